"""All queries of the sequence engine on the driver tables, with their SQL.

A trajectory is a user of `events`, its beats are the user's events by time, and a beat's signed channel is the value minus the user's
mean. A left/right pair is (l_discount, l_tax) of `lineitem`; a latent is a row of `embeddings`. Floats are rounded on both sides.
"""

from __future__ import annotations

from cadenza.plans import evaluation, events, latents, networks, pairs, records, shapes

FLAGSHIP = "maneuver_scores"
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for part in (events, pairs, latents, records, shapes, evaluation, networks):
    for name, (query, sql) in part.QUERIES.items():
        QUERIES[name] = query
        if sql is not None:
            ORACLE_SQL[name] = sql
