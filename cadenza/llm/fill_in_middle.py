"""Fill-in-the-middle: a text is cut into prefix, middle and suffix at unit ends, and its parts change places.

One Aho-Corasick automaton reads a text once and reports events only: the ASCII characters at which units may end, and the sentinels. What
lies between two events is counted by subtraction: in lines and words a gap holds no unit's end, in characters every place of it is one. So
the k-th unit's end is found by rank among the sparse events, and no list of units is made. Reading an output back uses the same automaton.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm import _text as T
from cadenza.llm._io import table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SENTINELS = (PREFIX, SUFFIX, MIDDLE)
#: The characters at which a unit may end; a unit goes on while such a character follows in words, and ends at each of them in lines.
ENDING = {"lines": "\n", "words": "\t\n\x0b\x0c\r ", "characters": ""}


@dataclass(frozen=True)
class Events:
    """What a scan has found: places of ending characters, (place, sentinel) pairs, and the text's length, all in code points."""

    ends: np.ndarray
    sentinels: list[tuple[int, str]]
    length: int


class Scanner:
    """The automaton over a kind of unit's ending characters and the sentinels."""

    def __init__(self, units: str = "lines"):
        self.units = units
        self.automaton = ahocorasick.Automaton()
        for c in ENDING[units]:
            self.automaton.add_word(c, "")
        for s in SENTINELS:
            self.automaton.add_word(s, s)
        self.automaton.make_automaton()

    def scan(self, text: str) -> Events:
        ends, sentinels = [], []
        for at, what in self.automaton.iter(text):
            if what:
                sentinels.append((at - len(what) + 1, what))
            else:
                ends.append(at)
        return Events(np.array(ends, np.int64), sentinels, len(text))

    def unit_ends(self, events: Events) -> np.ndarray | None:
        """Ends of units that events mark, in rising order; None: every place ends a unit. What follows the last one is a unit as well."""
        if self.units == "characters":
            return None
        ends = events.ends
        if self.units == "words" and len(ends):
            last = np.ones(len(ends), bool)
            last[:-1] = np.diff(ends) > 1  # an event right behind another leaves no gap, so the unit goes on
            ends = ends[last]
        return ends + 1

    def count(self, events: Events, ends: np.ndarray | None) -> int:
        if ends is None:
            return events.length
        return len(ends) + int(events.length > (int(ends[-1]) if len(ends) else 0))

    def end_of(self, events: Events, ends: np.ndarray | None, rank: int) -> int:
        """The place behind the first `rank` units."""
        if ends is None or rank == 0:
            return rank
        return int(ends[rank - 1]) if rank <= len(ends) else events.length


def draws(seed: int, ident: int | None) -> tuple[int, int, int, int]:
    """Four 32-bit numbers that a document's identifier and the seed decide; a null identifier is spelled as nothing."""
    digest = hashlib.sha256(f"{seed}:{'' if ident is None else ident}".encode()).hexdigest()
    return tuple(int(digest[i : i + 8], 16) for i in range(0, 32, 8))


def restored(output: str, form: str, scanner: Scanner) -> str:
    """The text that an output was made of. Parts of a changed text hold no sentinel, so the scan finds the three that were put in."""
    if form == "plain":
        return output
    (_, _), (second, _), (third, _) = scanner.scan(output).sentinels
    a, b, c = output[len(PREFIX) : second], output[second + len(SUFFIX) : third], output[third + len(MIDDLE) :]
    return a + c + b if form == "psm" else b + c + a


@dataclass(frozen=True)
class Choice:
    """How texts are changed: kind of unit, share in percent that is changed, percent of these in suffix-first form, seed."""

    units: str = "lines"
    percent: int = 100
    suffix_first: int = 50
    seed: int = 7


def change(text: str, ident: int | None, scanner: Scanner, choice: Choice) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, characters of the prefix, of the middle, output)."""
    events = scanner.scan(text)
    ends = scanner.unit_ends(events)
    n = scanner.count(events, ends)
    h1, h2, h3, h4 = draws(choice.seed, ident)
    if not text or events.sentinels or h3 % 100 >= choice.percent:
        return n, "plain", None, None, text
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = scanner.end_of(events, ends, first), scanner.end_of(events, ends, second)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < choice.suffix_first:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


_FIELDS = "{id} long, n long, form string, prefix_chars long, middle_chars long, "


def _changed(choice: Choice, digest: bool):
    """mapInArrow over (id, text): the changed text, or digests of it and of the text read back from it."""

    def run(batches):
        scanner = Scanner(choice.units)
        for whole in batches:
            for batch in T.slices(whole, "text", 8 << 20):
                ids = batch.column(0).to_pylist()
                rows = []
                for ident, text in zip(ids, batch.column(1), strict=True):
                    n, form, prefix, middle, out = change(text.as_py() or "", ident, scanner, choice)
                    if digest:
                        out = [hashlib.sha256(t.encode()).hexdigest() for t in (out, restored(out, form, scanner))]
                    else:
                        out = [out]
                    rows.append((n, form, prefix, middle, *out))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), *[pa.string()] * (2 if digest else 1)]
                names = ["id", "n", "form", "prefix_chars", "middle_chars", *(["output_sha256", "restored_sha256"] if digest else ["output"])]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=names)

    return run


def fill_in_middle(docs: DataFrame, choice: Choice = Choice(), ident: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: id, n (units), form (plain, psm or spm), prefix_chars, middle_chars and output.

    A null text counts as empty and stays plain, as do texts that hold a sentinel already; a null identifier draws as an empty one, and equal
    identifiers draw alike. Texts of any length are read whole; an empty table gives no rows. Other columns don't matter. Nothing is shuffled.
    """
    plain = docs.select(F.col(f"`{ident}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    return plain.mapInArrow(_changed(choice, False), _FIELDS.format(id="id") + "output string")


def read_back(changed: DataFrame, units: str = "lines") -> DataFrame:
    """(id, text) of what fill_in_middle has made: the exact texts."""

    def run(batches):
        scanner = Scanner(units)
        for whole in batches:
            for batch in T.slices(whole, "output", 8 << 20):
                texts = [restored(o.as_py(), f.as_py(), scanner) for o, f in zip(batch.column(2), batch.column(1), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    return changed.select("id", "form", "output").mapInArrow(run, "id long, text string")


def digests(docs: DataFrame, choice: Choice = Choice()) -> DataFrame:
    """fill_in_middle, with SHA-256 of each output and of the text that is read back from it in place of the output."""
    plain = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    return plain.mapInArrow(_changed(choice, True), _FIELDS.format(id="id") + "output_sha256 string, restored_sha256 string").withColumnRenamed("id", "doc_id")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document in fill-in-the-middle form by lines: doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256.

    Null, empty and sentinel-holding texts stay plain; repeated rows of one doc_id are changed alike; an empty table gives no rows.
    """
    return digests(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS l, CAST('0x' || substr(h, 1, 8) AS UBIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS UBIGINT) AS h2,
  CAST('0x' || substr(h, 17, 8) AS UBIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS UBIGINT) AS h4 FROM d),
c AS (SELECT *, len(l) AS n, CAST(least(h1 % (len(l) + 1), h2 % (len(l) + 1)) AS BIGINT) AS a, CAST(greatest(h1 % (len(l) + 1), h2 % (len(l) + 1)) AS BIGINT) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, coalesce(array_to_string(l[1:a], ''), '') AS prefix, coalesce(array_to_string(l[a + 1:b], ''), '') AS middle, coalesce(array_to_string(l[b + 1:n], ''), '') AS suffix FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p"""
