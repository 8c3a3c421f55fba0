"""Content sort, fill-in-the-middle and source divergence: against their SQL on the smallest tables and on lopsided small ones."""

import hashlib
import random

import duckdb
import pandas as pd
import pytest
from cadenza.llm import content_sort, divergence, fill_in_middle
from cadenza.llm.queries import ORACLE_SQL, QUERIES
from hypothesis import given
from hypothesis import strategies as st

FIELDS = "doc_id long, text string, lang string, source string"


def rows_of(df):
    return sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=repr)


def by_sql(sql, documents):
    con = duckdb.connect()
    con.register("frame", pd.DataFrame(documents, columns=["doc_id", "text", "lang", "source"]).astype({"doc_id": "Int64", "text": "string", "lang": "string", "source": "string"}))
    con.execute("create view documents as select CAST(doc_id AS BIGINT) AS doc_id, CAST(text AS VARCHAR) AS text, CAST(lang AS VARCHAR) AS lang, CAST(source AS VARCHAR) AS source from frame")
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    order = [names.index(n) for n in sorted(names)]
    return sorted((tuple(r[i] for i in order) for r in found.fetchall()), key=repr)


def lopsided(seed):
    r = random.Random(seed)
    text = lambda: "".join(r.choice(["ab", "AB", "Éa", "\n", " ", "x\n", "İ", "<P>", "😀", "the ", "1"]) for _ in range(r.randint(0, 12)))
    rows = [(i, r.choice(["hot Text\nof\nlines", "HOT text\nof\nlines"]) if r.random() < 0.35 else text(), r.choice(["en", "en", "de", None]), r.choice(["a", "a", "b", "c", None])) for i in range(150)]
    rows += [(200, "long " * 40_000 + "\n" + "q" * 100_000, "en", "a"), (201, None, "fr", "z"), (202, "", "fr", None), (203, "<M>", "xx", "only"), (None, "no id", "en", "b"), (None, "hot text\nof\nlines", "en", "b")]
    return rows + rows[:5] + [(7, rows[7][1], "en", "b")]


@pytest.fixture(scope="module")
def table_dir(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("lopsided"))
    spark.createDataFrame(lopsided(3), FIELDS).repartition(5).write.parquet(f"{at}/documents.parquet")
    return at


NAMES = ["op11_content_sort", "op12_fill_in_middle", "op13_source_divergence"]


@pytest.mark.parametrize("name", NAMES)
def test_as_sql(spark, small, name):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang", "source").collect()
    assert rows_of(QUERIES[name](spark, small)) == by_sql(ORACLE_SQL[name], docs)


@pytest.mark.parametrize("name", NAMES)
def test_lopsided(spark, table_dir, name):
    assert rows_of(QUERIES[name](spark, table_dir)) == by_sql(ORACLE_SQL[name], lopsided(3))


@pytest.mark.parametrize("name", NAMES)
def test_empty(spark, tmp_path, name):
    spark.createDataFrame([], FIELDS).write.parquet(f"{tmp_path}/documents.parquet")
    assert QUERIES[name](spark, str(tmp_path)).collect() == []


def test_copies_over_many_partitions(spark):
    """Groups that go on over several partitions, some of them whole partitions."""
    rows = [(i, ["b", "B", "a", "c", "bb"][i % 5] if i < 400 else f"{i}", None, None) for i in range(420)]
    docs = spark.createDataFrame(rows, FIELDS).repartition(7)
    for keep in ("smallest", "largest"):
        found = {r.id: r for r in content_sort.copies(docs, keep, partitions=37).collect()}
        groups = {}
        for i, t, _, _ in rows:
            groups.setdefault(t.lower(), []).append(i)
        for t, ids in groups.items():
            first = min(ids) if keep == "smallest" else max(ids)
            for i in ids:
                assert (found[i].keep_id, found[i].group_size, found[i].kept, found[i].text_sha256) == (first, len(ids), i == first, hashlib.sha256(t.encode()).hexdigest())


def test_without_copies_keeps_columns(spark):
    names = ["id", "text", "head", "digest", "size", "keep", "first", "part", "edge", "keep_id", "kept", "doc_id", "_0"]
    docs = spark.createDataFrame([(1, "A", *[1] * 9, 5, 1), (1, "a", *[2] * 9, 4, 2), (1, "a", *[2] * 9, 4, 2), (2, None, *[3] * 9, 6, 3)], ", ".join(f"{n} {'string' if n == 'text' else 'long'}" for n in names))
    found = content_sort.without_copies(docs)
    assert found.columns == names and sorted((r.doc_id, r.text) for r in found.collect()) == [(4, "a"), (6, None)]
    assert content_sort.copies(docs).count() == fill_in_middle.digests(docs).count() == 4


@given(st.text("ab\n <PSM>é", max_size=30), st.integers(0, 50), st.sampled_from(list(fill_in_middle.ENDING)))
def test_parts_and_way_back(text, ident, units):
    import re

    scanner = fill_in_middle.Scanner(units)
    n, form, prefix, middle, out = fill_in_middle.change(text, ident, scanner, fill_in_middle.Choice(units))
    spelled = re.findall({"lines": r"[^\n]*\n|[^\n]+", "words": r"[^\t-\r ]*[\t-\r ]+|[^\t-\r ]+", "characters": r"(?s)."}[units], text)
    assert n == len(spelled) and fill_in_middle.restored(out, form, scanner) == text
    assert (form == "plain") == (not text or any(s in text for s in fill_in_middle.SENTINELS))
    if form != "plain":
        cuts = {sum(map(len, spelled[:k])) for k in range(n + 1)}
        assert {prefix, prefix + middle} <= cuts


def test_outputs_read_back(spark):
    rows = [(1, "one\ntwo\n\nthree", None, None), (2, None, None, None), (3, "a<S>b", None, None), (4, "x" * 10_000, None, None)]
    for units in fill_in_middle.ENDING:
        made = fill_in_middle.fill_in_middle(spark.createDataFrame(rows, FIELDS), fill_in_middle.Choice(units, percent=60))
        assert sorted(map(tuple, fill_in_middle.read_back(made, units).collect())) == [(i, t or "") for i, t, _, _ in rows]


def test_blocks_of_groups(spark, monkeypatch):
    """Posting lists in several blocks, and a language without kept terms, give what one block gives."""
    docs = spark.createDataFrame(lopsided(5), FIELDS)
    whole = rows_of(divergence.audit(docs))
    monkeypatch.setattr(divergence, "BLOCK", 2)
    assert rows_of(divergence.audit(docs)) == whole == by_sql(ORACLE_SQL["op13_source_divergence"], lopsided(5))
    assert {r.value for r in divergence.audit(docs, least=10**6).collect()} == {0}
