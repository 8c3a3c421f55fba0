"""Language by prediction by partial matching: frozen byte context trees, one for each language, and exact code lengths."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm import _text as T
from cadenza.llm._io import drop, table, written

ORDER = 3
#: A context of full length stands in the trees from this many occurrences on; rarer ones use the shorter context.
LEAST = 24
#: Contexts of two bytes, and of three, that the trees hold at most: the most frequent ones. They bound the model, not what is counted.
CONTEXTS = 1 << 16
#: Code lengths that the model tabulates at most; many languages leave room for fewer contexts.
CELLS = 1 << 27
#: Bytes whose code lengths are looked up together.
CHUNK = 1 << 20
UNKNOWN = "und"


@dataclass
class Model:
    """languages; code of each byte (0: never seen); state of each full context; bits[state * symbols + symbol, language]."""

    languages: list[str]
    codes: np.ndarray
    states: np.ndarray
    bits: np.ndarray


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 4 == 2


def _contexts(batches):
    """mapInArrow: (lang, gram, n), gram being a byte and the three before it (zeros before a text's start)."""
    for whole in batches:
        for batch in T.slices(whole, "text"):
            data, offsets = T.buffers(batch.column(1))
            gram, owner = _grams(T.LOWER_AZ[data], offsets)
            if not len(gram):
                continue
            coded = batch.column(0).dictionary_encode()
            key = coded.indices.to_numpy()[owner].astype(np.int64) << 32 | gram
            keys, n = np.unique(key, return_counts=True)
            yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(keys >> 32)), pa.array(keys & 0xFFFFFFFF), pa.array(n)], names=["lang", "gram", "n"])


def _padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes with three zeros before each text, where the texts' own bytes stand)."""
    n = len(offsets) - 1
    at = T.ranges(offsets[:-1] + 3 * np.arange(1, n + 1), np.diff(offsets))
    out = np.zeros(len(data) + 3 * n, data.dtype)
    out[at] = data
    return out, at


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    padded, at = _padded(data, offsets)
    wide = padded.astype(np.int64)
    return wide[at - 3] << 24 | wide[at - 2] << 16 | wide[at - 1] << 8 | wide[at], np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def _code_lengths(counts: list[np.ndarray]) -> np.ndarray:
    """Bits of every symbol in each context. counts: symbol counts by context (rows) from the longest context to the empty one.

    Escape method C with exclusion: a context gives a seen symbol n / (t + u) and leaves u / (t + u) to shorter
    contexts, which count only symbols that no longer one has seen. Behind the empty context all 256 bytes are alike.
    """
    rows, symbols = counts[0].shape
    p = np.zeros((rows, symbols))
    open_ = np.ones((rows, symbols), bool)
    left = np.ones((rows, 1))
    for c in counts:
        c = np.where(open_, c, 0)
        total, kinds = c.sum(axis=1, keepdims=True), (c > 0).sum(axis=1, keepdims=True)
        share = np.where(total > 0, total + kinds, 1)
        p += left * c / share
        left = np.where(total > 0, left * kinds / share, left)
        open_ &= c == 0
    # symbol 0 stands for every byte that was never seen
    alike = 256 - (symbols - open_[:, 1:].sum(axis=1, keepdims=True) - 1)
    return -np.log2(np.where(open_, left / alike, p))


def build(rows: list[tuple[str, int, int]], least: int = LEAST) -> Model:
    """The frozen trees from (language, gram, count) rows."""
    languages = sorted({r[0] for r in rows})
    number = {x: i for i, x in enumerate(languages)}
    lang, gram, n = np.array([number[r[0]] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64)
    context, at = np.unique(gram >> 8, return_inverse=True)
    often = (np.bincount(at, n) >= least)[at]
    return _trees(languages, (lang, gram & 0xFFFFFF, n), (lang[often], gram[often], n[often]))


def _trees(languages: list[str], short: tuple[np.ndarray, ...], long: tuple[np.ndarray, ...]) -> Model:
    """short: (language, gram of three bytes, count) of all grams; long: the same with four bytes, of the contexts that the trees hold."""
    lang, gram, n = short
    seen = np.unique(gram & 0xFF)
    codes = np.zeros(256, np.int64)
    codes[seen] = np.arange(1, len(seen) + 1)
    symbols = len(seen) + 1
    digits = [codes[gram >> shift & 0xFF] for shift in (16, 8, 0)]
    pair, one = digits[0] * symbols + digits[1], digits[1]
    full = (codes[long[1] >> 24 & 0xFF] * symbols + codes[long[1] >> 16 & 0xFF]) * symbols + codes[long[1] >> 8 & 0xFF]
    last = codes[long[1] & 0xFF]
    # contexts of the joint tree: all single bytes, the most frequent pairs, and triples whose pair is among them
    room = max(1, min(CONTEXTS, CELLS // (2 * symbols * len(languages))))
    totals = np.bincount(pair, n, symbols**2)
    pairs = np.sort(np.argsort(-totals, kind="stable")[: min(room, int((totals > 0).sum()))])
    triples, at = np.unique(full, return_inverse=True)
    totals = np.bincount(at, long[2], len(triples)) if len(triples) else np.zeros(0)
    totals[~np.isin(triples % symbols**2, pairs)] = 0
    triples = np.sort(triples[np.argsort(-totals, kind="stable")[: min(room, int((totals > 0).sum()))]])
    tables = []
    for k in range(len(languages)):
        own = lang == k

        def table_of(context, size, symbol, n):
            return np.bincount(context * symbols + symbol, n, size * symbols).reshape(size, symbols)

        zero = table_of(np.zeros_like(one[own]), 1, digits[2][own], n[own])
        first = table_of(one[own], symbols, digits[2][own], n[own])
        inside = own & np.isin(pair, pairs)
        second = table_of(np.searchsorted(pairs, pair[inside]), len(pairs), digits[2][inside], n[inside])
        inside = (long[0] == k) & np.isin(full, triples)
        third = table_of(np.searchsorted(triples, full[inside]), len(triples), last[inside], long[2][inside]) if len(triples) else np.zeros((0, symbols))
        lengths = [_code_lengths([first, np.repeat(zero, symbols, axis=0)])]
        lengths.append(_code_lengths([second, first[pairs % symbols], np.repeat(zero, len(pairs), axis=0)]))
        short_ = triples % symbols**2
        lengths.append(_code_lengths([third, second[np.searchsorted(pairs, short_)], first[short_ % symbols], np.repeat(zero, len(triples), axis=0)]))
        tables.append(np.concatenate(lengths).astype(np.float32))
    bits = np.stack(tables, axis=-1)
    # the state of a full context: its triple, else its pair, else its last byte
    by_pair = np.tile(np.arange(symbols), symbols)
    by_pair[pairs] = symbols + np.arange(len(pairs))
    states = np.tile(by_pair, symbols).astype(np.int32)
    states[triples] = symbols + len(pairs) + np.arange(len(triples))
    return Model(languages, codes.astype(np.uint8), states, bits.reshape(-1, len(languages)))


def train(docs: DataFrame, least: int = LEAST) -> Model | None:
    """Learns from text and lang of all documents that aren't held out; None if there are none.

    Grams are counted on the executors and merge in the map tasks. What reaches the driver is bounded by the model: counts of grams of
    three bytes, and of four behind the CONTEXTS most frequent contexts that occur `least` times or more.
    """
    usable = docs.where(~held_out() & F.col("lang").isNotNull() & (F.length("text") > 0)).select("lang", "text")
    counts = written(usable.mapInArrow(_contexts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    context = F.shiftright("gram", 8).alias("context")
    often = counts.groupBy(context).agg(F.sum("n").alias("uses")).where(F.col("uses") >= least).orderBy(F.desc("uses"), "context").limit(CONTEXTS)
    short = counts.groupBy("lang", F.col("gram").bitwiseAND(0xFFFFFF).alias("gram")).agg(F.sum("n").alias("n")).toArrow()
    if not short.num_rows:
        return None
    long = counts.join(often.select("context"), F.shiftright("gram", 8) == F.col("context"), "left_semi").toArrow()
    drop(counts)
    languages = sorted(set(short.column("lang").to_pylist()))

    def arrays(table: pa.Table) -> tuple[np.ndarray, ...]:
        coded = table.column("lang").combine_chunks().dictionary_encode()
        number = np.array([languages.index(x) for x in coded.dictionary.to_pylist()], np.int64)
        return number[coded.indices.to_numpy()] if len(number) else np.zeros(0, np.int64), table.column("gram").to_numpy(), table.column("n").to_numpy()

    return _trees(languages, arrays(short), arrays(long))


def score(model: Model, texts: pa.Array) -> np.ndarray:
    """Bits of every text under every language."""
    data, offsets = T.buffers(texts)
    out = np.zeros((len(texts), len(model.languages)))
    codes, at = _padded(model.codes[T.LOWER_AZ[data]], offsets)
    symbols = int(round(len(model.states) ** (1 / 3)))
    for low in range(0, len(at), CHUNK):  # a chunk is all of a batch but for very long texts
        part = at[low : low + CHUNK]
        wide = codes[part[0] - 3 : part[-1] + 1].astype(np.int32)
        part = part - (part[0] - 3)
        state = model.states[(wide[part - 3] * symbols + wide[part - 2]) * symbols + wide[part - 1]]
        edges = np.clip(offsets - low, 0, len(part))
        some = np.flatnonzero(np.diff(edges))
        out[some] += np.add.reduceat(model.bits[state * symbols + wide[part]], edges[some], axis=0, dtype=np.float64)
    return out


def _letters(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text holds a letter of any script."""
    low = data | 0x20
    counts = np.concatenate([[0], np.cumsum((low >= 0x61) & (low <= 0x7A))])
    found = np.diff(counts[offsets]) > 0
    for i in np.flatnonzero(~found & (np.diff(offsets) > 0)):
        found[i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))
    return found


def predict(docs: DataFrame, model: Model | None, keep: list[str]) -> DataFrame:
    """The columns `keep`, and lang_pred and score: the language of the shortest code and its share among all languages' likelihoods.

    Only the text is looked at, whole. A null text and one without a letter are `und` with score 0, as is every text if nothing was learned.
    """
    schema = docs.select(*keep).schema
    fields = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in schema] + ["lang_pred string", "score double"])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for whole in batches:
            for batch in T.slices(whole, "_text"):
                texts = batch.column(batch.num_columns - 1)
                letters = _letters(*T.buffers(texts))
                lang, part = [UNKNOWN] * len(texts), np.zeros(len(texts))
                if model is not None:
                    bits = score(model, texts)
                    best = bits.argmin(axis=1)
                    share = 1 / np.exp2(np.maximum(-1000, bits.min(axis=1, keepdims=True) - bits)).sum(axis=1)
                    lang = [model.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), letters.tolist(), strict=True)]
                    part = np.where(letters, share, 0.0)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(lang), pa.array(part)], names=[*keep, "lang_pred", "score"])

    return docs.select(*keep, F.coalesce("text", F.lit("")).alias("_text")).mapInArrow(run, fields)


def identify(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, held_out, lang_pred, score. Null languages teach nothing; repeated rows each give a row and teach
    once each; of languages with equally long codes the first by name is taken; an empty table gives none."""
    marked = docs.withColumn("held_out", held_out())
    return predict(marked, train(docs), ["doc_id", "held_out"])


def with_language(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """Documents of a certain language: `und` and scores under `least` go; columns stay as they are, even ones named like a result."""
    names = {c: f"_{i}" for i, c in enumerate(docs.columns)}
    plain = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], "text")
    found = predict(plain, train(docs), list(names.values())).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    return found.select(*[F.col(n).alias(c) for c, n in names.items()])


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's language by the shortest exact code, learned from documents that aren't held out.

    Null texts, and those without a letter, are `und`; documents without a language are predicted but not learned from; repeated rows each give a row; an empty table gives none.
    """
    return identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
