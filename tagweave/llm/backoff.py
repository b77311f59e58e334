"""Stupid-backoff language-model scores from n-gram count tables of the whole corpus.

    S(w | context) = c(context w) / c(context)        if c(context w) >= least (words themselves: any count)
                   = alpha * S(w | shorter context)   otherwise;  S(w) = c(w) / words of the corpus

The relations are kept in blocks so that rows stay few and small. A block holds whole documents of about
``block_words`` words (a longer document is one block).

  1. Each block emits its different n-grams of all orders, hashed to 64 bits, with their counts: one row for each
     (block, part), where part is a range of hashes. This is the exploded n-gram relation, pre-aggregated, so a
     word that makes up a third of all text is one entry of a block.
  2. Rows are dealt by part. A task has one part of the count tables: it sums the counts of each n-gram and
     joins them back to the rows it received, in their order.
  3. Blocks (word sequences) and their counts are cogrouped by block; positions are scored and summed for each
     document. The size of the corpus comes in last, from the number of positions scored by single words.

The number of parts follows the size of the input, so a part of the count tables stays small. The input is read
twice and must give the same blocks both times: it is stored first, except where the caller knows that it is a plain
scan of files, whose splits are the same within a job; other blocks are noticed and end the job.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, id_text, table, words

ORDER, ALPHA, LEAST = 3, 0.4, 2
U = np.uint64


def word_hashes(tokens: list[bytes], memo: dict[bytes, int], most: int = 400_000) -> np.ndarray:
    missing = {w for w in tokens if w not in memo}
    if missing:
        if len(memo) + len(missing) > most:
            memo.clear()
            missing = set(tokens)
        for w in missing:
            memo[w] = xxhash.xxh64_intdigest(w)
    return np.fromiter(map(memo.__getitem__, tokens), U, len(tokens))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> U(32)) * U(0xD6E8FEB86659FD93)
    return x ^ x >> U(29)


def grams(hashes: np.ndarray, sizes: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order up to ``order``: (positions of last words, n-gram hashes); none crosses documents."""
    ends = np.cumsum(sizes)
    within = np.arange(len(hashes)) - np.repeat(ends - sizes, sizes)
    key = mixed(hashes)
    yield np.arange(len(hashes)), key
    for n in range(2, order + 1):
        at = np.flatnonzero(within >= n - 1)
        longer = np.zeros(len(hashes), U)
        longer[at] = mixed(key[at - 1] * U(0x9E3779B97F4A7C15) + hashes[at] + U(n))
        key = longer
        yield at, key[at]


def squeeze(a: np.ndarray) -> bytes:
    """Integers by byte planes, compressed: high bytes of small numbers vanish."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes())


def unsqueeze(data: bytes, kind: str, n: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data, max_output_size=n * size or 1), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).reshape(-1).view(kind) if n else np.zeros(0, kind)


def gaps(keys: np.ndarray) -> np.ndarray:
    return np.diff(keys, prepend=U(0))


def in_blocks(batches: Iterator[pa.RecordBatch], block_words: int) -> Iterator[tuple[int, list, np.ndarray, np.ndarray]]:
    """(block, doc ids, words of each, word hashes)."""
    memo = sys.__dict__.setdefault("_tagweave_words", {})
    base, block = TaskContext.get().partitionId() << 24, 0
    ids: list = []
    held: list[np.ndarray] = []
    gathered = 0
    for batch in batches:
        names = batch.column(0).to_pylist()
        for i in range(0, len(names), 256):
            for name, text in zip(names[i : i + 256], batch.column(1).slice(i, 256).to_pylist()):
                h = word_hashes(words(text, lower=True), memo)
                if held and gathered + len(h) > block_words:
                    yield base + block, ids, np.array([len(x) for x in held]), np.concatenate(held)
                    block, ids, held, gathered = block + 1, [], [], 0
                ids.append(name)
                held.append(h)
                gathered += len(h)
    if held:
        yield base + block, ids, np.array([len(x) for x in held]), np.concatenate(held)


def requests(inner: DataFrame, parts: int, order: int, block_words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = np.array([(k << 64) // parts for k in range(1, parts)], U)
        for block, _, sizes, hashes in in_blocks(batches, block_words):
            for level, (_, found) in enumerate(grams(hashes, sizes, order)):  # one order at a time: a third of the memory
                keys, counts = np.unique(found, return_counts=True)
                cuts = [0, *np.searchsorted(keys, bounds).tolist(), len(keys)]
                rows = [(block, p, level, b - a, squeeze(gaps(keys[a:b])), squeeze(counts[a:b].astype("<u4"))) for p, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
                if rows:
                    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=["block", "part", "level", "n", "keys", "counts"])

    return inner.mapInArrow(run, "block long, part int, level int, n long, keys binary, counts binary")


def answers(asked: DataFrame) -> DataFrame:
    """Joins every row's n-grams with the count table of its part; one group of the input is one part."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        keys = [np.cumsum(unsqueeze(k, "<u8", n), dtype=U) for k, n in zip(rows["keys"], rows["n"])]
        counts = np.concatenate([unsqueeze(c, "<u4", n) for c, n in zip(rows["counts"], rows["n"])])
        _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        totals = np.bincount(inverse, counts).astype("<u8")[inverse]  # sums of doubles, exact to 2^53
        out, at = [], 0
        for n in rows["n"]:
            out.append(squeeze(totals[at : at + n]))
            at += n
        return pd.DataFrame({"block": rows["block"], "part": rows["part"], "level": rows["level"], "n": rows["n"], "body": out})

    return asked.groupBy("part").applyInPandas(run, "block long, part int, level int, n long, body binary")


def texts_of(inner: DataFrame, block_words: int) -> DataFrame:
    """The blocks themselves, one row each: ids, sizes, vocabulary and word numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, sizes, hashes in in_blocks(batches, block_words):
            vocabulary, numbers, counts = np.unique(hashes, return_inverse=True, return_counts=True)
            by_count = np.argsort(-counts, kind="stable")
            rank = np.empty(len(by_count), "<u4")
            rank[by_count] = np.arange(len(by_count))
            nulls = np.array([d is None for d in ids], np.uint8)
            chunks = [np.array([len(ids), len(vocabulary), len(hashes)], "<i8").tobytes()]
            for a in (np.array([d or 0 for d in ids], "<i8"), nulls, sizes.astype("<u4"), vocabulary[by_count].astype("<u8"), rank[numbers]):
                data = squeeze(a)
                chunks += [np.array([len(data)], "<i8").tobytes(), data]
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([b"".join(chunks)], pa.binary())], names=["block", "body"])

    return inner.mapInArrow(run, "block long, body binary")


def opened(data: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    docs, vocabulary, n = np.frombuffer(data, "<i8", 3).tolist()
    at, got = 24, []
    for kind, size in (("<i8", docs), ("u1", docs), ("<u4", docs), ("<u8", vocabulary), ("<u4", n)):
        length = int(np.frombuffer(data, "<i8", 1, at)[0])
        got.append(unsqueeze(data[at + 8 : at + 8 + length], kind, size))
        at += 8 + length
    ids, nulls, sizes, hashes, numbers = got
    return [None if z else d for d, z in zip(ids.tolist(), nulls.tolist())], sizes.astype(np.int64), hashes[numbers]


def scored(given: pd.DataFrame, block: pd.DataFrame, order: int, alpha: float, least: int) -> pd.DataFrame:
    """Scores of one block, without the size of the corpus."""
    if len(block) != 1:
        raise RuntimeError("the input gave other blocks when it was read again")
    ids, sizes, hashes = opened(block["body"].iloc[0])
    given = given.sort_values(["level", "part"])
    counts, all_places = [], []
    for level, (places, found) in enumerate(grams(hashes, sizes, order)):
        keys, inverse = np.unique(found, return_inverse=True)
        own = given[given["level"] == level]
        totals = np.concatenate([unsqueeze(b, "<u8", n) for b, n in zip(own["body"], own["n"])]) if len(own) else np.zeros(0, "<u8")
        if len(totals) != len(keys):
            raise RuntimeError("the input gave other blocks when it was read again")
        full = np.zeros(len(hashes), np.float32 if totals.max(initial=0) < 1 << 24 else np.float64)
        full[places] = totals[inverse]
        counts.append(full)
        all_places.append(places)
    score, hit = np.log10(np.maximum(counts[0], 1), dtype=np.float64), np.ones(len(hashes), np.int8)
    step = np.log10(alpha)
    for n in range(2, order + 1):
        places = all_places[n - 1]
        seen = counts[n - 1][places] >= least
        there, away = places[seen], places[~seen]
        score[there] = np.log10(counts[n - 1][there], dtype=np.float64) - np.log10(counts[n - 2][there - 1], dtype=np.float64)
        hit[there] = n
        score[away] += step
    owner = np.repeat(np.arange(len(sizes)), sizes)
    total = np.bincount(owner, score, minlength=len(sizes))
    hits = {f"n_order{n}": np.bincount(owner[hit == n], minlength=len(sizes)).astype(np.int64) for n in range(1, order + 1)}
    return pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "n_words": sizes, "partial": total, **hits})


def backoff_scores(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, least: int = LEAST, block_words: int = 2_000_000, part_bytes: int = 1 << 24, store: bool = True,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, score (log10, summed), mean_score, n_order1.. (positions scored by each order).

    ``least`` isn't part of the published formula, which takes every count (least=1). Here the documents scored are
    those counted, so an n-gram seen once was seen in its own document alone; with 2 it backs off. ``part_bytes``:
    text for each part of the count tables. ``store``: keep the input in the shared folder before it is read twice.

    Words are runs of bytes other than white space, A-Z lower-cased. Defined cases: null, empty and wordless
    texts have no words, score 0 and a null mean; repeated rows are documents each and count each; null ids
    stay null; an empty table gives no rows; further columns are ignored.
    """
    spark = docs.sparkSession
    inner = id_text(docs, id_col, text_col)
    if store:
        inner = durable(inner, "texts")
    size = inner.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // part_bytes))
    # Two inputs, not a union: in a union the partition numbers that name the blocks would be shifted.
    counted = answers(requests(inner, parts, order, block_words)).groupBy("block")
    both = counted.cogroup(texts_of(inner, block_words).groupBy("block"))
    names = [f"n_order{n}" for n in range(1, order + 1)]
    schema = "doc_id long, n_words long, partial double, " + ", ".join(f"{n} long" for n in names)
    sums = durable(both.applyInPandas(lambda a, b: scored(a, b, order, alpha, least), schema), "scores")
    size = sums.agg(F.sum("n_words")).first()[0] or 1
    score = F.col("partial") - F.col("n_order1") * F.log10(F.lit(float(max(size, 1))))
    return sums.select("doc_id", "n_words", score.alias("score"), F.when(F.col("n_words") > 0, score / F.col("n_words")).alias("mean_score"), *names)


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores to four decimals and their means to six, because sums of doubles depend on their order."""
    scores = backoff_scores(table(spark, sf_dir, "documents"), store=False)  # a plain scan of files
    return scores.withColumn("score", F.round("score", 4)).withColumn("mean_score", F.round("mean_score", 6))


ORACLE = r"""
WITH x AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM x),
g AS (SELECT doc_id, i, w, lag(w) OVER o AS p, lag(w, 2) OVER o AS q FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
c1 AS (SELECT w, count(*) AS n FROM g GROUP BY w), c2 AS (SELECT p, w, count(*) AS n FROM g WHERE p IS NOT NULL GROUP BY ALL), c3 AS (SELECT q, p, w, count(*) AS n FROM g WHERE q IS NOT NULL GROUP BY ALL),
h AS (
  SELECT g.doc_id, g.q, g.p, a.n AS n1, before.n AS n1p, b.n AS n2, pair.n AS n2p, c.n AS n3
  FROM g JOIN c1 a ON a.w = g.w LEFT JOIN c1 before ON before.w = g.p LEFT JOIN c2 b ON b.p = g.p AND b.w = g.w
  LEFT JOIN c2 pair ON pair.p = g.q AND pair.w = g.p LEFT JOIN c3 c ON c.q = g.q AND c.p = g.p AND c.w = g.w),
s AS (
  SELECT doc_id, CASE WHEN n3 >= 2 THEN 3 WHEN n2 >= 2 THEN 2 ELSE 1 END AS level,
    CASE WHEN n3 >= 2 THEN log10(n3 / n2p::DOUBLE) WHEN n2 >= 2 THEN log10(n2 / n1p::DOUBLE) ELSE log10(n1 / (SELECT count(*) FROM g)::DOUBLE) END
    + log10(0.4) * CASE WHEN n3 >= 2 THEN 0 WHEN n2 >= 2 THEN (q IS NOT NULL)::INT ELSE (p IS NOT NULL)::INT + (q IS NOT NULL)::INT END AS v FROM h),
t AS (SELECT doc_id, sum(v) AS v, count(*) AS n, count(*) FILTER (level = 1) AS k1, count(*) FILTER (level = 2) AS k2, count(*) FILTER (level = 3) AS k3 FROM s GROUP BY doc_id)
SELECT x.doc_id, coalesce(t.n, 0)::BIGINT AS n_words, round(coalesce(t.v, 0), 4) AS score, round(t.v / t.n, 6) AS mean_score,
  coalesce(t.k1, 0)::BIGINT AS n_order1, coalesce(t.k2, 0)::BIGINT AS n_order2, coalesce(t.k3, 0)::BIGINT AS n_order3
FROM x LEFT JOIN t USING (doc_id)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_lm_scoring": op1_lm_scoring}
ORACLE_SQL: dict[str, str] = {"op1_lm_scoring": ORACLE}
