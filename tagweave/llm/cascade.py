"""Quality rules as a short-circuit cascade.

Every rule reads a few lazily computed statistics of a text. On a bounded sample the cost of a rule (seconds
for the statistics it adds) and its selectivity (share rejected) are estimated; rules run in descending order
of rejection per second, and a document leaves at the first rule that rejects it. The order changes the time,
never the verdict, because a document is kept only if no rule rejects it. ``report`` returns the base statistics of
every document besides, and so has to compute them for rejected ones too; only ``cascade`` gains from the order.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_text, table

SYMBOLS = b"#*$%&|<>"
ENDINGS = re.compile(rb"!!(?=\s|$)")


class Facts:
    """Statistics of one text, computed when first asked for and kept."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def raw(self) -> bytes:
        return self.text.encode("utf-8", "surrogatepass")

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.raw.count, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")))

    @cached_property
    def n_symbols(self) -> int:
        return sum(self.raw.count(SYMBOLS[i : i + 1]) for i in range(len(SYMBOLS)))

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.raw.split(b"\n") if x and not x.isspace()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        n = self.n_words
        if n < 4:
            return 0
        known = {w: i for i, w in enumerate(dict.fromkeys(self.words))}
        if len(known) == n:
            return 0
        ids = np.fromiter(map(known.__getitem__, self.words), np.int64, n)
        base = len(known)
        pairs = ids[:-1] * base + ids[1:]
        if base < 2_000_000:
            windows = pairs[:-1] * base + ids[2:]
        else:
            windows = np.unique(pairs, return_inverse=True)[1][:-1] * base + ids[2:]
        order = np.argsort(windows, kind="stable")
        same = np.concatenate(([False], windows[order][1:] == windows[order][:-1], [False]))
        again = np.zeros(n + 1, np.int64)
        places = order[same[1:] | same[:-1]]
        np.add.at(again, places, 1)
        covered = again[:n].copy()
        covered[1:] += again[: n - 1]
        covered[2:] += again[: n - 2]
        return int((covered > 0).sum())

    @cached_property
    def n_shouted(self) -> int:
        return len(ENDINGS.findall(self.raw))

    @cached_property
    def n_digits(self) -> int:
        return sum(self.raw.count(b"%d" % d) for d in range(10))


#: name -> rejects. The first two are the base; the others follow common web-corpus heuristics.
BASE = ("few_words", "repeats")
RULES: dict[str, Callable[[Facts], bool]] = {
    "few_words": lambda f: f.n_words < 50,
    "repeats": lambda f: 100 * f.n_repeat_words > 50 * f.n_words,
    "symbols": lambda f: 10 * f.n_symbols > f.n_words,
    "dup_lines": lambda f: 10 * f.n_dup_lines > 3 * len(f.lines),
    "long_words": lambda f: f.word_chars > 14 * f.n_words,
    "short_words": lambda f: f.word_chars < 2 * f.n_words,
    "shouting": lambda f: 10 * f.n_shouted > 3 * f.n_words,
    "digits": lambda f: 5 * f.n_digits > f.word_chars,
}


def measured(strata: list[tuple[float, list[str | None]]], rules: dict[str, Callable[[Facts], bool]] = RULES) -> list[tuple[str, float, float]]:
    """(rule, seconds a document, share rejected), ordered as the cascade runs them, from samples of strata and their
    shares of all documents. A rule is timed on facts of its own, so what it needs is charged to it in full."""
    found = []
    for name, rejects in rules.items():
        cost = hit = 0.0
        for share, sample in strata:
            facts = [Facts(t) for t in sample]
            began = time.perf_counter()
            hits = sum(map(rejects, facts))
            cost += share * (time.perf_counter() - began) / len(sample)
            hit += share * hits / len(sample)
        found.append((name, cost, hit))
    return sorted(found, key=lambda x: (-(x[2] / max(x[1], 1e-9)), x[1], x[0]))


def plan(docs: DataFrame, sample_rows: int = 400, long_chars: int = 20_000, long_rows: int = 12, text_col: str = "text") -> list[tuple[str, float, float]]:
    """Measures the rules on at most ``sample_rows`` texts of up to ``long_chars`` characters and ``long_rows`` longer
    ones, each kind weighted by its share of all documents, in one executor task; only the few figures come back.

    The rows are those with the smallest hashes of their texts, so a rerun takes the same ones. A threshold for
    the hashes, from the number of rows, lets about four times as many rows leave their tasks.
    """
    texts = docs.select(F.col(text_col).cast("string").alias("text")).withColumn("h", F.xxhash64("text")).withColumn("long", F.coalesce(F.char_length("text"), F.lit(0)) > long_chars)
    n, n_long = texts.agg(F.count("*"), F.count_if("long")).first()
    samples = []
    for is_long, rows, of in ((False, sample_rows, n - n_long), (True, long_rows, n_long)):
        kind = texts.where(F.col("long") == F.lit(is_long))
        if (share := 4 * rows / max(1, of)) < 1:
            kind = kind.where(F.col("h") <= int(-(2**63) + share * (2**64 - 1)))
        samples.append(kind.orderBy("h").limit(rows).select("text", "long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, list] = {False: [], True: []}
        for b in batches:
            for text, is_long in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held[is_long].append(text)
        strata = [(of / n, held[is_long]) for is_long, of in ((False, n - n_long), (True, n_long)) if held[is_long]]
        if strata:
            names, costs, shares = zip(*measured(strata))
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(costs, pa.float64()), pa.array(shares, pa.float64())], names=["rule", "cost", "rejected"])

    rows = samples[0].union(samples[1]).coalesce(1).mapInArrow(run, "rule string, cost double, rejected double").collect()
    return [tuple(r) for r in rows] or [(name, 0.0, 0.0) for name in RULES]


def cascade(docs: DataFrame, order: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, kept, rejected_by (the first rule of the order that rejects, null if kept).

    Defined cases: null and wordless texts have no words and fail the base; repeated rows are judged each; null
    ids stay null; an empty table gives no rows; further columns are ignored.
    """
    return _judged(docs, order, id_col, text_col, False).select("doc_id", "kept", "rejected_by")


def report(docs: DataFrame, order: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As cascade(), with the base statistics of every document, also of those rejected early."""
    return _judged(docs, order, id_col, text_col, True)


def _judged(docs: DataFrame, order: list[str] | None, id_col: str, text_col: str, full: bool) -> DataFrame:
    order = order or [name for name, _, _ in plan(docs, text_col=text_col)]
    stats = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = [(name, RULES[name]) for name in order]
        for batch in batches:
            rows: list[tuple] = []
            for i in range(0, batch.num_rows, 256):
                for t in batch.column(1).slice(i, 256).to_pylist():
                    f = Facts(t)
                    by = next((name for name, rejects in steps if rejects(f)), None)
                    given = tuple(getattr(f, s) for s in stats) if full else (None,) * 5
                    rows.append((*given, any(RULES[b](f) for b in BASE) if full else None, by is None, by))
            kinds = [*[pa.int64()] * 5, pa.bool_(), pa.bool_(), pa.string()]
            cols = zip(*rows) if rows else [[]] * 8
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(list(c), k) for c, k in zip(cols, kinds)]], names=["doc_id", *stats, "base_failed", "kept", "rejected_by"])

    schema = "doc_id long, " + ", ".join(f"{s} long" for s in stats) + ", base_failed boolean, kept boolean, rejected_by string"
    return id_text(docs, id_col, text_col).mapInArrow(run, schema)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict doesn't depend on the measured order; the rule named for a rejected document might, so it
    is left out."""
    return report(table(spark, sf_dir, "documents")).drop("rejected_by")


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
i AS (SELECT doc_id, w, generate_series AS i FROM d, generate_series(1, len(w) - 2)),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS t FROM i),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, t) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM c WHERE n > 1) GROUP BY doc_id),
f AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words,
    coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
    coalesce(r.n, 0)::BIGINT AS n_repeat_words,
    len(regexp_extract_all(text, '!![\x20\x09-\x0D]')) + CASE WHEN text LIKE '%!!' THEN 1 ELSE 0 END AS shouted,
    len(regexp_extract_all(text, '[0-9]')) AS digits
  FROM d LEFT JOIN r ON r.doc_id = d.doc_id),
s AS (SELECT *, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR 10 * n_dup_lines > 3 * len(ls) OR word_chars > 14 * n_words
    OR word_chars < 2 * n_words OR 10 * shouted > 3 * n_words OR 5 * digits > word_chars) AS kept
FROM s
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op4_quality_rules": op4_quality_rules}
ORACLE_SQL: dict[str, str] = {"op4_quality_rules": ORACLE}
