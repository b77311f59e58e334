"""Mixing sources to target weights by Efraimidis-Spirakis sampling, with DataFrame functions only.

A source whose target is T and whose documents have S words in all takes floor(T / S) complete epochs of every
document; the rest of the target is filled by weighted sampling without replacement: each document has the
exponential key -ln(u) / weight, documents are taken in ascending order of the key, and a running sum of sizes
cuts them at the budget (to the nearest document). u comes from an MD5 of seed and id, so reruns agree.

The running sum is of three levels, so that no task ever holds a source: keys are dealt into octave bins (64 for
each doubling of the key), which are few whatever the weights; a bin with many rows is cut evenly into parts of
about ``part_rows`` rows; rows are sorted only within their part. Windows over the sums of bins and of parts give
every part's offset.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, durable, table, unused

MOST = 3  # complete epochs at most; a target stops at this multiple of its source


def targets(sources: DataFrame, weights: Sequence[float]) -> DataFrame:
    """(source, source_size) -> also target. Weights go round in order of the source name (null last).

    The shares are a water-fill: in ascending order of cap / weight, sources are capped while their share of
    what is left exceeds their cap; the share of the first that isn't capped (the largest of these) is the
    common level. The table has a row for each source, so its windows are small.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("k", F.row_number().over(order) - 1).withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("k") % len(weights) + 1).cast("int")))
    filled = Window.orderBy((MOST * F.col("source_size") / F.col("w")), "k")
    before, on = filled.rowsBetween(Window.unboundedPreceding, -1), filled.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy(F.lit(0))
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum(MOST * F.col("source_size")).over(before), F.lit(0))) / F.sum("w").over(on)
    stepped = ranked.withColumn("level", level).withColumn("capped", level * F.col("w") > MOST * F.col("source_size"))
    final = stepped.withColumn("level", F.max(F.when(~F.col("capped"), F.col("level"))).over(every))
    return final.select("source", "source_size", F.when(F.col("capped"), MOST * F.col("source_size")).otherwise(F.col("w") * F.coalesce("level", F.lit(0.0))).cast("double").alias("target"))


BINS = 64  # for each doubling of a key


def mix(rows: DataFrame, weights: Sequence[float] = (5, 2, 1), seed: int = 42, part_rows: int = 20_000) -> DataFrame:
    """``rows`` (doc_id, source, size, weight) -> doc_id, size, source_size, target, taken, source.

    Defined cases: null sources are one source, ordered last; null or negative sizes count as 0 and such rows
    take 0; null or non-positive weights count as the smallest weight 1e-6; rows without an id draw their key from
    their size; repeated rows count each; an empty table gives no rows.
    """
    size = F.greatest(F.coalesce("size", F.lit(0)), F.lit(0)).cast("long")
    hexes = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("size "), size.cast("string")))))
    u = (F.conv(F.substring(hexes, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    weight = F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(1e-6))
    keyed = rows.select("doc_id", "source", size.alias("size"), (-F.log(u) / weight).alias("key"))
    keyed = durable(keyed.withColumn("bin", F.floor(F.log2("key") * BINS).cast("int")), "keys")
    bins = durable(keyed.groupBy("source", "bin").agg(F.sum("size").alias("n"), F.count("*").alias("n_rows")), "bins")
    aims = targets(bins.groupBy("source").agg(F.sum("n").alias("source_size")), weights)
    running = Window.partitionBy("source").orderBy("bin")
    offsets = bins.withColumn("offset", F.sum("n").over(running) - F.col("n")).withColumn("parts", F.ceil(F.col("n_rows") / part_rows))
    plan = offsets.join(aims, offsets["source"].eqNullSafe(aims["source"])).select(offsets["source"].alias("s"), F.col("bin").alias("b"), "offset", "parts", "source_size", "target")
    plan = durable(plan, "plan")
    low, high = F.pow(F.lit(2.0), F.col("bin") / BINS), F.pow(F.lit(2.0), (F.col("bin") + 1) / BINS)
    part = F.greatest(F.lit(0), F.least(F.col("parts") - 1, F.floor((F.col("key") - low) / (high - low) * F.col("parts"))))
    dealt = keyed.join(plan, keyed["source"].eqNullSafe(plan["s"]) & (keyed["bin"] == plan["b"])).withColumn("part", part.cast("long")).drop("s", "b")
    # Only bins of several parts need the sums of those before; their rows are few next to the documents'.
    sums = dealt.where("parts > 1").groupBy("source", "bin", "part").agg(F.sum("size").alias("n"))
    before = sums.select(F.col("source").alias("s"), F.col("bin").alias("b"), F.col("part").alias("p"), (F.sum("n").over(Window.partitionBy("source", "bin").orderBy("part")) - F.col("n")).alias("before"))
    dealt = dealt.join(before, dealt["source"].eqNullSafe(before["s"]) & (dealt["bin"] == before["b"]) & (dealt["part"] == before["p"]), "left").drop("s", "b", "p")
    inside = Window.partitionBy("source", "bin", "part").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("ahead", F.col("offset") + F.coalesce("before", F.lit(0)) + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    epochs = F.least(F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0), F.lit(MOST)).cast("long")
    rest = F.col("target") - epochs * F.col("source_size")
    fraction = F.when(F.col("ahead") + F.col("size") / 2 <= rest, 1).otherwise(0).cast("long")
    taken = F.col("size") * F.least(epochs + fraction, F.lit(MOST))
    return placed.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "source")


def sizes_and_weights(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight_col: str | None = None) -> DataFrame:
    """Words of each text, and its quality weight: the column ``weight_col``, such as a classifier's score. Without
    one a stand-in: 0.05 plus the square of the share of its words without any of the marks ``#*$%&|<>!`` (prose
    weighs about 1, markup and shouting little; empty texts 0.05)."""
    text = F.col(text_col).cast(T.StringType())
    named = [F.col(id_col).cast(T.LongType()).alias("doc_id"), F.col(source_col).cast(T.StringType()).alias("source"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size")]
    if weight_col:
        return docs.select(*named, F.col(weight_col).cast("double").alias("weight"))
    inner = docs.select(*named, F.coalesce(F.regexp_count(text, F.lit("[#*$%&|<>!]+")), F.lit(0)).alias("marks"))
    clean = F.greatest(F.lit(0.0), 1 - F.col("marks") / F.greatest("size", F.lit(1)))
    return inner.select("doc_id", "source", "size", (0.05 + F.when(F.col("size") > 0, clean * clean).otherwise(0.0)).alias("weight"))


def repeat_taken(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight_col: str | None = None) -> DataFrame:
    """Rows of ``docs`` repeated as often as the mix takes them, all columns kept.

    Rows that share an id (or have none) are repeated as often as the one of them that is taken most.
    """
    mixed = mix(sizes_and_weights(docs, id_col, text_col, source_col, weight_col), weights, seed).where("taken > 0")
    of, times = unused(docs, "of_doc"), unused(docs, "times")
    counted = mixed.groupBy("doc_id").agg(F.max(F.col("taken") / F.col("size")).cast("int").alias(times)).withColumnRenamed("doc_id", of)
    joined = docs.join(counted, F.col(id_col).cast(T.LongType()).eqNullSafe(F.col(of)))
    return joined.withColumn(of, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)


def op9_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(sizes_and_weights(table(spark, sf_dir, "documents"))).drop("source")


#: Same arithmetic in the same order. Keys only decide the order of documents within a source.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    coalesce(len(regexp_extract_all(text, '[#*$%&|<>!]+')), 0) AS marks FROM documents),
k AS (
  SELECT doc_id, source, size,
    -ln((('0x' || substr(md5('42:' || coalesce(doc_id::VARCHAR, 'size ' || size::VARCHAR)), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0)
    / (0.05 + CASE WHEN size > 0 THEN pow(greatest(0.0, 1 - marks / greatest(size, 1)::DOUBLE), 2) ELSE 0.0 END) AS key
  FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
w AS (
  SELECT source, source_size, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w,
    row_number() OVER (ORDER BY source NULLS LAST) AS k FROM s),
v AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w WINDOW o AS (ORDER BY 3 * source_size / w, k)),
t AS (
  SELECT source, source_size, CASE WHEN level * w > 3 * source_size THEN (3 * source_size)::DOUBLE
    ELSE w * max(CASE WHEN level * w <= 3 * source_size THEN level END) OVER () END AS target FROM v),
r AS (
  SELECT doc_id, size, source_size, target, least(CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END, 3)::BIGINT AS e,
    coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (size * least(e + CASE WHEN ahead + size / 2.0 <= target - e * source_size THEN 1 ELSE 0 END, 3))::BIGINT AS taken
FROM r
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op9_mixing_sources": op9_mixing_sources}
ORACLE_SQL: dict[str, str] = {"op9_mixing_sources": ORACLE}
