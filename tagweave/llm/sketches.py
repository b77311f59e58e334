"""Bottom-k sketches of word-shingle hashes as document fingerprints, with DataFrame functions only.

A sketch is the ascending array of the k smallest different 64-bit hashes of a text's five-word shingles. The
sketch of a union is the bottom k of the merged arrays, so sketches of parts merge; what two sketches share
among the bottom k of their union estimates resemblance, and the k-th smallest hash the number of shingles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, id_text, table

K, SHINGLE = 128, 5


def with_sketch(df: DataFrame, text: str, name: str, k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """Adds the sketch of column ``text``. Null, empty and wordless texts: an empty sketch; texts shorter than
    a shingle: their whole word sequence is the one shingle."""
    parts = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    step = df.withColumn("__h", F.transform(parts, lambda w: F.xxhash64(w)))
    h = F.col("__h")
    many = F.transform(F.sequence(F.lit(0), F.size(h) - shingle), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(shingle)]))
    some = F.when(F.size(h) > shingle, many).when(F.size(h) > 0, F.array(F.xxhash64(*[F.coalesce(F.get(h, F.lit(j)), F.lit(0)) for j in range(shingle)])))
    sketch = F.coalesce(F.slice(F.sort_array(F.array_distinct(some)), 1, k), F.array().cast("array<bigint>"))
    return step.withColumn(name, sketch).drop("__h")


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of what a and b were made from."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def shared(a: Column, b: Column, union: Column) -> Column:
    """Share of the bottom k of the union that both sketches have."""
    both = F.size(F.array_intersect(F.array_intersect(a, b), union))
    return F.when(F.size(union) == 0, 1.0).otherwise(both / F.size(union))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity, 0 to 1; two empty sketches resemble each other fully."""
    return shared(a, b, merge(a, b, k))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of different shingles; exact while the sketch isn't full."""
    spread = (F.element_at(a, -1).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / spread)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has too; an empty a is contained in everything."""
    return contained(a, b, merge(a, b, k), k)


def contained(a: Column, b: Column, union: Column, k: int = K) -> Column:
    """``containment`` where the sketch of the union is at hand."""
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), shared(a, b, union) * distinct_count(union, k) / distinct_count(a, k)))


def text_of(sketch: Column) -> Column:
    """Sixteen hexadecimal digits for each hash; an empty sketch is an empty string."""
    return F.lower(F.array_join(F.transform(sketch, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


RANGES = 16_384  # at most: bounds the boundaries, which travel with the plan, and the table of range tops


def range_bounds(docs: DataFrame, range_rows: int) -> list[int]:
    """Ascending lower bounds of ranges of doc_id with about ``range_rows`` rows each, whatever the ids are:
    approximate quantiles, of which at most RANGES come to the driver."""
    n = docs.where("doc_id IS NOT NULL").count()
    ranges = min(RANGES, n // range_rows)
    if ranges < 2:
        return []
    found = docs.agg(F.percentile_approx("doc_id", [k / ranges for k in range(1, ranges)], 10 * ranges)).first()[0]
    return sorted(set(found))


def range_of(bounds: list[int]) -> Column:
    """The number of bounds that are at most doc_id, by bisection; null for a null id."""
    if not bounds:
        return F.when(F.col("doc_id").isNotNull(), 0)
    held = F.array(*[F.lit(b).cast("long") for b in bounds])
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])
    ahead = lambda at, step: F.get(held, at + step - 1)  # noqa: E731  null beyond the last bound
    found = F.aggregate(steps, F.lit(0), lambda at, step: F.when(ahead(at, step) <= F.col("doc_id"), at + step).otherwise(at))
    return F.when(F.col("doc_id").isNotNull(), found)


def with_next(docs: DataFrame, range_rows: int = 500, k: int = K) -> DataFrame:
    """(doc_id, text) with next_text, that of the next row in descending doc_id (after the last, of the first), and
    sketches of both (``sketch``, ``next_sketch``).

    Rows are dealt by ranges of ids; the row with the largest id of a range is repeated in the next range that has
    rows, so every neighbour is in the same range and the texts are shuffled once. The repeated rows are at most
    RANGES, as are the tops of ranges that one window orders. Ties are ordered by text; rows with a null id form a
    range of their own, after all others.
    """
    bounds = range_bounds(docs, range_rows)
    plain = docs.withColumn("range", range_of(bounds)).withColumn("ghost", F.lit(False)).withColumn("at", F.col("doc_id"))
    tops = durable(docs.where("doc_id IS NOT NULL").select("doc_id", range_of(bounds).alias("range")).groupBy("range").agg(F.max("doc_id").alias("top")), "tops")
    least, most = tops.agg(F.min("range"), F.max("top")).first()
    after = F.coalesce(F.lead("range").over(Window.orderBy("range")), F.lit(least))
    goals = tops.select(F.col("top").alias("doc_id"), after.cast("int").alias("range"))
    first = F.when(F.col("doc_id") == most, F.lit(-(1 << 63))).otherwise(F.col("doc_id")) if most is not None else F.col("doc_id")
    ghosts = docs.join(F.broadcast(goals), "doc_id").withColumn("ghost", F.lit(True)).withColumn("at", first)
    inside = Window.partitionBy("range").orderBy(F.col("at").asc_nulls_first(), F.col("ghost").desc(), "text")
    both = with_sketch(plain.unionByName(ghosts), "text", "sketch", k)
    named = both.select("*", *[F.lag(c).over(inside).alias(f"next_{c}") for c in ("text", "sketch")])
    return named.where("NOT ghost").drop("range", "ghost", "at")


def fingerprints(docs: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Sketches of every text and of its edited text, whose second half comes from the next document.

    Defined cases: null texts are empty; equal texts have equal fingerprints; a single document is its own next
    document; of rows that share an id the next in descending order is the next smaller row (ordered by text),
    a null id has the next smaller of the null ids, the smallest of them none (an empty next text); an empty
    table gives no rows; further columns are ignored.
    """
    own = id_text(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    near = with_next(own, k=k).withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    following = F.coalesce("next_text", F.lit(""))
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring(following, F.lit(1), half))
    both = with_sketch(near.select("doc_id", "n_chars", "sketch", F.coalesce("next_sketch", F.array().cast("array<bigint>")).alias("next_sketch"), edited.alias("edited")), "edited", "edited_sketch", k)
    both = both.withColumn("edited_sha256", F.sha2("edited", 256)).drop("edited")
    for name, other in (("edited", "edited_sketch"), ("next", "next_sketch")):  # each union once, in a step of its own
        both = both.withColumn("union_" + name, merge(F.col("sketch"), F.col(other), k))
    near = lambda name, other: shared(F.col("sketch"), F.col(other), F.col("union_" + name)).alias("near_" + name)
    return both.select(
        "doc_id", "n_chars", "edited_sha256", text_of(F.col("sketch")).alias("fingerprint"), text_of(F.col("edited_sketch")).alias("edited_fingerprint"), near("edited", "edited_sketch"), near("next", "next_sketch"),
        contained(F.col("sketch"), F.col("edited_sketch"), F.col("union_edited"), k).alias("contained_in_edited"), distinct_count(F.col("sketch"), k).alias("n_shingles"),
    )


def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op5_document_fingerprints": op5_document_fingerprints}
ORACLE_SQL: dict[str, str] = {}
