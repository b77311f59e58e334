"""Line dedup by overlapping three-line windows, with DataFrame functions only.

Lines are the parts of a text between line feeds. A window is a run of three consecutive lines; windows overlap:
one starts at every line. Each window is known by two 64-bit hashes of its line hashes. The smallest (doc_id, first
line) of a window is its first occurrence and stays; the lines of every later occurrence are covered, covered
positions of a document are merged into one set, and the lines in it are removed.

With ``long_words`` (off by default) runs of one or two lines that hold more words than that are windows as well.
op10 and the pipeline set it to ``PASSAGE_WORDS``, so that a repeated passage of over 50 words is found whether it is
set as three lines or as one.

Windows that occur once are dropped after a pre-aggregated count, so only repeated ones are joined back, from
a stored table, as a plain sort-merge join whose hot windows Spark splits at run time. A document's covered
positions are gathered in one row (they are fewer than its lines).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, durable, table, unused

LINES, PASSAGE_WORDS = 3, 50


def window_rows(docs: DataFrame, long_words: int | None) -> DataFrame:
    """(doc_id, at, size, w1, w2) of every window of (doc_id, text)."""
    lines = F.split("text", "\n")
    size_of = lambda x: F.regexp_count(x, F.lit(WORD)).cast("int")
    hashed = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("h"), F.xxhash64(F.lit(1), x).alias("g"), size_of(x).alias("n"))).alias("ls"))
    sized = hashed.select("doc_id", "ls", F.size("ls").alias("n_lines"))
    rows = sized.select("doc_id", "ls", F.explode(F.sequence(F.lit(0), F.col("n_lines") - 1)).alias("at"))
    at = lambda k: F.get("ls", F.col("at") + k)  # noqa: E731  null beyond the last line
    flat = rows.select("doc_id", "at", *[at(k).alias(f"l{k}") for k in range(LINES)])
    runs = []
    for size in range(LINES if long_words is None else 1, LINES + 1):
        used = [F.col(f"l{k}") for k in range(size)]
        words = sum((x["n"] for x in used[1:]), used[0]["n"])
        whole = used[-1]["h"].isNotNull()
        run = F.struct(F.lit(size).alias("size"), F.xxhash64(F.lit(size), *[x["h"] for x in used]).alias("w1"), F.xxhash64(F.lit(size), *[x["g"] for x in used]).alias("w2"))
        runs.append(F.when(whole if size == LINES else whole & (words > long_words), run))
    return flat.select("doc_id", "at", F.explode(F.array(*runs)).alias("run")).where("run IS NOT NULL").select("doc_id", "at", "run.size", "run.w1", "run.w2")


def removed_lines(docs: DataFrame, long_words: int | None = None) -> DataFrame:
    """(doc_id, covered): sorted positions of the lines to remove, for documents that have any."""
    windows = window_rows(docs, long_words)
    place = F.struct("doc_id", "at").alias("place")
    repeated = windows.select("w1", "w2", place).groupBy("w1", "w2").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    repeated = durable(repeated, "windows")
    later = windows.join(repeated, ["w1", "w2"]).where(F.struct("doc_id", "at") > F.col("first"))
    return later.groupBy("doc_id", "at").agg(F.max("size").alias("size")).groupBy("doc_id").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list(F.expr("sequence(at, at + size - 1)"))))).alias("covered"))


def dedup_lines(docs: DataFrame, long_words: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated lines removed from its text column; all rows and columns stay.

    Defined cases: null texts and rows with a null id stay as they are; a text all of whose lines go becomes
    empty; rows that repeat an id and text are one document (identical windows at identical places are the
    same occurrence, so none of them is removed); of rows that share an id with other texts, all lines covered
    in any of them are removed; an empty table gives no rows. Columns may have any names.
    """
    inner = docs.select(F.col(id_col).cast(T.LongType()).alias("doc_id"), F.col(text_col).cast(T.StringType()).alias("text"))
    of, covered, held = (unused(docs, name) for name in ("of_doc", "covered", "lines"))
    removed = removed_lines(inner, long_words).select(F.col("doc_id").alias(of), F.col("covered").alias(covered))
    joined = docs.join(removed, F.col(id_col).cast(T.LongType()) == F.col(of), "left")
    with_lines = joined.withColumn(held, F.when(F.col(covered).isNotNull(), F.split(F.col(text_col), "\n")))
    left = F.array_except(F.sequence(F.lit(0), F.size(held) - 1), F.col(covered))
    text = F.when(F.col(covered).isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(left, lambda i: F.get(F.col(held), i)), "\n"))
    return with_lines.withColumn(text_col, text).select(*docs.columns)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines (before), n_chars, n_chars_removed and text of every document after line dedup."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = dedup_lines(docs.withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long")).withColumn("n_before", F.coalesce(F.char_length("text"), F.lit(0)).cast("long")), PASSAGE_WORDS)
    return done.select("doc_id", "n_lines", F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("n_chars"), (F.col("n_before") - F.coalesce(F.char_length("text"), F.lit(0))).alias("n_chars_removed"), "text")


ORACLE = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos
  FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
n AS (SELECT doc_id, pos, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w FROM l),
r AS (
  SELECT doc_id, pos, line AS a, w AS wa,
    lead(line) OVER o AS b, lead(w) OVER o AS wb, lead(line, 2) OVER o AS c
  FROM n WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
w AS (
  SELECT doc_id, pos, 1 AS size, a AS run FROM r WHERE wa > 50
  UNION ALL SELECT doc_id, pos, 2, a || chr(10) || b FROM r WHERE b IS NOT NULL AND wa + wb > 50
  UNION ALL SELECT doc_id, pos, 3, a || chr(10) || b || chr(10) || c FROM r WHERE c IS NOT NULL),
f AS (SELECT doc_id, pos, size, row_number() OVER (PARTITION BY size, run ORDER BY doc_id, pos) AS k FROM w),
gone AS (SELECT DISTINCT doc_id, pos + unnest(range(size)) AS pos FROM f WHERE k > 1),
kept AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text
  FROM (SELECT l.* FROM l ANTI JOIN gone USING (doc_id, pos)) GROUP BY doc_id)
SELECT d.doc_id,
  CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END::BIGINT AS n_lines,
  coalesce(length(kept.text), 0)::BIGINT AS n_chars,
  (coalesce(length(d.text), 0) - coalesce(length(kept.text), 0))::BIGINT AS n_chars_removed,
  CASE WHEN d.text IS NOT NULL THEN coalesce(kept.text, '') END AS text
FROM documents d LEFT JOIN kept USING (doc_id)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op10_line_dedup": op10_line_dedup}
ORACLE_SQL: dict[str, str] = {"op10_line_dedup": ORACLE}
