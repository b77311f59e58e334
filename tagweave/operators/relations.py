"""Relations of tokens, events and grammar units over a DataFrame of documents.

A kernel turns one document into rows. It runs inside mapInArrow, which sends a batch of documents to Python and
takes flat Arrow columns back: one exchange each way, no nested arrays, no explode. Key columns are carried
along by repeating their values with an Arrow take, so they are never touched in Python. A short document that
occurs again is read once for each slice of a batch, and mostly once for each task; its rows are repeated by a take
as well.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..shipping import ship
from . import css, html, js, js_syntax, js_print, js_text, json, xml

ERROR = "STRUCT<message: STRING, line: INT, col: INT, context: STRING>"
VALUES = "ARRAY<STRUCT<token_type: STRING, data: STRING>>"
HTML = f"token_type STRING, data STRING, text STRING, attr_val STRING, has_template BOOLEAN, start INT, end INT, error {ERROR}, in_tag STRING"
XML = f"token_type STRING, data STRING, text STRING, attr_val STRING, start INT, end INT, error {ERROR}"
CSS_TOKENS = "token_type STRING, data STRING, start INT, end INT"
CSS_GRAMMAR = f"grammar STRING, token_type STRING, data STRING, values {VALUES}, end INT, error {ERROR}"
JSON = f"grammar STRING, state STRING, data STRING, depth INT, start INT, end INT, error {ERROR}, name STRING"

JS_TOKENS = f"token_type STRING, token_code INT, data STRING, start INT, end INT, error {ERROR}"
JS_NODES = "node_id INT, parent_id INT, field STRING, ordinal INT, kind STRING, op STRING, data STRING, flags ARRAY<STRING>, depth INT, exit_id INT, scope_id INT"
JS_SCOPES = "scope_id INT, parent_id INT, func_id INT, what STRING, has_with BOOLEAN, n_for_decls INT, n_func_args INT, n_arg_uses INT"
JS_VARS = "scope_id INT, ordinal INT, bound BOOLEAN, var_id INT, name STRING, decl STRING, uses INT, links INT"
JS_PROGRAMS = f"sexpr STRING, js STRING, json STRING, json_error STRING, n_nodes INT, n_scopes INT, error {ERROR}"

FLUSH = 50_000  # rows of a batch sent back; bounds memory for long documents
SLICE = 256 * 1024  # bytes of short documents read at once; their rows are sent back together
SHORT = 16 * 1024  # bytes of a document that is read together with others; longer ones are flushed as they are read
KEPT = 20_000  # documents and rows that a task keeps for documents that come again, and bytes of such a document
KEPT_BYTES = 1024


def text(b: bytes | None) -> str | None:
    return None if b is None else b.decode("utf-8", "replace")


def shaped(value, kind: pa.DataType):
    """Bytes as text, and tuples as the structs of an Arrow type."""
    if value is None:
        return None
    if pa.types.is_string(kind) or pa.types.is_large_string(kind):
        return text(value) if isinstance(value, bytes) else value
    if pa.types.is_struct(kind):
        return {f.name: shaped(v, f.type) for f, v in zip(kind, value)}
    if pa.types.is_list(kind):
        return [shaped(v, kind.value_type) for v in value]
    if pa.types.is_map(kind):
        return list(value.items())
    return value


def missing(values: list) -> pa.Array | None:
    """Which values are null; None if none is."""
    return pa.array([v is None for v in values]) if None in values else None


def column(values: list, kind: pa.DataType) -> pa.Array:
    """An Arrow column of a kernel's values. Bytes become text in one validated cast; only where some aren't UTF-8
    are they decoded one by one."""
    if pa.types.is_string(kind):
        if not isinstance(next((v for v in values if v is not None), ""), bytes):
            return pa.array(values, kind)
        try:
            return pa.array(values, pa.binary()).cast(kind)
        except pa.ArrowInvalid:
            return pa.array([text(v) for v in values], kind)
    if pa.types.is_nested(kind):
        if all(v is None for v in values):
            return pa.nulls(len(values), kind)
        if pa.types.is_list(kind):
            ends, flat = [0], []
            for v in values:
                flat += v or ()
                ends.append(len(flat))
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), column(flat, kind.value_type), kind, mask=missing(values))
        if pa.types.is_struct(kind):
            parts = [column([None if v is None else v[k] for v in values], f.type) for k, f in enumerate(kind)]
            return pa.StructArray.from_arrays(parts, fields=list(kind), mask=missing(values))
        return pa.array([shaped(v, kind) for v in values], kind)
    return pa.array(values, kind)


class Kept:
    """Rows of short documents that a task has read, for those that come again; when it is full, it begins anew."""

    def __init__(self):
        self.found: dict[str | bytes, list[tuple]] = {}
        self.size = 0

    def rows(self, body: str | bytes, read: Callable) -> list[tuple]:
        rows = self.found.get(body)
        if rows is None:
            rows = list(read(body))
            if len(body) <= KEPT_BYTES:
                self.size += 1 + len(rows)
                if self.size > KEPT:
                    self.found, self.size = {}, 1 + len(rows)
                self.found[body] = rows
        return rows


def slices(batch: pa.RecordBatch | pa.Array, n_bytes: int) -> Iterator[pa.RecordBatch | pa.Array]:
    """Parts of a batch with about SLICE of its ``n_bytes`` each."""
    step = max(1, SLICE * len(batch) // max(1, n_bytes))
    for at in range(0, len(batch), step):
        yield batch.slice(at, step)


def relation(docs: DataFrame, content: str, keys: list[str], kernel: Callable[[bytes], Iterator[tuple]], schema: str, numbered: bool = True, columns: list[str] | None = None) -> DataFrame:
    """Rows of every document: the key columns, seq (from 0) and the kernel's columns, or those named by ``columns``;
    what isn't named never leaves Python, where Spark's column pruning can't reach.

    ``content`` is a STRING or BINARY column; null documents have no rows. Keys that clash with a column of the
    relation are an error of the caller and are reported before any work.
    """
    ship(docs.sparkSession)
    full = T.StructType.fromDDL(("seq INT, " if numbered else "") + schema)
    if unknown := set(columns or ()) - set(full.names):
        raise ValueError(f"no columns of the relation: {sorted(unknown)}")
    own = T.StructType([f for f in full if columns is None or f.name in columns])
    places = [full.names.index(f.name) - numbered for f in own]  # in a kernel's row; -1 is seq
    if clash := set(keys) & {f.name for f in own}:
        raise ValueError(f"key columns clash with columns of the relation: {sorted(clash)}")
    inner = docs.select(*keys, content)
    result = T.StructType([inner.schema[k] for k in keys] + list(own.fields))
    arrow = to_arrow_schema(own)
    n_keys = len(keys)

    def read(body: str | bytes) -> Iterator[tuple]:
        return iter(kernel(body if isinstance(body, bytes) else body.encode("utf-8", "surrogatepass")))

    def batch_of(batch: pa.RecordBatch, source: pa.Array, own_columns: list[pa.Array]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(k).take(source) for k in range(n_keys)] + own_columns, names=[f.name for f in result])

    def one_by_one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        source, seqs, rows = [], [], []
        bodies = batch.column(n_keys)

        def flush() -> pa.RecordBatch:
            own_columns = [column(seqs if at < 0 else [r[at] for r in rows], f.type) for at, f in zip(places, arrow)]
            out = batch_of(batch, pa.array(source, pa.int32()), own_columns)
            for held in (source, seqs, rows):
                held.clear()
            return out

        for i in range(batch.num_rows):
            body = bodies[i].as_py()
            if body is None:
                continue
            found = read(body)
            at = 0
            while part := list(islice(found, FLUSH)):
                rows += part
                source += [i] * len(part)
                seqs += range(at, at + len(part))
                at += len(part)
                if len(rows) >= FLUSH:
                    yield flush()
        if rows:
            yield flush()

    def together(batch: pa.RecordBatch, kept: Kept) -> Iterator[pa.RecordBatch]:
        """Each different document is read once, and its rows are taken for all documents that are like it."""
        bodies = batch.column(n_keys).dictionary_encode()
        counts, rows = [], []
        for body in bodies.dictionary.to_pylist():
            found = kept.rows(body, read)
            counts.append(len(found))
            rows += found
        counts = np.array(counts, np.int64)
        docs = np.flatnonzero(bodies.indices.is_valid().to_numpy(zero_copy_only=False))
        which = bodies.indices.drop_null().to_numpy()
        n = counts[which]
        ends = np.cumsum(n)
        if not len(ends) or not ends[-1]:
            return
        seqs = np.arange(ends[-1]) - np.repeat(ends - n, n)
        at_rows = seqs + np.repeat((np.cumsum(counts) - counts)[which], n)
        again = pa.array(at_rows) if len(which) > len(counts) else None
        own_columns = []
        for at, f in zip(places, arrow):
            if at < 0:
                own_columns.append(pa.array(seqs.astype(np.int32)))
            else:
                made = column([r[at] for r in rows], f.type)
                own_columns.append(made if again is None else made.take(again))
        yield batch_of(batch, pa.array(np.repeat(docs, n)), own_columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = Kept()
        for batch in batches:
            for part in slices(batch, batch.column(n_keys).nbytes):
                longest = pc.max(pc.binary_length(part.column(n_keys))).as_py() or 0
                yield from together(part, kept) if longest <= SHORT else one_by_one(part)

    return inner.mapInArrow(run, result)


def html_tokens(docs: DataFrame, content: str = "html", keys: list[str] | None = None, template: tuple[str, str] = ("", ""), columns: list[str] | None = None) -> DataFrame:
    begin, end = template
    return relation(docs, content, keys or [c for c in docs.columns if c != content], lambda b: html.tokens(b, begin, end), HTML, columns=columns)


def xml_tokens(docs: DataFrame, content: str = "xml", keys: list[str] | None = None, columns: list[str] | None = None) -> DataFrame:
    return relation(docs, content, keys or [c for c in docs.columns if c != content], xml.tokens, XML, columns=columns)


def css_tokens(docs: DataFrame, content: str = "css", keys: list[str] | None = None, columns: list[str] | None = None) -> DataFrame:
    return relation(docs, content, keys or [c for c in docs.columns if c != content], css.tokens, CSS_TOKENS, columns=columns)


def css_grammar(docs: DataFrame, content: str = "css", keys: list[str] | None = None, inline: bool = False, columns: list[str] | None = None) -> DataFrame:
    return relation(docs, content, keys or [c for c in docs.columns if c != content], lambda b: css.grammar(b, inline), CSS_GRAMMAR, columns=columns)


def json_events(docs: DataFrame, content: str = "json", keys: list[str] | None = None, columns: list[str] | None = None) -> DataFrame:
    return relation(docs, content, keys or [c for c in docs.columns if c != content], json.events, JSON, columns=columns)


def js_tokens(docs: DataFrame, content: str = "js", keys: list[str] | None = None, regexp: bool = False, columns: list[str] | None = None) -> DataFrame:
    """``regexp``: every / begins a regular expression (else none does; which one is right takes a reader)."""
    return relation(docs, content, keys or [c for c in docs.columns if c != content], lambda b: js.tokens(b, regexp), JS_TOKENS, columns=columns)


def of_programs(rows: Callable, inline: bool, while_to_for: bool = False) -> Callable[[bytes], Iterator[tuple]]:
    def kernel(data: bytes) -> Iterator[tuple]:
        reader, tree, wrong = js_syntax.read(data, inline, while_to_for)
        yield from rows(reader, tree, wrong)

    return kernel


def js_relation(docs: DataFrame, content: str, keys: list[str] | None, kernel: Callable, schema: str, columns: list[str] | None = None) -> DataFrame:
    return relation(docs, content, keys or [c for c in docs.columns if c != content], kernel, schema, numbered=False, columns=columns)


def node_rows(reader, tree, wrong) -> Iterator[tuple]:
    return js_text.nodes(tree, reader) if tree else iter(())


def scope_rows(reader, tree, wrong) -> list[tuple]:
    return js_text.scopes(reader)[0] if tree else []


def var_rows(reader, tree, wrong) -> list[tuple]:
    return js_text.scopes(reader)[1] if tree else []


def program_rows(reader, tree, wrong, wanted: list[str] | None = None) -> Iterator[tuple]:
    """The one row of a program; forms that aren't ``wanted`` stay null and cost nothing."""
    if tree is None:
        yield None, None, None, None, None, None, wrong
        return
    is_wanted = lambda *names: wanted is None or not set(names).isdisjoint(wanted)
    made = reason = None
    if is_wanted("json", "json_error"):
        try:
            made = js_print.json(tree)
        except js_print.NotJson as e:
            reason = str(e)
    yield js_text.program(tree) if is_wanted("sexpr") else None, js_print.program(tree) if is_wanted("js") else None, made, reason, sum(1 for _ in js_text.nodes(tree)) if is_wanted("n_nodes") else None, len(reader.scopes), None


def js_nodes(docs: DataFrame, content: str = "js", keys: list[str] | None = None, inline: bool = False, while_to_for: bool = False, columns: list[str] | None = None) -> DataFrame:
    """Syntax trees as adjacency rows; programs with an error have none. Descendants of a node are the ids after
    it up to its exit_id; flags names what holds of it (async, generator, static, get, set, computed, optional,
    postfix, spread, await, default), scope_id is the scope it stands in. ``inline``: the code of an attribute, where
    ``return`` is good; ``while_to_for``: while statements come as for statements."""
    return js_relation(docs, content, keys, of_programs(node_rows, inline, while_to_for), JS_NODES, columns)


def js_scopes(docs: DataFrame, content: str = "js", keys: list[str] | None = None, inline: bool = False) -> DataFrame:
    return js_relation(docs, content, keys, of_programs(scope_rows, inline), JS_SCOPES)


def js_vars(docs: DataFrame, content: str = "js", keys: list[str] | None = None, inline: bool = False, columns: list[str] | None = None) -> DataFrame:
    """Variables of every scope: declared there (bound) or only used there. Rows of one program with the same var_id
    are the same variable."""
    return js_relation(docs, content, keys, of_programs(var_rows, inline), JS_VARS, columns)


def js_programs(docs: DataFrame, content: str = "js", keys: list[str] | None = None, inline: bool = False, while_to_for: bool = False, columns: list[str] | None = None) -> DataFrame:
    """One row for each program: symbolic expression, printed text, JSON (or why it is none), or its error."""
    rows = lambda reader, tree, wrong: program_rows(reader, tree, wrong, columns)
    return js_relation(docs, content, keys, of_programs(rows, inline, while_to_for), JS_PROGRAMS, columns)


def js_var_texts(names: DataFrame, keys: list[str]) -> DataFrame:
    """A line of text for each scope of js_vars: its declared and its only used variables, each with its kind of
    declaration, name, links and uses."""
    one = F.format_string("Var{%s %s %d %d}", "decl", "name", "links", "uses")
    held = names.groupBy(*keys, "scope_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "bound", one.alias("v")))).alias("held"))
    listed = lambda which: F.array_join(F.transform(F.filter("held", lambda x: x["bound"] == F.lit(which)), lambda x: x["v"]), ", ")
    return held.select(*keys, "scope_id", F.concat(F.lit("Scope{Declared: ["), listed(True), F.lit("], Undeclared: ["), listed(False), F.lit("]}")).alias("text"))


def js_inside(nodes: DataFrame, keys: list[str], outer: Column, inner: Column) -> DataFrame:
    """The nodes of programs for which ``inner`` holds: the keys, node_id and n_around, the number of nodes around it for
    which ``outer`` holds. A running sum over where those begin and end, not a join: the nodes are read once, and a
    program costs a sort of its own nodes, however many lie in how many."""
    step = lambda at, by: F.struct(at.cast("bigint").alias("at"), F.lit(by).alias("by"))
    node, leave = F.col("node_id"), F.col("exit_id")
    steps = F.array(F.when(inner, step(node * 2, 0)), F.when(outer, step(node * 2 + 1, 1)), F.when(outer, step(leave * 2 + 1, -1)))
    placed = nodes.where(inner | outer).select(*keys, "node_id", F.explode(steps).alias("s")).where("s IS NOT NULL").select(*keys, "node_id", "s.*")
    around = F.sum("by").over(Window.partitionBy(*keys).orderBy("at"))
    return placed.withColumn("n_around", around).where("by = 0").select(*keys, "node_id", "n_around")


def js_imports(nodes: DataFrame, keys: list[str], kind: str = "Import") -> DataFrame:
    """The imports (or with kind Export the exports) of programs, from their nodes: a row for each name, with the
    name it has in the module. The nodes are read once."""
    is_head = F.col("kind") == kind
    head = F.when(is_head, F.col("node_id")).otherwise(F.col("parent_id")).alias("head")
    of = nodes.where(is_head | (F.col("kind") == "Alias")).select(*keys, head, is_head.alias("is_head"), "ordinal", "op", "data")
    together = Window.partitionBy(*keys, "head")
    known = of.withColumn("module", F.max(F.when(F.col("is_head"), F.col("data"))).over(together)).withColumn("has_head", F.bool_or("is_head").over(together))
    return known.where("has_head AND NOT is_head").select(*keys, "module", "ordinal", F.col("op").alias("name"), F.col("data").alias("bound"))


def js_vars_by_uses(names: DataFrame, keys: list[str]) -> DataFrame:
    """Declared variables with their rank by uses in their scope."""
    order = Window.partitionBy(*keys, "scope_id").orderBy(F.desc("uses"), "ordinal")
    return names.where("bound").withColumn("rank", F.row_number().over(order))


#: Names of the precedence levels, lowest first.
PRECEDENCES = ("Expr", "Assign", "Coalesce", "Or", "And", "BitOr", "BitXor", "BitAnd", "Equals", "Compare", "Shift", "Add", "Mul", "Exp", "Unary", "Update", "LHS", "Opt", "Call", "New", "Member", "Primary")


def js_token_types(spark: SparkSession) -> DataFrame:
    """Dimension of token types: code, name and class bits."""
    rows = [(code, name, bool(code & 0x100), bool(code & 0x200), bool(code & 0x400), bool(code & 0x800), bool(code & 0x1000)) for name, code in js.CODES.items()]
    return spark.createDataFrame(rows, "code INT, name STRING, numeric BOOLEAN, punctuator BOOLEAN, operator BOOLEAN, reserved BOOLEAN, identifier BOOLEAN")


#: Names with a meaning of their own in pages and sheets; fixed values.
HTML_NAMES = {
    "raw text": "iframe math plaintext script style svg textarea title xml xmp",
    "void": "area base br col embed hr img input link meta source track wbr",
    "url": "action cite data formaction href manifest poster src",
}
CSS_NAMES = {"rules": "document keyframes layer media supports", "declarations": "font-face page"}


def names_dimension(spark: SparkSession, names: dict[str, str] = HTML_NAMES) -> DataFrame:
    """Dimension (name, kind, code) of known names, to join tokens with; codes are positions in the order of names."""
    rows = sorted((name, kind) for kind, held in names.items() for name in held.split())
    return spark.createDataFrame([(name, kind, code) for code, (name, kind) in enumerate(rows, 1)], "name STRING, kind STRING, code INT")


def js_operators(spark: SparkSession) -> DataFrame:
    """Dimension of binary operators with their precedence."""
    rows = [(op, level, PRECEDENCES[level]) for op, (level, _, _) in js_syntax.BINARY.items()]
    return spark.createDataFrame(rows, "op STRING, level INT, precedence STRING")
