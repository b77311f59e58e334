"""What queries and relations owe to large tables: even tasks, one reading of their documents, bounded memory."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tagweave.functions import codecs, positions
from tagweave.operators import css, relations
from tagweave.plans import catalogue, generated

SMALL = "/root/testdata/sf0.001"


def test_parts_are_dealt_evenly(spark):
    """The scan of the parts is one row group, that is one task."""
    rows = generated.documents(spark, SMALL, "{k}").groupBy(F.spark_partition_id()).count().collect()
    assert len(rows) >= spark.sparkContext.defaultParallelism and max(r["count"] for r in rows) <= 2 * min(r["count"] for r in rows)
    assert sum(r["count"] for r in rows) == spark.read.parquet(f"{SMALL}/part.parquet").count()


def test_statements_are_read_by_many_tasks(spark):
    found = catalogue.QUERIES["js_statements_from_parts"](spark, SMALL)
    assert found.select(F.spark_partition_id().alias("p")).distinct().count() >= spark.sparkContext.defaultParallelism


def test_documents_that_come_again_are_read_once(spark):
    read = spark.sparkContext.accumulator(0)

    def kernel(data):
        read.add(1)
        return css.tokens(data)

    docs = spark.range(30_000).repartition(1).select("id", F.concat(F.lit("a:"), F.col("id") % 7, F.repeat(F.lit(" b"), 20)).alias("css"))
    found = relations.relation(docs, "css", ["id"], kernel, relations.CSS_TOKENS)
    assert found.groupBy("id").count().where("count = 43").count() == 30_000 and read.value == 7


@pytest.mark.parametrize("kind", ["string", "binary"])
def test_rows_of_documents_read_together_are_those_of_each(spark, kind):
    bodies = [b"a:b", None, b"", b"x" * 20_000 + b" y", b"a:b", b"\xff{", "é: 'ü'".encode(), b"/*" + b"z" * 2_000 + b"*/", b"a:b", b" " * 1_100, None] * 40 + [b"q" + b"%d" % i for i in range(3_000)] + [b"a:b"] * 40_000
    if kind == "string":
        bodies = [None if b is None else b.decode("utf-8", "replace") for b in bodies]
    docs = spark.createDataFrame([(i, str(i % 3), b) for i, b in enumerate(bodies)], f"id int, name string, css {kind}").repartition(2)
    found = relations.css_tokens(docs, "css", ["name", "id"], columns=["data", "seq", "end"])
    want = [(str(i % 3), i, seq, relations.text(row[1]), row[3]) for i, b in enumerate(bodies) if b is not None for seq, row in enumerate(css.tokens(b if isinstance(b, bytes) else b.encode()))]
    assert found.columns == ["name", "id", "seq", "data", "end"] and sorted(map(tuple, found.collect())) == sorted(want)


def test_what_a_task_keeps_is_bounded():
    kept, tokens = relations.Kept(), lambda body: iter([(body,)] * 3)
    for i in range(3 * relations.KEPT):
        assert kept.rows(b"%d" % i, tokens) == [(b"%d" % i,)] * 3
    assert kept.size == sum(1 + len(rows) for rows in kept.found.values()) <= relations.KEPT
    assert len(kept.rows(b"x" * (relations.KEPT_BYTES + 1), tokens)) == 3 and max(map(len, kept.found)) <= relations.KEPT_BYTES


def test_values_of_repeated_documents_keep_their_structs(spark):
    """Lists of structs, empty lists and errors of documents that are read together."""
    docs = spark.createDataFrame([(i, ["a{b:c d", "a{b", "}", "@x{y}"][i % 4]) for i in range(1_000)], "id int, css string").repartition(1)
    rows = relations.css_grammar(docs, "css", ["id"]).where("id >= 996").orderBy("id", "seq").collect()
    want = [(996 + i, seq, *r) for i, body in enumerate([b"a{b:c d", b"a{b", b"}", b"@x{y}"]) for seq, r in enumerate(css.grammar(body))]
    shown = lambda e: e and tuple(e)
    assert [(r.id, r.seq, r.grammar, [tuple(v) for v in r["values"]], r.end, shown(r.error)) for r in rows] == [(w[0], w[1], w[2], [(k, v.decode()) for k, v in w[5]], w[6], shown(w[7])) for w in want]


#: Queries over documents made from every part: one reading, by all cores.
READ_ONCE = ["js_statements_from_parts", "js_literals_inside_functions", "css_units_from_parts", "js_flags_from_parts", "js_vars_from_parts", "js_node_kinds_from_parts", "js_vars_ranked", "js_scope_rows", "css_inline_from_parts", "js_tokens_from_parts", "js_scope_texts_from_parts", "js_import_names", "js_json_from_parts", "css_tokens_from_parts"]


@pytest.mark.parametrize("name", READ_ONCE)
def test_parts_are_read_once_by_many_tasks(spark, name):
    plan = catalogue.QUERIES[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan[plan.index("MapInArrow") :].count("Repartition ") == 1


def test_nodes_inside_others(spark):
    """Against a comparison of all pairs; a function may be in functions, and next to some."""
    programs = ["1;function f(){2;(function(){3;(()=>4)();5})();function g(){}6}7", "8", "function a(){9}function b(){}10", "function a(){function b(){function c(){}}}"]
    nodes = relations.js_nodes(spark.createDataFrame(list(enumerate(programs)), "id int, js string"), "js", ["id"], columns=["node_id", "exit_id", "kind"])
    rows = nodes.collect()
    for outer in ("Function", "Block"):
        want = {(x.id, x.node_id): sum(y.id == x.id and y.kind == outer and y.node_id < x.node_id <= y.exit_id for y in rows) for x in rows if x.kind in ("Literal", "Function")}
        found = relations.js_inside(nodes, ["id"], F.col("kind") == outer, F.col("kind").isin("Literal", "Function"))
        assert {(r.id, r.node_id): r.n_around for r in found.collect()} == want and max(want.values()) > 1


@pytest.mark.parametrize("kind, values", [
    (pa.list_(pa.struct([("token_type", pa.string()), ("data", pa.string())])), [[("a", b"b"), ("c", None)], [], None, [None]]), (pa.list_(pa.string()), [["a"], None, [], ["b", "c"]]),
    (pa.struct([("message", pa.string()), ("line", pa.int32())]), [("a", 1), None, ("b", None)]), (pa.list_(pa.string()), [None, None]), (pa.struct([("x", pa.list_(pa.int32()))]), [([1, 2],), (None,), None, ([],)]),
])
def test_nested_columns_are_those_of_single_values(monkeypatch, kind, values):
    """And none of their values becomes a dictionary on the way, which took most of the time of css_grammar."""
    want = pa.array([relations.shaped(v, kind) for v in values], kind)
    monkeypatch.setattr(relations, "shaped", None)
    assert relations.column(values, kind).equals(want) and relations.column(values, kind).type == kind


def test_imports_and_exports_from_one_reading(spark):
    programs = ["import {a as b, c} from 'm';import * as d from 'n';export {x as y}", "export {b};export {c as d} from 'o'", "import 'p'", "a"]
    nodes = relations.js_nodes(spark.createDataFrame(list(enumerate(programs)), "id int, js string"), "js", ["id"])
    of = lambda kind: list(map(tuple, relations.js_imports(nodes, ["id"], kind).select("id", "module", "ordinal", "name", "bound").collect()))
    heads = {(r.id, r.node_id): r for r in nodes.collect()}
    want = lambda kind: [(r.id, heads[r.id, r.parent_id].data, r.ordinal, r.op, r.data) for r in heads.values() if r.kind == "Alias" and heads[r.id, r.parent_id].kind == kind]
    by_text = lambda rows: sorted(rows, key=str)
    assert by_text(of("Import")) == by_text(want("Import")) and len(want("Import")) == 3
    assert by_text(of("Export")) == by_text(want("Export")) and len(want("Export")) == 3
    assert relations.js_imports(nodes, ["id"])._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def resident(pages="/proc/self/statm"):
    """Bytes of memory that this process holds now."""
    with open(pages) as f:
        return int(f.read().split()[1]) * 4096


def held(calls):
    """Megabytes that this process holds, from the 500th call on, when all that a worker needs is loaded."""
    calls.append(None)
    return resident() // 1_000_000 if len(calls) > 500 else None


def wide_texts(spark):
    """60 MB of texts in one batch."""
    return spark.range(10_000).repartition(1).select("id", F.repeat(F.lit("x"), 6_000).alias("text"))


def test_texts_of_a_batch_are_not_held_twice_over(spark):
    """A worker's memory doesn't grow by the results of a batch while it works on it."""
    calls = []
    found = wide_texts(spark).select(codecs.text_column(lambda x: b"%d %s" % (held(calls) or 0, x), "text").alias("out"))
    mb = F.substring_index("out", " ", 1).cast("int")
    row = found.agg(F.count("*").alias("n"), F.sum(F.length(F.substring_index("out", " ", -1))).alias("length"), F.min(F.when(mb > 0, mb)).alias("least"), F.max(mb).alias("most")).first()
    assert row.n == 10_000 and row.length == 60_000_000 and row.most - row.least < 20, row


def test_vectorised_functions_keep_rows_apart(spark):
    bodies = ["&quot;a&copy;", None, "", "x" * 300_000 + "&quot;", "é&amp;"] * 30
    rows = spark.createDataFrame(list(enumerate(bodies)), "id int, body string").repartition(2).select("id", codecs.replace_entities_column("body", {"quot": b'"', "copy": "©".encode()}).alias("out")).collect()
    assert [r.out for r in sorted(rows)] == [b and b.replace("&quot;", '"').replace("&copy;", "©") for b in bodies]


def test_results_of_two_columns_are_not_held_either(spark):
    calls = []
    function = lambda x, k: (held(calls), k, x.decode())
    found = wide_texts(spark).select(codecs.vectorised(function, "struct<line: int, col: int, context: string>", "text", F.col("id").cast("int")).alias("out"))
    row = found.agg(F.count_distinct("out.col").alias("n"), F.sum(F.length("out.context")).alias("length"), F.min("out.line").alias("least"), F.max("out.line").alias("most")).first()
    assert row.n == 10_000 and row.length == 60_000_000 and row.most - row.least < 20, row


def test_positions_of_texts(spark):
    """By rows, with nulls; a position is null where the text or the offset is."""
    cases = [("a\nbé", 4), (None, 1), ("x", None), ("", 0), ("y" * 300_000 + "\n", 300_001)] * 20
    rows = spark.createDataFrame([(i, t, o) for i, (t, o) in enumerate(cases)], "id int, t string, o int").repartition(2).select("id", codecs.position_column("t", "o").alias("p")).collect()
    assert [r.p and tuple(r.p) for r in sorted(rows, key=lambda r: r.id)] == [None if t is None or o is None else positions.position(t.encode(), o) for t, o in cases]
