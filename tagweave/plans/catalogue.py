"""Registered queries over the given tables, each with its DuckDB counterpart; those of ``generated`` are added at the end."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import binary, codecs, numbers, text
from ..operators import relations

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def spread(scan: DataFrame) -> DataFrame:
    """A table scan dealt to all cores if it has fewer partitions, as a small file of one row group has. A large
    input always has more, and then nothing is shuffled."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def dealt_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts, dealt out evenly: a row of a few bytes becomes a document that takes a kernel longer than any shuffle,
    and the scan of so small a table has the rows of a row group in one task."""
    scan = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    return scan.repartition(2 * max(spark.sparkContext.defaultParallelism, 4))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "pages"))


def page_tokens(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return relations.html_tokens(pages(spark, sf_dir), "html", ["page_id"], columns=list(columns) or None)


def of_type(tokens: DataFrame, *kinds: str) -> DataFrame:
    return tokens.where(F.col("token_type").isin(*kinds))


def raw_text(spark: SparkSession, sf_dir: str, tag: str) -> DataFrame:
    """Bodies of style or script elements, with the page and the token they come from."""
    bodies = of_type(page_tokens(spark, sf_dir, "seq", "token_type", "data", "in_tag"), "Text").where(F.col("in_tag") == tag)
    return bodies.select("page_id", F.col("seq").alias("of_seq"), F.col("data").alias("body"))


#: Pages with the bodies of their scripts emptied, so that patterns see no markup inside them.
BLANKED = r"SELECT page_id, regexp_replace(html, '(<script[^>]*>).*?(</script)', '\1\2', 'gs') AS h FROM pages"


@query(f"SELECT page_id, len(regexp_extract_all(h, '</[a-zA-Z]'))::BIGINT AS n_end_tags FROM ({BLANKED}) WHERE len(regexp_extract_all(h, '</[a-zA-Z]')) > 0")
def html_end_tags(spark, sf_dir):
    return of_type(page_tokens(spark, sf_dir, "token_type"), "EndTag").groupBy("page_id").agg(F.count("*").alias("n_end_tags"))


@query(f"""SELECT lower(t) AS tag, count(*)::BIGINT AS n FROM (SELECT unnest(regexp_extract_all(h, '<([a-zA-Z][a-zA-Z0-9]*)', 1)) AS t FROM ({BLANKED})) GROUP BY 1""")
def html_start_tags_by_name(spark, sf_dir):
    return of_type(page_tokens(spark, sf_dir, "token_type", "text"), "StartTag").groupBy(F.col("text").alias("tag")).agg(F.count("*").alias("n"))


@query(f"""SELECT 'EndTag' AS token_type, sum(len(regexp_extract_all(h, '</[a-zA-Z]')))::BIGINT AS n FROM ({BLANKED})
UNION ALL SELECT 'StartTag', sum(len(regexp_extract_all(h, '<[a-zA-Z]')))::BIGINT FROM ({BLANKED})
UNION ALL SELECT 'Comment', sum(len(regexp_extract_all(h, '<!--')))::BIGINT FROM ({BLANKED})
UNION ALL SELECT 'Doctype', sum(len(regexp_extract_all(h, '<!DOCTYPE')))::BIGINT FROM ({BLANKED})""")
def html_token_counts(spark, sf_dir):
    return of_type(page_tokens(spark, sf_dir, "token_type"), "EndTag", "StartTag", "Comment", "Doctype").groupBy("token_type").agg(F.count("*").alias("n"))


@query(f"""SELECT page_id, trim(unnest(regexp_extract_all(h, 'href="([^"]*)"', 1))) AS href FROM ({BLANKED})""")
def html_links(spark, sf_dir):
    links = of_type(page_tokens(spark, sf_dir, "token_type", "text", "attr_val"), "Attribute").where(F.col("text") == "href")
    return links.select("page_id", F.trim(F.regexp_replace("attr_val", "^[\"']|[\"']$", "")).alias("href"))


@query(f"""SELECT k AS attribute, count(*)::BIGINT AS n, count(DISTINCT v)::BIGINT AS n_values FROM (
  SELECT unnest(regexp_extract_all(h, ' ([a-z]+)="[^"<>]*"', 1)) AS k, unnest(regexp_extract_all(h, ' [a-z]+="([^"<>]*)"', 1)) AS v FROM ({BLANKED})) GROUP BY 1""")
def html_attr_values(spark, sf_dir):
    attributes = of_type(page_tokens(spark, sf_dir, "token_type", "text", "attr_val"), "Attribute").where(F.col("attr_val").isNotNull())
    return attributes.groupBy(F.col("text").alias("attribute")).agg(F.count("*").alias("n"), F.countDistinct("attr_val").alias("n_values"))


@query(r"SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1, 's') AS title FROM pages")
def html_titles(spark, sf_dir):
    return raw_text(spark, sf_dir, "title").select("page_id", F.col("body").alias("title"))


@query(f"""SELECT page_id, unnest(regexp_extract_all(h, '<!--(.*?)-->', 1)) AS comment FROM ({BLANKED})""")
def html_comments(spark, sf_dir):
    return of_type(page_tokens(spark, sf_dir, "token_type", "text"), "Comment").select("page_id", F.col("text").alias("comment"))


@query(f"""WITH t AS (SELECT page_id, unnest(regexp_extract_all(h, '<(/?[a-z][a-z0-9]*)', 1)) AS tag FROM ({BLANKED}))
SELECT page_id, ltrim(tag, '/') AS tag, sum(CASE WHEN tag LIKE '/%' THEN -1 ELSE 1 END)::BIGINT AS n_unclosed FROM t
WHERE ltrim(tag, '/') NOT IN ('br', 'img', 'meta', 'hr', 'input', 'link') GROUP BY 1, 2 HAVING sum(CASE WHEN tag LIKE '/%' THEN -1 ELSE 1 END) <> 0""")
def html_unclosed_tags(spark, sf_dir):
    tags = of_type(page_tokens(spark, sf_dir, "seq", "token_type", "text"), "StartTag", "EndTag").where(~F.col("text").isin("br", "img", "meta", "hr", "input", "link"))
    net = F.sum(F.when(F.col("token_type") == "StartTag", 1).otherwise(-1))
    return tags.groupBy("page_id", F.col("text").alias("tag")).agg(net.alias("n_unclosed")).where("n_unclosed <> 0")


@query(f"""WITH t AS (SELECT page_id, unnest(x) AS tag, unnest(range(len(x))) AS i FROM (SELECT page_id, regexp_extract_all(h, '<(/?[a-z][a-z0-9]*)', 1) AS x FROM ({BLANKED})))
SELECT page_id, max(d)::BIGINT AS depth FROM (SELECT page_id, sum(CASE WHEN tag LIKE '/%' THEN -1 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY i) AS d
  FROM t WHERE ltrim(tag, '/') NOT IN ('br', 'img', 'meta', 'hr', 'input', 'link')) GROUP BY 1""")
def html_tag_depth(spark, sf_dir):
    """The deepest nesting of every page: a running sum over its tags, void elements left out."""
    by_page = Window.partitionBy("page_id").orderBy("seq")
    step = F.when(F.col("token_type") == "StartTag", 1).otherwise(-1)
    tags = of_type(page_tokens(spark, sf_dir, "seq", "token_type", "text"), "StartTag", "EndTag").where(~F.col("text").isin("br", "img", "meta", "hr", "input", "link"))
    return tags.withColumn("depth", F.sum(step).over(by_page)).groupBy("page_id").agg(F.max("depth").alias("depth"))


@query(f"SELECT page_id, sum(length(x))::BIGINT AS n_text FROM (SELECT page_id, unnest(string_split_regex(regexp_replace(h, '<(style|title)>.*?</(style|title)>', '', 'gs'), '<[^>]*(>|$)')) AS x FROM ({BLANKED})) GROUP BY 1")
def html_text_len(spark, sf_dir):
    inside = of_type(page_tokens(spark, sf_dir, "token_type", "text", "in_tag"), "Text").where("in_tag IS NULL")
    per_page = inside.groupBy("page_id").agg(F.sum(F.char_length("text")).alias("n"))
    return pages(spark, sf_dir).select("page_id").join(per_page, "page_id", "left").select("page_id", F.coalesce("n", F.lit(0)).alias("n_text"))


@query("SELECT page_id, strlen(html)::BIGINT AS n_bytes, 0::BIGINT AS n_overlaps, strlen(html)::BIGINT AS last FROM pages")
def html_bytes_covered(spark, sf_dir):
    """The tokens of a page cover its bytes once, up to its end: the lengths of all tokens with the gaps of white space
    before ends of tags, tokens that begin before the end of the one before them, and the end of the last."""
    before = F.lag("end", 1, 0).over(Window.partitionBy("page_id").orderBy("seq"))
    tokens = page_tokens(spark, sf_dir, "seq", "token_type", "start", "end").select("page_id", "token_type", "start", "end", before.alias("before"))
    gap = F.when(F.col("token_type").isin("StartTagClose", "StartTagVoid", "Attribute"), F.col("start") - F.col("before")).otherwise(0)
    return tokens.groupBy("page_id").agg(F.sum(F.col("end") - F.col("start") + gap).alias("n_bytes"), F.count_if(F.col("start") < F.col("before")).alias("n_overlaps"), F.max("end").cast("bigint").alias("last"))


@query("SELECT page_id, 'margin' AS property, '0' AS value FROM pages")
def css_declarations_from_pages(spark, sf_dir):
    grammar = relations.css_grammar(raw_text(spark, sf_dir, "style"), "body", ["page_id"])
    value = F.array_join(F.transform("values", lambda v: v["data"]), "")
    return grammar.where("grammar = 'Declaration'").select("page_id", F.col("data").alias("property"), value.alias("value"))


@query("SELECT unnest(['BeginRuleset', 'Declaration', 'EndRuleset']) AS grammar, count(*)::BIGINT AS n FROM pages GROUP BY 1")
def css_grammar_counts(spark, sf_dir):
    return relations.css_grammar(raw_text(spark, sf_dir, "style"), "body", ["page_id"], columns=["grammar"]).groupBy("grammar").agg(F.count("*").alias("n"))


@query("""SELECT t AS token_type, count(*)::BIGINT AS n FROM (SELECT unnest(['Ident', 'LeftBrace', 'Ident', 'Colon', 'Number', 'RightBrace']) AS t FROM pages) GROUP BY 1""")
def css_token_counts(spark, sf_dir):
    return relations.css_tokens(raw_text(spark, sf_dir, "style"), "body", ["page_id"], columns=["token_type"]).groupBy("token_type").agg(F.count("*").alias("n"))


#: Scripts of the pages as SQL sees them.
SCRIPTS = r"SELECT page_id, regexp_extract(html, '<script>(.*?)</script>', 1, 's') AS body FROM pages"


@query(f"SELECT page_id, regexp_extract(body, 'track\\(([0-9]+)\\)', 1) AS argument FROM ({SCRIPTS})".replace("\\\\", "\\"))
def js_calls_from_pages(spark, sf_dir):
    """Arguments of calls of track: call nodes brought together with their callee and argument nodes, each program read
    once."""
    nodes = relations.js_nodes(raw_text(spark, sf_dir, "script"), "body", ["page_id"])
    at = F.explode(F.array(F.col("node_id"), F.col("parent_id"))).alias("call")
    of = nodes.where("kind = 'CallExpr' OR field IN ('x', 'args')").select("page_id", "node_id", "field", "kind", "data", at)
    own = F.col("call") == F.col("node_id")
    calls = of.groupBy("page_id", "call").agg(
        F.bool_or(own & (F.col("kind") == "CallExpr")).alias("is_call"), F.max(F.when(~own & (F.col("field") == "x"), F.col("data"))).alias("callee"),
        F.array_sort(F.collect_list(F.when(~own & (F.col("field") == "args"), F.struct("node_id", "data")))).alias("arguments"),
    )
    return calls.where("is_call AND callee = 'track'").select("page_id", F.explode("arguments.data").alias("argument"))


@query("SELECT scope_id, name, bound, count(*)::BIGINT AS n FROM (SELECT 0 AS scope_id, unnest(['t', 'track']) AS name, unnest([true, false]) AS bound FROM pages) GROUP BY ALL")
def js_scope_uses_from_pages(spark, sf_dir):
    found = relations.js_vars(raw_text(spark, sf_dir, "script"), "body", ["page_id"])
    return found.groupBy("scope_id", "name", "bound").agg(F.count("*").alias("n"))


@query("""SELECT t AS token_type, count(*)::BIGINT AS n FROM (SELECT unnest(['var', 'Whitespace', 'Identifier', '=', 'String', ';', 'Identifier', '(', 'Integer', ')', ';']) AS t FROM pages) GROUP BY 1""")
def js_token_counts(spark, sf_dir):
    return relations.js_tokens(raw_text(spark, sf_dir, "script"), "body", ["page_id"], columns=["token_type"]).groupBy("token_type").agg(F.count("*").alias("n"))


@query(f"SELECT page_id, 'Decl(var Binding(t = \"</p>\")) Stmt(track(' || regexp_extract(body, '([0-9]+)\\)', 1) || '))' AS sexpr FROM ({SCRIPTS})".replace("\\\\", "\\"))
def js_sexpr_from_pages(spark, sf_dir):
    return relations.js_programs(raw_text(spark, sf_dir, "script"), "body", ["page_id"], columns=["sexpr"]).select("page_id", "sexpr")


@query("SELECT page_id, regexp_replace(regexp_extract(html, '<script>(.*?)</script>', 1, 's'), '=', ' = ').replace(';track', ';' || chr(10) || 'track') AS js FROM pages")
def js_print_from_pages(spark, sf_dir):
    return relations.js_programs(raw_text(spark, sf_dir, "script"), "body", ["page_id"], columns=["js"]).select("page_id", "js")


@query("""SELECT p_partkey, '{"name": "' || p_name || '", "size": ' || p_size || '}' AS json FROM part""")
def js_json_from_parts(spark, sf_dir):
    script = F.concat(F.lit("({name: '"), "p_name", F.lit("', \"size\": "), "p_size", F.lit("})"))
    return relations.js_programs(dealt_parts(spark, sf_dir).select("p_partkey", script.alias("js_text")), "js_text", ["p_partkey"], columns=["json"]).select("p_partkey", "json")


@query("SELECT p_partkey, 0 AS ordinal, 'a' AS name, 'b' || p_size AS bound, chr(39) || 'm' || chr(39) AS module FROM part")
def js_import_names(spark, sf_dir):
    script = F.concat(F.lit("import {a as b"), "p_size", F.lit("} from 'm'"))
    nodes = relations.js_nodes(dealt_parts(spark, sf_dir).select("p_partkey", script.alias("js")), "js", ["p_partkey"], columns=["node_id", "parent_id", "ordinal", "kind", "op", "data"])
    return relations.js_imports(nodes, ["p_partkey"])


def prop_events(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return relations.json_events(spread(table(spark, sf_dir, "events").select("event_id", "props")), "props", ["event_id"], columns=list(columns) or None)


@query("""SELECT g AS grammar, sum(n)::BIGINT AS n FROM (
  SELECT unnest(['StartObject', 'EndObject', 'String', 'Number']) AS g, unnest([1, 1, len(json_keys(props)), len(json_keys(props))]) AS n FROM events WHERE props IS NOT NULL) GROUP BY 1""")
def json_events_from_props(spark, sf_dir):
    return prop_events(spark, sf_dir, "grammar").groupBy("grammar").agg(F.count("*").alias("n"))


@query("SELECT k AS name, count(*)::BIGINT AS n FROM (SELECT unnest(json_keys(props)) AS k FROM events) GROUP BY 1")
def json_keys(spark, sf_dir):
    keys = prop_events(spark, sf_dir, "grammar", "state", "data").where("grammar = 'String' AND state = 'ObjectValue'")
    return keys.groupBy(F.regexp_replace("data", '^"|"$', "").alias("name")).agg(F.count("*").alias("n"))


@query("SELECT event_id, (json_extract(props, '$.k'))::BIGINT AS k FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def json_number_values(spark, sf_dir):
    return prop_events(spark, sf_dir, "grammar", "data", "name").where("grammar = 'Number' AND name = 'k'").select("event_id", F.col("data").cast("bigint").alias("k"))


# Scalar functions over table columns.

def scalar(name: str, source: str, key: str, column: Callable[[], Column], sql: str) -> None:
    """A query of one function: key and ``out``."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, source)
        return (spread(rows) if source in ("documents", "pages") else rows).select(key, column().alias("out"))

    run.__name__ = name
    query(f"SELECT {key}, {sql} AS out FROM {source}")(run)


C = F.col
scalar("collapse_ws", "documents", "doc_id", lambda: text.collapse_whitespace(F.concat(F.lit(" \t"), C("text"), F.lit(" \n "))), r"regexp_replace(regexp_replace(' ' || chr(9) || text || ' ' || chr(10) || ' ', '[ \t\f]*[\r\n][ \t\f\r\n]*', chr(10), 'g'), '[ \t\f]+', ' ', 'g')")
scalar("trim_ws", "documents", "doc_id", lambda: text.trim_whitespace(F.concat(F.lit(" \t\n"), C("text"), F.lit("\r\n "))), r"regexp_replace(chr(9) || text || ' ', '^[ \t\n\f\r]+|[ \t\n\f\r]+$', '', 'g')")
scalar("ascii_lower", "documents", "doc_id", lambda: text.ascii_lower("text"), f"translate(text, '{text.UPPER}', '{text.LOWER}')")
scalar("equal_fold", "orders", "o_orderkey", lambda: text.equal_fold("o_orderpriority", "1-urgent"), "lower(o_orderpriority) = '1-urgent'")
scalar("number_len", "orders", "o_orderkey", lambda: text.number_len(F.concat(C("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit("e3px"))).cast("bigint"), "length(o_totalprice::DECIMAL(18,2)::VARCHAR) + 2")
scalar("dimension", "part", "p_partkey", lambda: F.concat_ws(",", text.dimension(F.concat(C("p_size"), F.lit("px solid")))["num"], text.dimension(F.concat(C("p_size"), F.lit("px solid")))["unit"]), "length(p_size::VARCHAR) || ',2'")
scalar("encode_url", "pages", "page_id", lambda: text.encode_url("url"), "replace(replace(replace(replace(replace(url_encode(url), '+', '%20'), '%21', '!'), '%27', ''''), '%28', '('), '%29', ')')")
scalar("decode_url", "pages", "page_id", lambda: text.decode_url(F.concat(text.encode_url("url"), F.lit("+%ii"))), "url || ' %ii'")
scalar("url_round_trip", "documents", "doc_id", lambda: text.decode_url(text.encode_url("text")) == C("text"), "true")
scalar("encode_data_uri", "part", "p_partkey", lambda: text.encode_data_uri(F.concat(F.lit('<p a="'), "p_name", F.lit('">#&'))), """'%3Cp%20a=%22' || replace(p_name, ' ', '%20') || '%22%3E%23%26'""")
scalar("mediatype", "part", "p_partkey", lambda: text.mediatype(F.concat(F.lit(" text/plain ; charset = utf-8; size="), "p_size"))["params"]["size"], "p_size::VARCHAR")
scalar("mediatype_mime", "part", "p_partkey", lambda: text.mediatype(F.concat(F.lit(" text/x"), "p_size", F.lit(" ; a=b")))["mimetype"], "'text/x' || p_size")
scalar("data_uri", "part", "p_partkey", lambda: text.data_uri(F.concat(F.lit("data:text/html;charset=utf-8;base64,"), F.base64(F.encode("p_name", "utf-8"))))["data"].cast("string"), "p_name")
scalar("data_uri_type", "part", "p_partkey", lambda: text.data_uri(F.concat(F.lit("data:text/html; charset=utf-8 ;base64,"), F.base64(F.encode("p_name", "utf-8"))))["mediatype"], "'text/html;charset=utf-8'")
scalar("quote_entity", "part", "p_partkey", lambda: text.quote_entity(F.concat(F.lit("&#"), F.lpad(F.when(C("p_size") % 2 == 0, "34").otherwise("39"), 5, "0"), F.lit(";x")))["quote"], """CASE WHEN p_size % 2 = 0 THEN '"' ELSE '''' END""")
scalar("append_escape", "part", "p_partkey", lambda: text.append_escape(F.concat(F.lit('"'), "p_name", F.lit('\\"')), '"'), r"""'\"' || p_name || '\\\"'""")
scalar("html_escape_attr", "documents", "doc_id", lambda: text.html_escape_attr(F.concat(F.lit("'"), "text", F.lit('"a"'))), """CASE WHEN length(x) - length(replace(x, '''', '')) > length(x) - length(replace(x, '"', '')) OR (length(x) - length(replace(x, '''', '')) = length(x) - length(replace(x, '"', ''))) THEN '"' || replace(x, '"', '&#34;') || '"' ELSE '''' || replace(x, '''', '&#39;') || '''' END""")
ORACLE_SQL["html_escape_attr"] = ORACLE_SQL["html_escape_attr"].replace("FROM documents", "FROM (SELECT doc_id, '''' || text || '\"a\"' AS x FROM documents)")
scalar("xml_escape_attr", "part", "p_partkey", lambda: text.xml_escape_attr(F.concat(F.lit('"'), "p_name")), """'''"' || p_name || ''''""")
scalar("xml_escape_cdata", "part", "p_partkey", lambda: text.xml_escape_cdata(F.concat(F.lit("<&"), "p_name"))["text"], "'&lt;&amp;' || p_name")
scalar("css_ident", "part", "p_partkey", lambda: text.is_css_ident("p_brand"), "regexp_full_match(p_brand, '-?[a-zA-Z_][a-zA-Z0-9_-]*')")
scalar("css_url_unquoted", "pages", "page_id", lambda: text.is_css_url_unquoted("url"), r"""NOT regexp_matches(url, '["''()\\ ]')""")
scalar("js_identifier_name", "part", "p_partkey", lambda: text.is_js_identifier_name("p_brand"), "regexp_full_match(p_brand, '[A-Za-z$_][A-Za-z0-9$_]*')")
scalar("indent", "documents", "doc_id", lambda: text.indent("text", 4), "replace(text, chr(10), chr(10) || '    ')")
scalar("fits", "part", "p_partkey", lambda: text.fits("p_name", 12), "CASE WHEN strlen(p_name) <= 12 THEN p_name END")
scalar("read_int", "orders", "o_orderkey", lambda: numbers.read_int(F.concat(F.lit("-"), "o_orderkey", F.lit("x")))["value"], "-o_orderkey")
scalar("read_uint", "orders", "o_orderkey", lambda: numbers.read_uint(F.concat("o_orderkey", F.lit("x")))["value"].cast("bigint"), "o_orderkey")
scalar("read_float", "lineitem", "l_orderkey", lambda: numbers.read_float(F.concat(C("l_quantity").cast("int"), F.lit(".5e1px")))["value"], "(l_quantity + 0.5) * 10")
scalar("read_decimal", "lineitem", "l_orderkey", lambda: numbers.read_decimal(F.concat(C("l_quantity").cast("int"), F.lit(".5e1")))["value"], "l_quantity + 0.5")
scalar("read_number", "orders", "o_orderkey", lambda: numbers.read_number(numbers.append_number(F.round(C("o_totalprice") * 100).cast("bigint"), 2))["num"], "round(o_totalprice * 100)::BIGINT")
scalar("append_int", "orders", "o_orderkey", lambda: numbers.append_int("o_custkey", "c"), "'c' || o_custkey")
scalar("len_int", "orders", "o_orderkey", lambda: numbers.len_int("o_custkey").cast("bigint"), "length(o_custkey::VARCHAR)")
scalar("append_decimal", "lineitem", "l_orderkey", lambda: numbers.append_decimal("l_quantity", 2), "l_quantity::BIGINT::VARCHAR")
scalar("append_number", "orders", "o_orderkey", lambda: numbers.append_number(F.round(C("o_totalprice") * 100).cast("bigint"), 2), "replace(replace(replace(format('{:,.2f}', round(o_totalprice * 100)::BIGINT / 100.0), ',', ';'), '.', ','), ';', '.')")
scalar("append_float", "part", "p_partkey", lambda: codecs.append_float_column(C("p_size").cast("double") / 2, 6), "CASE WHEN p_size % 2 = 0 THEN (p_size // 2)::VARCHAR WHEN p_size < 2 THEN '.5' ELSE (p_size // 2) || '.5' END")
scalar("replace_entities", "pages", "page_id", lambda: codecs.replace_entities_column("html", {"copy": "©".encode(), "middot": "·".encode(), "quot": b'"'}), r"""replace(replace(replace(html, '&copy;', '©'), '&middot;', '·'), '&quot;', '"')""")
scalar("collapse_and_replace", "part", "p_partkey", lambda: codecs.collapse_and_replace_column(F.concat(F.lit("  &quot; "), "p_name", F.lit(" \t\n x")), {"quot": b'"'}), """' " ' || p_name || chr(10) || 'x'""")
scalar("position_line", "documents", "doc_id", lambda: codecs.position_column("text", F.octet_length("text"))["line"], "(1 + length(text) - length(replace(text, chr(10), '')))::INTEGER")
scalar("printable", "part", "p_partkey", lambda: codecs.printable_column(C("p_size") + 64), "chr(p_size + 64)")
scalar("js_identifier_start", "part", "p_partkey", lambda: codecs.identifier_column("p_name", "start"), "regexp_matches(p_name, '^[A-Za-z$_]')")
scalar("css_token_text", "part", "p_partkey", lambda: text.css_token_text(F.lit("Ident"), "p_brand"), "'Ident(' || chr(39) || p_brand || chr(39) || ')'")
scalar("decode_url_binary", "pages", "page_id", lambda: F.hex(codecs.decode_url_binary(F.concat(F.lit("%80"), "url"))), "'80' || hex(encode(url))")
scalar("bin_read_u16", "events", "event_id", lambda: binary.read_uint(binary.write_int("event_id", 4), 2, 2).cast("bigint"), "event_id % 65536")
scalar("bin_read_u32_little", "events", "event_id", lambda: binary.read_uint(binary.write_int("event_id", 4, True), 0, 4, True), "event_id")
scalar("bin_round_trip", "events", "event_id", lambda: binary.read_int(binary.append(binary.write_int(-C("event_id"), 8), binary.write_string(F.lit("x"))), 0, 8), "-event_id")
scalar("bitmap_bits", "events", "event_id", lambda: F.array_join(F.transform(binary.bits(binary.write_int("event_id", 2)), lambda b: F.when(b, "1").otherwise("0")), ""), "lpad(right(event_id::BIT::VARCHAR, 16), 16, '0')")
scalar("bitmap_round_trip", "events", "event_id", lambda: F.hex(binary.from_bits(binary.bits(binary.write_int("event_id", 4)))), "lpad(printf('%X', event_id), 8, '0')")


# Plain relational work on the relations.

@query(f"""SELECT d.area, count(*)::BIGINT AS n FROM (SELECT unnest(regexp_extract_all(h, '<([a-z][a-z0-9]*)', 1)) AS tag FROM ({BLANKED})) t
JOIN (VALUES ('nav', 'furniture'), ('footer', 'furniture'), ('article', 'content'), ('p', 'content'), ('h1', 'content')) d(tag, area) USING (tag) GROUP BY 1""")
def join_tag_dimension(spark, sf_dir):
    areas = spark.createDataFrame([("nav", "furniture"), ("footer", "furniture"), ("article", "content"), ("p", "content"), ("h1", "content")], "tag string, area string")
    tags = of_type(page_tokens(spark, sf_dir, "token_type", "text"), "StartTag").select(F.col("text").alias("tag"))
    return tags.join(F.broadcast(areas), "tag").groupBy("area").agg(F.count("*").alias("n"))


@query(f"""WITH t AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(h, '<([a-z][a-z0-9]*)', 1)) AS tag FROM ({BLANKED}))
SELECT page_id FROM pages WHERE page_id NOT IN (SELECT page_id FROM t WHERE tag = 'br')""")
def anti_join_pages_without_br(spark, sf_dir):
    with_br = of_type(page_tokens(spark, sf_dir, "token_type", "text"), "StartTag").where("text = 'br'").select("page_id").distinct()
    return pages(spark, sf_dir).select("page_id").join(with_br, "page_id", "left_anti")


@query(f"""WITH t AS (SELECT unnest(regexp_extract_all(h, '<(/?[a-z][a-z0-9]*)', 1)) AS x FROM ({BLANKED})),
u AS (SELECT CASE WHEN x LIKE '/%' THEN 'EndTag' ELSE 'StartTag' END AS token_type, ltrim(x, '/') AS tag FROM t)
SELECT token_type, tag, count(*)::BIGINT AS n FROM u GROUP BY ROLLUP (token_type, tag)""")
def rollup_tags(spark, sf_dir):
    return of_type(page_tokens(spark, sf_dir, "token_type", "text"), "StartTag", "EndTag").rollup("token_type", F.col("text").alias("tag")).agg(F.count("*").alias("n"))


@query(f"""SELECT tag, n FROM (SELECT tag, count(*)::BIGINT AS n FROM (SELECT unnest(regexp_extract_all(h, '<([a-z][a-z0-9]*)', 1)) AS tag FROM ({BLANKED})) GROUP BY 1) ORDER BY n DESC, tag LIMIT 5""")
def top_tags(spark, sf_dir):
    return html_start_tags_by_name(spark, sf_dir).orderBy(F.desc("n"), "tag").limit(5)


@query(f"""SELECT DISTINCT tag FROM (SELECT unnest(regexp_extract_all(h, '<([a-z][a-z0-9]*)', 1)) AS tag FROM ({BLANKED}))
EXCEPT SELECT DISTINCT tag FROM (SELECT unnest(regexp_extract_all(h, '</([a-z][a-z0-9]*)', 1)) AS tag FROM ({BLANKED}))""")
def tags_never_closed(spark, sf_dir):
    """A set difference from one reading of the pages: names that only ever open."""
    tags = of_type(page_tokens(spark, sf_dir, "token_type", "text"), "StartTag", "EndTag").groupBy(F.col("text").alias("tag"))
    return tags.agg(F.bool_or(F.col("token_type") == "EndTag").alias("closed")).where("NOT closed").select("tag")


@query(f"""SELECT DISTINCT tag FROM (SELECT unnest(regexp_extract_all(h, '<([a-z][a-z0-9]*)', 1)) AS tag FROM ({BLANKED}))
EXCEPT SELECT * FROM (VALUES ('br'), ('img'), ('meta'), ('hr'), ('input'), ('link'))""")
def tags_that_are_not_void(spark, sf_dir):
    void = spark.createDataFrame([(t,) for t in ("br", "img", "meta", "hr", "input", "link")], "tag string")
    return of_type(page_tokens(spark, sf_dir, "token_type", "text"), "StartTag").select(F.col("text").alias("tag")).subtract(void)


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*)::BIGINT AS n, sum((json_extract(props, '$.k'))::BIGINT)::BIGINT AS total FROM events GROUP BY 1, 2")
def events_per_hour(spark, sf_dir):
    values = json_number_values(spark, sf_dir)
    events = table(spark, sf_dir, "events").select("event_id", "ts", "event_type").join(values, "event_id", "left")
    return events.groupBy(F.window("ts", "1 hour")["start"].alias("hour"), "event_type").agg(F.count("*").alias("n"), F.sum("k").alias("total"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """End tags of every page outside raw text."""
    return html_end_tags(spark, sf_dir)


from . import generated  # noqa: E402,F401  registers its queries here
