"""SQL surface: table functions for LATERAL joins, and the native scalar functions by name.

A table function takes a document and gives its rows. Those with options take them as further arguments:
``html_tokens(x, begin, end)`` the delimiters of templates, ``css_grammar(x, inline)``, ``js_tokens(x, regexp)``,
``js_nodes(x, inline)`` and the other JavaScript relations.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import numbers, text
from ..operators import css, html, js, json, relations, xml
from ..shipping import ship


def table_function(kernel: Callable[..., Iterator[tuple]], schema: str, numbered: bool = True):
    own = T.StructType.fromDDL(("seq INT, " if numbered else "") + schema)
    kinds = [f.type for f in to_arrow_schema(own)]

    class Rows:
        def eval(self, content, *options):
            if content is not None:
                data = content if isinstance(content, bytes) else content.encode("utf-8", "surrogatepass")
                for seq, row in enumerate(kernel(data, *options)):
                    yield tuple(relations.shaped(v, k) for v, k in zip((seq, *row) if numbered else row, kinds))

    return udtf(Rows, returnType=own)


def of_program(rows: Callable) -> Callable[..., Iterator[tuple]]:
    return lambda data, inline=False: relations.of_programs(rows, inline)(data)


#: Name -> (kernel, columns, whether rows are numbered).
FUNCTIONS = {
    "html_tokens": (html.tokens, relations.HTML, True), "xml_tokens": (xml.tokens, relations.XML, True), "css_tokens": (css.tokens, relations.CSS_TOKENS, True), "css_grammar": (css.grammar, relations.CSS_GRAMMAR, True),
    "json_events": (json.events, relations.JSON, True), "js_tokens": (js.tokens, relations.JS_TOKENS, True), "js_nodes": (of_program(relations.node_rows), relations.JS_NODES, False),
    "js_scopes": (of_program(relations.scope_rows), relations.JS_SCOPES, False), "js_vars": (of_program(relations.var_rows), relations.JS_VARS, False), "js_programs": (of_program(relations.program_rows), relations.JS_PROGRAMS, False),
}

#: Native functions of one text, which become SQL functions of the same name.
OF_TEXT: dict[str, Callable[[str], Column]] = {
    "number_len": text.number_len, "dimension_of": text.dimension, "ascii_lower": text.ascii_lower, "collapse_whitespace": text.collapse_whitespace, "trim_whitespace": text.trim_whitespace, "is_whitespace": text.is_whitespace,
    "is_newline": text.is_newline, "is_all_whitespace": text.is_all_whitespace, "is_css_ident": text.is_css_ident, "is_css_url_unquoted": text.is_css_url_unquoted, "is_js_identifier_name": text.is_js_identifier_name, "is_js_decimal": text.is_js_decimal,
    "decode_url_lenient": text.decode_url, "encode_url_strict": text.encode_url, "quote_entity": text.quote_entity, "html_escape_attr": text.html_escape_attr, "xml_escape_attr": text.xml_escape_attr, "xml_escape_cdata": text.xml_escape_cdata,
    "read_int": numbers.read_int, "read_uint": numbers.read_uint, "read_float": numbers.read_float, "read_decimal": numbers.read_decimal, "read_number": numbers.read_number,
}


def register(spark: SparkSession) -> None:
    """Adds all of these to a session, for as long as it lasts."""
    ship(spark)
    for name, (kernel, schema, numbered) in FUNCTIONS.items():
        spark.udtf.register(name, table_function(kernel, schema, numbered))
    empty = spark.createDataFrame([], "x STRING")
    for name, function in OF_TEXT.items():
        analysed = empty.select(function("x").alias("y"))
        expression = analysed._jdf.queryExecution().analyzed().expressions().head().child().sql()
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(x STRING) RETURNS {analysed.schema['y'].dataType.simpleString()} RETURN {expression}")
