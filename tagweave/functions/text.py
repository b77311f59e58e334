"""Text functions as native Column expressions: white space, escaping, URLs, media types, predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = r"[ \t\n\f\r]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NUMBER = r"^[+-]?([0-9]+(\.[0-9]+)?|\.[0-9]+)([eE][+-]?[0-9]+)?"
ESCAPE = r"\\(?:[0-9a-fA-F]{1,6}[ \t\n\r\f]?|[^0-9a-fA-F\n\r\f])"
IDENT = rf"(?:--|-?(?:[a-zA-Z_\x{{80}}-\x{{10FFFF}}]|{ESCAPE}))(?:[a-zA-Z0-9_\-\x{{80}}-\x{{10FFFF}}]|{ESCAPE})*"
URL = rf"(?:[^\"'()\\ \x00-\x1f\x7f]|{ESCAPE})*"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def number_len(c: Column | str) -> Column:
    """Length of the number that the text begins with; 0 if none."""
    return F.length(F.regexp_extract(col(c), NUMBER, 0))


def dimension(c: Column | str) -> Column:
    """Struct (num, unit): lengths of the leading number and of the unit after it (percent sign or letters)."""
    pattern = NUMBER + "(%|[a-zA-Z]+)?"
    return F.struct(number_len(c).alias("num"), F.length(F.regexp_extract(col(c), pattern, 4)).alias("unit"))


def ascii_lower(c: Column | str) -> Column:
    return F.translate(col(c), UPPER, LOWER)


def equal_fold(c: Column | str, lower: str) -> Column:
    return ascii_lower(c) == F.lit(lower)


def collapse_whitespace(c: Column | str) -> Column:
    """Each run of white space becomes a line feed if it has a line end, else a space."""
    lines = F.regexp_replace(col(c), r"[ \t\f]*[\r\n]" + BLANK + "*", "\n")
    return F.regexp_replace(lines, r"[ \t\f]+", " ")


def trim_whitespace(c: Column | str) -> Column:
    return F.regexp_replace(col(c), rf"\A{BLANK}+|{BLANK}+\z", "")


def is_whitespace(c: Column | str) -> Column:
    """One white-space character."""
    return col(c).rlike(rf"\A{BLANK}\z")


def is_newline(c: Column | str) -> Column:
    return col(c).isin("\n", "\r")


def is_all_whitespace(c: Column | str) -> Column:
    return col(c).rlike(rf"\A{BLANK}*\z")


def is_css_ident(c: Column | str) -> Column:
    """The whole text is one CSS identifier; empty is true."""
    return col(c).rlike(rf"\A(?:{IDENT})?\z")


def is_css_url_unquoted(c: Column | str) -> Column:
    return col(c).rlike(rf"\A{URL}\z")


def is_js_identifier_name(c: Column | str) -> Column:
    """ASCII identifier names only."""
    return col(c).rlike(r"\A[A-Za-z$_][A-Za-z0-9$_]*\z")


def is_js_decimal(c: Column | str) -> Column:
    return col(c).rlike(r"\A(0|[1-9][0-9]*(\.[0-9]*)?|\.[0-9]+)\z")


def decode_url(c: Column | str) -> Column:
    """%XX and + decoded, malformed % kept. Null where the bytes aren't UTF-8: see codecs.decode_url_bytes."""
    return F.try_url_decode(F.regexp_replace(col(c), r"%(?![0-9A-Fa-f]{2})", "%25"))


#: Characters besides letters, digits and * - . _ that stay as they are in a URL, and in the data of a data URI.
URL_PLAIN = "!'()~"
DATA_URI_PLAIN = "!$'()+,/:;=?@~"


def encode_url(c: Column | str, plain: str = URL_PLAIN) -> Column:
    """Bytes other than letters, digits, * - . _ and those of ``plain`` (ASCII) become %XX."""
    out = F.replace(F.url_encode(col(c)), F.lit("+"), F.lit("%20"))
    for sign in plain:
        out = F.replace(out, F.lit(f"%{ord(sign):02X}"), F.lit(sign))
    return out


def encode_data_uri(c: Column | str) -> Column:
    return encode_url(c, DATA_URI_PLAIN)


def append_escape(c: Column | str, characters: str, escape: str = "\\") -> Column:
    """``escape`` before each of the characters and before itself."""
    signs = "".join(f"\\x{{{ord(x):x}}}" for x in characters + escape)
    mark = "".join("\\" + x if x in "\\$" else x for x in escape)
    return F.regexp_replace(col(c), f"([{signs}])", mark + "$1")


def quote_entity(c: Column | str) -> Column:
    """Struct (quote, n): the quote that a leading character reference stands for and the reference's length."""
    pattern = r"^&(?:#0*3([49])|#x0*2([27])|(quot|apos));"
    decimal, hexadecimal, name = (F.regexp_extract(col(c), pattern, k) for k in (1, 2, 3))
    double = (decimal == "4") | (hexadecimal == "2") | (name == "quot")
    single = (decimal == "9") | (hexadecimal == "7") | (name == "apos")
    return F.struct(F.when(double, '"').when(single, "'").alias("quote"), F.length(F.regexp_extract(col(c), pattern, 0)).alias("n"))


def mediatype(c: Column | str) -> Column:
    """Struct (mimetype, params); params is null without a semicolon. Of repeated parameters the last counts."""
    text = F.regexp_replace(col(c), r"\A +", "")
    mime = F.regexp_extract(text, r"(?s)\A(.{0,2}\z|.{3}[^; ]*)", 1)
    rest = F.regexp_extract(text, r"(?s)\A.{3}[^; ]* *;(.*)\z", 1)
    has = text.rlike(r"(?s)\A.{3}[^; ]* *;")
    key = r"(?s)\A *([^=; ]*)"
    # A part that ends at a space followed by anything but a semicolon ends the list.
    whole = F.regexp_extract(rest, r"(?s)\A((?: *[^=; ]* *(?:= *[^; ]*)? *(?:;|\z))*(?: *[^=; ]* *(?:= *[^; ]*)?)?)", 1)
    parts = F.split(F.regexp_replace(whole, r";\z", "; "), ";")
    pair = lambda p: F.struct(F.regexp_extract(p, key, 1).alias("k"), F.regexp_extract(p, r"(?s)\A *[^=; ]* *= *([^; ]*)", 1).alias("v"))
    pairs = F.transform(parts, pair)
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.struct(mime.alias("mimetype"), F.when(has, F.map_from_entries(last)).alias("params"))


def data_uri(c: Column | str) -> Column:
    """Struct (mediatype, data, error)."""
    text = col(c)
    good = text.rlike(r"(?s)\Adata:[^,]*,")
    head = F.regexp_extract(text, r"(?s)\Adata:([^,]*),", 1)
    body = F.regexp_extract(text, r"(?s)\Adata:[^,]*,(.*)\z", 1)
    marked = F.transform(F.split(F.regexp_replace(head, "([=;])", "$1\u0001"), "\u0001"), lambda p: F.concat(trim_whitespace(F.regexp_replace(p, r"[=;]\z", "")), F.regexp_extract(p, r"[=;]\z", 0)))
    base64 = F.exists(marked, lambda p: p.isin("base64", "base64;"))
    kept = F.regexp_replace(F.array_join(F.filter(marked, lambda p: ~p.isin("base64", "base64;")), ""), r"[;=]\z", "")
    kind = F.when(F.length(kept) == 0, "text/plain").when(kept.startswith(";"), "text/plain").otherwise(kept)
    decoded = F.when(base64, F.try_to_binary(body, F.lit("base64"))).otherwise(F.encode(decode_url(F.when(~base64, body)), "utf-8"))
    wrong = F.when(~good, "invalid data URI").when(base64 & decoded.isNull(), "illegal base64 data")
    return F.struct(F.when(wrong.isNull(), kind).alias("mediatype"), F.when(wrong.isNull(), decoded).alias("data"), wrong.alias("error"))


def occurrences(c: Column, sign: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(sign), F.lit("")))


def quoted(c: Column, quote: str, entity: str) -> Column:
    return F.concat(F.lit(quote), F.replace(c, F.lit(quote), F.lit(entity)), F.lit(quote))


def html_escape_attr(c: Column | str, quote: Column | str = "", must_quote: bool = False) -> Column:
    """An attribute value with the shortest quoting; ``quote``: the one it had, or empty."""
    text, had = col(c), F.lit(quote) if isinstance(quote, str) else quote
    singles, doubles = occurrences(text, "'"), occurrences(text, '"')
    bare = ~text.rlike("[\t\n\f\r \"'<=>`]")
    bare = bare & (had == "") if must_quote else bare
    keep = ((singles == 0) & (had == "'")) | ((doubles == 0) & (had == '"'))
    double = (singles > doubles) | ((singles == doubles) & (had != "'"))
    return F.when(bare, text).when(keep, F.concat(had, text, had)).when(double, quoted(text, '"', "&#34;")).otherwise(quoted(text, "'", "&#39;"))


def xml_escape_attr(c: Column | str) -> Column:
    """Always quoted, by the rarer quote (double on a tie)."""
    text = col(c)
    return F.when(occurrences(text, '"') > occurrences(text, "'"), quoted(text, "'", "&#39;")).otherwise(quoted(text, '"', "&#34;"))


def xml_escape_cdata(c: Column | str) -> Column:
    """Struct (text, escaped): plain text where that is no longer than a CDATA section."""
    text = col(c)
    short = 3 * occurrences(text, "<") + 4 * occurrences(text, "&") <= 12
    return F.struct(F.when(short, F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))).otherwise(text).alias("text"), short.alias("escaped"))


def indent(c: Column | str, width: int) -> Column:
    """``width`` spaces after each line feed."""
    return F.replace(col(c), F.lit("\n"), F.lit("\n" + " " * width))


def fits(c: Column | str, capacity: int) -> Column:
    """The value if it fits into a sink of that many bytes, else null."""
    return F.when(F.octet_length(col(c)) <= capacity, col(c))


def css_token_text(token_type: Column | str, data: Column | str) -> Column:
    return F.format_string("%s('%s')", col(token_type), col(data))
