"""Functions on bytes that expressions can't state: entity replacement, URL decoding to any bytes, float text.

Each has a plain Python form and a vectorised Column form. The latter works on slices of Spark's batches, so that a
worker holds a batch once, as Spark sends it, and not all of its values and results as objects as well.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..operators.relations import column, slices
from ..shipping import ship
from . import positions
from .text import col

REFERENCE = re.compile(rb"&(?:#x([0-9a-fA-F]+)|#([0-9]+)|([0-9a-zA-Z]{1,31}));")
WHITE = re.compile(rb"[ \t\n\f\r]+")


def replace_entities(data: bytes, entities: dict[str, bytes], reverse: dict[bytes, bytes]) -> bytes:
    """Character references as bytes where that is safe.

    Named ones come from ``entities``; hexadecimal ones below 128 become the byte, those below 10000 decimal
    references; decimal ones below 128 become the byte. A single byte that ``reverse`` knows is written as its
    reference there. An ampersand that could start another reference stays escaped.
    """
    out, done = [], 0
    for m in REFERENCE.finditer(data):
        if m.start() < done or m.start() + 3 >= len(data):
            continue
        hexadecimal, decimal, name = m.groups()
        if name is not None:
            new = entities.get(name.decode())
        elif hexadecimal is not None:
            code = int(hexadecimal, 16)
            new = None if code >= 10_000 else bytes([code]) if code < 128 else b"&#%d;" % code
        else:
            new = bytes([int(decimal)]) if len(decimal.lstrip(b"0")) < 4 and int(decimal) < 128 else None
        if new is None:
            continue
        if len(new) == 1 and new in reverse:
            new = reverse[new]
        elif new == b"&" and re.match(rb"[0-9a-zA-Z#]", data[m.end() : m.end() + 1]):
            continue
        out += [data[done : m.start()], new]
        done = m.end()
    return b"".join(out) + data[done:]


def collapse(data: bytes) -> bytes:
    return WHITE.sub(lambda m: b"\n" if b"\n" in m[0] or b"\r" in m[0] else b" ", data)


def collapse_and_replace(data: bytes, entities: dict[str, bytes], reverse: dict[bytes, bytes]) -> bytes:
    """White space is collapsed before references are replaced, so white space from references stays."""
    return replace_entities(collapse(data), entities, reverse)


def decode_url_bytes(data: bytes) -> bytes:
    return re.sub(rb"%([0-9a-fA-F]{2})", lambda m: bytes([int(m[1], 16)]), data.replace(b"+", b" "))


def append_float(f: float | None, precision: int) -> str | None:
    """Short text of a number cut (not rounded) to ``precision`` + 1 digits: no leading zero, no trailing zeros,
    and an exponent where that is shorter. NaN and infinities give an empty text."""
    if f is None:
        return None
    if math.isnan(f) or math.isinf(f):
        return ""
    sign, f = ("-", -f) if f < 0 else ("", f)
    if precision < 0 or precision > 17:
        precision = 17
    if f == 0:
        return "0"
    keep = precision - math.floor(math.log10(f))  # decimals kept; negative: digits lost before the point
    scaled = int(f * 10.0**keep) if keep <= 300 else int(f * 1e300 * 10.0 ** (keep - 300))
    if not scaled:
        return "0"
    digits = str(scaled)
    top = len(digits) - keep - 1  # power of ten of the first digit
    return sign + short_text(digits.rstrip("0"), top, keep < 0)


def short_text(digits: str, top: int, cut: bool) -> str:
    """Digits without trailing zeros, of which the first stands for 10^top. ``cut``: digits before the point
    are missing, so the mantissa keeps one digit before its point."""
    n = len(digits)
    mantissa = digits[0] + ("." + digits[1:] if n > 1 else "")
    if top < -3:
        last = top - n + 1
        return f"{digits}e{last}" if len(str(last)) == len(str(top)) else f"{mantissa}e{top}"
    if top < 0:
        return "." + "0" * (-top - 1) + digits
    zeros = top - n + 1
    if cut and top >= 3:
        return f"{mantissa}e{top}"
    if zeros >= 3:
        return f"{digits}e{zeros}"
    return digits + "0" * zeros if zeros >= 0 else f"{digits[: top + 1]}.{digits[top + 1 :]}"


def vectorised(function: Callable, result: str, *columns: Column | str) -> Column:
    """A column of a Python function of single values; null where one of them is. Texts come as bytes and may be given
    back so."""
    ship(SparkSession.active())
    kind = to_arrow_type(T._parse_datatype_string(result))

    def values(part: pa.Array) -> list:
        return (part.cast(pa.binary()) if pa.types.is_string(part.type) else part).to_pylist()

    @F.arrow_udf(result)
    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for arrays in batches:
            arrays = arrays if isinstance(arrays, tuple) else (arrays,)
            batch = pa.RecordBatch.from_arrays(list(arrays), [str(k) for k in range(len(arrays))])
            del arrays
            for part in slices(batch, batch.nbytes):
                rows = zip(*map(values, part.columns))
                yield column([None if None in row else function(*row) for row in rows], kind)
            del batch, part  # before the next one comes

    return run(*[col(c) for c in columns])


def text_column(function, c: Column | str, *arguments) -> Column:
    """A vectorised column of a bytes -> bytes function over texts."""
    return vectorised(lambda x: function(x, *arguments), "string", c)


def replace_entities_column(c: Column | str, entities: dict[str, bytes], reverse: dict[bytes, bytes] | None = None) -> Column:
    return text_column(replace_entities, c, entities, reverse or {})


def collapse_and_replace_column(c: Column | str, entities: dict[str, bytes], reverse: dict[bytes, bytes] | None = None) -> Column:
    return text_column(collapse_and_replace, c, entities, reverse or {})


def decode_url_binary(c: Column | str) -> Column:
    return vectorised(decode_url_bytes, "binary", c)


def append_float_column(c: Column | str, precision: int) -> Column:
    return vectorised(lambda x: append_float(x, precision), "string", col(c).cast("double"))


def position_column(c: Column | str, offset: Column | str) -> Column:
    """Struct (line, col, context) of a byte offset of a text; null where one of them is."""
    return vectorised(positions.position, "struct<line: int, col: int, context: string>", c, offset)


def error_text(error: Column | str) -> Column:
    """An error struct of a relation as one readable text."""
    e = col(error)
    return F.format_string("%s on line %d and column %d\n%s", e["message"], e["line"], e["col"], e["context"])


def printable_column(code: Column | str) -> Column:
    """A code point as itself if it can be shown, else as 0x.. or U+...."""
    return vectorised(positions.printable, "string", code)


def identifier_column(c: Column | str, part: str) -> Column:
    """Whether the first character starts a JavaScript identifier (``start``), continues one (``continue``), or the
    last one does (``end``); empty texts are false."""
    from ..operators import js

    place, signs, test = {"start": (0, "$_", js.starts_name), "continue": (0, "$_", js.continues_name), "end": (-1, "$_", js.continues_name)}[part]

    def holds(data: bytes) -> bool:
        x = data.decode("utf-8", "replace")
        return bool(x) and (x[place] in signs or test(x[place]))

    return vectorised(holds, "boolean", c)
