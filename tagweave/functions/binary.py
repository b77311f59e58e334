"""Binary columns as native expressions: reading and writing fixed-width numbers, ranges and bits.

Offsets count bytes from 0. Reads beyond the end give null (ranges are cut short). Numbers are big-endian
unless ``little``. Bits go from the most significant of each byte.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

KINDS = {1: "smallint", 2: "int", 3: "int", 4: "bigint", 8: "decimal(20,0)"}
SIGNED = {1: "tinyint", 2: "smallint", 3: "int", 4: "int", 8: "bigint"}


def at(offset: Column | int) -> Column:
    return F.lit(offset) if isinstance(offset, int) else offset


def read_bytes(b: Column | str, offset: Column | int, n: Column | int) -> Column:
    return F.when(at(offset) >= 0, F.substring(col(b), at(offset) + 1, at(n)))


def at_end(b: Column | str, offset: Column | int, n: Column | int) -> Column:
    """Whether a range goes beyond the end."""
    return at(offset) + at(n) > F.octet_length(col(b))


def remaining(b: Column | str, offset: Column | int) -> Column:
    return F.octet_length(col(b)) - at(offset)


def seek(b: Column | str, position: Column | int, offset: Column | int, whence: str = "start") -> Column:
    """The position after moving by ``offset`` from the start, the current position or the end; null outside the bytes."""
    size = F.octet_length(col(b))
    to = {"start": F.lit(0), "current": at(position), "end": size}[whence] + at(offset)
    return F.when((to >= 0) & (to <= size), to)


def same_page(offset: Column, start: Column, end: Column, page: int = 4096) -> Column:
    return (F.floor(start / page) == F.floor(offset / page)) & (F.floor(end / page) == F.floor(offset / page))


def digits(b: Column | str, offset: Column | int, width: int, little: bool) -> Column:
    text = F.hex(read_bytes(b, offset, width))
    return F.concat(*[F.substring(text, 2 * (width - 1 - k) + 1, 2) for k in range(width)]) if little else text


def read_uint(b: Column | str, offset: Column | int, width: int, little: bool = False) -> Column:
    text = digits(b, offset, width, little)
    value = F.conv(text, 16, 10).cast("decimal(20,0)")
    return F.when(F.length(text) == 2 * width, value).cast(KINDS[width])


def read_int(b: Column | str, offset: Column | int, width: int, little: bool = False) -> Column:
    """Two's complement for every width, 3 bytes included: 0xFFFFFF is -1, not 16777215 as in readers that only widen
    the unsigned value; ``read_uint`` gives that one."""
    value = read_uint(b, offset, width, little).cast("decimal(21,0)")
    half = F.lit(str(2 ** (8 * width - 1))).cast("decimal(21,0)")
    return F.when(value >= half, value - half - half).otherwise(value).cast(SIGNED[width])


def write_int(c: Column | str, width: int, little: bool = False) -> Column:
    """Signed or unsigned whole numbers in ``width`` bytes."""
    text = F.substring(F.lpad(F.hex(col(c).cast("bigint")), 16, "0"), 17 - 2 * width, 2 * width)
    if little:
        text = F.concat(*[F.substring(text, 2 * (width - 1 - k) + 1, 2) for k in range(width)])
    return F.unhex(text)


def write_string(c: Column | str) -> Column:
    return F.encode(col(c), "utf-8")


def append(*parts: Column) -> Column:
    return F.concat(*parts)


def bits(b: Column | str) -> Column:
    """ARRAY<BOOLEAN> of all bits."""
    byte = lambda i: F.conv(F.hex(F.substring(col(b), F.floor(i / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    one = lambda i: F.call_function("getbit", byte(i), (F.lit(7) - i % 8).cast("int")) == 1
    return F.when(F.octet_length(col(b)) == 0, F.array().cast("array<boolean>")).otherwise(F.transform(F.sequence(F.lit(0), F.octet_length(col(b)) * 8 - 1), one))


def from_bits(b: Column | str) -> Column:
    """Bytes of an ARRAY<BOOLEAN>; the last byte is filled with zeros."""
    text = F.array_join(F.transform(col(b), lambda x: F.when(x, "1").otherwise("0")), "")
    full = F.rpad(text, (F.ceil(F.length(text) / 8) * 8).cast("int"), F.lit("0"))
    eights = F.filter(F.split(full, r"(?<=\G.{8})"), lambda x: x != "")
    return F.unhex(F.array_join(F.transform(eights, lambda x: F.lpad(F.conv(x, 2, 16), 2, "0")), ""))
