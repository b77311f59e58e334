"""Numbers and text as native Column expressions: reading prefixes, printing, colours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

INT = r"^[+-]?[0-9]+"
FLOAT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"
DECIMAL = r"^-?[0-9]*\.?[0-9]*"
MOST_UNSIGNED = "18446744073709551615"


def found(value: Column, n: Column) -> Column:
    return F.struct(value.alias("value"), n.alias("n"))


def read_int(c: Column | str) -> Column:
    """Struct (value BIGINT, n bytes read); (0, 0) without digits or beyond 64 bits."""
    text = F.regexp_extract(col(c), INT, 0)
    value = text.try_cast("bigint")
    return found(F.coalesce(value, F.lit(0).cast("bigint")), F.when(value.isNull(), 0).otherwise(F.length(text)))


def read_uint(c: Column | str) -> Column:
    text = F.regexp_extract(col(c), "^[0-9]+", 0)
    value = text.try_cast("decimal(38,0)")
    good = value.isNotNull() & (value <= F.lit(MOST_UNSIGNED).cast("decimal(38,0)"))
    return found(F.when(good, value).otherwise(F.lit(0)).try_cast("decimal(20,0)"), F.when(good, F.length(text)).otherwise(0))


def read_float(c: Column | str) -> Column:
    text = F.regexp_extract(col(c), FLOAT, 0)
    return found(F.coalesce(text.try_cast("double"), F.lit(0.0)), F.length(text))


def read_decimal(c: Column | str) -> Column:
    """Digits and one dot, no exponent and no plus sign; a lone dot reads nothing."""
    text = F.regexp_extract(col(c), DECIMAL, 0)
    return found(F.coalesce(text.try_cast("double"), F.lit(0.0)), F.when(text == ".", 0).otherwise(F.length(text)))


def read_number(c: Column | str, group: str = ".", decimal: str = ",") -> Column:
    """Struct (num unscaled, dec decimals, n bytes read) of a number with group signs. Reading stops before the digit
    with which the unscaled number would leave 64 bits."""
    g, d = f"\\x{{{ord(group):x}}}", f"\\x{{{ord(decimal):x}}}"
    whole = F.regexp_extract(col(c), rf"^-?(?:[0-9]|{g})*(?:{d}[0-9]*)?", 0)
    cut = lambda digits: F.regexp_extract(whole, rf"^-?[0{g}{d}]*(?:[0-9][{g}{d}]*){{0,{digits}}}", 0)
    value = lambda text: F.regexp_replace(text, "[^0-9-]", "").try_cast("bigint")
    text = F.when(F.length(F.regexp_replace(whole, "[^0-9]", "")) <= 18, whole).when(value(cut(19)).isNotNull(), cut(19)).otherwise(cut(18))
    decimals = F.length(F.regexp_extract(text, rf"{d}([0-9]*)$", 1))
    return F.struct(F.coalesce(value(text), F.lit(0).cast("bigint")).alias("num"), decimals.alias("dec"), F.octet_length(text).alias("n"))


def append_int(c: Column | str, prefix: str = "") -> Column:
    return F.concat(F.lit(prefix), col(c).cast("string"))


def len_int(c: Column | str) -> Column:
    return F.length(col(c).cast("string"))


def append_decimal(c: Column | str, decimals: int) -> Column:
    """At most that many decimals (0 to 17; other values count as 17), halves away from zero, without trailing zeros;
    empty for NaN and infinities. Numbers that don't fit 64 bits when scaled have all their digits."""
    kept = decimals if 0 <= decimals <= 17 else 17
    value = col(c).cast("double")
    scaled = value * F.lit(float(10**kept))
    rounded = F.when(scaled < 0, scaled - 0.5).otherwise(scaled + 0.5)
    fits = F.abs(rounded) < float(2**63)
    number = F.when(fits, rounded).cast("bigint")
    digits = F.abs(number).cast("string")
    digits = F.lpad(digits, F.greatest(F.length(digits), F.lit(kept + 1)), F.lit("0"))
    point = F.length(digits) - kept
    rest = F.rtrim(F.substring(digits, point + 1, F.lit(kept)), F.lit("0")) if kept else F.lit("")
    short = F.concat(F.when(number < 0, "-").otherwise(""), F.substring(digits, F.lit(1), point), F.when(rest != "", F.concat(F.lit("."), rest)).otherwise(""))
    long = F.format_string(f"%.{kept}f", value)
    long = F.regexp_replace(long, r"\.?0+$", "") if kept else long
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), "").when(fits, short).otherwise(long)


def append_number(c: Column | str, decimals: int, group_size: int = 3, group: str = ".", decimal: str = ",") -> Column:
    """An unscaled whole number printed with decimals and group signs; null for what is no number of up to 38 digits."""
    value = col(c).try_cast("decimal(38,0)")
    plain = F.ltrim(value.cast("string"), F.lit("-"))
    digits = F.lpad(plain, F.greatest(F.length(plain), F.lit(decimals + 1)), F.lit("0"))
    whole, rest = F.substring(digits, F.lit(1), F.length(digits) - decimals), F.substring(digits, F.length(digits) - decimals + 1, F.lit(decimals))
    sign = "\\" + group if group in "$\\" else group
    grouped = F.regexp_replace(whole, rf"(?<=[0-9])(?=(?:[0-9]{{{group_size}}})+$)", sign) if group_size > 0 else whole
    return F.concat(F.when(value < 0, "-").otherwise(""), grouped, *([F.lit(decimal), rest] if decimals > 0 else []))


def hsl_to_rgb(h: Column | str, s: Column | str, l: Column | str) -> Column:
    """Struct (r, g, b) in [0, 1]."""
    h, s, l = col(h), col(s), col(l)
    high = F.when(l <= 0.5, l * (s + 1)).otherwise(l + s - l * s)
    low = l * 2 - high

    def channel(turn: Column) -> Column:
        t = F.when(turn < 0, turn + 1).when(turn > 1, turn - 1).otherwise(turn)
        return F.when(t * 6 < 1, low + (high - low) * t * 6).when(t * 2 < 1, high).when(t * 3 < 2, low + (high - low) * (F.lit(2.0) / 3 - t) * 6).otherwise(low)

    return F.struct(channel(h + F.lit(1.0) / 3).alias("r"), channel(h).alias("g"), channel(h - F.lit(1.0) / 3).alias("b"))
