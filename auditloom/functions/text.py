"""Text and number expressions. Everything here stays a Catalyst column."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS = 1_000_000


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once a row, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def blank_to_null(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


# Fixed set: every character that counts as white space at the ends of a text.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def stripped(value: Column) -> Column:
    """Trim every kind of white space, null as blank."""
    return F.btrim(F.coalesce(value, F.lit("")), F.lit(WHITE_SPACE))


def epoch_us(seconds: Column) -> Column:
    """Epoch seconds (text or number) as whole microseconds; null if not numeric."""
    exact = seconds.try_cast("decimal(29,9)")
    return F.floor(exact * F.lit(MICROS)).cast("bigint")


def number_or(value: Column, default: float | None = 0.0) -> Column:
    number = value.try_cast("double")
    number = F.when(~F.isnan(number), number)
    return number if default is None else F.coalesce(number, F.lit(default))


def numeric_text(value: Column) -> Column:
    """Text that may be a number, any other as null: a cast that fails builds an exception for each row."""
    return F.when(value.rlike("[0-9nN]"), value)


def seconds_text(us: Column) -> Column:
    """Whole microseconds as epoch text with six decimals."""
    seconds = us.cast("decimal(20,0)") * F.lit("0.000001").cast("decimal(6,6)")
    return seconds.cast("decimal(26,6)").cast("string")


def contains_any(text: Column, needles: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(n) for n in needles])


def safe_name(value: Column) -> Column:
    """Lower-case name of letters, digits and single underscores; blank is ``missing``."""
    name = F.lower(F.regexp_replace(F.coalesce(value, F.lit("")), r"[^\p{L}\p{N}]+", "_"))
    return F.coalesce(blank_to_null(F.btrim(name, F.lit("_"))), F.lit("missing"))


def file_name(value: Column, limit: int = 120) -> Column:
    """Text usable as one path element."""
    name = F.regexp_replace(stripped(value), r"[^A-Za-z0-9_.-]+", "_")
    name = F.btrim(F.regexp_replace(name, "_+", "_"), F.lit("_"))
    return F.substring(F.coalesce(blank_to_null(name), F.lit("unknown")), 1, limit)


def basename(value: Column) -> Column:
    """Last path element; trailing slashes and ``/.`` are ignored."""
    value = F.coalesce(value, F.lit(""))
    ragged = value.endswith("/") | value.endswith("/.")
    head = F.when(ragged, F.regexp_replace(value, r"(?:/\.?+)++$", "")).otherwise(value)
    name = F.substring_index(head, "/", -1)
    return F.when(name == ".", "").otherwise(name)


def one_line(value: Column, limit: int = 500) -> Column:
    """Collapse white space and cap the length for display."""
    return once(stripped(F.regexp_replace(value, r"(?U)\s+", " ")), lambda text: F.when(
        F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text))


def printable_hex(value: Column) -> Column:
    """Decode hex digits when at least 85 % of the decoded characters are printable."""
    def shown(text: Column, given: Column) -> Column:
        count = F.length(F.regexp_replace(text, r"[[\p{C}\p{Z}]&&[^ \n\t\r\x00]]", ""))
        return F.when(count >= F.length(text) * F.lit(0.85), stripped(F.translate(text, "\0", " "))).otherwise(given)

    def read(given: Column) -> Column:
        is_hex = given.rlike("^[0-9A-Fa-f]+$") & (F.length(given) % 2 == 0)
        return F.when(is_hex, once(F.make_valid_utf8(F.unhex(given).cast("string")), lambda text: shown(text, given))).otherwise(given)

    return once(value, read)


def joined(items: Column) -> Column:
    return F.array_join(F.coalesce(items, F.array().cast("array<string>")), "|")
