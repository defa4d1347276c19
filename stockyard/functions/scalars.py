"""Column expressions for the scalar rules of the data model (no Python on rows)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters a JavaScript string trim removes.
BLANKS = r"\s\x{0B}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"


def trim_all(c: Column) -> Column:
    """Strip all white space at both ends, not only blanks."""
    return F.regexp_replace(c, f"^[{BLANKS}]+|[{BLANKS}]+$", "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(trim_all(c), F.lit(""))


def present(c: Column) -> Column:
    """Supplied and not the empty string."""
    return c.isNotNull() & (c != "")


def parse_int(c: Column) -> Column:
    """Leading integer of a text ('12abc' is 12, '0x1f' is 31), NULL where there is none."""
    text = F.regexp_extract(c, rf"^[{BLANKS}]*([+-]?\d+)", 1)
    hexa = F.regexp_extract(c, rf"^[{BLANKS}]*[+-]?0[xX]([0-9a-fA-F]+)", 1)
    minus = c.rlike(rf"^[{BLANKS}]*-")
    hex_value = F.conv(hexa, 16, 10).try_cast("bigint")
    return F.when(hexa != "", F.when(minus, -hex_value).otherwise(hex_value)).otherwise(text.try_cast("bigint"))


def parse_float(c: Column) -> Column:
    """Leading decimal number of a text, NULL where there is none."""
    text = F.regexp_extract(c, rf"^[{BLANKS}]*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1)
    return text.try_cast("double")


def to_money(c: Column) -> Column:
    """Two decimals, half up."""
    return c.cast("decimal(10,2)")


def round_half_up(c: Column) -> Column:
    """Round to an integer with halves toward plus infinity (-0.5 gives 0)."""
    return F.floor(c + F.lit(0.5)).cast("bigint")


def iso_text(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def short_code(c: Column) -> Column:
    """First dash-separated part of an id, upper case."""
    return F.upper(F.split(c.cast("string"), "-")[0])


def first_name(c: Column) -> Column:
    return F.split(c, " ")[0]


def medium_datetime(c: Column) -> Column:
    """Like '3 Oct 1998, 12:00 am'."""
    return F.concat(F.date_format(c, "d MMM yyyy, h:mm "), F.lower(F.date_format(c, "a")))


def indian_grouping(c: Column) -> Column:
    """Digits grouped 3, then 2, 2, ...: 1234567.50 gives '12,34,567.5'."""
    text = F.abs(c).cast("decimal(20,2)").cast("string")
    whole = F.regexp_replace(F.split(text, r"\.")[0], r"(\d)(?=(\d\d)+\d$)", "$1,")
    frac = F.regexp_replace(F.split(text, r"\.")[1], "0+$", "")
    sign = F.when(c < 0, F.lit("-")).otherwise(F.lit(""))
    return F.concat(sign, whole, F.when(frac != "", F.concat(F.lit("."), frac)).otherwise(F.lit("")))


def image_url(key: Column, base_url: str) -> Column:
    return F.when(present(key), F.concat(F.lit(base_url.rstrip("/") + "/"), key))


def millis_between(later: Column, earlier: Column) -> Column:
    return F.unix_millis(later.cast("timestamp")) - F.unix_millis(earlier.cast("timestamp"))


def epoch_millis(c: Column) -> Column:
    return F.unix_millis(c.cast("timestamp"))


def clamp_page(page: str | int | None, limit: str | int | None) -> tuple[int, int, int]:
    """(page, limit, offset) with page >= 1 and 1 <= limit <= 50; 0 or junk means the default."""

    def lead_int(v):
        text = str(v).strip() if v is not None else ""
        digits = ""
        for i, ch in enumerate(text):
            if ch.isdigit() or (i == 0 and ch in "+-"):
                digits += ch
            else:
                break
        try:
            return int(digits)
        except ValueError:
            return 0

    p = max(1, lead_int(page) or 1)
    n = min(50, max(1, lead_int(limit) or 10))
    return p, n, (p - 1) * n
