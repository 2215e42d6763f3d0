"""Text of news and messages as columns: numbers of either locale, counts with a unit, flattening, items, flags."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F


def locale_number(c: Column) -> Column:
    """'3.70', '-358,7', '1,234' (thousands), '1.234,5', '1,234.5' as numbers; else null. Of point and comma the last is the
    decimal sign; a comma alone is one, unless it stands before every three digits of a number not starting with zero."""
    s = F.regexp_replace(F.trim(c), r"[.,]+$", "")
    both = s.contains(",") & s.contains(".")
    comma_last = F.length(s) - F.instr(F.reverse(s), ",") > F.length(s) - F.instr(F.reverse(s), ".")
    plain = F.when(both & comma_last, F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).when(both, F.replace(s, F.lit(","), F.lit("")))
    plain = plain.when(s.rlike(r"^[-+]?[1-9][0-9]{0,2}(,[0-9]{3})+$"), F.replace(s, F.lit(","), F.lit(""))).otherwise(F.replace(s, F.lit(","), F.lit(".")))
    return F.when(plain.rlike(r"^[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)$"), plain.try_cast("double"))


def counted(c: Column) -> Column:
    """'1.2K', '3M', '415' as whole numbers; else null."""
    s = F.upper(F.trim(c))
    scale = F.when(s.endswith("K"), 1e3).when(s.endswith("M"), 1e6).otherwise(1.0)
    return F.when(s.rlike(r"^[0-9]+(\.[0-9]+)?[KM]?$"), F.round(F.regexp_extract(s, r"^([0-9.]+)", 1).try_cast("double") * scale).cast("long"))


def flat(c: Column, marks: str = "\\x{1F300}-\\x{1FAFF}\\x{2600}-\\x{27BF}\\x{2B50}\\x{FE0F}") -> Column:
    """One line: signs and emoji out, white space to one blank, separators at either end off."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, f"[{marks}]+", " "), r"\s+", " "), r"^[ \-–:/|]+|[ \-–:/|]+$", "")


def joined_numbers(c: Column) -> Column:
    """Numbers broken over two lines after a point or comma made one, and characters of no width taken out."""
    return F.regexp_replace(F.regexp_replace(c, "[\\x{200B}-\\x{200D}\\x{2060}\\x{FEFF}]", ""), r"([0-9])[.,]\s*\n\s*([0-9]{3})", "$1.$2")


def items(c: Column) -> Column:
    """A text's items: each starts at a line's beginning with a time of day, HH:MM, or is all that stands before the first."""
    return F.filter(F.split(c, r"(?m)\n(?=\s*[*\-]?\s*[0-9]{1,2}:[0-9]{2}\b)"), lambda x: F.length(F.trim(x)) > 0)


def minute_of(item: Column) -> Column:
    """The minute of the day that an item begins with; null if it begins with none."""
    hour, minute = (F.regexp_extract(item, r"^\s*[*\-]?\s*([0-9]{1,2}):([0-9]{2})", k).try_cast("int") for k in (1, 2))
    return F.when((hour < 24) & (minute < 60), hour * 60 + minute)


def delay_minutes(posted: Column, told: Column, zone: str) -> Column:
    """Minutes from the time of day told to that posted, local time, within a day."""
    local = F.from_utc_timestamp(posted, zone)
    return F.pmod(F.hour(local) * 60 + F.minute(local) - told, F.lit(1440))


def first_listed(c: Column, rules: list[tuple[str, str]], default: Column | None = None) -> Column:
    """The name of the first rule whose pattern is found, in the order listed."""
    out = reduce(lambda acc, r: acc.when(c.rlike(r[1]), r[0]), rules[1:], F.when(c.rlike(rules[0][1]), rules[0][0]))
    return out if default is None else out.otherwise(default)


def flags(c: Column, rules: list[tuple[str, str]]) -> Column:
    """Names of all rules whose patterns are found."""
    return F.filter(F.array(*[F.when(c.rlike(p), F.lit(n)) for n, p in rules]), lambda x: x.isNotNull())


def duration(seconds: Column) -> Column:
    """'1d 2h', '3h 05m' or '7m'."""
    d, h, m = F.floor(seconds / 86400), F.floor(seconds / 3600) % 24, F.floor(seconds / 60) % 60
    return F.when(d > 0, F.format_string("%dd %dh", d, h)).when(h > 0, F.format_string("%dh %02dm", h, m)).otherwise(F.format_string("%dm", m))


def fixed(c: Column, digits: int = 2, signed: bool = False) -> Column:
    """A number with that many digits after the point, halves away from zero: '1.25', '-0.30'; signed, '+1.25'. By whole numbers, so that
    it is the same wherever it is written. Null for null and what is not finite."""
    unit = 10**digits
    whole = F.floor(F.abs(c) * unit + 0.5).cast("long")
    sign = F.when((c < 0) & (whole > 0), "-").otherwise("+" if signed else "")
    tail = F.lpad((whole % unit).cast("string"), digits, "0")
    return F.when(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), F.concat(sign, F.floor(whole / unit).cast("string"), F.lit("."), tail))


def trade_message(kind: Column, side: Column, name: Column, entry: Column, price: Column, gain: Column, net: Column) -> Column:
    """What is said of a trade: one closed has its result with fees too, one still open (kind null or CUT) the gain at the last price;
    one without an entry was skipped, for the reason that kind gives."""
    what = F.concat(F.when(side > 0, "LONG").otherwise("SHORT"), F.lit(" #"), name.cast("string"))
    way = F.concat(what, F.lit(" "), fixed(entry), F.lit(" -> "), fixed(price), F.lit(" "), fixed(gain, signed=True), F.lit(" R"))
    is_open = F.coalesce(kind == "CUT", F.lit(True))
    closed = F.concat(kind, F.lit(" "), way, F.lit(" (net "), fixed(net, signed=True), F.lit(" R)"))
    return F.when(entry.isNull(), F.concat(F.lit("SKIPPED "), what, F.lit(": "), F.coalesce(kind, F.lit("unknown")))).when(is_open, F.concat(F.lit("OPEN "), way)).otherwise(closed)
