"""Column expressions for dates, identifiers, texts and money. All of them stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters whose values never appear in a log or a stored address.
SECRET_PARAMETERS = ("apikey", "api_key", "token", "key", "access_token")


def parse_date(text: Column) -> Column:
    """yyyy-MM-dd; empty and malformed texts are null."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def parse_compact_date(text: Column) -> Column:
    return F.when(text.rlike(r"^\d{8}$"), F.try_to_date(text, "yyyyMMdd"))


def parse_instant(text: Column) -> Column:
    return F.try_to_timestamp(text)


def parse_decimal(text: Column) -> Column:
    """Exact decimal(38,10); null for what is no number, too large, or needs more than ten decimals."""
    number = F.trim(text)
    fits = number.rlike(r"^[+-]?(\d{1,28})(\.\d{1,10}0*)?$")
    # d.ddde±xx: exact if the exponent leaves at most ten decimals and 28 digits before the point; zeros at the end do not count
    scientific = r"^[+-]?\d(?:\.(\d{0,37}?)0*)?[eE]([+-]?\d{1,2})$"
    # null where there is none: a try_cast of an empty text throws and catches, and costs more than all the rest
    exponent = F.nullif(F.regexp_extract(number, scientific, 2), F.lit("")).cast("int")
    exact = number.rlike(scientific) & (exponent <= 27) & (F.length(F.regexp_extract(number, scientific, 1)) - exponent <= 10)
    # two branches, not one condition: Spark makes what both sides of an "or" share ahead of it, so every plain number would be searched for an exponent
    return F.when(fits, number.cast("decimal(38,10)")).when(exact, number.cast("decimal(38,10)"))


def exact_decimal(text: Column, what: Column) -> Column:
    """:func:`parse_decimal` for values that have to fit: anything else raises, nothing is rounded."""
    parsed = parse_decimal(text)
    return F.when(parsed.isNotNull(), parsed).otherwise(F.raise_error(F.concat(F.lit("value out of range or scale: "), text, F.lit(" in "), what)).cast("decimal(38,10)"))


def fitted(value: Column, what: Column) -> Column:
    """A number of any type as decimal(38,10), unchanged in value; one that is too large or has more decimals raises. Null stays null."""
    text = value.cast("string")
    plain = F.when(text.contains("E"), text).otherwise(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"))
    return F.when(value.isNull(), F.lit(None).cast("decimal(38,10)")).otherwise(exact_decimal(F.regexp_replace(plain, r"\.$", ""), what))


def parse_items(text: Column) -> Column:
    """Comma list to trimmed, non-empty entries; null counts as empty."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def has_item(items: Column, prefix: str) -> Column:
    return F.coalesce(F.exists(items, lambda x: x.startswith(prefix)), F.lit(False))


def dashed_accession(text: Column) -> Column:
    """NNNNNNNNNN-NN-NNNNNN from that form or from 18 bare digits; null for anything else."""
    dashed = F.regexp_replace(F.trim(text), r"^(\d{10})(\d{2})(\d{6})$", "$1-$2-$3")
    return F.when(dashed.rlike(r"^\d{10}-\d{2}-\d{6}$"), dashed)


def padded_cik(cik: Column) -> Column:
    return F.lpad(cik.cast("string"), 10, "0")


def path_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(\.[A-Za-z]+)?$", 1)


def plain_number(value: Column) -> Column:
    """A decimal as text without trailing zeros or exponent."""
    text = value.cast("string")
    return F.when(text.contains("."), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


def abbreviated(value: Column) -> Column:
    """Thousands separators; billions and millions with three decimals."""
    size = F.abs(value)
    in_unit = lambda unit, suffix: F.concat(F.format_number(value.cast("double") / unit, 3), F.lit(suffix))
    return F.when(size >= 10**9, in_unit(1e9, "B")).when(size >= 10**6, in_unit(1e6, "M")).otherwise(F.format_number(value.cast("double"), 2))


def percent(share: Column) -> Column:
    """Two decimals; a positive share below 0.01% says so instead of showing zero."""
    return F.when(share.isNull(), None).when((share > 0) & (share < 0.0001), "<0.01%").otherwise(F.concat(F.format_number(share * 100, 2), F.lit("%")))


def percent_change(change: Column) -> Column:
    """A signed change in percent with two decimals; null stays null, what is no finite number is refused."""
    endless = F.isnan(change) | (F.abs(change) == float("inf"))
    text = F.concat(F.when(change > 0, "+").otherwise(""), F.format_number(change * 100, 2), F.lit("%"))
    return F.when(endless, F.raise_error(F.lit("a change that is no finite number has no percentage"))).otherwise(text)


def document_url(cik: Column, accn: Column) -> Column:
    """The public address of a filing's index page."""
    folder = F.replace(accn, F.lit("-"), F.lit(""))
    return F.concat(F.lit("https://www.sec.gov/Archives/edgar/data/"), cik.cast("string"), F.lit("/"), folder, F.lit("/"), accn, F.lit("-index.htm"))


def redact_uri(uri: Column) -> Column:
    return F.regexp_replace(uri, f"(?i)([?&](?:{'|'.join(SECRET_PARAMETERS)})=)[^&#]*", "$1***")


def is_throttle_page(status: Column, body: Column, markers: tuple[str, ...] = ("request rate threshold", "undeclared automated tool")) -> Column:
    """A refusal page that looks like content: status 403, short, and one of the markers."""
    low = F.lower(body)
    hit = F.lit(False)
    for m in markers:
        hit = hit | low.contains(m)
    return (status == 403) & (F.octet_length(body) <= 32_768) & hit


def months_between_days(days: Column) -> Column:
    return F.greatest(F.lit(1), F.round(days / 30.44).cast("int"))


def period_label(start: Column, end: Column) -> Column:
    span = F.concat(start.cast("string"), F.lit(" to "), end.cast("string"), F.lit(" ("), F.datediff(end, start).cast("string"), F.lit("d)"))
    return F.when(start.isNull(), F.concat(F.lit("instant, "), end.cast("string"))).otherwise(span)


def month_ends(first: Column, last: Column) -> Column:
    return F.transform(F.sequence(F.trunc(first, "month"), F.trunc(last, "month"), F.expr("interval 1 month")), F.last_day)


def relative_change(first: Column, latest: Column) -> Column:
    """|latest - first| over the larger magnitude, in double, 0..2; null where both are zero."""
    a, b = first.cast("double"), latest.cast("double")
    return F.try_divide(F.abs(b - a), F.nullif(F.greatest(F.abs(a), F.abs(b)), F.lit(0.0)))


def unit_class(unit: Column) -> Column:
    """Which units a stock split rewrites."""
    return F.when(unit.like("%/shares%"), "per-share").when(unit == "shares", "share count").otherwise("other")


def sic_group(sic: Column) -> Column:
    return F.when(sic.rlike(r"^\d{2}"), F.substring(sic, 1, 2).cast("int"))


def is_financial(sic: Column) -> Column:
    return F.coalesce(sic_group(sic).between(60, 67), F.lit(False))


def is_utility(sic: Column) -> Column:
    return F.coalesce(F.when(sic.rlike(r"^\d{4}$"), sic.cast("int")).between(4900, 4949), F.lit(False))
