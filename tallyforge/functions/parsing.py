"""Cells as column expressions: amounts, dates, postal codes, weights, hashes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accepted date forms in order: (shape of the text, format).
DATE_FORMS = [
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{2}$", "M/d/yy"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
]


def row_hash(columns: Sequence[str]) -> Column:
    """SHA-256 of key:value pairs in key order; null cells are left out."""
    pairs = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}:"), F.col(c))) for c in sorted(columns)]
    return F.sha2(F.concat_ws("", *pairs), 256)


def parse_amount(text: Column) -> Column:
    """Decimal(12,2) of a text with $ and commas; null for anything else, NaN and infinity among it."""
    clean = F.trim(F.regexp_replace(text, r"[$,]", ""))
    number = F.when(clean.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), clean)
    return number.try_cast("decimal(38,10)").try_cast("decimal(12,2)")


def parse_date(text: Column) -> Column:
    """The first of DATE_FORMS that the text fits and that is a date. Years of two digits from 69 on are in 1900."""
    clean = F.trim(text)
    tries = []
    for shape, form in DATE_FORMS:
        day = F.try_to_timestamp(F.when(clean.rlike(shape), clean), F.lit(form)).cast("date")
        if form.endswith("/yy"):
            day = F.when(F.year(day) >= 2069, F.add_months(day, -1200)).otherwise(day)
        tries.append(day)
    return F.coalesce(*tries)


def pad_zip(zip_code: Column) -> Column:
    """Digits under five places get zeros in front; others stay."""
    return F.when(zip_code.rlike(r"^[0-9]{1,4}$"), F.lpad(zip_code, 5, "0")).otherwise(zip_code)


def raw_address(*parts: Column) -> Column:
    return F.concat_ws(", ", *[F.when(p != "", p) for p in parts])


def normalize_zip(zip_code: Column, pad: bool = False) -> Column:
    """Struct of zip5, zip4 and warning. Five digits, nine digits and ZIP+4 are known forms."""
    z = F.trim(zip_code)
    parts = F.split(z, "-")
    head = F.get(parts, F.lit(0))
    head = F.when(F.length(head) < 5, F.lpad(head, 5, "0")).otherwise(head)
    none = F.lit(None).cast("string")

    def out(zip5, zip4, warning):
        return F.struct(zip5.alias("zip5"), zip4.alias("zip4"), warning.alias("warning"))

    said = lambda before, after: F.concat(F.lit(before), z, F.lit(after))
    return (
        F.when(zip_code.isNull() | (zip_code == ""), out(none, none, F.lit("Missing ZIP value")))
        .when(z.contains("-") & head.rlike(r"^\d{5}$"), out(head, F.get(parts, F.lit(1)), none))
        .when(z.contains("-"), out(none, none, said("Malformed ZIP5 in ZIP+4: '", "'")))
        .when(z.rlike(r"^\d{4}$") & F.lit(pad), out(F.lpad(z, 5, "0"), none, said("ZIP '", "' padded to 5 digits")))
        .when(z.rlike(r"^\d{4}$"), out(none, none, said("ZIP '", "' has 4 digits (unauthorized padding)")))
        .when(z.rlike(r"^\d{1,3}$"), out(none, none, said("ZIP '", "' is too short and invalid")))
        .when(z.rlike(r"^\d{9}$"), out(F.substring(z, 1, 5), F.substring(z, 6, 4), none))
        .when(z.rlike(r"^\d{5}$"), out(z, none, none))
        .otherwise(out(z, none, said("Unrecognized postal format: '", "'")))
    )


def normalize_weight(value: Column, unit: Column) -> Column:
    """Struct of weight (a share as double), rule and error."""
    text = F.trim(value)
    number = F.trim(F.regexp_replace(text, "%", "")).try_cast("double")
    kind = F.upper(F.trim(F.coalesce(unit, F.lit("UNKNOWN"))))
    none, no_error = F.lit(None).cast("double"), F.lit(None).cast("string")

    def out(weight, rule, error=no_error):
        return F.struct(weight.alias("weight"), F.lit(rule).alias("rule"), error.alias("error"))

    return (
        F.when(value.isNull() | (text == ""), out(none, ""))
        .when(number.isNull(), out(none, "", F.concat(F.lit("Malformed weight value: "), value)))
        .when(text.contains("%") | (kind == "PERCENTAGE"), out(number / 100, "PERCENTAGE_TO_FRACTION"))
        .when(kind == "FRACTION", out(number, "DIRECT_FRACTION"))
        .when(kind == "COUNT", out(none, "COUNT_UNNORMALIZED"))
        .when((number >= 0) & (number <= 1), out(number, "ASSUMED_FRACTION"))
        .when((number > 1) & (number <= 100), out(number / 100, "ASSUMED_PERCENTAGE"))
        .otherwise(out(none, "OUT_OF_RANGE_UNNORMALIZED"))
    )


def safe_cell(text: Column) -> Column:
    """A cell that a spreadsheet would take for a formula gets an apostrophe in front."""
    return F.when(text.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), text)).otherwise(text)
