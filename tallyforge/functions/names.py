"""Names as column expressions: entity type and normalised parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and word lists that decide the entity type and are stripped from names.
JOINT_PATTERN = r"\bAND\b|&|\bOR\b|/"
ORGANIZATION_WORDS = [
    "UNION", "PAC", "COMMITTEE", "LLC", "INC", "CORP", "ASSOCIATION", "TRUST", "LOCAL", "CLUB", "COUNCIL", "PARTY", "FUND", "CAMPAIGN",
    "FRIENDS OF", "TO ELECT", "ELECT", "CO", "FOUNDATION", "BOARD",
]
TITLES = ["MR", "MRS", "MS", "DR", "PROF", "HON"]
SUFFIXES = ["JR", "SR", "III", "IV", "II", "MD", "PHD", "DDS"]


def entity_type(name: Column) -> Column:
    """JOINT, ORGANIZATION or INDIVIDUAL; joint wins. Null or blank is UNKNOWN."""
    upper = F.upper(name)
    words = "|".join(rf"\b{w}\b" for w in ORGANIZATION_WORDS)
    return (
        F.when(name.isNull() | (F.trim(name) == ""), "UNKNOWN")
        .when(upper.rlike(f"(?U){JOINT_PATTERN}"), "JOINT")
        .when(upper.rlike(f"(?U){words}"), "ORGANIZATION")
        .otherwise("INDIVIDUAL")
    )


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _lead(tokens: Column, words: list[str]) -> Column:
    """How many tokens at the start begin with one of the words."""
    other = F.array_position(F.transform(tokens, lambda t: ~t.rlike(f"(?U)^(?:{'|'.join(words)})\\b")), True)
    return F.coalesce(F.nullif(other, F.lit(0)) - 1, F.size(tokens)).cast("int")


def _strip(text: Column) -> Column:
    """Struct of tokens without leading titles and trailing suffixes, and the leftmost suffix stripped."""
    tokens = F.filter(F.split(text, r"(?U)\s+"), lambda t: t != "")
    rest = _let(tokens, lambda ts: F.slice(ts, _lead(ts, TITLES) + 1, F.size(ts)))
    with_trail = _let(rest, lambda r: F.struct(r.alias("rest"), _lead(F.reverse(r), SUFFIXES).alias("trail")))
    return _let(
        with_trail,
        lambda x: F.struct(
            F.slice(x["rest"], F.lit(1), F.size(x["rest"]) - x["trail"]).alias("tokens"),
            F.when(x["trail"] > 0, F.get(x["rest"], F.size(x["rest"]) - x["trail"])).otherwise("").alias("suffix"),
        ),
    )


def _individual(upper: Column) -> Column:
    clean = F.regexp_replace(upper, r"(?U)[^\w\s\-',]", "")

    def parted(c: Column) -> Column:
        """LAST, FIRST: both sides are stripped, and the suffix of the first names comes first."""
        sides = F.struct(_strip(F.substr(c, F.instr(c, ",") + 1)).alias("first"), _strip(F.substring_index(c, ",", 1)).alias("last"))
        return _let(
            sides,
            lambda x: F.struct(
                F.concat(x["first"]["tokens"], x["last"]["tokens"]).alias("tokens"),
                F.when(x["first"]["suffix"] != "", x["first"]["suffix"]).otherwise(x["last"]["suffix"]).alias("suffix"),
            ),
        )

    def named(x: Column) -> Column:
        tokens, n = x["tokens"], F.size(x["tokens"])
        return F.struct(
            F.array_join(tokens, " ").alias("full"),
            F.when(n >= 2, F.get(tokens, F.lit(0))).otherwise("").alias("first"),
            F.when(n >= 3, F.array_join(F.slice(tokens, F.lit(2), F.greatest(n - 2, F.lit(0))), " ")).otherwise("").alias("middle"),
            F.when(n >= 1, F.get(tokens, n - 1)).otherwise("").alias("last"),
            x["suffix"].alias("suffix"),
        )

    return _let(_let(clean, lambda c: F.when(F.instr(c, ",") > 0, parted(c)).otherwise(_strip(c))), named)


def normalize_name(name: Column) -> Column:
    """Struct of full, first, middle, last and suffix; organisations and joint names keep their words.

    Each step is bound once, so that no part of the expression is computed again for every field."""
    text = F.coalesce(name, F.lit(""))
    blank = F.lit("")

    def of(u: Column) -> Column:
        whole = F.struct(F.trim(F.regexp_replace(u, r"(?U)\s+", " ")).alias("full"), *(blank.alias(f) for f in ("first", "middle", "last", "suffix")))
        return F.when(entity_type(u).isin("ORGANIZATION", "JOINT"), whole).otherwise(_individual(u))

    return _let(F.upper(text), of)
