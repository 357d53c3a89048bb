"""Checks that give violations as rows (Q1, Q2)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dealing import dealt


@dataclass(frozen=True)
class Unique:
    """No two rows of those that fit `where` have the same keys; a null key is like no other."""

    name: str
    keys: tuple[str, ...]
    where: str = "true"


@dataclass(frozen=True)
class Check:
    """Each row, named by key, fits a condition; one that is null counts as kept."""

    name: str
    key: str
    holds: str


_ONE_TARGET = "int(county_id is not null) + int(place_id is not null) + int(postal_id is not null) = 1"
_ONLY = {"COUNTY": "county_id", "PLACE": "place_id", "POSTAL_AREA": "postal_id"}

#: Q1: what each table keeps.
CONSTRAINTS: dict[str, list[Unique | Check]] = {
    "batches": [Unique("one completed batch for a file", ("file_hash",), "status = 'COMPLETED'")],
    "raw_rows": [Unique("one row for a place in a batch", ("import_batch_id", "row_number"))],
    "entities": [
        Check("unverified has no method", "entity_id", "verification_status <> 'UNVERIFIED' or coalesce(verification_method, 'NONE') = 'NONE'"),
        Check("verified has a method", "entity_id", "verification_status <> 'VERIFIED' or coalesce(verification_method, 'NONE') <> 'NONE'"),
        Check("verified has a time", "entity_id", "verification_status <> 'VERIFIED' or verified_at is not null"),
        Check("admin review has an actor", "entity_id", "verification_method <> 'ADMIN_REVIEW' or verified_by is not null"),
        Check("is_verified is in step", "entity_id", "(is_verified and verification_status = 'VERIFIED') or (not is_verified and verification_status = 'UNVERIFIED')"),
    ],
    "assignments": [Unique("one active assignment", ("contribution_id",), "is_active")],
    "assessments": [Unique("one current assessment", ("entity_id",), "is_current")],
    "patterns": [Unique("one pattern for a cluster", ("cluster_id",))],
    "amendments": [
        Check("amendment is not of itself", "amendment_id", "original_contribution_id <> replacement_contribution_id"),
        Unique("one amendment for a pair", ("original_contribution_id", "replacement_contribution_id")),
    ],
    "geography_files": [Unique("one batch for a geography file", ("file_hash",))],
    "identifiers": [Check("identifier has one target", "identifier_id", _ONE_TARGET)],
    "aliases": [Check("alias has one target", "alias_id", _ONE_TARGET)],
    **{
        name: [Unique(f"one active {name[:-1]}", (*keys, "dataset_id"), "is_active"), Check(f"weight of a {name[:-1]} is a share", "association_id", "weight is null or weight between 0 and 1")]
        for name, keys in {"place_counties": ("place_id", "county_id"), "postal_counties": ("postal_id", "county_id"), "postal_places": ("postal_id", "place_id")}.items()
    },
    "resolution_runs": [Unique("one pending run for a scope", ("dataset_id", "scope"), "status = 'PENDING'")],
    "resolutions": [Unique("one current resolution", ("location_id",), "status = 'CURRENT'")],
    "rule_sets": [Unique("one rule set for a version", ("chapter_id", "version")), Unique("one active rule set", ("chapter_id",), "status = 'ACTIVE'")],
    "rules": [
        Check("rule has one target", "rule_id", _ONE_TARGET),
        *[Check(f"{kind} rule has that target", "rule_id", f"target_type <> '{kind}' or ({column} is not null and {_ONE_TARGET})") for kind, column in _ONLY.items()],
        *[Unique(f"one active {kind} rule", ("rule_set_id", "effect", column), f"is_active and target_type = '{kind}'") for kind, column in _ONLY.items()],
    ],
    "overrides": [
        Check("override ends after its start", "override_id", "expiration_date is null or expiration_date >= effective_date"),
        Unique("one active override", ("chapter_id", "entity_id"), "status = 'ACTIVE'"),
    ],
    "results": [Unique("one result for a run", ("run_id", "entity_id"))],
    "chapter_assignments": [Unique("one assignment for a run", ("run_id", "entity_id"))],
}


def _claims(rows: DataFrame, constraints: Sequence[Unique | Check], first: int) -> DataFrame:
    """(_c, key): each row says which keys it claims and which checks it breaks; constraints are numbered from first."""
    told = []
    for i, c in enumerate(constraints, first):
        if isinstance(c, Unique):
            hit = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in c.keys]) & F.expr(c.where)
            key = F.concat_ws(":", *[F.col(k).cast("string") for k in c.keys])
        else:
            hit, key = ~F.expr(c.holds), F.col(c.key).cast("string")
        told.append(F.when(hit, F.struct(F.lit(i).alias("_c"), key.alias("key"))))
    return rows.select(F.explode(F.array_compact(F.array(*told))).alias("x")).select("x._c", "x.key")


def _violations(tables: Sequence[tuple[DataFrame, Sequence[Unique | Check]]]) -> DataFrame:
    """Q1: (check, key, n), from one scan of each table and one shuffle and aggregation of all their claims.

    A key that is claimed more than once is a violation. Nearly all claims are unlike, so that adding them up before the
    shuffle would only hold a scan's share of rows in memory; they are dealt first, and a task adds up its own.
    """
    every, claims = [], []
    for rows, constraints in tables:
        claims.append(_claims(rows, constraints, len(every)))
        every += constraints
    union = reduce(DataFrame.unionByName, claims)
    counts = dealt(union, "_c", "key").groupBy("_c", "key").agg(F.count("*").alias("n"))
    broken = [i for i, c in enumerate(every) if isinstance(c, Check)]
    names = F.array(*[F.lit(c.name) for c in every])
    return counts.where((F.col("n") > 1) | F.col("_c").isin(broken)).select(F.get(names, F.col("_c")).alias("check"), "key", "n")


def violations_of(rows: DataFrame, constraints: Sequence[Unique | Check]) -> DataFrame:
    """Q1: (check, key, n) of all constraints of a table."""
    return _violations([(rows, constraints)])


def check_invariants(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Q1: the constraints of the data model, for the tables that are given."""
    return _violations([(df, CONSTRAINTS[name]) for name, df in tables.items()])


def references(name: str, rows: DataFrame, column: str, target: DataFrame, key: str) -> DataFrame:
    """Q2: values of a column without a row in the target. Equal values are counted before they meet the target."""
    counts = rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    missing = counts.join(target.select(F.col(key).alias(column)).distinct(), column, "left_anti")
    return missing.select(F.lit(name).alias("check"), F.col(column).cast("string").alias("key"), "n")


def violations(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


@dataclass(frozen=True)
class Hop:
    """A step of a chain: the column that the rows have so far, the table, its key, and columns to go on with."""

    name: str
    column: str
    table: DataFrame
    key: str
    carry: Sequence[str] = field(default_factory=tuple)


def trace(chain: str, rows: DataFrame, hops: Sequence[Hop]) -> DataFrame:
    """Q2: (chain, place, hop, reached, missing) of a chain of references that starts at rows.

    A row is missing at the first hop whose table lacks its key (or where it has none), and is not followed further. A
    table with several rows of a key goes on with the smallest of what it carries, so that no row is counted twice. Rows
    are folded to their different keys first: from then on a key that a third of all rows have is one row.
    """
    first = hops[0].column
    now = rows.groupBy(F.col(first).alias("_k0")).agg(F.count("*").alias("_n"))
    for i, hop in enumerate(hops):
        rest = [c for c in hop.carry]
        one = hop.table.where(F.col(hop.key).isNotNull()).groupBy(F.col(hop.key).alias(f"_k{i}")).agg(
            F.lit(True).alias(f"_there{i}"), *([F.min(F.struct(*rest)).alias("_c")] if rest else [])
        )
        now = now.join(one, f"_k{i}", "left")
        there = F.coalesce(f"_there{i}", F.lit(False))
        flag = there if i == 0 else there & F.col(f"_ok{i - 1}")
        now = now.withColumn(f"_ok{i}", flag)
        keep = [c for c in now.columns if c.startswith("_ok")]
        nxt = [F.col(f"_c.{hops[i + 1].column}").alias(f"_k{i + 1}")] if i + 1 < len(hops) else []
        # what is left of a row is its next key and how far it came
        now = now.groupBy(*keep, *nxt).agg(F.sum("_n").alias("_n"))
    told = []
    for i, hop in enumerate(hops):
        came = F.col(f"_ok{i - 1}") if i else F.lit(True)
        told.append((F.lit(i + 1).alias("place"), F.lit(hop.name).alias("hop"), F.sum(F.when(F.col(f"_ok{i}"), F.col("_n")).otherwise(0)).alias("reached"), F.sum(F.when(came & ~F.col(f"_ok{i}"), F.col("_n")).otherwise(0)).alias("missing")))
    one = now.agg(F.array(*[F.struct(*t) for t in told]).alias("_x"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return one.select(F.inline("_x")).select(F.lit(chain).alias("chain"), "place", "hop", zero("reached"), zero("missing"))
