"""Queries of checks: constraints of the data model and chains of references, over tables with broken rows."""

from __future__ import annotations

from ..operators import quality
from .adapters import VIEWS
from .queries import query

#: Which view stands for a table of the model.
CHECKED = {
    "batches": "batches", "raw_rows": "raw_rows", "entities": "entities", "assignments": "assignments", "assessments": "assessments", "amendments": "amendments", "geography_files": "weighted",
    "identifiers": "targets", "aliases": "targets", "place_counties": "weighted", "postal_counties": "weighted", "postal_places": "weighted", "resolution_runs": "geo_runs", "resolutions": "placed",
    "rule_sets": "rule_sets", "rules": "chapter_rules", "overrides": "dated_overrides", "results": "run_results", "chapter_assignments": "run_results", "patterns": "payments",
}
_USED = tuple(dict.fromkeys(CHECKED.values()))
assert set(_USED) <= set(VIEWS)


def _sql(table: str, c: quality.Unique | quality.Check) -> str:
    rows = CHECKED[table]
    if isinstance(c, quality.Check):
        return f"""select '{c.name}' as "check", cast({c.key} as varchar) as key, count(*) as n from {rows} where not ({c.holds}) group by {c.key}"""
    key = " || ':' || ".join(f"cast({k} as varchar)" for k in c.keys)
    there = " and ".join(f"{k} is not null" for k in c.keys)
    return f"""select '{c.name}' as "check", {key} as key, count(*) as n from {rows} where ({c.where}) and {there} group by {", ".join(c.keys)} having count(*) > 1"""


@query(*_USED, oracle=" union all ".join(_sql(t, c) for t in CHECKED for c in quality.CONSTRAINTS[t]).replace("int(county_id is not null)", "cast(county_id is not null as int)").replace("int(place_id is not null)", "cast(place_id is not null as int)").replace("int(postal_id is not null)", "cast(postal_id is not null as int)"))
def quality_invariants(*tables):
    """Q1: all constraints; each has rows that break it."""
    given = dict(zip(_USED, tables, strict=True))
    return quality.check_invariants({t: given[v] for t, v in CHECKED.items()})


@query(
    "assignments",
    "entities",
    "amendments",
    "payments",
    oracle="""select 'assignment -> cluster' as "check", cast(cluster_id as varchar) as key, count(*) as n from assignments where cluster_id not in (select cluster_id from entities) group by cluster_id
     union all select 'amendment -> contribution', cast(replacement_contribution_id as varchar), count(*) from amendments where replacement_contribution_id not in (select contribution_id from payments) group by replacement_contribution_id""",
)
def quality_provenance(assignments, entities, amendments, payments):
    """Q2."""
    return quality.violations(
        quality.references("assignment -> cluster", assignments, "cluster_id", entities, "cluster_id"),
        quality.references("amendment -> contribution", amendments, "replacement_contribution_id", payments, "contribution_id"),
    )


def _hops(chain: str, rows: str, hops: list[tuple[str, str]]) -> str:
    """SQL of a chain: of each hop its name and the condition under which a row of `rows` has passed it."""
    out = []
    for i, (name, _) in enumerate(hops):
        before = " and ".join(f"({c})" for _, c in hops[:i]) or "true"
        out.append(f"select '{chain}' as chain, {i + 1} as place, '{name}' as hop, count(*) filter ({before} and ({hops[i][1]})) as reached, count(*) filter ({before} and not ({hops[i][1]})) as missing from {rows}")
    return " union all ".join(out)


TRACED = ("payments", "raw_rows", "batches", "assignments", "entities", "stored_assessments", "rule_versions", "placed", "locations", "run_results", "chapter_runs", "rule_sets", "chapter_rules", "audit_events")
_TRACES = " union all ".join(
    [
        _hops("import", "(select p.contribution_id, p.contribution_id in (select row_number from raw_rows where row_number % 50 <> 0) as a, p.contribution_id % 7 in (select import_batch_id from batches where import_batch_id <> 3) as b from payments p) as x", [("contribution -> raw row", "a"), ("raw row -> batch", "b")]),
        _hops("clustering", "(select p.contribution_id in (select contribution_id from assignments where is_active) as a, p.cluster_id in (select cluster_id from entities where cluster_id % 30 <> 4) as b, p.cluster_id in (select entity_id from entities where entity_id % 70 <> 9) as c from payments p) as x", [("contribution -> assignment", "a"), ("assignment -> cluster", "b"), ("cluster -> entity", "c")]),
        _hops("membership", "(select coalesce(rule_version_id in (select rule_version_id from rule_versions where rule_version_id <> 11), false) as a from stored_assessments) as x", [("assessment -> rule", "a")]),
        _hops("geography", "(select location_id in (select location_id from locations) as a, location_id in (select c_custkey from customer where c_custkey % 60 <> 2) as b from placed) as x", [("resolution -> location", "a"), ("location -> cluster", "b")]),
        _hops("county", "(select coalesce(county_id in (select n_nationkey from nation), false) as a from placed) as x", [("resolution -> county", "a")]),
        _hops("chapter", "(select r.run_id in (select run_id from chapter_runs) as a, coalesce(c.rule_set_id in (select rule_set_id from rule_sets where rule_set_id <> 5), false) as b from run_results r left join chapter_runs c on c.run_id = r.run_id) as x", [("result -> run", "a"), ("run -> rule set", "b")]),
        _hops("rule match", "(select r.rule_id in (select rule_id from chapter_rules) as a, coalesce(c.rule_set_id in (select rule_set_id from rule_sets where rule_set_id <> 5), false) as b from run_results r left join chapter_rules c on c.rule_id = r.rule_id) as x", [("result -> rule", "a"), ("rule -> rule set", "b")]),
    ]
)


@query(*TRACED, oracle=_TRACES)
def quality_traces(payments, raw_rows, batches, assignments, entities, assessments, rules, placed, locations, results, runs, rule_sets, chapter_rules, events):
    """Q2: chains of references hop by hop; each hop's table lacks some rows."""
    H = quality.Hop
    raw = raw_rows.where("row_number % 50 <> 0").selectExpr("row_number", "row_number % 7 as batch")
    held = entities.where("cluster_id % 30 <> 4")
    return quality.violations(
        quality.trace("import", payments, [H("contribution -> raw row", "contribution_id", raw, "row_number", ["batch"]), H("raw row -> batch", "batch", batches.where("import_batch_id <> 3"), "import_batch_id")]),
        quality.trace(
            "clustering", payments,
            [
                H("contribution -> assignment", "contribution_id", assignments.where("is_active"), "contribution_id", ["cluster_id"]),
                H("assignment -> cluster", "cluster_id", held, "cluster_id", ["entity_id"]), H("cluster -> entity", "entity_id", entities.where("entity_id % 70 <> 9"), "entity_id"),
            ],
        ),
        quality.trace("membership", assessments, [H("assessment -> rule", "rule_version_id", rules.where("rule_version_id <> 11"), "rule_version_id")]),
        quality.trace("geography", placed, [H("resolution -> location", "location_id", locations, "location_id", ["location_id"]), H("location -> cluster", "location_id", entities.where("cluster_id % 60 <> 2"), "cluster_id")]),
        quality.trace("county", placed, [H("resolution -> county", "county_id", entities.sparkSession.range(25), "id")]),
        quality.trace("chapter", results, [H("result -> run", "run_id", runs, "run_id", ["rule_set_id"]), H("run -> rule set", "rule_set_id", rule_sets.where("rule_set_id <> 5"), "rule_set_id")]),
        quality.trace("rule match", results, [H("result -> rule", "rule_id", chapter_rules, "rule_id", ["rule_set_id"]), H("rule -> rule set", "rule_set_id", rule_sets.where("rule_set_id <> 5"), "rule_set_id")]),
    )
