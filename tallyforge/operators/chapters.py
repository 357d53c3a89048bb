"""Chapters: rules, overrides, results and overlaps."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Result of an evaluation -> status of the assignment.
ASSIGNMENT = {
    "INCLUDED_BY_RULE": "INCLUDED", "MANUALLY_INCLUDED": "INCLUDED", "PROVISIONAL_GEOGRAPHIC_MATCH": "PROVISIONALLY_INCLUDED", "EXCLUDED_BY_RULE": "EXCLUDED",
    "MANUALLY_EXCLUDED": "EXCLUDED", "AMBIGUOUS_GEOGRAPHY": "AMBIGUOUS", "AMBIGUOUS_LOCATION": "AMBIGUOUS", "NO_CURRENT_LOCATION": "UNRESOLVED",
    "NO_CURRENT_RESOLVED_LOCATION": "UNRESOLVED", "INELIGIBLE_ENTITY_TYPE": "INELIGIBLE",
}


#: Chapters that are sent to all tasks at most; each entity gets a result for each chapter, so that there are few.
MOST_CHAPTERS = 10_000


def every_chapter(rows: DataFrame) -> DataFrame:
    """(chapter_id) of rows, to be put beside all entities; sent to all tasks only where their number is within the bound,
    which is looked at."""
    chapters = rows.select("chapter_id").distinct()
    return F.broadcast(chapters) if chapters.limit(MOST_CHAPTERS + 1).count() <= MOST_CHAPTERS else chapters


def match_rules(resolutions: DataFrame, rules: DataFrame) -> DataFrame:
    """Outcome and rule of every resolution in every chapter that has rules.

    resolutions: (location_id, entity_id, county_id, place_id, postal_id, postal_type, match_method); rules: active rows
    (chapter_id, rule_id, effect, target_type, target_id, postal_type). The rule with the first place in the order of
    effect (exclude, include) and target (postal, place, county) decides.
    """
    targets = F.explode(
        F.array(
            F.struct(F.lit("POSTAL").alias("target_type"), F.col("postal_id").alias("target_id"), F.col("postal_type").alias("postal_type")),
            F.struct(F.lit("PLACE").alias("target_type"), F.col("place_id").alias("target_id"), F.lit("").alias("postal_type")),
            F.struct(F.lit("COUNTY").alias("target_type"), F.col("county_id").alias("target_id"), F.lit("").alias("postal_type")),
        )
    )
    r = rules.withColumn("postal_type", F.when(F.col("target_type") == "POSTAL", F.col("postal_type")).otherwise(""))
    place = F.when(F.col("effect") == "EXCLUDE", 0).otherwise(3) + F.when(F.col("target_type") == "POSTAL", 0).when(F.col("target_type") == "PLACE", 1).otherwise(2)
    r = r.groupBy("chapter_id", "effect", "target_type", "target_id", "postal_type").agg(F.max("rule_id").alias("rule_id")).withColumn("_order", place)
    hits = resolutions.select("location_id", targets.alias("t")).select("location_id", "t.*").where("target_id is not null").join(r, ["target_type", "target_id", "postal_type"])
    best = hits.groupBy("location_id", "chapter_id").agg(F.min(F.struct("_order", "rule_id", "effect")).alias("_b"))
    rows = resolutions.crossJoin(every_chapter(rules)).join(best, ["location_id", "chapter_id"], "left")
    outcome = (
        F.when(F.col("_b.effect") == "EXCLUDE", "EXCLUDED_BY_RULE")
        .when(F.col("_b.effect") == "INCLUDE", "INCLUDED_BY_RULE")
        .when(F.col("match_method").contains("AMBIGUOUS"), "AMBIGUOUS_GEOGRAPHY")
        .otherwise("NO_RULE_MATCH")
    )
    return rows.select("chapter_id", "location_id", "entity_id", "match_method", outcome.alias("outcome"), F.col("_b.rule_id").alias("rule_id"))


def select_location(matched: DataFrame) -> DataFrame:
    """For each chapter and entity with a location that has a current resolution: the selection and, if all of them
    agree on outcome and rule, the location with the lowest id, outcome and rule; and the different outcomes."""
    verdict = F.struct(F.col("outcome"), F.coalesce("rule_id", F.lit(-1)).alias("rule_id"))
    rows = matched.groupBy("chapter_id", "entity_id").agg(F.count("*").alias("_n"), F.collect_set(verdict).alias("_v"), F.min("location_id").alias("location_id"))
    agree = F.size("_v") == 1  # a chapter's rules bound the set
    status = F.when(~agree, "AMBIGUOUS_LOCATION").when(F.col("_n") == 1, "SELECTED").otherwise("MULTIPLE_EQUIVALENT")
    one = F.get("_v", F.lit(0))
    return rows.select(
        "chapter_id", "entity_id", status.alias("selection_status"), F.when(agree, F.col("location_id")).alias("location_id"),
        F.when(agree, one["outcome"]).alias("outcome"), F.when(agree & (one["rule_id"] >= 0), one["rule_id"]).alias("rule_id"), F.array_sort("_v").alias("outcomes"),
    )


def active_overrides(overrides: DataFrame, day: date) -> DataFrame:
    """Overrides with those that ended before the day expired."""
    over = (F.col("status") == "ACTIVE") & (F.col("expiration_date") < F.lit(day))
    return overrides.withColumn("status", F.when(over, "EXPIRED").otherwise(F.col("status")))


def evaluate_chapters(entities: DataFrame, matched: DataFrame, overrides: DataFrame, locations: DataFrame, chapters: DataFrame) -> DataFrame:
    """C4: one result for each chapter and entity (entity_id, entity_type, verification_status), with what explains it.

    matched: of match_rules(), one row for each current resolution; locations: (entity_id) of current locations."""
    chosen = select_location(matched)
    reason = F.col("reason") if "reason" in overrides.columns else F.lit("")
    manual = overrides.where("status = 'ACTIVE'").groupBy("chapter_id", "entity_id").agg(F.max(F.struct("override_type", reason.alias("reason"))).alias("_o"))
    rows = entities.crossJoin(every_chapter(chapters))
    rows = rows.join(chosen, ["chapter_id", "entity_id"], "left").join(manual, ["chapter_id", "entity_id"], "left")
    rows = rows.join(locations.select("entity_id").distinct().withColumn("_placed", F.lit(True)), "entity_id", "left").withColumn("override_type", F.col("_o.override_type"))
    none = F.when(F.col("_placed"), "NO_CURRENT_RESOLVED_LOCATION").otherwise("NO_CURRENT_LOCATION")
    sel = F.when(F.col("entity_type") != "INDIVIDUAL", "INELIGIBLE_ENTITY_TYPE").otherwise(F.coalesce("selection_status", none))
    result = (
        F.when(F.col("entity_type") != "INDIVIDUAL", "INELIGIBLE_ENTITY_TYPE")
        .when(F.col("override_type") == "EXCLUDE", "MANUALLY_EXCLUDED")
        .when(F.col("override_type") == "INCLUDE", "MANUALLY_INCLUDED")
        .when(sel.isin("AMBIGUOUS_LOCATION", "NO_CURRENT_LOCATION", "NO_CURRENT_RESOLVED_LOCATION"), sel)
        .when((F.col("outcome") == "INCLUDED_BY_RULE") & (F.col("verification_status") != "VERIFIED"), "PROVISIONAL_GEOGRAPHIC_MATCH")
        .otherwise(F.col("outcome"))
    )
    names = F.create_map(*[x for kv in ASSIGNMENT.items() for x in map(F.lit, kv)])
    decisive = F.col("result_status").isin("INCLUDED_BY_RULE", "EXCLUDED_BY_RULE", "PROVISIONAL_GEOGRAPHIC_MATCH")
    high = F.col("result_status").isin("INELIGIBLE_ENTITY_TYPE", "MANUALLY_EXCLUDED", "MANUALLY_INCLUDED", "INCLUDED_BY_RULE", "EXCLUDED_BY_RULE")
    return rows.withColumn("result_status", result).select(
        "chapter_id", "entity_id", sel.alias("selection_status"), "result_status", F.coalesce(names[F.col("result_status")], F.lit("NO_MATCH")).alias("assignment_status"),
        F.when(high, "HIGH").when(F.col("result_status") == "PROVISIONAL_GEOGRAPHIC_MATCH", "MEDIUM").otherwise("LOW").alias("confidence"),
        F.when(decisive, F.col("rule_id")).alias("rule_id"),
        F.struct("entity_type", "location_id", "outcome", "outcomes", F.col("_o.reason").alias("reason")).alias("evidence"),
    )


def explain_results(results: DataFrame) -> DataFrame:
    """Results with selection_explanation and explanation, from their evidence, which goes."""
    e, sel, res, rule = F.col("evidence"), F.col("selection_status"), F.col("result_status"), F.col("rule_id").cast("string")
    each = F.transform(e["outcomes"], lambda o: F.concat(F.lit("('"), o["outcome"], F.lit("', "), F.when(o["rule_id"] < 0, "None").otherwise(o["rule_id"].cast("string")), F.lit(")")))
    selection = (
        F.when(sel == "INELIGIBLE_ENTITY_TYPE", F.format_string("Entity type '%s' is ineligible for chapter membership.", e["entity_type"]))
        .when(sel == "NO_CURRENT_LOCATION", "Entity has no registered current locations.")
        .when(sel == "NO_CURRENT_RESOLVED_LOCATION", "None of the entity's current locations have current resolutions.")
        .when(sel == "AMBIGUOUS_LOCATION", F.concat(F.lit("Conflicting location outcomes detected: ["), F.array_join(each, ", "), F.lit("]")))
        .otherwise(F.format_string("Selected location %s yielding outcome %s.", e["location_id"].cast("string"), e["outcome"]))
    )
    text = (
        F.when(res == "INELIGIBLE_ENTITY_TYPE", "Ineligible entity type.")
        .when(res == "MANUALLY_EXCLUDED", F.concat(F.lit("Excluded by manual override. Reason: "), F.coalesce(e["reason"], F.lit(""))))
        .when(res == "MANUALLY_INCLUDED", F.concat(F.lit("Included by manual override. Reason: "), F.coalesce(e["reason"], F.lit(""))))
        .when(res == "AMBIGUOUS_LOCATION", "Geographic evaluation is ambiguous due to conflicting current locations.")
        .when(res.isin("NO_CURRENT_LOCATION", "NO_CURRENT_RESOLVED_LOCATION"), F.col("selection_explanation"))
        .when(res == "EXCLUDED_BY_RULE", F.format_string("Excluded by rule %s.", rule))
        .when(res.isin("INCLUDED_BY_RULE", "PROVISIONAL_GEOGRAPHIC_MATCH"), F.format_string("Included by rule %s.", rule))
        .when(res == "AMBIGUOUS_GEOGRAPHY", "Matched zip reference has ambiguous outcomes or candidates.")
        .otherwise("No matching rules found in active ruleset.")
    )
    return results.withColumn("selection_explanation", selection).withColumn("explanation", text).drop("evidence")


def membership_snapshot(results: DataFrame, latest: DataFrame) -> DataFrame:
    """C5."""
    return results.join(latest.select("entity_id", F.col("calculated_status").alias("membership_status"), "calculation_date"), "entity_id", "left")


def rule_matches(results: DataFrame) -> DataFrame:
    """Results that a rule decided."""
    return results.where("rule_id is not null").select("chapter_id", "entity_id", "rule_id")


def run_counts(results: DataFrame) -> DataFrame:
    """C7."""
    s = F.col("assignment_status")
    return results.groupBy("chapter_id").agg(
        F.count("*").alias("considered"), F.count_if(s.isin("INCLUDED", "PROVISIONALLY_INCLUDED")).alias("included"), F.count_if(s == "EXCLUDED").alias("excluded"),
        F.count_if(s == "AMBIGUOUS").alias("ambiguous"), F.count_if(s.isin("UNRESOLVED", "INELIGIBLE", "NO_MATCH")).alias("unresolved"),
    )


def promote_runs(pointers: DataFrame, runs: DataFrame) -> DataFrame:
    """The current run of each chapter: the last completed one to apply whose rule set is active, else what it was."""
    good = runs.where("status = 'COMPLETED' and run_type = 'APPLY' and ruleset_status = 'ACTIVE'").groupBy("chapter_id").agg(F.max("run_id").alias("_new"))
    return pointers.join(good, "chapter_id", "full_outer").select("chapter_id", F.coalesce("_new", "current_run_id").alias("current_run_id"))


def rebuild_assignments(results: DataFrame, existing: DataFrame) -> DataFrame:
    """(chapter_id, entity_id, assignment_status, change)."""
    old = existing.select("chapter_id", "entity_id", F.col("assignment_status").alias("_old"))
    change = F.when(F.col("_old").isNull(), "CREATED").when(F.col("_old") == F.col("assignment_status"), "IDENTICAL").otherwise("UPDATED")
    return results.join(old, ["chapter_id", "entity_id"], "left").select("chapter_id", "entity_id", "assignment_status", change.alias("change"))


def rebuild_counts(rebuilt: DataFrame) -> DataFrame:
    """One row of counts of what rebuild_assignments() finds."""
    change = F.col("change")
    return rebuilt.agg(F.count_if(change == "CREATED").alias("created"), F.count_if(change == "UPDATED").alias("updated"), F.count_if(change == "IDENTICAL").alias("identical"))


# Results that a preview counts as one thing.
PREVIEWED = {
    "included": ["INCLUDED_BY_RULE", "MANUALLY_INCLUDED", "PROVISIONAL_GEOGRAPHIC_MATCH"],
    "excluded": ["EXCLUDED_BY_RULE", "MANUALLY_EXCLUDED"],
    "ambiguous": ["AMBIGUOUS_GEOGRAPHY", "AMBIGUOUS_LOCATION"],
    "unresolved": ["NO_CURRENT_LOCATION", "NO_CURRENT_RESOLVED_LOCATION", "NO_RULE_MATCH"],
}


def preview_diff(staged: DataFrame, current: DataFrame) -> DataFrame:
    """Whether each entity comes into or leaves one of four groups of results, and whether its rule differs. A side
    without a result is NO_MATCH, which is in no group, and has no rule to compare."""
    cols = lambda p: ["chapter_id", "entity_id", F.col("result_status").alias(f"{p}_status"), F.col("rule_id").alias(f"{p}_rule"), F.lit(True).alias(f"_{p}")]
    rows = staged.select(cols("new")).join(current.select(cols("old")), ["chapter_id", "entity_id"], "full_outer")
    rows = rows.withColumns({f"{p}_status": F.coalesce(f"{p}_status", F.lit("NO_MATCH")) for p in ("new", "old")})
    flags = {}
    for name, members in PREVIEWED.items():
        now, was = F.col("new_status").isin(members), F.col("old_status").isin(members)
        flags |= {f"new_{name}": now & ~was, f"removed_{name}": was & ~now}
    flags["rule_changed"] = F.col("_new").isNotNull() & F.col("_old").isNotNull() & ~F.col("new_rule").eqNullSafe(F.col("old_rule"))
    return rows.withColumns(flags).drop("_new", "_old")


INCLUDED = ["INCLUDED", "PROVISIONALLY_INCLUDED"]


def assignment_counts(assignments: DataFrame) -> DataFrame:
    """C11."""
    return assignments.groupBy("chapter_id", "assignment_status").agg(F.count("*").alias("n"))


def overlaps(assignments: DataFrame, chapters: DataFrame | None = None) -> DataFrame:
    """Entities in more than one chapter, with the sorted chapters; with a list (chapter_id, chapter_name,
    status) only of ACTIVE ones, with their names in the same order."""
    own = assignments.where(F.col("assignment_status").isin(INCLUDED))
    if chapters is None:
        kept = own.groupBy("entity_id").agg(F.array_sort(F.collect_set("chapter_id")).alias("chapter_ids"))
        return kept.where(F.size("chapter_ids") > 1)
    named = chapters.where("status = 'ACTIVE'").select("chapter_id", "chapter_name")
    kept = own.join(named, "chapter_id").groupBy("entity_id").agg(F.array_sort(F.collect_set(F.struct("chapter_id", "chapter_name"))).alias("_c"))
    return kept.where(F.size("_c") > 1).select("entity_id", F.col("_c.chapter_id").alias("chapter_ids"), F.col("_c.chapter_name").alias("chapter_names"))


def overlap_pairs(assignments: DataFrame, chapters: DataFrame | None = None) -> DataFrame:
    """Shared entities of each pair of chapters, from each entity's own few chapters; with a list only of ACTIVE
    ones, by name."""
    rows = overlaps(assignments, chapters)
    pairs = lambda ids: F.flatten(F.transform(ids, lambda a, i: F.transform(F.slice(ids, i + 2, F.size(ids)), lambda b: F.struct(a.alias("chapter_a"), b.alias("chapter_b")))))
    if chapters is None:
        return rows.select(F.explode(pairs(F.col("chapter_ids"))).alias("p")).groupBy("p.chapter_a", "p.chapter_b").agg(F.count("*").alias("shared"))
    both = F.arrays_zip(F.col("chapter_ids").alias("id"), F.col("chapter_names").alias("name"))
    counts = rows.select(F.explode(pairs(both)).alias("p")).groupBy("p").agg(F.count("*").alias("shared"))
    return counts.select(F.col("p.chapter_a.name").alias("chapter_1"), F.col("p.chapter_b.name").alias("chapter_2"), "shared")


def apply_overrides(overrides: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(all overrides, rejected decisions). Decisions need a reason, and an end not before the start; of a chapter
    and entity the newest active one (by decided_at, then override_id) stays so, older ones are superseded."""
    bad = (F.coalesce(F.trim("reason"), F.lit("")) == "") | (F.col("expiration_date") < F.col("effective_date"))
    bad = F.coalesce(bad, F.lit(False))
    both = overrides.unionByName(decisions.where(~bad).withColumn("status", F.lit("ACTIVE")), allowMissingColumns=True)
    newest = F.row_number().over(Window.partitionBy("chapter_id", "entity_id", "status").orderBy(F.desc("decided_at"), F.desc("override_id"))) == 1
    both = both.withColumn("_new", newest).withColumn("status", F.when((F.col("status") == "ACTIVE") & ~F.col("_new"), "SUPERSEDED").otherwise(F.col("status"))).drop("_new")
    return both, decisions.where(bad)


def revoke_overrides(overrides: DataFrame, revoked: DataFrame) -> DataFrame:
    """Active overrides of the given (chapter_id, entity_id) are revoked."""
    hit = overrides.join(revoked.select("chapter_id", "entity_id").distinct().withColumn("_hit", F.lit(True)), ["chapter_id", "entity_id"], "left")
    return hit.withColumn("status", F.when(F.col("_hit") & (F.col("status") == "ACTIVE"), "REVOKED").otherwise(F.col("status"))).select(overrides.columns)
