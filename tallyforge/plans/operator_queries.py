"""Registered queries of operators that no job of queries.py shows by itself, with SQL for comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names, parsing
from ..operators import chapters, geography, identity, ingest, membership, reports
from ..sources import scratch
from .queries import _GEO, _LATEST, _NAME, _RES, _RESULT, DAY, GEO, QUERIES, RESULT, SQL, _resolved, _results, query

__all__ = ["QUERIES", "SQL"]


def _in(values):
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


@query("raw_rows", oracle="select row_number, trim(name) as name, trim(amount_text) as amount_text, trim(txn) as txn, '' as filed_date from raw_rows")
def ingest_mapping(rows):
    """A file with headers of its own; what the profile does not map is empty."""
    file = rows.select("row_number", F.col("name").alias("Donor"), F.col("amount_text").alias("Gift"), F.col("date_text").alias("Day"), F.col("txn").alias("No."))
    mapping = {"NAME OF CONTRIBUTOR": "Donor", "AMOUNT": "Gift", "TRANSACTION DATE": "Day", "TRANSACTION ID": "No."}
    return ingest.apply_mapping_profile(file, mapping).select("row_number", "name", "amount_text", "txn", "filed_date")


@query(
    "payments",
    oracle="""select 'RawContribution' as source_type, cast(import_batch_id as varchar) || ':' || cast(contribution_id as varchar) as source_id, 'Contribution' as target_type,
     contribution_id as target_id from payments""",
)
def ingest_provenance(payments):
    """I17."""
    return ingest.provenance_links(payments.withColumn("row_number", F.col("contribution_id")))


def _people(rows):
    """Parsed rows, in clusters of equal names that have the id of their first row. Names are parsed once and kept: what
    follows reads the rows several times."""
    p = ingest.parse_rows(rows).withColumn("entity_type", names.entity_type(F.col("name")))
    p = p.select(F.col("row_number").alias("contribution_id"), "entity_type", "normalized_name", "person.first", "person.middle", "person.last", "person.suffix", "street", "city", "state", "zip", "transaction_date")
    p = scratch.keep(p, "people")
    return p, p.join(p.groupBy("normalized_name").agg(F.min("contribution_id").alias("cluster_id")), "normalized_name").select("contribution_id", "cluster_id")


@query(
    "raw_rows",
    oracle=f"""with {_NAME}, c as (select *, min(row_number) over (partition by normalized_name) as cluster_id from parsed)
     select cluster_id, entity_type, normalized_name as display_name, 'UNVERIFIED' as verification_status, case when entity_type = 'INDIVIDUAL' then first_name else '' end as first_name,
     case when entity_type = 'INDIVIDUAL' then middle_name else '' end as middle_name, case when entity_type = 'INDIVIDUAL' then last_name else '' end as last_name,
     case when entity_type = 'INDIVIDUAL' then suffix else '' end as suffix, case when entity_type <> 'INDIVIDUAL' then normalized_name end as legal_name from c where row_number = cluster_id""",
)
def identity_entities(rows):
    """R5."""
    people, clustered = _people(rows)
    return identity.derive_entities(clustered, people)


@query(
    "raw_rows",
    oracle=f"""with {_NAME} select row_number as location_id, min(row_number) over (partition by normalized_name) as cluster_id, street, city, state, zip, 'CURRENT' as status,
     case when street <> '' then 'STREET' else 'CITY_ZIP' end as precision, case when street <> '' then 'HIGH' else 'MEDIUM' end as confidence, transaction_date as effective_date from parsed""",
)
def identity_locations(rows):
    """R6."""
    people, clustered = _people(rows)
    return identity.derive_locations(people.join(clustered, "contribution_id"))


_REASON = """case when method not in ('ADMIN_REVIEW', 'EXTERNAL_IDENTITY_MATCH', 'LEGACY_REVIEWED') then 'method' when method = 'EXTERNAL_IDENTITY_MATCH' and source_type = '' then 'source'
 when method = 'EXTERNAL_IDENTITY_MATCH' and lower(other_key) in ('first_name', 'last_name', 'name', 'street', 'address', 'email', 'phone', 'ssn') then 'personal evidence' when trim(explanation) = '' then 'explanation' end"""


def _decisions(verifications):
    return verifications.withColumn("evidence", F.create_map(F.lit("source_type"), "source_type", F.lit("source_version"), "source_version", "other_key", F.lit("1")))


@query("verifications", oracle=f"select * from (select entity_id, {_REASON} as reason from verifications) as x where reason is not null")
def identity_verification_rejects(verifications):
    """Decisions that are turned down, and why."""
    return identity.check_verifications(_decisions(verifications))[1].select("entity_id", "reason")


@query(
    "entities",
    "verifications",
    oracle=f"""with v as (select entity_id, method from (select *, {_REASON} as reason from verifications) as x where reason is null)
     select e.entity_id, case when method is not null then 'VERIFIED' else verification_status end as verification_status, coalesce(method, verification_method) as verification_method,
     case when method is not null then 'staff' else verified_by end as verified_by from entities e left join v on e.entity_id = v.entity_id""",
)
def identity_verify(entities, verifications):
    """Entities with the accepted decisions."""
    return identity.apply_verifications(entities, _decisions(verifications)).select("entity_id", "verification_status", "verification_method", "verified_by")


@query(
    "entities",
    "manifest",
    oracle="""select e.entity_id, coalesce(m.verification_status, e.verification_status) as verification_status,
     case when m.entity_id is null then e.verification_method when m.verification_status = 'VERIFIED' and coalesce(m.verification_method, 'NONE') = 'NONE' then 'LEGACY_REVIEWED' else coalesce(m.verification_method, 'NONE') end as verification_method,
     case when m.entity_id is null then e.verified_by else m.verified_by end as verified_by from entities e left join manifest m on e.entity_id = m.entity_id""",
)
def identity_verification_rollback(entities, manifest):
    """Verification restored from a manifest."""
    return identity.apply_verification_rollback(entities, manifest).select("entity_id", "verification_status", "verification_method", "verified_by")


@query(
    "rule_versions",
    "coverages",
    oracle="""select r.*, c.coverage_end_date as through, c.coverage_status as status from
     (select monthly_interval_min, monthly_interval_max, active_grace_period, min_recurring_payments, skip_payment_allowed, rule_version_id from rule_versions where is_active order by rule_version_id limit 1) as r,
     (select coverage_end_date, coverage_status from coverages order by coverage_end_date desc limit 1) as c""",
)
def membership_in_force(rules, coverages):
    """M8: the rule and the coverage that evaluations take."""
    return membership.in_force(rules, coverages)


@query(
    "assessments",
    "entities",
    oracle="""with o as (select entity_id from entities where entity_id % 50 = 3)
     select entity_id, calculated_status, calculation_date, is_current and entity_id not in (select entity_id from o) as is_current, recurring_amount from assessments
     union all select entity_id, 'ACTIVE', date '2001-06-15', true, cast(0 as decimal(12,2)) from o""",
)
def membership_overrides(assessments, entities):
    """Every fiftieth entity is set to ACTIVE by hand."""
    manual = entities.where("entity_id % 50 = 3").select("entity_id", F.lit("ACTIVE").alias("status"), F.lit(DAY).alias("calculation_date"))
    return membership.apply_membership_overrides(assessments, manual).select("entity_id", "calculated_status", "calculation_date", "is_current", "recurring_amount")


@query(
    "assessments",
    "payments",
    oracle="""with m as (select entity_id, assessment_id, case assessment_id % 4 when 0 then 'S01' when 1 then 'S04' when 2 then 'S10' else 'S11' end as matrix_id from assessments),
     p as (select entity_id, count(*) as n from payments where amount > 200000 group by entity_id), x as (select m.*, coalesce(n, 0) as positive_count from m left join p on m.entity_id = p.entity_id)
     select entity_id, matrix_id, positive_count from x where (matrix_id = 'S01' and positive_count < 2) or (matrix_id = 'S04' and positive_count <> 1) or (matrix_id = 'S10' and positive_count <> 0)""",
)
def membership_evidence(assessments, payments):
    """Stored states against numbers of large payments; the states are dealt by id, so that many are wrong."""
    state = F.element_at(F.array(*map(F.lit, ["S01", "S04", "S10", "S11"])), (F.col("assessment_id") % 4 + 1).cast("int"))
    positives = payments.where("amount > 200000").groupBy("entity_id").agg(F.count("*").alias("positive_count"))
    return membership.evidence_violations(assessments.select("entity_id", state.alias("matrix_id")), positives)


@query(
    "assessments",
    oracle="""select assessment_id as entity_id, case assessment_id % 10 when 3 then 'ONLY_IN_AUDIT' when 7 then 'ONLY_IN_MANIFEST' else 'DIFFERENT' end as issue from assessments
     where assessment_id % 10 in (3, 7) or assessment_id % 10 in (1, 5) and assessment_id % 3 = 1""",
)
def membership_parity(assessments):
    """An audit and a manifest of the same rows, each of which lacks some, and which differ in others."""
    rows = assessments.select(F.col("assessment_id").alias("entity_id"), F.array(F.lit("calculated_status"), F.lit("recurring_amount")).alias("changed_fields"), F.col("calculated_status").alias("before"), F.lit("LAPSED").alias("after"))
    audit = rows.where("entity_id % 10 <> 7")
    other = rows.where("entity_id % 10 <> 3").withColumns(
        {
            "after": F.when((F.col("entity_id") % 10 == 1) & (F.col("entity_id") % 3 == 1), "ACTIVE").otherwise(F.col("after")),
            "changed_fields": F.when((F.col("entity_id") % 10 == 5) & (F.col("entity_id") % 3 == 1), F.array(F.lit("calculated_status"))).otherwise(F.reverse("changed_fields")),
        }
    )
    return membership.audit_repair_parity(audit, other)


@query(
    "weights",
    oracle="""with w as (select *, try_cast(trim(replace(value, '%', '')) as double) as number, upper(coalesce(unit, 'UNKNOWN')) as kind from weights)
     select row_number, case when value = '' or number is null then null when contains(value, '%') or kind = 'PERCENTAGE' then number / 100 when kind = 'FRACTION' then number when kind = 'COUNT' then null
       when number between 0 and 1 then number when number > 1 and number <= 100 then number / 100 end as weight,
     case when value = '' or number is null then '' when contains(value, '%') or kind = 'PERCENTAGE' then 'PERCENTAGE_TO_FRACTION' when kind = 'FRACTION' then 'DIRECT_FRACTION' when kind = 'COUNT' then 'COUNT_UNNORMALIZED'
       when number between 0 and 1 then 'ASSUMED_FRACTION' when number > 1 and number <= 100 then 'ASSUMED_PERCENTAGE' else 'OUT_OF_RANGE_UNNORMALIZED' end as rule from w""",
)
def geography_weights(weights):
    """G2."""
    return weights.select("row_number", parsing.normalize_weight(F.col("value"), F.col("unit")).alias("w")).select("row_number", "w.weight", "w.rule")


@query(
    "crosswalk",
    oracle="""select row_number, case when row_number_of > 1 then 'EXACT_DUPLICATE' when zip in ('', 'abc-de') or trim(county) = '' then 'VALIDATION_FAILURE' when zip = '2138' then 'POSSIBLE_TRUNCATED_LEADING_ZERO'
     when weight = 'bad' then 'VALIDATION_WARNING' else 'ACCEPTED' end as row_status from (select *, row_number() over (partition by row_hash order by row_number) as row_number_of from crosswalk) as x""",
)
def geography_reference_rows(crosswalk):
    """A file of ZIP codes and counties."""
    return geography.import_reference(crosswalk, "ZIP_COUNTY_CROSSWALK").select("row_number", "row_status")


@query(
    "crosswalk",
    "places",
    oracle="""select state_code, name from places union select 'CA', regexp_replace(upper(trim(county)), ' COUNTY$', '') from crosswalk where trim(county) <> ''""",
)
def geography_canonical(crosswalk, places):
    """Counties of a file beside names that are there."""
    known = places.select(F.col("place_id").alias("id"), "state_code", "name")
    return geography.canonicalise(known, crosswalk.select(F.lit(None).cast("string").alias("state_code"), F.col("county").alias("name")), "county").select("state_code", "name")


@query(
    "associations",
    "known_associations",
    oracle="""select min(row_number) as row_number, postal_id, place_id, dataset_id from associations a where postal_id is not null and place_id is not null
     and not exists (select 1 from known_associations k where k.is_active and k.postal_id = a.postal_id and k.place_id = a.place_id and k.dataset_id = a.dataset_id) group by postal_id, place_id, dataset_id""",
)
def geography_associations(rows, known):
    """G5."""
    return geography.dedupe_associations(rows, known, "postal_id", "place_id").select("row_number", "postal_id", "place_id", "dataset_id")


@query("assignments", oracle="select assignment_id, case when import_batch_id in (2, 5) then true else is_active end as is_active from assignments")
def geography_restore(rows):
    """What came with batches 2 and 5 is restored."""
    ids = rows.sparkSession.createDataFrame([(2,), (5,)], "import_batch_id long")
    return geography.flip_reference(rows, ids, True).select("assignment_id", "is_active")


@query(
    "datasets",
    oracle="""select dataset_id, dataset_type, case when dataset_id = 7 then 'ACTIVE' when status = 'ACTIVE' and dataset_type = (select dataset_type from datasets where dataset_id = 7) then 'SUPERSEDED' else status end as status from datasets""",
)
def geography_activate(datasets):
    """G8."""
    return geography.activate_dataset(datasets, 7)


_CANDIDATES = """cand as (select location_id, k.county_id from r join place_county k on k.place_id = r.place_id where candidate_rule = 'PLACE_COUNTY_SPAN'
 union all select location_id, k.county_id from r join postal_county k on k.postal_id = r.postal_id where candidate_rule = 'ZIP_COUNTY_MULTIPLE')"""


@query(
    *GEO,
    oracle=f"""{_GEO}, {_CANDIDATES} select r.location_id, match_method, confidence, ids as county_ids from r left join
     (select location_id, string_agg(cast(county_id as varchar), ',' order by county_id) as ids from cand group by location_id) c on c.location_id = r.location_id where match_method not in {_RES}""",
)
def geography_queue(*tables):
    """G13."""
    found, ref = _resolved(*tables)
    queue = geography.ambiguity_queue(found, geography.resolution_candidates(found, ref))
    return queue.withColumn("county_ids", F.array_join(F.transform("county_ids", lambda c: c.cast("string")), ","))


@query(
    *GEO,
    oracle=f"""{_GEO}, {_CANDIDATES}, pick as (select location_id, min(county_id) as county_id from cand group by location_id)
     select location_id, county_id, match_method, case when location_id in (select location_id from pick) then 'SUPERSEDED' else 'CURRENT' end as status from r
     union all select location_id, county_id, 'MANUALLY_RESOLVED', 'CURRENT' from pick""",
)
def geography_manual(*tables):
    """Of the candidates the lowest county is picked."""
    found, ref = _resolved(*tables)
    picks = geography.resolution_candidates(found, ref).groupBy("location_id").agg(F.min("county_id").alias("county_id"))
    return geography.apply_manual_resolutions(found.withColumn("status", F.lit("CURRENT")), picks).select("location_id", "county_id", "match_method", "status")


@query(
    "pointers",
    "runs",
    oracle="""select coalesce(p.chapter_id, n.chapter_id) as chapter_id, coalesce(run_id, current_run_id) as current_run_id from pointers p full join
     (select chapter_id, max(run_id) as run_id from runs where status = 'COMPLETED' and run_type = 'APPLY' and ruleset_status = 'ACTIVE' group by chapter_id) n on p.chapter_id = n.chapter_id""",
)
def chapters_promote(pointers, runs):
    """C8."""
    return chapters.promote_runs(pointers, runs)


@query(
    *RESULT,
    oracle=f"""{_RESULT}, old as (select chapter_id, entity_id, case when entity_id % 4 = 1 then 'AMBIGUOUS' else assignment_status end as was from res where entity_id % 3 <> 0)
     select res.chapter_id, res.entity_id, assignment_status, case when was is null then 'CREATED' when was = assignment_status then 'IDENTICAL' else 'UPDATED' end as change
     from res left join old on old.chapter_id = res.chapter_id and old.entity_id = res.entity_id""",
)
def chapters_rebuild(*tables):
    """Assignments against an older set that lacks a third and differs in a quarter."""
    new = _results(*tables)
    old = new.where("entity_id % 3 <> 0").withColumn("assignment_status", F.when(F.col("entity_id") % 4 == 1, "AMBIGUOUS").otherwise(F.col("assignment_status")))
    return chapters.rebuild_assignments(new, old)


@query(
    *RESULT,
    oracle=f"""{_RESULT}, j as (select coalesce(n.chapter_id, o.chapter_id) as chapter_id, coalesce(n.entity_id, o.entity_id) as entity_id, coalesce(n.result_status, 'NO_MATCH') as a, coalesce(o.result_status, 'NO_MATCH') as b,
      n.chapter_id is not null and o.chapter_id is not null and n.rule_id is distinct from o.rule_id as rule_changed
      from (select * from res where entity_id % 7 <> 4) n full join
      (select chapter_id, entity_id, case when entity_id % 11 = 1 then 'NO_RULE_MATCH' when entity_id % 11 = 2 then 'AMBIGUOUS_LOCATION' when entity_id % 11 = 3 then 'MANUALLY_EXCLUDED' else result_status end as result_status,
       case when entity_id % 11 in (1, 2, 3) then null else rule_id end as rule_id from res where entity_id % 5 <> 2) o on n.chapter_id = o.chapter_id and n.entity_id = o.entity_id)
     select chapter_id, entity_id, {", ".join(f"a in {_in(m)} and b not in {_in(m)} as new_{k}, b in {_in(m)} and a not in {_in(m)} as removed_{k}" for k, m in chapters.PREVIEWED.items())}, rule_changed from j""",
)
def chapters_preview(*tables):
    """A staged run that lacks a seventh of the entities against one that lacks a fifth and differs elsewhere."""
    new = _results(*tables)
    kind = F.col("entity_id") % 11
    old = new.where("entity_id % 5 <> 2").withColumns(
        {
            "result_status": F.when(kind == 1, "NO_RULE_MATCH").when(kind == 2, "AMBIGUOUS_LOCATION").when(kind == 3, "MANUALLY_EXCLUDED").otherwise(F.col("result_status")),
            "rule_id": F.when(~kind.isin(1, 2, 3), F.col("rule_id")),
        }
    )
    return chapters.preview_diff(new.where("entity_id % 7 <> 4"), old).drop("new_status", "old_status", "new_rule", "old_rule")


@query(
    *RESULT,
    oracle=f"""{_RESULT} select entity_id, string_agg(cast(chapter_id as varchar), ',' order by chapter_id) as chapter_ids from res where assignment_status in ('INCLUDED', 'PROVISIONALLY_INCLUDED')
     group by entity_id having count(*) > 1""",
)
def chapters_overlaps(*tables):
    """C12, C14."""
    return chapters.overlaps(_results(*tables)).withColumn("chapter_ids", F.array_join(F.transform("chapter_ids", lambda c: c.cast("string")), ","))


_ACTIVE = "i as (select res.*, chapter_name from res join chapter_list c on c.chapter_id = res.chapter_id and c.status = 'ACTIVE' where assignment_status in ('INCLUDED', 'PROVISIONALLY_INCLUDED'))"


@query(*RESULT, "chapter_list", oracle=f"{_RESULT}, {_ACTIVE} select entity_id, string_agg(chapter_name, ',' order by chapter_id) as chapter_names from i group by entity_id having count(*) > 1")
def chapters_overlaps_named(*tables):
    """C14: of active chapters, by name."""
    *rest, listed = tables
    return chapters.overlaps(_results(*rest), listed).select("entity_id", F.array_join("chapter_names", ",").alias("chapter_names"))


@query(
    *RESULT,
    "chapter_list",
    oracle=f"""{_RESULT}, {_ACTIVE} select a.chapter_name as chapter_1, b.chapter_name as chapter_2, count(*) as shared from i a join i b on a.entity_id = b.entity_id and a.chapter_id < b.chapter_id
     group by a.chapter_name, b.chapter_name""",
)
def chapters_overlap_pairs_named(*tables):
    """Of active chapters, by name."""
    *rest, listed = tables
    return chapters.overlap_pairs(_results(*rest), listed)


@query(
    "override_decisions",
    oracle="""with o as (select *, row_number() over (partition by chapter_id, entity_id order by decided_at desc, override_id desc) as k from
      (select chapter_id, entity_id, override_type, decided_at, override_id from override_decisions where trim(reason) <> '' and expiration_date >= effective_date
       union all select chapter_id, entity_id, 'INCLUDE', -1, override_id from override_decisions) as x)
     select chapter_id, entity_id, override_type, case when k > 1 then 'SUPERSEDED' when entity_id % 5 = 0 then 'REVOKED' else 'ACTIVE' end as status from o""",
)
def chapters_overrides(decisions):
    """Decisions over one older override each; then every fifth entity's is revoked."""
    old = decisions.withColumns({"override_type": F.lit("INCLUDE"), "decided_at": F.lit(-1).cast("long"), "status": F.lit("ACTIVE")})
    both = chapters.apply_overrides(old, decisions)[0]
    return chapters.revoke_overrides(both, decisions.where("entity_id % 5 = 0")).select("chapter_id", "entity_id", "override_type", "status")


@query("entities", oracle="select entity_id, '[redacted]' as display_name, entity_type from entities")
def reports_redacted(entities):
    """P7."""
    return reports.redact(entities).select("entity_id", "display_name", "entity_type")


@query("audit_events", oracle="select event_id, created_at, entity from audit_events where contains(lower(entity), 'urgent')")
def reports_audit_log(events):
    """P8."""
    return reports.audit_log(events, "URGENT")


@query(
    "entities",
    "assignments",
    "assessments",
    "chapter_results",
    "audit_events",
    oracle="""with free as (select entity_id, display_name, entity_type from entities where entity_id not in (select entity_id from assignments where import_batch_id = 0)),
     c as (select f.*, contains(display_name, '7') or contains(display_name, 'customer') as named, (select count(*) from assessments a where a.entity_id = f.entity_id) as n_assessments,
      (select count(*) from chapter_results r where r.entity_id = f.entity_id) as n_results from free f)
     select entity_id, display_name, entity_type, named, n_assessments, n_results, (select count(*) from audit_events v where contains(v.entity, cast(c.entity_id as varchar))) as n_events,
     'SYNTHETIC_BENCHMARK_DISPOSABLE' as disposition from c where named or n_assessments = 0""",
)
def reports_synthetic(entities, assignments, assessments, results, events):
    """Against the assignments of one batch; a keyword in the wrong case finds nothing."""
    told = events.select(F.col("entity").alias("description"))
    return reports.synthetic_entities(entities, assignments.where("import_batch_id = 0"), assessments, results, told, ["7", "customer"])


@query(
    "entities",
    "assessments",
    oracle="""with l as (select entity_id, arg_max(calculated_status, assessment_id) as status from assessments group by entity_id)
     select e.entity_id from entities e left join l on e.entity_id = l.entity_id where entity_type = 'INDIVIDUAL' and (status is null or status = 'UNKNOWN')""",
)
def reports_unknown(entities, assessments):
    """UNKNOWN takes in individuals without an assessment."""
    return reports.filter_by_status(entities, assessments, "UNKNOWN").select("entity_id")
