"""Queries of changes: batches processed again, rolled back and purged, what that re-evaluates, runs and manifests."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F


from ..operators import geography, identity, ingest, membership, reevaluation, reports
from ..sources import scratch
from ..sources.versions import Versioned
from .queries import _GEO, _NAME, _STATES, _STATUS, COVERAGE, DAY, GEO, HASHED, RULE, _resolved, query


def _store(df, name: str, key: str, parts: int = 16) -> Versioned:
    return Versioned(df.sparkSession, f"{scratch.folder(df.sparkSession)}/tallyforge/{name}-{uuid.uuid4().hex}", key, parts)


def _ids(df, *values: int):
    return df.sparkSession.createDataFrame([(v,) for v in values], "import_batch_id long")


def _parsed(rows):
    return ingest.with_row_hash(ingest.parse_rows(rows), HASHED)


_AGAIN = f"""{_STATUS},
 kept as (select d.*, s.validation_status from d join s on s.row_number = d.row_number where d.import_batch_id not in (3, 6)),
 fresh as (select *, row_number() over (partition by import_batch_id, row_hash order by row_number) > 1 or row_hash in (select row_hash from kept where validation_status = 'ACCEPTED') as dup2
   from parsed where import_batch_id = 3),
 fd as (select f.*, concat_ws('; ', case when name = '' then 'Missing name of contributor.' end, case when amount is null then 'Invalid amount value: ''' || amount_text || '''.' end,
   case when transaction_date is null then 'Invalid date value: ''' || date_text || '''.' end) as message from fresh f),
 imp as (select * from kept where validation_status in ('ACCEPTED', 'POSSIBLE_DUPLICATE', 'POSSIBLE_AMENDMENT')),
 fg as (select *, count(*) over (partition by txn order by row_number rows between unbounded preceding and 1 preceding) > 0 or txn in (select txn from imp) as nt,
   count(*) over (partition by txn, amount, transaction_date order by row_number rows between unbounded preceding and 1 preceding) > 0 or (txn, amount, transaction_date) in (select txn, amount, transaction_date from imp) as ns,
   count(*) over (partition by amount, transaction_date, normalized_name, zip order by row_number rows between unbounded preceding and 1 preceding) > 0
     or (amount, transaction_date, normalized_name, zip) in (select amount, transaction_date, normalized_name, zip from imp) as nl from fd where not dup2 and message = ''),
 fs as (select *, case when txn <> '' and ns then 'POSSIBLE_DUPLICATE' when txn <> '' and nt then 'POSSIBLE_AMENDMENT' when txn = '' and nl then 'POSSIBLE_DUPLICATE' else 'ACCEPTED' end as validation_status from fg)"""


def _stored(rows):
    """Statuses of each batch by itself, of which batch 6 is rolled back and 3 is to be processed again. Rows are parsed
    once, and the statuses are stored."""
    parsed = scratch.keep(_parsed(rows).drop("person", "zip5", "employer", "occupation"), "parsed")
    done = ingest.flag_duplicates(ingest.flag_exact_duplicates(ingest.validate_rows(parsed)))
    done = scratch.keep(done.select("import_batch_id", "row_number", "validation_status", "validation_message"), "statuses")
    batches = rows.sparkSession.createDataFrame([(b, "ROLLED_BACK" if b == 6 else "COMPLETED") for b in range(7)], "import_batch_id long, status string")
    return ingest.reprocess_batches(parsed, done, batches, _ids(rows, 3))


@query(
    "raw_rows",
    oracle=f"""{_AGAIN} select row_number, validation_status from fs union all select row_number, case when dup2 then 'EXACT_DUPLICATE' else 'VALIDATION_FAILURE' end from fd where dup2 or message <> ''
     union all select row_number, validation_status from s where import_batch_id <> 3""",
)
def ingest_reprocess(rows):
    """A batch evaluated again, against what the other completed batches have."""
    return _stored(rows)[0].select("row_number", "validation_status")


@query(
    "raw_rows",
    oracle=f"""{_AGAIN} select row_number, case when amount >= 0 then 'CONTRIBUTION' when upper(txn) like 'REF%' or (txn <> '' and txn in (select txn from imp)) then 'REFUND' when upper(txn) like 'REV%' then 'REVERSAL'
     when upper(name) like '%REFUND%' then 'REFUND' when upper(name) like '%REVERSAL%' then 'REVERSAL' else 'ADJUSTMENT' end as transaction_type from fs""",
)
def ingest_reprocessed_contributions(rows):
    """Types of the contributions that come of it; a known transaction number makes a refund."""
    return _stored(rows)[1].select("row_number", "transaction_type")


@query("raw_rows", oracle=f"{_STATUS} select row_number, case when import_batch_id in (2, 5) then 'UNPROCESSED' else validation_status end as validation_status from s")
def ingest_reset(rows):
    """Rows of two batches reset."""
    done = ingest.flag_duplicates(ingest.flag_exact_duplicates(ingest.validate_rows(_parsed(rows))))
    return ingest.reset_batches(done, _ids(rows, 2, 5)).select("row_number", "validation_status")


@query(
    "batches",
    oracle="""with k as (select f.file_hash, min(b.import_batch_id) as import_batch_id from batches f join batches b on b.file_hash = f.file_hash and b.status = 'COMPLETED' and b.import_batch_id < 5 group by f.import_batch_id, f.file_hash)
     select import_batch_id, 'REPROCESS_FAILED' as action, 'Attempted to import duplicate file hash ''' || file_hash || ''' without authorization override.' as notes from k
     union all select import_batch_id, 'REPROCESS_START', 'Reprocessing of batch ' || import_batch_id || ' initiated.' from k""",
)
def ingest_attempts(batches):
    """Attempts at files that a completed one of the first batches had, without and with an override."""
    files, first = batches.select("file_hash"), batches.where("import_batch_id < 5")
    return ingest.file_attempts(files, first).unionByName(ingest.file_attempts(files, first, True))


_LEFT = _STATES.replace("from payments p", "from payments_left p").replace("from payments group", "from payments_left group")


@query("entities", "payments_left", "payments", "assignments", oracle=f"{_LEFT} select entity_id, calculated_status, recurring_amount, n as positives from full_states".replace("n as positives", "case when state_id = 'S11' then 0 else n end as positive_count"))
def membership_after_rollback(entities, left, payments, assignments):
    """All memberships are stored, batches 2 and 5 are rolled back, and only entities of theirs are evaluated again."""
    store = _store(entities, "memberships", "entity_id")
    store.load(reevaluation.memberships(entities, payments, RULE, COVERAGE, DAY), 1)
    _, touched = reevaluation.touched_by_batches(assignments, _ids(entities, 2, 5))
    reevaluation.refresh_memberships(store, touched, entities, left, RULE, COVERAGE, DAY, 2)
    schema = reevaluation.memberships(entities, payments, RULE, COVERAGE, DAY).schema
    return store.current(schema).select("entity_id", "calculated_status", "recurring_amount", "positive_count")


@query(
    "entities",
    "payments",
    oracle=f"""{_STATES} select entity_id, case when entity_id % 6 = 1 then 'UNKNOWN' else calculated_status end as calculated_status, case when entity_id % 6 = 1 then 'INELIGIBLE' else membership_authority end as membership_authority,
     entity_id % 6 <> 1 as has_pattern from full_states""",
)
def membership_after_reclassification(entities, payments):
    """A sixth of the entities turn out to be organisations; their memberships are void, their patterns go."""
    decisions = entities.where("entity_id % 6 = 1").selectExpr("entity_id", "'ORGANIZATION' as new_type")
    now, kept = reevaluation.reclassified(reevaluation.memberships(entities, payments, RULE, COVERAGE, DAY), reevaluation.patterns(entities, payments, RULE), decisions, entities.select("cluster_id", "entity_id"))
    own = entities.select("cluster_id", "entity_id").join(kept.selectExpr("cluster_id", "true as has_pattern"), "cluster_id", "left")
    return now.join(own, "entity_id").select("entity_id", "calculated_status", "membership_authority", F.coalesce("has_pattern", F.lit(False)).alias("has_pattern"))


_PURGE = """c as (select cluster_id, count(*) filter (import_batch_id not in (0, 1, 2, 3, 4)) as surviving from assignments group by cluster_id having count(*) filter (import_batch_id in (0, 1, 2, 3, 4)) > 0),
 t as (select cluster_id, surviving, cluster_id in (select source_cluster_id from merge_decisions union select target_cluster_id from merge_decisions) as merged, cluster_id % 40 = 3 as matched from c),
 tt as (select *, surviving = 0 and not merged and not matched as orphaned from t),
 e as (select n.entity_id, count(*) filter (not coalesce(tt.orphaned, false)) as remaining from entities n left join tt on tt.cluster_id = n.cluster_id group by n.entity_id having count(tt.orphaned) > 0),
 ee as (select e.*, n.verification_status = 'VERIFIED' as verified, e.entity_id % 12 = 5 as manual from e join entities n on n.entity_id = e.entity_id),
 o as (select *, remaining = 0 and not manual and not verified as orphaned from ee)"""


def _purged(assignments, merges, entities):
    ids = _ids(entities, *range(5))
    matches, manual = entities.where("cluster_id % 40 = 3").select("cluster_id"), entities.where("entity_id % 12 = 5").selectExpr("entity_id", "true as manual_override")
    return ids, *ingest.purge_cascade(ids, assignments, assignments, entities.select("cluster_id", "entity_id"), merges, matches, entities, manual)


@query(
    "assignments", "merge_decisions", "entities", "payments",
    oracle=f"""with {_PURGE} select 'raw_rows' as item, count(*) as n from assignments where import_batch_id < 5 union all select 'contributions', count(*) from payments where import_batch_id < 5
     union all select 'orphaned_clusters', count(*) filter (orphaned) from tt union all select 'preserved_clusters', count(*) filter (not orphaned) from tt union all select 'clusters_with_surviving_contributions', count(*) filter (surviving > 0) from tt
     union all select 'clusters_with_merges', count(*) filter (merged) from tt union all select 'clusters_with_matches', count(*) filter (matched) from tt
     union all select 'orphaned_entities', count(*) filter (orphaned) from o union all select 'preserved_entities', count(*) filter (not orphaned) from o""",
)
def ingest_purge_preview(assignments, merges, entities, payments):
    """What a purge of batches 0 to 4 would delete and keep, with matches and manual assessments."""
    ids, touched, owners = _purged(assignments, merges, entities)
    return ingest.purge_preview(ids, assignments, payments, touched, owners)


@query(
    "assignments", "merge_decisions", "entities", "payments",
    oracle=f"""with {_PURGE} select 'payments' as item, count(*) as n from payments where import_batch_id >= 5 and cluster_id not in (select cluster_id from tt where orphaned) and entity_id not in (select entity_id from o where orphaned)
     union all select 'assignments', count(*) from assignments where import_batch_id >= 5 and cluster_id not in (select cluster_id from tt where orphaned) and entity_id not in (select entity_id from o where orphaned)
     union all select 'clusters', count(*) from entities where cluster_id not in (select cluster_id from tt where orphaned)
     union all select 'entities', count(*) from entities where entity_id not in (select entity_id from o where orphaned)""",
)
def ingest_purge(assignments, merges, entities, payments):
    """Rows of each table after the purge."""
    ids, touched, owners = _purged(assignments, merges, entities)
    tables = {"payments": payments, "assignments": assignments, "clusters": entities.select("cluster_id"), "entities": entities.select("entity_id")}
    left = ingest.purge(tables, ids, touched, owners)
    out = [df.agg(F.lit(name).alias("item"), F.count("*").alias("n")) for name, df in left.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


# --- identity -------------------------------------------------------------------------------------------

_OWN = """gone as (select original_contribution_id as id from amendments where review_status = 'ACCEPTED' union select replacement_contribution_id from amendments where review_status in ('PENDING', 'REJECTED')),
 own as (select a.{k}, p.contribution_id, p.amount, p.transaction_date from payments p join assignments a on a.contribution_id = p.contribution_id and a.is_active
  where p.contribution_id not in (select id from gone) and p.import_batch_id in (select import_batch_id from batches where status = 'COMPLETED'))"""


def _effective(key):
    @query(
        "payments", "amendments", "assignments", "batches",
        oracle=f"with {_OWN.replace('{k}', key)} select {key}, contribution_id, amount, row_number() over (partition by {key} order by transaction_date, contribution_id) as place from own",
    )
    def run(payments, amendments, assignments, batches):
        return identity.effective_of(payments, amendments, assignments, batches, key).select(key, "contribution_id", "amount", "place")

    return run


def _named(f, name, doc):
    """Registers what _effective() made under a name of its own."""
    from .queries import QUERIES, SQL

    QUERIES[name], SQL[name] = QUERIES.pop("run"), SQL.pop("run")
    f.__name__, f.__doc__ = name, doc
    return f


identity_effective_by_entity = _named(_effective("entity_id"), "identity_effective_by_entity", "R9: by entity, in order of date.")
identity_effective_by_cluster = _named(_effective("cluster_id"), "identity_effective_by_cluster", "R9: by cluster, in order of date.")


@query(
    "raw_rows",
    oracle=f"""with {_NAME}, c as (select min(row_number) over (partition by normalized_name) as cluster_id, row_number() over (partition by normalized_name order by row_number) - 1 as before from parsed)
     select cluster_id, case when max(before) >= 2 then 'HIGH' when max(before) = 1 then 'MEDIUM' else 'LOW' end as confidence_level from c group by cluster_id""",
)
def identity_confidence(rows):
    """Clusters of equal names; each row after the first is a match."""
    from pyspark.sql import Window

    p = ingest.parse_rows(rows).select("normalized_name", "row_number")
    w = Window.partitionBy("normalized_name")
    clustered = p.select(F.min("row_number").over(w).alias("cluster_id"), (F.row_number().over(w.orderBy("row_number")) - 1).alias("matched_before"))
    return identity.cluster_confidence(clustered)


@query(
    "entities",
    "stored_assessments",
    oracle="""select e.entity_id, entity_type, is_verified as previous_is_verified, verification_status as previous_verification_status, verification_method as previous_verification_method,
     cast(cluster_id as varchar) as clusters, a.id as current_assessment_id, coalesce(a.status, 'UNKNOWN') as current_assessment_status, 'UNVERIFIED' as proposed_verification_status,
     'PROVISIONAL' as proposed_membership_authority, 'INVALID_CLUSTER_CONFIDENCE_AUTOVERIFICATION' as reason_code
     from entities e left join (select entity_id, min(assessment_id) as id, arg_min(calculated_status, assessment_id) as status from stored_assessments where is_current group by entity_id) a on a.entity_id = e.entity_id
     where (is_verified or verification_status = 'VERIFIED') and (verification_method = 'NONE' or nullif(verified_by, '') is null)""",
)
def identity_drift_manifest(entities, assessments):
    """The manifest of a correction; an empty verifier is none."""
    own = entities.withColumn("verified_by", F.nullif("verified_by", F.lit("")))
    m = identity.drift_manifest(own, entities.select("cluster_id", "entity_id"), assessments)
    return m.withColumn("clusters", F.array_join(F.transform("cluster_ids", lambda c: c.cast("string")), ",")).drop("cluster_ids", "proposed_verification_method")


VERIFIED = ["verification_status", "verification_method", "verified_by", "is_verified"]


def _records(entities):
    """Corrections of drifted entities as records, beside the entities as they are when they come to be applied: one in
    nine has moved on."""
    drifted = identity.verification_drift(entities)
    after = identity.apply_unverification(entities, drifted).withColumn("is_verified", F.when(F.col("verification_status") == "UNVERIFIED", False).otherwise(F.col("is_verified")))
    records = identity.change_records(entities.join(drifted.select("entity_id"), "entity_id", "left_semi"), after, "entity_id", VERIFIED)
    return records, entities.withColumn("verified_by", F.when(F.col("entity_id") % 9 == 1, "somebody else").otherwise(F.col("verified_by")))


_DRIFT = "verification_status = 'VERIFIED' and (coalesce(verification_method, '') = '' or coalesce(verified_by, '') = '')"


@query(
    "entities",
    oracle=f"""with d as (select *, coalesce('''' || verification_method || '''', 'null') as m, coalesce('''' || verified_by || '''', 'null') as b from entities where {_DRIFT})
     select entity_id, concat_ws(',', 'verification_status', case when verification_method is not null then 'verification_method' end, case when verified_by is not null then 'verified_by' end, case when is_verified then 'is_verified' end) as changed_fields,
     sha256(entity_id || '||verification_status=''VERIFIED''|verification_method=' || m || '|verified_by=' || b || '|is_verified=''' || is_verified || '''||verification_status=''UNVERIFIED''|verification_method=null|verified_by=null|is_verified=''false''') as checksum from d""",
)
def identity_change_records(entities):
    """Records of a correction that can be undone."""
    return _records(entities)[0].select("entity_id", F.array_join("changed_fields", ",").alias("changed_fields"), "checksum")


@query(
    "entities",
    oracle=f"select entity_id, case when entity_id % 9 = 1 then 'MOVED_ON' end as reason, case when entity_id % 9 = 1 then 'VERIFIED' else 'UNVERIFIED' end as verification_status from entities where {_DRIFT}",
)
def identity_changes_applied(entities):
    """Records are applied, but for entities that have moved on."""
    records, now = _records(entities)
    out, bad = identity.apply_changes(now, records, "entity_id")
    return out.join(records.select("entity_id"), "entity_id", "left_semi").join(bad.select("entity_id", "reason"), "entity_id", "left").select("entity_id", "reason", "verification_status")


@query("entities", oracle="select entity_id, verification_status, verification_method, case when entity_id % 9 = 1 then 'somebody else' else verified_by end as verified_by, is_verified from entities")
def identity_changes_undone(entities):
    """Records applied and then undone leave all as it was."""
    records, now = _records(entities)
    out, bad = identity.apply_changes(now, records, "entity_id")
    undo = identity.inverted(records.join(bad.select("entity_id"), "entity_id", "left_anti"), "entity_id")
    return identity.apply_changes(out, undo, "entity_id")[0].select("entity_id", *VERIFIED)


# --- geography ------------------------------------------------------------------------------------------


@query(
    *GEO,
    oracle=f"""{_GEO} select location_id, 1 as run_id, match_method, case when location_id % 4 = 1 then 'SUPERSEDED' else 'CURRENT' end as status from r
     union all select location_id, 2, match_method, 'CURRENT' from r where location_id % 4 = 1""",
)
def geography_runs(*tables):
    """All locations are resolved in run 1, a quarter again in run 2, which is repeated as if it had died."""
    locations, ref = tables[0], _resolved(*tables)[1]
    store = _store(locations, "resolutions", "location_id")
    found = geography.resolve_locations(locations, ref)
    first = geography.supersede(found.selectExpr("*", "cast(0 as bigint) as run_id", "'' as status", "'' as origin").where("false"), found, 1)
    store.load(first, 1)
    for _ in range(2):
        geography.run_resolution(store, locations.where("location_id % 4 = 1"), ref, first.schema, 2)
    return store.current(first.schema).select("location_id", "run_id", "match_method", "status")


@query(
    "geo_runs",
    "datasets",
    oracle="""with x as (select dataset_id from datasets where status = 'ACTIVE' and dataset_id <> 7 and dataset_type = (select dataset_type from datasets where dataset_id = 7))
     select run_id, dataset_id, scope, case when status = 'PENDING' and dataset_id in (select dataset_id from x) then 'SUPERSEDED' else status end as status from geo_runs
     union all select 1000000, 7, 'dataset_7', 'PENDING' where not exists (select 1 from geo_runs where dataset_id = 7 and status = 'PENDING')""",
)
def geography_runs_after_activation(runs, datasets):
    """Runs after dataset 7 becomes active."""
    return geography.runs_after_activation(runs, datasets, 7, 1_000_000).select("run_id", "dataset_id", "scope", "status")


@query(
    "geo_runs",
    "geo_batches",
    oracle="""with down as (select distinct dataset_id from geo_batches where import_batch_id in (1, 3, 4) and status = 'COMPLETED'), up as (select distinct dataset_id from geo_batches where import_batch_id in (3, 9, 10, 14) and status = 'ROLLED_BACK')
     select run_id, dataset_id, scope, case when status = 'PENDING' and dataset_id in (select dataset_id from down) then 'CANCELLED' else status end as status from geo_runs
     union all select 999999 + row_number() over (order by dataset_id), dataset_id, 'dataset_' || dataset_id, 'PENDING' from up""",
)
def geography_runs_after_flip(runs, batches):
    """Batches 1, 3 and 4 are rolled back, then 3, 9, 10 and 14 restored; those in the wrong state change nothing."""
    down = geography.runs_after_flip(runs, batches, _ids(runs, 1, 3, 4), False)
    return geography.runs_after_flip(down, batches, _ids(runs, 3, 9, 10, 14), True, 1_000_000).select("run_id", "dataset_id", "scope", "status")





_RESTORED = """with restored as (select e.* exclude (verification_status), coalesce(m.verification_status, e.verification_status) as verification_status from entities e left join manifest m on e.entity_id = m.entity_id), """
_ROLLED = _RESTORED + _STATES.strip().removeprefix("with ").replace("from entities e left join counts", "from restored e left join counts")


@query("entities", "payments", "manifest", oracle=f"{_ROLLED} select entity_id, verification_status, state_id, calculated_status from full_states")
def membership_after_verification_rollback(entities, payments, manifest):
    """Verifications are restored from a manifest, and only its entities are evaluated again."""
    store = _store(entities, "memberships", "entity_id")
    store.load(reevaluation.memberships(entities, payments, RULE, COVERAGE, DAY), 1)
    restored = identity.apply_verification_rollback(entities, manifest)
    reevaluation.refresh_memberships(store, manifest.select("entity_id"), restored, payments, RULE, COVERAGE, DAY, 2)
    schema = reevaluation.memberships(entities, payments, RULE, COVERAGE, DAY).schema
    return store.current(schema).select("entity_id", "verification_status", "state_id", "calculated_status")


@query(
    "payments", "assignments", "batches",
    oracle="""with a as (select p.*, s.entity_id as owner from payments p join assignments s on s.contribution_id = p.contribution_id and s.is_active where p.import_batch_id in (select import_batch_id from batches where status = 'COMPLETED'))
     select owner as entity_id, cast(sum(greatest(amount, 0)) as decimal(22,2)) as given, cast(sum(least(amount, 0)) as decimal(22,2)) as returned, sum(amount) as net, count(*) as n from a group by owner""",
)
def reports_profile_totals_active(payments, assignments, batches):
    """P5: totals of active assignments in completed batches."""
    return reports.profile_totals(membership.active_contributions(payments, assignments, batches))
