"""Registered queries of the roster jobs, each with SQL for comparison where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names, parsing
from ..operators import chapters, geography, identity, ingest, membership, reports
from ..sources import scratch
from .adapters import sql, view

DAY = date(2001, 6, 15)
COVERAGE = membership.Coverage(date(2001, 6, 1))
RULE = membership.Rule(rule_version_id=1)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(*views: str, oracle: str | None = None):
    """Registers a function over the named views under its own name."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(*[view(spark, sf_dir, v) for v in views])
        if oracle:
            SQL[f.__name__] = sql(oracle, *views)
        return f

    return register


# --- ingest ---------------------------------------------------------------------------------------------

HASHED = ["amount_text", "city", "date_text", "employer", "name", "occupation", "state", "street", "txn", "zip"]
_HASH = "sha256(" + " || ".join(f"coalesce('{c}:' || {c}, '')" for c in HASHED) + ")"
_AMOUNT = (
    "case when regexp_full_match(trim(regexp_replace(amount_text, '[$,]', '', 'g')), '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') "
    "then try_cast(trim(regexp_replace(amount_text, '[$,]', '', 'g')) as decimal(12,2)) end"
)
_DATE = "cast(coalesce(try_strptime(date_text, '%Y-%m-%d'), try_strptime(date_text, '%m/%d/%Y'), try_strptime(date_text, '%d/%m/%Y')) as date)"
_TITLES = "^(" + "|".join(names.TITLES) + ")\\b"
_KIND = (
    "case when trim(name) = '' then 'UNKNOWN' when regexp_matches(upper(name), '\\bAND\\b|&|\\bOR\\b|/') then 'JOINT' "
    "when regexp_matches(upper(name), '" + "|".join(rf"\b{w}\b" for w in names.ORGANIZATION_WORDS) + "') then 'ORGANIZATION' else 'INDIVIDUAL' end"
)
_SUFFIXES = "^(" + "|".join(names.SUFFIXES) + ")\\b"
_NAME = f"""
 n1 as (select *, {_KIND} as kind, regexp_replace(upper(name), '[^A-Z0-9_\\s\\-'',]', '', 'g') as clean from raw_rows),
 n2 as (select *, list_filter(string_split_regex(case when contains(clean, ',') then split_part(clean, ',', 1) else clean end, '\\s+'), lambda x: x <> '') as l0,
        list_filter(string_split_regex(case when contains(clean, ',') then substr(clean, instr(clean, ',') + 1) else '' end, '\\s+'), lambda x: x <> '') as f0 from n1),
 n3 as (select *, coalesce(list_position(list_transform(l0, lambda x: not regexp_matches(x, '{_TITLES}')), true), len(l0) + 1) as la,
        coalesce(list_position(list_transform(f0, lambda x: not regexp_matches(x, '{_TITLES}')), true), len(f0) + 1) as fa from n2),
 n4 as (select *, l0[la:] as l1, f0[fa:] as f1 from n3),
 n5 as (select *, len(l1) - coalesce(list_position(list_transform(list_reverse(l1), lambda x: not regexp_matches(x, '{_SUFFIXES}')), true), len(l1) + 1) + 1 as lk,
        len(f1) - coalesce(list_position(list_transform(list_reverse(f1), lambda x: not regexp_matches(x, '{_SUFFIXES}')), true), len(f1) + 1) + 1 as fk from n4),
 n6 as (select *, l1[:lk] as l2, f1[:fk] as f2, coalesce(l1[lk + 1], '') as ls, coalesce(f1[fk + 1], '') as fs from n5),
 n7 as (select *, list_concat(f2, l2) as t, case when fs <> '' then fs else ls end as sx from n6),
 parsed as (select * exclude (kind), kind as entity_type, case when kind in ('ORGANIZATION', 'JOINT') then trim(regexp_replace(upper(name), '\\s+', ' ', 'g')) else array_to_string(t, ' ') end as normalized_name,
        case when kind in ('ORGANIZATION', 'JOINT') or len(t) < 2 then '' else t[1] end as first_name,
        case when kind in ('ORGANIZATION', 'JOINT') or len(t) < 3 then '' else array_to_string(t[2:len(t)-1], ' ') end as middle_name,
        case when kind in ('ORGANIZATION', 'JOINT') or len(t) < 1 then '' else t[len(t)] end as last_name,
        case when kind in ('ORGANIZATION', 'JOINT') then '' else sx end as suffix,
        {_AMOUNT} as amount, {_DATE} as transaction_date, {_HASH} as row_hash from n7)"""
_STATUS = f"""with {_NAME},
 d as (select *, row_number() over (partition by import_batch_id, row_hash order by row_number) > 1 as dup,
   concat_ws('; ', case when name = '' then 'Missing name of contributor.' end, case when amount is null then 'Invalid amount value: ''' || amount_text || '''.' end,
             case when transaction_date is null then 'Invalid date value: ''' || date_text || '''.' end) as message from parsed),
 g as (select *, count(*) over (partition by import_batch_id, txn order by row_number rows between unbounded preceding and 1 preceding) as nt,
   count(*) over (partition by import_batch_id, txn, amount, transaction_date order by row_number rows between unbounded preceding and 1 preceding) as ns,
   count(*) over (partition by import_batch_id, amount, transaction_date, normalized_name, zip order by row_number rows between unbounded preceding and 1 preceding) as nl
   from d where not dup and message = ''),
 s as (select row_number, import_batch_id, case when txn <> '' and ns > 0 then 'POSSIBLE_DUPLICATE' when txn <> '' and nt > 0 then 'POSSIBLE_AMENDMENT'
   when txn = '' and nl > 0 then 'POSSIBLE_DUPLICATE' else 'ACCEPTED' end as validation_status from g
   union all select row_number, import_batch_id, case when dup then 'EXACT_DUPLICATE' else 'VALIDATION_FAILURE' end from d where dup or message <> '')"""


def _checked(rows: DataFrame) -> DataFrame:
    parsed = ingest.with_row_hash(ingest.parse_rows(rows), HASHED)
    return ingest.flag_duplicates(ingest.flag_exact_duplicates(ingest.validate_rows(parsed)))


@query("raw_rows", oracle=f"with {_NAME} select row_number, row_hash, amount, transaction_date from parsed")
def ingest_parse(rows):
    """Row hash, amount and date of each row."""
    return ingest.with_row_hash(ingest.parse_rows(rows), HASHED).select("row_number", "row_hash", "amount", "transaction_date")


@query("raw_rows", oracle=f"with {_NAME} select row_number, entity_type, normalized_name, first_name, middle_name, last_name, suffix from parsed")
def identity_names(rows):
    """R1, R2."""
    n = rows.withColumns({"entity_type": names.entity_type(F.col("name")), "p": names.normalize_name(F.col("name"))})
    return n.select("row_number", "entity_type", F.col("p.full").alias("normalized_name"), F.col("p.first").alias("first_name"), F.col("p.middle").alias("middle_name"), F.col("p.last").alias("last_name"), F.col("p.suffix").alias("suffix"))


@query("raw_rows", oracle=f"{_STATUS} select s.row_number, s.validation_status, case when dup then 'Exact row hash already imported.' else d.message end as validation_message from s join d on s.row_number = d.row_number")
def ingest_statuses(rows):
    """I7-I10."""
    return _checked(rows).select("row_number", "validation_status", "validation_message")


@query(
    "raw_rows",
    oracle=f"""{_STATUS} select d.row_number, case when amount >= 0 then 'CONTRIBUTION' when upper(txn) like 'REF%' then 'REFUND' when upper(txn) like 'REV%' then 'REVERSAL'
     when upper(name) like '%REFUND%' then 'REFUND' when upper(name) like '%REVERSAL%' then 'REVERSAL' else 'ADJUSTMENT' end as transaction_type,
     concat_ws(', ', nullif(street, ''), nullif(city, ''), nullif(state, ''), nullif(zip, '')) as raw_address,
     case when regexp_full_match(zip, '[0-9]{{1,4}}') then lpad(zip, 5, '0') else zip end as zip5
     from d join s on s.row_number = d.row_number where validation_status in ('ACCEPTED', 'POSSIBLE_DUPLICATE', 'POSSIBLE_AMENDMENT')""",
)
def ingest_contributions(rows):
    """I11-I13."""
    return ingest.contributions(_checked(rows)).select("row_number", "transaction_type", "raw_address", "zip5")


@query(
    "raw_rows",
    oracle=f"""{_STATUS} select import_batch_id, count(*) as n_rows, count(*) filter (validation_status in ('ACCEPTED', 'POSSIBLE_DUPLICATE', 'POSSIBLE_AMENDMENT')) as successful,
     count(*) filter (validation_status = 'VALIDATION_FAILURE') as failed, count(*) filter (validation_status = 'EXACT_DUPLICATE') as duplicates from s group by import_batch_id""",
)
def ingest_batch_summary(rows):
    """I14."""
    return ingest.batch_summary(_checked(rows))


@query(
    "raw_rows",
    oracle=f"{_STATUS} select row_number, validation_status from s where validation_status <> 'ACCEPTED'",
)
def ingest_failures(rows):
    """I15."""
    return ingest.import_failures(_checked(rows)).select("row_number", "validation_status")


@query(
    "raw_rows",
    oracle="select import_batch_id, row_number, name from (select *, row_number() over (partition by import_batch_id order by row_number) as n from raw_rows) as x where n <= 5",
)
def ingest_preview(rows):
    """I16."""
    return ingest.import_preview(rows).select("import_batch_id", "row_number", "name")


@query(
    "raw_rows",
    oracle=f"""{_STATUS}, h as (select s.*, row_hash from s join d on s.row_number = d.row_number)
     select *, distinct_hashes - failures as expected, imported - (distinct_hashes - failures) as difference from
     (select import_batch_id, count(*) as n_rows, count(distinct row_hash) as distinct_hashes, count(*) filter (validation_status = 'VALIDATION_FAILURE') as failures,
      count(*) filter (validation_status in ('ACCEPTED', 'POSSIBLE_DUPLICATE', 'POSSIBLE_AMENDMENT')) as imported from h group by import_batch_id) as x""",
)
def ingest_reconcile(rows):
    """I18."""
    return ingest.reconcile_batch(_checked(rows))


@query(
    "assignments",
    oracle="select contribution_id, cluster_id, case when import_batch_id in (2, 5) then false else is_active end as is_active from assignments",
)
def ingest_rollback(assignments):
    """Batches 2 and 5 rolled back."""
    ids = assignments.sparkSession.createDataFrame([(2,), (5,)], "import_batch_id long")
    return ingest.flip_batches(assignments, ids, False)[0].select("contribution_id", "cluster_id", "is_active")


@query(
    "assignments",
    "merge_decisions",
    oracle="""select distinct cluster_id from assignments where import_batch_id <= 4 and cluster_id not in (select cluster_id from assignments where import_batch_id > 4)
     and cluster_id not in (select source_cluster_id from merge_decisions union select target_cluster_id from merge_decisions)""",
)
def ingest_purge_plan(assignments, decisions):
    """Batches 0 to 4 purged."""
    return ingest.purge_plan(assignments, decisions, assignments.sparkSession.range(5).select(F.col("id").alias("import_batch_id")))


@query("batches", oracle="select import_batch_id, file_hash from batches where file_hash not in (select file_hash from batches where status = 'COMPLETED' and import_batch_id < 5)")
def ingest_new_files(batches):
    """Files whose content no completed one of the first batches had."""
    return ingest.block_duplicate_files(batches.select("import_batch_id", "file_hash"), batches.where("import_batch_id < 5")).select("import_batch_id", "file_hash")


# --- identity -------------------------------------------------------------------------------------------


@query("raw_rows")
def identity_clusters(rows):
    """The fold depends on the order of rows, so that tests hold it against brute force on random blocks. Parsed
    rows and clusters are both read twice, and kept."""
    parsed = ingest.parse_rows(rows).withColumn("entity_type", names.entity_type(F.col("name")))
    own = parsed.select(F.col("row_number").cast("string").alias("contribution_id"), F.col("row_number").alias("row_order"), "entity_type", "normalized_name", "zip5", "person.suffix", "person.middle", "employer", "occupation")
    clustered = scratch.keep(identity.cluster_contributions(scratch.keep(own, "rows")), "clustered")
    return clustered.join(identity.cluster_confidence(clustered), "cluster_id")


@query(
    "assignments",
    "merge_decisions",
    oracle="""with m as (select a.*, target_cluster_id, decision_id from assignments a left join merge_decisions d on a.cluster_id = d.source_cluster_id)
     select contribution_id, cluster_id, is_active and target_cluster_id is null as is_active, merge_decision_id from m
     union all select contribution_id, target_cluster_id, true, decision_id from m where is_active and target_cluster_id is not null""",
)
def identity_merge(assignments, decisions):
    """R7."""
    return identity.merge_clusters(assignments, decisions).select("contribution_id", "cluster_id", "is_active", "merge_decision_id")


@query(
    "assignments",
    "merge_decisions",
    oracle="select contribution_id, cluster_id, is_active from assignments",
)
def identity_merge_and_split(assignments, decisions):
    """Merging and undoing it leaves the active assignments as they were; undone rows are left out."""
    own = assignments.withColumn("merge_decision_id", F.lit(None).cast("long"))
    merged = identity.merge_clusters(own, decisions)
    undone = identity.split_clusters(merged, decisions.select("decision_id"))
    return undone.where("merge_decision_id is null").select("contribution_id", "cluster_id", "is_active")


@query(
    "payments",
    "amendments",
    oracle="""select contribution_id, entity_id, amount from payments where contribution_id not in
     (select original_contribution_id from amendments where review_status = 'ACCEPTED' union select replacement_contribution_id from amendments where review_status in ('PENDING', 'REJECTED'))""",
)
def identity_effective(payments, amendments):
    """R9."""
    return identity.effective_contributions(payments, amendments).select("contribution_id", "entity_id", "amount")


@query(
    "amendments",
    oracle="""select 'SELF_REFERENCE' as issue, original_contribution_id as contribution_id from amendments where original_contribution_id = replacement_contribution_id
     union all select 'MULTIPLE_ACCEPTED', original_contribution_id from amendments where review_status = 'ACCEPTED' group by original_contribution_id having count(*) > 1
     union all select 'CYCLE', a.original_contribution_id from amendments a join amendments b on a.replacement_contribution_id = b.original_contribution_id
       and b.replacement_contribution_id = a.original_contribution_id where a.original_contribution_id <> a.replacement_contribution_id""",
)
def identity_amendment_issues(amendments):
    """On these data all cycles are of two."""
    return identity.validate_amendments(amendments)


@query("entities", oracle="select entity_id from entities where verification_status = 'VERIFIED' and (coalesce(verification_method, '') = '' or coalesce(verified_by, '') = '')")
def identity_drift(entities):
    """R11."""
    return identity.verification_drift(entities).select("entity_id")


@query(
    "entities",
    oracle="""select entity_id, case when d then 'UNVERIFIED' else verification_status end as verification_status, case when d then null else verification_method end as verification_method
     from (select *, verification_status = 'VERIFIED' and (coalesce(verification_method, '') = '' or coalesce(verified_by, '') = '') as d from entities) as x""",
)
def identity_unverify(entities):
    """Drifted entities reset."""
    return identity.apply_unverification(entities, identity.verification_drift(entities)).select("entity_id", "verification_status", "verification_method")


# --- membership -----------------------------------------------------------------------------------------

_NET = """net as (select {k}, transaction_date, sum(case when transaction_type = 'CONTRIBUTION' then amount else -abs(amount) end) as net
 from payments group by {k}, transaction_date having sum(case when transaction_type = 'CONTRIBUTION' then amount else -abs(amount) end) > 0),
 gaps as (select *, date_diff('day', lag(transaction_date) over (partition by {k} order by transaction_date), transaction_date) as gap,
 row_number() over (partition by {k} order by transaction_date desc) as rk from net),
 counts as (select {k}, count(*) as n, count(*) filter (gap between 20 and 40) as valid_gaps, count(*) filter (gap between 50 and 80) as skipped_gaps,
 max(transaction_date) as last_payment, sum(net) filter (rk <= 3) as last_three, to_json(list(gap order by transaction_date) filter (gap is not null)) as days from gaps group by {k})"""
_NET_E, _NET_C = _NET.replace("{k}", "entity_id"), _NET.replace("{k}", "cluster_id")
_STATES = f"""with {_NET_E}, base as (select e.*, coalesce(n, 0) as n, valid_gaps + skipped_gaps >= 1 as rec, date_diff('day', last_payment, date '2001-06-15') <= 60 as recent, last_three, days,
 (select count(*) from payments p where p.entity_id = e.entity_id) as contribution_count, (select count(*) from payments p where p.entity_id = e.entity_id and transaction_type <> 'CONTRIBUTION') as refund_count
 from entities e left join counts c on e.entity_id = c.entity_id),
 st as (select *, case when entity_type <> 'INDIVIDUAL' then 'S11' when n = 0 then 'S10' when n = 1 and verification_status = 'VERIFIED' then 'S04' when n = 1 then 'S09'
 when rec and verification_status = 'VERIFIED' and recent then 'S01' when rec and verification_status = 'VERIFIED' then 'S03' when rec then 'S07' when verification_status = 'VERIFIED' then 'S06' else 'S08' end as state_id from base),
 m(state_id, calculated_status, recurrence_pattern_status, membership_authority) as (values {", ".join(f"('{k}', '{v[0]}', '{v[1]}', '{v[2]}')" for k, v in membership.STATES.items())}),
 states as (select st.*, calculated_status, recurrence_pattern_status, membership_authority, least(n, 3) as k3, cast(last_three * 100 as bigint) as cents from st join m on st.state_id = m.state_id),
 full_states as (select *, case when recurrence_pattern_status = 'RECURRING_PATTERN' then
   cast((cents // k3 + case when 2 * (cents % k3) > k3 or (2 * (cents % k3) = k3 and (cents // k3) % 2 = 1) then 1 else 0 end) / 100.0 as decimal(12,2)) else cast(0 as decimal(12,2)) end as recurring_amount from states)"""


_SAID = "case state_id " + " ".join(f"when '{k}' then '{v}'" for k, v in membership.EXPLANATIONS.items() if k != "S11") + " else 'Entity type ' || entity_type || ' is ineligible for membership.' end"


@query("payments", oracle=f"with {_NET_E} select entity_id, transaction_date, net, gap from gaps")
def membership_net_payments(payments):
    """M2, M3."""
    return membership.payment_intervals(membership.net_payments(payments, "entity_id"), "entity_id")


@query(
    "payments",
    "assignments",
    "batches",
    oracle="""select p.contribution_id, a.cluster_id, p.amount from payments p join assignments a on p.contribution_id = a.contribution_id and a.is_active
     where p.import_batch_id in (select import_batch_id from batches where status = 'COMPLETED')""",
)
def membership_active_contributions(payments, assignments, batches):
    """M1."""
    return membership.active_contributions(payments, assignments, batches).select("contribution_id", "cluster_id", "amount")


@query("payments", oracle=f"with {_NET_E} select entity_id, n as n_payments, valid_gaps, skipped_gaps, last_payment, last_three, valid_gaps + skipped_gaps >= 1 as is_recurring from counts")
def membership_recurrence(payments):
    """M4."""
    return membership.recurrence_counts(membership.net_payments(payments, "entity_id"), "entity_id", RULE).drop("interval_days", "other_gaps")


@query(
    "entities",
    "payments",
    oracle=f"""with {_NET_C} select e.cluster_id, case when coalesce(n, 0) = 0 then 'INSUFFICIENT_HISTORY' when n = 1 then 'SINGLE_VISIBLE_CONTRIBUTION' when valid_gaps + skipped_gaps >= 1 then 'POSSIBLE_RECURRING'
     when confidence_level = 'LOW' then 'AMBIGUOUS_IDENTITY_CLUSTER' else 'INSUFFICIENT_HISTORY' end as pattern, coalesce(n, 0) as n_payments, coalesce(valid_gaps, 0) as valid_gaps,
     coalesce(skipped_gaps, 0) as skipped_gaps from entities e left join counts c on e.cluster_id = c.cluster_id""",
)
def membership_cluster_pattern(entities, payments):
    """M5 at each cluster's own last payment."""
    return membership.cluster_pattern(entities.select("cluster_id", "confidence_level"), payments, RULE)


@query(
    "entities",
    "payments",
    oracle=f"""{_STATES} select entity_id, entity_type, verification_status, state_id, calculated_status, recurrence_pattern_status, membership_authority, recurring_amount,
     case when recurrence_pattern_status = 'RECURRING_PATTERN' then 'Monthly' else 'None' end as payment_interval, contribution_count, refund_count,
     case when state_id = 'S11' then 0 else n end as positive_count, case when state_id = 'S11' then null else 14 end as coverage_age_days,
     case when state_id = 'S11' or days is null then '[]' else days end as interval_days, {_SAID} as explanation from full_states""",
)
def membership_states(entities, payments):
    """M6, M7: the flagship."""
    states = membership.membership_state(entities.select("entity_id", "entity_type", "verification_status"), payments, RULE, COVERAGE, DAY)
    return states.withColumns({"interval_days": F.to_json("interval_days"), "explanation": membership.explanation(F.col("state_id"), F.col("entity_type"))})


def _states(entities, payments):
    return membership.membership_state(entities.select("entity_id", "entity_type", "verification_status"), payments, RULE, COVERAGE, DAY)


@query(
    "entities",
    "payments",
    oracle=f"""{_STATES} select entity_id, state_id = 'S01' as is_current_member, state_id = 'S07' as is_provisional_possible, state_id = 'S02' as is_previously_recurring,
     state_id = 'S03' as is_lapsed, state_id = 'S04' as is_one_time, state_id = 'S11' as is_ineligible from states""",
)
def membership_predicates(entities, payments):
    """M10."""
    return membership.membership_predicates(_states(entities, payments))


@query("entities", "payments", oracle=f"{_STATES} select entity_id, state_id as matrix_id from states")
def membership_audit_matrix(entities, payments):
    """Every computed state is an allowed one."""
    return membership.audit_matrix(_states(entities, payments))


@query(
    "assessments",
    "entities",
    oracle="""with x as (select assessment_id as entity_id, entity_type, verification_status, calculated_status, case a.assessment_id % 2 when 0 then 'INSUFFICIENT_HISTORY' else 'RECURRING_PATTERN' end as p,
      case a.assessment_id % 3 when 1 then 'AUTHORITATIVE' else 'PROVISIONAL' end as u from assessments a join entities e on a.entity_id = e.entity_id)
     select entity_id, 'R01' as rule_id from x where calculated_status = 'ACTIVE' and u = 'PROVISIONAL' union all select entity_id, 'R02' from x where calculated_status = 'ACTIVE' and p = 'INSUFFICIENT_HISTORY'
     union all select entity_id, 'R03' from x where calculated_status = 'PROVISIONAL' and u = 'AUTHORITATIVE' union all select entity_id, 'R04' from x where entity_type <> 'INDIVIDUAL'
     union all select entity_id, 'R05' from x where verification_status = 'UNVERIFIED' and u = 'AUTHORITATIVE' union all select entity_id, 'R06' from x where calculated_status in ('ACTIVE', 'LAPSED') and p = 'INSUFFICIENT_HISTORY'""",
)
def membership_rejected(assessments, entities):
    """Over stored rows with patterns and authorities by id; each row counts as an entity of its own."""
    rows = assessments.join(entities.select("entity_id", "entity_type", "verification_status"), "entity_id").withColumns(
        {
            "entity_id": F.col("assessment_id"),
            "recurrence_pattern_status": F.when(F.col("assessment_id") % 2 == 0, "INSUFFICIENT_HISTORY").otherwise("RECURRING_PATTERN"),
            "membership_authority": F.when(F.col("assessment_id") % 3 == 1, "AUTHORITATIVE").otherwise("PROVISIONAL"),
        }
    )
    return membership.rejected_combinations(rows)


@query(
    "entities",
    oracle="""select entity_id, case when entity_id % 6 = 1 then 'ORGANIZATION' else entity_type end as entity_type, case when entity_id % 6 = 1 then null else 'x' end as first_name,
     case when entity_id % 6 = 1 then 'UNKNOWN' else 'ACTIVE' end as membership_status from entities""",
)
def identity_reclassify(entities):
    """A sixth of the entities are corrected to organisations."""
    own = entities.withColumns({c: F.lit("x") for c in ("first_name", "middle_name", "last_name")} | {"membership_status": F.lit("ACTIVE")})
    decisions = entities.where("entity_id % 6 = 1").select("entity_id", F.lit("ORGANIZATION").alias("new_type"), F.lit("named like one").alias("reason"))
    return identity.reclassify_entities(own, decisions)[0].select("entity_id", "entity_type", "first_name", "membership_status")


@query(
    "aliases",
    "places",
    "postal",
    oracle="select a.alias, p.place_id from aliases a join places p on a.place_id = p.place_id",
)
def geography_alias_targets(aliases, places, postal):
    """Aliases by the names of their places."""
    named = places.select(F.col("place_id").alias("id"), "state_code", "name")
    wanted = aliases.select("alias", F.lit("PLACE").alias("target_type"), F.concat(F.lit("nation_"), F.col("place_id")).alias("target"), F.lit("CA").alias("state_code"))
    return geography.resolve_alias_targets(wanted, named.where("false"), named, postal).select("alias", "place_id")


_LATEST = "latest as (select * exclude (rk) from (select *, row_number() over (partition by entity_id order by calculation_date desc, assessment_id desc) as rk from assessments) as x where rk = 1)"


@query("assessments", oracle=f"with {_LATEST} select entity_id, assessment_id, calculation_date, calculated_status from latest")
def membership_latest(assessments):
    """M11."""
    return membership.latest_assessment(assessments).select("entity_id", "assessment_id", "calculation_date", "calculated_status")


@query(
    "entities",
    "payments",
    "assessments",
    oracle=f"""{_STATES}, odd as (select entity_id from entities where is_verified <> (verification_status = 'VERIFIED' and coalesce(verification_method, '') <> 'NONE'))
     select entity_id, calculated_status, recurrence_pattern_status, membership_authority, recurring_amount, {_SAID} as explanation, date '2001-06-15' as calculation_date, 1 as rule_version_id, true as is_current
     from full_states where entity_id not in (select entity_id from odd)
     union all select entity_id, 'UNKNOWN', 'INSUFFICIENT_HISTORY', 'PROVISIONAL', null, 'Verification field inconsistency detected.', date '2001-06-15', 1, true from odd
     union all select entity_id, calculated_status, null, null, recurring_amount, null, calculation_date, null, is_current and entity_id not in (select entity_id from states) from assessments""",
)
def membership_assess(entities, payments, assessments):
    """M9: with entities whose verification fields disagree."""
    odd = entities.where(~membership.consistent())
    new = membership.assess_entities(assessments, _states(entities, payments), DAY, odd, RULE)
    return new.select("entity_id", "calculated_status", "recurrence_pattern_status", "membership_authority", "recurring_amount", "explanation", "calculation_date", "rule_version_id", "is_current")


@query(
    "entities",
    "payments",
    "assessments",
    oracle=f"""{_STATES}, {_LATEST} select l.calculated_status || '->' || s.calculated_status as transition, count(*) as n from latest l join full_states s on l.entity_id = s.entity_id
     group by 1""",
)
def membership_repair_manifest(entities, payments, assessments):
    """Stored against recomputed; the stored rows lack pattern and authority, so that all differ."""
    latest = membership.latest_assessment(assessments).withColumns({c: F.lit(None).cast("string") for c in ("recurrence_pattern_status", "membership_authority", "payment_interval", "rule_version_id")})
    return membership.repair_manifest(membership.audit_recompute(latest, _states(entities, payments).withColumn("rule_version_id", F.lit(1))))


# --- geography ------------------------------------------------------------------------------------------

GEO = ("locations", "places", "aliases", "postal", "postal_place", "place_county", "postal_county")
_GEO = """with loc as (select *, upper(trim(city)) as ucity, case when regexp_matches(zip, '^[0-9]{5}-') then substr(zip, 1, 5) when regexp_full_match(zip, '[0-9]{5}') then zip else '' end as zip5 from locations),
 z as (select loc.*, p.postal_id from loc left join postal p on loc.zip5 = p.postal_code),
 pm as (select location_id, count(*) as np, count(pp.place_id) as npz, min(case when pp.place_id is not null then pl.place_id end) as pid from z join places pl on z.ucity = pl.name and z.state = pl.state_code
   left join postal_place pp on pp.postal_id = z.postal_id and pp.place_id = pl.place_id group by location_id),
 am as (select location_id, count(*) as na, count(pp.place_id) as naz, min(case when pp.place_id is not null then pl.place_id end) as aid from z join aliases a on z.ucity = a.alias join places pl on pl.place_id = a.place_id and z.state = pl.state_code
   left join postal_place pp on pp.postal_id = z.postal_id and pp.place_id = pl.place_id group by location_id),
 pc as (select place_id, count(*) as n, min(county_id) as c from place_county group by place_id),
 zc as (select postal_id, count(*) as n, min(county_id) as c from postal_county group by postal_id),
 w as (select z.*, np, npz, pid, na, naz, aid, pc.n as pn, pc.c as pcounty, ac.n as an, ac.c as acounty, zc.n as zn, zc.c as zcounty from z left join pm on z.location_id = pm.location_id
   left join am on z.location_id = am.location_id left join pc on pc.place_id = pid left join pc ac on ac.place_id = aid left join zc on zc.postal_id = z.postal_id),
 r as (select location_id, entity_id, postal_id, case when npz = 1 and coalesce(pn, 0) > 1 then 'AMBIGUOUS_ZIP' when npz = 1 then 'EXACT_PLACE_ZIP_MATCH' when naz = 1 and an = 1 then 'EXACT_ALIAS_ZIP_MATCH'
   when naz = 1 and an > 1 then 'AMBIGUOUS_ZIP' when zn = 1 and coalesce(np, 0) + coalesce(na, 0) > 0 then 'CONFLICTING_SOURCE_VALUES' when zn = 1 then 'UNIQUE_ZIP_INFERENCE' when zn > 1 then 'AMBIGUOUS_ZIP'
   when np > 0 then 'AMBIGUOUS_PLACE' when na > 0 then 'AMBIGUOUS_ALIAS' else 'NO_REFERENCE_MATCH' end as match_method,
   case when npz = 1 then pid when naz = 1 and an >= 1 then aid end as place_id,
   case when npz = 1 then case when pn = 1 then pcounty end when naz = 1 and an >= 1 then case when an = 1 then acounty end when zn = 1 and coalesce(np, 0) + coalesce(na, 0) = 0 then zcounty end as county_id,
   case when npz = 1 and pn = 1 then 'HIGH' when npz = 1 then 'MEDIUM' when naz = 1 and an = 1 then 'HIGH' when naz = 1 and an > 1 then 'MEDIUM' when zn = 1 and coalesce(np, 0) + coalesce(na, 0) = 0 then 'MEDIUM' else 'LOW' end as confidence,
   case when npz = 1 and pn > 1 then 'PLACE_COUNTY_SPAN' when npz = 1 then null when naz = 1 and an > 1 then 'PLACE_COUNTY_SPAN' when naz = 1 and an = 1 then null when zn > 1 then 'ZIP_COUNTY_MULTIPLE' end as candidate_rule from w)"""


def _resolved(locations, places, aliases, postal, postal_place, place_county, postal_county):
    ref = {"place": places, "alias": aliases, "postal": postal, "postal_place": postal_place, "place_county": place_county, "postal_county": postal_county}
    return geography.resolve_locations(locations, ref), ref


@query(*GEO, oracle=f"{_GEO} select location_id, match_method, place_id, postal_id, county_id, confidence, candidate_rule from r")
def geography_resolve(*tables):
    """G9."""
    return _resolved(*tables)[0]


@query(
    *GEO,
    oracle=f"""{_GEO} select r.location_id, match_method, case when match_method = 'EXACT_ALIAS_ZIP_MATCH' then 'County matched from alias name ''' || ucity || ''' mapping to canonical place ''' || pl.name || ''' and ZIP ''' || zip5 || ''' intersection.'
      when match_method = 'EXACT_PLACE_ZIP_MATCH' and county_id is null then 'Place ''' || pl.name || ''' matched but has no registered county association.'
      when match_method = 'EXACT_PLACE_ZIP_MATCH' then 'County matched from exact place name ''' || pl.name || ''' and ZIP ''' || zip5 || ''' intersection.'
      when candidate_rule = 'PLACE_COUNTY_SPAN' and pl.name <> ucity then 'Alias ''' || ucity || ''' place ''' || pl.name || ''' spans multiple counties; county assignment requires review.'
      when candidate_rule = 'PLACE_COUNTY_SPAN' then 'Place ''' || pl.name || ''' spans multiple counties; county assignment requires review.'
      when match_method = 'CONFLICTING_SOURCE_VALUES' then 'Contradictory geographic values: observed city ''' || city || ''' does not associate with observed ZIP ''' || zip || '''.'
      when match_method = 'UNIQUE_ZIP_INFERENCE' then 'County ''County ' || county_id || ''' inferred through unique association with ZIP ''' || zip5 || '''.'
      when candidate_rule = 'ZIP_COUNTY_MULTIPLE' then 'ZIP ''' || zip5 || ''' is associated with more than one county; county assignment requires review.'
      when match_method = 'AMBIGUOUS_PLACE' then 'Observed city name ''' || city || ''' maps to canonical place, but ZIP ''' || zip || ''' reference was missing or not associated.'
      when match_method = 'AMBIGUOUS_ALIAS' then 'Observed city name ''' || city || ''' maps to geographic alias, but ZIP ''' || zip || ''' reference was missing or not associated.'
      else 'No reference matches found in active datasets for observed city ''' || city || ''' and ZIP ''' || zip || '''.' end as explanation
     from r join loc on loc.location_id = r.location_id left join places pl on pl.place_id = r.place_id""",
)
def geography_explained(*tables):
    """What is said of each resolution."""
    found, ref = _resolved(*tables)
    counties = ref["place_county"].select("county_id").union(ref["postal_county"].select("county_id")).distinct().withColumn("county_name", F.concat(F.lit("County "), F.col("county_id").cast("string")))
    return geography.explain_resolutions(found, tables[0], ref["place"], counties).select("location_id", "match_method", "explanation")


@query(
    *GEO,
    oracle=f"""{_GEO} select location_id, candidate_rule, k.county_id from r join place_county k on k.place_id = r.place_id where candidate_rule = 'PLACE_COUNTY_SPAN'
     union all select location_id, candidate_rule, k.county_id from r join postal_county k on k.postal_id = r.postal_id where candidate_rule = 'ZIP_COUNTY_MULTIPLE'""",
)
def geography_candidates(*tables):
    """G10."""
    return geography.resolution_candidates(*_resolved(*tables))


_RES = "('" + "', '".join(geography.RESOLVED) + "')"


@query(
    *GEO,
    oracle=f"""{_GEO} select count(*) filter (match_method in {_RES}) as resolved, count(*) filter (match_method like '%AMBIGUOUS%') as ambiguous,
     count(*) filter (match_method = 'CONFLICTING_SOURCE_VALUES') as conflicts, count(*) filter (match_method = 'NO_REFERENCE_MATCH') as unmatched from r""",
)
def geography_run_counts(*tables):
    """G11."""
    return geography.resolution_counts(_resolved(*tables)[0])


@query(*GEO, oracle=f"{_GEO} select location_id, case when match_method in {_RES} then county_id end as county_id, case when match_method in {_RES} and (place_id is not null or county_id is not null) then 'UPDATED' else 'SAME' end as cache_change from r")
def geography_cache(*tables):
    """Over locations with an empty cache."""
    empty = tables[0].withColumns({"place_id": F.lit(None).cast("long"), "county_id": F.lit(None).cast("long")})
    current = _resolved(*tables)[0].withColumn("status", F.lit("CURRENT"))
    return geography.location_geo_cache(empty, current).select("location_id", "county_id", "cache_change")


@query(
    "raw_rows",
    oracle="""select row_number, case when zip = '' then null when regexp_full_match(zip, '[0-9]{5}') then zip when regexp_full_match(zip, '[0-9]{1,4}') then null else zip end as zip5,
     case when zip = '' then 'Missing ZIP value' when regexp_full_match(zip, '[0-9]{5}') then null when regexp_full_match(zip, '[0-9]{4}') then 'ZIP ''' || zip || ''' has 4 digits (unauthorized padding)'
     when regexp_full_match(zip, '[0-9]{1,3}') then 'ZIP ''' || zip || ''' is too short and invalid' else 'Unrecognized postal format: ''' || zip || '''' end as warning from raw_rows""",
)
def geography_zip(rows):
    """G1."""
    return rows.select("row_number", parsing.normalize_zip(F.col("zip")).alias("z")).select("row_number", "z.zip5", "z.warning")


# --- chapters -------------------------------------------------------------------------------------------

_MATCH = f"""{_GEO},
 t as (select location_id, 'POSTAL' as target_type, postal_id as target_id from r where postal_id is not null union all select location_id, 'PLACE', place_id from r where place_id is not null
   union all select location_id, 'COUNTY', county_id from r where county_id is not null),
 hit as (select location_id, chapter_id, rule_id, effect, row_number() over (partition by location_id, chapter_id order by case effect when 'EXCLUDE' then 0 else 3 end
   + case t.target_type when 'POSTAL' then 0 when 'PLACE' then 1 else 2 end) as k from t join (select chapter_id, effect, target_type, target_id, max(rule_id) as rule_id from rules group by all) u
   on t.target_type = u.target_type and t.target_id = u.target_id),
 ma as (select ch.chapter_id, r.location_id, r.entity_id, r.match_method, case when h.effect = 'EXCLUDE' then 'EXCLUDED_BY_RULE' when h.effect = 'INCLUDE' then 'INCLUDED_BY_RULE'
   when r.match_method like '%AMBIGUOUS%' then 'AMBIGUOUS_GEOGRAPHY' else 'NO_RULE_MATCH' end as outcome, h.rule_id
   from r cross join (select distinct chapter_id from rules) ch left join hit h on h.location_id = r.location_id and h.chapter_id = ch.chapter_id and h.k = 1)"""
CHAPTER = (*GEO, "rules")
_RESULT = f"""{_MATCH},
 se as (select chapter_id, entity_id, count(*) as nr, count(distinct outcome || ':' || coalesce(cast(rule_id as varchar), '-')) as nd,
   min(outcome) as outcome, min(rule_id) as rule_id, min(location_id) as location_id,
   '[' || string_agg(distinct format('(''{{}}'', {{}})', outcome, coalesce(cast(rule_id as varchar), 'None')), ', ' order by format('(''{{}}'', {{}})', outcome, coalesce(cast(rule_id as varchar), 'None'))) || ']' as outcomes
   from ma where location_id % 17 <> 16 group by chapter_id, entity_id),
 ov as (select chapter_id, entity_id, max(override_type) as override_type, max(reason) as reason from overrides where expiration_date >= date '2001-06-15' group by chapter_id, entity_id),
 x as (select ch.chapter_id, e.entity_id, e.entity_type, e.verification_status, override_type, case when e.entity_type <> 'INDIVIDUAL' then 'INELIGIBLE_ENTITY_TYPE' when se.nr is null and e.entity_id in (select entity_id from locations) then 'NO_CURRENT_RESOLVED_LOCATION' when se.nr is null then 'NO_CURRENT_LOCATION' when nd > 1 then 'AMBIGUOUS_LOCATION'
   when nr = 1 then 'SELECTED' else 'MULTIPLE_EQUIVALENT' end as selection_status, case when nd = 1 then outcome end as outcome, case when nd = 1 then rule_id end as rule_id, location_id, outcomes, reason
   from entities e cross join (select distinct chapter_id from rules) ch left join se on se.chapter_id = ch.chapter_id and se.entity_id = e.entity_id left join ov on ov.chapter_id = ch.chapter_id and ov.entity_id = e.entity_id),
 y as (select *, case when entity_type <> 'INDIVIDUAL' then 'INELIGIBLE_ENTITY_TYPE' when override_type = 'EXCLUDE' then 'MANUALLY_EXCLUDED' when override_type = 'INCLUDE' then 'MANUALLY_INCLUDED'
   when selection_status not in ('SELECTED', 'MULTIPLE_EQUIVALENT') then selection_status when outcome = 'INCLUDED_BY_RULE' and verification_status <> 'VERIFIED' then 'PROVISIONAL_GEOGRAPHIC_MATCH' else outcome end as result_status from x),
 res as (select chapter_id, entity_id, selection_status, result_status, case {" ".join(f"when result_status = '{k}' then '{v}'" for k, v in chapters.ASSIGNMENT.items())} else 'NO_MATCH' end as assignment_status,
   case when result_status in ('INELIGIBLE_ENTITY_TYPE', 'MANUALLY_EXCLUDED', 'MANUALLY_INCLUDED', 'INCLUDED_BY_RULE', 'EXCLUDED_BY_RULE') then 'HIGH' when result_status = 'PROVISIONAL_GEOGRAPHIC_MATCH' then 'MEDIUM' else 'LOW' end as confidence,
   case when result_status in ('INCLUDED_BY_RULE', 'EXCLUDED_BY_RULE', 'PROVISIONAL_GEOGRAPHIC_MATCH') then rule_id end as rule_id,
   entity_type, location_id, outcome, outcomes, reason from y)"""
RESULT = (*CHAPTER, "overrides", "entities")


def _matched(*tables):
    *geo, rules = tables
    r = _resolved(*geo)[0].join(geo[0].select("location_id", "entity_id"), "location_id").withColumn("postal_type", F.lit("USPS_ZIP5"))
    return chapters.match_rules(r, rules)


def _results(*tables):
    """Of the locations each seventeenth has no current resolution."""
    *rest, overrides, entities = tables
    matched = _matched(*rest).where("location_id % 17 <> 16")
    return chapters.evaluate_chapters(entities, matched, chapters.active_overrides(overrides, DAY), rest[0], rest[-1])


@query(*CHAPTER, oracle=f"{_MATCH} select chapter_id, location_id, outcome, rule_id from ma")
def chapters_match(*tables):
    """C1."""
    return _matched(*tables).select("chapter_id", "location_id", "outcome", "rule_id")


@query(*RESULT, oracle=f"{_RESULT} select chapter_id, entity_id, selection_status, result_status, assignment_status, confidence, rule_id from res")
def chapters_results(*tables):
    """C2-C4."""
    return _results(*tables).drop("evidence")


@query(
    *RESULT,
    oracle=f"""{_RESULT}, said as (select *, case selection_status when 'INELIGIBLE_ENTITY_TYPE' then 'Entity type ''' || entity_type || ''' is ineligible for chapter membership.'
      when 'NO_CURRENT_LOCATION' then 'Entity has no registered current locations.' when 'NO_CURRENT_RESOLVED_LOCATION' then 'None of the entity''s current locations have current resolutions.'
      when 'AMBIGUOUS_LOCATION' then 'Conflicting location outcomes detected: ' || outcomes else 'Selected location ' || location_id || ' yielding outcome ' || outcome || '.' end as selection_explanation from res)
     select chapter_id, entity_id, result_status, selection_explanation, case result_status when 'INELIGIBLE_ENTITY_TYPE' then 'Ineligible entity type.' when 'MANUALLY_EXCLUDED' then 'Excluded by manual override. Reason: ' || reason
      when 'MANUALLY_INCLUDED' then 'Included by manual override. Reason: ' || reason when 'AMBIGUOUS_LOCATION' then 'Geographic evaluation is ambiguous due to conflicting current locations.'
      when 'NO_CURRENT_LOCATION' then selection_explanation when 'NO_CURRENT_RESOLVED_LOCATION' then selection_explanation when 'EXCLUDED_BY_RULE' then 'Excluded by rule ' || rule_id || '.'
      when 'INCLUDED_BY_RULE' then 'Included by rule ' || rule_id || '.' when 'PROVISIONAL_GEOGRAPHIC_MATCH' then 'Included by rule ' || rule_id || '.'
      when 'AMBIGUOUS_GEOGRAPHY' then 'Matched zip reference has ambiguous outcomes or candidates.' else 'No matching rules found in active ruleset.' end as explanation from said""",
)
def chapters_explained(*tables):
    """What is said of selections and results."""
    return chapters.explain_results(_results(*tables)).select("chapter_id", "entity_id", "result_status", "selection_explanation", "explanation")


@query(
    *RESULT,
    oracle=f"""{_RESULT} select chapter_id, count(*) as considered, count(*) filter (assignment_status in ('INCLUDED', 'PROVISIONALLY_INCLUDED')) as included, count(*) filter (assignment_status = 'EXCLUDED') as excluded,
     count(*) filter (assignment_status = 'AMBIGUOUS') as ambiguous, count(*) filter (assignment_status in ('UNRESOLVED', 'INELIGIBLE', 'NO_MATCH')) as unresolved from res group by chapter_id""",
)
def chapters_run_counts(*tables):
    """C7."""
    return chapters.run_counts(_results(*tables))


@query(*RESULT, oracle=f"{_RESULT} select chapter_id, entity_id, rule_id from res where rule_id is not null")
def chapters_rule_matches(*tables):
    """C6."""
    return chapters.rule_matches(_results(*tables))


@query(*RESULT, oracle=f"{_RESULT} select chapter_id, assignment_status, count(*) as n from res group by all")
def chapters_assignment_counts(*tables):
    """C11."""
    return chapters.assignment_counts(_results(*tables))


@query(
    *RESULT,
    oracle=f"""{_RESULT}, i as (select * from res where assignment_status in ('INCLUDED', 'PROVISIONALLY_INCLUDED'))
     select a.chapter_id as chapter_a, b.chapter_id as chapter_b, count(*) as shared from i a join i b on a.entity_id = b.entity_id and a.chapter_id < b.chapter_id group by all""",
)
def chapters_overlap_pairs(*tables):
    """C12, C13."""
    return chapters.overlap_pairs(_results(*tables))


@query(
    *RESULT,
    "assessments",
    oracle=f"{_RESULT}, {_LATEST} select chapter_id, res.entity_id, result_status, calculated_status as membership_status from res left join latest on latest.entity_id = res.entity_id",
)
def chapters_snapshot(*tables):
    """C5."""
    *rest, assessments = tables
    return chapters.membership_snapshot(_results(*rest), membership.latest_assessment(assessments)).select("chapter_id", "entity_id", "result_status", "membership_status")


# --- reports and checks ---------------------------------------------------------------------------------


@query(
    "entities",
    "assessments",
    oracle=f"""with {_LATEST}, b(status) as (values {", ".join(f"('{s}')" for s in reports.STATUSES)}),
     c as (select calculated_status as status, count(*) as n from entities e join latest l on e.entity_id = l.entity_id where entity_type = 'INDIVIDUAL' group by 1)
     select b.status, coalesce(n, 0) as n from b left join c on b.status = c.status""",
)
def reports_status_breakdown(entities, assessments):
    """P2."""
    return reports.status_breakdown(entities, membership.latest_assessment(assessments))


_COUNTED = "counted as (select * from payments where status = 'ACTIVE' and import_batch_id in (select import_batch_id from batches where status = 'COMPLETED'))"


@query(
    "entities",
    "payments",
    "batches",
    "assessments",
    "locations",
    oracle=f"""with {_LATEST}, {_COUNTED}, t as (select entity_id, sum(amount) as total, max(transaction_date) as last_date, count(*) as n from counted group by entity_id),
     pl as (select entity_id, arg_min(city, location_id) as city, arg_min(zip, location_id) as zip from locations where location_id % 13 <> 5 group by entity_id)
     select e.entity_id, display_name, coalesce(calculated_status, 'UNKNOWN') as status, coalesce(recurring_amount, 0) as recurring_amount, coalesce(total, 0) as total, last_date, coalesce(n, 0) as n,
     coalesce(city, '') as city, coalesce(zip, '') as zip from entities e left join latest l on e.entity_id = l.entity_id
     left join t on t.entity_id = e.entity_id left join pl on pl.entity_id = e.entity_id where entity_type = 'INDIVIDUAL'""",
)
def reports_people(entities, payments, batches, assessments, locations):
    """Of the locations each thirteenth is a former one."""
    placed = locations.withColumn("status", F.when(F.col("location_id") % 13 == 5, "FORMER").otherwise("CURRENT"))
    return reports.people_directory(entities, payments, batches, membership.latest_assessment(assessments), placed)


# What is searched for: in names, places, ZIP codes, employers, occupations, transaction numbers; cut at words, in
# either case, of one and two characters, and in none.
PATTERNS = ["on_1", "ANN7", "lee2", "customer#", "0000001", "9000", "bra", "KENYA", "emp 1", "urgent", "1-u", "t12", "7", "zz", "t ", "#", "", "no such thing"]


@query(
    "entities",
    "payments",
    "locations",
    oracle=f"""with p(pattern) as (values {", ".join(f"('{x}')" for x in PATTERNS)}),
     v as (select entity_id, unnest([display_name, first_name, last_name]) as value from entities union select entity_id, unnest([zip, city]) from locations union select entity_id, unnest([employer, occupation, txn]) from payments)
     select distinct pattern, v.entity_id from v join p on pattern <> '' and contains(lower(value), lower(pattern)) where v.entity_id in (select entity_id from entities where entity_type = 'INDIVIDUAL')""",
)
def reports_search(entities, payments, locations):
    """Many patterns at once, by the index."""
    spark = entities.sparkSession
    path = f"{scratch.folder(spark)}/tallyforge/people-{uuid.uuid4().hex}"
    reports.search_index(entities, payments, locations).write(path)
    return reports.people_search(reports.SearchIndex.read(spark, path), spark.createDataFrame([(x,) for x in PATTERNS], "pattern string"))


@query("payments", oracle="select entity_id, cast(sum(greatest(amount, 0)) as decimal(22,2)) as given, cast(sum(least(amount, 0)) as decimal(22,2)) as returned, sum(amount) as net, count(*) as n from payments group by entity_id")
def reports_profile_totals(payments):
    """P5."""
    return reports.profile_totals(payments)


@query("entities", "assessments", oracle=f"with {_LATEST} select e.entity_id, display_name, coalesce(calculated_status, 'UNKNOWN') as status from entities e left join latest l on e.entity_id = l.entity_id where entity_type = 'INDIVIDUAL'")
def reports_export(entities, assessments):
    """P6."""
    return reports.export_roster(entities, membership.latest_assessment(assessments))


@query(
    "entities",
    "payments",
    "batches",
    "raw_rows",
    oracle=f"""{_STATUS}, {_COUNTED} select (select count(*) from counted) as n_contributions, (select coalesce(sum(amount), 0) from counted) as total_amount,
     (select count(*) from entities where entity_type = 'INDIVIDUAL') as n_individuals,
     (select count(*) from s where validation_status = 'VALIDATION_FAILURE') as n_failed, (select count(*) from s where validation_status = 'EXACT_DUPLICATE') as n_duplicates""",
)
def reports_dashboard(entities, payments, batches, rows):
    """P1."""
    return reports.dashboard_metrics(payments, batches, entities, _checked(rows))


@query("batches", oracle="select import_batch_id, status, imported_at from batches order by imported_at desc, import_batch_id desc limit 5")
def reports_last_imports(batches):
    """The newest five imports, whatever their status."""
    return reports.last_imports(batches).select("import_batch_id", "status", "imported_at")


@query(
    "payments",
    "assignments",
    "batches",
    oracle="""select a.entity_id, row_number() over (partition by a.entity_id order by transaction_date desc, p.contribution_id desc) as place, p.contribution_id, transaction_date, amount,
     case when p.contribution_id % 3 = 0 then '' else 'given ' || cast(p.contribution_id as varchar) end as raw_name from payments p join assignments a on a.contribution_id = p.contribution_id and a.is_active
     where p.import_batch_id in (select import_batch_id from batches where status = 'COMPLETED')""",
)
def reports_timeline(payments, assignments, batches):
    """P5: of a third of the contributions the raw name is not known."""
    names_given = payments.where("contribution_id % 3 <> 0").select("contribution_id", F.concat(F.lit("given "), F.col("contribution_id").cast("string")).alias("raw_name"))
    return reports.profile_timeline(payments, assignments, batches, names_given)


