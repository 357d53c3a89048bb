"""Queries of audits: stored states against recomputed ones, as they are now and as they were."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import membership
from .queries import _NET_E, COVERAGE, query

CURRENT = 3
AUDIT = ("stored_assessments", "entities", "payments", "rule_versions")
_NAMES = {k: v for k, v in membership.STATES.items()}
_MATRIX = "case " + " ".join(
    f"when entity_type {'<>' if k == 'S11' else '='} 'INDIVIDUAL' "
    + ("" if k in ("S10", "S11") else f"and verification_status = '{'UNVERIFIED' if k in ('S07', 'S08', 'S09') else 'VERIFIED'}' ")
    + f"and calculated_status = '{s}' and recurrence_pattern_status = '{p}' and membership_authority = '{a}' then '{k}'"
    for k, (s, p, a) in _NAMES.items()
) + " else 'UNMATCHED' end"
_BOUNDS = " or ".join(f"(stored_matrix = '{k}' and ({f'np < {low}' if high is None else f'np not between {low} and {high}'}))" for k, (low, high) in membership.COUNTS.items())


def _audit_sql(upto: str) -> str:
    pick = lambda i: "case s " + " ".join(f"when '{k}' then '{v[i]}'" for k, v in _NAMES.items()) + " end"
    same = lambda side: ", ".join(
        f"case when {x} is distinct from {y} then '{name}' end"
        for name, x, y in (
            ("calculated_status", "o.calculated_status", f"{side}.calculated_status"),
            ("recurrence_pattern_status", "o.recurrence_pattern_status", f"{side}.recurrence_pattern_status"),
            ("membership_authority", "o.membership_authority", f"{side}.membership_authority"),
            ("recurring_amount", "coalesce(o.recurring_amount, 0)", f"{side}.amount"),
            ("payment_interval", "nullif(nullif(o.payment_interval, ''), 'None')", f"{side}.payment_interval"),
            ("rule_version_id", "o.rule_version_id", f"{side}.rid"),
        )
    )
    return f"""with {_NET_E}, own as (select a.*, e.entity_type, e.verification_status from stored_assessments a join entities e on a.entity_id = e.entity_id where a.is_current),
 req as (select assessment_id, entity_id, entity_type, verification_status, false as history, 3::bigint as rid, date '2001-06-01' as day, null::date as upto from own
   union all select assessment_id, entity_id, entity_type, verification_status, true, coalesce(rule_version_id, 3), coalesce(calculation_date, date '2001-06-01'), {upto} from own),
 facts as (select q.assessment_id, q.history, any_value(q.entity_type) as entity_type, any_value(q.verification_status) = 'VERIFIED' as ver, any_value(q.rid) as rid, any_value(q.day) as day,
   any_value(r.min_recurring_payments) as least_n, any_value(r.active_grace_period) as grace, count(g.transaction_date) as n,
   count(*) filter (g.gap between r.monthly_interval_min and r.monthly_interval_max or (r.skip_payment_allowed and g.gap between 50 and 80)) as reg,
   max(g.transaction_date) as lastp, list(g.net order by g.transaction_date desc) filter (g.net is not null) as nets
   from req q join rule_versions r on r.rule_version_id = q.rid left join gaps g on g.entity_id = q.entity_id and (q.upto is null or g.transaction_date <= q.upto) group by q.assessment_id, q.history),
 st as (select *, case when entity_type <> 'INDIVIDUAL' then 'S11' when n = 0 then 'S10' when n = 1 and ver and date_diff('day', date '2001-06-01', day) <= 60 then 'S04' when n = 1 and ver then 'S05' when n = 1 then 'S09'
   when reg >= least_n - 1 and ver and date_diff('day', lastp, day) <= grace then 'S01' when reg >= least_n - 1 and ver and date_diff('day', date '2001-06-01', day) > 60 then 'S02'
   when reg >= least_n - 1 and ver then 'S03' when reg >= least_n - 1 then 'S07' when ver then 'S06' else 'S08' end as s,
   cast(list_sum(nets[1:3]) * 100 as bigint) as cents, least(n, 3) as k3 from facts),
 made as (select assessment_id, history, s, rid, {pick(0)} as calculated_status, {pick(1)} as recurrence_pattern_status, {pick(2)} as membership_authority,
   case when s in ('S01', 'S02', 'S03', 'S07') then cast((cents // k3 + case when 2 * (cents % k3) > k3 or (2 * (cents % k3) = k3 and (cents // k3) % 2 = 1) then 1 else 0 end) / 100.0 as decimal(12,2))
     else cast(0 as decimal(12,2)) end as amount, case when s in ('S01', 'S02', 'S03', 'S07') then 'Monthly' end as payment_interval from st),
 pos as (select entity_id, count(*) as np from payments where transaction_type = 'CONTRIBUTION' and amount > 0 group by entity_id),
 m as (select o.*, {_MATRIX} as stored_matrix, coalesce(np, 0) as np from own o left join pos on pos.entity_id = o.entity_id),
 audit as (select o.assessment_id, o.entity_id, o.entity_type, stored_matrix, r.s as repair_matrix, stored_matrix <> 'UNMATCHED' as tuple_match, not ({_BOUNDS}) as evidence_match,
   concat_ws(',', {same("r")}) as repair_diffs, concat_ws(',', {same("h")}) as history_diffs,
   case when concat_ws(',', {same("h")}) = '' then 'HISTORICAL_MATCH' when o.rule_version_id is null and o.calculation_date is null then 'INSUFFICIENT_HISTORICAL_EVIDENCE'
     else 'BEST_EFFORT_RECONSTRUCTION_MISMATCH' end as classification,
   o.calculated_status as before_status, r.calculated_status as after_status, coalesce(o.recurrence_pattern_status, 'None') as before_pattern, r.recurrence_pattern_status as after_pattern,
   o.membership_authority as before_authority, r.membership_authority as after_authority
   from m o join made r on r.assessment_id = o.assessment_id and not r.history join made h on h.assessment_id = o.assessment_id and h.history)"""


_AUDIT, _AS_OF = _audit_sql("null"), _audit_sql("coalesce(calculation_date, date '2001-06-01')")
_SHOWN = "assessment_id, entity_id, stored_matrix, repair_matrix, tuple_match, evidence_match, repair_diffs, history_diffs, classification"


def _audit(assessments, entities, payments, rules, as_of=False):
    return membership.audit_states(assessments, entities, payments, rules, CURRENT, COVERAGE, as_of)


def _shown(audit):
    return audit.selectExpr("assessment_id", "entity_id", "stored_matrix", "repair_matrix", "tuple_match", "evidence_match", "array_join(repair_diffs, ',') as repair_diffs", "array_join(history_diffs, ',') as history_diffs", "classification")


@query(*AUDIT, oracle=f"{_AUDIT} select {_SHOWN} from audit")
def membership_audit(*tables):
    """Every current assessment under the rule in force, and under its own rule on its own day."""
    return _shown(_audit(*tables))


@query(*AUDIT, oracle=f"{_AS_OF} select {_SHOWN} from audit")
def membership_audit_as_of(*tables):
    """As membership_audit, but payments after an assessment's day do not count for its history."""
    return _shown(_audit(*tables, as_of=True))


_FIELD = lambda f: f"list_contains(string_split(repair_diffs, ','), '{f}')"
_COUNTERS = {
    "total_assessments": "true", "matrix_tuple_violations": "not tuple_match", "evidence_context_violations": "not evidence_match", "historical_parity_mismatches": "history_diffs <> ''",
    "current_repair_mismatches": "repair_diffs <> ''", "fully_matching": "repair_diffs = '' and tuple_match and evidence_match", **{f"field:{f}": _FIELD(f) for f in membership.DIFF_FIELDS},
    **{f"history:{k}": f"classification = '{k}'" for k in ("HISTORICAL_MATCH", "BEST_EFFORT_RECONSTRUCTION_MISMATCH", "INSUFFICIENT_HISTORICAL_EVIDENCE")},
}


@query(*AUDIT, oracle=_AUDIT + " " + " union all ".join(f"select '{k}' as counter, count(*) filter ({v}) as n from audit" for k, v in _COUNTERS.items()))
def membership_audit_summary(*tables):
    """The audit's counters."""
    return membership.audit_summary(_audit(*tables))


_SECTIONS = [
    ("'examined'", "'total'", "true"), ("'entity_type'", "entity_type", "true"), ("'rows'", "case when repair_diffs = '' then 'unchanged' else 'replaced' end", "true"),
    ("'calculated_status'", "before_status || '->' || after_status", _FIELD("calculated_status")), ("'recurrence_pattern_status'", "before_pattern || '->' || after_pattern", _FIELD("recurrence_pattern_status")),
    ("'membership_authority'", "before_authority || '->' || after_authority", _FIELD("membership_authority")),
    *[("'changed'", f"'{f}'", _FIELD(f)) for f in membership.DIFF_FIELDS[3:]], ("'matrix_state'", "stored_matrix || '->' || repair_matrix", "repair_diffs <> ''"),
]


@query(*AUDIT, oracle=_AUDIT + " select section, item, count(*) as n from (" + " union all ".join(f"select {s} as section, {i} as item from audit where {w}" for s, i, w in _SECTIONS) + ") as x group by section, item")
def membership_repair_sections(*tables):
    """All sections of the repair manifest."""
    return membership.repair_summary(_audit(*tables))


@query(
    *AUDIT,
    oracle=f"""{_AUDIT} select entity_id, assessment_id as current_assessment_id, before_status, after_status, stored_matrix as matrix_state_before, repair_matrix as matrix_state_after, 'STATE_MISMATCH' as reason_code,
     before_status <> after_status as chapter_reevaluation_needed, repair_diffs as changed_fields from audit where repair_diffs <> ''""",
)
def membership_repair_records(*tables):
    """What repair replaces, row by row."""
    rows = membership.repair_records(_audit(*tables)).withColumn("changed_fields", F.array_join("changed_fields", ","))
    return rows.drop("entity_type", "before_pattern", "after_pattern", "before_authority", "after_authority")
