"""Canonical inputs from the order tables, as SQL that both Spark and an ANSI engine run.

Each view is a template over the tables that it names in braces; views may use views before them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS: dict[str, str] = {
    "payments": """
        select o_orderkey as contribution_id, o_custkey as entity_id, o_custkey as cluster_id, cast(o_orderdate as date) as transaction_date,
               cast(o_totalprice as decimal(12,2)) as amount, o_orderkey % 10 as import_batch_id,
               case when o_orderstatus = 'P' and o_orderkey % 5 = 0 then 'REFUND' when o_orderstatus = 'P' and o_orderkey % 7 = 0 then 'ADJUSTMENT'
                    else 'CONTRIBUTION' end as transaction_type,
               case when o_orderkey % 4 = 0 then '' else 'T' || cast(o_orderkey % 6007 as string) end as txn,
               'EMP ' || cast(o_custkey % 17 as string) as employer, o_orderpriority as occupation,
               case when o_orderkey % 17 = 3 then 'SUPERSEDED' else 'ACTIVE' end as status
        from {orders}""",
    "entities": """
        select c_custkey as entity_id, c_custkey as cluster_id, c_name as display_name,
               case c_custkey % 10 when 0 then 'ORGANIZATION' when 1 then 'JOINT' else 'INDIVIDUAL' end as entity_type,
               case when c_custkey % 3 = 0 then 'UNVERIFIED' else 'VERIFIED' end as verification_status,
               case when c_custkey % 21 = 1 then null when c_custkey % 3 = 0 then null else 'ADMIN_REVIEW' end as verification_method,
               case when c_custkey % 33 = 1 then '' else 'staff' end as verified_by,
               case c_custkey % 4 when 0 then 'HIGH' when 1 then 'MEDIUM' else 'LOW' end as confidence_level,
               case when c_custkey % 10 > 1 then 'Ann' || cast(c_custkey % 101 as string) end as first_name, case when c_custkey % 10 > 1 then 'Lee' || cast(c_custkey % 203 as string) end as last_name,
               (c_custkey % 3 <> 0) <> (c_custkey % 29 = 3) as is_verified, case when c_custkey % 27 <> 5 then '2001-01-01' end as verified_at
        from {customer}""",
    "batches": """
        select import_batch_id, case when import_batch_id = 9 then 'ROLLED_BACK' else 'COMPLETED' end as status, 'h' || cast(import_batch_id % 8 as string) as file_hash,
               n as n_rows, import_batch_id % 4 as imported_at from (select o_orderkey % 10 as import_batch_id, count(*) as n from {orders} group by o_orderkey % 10) as b""",
    "assignments": """
        select o_orderkey as contribution_id, o_custkey as cluster_id, o_custkey as entity_id, o_orderkey % 10 as import_batch_id, o_orderkey % 23 <> 0 as is_active,
               o_orderkey as assignment_id, o_orderkey % 1000 as assigned_at, case when o_orderkey % 19 = 0 then o_custkey % 5 else null end as merge_decision_id
        from {orders}""",
    "merge_decisions": """
        select c_custkey as decision_id, c_custkey as source_cluster_id, c_custkey + 1 as target_cluster_id from {customer} where c_custkey % 50 = 7""",
    "amendments": """
        select o_orderkey as amendment_id, o_orderkey as original_contribution_id,
               case when o_orderkey % 400 = 0 then o_orderkey when o_orderkey % 400 = 200 then o_orderkey - 100 else o_orderkey + 100 end as replacement_contribution_id,
               case o_orderkey % 3 when 0 then 'PENDING' when 1 then 'ACCEPTED' else 'REJECTED' end as review_status
        from {orders} where o_orderkey % 100 = 0""",
    "raw_rows": """
        select o.o_orderkey % 7 as import_batch_id, o.o_orderkey as row_number,
               case when c_custkey % 41 = 0 then '' when c_custkey % 11 = 0 then 'Friends of ' || n_name when c_custkey % 13 = 0 then 'Pat & Sam ' || n_name
                    when c_custkey % 7 = 0 then 'Dr. Smith' || cast(c_custkey as string) || ', John Q. Jr.' when c_custkey % 5 = 0 then 'Ms. Ann  Marie Lee' || cast(c_custkey as string)
                    when c_custkey % 3 = 0 then 'Lee' || cast(c_custkey as string) || ', Kim' else 'Solo' || cast(c_custkey as string) end as name,
               case when o.o_orderkey % 37 = 0 then 'abc' when o.o_orderkey % 31 = 0 then '' when o.o_orderkey % 29 = 0 then '-$' || cast(cast(o_totalprice as decimal(12,2)) as string)
                    when o.o_orderkey % 5 = 0 then '$' || cast(cast(o_totalprice as decimal(12,2)) as string) else cast(cast(o_totalprice as decimal(12,2)) as string) end as amount_text,
               case when o.o_orderkey % 43 = 0 then '02/31/1999' when o.o_orderkey % 3 = 0
                    then cast(month(o_orderdate) as string) || '/' || cast(day(o_orderdate) as string) || '/' || cast(year(o_orderdate) as string)
                    else cast(cast(o_orderdate as date) as string) end as date_text,
               case when o.o_orderkey % 4 = 0 then '' when o.o_orderkey % 29 = 0 and o.o_orderkey % 2 = 1 then 'REF' || cast(o.o_orderkey as string)
                    else 'T' || cast(o.o_orderkey % 9001 as string) end as txn,
               cast(c_custkey % 100000 as string) as zip, n_name as city, 'CA' as state, case when c_custkey % 6 = 0 then '' else cast(c_custkey as string) || ' Main St' end as street,
               'Emp' || cast(c_custkey % 9 as string) as employer, o_orderpriority as occupation
        from {orders} o join {customer} c on o.o_custkey = c.c_custkey join {nation} n on c.c_nationkey = n.n_nationkey
        union all
        select o_orderkey % 7, o_orderkey + 10000000, 'Twice ' || cast(o_orderkey % 50 as string), '10.00', '2001-01-0' || cast(1 + o_orderkey % 3 as string), '', '90001', 'X', 'CA', '', '', ''
        from {orders} where o_orderkey % 10 = 3""",
    "locations": """
        select c_custkey as location_id, c_custkey % 1200 as entity_id,
               case when c_custkey % 9 = 0 then 'OLD ' || n_name when c_custkey % 14 = 0 then 'NOWHERE' else lower(n_name) end as city, 'CA' as state,
               case when c_custkey % 25 = 0 then '2138' when c_custkey % 8 = 0 then lpad(cast(90000 + n_nationkey as string), 5, '0') || '-1234'
                    else cast(90000 + (n_nationkey + case when c_custkey % 6 = 0 then 1 else 0 end) % 30 as string) end as zip
        from {customer} join {nation} on c_nationkey = n_nationkey""",
    "places": "select cast(n_nationkey as bigint) as place_id, n_name as name, 'CA' as state_code from {nation} where n_nationkey <> 20",
    "aliases": "select 'OLD ' || n_name as alias, cast(n_nationkey as bigint) as place_id from {nation} where n_nationkey % 2 = 0",
    "postal": "select cast(n_nationkey as bigint) as postal_id, cast(90000 + n_nationkey as string) as postal_code from {nation} where n_nationkey <> 3",
    "postal_place": "select cast(n_nationkey as bigint) as postal_id, cast(n_nationkey as bigint) as place_id from {nation} where n_nationkey % 6 <> 5",
    "place_county": """
        select cast(n_nationkey as bigint) as place_id, cast(n_regionkey as bigint) as county_id from {nation} where n_nationkey % 7 <> 6
        union all select cast(n_nationkey as bigint), cast(10 + n_regionkey as bigint) from {nation} where n_nationkey % 8 = 1""",
    "postal_county": """
        select cast(n_nationkey as bigint) as postal_id, cast(n_regionkey as bigint) as county_id from {nation} where n_nationkey % 9 <> 8
        union all select cast(n_nationkey as bigint), cast(20 + n_regionkey as bigint) from {nation} where n_nationkey % 5 = 2""",
    "rules": """
        select chapter_id, chapter_id * 1000 + cast(n_nationkey as bigint) as rule_id, case when (n_nationkey + chapter_id) % 5 = 0 then 'EXCLUDE' else 'INCLUDE' end as effect,
               case cast(n_nationkey as bigint) % 3 when 0 then 'POSTAL' when 1 then 'PLACE' else 'COUNTY' end as target_type,
               case when n_nationkey % 3 = 2 then cast(n_regionkey as bigint) else cast(n_nationkey as bigint) end as target_id, 'USPS_ZIP5' as postal_type
        from {nation} cross join (select cast(r_regionkey + 1 as bigint) as chapter_id from {region} where r_regionkey < 3) as ch where (n_nationkey + chapter_id) % 2 = 0""",
    "overrides": """
        select chapter_id, cast(c_custkey as bigint) as entity_id, case when c_custkey % 2 = 0 then 'INCLUDE' else 'EXCLUDE' end as override_type, 'ACTIVE' as status,
               cast(case when c_custkey % 4 = 0 then '2000-01-01' else '2030-01-01' end as date) as expiration_date, 'asked ' || cast(c_custkey as string) as reason
        from {customer} cross join (select cast(r_regionkey + 1 as bigint) as chapter_id from {region} where r_regionkey < 3) as ch where c_custkey % 37 = chapter_id""",
    "assessments": """
        select o_orderkey as assessment_id, o_custkey as entity_id, cast(o_orderdate as date) as calculation_date,
               case o_orderkey % 5 when 0 then 'ACTIVE' when 1 then 'LAPSED' when 2 then 'ONE_TIME' when 3 then 'UNKNOWN' else 'PROVISIONAL' end as calculated_status,
               cast(o_totalprice as decimal(12,2)) as recurring_amount, o_orderkey % 11 <> 0 as is_current
        from {orders} where o_orderkey % 3 <> 0""",
    "rule_versions": """
        select cast(n_nationkey as bigint) as rule_version_id, n_nationkey % 4 = 3 as is_active, cast(20 + n_regionkey as int) as monthly_interval_min,
               cast(40 + n_regionkey as int) as monthly_interval_max, 60 as active_grace_period, 2 as min_recurring_payments, n_regionkey % 2 = 0 as skip_payment_allowed
        from {nation}""",
    "coverages": """
        select o_orderkey % 10 as import_batch_id, max(cast(o_orderdate as date)) as coverage_end_date, 'CONFIRMED_COMPLETE' as coverage_status from {orders} group by o_orderkey % 10""",
    "manifest": """
        select c_custkey as entity_id, case when c_custkey % 4 = 0 then 'UNVERIFIED' else 'VERIFIED' end as verification_status,
               case c_custkey % 3 when 0 then 'NONE' when 1 then 'ADMIN_REVIEW' else null end as verification_method, 'clerk' as verified_by, cast(null as string) as verified_at
        from {customer} where c_custkey % 5 = 2""",
    "verifications": """
        select c_custkey as entity_id, case c_custkey % 5 when 0 then 'ADMIN_REVIEW' when 1 then 'LEGACY_REVIEWED' when 2 then 'EXTERNAL_IDENTITY_MATCH' when 3 then 'EXTERNAL_IDENTITY_MATCH' else 'GUESS' end as method,
               case when c_custkey % 8 = 0 then ' ' else 'seen' end as explanation, case when c_custkey % 11 = 3 then '' else 'voters' end as source_type, '2001' as source_version,
               case when c_custkey % 13 = 7 then 'Email' else 'record_id' end as other_key, 'staff' as verified_by, cast(c_custkey as bigint) as verified_at
        from {customer} where c_custkey % 2 = 0""",
    "weights": """
        select o_orderkey as row_number, case o_orderkey % 6 when 0 then cast(o_orderkey % 100 as string) || '%' when 1 then '0.' || cast(o_orderkey % 10 as string) when 2 then '' when 3 then 'x' || cast(o_orderkey % 7 as string)
               when 4 then cast(o_orderkey % 300 as string) else cast(o_orderkey % 50 as string) end as value,
               case o_orderkey % 5 when 0 then 'fraction' when 1 then 'PERCENTAGE' when 2 then 'COUNT' else null end as unit
        from {orders}""",
    "crosswalk": """
        select c_custkey as row_number, 'h' || cast(c_custkey % 1009 as string) as row_hash, cast(c_custkey % 997 as string) as county_code,
               case c_custkey % 7 when 0 then '2138' when 1 then 'abc-de' when 2 then '' else cast(90000 + c_custkey % 1009 as string) end as zip,
               case when c_custkey % 11 = 0 then ' ' else n_name || ' County' end as county, case when c_custkey % 17 = 0 then ' ' else 'P' || n_name end as place, case when c_custkey % 13 = 0 then 'bad' else '0.5' end as weight, cast(null as string) as unit
        from {customer} join {nation} on c_nationkey = n_nationkey""",
    "associations": """
        select cast(c_custkey as bigint) as row_number, cast(c_nationkey as bigint) as postal_id, case when c_custkey % 9 = 0 then null else cast(c_custkey % 5 as bigint) end as place_id, c_custkey % 2 as dataset_id
        from {customer}""",
    "known_associations": """
        select cast(n_nationkey as bigint) as postal_id, cast(n_regionkey as bigint) as place_id, 0 as dataset_id, n_nationkey % 2 = 0 as is_active from {nation}""",
    "datasets": """
        select cast(n_nationkey as bigint) as dataset_id, 'KIND' || cast(n_regionkey as string) as dataset_type, case n_nationkey % 3 when 0 then 'ACTIVE' when 1 then 'DRAFT' else 'SUPERSEDED' end as status from {nation}""",
    "runs": """
        select o_orderkey as run_id, o_custkey as chapter_id, case o_orderkey % 4 when 0 then 'FAILED' else 'COMPLETED' end as status, case o_orderkey % 3 when 0 then 'PREVIEW' else 'APPLY' end as run_type,
               case o_orderkey % 5 when 0 then 'DRAFT' else 'ACTIVE' end as ruleset_status from {orders}""",
    "pointers": "select c_custkey as chapter_id, cast(-c_custkey as bigint) as current_run_id from {customer}",
    "override_decisions": """
        select cast(1 + c_custkey % 3 as bigint) as chapter_id, cast(c_custkey as bigint) as entity_id, case when c_custkey % 2 = 0 then 'EXCLUDE' else 'INCLUDE' end as override_type,
               case when c_custkey % 6 = 0 then ' ' else 'asked' end as reason, date '2001-01-01' as effective_date, cast(case when c_custkey % 10 = 1 then '2000-01-01' else '2030-01-01' end as date) as expiration_date,
               cast(c_custkey % 97 as bigint) as decided_at, cast(c_custkey as bigint) as override_id
        from {customer} where c_custkey % 3 = 1""",
    "audit_events": """
        select o_orderkey as event_id, cast(o_orderdate as date) as created_at, 'Customer ' || cast(o_custkey as string) || ' ' || o_orderpriority as entity from {orders}""",
    "stored_assessments": """
        select o_orderkey as assessment_id, o_custkey as entity_id, case when o_orderkey % 13 = 0 then null else cast(o_orderdate as date) end as calculation_date, o_orderkey % 4 <> 0 as is_current,
               case when o_custkey % 10 < 2 then 'UNKNOWN' when o_custkey % 3 = 0 then 'PROVISIONAL' when o_orderkey % 5 = 0 then 'ACTIVE' else 'LAPSED' end as calculated_status,
               case when o_custkey % 10 < 2 then 'INSUFFICIENT_HISTORY' when o_orderkey % 9 = 0 then null else 'RECURRING_PATTERN' end as recurrence_pattern_status,
               case when o_custkey % 10 < 2 then 'INELIGIBLE' when o_custkey % 3 = 0 then 'PROVISIONAL' else 'AUTHORITATIVE' end as membership_authority,
               case when o_custkey % 10 > 1 then cast(o_totalprice as decimal(12,2)) when o_orderkey % 2 = 0 then cast(0 as decimal(12,2)) end as recurring_amount,
               case when o_custkey % 10 > 1 then 'Monthly' when o_orderkey % 3 = 0 then 'None' when o_orderkey % 3 = 1 then '' end as payment_interval,
               case o_orderkey % 6 when 0 then null when 1 then cast(3 as bigint) else cast(o_orderkey % 25 as bigint) end as rule_version_id
        from {orders}""",
    "payments_left": """
        select o_orderkey as contribution_id, o_custkey as entity_id, o_custkey as cluster_id, cast(o_orderdate as date) as transaction_date,
               cast(o_totalprice as decimal(12,2)) as amount, o_orderkey % 10 as import_batch_id,
               case when o_orderstatus = 'P' and o_orderkey % 5 = 0 then 'REFUND' when o_orderstatus = 'P' and o_orderkey % 7 = 0 then 'ADJUSTMENT'
                    else 'CONTRIBUTION' end as transaction_type
        from {orders} where o_orderkey % 10 not in (2, 5)""",
    "targets": """
        select c_custkey as identifier_id, c_custkey as alias_id, case when c_custkey % 3 = 0 or c_custkey % 31 = 5 then 1 end as county_id, case when c_custkey % 3 = 1 then 2 end as place_id,
               case when c_custkey % 3 = 2 and c_custkey % 37 <> 0 then 3 end as postal_id
        from {customer}""",
    "weighted": """
        select c_custkey as association_id, c_nationkey as place_id, c_custkey % 7 as county_id, c_custkey % 11 as postal_id, c_custkey % 90 as dataset_id, c_custkey % 4 <> 0 as is_active,
               case when c_custkey % 19 <> 0 then (c_custkey % 110) / 100.0 end as weight, 'f' || cast(c_custkey % 1400 as string) as file_hash
        from {customer}""",
    "geo_runs": """
        select cast(c_custkey as bigint) as run_id, cast(c_custkey % 40 as bigint) as dataset_id, 'dataset_' || cast(c_custkey % 40 as string) as scope,
               case c_custkey % 13 when 0 then 'PENDING' when 1 then 'FAILED' else 'COMPLETED' end as status, 'DATASET_ACTIVATION' as trigger_type
        from {customer}""",
    "geo_batches": """
        select cast(n_nationkey as bigint) as import_batch_id, cast(n_nationkey % 11 as bigint) as dataset_id, case n_nationkey % 3 when 0 then 'ROLLED_BACK' else 'COMPLETED' end as status from {nation}""",
    "rule_sets": """
        select c_custkey as rule_set_id, c_custkey % 700 as chapter_id, c_custkey % 4 as version, case c_custkey % 5 when 0 then 'ACTIVE' else 'DRAFT' end as status from {customer}""",
    "chapter_rules": """
        select c_custkey as rule_id, c_custkey % 150 as rule_set_id, case when c_custkey % 6 = 0 then 'EXCLUDE' else 'INCLUDE' end as effect,
               case c_custkey % 3 when 0 then 'COUNTY' when 1 then 'PLACE' else 'POSTAL_AREA' end as target_type, c_custkey % 8 <> 0 as is_active,
               case when c_custkey % 3 = 0 or c_custkey % 41 = 2 then c_nationkey end as county_id, case when c_custkey % 3 = 1 and c_custkey % 43 <> 1 then c_nationkey end as place_id,
               case when c_custkey % 3 = 2 then c_nationkey end as postal_id
        from {customer}""",
    "dated_overrides": """
        select c_custkey as override_id, c_custkey % 9 as chapter_id, c_custkey % 1300 as entity_id, case when c_custkey % 3 = 0 then 'REVOKED' else 'ACTIVE' end as status, date '2001-01-01' as effective_date,
               cast(case c_custkey % 10 when 1 then '2000-01-01' when 2 then null else '2030-01-01' end as date) as expiration_date
        from {customer}""",
    "run_results": "select o_orderkey as result_id, o_orderkey % 40 as run_id, o_custkey as entity_id, o_orderkey % 1700 as rule_id from {orders}",
    "chapter_runs": "select c_custkey as run_id, c_custkey % 1600 as rule_set_id from {customer} where c_custkey % 9 <> 4 and c_custkey < 40",
    "placed": """
        select c_custkey as resolution_id, case when c_custkey % 21 = 0 then -1 else c_custkey end as location_id, case when c_custkey % 16 = 0 then null else c_nationkey + case when c_custkey % 50 = 0 then 100 else 0 end end as county_id,
               case when c_custkey % 5 = 0 then 'SUPERSEDED' else 'CURRENT' end as status
        from {customer} union all select c_custkey + 1000000, c_custkey, c_nationkey, 'CURRENT' from {customer} where c_custkey % 100 = 7""",
    "chapter_list": "select cast(r_regionkey + 1 as bigint) as chapter_id, r_name as chapter_name, case when r_regionkey = 1 then 'INACTIVE' else 'ACTIVE' end as status from {region}",
    "chapter_results": """
        select o_orderkey as result_id, o_custkey as entity_id from {orders} where o_orderkey % 3 = 1""",
}
BASE = ["region", "nation", "customer", "orders"]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A canonical input over the tables of sf_dir."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in BASE if "{" + t + "}" in VIEWS[name]}
    return spark.sql(VIEWS[name], **tables)


def sql(query: str, *names: str) -> str:
    """A query over views as one statement for another engine."""
    parts = [f"{n} as ({VIEWS[n].format(**{t: t for t in BASE})})" for n in names]
    head, sep, rest = query.strip().partition("with ")
    return f"with {', '.join(parts)}, {rest}" if sep and not head else f"with {', '.join(parts)} {query}"
