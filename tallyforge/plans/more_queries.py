"""Queries of branches that others do not reach: files, all kinds of reference rows, stale data, former payers."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import functions as F

from ..functions import names
from ..operators import chapters, geography, identity, membership
from ..sources import scratch
from ..sources.contributions import read_contribution_csv, write_tables
from .queries import _GEO, _NAME, _NET_C, _RES, _RESULT, _SAID, _STATES, DAY, GEO, RESULT, RULE, _resolved, _results, query


def _folder(df, name):
    return f"{scratch.folder(df.sparkSession)}/tallyforge/{name}-{uuid.uuid4().hex}"


CELLS = ["row", "name", "amount_text", "street"]


@query(
    "raw_rows",
    oracle="""select row_number, case when row_number % 3 = 0 then 'says "' || name || '", twice' else name end as name, amount_text, case when row_number % 4 = 0 then street || chr(10) || 'rear' else street end as street from raw_rows""",
)
def ingest_csv(rows):
    """Rows written as a file of quoted cells with commas, quotes and line breaks, and read back."""
    path = _folder(rows, "csv")
    odd = rows.select(
        F.col("row_number").cast("string").alias("row"), F.when(F.col("row_number") % 3 == 0, F.concat(F.lit('says "'), "name", F.lit('", twice'))).otherwise(F.col("name")).alias("name"), "amount_text",
        F.when(F.col("row_number") % 4 == 0, F.concat("street", F.lit("\nrear"))).otherwise(F.col("street")).alias("street"),
    )
    odd.write.csv(path, header=True, quote='"', escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    back = read_contribution_csv(rows.sparkSession, path, CELLS)
    return back.select(F.col("row").cast("long").alias("row_number"), "name", "amount_text", "street")


@query("payments", "batches", oracle="select contribution_id, case when import_batch_id = 4 then cast(0 as decimal(12,2)) else amount end as amount, import_batch_id from payments")
def ingest_tables_written(payments, batches):
    """Tables are written, then the partition of batch 4 alone is replaced."""
    path = _folder(payments, "tables")
    write_tables({"payments": payments.select("contribution_id", "amount", "import_batch_id"), "batches": batches}, path)
    write_tables({"payments": payments.where("import_batch_id = 4").select("contribution_id", F.lit(0).cast("decimal(12,2)").alias("amount"), "import_batch_id")}, path)
    return payments.sparkSession.read.parquet(f"{path}/payments").select("contribution_id", "amount", "import_batch_id")


# --- reference files ------------------------------------------------------------------------------------

_DOUBT = "case when zip = '2138' then 'ZIP ''2138'' has 4 digits (unauthorized padding)' when zip = 'abc-de' then 'Malformed ZIP5 in ZIP+4: ''abc-de''' when zip = '' then 'Missing ZIP value' end"
_WHY = {
    "COUNTY_LIST": "case when trim(county) = '' then 'County name is required' end",
    "PLACE_LIST": "case when trim(place) = '' then 'Place name is required' end",
    "POSTAL_LIST": "case when zip in ('', 'abc-de') then doubt end",
    "ZIP_COUNTY_CROSSWALK": "case when zip in ('', 'abc-de') then doubt when trim(county) = '' then 'Referenced County '''' does not exist' end",
    "ZIP_PLACE_CROSSWALK": "case when zip in ('', 'abc-de') then doubt when trim(place) = '' then 'Referenced Place '''' does not exist' end",
    "PLACE_COUNTY_CROSSWALK": "case when trim(place) = '' or trim(county) = '' then 'Both PLACE and COUNTY are required' end",
}


def _kind_sql(kind: str) -> str:
    why = _WHY.get(kind, "cast(null as varchar)")
    zips, weighted = kind in geography.ZIP_KINDS, kind in geography.WEIGHTED
    bad = "case when weight = 'bad' then 'Malformed weight value: bad' end"
    parts = ", ".join([*(["doubt"] if zips else []), *([bad] if weighted else [])]) or "null"
    status = "case when k > 1 then 'EXACT_DUPLICATE' when why is not null then 'VALIDATION_FAILURE'"
    if zips:
        status += " when zip = '2138' then 'POSSIBLE_TRUNCATED_LEADING_ZERO'" + (" when weight = 'bad' then 'VALIDATION_WARNING'" if weighted else "")
    return f"select '{kind}' as kind, row_number, {status} else 'ACCEPTED' end as row_status, case when k > 1 then '' else coalesce(why, concat_ws('; ', {parts})) end as row_message from (select *, {why} as why from x) as y"


_KINDS = f"with x as (select *, {_DOUBT} as doubt, row_number() over (partition by row_hash order by row_number) as k from crosswalk), rows_of as (" + " union all ".join(map(_kind_sql, geography.KINDS)) + ")"


def _checked(crosswalk):
    out = None
    for kind in geography.KINDS:
        one = geography.import_reference(crosswalk, kind).select(F.lit(kind).alias("kind"), "row_number", "row_status", "row_message")
        out = one if out is None else out.unionByName(one)
    return out


@query("crosswalk", oracle=f"{_KINDS} select kind, row_number, row_status, row_message from rows_of")
def geography_reference_kinds(crosswalk):
    """The rows of a file taken as each of the eight kinds."""
    return _checked(crosswalk)


@query(
    "crosswalk",
    oracle=f"""{_KINDS} select kind, count(*) as row_count, count(*) filter (row_status = 'ACCEPTED') as successful_rows, count(*) filter (row_status = 'VALIDATION_FAILURE') as failed_rows,
     count(*) filter (row_status = 'EXACT_DUPLICATE') as duplicate_rows, count(*) filter (row_status in ('VALIDATION_WARNING', 'POSSIBLE_TRUNCATED_LEADING_ZERO')) as warning_rows from rows_of group by kind""",
)
def geography_reference_counts(crosswalk):
    """Counts of each kind's batch."""
    return _checked(crosswalk).groupBy("kind").agg(*geography.reference_counts(F.col("row_status")))


@query(
    "places", "postal", "postal_county",
    oracle="""with c(id, name) as (select distinct county_id, 'LAND ' || county_id from postal_county)
     select 'PLACE' as target_type, place_id as id from places union all select 'COUNTY', id from c union all select 'POSTAL_AREA', postal_id from postal""",
)
def geography_targets(places, postal, postal_county):
    """Targets of all three types; those of another type, or that are not known, go."""
    counties = postal_county.select(F.col("county_id").alias("id")).distinct().select("id", F.lit("CA").alias("state_code"), F.concat(F.lit("LAND "), F.col("id").cast("string")).alias("name"))
    named = places.select(F.col("place_id").alias("id"), "state_code", "name")
    want = lambda df, kind, target: df.select(F.lit("a").alias("alias"), F.lit(kind).alias("target_type"), target.alias("target"), F.lit("CA").alias("state_code"))
    rows = want(named, "PLACE", F.concat(F.lit(" "), F.lower("name"))).union(want(counties, "COUNTY", F.concat(F.initcap("name"), F.lit(" County")))).union(want(postal, "POSTAL_AREA", F.col("postal_code")))
    rows = rows.union(want(named, "COUNTY", F.col("name"))).union(want(postal, "PLACE", F.col("postal_code"))).union(want(named, "REGION", F.col("name")))
    found = geography.resolve_alias_targets(rows, counties, named, postal)
    return found.select("target_type", F.coalesce("county_id", "place_id", "postal_id").alias("id"))


@query(
    *GEO,
    oracle=f"""{_GEO}, x as (select r.*, match_method in {_RES} as ok from r) select location_id,
     case when location_id % 10 = 3 then 'CORRUPT' when location_id % 10 = 4 or not ok then 'CLEARED' when place_id is not distinct from -1 and county_id is not distinct from -1 then 'SAME' else 'UPDATED' end as cache_change,
     case when location_id % 10 = 3 then -1 when location_id % 10 = 4 or not ok then null else county_id end as county_id from x""",
)
def geography_cache_of_old(*tables):
    """Over a filled cache, with locations that have two current resolutions, or none."""
    filled = tables[0].withColumns({"place_id": F.lit(-1).cast("long"), "county_id": F.lit(-1).cast("long")})
    found = _resolved(*tables)[0].withColumn("status", F.when(F.col("location_id") % 10 == 4, "SUPERSEDED").otherwise("CURRENT"))
    twice = found.unionByName(found.where("location_id % 10 = 3"))
    return geography.location_geo_cache(filled, twice).select("location_id", "county_id", "cache_change")


# --- chapters -------------------------------------------------------------------------------------------


@query(
    *RESULT,
    oracle=f"""{_RESULT}, old as (select chapter_id, entity_id, case when entity_id % 4 = 1 then 'AMBIGUOUS' else assignment_status end as was from res where entity_id % 3 <> 0)
     select count(*) filter (was is null) as created, count(*) filter (was <> assignment_status) as updated, count(*) filter (was = assignment_status) as identical
     from res left join old on old.chapter_id = res.chapter_id and old.entity_id = res.entity_id""",
)
def chapters_rebuild_counts(*tables):
    """C9."""
    new = _results(*tables)
    old = new.where("entity_id % 3 <> 0").withColumn("assignment_status", F.when(F.col("entity_id") % 4 == 1, "AMBIGUOUS").otherwise(F.col("assignment_status")))
    return chapters.rebuild_counts(chapters.rebuild_assignments(new, old))


# --- membership and identity ----------------------------------------------------------------------------

#: Sixty-one days before the day: coverage that is stale by one.
OLD = membership.Coverage(date(2001, 4, 15))
_STALE = _STATES.replace("when n = 1 and verification_status = 'VERIFIED' then 'S04'", "when n = 1 and verification_status = 'VERIFIED' then 'S05'").replace("when rec and verification_status = 'VERIFIED' then 'S03'", "when rec and verification_status = 'VERIFIED' then 'S02'")
assert _STALE.count("'S05'") > _STATES.count("'S05'")


@query("entities", "payments", oracle=f"{_STALE} select entity_id, state_id, calculated_status, recurring_amount, {_SAID} as explanation from full_states")
def membership_states_of_stale_data(entities, payments):
    """M6, M7: with data that end too early to say who has lapsed."""
    states = membership.membership_state(entities.select("entity_id", "entity_type", "verification_status"), payments, RULE, OLD, DAY)
    return states.select("entity_id", "state_id", "calculated_status", "recurring_amount", membership.explanation(F.col("state_id"), F.col("entity_type")).alias("explanation"))


@query(
    "entities",
    "payments",
    oracle=f"""with {_NET_C} select e.cluster_id, case when coalesce(n, 0) = 0 then 'INSUFFICIENT_HISTORY' when n = 1 then 'SINGLE_VISIBLE_CONTRIBUTION'
     when valid_gaps + skipped_gaps >= 1 and date_diff('day', last_payment, date '2001-06-15') <= 60 then 'POSSIBLE_RECURRING' when valid_gaps + skipped_gaps >= 1 then 'PREVIOUSLY_RECURRING'
     when confidence_level = 'LOW' then 'AMBIGUOUS_IDENTITY_CLUSTER' else 'INSUFFICIENT_HISTORY' end as pattern from entities e left join counts c on e.cluster_id = c.cluster_id""",
)
def membership_cluster_pattern_on_a_day(entities, payments):
    """M5 on a given day, when many have not paid for long."""
    return membership.cluster_pattern(entities.select("cluster_id", "confidence_level"), payments, RULE, DAY).select("cluster_id", "pattern")


@query(
    "raw_rows",
    oracle=f"""with {_NAME}, p as (select *, case when kind_ok then 'x' end as keep from (select *, entity_type <> 'INDIVIDUAL' and row_number % 2 = 0 as kind_ok from parsed) as y)
     select row_number as entity_id, case when kind_ok then 'INDIVIDUAL' else entity_type end as entity_type, kind_ok and entity_type <> 'INDIVIDUAL' as corrected, 'ACTIVE' as membership_status from p""",
)
def identity_reclassify_to_people(rows):
    """Every second organisation turns out to be a person, who gets name parts and keeps the status."""
    own = rows.select(
        F.col("row_number").alias("entity_id"), F.col("name").alias("display_name"), names.entity_type(F.col("name")).alias("entity_type"), *[F.lit(None).cast("string").alias(c) for c in ("first_name", "middle_name", "last_name")],
        F.lit("ACTIVE").alias("membership_status"),
    )
    decisions = own.where("entity_type <> 'INDIVIDUAL' and entity_id % 2 = 0").selectExpr("entity_id", "'INDIVIDUAL' as new_type", "'a person' as reason")
    out = identity.reclassify_entities(own, decisions)[0]
    return out.select("entity_id", "entity_type", F.coalesce((F.col("entity_type") == "INDIVIDUAL") & F.col("last_name").isNotNull(), F.lit(False)).alias("corrected"), "membership_status")
