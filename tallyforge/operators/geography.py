"""Reference geography and the resolution of locations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.parsing import normalize_weight, normalize_zip
from ..sources.versions import Versioned

RESOLVED = ["EXACT_PLACE_ZIP_MATCH", "EXACT_ALIAS_ZIP_MATCH", "UNIQUE_ZIP_INFERENCE", "MANUALLY_RESOLVED"]
# Kinds of reference files.
KINDS = [
    "COUNTY_LIST", "PLACE_LIST", "POSTAL_LIST", "ZIP_COUNTY_CROSSWALK", "ZIP_PLACE_CROSSWALK", "PLACE_COUNTY_CROSSWALK", "ALIAS_LIST", "IDENTIFIER_LIST",
]
ZIP_KINDS, WEIGHTED = KINDS[2:5], KINDS[3:6]


def import_reference(rows: DataFrame, kind: str) -> DataFrame:
    """Rows (row_number, row_hash, zip, county, place, weight, unit) with zip5, share, row_status and row_message.

    A repeated row is EXACT_DUPLICATE. A row that lacks what its kind needs fails, a ZIP of four digits is kept as
    possibly truncated, other doubts about ZIP or (of crosswalks from ZIPs) weight are warnings. Aliases and identifiers
    are not judged here, as their targets are looked up later.
    """
    rows = rows.withColumns({"_z": normalize_zip(F.col("zip")), "_w": normalize_weight(F.col("weight"), F.col("unit")), "_n": F.row_number().over(Window.partitionBy("row_hash").orderBy("row_number"))})
    doubt, none = F.col("_z.warning"), F.lit(None).cast("string")
    short = F.coalesce(F.col("_z.zip5").isNull() & doubt.contains("unauthorized padding"), F.lit(False))
    no_zip = F.col("_z.zip5").isNull() & ~short
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    unknown = lambda c: F.format_string(f"Referenced {c.title()} '%s' does not exist", F.coalesce(F.trim(c), F.lit("")))
    why = {
        "COUNTY_LIST": F.when(blank("county"), "County name is required"),
        "PLACE_LIST": F.when(blank("place"), "Place name is required"),
        "POSTAL_LIST": F.when(no_zip, F.coalesce(doubt, F.lit("Postal code normalization failed"))),
        "ZIP_COUNTY_CROSSWALK": F.when(no_zip, F.coalesce(doubt, F.lit("Postal code is required"))).when(canonical_name(F.coalesce("county", F.lit("")), "county") == "", unknown("county")),
        "ZIP_PLACE_CROSSWALK": F.when(no_zip, F.coalesce(doubt, F.lit("Postal code is required"))).when(blank("place"), unknown("place")),
        "PLACE_COUNTY_CROSSWALK": F.when(blank("place") | blank("county"), "Both PLACE and COUNTY are required"),
    }.get(kind, none)
    warned = F.concat_ws("; ", doubt if kind in ZIP_KINDS else none, F.col("_w.error") if kind in WEIGHTED else none)
    status = F.when(F.col("_n") > 1, "EXACT_DUPLICATE").when(F.col("_why").isNotNull(), "VALIDATION_FAILURE")
    if kind in ZIP_KINDS:
        odd = doubt.isNotNull() | (F.col("_w.error").isNotNull() if kind in WEIGHTED else F.lit(False))
        status = status.when(short, "POSSIBLE_TRUNCATED_LEADING_ZERO").when(odd, "VALIDATION_WARNING")
    rows = rows.withColumn("_why", why).withColumns({"row_status": status.otherwise("ACCEPTED"), "zip5": F.col("_z.zip5"), "share": F.col("_w.weight")})
    said = F.when(F.col("row_status") == "EXACT_DUPLICATE", "").otherwise(F.coalesce("_why", warned))
    return rows.withColumn("row_message", said).drop("_z", "_w", "_n", "_why")


def reference_counts(statuses: Column) -> list[Column]:
    """The counts of a batch, as aggregates over row_status."""
    return [
        F.count("*").alias("row_count"), F.count_if(statuses == "ACCEPTED").alias("successful_rows"),
        F.count_if(statuses == "VALIDATION_FAILURE").alias("failed_rows"), F.count_if(statuses == "EXACT_DUPLICATE").alias("duplicate_rows"),
        F.count_if(statuses.isin("VALIDATION_WARNING", "POSSIBLE_TRUNCATED_LEADING_ZERO")).alias("warning_rows"),
    ]


def write_reference(rows: DataFrame, path: str) -> dict[str, int]:
    """Writes rows of import_reference() and returns the counts, observed in the pass that writes."""
    seen = Observation("reference")
    rows.observe(seen, *reference_counts(F.col("row_status"))).write.parquet(path)
    return dict(seen.get)


def canonical_name(column, kind: str):
    """Upper case; a county without the word COUNTY, wherever it follows a space."""
    name = F.upper(F.trim(column))
    return F.trim(F.replace(name, F.lit(" COUNTY"), F.lit(""))) if kind == "county" else name


def canonicalise(existing: DataFrame, names: DataFrame, kind: str, default_state: str = "CA") -> DataFrame:
    """Existing (id, state_code, name) with new names added; ids are hashes of state and name."""
    new = names.select(F.coalesce("state_code", F.lit(default_state)).alias("state_code"), canonical_name(F.col("name"), kind).alias("name")).where("name != ''").distinct()
    new = new.join(existing.select("state_code", "name"), ["state_code", "name"], "left_anti")
    return existing.unionByName(new.select(F.xxhash64(F.lit(kind), "state_code", "name").alias("id"), "state_code", "name"))


def dedupe_associations(rows: DataFrame, existing: DataFrame, left: str, right: str) -> DataFrame:
    """The first row of each pair that is not there yet; rows without either side go."""
    first = F.row_number().over(Window.partitionBy(left, right, "dataset_id").orderBy("row_number")) == 1
    good = rows.where(F.col(left).isNotNull() & F.col(right).isNotNull()).withColumn("_first", first).where("_first").drop("_first")
    return good.join(existing.where("is_active").select(left, right, "dataset_id"), [left, right, "dataset_id"], "left_anti")


def resolve_alias_targets(rows: DataFrame, counties: DataFrame, places: DataFrame, postals: DataFrame) -> DataFrame:
    """Rows (alias, target_type, target, state_code) with the id of their county, place or postal area; others go.

    counties, places: (id, state_code, name); postals: (postal_id, postal_code). The lowest id stands for equal names."""
    name = canonical_name(F.col("target"), "place")
    rows = rows.withColumn("_name", F.when(F.col("target_type") == "COUNTY", canonical_name(F.col("target"), "county")).otherwise(name))
    for kind, table, to in (("COUNTY", counties, "county_id"), ("PLACE", places, "place_id")):
        ids = table.groupBy("state_code", F.col("name").alias("_name")).agg(F.min("id").alias(to)).withColumn("target_type", F.lit(kind))
        rows = rows.join(ids, ["state_code", "_name", "target_type"], "left")
    zips = postals.groupBy(F.col("postal_code").alias("_name")).agg(F.min("postal_id").alias("postal_id")).withColumn("target_type", F.lit("POSTAL_AREA"))
    rows = rows.join(zips, ["_name", "target_type"], "left").drop("_name")
    return rows.where(F.coalesce("county_id", "place_id", "postal_id").isNotNull())


def flip_reference(rows: DataFrame, batch_ids: DataFrame, active: bool) -> DataFrame:
    """Rollback (active False) or restore of everything that came with the batches."""
    hit = batch_ids.select("import_batch_id").distinct().withColumn("_hit", F.lit(True))
    return rows.join(hit, "import_batch_id", "left").withColumn("is_active", F.when(F.col("_hit"), F.lit(active)).otherwise(F.col("is_active"))).select(rows.columns)


def activate_dataset(datasets: DataFrame, dataset_id) -> DataFrame:
    """The dataset is active, other active ones of its type are superseded."""
    kind = datasets.where(F.col("dataset_id") == dataset_id).select(F.col("dataset_type").alias("_type"))
    own = F.col("dataset_id") == dataset_id
    same = F.col("_type").isNotNull() & (F.col("status") == "ACTIVE")
    return (
        datasets.join(kind, F.col("dataset_type") == F.col("_type"), "left")
        .withColumn("status", F.when(own, "ACTIVE").when(same, "SUPERSEDED").otherwise(F.col("status")))
        .select(datasets.columns)
    )


def _outcomes(keys: DataFrame, ref: dict[str, DataFrame]) -> DataFrame:
    """The decision for each different (city, state_code, zip5)."""
    postal = ref["postal"].groupBy(F.col("postal_code").alias("zip5")).agg(F.min("postal_id").alias("postal_id"))
    rows = keys.join(postal, "zip5", "left")
    places = ref["place"].select("place_id", F.col("name").alias("city"), "state_code")
    alias = ref["alias"].join(ref["place"].select("place_id", "state_code"), "place_id").select("place_id", F.col("alias").alias("city"), "state_code")
    in_zip = ref["postal_place"].select("postal_id", "place_id").distinct()
    key = ["city", "state_code", "zip5"]

    def matches(named: DataFrame, name: str) -> DataFrame:
        found = rows.join(named, ["city", "state_code"]).join(in_zip.withColumn("_in", F.lit(1)), ["postal_id", "place_id"], "left")
        return found.groupBy(*key).agg(F.count("*").alias(f"n_{name}"), F.count("_in").alias(f"n_{name}_zip"), F.min(F.when(F.col("_in") == 1, F.col("place_id"))).alias(f"{name}_id"))

    counties = ref["place_county"].groupBy("place_id").agg(F.count("*").alias("n"), F.min("county_id").alias("c"))
    of = lambda name: counties.select(F.col("place_id").alias(f"{name}_id"), F.col("n").alias(f"{name}_counties"), F.col("c").alias(f"{name}_county"))
    zips = ref["postal_county"].groupBy("postal_id").agg(F.count("*").alias("zip_counties"), F.min("county_id").alias("zip_county"))
    rows = rows.join(matches(places, "place"), key, "left").join(matches(alias, "alias"), key, "left")
    rows = rows.join(of("place"), "place_id", "left").join(of("alias"), "alias_id", "left").join(zips, "postal_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    one = lambda name: zero(f"n_{name}_zip") == 1
    none = F.lit(None).cast("long")

    def out(method, place, county, confidence, rule=None):
        return F.struct(F.lit(method).alias("match_method"), place.alias("place_id"), county.alias("county_id"), F.lit(confidence).alias("confidence"), F.lit(rule).cast("string").alias("candidate_rule"))

    p, a = F.col("place_id"), F.col("alias_id")
    known = (zero("n_place") > 0) | (zero("n_alias") > 0)
    decided = (
        F.when(one("place") & (zero("place_counties") == 1), out("EXACT_PLACE_ZIP_MATCH", p, F.col("place_county"), "HIGH"))
        .when(one("place") & (zero("place_counties") > 1), out("AMBIGUOUS_ZIP", p, none, "MEDIUM", "PLACE_COUNTY_SPAN"))
        .when(one("place"), out("EXACT_PLACE_ZIP_MATCH", p, none, "MEDIUM"))
        .when(one("alias") & (zero("alias_counties") == 1), out("EXACT_ALIAS_ZIP_MATCH", a, F.col("alias_county"), "HIGH"))
        .when(one("alias") & (zero("alias_counties") > 1), out("AMBIGUOUS_ZIP", a, none, "MEDIUM", "PLACE_COUNTY_SPAN"))
        .when((zero("zip_counties") == 1) & known, out("CONFLICTING_SOURCE_VALUES", none, none, "LOW"))
        .when(zero("zip_counties") == 1, out("UNIQUE_ZIP_INFERENCE", none, F.col("zip_county"), "MEDIUM"))
        .when(zero("zip_counties") > 1, out("AMBIGUOUS_ZIP", none, none, "LOW", "ZIP_COUNTY_MULTIPLE"))
        .when(zero("n_place") > 0, out("AMBIGUOUS_PLACE", none, none, "LOW"))
        .when(zero("n_alias") > 0, out("AMBIGUOUS_ALIAS", none, none, "LOW"))
        .otherwise(out("NO_REFERENCE_MATCH", none, none, "LOW"))
    )
    return rows.withColumn("_d", decided).select(*key, "postal_id", "_d.*")


def resolve_locations(locations: DataFrame, ref: dict[str, DataFrame]) -> DataFrame:
    """The resolution of each location (location_id, city, state, zip).

    ref: active rows of place (place_id, name, state_code), alias (alias, place_id), postal (postal_id, postal_code),
    postal_place, place_county and postal_county. Each different city, state and ZIP is decided once.
    """
    rows = locations.withColumns(
        {
            "_city": F.upper(F.trim(F.coalesce("city", F.lit("")))),
            "_state": F.substring(F.upper(F.trim(F.coalesce("state", F.lit("")))), 1, 2),
            "_zip": F.coalesce(normalize_zip(F.col("zip"))["zip5"], F.lit("")),
        }
    )
    keys = rows.select(F.col("_city").alias("city"), F.col("_state").alias("state_code"), F.col("_zip").alias("zip5")).distinct()
    d = _outcomes(keys, ref).withColumnsRenamed({"city": "_city", "state_code": "_state", "zip5": "_zip"})
    return rows.join(d, ["_city", "_state", "_zip"]).select("location_id", "match_method", "place_id", "postal_id", "county_id", "confidence", "candidate_rule")


def resolution_candidates(resolutions: DataFrame, ref: dict[str, DataFrame]) -> DataFrame:
    """A row for each county that an ambiguous resolution may mean."""
    span = resolutions.where("candidate_rule = 'PLACE_COUNTY_SPAN'").select("location_id", "candidate_rule", "place_id").join(ref["place_county"].select("place_id", "county_id"), "place_id")
    many = resolutions.where("candidate_rule = 'ZIP_COUNTY_MULTIPLE'").select("location_id", "candidate_rule", "postal_id").join(ref["postal_county"].select("postal_id", "county_id"), "postal_id")
    cols = ["location_id", "candidate_rule", "county_id"]
    return span.select(cols).unionByName(many.select(cols))


# What is said of a resolution.
SAID = {
    "PLACE_ZIP": "County matched from exact place name '{place}' and ZIP '{zip5}' intersection.",
    "PLACE_NO_COUNTY": "Place '{place}' matched but has no registered county association.",
    "PLACE_SPAN": "Place '{place}' spans multiple counties; county assignment requires review.",
    "ALIAS_ZIP": "County matched from alias name '{name}' mapping to canonical place '{place}' and ZIP '{zip5}' intersection.",
    "ALIAS_SPAN": "Alias '{name}' place '{place}' spans multiple counties; county assignment requires review.",
    "CONFLICT": "Contradictory geographic values: observed city '{city}' does not associate with observed ZIP '{zip}'.",
    "ZIP_UNIQUE": "County '{county}' inferred through unique association with ZIP '{zip5}'.",
    "ZIP_MANY": "ZIP '{zip5}' is associated with more than one county; county assignment requires review.",
    "PLACE_ONLY": "Observed city name '{city}' maps to canonical place, but ZIP '{zip}' reference was missing or not associated.",
    "ALIAS_ONLY": "Observed city name '{city}' maps to geographic alias, but ZIP '{zip}' reference was missing or not associated.",
    "NOTHING": "No reference matches found in active datasets for observed city '{city}' and ZIP '{zip}'.",
}


def _fill(template: str, values: dict[str, Column]) -> Column:
    """A template with columns for its names."""
    parts, rest = [], template
    while "{" in rest:
        text, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        parts += [F.lit(text), F.coalesce(values[name].cast("string"), F.lit("None"))]
    return F.concat(*parts, F.lit(rest))


def explain_resolutions(resolutions: DataFrame, locations: DataFrame, places: DataFrame, counties: DataFrame) -> DataFrame:
    """Resolutions with an explanation. Its kind follows from method, rule and ids, and the names come from
    dimensions (place_id, name), (county_id, county_name) at the end, so that no text is shuffled with the rows.

    A place was found by an alias where its own name is not the city that was observed.
    """
    named = places.groupBy("place_id").agg(F.min("name").alias("_place"))
    rows = resolutions.join(locations.select("location_id", "city", "zip"), "location_id").join(named, "place_id", "left")
    rows = rows.join(counties.select("county_id", "county_name"), "county_id", "left")
    name, method, rule = F.upper(F.trim(F.coalesce("city", F.lit("")))), F.col("match_method"), F.col("candidate_rule")
    alias = F.col("_place") != name
    kind = (
        F.when(method == "EXACT_ALIAS_ZIP_MATCH", "ALIAS_ZIP")
        .when((method == "EXACT_PLACE_ZIP_MATCH") & F.col("county_id").isNull(), "PLACE_NO_COUNTY")
        .when(method == "EXACT_PLACE_ZIP_MATCH", "PLACE_ZIP")
        .when((rule == "PLACE_COUNTY_SPAN") & alias, "ALIAS_SPAN")
        .when(rule == "PLACE_COUNTY_SPAN", "PLACE_SPAN")
        .when(method == "CONFLICTING_SOURCE_VALUES", "CONFLICT")
        .when(method == "UNIQUE_ZIP_INFERENCE", "ZIP_UNIQUE")
        .when(rule == "ZIP_COUNTY_MULTIPLE", "ZIP_MANY")
        .when(method == "AMBIGUOUS_PLACE", "PLACE_ONLY")
        .when(method == "AMBIGUOUS_ALIAS", "ALIAS_ONLY")
        .otherwise("NOTHING")
    )
    values = {
        "place": F.col("_place"), "county": F.col("county_name"), "name": name, "city": F.coalesce("city", F.lit("None")), "zip": F.coalesce("zip", F.lit("None")),
        "zip5": normalize_zip(F.col("zip"))["zip5"],
    }
    text = reduce(lambda out, k: out.when(F.col("_kind") == k, _fill(SAID[k], values)), list(SAID)[1:], F.when(F.col("_kind") == "PLACE_ZIP", _fill(SAID["PLACE_ZIP"], values)))
    return rows.withColumn("_kind", kind).select(*resolutions.columns, text.alias("explanation"))


def supersede(history: DataFrame, found: DataFrame, run_id: int) -> DataFrame:
    """The history of resolutions after a run: rows of `found` are CURRENT, CURRENT ones of the same locations from
    before are SUPERSEDED. Rows that the same run left when it died go first, so that it can be repeated."""
    before = history.where(F.col("run_id") != run_id)
    hit = found.select("location_id").distinct().withColumn("_hit", F.lit(True))
    old = before.join(hit, "location_id", "left").withColumn("status", F.when(F.col("_hit") & (F.col("status") == "CURRENT"), "SUPERSEDED").otherwise(F.col("status"))).drop("_hit")
    new = found.withColumns({"run_id": F.lit(run_id).cast("long"), "status": F.lit("CURRENT"), "origin": F.lit("AUTOMATIC")})
    return old.unionByName(new, allowMissingColumns=True)


def run_resolution(store: Versioned, locations: DataFrame, ref: dict[str, DataFrame], schema: T.StructType, run_id: int) -> list[int]:
    """Resolves the given locations and publishes the history by location in the store; parts of other locations are
    neither read nor written, and a run that dies or is repeated leaves the same current set."""
    found = resolve_locations(locations, ref)
    keys = locations.select("location_id").distinct()
    history = store.before(run_id, keys, schema).join(keys, "location_id", "left_semi")
    return store.merge(keys, supersede(history, found, run_id).select(schema.fieldNames()), run_id)


def runs_after_activation(runs: DataFrame, datasets: DataFrame, dataset_id: int, run_id: int) -> DataFrame:
    """Resolution runs (run_id, dataset_id, scope, status, trigger_type) after a dataset becomes active: pending runs
    of those that it supersedes are SUPERSEDED, and it has one pending run of its own scope, new if there was none."""
    kind = datasets.where(F.col("dataset_id") == dataset_id).select(F.col("dataset_type").alias("_type"))
    other = datasets.where((F.col("status") == "ACTIVE") & (F.col("dataset_id") != dataset_id)).join(kind, F.col("dataset_type") == F.col("_type"), "left_semi")
    hit = other.select("dataset_id").distinct().withColumn("_hit", F.lit(True))
    pending = F.col("status") == "PENDING"
    old = runs.join(hit, "dataset_id", "left").withColumn("status", F.when(F.col("_hit") & pending, "SUPERSEDED").otherwise(F.col("status"))).select(runs.columns)
    scope = f"dataset_{dataset_id}"
    there = runs.where(pending & (F.col("dataset_id") == dataset_id) & (F.col("scope") == scope))
    return old.unionByName(_proposal(datasets.where(F.col("dataset_id") == dataset_id).join(there.select("dataset_id"), "dataset_id", "left_anti"), run_id).select(runs.columns))


def _proposal(datasets: DataFrame, first_id: int) -> DataFrame:
    """A pending run for each of a few datasets."""
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("dataset_id"))
    return datasets.select("dataset_id").distinct().select(
        (F.lit(first_id) + place - 1).cast("long").alias("run_id"), "dataset_id", F.concat(F.lit("dataset_"), F.col("dataset_id").cast("string")).alias("scope"),
        F.lit("PENDING").alias("status"), F.lit("DATASET_ACTIVATION").alias("trigger_type"),
    )


def runs_after_flip(runs: DataFrame, batches: DataFrame, batch_ids: DataFrame, active: bool, first_id: int = 0) -> DataFrame:
    """Resolution runs after batches (import_batch_id, dataset_id, status) are rolled back (pending runs of their
    datasets are CANCELLED) or restored (each dataset gets a new pending run). Only completed batches can be rolled back
    and only rolled-back ones restored; others change nothing."""
    can = batches.join(batch_ids.select("import_batch_id").distinct(), "import_batch_id", "left_semi").where(F.col("status") == ("ROLLED_BACK" if active else "COMPLETED"))
    own = can.select("dataset_id").distinct()
    if active:
        return runs.unionByName(_proposal(own, first_id).select(runs.columns))
    rows = runs.join(own.withColumn("_hit", F.lit(True)), "dataset_id", "left")
    return rows.withColumn("status", F.when(F.col("_hit") & (F.col("status") == "PENDING"), "CANCELLED").otherwise(F.col("status"))).select(runs.columns)


def resolution_counts(resolutions: DataFrame) -> DataFrame:
    """One row of counts of a run."""
    m = F.col("match_method")
    return resolutions.agg(
        F.count_if(m.isin(RESOLVED)).alias("resolved"),
        F.count_if(m.contains("AMBIGUOUS")).alias("ambiguous"),
        F.count_if(m == "CONFLICTING_SOURCE_VALUES").alias("conflicts"),
        F.count_if(m == "NO_REFERENCE_MATCH").alias("unmatched"),
    )


def location_geo_cache(locations: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Locations with the fields of their current resolution, and what happened: updated, cleared, same or corrupt."""
    cur = resolutions.where("status = 'CURRENT'").groupBy("location_id").agg(
        F.count("*").alias("_n"), F.min(F.when(F.col("match_method").isin(RESOLVED), F.struct("place_id", "county_id"))).alias("_r")
    )
    rows = locations.join(cur, "location_id", "left")
    new = {c: F.when(F.col("_n") > 1, F.col(c)).otherwise(F.col(f"_r.{c}")) for c in ("place_id", "county_id")}
    same = F.col("place_id").eqNullSafe(F.col("_r.place_id")) & F.col("county_id").eqNullSafe(F.col("_r.county_id"))
    change = F.when(F.col("_n") > 1, "CORRUPT").when(same, "SAME").when(F.col("_r").isNull(), "CLEARED").otherwise("UPDATED")
    return rows.withColumn("cache_change", change).withColumns(new).drop("_n", "_r")


def ambiguity_queue(resolutions: DataFrame, candidates: DataFrame) -> DataFrame:
    """Unresolved resolutions with their candidate counties; ids only."""
    named = candidates.groupBy("location_id").agg(F.sort_array(F.collect_list("county_id")).alias("county_ids"))
    return resolutions.where(~F.col("match_method").isin(RESOLVED)).select("location_id", "match_method", "confidence").join(named, "location_id", "left")


def apply_manual_resolutions(resolutions: DataFrame, picks: DataFrame) -> DataFrame:
    """Picks (location_id, county_id) supersede what is current."""
    hit = picks.select("location_id").distinct().withColumn("_hit", F.lit(True))
    old = resolutions.join(hit, "location_id", "left").withColumn("status", F.when(F.col("_hit") & (F.col("status") == "CURRENT"), "SUPERSEDED").otherwise(F.col("status"))).drop("_hit")
    new = picks.select("location_id", "county_id", F.lit("MANUALLY_RESOLVED").alias("match_method"), F.lit("HIGH").alias("confidence"), F.lit("CURRENT").alias("status"))
    return old.unionByName(new, allowMissingColumns=True)
