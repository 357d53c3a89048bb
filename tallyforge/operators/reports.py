"""Reports, exports and privacy."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.parsing import safe_cell

# Buckets of the status report, in order.
STATUSES = ["ACTIVE", "PROVISIONAL", "LIKELY", "PREVIOUSLY_RECURRING", "LAPSED", "ONE_TIME", "UNKNOWN", "INSUFFICIENT_HISTORY", "DATASET_TOO_STALE"]


def counted(contributions: DataFrame, batches: DataFrame) -> DataFrame:
    """ACTIVE contributions of completed batches, which is what reports add up."""
    done = batches.where("status = 'COMPLETED'").select("import_batch_id")  # a batch is many rows
    return contributions.where("status = 'ACTIVE'").join(done, "import_batch_id", "left_semi")


def dashboard_metrics(contributions: DataFrame, batches: DataFrame, entities: DataFrame, rows: DataFrame) -> DataFrame:
    """One row of totals of active contributions in completed batches, individuals, failed and duplicate rows."""
    a = counted(contributions, batches).agg(F.count("*").alias("n_contributions"), F.coalesce(F.sum("amount"), F.lit(0)).alias("total_amount"))
    b = entities.agg(F.count_if(F.col("entity_type") == "INDIVIDUAL").alias("n_individuals"))
    c = rows.agg(F.count_if(F.col("validation_status") == "VALIDATION_FAILURE").alias("n_failed"), F.count_if(F.col("validation_status") == "EXACT_DUPLICATE").alias("n_duplicates"))
    return a.crossJoin(b).crossJoin(c)  # three single rows


def last_imports(batches: DataFrame, n: int = 5) -> DataFrame:
    """The newest imports."""
    return batches.orderBy(F.desc("imported_at"), F.desc("import_batch_id")).limit(n)


def status_breakdown(entities: DataFrame, latest: DataFrame) -> DataFrame:
    """Assessed individuals by latest status, with all buckets; other statuses are not counted."""
    people = entities.where("entity_type = 'INDIVIDUAL'").select("entity_id").join(latest.select("entity_id", "calculated_status"), "entity_id")
    counts = people.groupBy(F.col("calculated_status").alias("status")).agg(F.count("*").alias("n"))
    buckets = entities.sparkSession.createDataFrame([(s,) for s in STATUSES], "status string")
    return buckets.join(counts, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def people_directory(entities: DataFrame, contributions: DataFrame, batches: DataFrame, latest: DataFrame, locations: DataFrame) -> DataFrame:
    """Individuals with latest status, totals and the current place with the lowest location id. Who was never
    assessed is UNKNOWN with 0, who never gave has 0, a place that is not known is empty."""
    totals = counted(contributions, batches).groupBy("entity_id").agg(F.sum("amount").alias("total"), F.max("transaction_date").alias("last_date"), F.count("*").alias("n"))
    place = locations.where("status = 'CURRENT'").groupBy("entity_id").agg(F.min_by(F.struct("city", "zip"), "location_id").alias("_p"))
    rows = entities.where("entity_type = 'INDIVIDUAL'").select("entity_id", "display_name")
    rows = rows.join(latest.select("entity_id", "calculated_status", "recurring_amount"), "entity_id", "left").join(totals, "entity_id", "left").join(place, "entity_id", "left")
    zero, empty = F.lit(0), F.lit("")
    return rows.select(
        "entity_id", "display_name", F.coalesce("calculated_status", F.lit("UNKNOWN")).alias("status"), F.coalesce("recurring_amount", zero).alias("recurring_amount"),
        F.coalesce("total", zero).alias("total"), "last_date", F.coalesce("n", zero).alias("n"), F.coalesce("_p.city", empty).alias("city"), F.coalesce("_p.zip", empty).alias("zip"),
    )


#: Where people are searched: field -> table.
SEARCHED = {
    "display_name": "entities", "first_name": "entities", "last_name": "entities", "zip": "locations", "city": "locations",
    "employer": "contributions", "occupation": "contributions", "txn": "contributions",
}


def search_values(entities: DataFrame, contributions: DataFrame, locations: DataFrame) -> DataFrame:
    """(value, entity_id): what each individual can be found by, in lower case, each value once."""
    tables = {"entities": entities, "contributions": contributions, "locations": locations}
    people = entities.where("entity_type = 'INDIVIDUAL'").select("entity_id")
    parts = []
    for name, rows in tables.items():
        fields = [F.lower(f) for f, t in SEARCHED.items() if t == name]
        own = rows.where("entity_type = 'INDIVIDUAL'") if name == "entities" else rows
        parts.append(own.select("entity_id", F.explode(F.array_distinct(F.array_compact(F.array(*fields)))).alias("value")).where("value <> ''").distinct())
    every = parts[0].unionByName(parts[1].unionByName(parts[2]).join(people, "entity_id", "left_semi"))
    return every.distinct().select("value", "entity_id")


def _grams(value: Column, n: int) -> Column:
    """All runs of n characters, each once; none of a shorter value."""
    last = F.length(value) - (n - 1)
    return F.when(last > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(value, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


@dataclass(frozen=True)
class SearchIndex:
    """Values with their entities, and which values hold a run of one to three characters."""

    values: DataFrame
    postings: DataFrame

    def write(self, path: str) -> None:
        """Sorted by run and by value, so that a look-up reads the row groups it needs."""
        self.values.repartitionByRange("value").sortWithinPartitions("value", "entity_id").write.parquet(f"{path}/values")
        self.postings.repartitionByRange("gram", "value").sortWithinPartitions("gram", "value").write.parquet(f"{path}/postings")

    @staticmethod
    def read(spark: SparkSession, path: str) -> SearchIndex:
        return SearchIndex(spark.read.parquet(f"{path}/values"), spark.read.parquet(f"{path}/postings"))


def search_index(entities: DataFrame, contributions: DataFrame, locations: DataFrame) -> SearchIndex:
    """An index of runs over the distinct values of the eight fields; a value that a third of all rows have is one."""
    values = search_values(entities, contributions, locations)
    every = F.concat(*[_grams(F.col("value"), n) for n in (1, 2, 3)])
    return SearchIndex(values, values.select("value").distinct().select(F.explode(every).alias("gram"), "value"))


def people_search(index: SearchIndex, patterns: DataFrame) -> DataFrame:
    """(pattern, entity_id) of individuals one of whose values contains the pattern, in any case; an empty pattern
    finds nobody. patterns: (pattern), a list that somebody typed.

    Values that hold all of a pattern's runs are the candidates, which are then looked at; neither contributions nor the
    list of values is scanned as a whole.
    """
    text = F.lower("pattern")
    runs = F.when(F.length(text) >= 3, _grams(text, 3)).when(F.length(text) == 2, _grams(text, 2)).otherwise(_grams(text, 1))
    asked = patterns.select("pattern").distinct().select("pattern", text.alias("_text"), F.explode(runs).alias("gram"), F.size(runs).alias("_runs"))
    met = index.postings.join(asked, "gram").groupBy("pattern", "_text", "_runs", "value").agg(F.count("*").alias("_n"))
    found = met.where((F.col("_n") == F.col("_runs")) & F.col("value").contains(F.col("_text"))).select("pattern", "value")
    return index.values.join(found, "value").select("pattern", "entity_id").distinct()


def filter_by_status(entities: DataFrame, assessments: DataFrame, status: str) -> DataFrame:
    """Individuals whose assessment with the largest id has the status; UNKNOWN takes in those without one."""
    last = assessments.groupBy("entity_id").agg(F.max_by("calculated_status", "assessment_id").alias("_status"))
    rows = entities.where("entity_type = 'INDIVIDUAL'").join(last, "entity_id", "left")
    own = F.coalesce("_status", F.lit("UNKNOWN")) if status == "UNKNOWN" else F.col("_status")
    return rows.where(own == status).drop("_status")


def profile_totals(contributions: DataFrame) -> DataFrame:
    """P5: what each entity gave and got back."""
    up, down = F.greatest("amount", F.lit(0)), F.least("amount", F.lit(0))
    return contributions.groupBy("entity_id").agg(
        F.sum(up).cast("decimal(22,2)").alias("given"), F.sum(down).cast("decimal(22,2)").alias("returned"), F.sum("amount").alias("net"), F.count("*").alias("n")
    )


def profile_timeline(contributions: DataFrame, assignments: DataFrame, batches: DataFrame, raw_names: DataFrame) -> DataFrame:
    """P5: contributions of each entity with an active assignment, of completed batches, numbered from the newest
    (of one day, the largest id), with the name as it was given (contribution_id, raw_name)."""
    done = batches.where("status = 'COMPLETED'").select("import_batch_id")
    own = assignments.where("is_active").select("contribution_id", "entity_id")
    rows = contributions.drop("entity_id").join(own, "contribution_id").join(done, "import_batch_id", "left_semi").join(raw_names, "contribution_id", "left")
    order = Window.partitionBy("entity_id").orderBy(F.desc("transaction_date"), F.desc("contribution_id"))
    return rows.select("entity_id", F.row_number().over(order).alias("place"), "contribution_id", "transaction_date", "amount", F.coalesce("raw_name", F.lit("")).alias("raw_name"))


def export_roster(entities: DataFrame, latest: DataFrame) -> DataFrame:
    """Individuals by name, with cells made safe for spreadsheets; a range-partitioned sort."""
    rows = entities.where("entity_type = 'INDIVIDUAL'").select("entity_id", "display_name").join(latest.select("entity_id", "calculated_status"), "entity_id", "left")
    return rows.orderBy("display_name", "entity_id").select("entity_id", safe_cell(F.col("display_name")).alias("display_name"), F.coalesce("calculated_status", F.lit("UNKNOWN")).alias("status"))


PRIVATE = ["display_name", "name", "first_name", "middle_name", "last_name", "street", "raw_address", "employer", "occupation"]


def redact(rows: DataFrame, allowed: bool = False) -> DataFrame:
    """Without permission, columns that name or place a person are masked; to be applied before any join."""
    return rows if allowed else rows.withColumns({c: F.lit("[redacted]") for c in PRIVATE if c in rows.columns})


def audit_log(events: DataFrame, text: str | None = None) -> DataFrame:
    """Newest first."""
    rows = events if text is None else events.where(F.lower("entity").contains(text.lower()))
    return rows.orderBy(F.desc("created_at"), F.desc("event_id"))


# What names of test entities hold, as written.
TEST_NAMES = ["Bench", "Test", "Resolver", "Atomicity"]


def synthetic_entities(entities: DataFrame, assignments: DataFrame, assessments: DataFrame, results: DataFrame, events: DataFrame, keywords: list[str] = TEST_NAMES) -> DataFrame:
    """Entities without assignments that are named like a test or were never assessed, with what depends on them.

    assignments, assessments, results: (entity_id), any number of rows each; events: (description). An event counts for
    an entity if its description holds the id's digits anywhere, so that runs of digits are cut into all their parts,
    which meet the ids by an equi-join. Keywords are plain strings, upper and lower case told apart.
    """
    free = entities.select("entity_id", "display_name", "entity_type").join(assignments.select("entity_id").distinct(), "entity_id", "left_anti")
    named = reduce(lambda a, b: a | b, [F.coalesce(F.col("display_name").contains(k), F.lit(False)) for k in keywords], F.lit(False))
    count = lambda rows, name: rows.groupBy("entity_id").agg(F.count("*").alias(name))
    rows = free.join(count(assessments, "n_assessments"), "entity_id", "left").where(named | F.col("n_assessments").isNull())
    digits = F.regexp_extract_all("description", F.lit("([0-9]+)"))
    parts = F.flatten(F.transform(digits, lambda d: F.flatten(F.transform(F.sequence(F.lit(1), F.length(d)), lambda i: F.transform(F.sequence(F.lit(1), F.length(d) - i + 1), lambda n: F.substring(d, i, n))))))
    told = events.select(F.explode(F.array_distinct(parts)).alias("_id")).where("length(_id) <= 19").groupBy("_id").agg(F.count("*").alias("n_events"))
    rows = rows.withColumn("named", named).join(count(results, "n_results"), "entity_id", "left").join(told, F.col("entity_id").cast("string") == F.col("_id"), "left")
    n = {c: F.coalesce(c, F.lit(0)).alias(c) for c in ("n_assessments", "n_results", "n_events")}
    return rows.select("entity_id", "display_name", "entity_type", "named", *n.values(), F.lit("SYNTHETIC_BENCHMARK_DISPOSABLE").alias("disposition"))


def clean_synthetic(entities: DataFrame, candidates: DataFrame, assignments: DataFrame) -> DataFrame:
    """Entities without the candidates; one that got an assignment meanwhile stays."""
    return entities.join(candidates.select("entity_id").join(assignments.select("entity_id").distinct(), "entity_id", "left_anti"), "entity_id", "left_anti")
