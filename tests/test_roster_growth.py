"""What roster jobs hold and compute as their inputs grow: shapes of plans, on small invented tables."""

from __future__ import annotations

from datetime import date, timedelta
from decimal import Decimal
from glob import glob

from pyspark.sql import functions as F

from tallyforge.operators import ingest, membership, quality, reevaluation
from tallyforge.plans import catalogue, queries
from tallyforge.sources.versions import Versioned


def plan_of(df) -> str:
    """The physical plan before any of it has run."""
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))


def test_constraints_are_added_up_once_after_their_claims_are_dealt(spark):
    rows = [(1, 1, None), (1, 1, 5), (1, 2, 5), (2, 1, 5), (None, 1, 5), (None, 1, 5)]
    raw = spark.createDataFrame([(a, b) for a, b, _ in rows], "import_batch_id long, row_number long")
    amendments = spark.createDataFrame([(1, 4, 4), (2, 4, 5), (3, 4, 5), (4, None, 5), (5, None, 5)], "amendment_id long, original_contribution_id long, replacement_contribution_id long")
    patterns = spark.createDataFrame([(1,), (2,), (2,), (2,), (None,), (None,)], "cluster_id long")
    found = quality.check_invariants({"raw_rows": raw, "amendments": amendments, "patterns": patterns})
    plan = plan_of(found)
    assert sorted(map(tuple, found.collect())) == [
        ("amendment is not of itself", "1", 1), ("one amendment for a pair", "4:5", 2), ("one pattern for a cluster", "2", 3), ("one row for a place in a batch", "1:1", 2),
    ]
    assert found.columns == ["check", "key", "n"]
    # a scan holds no keys: nothing is added up before the shuffle, and its number of parts is named, so that it stays
    exchanges = [line for line in plan.splitlines() if "Exchange" in line]
    assert len(exchanges) == 1 and "REPARTITION_BY_NUM" in exchanges[0]
    assert "HashAggregate" not in plan.split("Exchange", 1)[1]


def test_payments_of_changed_entities_are_dealt_before_they_meet_the_keys(spark, tmp_path, monkeypatch):
    entities = spark.createDataFrame([(i, "INDIVIDUAL", "VERIFIED") for i in range(6)], "entity_id long, entity_type string, verification_status string")
    pays = [(i, i % 6, date(2024, 1, 1) + timedelta(31 * (i // 6)), Decimal(10 + i), "CONTRIBUTION") for i in range(30)]
    payments = spark.createDataFrame(pays, "contribution_id long, entity_id long, transaction_date date, amount decimal(12,2), transaction_type string")
    rule, coverage, day = membership.Rule(), membership.Coverage(date(2024, 6, 1)), date(2024, 6, 1)
    store, plans = Versioned(spark, str(tmp_path), "entity_id", 4), []
    store.load(reevaluation.memberships(entities, payments, rule, coverage, day), 1)
    seen = Versioned.merge
    monkeypatch.setattr(Versioned, "merge", lambda self, keys, rows, run: plans.append(plan_of(rows)) or seen(self, keys, rows, run))
    left = payments.where("contribution_id < 24")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        reevaluation.refresh_memberships(store, entities.where("entity_id < 3"), entities, left, rule, coverage, day, 2)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    got = {r["entity_id"]: r for r in store.current(reevaluation.memberships(entities, payments, rule, coverage, day).schema).collect()}
    # the last three of four and of five payments, 31 days apart
    assert {k: (r["positive_count"], r["recurring_amount"], r["interval_days"]) for k, r in got.items()} == {
        i: (4, Decimal(22 + i), [31] * 3) if i < 3 else (5, Decimal(28 + i), [31] * 4) for i in range(6)
    }
    dealt = [line for line in plans[0].splitlines() if "Exchange hashpartitioning(entity_id" in line and "REPARTITION_BY_NUM" in line]
    assert dealt and plans[0].count("Window") == 1


def test_a_large_part_is_written_by_several_tasks(spark, tmp_path):
    rows = spark.range(3000).select(F.col("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "20k")
    try:
        store = Versioned(spark, str(tmp_path), "k", 2)
        store.load(rows.repartition(8), 1)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert len(glob(f"{tmp_path}/rows/run=1/part=*/*.parquet")) > 2
    assert sorted(r["k"] for r in store.current(rows.schema).collect()) == list(range(3000))


def test_rows_are_scanned_once_where_duplicates_are_flagged(spark):
    day = date(2024, 1, 1)
    rows = [
        (1, 1, "A", Decimal(5), day, "X", "1", False, ""), (1, 2, "A", Decimal(5), day, "X", "1", False, ""), (1, 3, "A", Decimal(6), day, "X", "1", False, ""),
        (1, 4, "", Decimal(5), day, "X", "1", False, ""), (1, 5, "", Decimal(7), day, "Y", "1", False, ""), (1, 6, None, Decimal(7), day, "Y", "1", False, ""),
        (1, 7, "B", Decimal(9), day, "Z", "1", True, ""), (1, 8, "B", Decimal(9), day, "Z", "1", False, ""), (1, 9, "C", None, day, "Z", "1", False, "bad"), (1, 10, "C", Decimal(1), day, "Z", "1", False, ""),
        (2, 11, "A", Decimal(5), day, "X", "1", False, ""), (1, 12, "", Decimal(9), day, "Z", "1", True, ""), (1, 13, "H", Decimal(2), day, "V", "1", False, ""),
    ]
    df = spark.createDataFrame(rows, "import_batch_id long, row_number long, txn string, amount decimal(12,2), transaction_date date, normalized_name string, zip string, exact_duplicate boolean, validation_message string")
    history = spark.createDataFrame([("H", Decimal("9.00"), day, "OLD", "1")], "txn string, amount decimal(12,2), transaction_date date, normalized_name string, zip string")
    flagged = ingest.flag_duplicates(df)
    assert plan_of(flagged).count("Scan ExistingRDD") == 1
    assert {r["row_number"]: r["validation_status"] for r in flagged.collect()} == {
        1: "ACCEPTED", 2: "POSSIBLE_DUPLICATE", 3: "POSSIBLE_AMENDMENT", 4: "POSSIBLE_DUPLICATE", 5: "ACCEPTED", 6: "POSSIBLE_DUPLICATE", 7: "EXACT_DUPLICATE", 8: "ACCEPTED", 9: "VALIDATION_FAILURE", 10: "ACCEPTED",
        11: "ACCEPTED", 12: "EXACT_DUPLICATE", 13: "ACCEPTED",
    }
    got = {r["row_number"]: (r["validation_status"], r["txn_in_history"]) for r in ingest.flag_duplicates(df, history).collect()}
    assert len(got) == 13 and got[13] == ("POSSIBLE_AMENDMENT", True) and not any(h for k, (_, h) in got.items() if k != 13)


def test_names_are_parsed_once(spark, tmp_path, monkeypatch):
    cells = "import_batch_id long, row_number long, name string, amount_text string, date_text string, txn string, zip string, city string, state string, street string, employer string, occupation string"
    raw = spark.createDataFrame([(i % 7, i, ["Lee, Kim", "Ann Poe"][i % 2], "5", "2024-01-01", f"T{i}", "90001", "X", "CA", "", "Emp", "") for i in range(30)], cells)
    seen = spark.sparkContext.accumulator(0)

    def told(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    raw = raw.coalesce(1).mapInArrow(told, raw.schema)
    for name in ("identity_clusters", "identity_entities", "identity_locations", "ingest_reprocess", "ingest_reprocessed_contributions", "reports_dashboard"):
        before = seen.value
        monkeypatch.setattr(queries, "view", lambda spark, folder, view: raw if view == "raw_rows" else own[view])
        own = {
            "entities": spark.createDataFrame([("INDIVIDUAL",)], "entity_type string"), "batches": spark.createDataFrame([(1, "COMPLETED")], "import_batch_id long, status string"),
            "payments": spark.createDataFrame([(1, Decimal(5), "ACTIVE")], "import_batch_id long, amount decimal(12,2), status string"),
        }
        assert catalogue.QUERIES[name](spark, "").collect()
        assert seen.value - before == 30, name
