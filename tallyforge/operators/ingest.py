"""Import of contribution rows: mapping, validation, duplicates, batches."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import normalize_name
from ..functions.parsing import pad_zip, parse_amount, parse_date, raw_address, row_hash
from ..sources.scratch import keep

# Target fields of a mapping, and statuses.
FIELDS = {
    "NAME OF CONTRIBUTOR": "name", "AMOUNT": "amount_text", "TRANSACTION DATE": "date_text", "TRANSACTION NUMBER": "txn", "ZIP": "zip",
    "CITY": "city", "STATE": "state", "STREET ADDRESS": "street", "EMPLOYER": "employer", "OCCUPATION": "occupation", "PAYMENT TYPE": "payment_type",
    "ID NUMBER": "id_number", "FILED DATE": "filed_date",
}
REQUIRED = ["NAME OF CONTRIBUTOR", "AMOUNT", "TRANSACTION DATE"]
PROBLEMS = ["EXACT_DUPLICATE", "POSSIBLE_DUPLICATE", "POSSIBLE_AMENDMENT", "VALIDATION_FAILURE", "UNPROCESSED"]
IMPORTED = ["ACCEPTED", "POSSIBLE_DUPLICATE", "POSSIBLE_AMENDMENT"]


def apply_mapping_profile(rows: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Target fields from the file's headers; what is not mapped is empty. The file's own cells stay for the hash."""
    missing = [f for f in REQUIRED if not mapping.get(f)]
    if missing:
        raise ValueError(f"mapping lacks {', '.join(missing)}")
    source = dict(mapping)
    source.setdefault("TRANSACTION NUMBER", source.get("TRANSACTION ID", ""))
    cell = lambda f: F.coalesce(F.trim(F.col(f"`{source[f]}`")), F.lit("")) if source.get(f) else F.lit("")
    return rows.select("*", *[cell(f).alias(to) for f, to in FIELDS.items()])


def parse_rows(rows: DataFrame) -> DataFrame:
    """Amount, date, normalised name and padded ZIP of mapped rows; narrow."""
    return rows.withColumns(
        {"amount": parse_amount(F.col("amount_text")), "transaction_date": parse_date(F.col("date_text")), "person": normalize_name(F.col("name")), "zip5": pad_zip(F.col("zip"))}
    ).withColumn("normalized_name", F.col("person.full"))


def with_row_hash(rows: DataFrame, columns: list[str]) -> DataFrame:
    """I4."""
    return rows.withColumn("row_hash", row_hash(columns))


def validate_rows(rows: DataFrame) -> DataFrame:
    """validation_message, empty for a good row; flag_duplicates() replaces that of exact duplicates."""
    return rows.withColumn(
        "validation_message",
        F.concat_ws(
            "; ",
            F.when(F.coalesce("name", F.lit("")) == "", "Missing name of contributor."),
            F.when(F.col("amount").isNull(), F.concat(F.lit("Invalid amount value: '"), F.coalesce("amount_text", F.lit("")), F.lit("'."))),
            F.when(F.col("transaction_date").isNull(), F.concat(F.lit("Invalid date value: '"), F.coalesce("date_text", F.lit("")), F.lit("'."))),
        ),
    )


def _order(*keys: str):
    return Window.partitionBy("import_batch_id", *keys).orderBy("row_number")


def flag_exact_duplicates(rows: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """I8: a row whose hash is an earlier row's of its batch, or an accepted one's of another completed batch.

    history: (row_hash, import_batch_id) of accepted rows of completed batches."""
    rows = rows.withColumn("exact_duplicate", F.row_number().over(_order("row_hash")) > 1)
    if history is None:
        return rows
    spread = history.groupBy("row_hash").agg(F.min("import_batch_id").alias("_lo"), F.max("import_batch_id").alias("_hi"))
    seen = F.coalesce((F.col("_lo") != F.col("import_batch_id")) | (F.col("_hi") != F.col("import_batch_id")), F.lit(False))
    return rows.join(spread, "row_hash", "left").withColumn("exact_duplicate", F.col("exact_duplicate") | seen).drop("_lo", "_hi")


def _earlier(rows: DataFrame, keys: list[str], counts: Column, name: str) -> DataFrame:
    """How many earlier rows of the batch have these keys; the keys of a row that does not count are its own."""
    own = F.when(~counts, F.col("row_number"))
    return rows.withColumn("_own", own).withColumn(name, F.count("*").over(_order(*keys, "_own").rowsBetween(Window.unboundedPreceding, -1))).drop("_own")


def flag_duplicates(rows: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """validation_status of validated rows with exact_duplicate.

    history: contributions of completed batches (txn, amount, transaction_date, normalized_name, zip). Rows go through
    one after the other of these windows once, so that nothing is parsed twice. In a window that a row has no part in
    (a bad one in any, one without a transaction number in those by number) it is alone, so that the many blank numbers
    share no key."""
    txn = F.coalesce("txn", F.lit(""))
    good, numbered = F.col("_ok"), F.col("_ok") & (txn != "")
    out = rows.withColumn("_ok", ~F.col("exact_duplicate") & (F.col("validation_message") == ""))
    out = _earlier(out, ["amount", "transaction_date", "normalized_name", "zip"], good, "_n_like")
    keys = {"like": ["amount", "transaction_date", "normalized_name", "zip"], "txn": ["txn"], "same": ["txn", "amount", "transaction_date"]}
    for name, on in keys.items():
        if history is None:
            out = out.withColumn(f"_h_{name}", F.lit(False))
        else:
            known = history.where("txn != ''") if "txn" in on else history
            out = out.join(known.select(*on).distinct().withColumn(f"_h_{name}", F.lit(True)), on, "left").withColumn(f"_h_{name}", F.col("_ok") & F.coalesce(f"_h_{name}", F.lit(False)))
    out = _earlier(_earlier(out, ["txn"], numbered, "_n_txn"), ["txn", "amount", "transaction_date"], numbered, "_n_same")
    status = (
        F.when(F.col("exact_duplicate"), "EXACT_DUPLICATE")
        .when(~F.col("_ok"), "VALIDATION_FAILURE")
        .when(txn == "", F.when((F.col("_n_like") > 0) | F.col("_h_like"), "POSSIBLE_DUPLICATE").otherwise("ACCEPTED"))
        .when((F.col("_n_same") > 0) | F.col("_h_same"), "POSSIBLE_DUPLICATE")
        .when((F.col("_n_txn") > 0) | F.col("_h_txn"), "POSSIBLE_AMENDMENT")
        .otherwise("ACCEPTED")
    )
    message = F.when(F.col("exact_duplicate"), "Exact row hash already imported.").otherwise(F.col("validation_message"))
    return out.withColumn("validation_message", message).select(*rows.columns, status.alias("validation_status"), F.col("_h_txn").alias("txn_in_history"))


def classify_transaction_type(rows: DataFrame) -> DataFrame:
    """Amounts under zero by transaction number, history and name."""
    txn, name = F.upper("txn"), F.upper("name")
    return rows.withColumn(
        "transaction_type",
        F.when(F.col("amount") >= 0, "CONTRIBUTION")
        .when(txn.startswith("REF") | F.col("txn_in_history"), "REFUND")
        .when(txn.startswith("REV"), "REVERSAL")
        .when(name.contains("REFUND"), "REFUND")
        .when(name.contains("REVERSAL"), "REVERSAL")
        .otherwise("ADJUSTMENT"),
    )


def contributions(rows: DataFrame) -> DataFrame:
    """Rows that are imported, with type and raw address."""
    own = classify_transaction_type(rows.where(F.col("validation_status").isin(IMPORTED)))
    return own.withColumn("raw_address", raw_address(*(F.col(c) for c in ("street", "city", "state", "zip"))))


def batch_summary(rows: DataFrame) -> DataFrame:
    """I14."""
    status = F.col("validation_status")
    return rows.groupBy("import_batch_id").agg(
        F.count("*").alias("n_rows"),
        F.count_if(status.isin(IMPORTED)).alias("successful"),
        F.count_if(status == "VALIDATION_FAILURE").alias("failed"),
        F.count_if(status == "EXACT_DUPLICATE").alias("duplicates"),
    )


def import_failures(rows: DataFrame) -> DataFrame:
    """I15."""
    return rows.where(F.col("validation_status").isin(PROBLEMS))


def import_preview(rows: DataFrame, n: int = 5) -> DataFrame:
    """I16: the first rows of each batch by row number."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("import_batch_id").orderBy("row_number"))).where(F.col("_n") <= n).drop("_n")


def provenance_links(imported: DataFrame) -> DataFrame:
    """One raw-to-contribution link for each contribution."""
    return imported.select(
        F.lit("RawContribution").alias("source_type"), F.concat_ws(":", "import_batch_id", "row_number").alias("source_id"),
        F.lit("Contribution").alias("target_type"), F.col("contribution_id").alias("target_id"),
    )


def reconcile_batch(rows: DataFrame) -> DataFrame:
    """Rows by outcome, expected contributions (distinct hashes less failures) and the difference."""
    status = F.col("validation_status")
    return (
        rows.groupBy("import_batch_id")
        .agg(
            F.count("*").alias("n_rows"),
            F.count_distinct("row_hash").alias("distinct_hashes"),
            F.count_if(status == "VALIDATION_FAILURE").alias("failures"),
            F.count_if(status.isin(IMPORTED)).alias("imported"),
        )
        .withColumn("expected", F.col("distinct_hashes") - F.col("failures"))
        .withColumn("difference", F.col("imported") - F.col("expected"))
    )


def block_duplicate_files(files: DataFrame, batches: DataFrame, override: bool = False) -> DataFrame:
    """Files (path, file_hash) that may be imported: whose hash no completed batch has, or with an override all of
    them, with the batch (the lowest, reprocess_batch_id) that such a file takes the place of."""
    done = batches.where("status = 'COMPLETED'").groupBy("file_hash").agg(F.min("import_batch_id").alias("reprocess_batch_id"))
    return files.join(done, "file_hash", "left") if override else files.join(done, "file_hash", "left_anti")


def file_attempts(files: DataFrame, batches: DataFrame, override: bool = False) -> DataFrame:
    """(import_batch_id, action, notes) of the attempts to import a file that a completed batch has."""
    known = block_duplicate_files(files, batches, True).where("reprocess_batch_id is not null")
    if override:
        return known.select(F.col("reprocess_batch_id").alias("import_batch_id"), F.lit("REPROCESS_START").alias("action"), F.format_string("Reprocessing of batch %s initiated.", F.col("reprocess_batch_id").cast("string")).alias("notes"))
    said = F.format_string("Attempted to import duplicate file hash '%s' without authorization override.", F.col("file_hash"))
    return known.select(F.col("reprocess_batch_id").alias("import_batch_id"), F.lit("REPROCESS_FAILED").alias("action"), said.alias("notes"))


def reset_batches(statuses: DataFrame, batch_ids: DataFrame) -> DataFrame:
    """Rows of the batches are unprocessed again."""
    hit = batch_ids.select("import_batch_id").distinct().withColumn("_hit", F.lit(True))
    new = {"validation_status": "UNPROCESSED", "validation_message": ""}
    return statuses.join(hit, "import_batch_id", "left").withColumns({c: F.when(F.col("_hit"), v).otherwise(F.col(c)) for c, v in new.items()}).select(statuses.columns)


def reprocess_batches(parsed: DataFrame, statuses: DataFrame, batches: DataFrame, batch_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(statuses, contributions of the batches) after the batches are evaluated again.

    parsed: all rows of parse_rows() with row_hash; statuses: (import_batch_id, row_number, validation_status,
    validation_message) as stored. The batches are pending meanwhile, so that they are no history to themselves; the
    history is what other completed batches have. Only rows of the batches are evaluated; several are evaluated at once,
    each against the others that stay.
    """
    ids = batch_ids.select("import_batch_id").distinct()
    done = batches.where("status = 'COMPLETED'").select("import_batch_id").join(ids, "import_batch_id", "left_anti")
    told = statuses.where(F.col("validation_status").isin(IMPORTED)).select("import_batch_id", "row_number", "validation_status")
    own = parsed.select("import_batch_id", "row_number", "row_hash", "txn", "amount", "transaction_date", "normalized_name", "zip")
    # four joins read this
    stored = keep(own.join(told, ["import_batch_id", "row_number"]).join(done, "import_batch_id", "left_semi"), "stored")
    hashes = stored.where("validation_status = 'ACCEPTED'").select("row_hash", "import_batch_id")
    history = stored.select("txn", "amount", "transaction_date", "normalized_name", "zip")
    fresh = parsed.join(ids, "import_batch_id", "left_semi")
    again = flag_duplicates(flag_exact_duplicates(validate_rows(fresh), hashes), history)
    kept = statuses.join(ids, "import_batch_id", "left_anti")
    return kept.unionByName(again.select(statuses.columns)), contributions(again)


def flip_batches(assignments: DataFrame, batch_ids: DataFrame, active: bool) -> tuple[DataFrame, DataFrame]:
    """Assignments with those of the batches (in)active, and the clusters that this touches."""
    flagged = assignments.join(batch_ids.select("import_batch_id").distinct().withColumn("_hit", F.lit(True)), "import_batch_id", "left")
    out = flagged.withColumn("is_active", F.when(F.col("_hit"), F.lit(active)).otherwise(F.col("is_active"))).drop("_hit")
    return out, flagged.where("_hit").select("cluster_id").distinct()


def purge_plan(assignments: DataFrame, decisions: DataFrame, batch_ids: DataFrame, matches: DataFrame | None = None) -> DataFrame:
    """Clusters that go with the batches: none of their assignments survives and no decision (merge, or match with
    cluster_id) names them."""
    ids = batch_ids.select("import_batch_id").distinct()
    touched = assignments.join(ids, "import_batch_id", "left_semi").select("cluster_id").distinct()
    survive = assignments.join(ids, "import_batch_id", "left_anti").select("cluster_id").distinct()
    named = decisions.select(F.col("source_cluster_id").alias("cluster_id")).union(decisions.select("target_cluster_id"))
    named = (named if matches is None else named.union(matches.select("cluster_id"))).distinct()
    return touched.join(survive, "cluster_id", "left_anti").join(named, "cluster_id", "left_anti")


def purge_entities(assignments: DataFrame, batch_ids: DataFrame, clusters: DataFrame, gone: DataFrame, entities: DataFrame, assessments: DataFrame) -> DataFrame:
    """Entities that go with the clusters of purge_plan(): of those with a cluster (cluster_id, entity_id) in the
    batches, the ones without a cluster that stays, a manual assessment or a verification."""
    touched = assignments.join(batch_ids.select("import_batch_id").distinct(), "import_batch_id", "left_semi").select("cluster_id").distinct()
    owners = clusters.join(touched, "cluster_id", "left_semi").select("entity_id").distinct()
    stay = clusters.join(gone, "cluster_id", "left_anti").select("entity_id")
    manual = assessments.where("manual_override").select("entity_id")
    verified = entities.where("verification_status = 'VERIFIED'").select("entity_id")
    return entities.select("entity_id").join(owners, "entity_id", "left_semi").join(stay.union(manual).union(verified).distinct(), "entity_id", "left_anti")


def purge_cascade(
    batch_ids: DataFrame, contributions: DataFrame, assignments: DataFrame, clusters: DataFrame, merges: DataFrame, matches: DataFrame, entities: DataFrame, assessments: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(what goes and why the rest stays) of a purge: clusters and entities that the batches touch.

    Clusters: (cluster_id, surviving, merged, matched, orphaned): a cluster goes if no assignment of another batch, no
    merge and no match names it. Entities: (entity_id, remaining, manual, verified, orphaned): one goes if none of its
    clusters (cluster_id, entity_id) remains and it has neither a manual assessment nor a verification. Deletion and
    preview both read these two tables, so that they cannot differ; contributions and raw rows go by their batch.
    """
    ids = batch_ids.select("import_batch_id").distinct()
    own = assignments.join(ids.withColumn("_gone", F.lit(True)), "import_batch_id", "left")
    per = own.groupBy("cluster_id").agg(F.count("_gone").alias("_going"), F.count_if(F.col("_gone").isNull()).alias("surviving")).where("_going > 0")
    merged = merges.select(F.col("source_cluster_id").alias("cluster_id")).union(merges.select("target_cluster_id")).distinct().withColumn("merged", F.lit(True))
    matched = matches.select("cluster_id").distinct().withColumn("matched", F.lit(True))
    no = lambda c: F.coalesce(c, F.lit(False))
    touched = per.join(merged, "cluster_id", "left").join(matched, "cluster_id", "left").select("cluster_id", "surviving", no("merged").alias("merged"), no("matched").alias("matched"))
    touched = touched.withColumn("orphaned", (F.col("surviving") == 0) & ~F.col("merged") & ~F.col("matched"))
    held = clusters.select("cluster_id", "entity_id").join(touched.select("cluster_id", "orphaned"), "cluster_id", "left")
    owned = held.groupBy("entity_id").agg(F.count("orphaned").alias("_touched"), F.count_if(~no("orphaned")).alias("remaining")).where("_touched > 0 and entity_id is not null")
    manual = assessments.where("manual_override").select("entity_id").distinct().withColumn("manual", F.lit(True))
    verified = entities.select("entity_id", (F.col("verification_status") == "VERIFIED").alias("verified"))
    rows = owned.join(verified, "entity_id").join(manual, "entity_id", "left").select("entity_id", "remaining", no("manual").alias("manual"), no("verified").alias("verified"))
    return touched, rows.withColumn("orphaned", (F.col("remaining") == 0) & ~F.col("manual") & ~F.col("verified"))


def purge_preview(batch_ids: DataFrame, rows: DataFrame, contributions: DataFrame, touched: DataFrame, owners: DataFrame) -> DataFrame:
    """(item, n) of a purge, from the tables of purge_cascade()."""
    ids = batch_ids.select("import_batch_id").distinct()
    count = lambda df, **items: df.agg(*[F.struct(F.lit(k).alias("item"), v.alias("n")).alias(k) for k, v in items.items()]).select(F.inline(F.array(*items)))
    inside = lambda df: df.join(ids, "import_batch_id", "left_semi")
    yes = F.count_if
    return (
        count(inside(rows), raw_rows=F.count("*"))
        .unionByName(count(inside(contributions), contributions=F.count("*")))
        .unionByName(
            count(
                touched, orphaned_clusters=yes(F.col("orphaned")), preserved_clusters=yes(~F.col("orphaned")), clusters_with_surviving_contributions=yes(F.col("surviving") > 0),
                clusters_with_merges=yes(F.col("merged")), clusters_with_matches=yes(F.col("matched")),
            )
        )
        .unionByName(count(owners, orphaned_entities=yes(F.col("orphaned")), preserved_entities=yes(~F.col("orphaned"))))
    )


def purge(tables: dict[str, DataFrame], batch_ids: DataFrame, touched: DataFrame, owners: DataFrame) -> dict[str, DataFrame]:
    """Tables without what goes: rows by import_batch_id, else by cluster_id, else by entity_id, as each has them."""
    ids = batch_ids.select("import_batch_id").distinct()
    gone = {"cluster_id": touched.where("orphaned").select("cluster_id"), "entity_id": owners.where("orphaned").select("entity_id")}
    out = {}
    for name, df in tables.items():
        left = df.join(ids, "import_batch_id", "left_anti") if "import_batch_id" in df.columns else df
        for key, keys in gone.items():
            left = left.join(keys, key, "left_anti") if key in df.columns else left
        out[name] = left
    return out
