"""Roster operators on small invented tables."""

from __future__ import annotations

import hashlib
import os
import random
import time
from collections import defaultdict
from datetime import date, timedelta
from decimal import Decimal
from glob import glob

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import names, parsing
from tallyforge.operators import chapters, geography, identity, ingest, membership, quality, reevaluation, reports
from tallyforge.sources.contributions import file_fingerprints, read_contribution_csv, write_tables
from tallyforge.sources.versions import Versioned


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("name", "kind", "parts"),
    [
        ("DOE, JANE A.", "INDIVIDUAL", ("JANE A DOE", "JANE", "A", "DOE", "")),
        ("Dr. Sam  Poe Jr.", "INDIVIDUAL", ("SAM POE", "SAM", "", "POE", "JR")),
        ("Roe III, Mr. Kim", "INDIVIDUAL", ("KIM ROE", "KIM", "", "ROE", "III")),
        ("Cher", "INDIVIDUAL", ("CHER", "", "", "CHER", "")),
        ("Mr-X Lee", "INDIVIDUAL", ("LEE", "", "", "LEE", "")),
        ("Ann Bo Cy Dee", "INDIVIDUAL", ("ANN BO CY DEE", "ANN", "BO CY", "DEE", "")),
        ("Pat &  Sam Poe", "JOINT", ("PAT & SAM POE", "", "", "", "")),
        ("Friends of  Poe", "ORGANIZATION", ("FRIENDS OF POE", "", "", "", "")),
        ("Mary Union", "ORGANIZATION", ("MARY UNION", "", "", "", "")),
        ("", "UNKNOWN", ("", "", "", "", "")),
        (None, "UNKNOWN", ("", "", "", "", "")),
    ],
)
def test_names(spark, name, kind, parts):
    assert one(spark, name, names.entity_type) == kind
    assert tuple(one(spark, name, names.normalize_name)) == parts


@pytest.mark.parametrize(("text", "amount"), [("$1,234.50", "1234.50"), ("-5", "-5.00"), ("1e3", "1000.00"), (" 7 ", "7.00"), ("abc", None), ("NaN", None), ("Infinity", None), ("", None), (None, None)])
def test_amounts(spark, text, amount):
    assert one(spark, text, parsing.parse_amount) == (Decimal(amount) if amount else None)


@pytest.mark.parametrize(
    ("text", "day"),
    [("2024-1-5", date(2024, 1, 5)), ("1/5/2024", date(2024, 1, 5)), ("1/5/70", date(1970, 1, 5)), ("1/5/68", date(2068, 1, 5)), ("25/12/2020", date(2020, 12, 25)), ("2020/3/4", date(2020, 3, 4)), ("02/31/2020", None), ("x", None), (None, None)],
)
def test_dates(spark, text, day):
    assert one(spark, text, parsing.parse_date) == day


@pytest.mark.parametrize(
    ("text", "zip5", "zip4", "warned"),
    [("95401", "95401", None, False), ("95401-1234", "95401", "1234", False), ("213-1", "00213", "1", False), ("02138", "02138", None, False), ("2138", None, None, True), ("12", None, None, True), ("954011234", "95401", "1234", False), ("K1A", "K1A", None, True), ("", None, None, True), (None, None, None, True)],
)
def test_zip(spark, text, zip5, zip4, warned):
    got = one(spark, text, parsing.normalize_zip)
    assert (got["zip5"], got["zip4"], got["warning"] is not None) == (zip5, zip4, warned)


def test_weights_and_cells(spark):
    rows = [("50%", None), ("0.5", "fraction"), ("7", "COUNT"), ("40", None), ("0.4", None), ("400", None), ("x", None), (None, None)]
    got = [tuple(r["w"]) for r in spark.createDataFrame(rows, "v string, u string").select(parsing.normalize_weight(F.col("v"), F.col("u")).alias("w")).collect()]
    assert [g[0] for g in got] == [0.5, 0.5, None, 0.4, 0.4, None, None, None] and got[6][2]
    assert [one(spark, x, parsing.safe_cell) for x in ("=1", "+1", "a", "@b", "-c")] == ["'=1", "'+1", "a", "'@b", "'-c"]


def test_csv_rows_are_numbered_and_blank_cells_kept(spark, tmp_path):
    file = tmp_path / "in.csv"
    file.write_bytes('﻿NAME,AMOUNT,ZIP\n"Doe, Jane",5,02138\nA,,\nB,7\n'.encode())
    rows = sorted(read_contribution_csv(spark, str(file), ["NAME", "AMOUNT", "ZIP"]).select("row_number", "NAME", "AMOUNT", "ZIP").collect())
    assert [tuple(r) for r in rows] == [(1, "Doe, Jane", "5", "02138"), (2, "A", "", ""), (3, "B", "7", None)]
    assert file_fingerprints(spark, str(file)).first()["file_hash"] == hashlib.sha256(file.read_bytes()).hexdigest()


def raw(spark, rows):
    cells = "import_batch_id long, row_number long, name string, amount_text string, date_text string, txn string, zip string, employer string"
    df = spark.createDataFrame(rows, cells)
    return ingest.flag_exact_duplicates(ingest.validate_rows(ingest.with_row_hash(ingest.parse_rows(df), ["name", "amount_text", "date_text", "txn", "zip"])))


def test_import_statuses(spark):
    rows = [
        (1, 1, "Ann Poe", "5", "2024-01-01", "T1", "90001", "X"),
        (1, 2, "Ann Poe", "5", "2024-01-01", "T1", "90001", "X"),  # same cells
        (1, 3, "Ann Poe", "5", "1/1/2024", "T1", "90001", "X"),  # same number, amount and day
        (1, 4, "Ann Poe", "6", "2024-01-01", "T1", "90001", "X"),
        (1, 5, "", "x", "", "", "", ""),
        (1, 6, "", "x", "", "", "", ""),  # a bad row twice
        (1, 7, "Ann Poe", "6", "2024-01-01", "", "90001", "X"),  # like row 4, without number
        (1, 8, "Bo Lee", "-3", "2024-01-01", "REV9", "90001", "X"),
        (1, 9, "Bo Lee", "-3", "2024-01-02", "H1", "90001", "X"),
    ]
    history = spark.createDataFrame([("H1", Decimal("9.00"), date(2023, 1, 1), "OLD", "1")], "txn string, amount decimal(12,2), transaction_date date, normalized_name string, zip string")
    out = ingest.flag_duplicates(raw(spark, rows), history)
    want = ["ACCEPTED", "EXACT_DUPLICATE", "POSSIBLE_DUPLICATE", "POSSIBLE_AMENDMENT", "VALIDATION_FAILURE", "EXACT_DUPLICATE", "POSSIBLE_DUPLICATE", "ACCEPTED", "POSSIBLE_AMENDMENT"]
    assert [r["validation_status"] for r in out.orderBy("row_number").collect()] == want
    types = {r["row_number"]: r["transaction_type"] for r in ingest.classify_transaction_type(out).collect()}
    assert types[8] == "REVERSAL" and types[9] == "REFUND" and types[1] == "CONTRIBUTION"
    summary = ingest.batch_summary(out).first()
    assert (summary["n_rows"], summary["successful"], summary["failed"], summary["duplicates"]) == (9, 6, 1, 2)
    assert ingest.reconcile_batch(out).first()["difference"] == 0
    many = raw(spark, rows).repartition(7)
    assert sorted(r["validation_status"] for r in ingest.flag_duplicates(many, history).collect()) == sorted(want)


def clustered(spark, rows, members=None):
    cells = "contribution_id string, row_order long, entity_type string, normalized_name string, zip5 string, suffix string, middle string, employer string, occupation string"
    df = spark.createDataFrame(rows, cells)
    known = spark.createDataFrame(members, f"cluster_id string, {cells}") if members else None
    return {r["contribution_id"]: r["cluster_id"] for r in identity.cluster_contributions(df, known).collect()}


def test_cluster_fold(spark):
    person = lambda i, emp, occ="", suffix="": (i, int(i[1:]), "INDIVIDUAL", "ANN POE", "90001", suffix, "", emp, occ)
    rows = [person("r1", "ACME"), person("r2", "acme "), person("r3", "OTHER"), person("r4", ""), person("r5", "ACME", "x"), person("r6", "ACME", "y"), ("r7", 7, "JOINT", "ANN POE", "90001", "", "", "ACME", "")]
    got = clustered(spark, rows)
    assert got == {"r1": "r1", "r2": "r1", "r3": "r3", "r4": "r4", "r5": "r1", "r6": "r6", "r7": "r7"}
    got = clustered(spark, rows[:1], [("old", *person("m0", "ACME"))])
    assert got == {"r1": "old"}


def brute_fold(rows):
    """Each row walks all clusters of its block in order of their making."""
    blocks, out = defaultdict(list), {}
    for cid, _, kind, name, zip5, *evidence in sorted(rows, key=lambda r: r[1]):
        suffix, middle, employer, occupation = (x.strip().upper() for x in evidence)
        if kind != "INDIVIDUAL" or not (suffix or middle or employer or occupation):
            out[cid] = cid
            continue
        for c in blocks[name, zip5]:
            plain = [(suffix, c["suffix"]), (employer, c["employer"]), (occupation, c["occupation"])]
            clash = any(x and any(v != x for v in have) for x, have in plain) or (middle and any(v[0] != middle[0] for v in c["middle"]))
            agree = any(x and x in have for x, have in plain) or (middle and any(v == middle or (v[0] == middle[0] and 1 in (len(v), len(middle))) for v in c["middle"]))
            if not clash and agree:
                break
        else:
            c = {"id": cid, "suffix": set(), "middle": set(), "employer": set(), "occupation": set()}
            blocks[name, zip5].append(c)
        for k, x in (("suffix", suffix), ("middle", middle), ("employer", employer), ("occupation", occupation)):
            c[k] |= {x} - {""}
        out[cid] = c["id"]
    return out


@pytest.mark.parametrize("seed", range(3))
def test_cluster_fold_is_that_of_brute_force(spark, seed):
    rng = random.Random(seed)
    pick = lambda *xs: rng.choice(xs) if rng.random() < 0.6 else ""
    rows = [
        (f"r{i}", i, rng.choice(["INDIVIDUAL"] * 9 + ["JOINT"]), rng.choice(["A B", "C D"]), rng.choice(["1", "2"]), pick("JR", "SR"), pick("Q", "QUINN", "QUEEN", "R", "ROSE"), pick("acme", "ACME ", "bolt", "cog"), pick("x", "y", "z", "w", "v"))
        for i in range(600)
    ]
    assert clustered(spark, rows) == brute_fold(rows)


def test_a_large_block_is_folded_in_linear_time(spark):
    rows = [(f"r{i}", i, "INDIVIDUAL", "A B", "1", "", "", f"emp{i // 2}", "clerk" if i % 2 else "") for i in range(50_000)]
    began = time.monotonic()
    got = clustered(spark, rows)
    assert time.monotonic() - began < 60 and len(got) == 50_000
    assert got["r1"] == "r0" and got["r3"] == "r2"


def test_chains_are_no_cycles(spark):
    edges = [(i, i + 1) for i in range(12)] + [(100, 101), (101, 100), (101, 150), (150, 200), (200, 201), (201, 202), (202, 200), (202, 300)]
    found = identity.cycle_nodes(spark.createDataFrame(edges, "u long, v long"))
    assert {r["node"] for r in found.collect()} == {100, 101, 200, 201, 202}
    assert identity.cycle_nodes(spark.createDataFrame(edges[:12], "u long, v long")).count() == 0


def test_verifications(spark):
    rows = [
        (1, "ADMIN_REVIEW", "seen", {}, "a", 1), (2, "ADMIN_REVIEW", " ", {}, "a", 1), (3, "EXTERNAL_IDENTITY_MATCH", "m", {"source_type": "s", "source_version": "1"}, "a", 1),
        (4, "EXTERNAL_IDENTITY_MATCH", "m", {"source_type": "s"}, "a", 1), (5, "EXTERNAL_IDENTITY_MATCH", "m", {"source_type": "s", "source_version": "1", "First_Name": "x"}, "a", 1),
        (6, "MANUAL_REVIEW", "m", {}, "a", 1), (7, "LEGACY_REVIEWED", "m", None, "a", 1), (1, "LEGACY_REVIEWED", "later", {}, "b", 2),
    ]
    d = spark.createDataFrame(rows, "entity_id long, method string, explanation string, evidence map<string,string>, verified_by string, verified_at long")
    good, bad = identity.check_verifications(d)
    assert sorted(r["entity_id"] for r in good.collect()) == [1, 1, 3, 7]
    assert {r["entity_id"]: r["reason"] for r in bad.collect()} == {2: "explanation", 4: "source", 5: "personal evidence", 6: "method"}
    e = spark.createDataFrame([(k, "UNVERIFIED", None) for k in range(1, 8)], "entity_id long, verification_status string, verification_method string")
    got = {r["entity_id"]: (r["verification_status"], r["verification_method"]) for r in identity.apply_verifications(e, d).collect()}
    assert got[1] == ("VERIFIED", "LEGACY_REVIEWED") and got[2] == ("UNVERIFIED", None) and got[3] == ("VERIFIED", "EXTERNAL_IDENTITY_MATCH")


def test_merge_and_split_return_to_the_start(spark):
    rows = [(i, f"c{i % 2}", True, i, i, None) for i in range(6)]
    a = spark.createDataFrame(rows, "contribution_id long, cluster_id string, is_active boolean, assignment_id long, assigned_at long, merge_decision_id long")
    d = spark.createDataFrame([(1, "c0", "c1")], "decision_id long, source_cluster_id string, target_cluster_id string")
    merged = identity.merge_clusters(a, d)
    assert {r["cluster_id"] for r in merged.where("is_active").collect()} == {"c1"} and merged.where("is_active").count() == 6
    back = identity.split_clusters(merged, d.select("decision_id"))
    assert sorted((r["contribution_id"], r["cluster_id"]) for r in back.where("is_active").collect()) == [(i, f"c{i % 2}") for i in range(6)]


def test_amendments(spark):
    rows = [(1, 10, 11, "ACCEPTED"), (2, 10, 12, "ACCEPTED"), (3, 5, 5, "PENDING"), (4, 20, 21, "PENDING"), (5, 21, 22, "PENDING"), (6, 22, 20, "PENDING"), (7, 22, 30, "REJECTED")]
    am = spark.createDataFrame(rows, "amendment_id long, original_contribution_id long, replacement_contribution_id long, review_status string")
    got = {(r["issue"], r["contribution_id"]) for r in identity.validate_amendments(am).collect()}
    assert got == {("SELF_REFERENCE", 5), ("MULTIPLE_ACCEPTED", 10), ("CYCLE", 20), ("CYCLE", 21), ("CYCLE", 22)}
    c = spark.range(40).withColumnRenamed("id", "contribution_id")
    assert {10, 5, 20, 21, 22, 30} & {r[0] for r in identity.effective_contributions(c, am).collect()} == set()


DAY = date(2024, 6, 15)


def state(spark, days, kind="INDIVIDUAL", verified="VERIFIED", through=date(2024, 6, 1), signs=None):
    e = spark.createDataFrame([(1, kind, verified)], "entity_id long, entity_type string, verification_status string")
    rows = [(1, DAY - timedelta(d), Decimal("10.00"), s) for d, s in zip(days, signs or ["CONTRIBUTION"] * len(days), strict=True)]
    p = spark.createDataFrame(rows, "entity_id long, transaction_date date, amount decimal(12,2), transaction_type string")
    return membership.membership_state(e, p, membership.Rule(), membership.Coverage(through), DAY)


@pytest.mark.parametrize(
    ("want", "days", "kwargs"),
    [
        ("S01", [10, 40, 70], {}), ("S01", [10, 71], {}), ("S02", [100, 130], {"through": date(2024, 3, 1)}), ("S03", [100, 130], {}), ("S04", [10], {}),
        ("S05", [10], {"through": date(2024, 3, 1)}), ("S06", [10, 20], {}), ("S07", [10, 40], {"verified": "UNVERIFIED"}), ("S08", [10, 20], {"verified": "UNVERIFIED"}),
        ("S09", [10], {"verified": "UNVERIFIED"}), ("S10", [], {}), ("S11", [10, 40], {"kind": "JOINT"}), ("S11", [], {"kind": "UNKNOWN"}),
        ("S10", [10, 10], {"signs": ["CONTRIBUTION", "REFUND"]}),
    ],
)
def test_membership_states(spark, want, days, kwargs):
    got = state(spark, days, **kwargs)
    row = got.first()
    assert row["state_id"] == want
    assert (row["calculated_status"], row["recurrence_pattern_status"], row["membership_authority"]) == membership.STATES[want]
    assert membership.audit_matrix(got).first()["matrix_id"] == want
    assert membership.membership_predicates(got).first()["is_current_member"] == (want == "S01")


def test_assessments(spark):
    new = state(spark, [10, 40])
    old = spark.createDataFrame([(1, "LAPSED", date(2024, 1, 1), True), (2, "ACTIVE", date(2024, 1, 1), True)], "entity_id long, calculated_status string, calculation_date date, is_current boolean")
    out = membership.assess_entities(old, new, DAY)
    odd = membership.assess_entities(old, new, DAY, spark.createDataFrame([(1,)], "entity_id long"))
    row = odd.where("entity_id = 1 and is_current").first()
    assert (row["calculated_status"], row["membership_authority"], row["explanation"]) == ("UNKNOWN", "PROVISIONAL", "Verification field inconsistency detected.")
    assert sorted((r["entity_id"], r["calculated_status"]) for r in out.where("is_current").collect()) == [(1, "ACTIVE"), (2, "ACTIVE")]
    assert quality.check_invariants({"assessments": out}).count() == 0
    new = new.withColumn("rule_version_id", F.lit(1))
    diff = membership.audit_recompute(new, new.withColumn("calculated_status", F.lit("LAPSED")))
    assert membership.repair_manifest(diff).first()["transition"] == "ACTIVE->LAPSED"
    assert membership.audit_repair_parity(diff, diff).count() == 0


def reference(spark):
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    return {
        "place": make([(1, "ALPHA", "CA"), (2, "BETA", "CA"), (3, "GAMMA", "CA")], "place_id long, name string, state_code string"),
        "alias": make([("OLD BETA", 2)], "alias string, place_id long"),
        "postal": make([(1, "90001"), (2, "90002"), (3, "90003"), (4, "90004")], "postal_id long, postal_code string"),
        "postal_place": make([(1, 1), (2, 2), (3, 3)], "postal_id long, place_id long"),
        "place_county": make([(1, 10), (2, 20), (2, 21)], "place_id long, county_id long"),
        "postal_county": make([(1, 10), (4, 40), (2, 20), (2, 21)], "postal_id long, county_id long"),
    }


def test_resolution(spark):
    cases = [
        ("Alpha", "90001", "EXACT_PLACE_ZIP_MATCH", 10), ("beta", "90002", "AMBIGUOUS_ZIP", None), ("old beta", "90002-1", "AMBIGUOUS_ZIP", None), ("GAMMA", "90003", "EXACT_PLACE_ZIP_MATCH", None),
        ("nowhere", "90004", "UNIQUE_ZIP_INFERENCE", 40), ("alpha", "90004", "CONFLICTING_SOURCE_VALUES", None), ("nowhere", "90002", "AMBIGUOUS_ZIP", None), ("alpha", "99999", "AMBIGUOUS_PLACE", None),
        ("old beta", "", "AMBIGUOUS_ALIAS", None), (None, None, "NO_REFERENCE_MATCH", None),
    ]
    rows = [(i, c, "ca", z) for i, (c, z, _, _) in enumerate(cases)]
    ref = reference(spark)
    out = geography.resolve_locations(spark.createDataFrame(rows, "location_id long, city string, state string, zip string"), ref)
    got = {r["location_id"]: (r["match_method"], r["county_id"]) for r in out.collect()}
    assert got == {i: (m, c) for i, (_, _, m, c) in enumerate(cases)}
    assert geography.resolution_candidates(out, ref).count() == 6
    counts = geography.resolution_counts(out).first()
    assert (counts["resolved"], counts["conflicts"], counts["unmatched"]) == (3, 1, 1)


def test_reference_files(spark):
    rows = [(1, "a", "90001", "X County", "", "50%", ""), (2, "a", "90001", "X County", "", "50%", ""), (3, "b", "2138", "X", "", "", ""), (4, "c", "90002", "", "", "", ""), (5, "d", "90003", "Y", "", "bad", "")]
    df = spark.createDataFrame(rows, "row_number long, row_hash string, zip string, county string, place string, weight string, unit string")
    got = [r["row_status"] for r in geography.import_reference(df, "ZIP_COUNTY_CROSSWALK").orderBy("row_number").collect()]
    assert got == ["ACCEPTED", "EXACT_DUPLICATE", "POSSIBLE_TRUNCATED_LEADING_ZERO", "VALIDATION_FAILURE", "VALIDATION_WARNING"]
    none = spark.createDataFrame([], "id long, state_code string, name string")
    named = df.select(F.lit(None).cast("string").alias("state_code"), F.col("county").alias("name"))
    assert {r["name"] for r in geography.canonicalise(none, named, "county").collect()} == {"X", "Y"}


def test_chapter_precedence(spark):
    entities = [(i, "INDIVIDUAL", "VERIFIED") for i in range(1, 8)] + [(8, "JOINT", "VERIFIED"), (9, "INDIVIDUAL", "UNVERIFIED"), (12, "INDIVIDUAL", "VERIFIED")]
    res = [
        (1, 1, 10, None, None, "EXACT_PLACE_ZIP_MATCH"), (2, 2, 20, None, None, "EXACT_PLACE_ZIP_MATCH"), (3, 3, None, None, None, "AMBIGUOUS_ZIP"), (4, 4, 10, None, None, "EXACT_PLACE_ZIP_MATCH"),
        (5, 4, 20, None, None, "EXACT_PLACE_ZIP_MATCH"), (6, 5, 10, None, None, "EXACT_PLACE_ZIP_MATCH"), (7, 5, 10, None, None, "UNIQUE_ZIP_INFERENCE"), (8, 7, 99, None, None, "UNIQUE_ZIP_INFERENCE"),
        (9, 8, 10, None, None, "EXACT_PLACE_ZIP_MATCH"), (10, 9, 10, None, None, "EXACT_PLACE_ZIP_MATCH"),
    ]
    r = spark.createDataFrame([(*x, "USPS_ZIP5") for x in res], "location_id long, entity_id long, county_id long, place_id long, postal_id long, match_method string, postal_type string")
    rules = spark.createDataFrame([(1, 100, "INCLUDE", "COUNTY", 10, ""), (1, 101, "EXCLUDE", "COUNTY", 20, "")], "chapter_id long, rule_id long, effect string, target_type string, target_id long, postal_type string")
    over = spark.createDataFrame([(1, 2, "INCLUDE", "ACTIVE", date(2030, 1, 1)), (1, 1, "EXCLUDE", "ACTIVE", date(2020, 1, 1))], "chapter_id long, entity_id long, override_type string, status string, expiration_date date")
    e = spark.createDataFrame(entities, "entity_id long, entity_type string, verification_status string")
    placed = r.select("entity_id").union(spark.createDataFrame([(12,)], "entity_id long"))  # 12 has a location without a resolution
    out = chapters.evaluate_chapters(e, chapters.match_rules(r, rules), chapters.active_overrides(over, DAY), placed, rules)
    got = {x["entity_id"]: x["result_status"] for x in out.collect()}
    assert got == {
        1: "INCLUDED_BY_RULE", 2: "MANUALLY_INCLUDED", 3: "AMBIGUOUS_GEOGRAPHY", 4: "AMBIGUOUS_LOCATION", 5: "INCLUDED_BY_RULE", 6: "NO_CURRENT_LOCATION", 7: "NO_RULE_MATCH",
        8: "INELIGIBLE_ENTITY_TYPE", 9: "PROVISIONAL_GEOGRAPHIC_MATCH", 12: "NO_CURRENT_RESOLVED_LOCATION",
    }
    assert chapters.run_counts(out).first()["considered"] == len(entities)
    assert chapters.rebuild_assignments(out, out.select("chapter_id", "entity_id", "assignment_status")).where("change <> 'IDENTICAL'").count() == 0
    flags = chapters.preview_diff(out, out.where("entity_id <> 1"))
    assert [x["entity_id"] for x in flags.where("new_included").collect()] == [1]
    assert flags.where("rule_changed").count() == 0  # an absent side has no rule to compare
    gone = chapters.preview_diff(out.where("entity_id not in (7, 12)"), out)
    assert sorted(x["entity_id"] for x in gone.where("removed_unresolved").collect()) == [7, 12]
    said = {x["entity_id"]: (x["selection_explanation"], x["explanation"]) for x in chapters.explain_results(out).collect()}
    assert said[4] == ("Conflicting location outcomes detected: [('EXCLUDED_BY_RULE', 101), ('INCLUDED_BY_RULE', 100)]", "Geographic evaluation is ambiguous due to conflicting current locations.")
    assert said[1] == ("Selected location 1 yielding outcome INCLUDED_BY_RULE.", "Included by rule 100.")
    assert said[8] == ("Entity type 'JOINT' is ineligible for chapter membership.", "Ineligible entity type.")


def test_overlaps_and_overrides(spark):
    rows = [(c, e, "INCLUDED" if (c + e) % 2 else "EXCLUDED") for c in range(1, 5) for e in range(6)]
    a = spark.createDataFrame(rows, "chapter_id long, entity_id long, assignment_status string")
    pairs = {(r["chapter_a"], r["chapter_b"]): r["shared"] for r in chapters.overlap_pairs(a).collect()}
    own = defaultdict(set)
    for c, e, s in rows:
        if s == "INCLUDED":
            own[c].add(e)
    assert pairs == {(a, b): len(own[a] & own[b]) for a in own for b in own if a < b and own[a] & own[b]}
    schema = "chapter_id long, entity_id long, override_type string, reason string, effective_date date, expiration_date date, decided_at long, override_id long"
    old = spark.createDataFrame([(1, 1, "INCLUDE", "r", date(2024, 1, 1), None, 1, 1, "ACTIVE")], schema + ", status string")
    # of two decisions at one time that with the larger id counts
    new = spark.createDataFrame([(1, 1, "EXCLUDE", "r", date(2024, 2, 1), None, 2, 3), (1, 1, "INCLUDE", "r", date(2024, 2, 1), None, 2, 2), (1, 2, "EXCLUDE", " ", date(2024, 2, 1), None, 2, 4)], schema)
    both, bad = chapters.apply_overrides(old, new)
    assert [(r["override_id"], r["status"]) for r in both.orderBy("override_id").collect()] == [(1, "SUPERSEDED"), (2, "SUPERSEDED"), (3, "ACTIVE")] and bad.count() == 1
    listed = spark.createDataFrame([(1, "One", "ACTIVE"), (2, "Two", "ACTIVE"), (3, "Three", "CLOSED"), (4, "Four", "ACTIVE")], "chapter_id long, chapter_name string, status string")
    named = {(r["chapter_1"], r["chapter_2"]): r["shared"] for r in chapters.overlap_pairs(a, listed).collect()}
    assert named == {("Two", "Four"): len(own[2] & own[4])}


def test_reports_and_writes(spark, tmp_path):
    e = spark.createDataFrame([(1, "INDIVIDUAL", "=Ann"), (2, "INDIVIDUAL", "Bo"), (3, "JOINT", "Cy & Di")], "entity_id long, entity_type string, display_name string")
    latest = spark.createDataFrame([(1, "ACTIVE")], "entity_id long, calculated_status string")
    counts = {r["status"]: r["n"] for r in reports.status_breakdown(e, latest).collect()}
    assert counts["ACTIVE"] == 1 and sum(counts.values()) == 1 and len(counts) == 9
    assert [r["display_name"] for r in reports.export_roster(e, latest).collect()] == ["'=Ann", "Bo"]
    assert {r["display_name"] for r in reports.redact(e).collect()} == {"[redacted]"}
    rows = spark.createDataFrame([(1, 1, "UNKNOWN"), (2, 1, "ACTIVE"), (3, 3, "UNKNOWN")], "assessment_id long, entity_id long, calculated_status string")
    assert [r["entity_id"] for r in reports.filter_by_status(e, rows, "UNKNOWN").collect()] == [2]
    assert [r["entity_id"] for r in reports.filter_by_status(e, rows, "ACTIVE").collect()] == [1]
    a = spark.createDataFrame([(1, "x"), (2, "y")], "import_batch_id long, v string")
    write_tables({"t": a}, str(tmp_path))
    write_tables({"t": a.where("import_batch_id = 2").withColumn("v", F.lit("z"))}, str(tmp_path))
    assert sorted((r["import_batch_id"], r["v"]) for r in spark.read.parquet(f"{tmp_path}/t").collect()) == [(1, "x"), (2, "z")]


def test_entry_has_a_query_for_each_oracle():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_purge_takes_entities_without_other_ties(spark):
    make = spark.createDataFrame
    assignments = make([(1, "a", 7), (2, "b", 7), (3, "c", 7), (4, "d", 7), (5, "e", 7), (6, "f", 8)], "contribution_id int, cluster_id string, import_batch_id int")
    batch, merges, matches = make([(7,)], "import_batch_id int"), make([], "source_cluster_id string, target_cluster_id string"), make([("e",)], "cluster_id string")
    gone = ingest.purge_plan(assignments, merges, batch, matches)
    assert {r[0] for r in gone.collect()} == {"a", "b", "c", "d"}
    clusters = make([("a", 1), ("b", 2), ("c", 3), ("d", 4), ("f", 4), ("e", 5)], "cluster_id string, entity_id int")
    entities = make([(1, "UNVERIFIED"), (2, "VERIFIED"), (3, "UNVERIFIED"), (4, None), (5, None), (6, None)], "entity_id int, verification_status string")
    manual = make([(3, True), (1, False)], "entity_id int, manual_override boolean")
    assert [r[0] for r in ingest.purge_entities(assignments, batch, clusters, gone, entities, manual).collect()] == [1]


def test_matrix_bounds_on_positive_counts(spark):
    matched = spark.createDataFrame([(1, "S01"), (2, "S01"), (3, "S04"), (4, "S10"), (5, "S10"), (6, "S11"), (7, "UNMATCHED")], "entity_id int, matrix_id string")
    positives = spark.createDataFrame([(1, 2), (2, 1), (3, 2), (4, 1), (6, 9)], "entity_id int, positive_count int")
    assert {tuple(r) for r in membership.evidence_violations(matched, positives).collect()} == {(2, "S01", 1), (3, "S04", 2), (4, "S10", 1)}


def test_verification_rollback(spark):
    entities = spark.createDataFrame([(k, "UNVERIFIED", None, None) for k in (1, 2, 3)], "entity_id int, verification_status string, verification_method string, verified_by string")
    manifest = spark.createDataFrame([(1, "VERIFIED", "NONE", "x", None), (2, "VERIFIED", "ADMIN_REVIEW", None, "2025-01-01"), (9, "VERIFIED", None, None, None)], "entity_id int, verification_status string, verification_method string, verified_by string, verified_at string")
    got = {tuple(r) for r in identity.apply_verification_rollback(entities, manifest).collect()}
    assert got == {(1, "VERIFIED", "LEGACY_REVIEWED", "x"), (2, "VERIFIED", "ADMIN_REVIEW", None), (3, "UNVERIFIED", None, None)}


def test_states_at_days_of_their_own(spark):
    """Every request against the state of the payments up to its day, under its own thresholds."""
    rng = random.Random(3)
    first = date(2023, 1, 1)
    pays = [(rng.randint(1, 12), first + timedelta(rng.randint(0, 500)), Decimal(rng.randint(1, 90)), rng.choice(["CONTRIBUTION"] * 5 + ["REFUND"])) for _ in range(160)]
    rules = [(1, 20, 40, 60, 2, True), (2, 10, 35, 90, 3, False), (3, 25, 60, 30, 4, True)]
    asks = [(i, rng.randint(1, 14), rng.choice(["INDIVIDUAL"] * 6 + ["JOINT"]), rng.choice(["VERIFIED", "UNVERIFIED"]), rng.randint(1, 3), first + timedelta(rng.randint(0, 600)), rng.random() < 0.5) for i in range(120)]
    payments = spark.createDataFrame(pays, "entity_id long, transaction_date date, amount decimal(12,2), transaction_type string")
    names = "rule_version_id long, monthly_interval_min int, monthly_interval_max int, active_grace_period int, min_recurring_payments int, skip_payment_allowed boolean"
    coverage = membership.Coverage(date(2024, 3, 1))
    requests = spark.createDataFrame([(*a[:6], a[5] if a[6] else None) for a in asks], "request_id long, entity_id long, entity_type string, verification_status string, rule_version_id long, evaluation_date date, upto date")
    got = {r["request_id"]: (r["state_id"], r["recurring_amount"], r["positive_count"]) for r in membership.states_at(requests, payments, spark.createDataFrame(rules, names), coverage).collect()}

    def state(ask):
        i, entity, kind, verified, version, day, bounded = ask
        _, lo, hi, grace, least, skip = rules[version - 1]
        net = defaultdict(Decimal)
        for e, d, amount, t in pays:
            if e == entity and (not bounded or d <= day):
                net[d] += amount if t == "CONTRIBUTION" else -amount
        line = sorted((d, n) for d, n in net.items() if n > 0)
        gaps = [(b[0] - a[0]).days for a, b in zip(line, line[1:], strict=False)]
        good = sum(lo <= g <= hi or (skip and 50 <= g <= 80) for g in gaps)
        ok, stale = verified == "VERIFIED", (day - coverage.through).days > 60
        if kind != "INDIVIDUAL":
            s = "S11"
        elif not line:
            s = "S10"
        elif len(line) == 1:
            s = ("S05" if stale else "S04") if ok else "S09"
        elif good >= least - 1:
            s = ("S01" if (day - line[-1][0]).days <= grace else "S02" if stale else "S03") if ok else "S07"
        else:
            s = "S06" if ok else "S08"
        last = [n for _, n in line[-3:]]
        mean = (sum(last) / len(last)).quantize(Decimal("0.01")) if s in ("S01", "S02", "S03", "S07") else Decimal("0.00")
        return s, mean, len(line)

    assert got == {a[0]: state(a) for a in asks}
    assert len({s for s, _, _ in got.values()}) >= 8


def test_long_chains_are_straightened_in_a_few_rounds(spark, monkeypatch):
    rounds = []
    inner = identity.keep
    monkeypatch.setattr(identity, "keep", lambda df, name: (rounds.append(name), inner(df, name))[1])
    n = 100_000
    chain = spark.range(n).selectExpr("id as u", "id + 1 as v")
    assert identity.cycle_nodes(chain).count() == 0 and rounds.count("pointers") < 25
    ring = chain.union(spark.createDataFrame([(n, 50_000), (7, 7), (200_000, 200_001), (200_001, 200_000)], "u long, v long"))
    groups = identity.cycle_groups(ring)
    assert groups.where(f"node between 50000 and {n}").agg(F.count("*").alias("a"), F.count_distinct("group").alias("b")).first() == (50_001, 1)
    assert sorted(r["node"] for r in groups.where(f"node < 50000 or node > {n}").collect()) == [7, 200_000, 200_001]


@pytest.mark.parametrize("seed", range(4))
def test_cycle_groups_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    edges = {(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(rng.choice([40, 60, 80]))}
    reach = {u: {u} for u in range(61)}
    out = defaultdict(set)
    for u, v in edges:
        out[u].add(v)
    for u in reach:
        todo = [u]
        while todo:
            for w in out[todo.pop()]:
                if w not in reach[u]:
                    reach[u].add(w)
                    todo.append(w)
    want = {u for u in reach if any(u in reach[v] for v in out[u])}
    got = {r["node"]: r["group"] for r in identity.cycle_groups(spark.createDataFrame(sorted(edges), "u long, v long")).collect()}
    assert set(got) == want
    assert all((got[a] == got[b]) == (b in reach[a] and a in reach[b]) for a in want for b in want)


def test_search_equals_a_scan(spark):
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abAB é1-") for _ in range(n))
    people = [(i, rng.choice(["INDIVIDUAL", "INDIVIDUAL", "JOINT"]), word(9), word(3), None if i % 5 == 0 else word(4)) for i in range(80)]
    gifts = [(rng.randint(0, 85), word(5), None if i % 7 == 0 else word(2), word(6)) for i in range(200)]
    places = [(rng.randint(0, 85), word(6), word(5)) for _ in range(90)]
    e = spark.createDataFrame(people, "entity_id long, entity_type string, display_name string, first_name string, last_name string")
    c = spark.createDataFrame(gifts, "entity_id long, employer string, occupation string, txn string")
    p = spark.createDataFrame(places, "entity_id long, city string, zip string")
    patterns = ["", "a", "É", "1", *[word(rng.randint(1, 5)) for _ in range(50)]]
    got = {tuple(r) for r in reports.people_search(reports.search_index(e, c, p), spark.createDataFrame([(x,) for x in patterns], "pattern string")).collect()}
    own = defaultdict(set)
    for i, kind, *names in people:
        if kind == "INDIVIDUAL":
            own[i] |= {n.lower() for n in names if n}
    for rows in (gifts, places):
        for i, *values in rows:
            if i in own:
                own[i] |= {v.lower() for v in values if v}
    assert got == {(x, i) for x in patterns if x for i, values in own.items() if any(x.lower() in v for v in values)}


def test_only_touched_parts_are_written_and_a_dead_run_counts_for_nothing(spark, tmp_path):
    rows = spark.range(200).selectExpr("id as k", "id * 2 as v")
    store = Versioned(spark, str(tmp_path / "t"), "k", 8)
    store.load(rows, 1)
    changed = spark.createDataFrame([(3,), (5,), (999,)], "k long")
    new = spark.createDataFrame([(3, -1), (999, -2)], "k long, v long")
    touched = store.merge(changed, new, 2)
    want = {(k, 2 * k) for k in range(200)} - {(3, 6), (5, 10)} | {(3, -1), (999, -2)}
    read = lambda: {tuple(r) for r in store.current(rows.schema).collect()}
    assert read() == want and 0 < len(touched) <= 3
    assert {p: r for p, r in store._pointers().items() if r == 2} == dict.fromkeys(touched, 2)
    assert sorted(os.path.basename(f) for f in glob(f"{tmp_path}/t/rows/run=2/*")) == sorted(f"part={p}" for p in touched)
    store.merge(changed, new, 2)  # repeated
    assert read() == want
    dealt = rows.withColumns({"part": store.part(), "run": F.lit(3)}).withColumn("v", F.lit(0).cast("long"))
    dealt.write.mode("append").partitionBy("run", "part").parquet(f"{tmp_path}/t/rows")  # a run that died before its pointer
    assert read() == want
    assert store.merge(changed.where("false"), new.where("false"), 4) == [] and read() == want


def test_reevaluation_equals_evaluation_of_everything(spark, tmp_path):
    rng = random.Random(8)
    pays = [(i, rng.randint(0, 40), date(2024, 1, 1) + timedelta(rng.randint(0, 150)), Decimal(5), "CONTRIBUTION", rng.randint(1, 4)) for i in range(300)]
    payments = spark.createDataFrame(pays, "contribution_id long, entity_id long, transaction_date date, amount decimal(12,2), transaction_type string, import_batch_id long").withColumn("cluster_id", F.col("entity_id"))
    entities = spark.createDataFrame([(i, "INDIVIDUAL", "VERIFIED" if i % 2 else "UNVERIFIED") for i in range(45)], "entity_id long, entity_type string, verification_status string")
    clusters = entities.select(F.col("entity_id").alias("cluster_id"), F.lit("LOW").alias("confidence_level"))
    rule, coverage = membership.Rule(), membership.Coverage(DAY)
    stores = {k: Versioned(spark, str(tmp_path / k), k, 8) for k in ("entity_id", "cluster_id")}
    stores["entity_id"].load(reevaluation.memberships(entities, payments, rule, coverage, DAY), 1)
    stores["cluster_id"].load(reevaluation.patterns(clusters, payments, rule), 1)
    ids = spark.createDataFrame([(2,)], "import_batch_id long")
    in_clusters, in_entities = reevaluation.touched_by_batches(payments, ids)
    left = payments.where("import_batch_id <> 2")
    reevaluation.refresh_memberships(stores["entity_id"], in_entities, entities, left, rule, coverage, DAY, 2)
    reevaluation.refresh_patterns(stores["cluster_id"], in_clusters, clusters, left, rule, 2)
    for key, want in (("entity_id", reevaluation.memberships(entities, left, rule, coverage, DAY)), ("cluster_id", reevaluation.patterns(clusters, left, rule))):
        assert sorted(map(str, stores[key].current(want.schema).collect())) == sorted(map(str, want.collect()))


def test_counts_are_observed_where_a_reference_file_is_written(spark, tmp_path):
    rows = [(i, f"h{i % 7}", ["90001", "2138", "abc-d", ""][i % 4], ["X County", ""][i % 5 == 0], "Y", ["50%", "bad"][i % 3 == 0], "", "A", "PLACE", "T") for i in range(60)]
    df = spark.createDataFrame(rows, "row_number long, row_hash string, zip string, county string, place string, weight string, unit string, alias string, target_type string, target string").withColumn("row_hash", F.col("row_number").cast("string"))
    for kind in geography.KINDS:
        checked = geography.import_reference(df, kind)
        counts = geography.write_reference(checked, str(tmp_path / kind))
        again = spark.read.parquet(str(tmp_path / kind)).agg(*geography.reference_counts(F.col("row_status"))).first().asDict()
        assert counts == again and counts["row_count"] == 60
