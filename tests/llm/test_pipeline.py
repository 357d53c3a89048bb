"""The pipeline's stages as they are wired, on a small table with nulls, empty and repeated texts and other columns."""

from __future__ import annotations

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SF = "/root/testdata/sf0.001"


def words(rng, n):
    return " ".join("".join(rng.choice(["ba", "ke", "lo", "mi"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables of their own: documents with one exact copy, one near copy, a long shared passage and a benchmark item."""
    rng = random.Random(9)
    path = tmp_path_factory.mktemp("tables")
    base, passage, item = [words(rng, 120) for _ in range(10)], words(rng, 80), "What is " + words(rng, 12) + "?\n" + words(rng, 6)
    near = base[1].split()
    near[60] = "changed"
    rows = [(i, t) for i, t in enumerate(base)] + [(20, base[0]), (21, " ".join(near)), (30, words(rng, 60) + " " + passage), (31, passage + " " + words(rng, 60))]
    rows += [(40, words(rng, 50) + " " + item + " " + words(rng, 50)), (50, None), (51, ""), (52, "one"), (52, "one")]
    docs = [(d, t, "en", "s", None if t is None else len(t), "kept?") for d, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, kept string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_each_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_duplicates", "repeated_strings", "decontamination", "packing"]
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    every = ids(docs)
    # without labels the score is 0.5 and nothing is rejected
    kept = stages["quality"](spark, docs, folder)
    assert kept.columns == docs.columns and ids(kept) == every
    one = stages["near_duplicates"](spark, docs, folder)
    assert one.columns == docs.columns and ids(one) == [d for d in every if d not in (20, 21)]
    cut = stages["repeated_strings"](spark, one, folder)
    text = {r["doc_id"]: r["text"] for r in cut.collect()}
    before = {r["doc_id"]: r["text"] or "" for r in one.collect()}
    assert cut.columns == docs.columns and ids(cut) == ids(one)
    assert all(len(text[d]) < len(before[d]) - 200 for d in (30, 31))
    assert all(text[d] == before[d] for d in before if d not in (30, 31))
    clean = stages["decontamination"](spark, cut, folder)
    assert clean.columns == docs.columns and ids(clean) == [d for d in ids(cut) if d != 40]
    packed = stages["packing"](spark, clean, folder)
    assert {r["doc_id"] for r in packed.collect()} == set(ids(clean))
    for stage in stages.values():
        assert stage(spark, docs.where("false"), folder).count() == 0


def test_run_is_its_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    key = lambda df: sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in df.collect())
    assert key(corpus_pipeline.run(spark, folder)) == key(docs)
