"""Operators 11 to 13 against brute force on small tables with nulls, empty, long, tied and repeated rows."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tallyforge.llm import collocations, fill_in_middle, inverted_multi_index
from tallyforge.llm.wavelet import WaveletMatrix

DOCS = "doc_id long, text string, lang string, n long, id long, output string"


def test_ranks_of_the_wavelet_matrix():
    rng = np.random.default_rng(3)
    for size in (0, 1, 63, 64, 65, 511, 512, 513, 5000):
        symbols = rng.integers(0, 5, size)
        matrix, at = WaveletMatrix(symbols, 3), np.arange(size + 1)
        for s in range(5):
            assert (matrix.rank(s, at) == np.concatenate([[0], np.cumsum(symbols == s)])).all()
            assert (matrix.rank_below(s, at) == np.concatenate([[0], np.cumsum(symbols < s)])).all()


def middle_moved(doc_id, text):
    """The contract, by regular expression and lists."""
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(units), "plain", None, None, text
    out = f"<S>{s}<P>{p}<M>{m}" if h4 % 100 < 20 else f"<P>{p}<S>{s}<M>{m}"
    return len(units), "spm" if h4 % 100 < 20 else "psm", len(p), len(m), out


def test_fill_in_middle(spark, monkeypatch):
    rng = random.Random(5)
    texts = ["".join(rng.choice(["ab", "Z", " ", "é", "漢", "😀", "\n", "1", "<", "S>", "\x00"]) for _ in range(rng.randint(0, 60))) for _ in range(200)]
    texts += [None, "", "a", "é", "<P>x", "x<M>", "ab<S", "<<S", "word " * 30000, "x" * 100000, "é" * 70000]
    rows = [(i, t, "en", 7, 8, "clash") for i, t in enumerate(texts)] + [(3, texts[3], None, None, None, None), (None, "no id here", None, None, None, None)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    made = fill_in_middle.fill_in_middle(docs)
    made = made.withColumn("restored", fill_in_middle.restore(made.output, made.form)).collect()
    assert len(made) == len(rows)
    want = Counter((r[0], *middle_moved(r[0], r[1])) for r in rows)
    assert Counter((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in made) == want
    text_of = {r[0]: r[1] or "" for r in rows}
    assert all(r["restored"] == text_of[r["doc_id"]] for r in made)
    assert {r["form"] for r in made} == {"plain", "psm", "spm"}
    assert fill_in_middle.fill_in_middle(docs.where("false")).count() == 0
    # matrices over one text and over many agree
    monkeypatch.setattr(fill_in_middle, "_TOGETHER", 1)
    one = fill_in_middle.Boundaries([b"ab c"])
    assert one.counts.tolist() == [3] and one.cut_after(np.array([2])).tolist() == [3]


def phrases(rows, minimum, best, share=100):
    """The contract of operator 13, by counting everything."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split("[.,;:!?\n-\r]", lower):
            w = tuple(x for x in re.split("[ \t]+", piece) if x)
            n[lang or "und"] += len(w)
            f.update((lang or "und", w[i : i + k]) for k in range(1, 6) for i in range(len(w) - k + 1))
    candidates = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= minimum}
    inside = set()
    for (lang, w), a in candidates.items():
        for k in range(2, len(w)):
            inside |= {(lang, w[i : i + k]) for i in range(len(w) - k + 1) if 100 * a >= share * f[lang, w[i : i + k]]}
    found = defaultdict(list)
    for (lang, w), a in candidates.items():
        if (lang, w) not in inside:
            cuts = [(1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            found[lang].append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return {(lang, i, p.decode(), -a, x, y, n[lang], -s) for lang, of in found.items() for i, (s, a, p, x, y) in enumerate(sorted(of)[:best], 1)}


@pytest.mark.parametrize(("shards", "slots"), [(1, 1 << 16), (3, 1 << 16), (4, 64), (2, 1)])
def test_collocations(spark, shards, slots):
    rng = random.Random(11)
    vocabulary = ["the", "of", "Ba", "ke", "é", "漢字", "x-y", "a"]
    frequent = ["the ke of é", "Ba ke the of a", "x-y x-y x-y"]
    rows = []
    for _ in range(400):
        parts = [rng.choice(frequent) if rng.random() < 0.3 else rng.choice(vocabulary) for _ in range(rng.randint(0, 40))]
        rows.append((rng.choice(["en", "de", None]), "".join(x + rng.choice([" ", " ", " ", "\t", ", ", ".\n", "\x0b"]) for x in parts)))
    rows += [("en", None), (None, ""), ("en", " \t"), ("fr", "only here"), ("en", "Ba ke " * 20000), ("en", rows[0][1]), ("en", rows[0][1]), ("late", "one two three four five six. " * 30)]
    docs = spark.createDataFrame([(i, t, lang, 7, 8, "clash") for i, (lang, t) in enumerate(rows)], DOCS).repartition(5)
    got = collocations.collocations(docs, minimum=25, best=20, shards=shards, slots=slots)
    assert {tuple(r) for r in got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()} == phrases(rows, 25, 20)


def test_collocations_of_nothing(spark):
    assert collocations.collocations(spark.createDataFrame([], DOCS)).count() == 0
    assert collocations.collocations(spark.createDataFrame([(1, None, None, 1, 1, "")], DOCS)).count() == 0


def test_pairs_of_centroids_come_in_order_and_once():
    rng = np.random.default_rng(2)
    first, second = rng.random(7), np.round(rng.random(9), 1)
    order = list(inverted_multi_index.cells_in_order(first, second))
    assert sorted(order) == list(range(63))
    sums = [first[c // 9] + second[c % 9] for c in order]
    assert sums == sorted(sums)


def neighbours(rows, k, every=100):
    """All distances, of one row for each id."""
    valid = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) and len(v) == 6:
            valid[i] = min(valid.get(i, v), v)
    ids = np.array(sorted(valid))
    x = np.array([valid[i] for i in ids.tolist()], dtype=np.float32).astype(np.float64)
    out = set()
    for i, q in zip(ids.tolist(), x, strict=True):
        if i % every == 0:
            d = np.sqrt(((x - q) ** 2).sum(axis=1))
            best = [j for j in np.lexsort((ids, d)) if ids[j] != i][:k]
            out |= {(i, r, int(ids[j]), round(float(d[j]), 9)) for r, j in enumerate(best, 1)}
    return out


def test_nearest(spark, monkeypatch):
    rng = np.random.default_rng(4)
    vectors = "vec_id long, embedding array<float>, label int, id long, vec string, q long"
    plain = rng.normal(size=(1500, 6)).astype(np.float32)
    plain[300:800] = plain[0]  # a third are copies
    plain[800:900] = plain[1] + np.float32(1e-4) * rng.normal(size=(100, 6)).astype(np.float32)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(plain)]
    bad = [(2000, None), (2100, [0.0] * 6), (2200, [None] + [1.0] * 5), (2300, [float("nan")] + [1.0] * 5), (2400, [float("inf")] + [1.0] * 5), (2500, [1.0, 2.0]), (2600, []), (None, [1.0] * 6)]
    rows += [*bad, rows[100], (100, [50.0] * 6), (-100, [0.5] * 6), (3000, [-0.0, 0.0, 1.0, 0.0, 0.0, 0.0]), (3001, [0.0, 0.0, 1.0, 0.0, 0.0, -0.0])]
    table = spark.createDataFrame([(i, v, 1, 9, "clash", 3) for i, v in rows], vectors).repartition(4)

    def found(df, **more):
        return {(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in inverted_multi_index.nearest(df, **more).collect()}

    want = neighbours(rows, 10)
    # with all candidates looked at the result is exact, whatever the sizes of tiles and blocks
    assert found(table, words=4, recall=1.0, probes=1000) == want
    monkeypatch.setattr(inverted_multi_index, "_LEAST", 1)
    monkeypatch.setattr(inverted_multi_index, "_TILE", 20)
    monkeypatch.setattr(inverted_multi_index, "_BLOCK", 5)
    monkeypatch.setattr(inverted_multi_index, "_HELD", 50)
    assert found(table, words=4, recall=1.0, probes=1000) == want
    few = table.where("vec_id in (0, 5, 100, 7)")
    assert found(few) == neighbours([r for r in rows if r[0] in (0, 5, 100, 7)], 10)
    assert found(table.where("vec_id = 0")) == set()
    assert inverted_multi_index.nearest(table.where("false")).columns == ["query_id", "rank", "vec_id", "score"]
    assert found(table.where("vec_id >= 2000 and vec_id < 2500")) == set()


def test_recall_of_nearest(spark):
    """Of vectors without any groups, the hardest to search, at the default recall."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(6000, 32)).astype(np.float32)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    got = {(r["query_id"], r["vec_id"]) for r in inverted_multi_index.nearest(table, probes=20).collect()}
    q = np.arange(0, 6000, 100)
    d = ((x[q][:, None].astype(np.float64) - x[None]) ** 2).sum(axis=2)
    d[np.arange(60), q] = np.inf
    want = {(int(i), int(j)) for i, row in zip(q, np.argsort(d, axis=1)[:, :10], strict=True) for j in row}
    assert len(got) == 600 and len(got & want) >= 540


def test_packed_hashes_come_back():
    rng = np.random.default_rng(1)
    for n in (0, 1, 1000):
        h = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64, endpoint=False))
        assert (collocations._unpacked(collocations._packed(h)) == h).all()
        at = collocations._dealt(h, 7)
        assert at[0] == 0 and at[-1] == len(h) and (np.diff(at) >= 0).all()


def test_collocations_told_in_many_pieces(spark, monkeypatch):
    rows = [("en", f"one two three w{i % 7} one two" * (1 + i % 3)) for i in range(200)]
    docs = spark.createDataFrame([(i, t, lang, 7, 8, "clash") for i, (lang, t) in enumerate(rows)], DOCS).repartition(2)
    monkeypatch.setattr(collocations, "_FOUND", 8)
    monkeypatch.setattr(collocations, "_PART_WORDS", 100)
    got = {tuple(r) for r in collocations.collocations(docs, minimum=20, best=50).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()}
    assert got == phrases(rows, 20, 50)


def test_wide_regions_fall_into_voronoi_cells(spark, monkeypatch):
    """Texts of two words have 32 shingles, so that hundreds of texts, most of them unlinked, meet in one region."""
    from tallyforge.llm import jaccard_join

    rng = random.Random(12)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.choice([11, 12, 12, 13])))) for i in range(3500)]
    widths, cells = [], jaccard_join._cells

    def counted(rows, pivots, tested, radius, turn):
        sizes = rows.join(pivots.where("wide").select("region").distinct(), "region", "left_semi").groupBy("region").count()
        out = cells(rows, pivots, tested, radius, turn)
        widths.append((sizes.agg({"count": "max"}).first()[0], out.count()))
        return out

    monkeypatch.setattr(jaccard_join, "_cells", counted)
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    masks = np.zeros(len(rows), dtype=np.uint64)
    for i, t in rows:
        w = t.split()
        for k in range(len(w) - 4):
            masks[i] |= np.uint64(1) << np.uint64(int("".join(w[k : k + 5]).replace("a", "0").replace("b", "1"), 2))
    both = np.bitwise_count(masks[:, None] & masks[None]).astype(int)
    linked = 100 * both >= 75 * np.bitwise_count(masks[:, None] | masks[None]).astype(int)
    want = np.arange(len(rows))
    while (new := np.where(linked, want[None], len(rows)).min(axis=1)).tolist() != want.tolist():
        want = new
    assert got == {i: int(c) for i, c in enumerate(want)}
    print(widths)
    assert max(w for w, _ in widths if w) >= 500 and sum(n for _, n in widths) > 500
