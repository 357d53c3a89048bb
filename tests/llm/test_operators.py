"""Each corpus operator against brute force on a small table with nulls, empty, long, tied and repeated rows."""

from __future__ import annotations

import hashlib
import itertools
import os
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tallyforge.llm import compact_windows, decontamination, html_text, jaccard_join, packing, quality_classifier, quality_rules, sharding, suffix_dedup, suffix_tree_lm

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, node long, shard string"


def words(rng, n):
    return [rng.choice(["the", "of", "and", "to"]) if rng.random() < 0.3 else "".join(rng.choice(["ba", "ke", "lo", "mi", "tu", "é"]) for _ in range(rng.randint(1, 4))) for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    out = [" ".join(words(rng, rng.randint(20, 300))) for _ in range(40)]
    passage = " ".join(words(rng, 80))
    for i in range(5):
        out.append(" ".join(words(rng, 60)) + " " + passage + "\n" + " ".join(words(rng, 60)))
    near = words(rng, 200)
    for i in range(8):
        own = list(near)
        own[10 * i] = "changed"
        out.append(" ".join(own))
    out += [out[0], out[0], out[1].upper(), "", None, " \n\t ", "word", "two words", "a " * 400, "x" * 5000, " ".join(words(rng, 9000))]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", "s", 0, 0.5, 3, "x") for i, t in enumerate(texts)]
    rows.append((0, texts[0], "en", "s", 0, 0.5, 3, "x"))  # a row twice
    rows.append((None, "a text without an id " * 30, None, None, None, None, None, None))
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def tokens(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if w]


def shingles(text):
    w = tokens(text)
    k = min(5, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def test_written_shards_have_every_row_once(spark, docs, tmp_path):
    sharding.write_shards(docs, str(tmp_path / "out"), 6)
    back, rows = spark.read.parquet(str(tmp_path / "out")), docs.collect()
    assert Counter((r["doc_id"], r["text"], r["source"]) for r in back.collect()) == Counter((r["doc_id"], r["text"], r["source"]) for r in rows)
    want = Counter((r["doc_id"], r["shard"]) for r in sharding.shard_by_bytes(docs, 6).collect())
    assert Counter((r["doc_id"], r["shard"]) for r in back.collect()) == want


def test_sharding(docs, nothing):
    rows = sharding.shard_by_bytes(docs, 6).collect()
    source = docs.select("doc_id", "text").collect()
    assert len(rows) == len(source)
    want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode())) for r in source)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    sizes = Counter()
    for r in rows:
        sizes[r["shard"]] += r["size"]
    total, most = sum(sizes.values()), max(r["size"] for r in rows)
    assert all(abs(sizes[s] - total / 6) <= most for s in range(6))
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    ordered = sorted(rows, key=lambda r: (-1 if r["doc_id"] is None else r["doc_id"], r["shard"], r["slot"]))
    assert [r["shard"] for r in ordered] == sorted(r["shard"] for r in rows)
    assert sharding.shard_by_bytes(nothing, 6).count() == 0


def test_packing(docs, nothing):
    import public_tokenizers
    from tokenizers import Tokenizer

    file = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, limits = Tokenizer.from_file(file), packing.Limits(512, 40, 500)
    rows = packing.pack_documents(docs, file, limits, chunk_tokens=3000).collect()
    ids = {r["doc_id"]: [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2] for r in docs.collect()}
    covered, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["doc_tokens"] == len(ids[r["doc_id"]]) and r["length"] == len(own) > 0
        assert r["ids_crc32"] == zlib.crc32(np.array(own, dtype="<u4").tobytes())
        covered[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    times = Counter(r["doc_id"] for r in docs.collect())
    for doc_id, x in ids.items():
        seen = Counter(k for s, n in covered[doc_id] for k in range(s, s + n))
        assert seen == Counter({k: times[doc_id] for k in range(len(x))})
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= limits.tokens and len(pieces) <= limits.segments and at - len(pieces) <= limits.loss
    assert packing.pack_documents(nothing, file).count() == 0


def test_words_with_added_tokens_get_the_tokenizers_ids():
    import public_tokenizers
    from tokenizers import Tokenizer

    file = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(file)
    end = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    texts = [f(x) for t in end for x in (t, t.upper(), t.title()) for f in (str, "x.{}".format, "{}y".format, "One {} two".format, "a{0}{0} é {0}.".format, " \n{}\t".format)]
    texts += ["x <| y |> z", "plain words.", "", "<", "|"]
    got = packing.WordIds(file)([t.encode() for t in texts])
    for text, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, dtype="<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_packing_of_examples_keeps_all_limits(spark):
    rng = random.Random(1)
    rows = [(str(i), rng.randint(1, 900), rng.randint(1, 6), rng.randint(0, 400)) for i in range(300)] + [("huge", 5000, 1, 1), ("null", None, None, None)]
    limits = packing.Limits(1000, 8, 600)
    out = packing.pack_examples(spark.createDataFrame(rows, "example_id string, tokens long, segments long, loss long"), limits).collect()
    assert len(out) == len(rows) and [r["example_id"] for r in out if r["bin_id"] is None] == ["huge"]
    bins = defaultdict(lambda: [0, 0, 0])
    for r in out:
        if r["bin_id"] is not None:
            for k, c in enumerate(("tokens", "segments", "loss")):
                bins[r["bin_id"]][k] += r[c]
    assert all(a <= 1000 and b <= 8 and c <= 600 for a, b, c in bins.values())


def test_jaccard_components(docs, nothing):
    source = [(r["doc_id"], r["text"]) for r in docs.collect()]
    sets, parent = [shingles(t) for _, t in source], list(range(len(source)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                parent[root(i)] = root(j)
    groups = defaultdict(list)
    for i, (d, _) in enumerate(source):
        groups[root(i)].append(d)
    want = Counter((d, len(sets[i]), min((x for x in groups[root(i)] if x is not None), default=None)) for i, (d, _) in enumerate(source))
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(docs).collect())
    assert got == want
    assert jaccard_join.jaccard_components(nothing).count() == 0
    kept = jaccard_join.keep_one_of_each(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {d for d, _, c in want if d == c}


def test_regions_of_large_groups_are_joined_exactly(spark):
    """A chain of sets, each linked with its neighbours only, and many sets around one frequent shingle."""
    rng = random.Random(3)
    base = words(rng, 60)
    rows = []
    for i in range(30):
        rows.append((i, " ".join(base[:] if i == 0 else rows[-1][1].split()[2:] + words(rng, 2))))
    line = "one two three four five six seven"
    rows += [(100 + i, line + " " + " ".join(words(rng, 30))) for i in range(60)]
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {d: shingles(t) for d, t in rows}
    want = {d: d for d in sets}
    for _ in range(len(rows)):
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    want[a] = want[b] = min(want[a], want[b])
        if all(want[a] == want[want[a]] for a in sets):
            break
    assert got == want


def test_quality_rules(docs, nothing):
    out = quality_rules.divergence_rules(docs)
    got = Counter(tuple(r[c] for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) for r in out.collect())
    want = Counter()
    for r in docs.collect():
        text = r["text"] or ""
        w = [x for x in re.split("[\x20\x09-\x0d]+", text) if x]
        runs = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {k for i in range(len(w) - 7) if runs[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
        lines = [x for x in text.split("\n") if x.strip(" \t\r\x0b\x0c")]
        n = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
        want[(r["doc_id"], *n, n[0] < 20 or 100 * n[4] > 30 * n[0])] += 1
    assert got == want
    assert not [r for r in out.collect() if r["base_failed"] and r["kept"]]
    assert quality_rules.divergence_rules(nothing).count() == 0


def test_js_distance(spark):
    from pyspark.sql import functions as F

    rows = [([1.0, 0.0], [0.0, 1.0]), ([0.5, 0.5], [0.5, 0.5]), ([0.9, 0.1], [0.1, 0.9])]
    got = [r[0] for r in spark.createDataFrame(rows, "p array<double>, q array<double>").select(quality_rules.js_distance(F.col("p"), F.col("q"))).collect()]

    def want(p, q):
        m = [(a + b) / 2 for a, b in zip(p, q)]
        return np.sqrt(sum(0.5 * a * np.log2(a / c) for a, c in zip(p, m) if a) + sum(0.5 * b * np.log2(b / c) for b, c in zip(q, m) if b))

    assert np.allclose(got, [want(p, q) for p, q in rows])


def test_suffix_dedup(docs, nothing):
    width = 200
    source = [(r["doc_id"], (r["text"] or "").encode()) for r in docs.collect()]
    counts = Counter(t[i : i + width] for _, t in source for i in range(len(t) - width + 1))
    want = Counter()
    for d, t in source:
        gone = np.zeros(len(t) + 1, dtype=bool)
        for i in range(len(t) - width + 1):
            if counts[t[i : i + width]] > 1:
                gone[i : i + width] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        want[d, len(t), int(gone.sum()), int((gone & ~np.append(False, gone[:-1])).sum()), hashlib.sha256(kept).hexdigest()] += 1
    out = suffix_dedup.remove_repeats(docs)
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in out.collect())
    assert got == want
    assert suffix_dedup.remove_repeats(nothing).count() == 0


def test_suffix_dedup_counts_windows_of_hot_grams(spark):
    rng = random.Random(9)
    shared = " ".join(words(rng, 60))[:260]
    rows = [(i, " ".join(words(rng, 40)) + shared + " ".join(words(rng, 40))) for i in range(12)]
    got = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(n >= len(shared.encode()) for n in got.values())


def test_repeated_passages(docs, texts, nothing):
    rows = compact_windows.repeated_passages(docs).collect()
    met = {r["doc_id"] for r in rows} | {r["class_doc_id"] for r in rows}
    owners = defaultdict(set)
    for i, t in enumerate(texts):
        w = tokens(t)
        for k in range(len(w) - 49):
            owners[tuple(w[k : k + 50])].add(i)
    repeated = {i for s in owners.values() if len(s) > 1 for i in s}
    assert repeated <= met
    sets = {}
    for r in rows:
        a, b = (tokens(texts[d])[s:e] for d, s, e in ((r["doc_id"], r["start_word"], r["end_word"]), (r["class_doc_id"], r["class_start"], r["class_end"])) if d is not None)
        x, y = shingles(" ".join(a)), shingles(" ".join(b))
        assert len(a) >= 50 and len(b) >= 50 and 100 * len(x & y) >= 75 * len(x | y)
    assert not sets and compact_windows.repeated_passages(nothing).count() == 0


def passage_links(spark, texts):
    rows = compact_windows.repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return {frozenset((r["doc_id"], r["class_doc_id"])) for r in rows}


def test_passages_around_a_common_line_meet_their_own_partners(spark):
    """Forty passages of two texts each, all around one line: each text meets the one that shares its passage."""
    rng = np.random.default_rng(31)
    word = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**6, n))
    line = " ".join(f"line{k}" for k in range(14))
    passages = [f"{word(30)} {line} {word(30)}" for _ in range(40)]
    texts = [f"{word(int(rng.integers(5, 60)))} {p} {word(int(rng.integers(5, 60)))}" for p in passages for _ in range(2)]
    assert passage_links(spark, texts) == {frozenset((2 * k, 2 * k + 1)) for k in range(40)}


def test_recall_of_near_passages(spark):
    """Passages of 70 words inside other text, four variants each with a word changed, against all aligned stretches."""
    rng = np.random.default_rng(32)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    texts, want = [], set()
    for k in range(60):
        base, variants = words(70), []
        for _ in range(4):
            own = list(base)
            own[int(rng.integers(70))] = words(1)[0]
            variants.append(own)
            texts.append(" ".join(words(int(rng.integers(0, 80))) + own + words(int(rng.integers(0, 80)))))
        runs = [[tuple(v[i : i + 5]) for i in range(66)] for v in variants]
        for i in range(4):
            for j in range(i):
                for s in range(21):
                    for e in range(s + 46, 67):
                        x, y = set(runs[i][s:e]), set(runs[j][s:e])
                        if runs[i][s] == runs[j][s] and runs[i][e - 1] == runs[j][e - 1] and 100 * len(x & y) >= 75 * len(x | y):
                            want |= {4 * k + i, 4 * k + j}
    links = passage_links(spark, texts)
    assert all(len({x // 4 for x in link}) == 1 for link in links)
    met = {x for link in links for x in link}
    assert len(want) > 150 and len(met & want) >= 0.95 * len(want)


def test_pairs_of_windows_do_not_depend_on_batches():
    rng = np.random.default_rng(33)
    s = [rng.integers(0, 2**63, n).astype(np.uint64) for n in (90, 200)]
    cols = []
    for f in range(3):
        text, l, c, r, sig = compact_windows.compact_windows(s, 20, f)
        cols += list(zip(text.tolist(), c.tolist(), l.tolist(), r.tolist(), [f] * len(text), sig.tolist(), strict=True))
    cols.sort()
    whole = [np.array(x) for x in zip(*cols, strict=True)]
    want = {(tuple(x.values()),) for x in compact_windows._paired(whole, 20, 0).to_pylist()}
    expected = sum(
        a[0] == b[0] and a[4] < b[4] and abs(a[1] - b[1]) < 20 and max(a[2], b[2]) <= min(a[1], b[1]) and max(a[1], b[1]) <= min(a[3], b[3]) and min(a[3], b[3]) - max(a[2], b[2]) >= 19
        for a in cols for b in cols
    )
    half = len(cols) // 2
    first = compact_windows._paired([x[:half] for x in whole], 20, 0).to_pylist()
    second = compact_windows._paired(whole, 20, half).to_pylist()
    assert {(tuple(x.values()),) for x in first + second} == want
    assert len(first) + len(second) == expected == compact_windows._paired(whole, 20, 0).num_rows


def test_compact_windows_cover_every_long_run_once():
    rng = np.random.default_rng(5)
    for n in (3, 10, 47, 120):
        s = rng.integers(0, 2**63, n).astype(np.uint64)
        for width in (3, 7, 20):
            text, l, c, r, _ = compact_windows.compact_windows([s], width, 0)
            for i in range(n):
                for j in range(i + width - 1, n):
                    assert sum(1 for a, b, d in zip(l, c, r) if a <= i <= b <= j <= d) == 1


def test_equal_shingles_have_few_windows():
    """A word or line said over and over: each long run is covered once, by about as many windows as in other text."""
    rng = np.random.default_rng(34)
    for period in (1, 3, 12, 40):
        s = np.concatenate([rng.integers(0, 2**63, 50), np.tile(rng.integers(0, 2**63, period), 400 // period), rng.integers(0, 2**63, 50)]).astype(np.uint64)
        text, l, c, r, _ = compact_windows.compact_windows([s], 46, 0)
        assert len(text) < 60
        for i in range(len(s) - 45):
            for j in range(i + 45, len(s), 7):
                assert sum(1 for a, b, d in zip(l, c, r) if a <= i <= b <= j <= d) == 1
                assert s[[b for a, b, d in zip(l, c, r) if a <= i <= b <= j <= d][0]] in s[i : j + 1]


def test_texts_that_repeat_one_word_or_line_meet(spark):
    rng = np.random.default_rng(35)
    word = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**6, n))
    line = " ".join(f"line{k}" for k in range(9)) + " "
    texts = [f"{word(40)} {said}{word(20 + 30 * k)}" for said in ("is " * 90, line * 12) for k in range(2)] + [word(100)]
    assert passage_links(spark, texts) == {frozenset((0, 1)), frozenset((2, 3))}


def test_texts_with_only_a_line_in_common_are_not_all_compared(spark, monkeypatch):
    """Pairs that are compared grow with the texts of a common line, not with their square; a passage around it is found."""
    rng = np.random.default_rng(36)
    word = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**6, n))
    line = " ".join(f"line{k}" for k in range(28))
    passage = f"{word(30)} {line} {word(30)}"
    texts = [f"{word(24)} {line} {word(24)}" for _ in range(150)] + [f"{word(20)} {passage} {word(20)}" for _ in range(2)]
    compared, save = [], compact_windows.save

    def counted(df, name):
        out = save(df, name)
        compared.append(out.count() if name == "passage-pairs" else 0)
        return out

    monkeypatch.setattr(compact_windows, "save", counted)
    assert passage_links(spark, texts) == {frozenset((150, 151))}
    assert sum(compared) < 20 * len(texts)


def test_passages_are_found_in_a_fixed_number_of_steps(spark, monkeypatch):
    """Groups of twelve near passages and a line that all other texts have in common: as many tables are saved as for any other input,
    and each text of a group has rows of its own."""
    rng = np.random.default_rng(37)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    line, texts = [f"line{k}" for k in range(40)], []
    for _ in range(12):
        base = words(70)
        for _ in range(12):
            own = list(base)
            own[int(rng.integers(70))] = words(1)[0]
            texts.append(" ".join(words(int(rng.integers(0, 60))) + own + words(int(rng.integers(0, 60)))))
    texts += [" ".join(words(30) + line + words(30)) for _ in range(150)]
    saved, save = [], compact_windows.save
    monkeypatch.setattr(compact_windows, "save", lambda df, name: (saved.append(name), save(df, name))[1])
    rows = compact_windows.repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert all(r["doc_id"] // 12 == r["class_doc_id"] // 12 and r["doc_id"] < 144 for r in rows)
    assert len({r["doc_id"] for r in rows}) >= 0.95 * 144
    assert len(saved) == len(set(saved)) <= 5


def test_windows_of_a_large_key_meet_as_by_comparing_all(monkeypatch):
    """Windows that share a line, some of them a passage: rare shingles lead to the same pairs, and these do not grow with the square."""
    rng = np.random.default_rng(38)
    near = rng.integers(1, 1 << 16, (400, 91)).astype(np.uint16)
    near[:, 30:67] = near[0, 30:67]
    for k in range(0, 60, 3):
        near[k : k + 3] = near[k]
        near[k : k + 3, ::30] = rng.integers(1, 1 << 16, (3, 4))
    near = near[rng.permutation(400)]
    sets = np.sort(near, axis=1)
    sets[:, 1:][sets[:, 1:] == sets[:, :-1]] = 0
    fewest = compact_windows._fewest_shared(near, sets, 46)
    found = []
    for many in (0, 1000):
        monkeypatch.setattr(compact_windows, "_MANY", many)
        pairs = compact_windows._alike(np.arange(400), near, sets, fewest, 46, 40, np.zeros(1 << 16, dtype=bool))
        found.append({(int(a), int(b)) for i, j in pairs for a, b in zip(i, j, strict=True)})
    assert found[0] == found[1] and len(found[0]) < 80  # a few share some shingles by chance
    common = {(a, b) for a in range(400) for b in range(a) if len(np.intersect1d(near[a], near[b])) >= 80}
    assert len(common) == 60 and {a for a, _ in common} <= {a for a, _ in found[0]}


def test_decontamination(spark, docs, texts, nothing):
    items = [(1, " ".join(tokens(texts[2])[10:50])), (2, " ".join(tokens(texts[3])[5:35]) + ". The answer."), (3, "unseen question words here. And an answer"), (4, None), (5, ""), (None, "x y")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.find_leaks(docs, benchmark).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(2, 1)}
    assert decontamination.find_leaks(docs, benchmark, block_items=1).count() == len(found)
    kept = decontamination.drop_leaks(docs, benchmark)
    assert kept.count() == docs.count() - 1 and kept.columns == docs.columns
    assert decontamination.find_leaks(nothing, benchmark).count() == 0
    assert decontamination.find_leaks(docs, benchmark.where("item_id > 99")).count() == 0


def test_block_max_wand_finds_all_above_threshold():
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(3, 30)))) for i in range(150)]
    index = decontamination.build_index(items)
    for _ in range(60):
        query = sorted({index.terms[w] for w in rng.sample(vocabulary, 20) if w in index.terms})
        scores = np.zeros(len(items))
        for t in query:
            scores[index.postings[t]] += index.impacts[t]
        for threshold in (0.2, 0.5, 0.8):
            got = dict(decontamination.block_max_wand(index, query, threshold))
            assert set(got) == set(np.flatnonzero(scores >= threshold - 1e-9)) and all(abs(scores[i] - s) < 1e-9 for i, s in got.items())


def test_classifier_learns_and_scores_all(spark, docs, nothing):
    rng = random.Random(2)
    good = [" ".join(words(rng, 120)) for _ in range(120)]
    bad = [" ".join(w + "***" for w in words(rng, 120)) for _ in range(120)]
    model = quality_classifier.fit([t.encode() for t in good[:80] + bad[:80]], np.array([1] * 80 + [0] * 80), rounds=15)
    assert model.score([t.encode() for t in good[80:]]).min() > model.score([t.encode() for t in bad[80:]]).max()
    out = quality_classifier.score_documents(docs, model)
    assert out.count() == docs.count() and out.where("score is null or score < 0 or score > 1").count() == 0
    assert quality_classifier.score_documents(nothing, model).count() == 0
    kept = quality_classifier.keep_quality(docs, model)
    assert kept.columns == docs.columns and kept.count() == out.where("predicted = 1").count()
    labels = spark.createDataFrame([(i, 1, 0) for i in range(5)] + [(6, None, None)], "doc_id long, quality int, toxic int")
    assert 0 < quality_classifier.train(docs, labels).score([b""])[0] < 1


def test_classifier_gradients():
    rng = np.random.default_rng(0)
    shapes = {"W": (6, 4), "b": (4,), "V": (4, 3), "U": (4, 3), "a": (3,), "c": (4,), "d": (1,)}
    model = quality_classifier.GatedAttention(np.zeros(6), np.ones(6), {k: rng.normal(size=s) for k, s in shapes.items()})
    x, first, y = rng.normal(size=(9, 6)), np.array([0, 2, 5]), np.array([1.0, 0.0, 1.0])

    def loss():
        p = model.forward(x, first)["score"]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    for k, g in model.gradients(x, first, y).items():
        flat = model.weights[k].reshape(-1)
        for i in range(len(flat)):
            keep = flat[i]
            flat[i] = keep + 1e-6
            up = loss()
            flat[i] = keep - 1e-6
            assert abs((up - loss()) / 2e-6 - g.reshape(-1)[i]) < 1e-5
            flat[i] = keep


def test_lm_scores(docs, nothing):
    rows = suffix_tree_lm.score_texts(docs).collect()
    source = docs.select("doc_id", "text").collect()
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1
    counts = Counter(w for r in source if not held(r["doc_id"]) for w in [*tokens(r["text"]), None])
    total, distinct = sum(counts.values()), len(counts)
    want = Counter()
    for r in source:
        t = [*tokens(r["text"]), None]
        base = sum(np.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in t)
        want[r["doc_id"], held(r["doc_id"]), len(t), sum(counts[w] > 0 for w in t), total, round(base, 6)] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows) == want
    assert all(r["score"] < 0 for r in rows)
    assert suffix_tree_lm.score_texts(nothing).count() == 0


def code(context, symbol):
    """A code of the suffix tree: the context's bytes, the last one first, and the symbol."""
    return int.from_bytes(context[::-1] + bytes([symbol]), "big")


def test_suffix_tree_distributions_sum_to_one(docs):
    tree = suffix_tree_lm.grow_tree(docs.selectExpr("coalesce(text, '') as text"))
    for context in (b"\n\n\n\n\n\n\n", b"the ba ", b"zzzzzzz", b"of the "):
        codes = np.array([code(context, b) for b in range(256)], dtype=np.uint64)
        assert abs((10 ** tree.log10(codes)).sum() - 1) < 1e-5
    assert max(len(c) for c in tree.contexts) > 1


def brute_tree(streams, least, depth):
    """Counts of every context, and those that stay: as the module says, without its numbers and levels."""
    counts = defaultdict(Counter)
    for s in streams:
        s = b"\n" * depth + s
        for i in range(depth, len(s)):
            for k in range(depth + 1):
                counts[s[i - k : i]][s[i]] += 1
    stay = set()
    for context, own in counts.items():
        total, up = sum(own.values()), counts[context[1:]]
        gain = sum(n * np.log(n / total / (up[x] / sum(up.values()))) for x, n in own.items())
        if len(context) < suffix_tree_lm.SURE or total >= least and gain > 0.5 * len(own) * np.log(total):
            stay |= {context[k:] for k in range(len(context) + 1)}
    return counts, stay


def brute_log10(counts, stay, context, symbol):
    p = 1 / 256
    for k in range(len(context) + 1):
        own = context[len(context) - k :]
        if own not in stay or own not in counts:
            break
        p = (counts[own][symbol] + len(counts[own]) * p) / (sum(counts[own].values()) + len(counts[own]))
    return np.log10(p)


def test_suffix_tree_is_that_of_brute_force(spark):
    rng = random.Random(5)
    source = [" ".join(words(rng, 40)) for _ in range(12)] + ["the same words again and again " * 4] * 3 + ["", "É é"]
    streams = [suffix_tree_lm.symbols(t.encode()) for t in source]
    counts, stay = brute_tree(streams, suffix_tree_lm.LEAST, suffix_tree_lm.DEPTH)
    tree = suffix_tree_lm.grow_tree(spark.createDataFrame([(t,) for t in source], "text string"))
    for k, contexts in enumerate(tree.contexts):
        assert {int(c).to_bytes(k, "big")[::-1] for c in contexts} == {c for c in stay if len(c) == k and c in counts}
    for s, got in zip(streams, tree.score(streams), strict=True):
        padded = b"\n" * suffix_tree_lm.DEPTH + s
        want = sum(brute_log10(counts, stay, padded[i : i + suffix_tree_lm.DEPTH], padded[i + suffix_tree_lm.DEPTH]) for i in range(len(s)))
        assert abs(got - want) < 1e-6 * abs(want)


@pytest.mark.parametrize("rounds", [1, 3])
def test_parts_of_the_suffix_tree_score_as_the_whole(docs, monkeypatch, rounds):
    monkeypatch.setattr(suffix_tree_lm, "WORD_SHARE", 0.0)  # the tree alone
    monkeypatch.setattr(suffix_tree_lm, "_BYTES", 20_000)
    rows = docs.selectExpr("xxhash64(doc_id, text) as rid", "coalesce(doc_id, 0) % 5 != 1 as train", "coalesce(text, '') as text")
    tree = suffix_tree_lm.grow_tree(rows.where("train").select("text"))
    got = {r["rid"]: r["score"] for r in suffix_tree_lm.score_rows(rows, symbols_at_once=10_000, words_at_once=500, rounds=rounds).collect()}
    source = rows.collect()
    assert got.keys() == {r["rid"] for r in source}
    for r, want in zip(source, tree.score([suffix_tree_lm.symbols(r["text"].encode()) for r in source]), strict=True):
        assert abs(got[r["rid"]] - want) < 1e-5 * abs(want) + 1e-5


def test_scores_mix_tree_and_words(docs):
    """Word by word: 0.1 of the word's unigram probability and 0.9 of what the tree gives its symbols; the unigram
    probability of unknown words is dealt among them by the tree."""
    source = docs.select("doc_id", "text").collect()
    train = [r for r in source if zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 5 != 1]
    counts = Counter(w for r in train for w in [*tokens(r["text"]), None])
    total, distinct = sum(counts.values()), len(counts)
    tree = suffix_tree_lm.grow_tree(docs.where("crc32(cast(coalesce(cast(doc_id as string), '') as binary)) % 5 != 1").selectExpr("coalesce(text, '') as text"))
    got = defaultdict(set)
    for r in suffix_tree_lm.score_texts(docs).collect():
        got[r["doc_id"], r["n_tokens"]].add(round(r["score"], 2))
    for r in source[:25]:
        stream, want = suffix_tree_lm.symbols((r["text"] or "").encode()), 0.0
        codes, _ = suffix_tree_lm._codes([stream])
        found, at = np.unique(codes, return_inverse=True)
        by_symbol, begin = tree.log10(found)[at], 0
        for w in [*tokens(r["text"]), None]:
            end = begin + (1 if w is None else len(w.encode()) + 1)
            spelled = 10 ** by_symbol[begin:end].sum()
            want += np.log10(0.1 * (counts[w] + 0.5) / (total + 0.5 * (distinct + 1)) * (1 if counts[w] else spelled) + 0.9 * spelled)
            begin = end
        assert any(abs(x - want) < 0.011 + 1e-5 * abs(want) for x in got[r["doc_id"], len(tokens(r["text"])) + 1])


def test_probabilities_of_all_words_sum_to_at_most_one():
    """Every word of at most four letters of a small alphabet after a text, known or not, and the end: the mass that is
    given stays at most one and grows with the length allowed, and what is known has its share of it."""
    streams = [suffix_tree_lm.symbols(t) for t in [b"ab ba abc ab cab b a", b"ba ba cab abc a b", b"abc ab a"] * 5]
    tree = suffix_tree_lm.grow(*suffix_tree_lm._counted(suffix_tree_lm._codes(streams)[0]))
    counts = Counter(w for s in streams for w in [*s.split(), None])
    total, distinct = sum(counts.values()), len(counts)
    for before in (b"", b"ab ", b"ba cab "):
        mass = []
        for longest in (1, 2, 3, 4):
            chosen = [None, *(bytes(w) for n in range(1, longest + 1) for w in itertools.product(b"abcz", repeat=n))]
            spelled = tree.score([before + (b"\n" if w is None else w + b" ") for w in chosen]) - (tree.score([before])[0] if before else 0)
            c = np.array([counts[w] for w in chosen])
            mass.append((10 ** suffix_tree_lm.mix(spelled, np.log10((c + 0.5) / (total + 0.5 * (distinct + 1))), c > 0, suffix_tree_lm.WORD_SHARE)).sum())
        assert mass == sorted(mass) and 0.5 < mass[-1] <= 1 + 1e-9


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.1/documents.parquet"), reason="needs the synthetic documents")
def test_held_out_texts_score_above_the_unigram_model(spark):
    """Also above the one that gives each unknown word the mass of all; a tree of few texts spells those too dearly for that."""
    row = suffix_tree_lm.op3_lm_scoring(spark, "/root/testdata/sf0.1").where("held_out").selectExpr("sum(score) / sum(n_tokens) as s", "sum(base_score) / sum(n_tokens) as b").first()
    assert row["s"] > row["b"] + 0.15


def test_rare_long_contexts_stay_in_a_tree_of_many_symbols(spark):
    rows = [("e " * 550_000,)] * 10 + [(x + "bcdef" + y,) for x, y in ("pq", "rs", "tu", "vw") for _ in range(10)]
    tree = suffix_tree_lm.grow_tree(spark.createDataFrame(rows, "text string").repartition(4))
    assert int.from_bytes(b"pbcdef"[::-1], "big") in tree.contexts[6].tolist()
    assert 10 ** tree.log10(np.array([code(b"\npbcdef", ord("q"))], dtype=np.uint64))[0] > 0.7


PAGES = [
    ("<p>One<p>Two <b>bold</b>  x", "One\n\nTwo bold x"),
    ("<ul><li>a<li>b<ol start=3><li>c<li>d</ol></ul>", "- a\n- b\n  3. c\n  4. d"),
    ("<table><tr><th>Name<th>N<tr><td>x<td>12</table>", "Name | N\nx    | 12"),
    ("a<div style='display: none'>no</div><script>var t='</p>';</script><div hidden>no</div>b", "ab"),
    ("x &amp; y<br>z", "x & y\nz"),
    ("<pre> a\n  b</pre>", " a\n  b"),
    ("plain", "plain"),
    ("", ""),
    (None, ""),
    ("<title>t</title><body>b <a href='x'>link</a> <input value=v>", "b link"),
    ("a < b and <unclosed", "a < b and <unclosed"),
    ("<div>" * 3000 + "deep", "deep"),
    ("<div>" * 250 + "<span hidden>secret<b>too</b></span>seen", "seen"),
    ("<div>" * 250 + "one<div>two<i>and</i></div>three", "one\ntwoand\nthree"),
    ("<div>" * 250 + "<div hidden>secret</div></div>" * 250 + "after", "after"),
    ("<p aria-hidden='true'>seen</p>", "seen"),
    ("<select><option>a<option>b</select><object>c</object><svg><text>d</text></svg>", "a\nb\ncd"),
    ("<table><tr><td>" + "w" * 60 + "<td>1<tr><td>x<td>2</table>", "w" * 60 + " | 1\n" + "x".ljust(60) + " | 2"),
    ("<table><tr><td colspan=2>both<td>c<tr><td>a<td>b<td>c</table>", "both  | c\na | b | c"),
    ("<script>if (a<b && c=='</p>') {}</script>x<textarea>a <b> c</textarea>", "xa <b> c"),
    ("<p title='a > b'>x</p><p title='it>y</p>", "x\n\ny"),
    ("<table><tr><td><p>one</p><p>two</p><ul><li>a<li>b</ul></td></tr><tr><td>foot</table>", "one\n\ntwo\n\n- a\n- b\n\nfoot"),
    ("<table><tr><td>a<br>bb<td>right<tr><td>x<td>y<br>z</table>", "a  | right\nbb\nx  | y\n     z"),
    ("<table><tr><td><table><tr><td>1<td>22<tr><td>333<td>4</table><td>z</table>", "1   | 22 | z\n333 | 4"),
    ("<table><tr><td>nav<tr><td><p>first<p>second</table>", "nav\n\nfirst\n\nsecond"),
    ("a<br><br>b<br>c<br><br><br>d", "a\n\nb\nc\n\nd"),
    ("<div style='visibility:hidden'>no<p style='visibility:visible'>yes</p>no<ul><li>no</ul></div>", "yes"),
    ("<div style='display:none'>no<p style='visibility:visible'>no</p></div>x", "x"),
    ("<table><tr><td rowspan=2>A<td>b<tr><td>c<tr><td>d<td>e</table>", "A | b\n  | c\nd | e"),
    ("<ol><li value=4>x<li>y</ol><form>q <input type=submit value='Go &amp; see'><input type=hidden value=no></form>", "4. x\n5. y\n\nq Go & see"),
]


def test_html_is_read_in_linear_time():
    began = time.monotonic()
    for page in ("<a " * 350_000, "<a '" * 250_000 + ">", "<p><button>" + "<b>" * 150_000 + "<div>" * 100_000, "<!--" * 250_000, "<table>" + "<tr><td>x" * 50_000 + "<tr><td>" + "y" * 300_000 + "<td>z", "<table><tr>" + "<td>a<br>b" * 2000 + "<td>" + "c<br>" * 100_000, "<table><tr><td>x<td>" * 150 + "deep"):
        assert len(html_text.page_text(page)) < 120 * len(page)
    assert time.monotonic() - began < 20
    began = time.monotonic()
    assert html_text.page_text("<a " * 350_000).startswith("<a <a")
    assert time.monotonic() - began < 1


def test_html(spark):
    rows = [(i, h, "u", 1) for i, (h, _) in enumerate(PAGES)]
    pages = spark.createDataFrame(rows, "page_id long, html string, url string, n_lines int")
    got = {r["page_id"]: r["text"] for r in html_text.extract_text(pages).collect()}
    assert got == {i: t for i, (_, t) in enumerate(PAGES)}
    assert html_text.extract_text(pages.where("page_id < 0")).count() == 0


@pytest.mark.parametrize("threshold", [0.05, 0.2, 0.5, 0.9])
def test_leaks_at_any_threshold(spark, threshold):
    """All pairs of a passage and an item whose share of the item's own BM25 score is at the threshold."""
    rng = random.Random(11)
    items = [(i, "What is it? " + " ".join(words(rng, 14)) + "\n" + " ".join(words(rng, 6))) for i in range(40)]
    docs = [(i, " ".join(words(rng, 30)) + " " + items[i % 40][1] + " " + " ".join(words(rng, 10))) for i in range(30)] + [(99, " ".join(words(rng, 60)))]
    index = decontamination.build_index(items, spare=min(0.3, threshold / 2))
    want = set()
    for d, text in docs:
        own = set(decontamination.words_of(text.encode()))
        for k, item in enumerate(index.ids):
            score = sum(index.impacts[t][index.postings[t].index(k)] for w, t in index.terms.items() if w in own and k in index.postings[t])
            if score >= threshold - 1e-9:
                want.add((d, item))
    texts = [decontamination.words_of(t.encode()) for _, t in docs]
    got = {(docs[row][0], index.ids[item]) for row, item, *_ in decontamination.search(index, texts, threshold)}
    assert got == want and len(want) >= 30
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontamination.find_leaks(*frames, threshold=threshold).collect()}
    assert {(i, i % 40) for i in range(30)} <= found <= want


def test_unknown_languages_have_a_pool_of_their_own(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(words(rng, 120)), "en") for i in range(20)] + [(100 + i, " ".join("жшщ" + w for w in words(rng, 120)), lang) for i, lang in enumerate(["ru", None] * 5)]
    out = {r["doc_id"]: r for r in quality_rules.divergence_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(out[100 + i]["kept"] and out[100 + i]["word_distance"] is None for i in range(10))


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.1/documents.parquet"), reason="needs the synthetic documents")
def test_quality_scores_of_held_out_documents(spark):
    scores = quality_classifier.op4_quality_classifier(spark, "/root/testdata/sf0.1").where("held_out").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").select("score", "quality").toPandas()
    good, bad = (np.sort(scores.loc[scores["quality"] == k, "score"].to_numpy()) for k in (1, 0))
    auc = np.searchsorted(bad, good).sum() / len(good) / len(bad)
    print("held-out AUC", auc, len(good), len(bad))
    assert auc > 0.9


def test_bytes_of_the_classifier_sample_are_bounded(spark):
    docs = spark.createDataFrame([(i, ("good text " if i % 2 else "BAD!!! ") * 200) for i in range(50)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality")
    assert quality_classifier.train(docs, labels, most_bytes=0).score([b"x"])[0] == 0.5
    model = quality_classifier.train(docs, labels, most_bytes=1 << 20)
    assert model.score([b"good text " * 200])[0] > 0.5 > model.score([b"BAD!!! " * 200])[0]


@pytest.mark.parametrize("name", ["rid", "kept", "n_bytes", "rest", "spans", "_text"])
def test_columns_of_any_name_stay(spark, name):
    rows = spark.createDataFrame([(1, "a" * 300, 7), (2, "a" * 300, 8), (3, None, 9)], f"doc_id long, text string, `{name}` int")
    out = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(rows).collect()}
    assert [out[k]["n_removed"] for k in (1, 2, 3)] == [300, 300, 0]
    if name not in ("kept", "n_bytes"):
        assert [out[k][name] for k in (1, 2, 3)] == [7, 8, 9]
