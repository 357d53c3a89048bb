"""What the corpus operators send and hold, on small inputs."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tallyforge.llm import collocations, difference_cover, suffix_tree_lm

pytest.importorskip("pyspark")


def test_repeated_windows_send_no_row_for_each_place(spark, monkeypatch):
    rng = random.Random(3)
    text = bytearray(rng.randbytes(70_000))
    other = bytearray(text)
    for at in range(500, len(other), 997):
        other[at] ^= 1
    # a place lies in one piece, and pieces overlap by their last bytes
    cut = 40_000
    pieces = []
    for rid, t in enumerate((bytes(text), bytes(other))):
        pieces += [(rid, 0, cut, 0, t[: cut + 200]), (rid, cut, len(t) - cut, cut - 2, t[cut - 2 :])]
    rows = []

    def saved(df, name):
        out = kept(df, name)
        rows.append(out.count())
        return out

    kept = difference_cover.save
    monkeypatch.setattr(difference_cover, "save", saved)
    found = difference_cover.repeated_windows(spark.createDataFrame(pieces, "rid long, lo int, n int, begin int, bytes binary")).collect()
    width = difference_cover.WIDTH
    times = Counter(bytes(t[i : i + width]) for t in (text, other) for i in range(len(t) - width + 1))
    want = {(rid, i) for rid, t in enumerate((text, other)) for i in range(len(t) - width + 1) if times[bytes(t[i : i + width])] > 1}
    assert {(r["rid"], i) for r in found for i in range(r["s"], r["e"] - width + 1)} == want and len(want) > 100_000
    assert sum(rows) < 1000


def test_a_context_is_looked_up_once(monkeypatch):
    rng = random.Random(5)
    streams = [suffix_tree_lm.symbols(bytes(rng.choice(b"abcdef   ") for _ in range(3000))) for _ in range(5)]
    codes, counts = suffix_tree_lm._counted(suffix_tree_lm._codes(streams)[0])
    tree = suffix_tree_lm.grow(codes, counts)
    asked, search = [], np.searchsorted
    with monkeypatch.context() as m:
        m.setattr(np, "searchsorted", lambda a, v, *x, **y: (asked.append(len(v)), search(a, v, *x, **y))[1])
        got = tree.log10(codes)
    levels = list(zip(tree.contexts, tree.totals, tree.kinds, tree.pairs, tree.counts, strict=True))
    want = []
    for code in codes.tolist():
        p = 1 / 256
        for k, (contexts, totals, kinds, pairs, n) in enumerate(levels):
            own = code >> (64 - 8 * k) if k else 0
            at = np.flatnonzero(contexts == own)
            if not len(at):
                break
            seen = n[pairs == (own << 8 | code & 255)].sum()
            p = (seen + kinds[at[0]] * p) / (totals[at[0]] + kinds[at[0]])
        want.append(np.log10(p))
    assert np.allclose(got, want)
    assert sum(asked) < 1.6 * sum(asked[1::2])  # contexts, pairs, contexts, pairs, ...


def test_a_phrase_that_only_shares_a_slot_is_no_candidate():
    told, lang = [b"a b", b"a b c", b"b c"], "en"
    hashes = {}
    _, _, _, words, _, firsts = collocations._words(told, [lang] * 3)
    for phrase, begin, end in zip(told, firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
        h = words[begin]
        for word in words[begin + 1 : end]:
            h = collocations._grown(np.array([h]), np.array([word]))[0]
        hashes[phrase] = h
    known = np.sort(np.array([hashes[b"a b c"], hashes[b"b c"]], dtype=np.uint64))
    counts = np.where(known == hashes[b"b c"], 200, 150).astype(np.int64)
    found = pa.table({"part": [0, 0], "lang": [lang, lang], "told": [collocations._line(told), collocations._line(told[:1])]})
    reached = pa.table({"part": [0], "h": [collocations._packed(known)], "a": [collocations._planes(counts)]})
    rows = {r["phrase"]: r for r in collocations._candidates(found, reached).to_pylist()}
    assert {p: (r["k"], r["a"]) for p, r in rows.items()} == {"a b c": (3, 150), "b c": (2, 200)}
    assert np.uint64(rows["a b c"]["firsts"][1] % (1 << 64)) == hashes[b"a b"] and np.uint64(rows["a b c"]["rests"][0] % (1 << 64)) == hashes[b"b c"]
    assert collocations._candidates(found, reached.slice(0, 0)).num_rows == 0
