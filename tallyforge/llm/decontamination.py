"""Operator 1, benchmark decontamination: a BM25 index of test items, searched by block-max WAND.

Every training passage is a query. Impacts are divided by the item's own BM25 score, so a score is the share
of an item that a passage has, and one threshold holds for all items. Passages are runs of words that overlap
by half and are twice as long as the longest item, so that an item lies in one as a whole.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass, field
from functools import reduce
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, text_bytes

BLOCK = 32
_FIRST = itemgetter(0)
#: Letters are lower-cased and ASCII punctuation parts words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if c < 128 and not chr(c).isalnum() else c for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def split_item(text: str) -> tuple[str, str]:
    """Question and answer: the answer is the last line, in a single line the last sentence."""
    text = text.strip()
    head, _, tail = text.rpartition("\n")
    if not head.strip() or not words_of(tail.encode()):
        cut = [m.end() for m in re.finditer(r"[.?!]\s+", text)]
        head, tail = (text[: cut[-1]], text[cut[-1] :]) if cut else (text, text)
    return head, tail


def _shingles(words: list[bytes], n: int = 5) -> set[tuple]:
    k = min(n, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


@dataclass
class Index:
    """Postings by term: items in order, impacts, and the largest impact of each block of BLOCK postings."""

    ids: list
    parts: list[tuple[list[bytes], list[bytes]]]
    terms: dict[bytes, int] = field(default_factory=dict)
    postings: list = field(default_factory=list)
    impacts: list = field(default_factory=list)
    block_max: list = field(default_factory=list)
    most: np.ndarray = field(default_factory=lambda: np.zeros(0))
    essential: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=bool))
    missing: np.ndarray = field(default_factory=lambda: np.zeros(0))  # of each item, what terms that aren't essential add
    most_of: list[float] = field(default_factory=list)
    longest: int = 1
    begin: np.ndarray = field(default_factory=lambda: np.zeros(1, dtype=np.int64))  # all postings in a row
    flat_items: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))
    flat_impacts: np.ndarray = field(default_factory=lambda: np.zeros(0))


def build_index(items: list[tuple[int, str]], k1: float = 1.2, b: float = 0.75, spare: float = 0.3) -> Index:
    """Items: (id, text); items without words are left out.

    The terms of most items are not essential, as long as they add no more than `spare` to any item: a passage
    without the rest of an item's terms cannot reach a threshold above that.
    """
    rows = [(i, words_of(t.encode()), tuple(words_of(p.encode()) for p in split_item(t))) for i, t in items if t]
    rows = sorted((r for r in rows if r[1]), key=lambda r: r[0])
    index = Index([r[0] for r in rows], [r[2] for r in rows])
    n, mean = len(rows), np.mean([len(r[1]) for r in rows]) if rows else 1.0
    found: dict[bytes, list[tuple[int, int]]] = {}
    for at, (_, words, _) in enumerate(rows):
        for w in set(words):
            found.setdefault(w, []).append((at, words.count(w)))
    lengths = np.array([len(r[1]) for r in rows], dtype=np.float64)
    own = np.zeros(n)
    for w, posts in found.items():
        index.terms[w] = len(index.postings)
        at = np.array([p[0] for p in posts])
        tf = np.array([p[1] for p in posts], dtype=np.float64)
        impact = np.log(1 + (n - len(posts) + 0.5) / (len(posts) + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * lengths[at] / mean))
        own[at] += impact
        index.postings.append(at)
        index.impacts.append(impact)
    for k, at in enumerate(index.postings):
        index.impacts[k] = index.impacts[k] / own[at]
        index.block_max.append(np.maximum.reduceat(index.impacts[k], np.arange(0, len(at), BLOCK)))
    index.most = np.array([x.max() for x in index.impacts])
    index.missing = np.zeros(n)
    index.essential = np.ones(len(index.postings), dtype=bool)
    for k in sorted(range(len(index.postings)), key=lambda k: (-len(index.postings[k]), k)):
        at = index.postings[k]
        if len(at) < 2 or (index.missing[at] + index.impacts[k] > spare).any():
            break
        index.missing[at] += index.impacts[k]
        index.essential[k] = False
    if n:
        index.begin = np.append(0, np.cumsum([len(x) for x in index.postings]))
        index.flat_items, index.flat_impacts = np.concatenate(index.postings), np.concatenate(index.impacts)
    for lists in (index.postings, index.impacts, index.block_max):  # the walk through the lists reads single values
        lists[:] = [x.tolist() for x in lists]
    index.most_of = index.most.tolist()
    index.longest = int(lengths.max()) if n else 1
    return index


def block_max_wand(index: Index, query: list[int], threshold: float) -> list[tuple[int, float]]:
    """All items whose score for the query's distinct terms is at least threshold, with the scores."""
    end, slack = len(index.ids), threshold - 1e-9
    lists = [[posts[0], 0, posts, index.impacts[t], index.block_max[t], index.most_of[t]] for t in query if (posts := index.postings[t])]
    out: list[tuple[int, float]] = []

    def advance(cursor: list, item: int) -> None:
        posts = cursor[2]
        at = cursor[1] = bisect_left(posts, item, cursor[1])
        cursor[0] = posts[at] if at < len(posts) else end

    while True:
        lists = sorted((c for c in lists if c[0] < end), key=_FIRST)
        bound, pivot = 0.0, None
        for k, c in enumerate(lists):
            bound += c[5]
            if bound >= slack:
                pivot = k
                break
        if pivot is None:
            return out
        item = lists[pivot][0]
        while pivot + 1 < len(lists) and lists[pivot + 1][0] == item:
            pivot += 1
        blocks, upto = 0.0, end
        for _, at, posts, _, maxima, _ in lists[: pivot + 1]:
            place = bisect_left(posts, item, at)
            if place < len(posts):
                block = place // BLOCK
                blocks += maxima[block]
                upto = min(upto, posts[min((block + 1) * BLOCK, len(posts)) - 1] + 1)
        if blocks >= slack:
            score = 0.0
            for c in lists[: pivot + 1]:
                advance(c, item)
                if c[0] == item:
                    score += c[3][c[1]]
                    advance(c, item + 1)
            if score >= slack:
                out.append((item, score))
        else:  # no item before the end of these blocks, or before the next list, can do
            if pivot + 1 < len(lists):
                upto = min(upto, lists[pivot + 1][0])
            for c in lists[: pivot + 1]:
                advance(c, max(upto, item + 1))


def search(index: Index, texts: list[list[bytes]], threshold: float):
    """Yields (text, item, score, first word of the passage, words of the passage) of all passages of the texts.

    The pivot test comes first, for all passages at once: a passage whose essential terms do not take any item
    to the threshold, even with all of the item's other terms, has no pivot. The others go through the lists.
    """
    get, n_terms, n_items = index.terms.get, len(index.terms), len(index.ids)
    half = max(64, index.longest)
    lengths = np.array([len(words) for words in texts])
    term = np.array([get(w, -1) for words in texts for w in words], dtype=np.int64)
    if not n_items or not (term >= 0).any():
        return
    # the passage that starts at half-window p holds the half-windows p and p + 1 of its text
    halves = -(-lengths // half)
    first_half = np.cumsum(halves) - halves
    owner = np.repeat(np.arange(len(texts)), lengths)
    inside = np.arange(len(term)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    hit = term >= 0
    term, place, inner = term[hit], first_half[owner[hit]] + inside[hit] // half, inside[hit] >= half
    keys = np.sort(np.concatenate([place, place[inner] - 1]) * n_terms + np.concatenate([term, term[inner]]))
    keys = keys[np.append(True, keys[1:] != keys[:-1])]
    window, term = keys // n_terms, keys % n_terms
    needed = index.essential[term]
    begin, counts = index.begin[term[needed]], np.diff(index.begin)[term[needed]]
    flat = np.arange(counts.sum()) + np.repeat(begin - (np.cumsum(counts) - counts), counts)
    pair = np.repeat(window[needed], counts) * n_items + index.flat_items[flat]
    order = np.argsort(pair, kind="stable")
    pair, impact = pair[order], index.flat_impacts[flat][order]
    starts = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])) if len(pair) else np.zeros(0, dtype=np.int64)
    if not len(starts):
        return
    pair, total = pair[starts], np.add.reduceat(impact, starts)
    for p in np.unique(pair[total + index.missing[pair % n_items] >= threshold - 1e-9] // n_items):
        text = int(np.searchsorted(first_half, p, "right")) - 1
        while not halves[text]:
            text -= 1
        start = int(p - first_half[text]) * half
        own = term[np.searchsorted(window, p) : np.searchsorted(window, p, "right")]
        for item, score in block_max_wand(index, own.tolist(), threshold):
            yield text, item, score, start, texts[text][start : start + 2 * half]


def overlap(part: list[bytes], passage: set[tuple], passage_words: list[bytes]) -> float:
    """Share of the part's five-word shingles in the passage; a part of fewer words counts as one."""
    own = _shingles(part)
    if not own:
        return 1.0
    if len(part) < 5:
        k = len(part)
        return float(any(passage_words[i : i + k] == part for i in range(len(passage_words) - k + 1)))
    return len(own & passage) / len(own)


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, min_overlap: float = 0.75, block_items: int = 20_000) -> DataFrame:
    """Pairs doc_id, item_id whose best passage has score >= threshold and question and answer overlap >= min_overlap.

    docs: (doc_id, text); benchmark: (item_id, text). The index covers all items, block_items of them at
    a time: one scan of the documents for each block, so what tasks get is bounded. Null and empty texts
    match nothing; a pair has one row for each row of the document, with its best passage (the first of
    equal ones); repeated item ids count by themselves; empty tables give no rows.
    """
    schema = pa.schema(
        [("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64()), ("passage_start", pa.int64())]
    )
    ddl = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, passage_start long"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def scan_with(shared):
        def scan(batches):
            for batch in slices(batches, 256):
                ids = batch.column("doc_id").to_pylist()
                found = _leaks(shared.value, text_bytes(batch.column("text")), threshold, min_overlap)
                out = [(ids[row], shared.value.ids[item], *x) for (row, item), x in found.items()]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

        return scan

    parts = [rows.mapInArrow(scan_with(index), ddl) for index in _indexes(benchmark, block_items, threshold)]
    return reduce(DataFrame.unionByName, parts)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, min_overlap: float = 0.75, block_items: int = 20_000) -> DataFrame:
    """The rows of docs in which find_leaks() finds nothing, with all columns; no shuffle."""

    def keep_with(shared):
        def keep(batches):
            for batch in slices(batches, 256):
                hit = np.zeros(batch.num_rows, dtype=bool)
                for row, _ in _leaks(shared.value, text_bytes(batch.column("text")), threshold, min_overlap):
                    hit[row] = True
                yield batch.filter(pa.array(~hit))

        return keep

    for index in _indexes(benchmark, block_items, threshold):
        docs = docs.mapInArrow(keep_with(index), docs.schema)
    return docs


def _indexes(benchmark: DataFrame, block_items: int, threshold: float):
    """Broadcast indexes of at most about block_items items each."""
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    blocks = max(1, -(-items.count() // block_items))
    for block in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).toPandas()
        yield benchmark.sparkSession.sparkContext.broadcast(build_index(list(zip(own["item_id"].tolist(), own["text"].tolist(), strict=True)), spare=min(0.3, threshold / 2)))


def _leaks(index: Index, texts: list[bytes], threshold: float, min_overlap: float) -> dict[tuple[int, int], tuple]:
    """(text, item): score, question overlap, answer overlap and start of the best passage that is verified."""
    best: dict[tuple[int, int], tuple] = {}
    for row, item, score, start, passage in search(index, [words_of(t) for t in texts], threshold):
        shingles = _shingles(passage)
        q, a = (overlap(p, shingles, passage) for p in index.parts[item])
        if min(q, a) >= min_overlap - 1e-9 and ((row, item) not in best or score > best[row, item][0] + 1e-12):
            best[row, item] = (float(score), q, a, start)
    return best


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
