"""Operator 13, phrase collocations: dynamic itemset counting over shards that are scanned in turn.

Step s scans shard s mod M. Single words are counted from step 0; a longer phrase becomes active once both phrases that
are one word shorter (its first and its last words) have reached the threshold in what was scanned so far, and is then
counted in the next M steps, each shard once, while phrases of other lengths are counted in the same scans. The job ends
when no phrase is in its cycle.

Words carry their language in their hash, so that one count serves all languages. Tasks learn which phrases have reached
the threshold from two small tables of fixed size (for each slot of the phrases' hashes, the first and the last step in
which one of them did). Slots are shared, so a phrase may be counted too early or too long, never too late: all its
occurrences in a scanned shard are counted or none, the same whenever that shard is scanned. The state keeps one count
for each shard and takes no shard twice, and keeps a phrase until the last step in which its parts' slots still count
it, so that counts are exact whatever the size of the tables.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import _LOWER, drop, mix64, release, rolling, save, shared_dir, slices, table, text_bytes

LONGEST = 5
_NEVER = 255
_PIECE_BREAK = np.zeros(256, dtype=bool)
_PIECE_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_WORD_BREAK = _PIECE_BREAK.copy()
_WORD_BREAK[[0x20, 0x09]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of text, and words, that a task hashes together.
_TOGETHER = 1 << 20
_WORDS_TOGETHER = 1 << 19
#: Different phrases that a task holds before it tells them, and words for which the state has a part.
_FOUND = 1 << 20
_PART_WORDS = 1 << 19


def _language(lang: str) -> np.uint64:
    name = np.frombuffer(lang.encode(), dtype=np.uint8)
    roll = rolling()
    return mix64(roll.prefix(name)[-1:] + np.uint64(len(name)))[0]


def _words(texts: list[bytes], langs: list[str]):
    """Lower-cased bytes of all texts, starts, ends and hashes of their words (never 0), and whether a word begins a piece."""
    joined = b"\n".join(texts).translate(_LOWER)
    buffer = np.frombuffer(joined, dtype=np.uint8)
    apart = np.concatenate([[True], _WORD_BREAK[buffer], [True]])
    starts = np.flatnonzero(apart[:-1] & ~apart[1:])
    ends = np.flatnonzero(~apart[:-1] & apart[1:])
    roll = rolling()
    of = {x: _language(x) for x in set(langs)}
    lengths = np.array([len(t) + 1 for t in texts])
    firsts = np.searchsorted(starts, np.concatenate([[0], np.cumsum(lengths)]))
    lang = np.repeat(np.array([of[x] for x in langs], dtype=np.uint64), np.diff(firsts))
    words = mix64(mix64(roll.of(roll.prefix(buffer), starts, ends - starts) + (ends - starts).astype(np.uint64)) ^ lang)
    words[words == 0] = 1
    # texts are apart by a line break, so that the first word of a text begins a piece too
    breaks = np.concatenate([[0], np.cumsum(_PIECE_BREAK[buffer], dtype=np.int64)])
    new = np.ones(len(starts), dtype=bool)
    new[1:] = breaks[starts[1:]] > breaks[ends[:-1]]
    return joined, starts, ends, words, new, firsts


def _grown(hashes: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of phrases with one word more at their end."""
    return mix64(hashes * _STEP + word)


def _groups(batches, columns: tuple[str, ...], most: int = _TOGETHER):
    for batch in slices(batches):
        texts = text_bytes(batch.column("text"))
        at = 0
        while at < len(texts):
            size, until = len(texts[at]), at + 1
            while until < len(texts) and size + len(texts[until]) <= most:
                size, until = size + len(texts[until]), until + 1
            yield [batch.column(c).slice(at, until - at).to_pylist() for c in columns], texts[at:until]
            at = until


def _tokens(shards: int):
    """(lang, text) -> (shard, lang, tokens): word hashes with a 0 before each new piece."""

    def run(batches):
        turn = 0
        for (langs,), texts in _groups(batches, ("lang",)):
            _, _, _, words, new, firsts = _words(texts, langs)
            at = np.arange(len(words)) + np.cumsum(new)
            tokens = np.zeros(len(words) + int(new.sum()), dtype=np.int64)
            tokens[at] = words.view(np.int64)
            pieces = np.concatenate([[0], np.cumsum(new)])
            offsets = firsts + pieces[firsts]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array((turn + np.arange(len(texts))) % shards, pa.int32()),
                    pa.array(langs, pa.string()),
                    pa.array(np.diff(firsts), pa.int64()),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(tokens)),
                ],
                ["shard", "lang", "words", "tokens"],
            )
            turn += len(texts)

    return run


class Reached:
    """For each slot of phrase hashes, the first and the last step in which one of its phrases reached the threshold."""

    def __init__(self, slots: int):
        self.mask = np.uint64(slots - 1)
        self.first = np.full(slots, _NEVER, dtype=np.uint8)
        self.last = np.zeros(slots, dtype=np.uint8)

    def add(self, slots: np.ndarray, step: int) -> None:
        self.first[slots] = np.minimum(self.first[slots], step)
        self.last[slots] = step

    def known(self, hashes: np.ndarray) -> np.ndarray:
        return self.first[hashes & self.mask] != _NEVER

    def latest(self, hashes: np.ndarray) -> np.ndarray:
        """The last step in which some phrase of the slot reached the threshold; asked of known phrases only."""
        return self.last[hashes & self.mask].astype(np.int64)


def _active(words: np.ndarray, held: Reached, longest: int):
    """(k, places, hashes, parts) of phrases of 2 words and more whose two shorter parts have reached the threshold."""
    places, hashes = np.flatnonzero(words), words[words != 0]
    for k in range(2, longest + 1):
        known = held.known(hashes)
        places, hashes = places[known], hashes[known]
        # a phrase's two parts begin at neighbouring places
        pair = np.flatnonzero(places[1:] == places[:-1] + 1)
        if not len(pair):
            return
        places, left, right = places[pair], hashes[pair], hashes[pair + 1]
        hashes = _grown(left, words[places + k - 1])
        yield k, places, hashes, left, right


def _planes(values: np.ndarray) -> bytes:
    """The first bytes of all values, then their second ones, ..., compressed: what is mostly zero then takes no room."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8).T.tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _values(planes: bytes, kind) -> np.ndarray:
    size = int.from_bytes(planes[:8], "little")
    plain = pa.decompress(planes[8:], decompressed_size=size, codec="zstd") if size else b""
    return np.ascontiguousarray(np.frombuffer(plain, dtype=np.uint8).reshape(8, -1).T).view(kind).ravel()


def _packed(hashes: np.ndarray) -> bytes:
    """Sorted hashes by their differences."""
    return _planes(np.diff(hashes, prepend=np.uint64(0)))


def _unpacked(planes: bytes) -> np.ndarray:
    return np.cumsum(_values(planes, np.uint64), dtype=np.uint64)


def _summed(hashes: list[np.ndarray], ends: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each hash once and in order, with the last end and the sum."""
    h, e, k = np.concatenate(hashes), np.concatenate(ends), np.concatenate(n)
    order = np.argsort(h, kind="stable")
    h, e, k = h[order], e[order], k[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, dtype=np.int64)
    return h[first], np.maximum.reduceat(e, first) if len(h) else e, np.add.reduceat(k, first) if len(h) else k


def _dealt(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Where each part begins in sorted hashes, and the end; a part is a range of hashes."""
    edges = [(p << 64) // parts for p in range(1, parts)]
    return np.concatenate([[0], np.searchsorted(hashes, np.array(edges, dtype=np.uint64)), [len(hashes)]]).astype(np.int64)


def _counted(held, step: int, shards: int, longest: int, parts: int):
    """(tokens) -> (part, h, e, n): occurrences of the phrases that are in their cycle, which ends not before step e. A
    task tells each part's phrases in one row, or in several if it meets very many."""

    def flush(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        h, e, n = _summed(*zip(*found, strict=True))
        at = _dealt(h, parts)
        rows = [(p, slice(at[p], at[p + 1])) for p in range(parts) if at[p + 1] > at[p]]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([p for p, _ in rows], pa.int32()),
                pa.array([_packed(h[x]) for _, x in rows], pa.binary()),
                pa.array([e[x].tobytes() for _, x in rows], pa.binary()),
                pa.array([_planes(n[x]) for _, x in rows], pa.binary()),
            ],
            ["part", "h", "e", "n"],
        )

    def blocks(batches):
        """Tokens of several texts, with a 0 at the end so that no phrase leaves its text."""
        parts, size = [], 0
        for b in batches:
            column = b.column("tokens")
            values, offsets = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.asarray(column.offsets)
            offsets = offsets - offsets[0]
            at = 0
            while at < len(column):
                until = max(at + 1, int(np.searchsorted(offsets, offsets[at] + _WORDS_TOGETHER, side="right")) - 1)
                parts.append(values[offsets[at] : offsets[until]])
                size, at = size + len(parts[-1]), until
                if size >= _WORDS_TOGETHER:
                    yield np.concatenate([*parts, np.zeros(1, dtype=np.uint64)])
                    parts, size = [], 0
        if parts:
            yield np.concatenate([*parts, np.zeros(1, dtype=np.uint64)])

    def run(batches):
        tables = held.value if held is not None else None
        found, size = [], 0
        for words in blocks(batches):
            met = []
            if step < shards:
                single = words[words != 0]
                met.append((single, np.full(len(single), shards - 1)))
            if tables is not None:
                for _, _, hashes, left, right in _active(words, tables, longest):
                    end = np.maximum(tables.latest(left), tables.latest(right)) + shards
                    met.append((hashes[end >= step], end[end >= step]))
            for hashes, ends in met:
                found.append(_summed([hashes], [ends.astype(np.uint8)], [np.ones(len(hashes), dtype=np.int64)]))
                size += len(found[-1][0])
            if size > _FOUND:
                found = [_summed(*zip(*found, strict=True))]
                size = len(found[0][0])
                if size > _FOUND // 2:
                    yield from flush(found)
                    found, size = [], 0
        if size:
            yield from flush(found)

    return run


_STATE = "part int, h binary, e binary, t binary, c binary"
_STATE_KINDS = pa.schema([("part", pa.int32()), ("h", pa.binary()), ("e", pa.binary()), ("t", pa.binary()), ("c", pa.binary())])


def _merged(step: int, shards: int, minimum: int):
    """A part's state and what the scan has counted of it, as the new state in one row.

    e: the last step in which the phrase's parts may still count it; t: the step in which it reached the minimum, or
    _NEVER; c: its count in each shard.
    """

    def run(state: pa.Table, found: pa.Table) -> pa.Table:
        h, e, n = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.uint8)], [np.zeros(0, dtype=np.int64)]
        for row in found.select(["h", "e", "n"]).to_pylist():
            h.append(_unpacked(row["h"]))
            e.append(np.frombuffer(row["e"], dtype=np.uint8))
            n.append(_values(row["n"], np.int64))
        new, ends, n = _summed(h, e, n)
        old, old_e, old_t, old_c = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint8), np.zeros(0, dtype=np.uint8), np.zeros((shards, 0), dtype=np.int64)
        for row in state.to_pylist():  # one at most
            old, old_e, old_t = _unpacked(row["h"]), np.frombuffer(row["e"], dtype=np.uint8), np.frombuffer(row["t"], dtype=np.uint8)
            old_c = _values(row["c"], np.int64).reshape(shards, -1)
        every = np.union1d(old, new)
        at_old, at_new = np.searchsorted(every, old), np.searchsorted(every, new)
        e, t, c = np.zeros(len(every), dtype=np.uint8), np.full(len(every), _NEVER, dtype=np.uint8), np.zeros((shards, len(every)), dtype=np.int64)
        e[at_old], t[at_old], c[:, at_old] = old_e, old_t, old_c
        e[at_new] = np.maximum(e[at_new], ends)
        # the shard just scanned: its count is the same in every scan, or not known yet
        c[step % shards, at_new] = np.maximum(c[step % shards, at_new], n)
        t[(t == _NEVER) & (c.sum(axis=0) >= minimum)] = step
        # a phrase that has not reached the minimum at the end of its cycle never will
        stay = (t != _NEVER) | (e > step)
        part = (state if state.num_rows else found).column("part")[0].as_py()
        rows = {"part": [part], "h": [_packed(every[stay])], "e": [e[stay].tobytes()], "t": [t[stay].tobytes()], "c": [_planes(c[:, stay].ravel())]}
        return pa.table({k: pa.array(v, _STATE_KINDS.field(k).type) for k, v in rows.items()})

    return run


def _reached_slots(step: int, slots: int):
    def run(batches):
        for batch in batches:
            for row in batch.select(["h", "t"]).to_pylist():
                h, t = _unpacked(row["h"]), np.frombuffer(row["t"], dtype=np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(h[t == step] & np.uint64(slots - 1)).astype(np.int32), pa.int32())], ["slot"])

    return run


def _reached_counts(shards: int):
    """A part's phrases that have reached the minimum, in one row."""

    def run(batches):
        for batch in batches:
            for row in batch.select(["part", "h", "t", "c"]).to_pylist():
                h, t = _unpacked(row["h"]), np.frombuffer(row["t"], dtype=np.uint8)
                a = _values(row["c"], np.int64).reshape(shards, -1).sum(axis=0)
                cols = [pa.array([row["part"]], pa.int32()), pa.array([_packed(h[t != _NEVER])], pa.binary()), pa.array([_planes(a[t != _NEVER])], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["part", "h", "a"])

    return run


def _count_rows(batches):
    """A row for each phrase and its count."""
    for batch in batches:
        for row in batch.select(["h", "a"]).to_pylist():
            yield pa.RecordBatch.from_arrays([pa.array(_unpacked(row["h"]).view(np.int64)), pa.array(_values(row["a"], np.int64))], ["h", "a"])


def count_phrases(tokens: list[DataFrame], words: int, minimum: int, longest: int = LONGEST, slots: int = 1 << 22) -> tuple[DataFrame, Reached]:
    """Exact counts (part, h, a) of all phrases of up to `longest` words with at least `minimum` occurrences, a part in a row.

    tokens: one table for each shard; words: how many they hold. The tables of reached phrases hold `slots` (a power of
    two) entries of two bytes whatever the input is; with more phrases than slots more is counted than need be, with the
    same result. The state lies in parts by ranges of hashes, whose number grows with the words, so that a part's phrases
    fit a task; what is shuffled are a part's hashes by their differences, not rows.
    """
    shards = len(tokens)
    spark = tokens[0].sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-words // _PART_WORDS), 1)
    held, step, latest = Reached(slots), 0, -1
    state = spark.createDataFrame([], _STATE)
    while step < shards or step <= latest + shards:
        shared = spark.sparkContext.broadcast(held) if step else None  # two bytes a slot
        scanned = tokens[step % shards].mapInArrow(_counted(shared, step, shards, longest, parts), "part int, h binary, e binary, n binary")
        merged = state.groupBy("part").cogroup(scanned.groupBy("part")).applyInArrow(_merged(step, shards, minimum), _STATE)
        kept = save(merged, "phrases")
        if step:
            drop(state)
        state = kept
        release(spark)
        new = state.mapInArrow(_reached_slots(step, slots), "slot int").distinct().toArrow()  # at most `slots` rows
        if new.num_rows:
            held.add(new.column("slot").to_numpy(), step)
            latest = step
        if shared is not None:
            shared.destroy()
        step += 1
    reached = save(state.mapInArrow(_reached_counts(shards), "part int, h binary, a binary"), "counted")
    drop(state)
    return reached, held


_TOLD = pa.schema([("part", pa.int32()), ("lang", pa.string()), ("told", pa.binary())])


def _spelled(held, longest: int, parts: int):
    """(lang, text) -> (part, lang, told): each known phrase once a task, those of a part and language in one piece. Only
    the words are sent, in order, since hashes follow from them and hardly compress."""

    def flush(found: list[pa.RecordBatch]):
        if not found:
            return
        rows = pa.Table.from_batches(found).sort_by([("part", "ascending"), ("lang", "ascending"), ("phrase", "ascending")])
        of, langs, phrases = rows.column("part").to_pylist(), rows.column("lang").to_pylist(), rows.column("phrase").to_pylist()
        cuts = [0, *(i for i in range(1, len(of)) if of[i] != of[i - 1] or langs[i] != langs[i - 1]), len(of)]
        told = [_line(phrases[x:y]) for x, y in zip(cuts, cuts[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([pa.array([c[x] for x in cuts[:-1]], t) for c, t in zip((of, langs), _TOLD.types, strict=False)] + [pa.array(told, pa.binary())], schema=_TOLD)

    def run(batches):
        tables = held.value
        told, found, size = np.zeros(0, dtype=np.uint64), [], 0
        for (langs,), texts in _groups(batches, ("lang",)):
            joined, starts, ends, words, new, firsts = _words(texts, langs)
            if not len(words):
                continue
            at = np.arange(len(words)) + np.cumsum(new)
            spread = np.zeros(at[-1] + 2, dtype=np.uint64)
            spread[at] = words
            word_at = np.zeros(len(spread), dtype=np.int64)
            word_at[at] = np.arange(len(words))
            for k, places, hashes, _, _ in _active(spread, tables, longest):
                known = tables.known(hashes)
                unique, one = np.unique(hashes[known], return_index=True)
                near = np.minimum(np.searchsorted(told, unique), max(len(told) - 1, 0))
                fresh = told[near] != unique if len(told) else np.ones(len(unique), dtype=bool)
                unique, one = unique[fresh], one[fresh]
                if not len(unique):
                    continue
                first = word_at[places[known][one]]
                told = np.sort(np.concatenate([told, unique]), kind="stable")
                text_of = np.searchsorted(firsts, first, side="right") - 1
                part_of = np.repeat(np.arange(parts), np.diff(_dealt(unique, parts)))
                phrases = [b" ".join(joined[starts[f + j] : ends[f + j]] for j in range(k)) for f in first.tolist()]
                found.append(pa.RecordBatch.from_arrays([pa.array(part_of, pa.int32()), pa.array([langs[i] for i in text_of.tolist()], pa.string()), pa.array(phrases, pa.binary())], ["part", "lang", "phrase"]))
                size += len(unique)
            if size > _FOUND // 16:
                yield from flush(found)
                found, size = [], 0
            if len(told) > _FOUND:  # what the task forgets it tells again
                told = np.zeros(0, dtype=np.uint64)
        yield from flush(found)

    return run


def _line(phrases: list[bytes]) -> bytes:
    """Phrases, which hold no line breaks, as compressed lines."""
    data = b"\n".join(phrases)
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _lines(told: bytes) -> list[bytes]:
    return pa.decompress(told[8:], decompressed_size=int.from_bytes(told[:8], "little"), codec="zstd", asbytes=True).split(b"\n")


_CANDIDATE = pa.schema(
    [("h", pa.int64()), ("lang", pa.string()), ("phrase", pa.string()), ("k", pa.int32()), ("a", pa.int64()), ("firsts", pa.list_(pa.int64())), ("rests", pa.list_(pa.int64()))]
)


def _candidates(found: pa.Table, reached: pa.Table) -> pa.Table:
    """Of what tasks have told of a part, each phrase that has reached the minimum once, with its count and, for each cut,
    the hashes of its first words and of the rest. What only shares a slot with such a phrase goes here."""
    phrases, of = [], []
    for lang, told in zip(found.column("lang").to_pylist(), found.column("told").to_pylist(), strict=True):
        lines = _lines(told)
        phrases += lines
        of += [lang] * len(lines)
    once = list(dict.fromkeys(zip(of, phrases, strict=True)))
    if not once or not reached.num_rows:
        return _CANDIDATE.empty_table()
    of, phrases = [lang for lang, _ in once], [phrase for _, phrase in once]
    (row,) = reached.select(["h", "a"]).to_pylist()
    known, counts = _unpacked(row["h"]), _values(row["a"], np.int64)
    _, _, _, words, _, firsts = _words(phrases, of)
    k_of, out = np.diff(firsts), []
    langs, texts = pa.array(of, pa.string()), pa.array(phrases, pa.binary()).cast(pa.string())
    for k in np.unique(k_of).tolist():
        own = np.flatnonzero(k_of == k)
        inside = {}
        for i in range(k):
            for n in range(1, k - i + 1):
                word = words[firsts[own] + i + n - 1]
                inside[i, n] = word if n == 1 else _grown(inside[i, n - 1], word)
        at = np.minimum(np.searchsorted(known, inside[0, k]), max(len(known) - 1, 0))
        true = np.flatnonzero(known[at] == inside[0, k]) if len(known) else np.zeros(0, dtype=np.int64)

        def parts_of(places, true=true, k=k, inside=inside):
            flat = np.stack([inside[x][true] for x in places], axis=1)
            return pa.ListArray.from_arrays(pa.array(np.arange(len(true) + 1) * (k - 1), pa.int32()), pa.array(np.ascontiguousarray(flat).reshape(-1).view(np.int64)))

        rows = pa.array(own[true])
        cut = [parts_of([(0, j) for j in range(1, k)]), parts_of([(j, k - j) for j in range(1, k)])]
        columns = [pa.array(inside[0, k][true].view(np.int64)), langs.take(rows), texts.take(rows), pa.array(np.full(len(true), k), pa.int32()), pa.array(counts[at[true]]), *cut]
        out.append(pa.Table.from_arrays(columns, schema=_CANDIDATE))
    return pa.concat_tables(out)


def collocations(docs: DataFrame, minimum: int = 100, share: int = 100, best: int = 2000, shards: int = 3, longest: int = LONGEST, slots: int = 1 << 22) -> DataFrame:
    """The strongest phrases of each language: (lang, rank, phrase, a, l, r, n, score).

    A phrase of 2 to `longest` words with a >= `minimum` occurrences within pieces is a candidate; its score is that of
    its weakest cut, floor(1000 a n / (l r)), with the first of equal cuts. A candidate inside a longer one that has at
    least `share` percent of its occurrences goes. Of each language `best` remain, by score, a and phrase.

    Null text is empty, a null language is `und`. Repeated rows count as often as they occur. A text is one task's work,
    however long; an empty table gives no rows; columns other than text and lang are ignored, ids are not needed.
    Phrases are told apart by 64-bit hashes of language and words.
    """
    spark = docs.sparkSession
    given = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    path = f"{shared_dir(spark)}/tallyforge/tokens-{uuid.uuid4().hex}"
    given.mapInArrow(_tokens(shards), "shard int, lang string, words long, tokens array<long>").write.partitionBy("shard").parquet(path)
    scanned = spark.read.schema("lang string, words long, tokens array<long>, shard int").parquet(path)
    scanned.saved_at = path
    totals = save(scanned.groupBy("lang").agg(F.sum("words").alias("n")), "words")
    words = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    counts, held = count_phrases([scanned.where(F.col("shard") == j).select("tokens") for j in range(shards)], words, minimum, longest, slots)
    drop(scanned)
    shared = spark.sparkContext.broadcast(held)
    kinds = "h long, lang string, phrase string, k int, a long, firsts array<long>, rests array<long>"
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-words // _PART_WORDS), 1)
    spelled = given.mapInArrow(_spelled(shared, longest, parts), "part int, lang string, told binary")
    found = save(spelled.groupBy("part").cogroup(counts.groupBy("part")).applyInArrow(_candidates, kinds), "candidates")
    # a phrase between two others occurs as often as the longer one at least, so that those longer by one word tell all
    around = F.array(F.element_at("firsts", -1), F.element_at("rests", 1))
    inside = found.where("k > 2").select(F.explode(around).alias("h"), "a").groupBy("h").agg(F.max("a").alias("longer"))
    sizes = counts.select("h", "a").mapInArrow(_count_rows, "h long, a long")
    cut = F.posexplode(F.arrays_zip("firsts", "rests")).alias("cut", "x")
    cuts = found.select("h", "lang", "a", cut).select("h", "lang", "a", "cut", F.col("x.firsts").alias("first"), F.col("x.rests").alias("rest"))
    wide = "decimal(38,0)"
    scored = (
        cuts.join(sizes.select(F.col("h").alias("first"), F.col("a").alias("l")), "first")
        .join(sizes.select(F.col("h").alias("rest"), F.col("a").alias("r")), "rest")
        .join(totals, "lang")
        .withColumn("score", F.expr(f"(cast(1000 as {wide}) * cast(a as {wide}) * cast(n as {wide})) div (cast(l as {wide}) * cast(r as {wide}))"))
    )
    weakest = scored.groupBy("h").agg(F.min(F.struct("score", "cut", "l", "r", "n")).alias("x")).select("h", "x.*")
    free = weakest.join(found.select("h", "lang", "phrase", "a"), "h").join(inside, "h", "left").where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    return free.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best).select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 strongest phrases of each language of documents."""
    return collocations(table(spark, sf_dir, "documents"))


SQL = r"""
with texts as (
    select row_number() over () as d, coalesce(lang, 'und') as lang,
        regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') as p
    from documents
), pieces as (
    select lang, regexp_extract_all(unnest(p), '[^\x20\x09]+') as w from texts
), grams as (
    select lang, k, array_to_string(w[i:i + k - 1], ' ') as phrase, count(*) as a
    from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from pieces, range(1, 6) t(k) where len(w) >= k)
    group by all
), totals as (
    select lang, sum(a)::bigint as n from grams where k = 1 group by lang
), candidates as (
    select lang, k, phrase, a, string_split(phrase, ' ') as w from grams where k > 1 and a >= 100
), cuts as (
    select c.*, cut, array_to_string(w[1:cut], ' ') as x, array_to_string(w[cut + 1:k], ' ') as y
    from (select *, unnest(range(1, k)) as cut from candidates) c
), scored as (
    select c.lang, c.k, c.phrase, c.a, c.cut, f.a as l, g.a as r, t.n,
        (1000::hugeint * c.a * t.n) // (f.a::hugeint * g.a) as score
    from cuts c join grams f on f.lang = c.lang and f.phrase = c.x join grams g on g.lang = c.lang and g.phrase = c.y
        join totals t on t.lang = c.lang
), weakest as (
    select * from scored qualify row_number() over (partition by lang, phrase order by score, cut) = 1
), inside as (
    select lang, array_to_string(w[i:i + m - 1], ' ') as phrase, max(a) as longer
    from (select lang, w, a, m, unnest(range(1, k - m + 2)) as i from candidates, range(2, 5) t(m) where m < k)
    group by all
)
select lang, rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n, score::bigint as score
from (
    select w.*, row_number() over (partition by w.lang order by score desc, w.a desc, encode(w.phrase)) as rank
    from weakest w left join inside i on i.lang = w.lang and i.phrase = w.phrase
    where longer is null or longer < w.a
)
where rank <= 2000
"""
