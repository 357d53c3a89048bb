"""Operator 3, LM scoring: a probabilistic suffix tree over the bytes of a text.

A text is its words, each followed by a space, then one end symbol. Contexts are the last bytes, up to DEPTH. A
context stays in the tree if it occurs LEAST times and its next-symbol distribution diverges from that of its own
suffix by more than the description of its parameters costs. Distributions are smoothed down the tree; the state at
each symbol is the longest suffix in the tree. A word's probability is that of its symbols, mixed with that of the
word in a unigram model with the weight WORD_SHARE. What the unigram model leaves to words that training lacks is dealt
among them by their spelling in the tree, so that the probabilities of all words after a text sum to at most one.

Beside the score there is that of the unigram model alone; its counts cover all training tokens, and it gives each unknown
word all that is left to unknown words, which makes it higher than a probability where many words are unknown.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, fold, mix64, release, rolling, save, slices, table, text_bytes

DEPTH = 7
#: Shorter contexts all stay; longer ones need this many occurrences, whatever the size of the corpus.
SURE, LEAST = 3, 8
WORD_SHARE = 0.1
END = 0x0A
_PAD = bytes([END]) * DEPTH
_BYTES = 2 << 20
_BLOCK = 1 << 20


def symbols(text: bytes) -> bytes:
    words = text.lower().split()  # lower-cases A-Z
    return b" ".join(words) + b" \n" if words else b"\n"


def _blocks(streams: list[bytes]):
    """Slices of streams of about a MB, so that what is computed from one stays small."""
    begin, held = 0, 0
    for k, s in enumerate(streams):
        held += len(s)
        if held >= _BLOCK or k + 1 == len(streams):
            yield slice(begin, k + 1), held
            begin, held = k + 1, 0


def _codes(streams: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each symbol of the streams: the DEPTH bytes before it, the last one first, and itself, as one number, so that
    contexts that end alike are neighbours; and the stream's first place."""
    lengths = np.array([len(s) for s in streams], dtype=np.int64)
    out, at = np.empty(lengths.sum(), dtype=np.uint64), 0
    for own, size in _blocks(streams):
        buffer = b"".join(x for s in streams[own] for x in (_PAD, s))
        inside = np.arange(size) + np.repeat(np.arange(len(lengths[own])) * DEPTH, lengths[own])
        # eight bytes that end in the symbol, which is the highest one as they lie in memory
        code = np.ndarray((len(buffer) - DEPTH,), dtype="<u8", buffer=buffer, strides=(1,))[inside]
        out[at : at + size] = (code << np.uint64(8)) | (code >> np.uint64(56))
        at += size
    return out, np.cumsum(lengths) - lengths


def _context(codes: np.ndarray, k: int) -> np.ndarray:
    return codes >> np.uint64(64 - 8 * k) if k else np.zeros(len(codes), dtype=np.uint64)


def _pair(codes: np.ndarray, k: int) -> np.ndarray:
    return (_context(codes, k) << np.uint64(8)) | (codes & np.uint64(255))


def _up(pairs: np.ndarray) -> np.ndarray:
    """Pairs of context and symbol without the context's oldest byte."""
    return ((pairs >> np.uint64(16)) << np.uint64(8)) | (pairs & np.uint64(255))


def _firsts(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, dtype=np.int64)


def _counted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different values in order, and how often each is there."""
    x = np.sort(x)
    first = _firsts(x)
    return x[first], np.diff(np.append(first, len(x)))


def _summed(x: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different values in order, and the sums of their n."""
    order = np.argsort(x)
    x, n = x[order], n[order]
    first = _firsts(x)
    return x[first], np.add.reduceat(n, first) if len(first) else n


@dataclass
class SuffixTree:
    """For each depth: contexts with totals and numbers of different next symbols, and counts of context and next."""

    contexts: list[np.ndarray]
    totals: list[np.ndarray]
    kinds: list[np.ndarray]
    pairs: list[np.ndarray]
    counts: list[np.ndarray]

    def log10(self, codes: np.ndarray) -> np.ndarray:
        """log10 of the probability of each code's symbol after its context; codes are in order."""
        p = np.full(len(codes), 1 / 256)
        alive = np.arange(len(codes))
        for k, (contexts, totals, kinds, pairs, counts) in enumerate(zip(self.contexts, self.totals, self.kinds, self.pairs, self.counts, strict=True)):
            if not len(contexts):
                break
            own = _context(codes[alive], k)
            # codes are in order, so that equal contexts are neighbours; each is looked up once
            first = _firsts(own)
            times = np.diff(np.append(first, len(own)))
            c = np.minimum(np.searchsorted(contexts, own[first]), len(contexts) - 1)
            hit = np.repeat(contexts[c] == own[first], times)
            alive, c, own = alive[hit], np.repeat(c, times)[hit], own[hit]
            pair = (own << np.uint64(8)) | (codes[alive] & np.uint64(255))
            q = np.minimum(np.searchsorted(pairs, pair), len(pairs) - 1)
            n = np.where(pairs[q] == pair, counts[q], 0)
            # mass for symbols not seen here goes to the shorter context, in proportion to the kinds seen
            p[alive] = (n + kinds[c] * p[alive]) / (totals[c] + kinds[c])
        return np.log10(p)

    def score(self, streams: list[bytes]) -> np.ndarray:
        """log10 of the probability of each stream, by the tree alone."""
        codes, first = _codes(streams)
        found, at = np.unique(codes, return_inverse=True)
        return np.add.reduceat(self.log10(found)[at], first)


def _level(pairs: np.ndarray, counts: np.ndarray, ordered: bool = False) -> tuple[np.ndarray, ...]:
    """Contexts, totals, kinds, pairs and counts of one depth, of pairs that may repeat, or `ordered` are different and in order."""
    counts = counts.astype(np.float64)
    if not ordered:
        pairs, counts = _summed(pairs, counts)
    own = pairs >> np.uint64(8)
    first = _firsts(own)
    totals = np.add.reduceat(counts, first) if len(own) else counts
    return own[first], totals, np.diff(np.append(first, len(own))).astype(np.float64), pairs, counts


def grow(codes: np.ndarray, counts: np.ndarray, low: SuffixTree | None = None) -> SuffixTree:
    """The tree of codes, which are different and in order; given the whole depths below SURE as `low`, codes need only be all those of some contexts of
    SURE bytes, since deeper contexts are tested against their own suffixes alone."""
    levels = list(zip(low.contexts, low.totals, low.kinds, low.pairs, low.counts, strict=True)) if low else []
    start, deep = len(levels), {}
    pairs, n = _pair(codes, DEPTH), counts
    for k in range(DEPTH, start - 1, -1):
        deep[k] = _level(pairs, n, ordered=k == DEPTH)
        pairs, n = _up(deep[k][3]), deep[k][4]
    levels += [deep[k] for k in range(start, DEPTH + 1)]
    longer = np.zeros(0, dtype=np.uint64)
    for k in range(DEPTH, max(start, SURE) - 1, -1):
        contexts, totals, kinds, pairs, n = levels[k]
        up_contexts, up_totals, _, up_pairs, up_n = levels[k - 1]
        own = np.repeat(np.arange(len(contexts)), kinds.astype(np.int64))
        up_pair = _up(pairs)
        above = up_n[np.searchsorted(up_pairs, up_pair)] / up_totals[np.searchsorted(up_contexts, up_pair >> np.uint64(8))]
        gain = np.bincount(own, weights=n * np.log(n / totals[own] / above), minlength=len(contexts))
        stays = (totals >= LEAST) & (gain > 0.5 * kinds * np.log(totals))
        stays |= np.isin(contexts, longer >> np.uint64(8))  # all suffixes of a context that stays, stay
        longer = contexts[stays]
        levels[k] = (longer, totals[stays], kinds[stays], pairs[stays[own]], n[stays[own]])
    return SuffixTree(*(list(x) for x in zip(*levels, strict=True)))


def grow_tree(texts: DataFrame) -> SuffixTree:
    """The tree of a table of texts (text) that one machine can hold, to look at; score_texts() grows the same one in
    parts. Null texts are empty; without any row the tree is empty and symbols are equally likely."""
    streams = [symbols(t) for t in text_bytes(texts.select("text").toArrow().column("text"))]
    return grow(*_counted(_codes(streams)[0])) if streams else grow(np.zeros(0, dtype=np.uint64), np.zeros(0))


def _packed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _unpacked(packed: bytes) -> bytes:
    return pa.decompress(packed[8:], decompressed_size=int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True)


def _planes(x: np.ndarray) -> bytes:
    """Numbers byte by byte: all first bytes, then all second ones; such data compress well."""
    return _packed(x.view(np.uint8).reshape(-1, x.dtype.itemsize).T.tobytes())


def _numbers(packed: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(_unpacked(packed), dtype=np.uint8).reshape(size, -1).T).view(kind).reshape(-1)


def mix(tree: np.ndarray, base: np.ndarray, known: np.ndarray, share: float) -> np.ndarray:
    """log10 of the probabilities of words, from those of their symbols and, with this share, those of the unigram model."""
    word = base + np.where(known, 0.0, tree)
    high = np.maximum(tree, word)
    return high + np.log10((1 - share) * 10 ** (tree - high) + share * 10 ** (word - high))


_UNIT = pa.schema([("unit", pa.int64()), ("rids", pa.binary()), ("trains", pa.binary()), ("streams", pa.binary()), ("symbols", pa.int64())])
_DEALT = pa.schema([("bucket", pa.int32()), ("unit", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
_PART = "bucket int, unit long, keys binary, counts binary"
_MODEL = -1


def _units(rows: DataFrame) -> DataFrame:
    """Rows of a few MB of symbols each, with their number."""

    def scan(batches):
        base, made = TaskContext.get().partitionId() << 32, 0
        rids, trains, streams, held = [], [], [], 0

        def unit():
            lengths = np.array([len(s) for s in streams], dtype=np.int64).tobytes()
            data = len(streams).to_bytes(8, "little") + lengths + b"".join(streams)
            row = [base + made, np.array(rids, dtype=np.int64).tobytes(), np.array(trains, dtype=np.int8).tobytes(), _packed(data), sum(map(len, streams))]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, _UNIT.types, strict=True)], schema=_UNIT)

        for batch in slices(batches):
            for rid, train, text in zip(batch.column("rid").to_pylist(), batch.column("train").to_pylist(), text_bytes(batch.column("text")), strict=True):
                rids.append(rid)
                trains.append(train)
                streams.append(symbols(text))
                held += len(streams[-1])
                if held >= _BYTES:
                    yield unit()
                    made, rids, trains, streams, held = made + 1, [], [], [], 0
        if rids:
            yield unit()

    return rows.select("rid", "train", "text").mapInArrow(scan, "unit long, rids binary, trains binary, streams binary, symbols long")


def _rows(batches, *names: str):
    """Values of one row at a time: a row holds MBs, a batch many rows."""
    for batch in batches:
        cols = [batch.column(c) for c in names]
        for k in range(batch.num_rows):
            yield tuple(c[k].as_py() for c in cols)


def _opened(packed: bytes) -> list[bytes]:
    data = _unpacked(packed)
    n = int.from_bytes(data[:8], "little")
    ends = 8 + 8 * n + np.cumsum(np.frombuffer(data, dtype=np.int64, count=n, offset=8))
    return [data[s:e] for s, e in zip([8 + 8 * n, *ends[:-1].tolist()], ends.tolist(), strict=True)]


def _trained(trains: bytes, streams: list[bytes]) -> list[bytes]:
    return [s for s, t in zip(streams, np.frombuffer(trains, dtype=np.int8).tolist(), strict=True) if t]


def _different(streams: list[bytes]) -> np.ndarray:
    return _counted(_codes(streams)[0])[0]


_END_WORD = np.uint64(0x656E64)


def _words(streams: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all words, the ends included: hashes and first symbols; and the first word of each stream."""
    roll, hashes, starts, first, at, words = rolling(), [], [], [], 0, 0
    for own, size in _blocks(streams):
        buffer = np.frombuffer(b"".join(streams[own]), dtype=np.uint8)
        ends = np.flatnonzero((buffer == 0x20) | (buffer == END))
        begins = np.append(0, ends[:-1] + 1)
        h = mix64(roll.of(roll.prefix(buffer), begins, ends - begins) + (ends - begins).astype(np.uint64))
        h[buffer[ends] == END] = _END_WORD
        before = np.cumsum([0, *(len(s) for s in streams[own][:-1])])
        first.append(np.searchsorted(begins, before) + words)
        hashes.append(h)
        starts.append(begins + at)
        at, words = at + size, words + len(ends)
    return np.concatenate(hashes), np.concatenate(starts), np.concatenate(first)


def _parts(unit: int, keys: np.ndarray, counts: np.ndarray | None, edges: np.ndarray):
    """Rows of a unit's keys, which are in order, cut at the edges of the buckets."""
    cuts = np.append(np.searchsorted(keys, edges), len(keys)).tolist()
    for at in range(0, len(edges), 64):
        own = [b for b in range(at, min(at + 64, len(edges))) if cuts[b + 1] > cuts[b]]
        if own:
            rows = [(b, unit, _planes(keys[cuts[b] : cuts[b + 1]]), None if counts is None else _planes(counts[cuts[b] : cuts[b + 1]])) for b in own]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _DEALT.types, strict=True)], schema=_DEALT)


def _word_counts(units: DataFrame, buckets: int) -> DataFrame:
    """(unit, bucket, counts): training counts of the unit's different words of that hash range; and unit -1 with (V, N)."""
    edges = np.array([(b << 64) // buckets for b in range(buckets)], dtype=np.uint64)

    def deal(batches):
        for unit, trains, packed in _rows(batches, "unit", "trains", "streams"):
            streams = _opened(packed)
            words = _counted(_words(streams)[0])[0]
            counts = np.zeros(len(words), dtype=np.int32)
            if own := _trained(trains, streams):
                found, n = _counted(_words(own)[0])
                counts[np.searchsorted(words, found)] = n
            yield from _parts(unit, words, counts, edges)

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        words = [_numbers(x, "u8") for x in pdf["keys"]]
        found, n = _summed(np.concatenate(words), np.concatenate([_numbers(x, "i4") for x in pdf["counts"]]).astype(np.int64))
        about = np.array([(n > 0).sum(), n.sum()], dtype=np.int64)
        replies = [_planes(n[np.searchsorted(found, w)]) for w in words]
        return pd.DataFrame({"unit": [*pdf["unit"], _MODEL], "bucket": int(pdf["bucket"].iloc[0]), "counts": [*replies, about.tobytes()]})

    return units.select("unit", "trains", "streams").mapInArrow(deal, _PART).groupBy("bucket").applyInPandas(total, "unit long, bucket int, counts binary")


def _short_contexts(units: DataFrame) -> tuple[SuffixTree, np.ndarray, np.ndarray]:
    """The depths below SURE, by training counts; and contexts of SURE bytes with their numbers. Both have at most 2^24
    rows, whatever the size of the corpus."""

    def count(batches):
        for trains, packed in _rows(batches, "trains", "streams"):
            streams = _opened(packed)
            codes, _ = _codes(streams)
            found = [(False, *_counted(_context(codes, SURE).astype(np.uint32)))]
            own = codes[np.repeat(np.frombuffer(trains, dtype=np.int8) > 0, [len(s) for s in streams])]
            if len(own):
                found.append((True, *_counted(_pair(own, SURE - 1).astype(np.uint32))))
            for low, key, n in found:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), low)), pa.array(key.astype(np.int64)), pa.array(n)], names=["low", "key", "n"])

    table_ = units.select("trains", "streams").mapInArrow(count, "low boolean, key long, n long").groupBy("low", "key").agg(F.sum("n").alias("n")).toArrow()
    is_low, key, n = (np.asarray(table_.column(c).to_numpy(zero_copy_only=False), dtype=t) for c, t in (("low", bool), ("key", np.int64), ("n", np.int64)))
    pairs, counts, levels = key[is_low].astype(np.uint64), n[is_low], []
    for _ in range(SURE):
        levels.insert(0, _level(pairs, counts))
        pairs, counts = _up(levels[0][3]), levels[0][4]
    key, n = key[~is_low], n[~is_low]
    order = np.argsort(key)
    return SuffixTree(*(list(x) for x in zip(*levels, strict=True))), key[order], n[order]


def score_rows(rows: DataFrame, symbols_at_once: int = 3_000_000, words_at_once: int = 1_000_000, rounds: int = 5) -> DataFrame:
    """(rid, n_tokens, n_known, train_tokens, base_score, score) of rows (rid, train, text), one for each different rid.

    Contexts that end alike meet in one task, with their training counts, so that each task grows its own part of the
    tree; the parts are saved. Then the units' codes are dealt to the parts and answered, a part of the units in each
    round, so that no more than that lies on disk. Only contexts below SURE bytes and the cuts between buckets go to
    all tasks, which is at most 2^24 rows of each.
    """
    spark = rows.sparkSession
    units = save(_units(rows), "symbol-units")
    total = units.agg(F.sum("symbols")).first()[0] or 0
    low, contexts, n = _short_contexts(units)
    buckets = max(1, int(-(-total // symbols_at_once)))
    # each bucket has about as many symbols; the first starts at 0
    cuts = np.searchsorted(np.cumsum(n), np.arange(1, buckets) * n.sum() / buckets) if len(n) else np.zeros(0, dtype=np.int64)
    edges = np.unique(np.append(0, contexts[np.minimum(cuts, max(len(contexts) - 1, 0))])).astype(np.uint64) << np.uint64(64 - 8 * SURE)
    shared = spark.sparkContext.broadcast((low, edges))

    words = save(_word_counts(units, max(1, int(-(-total // (8 * words_at_once))))), "word-counts")
    about = [np.frombuffer(r[0], dtype=np.int64) for r in words.where(F.col("unit") == _MODEL).select("counts").collect()]  # two numbers of each bucket
    distinct, tokens = (int(sum(a[k] for a in about)) for k in (0, 1))
    release(spark)

    def deal_counts(batches):
        for unit, trains, packed in _rows(batches, "unit", "trains", "streams"):
            if own := _trained(trains, _opened(packed)):
                codes, counts = _counted(_codes(own)[0])
                yield from _parts(unit, codes, counts.astype(np.int32), shared.value[1])

    def grow_part(pdf: pd.DataFrame) -> pd.DataFrame:
        codes, counts = _summed(np.concatenate([_numbers(x, "u8") for x in pdf["keys"]]), np.concatenate([_numbers(x, "i4") for x in pdf["counts"]]).astype(np.int64))
        tree = grow(codes, counts, shared.value[0])
        out = []
        for k in range(SURE, DEPTH + 1):
            out.append((int(pdf["bucket"].iloc[0]), _MODEL - k, _planes(tree.pairs[k]), _planes(tree.counts[k].astype(np.int64))))
        return pd.DataFrame(out, columns=_DEALT.names)

    def deal_codes(batches):
        for unit, packed in _rows(batches, "unit", "streams"):
            yield from _parts(unit, _different(_opened(packed)), None, shared.value[1])

    def ask(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = SuffixTree(*(list(x) for x in (lambda t: (t.contexts, t.totals, t.kinds, t.pairs, t.counts))(shared.value[0])))
        model = pdf[pdf["unit"] < 0].sort_values("unit", ascending=False)
        for pairs, counts in zip(model["keys"], model["counts"], strict=True):
            for have, new in zip((tree.contexts, tree.totals, tree.kinds, tree.pairs, tree.counts), _level(_numbers(pairs, "u8"), _numbers(counts, "i8"), ordered=True), strict=True):
                have.append(new)
        pdf = pdf[pdf["unit"] >= 0]
        asked = [_numbers(x, "u8") for x in pdf["keys"]]
        if not asked:
            return pd.DataFrame({"unit": [], "bucket": [], "p": []})
        codes = _counted(np.concatenate(asked))[0]
        p = tree.log10(codes).astype(np.float32)
        return pd.DataFrame({"unit": pdf["unit"], "bucket": pdf["bucket"], "p": [_planes(p[np.searchsorted(codes, x)]) for x in asked]})

    scores_schema = pa.schema([("rid", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def finish(batches):
        for rids, packed, parts, counts in _rows(batches, "rids", "streams", "parts", "words"):
            streams = _opened(packed)
            hashes, starts, first = _words(streams)
            c = np.concatenate([_numbers(x["counts"], "i8") for x in counts])[np.searchsorted(_counted(hashes)[0], hashes)]
            codes = _codes(streams)[0]
            order = np.argsort(codes)
            first_of = _firsts(codes[order])
            p = np.concatenate([_numbers(x["p"], "f4") for x in parts])
            by_symbol = np.empty(len(codes), dtype=np.float64)
            by_symbol[order] = np.repeat(p, np.diff(np.append(first_of, len(codes))))
            tree = np.add.reduceat(by_symbol, starts)
            base = np.log10((c + 0.5) / (tokens + 0.5 * (distinct + 1)))
            mixed = mix(tree, base, c > 0, WORD_SHARE)
            per = lambda x: np.add.reduceat(x, first)
            cols = (np.frombuffer(rids, dtype=np.int64), np.diff(np.append(first, len(c))), per((c > 0).astype(np.int64)), np.full(len(first), tokens), per(base), per(mixed))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, scores_schema.types, strict=True)], schema=scores_schema)

    counted = units.select("unit", "trains", "streams").mapInArrow(deal_counts, _PART)
    model = save(counted.groupBy("bucket").applyInPandas(grow_part, _PART), "suffix-tree")
    del counted
    release(spark)
    replies = words.where(F.col("unit") >= 0).groupBy("unit").agg(F.sort_array(F.collect_list(F.struct("bucket", "counts"))).alias("words"))
    done = []
    for k in range(rounds):
        own = units.where(F.pmod(F.xxhash64("unit"), F.lit(rounds)) == k)
        asked = own.select("unit", "streams").mapInArrow(deal_codes, _PART).unionByName(model).groupBy("bucket").applyInPandas(ask, "unit long, bucket int, p binary")
        parts = asked.groupBy("unit").agg(F.sort_array(F.collect_list(F.struct("bucket", "p"))).alias("parts"))
        joined = own.select("unit", "rids", "streams").join(parts, "unit").join(replies, "unit").select("rids", "streams", "parts", "words")
        done.append(save(joined.mapInArrow(finish, "rid long, n_tokens long, n_known long, train_tokens long, base_score double, score double"), "scores"))
        del asked, parts, joined  # with them go their shuffle files
        release(spark)
    drop(units, model, words)
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.dropDuplicates(["rid"])


def score_texts(docs: DataFrame, held_out_fold: int = 1) -> DataFrame:
    """Scores of docs (doc_id, text), learned from the rows outside the held-out fold of their ids.

    Null text is empty, and an empty text is the end alone; equal rows get equal scores; a null id folds as empty
    text; an empty table gives no rows. Words part at space and U+0009 to U+000D.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("rid"),
        (fold(F.col("doc_id").cast("long")) != held_out_fold).alias("train"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    return rows.drop("text").join(score_rows(rows), "rid").select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suffix-tree and unigram scores of all documents."""
    return score_texts(table(spark, sf_dir, "documents"))
