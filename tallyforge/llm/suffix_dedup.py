"""Operator 9, removal of every byte inside a string of 200 bytes that also starts anywhere else.

Bytes that cannot repeat are left out before the suffixes are sorted, and equal stretches are taken once:

1. Each window of 200 bytes has one anchor, the smallest gram hash inside it. Neighbouring windows share anchors, so a
   text has about one for every 70 bytes. Equal windows have equal anchors at equal distances, wherever they stand.
2. Anchors meet by gram. The windows of one anchor form a segment. Equal segments repeat as a whole; a gram with one
   segment has no repeat.
3. Where segments around equal grams differ, one segment of each kind is cut out, and a distributed difference-cover
   algorithm (difference_cover.py) finds the windows that repeat among all of these.

All comparisons are of 64-bit hashes of bytes. Every step is a join, a sort by ranges or an aggregation.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, mix64, release, rolling, save, slices, table, text_bytes
from .difference_cover import WIDTH, repeated_windows

GRAM = 64
_STEP = 1 << 20
_MOST = 4 << 20
_POSITION = np.uint64((1 << 24) - 1)
_PIECE = 1 << 16


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of width values, from block-wise running minima."""
    n = len(x)
    pad = -n % width
    blocks = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, dtype=x.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def _segments(pieces: list[tuple[int, int, bytes]], width: int):
    """Arrays (row, key, seg, lo, hi) of the segments in pieces (row, offset in the text, bytes)."""
    roll = rolling()
    buffer = np.frombuffer(b"".join(p[2] for p in pieces), dtype=np.uint8)
    prefix = roll.prefix(buffer)
    grams = mix64(roll.all(prefix, GRAM))
    # high bits of the hash, then the position: the leftmost of equal ones wins
    packed = (grams & ~_POSITION) | np.arange(len(grams), dtype=np.uint64)
    anchor = (sliding_min(packed, width - GRAM + 1) & _POSITION).astype(np.int64)
    lengths = np.array([len(p[2]) for p in pieces])
    begins = np.cumsum(lengths) - lengths
    counts = lengths - width + 1
    piece = np.repeat(np.arange(len(pieces)), counts)
    window = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + begins[piece]
    own = anchor[window]
    new = np.ones(len(own), dtype=bool)
    new[1:] = (own[1:] != own[:-1]) | (piece[1:] != piece[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(own)) - 1
    lo, hi, at, piece = window[first], window[last], own[first], piece[first]
    shape = ((at - lo).astype(np.uint64) << np.uint64(32)) | (hi - lo).astype(np.uint64)
    seg = mix64(roll.of(prefix, lo, hi - lo + width) + mix64(shape))
    shift = np.array([p[1] for p in pieces])[piece] - begins[piece]
    return np.array([p[0] for p in pieces])[piece], grams[at].view(np.int64), seg.view(np.int64), lo + shift, hi + shift


def _pieces(texts: list[bytes], width: int):
    """Lists of pieces of a few MB; a longer text is cut so that each window lies in one piece."""
    held, size = [], 0
    for row, text in enumerate(texts):
        for at in range(0, len(text) - width + 1, _STEP):
            x = text[at : at + _STEP + width - 1]
            held.append((row, at, x))
            size += len(x)
            if size >= _MOST:
                yield held
                held, size = [], 0
    if held:
        yield held


_FOUND = pa.schema([("rid", pa.int64()), ("key", pa.int64()), ("seg", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("n", pa.int32())])


def find_segments(rows: DataFrame, width: int) -> DataFrame:
    """Segments of rows (rid, text): rid, key (gram), seg (content), lo and hi (first and last window) and n.

    Segments that a task meets n times within a few MB are one row. They repeat, so their spans are rows as well, with
    a null key, lo and hi: begin and end. A passage of very many texts is thus a few rows of each task.
    """

    def scan(batches):
        for batch in slices(batches):
            rids = batch.column("rid").to_numpy(zero_copy_only=False)
            for pieces in _pieces(text_bytes(batch.column("text")), width):
                row, key, seg, lo, hi = _segments(pieces, width)
                order = np.argsort(seg, kind="stable")
                begin = np.flatnonzero(np.append(True, seg[order][1:] != seg[order][:-1]))
                times = np.diff(np.append(begin, len(seg)))
                one = order[begin]
                again = np.flatnonzero(np.repeat(times, times)[np.argsort(order)] > 1)
                yield _record(_FOUND, rids[row[one]], key[one], seg[one], lo[one], hi[one], times)
                if len(again):
                    new = np.append(True, (np.diff(again) > 1) | (row[again][1:] != row[again][:-1]) | (lo[again][1:] > hi[again][:-1] + 1))
                    first = again[new]
                    last = again[np.append(np.flatnonzero(new)[1:], len(again)) - 1]
                    none = pa.nulls(len(first), pa.int64())
                    yield _record(_FOUND, rids[row[first]], none, none, lo[first], hi[last] + width, pa.nulls(len(first), pa.int32()))

    return rows.mapInArrow(scan, "rid long, key long, seg long, lo int, hi int, n int")


def _record(schema: pa.Schema, *cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(cols, schema.types, strict=True)], schema=schema)


def _cut_pieces(joined: DataFrame, width: int) -> DataFrame:
    """Pieces (rid, lo, n, begin, bytes) of (rid, text, wanted array<struct<lo,hi>>): the bytes of the wanted segments,
    joined where they touch, in parts of at most 64 KB. Places lo to lo + n are a piece's own."""
    schema = pa.schema([("rid", pa.int64()), ("lo", pa.int32()), ("n", pa.int32()), ("begin", pa.int32()), ("bytes", pa.binary())])

    def cut(batches):
        for batch in slices(batches):
            out = []
            for rid, text, wanted in zip(batch.column("rid").to_pylist(), text_bytes(batch.column("text")), batch.column("wanted").to_pylist(), strict=True):
                runs: list[list[int]] = []
                for lo, hi in sorted((w["lo"], w["hi"]) for w in wanted):
                    if runs and lo <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], hi + width)
                    else:
                        runs.append([lo, hi + width])
                for lo, end in runs:
                    for at in range(lo, end, _PIECE):
                        begin = max(at - 2, 0)
                        out.append((rid, at, min(_PIECE, end - at), begin, text[begin : min(at + _PIECE + width, end)]))
            for at in range(0, len(out), 1000):
                cols = zip(*out[at : at + 1000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types, strict=True)], schema=schema)

    return joined.mapInArrow(cut, "rid long, lo int, n int, begin int, bytes binary")


def repeated_spans(rows: DataFrame) -> DataFrame:
    """Spans (rid, s, e) of rows (rid, text) whose windows repeat; they may overlap."""
    spark, width = rows.sparkSession, WIDTH
    found = save(find_segments(rows, width), "segments")
    all_ = found.where("key is not null")
    grams = all_.groupBy("key").agg(F.sum("n").alias("c"), F.min("seg").alias("a"), F.max("seg").alias("b")).where("c > 1")
    grams = save(grams.select("key", (F.col("a") != F.col("b")).alias("mixed")), "grams-met")
    release(spark)
    met = save(all_.join(grams, "key"), "segments-met")
    release(spark)
    kinds = save(
        met.groupBy("key", "seg").agg(F.sum("n").alias("n"), F.first("mixed").alias("mixed"), F.min(F.struct("rid", "lo", "hi")).alias("one")), "segment-kinds"
    )
    whole = met.where("n = 1").join(kinds.where("n > 1").select("key", "seg"), ["key", "seg"], "left_semi").select("rid", F.col("lo").alias("s"), (F.col("hi") + width).alias("e"))
    whole = whole.unionByName(found.where("key is null").select("rid", F.col("lo").alias("s"), F.col("hi").alias("e")))
    wanted = kinds.where("mixed").groupBy("one.rid").agg(F.collect_list(F.struct("one.lo", "one.hi")).alias("wanted"))
    # equal rows have one id; their windows repeat as wholes, so one of them is enough here
    pieces = save(_cut_pieces(rows.join(wanted, "rid"), width).dropDuplicates(["rid", "lo"]), "pieces")
    whole = save(whole, "whole-segments")
    drop(found, grams, met, kinds)
    release(spark)
    windows = repeated_windows(pieces)
    drop(pieces)
    return whole.unionByName(windows)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", as_text: bool = False) -> DataFrame:
    """Removes from each text the bytes of all strings of 200 bytes that also start anywhere else.

    Returns the columns of docs (but the text) and n_bytes, n_removed, n_spans (maximal removed runs)
    and kept: the remaining bytes, or with as_text the text they spell, less characters cut in two. Strings are judged on the input, within and across documents, and
    never across a document's end. Null text is empty; texts under 200 bytes stay; equal rows count
    as two places, so both lose what they share; ids may repeat or be null; an empty table gives no rows.
    Other columns stay, whatever their names; only those named as the four results are replaced by them.
    """
    results = ["n_bytes", "n_removed", "n_spans", "kept"]
    names = [c for c in docs.columns if c != text_col and c not in results]
    rest = F.struct(*[F.col(f"`{c}`") for c in names]) if names else F.struct(F.lit(0).alias("_"))
    rows = docs.select(rest.alias("rest"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.col(id_col).cast("string").alias("id"))
    rows = rows.select("rest", "text", F.xxhash64("id", "text").alias("rid"))
    spans = repeated_spans(rows.select("rid", "text"))
    of_row = spans.groupBy("rid").agg(F.sort_array(F.collect_set(F.struct("s", "e"))).alias("spans"))
    joined = rows.join(of_row, "rid", "left").select("rest", "text", "spans")
    out_schema = joined.select("rest").schema.add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept", "string" if as_text else "binary")

    def apply(batches):
        for batch in slices(batches):
            removed, runs, kept, sizes = [], [], [], []
            for text, spans_ in zip(text_bytes(batch.column("text")), batch.column("spans").to_pylist(), strict=True):
                parts, at, k, end = [], 0, 0, -1
                for span in spans_ or ():
                    s, e = span["s"], span["e"]
                    if s > end:
                        parts.append(text[at:s])
                        k += 1
                    end = at = max(end, e)
                parts.append(text[at:])
                x = b"".join(parts)
                kept.append(x.decode("utf-8", "ignore") if as_text else x)
                runs.append(k)
                sizes.append(len(text))
                removed.append(len(text) - len(x))
            cols = [batch.column("rest"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.string() if as_text else pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["rest", *results])

    return joined.mapInArrow(apply, out_schema).select(*[F.col(f"rest.`{c}`").alias(c) for c in names], *results)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the bytes of 200-byte strings that are found elsewhere."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
