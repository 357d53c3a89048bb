"""Operator 2, packing: vector bin packing by the dot-product heuristic.

Limits hold at once for tokens, segments and loss-bearing tokens. Bins are filled one after the
other: of the sizes that still fit, the bin takes the one whose demand has the largest dot product
with what the bin has left (both as shares of the limits).
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import save, slices, table, text_bytes

END_ID = 2
ID_BYTES = 4
#: Byte-level vocabularies write bytes that are no visible characters as those from U+0100 on, in order.
_BYTE_CHARS = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}
_MARKS = b"!\"#$%&()*+,-./:;<=>?@[]^_`{|}~"


@dataclass(frozen=True)
class Limits:
    """What one sequence holds at most."""

    tokens: int = 4096
    segments: int = 256
    loss: int = 4096

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.segments, self.loss], dtype=np.float64)


class _Pool:
    """Waiting items by demand, in columns that grow by doubling."""

    def __init__(self, cap: np.ndarray):
        self.cap, self.n, self.total = cap, 0, 0
        self.kinds: dict[tuple, int] = {}
        self.waiting: list[list] = []
        self.left = np.zeros(64, dtype=np.int64)
        self.demand = np.zeros((3, 64))
        self.share = np.zeros((3, 64))

    def put(self, demand: tuple, item: tuple) -> None:
        k = self.kinds.get(demand)
        if k is None:
            if self.n == len(self.left):
                self.left = np.concatenate([self.left, np.zeros_like(self.left)])
                self.demand = np.concatenate([self.demand, np.zeros_like(self.demand)], axis=1)
                self.share = np.concatenate([self.share, np.zeros_like(self.share)], axis=1)
            k = self.kinds[demand] = self.n
            self.demand[:, k] = demand
            self.share[:, k] = demand / self.cap / self.cap
            self.waiting.append([])
            self.n += 1
        self.waiting[k].append(item)
        self.left[k] += 1
        self.total += 1

    def take(self, k: int) -> tuple:
        self.left[k] -= 1
        self.total -= 1
        return self.waiting[k].pop()

    def best(self, room: np.ndarray) -> int:
        """The kind that fits with the largest dot product of demand and room; -1 if none fits."""
        n = self.n
        tokens, segments, loss = self.demand[:, :n]
        fits = np.flatnonzero((self.left[:n] > 0) & (tokens <= room[0]) & (segments <= room[1]) & (loss <= room[2]))
        return int(fits[(room @ self.share[:, fits]).argmax()]) if len(fits) else -1

    def longest(self) -> int:
        return int(np.where(self.left[: self.n] > 0, self.demand[0, : self.n], -1.0).argmax())


def fill_bins(demands: np.ndarray, limits: Limits, cut=None):
    """Yields bins as lists of (item, start, length of the cut or None).

    demands: rows of (tokens, segments, loss). Items beyond the limits must have been cut before.
    cut: a function (tokens of a piece) -> its demand; given it, an item that does not fit whole is cut
    to fill the bin, and its rest waits for the next bins. Equal demands are taken last in, first out.
    """
    cap = limits.vector()
    pool = _Pool(cap)
    for i, d in enumerate(demands.tolist()):
        pool.put(tuple(d), (i, 0))
    while pool.total:
        room, members = cap.copy(), []
        while pool.total:
            k = pool.best(room)
            if k >= 0:
                members.append((*pool.take(k), None))
                room -= pool.demand[:, k]
                continue
            if cut is None or room[0] < 1 or room[1] < 1:
                break
            k = pool.longest()
            whole = int(pool.demand[0, k])
            head = int(min(room[0], whole - 1))
            need = np.array(cut(head), dtype=np.float64)
            if head < 1 or (need > room).any():
                break
            item, start = pool.take(k)
            members.append((item, start, head))
            room -= need
            pool.put(tuple(float(x) for x in cut(whole - head)), (item, start + head))
        yield members


def piece_demand(tokens: int) -> tuple[int, int, int]:
    """A piece of a plain document: one segment, and loss on all tokens but its first."""
    return tokens, 1, tokens - 1


class WordIds(dict):
    """Ids of words as bytes. The tokenizer drops white space and never merges across it, so that a
    text's ids are those of its words in order; words seen before come from a bounded table. Added tokens are
    matched before words are parted: texts that may hold one are encoded whole, as they are."""

    def __init__(self, file: str, most: int = 800_000):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        super().__init__()
        self.tokenizer, self.most = Tokenizer.from_file(file), most
        self.model = self.tokenizer.model
        # the marks that an added token begins with, which no normaliser changes; or all of it in lower case
        added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = sorted({x[: len(x) - len(x.lstrip(_MARKS))] or x.lower() for x in added})

    def _learn(self, words: set[bytes]) -> None:
        # the tokenizer parts letters from marks: "thing." is "thing" and "."
        marked = {w: s for w in words if (s := w.rstrip(_MARKS)) and s != w and s.decode()[-1].isalpha()}
        plain = (words - marked.keys()) | ({x for w, s in marked.items() for x in (s, w[len(s) :])} - self.keys())
        hard = []
        for w in plain:
            text = w.decode()
            # what normalisers and pre-tokenizers leave as it is goes to the model directly
            if text.isalpha() and text == text.lower() and unicodedata.is_normalized("NFC", text):
                self[w] = np.array([t.id for t in self.model.tokenize(text if text.isascii() else w.decode("latin-1").translate(_BYTE_CHARS))], dtype="<u4").tobytes()
            else:
                hard.append(w)
        found = self.tokenizer.encode_batch_fast([w.decode() for w in hard], add_special_tokens=False)
        self.update((w, np.array(e.ids, dtype="<u4").tobytes()) for w, e in zip(hard, found, strict=True))
        self.update((w, self[s] + self[w[len(s) :]]) for w, s in marked.items())

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        if len(self) > self.most:
            self.clear()
        get = self.get
        lower = [t.lower() for t in texts]  # A-Z, as the tokenizer does
        split = [t.split() for t in lower]
        whole = [k for k, t in enumerate(lower) if any(x in t for x in self.added)]
        for k in whole:
            split[k] = []
        ids = [list(map(get, words)) for words in split]
        short = [k for k, x in enumerate(ids) if None in x]
        if short:
            self._learn({w for k in short for w, x in zip(split[k], ids[k], strict=True) if x is None})
            for k in short:
                ids[k] = map(get, split[k])
        out = [b"".join(x) for x in ids]
        found = self.tokenizer.encode_batch_fast([texts[k].decode() for k in whole], add_special_tokens=False)
        for k, e in zip(whole, found, strict=True):
            out[k] = np.array(e.ids, dtype="<u4").tobytes()
        return out


_word_ids: dict[str, WordIds] = {}

_FIRST = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
     ("sequence_id", pa.int64()), ("offset", pa.int64()), ("segments", pa.int64()), ("loss_tokens", pa.int64()), ("ids", pa.binary())]
)
_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, segments long, loss_tokens long, ids binary"


def _lay(pieces: list[tuple], sequence_id: int, keep_ids: bool) -> list[tuple]:
    """Rows of one sequence; pieces: (doc_id, start, ids, doc_tokens)."""
    out, at = [], 0
    for doc_id, start, ids, doc_tokens in pieces:
        n = len(ids) // ID_BYTES
        out.append((doc_id, start, n, zlib.crc32(ids), doc_tokens, sequence_id, at, 1, n - 1, ids if keep_ids else None))
        at += n
    return out


def _pack_pieces(pieces: list[tuple], limits: Limits) -> list[list[tuple]]:
    """Sequences of pieces; long pieces are first cut into whole sequences."""
    most = min(limits.tokens, limits.loss + 1)
    whole, rest = [], []
    for doc_id, start, ids, doc_tokens in pieces:
        n = len(ids) // ID_BYTES
        full = n // most
        whole += [[(doc_id, start + k * most, ids[k * most * ID_BYTES : (k + 1) * most * ID_BYTES], doc_tokens)] for k in range(full)]
        if n % most:
            rest.append((doc_id, start + full * most, ids[full * most * ID_BYTES :], doc_tokens))
    demands = np.array([piece_demand(len(p[2]) // ID_BYTES) for p in rest], dtype=np.float64).reshape(-1, 3)
    for members in fill_bins(demands, limits, cut=piece_demand):
        made = []
        for item, start, head in members:
            doc_id, at, ids, doc_tokens = rest[item]
            end = None if head is None else (start + head) * ID_BYTES
            made.append((doc_id, at + start, ids[start * ID_BYTES : end], doc_tokens))
        whole.append(made)
    return whole


def _filled(sequence: list[tuple], limits: Limits) -> bool:
    tokens = sum(len(p[2]) for p in sequence) // ID_BYTES
    return tokens >= limits.tokens or len(sequence) >= limits.segments or tokens - len(sequence) >= limits.loss


def pack_documents(docs: DataFrame, tokenizer_file: str, limits: Limits = Limits(), chunk_tokens: int = 4_000_000, end_id: int = END_ID) -> DataFrame:
    """Packs all docs (doc_id, text) into sequences within `limits`; documents are cut to fill them.

    One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, segments,
    loss_tokens. Each task tokenizes and packs its own rows, chunk_tokens at a time, without a shuffle;
    what is left of a task's last sequence (under one sequence of tokens) is packed with that of the
    other tasks, in groups of many sequences. A null or empty text is its end id alone; a null doc_id
    stays null; equal rows are packed each by itself; an empty table gives no rows.
    """

    def first(batches):
        words = _word_ids.get(tokenizer_file)
        if words is None:
            words = _word_ids[tokenizer_file] = WordIds(tokenizer_file)
        end = np.array([end_id], dtype="<u4").tobytes()
        base, made, pool, held = (TaskContext.get().partitionId() + 1) << 32, 0, [], 0

        def flush(last: bool):
            nonlocal made, pool, held
            out, open_ = [], []
            for sequence in _pack_pieces(pool, limits):
                if _filled(sequence, limits):
                    out += _lay(sequence, base + made, False)
                    made += 1
                else:
                    open_ += sequence
            if last:
                out += _lay(open_, -1, True)
                open_ = []
            pool, held = open_, sum(len(p[2]) for p in open_) // ID_BYTES
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _FIRST.types, strict=True)], schema=_FIRST)

        for batch in slices(batches):
            for doc_id, x in zip(batch.column("doc_id").to_pylist(), words(text_bytes(batch.column("text"))), strict=True):
                x += end
                n = len(x) // ID_BYTES
                pool.append((doc_id, 0, x, n))
                held += n
                if held >= chunk_tokens:
                    yield from flush(False)
        yield from flush(True)

    packed = save(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(first, _DDL), "packed")
    open_rows = packed.where("ids is not null")
    tokens = open_rows.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    groups = max(1, -(-tokens // (chunk_tokens // 2)))

    def second(pdf: pd.DataFrame) -> pd.DataFrame:
        group = int(pdf["_group"].iloc[0])
        pdf = pdf.sort_values(["doc_id", "start"], kind="stable")
        ids_of = [None if pd.isna(x) else int(x) for x in pdf["doc_id"]]
        pieces = list(zip(ids_of, pdf["start"].tolist(), pdf["ids"].tolist(), pdf["doc_tokens"].tolist(), strict=True))
        out = [row for k, s in enumerate(_pack_pieces(pieces, limits)) for row in _lay(s, (1 << 62) + (group << 32) + k, False)]
        return pd.DataFrame(out, columns=_FIRST.names).astype({"doc_id": "Int64"})

    rest = open_rows.withColumn("_group", F.pmod(F.xxhash64("doc_id", "start"), F.lit(groups)).cast("int")).groupBy("_group").applyInPandas(second, _DDL)
    return packed.where("ids is null").unionByName(rest).drop("ids")


def pack_examples(examples: DataFrame, limits: Limits, per_group: int = 200_000) -> DataFrame:
    """Packs instruction examples, which are not cut: example_id, tokens, segments, loss -> bin_id, slot.

    An example that is over a limit by itself gets a null bin. Nulls count as 0. Examples are dealt to
    groups of about per_group by a hash of the id; at most one bin of a group is poorly filled.
    """
    n = examples.count()
    groups = max(1, -(-n // per_group))
    rows = examples.select(
        F.col("example_id").cast("string").alias("example_id"),
        *(F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in ("tokens", "segments", "loss")),
    ).withColumn("_group", F.pmod(F.xxhash64("example_id", "tokens", "loss"), F.lit(groups)).cast("int"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        group = int(pdf["_group"].iloc[0])
        pdf = pdf.sort_values(["example_id", "tokens", "loss"], kind="stable").reset_index(drop=True)
        demands = pdf[["tokens", "segments", "loss"]].to_numpy(dtype=np.float64)
        fine = (demands <= limits.vector()).all(axis=1)
        own = np.flatnonzero(fine)
        bins, slots = defaultdict(lambda: None), {}
        for k, members in enumerate(fill_bins(demands[own], limits)):
            for slot, (item, _, _) in enumerate(members):
                bins[int(own[item])], slots[int(own[item])] = (group << 32) + k, slot
        at = range(len(pdf))
        return pdf[["example_id", "tokens", "segments", "loss"]].assign(
            bin_id=pd.array([bins[i] for i in at], dtype="Int64"), slot=pd.array([slots.get(i) for i in at], dtype="Int64")
        )

    return rows.groupBy("_group").applyInPandas(one, "example_id string, tokens long, segments long, loss long, bin_id long, slot long")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens."""
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
