"""Operator 4, quality classifier: attention-based multiple-instance learning.

A document is a bag of passages. Each passage is encoded (byte and byte-pair shares, word statistics) and
projected; gated attention weighs the passages; the weighted sum of their representations gives the score.
Encoder, attention and output layer are learned together from document labels.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fold, slices, table, text_bytes

PASSAGE_BYTES = 640
PAIRS = 256
WORD_STATS = 6
WIDTH = 256 + PAIRS + WORD_STATS


def passages(text: bytes, size: int = PASSAGE_BYTES) -> list[bytes]:
    """Whole text in runs of `size` bytes; an empty text is one empty passage."""
    return [text[i : i + size] for i in range(0, len(text), size)] or [b""]


def _word_stats(passage: bytes) -> tuple[float, ...]:
    words = passage.split()
    n = len(words)
    if not n:
        return (0.0,) * WORD_STATS
    return (1.0, len(set(words)) / n, len(passage) / n / 16, sum(map(bytes.istitle, words)) / n, sum(map(bytes.isupper, words)) / n, min(n, 8) / 8)


def encode(texts: list[bytes], at_once: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages, and the first passage of each text."""
    done = [_encode(texts[i : i + at_once]) for i in range(0, len(texts), at_once)]
    before = np.cumsum([0] + [len(x) for x, _ in done])
    return np.concatenate([x for x, _ in done]), np.concatenate([first + n for (_, first), n in zip(done, before[:-1], strict=True)])


def _encode(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    bags = [passages(t) for t in texts]
    flat = [p for bag in bags for p in bag]
    sizes = np.array([len(p) for p in flat])
    raw = np.frombuffer(b"".join(flat), dtype=np.uint8).astype(np.int64)
    owner = np.repeat(np.arange(len(flat)), sizes)
    out = np.zeros((len(flat), WIDTH), dtype=np.float32)
    scale = np.sqrt(np.maximum(sizes, 1)).astype(np.float32)[:, None]
    out[:, :256] = np.sqrt(np.bincount(owner * 256 + raw, minlength=len(flat) * 256).reshape(-1, 256)) / scale
    pair = (((raw[:-1] * 257 + raw[1:]) * 2654435761) >> 16) & (PAIRS - 1)
    same = owner[:-1] == owner[1:]
    out[:, 256 : 256 + PAIRS] = np.sqrt(np.bincount((owner[:-1] * PAIRS + pair)[same], minlength=len(flat) * PAIRS).reshape(-1, PAIRS)) / scale
    out[:, 256 + PAIRS :] = [_word_stats(p) for p in flat]
    lengths = np.array([len(b) for b in bags])
    return out, np.cumsum(lengths) - lengths


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class GatedAttention:
    """Learned weights; `mean` and `spread` standardise features."""

    mean: np.ndarray
    spread: np.ndarray
    weights: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        x = (x - self.mean) / self.spread
        h = np.tanh(x @ w["W"] + w["b"])
        t, g = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
        e = (t * g) @ w["a"]
        bag = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(x))))
        e = np.exp(e - np.maximum.reduceat(e, first)[bag])
        attention = e / np.add.reduceat(e, first)[bag]
        z = np.add.reduceat(h * attention[:, None], first, axis=0)
        return {"x": x, "h": h, "t": t, "g": g, "bag": bag, "attention": attention, "z": z, "score": _sigmoid(z @ w["c"] + w["d"])}

    def score(self, texts: list[bytes]) -> np.ndarray:
        return self.forward(*encode(texts))["score"]

    def gradients(self, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy."""
        w, f = self.weights, self.forward(x, first)
        delta = (f["score"] - y) / len(y)
        dz = delta[:, None] * w["c"]
        dz_of = dz[f["bag"]]
        dh = dz_of * f["attention"][:, None]
        da = (dz_of * f["h"]).sum(axis=1)
        mean = np.add.reduceat(da * f["attention"], first)[f["bag"]]
        de = f["attention"] * (da - mean)
        dt, dg = de[:, None] * w["a"] * f["g"], de[:, None] * w["a"] * f["t"]
        dpre_t, dpre_g = dt * (1 - f["t"] ** 2), dg * f["g"] * (1 - f["g"])
        dh = dh + dpre_t @ w["V"].T + dpre_g @ w["U"].T
        dpre = dh * (1 - f["h"] ** 2)
        return {
            "W": f["x"].T @ dpre, "b": dpre.sum(axis=0), "V": f["h"].T @ dpre_t, "U": f["h"].T @ dpre_g,
            "a": (f["t"] * f["g"]).T @ de, "c": f["z"].T @ delta, "d": np.array([delta.sum()]),
        }


def fit(texts: list[bytes], labels: np.ndarray, hidden: int = 32, attention: int = 16, rounds: int = 12, batch: int = 64, rate: float = 3e-3, decay: float = 1e-4) -> GatedAttention:
    """Adam over the labelled texts; the seed is fixed. Without both labels the score is their share (0.5 without any)."""
    rng = np.random.default_rng(4)
    shapes = {"W": (WIDTH, hidden), "b": (hidden,), "V": (hidden, attention), "U": (hidden, attention), "a": (attention,), "c": (hidden,), "d": (1,)}
    weights = {k: (rng.normal(0, 1 / np.sqrt(s[0]), s) if k not in "bd" else np.zeros(s)).astype(np.float64) for k, s in shapes.items()}
    y = np.asarray(labels, dtype=np.float64)
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
        zero = {k: np.zeros(s) for k, s in shapes.items()} | {"d": np.array([np.log(share / (1 - share))])}
        return GatedAttention(np.zeros(WIDTH), np.ones(WIDTH), zero)
    x, first = encode(texts)
    ends = np.append(first[1:], len(x))
    model = GatedAttention(x.mean(axis=0), x.std(axis=0) + 0.02, weights)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in weights.items()}
    step = 0
    for turn in range(rounds):
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            own = order[at : at + batch]
            rows = np.concatenate([np.arange(first[i], ends[i]) for i in own])
            sizes = ends[own] - first[own]
            grads = model.gradients(x[rows], np.cumsum(sizes) - sizes, y[own])
            step += 1
            for k, g in grads.items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                change = (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
                weights[k] -= rate * (0.5 ** (turn / 4)) * (change + decay * weights[k])
    return model


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", most: int = 6000, held_out_fold: int = 0, most_bytes: int = 64 << 20) -> GatedAttention:
    """Fits on at most `most` labelled documents outside the held-out fold, those with the smallest id hashes, and
    no more of these than have `most_bytes` of text together; both bound what comes to the driver.

    Null labels are left out; a document labelled more than once has its largest label.
    """
    known = labels.where(F.col(target).isNotNull() & (fold("doc_id") != held_out_fold)).groupBy("doc_id").agg(F.max(target).alias("_y"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # sizes first: only texts that fit the bound are moved
    sizes = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("_size")).join(F.broadcast(sample), "doc_id")  # `most` ids
    own = sizes.groupBy("doc_id").agg(F.sum("_size").alias("_size"), F.count("*").alias("_n"))
    order = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)  # over `most` ids and sizes
    fits = own.withColumns({"_bytes": F.sum("_size").over(order), "_rows": F.sum("_n").over(order)}).where((F.col("_bytes") <= most_bytes) & (F.col("_rows") <= most))
    rows = docs.select("doc_id", "text").join(F.broadcast(fits.join(sample, "doc_id").select("doc_id", "_y")), "doc_id").toPandas()
    # equal ids may have different texts: the order is that of id and text, whatever the tasks were
    rows = rows.assign(_t=[(t or "").encode() for t in rows["text"]]).sort_values(["doc_id", "_t"], kind="stable")
    return fit(rows["_t"].tolist(), rows["_y"].to_numpy())


def score_documents(docs: DataFrame, model: GatedAttention, threshold: float = 0.3) -> DataFrame:
    """The columns of docs (but the text), with score and predicted.

    A null text is empty, and an empty text is one empty passage, so both have a score; equal texts have
    equal scores; an empty table gives no rows. All passages of a text count.
    """
    names = [c for c in docs.columns if c not in ("text", "score", "predicted")]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in slices(batches, 256):
            score = shared.value.score(text_bytes(batch.column("text"))) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(score, pa.float64())], names=[*names, "score"])

    rows = docs.select(*names, F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, rows.select(*names).schema.add("score", "double")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_quality(docs: DataFrame, model: GatedAttention, threshold: float = 0.3) -> DataFrame:
    """The rows of docs whose score is at least threshold, with all columns; one scan, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in slices(batches, 256):
            if batch.num_rows:
                yield batch.filter(pa.array(shared.value.score(text_bytes(batch.column("text"))) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score_documents(docs, model).select("doc_id", (fold("doc_id") == 0).alias("held_out"), "score", "predicted")
