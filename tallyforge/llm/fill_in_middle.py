"""Operator 12, fill-in-middle: a wavelet matrix over character classes counts boundaries and locates both cuts.

A text is read as UTF-8 bytes, each of one class. Three classes begin a token (a letter after a non-letter, an ASCII
character that is no letter, the lead byte of any other character), two do not (a letter after a letter, a later byte of
a character). The classes that begin tokens are the smallest symbols, so that the tokens before a byte are one rank_below
query, and the code points before it are the bytes less the rank of the last class. A cut after k tokens is the first
byte before which more than k tokens begin, found by bisection on that count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, text_bytes
from .wavelet import WaveletMatrix

MARKS = ("<P>", "<S>", "<M>")

_FIRST_LETTER, _OTHER_ASCII, _LEAD, _LETTER, _TAIL = range(5)
_LETTERS = np.zeros(256, dtype=bool)
_LETTERS[[*range(65, 91), *range(97, 123)]] = True
#: Bytes of texts that share one matrix; a longer text has its own.
_TOGETHER = 2 << 20


def classes(joined: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The class of each byte of texts that stand one after another; a text's first letter begins a token."""
    letter = _LETTERS[joined]
    out = np.where(letter, _LETTER, np.where(joined < 0x80, _OTHER_ASCII, np.where(joined < 0xC0, _TAIL, _LEAD))).astype(np.uint8)
    before = np.concatenate([[False], letter[:-1]])
    before[starts[starts < len(joined)]] = False
    out[letter & ~before] = _FIRST_LETTER
    return out


class Boundaries:
    """Tokens and code points of texts that stand one after another, by ranks alone."""

    def __init__(self, texts: list[bytes]):
        joined = np.frombuffer(b"".join(texts), dtype=np.uint8)
        self.ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
        self.starts = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)
        self.matrix = WaveletMatrix(classes(joined, self.starts), 3)
        self.base = self.tokens_before(self.starts)
        self.counts = self.tokens_before(self.ends) - self.base

    def tokens_before(self, at: np.ndarray) -> np.ndarray:
        return self.matrix.rank_below(_LETTER, at)

    def code_points(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        return (last - first) - (self.matrix.rank(_TAIL, last) - self.matrix.rank(_TAIL, first))

    def cut_after(self, k: np.ndarray) -> np.ndarray:
        """Of each text, the byte (of the whole) where its token number k begins, or its end."""
        low, high, want = self.starts.copy(), self.ends.copy(), self.base + k
        while (open_ := low < high).any():
            middle = (low + high) >> 1
            # does token k begin at this byte or before it?
            reached = self.tokens_before(np.minimum(middle + 1, self.matrix.length)) > want
            high = np.where(open_ & reached, middle, high)
            low = np.where(open_ & ~reached, middle + 1, low)
        return low


def _cut(batches):
    """(..., text, h1, h2, kept plain by draw, spm by draw) -> (..., n, form, prefix_chars, middle_chars, output)."""
    for batch in slices(batches):
        texts = text_bytes(batch.column("text"))
        at = 0
        while at < len(texts):
            size, until = len(texts[at]), at + 1
            while until < len(texts) and size + len(texts[until]) <= _TOGETHER:
                size, until = size + len(texts[until]), until + 1
            yield _cut_some(batch.slice(at, until - at), texts[at:until])
            at = until


def _cut_some(batch: pa.RecordBatch, texts: list[bytes]) -> pa.RecordBatch:
    bounds = Boundaries(texts)
    h1, h2 = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("h1", "h2"))
    k1, k2 = h1 % (bounds.counts + 1), h2 % (bounds.counts + 1)
    first, second = bounds.cut_after(np.minimum(k1, k2)), bounds.cut_after(np.maximum(k1, k2))
    prefix, middle = bounds.code_points(bounds.starts, first), bounds.code_points(first, second)
    keep, spm = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("keep", "spm"))
    mark_p, mark_s, mark_m = (m.encode() for m in MARKS)
    forms, outputs = [], []
    for i, t in enumerate(texts):
        if keep[i] or not t or any(m.encode() in t for m in MARKS):
            forms.append("plain")
            outputs.append(t)
            continue
        a, b = int(first[i] - bounds.starts[i]), int(second[i] - bounds.starts[i])
        if spm[i]:
            forms.append("spm")
            outputs.append(b"".join([mark_s, t[b:], mark_p, t[:a], mark_m, t[a:b]]))
        else:
            forms.append("psm")
            outputs.append(b"".join([mark_p, t[:a], mark_s, t[b:], mark_m, t[a:b]]))
    plain = np.array([f == "plain" for f in forms])
    rest = [c for c in batch.schema.names if c not in ("text", "h1", "h2", "keep", "spm")]
    return pa.RecordBatch.from_arrays(
        [
            *[batch.column(c) for c in rest],
            pa.array(bounds.counts, pa.int64()),
            pa.array(forms, pa.string()),
            pa.array(prefix, pa.int64(), mask=plain),
            pa.array(middle, pa.int64(), mask=plain),
            pa.array(outputs, pa.binary()).cast(pa.string()),
        ],
        [*rest, "n", "form", "prefix_chars", "middle_chars", "output"],
    )


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, plain_percent: int = 10, spm_percent: int = 20) -> DataFrame:
    """Moves the middle of each text behind its suffix: (id, n, form, prefix_chars, middle_chars, output).

    Tokens are runs of A-Z and a-z, and every other code point. Cuts and forms are drawn from the hash of seed and id, so
    that they do not depend on the order of rows: equal ids draw alike, a null id draws as an empty one. Null text is
    empty. An empty text, one that holds a mark and `plain_percent` of the others stay as they are (plain, null counts of
    characters); of the rest `spm_percent` have their suffix first. Any length of text is cut whole; an empty table gives
    no rows; other columns are ignored.
    """
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(drawn, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    given = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), h[0].alias("h1"), h[1].alias("h2"),
        (h[2] % 100 >= 100 - plain_percent).alias("keep"), (h[3] % 100 < spm_percent).alias("spm"),
    )
    kind = docs.schema[id_col].dataType.simpleString()
    return given.mapInArrow(_cut, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string").withColumnRenamed("id", id_col)


def restore(output: Column, form: Column) -> Column:
    """The text that an output was made of. Texts with marks are plain, so that a mark's first place is its own."""

    def after(mark: str) -> Column:
        return F.locate(mark, output) + F.lit(3)

    def between(begin: str, end: str | None) -> Column:
        stop = F.locate(end, output) if end else F.length(output) + F.lit(1)
        return F.substr(output, after(begin), stop - after(begin))

    p, s, m = MARKS
    return (
        F.when(form == "plain", output)
        .when(form == "psm", F.concat(between(p, s), between(m, None), between(s, m)))
        .when(form == "spm", F.concat(between(p, m), between(m, None), between(s, p)))
    )


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, with digests of the output and of the text restored from it."""
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restore(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"),
    )


SQL = r"""
with drawn as (
    select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as u,
        sha256('1:' || doc_id::varchar) as h
    from documents
), cuts as (
    select *, len(u)::bigint as n,
        ('0x' || substr(h, 1, 8))::bigint % (len(u) + 1) as k1, ('0x' || substr(h, 9, 8))::bigint % (len(u) + 1) as k2,
        ('0x' || substr(h, 17, 8))::bigint % 100 as h3, ('0x' || substr(h, 25, 8))::bigint % 100 as h4
    from drawn
), parts as (
    select *,
        array_to_string(u[1:least(k1, k2)], '') as p,
        array_to_string(u[least(k1, k2) + 1:greatest(k1, k2)], '') as m,
        array_to_string(u[greatest(k1, k2) + 1:n], '') as s,
        case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 >= 90 then 'plain'
            when h4 < 20 then 'spm' else 'psm' end as form
    from cuts
)
select doc_id, n, form,
    case when form <> 'plain' then length(p) end as prefix_chars,
    case when form <> 'plain' then length(m) end as middle_chars,
    sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m
        else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
    sha256(t) as restored_sha256
from parts
"""
