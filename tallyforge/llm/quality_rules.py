"""Operator 6, quality rules: divergence of histograms from language references, in SQL functions only.

Each document has two histograms: character classes, and the commonest words of its language. The
reference of a language is the pooled histogram of all its documents that pass the base rules. A
document goes when the Jensen-Shannon distance (base 2, so 0 to 1) to its reference is over the limit;
a histogram of a text under the minimum length is not judged.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_BREAKS, save, table

# The commonest function words of each language.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "with", "was"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un"],
}
# Character classes, each counted by what its pattern matches.
CHAR_CLASSES = {
    "lower": r"\p{Ll}",
    "upper": r"\p{Lu}",
    "digit": r"\p{Nd}",
    "space": r"[\x20\x09-\x0D]",
    "stop": r"[.,;:!?'\"()\-]",
    "symbol": r"[#*$%&|<>]",
}
WINDOW = 8
#: Rows of a null or unknown language: character classes are held against the pool of all such rows, words are not judged.
OTHER = "?"


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column) -> Column:
    """Number of words inside WINDOW-word runs that are found twice or more in the array."""

    def windows(hashes: Column) -> Column:
        return F.when(
            F.size(hashes) >= WINDOW,
            F.transform(F.sequence(F.lit(1), F.size(hashes) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(hashes, i, WINDOW))),
        ).otherwise(F.array().cast("array<bigint>"))

    def covered(keys: Column) -> Column:
        ranked = F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))

        def positions(s: Column) -> Column:
            # after the sort, equal runs stand side by side; get() is null beyond the ends
            flagged = F.filter(s, lambda x, j: F.coalesce(F.get(s, j - 1)["k"] == x["k"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["k"] == x["k"], F.lit(False)))
            return F.sort_array(F.transform(flagged, lambda x: x["i"]))

        start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
        step = lambda acc, p: F.struct(
            (p + WINDOW).alias("end"), (acc["n"] + WINDOW - F.greatest(acc["end"] - p, F.lit(0))).cast("long").alias("n")
        )
        return F.aggregate(_let(ranked, positions), start, step, lambda acc: acc["n"])

    once = lambda keys: F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.lit(0).cast("long")).otherwise(covered(keys))
    return _let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: _let(windows(h), once))


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return _let(lines, lambda a: (F.size(a) - F.size(F.array_distinct(a))).cast("long"))


def _count(text: Column, pattern: str) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def features(docs: DataFrame) -> DataFrame:
    """One row of counts and histograms for each document."""
    text = F.col("_text")
    words = F.filter(F.split(text, WORD_BREAKS), lambda w: w != "")
    lists = F.create_map(*[x for lang, ws in COMMON_WORDS.items() for x in (F.lit(lang), F.array(*map(F.lit, ws)))])
    every = sorted({w for ws in COMMON_WORDS.values() for w in ws})

    def word_histogram(ws: Column) -> Column:
        common = F.filter(F.transform(ws, lambda w: F.lower(F.regexp_replace(w, r"[.,;:!?]+$", ""))), lambda w: w.isin(every))
        return _let(common, lambda hits: F.transform(lists[F.col("_lang")], lambda c: F.size(F.filter(hits, lambda w: w == c)).cast("long")))

    rows = docs.select(
        F.col("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"),
        F.when(F.col("lang").isin(*COMMON_WORDS), F.col("lang")).otherwise(F.lit(OTHER)).alias("_lang"),
    )
    counts = [_count(text, p).alias(f"c_{k}") for k, p in CHAR_CLASSES.items()]
    per_word = _let(
        words,
        lambda ws: F.struct(
            F.size(ws).cast("long").alias("n_words"), repeated_words(ws).alias("n_repeat_words"), word_histogram(ws).alias("h_words")
        ),
    )
    wide = rows.select("doc_id", "_lang", F.length(text).cast("long").alias("n_chars"), duplicate_lines(text).alias("n_dup_lines"), *counts, per_word.alias("w"))
    return wide.select(
        "doc_id",
        "_lang",
        "n_chars",
        F.col("w.n_words").alias("n_words"),
        (F.col("n_chars") - F.col("c_space")).alias("word_chars"),
        F.col("c_symbol").alias("n_symbols"),
        "n_dup_lines",
        F.col("w.n_repeat_words").alias("n_repeat_words"),
        F.array(*[F.col(f"c_{k}") for k in CHAR_CLASSES]).alias("h_chars"),
        F.col("w.h_words").alias("h_words"),
    )


def _shares(histogram: Column, total: Column) -> Column:
    """Shares of the total, with the rest as a last bin."""
    rest = total - F.aggregate(histogram, F.lit(0).cast("long"), lambda a, x: a + x)
    return F.transform(F.concat(histogram, F.array(F.greatest(rest, F.lit(0)))), lambda x: x / F.greatest(total, F.lit(1)))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares."""
    term = lambda a, b: F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(F.lit(0.0))
    parts = F.zip_with(p, q, lambda a, b: 0.5 * (term(a, b) + term(b, a)))
    return F.sqrt(F.greatest(F.aggregate(parts, F.lit(0.0), lambda s, x: s + x), F.lit(0.0)))


def divergence_rules(
    docs: DataFrame,
    max_char_distance: float = 0.25,
    max_word_distance: float = 0.24,
    min_chars: int = 200,
    min_words: int = 80,
) -> DataFrame:
    """Counts, base verdict, distances and final verdict of docs (doc_id, text, lang).

    Null text is empty and fails the base rules; rows of null or unknown languages are one pool, whose words
    are not judged; equal rows get equal results; an empty table gives no rows; other columns are ignored.
    The references cover all documents; there is one for each known language and one for all others, so broadcasting them is
    bounded by the length of COMMON_WORDS.
    """
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rows = save(features(docs).withColumn("base_failed", base), "quality-features")
    n_bins = {"h_chars": len(CHAR_CLASSES), "h_words": len(next(iter(COMMON_WORDS.values())))}
    good = rows.where(~F.col("base_failed"))
    sums = [F.sum(F.get(F.col(h), F.lit(i))).alias(f"{h}_{i}") for h, n in n_bins.items() for i in range(n)]
    pooled = good.groupBy("_lang").agg(F.sum("n_chars").alias("_chars"), F.sum("n_words").alias("_words"), *sums)
    refs = pooled.select(
        "_lang",
        *[_shares(F.array(*[F.col(f"{h}_{i}") for i in range(n)]), F.col(t)).alias(f"r_{h}") for (h, n), t in zip(n_bins.items(), ("_chars", "_words"), strict=True)],
    )
    return (
        rows.join(F.broadcast(refs), "_lang", "left")  # at most one row for each known language
        .withColumn("char_distance", F.when(F.col("n_chars") >= min_chars, js_distance(_shares(F.col("h_chars"), F.col("n_chars")), F.col("r_h_chars"))))
        .withColumn("word_distance", F.when((F.col("n_words") >= min_words) & F.col("h_words").isNotNull(), js_distance(_shares(F.col("h_words"), F.col("n_words")), F.col("r_h_words"))))
        .withColumn(
            "kept",
            ~F.col("base_failed")
            & reduce(
                lambda a, b: a & b,
                [F.coalesce(F.col(d) <= most, F.lit(True)) for d, most in (("char_distance", max_char_distance), ("word_distance", max_word_distance))],
            ),
        )
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance")
    )


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents under the divergence rules."""
    return divergence_rules(table(spark, sf_dir, "documents"))
