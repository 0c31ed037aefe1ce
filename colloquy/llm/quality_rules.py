"""Operator 5, quality rules: how far a document's histograms lie from its language.

Native: DataFrame functions only. Two histograms are taken of every whole text,
one over character classes and one over the common words of its language. The
reference of a language is the mean histogram of its documents that pass the base rules
and are long enough, without the judged one; the verdict compares Jensen-Shannon
distances (base 2, so 0 to 1) with thresholds. Short documents have noisy histograms and
are left to the base rules, as are documents of a language with fewer than
MIN_REFERENCE others to learn from.

Defined results: a null text counts as empty; null is a language of its own; a language
without a list of common words is judged by character classes alone, and its word_js is
null; a document without a reference has null distances; repeated rows give repeated
results; very long texts are measured whole; an empty table gives an empty result; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table, words

#: Common words by language: parameters, each with the same number of bins.
COMMON = {
    "en": "the of and to in is that it for on with as was by be this".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem".split(),
    "es": "de la que el en y a los se del las un por con no una".split(),
}
N_COMMON = len(COMMON["en"])
#: Character classes beside blanks and what is left.
CLASSES = {"lower": "[a-z]", "upper": "[A-Z]", "digit": "[0-9]", "punct": "[!-/:-@\\[-`{-~]"}
LONGEST_COMMON = max(len(w) for ws in COMMON.values() for w in ws)
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Histograms of fewer words, or of fewer code points in words, are not judged.
JUDGE_WORDS, JUDGE_CHARS = 50, 200
#: A reference is the mean of so many documents at least.
MIN_REFERENCE = 5
#: A text goes if one histogram lies this far off, or if both together do. Chance moves
#: the histograms of short texts, so NOISE / sqrt(words) comes on top.
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE, MAX_SUM, NOISE = 0.28, 0.28, 0.36, 0.5
SYMBOLS = "[#*$%&|<>]"


def repeated_words(w: Column) -> dict[str, Column]:
    """Steps, each a column that the next one reads, to count words in repeated 3-word windows."""
    starts = F.sequence(F.lit(0), F.size(w) - 3)
    return {
        "win": F.when(F.size(w) >= 3, F.transform(starts, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))).otherwise(F.array().cast("array<bigint>")),
        "sorted": F.when(
            F.size(F.array_distinct("win")) < F.size("win"),
            F.sort_array(F.transform("win", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")),
        "again": F.filter("sorted", lambda x, k: (F.get("sorted", k - 1)["h"] == x["h"]) | (F.get("sorted", k + 1)["h"] == x["h"])),
        "n_repeat_words": F.size(F.array_distinct(F.flatten(F.transform("again", lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))).cast("long"),
    }


def measured(docs: DataFrame) -> DataFrame:
    """One pass over the texts: the base counts and both histograms as shares."""
    t = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("lang").alias("own_lang"))
    t = t.withColumn("w", words(F.col("text")))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    common = F.array().cast("array<string>")
    for lang, bins in COMMON.items():
        common = F.when(F.coalesce("own_lang", F.lit("")) == lang, F.array(*map(F.lit, bins))).otherwise(common)
    t = t.withColumn("lines", lines).withColumn("common", common)
    t = t.withColumn("hits", F.transform(F.filter("w", lambda x: (F.length(x) <= LONGEST_COMMON) & F.array_contains("common", F.lower(x))), F.lower))
    for name, c in repeated_words(F.col("w")).items():
        t = t.withColumn(name, c)
    t = t.select(
        "doc_id", "own_lang", "n_repeat_words", "hits", "common",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.length("text").alias("n"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.length(F.regexp_replace("text", "[^a-z]+", "")).alias("n_lower"),  # most characters: shorter to strip the others
        *(F.regexp_count("text", F.lit(CLASSES[k])).alias(f"n_{k}") for k in list(CLASSES)[1:]),
    )
    counts = [*(F.col(f"n_{k}") for k in CLASSES), F.col("n") - F.col("word_chars")]
    rest = F.col("n") - sum(counts[1:], counts[0])
    share = lambda c, n: c.cast("double") / F.greatest(n, F.lit(1))
    each = F.transform("common", lambda c: share(F.size(F.filter("hits", lambda h: h == c)), F.col("n_words")))
    return t.select(
        "doc_id", "own_lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.array(*(share(c, F.col("n")) for c in [*counts, rest])).alias("class_p"),
        F.when(F.size("common") > 0, F.concat(each, F.array(share(F.col("n_words") - F.size("hits"), F.col("n_words"))))).alias("word_p"),
    )


def judged() -> Column:
    return (F.col("n_words") >= JUDGE_WORDS) & (F.col("word_chars") >= JUDGE_CHARS)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def teaches() -> Column:
    """Whether a document counts in the reference of its language."""
    return judged() & ~base_failed()


def references(m: DataFrame) -> DataFrame:
    """Sums of histograms by language, over all documents that teach: a few rows."""
    total = lambda c, n, name: F.array(*(F.sum(F.get(c, F.lit(i))) for i in range(n))).alias(name)
    return m.where(teaches()).groupBy("own_lang").agg(F.count("*").alias("n_ref"), total("class_p", len(CLASSES) + 2, "class_sum"), total("word_p", N_COMMON + 1, "word_sum"))


def without_own(sums: str, own: str) -> Column:
    """The mean of the others: sums less what the judged document added; null where too few are left."""
    n = F.col("n_ref") - F.when(teaches(), 1).otherwise(0)
    mean = F.zip_with(sums, own, lambda s, p: F.greatest(s - F.when(teaches(), p).otherwise(0.0), F.lit(0.0)) / n)
    return F.when(n >= MIN_REFERENCE, mean)


def js_distance(p: str, q: str) -> Column:
    """Square root of the Jensen-Shannon divergence in bits of two arrays of shares."""
    part = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)
    terms = F.zip_with(p, q, lambda a, b: part(a, (a + b) / 2) + part(b, (a + b) / 2))
    whole = F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / 2, F.lit(0.0)))
    return F.when(F.col(p).isNotNull() & F.col(q).isNotNull(), whole)


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, class_js, word_js.

    The measures are written to the shared folder once, as both the references and
    the verdicts read them. The references (a row a language) are joined back; the
    optimizer may broadcast them by their measured size.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    m = scratch.keep(measured(docs))
    ref = references(m).withColumnRenamed("own_lang", "ref_lang")
    t = m.join(ref, F.col("own_lang").eqNullSafe(F.col("ref_lang")), "left")
    t = t.withColumns({"class_q": without_own("class_sum", "class_p"), "word_q": without_own("word_sum", "word_p")})
    t = t.withColumns({"class_js": js_distance("class_p", "class_q"), "word_js": js_distance("word_p", "word_q")})
    word = F.coalesce("word_js", F.lit(0.0))
    over = F.greatest(F.col("class_js") - MAX_CLASS_DISTANCE, word - MAX_WORD_DISTANCE, F.col("class_js") + word - MAX_SUM)
    far = judged() & F.col("class_js").isNotNull() & (over > NOISE / F.sqrt("n_words"))
    return t.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), (~base_failed() & ~F.coalesce(far, F.lit(False))).alias("kept"),
        F.round("class_js", 6).alias("class_js"), F.round("word_js", 6).alias("word_js"),
    )


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))
