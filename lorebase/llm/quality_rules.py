"""Quality rules: base counts, then the divergence of a document's histograms from its language's.

Two histograms describe a text: its characters by class, and its words by a list of the language's common words (with one
more place for all others). References are the sums over all documents of the language that pass the base rules. A
document fails where the Jensen-Shannon distance (base 2, 0 to 1) between its histogram and the reference is above a
threshold. Short texts say little about a distribution, so each comparison asks for a least length; a language with few
words in all has no reference. What isn't compared isn't rejected.

On request (by_length) words are compared at any length, and the limit follows the number of words as sampling noise does: see word_limit().
That comes on top of the fixed limit, so nothing is kept that the fixed limit rejects.

Null texts are empty and fail the base rules. A null or unknown language has no common-word list; its characters are
compared all the same. Rows are judged one by one, so repeated rows get equal verdicts. Further columns pass through
filter_documents() untouched; an empty table gives no rows. DataFrame functions alone are used.
"""

from __future__ import annotations

import math
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, materialize

#: Common words of each language.
COMMON_WORDS = {
    "en": "the of and to in a is that it for on was as with be by are this at from".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par au aux elle la".split()[:19],
    "de": "der die und das den von zu mit ist im dem nicht ein eine auf für sich es an".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al".split(),
}
#: Character classes, as patterns of all that is outside a class; white space, symbols and the rest are what remains.
CLASSES = {"lower": "[^a-z]+", "upper": "[^A-Z]+", "digit": "[^0-9]+", "other_scripts": r"[\x00-\x7F]+"}

CHAR_LIMIT, CHAR_LEAST = 0.32, 200
WORD_LIMIT, WORD_LEAST = 0.30, 100
REFERENCE_LEAST = 1000
#: For limits by length: normal deviations that one text in a million exceeds, and the distance that subject and style may make.
NOISE_DEVIATIONS, STYLE_DISTANCE = 4.75, 0.1
#: References up to which they are broadcast; with more languages than that the join is left to Spark.
MANY_LANGUAGES = 10_000
_N_COMMON = max(map(len, COMMON_WORDS.values()))


def _one_of(listed: list[str], word: Column) -> Column:
    return word.isin(listed)


def _common_found(lang: Column, words: Column) -> Column:
    """The common words of the text's language that the text has, each between bars."""
    lowered = F.transform(words, F.lower)
    found = F.lit(None).cast("string")
    for code, listed in COMMON_WORDS.items():
        found = F.when(lang == code, F.concat(F.lit("|"), F.array_join(F.filter(lowered, partial(_one_of, listed)), "||"), F.lit("|"))).otherwise(found)
    return found


def features(df: DataFrame, *more: str) -> DataFrame:
    """doc_id, lang, base counts, base_failed, and the histograms chars and common (null without a list) of each row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    kept = [F.col(c) for c in more]
    d = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").alias("lang"), text.alias("t"), *kept)
    d = d.withColumn("words", F.array_remove(F.split("t", SPACES), ""))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.select(
        "doc_id", "lang", *kept, "words", F.size("words").cast("long").alias("n_words"), F.length("t").alias("n_all"), lines.alias("lines"),
        F.length(F.regexp_replace("t", SPACES, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("t", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        *(F.length(F.regexp_replace("t", pattern, "")).cast("long").alias(f"c_{name}") for name, pattern in CLASSES.items()),
        _common_found(F.col("lang"), F.col("words")).alias("found"),
    )
    # words in repeated 3-word windows: window hashes, those that come twice (neighbours once sorted), their places
    window = F.transform(F.sequence(F.lit(0), F.size("words") - 3), lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)))
    d = d.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")).withColumn("h", F.when(F.col("n_words") >= 3, window).otherwise(F.array().cast("array<bigint>")))
    d = d.drop("lines", "words").withColumn("sorted", F.sort_array("h"))
    d = d.withColumn("twice", F.array_distinct(F.filter("sorted", lambda x, i: (i > 0) & (x == F.get("sorted", i - 1))))).drop("sorted")
    # looked up by remainder, so that a text with many repeats costs n times the root of their number
    d = d.withColumn("n_bins", F.ceil(F.sqrt(F.size("twice"))).cast("int"))
    bins = F.transform(F.sequence(F.lit(0), F.col("n_bins") - 1), lambda b: F.filter("twice", lambda x: F.pmod(x, F.col("n_bins")) == b))
    d = d.withColumn("bins", F.when(F.col("n_bins") > 0, bins))
    places = F.filter(F.sequence(F.lit(0), F.size("h") - 1), lambda i: F.array_contains(F.get("bins", F.pmod(F.get("h", i), F.col("n_bins")).cast("int")), F.get("h", i)))
    d = d.withColumn("places", F.when((F.col("n_bins") > 0) & (F.size("bins") > 0), places)).drop("h", "bins", "twice", "n_bins")
    gaps = F.aggregate(F.transform("places", lambda p, i: F.when(i == 0, 3).otherwise(F.least(F.lit(3), p - F.get("places", i - 1)))), F.lit(0), lambda a, b: a + b)
    d = d.withColumn("n_repeat_words", F.when(F.size("places") > 0, gaps).otherwise(0).cast("long"))
    rest = F.col("n_all") - F.col("c_lower") - F.col("c_upper") - F.col("c_digit") - F.col("c_other_scripts") - F.col("n_symbols") - (F.col("n_all") - F.col("word_chars"))
    chars = F.array(*(F.col(f"c_{name}") for name in CLASSES), F.col("n_symbols"), F.col("n_all") - F.col("word_chars"), rest)
    counts = None
    for code, listed in COMMON_WORDS.items():
        each = [((F.length("found") - F.length(F.replace("found", F.lit(f"|{w}|"), F.lit("")))) / (len(w) + 2)).cast("long") for w in listed] + [F.lit(0).cast("long")] * (_N_COMMON - len(listed))
        counts = F.when(F.col("lang") == code, F.array(*each)) if counts is None else counts.when(F.col("lang") == code, F.array(*each))
    d = d.withColumn("common", counts).withColumn("common", F.concat("common", F.array(F.col("n_words") - F.aggregate("common", F.lit(0).cast("long"), lambda a, b: a + b))))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return d.select("doc_id", "lang", *kept, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), chars.alias("chars"), "common")


def references(measured: DataFrame) -> DataFrame:
    """(lang, ref_chars, ref_common): a row a language with enough words. All documents count that pass the base rules."""
    good = measured.where(~F.col("base_failed"))
    n_chars = len(CLASSES) + 3
    sums = [F.sum(F.get("chars", F.lit(i))).alias(f"a{i}") for i in range(n_chars)] + [F.sum(F.get("common", F.lit(i))).alias(f"b{i}") for i in range(_N_COMMON + 1)]
    r = good.groupBy("lang").agg(F.sum("n_words").alias("n"), *sums).where(F.col("n") >= REFERENCE_LEAST)
    return r.select(F.col("lang").alias("ref_lang"), F.array(*(F.col(f"a{i}") for i in range(n_chars))).alias("ref_chars"), F.when(F.col("b0").isNotNull(), F.array(*(F.col(f"b{i}") for i in range(_N_COMMON + 1)))).alias("ref_common"))


def jensen_shannon(a: Column, b: Column) -> Column:
    """The Jensen-Shannon distance of two arrays of counts: the root of the divergence in bits. Null where either has no count."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, y: s + y.cast("double"))
    share = lambda p, m: F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)

    def term(x: Column, y: Column) -> Column:
        p, q = x / total(a), y / total(b)
        return (share(p, (p + q) / 2) + share(q, (p + q) / 2)) / 2

    return F.when((total(a) > 0) & (total(b) > 0), F.sqrt(F.greatest(F.lit(0.0), F.aggregate(F.zip_with(a, b, term), F.lit(0.0), lambda s, x: s + x))))


def word_limit(n_words: Column) -> Column:
    """The word distance that n words of the language stay below.

    For n words drawn from the reference, 8 ln 2 n times the squared distance has nearly a chi-square distribution, with a degree of freedom
    for each common word; its quantile is that of Wilson and Hilferty. STYLE_DISTANCE is added in squares.
    """
    f = 2 / (9 * _N_COMMON)
    quantile = _N_COMMON * (1 - f + NOISE_DEVIATIONS * math.sqrt(f)) ** 3
    return F.sqrt(F.lit(quantile / (8 * math.log(2))) / n_words + F.lit(STYLE_DISTANCE**2))


def judged(measured: DataFrame, by_length: bool = False) -> DataFrame:
    """measured with char_distance, word_distance and kept."""
    refs = materialize(references(measured), "references")
    if refs.count() <= MANY_LANGUAGES:
        refs = F.broadcast(refs)
    d = measured.join(refs, F.col("lang").eqNullSafe(F.col("ref_lang")), "left")
    d = d.withColumn("char_distance", F.when(F.col("word_chars") >= CHAR_LEAST, jensen_shannon(F.col("chars"), F.col("ref_chars")))).withColumn("word_distance", F.when(F.col("n_words") >= (1 if by_length else WORD_LEAST), jensen_shannon(F.col("common"), F.col("ref_common"))))
    limit = F.lit(WORD_LIMIT)
    if by_length:
        limit = F.when(F.col("n_words") >= WORD_LEAST, F.least(limit, word_limit(F.col("n_words")))).otherwise(word_limit(F.col("n_words")))
    diverges = F.coalesce(F.col("char_distance") > CHAR_LIMIT, F.lit(False)) | F.coalesce(F.col("word_distance") > limit, F.lit(False))
    return d.withColumn("kept", ~F.col("base_failed") & ~diverges)


def quality_report(df: DataFrame, by_length: bool = False) -> DataFrame:
    d = judged(materialize(features(df), "measured"), by_length)
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance")


def filter_documents(df: DataFrame, by_length: bool = False) -> DataFrame:
    """The documents that the rules keep, with all their columns."""
    whole = df.withColumn("_row", F.struct(*(F.col(f"`{c}`") for c in df.columns)))
    kept = judged(materialize(features(whole, "_row"), "measured"), by_length).where("kept")
    return kept.select(*(F.col(f"_row.`{c}`").alias(c) for c in df.columns))
