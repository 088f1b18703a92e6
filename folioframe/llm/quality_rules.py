"""Operator 5, quality rules: base counts, then distribution divergence from language references.

DataFrame functions only. A text's character classes and its language's common words form two
histograms. The reference of a language is the mean histogram of its texts that pass the base rules,
over all rows. A text fails if the Jensen-Shannon distance (base 2, 0 to 1) of either histogram to the
reference exceeds its bound; texts under ``MIN_CHARS`` characters or ``MIN_WORDS`` words skip that
histogram, as do languages without a reference. Languages without a word list share one common list.

Null texts have no words and fail the base rules; a null language is its own language. Repeated rows
count each. Trigrams are compared by 64-bit hashes within a text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_GAP, materialize, table

SYMBOLS = "#*$%&|<>"
#: Frequent function words of each language.
COMMON = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "it", "on", "with", "as"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "une", "du", "que", "est"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "ist"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "del", "se", "las", "por"],
}
OTHER = ["the", "de", "la", "in", "a", "en", "und", "que", "die", "y", "et", "der"]
N_COMMON = 12
MIN_CHARS, MIN_WORDS = 200, 80
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.25, 0.28
MIN_BASE_WORDS, MAX_REPEAT_PERCENT = 50, 50
CHAR_CLASSES = ("lower", "upper", "digit", "symbol", "mark", "gap")


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def repeat_words(words: Column) -> Column:
    """Words in 3-word windows that are found twice or more, the first window included."""
    n = F.size(words)
    hashes = F.transform(
        F.sequence(F.lit(1), n - 2), lambda i: F.xxhash64(F.element_at(words, i), F.element_at(words, i + 1), F.element_at(words, i + 2))
    )

    def equal(s: Column, e: Column, j: Column) -> Column:
        before = F.when(j > 0, F.get(s, j - 1)["h"] == e["h"])
        return F.coalesce(before, F.lit(False)) | F.coalesce(F.get(s, j + 1)["h"] == e["h"], F.lit(False))

    def covered(h: Column) -> Column:
        placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        marked = _let(placed, lambda s: F.filter(s, lambda e, j: equal(s, e, j)))
        at = F.array_sort(F.transform(marked, lambda e: e["i"]))
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("sum"))
        step = lambda acc, x: F.struct(x.alias("last"), (acc["sum"] + F.least(F.lit(3), x - acc["last"])).alias("sum"))
        return F.aggregate(at, start, step)["sum"]

    found = _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
    return F.when(n < 4, F.lit(0)).otherwise(found).cast("long")


def text_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per row: ``id_col``, _lang, the base counts, character classes (array) and common words (array)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(F.col(id_col), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("_lang"), text.alias("_t"))
    df = df.withColumn("_w", F.array_remove(F.split("_t", WORD_GAP), ""))
    lines = F.filter(F.split("_t", "\n"), lambda x: F.regexp_replace(x, WORD_GAP, "") != "")
    df = df.withColumns({"_solid": F.regexp_replace("_t", WORD_GAP, ""), "_lines": lines})
    # What is left after the lower-case letters is short, so the other classes cost little.
    df = df.withColumn("_rest", F.regexp_replace("_solid", r"\p{Ll}+", ""))
    listed = reduce(lambda c, kv: c.when(F.col("_lang") == kv[0], F.array(*map(F.lit, kv[1]))), COMMON.items(), F.when(F.lit(False), F.array(*map(F.lit, OTHER))))
    listed = listed.otherwise(F.array(*map(F.lit, OTHER)))
    known = sorted({x for ws in (*COMMON.values(), OTHER) for w in ws for x in (w, w.capitalize())})
    df = df.withColumn("_hits", F.transform(F.filter("_w", lambda w: w.isin(*known)), F.lower))
    length = lambda c: F.length(c).cast("long")
    upper = length("_rest") - length(F.regexp_replace("_rest", r"\p{Lu}+", ""))
    digit = length("_rest") - length(F.regexp_replace("_rest", r"[0-9]+", ""))
    symbol = length("_rest") - length(F.translate("_rest", SYMBOLS, ""))
    df = df.select(
        id_col,
        "_lang",
        F.size("_w").cast("long").alias("n_words"),
        length("_solid").alias("word_chars"),
        symbol.alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("_w")).alias("n_repeat_words"),
        upper.alias("_upper"),
        digit.alias("_digit"),
        length("_rest").alias("_left"),
        length("_t").alias("_n"),
        F.transform(listed, lambda c: (F.size("_hits") - F.size(F.array_remove(F.col("_hits"), c))).cast("long")).alias("_common"),
    )
    chars = [F.col("word_chars") - F.col("_left"), F.col("_upper"), F.col("_digit"), F.col("n_symbols")]
    chars += [F.col("_left") - F.col("_upper") - F.col("_digit") - F.col("n_symbols"), F.col("_n") - F.col("word_chars")]
    df = df.withColumn("_chars", F.array(*chars)).withColumn(
        "base_failed", (F.col("n_words") < MIN_BASE_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    )
    rest = F.col("n_words") - F.aggregate("_common", F.lit(0).cast("long"), lambda a, x: a + x)
    return df.withColumn("_words", F.concat(F.col("_common"), F.array(rest))).drop("_upper", "_digit", "_left", "_n", "_common")


def _shares(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    return F.transform(counts, lambda x: F.when(total > 0, x / total).otherwise(F.lit(0.0)))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares: root of the divergence in bits."""

    def part(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))

    terms = F.zip_with(p, q, lambda a, b: (part(a, (a + b) / 2) + part(b, (a + b) / 2)) / 2)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)))


def references(counts: DataFrame) -> DataFrame:
    """Mean histograms of each language over the rows that pass the base rules."""
    sizes = {"_chars": len(CHAR_CLASSES), "_words": N_COMMON + 1}
    good = counts.where("not base_failed").select("_lang", *(_shares(F.col(c)).alias(c) for c in sizes))
    means = [F.avg(F.col(c)[i]).alias(f"{c}{i}") for c, n in sizes.items() for i in range(n)]
    found = good.groupBy("_lang").agg(*means)
    return found.select("_lang", *(F.array(*(F.col(f"{c}{i}") for i in range(n))).alias(f"_ref{c}") for c, n in sizes.items()))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per row: ``id_col``, base counts, base_failed, char_distance, word_distance (null: skipped) and kept."""
    counts = materialize(text_counts(docs, id_col, text_col, lang_col), "quality")
    # One row for each language; Spark broadcasts it only if it proves small.
    both = counts.join(references(counts).withColumnRenamed("_lang", "_lang2"), F.col("_lang") == F.col("_lang2"), "left")
    char = F.when(F.col("word_chars") >= MIN_CHARS, js_distance(_shares(F.col("_chars")), F.col("_ref_chars")))
    word = F.when(F.col("n_words") >= MIN_WORDS, js_distance(_shares(F.col("_words")), F.col("_ref_words")))
    both = both.withColumns({"char_distance": char, "word_distance": word})
    near = (F.coalesce(F.col("char_distance"), F.lit(0.0)) <= MAX_CHAR_DISTANCE) & (F.coalesce(F.col("word_distance"), F.lit(0.0)) <= MAX_WORD_DISTANCE)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return both.select(id_col, *names, "char_distance", "word_distance", (~F.col("base_failed") & near).alias("kept"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: ``quality_rules`` over all documents, distances to six decimals."""
    out = quality_rules(table(spark, sf_dir, "documents"))
    return out.withColumns({c: F.round(c, 6) for c in ("char_distance", "word_distance")})
