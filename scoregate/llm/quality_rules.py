"""Quality rules from DataFrame functions alone: base counts of a text, then a hashed n-gram log-likelihood ratio.

Method: the n-grams are all words and all pairs of adjacent words of the whole text, hashed into BUCKETS buckets. Two
multinomials are counted, of a trusted target (all documents labelled good) and of the raw corpus, all documents. A
document's score is the sum of log(p_target / p_raw) of its n-grams (each count plus one) over the number of its n-grams,
and it is kept from THRESHOLD on, wherever the base rules don't fail it. The trusted documents are found by a semi-join on
doc_id that is shuffled at every size; a bit set (common.sieve) keeps most other texts out of that shuffle and decides
nothing. Corpus statistics come to the driver as BUCKETS counts and go back as one literal array.

Defined cases: a null text has no words (and so fails the base rules); without trusted documents every ratio is 0; null
labels and ids trust nothing; repeated rows and further columns stay; an empty table gives an empty result. Equal 8-word
windows are found by 64-bit hashes."""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, functions as F

from scoregate.llm.common import free_name, sieve, words_of

BUCKETS = 1 << 14
THRESHOLD = -0.5
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
_BLANK = " \t\n\x0b\x0c\r"


def _let(value, body):
    """body(value) with the value worked out once."""
    return F.transform(F.array(value), body)[0]


def _buckets(words):
    """The bucket of each n-gram."""
    place = lambda h: F.pmod(h, F.lit(BUCKETS)).cast("int")
    pairs = lambda h: F.zip_with(F.slice(h, F.lit(1), F.greatest(F.size(h) - 1, F.lit(0))), F.slice(h, F.lit(2), F.size(h)), lambda a, b: place(F.xxhash64(a, b)))
    return _let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.concat(F.transform(h, place), pairs(h)))


def _covered(windows):
    """Words within a window that occurs twice or more, given the hashes of all windows in order."""
    placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def starts(p):
        same = lambda k, j: F.coalesce(F.get(p, j)["h"] == k["h"], F.lit(False))
        return F.array_sort(F.transform(F.filter(p, lambda k, j: same(k, j - 1) | same(k, j + 1)), lambda k: k["i"]))

    def total(s):
        gaps = F.zip_with(s, F.slice(s, 2, F.greatest(F.size(s), F.lit(1))), lambda a, b: F.coalesce(F.least(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(gaps, F.lit(0), lambda acc, g: acc + g)

    return _let(placed, lambda p: _let(starts(p), total))


def _repeat_words(words):
    """How many words lie within 8-word windows found twice or more."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    windows = lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(h, i, WINDOW)))
    found = lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), 0).otherwise(_covered(w))
    return F.when(F.size(words) >= 2 * WINDOW - WINDOW + 1, _let(hashes, lambda h: _let(windows(h), found))).otherwise(0)


def _counts(documents: DataFrame) -> list[int]:
    """How often the n-grams of the documents fall into each bucket."""
    counted = documents.select(F.explode(_buckets(words_of(F.col("text")))).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    out = [0] * BUCKETS
    for row in counted.collect():
        out[row["bucket"]] = row["n"]
    return out


def ratio_table(documents: DataFrame, trusted_ids: DataFrame) -> list[float]:
    """log(p_target / p_raw) of each bucket."""
    trusted = trusted_ids.select(F.col("doc_id").alias("_trusted")).where("_trusted is not null").distinct()
    maybe = sieve(trusted.select(F.xxhash64(F.col("_trusted").cast("string")).alias("place")))
    asked = documents.select("doc_id", "text").where(maybe(F.xxhash64(F.col("doc_id").cast("string"))))
    target = _counts(asked.join(trusted.hint("shuffle_merge"), F.col("doc_id") == F.col("_trusted"), "left_semi"))
    if not any(target):
        return [0.0] * BUCKETS
    raw = _counts(documents)
    all_raw, all_target = sum(raw) + BUCKETS, sum(target) + BUCKETS
    return [math.log((t + 1) / all_target) - math.log((r + 1) / all_raw) for t, r in zip(target, raw, strict=True)]


def judged(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with a struct column ``rules``: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long),
    ratio (double), base_failed and kept (boolean)."""
    documents = documents.withColumn("text", F.col("text").cast("string"))
    ratios = ratio_table(documents, labels.where("quality = 1"))
    table = F.from_json(F.lit(json.dumps(ratios)), "array<double>")
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, _BLANK, "") != "")

    def measured(words):
        n = F.size(words).cast("long")
        ratio = _let(_buckets(words), lambda found: F.aggregate(found, F.lit(0.0), lambda acc, b: acc + F.get(table, b)) / F.size(found))
        return F.struct(
            n.alias("n_words"),
            _repeat_words(words).cast("long").alias("n_repeat_words"),
            F.when(n > 0, ratio).otherwise(0.0).alias("ratio"),
        )

    bare = F.translate(text, _BLANK, "")
    repeats = free_name(documents, "__sg_dup_lines")
    counted = documents.withColumn("rules", _let(words_of(text), measured)).withColumn(repeats, _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))))
    n, repeated = F.col("rules.n_words"), F.col("rules.n_repeat_words")
    failed = (n < MIN_WORDS) | (100 * repeated > MAX_REPEAT_PERCENT * n)
    return counted.withColumn(
        "rules",
        F.struct(
            n.alias("n_words"),
            F.length(bare).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            F.col(repeats).cast("long").alias("n_dup_lines"),
            repeated.alias("n_repeat_words"),
            F.col("rules.ratio").alias("ratio"),
            failed.alias("base_failed"),
            (~failed & (F.col("rules.ratio") >= threshold)).alias("kept"),
        ),
    ).drop(repeats)


def quality_rules(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and the fields of ``rules`` of every document."""
    return judged(documents.select("doc_id", "text"), labels, threshold).select("doc_id", "rules.*")


def passing(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the rules keep, with their own columns."""
    own = documents.columns
    kept = free_name(documents, "__sg_rules")
    held = documents.withColumnRenamed("rules", kept)
    out = judged(held, labels, threshold).where("rules.kept").drop("rules")
    return out.withColumnRenamed(kept, "rules").select(*own)
