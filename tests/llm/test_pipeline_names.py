"""Stages leave columns alone whatever their names, those of the operators' own helpers among them."""

from pyspark.sql import functions as F

from scoregate.llm import gam, mixing, ngram_jaccard, quality_rules

NAMES = (
    "rules", "_dup_lines", "_own_rules", "_gam_score", "__sg_dup_lines", "__sg_rules", "__sg_score", "__SG_SCORE_", "_trusted",
    "place", "copies", "words", "features", "score"
)


def test_clashing_names(spark):
    good = "the quick fox number {} jumps over a lazy dog near the old river while seven birds sing songs about summer rain and quiet hills of home word{}"
    docs = spark.createDataFrame(
        [(i, good.format(i, i * 7), "en", "s", 1) for i in range(60)],
        "doc_id long, text string, lang string, source string, n_chars long"
    )
    docs = docs.withColumns({n: F.concat(F.lit(f"{n}:"), "doc_id") for n in NAMES})
    labels = spark.createDataFrame([(i, int(i % 10 > 0), 0) for i in range(60)], "doc_id long, quality int, toxic int")
    for stage in (
        lambda d: gam.accepted(d, labels, cut=0.0),
        lambda d: quality_rules.passing(d, labels),
        ngram_jaccard.keep_one_of_each_group,
        mixing.mixed_documents
    ):
        out = stage(docs)
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r[n] == f"{n}:{r['doc_id']}" for r in rows for n in NAMES)
