"""Text quality by the perplexity of an interpolated modified Kneser-Ney model of trusted text (`ngrams.py`).

A document is kept if its perplexity is at most a quantile of that of trusted texts in its language; those texts are a
quarter that the model has not seen.

Defined results: a null, empty or blank text has no perplexity and isn't kept; a null language is one of its own; a
language without trusted texts takes the quantile over all languages; without any trusted text nothing is judged and every
text with characters is kept; of several labels of a document the worst counts; repeated rows each get a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partloom.llm import ngrams
from partloom.llm.common import cut
from partloom.llm.folded import SYMBOLS, count, perplexities, smoothed  # noqa: F401 (the small model, by its old place)

QUANTILE = 0.99
#: One trusted text in so many is not learned from; the quantiles are theirs, as a model flatters what it has seen.
HELD_OUT = 4


def judged(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """doc_id, lang, perplexity, threshold, kept for every row of docs. labels: doc_id, quality, toxic (0 or 1)."""
    trusted = labels.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("x")).where("q = 1 and x = 0").select(F.col("doc_id").alias("trusted_id"))
    fitted = F.pmod(F.xxhash64("trusted_id"), F.lit(HELD_OUT)) != 0
    scored = cut(ngrams.perplexities(docs, trusted.where(fitted).select(F.col("trusted_id").alias("doc_id"))))
    at = F.percentile_approx("perplexity", F.lit(quantile), F.lit(10_000))
    for measured in (trusted.where(~fitted), trusted):  # all of them if none is held out
        known = scored.join(measured, F.col("doc_id") == F.col("trusted_id"), "left_semi").where("perplexity is not null")
        if (overall := known.agg(at).first()[0]) is not None:
            break
    each = known.groupBy(F.coalesce("lang", F.lit("")).alias("of_lang"), F.col("lang").isNull().alias("unknown")).agg(at.alias("own"))
    out = scored.join(each, (F.coalesce("lang", F.lit("")) == F.col("of_lang")) & (F.col("lang").isNull() == F.col("unknown")), "left")
    out = out.withColumn("threshold", F.coalesce("own", F.lit(overall).cast("double")))
    kept = F.col("perplexity").isNotNull() & F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))
    return out.select("doc_id", "lang", "perplexity", "threshold", kept.alias("kept"))
