"""Exact duplicates, found by a 128-bit content hash and confirmed on the bytes. DataFrame functions only.

Defined results: a null text equals an empty one; an empty table gives an empty result; rows that repeat both doc_id and
text count as members of their group and share its fate in `classes`, while `distinct_rows` leaves one of them; a null
doc_id loses to any other. Only doc_id and text are read by `classes`, so further columns of any name do no harm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partloom.llm.common import cut, text_or_empty


def _keyed(docs: DataFrame) -> DataFrame:
    text = text_or_empty()
    return docs.select(F.col("doc_id"), text.alias("body"), F.unhex(F.md5(text)).alias("content_hash"))


def classes(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, keep_id (largest doc_id of the equal texts), group_size, kept, text_sha256.

    Texts meet once: grouping by (hash, text) compares the bytes of whatever shares a hash, and each task first folds its
    own copies, so a group holding a third of the rows reaches the shuffle as one row per task. Rows learn their class
    over a join of short keys (hash and digest), which adaptive execution splits where one key is hot.
    """
    keyed = _keyed(docs)
    by_text = keyed.groupBy("content_hash", "body").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = by_text.select("content_hash", F.sha2("body", 256).alias("text_sha256"), "keep_id", "group_size")
    # Two different texts under one hash are two groups here; they could only meet again if SHA-256 agreed as well.
    groups = groups.groupBy("content_hash", "text_sha256").agg(
        F.max("keep_id").alias("keep_id"),
        F.when(F.count(F.lit(1)) == 1, F.max("group_size")).otherwise(F.raise_error(F.lit("two texts share MD5 and SHA-256"))).cast("long").alias("group_size"),
    )
    groups = cut(groups)  # a table on each side lets adaptive execution split the rows of a hot text
    rows = keyed.select("doc_id", "content_hash", F.sha2("body", 256).alias("text_sha256"))
    joined = rows.join(groups, ["content_hash", "text_sha256"])
    return joined.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def distinct_rows(docs: DataFrame) -> DataFrame:
    """The rows that stay, one for each distinct text, with every column of docs: the one with the largest doc_id."""
    text = text_or_empty()
    whole = F.struct(F.col("doc_id").alias("first"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c != "text"], F.col("text").isNull().alias("absent"))
    best = docs.select(F.unhex(F.md5(text)).alias("content_hash"), text.alias("body"), whole.alias("row")).groupBy("content_hash", "body").agg(F.max("row").alias("row"))
    back = {c: F.col(f"row.c{i}") for i, c in enumerate(docs.columns) if c != "text"}
    back["text"] = F.when(~F.col("row.absent"), F.col("body"))
    return best.select(*[back[c].alias(c) for c in docs.columns])
