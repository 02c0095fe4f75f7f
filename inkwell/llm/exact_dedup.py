"""Exact duplicates, by built-in operators only.

Texts are normalised (runs of ASCII white space become one space; null counts as empty) and grouped by the 128 bits
of their MD5 together with the normalised text itself, so that the grouping compares bytes inside each hash value
and a hash collision never merges two texts. Partial aggregation leaves one row per distinct text and task before
the shuffle, however large a group of copies is. The way back to the documents joins on the MD5 and the SHA-256,
narrow columns that adaptive execution can split for a hot group; should two different texts ever agree on both,
which the grouping by bytes detects, the job fails instead of merging them.

Defined results: the kept row of a group is the one with the smallest doc_id; ids that are null come last, so a group
of which all ids are null has keep_id null; rows that repeat both doc_id and text share their flags (of them,
drop_exact_duplicates leaves one, whichever way the rows are partitioned). Other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import SPACE, materialize, within_keys, without_keys


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def exact_groups(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    docs = documents.select("doc_id", normalised(F.col("text")).alias("norm"))
    docs = docs.select("doc_id", F.unhex(F.md5("norm")).alias("h"), F.unhex(F.sha2("norm", 256)).alias("sha"), "norm")
    texts = docs.groupBy("h", "sha", "norm").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    classes = texts.groupBy("h", "sha").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("group_size"), F.count(F.lit(1)).alias("n_texts"))
    classes = materialize(classes, "classes")  # so that both sides of the join are exchanged, and a hot group can be split
    size = F.when(F.col("n_texts") == 1, F.col("group_size")).otherwise(F.raise_error(F.lit("different texts agree on MD5 and SHA-256")).cast("bigint"))
    return docs.select("doc_id", "h", "sha").join(classes, ["h", "sha"]).select(
        "doc_id",
        "keep_id",
        size.alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_exact_duplicates(documents: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns; of rows that repeat doc_id and text, the first in order of its
    columns.

    Rows are told apart by id and text digest. Only rows that may be dropped are shuffled with their texts."""
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"))
    rows = materialize(exact_groups(documents).select(F.concat(key, "text_sha256").alias("row"), "kept"), "rows")
    dropped = rows.filter("NOT kept").select("row").distinct()
    repeated = rows.filter("kept").groupBy("row").count().filter("count > 1").select("row")
    # the columns travel as one, so that no name of theirs meets one of the work
    marked = documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("whole"), F.concat(key, F.sha2(normalised(F.col("text")), 256)).alias("row"))
    rest = without_keys(marked, "row", dropped)
    again = within_keys(rest, "row", repeated).join(repeated, "row", "left_semi")
    one = again.groupBy("row").agg(F.min_by("whole", F.to_json("whole")).alias("whole"))
    return without_keys(rest, "row", repeated).select("whole").unionByName(one.select("whole")).select("whole.*")
