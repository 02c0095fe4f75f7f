"""Mixing sources to target weights by weighted fair queueing, with built-in operators.

Every source gets a share of the total budget in proportion to its weight, but at most ``repeats`` times its own
size; what is cut off is shared again by weight until no source is above (the level is found in closed form from the
sources sorted by size over weight). Inside a source the documents stand in a shuffled order that depends on a seed
and the id only. A copy of a document is finished at virtual time (tokens of its source up to its end, earlier rounds
included) / target. The copies of all sources, sorted by virtual time, are taken until the budget is used up.

Running sums never pass one task: inside a source an order of n rows is cut into about sqrt(n) buckets by hash, bucket
sums are added up first, and windows run inside buckets only. In the global order the copies are added up by the
logarithm of their virtual time (FINENESS steps a doubling, a bounded number whatever the data); only the copies of the
step in which the budget ends are ordered, again in about sqrt(n) buckets. What meets in one window is one row for each
source, bucket or step.

Defined results: a null text has size 0; documents of size 0 are never taken; a null source is a source of its own and
the last one; a null doc_id is ordered before the others; rows that repeat a doc_id are documents of their own. An
empty table gives an empty result. All other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.llm.common import WORD, materialize, within_keys

#: Steps of virtual time for each doubling; there are 64 doublings at most.
FINENESS = 4096
#: Up to so many sources their targets are broadcast; beyond, the join is left to adaptive execution.
BROADCAST_SOURCES = 50_000


def sized(documents: DataFrame) -> DataFrame:
    """doc_id, source, size: number of words of the whole text."""
    return documents.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float = 1.0, repeats: int = 3) -> DataFrame:
    """One row per source: source, source_no, source_size, n_docs, weight, target. Weights repeat along the sources in order of
    code points (null last). The few rows per source are the only ones that meet in a single window."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    every = Window.partitionBy(F.lit(1))
    at = F.row_number().over(every.orderBy(F.col("source").isNull(), F.col("source").cast("binary")))
    by = by.withColumn("source_no", at).withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("source_no") - 1) % len(weights) + 1))
    total = F.sum("source_size").over(every) * F.lit(float(share))
    # Filled up to a level, sources of small size / weight reach their cap first: those before the first source that
    # stays below its cap hold repeats * size, and the rest share what is left by weight.
    fills = F.col("source_size") * F.lit(float(repeats)) / F.col("weight")
    upto = every.orderBy(fills, "source_no").rowsBetween(Window.unboundedPreceding, -1)
    by = by.withColumns({"total": total, "fills": fills, "capped": F.coalesce(F.sum(F.col("source_size") * F.lit(float(repeats))).over(upto), F.lit(0.0)), "weighed": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0))})
    level = (F.col("total") - F.col("capped")) / F.col("weighed")
    by = by.withColumn("level", F.min(F.when(level <= F.col("fills"), F.struct("fills", "source_no", level.alias("level")))).over(every)["level"])
    target = F.least(F.coalesce(F.col("weight") * F.col("level"), F.lit(float("inf"))), F.col("source_size") * F.lit(float(repeats)))
    return by.select("source", "source_no", "source_size", "n_docs", "weight", target.alias("target"))


def _running(rows: DataFrame, keys: list[str], order: list[Column], amount: str, out: str) -> DataFrame:
    """Adds the inclusive running sum of amount in order. The columns keys name a bucket; the last is its place."""
    sums = rows.groupBy(*keys).agg(F.sum(amount).alias("__sum"))
    before = Window.partitionBy(*(keys[:-1] or [F.lit(1)])).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))
    inside = F.sum(amount).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("__inside", inside).join(sums, keys).withColumn(out, F.col("__before") + F.col("__inside")).drop("__before", "__inside")


def fair_queue(documents: DataFrame, weights: Sequence[float], share: float = 1.0, repeats: int = 3, seed: str = "0") -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, virtual_time (of its first copy), taken_copies.

    By the virtual time 1 every source has finished at most its target, so all copies up to 1 fit the budget: their
    number per document is a division. Only copies that finish later go through the global order."""
    sizes = materialize(sized(documents), "sizes")
    targets = materialize(source_targets(sizes, weights, share, repeats), "targets").withColumnRenamed("source", "named")
    few = targets.count() <= BROADCAST_SOURCES
    rows = sizes.join(F.broadcast(targets) if few else targets, F.col("source").eqNullSafe(F.col("named"))).drop("named")
    shuffle = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    spread = F.conv(F.substring("shuffle", 1, 8), 16, 10).cast("long")
    rows = rows.withColumn("shuffle", shuffle).withColumn("place", (spread * F.ceil(F.sqrt("n_docs")) / F.lit(float(1 << 32))).cast("long"))
    rows = _running(rows, ["source_no", "place"], [F.col("shuffle"), F.col("doc_id"), F.col("size")], "size", "upto")
    time = F.when((F.col("size") > 0) & (F.col("target") > 0), F.col("upto") / F.col("target"))
    early = F.when(time.isNotNull(), F.least(F.lit(repeats), F.greatest(F.lit(0), F.floor((F.col("target") - F.col("upto")) / F.col("source_size")) + 1))).otherwise(F.lit(0)).cast("int")
    rows = materialize(rows.withColumn("virtual_time", time).withColumn("early", early).withColumn("row", F.monotonically_increasing_id()), "queued")
    # what is left of the budget goes to the copies that finish next, in global order of virtual time
    copies = rows.filter(F.col("virtual_time").isNotNull() & (F.col("early") < repeats)).withColumn("round", F.explode(F.sequence(F.col("early"), F.lit(repeats - 1))))
    copies = copies.select("row", "doc_id", "size", "source_no", (F.col("virtual_time") + F.col("round") * F.col("source_size") / F.col("target")).alias("finish"))
    copies = copies.withColumn("step", F.floor(F.log2(F.greatest(F.col("finish"), F.lit(1.0))) * FINENESS).cast("int"))
    rest = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total"), F.coalesce(F.sum(F.col("size") * F.col("early")), F.lit(0)).alias("used"), F.count(F.lit(1)).alias("n"))
    rest = rest.select(F.floor(F.col("total") * F.lit(float(share))) - F.col("used"), F.ceil(F.sqrt("n"))).first()
    left, cuts = int(rest[0]), max(1, int(rest[1]))
    steps = copies.groupBy("step").agg(F.sum("size").alias("sum"))
    steps = steps.withColumn("upto", F.sum("sum").over(Window.partitionBy(F.lit(1)).orderBy("step")))
    ends = steps.filter(F.col("upto") > left).agg(F.min_by(F.struct("step", (F.col("upto") - F.col("sum")).alias("before")), "step").alias("s")).select("s.*").first()
    if ends["step"] is None:
        late = copies.select("row")
    else:
        low, high = (2.0 ** ((ends["step"] + i) / FINENESS) for i in (0, 1))
        last = copies.filter(F.col("step") == ends["step"]).withColumn("cut", F.floor((F.col("finish") - low) / (high - low) * cuts).cast("long"))
        queue = _running(last, ["cut"], [F.col("finish"), F.col("source_no"), F.col("doc_id"), F.col("size")], "size", "queue")
        late = copies.filter(F.col("step") < ends["step"]).select("row").unionByName(queue.filter(F.col("queue") <= left - ends["before"]).select("row"))
    late = late.groupBy("row").agg(F.count(F.lit(1)).cast("int").alias("late"))
    done = rows.join(late, "row", "left").withColumn("taken_copies", F.col("early") + F.coalesce("late", F.lit(0)))
    return done.select("doc_id", "source", "size", "source_size", "target", "virtual_time", "taken_copies")


def mixture(documents: DataFrame, weights: Sequence[float], share: float = 1.0, repeats: int = 3, seed: str = "0") -> DataFrame:
    """The documents of the mix with all their columns, one row per copy that is taken.

    Rows are told apart by id and text digest. Rows that share both are documents of their own; what the mix takes of
    them is dealt out evenly, and what is left over of that comes from the one that is first in order of its columns."""
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce("text", F.lit(""))))
    columns = F.struct(*(F.col(f"`{c}`") for c in documents.columns))
    keyed = documents.select(columns.alias("whole"), key.alias("row"))
    queue = fair_queue(documents.select(key.alias("doc_id"), "source", "text"), weights, share, repeats, seed)
    taken = queue.groupBy(F.col("doc_id").alias("key")).agg(F.sum("taken_copies").alias("taken"), F.count(F.lit(1)).alias("rows")).filter("taken > 0")
    taken = materialize(taken.select("key", F.floor(F.col("taken") / F.col("rows")).cast("int").alias("each"), (F.col("taken") % F.col("rows")).cast("int").alias("rest")), "taken")
    even = keyed.join(taken.filter("each > 0"), F.col("row") == F.col("key")).withColumn("copy", F.explode(F.sequence(F.lit(1), "each"))).select("whole")
    some = taken.filter("rest > 0")
    one = within_keys(keyed, "row", some.select("key")).join(some, F.col("row") == F.col("key"))
    one = one.groupBy("row").agg(F.min_by("whole", F.to_json("whole")).alias("whole"), F.first("rest").alias("rest"))
    return even.unionByName(one.withColumn("copy", F.explode(F.sequence(F.lit(1), "rest"))).select("whole")).select("whole.*")
