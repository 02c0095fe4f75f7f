"""Near duplicates by a MinHash LSH forest.

Every document is sketched once: words (ASCII white space cut, A-Z lower-cased), the set of its distinct word
shingles, and ``TREES * OWN`` minimum hashes. Documents with the same word sequence form one class, so that copies
cost one row each and are never paired. Each tree orders the classes by the hashes from its own place in the signature
on. Candidates come from these orders in three rounds, and after each the links found are joined into components, so
that the next looks only at ends in different ones:

1. neighbours: in ORDERS of the sorted orders every class meets its predecessor, if they share a prefix of SHALLOW
   hashes; their prefix is the longest that either shares with any class on that side. First only the neighbour that
   agrees best.
2. all other neighbours, and all pairs of the small regions of all trees. A region holds the classes with a common
   prefix; depth adapts to it: one of at most ``region`` classes is done, a larger one is cut by the next STEP hashes,
   down to FULL hashes.
3. the regions that are still large at full depth make up families. Their classes meet the family's hub, the class with
   the most links so far; then those still outside the family's largest component meet all members in blocks, signatures
   first and then full sets, so pairs are never rows. Where families are dense copies of each other few are left for
   that; it is the one step whose work can grow faster than the input (50 ns of CPU a pair for the signatures).

Inside a small region, the classes' signatures are compared by one byte of each hash, so only pairs that agree well
become rows. A pair that shares no region is no candidate by regions: with a chance of (1 - J^SHALLOW)^TREES, 5e-8 at
0.80 and 6e-11 at 0.85; if all its regions are cut to full depth, (1 - J^FULL)^TREES, 6e-5 and 3e-7. Candidates are judged by the whole signature, with a margin
of five standard deviations below the threshold, then by the full shingle sets. Verified links are joined by label
propagation with pointer jumping; later rounds join the components found before, not their members. A class has at most two neighbours in an order, so no join of the first two rounds
has a frequent key; those of the third have one row for each family on one side, so that the other can be split.

Null or empty texts and texts without words have no shingles, link with nothing and are their own component; texts
with fewer words than a shingle have their whole sequence as one shingle. Rows that repeat a doc_id are judged each
by its own text (classes with the same smallest doc_id count as one); a null doc_id joins no class of its own: its
row takes the component of its text, or null, and kept is false. All other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.llm.common import materialize, slices, within_keys, without_keys

#: Trees, hashes of their own, hashes that order them (the next trees' follow a tree's own), least and full depth of
#: regions and the step between, the classes of a small region, and the orders in which neighbours meet.
TREES, OWN, ORDER, SHALLOW, FULL, STEP, REGION, ORDERS = 32, 4, 12, 4, 6, 2, 24, 4
WORDS_KEPT = 200_000
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53], np.uint64)


def _finish(x: np.ndarray) -> np.ndarray:
    """Finalising mix of 64-bit values."""
    x = (x ^ (x >> np.uint64(33))) * _MIX[4]
    x = (x ^ (x >> np.uint64(29))) * _MIX[5]
    return x ^ (x >> np.uint64(32))


class Shingler:
    """Texts to arrays of 64-bit shingle hashes; remembers the hashes of frequent words, a bounded number of them."""

    def __init__(self, words: int):
        self.k, self.known = words, {}
        self.odd = np.array([int(_MIX[i % 6]) * (2 * i + 1) % (1 << 64) | 1 for i in range(words)], np.uint64)

    @staticmethod
    def split(text: str | None) -> list[bytes]:
        return (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes, lower() and split() know ASCII only

    def hashes(self, words: list[bytes]) -> np.ndarray:
        """One hash for each window of k words, repeated ones included."""
        if not words:
            return np.empty(0, np.uint64)
        known = self.known
        if new := [w for w in set(words) if w not in known]:
            if len(known) + len(new) > WORDS_KEPT:
                known.clear()
                new = set(words)
            for w in new:
                known[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        if len(h) < self.k:
            h = np.concatenate([h, np.full(self.k - len(h), len(h), np.uint64)])
        n = len(h) - self.k + 1
        return _finish(reduce(lambda a, i: _finish(a) + h[i : i + n] * self.odd[i], range(self.k), np.zeros(n, np.uint64)))

    def shingles(self, text: str | None) -> np.ndarray:
        return np.unique(self.hashes(self.split(text)))


def signature(shingles: np.ndarray, multipliers: np.ndarray) -> bytes:
    """The minimum of each multiplied hash, as little-endian 32-bit values."""
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(len(multipliers), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 1024):
        np.minimum(best, (low[at : at + 1024, None] * multipliers[None, :]).min(axis=0), out=best)
    return best.tobytes()


def _multipliers(n: int) -> np.ndarray:
    return np.random.RandomState(20240501).randint(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32) | np.uint32(1)


def class_key(words: list[bytes]) -> bytes:
    """128-bit hash of a word sequence."""
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def sketches(documents: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, key (128-bit hash of the word sequence), n_shingles, sig and tiny (one byte of each hash of sig; both null
    without words) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, mult = Shingler(words), _multipliers(TREES * OWN)
        for b in slices(batches):
            keys, sizes, sigs, seen = [], [], [], {}
            for text in b.column("text").to_pylist():
                seq = cut.split(text)
                key = class_key(seq)
                if key not in seen:
                    s = np.unique(cut.hashes(seq))
                    seen[key] = (len(s), signature(s, mult) if len(s) else None)
                keys.append(key)
                sizes.append(seen[key][0])
                sigs.append(seen[key][1])
            tiny = [None if g is None else g[::4] for g in sigs]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary()), pa.array(tiny, pa.binary())], ["doc_id", "key", "n_shingles", "sig", "tiny"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, key binary, n_shingles long, sig binary, tiny binary")


def _similar_sizes(a: str, b: str, percent: int):
    return F.lit(100) * F.least(F.col(a), F.col(b)) >= F.lit(percent) * F.greatest(F.col(a), F.col(b))


def _small_pairs(rows: DataFrame, label: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs inside each region of rows (region, cls, n), which must be small, that no links join yet and whose
    signatures agree well enough by one byte of each hash. A region's few classes are gathered; pairs that disagree
    are never rows."""
    rows = materialize(rows.join(label, "cls", "left").select("region", "cls", "n", F.coalesce("component", "cls").alias("component")), "members")
    torn = materialize(rows.groupBy("region").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("region"), "torn")
    held = within_keys(rows, "region", torn).join(nodes.select("cls", "tiny"), "cls")
    gathered = held.groupBy("region").agg(F.collect_list(F.struct("cls", "component", "n", "tiny")).alias("members")).select("members")
    least = least_agreement(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1024):
            lists = b.column("members")
            sizes, flat = np.diff(lists.offsets.to_numpy()), lists.flatten()
            cls, component, n = (flat.field(c).to_numpy() for c in ("cls", "component", "n"))
            tiny = np.frombuffer(b"".join(flat.field("tiny").to_pylist()), np.uint8).reshape(len(cls), -1)
            region = np.repeat(np.arange(len(sizes)), sizes)
            pairs = []
            for gap in range(1, int(sizes.max(initial=0))):
                i = np.flatnonzero((region[gap:] == region[:-gap]) & (component[gap:] != component[:-gap]))
                i = i[100 * np.minimum(n[i], n[i + gap]) >= percent * np.maximum(n[i], n[i + gap])]
                i = i[(tiny[i] == tiny[i + gap]).sum(axis=1) >= least]
                pairs.append(np.stack([np.minimum(cls[i], cls[i + gap]), np.maximum(cls[i], cls[i + gap])]))
            a, c = np.concatenate(pairs, axis=1) if pairs else np.empty((2, 0), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], ["a", "b"])

    return gathered.mapInArrow(run, "a long, b long").distinct()


def _with_regions(rows: DataFrame, depth: int) -> DataFrame:
    """rows (tree, pre, cls, n) that share their prefix of this depth with another class, with the region and its size.
    Most prefixes are alone; their rows are dropped before the join."""
    keyed = rows.withColumn("region", F.xxhash64("tree", F.expr(f"substring(pre, 1, {4 * depth})")))
    sizes = materialize(keyed.groupBy("region").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), f"sizes-{depth}")
    return materialize(within_keys(keyed, "region", sizes.select("region")).join(sizes, "region"), f"regions-{depth}")


def orders(nodes: DataFrame) -> DataFrame:
    """tree, pre (the hashes that order it), cls, n, region, size of the classes that share SHALLOW hashes with another."""
    around = nodes.select("cls", "n", F.concat("sig", F.expr(f"substring(sig, 1, {4 * (ORDER - OWN)})")).alias("sig"))
    rows = around.select(F.posexplode(F.array(*(F.expr(f"substring(sig, {4 * OWN * t + 1}, {4 * ORDER})") for t in range(TREES)))).alias("tree", "pre"), "cls", "n")
    return _with_regions(rows, SHALLOW)


def forest(shared: DataFrame, region: int = REGION) -> tuple[DataFrame, DataFrame | None]:
    """The regions of the orders, as rows (region, cls, n): small ones, each at the depth that made it small, and those
    that stay large at full depth (None: there are none)."""
    small = []
    for depth in range(SHALLOW, FULL + 1, STEP):
        small.append(shared.filter(F.col("size") <= region).select("region", "cls", "n"))
        large = shared.filter(F.col("size") > region)
        if large.isEmpty():
            return reduce(DataFrame.unionByName, small), None
        if depth < FULL:
            shared = _with_regions(large.select("tree", "pre", "cls", "n"), depth + STEP)
    return reduce(DataFrame.unionByName, small), large.select("region", "cls", "n")


def neighbours(shared: DataFrame, percent: int, orders: int = ORDERS) -> DataFrame:
    """(a, b): in each of the first orders every class with its predecessor, if they share SHALLOW hashes and their sizes allow it.

    The orders are range-sorted over all tasks; where a task ends, its last row meets the next one's first."""
    parts = int(shared.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = shared.filter(F.col("tree") < orders).select("tree", "pre", "cls", "n").repartitionByRange(parts, "tree", "pre", "cls").sortWithinPartitions("tree", "pre", "cls")
    kinds = {"tree": pa.int32(), "pre": pa.binary(), "cls": pa.int64(), "n": pa.int64(), "place": pa.int64(), "other": pa.int64(), "m": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = place = None
        for b in batches:
            if not b.num_rows:
                continue
            place = 2 * b.column("part")[0].as_py()
            rows = pa.Table.from_batches([b.select(["tree", "pre", "cls", "n"])])
            edge = rows.slice(0, 1 if last is None else 0)
            if last is not None:
                rows = pa.concat_tables([last, rows])
            tree, cls, n = (rows.column(c).to_numpy() for c in ("tree", "cls", "n"))
            pre = np.frombuffer(b"".join(rows.column("pre").to_pylist()), np.uint32).reshape(len(tree), -1)[:, :SHALLOW]
            at = np.flatnonzero((tree[1:] == tree[:-1]) & (pre[1:] == pre[:-1]).all(axis=1))
            yield _table(kinds, cls=cls[at], n=n[at], other=cls[at + 1], m=n[at + 1])
            yield _table(kinds, **{c: edge.column(c) for c in ("tree", "pre", "cls", "n")}, place=[place] * edge.num_rows)
            last = rows.slice(rows.num_rows - 1)
        if last is not None:
            yield _table(kinds, **{c: last.column(c) for c in ("tree", "pre", "cls", "n")}, place=[place + 1])

    found = materialize(ordered.withColumn("part", F.spark_partition_id()).mapInArrow(run, "tree int, pre binary, cls long, n long, place long, other long, m long"), "neighbours")
    ends = found.filter("place IS NOT NULL")  # two rows for each task
    before = F.lag(F.struct("tree", "pre", "cls", "n", "place")).over(Window.partitionBy(F.lit(1)).orderBy("place"))
    met = ends.withColumn("before", before).filter(f"before.tree = tree AND substring(before.pre, 1, {4 * SHALLOW}) = substring(pre, 1, {4 * SHALLOW}) AND before.place % 2 = 1 AND place % 2 = 0")
    pairs = found.filter("other IS NOT NULL").select("cls", "n", "other", "m").unionByName(met.select(F.col("before.cls").alias("cls"), F.col("before.n").alias("n"), F.col("cls").alias("other"), F.col("n").alias("m")))
    return pairs.filter(_similar_sizes("n", "m", percent)).select(F.least("cls", "other").alias("a"), F.greatest("cls", "other").alias("b")).distinct()


def _table(kinds: dict[str, pa.DataType], **columns) -> pa.RecordBatch:
    """A batch of the columns given, the others null."""
    rows = len(next(iter(columns.values())))
    cast = lambda c, t: (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else pa.array(c)).cast(t)
    return pa.RecordBatch.from_arrays([cast(columns[c], t) if c in columns else pa.nulls(rows, t) for c, t in kinds.items()], list(kinds))


def least_agreement(percent: int) -> int:
    """Equal hashes that a pair at the threshold has, less five standard deviations."""
    t, n = percent / 100, TREES * OWN
    return math.floor(n * (t - 5 * math.sqrt(t * (1 - t) / n)))


def likely(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """a, b, agree (equal hashes) of the pairs whose signatures agree well enough."""
    sig, least = nodes.select("cls", "sig"), least_agreement(percent)
    both = pairs.join(sig.toDF("a", "sa"), "a").join(sig.toDF("b", "sb"), "b")
    return both.select("a", "b", "sa", "sb").mapInArrow(_agreeing(least), "a long, b long, agree int")


def _agreeing(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if x.num_rows:
                a, b = (np.frombuffer(b"".join(x.column(c).to_pylist()), np.uint32).reshape(x.num_rows, -1) for c in ("sa", "sb"))
                agree = (a == b).sum(axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([x.column("a"), x.column("b"), pa.array(agree)], ["a", "b", "agree"]).filter(pa.array(agree >= least))

    return run


def apart(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """The pairs (a, b) whose ends are in different components."""
    one, two = label.toDF("a", "ca"), label.toDF("b", "cb")
    both = pairs.join(one, "a", "left").join(two, "b", "left")
    return both.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def class_texts(documents: DataFrame, nodes: DataFrame, cls: DataFrame) -> DataFrame:
    """doc_id, text of the classes cls (one column). An id that is repeated may have other texts, or none, besides those
    of its class; they are left out."""
    keys = nodes.join(cls, "cls", "left_semi").select(F.col("cls").alias("doc_id"), "key")
    rows = within_keys(documents.select("doc_id", "text").filter("text IS NOT NULL"), "doc_id", cls).join(keys, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            own = pa.array([class_key(Shingler.split(t)) == k for t, k in zip(b.column("text").to_pylist(), b.column("key").to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").filter(own), b.column("text").filter(own)], ["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "key").mapInArrow(run, "doc_id long, text string")


def verified(pairs: DataFrame, documents: DataFrame, nodes: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs with 100 * |intersection| >= percent * |union| of the full shingle sets."""
    pairs = materialize(pairs, "likely")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    texts = materialize(class_texts(documents, nodes, ids), "texts")
    both = pairs.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = Shingler(words)
        for x in slices(batches):
            held, keep = {}, []
            for p, q, s, t in zip(*(x.column(c).to_pylist() for c in ("a", "b", "ta", "tb")), strict=True):
                for i, text in ((p, s), (q, t)):
                    if (i, text) not in held:
                        if len(held) > 64:
                            held.clear()
                        held[i, text] = cut.shingles(text)
                u, v = held.get((p, s)), held.get((q, t))
                u = cut.shingles(s) if u is None else u
                v = cut.shingles(t) if v is None else v
                common = len(np.intersect1d(u, v, assume_unique=True))
                keep.append(100 * common >= percent * (len(u) + len(v) - common))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([x.column("a").filter(keep), x.column("b").filter(keep)], ["a", "b"])

    return materialize(both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long").distinct(), "links")


def components(links: DataFrame) -> DataFrame:
    """(cls, component): for every end of a link the smallest end it reaches."""
    both = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "ends")
    labels = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("l")).select(F.col("a").alias("v"), "l"), "labels")
    while True:
        near = both.join(labels, both.b == labels.v).groupBy("a").agg(F.min("l").alias("m"))
        step = labels.join(near, labels.v == near.a).select("v", F.col("l").alias("old"), F.least("l", "m").alias("l"))
        up = labels.select(F.col("v").alias("w"), F.col("l").alias("jump"))
        step = materialize(step.join(up, step.l == up.w, "left").select("v", "old", F.least("l", F.coalesce("jump", "l")).alias("l")), "labels")
        if step.filter("l < old").isEmpty():
            return labels.select(F.col("v").alias("cls"), F.col("l").alias("component"))
        labels = step.select("v", "l")


def merged(label: DataFrame, links: DataFrame) -> DataFrame:
    """The components (cls, component) after more links (a, b).

    Only what the links change is worked on: their ends become the components they are in, and of these only those that
    a link joins take part in the propagation."""
    one, two = label.toDF("a", "ca"), label.toDF("b", "cb")
    named = links.join(one, "a", "left").join(two, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    between = materialize(named.filter("a <> b").distinct(), "between")
    if between.isEmpty():
        return label
    new = components(between)
    every = label.unionByName(new.select("cls", F.col("cls").alias("component"))).distinct()  # a component's own name is in label, or in no link so far
    return materialize(every.join(new.toDF("component", "joined"), "component", "left").select("cls", F.coalesce("joined", "component").alias("component")), "merged")


def near_duplicates(documents: DataFrame, words: int = 5, percent: int = 80, region: int = REGION) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    sketch = materialize(sketches(documents, words), "sketches")
    classes = sketch.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("cls"))
    own = sketch.select(F.col("doc_id").alias("cls"), "key", F.col("n_shingles").alias("n"), "sig", "tiny").join(classes, ["key", "cls"])
    nodes = materialize(own.groupBy("cls", "key").agg(F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("tiny").alias("tiny")), "nodes")
    judge = lambda pairs: verified(pairs.select("a", "b"), documents, nodes, words, percent)
    shared = orders(nodes)
    # first each class with the neighbour that agrees best
    near = materialize(likely(neighbours(shared, percent), nodes, percent), "near")
    ends = near.select(F.explode(F.array("a", "b")).alias("cls"), F.struct("agree", "a", "b").alias("pair"))
    links = judge(ends.groupBy("cls").agg(F.max("pair").alias("pair")).select("pair.a", "pair.b").distinct())
    label = components(links)
    # then the other neighbours and the pairs of small regions
    small, large = forest(shared, region)
    others = apart(near, label).unionByName(likely(_small_pairs(small, label, nodes, percent), nodes, percent).select("a", "b")).distinct()
    more = judge(others)
    label = merged(label, more)
    # then what regions that stay large have besides
    if large is not None:
        members = _families(large)
        label = merged(label, judge(_hub_pairs(members, label, links.unionByName(more), nodes, percent)))
        label = merged(label, _block_links(members, label, documents, nodes, words, percent))
    known = materialize(classes.join(label, "cls", "left").select("key", F.coalesce("component", "cls").alias("component_id")), "classes")
    out = sketch.select("doc_id", "key", "n_shingles").join(known, "key", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def _families(large: DataFrame) -> DataFrame:
    """(family, cls): classes of large regions (region, cls) that share one, or are joined by others that do, have one
    family. Regions and classes take the smallest name they meet in turn, until none changes."""
    rows = large.select("region", "cls").withColumn("family", F.col("region"))
    while True:
        of_class = rows.groupBy("cls").agg(F.min("family").alias("f"))
        rows_f = rows.join(of_class, "cls").select("region", "cls", "family", "f")
        of_region = materialize(rows_f.groupBy("region").agg(F.min("f").alias("g"), F.max("family").alias("was"), F.min("family").alias("low")), "of-region")
        rows = materialize(rows.select("region", "cls").join(of_region.select("region", F.col("g").alias("family")), "region"), "family-rows")
        if of_region.filter("g < was").isEmpty():
            return materialize(rows.select("family", "cls").distinct(), "families")


def _placed(members: DataFrame, label: DataFrame, nodes: DataFrame) -> DataFrame:
    """family, cls, component, n, sig of the members."""
    with_label = members.join(label, "cls", "left").select("family", "cls", F.coalesce("component", "cls").alias("component"))
    return with_label.join(nodes.select("cls", "n", "sig"), "cls")


def _hub_pairs(members: DataFrame, label: DataFrame, links: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Each family's members outside its hub's component with the hub, as far as sizes and signatures allow."""
    degree = links.select(F.explode(F.array("a", "b")).alias("cls")).groupBy("cls").agg(F.count(F.lit(1)).alias("degree"))
    hub = members.join(degree, "cls", "left").groupBy("family").agg(F.max_by("cls", F.struct(F.coalesce("degree", F.lit(0)), -F.col("cls"))).alias("hub"))
    at = materialize(_placed(members, label, nodes), "placed")
    hubs = materialize(at.join(hub, "family").filter("cls = hub").select("family", "hub", F.col("component").alias("hc"), F.col("n").alias("m"), F.col("sig").alias("sb")), "hubs")
    met = at.join(hubs, "family").filter(F.col("component") != F.col("hc")).filter(_similar_sizes("n", "m", percent))
    found = met.select(F.col("cls").alias("a"), F.col("hub").alias("b"), F.col("sig").alias("sa"), "sb").mapInArrow(_agreeing(least_agreement(percent)), "a long, b long, agree int")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _block_links(members: DataFrame, label: DataFrame, documents: DataFrame, nodes: DataFrame, words: int, percent: int) -> DataFrame:
    """Links of the classes outside the largest component of their family with its other components.

    A row is a block of the ones with a block of all; signatures and then full sets are compared inside the task, and
    only links leave it, one for each class and component that it reaches in a block."""
    at = materialize(_placed(members, label, nodes), "placed")
    most = at.groupBy("family", "component").agg(F.count(F.lit(1)).alias("held")).groupBy("family").agg(F.max_by("component", F.struct("held", "component")).alias("most"))
    at = materialize(at.join(materialize(most, "most"), "family").withColumn("out", F.col("component") != F.col("most")), "judged")
    at = at.join(at.filter("out").select("family").distinct(), "family", "left_semi")
    texts = class_texts(documents, nodes, at.select("cls").distinct()).withColumnRenamed("doc_id", "cls")
    held = materialize(at.join(texts, "cls"), "texts")

    def packed(rows: DataFrame, name: str, size: int) -> DataFrame:
        """One row per family and block of about size classes and 4 MB."""
        cuts = materialize(rows.groupBy("family").agg(F.ceil(F.greatest(F.count(F.lit(1)) / size, F.sum(F.length("text")) / 4e6)).cast("int").alias("cuts")), "cuts")
        placed = rows.join(cuts, "family").withColumn(name, F.pmod(F.xxhash64("cls", F.lit(5)), F.col("cuts")).cast("int"))
        return placed.groupBy("family", name, F.col("cuts").alias(f"{name}_cuts")).agg(F.collect_list(F.struct("cls", "component", "n", "sig", "text")).alias(f"{name}_rows"))

    few = materialize(packed(held.filter("out"), "few", 256), "apart")
    counts = few.groupBy("family").agg(F.max("few_cuts").cast("int").alias("cuts_met"))
    every = packed(held, "many", 512).join(counts, "family")
    met = every.withColumn("few", F.explode(F.sequence(F.lit(0), F.col("cuts_met") - 1))).join(few, ["family", "few"]).select("few_rows", "many_rows")
    least = least_agreement(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = Shingler(words)
        for x in slices(batches, 1):
            sides = []
            for c in ("few_rows", "many_rows"):
                rows = x.column(c).flatten()
                sig = np.frombuffer(b"".join(rows.field("sig").to_pylist()), np.uint32).reshape(len(rows), -1)
                sides.append((*(rows.field(f).to_numpy() for f in ("cls", "component", "n")), sig, rows.field("text")))
            (cls, component, n, sig, text), (cls_m, component_m, n_m, sig_m, text_m) = sides
            sets: dict[int, np.ndarray] = {}
            a, b = [], []
            for i in range(len(cls)):
                fit = np.flatnonzero((component_m != component[i]) & (100 * np.minimum(n_m, n[i]) >= percent * np.maximum(n_m, n[i])))
                agree = (sig_m[fit] == sig[i]).sum(axis=1)
                fit, agree = fit[agree >= least], agree[agree >= least]
                mine, reached = None, set()
                for j in fit[np.argsort(-agree, kind="stable")].tolist():
                    if component_m[j] in reached:
                        continue
                    mine = cut.shingles(text[i].as_py()) if mine is None else mine
                    if j not in sets:
                        sets[j] = cut.shingles(text_m[j].as_py())
                    common = len(np.intersect1d(mine, sets[j], assume_unique=True))
                    if 100 * common >= percent * (len(mine) + len(sets[j]) - common):
                        reached.add(component_m[j])
                        a.append(min(cls[i], cls_m[j]))
                        b.append(max(cls[i], cls_m[j]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return materialize(met.mapInArrow(run, "a long, b long").distinct(), "family-links")


def drop_near_duplicates(documents: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The documents that stay, one of each group, with all their columns. Rows without an id stay."""
    judged = near_duplicates(documents, words, percent).filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("kept").alias("kept"))
    whole = documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("whole"), "doc_id")
    return without_keys(whole, "doc_id", materialize(judged.filter("NOT kept").select("doc_id"), "dropped")).select("whole.*")
