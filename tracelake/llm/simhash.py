"""SimHash near-duplicate detection by multi-index hashing.

A fingerprint is the bitwise majority of the XXH64 (seed 42) of a text's word shingles. Documents are first gathered by
fingerprint, so that exact copies cost one row. Fingerprints at most RADIUS = 2 bits apart are found through two tables of
32-bit segments: of two such fingerprints either the first segments differ by at most one bit or the second segments are
equal. Each fingerprint therefore looks up the Hamming ball of radius 1 (33 values) in the first table and its own value in
the second; matches are kept if the whole distance is small enough.

A segment value that more than HOT fingerprints share isn't looked up pair by pair: there the rows meet on the other segment
with two of its 32 bits masked (496 masks), where a key has at most four fingerprints a side. That finds the same links with
rows in proportion to the group.

Connected groups come from alternating large-star and small-star steps over tables in the shared folder; at most FEW_LINKS links are
closed in one task.

Defined cases: a null text or one without words has fingerprint 0 and links like any other. Texts shorter than a shingle
count as one shingle. Rows with the same fingerprint, repeated rows among them, are in one group. A null doc_id is never the
smallest of its group. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import near_copies
from ._common import LOWER, cut, discard, free_name, numbered, small, table, with_row_ids

SHINGLE, RADIUS, HOT, SEED = 3, 2, 512, 42
#: Links up to which groups are closed in one task instead of by rounds over tables.
FEW_LINKS = 10_000


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    ends = list(accumulate(len(w) + 1 for w in words))  # one past the space that follows
    if len(words) <= size:
        return h(joined, SEED)
    counts, n = np.zeros(64, dtype=np.int64), len(words) - size + 1
    starts = [0, *ends]
    for at in range(0, n, 200_000):
        to = min(n, at + 200_000)
        hashes = np.array([h(joined[a : b - 1], SEED) for a, b in zip(starts[at:to], ends[at + size - 1 : to + size - 1])], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += (np.ones(len(bits), np.float32) @ bits.astype(np.float32)).astype(np.int64)  # exact below 2 ** 24
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """docs(rid, doc_id, text) to (rid, doc_id, fp long)."""

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t, size) for t in b.column("text").to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("rid"), b.column("doc_id"), pa.array(fps)], ["rid", "doc_id", "fp"])

    docs = docs.select("rid", F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(run, "rid long, doc_id long, fp long")


def links(fps: DataFrame, hot: int = HOT) -> DataFrame:
    """fps(fp), distinct, to pairs (a, b) at most two bits apart, a < b."""
    low, high = F.expr("fp & 4294967295"), F.expr("shiftrightunsigned(fp, 32)")
    values = F.explode(F.array(F.struct(F.lit(0).alias("seg"), low.alias("v"), high.alias("rest")), F.struct(F.lit(1).alias("seg"), high.alias("v"), low.alias("rest"))))
    tab = cut(fps.select("fp", values.alias("x")).select("fp", "x.*"))
    crowded = cut(tab.groupBy("seg", "v").count().filter(F.col("count") > hot).select("seg", "v"))
    ball = F.explode(F.when(F.col("seg") == 0, F.expr("concat(array(v), transform(sequence(0, 31), i -> v ^ shiftleft(1L, i)))")).otherwise(F.array("v")))
    probes = tab.select("seg", "fp", "rest", ball.alias("v"))
    near = lambda x, y: (F.col(x) < F.col(y)) & (F.bit_count(F.col(x).bitwiseXOR(F.col(y))) <= RADIUS)
    plain, rows = probes, tab
    some = crowded.count() > 0
    if some:
        plain, rows = (x.join(crowded, ["seg", "v"], "left_anti") for x in (probes, tab))
    p, t = plain.alias("p"), rows.alias("t")
    out = p.join(t, (F.col("p.seg") == F.col("t.seg")) & (F.col("p.v") == F.col("t.v")) & near("p.fp", "t.fp")).select(F.col("p.fp").alias("a"), F.col("t.fp").alias("b"))
    if some:
        masks = F.explode(F.expr("flatten(transform(sequence(0, 30), i -> transform(sequence(i + 1, 31), j -> shiftleft(1L, i) | shiftleft(1L, j))))"))
        wide = lambda x: x.join(crowded, ["seg", "v"], "left_semi").select("fp", "seg", "v", "rest", masks.alias("m")).withColumn("rest", F.expr("rest & ~m"))
        p, t = wide(probes).alias("p"), wide(tab).alias("t")
        same = F.lit(True)
        for c in ("seg", "v", "m", "rest"):
            same = same & (F.col(f"p.{c}") == F.col(f"t.{c}"))
        out = out.union(p.join(t, same & near("p.fp", "t.fp")).select(F.col("p.fp").alias("a"), F.col("t.fp").alias("b")))
    return out.distinct()


def _closed(batches):
    """All links (u, v) of a small table to (node, root)."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for b in batches:
        for u, v in zip(b.column("u").to_pylist(), b.column("v").to_pylist()):
            x, y = sorted((root(u), root(v)))
            up[y] = x
    nodes = list(up)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], ["node", "root"])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Pairs to (node, root): every node of a pair with the smallest node it is connected to."""
    edges = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct())
    if edges.count() <= FEW_LINKS:
        return edges.coalesce(1).mapInArrow(_closed, "node long, root long")

    def star(of: DataFrame) -> DataFrame:
        """of(u, v): each v to the smallest of u and all its v."""
        least = of.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        return of.join(least, "u")

    mark = lambda e: e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    was = None
    while (now := mark(edges)) != was:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = star(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        s = star(large)
        new = cut(s.select(F.col("v").alias("u"), F.col("m").alias("v")).union(s.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        discard(edges)
        was, edges = now, new
    roots = edges.groupBy("u").agg(F.min("v").alias("root"))
    return roots.select(F.col("u").alias("node"), "root").union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, size: int = SHINGLE, hot: int = HOT) -> DataFrame:
    """docs(doc_id, text) to (rid, doc_id, fp, component_id, first): first is the rid that stands for the group."""
    fps = cut(fingerprints(with_row_ids(docs, "text"), size))
    groups = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.min("rid").alias("rid")))
    linked = components(links(groups.select("fp"), hot))
    member = groups.join(linked, groups.fp == linked.node, "left").withColumn("root", F.coalesce("root", "fp"))
    member = cut(member.select("fp", "root", "least", "rid"))
    whole = member.groupBy("root").agg(F.min("least").alias("component_id"), F.min("rid").alias("first"))
    known = member.select("fp", "root").join(whole, "root").drop("root")
    return fps.join(known, "fp")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The documents that have the smallest doc_id of their group of near copies; of repeated rows one stays.

    The ids that go are broadcast if they are at most IDS, so that whole documents stay where they are; otherwise these are shuffled once.
    """
    rid = free_name(docs, "_rid")
    rows = numbered(docs, rid)
    gone = near_copies.groups(rows.select(F.col(rid).alias("rid"), "text")).filter("rid <> first").select(F.col("rid").alias(rid))
    return rows.join(small(gone, near_copies.IDS), rid, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
