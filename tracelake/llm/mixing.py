"""Mixing sources to target weights by capped water-filling [native DataFrame code only].

Every source has a weight; together the sources share a budget of words by weight, but none may be read more than
``epochs`` times. What a capped source can't take is shared again among the others by weight, until nothing is above
its cap. That fixed point has a closed form: with the sources sorted by cap / weight, the first i of them are capped,
where i is the least number for which the level (budget - caps of the first i) / (weights of the others) doesn't reach
the next source's cap / weight.

Sampling is seeded and exact: each document is repeated floor(target / source size) times in whole; the source's
remaining words come from the documents whose seeded hash is below the source's cutoff, found by two rounds of a
1,024-bucket histogram. The documents in the one histogram cell that holds the cutoff (about a millionth of the source)
give the fraction of their words that is still missing, rounded along their running sum, so that a source's taken words are its target
rounded down.

Defined cases: a null text or one without words has size 0 and takes 0 words. A null source is a source of its own, the last.
Rows with one doc_id, or none, share a hash and so a histogram cell; repeated rows count each, and which of them takes a word more is
open. Such a cell may hold very many rows: these are numbered in two levels, by task and within it. An empty table gives an empty result.
Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import cut, small, table

#: Fixed values of the query's contract.
WEIGHTS, SHARE, EPOCHS = (5, 2, 1), 1.5, 2
WORD = r"[^\x20\x09-\x0D]+"
CELLS = 1024


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """sizes(source, source_size) to (source, source_size, target double).

    The windows without partitions run over one row per source, not over documents.
    """
    everything = Window.partitionBy()
    ranked = sizes.withColumn("k", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), ((F.col("k") - 1) % len(weights) + 1).cast("int")).cast("double"))
    ranked = ranked.withColumn("cap", (F.col("source_size") * epochs).cast("double")).withColumn("at", F.col("cap") / F.col("w"))
    before = Window.orderBy("at", "k").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    )
    ranked = ranked.withColumn("level", level)
    # The level that counts is that of the first source, in this order, which stays below its cap.
    ranked = ranked.withColumn("fill", F.min(F.when(F.col("at") >= F.col("level"), F.struct("at", "k", "level"))).over(everything)["level"])
    target = F.when(F.col("fill").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("w") * F.col("fill")))
    return ranked.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: str = "mix") -> DataFrame:
    """docs(doc_id, text, source) to (doc_id, size, source_size, target, taken)."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    base = cut(
        docs.select(
            "doc_id", "source", words_in(F.col("text")).alias("size"), F.conv(F.substring(digest, 1, 10), 16, 10).cast("long").alias("u")
        )
    )
    plan = targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = plan.withColumn("whole", whole).withColumn("missing", F.floor("target").cast("long") - F.col("whole") * F.col("source_size"))
    plan = cut(plan)
    cell1 = F.shiftright("u", 30).cast("int")
    cell2 = F.shiftright("u", 20).cast("int") % CELLS

    def cutoff(cells: DataFrame, known: DataFrame, cell: str, missing: str, left: str, total: str) -> DataFrame:
        """The cell in which a source's missing words are reached, what is missing there, and its words."""
        up_to = Window.partitionBy("source").orderBy(cell)
        c, k = cells.alias("c"), known.alias("k")
        joined = c.join(small(k), F.col("c.source").eqNullSafe(F.col("k.source"))).select("c.source", f"c.{cell}", "c.n", f"k.{missing}")
        joined = joined.withColumn("sum", F.sum("n").over(up_to))
        return joined.filter((F.col("sum") > F.col(missing)) & (F.col("sum") - F.col("n") <= F.col(missing)) & (F.col("n") > 0)).select(
            "source", cell, (F.col(missing) - F.col("sum") + F.col("n")).alias(left), F.col("n").alias(total)
        )

    first = base.groupBy("source", cell1.alias("c1")).agg(F.sum("size").alias("n"))
    one = cut(cutoff(first, plan, "c1", "missing", "left1", "n1"))
    o = one.alias("o")
    inside = base.alias("b").join(small(o), F.col("b.source").eqNullSafe(F.col("o.source")) & (F.shiftright("b.u", 30).cast("int") == F.col("o.c1")))
    second = inside.groupBy("b.source", (F.shiftright("b.u", 20).cast("int") % CELLS).alias("c2")).agg(F.sum("b.size").alias("n"))
    two = cutoff(second, one, "c2", "left1", "left2", "n2")
    p, t = plan.alias("p"), two.alias("t")
    cuts = p.join(o, F.col("p.source").eqNullSafe(F.col("o.source")), "left").join(t, F.col("p.source").eqNullSafe(F.col("t.source")), "left")
    cuts = cut(cuts.select("p.*", "o.c1", "t.c2", "t.left2", "t.n2"))
    d, x = base.withColumn("d1", cell1).withColumn("d2", cell2).withColumn("task", F.spark_partition_id()).alias("d"), cuts.alias("x")
    out = d.join(small(x), F.col("d.source").eqNullSafe(F.col("x.source"))).withColumn("k", F.coalesce("x.whole", F.lit(0)))
    at_cut = F.coalesce((F.col("d1") == F.col("c1")) & (F.col("d2") == F.col("c2")), F.lit(False))
    below = F.coalesce((F.col("d1") < F.col("c1")) | ((F.col("d1") == F.col("c1")) & (F.col("d2") < F.col("c2"))), F.lit(False))
    names = "doc_id", "size", "source_size", "target"
    most = out.filter(~at_cut).select(*(f"d.{c}" if c in ("doc_id", "size") else f"x.{c}" for c in names), (F.col("size") * F.col("k") + F.when(below, F.col("size")).otherwise(0)).alias("taken"))
    # The rows of the cut cells: kinds of equal rows, their number by task, and the words before each row.
    kind = [F.coalesce(F.col(f"d.{c}").cast("string"), F.lit("")).alias(f"key_{c}") for c in ("source", "doc_id")] + [F.col(f"d.{c}").isNull().alias(f"no_{c}") for c in ("source", "doc_id")]
    keys = ["key_source", "key_doc_id", "no_source", "no_doc_id", "u", "size"]
    cell = cut(out.filter(at_cut).select("d.doc_id", "x.source_size", "x.target", "k", "left2", "n2", "d.u", "d.size", "task", *kind))
    by_task = cell.groupBy(*keys, "task").agg(F.count(F.lit(1)).alias("n"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    by_task = by_task.withColumn("rows_before", F.coalesce(F.sum("n").over(before(Window.partitionBy(*keys).orderBy("task"))), F.lit(0)))
    kinds = by_task.groupBy(*keys).agg(F.sum("n").alias("n"))
    order = Window.partitionBy("no_source", "key_source").orderBy("u", "size", F.col("no_doc_id"), "key_doc_id")
    kinds = kinds.withColumn("words_before", F.coalesce(F.sum(F.col("n") * F.col("size")).over(before(order)), F.lit(0)))
    cell = cell.withColumn("turn", F.row_number().over(Window.partitionBy(*keys, "task").orderBy("k"))).join(by_task.drop("n").join(kinds.drop("n"), keys), [*keys, "task"])
    end = F.col("words_before") + (F.col("rows_before") + F.col("turn")) * F.col("size")
    share_of = lambda words: F.call_function("div", words.cast("decimal(20,0)") * F.col("left2").cast("decimal(18,0)"), F.col("n2").cast("decimal(20,0)"))
    rest = cell.withColumn("end", end).select(*names, (F.col("size") * F.col("k") + share_of(F.col("end")) - share_of(F.col("end") - F.col("size"))).alias("taken"))
    return most.unionByName(rest)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH RECURSIVE base AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 10) AS BIGINT) AS u
  FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM base GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM sizes),
weighed AS (SELECT *, CASE (k - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w,
                   CAST(2 * source_size AS DOUBLE) AS cap FROM ranked),
leveled AS (SELECT *, cap / w AS "at",
         (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER before, 0)) /
         (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level
  FROM weighed WINDOW before AS (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
filled AS (SELECT *, (SELECT level FROM leveled WHERE "at" >= level ORDER BY "at", k LIMIT 1) AS fill FROM leveled),
plan AS (SELECT source, source_size, coalesce(least(cap, w * fill), cap) AS target FROM filled),
whole AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM plan),
missing AS (SELECT *, CAST(floor(target) AS BIGINT) - whole * source_size AS missing FROM whole),
cells AS (SELECT source, u >> 20 AS c, sum(size) AS n FROM base GROUP BY ALL),
cum AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY c) AS upto FROM cells),
cutoff AS (SELECT m.source, cum.c, CAST(m.missing - cum.upto + cum.n AS BIGINT) AS gap, CAST(cum.n AS BIGINT) AS n FROM cum
  JOIN missing m ON m.source IS NOT DISTINCT FROM cum.source
  WHERE cum.upto > m.missing AND cum.upto - cum.n <= m.missing AND cum.n > 0)
SELECT b.doc_id, b.size, m.source_size, m.target,
  CAST(b.size * m.whole + CASE WHEN (b.u >> 20) < x.c THEN b.size
       WHEN (b.u >> 20) = x.c THEN (run * x.gap) // x.n - ((run - b.size) * x.gap) // x.n
       ELSE 0 END AS BIGINT) AS taken
FROM (SELECT *, CAST(sum(size) OVER (PARTITION BY source, u >> 20 ORDER BY u, size, doc_id NULLS LAST ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM base) b
JOIN missing m ON m.source IS NOT DISTINCT FROM b.source
LEFT JOIN cutoff x ON x.source IS NOT DISTINCT FROM b.source
"""
