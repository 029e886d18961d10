"""WARC fixity audit by Merkle trees [DataFrame functions only].

Pages become WARC response records: a header block, the HTML and two line ends. Records are numbered and dealt to archive files of
RANGE numbers each, in which they stand one after the other; an offset is the sum of the lengths before. A record's leaf hashes its
offset and its bytes. Each node of the tree covers an ordered range of FANOUT nodes below it, by number, and hashes their numbers and
digests in order; the root covers all.

Two replicas are compared at their roots. Only where nodes differ are their children looked at, level by level, down to the
records: changed, missing or extra in the second replica. Identical replicas cost one comparison after hashing.

Defined cases: a null html or url is an empty one. Records are numbered by page_id where it is unique and whole, and otherwise by their
order by page_id, nulls last. Repeated rows are separate records. Two empty replicas are equal. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import cut, table, with_row_ids

FANOUT_BITS, RANGE_BITS = 4, 10
#: Pages don't say when they were read; records must.
DATE = "1970-01-01T00:00:00Z"


def records(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) to (n, page_id, head, body): the parts of a WARC response record."""
    keyed = with_row_ids(pages.select(F.col("page_id").alias("doc_id"), "url", "html"), "url", "html")
    body = F.coalesce("html", F.lit(""))
    head = F.concat(
        F.lit(f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "), F.coalesce("url", F.lit("")), F.lit("\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
        F.lit(">\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return keyed.select(F.col("rid").alias("n"), F.col("doc_id").alias("page_id"), head.alias("head"), body.alias("body"))


def leaves(recs: DataFrame) -> DataFrame:
    """records to (n, page_id, offset, length, digest)."""
    record = F.concat("head", "body", F.lit("\r\n\r\n"))
    sized = recs.select("n", "page_id", F.octet_length(record).cast("long").alias("length"), F.sha2(record.cast("binary"), 256).alias("content"))
    before = Window.partitionBy(F.shiftright("n", RANGE_BITS)).orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))
    return placed.select("n", "page_id", "offset", "length", F.sha2(F.concat_ws(":", F.col("offset").cast("string"), "content").cast("binary"), 256).alias("digest"))


def level_above(nodes: DataFrame) -> DataFrame:
    """(n, digest) to the same of the ranges of FANOUT nodes."""
    part = F.concat_ws("=", F.col("n").cast("string"), "digest")
    return nodes.groupBy(F.shiftright("n", FANOUT_BITS).alias("n")).agg(
        F.sha2(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("n", part.alias("p")))), lambda x: x["p"])).cast("binary"), 256).alias("digest")
    )


def tree(leaf: DataFrame, height: int) -> list[DataFrame]:
    """Levels from the leaves to the root."""
    levels = [leaf.select("n", "digest")]
    for _ in range(height):
        levels.append(cut(level_above(levels[-1])))
    return levels


def audit(first: DataFrame, second: DataFrame) -> DataFrame:
    """Leaves of two replicas to (n, page_id, state, offset, length, digest, found): where the second differs from the first."""
    a, b = cut(leaves(first)), cut(leaves(second))
    most = max(x.agg(F.max("n")).first()[0] or 0 for x in (a, b))
    height = max(1, -(-int(most).bit_length() // FANOUT_BITS))
    up, vp = tree(a, height), tree(b, height)

    def differing(x: DataFrame, y: DataFrame, below: DataFrame | None) -> DataFrame:
        """Nodes that differ, of those whose parents do."""
        if below is not None:
            x, y = (t.join(below, F.shiftright(t.n, FANOUT_BITS) == below.up, "left_semi") for t in (x, y))
        both = x.select("n", F.col("digest").alias("da")).join(y.select("n", F.col("digest").alias("db")), "n", "full")
        return both.filter(~F.col("da").eqNullSafe(F.col("db"))).select(F.col("n").alias("up"))

    bad = None
    for level in range(height, 0, -1):
        bad = cut(differing(up[level], vp[level], bad))
        if level == height and bad.limit(1).count() == 0:
            break
    inside = lambda t: t.join(bad, F.shiftright(t.n, FANOUT_BITS) == bad.up, "left_semi")
    x, y = inside(a).alias("x"), inside(b).alias("y")
    state = F.when(F.col("y.n").isNull(), "missing").when(F.col("x.n").isNull(), "extra").when((F.col("x.length") == F.col("y.length")) & (F.col("x.offset") == F.col("y.offset")), "changed").otherwise("moved or resized")
    both = x.join(y, F.col("x.n") == F.col("y.n"), "full").filter(~F.col("x.digest").eqNullSafe(F.col("y.digest")))
    pick = lambda c: F.coalesce(f"x.{c}", f"y.{c}").alias(c)
    return both.select(pick("n"), pick("page_id"), state.alias("state"), pick("offset"), pick("length"), F.col("x.digest").alias("digest"), F.col("y.digest").alias("found"))


def damaged(recs: DataFrame) -> DataFrame:
    """A second replica as a fault injection for the query: in every 97th record a letter is another, every 389th record is overwritten."""
    return recs.withColumn("body", F.when(F.col("n") % 97 == 5, F.translate("body", "e", "x")).when(F.col("n") % 389 == 7, F.repeat(F.lit("#"), F.octet_length("body"))).otherwise(F.col("body")))


def op5_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    recs = records(table(spark, sf_dir, "pages"))
    return audit(recs, damaged(recs)).select("page_id", "state", "offset", "length", "digest", "found")


OP5_SQL = r"""
WITH r AS (SELECT page_id AS n, page_id,
    'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Date: 1970-01-01T00:00:00Z' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) ||
    'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) ||
    'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) AS head, coalesce(html, '') AS body FROM pages),
e AS (SELECT *, chr(13) || chr(10) || chr(13) || chr(10) AS tail,
    CASE WHEN n % 97 = 5 THEN translate(body, 'e', 'x') WHEN n % 389 = 7 THEN repeat('#', strlen(body)) ELSE body END AS other FROM r),
c AS (SELECT n, page_id, CAST(strlen(head || body || tail) AS BIGINT) AS la, sha256(head || body || tail) AS ca, strlen(head || other || tail) AS lb, sha256(head || other || tail) AS cb FROM e),
o AS (SELECT *, coalesce(sum(la) OVER w, 0) AS oa, coalesce(sum(lb) OVER w, 0) AS ob FROM c
      WINDOW w AS (PARTITION BY n >> 10 ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT page_id, CASE WHEN la = lb AND oa = ob THEN 'changed' ELSE 'moved or resized' END AS state, CAST(oa AS BIGINT) AS "offset", CAST(la AS BIGINT) AS length,
       sha256(CAST(oa AS BIGINT) || ':' || ca) AS digest, sha256(CAST(ob AS BIGINT) || ':' || cb) AS found
FROM o WHERE ca <> cb OR oa <> ob
"""
