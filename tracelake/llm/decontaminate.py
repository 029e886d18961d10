"""Benchmark decontamination by suffix arrays over the training documents.

The documents are read in shards (runs of documents within an Arrow batch). A shard's words become the numbers of the
benchmark's vocabulary, 0 for all others, and its suffix array holds every position at which a benchmark window could start:
positions whose first words aren't a word, pair, triple or quadruple of any test item are left out, as no window matches
there. Every test suffix is then binary-searched in each shard's array; the run of matches gives all places of its window, and the
neighbours in the array give its longest verbatim match, which is found by extending them word by word. Words inside a
match are hit. Longer matches are the union of their windows.

The benchmark is broadcast in blocks of at most BLOCK_WORDS words; each block is one pass, and the passes are joined per document.

Defined cases: a null text has no words; an item without words matches nothing; an item under WINDOW words is one window.
Items that repeat an item_id count once; items with a null item_id hit words and aren't counted. Of longest matches of one length the first
in the document counts, then the item whose id is the least string. Repeated document rows are separate. Empty tables: without documents the result is empty, without a benchmark nothing is hit. Other columns are ignored.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import LOWER_WORDS, pieces_of, share, table, with_row_ids

WINDOW = 10
BLOCK_WORDS = 2_000_000
SHARD_BYTES = 8_000_000


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER_WORDS).split()


class TestSuffixes:
    """A block of benchmark items: their vocabulary, first words, and suffixes. Items of equal words are one, with several names."""

    __test__ = False

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.window, self.vocabulary, texts = window, {}, {}
        for name, words in items:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.uint32)
            if len(ids):
                texts.setdefault(ids.tobytes(), (ids, set()))[1].add(name)
        self.names = [sorted(names - {None}) for _, names in texts.values()]
        rows, item, place, length = [np.empty((0, window), np.uint32)], [], [], []
        starts: dict[int, set] = {1: set(), 2: set(), 3: set(), 4: set()}
        for k, (ids, _) in enumerate(texts.values()):
            n, size = max(1, len(ids) - window + 1), min(window, len(ids))
            x = np.zeros((n, window), np.uint32)
            x[:, :size] = np.lib.stride_tricks.sliding_window_view(ids, size)
            starts[min(4, size)].update(map(tuple, x[:, : min(4, size)].tolist()))
            rows.append(x)
            item += [k] * n
            place += range(n)
            length += [size] * n
        self.rows = np.concatenate(rows)
        self.item, self.place, self.length = (np.array(x, np.int64) for x in (item, place, length))
        # Windows that are equal are searched once.
        self.unique, self.which = np.unique(np.column_stack([self.rows, self.length.astype(np.uint32)]), axis=0, return_inverse=True)
        self.which = self.which.reshape(-1)
        self.by_window = np.argsort(self.which, kind="stable")  # the test suffixes of each window, one after the other
        self.first = np.searchsorted(self.which[self.by_window], np.arange(len(self.unique) + 1))
        # Grams of one to four words: a position goes on while its words so far begin a window; short windows are whole at once.
        self.steps, v = [], np.uint64(len(self.vocabulary) + 1)
        ranks = {(): 0}
        every = {g[:n] for gs in starts.values() for g in gs for n in range(1, len(g) + 1)}
        for n in range(1, 5):
            grams = sorted(g for g in every if len(g) == n)
            codes = np.array([ranks[g[:-1]] * int(v) + g[-1] for g in grams], np.uint64)
            order = np.argsort(codes)
            self.steps.append((codes[order], np.array([grams[j] in starts[n] for j in order], bool)))
            ranks = {grams[j]: r for r, j in enumerate(order)}
        self.base = v

    def places(self, ids: np.ndarray) -> np.ndarray:
        """Positions of ids at which a window could start."""
        out, at, rank = [], np.flatnonzero(ids), np.zeros(np.count_nonzero(ids), np.uint64)
        for n, (codes, whole) in enumerate(self.steps):
            inside = at + n < len(ids)
            at, rank = at[inside], rank[inside]
            if not len(at) or not len(codes):
                break
            code = rank * self.base + ids[at + n].astype(np.uint64)
            k = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
            found = codes[k] == code
            at, rank = at[found], k[found].astype(np.uint64)
            out.append(at[whole[k[found]]])
        return np.unique(np.concatenate(out)) if out else np.empty(0, np.int64)

    def matches(self, ids: np.ndarray):
        """Of each window found: (row of unique, positions in ids)."""
        at = self.places(ids)
        if not len(at) or not len(self.unique):
            return
        padded = np.concatenate([ids, np.zeros(self.window, np.uint32)])
        keys = _keys(padded[at[:, None] + np.arange(self.window)])
        order = np.argsort(keys, kind="stable")  # the shard's suffix array
        array, keys = at[order], keys[order]
        n = self.unique[:, -1].astype(np.int64)
        rows = self.unique[:, :-1].copy()
        low = np.searchsorted(keys, _keys(rows), "left")
        rows[np.arange(self.window) >= n[:, None]] = 0xFFFFFFFF
        high = np.searchsorted(keys, _keys(rows), "right")
        for k in np.flatnonzero(high > low).tolist():
            yield k, array[low[k] : high[k]]


def _keys(rows: np.ndarray) -> np.ndarray:
    """Rows of word numbers as byte strings that sort like them."""
    return np.ascontiguousarray(rows.astype(">u4")).view(f"S{4 * rows.shape[1]}").reshape(-1)


def diagonals(found: list[tuple[int, np.ndarray]], tests: TestSuffixes) -> tuple[np.ndarray, ...]:
    """The verbatim matches that can't be extended, as (item, place in item, place in ids, words), from the windows found."""
    suffix = [tests.by_window[tests.first[k] : tests.first[k + 1]] for k, _ in found]
    p = np.concatenate([np.empty(0, np.int64), *(np.repeat(at, len(s)) for s, (_, at) in zip(suffix, found))])
    s = np.concatenate([np.empty(0, np.int64), *(np.tile(s, len(at)) for s, (_, at) in zip(suffix, found))])
    item, place, size = tests.item[s], tests.place[s], tests.length[s]
    order = np.lexsort((p, place - p, item))
    p, item, place, size = p[order], item[order], place[order], size[order]
    begins = np.flatnonzero(np.concatenate([[True], (item[1:] != item[:-1]) | (np.diff(place - p) != 0) | (np.diff(p) != 1)])[: len(p)])
    runs = np.diff(np.append(begins, len(p)))
    return item[begins], place[begins], p[begins], runs - 1 + size[begins]


def _numbers(words: list[list[bytes]], tests: TestSuffixes) -> tuple[np.ndarray, np.ndarray]:
    """All words as numbers, with a 0 after each text, and where texts start."""
    get, sizes = tests.vocabulary.get, np.array([len(w) + 1 for w in words], np.int64)
    starts = np.cumsum(sizes) - sizes
    ids = np.zeros(int(sizes.sum()), np.uint32)
    for w, s in zip(words, starts.tolist()):
        ids[s : s + len(w)] = np.fromiter((get(x, 0) for x in w), np.uint32, len(w))
    return ids, starts


LONGEST = "struct<words:long,at:long,item:string,item_at:long>"


def _search(tests_b):
    longest = pa.struct([("words", pa.int64()), ("at", pa.int64()), ("item", pa.string()), ("item_at", pa.int64())])
    schema = pa.schema([("rid", pa.int64()), ("n_words", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("items", pa.list_(pa.string())), ("longest", longest)])

    def run(batches):
        tests = tests_b()
        for b in batches:
            rids, texts = b.column("rid").to_pylist(), b.column("text").to_pylist()
            for i, j in pieces_of(texts, SHARD_BYTES):
                words = [words_of(t) for t in texts[i:j]]
                ids, starts = _numbers(words, tests)
                item, place, p, size = diagonals(list(tests.matches(ids)), tests)
                edge, items, best = np.zeros(len(ids) + 1, np.int32), {}, {}
                np.add.at(edge, p, 1)
                np.add.at(edge, p + size, -1)
                doc = np.searchsorted(starts, p, "right") - 1
                for d, k in set(zip(doc.tolist(), item.tolist())):
                    items.setdefault(d, set()).update(tests.names[k])
                for d, k, q, at, n in zip(doc.tolist(), item.tolist(), place.tolist(), (p - starts[doc]).tolist(), size.tolist()):
                    name = tests.names[k][0] if tests.names[k] else None
                    x = (-n, at, name is None, name or "", q)
                    if d not in best or x < best[d]:
                        best[d] = x
                hit = np.concatenate([[False], np.cumsum(edge[:-1]) > 0, [False]])
                ups, downs = np.flatnonzero(hit[1:] & ~hit[:-1]), np.flatnonzero(~hit[1:] & hit[:-1])
                first = np.searchsorted(ups, np.append(starts, len(ids)))
                rows = []
                for d, (w, s, a, e) in enumerate(zip(words, starts.tolist(), first[:-1].tolist(), first[1:].tolist())):
                    x = best.get(d)
                    most = x and {"words": -x[0], "at": x[1], "item": None if x[2] else x[3], "item_at": x[4]}
                    rows.append((rids[i + d], len(w), (ups[a:e] - s).tolist(), (downs[a:e] - s).tolist(), sorted(items.get(d, ())), most))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run, f"rid long, n_words long, starts array<long>, ends array<long>, items array<string>, longest {LONGEST}"


def blocks_of(benchmark: DataFrame, block_words: int):
    """The items, sorted, in blocks of at most so many words or one item, one block at least; read one partition at a time."""
    block, size, some = [], 0, False
    for r in benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").distinct().orderBy("item_id", "text").toLocalIterator():
        words = words_of(r.text)
        if block and size + len(words) > block_words:
            yield block
            block, size, some = [], 0, True
        block.append((r.item_id, words))
        size += len(words)
    if block or not some:
        yield block


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs(doc_id, text), benchmark(item_id, text) to (rid, doc_id, n_words, n_hit, items, longest, spans).

    longest: the longest verbatim match (words, at, item, item_at), null without a hit; spans: the runs of hit words (starts, ends).
    """
    spark = docs.sparkSession
    keyed = with_row_ids(docs, "text")
    passes = [keyed.select("rid", "text").mapInArrow(*_search(share(spark, TestSuffixes(block, window)))) for block in blocks_of(benchmark, block_words)]
    found = passes[0]
    if len(passes) > 1:
        for p in passes[1:]:
            found = found.union(p)
        join = lambda c: F.flatten(F.collect_list(c)).alias(c)  # noqa: E731  one row per pass
        x = F.col("longest")
        order = F.struct(-x["words"], x["at"], x["item"].isNull(), x["item"], x["item_at"])
        found = found.groupBy("rid").agg(F.max("n_words").alias("n_words"), join("starts"), join("ends"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.min_by("longest", F.when(x.isNotNull(), order)).alias("longest"))
    spans = F.array_sort(F.arrays_zip("starts", "ends"))
    # Spans of several passes may overlap: each adds what lies behind the ends before it.
    hit = F.aggregate(spans, F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")), lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0).cast("long"), x["ends"] - F.greatest(x["starts"], a["to"]))).alias("n"), F.greatest(a["to"], x["ends"]).alias("to")))["n"]
    found = found.select("rid", "n_words", hit.alias("n_hit"), "items", "longest", spans.alias("spans"))
    if keyed.schema["doc_id"].dataType.typeName() == "long" and not hasattr(keyed, "_tracelake_path"):
        return found.select("rid", F.col("rid").alias("doc_id"), "n_words", "n_hit", "items", "longest", "spans")
    return keyed.select("rid", "doc_id").join(found, "rid").select("rid", "doc_id", "n_words", "n_hit", "items", "longest", "spans")


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a hit, with all their columns; one pass, no shuffle."""
    for block in blocks_of(benchmark, BLOCK_WORDS):
        docs = _without(docs, share(docs.sparkSession, TestSuffixes(block)))
    return docs


def _without(docs: DataFrame, tests_b) -> DataFrame:
    def run(batches):
        tests = tests_b()
        for b in batches:
            texts, clean = b.column("text").to_pylist(), np.ones(b.num_rows, bool)
            for i, j in pieces_of(texts, SHARD_BYTES):
                ids, starts = _numbers([words_of(t) for t in texts[i:j]], tests)
                for _, at in tests.matches(ids):
                    clean[i + np.searchsorted(starts, at, "right") - 1] = False
            yield b.filter(pa.array(clean))

    return docs.mapInArrow(run, docs.schema)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """longest, longest_at and longest_item: the words, the place and the item of the document's longest verbatim match."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    most = F.col("longest")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
        F.coalesce(most["words"], F.lit(0).cast("long")).alias("longest"), most["at"].alias("longest_at"), most["item"].alias("longest_item"),
    )


OP4_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, row_number() OVER () AS r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item_id, r, i AS q, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
       FROM b, unnest(range(1, greatest(2, len(w) - 8))) AS t(i) WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT d.doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM d, lens, unnest(range(1, len(w) - n + 2)) AS t(i)),
m AS (SELECT doc_id, i, n, item_id, r, q FROM dw JOIN bw USING (n, g)),
hits AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM m, unnest(range(i, i + n)) AS t(k) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names FROM (SELECT DISTINCT doc_id, item_id FROM m WHERE item_id IS NOT NULL) GROUP BY doc_id),
diagonals AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, r, q - i ORDER BY i) AS part FROM m),
runs AS (SELECT doc_id, r, min(item_id) AS item_id, min(i) - 1 AS pos, count(*) - 1 + max(n) AS words FROM diagonals GROUP BY doc_id, r, q - i, part),
longest AS (SELECT doc_id, words, pos, item_id FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY words DESC, pos, item_id NULLS LAST) = 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
       CAST(coalesce(words, 0) AS BIGINT) AS longest, CAST(pos AS BIGINT) AS longest_at, longest.item_id AS longest_item
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN longest USING (doc_id)
"""
