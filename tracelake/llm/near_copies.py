"""Groups of texts whose five-word shingles have a Jaccard similarity of SIMILAR = 0.8 or more, for the pipeline, by SimHash and multi-index hashing.

A text's fingerprint is the bitwise majority of hashes of its shingles, each shingle once: 2 * 64 bits to compare and `segments` segments of
`width` bits to index; a shingle's hashes come from its XXH64 (seed 42). Texts with the same set of shingles are gathered first and cost one
row. Each other is entered in one table per segment; texts that share a segment's value are candidates if the bits to compare differ in at
most NEAR = 40 places, and then the similarity is computed in full.

Texts at similarity 0.8 differ in a bit with a probability of DIFFER = 0.1515 (the angle between their sets over pi; 0.16 for some sets of
under 60 shingles, 0.19 for sets of four and five), so that one segment is shared with one of 0.8485 ** width, and with 88 segments of 12 bits
a pair is missed with one of about two in a million (one in 100,000; one in 2,000), and by NEAR with one of a similar size. Widths grow with
the logarithm of the number of texts, which keeps tables at about 256 unlike texts a value, and the number of segments with the widths.

Most of a large group is linked first through FIRST = 16 segments, where a text meets only the nearest before it that differs in at most
CLOSE = 24 places; then all segments are tried, with all pairs that aren't yet connected. Values under which more than MANY = 3 pairs a
text are candidates are crowded: their texts meet again with whole fingerprints, in chunks of CHUNK rows, each pair in the first segment
that it shares. These pairs, and those of other values, are compared in full if all 2,048 bits or more agree to SIGMAS = 4.6 standard
deviations. In a large group of texts that are all a little less similar than 0.8 such pairs still grow with its square.

Defined cases: null texts and texts without words are copies of each other. Texts shorter than a shingle count as one shingle. An empty
table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import LOWER, cut, discard, small

SHINGLE, SIMILAR, SEED = 5, 0.8, 42
#: Of the fingerprints: words and largest distances of the bits to compare; the segments that are tried first; words at least.
COMPARED, NEAR, CLOSE, FIRST, WORDS = 2, 40, 24, 16, 32
#: The probability that a bit differs at SIMILAR, and minus the logarithm of that of a pair which shares no segment.
DIFFER, MISS = math.acos(2 * SIMILAR / (1 + SIMILAR)) / math.pi, 12.2
WIDTH, VALUES = 12, 256
#: Pairs a text from which a value is crowded; rows of a chunk; standard deviations by which whole fingerprints may differ more.
MANY, CHUNK, SIGMAS = 3, 2048, 4.6
#: Ids that may be broadcast.
IDS = 200_000
LANES = np.uint64(0x0101010101010101)


def shingles(text: str | None) -> np.ndarray:
    """The hashes of a text's shingles, sorted, each once."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return np.array([h(joined, SEED)], np.uint64)
    ends = list(accumulate(len(w) + 1 for w in words))  # one past the space that follows
    return np.unique(np.array([h(joined[a : b - 1], SEED) for a, b in zip([0, *ends], ends[SHINGLE - 1 :])], np.uint64))


def similarity(x: np.ndarray, y: np.ndarray) -> float:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) or len(y) else 1.0


def index_of(n: int) -> tuple[int, int]:
    """Width and number of the segments for so many texts."""
    width = min(32, max(WIDTH, math.ceil(math.log2(max(n, 1) / VALUES))))
    return width, math.ceil(MISS / (1 - DIFFER) ** width)


def factors(words: int) -> np.ndarray:
    """For each word of a fingerprint, what makes its hashes of the shingles' hashes."""
    return np.random.default_rng(SEED).integers(0, 2**63, (words, 2), dtype=np.uint64).T * np.uint64(2) + np.uint64(1)


def fingerprint(x: np.ndarray, by: np.ndarray) -> np.ndarray:
    """The words of the bitwise majority of hashes of x, 64 bits each."""
    counts = np.zeros(by.shape[1] * 64, np.int64)
    for i in range(0, len(x), 255):  # what a lane of eight bits counts
        h = (x[i : i + 255, None] ^ by[0]) * by[1]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        lanes = np.stack([((h >> np.uint64(j)) & LANES).sum(axis=0, dtype=np.uint64) for j in range(8)])
        counts += lanes.astype("<u8").view(np.uint8).reshape(8, -1, 8).transpose(1, 2, 0).reshape(-1)
    return np.packbits(counts * 2 > len(x), bitorder="little").view("<u8")


def _signatures(words: int):
    """(rid, text) to (rid, same, n, fp): a hash of the set of shingles, their number, the fingerprint."""

    def run(batches):
        by = factors(words)
        for b in batches:
            out = [[] for _ in range(4)]
            for rid, text in zip(b.column("rid").to_pylist(), b.column("text").to_pylist()):
                x = shingles(text)
                for o, y in zip(out, (rid, xxhash.xxh3_128_digest(x.tobytes()), len(x), fingerprint(x, by).tobytes())):
                    o.append(y)
            kinds = pa.int64(), pa.binary(), pa.int64(), pa.binary()
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], ["rid", "same", "n", "fp"])

    return run


def _segments(fp: np.ndarray, width: int, segments: int) -> np.ndarray:
    """Of fingerprints, a row each: the segments' values."""
    bits = np.unpackbits(np.ascontiguousarray(fp[:, COMPARED:]).view(np.uint8), axis=1, bitorder="little")
    padded = np.zeros((len(fp), segments, 32), np.uint8)
    padded[:, :, :width] = bits[:, : segments * width].reshape(len(fp), segments, width)
    return np.packbits(padded, axis=2, bitorder="little").view("<u4")[:, :, 0]


def _words(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(len(column), -1)


def _entries(width: int, segments: int):
    """(rid, root, n, fp) to (key, rid, root, n, x, y), a row for each segment; key: segment and value; x, y: the bits to compare."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                fp = _words(b.column("fp"))
                key = _segments(fp, width, segments).astype(np.int64) | np.arange(segments, dtype=np.int64) << 32
                cols = [b.column(c).to_numpy() for c in ("rid", "root", "n")] + [fp[:, i].view(np.int64) for i in range(COMPARED)]
                yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1)), *(pa.array(np.repeat(c, segments)) for c in cols)], ["key", "rid", "root", "n", "x", "y"])

    return run


def _sizes_agree(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.minimum(x, y) >= SIMILAR * np.maximum(x, y)


def near(key, rid, root, n, x, y, nearest: bool, many: int = MANY):
    """Of rows sorted by key: places (i, j) of rows with equal keys and different roots that may be similar, and the places of all rows of crowded keys.

    nearest: for each row only the nearest such row before it, if it is close; no key is crowded then.
    """
    if not len(key):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    x, y = x.view(np.uint64), y.view(np.uint64)  # of negative numbers, numpy counts the bits of what they are without sign
    group = np.cumsum(np.r_[False, key[1:] != key[:-1]])
    size, met = np.bincount(group), np.zeros(group[-1] + 1, np.int64)
    j, d, found = np.arange(len(key)), 0, [(np.empty(0, np.int64),) * 2]
    while len(j):
        d += 1
        j = j[j >= d]
        j = j[group[j] == group[j - d]]
        i = j - d
        ok = (np.bitwise_count(x[i] ^ x[j]).astype(np.int64) + np.bitwise_count(y[i] ^ y[j]) <= (CLOSE if nearest else NEAR)) & (root[i] != root[j])
        ok[ok] = _sizes_agree(n[i[ok]], n[j[ok]])
        if ok.any():
            found.append((i[ok], j[ok]))
            if nearest:
                j = j[~ok]
            else:
                met += np.bincount(group[j[ok]], minlength=len(met))
                j = j[(met <= many * size)[group[j]]]
    i, j = (np.concatenate(p) for p in zip(*found))
    crowded = (met > many * size) & (not nearest)
    plain = ~crowded[group[j]]
    return i[plain], j[plain], np.flatnonzero(crowded[group])


def _whole(batches, names: tuple[str, ...]):
    """Sorted batches to lists of columns in which all rows of what the named columns hold are together."""
    rest = None
    for b in batches:
        if not b.num_rows:
            continue
        b = pa.Table.from_batches([b] if rest is None else [*rest.to_batches(), b])
        same = np.ones(b.num_rows, bool)
        for c in names:
            x = b.column(c).to_numpy()
            same &= x == x[-1]
        last = b.num_rows - int(same.sum())  # those may go on in the next batch
        if last:
            yield b.slice(0, last)
        rest = b.slice(last)
    if rest is not None:
        yield rest


def _pairs(a: np.ndarray, b: np.ndarray) -> list[pa.Array]:
    out = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1) if len(a) else np.empty((2, 0), np.int64)
    return [pa.array(x) for x in out]


def _meetings(nearest: bool, many: int):
    """Entries, sorted by key, to pairs (null, a, b), a < b, and (key, rid, null) for all rows of crowded keys."""

    def run(batches):
        for t in _whole(batches, ("key",)):
            key, rid, *more = (c.to_numpy() for c in t.columns)
            i, j, rows = near(key, rid, *more, nearest, many)
            a, b = _pairs(rid[i], rid[j])
            if len(a) or len(rows):
                cols = [pa.array(key[rows]), pa.array(rid[rows]), pa.nulls(len(rows), pa.int64())]
                cols = [pa.concat_arrays(p) for p in zip((pa.nulls(len(a), pa.int64()), a, b), cols)]
                yield pa.RecordBatch.from_arrays(cols, ["key", "a", "b"])

    return run


def agreeing(fp: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs of places (i, j) whole fingerprints leave a similarity of SIMILAR open for."""
    least, bits = np.minimum(n[i], n[j]), fp.shape[1] * 64
    p = np.where(least < 6, 0.1875, np.where(least < 60, 0.1611, DIFFER))
    return np.bitwise_count(fp[i] ^ fp[j]).sum(axis=1, dtype=np.int64) <= bits * p + SIGMAS * np.sqrt(bits * p * (1 - p))


def _agreeing(batches):
    """(a, b, n_a, n_b, fp_a, fp_b) to the pairs (a, b) that whole fingerprints leave open."""
    for b in batches:
        if b.num_rows:
            n = np.concatenate([b.column(c).to_numpy() for c in ("n_a", "n_b")])
            fp, i = np.concatenate([_words(b.column(c)) for c in ("fp_a", "fp_b")]), np.arange(b.num_rows)
            yield b.select(["a", "b"]).filter(pa.array(agreeing(fp, n, i, i + b.num_rows)))


def _crowds(width: int, segments: int):
    """(key, p, q, rid, root, n, part, fp), sorted by key, p and q, to pairs (a, b), a < b, of parts p and q."""

    def run(batches):
        for t in _whole(batches, ("key", "p", "q")):
            key, p, q, rid, root, n, part = (c.to_numpy() for c in t.columns[:-1])
            fp = _words(t.column("fp").combine_chunks())
            values = _segments(fp, width, segments)
            new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])])
            for start, end in zip(new, [*new[1:], len(key)]):
                across, out = p[start] != q[start], []
                for k in range(start, end):
                    j = np.arange(k + 1, end)
                    j = j[(root[j] != root[k]) & _sizes_agree(n[j], n[k])]
                    j = j[part[j] != part[k]] if across else j
                    j = j[agreeing(fp, n, np.full(len(j), k), j)]
                    j = j[(values[j] == values[k]).argmax(axis=1) == key[k] >> 32] if len(j) else j
                    out.append(np.stack([np.full(len(j), rid[k]), rid[j]]))
                pairs = np.concatenate(out, axis=1)
                if pairs.shape[1]:
                    yield pa.RecordBatch.from_arrays(_pairs(*pairs), ["a", "b"])

    return run


def _verify(batches):
    """(a, b, text_a, text_b) to (a, b)."""
    last = None, None
    for t in batches:
        out = []
        for a, b, x, y in zip(*(t.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b"))):
            if last[0] != b:
                last = b, shingles(y)
            if similarity(shingles(x), last[1]) >= SIMILAR:
                out.append((a, b))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])


def groups(docs: DataFrame) -> DataFrame:
    """docs(rid, text) to (rid, first): first is the smallest rid of the group."""
    from .simhash import components  # which imports this module

    docs = docs.select("rid", "text")
    width, segments = index_of(docs.count())
    words = max(WORDS, COMPARED + math.ceil(segments * width / 64))
    base = cut(docs.mapInArrow(_signatures(words), "rid long, same binary, n long, fp binary"))
    sets = cut(base.groupBy("same").agg(F.min("rid").alias("node")))
    nodes = base.join(sets, F.col("rid") == F.col("node"), "left_semi").filter("n > 0")
    tables = [base, sets]

    def kept(df: DataFrame) -> DataFrame:
        tables.append(cut(df))
        return tables[-1]

    def verified(pairs: DataFrame) -> DataFrame:
        ids = pairs.select(F.col("a").alias("rid")).union(pairs.select("b")).distinct()
        texts = kept(docs.join(small(ids, IDS), "rid", "left_semi"))
        a, b = (texts.select(F.col("rid").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")
        return kept(pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b").mapInArrow(_verify, "a long, b long"))

    def met(rows: DataFrame, segments: int, nearest: bool) -> DataFrame:
        entries = rows.select("rid", "root", "n", "fp").mapInArrow(_entries(width, segments), "key long, rid long, root long, n long, x long, y long")
        return kept(entries.repartition("key").sortWithinPartitions("key", "rid").mapInArrow(_meetings(nearest, MANY), "key long, a long, b long"))

    def open_(pairs: DataFrame, rows: DataFrame) -> DataFrame:
        for c in "ab":
            pairs = pairs.join(rows.select(*(F.col(x).alias(f"{x}_{c}") for x in ("rid", "n", "fp"))), F.col(c) == F.col(f"rid_{c}"))
        return pairs.select("a", "b", "n_a", "n_b", "fp_a", "fp_b").mapInArrow(_agreeing, "a long, b long")

    links = verified(kept(met(nodes.withColumn("root", F.col("rid")), min(FIRST, segments), True).select("a", "b").distinct()))
    rows = kept(nodes.join(components(links), F.col("rid") == F.col("node"), "left").select("rid", F.coalesce("root", "rid").alias("root"), "n", "fp"))
    found = met(rows, segments, False)
    pairs, crowd = found.filter("key is null").select("a", "b"), found.filter("key is not null").select("key", F.col("a").alias("rid"))
    sizes = crowd.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("long").alias("parts"))
    crowd = crowd.join(sizes, "key").join(rows, "rid").withColumn("part", F.pmod(F.xxhash64("rid"), "parts"))
    crowd = crowd.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).withColumn("p", F.least("part", "other")).withColumn("q", F.greatest("part", "other"))
    crowd = crowd.select("key", "p", "q", "rid", "root", "n", "part", "fp").repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")
    pairs = open_(kept(pairs.distinct()), rows).union(crowd.mapInArrow(_crowds(width, segments), "a long, b long"))
    links = links.union(verified(kept(pairs.distinct())))
    known = sets.join(components(links), "node", "left").select("same", F.coalesce("root", "node").alias("first"))
    out = cut(base.select("rid", "same").join(known, "same").select("rid", "first"))
    discard(*tables)
    return out
