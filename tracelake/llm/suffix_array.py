"""Substring deduplication by suffix arrays over bytes.

Every byte covered by a LENGTH-byte string that also starts anywhere else, in the same document or another, is removed; strings are
judged on the input. The pipeline's form, cut_repeats, takes strings of PASSAGE bytes and leaves the first copy of each. What may repeat is found and dealt to shards of bounded size as in _repeats. A shard's suffix array is
made by Larsson-Sadakane refinement (only groups of suffixes that are still equal are sorted again, by the ranks twice as far
on), common prefixes by Kasai's scan; runs with common prefixes of LENGTH bytes are the repeats. Shards are dealt by anchor, so
that equal strings always meet in one shard and no string needs a search in another's array; only what is too much
for one shard is merged across shards, by counting keys (see _repeats, step 3).

Defined cases: a null text is empty. Texts under LENGTH bytes lose nothing. Rows with equal or null doc_ids are different documents.
Where a cut goes through a character, the text form of the rest leaves its remaining bytes out; the digest has them. An empty
table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import free_name, numbered, table
from ._repeats import CROWD, Bytes, remove_repeats

LENGTH = 400
#: For the pipeline: passages of over 50 words are longer than this in any language written in words (four letters and a space each).
PASSAGE = 200


class Windows(Bytes):
    length, gram = LENGTH, 32


class Passages(Bytes):
    length, gram = PASSAGE, 32


def suffix_array(text: np.ndarray, depth: int | None = None, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of bytes, and each suffix's rank.

    With depth, suffixes that share so many bytes stay in any order. With wanted too, only those suffixes are brought to that
    depth; the others, which only lend their ranks, may stop at half of it.
    """
    n = len(text)
    padded = np.concatenate([text.astype(np.uint64) + np.uint64(1), np.zeros(7, np.uint64)])
    key = np.zeros(n, np.uint64)
    for i in range(7):  # 7 symbols of 9 bits
        key = (key << np.uint64(9)) | padded[i : i + n]
    array = np.argsort(key)
    sorted_key = key[array]
    head = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
    rank = np.empty(n, np.int64)
    rank[array] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    h = 7
    while depth is None or h < depth:
        unsorted = np.flatnonzero(~head | np.append(~head[1:], False))  # places in groups of two or more
        if wanted is not None and 2 * h >= depth:  # the last round: whole groups in which a wanted suffix is
            some = np.zeros(n, bool)
            some[rank[wanted]] = True
            unsorted = unsorted[some[rank[array[unsorted]]]]
        if not len(unsorted):
            break
        at = array[unsorted]
        ahead = at + h
        both = rank[at] * (n + 1) + np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        order = np.argsort(both)
        at, both = at[order], both[order]
        array[unsorted] = at
        new = np.concatenate([[True], both[1:] != both[:-1]])
        head[unsorted] = new
        rank[at] = unsorted[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        h *= 2
    return array, rank


def common_prefixes(text: bytes, array: np.ndarray, most: int | None = None, rank: np.ndarray | None = None) -> np.ndarray:
    """Kasai's scan: for each place of an array of suffixes, the common prefix, up to most, with the suffix before it.

    The array may leave suffixes out. Then what a suffix takes over from the one before it in the text holds only if the
    other's successor is in the array too; else the scan starts anew there. With rank, suffixes of equal rank are known to share
    most bytes and may be in any order, so that nothing is taken over from them.
    """
    before = np.full(len(text) + 1, -1, np.int64)
    before[array[1:]] = array[:-1]
    inside = np.zeros(len(text) + 1, bool)
    inside[array] = True
    places = np.flatnonzero(inside)
    out, h, last, most = [0] * len(places), 0, -2, len(text) if most is None else most
    tied = np.zeros(len(places), bool) if rank is None else (before[places] >= 0) & (rank[places] == rank[before[places]])
    carried = (inside[before[places] + 1] & ~tied).tolist()
    carry = False
    for k, (i, j, goes_on, tie) in enumerate(zip(places.tolist(), before[places].tolist(), carried, tied.tolist())):
        h = h - 1 if carry and h > 0 and i == last + 1 else 0
        last, carry = i, goes_on
        if j < 0:
            h, carry = 0, False
            continue
        if tie:
            out[k] = most
            continue
        while h < most:  # by blocks while whole blocks are equal, then byte by byte
            size = min(64, most - h)
            a, b = text[i + h : i + h + size], text[j + h : j + h + size]
            if a == b and len(a) == size:
                h += size
                continue
            for x, y in zip(a, b):
                if x != y:
                    break
                h += 1
            break
        out[k] = h
    found = np.zeros(len(text) + 1, np.int64)
    found[places] = out
    return found[array]


def _hits(rows: list[dict], length: int, keep_first: bool) -> list[list[int]]:
    data = b"".join(r["content"] for r in rows)
    if not data:
        return [[] for _ in rows]
    sizes = np.array([len(r["content"]) for r in rows])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    window = np.zeros(len(data) + 1, np.int32)  # where whole windows start
    np.add.at(window, starts, 1)
    np.add.at(window, starts + np.maximum(0, sizes - length + 1), -1)
    is_window = np.cumsum(window)[:-1] > 0
    array, rank = suffix_array(np.frombuffer(data, np.uint8), length, np.flatnonzero(is_window))
    array = array[is_window[array]]
    if not len(array):
        return [[] for _ in rows]
    heads = common_prefixes(data, array, length, rank) < length
    heads[0] = True
    group = np.cumsum(heads) - 1
    if keep_first:
        hits = array[array != np.minimum.reduceat(array, np.flatnonzero(heads))[group]]
    else:
        hits = array[np.bincount(group)[group] > 1]
    hits = np.sort(hits)
    bounds = np.searchsorted(hits, np.append(starts, len(data)))
    return [(hits[a:b] - s).tolist() for a, b, s in zip(bounds[:-1], bounds[1:], starts)]


def occurs_elsewhere(rows: list[dict], length: int = LENGTH) -> list[list[int]]:
    """For each piece, the offsets of the windows that another piece, or another place of it, has."""
    return _hits(rows, length, keep_first=False)


def occurs_earlier(rows: list[dict], length: int = PASSAGE) -> list[list[int]]:
    """For each piece, the offsets of the windows that a piece before it, or an earlier place of it, has."""
    return _hits(rows, length, keep_first=True)


def deduplicate(docs: DataFrame, with_text: bool = True, crowd: int = CROWD, keep_first: bool = False) -> DataFrame:
    """docs(doc_id, text) to (rid, doc_id, n, n_removed, n_spans, kept_sha, kept); kept is null where nothing is removed.

    Strings of LENGTH bytes lose every copy. With keep_first, strings of PASSAGE bytes lose every copy but the first, by doc_id and place.
    """
    if keep_first:
        return remove_repeats(docs, Passages, occurs_earlier, keep_first=True, with_text=with_text, crowd=crowd)
    return remove_repeats(docs, Windows, occurs_elsewhere, keep_first=False, with_text=with_text, crowd=crowd)


def op7_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = deduplicate(table(spark, sf_dir, "documents"), with_text=False)
    return found.select("doc_id", F.col("n").alias("n_bytes"), "n_removed", "n_spans", F.col("kept_sha").alias("kept_sha256"))


def cut_repeats(docs: DataFrame) -> DataFrame:
    """docs without what strings of PASSAGE bytes cover that start earlier too; the first copy of a passage stays.

    Earlier is: in a document with a smaller doc_id, or before in the same one. Documents of which only white space is left go;
    n_chars, if there, follows the text. Rows whose doc_id is null (last) or repeated are told apart by their number. Other columns
    may have any names.
    """
    rid = free_name(docs, "_rid")
    rows = numbered(docs, rid)
    found = deduplicate(rows.select(F.col(rid).alias("doc_id"), "text"), keep_first=True).filter("n_removed > 0")
    left = free_name(docs, "_kept")
    found = found.select(F.col("doc_id").alias(rid), F.col("kept").alias(left))
    was, now = F.col("text"), F.col(left)
    out = rows.join(found, rid, "left").filter(now.isNull() | now.rlike(r"[^\x09-\x0D\x20]"))
    columns = {c: F.col(f"`{c}`") for c in docs.columns} | {"text": F.coalesce(now, was)}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(now.isNull(), F.col("n_chars")).otherwise(F.length(now).cast(docs.schema["n_chars"].dataType))
    return out.select(*(x.alias(c) for c, x in columns.items()))
