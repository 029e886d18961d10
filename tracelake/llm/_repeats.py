"""Finding every fixed-length window that occurs more than once in a corpus, without shipping all windows.

A window is LENGTH consecutive symbols (bytes or words) of one document. The steps, each over all documents:

1. *Anchors.* Every window has an anchor, the least hash among its GRAM-symbol grams. Equal windows have equal anchors, and
   neighbouring windows mostly share one, so a document has about 2 / (LENGTH - GRAM) anchors a symbol. Anchors are counted
   over the corpus; a window whose anchor occurs once can't repeat.
2. *Pieces.* Runs of windows with the same repeated anchor become pieces, identified by a 128-bit hash of their content.
   Where the same whole piece occurs twice, all its windows repeat. Pieces are counted by key with map-side combining, so a
   passage that a third of all documents share costs a row per task.
3. *Shards.* Different pieces with the same anchor may still share some windows. One copy of each is sent, by its anchor,
   to a shard of bounded size, where an index (a suffix array or a suffix automaton) finds the shared windows exactly. An
   anchor with more than CROWD different pieces or CROWD_BYTES of them isn't sent to one shard: its windows are grouped in blocks of 64
   offsets from the anchor. A block repeats where the hash of all that it covers repeats; its windows can't repeat where the hash
   of the symbols that they all have in common doesn't; the others are split into blocks of 16, 4 and 1. These are plain counts by key.
4. The decisions are joined back to the pieces, gathered by document and applied to the text.

Only documents with a repeated anchor are sent through steps 2 to 4.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut, discard, pieces_of, with_row_ids

#: An anchor with more different pieces, or with more bytes of them, isn't sent to one shard.
CROWD, CROWD_BYTES = 2048, 1_000_000
SHARD_BYTES = 500_000
#: The most keys that a join broadcasts because very many rows have them, and the fewest rows of such a key.
HOT_KEYS, LEAST_HOT = 10_000, 1_000
#: Windows of one block, by level.
BLOCKS = (64, 16, 4, 1)


def sliding(op, x: np.ndarray, width: int) -> np.ndarray:
    """op over every width consecutive elements."""
    k, y = 1, x
    while 2 * k <= width:
        y = op(y[:-k], y[k:])
        k *= 2
    return op(y[: len(y) - (width - k)], y[width - k :]) if width > k else y


def gram_hashes(symbols: np.ndarray, gram: int) -> np.ndarray:
    """A hash of every gram consecutive symbols; gram is a power of two."""
    h, k, base = symbols.astype(np.uint64), 1, np.uint64(0x9E3779B97F4A7C15)
    while k < gram:
        h = h[:-k] * base + h[k:]
        base = base * base + np.uint64(2 * k)
        k *= 2
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


class Symbols:
    """A text as symbols; content(i, j) is what symbols i to j are in bytes."""

    length: int
    gram: int

    def __init__(self, text: str | None):
        raise NotImplementedError

    @classmethod
    def of(cls, content: bytes):
        """The symbols of a piece."""
        x = cls("")
        x._set(content)
        return x

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Grams' hashes, and the anchor of every window."""
        with np.errstate(over="ignore"):
            g = gram_hashes(self.codes, self.gram)
        return g, sliding(np.minimum, g, self.length - self.gram + 1)

    def anchor_counts(self) -> tuple[np.ndarray, np.ndarray]:
        """The anchors of all windows and at how many places each stands."""
        if self.n < self.length:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        g, m = self.anchors()
        pad = np.zeros(self.length - self.gram, np.uint64)
        chosen = g[g == sliding(np.maximum, np.concatenate([pad, m, pad]), self.length - self.gram + 1)]
        return np.unique(chosen, return_counts=True)

    def runs(self, repeated: np.ndarray):
        """(anchor, first window, number of windows, whether the anchor stands there more than once)."""
        if self.n < self.length:
            return
        g, m = self.anchors()
        starts = np.concatenate([[0], np.flatnonzero(m[1:] != m[:-1]) + 1])
        ends = np.append(starts[1:], len(m))
        keep = np.isin(m[starts], repeated)
        for s, e in zip(starts[keep].tolist(), ends[keep].tolist()):
            yield m[s], s, e - s, int(np.count_nonzero(g[s : e + self.length - self.gram] == m[s])) > 1


class Words(Symbols):
    """Words `[^\\x20\\x09-\\x0D]+`, as they are."""

    def __init__(self, text: str | None):
        self._set((text or "").encode("utf-8", "surrogatepass"))

    def _set(self, data: bytes) -> None:
        self.words = data.split()
        self.n = len(self.words)

    @property
    def codes(self) -> np.ndarray:
        h = xxhash.xxh3_64_intdigest
        return np.fromiter((h(w) for w in self.words), dtype=np.uint64, count=self.n)

    def content(self, i: int, j: int) -> bytes:
        return b" ".join(self.words[i:j])

    def kept(self, removed: np.ndarray) -> bytes:
        return b" ".join(w for w, gone in zip(self.words, removed.tolist()) if not gone)


class Bytes(Symbols):
    """The bytes of the UTF-8 text."""

    def __init__(self, text: str | None):
        self._set((text or "").encode("utf-8", "surrogatepass"))

    def _set(self, data: bytes) -> None:
        self.data, self.n = data, len(data)

    @property
    def codes(self) -> np.ndarray:
        return np.frombuffer(self.data, np.uint8)

    def content(self, i: int, j: int) -> bytes:
        return self.data[i:j]

    def kept(self, removed: np.ndarray) -> bytes:
        return self.codes[~removed].tobytes()


def _rows(schema: dict[str, pa.DataType], columns: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.values())], names=list(schema))


def _scan(kind: type[Symbols]):
    """(rid, doc_id, text) to (rid, doc_id, n, sha, vs, cs)."""
    schema = {"rid": pa.int64(), "doc_id": pa.int64(), "n": pa.int64(), "sha": pa.string(), "vs": pa.list_(pa.int64()), "cs": pa.list_(pa.int64())}

    def run(batches):
        for b in batches:
            out = [[] for _ in schema]
            for rid, doc_id, text in zip(*(b.column(c).to_pylist() for c in ("rid", "doc_id", "text"))):
                x = kind(text)
                v, c = x.anchor_counts()
                for o, y in zip(out, (rid, doc_id, x.n, sha256(x.content(0, x.n)).hexdigest(), v.view(np.int64), c)):
                    o.append(y)
            yield _rows(schema, out)

    return run, "rid long, doc_id long, n long, sha string, vs array<long>, cs array<long>"


def _cut_pieces(kind: type[Symbols]):
    """(rid, text, vs) to (rid, text, pieces)."""
    piece = pa.struct([("v", pa.int64()), ("ph", pa.binary()), ("s", pa.int32()), ("nw", pa.int32()), ("own", pa.bool_()), ("size", pa.int32())])
    schema = {"rid": pa.int64(), "text": pa.string(), "pieces": pa.list_(piece)}

    def run(batches):
        for b in batches:
            out = [[] for _ in schema]
            for rid, text, vs in zip(*(b.column(c).to_pylist() for c in ("rid", "text", "vs"))):
                x, found = kind(text), []
                for v, s, nw, own in x.runs(np.array(vs, np.int64).view(np.uint64)):
                    content = x.content(s, s + nw - 1 + x.length)
                    found.append({"v": int(v.view(np.int64)), "ph": xxhash.xxh3_128_digest(content), "s": s, "nw": nw, "own": own, "size": len(content)})
                for o, y in zip(out, (rid, text, found)):
                    o.append(y)
            yield _rows(schema, out)

    return run, "rid long, text string, pieces array<struct<v:long,ph:binary,s:int,nw:int,own:boolean,size:int>>"


def _contents(kind: type[Symbols]):
    """(text, wanted) to (shard, v, ph, rid, s, nw, content)."""
    schema = {"shard": pa.int64(), "v": pa.int64(), "ph": pa.binary(), "rid": pa.int64(), "s": pa.int32(), "nw": pa.int32(), "content": pa.binary()}

    def run(batches):
        for b in batches:
            texts, wanted = b.column("text").to_pylist(), b.column("wanted").to_pylist()
            for i, j in pieces_of(texts, 4_000_000):
                out = [[] for _ in schema]
                for text, want in zip(texts[i:j], wanted[i:j]):
                    x = kind(text)
                    for p in want:
                        for o, y in zip(out, (p["shard"], p["v"], p["ph"], p["rid"], p["s"], p["nw"], x.content(p["s"], p["s"] + p["nw"] - 1 + x.length))):
                            o.append(y)
                yield _rows(schema, out)

    return run, "shard long, v long, ph binary, rid long, s int, nw int, content binary"


def _shard(find):
    """A shard's pieces to (v, ph, offs): the windows that find() names for each."""
    schema = {"v": pa.int64(), "ph": pa.binary(), "offs": pa.list_(pa.int32())}

    def run(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: (r["v"], r["rid"], r["s"]))
        found = find(rows)
        return pa.table([pa.array([r["v"] for r in rows], pa.int64()), pa.array([r["ph"] for r in rows], pa.binary()), pa.array(found, schema["offs"])], names=list(schema))

    return run, "v long, ph binary, offs array<int>"


def _blocks(kind: type[Symbols], size: int):
    """Crowded pieces to a row for each place of the anchor and block of offsets from it, of the windows in todo, or of all.

    (v, ph, rid, first, last, core, whole): the windows from first to last; core: a hash of what all windows of such a block have
    in common, whole: one of all that its windows cover, with their offsets.
    """
    schema = {"v": pa.int64(), "ph": pa.binary(), "rid": pa.int64(), "first": pa.int32(), "last": pa.int32(), "core": pa.binary(), "whole": pa.binary()}

    def run(batches):
        h = xxhash.xxh3_128_digest
        for b in batches:
            for r in b.to_pylist():
                out, x = [[] for _ in schema], kind.of(r["content"])
                with np.errstate(over="ignore"):
                    g = gram_hashes(x.codes, x.gram)
                places = np.flatnonzero(g == np.int64(r["v"]).view(np.uint64))
                ranges = [(t["first"] - r["s"], t["last"] - r["s"]) for t in r["todo"]] if r["todo"] is not None else [(0, r["nw"])]
                starts = np.concatenate([np.arange(*t) for t in sorted(ranges)])
                at = places[np.searchsorted(places, starts)]  # the first place of the anchor in each window
                block = (at - starts) // size
                new = (at[1:] != at[:-1]) | (block[1:] != block[:-1]) | (starts[1:] != starts[:-1] + 1)
                turn = np.concatenate([[0], np.flatnonzero(new) + 1, [len(starts)]]).tolist()
                for a, e in zip(turn[:-1], turn[1:]):
                    i, j, k, p = int(starts[a]), int(starts[e - 1]), int(block[a]), int(at[a])
                    core = x.content(max(0, p - k * size), p - (k + 1) * size + 1 + x.length)
                    whole = x.content(i, j + x.length)
                    for o, y in zip(out, (r["v"], r["ph"], r["rid"], r["s"] + i, r["s"] + j + 1, h(core + b"|%d" % k), h(whole + b"|%d|%d" % (p - i, p - j)))):
                        o.append(y)
                yield _rows(schema, out)

    return run, "v long, ph binary, rid long, first int, last int, core binary, whole binary"


def _apply(kind: type[Symbols], with_text: bool):
    """(rid, text, gone) to (rid, n_removed, n_spans, sha, kept)."""
    schema = {"rid": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha": pa.string(), "kept": pa.string()}

    def run(batches):
        for b in batches:
            out = [[] for _ in schema]
            for rid, text, gone in zip(*(b.column(c).to_pylist() for c in ("rid", "text", "gone"))):
                x = kind(text)
                edge = np.zeros(x.n + 1, np.int32)
                for p in gone:
                    if p["all"]:
                        edge[p["s"]] += 1
                        edge[p["s"] + p["nw"] - 1 + x.length] -= 1
                    else:
                        at = np.array(p["offs"], np.int64) + p["s"]
                        np.add.at(edge, at, 1)
                        np.add.at(edge, at + x.length, -1)
                removed = np.cumsum(edge[:-1]) > 0
                kept = x.kept(removed)
                spans = int(np.count_nonzero(removed[1:] & ~removed[:-1])) + int(x.n > 0 and removed[0])
                for o, y in zip(out, (rid, int(removed.sum()), spans, sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if with_text else None)):
                    o.append(y)
            yield _rows(schema, out)

    return run, "rid long, n_removed long, n_spans long, kept_sha string, kept string"


def _matched(rows: DataFrame, known: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """rows joined by keys with known(keys, c, ...), where c is the number of rows that have the key.

    Keys with more than a share of 1 / HOT_KEYS of all rows, of which there can be no more than HOT_KEYS, are broadcast; their rows
    stay where they are. No key of the rest has enough rows to weigh on a task.
    """
    total = known.agg(F.sum("c")).first()[0] or 0
    known = known.withColumn("hot", F.col("c") > max(LEAST_HOT, total // HOT_KEYS))
    hot = F.broadcast(known.filter("hot").drop("hot", "c"))
    if known.filter("hot").limit(1).count() == 0:
        return rows.join(known.drop("hot", "c"), keys, how)
    rest = rows.join(F.broadcast(known.filter("hot").select(*keys)), keys, "left_anti")
    return rest.join(known.filter("not hot").drop("hot", "c"), keys, how).union(rows.join(hot, keys, "inner" if how == "left" else how))


def remove_repeats(docs: DataFrame, kind: type[Symbols], find, keep_first: bool, with_text: bool = False, crowd: int = CROWD, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """docs(doc_id, text) to (rid, doc_id, n, n_removed, n_spans, kept_sha, kept).

    keep_first: the first of equal windows, by document and place, isn't removed. find: names, for a shard's pieces in order of
    anchor and place, the offsets of the windows that other pieces (or, with keep_first, earlier places) have. kept is null
    where nothing is removed or with_text isn't set.
    """
    keyed = with_row_ids(docs, "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    base = cut(keyed.mapInArrow(*_scan(kind)))
    anchors = base.select("rid", F.explode(F.arrays_zip("vs", "cs")).alias("x")).select("rid", F.col("x.vs").alias("v"), F.col("x.cs").alias("places"))
    repeated = cut(anchors.groupBy("v").agg(F.sum("places").alias("places"), F.count(F.lit(1)).alias("c")).filter("places > 1").select("v", "c"))
    lists = _matched(anchors.select("rid", "v"), repeated, ["v"], "left_semi").groupBy("rid").agg(F.collect_list("v").alias("vs"))
    cand = cut(keyed.select("rid", "text").join(lists, "rid").mapInArrow(*_cut_pieces(kind)))
    pieces = cand.select("rid", F.explode("pieces").alias("p")).select("rid", "p.*")
    kinds = cut(
        pieces.groupBy("v", "ph").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("rid", "s")).alias("first"), F.max("own").alias("own"), F.max("nw").alias("nw"), F.max("size").alias("size"))
    )
    open_ = "true" if keep_first else "alone = 1"
    groups = kinds.groupBy("v").agg(F.count(F.lit(1)).alias("c"), F.max("own").alias("any_own"), F.min("n").alias("alone"), F.sum("size").alias("bytes")).filter(f"(c > 1 or any_own) and {open_}")
    groups = groups.withColumn("crowded", (F.col("c") > crowd) | (F.col("bytes") > CROWD_BYTES))
    need = cut(_matched(kinds, groups.select("v", "c", "crowded"), ["v"]).select("v", "ph", "n", "first.*", "nw", "size", "crowded"))
    plain_bytes = need.filter("not crowded").agg(F.sum("size")).first()[0] or 0
    shards = max(1, -(-int(plain_bytes) // shard_bytes))
    shard = F.when(F.col("crowded"), F.lit(-1)).otherwise(F.pmod(F.xxhash64("v"), F.lit(shards)))
    wanted = need.groupBy("rid").agg(F.collect_list(F.struct(shard.cast("long").alias("shard"), "v", "ph", "rid", "s", "nw")).alias("wanted"))
    contents = cut(cand.select("rid", "text").join(wanted, "rid").select("text", "wanted").mapInArrow(*_contents(kind)))
    run, schema = _shard(find)
    found = contents.filter("shard >= 0").groupBy("shard").applyInArrow(run, schema).filter("size(offs) > 0")
    if need.filter("crowded").limit(1).count():
        found = found.union(_crowded(contents.filter("shard < 0"), kind, need, keep_first))
    # Whole pieces go where their content stands before (or elsewhere), windows from the one copy of a piece that remains.
    copies = kinds.filter("n > 1").select("v", "ph", F.col("n").alias("c"), "first")
    copies = _matched(pieces, copies, ["v", "ph"])
    if keep_first:
        copies = copies.filter((F.col("first.rid") != F.col("rid")) | (F.col("first.s") != F.col("s")))
    whole = copies.select("rid", F.struct("s", "nw", F.lit(True).alias("all"), F.lit(None).cast("array<int>").alias("offs")).alias("g"))
    single = (kinds if keep_first else kinds.filter("n = 1")).select("v", "ph", "first.*", "nw")
    some = single.join(found, ["v", "ph"]).select("rid", F.struct("s", "nw", F.lit(False).alias("all"), "offs").alias("g"))
    gone = cut(whole.union(some).groupBy("rid").agg(F.collect_list("g").alias("gone")))
    discard(repeated, kinds, need, contents)
    done = cand.select("rid", "text").join(gone, "rid").mapInArrow(*_apply(kind, with_text))
    return base.select("rid", "doc_id", "n", "sha").join(done, "rid", "left").select(
        "rid", "doc_id", "n", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("kept_sha", "sha").alias("kept_sha"), "kept"
    )


def _crowded(contents: DataFrame, kind: type[Symbols], need: DataFrame, keep_first: bool) -> DataFrame:
    """The repeated windows of pieces whose anchor has too many different ones for a shard: (v, ph, offs)."""
    found, todo = None, contents.withColumn("todo", F.lit(None).cast("array<struct<first:int,last:int>>"))
    for size in (b for b in BLOCKS if b < 2 * (kind.length - kind.gram + 1)):  # larger ones hold all windows of an anchor
        blocks = cut(todo.select("v", "ph", "rid", "s", "nw", "content", "todo").mapInArrow(*_blocks(kind, size)))
        cores = blocks.groupBy("v", "core").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
        wholes = blocks.groupBy("v", "whole").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("rid", "first")).alias("least")).filter("c > 1")
        state = _matched(_matched(blocks, cores, ["v", "core"], "left_semi").drop("core"), wholes, ["v", "whole"], "left")
        # The first of equal blocks goes on for them all: its windows may start in other blocks too.
        again = F.col("least").isNotNull()
        first = again & (F.col("least.rid") == F.col("rid")) & (F.col("least.first") == F.col("first"))
        state = cut(state.select("v", "ph", "first", "last", (again & ~first if keep_first else again).alias("hit"), (~again | first).alias("open")))
        hits = state.filter("hit").select("v", "ph", "first", "last")
        found = hits if found is None else found.union(hits)
        open_ = state.filter("open").groupBy("v", "ph").agg(F.collect_list(F.struct("first", "last")).alias("todo"))
        todo = contents.join(open_, ["v", "ph"])
    starts = need.filter("crowded").select("v", "ph", "s")
    offs = F.sequence(F.col("first") - F.col("s"), F.col("last") - F.col("s") - 1)
    return found.join(starts, ["v", "ph"]).groupBy("v", "ph").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(offs)))).alias("offs"))
