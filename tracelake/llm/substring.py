"""Substring deduplication by suffix automata over words.

Every word covered by a LENGTH-word window that also starts earlier (in a smaller doc_id, or before in the same document) is
removed; windows are judged on the input. Reference shards hold one copy of each passage that may repeat (see _repeats);
in a shard, the passages are streamed in document order through a suffix automaton of all passages before, whose matching
statistics (the longest match that ends at each word) show every window that has been seen. The automata aren't
broadcast: the passages that repeat grow with the corpus, so a broadcast has no size bound, and each passage is sent to the one
shard that can match it instead.

Defined cases: a null text has no words. Texts under LENGTH words lose nothing. Rows with equal or null doc_ids are ordered after
their doc_id (nulls last) by text; the first keeps its words. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table
from ._repeats import CROWD, Words, remove_repeats

LENGTH = 20


class Windows(Words):
    length, gram = LENGTH, 8


class Automaton:
    """A suffix automaton that grows word by word and keeps the longest match of the stream with what came before."""

    def __init__(self):
        self.next, self.link, self.len = [{}], [-1], [0]
        self.last, self.state, self.matched = 0, 0, 0

    def restart(self) -> None:
        """The next words are those of another passage."""
        self.last, self.state, self.matched = 0, 0, 0

    def push(self, c) -> int:
        """The longest match, ending at c, with anything before; then c is added."""
        nxt, link, length = self.next, self.link, self.len
        s, m = self.state, self.matched
        while s and c not in nxt[s]:
            s = link[s]
            m = length[s]
        if c in nxt[s]:
            s, m = nxt[s][c], m + 1
        else:
            m = 0
        self._extend(c)
        while s and m <= length[link[s]]:
            s = link[s]
        self.state, self.matched = s, m
        return m

    def _extend(self, c) -> None:
        nxt, link, length, p = self.next, self.link, self.len, self.last
        if c in nxt[p]:  # another passage has this prefix already
            q = nxt[p][c]
            self.last = q if length[q] == length[p] + 1 else self._clone(p, q, c)
            return
        cur = len(nxt)
        nxt.append({})
        length.append(length[p] + 1)
        link.append(0)
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, q, c)
        self.last = cur

    def _clone(self, p: int, q: int, c) -> int:
        nxt, link, length = self.next, self.link, self.len
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = new
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new


def seen_before(rows: list[dict], length: int = LENGTH) -> list[list[int]]:
    """For each passage, in order of anchor and place, the windows that earlier ones of its anchor (or it itself, earlier) have."""
    out, anchor, automaton = [], None, None
    for r in rows:
        if r["v"] != anchor:
            anchor, automaton = r["v"], Automaton()
        automaton.restart()
        offs = []
        for i, w in enumerate(r["content"].split()):
            if automaton.push(w) >= length:
                offs.append(i - length + 1)
        out.append(offs)
    return out


def deduplicate(docs: DataFrame, with_text: bool = True, crowd: int = CROWD) -> DataFrame:
    """docs(doc_id, text) to (rid, doc_id, n, n_removed, n_spans, kept_sha, kept); kept is null where nothing is removed."""
    return remove_repeats(docs, Windows, seen_before, keep_first=True, with_text=with_text, crowd=crowd)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = deduplicate(table(spark, sf_dir, "documents"), with_text=False)
    return found.select("doc_id", F.col("n").alias("n_words"), "n_removed", F.col("kept_sha").alias("kept_sha256"))
