"""Suffix arrays, automata and repeats against brute force."""

import random
from hashlib import sha256

import numpy as np
import pytest

from tracelake.llm import _repeats, substring, suffix_array
from tracelake.llm.substring import Automaton


@pytest.mark.parametrize("alphabet,n", [(b"ab", 60), (b"a", 40), (b"abcdefgh", 300), (b"ab", 1)])
def test_suffix_array_and_common_prefixes(alphabet, n):
    text = bytes(random.Random(n).choices(alphabet, k=n))
    array, rank = suffix_array.suffix_array(np.frombuffer(text, np.uint8))
    assert array.tolist() == sorted(range(n), key=lambda i: text[i:])
    assert rank[array].tolist() == list(range(n))
    prefix = lambda a, b: next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
    want = [0, *(prefix(text[a:], text[b:]) for a, b in zip(array.tolist(), array.tolist()[1:]))]
    assert suffix_array.common_prefixes(text, array).tolist() == want


@pytest.mark.parametrize("seed", range(30))
def test_windows_of_pieces(seed):
    rng = random.Random(seed)
    rows = [{"content": bytes(rng.choices(b"ab", k=rng.randint(5, 60)))} for _ in range(rng.randint(1, 6))]
    seen = {}
    for k, r in enumerate(rows):
        for i in range(len(r["content"]) - 4):
            seen.setdefault(r["content"][i : i + 5], []).append((k, i))
    want = [sorted(i for v in seen.values() if len(v) > 1 for kk, i in v if kk == k) for k in range(len(rows))]
    assert suffix_array.occurs_elsewhere(rows, 5) == want
    assert suffix_array.occurs_earlier(rows, 5) == [sorted(i for v in seen.values() for kk, i in v[1:] if kk == k) for k in range(len(rows))]


@pytest.mark.parametrize("seed", range(30))
def test_automaton(seed):
    rng, before, a = random.Random(seed), [], Automaton()
    for _ in range(3):
        a.restart()
        word = []
        before.append(word)
        for _ in range(25):
            word.append(rng.choice("abc"))
            want = 0
            for n in range(1, len(word) + 1):
                end, last = word[-n:], len(before) - 1
                if any(w[i : i + n] == end for k, w in enumerate(before) for i in range(len(w) - n + (k < last))):
                    want = n
            assert a.push(word[-1]) == want


def texts():
    rng = random.Random(5)
    words = [f"w{i}é" for i in range(4000)]
    passage = [rng.choice(words) for _ in range(130)]
    out = []
    for i in range(60):
        own = [rng.choice(words) for _ in range(rng.randint(0, 200))]
        at = rng.randint(0, len(own))
        out.append(" ".join(own[:at] + (passage if i % 3 else passage[: rng.randint(1, 130)]) + own[at:]))
    return out + [out[7], out[7], "", None, "x " * 900, "ab" * 500, "  \n "]


@pytest.mark.parametrize("crowd", [2048, 2])
@pytest.mark.parametrize("module", [substring, suffix_array])
def test_against_brute_force(spark, module, crowd):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame([(i, t, "z", i) for i, t in rows], "doc_id long, text string, rid string, v int")
    found = {r.doc_id: r for r in module.deduplicate(docs, crowd=crowd).collect()}
    length = module.LENGTH
    symbols = [(t or "").encode().split() if module is substring else (t or "").encode() for _, t in rows]
    seen = {}
    for i, s in enumerate(symbols):
        for k in range(len(s) - length + 1):
            seen.setdefault(tuple(s[k : k + length]), []).append((i, k))
    for i, s in enumerate(symbols):
        gone = np.zeros(len(s), bool)
        for k in range(len(s) - length + 1):
            places = seen[tuple(s[k : k + length])]
            if (places[0] != (i, k)) if module is substring else len(places) > 1:
                gone[k : k + length] = True
        kept = [x for x, g in zip(s, gone) if not g]
        kept = b" ".join(kept) if module is substring else bytes(kept)
        assert (found[i].n, found[i].n_removed, found[i].kept_sha) == (len(s), gone.sum(), sha256(kept).hexdigest())
        if gone.any():
            assert found[i].kept == kept.decode("utf-8", "ignore")


def test_nulls_and_repeated_rows(spark):
    text = " ".join(f"word{i}" for i in range(120))
    docs = spark.createDataFrame([(1, text), (1, text), (None, text), (2, None), (None, None)], "doc_id long, text string")
    found = substring.deduplicate(docs).collect()
    assert sorted(r.n_removed for r in found) == [0, 0, 0, 120, 120]
    assert sorted(r.n_removed for r in suffix_array.deduplicate(docs).collect()) == [0, 0] + [len(text)] * 3
    assert substring.deduplicate(docs.limit(0)).count() == 0


def test_anchors_are_shared_by_equal_windows():
    x = suffix_array.Windows("abc" * 400)
    v, c = x.anchor_counts()
    assert len(v) <= 3 and c.sum() > 3
    assert isinstance(x, _repeats.Bytes)
