"""The fingerprints and the index of the pipeline's near-duplicate stage against brute force."""

import numpy as np
import pytest

from tracelake.llm import near_copies
from tracelake.llm.near_copies import MANY, NEAR, factors, fingerprint, index_of, near

from .test_near_copies import grouped, near_texts


def test_fingerprint_is_the_majority():
    rng, by = np.random.default_rng(3), factors(3)
    for n in (0, 1, 2, 254, 255, 256, 700):
        x = rng.integers(0, 2**64, n, dtype=np.uint64)
        h = (x[:, None] ^ by[0]) * by[1]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        want = [sum(int(v) >> bit & 1 for v in h[:, w]) * 2 > n for w in range(3) for bit in range(64)]
        assert np.unpackbits(fingerprint(x, by).view(np.uint8), bitorder="little").astype(bool).tolist() == want


def test_index_misses_few():
    for n in (0, 1, 1_000, 10**6, 10**7, 10**9):
        width, segments = index_of(n)
        assert n / 2**width <= 256 and (1 - (1 - near_copies.DIFFER) ** width) ** segments < 6e-6


def test_near_brute_force():
    """Bits as signed numbers, negative ones among them."""
    rng = np.random.default_rng(5)
    key = np.sort(rng.integers(0, 20, 300))
    base = rng.integers(-(2**63), 2**63, (2, 4))
    x, y = base[:, rng.integers(0, 4, 300)] ^ (1 << rng.integers(0, 63, (2, 300)))
    rid, root, n = np.arange(300), np.arange(300) // 3, rng.integers(70, 100, 300)
    far = lambda i, j: sum(bin((int(v[i]) ^ int(v[j])) & (2**64 - 1)).count("1") for v in (x, y))
    want = {(i, j) for j in range(300) for i in range(j) if key[i] == key[j] and root[i] != root[j] and far(i, j) <= NEAR and min(n[i], n[j]) >= 0.8 * max(n[i], n[j])}
    i, j, rows = near(key, rid, root, n, x, y, False, 10**6)
    assert len(want) > 100 and set(zip(i.tolist(), j.tolist())) == want and not len(rows)
    i, j, rows = near(key, rid, root, n, x, y, False, 0)
    assert not len(i) and set(key[rows]) == {key[j] for _, j in want} and len(rows) == np.isin(key, key[rows]).sum()


@pytest.mark.parametrize("many, chunk", [(MANY, 2048), (0, 2048), (0, 3)])
def test_crowded_values(spark, monkeypatch, many, chunk):
    """All values are crowded, then dealt in chunks; results stay those of all pairs."""
    texts = near_texts()
    monkeypatch.setattr(near_copies, "MANY", many)
    monkeypatch.setattr(near_copies, "CHUNK", chunk)
    docs = spark.createDataFrame(list(enumerate(texts)), "rid long, text string")
    assert {r.rid: r.first for r in near_copies.groups(docs).collect()} == dict(enumerate(grouped(texts)))
