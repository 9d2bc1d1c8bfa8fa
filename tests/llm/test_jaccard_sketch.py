"""Sketches tell sets apart that are too far from each other, also large ones, and never hide a similar pair."""

import numpy as np

from lookthru.llm import jaccard


def bits_and_allowed(rng, size, shared):
    x = rng.integers(0, 1 << 63, size, dtype=np.uint64)
    y = np.concatenate((x[:shared], rng.integers(0, 1 << 63, size - shared, dtype=np.uint64)))
    a, b = jaccard.sketches(np.concatenate((x, y)), np.array([size, size]))
    bits = sum(int(v).bit_count() for v in (a ^ b).view(np.uint64).tolist())
    return bits, (100 - jaccard.THRESHOLD) * 2 * size / (100 + jaccard.THRESHOLD), 2 * (size - shared)


def test_sketches_of_large_sets_tell_them_apart():
    rng = np.random.default_rng(3)
    for _ in range(50):
        bits, allowed, apart = bits_and_allowed(rng, 800, 680)   # similarity 0.74
        assert allowed < bits <= apart


def test_sketches_never_hide_a_similar_pair():
    rng = np.random.default_rng(4)
    for size in (1, 4, 40, 300, 3000):
        bits, allowed, apart = bits_and_allowed(rng, size, -(-size * 170 // 185))
        assert bits <= apart <= allowed


def test_sketches_are_made_some_at_a_time(monkeypatch):
    rng = np.random.default_rng(5)
    sizes = rng.integers(0, 30, 200)
    hashes = rng.integers(0, 1 << 63, sizes.sum(), dtype=np.uint64)
    whole = jaccard.sketches(hashes, sizes)
    monkeypatch.setattr(jaccard, "SKETCHED", 7)
    assert (jaccard.sketches(hashes, sizes) == whole).all() and whole.shape == (200, jaccard.SKETCH // 64)
    assert jaccard.sketches(hashes[:0], sizes[:0]).shape == (0, jaccard.SKETCH // 64)
