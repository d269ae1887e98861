"""Near-duplicate documents by circulant MinHash."""

import os
import random
import sys
from collections import Counter

import numpy as np

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

from tidewatch.llm import circulant  # noqa: E402


def rows_of(df):
    return Counter(tuple(r) for r in circulant.near_duplicates(df).collect())


def want(df):
    found = brute.jaccard([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()], 85, 100, 5)
    return Counter({(i, n, c, i == c): k for (i, n, c), k in found.items()})


def test_near_dedup_equals_brute_force(corpus, small):
    for df in (corpus, small):
        assert rows_of(df) == want(df)


def test_near_dedup_of_nothing(nothing):
    out = circulant.near_duplicates(nothing)
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"] and out.count() == 0


def test_second_permutation_is_one_and_turns():
    places = np.arange(1 << 20, dtype=np.uint32) * np.uint32(4093)
    hashed = circulant.pi(places, np.empty_like(places), np.empty_like(places))
    assert len(np.unique(hashed)) == len(places)
    sets = [np.random.default_rng(k).integers(0, 2**63, 1 + 90 * k, dtype=np.uint64) for k in range(900)]
    got = circulant.signatures(np.concatenate(sets), np.array([len(s) for s in sets]))
    for k in (0, 1, 7, 400, 899):
        for turn in (0, 1, 77, 143):
            at = circulant.sigma(sets[k]) + np.uint32(turn + 1)
            assert got[turn, k] == circulant.pi(at, np.empty_like(at), np.empty_like(at)).min()


def test_coordinates_agree_as_often_as_the_sets_are_similar():
    rng = np.random.default_rng(5)
    for share in (0.3, 0.85):
        both = rng.integers(0, 2**63, int(1000 * share), dtype=np.uint64)
        agree = []
        for _ in range(30):
            a, b = (np.concatenate([both, rng.integers(0, 2**63, int(1000 * (1 - share) / 2), dtype=np.uint64)]) for _ in range(2))
            s = circulant.signatures(np.concatenate([a, b]), np.array([len(a), len(b)]))
            agree.append((s[:, 0] == s[:, 1]).mean())
        assert abs(np.mean(agree) - share) < 0.03


def test_pairs_at_the_threshold_and_large_families(spark):
    rng = random.Random(13)
    rows = []
    for k in range(300):  # pairs with as many changes as the threshold allows, and one more
        n = rng.randint(60, 400)
        words = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        rows.append((2 * k, " ".join(words)))
        copy = list(words)
        for at in range(5, 5 * max(1, round(n * 0.081 / 5)) + k % 2 * 5, 5):
            copy[at] = "changed" + str(at)
        rows.append((2 * k + 1, " ".join(copy)))
    base = [f"v{rng.randrange(10**6)}" for _ in range(150)]
    for k in range(1000, 1400):  # a family that only hangs together over its members
        words = list(base)
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(words)))
    rows += [(5000 + k, "  ".join(base).upper()) for k in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert rows_of(df) == want(df)
