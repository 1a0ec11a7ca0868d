"""Links by shingle sets: every pair of 0.8 or more, against all pairs."""

import random
from itertools import combinations

import numpy as np
import pytest

import corpus_pipeline
from turnstile.llm import set_links, simhash

SF = "/root/testdata/sf0.001"


def kept(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted(r.doc_id for r in dict(corpus_pipeline.STAGES)["near_copies"](spark, docs, SF).collect())


def firsts(rows):
    """The smallest id of each group, by all pairs."""
    sets = [simhash.shingle_set(t.encode()) for _, t in rows]
    forest = simhash.Forest()
    for i, j in combinations(range(len(rows)), 2):
        if simhash.alike(sets[i], sets[j]):
            forest.join(i, j)
    return sorted({min(rows[j][0] for j in range(len(rows)) if forest.root(j) == forest.root(i)) for i in range(len(rows))})


def far_apart(rng, bits):
    """Two texts of 0.8 or more whose fingerprints differ by over ``bits`` bits."""
    while True:
        own = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(30, 60))]
        other = [*own, *(f"w{rng.randrange(10**6)}" for _ in range(len(own) // 5))]
        a, b = " ".join(own), " ".join(other)
        sets = [simhash.shingle_set(t.encode()) for t in (a, b)]
        prints = [simhash.fingerprint(t.encode(), simhash.WIDE_SHINGLE) for t in (a, b)]
        if simhash.alike(*sets) and (prints[0] ^ prints[1]).bit_count() > bits:
            return a, b


def test_links_that_fingerprints_miss_are_found(spark):
    """Pairs of 0.8 whose fingerprints are further apart than the quick search looks, and a pair just under it."""
    rng = random.Random(13)
    rows = []
    for i in range(30):
        rows += [(10 * i + k, t) for k, t in enumerate(far_apart(rng, simhash.WIDE_RADIUS))]
    words = [f"v{i}" for i in range(84 + 21)]
    rows += [(1000, " ".join(words[:84])), (1001, " ".join(words[:104])), (2000, " ".join(words[:83])), (2001, " ".join(words))]
    rows += [(3000, "one two three four"), (3001, "One  two three\tfour"), (3002, "one two three"), (3003, "one two three four five")]
    got = kept(spark, rows)
    assert got == firsts([r for r in rows if r[0] != 3001]) and 3002 in got and 3003 in got
    assert [i for i in got if i < 1000] == [10 * i for i in range(30)]


def lines(rng, texts):
    """Texts of common lines in any order, a few words of their own among them: most shingles are frequent."""
    common = [" ".join(f"c{i}w{k}" for k in range(14)) for i in range(12)]
    rows = []
    for i in range(texts):
        own = [*rng.sample(common, 9), " ".join(f"own{i}x{k}" for k in range(rng.randint(0, 30)))]
        rows += [(2 * i, "\n".join(own))]
        if i % 3 == 0:
            rows += [(2 * i + 1, "\n".join(own) + " " + " ".join(f"more{i}x{k}" for k in range(rng.randint(1, 30))))]
    return rows


@pytest.mark.parametrize("known,piece", [(1 << 18, 8192), (50, 40), (0, 40)])
def test_links_among_frequent_shingles(spark, known, piece, monkeypatch):
    """The order of the shingles and the size of pieces don't change the result."""
    monkeypatch.setattr(set_links, "KNOWN", known)
    monkeypatch.setattr(set_links, "PIECE", piece)
    rows = lines(random.Random(3), 120)
    assert kept(spark, rows) == firsts(rows)


def test_prefixes_meet_wherever_sets_link():
    """Sets just at and just under 0.8, under several orders: linked ones share a shingle early enough."""
    rng = random.Random(5)
    linked = 0
    for _ in range(4000):
        n = rng.choice([1, 2, 3, 5, 9, 40, 400])
        shared = [rng.getrandbits(64) for _ in range(n)]
        some = lambda: [rng.getrandbits(64) for _ in range(rng.randint(0, n // 4 + 1))]
        a, b = (np.array(sorted({*shared, *some()}), np.uint64) for _ in range(2))
        often = np.array(sorted(rng.sample(shared, rng.randint(0, n))), np.uint64)
        counts = np.array([rng.randint(1, 9) for _ in often], np.int64)
        x, y = (set_links.in_order(s, often, counts).tolist() for s in (a, b))
        met = [min(len(a) - x.index(t), len(b) - y.index(t)) for t in set(x) & set(y)]
        least = set_links.least_shared(len(a), len(b))
        differ = set_links.parities_apart(set_links.parities(a), set_links.parities(b))
        assert differ <= len(a) + len(b) - 2 * n
        if simhash.alike(a, b):
            linked += 1
            assert max(met) >= least and differ <= len(a) + len(b) - 2 * least
        else:
            assert n < least
    assert 1000 < linked < 3500


def test_pairs_of_groups_against_all_pairs(monkeypatch):
    """Small and large groups give the same pairs: of different roots, with enough shingles left."""
    rng = np.random.default_rng(7)
    keys = np.sort(rng.integers(0, 12, 300))
    size = rng.integers(20, 40, 300).astype(np.int32)
    rest = (size - rng.integers(0, 9, 300)).astype(np.int32)
    root = rng.integers(0, 4, 300)
    want = set()
    for i, j in combinations(range(300), 2):
        if keys[i] == keys[j] and root[i] != root[j] and min(rest[i], rest[j]) >= set_links.least_shared(size[i], size[j]):
            want.add((i, j))
    for small in (0, 20, 64):
        monkeypatch.setattr(set_links, "SMALL", small)
        got = [(min(x, y), max(x, y)) for a, b in set_links._pairs([keys, keys, size, rest, root]) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
        assert len(got) == len(set(got)) and set(got) == want and want
