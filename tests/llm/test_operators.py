"""Every operator of ``turnstile.llm`` on small fixtures, against brute force and on odd input."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from turnstile.llm import decontam, lattice, licenses, lm_scoring, mixing, quality, sentence_dedup, sharding, simhash, suffix_array, suffix_dedup, toxicity

#: Extra columns with names that operators use themselves.
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, key string, h double, slot string, kept int, name string"


def frame(spark, rows):
    """Rows (doc_id, text, source) with extra columns of clashing names."""
    full = [(i, t, "en", s, len(t or ""), 7, "k", 0.5, "x", 3, "n") for i, t, s in rows]
    return spark.createDataFrame(full, DOCS).repartition(3)


WORDS = "the and of hain thble eredst anwh onting ouer sheal riont dath ingel".split()


def prose(rng, n):
    out = []
    for i in range(n):
        out.append(rng.choice(WORDS) + rng.choice(["", "", "er", "ing"]))
        if i % 7 == 6:
            out[-1] += "."
    return " ".join(out)


@pytest.fixture(scope="module")
def corpus():
    """Ordinary, copied, near-copied, odd, null and very long texts."""
    rng = random.Random(5)
    base = [prose(rng, rng.randint(5, 120)) for _ in range(40)]
    passage = prose(rng, 60)
    rows = [(i, t, f"s{i % 3}") for i, t in enumerate(base)]
    rows += [(100 + i, base[3], "hot") for i in range(25)]
    rows += [(200 + i, base[i] + " " + passage + " " + base[i + 1], "hot") for i in range(12)]
    rows += [(300, None, None), (301, "", "s0"), (302, "   \n\t ", "s1"), (303, "a" * 500, "s1"), (304, "ab" * 300, None), (305, prose(rng, 30_000), "s2")]
    rows += [(306, "é ñ ß 漢字 " * 40, "s0"), (None, base[5], "s0"), (None, "only here without an id at all", "s1"), (7, base[7], "s1"), (7, base[7], "s1")]
    return rows


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return frame(spark, corpus)


def empty(spark):
    return spark.createDataFrame([], DOCS)


# ---------------------------------------------------------------- mixing


def targets_by_resharing(sizes, weights, share, most):
    """The contract's words: reshare the excess until no target is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, target, free = share * sum(sizes.values()), {}, set(names)
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > most * sizes[s]}
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        free -= over
    return target


def test_mix(spark, docs, corpus):
    got = mixing.mix(docs, tilt=F.log2(F.col("size") + 2)).collect()
    assert len(got) == len(corpus)
    assert got == mixing.mix(docs, tilt=F.log2(F.col("size") + 2)).collect() or sorted(map(str, got)) == sorted(
        map(str, mixing.mix(docs, tilt=F.log2(F.col("size") + 2)).collect())
    )
    sizes = defaultdict(int)
    for _, text, source in corpus:
        sizes[source] += len((text or "").encode().split())
    want = targets_by_resharing(sizes, (5, 2, 1), 1.5, 2)
    taken = defaultdict(int)
    largest = defaultdict(int)
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
        assert 0 <= r.copies <= 2 and r.lang == "en" and r.key == "k"
        taken[r.source] += r.copies * r.size
        largest[r.source] = max(largest[r.source], r.size)
    for s, t in want.items():
        assert abs(taken[s] - t) <= largest[s] / 2 + 1
    assert mixing.mix(empty(spark)).count() == 0


def test_mix_of_many_equal_sources(spark):
    rows = [(i, "one two three", f"s{i % 40:02d}") for i in range(4000)]
    got = mixing.mix(frame(spark, rows)).groupBy("source").agg(F.sum(F.col("copies") * 3).alias("n"), F.first("target").alias("t")).collect()
    assert all(abs(r.n - r.t) <= 2 for r in got)


def test_pareto_prefers_what_is_tilted(spark):
    rows = [(i, "w " * 10, "a") for i in range(3000)] + [(9000 + i, "w " * 10, "b") for i in range(3000)]
    got = mixing.mix(frame(spark, rows), weights=(1, 9), share=0.5, tilt=F.when(F.col("doc_id") % 2 == 0, 4.0).otherwise(1.0))
    r = got.where("source = 'a'").groupBy((F.col("doc_id") % 2).alias("odd")).agg(F.sum("copies").alias("n")).orderBy("odd").collect()
    assert r[0].n > 2.5 * r[1].n


def brute_pareto(spark, rows, want, most):
    """Rank by odds(U) / odds(p) within each source, whole copies first, a row in if its middle is."""
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").select("*", F.xxhash64(F.lit(20), "doc_id", "text").alias("tie"))
    own = defaultdict(list)
    for r in df.collect():
        u = (((r.tie % (1 << 64)) >> 11) + 0.5) / (1 << 53)
        own[r.source].append((u / (1 - u), r.tie, len((r.text or "").split()), r.doc_id, r.text))
    copies = Counter()
    for source, of in own.items():
        total = sum(x[2] for x in of)
        rate = want[source] / total if total else 0
        whole, run = math.floor(rate), 0
        for _, _, size, doc, text in sorted(of, key=lambda x: x[:2]):
            copies[doc, text] += whole
            if rate > whole and run + size / 2 <= want[source] - whole * total:
                copies[doc, text] += 1
            run += size
    return copies


def test_mix_against_a_brute_ranking(spark):
    rng = random.Random(12)
    rows = [(i, " ".join(["w"] * rng.randint(1, 40)), f"s{rng.randint(0, 3)}") for i in range(600)]
    rows += [(7000, "copies of one row", "s1")] * 90 + [(None, "no id", "s2"), (8000, "", "s0"), (8001, None, "s3")]
    for weights, share in (((5, 2, 1), 1.5), ((1, 1, 1, 1), 0.5), ((1, 2), 0.9)):
        sizes = defaultdict(int)
        for _, text, source in rows:
            sizes[source] += len((text or "").split())
        want = brute_pareto(spark, rows, targets_by_resharing(sizes, weights, share, 2), 2)
        got = Counter()
        for r in mixing.mix(frame(spark, rows), weights=weights, share=share).collect():
            got[r.doc_id, r.text] += r.copies
        assert {k: v for k, v in got.items() if k[1]} == {k: v for k, v in want.items() if k[1]}


def test_a_sample_that_ends_among_repeated_rows(spark):
    rows = [(1, "one two three", "a")] * 900 + [(i, "w " * 5, "b") for i in range(10, 300)]
    found = []
    for n in (2, 7):
        got = mixing.mix(frame(spark, rows).repartition(n), weights=(1, 1), share=0.7).collect()
        assert len(got) == len(rows)
        assert all(abs(sum(r.size * r.copies for r in got if r.source == s) - next(r.target for r in got if r.source == s)) <= 3 for s in "ab")
        found.append(sorted((r.doc_id, r.copies) for r in got))
    assert found[0] == found[1]
    slim = mixing.mix(frame(spark, rows), weights=(1, 1), share=0.7, columns=["doc_id"])
    assert slim.columns == ["doc_id", "size", "source_size", "target", "copies"]
    assert sorted((r.doc_id, r.copies) for r in slim.collect()) == found[0]


def test_take_mix_repeats_rows(spark, docs):
    mixed = {(r.doc_id, r.text): r.copies for r in mixing.mix(docs).collect()}
    out = mixing.take_mix(docs)
    assert out.columns == docs.columns or set(docs.columns) - set(out.columns) == set()
    assert out.count() == mixing.mix(docs).agg(F.sum("copies")).first()[0]
    assert mixed


# ---------------------------------------------------------------- LM scoring


PIECES = [bytes([b]) for b in range(256)] + [b" the", b"er", b"ing", b" an", b"ou", b"thble", b"the", b"onting onting"]


def brute_marginal(lat, word):
    ways = [1.0] + [0.0] * len(word)
    for e in range(1, len(word) + 1):
        ways[e] = sum(ways[s] * math.exp(lat.scores[lat.ids[word[s:e]]]) for s in range(e) if word[s:e] in lat.ids)
    return math.log(ways[-1])


def test_lattice_sums_all_segmentations():
    scores = np.log(np.arange(1, len(PIECES) + 1) / sum(range(1, len(PIECES) + 1)))
    lat = lattice.Lattice(PIECES, scores)
    words = [b" the", b" thering", b"x", b" onting onting", b" " + "été".encode(), b"", b" " + b"the" * 60]
    got = lat.score(words)
    for w, s in zip(words, got, strict=True):
        if w and len(w) < 60:
            assert s == pytest.approx(brute_marginal(lat, w))
    assert got[-1] == pytest.approx(lat._forward_long(words[-1])[-1])
    # Expected piece lengths add up to the words' lengths.
    used = lat.expect(words[:5] + words[6:], np.ones(6) * 2)
    assert sum(u * len(p) for u, p in zip(used, PIECES, strict=True)) == pytest.approx(2 * sum(map(len, words)))


def test_lm_scores(spark, docs, corpus, tmp_path):
    from turnstile.llm.queries import vocabulary_path

    got = lm_scoring.score_texts(docs, vocabulary_path()).collect()
    assert len(got) == len(corpus)
    train = Counter()
    ends = 0
    for i, text, _ in corpus:
        if i is None or zlib.crc32(str(i).encode()) % 5 != 1:
            train.update((text or "").encode().lower().split())
            ends += 1
    n, v = train.total() + ends, len(train) + 1
    logp = lambda c: math.log10((c + 0.5) / (n + 0.5 * (v + 1)))
    want = defaultdict(list)
    for i, text, _ in corpus:
        words = (text or "").encode().lower().split()
        want[i].append((len(words) + 1, sum(train[w] > 0 for w in words) + 1, sum(logp(train[w]) for w in words) + logp(ends)))
    for r in got:
        assert r.train_tokens == n
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 1)
        assert any((r.n_tokens, r.n_known) == w[:2] and r.base_score == pytest.approx(w[2]) for w in want[r.doc_id])
        assert r.score < 0
    assert lm_scoring.score_texts(empty(spark), vocabulary_path()).count() == 0


def model_file(path, pieces):
    """A unigram model, written field by field: pieces with score and type, then the model's type."""
    import struct

    def field(number, kind, data):
        return bytes([number << 3 | kind]) + (bytes([len(data)]) + data if kind == 2 else data)

    body = b""
    for piece, score, kind in pieces:
        body += field(1, 2, field(1, 2, piece.encode()) + field(2, 5, struct.pack("<f", score)) + field(3, 0, bytes([kind])))
    body += field(2, 2, field(3, 0, b"\x01"))
    path.write_bytes(body)
    return str(path)


def test_a_unigram_vocabulary_is_taken_as_it_is(spark, docs, corpus, tmp_path):
    pieces = [("<unk>", 0.0, 2), ("▁the", -2.5, 1), ("er", -3.25, 1), ("▁", -3.0, 1), ("The", -4.5, 1), ("the", -4.0, 1), ("ing", -3.75, 1), ("a", -5.0, 1), ("▁a▁b", -1.0, 1)]
    file = model_file(tmp_path / "own.model", pieces)
    found, scores, ranked = lm_scoring.load_pieces(file)
    own = dict(zip(found, scores, strict=True))
    assert not ranked and own[b" the"] == -2.5 and own[b"er"] == -3.25 and own[b"The"] == -4.5 and own[b"a"] == -5.0
    assert b" a b" not in own and own[b"q"] == -5.0 and len(own) == 256 + 5
    lat = lattice.Lattice(found, scores)
    ends = sum(i is None or zlib.crc32(str(i).encode()) % 5 != 1 for i, _, _ in corpus)
    words = sum(len((t or "").encode().split()) for i, t, _ in corpus if i is None or zlib.crc32(str(i).encode()) % 5 != 1)
    end = math.log((ends + 1) / (ends + words + 2))
    want = defaultdict(list)
    for i, t, _ in corpus:
        own_words = (t or "").encode().lower().split()
        if len(own_words) < 200 and all(len(w) < 60 for w in own_words):
            want[i].append((end + sum(brute_marginal(lat, b" " + w) + math.log1p(-math.exp(end)) for w in own_words)) / math.log(10))
    for r in lm_scoring.score_texts(docs, file).collect():
        if r.doc_id in want and r.n_tokens <= 200:
            assert any(r.score == pytest.approx(w) for w in want[r.doc_id])


def test_expectation_maximisation_against_all_segmentations(spark):
    pieces = [bytes([b]) for b in range(256)] + [b" the", b"er", b"ing", b" a", b"th"]
    scores = np.log(np.arange(1, len(pieces) + 1) / sum(range(1, len(pieces) + 1)))
    words = [(b"the", 5, 5), (b"thering", 2, 2), (b"a", 7, 9), (b"unseen", 0, 3)]
    df = spark.createDataFrame([(bytearray(w), c, e) for w, c, e in words], "word binary, c long, everywhere long")
    got, end = lm_scoring.fit(df, pieces, scores, 4, 2, 50.0)
    start, now, ends = np.exp(scores), scores, None
    ids = {p: i for i, p in enumerate(pieces)}

    def ways(word):
        if not word:
            return [[]]
        return [[ids[word[:n]], *rest] for n in range(1, len(word) + 1) if word[:n] in ids for rest in ways(word[n:])]

    for _ in range(2):
        expected = start * 50.0
        for word, c, _ in words:
            if c:
                own = ways(b" " + word)
                p = np.array([math.exp(sum(now[i] for i in w)) for w in own])
                for w, share in zip(own, p / p.sum(), strict=True):
                    for i in w:
                        expected[i] += c * share
        whole = expected.sum() + 4 + 1.0
        now, ends = np.log(expected / whole), math.log(5.0 / whole)
    assert np.allclose(got, now) and end == pytest.approx(ends)


def test_rare_and_frequent_words_score_alike(spark, docs, monkeypatch):
    from turnstile.llm.queries import vocabulary_path

    sort = lambda rows: sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.score))
    one = sort(lm_scoring.score_texts(docs, vocabulary_path()).collect())
    monkeypatch.setattr(lm_scoring, "FREQUENT", 8)
    two = sort(lm_scoring.score_texts(docs, vocabulary_path()).collect())
    for a, b in zip(one, two, strict=True):
        assert a.score == pytest.approx(b.score) and a.base_score == pytest.approx(b.base_score) and a.n_known == b.n_known


# ---------------------------------------------------------------- SimHash


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    counts = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g, 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(grams))


def brute_components(prints):
    n = len(prints)
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 4:
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(prints):
        r = find(i)
        if doc is not None:
            least[r] = min(least.get(r, doc), doc)
    return sorted(((d, f"{f:016x}", least.get(find(i))) for i, (d, f) in enumerate(prints)), key=str)


def test_near_duplicates(spark, docs, corpus):
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == brute_components([(i, brute_fingerprint(t)) for i, t, _ in corpus])
    assert simhash.near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("group", [4, 8192])
def test_chains_and_crowds_of_fingerprints(spark, group, monkeypatch):
    """Chains of four bits, a crowd around one centre, and lone ones; pieces of large groups too."""
    monkeypatch.setattr(simhash, "GROUP", group)
    rng = random.Random(group)
    prints = [rng.getrandbits(64) for _ in range(60)]
    for _ in range(20):
        x = prints[-1]
        for b in rng.sample(range(64), 4):
            x ^= 1 << b
        prints.append(x)
    centre = rng.getrandbits(64)
    prints += [centre ^ (1 << a) ^ (1 << b) for a in range(0, 20) for b in range(a)]
    prints = sorted(set(prints))
    signed = [(p ^ (1 << 63)) - (1 << 63) for p in prints]
    df = simhash.with_pivots(spark.createDataFrame([(x, 0) for x in signed], "fp long, least long"))
    roots = {r.node: r.root for r in simhash.components(simhash.links(df)).collect()}
    got = defaultdict(set)
    for x in signed:
        got[roots.get(x, x)].add(x)
    want = defaultdict(set)
    for doc, _, comp in brute_components(list(enumerate(prints))):
        want[comp].add(signed[doc])
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


@pytest.mark.parametrize("n", [10, 1 << 21, 1 << 28])
def test_blocks_leave_no_pair_out(n):
    blocks, agree = simhash.plan_blocks(n)
    masks = simhash.block_masks(blocks, agree)
    rng = random.Random(1)
    for _ in range(200):
        diff = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(diff & m == 0 for m in masks)


# ---------------------------------------------------------------- decontamination


def brute_hits(text, items):
    words = decontam.words_of((text or "").encode())
    hit, found = set(), set()
    for item, t in items:
        own = decontam.words_of((t or "").encode())
        grams = [own[i : i + 13] for i in range(max(1, len(own) - 12))] if own else []
        for g in grams:
            for i in range(len(words) - len(g) + 1):
                if words[i : i + len(g)] == g:
                    hit |= set(range(i, i + len(g)))
                    found.add("" if item is None else str(item))
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("max_bytes", [1 << 20, 300])
def test_decontamination(spark, docs, corpus, max_bytes):
    rng = random.Random(2)
    passage = corpus[66][1].split(" ")
    items = [(1, " ".join(passage[10:40])), (2, "Ereding,  of THE and"), (3, None), (4, "!!!"), (None, "hain the"), (5, corpus[3][1]), (5, corpus[3][1])]
    items += [(10 + i, prose(rng, 20)) for i in range(10)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.find_windows(docs, bench, max_bytes=max_bytes).collect()
    assert len(got) == len(corpus)
    want = defaultdict(list)
    for i, t, _ in corpus:
        want[i].append(brute_hits(t, items))
    for r in got:
        own = (r.n_words, r.n_hit, r["items"])
        assert own in want[r.doc_id]
        assert r.n_items == len(own[2]) and r.items_sha256 == hashlib.sha256(",".join(own[2]).encode()).hexdigest()
        assert r.contaminated == (r.n_hit > 0 and 20 * r.n_hit >= r.n_words)
        text = (r.text or "").encode()
        assert sum(len(decontam.words_of(text[s.start : s.stop])) for s in r.spans) == r.n_hit
    assert decontam.find_windows(empty(spark), bench).count() == 0
    none = decontam.find_windows(docs, bench.limit(0)).agg(F.sum("n_hit")).first()[0]
    assert none == 0


# ---------------------------------------------------------------- suffix arrays


def test_two_stage_sorting():
    rng = np.random.default_rng(1)
    for _ in range(200):
        depth = int(rng.choice([1, 2, 3, 7]))
        text = (rng.integers(0, int(rng.integers(1, 4)), int(rng.integers(0, 150))) * 100).astype(np.uint8)
        wanted = rng.random(len(text)) < 0.5
        wanted[max(0, len(text) - depth) :] = False
        order = suffix_array.two_stage_order(text, wanted, depth)
        assert sorted(order.tolist()) == np.flatnonzero(wanted).tolist()
        keys = [text[i : i + depth].tobytes() for i in order]
        starts = [k for i, k in enumerate(keys) if i == 0 or keys[i - 1] != k]
        assert len(starts) == len(set(starts))
        common = suffix_array.adjacent_prefixes(text, order, depth)
        for i in range(1, len(keys)):
            assert common[i] == next((j for j in range(depth) if keys[i - 1][j] != keys[i][j]), depth)


def brute_dedup(corpus):
    seen, out = set(), []
    named = sorted({(i is None, i or 0, t or "") for i, t, _ in corpus}, key=lambda x: x[:2])
    for last, i, text in named:
        b = text.encode()
        starts = []
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            if w in seen:
                starts.append(s)
            seen.add(w)
        kept, end, spans = [], 0, 0
        for s in starts:
            if s > end or not spans:
                kept.append(b[end:s])
                spans += 1
            end = s + 100
        kept.append(b[end:])
        left = b"".join(kept)
        out.append((None if last else i, len(b), len(b) - len(left), spans, hashlib.sha256(left).hexdigest()))
    return out


def test_finer_segments_hold_the_same_windows(spark):
    rng = random.Random(8)
    text = prose(rng, 300).encode()
    rows = []
    for h, place in zip(*(np.concatenate(x).tolist() for x in zip(*suffix_dedup.anchors(text), strict=True)), strict=True):
        _, a, b = suffix_dedup.unpack(place)
        rows.append((h, False, 1, 2, place, bytearray(text[a : b + 100])))
    df = spark.createDataFrame(rows, "h long, last boolean, doc_id long, name long, place long, s binary")
    seen = []
    for r in suffix_dedup._finer(df).collect():
        p, a, b = suffix_dedup.unpack(r.place)
        assert bytes(r.s) == text[a : b + 100] and a <= b <= p <= a + 36
        seen += range(a, b + 1)
    assert sorted(seen) == list(range(len(text) - 99))


@pytest.mark.parametrize("group,block", [(4096, 1 << 21), (2, 500)])
def test_byte_dedup(spark, corpus, group, block, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 1 << 12)
    rng = random.Random(9)
    shared = prose(rng, 40)
    own = [r for r in corpus if r[0] is not None] + [(None, shared + " once", "s0")]
    own += [(400 + i, prose(rng, 4 + i) + shared + prose(rng, 9 - i % 3), "hot") for i in range(15)]
    own += [own[-1]] * 5 + [own[-3]] * 2 + [(400, own[-2][1], "other")]  # repeated rows, and two texts of one id
    got = suffix_dedup.dedup_bytes(frame(spark, own)).collect()
    want = set(brute_dedup(own))
    assert len(got) == len(own)
    assert {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in got)
    assert suffix_dedup.dedup_bytes(empty(spark)).count() == 0


# ---------------------------------------------------------------- licenses


def test_licenses(spark):
    t = licenses.TEMPLATES
    rows = [
        (1, "Some code.\n" + t["mit"] + "\nmore words here", "a"),
        (2, "Released under the MIT License.", "a"),
        (3, "A text about licensed premises and reserved seats, all rights and wrongs reserved", "a"),
        (4, "Heading\nAll rights reserved.\nBody", "a"),
        (5, "x " * 3000 + t["apache-2.0"].upper() + " y" * 3000, "a"),
        (6, t["gpl-3.0"].replace("WITHOUT", "").replace("either version 3", "either version 9"), "a"),
        (7, None, None),
        (8, "", "a"),
        (None, t["isc"], "a"),
        (9, t["bsd-clauses"][:60], "a"),
        (10, "Copyright (c) 2020 Someone. All rights reserved. More on this line", "a"),
        (11, "all rights", "a"),
        (12, t["isc"], "a"), (12, t["isc"], "a"), (12, t["isc"], "a"),
        (13, "word " * 200_000 + t["bsl-1.0"], "a"),
    ]
    found = {(r.doc_id, r.license): r.containment for r in licenses.find_licenses(frame(spark, rows)).collect()}
    assert found[(1, "mit")] == 1.0 and found[(2, "mit-line")] == 1.0 and found[(4, "all-rights-reserved")] == 1.0
    assert found[(5, "apache-2.0")] == 1.0 and found[(None, "isc")] == 1.0
    assert 0.8 <= found[(6, "gpl-3.0")] < 1.0
    assert found[(10, "all-rights-reserved")] == 1.0 and found[(13, "bsl-1.0")] == 1.0
    assert not {k for k in found if k[0] in (3, 7, 8, 9, 11)}
    assert licenses.find_licenses(frame(spark, rows)).where("doc_id = 12").count() == 1  # repeated rows: one result
    assert licenses.find_licenses(empty(spark)).count() == 0


def test_markers_are_in_enough_shingles():
    marks = licenses.markers()
    for text in licenses.TEMPLATES.values():
        own = licenses.template_shingles(text)
        assert sum(any(m in s for m in marks) for s in own) > (1 - licenses.LEAST) * len(own)


# ---------------------------------------------------------------- toxicity


def test_toxicity_on_held_out_texts(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(500):
        toxic = i % 4 == 0
        words = prose(rng, 60).split(" ")
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["worthless", "pathetic", "disgusting"]))
        rows.append((i, " ".join(words), "s"))
        labels.append((i, int(toxic)))
    rows += [(900, None, None), (901, "", "s"), (None, "worthless pathetic disgusting", "s"), (902, "q" * 5000, "s")]
    lab = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(frame(spark, rows), lab).collect()
    truth = dict(labels)
    tested = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(got) == len(rows) and len(tested) > 100
    assert sum(r.predicted == truth[r.doc_id] for r in tested) / len(tested) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert {r.score for r in toxicity.score_toxicity(frame(spark, rows), lab.limit(0)).collect()} == {0.0}
    assert toxicity.score_toxicity(empty(spark), lab).count() == 0


def test_scores_against_plain_compression():
    """Distances are lengths by the two dictionaries; thresholds and the fit follow from them."""
    import zstandard as zstd

    rng = random.Random(3)
    good = [prose(rng, 80).encode() for _ in range(300)]
    bad = [(prose(rng, 40) + " " + rng.choice(["worthless", "pathetic", "disgusting"]) + " " + prose(rng, 30)).encode() for _ in range(150)]
    model = toxicity.train(bad, good)
    # The ordinary dictionary is the trainer's, on the windows of ordinary texts.
    own = [b" " + w + b" " for t in good for w in t.lower().split()]
    assert model.ordinary == zstd.train_dictionary(toxicity.BASE, own, k=12, d=6, level=3).as_bytes()
    assert model.toxic.endswith(model.ordinary) and len(model.toxic) <= len(model.ordinary) + toxicity.EXTRA
    distances = toxicity.Distances(model.toxic, model.ordinary, model.carrier)

    def length(content, window):
        p = zstd.ZstdCompressionParameters(
            window_log=16, chain_log=16, hash_log=15, search_log=4, min_match=5, target_length=16, strategy=zstd.STRATEGY_LAZY,
            write_content_size=False, write_checksum=False, write_dict_id=False, format=zstd.FORMAT_ZSTD1_MAGICLESS,
        )
        d = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=p)
        return len(zstd.ZstdCompressor(dict_data=d, compression_params=p).compress(b" " + window + b" " + model.carrier))

    for w in [b"worthless", b"pathetic", b"disgusting", b"the", b"thbleing", b"q" * 64]:
        assert distances.of(w) == length(model.ordinary, w) - length(model.toxic, w)
    assert min(distances.of(w) for w in (b"worthless", b"pathetic", b"disgusting")) >= 3
    seen = [distances.of(w) for t in good for w in toxicity.windows(t)]
    for tail, step in zip(toxicity.TAILS, model.steps, strict=True):
        assert sum(d >= step for d in seen) <= tail * len(seen)
    score = model.scorer()
    x = np.array(distances.features(bad[0], model.steps))
    assert score(bad[0]) == pytest.approx(1 / (1 + math.exp(-float(x @ np.array(model.weights)))))
    assert np.mean([score(t) >= 0.7 for t in bad]) > 0.95 and not any(score(t) >= 0.7 for t in good)
    long = b" ".join([*good, bad[0]])  # far over the sample's bytes, scored as a whole
    assert len(long) > 16_384 and 0 <= score(long) <= 1 and score(long) > score(b" ".join(good))


def test_repeated_tables_teach_alike(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    four = docs.union(docs).union(docs).union(docs)
    once = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, labels, sample=20).collect()}
    often = toxicity.score_toxicity(four, labels, sample=20).collect()
    assert len(often) == 4 * len(once) and all(r.score == once[r.doc_id] for r in often)


def test_repeated_rows_leave_room_for_toxic_texts(spark):
    rows = [(0, "an ordinary text", "s")] * 200 + [(i, f"text {i}", "s") for i in range(1, 20)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int")
    bad, good = toxicity.labelled_sample(frame(spark, rows), labels, 10, 1000, 1, 9, id_col="doc_id", text_col="text", seed=7)
    assert sorted(bad) == sorted(f"text {i}".encode() for i in range(1, 20, 2))
    assert len(good) == 10 and good.count(b"an ordinary text") == 1


# ---------------------------------------------------------------- sentences


def brute_sentences(rows):
    named = sorted({(i is None, i or 0, t or "") for i, t, _ in rows}, key=lambda x: x[:2])
    first, out = {}, {}
    for last, i, text in named:
        parts = sentence_dedup.sentences(text.encode())
        gone = set()
        for s in range(len(parts)):
            e = next((e for e in range(s + 3, len(parts) + 1) if sum(map(len, parts[s:e])) >= 15), None)
            if e:
                g = tuple(map(tuple, parts[s:e]))
                if first.setdefault(g, (i, text, s)) != (i, text, s):
                    gone |= set(range(s, e))
        out[(None if last else i, text)] = (len(parts), len(gone))
    return out


@pytest.mark.parametrize("points", [0, 3, 40])
def test_every_passage_of_fifty_words_holds_a_span(points):
    rng = random.Random(points)
    for _ in range(100):
        passage = [rng.choice(WORDS) + rng.choice(["", "a", "b"]) + ("." if points and rng.randrange(points) == 0 else "") for _ in range(50)]
        found = []
        for _ in range(2):
            text = " ".join([prose(rng, rng.randint(0, 40)), *passage, prose(rng, rng.randint(0, 40))])
            found.append(set(sentence_dedup.span_hashes(text.encode())[0]))
        assert found[0] & found[1]


def test_repeats_of_twenty_six_words_without_an_end_hold_a_span():
    """Parts of up to ten words lost many of these; parts of up to six lose none."""
    rng = random.Random(26)
    for _ in range(300):
        passage = [rng.choice(WORDS) + rng.choice(["", "a", "b"]) for _ in range(26)]
        found = []
        for _ in range(2):
            text = " ".join([prose(rng, rng.randint(0, 40)), *passage, prose(rng, rng.randint(0, 40))])
            found.append(set(sentence_dedup.span_hashes(text.encode())[0]))
        assert found[0] & found[1]


def test_sentences_hold_the_whole_text(corpus):
    for _, text, _ in corpus:
        b = (text or "").encode()
        parts = sentence_dedup.sentences(b)
        assert [w for own in parts for w in own] == b.lower().split()
        assert all(b[x:y].lower().split() == own for (x, y), own in zip(sentence_dedup.places(b, parts), parts, strict=True))


def test_cuts_are_the_smallest_of_any_few_words():
    rng = random.Random(3)
    for _ in range(100):
        words = [bytes([rng.choice(b"abcdef")]) for _ in range(rng.randint(0, 60))]
        n = sentence_dedup.WITHIN
        want = {i + words[i : i + n].index(min(words[i : i + n])) for i in range(len(words) - n + 1)}
        assert sentence_dedup.cuts(words) == sorted(want - {0})


def test_sentence_dedup(spark, docs, corpus):
    got = sentence_dedup.dedup_sentences(docs).collect()
    assert len(got) == len(corpus)
    by_id = defaultdict(set)
    for (i, _), v in brute_sentences([r for r in corpus]).items():
        by_id[i].add(v)
    for r in got:
        assert (r.n_sentences, r.n_removed) in by_id[r.doc_id]
        assert hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256
        assert r.n_bytes - r.n_removed_bytes == len(r.kept_text.encode())
    assert sum(r.n_removed for r in got) > 50
    assert sentence_dedup.dedup_sentences(empty(spark)).count() == 0


# ---------------------------------------------------------------- quality


def test_quality_measures_and_cascade(spark, docs, corpus):
    got = quality.cascade(docs, measure=True).collect()
    assert len(got) == len(corpus)
    for r in got:
        m = quality.Measures((r.text or "").encode())
        words = m.words
        assert (r.n_words, r.word_chars) == (len(words), sum(len(w.decode()) for w in words))
        grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        hit = {i + k for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for k in range(5)}
        assert r.n_repeat_words == len(hit)
        assert r.base_failed == (len(words) < 10 or 100 * len(hit) > 20 * len(words))
        assert r.kept == (not any(rule.rejects(m) for rule in quality.RULES))
        assert (r.rejected_by is None) == r.kept and not (r.base_failed and r.kept)
    assert quality.cascade(empty(spark)).count() == 0


def test_cascade_orders_rules_by_rejection_per_cost():
    slow = quality.Rule("slow", (), lambda m: sum(range(20_000)) < 0 or m.text == b"a")
    rules = (slow, quality.Rule("never", (), lambda m: False), quality.Rule("fast", (), lambda m: m.text == b"a"), quality.Rule("rest", (), lambda m: m.text == b"b"))
    steps = quality.plan_cascade([b"a"] * 20 + [b"b"] * 2, rules)
    # What "slow" rejects is gone when "fast" has rejected it.
    assert [s.name for s in steps][:2] == ["fast", "rest"] and [s.rejected for s in steps][1:] == [1.0, 0.0, 0.0]


def test_a_kept_plan_gives_the_same_reasons(spark, docs):
    steps = quality.plan(docs)
    one, two = (sorted(map(str, quality.cascade(docs.repartition(n), steps=steps).select("doc_id", "text", "kept", "rejected_by").collect())) for n in (2, 5))
    assert one == two
    reverse = quality.cascade(docs, steps=steps[::-1]).select("doc_id", "text", "kept").collect()
    assert sorted(map(str, reverse)) == sorted(map(str, quality.cascade(docs, steps=steps).select("doc_id", "text", "kept").collect()))


# ---------------------------------------------------------------- sharding


def test_shards(spark, docs, corpus, tmp_path):
    got = sharding.shard_records(docs, 24, bucket_bytes=2000).collect()
    assert sorted(map(str, ((r.doc_id, r.text) for r in got))) == sorted(map(str, ((i, t) for i, t, _ in corpus)))
    slots = defaultdict(list)
    of = {}
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.size == len((r.text or "").encode()) + 8
        assert r.key == "k" and r.name == "n"
        assert of.setdefault(r.doc_id, r.shard) == r.shard
        assert r.grown_shard in (r.shard, 24)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    grown = {r.doc_id: r.shard for r in sharding.shard_records(docs, 25).collect()}
    assert all(grown[r.doc_id] == r.grown_shard for r in got)
    assert sharding.shard_records(empty(spark)).count() == 0
    written = sharding.write_shards(sharding.shard_records(docs, 4), str(tmp_path / "s"))
    assert written.columns == sharding.shard_records(docs, 4).columns and written.count() == len(corpus)
    assert sorted(map(str, written.collect())) == sorted(map(str, sharding.shard_records(docs, 4).collect()))


def brute_fisher_yates(hashes, n):
    out = []
    for i, h in zip(range(n), hashes, strict=True):
        j = h % (i + 1)
        out.append(i)
        out[j], out[i] = out[i], out[j]
    return out


def test_fisher_yates_against_a_plain_one(spark):
    for n in (1, 2, 3, 17, 200):
        df = spark.range(1).select(sharding.fisher_yates(F.lit(n), F.lit(3), F.lit(7)).alias("p"))
        draws = [r.h for r in spark.range(n).select(F.xxhash64(F.lit(3), F.lit(7), F.col("id").cast("int")).alias("h"), "id").orderBy("id").collect()]
        assert df.first().p == brute_fisher_yates(draws, n)


def test_slots_follow_from_rows_and_seed_alone(spark, monkeypatch):
    rows = [(i, f"text {i} " * (i % 9), "s") for i in range(700)] + [(None, None, None)] * 3
    want = None
    for partitions, task in ((4, 64 << 20), (16, 5_000), (211, 700)):
        monkeypatch.setattr(sharding, "TASK_BYTES", task)
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        got = sharding.shard_records(frame(spark, rows).repartition(partitions % 13), 5, bucket_rows=40).collect()
        found = sorted(((r.doc_id is None, r.doc_id or 0, r.text or ""), r.shard, r.slot, r.grown_shard) for r in got)
        want = want or found
        assert found == want
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_a_crowd_of_equal_rows_is_scattered(spark):
    rows = [(1, "the same", "s")] * 3000 + [(i, f"text {i}", "s") for i in range(2, 500)]
    got = [sharding.shard_records(frame(spark, rows).repartition(n), 3, bucket_rows=50).collect() for n in (3, 8)]
    assert sorted(map(str, got[0])) == sorted(map(str, got[1])) and len(got[0]) == len(rows)
    for s in range(3):
        own = sorted(r.slot for r in got[0] if r.shard == s)
        assert own == list(range(len(own)))
    crowd = sorted(r.slot for r in got[0] if r.doc_id == 1)
    others = [r for r in got[0] if r.shard == next(r.shard for r in got[0] if r.doc_id == 1) and r.doc_id != 1]
    assert any(crowd[0] < r.slot < crowd[-1] for r in others)


def test_the_law_of_the_shards(spark):
    """The largest of seeded hashes with the id wins, for 24 shards and for 25; crc32 is zlib's."""
    from turnstile.llm.queries import queries

    sf = "/root/testdata/sf0.001"
    ids = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    draws = ids.select("doc_id", "text", F.array(*[F.xxhash64(F.lit(10), F.lit(i), F.col("doc_id")) for i in range(25)]).alias("h")).collect()
    want = {r.doc_id: (int(np.argmax(r.h[:24])), int(np.argmax(r.h)), zlib.crc32((r.text or "").encode()), len((r.text or "").encode()) + 8) for r in draws}
    got = queries()["op10_shards"](spark, sf).collect()
    assert len(got) == len(draws)
    for r in got:
        assert (r.shard, r.grown_shard, r.text_crc32, r.size) == want[r.doc_id] and r.law == "key"


def test_slots_are_shuffled(spark):
    rows = [(i, f"text {i}", "s") for i in range(5000)]
    got = sharding.shard_records(frame(spark, rows), 1).orderBy("slot").collect()
    ids = [r.doc_id for r in got]
    assert ids != sorted(ids) and abs(np.corrcoef(ids, range(len(ids)))[0, 1]) < 0.05


# ---------------------------------------------------------------- contracts

CONTRACTS = {
    "op1_": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op2_": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op3_": "doc_id bigint, fingerprint string, component_id bigint",
    "op4_": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op5_": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op7_": "doc_id bigint, held_out boolean, score double, predicted int",
    "op9_": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op10_": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
}


@pytest.mark.parametrize("prefix", CONTRACTS)
def test_queries_return_the_columns_agreed(spark, prefix):
    from turnstile.llm.queries import queries

    name = next(n for n in queries() if n.startswith(prefix))
    types = dict(queries()[name](spark, "/root/testdata/sf0.001").dtypes)
    for column in CONTRACTS[prefix].split(", "):
        c, t = column.split(" ")
        assert types[c] == t
