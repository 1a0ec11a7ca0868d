"""The pipeline, stage by stage, against plain Python."""

import random

import numpy as np

import corpus_pipeline
from turnstile.llm import decontam, quality, simhash

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [(str(r.item_id), (r.text or "").encode()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_copies", "decontaminate", "mix", "shard"]
    before = {r.doc_id: r for r in docs.collect()}
    outs = {}
    for name, stage in stages.items():
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name != "shard":
            assert out.columns == docs.columns
        docs, outs[name] = out, out.collect()
    good = {i for i, r in before.items() if not any(rule.rejects(quality.Measures((r.text or "").encode())) for rule in quality.RULES)}
    assert {r.doc_id for r in outs["quality"]} == good
    kept = {r.doc_id for r in outs["near_copies"]}
    assert len(kept) == len(outs["near_copies"]) < len(good) and kept <= good
    windows = decontam.Windows(bench)
    clean = set()
    for r in outs["near_copies"]:
        words = decontam.words_of(r.text.encode())
        n = sum(b - a for a, b in windows.scan(words)[0])
        if not (n and 20 * n >= len(words)):
            clean.add(r.doc_id)
    assert {r.doc_id for r in outs["decontaminate"]} == clean
    mixed = [r.doc_id for r in outs["mix"]]
    assert set(mixed) <= clean and max(map(mixed.count, set(mixed))) <= 2
    assert sorted(r.doc_id for r in outs["shard"]) == sorted(mixed)


def test_run_is_the_stages_in_order(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_stages_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


CLASHING = "kept int, size string, spans string, items long, n_words string, contaminated int, target string, copies string, rejected_by long, key string, root string, `a.b` int, Slot string"


def test_stages_keep_columns_nulls_repeats_and_long_texts(spark):
    rng = random.Random(4)
    text = lambda n: " ".join(f"w{rng.randrange(9000)}" for _ in range(n))
    long, twice = text(60_000), text(50)
    rows = [(i, text(60), f"s{i % 3}") for i in range(40)]
    rows += [(100, long, "s0"), (101, twice, "s1"), (101, twice, "s1"), (101, text(40), "s1"), (None, text(30), None), (None, text(30), "s2")]
    rows += [(102, None, "s0"), (103, "", None), (None, None, None), (104, "   ", "s0")]
    extra = (5, "big", "x", 7, "many", 3, "t", "c", 9, "k", "r", 1, "slot")
    docs = spark.createDataFrame([(*r, *extra) for r in rows], f"doc_id long, text string, source string, {CLASHING}").repartition(3)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.dtypes == docs.dtypes, name
        got = out.collect()
        assert all(tuple(r)[3:] == extra for r in got), name
        ids = [(r.doc_id, r.text) for r in got]
        if name == "quality":
            assert sorted(map(str, ids)) == sorted(str(r[:2]) for r in rows if r[1] and r[1].strip())
        elif name == "near_copies":
            words = [x for x in ids if x[1] and x[1].strip()]
            assert sorted(map(str, words)) == sorted(str(x) for x in {r[:2] for r in rows if r[1] and r[1].strip()})
            assert len(ids) - len(words) == 1  # texts without words are one group
        elif name == "decontaminate":
            assert sorted(map(str, ids)) == sorted(str(r[:2]) for r in rows)
        else:
            assert set(map(str, ids)) <= {str(r[:2]) for r in rows} and max(map(ids.count, ids)) <= 4
    assert {c for c, _ in corpus_pipeline.STAGES[-1][1](spark, docs, SF).dtypes} >= {"shard", "slot", "kept", "a.b", "size"}


def test_near_copies_of_one_id_keep_their_own_texts(spark):
    rows = [(1, "alpha beta gamma delta epsilon zeta"), (1, "one two three four five six"), (2, "seven eight nine ten eleven twelve")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert dict(corpus_pipeline.STAGES)["near_copies"](spark, docs, SF).count() == 3


def brute_groups(rows):
    """Groups by the Jaccard similarity of five-word shingles, all pairs."""
    sets = [simhash.shingle_set(t.encode()) for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if simhash.alike(sets[i], sets[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return len({find(i) for i in range(len(rows))}), sorted({min(rows[j][0] for j in range(len(rows)) if find(j) == find(i)) for i in range(len(rows))})


def test_near_copies_against_all_pairs(spark):
    """Edits of one to three words in texts of 60 to 400; links of 0.8 and just under it."""
    rng = random.Random(6)
    rows = []
    for i in range(120):
        n = rng.randint(60, 400)
        text = [f"w{rng.randrange(3000)}" for _ in range(n)]
        rows.append((1000 * i, " ".join(text)))
        for k in range(rng.randint(0, 3)):
            own = list(text)
            for _ in range(rng.randint(1, 3)):
                own[rng.randrange(n)] = "edit"
            rows.append((1000 * i + k + 1, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(r.doc_id for r in dict(corpus_pipeline.STAGES)["near_copies"](spark, docs, SF).collect())
    n, want = brute_groups(rows)
    assert set(want) <= set(got) and len(got) <= 1.02 * n


def form_letters(families, edits, seed=9):
    """A form letter in many variants, each of them twice with one more word changed: pairs alone agree to 0.8."""
    rng = random.Random(seed)
    letter = [f"w{rng.randrange(4000)}" for _ in range(260)]
    rows = []
    for i in range(families):
        own = list(letter)
        for at in rng.sample(range(260), edits):
            own[at] = f"name{rng.randrange(10**6)}"
        twin = list(own)
        twin[rng.randrange(260)] = f"other{i}"
        rows += [(2 * i, " ".join(own)), (2 * i + 1, " ".join(twin))]
    return rows


def test_near_copies_in_a_large_family(spark):
    """Every pair of 1,500 variants of one letter is one group; no link is lost for the others being close."""
    rows = form_letters(1500, 14)
    sets = [simhash.shingle_set(t.encode()) for _, t in rows]
    near = sum(simhash.alike(sets[i], sets[j]) for i in range(60) for j in range(len(rows)) if i != j)
    assert near == 60  # the first sixty against all: their twins alone
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id for r in dict(corpus_pipeline.STAGES)["near_copies"](spark, docs, SF).collect()}
    lost = [i for i in range(1500) if 2 * i + 1 in got]
    assert {2 * i for i in range(1500)} <= got and len(lost) <= 0.02 * 1500


def test_near_copies_of_one_fingerprint_meet_each_other(spark):
    """Texts that repeat a phrase share a fingerprint; whoever stands for it, each is compared."""
    base = "one two three four five six seven eight nine ten eleven " * 200
    rows = [(i, base + " ".join(f"tail{i // 2}x{k}" for k in range(12)) + (" odd" if i % 2 else "")) for i in range(40)]
    prints = {simhash.fingerprint(t.encode(), simhash.WIDE_SHINGLE) for _, t in rows}
    assert len(prints) == 1
    n, want = brute_groups(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(r.doc_id for r in dict(corpus_pipeline.STAGES)["near_copies"](spark, docs, SF).collect())
    assert n == 20 and got == want


def test_near_copies_take_maps_and_repeated_rows(spark):
    rows = [(1, "a b c d e f g h", {"k": 1}), (1, "a b c d e f g h", {"k": 1}), (1, "a b c d e f g h", {"k": 2}), (2, "i j k l m n", None), (None, "a b c d e f g h", {})]
    docs = spark.createDataFrame(rows, "doc_id long, text string, more map<string,int>").repartition(3)
    got = dict(corpus_pipeline.STAGES)["near_copies"](spark, docs, SF).collect()
    assert sorted(r.doc_id for r in got) == [1, 2] and len(got) == 2


def test_sketches_follow_similarity():
    """128 bytes agree about as often as the sets are alike, and hardly a pair of 0.8 is refused by them."""
    rng = random.Random(2)
    refused = 0
    for _ in range(400):
        shared, own = [rng.getrandbits(64) for _ in range(400)], [[rng.getrandbits(64) for _ in range(50)] for _ in range(2)]
        a, b = (simhash.sketch(np.array(shared + x, np.uint64)) for x in own)
        refused += (a == b).sum() < simhash.AGREE
    assert refused <= 1
    assert (simhash.sketch(np.arange(500, dtype=np.uint64) << np.uint64(3)) == simhash.sketch(np.arange(9000, 9500, dtype=np.uint64))).mean() < 0.1


def test_near_copies_stage_catches_edited_texts_and_rows_without_an_id(spark):
    rng = random.Random(8)
    words = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    rows = []
    for i in range(60):
        text = words(120)
        edited = [*text[:40], "edited", *text[41:]]  # five of about 121 shingles change
        rows += [(i, " ".join(text)), (100 + i, " ".join(edited))]
    alone = [" ".join(words(80)) for _ in range(4)]
    rows += [(None, rows[0][1]), (None, alone[0]), (None, alone[0]), (500, alone[1]), (500, alone[2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = dict(corpus_pipeline.STAGES)["near_copies"](spark, docs, SF).collect()
    assert {r.doc_id for r in out if r.doc_id is not None and r.doc_id < 500} == set(range(60))
    assert sorted(r.text for r in out if r.doc_id is None) == [alone[0]]
    assert sorted(r.text for r in out if r.doc_id == 500) == sorted(alone[1:3])
    assert len(out) == 63
