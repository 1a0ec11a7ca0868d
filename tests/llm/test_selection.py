"""Packing, importance resampling and the filter audit: brute force, SQL and odd input."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from turnstile.llm import filter_audit, importance, packing, queries, sharding

SF = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, row long, part string, marks string, place int, key string, start string"

ROWS = [
    (1, "alpha beta gamma delta " * 60, "en"), (2, "alpha beta gamma delta " * 60, "en"), (2, "alpha beta gamma delta " * 60, "en"), (3, None, "en"), (4, "", None),
    (5, "SHOUT LOUD # words " + " ".join(f"w{i}" for i in range(300)), "de"), (6, "é ß 漢字 naïve Ünïcode " * 20, ""), (None, "no id at all, quite alone here " * 9, "en"),
    (None, "alpha beta gamma delta " * 60, "en"), (7, " \n\t ", "fr"), (8, "x" * 70_000, "fr"), (9, " ".join(f"long{i % 977}" for i in range(300_000)), "de"), (10, "one", "en"),
    (11, "one two", "en"), (12, "tie tie tie " * 10, "en"), (13, "don't stop <|endoftext|> now  two   spaces\n\n new", "en"),
]


def frame(spark, rows, parts=3):
    full = [(i, t, lang, "s", 7, "p", "m", 1, "k", "z") for i, t, lang in rows]
    return spark.createDataFrame(full, DOCS).repartition(parts)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, ROWS)


def same(got, want):
    """A Spark result and a DuckDB one, row by row."""
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    mine = [tuple(r[c] for c in columns) for r in got.collect()]
    theirs = [tuple(r[want.columns.index(c)] for c in columns) for r in want.fetchall()]
    assert sorted(mine, key=repr) == sorted(theirs, key=repr)


# ---------------------------------------------------------------- packing


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY)


def test_ids_are_those_of_tokenizers(spark, tokenizer):
    encode = packing.encoder(VOCABULARY)
    texts = [r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + [t or "" for _, t, _ in ROWS]
    texts += ["a" * 300_000, " " * 300_000, "a  b \n  c\r\n\td 've'S 12345 …   x", "ab " * 100_000]
    for text in texts:
        assert encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_ids_of_any_text(text):
    from tokenizers import Tokenizer

    assert packing.encoder(VOCABULARY)(text).tolist() == Tokenizer.from_file(VOCABULARY).encode(text, add_special_tokens=False).ids


def check_packed(rows, ids_of, capacity=2048):
    """Each id lies in one piece, sequences are gapless and full or a power of two."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.length == len(r.ids) // 4 > 0
        pieces[r.doc_id].append((r.start, np.frombuffer(r.ids, "<u4").tolist(), r.doc_tokens))
        sequences[r.sequence_id].append((r.offset, r.length))
    want = defaultdict(Counter)
    for doc_id, text in ids_of:
        want[doc_id][tuple(text)] += 1
    assert set(pieces) == set(want)
    for doc_id, own in pieces.items():
        total, copies = Counter(), sum(want[doc_id].values())
        for _, ids, _ in own:
            total.update(ids)
        expected = Counter()
        for ids, n in want[doc_id].items():
            for i in ids:
                expected[i] += n
        assert total == expected
        if copies == 1:  # pieces in order give the document back
            whole, at = [], 0
            for start, ids, tokens in sorted(own):
                assert start == at and tokens == len(next(iter(want[doc_id])))
                whole += ids
                at += len(ids)
            assert tuple(whole) in want[doc_id]
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at == capacity or (at < capacity and at & (at - 1) == 0)


def test_pack_round_trip(spark, docs, tokenizer):
    rows = packing.pack(docs, VOCABULARY).collect()
    check_packed(rows, [(i, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]) for i, t, _ in ROWS])
    by_task = Counter(r.sequence_id >> 32 for r in rows if r.offset == 0 and sum(x.length for x in rows if x.sequence_id == r.sequence_id) < 2048)
    assert max(by_task.values()) <= 11


def test_pack_small_windows(spark, docs, tokenizer):
    """Windows hand their rest on; the result is as whole as with one window."""
    rows = packing.pack(docs, VOCABULARY, capacity=64, window=100).collect()
    check_packed(rows, [(i, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]) for i, t, _ in ROWS], 64)


def test_pack_empty(spark, docs):
    assert packing.pack(docs.limit(0), VOCABULARY).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60), st.booleans())
def test_pieces_go_to_the_cheapest_sequence_with_room(lengths, rest):
    total = sum(lengths)
    rooms = [64] * (total // 64) + ([1 << b for b in range(6, -1, -1) if (total % 64) >> b & 1] if rest else [])
    packed = packing.pack_pieces([(k, 0, n) for k, n in enumerate(lengths)], rooms, 4)
    used = [sum(n for *_, n in s) for s in packed]
    assert used == rooms
    # The rule, spelt out: a list of what waits, and every sequence looked at each time.
    waiting, left, cost, want, number = [(-n, k, k, 0) for k, n in enumerate(lengths)], list(rooms), [0.0] * len(rooms), [[] for _ in rooms], len(lengths)
    while waiting and any(left):
        waiting.sort()
        n, _, doc, start = waiting.pop(0)
        n = -n
        fits = [i for i in range(len(rooms)) if left[i] >= n]
        if fits:
            i = min(fits, key=lambda i: (cost[i], i))
        else:
            i = max((i for i in range(len(rooms)) if left[i]), key=lambda i: (left[i], -i))
            number += 1
            waiting.append((left[i] - n, number, doc, start + left[i]))
            n = left[i]
        want[i].append((doc, start, n))
        left[i] -= n
        cost[i] += packing.cost_of(n, 4)
    assert packed == want


def test_costs_are_balanced():
    """Half long, half short documents: sequences cost nearly the same, unlike packing in order."""
    rng = random.Random(3)
    lengths = sorted(rng.choice([rng.randint(5, 200), rng.randint(900, 2000)]) for _ in range(4000))
    total = sum(lengths)
    packed = packing.pack_pieces([(k, 0, n) for k, n in enumerate(lengths)], [2048] * (total // 2048), 64)
    costs = [sum(packing.cost_of(n, 64) for *_, n in s) for s in packed]
    in_order, now = [], 0.0
    room = 2048
    for n in lengths:
        if n > room:
            in_order.append(now)
            now, room = 0.0, 2048
        now += packing.cost_of(n, 64)
        room -= n
    assert np.std(costs) / np.mean(costs) < 0.5 * np.std(in_order) / np.mean(in_order)
    assert sum(len(s) for s in packed) <= len(lengths) + len(packed)  # a cut fills a sequence


def test_op11_on_given_tables(spark, tokenizer):
    got = queries.op11_pack_sequences(spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in got:
        ids = np.array([*tokenizer.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 1], "<u4")
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    assert sum(r.length for r in got) == sum({r.doc_id: r.doc_tokens for r in got}.values())


# ---------------------------------------------------------------- importance resampling


def features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def resampled(rows, target, percent=5, least=20, buckets=10_000, seed=42):
    """The contract's words, one document at a time."""
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text, *_ in rows:
        s.update(map(bucket, features(text)[1]))
    for text in target:
        t.update(map(bucket, features(text)[1]))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets))))
    out = []
    for doc_id, text, *_ in rows:
        words, grams = features(text)
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(g)) for g in grams)
        out.append([doc_id, len(grams), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words) >= least])
    asked = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = {id(r): k for k, r in enumerate(asked[: percent * len(asked) // 100], 1)}
    return sorted(((*r[:4], ranks.get(id(r))) for r in out), key=repr)


TARGET = ["alpha beta gamma question", None, "", "long1 long2 long3 tie tie tie"]


@pytest.mark.parametrize("percent", [5, 40, 100, 0])
def test_resample_brute_force(spark, docs, percent):
    target = spark.createDataFrame([(t, 1) for t in TARGET], "text string, doc_id int")
    got = importance.resample(docs, target, percent=percent).collect()
    assert sorted((tuple(r) for r in got), key=repr) == resampled(ROWS, TARGET, percent)


def test_parts_of_long_texts():
    """Texts in parts of a hundred bytes lose no n-gram."""
    for text in ["alpha " * 500, "x" * 5000, "a b " * 400 + "tail", "é漢字 ß " * 90]:
        want = Counter(zlib.crc32(g.encode()) % 997 for g in features(text)[1])
        found = Counter()
        connection = importance._connection()
        for part, tail in importance.parts_of(text.encode(), 100):
            found.update((importance._keys(connection, [0], [tail], [part], 997)).tolist())
        assert found == want


def test_packed_counts_are_spread():
    a, b = importance._packed(np.array([3, 9]), np.array([65_536 * 2, 5]))
    assert np.frombuffer(a, "<u2").tolist() == [3, 3, 3, 9] and np.frombuffer(b, "<u2").tolist() == [65_535, 65_535, 2, 5]


def test_resample_ties_and_empty(spark):
    """Equal ids and texts are ranked one after the other; nothing in, nothing out."""
    rows = [(4, "same words " * 20, "en")] * 30 + [(5, "same words " * 20, "en")] * 30
    target = spark.createDataFrame([("same",)], "text string")
    got = importance.resample(frame(spark, rows), target, percent=50).collect()
    assert sorted((tuple(r) for r in got), key=repr) == resampled(rows, ["same"], 50)
    assert importance.resample(frame(spark, rows).limit(0), target).count() == 0
    assert sorted((tuple(r) for r in importance.resample(frame(spark, rows), target.limit(0), percent=10).collect()), key=repr) == resampled(rows, [], 10)


@pytest.mark.parametrize("name", ["op12_importance_resample", "op13_filter_audit"])
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    same(queries.queries()[name](spark, SF), con.sql(queries.oracle_sql()[name]))


# ---------------------------------------------------------------- filter audit


def audited(rows, labels):
    """Every order applied to every document."""
    first = {}
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    label = {}
    for i, q, t in labels:
        if i is not None:
            old = label.get(i, (0, 0))
            label[i] = (max(old[0], q or 0), max(old[1], t or 0))
    docs = []
    for i, text, lang in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)), "E": i is not None and first[text] < i,
        }
        docs.append((lang or "", fails, *(label.get(i, (0, 0)) if i is not None else (0, 0))))
    out, shapley = {}, Counter()
    for order in map("".join, permutations("ABCDE")):
        for part in {d[0] for d in docs}:
            live = [d for d in docs if d[0] == part]
            own, gone = live, []
            for step, f in enumerate(order, 1):
                lost = [d for d in live if d[1][f]]
                live = [d for d in live if not d[1][f]]
                unique = sum(d[1][f] and sum(d[1].values()) == 1 for d in own)
                out[part, order, step] = [len(live), len(lost), sum(d[1][f] for d in gone), unique, sum(d[2] == 1 for d in lost), sum(d[3] == 1 for d in lost)]
                shapley[part, f] += len(lost)
                gone = gone + lost
    return sorted((p, o, s, *v, shapley[p, o[s - 1]]) for (p, o, s), v in out.items())


LABELS = [(1, 1, 0), (2, 0, 1), (2, 1, None), (5, 1, 1), (9, None, 1), (None, 1, 1), (77, 1, 1)]


def test_audit_brute_force(spark, docs):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(docs, labels).collect()
    assert sorted(map(tuple, got)) == audited(ROWS, LABELS)


def test_audit_empty(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs.limit(0), labels).count() == 0
    assert sorted(map(tuple, filter_audit.audit(docs, labels).collect())) == audited(ROWS, [])


# ---------------------------------------------------------------- sharding: an id with many texts


def test_an_id_with_many_texts_crowds_no_bucket(spark):
    """Half of all rows have one id and texts of their own: their shard gets more buckets, each of about the usual size."""
    rows = spark.range(6000).selectExpr("CASE WHEN id % 2 = 0 THEN 7 ELSE id END AS doc_id", "concat('text ', id) AS text").repartition(4)
    found = sharding.shard_records(rows, 6, bucket_rows=64)
    plan = found._jdf.queryExecution().analyzed().toString()
    got = found.select("doc_id", "text", "shard", "slot").collect()
    assert len(got) == 6000 and len({(r.shard, r.slot) for r in got}) == 6000
    by_shard = Counter(r.shard for r in got)
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(n)) for s, n in by_shard.items()) and max(by_shard.values()) > 3000
    # Buckets as the operator deals them: the fullest is near the size asked for.
    per = [max(1, math.ceil(by_shard.get(s, 0) / 64)) for s in range(6)]
    assert str(per).replace(" ", "").strip("[]") in plan.replace(" ", "")
    h = F.xxhash64(F.lit(11), F.col("doc_id"), F.col("text"), F.lit(1))
    buckets = found.select("shard", F.pmod(h, F.get(F.array(*map(F.lit, per)), F.col("shard"))).alias("b")).groupBy("shard", "b").count()
    assert buckets.agg(F.max("count")).first()[0] < 4 * 64
