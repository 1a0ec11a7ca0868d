"""SimHash near-duplicates with pivot distance tables.

A text's fingerprint has bit b set if over half of its shingles' hashes have.
Two fingerprints link if at most ``radius`` bits differ.

Finding the links, exactly:

* The table of pivots: of each distinct fingerprint the Hamming distances to the
  ``PIVOTS`` reference fingerprints are computed once and go along with it. If two
  rows of the table differ by more than the radius in any coordinate, the triangle
  inequality rules the pair out; what survives is verified bit by bit.
* Not every pair of rows can meet. The 64 bits are cut into blocks; of ``radius + k``
  blocks a linked pair agrees on ``k`` whole ones, so rows meet that have ``k``
  equal blocks. ``k`` follows the number of distinct fingerprints, so that groups
  stay small at any size; every choice finds every link. A group of over ``GROUP``
  rows is dealt again by blocks of the bits that are left, by the same argument.
* A group only says which of its fingerprints hang together: it sends a spanning
  forest, not its pairs. A fingerprint that is already linked leaves the search,
  so a group of near copies costs about its size. What is still beyond ``GROUP``
  rows is cut into pieces, and each pair of pieces is a task of its own.

Components then come from alternating minimum-label steps over that forest.

:func:`one_of_each` is the other use: near copies by the Jaccard similarity of
their shingles. At a similarity of 0.8 in five words the fingerprints of five-word
shingles differ by 10 bits in the mean, which no exact search by bits can follow at
scale. There a quick search finds most links and an exact one the rest. In the quick one the
fingerprints are those of two-word shingles, whose bits move less, rows meet that agree
on sampled bits, the pivots discard, and the sets of five-word shingles themselves
decide. Small groups send all their pairs to be decided. A large group gets its
members' sets and sends a spanning forest of the decided links, so that a family of
thousands costs about its size. The exact one (:mod:`turnstile.llm.set_links`) then
looks for every link between what is still apart.
"""

from __future__ import annotations

import random
from collections.abc import Iterable, Iterator, Sequence
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstile.llm.common import Sink, bound_batches, broadcast_if_small, discard, map_rows, materialize, utf8
from turnstile.llm.repeats import first_in_order, keyed_texts
from turnstile.llm.set_links import alike, decided, missing_links, node_of, sets_of, shingle_set  # noqa: F401  shingle_set is part of this module

SHINGLE = 4
SEED = 42
RADIUS = 4
#: Reference fingerprints: pseudo-random, from the hash of their number.
PIVOTS = np.array([xxhash.xxh64_intdigest(b"pivot %d" % i, SEED) for i in range(16)], np.uint64)
#: Distinct fingerprints that one search takes at once; twice that in a task.
GROUP = 8192
#: Near copies, the quick search: words of a fingerprint's shingle, bits that may differ, and
#: tables of sampled bits.
WIDE_SHINGLE, WIDE_RADIUS, TABLES = 2, 10, 24
#: Rows of a group that sends all its pairs; larger ones are decided where they meet.
SMALL = 64
#: MinHashes that spare a large group most exact comparisons: of two sets of similarity 0.8 about
#: 102.5 of 128 bytes agree, fewer than ``AGREE`` of them once in some 7,000 pairs.
_MULTIPLY = np.array([xxhash.xxh32_intdigest(b"multiply %d" % i, SEED) | 1 for i in range(128)], np.uint32)
_ADD = np.array([xxhash.xxh32_intdigest(b"add %d" % i, SEED) for i in range(128)], np.uint32)
AGREE = 86
_CHUNK = 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint of a UTF-8 text; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - shingle + 1)
    starts = np.concatenate(([0], stops[:-1] + 1))[:n].tolist()
    ends = stops[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        part = [digest(line[a:b], SEED) for a, b in zip(starts[at : at + _CHUNK], ends[at : at + _CHUNK], strict=True)]
        bits = np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return sum(1 << b for b in np.flatnonzero(2 * counts > n).tolist())


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row per row of ``docs``: ``doc_id`` and ``fp``, the fingerprint as a signed long."""

    def row(doc, text):
        yield doc, (fingerprint(text, shingle) ^ (1 << 63)) - (1 << 63)

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("t"))
    return map_rows(source, ["doc_id", "t"], pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())]), "doc_id long, fp long", row)


def plan_blocks(distinct: int, radius: int = RADIUS, per_group: int = 16) -> tuple[int, int]:
    """Blocks and how many must agree, for groups of about ``per_group`` at even spread."""
    for agree in range(1, 5):
        blocks = radius + agree
        if distinct >> (64 * agree // blocks) <= per_group:
            break
    return blocks, agree


def _cut(bits: Sequence[int], parts: int) -> list[int]:
    """Masks of ``parts`` runs of the given bits."""
    edges = [len(bits) * i // parts for i in range(parts + 1)]
    return [sum(1 << b for b in bits[a:z]) for a, z in zip(edges, edges[1:], strict=False)]


def block_masks(blocks: int, agree: int) -> list[int]:
    """One mask of bits for each choice of ``agree`` blocks."""
    return [sum(c) for c in combinations(_cut(range(64), blocks), agree)]


def sampled_masks(distinct: int, tables: int, per_group: int = 16) -> list[int]:
    """Masks of seeded random bits, as many bits as leave about ``per_group`` fingerprints together at even spread."""
    rng = random.Random(SEED)
    width = min(40, max(8, (max(distinct, 1) // per_group).bit_length()))
    return [sum(1 << b for b in rng.sample(range(64), width)) for _ in range(tables)]


def left_masks(mask: int, radius: int) -> list[int]:
    """Blocks of the bits outside ``mask``: who agrees on it and is linked agrees on one of them too."""
    return _cut([b for b in range(64) if not mask >> b & 1], radius + 1)


class Forest:
    """Union-find over signed longs."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (p := up.get(x, x)) != x:
            up[x] = x = up.get(p, p)
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def pivot_table(fps: np.ndarray, pivots: np.ndarray = PIVOTS) -> np.ndarray:
    """Hamming distances to the pivots, one row a fingerprint."""
    return np.bitwise_count(fps.view(np.uint64)[:, None] ^ pivots[None, :]).astype(np.int8)


def with_pivots(distinct: DataFrame) -> DataFrame:
    """``distinct(fp, least)`` with ``pivots``, the row of the table as 16 bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pivot_table(batch.column(0).to_numpy(zero_copy_only=False))
            rows = pa.array([row.tobytes() for row in table], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, rows], names=["fp", "least", "pivots"])

    return distinct.select("fp", "least").mapInArrow(run, "fp long, least long, pivots binary")


def near(x: np.ndarray, tx: np.ndarray, ys: np.ndarray, tys: np.ndarray, radius: int) -> np.ndarray:
    """Indices of ``ys`` within ``radius`` of ``x``: pivots discard, bits verify."""
    left = np.arange(len(ys))
    for k in range(0, tys.shape[1], 4):  # four coordinates at a time; most rows go with the first
        left = left[(np.abs(tys[left, k : k + 4] - tx[k : k + 4]) <= radius).all(axis=1)]
        if not len(left):
            return left
    return left[np.bitwise_count(ys[left].view(np.uint64) ^ x.view(np.uint64)) <= radius]


def link_group(fps: np.ndarray, table: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links among distinct ``fps``; what is linked leaves the search."""
    by = np.argsort(table[:, 0], kind="stable")  # the first coordinate bounds where to look
    fps, table = fps[by], table[by]
    left = np.arange(len(fps))
    while len(left):
        # Each tree grows from its smallest fingerprint, so that other groups give the same links.
        seed = int(fps[left].argmin())
        queue, left = [int(left[seed])], np.delete(left, seed)
        while queue and len(left):
            x = queue.pop()
            first = table[left, 0]
            part = left[np.searchsorted(first, table[x, 0] - radius) : np.searchsorted(first, table[x, 0] + radius, "right")]
            hit = part[near(fps[x], table[x], fps[part], table[part], radius)]
            for y in hit.tolist():
                yield int(fps[x]), int(fps[y])
                queue.append(y)
            left = left[~np.isin(left, hit, assume_unique=True)]


def link_small(
    keys: np.ndarray, fps: np.ndarray, table: np.ndarray, radius: int, widest: int, names: np.ndarray | None = None
) -> Iterator[tuple[int, int, bool]]:
    """The links of all small groups at once, and whether they are in a spanning forest: rows are sorted by key and fingerprint, and each meets those after it.

    Rows are named by ``names``, by their fingerprints unless it is given.
    """
    names = fps if names is None else names
    first, second = [], []
    for step in range(1, widest):
        a = np.flatnonzero(keys[step:] == keys[:-step])
        if not len(a):
            break
        for k in range(table.shape[1]):
            a = a[np.abs(table[a, k] - table[a + step, k]) <= radius]
        a = a[np.bitwise_count(fps[a].view(np.uint64) ^ fps[a + step].view(np.uint64)) <= radius]
        first.append(a)
        second.append(a + step)
    if not first:
        return
    a, b = np.concatenate(first), np.concatenate(second)
    by = np.lexsort((b, a))
    trees = Forest()  # over rows, so that groups stay apart
    for x, y in zip(a[by].tolist(), b[by].tolist(), strict=True):
        tree = trees.root(x) != trees.root(y)
        if tree:
            trees.join(x, y)
        yield int(names[x]), int(names[y]), tree


def _groups(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sorted (key, fp, pivots) rows, in portions that end where a key ends."""
    held: list[tuple[np.ndarray, ...]] = []
    count = 0
    for batch in batches:
        own = [batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)]
        table = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.int8).reshape(-1, len(PIVOTS))
        held.append((*own, table))
        count += batch.num_rows
        if count >= rows:
            whole = [np.concatenate(x) for x in zip(*held, strict=True)]
            cut = int(np.searchsorted(whole[0], whole[0][-1], "left"))
            if cut:
                yield tuple(x[:cut] for x in whole)
            held, count = [tuple(x[cut:] for x in whole)], len(whole[0]) - cut
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _dealt(distinct: DataFrame, masks: list[int], radius: int) -> DataFrame:
    """``key, fp, pivots``: rows that may be linked share a key, and a key has at most 2 * ``GROUP`` rows."""
    literal = F.array(*[F.lit(_signed(m)) for m in masks])
    keyed = distinct.select("fp", "pivots", F.posexplode(literal).alias("t", "mask")).select(
        F.xxhash64("t", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"), "t", "fp", "pivots"
    )
    hot = materialize(keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > GROUP).select("key"), "large-blocks")
    parts = [keyed.select("key", "fp", "pivots")]
    if hot.limit(1).count():
        parts = [keyed.join(hot, "key", "left_anti").select("key", "fp", "pivots")]
        # Large groups again, by blocks of the bits on which they needn't agree.
        finer = F.array(*[F.array(*[F.lit(_signed(m)) for m in left_masks(mask, radius)]) for mask in masks])
        large = keyed.join(hot, "key", "left_semi")
        again = large.select("key", "fp", "pivots", F.posexplode(F.get(finer, F.col("t"))).alias("u", "mask")).select(
            F.xxhash64("key", "u", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"), "fp", "pivots"
        )
        again = materialize(again, "blocks-again")
        counts = materialize(again.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "sizes-again")
        pieces = F.ceil(F.col("n") / GROUP).cast("int")
        grouped = again.join(counts, "key").withColumn("pieces", pieces)
        own = F.pmod(F.xxhash64("fp"), F.col("pieces")).cast("int")
        other = F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))
        met = grouped.withColumn("own", own).select("key", "fp", "pivots", "pieces", "own", other.alias("other"))
        pair = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
        parts.append(met.select(F.when(F.col("pieces") == 1, F.col("key")).otherwise(pair).alias("key"), "fp", "pivots"))
    return reduce(DataFrame.unionByName, parts)


def links(distinct: DataFrame, radius: int = RADIUS, *, small: int = 32) -> DataFrame:
    """A spanning forest ``(node, up)`` of the links among the rows of ``distinct(fp, pivots)``.

    Every pair of fingerprints at most ``radius`` bits apart is connected by it.
    """
    dealt = _dealt(distinct, block_masks(*plan_blocks(distinct.count(), radius)), radius)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        sink = Sink(pa.schema([("node", pa.int64()), ("up", pa.int64())]))
        for x, y, tree in _linked(batches, radius, small):
            if tree:
                forest.join(x, y)
            if len(forest.up) > 500_000:
                for node in list(forest.up):
                    if sink.add(node, forest.root(node)):
                        yield sink.flush()
                forest = Forest()
        for node in list(forest.up):
            if sink.add(node, forest.root(node)):
                yield sink.flush()
        if len(sink):
            yield sink.flush()

    return dealt.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(run, "node long, up long")


def _linked(batches: Iterator[pa.RecordBatch], radius: int, small: int) -> Iterator[tuple[int, int, bool]]:
    """Links of each group of rows sorted by key, and whether they are in its forest."""
    for keys, fps, table in _groups(batches, 200_000):
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        size = np.diff(np.concatenate((first, [len(keys)])))
        for a, n in zip(first[size > small].tolist(), size[size > small].tolist(), strict=True):
            for x, y in link_group(fps[a : a + n], table[a : a + n], radius):
                yield x, y, True
        few = np.repeat(size <= small, size)
        yield from link_small(keys[few], fps[few], table[few], radius, small)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of ``edges(node, up)``; the root is the smallest node reachable.

    Alternates large-star and small-star steps (Kiveris and others, 2014): each
    turns edges so that they point at smaller nodes; when nothing changes, every
    edge points at its root. Each step is written to the shared folder, and so are
    the minima: a join of two tables reads both sides as they are dealt, so that
    Spark can split a hot node's edges.
    """
    now = materialize(
        edges.select(F.greatest("node", "up").alias("node"), F.least("node", "up").alias("up")).where("node != up").distinct(), "edges"
    )
    both = lambda e: e.select("node", "up").unionByName(e.select(F.col("up").alias("node"), F.col("node").alias("up")))
    summary = lambda e: e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("node", "up").cast("decimal(38,0)")).alias("h")).first()
    last = summary(now)
    for _ in range(most_rounds):
        if not last.n:
            break
        # Large star: larger neighbours point at the smallest of all.
        pairs = both(now)
        least = materialize(pairs.groupBy("node").agg(F.least(F.min("up"), F.col("node")).alias("m")), "least")
        large = pairs.where("up > node").join(least, "node").select(F.col("up").alias("node"), F.col("m").alias("up")).distinct()
        large = materialize(large, "edges")
        # Small star: smaller neighbours and the node itself point at the smallest.
        least = materialize(large.groupBy("node").agg(F.min("up").alias("m")), "least")
        small = large.join(least, "node")
        small = small.select(F.col("up").alias("node"), F.col("m").alias("up")).unionByName(least.select("node", F.col("m").alias("up")))
        now = materialize(small.where("node != up").distinct(), "edges")
        seen = summary(now)
        if seen == last:
            break
        last = seen
    else:
        raise RuntimeError("components did not settle")
    return now.select("node", F.col("up").alias("root"))


def near_duplicates(
    docs: DataFrame, *, radius: int = RADIUS, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``fingerprint`` (16 hex digits), ``component_id``.

    ``component_id`` is the smallest id of the documents reachable over links,
    the document's own included. Texts without words (null, empty, blank) have
    fingerprint 0, which links like any other. A null id takes part and gets its
    component's id, null if all its members' ids are null. Repeated rows stay.
    Other columns are not read. An empty table gives an empty table. A very long
    text is hashed in pieces in its task; only its fingerprint goes on.
    """
    bound_batches(docs.sparkSession)
    prints = materialize(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle), "fingerprints")
    distinct = materialize(with_pivots(prints.groupBy("fp").agg(F.min("doc_id").alias("least"))), "distinct")
    roots = components(links(distinct, radius))
    rooted = materialize(
        distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "rooted"
    )
    # Aggregates are written before they are joined, so that Spark can split a hot root or fingerprint.
    least = materialize(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "component-ids")
    named = materialize(rooted.join(least, "root").select("fp", "component_id"), "named")
    return prints.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# ---------------------------------------------------------------- near copies by shingle sets


def sketch(hashes: np.ndarray) -> np.ndarray:
    """A byte of each of 128 minima of a set of hashes."""
    low = hashes.astype(np.uint32)
    least = np.full(len(_ADD), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 4096):
        least = np.minimum(least, (low[at : at + 4096, None] * _MULTIPLY + _ADD).min(axis=0))
    return ((least ^ (least >> np.uint32(15))) & np.uint32(255)).astype(np.uint8)


def link_alike(nodes: np.ndarray, fps: np.ndarray, table: np.ndarray, sets: list[np.ndarray], radius: int) -> Iterator[tuple[int, int]]:
    """A spanning forest of the pairs of a group that pivots and bits leave and the sets decide; what is linked leaves the search."""
    by = np.argsort(table[:, 0], kind="stable")
    nodes, fps, table, sets = nodes[by], fps[by], table[by], [sets[i] for i in by]
    sketches = np.array([sketch(x) for x in sets]).reshape(len(sets), len(_ADD))
    left = np.arange(len(fps))
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            x = queue.pop()
            first = table[left, 0]
            part = left[np.searchsorted(first, table[x, 0] - radius) : np.searchsorted(first, table[x, 0] + radius, "right")]
            hit = part[near(fps[x], table[x], fps[part], table[part], radius)]
            hit = hit[(sketches[hit] == sketches[x]).sum(axis=1) >= AGREE]
            hit = np.array([y for y in hit.tolist() if alike(sets[x], sets[y])], np.int64)
            for y in hit.tolist():
                yield int(nodes[x]), int(nodes[y])
            queue += hit.tolist()
            if len(hit):
                left = left[~np.isin(left, hit, assume_unique=True)]


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """key, node, fp, pivots of a batch."""
    own = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
    return (*own, np.frombuffer(b"".join(batch.column(3).to_pylist()), np.int8).reshape(-1, len(PIVOTS)))


def _portions(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[list[np.ndarray], list[pa.Array]]]:
    """Rows sorted by key in portions that end where a key ends; with them what other columns the batches have."""
    held: list[pa.RecordBatch] = []
    count = 0

    def portion(whole: pa.RecordBatch) -> tuple[list[np.ndarray], list[pa.Array]]:
        return list(_arrays(whole)), whole.columns[4:]

    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count >= rows:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            keys = whole.column(0).to_numpy(zero_copy_only=False)
            cut = int(np.searchsorted(keys, keys[-1], "left"))
            if cut:
                yield portion(whole.slice(0, cut))
            held, count = [whole.slice(cut)], len(keys) - cut
    if count:
        yield portion(pa.Table.from_batches(held).combine_chunks().to_batches()[0])


_EDGES = pa.schema([("node", pa.int64()), ("up", pa.int64())])
_PAIRS = pa.schema([("node", pa.int64()), ("up", pa.int64()), ("tree", pa.bool_())])


def candidates(nodes: DataFrame, radius: int, tables: int) -> tuple[DataFrame, DataFrame]:
    """Of ``nodes(node, fp, pivots)``: the pairs ``(node, up, tree)`` of small groups, and the rows ``(key, node, fp, pivots)`` of large ones.

    Rows that agree on some table's bits share a key. ``tree`` says whether a pair is in the
    spanning forest of one of its groups. Large groups are cut into pieces of ``GROUP`` rows, and each
    two pieces are a group.
    """
    masks = F.array(*[F.lit(_signed(m)) for m in sampled_masks(nodes.count(), tables)])
    keyed = nodes.select("node", "fp", "pivots", F.posexplode(masks).alias("t", "mask")).select(
        F.xxhash64("t", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"), "node", "fp", "pivots"
    )
    large = materialize(keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > SMALL), "large-groups")
    few = keyed.join(broadcast_if_small(large.select("key"), 8), "key", "left_anti")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink = Sink(_PAIRS)
        for (keys, own, fps, table), _ in _portions(batches, 200_000):
            for a, b, tree in link_small(keys, fps, table, radius, SMALL, own):
                if sink.add(max(a, b), min(a, b), tree):
                    yield sink.flush()
        if len(sink):
            yield sink.flush()

    met = few.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(pairs, "node long, up long, tree boolean")
    grouped = keyed.join(broadcast_if_small(large, 16), "key").withColumn("pieces", F.ceil(F.col("n") / GROUP).cast("int"))
    own = F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int")
    dealt = grouped.withColumn("own", own).select("key", "node", "fp", "pivots", "pieces", "own", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("other"))
    pair = F.when(F.col("pieces") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")))
    return met.groupBy("node", "up").agg(F.max("tree").alias("tree")), dealt.select(pair.alias("key"), "node", "fp", "pivots")


def decide_large(rows: DataFrame, sets: DataFrame, radius: int) -> DataFrame:
    """The links ``(node, up)`` of large groups, a spanning forest a group, decided where the sets ``(node, s)`` meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink = Sink(_EDGES)
        for (keys, own, fps, table), (held,) in _portions(batches, 1):
            edges = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                group = [np.frombuffer(x, np.uint64) for x in held.slice(a, b - a).to_pylist()]
                for x, y in link_alike(own[a:b], fps[a:b], table[a:b], group, radius):
                    if sink.add(max(x, y), min(x, y)):
                        yield sink.flush()
        if len(sink):
            yield sink.flush()

    joined = rows.join(sets, "node").select("key", "node", "fp", "pivots", "s")
    return joined.repartition("key").sortWithinPartitions("key").mapInArrow(run, "node long, up long").distinct()


def one_of_each(
    docs: DataFrame,
    *,
    radius: int = WIDE_RADIUS,
    tables: int = TABLES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """``doc_id`` and ``key`` (:func:`keyed_texts`) of one row of each group of near copies, and of all rows.

    Texts link if they have the same words, or if the Jaccard similarity of their
    sets of five-word shingles is 0.8 or more (:mod:`turnstile.llm.set_links`); no
    link is left out. ``radius`` and ``tables`` bear on how many of them the quick
    search finds first. Of each group the row with the smallest id
    comes, null last, then the smallest key. Rows without an id take part by their
    texts; rows that share id and text are one. Texts without words are copies.
    """
    bound_batches(docs.sparkSession)
    source = keyed_texts(docs, id_col, text_col)
    long = pa.int64()
    schema = lambda *names: pa.schema([(n, long) for n in names])

    def named(doc, key, text) -> Iterable[tuple]:
        yield doc, key, node_of(text), (fingerprint(text, WIDE_SHINGLE) ^ (1 << 63)) - (1 << 63)

    ddl = "doc_id long, key long, node long, fp long"
    rows = materialize(map_rows(source, ["doc_id", "key", "t"], schema("doc_id", "key", "node", "fp"), ddl, named), "named")
    # A node is a text, whatever its blanks and case.
    nodes = materialize(rows.groupBy("node").agg(F.first("fp").alias("fp"), F.min("key").alias("key")), "nodes")
    pairs, large = candidates(with_pivots(nodes.select("fp", F.col("node").alias("least"))).withColumnRenamed("least", "node"), radius, tables)
    pairs, large = materialize(pairs, "pairs"), materialize(large, "large-rows")

    # Only the texts that some pair or large group names are taken apart; only they are dealt.
    asked = pairs.select("node").union(pairs.select("up")).union(large.select("node")).distinct()
    needed = materialize(nodes.join(asked, "node").select("key", "node"), "needed")
    sets = sets_of(source, needed)
    in_large = materialize(decide_large(large, sets.select("node", "s"), radius), "decided")

    # The forests first; of the other pairs only those that would join what is still apart.
    first = materialize(decided(pairs.where("tree"), sets).unionByName(in_large), "first-links")
    now = components(first)
    apart = pairs.where("NOT tree").join(now, "node", "left").withColumn("a", F.coalesce("root", "node")).drop("root")
    apart = apart.join(now.select(F.col("node").alias("up"), "root"), "up", "left").where(F.col("a") != F.coalesce("root", "up"))
    roots = components(first.unionByName(decided(apart, sets)))
    discard(sets, pairs, large)
    # What fingerprints and sampled bits missed: every other link, by the sets alone.
    missed = missing_links(source, nodes.select("node", "key"), roots)
    roots = components(roots.select("node", F.col("root").alias("up")).unionByName(missed))
    grouped = rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    chosen = materialize(grouped.groupBy("root").agg(F.min(first_in_order()).alias("one")).select("one.doc_id", "one.key"), "chosen")
    return chosen, rows.select("doc_id", "key")
