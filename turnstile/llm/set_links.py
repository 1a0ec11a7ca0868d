"""Texts whose shingle sets agree to 0.8: every pair, by prefixes of the sets.

Sets of ``a`` and ``b`` shingles have a Jaccard similarity of ``LEAST`` if they
share at least 4/9 of ``a + b``. All shingles stand in one order, the same for every
text. What two sets share begins with their first shared shingle, so each has at
least that many shingles from there on: a pair that links shares one of the first
``a - ceil(0.8 a) + 1`` shingles of the one and of the other, and this place says of
most other pairs that too little is left. No pair is missed, whatever the order.

* The order puts frequent shingles last, so that prefixes hold rare ones. Which are
  frequent is counted roughly: it bears on the size of groups only.
* Texts that share a shingle of their prefixes meet there by hash. Most shingles have
  one text and go at once. Where all texts of a shingle are of one group already,
  nothing is left to find; else those of different groups are compared.
* A pair first shows the parities of its sets: one bit for each of some thousands of
  classes of hashes, odd or even. Sets differ in at least as many shingles as
  parities, so too many refuse a pair for certain. The sets decide on the rest.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstile.llm.common import broadcast_if_small, discard, map_rows, materialize, rows_of

SEED = 42
#: Near copies by shingle sets: words of a shingle and least similarity. :func:`least_shared` and
#: :func:`prefix` have the similarity as whole numbers.
SET_SHINGLE, LEAST = 5, 0.8
#: Shingles that are counted at once, how often one must stand among them, and in all, to be
#: frequent; the most frequent ones that every task knows.
COUNTED, OFTEN, FREQUENT, KNOWN = 1 << 21, 3, 16, 1 << 18
#: Rows of a group that are compared with those of all other groups at once; larger ones go by
#: themselves, and in pieces of ``PIECE`` rows each two of which are a group.
SMALL, PIECE = 64, 8192
_BATCH = 1 << 16


def node_of(text: bytes) -> int:
    """A text's name: equal for the same words, whatever their blanks and case."""
    return xxhash.xxh64_intdigest(b" ".join(text.lower().split()), SEED) - (1 << 63)


def shingle_set(text: bytes, shingle: int = SET_SHINGLE) -> np.ndarray:
    """Sorted hashes of a text's distinct shingles; of all its words where they are fewer."""
    words = text.lower().split()
    line = b" ".join(words)
    stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - shingle + 1)
    starts = [0, *(stops[: n - 1] + 1).tolist()]
    ends = stops[shingle - 1 :].tolist() if len(words) > shingle else [len(line)]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, ends, strict=True)), np.uint64, n))


def alike(a: np.ndarray, b: np.ndarray, least: float = LEAST) -> bool:
    """Whether two sets have a Jaccard similarity of ``least``."""
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared >= least * (len(a) + len(b) - shared)


def least_shared(a, b):
    """How many shingles sets of ``a`` and ``b`` share at least if they link: 4/9 of them, rounded up."""
    return -(-4 * (a + b) // 9)


def prefix(a: int) -> int:
    """How many shingles of a set of ``a`` hold the first that it shares with any set it links with."""
    return a - (4 * a + 4) // 5 + 1


def in_order(own: np.ndarray, frequent: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The prefix of a set in the order of all: shingles that aren't ``frequent`` by their hashes, then those, the rarer first."""
    n = prefix(len(own))
    if not len(frequent):
        return own[:n]
    at = np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)
    rank = np.where(frequent[at] == own, counts[at], 0)
    rare = own[rank == 0]
    if len(rare) >= n:
        return rare[:n]
    return own[np.lexsort((own, rank))[:n]]


def parities(own: np.ndarray) -> np.ndarray:
    """Whether odd numbers of a set's hashes fall into each class, as bytes; larger sets have more classes."""
    classes = max(1024, 1 << (2 * len(own) - 1).bit_length())
    return np.packbits(np.bincount((own & np.uint64(classes - 1)).astype(np.int64), minlength=classes).astype(np.uint8) & 1, bitorder="little")


def parities_apart(x: np.ndarray, y: np.ndarray) -> int:
    """In how many classes two sets' parities differ; their sets differ in as many shingles at least."""
    while len(x) != len(y):  # the upper half of the classes falls on the lower one
        if len(x) < len(y):
            x, y = y, x
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _distinct_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """Node and shingle set of the texts of a task; of copies mostly the first."""
    seen: set[int] = set()
    for (text,) in rows_of(batches, "t"):
        node = node_of(text)
        if node not in seen:
            seen.add(node)
            if len(seen) > 500_000:
                seen.clear()
            yield node, shingle_set(text)


def frequent_shingles(source: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and rough counts of frequent shingles of ``source(t)``, by hash, ``KNOWN`` at most.

    A task counts ``COUNTED`` shingles at a time and tells those it sees ``OFTEN``. Which are known
    only orders the shingles.
    """

    def told(held: list[np.ndarray]) -> pa.RecordBatch:
        values, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(values[n >= OFTEN].view(np.int64)), pa.array(n[n >= OFTEN].astype(np.int64))], names=["token", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for _, own in _distinct_sets(batches):
            held.append(own)
            count += len(own)
            if count >= COUNTED:
                yield told(held)
                held, count = [], 0
        if held:
            yield told(held)

    counted = source.select("t").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    counted = materialize(counted.where(F.col("n") >= FREQUENT), "frequent")
    least = FREQUENT
    while counted.where(F.col("n") >= least).count() > KNOWN:
        least *= 2
    most = counted.where(F.col("n") >= least).toArrow()
    discard(counted)
    hashes, counts = (most.column(i).to_numpy() for i in (0, 1))
    hashes = hashes.view(np.uint64)
    by = np.argsort(hashes)
    return hashes[by], counts[by]


def prefixes(source: DataFrame, frequent: np.ndarray, counts: np.ndarray) -> DataFrame:
    """``token, node, size, rest``: the prefix of every set of ``source(t)``; ``rest`` shingles stand from the token on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        count = 0
        for node, own in _distinct_sets(batches):
            first = in_order(own, frequent, counts)
            n = len(first)
            held.append((first.view(np.int64), np.full(n, node), np.full(n, len(own), np.int32), np.arange(len(own), len(own) - n, -1, dtype=np.int32)))
            count += n
            if count >= _BATCH:
                yield _batch(held, ["token", "node", "size", "rest"])
                held, count = [], 0
        if held:
            yield _batch(held, ["token", "node", "size", "rest"])

    return source.select("t").mapInArrow(run, "token long, node long, size int, rest int")


def _batch(held: list[tuple[np.ndarray, ...]], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held, strict=True)], names=names)


def _portions(batches: Iterator[pa.RecordBatch], rows: int = 200_000) -> Iterator[list[np.ndarray]]:
    """The columns of rows sorted by the first, in portions that end where a value of it does."""
    held: list[list[np.ndarray]] = []
    count, enough = 0, rows
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        count += batch.num_rows
        if count >= enough:
            whole = [np.concatenate(x) for x in zip(*held, strict=True)]
            cut = int(np.searchsorted(whole[0], whole[0][-1], "left"))
            if cut:
                yield [x[:cut] for x in whole]
            held, count = [[x[cut:] for x in whole]], len(whole[0]) - cut
            enough = max(rows, 2 * count)
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def shared_prefixes(rows: DataFrame) -> DataFrame:
    """Of :func:`prefixes` the rows whose token another node has too, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _portions(batches):
            token, node = columns[:2]
            new = np.concatenate(([True], (token[1:] != token[:-1]) | (node[1:] != node[:-1])))  # copies come from other tasks
            columns = [x[new] for x in columns]
            same = columns[0][1:] == columns[0][:-1]
            met = np.concatenate(([False], same)) | np.concatenate((same, [False]))
            if met.any():
                yield _batch([tuple(x[met] for x in columns)], ["token", "node", "size", "rest"])

    return rows.repartition("token").sortWithinPartitions("token", "node").mapInArrow(run, "token long, node long, size int, rest int")


def pairs_of_small(keys: np.ndarray, size: np.ndarray, rest: np.ndarray, root: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices of the pairs of all groups at once that are of different roots and have enough left; rows are sorted by key."""
    a = np.arange(len(keys))
    for step in range(1, len(keys)):
        a = a[: np.searchsorted(a, len(keys) - step)]
        a = a[keys[a + step] == keys[a]]
        if not len(a):
            return
        b = a + step
        hit = (root[a] != root[b]) & (np.minimum(rest[a], rest[b]) >= least_shared(size[a], size[b]))
        yield a[hit], b[hit]


def pairs_of_large(size: np.ndarray, rest: np.ndarray, root: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same of one large group, which costs nothing for the pairs of one root: rows of rarer roots meet those of others."""
    _, run, n = np.unique(root, return_inverse=True, return_counts=True)
    by = np.lexsort((run, n[run]))
    run, size, rest = run[by], size[by], rest[by]
    ends = np.flatnonzero(np.concatenate((run[1:] != run[:-1], [True]))) + 1
    others = ends[np.searchsorted(ends, np.arange(len(run)), "right")]
    for i, z in enumerate(others.tolist()):
        if z == len(run):
            return
        hit = z + np.flatnonzero(np.minimum(rest[i], rest[z:]) >= least_shared(size[i], size[z:]))
        if len(hit):
            yield np.full(len(hit), by[i]), by[hit]


def _pairs(columns: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices of a portion's pairs."""
    keys, _, size, rest, root = columns
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    n = np.diff(np.concatenate((first, [len(keys)])))
    few = np.flatnonzero(np.repeat(n <= SMALL, n))
    for a, b in pairs_of_small(keys[few], size[few], rest[few], root[few]):
        yield few[a], few[b]
    for at, rows in zip(first[n > SMALL].tolist(), n[n > SMALL].tolist(), strict=True):
        for a, b in pairs_of_large(size[at : at + rows], rest[at : at + rows], root[at : at + rows]):
            yield at + a, at + b


def prefix_pairs(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs ``(node, up)`` of different ``roots(node, root)`` that may link; a node without a root is its own."""
    rooted = shared.join(roots, "node", "left").select("token", "node", "size", "rest", F.coalesce("root", "node").alias("root"))
    rooted = materialize(rooted, "prefixes-rooted")
    counted = rooted.groupBy("token").agg(F.count("*").alias("n"), F.min("root").alias("a"), F.max("root").alias("z")).where("a < z")
    mixed = materialize(counted.select("token", F.ceil(F.col("n") / PIECE).cast("int").alias("pieces")), "prefixes-mixed")
    met = rooted.join(broadcast_if_small(mixed, 12), "token").withColumn("own", F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    two = F.xxhash64("token", F.least("own", "other"), F.greatest("own", "other"))
    dealt = met.select(F.when(F.col("pieces") == 1, F.col("token")).otherwise(two).alias("key"), "node", "size", "rest", "root")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _portions(batches):
            node = columns[1]
            held, count = [], 0
            for a, b in _pairs(columns):
                held.append((np.maximum(node[a], node[b]), np.minimum(node[a], node[b])))
                count += len(a)
                if count >= 1 << 20:
                    yield from distinct(held)
                    held, count = [], 0
            if count:
                yield from distinct(held)

    def distinct(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        node, up = (np.concatenate(x) for x in zip(*held, strict=True))
        by = np.lexsort((up, node))
        node, up = node[by], up[by]
        new = np.concatenate(([True], (node[1:] != node[:-1]) | (up[1:] != up[:-1])))
        whole = pa.RecordBatch.from_arrays([pa.array(node[new]), pa.array(up[new])], names=["node", "up"])
        for at in range(0, whole.num_rows, _BATCH):
            yield whole.slice(at, _BATCH)

    found = dealt.repartition("key").sortWithinPartitions("key").mapInArrow(run, "node long, up long").distinct()
    pairs = materialize(found, "prefix-pairs")
    discard(rooted, mixed)
    return pairs


_CUT = pa.schema([("node", pa.int64()), ("s", pa.binary()), ("p", pa.binary()), ("size", pa.int32())])
_MARKS = pa.schema([("node", pa.int64()), ("p", pa.binary()), ("size", pa.int32())])
_LINK = pa.schema([("node", pa.int64()), ("up", pa.int64())])


def sets_of(source: DataFrame, needed: DataFrame) -> DataFrame:
    """``node, s, p, size`` of the texts ``source(key, t)`` that ``needed(key, node)`` names: set, parities and number of shingles."""

    def cut(node, text) -> Iterable[tuple]:
        own = shingle_set(text)
        yield node, own.tobytes(), parities(own).tobytes(), len(own)

    texts = source.select("key", "t").join(broadcast_if_small(needed, 16), "key").groupBy("node").agg(F.first("t").alias("t"))
    return materialize(map_rows(texts, ["node", "t"], _CUT, "node long, s binary, p binary, size int", cut), "shingle-sets")


def parities_of(source: DataFrame, needed: DataFrame) -> DataFrame:
    """``node, p, size`` alone, of the same texts; no text is dealt while ``needed`` can be sent."""

    def cut(node, text) -> Iterable[tuple]:
        own = shingle_set(text)
        yield node, parities(own).tobytes(), len(own)

    texts = source.select("key", "t").join(broadcast_if_small(needed, 16), "key")
    marks = map_rows(texts, ["node", "t"], _MARKS, "node long, p binary, size int", cut)
    return materialize(marks.groupBy("node").agg(F.first("p").alias("p"), F.first("size").alias("size")), "parities")


def _both(pairs: DataFrame, table: DataFrame, what: list[str]) -> DataFrame:
    """``pairs(node, up)`` with ``what`` the table has of both."""
    other = table.select("node", *what).toDF("up", *[f"{c}_up" for c in what])
    return pairs.select("node", "up").join(table.select("node", *what), "node").join(other, "up")


def likely(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """The ``pairs`` that the parities of ``marks(node, p, size)`` leave; no link is refused."""

    def left(node, up, p, q, a, b) -> Iterable[tuple]:
        if parities_apart(np.frombuffer(p, np.uint8), np.frombuffer(q, np.uint8)) <= a + b - 2 * least_shared(a, b):
            yield node, up

    both = _both(pairs, marks, ["p", "size"])
    return materialize(map_rows(both, ["node", "up", "p", "p_up", "size", "size_up"], _LINK, "node long, up long", left), "likely")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The ``pairs`` that the sets of ``sets(node, s)`` link."""

    def checked(node, up, x, y) -> Iterable[tuple]:
        if alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)):
            yield node, up

    return materialize(map_rows(_both(pairs, sets, ["s"]), ["node", "up", "s", "s_up"], _LINK, "node long, up long", checked), "verified")


def decided(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Which of ``pairs(node, up)`` link: parities refuse for certain, so that few pairs carry their sets; those decide."""
    return verified(likely(pairs, sets), sets)


def missing_links(source: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Every link ``(node, up)`` between the ``roots(node, root)`` of the texts ``source(key, t)``; ``nodes(node, key)`` names a text of each node."""
    rows = prefixes(source, *frequent_shingles(source))
    shared = materialize(shared_prefixes(rows), "prefixes-shared")
    pairs = prefix_pairs(shared, roots)

    def named_in(some: DataFrame) -> DataFrame:
        asked = some.select("node").union(some.select("up")).distinct()
        return materialize(nodes.join(asked, "node").select("key", "node"), "needed")

    # Parities first and by themselves: hardly a pair here links, so hardly a text has to be dealt or keeps its set.
    marks = parities_of(source, named_in(pairs))
    left = likely(pairs, marks)
    discard(shared, pairs, marks)
    sets = sets_of(source, named_in(left))
    found = verified(left, sets)
    discard(left, sets)
    return found
