"""Vectors that meet in blocks: the products that searches, siblings and clothes share, and the overlaps of clothes.

The rows that answer are dealt once into a bounded number of blocks; what asks goes to
each and is read batch by batch, so a task holds one block's matrix. Matrices choose
what may be best; the choice is then scored number by number in the order of the
vector, as SQL does, so equal vectors tie and results are those of the text.
Rows whose vector is null, of another length or not finite meet in SQL.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnstile.plans.registry import cut

#: Blocks of the rows that answer; more only where a block would exceed ``BLOCK_ROWS``.
BLOCKS = 48
BLOCK_ROWS = 65_536
#: Rows of a key that meet at once; a key of at most ``FEW`` rows meets in a join.
PART_ROWS = 4_096
FEW = 64
#: Products held at once.
HELD = 1 << 22
#: Rows of a key whose clothes meet at once, overlaps held at once, and about how many a task is to give.
LOOK_ROWS = 8_192
TILE = 1 << 15
TASK_PAIRS = 1 << 22
#: Sums of products differ by their order of summation.
SLACK = 1e-9


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return whole.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(whole), -1)


def in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of rows, summed from the first number to the last."""
    total = np.zeros(len(a))
    for x, y in zip(a.T, b.T, strict=True):
        total += x * y
    return total


def _fits(column: str, size: int | None = None) -> Column:
    """Whether a row's array is finite (and of ``size`` numbers) and its key known."""
    finite = F.forall(column, lambda x: x.isNotNull() & (F.abs(x) < 1e100)) & F.col("key").isNotNull()
    return F.coalesce(finite if size is None else finite & (F.size(column) == size), F.lit(False))


def even(rows: DataFrame, column: str) -> tuple[DataFrame, DataFrame | None, int, int]:
    """``rows`` whose array is of the most frequent length and finite, the others (None: there are none), the number of the first, and the length."""
    fits = _fits(column)
    sizes = rows.select(F.size(column).alias("size"), fits.alias("fits")).groupBy("size", "fits").count().collect()
    size, n = max(((r["size"], r["count"]) for r in sizes if r["fits"]), key=lambda x: (x[1], x[0]), default=(0, 0))
    same = _fits(column, size)
    odd = sum(r["count"] for r in sizes) > n
    return rows.where(same), rows.where(~same) if odd else None, n, size


def _stream(holders: DataFrame, askers: DataFrame, by: list[str], parts: int, held: Callable, meet: Callable, schema: pa.Schema, ddl: str) -> DataFrame:
    """Each group's holders become one object by ``held(table)``, which its askers meet batch by batch: ``meet(object, batch)``."""
    both = holders.withColumn("side", F.lit(0)).unionByName(askers.withColumn("side", F.lit(1)), allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kept, whole = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            marks = [batch.column(c).to_numpy(zero_copy_only=False) for c in (*by, "side")]
            change = np.logical_or.reduce([m[1:] != m[:-1] for m in marks])
            cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                group = tuple(m[a].item() for m in marks[:-1])
                if group != now:
                    now, kept, whole = group, [], None
                if marks[-1][a] == 0:
                    kept.append(batch.slice(a, b - a))
                elif kept:
                    if whole is None:
                        whole = held(pa.Table.from_batches(kept))
                    yield from (pa.RecordBatch.from_arrays([pa.array(c, f.type, from_pandas=True) for c, f in zip(out, schema, strict=True)], schema=schema) for out in meet(whole, batch.slice(a, b - a)))

    dealt = both.repartitionById(parts, F.col(by[0]).cast("int")) if len(by) == 1 else both.repartition(parts, *by)
    return dealt.sortWithinPartitions(*by, "side").mapInArrow(run, ddl)


# ---------------------------------------------------------------- searches


class Block:
    """Rows that answer, by key; of equal vectors of a key the two lowest ids, as a probe may be one of them."""

    def __init__(self, table: pa.Table):
        ids, keys, vec = table["id"].to_numpy(), table["key"].to_numpy(), matrix(table["vec"])
        staff = table["staff"].to_numpy().astype(bool) if "staff" in table.column_names else np.zeros(len(ids), bool)
        seen: dict[tuple, list[int]] = {}
        stay = []
        for i in np.argsort(ids, kind="stable").tolist():
            alike = seen.setdefault((keys[i], staff[i], vec[i].tobytes()), [])
            if len(alike) < 2 and ids[i] not in alike:
                alike.append(ids[i])
                stay.append(i)
        at = np.array(stay)[np.argsort(keys[stay], kind="stable")]
        self.ids, self.keys, self.vec, self.staff = ids[at], keys[at], vec[at], np.flatnonzero(staff[at])
        self.first = np.flatnonzero(np.concatenate(([True], self.keys[1:] != self.keys[:-1])))
        self.last = np.append(self.first[1:], len(at))
        self.named = self.keys[self.first]
        self.order = np.argsort(self.ids, kind="stable")
        self.sorted = self.ids[self.order]

    def best(self, ids: np.ndarray, keys: np.ndarray, vec: np.ndarray, apart: bool, most: int) -> list[np.ndarray]:
        """``probe, probe_key, key, cosine, id, own_staff`` of the ``most`` best keys of each probe."""
        score = vec @ self.vec.T
        low, high = (np.searchsorted(self.sorted, ids, side) for side in ("left", "right"))
        for i in np.flatnonzero(high > low).tolist():
            score[i, self.order[low[i] : high[i]]] = -np.inf
        if apart:
            own = np.minimum(np.searchsorted(self.named, keys), len(self.named) - 1)
            for i in np.flatnonzero(self.named[own] == keys).tolist():
                score[i, self.first[own[i]] : self.last[own[i]]] = -np.inf
        top = np.maximum.reduceat(score, self.first, axis=1)
        bar = np.partition(top, -most, axis=1)[:, -most] if top.shape[1] > most else np.full(len(ids), -np.inf)
        rows, columns = np.nonzero((top >= bar[:, None] - SLACK) & (top > -np.inf))
        found_i, found_j = [], []
        for i, k in zip(rows.tolist(), columns.tolist(), strict=True):
            a = self.first[k]
            j = np.flatnonzero(score[i, a : self.last[k]] >= top[i, k] - SLACK) + a
            found_i.append(np.full(len(j), i))
            found_j.append(j)
        i, j = (np.concatenate(x) if x else np.zeros(0, int) for x in (found_i, found_j))
        exact = in_order(vec[i], self.vec[j])
        order = np.lexsort((self.ids[j], -exact, self.keys[j], i))
        i, j, exact = i[order], j[order], exact[order]
        fresh = np.concatenate(([True], (i[1:] != i[:-1]) | (self.keys[j[1:]] != self.keys[j[:-1]]))) if len(i) else np.zeros(0, bool)
        i, j, exact = i[fresh], j[fresh], exact[fresh]
        order = np.lexsort((self.ids[j], -exact, i))
        i, j, exact = i[order], j[order], exact[order]
        start = np.searchsorted(i, i, "left")
        keep = np.arange(len(i)) - start < most
        i, j, exact = i[keep], j[keep], exact[keep]
        return [ids[i], keys[i], self.keys[j], exact, self.ids[j], self._staff(score, vec)[i]]

    def _staff(self, score: np.ndarray, vec: np.ndarray) -> np.ndarray:
        """The best cosine with staff; NaN where there is none."""
        out = np.full(len(vec), np.nan)
        if len(self.staff):
            own = score[:, self.staff]
            top = own.max(axis=1)
            i, j = np.nonzero((own >= top[:, None] - SLACK) & (top > -np.inf)[:, None])
            np.fmax.at(out, i, in_order(vec[i], self.vec[self.staff[j]]))
        return out


_TOPS = pa.schema([("probe", pa.int64()), ("probe_key", pa.int64()), ("key", pa.int64()), ("cosine", pa.float64()), ("id", pa.int64()), ("own_staff", pa.float64())])
_TOPS_DDL = "probe long, probe_key long, key long, cosine double, id long, own_staff double"


def search(asked: DataFrame, rows: DataFrame, parts: int, apart: bool = False, most: int = 2) -> DataFrame:
    """``_TOPS`` of ``asked(block, id, key, vec)`` among ``rows(block, id, key, vec[, staff])`` of their block, in ``parts`` tasks."""

    def meet(block: Block, batch: pa.RecordBatch) -> Iterator[list[np.ndarray]]:
        ids, keys, vec = batch.column("id").to_numpy(), batch.column("key").to_numpy(zero_copy_only=False), matrix(batch.column("vec"))
        step = max(1, HELD // len(block.ids))
        for a in range(0, len(ids), step):
            yield block.best(ids[a : a + step], keys[a : a + step], vec[a : a + step], apart, most)

    return _stream(rows, asked, ["block"], parts, Block, meet, _TOPS, _TOPS_DDL)


def _dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def best_by_key(probes: DataFrame, gallery: DataFrame, apart: bool = False, staff: bool = False) -> DataFrame:
    """``probe, probe_key, key, cosine, id, own_staff``: the best rows of the keys that may be a probe's best two.

    ``apart`` leaves the probe's own key out; ``own_staff`` is the best cosine with a row of staff.
    """
    asking = probes.select(F.col("id").cast("long").alias("id"), F.col("key").cast("long").alias("key"), "vec")
    rows = gallery.select(F.col("id").cast("long").alias("id"), F.col("key").cast("long").alias("key"), "vec", *(["staff"] if staff else []))
    if staff:
        rows = rows.withColumn("staff", F.coalesce("staff", F.lit(False)))
    asking, rows = asking.where("id IS NOT NULL"), rows.where("id IS NOT NULL")
    even_rows, odd_rows, n, size = even(rows, "vec")
    fits = _fits("vec", size)
    blocks = max(1, min(BLOCKS, n), -(-n // BLOCK_ROWS))
    numbered = even_rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("long"))
    every = asking.where(fits).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("block", F.col("block").cast("long"))
    met = search(every, numbered, blocks, apart)
    others = [(asking.where(~fits), rows)] + ([(asking.where(fits), odd_rows)] if odd_rows is not None else [])
    if not asking.where(~fits).limit(1).count():
        others = others[1:]
    for left, right in others:
        g = right.select(*[F.col(c).alias(f"g_{c}") for c in right.columns])
        on = (F.col("g_id") != F.col("id")) & ((F.col("g_key") != F.col("key")) if apart else F.lit(True))
        cosine = _dot("vec", "g_vec")
        own = F.when(F.col("g_staff"), F.col("cosine")) if staff else F.lit(None).cast("double")
        pairs = left.join(g, on).withColumn("cosine", cosine)
        met = met.unionByName(pairs.select(F.col("id").alias("probe"), F.col("key").alias("probe_key"), F.col("g_key").alias("key"), "cosine", F.col("g_id").alias("id"), own.alias("own_staff")))
    top = F.max(F.struct(F.col("cosine"), (-F.col("id")).alias("back"))).alias("top")
    best = met.groupBy("probe", "probe_key", "key").agg(top, F.max("own_staff").alias("own_staff"))
    return best.select("probe", "probe_key", "key", F.col("top.cosine").alias("cosine"), (-F.col("top.back")).alias("id"), "own_staff")


# ---------------------------------------------------------------- within keys


def _parts(rows: DataFrame) -> DataFrame:
    """``key, n, parts`` of the keys of ``rows``."""
    return rows.groupBy("key").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / PART_ROWS).cast("long"))


_CLOSEST = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("quality", pa.float64()), ("closest", pa.float64())])


def closest_rows(table: pa.Table, low: int, high: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``id, quality, closest`` of the rows of two parts of a key, each against the other part."""
    sides = []
    for part in (low, high):
        rows = table.filter(pa.array(table["part"].to_numpy() == part))
        sides.append((rows["id"].to_numpy(), rows["quality"].to_numpy(), matrix(rows["vec"]) if rows.num_rows else np.zeros((0, 0))))
    (ids, quality, a), (other_ids, other_quality, b) = sides
    if not len(ids) or not len(other_ids):
        return []
    closest, other = np.full(len(ids), -np.inf), np.full(len(other_ids), -np.inf)
    sorted_ids, order = np.sort(other_ids), np.argsort(other_ids, kind="stable")
    step = max(1, HELD // len(other_ids))
    for s in range(0, len(ids), step):
        score = a[s : s + step] @ b.T
        first, last = (np.searchsorted(sorted_ids, ids[s : s + step], side) for side in ("left", "right"))
        for i in np.flatnonzero(last > first).tolist():
            score[i, order[first[i] : last[i]]] = -np.inf
        rows = np.arange(len(score))
        j = score.argmax(axis=1)
        closest[s : s + step] = np.where(score[rows, j] > -np.inf, in_order(a[s : s + step], b[j]), -np.inf)
        if low != high:
            i = score.argmax(axis=0)
            other = np.maximum(other, np.where(score[i, np.arange(len(i))] > -np.inf, in_order(a[s : s + step][i], b), -np.inf))
    out = [(ids, quality, closest)] + ([(other_ids, other_quality, other)] if low != high else [])
    return [tuple(x[c > -np.inf] for x in (i, q, c)) for i, q, c in out]


def closest_siblings(templates: DataFrame) -> DataFrame:
    """``key, id, quality, closest``: each template's highest cosine with another of its key; those without a sibling aren't in it."""
    rows = templates.select(F.col("key").cast("long").alias("key"), F.col("id").cast("long").alias("id"), F.col("quality").cast("double").alias("quality"), "vec")
    rows = rows.where("id IS NOT NULL AND key IS NOT NULL")
    good, odd, _, _ = even(rows, "vec")
    counts = _parts(rows)
    many = good.join(counts.where(F.col("n") > FEW), "key")
    many = many.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    dealt = many.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    dealt = dealt.select("key", "id", "quality", "vec", "part", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"))

    def meet(group: tuple, table: pa.Table) -> pa.Table:
        found = closest_rows(table, group[1].as_py(), group[2].as_py())
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [[]] * 3
        key = pa.array([group[0].as_py()] * len(columns[0]), pa.int64())
        return pa.Table.from_arrays([key, *[pa.array(c, f.type, from_pandas=True) for c, f in zip(columns, list(_CLOSEST)[1:], strict=True)]], schema=_CLOSEST)

    met = dealt.groupBy("key", "low", "high").applyInArrow(meet, "key long, id long, quality double, closest double")
    few = rows.join(counts.where(F.col("n") <= FEW), "key").select(*rows.columns)
    joined = [(few, few)]
    if odd is not None:
        big_odd, big = odd.join(counts.where(F.col("n") > FEW), "key").select(*rows.columns), rows.join(counts.where(F.col("n") > FEW), "key").select(*rows.columns)
        joined += [(big_odd, big), (big, big_odd)]
    for a, b in joined:
        b = b.select("key", F.col("id").alias("b_id"), F.col("vec").alias("b_vec"))
        pairs = a.join(b, "key").where("id <> b_id")
        met = met.unionByName(pairs.select("key", "id", "quality", _dot("vec", "b_vec").alias("closest")))
    return met.groupBy("key", "id", "quality").agg(F.max("closest").alias("closest"))


_LIKE = pa.schema([("probe", pa.int64()), ("likeness", pa.float64())])


def likeness(best: DataFrame, probes: DataFrame, gallery: DataFrame) -> DataFrame:
    """``probe, likeness``: the best clothing overlap of each probe with the other rows of its ``best(probe, key)``; none where a side has none."""
    asking = best.select("probe", "key").join(probes.where("appearance IS NOT NULL").select(F.col("id").cast("long").alias("probe"), F.col("appearance").alias("look")), "probe")
    # Descriptors are costly to derive, and are read several times.
    asking = cut(asking.select(F.col("probe").alias("id"), "key", "look"))
    rows = gallery.where("appearance IS NOT NULL").select(F.col("id").cast("long").alias("id"), F.col("key").cast("long").alias("key"), F.col("appearance").alias("look"))
    rows = cut(rows.where("id IS NOT NULL"))
    good, odd, _, size = even(rows, "look")
    fits = _fits("look", size)
    counts = _parts(good).select("key", "parts")
    held = good.join(counts, "key").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))).drop("parts")
    asked = asking.where(fits).join(counts, "key").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")

    def hold(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return table["id"].to_numpy(), np.ascontiguousarray(matrix(table["look"]).T)

    def meet(held: tuple[np.ndarray, np.ndarray], batch: pa.RecordBatch) -> Iterator[list]:
        own, columns = held
        ids, most = batch.column("id").to_numpy(), []
        for i, look in zip(ids.tolist(), matrix(batch.column("look")).tolist(), strict=True):
            total = np.zeros(len(own))
            for x, y in zip(look, columns, strict=True):
                total += np.minimum(x, y)
            total = total[own != i]
            most.append(float(total.max()) if len(total) else None)
        yield [ids, most]

    met = _stream(held, asked, ["key", "part"], BLOCKS, hold, meet, _LIKE, "probe long, likeness double").where("likeness IS NOT NULL")
    others = [(asking.where(fits), odd)] if odd is not None else []
    if asking.where(~fits).limit(1).count():
        others.append((asking.where(~fits), rows))
    for left, right in others:
        g = right.select("key", F.col("id").alias("g_id"), F.col("look").alias("g_look"))
        like = F.aggregate(F.zip_with("look", "g_look", lambda x, y: F.least(x, y)), F.lit(0.0), lambda s, v: s + v)
        met = met.unionByName(left.join(g, "key").where("id <> g_id").select(F.col("id").alias("probe"), like.alias("likeness")))
    return met.groupBy("probe").agg(F.max("likeness").alias("likeness"))


_OVERLAPS = pa.schema([("id_a", pa.int64()), ("id_b", pa.int64()), ("likeness", pa.float64())])


def six_digits(x: np.ndarray) -> np.ndarray:
    """Rounded as SQL rounds to six digits: half away from zero of the decimal that a number is written as."""
    scaled = x * 1e6
    whole = np.floor(scaled)
    out = (whole + (scaled - whole >= 0.5)) / 1e6
    near = (np.abs(scaled - whole - 0.5) < 1e-6 + np.abs(scaled) * 1e-15) | (np.abs(scaled) > 1e14)
    for i in np.flatnonzero(near).tolist():
        out.flat[i] = float(Decimal(repr(float(x.flat[i]))).quantize(Decimal("1e-6"), ROUND_HALF_UP)) + 0.0
    return out


def overlaps(ids: np.ndarray, looks: np.ndarray, other_ids: np.ndarray, columns: np.ndarray, own: bool) -> Iterator[list[np.ndarray]]:
    """``id_a, id_b, likeness`` of each row with each other row, a tile at a time; ``columns`` are the others' looks, number by number, by rising id.

    ``own``: both are of one part, where a pair is taken from the side of its smaller id.
    """
    first = np.searchsorted(other_ids, ids, "right") if own else np.zeros(len(ids), int)
    order = np.argsort(first, kind="stable")
    step = max(1, TILE // len(other_ids))
    for s in range(0, len(ids), step):
        rows = order[s : s + step]
        for c in range(int(first[rows[0]]), len(other_ids), TILE):
            named, some = other_ids[c : c + TILE], columns[:, c : c + TILE]
            total = np.zeros((len(rows), len(named)))
            least = np.empty_like(total)
            for x, y in zip(looks[rows].T, some, strict=True):
                least[:] = x[:, None]  # rows of numbers meet rows of numbers far faster than one number does
                total += np.minimum(least, y, out=least)
            a, b = np.broadcast_to(ids[rows][:, None], total.shape), np.broadcast_to(named, total.shape)
            met = named > ids[rows][:, None] if own else np.ones(total.shape, bool)
            yield [np.minimum(a, b)[met], np.maximum(a, b)[met], six_digits(total[met])]


def look_pairs(templates: DataFrame) -> DataFrame:
    """``id_a, id_b, likeness``: the clothing overlap of each two templates of a key, smaller id first; those whose lengths differ are an error.

    A task meets two parts of a key at a time, so what it holds and how long it takes don't grow with a key.
    """
    rows = templates.where("appearance IS NOT NULL").select(F.col("id").cast("long").alias("id"), F.col("key").cast("long").alias("key"), F.col("appearance").alias("look"))
    rows = rows.where("id IS NOT NULL AND key IS NOT NULL")
    good, odd, _, _ = even(rows, "look")
    counts = rows.groupBy("key").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / LOOK_ROWS).cast("long"))
    many, few = F.col("n") > FEW, (F.col("n") > 1) & (F.col("n") <= FEW)
    pairs, small = counts.agg(F.sum(F.when(many, F.col("n") * F.col("n") / 2)), F.max(few)).first()
    held = good.join(counts.where(many), "key").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    with_other = held.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    dealt = with_other.select("key", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "id", "look")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        part, low, high = (table[c].to_numpy() for c in ("part", "low", "high"))
        some, others = (table.filter(pa.array(part == side)) for side in (low, high))
        if some.num_rows and others.num_rows:
            others = others.sort_by("id")
            columns = np.ascontiguousarray(matrix(others["look"]).T)
            for out in overlaps(some["id"].to_numpy(), matrix(some["look"]), others["id"].to_numpy(), columns, bool(low[0] == high[0])):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], schema=_OVERLAPS)

    by = ["key", "low", "high"]
    tasks = max(BLOCKS, int((pairs or 0) // TASK_PAIRS))
    met = dealt.repartition(tasks, *by).groupBy(*by).applyInArrow(meet, "id_a long, id_b long, likeness double")
    joined = [(few_rows := rows.join(counts.where(few), "key").select(*rows.columns), few_rows)] if small else []
    if odd is not None:
        big, big_odd, big_good = (r.join(counts.where(many), "key").select(*rows.columns) for r in (rows, odd, good))
        joined += [(big_odd, big), (big_good, big_odd)]
    like = F.aggregate(F.zip_with("look", "other_look", lambda x, y: F.least(x, y)), F.lit(0.0), lambda s, v: s + v)
    checked = F.when(F.size("look") == F.size("other_look"), F.round(like, 6)).otherwise(F.raise_error(F.lit("histograms differ in length")))
    for a, b in joined:
        b = b.select("key", F.col("id").alias("other_id"), F.col("look").alias("other_look"))
        met = met.unionByName(a.join(b, "key").where("id < other_id").select(F.col("id").alias("id_a"), F.col("other_id").alias("id_b"), checked.alias("likeness")))
    return met
