"""Merges of identities, many at once: directed components by pointer jumping.

A merge points from the key that goes to the key that keeps. Pointers are jumped
over (each round doubles how far they reach), so a chain of any length ends at its
last keeper after a logarithm of rounds of joins, and no merge is applied one by one.

What contradicts is refused by rules that don't depend on the order of rows: of two
keepers of one key the smaller holds; of a ring the smallest key doesn't go; and of
two keys that must stay apart but would end at one keeper, the larger one that was
to go stays, with all that was merged into it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnstile.operators.folds import DIGITS, prune_groups
from turnstile.plans.dialect import DUCKDB
from turnstile.plans.registry import cut, frames
from turnstile.settings import FIXTURE, Settings
from turnstile.sources import bindings


def roots(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of ``edges(gone, keep)``, one a key: ``(gone, root)`` of those that end, and the ``gone`` of the smallest key of each ring."""
    known = edges.select(F.col("gone").alias("up"), F.lit(True).alias("open"))
    jumps = edges.select("gone", F.col("keep").alias("up"), F.col("gone").alias("low")).join(known, "up", "left")
    jumps = cut(jumps.select("gone", "up", "low", F.coalesce("open", F.lit(False)).alias("open")))
    reach, size = 1, jumps.count()
    while reach <= size and jumps.where("open").limit(1).count():
        far = jumps.select(F.col("gone").alias("up"), F.col("up").alias("next"), F.col("low").alias("next_low"), F.col("open").alias("next_open"))
        jumped = jumps.join(far, "up", "left")
        jumps = cut(
            jumped.select(
                "gone", F.coalesce("next", "up").alias("up"), F.least("low", F.coalesce("next_low", "low")).alias("low"), F.coalesce("next_open", F.lit(False)).alias("open")
            )
        )
        reach *= 2
    # After so many steps a pointer that still goes on stands on a ring, and every key of a ring is stood on.
    going = jumps.where("open")
    stood = going.select(F.col("up").alias("gone")).distinct()
    ring = going.join(stood, "gone", "left_semi").where("gone = low").select("gone")
    return jumps.where("NOT open").select("gone", F.col("up").alias("root")), ring


def resolve(templates: DataFrame, merges: DataFrame, cannot_link: DataFrame) -> DataFrame:
    """Each asked merge ``keep, gone`` with ``root``, where its key ends, or the ``reason`` it was refused."""
    held = cut(templates.groupBy("key").agg(F.count("*").alias("n")))
    apart = cut(cannot_link.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    asked = merges.groupBy("keep", "gone").agg(F.max("only_singleton").alias("only_singleton"))
    asked = asked.join(held.select(F.col("key").alias("keep"), F.col("n").alias("n_keep")), "keep", "left")
    asked = asked.join(held.select(F.col("key").alias("gone"), F.col("n").alias("n_gone")), "gone", "left")
    pair = [F.least("keep", "gone").alias("a"), F.greatest("keep", "gone").alias("b")]
    asked = asked.select("*", *pair).join(apart.withColumn("apart", F.lit(True)), ["a", "b"], "left")
    reason = (
        F.when(F.col("keep") == F.col("gone"), "same-key")
        .when(F.col("n_keep").isNull() | F.col("n_gone").isNull(), "unknown-key")
        .when(F.col("apart"), "cannot-link")
        .when(F.col("only_singleton") & (F.col("n_gone") != 1), "not-singleton")
    )
    place = F.row_number().over(W.partitionBy("gone", F.col("reason").isNull()).orderBy("keep"))
    judged = asked.select("keep", "gone", reason.alias("reason")).withColumn("reason", F.when(F.col("reason").isNotNull(), F.col("reason")).when(place > 1, "two-keepers"))
    judged = cut(judged)
    edges = judged.where("reason IS NULL").select("gone", "keep")
    ends, ring = roots(edges)
    ring = cut(ring)
    refused = ring.withColumn("why", F.lit("ring"))
    if ring.limit(1).count():
        edges = cut(edges.join(ring, "gone", "left_anti"))
        ends, _ = roots(edges)
    while True:
        at = {side: ends.select(F.col("gone").alias(side), F.col("root").alias(f"root_{side}")) for side in "ab"}
        met = apart.join(at["a"], "a", "left").join(at["b"], "b", "left")
        met = met.where(F.coalesce("root_a", "a") == F.coalesce("root_b", "b"))
        stays = cut(met.select(F.when(F.col("root_b").isNotNull(), F.col("b")).otherwise(F.col("a")).alias("gone")).distinct())
        if not stays.limit(1).count():
            break
        refused = refused.unionByName(stays.withColumn("why", F.lit("cannot-link")))
        edges = cut(edges.join(stays, "gone", "left_anti"))
        ends, _ = roots(edges)
    out = judged.join(ends, "gone", "left").join(refused, "gone", "left")
    own = F.when(F.col("reason").isNull(), F.col("why")).otherwise(F.col("reason"))
    return out.select("keep", "gone", own.alias("reason"), F.when(own.isNull(), F.col("root")).alias("root"))


def merged_templates(k: Settings, templates: DataFrame, merges: DataFrame, cannot_link: DataFrame) -> DataFrame:
    """``id, key`` after the merges that hold; keys that took others in are pruned to the cap, the most redundant first."""
    settled = cut(resolve(templates, merges, cannot_link).where("reason IS NULL").select(F.col("gone").alias("key"), "root"))
    moved = templates.join(settled, "key", "left")
    keys = settled.select(F.col("root").alias("new_key")).distinct().withColumn("grown", F.lit(True))
    rows = moved.withColumn("new_key", F.coalesce("root", "key")).join(keys, "new_key", "left").drop("key", "root").withColumnRenamed("new_key", "key")
    if k.template_cap <= 1:
        return rows.select("id", "key")
    grown = prune_groups(rows.where("grown"), k).select("id", "key")
    return rows.where("grown IS NULL").select("id", "key").unionByName(grown)


# ---------------------------------------------------------------- oracles


def _resolved_sql() -> str:
    """CTEs up to ``settled(keep, gone, reason, root)``; refusals one round at a time, pointers one hop at a time."""
    d = DUCKDB
    root = "list_reduce(list_prepend({x}, hops), lambda z, q: coalesce(up[z], z))"
    met = f"list_filter(pairs, lambda p: {root.format(x='p.a')} = {root.format(x='p.b')})"
    return f"""RECURSIVE held AS (SELECT key, count(*) AS n FROM {bindings.templates(d)} AS t GROUP BY key),
    apart AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM {bindings.cannot_link(d)} AS c WHERE a <> b),
    asked AS (SELECT keep, gone, bool_or(only_singleton) AS only_singleton FROM {bindings.merges(d)} AS m GROUP BY keep, gone),
    judged AS (SELECT keep, gone, CASE WHEN keep = gone THEN 'same-key' WHEN k.key IS NULL OR g.key IS NULL THEN 'unknown-key' WHEN apart.a IS NOT NULL THEN 'cannot-link'
        WHEN only_singleton AND g.n <> 1 THEN 'not-singleton' END AS reason
      FROM asked LEFT JOIN held AS k ON k.key = keep LEFT JOIN held AS g ON g.key = gone LEFT JOIN apart ON apart.a = least(keep, gone) AND apart.b = greatest(keep, gone)),
    edge AS (SELECT gone, min(keep) AS keep FROM judged WHERE reason IS NULL GROUP BY gone),
    reach(x, y) AS (SELECT gone, keep FROM edge UNION SELECT reach.x, edge.keep FROM reach JOIN edge ON edge.gone = reach.y),
    ring AS (SELECT min(r.y) AS gone FROM reach AS r JOIN reach AS b ON b.x = r.y AND b.y = r.x WHERE EXISTS (SELECT 1 FROM reach AS o WHERE o.x = r.x AND o.y = r.x) GROUP BY r.x),
    open_edge AS (SELECT * FROM edge WHERE gone NOT IN (SELECT gone FROM ring)),
    hop AS (SELECT list(gone) AS hops, map_from_entries(list(struct_pack(k := gone, v := keep))) AS up FROM open_edge),
    pair AS (SELECT list(struct_pack(a := a, b := b)) AS pairs FROM apart),
    round AS (
      SELECT 0 AS i, up, []::BIGINT[] AS stays FROM hop
      UNION ALL
      SELECT i + 1, map_from_entries(list_filter(map_entries(up), lambda e: NOT list_contains(bad, e.key))), list_concat(stays, bad) FROM (
        SELECT i, up, stays, list_distinct(list_transform({met}, lambda p: CASE WHEN up[p.b] IS NOT NULL THEN p.b ELSE p.a END)) AS bad
        FROM (SELECT i, round.up AS up, stays, pairs, hops FROM round, pair, hop) AS r0) AS r WHERE len(bad) > 0),
    final AS (SELECT up, stays, hops FROM round, (SELECT hops FROM hop) AS h ORDER BY i DESC LIMIT 1),
    settled AS (SELECT keep, gone, why AS reason, CASE WHEN why IS NULL THEN {root.format(x='gone')} END AS root FROM (
      SELECT judged.keep, judged.gone, up, hops, CASE WHEN reason IS NOT NULL THEN reason WHEN judged.keep <> edge.keep THEN 'two-keepers'
        WHEN judged.gone IN (SELECT gone FROM ring) THEN 'ring' WHEN list_contains(stays, judged.gone) THEN 'cannot-link' END AS why
      FROM judged LEFT JOIN edge ON edge.gone = judged.gone, final) AS s0)"""


def _merge_apply_sql() -> str:
    cap, d = FIXTURE.template_cap, DUCKDB
    near = f"list_max(list_transform(list_filter(rows, lambda q: q.id <> r.id), lambda q: round({d.dot('q.vec', 'r.vec')}, {DIGITS})))"
    return f"""WITH {_resolved_sql()},
    moved AS (SELECT coalesce(root, t.key) AS key, id, vec, quality FROM {bindings.templates(d)} AS t LEFT JOIN (SELECT gone, root FROM settled WHERE reason IS NULL) AS s ON s.gone = t.key),
    step AS (
      SELECT key, list(struct_pack(id := id, vec := vec, quality := quality)) AS rows FROM moved WHERE key IN (SELECT root FROM settled) GROUP BY key
      UNION ALL
      SELECT key, list_filter(rows, lambda r: r.id <> goes) AS rows FROM (SELECT key, rows,
          -list_sort(list_transform(rows, lambda r: struct_pack(near := -{near}, quality := coalesce(r.quality, '-inf'::DOUBLE), id := -r.id)))[1].id AS goes
        FROM step WHERE len(rows) > {cap}) AS s)
    SELECT id, key FROM moved WHERE key NOT IN (SELECT root FROM settled WHERE root IS NOT NULL)
    UNION ALL SELECT u.id, key FROM (SELECT key, unnest(rows) AS u FROM step WHERE len(rows) <= {cap}) AS o"""


def _cannot_link_norm_sql() -> str:
    return f"""WITH {_resolved_sql()}, live AS (SELECT gone, root FROM settled WHERE reason IS NULL)
    SELECT DISTINCT least(x, y) AS a, greatest(x, y) AS b FROM (SELECT coalesce(p.root, a) AS x, coalesce(q.root, b) AS y
      FROM apart LEFT JOIN live AS p ON p.gone = a LEFT JOIN live AS q ON q.gone = b) AS m"""


@frames("templates", "merges", "cannot_link", oracle=_merge_apply_sql)
def merge_apply(k: Settings, templates: DataFrame, merges: DataFrame, cannot_link: DataFrame) -> DataFrame:
    """Templates after all merges asked for: chains end at their last keeper, and a keeper holds at most the cap."""
    return merged_templates(k, templates, merges, cannot_link)


@frames("templates", "merges", "cannot_link", oracle=lambda: f"WITH {_resolved_sql()} SELECT keep, gone, reason FROM settled WHERE reason IS NOT NULL")
def merge_refused(k: Settings, templates: DataFrame, merges: DataFrame, cannot_link: DataFrame) -> DataFrame:
    """Merges refused, with the reason."""
    return resolve(templates, merges, cannot_link).where("reason IS NOT NULL").select("keep", "gone", "reason")


@frames("templates", "merges", "cannot_link", oracle=_cannot_link_norm_sql)
def cannot_link_norm(k: Settings, templates: DataFrame, merges: DataFrame, cannot_link: DataFrame) -> DataFrame:
    """Constraints after the merges: carried to where both keys ended, smaller first, once each."""
    live = cut(resolve(templates, merges, cannot_link).where("reason IS NULL").select("gone", "root"))
    at = {side: live.select(F.col("gone").alias(side), F.col("root").alias(f"root_{side}")) for side in "ab"}
    pairs = cannot_link.where("a <> b").join(at["a"], "a", "left").join(at["b"], "b", "left")
    pairs = pairs.select(F.coalesce("root_a", "a").alias("x"), F.coalesce("root_b", "b").alias("y"))
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
