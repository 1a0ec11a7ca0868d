"""The ``opN_`` queries: each applies its operator to the whole of its tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstile.llm import decontam, filter_audit, importance, licenses, lm_scoring, mixing, packing, quality, sentence_dedup, sharding, simhash, suffix_dedup, toxicity
from turnstile.llm.common import shared_path

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longer documents get a little more of their source's inclusion odds."""
    mixed = mixing.mix(_table(spark, sf_dir, "documents"), tilt=F.log2(F.col("size") + 2), columns=["doc_id"])
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return mixed.select("doc_id", "size", "source_size", "target", taken, "copies")


def vocabulary_path() -> str:
    """The public vocabulary whose scores start the model; a parameter of the operator."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op2_lattice_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_texts(_table(spark, sf_dir, "documents"), vocabulary_path())


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    hits = decontam.find_windows(docs, _table(spark, sf_dir, "benchmark"))
    return hits.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.dedup_bytes(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.find_licenses(_table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_sentence_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sentence_dedup.dedup_sentences(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_sentences", "n_removed", "n_bytes", "n_removed_bytes", "kept_sha256")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.cascade(docs, measure=True).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = sharding.shard_records(_table(spark, sf_dir, "documents"))
    written = sharding.write_shards(records, shared_path(spark, "shards"))
    return written.select(
        "doc_id",
        "size",
        F.crc32(F.coalesce(F.col("text").cast("binary"), F.lit(b""))).alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        "grown_shard",
    )


def op11_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op12_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def queries() -> dict[str, Query]:
    return {
        f.__name__: f
        for f in (
            op1_mix_sources,
            op2_lattice_scores,
            op3_simhash,
            op4_decontaminate,
            op5_suffix_dedup,
            op6_licenses,
            op7_toxicity,
            op8_sentence_dedup,
            op9_quality,
            op10_shards,
            op11_pack_sequences,
            op12_importance_resample,
            op13_filter_audit,
        )
    }


OP4_SQL = r"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
item AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS g
  FROM item, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS t(i) WHERE len(w) > 0),
width AS (SELECT DISTINCT n FROM win),
gram AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM doc, width, unnest(range(1, len(w) - n + 2)) AS t(i)),
hit AS (SELECT DISTINCT r, i, gram.n, item_id FROM gram JOIN win ON gram.n = win.n AND gram.g = win.g),
word AS (SELECT r, count(DISTINCT j) AS n_hit FROM hit, unnest(range(i, i + n)) AS t(j) GROUP BY r),
own AS (
  SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
  FROM (SELECT DISTINCT r, item_id FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN word USING (r) LEFT JOIN own USING (r)
"""

OP9_SQL = r"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
gram AS (SELECT r, i, array_to_string(w[i:i + 4], ' ') AS g FROM doc, unnest(range(1, len(w) - 3)) AS t(i)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM gram) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT j) AS n FROM twice, unnest(range(i, i + 5)) AS t(j) GROUP BY r),
line AS (
  SELECT r, x FROM (SELECT r, unnest(string_split(text, chr(10))) AS x FROM doc)
  WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
dup AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n FROM line GROUP BY r),
base AS (
  SELECT doc_id, w, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines,
         CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
         len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS n_alpha,
         len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_stutter
  FROM doc LEFT JOIN rep USING (r) LEFT JOIN dup USING (r)),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR 2 * n_dup_lines > n_lines
            OR word_chars < 2 * n_words OR word_chars > 15 * n_words
            OR 2 * n_alpha < n_words OR 10 * n_stutter > 3 * n_words) AS kept
FROM judged
"""


def _op6_sql() -> str:
    """Every window against every template, without markers or bands."""
    quoted = ", ".join(
        f"('{name}', {licenses.stride_of(text)}, {len(licenses.template_shingles(text))}, '{g}')"
        for name, text in licenses.TEMPLATES.items()
        for g in licenses.template_shingles(text)
    )
    lengths = ", ".join(f"({n})" for n in sorted({min(licenses.SHINGLE, len(licenses.template_words(t))) for t in licenses.TEMPLATES.values()}))
    return rf"""
WITH tpl(license, stride, n_shingles, g) AS (VALUES {quoted}),
doc AS (
  SELECT DISTINCT doc_id, text,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z]+') AS w
  FROM documents WHERE text IS NOT NULL),
shingle AS (
  SELECT doc_id, text, i - 1 AS pos, array_to_string(w[i:i + n - 1], ' ') AS g, n < 5 AS short
  FROM doc, (VALUES {lengths}) AS k(n), unnest(range(1, len(w) - n + 2)) AS t(i)),
hit AS (
  SELECT doc_id, text, license, n_shingles, shingle.g,
         unnest(CASE WHEN stride = 0 THEN [pos] ELSE [pos // stride - 1, pos // stride] END) AS win
  FROM shingle JOIN tpl ON shingle.g = tpl.g AND short = (stride = 0)),
own AS (
  SELECT doc_id, text, license, n_shingles, win, count(DISTINCT g) AS n_shared
  FROM hit GROUP BY doc_id, text, license, n_shingles, win)
SELECT doc_id, license, CAST(max(n_shared) AS BIGINT) AS n_shared, max(n_shared) / max(n_shingles) AS containment
FROM own WHERE n_shared >= {licenses.LEAST} * n_shingles GROUP BY doc_id, text, license
"""


OP8_SQL = r"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
piece AS (
  SELECT r, doc_id, text, generate_subscripts(p, 1) AS k, unnest(p) AS x
  FROM (SELECT r, doc_id, text,
               string_split(regexp_replace(regexp_replace(text, chr(10), chr(10) || chr(1), 'g'),
                                           '([.!?]+)([\x20\x09-\x0D])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS p FROM doc)),
tok AS (
  SELECT *, regexp_extract_all(x, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+') AS t, regexp_extract(x, '[\x20\x09-\x0D]*$') AS tail,
         list_transform(regexp_extract_all(x, '[^\x20\x09-\x0D]+'), lambda v: translate(v, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w
  FROM piece),
cut AS (
  SELECT *, list_sort(list_distinct(list_prepend(1, CASE WHEN len(w) > 12 THEN
    list_transform(range(1, len(w) - 4), lambda s: s - 1 + list_position(w[s:s + 5], list_min(w[s:s + 5]))) ELSE [] END))) AS c FROM tok),
norm AS (
  SELECT r, doc_id, text, k * 1000000 + q AS k,
         CASE WHEN len(w) = 0 THEN '' ELSE array_to_string(t[c[q]:coalesce(c[q + 1] - 1, len(t))], '') END AS x,
         CASE WHEN len(w) = 0 THEN '' ELSE regexp_extract(t[c[q]], '^[\x20\x09-\x0D]*') END AS lead_ws,
         CASE WHEN len(w) = 0 THEN x WHEN q = len(c) THEN tail ELSE '' END AS tail_ws,
         w[c[q]:coalesce(c[q + 1] - 1, len(w))] AS v
  FROM cut, unnest(range(1, len(c) + 1)) AS u(q)),
sent AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY k) AS i FROM norm WHERE len(v) > 0),
doc_sent AS (
  SELECT r, any_value(doc_id) AS doc_id, list(array_to_string(v, ' ') ORDER BY i) AS s, list_prepend(0, list(n ORDER BY i)) AS n
  FROM (SELECT *, sum(len(v)) OVER (PARTITION BY r ORDER BY i) AS n FROM sent) GROUP BY r),
ends AS (
  SELECT r, doc_id, s, i, list_filter(range(i + 2, least(i + 15, len(s)) + 1), lambda j: n[j + 1] - n[i] >= 15)[1] AS e
  FROM doc_sent, unnest(range(1, len(s) + 1)) AS u(i)),
span AS (SELECT r, doc_id, i, e, array_to_string(s[i:e], chr(10)) AS g FROM ends WHERE e IS NOT NULL),
later AS (
  SELECT r, i, e FROM (
    SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS LAST, r, i) AS place FROM span)
  WHERE place > 1),
gone AS (SELECT DISTINCT r, j FROM later, unnest(range(i, e + 1)) AS t(j)),
kept AS (
  SELECT norm.r, count(sent.i) AS n_sentences, count(gone.j) AS n_removed,
         coalesce(string_agg(CASE WHEN gone.j IS NULL THEN norm.x ELSE norm.lead_ws END || norm.tail_ws, '' ORDER BY norm.k), '') AS left_text
  FROM norm LEFT JOIN sent ON norm.r = sent.r AND norm.k = sent.k LEFT JOIN gone ON gone.r = sent.r AND gone.j = sent.i
  GROUP BY norm.r)
SELECT doc_id, CAST(n_sentences AS BIGINT) AS n_sentences, CAST(n_removed AS BIGINT) AS n_removed,
       CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes,
       CAST(octet_length(encode(text)) - octet_length(encode(left_text)) AS BIGINT) AS n_removed_bytes,
       sha256(left_text) AS kept_sha256
FROM doc JOIN kept USING (r)
"""


#: CRC-32 by a table of 256 entries made from its polynomial, byte by byte over distinct n-grams.
OP12_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT i, i AS c, 0 AS k FROM range(256) AS t(i)
  UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
tbl AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
doc AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
item AS (
  SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
feature AS (
  SELECT r, array_to_string(w[i:i + n - 1], ' ') AS g FROM doc, (VALUES (1), (2), (3)) AS k(n), unnest(range(1, len(w) - n + 2)) AS t(i)
  UNION ALL
  SELECT -1 AS r, array_to_string(w[i:i + n - 1], ' ') AS g FROM item, (VALUES (1), (2), (3)) AS k(n), unnest(range(1, len(w) - n + 2)) AS t(i)),
gram AS (
  SELECT g, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, octet_length(encode(g)) + 1), lambda j: CAST('0x' || hex(encode(g))[2 * j - 1:2 * j] AS BIGINT))),
                lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT g FROM feature), tbl),
hashed AS (SELECT r, bucket, count(*) AS n FROM feature JOIN gram USING (g) GROUP BY r, bucket),
sums AS (SELECT bucket, sum(CASE WHEN r >= 0 THEN n ELSE 0 END) AS s, sum(CASE WHEN r < 0 THEN n ELSE 0 END) AS t FROM hashed GROUP BY bucket),
alls AS (SELECT sum(s) AS big_s, sum(t) AS big_t FROM sums),
gain AS (SELECT bucket, CAST(floor(1000 * ln(CAST((t + 1) * (big_s + 10000) AS DOUBLE) / CAST((s + 1) * (big_t + 10000) AS DOUBLE))) AS BIGINT) AS gain FROM sums, alls),
weighed AS (SELECT r, sum(n) AS n_features, sum(n * gain) AS weight FROM hashed JOIN gain USING (bucket) WHERE r >= 0 GROUP BY r),
scored AS (
  SELECT r, doc_id, len(w) AS n_words, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
         CAST(coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS BIGINT) AS score
  FROM doc LEFT JOIN weighed USING (r)),
placed AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, r) AS place, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 5 * n // 100 THEN place END AS rank FROM scored LEFT JOIN placed USING (r)
"""

#: Every order is applied to every document.
OP13_SQL = r"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
first AS (SELECT text, min(doc_id) AS first_id FROM doc GROUP BY text),
label AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
failed AS (
  SELECT r, part, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic,
         map {'A': len(w) < 200, 'B': 100 * len(list_distinct(w)) < 50 * len(w),
              'C': 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 3 * length(text),
              'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(first_id < doc.doc_id, false)} AS f
  FROM doc JOIN first USING (text) LEFT JOIN label ON label.doc_id = doc.doc_id),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letter AS a, letter AS b, letter AS c, letter AS d, letter AS e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
step AS (SELECT filter_order, step, filter_order[step] AS x, filter_order[1:step - 1] AS earlier FROM orders, range(1, 6) AS t(step)),
seen AS (
  SELECT part, filter_order, step, x, good, toxic, f[x] AS fails,
         (SELECT count(*) FROM unnest(['A', 'B', 'C', 'D', 'E']) AS q(y) WHERE f[y]) AS n_fails,
         len(list_filter(string_split(earlier, ''), lambda y: coalesce(f[y], false))) > 0 AS gone
  FROM (SELECT part, f, good, toxic FROM failed), step),
counted AS (
  SELECT part, filter_order, step, x, count(*) FILTER (WHERE NOT gone AND NOT fails) AS kept, count(*) FILTER (WHERE NOT gone AND fails) AS removed,
         count(*) FILTER (WHERE gone AND fails) AS redundant, count(*) FILTER (WHERE fails AND n_fails = 1) AS unique_fails,
         count(*) FILTER (WHERE NOT gone AND fails AND good) AS good_lost, count(*) FILTER (WHERE NOT gone AND fails AND toxic) AS toxic_lost
  FROM seen GROUP BY part, filter_order, step, x)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM counted
"""


def oracle_sql() -> dict[str, str]:
    return {"op12_importance_resample": OP12_SQL, "op13_filter_audit": OP13_SQL, "op4_decontaminate": OP4_SQL, "op6_licenses": _op6_sql(), "op8_sentence_dedup": OP8_SQL, "op9_quality": OP9_SQL}
