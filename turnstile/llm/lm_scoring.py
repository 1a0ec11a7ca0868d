"""Language-model scoring by subword lattice likelihood.

The model is a unigram model over the pieces of an existing vocabulary. A text
is its lower-cased words and one end; a word may be cut into pieces in any way,
and its probability is the sum over all of them, by a forward recursion in log
space (:mod:`turnstile.llm.lattice`). Pieces never cross words, so a text's log
probability is the sum of its words' and the end's.

The scores of a unigram vocabulary are taken as they are; the corpus only says how
likely the end is. A vocabulary whose scores are ranks has no probabilities: Zipf's
law stands in for them, and ``rounds`` steps of expectation maximisation over the
training words fit them to the corpus, the end being one of the pieces.

Every distinct word is scored once. Words are counted where the texts are, then
summed by word. A word with at least 1 / ``FREQUENT`` of all tokens is frequent;
there can be no more than ``FREQUENT`` of them, whatever the corpus, so they are
sent to all executors and settled in place. All other tokens meet their word in
a join in which no key has more than 1 / ``FREQUENT`` of the tokens.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstile.llm.common import Sink, bound_batches, materialize, rows_of, utf8
from turnstile.llm.lattice import Lattice

#: At most so many words are sent to the executors.
FREQUENT = 1 << 17
#: Distinct words that one task holds before it hands its counts on.
HELD = 250_000
#: The word mark of the vocabulary; a blank stands for it, as no word holds one.
MARK = "▁"
_LN10 = float(np.log(10))


def load_pieces(model_file: str) -> tuple[list[bytes], np.ndarray, bool]:
    """Pieces of a sentencepiece model as bytes, their log scores, and whether they had to be made from ranks.

    Scores of a unigram model are taken as they are. Those of a model that ranks
    its pieces (0, -1, -2, ...) become log probabilities by Zipf's law, pieces that
    differ in case becoming one. Every single byte is a piece, by the model's own
    byte pieces or else with the lowest score. Pieces with a mark inside would
    cross words and go.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    own: list[tuple[str, float]] = []
    spelt: dict[bytes, float] = {}
    for i in range(model.vocab_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            spelt[bytes([int(piece[3:5], 16)])] = model.get_score(i)
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or MARK in piece[1:] or " " in piece):
            own.append((" " + piece[1:] if piece.startswith(MARK) else piece, model.get_score(i)))
    given = np.array([score for _, score in own])
    ranked = len(given) > 0 and given.min() < -100 and bool((given == np.rint(given)).all())
    found: dict[bytes, float] = {bytes([b]): -np.inf for b in range(256)}
    for piece, score in own:
        key = (piece.lower() if ranked else piece).encode()
        found[key] = max(found.get(key, -np.inf), score)
    if not ranked:
        found |= {b: score for b, score in spelt.items() if not np.isfinite(found[b])}
    scores = np.array(list(found.values()))
    known = np.isfinite(scores)
    if ranked:
        scores[known] = -np.log(10 - scores[known])
    scores[~known] = scores[known].min() if known.any() else 0.0
    return list(found), scores - np.logaddexp.reduce(scores) if ranked or not known.any() else scores, ranked


def held_out(doc_id: int | None, folds: int, fold: int) -> bool:
    """Whether crc32 of the id as text leaves ``fold``; a null id trains."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds == fold


def count_words(docs: DataFrame, folds: int, fold: int) -> DataFrame:
    """Distinct lower-cased words of ``docs(doc_id, t)``: ``word``, ``c`` in training, ``everywhere``."""
    schema = pa.schema([("word", pa.binary()), ("c", pa.int64()), ("everywhere", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        train: Counter[bytes] = Counter()
        test: Counter[bytes] = Counter()

        def handed() -> Iterator[pa.RecordBatch]:
            sink = Sink(schema)
            for w in train.keys() | test.keys():
                if sink.add(w, train[w], train[w] + test[w], weight=len(w)):
                    yield sink.flush()
            if len(sink):
                yield sink.flush()
            train.clear()
            test.clear()

        for doc, text in rows_of(batches, "doc_id", "t"):
            (test if held_out(doc, folds, fold) else train).update(text.lower().split())
            if len(train) + len(test) > HELD:
                yield from handed()
        yield from handed()

    parts = docs.select("doc_id", "t").mapInArrow(run, "word binary, c long, everywhere long")
    return parts.groupBy("word").agg(F.sum("c").alias("c"), F.sum("everywhere").alias("everywhere"))


def _larger(batches: Iterator[pa.RecordBatch], rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Batches of words, put together: the lattice handles words of one length at once."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def fit(words: DataFrame, pieces: list[bytes], scores: np.ndarray, ends: int, rounds: int, prior: float) -> tuple[np.ndarray, float]:
    """Scores of the pieces, and of the end, after ``rounds`` steps over ``words(word, c)``.

    The starting scores count as ``prior`` pieces seen. One sum a piece comes to
    the driver in each step.
    """
    context = words.sparkSession.sparkContext
    start = np.exp(scores)
    end = 0.0
    for _ in range(rounds):
        sent = context.broadcast((pieces, scores))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            lattice = Lattice(*sent.value)
            total = np.zeros(len(sent.value[0]))
            for batch in _larger(batches):
                own = [b" " + w for w in batch.column(0).to_pylist()]
                total += lattice.expect(own, batch.column(1).to_numpy().astype(float))
            ids = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64)), pa.array(total[ids])], names=["i", "e"])

        sums = words.where("c > 0").select("word", "c").mapInArrow(run, "i long, e double").groupBy("i").agg(F.sum("e").alias("e"))
        expected = start * prior
        for row in sums.collect():
            expected[row.i] += row.e
        whole = expected.sum() + ends + 1.0
        scores = np.log(expected / whole)
        end = float(np.log((ends + 1.0) / whole))
    return scores, end


def score_texts(
    docs: DataFrame,
    model_file: str,
    *,
    folds: int = 5,
    fold: int = 1,
    rounds: int | None = None,
    prior: float = 2_000.0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs`` with the score of its whole text.

    Columns: ``doc_id``, ``held_out``, ``n_tokens``, ``n_known``,
    ``train_tokens``, ``base_score``, ``score`` (log10). Texts whose id's crc32
    modulo ``folds`` isn't ``fold`` teach the model. ``rounds`` steps fit the
    scores to them: none unless it is given or the vocabulary only ranks its
    pieces, for which it is 2.

    A null text is empty: one token, the end. A null id trains and stays null.
    Repeated rows are scored each, and each teaches. Other columns are not read.
    An empty table gives an empty table. Rows are told apart by their place in
    the input, so an input whose order may change between reads should be
    written down first. A very long text is one value in a task, its words are rows.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("t"))
    words = materialize(count_words(source, folds, fold), "words")
    sums = words.agg(F.sum("c").alias("n"), F.sum("everywhere").alias("all"), F.count_if(F.col("c") > 0).alias("v")).first()
    out_of = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == fold
    ends = docs.select(F.col(id_col).cast("long").alias("doc_id")).where(~F.coalesce(out_of, F.lit(False))).count()
    tokens, distinct = (sums.n or 0) + ends, (sums.v or 0) + (ends > 0)
    whole = tokens + 0.5 * (distinct + 1)

    pieces, first, ranked = load_pieces(model_file)
    rounds = (2 if ranked else 0) if rounds is None else rounds
    if rounds:
        scores, end = fit(words, pieces, first, ends, rounds, prior)
        go_on = 0.0
    else:  # after each word and before the first the text ends or goes on
        scores, end = first, float(np.log((ends + 1) / (tokens + 2)))
        go_on = float(np.log1p(-np.exp(end)))
    model = spark.sparkContext.broadcast((pieces, scores))

    def marginal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(*model.value)
        for batch in _larger(batches):
            lp = go_on + lattice.score([b" " + w for w in batch.column(0).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lp / _LN10)], names=["word", "c", "everywhere", "lp"])

    scored = materialize(words.mapInArrow(marginal, "word binary, c long, everywhere long, lp double"), "scored-words")
    least = (sums.all or 0) / FREQUENT
    hot = {
        bytes(r.word): (r.c > 0, float(np.log10((r.c + 0.5) / whole)), r.lp)
        for r in scored.where(F.col("everywhere") >= F.lit(least)).limit(FREQUENT + 1).collect()
    }
    frequent = spark.sparkContext.broadcast(hot)
    end_base = float(np.log10((ends + 0.5) / whole))
    end_known, end_lp = int(ends > 0), end / _LN10

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each rare word of a text, and one for the text with all that is settled."""
        known = frequent.value
        rows: list[int] = []
        words: list[bytes] = []
        tfs: list[int] = []
        texts: list[tuple] = []

        def handed() -> pa.RecordBatch:
            n, (row, doc, tokens, n_known, base, lp) = len(rows), zip(*texts, strict=True)
            none = np.zeros(n, np.int64)
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([*rows, *row], pa.int64()),
                    # A text's key is no word and no other row's: it meets nothing in the join.
                    pa.array([*words, *(b" %d" % r for r in row)], pa.binary()),
                    pa.array([*tfs, *(0 for _ in row)], pa.int64()),
                    pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(doc, pa.int64())]),
                    pa.array(np.concatenate((none, tokens))),
                    pa.array(np.concatenate((none, n_known))),
                    pa.array(np.concatenate((none, base)).astype(float)),
                    pa.array(np.concatenate((none, lp)).astype(float)),
                ],
                names=["row", "word", "tf", "doc_id", "n_tokens", "known", "base", "lp"],
            )
            for x in (rows, words, tfs, texts):
                x.clear()
            return out

        for row, doc, text in rows_of(batches, "row", "doc_id", "t"):
            tf = Counter(text.lower().split())
            hot = tf.keys() & known.keys()
            rare = tf.keys() - hot
            words.extend(rare)
            tfs.extend(map(tf.__getitem__, rare))
            rows.extend(repeat(row, len(rare)))
            n_known, base, lp = end_known, end_base, end_lp
            for word in hot:
                n, own = tf[word], known[word]
                n_known += n * own[0]
                base += n * own[1]
                lp += n * own[2]
            texts.append((row, doc, tf.total() + 1, n_known, base, lp))
            if len(words) > 50_000 or len(texts) > 10_000:
                yield handed()
        if texts:
            yield handed()

    parts = source.withColumn("row", F.monotonically_increasing_id()).mapInArrow(
        settle, "row long, word binary, tf long, doc_id long, n_tokens long, known long, base double, lp double"
    )
    rare = scored.where(F.col("everywhere") < F.lit(least)).select(F.col("word"), "c", F.col("lp").alias("word_lp"))
    joined = parts.join(rare, "word", "left")
    c = F.coalesce("c", F.lit(0))
    base = F.col("base") + F.col("tf") * F.log10((c + 0.5) / F.lit(whole))
    out = joined.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("known") + F.when(c > 0, F.col("tf")).otherwise(0)).alias("n_known"),
        F.sum(base).alias("base_score"),
        F.sum(F.col("lp") + F.col("tf") * F.coalesce("word_lp", F.lit(0.0))).alias("score"),
    )
    return out.select(
        "doc_id",
        F.coalesce(out_of, F.lit(False)).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )
