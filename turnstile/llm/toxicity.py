"""Toxicity by compression distance.

Two zstandard dictionaries are trained from labelled texts: the ordinary one on
windows of ordinary texts, the toxic one on what sets toxic texts apart, laid
before the ordinary one as a shared base. A window, here a word with the blanks
around it, is compressed with either; how many bytes the toxic dictionary saves
is its distance. The thresholds on distances are calibrated: each is the least
that only a given share (``TAILS``) of ordinary windows reaches. A text's score
comes from its largest distances and from how many windows pass each threshold,
by a logistic fit on the labelled texts.

The toxic dictionary's samples are the parts of words whose grams stand in toxic
documents far more often than in ordinary ones. Trained on all windows of toxic
texts, a dictionary holds what is ordinary in them, and its distances drown.

A window stands before a fixed carrier that both dictionaries hold: zstandard
looks for no match in a block's last bytes and stores tiny blocks as they are.
Windows repeat, so each task remembers the distances of the last ones.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstile.llm.common import Sink, bound_batches, hashed_sample, rows_of, utf8

GRAMS = (5,8)
#: Shares of ordinary windows that reach the calibrated thresholds.
TAILS = (1e-2, 1e-3, 1e-4, 1e-5)
#: Bytes of the dictionaries.
BASE, EXTRA = 8_192, 8192
#: Windows that train the ordinary dictionary, at most.
TRAINED = 60_000
#: Distances remembered by a task.
REMEMBERED = 400_000
#: A window's longest part; a longer word is cut.
LONGEST = 64


def _grams(word: bytes) -> list[bytes]:
    marked = b" " + word + b" "
    return [marked[i : i + n] for n in GRAMS for i in range(len(marked) - n + 1)]


def windows(text: bytes) -> list[bytes]:
    """A text's windows: its lower-cased words, long ones in parts."""
    words = text.lower().split()
    if all(len(w) <= LONGEST for w in words):
        return words
    return [w[i : i + LONGEST] for w in words for i in range(0, len(w), LONGEST)]


def marked_grams(toxic: Sequence[bytes], ordinary: Sequence[bytes]) -> set[bytes]:
    """Grams that toxic documents hold over ten times as often, at over 6.5 standard errors."""
    seen_toxic: Counter[bytes] = Counter()
    seen_ordinary: Counter[bytes] = Counter()
    for texts, seen in ((toxic, seen_toxic), (ordinary, seen_ordinary)):
        for text in texts:
            seen.update({g for w in set(windows(text)) for g in _grams(w)})
    nt, no = max(len(toxic), 1), max(len(ordinary), 1)
    marked = set()
    for gram, c in seen_toxic.items():
        o = seen_ordinary[gram]
        if c >= 3 and c / nt > 10 * (o + 0.3) / no:
            p = (c + o) / (nt + no)
            if (c / nt - o / no) / math.sqrt(max(p * (1 - p), 1e-12) * (1 / nt + 1 / no)) >= 6.5:
                marked.add(gram)
    return marked


def marked_parts(word: bytes, marked: set[bytes]) -> list[bytes]:
    """The runs of a word, blanks around it included, that marked grams cover."""
    whole = b" " + word + b" "
    covered = bytearray(len(whole))
    for n in GRAMS:
        for i in range(len(whole) - n + 1):
            if whole[i : i + n] in marked:
                covered[i : i + n] = b"\x01" * n
    return [run for run in bytes(c if k else 0 for c, k in zip(whole, covered, strict=True)).split(b"\0") if run]


def trained(size: int, samples: list[bytes]) -> bytes:
    """A dictionary of at most ``size`` bytes, trained on ``samples``; their end where they are too few to train on."""
    try:
        return zstd.train_dictionary(size, samples, k=12, d=6, level=3).as_bytes()
    except zstd.ZstdError:
        return b"".join(samples)[-size:]


def dictionaries(toxic: Sequence[bytes], ordinary: Sequence[bytes]) -> tuple[bytes, bytes, bytes]:
    """Contents of the toxic and the ordinary dictionary, and the carrier."""
    own = [b" " + w + b" " for text in ordinary for w in windows(text)]
    # Spread evenly over the texts.
    base = trained(BASE, own[:: len(own) // TRAINED + 1])
    if len(base) < 64:
        base = b"-" * 64 + base
    marked = marked_grams(toxic, ordinary)
    parts = [b"\n" + run + b"\n" for text in toxic for w in sorted(set(windows(text))) for run in marked_parts(w, marked)]
    part = trained(EXTRA, parts) if parts else b""
    return part + base, base, b" " + base[-40:]


class Distances:
    """Bytes that the toxic dictionary saves on a window."""

    def __init__(self, toxic: bytes, ordinary: bytes, carrier: bytes):
        params = zstd.ZstdCompressionParameters(
            window_log=16, chain_log=16, hash_log=15, search_log=4, min_match=5, target_length=16, strategy=zstd.STRATEGY_LAZY,
            write_content_size=False, write_checksum=False, write_dict_id=False, format=zstd.FORMAT_ZSTD1_MAGICLESS,
        )
        self.held = []
        for content in (toxic, ordinary):
            own = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            own.precompute_compress(compression_params=params)
            self.held.append(zstd.ZstdCompressor(dict_data=own, compression_params=params))
        self.toxic, self.ordinary = self.held
        self.carrier = carrier
        self.memo: dict[bytes, int] = {}

    def of(self, window: bytes) -> int:
        found = self.memo.get(window)
        if found is None:
            if len(self.memo) >= REMEMBERED:
                self.memo.clear()
            block = b" " + window + b" " + self.carrier
            found = len(self.ordinary.compress(block)) - len(self.toxic.compress(block))
            self.memo[window] = found
        return found

    def features(self, text: bytes, steps: Sequence[int]) -> list[float]:
        """A text's largest savings, and how many windows reach each step."""
        counts = Counter(map(self.of, windows(text)))
        top: list[int] = []
        for value in sorted(counts, reverse=True):
            top += [value] * min(counts[value], 3 - len(top))
            if len(top) == 3:
                break
        top += [0] * (3 - len(top))
        reached = [sum(n for v, n in counts.items() if v >= s) for s in steps]
        total = counts.total()
        return [
            1.0,
            *[float(max(-8, min(t, 12))) for t in top],
            *[math.log1p(r) for r in reached],
            math.log1p(total),
            math.log1p(1000 * reached[0] / max(total, 1)),
        ]


@dataclass(frozen=True)
class Model:
    toxic: bytes
    ordinary: bytes
    carrier: bytes
    steps: tuple[int, ...]
    weights: tuple[float, ...]
    constant: float | None = None

    def scorer(self):
        """A function from a text to its score."""
        if self.constant is not None:
            return lambda text: self.constant
        distances = Distances(self.toxic, self.ordinary, self.carrier)
        weights = np.array(self.weights)

        def score(text: bytes) -> float:
            at = float(np.dot(distances.features(text, self.steps), weights))
            return 1 / (1 + math.exp(-max(-30.0, min(30.0, at))))

        return score


def calibrated_steps(distances: Distances, ordinary: Sequence[bytes]) -> tuple[int, ...]:
    """For each of ``TAILS`` the least distance that at most this share of ordinary windows reaches."""
    seen = Counter(d for text in ordinary for d in map(distances.of, windows(text)))
    total = max(seen.total(), 1)
    steps = []
    for tail in TAILS:
        at = 1
        while sum(n for d, n in seen.items() if d >= at) > tail * total:
            at += 1
        steps.append(max(at, steps[-1] + 1 if steps else at))
    return tuple(steps)


def train(toxic: Sequence[bytes], ordinary: Sequence[bytes], ridge: float = 1.0, rounds: int = 30) -> Model:
    """Dictionaries and a logistic fit; without texts of both kinds the score is constant."""
    if not toxic or not ordinary:
        return Model(b"", b"", b"", (), (), 1.0 if toxic else 0.0)
    content = dictionaries(toxic, ordinary)
    distances = Distances(*content)
    steps = calibrated_steps(distances, ordinary)
    x = np.array([distances.features(t, steps) for t in (*toxic, *ordinary)])
    y = np.array([1.0] * len(toxic) + [0.0] * len(ordinary))
    w = np.zeros(x.shape[1])
    for _ in range(rounds):  # Newton's method
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x.T * (p * (1 - p))) @ x + ridge * np.eye(len(w))
        w = w + np.linalg.solve(hessian, x.T @ (y - p) - ridge * w)
    return Model(*content, steps, tuple(w.tolist()))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, rows: int, nbytes: int, folds: int, fold: int, *, id_col: str, text_col: str, seed: int
) -> tuple[list[bytes], list[bytes]]:
    """Texts of at most ``rows`` toxic and as many ordinary training labels, by seeded hash.

    The labels are drawn first, so at most ``2 * rows`` of them are sent to the
    documents; each teaches one text. An id labelled twice is toxic if any label says so.
    """
    crc = F.crc32(F.col("id").cast("string").cast("binary"))
    own = labels.select(F.col(id_col).cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic"))
    own = own.where(F.col("id").isNotNull() & F.col("toxic").isNotNull() & (F.pmod(crc, F.lit(folds)) != fold))
    own = own.groupBy("id").agg(F.max("toxic").alias("toxic"))
    draw = F.xxhash64(F.lit(seed), F.col("id"))
    drawn = hashed_sample(own.where("toxic = 1"), rows, draw).unionByName(hashed_sample(own.where("toxic = 0"), rows, draw))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), utf8(text_col).alias("t")).where(F.octet_length("t") <= nbytes)
    # One text a label, however often its id stands in the documents: at most 2 * rows come.
    one = texts.join(F.broadcast(drawn), "id").groupBy("id").agg(F.min("toxic").alias("toxic"), F.min_by("t", F.xxhash64("t")).alias("t"))
    found = one.orderBy("toxic", draw, "id").select("toxic", "t").collect()
    return [bytes(r.t) for r in found if r.toxic], [bytes(r.t) for r in found if not r.toxic]


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    *,
    sample: int = 1_500,
    sample_bytes: int = 16_384,
    threshold: float = 0.7,
    folds: int = 3,
    fold: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = 7,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``held_out``, ``score`` (0 to 1), ``predicted``.

    Only labels whose id's crc32 modulo ``folds`` isn't ``fold`` are learned
    from, at most ``sample`` of either kind (texts of at most ``sample_bytes``
    bytes); every text is scored as a whole.

    A null or empty text has no windows and gets the score of no evidence. A
    null id isn't held out. Rows of ``labels`` without id or label teach
    nothing; without labels of both kinds all scores are 0, or 1 if all are
    toxic. Repeated rows are scored each. Other columns are not read. A very long text is
    one value, scored word by word. An empty table gives an empty table.
    """
    bound_batches(docs.sparkSession)
    model = train(*labelled_sample(docs, labels, sample, sample_bytes, folds, fold, id_col=id_col, text_col=text_col, seed=seed))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        score = sent.value.scorer()
        sink = Sink(pa.schema([("doc_id", pa.int64()), ("score", pa.float64())]))
        for doc, text in rows_of(batches, "doc_id", "t"):
            if sink.add(doc, score(text)):
                yield sink.flush()
        if len(sink):
            yield sink.flush()

    out_of = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == fold
    return source.mapInArrow(run, "doc_id long, score double").select(
        "doc_id",
        F.coalesce(out_of, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
