"""Quality rules as a short-circuit cascade.

Every rule is a predicate over lazily computed measures of one text. A bounded
sample, drawn by hash, says what each rule costs and what share it rejects;
rules then run in the order of rejection per cost, and a text leaves the cascade
at its first rejection. The order never changes a verdict: a text is kept if no
rule rejects it.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnstile.llm.common import Sink, bound_batches, hashed_sample, rows_of, utf8

#: Fixed values of the contract.
SYMBOLS = b"#*$%&|<>"
RUN = 5
LEAST_WORDS = 10
MOST_REPEATED = 20  # per cent of the words


class Measures:
    """Lazy measures of one text, given as UTF-8 bytes."""

    def __init__(self, text: bytes):
        self.text = text

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        """Code points in words: bytes that don't continue a character."""
        joined = np.frombuffer(b"".join(self.words), np.uint8)
        return int(np.count_nonzero((joined & 0xC0) != 0x80))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.text) - len(self.text.translate(None, SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        """Lines that hold a word."""
        return [x for x in self.text.split(b"\n") if x.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words inside windows of ``RUN`` words that stand twice or more in the text."""
        n = self.n_words - RUN + 1
        if n < 2:
            return 0
        seen: dict[bytes, int] = {}
        ids = np.fromiter((seen.setdefault(w, len(seen)) for w in self.words), np.int64, self.n_words)
        key = ids[:n]
        for i in range(1, RUN):  # exact: ranks and ids stay below 2 ** 31
            if i > 1:
                key = np.unique(key, return_inverse=True)[1]
            key = key * len(seen) + ids[i : n + i]
        _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
        starts = np.flatnonzero(counts[inverse] > 1)
        edge = np.zeros(self.n_words + 1, np.int64)
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + RUN, -1)
        return int(np.count_nonzero(np.cumsum(edge[:-1]) > 0))

    @cached_property
    def n_alpha_words(self) -> int:
        """Words with a letter: A-Z, a-z or anything beyond ASCII."""
        return sum(1 for w in self.words if not w.isascii() or w.lower() != w.upper())

    @cached_property
    def n_stutters(self) -> int:
        """Words equal to the word before."""
        return sum(map(bytes.__eq__, self.words[1:], self.words))

    @property
    def base_failed(self) -> bool:
        return self.n_words < LEAST_WORDS or 100 * self.n_repeat_words > MOST_REPEATED * self.n_words


#: What each measure is computed from.
NEEDS: dict[str, tuple[str, ...]] = {
    "words": (),
    "n_words": ("words",),
    "word_chars": ("words",),
    "n_symbols": (),
    "lines": (),
    "n_dup_lines": ("lines",),
    "n_repeat_words": ("words", "n_words"),
    "n_alpha_words": ("words",),
    "n_stutters": ("words",),
}


@dataclass(frozen=True)
class Rule:
    """``uses`` names the measures that ``rejects`` looks at."""

    name: str
    uses: tuple[str, ...]
    rejects: Callable[[Measures], bool]


#: Comparisons of whole numbers, so that they hold alike everywhere.
RULES: tuple[Rule, ...] = (
    Rule("few_words", ("n_words",), lambda m: m.n_words < LEAST_WORDS),
    Rule("repeated_runs", ("n_repeat_words", "n_words"), lambda m: 100 * m.n_repeat_words > MOST_REPEATED * m.n_words),
    Rule("symbols", ("n_symbols", "n_words"), lambda m: 10 * m.n_symbols > m.n_words),
    Rule("duplicate_lines", ("n_dup_lines", "lines"), lambda m: 2 * m.n_dup_lines > len(m.lines)),
    Rule("word_length", ("word_chars", "n_words"), lambda m: m.word_chars < 2 * m.n_words or m.word_chars > 15 * m.n_words),
    Rule("letters", ("n_alpha_words", "n_words"), lambda m: 2 * m.n_alpha_words < m.n_words),
    Rule("stutter", ("n_stutters", "n_words"), lambda m: 10 * m.n_stutters > 3 * m.n_words),
)


@dataclass(frozen=True)
class Step:
    """A rule's place in the cascade: what it costs there and the share it rejects of what reaches it."""

    name: str
    seconds: float
    rejected: float


def _schema(plain: DataFrame, fields: list[tuple]) -> T.StructType:
    """The schema of ``plain`` plus added columns."""
    kinds = {"boolean": T.BooleanType(), "string": T.StringType(), "long": T.LongType()}
    return T.StructType([*plain.schema.fields, *[T.StructField(n, kinds[k]) for n, _, k in fields]])


def _with_needs(measures: Sequence[str]) -> set[str]:
    return {n for m in measures for n in (m, *_with_needs(NEEDS.get(m, ())))}


def plan_cascade(texts: Sequence[bytes], rules: Sequence[Rule] = RULES) -> list[Step]:
    """Rules by rejection per cost on a sample, best first; ties in the given order.

    A measure is paid for once, by the first rule that uses it, and a rule is
    judged on what the rules before it let pass.
    """
    spent: dict[str, float] = {}
    left = [Measures(t) for t in texts]
    for name in NEEDS:  # in this order each finds what it is computed from
        start = time.perf_counter()
        for m in left:
            getattr(m, name)
        spent[name] = (time.perf_counter() - start) / max(len(texts), 1)
    verdicts, own = {}, {}
    for rule in rules:
        start = time.perf_counter()
        verdicts[rule.name] = [rule.rejects(m) for m in left]
        own[rule.name] = max(time.perf_counter() - start, 1e-9) / max(len(texts), 1)
    known: set[str] = set()
    alive = list(range(len(texts)))
    steps, waiting = [], list(rules)
    while waiting:
        judged = []
        for rule in waiting:
            seconds = own[rule.name] + sum(spent[m] for m in _with_needs(rule.uses) - known if m in spent)
            judged.append(Step(rule.name, seconds, sum(verdicts[rule.name][i] for i in alive) / max(len(alive), 1)))
        best = max(range(len(judged)), key=lambda i: (judged[i].rejected / judged[i].seconds, -i))
        steps.append(judged[best])
        rule = waiting.pop(best)
        known |= _with_needs(rule.uses)
        alive = [i for i in alive if not verdicts[rule.name][i]]
    return steps


def sample_texts(docs: DataFrame, rows: int, nbytes: int, *, id_col: str, text_col: str, seed: int) -> list[bytes]:
    """At most ``rows`` texts of at most ``nbytes`` each, by seeded hash of the id; it only orders rules."""
    text = utf8(text_col)
    short = F.when(F.octet_length(text) <= nbytes, text)  # a longer one isn't sent
    source = docs.select(F.col(id_col).alias("id"), short.alias("t"))
    drawn = hashed_sample(source, rows, F.xxhash64(F.lit(seed), F.col("id")))
    return [bytes(r.t) for r in drawn.select("t").collect() if r.t is not None]


def plan(
    docs: DataFrame,
    *,
    rules: Sequence[Rule] = RULES,
    sample_rows: int = 256,
    sample_bytes: int = 32_768,
    seed: int = 9,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> list[Step]:
    """The cascade's order for ``docs``. Costs are times: keep the plan where ``rejected_by`` must be the same again."""
    return plan_cascade(sample_texts(docs, sample_rows, sample_bytes, id_col=id_col, text_col=text_col, seed=seed), rules)


def cascade(
    docs: DataFrame,
    *,
    rules: Sequence[Rule] = RULES,
    sample_rows: int = 256,
    sample_bytes: int = 32_768,
    seed: int = 9,
    id_col: str = "doc_id",
    text_col: str = "text",
    measure: bool = False,
    steps: Sequence[Step] | None = None,
) -> DataFrame:
    """All rows of ``docs`` with ``kept`` and ``rejected_by`` (the rule that ended the cascade, or null).

    ``steps`` is a plan kept from :func:`plan`; none makes a new one. Which of
    several failing rules ends the cascade follows its order, ``kept`` doesn't.

    ``measure`` adds the measures of every text, rejected ones too:
    ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed``.

    A null or empty text has no words and is rejected. Columns of ``docs`` with
    those names are replaced; all others stay, whatever they are called. An
    empty table gives an empty table. The sample (at most ``sample_rows`` texts
    of at most ``sample_bytes``) decides the order of the rules alone. A very long
    text is judged whole in its task; repeated rows fare alike.
    """
    bound_batches(docs.sparkSession)
    if steps is None:
        steps = plan(docs, rules=rules, sample_rows=sample_rows, sample_bytes=sample_bytes, seed=seed, id_col=id_col, text_col=text_col)
    named = {r.name: r for r in rules}
    ordered = [named[s.name] for s in steps]
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    added = ("kept", "rejected_by", *((*counts, "base_failed") if measure else ()))
    plain = docs.drop(*added)
    source = plain.withColumn("__quality_text", utf8(text_col))
    fields = [("kept", pa.bool_(), "boolean"), ("rejected_by", pa.string(), "string")]
    if measure:
        fields += [(c, pa.int64(), "long") for c in counts] + [("base_failed", pa.bool_(), "boolean")]
    keep = plain.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, t) for n, t, _ in fields])
        for batch in batches:
            sink = Sink(schema)
            for (text,) in rows_of([batch], "__quality_text"):
                m = Measures(text)
                by = next((r.name for r in ordered if r.rejects(m)), None)
                extra = (*(getattr(m, c) for c in counts), m.base_failed) if measure else ()
                sink.add(by is None, by, *extra)
            added_batch = sink.flush()
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(len(keep))] + added_batch.columns, names=[*keep, *added_batch.schema.names]
            )

    return source.mapInArrow(run, _schema(plain, fields))

