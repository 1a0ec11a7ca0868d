"""The lattice of all segmentations of words into pieces, in log space.

Words of one length are handled together: piece lookups for every start and
length are array operations, and so is each step of the forward and backward
recursions. Every byte is a piece of its own, so every word has a segmentation.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence

import numpy as np

#: Longer pieces than this are found through their first eight bytes.
_PACKED = 8
_BITS = 20
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Words up to this length are handled together; longer ones one by one.
LONGEST = 96
_CELLS = 2_000_000


class Lattice:
    """Pieces (distinct byte strings, every single byte among them) with log scores."""

    def __init__(self, pieces: Sequence[bytes], scores: np.ndarray):
        self.scores = np.asarray(scores, np.float64)
        self.ids = {p: i for i, p in enumerate(pieces)}
        self.widest = max(map(len, pieces))
        by_length: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.long: dict[bytes, int] = {}
        heads = set()
        for piece, i in self.ids.items():
            if len(piece) <= _PACKED:
                by_length[len(piece)].append((int.from_bytes(piece, "big"), i))
            else:
                self.long[piece] = i
                heads.add(int.from_bytes(piece[:_PACKED], "big"))
        self.tables = {n: self._table(sorted(rows)) for n, rows in by_length.items()}
        self.heads = self._table([(h, 0) for h in sorted(heads)]) if heads else None
        self.long_lengths = sorted({len(p) for p in self.long})

    @staticmethod
    def _table(rows: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys = np.array([k for k, _ in rows], np.uint64)
        seen = np.zeros(1 << _BITS, bool)
        seen[(keys * _MIX) >> np.uint64(64 - _BITS)] = True
        return keys, np.array([i for _, i in rows], np.int32), seen

    @staticmethod
    def _find(table: tuple, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat places of ``keys`` in the table, and the piece there."""
        own, ids, seen = table
        at = np.flatnonzero(seen[(keys * _MIX) >> np.uint64(64 - _BITS)])
        found = keys[at]
        place = np.minimum(np.searchsorted(own, found), len(own) - 1)
        good = own[place] == found
        return at[good], ids[place[good]]

    def _edges(self, mat: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """For each piece length, the piece at each word and start, or -1."""
        n, width = mat.shape
        edges, key = [], np.zeros((n, width), np.uint64)
        for length in range(1, min(_PACKED, width) + 1):
            key = (key[:, : width - length + 1] << np.uint64(8)) | mat[:, length - 1 :]
            if length in self.tables:
                ids = np.full(key.size, -1, np.int32)
                at, own = self._find(self.tables[length], key.ravel())
                ids[at] = own
                edges.append((length, ids.reshape(key.shape)))
        if self.heads is not None and width > _PACKED:
            at, _ = self._find(self.heads, key.ravel())
            rows, starts = np.divmod(at, key.shape[1])
            more: dict[int, np.ndarray] = {}
            for r, s in zip(rows.tolist(), starts.tolist(), strict=True):
                line = mat[r].tobytes()
                for length in self.long_lengths:
                    if s + length > width:
                        break
                    i = self.long.get(line[s : s + length])
                    if i is not None:
                        if length not in more:
                            more[length] = np.full((n, width - length + 1), -1, np.int32)
                        more[length][r, s] = i
            edges += more.items()
        return edges

    def _forward(self, edges: list[tuple[int, np.ndarray]], n: int, width: int) -> np.ndarray:
        """Log-sum over all segmentations of the first ``e`` bytes, by ``e``."""
        padded = np.append(self.scores, -np.inf)  # id -1 scores nothing
        alpha = np.full((width + 1, n), -np.inf)
        alpha[0] = 0
        scored = [(length, padded[ids.T]) for length, ids in edges]
        for e in range(1, width + 1):
            terms = [alpha[e - length] + lp[e - length] for length, lp in scored if length <= e]
            alpha[e] = _logsum(terms)
        return alpha

    def _backward(self, edges: list[tuple[int, np.ndarray]], n: int, width: int) -> np.ndarray:
        padded = np.append(self.scores, -np.inf)
        beta = np.full((width + 1, n), -np.inf)
        beta[width] = 0
        scored = [(length, padded[ids.T]) for length, ids in edges]
        for s in range(width - 1, -1, -1):
            terms = [beta[s + length] + lp[s] for length, lp in scored if s + length <= width]
            beta[s] = _logsum(terms)
        return beta

    @staticmethod
    def _portions(words: Sequence[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Words of one width at a time: their places, and their bytes as rows."""
        groups: dict[int, list[int]] = defaultdict(list)
        for i, w in enumerate(words):
            groups[len(w)].append(i)
        for width, places in groups.items():
            rows = max(1, _CELLS // (16 * width)) if 0 < width <= LONGEST else 1
            for a in range(0, len(places) if width else 0, rows):
                part = places[a : a + rows]
                mat = np.frombuffer(b"".join([words[i] for i in part]), np.uint8)
                yield np.array(part), mat.reshape(len(part), width)

    def score(self, words: Sequence[bytes]) -> np.ndarray:
        """The log probability of each word: its marginal over all segmentations; 0 if empty."""
        out = np.zeros(len(words))
        for places, mat in self._portions(words):
            n, width = mat.shape
            if width > LONGEST:
                out[places[0]] = self._forward_long(mat.tobytes())[-1]
            else:
                out[places] = self._forward(self._edges(mat), n, width)[width]
        return out

    def expect(self, words: Sequence[bytes], counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in ``counts`` occurrences of each word, over all segmentations."""
        total = np.zeros(len(self.scores))
        for places, mat in self._portions(words):
            n, width = mat.shape
            if width > LONGEST:
                self._expect_long(mat.tobytes(), float(counts[places[0]]), total)
                continue
            edges = self._edges(mat)
            alpha, beta = self._forward(edges, n, width), self._backward(edges, n, width)
            for length, ids in edges:
                word, start = np.nonzero(ids >= 0)
                own = ids[word, start]
                log = alpha[start, word] + self.scores[own] + beta[start + length, word] - alpha[width, word]
                total += np.bincount(own, np.exp(log) * counts[places[word]], len(total))
        return total

    def _long_edges(self, word: bytes, end: int) -> Iterable[tuple[int, int]]:
        """(start, piece) of the pieces that end at ``end``."""
        for start in range(max(0, end - self.widest), end):
            i = self.ids.get(word[start:end])
            if i is not None:
                yield start, i

    def _forward_long(self, word: bytes) -> np.ndarray:
        alpha = np.zeros(len(word) + 1)
        for e in range(1, len(word) + 1):
            alpha[e] = np.logaddexp.reduce([alpha[s] + self.scores[i] for s, i in self._long_edges(word, e)])
        return alpha

    def _expect_long(self, word: bytes, count: float, total: np.ndarray) -> None:
        alpha = self._forward_long(word)
        beta = np.full(len(word) + 1, -np.inf)
        beta[-1] = 0
        for e in range(len(word), 0, -1):
            for s, i in self._long_edges(word, e):
                beta[s] = np.logaddexp(beta[s], self.scores[i] + beta[e])
        for e in range(1, len(word) + 1):
            for s, i in self._long_edges(word, e):
                total[i] += count * np.exp(alpha[s] + self.scores[i] + beta[e] - alpha[-1])


def _logsum(terms: list[np.ndarray]) -> np.ndarray:
    """log(sum(exp(terms))), where at least one term is finite."""
    if len(terms) == 1:
        return terms[0]
    most = terms[0]
    for t in terms[1:]:
        most = np.maximum(most, t)
    total = np.exp(terms[0] - most)
    for t in terms[1:]:
        total += np.exp(t - most)
    return most + np.log(total)
