"""Array kernels of additive quantisation: training, beam-search encoding, table scoring."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BLOCK = 1024


@dataclass
class Codebooks:
    """`cells` (cells, dim) are the coarse directions; `books` (stages, entries, dim) are full-dimensional codebooks whose entries add up to a vector."""

    cells: np.ndarray
    books: np.ndarray


def lloyd(x: np.ndarray, k: int, rounds: int, seed: int, direction: bool = False) -> np.ndarray:
    """k-means centres; with `direction` they are unit vectors and the nearest is the one of largest inner product."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].astype(np.float32)
    for _ in range(rounds):
        near = np.concatenate([(part @ c.T - (0 if direction else 0.5 * (c * c).sum(1))).argmax(1) for part in np.array_split(x, max(1, len(x) // 8192))])
        order = np.argsort(near, kind="stable")
        bounds = np.searchsorted(near[order], np.arange(k + 1))
        full = bounds[1:] > bounds[:-1]
        sums = np.add.reduceat(x[order], bounds[:-1][full], axis=0)
        c[full] = sums / (np.linalg.norm(sums, axis=1, keepdims=True) + 1e-30 if direction else (bounds[1:] - bounds[:-1])[full, None])
    return c


def train(x: np.ndarray, cells: int, stages: int = 8, entries: int = 256, beam: int = 4, rounds: int = 8, seed: int = 7) -> Codebooks:
    """Codebooks from unit vectors `x`: each is fitted to what the books before it leave over after beam search."""
    coarse = lloyd(x, cells, rounds, seed, direction=True)
    books, state = [], [_start(part) for part in np.array_split(x, max(1, -(-len(x) // BLOCK)))]
    for stage in range(stages):  # the beams go on from stage to stage
        left = np.concatenate([rest[np.arange(len(rest)), error.argmin(1)] for _, rest, error in state])
        books.append(lloyd(left, entries, rounds, seed + stage + 1))
        state = [_grown(*part, books[-1], beam) for part in state]
    return Codebooks(coarse, np.stack(books))


def decode(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    out = np.zeros((len(codes), books.shape[2]), dtype=np.float32)
    for m in range(len(books)):
        out += books[m][codes[:, m]]
    return out


def encode(x: np.ndarray, books: np.ndarray, beam: int = 8, block: int = BLOCK) -> np.ndarray:
    """Codes (n, stages): of all sums tried, the nearest; `beam` partial sums survive each stage."""
    return np.concatenate([_encode(part, books, beam) for part in np.array_split(x, max(1, -(-len(x) // block)))]) if len(x) else np.zeros((0, len(books)), dtype=np.uint8)


def _start(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (n, beams, stages), what they leave over (n, beams, dim), and its squared norm (n, beams), before the first stage."""
    return np.zeros((len(x), 1, 0), dtype=np.uint8), x[:, None, :], (x * x).sum(1)[:, None]


def _grown(codes: np.ndarray, left: np.ndarray, error: np.ndarray, book: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The `beam` best ways to go on by one entry of a book."""
    n, _, dim = left.shape
    k = len(book)
    cost = (error[:, :, None] - 2 * (left.reshape(-1, dim) @ book.T).reshape(n, -1, k) + (book * book).sum(1)).reshape(n, -1)
    keep = min(beam, cost.shape[1])
    best = np.argpartition(cost, keep - 1, axis=1)[:, :keep]
    via, entry = best // k, best % k
    rows = np.arange(n)[:, None]
    return np.concatenate([codes[rows, via], entry[:, :, None].astype(np.uint8)], axis=2), left[rows, via] - book[entry], cost[rows, best]


def _encode(x: np.ndarray, books: np.ndarray, beam: int) -> np.ndarray:
    state = _start(x)
    for book in books:
        state = _grown(*state, book, beam)
    codes, _, error = state
    return codes[np.arange(len(x)), error.argmin(1)]


def tables(q: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Lookup tables (queries, stages, entries) of inner products."""
    return (q @ books.reshape(-1, books.shape[2]).T).reshape(len(q), books.shape[0], books.shape[1])


def score(lut: np.ndarray, codes: np.ndarray, norms: np.ndarray, block: int = 512) -> np.ndarray:
    """Cosines (queries, rows) of queries with decoded rows, by adding table entries; `norms` are those of the decoded rows.

    The entries of all queries lie side by side, so an entry is copied for all of them at once.
    """
    table = np.ascontiguousarray(lut.transpose(1, 2, 0))
    out = np.empty((lut.shape[0], len(codes)), dtype=np.float32)
    for lo in range(0, len(codes), block):
        part = codes[lo : lo + block]
        total = table[0][part[:, 0]]
        for m in range(1, part.shape[1]):
            total += np.take(table[m], part[:, m], axis=0)
        out[:, lo : lo + block] = (total / norms[lo : lo + block, None]).T
    return out


def shortlist(scores: np.ndarray, size: int) -> np.ndarray:
    """Column numbers of the `size` largest scores of each row."""
    return np.argpartition(-scores, size - 1, axis=1)[:, :size] if scores.shape[1] > size else np.broadcast_to(np.arange(scores.shape[1]), scores.shape)
