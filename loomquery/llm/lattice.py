"""The lattice of all segmentations of a string into pieces of a fixed vocabulary, with log scores.

Units (a word with its word mark, say) of equal length are computed together as numpy arrays; a unit
longer than `LONG` runs by itself, position by position. Every single character has an arc: its own piece if the vocabulary has
one, else the escape, whose score the vocabulary sets for each character.
"""

from __future__ import annotations

import importlib
from dataclasses import dataclass, field

import numpy as np

MARK = "▁"
BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
SPREAD = np.uint64(0xD6E8FEB86659FD93)
LONG = 48
#: Units of one length that are computed at once, by their characters.
CELLS = 1 << 18
SLOTS = 18
#: Lengths at which it is looked up whether a piece goes on.
PREFIXES = 6


def load_pieces(path: str) -> tuple[list[str], np.ndarray, int]:
    """(pieces, log scores, id of the first byte piece) of a SentencePiece model file.

    A unigram model's scores are log probabilities already. A merge model's are minus the merge's rank;
    they become a Zipf law over ranks: log(1 / (rank + 10)), scaled to sum to 1. Control, byte and
    unreachable pieces have no arcs.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    scores = np.array([model.get_score(i) for i in range(len(names))])
    usable = np.array([not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)) for i in range(len(names))])
    first_byte = next((i for i in range(len(names)) if model.is_byte(i)), -1)
    ranks = -scores[usable & (scores > -1e8)]
    if len(ranks) and ranks.max() > 1000:  # ranks, not log probabilities
        rank = np.minimum(-scores, ranks.max() + 1)
        scores = -np.log(rank + 10)
        scores -= np.log(np.exp(scores[usable]).sum())
    return [n if u else "" for n, u in zip(names, usable, strict=True)], np.where(usable, scores, -np.inf), first_byte


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    """The public vocabulary files' place on this machine, where the package that holds them is installed."""
    return importlib.import_module("public_tokenizers").path(name)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


@dataclass
class Vocabulary:
    """Pieces by hash, with log scores: a vector, or a matrix with a column for each of several models.

    Two rows are added: the escape's, and one of -inf that stands for no arc and is reached by the id -1.
    """

    pieces: list[str]
    scores: np.ndarray
    escape: float | np.ndarray
    longest: int = field(init=False)

    def __post_init__(self):
        scores = np.asarray(self.scores, np.float64)
        self.scores = np.concatenate([scores, np.broadcast_to(self.escape, (1, *scores.shape[1:])), np.full((1, *scores.shape[1:]), -np.inf)])
        self.longest = max((len(p) for p in self.pieces), default=1) or 1
        self.ids = {p: i for i, p in enumerate(self.pieces) if p}
        self.table = np.full(1 << SLOTS, -1, np.int32)
        self.after = np.full(len(self.pieces), -1, np.int32)
        self.keys = np.zeros(len(self.pieces) + 1, np.uint64)
        for p, i in self.ids.items():
            h = 0
            for c in code_points(p).tolist():
                h = (h * int(BASE) + c + 1) % 2**64
            self.keys[i] = h
            slot = h * int(SPREAD) % 2**64 >> (64 - SLOTS)
            self.after[i], self.table[slot] = self.table[slot], i
        self.after = np.append(self.after, np.int32(-1))
        # Whether any piece is longer than n and starts like this, for short n: by the same bits.
        self.starts = [np.zeros(1 << SLOTS, bool) for _ in range(PREFIXES + 1)]
        for p in self.ids:
            h = 0
            for n, c in enumerate(code_points(p).tolist()[: PREFIXES + 1]):
                if n:
                    self.starts[n][h * int(SPREAD) % 2**64 >> (64 - SLOTS)] = True
                h = (h * int(BASE) + c + 1) % 2**64

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Piece ids of string hashes, -1 where there is none."""
        at = self.table[(hashes * SPREAD) >> np.uint64(64 - SLOTS)]
        look = np.flatnonzero(at >= 0)
        while len(look):
            look = look[self.keys[at[look]] != hashes[look]]
            at[look] = self.after[at[look]]
            look = look[at[look] >= 0]
        return at


def by_length(units: list[str]):
    """(rows, matrix) for groups of units of one length."""
    lengths = np.fromiter(map(len, units), np.int64, len(units))
    order = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[order])) + 1
    for group in np.split(order, cuts):
        n = int(lengths[group[0]]) if len(group) else 0
        if not n:
            continue
        step = max(1, CELLS // n)
        for at in range(0, len(group), step):
            rows = group[at : at + step]
            yield rows, code_points("".join(map(units.__getitem__, rows.tolist()))).reshape(len(rows), n)


def arcs(vocab: Vocabulary, chars: np.ndarray):
    """{(i, j): piece ids} of a matrix of units: the arc from position i to j; -1: none.

    Single characters that are no piece have the escape, numbered after the pieces.
    """
    n, length = chars.shape
    escape = len(vocab.pieces)
    found = {}
    c = chars.astype(np.uint64) + np.uint64(1)
    for i in range(length):
        h, rows = np.zeros(n, np.uint64), None  # rows: those that may still be at the start of a piece; None: all
        for j in range(i + 1, min(length, i + vocab.longest) + 1):
            h = h * BASE + (c[:, j - 1] if rows is None else c[rows, j - 1])
            ids = vocab.find(h)
            if rows is not None:
                own, ids = ids, np.full(n, -1, np.int32)
                ids[rows] = own
            if j == i + 1:
                ids = np.where(ids < 0, escape, ids)
            if j == i + 1 or (ids >= 0).any():
                found[i, j] = ids
            if j - i <= PREFIXES:
                on = np.flatnonzero(vocab.starts[j - i][(h * SPREAD) >> np.uint64(64 - SLOTS)])
                if not len(on):
                    break
                if len(on) < 0.7 * len(h):
                    h, rows = h[on], on if rows is None else rows[on]
    return found


def log_sum(terms: list[np.ndarray]) -> np.ndarray:
    """log(sum(exp(term))) element by element; -inf where all are."""
    if len(terms) == 1:
        return terms[0]
    stack = np.stack(terms)
    top = stack.max(axis=0)
    top = np.where(np.isfinite(top), top, 0)
    with np.errstate(divide="ignore"):
        return top + np.log(np.exp(stack - top).sum(axis=0))


def by_end(found: dict) -> dict:
    """{j: [(i, ids)]} of arcs {(i, j): ids}."""
    ends: dict = {}
    for (i, j), ids in found.items():
        ends.setdefault(j, []).append((i, ids))
    return ends


def forward(vocab: Vocabulary, units: list[str], stop=0.0) -> np.ndarray:
    """The log of the summed probability of all segmentations of each unit: the log-space forward recursion.

    Each segmentation's score is the sum of its pieces' scores plus `stop`. An empty unit has just `stop`.
    """
    models = vocab.scores.shape[1:]
    out = np.broadcast_to(stop, (len(units), *models)).astype(np.float64)
    for rows, chars in by_length(units):
        if chars.shape[1] > LONG:
            out[rows] = np.array([forward_one(vocab, units[i])[-1] for i in rows]) + stop
            continue
        alpha = np.full((chars.shape[1] + 1, len(rows), *models), -np.inf)
        alpha[0] = 0
        for j, into in sorted(by_end(arcs(vocab, chars)).items()):
            alpha[j] = log_sum([alpha[i] + vocab.scores[ids] for i, ids in into])
        out[rows] = alpha[-1] + stop
    return out


def forward_one(vocab: Vocabulary, unit: str) -> np.ndarray:
    """alpha of one unit, position by position; for long units, and as a plain form to test against."""
    alpha, escape = np.full((len(unit) + 1, *vocab.scores.shape[1:]), -np.inf), len(vocab.pieces)
    alpha[0] = 0
    for j in range(1, len(unit) + 1):
        for i in range(max(0, j - vocab.longest), j):
            if (k := vocab.ids.get(unit[i:j], escape if i == j - 1 else -1)) >= 0:
                alpha[j] = np.logaddexp(alpha[j], alpha[i] + vocab.scores[k])
    return alpha


def expected_counts(vocab: Vocabulary, units: list[str], scores: np.ndarray) -> np.ndarray:
    """Expected uses of each piece, and last the escape, over all segmentations of the units.

    `scores` stands in for the vocabulary's, as a vector. Probabilities are multiplied as they are, with the
    positions scaled by their single-character arc; units longer than `LONG` are summed in log space.
    """
    p, total = np.exp(scores), np.zeros(len(vocab.pieces) + 1)
    for rows, chars in by_length(units):
        n = chars.shape[1]
        if n > LONG:
            for r in rows:
                expected_one(vocab, units[r], scores, total)
            continue
        found = {at: (ids, p[ids]) for at, ids in arcs(vocab, chars).items()}
        # A position's single-character arc, on which each unit can pass, keeps products from underflow.
        scale = [found[i, i + 1][1] for i in range(n)]
        alpha, beta = np.zeros((n + 1, len(rows))), np.zeros((n + 1, len(rows)))
        alpha[0] = beta[n] = 1
        step = {}
        for (i, j), (_, q) in found.items():
            step[i, j] = q = q / np.prod(scale[i:j], axis=0)
            alpha[j] += alpha[i] * q
        top = [np.maximum(a, 1e-300) for a in alpha]
        for (i, j), q in reversed(step.items()):
            beta[i] += beta[j] * q
        for (i, j), (ids, _) in found.items():
            total += np.bincount(np.maximum(ids, 0), alpha[i] * step[i, j] * beta[j] / top[n], len(total))
    return total


def expected_one(vocab: Vocabulary, unit: str, scores: np.ndarray, total: np.ndarray) -> None:
    """Adds the expected uses of one unit's pieces to `total`, by log-space recursions over the whole unit."""
    n, escape = len(unit), len(vocab.pieces)
    into: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]
    for j in range(1, n + 1):
        for i in range(max(0, j - vocab.longest), j):
            if (k := vocab.ids.get(unit[i:j], escape if i == j - 1 else -1)) >= 0:
                into[j].append((i, k))
    alpha, beta = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    alpha[0] = beta[n] = 0
    for j in range(1, n + 1):
        alpha[j] = np.logaddexp.reduce([alpha[i] + scores[k] for i, k in into[j]])
    for j in range(n, 0, -1):
        for i, k in into[j]:
            beta[i] = np.logaddexp(beta[i], beta[j] + scores[k])
            total[k] += np.exp(alpha[i] + scores[k] + beta[j] - alpha[n])
