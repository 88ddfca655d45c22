"""SentencePiece encoding and decoding: k distinct sampled segmentations a text, without replacement.

A text is cut into units (a word with the mark of the space before it, a run of line feeds, ...); no piece crosses a
unit's border, so the lattice of the text is the chain of its units' lattices. Its paths' probabilities p are
given by the vocabulary's scores. Gumbel top-k: each path's log p gets independent Gumbel noise, and the k paths of
the greatest perturbed values are a sample without replacement. They are found without listing paths, by
best-first (A-star) search from the root with an exact bound: the greatest perturbed value below a node is itself
Gumbel-distributed around the log mass of the node's paths, so a child's value is drawn given its parent's (the best
child inherits it, the others' noise is truncated at it). The path on which the value is inherited is a plain sample
of the text's distribution, drawn forwards with the units' backward sums, for all units of a batch at once (with the
unit's own probability it takes the unit's greedy path, else it leaves that at a drawn step); the nodes that
branch off it enter the queue. Popping the queue's best gives the next path: the same up to the branch,
new behind it.

The noise of a 53-bit uniform number lies between -LEAST_NOISE and MOST_NOISE. So the k largest masses among the first
branches bound the k-th best value from below, and a branch whose log mass lies MOST_NOISE below the bound can't win; only
the first branches of a long text are looked at, and none that matters is lost.

`inclusion` is the log of the probability that the path would be among the sample, given the threshold (the
greatest value left in the queue): log(1 - exp(-exp(log p - threshold))); it is 0 if there is no path left.

All randomness is a hash of the seed, the row's key and the draw's place, sample, purpose and step, a field each: the same
whatever the partition, the batch or a repeated run, and no number is used twice in a text. Characters that are no piece are spelled as byte pieces. Decoding is exact: pieces join
to the text, a space being written as the mark, and the mark itself as its bytes.

Defined results: null and empty texts have one segmentation, without pieces, of probability 1. A text with fewer
than k segmentations gives all of them. Rows that repeat get the same samples. A null key is a key like others. Paths
never tie but with a probability of 2 ** -53 a draw; the earlier branch is then first. An empty table gives an empty result. `samples`, and `exact` with
`check`, replace columns of those names; other columns stay. A very long text is sampled as a whole: a batch holds
BATCH_CHARS characters or one text, at some 100 bytes a character of it.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lattice import LONG, MARK, Vocabulary, arcs, by_length, load_pieces, log_sum, tokenizer_path
from .words import mixed, sliced

K = 2
#: -log(2 ** -54), above any noise that a uniform number with 53 bits can give.
MOST_NOISE = 37.5
#: log(-log(2 ** -54)) and log(2), for the truncation, rounded up.
LEAST_NOISE = 4.4
#: Steps whose branches give the first bound.
FIRST_STEPS = 64
#: How far below the least piece's score the escape to bytes lies.
ESCAPE = 10.0
#: Characters of texts that are sampled together, about.
BATCH_CHARS = 3 << 20
#: Stands for the mark inside a text, which has no piece: a surrogate, so no text has it.
HIDDEN = "\ud800"
UNIT = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n+")


@dataclass
class Encoder:
    vocabulary: Vocabulary
    first_byte: int

    def __post_init__(self):
        spelt = [p.replace(MARK, " ").encode() for p in self.vocabulary.pieces]
        spelt[self.first_byte : self.first_byte + 256] = [bytes([i]) for i in range(256)]
        self.spelt = np.frombuffer(b"".join(spelt), np.uint8)
        self.sizes = np.array([len(b) for b in spelt], np.int32)
        self.packed_as = np.dtype("<u2" if len(spelt) <= 1 << 16 else "<u4")
        self.begins = (np.cumsum(self.sizes) - self.sizes).astype(np.int32)

    def decoded(self, ids: list[np.ndarray]) -> list[bytes]:
        """The UTF-8 texts of arrays of piece ids, all at once."""
        every = np.concatenate([np.empty(0, np.int32), *ids])
        sizes = self.sizes[every]
        ends = np.cumsum(sizes, dtype=np.int64)
        kind = np.int32 if ends[-1:].sum() < 2**31 - 1 else np.int64
        places = np.repeat((self.begins[every] - (ends - sizes)).astype(kind), sizes)
        places += np.arange(len(places), dtype=kind)
        text = self.spelt[places].tobytes()
        cuts = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)].tolist()
        return [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def decode(self, ids) -> str:
        """The text of piece ids."""
        return self.decoded([np.asarray(ids, np.int32)])[0].decode("utf-8", "replace")

    def spelled(self, char: int) -> list[int]:
        """The byte pieces of a code point."""
        return [self.first_byte + b for b in (MARK if char == ord(HIDDEN) else chr(char)).encode("utf-8", "surrogatepass")]


def encoder(path: str | None = None) -> Encoder:
    pieces, scores, first_byte = load_pieces(path or tokenizer_path())
    return Encoder(Vocabulary(pieces, scores, float(scores[np.isfinite(scores)].min()) - ESCAPE), first_byte)


def units_of(text: str) -> list[str]:
    return UNIT.findall(text.replace(MARK, HIDDEN).replace(" ", MARK))


class Lattices:
    """The lattices of distinct units as one machine: a state is a unit and a position in it.

    State s has the arcs at[s] to at[s + 1], the likeliest first, each with a piece, a next state, and its log
    probability among all ways on from s. `edge` has, by arc, the state's number plus the cumulative probability
    up to the arc. A unit's greedy path takes each state's first arc: its arcs are greedy[way[u]] to
    greedy[way[u + 1]], its probability is stay[u], and `leave` has, by step, the unit's number plus the
    cumulative probability of having left the greedy path at that step or before.
    """

    def __init__(self, vocab: Vocabulary, units: list[str]):
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        self.first = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]
        self.last = self.first + lengths
        escape = len(vocab.pieces)
        states, pieces, nexts, shares_, spells = [], [], [], [], []
        plain = np.exp(vocab.scores)
        for rows, chars in by_length(units):
            n = chars.shape[1]
            found = arcs(vocab, chars) if n <= LONG else long_arcs(vocab, units, rows)
            share = shares(found, n, vocab.scores, plain)
            bases = self.first[rows].astype(np.int32)
            for (i, j), ids in found.items():
                p, base, spell = share[i, j], bases, None
                if j == i + 1:  # there for all units
                    spell = np.where(ids == escape, chars[:, i], 0)
                else:
                    has = np.flatnonzero(ids >= 0)
                    ids, p, base = ids[has], p[has], bases[has]
                states.append(base + np.int32(i))
                nexts.append(base + np.int32(j))
                pieces.append(ids)
                shares_.append(p)
                spells.append(np.zeros(len(ids), np.int32) if spell is None else spell)
        join = lambda x, kind: np.concatenate(x).astype(kind) if x else np.empty(0, kind)
        state, p = join(states, np.int32), join(shares_, np.float64)
        order = np.argsort(state - 0.9 * p)  # by state, then by probability from the greatest
        self.state, p = state[order], np.maximum(p[order], 1e-300)
        self.log = np.log(p)
        self.piece, self.spell = (join(x, np.int32)[order] for x in (pieces, spells))
        self.next = join(nexts, np.int32)[order]
        total = int(self.last[-1]) + 1 if len(units) else 0
        self.at = np.concatenate([[0], np.cumsum(np.bincount(state, minlength=total))])
        run = np.cumsum(p)
        before = np.repeat(np.concatenate([[0], run])[self.at[:-1]], np.diff(self.at))
        self.edge = self.state + np.minimum(run - before, 1 - 1e-12)
        ends = self.at[1:][np.diff(self.at) > 0] - 1
        self.edge[ends] = self.state[ends] + 1  # an arc is found for every number below 1

        taken, alive, now = [], np.arange(len(units)), self.first.copy()
        while len(alive):
            arc = self.at[now[alive]]
            taken.append((alive, arc))
            now[alive] = self.next[arc]
            alive = alive[now[alive] != self.last[alive]]
        self.way, self.greedy = scattered(taken, np.zeros(len(units), np.int64))
        unit = np.repeat(np.arange(len(units)), np.diff(self.way))
        through = np.cumsum(self.log[self.greedy])
        reached = through - np.concatenate([[0], through])[self.way[unit]]
        self.stay = np.exp(reached[self.way[1:] - 1]) if len(units) else np.empty(0)
        self.leave = unit + np.minimum(-np.expm1(reached), 1 - 1e-12)


def shares(found: dict, n: int, scores: np.ndarray, plain: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
    """Each arc's probability among the ways on from its start, for units of length n: by products of plain
    probabilities, or of logs where those would be too small to tell."""
    first = next(iter(found.values()))
    beta = np.zeros((n + 1, len(first)))
    beta[n] = 1
    chances = {at: plain[ids] for at, ids in found.items()}
    for (i, j), q in reversed(chances.items()):  # from the last start on, so that beta[j] is complete
        beta[i] += q * beta[j]
    if beta.min() > 1e-280:
        return {(i, j): q * beta[j] / beta[i] for (i, j), q in chances.items()}
    onward: dict = {}
    for (i, j), ids in found.items():
        onward.setdefault(i, []).append((j, ids))
    logs = np.full((n + 1, len(first)), -np.inf)
    logs[n] = 0
    for i, out in sorted(onward.items(), reverse=True):
        logs[i] = log_sum([logs[j] + scores[ids] for j, ids in out])
    return {(i, j): np.exp(scores[ids] + logs[j] - logs[i]) for (i, j), ids in found.items()}


def scattered(steps: list[tuple[np.ndarray, np.ndarray]], before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, values) by row of steps given as (rows, values) in turn; `before` leaves room ahead of each row."""
    counts = before.copy()
    for rows, _ in steps:
        counts[rows] += 1
    offsets = np.concatenate([[0], np.cumsum(counts)])
    out, at = np.empty(offsets[-1], np.int64), offsets[:-1] + before
    for rows, values in steps:
        out[at[rows]] = values
        at[rows] += 1
    return offsets, out


def ramps(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... sizes[i] numbers for each i, in a row."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def long_arcs(vocab: Vocabulary, units: list[str], rows: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
    """As `arcs`, by dictionary: for units so long that few have their length."""
    escape, found = len(vocab.pieces), {}
    for r, row in enumerate(rows):
        u = units[row]
        for i in range(len(u)):
            for j in range(i + 1, min(len(u), i + vocab.longest) + 1):
                k = vocab.ids.get(u[i:j], escape if j == i + 1 else -1)
                if k >= 0:
                    found.setdefault((i, j), np.full(len(rows), -1))[r] = k
    return dict(sorted(found.items()))


#: Odd multipliers of a draw's fields: key, place, sample, purpose, step, branch.
FIELDS = (1, 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7, 0x2545F4914F6CDD1D, 0xD6E8FEB86659FD93)
#: What a draw is for. Each has its own field, so that no two draws of a text share their number however long it is.
ROOT, LEAVE, WALK, BRANCH, TAIL = range(5)


def uniform(*fields: np.ndarray | int) -> np.ndarray:
    """A number between 0 and 1 for each draw, from a hash of its fields; the first is a hash itself."""
    h, fixed = np.zeros(1, np.uint64), 0
    for x, c in zip(fields, FIELDS, strict=False):
        if isinstance(x, int):
            fixed += x * c
        else:
            h = h + x.astype(np.uint64) * np.uint64(c)
    return ((mixed(h + np.uint64(fixed % 2**64)) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def paths(lat: Lattices, units: np.ndarray, keys: np.ndarray, place: np.ndarray, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """A sampled path through each unit: (offsets, arcs), unit u's arcs being offsets[u] to offsets[u + 1]."""
    u = uniform(keys, place, sample, LEAVE)
    kept = np.diff(lat.way)[units]  # steps on the greedy path
    rows = np.flatnonzero(u >= lat.stay[units])
    steps = []
    if len(rows):
        at = lat.way[units[rows]]
        left = np.clip(np.searchsorted(lat.leave, units[rows] + u[rows] - lat.stay[units[rows]], side="right"), at, lat.way[units[rows] + 1] - 1)
        kept[rows] = left - at
        first = lat.greedy[left]
        state = lat.state[first]
        p = np.exp(lat.log[first])
        other = state + p + uniform(keys[rows], place[rows], sample, WALK, 0) * (1 - p)
        arc = np.clip(np.searchsorted(lat.edge, other, side="right"), np.minimum(first + 1, lat.at[state + 1] - 1), lat.at[state + 1] - 1)
        end = lat.last[units[rows]]
        while True:
            steps.append((rows, arc))
            state = lat.next[arc]
            on = state != end
            rows, state, end = rows[on], state[on], end[on]
            if not len(rows):
                break
            arc = np.searchsorted(lat.edge, state + uniform(keys[rows], place[rows], sample, WALK, len(steps)), side="right")
    offsets, out = scattered(steps, kept)
    out[ramps(offsets[:-1], kept)] = lat.greedy[ramps(lat.way[units], kept)]
    return offsets, out


def gumbel_below(top: np.ndarray, location: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel values around `location`, truncated to lie below `top`: exp(-v) = exp(-top) - log(u) * exp(-location)."""
    with np.errstate(over="ignore"):
        return -np.logaddexp(-top, np.log(-np.log(u)) - location)


def masses(lat: Lattices, path: np.ndarray, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(step, arc, log mass) of the nodes that leave the path, whose steps' log masses are `logs`."""
    state = lat.state[path]
    first = lat.at[state]
    width = lat.at[state + 1] - first
    arc, step = ramps(first, width), np.repeat(np.arange(len(path)), width)
    off = np.flatnonzero(arc != path[step])
    step, arc = step[off], arc[off]
    return step, arc, logs[step] + lat.log[arc]


def greatest(score: np.ndarray, of: np.ndarray, most: int) -> list[np.ndarray]:
    """The places of the greatest score of each group, of the second greatest, ... of the groups that have so many;
    `of` has the groups in a row. Of equal scores the first is the greater."""
    if most > 4:
        order = np.lexsort((-score, of))
        begins = np.flatnonzero(np.diff(of[order], prepend=-1))
        sizes = np.diff(np.append(begins, len(of)))
        return [order[begins[sizes > r] + r] for r in range(min(most, sizes.max(initial=0)))]
    out, score, of = [], score.copy(), of.astype(np.int64)
    begins = np.flatnonzero(np.diff(of, prepend=-1))
    while len(begins) and len(out) < most:
        sizes = np.diff(np.append(begins, len(of)))
        top = np.maximum.reduceat(score, begins)
        at = np.flatnonzero(score == np.repeat(top, sizes))
        at = at[np.diff(of[at], prepend=-1) > 0]
        at = at[score[at] > -np.inf]
        if not len(at):
            break
        out.append(at)
        score[at] = -np.inf
    return out


def branches(lat: Lattices, rest: list[np.ndarray], start: np.ndarray, phi: np.ndarray, top: np.ndarray, keys: np.ndarray, sample: int, least: np.ndarray, most: int) -> list[list]:
    """For each path of several texts the `most` best nodes above `least` that leave it: (-value, log mass, step, arc).

    `rest` has the paths' arcs from their steps `start` on, `phi` the log masses there, `top` the paths' values.
    """
    sizes = np.array([len(x) for x in rest])
    out: list[list] = [[] for _ in rest]
    if not sizes.sum():
        return out
    path, text = np.concatenate(rest), np.repeat(np.arange(len(rest)), sizes)
    first = (np.cumsum(sizes) - sizes)[text]
    # Summed text by text, so that the last digits don't depend on the batch.
    logs = np.concatenate([np.cumsum(np.concatenate([[p], lat.log[x[:-1]]])) for x, p in zip(rest, phi, strict=True) if len(x)])
    place = np.arange(len(path)) - first

    def left(at: np.ndarray):
        step, arc, mass = masses(lat, path[at], logs[at])
        return at[step], arc, mass

    step, arc, mass = left(np.flatnonzero(place < FIRST_STEPS))
    ranks = greatest(mass, text[step], most)
    bound = ranks[-1] if len(ranks) == most else np.empty(0, np.int64)
    least = least.copy()
    at = text[step[bound]]
    least[at] = np.maximum(least[at], np.minimum(top[at], mass[bound]) - LEAST_NOISE)
    # Log masses only fall along a path: these are all steps whose branches can matter.
    step, arc, mass = left(np.flatnonzero(logs > least[text] - MOST_NOISE))
    near = np.flatnonzero(mass > least[text[step]] - MOST_NOISE)
    step, arc, mass = step[near], arc[near], mass[near]
    of = text[step]
    which = arc - lat.at[lat.state[arc]]
    value = gumbel_below(top[of], mass, uniform(keys[of], place[step] + start[of], sample, BRANCH, 0, which))
    best = np.concatenate([np.empty(0, np.int64), *greatest(value, of, most)])
    best = best[value[best] > least[of[best]]]
    for t, *node in zip(of[best].tolist(), (-value[best]).tolist(), mass[best].tolist(), (place[step[best]] + start[of[best]]).tolist(), arc[best].tolist(), strict=True):
        out[t].append(tuple(node))
    return out


def rest_of_unit(lat: Lattices, state: int, end: int, key: int, place: int, sample: int) -> list[int]:
    """A sampled path from a state inside a unit to the unit's end."""
    out = []
    while state != end:
        u = float(uniform(key, place, sample, TAIL, len(out))[0])
        out.append(int(np.searchsorted(lat.edge, state + u, side="right")))
        state = int(lat.next[out[-1]])
    return out


def piece_ids(enc: Encoder, lat: Lattices, path: np.ndarray) -> np.ndarray:
    got, escape = lat.piece[path], len(enc.vocabulary.pieces)
    at = np.flatnonzero(got == escape)
    if not len(at):
        return got.astype(np.int32)
    chars = lat.spell[path[at]]
    if (chars < 128).all():
        got[at] = enc.first_byte + chars
        return got.astype(np.int32)
    spelled = [enc.spelled(int(c)) for c in chars]
    got = np.insert(got, np.repeat(at + 1, [len(x) - 1 for x in spelled]), 0)
    sizes = np.array([len(x) for x in spelled])
    got[ramps(at + np.cumsum(sizes - 1) - (sizes - 1), sizes)] = np.concatenate(spelled)
    return got.astype(np.int32)


class Numbers(dict):
    """Numbers keys as they first come."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


class Search:
    """The search over one text's lattice."""

    def __init__(self, lat: Lattices, numbers: np.ndarray, key: int, k: int):
        self.lat, self.numbers, self.key, self.k = lat, numbers, key, k
        root = -math.log(-math.log(float(uniform(key, 0, 0, ROOT)[0])))
        self.queue, self.found = [(-root, 0.0, 0, -1, None)], []

    def next_units(self) -> np.ndarray | None:
        """Pops the next path's node; the places of the units that are to be drawn anew behind it."""
        if not self.queue or len(self.found) == self.k:
            return None
        self.node = self.queue.pop(0)
        _, _, step, arc, parent = self.node
        if parent is None:
            self.where = -1
        else:
            self.where = int(np.searchsorted(parent[0], step, side="right")) - 1  # the unit that has the branch
        return np.arange(self.where + 1, len(self.numbers))

    def complete(self, offsets: np.ndarray, arcs_: np.ndarray) -> None:
        """Takes the drawn units: the path is what comes before the branch, the branch, the rest of its unit, and they."""
        lat, (negative, _, step, arc, parent) = self.lat, self.node
        if parent is None:
            self.begin, head, path = 0, np.empty(0, np.int64), arcs_
        else:
            unit = self.numbers[self.where]
            tail = rest_of_unit(lat, int(lat.next[arc]), int(lat.last[unit]), self.key, self.where, len(self.found))
            self.begin, head = step + 1, parent[0][: self.where + 1]
            path = np.concatenate([parent[1][:step], [arc], tail, arcs_]).astype(np.int64)
        self.offsets = np.concatenate([head, offsets + len(path) - len(arcs_)])
        self.found.append((path, float(lat.log[path].sum()), -negative))

    def least(self, most: int) -> float:
        """What a new node must exceed to be among the `most` best of the queue."""
        return -self.queue[most - 1][0] if len(self.queue) >= most else -math.inf

    def extend(self, nodes: list, most: int) -> None:
        path = (self.offsets, self.found[-1][0])
        self.queue = sorted(self.queue + [(*x, path) for x in nodes], key=lambda x: x[:4])[:most]


def sample_batch(enc: Encoder, texts: list[str], keys: list[int], k: int):
    """For each text a list of up to k (ids, log p, perturbed value), best first, and the threshold (None: none left)."""
    index = Numbers()
    numbers = [np.array(list(map(index.__getitem__, units_of(t))), np.int64) for t in texts]
    lat = Lattices(enc.vocabulary, list(index))
    searches = [Search(lat, n, key, k) for n, key in zip(numbers, keys, strict=True)]
    for sample in range(k):
        due = [(s, places) for s in searches if (places := s.next_units()) is not None]
        if not due:
            break
        sizes = np.array([len(p) for _, p in due])
        units = np.concatenate([s.numbers[p] for s, p in due])
        key_of = np.repeat(np.array([s.key for s, _ in due], np.uint64), sizes)
        offsets, drawn = paths(lat, units, key_of, np.concatenate([p for _, p in due]), sample)
        cuts = np.concatenate([[0], np.cumsum(sizes)])
        for (s, _), lo, hi in zip(due, cuts, cuts[1:], strict=False):
            s.complete(offsets[lo : hi + 1] - offsets[lo], drawn[offsets[lo] : offsets[hi]])
        # What can still matter in a queue: the paths to come and the threshold.
        own, most = [s for s, _ in due], k - sample
        of = lambda get, kind=np.float64: np.array([get(s) for s in own], kind)  # noqa: B023, E731
        rest = [s.found[-1][0][s.begin :] for s in own]
        nodes = branches(lat, rest, of(lambda s: s.begin, np.int64), of(lambda s: s.node[1]), of(lambda s: s.found[-1][2]), of(lambda s: s.key, np.uint64), sample, of(lambda s: s.least(most)), most)  # noqa: B023
        for s, x in zip(own, nodes, strict=True):
            s.extend(x, most)
    return [([(piece_ids(enc, lat, p), lp, v) for p, lp, v in s.found], -s.queue[0][0] if s.queue else None) for s in searches]


def inclusion(log_p: float, threshold: float | None) -> float:
    """log(1 - exp(-exp(log_p - threshold)))."""
    if threshold is None:
        return 0.0
    x = log_p - threshold
    return x if x < -30 else math.log(-math.expm1(-math.exp(min(x, 700.0))))


def row_key(seed: int, key) -> int:
    return xxhash.xxh3_64_intdigest(f"{seed}:{key}".encode())


SAMPLES_DDL = "array<struct<ids: array<int>, log_p: double, value: double, inclusion: double>>"


def offsets_of(sizes) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))


def packed(enc: Encoder, ids: list[np.ndarray]) -> pa.Array:
    """Arrays of piece ids as binary values: little-endian, of 16 bits where the vocabulary's ids fit, else of 32."""
    every = np.concatenate(ids).astype(enc.packed_as)
    ends = np.cumsum([len(x) for x in ids]) * every.itemsize
    offsets = np.concatenate([[0], ends])
    kind, width = (pa.binary(), np.int32) if ends[-1] < 2**31 else (pa.large_binary(), np.int64)
    return pa.Array.from_buffers(kind, len(ids), [None, pa.py_buffer(offsets.astype(width).tobytes()), pa.py_buffer(every.tobytes())])


def unpacked(enc: Encoder, ids: bytes) -> np.ndarray:
    return np.frombuffer(ids, enc.packed_as).astype(np.int32)


def sampled(shared, batches: Iterator[pa.RecordBatch], key: str, text: str, k: int, seed: int, with_decoded: bool):
    """(batch, texts' numbers of samples, arrays of ids, columns of log_p, value, inclusion, exact or None) by slices."""
    enc = shared.value
    for batch in sliced(batches, text, BATCH_CHARS):
        texts = [t or "" for t in batch[text].to_pylist()]
        found = sample_batch(enc, texts, [row_key(seed, x) for x in batch[key].to_pylist()], k)
        ids = [i for own, _ in found for i, _, _ in own]
        figures = [(lp, v, inclusion(lp, threshold)) for own, threshold in found for _, lp, v in own]
        columns = [pa.array([x[i] for x in figures], pa.float64()) for i in range(3)]
        sizes, exact = [len(own) for own, _ in found], None
        if with_decoded:
            decoded = iter(enc.decoded(ids))
            exact = [all([next(decoded) == raw for _ in range(n)]) for raw, n in zip((t.encode() for t in texts), sizes, strict=True)]
        yield batch, sizes, ids, columns, exact


def encode_rows(shared, key: str, text: str, k: int, seed: int, with_decoded: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sizes, ids, columns, exact in sampled(shared, batches, key, text, k, seed, with_decoded):
            lists = pa.ListArray.from_arrays(offsets_of([len(x) for x in ids]), pa.array(np.concatenate(ids), pa.int32()))
            rows = pa.StructArray.from_arrays([lists, *columns], ["ids", "log_p", "value", "inclusion"])
            added = [pa.ListArray.from_arrays(offsets_of(sizes), rows)] + ([pa.array(exact)] if with_decoded else [])
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, "samples", *["exact"] * with_decoded])

    return run


def sample_rows(shared, key: str, text: str, k: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sizes, ids, columns, exact in sampled(shared, batches, key, text, k, seed, True):
            row = np.repeat(np.arange(len(sizes)), sizes)
            rank = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            n = [len(x) for x in ids]
            yield pa.RecordBatch.from_arrays([batch[key].take(pa.array(row)), pa.array(rank, pa.int32()), pa.array(n, pa.int64()), packed(shared.value, ids), *columns, pa.array(np.array(exact, bool)[row])], [key, "rank", "n_pieces", "ids", "log_p", "value", "inclusion", "exact"])

    return run


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, seed: int = 1, path: str | None = None, check: bool = False) -> DataFrame:
    """`docs` with `samples`: up to k distinct segmentations of the text, best first; with `check` also `exact`,
    whether each of them decodes to the text."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in {"samples", *["exact"] * check} and c not in (key, text)])
    shared = docs.sparkSession.sparkContext.broadcast(encoder(path))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(encode_rows(shared, key, text, k, seed, check), f"{fields}, samples {SAMPLES_DDL}" + ", exact boolean" * check)


def decode(encoded: DataFrame, ids: str = "ids", path: str | None = None) -> DataFrame:
    """`encoded` with `decoded`: the text of an array of piece ids, or of packed ones; null for null."""
    shared = encoded.sparkSession.sparkContext.broadcast(encoder(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch[ids].to_pylist()
            texts = iter(shared.value.decoded([unpacked(shared.value, x) if isinstance(x, bytes) else np.array(x, np.int32) for x in lists if x is not None]))
            out = [None if x is None else next(texts).decode("utf-8", "replace") for x in lists]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*batch.schema.names, "decoded"])

    encoded = encoded.drop(*[c for c in encoded.columns if c.lower() == "decoded" and c != ids])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(run, f"{fields}, decoded string")


def samples_of(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, seed: int = 1, path: str | None = None) -> DataFrame:
    """A row for each sample: the text's key, the sample's rank, piece ids and scores, and whether its text's samples all decode to the text.

    The ids are packed (see `packed`), which `decode` reads too: as array cells they cost more to write than to sample.
    """
    shared = docs.sparkSession.sparkContext.broadcast(encoder(path))
    docs = docs.select(key, text)
    own = f"`{key}` {docs.schema[key].dataType.simpleString()}"
    return docs.mapInArrow(sample_rows(shared, key, text, k, seed), f"{own}, rank int, n_pieces long, ids binary, log_p double, value double, inclusion double, exact boolean")
