"""Benchmark decontamination by the q-gram lemma: count shared q-grams in diagonal bands, then align.

A benchmark item of m characters occurs in a text with at most e = floor(m * RATE) edits. By the q-gram lemma the
occurrence shares at least m - q + 1 - q * e of the item's q-grams with the text, and all on diagonals (place in the
text minus place in the item) within e of each other. So hits are counted in bands of 2 * (e + 1) diagonals which overlap
by half, such that any e + 1 neighbouring diagonals lie in one band; bands below the bound can't hold an
occurrence and are dropped. The text under each remaining band is aligned with the item (edit distance with free ends
in the text, computed within the band's diagonals), which decides.

Both sides are normalised alike, character by character: lower case, runs of anything but letters and digits as one
space; so layout and punctuation don't hide a passage. Items of fewer than LEAST normalised characters occur only exactly, as whole
words; those of fewer than Q are looked up by the hash of the whole item. `shortest` leaves out items of fewer
normalised characters than that, whose occurrences are no evidence; by default none. An item that isn't found whole is
also sought by its parts: the least runs of neighbouring sentences and lines that have LEAST_PART characters or more, so
that any run of them as long has a part. Those are items of their own, reported with `part`, from 0 up; the whole item has
part -1. A piece of a single sentence is no part.

Per distinct q-gram the index has the places in all items; q-grams beyond FREQUENT places are not looked up, and each
item's bound is lowered by the number of its q-grams that are not, so none is lost; where that leaves a bound below 1,
all of that item's q-grams are looked up. The items are taken in blocks of at most BLOCK_CHARS characters of items and parts (one
item at least), each of which is a pass over the documents with an index of that size on the executors, whose results are
written before the next pass begins; so one block at a time is in memory, on the driver too, however large the benchmark.
A benchmark of one block is a single pass. Documents never move: there is no shuffle.

Defined results: null and empty texts, and null items, have no occurrence; nor have items without a letter or digit. Rows that
repeat, or have a null id, are each searched; equal items are each reported. Of an item's occurrences that overlap the best
is reported: the fewest edits, then the first, then the shortest. `first` and `end` are places in the normalised text. Without documents, or
without items, there is no occurrence. A very long text is searched whole, by itself, in memory that follows its length. Other columns of the
documents stay, whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, free_name, written
from .lattice import SPREAD, code_points

Q, RATE = 8, 0.08
LEAST, LEAST_PART = 40, 60
FREQUENT, BLOCK_CHARS = 256, 4_000_000
#: q-grams are hashed by doubling, so Q is a power of two.
BASE = 0x9E3779B97F4A7C15
SLOTS = 20
#: Characters of texts that are searched together.
CHUNK_CHARS = 1 << 20
SPACE = np.uint32(32)
#: Where an item's parts end: at line feeds, and at marks that end a sentence.
PART_END = re.compile(r"\n+|(?<=[.!?])\s+")


_plain = np.empty(0, np.uint32)


def plain_table() -> np.ndarray:
    """For each code point of the first plane its lower-case form, or a space if it is no letter or digit. 0 stays."""
    global _plain
    if not len(_plain):
        low = [c.lower() if (c := chr(i)).isalnum() else " " for i in range(1 << 16)]
        table = np.array([ord(c) if len(c) == 1 else i for i, c in enumerate(low)], np.uint32)
        table[0] = 0
        _plain = table
    return _plain


def normalised(codes: np.ndarray) -> np.ndarray:
    """Code points in normal form. A 0 separates texts: a space beside it goes too."""
    if not len(codes):
        return codes
    if codes.max() < 1 << 16:
        out = plain_table()[codes]
    else:
        out, first = codes.copy(), codes < 1 << 16
        out[first] = plain_table()[codes[first]]
        beyond, where = np.unique(codes[~first], return_inverse=True)
        low = [ord(c.lower()) if c.isalnum() and len(c.lower()) == 1 else ord(c) if c.isalnum() else 32 for c in map(chr, beyond.tolist())]
        out[~first] = np.array(low, np.uint32)[where]
    gap, nothing = out == SPACE, out == 0
    out = out[~(gap & np.concatenate([[True], (gap | nothing)[:-1]]))]
    if not len(out):
        return out
    last = np.flatnonzero(np.concatenate([out[1:] == 0, [True]]))
    return np.delete(out, last[out[last] == SPACE])


def normal(text: str | None) -> np.ndarray:
    return normalised(code_points((text or "").replace("\0", " ")))


def qgrams(codes: np.ndarray) -> np.ndarray:
    h, have = codes.astype(np.uint64), 1
    if len(h) < Q:
        return np.empty(0, np.uint64)
    while have < Q:
        h, have = h[:-have] * np.uint64(pow(BASE, have, 2**64)) + h[have:], 2 * have
    h *= SPREAD
    return h


def parts_of(text: str) -> list[tuple[int, np.ndarray]]:
    """(part, normalised text): the whole as -1, then the least runs of its sentences and lines that are long enough."""
    whole = normal(text)
    found = [(-1, whole)] if len(whole) else []
    pieces = [p for p in (normal(x) for x in PART_END.split(text or "")) if len(p)]
    ends = np.cumsum([len(p) + 1 for p in pieces])  # with the space behind each
    runs: list[tuple[int, int]] = []
    for i, p in enumerate(pieces):
        j = int(np.searchsorted(ends, ends[i] - len(p) + LEAST_PART))
        if j == len(pieces):
            break
        if runs and runs[-1][1] == j:
            runs.pop()  # it holds the run that begins here
        runs.append((i, j))
    joined = [np.concatenate([x for p in pieces[i : j + 1] for x in ([SPACE], p)][1:]).astype(np.uint32) for i, j in runs]
    return found + [(i, p) for i, p in enumerate(joined) if len(p) != len(whole)]


@dataclass
class Index:
    names: list  # (item_id, part)
    texts: list[np.ndarray]
    edits: np.ndarray
    needed: np.ndarray
    grams: np.ndarray  # sorted
    at: np.ndarray  # of each gram its places: at[i] to at[i + 1]
    item: np.ndarray
    place: np.ndarray
    slots: np.ndarray  # whether any gram has these first bits
    brief: dict[int, list[int]]  # items of fewer than Q characters, by length


def index_of(items: list[tuple], shortest: int = 1) -> Index:
    names, texts, brief = [], [], {}
    for item_id, text in items:
        for part, t in parts_of(text):
            if len(t) < shortest:
                continue
            if len(t) < Q:
                brief.setdefault(len(t), []).append(len(names))
            names.append((item_id, part))
            texts.append(t)
    sizes = np.array([len(t) for t in texts], np.int64)
    edits = np.where(sizes < LEAST, 0, np.floor(sizes * RATE)).astype(np.int64)
    grams = [qgrams(t) for t in texts]
    every = np.concatenate(grams) if grams else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(texts)), [len(g) for g in grams])
    place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.empty(0, np.int64)
    _, where, count = np.unique(every, return_inverse=True, return_counts=True)
    frequent = count[where] > FREQUENT if len(every) else np.empty(0, bool)
    bound = sizes - Q + 1 - Q * edits
    skipped = np.bincount(owner, frequent, len(texts)).astype(np.int64)
    needs_all = bound - skipped < 1
    used = ~frequent | needs_all[owner] if len(every) else frequent
    needed = np.where(sizes < Q, 1 << 40, np.maximum(bound - np.where(needs_all, 0, skipped), 1))
    every, owner, place = every[used], owner[used], place[used]
    order = np.argsort(every, kind="stable")
    distinct, first = np.unique(every[order], return_index=True)
    slots = np.zeros(1 << SLOTS, bool)
    slots[distinct >> np.uint64(64 - SLOTS)] = True
    return Index(names, texts, edits, needed, distinct, np.append(first, len(every)), owner[order], place[order], slots, brief)


def aligned(t: np.ndarray, p: np.ndarray, low: int, high: int, edits: int) -> tuple[int, int, int] | None:
    """(edits, first, end) of the item's best occurrence in the text on diagonals low to high, or None if that
    takes more edits. Ties: the shortest occurrence on the least diagonal."""
    width, far, pack = high - low + 1, np.int64(1 << 61), np.int64(1 << 32)
    # Row i, column d: the item's first i characters end on diagonal low + d, at place i + low + d of the text.
    # A cell's number holds the cost and, for ties, how late it began, so that the least is the best.
    diagonals = np.arange(low, high + 1)
    start = np.where((diagonals >= 0) & (diagonals <= len(t)), diagonals, -1)
    row = np.where(start >= 0, pack - 1 - start, far)
    steps = np.arange(width) * pack
    for i in range(1, len(p) + 1):
        at = diagonals + i  # the place behind the character used
        inside = (at >= 1) & (at <= len(t))
        same = np.zeros(width, bool)
        same[inside] = t[at[inside] - 1] == p[i - 1]
        new = row + np.where(same, 0, pack)  # a match or a replaced character, on the same diagonal
        new[:-1] = np.minimum(new[:-1], row[1:] + pack)  # the item's character is missing in the text
        new[(at < 0) | (at > len(t))] = far
        # A character too many in the text moves right within the row; a running minimum does all of them.
        new = np.minimum.accumulate(new - steps) + steps
        new[(at < 0) | (at > len(t))] = far
        row = new
        if row.min() // pack > edits:
            return None
    d = int(np.argmin(row // pack))
    cost = int(row[d] // pack)
    return (cost, int(pack - 1 - row[d] % pack), int(len(p) + low + d)) if cost <= edits else None


def candidates(index: Index, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, item, diagonal) of the hits of normalised text."""
    h = qgrams(codes)
    maybe = np.flatnonzero(index.slots[h >> np.uint64(64 - SLOTS)])
    at = np.minimum(np.searchsorted(index.grams, h[maybe]), len(index.grams) - 1)
    same = index.grams[at] == h[maybe]
    hit, at = maybe[same], at[same]
    lo, n = index.at[at], index.at[at + 1] - index.at[at]
    entry = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
    place = np.repeat(hit, n)
    return place, index.item[entry], place - index.place[entry]


def located(index: Index, text: np.ndarray, item: np.ndarray, diagonal: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(item, edits, first, end): the items' occurrences in one text, each item's best first, from the text's hits."""
    enough = np.bincount(item, minlength=len(index.texts)) >= index.needed
    some = enough[item]
    item, diagonal = item[some], diagonal[some]
    if not len(item):
        return []
    # Band b holds the diagonals b * step to (b + 2) * step - 1, from the least one on.
    step, base = index.edits[item] + 1, -max(len(t) for t in index.texts) - 1
    band = (diagonal - base) // step
    names, counts = np.unique(np.concatenate([item << 40 | band, item << 40 | band - 1]), return_counts=True)
    which = names >> 40
    found: dict[int, set[tuple[int, int, int]]] = {}
    for k in np.flatnonzero(counts >= index.needed[which]):
        i, e = int(which[k]), int(index.edits[which[k]])
        low = base + int(names[k] & (1 << 40) - 1) * (e + 1)
        if len(index.texts[i]) < LEAST:
            found.setdefault(i, set()).update(exactly(text, index.texts[i], low, low + 1))
            continue
        # The occurrence's path stays within e diagonals of its hits.
        best = aligned(text, index.texts[i], low - e, low + 2 * e + 1 + e, e)
        if best:
            found.setdefault(i, set()).add(best)
    return [(i, *x) for i in sorted(found) for x in apart(found[i])]


def exactly(t: np.ndarray, p: np.ndarray, low: int, high: int) -> list[tuple[int, int, int]]:
    """(0, first, end) of the item's exact occurrences as whole words at places low to high."""
    whole = lambda at, end: (not at or t[at - 1] == SPACE) and (end == len(t) or t[end] == SPACE)
    ends = ((at, at + len(p)) for at in range(max(low, 0), min(high, len(t) - len(p)) + 1))
    return [(0, at, end) for at, end in ends if whole(at, end) and np.array_equal(t[at:end], p)]


def brief_places(index: Index, text: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(item, 0, first, end): whole-word occurrences of items too short for a q-gram."""
    out = []
    edges = np.flatnonzero(np.concatenate([[True], text == SPACE, [True]]))  # words lie between neighbouring edges
    for size, items in index.brief.items():
        starts = edges[:-1][np.isin(edges[:-1] + size + 1, edges)]
        if len(starts):
            windows = text[starts[:, None] + np.arange(size)]
            for i in items:
                out += [(i, *x) for x in apart({(0, int(at), int(at) + size) for at in starts[(windows == index.texts[i]).all(1)]})]
    return out


def apart(found: set[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The occurrences (edits, first, end) that overlap no better one that stays, best first."""
    out, firsts, ends = [], [], []
    for edits, first, end in sorted(found):
        at = bisect(firsts, first)
        if (not at or ends[at - 1] <= first) and (at == len(firsts) or end <= firsts[at]):
            out.append((edits, first, end))
            firsts.insert(at, first)
            ends.insert(at, end)
    return out


def search(index: Index, texts: list[str | None]) -> list[list[tuple[int, int, int, int]]]:
    """For each text its occurrences."""
    out: list[list] = [[] for _ in texts]
    if not index.texts or not texts:
        return out
    # A 0 before each text; they mark the texts' starts in the normal form too.
    codes = normalised(code_points("".join("\0" + (t or "").replace("\0", " ") for t in texts)))
    starts = np.flatnonzero(codes == 0)
    ends = np.append(starts[1:], len(codes))
    if len(index.grams):
        place, item, diagonal = candidates(index, codes)
        cuts, least = np.searchsorted(place, np.append(starts, len(codes))), index.needed.min()
        for k in np.flatnonzero(np.diff(cuts)):
            lo, hi = cuts[k], cuts[k + 1]
            if hi - lo >= least:
                out[k] = located(index, codes[starts[k] + 1 : ends[k]], item[lo:hi], diagonal[lo:hi] - starts[k] - 1)
    if index.brief:
        for k, (start, end) in enumerate(zip(starts, ends, strict=True)):
            out[k] = sorted(out[k] + brief_places(index, codes[start + 1 : end]))
    return out


HIT = pa.struct([("item_id", pa.int64()), ("part", pa.int32()), ("edits", pa.int32()), ("first", pa.int64()), ("end", pa.int64())])
HIT_DDL = "struct<item_id: bigint, part: int, edits: int, first: bigint, end: bigint>"


def hit_rows(shared, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            texts, out, at = batch["text"].to_pylist(), [], 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end] or "") <= CHUNK_CHARS):
                    size += len(texts[end] or "")
                    end += 1
                for found in search(index, texts[at:end]):
                    hits = [(*index.names[i], *rest) for i, *rest in found]
                    whole = {h[0] for h in hits if h[1] < 0}
                    out.append([dict(zip(("item_id", "part", "edits", "first", "end"), h, strict=True)) for h in hits if h[1] < 0 or h[0] not in whole])
                at = end
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(HIT))], [*batch.schema.names, name])

    return run


def blocks_of(items: DataFrame, shortest: int = 1) -> Iterator[list[tuple]]:
    """The items in blocks of at most BLOCK_CHARS characters (one item at least)."""
    block, size = [], 0
    for r in items.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null").orderBy("item_id", "text").toLocalIterator():
        own = sum(len(p) for _, p in parts_of(r["text"]) if len(p) >= shortest)
        if block and size + own > BLOCK_CHARS:
            yield block
            block, size = [], 0
        if own:
            block.append((r["item_id"], r["text"]))
            size += own
    if block:
        yield block


def with_hits(docs: DataFrame, block: list[tuple], hits: str, shortest: int) -> DataFrame:
    """`docs` (text, ...) with a new column `hits`: what of a block of items occurs in the text."""
    shared = docs.sparkSession.sparkContext.broadcast(index_of(block, shortest))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(hit_rows(shared, hits), f"{fields}, {hits} array<{HIT_DDL}>")


def passes(items: DataFrame, shortest: int) -> Iterator[tuple[list[tuple], bool]]:
    """(block, whether there is another)."""
    held = None
    for block in blocks_of(items, shortest):
        if held:
            yield held, True
        held = block
    if held:
        yield held, False


def matches(docs: DataFrame, items: DataFrame, shortest: int = 1) -> DataFrame:
    """(doc_id, item_id, part, edits, first, end): a row for each occurrence that overlaps no better one of the same item or part."""
    docs, found = docs.select("doc_id", "text"), []
    for block, more in passes(items, shortest):
        rows = with_hits(docs, block, "hits", shortest).select("doc_id", F.inline("hits"))
        found.append(written(rows, "matches") if more or found else rows)
    if not found:
        return docs.limit(0).select("doc_id", F.inline(F.array().cast(f"array<{HIT_DDL}>")))
    out = found[0]
    for rows in found[1:]:
        out = out.union(rows)
    return out


def decontaminated(docs: DataFrame, items: DataFrame, shortest: int = 1) -> DataFrame:
    """The rows of `docs` in which no item and no part of one occurs."""
    columns, earlier = docs.columns, None
    for block, more in passes(items, shortest):
        hits = free_name(docs, "hits")
        docs = with_hits(docs, block, hits, shortest).filter(F.size(hits) == 0).drop(hits)
        if more:
            docs = written(docs, "decontaminated")
            if earlier is not None:
                dropped(earlier)
            earlier = docs
    return docs.select(*[F.col(f"`{c}`") for c in columns])
