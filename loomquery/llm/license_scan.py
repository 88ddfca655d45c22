"""License scans: MinHash bands over overlapping text windows retrieve templates, exact containment verifies them.

Words are lower-cased runs of letters and digits. A template of n words has n - 4 shingles of five words; it occurs in
a text where CONTAINED = 0.75 or more of its distinct shingles do, each on about its own diagonal (place in the text minus place
in the template): within one of the overlapping bands of 2 * (n // 4 + 1) diagonals, n // 4 + 1 apart. So words may be changed, missing
or put in, up to n // 4 more of one than of the other, and two notices in a row are two matches. The span goes from the first to the
last shared shingle of the band. Of a template's occurrences that overlap the best is reported: the highest containment, then the
shortest, then the first. Different templates are all reported, so a notice that contains another has both.

Retrieval: for each length n the text has windows of 2 * n words, n words apart, so any n neighbouring words lie
in one window whole. A window has, of an occurrence, at least half of the template's shingles, and so a similarity of 0.2 or more to
the template (1/3 if nothing is put in). The BANDS bands of ROWS = 1 MinHash value miss it with probability 0.8 ** 64 = 6e-7
at most. Of a template so retrieved the diagonals in and around the window are verified on the exact shingles.

A window none of whose shingles is in any template can't collide, so it is passed over before its MinHash values are
made; this only saves work. A template of fewer than five words is one shingle, the whole sequence, and is looked up by its hash.

The templates are broadcast in their indexed form, in blocks of MOST_TEMPLATE_WORDS words (one template at least); each further
block is a pass of its own over the written result of the one before. Texts never move: there is no shuffle.

Defined results: null and empty texts have no match, nor have templates without a word. Rows that repeat, or have a null id, are
each scanned. Without templates, or without documents, there is no match. A very long text is scanned whole, in memory that follows its
length. `matches` replaces a column of that name; other columns stay, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, free_name, written
from .license_texts import TEMPLATES
from .words import mixed, rolling

SHINGLE, CONTAINED, BANDS, ROWS = 5, 0.75, 64, 1
MOST_TEMPLATE_WORDS = 2_000_000
WORD = re.compile(r"[^\W_]+")
MULTIPLIERS = np.random.default_rng(10).integers(1, 2**63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def words_of(text: str | None) -> np.ndarray:
    """Hashes of the lower-cased words."""
    found = WORD.findall((text or "").lower())
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w.encode("utf-8", "surrogatepass")) for w in found), np.uint64, len(found))


def bands_of(shingles: np.ndarray) -> np.ndarray:
    """A key for each band: the hash of its least values."""
    least = np.multiply.outer(MULTIPLIERS, shingles).min(axis=1).reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + least[:, r])
    return key


@dataclass
class Template:
    name: str
    length: int  # words
    shingles: np.ndarray  # of all places, sorted
    places: np.ndarray  # theirs
    distinct: int


@dataclass
class Templates:
    long: list[Template]
    every: np.ndarray  # all long templates' shingles, sorted
    by_band: dict[int, list[int]]
    short: dict[int, list[tuple[str, np.uint64]]]  # by length


def indexed(templates: Iterable[tuple[str, str]]) -> Templates:
    long, by_band, short = [], {}, {}
    for name, text in templates:
        words = words_of(text)
        if 0 < len(words) < SHINGLE:
            short.setdefault(len(words), []).append((name, rolling(words, len(words))[0]))
        if len(words) < SHINGLE:
            continue
        s = rolling(words, SHINGLE)
        order = np.argsort(s, kind="stable")
        for key in bands_of(np.unique(s)).tolist():
            by_band.setdefault(key, []).append(len(long))
        long.append(Template(name, len(words), s[order], order, len(np.unique(s))))
    return Templates(long, np.unique(np.concatenate([t.shingles for t in long])) if long else np.empty(0, np.uint64), by_band, short)


def retrieved(index: Templates, s: np.ndarray, known: np.ndarray) -> dict[int, list[int]]:
    """For each template that some window of the text collides with, these windows' first words."""
    found: dict[int, list[int]] = {}
    for n in sorted({t.length for t in index.long}):
        # The window at k * n has the shingles k * n to k * n + 2 * n - SHINGLE.
        size = 2 * n - SHINGLE + 1
        starts = np.unique(np.concatenate([known // n, (known - size) // n + 1]))
        for start in (starts[starts >= 0] * n).tolist():
            window = np.unique(s[start : start + size])
            if len(window):
                for t in {t for key in bands_of(window).tolist() for t in index.by_band.get(key, ()) if index.long[t].length == n}:
                    found.setdefault(t, []).append(start)
    return found


def occurrences(t: Template, s: np.ndarray, known: np.ndarray, windows: list[int]) -> list[tuple[float, int, int]]:
    """(containment, first word, end word) of the template in the bands in and around the windows."""
    lo, n = np.searchsorted(t.shingles, s[known]), np.searchsorted(t.shingles, s[known], side="right")
    n = n - lo
    entry = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
    place, shingle = np.repeat(known, n), t.shingles[entry]
    diagonal, step = place - t.places[entry], t.length // 4 + 1
    near = np.zeros(len(place), bool)
    for start in windows:
        near |= (diagonal > start - t.length) & (diagonal < start + 2 * t.length)
    place, shingle, band = place[near], shingle[near], diagonal[near] // step  # bands b and b - 1 hold it
    found = set()
    for b in np.unique(np.concatenate([band, band - 1])).tolist():
        at = (band == b) | (band == b + 1)
        share = len(np.unique(shingle[at])) / t.distinct
        if share >= CONTAINED:
            found.add((share, int(place[at].min()), int(place[at].max()) + SHINGLE))
    return apart(found)


def apart(found: set[tuple[float, int, int]]) -> list[tuple[float, int, int]]:
    """Those that overlap no better one that stays."""
    out: list[tuple[float, int, int]] = []
    for share, first, end in sorted(found, key=lambda m: (-m[0], m[2] - m[1], m[1])):
        if all(end <= a or first >= b for _, a, b in out):
            out.append((share, first, end))
    return out


def scan(index: Templates, text: str | None) -> list[tuple[str, float, int, int]]:
    """(template, containment, first word, end word) of each match, in the order of places, then templates."""
    words, out = words_of(text), []
    s = rolling(words, SHINGLE)
    if len(s) and len(index.every):
        at = np.minimum(np.searchsorted(index.every, s), len(index.every) - 1)
        known = np.flatnonzero(index.every[at] == s)
        if len(known):
            for t, windows in retrieved(index, s, known).items():
                out += [(index.long[t].name, *m) for m in occurrences(index.long[t], s, known, windows)]
    for n, templates in index.short.items():
        runs = rolling(words, n)
        for name, h in templates:
            out += [(name, *m) for m in apart({(1.0, int(i), int(i) + n) for i in np.flatnonzero(runs == h)})]
    return sorted(out, key=lambda m: (m[2], m[3], m[0]))


MATCH = pa.struct([("template", pa.string()), ("containment", pa.float64()), ("first", pa.int64()), ("end", pa.int64())])
MATCH_DDL = "struct<template: string, containment: double, first: bigint, end: bigint>"


def match_rows(shared, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[dict(zip(("template", "containment", "first", "end"), m, strict=True)) for m in scan(shared.value, t)] for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(MATCH))], [*batch.schema.names, column])

    return run


def blocks_of(templates: Iterable[tuple[str, str]]) -> Iterator[list[tuple[str, str]]]:
    block, size = [], 0
    for name, text in templates:
        n = len(WORD.findall(text or ""))
        if block and size + n > MOST_TEMPLATE_WORDS:
            yield block
            block, size = [], 0
        block.append((name, text))
        size += n
    if block:
        yield block


def with_matches(docs: DataFrame, templates: DataFrame | list[tuple[str, str]] | None = None) -> DataFrame:
    """`docs` (text, ...) with `matches`: the license templates that the text contains, and where (in words).

    `templates`: (name, text) pairs, or a table of them; the texts and notices of `license_texts` by default.
    """
    if isinstance(templates, DataFrame):
        templates = map(tuple, templates.select("name", "text").orderBy("name", "text").toLocalIterator())
    docs = docs.drop(*[c for c in docs.columns if c.lower() == "matches"])
    own, found, earlier = docs.columns, None, None
    for block in blocks_of(TEMPLATES if templates is None else templates):
        if found:
            docs = written(docs, "license-matches")
            if earlier is not None:
                dropped(earlier)
            earlier = docs
        new = free_name(docs, "matches_")
        shared = docs.sparkSession.sparkContext.broadcast(indexed(block))
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
        docs = docs.mapInArrow(match_rows(shared, new), f"{fields}, {new} array<{MATCH_DDL}>")
        if found:
            docs = docs.withColumn(found, F.concat(found, new)).drop(new)
        found = found or new
    matches_ = F.col(found) if found else F.array().cast(f"array<{MATCH_DDL}>")
    return docs.select(*[F.col(f"`{c}`") for c in own], matches_.alias("matches"))


def matches(docs: DataFrame, templates: DataFrame | list[tuple[str, str]] | None = None) -> DataFrame:
    """(doc_id, template, containment, first, end): a row for each match."""
    return with_matches(docs.select("doc_id", "text"), templates).select("doc_id", F.inline("matches"))
