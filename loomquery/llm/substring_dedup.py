"""Substring dedup: words covered by a window that also starts in an earlier document are removed.

Every run of `width` words of every text has a Rabin-Karp hash (two 64-bit lanes). Spark counts them:
a window is repeated if its hash occurs in documents of different ids, and it is removed wherever a
smaller id has it. Overlapping and adjoining windows merge into maximal intervals.

Shipping each window's hash would move several times the input. So a first pass ships runs. The anchor of
a window is the least hash of the half-windows inside it; equal windows have equal anchors, and neighbouring
windows that share theirs are a run, about 13 windows long, named by the hash of all its words. Counting runs by anchor
decides the same as counting each of their windows:

- An anchor that one id alone has: equal windows have equal anchors, so each of its windows is in that id alone.
- An anchor whose runs all have one name: every id that has the anchor has the same run of words, and so each
  window of it; a window's ids are the anchor's ids, and the least of them keeps it.
- Any other anchor lies at a border of repeated passages: its windows are shipped and counted one by one.

So each window's ids are counted, most of them a run at a time, and every repeated window is found.

Frequent runs and windows are combined before they are shuffled; the way back from one to its documents is a join with one row
a window, dealt for itself so that adaptive execution splits hot keys (`common.met`). No list is gathered but those of
one document. Lost executors: the stages are plain shuffles, recomputed from the input or from written tables.

Defined results: a null or empty text has no words and keeps the empty text. Texts of fewer than `width` words
lose nothing. Rows that share a doc_id never count as earlier to each other, and each loses what an
earlier id has. Rows with a null id lose nothing, and nobody loses words for them. An empty table gives an empty result. A very long text's
hashes are in memory at once, some 50 bytes a word. kept_text, n_words, n_removed and removed replace columns of these names; other columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, free_name, met, written
from .words import LANES, mixed, powers, rolling, signed, sliding_min, split_words, word_hashes

WIDTH = 50


def anchors_of(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each window its anchor: the least mixed hash of the runs of width // 2 words in it."""
    inner = max(1, width // 2)
    return sliding_min(mixed(rolling(hashes, inner)), width - inner + 1)


def runs_of(hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (anchor, name) pairs of the runs of windows that share an anchor."""
    anchors = anchors_of(hashes, width)
    starts = np.flatnonzero(np.concatenate([[True], anchors[1:] != anchors[:-1]]))
    ends = np.append(starts[1:], len(anchors)) + width - 1  # behind the run's last word
    up, down = powers(LANES[0], len(hashes))
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(mixed(hashes, 2) * up[: len(hashes)], out=total[1:])
    names = mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    pairs = np.unique(np.stack([signed(anchors[starts]), signed(names)], 1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def run_rows(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, found, names = [], [], []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                words = split_words(text)
                if len(words) >= width:
                    anchors, name = runs_of(word_hashes(words), width)
                    found.append(anchors)
                    names.append(name)
                    ids.append(np.full(len(anchors), doc_id, np.int64))
            if ids:
                yield pd.DataFrame({"doc_id": np.concatenate(ids), "anchor": np.concatenate(found), "name": np.concatenate(names)})

    return run


def window_hashes(hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    return rolling(hashes, width, 0), rolling(mixed(hashes, 1), width, 1)


def window_rows(width: int):
    """(doc_id, h1, h2, late) for the windows with one of the `mixed` anchors; late: an earlier id has the anchor."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, text, mixed_, late in zip(batch["doc_id"], batch["text"], batch["mixed"], batch["late"], strict=True):
                hashes = word_hashes(split_words(text))
                anchors = signed(anchors_of(hashes, width))
                at = np.flatnonzero(np.isin(anchors, np.asarray(mixed_, np.int64)))
                one, two = (signed(x)[at] for x in window_hashes(hashes, width))
                rows = np.unique(np.stack([one, two, np.isin(anchors[at], np.asarray(late, np.int64))], 1), axis=0)
                out.append(pd.DataFrame({"doc_id": np.full(len(rows), doc_id, np.int64), "h1": rows[:, 0], "h2": rows[:, 1], "late": rows[:, 2] > 0}))
            if out:
                yield pd.concat(out)

    return run


def covered(at: np.ndarray, n: int, width: int) -> np.ndarray:
    """Which of n words some window covers; `at` marks the windows by their first word."""
    step = np.zeros(n + 1, np.int64)
    starts = np.flatnonzero(at)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + width, -1)
    return np.cumsum(step[:n]) > 0


def intervals(gone: np.ndarray) -> np.ndarray:
    """The maximal runs of true values as rows (first, end)."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
    return edge.reshape(-1, 2)


SPANS = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))


def cleaned_rows(width: int, gone_: str, repeated_: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, n_words, n_removed, spans = [], [], [], []
            for text, anchors, windows in zip(batch["text"].to_pylist(), batch[gone_], batch[repeated_], strict=True):
                words = split_words(text)
                gone = np.zeros(len(words), bool)
                if (anchors.is_valid or windows.is_valid) and len(words) >= width:
                    hashes = word_hashes(words)
                    at = np.zeros(len(words) - width + 1, bool)
                    if anchors.is_valid:
                        at |= np.isin(signed(anchors_of(hashes, width)), anchors.values.to_numpy())
                    if windows.is_valid:
                        at |= np.isin(signed(rolling(hashes, width, 0)), windows.values.to_numpy())
                    gone = covered(at, len(words), width)
                left = [w for w, g in zip(words, gone, strict=True) if not g] if gone.any() else words
                kept.append(b" ".join(left).decode())
                n_words.append(len(words))
                n_removed.append(int(gone.sum()))
                spans.append([{"first": int(a), "end": int(b)} for a, b in intervals(gone)])
            own = [n for n in batch.schema.names if n not in (gone_, repeated_)]
            added = [pa.array(kept, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, SPANS)]
            yield pa.RecordBatch.from_arrays([*(batch[n] for n in own), *added], [*own, "kept_text", "n_words", "n_removed", "removed"])

    return run


def repeats(texts: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, gone, repeated): a document's anchors all of whose windows an earlier id has, and the first
    lanes of its other windows that an earlier id has."""
    runs = written(texts.mapInPandas(run_rows(width), "doc_id long, anchor long, name long"), "runs")
    several = runs.groupBy("anchor").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.min("name").alias("lo"), F.max("name").alias("hi")).filter("first < last")
    several = several.select("anchor", "first", (F.col("lo") == F.col("hi")).alias("whole"))
    only = lambda condition: F.collect_set(F.when(F.expr(condition), F.col("anchor")))
    shared = met(runs.select("doc_id", "anchor"), several, "anchor").filter("not whole or first < doc_id")
    flagged = shared.groupBy("doc_id").agg(only("whole").alias("gone"), only("not whole").alias("mixed"), only("not whole and first < doc_id").alias("late"))
    flagged = written(flagged, "anchors")
    dropped(runs)
    some = flagged.filter(F.size("mixed") > 0).select("doc_id", "mixed", "late")
    windows = texts.join(some, "doc_id").select("doc_id", "text", "mixed", "late").mapInPandas(window_rows(width), "doc_id long, h1 long, h2 long, late boolean")
    windows = written(windows, "windows")
    firsts = windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").select("h1", "h2", "first")
    again = met(windows.filter("late"), firsts, "h1", "h2").filter("first < doc_id").groupBy("doc_id").agg(F.collect_set("h1").alias("repeated"))
    return flagged.select("doc_id", "gone").join(again, "doc_id", "left")


def remove_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """`docs` (doc_id, text, ...) with kept_text, n_words, n_removed and the removed intervals of words."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in {"kept_text", "n_words", "n_removed", "removed"}])
    named = docs.filter("doc_id is not null")  # the same rows for all joins, so their texts are shuffled once
    gone, repeated = free_name(docs, "gone_"), free_name(docs, "repeated_")
    found = repeats(named.select("doc_id", "text"), width).withColumnsRenamed({"gone": gone, "repeated": repeated})
    none = F.lit(None).cast("array<bigint>")
    own = [F.col(f"`{c}`") for c in docs.columns]
    joined = named.join(found, "doc_id", "left").select(*own, gone, repeated).union(docs.filter("doc_id is null").select(*own, none, none))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return joined.mapInArrow(cleaned_rows(width, gone, repeated), f"{fields}, kept_text string, n_words long, n_removed long, removed array<struct<first: long, end: long>>")


def digest(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
