"""MinHash near-dedup: a multi-index Hamming join over b-bit signatures, verified on the full sets.

A document's set holds its distinct runs of five words (A to Z lower-cased). Its signature has `CHUNKS`
chunks of `SYMBOLS` b-bit MinHash values. By pigeonhole, two signatures that differ in at most
CHUNKS * (ERRORS + 1) - 1 values have a chunk with at most ERRORS differences; so each chunk is indexed
under every choice of SYMBOLS - ERRORS of its values, and all pairs under that distance (23 of 60) share a
key. A pair at similarity 0.75 has each value equal with probability 0.75, so it shares no key with
probability 0.367 ** 12 = 6e-6, and less the more alike it is.

Equal sets are one class, and classes are what the index holds. A group of near copies can be large and its
members unlike each other (each is like the original, say), so a key's classes are not all paired:

1. Star: each key's member with the most company over all its keys, which an original is, is compared with the others
   of the key. Verified links make components, and a key whose members are all in one is done.
2. Keys of fewer than `HEAVY` members: the pairs of members in different components are compared.
3. Larger keys: the members that such keys connect are a cluster. Those outside its largest component ask; each asks all
   others. Askers and members are cut into blocks of about `BLOCK` shingles, and each block of askers meets each block of
   members in one task, which compares members of different components, by signature,
   then by full sets, joins what is alike, and returns only the links that join components. So no pairs leave a task, and
   none holds more than two blocks; a cluster's sets are sent once for each block of its askers, and the askers' once for each
   of its members' blocks. (To send signatures only, and pairs that pass them on to verification, was tried: a group of
   copies whose members are near but not linked makes as many such pairs as the square of its size.)

Every pair of members of a key is compared or already connected, so no link is lost but by the index's stated chance.

Compared pairs first pass the signature distance (34 of 60, missed with probability 4e-8 at similarity 0.75),
then an exact intersection of full sets of 64-bit shingle hashes. Hot keys and centres: counts and minima are
combined before shuffling, and the joins have one row a key on the other side and are dealt for themselves (`common.met`), so
adaptive execution can split them. The state between steps is written to the shared folder. Python's batches are bounded by
the session's Arrow limits of rows and bytes; a very long text's set is in memory as a whole, eight bytes a shingle.

Defined results: null and empty texts, and texts without words, are linked with nothing; a text of one to four words has one
shingle, the whole sequence. Rows that share a doc_id are one node, whatever their texts. Rows with a null id stay alone: a null component,
kept. An empty table gives an empty result. Other columns of the input are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, met, written
from .components import joined, stars
from .words import mixed, rolling, signed, split_words, word_hashes

SHINGLE, PERCENT = 5, 75
CHUNKS, SYMBOLS, ERRORS = 12, 5, 1
#: Signatures further apart than this aren't compared exactly.
FARTHEST = 34
#: Members from which a key's open pairs are compared in blocks, and the shingles of a block (of one set at least).
HEAVY, BLOCK = 64, 1 << 18
#: A small cluster's members are cut into blocks of so many, up to so many blocks, so that several tasks share it.
FEW, MOST_SMALL = 256, 32

#: Odd multipliers, one a signature value, from a fixed seed.
MULTIPLIERS = np.random.default_rng(20).integers(1, 2**63, CHUNKS * SYMBOLS, np.uint64) * np.uint64(2) + np.uint64(1)
#: The choices of values of a chunk that index it.
CHOICES = [list(c) for c in combinations(range(SYMBOLS), SYMBOLS - ERRORS)]


def shingles(text: str | None) -> np.ndarray:
    words = split_words(text, lower=True)
    if not words:
        return np.empty(0, np.uint64)
    width = min(SHINGLE, len(words))
    return np.unique(mixed(rolling(word_hashes(words), width), width))


def signature(s: np.ndarray) -> np.ndarray:
    """The low 16 bits of each order's least hash."""
    least = np.full(len(MULTIPLIERS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 4096):
        np.minimum(least, np.multiply.outer(MULTIPLIERS, s[at : at + 4096]).min(axis=1), out=least)
    return mixed(least).astype(np.uint16)


def set_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for text in batch["text"]:
            s = shingles(text)
            digest = (int(signed(mixed(s, 2)).sum()), int(signed(mixed(s, 3)).sum())) if len(s) else (0, 0)
            out.append((len(s), *digest, signature(s).tobytes() if len(s) else b""))
        yield pd.DataFrame({"row_": batch["row_"], **{n: [x[i] for x in out] for i, n in enumerate(("n_shingles", "d1", "d2", "sig"))}})


def chunk_keys(sig: np.ndarray) -> np.ndarray:
    """Keys of signatures (rows) as a matrix with a column for each chunk and choice."""
    values = sig.reshape(len(sig), CHUNKS, SYMBOLS).astype(np.uint64)
    keys = []
    for n, choice in enumerate(CHOICES):
        h = np.broadcast_to(np.arange(CHUNKS, dtype=np.uint64) * np.uint64(64) + np.uint64(n + 1), values.shape[:2]).copy()
        for i in choice:
            h = mixed(h * np.uint64(0x100000001B3) + values[:, :, i])
        keys.append(h)
    return np.concatenate(keys, axis=1)


def signatures_of(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint16).reshape(len(column), -1)


def key_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        if len(batch):
            keys = chunk_keys(signatures_of(batch["sig"]))
            yield pd.DataFrame({"key": signed(keys.ravel()), "rep": np.repeat(batch["rep"].to_numpy(), keys.shape[1])})


def near_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        if len(batch):
            yield batch.loc[(signatures_of(batch["sa"]) != signatures_of(batch["sb"])).sum(axis=1) <= FARTHEST, ["a", "b"]]


def packed_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"rep": batch["doc_id"], "full": [shingles(t).tobytes() for t in batch["text"]]})


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Of two sorted sets."""
    small, large = sorted((a, b), key=len)
    if 100 * len(small) < PERCENT * len(large):
        return False
    at = np.searchsorted(large, small)
    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def verified_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        at = [alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(batch["fa"], batch["fb"], strict=True)]
        yield batch.loc[np.array(at, bool), ["a", "b"]]


def block_links(group: pd.DataFrame) -> pd.DataFrame:
    """The links between a block of askers and one of members that join different components."""
    asking = group["asking"].to_numpy()
    askers, others = (group[asking == x].sort_values("rep") for x in (True, False))
    root = {label: label for label in group["label"]}

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    reps, labels, asks = (others[c].to_numpy() for c in ("rep", "label", "asks"))
    sigs, sets, found = signatures_of(others["sig"]), [np.frombuffer(x, np.uint64) for x in others["full"]], []
    for rep, label, sig, full in zip(askers["rep"], askers["label"], askers["sig"], askers["full"], strict=True):
        own = np.frombuffer(full, np.uint64)
        rest = np.flatnonzero((labels != label) & (~asks | (reps > rep)))  # two askers meet twice
        far = (sigs[rest] != np.frombuffer(sig, np.uint16)).sum(axis=1)
        near = np.flatnonzero(far <= FARTHEST)
        for b in rest[near[np.argsort(far[near], kind="stable")]].tolist():
            x, y = find(label), find(labels[b])
            if x != y and alike(own, sets[b]):
                root[x] = y
                found.append((rep, reps[b]))
    return pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)


def sets_of(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, d1, d2, sig) a row: the set's size, two digests that name it, its signature."""
    rows = docs.select(F.struct("doc_id").alias("row_"), "text")  # the id stays what it is, a null too
    out = rows.mapInPandas(set_rows, "row_ struct<doc_id: long>, n_shingles long, d1 long, d2 long, sig binary")
    return out.select("row_.doc_id", "n_shingles", "d1", "d2", "sig")


def verified(pairs: DataFrame, reps: DataFrame, full: DataFrame) -> DataFrame:
    """Those of `pairs` (a, b) whose full sets are alike enough."""
    sig = reps.select("rep", "sig")
    near = pairs.join(sig.toDF("a", "sa"), "a").join(sig.toDF("b", "sb"), "b").mapInPandas(near_rows, "a long, b long")
    sets = near.join(full.toDF("b", "fb"), "b").join(full.toDF("a", "fa"), "a")
    return sets.select("a", "b", "fa", "fb").mapInPandas(verified_rows, "a long, b long")


def open_keys(members: DataFrame, forest: DataFrame) -> DataFrame:
    """(key, rep, label, size, top): members of the keys that have members in several components, with the key's
    size and its largest component."""
    labelled = members.join(forest.toDF("rep", "root"), "rep", "left").select("key", "rep", F.coalesce("root", "rep").alias("label"))
    by = labelled.groupBy("key", "label").agg(F.count("*").cast("double").alias("n"))
    stats = by.groupBy("key").agg(F.sum("n").alias("size"), F.max("n").alias("most"), F.max(F.struct("n", "label"))["label"].alias("top"))
    stats = stats.filter("most < size").select("key", "size", "top")
    return met(labelled, stats, "key")


def in_blocks(heavy: DataFrame, reps: DataFrame, full: DataFrame, forest: DataFrame) -> DataFrame:
    """The links (a, b) between components of the clusters that the keys of `heavy` (key, rep) make."""
    # A key is a node beside its members: a number that is a member's too would only join two clusters.
    cluster = stars(heavy.select(F.col("rep").alias("a"), F.col("key").alias("b")), "near-clusters")
    named = lambda df, to, name: df.join(to.toDF("rep", "root"), "rep", "left").withColumn(name, F.coalesce("root", "rep")).drop("root")
    nodes = named(named(heavy.select("rep").distinct(), cluster, "cluster"), forest, "label").join(reps.select("rep", "n", "sig"), "rep")
    sizes = nodes.groupBy("cluster", "label").agg(F.count("*").alias("members"), F.sum("n").alias("n")).groupBy("cluster")
    sizes = sizes.agg(F.sum("members").alias("members"), F.sum("n").alias("n"), F.max(F.struct("members", "label", "n")).alias("top"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.least(F.ceil(F.col("members") / FEW), F.lit(MOST_SMALL)))
    sizes = sizes.filter("top.members < members").select("cluster", F.col("top.label").alias("top"), F.ceil((F.col("n") - F.col("top.n")) / BLOCK).alias("n_askers"), blocks.alias("n_members"))
    nodes = met(nodes, sizes, "cluster").withColumn("asks", F.col("label") != F.col("top")).join(full, "rep")
    place = lambda count: F.pmod(F.xxhash64("rep"), count)
    every = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.col(count).cast("long") - 1))
    columns = ["cluster", "rep", "label", "sig", "full", "asks"]
    askers = nodes.filter("asks").select(*columns, F.lit(True).alias("asking"), place("n_askers").alias("u"), every("n_members").alias("v"))
    members = nodes.select(*columns, F.lit(False).alias("asking"), every("n_askers").alias("u"), place("n_members").alias("v"))
    return askers.union(members).groupBy("cluster", "u", "v").applyInPandas(block_links, "a long, b long")


def links(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(u, v): a forest over class representatives; v is the least node of u's component."""
    members = classes.select("rep", "sig").mapInPandas(key_rows, "key long, rep long")
    several = members.groupBy("key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi"), F.count("*").alias("size")).filter("lo < hi").select("key", "size")
    members = written(met(members, several, "key"), "near-keys")
    company = members.groupBy("rep").agg(F.sum("size").alias("company"))
    indexed = company.select("rep")
    reps = written(classes.select("rep", "sig", F.col("n_shingles").alias("n")).join(company, "rep"), "near-signatures")
    full = docs.select("doc_id", "text").join(indexed.toDF("doc_id"), "doc_id").mapInPandas(packed_rows, "rep long, full binary")
    full = written(full, "near-sets")

    best = members.join(reps.select("rep", "company"), "rep").groupBy("key").agg(F.max(F.struct("company", "rep"))["rep"].alias("a"))
    pairs = met(members, best, "key").filter("rep <> a").select("a", F.col("rep").alias("b")).distinct()
    forest = stars(verified(pairs, reps, full), "near-forest")

    left = written(open_keys(members.select("key", "rep"), forest), "near-open")
    dropped(members)
    light, heavy = left.filter(F.col("size") < HEAVY), left.filter(F.col("size") >= HEAVY)
    apart = light.filter("label <> top").select("key", F.col("rep").alias("a"), F.col("label").alias("la"))
    pairs = light.join(apart, "key").filter("la <> label and (label = top or rep < a)").select("a", F.col("rep").alias("b")).distinct()
    forest = joined(forest, verified(pairs, reps, full), "near-forest")
    if heavy.limit(1).count():
        forest = joined(forest, in_blocks(heavy.select("key", "rep"), reps, full, forest), "near-forest")
    for table in (left, reps, full):
        dropped(table)
    return forest


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) a row of `docs` (doc_id, text, ...)."""
    rows = written(sets_of(docs.select("doc_id", "text")), "near-rows")
    classes = rows.filter("n_shingles > 0 and doc_id is not null").groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"), F.max("doc_id").alias("last"))
    classes = written(classes, "near-classes")  # a table of its own, so that the join below can split a large class's rows
    forest = links(docs, classes)
    # A document of a class of one is its own representative: only shared classes are joined.
    shared = classes.filter("rep < last").select("d1", "d2", F.col("n_shingles").alias("n"), "rep")
    same = (rows["d1"] == shared["d1"]) & (rows["d2"] == shared["d2"]) & (rows["n_shingles"] == shared["n"])
    own = rows.join(shared, same, "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("rep", "doc_id")).alias("rep"))
    own = written(own, "near-own")
    for table in (rows, classes):
        dropped(table)
    # Rows that share a doc_id but not their set are one node.
    several = own.filter("doc_id is not null").groupBy("doc_id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).filter("lo < hi").select("doc_id")
    if several.limit(1).count():
        ties = own.filter("rep is not null").join(several, "doc_id").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
        forest = joined(forest, ties, "near-forest")
    named = own.join(forest.toDF("rep", "root"), "rep", "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.coalesce("root", "rep"))
    out = named.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
