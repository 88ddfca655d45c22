"""LM scoring: the marginal probability of a text under a subword lattice, summed over all segmentations.

The pieces come from an existing tokenizer's vocabulary, which stays as it is. Its scores weight all segmentations at
first; training words then re-estimate them by `rounds` of expectation maximisation, in which the vocabulary's own
distribution counts as PRIOR uses (`rounds=0` keeps the vocabulary's scores). The pieces of a word, up to its stop, form a
proper distribution over all strings: an escape arc spends its probability evenly over all code points. A word of the
training texts is one more arc of its own lattice, from its start to its end. So, with c the word's count among n training
words, d the discount and V the distinct words:

    q(word) = max(c - d, 0) / (n + 1) + (d * V + 1) / (n + 1) * sum over segmentations of prod P(piece) * P(stop)

which sums to 1. No piece crosses a word's border, so the forward recursion over a document's lattice is the sum of
its words' log forward values; each distinct word's is computed once, in log space, in numpy.

A text has words of its own, which it repeats: its distribution is drawn around q, by a Dirichlet law of concentration
SPREAD, and summed out too. Training texts may come in kinds, such as languages, each with a model q and end probability e of
its own; the kinds are summed out as well, and read from no text that is scored. A text of k words, c of each, has

    P(text) = sum over kinds of prior * e * (1 - e)**k * G(SPREAD) / G(SPREAD + k) * prod G(SPREAD * q + c) / G(SPREAD * q)

(G: the gamma function). Probabilities of all texts sum to 1. A kind's model is a column of each score: work and memory grow with the
number of kinds.

Work at scale: words are counted per batch before they are shuffled. The words that make up 1 / FREQUENT or more of
the training tokens are FREQUENT at most, and go to all executors as a table of that bound; they are the hot keys. The
rest meet their scores in a join by word, where no key has more than that share. The split decides only where a word's term is
added, not what the sum is. Per-document sums are combined before they are shuffled. Piece counts sent to the driver are
bounded by the vocabulary.

Defined results: a null text is empty and has just its end token. Rows that repeat, or share an id, or have a null id, are
each scored (and each counted in training). A null kind is a kind. Without training texts all words are scored by the
vocabulary's own scores. An empty table gives an empty result. A very long text is taken by itself: its distinct words are in memory at once. Other
columns of the input are not read, whatever their names.
"""

from __future__ import annotations

import math
import struct
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written
from .lattice import MARK, Vocabulary, expected_counts, forward, load_pieces, tokenizer_path
from .words import sliced, split_words

FREQUENT = 200_000
#: Longer words take the join however frequent they are, so the table of frequent words has a bound in bytes.
FREQUENT_BYTES = 64
ROUNDS, PRIOR, SPREAD = 2, 100, 2000.0
#: The stop's probability before training.
STOP = 0.3
#: Characters of texts whose words are in memory at once, about (one text at least).
SLICE_CHARS = 1 << 19
#: Words that the lattice takes at once.
ROWS = 200_000
CODE_POINTS = 0x110000


def log_gamma(x: np.ndarray) -> np.ndarray:
    """For x >= 1: Stirling's series at x + 8."""
    y = x + 8
    series = (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    return series - sum(np.log(x + j) for j in range(8))


def drawn(lq: np.ndarray, n: np.ndarray) -> np.ndarray:
    """log(G(a + n) / G(a)) with a = SPREAD * exp(lq): lq has a row for each word and a column for each kind."""
    out = lq + math.log(SPREAD)
    many = np.flatnonzero(n > 1)
    a = np.exp(out[many])
    out[many] += log_gamma(a + n[many, None]) - log_gamma(a + 1)
    return out


@dataclass
class Model:
    """Arrays have an entry for each kind of training text."""

    vocabulary: Vocabulary
    stop: np.ndarray  # log probability of a word's stop after a piece
    words: np.ndarray  # running
    distinct: np.ndarray
    texts: np.ndarray
    discount: np.ndarray
    n_words: int = 0  # distinct, over all kinds

    def n_tokens(self) -> int:
        return int(self.words.sum() + self.texts.sum())

    def base(self, counts: np.ndarray) -> np.ndarray:
        """log10 of the additive estimate that the contract names, of all kinds together."""
        distinct = self.n_words + (self.texts.sum() > 0)
        return np.log10((counts + 0.1) / (self.n_tokens() + 0.1 * (distinct + 1)))

    def word_scores(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """log q(word) by kind; `counts` has a column for each kind."""
        spelled = forward(self.vocabulary, [MARK + w for w in words], self.stop) + np.log((self.discount * self.distinct + 1) / (self.words + 1))
        with np.errstate(divide="ignore"):
            whole = np.log(np.maximum(counts - self.discount, 0) / (self.words + 1))
        return np.logaddexp(spelled, whole)

    def frame(self, n: np.ndarray) -> np.ndarray:
        """By text of n words and kind, the log of all factors but the words'."""
        end = (self.texts + 1) / (self.words + self.texts + 2)
        prior = np.log((self.texts + 1) / (self.texts.sum() + len(self.texts)))
        n = n[:, None].astype(np.float64)
        return prior + np.log(end) + n * np.log1p(-end) + log_gamma(np.array(SPREAD)) - log_gamma(SPREAD + n)

    def end(self) -> tuple[float, int]:
        """(base, known) of the end token."""
        texts = int(self.texts.sum())
        return float(self.base(np.array([texts]))[0]), int(texts > 0)


def count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, kind, n): for each batch the words' counts in training texts; other texts' words as kind -1."""
    for batch in batches:
        counts = defaultdict(Counter)
        for text, kind in zip(batch["text"].to_pylist(), batch["kind"].to_pylist(), strict=True):
            counts[kind].update(split_words(text, lower=True))
        for kind, c in counts.items():
            n = np.fromiter(c.values(), np.int64, len(c)) * (kind >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()), pa.array(np.full(len(c), kind, np.int32)), pa.array(n)], ["word", "kind", "n"])


def larger(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in batches of ROWS or a little more: the lattice works on all units of one length at once."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n >= ROWS:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def counts_of(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([batch[n].to_numpy() for n in batch.schema.names if n.startswith("c_")], 1).astype(np.float64)


def piece_rows(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, total = model.value, None
        for batch in larger(batches):
            words, counts = [MARK + w.decode("utf-8", "surrogatepass") for w in batch["word"].to_pylist()], counts_of(batch)
            total = np.zeros((len(m.vocabulary.pieces) + 1, counts.shape[1])) if total is None else total
            for z in range(counts.shape[1]):
                total[:, z] += expected_counts(m.vocabulary, [words[i] for i in np.flatnonzero(counts[:, z])], m.vocabulary.scores[:, z])
        if total is not None:
            at, kind = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(kind), pa.array(total[at, kind])], ["piece", "kind", "uses"])

    return run


def score_rows(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in larger(batches):
            words, counts = [w.decode("utf-8", "surrogatepass") for w in batch["word"].to_pylist()], counts_of(batch)
            lq = model.value.word_scores(words, counts)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(lq.ravel()), lq.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch["word"], pa.array(counts.sum(1).astype(np.int64)), lists], ["word", "c", "lq"])

    return run


#: known, base, tokens, id, whether there is an id, whether held out; the sums by kind follow.
STAT = "<qdqq??"


def text_rows(frequent):
    """For each text its rarer words, and one row under a key that is no word with what its frequent words sum to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bases, scores, model = frequent.value
        end_base, end_known = model.end()
        for batch in sliced(batches, "text", SLICE_CHARS):
            texts = [Counter(split_words(t, lower=True)) for t in batch["text"].to_pylist()]
            met = [[(i, c) for w, c in counts.items() if (i := table.get(w)) is not None] for counts in texts]
            of = np.repeat(np.arange(len(texts)), [len(x) for x in met])
            at, n = (np.array([x[k] for own in met for x in own], np.int64) for k in range(2))
            terms = drawn(scores[at], n)
            sizes = np.array([sum(c.values()) for c in texts], np.int64)
            sums = model.frame(sizes) + np.stack([np.bincount(of, t, len(texts)) for t in terms.T], 1)
            known, base = np.bincount(of, n, len(texts)) + end_known, np.bincount(of, n * bases[at], len(texts)) + end_base
            words, rows, uses, stats = [], [], [], []
            for k, (counts, row, doc_id, held) in enumerate(zip(texts, *(batch[c].to_pylist() for c in ("row_", "doc_id", "held")), strict=True)):
                rare = [(w, c) for w, c in counts.items() if w not in table]
                words += [w for w, _ in rare]
                uses += [c for _, c in rare]
                words.append(b" " + row.to_bytes(8, "big"))
                uses.append(0)
                rows.append(np.full(len(rare) + 1, row))
                stats += [None] * len(rare) + [struct.pack(STAT, int(known[k]), base[k], int(sizes[k]) + 1, doc_id or 0, doc_id is not None, held) + sums[k].tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(np.concatenate(rows)), pa.array(uses, pa.int32()), pa.array(stats, pa.binary())], ["word", "row_", "n", "stat"])

    return run


def sum_rows(model, kinds: int):
    """Rows of the join as sums by text within each batch: (row_, doc_id, held_out, n_tokens, n_known, base_score, s_0, ...)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, n = batch["row_"].to_numpy(), batch["n"].to_numpy().astype(np.float64)
            stats = batch["stat"]
            own = stats.is_valid().to_numpy(zero_copy_only=False)
            words = np.flatnonzero(~own)
            c = np.zeros(len(rows))
            c[words] = batch["c"].to_numpy(zero_copy_only=False)[words]
            sums = np.zeros((3 + kinds, len(rows)))
            sums[1] = np.where(c > 0, n, 0)
            sums[2] = n * model.value.base(c)
            sums[3:, words] = drawn(batch["lq"].flatten().to_numpy().reshape(len(words), kinds), n[words]).T
            ids, held = np.full(len(rows), None), np.full(len(rows), None)
            for i in np.flatnonzero(own):
                packed = stats[int(i)].as_py()
                known, base, tokens, doc_id, has_id, held[i] = struct.unpack_from(STAT, packed)
                sums[:3, i] = tokens, known, base
                sums[3:, i] = np.frombuffer(packed, np.float64, kinds, struct.calcsize(STAT))
                ids[i] = doc_id if has_id else None
            at, where = np.unique(rows, return_inverse=True)
            out = [np.bincount(where, s, len(at)) for s in sums]
            first = np.full((2, len(at)), None)
            first[:, where[own]] = ids[own], held[own]
            columns = [pa.array(at), pa.array(first[0], pa.int64()), pa.array(first[1], pa.bool_()), *(pa.array(x.astype(np.int64)) for x in out[:2]), *map(pa.array, out[2:])]
            yield pa.RecordBatch.from_arrays(columns, ["row_", "doc_id", "held_out", "n_tokens", "n_known", "base_score", *(f"s_{z}" for z in range(kinds))])

    return run


def first_model(path: str | None, kinds: int) -> Model:
    """The vocabulary's own scores for every kind."""
    pieces, scores, _ = load_pieces(path or tokenizer_path())
    none = np.zeros(kinds)
    vocabulary = Vocabulary(pieces, np.repeat(scores[:, None] + math.log(1 - STOP), kinds, 1), np.full(kinds, math.log(1e-6) - math.log(CODE_POINTS)))
    return Model(vocabulary, none + math.log(STOP), none, none, none, none + 0.75)


def re_estimated(model: Model, uses: np.ndarray, own: np.ndarray) -> Model:
    """The model with scores from the pieces' expected uses (last the escape's), to which `own`, the vocabulary's uses, are added."""
    uses = uses + np.concatenate([own, np.full((1, uses.shape[1]), 0.5)])
    total = uses.sum(0) + model.distinct + 0.5
    with np.errstate(divide="ignore"):
        scores = np.log(uses / total)
    return replace(model, vocabulary=Vocabulary(model.vocabulary.pieces, scores[:-1], scores[-1] - math.log(CODE_POINTS)), stop=np.log((model.distinct + 0.5) / total))


def trained(spark, counted: DataFrame, texts: np.ndarray, path: str | None, rounds: int) -> Model:
    """The model of words counted by kind (word, c_0, ...); a word without any count is only to be scored."""
    kinds = len(texts)
    c = [F.col(f"c_{z}") for z in range(kinds)]
    seen = counted.filter(sum(c[1:], c[0]) > 0)
    of = lambda test: [F.sum(test(x).cast("long")).alias("x") for x in c]
    s = np.array([x or 0 for x in seen.agg(F.count("*"), *of(lambda x: x), *of(lambda x: x > 0), *of(lambda x: x == 1), *of(lambda x: x == 2)).first()], np.float64)
    n, v, n1, n2 = s[1:].reshape(4, kinds)
    discount = np.where(n1 > 0, np.clip(n1 / np.maximum(n1 + 2 * n2, 1), 0.1, 0.95), 0.75)
    model = replace(first_model(path, kinds), words=n, distinct=v, texts=texts, discount=discount, n_words=int(s[0]))
    own = PRIOR / (1 - STOP) * np.exp(model.vocabulary.scores[:-2])
    for _ in range(rounds if model.n_words else 0):
        sent = spark.sparkContext.broadcast(model)
        rows = seen.mapInArrow(piece_rows(sent), "piece long, kind long, uses double").groupBy("piece", "kind").agg(F.sum("uses").alias("uses")).collect()
        uses = np.zeros((len(own) + 1, kinds))
        for r in rows:
            uses[r["piece"], r["kind"]] = r["uses"]
        model = re_estimated(model, uses, own)
    return model


def numbered_kinds(texts: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """`texts` with `kind` as a number, -1 for the texts that teach nothing, and the texts of each kind."""
    by = sorted(texts.filter("not held").groupBy("kind").agg(F.count("*").alias("n")).collect(), key=lambda r: (r["kind"] is None, r["kind"] or ""))
    number = F.lit(-1)
    for i, r in enumerate(by):
        number = F.when(F.col("kind").eqNullSafe(F.lit(r["kind"])), i).otherwise(number)
    return texts.withColumn("kind", F.when(F.col("held"), -1).otherwise(number).cast("int")), np.array([r["n"] for r in by] or [0], np.float64)


def score_texts(docs: DataFrame, held_out, kind=None, path: str | None = None, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) a row of `docs` (doc_id long, text, ...).

    `held_out`: a boolean column; the model learns from the other rows. `kind`: a string column that divides the
    training rows; it isn't read of the others. `path`: the vocabulary's model file.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    texts = docs.select("doc_id", "text", held_out.alias("held"), (F.lit("") if kind is None else kind).cast("string").alias("kind"))
    texts, sizes = numbered_kinds(texts)
    kinds = range(len(sizes))
    counts = texts.select("text", "kind").mapInArrow(count_rows, "word binary, kind int, n long")
    by_kind = [F.sum(F.when(F.col("kind") == z, F.col("n")).otherwise(0)).alias(f"c_{z}") for z in kinds]
    counted = written(counts.groupBy("word").agg(*by_kind), "lm-counts")
    model = trained(spark, counted, sizes, path, rounds)
    sent = sc.broadcast(model)
    scored = written(counted.mapInArrow(score_rows(sent), "word binary, c long, lq array<double>"), "lm-scores")
    dropped(counted)
    n_tokens = model.n_tokens()
    least = max(1, math.ceil(n_tokens / FREQUENT))
    top = scored.filter((F.col("c") >= least) & (F.length("word") <= FREQUENT_BYTES)).collect()
    bases = model.base(np.array([r["c"] for r in top], np.float64))
    table = {bytes(r["word"]): i for i, r in enumerate(top)}
    small = replace(model, vocabulary=None)  # the texts need no pieces
    frequent = sc.broadcast((table, bases, np.array([r["lq"] for r in top], np.float64).reshape(len(top), len(sizes)), small))
    rest = scored.filter((F.col("c") < least) | (F.length("word") > FREQUENT_BYTES))

    numbered = texts.select("doc_id", "text", "held").withColumn("row_", F.monotonically_increasing_id())
    # The row's own facts travel with its sums: the numbers needn't be the same if the input is read again.
    rows = numbered.select("row_", "doc_id", "held", "text").mapInArrow(text_rows(frequent), "word binary, row_ long, n int, stat binary")
    met = rows.join(rest, "word", "left").select("row_", "n", "stat", "c", "lq")
    by_sum = [f"s_{z}" for z in kinds]
    sums = met.mapInArrow(sum_rows(sc.broadcast(small), len(sizes)), "row_ long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, " + ", ".join(f"{s} double" for s in by_sum))
    one = [F.max(c).alias(c) for c in ("doc_id", "held_out")] + [F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", *by_sum)]
    sums = sums.groupBy("row_").agg(*one).withColumn("most", F.greatest(*by_sum) if len(by_sum) > 1 else F.col("s_0"))
    score = (F.col("most") + F.log(sum((F.exp(F.col(s) - F.col("most")) for s in by_sum), F.lit(0.0)))) / math.log(10)
    return sums.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_tokens).cast("long").alias("train_tokens"), "base_score", score.alias("score"))
