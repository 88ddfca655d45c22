"""Quality classifier by positive-unlabelled learning: the non-negative unbiased risk is minimised.

Trusted positives are labelled texts of good quality; unlabelled ones are any texts of the training fold, whose
labels aren't read. Labels other than the positives' are never used. With the class prior p, the risk of a scorer g is

    p * R_positive(g, good) + max(0, R_unlabelled(g, bad) - p * R_positive(g, bad)),

where the second part, the risk of the bad texts, cannot be below 0: a mini-batch in which it would be follows its
gradient upwards instead, which keeps a flexible scorer from fitting the positives alone.

The prior, the share of good texts among the unlabelled, is estimated from positives and unlabelled texts alone, by the best bin: a
scorer is fitted to tell the two apart, on one half of them; on the other half, at any threshold t, the share of unlabelled
texts above t is at least p times that of positives. The threshold with the least upper bound of the two shares' ratio (Hoeffding, at
confidence 1 - DELTA) gives the estimate; the halves change places, and the two estimates are averaged.

The scorer is a small network over figures of a whole text: its bytes' shares, its words, lines, repetition, letter
case. Label, language, source and id are no inputs. It is fitted on the driver on a sample of training texts, at most
`most_positives` and `most_unlabelled` of them (None: all, in the driver's memory at about 600 bytes a text), taken by
a hash of their ids, one text an id; the hash makes the sample the same whatever the partitions. Every text is then scored in one pass
without a shuffle.

Defined results: a null text counts as an empty one and gets a score too; so do rows without an id, which teach nothing. Rows that
repeat are each scored; equal texts have equal scores. Of several labels of one document the best holds; of several texts of one id
the one with the least figures teaches. Without any positive in the training fold each score is 0.5. An empty table gives an
empty result. A very long text is read whole; its words are in memory at once. `score` and `predicted` replace columns of these
names; other columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_POSITIVES, MOST_UNLABELLED = 8_000, 16_000
HIDDEN, EPOCHS, BATCH, RATE, DECAY, SEED = 32, 60, 512, 0.003, 1e-4, 7
#: Of the scorer that the prior's estimate needs, and of its bound.
PRIOR_EPOCHS, DELTA = 20, 0.1
#: Of a fit on few texts, whose epochs are short.
LEAST_STEPS = 100


def features(text: str | None) -> np.ndarray:
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = max(len(raw), 1)
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    ascii_share = np.sqrt(seen[:128] / n)
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    m, k = max(len(words), 1), max(len(lines), 1)
    distinct = len(set(words))
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    upper, lower, digits = seen[65:91].sum(), seen[97:123].sum(), seen[48:58].sum()
    marks = seen[33:48].sum() + seen[58:65].sum() + seen[91:97].sum() + seen[123:127].sum()
    line_of = {}
    for x in lines:
        line_of[x] = line_of.get(x, 0) + 1
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    own = [
        np.log1p(len(raw)), np.log1p(len(words)), np.log1p(len(lines)), distinct / m, np.log1p(distinct) / np.log1p(m), lengths.mean() / 10, lengths.std() / 10,
        np.log1p(lengths.max()), upper / max(upper + lower, 1), digits / n, marks / n, marks / m, seen[128:].sum() / n, len(line_of) / k, sum(len(x) * c for x, c in line_of.items() if c > 1) / n,
        same / m, np.log1p(len(raw) / k), sum(w.isupper() for w in words) / m, sum(w[-1:] in b"!?*#$%&|" for w in words) / m, len(raw) / n,
    ]
    return np.concatenate([ascii_share, own]).astype(np.float32)


def feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [features(t).tobytes() for t in batch["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["good"], batch["any"], pa.array(rows, pa.binary())], ["doc_id", "good", "any", "x"])


class Network:
    """One hidden layer over standardised figures; forward passes and gradients in numpy."""

    def __init__(self, x: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = x.mean(0, dtype=np.float64), np.maximum(x.std(0, dtype=np.float64), 1e-3)
        width = x.shape[1]
        self.params = [rng.normal(0, np.sqrt(2 / width), (width, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), np.zeros(1)]
        self.state = [(np.zeros_like(p), np.zeros_like(p)) for p in self.params]
        self.steps = 0

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def raw(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w, b, v, c = self.params
        h = np.maximum(z @ w + b, 0)
        return h @ v + c[0], h

    def step(self, z: np.ndarray, h: np.ndarray, by_score: np.ndarray) -> None:
        """One Adam step along the gradient of the scores' loss."""
        w, _, v, _ = self.params
        back = by_score[:, None] * v * (h > 0)
        gradients = [z.T @ back + DECAY * w, back.sum(0), h.T @ by_score + DECAY * v, by_score.sum(keepdims=True)]
        self.steps += 1
        for p, g, (m, s) in zip(self.params, gradients, self.state, strict=True):
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            p -= RATE * (m / (1 - 0.9**self.steps)) / (np.sqrt(s / (1 - 0.999**self.steps)) + 1e-8)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def risk(gp: np.ndarray, gu: np.ndarray, prior: float) -> tuple[float, float]:
    """(risk of the good texts, unbiased risk of the bad ones) of raw scores, with the logistic loss."""
    good = prior * np.logaddexp(0, -gp).mean()
    return float(good), float(np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean())


def slopes(gp: np.ndarray, gu: np.ndarray, prior: float) -> np.ndarray:
    """What a step follows downwards, by score: the risk's gradient, or, where the bad texts' risk is below 0, away from that."""
    rises_p, rises_u = prior * sigmoid(gp) / len(gp), sigmoid(gu) / len(gu)
    if risk(gp, gu, prior)[1] >= 0:
        return np.concatenate([prior * (sigmoid(gp) - 1) / len(gp) - rises_p, rises_u])
    return np.concatenate([rises_p, -rises_u])


def apart_slopes(gp: np.ndarray, gu: np.ndarray) -> np.ndarray:
    """The gradient of the loss of telling positives from unlabelled texts, both weighted alike."""
    return np.concatenate([(sigmoid(gp) - 1) / len(gp), sigmoid(gu) / len(gu)])


def fitted(positive: np.ndarray, unlabelled: np.ndarray, by_scores, epochs: int = EPOCHS) -> Network:
    """A network that follows `by_scores(scores of positives, scores of unlabelled texts)` down."""
    rng = np.random.default_rng(SEED)
    net = Network(np.concatenate([positive, unlabelled]))
    p, u = (net.standard(x).astype(np.float32) for x in (positive, unlabelled))
    batches = max(1, -(-max(len(p), len(u)) // BATCH))
    for _ in range(max(epochs, -(-LEAST_STEPS // batches))):
        order_p, order_u = rng.permutation(len(p)), rng.permutation(len(u))
        for i in range(batches):
            at_p, at_u = order_p[i::batches], order_u[i::batches]
            if not len(at_p) or not len(at_u):
                continue
            z = np.concatenate([p[at_p], u[at_u]]).astype(np.float64)
            g, h = net.raw(z)
            net.step(z, h, by_scores(g[: len(at_p)], g[len(at_p) :]))
    return net


def best_bin(gp: np.ndarray, gu: np.ndarray) -> float:
    """The prior from scores of held-out positives and unlabelled texts."""
    at = np.unique(gp)
    share = lambda g: 1 - np.searchsorted(np.sort(g), at) / len(g)
    slack = sum(np.sqrt(np.log(4 / DELTA) / (2 * len(g))) for g in (gp, gu))
    p, u = share(gp), share(gu)
    best = int(np.argmin((u + slack) / p))
    return float(min(u[best] / p[best], 1.0))


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Between 1 in the number of unlabelled texts and its complement, so that neither class is ruled out."""
    rng, found = np.random.default_rng(SEED), []
    halves = lambda x: np.array_split(x[rng.permutation(len(x))], 2)
    (p, q), (u, v) = halves(positive), halves(unlabelled)
    for teach_p, teach_u, other_p, other_u in ((p, u, q, v), (q, v, p, u)):
        if min(map(len, (teach_p, teach_u, other_p, other_u))):
            net = fitted(teach_p, teach_u, apart_slopes, PRIOR_EPOCHS)
            found.append(best_bin(*(net.raw(net.standard(x))[0] for x in (other_p, other_u))))
    least = 1 / (len(unlabelled) + 1)
    return float(np.clip(np.mean(found) if found else 0.5, least, 1 - least))


def score_rows(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = model.value
        for batch in batches:
            texts = batch["text"].to_pylist()
            if not texts:
                continue
            scores = sigmoid(net.raw(net.standard(np.stack([features(t) for t in texts])))[0]) if net else np.full(len(texts), 0.5)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores.astype(np.float64))], [*batch.schema.names, "score"])

    return run


def fit(docs: DataFrame, labels: DataFrame, training, most_positives: int | None, most_unlabelled: int | None) -> Network | None:
    """A network from the rows for which `training(doc_id)` holds; None without positives."""
    def sample(ids: DataFrame, most: int | None, good: bool) -> DataFrame:
        ids = ids.filter("doc_id is not null").distinct()
        ids = ids if most is None else ids.orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(most)
        return ids.select("doc_id", F.lit(good).alias("good"), F.lit(not good).alias("any"))

    positives = labels.filter(training(F.col("doc_id")) & (F.col("quality") == 1)).select("doc_id")
    unlabelled = docs.filter(training(F.col("doc_id"))).select("doc_id")
    wanted = sample(positives, most_positives, True).union(sample(unlabelled, most_unlabelled, False)).groupBy("doc_id").agg(F.max("good").alias("good"), F.max("any").alias("any"))
    if most_positives is not None and most_unlabelled is not None:
        wanted = F.broadcast(wanted)  # most_positives + most_unlabelled ids at most
    rows = docs.select("doc_id", "text").join(wanted, "doc_id").select("doc_id", "text", "good", "any")
    rows = rows.mapInArrow(feature_rows, "doc_id long, good boolean, any boolean, x binary")
    found = rows.groupBy("doc_id").agg(F.max("good").alias("good"), F.max("any").alias("any"), F.min("x").alias("x")).toArrow()  # a row an id
    raw = found["x"].to_pylist()
    if not raw:
        return None
    order = sorted(range(len(raw)), key=raw.__getitem__)  # the fit doesn't depend on the order of partitions
    x = np.frombuffer(b"".join(raw[i] for i in order), np.float32).reshape(len(raw), -1)
    p, u = (x[found[name].to_numpy()[order].astype(bool)] for name in ("good", "any"))
    if not len(p) or not len(u):
        return None
    prior = estimated_prior(p, u)
    return fitted(p, u, lambda gp, gu: slopes(gp, gu, prior))


def score_texts(docs: DataFrame, labels: DataFrame, training, most_positives: int | None = MOST_POSITIVES, most_unlabelled: int | None = MOST_UNLABELLED) -> DataFrame:
    """`docs` (doc_id, text, ...) with score (0 to 1, higher: likelier good) and predicted.

    `labels`: (doc_id, quality, ...) with 1 for good; `training`: a function from an id column to a boolean one.
    `most_positives`, `most_unlabelled`: how many texts the fit takes at most; None: all.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in {"score", "predicted"}])
    labels = labels.select("doc_id", "quality")
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, training, most_positives, most_unlabelled))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    scored = docs.mapInArrow(score_rows(model), f"{fields}, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
