"""The lattice, LM scores and sampled segmentations against enumeration."""

from __future__ import annotations

import binascii
import math
from collections import Counter

import numpy as np
import pytest

from loomquery.llm import gumbel_encode as g
from loomquery.llm import lattice, lm_scoring
from loomquery.llm.common import doc_fold
from loomquery.llm.words import split_words

TINY = ["a", "b", "ab", "ba", "aba", "▁", "▁a", "▁ab", "c", "bc"]


@pytest.fixture(scope="module")
def tiny():
    return lattice.Vocabulary(TINY, np.log(np.arange(1, len(TINY) + 1) / 100), math.log(1e-3))


def all_paths(v, unit):
    out = []

    def go(i, ids, lp):
        if i == len(unit):
            out.append((tuple(ids), lp))
            return
        for j in range(i + 1, min(len(unit), i + v.longest) + 1):
            k = v.ids.get(unit[i:j], len(v.pieces) if j == i + 1 else -1)
            if k >= 0:
                go(j, [*ids, k], lp + v.scores[k])

    go(0, [], 0.0)
    return out


UNITS = ["▁aba", "▁abab", "▁", "xabay", "▁abcabcab", "zz", "ab" * 40]


def test_forward_sums_all_segmentations(tiny):
    got = lattice.forward(tiny, UNITS, -0.5)
    for u, x in zip(UNITS[:-1], got, strict=False):
        assert abs(x - (np.logaddexp.reduce([lp for _, lp in all_paths(tiny, u)]) - 0.5)) < 1e-12
    assert abs(got[-1] - (lattice.forward_one(tiny, UNITS[-1])[-1] - 0.5)) < 1e-9
    assert lattice.forward(tiny, [""], -0.5) == [-0.5]


def test_matrix_scores_are_models_side_by_side(tiny):
    two = lattice.Vocabulary(TINY, np.stack([tiny.scores[:-2], tiny.scores[:-2] - 1], 1), np.array([-5.0, -6.0]))
    got = lattice.forward(two, UNITS, np.zeros(2))
    one = lattice.Vocabulary(TINY, tiny.scores[:-2] - 1, -6.0)
    assert np.allclose(got[:, 1], lattice.forward(one, UNITS))


def test_expected_counts(tiny):
    for u in UNITS[:-1]:
        paths = all_paths(tiny, u)
        one = np.zeros(len(TINY) + 1)
        lattice.expected_one(tiny, u, tiny.scores, one)
        assert np.allclose(one, lattice.expected_counts(tiny, [u], tiny.scores))
        z = np.logaddexp.reduce([lp for _, lp in paths])
        want = np.zeros(len(TINY) + 1)
        for ids, lp in paths:
            np.add.at(want, list(ids), math.exp(lp - z))
        assert np.allclose(want, lattice.expected_counts(tiny, [u], tiny.scores))


# LM scoring.
def scored(docs, **k):
    return {r["doc_id"]: r for r in lm_scoring.score_texts(docs, doc_fold(docs["doc_id"], 10) == 0, **k).collect()}


def test_scores(docs_of, words):
    rows = [(i, words(i % 40, 5 + i % 30)) for i in range(120)] + [(500, None), (501, ""), (502, " \n\t "), (503, "x" * 3000), (504, "Ünï çødé 日本 the The THE")]
    got = scored(docs_of(rows))
    train, texts = Counter(), 0
    for i, t in rows:
        if binascii.crc32(str(i).encode()) % 10:
            train.update(split_words(t, lower=True))
            texts += 1
    n, v = sum(train.values()) + texts, len(train) + 1
    assert len(got) == len(rows)
    for i, t in rows:
        r, own = got[i], [*(train[w] for w in split_words(t, lower=True)), texts]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (binascii.crc32(str(i).encode()) % 10 == 0, len(own), sum(c > 0 for c in own), n)
        assert abs(r["base_score"] - sum(math.log10((c + 0.1) / (n + 0.1 * (v + 1))) for c in own)) < 1e-6
        assert r["score"] < 0
    assert got[500]["score"] == got[501]["score"] == got[502]["score"]


TEXTS_AB = ["ab ba ab c", "aba aba ab", "b ab bc c c", "ca aba", "zz ab", None, "abcab"]


def enumerated_scores(v, texts, kinds, held, rounds):
    """log10 P(text) word by word: all segmentations listed, each word drawn after the ones before it."""
    pieces = len(TINY)
    stop = {z: lm_scoring.STOP for z in set(kinds)}
    plain = np.exp(v.scores[:-2])
    p = {z: np.append(plain * (1 - lm_scoring.STOP), 1e-6 / lm_scoring.CODE_POINTS) for z in set(kinds)}
    words = {z: Counter() for z in set(kinds)}
    n_texts = Counter()
    for t, z, h in zip(texts, kinds, held, strict=True):
        if not h:
            words[z].update((t or "").split())
            n_texts[z] += 1
    for z in [z for z in words if not n_texts[z]]:
        del words[z]

    def ways(word, z):
        return [(ids, math.prod([*(p[z][i] for i in ids), stop[z]])) for ids, _ in all_paths(v, "▁" + word)]

    for _ in range(rounds):
        for z, c in words.items():
            uses = np.append(lm_scoring.PRIOR * plain, 0.5)
            for w in c:
                total = sum(x for _, x in ways(w, z))
                for ids, x in ways(w, z):
                    for i in ids:
                        uses[i] += x / total
            everything = uses.sum() + len(c) + 0.5
            p[z] = uses / everything
            p[z][pieces] /= lm_scoring.CODE_POINTS
            stop[z] = (len(c) + 0.5) / everything
    out = []
    for t in texts:
        chances = []
        for z, c in words.items():
            n, once, twice = sum(c.values()), sum(x == 1 for x in c.values()), sum(x == 2 for x in c.values())
            d = min(max(once / max(once + 2 * twice, 1), 0.1), 0.95) if once else 0.75
            end = (n_texts[z] + 1) / (n + n_texts[z] + 2)
            chance, before = math.log((n_texts[z] + 1) / (sum(n_texts.values()) + len(words)) * end), Counter()
            for w in (t or "").split():
                q = max(c[w] - d, 0) / (n + 1) + (d * len(c) + 1) / (n + 1) * sum(x for _, x in ways(w, z))
                chance += math.log((1 - end) * (lm_scoring.SPREAD * q + before[w]) / (lm_scoring.SPREAD + before.total()))
                before[w] += 1
            chances.append(chance)
        out.append(np.logaddexp.reduce(chances) / math.log(10))
    return out


@pytest.mark.parametrize(("rounds", "frequent"), [(0, 200_000), (2, 200_000), (2, 5), (1, 1)])
def test_score_by_enumeration(spark, tiny, monkeypatch, rounds, frequent):
    """Whatever words go to the executors as a table."""
    monkeypatch.setattr(lm_scoring, "load_pieces", lambda path: (TINY, tiny.scores[:-2], -1))
    monkeypatch.setattr(lm_scoring, "FREQUENT", frequent)
    kinds, held = ["x", "y", "x", None, "y", "x", "x"], [False, False, False, False, True, False, True]
    docs = spark.createDataFrame([(i, t, k, h) for i, (t, k, h) in enumerate(zip(TEXTS_AB, kinds, held, strict=True))], "doc_id long, text string, kind string, held boolean")
    got = {r["doc_id"]: r["score"] for r in lm_scoring.score_texts(docs, docs["held"], docs["kind"], "tiny", rounds).collect()}
    want = enumerated_scores(tiny, TEXTS_AB, kinds, held, rounds)
    assert len(got) == len(want) and all(abs(got[i] - x) < 1e-9 * max(1, abs(x)) for i, x in enumerate(want))


def test_log_gamma():
    x = np.array([1, 1.5, 2, 3.25, 10, 1e4, 1e9])
    assert np.allclose(lm_scoring.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-13, atol=1e-11)


def test_word_probabilities_sum_to_less_than_one(tiny):
    """Over all strings of two letters up to a length, with training words among them."""
    import itertools

    total = sum(np.exp(tiny.scores[:-2]))
    v = lattice.Vocabulary(TINY, tiny.scores[:-2, None] - math.log(total / 0.6), math.log(0.1) - math.log(lm_scoring.CODE_POINTS))
    one = lambda x: np.array([x], float)
    m = lm_scoring.Model(v, one(math.log(0.3)), one(50), one(2), one(10), one(0.5), 2)
    strings = ["".join(x) for n in range(1, 9) for x in itertools.product("abc", repeat=n)]
    counts = np.array([[30.0 if s == "ab" else 20.0 if s == "cab" else 0.0] for s in strings])
    q = np.exp(m.word_scores(strings, counts))
    assert 0.8 < q.sum() < 1 and q[strings.index("ab")] > 0.5


def test_the_model_beats_the_base(spark):
    """On held-out texts, a token."""
    from loomquery.llm import queries

    got = queries.op1_lm_scoring(spark, "/root/testdata/sf0.01").filter("held_out").selectExpr("sum(score) / sum(n_tokens)", "sum(base_score) / sum(n_tokens)").first()
    assert got[0] > got[1]


def test_unseen_words_are_told_apart(docs_of, words):
    """Unseen words of common syllables are likelier than others as long; and partitions don't matter."""
    rows = [(i, words(i, 60)) for i in range(300)]
    held = [i for i in range(1000, 1400) if binascii.crc32(str(i).encode()) % 10 == 0][:20]
    rows += [(i, words(i, 60)) if n % 2 else (i, " ".join(w[::-1].replace("e", "q").replace("n", "z") for w in words(i, 60).split())) for n, i in enumerate(held)]
    got = scored(docs_of(rows))
    assert sum(r["n_known"] < r["n_tokens"] for r in got.values()) > 5
    assert min(got[i]["score"] / got[i]["n_tokens"] for i in held[1::2]) > max(got[i]["score"] / got[i]["n_tokens"] for i in held[::2])
    again = scored(docs_of(rows).repartition(7))
    assert all(abs(again[i]["score"] - got[i]["score"]) < 1e-6 for i in got)


def test_no_training_texts_and_no_texts(docs_of):
    held = [i for i in range(200) if binascii.crc32(str(i).encode()) % 10 == 0][:2]
    got = scored(docs_of([(held[0], "the cat"), (held[1], None)]))
    assert all(math.isfinite(r["score"]) and r["train_tokens"] == 0 and r["n_known"] == 0 for r in got.values())
    assert scored(docs_of([])) == {}


def test_repeated_rows_kinds_and_null_ids(spark):
    rows = [(1, "a b", "en"), (1, "a b", "en"), (2, "la le", "fr"), (None, "b", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row_ string")
    got = lm_scoring.score_texts(docs, doc_fold(docs["doc_id"], 10) == 99, docs["row_"]).collect()
    assert len(got) == 4 and got[0]["train_tokens"] == 11
    assert len({r["score"] for r in got if r["doc_id"] == 1}) == 1


# Sampled segmentations.
@pytest.fixture(scope="module")
def coder(tiny):
    return g.Encoder(lattice.Vocabulary([*TINY, *[""] * 256], np.concatenate([tiny.scores[:-2], np.full(256, -np.inf)]), math.log(1e-3)), len(TINY))


def text_paths(coder, text):
    """(ids, log p) of all segmentations of a text."""
    found = [((), 0.0)]
    for u in g.units_of(text):
        own = [(expand(coder, u, ids), lp) for ids, lp in all_paths(coder.vocabulary, u)]
        found = [(a + b, x + y) for a, x in found for b, y in own]
    z = np.logaddexp.reduce([lp for _, lp in found])
    return {ids: lp - z for ids, lp in found}


def expand(coder, unit, ids):
    out, at = [], 0
    for k in ids:
        if k == len(coder.vocabulary.pieces):
            out += coder.spelled(ord(unit[at]))
            at += 1
        else:
            out.append(k)
            at += len(coder.vocabulary.pieces[k])
    return tuple(out)


def test_samples_follow_the_law(coder):
    text, n = "aba ab", 6000
    p = text_paths(coder, text)
    first, pair = Counter(), Counter()
    for at in range(0, n, 500):
        for own, _ in g.sample_batch(coder, [text] * 500, [g.row_key(3, at + i) for i in range(500)], 2):
            ids = [tuple(x.tolist()) for x, _, _ in own]
            assert len(set(ids)) == 2 and all(abs(lp - p[i]) < 1e-9 for i, (_, lp, _) in zip(ids, own, strict=True))
            first[ids[0]] += 1
            pair[tuple(ids)] += 1
    for a, la in p.items():
        assert abs(first[a] / n - math.exp(la)) < 0.03
        for b, lb in p.items():
            if a != b:  # without replacement: in proportion to what is left
                assert abs(pair[a, b] / n - math.exp(la + lb) / -math.expm1(la)) < 0.03


LONG_UNIT = "ab" * 1200  # of over 1,100 pieces


def test_no_draw_of_a_text_is_used_twice(coder, monkeypatch):
    drawn, mixed = [], g.mixed
    monkeypatch.setattr(g, "mixed", lambda h: drawn.append(h.copy()) or mixed(h))
    [(own, _)] = g.sample_batch(coder, [LONG_UNIT + " ab aba\n" + LONG_UNIT], [g.row_key(1, 2)], 5)
    assert len(own) == 5 and min(len(ids) for ids, _, _ in own) > 2200
    numbers = np.concatenate(drawn)
    assert len(numbers) > 10_000 and len(np.unique(numbers)) == len(numbers)


def test_samples_of_a_long_unit_follow_the_law(coder):
    """Each sample's piece ends, at places far into the unit, have their posterior probability; samples are independent."""
    v, n, draws = coder.vocabulary, len(LONG_UNIT), 400
    alpha, beta = lattice.forward_one(v, LONG_UNIT), np.full(n + 1, -np.inf)
    beta[n] = 0
    for i in range(n - 1, -1, -1):
        beta[i] = np.logaddexp.reduce([v.scores[k] + beta[j] for j in range(i + 1, min(n, i + v.longest) + 1) if (k := v.ids.get(LONG_UNIT[i:j], len(v.pieces) if j == i + 1 else -1)) >= 0])
    ends = np.zeros((2, draws, n + 1), bool)
    for at in range(0, draws, 100):
        for row, (own, _) in enumerate(g.sample_batch(coder, [LONG_UNIT] * 100, [g.row_key(9, at + i) for i in range(100)], 2)):
            for s, (ids, lp, _) in enumerate(own):
                ends[s, at + row, np.cumsum([len(v.pieces[i]) for i in ids])] = True
                assert abs(lp - sum(v.scores[i] for i in ids) + alpha[n]) < 1e-6
    places = [3, 700, 1201, 1800, 2301, 2399]
    for x in places:
        want = math.exp(alpha[x] + beta[x] - alpha[n])
        assert 0.1 < want < 0.9 and all(abs(ends[s, :, x].mean() - want) < 0.1 for s in range(2))
        for y in places:
            assert abs(np.corrcoef(ends[0, :, x], ends[1, :, y])[0, 1]) < 0.2


def test_greatest_by_group():
    r = np.random.default_rng(4)
    for _ in range(50):
        of = np.sort(r.integers(0, 6, r.integers(0, 40)))
        score = r.integers(0, 9, len(of)).astype(float)
        for most in (1, 2, 3, 7):
            want: dict = {}
            for i in sorted(range(len(of)), key=lambda i: (of[i], -score[i], i)):
                want.setdefault(of[i], []).append(i)
            got = g.greatest(score, of, most)
            assert [x.tolist() for x in got] == [[v[n] for v in want.values() if len(v) > n] for n in range(min(most, max(map(len, want.values()), default=0)))]


def test_inclusion_scores_are_unbiased(coder):
    """Horvitz-Thompson: indicators over inclusion probabilities average to 1 for every path."""
    text, n, total = "abab", 4000, Counter()
    p = text_paths(coder, text)
    for at in range(0, n, 500):
        for own, threshold in g.sample_batch(coder, [text] * 500, [g.row_key(5, at + i) for i in range(500)], 3):
            for ids, lp, value in own:
                assert threshold is None or value > threshold
                total[tuple(ids.tolist())] += math.exp(-g.inclusion(lp, threshold))
    for ids, lp in p.items():
        if lp > math.log(0.03):
            assert abs(total[ids] / n - 1) < 0.25


def test_few_segmentations_are_all_there(coder):
    for text in ("", "c", "b", "ab", "aba"):
        p = text_paths(coder, text)
        [(own, threshold)] = g.sample_batch(coder, [text], [7], 50)
        assert {tuple(i.tolist()) for i, _, _ in own} == set(p) and threshold is None
        values = [v for _, _, v in own]
        assert values == sorted(values, reverse=True) and all(g.inclusion(lp, threshold) == 0 for _, lp, _ in own)


TEXTS = ["", None, " ", "  two  spaces ", "line\n\n\nfeeds\n", "tab\there", "▁mark ▁▁", "日本語 テキスト", "emoji 🙂🙃", "\x00\x01", "a" * 5000, "word " * 3000, "", "ﬁ ligature É"]


def test_round_trip(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, samples string")
    rows = g.encode(docs, check=True).orderBy("doc_id").collect()
    assert [r["doc_id"] for r in rows] == list(range(len(TEXTS))) and all(r["exact"] for r in rows)
    assert all(1 <= len(r["samples"]) <= 2 for r in rows)
    one = g.encode(docs).selectExpr("doc_id", "text", "samples[0].ids as ids")
    assert all(r["decoded"] == (r["text"] or "") for r in g.decode(one).collect())


def test_samples_do_not_depend_on_partitions(docs_of, words):
    docs = docs_of([(i, words(i, 30)) for i in range(60)] + [(3, "twice"), (3, "twice"), (None, "null key")])
    take = lambda d: sorted((str(r["doc_id"]), r["text"], str(r["samples"])) for r in g.encode(d).collect())
    assert take(docs) == take(docs.repartition(9))
    assert g.encode(docs.limit(0)).count() == 0
    clash = spark_columns(docs)
    assert g.encode(clash).columns == ["doc_id", "text", "exact", "samples"] and g.encode(clash, check=True).columns == ["doc_id", "text", "samples", "exact"]


def spark_columns(docs):
    return docs.selectExpr("doc_id", "text", "1 AS exact", "2 AS samples")
