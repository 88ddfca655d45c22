"""Near duplicates, repeated passages, fingerprints: against brute force, with odd inputs."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pandas as pd
import pytest

from loomquery.llm import components, merkle, near_dedup, substring_dedup
from loomquery.llm.words import rolling, sliding_min, split_words, word_hashes


def edited(text, seed, share):
    r = random.Random(seed)
    return " ".join(w if r.random() > share else f"x{r.randint(0, 999)}" for w in text.split())


# Vectorised pieces.
def test_rolling_hash_names_runs():
    words = [b"a", b"b", b"a", b"b", b"a", b"c"]
    h = rolling(word_hashes(words), 2)
    assert h[0] == h[2] and h[1] == h[3] and len(set(h.tolist())) == 3
    assert len(rolling(word_hashes(words), 7)) == 0


def test_sliding_min():
    x = np.random.default_rng(0).integers(0, 2**63, 100).astype(np.uint64)
    for w in (1, 2, 3, 8, 26, 100):
        assert sliding_min(x, w).tolist() == [int(x[i : i + w].min()) for i in range(101 - w)]


# Components.
def test_components(spark):
    r = random.Random(1)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, 2000 + i) for i in range(200)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {x["u"]: x["v"] for x in components.stars(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}
    assert components.stars(spark.createDataFrame([], "a long, b long")).count() == 0
    forest = components.stars(spark.createDataFrame(edges[:150], "a long, b long"))
    for more in (edges[150:200], [], edges[:20], edges[200:]):
        forest = components.joined(forest, spark.createDataFrame(more, "a long, b long"))
    assert {x["u"]: x["v"] for x in forest.collect()} == got


# Near duplicates.
def shingle_set(text):
    w = split_words(text, lower=True)
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute_components(rows):
    sets = [(i, shingle_set(t)) for i, t in rows]
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (a, s) in enumerate(sets):
        for b, t in sets[:n]:
            if s and t and a is not None and b is not None and 100 * len(s & t) >= 75 * len(s | t):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}


def corpus(words):
    rows = [(i, words(i, 20 + i % 200)) for i in range(150)]
    for i in range(150, 300):  # near copies, some too far from each other
        rows.append((i, edited(words(i % 30, 20 + i % 30 % 200), i, 0.004 * (i % 10))))
    base = words(999, 120)
    rows += [(i, edited(base, i, 0.03)) for i in range(300, 420)]  # one large group
    rows += [(i, words(7, 27)) for i in range(420, 440)] + [(440, None), (441, ""), (442, " \t"), (443, "one"), (444, "ONE"), (445, "one two three four"), (446, "long " * 4000), (447, "long " * 3999)]
    return rows


@pytest.mark.parametrize("heavy", [64, 8])
def test_near_duplicates(docs_of, words, monkeypatch, heavy):
    """With a low bound, most of the large group goes through blocks."""
    monkeypatch.setattr(near_dedup, "HEAVY", heavy)
    monkeypatch.setattr(near_dedup, "BLOCK", 2000)
    monkeypatch.setattr(near_dedup, "FEW", 16)
    rows = corpus(words)
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(docs_of(rows)).collect()}
    want = brute_components(rows)
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(shingle_set(t)) for i, t in rows}
    assert all(r["kept"] == (i == want[i]) for i, r in got.items())


def test_a_link_at_the_threshold(docs_of):
    """Three of four shingles are enough, two of three aren't."""
    text = "a b c d e f g h".split()
    rows = [(1, " ".join(text)), (2, " ".join(text[:7])), (3, " ".join(text[:6]))]
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs_of(rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_index_finds_pairs_at_the_threshold():
    """Signatures of sets at similarity 0.75 share a key: no miss in many draws."""
    r = np.random.default_rng(3)
    for _ in range(300):
        a = np.unique(r.integers(0, 2**63, 210).astype(np.uint64))
        b = np.unique(np.concatenate([a[:180], r.integers(0, 2**63, 30).astype(np.uint64)]))
        sig = np.stack([near_dedup.signature(a), near_dedup.signature(b)])
        keys = near_dedup.chunk_keys(sig)
        assert set(keys[0]) & set(keys[1]) and (sig[0] != sig[1]).sum() <= near_dedup.FARTHEST


def test_close_signatures_always_share_a_key():
    """The pigeonhole bound: any signatures that differ in at most 23 values."""
    r = np.random.default_rng(4)
    for _ in range(200):
        a = r.integers(0, 2**16, 60).astype(np.uint16)
        b = a.copy()
        b[r.choice(60, 23, replace=False)] += 1
        keys = near_dedup.chunk_keys(np.stack([a, b]))
        assert set(keys[0]) & set(keys[1])


def test_near_duplicates_of_odd_tables(spark, docs_of):
    assert near_dedup.near_duplicates(docs_of([])).count() == 0
    assert near_dedup.near_duplicates(docs_of([(1, None)])).first()["component_id"] == 1
    rows = [(5, "a b c d e f"), (5, "q r s t u v"), (3, "q r s t u v"), (None, "a b c d e f"), (9, "a b c d e f")]
    docs = spark.createDataFrame([(i, t, i, "x") for i, t in rows], "doc_id long, text string, component_id long, row_ string")
    got = sorted(((r["doc_id"] or -1), r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(docs).collect())
    assert got == [(-1, None, True), (3, 3, True), (5, 3, False), (5, 3, False), (9, 3, False)]


def test_blocks_join_what_is_alike():
    """Askers and members of blocks: the links make the components of all pairs alike, a few links a member."""
    r = np.random.default_rng(5)
    base = np.unique(r.integers(0, 2**63, 200).astype(np.uint64))
    sets = [np.unique(np.concatenate([r.choice(base, 180, replace=False), r.integers(0, 2**63, r.integers(0, 30)).astype(np.uint64)])) for _ in range(60)]
    label = np.arange(60) // 4
    row = lambda i, asking: (i, label[i], label[i] != 0, asking, near_dedup.signature(sets[i]).tobytes(), sets[i].tobytes())
    found = []
    for u in range(2):
        for v in range(3):
            rows = [row(i, True) for i in range(60) if label[i] and i % 2 == u] + [row(i, False) for i in range(60) if i % 3 == v]
            got = near_dedup.block_links(pd.DataFrame(rows, columns=["rep", "label", "asks", "asking", "sig", "full"]))
            assert len(got) < len(rows)
            found += list(zip(got["a"], got["b"], strict=True))
    assert all(near_dedup.alike(sets[a], sets[b]) and label[a] != label[b] for a, b in found)

    def components(links):
        at = list(range(60))
        for _ in range(60):
            for a, b in links:
                at[a] = at[b] = min(at[a], at[b])
        return at

    same = [(i, j) for i in range(60) for j in range(i) if label[i] == label[j]]
    alike = [(i, j) for i in range(60) for j in range(i) if near_dedup.alike(sets[i], sets[j])]
    assert components(same + found) == components(same + alike) != components(same)


# Repeated passages.
def brute_removed(rows, width=50):
    first = {}
    for i, t in rows:
        w = split_words(t)
        for k in range(len(w) - width + 1):
            x = tuple(w[k : k + width])
            if i is not None and (x not in first or i < first[x]):
                first[x] = i
    out = []
    for i, t in rows:
        w = split_words(t)
        gone = set()
        for k in range(len(w) - width + 1):
            if i is not None and first[tuple(w[k : k + width])] < i:
                gone.update(range(k, k + width))
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return out


@pytest.mark.parametrize("width", [50, 4])
def test_substring_dedup(spark, docs_of, words, width):
    passage, hot = words("p", 75), words("h", 60)
    rows = [(i, words(i, 30 + i % 90)) for i in range(60)]
    rows += [(100 + i, f"{words(i + 1000, 20)}\n{passage} {words(i + 2000, 15)}") for i in range(4)]
    rows += [(200 + i, f"{words(i + 3000, i)} {hot} {words(i + 4000, 8)}") for i in range(30)]
    rows += [(300, passage + " " + passage), (301, " ".join(passage.split()[10:64])), (302, " ".join(passage.split()[:49])), (303, rows[7][1]), (304, rows[7][1] + " " + hot)]
    rows += [(305, None), (306, ""), (307, "same " * 500), (308, "same " * 700), (309, "Same " * 60), (4, passage), (4, "the end"), (None, passage), (None, hot)]
    out = substring_dedup.remove_repeats(docs_of(rows), width).collect()
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in out)
    assert got == sorted((-1 if i is None else i, *x) for i, *x in brute_removed(rows, width))
    for r in out:  # the intervals are maximal and tell the removed words
        spans = [(s["first"], s["end"]) for s in r["removed"]]
        assert sum(b - a for a, b in spans) == r["n_removed"] and all(x[1] < y[0] for x, y in zip(spans, spans[1:], strict=False))


def test_substring_dedup_of_odd_tables(spark, docs_of):
    assert substring_dedup.remove_repeats(docs_of([])).count() == 0
    clash = spark.createDataFrame([(2**60 + 1, "a " * 60, "x", 5, "u"), (2**60 + 2, "a " * 60, "y", None, "v"), (None, "a " * 60, "z", 1, "w")], "doc_id long, text string, kept_text string, gone_ int, repeated_ string")
    out = substring_dedup.remove_repeats(clash)
    assert out.columns == ["doc_id", "text", "gone_", "repeated_", "kept_text", "n_words", "n_removed", "removed"]
    assert {r["doc_id"]: (r["n_removed"], r["gone_"], r["repeated_"]) for r in out.collect()} == {2**60 + 1: (0, 5, "u"), 2**60 + 2: (60, None, "v"), None: (0, 1, "w")}


# Fingerprints.
def test_fingerprints(spark, docs_of, words):
    rows = [(i, "\n".join(words(100 * i + k, 12) for k in range(40))) for i in range(4)] + [(10, None), (11, ""), (12, "x"), (13, "日本\n語" * 50)]
    rows += [(20, rows[0][1]), (21, rows[0][1] + " "), (22, rows[0][1].replace("\n", " \n", 1))]
    prints = {r["doc_id"]: r["p"] for r in docs_of(rows).select("doc_id", merkle.fingerprint(merkle.F.coalesce("text", merkle.F.lit(""))).alias("p")).collect()}
    assert prints[0] == prints[20] and prints[10] == prints[11]
    assert len({p[:64] for p in prints.values()}) == len(rows) - 2
    both = spark.createDataFrame([(prints[a], prints[b]) for a, b in ((0, 20), (0, 21), (0, 1), (10, 12), (10, 11))], "a string, b string")
    got = [r[0] for r in both.select(merkle.likeness(merkle.F.col("a"), merkle.F.col("b"))).collect()]
    assert got[0] == got[4] == 1 and 0.99 <= got[1] < 1 and got[2] < 0.05 and got[3] == 0


def test_likeness_survives_moved_places(spark, words):
    """A word put in early changes its block, not the ones after it; nor do paragraphs before others."""
    lines = [words(k, 60) for k in range(90)]
    text = "\n".join(lines)
    changed = {"a word in front": "new " + text, "a paragraph in front": "some new line\n" + text, "a paragraph gone": "\n".join(lines[:40] + lines[41:]), "other text": "\n".join(words(k + 500, 60) for k in range(90)), "reversed": "\n".join(lines[::-1])}
    rows = spark.createDataFrame([(n, text, t) for n, t in changed.items()], "name string, a string, b string")
    rows = rows.select("name", merkle.fingerprint(merkle.F.col("a")).alias("a"), merkle.fingerprint(merkle.F.col("b")).alias("b"))
    got = {r["name"]: (r["near"], r["n"], r["of"]) for r in rows.select("name", merkle.likeness(merkle.F.col("a"), merkle.F.col("b")).alias("near"), merkle.differing(merkle.F.col("b"), merkle.F.col("a")).alias("n"), merkle.F.size(merkle.branches(merkle.F.col("a"))).alias("of")).collect()}
    assert got["a word in front"][0] > 0.99 and got["a word in front"][1] == 1 and got["a word in front"][2] > 3
    assert got["a paragraph in front"][0] > 0.99 and got["a paragraph in front"][1] <= 2 and 0.98 < got["a paragraph gone"][0] < 1
    assert got["other text"][0] < 0.05 and 0.9 < got["reversed"][0] < 1


def plain_fingerprint(text):
    """By splitting and joining in Python, without the patterns."""
    import re

    def runs(items, ends):
        out, run = [], []
        for x in items:
            run.append(x)
            if ends(x):
                out.append(run)
                run = []
        return out + [run] * bool(run)

    sections = []
    for run in runs(text.split("\n"), lambda p: hashlib.sha256(p.encode()).hexdigest()[-1] == "0"):
        nodes = [hashlib.sha256(p.encode()).hexdigest() for p in run]
        blocks = []
        for p in run:
            units = re.findall(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", p)  # a word and the gap behind it
            blocks += ["".join(b).strip("\t\n\v\f\r ") for b in runs(units, lambda u: u.strip("\t\n\v\f\r ")[-1] in "gyoGYO.!?:;01234ао。")]
        sections.append((hashlib.sha256("".join(n + "," for n in nodes).encode()).hexdigest(), [hashlib.md5(b.encode()).hexdigest()[:8] for b in blocks]))
    return hashlib.sha256("".join(n for n, _ in sections).encode()).hexdigest() + ":" + ";".join(n[:16] + "." + "".join(b) for n, b in sections)


def test_fingerprints_against_plain_ones(spark, words):
    texts = ["", "x", "one two", " lead", "trail ", "ends so", "go", "\n\n", "a\tb\x0bc go d", "日本\n語 go 0", *["\n".join(words(f"{i} {k}", 1 + 7 * k % 50) for k in range(i * 12)) for i in range(1, 6)], "w " * 100, "so " * 100, "x\n" * 200]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", merkle.fingerprint(merkle.F.col("t")).alias("p")).collect()
    assert {r["t"]: r["p"] for r in got} == {t: plain_fingerprint(t) for t in texts}


def test_edits_are_located(docs_of, words):
    lines = [words(k, 9) for k in range(50)]
    new = list(lines)
    new[3], new[40] = "changed", new[40] + " more"
    new.insert(20, "put in")
    old_docs = docs_of([(1, "\n".join(lines)), (2, "same"), (3, "a\nb"), (4, "gone"), (None, "x")])
    new_docs = docs_of([(1, "\n".join(new)), (2, "same"), (3, "a"), (5, "new"), (None, "y")])
    node = lambda t: hashlib.sha256(t.encode()).hexdigest()
    rows = merkle.locate_edits(old_docs, new_docs).collect()
    assert sorted((r["doc_id"], r["version"], r["paragraph"], r["node"]) for r in rows) == [
        (1, "new", 3, node("changed")), (1, "new", 20, node("put in")), (1, "new", 41, node(new[41])), (1, "old", 3, node(lines[3])), (1, "old", 40, node(lines[40])), (3, "old", 1, node("b")),
    ]


def test_neighbours(spark, docs_of):
    r = random.Random(2)
    ids = r.sample(range(-5000, 5000), 700)
    rows = [(i, f"text {i} " + "é" * (i % 17)) for i in ids] + [(None, "no id"), (ids[0], "a twin"), (2**62, None)]
    rows += [(77, f"of one id {i}") for i in range(400)] + [(None, f"none {i}") for i in range(300)] + [(-(2**63), "least")]
    d = docs_of(rows).repartition(6)
    got = sorted((str(x["doc_id"]), x["edited_sha256"], x["n_chars"]) for x in merkle.edited_pairs(spark, d).collect())
    order = sorted(rows, key=lambda x: (x[0] is None, -(x[0] or 0), hashlib.md5((x[1] or "").encode()).hexdigest()))
    want = []
    for (i, t), (_, u) in zip(order, order[1:] + order[:1], strict=True):
        t, u = t or "", u or ""
        h = len(t) // 2
        want.append((str(i), hashlib.sha256((t[: len(t) - h] + u[:h]).encode()).hexdigest(), len(t)))
    assert got == sorted(want)
    assert merkle.edited_pairs(spark, docs_of([])).count() == 0
    assert merkle.edited_pairs(spark, docs_of([(7, "ab")])).first()["edited_sha256"] == hashlib.sha256(b"aa").hexdigest()
    assert merkle.edited_pairs(spark, docs_of([(None, "ab"), (None, "cd")])).count() == 2
