"""Url rules, decontamination, license scans, quality scores, rollups and the pipeline."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from helpers import SMALL
from loomquery.llm import decontaminate as d
from loomquery.llm import license_scan, quality, token_rollup, url_rules
from loomquery.llm.common import doc_fold


# Url rules.
def brute_verdict(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = rest[:cut], rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for verdict, h, p in rules:
        if h and host and (host == h or host.endswith("." + h)) and path.startswith(p or ""):
            rank = (len(h + (p or "")), len(h))
            if best is None or rank > best[0]:
                best = (rank, h + (p or ""), verdict)
    return (host, path, best and best[1], best[2] if best else default)


def test_url_rules(spark):
    r = random.Random(5)
    hosts = ["com", "a.com", "b.a.com", "c.b.a.com", "ba.com", "net", "x.net", "org", "a..com", "é.org", "com:80", "A.COM"]
    paths = ["", "/", "/en/", "/en/7", "/en/77/x", "/EN/7", "/e", "//", "/en/7?q#f", "?q=/en/7", "#/en/7"]
    rules = {(r.choice(hosts[:11]), r.choice(paths[:6])): r.choice(["allow", "block"]) for _ in range(40)}
    rules = [(v, h, p) for (h, p), v in rules.items()]
    urls = [f"{s}://{h}{p}" for s in ("http", "HTTPS") for h in hosts for p in paths] + [None, "", "no scheme/en/7", "://", "x://", "http:///en/7"] + ["http://a.com/en/7"] * 50
    pages = spark.createDataFrame([(i, u, "host", 1) for i, u in enumerate(urls)], "page_id long, url string, verdict string, n int").repartition(5)
    table = spark.createDataFrame(rules, "verdict string, host string, path string")
    got = {x["page_id"]: (x["host"], x["path"], x["rule"], x["verdict"]) for x in url_rules.judge(spark, pages, table).collect()}
    assert got == {i: brute_verdict(u, rules) for i, u in enumerate(urls)}
    ties = [("allow", "b.com", "/en"), ("block", "com", "/en/x"), ("block", "net", "/\U0010ffff"), ("allow", "x.net", "/"), ("block", "x.net", "/\U0010ffff\U0010ffff")]
    odd_urls = ["http://b.com/en/x", "http://c.com/en/x", "http://x.net/\U0010ffff", "http://x.net/\U0010ffff\U0010ffffz", "http://x.net/\U0010fffe", "http://b.com/" + "en/" * 3000, None, None]
    table_of = lambda rows: spark.createDataFrame(rows, "verdict string, host string, path string")
    clash = spark.createDataFrame([(i, u, 1, 2, 3) for i, u in enumerate(odd_urls)], "page_id long, url string, best int, u int, url_ int")
    out = url_rules.judge(spark, clash, table_of(ties))
    assert out.columns == ["page_id", "url", "best", "u", "url_", "host", "path", "rule", "verdict"]
    assert {x["page_id"]: (x["host"], x["path"], x["rule"], x["verdict"]) for x in out.collect()} == {i: brute_verdict(u, ties) for i, u in enumerate(odd_urls)}
    assert brute_verdict(odd_urls[0], ties)[2] == "b.com/en"
    assert url_rules.judge(spark, pages, table.limit(0), default="block").filter("verdict <> 'block' or rule is not null").count() == 0
    assert url_rules.judge(spark, pages.limit(0), table).count() == 0
    odd = spark.createDataFrame([("block", "a.com", "/en/"), ("allow", "a.com", "/en/"), ("block", "", "/"), (None, "net", None)], "verdict string, host string, path string")
    assert url_rules.judge(spark, pages, odd).filter("url = 'http://a.com/en/7'").select("verdict").distinct().collect() == [("block",)]


# Decontamination.
def distance(text, item):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i] + [0] * len(text)
        for j in range(1, len(text) + 1):
            new[j] = min(row[j - 1] + (text[j - 1] != c), row[j] + 1, new[j - 1] + 1)
        row = new
    return min(row)


def plain(x):
    return "".join(map(chr, d.normal(x)))


def test_items_are_found_within_their_edits():
    r = random.Random(8)
    found = 0
    for _ in range(120):
        item = plain("".join(r.choice("abcdefg h") for _ in range(r.randint(45, 110))))
        limit, q = int(len(item) * d.RATE), list(item)
        for _ in range(r.randint(0, limit + 3)):
            k, j = r.randrange(3), r.randrange(len(q))
            q[j : j + (k != 2)] = r.choice("xyz") if k != 1 else ""
        noise = lambda: "".join(r.choice("abcdefgh ") for _ in range(r.randint(0, 150)))  # noqa: B023, E731
        text = plain(noise() + " " + "".join(q) + " " + noise())
        index = d.index_of([(1, item)])
        got = [x for x in d.search(index, ["", text, None])[1] if index.names[x[0]][1] < 0]
        least = distance(text, item)
        want = least <= limit and len(item) >= d.LEAST
        found += want
        assert bool(got) == want and (not got or got[0][1] == least), (item, text)
    assert found > 60


def test_matches(spark, docs_of, words):
    items = [(1, words("i", 30)), (2, words("j", 25) + ".\n" + words("k", 40)), (3, "short"), (4, None), (5, words("i", 30))]
    first, second = items[0][1], items[1][1]
    part = second.split("\n")[1]
    rows = [(1, words(1, 200)), (2, f"{words(2, 50)} {first.upper()}! {words(3, 9)}"), (3, first.replace(" ", ",\n", 3)), (4, f"x {part} y"), (5, second), (6, None), (7, ""), (8, "so short!"), (9, words(4, 6000) + first), (9, first)]
    bench = spark.createDataFrame(items, "item_id int, text string")
    got = sorted({(r["doc_id"], r["item_id"], r["part"]) for r in d.matches(docs_of(rows), bench).collect()})
    assert got == [(2, 1, -1), (2, 5, -1), (3, 1, -1), (3, 5, -1), (4, 2, 1), (5, 2, -1), (8, 3, -1), (9, 1, -1), (9, 5, -1)]
    kept = d.decontaminated(spark.createDataFrame([(i, t, "h") for i, t in rows], "doc_id long, text string, hits string"), bench)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 6, 7] and kept.columns == ["doc_id", "text", "hits"]
    assert d.matches(docs_of([]), bench).count() == 0 and d.matches(docs_of(rows), bench.limit(0)).count() == 0


def test_blocks_of_items_change_nothing(spark, docs_of, words, monkeypatch):
    items = spark.createDataFrame([(i, words(i, 30)) for i in range(12)], "item_id long, text string")
    docs = docs_of([(i, words(900 + i, 30) + " " + words(i, 30)) for i in range(12)] + [(20, words(77, 40))])
    one = sorted(map(tuple, d.matches(docs, items).collect()))
    monkeypatch.setattr(d, "BLOCK_CHARS", 300)
    assert len(list(d.blocks_of(items))) > 3 and sorted(map(tuple, d.matches(docs, items).collect())) == one and len(one) == 12
    assert [r["doc_id"] for r in d.decontaminated(docs, items).collect()] == [20]
    plan = d.matches(docs, items)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan  # a pass for each block, not all in one plan


def ends_within(text, item, limit):
    """{end: least edits} of the item's occurrences in the text with `limit` edits at most."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i] + [0] * len(text)
        for j in range(1, len(text) + 1):
            new[j] = min(row[j - 1] + (text[j - 1] != c), row[j] + 1, new[j - 1] + 1)
        row = new
    return {j: e for j, e in enumerate(row) if e <= limit}


def whole_distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, x in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != c), row[j] + 1, new[j - 1] + 1))
        row = new
    return row[-1]


def changed(r, text, n):
    out = list(text)
    for _ in range(n):
        k, j = r.randrange(3), r.randrange(len(out))
        out[j : j + (k != 2)] = r.choice("xyz") if k != 1 else ""
    return "".join(out)


def test_rows_against_brute_force(spark, docs_of, words):
    """Whole items, parts and short items: every row, and every place that has a row."""
    r = random.Random(11)
    items = {i: ". ".join(words(f"{i}-{k}", r.randint(3, 9)) for k in range(4)) + "." for i in range(6)} | {10: "a of", 11: "Who wrote it?", 12: "?!", 13: "𝐀🙂 x"}
    names = {(i, part): plain(t) if isinstance(t, str) else "".join(map(chr, t)) for i, x in items.items() for part, t in d.parts_of(x)}
    docs = []
    for n in range(40):
        pieces = [words(f"noise{n}", r.randint(1, 25))]
        for _ in range(r.randint(0, 3)):
            (i, part), t = r.choice(list(names.items()))
            pieces += [changed(r, t, r.randint(0, int(len(t) * d.RATE) + 2)) if len(t) >= d.LEAST else t, words(r.random(), r.randint(15, 30))]
        docs.append((n, " ".join(pieces)))
    got: dict = {}
    for row in d.matches(docs_of(docs), spark.createDataFrame(list(items.items()), "item_id long, text string")).collect():
        got.setdefault((row["doc_id"], row["item_id"], row["part"]), []).append((row["edits"], row["first"], row["end"]))
    n_parts = 0
    for n, text in docs:
        t = plain(text)
        for (i, part), item in names.items():
            found = got.pop((n, i, part), [])
            if len(item) < d.LEAST:
                want = [] if part >= 0 else [(0, at, at + len(item)) for at in range(len(t)) if (" " + t + " ").startswith(" " + item + " ", at)]
                assert sorted(found) == sorted(d.apart(set(want))), (n, i)
                continue
            ends = ends_within(t, item, int(len(item) * d.RATE))
            whole = ends_within(t, names[i, -1], int(len(names[i, -1]) * d.RATE)) if len(names[i, -1]) >= d.LEAST else {}
            assert bool(found) == (bool(ends) and (part < 0 or not whole)), (n, i, part)
            n_parts += bool(found) and part >= 0
            if found:
                assert min(found)[0] == min(ends.values()) and all(whole_distance(t[a:b], item) == e for e, a, b in found)
                spans = sorted((a, b) for _, a, b in found)
                assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False))
                assert all(any(a < j and b > j - len(item) // 2 for a, b in spans) for j in ends)
    assert not got and n_parts > 5


def test_shortest_items_can_be_left_out(spark, docs_of):
    items = spark.createDataFrame([(1, "yes"), (2, "who wrote emma")], "item_id long, text string")
    docs = docs_of([(1, "Yes. So who wrote Emma? Yes!"), (2, "yesterday")])
    take = lambda **k: sorted(tuple(x) for x in d.matches(docs, items, **k).collect())
    assert take() == [(1, 1, -1, 0, 0, 3), (1, 1, -1, 0, 22, 25), (1, 2, -1, 0, 7, 21)] and take(shortest=8) == [(1, 2, -1, 0, 7, 21)]


def test_columns_that_clash(spark, words):
    rows = [(1, words("i", 30), 5, "a", "b"), (None, words("j", 30), 6, "c", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, hits int, earlier_hits_ string, item_id string")
    items = spark.createDataFrame([(1, words("i", 30))], "item_id long, text string")
    kept = d.decontaminated(docs, items)
    assert kept.columns == docs.columns and [tuple(x) for x in kept.collect()] == [rows[1]]
    assert len(d.matches(docs, items).collect()) == 1


def test_frequent_grams_lose_nothing(monkeypatch, words):
    monkeypatch.setattr(d, "FREQUENT", 1)
    items = [(i, words("common", 12) + " " + words(i, 25)) for i in range(5)]
    index = d.index_of(items)
    assert [sorted({index.names[x[0]][0] for x in f}) for f in d.search(index, [t for _, t in items])] == [[i] for i in range(5)]


# License scans.
def test_licenses(spark, docs_of, words):
    grant = dict(license_scan.TEMPLATES)["mit-grant"]
    cut = grant.split()
    rows = [(1, words(1, 300)), (2, f"{words(2, 40)}\nReleased under the MIT License.\n{words(3, 40)}"), (3, words(4, 501) + " " + grant.upper()), (4, " ".join([*cut[:20], "changed", *cut[21:]])), (5, " ".join(cut[: len(cut) // 2])), (6, None), (7, ""), (8, "MIT License"), (9, "Released under the MIT License. " * 3), (9, "Licensed under CC BY-NC 4.0."), (None, grant + " and " + grant)]
    n = len(license_scan.WORD.findall(grant))
    got = sorted((r["doc_id"] or 99, r["template"], r["first"], r["end"]) for r in license_scan.matches(docs_of(rows)).collect())
    names = [(i, t) for i, t, _, _ in got]
    assert names == [(2, "mit"), (3, "mit-grant"), (4, "mit-grant"), (9, "cc-by-nc-4.0"), (9, "mit"), (9, "mit"), (9, "mit"), (99, "mit-grant"), (99, "mit-grant")]
    assert [x[2:] for x in got[-2:]] == [(0, n), (n + 1, 2 * n + 1)] and [x[2:] for x in got[4:7]] == [(0, 5), (5, 10), (10, 15)]
    assert license_scan.matches(docs_of(rows), []).count() == 0 and license_scan.matches(docs_of([])).count() == 0
    clash = spark.createDataFrame([(1, "Released under the MIT License.", 5, "a")], "doc_id long, text string, matches int, earlier_matches_ string")
    out = license_scan.with_matches(clash)
    assert out.columns == ["doc_id", "text", "earlier_matches_", "matches"] and len(out.first()["matches"]) == 1


def plain_matches(templates, text):
    """All matches by a plain search over the whole text, by words, without windows or hashes."""
    words, out = [w.lower() for w in license_scan.WORD.findall(text or "")], set()
    for name, t in templates:
        own = [w.lower() for w in license_scan.WORD.findall(t or "")]
        width, drift = min(5, len(own)), len(own) // 4 + 1
        if not own:
            continue
        at: dict = {}
        for k in range(len(own) - width + 1):
            at.setdefault(tuple(own[k : k + width]), []).append(k)
        hits = [(p - k, p, sh) for p in range(len(words) - width + 1) for sh in [tuple(words[p : p + width])] for k in at.get(sh, ())]
        if len(own) < 5:
            drift = 1
        found = set()
        for low in range(-len(own) // drift * drift - drift, len(words) + drift, drift):
            band = [(p, sh) for d_, p, sh in hits if low <= d_ < low + (2 * drift if len(own) >= 5 else 1)]
            if band and 4 * len({sh for _, sh in band}) >= 3 * len(at):
                found.add((len({sh for _, sh in band}) / len(at), min(band)[0], max(band)[0] + width))
        kept: list = []
        for m in sorted(found, key=lambda m: (-m[0], m[2] - m[1], m[1])):
            if not any(m[1] < b and a < m[2] for _, a, b in kept):
                kept.append(m)
        out |= {(name, *m) for m in kept}
    return out


def test_license_matches_against_plain_search(words):
    """Whole rows: template, containment and span; of broken, doubled and neighbouring texts."""
    r = random.Random(6)
    templates = [*license_scan.TEMPLATES, ("tiny", "two words"), ("one", "zqx"), ("none", "?!"), ("periodic", "la la le " * 9)]
    index = license_scan.indexed(templates)
    for n in range(120):
        doc = words(n, r.randint(0, 300)).split()
        for _ in range(r.randint(1, 3)):
            own = license_scan.WORD.findall(r.choice(templates)[1])
            for _ in range(r.randint(0, max(0, len(own) // 20))):
                k, j = r.randrange(3), r.randrange(len(own))
                own[j : j + (k != 2)] = ["other"] if k != 1 else []
            if r.random() < 0.1:
                own = own[: len(own) // 2]
            doc += [*own, *words(n + 0.5, r.choice([0, 1, 40])).split()]
        got = license_scan.scan(index, " ".join(doc))
        assert set(got) == plain_matches(templates, " ".join(doc)) and len(set(got)) == len(got), n


def test_blocks_of_templates_change_nothing(spark, docs_of, words, monkeypatch):
    docs = docs_of([(i, words(i, 30) + " " + t) for i, (_, t) in enumerate(license_scan.TEMPLATES)])
    one = sorted(map(tuple, license_scan.matches(docs).collect()))
    monkeypatch.setattr(license_scan, "MOST_TEMPLATE_WORDS", 200)
    assert len(list(license_scan.blocks_of(license_scan.TEMPLATES))) > 4
    table = spark.createDataFrame(license_scan.TEMPLATES, "name string, text string")
    assert sorted(map(tuple, license_scan.matches(docs, table).collect())) == one and len(one) >= len(license_scan.TEMPLATES)


# Quality.
def test_quality(spark, docs_of, words):
    good = lambda i: (i, ". ".join(words(i * 10 + k, 12) for k in range(5)))
    junk = lambda i: (i, " ".join(w + "$$$" for w in words(i, 50).split()) if i % 2 else "spam " * 60)
    rows = [good(i) if i % 5 else junk(i) for i in range(1, 600)]
    labels = spark.createDataFrame([(i, int(i % 5 > 0), "x") for i in range(1, 600, 2)], "doc_id long, quality int, text string")
    extra = docs_of([*rows, (1000, None), (1001, ""), (1002, "x" * 50000), (1003, rows[0][1]), (1003, rows[0][1])])
    fold = lambda i: doc_fold(i, 3) != 1
    got = quality.score_texts(extra, labels, fold).collect()
    assert len(got) == len(rows) + 5 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    right = [r["predicted"] == int(r["doc_id"] % 5 > 0) for r in got if r["doc_id"] < 1000]
    assert sum(right) / len(right) > 0.95
    again = {(r["doc_id"], r["text"]): r["score"] for r in quality.score_texts(extra.repartition(5), labels, fold).collect()}
    assert all(abs(again[r["doc_id"], r["text"]] - r["score"]) < 1e-9 for r in got)
    blind = quality.score_texts(extra, labels.filter("quality = 0"), fold).collect()
    assert len({r["score"] for r in blind}) == 1
    assert quality.score_texts(extra.limit(0), labels.limit(0), fold).count() == 0


def test_quality_reads_labels_of_the_training_fold_only(spark, docs_of, words):
    rows = [(i, words(i, 30) + ("!!! " * 30 if i % 3 == 0 else "")) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)], "doc_id long, quality int")
    flipped = labels.withColumn("quality", F.when(doc_fold(F.col("doc_id"), 3) == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    take = lambda x: {r["doc_id"]: r["score"] for r in quality.score_texts(docs_of(rows), x, lambda i: doc_fold(i, 3) != 1).collect()}
    assert take(labels) == take(flipped)


def test_quality_reads_positive_labels_only(spark, docs_of, words):
    rows = [(i, words(i, 30) + ("!!! " * 30 if i % 3 == 0 else "")) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)], "doc_id long, quality int")
    take = lambda x: {r["doc_id"]: r["score"] for r in quality.score_texts(docs_of(rows), x, lambda i: doc_fold(i, 3) != 1).collect()}
    assert take(labels) == take(labels.filter("quality = 1"))


def test_many_rows_of_one_id_teach_once(spark, docs_of, words, monkeypatch):
    rows = [(i, words(i, 30)) for i in range(60)] + [(7, words(1000 + i, 10)) for i in range(500)] + [(None, "no id")] * 50
    labels = spark.createDataFrame([(i, 1) for i in range(0, 60, 2)] + [(7, 1)], "doc_id long, quality int")
    seen, fitted = [], quality.fitted
    monkeypatch.setattr(quality, "fitted", lambda p, u, *a: seen.append((len(p), len(u))) or fitted(p, u, *a))
    docs = docs_of(rows).select("doc_id", "text", F.lit(1).alias("score"), F.lit("g").alias("good"))
    got = quality.score_texts(docs, labels, lambda i: F.lit(True))
    assert got.columns == ["doc_id", "text", "good", "score", "predicted"] and got.count() == len(rows)
    assert max(seen) == (31, 60)  # and halves of them for the prior
    seen.clear()
    quality.score_texts(docs, labels, lambda i: F.lit(True), most_positives=10, most_unlabelled=20)
    assert max(seen) == (10, 20)
    seen.clear()
    quality.score_texts(docs, labels, lambda i: F.lit(True), most_positives=None, most_unlabelled=None)
    assert max(seen) == (31, 60)


def test_risk_and_its_slopes_against_direct_computation():
    r = np.random.default_rng(1)
    unbiased = lambda gp, gu, prior: (prior * sum(math.log(1 + math.exp(-x)) for x in gp) / len(gp), sum(math.log(1 + math.exp(x)) for x in gu) / len(gu) - prior * sum(math.log(1 + math.exp(x)) for x in gp) / len(gp))
    branches = set()
    for prior, lift in ((0.3, 0.0), (0.9, 0.0), (0.9, 4.0), (0.99, 2.0)):
        gp, gu = r.normal(lift, 1, 5), r.normal(0, 1, 7)
        good, bad = quality.risk(gp, gu, prior)
        assert np.allclose((good, bad), unbiased(gp, gu, prior))
        branches.add(bad >= 0)
        target = (lambda x: sum(quality.risk(x[:5], x[5:], prior))) if bad >= 0 else (lambda x: -quality.risk(x[:5], x[5:], prior)[1])  # noqa: B023
        x = np.concatenate([gp, gu])
        steps = np.eye(12) * 1e-6
        numeric = [(target(x + e) - target(x - e)) / 2e-6 for e in steps]
        assert np.allclose(numeric, quality.slopes(gp, gu, prior), atol=1e-8)
        apart = lambda x: np.logaddexp(0, -x[:5]).mean() + np.logaddexp(0, x[5:]).mean()
        assert np.allclose([(apart(x + e) - apart(x - e)) / 2e-6 for e in steps], quality.apart_slopes(gp, gu), atol=1e-8)
    assert branches == {True, False}


def test_network_gradient_against_differences():
    r = np.random.default_rng(2)
    net = quality.Network(r.normal(0, 1, (9, 6)))
    z, weights = r.normal(0, 1, (9, 6)), r.normal(0, 1, 9)
    before = [p.copy() for p in net.params]
    g, h = net.raw(z)
    moved = quality.Network(r.normal(0, 1, (9, 6)))
    moved.params = [p.copy() for p in before]
    moved.step(z, h, weights)
    loss = lambda: float((net.raw(z)[0] * weights).sum())
    for p, q in zip(net.params, moved.params, strict=True):  # Adam's first step goes against the gradient's sign
        flat, out = p.reshape(-1), (q - p).reshape(-1)
        for i in range(0, len(flat), 7):
            flat[i] += 1e-6
            up = loss()
            flat[i] -= 2e-6
            slope = (up - loss()) / 2e-6
            flat[i] += 1e-6
            assert abs(slope) < 1e-3 or np.sign(out[i]) == -np.sign(slope)


@pytest.mark.parametrize("prior", [0.2, 0.5, 0.85])
def test_prior_from_positives_and_unlabelled_texts(prior):
    r = np.random.default_rng(int(prior * 100))
    good = lambda n: r.normal(1.5, 1, (n, 4))
    n = int(prior * 3000)
    unlabelled = np.concatenate([good(n), r.normal(-1.5, 1, (3000 - n, 4))])
    assert abs(quality.estimated_prior(good(1200), unlabelled) - prior) < 0.08


# Rollups.
def change(spark, *rows):
    return spark.createDataFrame(rows, "op string, source string, lang string, tokenizer string, n_tokens long, old_tokens long")


def totals(rollup):
    return {tuple(r)[:3]: tuple(r)[3:] for r in rollup.totals().collect()}


def test_rollup(spark, tmp_path):
    rollup = token_rollup.Rollup(spark, f"file://{tmp_path}/r")
    assert totals(rollup) == {}
    rollup.compact()
    load = change(spark, ("insert", "a", "en", "t1", 10, None), ("insert", "a", "en", "t1", 5, None), ("insert", None, "en", "t1", None, None), ("insert", "b", None, "t1", 7, None))
    assert rollup.commit("load", load) and not rollup.commit("load", load.repartition(3))
    with pytest.raises(ValueError, match="other changes"):
        rollup.commit("load", load.limit(2))
    fix = change(spark, ("revise", "a", "en", "t1", 6, 5), ("delete", "b", None, "t1", 7, None))
    assert rollup.commit("fix", fix)
    want = {("a", "en", "t1"): (2, 16), (None, "en", "t1"): (1, 0)}
    assert totals(rollup) == want
    rollup.compact()
    assert totals(rollup) == want and not rollup.commit("fix", fix)  # ids are known after compaction too
    rollup.commit("more", change(spark, ("insert", "a", "en", "t2", 1, None)))
    assert totals(rollup) == want | {("a", "en", "t2"): (1, 1)}
    rollup.compact()
    assert totals(rollup) == want | {("a", "en", "t2"): (1, 1)}
    with pytest.raises(Exception, match="unknown op"):
        rollup.commit("bad", change(spark, ("upsert", "a", "en", "t1", 1, None)))
    assert "bad" not in rollup.committed() and rollup.committed() == ["fix", "load", "more"]
    with pytest.raises(ValueError):
        rollup.commit("../x", load)
    assert rollup.commit("none", load.limit(0)) and not rollup.commit("none", load.limit(0)) and rollup.commit("0001", load.limit(0))
    clash = change(spark, ("insert", "z", "en", "t1", 2, None)).selectExpr("*", "'x' AS batch", "1 AS n_docs")
    assert rollup.commit("clash", clash) and totals(rollup)["z", "en", "t1"] == (1, 2)
    again = rollup.commit_stream("s")
    assert again(load, 0) and not again(load, 0)


def test_order_of_batches_does_not_matter(spark, tmp_path):
    batches = [(f"b{i}", change(spark, ("insert", "a", "en", "t", i, None), ("revise", "a", "en", "t", 2 * i, i))) for i in range(4)]
    results = []
    for n, order in enumerate((batches, batches[::-1])):
        r = token_rollup.Rollup(spark, f"file://{tmp_path}/{n}")
        for name, x in order:
            r.commit(name, x)
        results.append(totals(r))
    assert results[0] == results[1] == {("a", "en", "t"): (4, 12)}


def test_corpus_history(spark, tmp_path):
    import tiktoken

    rows = [(1, "the cat\nsat\nsat", "a", "en"), (2, "the cat\nsat\nsat", "b", "en"), (3, None, "a", None), (4, "", "a", "en"), (5, "été 日本 x " * 500, "b", "fr"), (5, "twin", "b", "fr"), (None, "no id", "a", "en"), (7, "no id", "a", "en")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, source string, lang string, words string")
    got = {tuple(r)[:3]: tuple(r)[3:] for r in token_rollup.corpus_history(docs, f"file://{tmp_path}/h").collect()}
    ranks = token_rollup.load_ranks(token_rollup.tokenizer_path("byte_bpe_50k.tiktoken"))
    coder = tiktoken.Encoding("t", pat_str=token_rollup.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want, seen = {}, set()
    for i, t, source, lang in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        t = t or ""
        if t in seen:
            continue
        seen.add(t)
        once = "\n".join(dict.fromkeys(t.split("\n")))
        for name, n in ((token_rollup.WORDS, len(once.split())), (token_rollup.BPE, len(coder.encode_ordinary(once)))):
            k = (source, lang, name)
            want[k] = (want.get(k, (0, 0))[0] + 1, want.get(k, (0, 0))[1] + n)
    assert got == want
    assert token_rollup.corpus_history(docs.limit(0), f"file://{tmp_path}/e").count() == 0


# The pipeline.
@pytest.fixture(scope="module")
def stages(spark):
    """What each stage gets and gives."""
    from loomquery.llm.common import table, written

    docs, out = table(spark, SMALL, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        made = written(stage(spark, docs, SMALL), f"test-{name}")
        out.append((name, docs, made))
        docs = made
    return {name: (a.toPandas(), b.toPandas()) for name, a, b in out}


def test_stages_are_as_asked():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "substring_dedup", "decontaminate", "encode"]


def test_quality_stage(spark, stages):
    before, after = stages["quality"]
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").toPandas().set_index("doc_id")["quality"]
    assert list(after.columns) == corpus_pipeline.COLUMNS and set(after.doc_id) < set(before.doc_id)
    kept = labels.index.isin(after.doc_id)
    assert kept[labels == 1].mean() > 0.95 and kept[labels == 0].mean() < 0.8  # few labels here; test_quality has more


def test_near_dedup_stage(stages):
    from test_duplicates import brute_components

    before, after = stages["near_dedup"]
    best = brute_components(list(zip(before.doc_id.tolist(), before.text, strict=True)))
    assert sorted(after.doc_id) == sorted(i for i, c in best.items() if i == c)


def test_substring_stage(stages):
    from test_duplicates import brute_removed

    before, after = stages["substring_dedup"]
    want = {}
    for (i, n, gone, kept), text in zip(brute_removed(list(zip(before.doc_id.tolist(), before.text, strict=True))), before.text, strict=True):
        if not n or gone < n:
            want[i] = kept if gone else text
    assert dict(zip(after.doc_id.tolist(), after.text, strict=True)) == want
    assert (after.n_chars == after.text.map(len)).all()


def test_decontaminate_stage(spark, stages):
    before, after = stages["decontaminate"]
    items = [r["text"] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    gone = set(before.doc_id) - set(after.doc_id)
    holds = {i for i, t in zip(before.doc_id, before.text, strict=True) if any(plain(x) in plain(t) for x in items)}
    assert holds <= gone and len(gone - holds) <= 1


def test_encode_stage(stages):
    from loomquery.llm.gumbel_encode import encoder

    before, after = stages["encode"]
    texts, enc = before.set_index("doc_id")["text"], encoder()
    assert sorted(after.doc_id) == sorted(before.doc_id)
    for i, samples in zip(after.doc_id, after.samples, strict=True):
        assert all(enc.decode(s["ids"]) == texts[i] for s in samples)
        assert len({tuple(s["ids"]) for s in samples}) == len(samples)
