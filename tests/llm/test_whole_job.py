"""The registered queries and the pipeline do the whole of their operators' jobs."""

from __future__ import annotations

import math

import corpus_pipeline
from helpers import SMALL
from loomquery.llm import decontaminate as d
from loomquery.llm import near_dedup, queries
from loomquery.llm.gumbel_encode import decode, encode, encoder, unpacked


def test_op4_decodes_every_sample(spark):
    out = queries.op4_gumbel_encode(spark, SMALL)
    rows = out.collect()
    assert "exact" in out.columns and all(r["exact"] for r in rows)
    enc, texts = encoder(), {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    ids = [unpacked(enc, bytes(r["ids"])) for r in rows]
    assert all(enc.decode(x) == texts[r["doc_id"]] and r["n_pieces"] == len(x) for r, x in zip(rows, ids, strict=True))
    lists = {r["doc_id"]: [tuple(s["ids"]) for s in r["samples"]] for r in encode(spark.read.parquet(f"{SMALL}/documents.parquet")).collect()}
    assert all(lists[r["doc_id"]][r["rank"]] == tuple(x.tolist()) for r, x in zip(rows, ids, strict=True))
    assert all(r["decoded"] == texts[r["doc_id"]] for r in decode(out).collect())
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id").collect()}


def test_the_pipeline_decodes_every_sample(docs_of):
    out = corpus_pipeline.encode_stage(None, docs_of([(1, "two  words"), (2, None), (3, "日本語 ▁")]), SMALL)
    assert "exact" in out.columns and [r["exact"] for r in out.collect()] == [True] * 3


def plain(codes):
    return "".join(map(chr, codes))


def test_every_occurrence_of_an_item_is_reported(spark, docs_of, words):
    item = words("i", 20)
    text = f"{item} {words(1, 50)} {item[:-1]}# {words(2, 30)} {item}"
    rows = d.matches(docs_of([(1, text)]), spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    normal = plain(d.normal(text))
    exact = [r for r in rows if r["edits"] == 0]
    assert len(rows) == 3 and len(exact) == 2 and all(normal[r["first"] : r["end"]] == item for r in exact)
    assert d.apart({(0, 5, 10), (1, 9, 14), (1, 10, 15), (2, 0, 5), (2, 4, 9)}) == [(0, 5, 10), (1, 10, 15), (2, 0, 5)]


def test_short_items_occur_as_whole_words(spark, docs_of):
    items = spark.createDataFrame([(1, "Who wrote Emma?"), (2, "東京都の人口は何人ですか今年")], "item_id long, text string")
    rows = [(1, "q: who wrote  EMMA"), (2, "who wrote emmas"), (3, "xwho wrote emma"), (4, "who wrote emma, who wrote emma"), (5, "。東京都の人口は何人ですか今年。"), (6, "who wrote ema")]
    got = sorted((r["doc_id"], r["item_id"], r["edits"]) for r in d.matches(docs_of(rows), items).collect())
    assert got == [(1, 1, 0), (4, 1, 0), (4, 1, 0), (5, 2, 0)]


def test_runs_of_short_sentences_are_parts(spark, docs_of):
    sentences = [f"The {a} river runs past {b}." for a, b in zip(("grey", "wide", "old", "cold", "slow", "deep"), ("Aldham", "Birwick", "Corley", "Dunmow", "Elmsett", "Farnham"), strict=True)]
    items = spark.createDataFrame([(1, " ".join(sentences))], "item_id long, text string")
    rows = [(i, "So they say. " + " ".join(sentences[i : i + 3]) + " And so on.") for i in range(4)] + [(9, "It rained. " + sentences[2])]
    assert {r["doc_id"] for r in d.matches(docs_of(rows), items).collect()} == {0, 1, 2, 3}
    lengths = [len(p) for k, p in d.parts_of("Yes. " + "word " * 20 + "stop. No. No.") if k >= 0]
    assert lengths == [104]  # a run that holds a shorter one is left out


def test_signature_filter_misses_less_than_the_index():
    def missed(n, least):
        return sum(math.comb(n, k) * 0.25**k * 0.75 ** (n - k) for k in range(least, n + 1))

    assert missed(60, near_dedup.FARTHEST + 1) < 0.01 * missed(near_dedup.SYMBOLS, near_dedup.ERRORS + 1) ** near_dedup.CHUNKS


ODD = [(1, None, None, None, None, 1), (2, "", "en", "s", 0, 2), (None, "no id here", "en", None, 10, 3), (3, " \t\n", None, "s", 3, 4), (4, "word " * 4000, "xx", "s", None, 5), (5, "twin text of some words here", "en", "s", 28, 6), (5, "twin text of some words here", "en", "s", 28, 7), (6, "日本語 ▁ 🙂", "ja", "s", 8, 8)]


def test_stages_take_odd_tables(spark):
    """Nulls in every column, empty and long texts, repeated rows and extra columns with the stages' own names; and no rows at all."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept_id int"
    docs = spark.createDataFrame(ODD, schema).selectExpr("*", "1 AS score", "2 AS hits", "3 AS gone_", "'x' AS kept", "4 AS samples", "5 AS exact")
    for name, stage in corpus_pipeline.STAGES:
        for given in (docs, docs.limit(0)):
            out = stage(spark, given, SMALL)
            rows = out.collect()
            if name == "encode":
                assert set(out.columns) == {"doc_id", "lang", "source", "samples", "exact"} and all(r["exact"] for r in rows)
            else:
                assert out.columns == corpus_pipeline.COLUMNS
            if name != "quality":
                assert len(rows) == given.count() and sorted(str(r["doc_id"]) for r in rows) == sorted(str(r["doc_id"]) for r in given.collect())
            else:
                assert len(rows) <= given.count()


def test_scratch_tables_go(spark, tmp_path):
    """Tables of a run are deleted as soon as no plan reads them, and all at the end of the driver; a cluster must name its folder."""
    import pytest

    from loomquery import shared

    df = shared.written(spark.range(5), "gone")
    [path] = {f.rsplit("/", 1)[0].removeprefix("file://") for f in df.inputFiles()}
    assert df.count() == 5
    shared.dropped(df)
    import os

    assert not os.path.exists(path)

    class Elsewhere:
        class sparkContext:  # noqa: N801
            master = "spark://cluster"
            getConf = staticmethod(dict)

            class _jsc:  # noqa: N801
                @staticmethod
                def sc():
                    class Sc:
                        @staticmethod
                        def getCheckpointDir():
                            class Nothing:
                                isDefined = staticmethod(lambda: False)

                            return Nothing

                    return Sc

        class conf:  # noqa: N801
            get = staticmethod(lambda name, default: default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(Elsewhere)
