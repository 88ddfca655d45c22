"""Token counts as delta-maintained rollups: additive totals by source, language and tokenizer version.

A change is a row (op, source, lang, tokenizer, n_tokens, old_tokens): `insert` adds a document and its tokens, `delete`
takes them away, `revise` keeps the document and replaces old_tokens by n_tokens. A batch of changes becomes signed
deltas, summed by key (combined before the shuffle, so a hot source is one row a task), and is written as one
small table. Totals are the sum of all committed batches; sums commute, so batches may come in any order.

A commit is idempotent: a batch is known by its id. Its deltas are written under a name of their own, then renamed to the
batch's folder, which exists just when the batch is committed. Committing an id again does nothing if its deltas
are the same, which a digest kept with the batch tells, and is an error if they aren't. A job
that dies leaves no trace that counts, and of two that race the second's rename fails. `compact` sums the
committed batches into a snapshot with a table of their ids; readers take the newest complete snapshot and the batches
whose ids that table lacks, by an anti join: neither ids nor deltas come to the driver. (Renaming is atomic on HDFS and local disks; a
store without it needs a lock around commit.)

Defined results: null sources, languages and tokenizers are keys of their own. A null count is 0. A key whose documents
and tokens are both 0 is left out of the totals. An unknown op is an error that commits nothing. Repeated rows of a
batch each count: a batch holds each change once. A batch without changes is committed and adds nothing; without batches there are no
totals. A very long text is counted whole, by itself. Other columns of a batch or of the documents are not read, whatever their names.
"""

from __future__ import annotations

import base64
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written
from .lattice import tokenizer_path
from .words import split_words

KEYS = ["source", "lang", "tokenizer"]
TOTALS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def deltas(changes: DataFrame) -> DataFrame:
    """A batch's signed sums by key."""
    new, old = F.coalesce("n_tokens", F.lit(0)), F.coalesce("old_tokens", F.lit(0))
    docs = F.expr("case op when 'insert' then 1 when 'delete' then -1 when 'revise' then 0 else raise_error(concat('unknown op ', coalesce(op, 'null'))) end")
    tokens = F.when(F.col("op") == "insert", new).when(F.col("op") == "delete", -new).otherwise(new - old)
    rows = changes.select(*KEYS, docs.cast("long").alias("n_docs"), tokens.cast("long").alias("n_tokens"))
    return summed(rows)


def digest_of(sums: DataFrame) -> str:
    """The name of the file that marks a batch of these deltas, whatever their order."""
    n, total = sums.agg(F.count("*"), F.sum(F.xxhash64(*KEYS, "n_docs", "n_tokens").cast("decimal(38,0)"))).first()
    return f"_digest_{n}_{total or 0}"


def summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


class Rollup:
    """Totals kept at a path that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, *names: str):
        p = self.jvm.org.apache.hadoop.fs.Path("/".join([self.path, *names]))
        return p.getFileSystem(self.conf), p

    def _names(self, folder: str) -> list[str]:
        fs, p = self._at(folder)
        return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []

    def committed(self) -> list[str]:
        return [n.removeprefix("batch=") for n in self._names("batches")]

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Adds a batch's changes to the totals; False if the batch is there already. Another batch of its id is an error."""
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", batch or ""):
            raise ValueError(f"not a batch id: {batch!r}")
        fs, to = self._at("batches", f"batch={batch}")
        if fs.exists(to):
            return self._same(batch, deltas(changes))
        attempt = f"attempt-{uuid.uuid4().hex}"
        deltas(changes).write.parquet(f"{self.path}/attempts/{attempt}")
        sums = self.spark.read.schema(TOTALS).parquet(f"{self.path}/attempts/{attempt}")
        fs.create(self._at("attempts", attempt, digest_of(sums))[1]).close()
        fs.mkdirs(to.getParent())
        _, made = self._at("attempts", attempt)
        # A rename onto a folder that has come up meanwhile would move this one into it: look, then undo.
        if fs.exists(to) or not fs.rename(made, to):
            same = self._same(batch, sums)
            fs.delete(made, True)
            return same
        nested, where = self._at("batches", f"batch={batch}", attempt)
        if nested.exists(where):
            nested.delete(where, True)
            return False
        return True

    def _same(self, batch: str, sums: DataFrame) -> bool:
        """False, if the committed batch of this id has these deltas; else an error."""
        fs, mark = self._at("batches", f"batch={batch}", digest_of(sums))
        if not fs.exists(mark):
            raise ValueError(f"batch {batch!r} is committed with other changes")
        return False

    def commit_stream(self, name: str):
        """For foreachBatch: a micro-batch that is delivered twice counts once."""
        return lambda changes, number: self.commit(f"{name}-{number}", changes)

    def _snapshots(self) -> list[str]:
        return [n for n in self._names("snapshots") if self._at("snapshots", n, "_SUCCESS")[0].exists(self._at("snapshots", n, "_SUCCESS")[1])]

    def _batches(self) -> DataFrame:
        """The committed batches' deltas, with their ids."""
        fs, p = self._at("batches")
        if not fs.exists(p) or not fs.listStatus(p):
            return self.spark.createDataFrame([], f"{TOTALS}, batch string")
        return self.spark.read.schema(f"{TOTALS}, batch string").parquet(f"{self.path}/batches")

    def _rows(self, batches: DataFrame) -> DataFrame:
        """The rows whose sum the totals are: the newest snapshot's, and those of the batches that it doesn't hold."""
        newest, columns = self._snapshots()[-1:], [*KEYS, "n_docs", "n_tokens"]
        if not newest:
            return batches.select(columns)
        held = self.spark.read.schema("batch string").parquet(f"{self.path}/snapshots/{newest[0]}/batches")
        fresh = batches.join(held, "batch", "left_anti").select(columns)
        return self.spark.read.schema(TOTALS).parquet(f"{self.path}/snapshots/{newest[0]}/totals").select(columns).union(fresh)

    def totals(self) -> DataFrame:
        return summed(self._rows(self._batches())).filter("n_docs <> 0 or n_tokens <> 0")

    def compact(self) -> None:
        """Sums all batches so far into a snapshot. The batches' folders stay as the record of their ids."""
        batches = self._batches()  # one listing for both tables: a batch that comes later is in neither
        name = f"{len(self._names('snapshots')):08d}-{uuid.uuid4().hex}"
        at = f"{self.path}/snapshots/{name}"
        summed(self._rows(batches)).write.parquet(f"{at}/totals")
        batches.select("batch").distinct().write.parquet(f"{at}/batches")
        fs, mark = self._at("snapshots", name, "_SUCCESS")
        fs.create(mark).close()


#: How a byte-level merge vocabulary cuts a text into words, and no special tokens. Fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_encodings: dict[str, object] = {}


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def encoding_of(name: str, ranks: dict[bytes, int]):
    if name not in _encodings:
        import tiktoken

        _encodings[name] = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[name]


def without_repeated_lines(text: str) -> str:
    return "\n".join(dict.fromkeys(text.split("\n")))


WORDS, BPE = "words-1", "byte_bpe_50k"


def count_rows(ranks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = encoding_of(BPE, ranks.value)
        count = lambda t: (len(split_words(t)), len(encoding.encode_ordinary(t)))
        for batch in batches:
            rows = []
            for text in batch["text"].to_pylist():
                text = text or ""
                once = without_repeated_lines(text)
                own = count(text)
                rows.append((*own, *(own if len(once) == len(text) else count(once))))
            names = ["words", "bpe", "words_once", "bpe_once"]
            kept = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(batch[n] for n in kept), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(4))], [*kept, *names])

    return run


def counted(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, source, lang, digest, words, bpe, words_once, bpe_once): each text's tokens by tokenizer version, as it
    is and without its repeated lines."""
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(path or tokenizer_path("byte_bpe_50k.tiktoken")))
    rows = docs.select("doc_id", "source", "lang", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"), "text")
    return rows.mapInArrow(count_rows(ranks), "doc_id long, source string, lang string, digest string, words long, bpe long, words_once long, bpe_once long")


def changes_of(rows: DataFrame, op: str, new: tuple[str, str], old: tuple[str, str] | None = None) -> DataFrame:
    """The changes that `rows` make, one for each tokenizer version."""
    versions = [F.struct(F.lit(v).alias("tokenizer"), F.col(n).alias("n_tokens"), (F.col(o) if o else F.lit(None).cast("long")).alias("old_tokens")) for v, n, o in zip((WORDS, BPE), new, old or (None, None), strict=True)]
    return rows.select(F.lit(op).alias("op"), "source", "lang", F.inline(F.array(*versions)))


def corpus_history(docs: DataFrame, path: str) -> DataFrame:
    """Totals after a corpus is loaded, its exact copies are deleted and its repeated lines dropped, a batch each.

    Of the rows that have one text the first by id stays (rows that share the id too: any one). The delete batch is
    delivered twice, as after a lost acknowledgement.
    """
    spark = docs.sparkSession
    rows = written(counted(docs), "token-counts")
    rollup = Rollup(spark, path)
    rollup.commit("load", changes_of(rows, "insert", ("words", "bpe")))
    one = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "source", "lang", "words", "bpe", "words_once", "bpe_once")
    by_text = rows.groupBy("digest").agg(F.min(one).alias("kept"))
    kept = by_text.select("kept.*")
    # Deleting a text's other rows is deleting all and inserting the kept one again, in one batch: no join is needed.
    delete = changes_of(rows, "delete", ("words", "bpe")).union(changes_of(kept, "insert", ("words", "bpe")))
    rollup.commit("copies", delete)
    rollup.commit("copies", delete)
    revised = kept.filter("words <> words_once or bpe <> bpe_once")
    rollup.commit("repeated-lines", changes_of(revised, "revise", ("words_once", "bpe_once"), ("words", "bpe")))
    rollup.compact()
    return rollup.totals()
