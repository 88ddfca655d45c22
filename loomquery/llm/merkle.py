"""Document fingerprints: a Merkle tree over blocks, paragraphs and sections, in SQL functions only.

A text is cut at line feeds into paragraphs. A paragraph's node is the SHA-256 of its exact text. A section is a run of
paragraphs up to one whose node ends in the digit 0, of about 16; its node is the SHA-256 of its
paragraphs' nodes, and the root that of the sections' nodes; so roots are equal just when texts are. Below each paragraph lie
short digests of its blocks, runs of words up to one that ends in a character of `ENDS`, without the space around
them, which let likeness see an edit inside a paragraph. Sections and blocks are cut by what they hold, not by place, so what is put in
or left out changes the branches it is in, and the ones after it stay as they are.

The fingerprint string is `root:section;section;...`, where a section is its node cut to `NODE_HEX` digits, a dot, and its
blocks' digests of `BLOCK_HEX` digits. It grows with the text, by about a seventh of it. `likeness` compares two fingerprints
from the root down: equal roots are 1; of the sections that both have, all blocks count as shared and are not looked at; only
sections that differ are opened, and their sets of blocks compared. The result is the Dice coefficient of the blocks, below 1.
`locate_edits` does the same with two versions' trees, and returns the paragraphs of differing sections that the other version lacks.

Defined results: a null text is an empty one. Rows that repeat are each fingerprinted. Texts without
any word have no blocks: their likeness to a different text is 0. An empty table gives an empty result. A very long text is one
row: its tree is in memory at once, some tens of bytes a word. `edited_pairs` and `locate_edits` read the key and the text only,
whatever the other columns' names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NODE_HEX, BLOCK_HEX = 16, 8
#: Characters at the end of a word that end its block: one word in eight or so. Fixed values.
ENDS = "gyoGYO.!?:;0-4ао。"
SPACES = " \t\n\v\f\r"


def sha(c):
    return F.sha2(c.cast("binary"), 256)


def block_digests(paragraph):
    cut = F.split(F.regexp_replace(paragraph, rf"([{ENDS}][\x20\x09-\x0D]+)", "$1\n"), "\n", -1)
    found = F.filter(F.transform(cut, lambda b: F.btrim(b, F.lit(SPACES))), lambda b: b != "")
    return F.array_join(F.transform(found, lambda b: F.substring(F.md5(b.cast("binary")), 1, BLOCK_HEX)), "")


def sections_of(text):
    """A text's sections: their paragraphs as node=blocks, with a comma behind each."""
    paragraphs = F.transform(F.split(text, "\n", -1), lambda p: F.concat(sha(p), F.lit("="), block_digests(p), F.lit(",")))
    # Only nodes are followed by an equals sign.
    cut = F.split(F.regexp_replace(F.array_join(paragraphs, ""), "(0=[0-9a-f]*,)", "$1;"), ";", -1)
    return F.filter(cut, lambda s: s != "")


def section_node(section):
    return sha(F.regexp_replace(section, "=[0-9a-f]*", ""))


def let(value, f):
    """f of a value that is computed once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def fingerprint(text):
    pairs = F.transform(sections_of(text), lambda s: F.struct(section_node(s).alias("node"), F.regexp_replace(s, "[0-9a-f]{64}=|,", "").alias("blocks")))
    root_ = lambda p: sha(F.array_join(F.transform(p, lambda x: x["node"]), ""))
    shown = lambda p: F.array_join(F.transform(p, lambda x: F.concat(F.substring(x["node"], 1, NODE_HEX), F.lit("."), x["blocks"])), ";")
    return let(pairs, lambda p: F.concat(root_(p), F.lit(":"), shown(p)))


def root(print_):
    return F.substring(print_, 1, 64)


def branches(print_):
    """The sections of a fingerprint."""
    return F.split(F.substring(print_, 66, F.length(print_)), ";")


def blocks(sections):
    """The distinct block digests below sections."""
    joined = F.array_join(F.transform(sections, lambda s: F.substring(s, F.lit(NODE_HEX + 2), F.length(s))), "")
    return F.array_distinct(F.regexp_extract_all(joined, F.lit(f"[0-9a-f]{{{BLOCK_HEX}}}"), F.lit(0)))


def likeness(a, b):
    """Of two fingerprints, from 0 to 1; 1 just for equal texts."""

    def of_branches(own, other):
        shared = F.aggregate(F.array_intersect(own, other), F.lit(0), lambda n, s: n + ((F.length(s) - NODE_HEX - 1) / BLOCK_HEX).cast("int"))
        return let(shared, lambda n: let(blocks(F.array_except(own, other)), lambda left: let(blocks(F.array_except(other, own)), lambda right: dice(n, left, right))))

    def dice(shared, left, right):
        both = 2 * shared + F.size(left) + F.size(right)
        return F.when(both > 0, 2.0 * (shared + F.size(F.array_intersect(left, right))) / both).otherwise(0.0)

    compared = let(branches(a), lambda own: let(branches(b), lambda other: of_branches(own, other)))
    # Different texts can share all blocks (in another order): they stay below 1.
    return F.when(root(a) == root(b), 1.0).otherwise(F.least(compared, F.lit(0.999))).cast("double")


def differing(a, b):
    """How many sections of fingerprint `a` the other one lacks."""
    return F.size(F.array_except(branches(a), branches(b)))


def locate_edits(old: DataFrame, new: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, version, section, paragraph, node): the paragraphs, counted from 0, that one version (`old` or `new`) has and
    the other lacks, in sections that it lacks.

    Keys that only one side has, and null keys, are left out.
    """
    tree = lambda df, name: df.select(F.col(f"`{key}`").alias("key"), F.transform(sections_of(F.coalesce(F.col(f"`{text}`"), F.lit(""))), lambda s: F.split(F.regexp_replace(s, "=[0-9a-f]*,$", ""), "=[0-9a-f]*,")).alias(name))
    both = tree(old, "old").join(tree(new, "new"), "key").filter("old <> new")
    found = []
    for own, other in (("old", "new"), ("new", "old")):
        # Equal sections are never opened.
        rest = F.flatten(F.array_except(other, own))
        each = both.select("key", F.expr(f"transform({own}, (s, i) -> aggregate(slice({own}, 1, i), 0, (n, x) -> n + size(x)))").alias("starts"), own, other, rest.alias("rest"))
        opened = each.select("key", "starts", other, "rest", F.posexplode(own).alias("section", "nodes")).filter(~F.array_contains(other, F.col("nodes")))
        lines = opened.select("key", "section", F.get("starts", "section").alias("first"), "rest", F.posexplode("nodes").alias("at", "node")).filter(~F.array_contains("rest", F.col("node")))
        found.append(lines.select("key", F.lit(own).alias("version"), "section", (F.col("first") + F.col("at")).alias("paragraph"), "node"))
    return found[0].union(found[1]).withColumnRenamed("key", key)


#: Bounds in one step of the two-step search for a row's range.
STEP = 64
#: The values that a text's place among rows of one id can take.
PLACES = 16**7


def range_of(doc_id, cuts: list[int]):
    """How many of the descending `cuts` are doc_id or more."""
    if not cuts:
        return F.lit(0)
    coarse = cuts[STEP - 1 :: STEP]
    skipped = F.size(F.filter(F.lit(coarse), lambda c: c >= doc_id)) if coarse else F.lit(0)
    fine = F.lit([[*cuts[i : i + STEP]] for i in range(0, len(cuts), STEP)] + [[cuts[-1]]])
    rest = F.size(F.filter(F.get(fine, skipped), lambda c: c >= doc_id))
    return F.least(skipped * STEP + rest, F.lit(len(cuts)))


def with_next(spark: SparkSession, docs: DataFrame, carried: list[str]) -> DataFrame:
    """`docs` (doc_id, text and the `carried` columns) with next_<c> for each carried column c: that of the
    next document by descending doc_id, and of the first after the last.

    Rows of one doc_id follow each other in the order of their texts' MD5; null ids come last. Rows are dealt by ranges of
    this order whose bounds are quantiles of doc_id: an id that is several quantiles is cut into as many ranges by the MD5, and so are
    the null ids, by their share; each row is shuffled once and each range is sorted on its own. A range's first row also goes, as a
    guest, to the range before it. What the driver holds is a row's id and MD5 a range.
    """
    n = 3 * int(spark.conf.get("spark.sql.shuffle.partitions"))  # several ranges a task even out their sizes
    stats = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], max(10_000, 100 * n)).alias("q"), F.count("*").alias("rows"), F.count("doc_id").alias("ids")).first()
    quantiles = stats["q"] or []
    cuts = sorted(set(quantiles), reverse=True)
    parts = [1, *(quantiles.count(c) for c in cuts)]  # range k + 1 begins with the id cuts[k]
    starts = [sum(parts[:k]) for k in range(len(parts) + 1)]
    blanks = max(1, -(-n * (stats["rows"] - stats["ids"]) // max(stats["rows"], 1)))
    docs = docs.withColumn("md5", F.md5(F.col("text").cast("binary")))
    share = F.conv(F.substring("md5", 1, 7), 16, 10).cast("long")
    at, own = range_of(F.col("doc_id"), cuts), F.col("doc_id")
    several = F.get(F.lit(parts), at)
    first = F.get(F.lit([None, *cuts] if cuts else [0]), at) == own
    known = F.get(F.lit(starts), at) + F.when(first, F.floor(share * several / PLACES)).otherwise(several - 1)
    part = F.when(own.isNull(), starts[-1] + F.floor(share * blanks / PLACES)).otherwise(known).cast("int")
    docs = docs.withColumn("part", part)
    heads = {r["part"]: r["h"] for r in docs.groupBy("part").agg(F.min(F.struct(F.bitwise_not("doc_id").alias("id"), "md5")).alias("h")).collect()}
    if not heads:
        return docs.select("*", *[F.col(c).alias(f"next_{c}") for c in carried]).drop("part", "md5")
    seen = sorted(heads)
    before = dict(zip(seen, [seen[-1], *seen[:-1]], strict=True))
    by_part = lambda f, kind: F.get(F.lit([f(p) for p in range(seen[-1] + 1)]).cast(f"array<{kind}>"), F.col("part"))
    head = lambda p, name: heads[p][name] if p in heads else None
    is_head = (by_part(lambda p: head(p, "md5"), "string") == F.col("md5")) & by_part(lambda p: head(p, "id"), "bigint").eqNullSafe(F.bitwise_not("doc_id"))
    stays = F.struct(F.col("part").alias("at"), F.lit(0).alias("guest"))
    goes = F.struct(by_part(lambda p: before.get(p, -1), "int").alias("at"), F.lit(1).alias("guest"))
    dealt = docs.select("*", F.inline(F.when(is_head, F.array(stays, goes)).otherwise(F.array(stays)))).drop("part")
    order = Window.partitionBy("at").orderBy("guest", F.col("doc_id").desc_nulls_last(), "md5")
    return dealt.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in carried]).filter("guest = 0").drop("at", "guest", "md5")


def edited_pairs(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Each document beside its text edited by its successor: the last half gives way to the successor's first part.

    `sections` counts the text's sections, `edited_sections` those of the edited text that differ.
    """
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("fingerprint", fingerprint(F.col("text")))
    d = with_next(spark, d, ["text", "fingerprint"]).withColumn("n_chars", F.length("text"))
    edited = F.expr("concat(substring(text, 1, n_chars - int(n_chars / 2)), substring(next_text, 1, int(n_chars / 2)))")
    d = d.select("doc_id", F.col("n_chars").cast("long").alias("n_chars"), "fingerprint", "next_fingerprint", edited.alias("edited"))
    d = d.select("*", sha(F.col("edited")).alias("edited_sha256"), fingerprint(F.col("edited")).alias("edited_fingerprint"))
    own, other = F.col("fingerprint"), F.col("edited_fingerprint")
    counts = [F.size(branches(own)).cast("long").alias("sections"), differing(other, own).cast("long").alias("edited_sections")]
    return d.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(own, other).alias("near_edited"), likeness(own, F.col("next_fingerprint")).alias("near_next"), *counts)
