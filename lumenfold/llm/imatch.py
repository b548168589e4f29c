"""Operator 4: I-Match fingerprints over randomised lexicons. DataFrame functions only.

A lexicon keeps the terms whose inverse document frequency lies in a band. A text's lexicon terms,
as 64-bit codes, are made distinct, sorted and hashed: once whole, and once for each of DRAWS * LEVELS randomised
subsets of the lexicon. The subsets of one draw are nested, keep an eighth of the terms and then a quarter of those each
time, so texts of any length have subsets that hold a few of their terms.

Likeness of two fingerprints: 1 for equal ones; else the share of draws in which they agree on
the smallest subset that holds a term of either. Draws without one are left out.

The band bounds the lexicon: a term of it is in at least exp(-HIGH) of all documents, so it has at
most exp(HIGH) times the mean number of distinct terms entries, at any corpus size. Up to MOST_TERMS
its hash table is a constant of the plan; a larger one is joined by shuffle.

Defined results: null and empty texts have an empty whole hash and are like only each other. A text without lexicon terms is
known by the hash of all its terms. The next document follows in descending doc_id, null last,
equal ids by text; the last one's next is the first, a single one's is itself. Repeated rows have equal fingerprints. A text is split
whole, in one task, with some 100 bytes of memory a word. An empty table gives an empty one. Clashing
column names cannot matter: only doc_id and text are read.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as c

LOW, HIGH = 1.0, 7.0
LEAST_DOCS = 2
DRAWS, LEVELS, SHRINK = 12, 4, 4
GROUP = 4
SLOTS = 1 << 16
MOST_TERMS = 1_000_000
#: Files of the lexicon, which is a small part of the terms that are counted for it.
FILES = 8
#: Ranges of the key: some for each shuffle partition, so that their sizes even out. So many bounds are quantiles; further ranges part theirs evenly.
RANGES_A_PARTITION, LEAST_RANGES, BOUNDS = 4, 64, 256
NONE = "------"


def terms_of(text: Column) -> Column:
    """64-bit codes of the distinct terms of a text, sorted."""
    terms = F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")
    return F.sort_array(F.array_distinct(F.transform(terms, lambda t: F.xxhash64(t))))


def slot(term: Column) -> Column:
    return F.pmod(term, F.lit(SLOTS)).cast("int")


def membership(term: Column) -> Column:
    """One bit for each subset: draw * LEVELS + level."""
    bits = F.lit(0).cast("long")
    for d in range(DRAWS):
        h = F.xxhash64(F.lit(d), term)
        for level in range(LEVELS):
            bits = bits + F.when(F.pmod(h, F.lit(2 * SHRINK ** (level + 1))) == 0, F.lit(1 << (d * LEVELS + level))).otherwise(F.lit(0))
    return bits


def lexicon(docs: DataFrame, n: int) -> DataFrame:
    """(term code, mask) of the terms in the band; n: the number of docs."""
    used = docs.select(F.explode(terms_of(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    band = used.filter(F.col("df").between(max(LEAST_DOCS, n * math.exp(-HIGH)), max(LEAST_DOCS, n * math.exp(-LOW))))
    return c.cut(band.select("term", membership(F.col("term")).alias("mask")).repartition(FILES))


def hashed_array(lex: DataFrame) -> DataFrame:
    """One row: an array of SLOTS maps term -> mask (null where none). Its size is bounded by MOST_TERMS."""
    spark = lex.sparkSession
    maps = lex.groupBy(slot(F.col("term")).alias("slot")).agg(F.map_from_entries(F.collect_list(F.struct("term", "mask"))).alias("m"))
    every = spark.range(SLOTS).select(F.col("id").cast("int").alias("slot")).join(maps, "slot", "left")
    return every.agg(F.transform(F.sort_array(F.collect_list(F.struct("slot", F.map_entries("m").alias("e")))), lambda x: F.map_from_entries(x["e"])).alias("a"))


class Lexicon:
    """Looks up the lexicon terms of texts: sorted array of (term code, mask)."""

    def __init__(self, docs: DataFrame):
        self.docs = docs.count()
        self.lex = lexicon(docs, self.docs)
        self.small = self.lex.count() <= MOST_TERMS
        self.array = c.cut(hashed_array(self.lex)) if self.small else None

    def add(self, df: DataFrame, text: str, into: str) -> DataFrame:
        """df with the column `into`: (terms found, hash of all terms)."""
        every = lambda ts: F.when(F.size(ts) > 0, F.xxhash64(ts))
        if self.small:
            # An array of one names the terms. They and the subquery are referred to once, so that the projections
            # become one and no row carries the lexicon: tests/llm/test_against_brute_force.py looks at the plan.
            look = lambda t: F.try_element_at(F.get("_lexicon", slot(t)), t)
            found = lambda ts: F.filter(F.transform(ts, lambda t: F.struct(t.alias("term"), look(t).alias("mask"))), lambda x: x["mask"].isNotNull())
            met = F.transform(F.array(terms_of(F.col(text))), lambda ts: F.struct(found(ts).alias("found"), every(ts).alias("every")))
            return df.withColumn("_lexicon", self.array.scalar()).withColumn(into, F.get(met, 0)).drop("_lexicon")
        df = df.withColumn("_terms", terms_of(F.col(text))).withColumn("_row", F.monotonically_increasing_id())
        df = c.written(df.withColumn("_every", every(F.col("_terms"))))  # the row numbers must stay
        met = df.select("_row", F.explode("_terms").alias("term")).join(self.lex, "term").groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("term", "mask"))).alias("_found"))
        none = F.array().cast("array<struct<term:bigint,mask:bigint>>")
        return df.join(met, "_row", "left").withColumn(into, F.struct(F.coalesce("_found", none).alias("found"), F.col("_every").alias("every"))).drop("_row", "_every", "_found", "_terms")


def piece(terms: Column, digits: int) -> Column:
    return F.lower(F.substring(F.lpad(F.hex(F.xxhash64(terms)), 16, "0"), 17 - digits, digits))


def fingerprint(met: Column) -> Column:
    """Pieces of a fingerprint: the whole hash (empty for no term), then one for each subset, draw by draw."""
    found = met["found"]
    whole = F.when(F.size(found) > 0, piece(F.transform(found, lambda x: x["term"]), 16)).otherwise(F.coalesce(F.lower(F.lpad(F.hex(met["every"]), 16, "0")), F.lit("")))
    has = lambda x, bits: x["mask"].bitwiseAND(bits) != 0
    hashed = lambda s: F.when(F.size(s) > 0, piece(F.transform(s, lambda x: x["term"]), 6)).otherwise(F.lit(NONE))
    named = lambda s, then: F.get(F.transform(F.array(s), then), 0)  # an array of one: s is found once and used often

    def draw(some: Column, bits: Column) -> Column:
        """The pieces of one draw: each subset lies in the one before."""
        level = lambda s, k: F.filter(s, lambda x: has(x, bits[f"b{k}"]))
        return named(level(some, 0), lambda s: F.array(hashed(s), *[hashed(level(s, k)) for k in range(1, LEVELS)]))

    # Draws go in groups: a pass over all terms for a group, then one over the group's few for each draw.
    bit = lambda d, k: F.lit(1 << (d * LEVELS + k))
    groups = [range(g, min(g + GROUP, DRAWS)) for g in range(0, DRAWS, GROUP)]
    table = F.array(*[F.struct(F.lit(sum(1 << d * LEVELS for d in g)).alias("any"), F.array(*[F.struct(*[bit(d, k).cast("long").alias(f"b{k}") for k in range(LEVELS)]) for d in g]).alias("draws")) for g in groups])
    pieces = F.transform(table, lambda g: named(F.filter(found, lambda x: has(x, g["any"])), lambda some: F.flatten(F.transform(g["draws"], lambda d: draw(some, d)))))
    return F.concat(F.array(whole), F.flatten(pieces))


def likeness(a: Column, b: Column) -> Column:
    """Of two arrays of pieces."""

    def vote(d: int) -> Column:
        """Whether the smallest subset with a term of either agrees: 1 or 0, null where none has one."""
        said = []
        for level in reversed(range(LEVELS)):
            x, y = (F.get(pieces, F.lit(1 + d * LEVELS + level)) for pieces in (a, b))
            said.append(F.when((x != NONE) | (y != NONE), (x == y).cast("int")))
        return F.coalesce(*said)

    votes = F.filter(F.array(*[vote(d) for d in range(DRAWS)]), lambda v: v.isNotNull())
    agreed = F.aggregate(votes, F.lit(0), lambda n, v: n + v)
    return F.when(a == b, 1.0).otherwise(F.coalesce(F.try_divide(agreed.cast("double"), F.size(votes).cast("double")), F.lit(0.0)))


def with_next(docs: DataFrame, prepare: Callable[[DataFrame], DataFrame], *, key: str, order: list[str], carry: list[str]) -> DataFrame:
    """prepare(docs) with next_<x> for each x of carry, from the following document in descending key, cyclically.

    Documents go to ranges of the key, as many as the cluster has use for; each range also gets the first document of the one
    below, so that no task sees more than its range.
    """
    spark = docs.sparkSession
    n = max(LEAST_RANGES, RANGES_A_PARTITION * c.parts(spark))
    many = min(n, BOUNDS)
    within = -(-n // many)
    bounds = docs.agg(F.percentile_approx(key, [i / many for i in range(1, many)], 100 * many)).first()[0] or []
    array = F.array(*[F.lit(x) for x in sorted(set(bounds))]).cast("array<bigint>")
    range_ = F.size(F.filter(array, lambda b: b < F.col(key)))
    if within > 1:
        low, high = F.try_element_at(array, F.nullif(range_, F.lit(0))), F.get(array, range_)
        share = F.try_divide(F.col(key).cast("double") - low, high.cast("double") - low)
        range_ = range_ * within + F.coalesce(F.least(F.lit(within - 1), F.floor(share * within)), F.lit(0))
    bucket = F.when(F.col(key).isNull(), -1).otherwise(range_)
    dealt = docs.withColumn("_bucket", bucket.cast("int")).withColumn("_extra", F.lit(0))
    heads = dealt.groupBy("_bucket").agg(F.max(key).alias("_head"))  # a row for each range
    ranges = Window.orderBy("_bucket")
    to = heads.select("_head", F.coalesce(F.lead("_bucket").over(ranges), F.first("_bucket").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("_to"))
    extra = dealt.join(F.broadcast(to), F.col(key).eqNullSafe(F.col("_head"))).withColumn("_bucket", F.col("_to")).withColumn("_extra", F.lit(1)).drop("_head", "_to")
    inside = Window.partitionBy("_bucket").orderBy("_extra", F.col(key).desc_nulls_last(), *order)
    rows = prepare(dealt.unionByName(extra)).withColumns({f"next_{x}": F.lead(x).over(inside) for x in carry})
    return rows.filter("_extra = 0").drop("_bucket", "_extra")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = c.table(spark, sf_dir, "documents").select("doc_id", c.text_of().alias("text"))
    words = Lexicon(docs)
    printed = lambda df, text, into: words.add(df, text, "_met").withColumn(into, fingerprint(F.col("_met"))).drop("_met")
    rows = with_next(docs, lambda df: printed(df, "text", "pieces"), key="doc_id", order=["text"], carry=["text", "pieces"])
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(F.col("next_text"), F.lit(1), third))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "pieces", "next_pieces")
    rows = printed(rows, "edited", "edited_pieces")
    said = lambda x: F.array_join(x, "")
    rows = rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited"), 256).alias("edited_sha256"), said("pieces").alias("fingerprint"), said("edited_pieces").alias("edited_fingerprint"),
        likeness(F.col("pieces"), F.col("edited_pieces")).alias("near_edited"), likeness(F.col("pieces"), F.col("next_pieces")).alias("near_next"),
    )
    return c.in_files(rows, words.docs)
