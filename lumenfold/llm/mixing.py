"""Operator 6: mixes sources to target weights by time-varying curricula.

Each source has a weight schedule over training time 0..1, linear between knots. Its integral is
the source's weight; the weights share the total size. Water filling caps a target at `most`
times its source's size and gives the excess to the other sources by weight. A source's words, in
a fixed hashed order of its documents and as many passes as needed, are its supply; word x of a
demand of D words is trained at the time t where the schedule's integral up to t is x/D of the
whole. Documents are range-sorted by that time.

The ranking moves a few numbers a document, no text; only stage(), which gives out the texts, moves them.

Defined results: null source is a source of its own, sorted last; null or empty texts have size 0
and nothing is taken; equal rows are separate documents, ranked side by side; an empty table gives an empty one. A
long text is one document and may be cut at the end of its source's demand. Clashing column names
are safe: only three columns are read, and stage() carries the row as one struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as c

#: Weight schedules, dealt to the sources in code-point order, repeating; the integrals are 5, 2 and 1.
SCHEDULES = (((0.0, 7.5), (1.0, 2.5)), ((0.0, 1.0), (0.5, 2.0), (1.0, 3.0)), ((0.0, 1.0), (1.0, 1.0)))
MOST = 3
#: Multiplier, fold and modulus of the arithmetic hash of doc_id by which a source's documents are ordered.
HASH, FOLD, MODULUS = 2654435761, 1 << 31, 1 << 32
#: Fewest ranges of the hash a source is summed in; as many as shuffle partitions where those are more. The order does not depend on it.
BUCKETS = 64
#: Most ranges that the table of sources is sorted in.
RANGES = 200


def integrals(knots) -> list[float]:
    """The integral of a schedule up to each of its knots."""
    out = [0.0]
    for (a, v), (b, w) in zip(knots, knots[1:], strict=False):
        out.append(out[-1] + (b - a) * (v + w) / 2)
    return out


def time_of(share: Column, knots) -> Column:
    """The time at which a share (0..1) of the schedule's integral is reached."""
    upto = integrals(knots)
    y = share * F.lit(upto[-1])
    out = None
    for k in reversed(range(len(knots) - 1)):
        (a, v), (b, w) = knots[k], knots[k + 1]
        rest = F.greatest(y - F.lit(upto[k]), F.lit(0.0))
        root = F.sqrt(F.greatest(F.lit(v * v) + F.lit(2 * (w - v) / (b - a)) * rest, F.lit(0.0)))
        here = F.when(rest <= 0, F.lit(a)).otherwise(F.lit(a) + F.try_divide(2 * rest, F.lit(v) + root))
        out = here if out is None else F.when(y < upto[k + 1], here).otherwise(out)
    return out


def ranked_sources(sizes: DataFrame) -> DataFrame:
    """Adds `place`, the rank (from 0) of each source in code-point order, null last; no single sorter."""
    spark = sizes.sparkSession
    by = F.col("source").asc_nulls_last()
    placed = c.cut(sizes.repartitionByRange(min(c.parts(spark), RANGES), by).sortWithinPartitions(by))
    placed = placed.withColumn("_id", F.monotonically_increasing_id())
    part, inner = F.shiftright("_id", 33), F.col("_id").bitwiseAND((1 << 33) - 1)
    starts, seen = {}, 0  # one entry a partition
    for p, n in sorted((r[0], r[1]) for r in placed.groupBy(part.alias("p")).count().collect()):
        starts[p], seen = seen, seen + n
    start = F.coalesce(*[F.when(part == p, F.lit(n)) for p, n in starts.items()], F.lit(0))
    return placed.withColumn("place", (start + inner).cast("long")).drop("_id")


def targets(sizes: DataFrame, schedules=SCHEDULES, most: float = MOST) -> DataFrame:
    """(source, source_size) to those, `place` and `target`. The driver holds only sums."""
    weights = [integrals(k)[-1] for k in schedules]
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("place", F.lit(len(weights))) + 1).cast("int"))
    shares = c.cut(ranked_sources(sizes).withColumn("weight", weight))
    total = shares.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:  # each round caps at least one more source, and few rounds do
        capped = F.col("weight") * level >= most * F.col("source_size")
        n, held, free = shares.agg(F.count_if(capped), F.sum(F.when(capped, most * F.col("source_size")).otherwise(0)), F.sum(F.when(capped, 0.0).otherwise(F.col("weight")))).first()
        if n == full or not free:
            break
        full, level = n, (total - held) / free
    target = F.least(F.col("weight") * level, (most * F.col("source_size")).cast("double"))
    return shares.withColumn("target", target).drop("weight")


def hashed(key: Column) -> Column:
    """0..2**32 - 1; a null key is 0."""
    return F.coalesce(F.pmod(F.pmod(key.cast("long"), F.lit(FOLD)) * F.lit(HASH), F.lit(MODULUS)), F.lit(0).cast("long"))


def mixed(docs: DataFrame, schedules=SCHEDULES, most: float = MOST, text: str = "text", source: str = "source", key: str = "doc_id", whole: bool = False) -> DataFrame:
    """A row per document: `key`, size, source_size, target, taken, place, offset; with `whole` also `row`, all its columns.

    offset: words of the source before this document. taken: whole passes and, for the document at
    which the demand ends, the first words of it.
    """
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    row = [F.struct(*[F.col(f"`{x}`") for x in docs.columns]).alias("row")] if whole else []
    rows = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), size.alias("size"), hashed(F.col(key)).alias("hash"), *row)
    if not whole:
        rows = c.written(rows)  # the texts are read once
    rows = rows.withColumn("bucket", F.floor(F.col("hash") / (MODULUS // max(BUCKETS, c.parts(docs.sparkSession)))).cast("int"))
    sums = c.cut(rows.groupBy("source", "bucket").agg(F.sum("size").alias("held")))
    per_source = targets(sums.groupBy("source").agg(F.sum("held").alias("source_size")), schedules, most)
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("start", F.coalesce(F.sum("held").over(before), F.lit(0))).alias("a").join(per_source.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")))
    starts = starts.select(F.col("a.source").alias("s_source"), F.col("bucket").alias("s_bucket"), "start", "source_size", "target", "place")
    inside = Window.partitionBy("source", "bucket").orderBy("hash", "key", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(starts, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("bucket") == F.col("s_bucket")))
    demand, offset = F.floor("target"), F.col("start") + F.col("within")
    passes = F.when(F.col("source_size") > 0, F.floor(F.try_divide(demand, F.col("source_size")))).otherwise(0)
    rest = F.greatest(F.lit(0), F.least(F.col("size"), demand - passes * F.col("source_size") - offset))
    return rows.select("key", *["row"] * whole, "size", "source_size", "target", (passes * F.col("size") + rest).cast("long").alias("taken"), "place", offset.cast("long").alias("offset"))


def position(nth: Column, schedules=SCHEDULES) -> Column:
    """The training time (0..1) of the nth pass (from 0) over a row of mixed()."""
    share = F.least(F.lit(1.0), F.coalesce(F.try_divide(nth * F.col("source_size") + F.col("offset"), F.floor("target")), F.lit(0.0)))
    kind = F.pmod("place", F.lit(len(schedules)))
    return F.coalesce(*[F.when(kind == i, time_of(share, k)) for i, k in enumerate(schedules)])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """position, position_2, position_3: where each pass over the document is trained; null for a pass that is not made."""
    docs = c.table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    at = lambda n: F.when(F.col("taken") > n * F.col("size"), F.round(position(F.lit(n)), 9)).alias(f"position_{n + 1}" if n else "position")
    rows = mixed(docs).select(F.col("key").alias("doc_id"), "size", "source_size", "target", "taken", *[at(n) for n in range(MOST)])
    return rows.orderBy("position", "doc_id")


def first_words(text: Column, n: Column) -> Column:
    """The first n words of a text with the white space before and between them."""
    return F.array_join(F.slice(F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"), F.lit(1), n), "")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: every document as often as it is taken, in training order; one cut short keeps its first words."""
    rows = mixed(docs, whole=True).filter("taken > 0").withColumn("nth", F.explode(F.sequence(F.lit(0), ((F.col("taken") - 1) / F.col("size")).cast("int"))))
    words = F.least(F.col("size"), F.col("taken") - F.col("nth") * F.col("size"))
    text = F.when(words == F.col("size"), F.col("row.text")).otherwise(first_words(F.col("row.text"), words.cast("int")))
    rows = rows.withColumn("_at", position(F.col("nth"))).withColumn("_text", text).orderBy("_at", "key", "nth")
    cols = {"text": F.col("_text"), "n_chars": F.length("_text").cast("long")}
    return rows.select(*[(cols[x] if x in cols else F.col(f"row.`{x}`")).alias(x) for x in docs.columns])


def _time(u: str) -> str:
    """The position of a share of the demand, in SQL."""
    y = f"({u}) * [5e0, 2e0, 1e0][place % 3 + 1]"
    return f"""CASE place % 3
        WHEN 0 THEN 2 * {y} / (7.5e0 + sqrt(56.25e0 - 10 * {y}))
        WHEN 1 THEN CASE WHEN {y} < 0.75e0 THEN 2 * {y} / (1 + sqrt(1 + 4 * {y})) ELSE 0.5e0 + 2 * ({y} - 0.75e0) / (2 + sqrt(4 + 4 * ({y} - 0.75e0))) END
        ELSE {y} END"""


def _pass(n: int) -> str:
    share = f"least(1e0, CASE WHEN demand > 0 THEN ({n} * z + c)::DOUBLE / demand ELSE 0 END)"
    return f"CASE WHEN taken > {n} * size THEN round({_time(share)}, 9) END AS position{f'_{n + 1}' if n else ''}"


SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) size,
        coalesce(((doc_id % 2147483648) * 2654435761) % 4294967296, 0) h FROM documents),
z AS (SELECT source, sum(size)::BIGINT z, row_number() OVER (ORDER BY source NULLS LAST) - 1 place FROM d GROUP BY source),
w AS (SELECT *, [5e0, 2e0, 1e0][place % 3 + 1] w FROM z),
o AS (SELECT *, 3 * z / w ratio, row_number() OVER q k, sum(3 * z) OVER q held, sum(w) OVER q gone FROM w WINDOW q AS (ORDER BY 3 * z / w, place ROWS UNBOUNDED PRECEDING)),
t AS (SELECT sum(z) total, sum(w) weight FROM w),
l AS (SELECT k, (total - held) / nullif(weight - gone, 0) level FROM (SELECT 0 k, 0 held, 0 gone UNION ALL SELECT k, held, gone FROM o), t),
v AS (SELECT level FROM l LEFT JOIN o ON o.k = l.k + 1 WHERE o.k IS NULL OR level < ratio ORDER BY l.k LIMIT 1),
s AS (SELECT source s, z, place, CASE WHEN level IS NULL THEN 3 * z ELSE least(w * level, 3 * z) END::DOUBLE target FROM w, v),
c AS (SELECT doc_id, size, z, place, target, floor(target)::BIGINT demand,
        coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT c
      FROM d JOIN s ON s.s IS NOT DISTINCT FROM source),
k AS (SELECT *, CASE WHEN z > 0 THEN demand // z ELSE 0 END * size + greatest(0, least(size, demand - CASE WHEN z > 0 THEN demand // z ELSE 0 END * z - c)) taken FROM c)
SELECT doc_id, size::BIGINT size, z source_size, target, taken::BIGINT taken, """ + ", ".join(_pass(n) for n in range(MOST)) + " FROM k\n"
