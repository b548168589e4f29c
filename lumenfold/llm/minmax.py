"""Operator 9: near duplicates by min-max hashing.

Under each permutation of the shingle hashes both the minimum and the maximum are kept, so half
as many hash evaluations give a signature. Bands of `ROWS` signature values name buckets; at a
similarity of 0.8 a pair shares none of the BANDS buckets with probability 5e-6. Links are
confirmed on full shingle sets.

Texts with equal sets are one class, whatever their doc_ids, and only classes go on, each under a
number of its own. Connectivity is what is asked for, so links are confirmed in two rounds:
  stars    each class with the first class of a bucket it shares most buckets with: one pair a class;
  prefixes classes in a bucket whose components still differ, at first with one other a shingle, at last with all. Their shingles are put in one order, those of
           a single component first, then the rarer ones; two sets that are alike share a shingle among the first few
           of the shorter and the first few of the longer, so only these are joined. That filter drops no link, and
           documents of one template that are not alike share none of them. No pair within a component is joined.

Defined results: null, empty and wordless texts have an empty set and are linked with nothing; so is a row
with a null doc_id (its component is null, and it is kept). Rows that share a doc_id are judged each by its
own text: both may link, and each has the smallest doc_id that its own links reach. Ties need no rule: equal sets are one
class. A text is read whole, in one task: memory is 8 bytes a word, a few times over. An empty table gives an empty one. Only
doc_id and text are read, so other columns cannot clash; stage() passes them on by name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c

SHINGLE, PERCENT = 5, 80
PERMUTATIONS, ROWS = 120, 6
BANDS = 2 * PERMUTATIONS // ROWS
SEED = 7
MIX = np.random.RandomState(SEED)
ODD = (MIX.randint(0, 2**62, PERMUTATIONS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
ADD = MIX.randint(0, 2**63, PERMUTATIONS, dtype=np.uint64)
BAND_ODD = (MIX.randint(0, 2**62, (BANDS, ROWS), dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
#: Bits of a parity sketch.
SKETCH = 1024
#: How often loose classes meet the first of their shingle before they meet all.
ROUNDS = 1
#: So many earlier shingles of a prefix go along, so that a pair which shares several mostly comes once.
HEAD = 16
#: A component with more members than this that share a token is not joined with itself.
MEMBERS = 64
#: Texts whose sets a Python worker holds at once.
ROWS_AT_ONCE = 500
#: Texts that Spark sends a Python worker at once: by default those of a whole task, which both then hold beside all else.
BATCH = "2m"
#: Shingles that are hashed at once.
BLOCK = 2048


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct 64-bit hashes of the word shingles of texts; remembers words' hashes."""

    def __init__(self, size: int, memory: int = 300_000):
        self.size, self.memory, self.known = size, memory, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only ASCII white space parts
        if not words:
            return np.empty(0, np.uint64)
        if len(words) < self.size:
            return np.array([xxhash.xxh64_intdigest(b" ".join(words), 1)], np.uint64)
        known, hashed = self.known, xxhash.xxh64_intdigest
        if len(known) > self.memory:
            known.clear()
        h = np.array([known[w] if w in known else known.setdefault(w, hashed(w)) for w in words], np.uint64)
        n = len(h) - self.size + 1
        total = np.zeros(n, np.uint64)
        for k in range(self.size):
            total = mixed(total + h[k : k + n])
        return np.unique(total)


def bands(shingles: np.ndarray) -> np.ndarray:
    """The bucket names of a set."""
    low, high = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64), np.zeros(PERMUTATIONS, np.uint64)
    base = mixed(shingles)
    for a in range(0, len(base), BLOCK):
        part = base[None, a : a + BLOCK] * ODD[:, None]
        part += ADD[:, None]
        part ^= part >> np.uint64(32)
        np.minimum(low, part.min(1), out=low)
        np.maximum(high, part.max(1), out=high)
    rows = np.stack([low, high], 1).reshape(BANDS, ROWS)
    return mixed((mixed(rows) * BAND_ODD).sum(1) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of batches, a few at a time: what is made of them is held at once."""
    for batch in batches:
        for a in range(0, len(batch), ROWS_AT_ONCE):
            yield batch.slice(a, ROWS_AT_ONCE)


def set_key(shingles: np.ndarray) -> bytes | None:
    """16 bytes that name a whole set; null for the empty one."""
    return xxhash.xxh128_digest(shingles.tobytes()) if len(shingles) else None


def said(text: Column) -> Column:
    """What tells rows of one doc_id apart: a digest of the text, null for null."""
    return F.md5(text.cast("binary"))


def signatures(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, said, n_shingles, set_key, bands) of (doc_id, said, text)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(size)
        for batch in slices(batches):
            out: list[tuple] = []
            for text in batch.column(2):
                s = shingler(text.as_py())
                out.append((len(s), set_key(s), bands(s) if len(s) else None))
            n, key, band = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(band, pa.list_(pa.int64()))], names=["doc_id", "said", "n_shingles", "set_key", "bands"])

    return docs.select("doc_id", "said", "text").mapInArrow(sign, "doc_id long, said string, n_shingles long, set_key binary, bands array<long>")


def shingle_sets(rows: DataFrame, size: int) -> DataFrame:
    """(node, shingles, sketch) of (node, set_key, text), where the text has that set; each node once a task.

    Bit i of the sketch is the parity of the number of shingles that fall on i.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, done = Shingler(size), set()
        for batch in slices(batches):
            nodes, found = [], []
            for node, key, text in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                if node not in done and set_key(s := shingler(text.as_py())) == key.as_py():
                    done.add(node)
                    nodes.append(node)
                    found.append(s)
            sketched = [np.packbits(np.bincount((s % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH) & 1).view(np.int64) for s in found]
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64())), pa.array(sketched, pa.list_(pa.int64()))], names=["node", "shingles", "sketch"])

    return rows.select("node", "set_key", "text").mapInArrow(sets, "node long, shingles array<long>, sketch array<long>")


def may_be_alike(a: str, b: str, na: Column, nb: Column, percent: int) -> Column:
    """Of two sketches and set sizes: false only where the sets cannot be alike. Two sets differ in at least as many elements as their sketches in bits."""
    least = sum((F.bit_count(F.get(a, i).bitwiseXOR(F.get(b, i))) for i in range(SKETCH // 64)), F.lit(0))
    return (100 + percent) * least <= (100 - percent) * (na + nb)


def alike(a: Column, b: Column, percent: int) -> Column:
    both = F.size(F.array_intersect(a, b))
    return 100 * both >= percent * (F.size(a) + F.size(b) - both)


def components(links: DataFrame) -> DataFrame:
    """(node, root) of undirected links (a, b): root is the smallest node reachable. Alternates large and small stars."""
    edges = c.cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    before = None
    while True:
        both = edges.union(edges.select(F.col("b"), F.col("a")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        large = both.join(least, F.col("a") == F.col("n")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "n")
        small = large.join(least, F.col("a") == F.col("n")).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        edges = c.cut(small.filter("a <> b").distinct())
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.max("a"), F.min("b")).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now


def rooted(df: DataFrame, roots: DataFrame, name: str, into: str) -> DataFrame:
    """df with the root of the node in column `name`."""
    r = roots.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    return df.join(r, F.col(name) == F.col("_node"), "left").withColumn(into, F.coalesce("_root", name)).drop("_node", "_root")


def prefixes(loose: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(node, root, n, token, short, before): the first shingles of each loose set (node, root), as 32-bit tokens, in one order for all.

    Tokens of one component come first and cannot join; then rarer ones. Of two alike sets the shorter
    one's first n - ceil(2 * percent * n / (100 + percent)) + 1 (`short`) and the longer one's first
    n - ceil(percent * n / 100) + 1 shingles meet: fewer shared ones than that leave no room for the overlap.
    """
    tokens = sets.join(loose, "node").select("node", "root", F.size("shingles").alias("n"), F.explode("shingles").alias("s")).withColumn("token", F.col("s").bitwiseAND((1 << 31) - 1).cast("int")).drop("s")
    torn = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 <> r1").select("token", "df")
    shared = tokens.join(torn, "token").groupBy("node", "root", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("list"))
    free = F.col("n") - F.size("list")  # tokens before the first shared one
    room = lambda top, under: F.greatest(F.lit(0), (F.col("n") - F.ceil(top * F.col("n") / under) + 1 - free).cast("int"))
    cut = shared.withColumns({"near": room(2 * percent, 100 + percent), "far": room(percent, 100)})
    head = F.transform(F.slice("list", 1, HEAD), lambda x: x["token"])
    listed = cut.select("node", "root", "n", "near", head.alias("head"), F.posexplode(F.slice("list", F.lit(1), F.col("far"))).alias("i", "x"))
    return listed.select("node", "root", "n", F.col("x.token").alias("token"), (F.col("i") < F.col("near")).alias("short"), F.slice("head", F.lit(1), F.least("i", F.lit(HEAD))).alias("before"))


def torn(rows: DataFrame) -> DataFrame:
    """Those of prefixes() whose token is still in several components; written."""
    kept = rows.groupBy("token").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 <> r1").select("token")
    return c.written(rows.join(kept, "token", "left_semi"))


def fits(percent: int) -> Column:
    """Whether x, the shorter, and y of different components may be alike, by size and sketch."""
    na, nb = F.col("x.n"), F.col("y.n")
    return (F.col("x.root") != F.col("y.root")) & (na * 100 >= percent * nb) & (nb * 100 >= percent * na) & may_be_alike("x.sketch", "y.sketch", na, nb, percent)


PAIR = ("x.node a", "y.node b", "x.root ra", "y.root rb")


def to_firsts(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b, ra, rb): each row with the first member of its token, if that is of another component: one pair a row."""
    first = rows.groupBy("token").agg(F.min(F.struct("root", "node")).alias("f")).select("token", F.col("f.node").alias("node"))
    y = rows.drop("short", "before").distinct().join(first, ["token", "node"]).alias("y")
    return rows.alias("x").join(y, (F.col("x.token") == F.col("y.token")) & fits(percent)).selectExpr(*PAIR).distinct()


def across(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b, ra, rb): pairs of prefixes() of different components that share a token.

    Of a token, members of a component of more than MEMBERS meet only members of others, so that no
    large component is joined with itself.
    """
    sizes = rows.groupBy("token", "root").agg((F.count(F.lit(1)) > MEMBERS).alias("large"))
    rows = rows.join(sizes, ["token", "root"])
    x, y = rows.filter("short").alias("x"), rows.alias("y")
    small, large = lambda df, k: df.filter(f"not {k}.large"), lambda df, k: df.filter(f"{k}.large")
    na, nb = F.col("x.n"), F.col("y.n")
    near = fits(percent) & ((na < nb) | ((na == nb) & (F.col("x.node") < F.col("y.node")))) & ~F.arrays_overlap("x.before", "y.before")
    token = F.col("x.token") == F.col("y.token")
    found = small(x, "x").join(y, token & near).selectExpr(*PAIR).unionByName(large(x, "x").join(small(y, "y"), token & near).selectExpr(*PAIR))
    kinds = lambda df, k: df.filter("large").select("token", F.col("root").alias(k)).distinct()
    met = kinds(rows.filter("short"), "rx").join(kinds(rows, "ry"), "token").filter("rx <> ry").alias("m")
    both = large(x, "x").join(met, (F.col("m.token") == F.col("x.token")) & (F.col("rx") == F.col("x.root")))
    both = both.join(large(y, "y"), token & (F.col("ry") == F.col("y.root")) & near)
    return found.unionByName(both.selectExpr(*PAIR)).distinct()


def judged(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, said, n_shingles, component_id, first) for every row of docs; first: said of the row that stands for the component, among those of component_id."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), said(F.col("text")).alias("said"), "text")
    signed = c.written(signatures(rows, size), BATCH)
    known = signed.filter("doc_id is not null and set_key is not null")
    classes = known.groupBy("set_key").agg(F.min(F.struct("doc_id", "said")).alias("rep"), F.first("bands").alias("bands"))
    classes = c.written(classes.select("set_key", "rep", "bands", F.monotonically_increasing_id().alias("node")))  # written, so the numbers stay
    buckets = classes.select("node", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.min("node").alias("hub"), F.max("node").alias("far")).filter("hub <> far").select("bucket", "hub")
    spots = c.written(buckets.join(shared, "bucket"))  # only buckets of two classes or more
    best = c.cut(spots.filter("node <> hub").groupBy("node").agg(F.mode("hub", True).alias("hub")))
    nodes = classes.select("node", "set_key", F.col("rep.doc_id").alias("doc_id"), F.col("rep.said").alias("said")).join(spots.select("node").distinct(), "node")
    sets = c.written(shingle_sets(rows.join(nodes, ["doc_id", "said"]), size), BATCH)
    if not sets.groupBy("node").count().filter("count > 1").isEmpty():  # equal rows that different tasks met
        sets = c.written(sets.dropDuplicates(["node"]))

    def confirmed(pairs: DataFrame) -> DataFrame:
        a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
        b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
        near = (F.size("sa") * 100 >= percent * F.size("sb")) & (F.size("sb") * 100 >= percent * F.size("sa"))
        return pairs.join(a, "a").join(b, "b").filter(near & alike(F.col("sa"), F.col("sb"), percent)).select(*pairs.columns)

    links = c.cut(confirmed(best.select(F.col("node").alias("a"), F.col("hub").alias("b"))))
    roots = components(links)
    spread = rooted(spots, roots, "node", "root")
    open_ = spread.groupBy("bucket").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 <> r1").select("bucket")
    loose = c.cut(spread.join(open_, "bucket", "left_semi").select("node", "root").distinct())
    rows, sketches = torn(prefixes(loose, sets, percent)), sets.select("node", "sketch")
    merged = None  # links between components
    for pairs in (to_firsts,) * ROUNDS + (across,):
        new = c.cut(confirmed(c.cut(pairs(rows.join(sketches, "node"), percent))).select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct())
        merged = new if merged is None else merged.union(new)
        if pairs is to_firsts:
            rows = torn(rooted(rows.withColumnRenamed("root", "old"), components(new), "old", "root").drop("old"))

    rooted_ = rooted(rooted(classes.select("set_key", "rep", "node"), roots, "node", "old"), components(merged), "old", "root")
    least = rooted_.groupBy("root").agg(F.min("rep").alias("least"))
    found = rooted_.join(least, "root").select(F.col("set_key").alias("k"), F.col("least.doc_id").alias("component_id"), F.col("least.said").alias("first"))
    out = signed.select("doc_id", "said", "n_shingles", "set_key").join(found, (F.col("set_key") == F.col("k")) & F.col("doc_id").isNotNull(), "left")
    return out.select("doc_id", "said", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "first")


def grouped(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs; kept: doc_id is component_id, or null."""
    return judged(docs, size, percent).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingles of four words, as this query's table is defined; stage() takes the usual five."""
    return grouped(c.table(spark, sf_dir, "documents").select("doc_id", "text"), size=4)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: one row of each group stays, that of the smallest doc_id; rows with a null doc_id or no word all stay.

    Of rows of that doc_id with different texts it is the one of the least digest; of equal rows any one.
    """
    rows = judged(docs)
    goes = c.cut(rows.filter((F.col("doc_id") != F.col("component_id")) | (F.col("said") != F.col("first"))).select("doc_id", "said").distinct())
    twice = c.cut(rows.filter("first is not null").groupBy("doc_id", "said").count().filter("count > 1").select("doc_id", "said").join(goes, ["doc_id", "said"], "left_anti"))
    told = docs.select(F.struct(*[F.col(f"`{x}`") for x in docs.columns]).alias("_row"), F.col("doc_id").cast("long").alias("_id"), said(F.col("text")).alias("_said"))
    on = lambda keys: [F.col("_id") == keys["doc_id"], F.col("_said") == keys["said"]]
    left = told.join(goes, on(goes), "left_anti")
    if not twice.isEmpty():
        one = left.join(twice, on(twice), "left_semi").dropDuplicates(["_id", "_said"])
        left = left.join(twice, on(twice), "left_anti").unionByName(one)
    return left.select("_row.*")


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3])
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) g FROM d)),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id a, b.doc_id b, count(*) i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
e AS (SELECT a x, b y FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id x, doc_id root FROM d UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.x WHERE r.root < e.y),
m AS (SELECT x, min(root) root FROM r GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) n_shingles, root component_id, d.doc_id = root kept FROM d JOIN m ON x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
