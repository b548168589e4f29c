"""Operator 7: removes bytes of repeated passages, by difference-cover suffix sorting of bounded depth.

Two suffixes count as one for `length` bytes, so suffixes are only told apart to that depth:
  cover    Sampled positions are a difference cover made by content: the least name of a
           2/5 * length-gram in each window of `length` bytes. Equal windows have their sampled position at
           the same shift, which is all that a cover of residues is for, at 3 % of the positions
           instead of 67 %.
  triples  The name of 3w bytes is that of the triple of the names of its w-byte parts, recursively
           from single bytes. A text lies whole in one task, so the names of a triple's parts are at hand
           and need no sort at each level; a name is a 64-bit fingerprint in place of a rank.
  sort     Sampled positions are sorted by the name of their gram, then of all bytes that any
           window of theirs spans. A position after the first of its whole span repeats in all its windows.
  merge    Only where spans of one gram differ are the suffixes between sampled positions merged
           in: the windows of each span's first position are sorted by name.
  compare  Neighbours in that order with an equal prefix of `length` bytes are one string; all but
           the earliest start are repeats. Every byte of a repeat goes.

Names alone decide nothing: spans and windows also carry a digest of their bytes by another function, and
only rows that agree in all of them are equal; each byte taken out stands behind 128 bits.

What repeats inside one batch of documents is settled there, so that a passage in a third of all
documents meets as one row a batch. A passage's first and last positions span its different surroundings, which no batch can
settle: grams of that kind, those in a thousandth of all documents, are counted first (their number is bounded by that
share) and spread over many tasks by the digest of their spans. No group is ever listed pairwise or held in memory.

Defined results: null and empty texts have no bytes. Order is by doc_id, null last, then a fingerprint of the text, then
start; rows alike in doc_id and text are one document: they do not remove each other. A long text lies whole in one task, at some
60 bytes of memory a byte of its chunk. An empty table gives an empty one. Only doc_id
and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as c

LENGTH = 100
#: A gram is spread over tasks if it is in so many documents of a batch, and in this share of all.
OFTEN, SHARE = 16, 0.001
#: Bytes of text that are named at once: few enough for a core's cache.
CHUNK = 100_000
LAST = (1 << 63) - 1
U = np.uint64
ODD = [U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads every bit; in place."""
    x ^= x >> U(31)
    x *= ODD[3]
    x ^= x >> U(29)
    x *= ODD[0]
    x ^= x >> U(32)
    return x


CODES = mixed(np.arange(1, 257, dtype=U) * ODD[1])


def triples(x: np.ndarray, step: int, last: int | None = None) -> np.ndarray:
    """Names of the triples (p, p + step, p + last); pairs where last is step."""
    last = 2 * step if last is None else last
    n = max(0, len(x) - last)
    out = x[:n] * ODD[0]
    out += x[last : last + n] * ODD[2]
    if last != step:
        out += x[step : step + n] * ODD[1]
    out ^= out >> U(29)
    return out


def named(levels: list[np.ndarray], length: int, at: np.ndarray | None = None) -> np.ndarray:
    """Names of the `length`-byte strings, all or those at some places; levels[j] holds those of 3**j bytes and is extended as needed.

    For some places the last triples, of the longest parts, are named there alone.
    """
    j = 0
    while 3 ** (j + 1) <= (length if at is None else length // 3):
        if len(levels) == j + 1:
            levels.append(triples(levels[j], 3**j))
        j += 1
    if at is None:
        rest = length - 3**j
        return mixed(triples(levels[j], min(rest, 3**j), rest) if rest else levels[j].copy())
    x, w = levels[j], 3**j
    out, steps = np.zeros(len(at), U), range(0, length - w + 1, w)
    for i, step in enumerate([*steps, length - w] if (length - w) % w else steps):
        out *= ODD[i % 3]
        out += x[at + step]
        out ^= out >> U(29)
    return mixed(out)


def sliding(x: np.ndarray, width: int, least) -> np.ndarray:
    """The least (or greatest) of each `width` neighbours."""
    size = 1
    while size * 2 <= width:
        x = least(x[:-size], x[size:])
        size *= 2
    return least(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def digests(data: bytes, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Of the bytes themselves, by a function that shares nothing with the names."""
    view, of = memoryview(data), xxhash.xxh3_64_intdigest
    return np.fromiter((of(view[a:b]) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)), U, len(starts))


def seen_before(*keys: np.ndarray) -> np.ndarray:
    """Whether a row agrees in all keys with an earlier one, the first of its mixed key."""
    mix = keys[0].copy()
    for k in keys[1:]:
        mix = mixed(mix) ^ k
    _, index, inverse = np.unique(mix, return_index=True, return_inverse=True)
    first = index[inverse]
    again = first != np.arange(len(mix))
    for k in keys:
        again &= k == k[first]
    return again


class Spans:
    """Of texts laid end to end: each sampled position's gram, span name and digest, and its windows [start, stop)."""

    def __init__(self, texts: list[bytes], length: int = LENGTH, check: bool = True):
        sizes = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(sizes)
        self.begin = ends - sizes
        data = b"".join(texts)
        levels = [CODES[np.frombuffer(data, np.uint8)]]
        gram = max(1, length * 2 // 5)
        width = length - gram + 1
        if not len(texts) or ends[-1] < length:
            self.doc = self.start = self.stop = np.empty(0, np.int64)
            self.gram = self.span = self.check = np.empty(0, U)
            return
        g = named(levels, gram)
        low = sliding(g, width, np.minimum)
        pad = np.zeros(width - 1, U)
        chosen = np.flatnonzero(g == sliding(np.concatenate([pad, low, pad]), width, np.maximum))
        mark = np.zeros(len(g), np.int64)
        mark[chosen] = 1
        # Windows within one text
        inside = np.zeros(ends[-1] - length + 2, np.int64)
        fits = sizes >= length
        np.add.at(inside, self.begin[fits], 1)
        np.add.at(inside, ends[fits] - length + 1, -1)
        s = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
        j = np.cumsum(mark)[s + width - 1] - 1
        wrong = np.flatnonzero(g[chosen[j]] != low[s])
        while len(wrong):
            j[wrong] -= 1
            wrong = wrong[g[chosen[j[wrong]]] != low[s[wrong]]]
        at = chosen[j]
        new = np.ones(len(s), bool)
        new[1:] = (at[1:] != at[:-1]) | (s[1:] != s[:-1] + 1)
        first = np.flatnonzero(new)
        stop = np.append(first[1:], len(s))
        a, b = s[first], s[stop - 1]
        self.gram = g[at[first]]
        self.span = mixed(named(levels, length, a) * ODD[0] + named(levels, length, b) * ODD[1] + (at[first] - a).astype(U) * ODD[2] + (b - a).astype(U) * ODD[3])
        self.check = digests(data, a, b + length) if check else np.empty(0, U)
        self.doc = np.searchsorted(ends, a, "right")
        self.start, self.stop = a - self.begin[self.doc], b + 1 - self.begin[self.doc]


def encoded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def chunks(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """(doc_ids, fingerprints, texts) of about CHUNK bytes, in order, each document once."""
    places = {k: i for i, k in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))}
    ids, prints, texts, size = [], [], [], 0
    for d, t in sorted(places):
        ids.append(d)
        prints.append(t)
        texts.append(encoded(batch.column(2)[places[d, t]].as_py()))
        size += len(texts[-1])
        if size >= CHUNK:
            yield np.array(ids), np.array(prints), texts
            ids, prints, texts, size = [], [], [], 0
    if ids:
        yield np.array(ids), np.array(prints), texts


def frequent(docs: DataFrame, length: int) -> np.ndarray:
    """The grams that are in SHARE of all documents or more, sorted: at most the mean number of sampled positions a document, over SHARE."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams, docs_ = [], 0
            for ids, _, texts in chunks(batch):
                grams.append(Spans(texts, length, False).gram)
                docs_ += len(ids)
            gram, n = np.unique(np.concatenate(grams), return_counts=True) if grams else (np.empty(0, U), np.empty(0, np.int64))
            many = n >= OFTEN
            yield pa.RecordBatch.from_arrays([pa.array([None, *gram[many].view(np.int64).tolist()], pa.int64()), pa.array([docs_, *n[many].tolist()], pa.int64())], names=["gram", "n"])

    counts = c.cut(docs.select("d", "t", "text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).coalesce(FILES))
    total = counts.filter("gram is null").first()
    rows = counts.filter((F.col("gram").isNotNull()) & (F.col("n") >= SHARE * total["n"])).collect() if total else []
    return np.sort(np.array([r["gram"] for r in rows], np.int64).view(U))


#: A place: start << 10 | number of windows << 2 | flags; few bytes a row, in the order of start.
AGAIN, HOT = 1, 2
MOST_WINDOWS = 255
#: Files of the counts of grams, of which there are few.
FILES = 8
ROW = "d long, t long, place long, gram long, span long, check long"


def places(start: np.ndarray, stop: np.ndarray, flag: np.ndarray | int) -> np.ndarray:
    return (start.astype(np.int64) << 10) | ((stop - start).astype(np.int64) << 2) | flag


def runs(d: np.ndarray, t: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of windows [start, stop) in order, those that follow each other as one, while they are MOST_WINDOWS at most."""
    if not len(start):
        return d, t, start, stop
    new = np.ones(len(start), bool)
    new[1:] = (d[1:] != d[:-1]) | (t[1:] != t[:-1]) | (start[1:] != stop[:-1])
    out, head = [], 0
    for i in range(1, len(start)):
        if new[i] or stop[i] - start[head] > MOST_WINDOWS:
            out.append(head)
            head = i
    first = np.array([*out, head])
    last = np.append(first[1:], len(start)) - 1
    return d[first], t[first], start[first], stop[last]


def spread(d: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Names for rows that meet no other: they go anywhere."""
    return mixed((d.astype(U) + place.astype(U) * ODD[2]) * ODD[1])


def rows_of(again: np.ndarray, flag: np.ndarray | int, keys: list[np.ndarray], d: np.ndarray, t: np.ndarray, start: np.ndarray, stop: np.ndarray) -> list[pa.Array]:
    """d, t, place and keys: the rows that are new in their batch, then runs of those that are not, under names of their own."""
    run = runs(d[again], t[again], start[again], stop[again])
    place = np.concatenate([places(start, stop, flag)[~again], places(run[2], run[3], AGAIN)])
    n = len(run[0])
    keys = [np.concatenate([k[~again], np.zeros(n, U)]) for k in keys]
    d, t = np.concatenate([d[~again], run[0]]), np.concatenate([t[~again], run[1]])
    if n:
        keys[0][-n:] = spread(d[-n:], place[-n:])
    return [pa.array(x) for x in (d, t, place, *(k.view(np.int64) for k in keys))]


def sampled(docs: DataFrame, length: int, often: np.ndarray, salts: int) -> DataFrame:
    """Sampled positions of keyed documents: what repeats in its batch is AGAIN; a frequent gram is HOT, and salted by the span's digest."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for ids, prints, texts in chunks(batch):
                s = Spans(texts, length)
                parts.append((s.gram, s.span, s.check, ids[s.doc], prints[s.doc], s.start, s.stop))
            if parts:
                gram, span, check, d, t, start, stop = (np.concatenate(x) for x in zip(*parts, strict=True))
                again = seen_before(gram, span, check)  # rows are in the order of d, t, start
                hot = np.isin(gram, often)
                gram[hot] += (check[hot] % U(salts) + U(1)) * ODD[3]
                yield pa.RecordBatch.from_arrays(rows_of(again, np.where(hot, HOT, 0), [gram, span, check], d, t, start, stop), names=["d", "t", "place", "gram", "span", "check"])

    return docs.select("d", "t", "text").mapInArrow(rows, ROW)


def windows(docs: DataFrame, length: int) -> DataFrame:
    """(d, t, place, name, check) of the windows in the lists `todo` of documents, one a row; runs of those that repeat in their batch are AGAIN."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            todo = dict(zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True), batch.column(3), strict=True))  # equal keys have equal lists
            out: list[tuple] = []
            for ids, prints, texts in chunks(batch):
                data = b"".join(texts)
                levels = [CODES[np.frombuffer(data, np.uint8)]]
                begin = np.cumsum([0] + [len(x) for x in texts])
                for i, (d, t) in enumerate(zip(ids.tolist(), prints.tolist(), strict=True)):
                    packed = np.sort(todo[d, t].values.to_numpy())
                    a, n = packed >> 8, packed & 255
                    start = np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())
                    at = begin[i] + start
                    out.append((named(levels, length, at), digests(data, at, at + length), np.full(len(start), d), np.full(len(start), t), start))
            if out:
                name, check, d, t, start = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(rows_of(seen_before(name, check), 0, [name, check], d, t, start, start + 1), names=["d", "t", "place", "name", "check"])

    return docs.select("d", "t", "text", "todo").mapInArrow(rows, "d long, t long, place long, name long, check long")


def listed(rows: DataFrame, into: str) -> DataFrame:
    """(d, t, list): windows of each document, start * 256 + number; spans hold fewer than 256."""
    return rows.groupBy("d", "t").agg(F.collect_list(F.shiftright("place", 2)).alias(into))


def keyed(docs: DataFrame) -> DataFrame:
    """(d, t, text): t tells apart the texts of one doc_id and is 0 where every doc_id has one row."""
    keys = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("d"), c.text_of().alias("text"))
    alone = keys.groupBy("d").count().filter("count > 1").isEmpty()
    return keys.select("d", (F.lit(0).cast("long") if alone else F.xxhash64("text")).alias("t"), "text")


def removed(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row of docs; length: 4 to 400."""
    keys, n = keyed(docs), docs.count()
    here = F.struct("d", "t", "place")
    found = sampled(keys, length, frequent(keys, length), max(64, c.parts(docs.sparkSession)))
    by_gram, by_span = Window.partitionBy("gram"), Window.partitionBy("gram", "span", "check").orderBy("d", "t", "place")
    told = found.repartition(F.col("gram")).withColumn("first", F.first(here).over(by_span))
    told = told.withColumns({"low": F.min("check").over(by_gram), "high": F.max("check").over(by_gram)})
    has = lambda flag: F.col("place").bitwiseAND(flag) != 0
    told = told.select("d", "t", "place", (has(AGAIN) | (F.col("first") != here)).alias("repeat"), (has(HOT) | (F.col("low") != F.col("high"))).alias("differs"))
    told = c.written(c.in_files(told.filter("repeat or differs"), n))
    spans = told.filter("repeat").select("d", "t", "place")

    open_ = listed(told.filter("not repeat"), "todo")
    order = Window.partitionBy("name", "check").orderBy("d", "t", "place")
    again = windows(keys.join(open_, ["d", "t"]), length).withColumn("first", F.first(here).over(order)).filter(has(AGAIN) | (F.col("first") != here))
    every = listed(spans.unionByName(again.select("d", "t", "place")), "gone")
    return c.in_files(finished(keys.join(every, ["d", "t"], "left"), length), n)  # both joins read one exchange of the texts


def finished(docs: DataFrame, length: int) -> DataFrame:
    """Takes the bytes of the listed windows out of each text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, gone in zip(batch.column(1), batch.column(2), strict=True):
                said = np.frombuffer(encoded(text.as_py()), np.uint8)
                n = len(said)
                cover = np.zeros(n + 1, np.int64)
                if gone.is_valid:
                    packed = gone.values.to_numpy()
                    a = packed >> 8
                    np.add.at(cover, a, 1)
                    np.add.at(cover, a + (packed & 255) + length - 1, -1)
                off = np.cumsum(cover[:n]) > 0
                runs = int(off[0]) + int((off[1:] & ~off[:-1]).sum()) if n else 0
                out.append((n, int(off.sum()), runs, hashlib.sha256(said[~off].tobytes()).hexdigest()))
            n, gone_n, runs, sha = zip(*out, strict=True) if out else ((), (), (), ())
            ids = pa.array([None if d == LAST else d for d in batch.column(0).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(gone_n, pa.int64()), pa.array(runs, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return docs.select("d", "text", "gone").mapInArrow(rows, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(c.table(spark, sf_dir, "documents").select("doc_id", "text"))


SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) h FROM documents),
w AS (SELECT doc_id, s, substr(h, (2 * s + 1)::BIGINT, 200) x FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) s FROM d)),
g AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY x ORDER BY doc_id, s) k FROM w) WHERE k > 1),
b AS (SELECT doc_id, unnest(range(0, length(h) // 2)) t, unnest(string_split(regexp_replace(h, '(..)', '\1,', 'g'), ',')[:length(h) // 2]) v FROM d),
c AS (SELECT b.doc_id, t, v, coalesce(t - max(s) OVER (PARTITION BY b.doc_id ORDER BY t) < 100, false) gone FROM b LEFT JOIN g ON g.doc_id = b.doc_id AND s = t),
e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY t), false) starts FROM c),
f AS (SELECT doc_id, count(*) n, count_if(gone) r, count_if(starts) p, string_agg(v, '' ORDER BY t) FILTER (NOT gone) k FROM e GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT n_bytes, coalesce(r, 0)::BIGINT n_removed, coalesce(p, 0)::BIGINT n_spans, sha256(unhex(coalesce(k, ''))) kept_sha256 FROM d LEFT JOIN f USING (doc_id)
"""
