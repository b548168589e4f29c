"""Operator 5: packs documents into fixed windows by minimum bin slack.

Every document is tokenised, ends in id 0, and is cut into full windows and one remainder. The
remainders' lengths are a multiset of at most `window` different numbers, whatever the corpus: the
driver holds only this histogram. A bitset subset-sum dynamic programme seeded with the longest
length left finds the multiset of remaining lengths that fills a window closest to its capacity,
backtracks how often it takes each length, and the pattern is used as often as the counts allow.
Pieces are then numbered within their length and looked up in the pattern plan, so no task sees
more than its share.

In the pipeline documents have places in training order, and the sequences follow it: a length is dealt to the
patterns by hash, so a pattern that is used often gets pieces of all times; within a pattern the earliest pieces fill the
first sequence; and sequences are numbered by their earliest piece. A place also tells the passes of a
repeated document apart.

Null and empty texts are the single id 0; equal rows are packed each for itself; an empty table
gives an empty one. Sequences end padded to `window` tokens, or unpadded where their fill is a power
of two. A text is tokenised whole, in one task. Only doc_id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as c

WINDOW = 1024
END = 0
VOCABULARY = "byte_bpe_50k.json"
#: So many file names are broadcast; a table in more files is joined by shuffle.
MOST_FILES = 20_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


class Coder:
    """The ids of texts by a byte-level BPE vocabulary file.

    Texts of PLAIN characters go through the faster of the two installed libraries, with the same
    vocabulary and the same pre-splitting; all others, and any with a special token's string, go
    through `tokenizers` itself. tests/llm hold the two against each other.
    """

    #: Letters, digits, punctuation and white space that both libraries' classes agree on.
    PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\u024f\u2010-\u2027\u2030-\u205e\u20ac]*")
    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        byte = {ch: b for b, ch in self.alphabet().items()}
        ranks = {bytes(byte[ch] for ch in word): i for word, i in self.whole.get_vocab(with_added_tokens=False).items() if word not in self.special}
        self.fast = tiktoken.Encoding(path, pat_str=self.SPLIT, mergeable_ranks=ranks, special_tokens={})

    @staticmethod
    def alphabet() -> dict[int, str]:
        """The printable character by which a byte-level vocabulary writes each byte."""
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in shown]
        return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}

    def __call__(self, text: str) -> np.ndarray:
        if self.PLAIN.fullmatch(text) and not any(x in text for x in self.special):
            return np.array(self.fast.encode_to_numpy(text, disallowed_special=()), dtype="<u4")
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4")


def placed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, place): place numbers the rows in the order of the files they are read from, as a sorted table was written.

    Rows that come from no file are numbered in the order of their partitions.
    """
    try:
        rows = docs.select("doc_id", "text", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    except AnalysisException:
        return c.written(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("place")))
    part = F.regexp_extract("_file", r"part-(\d+)[^/]*$", 1).try_cast("long")
    files = rows.groupBy("_file").agg(F.count(F.lit(1)).alias("_n"))  # a row for each file
    before = Window.orderBy(part, "_file").rowsBetween(Window.unboundedPreceding, -1)
    starts = c.cut(files.select("_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")))
    starts = F.broadcast(starts) if starts.count() <= MOST_FILES else starts
    return rows.join(starts, "_file").select("doc_id", "text", (F.col("_start") + F.col("_at")).alias("place"))


def pieces(docs: DataFrame, path: str, window: int = WINDOW, end: int = END) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): full windows of each document, then its remainder; and its place, if it has one."""
    timed = "place" in docs.columns
    fields = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["place"] * timed]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(path)
        for batch in batches:
            rows: list[tuple] = []
            names = [batch.column(0).to_pylist(), *(x.to_pylist() for x in batch.columns[2:])]
            for text, name, *place in zip(batch.column(1), *names, strict=True):
                ids = np.append(coder(text.as_py() or ""), np.array([end], dtype="<u4"))
                rows += [(name, a, len(part := ids[a : a + window]), zlib.crc32(part.tobytes()), len(ids), *place) for a in range(0, len(ids), window)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * len(fields), names=fields)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), c.text_of().alias("text"), *["place"] * timed).mapInArrow(cut, PIECES + ", place long" * timed)


def closest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """Lengths and how many of each: the subset sum closest to capacity from below. Bit s of `sums`: s can be reached."""
    sums, steps = 1, []
    mask = (1 << (capacity + 1)) - 1
    for length in sorted(counts, reverse=True):
        left, chunk = min(counts[length], capacity // length), 1
        while left > 0:  # 1, 2, 4, ... copies at once
            take = min(chunk, left)
            steps.append((length, take, sums))
            sums |= (sums << (length * take)) & mask
            left, chunk = left - take, 2 * chunk
        if sums >> capacity & 1:
            break
    at, out = sums.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            out[length] = out.get(length, 0) + take
            at -= length * take
    return out


def plan(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int, int]]:
    """(length, low, high, first sequence, pieces a sequence, first offset): pieces ranked low..high-1 of a length
    fill sequences from the first on, so many side by side. As many rows as patterns use lengths: bounded by the window."""
    left = {k: n for k, n in histogram.items() if n}
    used = dict.fromkeys(left, 0)
    out, sequence = [], 0
    while left:
        seed = max(left)
        rest = left | {seed: left[seed] - 1}
        pattern = closest({k: n for k, n in rest.items() if n and k <= window - seed}, window - seed)
        pattern[seed] = pattern.get(seed, 0) + 1
        times = min(left[k] // n for k, n in pattern.items())
        offset = 0
        for k in sorted(pattern, reverse=True):
            n = pattern[k]
            out.append((k, used[k], used[k] + n * times, sequence, n, offset))
            used[k] += n * times
            left[k] -= n * times
            offset += n * k
            if not left[k]:
                del left[k]
        sequence += times
    return out


def packed(cuts: DataFrame, window: int = WINDOW) -> DataFrame:
    """pieces() with sequence_id and offset; where they have places, the sequences follow them."""
    spark = cuts.sparkSession
    histogram = {r["length"]: r["count"] for r in cuts.groupBy("length").count().collect()}  # at most `window` rows
    rows = plan(histogram, window)
    schema = "p_length long, low long, high long, first long, side long, p_offset long"
    layout = F.broadcast(spark.createDataFrame(rows, schema))  # bounded by the window, not by the corpus
    buckets = max(64, c.parts(spark))
    timed = ["place"] if "place" in cuts.columns else []
    ranked = c.numbered(cuts, ["length"], ["doc_id", "start", "ids_crc32", *timed], "_rank", buckets)
    joined = ranked.join(layout, (F.col("length") == F.col("p_length")) & (F.col("_rank") >= F.col("low")) & (F.col("_rank") < F.col("high")))
    if timed:
        total = (cuts.agg(F.max("place")).first()[0] or 0) + 1
        slot = lambda place: F.floor(F.col(place).cast("double") * buckets / total)
        joined = c.numbered(joined, ["length", "low"], ["place", "start"], "_nth", bucket=slot("place"))
    else:
        joined = joined.withColumn("_nth", F.col("_rank") - F.col("low"))
    sequence = F.col("first") + F.floor(F.col("_nth") / F.col("side"))
    offset = F.col("p_offset") + (F.col("_nth") % F.col("side")) * F.col("length")
    out = joined.select(*cuts.columns, sequence.cast("long").alias("sequence_id"), offset.cast("long").alias("offset"))
    if not timed:
        return out
    out = c.written(out)
    first = out.groupBy(F.col("sequence_id").alias("_old")).agg(F.min("place").alias("_first"))
    order = c.numbered(first, [], ["_first", "_old"], "_new", bucket=slot("_first"))
    return out.join(order, F.col("sequence_id") == F.col("_old")).withColumn("sequence_id", F.col("_new")).select(*out.columns)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: the packed pieces, with the place of their document in the training order that docs is sorted by. The last stage."""
    return packed(c.written(pieces(placed(docs), vocabulary_path())))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(c.written(pieces(c.table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary_path())))
