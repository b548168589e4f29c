"""Operator 3: secret scan with multipart credential linking.

Strong candidates (assign, access, hex) are always reported. Weak ones are an unlabelled
`key` (40 characters of base 64 in mixed classes) and an `endpoint` (a URL or host:port). Both
mean nothing alone: within a scope of SCOPE code points around an access identifier or an
assignment, a sorted interval join links the parts, and a weak part is reported only where its
complement is: a key beside an access identifier, an endpoint beside an access identifier, an
assigned secret or a reported key.

A scan reads one whole text at a time, in time and memory in proportion to it; nothing is shuffled. Defined results: null and
empty texts have no spans; repeated rows are scanned alike; spans that start together are told in the order of KINDS; an empty
table gives an empty one; other columns, whatever their names, pass beside the scan.
"""

from __future__ import annotations

import bisect
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as c

#: The base patterns and the fewest characters of what they find.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_MIN, ACCESS_MIN = 12, 18
#: A key may follow '=' at once (NAME=key); one before '=' is a longer, padded value.
KEY = re.compile(r"(?<![A-Za-z0-9/+])[A-Za-z0-9/+]{40}(?![A-Za-z0-9/+=])")
ENDPOINT = re.compile(r"""[a-z][a-z0-9+.-]{1,15}://[^\s"'<>]+|(?<![\w.-])[a-z0-9-]+(?:\.[a-z0-9-]+)+:\d{2,5}(?!\d)""")
KINDS = ("assign", "access", "hex", "key", "endpoint")
SCOPE = 300


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place, end) of the strong candidates."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_MIN]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_MIN]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def near(span: tuple[int, int, int], others: list[tuple[int, int, int]], longest: int, scope: int) -> list[tuple[int, int, int]]:
    """The spans of the sorted list `others` that start or end within the scope around span."""
    i = bisect.bisect_left(others, (span[0] - scope - longest,))
    out = []
    while i < len(others) and others[i][0] <= span[2] + scope:
        if others[i][2] >= span[0] - scope:
            out.append(others[i])
        i += 1
    return out


def linked(text: str, base: list[tuple[int, int, int]], scope: int = SCOPE) -> tuple[list[tuple[int, int, int]], int]:
    """The weak spans whose complement is in scope, and the number of links."""
    anchors = [x for x in base if x[1] < 2]
    if not anchors:
        return [], 0
    longest = max(x[2] - x[0] for x in anchors)
    access = [x for x in anchors if x[1] == 1]
    taken = sorted(base)
    wide = max(x[2] - x[0] for x in base)
    free = lambda m: not any(b[0] < m.end() and m.start() < b[2] for b in near((m.start(), 9, m.end()), taken, wide, 0))
    keys, links = [], 0
    if access:
        for m in KEY.finditer(text):
            s = m.group()
            mixed = any(x.isdigit() for x in s) and any(x.islower() for x in s) and any(x.isupper() for x in s)
            if mixed and free(m) and (n := len(near((m.start(), 3, m.end()), access, longest, scope))):
                keys.append((m.start(), 3, m.end()))
                links += n
    parts = sorted(anchors + keys)
    longest = max(longest, 40)
    ends = []
    if ":" in text:
        for m in ENDPOINT.finditer(text):
            if free(m) and (n := len(near((m.start(), 4, m.end()), parts, longest, scope))):
                ends.append((m.start(), 4, m.end()))
                links += n
    return keys + ends, links


def scan(text: str, scope: int = SCOPE) -> dict:
    base = base_spans(text)
    weak, links = linked(text, base, scope)
    said = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
    return {
        "n_assign": sum(x[1] == 0 for x in base),
        "n_access": sum(x[1] == 1 for x in base),
        "n_hex": sum(x[1] == 2 for x in base),
        "base_sha256": hashlib.sha256(said(base).encode()).hexdigest(),
        "spans": said(base + weak),
        "n_links": links,
    }


FOUND = T.StructType([T.StructField(x, T.LongType()) for x in ("n_assign", "n_access", "n_hex")] + [T.StructField(x, T.StringType()) for x in ("base_sha256", "spans")] + [T.StructField("n_links", T.LongType())])
ARROW = pa.struct([(f.name, pa.int64() if f.dataType == T.LongType() else pa.string()) for f in FOUND])


@F.arrow_udf(FOUND)
def found(texts: pa.Array) -> pa.Array:
    return pa.array([scan(x.as_py() or "") for x in texts], ARROW)


def redact(text: str, mark: str = "[SECRET]") -> str:
    base = base_spans(text)
    out, at = [], 0
    for a, _, b in sorted(base + linked(text, base)[0]):
        if b > at:
            out += [text[at:a], mark] if a >= at else []
            at = b
    return "".join(out) + text[at:] if out else text


@F.arrow_udf(T.StringType())
def redacted(texts: pa.Array) -> pa.Array:
    return pa.array([redact(x.as_py() or "") for x in texts], pa.string())


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = c.table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", found("text").alias("_f")).select("doc_id", "_f.*")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: every reported span becomes a mark; every document stays."""
    clean = docs.withColumn("text", redacted("text"))
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean
