"""From raw documents to packed training sequences: each stage's rows are the next one's documents.

Quality rules reject documents and remove lines; near-duplicate detection leaves one of each group; found secrets become a
mark; the mix takes each document as often as its source's target says, in training order; packing cuts it into
sequences in that order. Defined results: null, empty and wordless texts fail the quality rules, so nothing of them is packed; equal rows
are one document after the second stage, different texts of one doc_id are each judged; rows with a null doc_id are never
duplicates; a long text passes whole through every stage, in one task at a time; an empty table gives no sequence; columns of documents pass
through all but the last stage under their names, whatever they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenfold.llm import common, minmax, mixing, packing, quality, secrets

STAGES = [
    ("quality rules", quality.stage),
    ("near duplicates", minmax.stage),
    ("secret scan", secrets.stage),
    ("source mix", mixing.stage),
    ("packing", packing.stage),
]

#: No SQL states tokenising, curriculum order and bin packing: tests/llm/test_against_brute_force.py holds run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over sf_dir's documents; each stage's result is written to the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
