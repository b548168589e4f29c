import subprocess
import sys

from compare import ROOT

import __spark_entry__ as entry


def test_entry(spark):
    out = entry.entry(spark)
    assert out.count() == 1000 and "instance" in out.columns


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_the_corpus_operators():
    code = "import sys; sys.modules['corpus_pipeline'] = None; sys.modules['lumenfold.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'lift_labels' in q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
