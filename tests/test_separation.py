"""The library without the text operators: it imports, registers its queries and runs."""

import shutil
import subprocess
import sys
from pathlib import Path


def test_the_rest_works_without_the_text_operators(tmp_path):
    repo = Path(__file__).resolve().parent.parent
    for left_out, names in (("folders", ("llm",)), ("all", ("llm", "corpus_pipeline.py"))):
        copy = tmp_path / left_out
        shutil.copytree(repo, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", *names))
        code = "import __spark_entry__ as e; q = e.queries(); print(len(q), sorted(n for n in q if n[:2] == 'op' and n[2:3].isdigit() or n == 'pipeline'), len(e.oracle_sql()))"
        done = subprocess.run([sys.executable, "-B", "-c", code], cwd=copy, capture_output=True, text=True, timeout=300)
        assert done.returncode == 0, done.stderr[-2000:]
        n, none, _ = done.stdout.strip().splitlines()[-1].split(" ", 2)
        assert int(n) > 90 and none == "[]"
    # and it runs: a query with a fold, one over a written table
    code = (
        "from pyspark.sql import SparkSession; import __spark_entry__ as e; "
        "s = SparkSession.builder.master('local[2]').config('spark.sql.shuffle.partitions', 2).config('spark.ui.enabled', False).getOrCreate(); "
        "print([e.queries()[n](s, '/root/testdata/sf0.001').count() > 0 for n in ('pnf_transitions', 'journal_append')], e.entry(s).count() > 0)"
    )
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=copy, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]
    assert done.stdout.strip().splitlines()[-1] == "[True, True] True"
