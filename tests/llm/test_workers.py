"""Workers need not have the package: only what is sent to them."""

import os
import subprocess
import sys
import textwrap

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
NAMES = ["op3_suffix_trees", "op4_suffix_arrays", "op7_chat_format", "op9_byte_bpe", "op10_simhash", "op11_spelling_variants", "op12_collocations", "op13_line_dedup"]


def test_queries_run_where_workers_lack_the_package(tmp_path, sf):
    """A driver in an empty folder, which alone puts the repository on its path."""
    code = f"""
        import sys
        from pyspark.sql import SparkSession
        spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
        sys.path.insert(0, {ROOT!r})
        from evidentia.llm.queries import QUERIES
        for name in {NAMES!r}:
            print("ROWS", name, QUERIES[name](spark, {sf!r}).count())
    """
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    extra = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and os.path.abspath(p) != ROOT and not os.path.isdir(os.path.join(p, "evidentia"))]
    out = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], cwd=tmp_path, env=env | {"PYTHONPATH": os.pathsep.join(extra)}, capture_output=True, text=True, timeout=600)
    assert out.stdout.count("ROWS") == len(NAMES), out.stderr[-3000:]
