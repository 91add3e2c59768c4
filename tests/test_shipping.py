"""Kernels must run where the package is not on the workers' path."""

import os
import subprocess
import sys
import textwrap

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_kernels_run_from_another_folder(tmp_path, sf_dir):
    script = tmp_path / "job.py"
    script.write_text(
        textwrap.dedent(
            f"""
            import sys
            sys.path.insert(0, {ROOT!r})
            import __spark_entry__ as contract
            from pyspark.sql import SparkSession
            spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
            for name in ("art_reconstruct", "forward_project", "reduce_custom", "udf_scalar"):
                assert contract.queries()[name](spark, {sf_dir!r}).count() > 0
            """
        )
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, check=True, timeout=300)
