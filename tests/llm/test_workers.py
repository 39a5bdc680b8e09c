"""On a cluster whose workers have no copy of the package, only the driver's path leads to it."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent.parent
RUN = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
conf = {{"spark.master": "local-cluster[2,1,1024]", "spark.executor.memory": "900m", "spark.sql.shuffle.partitions": "2", "spark.ui.enabled": "false",
        "spark.checkpoint.dir": "file://{shared}", "spark.driver.host": "127.0.0.1", "spark.ui.showConsoleProgress": "false"}}
spark = SparkSession.builder.config(map=conf).getOrCreate()
import __spark_entry__
for name in {names!r}:
    print(name, __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001").count(), flush=True)
spark.stop()
"""


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no test tables here")
def test_workers_need_no_copy_of_the_package(tmp_path):
    names = ["op2_language_id", "op4_decontaminate", "op7_lm_scoring"]
    home = tmp_path / "home"
    home.mkdir()
    import pyspark

    for p in Path(pyspark.__file__).parent.iterdir():  # executors' logs go beside these links
        if p.name != "work":
            (home / p.name).symlink_to(p)
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    env |= {"SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "PYSPARK_PYTHON": sys.executable}
    code = RUN.format(root=str(ROOT), shared=str(tmp_path / "shared"), names=names)
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]
    assert [line.split() for line in done.stdout.splitlines() if line.startswith("op")] == [[n, "200"] for n in names]
