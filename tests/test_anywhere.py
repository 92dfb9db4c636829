"""Jobs with Python functions run from any working folder, as their package travels with them."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
JOB = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
from lexframe.plans.registry import queries
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
print("rows", *[queries()[n](spark, "/root/testdata/sf0.001").count() for n in ("trace_peak_alive", "stream_trace", "template_segments")])
"""


def test_other_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", JOB.format(repo=REPO)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "rows 16 16 " in done.stdout, done.stderr[-2000:]


def test_no_private_scratch_on_a_cluster():
    import pytest

    from lexframe.sources.workdir import base_dir

    class Context:
        master, applicationId = "spark://host", "a"
        getConf = staticmethod(dict)
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext, conf = Context, {}

    with pytest.raises(ValueError):
        base_dir(Session)
