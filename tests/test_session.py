import os
import subprocess
import sys

PLAIN = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
import __spark_entry__ as entry
spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
from granary.session import _written, release
assert spark.conf.get("spark.checkpoint.dir", None) is None
assert entry.entry(spark).count() > 0
assert spark.conf.get("spark.checkpoint.dir", None) is None
import os
folders = [p.removeprefix("file:") for _, p in _written]
assert folders and all(os.path.isdir(f) for f in folders)
release(spark)
assert not any(os.path.exists(f) for f in folders) and not _written
print("plain session ok")
"""


def test_entry_in_a_session_without_checkpoint_folder(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    run = subprocess.run(
        [sys.executable, "-c", PLAIN.format(root=root)], capture_output=True, text=True, timeout=600, env=os.environ | {"SPARK_CONF_DIR": str(tmp_path)},
    )
    assert "plain session ok" in run.stdout, run.stderr[-2000:]
