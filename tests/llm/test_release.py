"""What executors of their own hand back between steps."""

import os
import subprocess
import sys

RUN = """
import re
import time
from pathlib import Path
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from moraine.llm.common import hand_back

s = SparkSession.builder.master("local-cluster[1,2,1200]").config("spark.executor.memory", "1000m").config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1").config("spark.sql.shuffle.partitions", "8").getOrCreate()

def executor_mb():
    for p in Path("/proc").glob("[0-9]*"):
        try:
            line = (p / "cmdline").read_text()
            if "CoarseGrainedExecutorBackend" in line and s.sparkContext.applicationId in line:
                return int(re.search(r"RssAnon:\\s+(\\d+)", (p / "status").read_text())[1]) // 1024
        except OSError:
            pass

rows = s.range(0, 3_000_000, 1, 8).select((F.col("id") * 7919 % 100003).alias("u"), F.sha2(F.col("id").cast("string"), 256).alias("x"))
rows.repartition("u").sortWithinPartitions("x").write.format("noop").mode("overwrite").save()
before = executor_mb()
hand_back(s)
time.sleep(3)  # heap is uncommitted by another thread
print("MB", before, executor_mb())
s.stop()
"""


def test_executors_hand_back_heap():
    env = os.environ | {"PYSPARK_PYTHON": sys.executable, "PYTHONPATH": os.pathsep.join(p for p in sys.path if p)}
    out = subprocess.run([sys.executable, "-c", RUN], env=env, capture_output=True, text=True, timeout=240).stdout
    before, after = map(int, out.split("MB")[1].split())
    assert before > 400 and after < 0.7 * before, (before, after)
