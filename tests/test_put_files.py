"""Log files are written line by line: no task holds the lines of a whole file."""

import json
import os
import subprocess
import sys
from collections import Counter
from pathlib import Path

import __spark_entry__ as entry

#: Writes one file of so many lines and prints the peak memory of its tasks, in bytes.
ONE_FILE = """
import glob, json, sys
from pyspark.sql import SparkSession, functions as F
import __spark_entry__ as entry

folder, lines = sys.argv[1], int(sys.argv[2])
spark = (
    SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
    .config("spark.sql.warehouse.dir", f"{folder}/warehouse")
    .config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", f"file://{folder}/events")
    .config("spark.eventLog.rolling.enabled", "false").config("spark.eventLog.compress", "false")
    .getOrCreate()
)
rows = spark.range(lines).select(
    F.concat("id", F.lit(" "), F.repeat(F.lit("x"), 1000)).alias("value"),
    F.when(F.col("id") >= 0, "2024-01-01").alias("day"), (F.col("id") % 1).alias("part"),
)
entry._put_files(rows, f"{folder}/root")
spark.stop()
ended = [json.loads(x) for f in glob.glob(f"{folder}/events/*") for x in open(f) if "TaskEnd" in x]
print(max(x["Task Metrics"]["Peak Execution Memory"] for x in ended))
"""


def test_memory_of_a_task_does_not_follow_its_file(tmp_path):
    (tmp_path / "events").mkdir()
    env = os.environ | {"PYTHONPATH": str(Path(entry.__file__).parent)}
    run = subprocess.run(
        [sys.executable, "-c", ONE_FILE, str(tmp_path), "150000"],
        env=env, cwd=tmp_path, capture_output=True, text=True, check=True, timeout=300,
    )
    found = (tmp_path / "root/archive/cowrie.json.2024-01-01.0").stat().st_size
    assert found > 150_000_000 > 2 * int(run.stdout.split()[-1])


def test_more_files_than_a_task_has_open(spark, tmp_path, monkeypatch):
    """Every line comes to its file, and the session's setting is what it was."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    monkeypatch.setattr(entry, "OPEN_FILES", 3)
    days = [f"2024-01-{n:02}" for n in range(1, 21)] + ["live"]
    rows = [(json.dumps({"n": n}), days[n % 21], n % 3) for n in range(2000)]
    entry._put_files(spark.createDataFrame(rows, "value string, day string, part int"), str(tmp_path))
    held = {
        str(path.relative_to(tmp_path)): Counter(path.read_text().splitlines())
        for path in tmp_path.rglob("cowrie.json*")
        if not path.name.startswith(".")
    }
    wanted = {}
    for value, day, part in rows:
        file = f"s{part}/live/cowrie.json" if day == "live" else f"archive/cowrie.json.{day}.{part}"
        wanted.setdefault(file, Counter())[value] += 1
    assert held == wanted
    assert spark.conf.get(name) == before
