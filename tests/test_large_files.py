"""Files of which an executor can hold one at a time, but not one for each of its cores."""

import hashlib
import importlib.util
import os
import subprocess
import sys
from pathlib import Path

import pytest

from glossa.sources.texts import COPIES, executor, from_files, one_at_a_time

ROOT = Path(__file__).resolve().parents[1]
READ = """
import sys
from pyspark.sql import SparkSession
from glossa.sources.texts import from_files
b = SparkSession.builder.master("local-cluster[1,2,1024]").config("spark.executor.memory", "650m").config("spark.ui.enabled", "false")
b = b.config("spark.driver.memory", "600m").config("spark.task.maxFailures", "1").config("spark.excludeOnFailure.enabled", "false")
spark = b.config("spark.executor.extraJavaOptions", "-XX:ActiveProcessorCount=2").config("spark.local.dir", sys.argv[3]).getOrCreate()
spark.range(1).count()  # the executor is there
from_files(spark, sys.argv[1]).unionAll(from_files(spark, f"{sys.argv[1]}/more")).write.parquet(sys.argv[2])  # both in one stage
"""


def test_one_large_file_at_a_time(tmp_path):
    import pyarrow.parquet as pq

    for d in ("files/more", "home", "local"):
        (tmp_path / d).mkdir(parents=True)
    for p in Path(importlib.util.find_spec("pyspark").origin).parent.iterdir():  # executors log into Spark's home
        if p.name != "work":
            (tmp_path / "home" / p.name).symlink_to(p)
    texts = [b"\r\n".join(b"%d %s" % (i, hashlib.sha256(b"%d" % (i + k)).hexdigest().encode()) for i in range(450_000)) for k in range(4)]
    for k, t in enumerate(texts):
        (tmp_path / ("files" if k < 2 else "files/more") / f"{k}.txt").write_bytes(t)
    (tmp_path / "files" / "bad.txt").write_bytes(b"caf\xe9")
    run = [sys.executable, "-c", READ, str(tmp_path / "files"), str(tmp_path / "out"), str(tmp_path / "local")]
    got = subprocess.run(run, env=os.environ | {"PYTHONPATH": str(ROOT), "SPARK_HOME": str(tmp_path / "home")}, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert got.returncode == 0, got.stderr[-3000:]
    rows = [(Path(r["path"]).name, r["valid"], r["text"]) for r in pq.read_table(tmp_path / "out").to_pylist()]
    want = [(f"{k}.txt", True, t.decode().replace("\r\n", "\n")) for k, t in enumerate(texts)]
    assert sorted(rows, key=lambda r: r[0]) == [*want[:2], *(r for r in want[2:] for _ in range(2)), ("bad.txt", False, None)]


@pytest.mark.parametrize(("cores", "files_in_heap", "expected"), [(4, 100, False), (4, 4, False), (4, 3.9, True), (4, 0.1, True), (1, 0.1, False), (1, 9, False)])
def test_one_at_a_time_where_not_each_core_has_room(cores, files_in_heap, expected):
    assert one_at_a_time(cores, int(files_in_heap * COPIES * 1_000_000), 1_000_000) is expected


def test_a_local_session_and_an_empty_folder(spark, tmp_path):
    assert executor(spark)[0] == 1 and not one_at_a_time(*executor(spark), 10**12) and not one_at_a_time(4, 10**9, 0)
    (tmp_path / "none").mkdir()
    assert from_files(spark, str(tmp_path / "none")).collect() == []
