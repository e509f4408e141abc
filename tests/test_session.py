"""The package on the workers, and the shared folder."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

from rayloom import session
from rayloom.session import discard, kept, shared_dir

ROOT = Path(__file__).resolve().parents[1]

SCRIPT = """
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
sys.path.insert(0, {root!r})
import __spark_entry__ as e
print("ROWS", e.queries()["timeline_groups"](spark, {data!r}).count())
"""


def test_workers_find_the_package_from_anywhere(tmp_path):
    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("no test data")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT.format(root=str(ROOT), data=data)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS " in out.stdout, out.stderr[-2000:]


UNSET = """
import sys
sys.path.insert(0, {root!r})
from rayloom.session import session, kept, shared_dir
spark = session(**{{"spark.master": "local[2]", "spark.ui.enabled": "false"}})
assert not spark.conf.get("spark.checkpoint.dir", None)
one = shared_dir(spark)
print("ROWS", kept(spark.range(7)).count(), one == shared_dir(spark.newSession()), one.startswith("file:/"))
"""


def test_a_local_session_without_a_shared_folder(tmp_path):
    """The key is unset, also in the defaults of the machine."""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"SPARK_CONF_DIR": str(tmp_path)}
    out = subprocess.run([sys.executable, "-c", UNSET.format(root=str(ROOT))], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS 7 True True" in out.stdout, out.stderr[-2000:]


class Far:
    """A session on a cluster that names no shared folder."""

    class conf:
        get = staticmethod(lambda key, default=None: default)

    class sparkContext:
        master = "spark://host:7077"


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Far)


def test_kept_tables_can_be_discarded(spark, tmp_path):
    df = kept(spark.range(10))
    assert df.count() == 10
    (folder,) = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    discard(df)
    assert not os.path.exists(folder.removeprefix("file:").replace("//", "/"))
    spark.range(3).write.parquet(f"{tmp_path}/own")
    with pytest.raises(ValueError, match="shared folder"):
        discard(spark.read.parquet(f"{tmp_path}/own"))


def test_the_package_is_shipped_once(spark, monkeypatch):
    session.ship(spark)
    monkeypatch.setattr(session.tempfile, "mkdtemp", lambda **_: pytest.fail("shipped again"))
    assert session.ship(spark) is spark
