"""A folder of batches of tables, each committed as a whole, and matches that are kept in one.

A batch's tables stand in a folder of their own below `data`; the batch counts once a small file with the
next number stands in `log`, which is created only where there is none. What a run that died
has written has no such file, so nobody reads it; `sweep` deletes it. A batch may name keys
(dates, for example): of each key the last batch that names it counts, so writing again replaces,
whatever else the older batch holds. A batch with `reset` makes all before it count no more.

The file system under the folder must refuse to create a file that exists (local disks and HDFS do;
an object store may need a committer of its own).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH = "__batch"


class Store:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def batches(self) -> list[dict]:
        """The committed batches that count, oldest first: id, keys (None: it has none), tables."""
        fs, p = self._fs(f"{self.folder}/log")
        if not fs.exists(p):
            return []
        raw = self.spark.read.text(f"{self.folder}/log", wholetext=True).select("_metadata.file_name", "value").collect()  # one small row a batch
        out = []
        for r in sorted(raw, key=lambda r: r.file_name):
            try:
                b = json.loads(r.value)
            except ValueError:
                continue  # its writer died before it was closed
            out = [b] if b["reset"] else [*out, b]
        return out

    def put(self, tables: dict[str, DataFrame], keys: list[str] | None = None, reset: bool = False) -> str:
        """Write the tables and then commit them together; the batch's id."""
        name = uuid.uuid4().hex
        for t, df in tables.items():
            df.withColumn(BATCH, F.lit(name)).write.parquet(f"{self.folder}/data/{name}/{t}")
        text = json.dumps({"id": name, "keys": keys, "tables": sorted(tables), "reset": reset})
        fs, p = self._fs(f"{self.folder}/log")
        number = 1 + max((int(f.getPath().getName().split(".")[0]) for f in fs.listStatus(p)), default=-1) if fs.exists(p) else 0
        while True:
            at = self._fs(f"{self.folder}/log/{number:08d}.json")[1]
            try:
                to = fs.create(at, False)
            except Py4JJavaError as e:
                if not fs.exists(at):
                    raise
                number += 1  # another writer was first
                if number > 99_999_999:
                    raise ValueError("too many batches") from e
                continue
            to.write(bytearray(text.encode()))
            to.close()
            return name

    def owners(self) -> dict[str, str]:
        """key -> the batch that counts for it."""
        return {k: b["id"] for b in self.batches() for k in b["keys"] or ()}

    def read(self, table: str, key: str | None = None) -> DataFrame | None:
        """The table over all batches that count; with `key`, the name of the column that holds a batch's keys,
        rows whose key another batch has replaced are left out. None where no batch has it."""
        all_ = [b for b in self.batches() if table in b["tables"]]
        owners = self.owners()
        live = set(owners.values())
        some = [b for b in all_ if b["keys"] is None or b["id"] in live]
        if not some:
            return None
        df = self.spark.read.option("mergeSchema", True).parquet(*[f"{self.folder}/data/{b['id']}/{table}" for b in some])
        if key is not None:
            own = self.spark.createDataFrame(list(owners.items()) or [("", "")], f"__key string, {BATCH} string")
            df = df.withColumn("__key", F.col(key).cast("string")).join(F.broadcast(own), ["__key", BATCH], "left_semi").drop("__key")  # a row a key of the log
        return df.drop(BATCH)

    def sweep(self) -> int:
        """Delete what no batch that counts holds, as long as no other run writes here; how many folders went."""
        fs, p = self._fs(f"{self.folder}/data")
        if not fs.exists(p):
            return 0
        good, gone = {b["id"] for b in self.batches()}, 0
        for f in fs.listStatus(p):
            if f.getPath().getName() not in good:
                fs.delete(f.getPath(), True)
                gone += 1
        return gone


def _named(pairs: DataFrame) -> DataFrame:
    """Pairs in the order of their names, with `turned` where that is not the order they came in."""
    turned = F.col("image_i") > F.col("image_j")
    return pairs.select(F.least("image_i", "image_j").alias("image_a"), F.greatest("image_i", "image_j").alias("image_b"), turned.alias("turned"))


def kept_matches(store: Store, wanted: DataFrame, match: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, int]:
    """The matches (image_i, image_j, kp_i, kp_j) of the pairs `wanted` (image_i, image_j), and how many pairs were
    matched anew: those that the store has in neither direction. `match` gets these, each in the order of
    its names, and what it returns is committed with them in one batch; a pair without a match is
    stored as well and is not tried again."""
    w = _named(wanted.select("image_i", "image_j")).distinct()
    done = store.read("pairs")
    new = w.select("image_a", "image_b").distinct()
    if done is not None:
        new = new.join(done, ["image_a", "image_b"], "left_anti")
    new = new.persist()
    n = new.count()
    if n:
        m = match(new.select(F.col("image_a").alias("image_i"), F.col("image_b").alias("image_j")))
        turn = F.col("image_i") > F.col("image_j")
        k = lambda a, b: F.when(turn, F.col(a)).otherwise(F.col(b))
        m = m.select(F.least("image_i", "image_j").alias("image_a"), F.greatest("image_i", "image_j").alias("image_b"), k("kp_j", "kp_i").alias("kp_a"), k("kp_i", "kp_j").alias("kp_b"))
        store.put({"pairs": new, "matches": m})
    new.unpersist()
    found = store.read("matches")
    if found is None:  # nothing was wanted, ever
        none = "cast(null as string) image_i, cast(null as string) image_j, cast(null as long) kp_i, cast(null as long) kp_j"
        return wanted.sparkSession.range(0).selectExpr(*none.split(", ")), 0
    m = found.join(w, ["image_a", "image_b"])
    side = lambda a, b: F.when(F.col("turned"), F.col(a)).otherwise(F.col(b))
    return m.select(side("image_b", "image_a").alias("image_i"), side("image_a", "image_b").alias("image_j"), side("kp_b", "kp_a").alias("kp_i"), side("kp_a", "kp_b").alias("kp_j")), n
