"""A table of one row for each key in hash buckets, of which an upsert rewrites only those that it touches.

``data/<version>-<id>/bucket=<k>`` has the rows of a bucket as some version wrote
them, and ``versions/<n>.json`` names the folder of each bucket as of version n,
and the last batch of each stream that is in it. A version appears by one rename,
so readers see a batch whole or not at all, and a batch that is replayed after a
failure, or under a new checkpoint folder with the same stream name, changes
nothing. Files are reached through Spark and its Hadoop file systems alone.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


class BucketTable:
    """``keys`` name a row; of rows with equal keys the one that ``latest`` puts first stays (descending, nulls last), whenever it came.

    Rows alike in keys and ``latest`` keep one of them by their other columns' order. The
    number of buckets is fixed when the table is begun: a bucket is what a batch
    rewrites for one key, and what one task sorts.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], latest: list[str], buckets: int = 256):
        self.spark, self.path, self.keys, self.latest, self.buckets = spark, path.rstrip("/"), keys, latest, buckets
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    # ---- versions ----

    def _versions(self) -> list[int]:
        if not self._fs.exists(self._path("versions")):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path("versions"))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def state(self) -> dict:
        """The pointer of the newest version: ``version, buckets, applied``."""
        versions = self._versions()
        if not versions:
            return {"version": -1, "count": self.buckets, "buckets": {}, "applied": {}}
        got = self.spark.read.text(f"{self.path}/versions/{versions[-1]}.json", wholetext=True).first()[0]
        state = json.loads(got)
        if state["count"] != self.buckets:
            raise ValueError(f"the table has {state['count']} buckets")
        return state

    def _point(self, state: dict) -> None:
        self._fs.mkdirs(self._path("versions"))
        draft = self._path(f"versions/_{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(state, sort_keys=True).encode()))
        out.close()
        target = self._path(f"versions/{state['version']}.json")
        if self._fs.exists(target) or not self._fs.rename(draft, target):
            self._fs.delete(draft, False)
            raise RuntimeError(f"version {state['version']} was written by another stream; the batch will be tried again")

    # ---- rows ----

    def read(self, buckets: list[int] | None = None) -> DataFrame | None:
        """The newest version's rows, or those of some of its buckets; None before the first."""
        state = self.state()
        folders = [f for k, f in state["buckets"].items() if buckets is None or int(k) in buckets]
        return self.spark.read.option("mergeSchema", "true").parquet(*[f"{self.path}/{f}" for f in folders]) if folders else None

    def upsert(self, batch: DataFrame, stream: str, number: int) -> bool:
        """Merges a batch of a stream into the buckets of its keys; whether it wasn't in the table yet."""
        state = self.state()
        if state["applied"].get(stream, -1) >= number:
            return False
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        touched = sorted(r[0] for r in batch.select(bucket).distinct().collect())  # numbers of buckets
        if touched:
            old = self.read(touched)
            both = batch if old is None else batch.unionByName(old, allowMissingColumns=True)
            rest = [c for c in both.columns if c not in self.keys + self.latest and not both.schema[c].dataType.typeName().startswith(("map", "variant"))]
            order = [F.desc_nulls_last(c) for c in self.latest] + [F.asc_nulls_last(c) for c in rest]
            last = both.withColumn("__r", F.row_number().over(Window.partitionBy(*self.keys).orderBy(*order))).where("__r = 1").drop("__r")
            folder = f"data/{state['version'] + 1}-{uuid.uuid4().hex[:8]}"
            last.withColumn("bucket", bucket).repartition(len(touched), "bucket").write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
            state["buckets"] |= {str(k): f"{folder}/bucket={k}" for k in touched}
        self._point(state | {"version": state["version"] + 1, "applied": state["applied"] | {stream: number}})
        return True

    def vacuum(self, keep: int = 2) -> None:
        """Removes versions before the last ``keep``, and the folders of data that none of those names."""
        versions = self._versions()
        named = set()
        for n in versions[-keep:]:
            state = json.loads(self.spark.read.text(f"{self.path}/versions/{n}.json", wholetext=True).first()[0])
            named |= set(state["buckets"].values())
        for n in versions[:-keep]:
            self._fs.delete(self._path(f"versions/{n}.json"), False)
        if not versions or not self._fs.exists(self._path("data")):
            return
        newest = versions[-1]
        for folder in self._fs.listStatus(self._path("data")):
            name = folder.getPath().getName()
            if int(name.partition("-")[0]) > newest:
                continue  # of a batch that is being written
            for part in self._fs.listStatus(folder.getPath()):
                if part.isDirectory() and f"data/{name}/{part.getPath().getName()}" not in named:
                    self._fs.delete(part.getPath(), True)
            if not any(p.isDirectory() for p in self._fs.listStatus(folder.getPath())):
                self._fs.delete(folder.getPath(), True)
