"""A keyed table that micro-batches save into, kept small by compaction.

Every micro-batch adds one delta folder of its newest rows per key. After ``deltas`` of them base and deltas are folded into
a new base, buckets of keys side by side, so files stay bounded however many batches run. A manifest names what belongs to the
table and the last batch; it is written beside the old one and renamed over it, so a reader or a retry sees the state
before or after a batch and never half of it. The newest row of a key is the largest by (order, then all other values), so
late and tied saves give one answer whatever the batches were.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = "manifest.json"


def newest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row per key; rows that tie on ``order`` are told apart by their other values."""
    values = [c for c in df.columns if c not in keys]
    by = F.struct(*order, *[c for c in values if c not in order])
    return df.groupBy(*keys).agg(F.max_by(F.struct(*values), by).alias("_v")).select(*keys, "_v.*").select(df.columns)


class UpsertTable:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: list[str], order: list[str], *,
                 deltas: int = 8, buckets: int | None = None):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.keys, self.order, self.deltas, self.buckets = keys, order, deltas, buckets
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # ------------------------------------------------------------ manifest

    def _state(self) -> dict:
        where = self._path(f"{self.path}/{MANIFEST}")
        if not self._fs.exists(where):
            return {"batch": -1, "base": None, "deltas": []}
        lines = self.spark.read.text(f"{self.path}/{MANIFEST}", wholetext=True).first()
        return json.loads(lines["value"])

    def _commit(self, state: dict) -> None:
        jvm = self.spark.sparkContext._jvm
        fresh = self._path(f"{self.path}/.{MANIFEST}-{uuid.uuid4().hex}")
        out = self._fs.create(fresh, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        overwrite = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(fresh, self._path(f"{self.path}/{MANIFEST}"), overwrite)

    def _read(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in folders])

    # ------------------------------------------------------------ use

    def save(self, batch: DataFrame, batch_id: int) -> None:
        """Upsert a micro-batch; one that was saved before is left alone. For ``foreachBatch``."""
        state = self._state()
        if batch_id <= state["batch"]:
            return
        name = f"delta-{batch_id}-{uuid.uuid4().hex[:8]}"
        newest(batch.select(self.schema.names), self.keys, self.order).write.parquet(f"{self.path}/{name}")
        held = ([state["base"]] if state["base"] else []) + state["deltas"] + [name]
        if len(state["deltas"]) + 1 < self.deltas:
            self._commit(state | {"batch": batch_id, "deltas": state["deltas"] + [name]})
            return
        base = f"base-{batch_id}-{uuid.uuid4().hex[:8]}"
        whole = newest(self._read(held), self.keys, self.order)
        if self.buckets:
            whole = whole.repartition(self.buckets, *self.keys)
        whole.sortWithinPartitions(*self.keys).write.parquet(f"{self.path}/{base}")
        self._commit({"batch": batch_id, "base": base, "deltas": []})
        for folder in held:  # no reader finds them any more
            self._fs.delete(self._path(f"{self.path}/{folder}"), True)

    def read(self) -> DataFrame:
        """The newest row of every key."""
        state = self._state()
        held = ([state["base"]] if state["base"] else []) + state["deltas"]
        if not held:
            return self.spark.createDataFrame([], self.schema)
        return newest(self._read(held), self.keys, self.order)
