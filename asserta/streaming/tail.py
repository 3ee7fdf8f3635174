"""Following a store's log with Structured Streaming."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from asserta.model import DATOM, FACT
from asserta.sources.store import Store
from asserta.sources.workspace import child_names, delete_path

#: Seconds to wait for a commit that is under way, before what it logged is put aside.
PATIENCE = 5.0


def stream(spark: SparkSession, path: str) -> DataFrame:
    """Datoms as folders of the log arrive, committed or not."""
    return spark.readStream.schema(DATOM).option("basePath", f"{path}/txlog").parquet(f"{path}/txlog")


def changes(datoms: DataFrame) -> DataFrame:
    """Each fact whose operations changed, and whether it is current; for the update output mode. State has a row for
    each fact, as retractions may come at any time."""
    last = F.max(F.shiftleft("tx", 1) + F.col("retracted").cast("bigint"))
    return datoms.groupBy(*FACT).agg(last.alias("last")).select(*FACT, F.shiftright("last", 1).alias("tx"), (F.col("last") % 2 == 0).alias("current"))


class Follower:
    """Delivers committed transactions, each once unless a run is repeated after a failure. A transaction is committed
    if the manifest has got so far and doesn't list it as failed. What isn't settled yet is put aside beside the
    checkpoint, for as long as it takes, and delivered with a later batch or at the next start."""

    def __init__(self, store: Store, handle: Callable[[DataFrame, int], None], checkpoint: str, patience: float = PATIENCE):
        self.store, self.handle, self.patience = store, handle, patience
        self.aside = f"{checkpoint.rstrip('/')}-aside"

    def batch(self, rows: DataFrame, number: int) -> None:
        spark = self.store.spark
        waiting = child_names(spark, self.aside)
        if waiting:
            rows = rows.unionByName(spark.read.schema(DATOM).parquet(*[f"{self.aside}/{n}" for n in waiting]))
        rows = rows.dropDuplicates().persist()  # a batch that is repeated meets what it put aside before
        last = rows.agg(F.max("tx")).first()[0]
        if last is not None:
            until = time.time() + self.patience
            while (known := self.store.manifest()) and known.max_tx < last and time.time() < until:
                time.sleep(0.1)
            most, failed = (known.max_tx, known.failed) if known else (-1, [])
            rest = rows.where(F.col("tx") > most)
            if not rest.isEmpty():
                rest.write.parquet(f"{self.aside}/{uuid.uuid4().hex}")
            self.handle(rows.where((F.col("tx") <= most) & ~F.col("tx").isin(failed)) if failed else rows.where(F.col("tx") <= most), number)
        for n in waiting:
            delete_path(spark, f"{self.aside}/{n}")
        rows.unpersist()

    def settle(self) -> None:
        """Delivers what was put aside before and is committed by now."""
        if child_names(self.store.spark, self.aside):
            self.batch(self.store.spark.createDataFrame([], DATOM), -1 - time.time_ns())


def follow(store: Store, handle: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False, patience: float = PATIENCE) -> StreamingQuery:
    """Calls handle(datoms, batch) with committed transactions. once: what is there now, then ends. Batches delivered
    at the start from what was put aside have negative numbers."""
    follower = Follower(store, handle, checkpoint, patience)
    follower.settle()
    writer = stream(store.spark, store.path).writeStream.foreachBatch(follower.batch).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if once else writer.start()
