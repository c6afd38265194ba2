"""An inbox of archives as a stream: what arrives is decoded once and can be searched at once.

Each micro-batch writes its tables to a folder of its own, ``batch=<n>``. A batch that is run again after a failure overwrites its folder, so
that with the checkpoint's record of files every archive counts once. ``apk.load`` reads all batches as one code model.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.model import CodeModel
from ..sources import apk

FILE = "path string, modificationTime timestamp, length long, content binary"


def watch(
    spark: SparkSession,
    inbox: str,
    out: str,
    checkpoint: str,
    on_batch: Callable[[CodeModel, int], None] | None = None,
    extra: tuple[str, ...] = (),
    files: int = 64,
    once: bool = False,
) -> StreamingQuery:
    """Decode archives as they arrive in ``inbox``; ``out`` and ``checkpoint`` are folders that driver and executors share.

    on_batch gets the code model of each batch alone, as soon as that is written: searches there give results while others are still to come.
    files bounds a batch. once: take what is there and end. Archives that can't be decoded give rows of the table ``errors``.
    """

    def take(df: DataFrame, n: int) -> None:
        apk.decoded(df, extra, permissive=True).write.mode("overwrite").partitionBy("table").parquet(f"{out}/batch={n}")
        if on_batch:
            on_batch(apk.load(df.sparkSession, f"{out}/batch={n}"), n)

    stream = spark.readStream.format("binaryFile").schema(FILE).option("maxFilesPerTrigger", files).load(inbox)
    writer = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def progress(query: StreamingQuery) -> dict[str, int]:
    """Batches done and archives taken, of those batches that the query still remembers."""
    recent = query.recentProgress
    return {"batches": sum(1 for p in recent if p["numInputRows"]), "archives": sum(p["numInputRows"] for p in recent)}
