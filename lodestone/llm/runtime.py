"""Session helpers shared by the operators: lineage cuts, row identities and reading a table."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

#: Rows in one Arrow batch handed to Python, and its bytes. Long texts make long batches, so it is far below Spark's 10,000.
ARROW_ROWS, ARROW_BYTES = 512, 32 << 20
#: Bits of a bitmap of keys: 8 MiB at most are broadcast, however many keys there are.
BITMAP_BITS = 1 << 26


def prepare(spark: SparkSession) -> None:
    """Bound Arrow batches and make sure that a checkpoint folder exists.

    The folder named in ``spark.checkpoint.dir`` is used as it is; only where the session names none
    (local tests) is a temporary one made; elsewhere than on a local master that is an error.
    """
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    if not 0 < int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) <= ARROW_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    ship(spark)
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master().startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="lodestone-"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as Spark's writers take it."""
    prepare(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and go on from there (survives lost executors)."""
    prepare(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have yet, so that extra columns of the input never clash."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def prefix(df: DataFrame) -> str:
    """What no column name of ``df`` begins with: a space for an operator's own columns beside those of its input."""
    out = "_own_"
    while any(c.lower().startswith(out) for c in df.columns):
        out += "_"
    return out


def any_of(columns: list[Column]) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | c
    return out


def tidy(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffles of frames that nothing refers to any more (it acts when the driver collects garbage)."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def bitmap(keys: DataFrame, key: str) -> DataFrame:
    """(k, bits): a bit for each key's hash, in pages of 4 KiB; BITMAP_BITS / 8 bytes at most, so that it can be broadcast."""
    bit = _bit(F.col(key))
    return keys.groupBy(F.bitmap_bucket_number(bit).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))


def marked(df: DataFrame, key: Column, bits: DataFrame) -> tuple[DataFrame, Column]:
    """``df`` with its page of a bitmap beside each row, and whether the row's bit is set: true for all keys of the bitmap, and for a few more."""
    own = prefix(df)
    bits = bits.select(F.col("k").alias(own + "page"), F.col("bits").alias(own + "bits"))
    at = F.bitmap_bit_position(_bit(key))
    byte = F.conv(F.hex(F.substring(F.col(own + "bits"), (F.shiftright(at.cast("int"), 3) + 1), F.lit(1))), 16, 10).cast("int")
    found = F.call_function("shiftright", byte, (at % 8).cast("int")).bitwiseAND(F.lit(1)) == 1
    return df.join(F.broadcast(bits), F.bitmap_bucket_number(_bit(key)) == F.col(own + "page"), "left"), F.coalesce(found, F.lit(False))


def _bit(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BITMAP_BITS)) + 1  # Spark's bitmaps number positive values from 1
