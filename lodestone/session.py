"""Sessions, and making this package importable in Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent
#: Bytes of a table's files to a piece, see ``spread``.
PIECE = 8 << 20


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, unless their PYTHONPATH has it already (once a context)."""
    context = spark.sparkContext
    if getattr(context, "_lodestone_shipped", False):
        return
    context._lodestone_shipped = True
    if str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    target = Path(tempfile.mkdtemp(prefix="lodestone-")) / "lodestone.zip"  # the driver's; Spark serves it
    with zipfile.ZipFile(target, "w") as z:
        for path in sorted((ROOT / "lodestone").rglob("*.py")):
            z.write(path, path.relative_to(ROOT))
    context.addPyFile(str(target))


def reliable(spark: SparkSession) -> None:
    """Make sure that a checkpoint folder is set: the one named in ``spark.checkpoint.dir``; on a local master that names none, a temporary one."""
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master().startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="lodestone-"))


def pieces(frame: DataFrame) -> int:
    """Into how many pieces of PIECE bytes the largest table goes that a frame reads, by Spark's figures; tables of unknown size don't count."""
    leaves = frame._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(k).stats().sizeInBytes()) for k in range(leaves.size())]
    return max([0, *(-(-b // PIECE) for b in sizes if b < 1 << 60)])


def spread(keys: list[str], left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join, dealt by its keys into as many pieces as the larger one's tables have, if that is more than two for each core.

    Spark merges small partitions up to a size after compression; of ids that are millions of rows to a task, with sorts and maps of a GB. Pieces
    of a count of their own stay as they are. Only for keys that no row shares with very many: Spark doesn't split such pieces.
    """
    n = max(pieces(left), pieces(right))
    if n <= 2 * left.sparkSession.sparkContext.defaultParallelism:
        return left, right
    return left.repartition(n, *keys), right.repartition(n, *keys)


def local(cores: str = "*", shuffle: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benches."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lodestone")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
