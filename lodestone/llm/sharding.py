"""Extendible hashing: shards of bounded bytes.

A row's key is hashed to 60 bits. The directory starts as one bucket; a bucket that holds more than the
limit splits on its next bit, and only such buckets do, until each fits. The splits are found on sums:
bytes are added up (before the shuffle) by a prefix of a few bits more than the number of shards needs, the
sums of all shorter prefixes follow from these, and a prefix's bucket is the shortest one that fits. Where
even the longest prefix is too large, the rows below it alone go on with more bits.

Rows that agree in all 60 bits (repeats of one row, or one row beyond the limit) can't be split by bits. They
go to overflow shards, filled in turn up to the limit; a row that is larger than the limit has a shard alone.

Defined results: a null or empty text has 0 bytes; a null id hashes as 'null'; repeated rows are spread
over overflow shards only if together they exceed the limit; an empty table has no shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import runtime

BITS = 60
LIMIT = 1 << 20
#: Bits of prefix beyond those that evenly filled shards would need.
SPARE = 4


def key_hash(*keys: Column) -> Column:
    parts = [F.coalesce(k.cast("string"), F.lit("null")) for k in keys]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 15), 16, 10).cast("long")


def _prefix(h: Column, bits: int | Column) -> Column:
    return F.call_function("shiftright", h, F.lit(BITS) - (F.lit(bits) if isinstance(bits, int) else bits))


def _depths(cells: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """(cell, depth): for each prefix of ``high`` bits, the shortest prefix of more than ``low`` bits that fits; null if none."""
    every = cells.select("cell", "bytes", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth"))
    every = every.withColumn("bucket", F.call_function("shiftright", F.col("cell"), F.lit(high) - F.col("depth")))
    sums = every.groupBy("depth", "bucket").agg(F.sum("bytes").alias("total")).where(F.col("total") <= limit)
    fits = every.join(sums, ["depth", "bucket"]).groupBy("cell").agg(F.min("depth").alias("depth"))
    return cells.select("cell").join(fits, "cell", "left")


def directory(rows: DataFrame, limit: int = LIMIT) -> list[tuple[int, DataFrame]]:
    """[(bits, (cell, depth))] rounds; ``rows`` has h, bytes. A null depth goes on in the next round, or overflows after the last."""
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    bits = min(BITS, max(1, (total // limit)).bit_length() + SPARE)
    rounds, left, low = [], rows, 0
    while True:
        cells = left.groupBy(_prefix(F.col("h"), bits).alias("cell")).agg(F.sum("bytes").alias("bytes"))
        found = runtime.cut(_depths(cells, low, bits, limit))
        rounds.append((bits, found))
        full = found.where("depth IS NULL")
        if bits == BITS or full.isEmpty():
            return rounds
        left = left.join(full.select(F.col("cell").alias("_c")), _prefix(F.col("h"), bits) == F.col("_c"), "left_semi")
        low, bits = bits + 1, min(BITS, bits + 14)


def assign(df: DataFrame, limit: int = LIMIT, keys: tuple[str, ...] = ("doc_id", "text"), text_col: str = "text") -> DataFrame:
    """``df`` with n_bytes and shard: the bits of the bucket, for overflow shards ``<bits>+<number>``."""
    runtime.prepare(df.sparkSession)
    names = [runtime.fresh(df, n) for n in ("n_bytes", "shard")]
    own = runtime.prefix(df)
    h = key_hash(*[F.md5(k) if df.schema[k].dataType.simpleString() == "string" else F.col(k) for k in keys])
    whole = df.withColumns({f"{own}h": h, f"{own}bytes": F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")})
    small = runtime.cut(whole.select(F.col(f"{own}h").alias("h"), F.col(f"{own}bytes").alias("bytes")))
    rounds = directory(small, limit)
    shard = F.lit(None).cast("string")
    placed = whole
    for k, (bits, found) in enumerate(rounds):
        found = found.select(F.col("cell").alias(f"{own}cell{k}"), F.col("depth").alias(f"{own}depth{k}"))
        placed = placed.join(found, _prefix(F.col(f"{own}h"), bits) == F.col(f"{own}cell{k}"), "left")
        d = F.col(f"{own}depth{k}")
        label = F.when(d == 0, F.lit("")).otherwise(F.lpad(F.bin(_prefix(F.col(f"{own}h"), d)), BITS, "0"))
        shard = F.coalesce(shard, F.when(d.isNotNull(), F.right(label, d)))
    placed = placed.select(*df.columns, f"{own}h", f"{own}bytes", shard.alias(f"{own}shard"))
    if not rounds[-1][1].where("depth IS NULL").isEmpty():
        placed = _overflow(placed, limit, own)
    return placed.select(*df.columns, F.col(f"{own}bytes").alias(names[0]), F.col(f"{own}shard").alias(names[1]))


def _overflow(placed: DataFrame, limit: int, own: str) -> DataFrame:
    """Numbers for rows without a bucket: those of one hash fill shards in turn, numbered within input partitions first."""
    h, size, shard, part, nth, before, n, most = (own + x for x in ("h", "bytes", "shard", "part", "nth", "before", "n", "most"))
    done = placed.where(F.col(shard).isNotNull())
    # Written once: the numbers of partitions must be the same wherever they are read.
    rest = runtime.cut(placed.where(F.col(shard).isNull()).withColumn(part, F.spark_partition_id()))
    rest = rest.withColumn(nth, F.row_number().over(Window.partitionBy(h, part).orderBy(size)))
    ahead = rest.groupBy(h, part).agg(F.count("*").alias(n), F.max(size).alias(most))
    so_far = F.sum(n).over(Window.partitionBy(h).orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    largest = F.greatest(F.max(most).over(Window.partitionBy(h)), F.lit(1))
    ahead = ahead.select(h, part, F.coalesce(so_far, F.lit(0)).alias(before), largest.alias(most))
    each = F.greatest(F.floor(F.lit(limit) / F.col(most)), F.lit(1))
    number = F.floor((F.col(before) + F.col(nth) - 1) / each).cast("string")
    rest = rest.join(ahead, [h, part]).withColumn(shard, F.concat(F.lpad(F.bin(h), BITS, "0"), F.lit("+"), number))
    return done.unionByName(rest.select(*done.columns))


def write_shards(df: DataFrame, path: str, limit: int = LIMIT) -> None:
    """Write ``df``'s rows as Parquet, a folder and a file for each shard."""
    placed = assign(df, limit)
    shard = placed.columns[-1]
    placed.repartition(F.col(shard)).write.partitionBy(shard).mode("overwrite").parquet(path)


SQL = f"""
WITH rows AS (
  SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS n_bytes,
         ('0x' || substr(md5(concat_ws('|', coalesce(doc_id::VARCHAR, 'null'), coalesce(md5(text), 'null'))), 1, 15))::BIGINT AS h
  FROM documents
), levels AS (
  SELECT r.*, d.d, r.h >> ({BITS} - d.d) AS bucket FROM rows r, range(0, 41) AS d(d)
), sums AS (SELECT d, bucket, sum(n_bytes) AS total FROM levels GROUP BY ALL),
depths AS (SELECT l.doc_id, min(l.d) AS depth FROM levels l JOIN sums s ON s.d = l.d AND s.bucket = l.bucket AND s.total <= {LIMIT} GROUP BY l.doc_id)
SELECT r.doc_id, r.n_bytes, CASE WHEN depth = 0 THEN '' ELSE right(lpad(bin(r.h >> ({BITS} - depth)), {BITS}, '0'), depth::INT) END AS shard
FROM rows r JOIN depths USING (doc_id)
"""
