"""Quality rules with adaptive thresholds.

Each document gets integer metrics. Per language and source, and per metric, a mergeable quantile sketch is
kept: a histogram over buckets of bounded relative width (a value keeps its five leading bits, so a bucket is at
most 1/16 wide), whose counts add up in any order. Quantiles of the sketches replace fixed cutoffs: a
document is an outlier of its group when a metric lies beyond a fence made from its group's quantiles.
Groups below ``min_group`` documents borrow the sketch of their language's documents, merged over sources,
so that a small source cannot declare its own junk usual. Thresholds join the metrics by (lang, source).

Fences (Q1, Q2, Q3: quartiles of the group): upper = Q3 + spread * max(Q3 - Q1, Q3 / 4, least[metric]),
lower = Q1 - spread * max(Q3 - Q1, Q3 / 4, least[metric]).

Defined results: null text has no words and fails the base rules; null lang or source form groups of their
own; repeated rows are judged alike, one output row each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import runtime, textscan as ts

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Metric, which sides are fenced, and the least spread that counts (all per mille but mean_word: hundredths).
FENCED = (("symbol_rate", "high", 15), ("dup_line_rate", "high", 100), ("repeat_rate", "high", 50), ("upper_rate", "high", 100), ("bang_rate", "high", 20), ("mean_word", "both", 100))
SPREAD = 4
MIN_GROUP = 50
SYMBOLS = np.zeros(256, np.int64)
SYMBOLS[list(b"#*$%&|<>")] = 1
METRICS_SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_bang long"


def _slab_metrics(buf: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    w = ts.words(buf, offsets, ts.SPACE, lower=False)
    docs = w.docs

    def spread(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags)])
        return total[offsets[1:]] - total[offsets[:-1]]

    chars = ts.SPACE[buf] & ((buf & 0xC0) != 0x80)
    hashes, whole = w.windows(5)
    many, _ = ts.repeated(w.doc[: len(hashes)][whole], hashes[whole])
    covered = np.zeros(len(w.hash) + 1, np.int64)
    at = np.flatnonzero(whole)[many]
    np.add.at(covered, at, 1)
    np.add.at(covered, at + 5, -1)
    repeat = np.cumsum(covered[:-1]) > 0
    # Lines: cut at \n and at the ends of documents; a line's hash is over all its bytes.
    cut = np.unique(np.concatenate([offsets, np.flatnonzero(buf == 10) + 1])) if len(buf) else np.zeros(1, np.int64)
    begin, end = cut[:-1], cut[1:].copy()
    ends_in_newline = buf[end - 1] == 10 if len(end) else np.zeros(0, bool)
    line_doc = np.searchsorted(offsets, begin, "right") - 1
    with_word = np.searchsorted(w.start, end) > np.searchsorted(w.start, begin)
    begin, end, line_doc = begin[with_word], (end - ends_in_newline)[with_word], line_doc[with_word]
    said = [buf[a:b].tobytes() for a, b in zip(begin, end, strict=True)]
    later, seen, last = np.zeros(len(said), bool), set(), -1
    for i, (d, line) in enumerate(zip(line_doc.tolist(), said, strict=True)):
        if d != last:
            seen, last = set(), d
        later[i] = line in seen
        seen.add(line)
    return [
        np.diff(w.first),
        spread(chars),
        spread(SYMBOLS[buf]),
        ts.per_doc(later, line_doc, docs),
        ts.per_doc(repeat, w.doc, docs),
        np.bincount(line_doc, minlength=docs),
        spread((buf >= 65) & (buf <= 90)),
        spread(buf == 33),
    ]


def metrics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """Per row: its id, the columns of ``keep`` and the metrics, all from the whole text."""
    runtime.prepare(df.sparkSession)
    names = [x.split()[0] for x in METRICS_SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [_slab_metrics(buf, offsets) for _, buf, offsets in ts.slabs(batch.column(batch.num_columns - 1))]
            columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * len(names)
            arrays = [*batch.columns[:-1], *(pa.array(c.astype(np.int64)) for c in columns)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names[:-1], *names])

    head = [id_col, *keep]
    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in head] + [METRICS_SCHEMA])
    return df.select(*head, text_col).mapInArrow(run, schema)


def rates() -> dict[str, Column]:
    """Integer rates out of the metrics."""
    words, chars, lines = (F.greatest(F.col(c), F.lit(1)) for c in ("n_words", "word_chars", "n_lines"))
    return {
        "symbol_rate": F.expr("1000 * n_symbols div greatest(word_chars, 1)"),
        "dup_line_rate": F.expr("1000 * n_dup_lines div greatest(n_lines, 1)"),
        "repeat_rate": F.expr("1000 * n_repeat_words div greatest(n_words, 1)"),
        "upper_rate": F.expr("1000 * n_upper div greatest(word_chars, 1)"),
        "bang_rate": F.expr("1000 * n_bang div greatest(word_chars, 1)"),
        "mean_word": F.expr("100 * word_chars div greatest(n_words, 1)"),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def bucket(value: Column) -> Column:
    """A value's bucket, given as its least value: its five leading bits."""
    shift = F.greatest(F.length(F.bin(value)) - 5, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def sketches(measured: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, metric, bucket, n): counts add up, so sketches of parts merge by a sum."""
    names = [m for m, _, _ in FENCED]
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), bucket(F.col(m)).alias("bucket")) for m in names])).alias("x")
    long = measured.where(~base_failed()).select(lang, source, pairs)
    return long.groupBy(lang, source, F.col("x.metric").alias("metric"), F.col("x.bucket").alias("bucket")).agg(F.count("*").alias("n"))


def quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, metric, size, q1, q3): the buckets in which the ranks ceil(n/4) and ceil(3n/4) fall."""
    merged = sketch.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))
    rows = merged.groupBy(*keys, "metric").agg(F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("b"), F.sum("n").alias("size"))
    # A sketch has at most 16 buckets for each of 60 powers of two, so its array is bounded.

    def at(share: int) -> Column:
        rank = F.expr(f"(size * {share} + 3) div 4")
        folded = F.aggregate(
            "b",
            F.struct(F.lit(0).cast("long").alias("seen"), F.lit(-1).cast("long").alias("hit")),
            lambda acc, x: F.struct(
                (acc["seen"] + x["n"]).alias("seen"),
                F.when((acc["hit"] < 0) & (acc["seen"] + x["n"] >= rank), x["bucket"]).otherwise(acc["hit"]).alias("hit"),
            ),
        )
        return folded["hit"]

    return rows.select(*keys, "metric", "size", at(1).alias("q1"), at(3).alias("q3"))


def thresholds(measured: DataFrame, min_group: int = MIN_GROUP, spread: int = SPREAD) -> DataFrame:
    """One row per (lang, source): low_<metric> and high_<metric> of each fenced metric."""
    sketch = runtime.cut(sketches(measured))
    own = quartiles(sketch, ["lang", "source"])
    wide = quartiles(sketch, ["lang"]).select(F.col("lang").alias("l"), F.col("metric").alias("m"), F.col("q1").alias("w1"), F.col("q3").alias("w3"))
    both = own.join(wide, F.col("lang").eqNullSafe(F.col("l")) & (F.col("metric") == F.col("m")), "left")
    q1 = F.when(F.col("size") >= min_group, F.col("q1")).otherwise(F.col("w1"))
    q3 = F.when(F.col("size") >= min_group, F.col("q3")).otherwise(F.col("w3"))
    least = F.create_map(*[F.lit(x) for m, _, low in FENCED for x in (m, low)])
    reach = spread * F.greatest(q3 - q1, F.expr("1") * (F.floor(q3 / 4)), least[F.col("metric")].cast("long"))
    fences = both.select("lang", "source", "metric", (q1 - reach).alias("low"), (q3 + reach).alias("high"))
    columns = [F.max(F.when(F.col("metric") == m, F.col(side))).alias(f"{side}_{m}") for m, sides, _ in FENCED for side in ("low", "high") if side == "high" or sides == "both"]
    return fences.groupBy("lang", "source").agg(*columns)


def judge(measured: DataFrame, fences: DataFrame) -> DataFrame:
    """``measured`` with base_failed, outlier (the first metric out of its fence, else null) and kept."""
    f = fences.withColumnsRenamed({"lang": "fence_lang", "source": "fence_source"})
    same = F.col("lang").eqNullSafe(F.col("fence_lang")) & F.col("source").eqNullSafe(F.col("fence_source"))
    joined = measured.join(f, same, "left")
    out = [F.when(F.col(m) > F.col(f"high_{m}"), F.lit(m)) for m, _, _ in FENCED]
    out += [F.when(F.col(m) < F.col(f"low_{m}"), F.lit(m)) for m, sides, _ in FENCED if sides == "both"]
    return joined.withColumns({"base_failed": base_failed(), "outlier": F.coalesce(*out)}).withColumn("kept", ~F.col("base_failed") & F.col("outlier").isNull())


def verdicts(df: DataFrame, min_group: int = MIN_GROUP, spread: int = SPREAD) -> DataFrame:
    """Per document: doc_id, the base metrics, base_failed, kept, outlier."""
    measured = runtime.cut(metrics(df).withColumns(rates()))
    found = judge(measured, thresholds(measured, min_group, spread))
    return found.select("doc_id", *BASE, "base_failed", "kept", "outlier")


def filter_documents(df: DataFrame, min_group: int = MIN_GROUP, spread: int = SPREAD) -> DataFrame:
    """The rows of ``df`` that pass, with its columns.

    Metrics and verdicts follow each row itself (not its id), so repeated and null ids are no matter.
    """
    measured = runtime.cut(metrics(df).withColumns(rates()))
    fences = thresholds(measured, min_group, spread)
    carried = [c for c in df.columns]
    key = runtime.fresh(df, "fence_key")
    row = df.withColumn(key, F.struct(*[F.col(c) for c in carried]))
    again = _inline_metrics(row, key).withColumns(rates())
    return judge(again, fences).where("kept").select(f"{key}.*")


def _inline_metrics(row: DataFrame, key: str) -> DataFrame:
    inner = row.schema[key].dataType
    lang, source, text = (inner.fieldNames().index(c) for c in ("lang", "source", "text"))
    names = [x.split()[0] for x in METRICS_SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.column(0)
            parts = [_slab_metrics(buf, offsets) for _, buf, offsets in ts.slabs(whole.field(text))]
            columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * len(names)
            arrays = [whole, whole.field(lang), whole.field(source), *(pa.array(c.astype(np.int64)) for c in columns)]
            yield pa.RecordBatch.from_arrays(arrays, names=[key, "lang", "source", *names])

    from pyspark.sql import types as T

    kinds = T.StructType.fromDDL(METRICS_SCHEMA)
    schema = T.StructType([T.StructField(key, inner), T.StructField("lang", inner["lang"].dataType), T.StructField("source", inner["source"].dataType), *kinds.fields])
    return row.select(key).mapInArrow(run, schema)
