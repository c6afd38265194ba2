"""Benchmark decontamination with a broadcast hash set of normalised n-grams.

A window is ``n`` consecutive words of an item (A-Z lower-cased, words of letters, digits and non-ASCII
characters); an item of fewer words, but not none, is one window. Workers hold the windows' hashes in one sorted
array, look up the windows of each document's token stream, and verify every hit word by word. The set is
broadcast only while the benchmark's text is at most ``max_broadcast_bytes``; a larger benchmark is joined
by window hash in a shuffle instead, with the same results.

Defined results: null or empty texts have no words; a null item_id counts as the empty string; repeated
items with one id count once per distinct id; repeated documents each get their own row. An empty table gives an
empty result, an empty benchmark no hits. Very long texts count whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime, textscan as ts

#: Bytes of benchmark text whose windows are broadcast.
MAX_BROADCAST_BYTES = 32 << 20


class WindowSet:
    """The windows of a benchmark: by length, sorted hashes in one array, where each one's words stand in one text, and its items.

    Some 24 bytes a window and the text itself; it is made once, on the driver, and broadcast as it is.
    """

    def __init__(self, ids: list[str], texts: list[str | None], n: int):
        self.n, self.ids = n, ids
        said, at = [], 0
        found: dict[int, list[tuple[np.ndarray, ...]]] = {}
        for row, buf, offsets in ts.slabs(pa.array(texts, pa.string())):
            w = ts.words(buf, offsets, ts.ALNUM, lower=True)
            said.append(joined(w, 0, len(w.start)) + b" ")
            end = at + np.cumsum(w.end - w.start + 1) - 1
            begin = end - (w.end - w.start)
            at += len(said[-1])
            for k in range(w.docs):
                a, b = int(w.first[k]), int(w.first[k + 1])
                if a == b:
                    continue
                size = min(n, b - a)
                hashes, _ = ts.window_hashes(w.hash[a:b], w.doc[a:b], size)
                own = (hashes, begin[a : b - size + 1], end[a + size - 1 : b], np.full(len(hashes), row + k))
                found.setdefault(size, []).append(own)
        self.text = b"".join(said)
        self.by_size = {size: self._sorted(*(np.concatenate(c) for c in zip(*parts, strict=True))) for size, parts in sorted(found.items())}

    def _sorted(self, hashes: np.ndarray, begin: np.ndarray, end: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, ...]:
        """Distinct windows (hash, begin, end, where its items begin) in the order of their hashes, and all items."""
        order = np.lexsort((owner, hashes))
        hashes, begin, end, owner = hashes[order], begin[order], end[order], owner[order]
        words = lambda k: self.text[begin[k] : end[k]]
        again = np.flatnonzero(hashes[1:] == hashes[:-1]) + 1
        fresh = np.ones(len(hashes), bool)
        fresh[again] = [words(k) != words(k - 1) for k in again.tolist()]
        for h in np.unique(hashes[again[fresh[again]]]).tolist():  # different words of one hash: put together what is equal
            low, high = np.searchsorted(hashes, [h], "left")[0], np.searchsorted(hashes, [h], "right")[0]
            some = np.array(sorted(range(low, high), key=lambda k: (words(k), owner[k])))
            begin[low:high], end[low:high], owner[low:high] = begin[some], end[some], owner[some]
            fresh[low + 1 : high] = [words(k) != words(k - 1) for k in range(low + 1, high)]
        keep = fresh.copy()
        keep[1:] |= owner[1:] != owner[:-1]
        first = np.flatnonzero(fresh)
        starts = np.append(np.cumsum(keep)[first] - 1, keep.sum())
        return hashes[first], begin[first], end[first], starts, owner[keep].astype(np.int32)

    def scan(self, w: ts.Words) -> tuple[np.ndarray, list[set[int]]]:
        """Which words of a slab are hit, and the items whose windows occur in each document."""
        marks = np.zeros(len(w.hash) + 1, np.int64)
        items: list[set[int]] = [set() for _ in range(w.docs)]
        for size, (known, begin, end, starts, owners) in self.by_size.items():
            hashes, whole = w.windows(size)
            if not len(hashes):
                continue
            at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            for i in np.flatnonzero((known[at] == hashes) & whole).tolist():
                said, k = joined(w, i, size), at[i]
                while k < len(known) and known[k] == hashes[i]:
                    if self.text[begin[k] : end[k]] == said:  # verified word by word
                        marks[i] += 1
                        marks[i + size] -= 1
                        items[w.doc[i]].update(owners[starts[k] : starts[k + 1]].tolist())
                        break
                    k += 1
        return np.cumsum(marks[:-1]) > 0, items


def joined(w: ts.Words, i: int, size: int) -> bytes:
    return b" ".join([w.buf[s:e].tobytes() for s, e in zip(w.start[i : i + size], w.end[i : i + size], strict=True)])


def _items_digest(ids: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


def remove_spans(w: ts.Words, text: bytes, doc: int, hit: np.ndarray, offset: int) -> str:
    """A document's text without its hit words and what stands between two hit words that follow each other."""
    a, b = int(w.first[doc]), int(w.first[doc + 1])
    keep, last = [], 0
    flags = hit[a:b]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    for s, e in zip(edges[::2], edges[1::2], strict=True):
        keep.append(text[last : int(w.start[a + s]) - offset])
        last = int(w.end[a + e - 1]) - offset
    keep.append(text[last:])
    return b"".join(keep).decode()


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    n: int = 8,
    min_items: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    remove: str | None = None,
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """Per row of ``docs``: id, n_words, n_hit, n_items, items_sha256, contaminated (n_items >= min_items).

    With remove="spans", ``docs`` itself comes back with hit words cut out of contaminated texts; with
    remove="documents", without the contaminated rows.
    """
    spark = docs.sparkSession
    runtime.prepare(spark)
    bench = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = bench.agg(F.sum(F.octet_length("text") + F.octet_length("item_id"))).first()[0] or 0
    if size > max_broadcast_bytes:
        return _scan_by_join(docs, bench, n, min_items, id_col, text_col, remove)
    rows = bench.collect()  # at most max_broadcast_bytes
    found = spark.sparkContext.broadcast(WindowSet([r[0] for r in rows], [r[1] for r in rows], n))

    kind = docs.schema[id_col].dataType.simpleString()
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = found.value
        for batch in batches:
            counts: list[tuple[int, int, int, str]] = []
            for _, buf, offsets in ts.slabs(batch.column(1)):
                w = ts.words(buf, offsets, ts.ALNUM, lower=True)
                hit, items = known.scan(w)
                total, hits = np.diff(w.first), ts.per_doc(hit, w.doc, w.docs)
                for k, found_items in enumerate(items):
                    names = {known.ids[i] for i in found_items}
                    counts.append((int(total[k]), int(hits[k]), len(names), _items_digest(names)))
            columns = [list(c) for c in zip(*counts, strict=True)] or [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string()), pa.array([c >= min_items for c in columns[2]], pa.bool_())],
                names=[id_col, "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = found.value
        for batch in batches:
            place = batch.schema.get_field_index(text_col)
            column = batch.column(place)
            keep, changed = np.ones(batch.num_rows, bool), {}
            for row, buf, offsets in ts.slabs(column):
                w = ts.words(buf, offsets, ts.ALNUM, lower=True)
                hit, items = known.scan(w)
                for k, found_items in enumerate(items):
                    if len({known.ids[i] for i in found_items}) >= min_items:
                        keep[row + k] = False
                        raw = buf[offsets[k] : offsets[k + 1]].tobytes()
                        changed[row + k] = remove_spans(w, raw, k, hit, int(offsets[k])) if remove == "spans" else None
            if remove == "documents":
                yield batch.filter(pa.array(keep))
            elif changed:
                texts = column.to_pylist()
                for k, text in changed.items():
                    texts[k] = text
                columns = list(batch.columns)
                columns[place] = pa.array(texts, column.type)
                yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)
            else:
                yield batch

    if remove:
        return docs.mapInArrow(clean, docs.schema)
    schema = f"`{id_col}` {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    return docs.select(id_col, text_col).mapInArrow(measure, schema)


def _windows_of(df: DataFrame, key: str, text_col: str, sizes: list[int], short: bool, n: int) -> DataFrame:
    """(key, pos, size, said): every window as its words; with short, an item below n words is one window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for row, buf, offsets in ts.slabs(batch.column(1)):
                w = ts.words(buf, offsets, ts.ALNUM, lower=True)
                count = np.diff(w.first)
                for size in range(1, n + 1) if short else sizes:
                    hashes, whole = w.windows(size)
                    at = np.flatnonzero(whole)
                    if short and size < n:
                        at = at[count[w.doc[at]] == size]
                    if not len(at):
                        continue
                    yield pa.RecordBatch.from_arrays(
                        [
                            ids.take(pa.array(row + w.doc[at])),
                            pa.array(at - w.first[w.doc[at]], pa.int64()),
                            pa.array(np.full(len(at), size), pa.int32()),
                            pa.array([joined(w, int(i), size) for i in at], pa.binary()),
                        ],
                        names=[key, "pos", "size", "said"],
                    )

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text_col).mapInArrow(run, f"`{key}` {kind}, pos long, size int, said binary")


def _scan_by_join(docs: DataFrame, bench: DataFrame, n: int, min_items: int, id_col: str, text_col: str, remove: str | None) -> DataFrame:
    """The way beyond the broadcast limit: distinct windows of both sides meet in a shuffle."""
    key = runtime.fresh(docs, "row_key")
    docs = runtime.cut(docs.withColumn(key, F.monotonically_increasing_id()))
    wanted = runtime.cut(_windows_of(bench, "item_id", "text", [], True, n).select("item_id", "size", "said").distinct())
    sizes = [r[0] for r in wanted.select("size").distinct().collect()]  # at most n rows
    hits = _windows_of(docs, key, text_col, sizes, False, n).join(wanted.select("size", "said").distinct(), ["size", "said"], "left_semi")
    hits = runtime.cut(hits)
    # Which words are hit: positions of one row stay together, items are joined by the distinct window.
    spans = hits.select(key, F.explode(F.sequence("pos", F.col("pos") + F.col("size") - 1)).alias("word")).distinct()
    words_hit = spans.groupBy(key).agg(F.count("*").alias("n_hit"), F.sort_array(F.collect_list("word")).alias("hit_words"))
    items = hits.select(key, "size", "said").distinct().join(wanted, ["size", "said"]).select(key, "item_id").distinct()
    items = items.groupBy(key).agg(F.count("*").alias("n_items"), F.array_join(F.sort_array(F.collect_list("item_id")), ",").alias("names"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = [int(x) for _, buf, off in ts.slabs(batch.column(1)) for x in np.diff(ts.words(buf, off, ts.ALNUM, lower=True).first)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64())], names=[key, "n_words"])

    found = words_hit.join(items, key)
    if remove == "documents":
        return docs.join(found.where(F.col("n_items") >= min_items).select(key), key, "left_anti").drop(key)
    if remove == "spans":
        own = runtime.prefix(docs)
        dirty = found.where(F.col("n_items") >= min_items).select(F.col(key).alias(f"{own}key"), F.col("hit_words").alias(f"{own}hit_words"))
        names = docs.columns

        def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hit_words = batch.column(batch.num_columns - 1).to_pylist()
                place = batch.schema.get_field_index(text_col)
                texts = batch.column(place).to_pylist()
                for k, positions in enumerate(hit_words):
                    if positions is not None:
                        for _, buf, off in ts.slabs(pa.array([texts[k]], pa.string())):
                            w = ts.words(buf, off, ts.ALNUM, lower=True)
                            hit = np.zeros(len(w.hash), bool)
                            hit[positions] = True
                            texts[k] = remove_spans(w, buf.tobytes(), 0, hit, 0)
                columns = list(batch.columns)[: len(names)]
                columns[place] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays(columns, names=names)

        joined_docs = docs.join(dirty, F.col(key) == F.col(f"{own}key"), "left").select(*docs.columns, f"{own}hit_words")
        return joined_docs.mapInArrow(drop, docs.schema).drop(key)
    totals = docs.select(key, text_col).mapInArrow(count, f"`{key}` long, n_words long")
    out = docs.select(key, id_col).join(totals, key).join(found, key, "left")
    return out.select(
        id_col,
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce("names", F.lit("")), 256).alias("items_sha256"),
        (F.coalesce("n_items", F.lit(0)) >= min_items).alias("contaminated"),
    )
