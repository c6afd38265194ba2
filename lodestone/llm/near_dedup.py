"""Near-duplicate links by a chosen-path set similarity join.

A document's set is its distinct shingles of five words. Documents of equal sets are one *text*, stood for by
its smallest doc_id. Texts get K minwise values. In each of ``trees`` independent trees, a node chooses one or
two of the K positions (1 / threshold on average, by a hash of the node) and sends each of its texts to a child
for the value at each chosen position, so that a pair at the threshold survives a level with one common child on
average. STRIDE levels are branched at once, from a text's own values alone. Then the nodes' members are brought together
in sorted runs, once, with a byte of each minwise value: a node of at most LEAF texts is compared exhaustively on these,
a larger one branches on, and one that is still large at the last level is handed over whole.

What comes out of a node is a *group*: the texts that have a partner in it whose values allow the threshold, named after the
one of them that comes first in one order of all texts. The trees' groups of the same name are united, so that a cluster which meets in
most nodes of most trees makes few groups. Groups are compared on their full sets, computed again from the whole texts, in
cells of bounded size: first a group's chunks, its first text in each of them, which joins up the large clusters; then, in groups
that are still of several components, every chunk of the largest component with every block of the others, and those blocks with each
other, so that nothing is left out. Trees are taken in two batches; the second leaves out whatever the first has joined.

Recall: a pair at exactly the threshold has Binomial(K, threshold) equal minwise values, the same ones in all trees.
``miss`` is the chance that it meets in no tree down to the last level, or that its values don't allow the threshold
(candidates need an estimate above threshold - 5 standard deviations), averaged over that number; ``trees_for`` takes as
many trees as bring it to 1 - recall at most. For a recall of 0.9999 that is 13 trees at 0.85 (a miss of 6.8e-5) and
15 at 0.80 (9.3e-5). Pairs that are more similar, or that meet in a small node earlier, are missed more seldom.

Sizes: a node of more than HOT_TEXTS texts (and of more than a HOT_NODES-th of a level's rows, so that no more than HOT_NODES
nodes can be listed) is dealt to several tasks; it branches there, which needs no other row. Long nodes and cells stream through
a task in Arrow batches.

Defined results: a text without words has the empty set, links with nothing and stays. A null doc_id takes
part in no link, has a null component and stays. Rows that repeat a doc_id share their component. An empty table gives an empty
result. Very long texts count whole; a text above BLOCK_SHINGLES shingles has a block of its own on average. Equal
similarities need no order: links are all taken.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import runtime, textscan as ts
from .components import connected_components

SHINGLE = 5
K = 64
LEAF = 64
#: Levels of a tree, and those that are branched at once.
LEVELS, STRIDE = 4, 2
#: Trees of the first batch.
FIRST = 4
#: Texts, and shingles, of a block of a group.
BLOCK_TEXTS, BLOCK_SHINGLES = 1024, 1 << 18
#: From how many texts a node is dealt to several tasks, and how many such nodes there can be.
HOT_TEXTS, HOT_NODES = 4096, 100_000
#: Rows of sorted nodes that are compared at a time.
CHUNK = 1 << 13
RECALL = 0.9999
_rng = np.random.default_rng(77001)
_XOR = _rng.integers(0, 1 << 63, K, dtype=np.uint64)
_MUL = _rng.integers(1, 1 << 62, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def allowed(threshold: float) -> float:
    """How many equal minwise values a candidate needs."""
    return K * (threshold - 5 * sqrt(threshold * (1 - threshold) / K))


def survival(threshold: float, level: int, same: float) -> float:
    """Chance that a pair with this share of equal minwise values has a common node at a level of one tree."""
    two, lost = 1 / threshold - 1, 0.0
    for _ in range(level):
        x = 1 - same + same * lost
        lost = (1 - two) * x + two * x * x
    return 1 - lost


def miss(threshold: float, trees: int, level: int = LEVELS) -> float:
    """Chance that a pair at the threshold is no candidate in any tree, where nodes are compared at that level."""
    total = 0.0
    for n in range(K + 1):
        chance = comb(K, n) * threshold**n * (1 - threshold) ** (K - n)
        total += chance * ((1 - survival(threshold, level, n / K)) ** trees if n >= allowed(threshold) else 1.0)
    return total


def trees_for(threshold: float, recall: float) -> int:
    """The fewest trees with that recall at the threshold, though all nodes stay large down to the last level."""
    if miss(threshold, 1 << 20) > 1 - recall:
        raise ValueError(f"a recall of {recall} can't be reached with {K} minwise values")
    trees = 1
    while miss(threshold, trees) > 1 - recall:
        trees += 1
    return trees


def shingle_sets(w: ts.Words) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of a slab's documents, one after another, and where each begins."""
    count = np.diff(w.first)
    hashes, whole = w.windows(SHINGLE)
    doc = w.doc[: len(hashes)][whole]
    hashes = hashes[whole]
    begin = np.searchsorted(doc, np.arange(w.docs + 1))
    sets = []
    for k in range(w.docs):
        if count[k] >= SHINGLE:
            sets.append(np.unique(hashes[begin[k] : begin[k + 1]]))
        elif count[k]:
            a, b = w.first[k], w.first[k + 1]
            sets.append(ts.window_hashes(w.hash[a:b], w.doc[a:b], int(b - a))[0])
        else:
            sets.append(np.zeros(0, np.uint64))
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)


def minwise(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """K minwise values (uint32) of each set; all ones for an empty set."""
    out = np.full((len(begin) - 1, K), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(np.diff(begin))
    if len(full):
        for k in range(K):
            out[full, k] = np.minimum.reduceat(((values ^ _XOR[k]) * _MUL[k]) >> np.uint64(32), begin[full]).astype(np.uint32)
    return out


def _binary(matrix: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values."""
    rows, width = len(matrix), matrix.shape[1] * matrix.itemsize
    offsets = np.arange(0, (rows + 1) * width, width, dtype=np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), rows, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(matrix))])


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    """Binary values of equal length as the rows of a matrix."""
    if not len(column):
        return np.zeros((0, K), kind)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(kind).reshape(len(column), K)


def sketch(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, digest of the set, sig: K unsigned 32-bit integers)."""
    runtime.prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, buf, offsets in ts.slabs(batch.column(1)):
                values, begin = shingle_sets(ts.words(buf, offsets, ts.SPACE, lower=True))
                n = len(begin) - 1
                digest = [hashlib.blake2b(values[begin[k] : begin[k + 1]].tobytes(), digest_size=16).digest() for k in range(n)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, n), pa.array(np.diff(begin)), pa.array(digest, pa.binary()), _binary(minwise(values, begin))], names=["doc_id", "n_shingles", "digest", "sig"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("doc_id"), text_col).mapInArrow(run, f"doc_id {kind}, n_shingles long, digest binary, sig binary")


def _mix(*parts: np.ndarray | int) -> np.ndarray:
    """A 64-bit hash of some columns."""
    out = np.array([0x51ED270B35A4F3C7], np.uint64)
    for x in parts:
        out = ts.mix(out * ts.U(0xD1342543DE82EF95) + (x if isinstance(x, np.ndarray) else ts.U(x)))
    return out


def _branch(node: np.ndarray, row: np.ndarray, sig: np.ndarray, level: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The nodes STRIDE levels below those of some rows, and whose they are. Chosen positions follow from the node alone."""
    for at in range(level, level + STRIDE):
        h = _mix(node, at)
        first = h % ts.U(K)
        second = (first + ts.U(1) + (h >> ts.U(8)) % ts.U(K - 1)) % ts.U(K)
        twice = (h >> ts.U(24)) % ts.U(10_000) < int(10_000 * (1 / threshold - 1))
        node, position, row = np.concatenate([node, node[twice]]), np.concatenate([first, second[twice]]), np.concatenate([row, row[twice]])
        node = _mix(node, position, sig[row, position.astype(np.int64)].astype(np.uint64))
    return node, row


def _members(texts: DataFrame, trees: range, level: int, threshold: float, hot: tuple[np.ndarray, np.ndarray] | None) -> DataFrame:
    """Texts at the nodes STRIDE levels below the roots of trees, or below their column ``node``.

    Without ``hot``, only the column node. With it, (node, salt, rep, n_shingles, label, sig: K bytes); salt is -1 but for hot nodes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig, rows = _matrix(batch.column(3), np.uint32), np.arange(batch.num_rows)
            if level:
                node, row = np.asarray(batch.column(4)).view(np.uint64), rows
            else:
                node, row = np.repeat(_mix(np.array(trees, np.uint64)), len(rows)), np.tile(rows, len(trees))
            node, row = _branch(node, row, sig, level, threshold)
            if hot is None:
                yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64))], names=["node"])
                continue
            rep = np.asarray(batch.column(0))[row]
            salt = np.full(len(node), -1)
            if len(hot[0]):
                at = np.minimum(np.searchsorted(hot[0], node), len(hot[0]) - 1)
                some = np.flatnonzero(hot[0][at] == node)
                salt[some] = _mix(rep[some].view(np.uint64), 5) % hot[1][at[some]]
            columns = [pa.array(node.view(np.int64)), pa.array(salt), pa.array(rep), batch.column(1).take(pa.array(row)), batch.column(2).take(pa.array(row)), _binary(sig.astype(np.uint8)[row])]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "salt", "rep", "n_shingles", "label", "sig"])

    columns = ["rep", "n_shingles", "label", "sig", *(["node"] if level else [])]
    return texts.select(*columns).mapInArrow(run, "node long" if hot is None else "node long, salt long, rep long, n_shingles long, label long, sig binary")


def _hot(nodes: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The nodes that are dealt to several tasks, in order, and to how many each. There are HOT_NODES at most, as each has more
    than a HOT_NODES-th of all the rows that are counted here."""
    large = runtime.cut(nodes.groupBy("node").count().where(F.col("count") > HOT_TEXTS))
    total = large.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    least = max(HOT_TEXTS, total // HOT_NODES)
    found = sorted((r[0] % (1 << 64), -(-r[1] // least)) for r in large.where(F.col("count") > least).collect())
    return np.array([n for n, _ in found], np.uint64), np.array([k for _, k in found], np.uint64)


def _compare(members: DataFrame, threshold: float, last: bool) -> DataFrame:
    """What comes out of nodes: (g, rep, n_shingles, label, large).

    large: a text of a node that branches on, g is the node. Otherwise a member of a group, g is its first text, or
    the node where a node that was dealt to several tasks is handed over whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = _Runs(threshold, last)
        kept, rows = [], 0
        for batch in batches:
            kept.append(batch)
            rows += batch.num_rows
            if rows >= CHUNK:
                yield from state.take(pa.Table.from_batches(kept).combine_chunks().to_batches()[0], False)
                kept, rows = [], 0
        if rows:
            kept = pa.Table.from_batches(kept).combine_chunks().to_batches()
        yield from state.take(kept[0] if kept else None, True)

    # The order of a node's texts is the same wherever they meet, so that their groups get the same names.
    dealt = members.repartition("node", "salt").sortWithinPartitions("node", "salt", F.xxhash64("rep"), "rep")
    return dealt.mapInArrow(run, "g long, rep long, n_shingles long, label long, large boolean")


class _Runs:
    """Sorted nodes as they stream by."""

    def __init__(self, threshold: float, last: bool):
        self.threshold, self.last = threshold, last
        self.cut = allowed(threshold)
        self.rest: tuple[np.ndarray, ...] | None = None
        self.open: tuple[int, int, int] | None = None  # node, salt and first text of a large node that goes on

    def take(self, batch: pa.RecordBatch | None, final: bool) -> Iterator[pa.RecordBatch]:
        rows = None
        if batch is not None:
            rows = (*(np.asarray(batch.column(k)) for k in range(5)), _matrix(batch.column(5), np.uint8))
        if self.rest is not None:
            rows = self.rest if rows is None else tuple(np.concatenate(x) for x in zip(self.rest, rows, strict=True))
            self.rest = None
        if rows is None or not len(rows[0]):
            return
        node, salt, rep, n, label, sig = rows
        begin = np.flatnonzero(np.concatenate([[True], (node[1:] != node[:-1]) | (salt[1:] != salt[:-1])]))
        length = np.diff(np.append(begin, len(node)))
        first = rep[begin]
        large = (length > LEAF) | (salt[begin] >= 0)
        if self.open is not None and self.open[:2] == (node[0], salt[0]):
            large[0], first[0] = True, self.open[2]
        self.open = None
        stop = len(node)
        if not final:
            if large[-1]:
                self.open = (node[-1], salt[-1], first[-1])
            else:  # more of it may follow
                stop = begin[-1]
                self.rest = tuple(x[stop:] for x in rows)
        of = np.repeat(np.arange(len(begin)), length)[:stop]
        big = np.flatnonzero(large[of])
        if len(big):
            g = np.where(salt[big] >= 0, node[big], first[of[big]]) if self.last else node[big]
            yield self._out(g, big, rep, n, label, not self.last)
        small = np.flatnonzero(~large[of] & (length[of] > 1))
        if len(small):
            run = of[small]
            partner = self._partners(run, n[small], label[small], sig[small])
            small, run = small[partner], run[partner]
            if len(small):
                starts = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
                g = np.repeat(rep[small[starts]], np.diff(np.append(starts, len(run))))
                yield self._out(g, small, rep, n, label, False)

    def _partners(self, run: np.ndarray, n: np.ndarray, label: np.ndarray, sig: np.ndarray) -> np.ndarray:
        """Which rows have another of their run whose size and minwise values allow the threshold, under another label."""
        out = np.zeros(len(run), bool)
        low = np.arange(len(run))
        for d in range(1, LEAF):
            low = low[low + d < len(run)]
            low = low[run[low] == run[low + d]]
            if not len(low):
                break
            high = low + d
            fits = (label[low] != label[high]) & (np.minimum(n[low], n[high]) >= self.threshold * np.maximum(n[low], n[high]) - 1e-9)
            a, b = low[fits], high[fits]
            near = (sig[a] == sig[b]).sum(axis=1) >= self.cut
            out[a[near]] = out[b[near]] = True
        return out

    @staticmethod
    def _out(g: np.ndarray, at: np.ndarray, rep: np.ndarray, n: np.ndarray, label: np.ndarray, large: bool) -> pa.RecordBatch:
        columns = [pa.array(x) for x in (g, rep[at], n[at], label[at], np.full(len(at), large))]
        return pa.RecordBatch.from_arrays(columns, names=["g", "rep", "n_shingles", "label", "large"])


def _links(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Each set that is linked with another, and the first of its component. All intersections are counted, by shingle."""
    m, size = len(sets), np.array([len(s) for s in sets])
    values, owner = np.concatenate(sets), np.repeat(np.arange(m), size)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    begin = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    times = np.diff(np.append(begin, len(values)))
    of = np.repeat(np.arange(len(begin)), times)
    both = np.zeros((m, m), np.float32)
    frequent = times > 32
    rare = np.flatnonzero(~frequent[of] & (times[of] > 1))
    low, pairs = rare, [np.zeros(0, np.int64)]
    for d in range(1, 32):
        low = low[low + d < len(of)]
        low = low[of[low] == of[low + d]]
        if not len(low):
            break
        pairs.append(owner[low] * m + owner[low + d])
    both += np.bincount(np.concatenate(pairs), minlength=m * m).reshape(m, m)
    common = np.flatnonzero(frequent)
    for k in range(0, len(common), 2048):
        some = common[k : k + 2048]
        stands = np.zeros((m, len(some)), np.float32)
        for c, v in enumerate(some):
            stands[owner[begin[v] : begin[v] + times[v]], c] = 1
        both += stands @ stands.T
    near = np.triu(100 * both >= percent * (size[:, None] + size - both), 1)
    near |= near.T
    found, seen = [], np.zeros(m, bool)
    for i in np.flatnonzero(near.any(axis=1)):
        if seen[i]:
            continue
        seen[i] = True
        front = np.array([i])
        while len(front):
            front = np.flatnonzero(near[front].any(axis=0) & ~seen)
            seen[front] = True
            found += [(int(i), int(j)) for j in front]
    return found


def _exact(cells: DataFrame, percent: int) -> DataFrame:
    """(u, v): labels that links within cells join. cells: (cell, label, text); a cell's texts stream through one task."""

    def links(label: list[int], sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        found = _links(sets, percent) if len(sets) > 1 else []
        found = [(label[i], label[j]) for i, j in found if label[i] != label[j]]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, label, sets = None, [], []
        for batch in batches:
            own = _sets(batch.column(2))
            for cell, x, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), own, strict=True):
                if cell != now:
                    yield from links(label, sets)
                    now, label, sets = cell, [], []
                label.append(x)
                sets.append(s)
        yield from links(label, sets)

    return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "u long, v long")


class _Join:
    """State of one run."""

    def __init__(self, df: DataFrame, threshold: int, recall: float, id_col: str, text_col: str):
        self.spark = df.sparkSession
        self.percent, self.threshold = threshold, threshold / 100
        self.trees = trees_for(self.threshold, recall)
        self.docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        self.sketches = runtime.cut(sketch(self.docs))
        real = self.sketches.where("n_shingles > 0 AND doc_id IS NOT NULL")
        # Texts that an id shares with another of its rows are linked through the id itself.
        self.texts = runtime.cut(real.groupBy("digest", "n_shingles", "sig").agg(F.min("doc_id").alias("rep")))
        self.edges = real.select("doc_id", "digest").join(self.texts.select("digest", "rep").hint("merge"), "digest").where("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
        twice = runtime.cut(real.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("digest").alias("x"), F.max("digest").alias("y")).where("n > 1"))
        self.repeats = not twice.isEmpty()
        if twice.where("x <> y").isEmpty():
            self.edges = None
        self.labels: DataFrame | None = None

    def label_of(self, df: DataFrame, column: str, name: str) -> DataFrame:
        if self.labels is None:
            return df.withColumn(name, F.col(column))
        found = self.labels.select(F.col("v").alias("_v"), F.col("component").alias("_c"))
        return df.join(found.hint("merge"), F.col(column) == F.col("_v"), "left").withColumn(name, F.coalesce("_c", column)).drop("_v", "_c")

    def texts_of(self, ids: DataFrame) -> DataFrame:
        """(id, text) of the wanted ids (id)."""
        # The bitmap keeps the texts that aren't asked for out of the shuffle.
        docs = self.docs.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("id"), "text")
        docs, likely = runtime.marked(docs, F.col("id"), runtime.bitmap(ids, "id"))
        once = docs.where(likely).select("id", "text")
        if self.repeats and self.edges is None:  # the same set whichever row is taken
            once = once.dropDuplicates(["id"])
        if self.edges is not None:  # an id may have several texts: the one that stands for its pair's text is meant
            own = self.sketches.select(F.col("doc_id").alias("id"), "digest").join(self.texts.select("digest", F.col("rep").alias("id")), ["digest", "id"])
            once = _with_digest(once).join(own, ["id", "digest"], "left_semi").dropDuplicates(["id"]).drop("digest")
        return once

    def merge(self, links: DataFrame) -> None:
        """Components of the components so far (u, v: labels): a graph of what is new only."""
        merged = runtime.cut(connected_components(links))
        if self.labels is None:
            self.labels = merged
        else:
            to = merged.select(F.col("v").alias("_v"), F.col("component").alias("_c"))
            moved = self.labels.join(to.hint("merge"), F.col("component") == F.col("_v"), "left").select("v", F.coalesce("_c", "component").alias("component"))
            fresh = merged.join(self.labels.select("v").hint("merge"), "v", "left_anti")
            self.labels = runtime.cut(moved.union(fresh))
        runtime.tidy(self.spark)

    def run(self) -> DataFrame:
        for trees in (range(min(FIRST, self.trees)), range(min(FIRST, self.trees), self.trees)):
            if len(trees):
                self.batch(trees)
        return self.result()

    def batch(self, trees: range) -> None:
        """Link what meets in some trees."""
        texts = self.label_of(self.texts.select("rep", "n_shingles", "sig"), "rep", "label")
        texts = texts if self.labels is None else runtime.cut(texts)
        found, at = None, texts
        for level in range(0, LEVELS, STRIDE):
            hot = _hot(_members(at, trees, level, self.threshold, None))
            out = runtime.cut(_compare(_members(at, trees, level, self.threshold, hot), self.threshold, level + STRIDE == LEVELS))
            some = out.where(~F.col("large")).drop("large")
            found = some if found is None else found.union(some)
            large = out.where("large").select(F.col("g").alias("node"), "rep", "label")
            if self.labels is not None:  # a node whose texts are all in one component has nothing more to tell
                large = large.join(_mixed(large, "node").hint("merge"), "node", "left_semi")
            if large.isEmpty():
                break
            at = large.select("node", "rep").join(texts.hint("merge"), "rep")
        members = runtime.cut(found.distinct())
        self.chunks(members)
        self.blocks(members)
        runtime.tidy(self.spark)

    def compare(self, cells: DataFrame) -> None:
        """Link what cells (cell, rep, label) hold."""
        cells = runtime.cut(cells)
        texts = self.texts_of(cells.select(F.col("rep").alias("id")))
        listed = cells.join(texts.hint("merge"), F.col("rep") == F.col("id")).select("cell", "label", "text")
        links = runtime.cut(_exact(listed, self.percent))
        if not links.isEmpty():
            self.merge(links)

    def chunks(self, members: DataFrame) -> None:
        """Compare the texts of a group's chunks, and the group's first text with all."""
        sizes = members.groupBy("g").agg(_blocks_of("n_shingles").alias("chunks"), F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("g", "chunks")
        own = F.pmod(F.xxhash64("rep", F.lit(3)), F.col("chunks")).cast("int")
        every = F.when(F.col("g") == F.col("rep"), F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array(own))
        cells = members.join(sizes.hint("merge"), "g").select("g", "rep", "label", F.explode(every).alias("chunk"))
        self.compare(cells.select(F.xxhash64("g", "chunk").alias("cell"), "rep", "label"))

    def blocks(self, members: DataFrame) -> None:
        """In groups of several chunks that aren't one component yet: compare what lies in different chunks."""
        sizes = members.groupBy("g").agg(_blocks_of("n_shingles").alias("chunks")).where("chunks > 1").select("g")
        large = members.drop("label").join(sizes.hint("merge"), "g", "left_semi")
        if large.isEmpty():
            return
        large = self.label_of(large, "rep", "label")
        large = runtime.cut(large.join(_mixed(large, "g").hint("merge"), "g", "left_semi"))
        if large.isEmpty():
            return
        counts = large.groupBy("g", "label").count()
        most = counts.groupBy("g").agg(F.max_by("label", F.struct("count", "label")).alias("most"))
        sided = large.join(most.hint("merge"), "g").withColumn("wide", F.col("label") == F.col("most"))
        dealt = sided.groupBy("g", "wide").agg(_blocks_of("n_shingles").alias("blocks"))
        both = dealt.groupBy("g").agg(*(F.coalesce(F.max(F.when(F.col("wide") == side, F.col("blocks"))), F.lit(0)).alias(name) for name, side in (("wides", True), ("narrows", False))))
        sided = sided.join(both.hint("merge"), "g")
        own = F.pmod(F.xxhash64("rep", F.lit(4)), F.when(F.col("wide"), F.col("wides")).otherwise(F.col("narrows"))).cast("int")
        upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        cross = F.when(F.col("wide"), F.transform(upto(F.col("narrows")), lambda k: F.struct(k.alias("a"), F.lit(1).alias("kind"), own.alias("b"))))
        cross = cross.otherwise(
            F.concat(
                F.transform(upto(F.col("wides")), lambda k: F.struct(own.alias("a"), F.lit(1).alias("kind"), k.alias("b"))),
                F.transform(upto(F.col("narrows")), lambda k: F.struct(F.least(own, k).alias("a"), F.lit(2).alias("kind"), F.greatest(own, k).alias("b"))),
            )
        )
        cells = sided.select("g", "rep", "label", F.explode(cross).alias("c"))
        self.compare(cells.select(F.xxhash64("g", "c.a", "c.kind", "c.b").alias("cell"), "rep", "label"))

    def result(self) -> DataFrame:
        """Per row: doc_id, n_shingles, component_id, kept."""
        if self.edges is not None:
            links = self.edges if self.labels is None else self.edges.union(self.labels.select(F.col("v").alias("u"), F.col("component").alias("v")))
            self.labels = runtime.cut(connected_components(links))
        named = self.label_of(self.texts.select("digest", "rep"), "rep", "component").select("digest", "component")
        out = self.sketches.select("doc_id", "n_shingles", "digest").join(named.hint("merge"), "digest", "left")
        component = F.when(F.col("doc_id").isNull(), F.lit(None)).when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component"))
        out = out.select("doc_id", "n_shingles", component.alias("component_id"))
        return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _blocks_of(shingles: str) -> Column:
    """An aggregate: how many blocks of bounded size a group's texts make."""
    return F.greatest(F.ceil(F.count("*") / BLOCK_TEXTS), F.ceil(F.sum(shingles) / BLOCK_SHINGLES)).cast("int")


def _mixed(df: DataFrame, key: str) -> DataFrame:
    """The keys under which there is more than one label."""
    return df.groupBy(key).agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select(key)


def _sets(column: pa.Array) -> list[np.ndarray]:
    out = []
    for _, buf, offsets in ts.slabs(column):
        values, begin = shingle_sets(ts.words(buf, offsets, ts.SPACE, lower=True))
        out += [values[begin[k] : begin[k + 1]] for k in range(len(begin) - 1)]
    return out


def _with_digest(df: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in _sets(batch.column(1))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digest, pa.binary())], names=["id", "text", "digest"])

    return df.mapInArrow(run, "id long, text string, digest binary")


def components(df: DataFrame, threshold: int = 85, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``df``: doc_id, n_shingles, component_id, kept. threshold: per cent of Jaccard similarity."""
    return _Join(df, threshold, recall, id_col, text_col).run()


def deduplicate(df: DataFrame, threshold: int = 80, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with one document of each component; its columns stay as they are."""
    out = components(df, threshold, recall, id_col, text_col)
    key = runtime.prefix(df) + "gone"
    gone = out.where(~F.col("kept")).select(F.col("doc_id").alias(key)).distinct()
    return df.join(gone, F.col(id_col) == F.col(key), "left_anti")
