"""Byte-level BPE encoding and decoding with padded numpy matrices.

Texts are cut into pieces by the tokenizer's pattern. Pieces that a worker hasn't met yet go, a batch at a
time, into matrices by length bucket (one row a piece, padded with -1). In each round every row merges its
leftmost pair of minimum rank; ranks of pairs come from an open-addressing hash table in numpy, and rows
are compacted as they shrink. A piece that is a token itself is that token. Pieces longer than the largest
bucket are merged as one array: all leftmost occurrences of the minimum pair in a round, as long as that
makes no pair of a lower rank, in which case the round merges the leftmost one only. So every piece gets
the ids that one merge at a time gives.

Defined results: a null or empty text has no tokens; any valid UTF-8 text of any length is encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import chain, filterfalse, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import runtime

BUCKETS = (4, 8, 16, 32, 64)
#: Chunks that one worker remembers; it starts anew beyond.
REMEMBERED = 600_000
#: Longer chunks aren't remembered beyond their batch.
LONG_CHUNK = 80
#: Rows of a matrix.
ROWS = 20_000
NONE = np.int32(2**31 - 1)
_CUT = re.compile(r" (?=\S)")
_WIDTH = [next(b for b in BUCKETS if n <= b) for n in range(BUCKETS[-1] + 1)]
_ODD_SPACE = re.compile(r" (?!\S)")


class PairTable:
    """(left id, right id) -> rank, linear probing over a power of two of slots."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(1, len(rank)) * 3))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.ranks = np.full(1 << bits, NONE, np.int32)
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        key, at = np.unique(key, return_index=True)
        rank = rank[at].astype(np.int32)
        slot, todo = self._slot(key), np.arange(len(key))
        while len(todo):
            free = todo[self.keys[slot[todo]] == -1]
            self.keys[slot[free]] = key[free]  # of several for a slot, the last one stays
            self.ranks[slot[free]] = rank[free]
            todo = todo[self.keys[slot[todo]] != key[todo]]
            slot[todo] = (slot[todo] + 1) & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; NONE where there is no merge. A negative id is padding."""
        shape = left.shape
        left, right = left.ravel().astype(np.int64), right.ravel().astype(np.int64)
        out = np.full(left.shape, NONE, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        key = left[todo] << 32 | right[todo]
        slot = self._slot(key)
        while len(todo):
            found = self.keys[slot]
            hit = found == key
            out[todo[hit]] = self.ranks[slot[hit]]
            go = ~hit & (found != -1)
            todo, key, slot = todo[go], key[go], (slot[go] + 1) & self.mask
        return out.reshape(shape)


class Vocabulary:
    """Ranks of a tiktoken file, its pair table, and the bytes of its tokens."""

    def __init__(self, path: str, pattern: str):
        self.pattern = regex.compile(pattern)
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        left, right, rank = [], [], []
        for token, r in self.rank.items():
            for k in range(1, len(token)):
                a, b = self.rank.get(token[:k]), self.rank.get(token[k:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), rank.append(r)
        self.pairs = PairTable(np.array(left, np.int64), np.array(right, np.int64), np.array(rank, np.int64))
        self.of_byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)
        size = max(self.rank.values()) + 1
        by_rank = [b""] * size
        for token, r in self.rank.items():
            by_rank[r] = token
        self.length = np.array([len(t) for t in by_rank], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        self.bytes = np.frombuffer(b"".join(by_rank), np.uint8)
        self.known: dict[str, bytes] = {}
        self.piece: dict[str, bytes] = {}

    # -- encoding -------------------------------------------------------------------------------

    def merge_rows(self, tokens: np.ndarray) -> np.ndarray:
        """Fully merged rows of a matrix of ids padded with -1 at the end."""
        out = np.full_like(tokens, -1)
        rows = np.arange(len(tokens))
        ranks = self.pairs(tokens[:, :-1], tokens[:, 1:]) if tokens.shape[1] > 1 else np.empty((len(tokens), 0), np.int32)
        while len(rows) and ranks.shape[1]:
            every = np.arange(len(rows))
            at = ranks.argmin(axis=1)  # the leftmost of the least
            best = ranks[every, at]
            done = best == NONE
            if done.any():
                out[rows[done], : tokens.shape[1]] = tokens[done]
                go = ~done
                rows, tokens, ranks, at, best = rows[go], tokens[go], ranks[go], at[go], best[go]
                if not len(rows):
                    return out
                every = np.arange(len(rows))
            tokens[every, at] = best
            columns = np.arange(tokens.shape[1] - 1)[None, :]
            tokens = np.take_along_axis(tokens, columns + (columns > at[:, None]), axis=1)
            ranks = np.take_along_axis(ranks, columns[:, :-1] + (columns[:, :-1] >= at[:, None]), axis=1)
            right = at < ranks.shape[1]  # only the pairs beside the merged one are new
            ranks[every[right], at[right]] = self.pairs(tokens[every[right], at[right]], tokens[every[right], at[right] + 1])
            left = at > 0
            ranks[every[left], at[left] - 1] = self.pairs(tokens[every[left], at[left] - 1], tokens[every[left], at[left]])
        if len(rows):
            out[rows, : tokens.shape[1]] = tokens
        return out

    def merge_long(self, piece: bytes) -> np.ndarray:
        """One long piece."""
        tokens = self.of_byte[np.frombuffer(piece, np.uint8)]
        while len(tokens) > 1:
            ranks = self.pairs(tokens[:-1], tokens[1:])
            best = ranks.min()
            if best == NONE:
                break
            hits = np.flatnonzero(ranks == best)
            runs = np.split(hits, np.flatnonzero(np.diff(hits) != 1) + 1)
            chosen = np.concatenate([run[::2] for run in runs])  # leftmost that don't overlap
            merged = self._apply(tokens, chosen, best)
            if len(chosen) > 1 and (self.pairs(merged[:-1], merged[1:]) < best).any():
                merged = self._apply(tokens, chosen[:1], best)
            tokens = merged
        return tokens

    @staticmethod
    def _apply(tokens: np.ndarray, at: np.ndarray, rank: np.int32) -> np.ndarray:
        tokens = tokens.copy()
        tokens[at] = rank
        return np.delete(tokens, at + 1)

    def ids_of(self, pieces: Iterable[str]) -> dict[str, bytes]:
        """Ids, as little-endian 32-bit bytes, of distinct pieces."""
        found: dict[str, bytes] = {}
        buckets: dict[int, tuple[list[str], list[bytes]]] = {b: ([], []) for b in BUCKETS}
        rank_of = self.rank.get
        for text in pieces:
            piece = text.encode()
            if (rank := rank_of(piece)) is not None:
                found[text] = rank.to_bytes(4, "little")
            elif len(piece) > BUCKETS[-1]:
                found[text] = self.merge_long(piece).astype("<u4").tobytes()
            else:
                names, members = buckets[_WIDTH[len(piece)]]
                names.append(text)
                members.append(piece)
        for width, (names, members) in buckets.items():
            for k in range(0, len(members), ROWS):
                some = members[k : k + ROWS]
                size = np.fromiter(map(len, some), np.int64, len(some))
                inside = np.arange(width)[None, :] < size[:, None]
                tokens = np.full((len(some), width), -1, np.int32)
                tokens[inside] = self.of_byte[np.frombuffer(b"".join(some), np.uint8)]
                merged = self.merge_rows(tokens)
                kept = merged >= 0
                ends = (np.cumsum(kept.sum(axis=1)) * 4).tolist()
                flat, begin = merged[kept].astype("<u4").tobytes(), 0
                for text, end in zip(names[k : k + ROWS], ends, strict=True):
                    found[text] = flat[begin:end]
                    begin = end
        return found

    def learn(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks: their pieces' ids in order."""
        cut = list(map(self.pattern.findall, chunks))
        pieces = set(chain.from_iterable(cut))
        if len(self.piece) > REMEMBERED:
            self.piece.clear()
        new = self.ids_of(filterfalse(self.piece.__contains__, pieces))
        self.piece |= new
        get = self.piece.__getitem__
        out = [get(x[0]) if len(x) == 1 else b"".join(map(get, x)) for x in cut]
        for p in new:
            if len(p) > LONG_CHUNK:
                del self.piece[p]
        return out

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers.

        A piece always ends before a space that a non-space follows. So texts are cut there into chunks, whose
        ids a worker remembers; the pattern runs over new chunks only.
        """
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        cut = [[] if not t else t.split(" ") if not _ODD_SPACE.search(t) else _CUT.split(t) for t in texts]
        heads = [parts[0] for parts in cut if parts]  # no space before these
        head = dict(zip(heads, self.learn(heads), strict=True))
        new: set[str] = set()
        for parts in cut:
            new.update(filterfalse(known.__contains__, islice(parts, 1, None)))
        order = list(new)
        known.update(zip(order, self.learn([f" {c}" for c in order]), strict=True))
        out = [b"".join([head[parts[0]], *map(known.__getitem__, islice(parts, 1, None))]) if parts else b"" for parts in cut]
        for c in order:
            if len(c) > LONG_CHUNK:
                del known[c]
        return out

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_batch([text])[0], "<u4").tolist()

    # -- decoding -------------------------------------------------------------------------------

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """Bytes of the tokens, gathered from one table."""
        if not len(ids):
            return b""
        size = self.length[ids]
        ends = np.cumsum(size)
        index = np.arange(ends[-1]) + np.repeat(self.begin[ids] - (ends - size), size)
        return self.bytes[index].tobytes()


_loaded: dict[tuple[str, str], Vocabulary] = {}


def vocabulary(path: str, pattern: str) -> Vocabulary:
    """A worker loads a vocabulary once."""
    key = (path, pattern)
    if key not in _loaded:
        _loaded[key] = Vocabulary(path, pattern)
    return _loaded[key]


def encode(df: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``df`` with an array<int> of ids of each text. The file's path must exist on the executors."""
    from pyspark.sql import types as T

    runtime.prepare(df.sparkSession)
    ids_col = runtime.fresh(df, ids_col)
    schema = T.StructType([*df.schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path, pattern)
        for batch in batches:
            found = vocab.encode_batch(batch.column(text_col).to_pylist())
            offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in found])]).astype(np.int32)
            flat = pa.array(np.frombuffer(b"".join(found), "<i4"))
            lists = pa.ListArray.from_arrays(pa.array(offsets), flat)
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, ids_col])

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, pattern: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """``df`` with the bytes of each array of ids (null: empty). An id out of the vocabulary is an error."""
    from pyspark.sql import types as T

    runtime.prepare(df.sparkSession)
    bytes_col = runtime.fresh(df, bytes_col)
    schema = T.StructType([*df.schema.fields, T.StructField(bytes_col, T.BinaryType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path, pattern)
        for batch in batches:
            found = [vocab.decode_bytes(np.array(ids or [], np.int64)) for ids in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], names=[*batch.schema.names, bytes_col])

    return df.mapInArrow(run, schema)


def digests(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: its id, n_tokens, the SHA-256 of its ids and of the bytes that they decode to.

    Encodes and decodes in one pass, so that id lists never leave the worker.
    """
    runtime.prepare(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path, pattern)
        for batch in batches:
            found = vocab.encode_batch(batch.column(1).to_pylist())
            decoded = [vocab.decode_bytes(np.frombuffer(x, "<u4").astype(np.int64)) for x in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(x) // 4 for x in found], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in found]),
                    pa.array([hashlib.sha256(x).hexdigest() for x in decoded]),
                ],
                names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return df.select(id_col, text_col).mapInArrow(run, schema)
