"""URL filter: all glob rules at once by a bit-parallel automaton.

Rules become the bits of multiword Shift-And masks: a bit per character of a pattern, ``*`` as a self-loop on
the bit before it, ``?`` as a bit that every character sets. One pass over a URL's characters, for a batch
of URLs at a time, moves the states of all patterns together.

The canonical URL is ``.host`` + NUL + ``path`` (host in lower case, without query and fragment). A domain rule
``example.com/en/`` is the glob ``*.example.com`` NUL ``/en/*``, so it fits the host, its subdomains, and paths
that start so. Of the domain rules that match, the longest wins; without one, block globs decide, else allow.

Defined results: a null URL, or one without ``://``, has an empty host and path and fits no domain rule.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import runtime

DOMAIN_RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
#: Over the canonical URL, for pages that no domain rule decides.
BLOCK_GLOBS = ("*spam*\0*", "*.cheap-*\0*", "*casino*\0*", "*pills*\0*", "*\0*/ads/*", "*\0*.exe", "*\0*/wp-login*")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def domain_glob(rule: str) -> str:
    host, slash, path = rule.partition("/")
    return f"*.{host}\0{slash}{path}*"


class ShiftAnd:
    """Masks of all patterns; ``match`` gives a boolean for each text and pattern."""

    def __init__(self, globs: Sequence[str]):
        start, every, loop, last, steps = [], [], [], [], []
        self.empty, self.trailing = [], []
        for glob in globs:
            begin, floating = len(steps), False
            for c in glob.encode():
                if c == ord("*"):
                    if len(steps) > begin:
                        loop[-1] = True
                    else:
                        floating = True
                    continue
                steps.append(None if c == ord("?") else c)
                start.append(len(steps) - 1 == begin)
                every.append(start[-1] and floating)
                loop.append(False)
            last.append(len(steps) - 1 if len(steps) > begin else -1)
            self.empty.append(len(steps) == begin and floating)
        self.words = max(1, -(-len(steps) // 64))
        self.start, self.every, self.loop = self._pack(start), self._pack(every), self._pack(loop)
        self.mask = np.stack([self._pack([s is None or s == c for s in steps]) for c in range(256)])
        self.last = np.array(last, np.int64)

    def _pack(self, bits: list[bool]) -> np.ndarray:
        out = np.zeros(self.words * 64, np.uint8)
        out[: len(bits)] = bits
        return np.packbits(out, bitorder="little").view("<u8")

    def match(self, texts: Sequence[bytes]) -> np.ndarray:
        n = len(texts)
        size = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-size, kind="stable")
        state = np.zeros((n, self.words), np.uint64)
        flat = np.frombuffer(b"".join(texts), np.uint8)
        begin = (np.cumsum(size) - size)[order]
        size = size[order]
        longest = int(size[0]) if n else 0
        alive = n
        for at in range(longest):
            while size[alive - 1] <= at:
                alive -= 1
            d = state[:alive]
            shifted = d << np.uint64(1)
            shifted[:, 1:] |= d[:, :-1] >> np.uint64(63)
            shifted = (shifted & ~self.start) | (self.start if at == 0 else self.every)
            state[:alive] = (shifted & self.mask[flat[begin[:alive] + at]]) | (d & self.loop)
        hit = np.zeros((n, len(self.last)), bool)
        for k, bit in enumerate(self.last):
            hit[order, k] = self.empty[k] if bit < 0 else (state[:, bit >> 6] >> np.uint64(bit & 63) & np.uint64(1)).astype(bool)
        return hit


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def judge(df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str]] = DOMAIN_RULES, block_globs: Sequence[str] = BLOCK_GLOBS) -> DataFrame:
    """Per row: id, host, path, rule (null if no domain rule fits), verdict."""
    runtime.prepare(df.sparkSession)
    rules = sorted(rules, key=lambda r: -len(r[0]))
    globs = [domain_glob(r) for r, _ in rules] + list(block_globs)
    machine = ShiftAnd(globs)
    host, path = host_and_path(F.col(url_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            texts = [b"." + h.encode().replace(b"\0", b"\1") + b"\0" + p.encode().replace(b"\0", b"\1") for h, p in zip(hosts, paths, strict=True)]
            hit = machine.match(texts)
            domain = hit[:, : len(rules)]
            found = domain.any(axis=1) if len(rules) else np.zeros(len(texts), bool)
            which = domain.argmax(axis=1) if len(rules) else np.zeros(len(texts), int)
            blocked = hit[:, len(rules) :].any(axis=1)
            rule = [rules[w][0] if f else None for w, f in zip(which, found, strict=True)]
            verdict = [rules[w][1] if f else "block" if b else "allow" for w, f, b in zip(which, found, blocked, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=[id_col, "host", "path", "rule", "verdict"])

    kind = df.schema[id_col].dataType.simpleString()
    picked = df.select(F.col(id_col), host.alias("host"), path.alias("path"))
    return picked.mapInArrow(run, f"`{id_col}` {kind}, host string, path string, rule string, verdict string")


SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), r AS (
  SELECT *, CASE
      WHEN ends_with('.' || host, '.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
      WHEN ends_with('.' || host, '.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
      WHEN ends_with('.' || host, '.net') AND starts_with(path, '/es/') THEN 'net/es/'
      WHEN ends_with('.' || host, '.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
      WHEN ends_with('.' || host, '.com') AND starts_with(path, '/') THEN 'com/' END AS rule FROM p
)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow'
    WHEN rule IS NOT NULL THEN 'block'
    WHEN contains(host, 'spam') OR contains(host, 'casino') OR contains(host, 'pills') OR contains('.' || host, '.cheap-')
      OR contains(path, '/ads/') OR ends_with(path, '.exe') OR contains(path, '/wp-login') THEN 'block'
    ELSE 'allow' END AS verdict
FROM r
"""
