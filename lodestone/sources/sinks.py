"""Where results go: lines to a stream or a file of the driver, or text and JSON folders that the executors write."""

from __future__ import annotations

from itertools import batched
from typing import TextIO

from pyspark.sql import DataFrame

LINES = 8192


def to_stream(lines: DataFrame, *outs: TextIO) -> int:
    """The first column as lines, a partition at a time on the driver; returns how many."""
    n = 0
    for chunk in batched(lines.toLocalIterator(prefetchPartitions=True), LINES):
        text = "\n".join(r[0] for r in chunk) + "\n"
        n += len(chunk)
        for out in outs:
            out.write(text)
    return n


def to_file(lines: DataFrame, path: str) -> int:
    """One file of the driver, with LF; what UTF-8 can't hold becomes a question mark."""
    with open(path, "w", encoding="utf-8", errors="replace", newline="\n") as out:
        return to_stream(lines, out)


def to_text(lines: DataFrame, path: str) -> None:
    """A folder of text files, for results that are too large for the driver."""
    lines.write.mode("overwrite").text(path)


def to_json(rows: DataFrame, path: str) -> None:
    """A folder of JSON lines, nulls included."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
