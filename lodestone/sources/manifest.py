"""File kinds by their first bytes, and binary XML (an archive's manifest) as XML text."""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import quoteattr

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

STRINGS, NAMESPACE, NAMESPACE_END, START, END, TEXT = 0x0001, 0x0100, 0x0101, 0x0102, 0x0103, 0x0104
#: Kinds by magic, in the order in which they are tried.
MAGIC = (("DEX", "6465780A"), ("DEY", "6465790A"), ("APK", "504B0304"), ("AXML", "03000800"), ("ARSC", "02000C00"))


def file_kind(content: Column) -> Column:
    """APK, DEX, DEY, AXML or ARSC; null for anything else."""
    out = F.lit(None).cast("string")
    for kind, magic in reversed(MAGIC):
        out = F.when(F.hex(F.substring(content, 1, 4)) == magic, kind).otherwise(out)
    return out


def _pool(data: bytes, at: int) -> list[str]:
    count, _, flags, begin = struct.unpack_from("<4I", data, at + 8)
    out = []
    for off in struct.unpack_from(f"<{count}I", data, at + 28):
        p = at + begin + off
        if flags & 0x100:  # UTF-8: characters, then bytes, each in one or two
            p += 2 if data[p] & 0x80 else 1
            size = data[p]
            if size & 0x80:
                size, p = (size & 0x7F) << 8 | data[p + 1], p + 1
            out.append(data[p + 1 : p + 1 + size].decode("utf-8", "replace"))
        else:
            size = struct.unpack_from("<H", data, p)[0]
            if size & 0x8000:
                size, p = (size & 0x7FFF) << 16 | struct.unpack_from("<H", data, p + 2)[0], p + 2
            out.append(data[p + 2 : p + 2 + 2 * size].decode("utf-16-le", "replace"))
    return out


def _value(kind: int, value: int, strings: list[str]) -> str:
    if kind == 0x03:
        return strings[value]
    if kind in (0x01, 0x02):
        return f"{'@' if kind == 1 else '?'}{value:08X}"
    if kind == 0x04:
        return repr(struct.unpack("<f", struct.pack("<I", value))[0])
    if kind in (0x05, 0x06):
        amount = ((value >> 8) ^ 0x800000) - 0x800000
        scale = (1, 1 / (1 << 7), 1 / (1 << 15), 1 / (1 << 23))[value >> 4 & 3]
        unit = ("px", "dip", "sp", "pt", "in", "mm")[value & 15] if kind == 5 and value & 15 < 6 else "%" if kind == 6 else ""
        return f"{amount * scale * (100 if kind == 6 else 1):g}{unit}"
    if kind == 0x12:
        return "true" if value else "false"
    if kind == 0x11:
        return f"0x{value:08X}"
    if 0x1C <= kind <= 0x1F:
        return f"#{value:08X}"
    return str((value ^ 0x80000000) - 0x80000000)


def xml(data: bytes) -> str:
    """Binary XML as text, an element a line; broken data raises ValueError."""
    if data[:4] != b"\x03\x00\x08\x00":
        raise ValueError("not binary XML")
    strings: list[str] = []
    prefixes: dict[str, str] = {}
    fresh: list[tuple[str, str]] = []
    lines, depth, at = ['<?xml version="1.0" encoding="utf-8"?>'], 0, 8
    try:
        while at + 8 <= len(data):
            kind, _, size = struct.unpack_from("<HHI", data, at)
            if size < 8:
                raise ValueError(f"a chunk without a size at {at}")
            if kind == STRINGS:
                strings = _pool(data, at)
            elif kind == NAMESPACE:
                prefix, uri = struct.unpack_from("<2I", data, at + 16)
                prefixes[strings[uri]] = strings[prefix]
                fresh.append((strings[prefix], strings[uri]))
            elif kind == START:
                name, begin, width, count = struct.unpack_from("<IHHH", data, at + 20)
                said = [f"xmlns:{p}={quoteattr(u)}" for p, u in fresh]
                fresh = []
                for k in range(count):
                    ns, key, raw, _, typed, value = struct.unpack_from("<3IHxBI", data, at + 16 + begin + k * width)
                    text = strings[raw] if raw != 0xFFFFFFFF and typed == 0x03 else _value(typed, value, strings)
                    own = f"{prefixes[strings[ns]]}:" if ns != 0xFFFFFFFF and strings[ns] in prefixes else ""
                    said.append(f"{own}{strings[key]}={quoteattr(text)}")
                lines.append("  " * depth + f"<{' '.join([strings[name], *said])}>")
                depth += 1
            elif kind == END:
                depth -= 1
                lines.append("  " * depth + f"</{strings[struct.unpack_from('<I', data, at + 20)[0]]}>")
            elif kind == TEXT:
                text = strings[struct.unpack_from("<I", data, at + 16)[0]]
                lines.append("  " * depth + text.replace("&", "&amp;").replace("<", "&lt;"))
            at += size
    except (IndexError, struct.error) as e:
        raise ValueError(f"broken binary XML near {at}") from e
    return "\n".join(lines) + "\n"


def manifests(spark: SparkSession, path: str | list[str], entry: str = "AndroidManifest.xml") -> DataFrame:
    """(path, xml, error) of each archive: one row, with an error where the entry is missing or broken. ``xpath`` functions read on."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, errors = [], []
            for data in batch.column(1):
                text = error = None
                try:
                    with zipfile.ZipFile(io.BytesIO(data.as_py())) as z:
                        raw = z.read(entry)
                    text = xml(raw) if raw[:4] == b"\x03\x00\x08\x00" else raw.decode("utf-8", "replace")
                except (KeyError, ValueError, zipfile.BadZipFile, NotImplementedError) as e:
                    error = f"{type(e).__name__}: {e}"
                texts.append(text)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=["path", "xml", "error"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, xml string, error string")
