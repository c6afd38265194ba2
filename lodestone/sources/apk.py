"""Archives (APK) and bare DEX files as tables.

Files come through Spark's ``binaryFile`` reader, so from any store that Spark reads, a file a task. ``read`` decodes one
table with only the sections that it needs; ``ingest`` decodes each archive once, into Parquet of all tables, a folder each, which queries then
scan with pruning. A DEFLATE stream can't be split, so a file is the unit of work; one of a file's rows never leaves its task.
With ``permissive``, an archive, entry, class or body that can't be decoded gives a row of the table ``errors`` and the rest goes on.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import fields

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.model import CodeModel
from ..session import ship
from . import bytecode, codec, flow, rebuild, smali

_KEY = "dex_id string, "
SCHEMAS = {
    "dex": _KEY + "dex_name string, entry_ord int, logical_ord int",
    "strings": _KEY + "string_idx long, value string",
    "types": _KEY + "type_idx long, descriptor string",
    "fields": _KEY + "field_idx long, class_type_idx long, class_name string, name string, descriptor string",
    "methods": _KEY + "method_idx long, class_type_idx long, class_name string, name string, descriptor string",
    "class_defs": _KEY + "class_def_ord long, class_type_idx long, class_name string, access_flags long, superclass_idx long, interface_type_idxs array<long>",
    "class_members": _KEY + "class_def_ord long, kind string, member_idx long, access_flags long, code_off long",
    "refs": _KEY + "code_off long, insn_off long, opcode int, ref_kind string, ref_idx long",
}
#: Tables beside the code model's. Places of instructions count 16-bit units, begin and end bytes of the container.
EXTRA = {
    "bodies": _KEY + "code_off long, register_count int, ins int, outs int, begin long, end long",
    "instructions": _KEY + "code_off long, insn_off long, units int, opcode int, mnemonic string, registers array<int>, literal long, target long, ref_kind string, ref_idx long",
    "tries": _KEY + "code_off long, try_ord int, try_begin long, try_end long, handler_ord int, type_idx long, handler long",
    "debug": _KEY + "code_off long, insn_off long, event_ord int, event string, line long, register int, string_idx long, type_idx long",
    "annotations": _KEY + "class_name string, place string, member_idx long, parameter int, visibility string, type_idx long, value string",
    "static_values": _KEY + "field_idx long, value string",
    "class_sources": _KEY + "class_name string, source string",
    "blocks": _KEY + "code_off long, block int, block_begin long, block_end long, reachable boolean, dominator int",
    "block_edges": _KEY + "code_off long, block int, to_block int, edge string",
    "chains": _KEY + "code_off long, insn_off long, register int, defined_at long",
    "smali": _KEY + "class_name string, method string, lines array<string>",
}
ERRORS = "path string, entry string, place string, error string"
SCHEMAS |= EXTRA
ROWS = 20_000


def dex_entries(data: bytes) -> Iterator[tuple[int, str, bytes]]:
    """(ordinal, name, bytes) of an archive's DEX entries: ``classes*.dex`` at its root, else any ``*.dex`` there. A bare DEX is one entry."""
    if data[:4] == b"dex\n":
        yield 0, "classes.dex", data
        return
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = [i for i in z.infolist() if "/" not in i.filename and i.filename.endswith(".dex")]
        named = list({i.filename: i for i in reversed(root) if re.fullmatch(r"classes.*\.dex", i.filename)}.values())[::-1]
        for k, info in enumerate(named or root):
            yield k, info.filename, z.read(info)


def _codes(dex: codec.Dex) -> Iterator[tuple[int, bytecode.Code]]:
    for off in sorted({m[4] for m in dex.class_members() if m[4]}):
        yield off, bytecode.code_item(dex.data, off)


def _of_body(table: str, dex: codec.Dex, off: int, code: bytecode.Code) -> Iterator[tuple]:
    if table == "bodies":
        yield off, code.registers, code.ins, code.outs, code.begin, code.begin + len(code.insns)
    elif table == "instructions":
        for i in bytecode.sweep(code.insns):
            if isinstance(i, bytecode.Instruction):
                kind = None if i.index is None else smali.reference_kind(i.op)
                yield off, i.at, i.units, i.op, i.name, i.registers, i.literal, i.target, kind, i.index
    elif table == "tries":
        for k, t in enumerate(code.tries):
            for j, (what, place) in enumerate(t.handlers):
                yield off, k, t.start, t.end, j, what, place
    elif table == "debug" and code.debug_off:
        for k, (at, kind, values) in enumerate(bytecode.debug_events(dex.data, code.debug_off)[2]):
            line = values[0] if kind == "line" else None
            register = None if kind == "line" else values[0]
            name, type_ = (values[1], values[2]) if kind == "local" else (-1, -1)
            yield off, at, k, kind, line, register, name if name >= 0 else None, type_ if type_ >= 0 else None
    elif table in ("blocks", "block_edges"):
        g = flow.graph(code)
        if table == "block_edges":
            yield from ((off, *e) for e in g.edges)
            return
        up = flow.dominators(g)
        yield from ((off, k, begin, end, k in up, up.get(k)) for k, (begin, end) in enumerate(g.blocks))
    elif table == "chains":
        yield from ((off, *c) for c in flow.reaching(code))


def _of_classes(table: str, dex: codec.Dex) -> Iterator[tuple]:
    names = smali.Names(dex)
    for c in bytecode.class_defs(dex):
        if table == "class_sources":
            yield c.descriptor, c.source
        elif table == "static_values":
            yield from ((index, names.value(value)) for index, _, _, value in c.fields if value)
        else:
            notes = c.annotations
            every = [("class", None, None, notes["class"])]
            every += [(kind[:-1], k, None, own) for kind in ("fields", "methods") for k, own in notes[kind].items()]
            every += [("parameter", k, n, own) for k, lists in notes["parameters"].items() for n, own in enumerate(lists)]
            for place, member, parameter, own in every:
                for visibility, kind, elements in own:
                    said = "{" + ", ".join(f"{dex.string_list[n]} = {names.value(v)}" for n, v in elements) + "}"
                    yield c.descriptor, place, member, parameter, visibility, kind, said


def rows_of(dex: codec.Dex, table: str) -> Iterator[tuple]:
    if table == "smali":
        yield from smali.classes(dex)
    elif table in ("annotations", "static_values", "class_sources"):
        yield from _of_classes(table, dex)
    elif table in EXTRA:
        for off, code in _codes(dex):
            yield from _of_body(table, dex, off, code)
    else:
        yield from getattr(dex, table)()


def decode(path: str, data: bytes, tables: list[str], permissive: bool = False) -> Iterator[tuple[str, tuple]]:
    """(table, row) of an archive. Its DEX files are parsed once for all tables."""
    entry = ""

    def fault(where: str, place: str, e: Exception) -> tuple[str, tuple]:
        if not permissive:
            raise e
        return "errors", (path, where, place, f"{type(e).__name__}: {e}")

    try:
        for entry_ord, entry, raw in dex_entries(data):
            try:
                found = list(codec.logical(raw, entry))
            except (ValueError, IndexError, struct.error) as e:
                yield fault(entry, "file", e)
                continue
            for logical_ord, name, dex in found:
                dex_id = f"{path}!{entry_ord}!{logical_ord}"
                for table in tables:
                    if table == "dex":
                        yield table, (dex_id, name, entry_ord, logical_ord)
                        continue
                    try:
                        for row in rows_of(dex, table):
                            yield table, (dex_id, *row)
                    except (ValueError, IndexError, struct.error) as e:
                        yield fault(name, table, e)
    except (zipfile.BadZipFile, zlib.error, NotImplementedError, RuntimeError) as e:
        yield fault(entry, "archive", e)


def _schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def read(spark: SparkSession, path: str | list[str], table: str) -> DataFrame:
    """One table of all archives under ``path``."""
    ship(spark)
    schema = _schema(SCHEMAS[table])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for where, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = []
                for _, row in decode(where, data.as_py(), [table]):
                    rows.append(row)
                    if len(rows) == ROWS:
                        yield _batch(rows, schema)
                        rows = []
                if rows:
                    yield _batch(rows, schema)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, SCHEMAS[table])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def model(spark: SparkSession, path: str | list[str]) -> CodeModel:
    """Archives as a code model that decodes on the fly."""
    return CodeModel(*(read(spark, path, f.name) for f in fields(CodeModel)))


def ingest(spark: SparkSession, path: str | list[str], out: str, extra: tuple[str, ...] = (), permissive: bool = False) -> CodeModel:
    """Decode each archive once into Parquet, all tables of the model and those of ``extra`` and ``errors``, and go on from there."""
    found = spark.read.format("binaryFile").load(path).select("path", "content")
    decoded(found, extra, permissive).write.mode("overwrite").partitionBy("table").parquet(out)
    return load(spark, out)


def decoded(archives: DataFrame, extra: tuple[str, ...] = (), permissive: bool = False) -> DataFrame:
    """Rows of all tables of ``archives`` (path, content) in one frame: the column ``table``, and every table's columns, null in the others' rows."""
    ship(archives.sparkSession)
    tables = [f.name for f in fields(CodeModel)] + list(extra)
    wide = {}
    for ddl in (*(SCHEMAS[t] for t in tables), ERRORS):
        wide |= dict(_ddl(ddl))
    ddl = "table string, " + ", ".join(f"`{n}` {kind}" for n, kind in wide.items())
    schema = _schema(ddl)
    columns = {t: [n for n, _ in _ddl(ERRORS if t == "errors" else SCHEMAS[t])] for t in [*tables, "errors"]}

    def batch(table: str, rows: list[tuple]) -> pa.RecordBatch:
        own = dict(zip(columns[table], zip(*rows, strict=True), strict=True))
        arrays = [pa.array([table] * len(rows)) if f.name == "table" else pa.array(own[f.name], f.type) if f.name in own else pa.nulls(len(rows), f.type) for f in schema]
        return pa.RecordBatch.from_arrays(arrays, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in batches:
            for where, data in zip(given.column(0).to_pylist(), given.column(1), strict=True):
                now, rows = "", []
                for table, row in decode(where, data.as_py(), tables, permissive):
                    if rows and (table != now or len(rows) == ROWS):
                        yield batch(now, rows)
                        rows = []
                    now = table
                    rows.append(row)
                if rows:
                    yield batch(now, rows)

    return archives.select("path", "content").mapInArrow(run, ddl)


def _ddl(ddl: str) -> list[tuple[str, str]]:
    return [tuple(c.split(" ")) for c in ddl.split(", ")]


def load(spark: SparkSession, out: str) -> CodeModel:
    """The code model of what ``ingest`` has written."""
    return CodeModel(*(load_table(spark, out, f.name) for f in fields(CodeModel)))


def load_table(spark: SparkSession, out: str, table: str) -> DataFrame:
    """One table of what ``ingest`` has written; empty where no archive had a row of it."""
    own = _ddl(ERRORS if table == "errors" else SCHEMAS[table])
    every = spark.read.parquet(out)
    return every.where(F.col("table") == table).select(*((F.col(n) if n in every.columns else F.lit(None)).cast(kind).alias(n) for n, kind in own))


def disassemble(spark: SparkSession, path: str | list[str], wanted: str | None = None, only: str | None = None, offsets: bool = False, debug: bool = False) -> DataFrame:
    """(dex_id, class_name, method, line_ord, line): assembly text; of one class (descriptor), one method (``name(..)R``) if asked for."""
    ship(spark)
    only = smali.signature(only) if only else None
    ddl = "dex_id string, class_name string, method string, line_ord int, line string"
    schema = _schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for where, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for entry_ord, entry, raw in dex_entries(data.as_py()):
                    for logical_ord, _, dex in codec.logical(raw, entry):
                        for cls, method, lines in smali.classes(dex, wanted, None, offsets, debug):
                            if lines and only in (None, method):
                                yield _batch([(f"{where}!{entry_ord}!{logical_ord}", cls, method, k, x) for k, x in enumerate(lines)], schema)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, ddl)


def disassemble_range(spark: SparkSession, path: str | list[str], offset: int, size: int) -> DataFrame:
    """(dex_id, line_ord, line): the instructions of a byte range of each DEX."""
    ship(spark)
    ddl = "dex_id string, line_ord int, line string"
    schema = _schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for where, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for entry_ord, entry, raw in dex_entries(data.as_py()):
                    for logical_ord, _, dex in codec.logical(raw, entry):
                        rows = [(f"{where}!{entry_ord}!{logical_ord}", k, x) for k, x in enumerate(smali.span(dex, offset, size))]
                        if rows:
                            yield _batch(rows, schema)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, ddl)


def extract(spark: SparkSession, path: str | list[str], wanted: str) -> DataFrame:
    """(dex_id, class_name, dex): a class (descriptor) as the bytes of a DEX of its own, from each DEX that defines it."""
    ship(spark)
    ddl = "dex_id string, class_name string, dex binary"
    schema = _schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for where, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for entry_ord, entry, raw in dex_entries(data.as_py()):
                    for logical_ord, _, dex in codec.logical(raw, entry):
                        made = rebuild.class_dex(dex, wanted)
                        if made:
                            yield _batch([(f"{where}!{entry_ord}!{logical_ord}", wanted, made)], schema)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, ddl)
