"""Reference search: where code names strings, types, methods and fields.

The order of the joins is fixed: ids of the targets first (filters on small dictionaries), then a join of the
references with them on (dex_id, kind, id), and owners' names last, for the few rows that are left.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names
from ..plans.model import CodeModel
from .locate import FindQuery, locate


def hits(model: CodeModel, q: FindQuery) -> DataFrame:
    """Instructions that refer to the query's targets: dex_id, code_off, insn_off, ref_idx, label."""
    targets = locate(model, q)
    return model.refs.where(F.col("ref_kind") == q.kind).join(targets, ["dex_id", "ref_idx"]).select("dex_id", "code_off", "insn_off", "opcode", "ref_idx", "label")


def owned(model: CodeModel, q: FindQuery) -> DataFrame:
    """Hits of all methods that own them; a shared body has several owners."""
    return model.owned(hits(model, q))


def occurrences(model: CodeModel, q: FindQuery) -> DataFrame:
    """A row for each reference, numbered from 0 within its method and target, in code order."""
    order = Window.partitionBy("dex_id", "method_idx", "ref_idx").orderBy("insn_off")
    rows = owned(model, q).withColumn("occurrence", (F.row_number().over(order) - 1).cast("long"))
    return rows.join(model.dex, "dex_id").select("dex_name", "class_name", "method_name", "method_descriptor", "method_idx", F.lit(q.kind).alias("kind"), F.col("label").alias("matched"), "ref_idx", "occurrence")


def aggregated(model: CodeModel, q: FindQuery) -> DataFrame:
    """A row for each method, with its distinct targets joined in the order of their ids."""
    distinct = owned(model, q).select("dex_id", "method_idx", "class_name", "method_name", "ref_idx", "label").distinct()
    rows = distinct.groupBy("dex_id", "method_idx", "class_name", "method_name").agg(F.sort_array(F.collect_list(F.struct("ref_idx", "label"))).alias("x"))
    return rows.join(model.dex, "dex_id").select("dex_name", "method_idx", "class_name", "method_name", F.array_join("x.label", "; ").alias("matched"))


def find_refs(model: CodeModel, q: FindQuery, aggregate: bool = False) -> DataFrame:
    return aggregated(model, q) if aggregate else occurrences(model, q)


def find_refs_multi(model: CodeModel, queries: list[FindQuery]) -> DataFrame:
    """Occurrences of several kinds in one table; ``kind`` tells them apart."""
    return reduce(DataFrame.unionByName, [occurrences(model, q) for q in queries])


def render(rows: DataFrame) -> DataFrame:
    """Aggregated rows as result lines."""
    return rows.select("dex_name", "method_idx", F.concat("dex_name", F.lit(" | "), "class_name", F.lit("->"), "method_name", F.lit(" | matched=("), "matched", F.lit(")")).alias("line"))


def parse(lines: DataFrame) -> DataFrame:
    """Result lines as rows again; occurrence is null where a line has none."""
    pattern = r"^(.*?) \| (.*?)->(.*?) \| matched=\((.*?)\)(?: \| occurrence=(\d+))?$"
    got = {name: F.regexp_extract("line", pattern, k + 1) for k, name in enumerate(("dex_name", "class_name", "method_text", "matched_text"))}
    return lines.select(*[c.alias(n) for n, c in got.items()], F.nullif(F.regexp_extract("line", pattern, 5), F.lit("")).cast("long").alias("occurrence"))


def render_occurrences(rows: DataFrame) -> DataFrame:
    """Occurrences as result lines, with descriptors and numbers."""
    method = F.concat("class_name", F.lit("->"), "method_name", "method_descriptor")
    return rows.select(F.concat("dex_name", F.lit(" | "), method, F.lit(" | matched=("), "matched", F.lit(") | occurrence="), F.col("occurrence").cast("string")).alias("line"))


def parse_whole(lines: DataFrame, kind: str = "") -> DataFrame:
    """Result lines of one kind as rows with all their parts. What matched may hold `` | `` itself; a line without a number is occurrence 0."""
    part = lambda n: F.regexp_extract("line", r"(?s)^(.*?) \| (.*?) \| (.*?)(?: \| occurrence=([0-9]+))?$", n)
    step = lines.select("line", part(1).alias("dex_name"), part(2).alias("method_text"), part(3).alias("matched_text"), F.coalesce(F.nullif(part(4), F.lit("")).cast("long"), F.lit(0)).alias("occurrence"))
    of_method = lambda n: F.regexp_extract("method_text", r"(?s)^(.*?)->([^(]*)(.*)$", n)
    value = F.regexp_replace("matched_text", r"(?s)^matched=\((.*).$", "$1")
    step = step.withColumns({"class_name": of_method(1), "method_name": of_method(2), "method_descriptor": of_method(3), "value": value})
    target = lambda n: F.regexp_extract("value", r"(?s)^(.*?)->([^(]*)(.*)$" if kind == "method" else r"(?s)^(.*?)->(.*?)(?::([^:]*))?$", n)
    member, none = kind in ("method", "field"), F.lit("")
    return step.select(
        "dex_name",
        "class_name",
        names.dotted(F.col("class_name")).alias("class_display"),
        "method_text",
        "method_name",
        "method_descriptor",
        "matched_text",
        F.lit("class" if kind == "type" else kind).alias("target_type"),
        (target(1) if member else F.col("value") if kind == "type" else none).alias("target_class"),
        (target(2) if member else F.col("value")).alias("target_name"),
        (target(3) if member else none).alias("target_descriptor"),
        "occurrence",
        "line",
    )


def filter_rows(rows: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Rows of which any column holds the text, whatever its case."""
    return rows.where(reduce(lambda a, b: a | b, [F.contains(F.lower(c), F.lit(text.lower())) for c in columns]))


def owners_of_offsets(model: CodeModel, offsets: DataFrame, bodies: DataFrame, cell: int = 64) -> DataFrame:
    """Raw offsets (dex_id, offset) with the methods in whose body they lie.

    bodies: dex_id, code_off, begin, end of each body's instructions in bytes (for archives, those of ``apk.bodies``). Each body is put into
    every cell of so many bytes that it touches, so the join is an equality join with a range check.
    """
    named = model.owners.select("dex_id", "code_off", "method_idx", "class_name", "method_name")
    cells = bodies.where("end > begin").withColumn("cell", F.explode(F.sequence(F.expr(f"begin div {cell}"), F.expr(f"(end - 1) div {cell}")))).join(named, ["dex_id", "code_off"])
    probes = offsets.withColumn("cell", F.expr(f"offset div {cell}"))
    return probes.join(cells, ["dex_id", "cell"]).where("offset >= begin AND offset < end").select("dex_id", "offset", "method_idx", "class_name", "method_name")


def class_closure(model: CodeModel, name: str) -> DataFrame:
    """Ids that one class's code refers to: dex_id, ref_kind, ref_idx."""
    mine = model.owners.where(F.col("class_name") == name).select("dex_id", "code_off").distinct()
    return model.refs.join(mine, ["dex_id", "code_off"], "left_semi").select("dex_id", "ref_kind", "ref_idx").distinct()


def dense_remap(model: CodeModel, name: str) -> DataFrame:
    """New dense ids of a class's closure, per kind and DEX, by the order of the old ones."""
    order = Window.partitionBy("dex_id", "ref_kind").orderBy("ref_idx")
    return class_closure(model, name).withColumn("new_idx", (F.row_number().over(order) - 1).cast("long"))
