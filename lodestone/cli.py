"""Command line: ``python -m lodestone COMMAND ARCHIVES ...``. ARCHIVES is a file, a folder or a pattern that Spark reads."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import session
from .functions import names
from .operators import locate, refs
from .operators.locate import KINDS, FindQuery
from .sources import apk, manifest, sinks


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lodestone", description=__doc__)
    top.add_argument("--cores", default="*", help="cores of a local session; an active session is used as it is")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, about: str) -> argparse.ArgumentParser:
        sub = commands.add_parser(name, help=about)
        sub.add_argument("archives")
        sub.add_argument("-o", "--output", help="also write the lines to this file")
        sub.add_argument("--json", help="write the rows as JSON lines to this folder")
        return sub

    command("listclass", "names of the defined classes").add_argument("--prefix")
    command("getmanifest", "the manifest as XML")
    sub = command("disassemble", "assembly text of a class")
    sub.add_argument("class_name")
    sub.add_argument("--method", help="name(parameters)result")
    sub.add_argument("--debuginfo", action="store_true")
    sub = commands.add_parser("extractclass", help="a class as a DEX of its own, from the first DEX that defines it")
    sub.add_argument("archives")
    sub.add_argument("class_name")
    sub.add_argument("-o", "--output", required=True)
    sub = command("findrefs", "methods that refer to something, or classes that extend or implement one")
    sub.add_argument("kind", choices=[*KINDS, "extends", "impl"])
    sub.add_argument("value", nargs="?")
    sub.add_argument("--class", dest="class_name")
    sub.add_argument("--fuzzy-class", action="store_true")
    sub.add_argument("--regex", action="store_true", help="patterns are Java regular expressions")
    sub.add_argument("--occurrences", action="store_true", help="a line for each reference")
    return top


def found(spark: SparkSession, args: argparse.Namespace) -> tuple[DataFrame, DataFrame]:
    """(rows, lines in their order) of a command."""
    if args.command == "getmanifest":
        rows = manifest.manifests(spark, args.archives)
        return rows, rows.orderBy("path").select(F.coalesce("xml", F.raise_error(F.concat("path", F.lit(": "), "error"))))
    if args.command == "disassemble":
        wanted = spark.range(1).select(names.class_descriptor(F.lit(args.class_name))).first()[0]
        rows = apk.disassemble(spark, args.archives, wanted, args.method, debug=args.debuginfo)
        order = F.struct("class_name", F.coalesce("method", F.lit("")))
        return rows, rows.orderBy("dex_id", order, "line_ord").select("line")
    model = apk.model(spark, args.archives)
    if args.command == "listclass":
        rows = locate.list_classes(model, args.prefix)
        return rows, rows.orderBy("entry_ord", "logical_ord", "class_def_ord").select("class_name")
    if args.kind in ("extends", "impl"):
        if not args.value:
            raise ValueError("a class is required")
        rows = (locate.extends if args.kind == "extends" else locate.implements)(model, args.value)
        said = F.concat("dex_name", F.lit(" | "), "class_name", F.lit(" extends " if args.kind == "extends" else " implements "), "target")
        return rows, rows.orderBy("dex_name", "class_def_ord").select(said.alias("line"))
    q = FindQuery(args.kind, args.value, args.class_name, fuzzy_class=args.fuzzy_class, mode="regex" if args.regex else "literal")
    if args.occurrences:
        rows = refs.occurrences(model, q)
        return rows, refs.render_occurrences(rows.orderBy("dex_name", "method_idx", "ref_idx", "occurrence"))
    rows = refs.aggregated(model, q)
    return rows, refs.render(rows.orderBy("dex_name", "method_idx")).select("line")


def extract(spark: SparkSession, args: argparse.Namespace) -> None:
    """The class's DEX as a file of the driver."""
    wanted = spark.range(1).select(names.class_descriptor(F.lit(args.class_name))).first()[0]
    row = apk.extract(spark, args.archives, wanted).orderBy("dex_id").first()
    if row is None:
        raise ValueError(f"no class {wanted}")
    with open(args.output, "wb") as out:
        out.write(row["dex"])


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.getActiveSession() or session.local(args.cores)
    try:
        if args.command == "extractclass":
            extract(spark, args)
            return 0
        rows, lines = found(spark, args)
        if args.json:
            sinks.to_json(rows, args.json)
        if args.output:
            with open(args.output, "w", encoding="utf-8", errors="replace", newline="\n") as out:
                sinks.to_stream(lines, sys.stdout, out)
        else:
            sinks.to_stream(lines, sys.stdout)
    except Exception as e:  # a command ends with a message, not a trace
        print(f"Error: {e}", file=sys.stderr)
        return 1
    return 0
