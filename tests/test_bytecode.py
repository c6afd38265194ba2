"""Instructions, tries, debug events, assembly text and flow, over bodies written by hand."""

import struct

import pytest
from lodestone.functions import names
from lodestone.sources import apk, bytecode, codec, flow, smali
from pyspark.sql import functions as F

from tests import dexfile
from tests.test_archives import archive


def code(text, tries=(), registers=4, ins=1):
    return bytecode.Code(registers, ins, 0, 0, bytes.fromhex(text.replace(" ", "")), 16, list(tries))


#: if-eqz v3 +4; const/4 v0 1; goto +2; const/4 v0 2; return v0
DIAMOND = "3803 0400 1210 2802 1220 0f00"
#: const/4 v0 0; if-ge v0 v3 +5; add-int/lit8 v0 v0 1; goto -4; return-void
LOOP = "1200 3530 0500 d800 0001 28fc 0e00"


def test_opcodes_agree_with_the_lengths():
    assert {op: int(form[0]) for op, (_, form) in bytecode.OPCODES.items()} == codec.LENGTH
    assert bytecode.OPCODES[0x6F][0] == "invoke-super" and bytecode.OPCODES[0xAF] == ("rem-double", "23x") and bytecode.OPCODES[0xE2] == ("ushr-int/lit8", "22b")


def test_operands():
    one = lambda text: next(bytecode.sweep(bytes.fromhex(text.replace(" ", ""))))
    assert one("12f1").registers == [1] and one("12f1").literal == -1
    assert one("1905 0040").literal == 0x4000 << 48
    assert one("7130 0200 2143").registers == [1, 2, 3]
    assert one("7703 0000 0200").registers == [2, 3, 4]
    assert one("2afc ffff ff00".replace("fc", "00")).target is not None
    assert one("28fe").target == -2
    with pytest.raises(ValueError):
        one("3e00")


def test_payloads():
    """packed-switch v0 +4; return-void; nop; payload of key 7 and 8"""
    items = list(bytecode.sweep(bytes.fromhex("2b00 0500 0000 0e00 0000 0001 0200 0700 0000 0300 0000 0400 0000".replace(" ", ""))))
    p = bytecode.resolve(items)[0]
    assert (p.kind, p.keys, p.targets) == ("packed", [7, 8], [3, 4])


def test_debug_events():
    raw = bytes([10, 1, 3, 0x0E, 3, 0, 2, 1, 0x0E + 15, 5, 0, 2, 0x7D, 1, 4, 7, 0])
    assert bytecode.debug_events(raw, 0) == (10, [2], [(0, "line", (10,)), (0, "local", (0, 1, 0, -1)), (1, "line", (10,)), (1, "end_local", (0,))])


def test_encoded_values():
    value = lambda *raw: bytecode.encoded_value(bytes(raw), 0)[0]
    assert value(0x04, 0xFF) == ("int", -1) and value(0x03, 0x41) == ("char", 65) and value(0x3F) == ("boolean", True)
    assert value(0x30, 0x80, 0x3F) == ("float", 1.0)
    assert value(0x1C, 2, 0x1E, 0x17, 5) == ("array", [("null", None), ("string", 5)])
    with pytest.raises(ValueError):
        value(0x05)


def test_branch_and_loop():
    g = flow.graph(code(DIAMOND))
    assert g.blocks == [(0, 2), (2, 4), (4, 5), (5, 6)]
    assert sorted(g.edges) == [(0, 1, "next"), (0, 2, "branch"), (1, 3, "branch"), (2, 3, "next")]
    assert flow.dominators(g) == {0: None, 1: 0, 2: 0, 3: 0}
    assert [c for c in flow.reaching(code(DIAMOND)) if c[0] == 5] == [(5, 0, 2), (5, 0, 4)]
    g = flow.graph(code(LOOP))
    assert flow.dominators(g) == {0: None, 1: 0, 2: 1, 3: 1}
    assert (2, 1, "branch") in g.edges
    assert {d for at, r, d in flow.reaching(code(LOOP)) if at == 1 and r == 0} == {0, 3}


def test_handler_edges():
    """sget-object v0; goto +2; move-exception v1; return-void, the first in a try"""
    g = flow.graph(code("6200 0000 2802 0d01 0e00", [bytecode.Try(0, 2, [(3, 3), (None, 3)])]))
    assert {e for e in g.edges if e[2].startswith("catch")} == {(0, 2, "catch:3"), (0, 2, "catch:all")}


def test_tries_of_a_code_item():
    insns = bytes.fromhex("62000000 0d01 0e00 0000".replace(" ", "")) + b""
    raw = struct.pack("<4H2I", 2, 0, 0, 1, 0, 5) + insns + b"\0\0" + struct.pack("<IHH", 0, 2, 1) + bytes([1, 0x7F, 4, 2, 3])
    found = bytecode.code_item(raw, 0).tries
    assert [(t.start, t.end, t.handlers) for t in found] == [(0, 2, [(4, 2), (None, 3)])]


def test_text_of_methods():
    dex = codec.Dex(dexfile.two_methods())
    said = ["\n".join(lines) for _, _, lines in smali.classes(dex)]
    assert said[0].splitlines() == ["# CLASS: Lexample/Test;", ".class public Lexample/Test;", ".super Ljava/lang/Object;"]
    assert said[1].splitlines()[:5] == ["## METHOD: public first ()V", ".method public first()V", "    .locals 2", '    const-string v0, "token"', "    return-void"]
    assert [m for _, m, _ in smali.classes(dex, only="first()V")] == [None, "first()V"]
    for bad in ("first", "missing()V"):
        with pytest.raises(ValueError):
            list(smali.classes(dex, only=bad))
    calls = codec.Dex(dexfile.calls())
    assert "    invoke-static {}, Lexample/Target;->call(I)V" in [x for *_, lines in smali.classes(calls) for x in lines]
    body = "\n".join(smali.body(calls, code(DIAMOND), smali.Names(calls)))
    assert "    if-eqz v3, :cond_0" in body and "    :cond_0\n    const/4 v0, 0x2" in body and "    goto :goto_0" in body


def test_tables_from_one_pass(spark, tmp_path):
    (tmp_path / "a.apk").write_bytes(archive([("classes.dex", dexfile.two_methods()), ("classes2.dex", b"dex\n035\0" + b"\1" * 40)]))
    (tmp_path / "b.apk").write_bytes(b"no archive")
    out = str(tmp_path / "tables")
    with pytest.raises(Exception):  # noqa: B017
        apk.ingest(spark, str(tmp_path / "*.apk"), out)
    model = apk.ingest(spark, str(tmp_path / "*.apk"), out, tuple(apk.EXTRA), permissive=True)
    assert model.methods.count() == 2 and model.refs.count() == 1
    assert {(r["entry"], r["place"]) for r in apk.load_table(spark, out, "errors").collect()} == {("classes2.dex", "file"), ("", "archive")}
    assert [r["mnemonic"] for r in apk.load_table(spark, out, "instructions").orderBy("insn_off").collect()] == ["const-string", "return-void", "nop"]
    assert apk.load_table(spark, out, "blocks").where("reachable").count() == 1
    assert apk.load_table(spark, out, "tries").count() == 0
    (tmp_path / "c.apk").write_bytes(archive([("classes.dex", dexfile.calls())]))
    lines = apk.disassemble(spark, str(tmp_path / "c.apk"), "Lexample/Test;", "run()V").orderBy("line_ord").collect()
    assert [r["line"] for r in lines][0] == "## METHOD: public static run ()V" and lines[-1]["line"] == ".end method"


def test_names_of_arrays_and_prefixes(spark):
    df = spark.createDataFrame([("[I",), ("I",), ("[Lp/Q;",), ("p.Q",)], "s string").select(names.class_descriptor(F.col("s")).alias("s"))
    assert [r[0] for r in df.collect()] == ["[I", "I", "[Lp/Q;", "Lp/Q;"]
    df = spark.createDataFrame([("Lib.Main",), ("Lib/Main",), ("com.a",)], "s string").select(names.class_prefix(F.col("s")).alias("s"))
    assert [r[0] for r in df.collect()] == ["LLib/Main", "Lib/Main", "Lcom/a"]
