"""Java source text, and binary XML."""

import struct

import pytest
from lodestone.functions import java_source as js
from lodestone.sources import manifest
from pyspark.sql import functions as F

from tests.test_archives import archive

SOURCE = 'class A { // run()\n  @Over void run(int x) throws E { if (x > 1) { s("run"); } }\n  int go() { return run(2); }\n}'


def words(kind):
    return [SOURCE[b:e] for k, b, e in js.lex(SOURCE) if k == kind]


def test_lexer():
    assert words("comment") == ["// run()"] and words("string") == ['"run"'] and words("annotation") == ["@Over"]
    assert words("identifier") == ["A", "run", "x", "E", "x", "s", "go", "run"] and words("number") == ["1", "2"]
    assert [k for k, *_ in js.lex("/* open")] == ["comment"] and list(js.lex("")) == []


def test_places():
    at = SOURCE.index("run(2)")
    assert js.position(SOURCE, at) == (3, 20) and js.offset_of(SOURCE, 3, 20) == at
    assert js.token_at(SOURCE, at + 3) == js.token_at(SOURCE, at) == (at, at + 3)
    assert js.token_at(SOURCE, SOURCE.index('"run"') + 2) is None
    low, high = js.method_range(SOURCE, at)
    assert SOURCE[low:high] == "go() { return run(2); }" and js.method_range(SOURCE, 3) is None
    low, high = js.method_range(SOURCE, SOURCE.index("x > 1"))
    assert SOURCE[low:high].startswith("run(int x)")
    assert js.rename(SOURCE, "run", "walk").count("walk") == 2


def test_escapes():
    assert js.escape("a'\"\\\né\U0001f600") == "a\\'\\\"\\\\\\n\\u00e9\\u1f600"
    assert js.unescape("\\u0041\\uuu0042 \\\\u0041 \\ud83d\\ude00 \\ufffd \\ud83d") == "AB \\\\u0041 \U0001f600 \\ufffd \\ud83d"


def test_tokens_of_a_table(spark):
    df = spark.createDataFrame([(1, "int a;"), (2, None), (3, "")], "n long, s string")
    assert [tuple(r) for r in js.tokens(df, "n", "s").orderBy("begin").collect()] == [(1, "keyword", "int", 0, 3), (1, "identifier", "a", 4, 5), (1, "symbol", ";", 5, 6)]


def binary_xml():
    texts = ["android", "http://x", "manifest", "package", "a.b", "debuggable"]
    raw, offs = b"", []
    for t in texts:
        offs.append(len(raw))
        raw += struct.pack("<H", len(t)) + t.encode("utf-16-le") + b"\0\0"
    pool = struct.pack("<5I", len(texts), 0, 0, 28 + 4 * len(texts), 0) + struct.pack(f"<{len(texts)}I", *offs) + raw
    chunk = lambda kind, body: struct.pack("<HHI", kind, 8, 8 + len(body)) + body
    none = 0xFFFFFFFF
    attributes = struct.pack("<3IHBBI", none, 3, 4, 8, 0, 3, 4) + struct.pack("<3IHBBI", 1, 5, none, 8, 0, 0x12, 1)
    start = struct.pack("<2I", 1, none) + struct.pack("<2I", none, 2) + struct.pack("<6H", 20, 20, 2, 0, 0, 0) + attributes
    body = chunk(1, pool) + chunk(0x100, struct.pack("<4I", 1, none, 0, 1)) + chunk(0x102, start) + chunk(0x103, struct.pack("<4I", 1, none, none, 2))
    return struct.pack("<HHI", 3, 8, 8 + len(body)) + body


def test_binary_xml(spark, tmp_path):
    said = manifest.xml(binary_xml())
    assert '<manifest xmlns:android="http://x" package="a.b" android:debuggable="true">' in said and said.endswith("</manifest>\n")
    with pytest.raises(ValueError):
        manifest.xml(binary_xml()[:90])
    (tmp_path / "a.apk").write_bytes(archive([("AndroidManifest.xml", binary_xml())]))
    (tmp_path / "b.apk").write_bytes(archive([("x", b"")]))
    got = {r["path"][-5:]: (r["package"], r["error"] is None) for r in manifest.manifests(spark, str(tmp_path)).select("path", "error", F.expr("xpath_string(xml, '/manifest/@package')").alias("package")).collect()}
    assert got["a.apk"] == ("a.b", True) and not got["b.apk"][1]
    kinds = spark.read.format("binaryFile").load(str(tmp_path)).select(manifest.file_kind(F.col("content"))).distinct().collect()
    assert [r[0] for r in kinds] == ["APK"]
