"""The command line, the sinks and the inbox stream."""

import json

import pytest
from lodestone import cli
from lodestone.operators import locate, refs
from lodestone.operators.locate import FindQuery
from lodestone.sources import apk
from lodestone.streaming import inbox

from tests import dexfile
from tests.test_archives import archive, rows


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    out = tmp_path_factory.mktemp("outside")
    (out / "a.apk").write_bytes(archive([("classes.dex", dexfile.two_methods()), ("classes2.dex", dexfile.calls())]))
    return out


def said(spark, capsys, *argv):
    assert cli.main([*argv], spark) == 0
    return capsys.readouterr().out.splitlines()


def test_commands(spark, folder, capsys, tmp_path):
    a = str(folder / "a.apk")
    assert said(spark, capsys, "listclass", a, "--prefix", "example") == ["Lexample/Test;"] * 2
    lines = ["classes.dex | Lexample/Test;->first | matched=(token)", "classes.dex | Lexample/Test;->second | matched=(token)"]
    assert said(spark, capsys, "findrefs", a, "string", "tok", "-o", str(tmp_path / "o.txt"), "--json", str(tmp_path / "j")) == lines
    assert (tmp_path / "o.txt").read_text() == "\n".join(lines) + "\n"
    written = [json.loads(x) for f in (tmp_path / "j").glob("*.json") for x in f.read_text().splitlines()]
    assert sorted(x["method_name"] for x in written) == ["first", "second"]
    occurrence = "classes2.dex | Lexample/Test;->run()V | matched=(Lexample/Target;->call(I)V) | occurrence=0"
    assert said(spark, capsys, "findrefs", a, "method", "call", "--class", "Target", "--fuzzy-class", "--occurrences") == [occurrence]
    assert said(spark, capsys, "findrefs", a, "impl", "example.Target") == ["classes2.dex | Lexample/Test; implements Lexample/Target;"]
    assert any("const-string" in x for x in said(spark, capsys, "disassemble", a, "example.Test", "--method", "first()V"))
    assert said(spark, capsys, "extractclass", a, "example.Test", "-o", str(tmp_path / "c.dex")) == []
    assert said(spark, capsys, "listclass", str(tmp_path / "c.dex")) == ["Lexample/Test;"]
    assert cli.main(["extractclass", a, "no.Such", "-o", str(tmp_path / "d.dex")], spark) == 1 and "no class" in capsys.readouterr().err
    assert cli.main(["findrefs", a, "method"], spark) == 1 and "Error" in capsys.readouterr().err


def test_inbox(spark, folder, tmp_path):
    """Two runs over one inbox: each archive is taken once, broken ones become errors, results come batch by batch."""
    box, out, seen = tmp_path / "in", str(tmp_path / "out"), []
    box.mkdir()
    found = lambda model, n: seen.append((n, refs.occurrences(model, FindQuery("string", "token")).count()))
    run = lambda: inbox.watch(spark, str(box), out, str(tmp_path / "check"), found, files=1, once=True)
    (box / "a.apk").write_bytes((folder / "a.apk").read_bytes())
    (box / "broken.apk").write_bytes(b"PK\3\4 no archive")
    query = run()
    query.awaitTermination()
    assert inbox.progress(query) == {"batches": 2, "archives": 2}
    (box / "b.dex").write_bytes(dexfile.two_methods())
    run().awaitTermination()
    assert sorted(n for n, _ in seen) == [0, 1, 2] and sorted(k for _, k in seen) == [0, 2, 2]
    model = apk.load(spark, out)
    assert locate.list_classes(model).count() == 3
    assert apk.load_table(spark, out, "errors").count() == 1
    assert rows(model.dex.select("dex_name")) == [("classes.dex",), ("classes.dex",), ("classes2.dex",)]
