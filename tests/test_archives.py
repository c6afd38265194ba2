"""Archives decoded, and the same operators over them."""

import io
import zipfile

import pytest
from lodestone.operators import graph, locate, refs
from lodestone.operators.locate import FindQuery
from lodestone.sources import apk, codec

from tests import dexfile


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def archive(entries, method=zipfile.ZIP_DEFLATED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for name, data in entries:
            z.writestr(name, data)
    return out.getvalue()


@pytest.fixture(scope="module")
def model(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("apk")
    (folder / "a.apk").write_bytes(archive([("classes.dex", dexfile.two_methods()), ("classes2.dex", dexfile.calls()), ("lib/x.dex", b"no"), ("other.dex", b"no")]))
    (folder / "b.apk").write_bytes(archive([("classes.dex", dexfile.two_methods())], zipfile.ZIP_STORED))
    return apk.ingest(spark, str(folder / "*.apk"), str(folder / "tables"))


def test_string_references_of_a_shared_body(model):
    found = refs.occurrences(model, FindQuery("string", "token"))
    assert rows(found.select("method_name", "occurrence")) == [("first", 0), ("first", 0), ("second", 0), ("second", 0)]
    assert refs.aggregated(model, FindQuery("string", "first token")).count() == 0


def test_calls_and_fields(model):
    assert rows(graph.call_edges(model).select("from_name", "to_class", "to_name", "to_descriptor", "is_external")) == [("run", "Lexample/Target;", "call", "(I)V", True)]
    assert rows(graph.field_edges(model).select("method_name", "field_name", "access")) == [("run", "size", "r")]
    assert rows(locate.implements(model, "example.Target").select("class_name")) == [("Lexample/Test;",)]
    assert locate.extends(model, "java.lang.Object").count() == 2


def test_classes(model):
    assert locate.list_classes(model, "com.example").count() == 0
    assert locate.list_classes(model, "example").count() == locate.list_classes(model, "Lexample/").count() == 3


def test_members(model):
    exact = lambda name: locate.locate(model, FindQuery("method", name, exact_name=True)).select("ref_idx").distinct()
    assert rows(exact("fir")) == [] and rows(exact("first")) == [(0,)]
    with pytest.raises(ValueError):
        FindQuery("method")


def test_numbers():
    assert codec.uleb128(b"\xe5\x8e\x26", 0) == (624485, 3)
    assert codec.sleb128(b"\x9b\xf1\x59", 0) == (-624485, 3)
    with pytest.raises(ValueError):
        codec.uleb128(b"\xff" * 6, 0)


def test_strings():
    assert codec.mutf8(b"a\xc0\x80b") == "a\0b"
    assert codec.mutf8(b"\xed\xa0\xbd\xed\xb8\x80") == "\U0001f600"
    assert codec.mutf8(b"\xff") == "�"


def test_broken_files():
    good = dexfile.two_methods()
    with pytest.raises(ValueError):
        codec.Dex(b"PK\x03\x04" + good[4:])
    with pytest.raises(ValueError):
        codec.Dex(good.rstrip(b"\0")[: good.index(b"token") + 3])
