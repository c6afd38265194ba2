"""A class written as a DEX of its own says the same as before."""

import hashlib
import struct
import zlib

import pytest
from lodestone.sources import apk, bytecode, codec, rebuild, smali

from tests import dexfile
from tests.test_archives import archive


def text(raw, cls="Lexample/Test;"):
    return [(c, m, lines) for c, m, lines in smali.classes(codec.Dex(raw), cls, None, False, True)]


def crowded() -> bytes:
    """Two classes and unused ids; the wanted one has an interface, a source, two static fields with values, annotations of all places, a try, locals and parameters."""
    strings = [b"<a>", b"Fine.java", b"I", b"LOther;", b"Lexample/Note;", b"Lexample/Oops;", b"Lexample/Test;", b"Ljava/lang/Object;", b"V", b"VI", b"count", b"left", b"local", b"name", b"other", b"run", b"unused", b"value", b"wanted"]
    types = [2, 3, 4, 5, 6, 7, 8]
    fields = [(1, 0, 16), (4, 0, 10), (4, 5, 13)]
    methods = [(1, 0, 14), (4, 1, 15)]
    body = bytes.fromhex("1a00 1200 6001 0100 0d00 0e00".replace(" ", ""))  # const-string, sget, move-exception, return-void
    raw = bytearray(dexfile.build(strings, types, [(8, 6, []), (9, 6, [0])], fields, methods, [{"type": 1, "super": 5, "methods": [(0, 1, 0)]}, {"type": 4, "super": 5, "interfaces": [1], "methods": []}], [body]))

    def put(more: bytes) -> int:
        raw.extend(bytes(-len(raw) % 4))
        raw.extend(more)
        return len(raw) - len(more)

    debug = put(bytes([7, 1, 13, 0x0E, 3, 0, 13, 1, 4, 1, 13, 1, 1, 0x1E, 9, 2, 5, 0, 6, 0, 0]))
    code = put(struct.pack("<4H2I", 3, 1, 0, 2, debug, 6) + body + struct.pack("<IHHIHH", 0, 2, 1, 2, 2, 1) + bytes([1, 0x7F, 3, 4, 5]))
    data = put(rebuild.uleb(2) + rebuild.uleb(0) + rebuild.uleb(1) + rebuild.uleb(0) + bytes([1, 9, 1, 9, 1, 1]) + rebuild.uleb(code))
    values = put(bytes([2, 0x24, 0x39, 0x05, 0x17, 18]))
    note = put(bytes([1, 2, 2, 11, 0x1C, 2, 0x1E, 0x3F, 17, 0x18, 3]))
    system = put(bytes([2, 2, 1, 17, 0x1D, 3, 1, 13, 0x30, 0x80, 0x3F]))
    one, both = put(struct.pack("<2I", 1, note)), put(struct.pack("<3I", 2, note, system))
    listed = put(struct.pack("<2I", 1, one))
    notes = put(struct.pack("<4I", both, 1, 1, 1) + struct.pack("<6I", 1, one, 1, both, 1, listed))
    at = codec.Dex(bytes(raw)).sizes["class_defs"][1] + 32
    struct.pack_into("<4I", raw, at + 16, 1, notes, data, values)
    return bytes(raw)


@pytest.mark.parametrize("raw", [dexfile.two_methods(), dexfile.calls(), crowded()])
def test_text_stays(raw):
    got = rebuild.class_dex(codec.Dex(raw), "Lexample/Test;")
    assert text(got) == text(raw) and len(text(raw)) > 1
    assert rebuild.class_dex(codec.Dex(got), "Lexample/Test;") == got
    assert struct.unpack_from("<I", got, 8)[0] == zlib.adler32(got[12:]) and got[12:32] == hashlib.sha1(got[32:]).digest() and struct.unpack_from("<I", got, 32)[0] == len(got)


def test_parts_stay_and_others_go():
    raw = crowded()
    old, new = codec.Dex(raw), codec.Dex(rebuild.class_dex(codec.Dex(raw), "Lexample/Test;"))
    assert not {"unused", "other"} & set(new.string_list) and {"wanted", "local", "Fine.java", "left"} <= set(new.string_list)
    assert new.string_list == sorted(new.string_list) and len(list(new.methods())) == 1 and len(list(new.fields())) == 2
    a, b = next(c for c in bytecode.class_defs(old) if c.descriptor == "Lexample/Test;"), next(bytecode.class_defs(new))
    assert (a.flags, a.parent, a.interfaces, a.source) == (b.flags, b.parent, b.interfaces, b.source) == (1, "Ljava/lang/Object;", ["LOther;"], "Fine.java")
    said = lambda dex, table, *at: [tuple(r[k] for k in at) for r in apk.rows_of(dex, table) if table != "debug" or r[0] == max(x[0] for x in apk.rows_of(dex, table))]
    assert said(old, "annotations", 0, 1, 3, 4, 6) == said(new, "annotations", 0, 1, 3, 4, 6) and len(said(new, "annotations", 0)) == 6
    assert said(old, "static_values", 1) == said(new, "static_values", 1) == [("0x539",), ('"wanted"',)]
    assert said(old, "tries", 1, 2, 3, 4, 6) == said(new, "tries", 1, 2, 3, 4, 6) and len(said(new, "tries", 1)) == 4
    assert said(old, "debug", 1, 2, 3, 4, 5) == said(new, "debug", 1, 2, 3, 4, 5) and len(said(new, "debug", 1)) >= 4
    kinds = struct.unpack_from("<I", new.data, struct.unpack_from("<I", new.data, 52)[0])[0]
    assert kinds == 18
    assert rebuild.class_dex(old, "Lmissing;") is None


def test_bad_ids_raise():
    raw = bytearray(dexfile.two_methods())
    at = raw.index(bytes.fromhex("1a000500"))
    raw[at + 2] = 99
    with pytest.raises(ValueError):
        rebuild.class_dex(codec.Dex(bytes(raw)), "Lexample/Test;")
    with pytest.raises(ValueError):
        rebuild.value(rebuild.Ids(codec.Dex(dexfile.calls())), ("method_handle", 1))


def test_column(spark, tmp_path):
    (tmp_path / "a.apk").write_bytes(archive([("classes.dex", dexfile.two_methods()), ("classes2.dex", dexfile.calls())]))
    rows = apk.extract(spark, str(tmp_path / "a.apk"), "Lexample/Test;").orderBy("dex_id").collect()
    assert [text(bytes(r["dex"])) for r in rows] == [text(dexfile.two_methods()), text(dexfile.calls())]
