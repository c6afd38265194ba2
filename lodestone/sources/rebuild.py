"""One class of a DEX as a DEX of its own, with the ids that it refers to and no others.

The class's sections are written twice by the same code: the first time only to learn which ids they name, the second time with new
ids. Those are dense and keep the order of the old ones, so the tables stay sorted as the format demands, and no number grows beyond its place. The
result has version 035, with checksum, signature and map. Call sites and method handles can't be moved so; a class with one raises ValueError.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

from . import bytecode, smali
from .codec import NO_INDEX, Dex, uleb128

TABLES = ("string", "type", "proto", "field", "method")
WIDTH = {"string": 4, "type": 4, "proto": 12, "field": 8, "method": 8}
#: Fixed values of the format: kinds of sections in the map, and tags of encoded values.
MAP = {"header": 0, "string": 1, "type": 2, "proto": 3, "field": 4, "method": 5, "class_def": 6, "map": 0x1000, "type_list": 0x1001, "set_list": 0x1002, "set": 0x1003, "class_data": 0x2000, "code": 0x2001, "string_data": 0x2002, "debug": 0x2003, "annotation": 0x2004, "array": 0x2005, "directory": 0x2006}
INTEGERS = {"byte": 0x00, "short": 0x02, "int": 0x04, "long": 0x06}
INDICES = {"proto": 0x15, "string": 0x17, "type": 0x18, "field": 0x19, "method": 0x1A, "enum": 0x1B}
ALIGNED = {"type_list", "set_list", "set", "code", "directory", "map"}


def uleb(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def sleb(n: int) -> bytes:
    out = bytearray()
    while not -64 <= n < 64:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n & 0x7F])


class Ids:
    """Old ids to new ones; until ``settle`` it notes which are used and gives them back as they are."""

    def __init__(self, dex: Dex):
        self.dex = dex
        self.used: dict[str, set[int]] = {t: set() for t in TABLES}
        self.new: dict[str, dict[int, int]] | None = None

    def row(self, table: str, k: int) -> tuple[int, ...]:
        count, off = self.dex.sizes[table + "s"]
        if k >= count:
            raise ValueError(f"bad {table} index {k}")
        return struct.unpack_from({"proto": "<3I", "field": "<HHI", "method": "<HHI"}.get(table, "<I"), self.dex.data, off + k * WIDTH[table])

    def __call__(self, table: str, k: int) -> int:
        if self.new is not None:
            return self.new[table][k]
        if k not in self.used[table]:
            row = self.row(table, k)
            self.used[table].add(k)
            for other, n in self.parts(table, row):
                self(other, n)
        return k

    def parts(self, table: str, row: tuple[int, ...]) -> list[tuple[str, int]]:
        """What a table's row refers to in turn."""
        if table == "type":
            return [("string", row[0])]
        if table == "proto":
            return [("string", row[0]), ("type", row[1]), *(("type", t) for t in self.dex._types_at(row[2]))]
        if table in ("field", "method"):
            return [("type", row[0]), ("type" if table == "field" else "proto", row[1]), ("string", row[2])]
        return []

    def settle(self) -> None:
        self.new = {t: {old: k for k, old in enumerate(sorted(self.used[t]))} for t in TABLES}


def value(ids: Ids, said: tuple[str, object]) -> bytes:
    kind, v = said
    if kind in INTEGERS:
        size = max(1, (v.bit_length() if v >= 0 else (~v).bit_length()) // 8 + 1)
        return bytes([INTEGERS[kind] | size - 1 << 5]) + v.to_bytes(size, "little", signed=True)
    if kind in ("float", "double"):
        raw = struct.pack("<f" if kind == "float" else "<d", v).lstrip(b"\0") or b"\0"
        return bytes([(0x10 if kind == "float" else 0x11) | len(raw) - 1 << 5]) + raw
    if kind in INDICES or kind == "char":
        n = v if kind == "char" else ids("field" if kind == "enum" else kind, v)
        size = max(1, -(-n.bit_length() // 8))
        return bytes([INDICES.get(kind, 0x03) | size - 1 << 5]) + n.to_bytes(size, "little")
    if kind == "array":
        return b"\x1c" + array(ids, v)
    if kind == "annotation":
        return b"\x1d" + annotation(ids, *v)
    if kind == "boolean":
        return bytes([0x1F | int(v) << 5])
    if kind == "null":
        return b"\x1e"
    raise ValueError(f"a {kind} can't be moved")


def array(ids: Ids, values: list) -> bytes:
    return uleb(len(values)) + b"".join(value(ids, v) for v in values)


def annotation(ids: Ids, kind: int, elements: list) -> bytes:
    return uleb(ids("type", kind)) + uleb(len(elements)) + b"".join(uleb(ids("string", n)) + value(ids, v) for n, v in elements)


def debug(ids: Ids, at: int) -> bytes:
    """A debug stream with its names and types renumbered; all else byte by byte."""
    data, out = ids.dex.data, bytearray()

    def copy(n: int = 1) -> None:
        nonlocal at
        for _ in range(n):
            end = uleb128(data, at)[1]
            out.extend(data[at:end])
            at = end

    def name(table: str) -> None:
        nonlocal at
        k, at = bytecode.uleb128p1(data, at)
        out.extend(uleb(ids(table, k) + 1 if k >= 0 else 0))

    copy()
    count = uleb128(data, at)[0]
    copy()
    for _ in range(count):
        name("string")
    while True:
        op = data[at]
        out.append(op)
        at += 1
        if op == 0:
            return bytes(out)
        if op in (1, 2, 5, 6):
            copy()
        elif op in (3, 4):
            copy()
            for table in ("string", "type", "string")[: op - 1]:
                name(table)
        elif op == 9:
            name("string")


def instructions(ids: Ids, insns: bytes) -> bytes:
    out = bytearray(insns)
    for i in bytecode.sweep(insns):
        if isinstance(i, bytecode.Instruction) and i.index is not None:
            kind = smali.reference_kind(i.op)
            if kind not in TABLES:
                raise ValueError(f"a {kind} can't be moved")
            struct.pack_into("<I" if i.format == "31c" else "<H", out, 2 * i.at + 2, ids(kind, i.index))
            if i.proto is not None:
                struct.pack_into("<H", out, 2 * i.at + 6, ids("proto", i.proto))
    return bytes(out)


class Writer:
    """Sections one after another from a place on; ``put`` gives an item's place."""

    def __init__(self, begin: int):
        self.begin, self.data, self.map = begin, bytearray(), {}

    def put(self, kind: str, raw: bytes) -> int:
        if kind in ALIGNED:
            self.data.extend(bytes(-(self.begin + len(self.data)) % 4))
        at = self.begin + len(self.data)
        count, first = self.map.get(kind, (0, at))
        self.map[kind] = (count + 1, first)
        self.data.extend(raw)
        return at

    def types(self, ids: Ids, listed: list[int]) -> int:
        return self.put("type_list", struct.pack(f"<I{len(listed)}H", len(listed), *(ids("type", t) for t in listed))) if listed else 0


def _annotations(ids: Ids, w: Writer, notes: dict) -> int:
    """The directory of a class's annotations: all items first, then sets, lists of sets, and the directory."""
    groups = [("class", None, notes["class"])] + [(p, k, own) for p in ("fields", "methods") for k, own in sorted(notes[p].items())]
    lists = sorted(notes["parameters"].items())
    if not lists and not any(own for *_, own in groups):
        return 0
    item = lambda visibility, kind, elements: w.put("annotation", bytes([bytecode.VISIBILITY.index(visibility)]) + annotation(ids, kind, elements))
    items = [[item(*a) for a in own] for *_, own in groups]
    of_lists = [[[item(*a) for a in own] for own in sets] for _, sets in lists]
    put_set = lambda offs: w.put("set", struct.pack(f"<I{len(offs)}I", len(offs), *offs)) if offs else 0
    sets = [put_set(x) for x in items]
    list_sets = [[put_set(x) for x in one] for one in of_lists]
    list_offs = [w.put("set_list", struct.pack(f"<I{len(x)}I", len(x), *x)) for x in list_sets]
    rows = {p: [(ids(p[:-1], k), off) for (q, k, _), off in zip(groups, sets, strict=True) if q == p] for p in ("fields", "methods")}
    rows["parameters"] = [(ids("method", k), off) for (k, _), off in zip(lists, list_offs, strict=True)]
    raw = struct.pack("<4I", sets[0], *(len(r) for r in rows.values()))
    return w.put("directory", raw + b"".join(struct.pack("<2I", *x) for r in rows.values() for x in r))


def _code(ids: Ids, w: Writer, code: bytecode.Code, debug_at: int) -> int:
    units = len(code.insns) // 2
    raw = struct.pack("<4H2I", code.registers, code.ins, code.outs, len(code.tries), debug_at, units) + instructions(ids, code.insns)
    if code.tries:
        lists = list(dict.fromkeys(tuple(t.handlers) for t in code.tries))
        said, places = bytearray(uleb(len(lists))), {}
        for handlers in lists:
            places[handlers] = len(said)
            typed = [(t, at) for t, at in handlers if t is not None]
            rest = [at for t, at in handlers if t is None]
            said += sleb(-len(typed) if rest else len(typed)) + b"".join(uleb(ids("type", t)) + uleb(at) for t, at in typed) + b"".join(uleb(at) for at in rest)
        raw += bytes(2 * (units & 1)) + b"".join(struct.pack("<IHH", t.start, t.end - t.start, places[tuple(t.handlers)]) for t in code.tries) + said
    return w.put("code", raw)


def _sections(ids: Ids, w: Writer, k: int, members: list[tuple]) -> bytes:
    """Everything of the class, and its row of class_defs."""
    dex = ids.dex
    cls, flags, parent, interfaces, source, notes, _, values = struct.unpack_from("<8I", dex.data, dex.sizes["class_defs"][1] + 32 * k)
    row = [ids("type", cls), flags, NO_INDEX if parent == NO_INDEX else ids("type", parent), w.types(ids, dex._types_at(interfaces)), NO_INDEX if source == NO_INDEX else ids("string", source)]
    row.append(_annotations(ids, w, bytecode.annotations(dex, notes)))
    offs = sorted({m[4] for m in members if m[4]})
    codes = {off: bytecode.code_item(dex.data, off) for off in offs}
    debugs = {off: w.put("debug", debug(ids, c.debug_off)) if c.debug_off else 0 for off, c in codes.items()}
    places = {off: _code(ids, w, c, debugs[off]) for off, c in codes.items()}
    lists = {kind: [m for m in members if m[1] == kind] for kind in ("static_field", "instance_field", "direct_method", "virtual_method")}
    raw = b"".join(uleb(len(x)) for x in lists.values())
    for kind, listed in lists.items():
        last = 0
        for _, _, index, access, code in listed:
            now = ids(kind.split("_")[1], index)
            raw += uleb(now - last) + uleb(access) + (uleb(places[code] if code else 0) if kind.endswith("method") else b"")
            last = now
    row.append(w.put("class_data", raw) if members else 0)
    row.append(w.put("array", array(ids, bytecode.encoded_array(dex.data, values)[0])) if values else 0)
    return struct.pack("<8I", *row)


def class_dex(dex: Dex, descriptor: str) -> bytes | None:
    """The bytes of a DEX that holds the class alone; None if it isn't defined here. Of several definitions the first one counts."""
    k = next((c[0] for c in dex.class_defs() if c[2] == descriptor), None)
    if k is None:
        return None
    members, ids = [m for m in dex.class_members() if m[0] == k], Ids(dex)
    _sections(ids, Writer(0), k, members)
    ids.settle()
    used = {t: sorted(ids.used[t]) for t in TABLES}
    at, starts = 0x70, {}
    for t in TABLES:
        starts[t] = at if used[t] else 0
        at += WIDTH[t] * len(used[t])
    class_at = at
    w = Writer(at + 32)
    lists = [dex._types_at(ids.row("proto", p)[2]) for p in used["proto"]]
    list_offs = [w.types(ids, x) for x in lists]
    class_row = _sections(ids, w, k, members)
    offs = []
    for s in used["string"]:
        begin = ids.row("string", s)[0]
        offs.append(w.put("string_data", dex.data[begin : dex.data.index(b"\0", uleb128(dex.data, begin)[1]) + 1]))
    tables = struct.pack(f"<{len(offs)}I", *offs)
    tables += b"".join(struct.pack("<I", ids("string", ids.row("type", t)[0])) for t in used["type"])
    for p, off in zip(used["proto"], list_offs, strict=True):
        shorty, result, _ = ids.row("proto", p)
        tables += struct.pack("<3I", ids("string", shorty), ids("type", result), off)
    for t, second in (("field", "type"), ("method", "proto")):
        for n in used[t]:
            cls, other, name = ids.row(t, n)
            tables += struct.pack("<HHI", ids("type", cls), ids(second, other), ids("string", name))
    fixed = {"header": (1, 0)} | {t: (len(used[t]), starts[t]) for t in TABLES if used[t]} | {"class_def": (1, class_at)}
    w.data.extend(bytes(-(w.begin + len(w.data)) % 4))
    map_at = w.begin + len(w.data)
    entries = sorted((off, MAP[kind], n) for kind, (n, off) in (fixed | w.map | {"map": (1, map_at)}).items())
    w.put("map", struct.pack("<I", len(entries)) + b"".join(struct.pack("<HHII", kind, 0, n, off) for off, kind, n in entries))
    size = w.begin + len(w.data)
    head = struct.pack("<6I", size, 0x70, 0x12345678, 0, 0, map_at) + b"".join(struct.pack("<2I", len(used[t]), starts[t]) for t in TABLES)
    rest = head + struct.pack("<4I", 1, class_at, size - w.begin, w.begin) + tables + class_row + bytes(w.data)
    signed = hashlib.sha1(rest).digest() + rest
    return b"dex\n035\0" + struct.pack("<I", zlib.adler32(signed)) + signed
