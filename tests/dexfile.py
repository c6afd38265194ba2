"""A writer of small DEX files, from the public format description."""

from __future__ import annotations

import struct


def uleb(n: int) -> bytes:
    out = bytearray()
    while True:
        out.append(n & 0x7F | (0x80 if n > 0x7F else 0))
        n >>= 7
        if not n:
            return bytes(out)


def build(strings: list[bytes], types: list[int], protos: list[tuple[int, int, list[int]]], fields: list[tuple], methods: list[tuple], classes: list[dict], bodies: list[bytes]) -> bytes:
    """classes: type, flags, super, interfaces, methods: [(method, flags, body)]; all numbers are indices."""
    counts = [(len(strings), 4), (len(types), 4), (len(protos), 12), (len(fields), 8), (len(methods), 8), (len(classes), 32)]
    offs, at = [], 0x70
    for n, width in counts:
        offs.append(at if n else 0)
        at += n * width
    data = bytearray()

    def put(raw: bytes, align: int = 1) -> int:
        while (at + len(data)) % align:
            data.append(0)
        data.extend(raw)
        return at + len(data) - len(raw)

    type_list = lambda x: put(struct.pack(f"<I{len(x)}H", len(x), *x), 4) if x else 0
    string_offs = [put(uleb(len(s)) + s + b"\0") for s in strings]
    proto_rows = b"".join(struct.pack("<3I", a, b, type_list(c)) for a, b, c in protos)
    code = [put(struct.pack("<4H2I", 2, 0, 0, 0, 0, len(b) // 2) + b, 4) for b in bodies]
    class_rows = b""
    for c in classes:
        interfaces = type_list(c.get("interfaces", []))
        listed, last = b"", 0
        for m, flags, body in c.get("methods", []):
            listed += uleb(m - last) + uleb(flags) + uleb(code[body])
            last = m
        off = put(uleb(0) * 2 + uleb(len(c["methods"])) + uleb(0) + listed) if c.get("methods") else 0
        class_rows += struct.pack("<8I", c["type"], c.get("flags", 1), c.get("super", 0xFFFFFFFF), interfaces, 0xFFFFFFFF, 0, off, 0)
    ids = struct.pack(f"<{len(strings)}I", *string_offs) + struct.pack(f"<{len(types)}I", *types) + proto_rows
    ids += b"".join(struct.pack("<HHI", *f) for f in fields) + b"".join(struct.pack("<HHI", *m) for m in methods) + class_rows
    head = b"dex\n035\0" + bytes(24) + struct.pack("<6I", at + len(data), 0x70, 0x12345678, 0, 0, 0)
    head += b"".join(struct.pack("<2I", n, o) for (n, _), o in zip(counts, offs, strict=True)) + struct.pack("<2I", len(data), at)
    return head + ids + bytes(data)


def two_methods() -> bytes:
    """``first`` and ``second`` share one body: const-string "token"; return-void. Behind it stands a switch payload that looks like a reference."""
    strings = [b"Lexample/Test;", b"Ljava/lang/Object;", b"V", b"first", b"second", b"token"]
    body = bytes.fromhex("1a000500") + bytes.fromhex("0e00") + bytes.fromhex("0000") + bytes.fromhex("0001 0100 1a000500 1a000500".replace(" ", ""))
    classes = [{"type": 0, "super": 1, "methods": [(0, 1, 0), (1, 1, 0)]}]
    return build(strings, [0, 1, 2], [(2, 2, [])], [], [(0, 0, 3), (0, 0, 4)], classes, [body])


def calls() -> bytes:
    """``Lexample/Test;->run()V`` invokes a method of a class that isn't defined, and reads a field."""
    strings = [b"I", b"Lexample/Target;", b"Lexample/Test;", b"V", b"VI", b"call", b"run", b"size"]
    body = bytes.fromhex("71000000 0000".replace(" ", "")) + bytes.fromhex("52000000") + bytes.fromhex("0e00")
    return build(strings, [0, 1, 2, 3], [(3, 3, []), (4, 3, [0])], [(2, 0, 7)], [(1, 1, 5), (2, 0, 6)], [{"type": 2, "interfaces": [1], "methods": [(1, 9, 0)]}], [body])
