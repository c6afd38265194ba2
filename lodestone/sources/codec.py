"""Decoding of DEX bytes, from the public format description. Plain functions over ``bytes``; they run in executors."""

from __future__ import annotations

import struct
from collections.abc import Iterator

NO_INDEX = 0xFFFFFFFF
#: Opcode ranges (first, last) and their length in 16-bit units. Opcodes out of all ranges are unused.
UNITS = (
    (0x00, 0x01, 1), (0x02, 0x02, 2), (0x03, 0x03, 3), (0x04, 0x04, 1), (0x05, 0x05, 2), (0x06, 0x06, 3), (0x07, 0x07, 1), (0x08, 0x08, 2), (0x09, 0x09, 3), (0x0A, 0x12, 1),
    (0x13, 0x13, 2), (0x14, 0x14, 3), (0x15, 0x16, 2), (0x17, 0x17, 3), (0x18, 0x18, 5), (0x19, 0x1A, 2), (0x1B, 0x1B, 3), (0x1C, 0x1C, 2), (0x1D, 0x1E, 1), (0x1F, 0x20, 2),
    (0x21, 0x21, 1), (0x22, 0x23, 2), (0x24, 0x26, 3), (0x27, 0x28, 1), (0x29, 0x29, 2), (0x2A, 0x2C, 3), (0x2D, 0x3D, 2), (0x44, 0x6D, 2), (0x6E, 0x72, 3), (0x74, 0x78, 3),
    (0x7B, 0x8F, 1), (0x90, 0xAF, 2), (0xB0, 0xCF, 1), (0xD0, 0xE2, 2), (0xFA, 0xFB, 4), (0xFC, 0xFD, 3), (0xFE, 0xFF, 2),
)
#: Opcode ranges whose second unit is an index, and into which table.
REFERENCES = ((0x1A, 0x1B, "string"), (0x1C, 0x1C, "type"), (0x1F, 0x20, "type"), (0x22, 0x25, "type"), (0x52, 0x6D, "field"), (0x6E, 0x72, "method"), (0x74, 0x78, "method"), (0xFA, 0xFB, "method"))
LENGTH = {op: n for a, b, n in UNITS for op in range(a, b + 1)}
KIND = {op: kind for a, b, kind in REFERENCES for op in range(a, b + 1)}


def uleb128(data: bytes, at: int) -> tuple[int, int]:
    """Value, and where the next one begins."""
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 0x7F) << shift
        if byte < 0x80:
            return value, at
        shift += 7
        if shift > 28:
            raise ValueError(f"LEB128 of more than five bytes before {at}")


def sleb128(data: bytes, at: int) -> tuple[int, int]:
    begin = at
    value, at = uleb128(data, at)
    bits = 7 * (at - begin)
    return (value - (1 << bits) if value >> (bits - 1) & 1 else value), at


def mutf8(raw: bytes) -> str:
    """Modified UTF-8: C0 80 is NUL, and characters beyond the base plane are two surrogates. Broken bytes become U+FFFD."""
    try:
        text = raw.replace(b"\xc0\x80", b"\0").decode("utf-8", "surrogatepass")
    except UnicodeDecodeError:
        return raw.decode("utf-8", "replace")
    return text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


def code_units(insns: bytes) -> Iterator[tuple[int, int, str | None, int | None]]:
    """(offset in units, opcode, kind of reference, index) of a body's instructions. Switch and array payloads are stepped over."""
    at, size = 0, len(insns) // 2
    while at < size:
        unit = struct.unpack_from("<H", insns, 2 * at)[0]
        if unit in (0x0100, 0x0200, 0x0300) and at + 2 <= size:
            count = struct.unpack_from("<H", insns, 2 * at + 2)[0]
            if unit == 0x0100:
                at += 4 + 2 * count
            elif unit == 0x0200:
                at += 2 + 4 * count
            else:
                at += 4 + (count * struct.unpack_from("<I", insns, 2 * at + 4)[0] + 1) // 2
            continue
        op = unit & 0xFF
        units = LENGTH.get(op)
        if units is None or at + units > size:
            raise ValueError(f"no instruction at unit {at}")
        kind = KIND.get(op)
        index = None if kind is None else struct.unpack_from("<I" if op == 0x1B else "<H", insns, 2 * at + 2)[0]
        yield at, op, kind, index
        at += units


class Dex:
    """Tables of one logical DEX, decoded when they are asked for. Offsets count from the beginning of the container."""

    def __init__(self, data: bytes, base: int = 0):
        if data[base : base + 4] != b"dex\n" or data[base + 7] != 0:
            raise ValueError("not a DEX file")
        self.data = data
        numbers = struct.unpack_from("<14I", data, base + 56)
        self.sizes = dict(zip(("strings", "types", "protos", "fields", "methods", "class_defs"), zip(numbers[::2], numbers[1::2], strict=True), strict=False))
        self.string_list = [self._string(struct.unpack_from("<I", data, at)[0]) for at in self._rows("strings", 4)]
        self.type_list = [self._at(self.string_list, struct.unpack_from("<I", data, at)[0], "type string") for at in self._rows("types", 4)]

    def _rows(self, table: str, width: int) -> range:
        count, off = self.sizes[table]
        if count and off + count * width > len(self.data):
            raise ValueError(f"table {table} ends beyond the file")
        return range(off, off + count * width, width)

    @staticmethod
    def _at(values: list[str], index: int, what: str) -> str:
        if index >= len(values):
            raise ValueError(f"bad {what} index {index}")
        return values[index]

    def _string(self, off: int) -> str:
        _, begin = uleb128(self.data, off)
        end = self.data.find(b"\0", begin)
        if end < 0:
            raise ValueError(f"string at {off} has no end")
        return mutf8(self.data[begin:end])

    def _types_at(self, off: int) -> list[int]:
        return list(struct.unpack_from(f"<{struct.unpack_from('<I', self.data, off)[0]}H", self.data, off + 4)) if off else []

    def strings(self) -> Iterator[tuple]:
        yield from enumerate(self.string_list)

    def types(self) -> Iterator[tuple]:
        yield from enumerate(self.type_list)

    def protos(self) -> list[str]:
        out = []
        for at in self._rows("protos", 12):
            _, result, parameters = struct.unpack_from("<3I", self.data, at)
            listed = "".join(self._at(self.type_list, t, "parameter") for t in self._types_at(parameters))
            out.append(f"({listed}){self._at(self.type_list, result, 'return type')}")
        return out

    def fields(self) -> Iterator[tuple]:
        for k, at in enumerate(self._rows("fields", 8)):
            cls, kind, name = struct.unpack_from("<HHI", self.data, at)
            yield k, cls, self._at(self.type_list, cls, "class"), self._at(self.string_list, name, "name"), self._at(self.type_list, kind, "type")

    def methods(self) -> Iterator[tuple]:
        protos = self.protos()
        for k, at in enumerate(self._rows("methods", 8)):
            cls, proto, name = struct.unpack_from("<HHI", self.data, at)
            yield k, cls, self._at(self.type_list, cls, "class"), self._at(self.string_list, name, "name"), self._at(protos, proto, "prototype")

    def class_defs(self) -> Iterator[tuple]:
        for k, at in enumerate(self._rows("class_defs", 32)):
            cls, flags, parent, interfaces = struct.unpack_from("<4I", self.data, at)
            yield k, cls, self._at(self.type_list, cls, "class_def->type_idx"), flags, None if parent == NO_INDEX else parent, self._types_at(interfaces)

    def class_members(self) -> Iterator[tuple]:
        for k, at in enumerate(self._rows("class_defs", 32)):
            off = struct.unpack_from("<I", self.data, at + 24)[0]
            if not off:
                continue
            counts = []
            for _ in range(4):
                n, off = uleb128(self.data, off)
                counts.append(n)
            for kind, n in zip(("static_field", "instance_field", "direct_method", "virtual_method"), counts, strict=True):
                index = 0
                for _ in range(n):
                    step, off = uleb128(self.data, off)
                    flags, off = uleb128(self.data, off)
                    index += step
                    code = 0
                    if kind.endswith("method"):
                        code, off = uleb128(self.data, off)
                    yield k, kind, index, flags, code

    def refs(self) -> Iterator[tuple]:
        """Instructions with a reference, of each body once however many methods share it."""
        for code in sorted({m[4] for m in self.class_members() if m[4]}):
            size = struct.unpack_from("<I", self.data, code + 12)[0]
            for at, op, kind, index in code_units(self.data[code + 16 : code + 16 + 2 * size]):
                if kind:
                    yield code, at, op, kind, index


def logical(data: bytes, entry: str) -> Iterator[tuple[int, str, Dex]]:
    """(ordinal, name, DEX) of an entry: one, or several in a container of version 041."""
    if data[:8] != b"dex\n041\0":
        yield 0, entry, Dex(data)
        return
    begins, at = [], 0
    while at + 0x70 <= len(data):
        size = struct.unpack_from("<I", data, at + 32)[0]
        if size < 0x70:
            raise ValueError(f"bad size of the DEX at {at}")
        begins.append(at)
        at += size
    for k, begin in enumerate(begins):
        yield k, f"{entry}!classes{k + 1 if k else ''}.dex" if len(begins) > 1 else entry, Dex(data, begin)
