"""Instructions and code items of DEX bytes: registers, literals, references, branches, tries, debug events, encoded values.

Everything follows from the public format description. Names and formats of opcodes are made from its families by rule.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

from .codec import NO_INDEX, Dex, sleb128, uleb128

_BINARY = "add sub mul div rem and or xor shl shr ushr".split()
_TYPES = ["", "-wide", "-object", "-boolean", "-byte", "-char", "-short"]
_CASTS = "int-to-long int-to-float int-to-double long-to-int long-to-float long-to-double float-to-int float-to-long float-to-double double-to-int double-to-long double-to-float int-to-byte int-to-char int-to-short".split()


def _instruction_set() -> dict[int, tuple[str, str]]:
    """Opcode -> (name, format)."""
    out: dict[int, tuple[str, str]] = {}

    def put(first: int, names: list[str], form: str) -> None:
        out.update({first + k: (n, form) for k, n in enumerate(names)})

    put(0x00, ["nop"], "10x")
    for k, kind in enumerate(("", "-wide", "-object")):
        for j, (tail, form) in enumerate((("", "12x"), ("/from16", "22x"), ("/16", "32x"))):
            put(0x01 + 3 * k + j, [f"move{kind}{tail}"], form)
    put(0x0A, ["move-result", "move-result-wide", "move-result-object", "move-exception"], "11x")
    put(0x0E, ["return-void"], "10x")
    put(0x0F, ["return", "return-wide", "return-object"], "11x")
    for k, (name, form) in enumerate((("const/4", "11n"), ("const/16", "21s"), ("const", "31i"), ("const/high16", "21h"), ("const-wide/16", "21s"), ("const-wide/32", "31i"), ("const-wide", "51l"), ("const-wide/high16", "21h"), ("const-string", "21c"), ("const-string/jumbo", "31c"), ("const-class", "21c"))):
        put(0x12 + k, [name], form)
    put(0x1D, ["monitor-enter", "monitor-exit"], "11x")
    for k, (name, form) in enumerate((("check-cast", "21c"), ("instance-of", "22c"), ("array-length", "12x"), ("new-instance", "21c"), ("new-array", "22c"), ("filled-new-array", "35c"), ("filled-new-array/range", "3rc"), ("fill-array-data", "31t"), ("throw", "11x"), ("goto", "10t"), ("goto/16", "20t"), ("goto/32", "30t"), ("packed-switch", "31t"), ("sparse-switch", "31t"))):
        put(0x1F + k, [name], form)
    put(0x2D, ["cmpl-float", "cmpg-float", "cmpl-double", "cmpg-double", "cmp-long"], "23x")
    put(0x32, [f"if-{c}" for c in "eq ne lt ge gt le".split()], "22t")
    put(0x38, [f"if-{c}z" for c in "eq ne lt ge gt le".split()], "21t")
    put(0x44, [f"{v}{t}" for v in ("aget", "aput") for t in _TYPES], "23x")
    put(0x52, [f"{v}{t}" for v in ("iget", "iput") for t in _TYPES], "22c")
    put(0x60, [f"{v}{t}" for v in ("sget", "sput") for t in _TYPES], "21c")
    calls = [f"invoke-{c}" for c in "virtual super direct static interface".split()]
    put(0x6E, calls, "35c")
    put(0x74, [f"{c}/range" for c in calls], "3rc")
    put(0x7B, [f"{v}-{t}" for t in ("int", "long") for v in ("neg", "not")] + ["neg-float", "neg-double", *_CASTS], "12x")
    typed = [f"{b}-{t}" for t in ("int", "long") for b in _BINARY] + [f"{b}-{t}" for t in ("float", "double") for b in _BINARY[:5]]
    put(0x90, typed, "23x")
    put(0xB0, [f"{n}/2addr" for n in typed], "12x")
    literal = ["add", "rsub", *_BINARY[2:8]]
    put(0xD0, ["rsub-int" if b == "rsub" else f"{b}-int/lit16" for b in literal], "22s")
    put(0xD8, [f"{b}-int/lit8" for b in [*literal, *_BINARY[8:]]], "22b")
    put(0xFA, ["invoke-polymorphic"], "45cc")
    put(0xFB, ["invoke-polymorphic/range"], "4rcc")
    put(0xFC, ["invoke-custom"], "35c")
    put(0xFD, ["invoke-custom/range"], "3rc")
    put(0xFE, ["const-method-handle", "const-method-type"], "21c")
    return out


OPCODES = _instruction_set()
ENDS = frozenset(op for op, (n, _) in OPCODES.items() if n.startswith(("return", "throw", "goto")))
THROWS = frozenset(
    op
    for op, (n, _) in OPCODES.items()
    if n.startswith(("const-string", "const-class", "const-method", "monitor", "check-cast", "instance-of", "array-length", "new-", "filled-", "throw", "aget", "aput", "iget", "iput", "sget", "sput", "invoke", "div-int", "rem-int", "div-long", "rem-long"))
)


@dataclass
class Instruction:
    """One instruction. Places count 16-bit units; ``target`` is a place, ``payload`` what a switch or array instruction points to."""

    at: int
    op: int
    units: int
    registers: list[int] = field(default_factory=list)
    literal: int | None = None
    target: int | None = None
    index: int | None = None
    proto: int | None = None

    @property
    def name(self) -> str:
        return OPCODES[self.op][0]

    @property
    def format(self) -> str:
        return OPCODES[self.op][1]


@dataclass
class Payload:
    """Data between instructions: kind packed (keys follow from the first), sparse or array."""

    at: int
    kind: str
    units: int
    keys: list[int]
    targets: list[int]
    width: int = 0
    data: bytes = b""


def _instruction(code: bytes, at: int) -> Instruction:
    unit = struct.unpack_from("<H", code, 2 * at)[0]
    op, high = unit & 0xFF, unit >> 8
    if op not in OPCODES:
        raise ValueError(f"no instruction at unit {at}")
    form = OPCODES[op][1]
    units = int(form[0])
    if 2 * (at + units) > len(code):
        raise ValueError(f"the instruction at unit {at} is cut")
    word = lambda k, kind="H": struct.unpack_from("<" + kind, code, 2 * (at + k))[0]
    i = Instruction(at, op, units)
    if form in ("12x", "22c", "22t", "22s"):
        i.registers = [high & 15, high >> 4]
    elif form in ("22x", "21c", "21s", "21h", "21t", "31i", "31t", "31c", "51l", "11x"):
        i.registers = [high]
    if form == "11n":
        i.registers, i.literal = [high & 15], ((high >> 4) ^ 8) - 8
    elif form == "22x":
        i.registers.append(word(1))
    elif form == "32x":
        i.registers = [word(1), word(2)]
    elif form == "23x":
        i.registers = [high, word(1) & 255, word(1) >> 8]
    elif form == "22b":
        i.registers, i.literal = [high, word(1) & 255], struct.unpack_from("<b", code, 2 * at + 3)[0]
    elif form in ("21s", "22s"):
        i.literal = word(1, "h")
    elif form == "21h":
        i.literal = word(1, "h") << (16 if op == 0x15 else 48)
    elif form == "31i":
        i.literal = word(1, "i")
    elif form == "51l":
        i.literal = word(1, "q")
    elif form == "10t":
        i.target = at + ((high ^ 128) - 128)
    elif form in ("20t", "21t", "22t"):
        i.target = at + word(1, "h")
    elif form in ("30t", "31t"):
        i.target = at + word(1, "i")
    elif form == "31c":
        i.index = word(1, "I")
    elif form in ("21c", "22c"):
        i.index = word(1)
    elif form in ("35c", "45cc"):
        count, low = high >> 4, word(2)
        i.registers = [*(low >> s & 15 for s in (0, 4, 8, 12)), high & 15][:count]
        i.index = word(1)
    elif form in ("3rc", "4rcc"):
        i.registers = list(range(word(2), word(2) + high))
        i.index = word(1)
    if form in ("45cc", "4rcc"):
        i.proto = word(3)
    return i


def sweep(code: bytes) -> Iterator[Instruction | Payload]:
    """A body's instructions and payloads in order. A payload's targets count from itself; ``resolve`` makes places of them."""
    at, size = 0, len(code) // 2
    while at < size:
        ident = struct.unpack_from("<H", code, 2 * at)[0]
        if ident in (0x0100, 0x0200, 0x0300) and at + 4 <= size:
            count = struct.unpack_from("<H", code, 2 * at + 2)[0]
            if ident == 0x0100:
                first, *targets = struct.unpack_from(f"<{count + 1}i", code, 2 * at + 4)
                item: Instruction | Payload = Payload(at, "packed", 4 + 2 * count, list(range(first, first + count)), targets)
            elif ident == 0x0200:
                both = struct.unpack_from(f"<{2 * count}i", code, 2 * at + 4)
                item = Payload(at, "sparse", 2 + 4 * count, list(both[:count]), list(both[count:]))
            else:
                n = struct.unpack_from("<I", code, 2 * at + 4)[0]
                item = Payload(at, "array", 4 + (count * n + 1) // 2, [], [], count, code[2 * at + 8 : 2 * at + 8 + count * n])
        else:
            item = _instruction(code, at)
        yield item
        at += item.units


def resolve(items: list[Instruction | Payload]) -> dict[int, Payload]:
    """Payloads by the place of the instruction that uses them, with their targets as places."""
    by_place = {p.at: p for p in items if isinstance(p, Payload)}
    out = {}
    for i in items:
        if isinstance(i, Instruction) and i.format == "31t" and i.target in by_place:
            p = by_place[i.target]
            out[i.at] = Payload(p.at, p.kind, p.units, p.keys, [i.at + t for t in p.targets], p.width, p.data)
    return out


@dataclass
class Try:
    """A covered range and its handlers, (type index or None for all, place), in order."""

    start: int
    end: int
    handlers: list[tuple[int | None, int]]


@dataclass
class Code:
    registers: int
    ins: int
    outs: int
    debug_off: int
    insns: bytes
    begin: int
    tries: list[Try]


def code_item(data: bytes, off: int) -> Code:
    registers, ins, outs, tries, debug, units = struct.unpack_from("<4H2I", data, off)
    begin = off + 16
    end = begin + 2 * units
    if end > len(data):
        raise ValueError(f"the code at {off} ends beyond the file")
    listed = []
    if tries:
        table = end + 2 * (units & 1)
        base = table + 8 * tries
        for k in range(tries):
            start, count, handler = struct.unpack_from("<IHH", data, table + 8 * k)
            listed.append(Try(start, start + count, _handlers(data, base + handler)))
    return Code(registers, ins, outs, debug, data[begin:end], begin, listed)


def _handlers(data: bytes, at: int) -> list[tuple[int | None, int]]:
    size, at = sleb128(data, at)
    out: list[tuple[int | None, int]] = []
    for _ in range(abs(size)):
        kind, at = uleb128(data, at)
        place, at = uleb128(data, at)
        out.append((kind, place))
    if size <= 0:
        out.append((None, uleb128(data, at)[0]))
    return out


def uleb128p1(data: bytes, at: int) -> tuple[int, int]:
    """A ULEB128 less one; zero stands for -1."""
    value, at = uleb128(data, at)
    return value - 1, at


def debug_events(data: bytes, off: int) -> tuple[int, list[int], list[tuple]]:
    """First line, parameter names (string indices, -1 for none), and events (place, kind, values) in order.

    Kinds: line (number), local (register, name, type, signature), end_local and restart_local (register).
    """
    line, at = uleb128(data, off)
    count, at = uleb128(data, at)
    names = []
    for _ in range(count):
        name, at = uleb128p1(data, at)
        names.append(name)
    first, address, out = line, 0, []
    while data[at]:
        op = data[at]
        at += 1
        if op == 1:
            step, at = uleb128(data, at)
            address += step
        elif op == 2:
            step, at = sleb128(data, at)
            line += step
        elif op in (3, 4):
            register, at = uleb128(data, at)
            said = []
            for _ in range(op - 1):
                value, at = uleb128p1(data, at)
                said.append(value)
            out.append((address, "local", (register, *said, *([-1] if op == 3 else []))))
        elif op in (5, 6):
            register, at = uleb128(data, at)
            out.append((address, "end_local" if op == 5 else "restart_local", (register,)))
        elif op == 9:
            _, at = uleb128p1(data, at)
        elif op >= 10:
            address += (op - 10) // 15
            line += (op - 10) % 15 - 4
            out.append((address, "line", (line,)))
    return first, names, out


def encoded_value(data: bytes, at: int) -> tuple[tuple[str, object], int]:
    """((kind, value), where it ends). Kinds of references have an index; array has a list of values; annotation (type, [(name, value)])."""
    tag = data[at]
    kind, size = tag & 0x1F, (tag >> 5) + 1
    at += 1
    raw = data[at : at + size]
    signed = {0x00: "byte", 0x02: "short", 0x04: "int", 0x06: "long"}
    index = {0x15: "proto", 0x16: "method_handle", 0x17: "string", 0x18: "type", 0x19: "field", 0x1A: "method", 0x1B: "enum"}
    if kind in signed:
        return (signed[kind], int.from_bytes(raw, "little", signed=True)), at + size
    if kind == 0x03:
        return ("char", int.from_bytes(raw, "little")), at + size
    if kind == 0x10:
        return ("float", struct.unpack("<f", raw.rjust(4, b"\0"))[0]), at + size
    if kind == 0x11:
        return ("double", struct.unpack("<d", raw.rjust(8, b"\0"))[0]), at + size
    if kind in index:
        return (index[kind], int.from_bytes(raw, "little")), at + size
    if kind == 0x1C:
        values, at = encoded_array(data, at)
        return ("array", values), at
    if kind == 0x1D:
        said, at = encoded_annotation(data, at)
        return ("annotation", said), at
    if kind == 0x1E:
        return ("null", None), at
    if kind == 0x1F:
        return ("boolean", bool(tag >> 5)), at
    raise ValueError(f"no encoded value of kind {kind:#x} at {at - 1}")


def encoded_array(data: bytes, at: int) -> tuple[list[tuple[str, object]], int]:
    count, at = uleb128(data, at)
    out = []
    for _ in range(count):
        value, at = encoded_value(data, at)
        out.append(value)
    return out, at


def encoded_annotation(data: bytes, at: int) -> tuple[tuple[int, list[tuple[int, tuple]]], int]:
    kind, at = uleb128(data, at)
    count, at = uleb128(data, at)
    out = []
    for _ in range(count):
        name, at = uleb128(data, at)
        value, at = encoded_value(data, at)
        out.append((name, value))
    return (kind, out), at


VISIBILITY = ("build", "runtime", "system")


def annotations(dex: Dex, off: int) -> dict[str, object]:
    """A class's annotations_directory: ``class`` a list, ``fields``, ``methods`` and ``parameters`` by index. One annotation is (visibility, type, elements)."""
    out: dict[str, object] = {"class": [], "fields": {}, "methods": {}, "parameters": {}}
    if not off:
        return out
    data = dex.data
    own, fields, methods, parameters = struct.unpack_from("<4I", data, off)
    out["class"] = _annotation_set(data, own)
    at = off + 16
    for name, count in (("fields", fields), ("methods", methods), ("parameters", parameters)):
        for _ in range(count):
            index, where = struct.unpack_from("<2I", data, at)
            at += 8
            if name == "parameters":
                sets = struct.unpack_from(f"<{struct.unpack_from('<I', data, where)[0]}I", data, where + 4)
                out[name][index] = [_annotation_set(data, s) for s in sets]
            else:
                out[name][index] = _annotation_set(data, where)
    return out


def _annotation_set(data: bytes, off: int) -> list[tuple]:
    if not off:
        return []
    out = []
    for where in struct.unpack_from(f"<{struct.unpack_from('<I', data, off)[0]}I", data, off + 4):
        said, _ = encoded_annotation(data, where + 1)
        out.append((VISIBILITY[data[where]] if data[where] < 3 else str(data[where]), *said))
    return out


@dataclass
class ClassDef:
    ordinal: int
    descriptor: str
    flags: int
    parent: str | None
    interfaces: list[str]
    source: str | None
    annotations: dict
    fields: list[tuple[int, int, bool, tuple | None]]  # index, flags, static, first value
    methods: list[tuple[int, int, int]]  # index, flags, code offset


def class_defs(dex: Dex) -> Iterator[ClassDef]:
    """Classes with their sections; each is decoded by itself."""
    data = dex.data
    members: dict[int, list[tuple]] = {}
    for m in dex.class_members():
        members.setdefault(m[0], []).append(m)
    count, table = dex.sizes["class_defs"]
    for k in range(count):
        cls, flags, parent, interfaces, source, notes, _, values = struct.unpack_from("<8I", data, table + 32 * k)
        first = encoded_array(data, values)[0] if values else []
        fields, methods, static = [], [], 0
        for _, kind, index, access, code in members.get(k, []):
            if kind.endswith("method"):
                methods.append((index, access, code))
                continue
            is_static = kind == "static_field"
            fields.append((index, access, is_static, first[static] if is_static and static < len(first) else None))
            static += is_static
        named = lambda i: None if i == NO_INDEX else dex.type_list[i]
        said = None if source == NO_INDEX else dex.string_list[source]
        yield ClassDef(k, named(cls) or "", flags, named(parent), [dex.type_list[i] for i in dex._types_at(interfaces)], said, annotations(dex, notes), fields, methods)
