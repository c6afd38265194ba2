"""Assembly text of classes, methods and byte ranges."""

from __future__ import annotations

import json
import re
from collections import defaultdict
from collections.abc import Iterator

from . import bytecode as bc
from .codec import Dex

#: Bit, name, and where it can stand: class, field, method.
FLAGS = (
    (0x1, "public", "cfm"), (0x2, "private", "cfm"), (0x4, "protected", "cfm"), (0x8, "static", "cfm"), (0x10, "final", "cfm"), (0x20, "synchronized", "m"), (0x40, "volatile", "f"),
    (0x40, "bridge", "m"), (0x80, "transient", "f"), (0x80, "varargs", "m"), (0x100, "native", "m"), (0x200, "interface", "c"), (0x400, "abstract", "cm"), (0x800, "strictfp", "m"),
    (0x1000, "synthetic", "cfm"), (0x2000, "annotation", "c"), (0x4000, "enum", "cf"), (0x10000, "constructor", "m"), (0x20000, "declared-synchronized", "m"),
)
SIGNATURE = re.compile(r"[^\s()]+\((?:\[*(?:[ZBSCIJFD]|L[^;()]+;))*\)(?:V|\[*(?:[ZBSCIJFD]|L[^;()]+;))")


def flag_names(flags: int, where: str) -> list[str]:
    return [name for bit, name, places in FLAGS if flags & bit and where in places]


def signature(text: str) -> str:
    """``name(parameters)result`` without white space; anything else raises."""
    said = re.sub(r"\s", "", text)
    if not SIGNATURE.fullmatch(said):
        raise ValueError(f"not a method signature: {text!r}")
    return said


def quote(text: str) -> str:
    return json.dumps(text, ensure_ascii=True)


class Names:
    """Texts of a DEX's ids. An id without an entry gives a text that says so."""

    def __init__(self, dex: Dex):
        self.dex = dex
        self.protos = dex.protos()
        self.fields = [f"{c}->{n}:{t}" for _, _, c, n, t in dex.fields()]
        self.members = [(n, d) for _, _, _, n, d in dex.methods()]
        self.methods = [f"{c}->{n}{d}" for _, _, c, n, d in dex.methods()]

    def of(self, kind: str, index: int) -> str:
        if kind == "string":
            return quote(self.dex.string_list[index]) if index < len(self.dex.string_list) else f"invalid string {index}"
        table = {"type": self.dex.type_list, "proto": self.protos, "field": self.fields, "enum": self.fields, "method": self.methods}.get(kind)
        if table is None:
            return f"{kind}@{index}"
        return table[index] if index < len(table) else f"invalid {kind} {index}"

    def value(self, said: tuple[str, object]) -> str:
        kind, value = said
        if kind == "array":
            return "{" + ", ".join(self.value(v) for v in value) + "}"
        if kind == "annotation":
            return f".subannotation {self.of('type', value[0])} {{{', '.join(f'{self.dex.string_list[n]} = {self.value(v)}' for n, v in value[1])}}}"
        if kind == "enum":
            return f".enum {self.of('field', value)}"
        if kind == "char":
            return "'" + quote(chr(value))[1:-1].replace("'", "\\'") + "'"
        if kind in ("boolean", "null"):
            return str(value).lower() if kind == "boolean" else "null"
        if kind in ("byte", "short", "int", "long"):
            return f"{value:#x}{ {'byte': 't', 'short': 's', 'long': 'L'}.get(kind, '') }"
        if kind in ("float", "double"):
            return f"{value!r}{'f' if kind == 'float' else ''}"
        return self.of(kind, value)


def reference_kind(op: int) -> str:
    name = bc.OPCODES[op][0]
    if name.startswith("const-string"):
        return "string"
    if name.startswith(("iget", "iput", "sget", "sput")):
        return "field"
    if name.startswith("invoke-custom"):
        return "call_site"
    if name.startswith("invoke"):
        return "method"
    return {"const-method-handle": "method_handle", "const-method-type": "proto"}.get(name, "type")


def operands(i: bc.Instruction, names: Names, label: str | None = None) -> str:
    said = [f"v{r}" for r in i.registers]
    if i.format in ("35c", "45cc"):
        said = ["{" + ", ".join(said) + "}"]
    elif i.format in ("3rc", "4rcc"):
        said = [f"{{{said[0]} .. {said[-1]}}}" if said else "{}"]
    if i.literal is not None:
        said.append(f"{i.literal:#x}")
    if i.target is not None:
        said.append(f":{label}" if label else f"{i.target - i.at:+#x}")
    if i.index is not None:
        said.append(names.of(reference_kind(i.op), i.index))
    if i.proto is not None:
        said.append(names.of("proto", i.proto))
    return ", ".join(said)


def _branch_labels(items: list) -> tuple[dict[int, str], dict[int, list[str]]]:
    """Label of each branching instruction, and the labels of each place. Branches number their labels by kind: goto, cond, label."""
    by_branch, at_place, count = {}, defaultdict(list), defaultdict(int)
    for i in items:
        if isinstance(i, bc.Instruction) and i.target is not None:
            kind = "goto" if i.name.startswith("goto") else "cond" if i.name.startswith("if-") else "label"
            by_branch[i.at] = f"{kind}_{count[kind]}"
            count[kind] += 1
            at_place[i.target].append(by_branch[i.at])
    return by_branch, at_place


def _try_lines(code: bc.Code, names: Names, at_place: dict[int, list[str]]) -> dict[int, list[str]]:
    """Adds the labels of tries and handlers to ``at_place``; catch directives by the place where a range ends."""
    out, handlers = defaultdict(list), {}
    for k, t in enumerate(code.tries):
        at_place[t.start].append(f"try_start_{k}")
        at_place[t.end].append(f"try_end_{k}")
        for kind, place in t.handlers:
            if place not in handlers:
                handlers[place] = f"{'catchall' if kind is None else 'catch'}_{len(handlers)}"
                at_place[place].append(handlers[place])
            what = ".catchall" if kind is None else f".catch {names.of('type', kind)}"
            out[t.end].append(f"    {what} {{:try_start_{k} .. :try_end_{k}}} :{handlers[place]}")
    return out


def _debug_lines(dex: Dex, off: int) -> dict[int, list[str]]:
    out = defaultdict(list)
    if not off:
        return out
    strings = lambda k: dex.string_list[k] if 0 <= k < len(dex.string_list) else None
    for place, kind, values in bc.debug_events(dex.data, off)[2]:
        if kind == "local":
            register, name, type_, sig = values
            said = f"    .local v{register}"
            said += f", {quote(strings(name))}" if strings(name) is not None else ""
            said += f":{dex.type_list[type_]}" if 0 <= type_ < len(dex.type_list) else ""
            said += f"    # {strings(sig)}" if strings(sig) is not None else ""
        else:
            said = "    ." + {"line": "line ", "end_local": "end local v", "restart_local": "restart local v"}[kind] + str(values[0])
        out[place].append(said)
    return out


def body(dex: Dex, code: bc.Code, names: Names, offsets: bool = False, debug: bool = False) -> Iterator[str]:
    """Lines of a body. offsets: with the byte place before each instruction; debug: with lines and locals."""
    items = list(bc.sweep(code.insns))
    by_branch, at_place = _branch_labels(items)
    payloads = bc.resolve(items)
    cases = {}
    for p in payloads.values():
        cases[p.at] = p
        for k, t in zip(p.keys, p.targets, strict=True):
            label = f"{p.kind[0]}switch_{k}" if k >= 0 else f"{p.kind[0]}switch_m{-k}"
            if label not in at_place[t]:
                at_place[t].append(label)
    caught = _try_lines(code, names, at_place)
    said = _debug_lines(dex, code.debug_off) if debug else {}
    end = items[-1].at + items[-1].units if items else 0
    for i in [*items, None]:
        place = end if i is None else i.at
        yield from said.get(place, [])
        yield from (f"    :{x}" for x in at_place.get(place, []))
        yield from caught.get(place, [])
        if isinstance(i, bc.Instruction):
            if offsets:
                yield f"    # {2 * i.at:08x}  {code.insns[2 * i.at : 2 * (i.at + i.units)].hex(' ')}"
            yield f"    {i.name} {operands(i, names, by_branch.get(i.at))}".rstrip()
        elif i is not None and i.kind == "array":
            yield f"    .array-data {i.width}"
            yield from (f"        {int.from_bytes(i.data[k : k + i.width], 'little', signed=True):#x}" for k in range(0, len(i.data), i.width or 1))
            yield "    .end array-data"
        elif i is not None:
            p = cases.get(i.at, i)
            yield f"    .{p.kind}-switch"
            yield from (f"        {k:#x} -> :{p.kind[0]}switch_{k if k >= 0 else f'm{-k}'}" for k in p.keys)
            yield f"    .end {p.kind}-switch"


def _annotation_lines(listed: list[tuple], names: Names, margin: str) -> Iterator[str]:
    for visibility, kind, elements in listed:
        yield f"{margin}.annotation {visibility} {names.of('type', kind)}"
        yield from (f"{margin}    {names.dex.string_list[n]} = {names.value(v)}" for n, v in elements)
        yield f"{margin}.end annotation"


def method(dex: Dex, names: Names, index: int, flags: int, code_off: int, notes: dict, offsets: bool = False, debug: bool = False) -> Iterator[str]:
    name, descriptor = names.members[index]
    listed = flag_names(flags, "m")
    yield f"## METHOD: {' '.join(listed)} {name} {descriptor}"
    if name in ("<init>", "<clinit>") and "constructor" not in listed:
        listed.append("constructor")
    yield " ".join([".method", *listed, f"{name}{descriptor}"])
    code = bc.code_item(dex.data, code_off) if code_off else None
    if code:
        yield f"    .locals {max(0, code.registers - code.ins)}"
    yield from _annotation_lines(notes["methods"].get(index, []), names, "    ")
    for k, own in enumerate(notes["parameters"].get(index, [])):
        if own:
            yield f"    .param p{k}"
            yield from _annotation_lines(own, names, "        ")
            yield "    .end param"
    if code:
        yield from body(dex, code, names, offsets, debug)
    yield ".end method"


def classes(dex: Dex, wanted: str | None = None, only: str | None = None, offsets: bool = False, debug: bool = False) -> Iterator[tuple[str, str | None, list[str]]]:
    """(class, method label or None, lines): each class's head with its fields, then each of its methods.

    wanted: one class's descriptor; only: one method's signature, which must be found.
    """
    only = signature(only) if only else None
    names, found = Names(dex), False
    for c in bc.class_defs(dex):
        if wanted and c.descriptor != wanted:
            continue
        head = [f"# CLASS: {c.descriptor}", " ".join([".class", *flag_names(c.flags, "c"), c.descriptor])]
        head += [f".super {c.parent}"] if c.parent else []
        head += [f".implements {x}" for x in c.interfaces]
        head += [f".source {quote(c.source)}"] if c.source is not None else []
        head += _annotation_lines(c.annotations["class"], names, "")
        for index, flags, _, value in c.fields:
            head += _annotation_lines(c.annotations["fields"].get(index, []), names, "    ")
            said = names.fields[index].partition("->")[2]
            head.append("    " + " ".join([".field", *flag_names(flags, "f"), said]) + (f" = {names.value(value)}" if value else ""))
        yield c.descriptor, None, head
        for index, flags, code in c.methods:
            label = "".join(names.members[index])
            if only in (None, label):
                found = True
                yield c.descriptor, label, list(method(dex, names, index, flags, code, c.annotations, offsets, debug))
    if only and not found:
        raise ValueError(f"no method {only}")


def span(dex: Dex, offset: int, size: int) -> Iterator[str]:
    """Instructions of a byte range, with their offsets."""
    names = Names(dex)
    for i in bc.sweep(dex.data[offset : offset + size]):
        if isinstance(i, bc.Instruction):
            yield f"{offset + 2 * i.at:08x}  {i.name} {operands(i, names)}".rstrip()

