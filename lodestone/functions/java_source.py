"""Java source text: tokens, highlight spans, places, escapes. Offsets count code points."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import ship

KEYWORDS = frozenset(
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null".split()
)
TOKEN = re.compile(
    r"""(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>"(?:\\.|[^"\\\n])*(?:"|$)|'(?:\\.|[^'\\\n])*(?:'|$))|(?P<annotation>@[^\W\d][\w.$]*)"""
    r"""|(?P<number>\.?\d(?:[eEpP][+-]|[\w.])*)|(?P<identifier>(?:[^\W\d]|\$)[\w$]*)|(?P<symbol>[^\s])""",
    re.S | re.M,
)


def lex(source: str) -> Iterator[tuple[str, int, int]]:
    """(kind, begin, end): comment, string, annotation, number, identifier, keyword or symbol. An unclosed comment goes on to the end, an unclosed literal to its line's."""
    for m in TOKEN.finditer(source):
        kind = m.lastgroup or "symbol"
        yield ("keyword" if kind == "identifier" and m[0] in KEYWORDS else kind), m.start(), m.end()


def spans(source: str) -> list[tuple[str, int, int]]:
    """What an editor paints: keywords, comments, literals and annotations."""
    return [t for t in lex(source) if t[0] in ("keyword", "comment", "string", "annotation")]


def position(source: str, offset: int) -> tuple[int, int]:
    """(line from 1, column from 0) of an offset; beyond the ends, that of the nearest end."""
    starts = [0, *(m.end() for m in re.finditer("\n", source))]
    offset = max(0, min(offset, len(source)))
    line = bisect_right(starts, offset)
    return line, offset - starts[line - 1]


def offset_of(source: str, line: int, column: int) -> int:
    starts = [0, *(m.end() for m in re.finditer("\n", source))]
    begin = starts[max(1, min(line, len(starts))) - 1]
    end = starts[line] - 1 if 1 <= line < len(starts) else len(source)
    return min(begin + max(0, column), end)


def token_at(source: str, offset: int) -> tuple[int, int] | None:
    """The identifier at an offset, or that ends there."""
    edge = None
    for kind, begin, end in lex(source):
        if kind in ("identifier", "annotation") and begin <= offset < end:
            return begin, end
        if kind == "identifier" and end == offset:
            edge = begin, end
    return edge


def method_range(source: str, offset: int) -> tuple[int, int] | None:
    """The innermost method whose text, from its name to its closing brace, holds an offset."""
    tokens = [t for t in lex(source) if t[0] in ("identifier", "keyword", "symbol", "annotation")]
    word = lambda k: source[tokens[k][1] : tokens[k][2]]
    found, braces = None, []
    k, name = 0, None
    while k < len(tokens):
        said = word(k)
        if tokens[k][0] == "identifier" and k + 1 < len(tokens) and word(k + 1) == "(":
            depth, j = 0, k + 1
            while j < len(tokens):
                depth += {"(": 1, ")": -1}.get(word(j), 0)
                j += 1
                if not depth:
                    break
            if j < len(tokens) and word(j) == "throws":
                while j < len(tokens) and word(j) not in ("{", ";"):
                    j += 1
            if j < len(tokens) and word(j) == "{" and not (k and word(k - 1) in ("new", ".")):
                name, k = tokens[k][1], j
                said = "{"
        if said == "{":
            braces.append(name)
            name = None
        elif said == "}" and braces:
            begin = braces.pop()
            if begin is not None and begin <= offset < tokens[k][2] and (found is None or begin > found[0]):
                found = begin, tokens[k][2]
        k += 1
    return found


def rename(source: str, old: str, new: str, within: tuple[int, int] | None = None) -> str:
    """Identifier tokens of a name replaced, in a range if one is given; comments and literals stay."""
    low, high = within or (0, len(source))
    out, at = [], 0
    for kind, begin, end in lex(source):
        if kind == "identifier" and source[begin:end] == old and low <= begin and end <= high:
            out += [source[at:begin], new]
            at = end
    return "".join([*out, source[at:]])


ESCAPES = {"'": "\\'", '"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t"}


def escape(text: str) -> str:
    """A literal's inside: printable ASCII as it is, else ``\\uXXXX`` of the code point."""
    return "".join(ESCAPES.get(c) or (c if " " <= c <= "~" else f"\\u{ord(c):04x}") for c in text)


_UNICODE = re.compile(r"(\\+)(u+)([0-9a-fA-F]{4})")
_PAIR = re.compile("[\ud800-\udbff][\udc00-\udfff]")


def unescape(text: str) -> str:
    """``\\uXXXX`` as characters, pairs of surrogates joined. A backslash that is itself escaped begins none; U+FFFD and lone surrogates stay escaped."""

    def one(m: re.Match) -> str:
        value = int(m[3], 16)
        if len(m[1]) % 2 == 0 or value == 0xFFFD:
            return m[0]
        return m[1][:-1] + chr(value)

    said = _PAIR.sub(lambda m: m[0].encode("utf-16-le", "surrogatepass").decode("utf-16-le"), _UNICODE.sub(one, text))
    return re.sub("[\ud800-\udfff]", lambda m: f"\\u{ord(m[0]):04x}", said)


def tokens(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, kind, token, begin, end) of each row's source; a null has none."""
    ship(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, source in enumerate(batch.column(1)):
                text = source.as_py() or ""
                found = list(lex(text))
                if found:
                    kinds, begins, ends = zip(*found, strict=True)
                    ids = pa.concat_arrays([batch.column(0).slice(k, 1)] * len(found))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(kinds), pa.array([text[b:e] for b, e in zip(begins, ends, strict=True)]), pa.array(begins, pa.int64()), pa.array(ends, pa.int64())], names=["id", "kind", "token", "begin", "end"])

    return df.select(id_col, text_col).mapInArrow(run, f"id {kind}, kind string, token string, begin long, end long")
