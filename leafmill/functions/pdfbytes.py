"""Title of a PDF's information dictionary: literal strings in raw bytes (Arrow UDF)."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ESCAPED = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
#: One step of a literal string: an escape, a run of plain bytes, or a parenthesis.
_TOKEN = re.compile(rb"\\(?:([0-7]{1,3})|(\r\n|\r|\n)|(.))|([^\\()]+)|(\()|(\))", re.DOTALL)


def literal_after(marker: bytes, data: bytes) -> str | None:
    """The string in balanced parentheses behind the first marker, decoded; None if there is none."""
    at = data.find(marker)
    opening = re.compile(rb"[ \t\r\n]*\(").match(data, at + len(marker)) if at >= 0 else None
    if not opening:
        return None
    out, depth, at = bytearray(), 1, opening.end()
    while token := _TOKEN.match(data, at):
        octal, newline, escaped, plain, opened, closed = token.groups()
        at = token.end()
        if closed:
            depth -= 1
            if not depth:
                return _decoded(bytes(out))
            out += closed
        elif octal:
            out.append(int(octal, 8) & 0xFF)
        elif escaped:
            out += _ESCAPED.get(escaped, escaped)
        elif not newline:
            depth += bool(opened)
            out += plain or opened
    return None


def _decoded(raw: bytes) -> str:
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("latin-1")


@F.pandas_udf(T.StringType())
def info_title(content: pd.Series) -> pd.Series:
    return content.map(lambda data: None if data is None else literal_after(b"/Title", bytes(data)))
