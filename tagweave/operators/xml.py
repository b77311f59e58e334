"""XML 1.0 tokens of a document: (token_type, data, text, attr_val, start, end, error). A NUL ends it with an error."""

from __future__ import annotations

import re
from collections.abc import Iterator

from ..functions.positions import error

SPACES = re.compile(rb"[ \t\n\r]*")
NAME_END = re.compile(rb"[ >\t\n\r\x00]|[/?]>")
KEY_END = re.compile(rb"[ =>\t\n\r\x00]|[/?]>")
TEXT_END = re.compile(rb"[<\x00]")
BLANKED = bytes.maketrans(b"\t\n\r", b"   ")
DOCTYPE_STOP = re.compile(rb'["\[\]>\x00]')
CLOSERS = {b"/>": "StartTagCloseVoid", b"?>": "StartTagClosePI"}


def end_of(pattern: re.Pattern, data: bytes, at: int) -> int:
    m = pattern.search(data, at)
    return m.start() if m else len(data)


def closed_by(data: bytes, at: int, mark: bytes) -> tuple[int, int]:
    """(end of the content, end of the token); a NUL or the end of the document also closes."""
    m = re.compile(re.escape(mark) + rb"|\x00").search(data, at)
    if not m:
        return len(data), len(data)
    return m.start(), m.start() if m[0] == b"\x00" else m.end()


def doctype_end(data: bytes, at: int) -> tuple[int, int]:
    quoted = bracketed = False
    while m := DOCTYPE_STOP.search(data, at):
        at = m.end()
        if m[0] == b"\x00":
            return m.start(), m.start()
        if m[0] == b'"':
            quoted = not quoted
        elif not quoted and m[0] == b">":
            if not bracketed:
                return m.start(), m.end()
        elif not quoted:
            bracketed = m[0] == b"["
    return len(data), len(data)


def tokens(data: bytes | None) -> Iterator[tuple]:
    data = data or b""
    size, at = len(data), 0
    while at < size:
        if data[at] == 0:
            yield "Error", b"", None, None, at, at, error(data, at, "unexpected NULL character")
            return
        if data[at] != 60:
            stop = end_of(TEXT_END, data, at)
            yield "Text", data[at:stop], data[at:stop], None, at, stop, None
        elif data.startswith(b"</", at):
            inner, stop = closed_by(data, at + 2, b">")
            yield "EndTag", data[at:stop], data[at + 2 : inner].rstrip(b" \t\n\r"), None, at, stop, None
        elif data.startswith(b"<!--", at):
            inner, stop = closed_by(data, at + 4, b"-->")
            yield "Comment", data[at:stop], data[at + 4 : inner] if stop > inner else None, None, at, stop, None
        elif data.startswith(b"<![CDATA[", at):
            inner, stop = closed_by(data, at + 9, b"]]>")
            yield "CDATA", data[at:stop], data[at + 9 : inner], None, at, stop, None
        elif data.startswith(b"<!DOCTYPE", at):
            inner, stop = doctype_end(data, at + 9)
            yield "DOCTYPE", data[at:stop], data[at + 9 : inner], None, at, stop, None
        else:
            lead = 2 if data.startswith(b"<?", at) else 1
            stop = end_of(NAME_END, data, at + lead)
            yield "StartTagPI" if lead == 2 else "StartTag", data[at:stop], data[at + lead : stop], None, at, stop, None
            stop = yield from attributes(data, stop)
            if stop < 0:
                return
        at = stop


def attributes(data: bytes, at: int) -> Iterator[tuple]:
    """Rows up to the end of the tag; gives its offset, or -1 where the document can't go on."""
    while True:
        first = SPACES.match(data, at).end()
        if first >= len(data):
            return -1
        if data[first] == 0:
            yield "Error", b"", None, None, first, first, error(data, first, "unexpected NULL character")
            return -1
        closer = CLOSERS.get(data[first : first + 2])
        if closer or data[first] == 62:
            stop = first + (2 if closer else 1)
            yield closer or "StartTagClose", data[first:stop], None, None, first, stop, None
            return stop
        name_end = end_of(KEY_END, data, first)
        equals = SPACES.match(data, name_end).end()
        value, stop, whole = None, name_end, None
        if data[equals : equals + 1] == b"=":
            begin = SPACES.match(data, equals + 1).end()
            quote = data[begin : begin + 1]
            if quote in (b'"', b"'"):
                _, stop = closed_by(data, begin + 1, quote)
                value = data[begin:stop].translate(BLANKED)
                whole = data[at:begin] + value
            else:
                stop = end_of(NAME_END, data, begin)
                value = data[begin:stop]
        yield "Attribute", whole or data[at:stop], data[first:name_end], value, at, stop, None
        at = stop
