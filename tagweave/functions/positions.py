"""Byte offset -> line, column and a readable line of context.

Lines end at LF, CR, CRLF, U+2028 and U+2029. Columns count characters from 1.
"""

from __future__ import annotations

import re
import unicodedata

NEWLINE = re.compile(rb"\r\n|[\n\r]|\xe2\x80[\xa8\xa9]")
WIDTH, MARGIN = 60, 20


def graphic(c: str) -> bool:
    """Letters, marks, numbers, punctuation, symbols and space separators."""
    return unicodedata.category(c)[0] in "LMNPS" or unicodedata.category(c) == "Zs"


def position(data: bytes, offset: int) -> tuple[int, int, str]:
    line, start = 1, 0
    for m in NEWLINE.finditer(data):
        if m.end() > offset:
            break
        line, start = line + 1, m.end()
    at = max(start, min(offset, len(data)))
    while at > start and at < len(data) and data[at] & 0xC0 == 0x80:  # inside a character
        at -= 1
    inside = NEWLINE.match(data, at - 1) if at > start else None
    if inside and inside.end() - inside.start() == 2 and inside.start() < offset < inside.end():
        at = inside.start()
    col = len(data[start:at].decode("utf-8", "replace")) + 1
    end = re.compile(rb"[\n\r]|\Z").search(data, at).start()
    return line, col, context(data[start:end].decode("utf-8", "replace"), line, col)


def context(text: str, line: int, col: int) -> str:
    """The line cut to about sixty characters around the column, with a caret below."""
    front = rear = ""
    if len(text) > WIDTH:
        if col <= WIDTH - MARGIN:
            rear, text = "...", text[: WIDTH - 3]
        elif col >= len(text) - MARGIN - 3:
            front, cut = "...", len(text) - 2 * MARGIN
            text, col = text[cut - 4 :], col - (cut - 7)
        else:
            front = rear = "..."
            text, col = text[col - MARGIN - 1 : col + MARGIN], MARGIN + 4
    shown = "".join(c if graphic(c) else "·" for c in text)
    return f"{line:5d}: {front}{shown}{rear}\n{' ' * (6 + col)}^"


def error(data: bytes, offset: int, message: str) -> tuple[str, int, int, str]:
    return (message, *position(data, offset))


def error_text(found: tuple[str, int, int, str]) -> str:
    message, line, col, where = found
    return f"{message} on line {line} and column {col}\n{where}"


def printable(code: int) -> str:
    c = chr(code)
    return c if graphic(c) else f"0x{code:02X}" if code < 128 else f"U+{code:04X}"
