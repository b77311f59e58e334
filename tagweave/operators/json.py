"""JSON events: (grammar, state, data, depth, start, end, error, name); name is that of the member whose value an event
is or begins, as written between the quotes.

The grammar is lenient: a comma may stand before the first or after the last item, containers may stay open at
the end of the document, and strings are not validated.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from ..functions.positions import error

SPACES = re.compile(rb"[ \n\r\t]*")
STRING = re.compile(rb'"(?:[^"\\\x00]|\\[^\x00])*+"', re.S)
NUMBER = re.compile(rb"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")
LITERAL = re.compile(rb"true|false|null")
VALUE, KEY, MEMBER, ITEM = "Value", "ObjectKey", "ObjectValue", "Array"
OPENERS = {0x7B: ("StartObject", KEY), 0x5B: ("StartArray", ITEM)}
CLOSERS = {0x7D: ("EndObject", KEY, "unexpected right brace character"), 0x5D: ("EndArray", ITEM, "unexpected right bracket character")}


def unfinished(data: bytes, at: int) -> int:
    """Where reading a string without an end stops."""
    stop = data.find(b"\x00", at)
    return len(data) if stop < 0 else stop


def events(data: bytes | None) -> Iterator[tuple]:
    data = data or b""
    states, pending, at, key = [VALUE], False, 0, None  # pending: a comma or a closing sign must come before the next item

    def wrong(where: int, message: str) -> tuple:
        return "Error", states[-1], b"", len(states) - 1, where, where, error(data, where, message), None

    while True:
        at = SPACES.match(data, at).end()
        if data[at : at + 1] == b",":
            if states[-1] not in (ITEM, KEY):
                yield wrong(at, "unexpected comma character")
                return
            at, pending = SPACES.match(data, at + 1).end(), False
        c = data[at] if at < len(data) else -1
        if pending and c not in (0x7D, 0x5D, 0, -1):
            yield wrong(at, "expected comma character or an array or object ending")
            return
        if c in OPENERS:
            grammar, state = OPENERS[c]
            name = key if states[-1] == MEMBER else None
            states.append(state)
            stop = at + 1
            yield grammar, state, data[at:stop], len(states) - 2, at, stop, None, name
        elif c in CLOSERS:
            grammar, state, message = CLOSERS[c]
            if states[-1] != state:
                yield wrong(at, message)
                return
            states.pop()
            if states[-1] == MEMBER:
                states[-1] = KEY
            pending, stop = True, at + 1
            yield grammar, states[-1], data[at:stop], len(states) - 1, at, stop, None, None
        elif states[-1] == KEY:
            m = STRING.match(data, at)
            if not m:
                if c == -1:
                    pass
                yield wrong(unfinished(data, at + 1) if c == 0x22 else at, "expected object key to be a quoted string")
                return
            colon = SPACES.match(data, m.end()).end()
            if data[colon : colon + 1] != b":":
                yield wrong(colon, "expected colon character after object key")
                return
            states[-1], stop, key = MEMBER, colon + 1, m[0][1:-1]
            yield "String", MEMBER, m[0], len(states) - 1, at, stop, None, None
        else:
            pending, name = True, None
            if states[-1] == MEMBER:
                states[-1], name = KEY, key
            for grammar, pattern in (("String", STRING), ("Number", NUMBER), ("Literal", LITERAL)):
                if m := pattern.match(data, at):
                    break
            else:
                where = unfinished(data, at + 1) if c == 0x22 else at
                if where >= len(data):
                    return
                message = "unexpected NULL character" if data[where] == 0 else f"unexpected character '{chr(data[where])}'"
                yield wrong(where, message)
                return
            stop = m.end()
            yield grammar, states[-1], m[0], len(states) - 1, at, stop, None, name
        at = stop
