"""CSS tokens and grammar units of a stylesheet or of inline declarations.

Tokens: (token_type, data, start, end). Units: (grammar, token_type, data, values, end, error), where values are
(token_type, data) pairs. Unterminated strings, comments and urls at the end of the input are good.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from ..functions.positions import error

ESCAPE = rb"\\(?:[0-9a-fA-F]{1,6}[ \t\n\r\f]?|[\xc0-\xff][\x80-\xbf]*|[^0-9a-fA-F\n\r\f\xc0-\xff])"
NAME = rb"(?:[a-zA-Z0-9_\-\x80-\xff]|" + ESCAPE + rb")"
IDENT = rb"(?:--|-?(?:[a-zA-Z_\x80-\xff]|" + ESCAPE + rb"))" + NAME + rb"*"
NUMBER = rb"[+-]?(?:[0-9]+(?:\.[0-9]+)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?+"  # an exponent is never given back as a unit
TOKEN = re.compile(
    rb"(?P<Whitespace>[ \t\n\r\f]+)|(?P<Comment>/\*(?:.*?\*/|.*\Z))|(?P<CDO><!--)|(?P<CDC>-->)"
    rb"|(?P<CustomPropertyName>--" + NAME + rb"*)|(?P<AtKeyword>@" + IDENT + rb")|(?P<Hash>#" + NAME + rb"+)"
    rb"|(?P<Dimension>" + NUMBER + IDENT + rb")|(?P<Percentage>" + NUMBER + rb"%)|(?P<Number>" + NUMBER + rb")"
    rb"|(?P<Ident>" + IDENT + rb")|(?P<String>[\"'])|(?P<Match>[~|^$*]=)|(?P<Column>\|\|)|(?P<Sign>[:;,()\[\]{}])|(?P<Delim>.)",
    re.S,
)
SPACES = re.compile(rb"[ \t\n\r\f]*")
QUOTED = {q: re.compile(rb"(?:[^" + q + rb"\n\r\f\\]|" + ESCAPE + rb"|\\(?:\r\n|[\n\r\f]|\Z))*+", re.S) for q in (b'"', b"'")}
UNQUOTED = re.compile(rb"(?:[^\"'()\\ \x00-\x1f\x7f]|" + ESCAPE + rb")*+", re.S)
REMNANTS = re.compile(rb"(?:[^)\\]|" + ESCAPE + rb"|\\)*+\)?", re.S)
RANGE = re.compile(rb"[uU]\+([0-9a-fA-F]*)(?:-([0-9a-fA-F]+)|(\?+))?")
MATCHES = {b"~=": "IncludeMatch", b"|=": "DashMatch", b"^=": "PrefixMatch", b"$=": "SuffixMatch", b"*=": "SubstringMatch"}
SIGNS = {
    b":": "Colon", b";": "Semicolon", b",": "Comma", b"(": "LeftParenthesis", b")": "RightParenthesis",
    b"[": "LeftBracket", b"]": "RightBracket", b"{": "LeftBrace", b"}": "RightBrace",
}


def string_end(data: bytes, at: int) -> tuple[str, int]:
    """(String or BadString, end) of the string whose quote is at ``at``."""
    stop = QUOTED[data[at : at + 1]].match(data, at + 1).end()
    bad = data[stop : stop + 1] in (b"\n", b"\r", b"\f")
    return "BadString" if bad else "String", min(stop + 1, len(data))


def url_end(data: bytes, at: int) -> tuple[str, int]:
    """(URL or BadURL, end) of a url whose parenthesis ends at ``at``."""
    at = SPACES.match(data, at).end()
    good = True
    if data[at : at + 1] in (b'"', b"'"):
        kind, at = string_end(data, at)
        good = kind == "String"
    else:
        at = UNQUOTED.match(data, at).end()
        good = at >= len(data) or data[at] in b") \t\n\r\f"
    if good:
        at = SPACES.match(data, at).end()
        if at >= len(data) or data[at] == 41:
            return "URL", min(at + 1, len(data))
    return "BadURL", REMNANTS.match(data, at).end()


def unicode_range(data: bytes, at: int) -> int:
    """End of a unicode range at ``at``, or ``at``."""
    m = RANGE.match(data, at)
    if not m:
        return at
    first, second, marks = m.groups()
    if second is None and data[m.end() : m.end() + 1] == b"-" and not marks:
        return at
    length = len(second) if second else len(first) + len(marks or b"")
    return m.end() if 1 <= length <= 6 and (second is None or 1 <= len(first) <= 6) else at


def tokens(data: bytes | None) -> Iterator[tuple]:
    data = data or b""
    at, size = 0, len(data)
    while at < size:
        if data[at] in b"uU" and (stop := unicode_range(data, at)) > at:
            yield "UnicodeRange", data[at:stop], at, stop
            at = stop
            continue
        m = TOKEN.match(data, at)
        kind, stop = m.lastgroup, m.end()
        if kind == "Sign":
            kind = SIGNS[m[0]]
        elif kind == "Match":
            kind = MATCHES[m[0]]
        elif kind == "String":
            kind, stop = string_end(data, at)
        elif kind == "Ident" and data[stop : stop + 1] == b"(":
            kind, stop = url_end(data, stop + 1) if m[0].replace(b"\\", b"").lower() == b"url" else ("Function", stop + 1)
        yield kind, data[at:stop], at, stop
        at = stop


OPENING = frozenset(("LeftParenthesis", "LeftBrace", "LeftBracket", "Function"))
CLOSING = frozenset(("RightParenthesis", "RightBrace", "RightBracket"))
PASSED_OVER = frozenset(("Whitespace", "Comment"))
RULE_LISTS = frozenset((b"document", b"keyframes", b"layer", b"media", b"supports"))
DECLARATION_LISTS = frozenset((b"font-face", b"page"))
SPACE = ("Whitespace", b" ")
END = ("Error", b"")
#: Where units end, at their own level of brackets.
DECLARATION_ENDS, BLOCK_BEGINS = frozenset(("Semicolon", "RightBrace")), frozenset(("LeftBrace",))


class Sheet:
    """The tokens of a text, by position. Units are cut out of them by their brackets (``extent``); what a unit gives
    is worked out from its tokens alone."""

    def __init__(self, data: bytes):
        self.data, self.all = data, list(tokens(data))
        self.size = len(self.all)

    def kind(self, i: int) -> str:
        return self.all[i][0] if i < self.size else "Error"

    def token(self, i: int) -> tuple[str, bytes]:
        return self.all[i][:2] if i < self.size else END

    def end(self, i: int) -> int:
        """Offset of the end of token i, or of the text."""
        return self.all[min(i, self.size - 1)][3]

    def start(self, i: int) -> int:
        return self.all[i][2] if i < self.size else self.end(i)

    def after(self, i: int, over: frozenset = PASSED_OVER) -> int:
        """Position of the first token from i on that isn't passed over."""
        while i < self.size and self.all[i][0] in over:
            i += 1
        return i

    def extent(self, i: int, ends: frozenset, strict: bool = True) -> tuple[int, bool]:
        """Position of the first token from i on that ends a unit there: one of ``ends`` outside brackets, or (``strict``)
        a bracket that closes nothing, for which the second value is true."""
        depth = 0
        for j in range(i, self.size):
            kind = self.all[j][0]
            if depth == 0 and kind in ends:
                return j, False
            if kind in OPENING:
                depth += 1
            elif kind in CLOSING:
                if depth:
                    depth -= 1
                elif strict:
                    return j, True
        return self.size, False

    def counted(self, i: int, stop: int) -> list[tuple[tuple[str, bytes], bool, bool]]:
        """The tokens that count in a range: (token, white space before it, white space or a comment before it)."""
        found, spaced, apart = [], False, False
        for kind, data, *_ in self.all[i:stop]:
            if kind in PASSED_OVER:
                spaced, apart = spaced or kind == "Whitespace", True
            else:
                found.append(((kind, data), spaced, apart))
                spaced = apart = False
        return found

    def wrong(self, message: str, where: int) -> tuple:
        return error(self.data, where, message)


def joined(parts: list, gap: Callable[[tuple, tuple], bool]) -> list[tuple[str, bytes]]:
    """Tokens with one space between two that had white space between them and for which ``gap`` holds. The first is
    compared with the beginning, which is an empty token."""
    out, before = [], ("", b"")
    for token, spaced, _ in parts:
        if spaced and gap(before, token):
            out.append(SPACE)
        out.append(token)
        before = token
    return out


def prelude(parts: list) -> list[tuple[str, bytes]]:
    """Values of an at-rule: no space beside a comma or colon, inside a parenthesis or before the first bracket."""
    def gap(a: tuple, b: tuple) -> bool:
        return a[1] not in (b",", b":") and b[1] not in (b",", b":") and a[0] != "LeftParenthesis" and b[0] != "RightParenthesis" and not (a[0] == "" and b[0] in ("LeftParenthesis", "LeftBracket"))

    return joined(parts, gap)


def selector(parts: list) -> list[tuple[str, bytes]]:
    """Values of a ruleset: no space at the start, beside a combinator or inside the brackets of an attribute."""
    signs, inside, flagged = (b",", b">", b"+", b"~"), False, []
    for token, spaced, apart in parts:
        flagged.append((token, spaced and not inside, apart))
        inside = token[0] == "LeftBracket" or inside and token[0] != "RightBracket"
    return joined(flagged, lambda a, b: a[0] != "" and a[1] not in signs and b[1] not in signs)


def at_name(word: bytes) -> bytes:
    """The lower-case name of an at-rule without its vendor."""
    name = word[1:].lower()
    return name[name.index(b"-", 1) + 1 :] if name.startswith(b"-") and b"-" in name[1:] else name


def units(sheet: Sheet, inline: bool) -> Iterator[tuple]:
    """(grammar, token_type, data, values, end, error), from the outermost block inwards. ``open_`` holds the kinds of
    the enclosing blocks: what may stand there, and what their end is called."""
    open_, i = ["declarations" if inline else "stylesheet"], 0
    fresh_unknown = False
    while True:
        where = open_[-1]
        if where == "unknown":
            i = sheet.after(i, PASSED_OVER if fresh_unknown else frozenset(("Comment",)))
            stop, fresh_unknown = sheet.extent(i, frozenset(("RightBrace",)), False)[0], False
            for j in range(i, stop):
                if sheet.kind(j) != "Comment":
                    yield "Token", *sheet.token(j), [], sheet.end(j), None
            open_.pop()
            yield "EndAtRule", *sheet.token(stop), [], sheet.end(stop), None
            i = stop + 1
            continue
        i = sheet.after(i, PASSED_OVER if len(open_) > 1 or inline else frozenset(("Whitespace",)))
        if where not in ("stylesheet", "rules"):
            while sheet.kind(i) == "Semicolon":
                i = sheet.after(i + 1)
        kind = sheet.kind(i)
        if len(open_) > 1 and kind in ("RightBrace", "Error"):
            yield "EndRuleset" if open_.pop() == "block" else "EndAtRule", *sheet.token(i), [], sheet.end(i), None
            i += 1
            continue
        if kind == "Error":
            return
        if kind == "AtKeyword":
            row, i, inner = at_rule(sheet, i)
        elif where == "rules":
            row, i, inner = ruleset(sheet, i)
        elif kind == "CustomPropertyName":
            row, i, inner = custom_property(sheet, i)
        elif where == "stylesheet":
            if kind in ("CDO", "CDC", "Comment"):
                row, i, inner = ("Comment" if kind == "Comment" else "Token", *sheet.token(i), [], sheet.end(i), None), i + 1, None
            else:
                row, i, inner = ruleset(sheet, i)
        else:
            row, i, inner = declaration(sheet, i, inline)
            if row is None:
                return
        yield row
        if inner == "end" and len(open_) > 1:
            open_.pop()
        elif inner and inner != "end":
            open_.append(inner)
            fresh_unknown = inner == "unknown"


def stray(sheet: Sheet, shown: tuple, values: list, j: int, message: str) -> tuple:
    """The row of a unit that ends at a bracket which closes nothing; its block ends as well."""
    return ("Error", *shown, [*values, sheet.token(j)], sheet.end(j), sheet.wrong(message, sheet.end(j))), j + 1, "end"


# Each of these takes the position of a unit's first token and gives its row, where the next unit begins, and the kind
# of block that begins ("end": the block around ends, None: neither).


def at_rule(sheet: Sheet, i: int) -> tuple:
    word = sheet.all[i][1]
    shown = ("AtKeyword", word.lower())
    j, odd = sheet.extent(i + 1, DECLARATION_ENDS | BLOCK_BEGINS)
    values = prelude(sheet.counted(i + 1, j))
    if odd:
        return stray(sheet, shown, values, j, "unexpected ending in at rule")
    if sheet.kind(j) == "LeftBrace":
        name = at_name(word)
        inner = "at_block" if name in DECLARATION_LISTS else "rules" if name in RULE_LISTS else "unknown"
        return ("BeginAtRule", *shown, values, sheet.end(j), None), j + 1, inner
    return ("AtRule", *shown, values, sheet.end(j), None), j + (sheet.kind(j) == "Semicolon"), None


def ruleset(sheet: Sheet, i: int) -> tuple:
    shown, message = ("Whitespace", b""), "unexpected ending in qualified rule"
    j, odd = sheet.extent(i, BLOCK_BEGINS)
    values = selector(sheet.counted(i, j))
    if odd:
        return stray(sheet, shown, values, j, message)
    if j == sheet.size:
        return ("Error", *shown, values, sheet.end(j), sheet.wrong(message, sheet.end(j))), j, None
    return ("BeginRuleset", *shown, values, sheet.end(j), None), j + 1, "block"


def custom_property(sheet: Sheet, i: int, star: bytes = b"") -> tuple:
    name, colon = ("CustomPropertyName", star + sheet.all[i][1]), sheet.after(i + 1)
    if sheet.kind(colon) != "Colon":
        return ("Error", *name, [], sheet.end(colon), sheet.wrong("expected colon in custom property", sheet.start(colon))), colon + 1, None
    j, odd = sheet.extent(colon + 1, DECLARATION_ENDS)
    if odd:
        return ("Error", *name, [sheet.token(j)], sheet.end(j), sheet.wrong("unexpected ending in custom property", sheet.end(j))), j + 1, None
    value = b"".join(t[1] for t in sheet.all[colon + 1 : j])
    return ("CustomProperty", *name, [("CustomPropertyValue", value)], sheet.end(j), None), j + (sheet.kind(j) == "Semicolon"), None


def broken(sheet: Sheet, i: int, shown: tuple, values: list, wrong: tuple, spaced: bool) -> tuple:
    """The row of a declaration that is given up at token i: everything up to its end."""
    j, _ = sheet.extent(i, DECLARATION_ENDS, False)
    parts = sheet.counted(i, j)
    if parts and spaced:
        parts[0] = (parts[0][0], True, True)
    values = [*values, *joined(parts, lambda a, b: True)]
    closed = sheet.kind(j) == "Semicolon"
    return ("Error", *shown, [*values, sheet.token(j)] if closed else values, sheet.end(j), wrong), j + closed, None


def declaration(sheet: Sheet, i: int, inline: bool) -> tuple:
    first, spaced = sheet.token(i), i > 0 and sheet.kind(i - 1) == "Whitespace"
    if first == ("Delim", b"*"):  # *property, read by old browsers only
        star, i = i, sheet.after(i + 1)
        if i == sheet.size:
            return None, i, None
        spaced = i > star + 1 and any(sheet.kind(k) == "Whitespace" for k in range(star + 1, i))
        kind, data = sheet.token(i)
        if kind == "AtKeyword":
            return at_rule(sheet, i)
        first = (kind, b"*" + data)
    if first[0] == "CustomPropertyName":
        return custom_property(sheet, i, first[1][: -len(sheet.all[i][1])])
    if first[0] not in ("Ident", "Delim"):
        wrong = sheet.wrong(f"unexpected token '{first[1].decode('utf-8', 'replace')}' in declaration", sheet.end(i) - len(first[1]))
        if first[0] == "RightBrace":
            return ("Error", *first, [first], sheet.end(i), wrong), i + 1, None
        row, j, inner = broken(sheet, i, first, [], wrong, spaced)
        return row, j, inner
    j, odd = sheet.extent(i + 1, DECLARATION_ENDS if inline else DECLARATION_ENDS | BLOCK_BEGINS)
    parts = [(token, apart, apart) for token, _, apart in sheet.counted(i + 1, j)]
    values = [first, *joined(parts, lambda a, b: True)]
    if odd:
        return broken(sheet, j, sheet.token(j), values, sheet.wrong("unexpected ending in declaration", sheet.end(j)), sheet.kind(j - 1) == "Whitespace")
    if sheet.kind(j) == "LeftBrace":
        return ("BeginRuleset", "Whitespace", b"", values, sheet.end(j), None), j + 1, "block"
    if not parts or parts[0][0][0] != "Colon":
        second = sheet.start(sheet.after(i + 1)) if parts else 0
        return broken(sheet, j, sheet.token(j), values, sheet.wrong("expected colon in declaration", second or sheet.end(j)), False)
    colon = 2 if values[1] == SPACE else 1
    return ("Declaration", first[0], first[1].lower(), tight(values[colon + 1 :]), sheet.end(j), None), j + (sheet.kind(j) == "Semicolon"), None


SWALLOWS = frozenset((b",", b"/", b":", b"!", b"="))


def tight(values: list[tuple[str, bytes]]) -> list[tuple[str, bytes]]:
    """Without the white space at the start and next to , / : ! and =."""
    kept: list[tuple[str, bytes]] = []
    for i, v in enumerate(values):
        if v == SPACE:
            following = values[i + 1][1] if i + 1 < len(values) else b" "
            if not kept or kept[-1][1] in SWALLOWS or following in SWALLOWS:
                continue
        kept.append(v)
    return kept


def grammar(data: bytes | None, inline: bool = False) -> Iterator[tuple]:
    if data:
        yield from units(Sheet(data), inline)


def is_ident(data: bytes) -> bool:
    return not data or bool(re.fullmatch(IDENT, data, re.S))


def is_url_unquoted(data: bytes) -> bool:
    return UNQUOTED.fullmatch(data) is not None
