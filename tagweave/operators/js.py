"""JavaScript tokens: (token_type, token_code, data, start, end, error).

token_type is the text of an operator, sign or keyword, and a class name for everything else. token_code keeps
the class bits: 0x100 numeric, 0x200 punctuator, 0x400 operator (with 0x200), 0x800 reserved word, 0x1000
identifier (also contextual keywords).
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

from ..functions.positions import error, printable

#: Fixed vocabularies, in the order of their codes.
BASE = ("Error", "Whitespace", "LineTerminator", "Comment", "CommentLineTerminator", "String", "Template", "TemplateStart", "TemplateMiddle", "TemplateEnd", "RegExp", "PrivateIdentifier")
NUMERIC = ("Numeric", "Decimal", "Binary", "Octal", "Hexadecimal", "Integer")
PUNCTUATORS = ("Punctuator", "{", "}", "(", ")", "[", "]", ".", ";", ",", "?", ":", "=>", "...")
OPERATORS = ("Operator", "=", "==", "===", "!", "!=", "!==", "<", "<=", "<<", "<<=", ">", ">=", ">>", ">>=", ">>>", ">>>=", "+", "+=", "++", "-", "-=", "--", "*", "*=", "**", "**=", "/", "/=", "%", "%=", "&", "|", "^", "~", "&=", "|=", "^=", "&&", "||", "??", "&&=", "||=", "??=", "?.")
RESERVED = ("Reserved", "await", "break", "case", "catch", "class", "const", "continue", "debugger", "default", "delete", "do", "else", "enum", "export", "extends", "false", "finally", "for", "function", "if", "import", "in", "instanceof", "new", "null", "return", "super", "switch", "this", "throw", "true", "try", "typeof", "yield", "var", "void", "while", "with")
CONTEXTUAL = ("Identifier", "as", "async", "from", "get", "implements", "interface", "let", "meta", "of", "package", "private", "protected", "public", "set", "static", "target")
CODES = {name: base + k for base, names in ((0, BASE), (0x100, NUMERIC), (0x200, PUNCTUATORS), (0x600, OPERATORS), (0x800, RESERVED), (0x1000, CONTEXTUAL)) for k, name in enumerate(names)}
KEYWORDS = frozenset(RESERVED[1:] + CONTEXTUAL[1:])
IDENTIFIERS = frozenset(CONTEXTUAL)
NAMES = frozenset(RESERVED[1:]) | IDENTIFIERS
NUMBERS = frozenset(NUMERIC)

SPACE = re.compile(rb"(?:[ \t\v\f]|\xc2\xa0|\xef\xbb\xbf|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xaf]|\xe2\x81\x9f|\xe3\x80\x80)+")
LINES = re.compile(rb"(?:[\n\r]|\xe2\x80[\xa8\xa9])+")
REST_OF_LINE = re.compile(rb"(?:[^\n\r\xe2]|\xe2(?!\x80[\xa8\xa9]))*+")
SIGN = re.compile(b"|".join(re.escape(x.encode()) for x in sorted((*PUNCTUATORS[1:], *OPERATORS[1:]), key=len, reverse=True)))
NAME = re.compile(rb"(?:[A-Za-z0-9_$]|\\u(?:[0-9a-fA-F]{4}|\{[0-9a-fA-F]+\}))*+")
NAME_START = re.compile(rb"[A-Za-z_$]|\\u(?:[0-9a-fA-F]{4}|\{[0-9a-fA-F]+\})")
STRINGS = {q: re.compile(rb"(?:[^\\\n\r" + q + rb"]|\\(?:\r\n|[\s\S])?)*+", re.S) for q in (b'"', b"'")}
TEMPLATE = re.compile(rb"(?:[^`$\\]|\\[\s\S]?|\$(?!\{))*+(`|\$\{|)", re.S)
REGEXP = re.compile(rb"/(?:[^/\[\]\\\n\r\xe2]|\xe2(?!\x80[\xa8\xa9])|\](?=[\s\S])|\\(?!\xe2\x80[\xa8\xa9])[^\n\r]|\[(?:[^\]\\\n\r\xe2]|\xe2(?!\x80[\xa8\xa9])|\\(?!\xe2\x80[\xa8\xa9])[^\n\r])*+\])*+/")
RADIX = {b"x": ("Hexadecimal", rb"[0-9a-fA-F]"), b"b": ("Binary", rb"[01]"), b"o": ("Octal", rb"[0-7]")}
RADIX = {k: (kind, re.compile(d + rb"(?:_?" + d + rb")*n?")) for k, (kind, d) in RADIX.items()}
DIGITS = rb"[0-9](?:_?[0-9])*"
DECIMAL = re.compile(rb"(?:(0|" + DIGITS + rb")(?:(n)|(\.)(?:" + DIGITS + rb")?)?|\." + DIGITS + rb")")
EXPONENT = re.compile(rb"[eE][+-]?")
MORE_DIGITS = re.compile(DIGITS)
START = frozenset(("Lu", "Ll", "Lt", "Lm", "Lo", "Nl"))
CONTINUE = START | frozenset(("Mn", "Mc", "Nd", "Pc"))
OTHER_START, OTHER_CONTINUE = "℘℮゛゜ᢅᢆ", "··፩፪፫፬፭፮፯፰፱᧚‌‍"


def character(data: bytes, at: int) -> tuple[str, int]:
    """(character, its bytes) at an offset; a broken sequence is one byte."""
    lead = data[at]
    n = 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
    try:
        return data[at : at + n].decode(), n
    except UnicodeDecodeError:
        return "�", 1


def starts_name(c: str) -> bool:
    return unicodedata.category(c) in START or c in OTHER_START


def continues_name(c: str) -> bool:
    return unicodedata.category(c) in CONTINUE or c in OTHER_START or c in OTHER_CONTINUE


def name_end(data: bytes, at: int) -> int:
    """End of the identifier characters from ``at``."""
    while True:
        at = NAME.match(data, at).end()
        if at >= len(data) or data[at] < 0xC0:
            return at
        c, n = character(data, at)
        if not continues_name(c):
            return at
        at += n


def identifier_end(data: bytes, at: int) -> int:
    """End of an identifier at ``at``; ``at`` if there is none."""
    if m := NAME_START.match(data, at):
        return name_end(data, m.end())
    if at < len(data) and data[at] >= 0xC0:
        c, n = character(data, at)
        if starts_name(c):
            return name_end(data, at + n)
    return at


class Lexer:
    """``next`` gives (type, data); ``wrong`` is the error of the last Error token, None at the end."""

    def __init__(self, data: bytes):
        self.data, self.at, self.start = data, 0, 0
        self.wrong: tuple | None = None
        self.new_line, self.after_number = True, False
        self.level = 0
        self.templates: list[int] = []

    def fail(self, message: str, at: int | None = None) -> None:
        self.wrong = error(self.data, self.at if at is None else at, message)

    def give(self, kind: str, stop: int) -> tuple[str, bytes]:
        self.at = stop
        return kind, self.data[self.start : stop]

    def next(self) -> tuple[str, bytes]:
        data, at = self.data, self.at
        self.start, self.wrong = at, None
        new_line, self.new_line = self.new_line, False
        after_number, self.after_number = self.after_number, False
        if at >= len(data):
            return "Error", b""
        if m := SPACE.match(data, at):
            self.new_line = new_line
            return self.give("Whitespace", m.end())
        if m := LINES.match(data, at):
            self.new_line = True
            return self.give("LineTerminator", m.end())
        c = data[at : at + 1]
        if data.startswith(b"//", at) or data.startswith(b"<!--", at) or new_line and data.startswith(b"-->", at):
            return self.give("Comment", REST_OF_LINE.match(data, at).end())
        if data.startswith(b"/*", at):
            return self.block_comment()
        if c.isdigit() or c == b"." and data[at + 1 : at + 2].isdigit():
            self.after_number = True
            return self.number()
        if c in STRINGS:
            stop = STRINGS[c].match(data, at + 1).end()
            if data[stop : stop + 1] == c:
                return self.give("String", stop + 1)
            self.fail("unterminated string literal", stop)
            return self.give("Error", stop)
        if c == b"`":
            self.templates.append(self.level)
            return self.template(False)
        if c in (b"{", b"("):
            self.level += 1
        elif c in (b"}", b")"):
            self.level -= 1
            if c == b"}" and self.templates and self.level == self.templates[-1]:
                return self.template(True)
        if m := SIGN.match(data, at):
            kind, stop = m[0].decode(), m.end()
            if kind == "?." and data[stop : stop + 1].isdigit():
                kind, stop = "?", at + 1
            return self.give(kind, stop)
        if c == b"#" and (stop := identifier_end(data, at + 1)) > at + 1:
            return self.give("PrivateIdentifier", stop)
        if (stop := identifier_end(data, at)) > at:
            if after_number:
                self.fail("unexpected identifier after number", stop)
                self.at = stop
                return "Error", b""
            text = data[at:stop].decode("utf-8", "replace")
            return self.give(text if text in KEYWORDS else "Identifier", stop)
        if c == b"#":
            at += 1
            if at >= len(data):
                self.fail("unexpected " + printable(0), at)
                return self.give("Error", at)
        c, n = character(data, at)
        self.fail("unexpected " + printable(ord(c)), at)
        return self.give("Error", at + n)

    def block_comment(self) -> tuple[str, bytes]:
        stop = self.data.find(b"*/", self.at + 2)
        if stop < 0:
            self.at = len(self.data)
            self.fail("unexpected EOF in comment")
            return "Error", b""
        if LINES.search(self.data, self.at, stop):
            self.new_line = True
            return self.give("CommentLineTerminator", stop + 2)
        return self.give("Comment", stop + 2)

    def number(self) -> tuple[str, bytes]:
        data, at = self.data, self.at
        if data[at] == 48:
            if radix := RADIX.get(data[at + 1 : at + 2].lower()):
                m = radix[1].match(data, at + 2)
                return self.give(radix[0], m.end()) if m else self.give("Integer", at + 1)
            if data[at + 1 : at + 2].isdigit():
                self.fail("legacy octal numbers are not supported", at + 1)
                return self.give("Error", at + 1)
            m = re.compile(rb"(0)(?:(n)|(\.)(?:" + DIGITS + rb")?)?").match(data, at)
        else:
            m = DECIMAL.match(data, at)
        stop = m.end()
        if m[2]:
            return self.give("Integer", stop)
        kind = "Integer" if m[1] and not m[3] else "Decimal"
        if e := EXPONENT.match(data, stop):
            digits = MORE_DIGITS.match(data, e.end())
            if not digits:
                self.fail("invalid number", e.end())
                return self.give("Error", e.end())
            return self.give("Decimal", digits.end())
        return self.give(kind, stop)

    def template(self, inside: bool) -> tuple[str, bytes]:
        m = TEMPLATE.match(self.data, self.at + 1)
        if m[1] == b"`":
            self.templates.pop()
            return self.give("TemplateEnd" if inside else "Template", m.end())
        if m[1]:
            self.level += 1
            return self.give("TemplateMiddle" if inside else "TemplateStart", m.end())
        self.fail("unterminated template literal", m.end())
        return self.give("Error", m.end())

    def regexp(self) -> tuple[str, bytes]:
        """Reads the last token, a / or /=, as the beginning of a regular expression."""
        data = self.data
        if self.data[self.start : self.at] not in (b"/", b"/="):
            self.fail("expected / or /=")
            return "Error", b""
        self.wrong = None
        m = REGEXP.match(data, self.start)
        if not m:
            stop = LINES.search(data, self.start)
            self.at = stop.start() if stop else len(data)
            self.fail("unexpected EOF or newline")
            return "Error", b""
        return self.give("RegExp", name_end(data, m.end()))


def tokens(data: bytes | None, regexp: bool = False) -> Iterator[tuple]:
    """All tokens. ``regexp``: every / and /= begins a regular expression (else none does; a reader knows)."""
    lexer = Lexer(data or b"")
    while True:
        kind, text = lexer.next()
        if regexp and kind in ("/", "/="):
            kind, text = lexer.regexp()
        if kind == "Error":
            if lexer.wrong is None:
                return
            yield kind, 0, text, lexer.start, lexer.at, lexer.wrong
            if lexer.at >= len(lexer.data):
                return
            continue
        yield kind, CODES[kind], text, lexer.start, lexer.at, None
