"""HTML5 tokens of a document, with optional template delimiters.

The scanner leaps from one interesting byte to the next with compiled patterns; it never walks byte by byte.
A row is (token_type, data, text, attr_val, has_template, start, end, error, in_tag); in_tag is the element whose raw text
a Text token is (script, style, title and the like), else null.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

from ..functions.positions import error

#: Delimiters of common template languages.
TEMPLATES = {"go": ("{{", "}}"), "handlebars": ("{{", "}}"), "mustache": ("{{", "}}"), "ejs": ("<%", "%>"), "asp": ("<%", "%>"), "php": ("<?", "?>")}

SPACES = re.compile(rb"[ \t\n\r\f]*")
RAW = frozenset((b"textarea", b"title", b"style", b"xmp", b"iframe", b"script", b"plaintext"))
FOREIGN = {b"svg": "SVG", b"math": "Math", b"xml": "XML"}
LETTERS = re.compile(rb"[a-zA-Z]*")
COMMENT_END = re.compile(rb"--!?>")
FOREIGN_STOP = re.compile(rb'["\x00]|</')
FOREIGN_END = re.compile(rb"[>\x00]")
TEMPLATE_STRINGS = {q: re.compile(rb"(?:\\.|[^\\" + q + rb"])*" + q, re.S) for q in (b'"', b"'")}
SCRIPT_STOP = re.compile(rb"-->|</?")


@lru_cache(maxsize=32)
def patterns(begin: bytes) -> tuple:
    """Text, raw-text, tag-name, attribute-name, unquoted-value stops for a template delimiter (or none)."""
    t = re.escape(begin)
    also = b"|" + t if begin else b""
    return (
        re.compile(rb"<(?=[a-zA-Z!?])|</(?=[^>])" + also, re.S), re.compile(rb"</|<!--" + also),
        re.compile(rb"[ >\t\n\r\f]|/>" + also), re.compile(rb"[ =>\t\n\r\f]|/>" + also), re.compile(rb"[ >\t\n\r\f]"),
        re.compile(rb'"' + also), re.compile(rb"'" + also),
    )


class Scanner:
    def __init__(self, data: bytes, begin: bytes = b"", end: bytes = b""):
        self.data, self.begin, self.end = data, begin, end
        self.text, self.raw, self.name, self.key, self.bare, *quoted = patterns(begin)
        self.quoted = dict(zip((b'"', b"'"), quoted))
        self.template_stop = re.compile(re.escape(end) + rb"|[\"']") if begin else None

    def find(self, pattern: re.Pattern, at: int) -> int:
        m = pattern.search(self.data, at)
        return m.start() if m else len(self.data)

    def at_template(self, at: int) -> bool:
        return bool(self.begin) and self.data.startswith(self.begin, at)

    def after_template(self, at: int) -> int:
        """End of the template that begins at ``at``; its strings hide the closing delimiter."""
        at += len(self.begin)
        while m := self.template_stop.search(self.data, at):
            if m[0] == self.end:
                return m.end()
            closing = TEMPLATE_STRINGS[m[0]].match(self.data, m.end())
            if not closing:
                break
            at = closing.end()
        return len(self.data)

    def after_templates(self, at: int) -> int:
        while self.at_template(at):
            at = self.after_template(at)
        return at

    def rows(self) -> Iterator[tuple]:
        data, size, at = self.data, len(self.data), 0
        raw_tag = None
        while at < size:
            if raw_tag:
                stop, templated = self.raw_end(at, raw_tag)
                inside, raw_tag = raw_tag, None
                if stop > at:
                    yield "Text", data[at:stop], data[at:stop], None, templated, at, stop, None, inside
                    at = stop
                    continue
            m = self.text.search(data, at)
            stop = m.start() if m else size
            if stop > at:
                yield "Text", data[at:stop], data[at:stop], None, False, at, stop, None, None
                at = stop
                continue
            if self.at_template(at):
                stop = self.after_template(at)
                yield "Template", data[at:stop], None, None, True, at, stop, None, None
            elif data.startswith(b"</", at):
                stop = data.find(b">", at)
                stop, end = (size, size) if stop < 0 else (stop, stop + 1)
                if data[at + 2 : at + 3].isalpha():
                    yield "EndTag", data[at:end].lower(), data[at + 2 : stop].rstrip(b" \t\n\r").lower(), None, False, at, end, None, None
                else:
                    yield "Comment", data[at:end], data[at + 2 : stop], None, False, at, end, None, None
                stop = end
            elif data.startswith((b"<!", b"<?"), at):
                kind, text, stop = self.markup(at)
                yield kind, data[at:stop], text, None, False, at, stop, None, None
            else:
                stop = self.find(self.name, at + 1)
                tag = data[at + 1 : stop].lower()
                if tag in FOREIGN:
                    stop, wrong = self.foreign_end(stop, tag)
                    if wrong is not None:
                        yield "Error", b"", None, None, False, at, wrong, error(data, wrong, "unexpected NULL character"), None
                        return
                    yield FOREIGN[tag], b"<" + tag + data[at + 1 + len(tag) : stop], tag, None, False, at, stop, None, None
                else:
                    raw_tag = tag if tag in RAW else None
                    yield "StartTag", b"<" + tag, tag, None, False, at, stop, None, None
                    stop = yield from self.attributes(stop)
                    if stop >= size and not data.endswith(b">"):
                        return
            at = stop

    def attributes(self, at: int) -> Iterator[tuple]:
        data, size = self.data, len(self.data)
        if data[at : at + 1] == b">":  # most tags have none
            yield "StartTagClose", b">", None, None, False, at, at + 1, None, None
            return at + 1
        while True:
            first = SPACES.match(data, at).end()
            if first >= size:
                return size
            if data.startswith(b"/>", first):
                yield "StartTagVoid", b"/>", None, None, False, first, first + 2, None, None
                return first + 2
            if data[first] == 62:
                yield "StartTagClose", b">", None, None, False, first, first + 1, None, None
                return first + 1
            stop, name_end, value, templated_name, templated = self.attribute(first)
            name = data[first:name_end]
            if templated_name:
                whole = data[at:stop]
            else:
                name = name.lower()
                whole = data[at:first] + name + data[name_end:stop]
            yield "Attribute", whole, name, value, templated, at, stop, None, None
            at = stop

    def attribute(self, first: int) -> tuple[int, int, bytes | None, bool, bool]:
        """(end, end of the name, value, template in the name, template anywhere)."""
        data, at = self.data, self.after_templates(first)
        while True:
            name_end = self.find(self.key, at)
            if not self.at_template(name_end):
                break
            at = self.after_template(name_end)
        in_name = at > first
        equals = SPACES.match(data, name_end).end()
        value, anywhere, stop = None, in_name, name_end
        if data[equals : equals + 1] == b"=":
            begin = SPACES.match(data, equals + 1).end()
            quote = data[begin : begin + 1]
            if self.at_template(begin):
                stop, anywhere = self.after_templates(begin), True
            elif quote in self.quoted:
                stop = begin + 1
                while True:
                    stop = self.find(self.quoted[quote], stop)
                    if not self.at_template(stop):
                        break
                    stop, anywhere = self.after_template(stop), True
                stop = min(stop + 1, len(data))
            else:
                stop = self.find(self.bare, begin)
            value = data[begin:stop]
        after = self.after_templates(stop)
        return after, name_end, value, in_name, anywhere or after > stop

    def markup(self, at: int) -> tuple[str, bytes, int]:
        """<! and <? constructs: (type, text, end)."""
        data, size = self.data, len(self.data)
        if data.startswith(b"<!--", at):
            m = COMMENT_END.search(data, at + 4)
            return "Comment", data[at + 4 : m.start() if m else size], m.end() if m else size
        if data.startswith(b"<![CDATA[", at):
            stop = data.find(b"]]>", at + 9)
            return ("Text", data[at + 9 : stop], stop + 3) if stop >= 0 else ("Text", data[at + 9 :], size)
        stop = data.find(b">", at)
        stop, end = (size, size) if stop < 0 else (stop, stop + 1)
        if data[at + 2 : at + 9].lower() == b"doctype" and data.startswith(b"<!", at):
            return "Doctype", data[at + 9 : stop], end
        return "Comment", data[at + 2 : stop], end

    def raw_end(self, at: int, tag: bytes) -> tuple[int, bool]:
        """Where the raw text ends: at its closing tag."""
        data, templated = self.data, False
        if tag == b"plaintext":
            return len(data), False
        while m := self.raw.search(data, at):
            if m[0] == self.begin:
                at, templated = self.after_template(m.start()), True
            elif m[0] == b"</":
                at = LETTERS.match(data, m.end()).end()
                if data[m.end() : at].lower() == tag:
                    return m.start(), templated
            elif tag == b"script":
                at, closed = self.escaped_script(m.end())
                if closed:
                    return at, templated
            else:
                at = m.end()
        return len(data), templated

    def escaped_script(self, at: int) -> tuple[int, bool]:
        """Inside <!-- of a script: nested scripts hide one closing tag each. (position, it ends the script)."""
        data, nested = self.data, False
        while m := SCRIPT_STOP.search(data, at):
            at = m.end()
            if m[0] == b"-->":
                return at, False
            at = LETTERS.match(data, at).end()
            if data[m.end() : at].lower() == b"script":
                if m[0] == b"<":
                    nested = True
                elif nested:
                    nested = False
                else:
                    return m.start(), True
        return len(data), False

    def foreign_end(self, at: int, tag: bytes) -> tuple[int, int | None]:
        """(end of the element, offset of a NUL that spoils it)."""
        data, size, quoted = self.data, len(self.data), False
        while m := FOREIGN_STOP.search(data, at):
            at = m.end()
            if m[0] == b"\x00":
                return m.start(), m.start()
            if m[0] == b'"':
                quoted = not quoted
            elif not quoted:
                at = LETTERS.match(data, at).end()
                if data[m.end() : at].lower() == tag:
                    last = FOREIGN_END.search(data, at)
                    if last and last[0] == b"\x00":
                        return last.start(), last.start()
                    return (last.end(), None) if last else (size, None)
        return size, None


def tokens(data: bytes | None, begin: str = "", end: str = "") -> Iterator[tuple]:
    """Rows of a document; none for null and empty ones."""
    if data:
        yield from Scanner(data, begin.encode(), end.encode()).rows()
