"""Tokens of documents that arrive in chunks, in any order, as a stateful stream.

The state of a document is the unread tail, the number of the next chunk, the chunks that came too early and the
offset and sequence number reached. Tokens are given out up to where later bytes could change them; the rest stays
in the tail. For HTML, XML and CSS that is one construct (a raw-text element, a comment, a text), whatever the length
of the document. JSON events and JavaScript tokens depend on all that is open around them, so these documents are
kept whole until their last chunk.

A tail in which nothing could be given out is only looked at again when it has doubled, so a long construct is read
about twice and not once for every chunk. A document's state is removed with its last chunk, or when none of its
chunks came for ``timeout``; then what is there is given out as if it were the end, and marked.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import css, html, js, json, relations, xml
from ..operators.relations import text
from ..shipping import ship

STATE = "held BINARY"
HTML_CONSTRUCTS = frozenset(("StartTag", "EndTag", "Comment", "Doctype", "SVG", "Math", "XML"))
XML_CONSTRUCTS = frozenset(("StartTag", "StartTagPI", "EndTag", "Comment", "CDATA", "DOCTYPE"))
CSS_REACH = 16  # no CSS token that ends so far before the end of the bytes depends on what follows


def before_last(constructs: frozenset) -> Callable[[list[tuple], int, int], int]:
    """Tokens up to the last construct are final: it may go on."""
    return lambda found, start, size: max((i for i, t in enumerate(found) if t[0] in constructs), default=0)


def before_reach(found: list[tuple], start: int, size: int) -> int:
    return sum(1 for t in found[:-1] if t[start + 1] <= size - CSS_REACH)


def nothing(found: list[tuple], start: int, size: int) -> int:
    return 0


#: Kernel, its columns, and how many of the tokens of an unfinished text are final.
FORMATS: dict[str, tuple] = {
    "html": (html.tokens, relations.HTML, before_last(HTML_CONSTRUCTS)), "xml": (xml.tokens, relations.XML, before_last(XML_CONSTRUCTS)), "css": (css.tokens, relations.CSS_TOKENS, before_reach),
    "json": (json.events, relations.JSON, nothing), "js": (js.tokens, relations.JS_TOKENS, nothing),
}


def columns_of(schema: str) -> list[tuple[str, str]]:
    """(name, type) of the rows of a stream: offsets are long, an error is its message."""
    found = []
    for f in T.StructType.fromDDL(schema):
        kind = "STRING" if isinstance(f.dataType, T.StructType) else "LONG" if f.name in ("start", "end") else f.dataType.simpleString()
        found.append((f.name, kind))
    return found


class Document:
    """What is known of one document between chunks."""

    def __init__(self):
        self.tail, self.offset, self.seq, self.next_chunk = b"", 0, 0, 0
        self.early: dict[int, tuple[bytes, bool]] = {}
        self.ended, self.look_at = False, 0

    def add(self, number: int, chunk: bytes, last: bool) -> None:
        if number >= self.next_chunk:
            self.early[number] = (chunk, last)
        parts = [self.tail]
        while self.next_chunk in self.early and not self.ended:
            chunk, self.ended = self.early.pop(self.next_chunk)
            parts.append(chunk)
            self.next_chunk += 1
        self.tail = b"".join(parts)

    def given_out(self, kind: str, names: list[str]) -> Iterator[tuple]:
        """Rows (seq, then the format's columns, ``names``) that are final."""
        kernel, _, final = FORMATS[kind]
        if not self.ended and (len(self.tail) < self.look_at or final is nothing):
            return
        start, end = names.index("start"), names.index("end")
        found = list(kernel(self.tail))
        keep = len(found) if self.ended else final(found, start, len(self.tail))
        cut = len(self.tail) if keep == len(found) else found[keep][start]
        for row in found[:keep]:
            values = [v[0] if name == "error" and v is not None else text(v) if isinstance(v, bytes) else v for name, v in zip(names, row)]
            values[start] += self.offset
            values[end] += self.offset
            yield self.seq, *values
            self.seq += 1
        if keep or self.ended:
            self.offset += cut
            self.tail = self.tail[cut:]
        self.look_at = 2 * len(self.tail) if keep == 0 else 0


def tokens_of_chunks(chunks: DataFrame, kind: str = "html", timeout: str = "1 hour") -> DataFrame:
    """``chunks`` is a stream of (stream_id STRING, chunk_seq INT from 0, chunk BINARY, last BOOLEAN); ``kind`` one of
    FORMATS. Gives stream_id, seq, the format's columns and ``cut_off``: whether the document timed out before its last
    chunk. Chunks that come again are ignored while a document is known."""
    ship(chunks.sparkSession)
    columns = [("stream_id", "STRING"), ("seq", "INT"), *columns_of(FORMATS[kind][1]), ("cut_off", "BOOLEAN")]
    names = [name for name, _ in columns[2:-1]]
    wait = int(pd.Timedelta(timeout).total_seconds() * 1000)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        document = pickle.loads(state.get[0]) if state.exists else Document()
        for frame in frames:
            for number, chunk, last in zip(frame["chunk_seq"], frame["chunk"], frame["last"]):
                document.add(int(number), bytes(chunk), bool(last))
        cut_off = state.hasTimedOut
        document.ended |= cut_off
        rows = [(key[0], *row, cut_off) for row in document.given_out(kind, names)]
        if document.ended:
            state.remove()
        else:
            state.update((pickle.dumps(document),))
            state.setTimeoutDuration(wait)
        yield pd.DataFrame(rows, columns=[name for name, _ in columns])

    ordered = chunks.select(F.col("stream_id").cast("string").alias("stream_id"), "chunk_seq", "chunk", "last")
    schema = ", ".join(f"`{name}` {t}" for name, t in columns)
    return ordered.groupBy("stream_id").applyInPandasWithState(run, schema, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def windowed_counts(events: DataFrame, time: str, keys: list[str], width: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts per window and keys; rows later than ``late`` are left out once their window has closed."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    return events.withWatermark(time, late).groupBy(window.alias("window"), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def session_counts(events: DataFrame, time: str, keys: list[str], gap: str, late: str = "10 minutes") -> DataFrame:
    session = F.session_window(time, gap).alias("session")
    return events.withWatermark(time, late).groupBy(session, *keys).agg(F.count("*").alias("n")).select(F.col("session.start").alias("start"), F.col("session.end").alias("end"), *keys, "n")
