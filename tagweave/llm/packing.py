"""Best-fit packing of tokenised documents into fixed-length sequences.

Bounded-space online best-fit: a task keeps at most ``open_bins`` unfinished sequences. Their free space is
the key of a bitset (an integer whose bit f is set while some open sequence has f tokens free), so the
tightest sequence that still takes a piece is one bit operation away. A piece that fits nowhere opens a
sequence; when that would exceed the bound, the fullest open sequence closes first. The packer is online, its
input isn't: pieces are held back and sorted longest first, up to ``look_ahead`` of them, so that in a small
partition this is best-fit decreasing. That is what lets the rule come near the lower bound.

Every task packs its own input partition. Sequences that are still open when it ends are taken apart, and their
pieces (without texts, a few numbers each) are packed again together with those of other tasks; a task of this
second pass takes what fills about ``group_sequences`` sequences. Sequence ids are made of the pass, the partition
number and a counter.

Defined cases: a null or empty text is one piece that holds only the end id; repeated rows are packed each;
a null doc_id stays null; an empty table gives no rows; further columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, encoder, id_text, table

SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
MARK = ", still_open boolean"


class BestFit:
    """The packer itself: ``place(length)`` gives (sequence, offset); ``closed`` lists sequences that take no more."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.open_bins = capacity, open_bins
        self.free: dict[int, list[int]] = {}
        self.bits, self.n_open, self.made = 0, 0, 0
        self.closed: list[int] = []

    def _take(self, space: int) -> int:
        stack = self.free[space]
        bin_ = stack.pop()
        if not stack:
            self.bits ^= 1 << space
        self.n_open -= 1
        return bin_

    def place(self, length: int) -> tuple[int, int]:
        fitting = self.bits >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            bin_ = self._take(space)
        else:
            space, bin_ = self.capacity, self.made
            self.made += 1
            if self.n_open >= self.open_bins:
                self.closed.append(self._take((self.bits & -self.bits).bit_length() - 1))
        left = space - length
        if left:
            stack = self.free.setdefault(left, [])
            if not stack:
                self.bits |= 1 << left
            stack.append(bin_)
            self.n_open += 1
        else:
            self.closed.append(bin_)
        return bin_, self.capacity - space


class Packing:
    """Packs pieces (doc_id, piece, start, length, crc32) of one task. ``add`` them; ``batches`` gives the rows of
    closed sequences, at the end with those of open ones, marked so."""

    def __init__(self, base: int, capacity: int, open_bins: int, look_ahead: int):
        self.base, self.look_ahead, self.packer = base, look_ahead, BestFit(capacity, open_bins)
        self.held: list[tuple] = []
        self.bins: dict[int, list[tuple]] = {}
        self.ready: list[tuple] = []

    def add(self, pieces: Iterable[tuple]) -> None:
        self.held.extend(pieces)

    def batches(self, end: bool = False) -> Iterator[pa.RecordBatch]:
        if len(self.held) < self.look_ahead and not end:
            return
        self.held.sort(key=lambda x: -x[3])
        packer = self.packer
        for row in self.held:
            bin_, offset = packer.place(row[3])
            self.bins.setdefault(bin_, []).append((*row, self.base + bin_, offset, False))
            while packer.closed:
                self.ready += self.bins.pop(packer.closed.pop())
            if len(self.ready) >= 20_000:
                yield self.flush()
        self.held.clear()
        if end:
            self.ready += [(*row[:-1], True) for rows in self.bins.values() for row in rows]
            self.bins.clear()
        if self.ready:
            yield self.flush()

    def flush(self) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 5, pa.bool_()]
        cols = [pa.array(c, k) for c, k in zip(zip(*self.ready), kinds)]
        self.ready.clear()
        return pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in (SCHEMA + MARK).split(", ")])


def pieces_of(ids: bytes, capacity: int) -> list[tuple[int, int, int]]:
    """(start, length, crc32) of the pieces of one document; only the first may be shorter than the others."""
    n = len(ids) // 4
    first = n % capacity or min(n, capacity)
    cuts = [0, *range(first, n + 1, capacity)]
    held = memoryview(ids)
    return [(a, b - a, zlib.crc32(held[4 * a : 4 * b])) for a, b in zip(cuts, cuts[1:])]


def pack(docs: DataFrame, vocabulary: str, *, white_space_dropped: bool = False, end_id: int = 2, capacity: int = 1024,
         open_bins: int = 8192, look_ahead: int = 1 << 17, group_sequences: int = 1 << 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece. ``look_ahead`` bounds the pieces held back for ordering (about 60 bytes each)."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(vocabulary, white_space_dropped)
        packing = Packing(TaskContext.get().partitionId() << 40, capacity, open_bins, look_ahead)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for i in range(0, len(ids), 1024):
                for doc, held_ids in zip(ids[i : i + 1024], tokens.encode_batch(texts.slice(i, 1024).to_pylist())):
                    packing.add((doc, k, *p) for k, p in enumerate(pieces_of(held_ids + end, capacity)))
                yield from packing.batches()
        yield from packing.batches(end=True)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packing = Packing((1 << 62) + (TaskContext.get().partitionId() << 40), capacity, open_bins, look_ahead)
        for batch in batches:
            packing.add(zip(*(c.to_pylist() for c in batch.columns)))
            yield from packing.batches()
        yield from packing.batches(end=True)

    placed = durable(id_text(docs, id_col, text_col).mapInArrow(run, SCHEMA + MARK), "pieces")
    rest = placed.where("still_open").select(*[c.split()[0] for c in SCHEMA.split(", ")[:5]])
    tokens_left = rest.agg(F.sum("length")).first()[0] or 0
    dealt = rest.repartition(-(-tokens_left // (capacity * group_sequences)) or 1)
    return placed.where("NOT still_open").union(dealt.mapInArrow(again, SCHEMA + MARK)).drop("still_open")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op8_best_fit_packing": op8_best_fit_packing}
ORACLE_SQL: dict[str, str] = {}
