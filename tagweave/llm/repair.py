"""Token ids in Re-Pair compressed binary blocks.

Documents are dealt by ranges of doc_id, so shard numbers and rows ascend with the ids. A shard is cut into
blocks of about ``block_ids`` ids (a longer document is one block). In each block frequent pairs of adjacent
ids are replaced by nonterminals, round after round; a pair that overlaps a more frequent one waits for a later
round. A block is one binary value in a Parquet file of the shared folder:

    magic "RPB1"; uint32: documents, rules, body symbols, first nonterminal; uint64: ids
    int64 doc_id, uint8 (1: doc_id is null) and uint32 length of each document
    uint32 left, right and expansion length of each rule
    body symbols, uint16 if all rules and ids fit, else uint32

All integers are little-endian. Expansion lengths let ``Block.ids(start, stop)`` find and expand just the
symbols that cover a range.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import encoder, id_text, new_path, table

MAGIC, HEAD = b"RPB1", struct.Struct("<4s4IQ")
FILE_SCHEMA = "shard int, block int, block_start long, n_ids long, data binary"


#: Least count of the pairs that a round replaces: the most frequent ones first.
ROUNDS = (96, 32, 12, 8)


def compress(ids: np.ndarray, first: int, rounds: tuple[int, ...] = ROUNDS, table_bits: int = 18) -> tuple[np.ndarray, np.ndarray]:
    """(body, rules): rules[k] is the pair that nonterminal first + k stands for. The last round is repeated
    while it shortens the body by a twentieth."""
    body, rules = ids.astype(np.uint32), []
    made, slots = first, 1 << table_bits
    waiting = list(rounds)
    while waiting:
        least, n = waiting.pop(0), len(body)
        if n < 2 * least:
            continue
        slot = (((body[:-1] * np.uint32(0x9E3779B1) + body[1:]) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - table_bits)).astype(np.intp)
        often = np.bincount(slot, minlength=slots) >= least
        at = np.flatnonzero(often[slot])
        slot = slot[at]
        key = body[at].astype(np.uint64) << np.uint64(32)
        key |= body[at + 1]
        shown = np.zeros(slots, np.uint64)
        shown[slot] = key  # one pair of a slot is counted in a round
        same = shown[slot] == key
        at, slot = at[same], slot[same]
        weight = np.bincount(slot, minlength=slots)[slot]
        good = weight >= least
        at, slot, weight = at[good], slot[good], weight[good]
        weight <<= table_bits
        weight += slot  # unequal for unequal pairs
        # A pair is replaced where it outweighs the pairs that overlap it; of a run of equal ones the first.
        beside = at[1:] == at[:-1] + 1
        chosen = np.ones(len(at), bool)
        chosen[1:] &= ~beside | (weight[1:] > weight[:-1])
        chosen[:-1] &= ~beside | (weight[:-1] >= weight[1:])
        at, slot = at[chosen], slot[chosen]
        worth = np.bincount(slot, minlength=slots) >= least // 2
        good = worth[slot]
        at, slot = at[good], slot[good]
        if not len(at):
            continue
        fresh = np.flatnonzero(worth)
        number = np.zeros(slots, np.uint32)
        number[fresh] = np.arange(made, made + len(fresh), dtype=np.uint32)
        rules.append(np.stack([shown[fresh] >> np.uint64(32), shown[fresh] & np.uint64(0xFFFFFFFF)], axis=1).astype(np.uint32))
        made += len(fresh)
        keep = np.ones(n, bool)
        keep[at + 1] = False
        body[at] = number[slot]
        body = body[keep]
        if not waiting and len(at) >= n // 20:
            waiting.append(least)
    return body, np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)


def lengths_of(rules: np.ndarray, first: int) -> np.ndarray:
    """Expansion lengths; a rule only refers to ids and to rules of earlier rounds."""
    out = np.zeros(len(rules), np.int64)
    left, right = rules[:, 0].astype(np.int64) - first, rules[:, 1].astype(np.int64) - first
    while (todo := np.flatnonzero(out == 0)).size:
        l, r = left[todo], right[todo]
        ll, rr = np.where(l < 0, 1, out[np.maximum(l, 0)]), np.where(r < 0, 1, out[np.maximum(r, 0)])
        ready = (ll > 0) & (rr > 0)
        out[todo[ready]] = (ll + rr)[ready]
    return out


def dump(doc_ids: list[int | None], ids: list[bytes], first: int) -> bytes:
    sizes = np.array([len(x) // 4 for x in ids], "<u4")
    stream = np.frombuffer(b"".join(ids), "<u4")
    body, rules = compress(stream, first)
    kind = "<u2" if first + len(rules) <= 1 << 16 else "<u4"
    nulls = np.array([d is None for d in doc_ids], np.uint8)
    return b"".join((
        HEAD.pack(MAGIC, len(sizes), len(rules), len(body), first, len(stream)), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), nulls.tobytes(), sizes.tobytes(),
        rules[:, 0].astype("<u4").tobytes(), rules[:, 1].astype("<u4").tobytes(), lengths_of(rules, first).astype("<u4").tobytes(), body.astype(kind).tobytes(),
    ))


class Block:
    """A block read back; ``ids(start, stop)`` expands any range, ``document(k)`` the k-th document."""

    def __init__(self, data: bytes):
        magic, docs, n_rules, n_body, self.first, self.n_ids = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a Re-Pair block")
        at = HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(data, kind, n, at)
            at += got.nbytes
            return got

        doc_ids, nulls, self.sizes = take("<i8", docs), take("u1", docs), take("<u4", docs)
        self.doc_ids = [None if z else d for d, z in zip(doc_ids.tolist(), nulls.tolist())]
        self.left, self.right, lengths = take("<u4", n_rules), take("<u4", n_rules), take("<u4", n_rules)
        self.body = take("<u2" if self.first + n_rules <= 1 << 16 else "<u4", n_body).astype(np.int64)
        self.lengths = lengths.astype(np.int64)
        self.flat: np.ndarray | None = None
        sized = np.where(self.body < self.first, 1, self.lengths[np.maximum(self.body - self.first, 0)] if n_rules else 1)
        self.ends = np.cumsum(sized)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes, dtype=np.int64)))

    def ids(self, start: int, stop: int) -> np.ndarray:
        if stop <= start:
            return np.zeros(0, "<u4")
        low, high = np.searchsorted(self.ends, [start, stop - 1], side="right")
        skip = start - (int(self.ends[low - 1]) if low else 0)
        return self.expanded(self.body[low : high + 1])[skip : skip + stop - start]

    def expanded(self, symbols: np.ndarray) -> np.ndarray:
        """Symbols expanded; those of more than one level at once, by the flat expansions of the rules."""
        if not len(self.left):
            return symbols.astype("<u4")
        if self.flat is None:
            rules = np.stack([self.left, self.right], axis=1).astype(np.int64).reshape(-1)
            while (deep := rules >= self.first).any():
                wide = np.repeat(rules, np.where(deep, 2, 1))
                at = np.cumsum(np.where(deep, 2, 1)) - 1
                k = rules[deep] - self.first
                wide[at[deep]] = self.right[k]
                wide[at[deep] - 1] = self.left[k]
                rules = wide
            self.flat = rules.astype("<u4")
            self.flat_at = np.cumsum(self.lengths) - self.lengths
        deep = symbols >= self.first
        k = np.maximum(symbols - self.first, 0)
        sized = np.where(deep, self.lengths[k], 1)
        ends = np.cumsum(sized)
        out = np.empty(int(ends[-1]), "<u4")
        out[(ends - sized)[~deep]] = symbols[~deep]
        ends, sized, begins = ends[deep], sized[deep], self.flat_at[k[deep]]
        for j in range(int(sized.max(initial=0))):  # the j-th id of every nonterminal that is longer
            if j:
                more = sized > j
                if not more.all():
                    ends, sized, begins = ends[more], sized[more], begins[more]
            out[ends - sized + j] = self.flat[begins + j]
        return out

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))


def write(docs: DataFrame, vocabulary: str, path: str, *, white_space_dropped: bool, first: int, end_id: int = 2,
          block_ids: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the files. ``first``: the smallest number that is not an id of the vocabulary.

    Defined cases: null and empty texts are the end id alone; null ids come first; rows that share an id stay
    side by side in any order; an empty table gives a file without blocks; further columns are ignored.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, shard = encoder(vocabulary, white_space_dropped), TaskContext.get().partitionId()
        ids: list[int | None] = []
        held: list[bytes] = []
        block = begun = gathered = 0

        def flush() -> pa.RecordBatch:
            nonlocal block, begun, gathered
            row = [[shard], [block], [begun], [gathered], [dump(ids, held, first)]]
            block, begun, gathered = block + 1, begun + gathered, 0
            ids.clear()
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))], names=["shard", "block", "block_start", "n_ids", "data"])

        for batch in batches:
            names = batch.column(0).to_pylist()
            for i in range(0, len(names), 1024):
                for name, found in zip(names[i : i + 1024], tokens.encode_batch(batch.column(1).slice(i, 1024).to_pylist())):
                    if held and gathered + len(found) // 4 >= block_ids:
                        yield flush()
                    ids.append(name)
                    held.append(found + end)
                    gathered += len(found) // 4 + 1
        if held:
            yield flush()

    dealt = id_text(docs, id_col, text_col).repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    dealt.mapInArrow(run, FILE_SCHEMA).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of the files, from their blocks."""
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    sizes = files.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    starts = sizes.select(F.col("shard").alias("of_shard"), (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("shard_start"))
    # A row for each shard, that is for each shuffle partition: small whatever the size of the corpus.
    placed = files.join(F.broadcast(starts), F.col("shard") == F.col("of_shard")).select((F.col("shard_start") + F.col("block_start")).alias("at"), "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                block = Block(data.as_py())
                whole, cuts = memoryview(block.ids(0, block.n_ids).tobytes()), block.starts
                crcs = [zlib.crc32(whole[4 * a : 4 * b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
                cols = [pa.array(block.doc_ids, pa.int64()), pa.array(at + cuts[:-1]), pa.array(block.sizes.astype(np.int64)), pa.array(crcs, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op2_repair_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_path(spark, "repair")
    write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), path, white_space_dropped=True, first=49_408)
    return read(spark, path)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op2_repair_tokens": op2_repair_tokens}
ORACLE_SQL: dict[str, str] = {}
