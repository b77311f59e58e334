"""Helpers shared by the training-data operators: reading, durable tables, words, tokenizers."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import tempfile
import uuid
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship

#: Bytes that separate words in every operator of this subpackage (same as bytes.split()).
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is configured, a temporary one if everything runs in
    this process (tests), else an error: executors elsewhere couldn't read it."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="shared-"))
    return sc.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def durable(df: DataFrame, kind: str = "step") -> DataFrame:
    """Writes a table to the shared folder and reads it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, kind)
    df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored.stored_at = path
    return stored


def discard(*tables: DataFrame) -> None:
    """Deletes durable tables that nothing reads any more."""
    for df in tables:
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name = "_" + name
    return name


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only key and text, so that further columns of the input can't clash with names used inside."""
    ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast(T.LongType()).alias("doc_id"), F.col(text_col).cast(T.StringType()).alias("text"))


def words(text: str | None, lower: bool = False) -> list[bytes]:
    """Maximal runs of bytes other than space and 0x09-0x0D; null has none. ``lower``: A-Z only."""
    if not text:
        return []
    held = text.encode("utf-8", "surrogatepass")
    return (held.lower() if lower else held).split()


LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"


class WordwiseEncoder:
    """Ids of whole texts as the tokenizers library gives them, with a bounded memo of pieces.

    Both public vocabularies first cut a text by a published pattern and never merge across its pieces. For
    texts of ASCII and Latin-1 letters the same pattern is applied here, each new piece is encoded once by the
    library, and the ids are joined. Texts with other characters, or with the string of an added token, go to the
    library whole. Runs of letters are
    encoded many at a time with a digit between them, which always stands alone and so marks where each ends.
    Pieces are first looked up in a small memo of the frequent ones, which stays in the processor's cache; a
    large memo holds the others.
    ``white_space_dropped``: the vocabulary lower-cases and ignores white space; otherwise a space belongs to
    the next word.
    """

    ALLOWED = "".join(map(chr, [10, *range(32, 127), *range(0xC0, 0x100)])).replace("×", "").replace("÷", "").encode("latin-1")
    ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"
    FINE_WORD = re.compile(f"{ENDINGS}|[a-zß-öø-ÿ]+|[0-9]|[^ \\na-zß-öø-ÿ0-9]+")
    FINE_BYTE = re.compile(f"{ENDINGS}| ?[{LETTERS}]+| ?[0-9]+| ?[^ \\n{LETTERS}0-9]+|[ \\n]+(?![^ \\n])|[ \\n]+")
    PLAIN = re.compile(f" ?[{LETTERS}]+")

    def __init__(self, path: str, white_space_dropped: bool, most: int = 1_500_000, frequent: int = 32_768, group_chars: int = 3_000_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.added = [t.content.lower() for t in self.library.get_added_tokens_decoder().values()]
        self.lower = white_space_dropped
        self.fine = (self.FINE_WORD if white_space_dropped else self.FINE_BYTE).findall
        self.between = " 0 " if white_space_dropped else "0"
        self.mark = self.library.encode("0", add_special_tokens=False).ids[0]
        self.most, self.frequent, self.group_chars = most, frequent, group_chars
        self.memo: dict[str, bytes] = {}
        self.often: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def cut(self, text: str) -> list[str] | None:
        """Pieces, or None for a text that isn't cut."""
        try:
            if text.encode("latin-1").translate(None, self.ALLOWED):
                return None
        except UnicodeEncodeError:
            return None
        if "<" in text and any(a in text.lower() for a in self.added):
            return None
        return self.fine(text.lower() if self.lower else text)

    def learn(self, pieces: set[str]) -> None:
        memo = self.memo
        if len(memo) + len(pieces) > self.most:
            memo.clear()
        plain = [p for p in pieces if self.PLAIN.fullmatch(p)]
        groups = [plain[i : i + 64] for i in range(0, len(plain), 64)]
        for group, found in zip(groups, self.library.encode_batch_fast([self.between.join([*g, ""]) for g in groups], add_special_tokens=False)):
            ids = np.array(found.ids, "<u4")
            ends = np.flatnonzero(ids == self.mark)
            if len(ends) != len(group):
                memo.update((p, self.whole(p)) for p in group)
                continue
            held, at = ids.tobytes(), 0
            for p, end in zip(group, (ends * 4).tolist()):
                memo[p] = held[at:end]
                at = end + 4
        for p in pieces.difference(plain):
            memo[p] = self.whole(p)

    def choose_often(self, cuts: list[list[str] | None]) -> None:
        """The most frequent pieces of the first texts, in fresh objects that lie side by side."""
        counts = Counter(p for c in cuts if c for p in c)
        self.often = {p[:1] + p[1:]: bytes(bytearray(self.memo[p])) for p, _ in counts.most_common(self.frequent)}

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; null and empty texts have none.

        Texts are taken in groups of bounded size, so that many new pieces meet the library at once.
        """
        out: list[bytes] = []
        group, size = [], 0
        for t in texts:
            if group and size + len(t or "") > self.group_chars:
                out += self.encode_group(group)
                group, size = [], 0
            group.append(t)
            size += len(t or "")
        return out + self.encode_group(group)

    def encode_group(self, texts: list[str | None]) -> list[bytes]:
        cuts = [self.cut(t) if t else [] for t in texts]
        get = self.often.get
        found = [None if c is None else [*map(get, c)] for c in cuts]
        places = [[i for i, ids in enumerate(f) if ids is None] if f else [] for f in found]
        rare = [[c[i] for i in at] for c, at in zip(cuts, places) if at]
        memo = self.memo
        if fresh := {p for r in rare for p in r if p not in memo}:
            if len(memo) + len(fresh) > self.most:
                fresh = {p for r in rare for p in r}
            self.learn(fresh)
        for f, c, at in zip(found, cuts, places):
            for i in at:
                f[i] = memo[c[i]]
        if len(self.often) < self.frequent and sum(map(len, filter(None, cuts))) > 8 * self.frequent:
            memo.update(self.often)
            self.choose_often(cuts)
        return [self.whole(t) if f is None else b"".join(f) for t, f in zip(texts, found)]


_KEPT: dict[object, object] = {}


def kept(key: object, make: Callable[[], object]) -> object:
    """What a worker process keeps from task to task for the operator that it runs, such as memos of words. A worker
    serves one operator after another, so what it kept for another one goes first."""
    if key not in _KEPT:
        forget()
        _KEPT[key] = make()
    return _KEPT[key]


def forget() -> None:
    """Gives back what this worker process keeps, to the system too; for operators that keep nothing."""
    if not _KEPT:
        return
    _KEPT.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
        trim(0)


def encoder(path: str, white_space_dropped: bool) -> WordwiseEncoder:
    """One encoder for each worker process, that of the vocabulary file last asked for."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    key = (path, white_space_dropped)
    return kept(key, lambda: WordwiseEncoder(*key))
