"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints of 64 bits are compared in 2^(radius+1)-1 tables. Every bit position i carries a non-zero vector
m(i) of radius+1 bits; table v keeps the positions whose m(i) has an odd product with v. The vectors of at
most ``radius`` differing positions never span the whole space, so some v is orthogonal to all of them and
its table keeps none of these positions: every pair within the radius meets in a bucket of some table.

For texts that share four fifths of their shingles, masks of the same kind are laid over minimum-hash signatures
(``groups``) and what meets is compared exactly; op3's contract takes the fingerprints alone, the pipeline's stage both.

Components are found without emitting the pairs of a bucket: (1) equal fingerprints become one row; (2) every
member of a bucket is compared with two hubs of the bucket; (3) the links are contracted to components;
(4) only buckets that still hold several components are compared further, and there only members outside the
bucket's largest component with members of other components; a bucket with many of these is first cut by a second
family of covering masks over other positions, under which every pair within the radius meets as well. What (4)
finds is contracted again. A link that is never compared joins two members which are already in one component, so
components are exact.

A node is named by its smallest document first, so the smallest node of a component names its smallest document and
no join by component is needed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, durable, forget, id_text, table, unused, words

BYTES = np.uint64(0x0101010101010101)


def fingerprint(tokens: list[bytes], shingle: int, seed: int = 42) -> int:
    """Bit set where over half the shingle hashes have it; no words: zero."""
    n = len(tokens)
    if not n:
        return 0
    if n <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(tokens), seed)
    text = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, n) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: n - shingle + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(text[a:b], seed) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist())], np.uint64)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65_280):  # 256 rows of at most 255 bytes each: lanes can't overflow
        part = hashes[i : i + 65_280]
        lanes = np.arange(0, len(part), 255)
        for bit in range(8):
            sums = np.add.reduceat((part >> np.uint64(bit)) & BYTES, lanes)
            counts[bit::8] += sums.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * counts > len(hashes)).tolist())


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long); A-Z are lower-cased, other characters stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            texts = batch.column(1)
            fps = [fingerprint(words(t, lower=True), shingle) for i in range(0, len(texts), 256) for t in texts.slice(i, 256).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def masks(radius: int, step: int = 1) -> list[int]:
    """The tables' bit masks as signed longs; another odd ``step`` deals the vectors to other positions."""
    top = 1 << (radius + 1)
    carried = [i * step % 64 % (top - 1) + 1 for i in range(64)]
    found = [sum(1 << i for i, m in enumerate(carried) if (m & v).bit_count() % 2) for v in range(1, top)]
    return [m - (1 << 64) if m >> 63 else m for m in found]


def masked(fp: Column, radius: int, step: int = 1) -> Column:
    """What each of the masks leaves of a fingerprint."""
    return F.array(*[fp.bitwiseAND(F.lit(m)) for m in masks(radius, step)])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the smallest node of its component.

    Alternates large and small star contraction; each round's edges are a table in the shared folder, and those of
    the round before are deleted.
    """
    e = durable(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = None
    while True:
        mark = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == state or not mark[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())
        state = mark
        least = durable(e.union(e.select(F.col("v"), F.col("u"))).groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = e.select(F.col("v").alias("k"), F.col("u").alias("w")).join(least.withColumnRenamed("u", "k"), "k").select(F.col("w").alias("u"), F.col("m").alias("v"))
        own = least.where("u != m").select("u", F.col("m").alias("v"))
        large = durable(large.union(own).where("u != v").distinct(), "edges")
        discard(e, least)
        small = durable(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        moved = large.join(small, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = durable(moved.union(small.select("u", F.col("m").alias("v"))).distinct(), "edges")
        discard(large, small)


def grouped(items: DataFrame, near: Callable[[Column, Column], Column], finer: Callable[[Column], Column] | None = None, confirm: Callable[[DataFrame], DataFrame] | None = None,
            crowds: Callable[[DataFrame], DataFrame] | None = None, crowd: int = 200) -> DataFrame:
    """(item, root) of every item of a table (item, keys, sig): items are linked if they meet under a key (keys are
    an array with one for each table) and ``near`` holds for their signatures. Where signatures only hint at a
    link, ``confirm`` leaves the true ones of the pairs (a, b).

    Buckets with more than ``crowd`` members outside their largest component are divided by ``finer``, further keys of
    a signature of which every linked pair shares one, or given to ``crowds``: it makes of their members (t, key, n, item)
    links that connect whatever is linked in a bucket of n members.

    The condition is part of the joins, so no pair that fails it ever becomes a row. The table is read several
    times and should be stored.
    """
    sig = lambda name, sig: items.select(F.col("item").alias(name), F.col("sig").alias(sig))
    members = items.select("item", F.posexplode("keys").alias("t", "key"))
    order = F.struct(F.xxhash64("item").alias("h"), "item")
    hubs = durable(members.groupBy("t", "key").agg(F.min(order)["item"].alias("hub"), F.max(order)["item"].alias("hub2")).where("hub != hub2"), "hubs")
    met = members.join(hubs, ["t", "key"]).select(F.col("item").alias("a"), F.explode(F.array("hub", "hub2")).alias("b")).where("a != b").distinct()
    edges = met.join(sig("a", "sig_a"), "a").join(sig("b", "sig_b"), "b").where(near(F.col("sig_a"), F.col("sig_b"))).select("a", "b")
    first = durable(components(confirm(edges) if confirm else edges), "roots")
    discard(hubs)

    labelled = durable(items.select("item").join(first.select(F.col("node").alias("item"), "root"), "item", "left").select("item", F.coalesce("root", "item").alias("root")), "labels")
    members = items.select("item", "keys").join(labelled, "item").select("item", "root", F.posexplode("keys").alias("t", "key"))
    sizes = members.groupBy("t", "key", "root").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("t", "key").agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("n"), F.count("*").alias("parts")).where("parts > 1")
    mixed = durable(mixed.select("t", "key", "n", F.col("top.root").alias("main"), (F.col("n") - F.col("top.n") > crowd).alias("crowded")), "mixed")
    inside = durable(members.join(mixed, ["t", "key"]), "inside")
    discard(first, mixed)
    packed = crowds(inside.where("crowded").select("t", "key", "n", "item")) if crowds else None
    if crowds:
        inside = inside.where("NOT crowded")
    plain = F.array(F.lit(0).cast("long"))
    cut = lambda s: F.posexplode(F.when(F.col("crowded"), finer(F.col(s))).otherwise(plain) if finer else plain).alias("s", "fine")
    names = (["item AS item_a"], ["item AS item_b"]) if confirm else ([], [])
    here = inside.join(sig("item", "sig_a"), "item").select("t", "key", *map(F.expr, names[0]), "root", "sig_a", cut("sig_a"))
    outer = inside.where("root != main").withColumnRenamed("root", "root_b").join(sig("item", "sig_b"), "item").select("t", "key", *map(F.expr, names[1]), "root_b", "sig_b", cut("sig_b"))
    on = (here["t"] == outer["t"]) & (here["key"] == outer["key"]) & (here["s"] == outer["s"]) & (here["fine"] == outer["fine"]) & (here["root"] != outer["root_b"]) & near(here["sig_a"], outer["sig_b"])
    found = here.join(outer, on)
    if confirm:
        true = confirm(found.select(F.col("item_a").alias("a"), F.col("item_b").alias("b")))
        true = true.union(packed) if packed is not None else true
        root = lambda name: labelled.select(F.col("item").alias(name), F.col("root").alias("root_" + name))
        links = true.join(root("a"), "a").join(root("b"), "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))
    else:
        links = found.select(F.col("root").alias("a"), F.col("root_b").alias("b"))
    second = components(links)
    return labelled.join(second.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("item", F.coalesce("top", "root").alias("root"))


def link(nodes: DataFrame, radius: int = 4) -> DataFrame:
    """(item, root): one row for each row of a stored table (item, fp) of different fingerprints; root is the
    smallest item of its component."""
    items = nodes.select("item", masked(F.col("fp"), radius).alias("keys"), F.col("fp").alias("sig"))
    return grouped(items, lambda a, b: F.bit_count(a.bitwiseXOR(b)) <= radius, finer=lambda fp: masked(fp, radius, 27))


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint, component_id (smallest doc_id of the component) for every row of ``docs``.

    Defined cases: null, empty and wordless texts have the fingerprint zero and are linked like any other;
    texts of fewer words than a shingle hash whole; a row with a null doc_id takes part and keeps its null, the
    smallest id ignores it (null if a component has no other); repeated rows stay; an empty table gives no
    rows; further columns are ignored.
    """
    fps = durable(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    # Ordered by the smallest document with the fingerprint, those without an id last.
    item = F.struct(F.col("least").isNull().alias("nameless"), "least", "fp").alias("item")
    nodes = durable(fps.groupBy("fp").agg(F.min("doc_id").alias("least")).select("fp", item), "nodes")
    by_fp = durable(link(nodes, radius).select("item.fp", F.col("root.least").alias("component_id")), "components")
    return fps.join(by_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: Positions of a signature go to masks by the extended Hamming code of length 8: 14 masks keep 4 positions each
#: and leave out the other 4, one keeps all 8. Any 3 positions are left out by some mask.
CODE = [[((m >> 3 & v >> 3) ^ (m >> 2 & v >> 2) ^ (m >> 1 & v >> 1) ^ (m & v)) & 1 for m in range(8, 16)] for v in range(1, 16)]
GROUPS, RANGES = 3, 256
MIX = np.random.default_rng(7).integers(1, 1 << 63, (2, 8 * GROUPS), np.uint64) | np.uint64(1)
WEIGHTS = np.random.default_rng(8).integers(1, 1 << 63, (15, 8), np.uint64) | np.uint64(1)
ONES = 0x1111111111111111


def mixed64(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ x >> np.uint64(29)


def signature(tokens: list[bytes], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys of the tables, sketch) of the different shingles of a text, as longs. The sketch takes the smallest
    hash of each of 256 ranges: four bits of it (1 to 15, 0 for an empty range) and whether there is one."""
    text, n = b" ".join(tokens), len(tokens)
    if n <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(text)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, n) + 1)
        starts = np.concatenate(([0], ends[:-1]))[: n - shingle + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(text[a:b]) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist())], np.uint64)
    least = np.array([mixed64(hashes * a + b).min() for a, b in MIX.T], np.uint64).reshape(GROUPS, 8)
    keys = np.concatenate([((least[g] * WEIGHTS * np.array(CODE, np.uint64)).sum(axis=1, dtype=np.uint64) << np.uint64(2)) + np.uint64(g) for g in range(GROUPS)])
    ordered = np.sort(hashes)
    ranges = (ordered >> np.uint64(56)).astype(np.int64)
    first = np.concatenate(([True], ranges[1:] != ranges[:-1]))
    four = np.zeros(RANGES, np.uint8)
    four[ranges[first]] = (mixed64(ordered[first]) % np.uint64(15)).astype(np.uint8) + 1
    packed = np.concatenate([four[::2] | four[1::2] << 4, np.packbits(four > 0)])
    return keys.view(np.int64), packed.view("<i8")


def may_resemble(a: Column, b: Column, least: float) -> Column:
    """Whether the resemblance estimated from two sketches is ``least`` or more, or they use too few ranges to tell.

    Of the ranges used by either, d differ in their four bits; 15 d / 14 is expected to be the share of the union
    that they don't share. Small lambdas, because a condition of many bit operations would grow into a method that
    the JVM doesn't compile.
    """
    half, longs = RANGES // 16, RANGES // 64
    used = sum((F.bit_count(F.get(a, k).bitwiseOR(F.get(b, k))) for k in range(half + 1, half + longs)), F.bit_count(F.get(a, half).bitwiseOR(F.get(b, half))))
    x = F.zip_with(F.slice(a, 1, half), F.slice(b, 1, half), lambda p, q: p.bitwiseXOR(q))
    x = F.transform(x, lambda v: v.bitwiseOR(F.shiftrightunsigned(v, 1)))
    x = F.transform(x, lambda v: v.bitwiseOR(F.shiftrightunsigned(v, 2)))
    differ = F.aggregate(x, F.lit(0), lambda n, v: n + F.bit_count(v.bitwiseAND(F.lit(ONES))))
    return (15 * differ <= 14 * (1 - least) * used) | (used < 32)


def shingles(tokens: list[bytes], shingle: int) -> set[bytes]:
    """The different shingles; a text of no more words than a shingle is one."""
    if len(tokens) <= shingle:
        return {b" ".join(tokens)}
    return set(map(b" ".join, zip(*(tokens[i:] for i in range(shingle)))))


def confirmed(pairs: DataFrame, docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The different pairs (a, b) of items whose texts share ``similarity`` of all their different shingles or more.

    Only the texts of the pairs leave the table (doc_id, h, text).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            keep = []
            for i in range(0, batch.num_rows, 256):
                for text_a, text_b in zip(batch.column(2).slice(i, 256).to_pylist(), batch.column(3).slice(i, 256).to_pylist()):
                    a, b = shingles(words(text_a, lower=True), shingle), shingles(words(text_b, lower=True), shingle)
                    both = len(a & b)
                    keep.append(both / (len(a) + len(b) - both) >= similarity)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    pairs = durable(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct(), "pairs")
    texts = texts_of(docs, pairs.select(F.col("a").alias("item")).union(pairs.select("b")))
    of = lambda name: texts.select(F.col("item").alias(name), F.col("text").alias("text_" + name))
    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "text_a", "text_b").mapInArrow(run, f"a {NODE}, b {NODE}")


NODE = "struct<doc_id: long, h: long>"


def texts_of(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(item, text) of the different ones of ``items``, stored."""
    needed = items.distinct().select("item.doc_id", "item.h")
    found = docs.join(needed, ["doc_id", "h"], "left_semi").groupBy("doc_id", "h").agg(F.min("text").alias("text"))
    return durable(found.select(F.struct("doc_id", "h").alias("item"), "text"), "texts")


def alike_within(texts: list[str | None], shingle: int, similarity: float) -> list[tuple[int, int]]:
    """Pairs of positions that connect all texts which are connected by resemblances of at least ``similarity``.

    Shingles of more than 8 texts are counted by a product of matrices, the others pair by pair.
    """
    known: dict[bytes, int] = {}  # a shingle of many texts is held once
    held = [np.fromiter((known.setdefault(g, len(known)) for g in shingles(words(t, lower=True), shingle)), np.int32) for t in texts]
    n, sizes = len(held), np.array([len(x) for x in held], np.float64)
    del known
    which = np.concatenate(held) if held else np.zeros(0, np.int32)
    order = np.argsort(which, kind="stable")
    at, which = np.repeat(np.arange(n, dtype=np.int32), [len(x) for x in held])[order], which[order]
    del held, order
    many = np.bincount(which)[which] > 8
    both = np.zeros((n, n), np.float32)
    few_at, few = at[~many], which[~many]
    for k in range(1, 8):  # texts of a shingle lie side by side
        meet = few[:-k] == few[k:]
        np.add.at(both, (few_at[:-k][meet], few_at[k:][meet]), 1)
    at, column = at[many], np.cumsum(np.diff(which[many], prepend=-1) != 0) - 1
    for k in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        a, b = np.searchsorted(column, (k, k + 4096))
        m = np.zeros((n, 4096), np.float32)
        m[at[a:b], column[a:b] - k] = 1
        both += np.triu(m @ m.T, 1)
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    found = []
    for i in range(n):
        shared = both[i, i + 1 :].astype(np.float64)
        for j in (np.flatnonzero(shared / (sizes[i] + sizes[i + 1 :] - shared) >= similarity) + i + 1).tolist():
            if (a := find(i)) != (b := find(j)):
                root[b] = a
                found.append((i, j))
    return found


def crowd_links(members: DataFrame, docs: DataFrame, shingle: int, similarity: float, block: int = 800) -> DataFrame:
    """Links (a, b) of the members (t, key, n, item) of crowded buckets. A bucket's members are dealt into blocks of
    about ``block``; a task compares two blocks, and gives out fewer links than they have members."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        links = alike_within(rows["text"].tolist(), shingle, similarity)
        ends = [rows[["doc_id", "h"]].iloc[[pair[k] for pair in links]].reset_index(drop=True) for k in (0, 1)]
        return pd.concat(ends, axis=1).set_axis(["doc_a", "h_a", "doc_b", "h_b"], axis=1)

    members = durable(members, "crowds")
    texts = texts_of(docs, members.select("item"))
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = members.withColumn("own", F.pmod(F.xxhash64("item"), blocks).cast("int"))
    dealt = own.withColumn("other", F.explode(F.when(blocks == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), blocks - 1), lambda j: j != F.col("own")))))
    dealt = dealt.select("t", "key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "item")
    held = dealt.join(texts, "item").select("t", "key", "low", "high", "item.doc_id", "item.h", "text")
    links = held.groupBy("t", "key", "low", "high").applyInPandas(run, "doc_a long, h_a long, doc_b long, h_b long")
    return links.select(*[F.struct(F.col(f"doc_{x}").alias("doc_id"), F.col(f"h_{x}").alias("h")).alias(x) for x in ("a", "b")])


def groups(docs: DataFrame, shingle: int = 5, radius: int = 4, similarity: float = 0.8, slack: float = 0.12, crowd: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h, root) of the rows with an id: groups of texts that resemble each other. h is the hash of a row's
    text, root (doc_id, h) the smallest row of its group.

    SimHash bits tell texts apart that share nine tenths of their shingles, but not reliably those that share
    four fifths: these differ in about ten of 64 bits. So besides fingerprints within ``radius``, the covering
    masks are laid over the positions of minimum-hash signatures: three signatures of eight positions, fifteen
    masks each, so that a pair that differs in at most three positions of a signature is sure to meet. The sketches
    only set aside pairs that meet and are far from alike: those estimated below ``similarity - slack`` (at 0.8 the
    estimate's deviation is about 0.025, and it is 0.014 too low for texts with many empty ranges; it isn't asked
    below 32 ranges). The others' shingles are compared (``confirmed``). In buckets with more than ``crowd`` members
    that the first links didn't join, blocks of texts are compared at once instead (``crowd_links``).

    Rows that share an id but not their text are nodes each; texts of the same words are one.
    """

    def longs(rows: list[np.ndarray]) -> pa.ListArray:
        return pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * len(rows[0]), np.concatenate(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part, rows = batch.slice(i, 256), []
                for t in part.column(2).to_pylist():
                    w = words(t, lower=True)
                    rows.append((xxhash.xxh128_digest(b" ".join(w)), fingerprint(w, shingle), *signature(w, shingle)))
                same, fps, keys, sigs = zip(*rows)
                cols = [pa.array(same, pa.binary()), pa.array(np.array(fps, np.uint64).view(np.int64)), longs(keys), longs(sigs)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *cols], names=["doc_id", "h", "same", "fp", "keys", "sig"])

    inner = id_text(docs, id_col, text_col).where("doc_id IS NOT NULL").select("doc_id", F.xxhash64("text").alias("h"), "text")
    signed = durable(inner.mapInArrow(run, "doc_id long, h long, same binary, fp long, keys array<long>, sig array<long>"), "signatures")
    firsts = signed.groupBy("same").agg(F.min(F.struct("doc_id", "h", "fp", "keys", "sig")).alias("r"))
    items = durable(firsts.select("same", F.struct("r.doc_id", "r.h").alias("item"), "r.fp", "r.keys", "r.sig"), "items")
    texts = grouped(
        items.select("item", "keys", "sig"), lambda a, b: may_resemble(a, b, similarity - slack), confirm=lambda pairs: confirmed(pairs, inner, shingle, similarity),
        crowds=lambda members: crowd_links(members, inner, shingle, similarity), crowd=crowd,
    )

    nodes = durable(items.groupBy("fp").agg(F.min("item").alias("item")), "nodes")
    bits = link(nodes, radius).union(items.join(nodes.withColumnRenamed("item", "root"), "fp").select("item", "root"))
    top = components(texts.union(bits).select(F.col("item").alias("a"), F.col("root").alias("b")))
    rooted = durable(items.join(top.withColumnRenamed("node", "item"), "item", "left").select("same", F.coalesce("root", "item").alias("root")), "groups")
    return signed.select("doc_id", "h", "same").join(rooted, "same").select("doc_id", "h", "root")


def keep_one(docs: DataFrame, shingle: int = 5, radius: int = 4, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that represent their group: of each group that with the smallest doc_id, all columns kept.

    Groups are components of both kinds of links: fingerprints within the radius, and texts at least as similar
    as ``similarity``. Rows that share an id are judged each by its own text; of rows that share id and text one
    stays, that with the smallest hash of all its columns. Rows without an id can't be named by a group and stay.
    """
    of, h, k = (unused(docs, name) for name in ("of_doc", "h", "k"))
    kept = groups(docs, shingle, radius, similarity, id_col=id_col, text_col=text_col).where("root.doc_id = doc_id AND root.h = h").select(F.col("doc_id").alias(of), F.col("h").alias(h)).distinct()
    text_hash = F.xxhash64(F.col(text_col).cast("string"))
    named = docs.join(kept, (F.col(id_col).cast("long") == F.col(of)) & (text_hash == F.col(h)))
    first = Window.partitionBy(of, h).orderBy(F.xxhash64(*[F.col(c) for c in docs.columns]))
    named = named.withColumn(k, F.row_number().over(first)).where(F.col(k) == 1).select(*docs.columns)
    return named.unionByName(docs.where(F.col(id_col).isNull()))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op3_simhash_near_dedup": op3_simhash_near_dedup}
ORACLE_SQL: dict[str, str] = {}
