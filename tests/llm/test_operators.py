"""Each operator against brute force on small tables with nulls, empty and long texts, ties and copies."""

import hashlib
import math
import random
import re
import tracemalloc
import weakref
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import public_tokenizers
from tagweave.llm import backoff, cascade, classifier, common, extraction, linededup, mixing, packing, repair, simhash, sketches

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(texts, first=0):
    return [(first + i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty, wordless, repeated and long texts, a repeated row."""
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    long = " ".join(rng.choice(words) for _ in range(5000))
    para = ["\n".join(" ".join(rng.choice(words) for _ in range(12)) for _ in range(5)) for _ in range(12)]
    texts = [None, "", " \n\t ", "one", "one two three", long, long, *para, para[0], para[1] + "\nmore", "É ñ ß x y", "a\tb\r\nc"]
    rows = rows_of(texts)
    rows += [rows[8], (None, "no id here", None, None, None), (100, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).cache()


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def empty(spark):
    return spark.createDataFrame([], DOCS)


def clashing(df):
    """Extra columns named like columns used inside the operators."""
    for name in ("fp", "component_id", "covered", "at", "bucket", "size", "key", "block", "part", "score", "sketch", "piece", "kept", "run", "ls"):
        df = df.withColumn(name, F.lit("x"))
    return df


def everything(df):
    return df.select("doc_id", "text").collect()


def grams(text):
    return text.encode().lower().split()


# 1. Language-model scores

def brute_backoff(texts, least=2, alpha=0.4):
    seqs = [grams(t or "") for t in texts]
    counts = [Counter(g for s in seqs for g in zip(*(s[k:] for k in range(n)))) for n in (1, 2, 3)]
    total = max(1, sum(counts[0].values()))

    def one(s, i, n):
        if n == 1:
            return math.log10(counts[0][s[i],] / total)
        gram = tuple(s[i - n + 1 : i + 1])
        if counts[n - 1][gram] >= least:
            return math.log10(counts[n - 1][gram] / counts[n - 2][gram[:-1]])
        return math.log10(alpha) + one(s, i, n - 1)

    return [sum(one(s, i, min(3, i + 1)) for i in range(len(s))) for s in seqs]


def test_backoff_equals_brute_force(spark, odd):
    rows = everything(odd)
    got = backoff.backoff_scores(clashing(odd), block_words=500, part_bytes=1000).collect()
    want = Counter((r.doc_id, round(v, 6) + 0.0) for r, v in zip(rows, brute_backoff([r.text for r in rows])))
    assert Counter((r.doc_id, round(r.score, 6) + 0.0) for r in got) == want
    assert all((r.mean_score is None) == (r.n_words == 0) for r in got)


def test_backoff_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = everything(docs)
    want = dict(zip([r.doc_id for r in rows], brute_backoff([r.text for r in rows])))
    got = backoff.op1_lm_scoring(spark, SF).collect()
    assert len(got) == len(want) and all(abs(r.score - want[r.doc_id]) < 1e-4 for r in got)


def test_backoff_of_nothing(spark):
    assert backoff.backoff_scores(empty(spark)).count() == 0


# 2. Re-Pair

def whole_ids(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids + [2]


@pytest.mark.parametrize("name,dropped", [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_encoder_equals_library(name, dropped):
    texts = ["", None, "a\tb \n\n  c  d\n", "  x", "x  ", "\n\n", " ", "Ǆ ſ İ ΑΣ é <|endoftext|> a", "don't we'll\n I'm  'tis 12ab", " \n \n a", "naïve œuvre ½ x0 0 0a", "a 'll b\n's", "x,y.z!! ($3)", "ÀÖØöøÿ ×÷", "word " * 50]
    rng = random.Random(2)
    texts += ["".join(rng.choice("ab 'sRe.,!\n0é") for _ in range(60)) for _ in range(200)]
    encode, library = common.WordwiseEncoder(public_tokenizers.path(name), dropped, most=50, frequent=8), whole_ids(name)
    for _ in range(2):
        got = [np.frombuffer(b, "<u4").tolist() for b in encode.encode_batch(texts)]
        assert got == [library(t)[:-1] for t in texts]


@pytest.mark.parametrize("name,dropped", [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_added_tokens_inside_texts(name, dropped):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path(name))
    encode = common.WordwiseEncoder(public_tokenizers.path(name), dropped)
    for at, token in plain.get_added_tokens_decoder().items():
        texts = [f"x {token.content} y", token.content, f"a{token.content}b", token.content.upper(), f"<|{token.content}|>", "plain <| words |>"]
        got = [np.frombuffer(b, "<u4").tolist() for b in encode.encode_batch(texts)]
        assert got == [plain.encode(t, add_special_tokens=False).ids for t in texts] and at in got[0]


def test_repair_round_trip_and_random_access():
    rng = np.random.default_rng(3)
    for stream in (np.zeros(0, np.uint32), np.zeros(1000, np.uint32), rng.integers(0, 40, 20_000).astype(np.uint32), np.tile(np.arange(7, dtype=np.uint32), 900)):
        cuts = np.sort(rng.integers(0, len(stream) + 1, 5))
        parts = [p.astype("<u4").tobytes() for p in np.split(stream, cuts)]
        block = repair.Block(repair.dump([1, None, 3, 4, 5, 6], parts, 100))
        assert (block.ids(0, block.n_ids) == stream).all() and block.doc_ids == [1, None, 3, 4, 5, 6]
        for k, p in enumerate(parts):
            assert block.document(k).tobytes() == p
        for _ in range(20):
            a, b = sorted(rng.integers(0, len(stream) + 1, 2))
            assert (block.ids(int(a), int(b)) == stream[a:b]).all()
    body, rules = repair.compress(np.tile(np.arange(8, dtype=np.uint32), 500), 100)
    assert len(body) < 1500 and len(rules)


def check_tokens(rows, got):
    library, at, want = whole_ids("word_bpe_49k.json"), 0, Counter()
    ordered = sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    for r in ordered:
        ids = np.array(library(r.text), "<u4")
        want[r.doc_id, at, len(ids), zlib.crc32(ids.tobytes())] += 1
        at += len(ids)
    assert Counter(map(tuple, got)) == want


def test_repair_files(spark, odd, tmp_path):
    path, docs = str(tmp_path / "tokens"), clashing(odd)
    repair.write(docs, public_tokenizers.path("word_bpe_49k.json"), path, white_space_dropped=True, first=49_408, block_ids=700)
    check_tokens(everything(docs), repair.read(spark, path).collect())
    repair.write(empty(spark), public_tokenizers.path("word_bpe_49k.json"), str(tmp_path / "none"), white_space_dropped=True, first=49_408)
    assert repair.read(spark, str(tmp_path / "none")).count() == 0


def test_repair_of_documents(spark, documents):
    check_tokens(everything(documents), repair.op2_repair_tokens(spark, SF).collect())


# 3. SimHash

def brute_fingerprint(text, shingle):
    w = grams(text or "")
    shingles = [b" ".join(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps, radius=4):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = defaultdict(lambda: None)
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = d if least[find(i)] is None else min(least[find(i)], d)
    return [least[find(i)] for i in range(len(fps))]


def test_covering_masks_meet_every_pair():
    rng = random.Random(4)
    masks = [m & (1 << 64) - 1 for m in simhash.masks(4)]
    assert len(masks) == 31 and all(28 <= m.bit_count() <= 36 for m in masks)
    for _ in range(3000):
        differing = sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4)))
        assert any(not m & differing for m in masks)


def test_simhash_equals_brute_force(spark, odd):
    rows = everything(odd)
    fps = [brute_fingerprint(r.text, 4) for r in rows]
    want = Counter(zip([r.doc_id for r in rows], [f"{f:016x}" for f in fps], brute_components([r.doc_id for r in rows], fps)))
    got = simhash.near_duplicates(clashing(odd)).collect()
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == want


def test_simhash_links_of_dense_groups(spark):
    """Chains and dense groups whose members differ from the hubs by more than the radius."""
    rng = random.Random(5)
    fps = []
    for _ in range(4):
        base = rng.getrandbits(64)
        for _ in range(80):
            fps.append(base)
            for b in rng.sample(range(64), 3):
                base ^= 1 << b
        fps += [base ^ sum(1 << b for b in rng.sample(range(20), k)) for k in (1, 2, 5, 6, 7) for _ in range(20)]
    fps += [rng.getrandbits(64) for _ in range(50)]
    check_links(spark, fps)


def test_simhash_links_in_a_crowded_bucket(spark):
    """A bucket whose members share the bits a mask keeps and nothing else; some of them are near each other."""
    rng = random.Random(12)
    kept = simhash.masks(4)[5] & (1 << 64) - 1
    base = rng.getrandbits(64) & kept
    fps = [base | rng.getrandbits(64) & ~kept & (1 << 64) - 1 for _ in range(700)]
    fps += [f ^ sum(1 << b for b in rng.sample(range(64), 4)) for f in fps[:150]]
    for crowd in (1, 10_000):
        check_links(spark, fps, crowd)


def check_links(spark, fps, crowd=None):
    fps = list(dict.fromkeys(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    table = spark.createDataFrame(list(enumerate(signed)), "item long, fp long").cache()
    if crowd is None:
        got = simhash.link(table)
    else:
        items = table.select("item", simhash.masked(F.col("fp"), 4).alias("keys"), F.col("fp").alias("sig"))
        got = simhash.grouped(items, lambda a, b: F.bit_count(a.bitwiseXOR(b)) <= 4, finer=lambda fp: simhash.masked(fp, 4, 27), crowd=crowd)
    assert {r.item: r.root for r in got.collect()} == dict(enumerate(brute_components(list(range(len(fps))), fps)))


def test_both_families_of_masks_meet_every_pair():
    rng = random.Random(13)
    for step in (1, 27):
        masks = [m & (1 << 64) - 1 for m in simhash.masks(4, step)]
        assert all(any(not m & d for m in masks) for d in (sum(1 << b for b in rng.sample(range(64), 4)) for _ in range(3000)))


def test_simhash_of_documents_and_of_nothing(spark, documents):
    rows = everything(documents)
    fps = [brute_fingerprint(r.text, 4) for r in rows]
    want = dict(zip([r.doc_id for r in rows], zip([f"{f:016x}" for f in fps], brute_components([r.doc_id for r in rows], fps))))
    got = simhash.op3_simhash_near_dedup(spark, SF).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == want
    assert simhash.near_duplicates(empty(spark)).count() == 0


def jaccard(a, b):
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.split(), b.split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_similar_texts_meet(spark):
    """Copies with replaced words: those at 0.84 and more are grouped with their original, those below 0.7 not."""
    rng = random.Random(6)
    words, texts = [f"w{i}" for i in range(2000)], []
    for _ in range(60):
        base = [rng.choice(words) for _ in range(rng.choice((40, 150, 600)))]
        texts.append(" ".join(base))
        for share in (0.005, 0.02, 0.1):
            texts.append(" ".join(rng.choice(words) if rng.random() < share else w for w in base))
    got = {r.doc_id: r.root.doc_id for r in simhash.groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        j = jaccard(texts[i - i % 4], t)
        assert (got[i] == i - i % 4) if j >= 0.84 else (got[i] != i - i % 4 or j > 0.7)
    assert simhash.groups(spark.createDataFrame([], DOCS)).count() == 0


def test_similar_texts_at_the_limit(spark):
    """Pairs that share exactly four fifths of their shingles are grouped; those that lack one shingle only if their
    fingerprints link them."""
    rng, texts = random.Random(8), []
    fresh = lambda n: [f"{rng.getrandbits(40):x}" for _ in range(n)]
    for k in range(160):
        own = (3, 8, 40, 100)[k % 4]
        base = fresh(8 * own + 4 - k // 4 % 2)
        texts += [" ".join(base + fresh(own)), " ".join(base + fresh(own))]
    got = {r.doc_id: r.root.doc_id for r in simhash.groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i in range(0, len(texts), 2):
        close = (brute_fingerprint(texts[i], 5) ^ brute_fingerprint(texts[i + 1], 5)).bit_count() <= 4
        alike = jaccard(texts[i], texts[i + 1]) >= 0.8
        assert alike == (i // 8 % 2 == 0) and (got[i] == got[i + 1]) == (alike or close)


def test_blocks_of_texts_are_connected_as_pairs_are():
    rng = random.Random(15)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    texts = [" ".join(rng.choice(base) if rng.random() < rate else w for w in base) for rate in (0, 0.01, 0.02, 0.04, 0.08) for _ in range(40)] + ["", None, "a", "a b", "a"]
    links = simhash.alike_within(texts, 5, 0.8)
    want = brute_groups(texts)
    assert len(links) < len(texts)
    root = list(range(len(texts)))
    for i, j in links:
        assert jaccard(texts[i] or "", texts[j] or "") >= 0.8
        a, b = root[i], root[j]
        root = [min(a, b) if x in (a, b) else x for x in root]
    assert root == want


def test_blocks_of_long_near_copies_hold_a_shingle_once():
    rng = random.Random(17)
    base = [f"word{rng.randrange(9000)}" for _ in range(2000)]
    texts = [" ".join(f"x{rng.getrandbits(30)}" if rng.random() < 0.002 else w for w in base) for _ in range(100)]
    tracemalloc.start()
    links = simhash.alike_within(texts, 5, 0.8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(links) == 99 and peak < 12e6
    assert simhash.alike_within([], 5, 0.8) == []


def test_a_worker_keeps_only_what_its_operator_needs():
    made = [weakref.ref(common.encoder(public_tokenizers.path("byte_bpe_50k.json"), False))]
    assert common.encoder(public_tokenizers.path("byte_bpe_50k.json"), False) is made[0]()
    made.append(weakref.ref(common.kept("hasher", classifier.Hasher)))
    assert made[0]() is None and common.kept("hasher", classifier.Hasher) is made[1]()
    common.forget()
    assert made[1]() is None


def brute_groups(texts):
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if jaccard(texts[i] or "", texts[j] or "") >= 0.8 and root[i] != root[j]:
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    return root


def test_a_crowd_of_near_copies(spark):
    """Copies of one text that are changed by more and less, so that most pairs are near the limit: the links are those
    of all pairs, by joins and by blocks."""
    rng = random.Random(16)
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    texts = [" ".join(f"x{rng.getrandbits(30)}" if rng.random() < rate else w for w in base) for rate in (0.005, 0.01, 0.02, 0.03, 0.05) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for crowd in (5, 10_000):
        got = {r.doc_id: r.root.doc_id for r in simhash.groups(docs, radius=0, crowd=crowd).collect()}
        assert [got[i] for i in range(len(texts))] == brute_groups(texts)


def test_similar_odd_tables(spark, odd):
    got = simhash.groups(clashing(odd)).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in everything(odd) if r.doc_id is not None)
    assert len({r.root for r in got if r.doc_id in (0, 1, 2, 100)}) == 1
    kept = simhash.keep_one(clashing(odd))
    assert kept.columns == clashing(odd).columns and kept.where("doc_id IS NULL").count() == 1 and kept.count() == kept.distinct().count()
    assert simhash.keep_one(empty(spark)).count() == 0


def test_rows_that_share_an_id_are_judged_by_their_texts(spark):
    rng = random.Random(14)
    text = lambda: " ".join(f"{rng.getrandbits(30):x}" for _ in range(60))
    a, b, c = text(), text(), text()
    rows = [(1, a, "x"), (1, b, "y"), (2, b, "z"), (3, a, "x"), (3, c, "x"), (4, c + " more", "x"), (4, c + " more", "w"), (5, a.upper(), "x"), (1, a, "x"), (1, a, "v"), (None, a, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, of_doc string")
    for _ in range(2):
        got = sorted((r.doc_id or 0, r.text) for r in simhash.keep_one(docs).collect())
        assert got == sorted([(1, a), (1, b), (3, c), (0, a)])


def test_long_text_fingerprint():
    words = [b"%d" % (i * 7919 % 65_521) for i in range(70_000)]
    text = b" ".join(words).decode()
    hashes = np.array([xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), seed=42) for i in range(len(words) - 3)], np.uint64)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0)
    assert simhash.fingerprint(grams(text), 4) == sum(1 << i for i in range(64) if 2 * int(bits[i]) > len(hashes))


# 4. Quality rules

def brute_facts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(zip(w, w[1:], w[2:]))
    repeated = {i + k for i, g in enumerate(zip(w, w[1:], w[2:])) if windows[g] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated)


def test_rules_equal_brute_force(spark, odd):
    extra = spark.createDataFrame(rows_of(["a b c a b c a b c", "x y z " * 40, "### $$ || <> * a", "l\nl\n \n\nl", "d d d d"], 200), DOCS)
    docs = odd.unionByName(extra)
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in cascade.report(clashing(docs)).collect())
    want = Counter((r.doc_id, *(f := brute_facts(r.text)), f[0] < 50 or 100 * f[4] > 50 * f[0]) for r in everything(docs))
    assert got == want


def test_cascade_order_changes_no_verdict(spark, documents):
    kept = [{r.doc_id: r.kept for r in cascade.cascade(documents, order).collect()} for order in (list(cascade.RULES), list(cascade.RULES)[::-1], None)]
    assert kept[0] == kept[1] == kept[2] and set(kept[0].values()) == {True, False}
    assert {p[0] for p in cascade.plan(documents, 5, 300, 3)} == set(cascade.RULES)
    plan = cascade.plan(documents)
    assert {p[0] for p in plan} == set(cascade.RULES) and [p[2] / max(p[1], 1e-9) for p in plan] == sorted((p[2] / max(p[1], 1e-9) for p in plan), reverse=True)
    assert cascade.report(empty(spark)).count() == 0


# 5. Sketches

def brute_edited(rows):
    ordered = sorted(rows, key=lambda r: -r.doc_id)
    out = {}
    for i, r in enumerate(ordered):
        t, n = r.text or "", (ordered[(i + 1) % len(ordered)].text or "")
        half = len(t) // 2
        out[r.doc_id] = t[: len(t) - half] + n[:half]
    return out


def true_resemblance(a, b):
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in (a.encode().split(), b.encode().split())]
    return len(sets[0] & sets[1]) / max(1, len(sets[0] | sets[1])) if sets[0] or sets[1] else 1.0


def test_sketches_of_documents(spark, documents):
    rows = everything(documents)
    edited, text = brute_edited(rows), {r.doc_id: r.text or "" for r in rows}
    got = sketches.op5_document_fingerprints(spark, SF).collect()
    assert len(got) == len(rows)
    errors = []
    for r in got:
        assert r.edited_sha256 == hashlib.sha256(edited[r.doc_id].encode()).hexdigest() and r.n_chars == len(text[r.doc_id])
        errors.append(abs(r.near_edited - true_resemblance(text[r.doc_id], edited[r.doc_id])))
    assert np.mean(errors) < 0.03 and max(errors) < 0.2


def test_sketches_of_odd_tables(spark, odd):
    got = sketches.fingerprints(clashing(odd)).collect()
    assert len(got) == odd.count()
    by_text = defaultdict(set)
    texts = {r.doc_id: r.text or "" for r in everything(odd)}
    for r in got:
        by_text[texts[r.doc_id]].add(r.fingerprint)
    assert all(len(v) == 1 for v in by_text.values())
    one = spark.createDataFrame([(7, "a b c d e f g h")], "doc_id long, text string")
    assert sketches.fingerprints(one).first().near_next == 1.0
    assert sketches.fingerprints(empty(spark)).count() == 0


@pytest.mark.parametrize("ids", [
    [1, 2, 1023, 1024, 5000, 5_000_000, 5_000_001, 9_999_999_999], [-(1 << 63), -5, 0, 7, (1 << 63) - 1], [3], [0, *range(1 << 40, (1 << 40) + 60)],
    [random.Random(9).getrandbits(63) - (1 << 62) for _ in range(300)],
])
def test_neighbours_across_ranges(spark, ids):
    """Dense, sparse, hashed and clumped ids, with ranges of one row and more."""
    ids = sorted(ids)
    docs = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string")
    for range_rows in (1, 7, 500):
        got = {r.doc_id: r.next_text for r in sketches.with_next(docs, range_rows).collect()}
        assert got == {b: f"t{a}" for a, b in zip([ids[-1], *ids], ids)}


def test_hashed_ids_leave_no_large_range(spark):
    docs = spark.range(20_000).select(F.xxhash64("id").alias("doc_id"))
    bounds = sketches.range_bounds(docs, 100)
    sizes = [r["count"] for r in docs.groupBy(sketches.range_of(bounds)).count().collect()]
    assert len(sizes) > 150 and max(sizes) < 300


def brute_sketch(text, k):
    """Chained XXH64 of the words' XXH64, as Spark's xxhash64 of a string and of several longs."""
    def chained(hashes):
        seed = 42
        for h in hashes:
            seed = xxhash.xxh64_intdigest(h.to_bytes(8, "little"), seed)
        return seed

    h = [xxhash.xxh64_intdigest(w, 42) for w in (text or "").encode().split()]
    grams = [h[i : i + 5] for i in range(len(h) - 4)] if len(h) >= 5 else [h + [0] * (5 - len(h))] if h else []
    return sorted({x - (1 << 64) if x >> 63 else x for x in map(chained, grams)})[:k]


def test_sketches_equal_brute_force(spark, odd, documents):
    for docs in (odd, documents):
        rows = {r.doc_id: r.text for r in everything(docs) if r.doc_id is not None}
        hexes = lambda s: "".join(f"{x & (1 << 64) - 1:016x}" for x in s)
        for r in sketches.fingerprints(docs).collect():
            if r.doc_id is None:
                continue
            assert r.fingerprint == hexes(brute_sketch(rows[r.doc_id], 128))
    edited = brute_edited(everything(documents))
    for r in sketches.fingerprints(documents).collect():
        a, b = brute_sketch(rows[r.doc_id], 128), brute_sketch(edited[r.doc_id], 128)
        union = sorted(set(a) | set(b))[:128]
        j = len(set(a) & set(b) & set(union)) / len(union) if union else 1.0
        assert r.edited_fingerprint == hexes(b) and abs(r.near_edited - j) < 1e-12
        full = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in ((rows[r.doc_id] or "").split(), edited[r.doc_id].split())]
        assert not full[0] or abs(r.contained_in_edited - len(full[0] & full[1]) / len(full[0])) < 0.25


def test_sketches_merge(spark):
    a, b = "one two three four five six seven", "five six seven eight nine ten eleven twelve"
    df = spark.createDataFrame([(a, b)], "a string, b string")
    df = sketches.with_sketch(sketches.with_sketch(df, "a", "sa", 4), "b", "sb", 4)
    row = df.select("sa", "sb", sketches.merge(F.col("sa"), F.col("sb"), 4).alias("m"), sketches.distinct_count(F.col("sa"), 8).alias("n"), sketches.containment(F.col("sa"), F.col("sa"), 4).alias("c")).first()
    assert row.m == sorted(set(row.sa) | set(row.sb))[:4] and row.n == 3 and row.c == 1.0


def test_containment_of_a_part(spark):
    words = [f"w{i}" for i in range(4000)]
    df = spark.createDataFrame([(" ".join(words[:1000]), " ".join(words))], "a string, b string")
    df = sketches.with_sketch(sketches.with_sketch(df, "a", "sa"), "b", "sb")
    row = df.select(sketches.containment(F.col("sa"), F.col("sb")).alias("part"), sketches.containment(F.col("sb"), F.col("sa")).alias("whole")).first()
    assert row.part > 0.75 and 0.15 < row.whole < 0.35


# 6. Quality classifier

def test_classifier_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = classifier.op6_quality_classifier(spark, sf).collect()
    held = [r for r in rows if r.held_out and r.doc_id in quality]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert len(rows) == 1000 and len(held) > 40 and np.mean([r.predicted == quality[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)


def plain_ftrl(rows, bits, epochs=4, alpha=0.1, beta=1.0, l1=0.02, l2=0.1):
    """FTRL-Proximal by the published update, one coordinate at a time, in dictionaries."""
    z, n = defaultdict(float), defaultdict(float)
    weight = lambda i: 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)
    for _ in range(epochs):
        for text, y in rows:
            x = {1 << bits: 1.0}
            for part in classifier.families(grams_as_they_are(text), classifier.Hasher(), bits):
                for i in part.tolist():
                    x[i] = x.get(i, 0.0) + classifier.SCALE / len(part)
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-max(-35, min(35, sum(w[i] * v for i, v in x.items())))))
            for i, v in x.items():
                g = (p - y) * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * w[i]
                n[i] += g * g
    return {i: weight(i) for i in z}


def grams_as_they_are(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


def test_training_equals_plain_ftrl(spark, documents):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = [(r.text, labels[r.doc_id]) for r in everything(documents) if r.doc_id in labels and len(r.text or "") < 4000][:40] + [("", 1), (None, 0), ("a a", 1)]
    got, want = classifier.trained(rows), plain_ftrl(rows, classifier.BITS)
    assert np.abs(got).sum() > 1 and max(abs(got[i] - w) for i, w in want.items()) < 1e-4
    assert set(np.flatnonzero(got).tolist()) <= set(want)


def test_scores_equal_plain_sums(spark, documents):
    weights = np.random.default_rng(5).normal(0, 0.3, (1 << classifier.BITS) + 1).astype(np.float32)
    texts = {r.doc_id: r.text for r in everything(documents)}
    for r in classifier.score(documents, weights).collect():
        total = float(weights[-1])
        for part in classifier.families(grams_as_they_are(texts[r.doc_id]), classifier.Hasher()):
            total += classifier.SCALE * sum(float(weights[i]) for i in part.tolist()) / len(part)
        assert abs(r.score - 1 / (1 + math.exp(-max(-35, min(35, total))))) < 1e-6


def test_classifier_odd_tables(spark, odd):
    labels = spark.createDataFrame([(3, 1, 0), (7, 0, 0), (8, 1, None), (None, 1, 1), (9, None, 0), (8, 1, 0)], "doc_id long, quality int, toxic int")
    weights = classifier.train(clashing(odd), labels)
    got = classifier.score(clashing(odd), weights).collect()
    assert len(got) == odd.count() and len({r.score for r in got if r.doc_id in (0, 1, 2)}) == 1
    kept = classifier.keep_good(odd, weights, 0.0)
    assert kept.count() == odd.count() and kept.columns == odd.columns
    assert not classifier.train(empty(spark), labels).any() and classifier.score(empty(spark), weights).count() == 0


# 7. HTML extraction

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
<header><h1>Site</h1><a href="/">Home</a></header><nav><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></nav>
<div class="cookie-notice">We use cookies to make this site better for all of you, is that fine?</div>
<article><h1>Title  &amp;
more</h1><p>First <b>bold</b>text &copy; 2020 goes on for a while and says some things of note.<br>Next line</p>
<div class="ad">Buy this now</div><p>Second paragraph</p><form><label>Mail</label><input></form></article>
<aside>Related things to read</aside><section id="comments"><p>Nice article, I liked it a lot and want more of it.</p></section>
<footer>&copy; us</footer></body></html>"""


def test_extraction_of_a_page():
    assert extraction.main_text(PAGE) == "Title & more First boldtext © 2020 goes on for a while and says some things of note. Next line Second paragraph"


def test_extraction_looks_at_names_of_parts_not_of_wrappers():
    body = "<p>" + "Words of the story go here and on and on for some time. " * 3 + "</p>"
    story = extraction.main_text(f"<article>{body}</article>")
    assert story and extraction.main_text(f"<div class='page has-sidebar'><article class='post advertising-news'>{body}</article></div>") == story
    assert extraction.main_text(f"<article>{body}</article><section class=comments><article class='comment'>{body}</article></section>") == story
    assert extraction.main_text(f"<div>{body}</div><div id='sidebar'>{body}</div><div role=navigation>{body}</div><div style='display:none'>{body}</div>") == story


def test_extraction_drops_only_what_is_hidden():
    body = "<p>" + "Plain words of a story that goes on. " * 8 + "</p>"
    story = extraction.main_text(f"<article>{body}</article>")
    for shown in ('class="overflow-hidden"', "class='md:hidden x'", 'data-hidden-x', 'data-hidden="1"', 'style="overflow:hidden"', 'aria-hidden="false"', 'title="display: none"'):
        for page in (f"<body {shown}><article>{body}</article></body>", f"<div {shown}><article>{body}</article></div>", f"<article {shown}>{body}</article>", f"<div {shown}>{body}</div>"):
            assert extraction.main_text(page) == story, page
    for gone in ("hidden", 'hidden=""', 'HIDDEN="hidden"', "aria-hidden=true", 'style="color:red; Display : none"', "style='visibility:hidden!important;top:0'"):
        assert extraction.main_text(f"<article>{body}<div {gone}>{body}</div></article>") == story, gone


def test_extraction_keeps_parts_of_an_article_whose_names_only_hint():
    body, part = "<p>" + "Plain words of a story that goes on. " * 8 + "</p>", "<p>" + "Others wrote of it in earlier years too. " * 40 + "</p>"
    for names in ('id="related-work"', 'class="legal-analysis"', "class='social-science x'", 'id="share-price"', 'aria-label="Related work in search"'):
        got = extraction.main_text(f"<article>{body}<section {names}><h2>Earlier work</h2>{part}</section></article>")
        assert "Earlier work" in got and got.count("Others wrote") == 40, names
    assert extraction.main_text(f"<article>{body}<h2 id='search-algorithms'>How to search</h2>{part.replace('<p>', '<p class=section-header>')}</article>").count("How to search Others") == 1
    story = extraction.main_text(f"<article>{body}</article>")
    for names in ("class=related", "class='x share-buttons'", "id=post-footer", "role=navigation", "class=related-posts"):
        assert extraction.main_text(f"<article>{body}<div {names}>{part}</div></article>") == story, names
    assert extraction.main_text(f"<article>{body}<div class=share-it><a href=x>Tell your friends</a></div></article>") == story


def test_extraction_of_pages_that_break_the_list_of_names():
    body = "".join(f"<p>{w} words of the story go here and on and on for some time, and then they go on again for a while. " * 3 + "</p>" for w in ("Plain", "Other", "Last"))
    story = extraction.main_text(f"<article>{body}</article>")
    assert story.count("words of the story") == 9
    for wrapper in ("<form>", "<form action=x class=main-form>", "<div class='sidebar-layout'>", "<div class=search-result>", "<div id=comments-page-wrapper>", "<div class='menu-open nav-down'>", "<section class=news-related-topic>"):
        end = "</" + re.match(r"<(\w+)", wrapper)[1] + ">"
        for inner in (f"<article>{body}</article>", body):
            page = f"<body>{wrapper}<nav><a href=a>One</a></nav>{inner}<div class=site-footer>All rights</div>{end}</body>"
            assert extraction.main_text(page) == story, page
    head = "<header><h1>Title of the story</h1><span>By A. Writer</span></header>"
    assert extraction.main_text(f"<body><header><h1>Site name</h1></header><article>{head}{body}</article></body>") == "Title of the story " + story
    for gone in ("<form><label>Mail</label><input><button>Send</button></form>", "<form>Sign up for our letter</form>", "<section class=comments><p>Nice story, I liked it a lot and want more of it, and so on and so forth for many words.</p></section>", "<div class=cookie-notice>We use cookies to make this site better for all of you, is that fine?</div>"):
        assert extraction.main_text(f"<body><div>{body}</div>{gone}</body>") == story, gone
        assert extraction.main_text(f"<body><article>{body}</article>{gone}</body>") == story, gone


def test_neighbours_decide_where_there_is_a_hint():
    """The same block is kept between long blocks without links and dropped between links: the tree uses neighbours."""
    block, long, links = "<div class=share-it>Twelve words that may be part of the text or may not be</div>", "<p>" + "Plain words of a story that goes on. " * 8 + "</p>", "<p><a href=a>One</a> <a href=b>Two</a></p>"
    assert "Twelve" in extraction.main_text(f"<div>{long}{block}{long}</div>") and "Twelve" not in extraction.main_text(f"<div>{links}{block}{links}</div>")
    used = set()

    def walk(node):
        if isinstance(node, tuple):
            used.add(extraction.FEATURES[node[0]])
            walk(node[2]), walk(node[3])

    walk(extraction.tree())
    assert {"words", "links", "furniture", "hint", "article"} <= used and used & {"words_before", "words_after", "links_before", "links_after"} and used & {"links_after", "links_before"}


def test_extraction_goes_on_after_elements_without_an_end():
    body, rest = ("<p>" + w * 8 + "</p>" for w in ("Plain words of a story that goes on. ", "The rest of it comes after that. "))
    story = extraction.main_text(f"<article>{body}{rest}</article>")
    for odd in ('<svg class="i"/>', "<math/>", "<select><option>Red<option>Blue", "<object data=x>", "<canvas>", "<iframe src='a'>", "<template>", "<noscript>"):
        tag = re.match(r"<(\w+)", odd)[1]
        for tail in ("", f"<div><{tag}></{tag}></div>"):
            assert extraction.main_text(f"<body><article>{body}{odd}{rest}{tail}</article></body>") == story, odd
    for gone in ("<svg><svg><text>x y</text></svg><text>z</text></svg>", "<select><option>Red</select>", "<object><object>x</object>y</object>", "<iframe>no frames</iframe>"):
        assert extraction.main_text(f"<article>{body}{gone}{rest}</article>") == story, gone
    assert extraction.main_text("<article><p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p></article>") == "so x=2 holds"
    assert len(extraction.main_text("<article>" + "<select><p>word" * 20_000)) > 0


@pytest.mark.parametrize("page,want", [(None, ""), ("", ""), ("<article><p>cut off he", "cut off he"), ("<article>a<scr", "a"), ("<article>x<!-- open", "x"), ("<article><p title='>'>q</p>", "q"), ("<" * 2000, ""), ("<article>1 < 2 &lt; 3</article>", "1 < 2 < 3")])
def test_extraction_of_odd_pages(page, want):
    got = extraction.main_text(page)
    assert got == want if page != "<" * 2000 else isinstance(got, str)


def test_extraction_of_pages(spark):
    import html

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = extraction.op7_html_extraction(spark, SF).collect()
    for r in got:
        inner = re.search(r"<article>(.*?)(</article>|\Z)", pages[r.page_id], re.S)
        assert r.text == " ".join(html.unescape(re.sub(r"<[^>]*>|<[^>]*\Z", " ", inner[1])).split()) and r.n_chars == len(r.text)
    odd = spark.createDataFrame([(1, None, None, "x"), (1, "u", "", "x"), (None, "u", "<p>hi", "x")], "page_id long, url string, html string, text string")
    assert extraction.extract(odd).count() == 3 and extraction.extract(odd.limit(0)).count() == 0


# 8. Packing

def check_packing(rows, got, capacity=1024):
    library = whole_ids("byte_bpe_50k.json")
    want = Counter()
    for r in rows:
        ids = np.array(library(r.text), "<u4")
        first = len(ids) % capacity or min(len(ids), capacity)
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[r.doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), -(-sum(r.length for r in got) // capacity)


def test_packing_of_documents(spark, documents):
    bins, least = check_packing(everything(documents), packing.op8_best_fit_packing(spark, SF).collect())
    assert bins <= 1.05 * least


@pytest.mark.parametrize("partitions", [1, 32, 211])
def test_packing_hardly_depends_on_partitions(spark, partitions):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(partitions)
    got = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()
    bins = {r.sequence_id for r in got}
    assert len(bins) <= 1.01 * -(-sum(r.length for r in got) // 1024)


def test_packing_in_many_groups(spark, documents):
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    check_packing(everything(documents), packing.pack(documents.repartition(7), vocabulary, open_bins=5, group_sequences=10).collect())


def test_packing_of_odd_tables(spark, odd):
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    check_packing(everything(odd), packing.pack(clashing(odd), vocabulary, open_bins=2, look_ahead=3).collect())
    assert packing.pack(empty(spark), vocabulary).count() == 0


def test_best_fit_takes_the_tightest_and_closes_the_fullest():
    p = packing.BestFit(10, 2)
    assert p.place(6) == (0, 0) and p.place(7) == (1, 0)  # 4 and 3 free
    assert p.place(3) == (1, 7) and p.place(5) == (2, 0)  # fills the second; a third opens
    assert p.place(6) == (3, 0) and p.place(4) == (3, 6)  # the fullest (4 free) closed, one of its kind stays


# 9. Mixing

def brute_targets(sizes, weights=(5, 2, 1)):
    names = sorted((n for n in sizes if n is not None), key=lambda s: s.encode()) + [n for n in sizes if n is None]
    w = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    total, left, fixed = sum(sizes.values()), dict(w), {}
    while left:
        rest, share = total - sum(fixed.values()), sum(left.values())
        over = [n for n in left if rest * left[n] / share > 3 * sizes[n]]
        if not over:
            return fixed | {n: rest * left[n] / share for n in left}
        for n in over:
            fixed[n] = 3.0 * sizes[n]
            del left[n]
    return fixed


def check_mix(rows):
    sizes, taken, target = Counter(), Counter(), {}
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
    want = brute_targets(dict(sizes))
    biggest = defaultdict(int)
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        biggest[r.source] = max(biggest[r.source], r.size)
    assert all(abs(taken[s] - target[s]) <= biggest[s] / 2 + 1e-6 for s in sizes)


def test_mixing_of_documents(spark, documents):
    rows = mixing.mix(mixing.sizes_and_weights(documents)).collect()
    assert len(rows) == documents.count()
    check_mix(rows)
    again = mixing.op9_mixing_sources(spark, SF)
    assert sorted(again.collect()) == sorted(mixing.op9_mixing_sources(spark, SF).collect())


@pytest.mark.parametrize("sizes", [{"a": 1, "b": 1000, "c": 5}, {"a": 0, None: 7}, {"x": 3}, {"a": 1, "b": 1, "c": 1, "d": 10_000, None: 2}, {"é": 10, "z": 10, "Z": 10}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df, (5, 2, 1)).collect()}
    want = brute_targets(sizes)
    assert all(abs(got[s] - want[s]) < 1e-6 for s in sizes)


def test_mixing_of_odd_tables(spark, odd):
    check_mix(mixing.mix(mixing.sizes_and_weights(clashing(odd)), part_rows=2).collect())
    assert mixing.mix(mixing.sizes_and_weights(empty(spark))).count() == 0
    repeated = mixing.repeat_taken(odd)
    assert repeated.columns == odd.columns


def test_heavier_documents_are_taken_more_often(spark):
    rows = [(i, "a", 1, 1.0 if i % 2 else 0.1) for i in range(4000)] + [(10_000 + i, "b", 1, 1.0) for i in range(4000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, size int, weight double"), (1, 3)).where("source = 'a' AND taken > 0").collect()
    heavy = sum(r.doc_id % 2 for r in got)
    assert len(got) == 2000 and heavy > 0.7 * len(got)


def test_parts_of_bins_change_nothing_and_stay_small(spark):
    """A source whose weights are all small, a third of all rows: results as with one part, and no part is large."""
    rows = [(i, "code" if i % 3 == 0 else "web", i % 50, 0.05 if i % 3 == 0 else 1.0) for i in range(30_000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long, weight double")
    whole, parts = (sorted(mixing.mix(df, part_rows=n).collect()) for n in (1 << 40, 16))
    assert whole == parts
    check_mix(whole)
    key = -F.log((F.conv(F.substring(F.md5(F.concat(F.lit("42:"), F.col("doc_id").cast("string"))), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)) / F.col("weight")
    assert df.groupBy("source", F.floor(F.log2(key) * mixing.BINS)).count().agg(F.max("count")).first()[0] < 200


def test_mixing_by_a_column_of_scores(spark):
    docs = spark.createDataFrame([(i, "a b c", "s", 0.9 if i % 2 else 0.01) for i in range(2000)] + [(5000 + i, "a b c", "t", 1.0) for i in range(2000)], "doc_id long, text string, source string, quality double")
    got = mixing.mix(mixing.sizes_and_weights(docs, weight_col="quality"), (1, 3)).where("source = 's' AND taken > 0").collect()
    assert sum(r.doc_id % 2 for r in got) > 0.8 * len(got) > 0


# 10. Line dedup

def brute_lines(rows, long_words=math.inf):
    first, windows = {}, []
    for r in {(r.doc_id, r.text) for r in rows if r.doc_id is not None and r.text is not None}:
        lines = r[1].split("\n")
        for at in range(len(lines)):
            for size in (1, 2, 3):
                part = tuple(lines[at : at + size])
                if len(part) == size and (size == 3 or sum(len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in part) > long_words):
                    windows.append((part, r[0], at, size))
                    first[part] = min(first.get(part, (r[0], at)), (r[0], at))
    gone = defaultdict(set)
    for part, doc, at, size in windows:
        if (doc, at) > first[part]:
            gone[doc].update(range(at, at + size))
    return [(r.doc_id, r.text if r.doc_id is None or r.text is None else "\n".join(x for i, x in enumerate(r.text.split("\n")) if i not in gone[r.doc_id])) for r in rows]


def test_line_dedup_equals_brute_force(spark, odd):
    block = "\n".join(f"line {i} of a passage" for i in range(6))
    wide = " ".join(f"w{i}" for i in range(60))
    extra = spark.createDataFrame(rows_of([block, "x\n" + block + "\ny\n" + block, "a\na\na\na\na", wide, "p\n" + wide + "\nq", "\n\n\n\n", wide + "x\nshort", "z\n" + wide + "x\nshort"], 300), DOCS)
    docs = odd.unionByName(extra)
    wide_docs = clashing(docs)
    for name in ("__covered", "__lines", "of_doc", "_of_doc", "covered", "lines", "n", "first", "w1"):
        wide_docs = wide_docs.withColumn(name, F.lit("kept"))
    for long_words in (None, 50):
        got = linededup.dedup_lines(wide_docs, long_words)
        assert Counter(map(tuple, everything(got))) == Counter(brute_lines(everything(docs), long_words or math.inf))
        assert got.columns == wide_docs.columns and got.where("__lines <> 'kept' OR covered <> 'kept'").count() == 0
    assert linededup.dedup_lines(empty(spark)).count() == 0


def test_line_dedup_of_documents(spark, documents):
    got = {r.doc_id: r.text for r in linededup.op10_line_dedup(spark, SF).collect()}
    assert got == dict(brute_lines(everything(documents), 50))
