"""Packing, lexical search and the dataset manifest against plain versions of them."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lacuna.llm import bpe, lexical, manifest, packing
from lacuna.llm.queries import BYTE_TOKENIZER, QUERIES

FOLDER = "/root/testdata/sf0.001"
SOURCE = bpe.read_tokenizer(BYTE_TOKENIZER)
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
ODD = ["", "a", "it's 12 <|endoftext|> x<|endoftext|>", "<|endoftext", "é 日本語 😀 ‍x", " \n\n  a\t", "\x00\x1f", "don't WE'LL  'S", "a" * 5000]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(BYTE_TOKENIZER)


# Packing

@pytest.mark.parametrize("text", ODD)
def test_byte_ids_of_odd_texts(library, text):
    assert packing.ByteBPE(SOURCE).ids(text).tolist() == library.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_byte_ids_of_any_text(library, text):
    assert packing._tokenizer(SOURCE).ids(text).tolist() == library.encode(text, add_special_tokens=False).ids


def best_fit(counts, capacity):
    rooms = []
    for n in range(capacity, 0, -1):
        for _ in range(int(counts[n])):
            fit = [r for r in rooms if r >= n]
            if fit:
                rooms.remove(min(fit))
                rooms.append(min(fit) - n)
            else:
                rooms.append(capacity - n)
    return len(rooms)


def check_patterns(counts, capacity):
    found = packing.patterns(counts, capacity)
    got = np.zeros(capacity + 1, int)
    for pattern, number in found:
        assert number > 0 and sum(n * k for n, k in pattern) <= capacity
        for n, k in pattern:
            got[n] += k * number
    assert got.tolist() == counts.tolist()
    return sum(number for _, number in found)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 59), max_size=80))
def test_patterns_hold_every_length_and_pack_tightly(lengths):
    counts = np.bincount(lengths, minlength=61).astype(int) if lengths else np.zeros(61, int)
    used, total = check_patterns(counts, 60), sum(lengths)
    assert used <= best_fit(counts, 60) + 1 and used >= -(-total // 60)


def test_program_beats_best_fit_on_many_pieces():
    # 26 + 27 + 47 fills a sequence; best fit puts two of 47 together and has no use for the room of 6.
    counts = np.zeros(101, int)
    counts[[26, 27, 47]] = 30_000
    assert check_patterns(counts, 100) <= 30_010
    # Where long pieces have too few short ones beside them, the rounding stays close to best fit.
    counts = np.random.default_rng(3).integers(0, 40, 101)
    counts[[0, 100]] = 0
    assert check_patterns(counts, 100) <= 1.015 * best_fit(counts, 100)


def test_knapsack_prices_equal_an_exhaustive_search():
    rng = np.random.default_rng(5)
    worth = np.full(31, -np.inf)
    worth[[4, 7, 9, 13]] = rng.random(4)
    best, _ = packing.price(worth, 30)
    want = max(a * worth[4] + b * worth[7] + c * worth[9] + d * worth[13] for a in range(8) for b in range(5)
               for c in range(4) for d in range(3) if 4 * a + 7 * b + 9 * c + 13 * d <= 30)
    assert best[30] == pytest.approx(want)


def check_packing(rows, docs, library, capacity, end=0):
    """Pieces are the documents, sequences are gapless, and few."""
    want = Counter()
    for doc_id, text in docs:
        ids = library.encode(text or "", add_special_tokens=False).ids + [end]
        n = -(-len(ids) // capacity)
        first = len(ids) - (n - 1) * capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        for k, (x, y) in enumerate(zip(cuts, cuts[1:])):
            want[doc_id, k, x, y - x, zlib.crc32(np.array(ids[x:y], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    held = {}
    for r in rows:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(r["length"] for r in rows)
    assert not rows or len(held) <= -(-total // capacity) * 1.02 + 1


def test_packing_query(spark, library):
    rows = QUERIES["op11_bestfit_packing"](spark, FOLDER).collect()
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    check_packing(rows, docs, library, 2048)


def test_packing_of_odd_rows(spark, library):
    docs = [(i, t) for i, t in enumerate(ODD)] + [(None, "b"), (None, None), (3, "same"), (3, "same"), (4, "x y z " * 700)] * 3
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5).withColumn("sequence_id", F.lit("other"))
    pieces = packing.cut(df, SOURCE, 64)
    assert pieces.columns == ["id", "piece", "start", "length", "ids"]
    packed = packing.assign(pieces.withColumn("offset", F.lit("clash")), 64).cache()
    rows = packed.select(F.col("id").alias("doc_id"), "piece", "start", "length", F.crc32("ids").alias("ids_crc32"),
                         "sequence_id", "offset").collect()
    check_packing(rows, docs, library, 64)
    # The sequences themselves hold the ids of their pieces one behind the other.
    whole = {r["sequence_id"]: np.frombuffer(r["ids"], "<u4") for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        assert whole[r["sequence_id"]][r["offset"]:r["offset"] + r["length"]].tobytes() == bytes(r["ids"])
    packed.unpersist()


def test_packing_of_nothing_and_of_bad_lengths(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert packing.pack(empty, SOURCE).count() == 0
    for length in (0, 9):
        with pytest.raises(Exception, match="1 to 8 tokens"):
            packing.assign(spark.createDataFrame([(length,)], "length bigint"), 8).count()


# Search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms_of(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_search(docs, items, k):
    words = [terms_of(t) for _, t in docs]
    n_docs, n_terms = sum(bool(w) for w in words), sum(map(len, words))
    df, out = Counter(t for w in words for t in set(w)), []
    for item_id, text in items:
        found = []
        for (doc_id, _), w in zip(docs, words):
            tf, score = Counter(w), 0
            for t in set(terms_of(text)) & set(tf):
                weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                m = 50 + 50 * len(w) * n_docs // n_terms
                score += weight * (1_000_000_000 * tf[t] // (1000 * tf[t] + 20 * m))
            if score > 0:
                found.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def as_sorted(rows):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in rows), key=repr)


def test_search_equals_scoring_every_document(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    assert as_sorted(QUERIES["op12_lexical_search"](spark, FOLDER).collect()) == plain_search(docs, items, 50)


@pytest.mark.parametrize("block,step,group", [(1, 1, 2), (7, 3, 1 << 19), (1 << 18, 16, 20)])
def test_search_in_small_blocks_and_groups(spark, monkeypatch, block, step, group):
    rng = random.Random(block)
    words = ["Alpha", "beta", "GAMMA", "été", "x1", "日本", "the", "of"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 12)))) for i in range(60)]
    docs += [(i, "alpha beta same") for i in range(100, 130)] + [(None, "alpha beta same"), (None, None), (7, "beta"), (200, "?!"), (201, "the " * 3000)]
    items = [(1, "Alpha, beta!"), (1, "alpha beta"), (None, "the of été"), (2, ""), (3, None), (4, "nowhere"), (5, "日本 x1 the the")]
    monkeypatch.setattr(lexical, "BLOCK", block)
    monkeypatch.setattr(lexical, "STEP", step)
    monkeypatch.setattr(lexical, "GROUP_TERMS", group)
    d = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3).withColumn("number", F.lit("clash"))
    q = spark.createDataFrame(items, "item_id bigint, text string").withColumn("item", F.lit("clash"))
    assert as_sorted(lexical.search(d, q, k=5).collect()) == plain_search(docs, items, 5)


def test_search_visits_few_documents(monkeypatch):
    rng = np.random.default_rng(2)
    n = 4000
    term, doc = np.repeat(np.arange(3), n), np.tile(np.arange(n), 3)
    tables = lexical.Tables(term, doc, (rng.pareto(1.2, 3 * n) * 1000).astype(np.int64) + 1, n)
    seen, plain = [0], lexical.Tables.scores
    monkeypatch.setattr(lexical.Tables, "scores", lambda self, t, d: (seen.__setitem__(0, seen[0] + len(d)), plain(self, t, d))[1])
    got = lexical.best_first(tables, np.arange(3), 10, [], np.arange(n))
    every = plain(tables, np.arange(3), np.arange(n))
    assert sorted(got, reverse=True) == sorted(((int(s), -i) for i, s in enumerate(every)), reverse=True)[:10]
    assert seen[0] < n / 4


def test_range_maxima_equal_a_scan():
    rng = np.random.default_rng(4)
    pairs = np.unique(rng.integers(0, [5, 50], (120, 2)), axis=0)
    impact = rng.integers(1, 9, len(pairs))
    tables = lexical.Tables(pairs[:, 0], pairs[:, 1], impact, 50)
    low = rng.integers(0, 50, 40)
    high = np.minimum(low + rng.integers(0, 20, 40), 49)
    value, _ = tables.maxima(np.arange(5), low, high)
    for r in range(40):
        for t in range(5):
            inside = (pairs[:, 0] == t) & (pairs[:, 1] >= low[r]) & (pairs[:, 1] <= high[r])
            assert value[r, t] == impact[inside].max(initial=0)


def test_search_of_nothing(spark):
    empty, one = spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame([(1, "a")], "doc_id bigint, text string")
    items = one.withColumnRenamed("doc_id", "item_id")
    assert lexical.search(empty, items).count() == 0
    assert lexical.search(one, items.where("item_id > 1")).count() == 0
    assert as_sorted(lexical.search(one, items).collect()) == plain_search([(1, "a")], [(1, "a")], 50)


# Manifest

def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_tree(leaves):
    """Root, and for each leaf what stands left and right of its path."""
    beside, level, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for i, k in enumerate(at):
            run = level[k // 16 * 16:k // 16 * 16 + 16]
            beside[i].append(("".join(run[:k % 16]), "".join(run[k % 16 + 1:])))
        level = [h(*level[i:i + 16]) for i in range(0, len(level), 16)]
        at = [k // 16 for k in at]
    return level[0], beside


def plain_manifest(rows, changed):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    parts = []
    for s in order:
        rows = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        parts.append((rows, [leaf_of(r) for r in rows]))
    trees = [plain_tree(leaves) for _, leaves in parts]
    root, above = plain_tree([t[0] for t in trees])
    out = Counter()
    for (rows, leaves), (subroot, beside), up in zip(parts, trees, above):
        for r, leaf, path in zip(rows, leaves, beside):
            path = path + up
            node = leaf
            if changed(r[0]) and r[4] is not None:
                node = leaf_of((*r[:4], "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[4])))
            for x, y in path:
                node = h(x, node, y)
            out[r[0], leaf, subroot, root, h(*(x for pair in path for x in pair)), node, node == root] += 1
    return out


def told(df):
    return Counter(tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect())


def fifth(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0


def lowered(docs, levels=3):
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    text = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return manifest.build(docs, ["doc_id", "source", "lang", "n_chars", "text"], changed=changed, current={"text": text}, levels=levels)


def test_manifest_query(spark):
    rows = [tuple(r[c] for c in ("doc_id", "source", "lang", "n_chars", "text"))
            for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    found = told(QUERIES["op13_merkle_manifest"](spark, FOLDER))
    assert found == plain_manifest(rows, fifth)
    assert {r[-1] for r in found} == {True, False}


def test_manifest_of_odd_rows(spark):
    rows = [(i * 37 - 900, "a", "en", i, f"Text {i}") for i in range(300)]
    rows += [(1 << 40, "b", None, None, None), (-(1 << 62), "b", "de", 0, ""), (63, "b", "x", 1, "Ab"), (64, "b", "x", 1, "Ab"), (127, "b", "x", 1, "É")]
    rows += [(None, "c", "x", 1, "No id"), (None, "c", "x", 1, "No id"), (None, "c", "x", 2, "other"), (5, "c", "x", 1, "T"), (5, "c", "x", 1, "T"),
             (5, "c", "x", 1, "U"), (6, "c", "x", 1, "T")]
    rows += [(7, None, "x", 1, "null source"), (8, "", "x", 1, "empty source"), (9, "é", "x", 1, "Z"), (9, "z", "x", 1, "Z")]
    rows += [(10, "d", "x", 1, f"tie {i}") for i in range(40)] + [(10, "d", "x", 1, "tie 3")] * 30
    df = spark.createDataFrame([(a, e, c, b, d) for a, b, c, d, e in rows], SCHEMA).repartition(6)
    clash = df.withColumn("leaf", F.lit(1)).withColumn("slot", F.lit(2)).withColumn("grp", F.lit(3)).withColumn("word", F.lit(4))
    assert told(lowered(clash, levels=1)) == plain_manifest(rows, fifth)  # many rounds


@pytest.mark.parametrize("n", [0, 1, 16, 17, 256, 257])
def test_manifest_of_few_rows(spark, n):
    rows = [(i, "s", "en", 1, "A") for i in range(n)]
    df = spark.createDataFrame([(a, e, c, b, d) for a, b, c, d, e in rows], SCHEMA)
    assert told(lowered(df)) == (plain_manifest(rows, fifth) if n else Counter())


def test_manifest_without_changes_verifies(spark):
    df = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert manifest.build(df, ["doc_id", "text"]).where("NOT verified").count() == 0
