import hashlib
import random
import sys

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lacuna.llm import bpe, chat
from lacuna.llm.queries import TOKENIZER

SOURCE = bpe.read_tokenizer(TOKENIZER)
ODD = ["", "a", "ΑΣ ΟΔΟΣ Σ", "<|endoftext|>a<|startoftext|>  <|endoftext|", "x" * 3000, "the" * 700, "é ẞ İ I'LL don't 'S'd", "á ́a q",
       "a\x1cb \x1f c\x85d e", "１２ 3½", "日本語テキスト", "😀😀 ‍", "\x00\x01"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(TOKENIZER)


@pytest.fixture(scope="module")
def own():
    return bpe.WordBPE(SOURCE)


def check(own, library, text):
    want = library.encode(text, add_special_tokens=False).ids
    got = np.frombuffer(own.encode(text), np.int32)
    assert got.tolist() == want
    assert own.decode(got) == library.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(own, library, text):
    check(own, library, text)


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(max_codepoint=0x2FFF, exclude_categories=("Cs", "Cn")), max_size=60))
def test_any_text(own, library, text):
    check(own, library, text)


def test_long_words_merge_alike(own):
    rng = random.Random(1)
    for _ in range(300):
        word = "".join(rng.choice("theandiogr") for _ in range(rng.randrange(1, 60)))
        raw = word.encode()
        ids = [*(own.inner[b] for b in raw[:-1]), own.final[raw[-1]]]
        assert own._merge_long(ids) == own.merge(word)


def test_forgetting_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    small = bpe.WordBPE(SOURCE)
    check(small, library, "one two three four one two five six seven one " * 5)


def test_documents(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame([(-1, None), (-1, ""), (None, "null id")], docs.schema)
    out = bpe.decode(bpe.encode(docs.union(more), SOURCE), SOURCE).collect()
    assert len(out) == docs.count() + 3
    for r in out:
        want = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == want and r["decoded"] == library.decode(want, skip_special_tokens=False)
    clash = docs.limit(3).selectExpr("doc_id", "text", "1 AS ids", "2 AS `a b`")
    assert bpe.encode(clash, SOURCE).columns == ["doc_id", "text", "a b", "ids"]
    assert bpe.encode(docs.limit(0), SOURCE).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "a\nb", "%0A<|"]),
                          st.text(st.sampled_from("<|im_endstar>\\ \nk%"), max_size=30)), max_size=6))
def test_format_round_trip(turns):
    examples = list(chat.expand(turns))
    if turns:
        assert examples[-1][0] == len(turns) and examples[-1][4] and chat.parse(examples[-1][1]) == turns
    assert [chat.unescape(t[a:b]) for _, t, a, b, _ in examples if b > a] == [t for r, t in turns if r == "assistant" and t]
    for n, text, a, b, _ in examples:
        assert chat.parse(text) == turns[:n]
    for _, t in turns:
        assert chat.unescape(chat.escape(t)) == t and chat.START not in chat.escape(t) and chat.END not in chat.escape(t)


def test_conversations(spark):
    rows = [(1, 1, "assistant", "B"), (1, 0, "user", "A"), (1, 2, "user", "C"), (2, 0, "user", None), (None, 0, "assistant", "x"), (1, None, "system", "S"),
            (3, 0, "assistant", "d"), (3, 0, "assistant", "d"), (4, 0, None, "é" * 9)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, example int")
    got = {r["conv_id"]: r for r in chat.read_back(chat.prefix_examples(df)).collect()}
    assert {k: [tuple(t) for t in r["turns"]] for k, r in got.items()} == {
        1: [("system", "S"), ("user", "A"), ("assistant", "B"), ("user", "C")], 2: [("user", "")], None: [("assistant", "x")],
        3: [("assistant", "d"), ("assistant", "d")], 4: [("", "é" * 9)]}
    assert {k: "".join(r["losses"]) for k, r in got.items()} == {1: "B", 2: "", None: "x", 3: "dd", 4: ""}
    assert chat.prefix_examples(df.limit(0)).count() == 0
    many = spark.createDataFrame([(1, i, ("user", "assistant")[i % 2], f"t{i}") for i in range(300)], "conv_id long, turn long, role string, text string")
    examples = chat.prefix_examples(many, batch_chars=1000)
    assert examples.count() == 150
    (r,) = chat.read_back(examples).collect()
    assert len(r["turns"]) == 300 and hashlib.sha256("".join(r["losses"]).encode()).hexdigest() == hashlib.sha256(
        "".join(f"t{i}" for i in range(1, 300, 2)).encode()).hexdigest()
    assert sys.maxsize > r["chars"] > 0
