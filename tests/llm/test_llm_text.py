import numpy as np
from brute import words as plain_words

from lacuna.llm import keyfilter, text
from lacuna.llm.components import components
from lacuna.session import Scratch

TEXTS = ["", "a", " A  b\x0bc ", "Été été É", "one two three one two three", "x" * 5000 + " y", "\n\n"]


def test_words_and_windows():
    w = text.split_words([t.encode() for t in TEXTS])
    assert np.diff(w.first).tolist() == [len(plain_words(t)) for t in TEXTS]
    cut = [[bytes(w.buffer[w.starts[i]:w.ends[i]]).decode() for i in range(w.first[d], w.first[d + 1])] for d in range(len(TEXTS))]
    assert cut == [plain_words(t) for t in TEXTS]
    by = {}
    for i in range(len(w.hashes)):
        by.setdefault(bytes(w.buffer[w.starts[i]:w.ends[i]]), set()).add(int(w.hashes[i]))
    assert all(len(v) == 1 for v in by.values()) and len(set.union(*by.values())) == len(by)
    codes, at = text.windows(w, 3)
    assert len(codes) == sum(max(0, len(plain_words(t)) - 2) for t in TEXTS)
    two = [int(c) for c, a in zip(codes, at) if w.owner[a] == 4]
    assert two[0] == two[3] and len(set(two)) == 3


def test_long_texts_are_cut_between_words(monkeypatch):
    many = " ".join(f"w{i}" for i in range(3000))
    whole = text.split_words([many.encode()]).hashes
    monkeypatch.setattr(text, "_SEGMENT", 100)
    assert (text.split_words([many.encode()]).hashes == whole).all()


def test_bitmap(spark):
    df = spark.range(1000).selectExpr("xxhash64(id) AS h")
    held = keyfilter.bitmap(df, "h", 1000)
    keys = np.array([r[0] for r in df.collect()], np.int64).view(np.uint64)
    assert keyfilter.passes(held, keys).all()
    other = text.mix(np.arange(10**6, 10**6 + 1000, dtype=np.uint64))
    assert keyfilter.passes(held, other).mean() < 0.2
    assert not keyfilter.passes(keyfilter.bitmap(df.limit(0), "h", 0), other).any()


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 99), (7, 7), (None, 3), (5, 4)] + [(200, 200 + i) for i in range(1, 60)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "t")).collect()))
    assert got == {**{i: 0 for i in range(41)}, 99: 99, 100: 99, 101: 99, **{200 + i: 200 for i in range(60)}}
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0
