import random
import re
import textwrap

import numpy as np
import pytest
from brute import private
from pyspark.sql import functions as F

from lacuna.llm import cascade, crf, licenses, lines, merkle


def test_base_spans_equal_plain_patterns():
    rng = random.Random(1)
    alphabet = ["a.b", "@", "@x", "x.y", "1", "23", ".", "+", " ", "-", "(", ")", "4111 1111 1111 1111", "10.0.0.255", "é", "+1 (803) 555-5351",
                "a@b.c", "%", "..", "999.1.1.1", "\n", "5500-0000-0000-0004", "0000000000000"]
    for _ in range(3000):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 25)))
        raw = t.encode()
        points = np.r_[0, np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)]
        assert [(points[a], k, points[b]) for a, k, b in crf.base_spans(raw)] == private(t), t


def test_viterbi_equals_all_paths():
    rng = np.random.default_rng(2)
    model = crf.Model(np.zeros(0, np.uint64), np.zeros((3, 2, 5)), np.zeros((3, 61, 5)), rng.normal(size=(5, 5)) * 2)
    from itertools import product
    for n in (1, 2, 5):
        scores = rng.normal(size=(n, 5)) * 3
        got = model.decode(scores, np.zeros(n, np.int64))
        value = lambda p: sum(scores[i, y] for i, y in enumerate(p)) + sum(model.pairs[a, b] for a, b in zip((0, *p), (*p, 0)))
        assert value(tuple(got)) == pytest.approx(max(map(value, product(range(5), repeat=n))))
    many, text = rng.normal(size=(400, 5)) * 4 + np.array([6, 0, 0, 0, 0]), np.sort(rng.integers(0, 30, 400))
    together = model.decode(many, text)
    for d in range(30):
        assert (together[text == d] == model.decode(many[text == d], text[text == d])).all()


def test_held_out_accuracy():
    model = crf.train(crf.made_rows(600, seed=5))
    found = right = total = 0
    for text, spans in crf.made_rows(400, seed=99):
        (base, added), = crf.find([text.encode()], model)
        got = {(s, k, e) for s, k, e in base + added}
        found, total, right = found + len(got), total + len(spans), right + len(got & set(spans))
    assert right / total > 0.9 and right / found > 0.95
    only = [crf.find([t.encode()], model)[0] for t in ["Call (803) 555-5351, now.", "write a.b@c", "in 2024 or 12:30 we paid $300"]]
    assert [len(a) for _, a in only] == [1, 0, 0]


def test_spans_edge_cases(spark):
    model = crf.train(crf.made_rows(200))
    long = "word " * 60000 + "mail a@b.co end"
    df = spark.createDataFrame([(1, None, 0), (1, "", 0), (None, "é a@b.co", 0), (2, long, 0)], "doc_id long, text string, base int")
    got = crf.spans(df, model).collect()
    assert sorted([[(s["kind"], s["start"], s["end"]) for s in r["base"]] for r in got]) == [
        [], [], [("email", 2, 8)], [("email", 300005, 300011)]]
    assert crf.spans(df.limit(0), model).count() == 0 and crf.train([]).pairs.sum() == 0
    assert isinstance(crf.fit(df.limit(0)), crf.Model)


def test_cascade_order_and_verdicts(spark):
    assert cascade.order_rules({0: 50, 1: 40, 2: 10, 3: 5}, [1.0, 0.1]) == [1, 0]
    assert cascade.order_rules({}, [1.0, 1.0, 1.0]) == [0, 1, 2]
    texts = [b"", b"good plain words stand here in this long enough text for all of the rules to be happy with them now",
             b"## a%% b$$ " * 20, b"SHOUT OUT LOUD " * 9, "café société".encode(), b"12 34 56 " * 12]
    verdicts = {tuple(cascade.first_rejections(texts, cascade.RULES, list(order))[0] < 0) for order in (range(8), range(7, -1, -1))}
    assert verdicts == {(False, True, False, False, False, False)}
    assert cascade.first_rejections(texts, cascade.RULES, list(range(8)))[1] < 6 * 8
    good = texts[1].decode()
    df = spark.createDataFrame([(1, None, "k"), (1, good, "k"), (None, good, None), (2, good, "k"), (2, good, "k")], "doc_id long, text string, kept string")
    assert sorted(r["kept"] for r in cascade.judge(df).collect()) == [False, True, True, True, True]
    out = cascade.keep_good(df)
    assert out.columns == df.columns and out.count() == 4
    assert cascade.judge(df.limit(0)).count() == 0 == cascade.keep_good(df.limit(0)).count()


def test_cascade_counts_once_and_in_any_script(spark):
    texts = [b"a b " * 30, b"one word after the other " * 3, "é a".encode() * 40, b""]
    seen = cascade.Measured(texts)
    assert seen("n_repeat_words", np.array([0, 2])).tolist() == [60, 39]
    calls, plain = [], cascade.MEASURES["n_words"]
    cascade.MEASURES["n_words"] = lambda t: calls.extend(t) or plain(t)
    try:
        assert seen("n_words", np.arange(4)).tolist() == [60, 15, 41, 0] and calls == [texts[1], texts[3]]
    finally:
        cascade.MEASURES["n_words"] = plain
    work = []
    rule = lambda name, bad: cascade.Rule(name, lambda m, r: work.append((name, r.tolist())) or np.isin(r, bad))
    verdict, n = cascade.first_rejections(texts, [rule("x", [1]), rule("y", [0, 1])], [1, 0], np.array([0, 2, 3]))
    assert verdict.tolist() == [1, -1, -1] and work == [("y", [0, 2, 3]), ("x", [2, 3])] and n == 5
    russian = "Компания IBM представила новый сервер для больших вычислений и хранения данных в научных центрах страны на этой неделе в городе Москва " \
              "где собрались учёные"
    chinese = " ".join("这是一个关于机器学习与自然语言处理的句子没有空格" + chr(0x4E00 + i) for i in range(25))
    loud = "SHOUT OUT LOUD NOW ALL OF YOU PEOPLE WHO ARE HERE IN THIS BIG ROOM TONIGHT AND WAIT FOR THE BAND TO COME"
    long = " ".join(f"averyveryverylongwordindeed{i}" for i in range(25))
    got = {r["id"]: r["rule"] for r in cascade.judge(spark.createDataFrame(
        list(enumerate([russian, chinese, loud, long])), "doc_id long, text string")).collect()}
    assert got == {0: None, 1: None, 2: "shouting", 3: "odd_lengths"}


def test_rules_keep_good_documents(spark):
    folder = "/root/testdata/sf0.01"
    got = cascade.judge(spark.read.parquet(f"{folder}/documents.parquet")).join(
        spark.read.parquet(f"{folder}/labels.parquet").withColumnRenamed("doc_id", "id"), "id").where("NOT base_failed").toPandas()
    assert got[got.quality == 1].kept.all() and not got[got.quality == 0].kept.any()


def test_lines_edge_cases(spark):
    shared = "  Shared Line here\t"
    rows = [(3, f"a\n{shared}\nb"), (1, "shared line HERE"), (2, shared + "\n" + shared), (None, "shared line here\nx"),
            (5, None), (6, ""), (7, "short\nshort"), (8, "short"), (9, "only mine twice\nonly mine twice"), (3, "SHARED line here"),
            (3, f"a\n{shared}\nb")]
    df = spark.createDataFrame([(i, t, -1, "z") for i, t in rows], "doc_id long, text string, n_lines int, pos string")
    out = lines.drop_shared_lines(df)
    assert sorted(out.columns) == sorted(["doc_id", "text", "pos", "n_lines", "n_dropped"])
    got = sorted((str(r["doc_id"]), r["text"], r["n_lines"], r["n_dropped"]) for r in out.collect())
    assert got == sorted([("3", "a\nb", 3, 1), ("1", "shared line HERE", 1, 0), ("2", "", 2, 2), ("None", "x", 2, 1), ("5", "", 1, 0),
                          ("6", "", 1, 0), ("7", "short\nshort", 2, 0), ("8", "short", 1, 0),
                          ("9", "only mine twice\nonly mine twice", 2, 0), ("3", "", 1, 1), ("3", "a\nb", 3, 1)])
    assert lines.drop_shared_lines(df.limit(0)).count() == 0
    three = lines.drop_shared_lines(df.where("doc_id < 3"), min_docs=3)
    assert {r["n_dropped"] for r in three.collect()} == {0}
    assert sum(r["n_dropped"] for r in lines.drop_shared_lines(df, min_docs=3).collect()) == 6


def test_licences(spark):
    known = licenses.catalogue(spark)
    mit = licenses.KNOWN[0][1]
    again = mit.replace("<year> <holder>", "2020 Some One").replace("copyright holders", "copyright owners").upper().replace(", ", " ,\n\t")
    rows = [(1, mit), (2, again), (3, mit + " more"), (4, None), (4, ""), (None, "x\n ** RELEASED under the MIT Licence **\ny"),
            (5, "Released under the MIT License."), (5, "Released under the MIT License."), (6, "SPDX-License-Identifier: Apache-2.0\nReleased under the MIT License.")]
    df = spark.createDataFrame([(i, t, "own") for i, t in rows], "doc_id long, text string, license string")
    got = sorted((str(r["id"]), str(r["license"]), ",".join(r["line_licenses"]), r["n_license_lines"]) for r in licenses.scan(df, known).collect())
    assert got == sorted([("1", "MIT", "", 0), ("2", "MIT", "", 0), ("3", "None", "", 0), ("4", "None", "", 0), ("4", "None", "", 0),
                          ("None", "None", "MIT", 1), ("5", "MIT", "MIT", 1), ("5", "MIT", "MIT", 1), ("6", "None", "Apache-2.0,MIT", 2)])
    whole = licenses.scan_texts(df, known)
    assert whole.columns == ["doc_id", "text", "text_digest", "license"] and whole.count() == len(rows)
    assert licenses.scan(df.limit(0), known).count() == 0 and licenses.scan(df, known.limit(0)).where("license IS NOT NULL").count() == 0


def test_licences_of_the_catalogue(spark):
    """A copy of each complete text with changed case, punctuation and copyright line, and usual notices."""
    names = ["Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0-only", "GPL-3.0-only", "LGPL-2.1-only", "LGPL-3.0-only",
             "MPL-2.0", "Unlicense", "CC0-1.0", "GFDL-1.3-only"]
    rows = []
    for name in names:
        body = max((t for k, t in licenses.KNOWN if k == name), key=len)
        rows.append((name, "Copyright 2021 Some One\n" + body.upper().replace("<YEAR>, <HOLDER>", "2020 X").replace(", ", " ;  ")))
    rows += [("CC-BY-SA-4.0", "licensed under CC-BY-SA 4.0"), ("GPL-3.0-or-later", "// SPDX-License-Identifier: GPL-3.0-or-later"),
             ("CC-BY-SA-3.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.")]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r["id"]: r["license"] for r in licenses.scan(df, licenses.catalogue(spark)).collect()}
    assert [got[i] for i in range(len(rows))] == [k for k, _ in rows]


def test_licences_in_any_wrapping(spark):
    """Every paragraph wrapped anew at widths 50 to 100."""
    rows = []
    for name in ("MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Apache-2.0", "GPL-2.0-only", "GPL-3.0-only", "LGPL-2.1-only", "MPL-2.0",
                 "CC0-1.0", "GFDL-1.3-only"):
        body = max((t for k, t in licenses.KNOWN if k == name), key=len)
        for width in range(50, 101):
            rows.append((name, "\n\n".join(textwrap.fill(p, width) for p in re.split(r"\n[ \t]*\n", body))))
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r["doc_id"]: r["license"] for r in licenses.scan_texts(df, licenses.catalogue(spark)).collect()}
    assert not [(k, 50 + i % 51) for i, (k, _) in enumerate(rows) if got[i] != k]


def test_copyright_lines(spark):
    gone = ["Copyright (c) 2020 X", "copyright 1999 x. all rights reserved", "  \u00a9 2001 X", "(C) 2020 X", "Copyright [yyyy] [name]",
            "Copyright: \u00a9 X", "All rights reserved."]
    stay = ["copyright notice and this list", "(c) You must keep", "copyrighted by X", "the copyright 2020"]
    df = spark.createDataFrame([(t,) for t in gone + stay], "text string")
    got = [r[0] for r in df.select(licenses.canonical(F.concat(F.lit("a\n"), "text", F.lit("\nb")))).collect()]
    assert got[:len(gone)] == ["a b"] * len(gone) and all(len(g) > 10 for g in got[len(gone):])


def test_licence_scan_is_native(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    plan = licenses.scan(df, licenses.catalogue(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_fixity(spark):
    rng = random.Random(3)
    a, at = [], {}
    for f in ["f", "g", None]:
        pos = 0
        for _ in range(200):
            body = "r" * rng.randrange(0, 400)
            a.append((f, pos, body.encode(), 1))
            pos += max(1, len(body))
    a += [("f", 0, b"again", 1), ("f", 0, b"again", 1)]
    b = list(a)
    want = set()
    for k in (5, 250, 599, 300):
        f, pos, body, _ = b[k]
        b[k] = (f, pos, body + b"!", 1)
        want.add((f, pos, "changed"))
    f, pos, *_ = b.pop(77)
    want.add((f, pos, "missing"))
    b.append(("g", 10**5, b"late", 1))
    b.append(("new", 3, None, 1))
    want |= {("g", 10**5, "extra"), ("new", 3, "extra")}
    b.remove(("f", 0, b"again", 1))
    want.add(("f", 0, "changed"))
    shape = "file string, at long, payload binary, digest int"
    left, right = (spark.createDataFrame(x, shape) for x in (a, b))
    for span, fanout in ((1 << 16, 16), (64, 32)):
        got = [(r["file"], r["at"], r["kind"]) for r in merkle.audit(left, right, span=span, fanout=fanout).collect()]
        assert len(got) == len(want) and set(got) == want
    assert merkle.audit(left, left).count() == 0 == merkle.audit(left.limit(0), left.limit(0)).count()
    assert merkle.audit(left.limit(0), right).where("kind <> 'extra'").count() == 0


def test_records_without_a_place_are_told_apart(spark):
    shape = "file string, at long, payload binary"
    a = spark.createDataFrame([("f", 0, b"x"), ("f", None, b"a"), ("f", None, b"a"), ("g", -3, b"same"), (None, -1, None)], shape)
    b = spark.createDataFrame([("f", 0, b"y"), ("f", None, b"a"), ("g", -3, b"same")], shape)
    got = {(r["file"], r["at"], r["kind"], r["copies_a"], r["copies_b"], r["size_a"], r["size_b"]) for r in merkle.audit(a, b).collect()}
    assert got == {("f", 0, "changed", 1, 1, 1, 1), ("f", None, "unplaced", 2, 1, 1, 1), ("g", -3, "unplaced", 1, 1, 4, 4),
                   (None, -1, "unplaced", 1, None, 0, None)}
    assert merkle.audit(a.where("at IS NULL"), b.limit(0)).select("kind").first()["kind"] == "unplaced"


def test_a_line_separator_at_the_end_is_no_white_space(spark):
    for mark in "\x85\u2028\u2029":
        docs = [(1, f"other words here {mark}"), (2, f"other words here{mark}"), (3, f" other words here{mark}\t")]
        got = {r["doc_id"]: (r["text"], r["n_dropped"]) for r in lines.drop_shared_lines(
            spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
        assert got == {1: (docs[0][1], 0), 2: (docs[1][1], 0), 3: ("", 1)}


def test_columns_named_like_helpers_stay(spark):
    df = spark.createDataFrame([(1, "a long shared line\nx", "s", "g", "t", 5), (2, "a long shared line\ny", "s", "g", "t", 6)],
                               "doc_id bigint, text string, split_lines string, gone_lines string, text_row string, gone_id int")
    got = lines.drop_shared_lines(df).orderBy("doc_id").collect()
    assert [tuple(r)[1:6] for r in got] == [("a long shared line\nx", "s", "g", "t", 5), ("y", "s", "g", "t", 6)]
