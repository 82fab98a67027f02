import random

import numpy as np
import pytest
from brute import classes, common_passage, fingerprint, overlap_items
from itertools import combinations

from lacuna.llm import simhash, spaced, windows

ROWS = "doc_id long, text string, fp string, id string"


def prose(rng, n, vocabulary=4000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def frame(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "x", "y") for i, t in zip(ids, texts)], ROWS)


@pytest.fixture(scope="module")
def near():
    """Texts with exact and near copies, empty ones, and short ones."""
    rng = random.Random(1)
    texts = [" ".join(prose(rng, rng.randrange(1, 200))) for _ in range(60)] + ["", None, " \n ", "A b", "a  B"]
    for k in range(40):
        w = texts[k % 8].split()
        for _ in range(k % 3):
            w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w).upper() if k % 5 == 0 else " ".join(w))
    return texts


def test_simhash_equals_brute_force(spark, near):
    prints = [fingerprint(t) for t in near]
    want = classes(len(near), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 4)
    for bucket in (2048, 3):  # the second makes every larger bucket go through further blocks
        got = {r["id"]: r for r in simhash.near_duplicates(frame(spark, near), bucket=bucket).collect()}
        assert [got[i]["fp"] & (1 << 64) - 1 for i in range(len(near))] == prints
        assert [got[i]["component_id"] for i in range(len(near))] == want


def test_simhash_buckets_find_all_links_at_any_size():
    rng = random.Random(2)
    for n in (1, 10**4, 10**9, 10**14):
        masks = simhash.block_masks(list(range(64)), simhash.choose_blocks(n, 4), 4)
        for _ in range(200):
            a = rng.getrandbits(64)
            b = a
            for bit in rng.sample(range(64), 4):
                b ^= 1 << bit
            assert any(a & m == b & m for m in masks)
    values = [rng.getrandbits(64) - (1 << 63) for _ in range(5)]
    values += [values[0] ^ 1, values[0] ^ 3, values[0] ^ 63, values[1] ^ (15 << 20)]
    links = simhash.bucket_links(values, 4)
    root = classes(len(values), lambda i, j: ((values[i] ^ values[j]) & (1 << 64) - 1).bit_count() <= 4)
    index = {v: i for i, v in enumerate(values)}
    edges = {(index[a], index[b]) for a, b in links}
    assert classes(len(values), lambda i, j: (i, j) in edges or (j, i) in edges) == root
    assert len(links) == len(values) - len(set(root))


def test_simhash_edge_cases(spark):
    rows = [(5, "a b c d e"), (5, "a b c d e"), (None, "A B C D E"), (7, "other words stand here now"), (None, "")]
    df = spark.createDataFrame([(i, t, 0.5) for i, t in rows], "doc_id long, text string, fp double")
    got = sorted(str((r["id"], r["component_id"])) for r in simhash.near_duplicates(df).collect())
    assert got == sorted(map(str, [(5, 5), (5, 5), (None, 5), (7, 7), (None, None)]))
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_masks_fit_beside_any_two_replacements():
    for gone in [c for k in range(3) for c in combinations(range(spaced.WINDOW), k)]:
        assert any(all(m[j] == "0" or at + j not in gone for j in range(len(m)))
                   for m in spaced.MASKS for at in range(spaced.WINDOW - len(m) + 1))
    assert spaced.EQUAL == spaced.WINDOW - 2 and spaced.EQUAL >= 0.8 * spaced.WINDOW


def test_overlaps_equal_brute_force(spark):
    rng = random.Random(3)
    items = [(k, " ".join(prose(rng, n, 300))) for k, n in enumerate([13, 14, 30, 60, 8, 12, 7, 3, 25, 25])]
    items += [(20, None), (21, ""), (None, " ".join(prose(rng, 20, 300))), (9, items[2][1])]
    texts = ["", None, "short"]
    for k in range(120):
        body = prose(rng, rng.randrange(0, 120), 300)
        piece = (items[k % 10][1] or "").split()
        cut = piece[rng.randrange(0, 3):len(piece) - rng.randrange(0, 3)] if k % 2 else piece
        for _ in range(k % 5):
            if cut:
                cut[rng.randrange(len(cut))] = "replaced"
        at = rng.randrange(len(body) + 1)
        texts.append(" ".join(body[:at] + [w.upper() + "," for w in cut] + body[at:]))
    docs = frame(spark, texts)
    table = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, words int")
    got = {(r["doc_id"], r["item_id"]) for r in spaced.overlaps(docs, table).collect()}
    assert got == {(i, k) for i, t in enumerate(texts) for k in overlap_items(t, items)} and len(got) > 50
    kept = spaced.decontaminate(docs, table)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == set(range(len(texts))) - {d for d, _ in got}
    assert spaced.overlaps(docs.limit(0), table).count() == 0 == spaced.overlaps(docs, table.limit(0)).count()


def test_compact_windows_equal_definition():
    rng = np.random.default_rng(4)
    for width in (1, 2, 5, 9):
        for top in (3, 10**6):
            owner = np.sort(rng.integers(0, 4, 60))
            values = rng.integers(1, top, 60).astype(np.uint64)
            got = set(zip(*(x.tolist() for x in windows.compact_windows(values, owner, width))))
            want = set()
            for c in range(60):
                a = b = c
                while a and owner[a - 1] == owner[c] and values[a - 1] > values[c]:
                    a -= 1
                while b + 1 < 60 and owner[b + 1] == owner[c] and values[b + 1] >= values[c]:
                    b += 1
                if b - a + 1 >= width:
                    want.add((a, c, b))
            assert got == want


def test_passages_equal_brute_force(spark):
    rng = random.Random(5)
    common = [prose(rng, n) for n in (40, 50, 51, 80, 200)]  # 40 of 50 words are less than 0.8 of the shingles
    texts = ["", None, "a b", " ".join(common[2])] + [" ".join(prose(rng, rng.randrange(1, 150))) for _ in range(30)]
    for k in range(60):
        body = prose(rng, rng.randrange(0, 120))
        at = rng.randrange(len(body) + 1)
        texts.append(" ".join(body[:at] + common[k % 5] + body[at:]))
    texts += [texts[10]] * 3 + ["Go " * 300, "go " * 200, " ".join(prose(rng, 60))] + [" ".join(prose(rng, 60))] * 2
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, uid int, words string")
    got = {r["id"]: r for r in windows.passages(df).collect()}
    assert len(got) == len(texts)
    want = classes(len(texts), lambda i, j: common_passage(texts[i], texts[j]))
    assert [got[i]["class_id"] for i in range(len(texts))] == want
    for i, t in enumerate(texts):
        flagged = any(j != i and common_passage(t, o) for j, o in enumerate(texts))
        assert (got[i]["n_dup_words"] > 0) == flagged, i
    # the passage, and nothing beyond what happens to go on alike, is in the span
    for i in range(34, 94):
        k = (i - 34) % 5
        if k:
            w, p = texts[i].split(), common[k]
            at = next(x for x in range(len(w)) if w[x:x + len(p)] == p)
            assert any(int(a) <= at and int(b) >= at + len(p) for a, b in (s.split(":") for s in got[i]["spans"].split(",")))
            assert got[i]["n_dup_words"] <= len(p) + 14
    assert windows.passages(df.limit(0)).count() == 0


def test_passages_with_one_replaced_word(spark):
    rng = random.Random(6)
    texts = []
    for _ in range(60):
        p = prose(rng, 102, 10**6)
        texts.append(" ".join(p))
        p[51 if len(texts) % 4 == 1 else 20] = "new"
        texts.append(" ".join(prose(rng, 30) + p))
    got = {r["id"]: r["class_id"] for r in windows.passages(frame(spark, texts)).collect()}
    assert all(got[i] == got[i + 1] == i for i in range(0, 120, 2))


def test_passages_edge_cases(spark):
    p = " ".join(f"p{i}" for i in range(60))
    rows = [(None, p), (4, p), (4, p), (9, "x " + p), (8, " ".join(f"q{i}" for i in range(60))), (8, " ".join(f"q{i}" for i in range(60)))]
    got = sorted((str(r["id"]), r["class_id"], r["n_dup_words"]) for r in windows.passages(
        spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [("4", 4, 60), ("4", 4, 60), ("8", 8, 0), ("8", 8, 0), ("9", 4, 60), ("None", 4, 60)]


def test_passages_around_one_common_line(spark, monkeypatch):
    """A line in all texts gives them common signatures; the pairs compared still grow with the texts alone."""
    rng = random.Random(8)
    line, texts = prose(rng, 20), []
    for k in range(240):
        if k % 24 == 1:  # the text before, with a word changed
            body = texts[-1].split()
            body[5] = "changed"
        else:
            body = [f"{w}{k}" for w in prose(rng, 40)] + line + [f"{w}{k}" for w in prose(rng, 40)]
        texts.append(" ".join(body))
    compared, verify = [], windows._verify
    monkeypatch.setattr(windows, "_verify", lambda pairs: compared.append(pairs.count()) or verify(pairs))
    got = {r["id"]: r["class_id"] for r in windows.passages(frame(spark, texts)).collect()}
    assert got == {i: i - 1 if i % 24 == 1 else i for i in range(240)}
    assert sum(compared) < 20 * len(texts) < 240 * 239 // 2


def similar_starts(a, b, passage=50, shingle=5):
    """The starts in a and in b of passages that are similar as sets to one of the other text."""
    bags = [[{tuple(t[p:p + shingle]) for p in range(i, i + passage - shingle + 1)} for i in range(len(t) - passage + 1)] for t in (a, b)]
    hit = [(i, j) for i, x in enumerate(bags[0]) for j, y in enumerate(bags[1]) if len(x & y) >= 0.8 * len(x | y)]
    return {i for i, _ in hit}, {j for _, j in hit}


def edited(rng, k):
    """Two texts of differing surroundings around a 50-word passage, with one word inserted (even k) or deleted in the second."""
    p = prose(rng, 50, 10**6)
    q = p[:25] + ["new"] + p[25:] if k % 2 == 0 else p[:25] + p[26:]
    return [prose(rng, 20, 10**6) + x + prose(rng, 20, 10**6) for x in (p, q)]


def test_passages_of_two_cells_are_compared_from_all_starts():
    rng = random.Random(9)
    for k in range(40):
        a, b = edited(rng, k) if k < 30 else [[rng.choice("xyz") for _ in range(90)] for _ in range(2)]
        if k > 35:
            b = a[:30] + a[31:]
        codes = {w: i for i, w in enumerate(dict.fromkeys(a + b))}
        x, y = (np.array([codes[w] for w in t], np.uint32) for t in (a, b))
        spans, left = windows.matched(x, y, 0, 0, 1000, [(0, len(a) - 50, 0, len(b) - 50)])  # the alignment meets nowhere
        want = similar_starts(a, b)
        for side, starts in enumerate(want):
            covered = {p for s in spans for p in range(*s[2 * side:2 * side + 2])}
            assert covered == {p for i in starts for p in range(i, i + 50)}
            open_ = sorted(set(range(len((a, b)[side]) - 49)) - starts)
            assert left[0][2 * side:2 * side + 2] == ((open_[0], open_[-1]) if open_ else (len((a, b)[side]) - 49, -1))
        assert k >= 30 or want[0]


def test_a_match_elsewhere_does_not_settle_a_cell(spark):
    """X is L's edited copy; Y repeats X around a line that all three have. Y must find X whatever X shares with L."""
    rng = random.Random(10)
    texts = []
    for _ in range(40):
        same, line, left, right = (prose(rng, n, 10**6) for n in (60, 40, 7, 7))
        texts.append(" ".join(same + prose(rng, 7, 10**6) + line + prose(rng, 7, 10**6)))
        texts.append(" ".join(same + left + line + right))
        texts.append(" ".join(prose(rng, 30, 10**6) + left + line + right + prose(rng, 30, 10**6)))
    got = {r["id"]: r for r in windows.passages(frame(spark, texts)).collect()}
    for i in range(0, 120, 3):
        assert [got[i + k]["class_id"] for k in range(3)] == [i] * 3
        a, b = got[i + 2]["spans"].split(",")[0].split(":")
        assert int(a) <= 30 and int(b) >= 84


def test_recall_of_edited_passages(spark):
    """50-word passages at the threshold of 0.8 (0.804), against brute force."""
    rng = random.Random(11)
    texts = [" ".join(t) for k in range(300) for t in edited(rng, k)]
    got = {r["id"]: r["class_id"] for r in windows.passages(frame(spark, texts)).collect()}
    assert all(similar_starts(texts[i].split(), texts[i + 1].split())[0] for i in range(0, 600, 2))
    assert sum(got[i + 1] == i for i in range(0, 600, 2)) >= 0.97 * 300
    assert all(got[i] in (i, i - i % 2) for i in range(600))


def test_passages_of_a_family_of_edited_copies(spark, monkeypatch):
    """Copies with a word in about thirty replaced: which passages stay similar equals brute force, few pairs are compared one by one."""
    rng = random.Random(12)
    texts = []
    for _ in range(4):
        body = prose(rng, 90, 10**6)
        texts += [[f"new{rng.random()}" if rng.random() < 1 / 30 else w for w in body] for _ in range(12)]
    compared, verify = [], windows._verify
    monkeypatch.setattr(windows, "_verify", lambda pairs: compared.append(pairs.count()) or verify(pairs))
    got = {r["id"]: r for r in windows.passages(frame(spark, [" ".join(t) for t in texts])).collect()}
    starts = [[similar_starts(x, y) if i != j and i // 12 == j // 12 else (set(), set()) for j, y in enumerate(texts)]
              for i, x in enumerate(texts)]
    assert [got[i]["class_id"] for i in range(48)] == classes(48, lambda i, j: bool(starts[i][j][0]))
    for i in range(48):
        spans = [tuple(map(int, s.split(":"))) for s in got[i]["spans"].split(",") if s]
        held = {p for x, y in spans for p in range(x, y)}
        want = {p for a, _ in starts[i] for s in a for p in range(s, s + 50)}
        assert len(want - held) <= 0.02 * len(want) and held <= want
    assert sum(compared) < 4 * len(texts)


def test_only_text_that_others_may_hold_gets_signatures(spark, monkeypatch):
    """Without enough shingles in other texts a passage has no cells, so work follows the shared text."""
    rng = random.Random(13)
    line, texts = prose(rng, 10), []
    for k in range(240):
        body = [f"{w}{k}" for w in prose(rng, 60)] + line + [f"{w}{k}" for w in prose(rng, 60)]
        texts.append(texts[-1].replace(" ", " changed ", 1) if k % 24 == 1 else " ".join(body))
    tables, write = {}, windows.Scratch.write
    monkeypatch.setattr(windows.Scratch, "write", lambda self, df, name: tables.setdefault(name, write(self, df, name)))
    got = {r["id"]: r["class_id"] for r in windows.passages(frame(spark, texts)).collect()}
    assert got == {i: i - 1 if i % 24 == 1 else i for i in range(240)}
    assert tables["segments"].select("uid").distinct().count() < len(texts) // 2


def test_texts_of_one_class_meet_only_for_starts_in_no_span():
    rng = np.random.default_rng(14)
    a = rng.integers(1, 1 << 32, 60, np.uint32)
    b = a.copy()
    b[0] = 7
    sides = dict(uid=[1, 2], low=[0, 0], high=[10, 10], first=[0, 0], last=[10, 10], anchor=[20, 20], at=[0, 0],
                 words=[a.tobytes(), b.tobytes()])
    meet = lambda label, bare: windows._meet(**sides, label=label, bare_first=[bare, bare], bare_last=[10, 10])
    assert meet([1, 1], 11) == []
    assert {(i, j) for i, j, _ in meet([1, 1], 4)} == {(0, 1)} == {(i, j) for i, j, _ in meet([1, 2], 11)}
    assert meet([1, 2], 11)[0][2] == [(0, 60, 0, 60)]


def test_large_keys_by_rounds_give_the_same_classes(spark, monkeypatch):
    rng = random.Random(15)
    texts = []
    for _ in range(3):
        body = prose(rng, 80, 10**6)
        texts += [" ".join(f"new{rng.random()}" if rng.random() < 1 / 30 else w for w in body) for _ in range(8)]
    got = []
    for local in (windows.LOCAL, 0):
        monkeypatch.setattr(windows, "LOCAL", local)
        got.append({r["id"]: (r["class_id"], r["n_dup_words"]) for r in windows.passages(frame(spark, texts)).collect()})
    assert got[0] == got[1] and any(c < i for i, (c, _) in got[0].items())


def test_a_short_mask_survives_any_replacement():
    for n in range(1, spaced.WINDOW):
        for gone in combinations(range(n), n - spaced.needed(n)):
            assert any(all(m[g] == "0" for g in gone) for m in spaced.short_masks(n))
        assert all("1" in m for m in spaced.short_masks(n))


def test_items_of_any_length_are_found(spark):
    rng = random.Random(9)
    pool = [f"w{i}" for i in range(500)]
    items = [(n, " ".join(rng.sample(pool, n))) for n in range(0, 16)] + [(50, None), (51, "w1 w1"), (52, "Paris")]
    docs = [(0, None), (1, ""), (2, "Paris"), (3, "in paris now"), (4, "w1 w1"), (5, "w1 w1 w1")]
    for n, text in items[1:16]:
        words = text.split()
        for replaced in range(0, 4):
            new = list(words)
            for k in rng.sample(range(n), min(replaced, n)):
                new[k] = "other"
            docs.append((len(docs), " ".join(new)))
            docs.append((len(docs), " ".join(["before", *new, "after", "that"])))
    table = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in spaced.overlaps(spark.createDataFrame(docs, "doc_id bigint, text string"), table).collect()}
    assert got == {(i, item) for i, text in docs for item in overlap_items(text, [(a, b or "") for a, b in items])}
    assert {(2, 52), (4, 51)} <= got and (3, 52) not in got
