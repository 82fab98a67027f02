"""The pipeline against a plain version, stage by stage, on sf0.001."""

from brute import classes, fingerprint, overlap_items

import corpus_pipeline as P

FOLDER = "/root/testdata/sf0.001"


def plain_lines(docs):
    holders = {}
    for d, t in docs.items():
        for line in t.split("\n"):
            key = line.strip(" \t\n\r\x0b\x0c").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
            if len(key) >= 10:
                holders.setdefault(key, set()).add(d)
    out = {}
    for d, t in docs.items():
        kept = []
        for line in t.split("\n"):
            key = line.strip(" \t\n\r\x0b\x0c").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
            if len(holders.get(key, ())) < 2 or min(holders[key]) == d:
                kept.append(line)
        out[d] = "\n".join(kept)
    return out


def test_stages_equal_plain_versions(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").withColumnRenamed("n_chars", "n_chars")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    steps = dict(P.STAGES)
    assert list(steps) == ["quality", "line_dedup", "near_dedup", "decontamination", "tokens"]
    read = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    good = steps["quality"](spark, docs, FOLDER)
    kept = read(good)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    text = read(docs)
    assert all(d in kept for d, q in labels.items() if q and len(text[d].split()) >= 20)
    assert not any(d in kept for d, q in labels.items() if not q)
    lined = steps["line_dedup"](spark, good, FOLDER)
    assert lined.columns == docs.columns
    after = plain_lines(kept)
    assert read(lined) == after
    near = steps["near_dedup"](spark, lined, FOLDER)
    ids = sorted(after)
    prints = [fingerprint(after[d]) for d in ids]
    root = classes(len(ids), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 4)
    alone = {d: after[d] for i, d in enumerate(ids) if root[i] == i}
    assert near.columns == docs.columns and read(near) == alone
    clean = steps["decontamination"](spark, near, FOLDER)
    pure = {d: t for d, t in alone.items() if not overlap_items(t, items)}
    assert clean.columns == docs.columns and read(clean) == pure and len(pure) < len(alone)
    own = Tokenizer.from_file(P.TOKENIZER)
    coded = steps["tokens"](spark, clean, FOLDER)
    assert {r["doc_id"]: r["ids"] for r in coded.collect()} == {
        d: own.encode(t, add_special_tokens=False).ids for d, t in pure.items()}


def test_run(spark):
    assert P.run(spark, FOLDER).count() > 50 and P.ORACLE_SQL is None


def test_a_text_whose_id_repeats_stays_if_it_is_no_copy(spark):
    a, b = "one two three four five six seven eight", "nine ten eleven twelve thirteen fourteen fifteen"
    rows = [(1, a), (2, a), (2, b), (None, a), (3, b), (4, None), (5, None), (6, a)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = P.near_dedup(spark, docs, "").collect()
    assert sorted([(r["doc_id"], r["text"]) for r in got], key=repr) == sorted([(1, a), (2, b), (None, a), (4, None)], key=repr)
