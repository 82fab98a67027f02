"""Benchmark passages in documents, found by spaced seeds that tolerate replaced words."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.keyfilter import bitmap, passes
from lacuna.llm.text import NOT_ALNUM, U64, Words, groups, mix, split_words, texts_of
from lacuna.session import Scratch

#: An overlap is ``WINDOW`` consecutive words of which at least ``EQUAL`` (0.8 or more) are equal.
WINDOW, EQUAL = 13, 11
#: Fixed masks; 0 ignores a word. Whichever two words of a window are replaced, one of the masks fits somewhere in
#: it without touching them, so every overlap has a seed (the tests try all replacements).
MASKS = ("11010111", "11110011")
#: Benchmark texts shorter than a window are searched whole, with the same tolerance. Below five words they are no passage
#: and only found as the whole text of a document.
PASSAGE, SHARE = 5, 0.8
#: Slots of the bitmap per benchmark hash: one place in about a thousand passes by chance.
SLOTS = 1024


def seeds(words: Words, mask: str, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words under the mask at each place where it fits into a text, and the index of the first word."""
    n = len(words.hashes) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    total = np.full(n, salt, U64)
    for j, used in enumerate(mask):
        if used == "1":
            total = total * U64(0x9E3779B97F4A7C15) + words.hashes[j:j + n]
    room = np.repeat(words.first[1:], np.diff(words.first))[:n]
    at = np.flatnonzero(np.arange(n) + len(mask) <= room)
    return mix(total[at]), at


def needed(n: int) -> int:
    """How many words of an overlap with an item of ``n`` words must be equal."""
    return EQUAL if n >= WINDOW else int(np.ceil(SHARE * n)) if n >= PASSAGE else n


def short_masks(n: int) -> list[str]:
    """Masks as long as an item of fewer than ``WINDOW`` words: whichever words may be replaced, one mask touches none of them.

    With r replaceable words the places are dealt into r + 2 groups, and a mask ignores r of those.
    """
    r = n - needed(n)
    return ["".join("0" if k % (r + 2) in ignored else "1" for k in range(n)) for ignored in combinations(range(r + 2), r)]


def short_seeds(words: Words, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Seeds of items of ``n`` words; below ``PASSAGE`` words only those of whole texts."""
    found = [seeds(words, m, 100 + 16 * n + k) for k, m in enumerate(short_masks(n))]
    if n >= PASSAGE:
        return found
    whole = np.repeat(np.diff(words.first) == n, np.diff(words.first))
    return [(h[whole[at]], at[whole[at]]) for h, at in found]


def all_seeds(words: Words, lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Seeds under all masks, and under those of each of the short ``lengths``."""
    found = [seeds(words, m, i + 1) for i, m in enumerate(MASKS)]
    found += [x for n in lengths for x in short_seeds(words, n)]
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def item_seeds(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, words, hashes, places) of each benchmark text with a word; hashes are those of its seeds."""
    kind = items.schema[id_col].dataType.simpleString()

    def run(parts):
        for part in parts:
            texts, rows = texts_of(part.column(1)), []
            for i, text in enumerate(texts):
                w = split_words([text], NOT_ALNUM)
                n = len(w.hashes)
                if not n:
                    continue
                if n < WINDOW:
                    h, at = (np.concatenate(x) for x in zip(*short_seeds(w, n)))
                else:
                    h, at = all_seeds(w, [])
                rows.append((part.column(0)[i].as_py(), w.hashes.tobytes(), h.view(np.int64).tolist(), at.tolist()))
            kinds = [part.schema.field(0).type, pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(4)],
                                             names=["item_id", "words", "hashes", "places"])

    return items.select(F.col(id_col).alias("item_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, f"item_id {kind}, words binary, hashes array<bigint>, places array<bigint>")


def hit_segments(docs: DataFrame, filter_words, lengths: list[int], id_col: str, text_col: str) -> DataFrame:
    """(doc_id, start, words, hashes, places): the stretches of each text around seeds that pass the bitmap.

    Words are held once per stretch, with a window's length on both sides of every seed; places count from the
    text's first word, ``start`` is the stretch's.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast(filter_words)

    def run(parts):
        for part in parts:
            ids, texts = part.column(0), texts_of(part.column(1))
            for begin, stop in groups(texts):
                w = split_words(texts[begin:stop], NOT_ALNUM)
                h, at = all_seeds(w, lengths)
                ok = passes(held.value, h)
                h, at = h[ok], at[ok]
                if not len(at):
                    continue
                order = np.argsort(at, kind="stable")
                h, at = h[order], at[order]
                text = w.owner[at]
                low = np.maximum(at - WINDOW, w.first[text])
                high = np.minimum(at + 2 * WINDOW, w.first[text + 1])
                new = np.r_[True, (text[1:] != text[:-1]) | (low[1:] > np.maximum.accumulate(high)[:-1])]
                heads = np.flatnonzero(new)
                tails = np.r_[heads[1:], len(at)]
                rows = []
                for a, b in zip(heads.tolist(), tails.tolist()):
                    t, lo, hi = int(text[a]), int(low[a]), int(high[a:b].max())
                    first = int(w.first[t])
                    rows.append((ids[begin + t].as_py(), lo - first, w.hashes[lo:hi].tobytes(),
                                 h[a:b].view(np.int64), at[a:b] - first))
                kinds = [part.schema.field(0).type, pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(5)],
                                                 names=["doc_id", "start", "words", "hashes", "places"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, f"doc_id {kind}, start bigint, words binary, hashes array<bigint>, places array<bigint>")


def overlaps_along(doc: np.ndarray, start: int, item: np.ndarray, shift: int) -> list[tuple[int, int, int]]:
    """Verified stretches (first word, end, equal words) of a document along one alignment with an item.

    Word p of the document stands beside word p - shift of the item; ``doc`` begins at word ``start``.
    """
    low, high = max(start, shift), min(start + len(doc), shift + len(item))
    width = min(WINDOW, len(item))
    if high - low < width:
        return []
    equal = doc[low - start:high - start] == item[low - shift:high - shift]
    total = np.r_[0, np.cumsum(equal)]
    good = np.flatnonzero(total[width:] - total[:-width] >= needed(width))
    out = []
    for w in good.tolist():
        if out and w <= out[-1][1]:
            out[-1][1] = w + width
        else:
            out.append([w, w + width])
    return [(low + a, low + b, int(total[b] - total[a])) for a, b in out]


def overlaps(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Benchmark passages in documents: doc_id, item_id, first_word, end_word, equal_words, n_words.

    Words are runs of letters and digits, every character beyond ASCII counting as a letter; only A-Z is lower-cased. A
    passage is a maximal stretch of windows of 13 words, 11 or more of them equal to the benchmark's at the same distance.
    Items of 5 to 12 words are one window with 0.8 or more equal; shorter ones are no passage and are found only
    as the whole text of a document. One row per passage and alignment; ``n_words`` is the length of the item.

    Masks hash some of the words at each place of both sides. Places of documents that pass a bitmap of the
    benchmark's hashes (64 MB at most) are joined with the hashes themselves and verified once per alignment.
    Documents are read once; what is kept and shuffled is the stretches around hits.

    Null texts have no words. Repeated rows and ids are searched row by row; null ids are kept. An empty side gives
    no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "spaced")
    found = item_seeds(items, item_id_col, item_text_col).withColumn("item", F.monotonically_increasing_id())
    bench = scratch.write(found, "items")
    seed = bench.select("item", F.explode(F.arrays_zip("hashes", "places")).alias("s")).select(
        "item", F.col("s.hashes").alias("h"), F.col("s.places").alias("item_at"))
    size = bench.agg(F.sum(F.size("hashes"))).first()[0] or 0
    short = [r[0] for r in bench.select((F.octet_length("words") / 8).cast("int").alias("n")).where(
        F.col("n") < WINDOW).distinct().collect()]  # at most WINDOW - 1 lengths
    segments = scratch.write(hit_segments(docs, bitmap(seed, "h", size, SLOTS), sorted(short), id_col, text_col).withColumn(
        "segment", F.monotonically_increasing_id()), "segments")
    hits = segments.select("segment", F.explode(F.arrays_zip("hashes", "places")).alias("s")).select(
        "segment", F.col("s.hashes").alias("h"), F.col("s.places").alias("at"))
    aligned = hits.join(seed, "h").select("segment", "item", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
    sides = aligned.join(segments.select("segment", "doc_id", "start", F.col("words").alias("doc_words")), "segment").join(
        bench.select("item", "item_id", F.col("words").alias("item_words")), "item")
    doc_kind, item_kind = (x.schema[c].dataType.simpleString() for x, c in ((segments, "doc_id"), (bench, "item_id")))

    def run(parts):
        for part in parts:
            rows = []
            for r in range(part.num_rows):
                doc, item = (np.frombuffer(part.column(k)[r].as_py(), np.uint64) for k in (2, 4))
                for a, b, n in overlaps_along(doc, part.column(1)[r].as_py(), item, part.column(5)[r].as_py()):
                    rows.append((part.column(0)[r].as_py(), part.column(3)[r].as_py(), a, b, n, len(item)))
            kinds = [part.schema.field(0).type, part.schema.field(3).type, *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], kinds[k]) for k in range(6)], names=[
                "doc_id", "item_id", "first_word", "end_word", "equal_words", "n_words"])

    return sides.select("doc_id", "start", "doc_words", "item_id", "item_words", "shift").mapInArrow(
        run, f"doc_id {doc_kind}, item_id {item_kind}, first_word bigint, end_word bigint, equal_words bigint, "
             "n_words bigint")


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id has no benchmark passage, all columns unchanged. Null ids are compared as equal."""
    found = overlaps(docs, items, id_col, text_col, item_id_col, item_text_col)
    bad = Scratch(docs.sparkSession, "leaks").write(found.select(F.col("doc_id").alias("_leak")).distinct(), "ids")
    return docs.join(bad, docs[id_col].eqNullSafe(bad["_leak"]), "left_anti")
