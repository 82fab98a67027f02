"""Ranked lexical search: best-first document intervals over range-maximum tables of the posting lists."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lacuna.llm.text import NOT_ALNUM, groups, split_words, texts_of
from lacuna.session import Scratch

#: Documents returned per item; postings of a block of documents that is searched at once.
TOP, BLOCK = 50, 1 << 18
#: Items are answered in groups of so many hashes of terms (8 bytes each), which are sent to each task.
GROUP_TERMS = 1 << 19
#: Intervals opened at a time.
STEP = 16


class Tables:
    """Posting lists of a block of documents, with a sparse table of range maxima over their impacts.

    The lists stand one behind the other: list t has the entries cut[t] to cut[t + 1], in the order of the documents.
    Row j of the sparse table has the place of the largest impact of each 2^j neighbours, and a range within a list is
    covered by two such runs, so the largest impact of any list in any document interval is two lookups.
    """

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_docs: int):
        order = np.lexsort((doc, term))
        self.term, self.doc, self.impact, self.n = term[order], doc[order], impact[order], n_docs
        self.key = self.term * n_docs + self.doc
        self.names, at, size = np.unique(self.term, return_index=True, return_counts=True)
        self.most = np.maximum.reduceat(self.impact, at) if len(at) else self.impact
        self.levels = [np.arange(len(order), dtype=np.int32)]
        span, longest = 1, int(size.max(initial=0))
        while span * 2 <= longest:
            x, y = self.levels[-1][:-span], self.levels[-1][span:]
            self.levels.append(np.where(self.impact[x] >= self.impact[y], x, y))
            span *= 2

    def maxima(self, terms: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest impact of each term (columns) in each document interval (rows, ends inclusive), and its entry or -1."""
        x = np.searchsorted(self.key, terms * self.n + low[:, None])
        y = np.searchsorted(self.key, terms * self.n + high[:, None], "right")
        place, value = np.full(x.shape, -1, np.int64), np.zeros(x.shape, np.int64)
        size = y - x
        level = np.frexp(np.maximum(size, 1))[1] - 1
        for j in np.unique(level[size > 0]).tolist():
            own = (level == j) & (size > 0)
            a, b = self.levels[j][x[own]], self.levels[j][y[own] - (1 << j)]
            place[own] = best = np.where(self.impact[a] >= self.impact[b], a, b)
            value[own] = self.impact[best]
        return value, place

    def scores(self, terms: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """The exact score of each document."""
        key = terms * self.n + docs[:, None]
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.impact[at], 0).sum(axis=1)


def best_first(tables: Tables, terms: np.ndarray, k: int, known: list[tuple[int, int]], ids: np.ndarray) -> list[tuple[int, int]]:
    """The k best (score, -number) of ``known`` and the documents of the block, as a heap with the least of them first.

    A document's number is ``ids`` of its place, ascending. An interval of documents is bounded by the sum of its
    terms' largest impacts. The interval with the highest bound is opened: its document with the largest impact is
    scored, and what lies on either side of it are two new intervals. Intervals that cannot reach the k-th best score,
    or only tie with it with higher numbers, are dropped; so ends the search, with no document left out that belongs to the best.
    """
    heap = known
    terms = terms[np.isin(terms, tables.names)]
    if not len(terms):
        return heap

    def bounded(low: np.ndarray, high: np.ndarray):
        value, place = tables.maxima(terms, low, high)
        total, column = value.sum(axis=1), value.argmax(axis=1)
        split = np.where(total > 0, tables.doc[place[np.arange(len(low)), column]], 0)
        return zip((-total).tolist(), low.tolist(), high.tolist(), split.tolist())

    def hopeful(bound: int, low: int) -> bool:
        return bound > 0 and (len(heap) < k or (bound, -int(ids[low])) > heap[0])

    queue = [x for x in bounded(np.array([0]), np.array([tables.n - 1])) if hopeful(-x[0], x[1])]
    while queue:
        opened = []
        while queue and len(opened) < STEP:
            if not hopeful(-queue[0][0], queue[0][1]):
                if len(heap) == k and -queue[0][0] < heap[0][0]:
                    queue.clear()  # no other bound is higher
                    break
                heapq.heappop(queue)
                continue
            opened.append(heapq.heappop(queue))
        if not opened:
            break
        docs = np.array([x[3] for x in opened])
        for doc, score in zip(docs.tolist(), tables.scores(terms, docs).tolist()):
            entry = (score, -int(ids[doc]))
            if len(heap) < k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
        low = np.array([y for _, lo, hi, at in opened for y in (lo, at + 1)])
        high = np.array([y for _, lo, hi, at in opened for y in (at - 1, hi)])
        some = low <= high
        if some.any():
            for x in bounded(low[some], high[some]):
                if hopeful(-x[0], x[1]):
                    heapq.heappush(queue, x)
    return heap


def _counted(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """(number, n, terms, counts): per document the number of its terms, and those of the vocabulary with their counts."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kinds = pa.list_(pa.int32())

    def run(parts):
        known = sent.value
        for part in parts:
            texts = texts_of(part.column(1))
            for begin, stop in groups(texts):
                words = split_words(texts[begin:stop], gap=NOT_ALNUM)
                at = np.minimum(np.searchsorted(known, words.hashes), len(known) - 1)
                hit = np.flatnonzero(known[at] == words.hashes) if len(known) else np.zeros(0, np.int64)
                pair, count = np.unique(words.owner[hit] * len(known) + at[hit], return_counts=True)
                cuts = np.searchsorted(pair, np.arange(stop - begin + 1) * len(known)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(x.astype(np.int32)))
                         for x in (pair % max(len(known), 1), count)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).slice(begin, stop - begin), pa.array(np.diff(words.first)),
                     *[x.cast(kinds) for x in lists]], names=["number", "n", "terms", "counts"])

    return docs.mapInArrow(run, "number bigint, n bigint, terms array<int>, counts array<int>")


def _item_terms(items: DataFrame, text_col: str) -> DataFrame:
    """(item, hashes): the different terms of each item."""
    def run(parts):
        for part in parts:
            words = split_words(texts_of(part.column(1)), gap=NOT_ALNUM)
            cuts, found = words.first, words.hashes.view(np.int64)
            lists = [np.unique(found[a:b]) for a, b in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lists, pa.list_(pa.int64()))], names=["item", "hashes"])

    return items.select("item", F.col(text_col).cast("string").alias("text")).mapInArrow(run, "item bigint, hashes array<bigint>")


def _searched(counted: DataFrame, names: np.ndarray, items: list[np.ndarray], weight: np.ndarray, n_docs: int, n_terms: int,
              k: int) -> DataFrame:
    """(item, part, number, score): for each task the k best documents of each item of ``names``."""
    sent = counted.sparkSession.sparkContext.broadcast((names, items, weight))

    def run(parts):
        names, items, weight = sent.value
        heaps: list[list[tuple[int, int]]] = [[] for _ in items]
        member = np.repeat(np.arange(len(items)), [len(t) for t in items])
        flat = np.concatenate([*items, np.zeros(0, np.int64)]).astype(np.int64)

        def search(number, n, size, term, count):
            order = np.argsort(number, kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            doc = np.repeat(place, size)
            m = 50 + 50 * n * n_docs // n_terms
            tf = count.astype(np.int64)
            impact = weight[term] * (1_000_000_000 * tf // (1000 * tf + 20 * np.repeat(m, size)))
            some = impact > 0
            if not some.any():
                return
            tables = Tables(term[some].astype(np.int64), doc[some], impact[some], len(number))
            # An item whose bound over the whole block is too low is not searched.
            most = np.zeros(len(weight), np.int64)
            most[tables.names] = tables.most
            bound = np.bincount(member, most[flat].astype(float), len(items))
            least = np.array([h[0][0] if len(h) == k else 1 for h in heaps])
            for i in np.flatnonzero(bound >= least).tolist():
                heaps[i] = best_first(tables, items[i], k, heaps[i], number[order])

        for part in parts:
            number, n = part.column(0).to_numpy(), part.column(1).to_numpy()
            size = part.column(2).value_lengths().to_numpy().astype(np.int64)
            term, count = (part.column(c).flatten().to_numpy() for c in (2, 3))
            cut = np.r_[0, np.cumsum(size)]
            begin = 0
            while begin < len(number):
                stop = max(int(np.searchsorted(cut, cut[begin] + BLOCK, "right")) - 1, begin + 1)
                x, y = cut[begin], cut[stop]
                search(number[begin:stop], n[begin:stop], size[begin:stop], term[x:y], count[x:y])
                begin = stop
        rows = [(i, -minus, score) for i, heap in enumerate(heaps) for score, minus in heap]
        item, number, score = np.array(rows, np.int64).reshape(-1, 3).T
        task = TaskContext.get().partitionId() if rows else 0
        yield pa.RecordBatch.from_arrays([pa.array(names[item]), pa.array(np.full(len(rows), task)), pa.array(number), pa.array(score)],
                                         names=["item", "part", "number", "score"])

    return counted.where(F.size("terms") > 0).mapInArrow(run, "item bigint, part bigint, number bigint, score bigint")


def search(docs: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The ``k`` best documents of each item: item_id, rank, doc_id, score.

    Terms are runs of letters, digits and characters beyond ASCII, A-Z lower-cased, told by a 64-bit hash. The score of
    a document is the sum of integer impacts of the item's terms, as in BM25: w * (10^9 tf div (1000 tf + 20 m)), with
    w = floor(1000 ln((2 N + 2) / (2 df + 1))) and m = 50 + 50 n N div L; N documents have a term, L is their
    number of terms, n that of this document. Equal scores rank by ascending id.

    Documents are counted once against the vocabulary of the items. Each task then searches its documents block by block
    (``BLOCK`` postings, so memory is bounded) and keeps k documents per item; those meet in two steps, salted first.
    The items are sent to the tasks: in groups of about ``GROUP_TERMS`` terms, each group with its own pass over the
    documents, so that what is sent does not grow with the table.

    A document without a term is found by none, an item without a term or a match has no rows; null texts are
    empty. A null doc_id comes last among equal scores. Repeated documents each have their rank; repeated items are answered
    each, also those with a null id. Empty tables give no rows; other columns are ignored. Ids must be whole numbers.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lexical")
    last = (1 << 63) - 1
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(last)).alias("number"),
                        F.col(text_col).cast("string").alias("text"))
    named = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).cast("string").alias("text")).withColumn(
        "item", F.monotonically_increasing_id())
    named = scratch.write(named, "items")
    terms, seen = scratch.write_observed(_item_terms(named, "text"), "terms", n="sum(size(hashes))")
    n_groups = max(1, -(-(seen["n"] or 0) // GROUP_TERMS))
    found = None
    for g in range(n_groups):
        group = terms.where((F.size("hashes") > 0) & (F.pmod(F.xxhash64("item"), F.lit(n_groups)) == g)).toArrow()
        names = group["item"].to_numpy()
        hashes = [np.array(h, np.int64).view(np.uint64) for h in group["hashes"].to_pylist()]
        vocabulary = np.unique(np.concatenate([*hashes, np.zeros(0, np.uint64)]))
        counted, total = scratch.write_observed(_counted(texts, vocabulary), f"counted_{g}", docs="count_if(n > 0)", terms="sum(n)")
        held = counted.select(F.explode("terms").alias("t")).groupBy("t").count().toArrow()
        df = np.zeros(len(vocabulary), np.int64)
        df[held["t"].to_numpy()] = held["count"].to_numpy()
        n_docs, n_terms = total["docs"] or 0, total["terms"] or 0
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)
        rows = _searched(counted, names, [np.searchsorted(vocabulary, h) for h in hashes], weight, n_docs, n_terms, k)
        found = rows if found is None else found.union(rows)
    best = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "number"))
    some = found.withColumn("salt", F.pmod("part", F.lit(64))).withColumn("r", best("item", "salt")).where(F.col("r") <= k)
    ranked = some.withColumn("rank", best("item")).where(F.col("rank") <= k)
    return ranked.join(named.select("item", "item_id"), "item").select(
        "item_id", F.col("rank").cast("int").alias("rank"), F.expr(f"nullif(number, {last}L)").alias("doc_id"), "score")
