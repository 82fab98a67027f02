"""Packing of token sequences by a configuration linear program over the lengths."""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lacuna.llm.bpe import byte_alphabet
from lacuna.llm.text import groups
from lacuna.session import Scratch

#: Tokens a sequence holds, and the id that ends a document.
CAPACITY, END = 2048, 0
#: Rounds of multiplicative weights and the share of a length that one round covers at most.
ROUNDS, STEP, RATE = 120, 0.02, 6.0


def price(worth: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Knapsack by dynamic programming: the best total worth within each capacity, and the last length put in.

    ``worth[l]`` is what an item of length l is worth (-inf: there is none), items may be repeated. A last length
    of 0 leaves a token of room unused.
    """
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    lengths = np.flatnonzero(worth > 0)
    for room in range(int(lengths[0]) if len(lengths) else capacity + 1, capacity + 1):
        total = worth[1:room + 1] + best[room - 1::-1]
        item = int(total.argmax())
        if total[item] > best[room - 1]:
            best[room], last[room] = total[item], item + 1
        else:
            best[room] = best[room - 1]
    return best, last


def _pattern(first: int, room: int, last: np.ndarray, counts: np.ndarray) -> tuple[tuple[int, int], ...]:
    """(length, copies) of an item and the best use of the room beside it, with no more copies than there are."""
    found = {first: 1}
    while room > 0:
        item = int(last[room])
        if item:
            found[item] = found.get(item, 0) + 1
        room -= item or 1
    return tuple(sorted((n, min(k, int(counts[n]))) for n, k in found.items()))


def fractional(counts: np.ndarray, capacity: int) -> dict[tuple[tuple[int, int], ...], float]:
    """An approximate solution of the configuration program: how often each pattern of lengths is used.

    The program asks for the least number of sequences whose patterns hold ``counts[l]`` items of every length l. Each
    length has a price, at first its share of a sequence. A round prices patterns by a knapsack, takes for
    every length the best pattern with it if that is worth nearly as much as the best of all, and lowers the prices of
    the lengths that these patterns hold, the more the further they are covered.
    """
    lengths = np.flatnonzero(counts)
    use: dict[tuple[tuple[int, int], ...], float] = {}
    if not len(lengths):
        return use
    covered, base = np.zeros(capacity + 1), np.arange(capacity + 1) / capacity
    for _ in range(ROUNDS):
        worth = np.full(capacity + 1, -np.inf)
        worth[lengths] = base[lengths] * np.exp(-RATE * covered[lengths])
        best, last = price(worth, capacity)
        with_it = worth[lengths] + best[capacity - lengths]
        load, taken = np.zeros(capacity + 1), {}
        for n in lengths[with_it >= (1 - STEP) * best[capacity]].tolist():
            pattern = _pattern(n, capacity - n, last, counts)
            if pattern not in taken:
                taken[pattern] = min(counts[k] / copies for k, copies in pattern)
                for k, copies in pattern:
                    load[k] += taken[pattern] * copies
        for pattern, number in taken.items():  # no length is covered by more than STEP in a round
            number *= STEP * min(1.0, *(counts[k] / load[k] for k, _ in pattern))
            use[pattern] = use.get(pattern, 0.0) + number
            for k, copies in pattern:
                covered[k] += number * copies / counts[k]
    mean = float((covered * base * counts).sum() / (base * counts).sum())
    return {pattern: number / mean for pattern, number in use.items()}


def fill(counts: np.ndarray, capacity: int) -> list[tuple[int, int]]:
    """A pattern for what is left: the longest item, and items that leave the least room beside it, long ones first."""
    first = int(np.flatnonzero(counts)[-1])
    room = capacity - first
    left = counts[:room + 1].copy()
    if first <= room:
        left[first] -= 1
    items, reach, kept = [], 1, []
    limit = (1 << (room + 1)) - 1
    for n in np.flatnonzero(left)[::-1].tolist():
        copies, some = min(int(left[n]), room // n), 1
        while copies:  # copies in powers of two, so that few sets of sums are needed
            some = min(some, copies)
            items.append((n, some))
            kept.append(reach)
            reach |= (reach << (n * some)) & limit
            copies, some = copies - some, some * 2
        if reach >> room & 1:
            break
    total, found = reach.bit_length() - 1, {first: 1}
    for (n, some), before in zip(reversed(items), reversed(kept)):
        if not before >> total & 1:
            found[n] = found.get(n, 0) + some
            total -= n * some
    return sorted(found.items())


def patterns(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[list[tuple[int, int]], int]]:
    """Whole numbers of patterns [(length, copies)] that hold ``counts[l]`` items of each length l exactly.

    The fractional solution is rounded down, then up where items are left, largest fraction first; what
    no pattern took is packed pattern by pattern by ``fill``, each as often as it fits. The work depends on the capacity,
    not on the number of items.
    """
    left = counts.astype(np.int64).copy()
    out = []

    def take(pattern, wanted):
        number = min([wanted, *[int(left[n]) // k for n, k in pattern]])
        if number > 0:
            for n, k in pattern:
                left[n] -= k * number
            out.append((list(pattern), number))

    use = sorted(fractional(counts, capacity).items(), key=lambda x: -x[1])
    for pattern, number in use:
        take(pattern, int(number))
    for pattern, number in sorted(use, key=lambda x: int(x[1]) - x[1]):
        if sum(n * k for n, k in pattern) == capacity:
            take(pattern, 1)
    while left.any():
        pattern = fill(left, capacity)
        take(pattern, int(left.max()))
    return out


class ByteBPE:
    """Ids of texts under a byte-level BPE file of the ``tokenizers`` library, the special tokens in them included.

    The vocabulary is read from the file; the merging is done by ``tiktoken``, which gives the same ids if each merge
    makes the token that follows the one before, and is several times faster. Other files are run by ``tokenizers``.
    """

    def __init__(self, source: str):
        import tiktoken

        spec = json.loads(source)
        model, split = spec["model"], spec["pre_tokenizer"]
        plain = model["type"] == "BPE" and spec["normalizer"] is None and split["type"] == "ByteLevel" and not any(
            model.get(k) for k in ("continuing_subword_prefix", "end_of_word_suffix", "dropout", "ignore_merges")) \
            and split["use_regex"] and not split["add_prefix_space"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        alphabet = {c: b for b, c in enumerate(byte_alphabet())}
        vocab = {t: i for t, i in model["vocab"].items() if t not in self.special}
        made = [vocab.get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
        if plain and made == list(range(256, 256 + len(made))) and len(vocab) == 256 + len(made) \
                and all(t["normalized"] is False and not t["lstrip"] and not t["rstrip"] and not t["single_word"]
                        for t in spec["added_tokens"]):
            ranks = {bytes(alphabet[c] for c in t): i for t, i in vocab.items()}
            # The pattern of byte-level splitting, a fixed value.
            pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
            known = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens=self.special)
            allowed = set(self.special)
            self.ids = lambda text: known.encode_to_numpy(text, allowed_special=allowed, disallowed_special=())
        else:
            from tokenizers import Tokenizer

            other = Tokenizer.from_str(source)
            other.no_truncation()
            other.no_padding()
            self.ids = lambda text: np.array(other.encode(text, add_special_tokens=False).ids, np.uint32)


@lru_cache(maxsize=2)
def _tokenizer(source: str) -> ByteBPE:
    return ByteBPE(source)


def cut(docs: DataFrame, source: str, capacity: int = CAPACITY, end: int = END, id_col: str = "doc_id",
        text_col: str = "text") -> DataFrame:
    """Pieces of the documents: id, piece, start, length, ids (little-endian unsigned 32-bit, as binary).

    A document is the ids of its text and ``end``. Only documents of more than ``capacity`` ids are cut, into pieces of
    that length of which the first holds what is left over. ``source`` is the text of the tokenizer file (64 MB at
    most). A null text is empty and gives one piece with the end alone. Every row has its pieces, also
    repeated ones and those with a null id; empty tables give none; other columns are ignored.
    """
    if capacity < 1 or len(source) > 64 << 20:
        raise ValueError("the capacity must be 1 or more and the tokenizer file at most 64 MB long")
    held = docs.sparkSession.sparkContext.broadcast(source)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(parts):
        ids_of = _tokenizer(held.value).ids
        for part in parts:
            texts = [t or "" for t in part.column(1).to_pylist()]
            for begin, stop in groups(texts):
                row, piece, start, length, ids = [], [], [], [], []
                for r in range(begin, stop):
                    code = np.append(ids_of(texts[r]), end).astype("<u4")
                    n = -(-len(code) // capacity)
                    cuts = [0, *range(len(code) - (n - 1) * capacity, len(code) + 1, capacity)]
                    for k, (x, y) in enumerate(zip(cuts, cuts[1:])):
                        row.append(r)
                        piece.append(k)
                        start.append(x)
                        length.append(y - x)
                        ids.append(code[x:y].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                     pa.array(length, pa.int64()), pa.array(ids, pa.binary())],
                    names=["id", "piece", "start", "length", "ids"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, piece int, start bigint, length bigint, ids binary")


def _fields(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def _numbered(pieces: DataFrame, length: str, capacity: int) -> DataFrame:
    """Adds the task (``_part``) and how many pieces of the same length the task had before (``_nth``)."""
    at = pieces.columns.index(length)

    def run(parts):
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for part in parts:
            size = part.column(at).to_numpy()
            if len(size) and (size.min() < 1 or size.max() > capacity):
                raise ValueError(f"pieces must have 1 to {capacity} tokens")
            order = np.argsort(size, kind="stable")
            ranked = size[order]
            nth = np.empty(len(size), np.int64)
            nth[order] = np.arange(len(size)) - np.searchsorted(ranked, ranked) + seen[ranked]
            seen += np.bincount(size, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(len(size), task)), pa.array(nth)],
                                             names=[*part.schema.names, "_part", "_nth"])

    return pieces.mapInArrow(run, f"{_fields(pieces)}, _part bigint, _nth bigint")


def places(counts: np.ndarray, capacity: int) -> tuple[np.ndarray, ...]:
    """Where the r-th piece of a length goes, as runs: (length << 48 | first rank, first sequence, copies, offset).

    A run covers the pieces of one length in all sequences of one pattern, so there are as many as patterns
    have lengths: at most ``ROUNDS`` patterns per length, whatever the number of pieces.
    """
    shorter = counts[:capacity + 1].copy()
    shorter[capacity] = 0
    plan = [*patterns(shorter, capacity), *([([(capacity, 1)], int(counts[capacity]))] if counts[capacity] else [])]
    taken, runs, sequence = np.zeros(capacity + 1, np.int64), [], 0
    for pattern, number in plan:
        offset = 0
        for n, copies in reversed(pattern):
            runs.append((n << 48 | int(taken[n]), sequence, copies, offset))
            taken[n] += copies * number
            offset += copies * n
        sequence += number
    return tuple(np.array(sorted(runs), np.int64).reshape(-1, 4).T)


def assign(pieces: DataFrame, capacity: int = CAPACITY, length_col: str = "length") -> DataFrame:
    """``pieces`` with sequence_id and offset: a packing into few sequences of ``capacity`` tokens, gapless from 0.

    The histogram of lengths (``capacity`` numbers) is all that reaches the driver; it solves the configuration program
    there and sends each task the runs of places per length. A piece is told by its rank among those of its length:
    its number within its task, given as the pieces are written, and the counts of the tasks before. So no length
    is sorted or gathered, however many pieces have it. Every row gets a place; a length that is null,
    under 1 or over the capacity is an error. Columns named sequence_id or offset are replaced.
    """
    scratch = Scratch(pieces.sparkSession, "packing")
    own = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    length = F.col(f"`{length_col}`")
    rows = scratch.write(_numbered(pieces.select(*[F.col(f"`{c}`") for c in own]), length_col, capacity), "pieces")
    counts = scratch.write(rows.groupBy(F.col("_part").alias("_p"), length.alias("_l")).agg(F.count("*").alias("n")), "counts")
    total = np.zeros(capacity + 1, np.int64)
    for n, number in counts.groupBy("_l").agg(F.sum("n")).collect():
        total[n] = number
    sent = pieces.sparkSession.sparkContext.broadcast(places(total, capacity))
    before = Window.partitionBy("_l").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("_p", "_l", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_shift"))
    ranked = rows.join(shifts, (F.col("_part") == F.col("_p")) & (length == F.col("_l"))).select(
        *[F.col(f"`{c}`") for c in own], (F.col("_nth") + F.col("_shift")).alias("_rank"))
    at = own.index(length_col)

    def run(parts):
        first, sequence, copies, offset = sent.value
        for part in parts:
            size, rank = part.column(at).to_numpy(), part.column(len(own)).to_numpy()
            key = size << 48 | rank
            r = np.searchsorted(first, key, "right") - 1
            nth = key - first[r] if len(r) else key
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:-1], pa.array(sequence[r] + nth // copies[r]), pa.array(offset[r] + nth % copies[r] * size)],
                names=[*own, "sequence_id", "offset"])

    return ranked.mapInArrow(run, f"{_fields(rows.select(*[F.col(f'`{c}`') for c in own]))}, sequence_id bigint, offset bigint")


def pack(docs: DataFrame, source: str, capacity: int = CAPACITY, end: int = END, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """``cut`` and ``assign``: id, piece, start, length, ids, sequence_id, offset."""
    return assign(cut(docs, source, capacity, end, id_col, text_col), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids): the packed sequences themselves; a sequence has at most as many pieces as tokens."""
    return packed.groupBy("sequence_id").agg(
        F.sum("length").alias("length"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p")).select(
        "sequence_id", "length", F.expr("aggregate(p, X'', (t, x) -> concat(t, x.ids))").alias("ids"))
