"""Byte pair encoding with word ends, and its decoding."""

from __future__ import annotations

import heapq
import json
import unicodedata
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.text import groups

#: Pieces of text are remembered per worker, up to twice so many (some 130 MB); that changes no result.
REMEMBERED = 300_000
_SEPARATORS = frozenset("\x1c\x1d\x1e\x1f")
_NEVER = 1 << 60


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself if printable Latin-1, else the next from U+0100."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


def _every_character() -> str:
    return "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))


class WordBPE:
    """The model of a tokenizer file: normalizer (NFC, white space, lower case), word pattern, vocabulary, merges."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model = spec["model"]
        kinds = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        steps = [p["type"] for p in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or steps != ["Split", "ByteLevel"] \
                or spec.get("decoder") or spec.get("post_processor"):
            raise ValueError("not a word BPE file: NFC, white space, lower case, split, byte level")
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        # A pair's key is one integer; merges are numbered by rank.
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank.setdefault(self.vocab[a] << 32 | self.vocab[b], r)
            self.made.append(self.vocab[a + b])
        order = sorted(self.rank)
        self.pairs = np.array(order, np.int64)
        self.ranks = np.array([*[self.rank[k] for k in order], _NEVER], np.int64)
        self.results = np.array(self.made, np.int64)
        letters = byte_alphabet()
        self.inner = [self.vocab.get(c) for c in letters]
        self.final = [self.vocab.get(c + self.end) for c in letters]
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.plain = regex.compile(pattern).findall
        # Characters newer than this Python's Unicode are neither letters nor digits.
        newer = {kind: "".join(c for c in regex.findall(rf"\p{{{kind}}}", _every_character())
                               if unicodedata.category(c) == "Cn") for kind in "LN"}
        self.newer = frozenset("".join(newer.values()))
        for kind, some in newer.items():
            if some:
                pattern = pattern.replace(f"\\p{{{kind}}}", f"[\\p{{{kind}}}--[{some}]]")
        self.strict = regex.compile(pattern, regex.V1).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.table = np.array([self.tokens.get(i) for i in range(max(self.tokens, default=-1) + 1)], object)

    def merge(self, word: str) -> list[int]:
        """Ids of one word, by a contiguous array of ranks.

        ``parts`` are the ids between the boundaries that are left and ``ranks[k]`` is the rank of parts k and
        k + 1. The least rank, the leftmost of equals, is merged: the boundary between the two parts is deleted and
        the ranks on both sides are looked up again, until no pair has a rank.
        """
        raw = word.encode("utf-8", "surrogatepass")
        parts = [i for i in [*[self.inner[b] for b in raw[:-1]], self.final[raw[-1]]] if i is not None]
        if len(raw) > 512:
            return self._merge_long(parts)
        look, made = self.rank.get, self.made
        ranks = [look(a << 32 | b, _NEVER) for a, b in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == _NEVER:
                break
            k = ranks.index(least)
            parts[k] = new = made[least]
            del parts[k + 1], ranks[k]
            if k < len(ranks):
                ranks[k] = look(new << 32 | parts[k + 1], _NEVER)
            if k:
                ranks[k - 1] = look(parts[k - 1] << 32 | new, _NEVER)
        return parts

    def _look(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if not len(self.pairs):
            return np.full(left.shape, _NEVER)
        keys = left << 32 | right
        at = np.searchsorted(self.pairs, keys)
        at[at == len(self.pairs)] = 0
        return self.ranks[np.where(self.pairs[at] == keys, at, len(self.pairs))]

    def merge_many(self, words: list[str]) -> dict[str, list[int]]:
        """``merge`` for many words: one array of parts and one of ranks for all words of a length.

        Every pass merges one pair in each word that has one left, so the words still in work all have as many parts.
        """
        out, by_length = {}, {}
        for word in words:
            raw = word.encode("utf-8", "surrogatepass")
            by_length.setdefault(len(raw), []).append((word, raw))
        inner, final = (np.array([-1 if i is None else i for i in x], np.int64) for x in (self.inner, self.final))
        for n, some in by_length.items():
            if n > 64 or min(inner.min(), final.min()) < 0:
                out.update((w, self.merge(w)) for w, _ in some)
                continue
            raw = np.frombuffer(b"".join([r for _, r in some]), np.uint8).reshape(-1, n)
            parts = inner[raw]
            parts[:, -1] = final[raw[:, -1]]
            ranks, names = self._look(parts[:, :-1], parts[:, 1:]), np.arange(len(some))
            while True:
                width = ranks.shape[1]
                k = ranks.argmin(axis=1) if width else np.zeros(len(names), np.int64)
                rows = np.arange(len(names))
                live = ranks[rows, k] < _NEVER if width else np.zeros(len(names), bool)
                for name, ids in zip(names[~live].tolist(), parts[~live].tolist()):
                    out[some[name][0]] = ids
                if not live.any():
                    break
                names, parts, ranks, k = names[live], parts[live], ranks[live], k[live]
                rows = np.arange(len(names))
                parts[rows, k] = self.results[ranks[rows, k]]
                keep = np.ones(parts.shape, bool)
                keep[rows, k + 1] = False
                parts = parts[keep].reshape(len(names), width)
                keep = np.ones(ranks.shape, bool)
                keep[rows, k] = False
                ranks = ranks[keep].reshape(len(names), width - 1)
                for at, some_rows in ((k, np.flatnonzero(k < width - 1)), (k - 1, np.flatnonzero(k > 0))):
                    c = at[some_rows]
                    ranks[some_rows, c] = self._look(parts[some_rows, c], parts[some_rows, c + 1])
        return out

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same merges for a word too long to scan again after each: the ranks wait in a heap."""
        n, look = len(ids), self.rank.get
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap: list[tuple[int, int, int, int]] = []

        def push(i):
            j = after[i] if i >= 0 else n
            if j < n and (found := look(ids[i] << 32 | ids[j])) is not None:
                heapq.heappush(heap, (found, i, ids[i], ids[j]))

        for i in range(n):
            push(i)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = self.made[r], False, after[j]
            if after[j] < n:
                before[after[j]] = i
            push(before[i])
            push(i)
        return [ids[i] for i in range(n) if alive[i]]

    def _clean(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        # A capital sigma is lower-cased without regard to its place in the word.
        return text.replace("Σ", "σ").lower() if "Σ" in text else text.lower()

    def _pieces(self, text: str) -> list[str]:
        """Pieces between white space; no word holds any. U+001C to U+001F are none here."""
        return text.split() if _SEPARATORS.isdisjoint(text) else regex.findall(r"\S+", text)

    def find(self, piece: str) -> list[str]:
        """The words of a piece. A piece of letters is one, and so is what stands before a last mark."""
        if piece.isalpha():
            return [piece]
        if piece[-1] in ".,;:!?" and piece[:-1].isalpha():
            return [piece[:-1], piece[-1]]
        return (self.plain if piece.isascii() or self.newer.isdisjoint(piece) else self.strict)(piece)

    def learn(self, pieces: set[str]) -> None:
        """Remember the ids of pieces; the words of those not seen before are merged together."""
        if len(self.known) + len(pieces) > REMEMBERED:
            self.older, self.known = self.known, {}
        old = [p for p in pieces if p in self.older]
        for p in old:
            self.known[p] = self.older[p]
        new = [(p, self.find(p)) for p in pieces if p not in self.known]
        merged = self.merge_many(list({w for _, words in new for w in words}))
        for p, words in new:
            self.known[p] = array("i", [i for w in words for i in merged[w]]).tobytes()

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers.

        Pieces are remembered in two generations of ``REMEMBERED``; only those that this call needs are sure to be there.
        """
        plans = []
        for text in texts:
            parts = self.cut(text) if text and self.cut and "<|" in text else [text or ""]
            plans.append([self.special[x] if k % 2 else self._pieces(self._clean(x)) for k, x in enumerate(parts)])
        self.learn({p for plan in plans for part in plan if isinstance(part, list) for p in part})
        get = self.known.__getitem__
        return [b"".join([b"".join(map(get, x)) if isinstance(x, list) else np.int32(x).tobytes() for x in plan]) for plan in plans]

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: np.ndarray) -> str:
        """Tokens joined by spaces, special ones included; unknown ids are left out."""
        ids = ids[(ids >= 0) & (ids < len(self.table))]
        return " ".join([t for t in self.table[ids].tolist() if t is not None])


@lru_cache(maxsize=2)
def _model(source: str) -> WordBPE:
    return WordBPE(source)


def _checked(source: str) -> str:
    if len(source) > 64 << 20:
        raise ValueError("the tokenizer file is larger than 64 MB, too large to send to every task")
    return source


def read_tokenizer(path: str) -> str:
    """The text of a tokenizer file, read by the driver."""
    with open(path, encoding="utf-8") as file:
        return _checked(file.read())


def encode(docs: DataFrame, source: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """``docs`` with the ids (array<int>) of each text; an ``out_col`` that is there already is replaced.

    ``source`` is the text of the tokenizer file (64 MB at most; it is sent to each executor once). Special tokens
    that stand in a text become their ids. A null text is empty and has no ids. Rows are independent: repeated
    rows, ties and null ids need no care, empty tables give none, and memory is bounded by the longest text.
    """
    held = docs.sparkSession.sparkContext.broadcast(_checked(source))
    own = [c for c in docs.columns if c != out_col]
    at = own.index(text_col)

    def run(parts):
        model = _model(held.value)
        for part in parts:
            texts = part.column(at).cast(pa.string())
            sizes = texts.to_pylist()
            for begin, stop in groups([t or "" for t in sizes]):
                codes = model.encode_all(sizes[begin:stop])
                offsets = np.cumsum([0, *[len(c) // 4 for c in codes]]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(codes), np.int32)))
                some = part.slice(begin, stop - begin)
                yield pa.RecordBatch.from_arrays([*some.columns, ids], names=[*own, out_col])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*own).schema)
    return docs.select(*[F.col(f"`{c}`") for c in own]).mapInArrow(run, f"{fields}, `{out_col}` array<int>")


def decode(docs: DataFrame, source: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``docs`` with the text that the ids stand for; null ids are an empty text."""
    held = docs.sparkSession.sparkContext.broadcast(_checked(source))
    own = [c for c in docs.columns if c != out_col]
    at = own.index(ids_col)

    def run(parts):
        model = _model(held.value)
        for part in parts:
            column = part.column(at)
            offsets = column.offsets.to_numpy()
            values = column.values.to_numpy(zero_copy_only=False)
            for begin in range(0, part.num_rows, 256):
                stop = min(begin + 256, part.num_rows)
                texts = [model.decode(values[offsets[i]:offsets[i + 1]]) for i in range(begin, stop)]
                some = part.slice(begin, stop - begin)
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(texts, pa.string())], names=[*own, out_col])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*own).schema)
    return docs.select(*[F.col(f"`{c}`") for c in own]).mapInArrow(run, f"{fields}, `{out_col}` string")
