"""Quality rules as a short-circuit cascade, ordered by rejections per second on a sample."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.text import groups, per_text, split_words, texts_of, windows

SYMBOLS = b"#*$%&|<>"
#: Rules are ordered after a sample of about so many documents; the order changes the work, never a verdict.
SAMPLE_DOCS = 2000
_BLANKS = b"\t\n\x0b\x0c\r "
_UPPER = bytes(range(65, 91))
#: Bytes that end or go on a character but begin none.
_LATER = bytes(range(128, 192))
#: Bytes that begin a character from U+0800 on, where scripts do without blanks or have other word lengths.
_WIDE = bytes(range(224, 256))
#: What begins no letter; every character beyond ASCII counts as a letter.
_NO_LETTER = bytes(b for b in range(192) if not (65 <= b <= 90 or 97 <= b <= 122))


@dataclass(frozen=True)
class Rule:
    """``rejects`` gets measured texts and the numbers of those to judge, and returns a flag for each of these."""

    name: str
    rejects: Callable[[Measured, np.ndarray], np.ndarray]


class Measured:
    """UTF-8 texts with their measures, each taken once per text, and only of the texts that it is asked for."""

    def __init__(self, texts: list[bytes], known: dict[str, tuple[np.ndarray, np.ndarray]] | None = None):
        self.texts = texts
        self._known = {k: (v.copy(), at.copy()) for k, (v, at) in (known or {}).items()}

    def __len__(self) -> int:
        return len(self.texts)

    def copy(self) -> Measured:
        return Measured(self.texts, self._known)

    def __call__(self, name: str, rows: np.ndarray) -> np.ndarray:
        n = len(self.texts)
        value, at = self._known.setdefault(name, (np.zeros(n, np.int64), np.zeros(n, bool)))
        todo = rows[~at[rows]]
        if len(todo):
            for k, found in MEASURES[name]([self.texts[i] for i in todo.tolist()]).items():
                into, done = self._known.setdefault(k, (np.zeros(n, np.int64), np.zeros(n, bool)))
                into[todo], done[todo] = found, True
        return value[rows]


def _each(name: str, of: Callable[[bytes], int]) -> Callable[[list[bytes]], dict[str, np.ndarray]]:
    return lambda texts: {name: np.fromiter(map(of, texts), np.int64, len(texts))}


def _repeats(texts: list[bytes]) -> dict[str, np.ndarray]:
    """n_repeat_words, and n_words, which comes with the same cut into words."""
    out = {k: np.zeros(len(texts), np.int64) for k in ("n_words", "n_repeat_words")}
    for begin, stop in groups(texts):
        words = split_words(texts[begin:stop], fold=False)
        out["n_words"][begin:stop] = np.diff(words.first)
        out["n_repeat_words"][begin:stop] = repeated_words(words)
    return out


def _bare(text: bytes) -> int:
    """Words without a letter."""
    return sum(1 for w in text.translate(_TO_PLAIN).split() if b"a" not in w)


_TO_PLAIN = bytes(i if i in (9, 10, 11, 12, 13, 32) else 97 if i >= 128 or chr(i).isalpha() else 46 for i in range(256))


def _stuttered(text: bytes) -> int:
    """Words that equal the word before."""
    words = text.split()
    return sum(map(eq, words, words[1:]))


def duplicate_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")] if b"\n" in text else []
    return len(lines) - len(set(lines))


def repeated_words(words, width: int = 8) -> np.ndarray:
    """Per text, the words in runs of ``width`` words that occur at least twice in the text."""
    codes, at = windows(words, width)
    covered = np.zeros(len(words.hashes) + 1, np.int64)
    if len(codes):
        text = words.owner[at]
        order = np.lexsort((codes, text))
        same = (codes[order][1:] == codes[order][:-1]) & (text[order][1:] == text[order][:-1])
        twice = np.zeros(len(codes), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        np.add.at(covered, at[twice], 1)
        np.add.at(covered, at[twice] + width, -1)
    return per_text(np.cumsum(covered)[:-1] > 0, words)


#: Measures by name; a function may give others that come with its own.
MEASURES = {name: _each(name, of) for name, of in {
    "n_words": lambda t: len(t.split()),
    "word_chars": lambda t: len(t.translate(None, _BLANKS + _LATER)),
    "n_symbols": lambda t: len(t) - len(t.translate(None, SYMBOLS)),
    "n_dup_lines": duplicate_lines,
    "n_lines": lambda t: t.count(b"\n") + 1,
    "upper": lambda t: len(t) - len(t.translate(None, _UPPER)),
    "letters": lambda t: len(t.translate(None, _NO_LETTER)),
    "wide": lambda t: 0 if t.isascii() else len(t) - len(t.translate(None, _WIDE)),
    "bare": _bare,
    "stuttered": _stuttered,
}.items()}
MEASURES["n_repeat_words"] = _repeats


def _few_words(m: Measured, r: np.ndarray) -> np.ndarray:
    return m("n_words", r) < 20


def _repeated(m: Measured, r: np.ndarray) -> np.ndarray:
    """Over 30 % of the words in repeated runs of eight."""
    return 100 * m("n_repeat_words", r) > 30 * m("n_words", r)


def _many_symbols(m: Measured, r: np.ndarray) -> np.ndarray:
    """Over one symbol in ten words."""
    return 10 * m("n_symbols", r) > m("n_words", r)


def _shouting(m: Measured, r: np.ndarray) -> np.ndarray:
    """Capitals of A-Z are over half of all letters, those of other scripts included."""
    return 2 * m("upper", r) > m("letters", r)


def _bare_words(m: Measured, r: np.ndarray) -> np.ndarray:
    """Over a fifth of the words have no letter."""
    return 5 * m("bare", r) > m("n_words", r)


def _odd_lengths(m: Measured, r: np.ndarray) -> np.ndarray:
    """Words of under 2 or over 15 characters on average, unless most characters are of U+0800 or beyond."""
    chars, n = m("word_chars", r), m("n_words", r)
    return ((2 * n > chars) | (chars > 15 * n)) & (2 * m("wide", r) <= chars)


def _same_lines(m: Measured, r: np.ndarray) -> np.ndarray:
    """Over half of the lines repeat an earlier one."""
    return 2 * m("n_dup_lines", r) > m("n_lines", r)


def _stutter(m: Measured, r: np.ndarray) -> np.ndarray:
    """Over 30 % of the words equal the word before."""
    return 10 * m("stuttered", r) > 3 * m("n_words", r)


#: The rules whose verdict ``judge`` reports apart.
BASE = [Rule("few_words", _few_words), Rule("repeated_words", _repeated)]
RULES = [*BASE, Rule("many_symbols", _many_symbols), Rule("shouting", _shouting), Rule("bare_words", _bare_words),
         Rule("odd_lengths", _odd_lengths), Rule("same_lines", _same_lines), Rule("stutter", _stutter)]
#: What ``judge`` reports of every text; the words are cut once, for the repeats.
COUNTS = ("n_repeat_words", "n_words", "word_chars", "n_symbols", "n_dup_lines")


def reported(texts: Measured) -> np.ndarray:
    """Take the reported counts of all texts; which of them fail a base rule."""
    rows = np.arange(len(texts))
    for name in COUNTS:
        texts(name, rows)
    return np.any([rule.rejects(texts, rows) for rule in BASE], axis=0)


def order_rules(patterns: dict[int, int], seconds: list[float]) -> list[int]:
    """Greedy order: next comes the rule that rejects most of what is left per second.

    ``patterns`` counts the sampled documents by the set of rules (as bits) that reject them; ``seconds`` is the
    time of each rule on the sample.
    """
    left, order = dict(patterns), []
    while len(order) < len(seconds):
        gain = lambda r: (sum(n for p, n in left.items() if p >> r & 1) / max(seconds[r], 1e-9), -r)
        best = max((r for r in range(len(seconds)) if r not in order), key=gain)
        order.append(best)
        left = {p: n for p, n in left.items() if not p >> best & 1}
    return order


def plan(docs: DataFrame, rules: list[Rule], text_col: str = "text", sample_docs: int = SAMPLE_DOCS,
         report: bool = False) -> list[int]:
    """Time and try every rule on about ``sample_docs`` documents; the driver gets a row per set of rejecting rules.

    With ``report`` the rules come after ``reported``: they are tried on what passes it, and what it has counted
    costs them nothing.
    """
    n = docs.count()
    if not n:
        return list(range(len(rules)))
    chosen = docs.select(F.col(text_col).cast("string").alias("text")).sample(min(1.0, sample_docs / n), seed=11)

    def run(parts):
        for part in parts:
            texts = Measured(texts_of(part.column(0)))
            rows = np.flatnonzero(~reported(texts)) if report else np.arange(len(texts))
            hits, costs = np.zeros(len(rows), np.int64), []
            for i, rule in enumerate(rules):
                fresh, begin = texts.copy(), time.perf_counter()
                hits |= rule.rejects(fresh, rows).astype(np.int64) << i
                costs.append(time.perf_counter() - begin)
            kinds, counts = np.unique(hits, return_counts=True)
            for k, c in zip(kinds.tolist(), counts.tolist()):
                yield pa.RecordBatch.from_pydict({"pattern": [k], "n": [c], "seconds": pa.array(
                    [costs], pa.list_(pa.float64()))})
                costs = [0.0] * len(rules)

    tried = chosen.mapInArrow(run, "pattern bigint, n bigint, seconds array<double>")
    rows = tried.groupBy("pattern").agg(F.sum("n").alias("n"), *[
        F.sum(F.get("seconds", F.lit(i))).alias(f"s{i}") for i in range(len(rules))]).collect()
    return order_rules({r["pattern"]: r["n"] for r in rows}, [sum(r[f"s{i}"] for r in rows) for i in range(len(rules))])


def first_rejections(texts: Measured | list[bytes], rules: list[Rule], order: list[int],
                     rows: np.ndarray | None = None) -> tuple[np.ndarray, int]:
    """The index of the rule that rejects each text (-1: none) of ``rows``, and how many rule evaluations that took."""
    texts = texts if isinstance(texts, Measured) else Measured(texts)
    rows = np.arange(len(texts)) if rows is None else rows
    verdict, alive, work = np.full(len(rows), -1, np.int64), np.arange(len(rows)), 0
    for r in order:
        if not len(alive):
            break
        work += len(alive)
        bad = rules[r].rejects(texts, rows[alive])
        verdict[alive[bad]] = r
        alive = alive[~bad]
    return verdict, work


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] = RULES,
          sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """One row per row of ``docs``: its id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rule.

    ``base_failed``: under 20 words, or over 30 % of the words in repeated runs of eight. ``kept`` is false for those;
    the others run through the cascade of the other rules, where a document leaves at the first rule that rejects
    it. Rules use the reported counts as they are, so each text is counted once. ``rule`` names the rejecting rule
    ("base": those before the cascade): a report of the work done, which follows the order found on the sample, unlike ``kept``.

    A null text is empty: no words, so it fails. Repeated rows and null ids are judged row by row; empty tables
    give no rows; other columns are ignored.
    """
    rules = [r for r in rules if r not in BASE]
    order = plan(docs, rules, text_col, sample_docs, report=True)
    kind = docs.schema[id_col].dataType.simpleString()
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(parts):
        for part in parts:
            texts = Measured(texts_of(part.column(1)))
            failed, every = reported(texts), np.arange(len(texts))
            rest = np.flatnonzero(~failed)
            verdict = np.full(len(texts), -1, np.int64)
            verdict[rest], _ = first_rejections(texts, rules, order, rest)
            names = ["base" if f else rules[v].name if v >= 0 else None for f, v in zip(failed, verdict)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *[pa.array(texts(c, every)) for c in counts], pa.array(failed), pa.array(~failed & (verdict < 0)),
                 pa.array(names, pa.string())], names=["id", *counts, "base_failed", "kept", "rule"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, f"id {kind}, {', '.join(c + ' bigint' for c in counts)}, base_failed boolean, kept boolean, rule string")


def keep_good(docs: DataFrame, text_col: str = "text", rules: list[Rule] = RULES,
              sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """The rows of ``docs``, all columns unchanged, that no rule rejects."""
    order = plan(docs, rules, text_col, sample_docs)
    at = docs.columns.index(text_col)

    def run(parts):
        for part in parts:
            verdict, _ = first_rejections(texts_of(part.column(at).cast(pa.string())), rules, order)
            yield part.filter(pa.array(verdict < 0))

    return docs.mapInArrow(run, docs.schema)
