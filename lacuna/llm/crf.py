"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.text import SPACE, U64, encode, groups, mix, powers, texts_of

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *KINDS)
#: The labelled table has rows from about so many documents of the corpus, and so many written ones.
TRAIN_DOCS, TRAIN_MADE = 2000, 600

_DOMAIN = re.compile(rb"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = re.compile(rb"[A-Za-z0-9._%+-]+")
# A start within a run of digits has the same continuation as the run's first digit, so only that one is tried.
_IP = re.compile(rb"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(rb"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGITS = bytes(b for b in range(256) if not 48 <= b <= 57)


def luhn(digits: bytes) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = (d - 48) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _small_parts(match: bytes) -> bool:
    return all(len(p) <= 3 and int(p) <= 255 for p in (p.lstrip(b"0") or b"0" for p in match.split(b".")))


def _card(match: bytes) -> bool:
    digits = match.translate(None, _NOT_DIGITS)
    return 12 <= len(digits) <= 19 and luhn(digits)


def _digits(match: bytes) -> int:
    return len(match.translate(None, _NOT_DIGITS))


def _emails(text: bytes) -> list[tuple[int, int]]:
    """Leftmost matches: the local part of an "@" is the longest run before it that no match has taken."""
    out, end, at = [], 0, text.find(b"@")
    while at >= 0:
        if (domain := _DOMAIN.match(text, at + 1)) and at > end and _LOCAL.match(text, at - 1):
            begin = at
            while begin > end and _LOCAL.match(text, begin - 1, begin):
                begin -= 1
            out.append((begin, domain.end()))
            end = domain.end()
        at = text.find(b"@", max(at + 1, end))
    return out


def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes, sorted: leftmost non-overlapping matches of each kind that pass its check."""
    out = [(a, 0, b) for a, b in _emails(text)] if b"@" in text else []
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if _small_parts(m[0])]
    out += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if _card(m[0])]
    if b"+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= _digits(m[0]) <= 15]
    return sorted(out)


def plausible(kind: int, found: bytes) -> bool:
    """What a decoded span must hold to be reported as its kind."""
    if kind == 0:
        return (b"@" in found or b"(at)" in found or b"[at]" in found) and len(found) >= 6
    if kind == 1:
        return bool(re.fullmatch(rb"[0-9]+(?:[.:-][0-9]+){3}", found)) and _small_parts(re.sub(rb"[:-]", b".", found))
    if kind == 2:
        return _card(found) and not re.search(rb"[A-Za-z]", found)
    return 9 <= _digits(found) <= 15 and bool(re.fullmatch(rb"[(]?[0-9][0-9()./ -]*[0-9]", found)) and bool(
        re.search(rb"[0-9)][()./ -]+[0-9]", found))


# ---- word shapes

_CLASS = np.arange(256, dtype=np.int64)
_CLASS[[*range(97, 123), *range(128, 256)]] = ord("x")
_CLASS[65:91] = ord("X")
_CLASS[48:58] = ord("0")
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_TRIM_END = np.zeros(256, bool)
_TRIM_END[list(b".,;:!?\"'")] = True
_LENGTHS = np.array([4, 5, 9, 12, 20])  # digit runs: 1, 2, 3, 4, 5-8, 9-11, 12-19, 20 or more


@dataclass
class Tokens:
    """White-space words without closing punctuation: byte ranges, text, shape hash, flag number."""

    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray
    shape: np.ndarray
    flags: np.ndarray
    base: np.ndarray


N_FLAGS = 60


def tokens(texts: list[bytes]) -> Tokens:
    """Tokens of some texts and their word shapes.

    A shape holds one mark per run of letters of one case, one for the length class of a run of digits, and every
    punctuation mark as it is.
    """
    buffer = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    base = np.cumsum(sizes + 1) - sizes - 1
    inside = np.r_[0, (~SPACE[buffer]).astype(np.int8), 0]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    for _ in range(3):
        ends = ends - (_TRIM_END[buffer[ends - 1]] & (ends - starts > 1))
        starts = starts + (((buffer[starts] == 34) | (buffer[starts] == 39)) & (ends - starts > 1))
    if not len(starts):
        none = np.zeros(0, np.int64)
        return Tokens(none, none, none, np.zeros(0, U64), none, base)
    kind = _CLASS[buffer]
    change = np.ones(len(kind), bool)
    change[1:] = (kind[1:] != kind[:-1]) | ((kind[1:] != 120) & (kind[1:] != 88) & (kind[1:] != 48))
    change[starts] = True
    change[ends] = True
    runs = np.flatnonzero(change)
    first = np.searchsorted(runs, starts)
    mark = kind[runs]
    length = np.diff(np.r_[runs, len(kind)])
    digit = mark == 48
    mark = np.where(digit, 300 + np.where(length < 4, length, 3 + np.searchsorted(_LENGTHS, length, "right")), mark)
    last = np.searchsorted(runs, ends)
    owner = np.repeat(np.arange(len(starts)), last - first)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(last - first) - (last - first), last - first)
    picked = mark[np.repeat(first, last - first) + within].astype(U64)
    total = np.add.reduceat(mix(picked + U64(1)) * powers(int(within.max()) + 1)[within], np.cumsum(last - first) - (last - first))
    count = lambda flag: (c := np.r_[0, np.cumsum(flag, dtype=np.int64)])[ends] - c[starts]
    digits = np.searchsorted([1, 5, 9, 12], count(kind == 48), "right")
    head = buffer[starts]
    lead = np.where(head == 43, 1, np.where(head == 40, 2, 0))
    flags = (((count(buffer == 64) > 0) * 2 + (count(buffer == 46) > 0)) * 5 + digits) * 3 + lead
    return Tokens(starts, ends, np.searchsorted(base, starts, "right") - 1, mix(total), flags, base)


# ---- the model

@dataclass
class Model:
    """Weights per label of the shapes and flags of a token and its two neighbours, and of label pairs.

    ``shapes`` are the known shape hashes in order; number 0 is any other shape, 1 the edge of a text.
    """

    shapes: np.ndarray
    by_shape: np.ndarray
    by_flag: np.ndarray
    pairs: np.ndarray

    def numbers(self, shape: np.ndarray) -> np.ndarray:
        if not len(self.shapes):
            return np.zeros(len(shape), np.int64)
        at = np.minimum(np.searchsorted(self.shapes, shape), len(self.shapes) - 1)
        return np.where(self.shapes[at] == shape, at + 2, 0)

    def scores(self, shape: np.ndarray, flags: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Score of each label for each token; neighbours in other texts are edges."""
        n = len(shape)
        first = np.r_[True, text[1:] != text[:-1]] if n else np.zeros(0, bool)
        last = np.r_[first[1:], True] if n else first
        out = self.by_shape[1][shape] + self.by_flag[1][flags]
        for k, edge, step in ((0, first, 1), (2, last, -1)):
            s, f = np.roll(shape, step), np.roll(flags, step)
            s[edge], f[edge] = 1, N_FLAGS
            out += self.by_shape[k][s]
            out += self.by_flag[k][f]
        return out

    def decode(self, scores: np.ndarray, text: np.ndarray) -> np.ndarray:
        """The best label sequence of each text (Viterbi); outside a text stands label O.

        A token whose score for O is ahead of all others by more than any pair weights can make up for is O on
        every best path, and the path falls apart there. So only the runs of other tokens are decoded, all side
        by side.
        """
        n, labels = len(scores), np.zeros(len(scores), np.int64)
        if not n:
            return labels
        t = self.pairs
        gain = max(t[a, y] + t[y, b] - t[a, 0] - t[0, b] for a in range(len(t)) for b in range(len(t))
                   for y in range(1, len(t)))
        open_ = np.flatnonzero(scores[:, 0] - scores[:, 1:].max(axis=1) <= gain)
        if not len(open_):
            return labels
        heads = np.flatnonzero(np.r_[True, (open_[1:] != open_[:-1] + 1) | (text[open_[1:]] != text[open_[:-1]])])
        sizes = np.diff(np.r_[heads, len(open_)])
        order = np.argsort(-sizes, kind="stable")
        begin, sizes = open_[heads[order]], sizes[order]
        score = t[0] + scores[begin]
        back, done = [], []
        for step in range(1, int(sizes[0]) + 1):
            live = int(np.searchsorted(-sizes, -step, "left"))  # runs longer than step
            done.append((live, len(score)))
            final = (score[live:] + t[:, 0]).argmax(axis=1)
            labels[begin[live:len(score)] + step - 1] = final
            if live:
                paths = score[:live, :, None] + t
                back.append(paths.argmax(axis=1))
                score = paths.max(axis=1) + scores[begin[:live] + step]
        for step in range(len(back), 0, -1):
            rows = np.arange(len(back[step - 1]))
            at = begin[:len(rows)] + step
            labels[at - 1] = back[step - 1][rows, labels[at]]
        return labels


def train(rows: list[tuple[str, list[tuple[int, int, int]]]], rounds: int = 120, rate: float = 0.15,
          decay: float = 1e-3) -> Model:
    """Fit the weights by maximum likelihood on a small table of (text, [(start, kind, end)]), spans in bytes.

    Each text is one sequence. Full gradients come from the forward and backward sums of all sequences side by side; the
    steps are Adam's. Nothing is random. An empty table gives weights of zero.
    """
    texts = [encode(t) for t, _ in rows]
    tok = tokens(texts)
    gold = np.zeros(len(tok.starts), np.int64)
    at = np.searchsorted(tok.text, np.arange(len(texts) + 1))
    for i, (_, spans) in enumerate(rows):
        for start, kind, end in spans:
            for k in range(at[i], at[i + 1]):
                if tok.starts[k] - tok.base[i] < end and tok.ends[k] - tok.base[i] > start:
                    gold[k] = kind + 1
    shapes = np.unique(tok.shape)
    n_labels = len(LABELS)
    model = Model(shapes, np.zeros((3, len(shapes) + 2, n_labels)), np.zeros((3, N_FLAGS + 1, n_labels)),
                  np.zeros((n_labels, n_labels)))
    if not len(gold):
        return model
    shape = model.numbers(tok.shape)
    sizes = np.diff(at)
    rows_, longest = np.flatnonzero(sizes), int(sizes.max())
    grid = np.full((len(rows_), longest), -1)
    for r, i in enumerate(rows_):
        grid[r, :sizes[i]] = np.arange(at[i], at[i + 1])
    on = grid >= 0
    first = np.r_[True, tok.text[1:] != tok.text[:-1]]
    last = np.r_[first[1:], True]
    near = []
    for step, edge in ((1, first), (0, None), (-1, last)):
        s, f = np.roll(shape, step), np.roll(tok.flags, step)
        if edge is not None:
            s[edge], f[edge] = 1, N_FLAGS
        near.append((s, f))
    target = np.eye(n_labels)[gold]
    pair_gold = np.zeros_like(model.pairs)
    np.add.at(pair_gold, (np.where(first, 0, np.r_[0, gold[:-1]]), gold), 1)
    np.add.at(pair_gold, (gold[last], 0), 1)
    weights = [model.by_shape, model.by_flag, model.pairs]
    moment = [[np.zeros_like(w), np.zeros_like(w)] for w in weights]
    log_sum = lambda x, axis: (m := x.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis=axis))
    for round_ in range(1, rounds + 1):
        flat = model.scores(shape, tok.flags, tok.text)
        e = np.where(on[..., None], flat[np.maximum(grid, 0)], 0.0)
        t = model.pairs
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[:, 0] = t[0] + e[:, 0]
        for k in range(1, longest):
            step = log_sum(alpha[:, k - 1, :, None] + t, 1) + e[:, k]
            alpha[:, k] = np.where(on[:, k, None], step, alpha[:, k - 1])
        total = log_sum(alpha[:, -1] + t[:, 0], 1)
        beta[:, -1] = t[:, 0]
        for k in range(longest - 2, -1, -1):
            step = log_sum(t + (e[:, k + 1] + beta[:, k + 1])[:, None, :], 2)
            beta[:, k] = np.where(on[:, k + 1, None], step, t[:, 0])
        node = np.exp(alpha + beta - total[:, None, None])[on]
        index = grid[on]
        miss = np.zeros_like(target)
        miss[index] = target[index] - node
        expected = np.zeros_like(t)
        expected[0] += np.exp(alpha + beta - total[:, None, None])[:, 0].sum(axis=0)
        for k in range(longest - 1):
            both = np.exp(alpha[:, k, :, None] + t + (e[:, k + 1] + beta[:, k + 1])[:, None, :] - total[:, None, None])
            expected += both[on[:, k + 1]].sum(axis=0)
        ends_ = np.exp(alpha[:, -1] + t[:, 0] - total[:, None]).sum(axis=0)
        expected[:, 0] += ends_
        grads = [np.zeros_like(w) for w in weights]
        for k, (s, f) in enumerate(near):
            np.add.at(grads[0][k], s, miss)
            np.add.at(grads[1][k], f, miss)
        grads[2] = pair_gold - expected
        for w, g, m in zip(weights, grads, moment):
            g = g / len(rows_) - decay * w
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.99 * m[1] + 0.01 * g * g
            w += rate * (m[0] / (1 - 0.9 ** round_)) / (np.sqrt(m[1] / (1 - 0.99 ** round_)) + 1e-8)
    return Model(model.shapes, model.by_shape.astype(np.float32), model.by_flag.astype(np.float32),
                 model.pairs.astype(np.float32))


# ---- the labelled table

def _with_check_digit(digits: str) -> str:
    return next(digits + d for d in "0123456789" if luhn((digits + d).encode()))


def made_rows(n: int = TRAIN_MADE, seed: int = 5) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Written examples, labelled as they are made: each kind in several forms, numbers that are none, plain text."""
    rng = np.random.default_rng(seed)
    digits = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    word = lambda: "".join(chr(97 + x) for x in rng.integers(0, 26, rng.integers(2, 9)))
    area = lambda: str(rng.integers(200, 990))

    def form(kind):
        if kind == 0:
            host = ".".join([word(), *([word()] if rng.random() < 0.5 else []), str(rng.choice(["com", "org", "net"]))])
            at = str(rng.choice(["@", "@", "@", "(at)", "[at]"]))
            return f"{word()}{str(rng.choice(['', '.' + word(), '.' + digits(2)]))}{at}{host}"
        if kind == 1:
            return ".".join(str(x) for x in rng.integers(0, 256, 4))
        if kind == 2:
            full = _with_check_digit(str(rng.integers(3, 7)) + digits(14))
            gap = str(rng.choice(["", "", " ", "-", "."]))
            return gap.join(full[i:i + 4] for i in range(0, 16, 4))
        a, b, c = area(), area(), digits(4)
        return str(rng.choice([f"+1 ({a}) {b}-{c}", f"+{digits(2)} {digits(3)} {digits(7)}", f"({a}) {b}-{c}",
                               f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"1-{a}-{b}-{c}", f"+1-{a}-{b}-{c}"]))

    def other():
        return str(rng.choice([digits(1), digits(2), digits(4), digits(6), digits(10), digits(16), f"{digits(1)}.{digits(2)}",
                               f"{digits(4)}-{digits(2)}-{digits(2)}", f"{digits(2)}:{digits(2)}", f"v{digits(1)}.{digits(1)}.{digits(1)}",
                               word().upper() + "-" + digits(4), f"({digits(4)})", f"{digits(3)}-{digits(3)}", f"${digits(3)}",
                               f"{digits(2)}/{digits(2)}/{digits(4)}", f"@{word()}", f"{word()}.{word()}", f"({word()})", f"+{digits(1)}",
                               "".join(str(x) for x in rng.choice(list("0123456789abcdef"), 24))]))

    rows = []
    for i in range(n):
        parts, spans, size = [], [], 0
        slot = int(rng.integers(0, 8))
        for k in range(8):
            if k == slot and i % 3 < 2:
                kind = i % 4
                piece = form(kind)
                spans.append((size, kind, size + len(piece)))
            elif k == slot or rng.random() < 0.1:
                piece = other()
            else:
                piece = word()
                piece = piece.capitalize() if rng.random() < 0.2 else piece
            piece += str(rng.choice(["", "", "", ".", ","]))
            parts.append(piece)
            size += len(piece) + 1
        rows.append((" ".join(parts), spans))
    return rows


def labelled_rows(docs: DataFrame, text_col: str = "text", train_docs: int = TRAIN_DOCS,
                  reach: int = 60) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Rows from a bounded sample of about ``train_docs`` documents: what surrounds up to four pattern matches of each,
    labelled by them, or else the beginning of the text. The rows, at most four of some 150 characters per document, come to the driver."""
    n = docs.count()
    if not n:
        return []

    def run(parts):
        for part in parts:
            texts, spans = [], []
            for text in texts_of(part.column(0)):
                found = base_spans(text)
                for s, _, e in found[:4] or [(0, 0, 0)]:
                    if e - s > 200:
                        continue
                    a, b = max(0, s - reach), min(len(text), e + reach)
                    while 0 < a and not SPACE[text[a - 1]]:
                        a += 1
                        if a >= s:
                            a = s
                            break
                    while b < len(text) and b > e and not SPACE[text[b]]:
                        b -= 1
                    body = text[a:b].decode("utf-8", "ignore")
                    if body.encode() == text[a:b]:
                        texts.append(body)
                        spans.append([{"s": x - a, "k": k, "e": y - a} for x, k, y in found if x >= a and y <= b])
            kind = pa.list_(pa.struct([("s", pa.int64()), ("k", pa.int64()), ("e", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(spans, kind)], names=["text", "spans"])

    sample = docs.select(F.col(text_col).cast("string").alias("text")).sample(min(1.0, train_docs / n), seed=3)
    rows = sample.mapInArrow(run, "text string, spans array<struct<s:bigint,k:bigint,e:bigint>>").collect()
    return [(r["text"], [(s["s"], s["k"], s["e"]) for s in r["spans"]]) for r in rows]


# ---- finding

def find(texts: list[bytes], model: Model) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """For each text: pattern spans and what the model adds, as (start, kind, end) in code points.

    A span of the model is a run of words with one label that holds what its kind needs and touches no other span.
    """
    out = []
    for begin, stop in groups(texts):
        some = texts[begin:stop]
        tok = tokens(some)
        labels = model.decode(model.scores(model.numbers(tok.shape), tok.flags, tok.text), tok.text)
        marked = np.flatnonzero(labels)
        by_text: dict[int, list[tuple[int, int, int]]] = {}
        if len(marked):
            breaks = (marked[1:] != marked[:-1] + 1) | (labels[marked[1:]] != labels[marked[:-1]]) | (
                tok.text[marked[1:]] != tok.text[marked[:-1]])
            heads = np.flatnonzero(np.r_[True, breaks])
            tails = np.r_[heads[1:], len(marked)] - 1
            for a, b in zip(marked[heads].tolist(), marked[tails].tolist()):
                d = int(tok.text[a])
                by_text.setdefault(d, []).append((int(tok.starts[a] - tok.base[d]), int(labels[a]) - 1,
                                                  int(tok.ends[b] - tok.base[d])))
        for d, text in enumerate(some):
            base = base_spans(text)
            taken = sorted((s, e) for s, _, e in base)
            added = []
            for s, k, e in by_text.get(d, []):
                at = int(np.searchsorted([x[0] for x in taken], e)) if taken else 0
                if not (at and max(x[1] for x in taken[:at]) > s) and plausible(k, text[s:e]):
                    added.append((s, k, e))
            if (base or added) and not text.isascii():
                raw = np.frombuffer(text, np.uint8)
                points = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]
                base, added = ([(int(points[s]), k, int(points[e])) for s, k, e in x] for x in (base, added))
            out.append((base, added))
    return out


def spans(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, base and added, arrays of (kind, start, end) in code points, sorted.

    ``base`` are the matches of the fixed patterns, ``added`` those of the model; they do not touch. The model is
    sent to each executor once; its size is that of the labelled table.

    Null texts are empty and have no spans; repeated rows, null ids and empty tables need no care. Long texts are cut
    into words whole, one at a time.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast(model)
    item = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(parts):
        for part in parts:
            found = find(texts_of(part.column(1)), held.value)
            as_rows = lambda k: pa.array([[{"kind": KINDS[x[1]], "start": x[0], "end": x[2]} for x in f[k]]
                                          for f in found], item)
            yield pa.RecordBatch.from_arrays([part.column(0), as_rows(0), as_rows(1)], names=["id", "base", "added"])

    shape = "array<struct<kind:string,start:bigint,end:bigint>>"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, f"id {kind}, base {shape}, added {shape}")


def fit(docs: DataFrame, text_col: str = "text", train_docs: int = TRAIN_DOCS) -> Model:
    """A model trained on the labelled rows of ``docs`` and the written ones."""
    return train(made_rows() + labelled_rows(docs, text_col, train_docs))
