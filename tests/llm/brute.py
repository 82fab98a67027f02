"""Plain versions of the operators, one text or pair at a time."""

import re

import xxhash

WORD = re.compile("[^\x20\x09-\x0d]+")


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words(text):
    return WORD.findall(ascii_lower(text or ""))


def fingerprint(text, shingle=4):
    w = words(text)
    if not w:
        return 0
    grams = [" ".join(w[i:i + shingle]) for i in range(max(1, len(w) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(n, linked):
    """The smallest index reachable from each of n, by a plain union."""
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def tokens(text):
    return re.findall(r"(?:[0-9a-z]|[^\x00-\x7f])+", ascii_lower(text or ""))


def overlap_items(text, items, window=13, equal=11, passage=5):
    """Ids of the items that share a window with the text at some alignment; the shortest are the text."""
    t, out = tokens(text), set()
    for item_id, item in items:
        s = tokens(item)
        if len(s) < passage:
            out |= {item_id} if s and s == t else set()
            continue
        width = min(window, len(s))
        need = equal if width == window else -(-4 * width // 5)
        for shift in range(-len(s) + width, len(t) - width + 1):
            low, high = max(0, shift), min(len(t), shift + len(s))
            same = [t[p] == s[p - shift] for p in range(low, high)]
            if any(sum(same[i:i + width]) >= need for i in range(len(same) - width + 1)):
                out.add(item_id)
                break
    return out


def common_passage(a, b, passage=50, shingle=5):
    """Whether two texts hold the same run of ``passage`` words."""
    a, b = words(a), words(b)
    runs = {tuple(a[i:i + passage]) for i in range(len(a) - passage + 1)}
    return any(tuple(b[i:i + passage]) in runs for i in range(len(b) - passage + 1))


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, d in enumerate(int(c) for c in reversed(digits)):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def private(text):
    only = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 12 <= len(only(m)) <= 19 and luhn(only(m))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(only(m)) <= 15]
    return sorted(out)
