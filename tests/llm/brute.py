"""Plain Python versions of the operators, from their rules; quadratic where that is clearest."""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from collections import Counter

import xxhash

WS = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LAST = (1 << 63) - 1


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def counts(text: str | None) -> tuple:
    own = words(text)
    lines = [line for line in (text or "").split("\n") if words(line)]
    windows = [tuple(own[i : i + 5]) for i in range(len(own) - 4)]
    times = Counter(windows)
    again = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(5)}
    failed = len(own) < 10 or 100 * len(again) > 20 * len(own)
    return (
        len(own), sum(map(len, own)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(again), failed,
    )


def simhash(text: str | None, k: int = 3) -> int:
    own = words((text or "").translate(LOWER))
    if not own:
        return 0
    shingles = [" ".join(own[i : i + k]) for i in range(max(1, len(own) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(rows: list[tuple[int | None, str | None]], radius: int = 2) -> list[tuple]:
    marks = [simhash(t) for _, t in rows]
    group = list(range(len(rows)))

    def root(i: int) -> int:
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (marks[i] ^ marks[j]).bit_count() <= radius:
                group[root(i)] = root(j)
    least: dict[int, list[int]] = {}
    for i, (doc, _) in enumerate(rows):
        least.setdefault(root(i), [])
        if doc is not None:
            least[root(i)].append(doc)
    return [(doc, f"{marks[i]:016x}", min(least[root(i)], default=None)) for i, (doc, _) in enumerate(rows)]


def line_key(line: str) -> str:
    return line.strip(WS).translate(LOWER)


def left_lines(rows: list[tuple[int | None, str | None]]) -> list[tuple]:
    holders: dict[str, set[int]] = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(line_key(line)) >= 10:
                holders.setdefault(line_key(line), set()).add(LAST if doc is None else doc)
    out = []
    for doc, text in rows:
        every = (text or "").split("\n")
        own = LAST if doc is None else doc
        kept = [line for line in every if not (line_key(line) in holders and min(holders[line_key(line)]) < own)]
        out.append((doc, len(every), len(every) - len(kept), "\n".join(kept)))
    return out


def left_words(rows: list[tuple[int | None, str | None]], length: int = 13) -> list[tuple]:
    first: dict[tuple, int] = {}
    for doc, text in rows:
        own = words(text)
        for i in range(len(own) - length + 1):
            key = tuple(own[i : i + length])
            first[key] = min(first.get(key, LAST), LAST if doc is None else doc)
    out = []
    for doc, text in rows:
        own = words(text)
        gone = set()
        for i in range(len(own) - length + 1):
            if first[tuple(own[i : i + length])] < (LAST if doc is None else doc):
                gone |= set(range(i, i + length))
        out.append((doc, len(own), len(gone), " ".join(w for i, w in enumerate(own) if i not in gone)))
    return out


def shingles(text: str | None) -> list[tuple]:
    own = re.findall(r"[^\W_]+", (text or "").lower())
    return [tuple(own[i : i + 5]) for i in range(len(own) - 4)]


def hits(docs: list[tuple], items: list[tuple], least: float = 0.8) -> dict[tuple, float]:
    """Best similarity of each document and item over all windows as long as the item, also cut by the ends."""
    out: dict[tuple, float] = {}
    for item, item_text in items:
        want = Counter(shingles(item_text))
        n = sum(want.values())
        for doc, text in docs:
            own = shingles(text)
            if not n or not set(own) & set(want):
                continue
            for start in range(1 - n, len(own)):
                have = Counter(own[max(0, start) : start + n])
                both = sum((have & want).values())
                value = both / (sum(have.values()) + n - both)
                if value >= least:
                    out[doc, item] = max(out.get((doc, item), 0), round(value, 6))
    return out


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def similar(rows: list[tuple[int | None, str | None]], size: int = 4, percent: int = 85) -> list[tuple]:
    """(key, set size, least key reached) of every row, all pairs compared."""
    sets = []
    for _, text in rows:
        own = words((text or "").translate(LOWER))
        runs = zip(*(own[k:] for k in range(size)), strict=False) if len(own) >= size else [tuple(own)] * bool(own)
        sets.append(frozenset(runs))
    group = list(range(len(rows)))

    def root(i: int) -> int:
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                group[root(i)] = root(j)
    least: dict[int, list[int]] = {}
    for i, (key, _) in enumerate(rows):
        least.setdefault(root(i), []).extend([key] if key is not None else [])
    return [(key, len(sets[i]), min(least[root(i)], default=None) if sets[i] else key) for i, (key, _) in enumerate(rows)]


def hard_negatives(rows: list[tuple], every: int = 100, scale: int = 256, positives: int = 5, negatives: int = 10) -> list[tuple]:
    """All pairs of (id, label, vector) rows, sorted for each anchor; whole numbers of any size."""
    usable = []
    for key, label, vector in rows:
        if key is not None and label is not None and vector is not None and all(x is not None and math.isfinite(x) for x in vector):
            usable.append((key, label, [math.floor(scale * x) for x in vector]))
    best: dict[int, tuple] = {}
    for key, label, vector in usable:
        best[key] = min(best.get(key, (label, vector)), (label, vector))
    out = []
    for anchor in sorted(k for k in best if k % every == 0):
        kind, own = best[anchor]
        scored = sorted((-sum(x * y for x, y in zip(own, v, strict=False)), k, c) for k, (c, v) in best.items() if k != anchor)
        for s, positive, _ in [r for r in scored if r[2] == kind][:positives]:
            inside = [(n, k) for n, k, c in scored if c != kind and 30 * -s <= 100 * -n <= 90 * -s]
            out += [(anchor, positive, i + 1, k, -s, -n) for i, (n, k) in enumerate(inside[:negatives])]
    return out


def alignment(rows: list[tuple[int | None, str | None]], first: str, second: str) -> list[tuple]:
    """Whole texts through both libraries, groups by sets of offsets, counts in one dictionary."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(first), SentencePieceProcessor(model_file=second)
    a.encode_special_tokens = True
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [x for x in range(256) if x not in printable]
    spelled = {chr(x): x for x in printable} | {chr(256 + k): x for k, x in enumerate(others)}

    def b_bytes(i: int) -> bytes:
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", piece) else piece.replace("▁", " ").encode()

    found = []
    for key, text in rows:
        groups, links = [], []
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        parts_a = [bytes(spelled[c] for c in a.id_to_token(i)) for i in ids_a]
        parts_b = [b_bytes(i) for i in ids_b]
        if not text or not b"".join(parts_a) == b"".join(parts_b) == (" " + text).encode():
            found.append((key, [], [], groups, links))
            continue
        ends_a, ends_b = (list(itertools.accumulate(map(len, p))) for p in (parts_a, parts_b))
        p = q = 0
        for end in sorted(set(ends_a) & set(ends_b)):
            x, y = ends_a.index(end) + 1, ends_b.index(end) + 1
            groups.append(",".join(map(str, ids_a[p:x])) + "|" + ",".join(map(str, ids_b[q:y])))
            links.append((ids_a[x - 1], ids_b[y - 1]))
            p, q = x, y
        found.append((key, ids_a, ids_b, groups, links))
    times = Counter(link for *_, links in found for link in links)
    best: dict[int, int] = {}
    for (_, y), n in times.items():
        best[y] = max(best.get(y, 0), n)
    return [
        (key, len(x), len(y), len(g), len(links), sum(times[k] == best[k[1]] for k in links), sum(times[k] for k in links),
         sha(";".join(g)) if g else "")
        for key, x, y, g, links in found
    ]
