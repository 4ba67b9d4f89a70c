"""Two tokenizers' ids of the same texts, aligned at the byte offsets where tokens of both end.

Both vocabularies part at a single space between visible characters, so what lies between two such spaces is aligned
by itself, once for each distinct spelling, and a text is the sequence of its pieces. A very long text is cut into byte ranges that are
different tasks' work. Where a range ends for one tokenizer it may go on for the other; so a range gives a fragment: an
open prefix up to the first offset where both end, closed groups, and an open suffix. Fragments compose: the
open ends that meet are aligned anew, which closes the groups in between. The operation is associative, so the
fragments of a text are folded by a tree of shuffles, a few neighbours to a task and level.
"""

from __future__ import annotations

import hashlib
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.store import shared_batches, written
from granary.llm.tokens import bounded

#: Pieces remembered by a worker before it starts anew, and the ids of their groups.
REMEMBERED = 500_000
LINKS = 8_000_000
#: Pieces that are encoded in one go.
BLOCK = 1000
#: Bytes of text, or of links, looked at in one go.
AT_ONCE = 4_000_000
#: Bytes of a text that are one task's work; shorter texts are aligned where they are read.
RANGE = 1 << 18
#: Fragments composed by a task in a level of the tree.
FAN = 16
#: Id pairs whose counts a task holds at once: 34 MB.
PAIRS = 1 << 21
SPACE = "▁"
#: A space between visible characters.
APART = re.compile(r"(?<=\S) (?=\S)")
#: Stands before a text that may not get a space; it is a byte of its own in any vocabulary with bytes as a last resort.
MARK = "\n"


class Tokenizers:
    """Ids and bytes of both vocabularies, and where texts can be cut for each."""

    def __init__(self, first: str, second: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.a = Tokenizer.from_file(first)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        spelled = {c: b for b, c in zip(_byte_order(), _byte_letters(ByteLevel), strict=True)}
        self.a_bytes = {i: bytes(spelled[c] for c in t) if all(c in spelled for c in t) else t.encode() for t, i in self.a.get_vocab().items()}
        self.b = SentencePieceProcessor(model_file=second)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)
        ]
        plain = [p for i, p in enumerate(pieces) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]
        self.a_sizes = np.zeros(max(self.a_bytes) + 1, np.int64)
        for i, token in self.a_bytes.items():
            self.a_sizes[i] = len(token)
        self.b_sizes = np.array([len(p) for p in self.b_bytes], np.int64)
        #: each id as it reads inside and at the end of its side of a group
        self.spelled = [f"{i}{end}" for ends, n in ((",|", len(self.a_sizes)), (",;", len(self.b_sizes))) for i in range(n) for end in ends]
        #: characters that stand side by side in some piece: only between these can a piece lie across a cut
        self.inside = {p[i : i + 2] for p in plain for i in range(len(p) - 1)}
        self.parts_at_spaces = not any(y == SPACE != x for x, y in self.inside)

    def encode_a(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_b(self, texts: list[str]) -> list[list[int]]:
        """Of texts that are to begin with a space, without it; any other is given with MARK in front of it."""
        return self.b.encode(texts)

    def a_part(self, text: str) -> list[int]:
        return self.encode_a([text])[0]

    def b_part(self, text: str) -> list[int] | None:
        """Ids of a part of a text that begins at a cut; None if the vocabulary can't be kept from adding a space."""
        if text.startswith(" ") and len(text) > 1:
            return self.encode_b([text[1:]])[0]
        ids = self.encode_b([MARK + text])[0]
        lead, k = (" " + MARK).encode(), 0
        while lead and k < len(ids) and lead.startswith(self.b_bytes[ids[k]]):
            lead = lead[len(self.b_bytes[ids[k]]) :]
            k += 1
        return None if lead else ids[k:]

    def cut_a(self, text: str, at: int) -> int:
        """The next place from `at` where the first vocabulary always parts; the end if there is none."""
        for i in range(max(1, at), len(text)):
            x, y = text[i - 1], text[i]
            if y == " " and not x.isspace() and i + 1 < len(text) and not text[i + 1].isspace():
                return i
            if x.isalpha() and _mark(y) or _mark(x) and x != "'" and y.isalpha():
                return i
        return len(text)

    def cut_b(self, text: str, at: int) -> int:
        """The same for the second: no piece has these two characters side by side."""
        for i in range(max(1, at), len(text)):
            x, y = (SPACE if c == " " else c for c in text[i - 1 : i + 1])
            if x + y not in self.inside:
                return i
        return len(text)


def _byte_order() -> list[int]:
    """The bytes in the order in which a byte-level vocabulary spells them: the printable ones as themselves, then the others."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return own + [b for b in range(256) if b not in own]


def _byte_letters(byte_level) -> list[str]:
    own = _byte_order()
    printable = 256 - 68
    letters = [chr(b) for b in own[:printable]] + [chr(256 + k) for k in range(68)]
    assert set(letters) == set(byte_level.alphabet())
    return letters


def _mark(c: str) -> bool:
    """A character that is no letter, number or white space, and not one that joins another."""
    return c.isprintable() and not c.isalnum() and not c.isspace() and c.isascii() or c in "、。「」！？，："


@dataclass
class Tokens:
    """Tokens of both vocabularies with the byte offsets where they end."""

    a: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    a_ends: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    b: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    b_ends: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))

    def __add__(self, other: Tokens) -> Tokens:
        return Tokens(*(np.concatenate([getattr(self, f), getattr(other, f)]) for f in self.__dataclass_fields__))

    def __len__(self) -> int:
        return len(self.a) + len(self.b)

    def upto(self, offset: int) -> tuple[Tokens, Tokens]:
        """What ends at the offset or before it, and the rest."""
        i, j = np.searchsorted(self.a_ends, offset, "right"), np.searchsorted(self.b_ends, offset, "right")
        return Tokens(self.a[:i], self.a_ends[:i], self.b[:j], self.b_ends[:j]), Tokens(self.a[i:], self.a_ends[i:], self.b[j:], self.b_ends[j:])


@dataclass
class Closed:
    """Groups whose both ends are known: how they read, and the linked ids, the first vocabulary's in the upper half."""

    text: str = ""
    links: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))

    def __add__(self, other: Closed) -> Closed:
        text = f"{self.text};{other.text}" if self.text and other.text else self.text or other.text
        return Closed(text, np.concatenate([self.links, other.links]))


def grouped(tokens: Tokens) -> Closed:
    """The groups of tokens that begin and end where both vocabularies do. Of each group the last two tokens end together."""
    ends = np.intersect1d(tokens.a_ends, tokens.b_ends)
    i, j = np.searchsorted(tokens.a_ends, ends, "right"), np.searchsorted(tokens.b_ends, ends, "right")
    a, b = list(map(str, tokens.a.tolist())), list(map(str, tokens.b.tolist()))
    parts, p, q = [], 0, 0
    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        parts.append(",".join(a[p:x]) + "|" + ",".join(b[q:y]))
        p, q = x, y
    return Closed(";".join(parts), tokens.a[i - 1] << 32 | tokens.b[j - 1])


@dataclass
class Fragment:
    """A byte range of a text: tokens before the first common end and with it, groups after that, tokens after the last
    one. Without a common end (`met` false) all its tokens are the prefix."""

    prefix: Tokens
    closed: Closed
    suffix: Tokens
    met: bool

    @classmethod
    def of(cls, tokens: Tokens) -> Fragment:
        ends = np.intersect1d(tokens.a_ends, tokens.b_ends)
        if not len(ends):
            return cls(tokens, Closed(), Tokens(), False)
        prefix, rest = tokens.upto(ends[0])
        inner, suffix = rest.upto(ends[-1])
        return cls(prefix, grouped(inner), suffix, True)

    def __add__(self, other: Fragment) -> Fragment:
        """This range and the one behind it. What is open where they meet is aligned anew: a token of one vocabulary may end
        in this range where the other's, cut elsewhere, ends in the next."""
        middle = Fragment.of((self.suffix if self.met else self.prefix) + other.prefix)
        if not middle.met:
            if not self.met:
                return replace(middle, suffix=Tokens())
            return replace(self, suffix=middle.prefix)
        closed = (self.closed + grouped(middle.prefix) if self.met else Closed()) + middle.closed + other.closed
        return Fragment(
            self.prefix if self.met else middle.prefix, closed, other.suffix if other.met else middle.suffix, True
        )

    def whole(self) -> Closed | None:
        """The groups, if the range is a whole text; None if its last tokens do not end together."""
        if len(self.suffix) or not self.met:
            return None
        return grouped(self.prefix) + self.closed


def tokenizers(first: str, second: str) -> Tokenizers:
    """A worker's, kept between tasks."""
    kept = vars(sys).setdefault("_granary_tokenizers", {})
    if (first, second) not in kept:
        kept[first, second] = Tokenizers(first, second)
    return kept[first, second]


class Pieces:
    """The alignment of every distinct piece met: space and spelling."""

    def __init__(self, own: Tokenizers):
        self.own = own
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.texts: list[str] = []
        self.counts = np.empty((0, 3), np.int64)  # tokens of each, links; -1 links: the bytes differ
        self.links = np.empty(0, np.int64)
        self.starts = np.empty(0, np.int64)

    def full(self) -> bool:
        return len(self.known) > REMEMBERED or len(self.links) > LINKS

    def of(self, texts: list[str | None]) -> list[np.ndarray]:
        """The numbers of each text's pieces in order; none for null and empty texts."""
        cut = [self._cut(t) if t else [] for t in texts]
        self._learn(list(dict.fromkeys(p for own in cut for p in own if p not in self.known)))
        return [np.fromiter(map(self.known.__getitem__, own), np.int64, len(own)) for own in cut]

    def links_of(self, numbers: np.ndarray) -> np.ndarray:
        """The links of pieces, given by number, after one another."""
        many = np.maximum(self.counts[numbers, 2], 0)
        return self.links[np.repeat(self.starts[numbers] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))]

    def _cut(self, text: str) -> list[str]:
        if not self.own.parts_at_spaces:
            return [text]
        own = text.split(" ")
        if any(not p or p[0].isspace() or p[-1].isspace() for p in set(own)):
            return APART.split(text)
        return own

    def _learn(self, new: list[str]) -> None:
        clean = [p for p in new if p and not p[0].isspace() and not p[-1].isspace()]
        known = [self._alone([p for p in new if not p or p[0].isspace() or p[-1].isspace()])]
        for at in range(0, len(clean) if self.own.parts_at_spaces else 0, BLOCK):
            block = clean[at : at + BLOCK]
            known.append(self._together(block) or self._alone(block))
        if not self.own.parts_at_spaces:
            known.append(self._alone(clean))
        for spelled, texts, counts, links in known:
            self.known.update(zip(spelled, range(len(self.texts), len(self.texts) + len(spelled)), strict=True))
            self.texts += texts
            sizes = np.maximum(counts[:, 2], 0)
            self.starts = np.concatenate([self.starts, len(self.links) + np.cumsum(sizes) - sizes])
            self.counts = np.concatenate([self.counts, counts])
            self.links = np.concatenate([self.links, links])

    def _alone(self, block: list[str]) -> tuple[list[str], list[str], np.ndarray, np.ndarray]:
        """Spelling, groups, counts and links of pieces, one after the other."""
        texts, counts, links = [], [], [np.empty(0, np.int64)]
        a_of, b_of = self.own.a_bytes, self.own.b_bytes
        spaced = [" " + p for p in block]
        for piece, ids, others in zip(spaced, self.own.encode_a(spaced), self.own.encode_b(block), strict=True):
            whole, a, b = piece.encode(), [a_of[i] for i in ids], [b_of[i] for i in others]
            closed = None
            if b"".join(a) == whole == b"".join(b):
                closed = grouped(Tokens(
                    np.array(ids, np.int64), np.cumsum([len(x) for x in a]), np.array(others, np.int64), np.cumsum([len(x) for x in b]),
                ))
            texts.append(closed.text if closed else "")
            counts.append((len(ids), len(others), len(closed.links) if closed else -1))
            links.append(closed.links if closed else links[0])
        return block, texts, np.array(counts, np.int64).reshape(-1, 3), np.concatenate(links)

    def _together(self, block: list[str]) -> tuple[list[str], list[str], np.ndarray, np.ndarray] | None:
        """The same for pieces without white space at their ends, as one text that both vocabularies part at its spaces;
        None if the tokens of one do not spell it."""
        own, joined = self.own, " ".join(block)
        whole = (" " + joined).encode()
        ids, others = own.encode_a([" " + joined])[0], own.encode_b([joined])[0]
        if b"".join(map(own.a_bytes.__getitem__, ids)) != whole or b"".join(map(own.b_bytes.__getitem__, others)) != whole:
            return None
        a, b = np.array(ids, np.int64), np.array(others, np.int64)
        a_ends, b_ends = np.cumsum(own.a_sizes[a]), np.cumsum(own.b_sizes[b])
        ends = np.cumsum(np.fromiter((len(p.encode()) + 1 for p in block), np.int64, len(block)))
        common = a_ends[np.isin(a_ends, b_ends, assume_unique=True)]
        if not np.isin(ends, common, assume_unique=True).all():
            return None
        in_group = [np.searchsorted(common, e) for e in (a_ends, b_ends)]
        last = [common[g] == e for g, e in zip(in_group, (a_ends, b_ends), strict=True)]
        of_piece = [np.bincount(np.searchsorted(ends, e), minlength=len(block)) for e in (a_ends, b_ends, common)]
        # a group reads: ids of the first with commas, a bar, ids of the second with commas, a semicolon
        order = np.argsort(np.concatenate([2 * in_group[0], 2 * in_group[1] + 1]), kind="stable")
        codes = np.concatenate([2 * a + last[0], 2 * len(own.a_sizes) + 2 * b + last[1]])[order]
        parts = list(map(own.spelled.__getitem__, codes.tolist()))
        stops = np.cumsum(of_piece[0] + of_piece[1]).tolist()
        texts = ["".join(parts[x:y])[:-1] for x, y in zip([0, *stops[:-1]], stops, strict=True)]
        return block, texts, np.stack(of_piece, axis=1).astype(np.int64), a[last[0]] << 32 | b[last[1]]


def pieces(first: str, second: str) -> Pieces:
    """A worker's, kept between tasks."""
    kept = vars(sys).setdefault("_granary_pieces", {})
    if (first, second) not in kept:
        kept[first, second] = Pieces(tokenizers(first, second))
    return kept[first, second]


def _summed(links: np.ndarray, times: np.ndarray) -> Iterator[pa.RecordBatch]:
    each, where = np.unique(links, return_inverse=True)
    total = np.bincount(where, times, len(each)).astype(np.int64)
    for at in range(0, len(each), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(each[at : at + 50_000]), pa.array(total[at : at + 50_000])], ["link", "times"])


def short_links(docs: DataFrame, first: str, second: str) -> DataFrame:
    """A row (doc, n_a, n_b, n_links, groups_sha256, links) per text, 8 bytes a link in order, so that no text is encoded again when
    links are counted; and rows (link, times): how often each pair of ids is linked, added up per task. `docs` has doc and text."""
    kind = docs.schema["doc"].dataType.simpleString()
    names = ["doc", "n_a", "n_b", "n_links", "groups_sha256", "links", "link", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(first, second)
        times = np.zeros(0, np.int64)
        doc_type = None

        def told() -> Iterator[pa.RecordBatch]:
            used = np.flatnonzero(times)
            for batch in _summed(own.links_of(used), np.repeat(times[used], np.maximum(own.counts[used, 2], 0))):
                empty = [pa.nulls(batch.num_rows, t) for t in (doc_type, *[pa.int64()] * 3, pa.string(), pa.binary())]
                yield pa.RecordBatch.from_arrays([*empty, *batch.columns], names)

        for batch in bounded(batches, "text", AT_ONCE):
            doc_type = batch.column("doc").type
            if own.full():
                yield from told()
                own.forget()
                times = np.zeros(0, np.int64)
            found = own.of(batch.column("text").to_pylist())
            times = np.pad(times, (0, len(own.texts) - len(times)))
            spelled = [len(f) > 0 and bool((own.counts[f, 2] >= 0).all()) for f in found]
            flat = np.concatenate([np.empty(0, np.int64), *(f for f, good in zip(found, spelled, strict=True) if good)])
            times += np.bincount(flat, minlength=len(times))
            sums = np.array([own.counts[f].sum(0) if good else (0, 0, 0) for f, good in zip(found, spelled, strict=True)], np.int64)
            digests = [
                hashlib.sha256(";".join([own.texts[i] for i in f.tolist()]).encode()).hexdigest() if good else ""
                for f, good in zip(found, spelled, strict=True)
            ]
            ends = np.concatenate([[0], 8 * np.cumsum(sums[:, 2])]).astype(np.int32)
            links = pa.Array.from_buffers(pa.binary(), len(found), [None, pa.py_buffer(ends), pa.py_buffer(own.links_of(flat))])
            empty = pa.nulls(len(found), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc"), *map(pa.array, sums.T.copy()), pa.array(digests, pa.string()), links, empty, empty], names)
        if doc_type is not None:
            yield from told()

    schema = f"doc {kind}, n_a long, n_b long, n_links long, groups_sha256 string, links binary, link long, times long"
    return docs.select("doc", "text").mapInArrow(run, schema)


class Counted:
    """Counts of links, looked up: how many of some links are their second id's best, and the sum of all their counts."""

    def __init__(self, files: list[str]):
        rows = pa.Table.from_batches(list(shared_batches(files, 1 << 16)) or [pa.RecordBatch.from_pylist([], TABLE)])
        order = np.argsort(link := rows.column("link").to_numpy())
        self.link = link[order]
        self.times = rows.column("times").to_numpy()[order]
        self.best = rows.column("best").to_numpy()[order]

    def of(self, links: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Two numbers for each run of links, given where each ends. Links of another part of the table count nothing."""
        out = np.zeros((len(links) + 1, 2), np.int64)
        if len(self.link):
            at = np.minimum(np.searchsorted(self.link, links), len(self.link) - 1)
            here = self.link[at] == links
            out[1:, 0], out[1:, 1] = here & (self.best[at] > 0), np.where(here, self.times[at], 0)
        total = np.cumsum(out, axis=0)
        return total[ends] - total[np.concatenate([[0], ends[:-1]])] if len(ends) else np.zeros((0, 2), np.int64)


TABLE = pa.schema([("link", pa.int64()), ("times", pa.int64()), ("best", pa.int32())])


def counted_links(counts: DataFrame) -> tuple[list[list[str]], DataFrame]:
    """The table (link, times, best) of all linked pairs of ids as lists of files, each of which a task can hold; `best` is 1
    where no link of the same second id has more."""
    table = written(counts.groupBy("link").agg(F.sum("times").alias("times")), "links-counted")
    second = F.col("link").bitwiseAND((1 << 32) - 1)
    most = table.groupBy(second.alias("b")).agg(F.max("times").alias("most"))
    judged = table.withColumn("b", second).join(most, "b").select("link", "times", (F.col("times") == F.col("most")).cast("int").alias("best"))
    parts = max(1, -(-table.count() // PAIRS))
    judged = written(judged, "links-judged") if parts > 1 else judged
    part = F.pmod(F.xxhash64("link"), F.lit(parts))
    return [written(judged.filter(part == k).coalesce(8), "links-part").inputFiles() for k in range(parts)]


RESULT = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _row(n_a: int, n_b: int, links: int, best: int, total: int, text: str) -> tuple:
    return (n_a, n_b, links, links, best, total, hashlib.sha256(text.encode()).hexdigest())


def short_rows(table: DataFrame, files: list[str], whole: bool) -> DataFrame:
    """The result of each text of a table (doc, row, n_a, n_b, n_links, groups_sha256, links), with what the links in these files
    give; without the digest unless `whole`."""
    kind = table.schema["doc"].dataType.simpleString()
    names = RESULT.replace(" long", "").replace(" string", "").split(", ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted = Counted(files)
        for batch in bounded(batches, "links", AT_ONCE):
            many = batch.column("n_links")
            links = np.frombuffer(b"".join(v.as_buffer() or b"" for v in batch.column("links")), np.int64)
            best, total = counted.of(links, np.cumsum(many.to_numpy())).T.copy()
            digest = batch.column("groups_sha256") if whole else pa.array([""] * batch.num_rows, pa.string())
            columns = [batch.column(c) for c in ("doc", "row", "n_a", "n_b")]
            yield pa.RecordBatch.from_arrays([*columns, many, many, pa.array(best), pa.array(total), digest], ["doc", "row", *names])

    return table.select("doc", "row", "n_a", "n_b", "n_links", "groups_sha256", "links").mapInArrow(run, f"doc {kind}, row long, {RESULT}")


def byte_ranges(docs: DataFrame, first: str, second: str, size: int) -> DataFrame:
    """(row, part, a_at, a_text, b_at, b_text): what each vocabulary has of each byte range of a text, behind a space. A range
    ends at the first place behind so many bytes where the vocabulary always parts."""
    kind = "row long, part int, a_at long, a_text string, b_at long, b_text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizers(first, second)
        names = [f.split()[0] for f in kind.split(", ")]
        for batch in batches:
            for row, value in zip(batch.column("row").to_pylist(), batch.column("text"), strict=True):
                text, part, i, j, at_a, at_b = " " + value.as_py(), 0, 0, 0, 0, 0
                while i < len(text) or j < len(text):
                    target = max(i, j) + size
                    both = APART.search(text, target) if own.parts_at_spaces else None
                    if both and both.start() < target + size:
                        x = y = both.start()
                    else:
                        x, y = own.cut_a(text, target), own.cut_b(text, target)
                    a, b = text[i:x], text[j:y]
                    yield pa.RecordBatch.from_pylist([dict(zip(names, (row, part, at_a, a, at_b, b), strict=True))], schema)
                    at_a, at_b = at_a + len(a.encode()), at_b + len(b.encode())
                    part, i, j = part + 1, x, y

    schema = pa.schema([("row", pa.int64()), ("part", pa.int32()), ("a_at", pa.int64()), ("a_text", pa.string()), ("b_at", pa.int64()), ("b_text", pa.string())])
    return docs.select("row", "text").mapInArrow(run, kind)


def range_fragment(own: Tokenizers, a_at: int, a_text: str, b_at: int, b_text: str) -> tuple[Fragment | None, int, int]:
    """The fragment of a byte range and its numbers of tokens; None if the tokens' bytes are not the text's."""
    ids, others = own.a_part(a_text), own.b_part(b_text) if b_text else []
    if others is None:
        return None, 0, 0
    a, b = [own.a_bytes[i] for i in ids], [own.b_bytes[i] for i in others]
    if b"".join(a) != a_text.encode() or b"".join(b) != b_text.encode():
        return None, 0, 0
    long = lambda v: np.array(v, np.int64)
    tokens = Tokens(long(ids), a_at + np.cumsum(long([len(x) for x in a])), long(others), b_at + np.cumsum(long([len(x) for x in b])))
    return Fragment.of(tokens), len(ids), len(others)


FRAGMENT = pa.schema([
    ("row", pa.int64()), ("part", pa.int32()), ("valid", pa.bool_()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("met", pa.bool_()),
    *((f"{side}_{f}", pa.list_(pa.int64())) for side in ("prefix", "suffix") for f in ("a", "a_ends", "b", "b_ends")),
    ("text", pa.string()), ("links", pa.list_(pa.int64())),
])
FRAGMENT_SQL = "row long, part int, valid boolean, n_a long, n_b long, met boolean, " + ", ".join(
    f"{side}_{f} array<long>" for side in ("prefix", "suffix") for f in ("a", "a_ends", "b", "b_ends")) + ", text string, links array<long>"


def _packed(row: int, part: int, fragment: Fragment | None, n_a: int, n_b: int) -> pa.RecordBatch:
    f = fragment or Fragment(Tokens(), Closed(), Tokens(), False)
    sides = [v for s in (f.prefix, f.suffix) for v in (s.a, s.a_ends, s.b, s.b_ends)]
    values = [row, part, fragment is not None, n_a, n_b, f.met, *sides, f.closed.text, f.closed.links]
    return pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip(values, FRAGMENT, strict=True)], schema=FRAGMENT)


def _unpacked(batch: pa.RecordBatch, i: int) -> tuple[int, int, Fragment | None, int, int]:
    at = lambda name: batch.column(name)[i]
    row, part, n_a, n_b = (at(c).as_py() for c in ("row", "part", "n_a", "n_b"))
    if not at("valid").as_py():
        return row, part, None, n_a, n_b
    numbers = lambda name: at(name).values.to_numpy().astype(np.int64)
    prefix, suffix = (Tokens(*(numbers(f"{side}_{f}") for f in ("a", "a_ends", "b", "b_ends"))) for side in ("prefix", "suffix"))
    return row, part, Fragment(prefix, Closed(at("text").as_py(), numbers("links")), suffix, at("met").as_py()), n_a, n_b


def fragments(ranges: DataFrame, first: str, second: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizers(first, second)
        for batch in batches:
            for r in batch.to_pylist():
                yield _packed(r["row"], r["part"], *range_fragment(own, r["a_at"], r["a_text"], r["b_at"], r["b_text"]))

    return ranges.repartition("row", "part").mapInArrow(run, FRAGMENT_SQL)


def composed(table: DataFrame, fan: int = FAN) -> DataFrame:
    """One fragment per row and `fan` neighbours; `part` then numbers these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for i in range(batch.num_rows):
                row, part, fragment, n_a, n_b = _unpacked(batch, i)
                if held and held[:2] == (row, part // fan):
                    joined = held[2] + fragment if held[2] and fragment else None
                    held = (row, part // fan, joined, held[3] + n_a, held[4] + n_b)
                else:
                    if held:
                        yield _packed(*held)
                    held = (row, part // fan, fragment, n_a, n_b)
        if held:
            yield _packed(*held)

    dealt = table.withColumn("to", F.expr(f"part div {fan}")).repartition("row", "to").sortWithinPartitions("row", "part")
    return dealt.drop("to").mapInArrow(run, FRAGMENT_SQL)


def reduced(table: DataFrame, fan: int = FAN) -> DataFrame:
    """One fragment per row, by as many levels of the tree as the longest text needs; each is written."""
    table = written(table, "fragments")
    most = table.agg(F.max("part")).first()[0]
    while most:
        table = written(composed(table, fan), "fragments")
        most //= fan
    return table


def long_counts(whole: DataFrame) -> DataFrame:
    """(link, times) of the closed fragments of whole texts, added up per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                fragment = _unpacked(batch, i)[2]
                closed = fragment.whole() if fragment else None
                if closed:
                    yield from _summed(closed.links, np.ones(len(closed.links), np.int64))

    return whole.mapInArrow(run, "link long, times long")


def long_rows(whole: DataFrame, files: list[str]) -> DataFrame:
    names = RESULT.replace(" long", "").replace(" string", "").split(", ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted = Counted(files)
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                row, _, fragment, n_a, n_b = _unpacked(batch, i)
                closed = fragment.whole() if fragment else None
                if closed:
                    best, total = counted.of(closed.links, np.array([len(closed.links)]))[0].tolist()
                    rows.append((row, *_row(n_a, n_b, len(closed.links), best, total, closed.text)))
                else:
                    rows.append((row, 0, 0, 0, 0, 0, 0, ""))
            columns = [pa.array(c, pa.string() if n == "groups_sha256" else pa.int64()) for c, n in zip(zip(*rows, strict=True), ["row", *names], strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["row", *names])

    return whole.mapInArrow(run, f"row long, {RESULT}")


def aligned(
    docs: DataFrame, first: str, second: str, *, key: str = "doc_id", text: str = "text", size: int = RANGE, fan: int = FAN
) -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each text behind a space, in the ids of a
    byte-level vocabulary (`first`) and a piece vocabulary with byte fallback (`second`).

    Groups end where tokens of both end; a link is the pair of tokens that end there, and its count how many links of all
    texts have the same two ids. Null and empty texts, and texts that the tokens of one vocabulary don't spell,
    have zeros and an empty digest. Rows that repeat a key, or have a null one, are texts of their own.
    """
    names = RESULT.replace(" long", "").replace(" string", "").split(", ")
    own = docs.select(F.col(key).alias("doc"), F.col(text).alias("text"))
    is_long = F.coalesce(F.octet_length("text") > size, F.lit(False))
    short = written(short_links(own.filter(~is_long), first, second).withColumn("row", F.monotonically_increasing_id()), "short")
    long = written(own.filter(is_long).withColumn("row", F.monotonically_increasing_id()), "long")
    whole = reduced(fragments(written(byte_ranges(long, first, second, size), "ranges"), first, second), fan)
    # more pairs of ids than a task holds: their counts are added up from parts of the table
    files = counted_links(short.filter("link is not null").select("link", "times").unionByName(long_counts(whole)))
    short = short.filter("link is null")

    def result(part: list[str], digest: bool) -> DataFrame:
        told = long.select("doc", "row").join(long_rows(whole, part), "row").select("doc", (-1 - F.col("row")).alias("row"), *names)
        return short_rows(short, part, digest).unionByName(told)

    every = result(files[0], True)
    if len(files) > 1:
        for part in files[1:]:
            every = every.unionByName(result(part, False))
        sums = [F.sum(c).alias(c) if c in ("n_best", "count_sum") else F.max(c).alias(c) for c in names]
        every = every.groupBy("row", "doc").agg(*sums)
    return every.select(F.col("doc").alias(key), *names)
