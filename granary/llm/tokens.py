"""Token ids of many texts by the tokenizers library, with one encoding per distinct piece.

The byte-level vocabulary always splits a text before a space that a visible character follows and
never merges across that place. So texts are cut there, each distinct piece is encoded once by the
library, and the ids of a text are those of its pieces in order. A text in which white space or
nothing follows a space, or that holds the string of an added token, is encoded whole. Tests hold this against the encoding of whole texts.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces remembered before the memory starts anew; about 200 bytes each.
REMEMBERED = 900_000
#: Bytes of text encoded at once; a longer text is a batch of its own.
AT_ONCE = 6_000_000


class Encoder:
    """Encodes batches of texts; remembers the pieces it has met, up to a bound."""

    def __init__(self, vocabulary: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker on each core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(vocabulary)
        # the library turns their strings in a text into their ids, wherever they stand
        self.added = [token.content for token in self.library.get_added_tokens_decoder().values()]
        self.remembered = remembered
        self.width = np.zeros(self.library.get_vocab_size(), np.int64)  # bytes of each id
        for token, number in self.library.get_vocab().items():
            self.width[number] = len(token)  # the vocabulary spells each byte as one character
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.pool = np.empty(0, np.uint32)
        self.starts = np.empty(0, np.int64)
        self.lengths = np.empty(0, np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts after one another, and where each text ends. Null counts as empty."""
        texts = pc.fill_null(texts, "")
        cut = pc.split_pattern(texts, " ")
        offsets = cut.offsets.to_numpy().astype(np.int64) - cut.offsets[0].as_py()
        coded = cut.flatten().dictionary_encode()
        codes = coded.indices.to_numpy()
        spelled = coded.dictionary.to_pylist()
        uncut = np.fromiter((not key or key[0].isspace() for key in spelled), bool, len(spelled))[codes]
        uncut[offsets[:-1]] = False  # what stands first in a text follows no space
        whole = np.add.reduceat(uncut, offsets[:-1]) > 0 if len(texts) else np.empty(0, bool)
        for token in self.added:
            whole |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        if whole.any():
            return self._with_whole(texts, whole)
        # a key that starts with a space stands for the first piece of a text
        firsts = [" " + spelled[i] for i in codes[offsets[:-1]].tolist()]
        self._learn_missing([key for key in spelled if key and not key[0].isspace()] + firsts)
        found = self._look_up(spelled)[codes]
        found[offsets[:-1]] = self._look_up(firsts)
        lengths = self.lengths[found]
        behind = np.cumsum(lengths)
        places = np.repeat(self.starts[found] - (behind - lengths), lengths)
        places += np.arange(places.size)
        return self.pool[places], behind[offsets[1:] - 1]

    def _with_whole(self, texts: pa.Array, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids, ends = self.encode(texts.filter(pa.array(~whole)))
        cut = iter(np.split(ids, ends[:-1])) if ends.size else iter(())
        alone = iter(self.library.encode_batch_fast(texts.filter(pa.array(whole)).to_pylist(), add_special_tokens=False))
        parts = [np.array(next(alone).ids, np.uint32) if flag else next(cut) for flag in whole.tolist()]
        return np.concatenate(parts), np.cumsum([len(p) for p in parts])

    def _look_up(self, keys: list[str]) -> np.ndarray:
        return np.fromiter(map(self.known.get, keys, repeat(0)), np.int64, len(keys))

    def _learn_missing(self, keys: list[str]) -> None:
        new = set(keys).difference(self.known)
        if len(self.known) + len(new) > self.remembered:
            self._forget()
            new = set(keys)
        firsts = [key for key in new if key[0] == " "]
        others = [key for key in new if key[0] != " "]
        alone = [e.ids for e in self.library.encode_batch_fast([k[1:] for k in firsts], add_special_tokens=False)]
        lengths = [np.fromiter(map(len, alone), np.int64, len(alone))]
        flat = [np.fromiter((i for ids in alone for i in ids), np.uint32)]
        for at in range(0, len(others), 200):
            # pieces that follow a space keep their ids side by side; widths tell where each ends
            group = [" " + key for key in others[at : at + 200]]
            ids = self.library.encode_batch_fast(["".join(group)], add_special_tokens=False)[0].ids
            ids = np.array(ids, np.uint32)
            bytes_behind = np.cumsum(np.fromiter((len(p.encode()) for p in group), np.int64, len(group)))
            cuts = np.searchsorted(np.cumsum(self.width[ids]), bytes_behind) + 1
            lengths.append(np.diff(cuts, prepend=0))
            flat.append(ids)
        grown = np.concatenate(lengths)
        self.starts = np.concatenate([self.starts, np.cumsum(grown) - grown + len(self.pool)])
        self.lengths = np.concatenate([self.lengths, grown])
        self.pool = np.concatenate([self.pool, *flat])
        base = len(self.known)
        self.known.update(zip(firsts + others, range(base, base + len(new)), strict=True))


def bounded(batches: Iterator[pa.RecordBatch], column: str, most: int = AT_ONCE) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts of each have at most so many bytes, or are one text."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start = size = 0
        for row, length in enumerate(sizes.tolist()):
            if size and size + length > most:
                yield batch.slice(start, row - start)
                start, size = row, 0
            size += length
        if start < batch.num_rows:
            yield batch.slice(start)


def encoder(vocabulary: str, remembered: int = REMEMBERED) -> Encoder:
    """The worker's encoder for a vocabulary, kept between batches and tasks."""
    # this module travels by value, so its own globals do not outlive a task
    kept = vars(sys).setdefault("_granary_encoders", {})
    key = (vocabulary, remembered)
    if key not in kept:
        kept[key] = Encoder(vocabulary, remembered)
    return kept[key]
