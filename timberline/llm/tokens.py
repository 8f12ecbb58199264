"""Token ids of whole texts with a public tokenizer, computed once per distinct word.

The tokenizer drops white space and never joins characters across a space, so the ids of a text are
the ids of its space-separated words in order. Plain words (Latin letters, then marks) fall into letters
and marks, which many words share. A worker gives the library each part it meets once, keeps its ids in
a bounded memory of two generations, and lays the ids of a batch out with array operations.
"""

from __future__ import annotations

import functools
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Parts a worker remembers in a generation. A full one becomes the older; parts of the older that are met
#: again move on, the rest is forgotten with it. Results do not change.
MEMORY_PARTS = 300_000
#: Plain words the library gets in one text.
JOINED = 256
END_ID = 2

#: Letters of the Latin-1 block: lower-cased letter by letter, never composed, one word of the tokenizer.
_LETTERS = "".join(map(chr, [*range(65, 91), *range(97, 123), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]))
_MARKS = ".,;:!?"
_PLAIN = "^[A-Za-zÀ-ÖØ-öø-ÿ]+[.,;:!?]*$"
_PLAIN_PART = "^[a-zß-öø-ÿ]+$"


class _Generation:
    """Ids of parts, one after the other."""

    def __init__(self):
        self.place: dict[str, int] = {}
        self.start = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def add(self, parts: list[str], lengths: np.ndarray, ids: np.ndarray) -> None:
        self.place.update(zip(parts, range(len(self.place), len(self.place) + len(parts))))
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(lengths, dtype=np.int64)])
        self.ids = np.concatenate([self.ids, ids])


def _gather(ids: np.ndarray, begin: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of pieces one after the other, and where each piece begins in them."""
    before = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    kind = np.int32 if max(before[-1], len(ids)) < 1 << 31 else np.int64
    at = np.repeat((begin - before[:-1]).astype(kind), lengths)
    at += np.arange(before[-1], dtype=kind)
    return ids[at], before


class WordEncoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        #: ids that end a word of the tokenizer
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.young, self.old = _Generation(), _Generation()

    def _library(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(lengths, ids) of parts, each encoded as a text of its own."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        return lengths, np.fromiter((i for x in found for i in x), np.uint32, int(lengths.sum()))

    def _plain(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for plain parts: each is one word of the tokenizer, so its last id says where it ends."""
        texts = [" ".join(parts[k:k + JOINED]) for k in range(0, len(parts), JOINED)]
        ids = self._library(texts)[1]
        last = np.flatnonzero(self.ends[ids])
        if len(last) != len(parts) or len(ids) != (last[-1] + 1 if len(last) else 0):
            return self._library(parts)
        return np.diff(last, prepend=-1), ids

    def _places(self, parts: pa.Array) -> np.ndarray:
        """Places of distinct parts in the young generation, which learns those it does not hold."""
        names = parts.to_pylist()
        if len(self.young.place) > MEMORY_PARTS:
            self.old, self.young = self.young, _Generation()
        young = self.young.place
        new = [w for w in names if w not in young]
        if new:
            known = [w for w in new if w in self.old.place]
            if known:
                at = np.fromiter(map(self.old.place.__getitem__, known), np.int64, len(known))
                lengths = self.old.start[at + 1] - self.old.start[at]
                self.young.add(known, lengths, _gather(self.old.ids, self.old.start[at], lengths)[0])
                new = [w for w in new if w not in young]
            plain = pc.match_substring_regex(pa.array(new, pa.large_string()), _PLAIN_PART).to_pylist()
            for kind, encode in ((True, self._plain), (False, self._library)):
                mine = [w for w, p in zip(new, plain) if p is kind]
                if mine:
                    self.young.add(mine, *encode(mine))
        return np.fromiter(map(young.__getitem__, names), np.int64, len(names))

    def encode(self, texts: pa.Array, end: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, where each text starts), each text closed by ``end``."""
        split = pc.split_pattern(texts, " ")
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary
        plain = pc.match_substring_regex(words, _PLAIN)
        first = pc.if_else(plain, pc.utf8_rtrim(pc.utf8_lower(words), characters=_MARKS), words)
        marks = pc.if_else(plain, pc.utf8_ltrim(words, characters=_LETTERS), "")
        parts = pa.concat_arrays([first, marks]).dictionary_encode()
        place = self._places(parts.dictionary)[parts.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.int64)
        # ids of the distinct words: letters, then marks
        pairs = place.reshape(2, -1).T.ravel()
        ids, before = _gather(self.young.ids, self.young.start[pairs], self.young.start[pairs + 1] - self.young.start[pairs])
        word_start = before[::2]
        edges = split.offsets.to_numpy().astype(np.int64)
        of_word = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        if end is not None:  # the end id is one more word, after the last of each text
            ids, word_start = np.append(ids, np.uint32(end)), np.append(word_start, len(ids) + 1)
            of_word = np.insert(of_word, edges[1:], len(words))
            edges = edges + np.arange(len(edges))
        begin = word_start[of_word]
        ids, before = _gather(ids, begin, word_start[of_word + 1] - begin)
        return ids, before[edges]


@functools.cache
def word_encoder(path: str) -> WordEncoder:
    """One encoder for each worker process and tokenizer file."""
    return WordEncoder(path)
