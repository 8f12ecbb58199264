"""Columnar word work inside tasks: texts of an Arrow batch as word codes over a small dictionary."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Text bytes worked on at once inside a task; a longer text is a slice of its own.
SLICE_BYTES = 6 << 20


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of a slice stay near ``limit`` bytes."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(size, dtype=np.int64) // limit
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(size)]
        for a, b in zip(edges, edges[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """The text column with null as empty, as 64-bit offset strings."""
    return pc.fill_null(batch.column(column).cast(pa.large_string()), "")


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of some texts.

    ``codes`` holds every word of every text in order, ``starts`` (one longer than the texts) where
    each text begins, ``vocabulary`` the distinct words.
    """

    def __init__(self, texts: pa.Array):
        parts = pc.ascii_split_whitespace(texts)
        flat = parts.flatten()
        owner = np.repeat(np.arange(len(texts)), np.diff(parts.offsets.to_numpy()))
        coded = flat.dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        self.vocabulary: list[str] = coded.dictionary.to_pylist()
        self.lengths = pc.utf8_length(coded.dictionary).to_numpy(zero_copy_only=False).astype(np.int64)
        real = (self.lengths > 0)[codes] if len(codes) else np.zeros(0, bool)
        self.codes = codes[real]
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(owner[real], minlength=len(texts)))]).astype(np.int64)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.starts)

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.starts) - 1), self.counts)

    def per_text(self, values: np.ndarray) -> np.ndarray:
        """Sum over each text of a number given for every vocabulary entry."""
        return sums(values[self.codes], self.starts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of every vocabulary entry, the same in every process."""
        return np.fromiter(
            (xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in self.vocabulary),
            np.uint64, len(self.vocabulary),
        )


def sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[starts[1:]] - total[starts[:-1]]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers (multiply and shift, twice)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` consecutive word hashes of one long sequence."""
    n = max(len(hashes) - size + 1, 0)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = (out + hashes[k:k + n]) * np.uint64(0x9E3779B97F4A7C15 + 2 * k)
    return mix(out)


def inside(starts: np.ndarray, size: int) -> np.ndarray:
    """Of all windows over a long sequence, those that lie in one text."""
    n = max(int(starts[-1]) - size + 1, 0)
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    return owner[:n] == owner[size - 1:size - 1 + n]
