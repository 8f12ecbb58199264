"""Token counts of whole texts: batches of near equal bytes are encoded in Arrow functions that return lengths only.

Texts stay where they are read; no shuffle. A text longer than ``PIECE_CHARS`` is cut at safe places, so
that no call holds the tokens of a very long text at once: places where the tokenizer's own word pattern
always ends a word, so the counts of the pieces add up to the count of the text. These are the end of a
visible character before white space and, for scripts without spaces, the end of a letter before a mark.
Special strings hold no such place. Only byte-level tokenizers with the usual pattern and no normaliser
are known to allow this; with any other file a text is encoded as a whole.

Defined results: a null text counts as empty (0 bytes, 0 tokens); rows that repeat an id are counted
each; a null ``doc_id`` stays null; an empty table gives an empty result. Only ``doc_id`` and the text
are read, so further columns of any name do no harm.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .words import slices, texts_of

#: A longer text is cut; bytes of the pieces given to the library at once.
PIECE_CHARS = 1 << 16
BATCH_BYTES = 1 << 20

COUNTS = "doc_id long, n_bytes long, n_tokens long"

#: Letters that every version of the character tables has as letters.
_LETTER = "A-Za-zÀ-ÖØ-öø-ɏа-яА-Яぁ-ゖァ-ヺ一-龥가-힣"
_MARK = ".,;:!?、。，！？；："
_SAFE = re.compile(f"(?<=[!-~{_LETTER}])(?=[ \\t\\n\\r])|(?<=[{_LETTER}])(?=[{_MARK}])")


def safe_pieces(text: str, size: int = PIECE_CHARS) -> list[str]:
    """Cut a text at the first safe place after every ``size`` characters."""
    out, at = [], 0
    while len(text) - at > size:
        cut = _SAFE.search(text, at + size)
        if cut is None:
            break
        out.append(text[at:cut.start()])
        at = cut.start()
    out.append(text[at:])
    return out


def balanced(sizes: np.ndarray, limit: int = BATCH_BYTES) -> list[tuple[int, int]]:
    """Ranges of consecutive pieces of near ``limit`` bytes; a larger piece is a range of its own."""
    edges, held = [0], 0
    for k, size in enumerate(sizes.tolist()):
        if held and held + size > limit:
            edges.append(k)
            held = 0
        held += size
    edges.append(len(sizes))
    return [(a, b) for a, b in zip(edges, edges[1:]) if b > a]


def _cuttable(config: dict) -> bool:
    first = config.get("pre_tokenizer") or {}
    return config.get("normalizer") is None and first.get("type") == "ByteLevel" and bool(first.get("use_regex"))


@functools.cache
def counter(path: str) -> tuple[Callable[[list[str]], list[int]], bool]:
    """(lengths of the encodings of some texts, whether texts may be cut), once for each worker process."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)], False
    # one thread for each task, as Spark has given out the cores
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    with open(path, encoding="utf-8") as file:
        cuttable = _cuttable(json.load(file))
    return lambda texts: [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)], cuttable


def lengths(texts: list[str], path: str, piece_chars: int = PIECE_CHARS, batch_bytes: int = BATCH_BYTES) -> np.ndarray:
    """Tokens of each text."""
    count, cuttable = counter(path)
    pieces, owner = [], []
    for k, text in enumerate(texts):
        cut = safe_pieces(text, piece_chars) if cuttable and len(text) > piece_chars else [text]
        pieces += cut
        owner += [k] * len(cut)
    sizes = pc.binary_length(pa.array(pieces, pa.large_string())).to_numpy(zero_copy_only=False)
    found = np.zeros(len(pieces), np.int64)
    for a, b in balanced(sizes, batch_bytes):
        found[a:b] = count(pieces[a:b])
    return np.bincount(np.array(owner, np.int64), found, len(texts)).astype(np.int64)


def _count_part(path: str, piece_chars: int, batch_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = texts_of(batch)
            tokens = lengths(texts.to_pylist(), path, piece_chars, batch_bytes)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pc.binary_length(texts).cast(pa.int64()), pa.array(tokens)],
                names=["doc_id", "n_bytes", "n_tokens"])

    return run


def token_counts(
    docs: DataFrame, tokenizer: str, text: str = "text", piece_chars: int = PIECE_CHARS, batch_bytes: int = BATCH_BYTES,
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_count_part(tokenizer, piece_chars, batch_bytes), COUNTS)
