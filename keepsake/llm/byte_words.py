"""Words of Arrow text columns, found on their bytes (shared by the token, term and phrase operators)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are read at a time; a longer text is read alone.
BLOCK = 8 << 20
#: Each byte with A-Z lower-cased.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(inside: range | list[int]) -> np.ndarray:
    """Table by byte value: whether the byte is one of ``inside``."""
    table = np.zeros(256, bool)
    table[list(inside)] = True
    return table


def texts_of(column: pa.Array) -> pa.Array:
    """A column as 64-bit-offset bytes; null counts as empty."""
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    return column.cast(pa.large_binary()).fill_null(b"")


def blocks(batch: pa.RecordBatch, column: str, most: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``most`` bytes of text."""
    ends = _offsets(texts_of(batch.column(column)))
    at = 0
    while at < batch.num_rows:
        upto = int(np.searchsorted(ends, ends[at] + most, "right")) - 1
        upto = min(max(upto, at + 1), batch.num_rows)
        yield batch.slice(at, upto - at)
        at = upto


def _offsets(texts: pa.Array) -> np.ndarray:
    return np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts in a row, where each text begins and the last one ends)."""
    ends = _offsets(texts)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[ends[0]:ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, ends - ends[0]


def word_spans(raw: np.ndarray, ends: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, byte after the last) of each maximal run of ``word`` bytes; no run crosses a text's border."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = word[raw]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    begins = ends[:-1][ends[:-1] < len(raw)]
    first[begins] = inside[begins]
    stops = ends[1:][ends[1:] > 0] - 1
    last[stops] = inside[stops]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def found_words(raw: np.ndarray, ends: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(first byte of each run of ``word`` bytes, number of runs in each text, the runs with A-Z lower-cased)."""
    starts, stops = word_spans(raw, ends, word)
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(stops - starts, out=offsets[1:])
    kept = LOWER[raw[word[raw]]]
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(kept)])
    return starts, np.diff(np.searchsorted(starts, ends)), words


def coded(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(code of each word, distinct words by code)."""
    d = words.dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary
