"""Words of whole batches at once: UTF-8 bytes are classified by a table, so no text is touched byte by byte in Python.

A word is a maximal run of ASCII letters, ASCII digits and characters from U+0080 on, with A-Z in lower case.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_IS_WORD = np.array([48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


@dataclasses.dataclass
class Words:
    """The words of a batch of texts in order: ``ids`` index ``vocabulary``, text i has ``counts[i]`` of them."""

    vocabulary: pa.Array
    ids: np.ndarray
    counts: np.ndarray

    def starts(self) -> np.ndarray:
        """Where each text's words begin in ``ids``, with the end behind."""
        return np.concatenate([[0], np.cumsum(self.counts)])


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of all texts, one text more in offsets; null texts are empty. Nothing is copied where there are no nulls."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2] if len(texts) else None
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def runs(raw: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mask, starts, ends) of the maximal runs of member bytes; none goes over the border of two texts."""
    mask = member[raw]
    first = mask.copy()
    first[1:] &= ~mask[:-1]
    border = offsets[1:-1]
    border = border[border < len(raw)]
    first[border] = mask[border]
    starts = np.flatnonzero(first)
    last = mask.copy()
    last[:-1] &= ~mask[1:] | first[1:]
    return mask, starts, np.flatnonzero(last) + 1


def coded(raw: np.ndarray, mask: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(vocabulary, ids) of runs; by exact comparison, not by a hash alone."""
    lengths = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(lengths), pa.py_buffer(raw[mask])])
    found = words.dictionary_encode()
    return found.dictionary, found.indices.to_numpy(zero_copy_only=False)


def words(texts: pa.Array) -> Words:
    raw, offsets = text_bytes(texts)
    mask, starts, ends = runs(raw, offsets, _IS_WORD)
    vocabulary, ids = coded(_LOWER[raw], mask, starts, ends)
    return Words(vocabulary, ids, np.diff(np.searchsorted(starts, offsets)))


def counted(texts: pa.Array) -> np.ndarray:
    """Only how many words each text has."""
    raw, offsets = text_bytes(texts)
    _, starts, _ = runs(raw, offsets, _IS_WORD)
    return np.diff(np.searchsorted(starts, offsets))
