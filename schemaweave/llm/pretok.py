"""Vectorised splitting by the public byte-level BPE pattern.

The pattern's alternatives depend on the classes of neighbouring characters only, so the piece boundaries of a whole batch
of texts are computed with numpy from a class per code point: letter, number, white space, other, or end of text. The rules:

* a boundary lies wherever the class changes;
* a run of white space before a character gives up its last character, which leads the next piece if it is a plain space
  and is a piece of its own otherwise;
* an apostrophe that begins a piece takes the letters of 's 't 're 've 'm 'll 'd along.

Contract: callers turn null into empty text, which has no pieces; an empty batch has none either; a text is cut whole, and the
work is linear in the characters. Repeated texts are cut again; equal pieces of a block are one distinct piece.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np

SPACE, LETTER, NUMBER, OTHER, END = range(5)
#: Between two texts; UTF-8 can't hold a lone surrogate, so no text contains it.
SEPARATOR = "\ud800"
CHARS = 1 << 19


@functools.cache
def classes() -> np.ndarray:
    import regex

    out = np.full(0x110000, OTHER, np.uint8)
    everything = "".join(map(chr, range(0x110000)))
    for code, pattern in ((SPACE, r"\s+"), (LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, everything):
            out[m.start() : m.end()] = code
    out[ord(SEPARATOR)] = END
    return out


def boundaries(chars: np.ndarray) -> np.ndarray:
    """Starts of the pieces of ``chars`` (code points, the last one a separator)."""
    c = classes()[chars]
    n = len(chars)
    start = np.empty(n, bool)
    start[0] = True
    start[1:] = (c[1:] != c[:-1]) | (c[1:] == END)
    space = c == SPACE
    before = np.flatnonzero(space[:-1] & (c[1:] != SPACE) & (c[1:] != END))  # the last of a run, before a character
    start[before] = True
    plain = before[chars[before] == 32]
    start[plain + 1] = False
    quote = np.flatnonzero(chars[:-1] == 39)
    if len(quote):
        quote = quote[start[quote] & (c[quote + 1] == LETTER)]
    if len(quote):
        padded = np.append(chars, [0, 0])
        a, b = padded[quote + 1], padded[quote + 2]
        one = np.isin(a, [ord(x) for x in "stmd"])
        two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        for hit, size in ((one, 2), (two & ~one, 3)):
            at = quote[hit]
            start[at + 1] = False
            start[at + size] = True
    return np.flatnonzero(start)


def pieces(texts: list[str], most: int = CHARS) -> Iterator[tuple[int, int, list[bytes], np.ndarray, np.ndarray]]:
    """For blocks of texts, about ``most`` code points each: first text, text after the last, the distinct UTF-8 pieces, which of them comes at each place, and where each text's places end."""
    first, total = 0, 0
    for i, t in enumerate(texts):
        total += len(t) + 1
        if total >= most or i == len(texts) - 1:
            yield (first, i + 1, *_split(texts[first : i + 1]))
            first, total = i + 1, 0


def _split(texts: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    joined = SEPARATOR.join(texts) + SEPARATOR
    chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    utf8 = joined.encode("utf-8", "surrogatepass")
    starts = boundaries(chars)
    marks = np.flatnonzero(chars[starts] == ord(SEPARATOR))
    at = np.flatnonzero((np.frombuffer(utf8, np.uint8) & 0xC0) != 0x80)[starts]  # of each piece in the bytes
    ends = np.append(at[1:], len(utf8))
    real = np.ones(len(starts), bool)
    real[marks] = False
    return *_distinct(utf8, at[real], ends[real]), marks - np.arange(len(marks))


_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _distinct(data: bytes, start: np.ndarray, end: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The distinct slices and which of them each one is. Up to 16 bytes are told apart by their first and last 8 and their size; longer ones, which are few, by a dictionary."""
    size = end - start
    words = np.ndarray((len(data) + 8,), "<u8", data + b"\0" * 16, 0, (1,))
    head = words[start] & _MASK[np.minimum(size, 8)]
    tail = np.where(size > 8, words[np.maximum(end - 8, 0)], 0).astype(np.uint64)
    long = np.flatnonzero(size > 16)
    if len(long):
        number: dict[bytes, int] = {}
        tail[long] = [number.setdefault(data[i:j], len(number)) for i, j in zip(start[long].tolist(), end[long].tolist(), strict=True)]
    kind = np.where(size > 16, 17, size).astype(np.uint64)
    h = head * _A ^ tail * _B ^ kind * _C
    h = (h ^ (h >> np.uint64(32))) * _A
    h ^= h >> np.uint64(29)
    order = np.argsort(h)  # any of the equal ones may lead, so the sort needn't be stable
    new = np.ones(len(h), bool)
    new[1:] = h[order[1:]] != h[order[:-1]]
    first, which = order[new], np.empty(len(h), np.int64)
    which[order] = np.cumsum(new) - 1
    leader = first[which]
    if not ((head[leader] == head) & (tail[leader] == tail) & (kind[leader] == kind)).all():  # two hashes met
        _, first, which = np.unique(np.stack([head, tail, kind], 1), axis=0, return_index=True, return_inverse=True)
    return [data[i:j] for i, j in zip(start[first].tolist(), end[first].tolist(), strict=True)], which.reshape(-1)
