"""SimHash fingerprints and their components at a Hamming distance of 3 or less.

Candidates come from an inverted index over byte positions with count filtering. Fingerprints at most 3 bits apart share at
least 5 of their 8 positional bytes, whichever 3 positions differ. The posting lists of single bytes would each hold 1/256
of all fingerprints, so the index keys are sets of four positional bytes: 14 sets (the planes of the affine geometry of 8
points) such that any 3 positions lie outside at least one of them. Fingerprints under one key are compared: shared
positional bytes are tallied per pair, pairs with 5 or more are retained, and the Hamming distance verifies them.

A key that more than CAP distinct fingerprints share is dealt out again by the same 14 sets over the eight nibbles of the
bits left open, and once more over the eight 2-bit groups below those; a key of the last level can hold 256 fingerprints at
most. So the work under a key is bounded, no pair is lost, and of each key's links only a spanning forest is emitted.

Contract: exact copies share a fingerprint and meet before any comparison, in a partial aggregate. Null text is empty text;
texts without words have the fingerprint zero and link like any other. Rows are kept one for one; null ids keep their row
and count for no component_id (null if a component has no other); extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash_wide
from .common import claim, id_text, parallelism, slices, staged
from .components import components

CAP = 1024
#: The 14 planes of AG(3, 2): any three of the eight points lie in exactly one; its complement is a plane too.
PLANES = [[x for x in range(8) if bin(a & x).count("1") % 2 == c] for a in range(1, 8) for c in (0, 1)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def fingerprint(text: str, words: int = 3) -> int:
    import xxhash

    tokens = text.encode().lower().split()  # bytes.lower() is A-Z, bytes.split() the six ASCII white spaces
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens])
    n = max(1, len(tokens) - words + 1)
    starts = np.concatenate([[0], ends[: n - 1]]).tolist()
    stops = (ends[-n:] - 1).tolist()
    h = xxhash.xxh64_intdigest
    hashes = np.fromiter((h(joined[i:j], 42) for i, j in zip(starts, stops, strict=True)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for k in range(0, n, 4096):
        ones += np.unpackbits(hashes[k : k + 4096].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("simhash")
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([_signed(fingerprint(t, words)) for t in batch["text"].to_pylist()], pa.int64())], ["doc_id", "fp"])

    docs = id_text(docs, id_col, text_col)
    return docs.mapInArrow(run, f"doc_id {docs.dtypes[0][1]}, fp long")


def _expand(rows: DataFrame, level: int) -> DataFrame:
    """(mask, key, fp) of the next level: mask grows by half of the bits that are still open."""
    unit = 8 >> level  # bits in each of the eight groups of open bits

    def widen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {}
        for batch in batches:
            masks, fps = np.asarray(batch["mask"]), np.asarray(batch["fp"]).view(np.uint64)
            for mask in np.unique(masks).tolist():
                if mask not in seen:
                    free = [b for b in range(64) if not mask >> b & 1]
                    seen[mask] = np.array([(mask % (1 << 64)) | sum(1 << b for g in plane for b in free[g * unit : (g + 1) * unit]) for plane in PLANES], np.uint64)
                own = fps[masks == mask]
                for wide in seen[mask]:
                    key = own & wide
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), wide).view(np.int64)), pa.array(key.view(np.int64)), pa.array(own.view(np.int64))], ["mask", "key", "fp"])

    return rows.select("mask", "fp").mapInArrow(widen, "mask long, key long, fp long")


def _forest(fps: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of fingerprints sorted by run (a key): pairs (fingerprint, a fingerprint it is linked with, directly or through others) that connect what links."""
    n = len(fps)
    label = np.arange(n)
    left, right = [], []
    here = np.arange(n)
    for k in range(1, n):
        here = here[here + k < n]
        here = here[run[here] == run[here + k]]
        if not len(here):
            break
        x = fps[here] ^ fps[here + k]
        shared = (x.view(np.uint8).reshape(-1, 8) == 0).sum(1)  # positional bytes in common
        hit = here[(shared >= 5)]
        hit = hit[np.bitwise_count(fps[hit] ^ fps[hit + k]) <= 3]
        left.append(hit)
        right.append(hit + k)
    if not left:
        return fps[:0], fps[:0]
    a, b = np.concatenate(left), np.concatenate(right)
    while True:
        least = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        label = label[label]
        if (label == before).all():
            break
    odd = np.flatnonzero(label != np.arange(n))
    return fps[odd], fps[label[odd]]


def _compare(keyed: DataFrame, last: bool) -> DataFrame:
    """Rows (fp, other, mask): links, mask null; and, unless ``last``, the fingerprints of keys beyond CAP, other null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(fps: np.ndarray, runs: np.ndarray) -> pa.RecordBatch:
            a, b = _forest(fps, runs)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.nulls(len(a), pa.int64())], ["fp", "other", "mask"])

        def over(mask: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(fps.view(np.int64)), pa.nulls(len(fps), pa.int64()), pa.array(mask)], ["fp", "other", "mask"])

        mask, key, fps = (np.zeros(0, t) for t in (np.int64, np.int64, np.uint64))
        beyond = None  # the key that has been found to hold more than CAP
        for batch in batches:
            mask, key, fps = np.concatenate([mask, np.asarray(batch["mask"])]), np.concatenate([key, np.asarray(batch["key"])]), np.concatenate([fps, np.asarray(batch["fp"]).view(np.uint64)])
            new = np.concatenate([[True], (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])])
            runs = np.cumsum(new) - 1
            sizes = np.bincount(runs)
            big = np.zeros(len(sizes), bool) if last else sizes > CAP
            big[0] |= (mask[0], key[0]) == beyond
            done = np.ones(len(sizes), bool)
            done[-1] = big[-1]  # the last key may go on in the next batch
            beyond = (mask[-1], key[-1]) if big[-1] else None
            out = big[runs]
            if out.any():
                yield over(mask[out], fps[out])
            out = ~out & done[runs]
            if out.any():
                yield links(fps[out], runs[out])
            rest = ~done[runs]
            mask, key, fps = mask[rest], key[rest], fps[rest]
        if len(fps):
            yield links(fps, np.zeros(len(fps), np.int64))

    dealt = keyed.repartition(parallelism(keyed.sparkSession), "mask", "key").sortWithinPartitions("mask", "key", "fp")
    return dealt.mapInArrow(run, "fp long, other long, mask long")


def links(distinct: DataFrame) -> DataFrame:
    """(a, b) long pairs that connect all fingerprints (fp) of the same component."""
    rows, out = distinct.select(F.lit(0).cast("long").alias("mask"), "fp"), None
    for level in range(3):
        found = staged(_compare(_expand(rows, level), level == 2), f"links{level}")
        mine = found.where("mask is null").select(F.col("fp").alias("a"), F.col("other").alias("b"))
        out = mine if out is None else out.union(mine)
        rows = found.where("mask is not null").select("mask", "fp").distinct()
        if level == 2 or rows.isEmpty():
            return out


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id of its component)."""
    prints = staged(fingerprints(docs, id_col, text_col, words), "fingerprints")
    classes = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = components(links(classes.select("fp")), "fp-components")
    classes = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    of = staged(classes.join(least, "root").select("fp", "component_id"), "component-ids")
    return prints.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, similarity: float | None = None) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component, all columns. Rows that repeat one id are one document; rows without an id are kept.

    Without a similarity, components are those of 64-bit fingerprints; with one, of wide fingerprints verified by the shingle sets."""
    found = simhash_components(docs, id_col, text_col, words) if similarity is None else simhash_wide.near_components(docs, id_col, text_col, words, similarity)
    drop = found.where("doc_id <> component_id").select(F.col("doc_id").alias("__dropped_id")).distinct()
    return docs.join(drop, docs[id_col] == drop["__dropped_id"], "left_anti")
