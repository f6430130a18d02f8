"""Byte-level BPE encoding and decoding by recursive DuckDB queries, one connection per partition.

Texts are split by the public pattern; the distinct pieces that a partition hasn't met yet become rows of a DuckDB table.
A recursive query holds each piece's tokens, joins its token-position rows with the merge table (left id, right id, merged
id), finds the leftmost pair of minimum rank, contracts it, and goes on until no piece has a pair that merges. Decoding
joins (piece, position, id) rows with the vocabulary and aggregates the bytes in order of position.

Pieces longer than LONG bytes go through a second recursive query that contracts every non-overlapping occurrence of the
minimum-rank pair at once, where that equals doing them one after the other from the left: where no merge of the new token
outranks it. Else one pair at a time, as for the rest. So a piece of n equal letters takes about log n rounds and not n.

Contract: null text is empty text (no ids, the digests of nothing); rows are kept one for one, repeated ids and texts
included; the result only has the columns named here, whatever else the input has. Memory: the
cache of pieces holds about CACHE pieces at most; an Arrow batch is split into blocks of texts before it is cut into pieces.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import os
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import pretok
from .common import CLEAR, claim, id_text, shared_dir, slices

LONG, CACHE, MISSING = 64, 560_000, 20_000

ENCODE = """
WITH RECURSIVE bpe(wid, toks, round) AS (
    SELECT wid, toks, 0 FROM words
  UNION ALL
    SELECT b.wid, list_concat(list_concat(b.toks[1:p.pos - 1], [p.id]), b.toks[p.pos + 2:]), b.round + 1
    FROM bpe b JOIN (
        SELECT t.wid, min(m.id::BIGINT * 1048576 + t.pos) AS best, best // 1048576 AS id, best % 1048576 AS pos
        FROM (SELECT wid, unnest(range(1, len(toks))) AS pos, unnest(toks[1:len(toks) - 1]) AS l, unnest(toks[2:]) AS r FROM bpe) t
        JOIN merges m ON m.l = t.l AND m.r = t.r
        GROUP BY t.wid
    ) p ON p.wid = b.wid
)
SELECT wid, arg_max(toks, round) AS toks FROM bpe GROUP BY wid ORDER BY wid
"""

#: Each round rebuilds one piece's tokens from its rows: hits of the minimum rank, every other one of a run of adjacent hits.
ENCODE_LONG = """
WITH RECURSIVE bpe(wid, toks) USING KEY (wid) AS (
    SELECT wid, toks FROM words
  UNION
    SELECT wid, list(CASE WHEN hit THEN id ELSE tok END ORDER BY pos) FILTER (WHERE NOT gone) AS toks
    FROM (
        SELECT *, coalesce(lag(hit) OVER (PARTITION BY wid ORDER BY pos), false) AS gone
        FROM (
            SELECT wid, pos, tok, best AS id, cand AND CASE WHEN safe THEN (pos - start) % 2 = 0 ELSE pos = first END AS hit
            FROM (
                SELECT *, max(CASE WHEN NOT cand THEN pos ELSE 0 END) OVER (PARTITION BY wid ORDER BY pos) + 1 AS start,
                    min(CASE WHEN cand THEN pos END) OVER (PARTITION BY wid) AS first
                FROM (
                    SELECT *, coalesce(id = best, false) AS cand, coalesce(bool_or(safe_id AND id = best) OVER (PARTITION BY wid), false) AS safe
                    FROM (
                        SELECT t.wid, t.pos, t.tok, m.id, m.safe AS safe_id, min(m.id) OVER (PARTITION BY t.wid) AS best
                        FROM (SELECT wid, unnest(range(1, len(toks) + 1)) AS pos, unnest(toks) AS tok, unnest(list_append(toks[2:], -1)) AS nxt FROM bpe) t
                        LEFT JOIN merges m ON m.l = t.tok AND m.r = t.nxt
                    ) WHERE best IS NOT NULL
                )
            )
        )
    )
    GROUP BY wid
)
SELECT wid, toks FROM bpe ORDER BY wid
"""

DECODE = """
SELECT t.wid, string_agg(v.hex, '' ORDER BY t.pos) AS hex
FROM (SELECT wid, unnest(range(1, len(toks) + 1)) AS pos, unnest(toks) AS id FROM encoded) t JOIN vocab v ON v.id = t.id
GROUP BY t.wid ORDER BY t.wid
"""


@functools.cache
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.cache
def merge_table(path: str) -> pa.Table:
    """Every (left id, right id) whose bytes together are a token; safe: no merge with that token as a part has a smaller id."""
    of, rows = ranks(path), []
    unsafe = set()
    for token, rank in of.items():
        for i in range(1, len(token)):
            left, right = of.get(token[:i]), of.get(token[i:])
            if left is not None and right is not None:
                rows.append((left, right, rank))
                unsafe.update(x for x in (left, right) if x > rank)
    left, right, rank = zip(*rows, strict=True)
    return pa.table({"l": pa.array(left, pa.int32()), "r": pa.array(right, pa.int32()), "id": pa.array(rank, pa.int32()), "safe": pa.array([x not in unsafe for x in rank])})


class PieceCoder:
    """Encodes and decodes distinct pieces; one per Python worker and vocabulary, kept between partitions."""

    def __init__(self, path: str, spill: str = ""):
        import duckdb

        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "temp_directory": spill})
        self.db.execute("SET enable_progress_bar = false")
        of = ranks(path)
        self.db.register("merge_rows", merge_table(path))
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merge_rows")
        self.db.register("vocab_rows", pa.table({"id": pa.array(of.values(), pa.int32()), "hex": [k.hex() for k in of]}))
        self.db.execute("CREATE TABLE vocab AS SELECT * FROM vocab_rows")
        self.byte = np.array([of[bytes([i])] for i in range(256)], np.int32)
        self.whole = of
        self.cache: dict[bytes, tuple[int, str, bytes]] = {}
        self.old: dict[bytes, tuple[int, str, bytes]] = {}

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """Token ids of each piece."""
        out: list = [None] * len(words)
        for sql, chosen in ((ENCODE, [i for i, w in enumerate(words) if len(w) <= LONG]), (ENCODE_LONG, [i for i, w in enumerate(words) if len(w) > LONG])):
            if not chosen:
                continue
            some = [words[i] for i in chosen]
            offsets = np.concatenate([[0], np.cumsum([len(w) for w in some])]).astype(np.int32)
            toks = pa.ListArray.from_arrays(pa.array(offsets), pa.array(self.byte[np.frombuffer(b"".join(some), np.uint8)]))
            self.db.register("word_rows", pa.table({"wid": pa.array(chosen, pa.int32()), "toks": toks}))
            self.db.execute("CREATE OR REPLACE TEMP TABLE words AS SELECT * FROM word_rows")
            got = self.db.sql(sql).to_arrow_table()
            for i, ids in zip(got["wid"].to_pylist(), got["toks"].to_pylist(), strict=True):
                out[i] = ids
        return out

    def decode(self, ids: list[list[int]]) -> list[bytes]:
        """Bytes of each list of token ids."""
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
        flat = pa.array([y for x in ids for y in x], pa.int32())
        self.db.register("encoded", pa.table({"wid": pa.array(range(len(ids)), pa.int32()), "toks": pa.ListArray.from_arrays(pa.array(offsets), flat)}))
        out = [b""] * len(ids)
        got = self.db.sql(DECODE).to_arrow_table()
        for i, h in zip(got["wid"].to_pylist(), got["hex"].to_pylist(), strict=True):
            out[i] = bytes.fromhex(h)
        return out

    def learn(self, words: list[bytes]) -> None:
        """Put those of the distinct pieces that the cache lacks into it, MISSING pieces to a query. A full cache is put aside and only what is met again comes back, so that common pieces stay."""
        if len(self.cache) > CACHE // 2:
            self.old, self.cache = self.cache, {}
        old, young = self.old, self.cache
        for w in words:
            if w not in young and w in old:
                young[w] = old[w]
        new = [w for w in words if w not in young]
        for k in range(0, len(new), MISSING):
            some = new[k : k + MISSING]
            ids = self.encode(some)
            for w, i, back in zip(some, ids, self.decode(ids), strict=True):
                self.cache[w] = (len(i), ",".join(map(str, i)), w if back == w else back)


@functools.cache
def coder(path: str, spill: str = "") -> PieceCoder:
    """``spill``: a folder for what a query over very long pieces can't hold in memory; none if empty."""
    if spill:
        os.makedirs(spill, exist_ok=True)
    return PieceCoder(path, f"{spill}/{uuid.uuid4().hex}" if spill else "")


CLEAR["bpe"] = coder.cache_clear


def bpe_digests(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 (of the decoded bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("bpe")
        c = coder(ranks_path, spill)
        for batch in slices(batches):
            n, ids_sha, decoded_sha = [], [], []
            for _, _, words, places, ends in pretok.pieces(batch["text"].to_pylist()):
                c.learn(words)
                found = [c.cache[w] for w in words]
                sizes, ids, decoded = np.array([x[0] for x in found], np.int64), [x[1] for x in found], [x[2] for x in found]
                totals, start = np.concatenate([[0], np.cumsum(sizes[places])]), 0
                for end in ends.tolist():
                    own = places[start:end].tolist()
                    n.append(int(totals[end] - totals[start]))
                    ids_sha.append(hashlib.sha256(",".join([ids[i] for i in own]).encode()).hexdigest())
                    decoded_sha.append(hashlib.sha256(b"".join([decoded[i] for i in own])).hexdigest())
                    start = end
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(decoded_sha)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    spill = shared_dir(docs.sparkSession)  # DuckDB writes to file systems only
    spill = re.sub("^file:/*", "/", spill) + "/duckdb" if re.match("/|file:", spill) else ""
    docs = id_text(docs, id_col, text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
