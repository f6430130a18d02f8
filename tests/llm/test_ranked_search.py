"""Block-Max WAND against scoring every document, and its posting blocks."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from schemaweave.llm import ranked_search as R

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    """docs, items: (id, text)."""
    counted = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, total = sum(bool(c) for _, c in counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, ts in asked.items():
        rows = []
        for i, c in counted:
            m = 10 + 90 * c.total() * n_docs // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in ts if c[t])
            if score > 0:
                rows.append((-score, i is None, i or 0))
        out += [(item, rank, None if null else i, -s) for rank, (s, null, i) in enumerate(sorted(rows)[:k], 1)]
    return sorted(out, key=str)


def corpus(seed, n):
    r = random.Random(seed)
    words = [f"w{int(r.paretovariate(0.6)) % 300}" for _ in range(4000)]
    docs = [(i, " ".join(r.choice(words) for _ in range(r.choice([1, 5, 40, 200])))) for i in range(n)]
    items = [(j, " ".join(r.choice(words) for _ in range(r.choice([1, 4, 25])))) for j in range(20)]
    return docs, items


def test_packed_numbers():
    r = np.random.default_rng(1)
    v = np.concatenate([[0, 127, 128, 16383, 16384, 2**31, 2**55], r.integers(0, 1 << 40, 500)])
    data, begin = R.packed(v)
    assert R.unpacked(data).tolist() == v.tolist() and begin[-1] == len(data)
    assert R.unpacked(data[begin[3] : begin[9]]).tolist() == v[3:9].tolist()
    assert len(R.packed(v[:0])[0]) == len(R.unpacked(R.packed(v[:0])[0])) == 0


@pytest.mark.parametrize("block", [1, 3, 128])
@pytest.mark.parametrize("most", [1, 3000, 1 << 30])
def test_blocks_and_shards(monkeypatch, block, most):
    """One posting to a block and one document to a shard give what scoring everything gives, and blocks stay closed."""
    monkeypatch.setattr(R, "BLOCK", block)
    docs, items = corpus(block, 260)
    docs += [(3, docs[3][1]), (None, docs[4][1]), (9, None), (10, "?!"), (11, docs[200][1])]
    n_docs, total = sum(bool(terms(t)) for _, t in docs), sum(len(terms(t)) for _, t in docs)
    batches = [pa.RecordBatch.from_arrays([pa.array([i for i, _ in part], pa.int64()), pa.array([t for _, t in part], pa.string())], ["doc_id", "text"]) for part in (docs[:100], docs[100:])]
    rows = [r for b in R._indexed(iter(batches), n_docs, total, most) for r in b.to_pylist()]
    df = Counter()
    for r in rows:
        df[r["term"]] += r["df"]
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items() if t}
    tops = [R.Top() for _ in items]
    opened = blocks = 0
    for shard in sorted({r["shard"] for r in rows}):
        mine = [r for r in rows if r["shard"] == shard]
        assert mine[0]["term"] == ""
        lists = R.Lists(mine[0]["blocks"], mine[0]["postings"], n_docs, total)
        for r in mine[1:]:
            lists.add(r["term"], r["blocks"], r["postings"])
        for (_, text), top in zip(items, tops, strict=True):
            R.block_max_wand(lists, {t: weight[t] for t in set(terms(text)) if t in weight}, top)
        opened, blocks = opened + lists.opened, blocks + sum(map(len, lists.blocks.values()))
    got = [(item, rank, None if null else i, s) for (item, _), top in zip(items, tops, strict=True) for rank, (s, null, i) in enumerate(top.rows, 1)]
    assert sorted(got, key=str) == brute(docs, items)
    assert opened < blocks


def test_low_bounds_stay_closed():
    """A document that holds all of an item's rare terms sets the threshold; the frequent term's other blocks are never decompressed."""
    docs = [(i, "common " * (1 if i else 2) + ("rare rarer rarest" if i == 0 else f"x{i}")) for i in range(2000)]
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in docs], pa.int64()), pa.array([t for _, t in docs])], ["doc_id", "text"])
    rows = [r for b in R._indexed(iter([batch]), 2000, 6000, 1 << 30) for r in b.to_pylist()]
    lists = R.Lists(rows[0]["blocks"], rows[0]["postings"], 2000, 6000)
    for r in rows[1:]:
        lists.add(r["term"], r["blocks"], r["postings"])
    top = R.Top(1)
    R.block_max_wand(lists, {"common": 5, "rare": 7000, "rarer": 7000, "rarest": 7000}, top)
    assert top.rows[0][2] == 0 and lists.opened == 4 and len(lists.blocks["common"]) == 16


def test_tables(spark):
    docs, items = corpus(5, 120)
    docs += [(3, docs[3][1]), (None, docs[4][1]), (None, None), (7, "")]
    items += [(0, "w1 extra"), (None, items[1][1]), (50, None), (51, "!?")]
    d = spark.createDataFrame([(*x, "k", 2) for x in docs], "doc_id long, text string, term string, shard int").repartition(5)
    q = spark.createDataFrame(items, "item_id long, text string")
    assert sorted((tuple(r) for r in R.ranked(d, q).collect()), key=str) == brute(docs, items)
    for a, b in ((d.limit(0), q), (d, q.limit(0))):
        assert R.ranked(a, b).count() == 0


def test_items_in_several_blocks(spark, monkeypatch):
    docs, items = corpus(6, 60)
    monkeypatch.setattr(R.item_blocks, "__defaults__", (60, "item_id", "text"))
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert len(list(R.item_blocks(q))) > 3
    assert sorted((tuple(r) for r in R.ranked(d, q, 4).collect()), key=str) == brute(docs, items, 4)
