"""Windows and longest matches by suffix arrays against plain loops over words."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from schemaweave.llm import decontaminate as D
from schemaweave.llm import words as W

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def split(text):
    return WORD.findall(lower(text))


def brute(texts, items, window=10):
    """Per text: words, spans of hit words, items."""
    out = []
    for text in texts:
        w, hit, held = split(text), set(), set()
        for i, t in items:
            v = split(t)
            n = min(window, len(v))
            wanted = {tuple(v[p : p + n]) for p in range(len(v) - n + 1)} if n else set()
            at = [p for p in range(len(w) - n + 1) if tuple(w[p : p + n]) in wanted] if n else []
            hit.update(p + k for p in at for k in range(n))
            held |= {i} if at and i is not None else set()
        out.append((len(w), sorted(hit), sorted(held)))
    return out


def brute_longest(texts, items):
    """Per item word: the greatest number of words from there on that stand together in a text."""
    out = {}
    for i, t in items:
        v = split(t)
        for p in range(len(v)):
            best = 0
            for text in texts:
                w = split(text)
                for a in range(len(w)):
                    n = 0
                    while a + n < len(w) and p + n < len(v) and w[a + n] == v[p + n]:
                        n += 1
                    best = max(best, n)
            if best:
                out[i, p] = max(out.get((i, p), 0), best)
    return out


def hits(row):
    return [p for s in row["spans"] for p in range(s["start"], s["stop"])]


class Held:
    def __init__(self, value):
        self.value = value


def random_case(seed, alphabet):
    r = random.Random(seed)
    some = lambda n: " ".join(r.choice(alphabet) for _ in range(n))
    items = [(r.randrange(5) if r.random() < 0.9 else None, some(r.choice([0, 1, 3, 9, 10, 11, 25]))) for _ in range(8)]
    texts = [some(r.choice([0, 1, 5, 30, 80])) for _ in range(25)]
    texts += [some(3) + " " + r.choice(items)[1] + " " + some(4) for _ in range(10)] + [texts[3], None, "", "?!"]
    return texts, items


def test_words_keep_to_their_texts():
    texts = ["Hello, Wörld 12a", "", None, "x", "y z", "ÀB\x00c", " end", "ab"]
    for a in (pa.array(texts), pa.array(texts).slice(2, 4), pa.array([], pa.string()), pa.array([None], pa.string())):
        w = W.words(a)
        v, s = [x.decode() for x in w.vocabulary.to_pylist()], w.starts()
        assert [[v[k] for k in w.ids[s[i] : s[i + 1]]] for i in range(len(a))] == [split(t) for t in a.to_pylist()]
        assert list(W.counted(a)) == list(w.counts)


@pytest.mark.parametrize("depth", [1, 2, 5, 40])
def test_suffix_order(depth):
    r = np.random.default_rng(depth)
    ids = r.integers(0, 3, 300).astype(np.int32)
    ids[-1] = 0
    ends = np.flatnonzero(ids == 0)
    left = ends[np.searchsorted(ends, np.arange(300))] - np.arange(300)
    got = D.suffix_order(ids, left, depth)
    word = lambda p: tuple(ids[p : min(p + depth, p + left[p])])
    assert sorted(got) == list(np.flatnonzero(ids)) and [word(p) for p in got] == sorted(word(p) for p in got)
    assert len(D.suffix_order(np.zeros(3, np.int32), np.zeros(3, int), depth)) == 0


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("size", [12, 60, 1 << 20])
def test_pieces_and_blocks(monkeypatch, seed, size):
    """Small shards, documents in overlapping pieces, and the items in two blocks give what loops give."""
    monkeypatch.setattr(D, "WORDS", size)
    texts, items = random_case(seed, "a b c d".split() if seed % 2 else [f"w{i}" for i in range(60)])
    blocks = [Held(D.Tests(items[:3])), Held(D.Tests(items[3:]))]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])
    schema = pa.schema([("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("vocabulary", pa.list_(pa.binary())), ("ids", pa.binary()), ("suffixes", pa.binary()), ("more", pa.bool_())])
    shards = list(D._shards(iter([batch]), 25, schema))
    of = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("item_ids", pa.list_(pa.int64())), ("longest", pa.int64())])
    rows = [r for b in D._found(iter(shards), blocks, of) for r in b.to_pylist()]
    assert [r["doc_id"] for r in rows] == list(range(len(texts)))
    assert [(r["n_words"], hits(r), r["item_ids"]) for r in rows] == brute(texts, items)
    where = pa.schema([(n, pa.int64()) for n in ("item_id", "item_word", "n_words", "doc_id", "doc_word")])
    found, named = {}, [x for x in items if x[0] is not None]
    for b in D._longest(iter(shards), blocks, where):
        for r in b.to_pylist():
            w = split(texts[r["doc_id"]])
            if r["item_id"] is not None:
                found[r["item_id"], r["item_word"]] = max(found.get((r["item_id"], r["item_word"]), 0), r["n_words"])
                held = {tuple(split(t)[r["item_word"] : r["item_word"] + r["n_words"]]) for i, t in named if i == r["item_id"]}
                assert tuple(w[r["doc_word"] : r["doc_word"] + r["n_words"]]) in held
    assert found == brute_longest(texts, named)


def test_tables(spark):
    """Nulls, repeated rows, clashing names, no items, no documents."""
    ten = "One two three four five six seven eight nine TEN"
    items = spark.createDataFrame([(1, ten), (1, "alpha beta"), (12, ten + " eleven"), (None, "omega"), (4, None), (5, "?!")], "item_id long, text string")
    rows = [(1, "x " + ten.lower()), (1, "x " + ten.lower()), (None, f"{ten}, eleven"), (3, None), (4, "Alpha  beta; omega"), (5, "alpha. gamma beta"), (6, "")]
    docs = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, n_words string, spans int")
    want = sorted(((i, *x) for (i, _), x in zip(rows, brute([t for _, t in rows], [(r.item_id, r.text) for r in items.collect()]), strict=True)), key=str)
    got = [r.asDict(recursive=True) for r in D.searched(docs, items).collect()]
    assert sorted(((r["doc_id"], r["n_words"], hits(r), r["item_ids"]) for r in got), key=str) == want
    digests = D.contamination_digests(docs, items)
    assert digests.where("contaminated").count() == 4 and {r.n_items for r in digests.where("doc_id = 1").collect()} == {2}
    kept = D.decontaminated(docs, items)
    assert kept.columns == docs.columns and sorted((r.doc_id, r.text) for r in kept.collect()) == [(3, None), (5, "alpha. gamma beta"), (6, "")]
    assert not D.contamination_digests(docs, items.limit(0)).where("contaminated").count() and D.contamination_digests(docs, items.limit(0)).count() == 7
    assert D.contamination_digests(docs.limit(0), items).count() == 0
    longest = {(r.item_id, r.item_word): (r.n_words, r.doc_id) for r in D.longest_matches(D.suffix_shards(docs, 11), D.test_blocks(items)).collect()}
    assert longest[12, 0] == (11, None) and longest[12, 1] == (10, None)
