"""Failure masks, duplicates across partition borders and the audit's counters against plain loops."""

import itertools
import random
import re

import pyarrow as pa
import pytest

from schemaweave.llm import filter_audit as A


def brute_mask(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    return sum(bool(c) << k for k, c in enumerate((len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), re.search(r"[#$%&*|]", t))))


def brute_masks(rows):
    ids = {}
    for i, t, _ in rows:
        ids.setdefault(t or "", []).append(i)
    least = {t: min((x for x in v if x is not None), default=None) for t, v in ids.items()}
    again = lambda i, t: least[t or ""] is not None and (i is None or least[t or ""] < i)
    return [(i, p or "", brute_mask(t) | (16 if again(i, t) else 0)) for i, t, p in rows]


def brute_audit(rows, labels):
    """The filters applied one after the other, in every order."""
    masks = brute_masks(rows)
    good, toxic = ({d for d, *x in labels if d is not None and x[k] == 1} for k in (0, 1))
    out = {}
    for part in {p for _, p, _ in masks}:
        mine = [(i, m) for i, p, m in masks if p == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                bit = 1 << "ABCDE".index(f)
                gone, kept = [x for x in left if x[1] & bit], [x for x in left if not x[1] & bit]
                failing = [x for x in mine if x[1] & bit]
                out[part, order, step] = [len(kept), len(gone), len(failing) - len(gone), sum(m == bit for _, m in mine), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
                left = kept
    for part in {p for _, p, _ in masks}:
        for f in "ABCDE":
            mine = [k for k in out if k[0] == part and k[1][k[2] - 1] == f]
            total = sum(out[k][1] for k in mine)
            for k in mine:
                out[k].append(total)
    return out


TEXTS = ["", None, "short Text", "ALL BIG", "a# b", "word " * 250, " ".join(f"w{i}" for i in range(220)), "x\x0by\x1cz é漢 A", "tab\tand\nline ", "%" * 3]


def test_masks():
    rng = random.Random(3)
    texts = TEXTS + ["".join(rng.choice("aAB #\t\n\x1cé漢") for _ in range(rng.randrange(60))) * rng.choice([1, 30]) for _ in range(200)]
    for a in (pa.array(texts, pa.string()), pa.array(texts, pa.string()).slice(5, 90), pa.array([], pa.string())):
        assert A.text_failures(a).tolist() == [brute_mask(t) for t in a.to_pylist()]


@pytest.mark.parametrize("partitions", ["1", "3", "40"])
def test_duplicates_across_borders(spark, partitions):
    """A third of the rows share a text, ids repeat, some are null; wherever the borders fall, the same rows fail E."""
    rng = random.Random(int(partitions))
    rows = [(rng.choice([None, rng.randrange(60)]), rng.choice(TEXTS) if k % 3 else "hot text", rng.choice(["en", "de", None, ""])) for k in range(240)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, failed int, fp string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = [tuple(r) for r in A.failures(docs).select("doc_id", "part", "failed").collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(got, key=str) == sorted(brute_masks(rows), key=str)


def test_equal_fingerprints_of_different_texts():
    """Rows as a partition may get them when fingerprints collide; the ends tell each text's least id."""
    rows = [(7, 3, "a"), (7, 5, "a"), (7, 2, "b"), (7, 4, "b"), (7, None, "b")]
    batch = pa.RecordBatch.from_arrays([pa.array([i for _, i, _ in rows], pa.int64()), pa.array(["p"] * 5), pa.array([t for *_, t in rows]), pa.array([f for f, *_ in rows], pa.int64())], ["doc_id", "part", "text", "fp"])
    out = [r for b in A._marks(iter([batch])) for r in b.to_pylist()]
    assert [bool(r["failed"] & 16) for r in out if not r["border"]] == [False, True, False, True, True]
    assert [(r["doc_id"], r["fp"]) for r in out if r["border"]] == [(3, 7), (2, 7)]
    assert list(A._marks(iter([]))) == []


def test_audit(spark):
    rng = random.Random(9)
    rows = [(i if i % 11 else None, rng.choice(TEXTS) if i % 2 else f"{rng.choice(TEXTS)} {i}", rng.choice(["en", "de", None])) for i in range(90)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 90, 2)] + [(4, 1, 0), (None, 1, 1), (999, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    got = {(r.part, r.filter_order, r.step): [r[n] for n in names] for r in A.interactions(docs, table).collect()}
    assert got == brute_audit(rows, labels)
    assert A.interactions(docs.limit(0), table).count() == 0
    assert {r.good_lost for r in A.interactions(docs, table.limit(0)).collect()} == {0}
