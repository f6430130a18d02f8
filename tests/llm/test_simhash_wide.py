import random

import corpus_pipeline
from schemaweave.llm import simhash, simhash_wide


def brute_kept(rows):
    """Ids kept, by all pairs of shingle sets made of words themselves."""
    bags = []
    for _, text in rows:
        words = text.encode().lower().split()
        bags.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(bags):
        for j, b in enumerate(bags[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {rows[find(i)][0] for i in range(len(rows))}


def edited_rows():
    rng = random.Random(1)
    rows = [(0, ""), (1, " \n"), (2, "one two"), (3, "ONE  two"), (4, "one two three")]
    for _ in range(20):
        words = [f"w{rng.randrange(10_000)}" for _ in range(rng.choice([12, 60, 300]))]
        rows.append((len(rows), " ".join(words)))
        for _ in range(6):
            copy = list(words)
            for _ in range(rng.randrange(1, 2 + len(words) // 30)):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(10_000)}"
            rows.append((len(rows), " ".join(copy)))
    return rows


def test_stage_keeps_one_of_each_by_shingles(spark, smallest):
    """Copies with several edits are more than 3 bits of 64 apart."""
    rows = edited_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    assert {r.doc_id for r in stage(spark, docs, smallest).collect()} == brute_kept(rows)


def kept(docs):
    return simhash.keep_one_each(docs, words=5, similarity=0.8)


def test_keys_beyond_the_cap(spark, monkeypatch):
    """All shared keys are compared along their order first, then across components; postings leave a task's memory early."""
    monkeypatch.setattr(simhash_wide, "CAP", 2)
    monkeypatch.setattr(simhash_wide, "HELD", 4096)
    rows = edited_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id for r in kept(docs).collect()} == brute_kept(rows)


def test_keys_of_three_bytes(spark, monkeypatch):
    monkeypatch.setattr(simhash_wide, "SHAPES", simhash_wide.SHAPES[1:])
    rows = edited_rows()[:60]
    assert {r.doc_id for r in kept(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == brute_kept(rows)


def test_a_large_group_of_near_copies(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(w if rng.random() > 0.004 else f"e{rng.randrange(99)}" for w in words)) for i in range(300)]
    rows += [(1000 + i, " ".join(f"x{rng.randrange(10_000)}" for _ in range(80))) for i in range(100)]
    assert {r.doc_id for r in kept(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == brute_kept(rows)


def test_recall_at_the_similarity_itself():
    """Pairs of sets of similarity 0.8: at least 995 of 1,000 share a key."""
    import numpy as np

    rng = np.random.default_rng(2)
    width, size, groups = simhash_wide.SHAPES[0][1]
    met = 0
    for _ in range(1000):
        both, a, b = (rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (160, 20, 20))
        x, y = (np.frombuffer(simhash_wide.wide_fingerprint(np.unique(np.concatenate([both, own])), size * groups + 4), np.uint8) for own in (a, b))
        shared = (x == y)[: size * groups].reshape(groups, size).sum(1)
        met += shared.max() >= width and shared.sum() >= simhash_wide.MINIMUM
    assert met >= 995


def test_empty_table_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "x", 1), (2, "A b c  d e f", "y", 2), (3, None, None, None), (4, "", "z", 4)], "doc_id long, text string, node string, __dropped_id long")
    got = kept(docs)
    assert got.schema == docs.schema and sorted(r.doc_id for r in got.collect()) == [1, 3]
    assert kept(docs.where("false")).count() == 0


def test_rows_without_an_id_are_kept(spark):
    docs = spark.createDataFrame([(2, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (1, "a b c d e f"), (3, None)], "doc_id long, text string")
    assert sorted(r.doc_id or 0 for r in kept(docs).collect()) == [0, 1, 1, 3]
