import hashlib
import random
import re

import numpy as np
import pytest

from schemaweave.llm import components, simhash, suffix_dedup
from schemaweave.llm import suffix_dedup as S


def brute_print(text):
    import xxhash

    raw = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    w = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    sh = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hs = [xxhash.xxh64_intdigest(x, 42) for x in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(prints):
    """id by id over all pairs."""
    ids = list(range(len(prints)))
    label = ids.copy()
    changed = True
    while changed:
        changed = False
        for i in ids:
            for j in ids:
                if bin(prints[i] ^ prints[j]).count("1") <= 3 and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


def test_fingerprints_and_components(spark):
    rng = random.Random(4)
    base = ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 4))) for _ in range(60)]
    texts = [None, "", " \n", "One", "one", "one TWO", "É é x y z"]
    for _ in range(60):
        t = rng.choices(base, k=rng.randint(3, 120))
        texts.append(" ".join(t))
        for _ in range(rng.randint(0, 2)):
            u = t.copy()
            u[rng.randrange(len(u))] = rng.choice(base)
            texts.append("  ".join(u))
    rows = [(i, t, "x", "y") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id string")
    got = {r.doc_id: r for r in simhash.simhash_components(df).collect()}
    prints = [brute_print(t) for t in texts]
    assert [int(got[i].fingerprint, 16) for i in range(len(texts))] == prints
    assert [got[i].component_id for i in range(len(texts))] == brute_components(prints)
    kept = simhash.keep_one_each(df)
    assert kept.schema == df.schema
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(brute_components(prints)))
    assert simhash.simhash_components(df.where("false")).count() == 0


def test_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(4, "a b c d"), (4, "a b c d"), (None, "a b c d"), (9, "a b c d"), (None, "q")], "doc_id long, text string")
    got = simhash.simhash_components(df).collect()
    assert len(got) == 5 and [r.component_id for r in got if r.doc_id == 9] == [4]
    assert sorted(str(r.doc_id) for r in simhash.keep_one_each(df).collect()) == ["4", "4", "None", "None"]


@pytest.mark.parametrize("cap", [4, 1024])
def test_links_of_crowded_keys(spark, monkeypatch, cap):
    """A ball of near fingerprints and random ones: the same components whether keys are dealt again or not."""
    monkeypatch.setattr(simhash, "CAP", cap)
    rng = random.Random(8)
    centre, prints = rng.getrandbits(64), set()
    for _ in range(300):
        x = centre
        for b in rng.sample(range(64), rng.randint(0, 3)):
            x ^= 1 << b
        prints.add(x)
    prints |= {rng.getrandbits(64) for _ in range(100)}
    prints = sorted(prints)
    keyed = simhash._expand(spark.createDataFrame([(0, simhash._signed(p)) for p in prints], "mask long, fp long"), 0)
    del keyed
    df = spark.createDataFrame([(simhash._signed(p),) for p in prints], "fp long")
    roots = {r.node: r.root for r in components.components(simhash.links(df)).collect()}
    label = brute_components(prints)
    mine = {}
    for p, want in zip(prints, label, strict=True):
        mine.setdefault(want, set()).add(roots.get(simhash._signed(p), simhash._signed(p)))
    assert all(len(x) == 1 for x in mine.values())
    assert len({next(iter(x)) for x in mine.values()}) == len(mine)


def test_three_levels_of_keys_lose_no_pair():
    """Any 3 of 64 bits leave a key of every level untouched."""
    rng = random.Random(9)
    for _ in range(300):
        bits, mask = rng.sample(range(64), 3), 0
        for level in range(3):
            unit = 8 >> level
            free = [b for b in range(64) if not mask >> b & 1]
            wide = [mask | sum(1 << b for g in plane for b in free[g * unit : (g + 1) * unit]) for plane in simhash.PLANES]
            ok = [m for m in wide if not any(m >> b & 1 for b in bits)]
            assert ok
            mask = rng.choice(ok)


def test_components_of_a_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components.components(e).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}
    assert components.components(e.where("false")).count() == 0


def brute_passages(rows, length=100):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                gone[p : p + length] = True
            seen.add(w)
        edge = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        out[i] = (len(b), int(gone.sum()), int((edge == 1).sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest())
    return out


def passages_corpus():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    shared, rows = [prose(rng.randint(10, 60)) for _ in range(10)], []
    for i in range(150):
        r = rng.random()
        if r < 0.45 and rows:
            x = rng.choice(rows)[1] or ""
            k = rng.randint(0, len(x))
            x = x if r < 0.2 else x[:k] + rng.choice(["", "X", " yy "]) + x[k + rng.randint(0, 3) :]
        else:
            x = " ".join(rng.choice([prose(rng.randint(0, 30)), rng.choice(shared)]) for _ in range(rng.randint(0, 6)))
        rows.append((i * 3, x))
    return rows + [(5000, None), (5001, ""), (5002, "a" * 700), (5003, "a" * 300), (5004, "ab" * 300), (5005, " " * 99), (5007, "é" * 200), (None, prose(80)), (5009, "a" * 101)]


def test_passages_match_brute_force(spark):
    rows = passages_corpus()
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, place string").repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.passage_digests(df).collect()}
    assert got == brute_passages(rows)
    assert suffix_dedup.passage_digests(df.where("false")).count() == 0


def test_one_line_in_many_surroundings(spark):
    rng = random.Random(8)
    some = lambda: "".join(rng.choices("abcdefgh ", k=rng.randint(0, 90)))
    line, before, behind = "the one line that very many of the documents share", [some() for _ in range(60)], [some() for _ in range(60)]
    rows = [(i, rng.choice(before) + line[rng.choice([0, 0, 9]) :] + rng.choice(behind)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {r.doc_id: tuple(r)[1:] for r in suffix_dedup.passage_digests(df).collect()} == brute_passages(rows)


def test_surroundings_of_an_anchor_are_dealt_by_its_sides():
    import pyarrow as pa
    import zstandard

    for back in range(69):
        for count in range(1, back + 2):
            parts = list(S._sides(back, count))
            assert sorted(k for _, first, n in parts for k in range(first, first + n)) == list(range(count))
            assert all((back - k >= S.SIDE) == left for left, first, n in parts for k in (first, first + n - 1))
    rng = random.Random(9)
    texts = [bytes(rng.choices(b"abcd", k=68)) + b"k" * 32 + bytes(rng.choices(b"abcd", k=68)) for _ in range(200)]
    wanted = [[{"h": -5, "place": 0, "back": 68, "count": 69}]] * len(texts)
    kind = pa.list_(pa.struct([("h", pa.int64()), ("place", pa.int64()), ("back", pa.int16()), ("count", pa.int16())]))
    batch = pa.RecordBatch.from_arrays([pa.array(range(200)), pa.array([zstandard.compress(t) for t in texts]), pa.array(wanted, kind)], ["doc_id", "bytes", "wanted"])
    (rows,) = S._fetch_rows(iter([batch]))
    assert len(rows) == len(set(rows["h"].to_pylist())) == 400


def test_repeated_rows_are_one_document(spark):
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_removed) for r in suffix_dedup.passage_digests(df).collect())
    assert got == [(1, 0), (1, 0), (2, len(text))]


def test_kept_texts_have_whole_characters(spark):
    rows = passages_corpus()
    df = spark.createDataFrame([(i, t, 0, "s") for i, t in rows], "doc_id long, text string, n_chars long, rest string")
    out = suffix_dedup.without_repeats(df)
    assert out.schema == df.schema
    for r in out.collect():
        assert r.n_chars == len(r.text)
    assert S.kept_text("aéb".encode(), [(2, 4)]) == "aé" and S.kept_text("aéb".encode(), [(1, 3)]) == "ab"


def test_long_documents_go_through_in_blocks(monkeypatch):
    import pyarrow as pa

    rng = random.Random(6)
    text = "".join(rng.choice("abcd ") for _ in range(5000))
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([1], pa.int64()), "text": [text]})

    def windows(rows):
        return sorted((int(p) & (1 << 40) - 1) + k for b in rows for p, n in zip(b["place"].to_pylist(), b["count"].to_pylist(), strict=True) for k in range(n))

    whole = windows(S._anchor_rows(iter([batch])))
    monkeypatch.setattr(S, "BLOCK", 700)
    assert windows(S._anchor_rows(iter([batch]))) == whole == list(range(5000 - 99))


def test_deep_shallow_order():
    rng = random.Random(7)
    some = [bytes(rng.choices(b"ab\0", k=rng.randint(0, 30))) for _ in range(500)]
    deep = [b"p" * 90 + bytes(rng.choices(b"xy", k=rng.randint(0, 12))) for _ in range(400)]
    for strings in (some, deep, some + deep, [b"same"] * 50, [b""], []):
        order = S.deep_shallow(strings, 72)
        assert [strings[i] for i in order] == sorted(strings)
        if len(strings) > 1:
            lcp = S.common_prefixes(strings, order)
            s = sorted(strings)
            assert lcp[1:].tolist() == [S.common(a, b) for a, b in zip(s, s[1:], strict=False)]
