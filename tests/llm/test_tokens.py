import hashlib
import random
import zlib

import numpy as np
import pytest

from schemaweave.llm import bpe_sql, huffman_ids, pretok

P = pytest.importorskip("public_tokenizers")
RANKS, BYTES = P.path("byte_bpe_multi_50k.tiktoken"), P.path("byte_bpe_50k.json")
ROWS = [(3, "Hello  world's\n\n 'tis café 漢字😀 123abc"), (1, ""), (2, None), (5, "x" * 3000 + " " * 900 + "=" * 77), (5, "twice"), (5, "twice"), (None, "no id"), (9, "<|endoftext|> \\n '''re don't")]


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id long, text string, n_tokens int, ids string")


def test_pieces_equal_the_pattern():
    import regex

    rng, pat = random.Random(1), regex.compile(P.PATTERN)
    texts = ["".join(rng.choice("ab'srtvemlld  \n\t  1٣²x!?éß漢😀 \x1c.,") for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    seen = 0
    for first, last, words, places, ends in pretok.pieces(texts):
        start = 0
        for text, end in zip(texts[first:last], ends, strict=True):
            assert [words[i].decode() for i in places[start:end]] == pat.findall(text)
            start, seen = end, seen + 1
    assert seen == len(texts)


def test_bpe_equals_tiktoken(spark):
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe_sql.ranks(RANKS), special_tokens={})
    got = bpe_sql.bpe_digests(frame(spark), RANKS).collect()
    want = []
    for i, t in ROWS:
        ids = enc.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert bpe_sql.bpe_digests(frame(spark, []), RANKS).count() == 0


def test_long_pieces_equal_tiktoken():
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe_sql.ranks(RANKS), special_tokens={})
    rng, c = random.Random(2), bpe_sql.coder(RANKS)
    for w in (b"a" * 999, b"ab" * 200, "é".encode() * 120, bytes(rng.choices(b"etaoinsh", k=400)), bytes(rng.choices(range(256), k=300))):
        ids = c.encode([w])[0]
        assert ids == enc._encode_single_piece(w)
        assert c.decode([ids]) == [w]


def test_token_files(spark):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(BYTES)
    got = huffman_ids.token_id_digests(frame(spark), BYTES).collect()
    rows = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want, start = [], 0
    for i, t in rows:
        ids = [*tk.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert huffman_ids.token_id_digests(frame(spark, []), BYTES).count() == 0


def test_files_are_read_by_nothing_but_their_path(spark, tmp_path):
    import subprocess
    import sys

    path = f"file://{tmp_path}/ids"
    assert huffman_ids.write_ids(frame(spark), BYTES, path=path) == path
    code = {r.id: r.length for r in spark.read.parquet(f"{path}/code").collect()}
    assert 0 in code and sum(2.0**-n for n in code.values()) <= 1
    script = f"""
from pyspark.sql import SparkSession
from schemaweave.llm import huffman_ids
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
for r in huffman_ids.read_ids(spark, {path!r}).orderBy("start").collect():
    print("row", r.doc_id, r.start, r.n_tokens, r.ids_crc32)
"""
    out = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, timeout=300, check=True).stdout
    here = [f"row {r.doc_id} {r.start} {r.n_tokens} {r.ids_crc32}" for r in huffman_ids.read_ids(spark, path).orderBy("start").collect()]
    assert [x for x in out.splitlines() if x.startswith("row ")] == here


def test_huffman_code():
    rng = np.random.default_rng(3)
    for counts in ({5: 1}, {0: 1, 9: 1}, {i: 2**i for i in range(40)}, {int(i): int(n) for i, n in enumerate(rng.zipf(1.5, 3000))}):
        lengths = huffman_ids.code_lengths(counts)
        used = lengths[lengths > 0].astype(float)
        assert len(used) == len(counts) and used.max() <= huffman_ids.LIMIT
        assert (2.0**-used).sum() <= 1
        ids = rng.choice(np.array(list(counts)), 1000).astype(np.uint32)
        payload, marks = huffman_ids.pack(ids, huffman_ids.canonical_codes(lengths), lengths)
        assert (huffman_ids.unpack(payload, marks, len(ids), huffman_ids.decode_table(lengths)) == ids).all()


def test_unlimited_code_is_huffman():
    import heapq

    counts = {i: n for i, n in enumerate([5, 9, 12, 13, 16, 45, 1, 1, 2])}
    heap = [(n, i) for i, n in counts.items()]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        cost += a[0] + b[0]
        heapq.heappush(heap, (a[0] + b[0], 99))
    lengths = huffman_ids.code_lengths(counts)
    assert sum(counts[i] * int(lengths[i]) for i in counts) == cost


def test_special_strings_as_the_library_has_them(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tk = Tokenizer.from_file(path)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>  y", "<|endoftext", "plain", None, "<|endoftext|> " + "word " * 50]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").fillna("", ["text"])
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in huffman_ids.encoded(docs, path, 0).collect()}
    assert got == {i: [*tk.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}


def test_new_pieces_go_to_the_model_at_once():
    """op10: a piece is split already, so neither the pattern nor offsets are worked out again for it."""
    from types import SimpleNamespace

    from tokenizers import Tokenizer

    p, tk = huffman_ids.PieceIds(BYTES), Tokenizer.from_file(BYTES)
    p.tokenizer = SimpleNamespace(model=p.tokenizer.model)  # no encoding of texts
    words = [" caf\u00e9", "'re", " ", "\n\n", "\u6f22\u5b57", "\U0001f600", "\x00\x7f\u00ad", "x" * 300, " don", " 12345678"]
    ids, sizes = p.ids([w.encode() for w in words], np.array([*range(len(words)), 2, 0]))
    want = [tk.encode(w, add_special_tokens=False).ids for w in [*words, words[2], words[0]]]
    assert sizes.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])
    again, _ = p.ids([words[5].encode()], np.array([0]))
    assert again.tolist() == want[5]


def test_ids_are_counted_where_they_are_made(spark):
    """op10: the counts come from the tasks that encode; documents' ids aren't read again for them."""
    docs = frame(spark).select("doc_id", "text").fillna("", ["text"]).repartition(3)
    rows = huffman_ids.encoded(docs, BYTES, 0, counted=True)
    made = [r.ids for r in rows.where("seen is null").collect()]
    want = np.unique(np.frombuffer(b"".join(made), "<u4"), return_counts=True)
    assert len(made) == len(ROWS) and huffman_ids.id_counts(rows) == dict(zip(*(x.tolist() for x in want), strict=True))
