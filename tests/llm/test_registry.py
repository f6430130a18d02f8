"""Every registered query over the smallest tables, against SQL or a plain computation of its contract."""

import hashlib
import zlib

import numpy as np
import pytest

from schemaweave.llm import mixing, queries, toxicity

from ..parity import assert_same, duck
from .test_dedup import brute_components, brute_passages, brute_print

Q = queries.queries()


@pytest.fixture(scope="module")
def texts(spark, smallest):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{smallest}/documents.parquet").collect()}


def sha(data) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def test_names():
    assert [n.split("_")[0] for n in Q] == [f"op{i}" for i in range(1, 14)]


def test_sql(spark, smallest):
    for name, sql in queries.oracle_sql().items():
        assert_same(Q[name](spark, smallest).toPandas(), duck(smallest, sql))


def test_op2(spark, smallest, texts):
    """The score is that of the network written as plain loops."""
    docs = spark.read.parquet(f"{smallest}/documents.parquet")
    labels = spark.read.parquet(f"{smallest}/labels.parquet")
    got = {r.doc_id: r for r in Q["op2_toxicity"](spark, smallest).collect()}
    assert set(got) == set(texts)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in got.items())
    model = toxicity.fit(docs, labels, labels["doc_id"].isNotNull() & (~labels["doc_id"].isin([i for i, r in got.items() if r.held_out])))
    for i in sorted(texts)[:6]:
        words = np.concatenate([toxicity.words_of(texts[i]), np.full((max(toxicity.WIDTHS) - 1, 3), toxicity.PAD)])[:400]
        x = [sum(model.embedding[b].astype(float) for b in row) for row in words]
        pooled = []
        for k, width in enumerate(toxicity.WIDTHS):
            for f in range(toxicity.FILTERS):
                pooled.append(max(0.0, max(sum(float(x[at + j] @ model.filters[k][j][:, f]) for j in range(width)) + float(model.biases[k][f]) for at in range(len(x) - width + 1))))
        if len(toxicity.words_of(texts[i])) <= 398:
            logit = float(np.dot(pooled, model.weights)) + model.bias
            assert abs(model.score(np.array([logit]))[0] - got[i].score) < 1e-3


def test_op2_on_labels_that_were_held_out(spark, smallest):
    folder = smallest.replace("sf0.001", "sf0.1")
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    held = [(toxic[r.doc_id], r.predicted) for r in Q["op2_toxicity"](spark, folder).collect() if r.held_out and r.doc_id in toxic]
    assert np.mean([a == b for a, b in held]) >= 0.95
    assert sum(a and b for a, b in held) >= 0.75 * sum(a for a, _ in held)


def test_op3(spark, smallest, texts):
    for r in Q["op3_matroska"](spark, smallest).collect():
        raw = texts[r.doc_id].encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), sha(payload), zlib.crc32(payload[-16:]))


def test_op4(spark, smallest):
    got = Q["op4_main_text"](spark, smallest).collect()
    assert len(got) == spark.read.parquet(f"{smallest}/pages.parquet").count() and all(r.n_chars == len(r.text) > 0 for r in got)


def test_op5(spark, smallest, texts):
    import public_tokenizers
    import tiktoken

    from schemaweave.llm import bpe_sql

    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe_sql.ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    for r in Q["op5_byte_bpe"](spark, smallest).collect():
        ids = enc.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(texts[r.doc_id]))


def test_op6(spark, smallest, texts):
    ids = sorted(texts)
    prints = [brute_print(texts[i]) for i in ids]
    root = brute_components(prints)
    want = {i: (f"{p:016x}", ids[k]) for i, p, k in zip(ids, prints, root, strict=True)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in Q["op6_simhash"](spark, smallest).collect()} == want


@pytest.mark.parametrize("size", ["sf0.001", "sf0.1"])
def test_op7(spark, smallest, size):
    folder = smallest.replace("sf0.001", size)
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    of: dict = {}
    for r in Q["op7_multi_index"](spark, folder).collect():
        of.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(of) == {i for i in ids.tolist() if i % 20 == 0}
    hits = 0
    for q, found in of.items():
        scores = (x * x[ids == q][0]).sum(1)
        scores[ids == q] = -np.inf
        best = ids[np.lexsort((ids, -scores))[:20]]
        hits += len({v for _, v, _ in found} & set(best.tolist()))
        assert all(s == scores[ids == v][0] for _, v, s in found)
    assert hits / (20 * len(of)) >= 0.9


def test_op8(spark, smallest, texts):
    got = Q["op8_mixing"](spark, smallest).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {i: len(t.split()) for i, t in texts.items()}
    total = sum(r.rate * r.n_tokens for r in got)
    for domain, share in queries.TARGETS.items():
        assert abs(sum(r.rate * r.n_tokens for r in got if r.domain == domain) / total - share) < 0.02


def test_mixing_stage_meets_its_targets(spark, smallest):
    """With a rate of 1 at least, the expected totals of the domains are still at their targets."""
    docs = spark.read.parquet(f"{smallest}/documents.parquet")
    labels = queries.domain_labels(docs, spark.read.parquet(f"{smallest}/labels.parquet"))
    model = mixing.fit(docs, labels)
    members = mixing.staged(mixing.memberships(docs, model), "test-members")
    residuals = mixing.fit_rates(members, model.domains, queries.TARGETS, keep_all=True)
    totals = mixing.domain_totals(members, residuals, len(model.domains), 1.0)
    for domain, got in zip(model.domains, totals / totals.sum(), strict=True):
        assert abs(got - queries.TARGETS[domain]) < 0.02
    some = {d: w for d, w in queries.TARGETS.items() if d != "es"}
    now = mixing.domain_totals(members, [], len(model.domains))
    residuals = mixing.fit_rates(members, model.domains, some)
    totals = mixing.domain_totals(members, residuals, len(model.domains))
    at = model.domains.index("es")
    assert abs(totals[at] / totals.sum() - now[at] / now.sum()) < 0.02  # no target: its share stays


def test_op9(spark, smallest, texts):
    want = brute_passages(sorted(texts.items()))
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in Q["op9_passages"](spark, smallest).collect()} == {i: tuple(w) for i, w in want.items()}


def test_op10(spark, smallest, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    start, want = 0, {}
    for i in sorted(texts):
        ids = [*tk.encode(texts[i], add_special_tokens=False).ids, 0]
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in Q["op10_token_ids"](spark, smallest).collect()} == want
