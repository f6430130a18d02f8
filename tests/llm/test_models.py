import numpy as np
import pytest

from pyspark.sql import functions as F

from schemaweave.llm import dom_model, mixing, multi_index, toxicity


def brute_marginals(logits, parents, pairs):
    """Over all states of a small tree."""
    import itertools

    n, total, on = len(parents), 0.0, np.zeros(len(parents))
    for states in itertools.product((0, 1), repeat=n):
        w = np.exp(sum(x for x, s in zip(logits, states, strict=True) if s))
        for i in range(1, n):
            w *= pairs[states[parents[i]]][states[i]]
        total += w
        on += w * np.array(states)
    return on / total


def test_sum_product_is_exact():
    rng = np.random.default_rng(1)
    for _ in range(30):
        n = int(rng.integers(1, 9))
        parents = [-1, *(int(rng.integers(0, i)) for i in range(1, n))]
        logits, pairs = rng.normal(0, 2, n).tolist(), rng.uniform(0.1, 3, (2, 2)).tolist()
        assert np.allclose(dom_model.sum_product(logits, parents, pairs), brute_marginals(logits, parents, pairs))


def test_main_text_on_unseen_layouts():
    model, hit, miss, extra = dom_model.default_model(), 0, 0, 0
    for page in dom_model.labelled_pages(120, seed=99):
        dom = dom_model.Dom(page)
        known = [bool(m and m[1] == "1") for m in map(dom_model.LABEL.search, dom.attrs)]
        got = model.marginals(dom)
        for node, text in dom.pieces:
            if text and text.strip():
                hit += known[node] and got[node] > 0.5
                miss += known[node] and got[node] <= 0.5
                extra += not known[node] and got[node] > 0.5
    assert miss + extra < 0.02 * hit


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ('<html><body><nav><ul><li><a href="/a">Home</a></li></ul></nav><article><h1>A &amp; B</h1><p>One<br>two  <b>thr</b>ee &eacute;.<p>Four</article><footer>&copy; me</footer>', "A & B One two three é. Four"),
        ('<body><article><p>x</p><script>var a="</p>";</script><p>y<div class="ad">buy</div></article><div class="comments"><div class="comment"><p>first!</p></div></div></body>', "x y"),
        ('<article><p>cut off he', "cut off he"),
    ],
)
def test_main_text(page, text):
    assert dom_model.default_model().extract(page) == text


def test_main_text_frame(spark):
    df = spark.createDataFrame([(1, "u", "<article><p>a</p></article>", "t"), (1, None, None, None), (None, "v", "", "t")], "page_id long, url string, html string, text string")
    got = sorted(map(tuple, dom_model.main_text(df).collect()), key=str)
    assert got == sorted([(1, "u", "a", 1), (1, None, "", 0), (None, "v", "", 0)], key=str)
    assert dom_model.main_text(df.where("false")).count() == 0
    deep = "<div>" * 5000 + "x"
    dom_model.default_model().extract(deep)


def labelled(spark, n=240):
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(300)]
    rows = []
    for i in range(n):
        t = list(rng.choice(words, 60))
        bad = i % 4 == 0
        if bad:
            t[int(rng.integers(0, 60))] = "zorgle" + str(rng.choice(list("abc")))
            t[int(rng.integers(0, 60))] = "ZORGLEN!"
        rows.append((i, " ".join(t), "en", int(bad)))
    docs = spark.createDataFrame([r[:3] for r in rows] + [(900, None, None), (901, "", "en"), (None, "zorgle", "xx")], "doc_id long, text string, lang string")
    return docs, spark.createDataFrame([(r[0], r[3], None) for r in rows] + [(None, 1, "z"), (5, None, "z")], "doc_id long, toxic int, text string")


def test_toxicity_on_held_out_documents(spark):
    docs, labels = labelled(spark)
    model = toxicity.fit(docs, labels, labels["doc_id"] % 3 != 0)
    got = {r.doc_id: r.score for r in toxicity.scores(docs, model).collect() if r.doc_id is not None}
    held = [i for i in range(240) if i % 3 == 0]
    assert all((got[i] >= 0.3) == (i % 4 == 0) for i in held)
    assert got[900] == got[901] < 0.3
    kept = toxicity.keep_clean(docs, model)
    assert kept.schema == docs.schema and kept.where("doc_id % 4 = 0 and doc_id < 240").count() <= 2
    assert kept.where("doc_id in (900, 901)").count() == 2
    assert toxicity.scores(docs.where("false"), model).count() == 0


def test_toxicity_without_labels(spark):
    docs, labels = labelled(spark, 12)
    assert {r.score for r in toxicity.scores(docs, toxicity.fit(docs, labels.where("toxic = 0"))).collect()} == {0.0}


def test_pooling_by_blocks_equals_whole_text():
    rng = np.random.default_rng(3)
    model = toxicity.Model(rng.normal(size=(toxicity.PAD + 1, toxicity.DIM)).astype(np.float32), [rng.normal(size=(w, toxicity.DIM, toxicity.FILTERS)).astype(np.float32) for w in toxicity.WIDTHS], [rng.normal(size=toxicity.FILTERS).astype(np.float32) for _ in toxicity.WIDTHS], np.ones(24, np.float32), 0.0)
    model.embedding[toxicity.PAD] = 0
    words = rng.integers(0, toxicity.PAD, (70_000, 3))
    x = np.concatenate([model.embedding[words].sum(1), np.zeros((2, toxicity.DIM), np.float32)])
    want = np.concatenate([np.maximum((sum(x[j : j + len(x) - w + 1] @ f[j] for j in range(w)) + b).max(0), 0) for w, f, b in zip(toxicity.WIDTHS, model.filters, model.biases, strict=True)])
    assert np.allclose(toxicity.Scorer(model).pooled(words), want, atol=1e-3)


def test_word_hashes_do_not_depend_on_blocks(monkeypatch):
    text = " ".join(f"Wort{'äöü'[i % 3]}{'x' * (i % 9)}" for i in range(400))
    whole = toxicity.words_of(text)
    monkeypatch.setattr(toxicity, "_CHARS", 256)
    assert (toxicity.words_of(text) == whole).all()


def test_rates_meet_targets(spark):
    rng = np.random.default_rng(5)
    kinds = {"a": "red rot rouge", "b": "blue blau bleu", "c": "green gruen vert"}
    rows = [(i, " ".join(rng.choice(kinds[k].split(), 30)), k) for i, k in enumerate(rng.choice(list("abc"), 300, p=[0.7, 0.2, 0.1]))]
    docs = spark.createDataFrame(rows + [(None, None, "a"), (1000, "", None)], "doc_id long, text string, rate string")
    table = spark.createDataFrame([r for r in rows if r[0] % 2], "doc_id long, text string, domain string").select("doc_id", "domain")
    targets = {"a": 0.4, "b": 0.3, "c": 0.3}
    out = {r.doc_id: r for r in mixing.mixed(docs, table, targets).collect()}
    tokens, total = dict.fromkeys("abc", 0.0), sum(r.n_tokens for r in out.values())
    for i, _, k in rows:
        assert out[i].domain == k
        tokens[k] += out[i].rate * out[i].n_tokens
    assert all(abs(tokens[k] / total - targets[k]) < 0.01 for k in targets)
    assert all(r.rate >= 0 and abs(r.copies - r.rate) < 1 for r in out.values()) and out[1000].n_tokens == 0
    again = mixing.repeated(docs, table, targets)
    assert again.schema == docs.schema
    ids = [r.doc_id for r in again.collect()]
    assert set(ids) == set(range(300)) | {None, 1000}
    assert {r.rate for r in mixing.mixed(docs, table.where("false"), targets).collect()} == {1.0}
    assert mixing.mixed(docs.where("false"), table, targets).count() == 0


def test_projected_gradient_reaches_the_least_squares_optimum():
    """Against many steps of plain gradient descent on the same objective."""
    rng = np.random.default_rng(6)
    tokens, p = rng.integers(1, 50, 200).astype(float), rng.dirichlet(np.ones(3) * 0.4, 200)
    w = tokens / tokens.sum()
    share = w @ p
    want = np.array([0.5, 0.3, 0.2])
    steps = []
    for _ in range(200):
        steps.append((0.0, ((w * mixing.replay(p, steps)) @ p - want) / share))
    value = lambda r: (((w * r) @ p - want) ** 2 / share).sum() + mixing.PULL * (w * (r - 1) ** 2).sum()
    r = np.ones(200)
    for _ in range(20_000):
        r = np.maximum(0, r - 0.5 * (p @ (((w * r) @ p - want) / share) + mixing.PULL * (r - 1)))
    assert value(mixing.replay(p, steps)) <= value(r) + 1e-4


@pytest.mark.parametrize("keep_all", [False, True])
@pytest.mark.parametrize("seed", range(4))
def test_rates_settle_at_the_optimum(monkeypatch, seed, keep_all):
    """Few and many documents, sharp and vague posteriors: the accelerated steps end, where plain steps come to after very many."""
    rng = np.random.default_rng(seed)
    n = [20, 300, 5000, 60][seed]
    tokens, p = rng.integers(1, 400, n).astype(float), rng.dirichlet(np.array([3, 1, 0.5, 0.1]) * [1, 0.05, 0.3, 0.01][seed], n)
    monkeypatch.setattr(mixing, "domain_totals", lambda m, steps, k, least=0.0, ahead=0.0: (tokens * mixing.replay(p, steps, least, ahead)) @ p)
    steps = mixing.fit_rates(None, list("abcd"), {"a": 0.3, "b": 0.3, "c": 0.2, "d": 0.2}, keep_all)
    assert len(steps) < mixing.STEPS
    share, least = (tokens @ p) / tokens.sum(), float(keep_all)
    want = np.array([0.3, 0.3, 0.2, 0.2]) * (max(share / [0.3, 0.3, 0.2, 0.2]) if keep_all else 1)
    w = tokens / tokens.sum()
    value = lambda r: (((w * r) @ p - want) ** 2 / share).sum() + mixing.PULL * (w * (r - 1) ** 2).sum()
    r = np.ones(n)
    for _ in range(30_000):
        r = np.maximum(least, r - (p @ (((w * r) @ p - want) / share) + mixing.PULL * (r - 1)) / (1 + mixing.PULL))
    assert value(mixing.replay(p, steps, least)) <= value(r) * 1.003 + 1e-7


def test_search_recall_order_and_exclusions(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(900, 12)).astype(np.float32)
    x[100:160] = x[100]
    x[:450] *= 3
    rows = [(i, v.tolist(), 0, 1.0) for i, v in enumerate(x)]
    rows += [(2000, None, 0, 1.0), (2020, [0.0] * 12, 0, 1.0), (2040, [None] + [1.0] * 11, 0, 1.0), (2060, [float("nan")] * 12, 0, 1.0), (2080, [float("inf")] * 12, 0, 1.0), (2100, [1.0] * 5, 0, 1.0), (None, [1.0] * 12, 0, 1.0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int, score double")
    got = multi_index.search(df, df["vec_id"] % 20 == 0, at_least=300).collect()
    x = x.astype(np.float64)
    hits = total = 0
    of: dict = {}
    for r in got:
        of.setdefault(r.query_id, []).append(r)
    assert set(of) == set(range(0, 900, 20))
    for q, found in of.items():
        found.sort(key=lambda r: r.rank)
        s = (x * x[q]).sum(1)
        assert [r.rank for r in found] == list(range(1, 21)) and all(r.score == s[r.vec_id] for r in found)
        assert all((-a.score, a.vec_id) < (-b.score, b.vec_id) for a, b in zip(found, found[1:], strict=False))
        s[q] = -np.inf
        best = np.lexsort((np.arange(900), -s))[:20]
        hits, total = hits + len({r.vec_id for r in found} & set(best.tolist())), total + 20
    assert hits / total >= 0.9
    assert multi_index.search(df.where("false"), df["vec_id"] % 20 == 0).count() == 0
    few = multi_index.search(df.where("vec_id < 5"), df["vec_id"] % 20 == 0).collect()
    assert len(few) == 4


def test_search_spreads_large_cells(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "SLICE", 40)
    monkeypatch.setattr(multi_index, "LEAST_SLICE", 40)
    rows = [(i, [1.0, 2.0, float(i % 3)]) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = multi_index.search(df, df["vec_id"] == 2, k=5, fraction=1.0).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [5, 8, 11, 14, 17]


def test_rows_of_one_id_are_queries_of_their_own(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(200)]
    rows += [rows[20], (20, rng.normal(size=6).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = multi_index.search(df, df["vec_id"] == 20, k=5, fraction=1.0).collect()
    assert sorted(r.rank for r in got) == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5] and all(r.vec_id != 20 for r in got)


def test_texts_without_words_have_no_tokens(spark):
    docs = spark.createDataFrame([(1, ""), (2, None), (3, " \n"), (4, " a  b ")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, domain string")
    assert {r.doc_id: r.n_tokens for r in mixing.mixed(docs, none, {"en": 1.0}).collect()} == {1: 0, 2: 0, 3: 0, 4: 2}


def test_clusters_take_few_cells():
    """The share that must be seen follows the data: little for clusters, much for vectors without structure."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(60, 16)) * 4
    clustered = centres[rng.integers(0, 60, 4000)] + rng.normal(size=(4000, 16)) * 0.1
    plain = rng.normal(size=(4000, 16))
    share = [multi_index.Codebooks(x, float((x * x).sum(1).max()), 16).needed(x, 20, 0.97) for x in (clustered, plain)]
    assert share[0] < 0.35 < share[1]


def test_length_of_vectors_is_that_of_the_table(spark):
    """Half of the queries have another length; the others are answered."""
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=2 if i in (60, 80, 100) else 8).tolist()) for i in range(1, 101)]
    got = multi_index.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.expr("vec_id % 20 = 0")).collect()
    assert {r.query_id for r in got} == {20, 40}


def test_one_long_label_leaves_the_others(spark, monkeypatch):
    """Long texts are cut, none behind them goes, and repeated ids count once."""
    monkeypatch.setattr(toxicity, "LONGEST", 40)
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 400)
    docs = spark.createDataFrame([(i, "x" * 1000 if i == 3 else f"word{i}", "en") for i in range(12)] + [(5, "again", "en"), (6, None, None)], "doc_id long, text string, lang string")
    chosen = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.bounded_texts(docs, chosen, "toxic").collect()}
    assert set(got) == set(range(12)) and got[3].text == "x" * 40 and got[5].text == "again" and got[6].text == ""
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 60)
    assert {r.toxic for r in toxicity.bounded_texts(docs, chosen, "toxic").collect()} == {0, 1}


def test_domains_with_very_long_texts(spark):
    docs = spark.createDataFrame([(i, ("rot " if i % 2 else "blue ") * (200_000 if i == 3 else 20)) for i in range(30)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, "a" if i % 2 else "b") for i in range(30)], "doc_id long, domain string")
    out = mixing.mixed(docs, labels, {"a": 0.5, "b": 0.5}).collect()
    assert all(r.domain == ("a" if r.doc_id % 2 else "b") for r in out)


def test_toxicity_learns_from_every_labelled_text(spark):
    """Words that only late labelled rows or the ends of long texts hold; rows far beyond one task."""
    assert not {"POSITIVES", "NEGATIVES"} & set(vars(toxicity))
    end = "plain " * 60_000
    docs = spark.createDataFrame([(i, (end + "zorgle") if i < 6 else (end + "calm") if i < 12 else f"calm words {i % 7}", "en") for i in range(60)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i < 6)) for i in range(60)], "doc_id long, toxic int")
    found = toxicity.labelled(docs, labels).collect()
    assert len(found) == 60 and max(len(r.text) for r in found) == len(end) + 6
    got = {r.doc_id: r.score for r in toxicity.scores(docs, toxicity.fit(docs, labels)).collect()}
    assert min(got[i] for i in range(6)) > max(got[i] for i in range(6, 60))


def test_toxicity_learned_in_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "TASK", 40)
    docs, labels = labelled(spark)
    model = toxicity.fit(docs.repartition(4), labels, labels["doc_id"] % 3 != 0)
    got = {r.doc_id: r.score for r in toxicity.scores(docs, model).collect() if r.doc_id is not None}
    assert np.mean([(got[i] >= 0.3) == (i % 4 == 0) for i in range(0, 240, 3)]) >= 0.95


def test_thresholds_of_counted_values_equal_those_of_rows():
    rng = np.random.default_rng(2)
    v = np.round(rng.normal(size=400) * 8) / 8
    y = (rng.random(400) < 1 / (1 + np.exp(-3 * v))).astype(int)
    values, which = np.unique(v, return_inverse=True)
    got = toxicity.best_threshold(values, np.bincount(which, y).astype(int), np.bincount(which))
    assert got == toxicity.best_threshold(v, y)
