"""A convolutional text classifier for toxicity, trained with numpy.

A word is a run of letters in lower case. Its vector is the sum of three hashed embeddings: of the word, of its first four
and of its first five letters (so that inflected forms share what they begin with). Filters of widths 1, 2 and 3 slide over
the words, each keeps its largest response in the whole text (ReLU, max pooling), and a linear layer gives the logit. All of
it is trained by Adam with gradients through the winning positions; the first channel of an embedding starts from the
smoothed log-odds of its bucket.

Fitting uses every labelled document of the allowed part with its whole text: a fifth, by a hash of the id, isn't trained on
and sets the thresholds, one for all languages, which becomes the score 0.3, and one for each language that has enough labelled
rows. The counts for the log-odds are sums over all tasks. Each round of training is one pass in tasks of about TASK
documents, each of which starts from the model so far and takes Adam's steps on its own batches; a bucket's embedding
becomes the mean over the tasks that moved it, by how often they did, all else the mean by documents. Thresholds come from
counts of the logits on a grid of 1 / GRID. What reaches the driver is bounded by the buckets, the grid and the languages. Scores
never see language, source, label or id. A text's longest part in memory besides its words is one block of them.

Contract: null and empty texts have the score of a text without words; rows are kept one for one; without labels of both
kinds every score is 0; labels with a null id or class are ignored, of an id labelled twice the larger class counts; extra
columns are ignored. A null language takes the threshold for all.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import pretok
from .common import CLEAR, claim, slices, staged

BITS, DIM, FILTERS, WIDTHS = 17, 8, 8, (1, 2, 3)
EPOCHS, BATCH, TASK, BLOCK, GRID = 4, 32, 10_000, 32_768, 1024
#: Bytes of text of each class in a sample (``bounded_texts``).
SAMPLE_BYTES, LONGEST = 12 << 20, 1 << 18
THRESHOLD, ENOUGH = 0.3, 20
PAD = 1 << BITS  # its embedding is zero
_BASE, _CHARS = 0x9E3779B97F4A7C15, 1 << 18


def _powers(base: int) -> np.ndarray:
    """base**i mod 2**64."""
    out = np.ones(1, np.uint64)
    step = base
    while len(out) < _CHARS:
        out = np.concatenate([out, out * np.uint64(step)])
        step = step * step % (1 << 64)
    return out


_TABLES: list[np.ndarray] = []
CLEAR["words"] = _TABLES.clear


def buckets(text: str) -> np.ndarray:
    """The three buckets of each word of a piece of text, at most _CHARS code points long."""
    if not _TABLES:
        _TABLES.extend((_powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))))
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = np.zeros(len(chars) + 2, np.int8)
    letter[1:-1] = pretok.classes()[chars] == pretok.LETTER
    edges = np.diff(letter)
    start, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    total = np.zeros(len(chars) + 1, np.uint64)
    np.cumsum(chars * _TABLES[0][: len(chars)], out=total[1:])
    out = np.empty((len(start), 3), np.int64)
    size = end - start
    for k, (stop, salt) in enumerate(((end, 0x632BE59BD9B4E019), (start + np.minimum(size, 4), 0x7F4A7C159E3779B9), (start + np.minimum(size, 5), 0xBF58476D1CE4E5B9))):
        h = (total[stop] - total[start]) * _TABLES[1][start] ^ np.uint64(salt)
        h = (h ^ h >> np.uint64(29)) * np.uint64(0x94D049BB133111EB)
        out[:, k] = h >> np.uint64(64 - BITS)
    out[size < 4, 1] = PAD
    out[size < 5, 2] = PAD
    return out


def words_of(text: str) -> np.ndarray:
    """Buckets of all words of a text of any length; one of padding if there are none. A run of letters longer than half of _CHARS is cut there into words of its own."""
    text = text.lower()
    if len(text) < _CHARS:
        out = buckets(text)
        return out if len(out) else np.full((1, 3), PAD)
    parts, at = [], 0
    while at < len(text):
        end = min(at + _CHARS - 1, len(text))
        while at < end < len(text) and text[end - 1].isalpha() and end > at + _CHARS // 2:  # cut between words
            end -= 1
        parts.append(buckets(text[at:end]))
        at = end
    out = np.concatenate(parts)
    return out if len(out) else np.full((1, 3), PAD)


@dataclasses.dataclass
class Model:
    embedding: np.ndarray  # (2**BITS + 1, DIM)
    filters: list[np.ndarray]  # per width: (width, DIM, FILTERS)
    biases: list[np.ndarray]
    weights: np.ndarray
    bias: float
    shift: float = 0.0  # the logit that becomes THRESHOLD
    by_language: dict[str, float] = dataclasses.field(default_factory=dict)  # thresholds of the score

    def projected(self) -> np.ndarray:
        """Each bucket's share of the responses, for every filter and place in it: scoring only adds these up."""
        return np.concatenate([np.concatenate([self.embedding @ f[j] for j in range(len(f))], axis=1) for f in self.filters], axis=1).astype(np.float32)

    def score(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(logits - self.shift + np.log(THRESHOLD / (1 - THRESHOLD)), -60, 60)))


class Scorer:
    def __init__(self, model: Model):
        self.model, self.table = model, model.projected()

    def pooled(self, words: np.ndarray) -> np.ndarray:
        """Largest responses of every filter in a text, block by block with an overlap of the widest filter."""
        m, most = self.model, np.full(len(WIDTHS) * FILTERS, -np.inf, np.float32)
        padded = np.concatenate([words, np.full((max(WIDTHS) - 1, 3), PAD)])
        for at in range(0, max(1, len(words)), BLOCK):
            part = padded[at : at + BLOCK + max(WIDTHS) - 1]
            shares = self.table[part[:, 0]] + self.table[part[:, 1]] + self.table[part[:, 2]]
            column = 0
            for k, width in enumerate(WIDTHS):
                n = len(part) - width + 1
                r = shares[:n, column : column + FILTERS]
                for j in range(1, width):
                    r = r + shares[j : j + n, column + j * FILTERS : column + (j + 1) * FILTERS]
                own = slice(k * FILTERS, (k + 1) * FILTERS)
                most[own] = np.maximum(most[own], r.max(0) + m.biases[k])
                column += width * FILTERS
        return np.maximum(most, 0)

    def logits(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        return np.array([self.pooled(words_of(t)) for t in texts]) @ self.model.weights + self.model.bias


def begun(seen: np.ndarray, n: np.ndarray, seed: int = 7) -> Model:
    """The model before training; seen: in how many documents of class 0 and 1 each bucket occurs, n: how many there are."""
    rng = np.random.default_rng(seed)
    odds = np.log((seen[1] + 1) / (n[1] + 2)) - np.log((seen[0] + 1) / (n[0] + 2)) - (np.log(1 / (n[1] + 2)) - np.log(1 / (n[0] + 2)))
    e = rng.normal(0, 0.02, (PAD + 1, DIM)).astype(np.float32)
    e[:, 0] = np.clip(odds, -4, 6) / 3
    e[PAD] = 0
    filters = [rng.normal(0, 0.2, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    for f in filters:
        f[:, 0, :] = np.abs(f[:, 0, :]) + 0.3
    return Model(e, filters, [np.full(FILTERS, -0.1, np.float32) for _ in WIDTHS], np.full(len(WIDTHS) * FILTERS, 0.1, np.float32), -1.0)


class Learner:
    """Adam's steps from a model on."""

    def __init__(self, model: Model):
        self.e = model.embedding.copy()
        self.params = [p.copy() for p in (*model.filters, *model.biases, model.weights, np.array([model.bias], np.float32))]
        self.moments = [(np.zeros_like(p), np.zeros_like(p)) for p in self.params]
        self.e1, self.e2 = np.zeros_like(self.e), np.zeros_like(self.e)
        self.moved, self.documents, self.steps = np.zeros(PAD + 1, np.int64), 0, 0

    def adam(self, p: np.ndarray, g: np.ndarray, m: np.ndarray, v: np.ndarray, rate: float = 0.01) -> None:
        m[...] = 0.9 * m + 0.1 * g
        v[...] = 0.99 * v + 0.01 * g * g
        p -= rate * (m / (1 - 0.9**self.steps)) / (np.sqrt(v / (1 - 0.99**self.steps)) + 1e-6)

    def winners(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Of every document and filter the largest response, and the buckets of the words under it."""
        wide, nw = max(WIDTHS), len(WIDTHS)
        most = np.full((len(docs), nw * FILTERS), -np.inf, np.float32)
        where = np.full((len(docs), nw * FILTERS, wide, 3), PAD)
        group: list[tuple[int, np.ndarray]] = []

        def settle() -> None:
            flat = np.concatenate([part for _, part in group])
            x, filters = self.e[flat].sum(1), np.arange(FILTERS)
            for k, width in enumerate(WIDTHS):
                r, at, columns = self.params[nw + k] + sum(x[j : j + len(x) - width + 1] @ self.params[k][j] for j in range(width)), 0, k * FILTERS + filters
                for d, part in group:
                    own = r[at : at + len(part) - width + 1]
                    best = own.argmax(0)
                    found = own[best, filters]
                    better = found > most[d, columns]
                    most[d, columns[better]] = found[better]
                    for j in range(width):
                        where[d, columns[better], j] = flat[at + best[better] + j]
                    at += len(part)
            group.clear()

        for d, words in enumerate(docs):
            for at in range(0, len(words), BLOCK):
                part = words[at : at + BLOCK + wide - 1]
                missing = min(BLOCK, len(words) - at) + wide - 1 - len(part)
                group.append((d, np.concatenate([part, np.full((missing, 3), PAD)]) if missing else part))
                if sum(len(p) for _, p in group) >= BLOCK:
                    settle()
        if group:
            settle()
        return most, where

    def step(self, docs: list[np.ndarray], labels: np.ndarray, weight: np.ndarray) -> None:
        nw = len(WIDTHS)
        self.steps += 1
        self.documents += len(docs)
        pooled, where = self.winners(docs)
        active, out = np.maximum(pooled, 0), self.params[2 * nw]
        logit = active @ out + self.params[2 * nw + 1][0]
        slope = (weight * (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels) / BATCH).astype(np.float32)
        back = slope[:, None] * out * (pooled > 0)
        grads = [np.zeros_like(p) for p in self.params]
        grads[2 * nw], grads[2 * nw + 1] = slope @ active, slope.sum(keepdims=True)
        x, rows, row_grads = self.e[where].sum(3), [], []
        for k, width in enumerate(WIDTHS):
            own = slice(k * FILTERS, (k + 1) * FILTERS)
            g = back[:, own]
            grads[nw + k] = g.sum(0)
            for j in range(width):
                grads[k][j] = np.einsum("bfd,bf->df", x[:, own, j], g)
                rows.append(where[:, own, j].reshape(-1))
                row_grads.append(np.repeat((g[:, :, None] * self.params[k][j].T).reshape(-1, DIM), 3, axis=0))
        for p, g, (m1, m2) in zip(self.params, grads, self.moments, strict=True):
            self.adam(p, g + 1e-4 * p, m1, m2)
        touched, at = np.unique(np.concatenate(rows), return_inverse=True)
        g = np.zeros((len(touched), DIM), np.float32)
        np.add.at(g, at, np.concatenate(row_grads))
        m1, m2, own = self.e1[touched], self.e2[touched], self.e[touched]
        self.adam(own, g + 1e-4 * own, m1, m2, 0.005)
        self.e1[touched], self.e2[touched], self.e[touched] = m1, m2, own
        self.moved[touched] += 1
        self.e[PAD] = 0

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places in the model, what they count and what stands there now: moved buckets, then all else in rows of DIM."""
        self.moved[PAD] = 0
        flat = np.concatenate([p.ravel() for p in self.params])
        rest = np.pad(flat, (0, -len(flat) % DIM)).reshape(-1, DIM)
        at = np.flatnonzero(self.moved)
        return np.concatenate([at, PAD + 1 + np.arange(len(rest))]), np.concatenate([self.moved[at], np.full(len(rest), self.documents)]), np.concatenate([self.e[at], rest])


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    claim("words")
    seen = np.zeros((2, PAD + 1), np.int64)
    for batch in slices(batches):
        for t, label in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist(), strict=True):
            seen[label, np.unique(words_of(t))] += 1
    at = np.flatnonzero(seen.any(0))
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(seen[0, at]), pa.array(seen[1, at])], ["place", "n0", "n1"])


def _round(known: DataFrame, model: Model, weight: np.ndarray, epoch: int) -> Model:
    """The model after one pass over ``known`` (text, toxic)."""
    values = [f"v{i}" for i in range(DIM)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("words")
        learner, rng = Learner(model), np.random.default_rng((7, epoch))
        for batch in slices(batches):
            docs, y = [words_of(t) for t in batch["text"].to_pylist()], np.array(batch["toxic"].to_pylist(), np.int64)
            order = rng.permutation(len(docs))
            for at in range(0, len(order), BATCH):
                own = order[at : at + BATCH]
                learner.step([docs[d] for d in own], y[own], weight[y[own]])
        if learner.documents:
            at, n, v = learner.rows()
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n, pa.int64()), *(pa.array(v[:, i], pa.float32()) for i in range(DIM))], ["place", "n", *values])

    moved = known.select("text", "toxic").mapInArrow(run, f"place long, n long, {', '.join(f'{v} float' for v in values)}")
    got = moved.groupBy("place").agg(*((F.sum(F.col("n") * F.col(v).cast("double")) / F.sum("n")).cast("float").alias(v) for v in values)).toArrow()
    at, v = got["place"].to_numpy(), np.stack([got[v].to_numpy() for v in values], 1)
    e = model.embedding.copy()
    e[at[at < PAD]] = v[at < PAD]
    rest = v[at > PAD][np.argsort(at[at > PAD])].ravel()
    params, begin = [], 0
    for p in (*model.filters, *model.biases, model.weights):
        params.append(rest[begin : begin + p.size].reshape(p.shape))
        begin += p.size
    return Model(e, params[: len(WIDTHS)], params[len(WIDTHS) : -1], params[-1], float(rest[begin]))


def _graded(held: DataFrame, model: Model) -> DataFrame:
    """(lang, place, n, hits): how many documents have each logit on the grid, and how many of them are toxic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("words")
        scorer = Scorer(model)
        for batch in slices(batches):
            place = np.round(np.clip(scorer.logits(batch["text"].to_pylist()), -60, 60) * GRID).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch["lang"], pa.array(place), batch["toxic"]], ["lang", "place", "toxic"])

    return held.select("text", "lang", "toxic").mapInArrow(run, "lang string, place long, toxic int").groupBy("lang", "place").agg(F.count("*").alias("n"), F.sum("toxic").alias("hits"))


def best_threshold(values: np.ndarray, labels: np.ndarray, rows: np.ndarray | None = None) -> float:
    """The middle of the gap at which F1 is largest; of equal ones the widest gap. With ``rows``, each value stands for so many, ``labels`` of them positive."""
    order = np.argsort(-values, kind="stable")
    v, hits = values[order], np.cumsum(labels[order])
    f1 = 2 * hits / (np.cumsum(np.ones(len(v), np.int64) if rows is None else rows[order]) + labels.sum())
    gap = v - np.append(v[1:], v[-1] - 1)
    f1 = np.where(gap > 0, np.round(f1, 6), -1)
    best = np.flatnonzero(f1 == f1.max())
    k = best[gap[best].argmax()]
    return float(v[k] - gap[k] / 2)


def bounded_texts(docs: DataFrame, chosen: DataFrame, by: str) -> DataFrame:
    """One row per document of ``chosen`` (doc_id, ``by``; small) with its text cut to LONGEST characters, as many per value of ``by`` as SAMPLE_BYTES hold."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    cut = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", by, F.struct(F.substring(F.coalesce("text", F.lit("")), 1, LONGEST).alias("text"), *rest).alias("x"))
    one = cut.groupBy("doc_id", by).agg(F.min("x").alias("x")).select("doc_id", by, "x.*")
    size = F.sum(F.octet_length("text")).over(Window.partitionBy(by).orderBy(F.xxhash64("doc_id"), "doc_id"))
    return one.withColumn("size", size).where(F.col("size") <= SAMPLE_BYTES).drop("size")


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, lang, toxic, held): every labelled document once, with its whole text."""
    own = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    found = docs.select("doc_id", F.struct(F.coalesce("text", F.lit("")).alias("text"), F.col("lang").cast("string").alias("lang")).alias("x")).join(own.hint("merge"), "doc_id")
    one = found.groupBy("doc_id", "toxic").agg(F.min("x").alias("x")).select("doc_id", "x.*", "toxic")
    return one.withColumn("held", F.pmod(F.xxhash64(F.lit("held"), "doc_id"), F.lit(5)) == 4)


def fit(docs: DataFrame, labels: DataFrame, allowed: Column | None = None) -> Model | None:
    """Fit on all labels for which ``allowed`` holds; docs has doc_id, text and lang, labels doc_id and toxic. Of documents that repeat an id the least text and lang count."""
    found = labelled(docs, labels.where(allowed) if allowed is not None else labels)
    known = staged(found.sortWithinPartitions(F.xxhash64("doc_id"), "doc_id"), "labelled")  # in an order that says nothing of the texts
    n = np.zeros((2, 2), np.int64)
    for r in known.groupBy("held", "toxic").agg(F.count("*").alias("n")).collect():
        n[int(r["held"]), r["toxic"]] = r["n"]
    if not n.sum(0).all():
        return None
    grade = n.all()  # else too few to keep some for the thresholds
    own, n = (known.where("not held"), n[0]) if grade else (known, n.sum(0))
    own = own.coalesce(-(-int(n.sum()) // TASK))
    counts = own.select("text", "toxic").mapInArrow(_seen, "place long, n0 long, n1 long").groupBy("place").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()
    seen = np.zeros((2, PAD + 1))
    for c in (0, 1):
        seen[c, counts["place"].to_numpy()] = counts[f"n{c}"].to_numpy()
    model = begun(seen, n)
    for epoch in range(EPOCHS):
        model = _round(own, model, n.sum() / (2 * n), epoch)
    if grade:
        graded = staged(_graded(known.where("held"), model), "graded")
        rows = graded.groupBy("place").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits")).toArrow()
        model.shift = best_threshold(rows["place"].to_numpy() / GRID, rows["hits"].to_numpy(), rows["n"].to_numpy())
        enough = graded.where("lang <> ''").groupBy("lang").agg(F.sum("hits").alias("h"), F.sum("n").alias("n")).where((F.col("h") >= ENOUGH) & (F.col("n") - F.col("h") >= ENOUGH))

        def best(rows: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"lang": [rows["lang"].iloc[0]], "logit": [best_threshold(rows["place"].to_numpy() / GRID, rows["hits"].to_numpy(), rows["n"].to_numpy())]})

        for r in graded.join(enough.select("lang"), "lang", "left_semi").groupBy("lang").applyInPandas(best, "lang string, logit double").collect():
            model.by_language[r["lang"]] = float(model.score(np.array([r["logit"]]))[0])
    return model


def scores(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("words")
        scorer = Scorer(model) if model else None
        for batch in slices(batches):
            found = model.score(scorer.logits([t or "" for t in batch["text"].to_pylist()])) if model else np.zeros(len(batch))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(found, pa.float64())], ["doc_id", "score"])

    own = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    return own.mapInArrow(run, f"doc_id {own.dtypes[0][1]}, score double")


def keep_clean(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, lang and any others) whose score is below the threshold of their language; one pass, no shuffle."""
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("words")
        scorer = Scorer(model) if model else None
        for batch in slices(batches):
            if model and len(batch):
                found = model.score(scorer.logits([t or "" for t in batch["text"].to_pylist()]))
                least = np.array([model.by_language.get(x, THRESHOLD) for x in batch["lang"].to_pylist()])
                batch = batch.filter(pa.array(found < least))
            yield batch

    return docs.mapInArrow(run, schema)
