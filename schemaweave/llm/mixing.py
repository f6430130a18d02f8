"""Mixing to target weights with soft membership.

A classifier fitted on a labelled table gives each document's posterior over the domains. Rates r >= 0 are then fitted so
that the expected token totals of the domains, sum of rate * tokens * posterior, come as near as they can to the targets:
least squares of the shares, each relative to the domain's share now, plus a small pull of every rate to 1, minimised by
projected gradient in the metric of the documents' tokens. In that metric the step bound is 1 + PULL for any data.

A step needs one pass over (tokens, posterior) and brings one number per domain and task to the driver. A document's rate
follows from its posterior and the momentum and residuals of the steps so far, so a pass replays them and no rates are stored: nothing is
lost with an executor. Copies are the rate rounded up or down by a hash of the id, so that their mean is the rate.

The classifier: naive Bayes on hashed words and their first four letters, the mean log likelihood per word times a
temperature that a fifth of the labelled rows sets. It is fitted on at most LABELLED labelled rows per domain in order of a
hash of the id.

``keep_all`` bounds the rates below by 1 inside the projection, so that the totals are those of the rates that are used.

Contract: null or empty texts have no tokens and the domains' prior as posterior; null ids keep their row; rows are kept one
for one; extra columns are ignored; domains without labelled rows take no part and the other targets are scaled; domains without a target keep their share;
without any labelled row every rate is 1. An empty table gives no rows.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import claim, slices, staged
from .toxicity import PAD, bounded_texts, words_of

LABELLED, PULL, STEPS, NEAR = 1000, 1e-3, 1000, 1e-5


@dataclasses.dataclass
class DomainModel:
    domains: list[str]
    prior: np.ndarray
    table: np.ndarray  # (buckets, domains): log likelihoods
    temperature: float = 1.0

    def logits(self, text: str) -> np.ndarray:
        words = words_of(text)[:, :2].ravel()
        words = words[words != PAD]
        return self.table[words].mean(0) if len(words) else np.zeros(len(self.domains))

    def posteriors(self, texts: list[str]) -> np.ndarray:
        z = np.log(self.prior) + self.temperature * np.array([self.logits(t) for t in texts]).reshape(len(texts), len(self.domains))
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


def fit(docs: DataFrame, labelled: DataFrame, most: int = LABELLED) -> DomainModel | None:
    """docs has doc_id and text, labelled doc_id and domain."""
    own = labelled.select("doc_id", "domain").where("doc_id is not null and domain is not null").groupBy("doc_id").agg(F.min("domain").alias("domain"))
    names = sorted(r["domain"] for r in own.select("domain").distinct().collect())
    if not names:
        return None
    place = F.row_number().over(Window.partitionBy("domain").orderBy(F.xxhash64("doc_id"), "doc_id"))
    some = own.withColumn("place", place).where(F.col("place") <= most).drop("place")
    rows = bounded_texts(docs.select("doc_id", "text"), some, "domain").toArrow().sort_by("doc_id")
    texts, y = [t or "" for t in rows["text"].to_pylist()], np.array([names.index(d) for d in rows["domain"].to_pylist()], np.int64)
    held = np.arange(len(y)) % 5 == 4
    counts = np.zeros((PAD, len(names)))
    for t, d in zip([t for t, h in zip(texts, held, strict=True) if not h], y[~held], strict=True):
        words = words_of(t)[:, :2].ravel()
        counts[:, d] += np.bincount(words[words != PAD], minlength=PAD)
    smooth = counts + 0.1
    share = np.bincount(y, minlength=len(names)) + 1.0
    model = DomainModel(names, share / share.sum(), np.log(smooth / smooth.sum(0)).astype(np.float32))
    if held.any() and len(names) > 1:
        z = np.array([model.logits(t) for t, h in zip(texts, held, strict=True) if h])

        def loss(temperature: float) -> float:
            x = np.log(model.prior) + temperature * z
            x = x - x.max(1, keepdims=True)
            return float((np.log(np.exp(x).sum(1)) - x[np.arange(len(x)), y[held]]).mean())

        model.temperature = min((2.0**k for k in range(-2, 8)), key=loss)
    return model


def memberships(docs: DataFrame, model: DomainModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, posterior) of every row; tokens are runs of anything but white space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("words")
        for batch in slices(batches):
            texts = [t or "" for t in batch["text"].to_pylist()]
            p = model.posteriors(texts)
            posterior = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * p.shape[1], pa.int32()), pa.array(p.ravel()))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([len(t.split()) for t in texts], pa.int64()), posterior], ["doc_id", "n_tokens", "posterior"])

    own = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    return own.mapInArrow(run, f"doc_id {own.dtypes[0][1]}, n_tokens long, posterior array<double>")


def replay(p: np.ndarray, steps: list[tuple[float, np.ndarray]], least: float = 0.0, ahead: float = 0.0) -> np.ndarray:
    """Rates after the steps, each a momentum and the scaled residuals at the point that the momentum leads to; none is below ``least``. ``ahead`` goes on by that momentum."""
    r = before = np.ones(len(p))
    for momentum, g in steps:
        at = r + momentum * (r - before)
        before, r = r, np.maximum(least, at - (p @ g + PULL * (at - 1)) / (1 + PULL))
    return r + ahead * (r - before)


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    tokens = np.asarray(batch["n_tokens"]).astype(np.float64)
    return tokens, np.asarray(batch["posterior"].flatten()).reshape(len(tokens), -1)


def domain_totals(members: DataFrame, steps: list[tuple[float, np.ndarray]], k: int, least: float = 0.0, ahead: float = 0.0) -> np.ndarray:
    """Expected token totals of the domains under the rates so far, or ahead of them: one row per domain reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k)
        for batch in batches:
            if len(batch):
                tokens, p = _columns(batch)
                total += (tokens * replay(p, steps, least, ahead)) @ p
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(total)], ["domain", "total"])

    out = np.zeros(k)
    for r in members.select("n_tokens", "posterior").mapInArrow(run, "domain int, total double").groupBy("domain").agg(F.sum("total").alias("total")).collect():
        out[r["domain"]] = r["total"]
    return out


def fit_rates(members: DataFrame, domains: list[str], targets: dict[str, float], keep_all: bool = False) -> list[tuple[float, np.ndarray]]:
    """The steps of the rates. The total stays that of the corpus or, with ``keep_all``, is the least at which no domain shrinks.

    Domains without a target keep their share, and the targets share the rest. Steps are projected-gradient steps with Nesterov's
    momentum, up to where every step shortens the way to the optimum by a fixed share, whatever the data. They end when the residuals no longer change; rates that still do after STEPS steps are an error."""
    k = len(domains)
    now = domain_totals(members, [], k)
    if not now.sum():
        return []
    share = now / now.sum()
    aimed = np.array([d in targets for d in domains])
    want = np.array([max(0.0, targets.get(d, 0.0)) for d in domains])
    if not want.sum():
        return []
    want = np.where(aimed, want / want.sum() * share[aimed].sum(), share)
    if keep_all:
        want = want * max(s / w for s, w in zip(share.tolist(), want.tolist(), strict=True) if w > 0 and s > 0)
    scale = 1 / np.maximum(share, 1e-9)
    steps: list[tuple[float, np.ndarray]] = []
    momentum, pace, got, still = 0.0, 1.0, share, 0
    flat = (PULL / (1 + PULL)) ** 0.5  # of the objective in the metric of the tokens: what it bends at least over what it bends at most
    most = (1 - flat) / (1 + flat)
    while True:
        g = (got - want) * scale
        still = still + 1 if steps and np.abs(g - steps[-1][1]).max() < NEAR else 0
        if still == 3:  # one alone may be a turning point
            return steps
        if len(steps) == STEPS:
            raise RuntimeError(f"rates still change after {STEPS} steps; shares are {np.abs(got / got.sum() - want / want.sum()).max():.4f} off their targets at most")
        steps.append((momentum, g))
        pace, last = (1 + (1 + 4 * pace * pace) ** 0.5) / 2, pace
        momentum = min((last - 1) / pace, most)
        got = domain_totals(members, steps, k, float(keep_all), momentum) / now.sum()


def _copies(rate: np.ndarray, h: np.ndarray) -> np.ndarray:
    u = (h.view(np.uint64) >> np.uint64(11)) / 2.0**53
    return (np.floor(rate) + (u < rate - np.floor(rate))).astype(np.int64)


def repeated(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], keep_all: bool = True) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and any others), each as often as its copies say; no row of documents moves."""
    model = fit(docs, labelled)
    if model is None:
        return docs
    residuals = fit_rates(staged(memberships(docs, model), "memberships"), model.domains, targets, keep_all)
    names = docs.columns
    mark = "h" + "_" * max(map(len, names))  # longer than any column's name

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("words")
        for batch in slices(batches):
            rate = replay(model.posteriors([t or "" for t in batch["text"].to_pylist()]), residuals, float(keep_all))
            copies = _copies(rate, np.asarray(batch[mark]))
            rows = pa.RecordBatch.from_arrays([batch[c] for c in names], names)
            while copies.any():  # a round per copy: a batch is never larger than it was
                yield rows.filter(pa.array(copies > 0))
                copies = np.maximum(0, copies - 1)

    return docs.withColumn(mark, F.xxhash64("doc_id", F.lit("mix"))).mapInArrow(run, docs.schema)


def mixed(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], keep_all: bool = False) -> DataFrame:
    """Per document: doc_id, n_tokens, domain (the likeliest), rate, copies."""
    model = fit(docs, labelled)
    if model is None:
        return docs.select("doc_id", F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"(\S+)"), F.lit(1))).cast("long").alias("n_tokens"), F.lit(None).cast("string").alias("domain"), F.lit(1.0).alias("rate"), F.lit(1).alias("copies"))
    members = staged(memberships(docs, model), "memberships")
    residuals = fit_rates(members, model.domains, targets, keep_all)
    names = np.array(model.domains, object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                _, p = _columns(batch)
                rate = replay(p, residuals, float(keep_all))
                copies = _copies(rate, np.asarray(batch["h"]))
                yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["n_tokens"], pa.array(names[p.argmax(1)], pa.string()), pa.array(rate), pa.array(copies, pa.int32())], ["doc_id", "n_tokens", "domain", "rate", "copies"])

    return members.withColumn("h", F.xxhash64("doc_id", F.lit("mix"))).mapInArrow(run, f"doc_id {members.dtypes[0][1]}, n_tokens long, domain string, rate double, copies int")
