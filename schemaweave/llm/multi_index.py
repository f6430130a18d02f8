"""Approximate nearest neighbours by inner product with an inverted multi-index.

Vectors get one further component that makes all norms equal, so that a smaller distance means a larger inner product. Each
is split into two halves, each half is quantised by its own codebook (k-means on a bounded sample), and every vector lies
in the cell of its pair of centroids. A query goes through the pairs in order of summed distance, with a heap over the two
sorted lists, until the cells seen hold a share of all vectors and at least ``at_least`` of them; those are compared in double
precision. That share is ``fraction`` or, by default, what the sample needs for a recall of ``target``: queries of the sample
are answered by brute force within it, and the share at which each neighbour's cell comes up is counted. So clustered vectors
take few cells, and vectors without structure many. Centroids grow with the square root of the number of vectors.

Layout: cells lie side by side in slices of LEAST_SLICE to SLICE vectors, so that every task slot has one; a cell that holds more, because a third of all vectors are
alike, say, is spread over several slices. A slice's task holds its vectors and streams the queries that want one of its
cells, each query once per slice. Every slice returns 20 at most to a query, so the last step is small.

What reaches the driver: a sample of SAMPLE vectors for the codebooks (all vectors are indexed), one norm, and the counts of
k*k cells (at most MOST_CENTROIDS ** 2). Recall against brute force is measured in the tests; on data without any structure,
such as independent random vectors, it is about the share of the vectors seen, and so is the work.

Contract: vectors that are null, zero, of another length than most, or hold null or non-finite components take no part,
neither as queries nor as candidates, nor do rows with null ids. Candidates with repeated ids are rows of their own; equal
rows are one query, and rows of one id with different vectors are queries of their own, each with its ranks from 1; a query
never returns a row with its own id. Ties go to the smaller id. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import parallelism

SAMPLE, SLICE, LEAST_SLICE = 16_384, 8_192, 512
LEAST_CENTROIDS, MOST_CENTROIDS, PROBES = 16, 512, 256


def matrix(column: pa.Array) -> np.ndarray:
    """A list column without nulls, all lists of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def usable(vectors: DataFrame, id_col: str, vec_col: str, is_query: Column | None = None) -> DataFrame:
    """(id, vec) of the rows that take part, or of the queries among them; the commonest length is that of all vectors."""
    rows = vectors.select(vectors[id_col].alias("id"), vectors[vec_col].cast("array<double>").alias("vec"), (F.lit(True) if is_query is None else is_query).alias("asked")).where("id is not null and size(vec) > 0")
    rows = rows.where("forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(vec, x -> x <> 0)")
    length = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where((F.size("vec") == (length["n"] if length else 0)) & F.col("asked")).select("id", "vec")


def kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        a = nearest(x, c)
        for j in range(k):
            if (a == j).any():
                c[j] = x[a == j].mean(0)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (2 * x @ c.T - (c * c).sum(1)).argmax(1)


class Codebooks:
    def __init__(self, sample: np.ndarray, most: float, k: int):
        self.most = most
        x = self.extended(sample)
        self.half = x.shape[1] // 2
        k = min(k, len(x))
        self.books = kmeans(x[:, : self.half], k), kmeans(x[:, self.half :], k)
        self.k = k

    def extended(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        return np.hstack([x, np.zeros((len(x), 1)) if query else np.sqrt(np.maximum(0, self.most - (x * x).sum(1)))[:, None]])

    def cells(self, x: np.ndarray) -> np.ndarray:
        x = self.extended(x)
        return nearest(x[:, : self.half], self.books[0]) * self.k + nearest(x[:, self.half :], self.books[1])

    def needed(self, sample: np.ndarray, k: int, target: float) -> float:
        """The share of vectors that must be seen for a recall of ``target`` among the sample."""
        cells = self.cells(sample)
        sizes = np.bincount(cells, minlength=self.k**2)
        shares = []
        for i in np.linspace(0, len(sample) - 1, min(PROBES, len(sample))).astype(int):
            scores = sample @ sample[i]
            scores[i] = -np.inf
            near = np.argpartition(-scores, min(k, len(scores) - 1))[:k]
            q = self.extended(sample[i : i + 1], True)[0]
            away = ((q[: self.half] - self.books[0]) ** 2).sum(1)[:, None] + ((q[self.half :] - self.books[1]) ** 2).sum(1)
            order = np.argsort(away.ravel(), kind="stable")
            at = np.empty(len(order))
            at[order] = np.cumsum(sizes[order]) / len(sample)
            shares.append(at[cells[near]])
        return float(np.quantile(np.concatenate(shares), target))

    def traverse(self, query: np.ndarray, sizes: np.ndarray, want: int) -> list[int]:
        """Cells in order of summed distance until they hold ``want`` vectors; empty cells are passed over."""
        q = self.extended(query[None], True)[0]
        d1, d2 = (((part - book) ** 2).sum(1) for part, book in ((q[: self.half], self.books[0]), (q[self.half :], self.books[1])))
        o1, o2 = np.argsort(d1, kind="stable").tolist(), np.argsort(d2, kind="stable").tolist()
        d1, d2 = d1.tolist(), d2.tolist()
        heap, out, seen = [(d1[o1[0]] + d2[o2[0]], 0, 0)], [], 0
        while heap and seen < want:
            _, i, j = heapq.heappop(heap)
            cell = o1[i] * self.k + o2[j]
            if sizes[cell]:
                out.append(cell)
                seen += sizes[cell]
            if j + 1 < self.k:
                heapq.heappush(heap, (d1[o1[i]] + d2[o2[j + 1]], i, j + 1))
            if j == 0 and i + 1 < self.k:
                heapq.heappush(heap, (d1[o1[i + 1]] + d2[o2[0]], i + 1, 0))
        return out


def search(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", fraction: float | None = None, at_least: int = 1000, centroids: int | None = None, target: float = 0.97) -> DataFrame:
    """query_id, rank (from 1), id under ``id_col``'s name, score: each query's ``k`` nearest of the candidates seen."""
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vec_col)
    kind = rows.dtypes[0][1]
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()
    out_schema = f"query_id {kind}, asked long, id {kind}, score double"
    if not sample.num_rows:
        return spark.createDataFrame([], f"query_id {kind}, rank int, {id_col} {kind}, score double")
    n_rows, most = rows.agg(F.count("*"), F.max(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))).first()
    x = matrix(sample["vec"].combine_chunks())
    books = Codebooks(x, most, centroids or int(np.clip(np.sqrt(n_rows) / 8, LEAST_CENTROIDS, MOST_CENTROIDS)))
    if fraction is None:
        fraction = books.needed(x, k, target)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = books.cells(matrix(batch["vec"])) if len(batch) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch["id"], batch["vec"], pa.array(cells, pa.int32())], ["id", "vec", "cell"])

    index = rows.mapInArrow(assign, f"id {kind}, vec array<double>, cell int")
    sizes = np.zeros(books.k**2, np.int64)
    for r in index.groupBy("cell").count().collect():
        sizes[r["cell"]] = r["count"]
    # Slices: cells side by side until ``full`` vectors are in; a larger cell has slices of its own.
    full = min(SLICE, max(LEAST_SLICE, int(sizes.sum()) // parallelism(spark)))
    first, parts, n, room = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64), -1, 0
    for cell, size in enumerate(sizes.tolist()):
        if size > full:
            first[cell], parts[cell] = n + 1, -(-size // full)
            n, room = n + int(parts[cell]), 0
        else:
            if size > room:
                n, room = n + 1, full
            first[cell], room = n, room - size
    want = max(at_least, int(np.ceil(fraction * sizes.sum())))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = np.asarray(batch["cell"])
            slices = first[cells] + np.asarray(batch["h"]) % parts[cells] if len(batch) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(slices, pa.int32()), pa.array(np.zeros(len(batch)), pa.int8()), batch["id"], batch["vec"], pa.array([[c] for c in cells.tolist()], pa.list_(pa.int32())), batch["h"]], ["slice", "kind", "id", "vec", "cells", "h"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            queries = matrix(batch["vec"])
            for start in range(0, len(batch), 64):
                at, slices, cells = [], [], []
                for i in range(start, min(start + 64, len(batch))):
                    own: dict[int, list[int]] = {}
                    for cell in books.traverse(queries[i], sizes, want):
                        for s in range(first[cell], first[cell] + parts[cell]):
                            own.setdefault(s, []).append(cell)
                    at += [i] * len(own)
                    slices += own
                    cells += own.values()
                yield pa.RecordBatch.from_arrays([pa.array(slices, pa.int32()), pa.array(np.ones(len(at)), pa.int8()), batch["id"].take(pa.array(at, pa.int32())), batch["vec"].take(pa.array(at, pa.int32())), pa.array(cells, pa.list_(pa.int32())), batch["h"].take(pa.array(at, pa.int32()))], ["slice", "kind", "id", "vec", "cells", "h"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, vecs, cells, members = None, [], [], [], None
        for batch in batches:
            slices, kinds = np.asarray(batch["slice"]), np.asarray(batch["kind"])
            cuts = np.flatnonzero(np.concatenate([[True], (slices[1:] != slices[:-1]) | (kinds[1:] != kinds[:-1])])).tolist() + [len(slices)]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                part = batch.slice(i, j - i)
                if slices[i] != now:
                    now, ids, vecs, cells, members = slices[i], [], [], [], None
                if kinds[i] == 0:
                    ids.append(part["id"])
                    vecs.append(matrix(part["vec"]))
                    cells.append(part["cells"].flatten().to_numpy())
                    continue
                if not ids:
                    continue
                if members is None:  # the slice is whole: its queries follow
                    names, x, of = np.asarray(pa.concat_arrays(ids)), np.concatenate(vecs), np.concatenate(cells)
                    order = np.lexsort((names, of))
                    names, x, of = names[order], x[order], of[order]
                    edges = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])).tolist() + [len(of)]
                    members = [(int(of[a]), a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]
                yield from answers(part, names, x, members)

    def answers(part: pa.RecordBatch, names: np.ndarray, x: np.ndarray, members: list[tuple[int, int, int]]) -> Iterator[pa.RecordBatch]:
        for start in range(0, len(part), 512):
            some = part.slice(start, 512)
            q, own, asked = matrix(some["vec"]), np.asarray(some["id"]), np.asarray(some["h"])
            wanted = some["cells"].to_pylist()
            of: dict[int, list[int]] = {}
            for i, cells in enumerate(wanted):
                for cell in cells:
                    of.setdefault(cell, []).append(i)
            scores = np.full((len(some), len(x)), -np.inf)
            for cell, a, b in members:
                if cell in of:
                    scores[np.array(of[cell])[:, None], np.arange(a, b)] = q[of[cell]] @ x[a:b].T
            scores[own[:, None] == names] = -np.inf
            out = [], [], [], []
            for i in range(len(some)):
                s = scores[i]
                least = np.partition(s, -k)[-k] if len(s) > k else -np.inf
                near = np.flatnonzero((s >= least - 1e-9 * max(1.0, abs(least))) & (s > -np.inf)) if least > -np.inf else np.flatnonzero(s > -np.inf)
                exact = (x[near] * q[i]).sum(1)  # in an order that doesn't depend on the block
                best = np.lexsort((names[near], -exact))[:k]
                out[0].append(np.full(len(best), own[i]))
                out[1].append(np.full(len(best), asked[i]))
                out[2].append(names[near[best]])
                out[3].append(exact[best])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(out, (some["id"].type, pa.int64(), some["id"].type, pa.float64()), strict=True)], ["query_id", "asked", "id", "score"])

    placed = f"slice int, kind byte, id {kind}, vec array<double>, cells array<int>, h long"
    stored = index.withColumn("h", F.abs(F.xxhash64("id") % 1_000_003)).mapInArrow(place, placed)
    asked = usable(vectors, id_col, vec_col, is_query).dropDuplicates(["id", "vec"]).withColumn("h", F.xxhash64("vec")).mapInArrow(ask, placed)
    both = stored.unionByName(asked).repartition(max(parallelism(spark), n + 1), "slice").sortWithinPartitions("slice", "kind")
    found = both.mapInArrow(compare, out_schema)
    rank = F.row_number().over(Window.partitionBy("query_id", "asked").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
