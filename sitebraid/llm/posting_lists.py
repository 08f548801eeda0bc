"""Approximate nearest neighbours by cosine, over balanced posting lists.

Centroids are fitted on a bounded sample by k-means that charges for crowded clusters and splits what stays
too large. A graph links each centroid to its nearest ones; vectors and queries find their lists by a beam
search over it, many at once, in every task's memory. Each vector joins its nearest list and those hardly
farther (boundary vectors are in several lists); each query reads the lists whose distance is within a
ratio of the nearest. Lists are dealt out in parts of bounded size, so no task holds a whole crowded list.

Equal vectors are equally near to everything, so only the smallest ids of each vector, as many as a result
can hold and one more, are indexed; that loses nothing and keeps a vector that fills a third of the table
from filling a list.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import column, write_table

NEAREST, QUERY_EVERY = 5, 50
#: Vectors a list is meant to hold, most lists, and sampled vectors a list (the sample has LISTS_MOST times as many at most).
LIST_ROWS, LISTS_MOST, SAMPLED = 128, 8192, 16
#: Copies of a boundary vector and how much farther than the nearest list they may be; the same of lists a query reads.
COPIES, COPY_RATIO = 4, 1.12
READS, READ_RATIO, READS_LEAST = 48, 1.6, 12
#: Links of a centroid, starts and width of a beam, rounds at most.
LINKS, STARTS, BEAM, ROUNDS = 24, 64, 64, 40
#: Vectors and queries that meet in one task at most, about.
PART_ROWS, BLOCK_ROWS = 4096, 2048


@dataclass
class Index:
    """Unit centroids, their graph and where beams start; bounded by LISTS_MOST."""

    centroids: np.ndarray
    links: np.ndarray
    starts: np.ndarray

    def nearest(self, units: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Lists and distances of unit vectors, nearest first, by a beam search over the graph."""
        n, c = len(units), len(self.centroids)
        most = min(most, c)
        if c <= BEAM:
            likeness = units @ self.centroids.T
            order = np.argsort(-likeness, axis=1, kind="stable")[:, :most]
            return order, _distance(np.take_along_axis(likeness, order, 1))
        width = max(BEAM, most)
        likeness = units @ self.centroids[self.starts].T
        order = np.argsort(-likeness, axis=1)[:, :width]
        beam, near = self.starts[order], np.take_along_axis(likeness, order, 1)
        if beam.shape[1] < width:
            gap = width - beam.shape[1]
            beam = np.concatenate([beam, np.full((n, gap), -1)], axis=1)
            near = np.concatenate([near, np.full((n, gap), -np.inf)], axis=1)
        seen = np.zeros((n, c), bool)  # in the beam once or before
        np.put_along_axis(seen, np.where(beam < 0, beam[:, :1], beam), True, axis=1)
        open_ = beam >= 0
        rows = np.arange(n)
        for _ in range(ROUNDS):
            waiting = np.where(open_, near, -np.inf)
            pick = np.argpartition(-waiting, 3, axis=1)[:, :4]
            live = np.take_along_axis(open_, pick, 1)
            if not live.any():
                break
            np.put_along_axis(open_, pick, False, axis=1)
            around = self.links[np.take_along_axis(beam, pick, 1)]
            around[~live] = -1
            around = around.reshape(n, -1)
            fresh = (around >= 0) & ~seen[rows[:, None], around]
            order = np.argsort(around, axis=1, kind="stable")  # a centroid met twice counts once
            sorted_ = np.take_along_axis(around, order, 1)
            again = np.zeros_like(fresh)
            np.put_along_axis(again, order, np.concatenate([np.zeros((n, 1), bool), sorted_[:, 1:] == sorted_[:, :-1]], axis=1), axis=1)
            fresh &= ~again
            like = np.where(fresh, np.einsum("nkd,nd->nk", self.centroids[around], units), -np.inf)
            seen[np.repeat(rows, around.shape[1])[fresh.ravel()], around[fresh]] = True
            beam, near, open_ = np.concatenate([beam, around], 1), np.concatenate([near, like], 1), np.concatenate([open_, fresh], 1)
            keep = np.argpartition(-near, width - 1, axis=1)[:, :width]
            beam, near, open_ = (np.take_along_axis(x, keep, 1) for x in (beam, near, open_))
        order = np.argsort(-near, axis=1, kind="stable")[:, :most]
        return np.take_along_axis(beam, order, 1), _distance(np.take_along_axis(near, order, 1))


def _distance(likeness: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * likeness))


def _top(units: np.ndarray, centroids: np.ndarray, most: int) -> np.ndarray:
    return np.concatenate([np.argsort(-(units[i : i + 1024] @ centroids.T), axis=1)[:, :most] for i in range(0, len(units), 1024)])


def fit(sample: np.ndarray, lists: int) -> Index:
    """Balanced k-means over unit vectors, and the graph over what comes out."""
    rng = np.random.default_rng(7)
    lists = max(1, min(lists, len(sample)))
    centroids = sample[rng.permutation(len(sample))[:lists]].copy()
    load = np.zeros(lists)
    for _ in range(10):
        owner = np.empty(len(sample), "i8")
        charge = 0.05 * (load / max(load.mean(), 1e-9) - 1) if load.any() else load
        for i in range(0, len(sample), 2048):
            owner[i : i + 2048] = np.argmax(sample[i : i + 2048] @ centroids.T - charge, axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, owner, sample)
        load = np.bincount(owner, minlength=lists).astype(float)
        empty = load == 0
        sums[empty] = sample[rng.integers(0, len(sample), int(empty.sum()))]
        centroids = _units(sums)
    parts = [np.flatnonzero(owner == j) for j in range(lists)]
    most, done = 2 * max(1, len(sample) // lists), []
    while parts:  # clusters that are still too large are cut along their longest direction
        part = parts.pop()
        if len(part) <= most or len(done) + len(parts) >= 2 * LISTS_MOST:
            if len(part):
                done.append(_units(sample[part].sum(axis=0, keepdims=True))[0])
            continue
        inside = sample[part] - sample[part].mean(axis=0)
        side = rng.normal(size=sample.shape[1])
        for _ in range(5):
            side = inside.T @ (inside @ side)
            side /= max(np.linalg.norm(side), 1e-30)
        reach = inside @ side
        low = reach <= np.median(reach)
        if low.all():
            done.append(_units(sample[part].sum(axis=0, keepdims=True))[0])
        else:
            parts += [part[low], part[~low]]
    centroids = np.array(done)
    links = _top(centroids, centroids, min(LINKS + 1, len(centroids)))
    return Index(centroids, links, rng.permutation(len(centroids))[:STARTS])


def _units(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, v (doubles) of rows with an id and a vector that is not zero and has finite components only.

    Where vectors differ in length, those of the commonest length (the longest of equally common ones) take part.
    """
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0))
    rows = rows.where(~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0))
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("v") == (common["d"] if common else 0))


def _matrix(packed) -> np.ndarray:
    return np.frombuffer(b"".join(packed), "f8").reshape(len(packed), -1)


def _packed(df: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = column(b, "v")
            flat = values.flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(b.num_rows, -1)
            # by a power of two, which changes no cosine: squares of very large or small components stay finite
            flat = np.ldexp(flat, -np.frexp(np.abs(flat).max(axis=1, initial=0.0))[1][:, None])
            yield pa.RecordBatch.from_arrays([column(b, "vec_id"), pa.array([r.tobytes() for r in flat], pa.binary())], ["vec_id", "v"])

    return df.select("vec_id", "v").mapInArrow(run, "vec_id long, v binary")


def _to_lists(df: DataFrame, index: Index, copies: int, ratio: float, least: int) -> DataFrame:
    """vec_id, v, list: a row for each list within ratio of the nearest one's distance (least at least, copies at most)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                units = _units(_matrix(column(part, "v").to_pylist()))
                lists, distance = index.nearest(units, copies)
                take = (distance <= ratio * np.maximum(distance[:, :1], 1e-9)) & np.isfinite(distance)
                take[:, :least] = np.isfinite(distance[:, :least])
                rows = np.repeat(np.arange(len(lists)), take.sum(axis=1))
                chosen = part.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([column(chosen, "vec_id"), column(chosen, "v"), pa.array(lists[take].astype("i4"))], ["vec_id", "v", "list"])

    return df.mapInArrow(run, "vec_id long, v binary, list int")


def _best(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, nearest: int) -> pd.DataFrame:
    """Each query's nearest of vectors by exact cosine, ties to the smaller id, itself left out."""
    out_q, out_v, out_s = [], [], []
    own_norms, norms = np.sqrt(np.einsum("ij,ij->i", queries, queries)), np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
    for at in range(0, len(queries), 256):
        rough = (queries[at : at + 256] / own_norms[at : at + 256, None]) @ (vectors / norms[:, None]).T
        rough[query_ids[at : at + 256, None] == ids[None, :]] = -np.inf
        k = min(nearest, len(ids))
        line = -np.partition(-rough, k - 1, axis=1)[:, k - 1] - 1e-9
        q, v = np.nonzero((rough >= line[:, None]) & (rough > -np.inf))
        exact = np.einsum("ij,ij->i", queries[at + q], vectors[v]) / (own_norms[at + q] * norms[v])
        order = np.lexsort((ids[v], -exact, q))
        q, v, exact = q[order], v[order], exact[order]
        place = np.arange(len(q)) - np.searchsorted(q, q, "left")
        keep = place < nearest
        out_q.append(query_ids[at + q[keep]])
        out_v.append(ids[v[keep]])
        out_s.append(exact[keep])
    return pd.DataFrame({"query_id": np.concatenate(out_q), "vec_id": np.concatenate(out_v), "score": np.concatenate(out_s)})


def search(vectors: DataFrame, nearest: int = NEAREST, every: int = QUERY_EVERY, id_col: str = "vec_id", vec_col: str = "embedding", lists: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score of the nearest found of every query (ids divisible by every).

    Rows with equal id and vector count once. A query that its lists give too few neighbours reads all
    lists. Tables without usable vectors or queries give no rows.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vec_col)
    queries = write_table(_packed(rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "v"])), "queries")
    place = F.row_number().over(W.partitionBy("v").orderBy("vec_id"))  # limited in each task before the shuffle
    single = rows.dropDuplicates(["vec_id", "v"])  # copies of a row mustn't take other ids' places
    first = single.withColumn("place", place).where(F.col("place") <= nearest + 1 + 1).drop("place")
    kept = write_table(_packed(first), "vectors")
    schema = "query_id long, rank int, vec_id long, score double"
    n = kept.count()
    if not n or queries.isEmpty():
        return spark.createDataFrame([], schema)
    count = lists or max(1, min(LISTS_MOST, n // LIST_ROWS))
    sample = _matrix([r["v"] for r in kept.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLED * count if count > 1 else 64).collect()])  # bounded by SAMPLED * LISTS_MOST
    index = fit(_units(sample), count)
    placed = write_table(_to_lists(kept, index, COPIES, COPY_RATIO, 1), "postings")
    sizes = {r["list"]: r["n"] for r in placed.groupBy("list").agg(F.count("*").alias("n")).collect()}  # a row a list
    asked = write_table(_to_lists(queries, index, READS, READ_RATIO, READS_LEAST), "asked")

    def met(asked: DataFrame) -> DataFrame:
        loads = {r["list"]: r["n"] for r in asked.groupBy("list").agg(F.count("*").alias("n")).collect()}
        plan = spark.createDataFrame([(k, -(-sizes.get(k, 0) // PART_ROWS), -(-loads.get(k, 0) // BLOCK_ROWS)) for k in sizes if k in loads], "list int, parts int, blocks int")
        plan = F.broadcast(plan)  # a row a list
        left = placed.join(plan, "list").select("list", "vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        right = asked.join(plan, "list").select("list", "vec_id", "v", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int").alias("block"))

        def compare(own: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
            if not len(own) or not len(other):
                return pd.DataFrame({"query_id": np.zeros(0, "i8"), "vec_id": np.zeros(0, "i8"), "score": np.zeros(0)})
            return _best(other["vec_id"].to_numpy(), _matrix(other["v"].tolist()), own["vec_id"].to_numpy(), _matrix(own["v"].tolist()), nearest)

        by = ("list", "part", "block")
        found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(compare, "query_id long, vec_id long, score double")
        return found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))

    found = write_table(met(asked), "found")
    short = queries.join(found.groupBy("query_id").count().where(F.col("count") >= min(nearest, n - 1)), F.col("query_id") == F.col("vec_id"), "left_anti").select("vec_id", "v")
    if not short.isEmpty():
        every_list = short.withColumn("list", F.explode(F.array(*map(F.lit, sorted(sizes)))))
        found = found.unionByName(met(write_table(every_list, "asked"))).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")
