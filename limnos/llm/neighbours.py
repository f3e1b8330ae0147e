"""Approximate nearest neighbours by largest inner product: a forest of random-projection trees.

Trees: hyperplanes between two random points of a node, fitted on a bounded sample of distinct vectors, each lengthened
by one coordinate so that all have the same norm (largest inner product then is smallest angle). Every distinct vector
is put in one leaf of every tree; a leaf is cut into chunks of bounded size, so no task holds a leaf of any size.
Searching: a query walks all trees with one shared priority queue, always going on at the node with the widest margin,
until it has met enough leaves; how many that is, is read off the sample, where the true neighbours are known: so many that the
goal for the recall is met there (neighbours in the whole are nearer, so it is met there too). Leaves and their queries meet in a cogroup; each group reranks exactly, in double
precision, and hands on the best of each query only.

Equal vectors are one point: the point keeps the ``k`` + 1 smallest ids, which are all that ties can ask for. Equal
queries are searched once.

Defined results: vectors null, zero, or holding null or non-finite components take no part, and neither do vectors of
another length than the most frequent one (ties: the shorter); a query with fewer than ``k`` candidates gets them all if
the forest meets them; equal scores are ranked by id; repeated rows of one id are one candidate.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from limnos.llm.registry import query, table
from limnos.session import cut_lineage

NEIGHBOURS = 20
TREES = 8
#: The trees are fitted on at most this many vectors, those with the smallest hash.
SAMPLE_ROWS = 20_000
#: Sample points of a leaf, at most; recall asked for on the sample, with this many trial queries; points of a chunk.
LEAF = 256
RECALL = 0.96
TRIALS = 256
CHUNK = 1024


@dataclass(frozen=True)
class Forest:
    """Per tree: normals, offsets and children (a negative child is leaf -1 - child)."""

    trees: tuple[tuple[np.ndarray, np.ndarray, np.ndarray], ...]
    radius: float

    def lengthened(self, x: np.ndarray) -> np.ndarray:
        """Points with the coordinate that makes their norms equal."""
        rest = np.sqrt(np.maximum(0.0, self.radius**2 - (x * x).sum(axis=1)))
        return np.hstack([x, rest[:, None]])

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Leaf of every point (rows) in every tree (columns)."""
        points = self.lengthened(x)
        out = np.zeros((len(x), len(self.trees)), np.int64)
        for t, (normals, offsets, children) in enumerate(self.trees):
            at = np.zeros(len(x), np.int64) if len(normals) else np.full(len(x), -1)
            while (live := np.flatnonzero(at >= 0)).size:
                node = at[live]
                side = (np.einsum("ij,ij->i", points[live], normals[node]) > offsets[node]).astype(int)
                at[live] = children[node, side]
            out[:, t] = -1 - at
        return out

    def search(self, x: np.ndarray, leaves: int) -> list[tuple[int, int]]:
        """(tree, leaf) of the leaves nearest to a query, over all trees by one queue of margins."""
        point = np.append(x, 0.0)
        # Of the same norm as the points that are placed, which the offsets are for.
        point = point * ((self.radius or 1.0) / (np.linalg.norm(point) or 1.0))
        heap = [(-np.inf, t, 0 if len(tree[0]) else -1) for t, tree in enumerate(self.trees)]
        margins = [normals @ point - offsets for normals, offsets, _ in self.trees]
        heapq.heapify(heap)
        found = []
        while heap and len(found) < leaves:
            reach, t, node = heapq.heappop(heap)
            while node >= 0:
                margin, (_, _, children) = margins[t][node], self.trees[t]
                near = int(margin > 0)
                heapq.heappush(heap, (max(reach, abs(margin)), t, int(children[node, 1 - near])))
                node = int(children[node, near])
            found.append((t, -1 - node))
        return found


def grow(sample: np.ndarray, radius: float, trees: int = TREES, leaf: int = LEAF, seed: int = 7) -> Forest:
    base = Forest((), radius)
    points = base.lengthened(sample) / (radius or 1.0)
    rng = np.random.default_rng(seed)
    grown = []
    for _ in range(trees):
        normals, offsets, children, n_leaves = [], [], [], 0
        work = [(np.arange(len(points)), -1, 0)]
        while work:
            rows, parent, side = work.pop()
            place = -1 - n_leaves
            if len(rows) > leaf:
                a, b = points[rng.choice(rows, 2, replace=False)]
                normal = (a - b) / (np.linalg.norm(a - b) or 1.0)
                shade = points[rows] @ normal
                offset = float(np.median(shade))
                right = shade > offset
                if right.any() and not right.all():
                    place = len(normals)
                    normals.append(normal)
                    offsets.append(offset)
                    children.append([0, 0])
                    work += [(rows[~right], place, 0), (rows[right], place, 1)]
            if place < 0:
                n_leaves += 1
            if parent >= 0:
                children[parent][side] = place
        width = points.shape[1] if len(points) else 1
        # Margins are taken on points of norm one; points are placed with their own norm, which is the radius.
        grown.append((np.array(normals).reshape(-1, width), np.array(offsets), np.array(children, np.int64).reshape(-1, 2)))
    return Forest(tuple((n, o * (radius or 1.0), c) for n, o, c in grown), radius)


def leaves_needed(forest: Forest, sample: np.ndarray, k: int, recall: float = RECALL, trials: int = TRIALS) -> int:
    """Leaves a query must meet so that this share of its true neighbours in the sample is found."""
    most = sum(len(offsets) + 1 for _, offsets, _ in forest.trees)
    if len(sample) < 2:
        return most
    at, met = forest.leaves(sample), []
    for i in range(0, len(sample), max(1, len(sample) // trials)):
        near = sample @ sample[i]
        near[i] = -np.inf
        true = np.argsort(-near)[: min(k, len(sample) - 1)]
        turn = {leaf: n for n, leaf in enumerate(forest.search(sample[i], most), 1)}
        met += [min(turn[t, int(at[j, t])] for t in range(at.shape[1])) for j in true]
    return int(np.quantile(met, recall, method="higher"))


def _usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def points_of(vectors: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Distinct usable vectors: v, n (how many ids), ids (the k + 1 smallest)."""
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).filter(F.col("id").isNotNull() & _usable(F.col("v"))).distinct()
    # Copies of one vector meet in as many tasks as their ids have remainders; each task keeps few ids.
    part = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    first = part.withColumn("place", F.row_number().over(Window.partitionBy("v", "salt").orderBy("id"))).filter(F.col("place") <= k + 1)
    return first.groupBy("v").agg(F.slice(F.sort_array(F.collect_list("id")), 1, k + 1).alias("ids"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = NEIGHBOURS, trees: int = TREES, leaf: int = LEAF, recall: float = RECALL, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found of each query (queries: rows of vectors)."""
    spark = vectors.sparkSession
    empty = "query_id long, rank int, vec_id long, score double"
    lengths = vectors.filter(_usable(F.col("embedding"))).groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if lengths is None:
        return spark.createDataFrame([], empty)
    same = F.size("embedding") == lengths["n"]
    points = points_of(vectors.filter(same), k)
    points = cut_lineage(points.select(F.col("ids")[0].alias("point"), "ids", "v"))
    radius = points.agg(F.sqrt(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))))).first()[0]
    sample = points.orderBy(F.xxhash64("v"), "point").select("v").limit(sample_rows).toPandas()
    known = np.array(sample.v.tolist(), float)
    forest = grow(known, radius, trees, leaf)
    leaves = leaves_needed(forest, known, k, recall)
    sent = spark.sparkContext.broadcast(forest)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = sent.value.leaves(np.array(batch.column("v").to_pylist(), float))
                n, t = at.shape
                rows = np.repeat(np.arange(n), t)
                yield pa.RecordBatch.from_pydict({"tree": pa.array(np.tile(np.arange(t), n).astype(np.int32)), "leaf": pa.array(at.ravel()), "point": batch.column("point").take(pa.array(rows)), "v": batch.column("v").take(pa.array(rows))})

    kind = points.schema["v"].dataType.simpleString()
    placed = points.select("point", "v").mapInArrow(place, f"tree int, leaf long, point long, v {kind}")
    counts = placed.groupBy("tree", "leaf").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    # One row for each leaf of the forest, whose size the sample bounds.
    chunks = F.broadcast(counts)
    items = placed.join(chunks, ["tree", "leaf"]).select("tree", "leaf", F.pmod(F.xxhash64("point"), F.col("chunks")).cast("int").alias("chunk"), "point", "v")

    def seek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("v").to_pylist(), float)
            for i in range(len(x)):
                found = sent.value.search(x[i], leaves)
                one = pa.array([i] * len(found), pa.int64())
                yield pa.RecordBatch.from_pydict({"tree": pa.array([t for t, _ in found], pa.int32()), "leaf": pa.array([f for _, f in found], pa.int64()), "query": batch.column("query").take(one), "v": batch.column("v").take(one)})

    asked = queries.filter(same & _usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("query_id"), F.col("embedding").alias("v")).distinct()
    distinct_queries = cut_lineage(asked.groupBy("v").agg(F.min("query_id").alias("query")))
    visits = distinct_queries.mapInArrow(seek, f"tree int, leaf long, query long, v {kind}")
    visits = visits.join(chunks, ["tree", "leaf"]).select("tree", "leaf", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "query", "v")

    def rerank(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(p):
            return pd.DataFrame({"query": pd.Series(dtype="int64"), "point": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        p = p.sort_values("point")
        x, ids = np.array(p.v.tolist(), float), p.point.to_numpy()
        out = []
        for i in range(0, len(q), 256):
            part = q.iloc[i : i + 256]
            s = np.array(part.v.tolist(), float) @ x.T
            # One more than asked, as the query's own point may be among them.
            keep = np.argsort(-s, axis=1, kind="stable")[:, : k + 1]
            out.append(pd.DataFrame({"query": np.repeat(part["query"].to_numpy(), keep.shape[1]), "point": ids[keep].ravel(), "score": np.take_along_axis(s, keep, 1).ravel()}))
        return pd.concat(out)

    keys = ["tree", "leaf", "chunk"]
    met = visits.groupBy(*keys).cogroup(items.groupBy(*keys)).applyInPandas(rerank, "query long, point long, score double")
    # The same pair may score in the last digits differently from block to block; the exact sum comes below.
    best = met.groupBy("query", "point").agg(F.max("score").alias("near"))
    best = best.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("near"), "point"))).filter(F.col("place") <= k + 2)
    exact = F.aggregate(F.zip_with("qv", "v", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    pairs = best.join(distinct_queries.select("query", F.col("v").alias("qv")), "query").join(points, "point").select("query", "ids", exact.alias("score"))
    # Each query's own list: copies of a query share what was found, less their own id.
    members = asked.join(distinct_queries, "v").select("query", "query_id")
    rows = members.join(pairs, "query").select("query_id", F.explode("ids").alias("vec_id"), "score").filter("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


@query("op3_neighbours")
def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.filter("vec_id % 20 = 0"))
