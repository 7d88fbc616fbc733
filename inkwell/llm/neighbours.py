"""Approximate nearest neighbours by inner product, on robust-pruned directed graphs.

Vectors are dealt by a hash of their content into shards, whose size grows with the root of the number of vectors
(shard_size), so that queries visit fewer shards than a fixed size would give. A shard's graph is built by inserting
nodes a batch at a time: a greedy beam search over the graph so far (with the batch's own nearest nodes) proposes
neighbours, and pruning keeps a proposal only if no kept neighbour is ALPHA times nearer to it than the node is, at
most DEGREE of them; reverse edges are pruned likewise. A second pass re-inserts every node. Largest inner product
becomes least distance by one more coordinate that gives all vectors of a shard the same norm. A query has 0 there and
so lies apart from short vectors: proposals also come from a search from where a query in the node's direction lies, and
each node has AHEAD more edges, pruned as seen from there, or few edges would lead to long vectors. Blocks of queries are
searched in every shard with a beam of BEAM, and scores are computed anew in double precision on the vectors given.

Equal vectors are one node: of its vec_ids the k + 1 smallest are enough for any query's k nearest with ties to the
smaller vec_id. Vectors that are null, zero, or hold null or non-finite components take no part; neither do rows with
a null vec_id. Rows of equal vec_id count once, with the least vector. Vectors only meet those of the same length.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.llm.common import materialise, table

DEGREE, SLACK, AHEAD, ALPHA = 32, 48, 24, 1.2
BUILD_BEAM, BEAM, WIDTH, BATCH = 64, 128, 4, 256
#: A shard has at least SHARD vectors on average, and ROOT * sqrt(n) of n, while its vectors stay under SHARD_BYTES.
SHARD, ROOT, SHARD_BYTES = 8192, 32, 2**26
#: Queries of a block; a task searches as many queries as a shard has vectors with one copy of its graph.
BLOCK = 256
#: Squared distance, among points of norm 1, from which a query in a node's direction is looked for apart from the node.
APART = 1e-6


def search(points: np.ndarray, squares: np.ndarray, edges: np.ndarray, starts: np.ndarray, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and distances of the beam after a greedy search for each query; -1 and infinity where it holds fewer."""
    b, n = len(queries), len(points)
    rows = np.arange(b)[:, None]
    seen = np.zeros((b, n), bool)
    ids = np.full((b, beam), -1, np.int64)
    far = np.full((b, beam), np.inf, np.float32)
    done = np.ones((b, beam), bool)
    new = np.broadcast_to(starts, (b, len(starts)))
    while True:
        new = np.sort(new, 1)
        fresh = (new >= 0) & ~seen[rows, new]
        fresh[:, 1:] &= new[:, 1:] != new[:, :-1]
        asker, node = np.nonzero(fresh)[0], new[fresh]
        seen[asker, node] = True
        distance = np.full(new.shape, np.inf, np.float32)
        distance[fresh] = squares[node] - 2 * np.einsum("ij,ij->i", points[node], queries[asker])
        all_ids, all_far = np.hstack([ids, new]), np.hstack([far, distance])
        all_done = np.hstack([done, ~fresh])
        order = np.argpartition(all_far, beam - 1, 1)[:, :beam] if all_far.shape[1] > beam else np.argsort(all_far, 1)
        order = np.take_along_axis(order, np.argsort(np.take_along_axis(all_far, order, 1), 1), 1)
        ids, far, done = (np.take_along_axis(x, order, 1) for x in (all_ids, all_far, all_done))
        at = np.sort(np.where(done, beam, np.arange(beam)), 1)[:, :WIDTH]
        if (at == beam).all():
            return np.where(np.isinf(far), -1, ids), far
        open_ = at < beam
        mark = np.zeros((b, beam + 1), bool)
        mark[rows, at] = True
        done |= mark[:, :beam]
        at = np.minimum(at, beam - 1)
        new = np.where(open_[:, :, None], edges[np.take_along_axis(ids, at, 1)], -1).reshape(b, -1)


def prune(points: np.ndarray, nodes: np.ndarray, pool: np.ndarray, degree: int, alpha: float, seats: np.ndarray) -> np.ndarray:
    """For each node up to degree ids of its pool (-1: none): the nearest to its seat, then the nearest that none kept is alpha times nearer to."""
    pool = np.sort(pool, 1)
    pool[:, 1:][pool[:, 1:] == pool[:, :-1]] = -1
    pool = np.where(pool == nodes[:, None], -1, pool)
    near = points[pool]
    gap = near - seats[:, None, :]
    distance = np.where(pool >= 0, np.einsum("bkd,bkd->bk", gap, gap), np.inf)
    order = np.argsort(distance, 1, kind="stable")
    pool, distance, near = np.take_along_axis(pool, order, 1), np.take_along_axis(distance, order, 1), np.take_along_axis(near, order[:, :, None], 1)
    size = np.einsum("bkd,bkd->bk", near, near)
    between = size[:, :, None] + size[:, None, :] - 2 * near @ near.transpose(0, 2, 1)
    alive = np.isfinite(distance)
    rows = np.arange(len(nodes))
    out = np.full((len(nodes), degree), -1, np.int64)
    for k in range(degree):
        best = alive.argmax(1)
        live = alive[rows, best]
        if not live.any():
            break
        out[live, k] = pool[rows, best][live]
        alive &= ~((alpha * alpha * between[rows, best] <= distance) & live[:, None])
        alive[rows, best] = False
    return out


def augmented(vectors: np.ndarray) -> np.ndarray:
    norms = (vectors.astype(np.float64) ** 2).sum(1)
    rest = np.sqrt(np.maximum(norms.max(initial=0.0) - norms, 0))
    scale = np.sqrt(max(norms.max(initial=0.0), 1e-300))
    return (np.hstack([vectors, rest[:, None]]) / scale).astype(np.float32)


def aimed(vectors: np.ndarray) -> np.ndarray:
    """Where queries in the vectors' directions lie among augmented points. No vector is zero."""
    unit = vectors / np.sqrt((vectors.astype(np.float64) ** 2).sum(1, keepdims=True))
    return np.hstack([unit, np.zeros((len(unit), 1))]).astype(np.float32)


def build(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (n x SLACK + AHEAD ids, -1: none) and start nodes of a shard's graph."""
    points = augmented(vectors)
    n = len(points)
    squares = (points**2).sum(1)
    aims = aimed(vectors)
    apart = ((points - aims) ** 2).sum(1) > APART
    edges = np.full((n, SLACK + AHEAD), -1, np.int64)
    order = np.random.default_rng(n).permutation(n)
    medoid = int(((points - points.mean(0)) ** 2).sum(1).argmin()) if n else 0
    order = np.concatenate([[medoid], order[order != medoid]])[:n]
    starts = order[: min(8, n)]

    def connect(nodes: np.ndarray, known: bool) -> None:
        inner = squares[nodes][None, :] - 2 * points[nodes] @ points[nodes].T
        np.fill_diagonal(inner, np.inf)
        own = nodes[np.argsort(inner, 1)[:, : min(16, len(nodes))]]
        aside = nodes[np.argsort(-aims[nodes] @ points[nodes].T, 1)[:, : min(16, len(nodes))]]
        pool = [own, aside, edges[nodes]]
        if known:
            pool.append(search(points, squares, edges, starts, points[nodes], BUILD_BEAM)[0])
            lean = np.flatnonzero(apart[nodes])
            ahead = np.full((len(nodes), BUILD_BEAM), -1, np.int64)
            ahead[lean] = search(points, squares, edges, starts, aims[nodes[lean]], BUILD_BEAM)[0]
            pool.append(ahead)
        pool = np.hstack(pool)
        kept = prune(points, nodes, pool, DEGREE, ALPHA, points[nodes])
        pool = np.where((pool[:, :, None] == kept[:, None, :]).any(2), -1, pool)
        edges[nodes] = -1
        edges[nodes, :DEGREE] = kept
        edges[nodes, SLACK:] = prune(points, nodes, pool, AHEAD, ALPHA, aims[nodes])
        held = (edges[:, :SLACK] >= 0).sum(1)
        target, source = kept.ravel(), np.repeat(nodes, kept.shape[1])
        order_ = np.argsort(target, kind="stable")
        target, source = target[order_], source[order_]
        target, source = target[target >= 0], source[target >= 0]
        at, first, many = np.unique(target, return_index=True, return_counts=True)
        place = held[target] + np.arange(len(target)) - np.repeat(first, many)
        fits = np.repeat(held[at] + many <= SLACK, many)
        edges[target[fits], place[fits]] = source[fits]
        over = np.flatnonzero(held[at] + many > SLACK)
        over = over[np.argsort(many[over], kind="stable")]  # alike in width
        for part in range(0, len(over), BATCH):
            chosen = over[part : part + BATCH]
            widest = int(many[chosen].max())
            slot = np.arange(widest)
            more = np.where(slot < many[chosen][:, None], source[np.minimum(first[chosen][:, None] + slot, len(source) - 1)], -1)
            full = at[chosen]
            slim = prune(points, full, np.hstack([edges[full, :SLACK], more]), DEGREE, ALPHA, points[full])
            edges[full, :SLACK] = -1
            edges[full, :DEGREE] = slim

    for turn in range(2):
        for part in range(0, n, BATCH):
            connect(order[part : part + BATCH], known=turn > 0 or part > 0)
    return edges, starts


def shard_size(n: int, dim: int) -> int:
    """Vectors of a shard on average, of n vectors in all with at most dim components."""
    return min(max(SHARD, int(ROOT * n**0.5)), max(1024, SHARD_BYTES // (8 * max(dim, 1))))


def valid(embeddings: DataFrame) -> DataFrame:
    v = F.col("embedding")
    fine = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))) & F.exists(v, lambda x: x != 0)
    return embeddings.where("vec_id is not null and embedding is not null").where(fine).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def nearest(embeddings: DataFrame, is_query: F.Column, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest that were found for each query row, itself left out."""
    rows = materialise(valid(embeddings.select("vec_id", "embedding")).withColumn("k1", F.xxhash64("embedding")).withColumn("k2", F.xxhash64(F.lit(7), "embedding")), "ann-rows")
    key = ["k1", "k2"]
    distinct = rows.groupBy(*key).agg(F.min("embedding").alias("embedding"), F.max(is_query).alias("asked"))
    n, longest = distinct.agg(F.count("*"), F.max(F.size("embedding"))).first()
    size = shard_size(n, longest or 1)
    shards = max(1, -(-n // size))
    nodes = materialise(distinct.withColumn("dim", F.size("embedding")).withColumn("shard", F.pmod("k1", F.lit(shards)).cast("int")), "ann-nodes")
    first = Window.partitionBy(*key).orderBy("vec_id")
    members = materialise(rows.select(*key, "vec_id", F.row_number().over(first).alias("r")).where(F.col("r") <= k + 1).drop("r"), "ann-members")

    def index(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["k1", "k2"])
        vectors = np.array(part["embedding"].tolist(), np.float64)
        edges, starts = build(vectors)
        head = part.iloc[0]
        return pd.DataFrame([{"dim": head["dim"], "shard": head["shard"], "keys": part[["k1", "k2"]].to_numpy(np.int64).tobytes(), "vectors": vectors.tobytes(), "edges": edges.astype(np.int32).tobytes(), "starts": starts.astype(np.int32).tobytes()}])

    graphs = materialise(nodes.groupBy("dim", "shard").applyInPandas(index, "dim int, shard int, keys binary, vectors binary, edges binary, starts binary"), "ann-graphs")
    asked = nodes.where("asked").select(*key, "dim", "embedding")
    groups = max(1, -(-asked.count() // size))
    asked = asked.withColumn("part", F.pmod("k2", F.lit(groups)).cast("int"))
    places = graphs.select(F.col("dim").alias("length"), F.col("shard").alias("place"))
    # each query goes to each shard of its length once
    sent = asked.join(places, F.col("dim") == F.col("length")).select(*key, "embedding", F.col("length").alias("dim"), F.col("place").alias("shard"), F.col("part").alias("part"))
    copies = graphs.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def look(graph: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        columns = ["q1", "q2", "k1", "k2", "score"]
        if not len(graph) or not len(queries):
            return pd.DataFrame(columns=columns)
        g = graph.iloc[0]
        d = int(g["dim"])
        keys = np.frombuffer(g["keys"], np.int64).reshape(-1, 2)
        vectors = np.frombuffer(g["vectors"], np.float64).reshape(-1, d)
        edges = np.frombuffer(g["edges"], np.int32).reshape(-1, SLACK + AHEAD).astype(np.int64)
        starts = np.frombuffer(g["starts"], np.int32).astype(np.int64)
        points = augmented(vectors)
        squares = (points**2).sum(1)
        out = []
        for at in range(0, len(queries), BLOCK):
            part = queries.iloc[at : at + BLOCK]
            exact = np.array(part["embedding"].tolist(), np.float64)
            found, _ = search(points, squares, edges, starts, aimed(exact), BEAM)
            score = np.where(found >= 0, np.einsum("bkd,bd->bk", vectors[found], exact), -np.inf)
            order = np.argsort(-score, 1, kind="stable")
            found, score = np.take_along_axis(found, order, 1), np.take_along_axis(score, order, 1)
            ask = np.repeat(part[["k1", "k2"]].to_numpy(np.int64), found.shape[1], 0)
            # all that tie with the last one stay: vec_ids decide, and are joined later
            good = ((found >= 0) & (score >= score[:, [min(k, score.shape[1] - 1)]])).ravel()
            out.append(np.column_stack([ask, keys[found.ravel()]])[good])
            out.append(score.ravel()[good])
        pairs, scores = np.vstack(out[::2]), np.concatenate(out[1::2])
        return pd.DataFrame({"q1": pairs[:, 0], "q2": pairs[:, 1], "k1": pairs[:, 2], "k2": pairs[:, 3], "score": scores})

    left, right = ([f[c] for c in ("dim", "shard", "part")] for f in (copies, sent))
    found = copies.groupBy(*left).cogroup(sent.groupBy(*right)).applyInPandas(look, "q1 long, q2 long, k1 long, k2 long, score double")
    asker = Window.partitionBy("q1", "q2")
    best = found.withColumn("r", F.rank().over(asker.orderBy(F.desc("score")))).where(F.col("r") <= k + 1).drop("r")
    expanded = best.join(members, key).withColumn("r", F.row_number().over(asker.orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= k + 1).select("q1", "q2", "vec_id", "score")
    askers = rows.where(is_query).select(F.col("k1").alias("q1"), F.col("k2").alias("q2"), F.col("vec_id").alias("query_id"))
    joined = askers.join(materialise(expanded, "ann-found"), ["q1", "q2"]).where("vec_id <> query_id")
    ranked = joined.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


QUERIES = {"op2_neighbours": op2_neighbours}
