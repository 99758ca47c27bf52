"""Problem 3: the k most similar vectors of every vector.

Method: the collection is routed to shards by centroids, and over each shard a
robust-pruned directed graph is built: greedy beam searches propose neighbours, and
pruning with a relaxed distance keeps edges that point in diverse directions. A beam
search takes every vector to the graph of its own shard, also from its own node, and to the
few shards whose centroids are about as near; the shards' answers are merged. All steps
run on whole blocks of vectors at once, inside tasks that Spark partitions.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.lineage import cut
from lectern.functions.skew import salted_join

K, DIM = 5, 64
#: Edges of a node, random ones it begins with, beam while building and while searching, factor of the relaxed distance.
DEGREE, LOOSE, BUILD_BEAM, BEAM, ALPHA = 24, 4, 32, 32, 1.1
#: Vectors a centroid is meant for, most centroids, vectors of the sample they are fitted on for each, and rounds of that.
SHARD_SIZE, MOST_SHARDS, PER_CENTROID, ROUNDS = 8_000, 4096, 64, 8
#: A vector visits the shards whose centroids are by at most so much less similar than the nearest one, and at most so many.
NEAR, VISITS = 0.1, 6
#: Most vectors of one graph and of one block of visitors; larger shards are split, larger crowds come in blocks.
LARGEST, CROWD = 20_000, 50_000
#: Cells of the table of seen nodes in one block of searches.
CELLS = 1 << 24


def _unit(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(1)
            b = b.filter(pc.and_(pc.is_valid(b.column(0)), pc.equal(pc.fill_null(pc.list_value_length(v), 0), dim)))
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)  # nulls become NaN
            with np.errstate(all="ignore"):
                norm = np.sqrt((x * x).sum(1))
            fine = np.isfinite(norm) & (norm > 0)
            unit = (x[fine] / norm[fine, None]).astype(np.float32)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(fine)), pa.array([u.tobytes() for u in unit], pa.binary())], names=["id", "v"])

    return run


def usable(df: DataFrame, key: str, vector: str, dim: int = DIM) -> DataFrame:
    """(id, v): the unit vector of each id, packed; those of another length, with null, NaN or infinity, or all zero are left out.

    Repeated ids count once; with different vectors the one of the least bytes counts.
    """
    x = df.select(F.col(key).cast("string").alias("id"), F.col(vector).alias("v"))
    return x.mapInArrow(_unit(dim), "id string, v binary").groupBy("id").agg(F.min("v").alias("v"))


def search(points: np.ndarray, edges: np.ndarray, queries: np.ndarray, starts: np.ndarray, beam: int, step: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Beam search of many queries at once: (positions, similarities), best first; -1 where a beam isn't full.

    Each search begins at its row of starts and expands, step nodes at a time, the best
    ones of its beam until all of the beam are expanded; no node is looked at twice.
    """
    ids, sim = np.full((len(queries), beam), -1, np.int32), np.full((len(queries), beam), -2, np.float32)
    size = max(16, CELLS // max(len(points), 1))
    for a in range(0, len(queries), size):
        part = slice(a, a + size)
        _search(points, edges, queries[part], starts[part], step, ids[part], sim[part])
    order = np.argsort(-sim, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sim, order, 1)


def _search(points: np.ndarray, edges: np.ndarray, queries: np.ndarray, new: np.ndarray, step: int, ids: np.ndarray, sim: np.ndarray) -> None:
    n, beam = len(points), ids.shape[1]
    seen, live = np.zeros(len(queries) * n, bool), np.arange(len(queries))
    i, s, d = ids.copy(), sim.copy(), np.ones(ids.shape, bool)  # d: expanded, or nothing
    while True:
        at = (live[:, None] * n + new)[new >= 0]
        at = at[~seen[at]]
        at.sort()
        at = at[np.concatenate([[True], at[1:] != at[:-1]])] if len(at) else at
        seen[at] = True
        row, node = np.divmod(at, n)
        fresh = np.einsum("ij,ij->i", points[node], queries[row])
        r = np.searchsorted(live, row)
        enters = fresh > s.min(1)[r]
        r, node, fresh = r[enters], node[enters], fresh[enters]
        count = np.bincount(r, minlength=len(live))
        nth = np.arange(len(r)) - np.repeat(np.cumsum(count) - count, count)
        more_i, more_s = np.full((len(live), count.max()), -1, np.int32), np.full((len(live), count.max()), -2, np.float32)
        more_i[r, nth], more_s[r, nth] = node, fresh
        i, s, d = np.concatenate([i, more_i], 1), np.concatenate([s, more_s], 1), np.concatenate([d, more_i < 0], 1)
        top = np.argpartition(-s, beam - 1, axis=1)[:, :beam]
        i, s, d = (np.take_along_axis(x, top, 1) for x in (i, s, d))
        over = d.all(1)
        ids[live[over]], sim[live[over]] = i[over], s[over]
        live, i, s, d = live[~over], i[~over], s[~over], d[~over]
        if not len(live):
            return
        best = np.argpartition(np.where(d, 9, -s), step - 1, axis=1)[:, :step]
        nodes = np.where(np.take_along_axis(d, best, 1), -1, np.take_along_axis(i, best, 1))
        np.put_along_axis(d, best, True, 1)
        new = np.where(nodes[:, :, None] >= 0, edges[nodes], -1).reshape(len(live), -1)


def prune(points: np.ndarray, nodes: np.ndarray, pool: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each node, at most degree of its pool: the nearest, then the next one that no chosen one is alpha times nearer to."""
    pool = np.where(pool == nodes[:, None], -1, pool)
    to = np.where(pool < 0, 9, 2 - 2 * np.matmul(points[pool], points[nodes][:, :, None])[:, :, 0])
    order = np.argsort(to, axis=1)
    pool, to = np.take_along_axis(pool, order, 1), np.take_along_axis(to, order, 1)
    to[:, 1:][pool[:, 1:] == pool[:, :-1]] = 9
    x = points[pool]
    between = 2 - 2 * np.matmul(x, x.transpose(0, 2, 1))
    out, left, rows = np.full((len(nodes), degree), -1, np.int32), to < 9, np.arange(len(nodes))
    for k in range(degree):
        first = left.argmax(1)
        some = left[rows, first]
        if not some.any():
            break
        out[some, k] = pool[rows, first][some]
        left &= alpha * alpha * between[rows, first] > to
        left[rows, first] = False
    return out


def _link_back(points: np.ndarray, edges: np.ndarray, nodes: np.ndarray, degree: int, alpha: float) -> None:
    """Links the neighbours of nodes back to them: as they come while there is room, pruned where there is none."""
    back, forth = edges[nodes].ravel(), np.repeat(nodes, degree)
    by = np.argsort(back, kind="stable")
    back, forth = back[by][back[by] >= 0], forth[by][back[by] >= 0]
    heads, starts = np.unique(back, return_index=True)
    count = np.diff(np.append(starts, len(back)))
    nth, row = np.arange(len(back)) - np.repeat(starts, count), np.repeat(np.arange(len(heads)), count)
    new, fits = np.full((len(heads), degree), -1, np.int32), nth < degree
    new[row[fits], nth[fits]] = forth[fits]
    new[(new[:, :, None] == edges[heads][:, None, :]).any(2)] = -1
    got = (new >= 0).sum(1)
    room = (edges[heads] >= 0).sum(1) + got <= degree
    h = heads[room & (got > 0)]
    both = np.concatenate([edges[h], new[room & (got > 0)]], 1)
    edges[h] = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable")[:, :degree], 1)
    full = np.flatnonzero(~room & (got > 0))
    for a in range(0, len(full), 2048):
        h = heads[full[a : a + 2048]]
        edges[h] = prune(points, h, np.concatenate([edges[h], new[full[a : a + 2048]]], 1), degree, alpha)


def pivots_of(points: np.ndarray, queries: np.ndarray, near: int = 8, seed: int = 5) -> np.ndarray:
    """For each query, where a search begins: the nearest of about 2 sqrt(n) chosen nodes."""
    n = len(points)
    pivots = np.sort(np.random.default_rng(seed).choice(n, min(n, max(16, int(2 * n**0.5))), replace=False)).astype(np.int32)
    near, chosen, out = min(near, len(pivots)), points[pivots].T, []
    for a in range(0, len(queries), 4096):
        out.append(pivots[np.argpartition(-(queries[a : a + 4096] @ chosen), near - 1, axis=1)[:, :near]])
    return np.concatenate(out) if out else np.zeros((0, near), np.int32)


def build(points: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, seed: int = 3) -> np.ndarray:
    """The edges of the graph over unit vectors: each node is searched for, linked to its pruned pool, and linked back."""
    rng, n = np.random.default_rng(seed), len(points)
    edges = np.full((n, degree), -1, np.int32)
    if n > 1:
        edges[:, :LOOSE] = rng.integers(0, n, (n, LOOSE))
    order = rng.permutation(n).astype(np.int32)
    at, size = 0, 256
    while at < n:
        nodes = order[at : at + size]
        at, size = at + len(nodes), min(2 * size, 2048)
        pool, _ = search(points, edges, points[nodes], pivots_of(points, points[nodes]), beam)
        edges[nodes] = prune(points, nodes, np.concatenate([pool, edges[nodes]], 1), degree, alpha)
        _link_back(points, edges, nodes, degree, alpha)
    return edges


def _matrix(column: pd.Series, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float32).reshape(-1, dim)


def centroids(sample: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 1) -> np.ndarray:
    """k directions by spherical k-means over a sample of unit vectors."""
    c = sample[np.random.default_rng(seed).choice(len(sample), k, replace=False)].copy()
    for _ in range(rounds):
        of = np.concatenate([(sample[a : a + 8192] @ c.T).argmax(1) for a in range(0, len(sample), 8192)])
        total = np.zeros_like(c)
        np.add.at(total, of, sample)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 0, total / np.maximum(norm, 1e-12), c).astype(np.float32)
    return c


def _routes(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """For each vector the shards it visits, its own first, -1 for none."""
    out = []
    for a in range(0, len(x), 4096):
        s = x[a : a + 4096] @ c.T
        top = np.argsort(-s, axis=1, kind="stable")[:, :VISITS]
        near = np.take_along_axis(s, top, 1)
        out.append(np.where(near >= near[:, :1] - NEAR, top, -1))
    return np.concatenate(out)


def _loads(held, dim: int):
    """(shard, own, visits): of a batch, how many vectors belong to each shard and how many visit it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                r = _routes(_matrix(b["v"], dim), held.value)
                own, all_ = np.bincount(r[:, 0], minlength=len(held.value)), np.bincount(r[r >= 0], minlength=len(held.value))
                yield pd.DataFrame({"shard": np.arange(len(all_), dtype=np.int32), "own": own, "visits": all_})

    return run


def _sent(held, parts, blocks, dim: int):
    """(shard, part, block, home, cls, v): each vector to its part of its shard, in every block, and to the parts of the shards it visits, in one block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n_parts, n_blocks = parts.value, blocks.value
        for b in batches:
            if not len(b):
                continue
            r = _routes(_matrix(b["v"], dim), held.value)
            h = np.array([int.from_bytes(c[:8], "little", signed=False) for c in b["cls"]], np.uint64)
            own = r[:, 0]
            part, row = (h % n_parts[own].astype(np.uint64)).astype(np.int64), np.arange(len(b))
            at = np.repeat(row, n_blocks[own])
            block = np.concatenate([np.arange(n) for n in n_blocks[own]])
            rows = [pd.DataFrame({"shard": own[at], "part": part[at], "block": block, "home": True, "i": at})]
            for j in range(r.shape[1]):
                to = np.flatnonzero(r[:, j] >= 0)
                shard = r[to, j]
                at = np.repeat(to, n_parts[shard])
                p = np.concatenate([np.arange(n) for n in n_parts[shard]]) if len(to) else np.zeros(0, np.int64)
                other = np.ones(len(at), bool) if j else p != part[at]  # in its own part a vector is at home
                at, p = at[other], p[other]
                block = ((h[at] >> np.uint64(20)) % n_blocks[r[at, j]].astype(np.uint64)).astype(np.int64)
                rows.append(pd.DataFrame({"shard": r[at, j], "part": p, "block": block, "home": False, "i": at}))
            out = pd.concat(rows)
            i = out.pop("i").to_numpy()
            yield out.assign(cls=b["cls"].to_numpy()[i], v=b["v"].to_numpy()[i])

    return run


def _both_ways(asked: np.ndarray, ids: np.ndarray, sim: np.ndarray, k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best for each of the asked nodes of a graph of n, what other nodes found of it included."""
    a, b, s = np.repeat(asked, ids.shape[1]), ids.ravel().astype(np.int64), sim.ravel()
    a, b, s = a[b >= 0], b[b >= 0], s[b >= 0]
    a, b, s = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([s, s])
    where = np.full(n, -1, np.int64)
    where[asked] = np.arange(len(asked))
    pair, first = np.unique((a * n + b)[where[a] >= 0], return_index=True)
    s = s[where[a] >= 0][first]
    a, b = where[pair // n], pair % n
    by = np.lexsort((b, -s, a))
    a, b, s = a[by], b[by], s[by]
    nth = np.arange(len(a)) - np.searchsorted(a, a)
    out_i, out_s = np.full((len(asked), k), -1, np.int32), np.full((len(asked), k), -2, np.float32)
    out_i[a[nth < k], nth[nth < k]], out_s[a[nth < k], nth[nth < k]] = b[nth < k], s[nth < k]
    return out_i, out_s


def _answered(k: int, dim: int, blocks):
    def answer(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        home, visit = group[group["home"]].sort_values("cls"), group[~group["home"]]  # in this order, so that each run gives the same
        out = []
        if len(home):
            points, names = _matrix(home["v"], dim), home["cls"].to_numpy()
            edges = build(points)
            mine = np.flatnonzero([(int.from_bytes(c[:8], "little", signed=False) >> 20) % int(blocks.value[key[0]]) == key[2] for c in names])  # each home vector asks in one block
            asked = [(names[mine], points[mine], np.concatenate([mine[:, None].astype(np.int32), pivots_of(points, points[mine])], 1))]
            if len(visit):
                v = _matrix(visit["v"], dim)
                asked.append((visit["cls"].to_numpy(), v, pivots_of(points, v)))
            for j, (who, x, starts) in enumerate(asked):
                ids, sim = search(points, edges, x, starts, BEAM)
                if j == 0:
                    ids, sim = _both_ways(mine, ids, sim, k + 1, len(points))
                ids, sim = ids[:, : k + 1].ravel(), sim[:, : k + 1].ravel()
                out.append(pd.DataFrame({"cls": np.repeat(who, min(k + 1, BEAM))[ids >= 0], "nb": names[ids[ids >= 0]], "cosine": sim[ids >= 0]}))
        return pd.concat(out) if out else pd.DataFrame({"cls": pd.Series(dtype=object), "nb": pd.Series(dtype=object), "cosine": pd.Series(dtype="float32")})

    return answer


def _classed(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.frombuffer(b"".join(b.column(1).to_pylist()), np.float32).reshape(-1, dim)
            grid = np.rint(x * 1e5).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([xxhash.xxh3_128_digest(g.tobytes()) for g in grid], pa.binary())], names=["id", "v", "cls"])

    return run


def most_similar(vectors: DataFrame, k: int = K, shard_size: int = SHARD_SIZE, largest: int = LARGEST, crowd: int = CROWD, dim: int = DIM) -> DataFrame:
    """(id, nb, cosine, rank): the k other ids of highest cosine for every id of (id, v) as usable gives them.

    Equal directions (to five decimals) are one point of the graph, so copies crowd no
    search; they come out as each other's neighbours, ties in the order of the ids. Fewer
    than k others give fewer rows; one vector or none gives no row. The centroids are
    fitted on a sample of at most PER_CENTROID vectors for each; every vector is indexed
    and asked. Routing and graph are approximate: tests measure the recall.
    """
    context = vectors.sparkSession.sparkContext
    members = cut(vectors.select("id", "v").mapInArrow(_classed(dim), "id string, v binary, cls binary"))
    reps = cut(members.groupBy("cls").agg(F.min("v").alias("v")))
    n = reps.count()
    shards = min(MOST_SHARDS, max(1, -(-n // shard_size)))
    share = max(1, n // (PER_CENTROID * shards))
    sample = [r["v"] for r in reps.where(F.pmod(F.xxhash64("cls", F.lit(7)), F.lit(share)) == 0).select("v").limit(2 * PER_CENTROID * shards).collect()] or [r["v"] for r in reps.select("v").limit(1).collect()]
    x = _matrix(pd.Series(sample, dtype=object), dim)
    held = context.broadcast(centroids(x, min(shards, len(x))) if len(x) else np.zeros((1, dim), np.float32))
    own, visits = np.zeros(len(held.value), np.int64), np.zeros(len(held.value), np.int64)
    for r in reps.mapInPandas(_loads(held, dim), "shard int, own bigint, visits bigint").groupBy("shard").agg(F.sum("own").alias("own"), F.sum("visits").alias("visits")).collect():  # a row for each shard
        own[r["shard"]], visits[r["shard"]] = r["own"], r["visits"]
    parts, blocks = context.broadcast(np.maximum(1, -(-own // largest))), context.broadcast(np.maximum(1, -(-visits // crowd)))
    sent = reps.mapInPandas(_sent(held, parts, blocks, dim), "shard int, part int, block int, home boolean, cls binary, v binary")
    found = sent.groupBy("shard", "part", "block").applyInPandas(_answered(k, dim, blocks), "cls binary, nb binary, cosine float")
    best = Window.partitionBy("cls").orderBy(F.desc("cosine"), "nb")
    found = found.where("cls != nb").withColumn("r", F.row_number().over(best)).where(F.col("r") <= k)
    classes = found.select("cls", "nb", "cosine").union(reps.select("cls", F.col("cls").alias("nb"), F.lit(1.0).cast("float")))
    first = members.select("cls", "id").withColumn("r", F.row_number().over(Window.partitionBy("cls").orderBy("id"))).where(F.col("r") <= k + 1)
    spread = classes.join(first.select(F.col("cls").alias("nb"), F.col("id").alias("other")), "nb").select("cls", "other", "cosine")
    order = Window.partitionBy("cls").orderBy(F.desc("cosine"), "other")
    spread = spread.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    each = salted_join(members.select("id", "cls"), cut(spread), ["cls"], "id").where("id != other")
    rank = F.row_number().over(Window.partitionBy("id").orderBy("r"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("id", F.col("other").alias("nb"), F.col("cosine").cast("double").alias("cosine"), "rank")


def collection(*tables: tuple[DataFrame, str, str], dim: int = DIM) -> DataFrame:
    """The usable vectors of several (table, key, vector) as one collection."""
    return reduce(DataFrame.union, [usable(t, k, v, dim) for t, k, v in tables])
