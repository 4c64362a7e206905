"""Approximate nearest neighbours by a robust-pruned directed graph in each shard."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

GRAPH = "shard int, band int, vectors binary, edges binary, entry int, ids array<array<bigint>>, width int"
#: Binary orders of magnitude in a shard, and those by which a vector must exceed another for the other to change no distance.
#: Within both together no square of a double underflows.
BAND, APART = 200, 80


def distances(x: np.ndarray, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distances from each q to the vectors that its row of `rows` names; -1 names none."""
    at, col = np.nonzero(rows >= 0)
    ids, near = rows[at, col], np.empty(len(at))
    for lo in range(0, len(at), 2048):  # what a step reads stays in the cache
        d = x[ids[lo : lo + 2048]]
        d -= q[at[lo : lo + 2048]]
        near[lo : lo + 2048] = np.einsum("nd,nd->n", d, d)
    out = np.full(rows.shape, np.inf)
    out[at, col] = near
    return out


def magnitudes(x: np.ndarray) -> np.ndarray:
    """The binary exponent of each vector's largest component."""
    return np.frexp(np.abs(x).max(axis=1, initial=0.0))[1]


def band() -> Column:
    """Which `BAND` powers of two the largest component of `v` lies in."""
    return F.floor(F.log2(F.array_max(F.transform("v", lambda x: F.abs(x)))) / BAND).cast("int")


def euclidean(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of rows of `a` and `b` (last axis), finite wherever the exact value is a finite double."""
    half = a / 2 - b / 2
    power = np.frexp(np.abs(half).max(axis=-1))[1]
    part = np.ldexp(half, -power[..., None])
    return np.ldexp(np.sqrt(np.einsum("...d,...d->...", part, part)), power + 1)


def beam_search(x: np.ndarray, edges: np.ndarray, entry: int, q: np.ndarray, beam: int, expand: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of all q together: ids and squared distances of the `beam` nearest met (-1 fills).

    In a step every query expands its `expand` nearest nodes not expanded yet; it ends when its beam has none.
    """
    n = len(q)
    ids, dist, done = np.full((n, beam), -1, np.int64), np.full((n, beam), np.inf), np.zeros((n, beam), bool)
    ids[:, 0] = entry
    dist[:, 0] = distances(x, ids[:, :1], q)[:, 0]
    live = np.arange(n)
    while len(live):
        here, far, was = ids[live], dist[live], done[live]
        open_ = (here >= 0) & ~was
        nth = np.cumsum(open_, axis=1)
        pick = open_ & (nth <= expand)
        has = nth[:, -1] > 0
        if not has.all():
            live, here, far, was, pick = live[has], here[has], far[has], was[has], pick[has]
            if not len(live):
                break
        was |= pick
        nodes = np.full((len(live), expand), -1, np.int64)
        at, col = np.nonzero(pick)
        nodes[at, nth[has][at, col] - 1] = here[at, col]
        near = edges[nodes].astype(np.int64)
        near[nodes < 0] = -1
        near = np.sort(near.reshape(len(live), -1), axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        met = np.sort(here, axis=1)
        flat = met + (np.arange(len(live)) * (len(x) + 1))[:, None]
        want = near + (np.arange(len(live)) * (len(x) + 1))[:, None]
        found = np.searchsorted(flat.ravel(), want.ravel())
        seen = flat.ravel()[np.minimum(found, flat.size - 1)] == want.ravel()
        near[seen.reshape(near.shape)] = -1
        d = distances(x, near, q[live])
        d[d >= far[:, -1:]] = np.inf  # what only equals the beam's last stays out, or equal ones would push each other out for ever
        all_d = np.concatenate([far, d], axis=1)
        top = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
        part = np.take_along_axis(all_d, top, 1)
        top = np.take_along_axis(top, np.argsort(part, axis=1), 1)
        dist[live] = np.take_along_axis(all_d, top, 1)
        ids[live] = np.where(np.isinf(dist[live]), -1, np.take_along_axis(np.concatenate([here, near], axis=1), top, 1))
        done[live] = np.take_along_axis(np.concatenate([was, np.zeros(near.shape, bool)], axis=1), top, 1)
    return ids, dist


def robust_prune(x: np.ndarray, own: np.ndarray, ids: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each `own`, up to `degree` of its candidates: the nearest one stays, and removes those that are `alpha` times nearer to it than to `own`."""
    ids = np.where(ids == own[:, None], -1, ids)
    dist = distances(x, ids, x[own])
    order = np.argsort(dist, axis=1, kind="stable")
    ids, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
    out = np.full((len(own), degree), -1, np.int64)
    alive, vectors, every = ~np.isinf(dist), x[ids], np.arange(len(own))
    squares = np.einsum("brd,brd->br", vectors, vectors)
    for k in range(degree):
        any_ = alive.any(axis=1)
        if not any_.any():
            break
        at = alive.argmax(axis=1)
        out[:, k] = np.where(any_, ids[every, at], -1)
        between = squares + squares[every, at][:, None] - 2 * np.matmul(vectors, vectors[every, at][:, :, None])[:, :, 0]
        alive &= ~((alpha * alpha * between <= dist) & any_[:, None])
        alive[every, at] = False
    return out


def build_graph(x: np.ndarray, degree: int = 24, beam: int = 48, alpha: float = 1.2, batch: int = 1024) -> tuple[np.ndarray, int]:
    """Edges (rows x 2 degree, -1 fills) and the entry, the vector nearest the mean.

    Vectors join in batches that double up to `batch`: a greedy search proposes neighbours, pruning picks
    `degree` of them, and they link back. A node keeps up to twice the degree of links before it is pruned again.
    """
    n, wide = len(x), 2 * degree
    entry = int(np.argmin(((x - x.mean(axis=0)) ** 2).sum(axis=1)))
    edges, filled = np.full((n, wide), -1, np.int32), np.zeros(n, np.int64)
    order = np.random.default_rng(0).permutation(n)
    order = np.concatenate(([entry], order[order != entry]))
    at, size = 1, 1
    while at < n:
        new = order[at : at + size]
        ids, _ = beam_search(x, edges, entry, x[new], beam)
        ids = np.concatenate([ids, np.broadcast_to(new[:16], (len(new), len(new[:16])))], axis=1)
        picked = robust_prune(x, new, ids, degree, alpha)
        edges[new, :degree], filled[new] = picked, (picked >= 0).sum(axis=1)
        src, dst = np.repeat(new, degree), picked.ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        mutual = (edges[dst] == src[:, None]).any(axis=1)  # two new ones that picked each other
        src, dst = src[~mutual], dst[~mutual]
        by = np.argsort(dst, kind="stable")
        src, dst = src[by], dst[by]
        heads, first, counts = np.unique(dst, return_index=True, return_counts=True)
        nth = np.arange(len(dst)) - np.repeat(first, counts)
        slot = filled[dst] + nth
        fits = slot < wide
        edges[dst[fits], slot[fits]] = src[fits]
        full = heads[filled[heads] + counts > wide]
        filled[heads] = np.minimum(filled[heads] + counts, wide)
        if len(full):
            width = int(counts.max())
            more = np.full((len(full), width), -1, np.int64)
            over = ~fits
            more[np.searchsorted(full, dst[over]), nth[over]] = src[over]
            for lo in range(0, len(full), 1024):
                own = full[lo : lo + 1024]
                kept = robust_prune(x, own, np.concatenate([edges[own], more[lo : lo + 1024]], axis=1), degree, alpha)
                edges[own] = -1
                edges[own, :degree], filled[own] = kept, (kept >= 0).sum(axis=1)
        at, size = at + len(new), min(size * 2, batch)
    return edges, entry


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """`(id, v)` of the vectors that take part: doubles, not null or zero, all components finite."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(fine & F.exists("v", lambda x: x != 0))


def build_index(rows: DataFrame, copies: int, shard_mb: int = 32, spread: int = 8, least: int = 4096, degree: int = 24, beam: int = 48, alpha: float = 1.2) -> DataFrame:
    """One graph a shard (`GRAPH`), over distinct vectors dealt out by hash; each carries its `copies` smallest ids.

    Vectors of a shard are of one band of magnitudes, so that one huge vector does not blur the others. A shard holds about `shard_mb` of vectors, which a task builds in memory; shards are `spread` at least, where
    each has `least` vectors. Rows with equal vectors are one node, so a vector that very many rows share neither crowds the graph nor
    a task: a rank filter on it, which Spark applies before the shuffle too, keeps its smallest ids.
    """
    same = Window.partitionBy("v").orderBy("id")
    kept = rows.withColumn("nth", F.row_number().over(same)).where(F.col("nth") <= copies)
    distinct = materialize(kept.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")), "vectors")
    n, numbers = distinct.agg(F.count(F.lit(1)), F.sum(F.size("v"))).first()
    shards = max(1, -(-(numbers or 0) * 8 // (shard_mb << 20)), min(spread, -(-n // least)))

    def build(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(f["v"].to_numpy()).astype(np.float64)
        edges, entry = build_graph(np.ldexp(x, -magnitudes(x).max()), degree, beam, alpha)
        return pd.DataFrame({"shard": [key[0]], "band": [key[2]], "vectors": [x.astype("<f8").tobytes()], "edges": [edges.astype("<i4").tobytes()], "entry": [entry], "ids": [[list(map(int, i)) for i in f["ids"]]], "width": [x.shape[1]]})

    dealt = distinct.withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int")).withColumn("size", F.size("v")).withColumn("band", band())
    return materialize(dealt.groupBy("shard", "size", "band").applyInPandas(build, GRAPH), "graphs")


def search_index(graphs: DataFrame, queries: DataFrame, k: int, beam: int | None = None, block: int = 32768) -> DataFrame:
    """`(query_id, rank, vec_id, score)`: the k nearest found for each query `(id, v)`, itself left out.

    Without a `beam` it is 16 times the fourth root of a shard's vectors (128 for 4,096, 256 for 65,536), which
    holds recall as shards grow. Queries go in blocks of about `block`, so a graph is copied once for each; a block and a shard are one
    task's beam search, and the shards' answers meet by rank. Where a query and a shard are far apart in size, the smaller side changes no distance:
    the shard's shortest vectors are the nearest to a small query, and all are as far from a large one. Scores are Euclidean distances of the original vectors in doubles; ties go
    to the smaller id.
    """
    blocks = max(1, -(-queries.count() // block))
    asked = queries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("width", F.size("v"))
    pairs = graphs.select(F.col("shard").alias("shard"), F.col("width").alias("width")).distinct()
    left = asked.join(pairs, "width")
    right = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def search(qs: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, float]] = []
        for row in g.itertuples() if len(qs) else ():
            x = np.frombuffer(row.vectors, "<f8").reshape(-1, row.width)
            edges = np.frombuffer(row.edges, "<i4").reshape(len(x), -1)
            wide = max(beam or round(16 * len(x) ** 0.25), k + 1)
            sizes, asked = magnitudes(x), np.stack(qs["v"].to_numpy()).astype(np.float64)
            least = np.array([i[0] for i in row.ids])
            side = np.where(magnitudes(asked) >= sizes.max() + APART, 1, np.where(magnitudes(asked) <= sizes.min() - APART, -1, 0))
            for of in np.unique(side):
                every, own_ids = asked[side == of], qs["id"].to_numpy()[side == of]
                if of:  # all are as far from a large query; to a small one the shortest are the nearest
                    chosen = np.lexsort((least, least if of > 0 else euclidean(x, np.zeros(row.width))))[: 2 * (k + 1)]
                else:
                    power = -max(sizes.max(), magnitudes(every).max())
                    small = np.ldexp(x, power)
                for at in range(0, len(every), 512):
                    q = every[at : at + 512]
                    found = np.broadcast_to(chosen, (len(q), len(chosen))) if of else beam_search(small, edges, row.entry, np.ldexp(q, power), wide)[0]
                    d = np.where(found >= 0, euclidean(x[found], q[:, None, :]), np.inf)
                    order = np.argsort(d, axis=1, kind="stable")[:, : 2 * (k + 1)]
                    for own, nodes, ds in zip(own_ids[at : at + 512], np.take_along_axis(found, order, 1), np.take_along_axis(d, order, 1), strict=True):
                        mine = [(s, int(i)) for node, s in zip(nodes, ds, strict=True) if node >= 0 for i in row.ids[node] if i != own]
                        out += [(int(own), i, float(s)) for s, i in sorted(mine)[:k]]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    met = left.groupBy("block", "shard", "width").cogroup(right.groupBy("block", "shard", "width")).applyInPandas(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", shard_mb: int = 32, spread: int = 8, least: int = 4096, degree: int = 24, build_beam: int = 48, beam: int | None = None, alpha: float = 1.2) -> DataFrame:
    """The k nearest rows found for each query row, over all usable `vectors`; see `search_index`.

    Null or zero vectors, and those with null or non-finite components, take no part on either side. Vectors
    meet only those of their own width, and a query any vector but those of its own id. Rows that repeat an id are candidates one by one; of query rows that
    repeat one, the smallest vector asks. Queries with fewer candidates get all; empty tables give no rows; other columns are ignored.
    """
    rows, asked = usable(vectors, id_col, vector_col), usable(queries, id_col, vector_col).groupBy("id").agg(F.min("v").alias("v"))
    return search_index(build_index(rows, k + 1, shard_mb, spread, least, degree, build_beam, alpha), asked, k, beam)
