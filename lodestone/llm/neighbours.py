"""Most similar vectors: block matrix joins of int8 product tiles with error bounds.

Vectors are scaled to unit length and kept as 16-bit codes with the norm of what rounding took off;
their high bytes are the int8 codes. A tile of int8 products (exact in float32, as every sum stays
under 2^24) gives cosines with a bound on the quantisation error; only pairs the bound can't rule out
are recomputed.

``similar_pairs``: all pairs above a threshold. Blocks are Voronoi cells of pivots drawn from the
data; a vector lies in the cells of its ``PROBES`` nearest pivots, and two similar vectors almost
always share one (recall against brute force is measured in the tests and stated in the README). The
number of pivots grows with the square root of the rows without a limit, and so does the sample they
are drawn from, so that the work grows as rows^1.5. A cell that a third of all rows may share is cut
into tiles, and tile pairs are spread over tasks. With ``exact`` there is one cell of all rows: every
tile meets every other, no pair is lost, and the work grows as rows^2.

``nearest``: the k most similar vectors of every query against every row, exact, in tiles of bounded
size; each tile keeps k candidates a query by heap, which are merged by a grouped top-k.

Edge cases: vectors that are null, all zero, of another length than ``DIM`` or not finite are unusable
and in no result; repeated ids count once (their first row in a tile); identical vectors are similar
with cosine 1; ties go to the smaller id; null ids are ignored; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.session import cut_lineage, spread

DIM = 64
#: Cells a vector lies in.
PROBES = 4
#: Vectors from which pivots are drawn and cell sizes estimated, at least; four to a pivot where that is more
#: (by a hash of the id). The driver holds them: 4 * 2 * sqrt(rows) vectors, 64 MB for a thousand million rows.
SAMPLE = 8192
#: Rows of a tile, about.
TILE = 4000


def matrix(col: pa.Array, dim: int = DIM) -> tuple[np.ndarray, np.ndarray]:
    """Usable vectors of a column as unit float64 rows, and their row numbers."""
    n = len(col)
    lengths = np.asarray(col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    at = np.flatnonzero(lengths == dim)
    if not len(at):
        return np.zeros((0, dim)), at
    if len(at) < n:
        col = col.take(pa.array(at))
    v = np.asarray(col.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)
    top = np.abs(v).max(1)
    good = np.isfinite(top) & (top > 0)
    v, at, top = v[good], at[good], top[good]
    v = v / top[:, None]
    return v / np.sqrt((v * v).sum(1))[:, None], at


def quantise(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """16-bit codes of unit vectors, and the step of each row."""
    step = np.abs(u).max(1) / 32512.0
    return np.rint(u / step[:, None]).astype(np.int16), step


def coarse(codes: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes as float32, their steps, and the norm of what they leave out."""
    q = np.rint(codes / 256.0)
    rest = codes - q * 256.0
    return q.astype(np.float32), step * 256.0, np.sqrt((rest * rest).sum(1)) * step + np.sqrt(codes.shape[1]) * step / 2


def tile_pairs(a: tuple, b: tuple | None, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (row of a, row of b, cosine) of at least ``least``, less the 16-bit error; b None: a with itself.

    a and b are (codes, step) pairs."""
    other = b or a
    qa, sa, ea = coarse(*a)
    qb, sb, eb = (qa, sa, ea) if b is None else coarse(*other)
    ii, jj = [], []
    for x in range(0, len(qa), 1024):
        y0 = x if b is None else 0
        got = qa[x : x + 1024] @ qb[y0:].T
        got *= sa[x : x + 1024, None].astype(np.float32)
        # cos >= least needs  got * sb >= least - ea - eb - ea*eb
        need = (least - 1e-5 - eb[y0:] - ea[x : x + 1024].max() * (1 + eb[y0:])) / sb[y0:]
        i, j = np.nonzero(got >= need.astype(np.float32)[None, :])
        i, j = i + x, j + y0
        if b is None:
            k = i < j
            i, j = i[k], j[k]
        ii.append(i)
        jj.append(j)
    i = np.concatenate(ii) if ii else np.zeros(0, int)
    j = np.concatenate(jj) if jj else np.zeros(0, int)
    cos = np.empty(len(i))
    for x in range(0, len(i), 100_000):
        p, q = i[x : x + 100_000], j[x : x + 100_000]
        cos[x : x + 100_000] = np.einsum("nd,nd->n", a[0][p].astype(np.float64), other[0][q].astype(np.float64)) * a[1][p] * other[1][q]
    keep = cos >= least - 2 * EDGE
    return i[keep], j[keep], cos[keep]


#: The 16-bit codes' cosine is within this of the true one (dim 64: 2 * 8 * 2^-16 / 2, with room).
EDGE = 1.5e-4


def pivot_count(n: int) -> int:
    """About twice the square root of the rows, a power of two."""
    return 1 << max(3, round(math.log2(2.0 * math.sqrt(max(n, 1)))))


def pivots_of(rows: DataFrame, n: int, least: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Pivots, and the estimated share of rows in each cell, from a sample."""
    want = pivot_count(n)
    sample = max(least, 4 * want)
    share = min(1.0, 2.0 * sample / max(n, 1))
    some = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < F.lit(math.ceil(share * (1 << 20)))).select("id", "vector").limit(sample)
    table = some.toArrow().sort_by("id")
    u, _ = matrix(table["vector"].combine_chunks()) if table.num_rows else (np.zeros((0, DIM)), None)
    if not len(u):
        return np.zeros((0, DIM), np.float32), np.zeros(0)
    distinct = np.unique(np.round(u, 6), axis=0)
    order = np.random.default_rng(7).permutation(len(distinct))[: min(want, len(distinct))]
    pivots = distinct[np.sort(order)].astype(np.float32)
    cells = cells_of(u, pivots)
    return pivots, np.bincount(cells.ravel(), minlength=len(pivots)) / len(u)


def cells_of(u: np.ndarray, pivots: np.ndarray, probes: int = PROBES) -> np.ndarray:
    """Numbers of the nearest pivots of each row, nearest first."""
    probes = min(probes, len(pivots))
    out = np.empty((len(u), probes), np.int32)
    for x in range(0, len(u), 2048):
        s = u[x : x + 2048].astype(np.float32) @ pivots.T
        rows = np.arange(len(s))
        for k in range(probes):
            best = s.argmax(1)
            out[x : x + 2048, k] = best
            s[rows, best] = -2.0
    return out


_BLOCKS = "key bigint, side int, id string, codes binary, step double, cells binary"


def similar_pairs(rows: DataFrame, least: float = 0.9, probes: int = PROBES, exact: bool = False) -> DataFrame:
    """``id_a, id_b, cosine``: pairs of different ids, the smaller first, of at least ``least``.

    ``exact`` compares all rows, tile by tile, instead of the cells of ``probes`` pivots."""
    spark = rows.sparkSession
    rows = rows.select("id", "vector").filter(F.col("id").isNotNull() & (F.size("vector") == DIM))
    n = rows.count()
    pivots, shares = (np.eye(1, DIM, dtype=np.float32), np.ones(1)) if exact else pivots_of(rows, n)
    if not len(pivots):
        return spark.createDataFrame([], "id_a string, id_b string, cosine double")
    tiles = np.maximum(1, np.ceil(shares * n / TILE)).astype(np.int64)
    sent = spark.sparkContext.broadcast((pivots, tiles))

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        pivots, tiles = sent.value
        for b in batches:
            u, at = matrix(b[1])
            if not len(u):
                continue
            codes, step = quantise(u)
            cells = cells_of(u, pivots, probes)
            ids = b[0].take(pa.array(at))
            packed = np.sort(cells, axis=1).astype("<i4")
            width = packed.shape[1] * 4
            row = np.repeat(np.arange(len(u)), cells.shape[1])
            cell = cells.ravel().astype(np.int64)
            key, side = cell << 40, np.zeros(len(cell), np.int32)
            split = tiles[cell] > 1
            if split.any():
                # a cell cut into T tiles: a row of tile t goes to the tile pairs (t, x) and (x, t)
                hashes = np.fromiter((hash_id(x) for x in ids.to_pylist()), np.int64, len(ids))
                c, r, count = cell[split], row[split], tiles[cell[split]]
                t = np.repeat(hashes[r] % count, count)
                x = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                low, high = np.minimum(t, x), np.maximum(t, x)
                keep = ~split
                row = np.r_[row[keep], np.repeat(r, count)]
                key = np.r_[key[keep], np.repeat(c, count) << 40 | low << 20 | high]
                side = np.r_[side[keep], (t != low).astype(np.int32)]
            take = pa.array(row)
            fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(DIM * 2), len(u), [None, pa.py_buffer(codes.astype("<i2").tobytes())])
            lists = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(u), [None, pa.py_buffer(packed.tobytes())])
            for x in range(0, len(row), 20_000):
                t = take.slice(x, 20_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[x : x + 20_000]), pa.array(side[x : x + 20_000]), ids.take(t), fixed.cast(pa.binary()).take(t), pa.array(step).take(t), lists.cast(pa.binary()).take(t)],
                    ["key", "side", "id", "codes", "step", "cells"],
                )

    def join(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        key = group["key"][0].as_py()
        cell, lo, hi = key >> 40, key >> 20 & 0xFFFFF, key & 0xFFFFF
        ids = np.array(group["id"].to_pylist(), object)
        _, first = np.unique(ids.astype(str), return_index=True)  # repeated rows
        ids = ids[first]
        side = group["side"].to_numpy()[first]
        codes = np.frombuffer(b"".join(group["codes"].to_pylist()), "<i2").reshape(-1, DIM)[first]
        step = group["step"].to_numpy()[first]
        cells = np.frombuffer(b"".join(group["cells"].to_pylist()), "<i4").reshape(group.num_rows, -1)[first]
        if lo == hi:
            i, j, cos = tile_pairs((codes, step), None, least)
        else:
            x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            i, j, cos = tile_pairs((codes[x], step[x]), (codes[y], step[y]), least)
            i, j = x[i], y[j]
        if len(i) and cells.shape[1] > 1:  # each pair comes from the first cell that both share
            a, b = cells[i], cells[j]
            common = np.where((a[:, :, None] == b[:, None, :]).any(2), a, 2**31 - 1).min(1)
            keep = common == cell
            i, j, cos = i[keep], j[keep], cos[keep]
        a, b = ids[i], ids[j]
        swap = np.array([p.encode() > q.encode() for p, q in zip(a, b)], bool)
        return pa.table({"id_a": pa.array(np.where(swap, b, a), pa.string()), "id_b": pa.array(np.where(swap, a, b), pa.string()), "cosine": pa.array(cos, pa.float64())})

    blocks = spread(rows).mapInArrow(assign, _BLOCKS)
    pairs = cut_lineage(blocks.groupBy("key").applyInArrow(join, "id_a string, id_b string, cosine double"))
    at_edge = (F.col("cosine") >= least - EDGE) & (F.col("cosine") < least + EDGE)
    edge = pairs.filter(at_edge)
    sure = pairs.filter(F.col("cosine") >= least + EDGE)
    if edge.isEmpty():
        return sure
    # pairs that 16 bits can't decide: in float, from the vectors themselves
    unit = rows.dropDuplicates(["id"])
    a, b = unit.select(F.col("id").alias("id_a"), F.col("vector").alias("va")), unit.select(F.col("id").alias("id_b"), F.col("vector").alias("vb"))
    exact = edge.select("id_a", "id_b").join(a, "id_a").join(b, "id_b").select("id_a", "id_b", cosine("va", "vb").alias("cosine"))
    return sure.unionByName(exact.filter(F.col("cosine") >= least))


def cosine(a: str, b: str):
    """Cosine of two vector columns, in double."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def hash_id(s: str) -> int:
    import xxhash

    return xxhash.xxh32_intdigest(s)


_TILES = "key bigint, query boolean, id string, vector array<float>"


def nearest(rows: DataFrame, queries: DataFrame, k: int = 10, rows_a_tile: int = 30_000, queries_a_tile: int = 4_096) -> DataFrame:
    """``id, neighbour, cosine, place``: the k most similar other vectors of each query, against all rows.

    The larger side is dealt into tiles once per group of queries, each query once per tile; no
    side is broadcast, and no task holds more than a tile and a group of queries.
    """
    ok = F.col("id").isNotNull() & (F.size("vector") == DIM)
    rows, queries = rows.select("id", "vector").filter(ok), queries.select("id", "vector").filter(ok)
    n, m = rows.count(), queries.count()
    tiles, groups = max(1, -(-n // rows_a_tile)), max(1, -(-m // queries_a_tile))
    h = F.xxhash64("id")
    all_tiles, all_groups = F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))), F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    r = rows.withColumn("t", F.pmod(h, F.lit(tiles))).withColumn("g", all_groups).withColumn("query", F.lit(False))
    q = queries.withColumn("g", F.pmod(h, F.lit(groups))).withColumn("t", all_tiles).withColumn("query", F.lit(True))
    cols = [(F.col("t") * groups + F.col("g")).cast("bigint").alias("key"), "query", "id", "vector"]
    both = r.select(*cols).unionByName(q.select(*cols))

    def tile(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        u, at = matrix(group["vector"].combine_chunks() if isinstance(group["vector"], pa.ChunkedArray) else group["vector"])
        ids = np.array(group["id"].to_pylist(), object)[at]
        is_query = group["query"].to_numpy(zero_copy_only=False)[at].astype(bool)
        out: list[tuple[str, str, float]] = []
        parts = []
        for flag in (True, False):
            x = np.flatnonzero(is_query == flag)
            _, first = np.unique(ids[x].astype(str), return_index=True)
            parts.append(x[first])
        qx, rx = parts
        if len(qx) and len(rx):
            q8, qs, qe = coarse(*quantise(u[qx]))
            r8, rs, re_ = coarse(*quantise(u[rx]))
            for x in range(0, len(qx), 256):
                s = (q8[x : x + 256] @ r8.T) * rs.astype(np.float32)[None, :] * qs[x : x + 256, None].astype(np.float32)
                err = qe[x : x + 256, None] + re_[None, :] * (1 + qe[x : x + 256, None]) + 1e-5
                low = s - err
                kth = np.partition(low, max(0, low.shape[1] - k - 1), axis=1)[:, max(0, low.shape[1] - k - 1)]
                for i in range(len(s)):
                    cand = np.flatnonzero(s[i] + err[i] >= kth[i])
                    name = ids[qx[x + i]]
                    cos = u[rx[cand]] @ u[qx[x + i]]
                    best = heapq.nsmallest(k, ((-c, ids[rx[j]]) for c, j in zip(cos.tolist(), cand.tolist()) if ids[rx[j]] != name))
                    out += [(name, other, -c) for c, other in best]
        cols = list(zip(*out)) or [[], [], []]
        return pa.table({"id": pa.array(cols[0], pa.string()), "neighbour": pa.array(cols[1], pa.string()), "cosine": pa.array(cols[2], pa.float64())})

    from pyspark.sql import Window

    found = both.groupBy("key").applyInArrow(tile, "id string, neighbour string, cosine double")
    w = Window.partitionBy("id").orderBy(F.round("cosine", 9).desc(), "neighbour")
    return found.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)
