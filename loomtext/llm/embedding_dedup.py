"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors are rotated by a fixed random orthogonal matrix and split into low-dimensional blocks.  If the squared
distance of two vectors is at most T = 2 - 2 * threshold, it is at most T / blocks in one block at least.  Each block
is range-joined: rows stand in the order of its first coordinate, and a run of them meets the rows within the radius.
A pair counts only in its first block within the budget and is then verified by its exact cosine, so the union of the
candidates is verified once and link counts add up.

Before that, a block may also be cut into a grid of cells wider than the radius: a vector goes to its own cell and to
every neighbour within the radius, and vectors meet in the own cell of the one with the smaller id.  Where vectors
spread over few radii, that makes more copies and comparisons than it saves, so a grid is only used if a bounded sample
of the largest label says that it pays; else all blocks of a label are joined in one group.

Equal vectors are one class first (a partial aggregate), so copies cost one row; rows get their class's result by a
128-bit hash of the vector, so vectors are shuffled once, and rows of a class with many copies are salted.  Large
cells and labels are split into chunk pairs: exact link counts need every pair of a cell's different vectors to be
compared.  Chunk pairs go in waves that move about as many vectors as there are, and a wave's shuffle is dropped before
the next, so disk stays in proportion to the input (comparisons don't).  A group returns link counts and star edges,
never its pairs.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components, and vectors with a null
label link with nothing (component: their own id); different lengths never link; rows with a null id are returned
without component and not kept; repeated rows count as separate vectors; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import Forest, block_sizes, grouped, large_blocks, split_blocks, stream_groups
from .common import connected_components, discard, integral, lean, sized, stored

#: A group of vectors that meet; block is -1 where all blocks do.
KEYS = ["block", "label", "dims", "cell"]

_ROTATIONS: dict[int, np.ndarray] = {}


def rotation(dims: int) -> np.ndarray:
    if dims not in _ROTATIONS:
        q, r = np.linalg.qr(np.random.default_rng(dims).normal(size=(dims, dims)))
        _ROTATIONS[dims] = q * np.sign(np.diag(r))
    return _ROTATIONS[dims]


def _bounds(dims: int, blocks: int) -> list[tuple[int, int]]:
    edge = np.linspace(0, dims, min(blocks, dims) + 1).round().astype(int)
    return list(zip(edge[:-1].tolist(), edge[1:].tolist()))


def _units(vectors: list) -> np.ndarray:
    x = np.concatenate(vectors).astype("<f8").reshape(len(vectors), -1)
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow in the norm
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _radius(budget: float, cuts: int) -> float:
    return math.sqrt(budget / cuts) * (1 + 1e-6) + 1e-9


def _cells(z: np.ndarray, radius: float, width: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, whether it is the row's own) of every cell that the radius around a row touches."""
    w = width * radius
    own = np.floor(z / w).astype(np.int64)
    low, high = np.floor((z - radius) / w).astype(np.int64), np.floor((z + radius) / w).astype(np.int64)
    at = np.arange(len(z))
    cells = np.zeros((len(z), 0), np.int64)
    for d in range(z.shape[1]):  # one more coordinate: every cell that the radius touches
        n = high[at, d] - low[at, d] + 1
        first = np.repeat(np.cumsum(n) - n, n)
        step = low[np.repeat(at, n), d] + np.arange(n.sum()) - first
        cells = np.concatenate((np.repeat(cells, n, 0), step[:, None]), 1)
        at = np.repeat(at, n)
    code = np.zeros(len(at), np.int64)
    for d in range(z.shape[1]):
        code = code * 4096 + cells[:, d] + 2048
    return at, code, (cells == own[at]).all(1)


def _spread(blocks: int, budget: float, grid_dims: int, width: float):
    """A vector to its cells in every block: (block, label, dims, cell, id, copies, home, embedding)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dims, g in pdf.groupby("dims"):
                vectors = g["embedding"].to_numpy()
                y = _units(vectors.tolist()) @ rotation(int(dims))
                cuts = _bounds(int(dims), blocks)
                for b, (lo, hi) in enumerate(cuts):
                    at, cell, home = _cells(y[:, lo : min(hi, lo + grid_dims)], _radius(budget, len(cuts)), width)
                    yield pd.DataFrame({
                        "block": b, "label": g["label"].to_numpy()[at], "dims": dims, "cell": cell, "id": g["id"].to_numpy()[at],
                        "copies": g["copies"].to_numpy()[at], "home": home, "embedding": vectors[at],
                    })

    return lean(run)


def paying_grid(vectors: list, blocks: int, budget: float, most: int, width: float, pays: float) -> int:
    """How many coordinates of a block to cut, up to ``most``; 0 unless cells leave at most ``pays`` of the pairs."""
    if len(vectors) < 2 or most < 1:
        return 0
    y = _units(vectors) @ rotation(len(vectors[0]))
    cuts = _bounds(y.shape[1], blocks)
    best, share = 0, pays
    for dims in range(1, most + 1):
        pairs = 0
        for lo, hi in cuts:
            n = np.unique(_cells(y[:, lo : min(hi, lo + dims)], _radius(budget, len(cuts)), width)[1], return_counts=True)[1]
            pairs += int((n * (n - 1)).sum())
        if (left := pairs / (len(cuts) * len(y) * (len(y) - 1))) <= share:
            best, share = dims, left
    return best


def _join(blocks: int, threshold: float, budget: float, slab: int = 50_000, tile: int = 256, wide: int = 4096):
    """Links in each group: (id, links, peer); links are copies of linked classes, peer is a star edge or null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in stream_groups(batches, KEYS + ["_i", "_j"]):
            if len(g) < 2:
                continue
            grid, dims = int(g["block"].iat[0]), int(g["dims"].iat[0])
            i, j = int(g["_i"].iat[0]), int(g["_j"].iat[0])
            u = _units(g["embedding"].tolist())
            y = u @ rotation(dims)
            cuts = _bounds(dims, blocks)
            share = budget / len(cuts)
            ids, copies, home, c = (g[x].to_numpy() for x in ("id", "copies", "home", "_c"))
            links = np.zeros(len(g), np.int64)
            forest = Forest(len(g))
            for block in range(len(cuts)) if grid < 0 else [grid]:
                lo, hi = cuts[block]
                order = np.argsort(y[:, lo], kind="stable")
                left, right = order[c[order] == i], order[c[order] == j]
                # squared distances in one product of single precision, with room for its rounding
                size = np.einsum("ij,ij->i", y[:, lo:hi], y[:, lo:hi])[:, None]
                one = np.ones((len(g), 1))
                a = np.concatenate((-2 * y[:, lo:hi], size, one), 1)[left].astype(np.float32)
                b = np.concatenate((y[:, lo:hi], one, size), 1)[right].astype(np.float32)
                limit = np.float32(share + 3e-7 * (hi - lo + 8))
                x0, z0, radius = y[left, lo], y[right, lo], _radius(budget, len(cuts))
                for s in range(0, len(left), tile):
                    start = int(np.searchsorted(z0, x0[s] - radius))
                    stop = int(np.searchsorted(z0, x0[min(s + tile, len(left)) - 1] + radius, side="right"))
                    for t in range(max(start, s) if i == j else start, stop, wide):
                        end = min(t + wide, stop)
                        at = np.flatnonzero(a[s : s + tile] @ b[t:end].T <= limit)
                        p, q = s + at // (end - t), t + at % (end - t)
                        if i == j:
                            keep = p < q
                            p, q = p[keep], q[keep]
                        p, q = left[p], right[q]
                        keep = home[np.where(ids[p] < ids[q], p, q)] & (ids[p] != ids[q])
                        p, q = p[keep], q[keep]
                        for v in range(0, len(p), slab):
                            x, z = p[v : v + slab], q[v : v + slab]
                            ok = np.einsum("ij,ij->i", u[x], u[z]) >= threshold
                            x, z = x[ok], z[ok]
                            gap = (y[x] - y[z]) ** 2
                            within = np.stack([np.add.reduce(gap[:, l:h], axis=1) <= share for l, h in cuts], 1)
                            ok = within[:, block] & ~within[:, :block].any(1)
                            x, z = x[ok], z[ok]
                            np.add.at(links, x, copies[z])
                            np.add.at(links, z, copies[x])
                            for k, m in zip(x.tolist(), z.tolist()):
                                forest.join(k, m)
            hit = np.flatnonzero(links)
            if len(hit):
                yield pd.DataFrame({"id": ids[hit], "links": links[hit], "peer": ids[[forest.find(k) for k in hit.tolist()]]})

    return lean(run)


def link_embeddings(
    table: DataFrame, threshold: float = 0.98, blocks: int = 4, width: float = 4.0, cell_rows: int = 4096, chunk: int = 16_384,
    pays: float = 0.5, sample: int = 2000, wave_rows: int = 250_000, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of table.  ``blocks``: subspaces; ``width``: of a grid cell in
    radii; ``cell_rows``: about how many vectors of the largest label a cell may hold; ``pays``: what share of the pairs
    a grid may leave, by a sample of so many vectors; ``chunk``: from how many rows a cell is split and a class salted;
    ``wave_rows``: how many vectors are moved at a time, if there are no more.  None of these changes results."""
    spark = table.sparkSession
    integral(table, id_col)
    budget = (2 - 2 * threshold) * (1 + 1e-9) + 1e-12
    single = dict(table.dtypes)[vec_col] == "array<float>"
    rows = table.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"),
        F.col(vec_col).cast("array<float>" if single else "array<double>").alias("embedding"),
    )
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = (
        F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(F.size("embedding") > 0, F.lit(False))
        & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists("embedding", lambda x: x != 0), F.lit(False))
    )
    rows = rows.withColumn("usable", usable)
    same = [F.xxhash64(F.lit(k), "embedding").alias(f"e{k}") for k in (1, 2)]
    vectors = stored(
        spark,
        rows.where("usable").groupBy("label", "embedding").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
        .select("*", F.size("embedding").alias("dims"), *same),
        "vectors",
    )
    labels = vectors.groupBy("label", "dims").agg(F.count("*").alias("n"))
    total, largest = labels.agg(F.coalesce(F.sum("n"), F.lit(0)), F.max(F.struct("n", "label", "dims"))).first()
    grid_dims = 0
    if largest is not None and largest.n > cell_rows:
        most = min(5, max(1, math.ceil(math.log(largest.n / cell_rows, 1.8))))  # about 1.8 filled cells a coordinate
        some = vectors.where((F.col("label") == largest.label) & (F.col("dims") == largest.dims))
        some = some.where(F.pmod(F.xxhash64("id"), F.lit(max(1, largest.n // sample))) == 0).select("embedding").limit(sample)
        grid_dims = paying_grid([np.array(r[0]) for r in some.collect()], blocks, budget, most, width, pays)
    if grid_dims:
        kind = vectors.schema["embedding"].dataType.simpleString()
        spread = vectors.mapInPandas(
            _spread(blocks, budget, grid_dims, width),
            f"block int, label string, dims int, cell long, id long, copies long, home boolean, embedding {kind}",
        )
    else:
        spread = vectors.select(F.lit(-1).alias("block"), "label", "dims", F.lit(0).cast("long").alias("cell"), "id", "copies", F.lit(True).alias("home"), "embedding")
    sizes = stored(spark, block_sizes(spread, KEYS), "cell-sizes")
    moved = sizes.agg(F.sum(F.col("_n") * F.ceil(F.col("_n") / chunk))).first()[0] or 0
    large = sized(spark, large_blocks(sizes, KEYS, chunk), "large-cells")
    discard(sizes)
    waves = max(1, math.ceil(moved / max(total, wave_rows)))
    found = []
    for wave in range(waves):
        groups = grouped(split_blocks(spread, KEYS, "id", large, (wave, waves)), [*KEYS, "_i", "_j"])
        found.append(stored(spark, groups.mapInPandas(_join(blocks, threshold, budget), "id long, links long, peer long"), "links"))
    classes = stored(spark, vectors.drop("embedding", "dims"), "classes")
    discard(vectors)
    found = functools.reduce(DataFrame.unionAll, found)
    degree = found.groupBy("id").agg(F.sum("links").alias("links"))
    edges = found.where("id != peer").select(F.col("id").alias("u"), F.col("peer").alias("v"))
    components = connected_components(spark, edges, "vectors-cc")
    salts = F.ceil(F.col("copies") / chunk).cast("int")
    result = (
        classes.join(degree, "id", "left").join(components, "id", "left")
        .select("label", "e1", "e2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"),
                F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    )
    hot = sized(spark, classes.where(F.col("copies") > chunk).select("label", "e1", "e2", salts.alias("salts")), "hot-vectors")
    members = rows.where("usable").select("id", "label", *same).join(hot, ["label", "e1", "e2"], "left")
    members = members.withColumn("salt", F.pmod(F.xxhash64("id"), F.coalesce("salts", F.lit(1)).cast("long")).cast("int"))
    out = members.join(result, ["label", "e1", "e2", "salt"]).select("id", "n_links", "component_id")
    rest = rows.where(~F.col("usable")).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return out.unionAll(rest).select(
        F.col("id").alias("vec_id"), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept")
    )


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector: links are cosines of at least 0.98 within a label."""
    return link_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
