"""Nearest vectors, feature normalisation and the greedy coreset."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomframe.operators.running import Ordered
from loomframe.session import durable, release, spread

#: Base vectors of a block, in bytes of float32.
BLOCK_BYTES = 256 << 20


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def nearest(queries: DataFrame, base: DataFrame, blocks: int | None = None) -> DataFrame:
    """(qid, id, d2) of each query's nearest base vector; the smallest id on ties.

    Queries (qid, x) and base (id, x) meet in blocks.  The base, a coreset, is
    cut into so many blocks that each stays below BLOCK_BYTES; a block is
    sent to the tasks once for each block of queries.
    """
    size = base.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("d")).first()
    n_bytes = (size["n"] or 0) * (size["d"] or 0) * 4
    blocks = blocks or max(1, -(-n_bytes // BLOCK_BYTES))
    query_blocks = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = queries.select("qid", "x", F.pmod(F.xxhash64("qid"), F.lit(query_blocks)).cast("int").alias("qb")).withColumn("bb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = base.select("id", "x", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("bb")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))

    def run(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(b):
            return pd.DataFrame({"qid": [], "id": [], "d2": []}).astype({"qid": "int64", "id": "int64", "d2": "float64"})
        b = b.sort_values("id")
        ids, m = b["id"].to_numpy(np.int64), np.stack(b["x"].to_list()).astype(np.float64)
        out = []
        for at in range(0, len(q), 2000):
            part = q.iloc[at : at + 2000]
            x = np.stack(part["x"].to_list()).astype(np.float64)
            d = (x * x).sum(1)[:, None] + (m * m).sum(1)[None] - 2 * x @ m.T
            # the expansion loses digits near zero, so near ties are measured again
            for row, v, line in zip(part["qid"], x, d, strict=True):
                close = np.flatnonzero(line <= line.min() + 1e-9 * (1 + abs(line.min())))
                e = ((m[close] - v) ** 2).sum(1)
                k = close[int(e.argmin())]
                out.append((row, ids[k], float(e.min())))
        return pd.DataFrame(out, columns=["qid", "id", "d2"])

    found = spread(left, "qb", "bb").groupBy("qb", "bb").cogroup(spread(right, "qb", "bb").groupBy("qb", "bb")).applyInPandas(run, "qid long, id long, d2 double")
    best = found.groupBy("qid").agg(F.min(F.struct("d2", "id")).alias("b"))
    return best.select("qid", F.col("b.id").alias("id"), F.col("b.d2").alias("d2"))


def normalise_pixels(pixels: Column, mean: list[float], std: list[float]) -> Column:
    """uint8 values as three normalised channels."""

    def channel(m: float, s: float) -> Column:
        return F.transform(pixels, lambda x: (x / F.lit(255.0) - F.lit(m)) / F.lit(s))

    return F.array(*map(channel, mean, std))


def index_to_source(index: Column, cells: int, width: int) -> list[Column]:
    """Frame number in the bank, row and column of a feature's index."""
    cell = F.pmod(index, F.lit(cells))
    return [F.floor(index / cells).cast("long").alias("bank_frame"), F.floor(cell / width).cast("int").alias("row"), F.pmod(cell, F.lit(width)).cast("int").alias("col")]


def embed(frames: DataFrame, function, schema: str) -> DataFrame:
    """Features of frames by a given function of one pandas frame; the model itself is pluggable."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield function(pdf)

    return frames.mapInPandas(run, schema)


def write_features(features: DataFrame, path: str, fold: str = "fold") -> None:
    """Write a feature bag with one folder for each fold."""
    features.write.partitionBy(fold).parquet(path)


def shape_trace(layers: dict[str, object], x: np.ndarray) -> dict[str, tuple[int, ...]]:
    """Shapes of what each named function makes of the one before's result, in order."""
    out = {}
    for name, layer in layers.items():
        x = layer(x)
        out[name] = tuple(x.shape)
    return out


def _projection(rng: np.random.Generator, width: int, dim: int) -> np.ndarray | None:
    """Random projection of wide features, drawn before the starts."""
    return rng.standard_normal((width, dim)) / np.sqrt(dim) if width > dim else None


def _far(z: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Distances of rows to a centre; each depends on its own row alone, so any split of the rows gives the same."""
    d = z - centre
    return np.sqrt((d * d).sum(1))


def greedy_coreset(x: np.ndarray, size: int, starts: int = 10, dim: int = 128, seed: int = 0) -> np.ndarray:
    """Places of a greedy k-centre selection, in memory.

    Distances to ``starts`` random points, averaged, open the search; then the
    farthest point joins, the smallest place on ties.
    """
    rng = np.random.default_rng(seed)
    p = _projection(rng, x.shape[1], dim)
    z = x.astype(np.float64) if p is None else x.astype(np.float64) @ p
    first = rng.choice(len(z), min(starts, len(z)), replace=False)
    dist = np.mean([_far(z, z[i]) for i in first], axis=0)
    out = []
    for _ in range(min(size, len(z))):
        i = int(dist.argmax())
        out.append(i)
        dist = np.minimum(dist, _far(z, z[i]))
    return np.array(out)


#: Farthest points that a round looks at on the driver.
ROUND = 512


def coreset(features: DataFrame, share: float = 0.01, seed: int = 0, starts: int = 10, dim: int = 128, round_size: int = ROUND) -> DataFrame:
    """(id, x) of the greedy k-centre selection of a feature bag (id, x) with numeric distinct ids, in order of id.

    A round takes the ``round_size`` points farthest from the centres so far and
    selects among them as the greedy search would.  Distances only fall, so as long
    as the farthest of them is farther than any point outside was, it is the
    farthest of all; then the new centres go to all points and the next round
    begins.  So the selection is the sequential one, at any size, in many fewer
    rounds than centres.
    """
    spark = features.sparkSession
    n = features.count()
    size = min(n, max(1, int(n * share)))
    if not n:
        return features.select("id", "x")
    rng = np.random.default_rng(seed)
    p = _projection(rng, features.select(F.size("x")).first()[0], dim)
    places = rng.choice(n, min(starts, n), replace=False).tolist()
    # the order runs from the largest id down
    numbered = Ordered(features.select("id", "x"), "id").sums({}, "k").rows
    drawn = {n - 1 - r["k"]: np.array(r["x"], np.float64) for r in numbered.where(F.col("k").isin([n - 1 - i for i in places])).collect()}  # the starts
    project = lambda x: x if p is None else x @ p
    opening = [project(drawn[i][None])[0] for i in places]

    def open_(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                z = project(np.stack(pdf["x"].to_list()).astype(np.float64))
                yield pd.DataFrame({"id": pdf["id"], "z": list(z), "dist": np.mean([_far(z, c) for c in opening], axis=0)})

    kind = dict(features.dtypes)["id"]
    state = durable(features.select("id", "x").mapInPandas(open_, f"id {kind}, z array<double>, dist double"), "coreset")
    chosen: list[int] = []
    while len(chosen) < size:
        top = state.select("id", "dist").orderBy(F.desc("dist"), "id").limit(round_size + 1).collect()
        outside = top[round_size]["dist"] if len(top) > round_size else -1.0
        top = top[:round_size]
        held = {r["id"]: np.array(r["z"]) for r in state.where(F.col("id").isin([r["id"] for r in top])).select("id", "z").collect()}  # a round's points
        ids = [r["id"] for r in top]
        order = np.argsort(ids)  # smallest id first on ties
        ids, z, dist = [ids[i] for i in order], np.stack([held[ids[i]] for i in order]), np.array([top[i]["dist"] for i in order])
        new: list[int] = []
        while len(chosen) + len(new) < size and len(new) < len(ids):
            i = int(dist.argmax())
            if new and not dist[i] > outside:
                break
            new.append(i)
            dist = np.minimum(dist, _far(z, z[i]))
        centres = z[new]
        chosen += [ids[i] for i in new]

        def closer(batches: Iterator[pd.DataFrame], centres: np.ndarray = centres) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    z, dist = np.stack(pdf["z"].to_list()), pdf["dist"].to_numpy(float)
                    for c in centres:
                        dist = np.minimum(dist, _far(z, c))
                    yield pd.DataFrame({"id": pdf["id"], "z": pdf["z"], "dist": dist})

        if len(chosen) < size:
            after = durable(state.mapInPandas(closer, f"id {kind}, z array<double>, dist double"), "coreset")
            release(state)
            state = after
    release(state)
    return features.select("id", "x").join(spark.createDataFrame([(i,) for i in chosen], f"id {kind}"), "id")


def relative_error(pairs: DataFrame) -> DataFrame:
    """max |a - b| / max |b| of (a, b)."""
    return pairs.agg((F.max(F.abs(F.col("a") - F.col("b"))) / F.max(F.abs("b"))).alias("rel"))
