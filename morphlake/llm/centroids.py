"""Centroid clustering of integer vectors, screened in float32, decided exactly.

Components become integers, ``floor(256 * x)``.  A task multiplies its vectors
with all centroids in float32.  Every score (squared norm of the centroid less
twice the product) comes with an interval that holds the exact value: the
classical bound on the rounding of a product of ``n`` terms, ``n u / (1 - n u)``
times the product of the norms, which holds for any order of summation.  A
vector whose best interval lies below all others is settled; where intervals
overlap the rivals' distances are computed again in exact integers, and the
smallest number wins ties.  Distances returned are exact integers throughout.

Centroids move by exact sums: tasks send, for each centroid, how many vectors
it has and the sums of their components, which Spark adds up; means are floored
by integer division on the driver, which sees ``k`` rows a round and no vector.

Vectors are narrow if no component exceeds ``NARROW`` in size, so that their
distances fit 64 bits.  Wider ones are computed with unbounded integers; their
sums travel in limbs of 32 bits.  A column of 64 bits holds no distance or
inertia beyond 2**63 - 1: there it says 2**63 - 1.

Defined results: vectors that are null, of another length, or with a null or
non-finite component are not kept and not returned; an empty table, or one
without kept vectors, gives an empty result; with fewer than ``k`` kept vectors
there are as many centroids; repeated rows are vectors of their own; a null id
hashes as the empty text; equal hashes go by their components; further columns
of the table are not returned.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, materialize

DIMENSIONS, CENTROIDS, ROUNDS, SCALE, SEED = 64, 40, 5, 256, 2
#: Largest component of vectors whose squared distances fit 64 bits at 64 dimensions.
NARROW = 1 << 27
LIMB = 32
LARGEST = 2**63 - 1
#: Vectors that a task multiplies at once.
BLOCK = 8192
#: Unit roundoff of float32; rounding in float64 is covered by the slack.
UNIT, SLACK = 2.0**-24, 2.0**-40


def quantized(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dimensions: int = DIMENSIONS) -> DataFrame:
    """``vec_id, q, wide``: the integers of each kept vector, or its components
    as they are where one of them is wide."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    kept = (F.size("x") == dimensions) & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    narrow = F.forall("x", lambda c: F.abs(c) <= NARROW / SCALE)
    return (
        vectors.select(F.col(id_col).alias("vec_id"), x.alias("x"))
        .where(F.coalesce(kept, F.lit(False)))
        .select("vec_id", F.when(narrow, F.transform("x", lambda c: F.floor(c * SCALE).cast("int"))).alias("q"), F.when(~narrow, F.col("x")).alias("wide"))
    )


def _integer(x: float) -> int:
    n, d = x.as_integer_ratio()
    return SCALE * n // d


def _stacked(q: pa.Array, wide: pa.Array, dimensions: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Places and integer matrices: narrow vectors as int64, wide ones as objects."""
    out = []
    for column, make in ((q, None), (wide, _integer)):
        at = np.flatnonzero(np.asarray(column.is_valid()))
        if not len(at):
            continue
        flat = column.filter(column.is_valid()).flatten().to_numpy(zero_copy_only=False)
        if make is None:
            out.append((at, flat.astype(np.int64).reshape(-1, dimensions)))
        else:
            rows = np.empty(len(flat), object)
            rows[:] = [make(v) for v in flat.tolist()]
            out.append((at, rows.reshape(-1, dimensions)))
    return out


@dataclass
class Centroids:
    """Integer centroids and what screening needs of them."""

    rows: list[list[int]]

    def __post_init__(self) -> None:
        exact = np.empty((len(self.rows), len(self.rows[0])), object)
        exact[:] = self.rows
        self.exact = exact
        self.narrow = all(abs(v) <= NARROW for row in self.rows for v in row)
        self.whole = exact.astype(np.int64) if self.narrow else exact
        square = (exact * exact).sum(1)
        with np.errstate(over="ignore"):
            self.single = exact.astype(np.float64).astype(np.float32)
        self.square = square.astype(np.float64)
        self.norm = np.sqrt(self.square) * (1 + SLACK)

    def _distance(self, vectors: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """Exact squared distances, of each vector to its centroid."""
        fits = self.narrow and vectors.dtype != object
        gap = (vectors if fits else vectors.astype(object)) - (self.whole if fits else self.exact)[numbers]
        return (gap * gap).sum(1)

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Centroid and exact distance of each vector, and how many were decided
        by exact integers."""
        n, k = len(vectors), len(self.rows)
        real = vectors.astype(np.float64)
        with np.errstate(over="ignore", invalid="ignore"):
            dot = (real.astype(np.float32) @ self.single.T).astype(np.float64)
            norm = np.sqrt((real * real).sum(1)) * (1 + SLACK)
            terms = vectors.shape[1] + 2  # two more for rounding the factors
            error = 2 * terms * UNIT / (1 - terms * UNIT) * (1 + SLACK) * norm[:, None] * self.norm
            score = self.square - 2 * dot
            error += SLACK * (self.square + 2 * np.abs(dot) + 1)
            low, high = score - error, score + error
            known = np.isfinite(low) & np.isfinite(high)
        low, high = np.where(known, low, -np.inf), np.where(known, high, np.inf)
        rivals = low <= high.min(1, keepdims=True)
        chosen = rivals.argmax(1)
        open_rows = np.flatnonzero(rivals.sum(1) > 1)
        if len(open_rows):
            at, number = np.nonzero(rivals[open_rows])
            gaps = self._distance(vectors[open_rows[at]], number)
            best: dict[int, tuple[Any, int]] = {}
            if gaps.dtype == object:
                for row, j, gap in zip(at.tolist(), number.tolist(), gaps.tolist()):
                    if row not in best or gap < best[row][0]:
                        best[row] = (gap, j)
                chosen[open_rows] = [best[r][1] for r in range(len(open_rows))]
            else:
                order = np.lexsort((number, gaps, at))
                first = np.concatenate(([True], at[order][1:] != at[order][:-1]))
                chosen[open_rows] = number[order][first]
        return chosen, self._distance(vectors, chosen), len(open_rows)


def limbs(sums: list[int]) -> list[list[int]]:
    """Integers as rows of limbs that add up to them, lowest first; the last
    carries the sign.  Integers that fit 64 bits are one row."""
    rows = []
    while any(not -(2**62) <= s < 2**62 for s in sums):
        rows.append([s & ((1 << LIMB) - 1) for s in sums])
        sums = [s >> LIMB for s in sums]
    return [*rows, sums]


def _moved(vectors: DataFrame, centroids: Centroids, dimensions: int) -> list[list[int]]:
    """The centroids after one round."""
    shipped, key = vectors.sparkSession.sparkContext.broadcast(centroids.rows), uuid.uuid4().hex

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Centroids = held(key, lambda: Centroids(shipped.value))
        k = len(now.rows)
        count, total = np.zeros(k, np.int64), np.zeros((k, dimensions), object)
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                part = batch.slice(a, BLOCK)
                for _, rows in _stacked(part.column(1), part.column(2), dimensions):
                    chosen, _, _ = now.nearest(rows)
                    count += np.bincount(chosen, minlength=k)
                    order = np.argsort(chosen, kind="stable")
                    present, first = np.unique(chosen[order], return_index=True)
                    total[present] += np.add.reduceat(rows[order], first, axis=0).astype(object)
        made = [(j, level, int(count[j]) if level == 0 else 0, row) for j in np.flatnonzero(count).tolist() for level, row in enumerate(limbs(total[j].tolist()))]
        columns = list(zip(*made)) or [[], [], [], []]
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], ["number", "level", "n", "sums"])

    partial = vectors.select("vec_id", "q", "wide").mapInArrow(sums, "number int, level int, n long, sums array<long>")
    exact = "decimal(38,0)"
    added = partial.groupBy("number", "level").agg(F.sum(F.col("n").cast(exact)).alias("n"), *(F.sum(F.col("sums")[i].cast(exact)).alias(f"s{i}") for i in range(dimensions)))
    counts, totals = {}, {}
    for r in added.collect():
        j = r["number"]
        counts[j] = counts.get(j, 0) + int(r["n"])
        row = totals.setdefault(j, [0] * dimensions)
        totals[j] = [t + (int(r[f"s{i}"]) << (LIMB * r["level"])) for i, t in enumerate(row)]
    return [[t // counts[j] for t in totals[j]] if j in counts else old for j, old in enumerate(centroids.rows)]


def _assigned(vectors: DataFrame, centroids: Centroids, dimensions: int) -> DataFrame:
    """``vec_id, cluster, distance, exact_distance`` (as text, for sums)."""
    shipped, key = vectors.sparkSession.sparkContext.broadcast(centroids.rows), uuid.uuid4().hex

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Centroids = held(key, lambda: Centroids(shipped.value))
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                part = batch.slice(a, BLOCK)
                cluster, distance = np.zeros(part.num_rows, np.int32), np.zeros(part.num_rows, np.int64)
                for at, rows in _stacked(part.column(1), part.column(2), dimensions):
                    chosen, gaps, _ = now.nearest(rows)
                    cluster[at] = chosen
                    distance[at] = gaps if gaps.dtype != object else [min(g, LARGEST) for g in gaps.tolist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(cluster), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return vectors.select("vec_id", "q", "wide").mapInArrow(assign, f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, cluster int, distance long")


def clusters(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, seed: int = SEED) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256``
    of every kept vector after ``rounds`` rounds."""
    spark = vectors.sparkSession
    kept = materialize(quantized(vectors, id_col, vector_col, dimensions), "vectors")
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    starts = [r["q"] if r["q"] is not None else [_integer(v) for v in r["wide"]] for r in kept.orderBy(rank, "q", "wide").limit(k).collect()]
    result = f"vec_id {kept.schema['vec_id'].dataType.simpleString()}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not starts:
        return spark.createDataFrame([], result)
    centroids = Centroids([list(map(int, row)) for row in starts])
    for _ in range(rounds):
        centroids = Centroids(_moved(kept, centroids, dimensions))
    assigned = materialize(_assigned(kept, centroids, dimensions), "assigned")
    inertia = {r["cluster"]: int(r["total"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    whole = min(sum(inertia.values()), LARGEST)
    facts = [(j, min(total, LARGEST), whole, hashlib.sha256(",".join(map(str, centroids.rows[j])).encode()).hexdigest()) for j, total in inertia.items()]
    of_cluster = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(of_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
