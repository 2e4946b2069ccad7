"""Whitening of embeddings by a covariance in tiles.

Vectors are cut into row blocks, each row block into column blocks.  The column blocks are shuffled by their row block,
so that each pair of them, a tile of the covariance, is multiplied where they meet; products are summed per tile, first
in their task, then over tasks.  The driver holds dimension squared doubles for the eigenvectors, whatever the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from ._shared import materialize, small_batches

SCALE = 1024
SHIFT = 100_000
#: Scaled entries are below this, so that they are exact and 1,024 of them add up in 64 bits.
LIMIT = float(1 << 52)
TILE = 32  # dimensions of a column block
BLOCK_ROWS = 1024  # vectors of a row block
SUMMED_AT_ONCE = 64  # tasks of the first sum of a tile
NO_VARIANCE = 1e-11  # share of the first eigenvalue under which a component has none

Centre = Callable[[np.ndarray], np.ndarray]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _cut(centre: Centre, tile: int, block_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, block_rows):
                z = centre(_matrix(batch.column(0).slice(at, block_rows)))
                starts = range(0, z.shape[1], tile)
                data = [np.ascontiguousarray(z[:, c : c + tile]).tobytes() for c in starts]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block] * len(data), pa.int64()), pa.array([c // tile for c in starts], pa.int32()), pa.array([len(z)] * len(data), pa.int32()), pa.array(data, pa.binary())],
                    ["row_block", "col", "n_rows", "data"],
                )
                block += 1

    return run


def _tiles(sums: dict[tuple[int, int], np.ndarray], salt: int) -> pa.RecordBatch:
    keys = sorted(sums)
    return pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([salt] * len(keys), pa.int32()), pa.array([sums[k].tobytes() for k in keys], pa.binary())],
        ["i", "j", "salt", "data"],
    )


def _multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Products of all column block pairs of each row block, summed per tile over the task."""
    sums: dict[tuple[int, int], np.ndarray] = {}
    block, held = None, []
    for batch in batches:
        for row_block, col, n, data in zip(*(batch[c] for c in ("row_block", "col", "n_rows", "data")), strict=True):
            if row_block.as_py() != block:
                block, held = row_block.as_py(), []
            x = np.frombuffer(data.as_buffer()).reshape(n.as_py(), -1)
            held.append((col.as_py(), x))
            for i, y in held:
                key = (i, col.as_py())
                sums[key] = sums[key] + y.T @ x if key in sums else y.T @ x
    if sums:
        yield _tiles(sums, TaskContext.get().partitionId() % SUMMED_AT_ONCE)


def _add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = sum(np.frombuffer(x.as_buffer()) for batch in batches for x in batch["data"])
    yield _tiles({(key[0].as_py(), key[1].as_py()): total}, key[2].as_py() if len(key) > 2 else 0)


def tiled_products(rows: DataFrame, centre: Centre, dim: int, tile: int = TILE, block_rows: int = BLOCK_ROWS) -> np.ndarray:
    """Sum over the rows of z z^T, where z is ``centre`` of the row's only column (an array of ``dim`` numbers).

    ``rows`` is read in a fixed order: a scan or a materialised table.
    """
    blocks = rows.mapInArrow(_cut(centre, tile, block_rows), "row_block long, col int, n_rows int, data binary")
    met = blocks.repartition("row_block").sortWithinPartitions("row_block", "col")
    kind = "i int, j int, salt int, data binary"
    parts = met.mapInArrow(_multiply, kind).groupBy("i", "j", "salt").applyInArrow(_add, kind)
    out = np.zeros((dim, dim))
    for i, j, _, data in parts.groupBy("i", "j").applyInArrow(_add, kind).collect():  # dim * dim doubles
        a, b = slice(i * tile, min(dim, (i + 1) * tile)), slice(j * tile, min(dim, (j + 1) * tile))
        part = np.frombuffer(bytes(data)).reshape(a.stop - a.start, -1)
        out[a, b] = part
        out[b, a] = part.T
    return out


def _sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's number of vectors and their exact sum, if it has any."""
    n, total = 0, 0
    for batch in batches:
        x = _matrix(batch.column(0)) if batch.num_rows else ()
        n += len(x)
        for at in range(0, len(x), 1024):
            total = total + x[at : at + 1024].sum(axis=0).astype(object)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tolist()], pa.list_(pa.decimal128(38, 0)))], ["n", "sums"])


def _project(n: int, base: np.ndarray, rest: np.ndarray, directions: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            away = _matrix(batch["x"]) - base
            z = away - rest / n
            deviation = []
            small = (z * z).sum(axis=1) * n * n < 1 << 61
            exact = away[small] * n - rest
            found = iter((exact * exact).sum(axis=1).tolist())
            for i, ok in enumerate(small.tolist()):  # others by Python's whole numbers
                d = next(found) if ok else sum((int(a) * n - int(r)) ** 2 for a, r in zip(away[i], rest, strict=True))
                deviation.append(d if d < 1 << 63 else None)
            white = z @ directions
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(white) + 1) * white.shape[1], pa.int32()), pa.array(white.ravel()))
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(deviation, pa.int64()), lists], ["id", "deviation", "white"])

    return run


def embedding_whitening(vectors: DataFrame, n_components: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector and component: id_col, component, n, deviation, whitened, explained, identity_error.

    Each entry c counts as x = floor(1024 * c) + 100000.  Components are unit eigenvectors of the covariance of x over
    all vectors (divisor n, centred before multiplying), numbered from 1 by falling eigenvalue e, their largest entry
    positive; ``whitened`` is the centred vector's projection over sqrt(e), ``explained`` is e over the trace, ``deviation``
    is the exact sum over dimensions of (n * x - S) ** 2 with the sums S of all vectors, ``identity_error`` (one value) the
    largest absolute entry of whitened's covariance minus the identity.

    Vectors that are null or empty, hold a null or a number that is not finite or not below 2 ** 42 (x would not be exact)
    are left out, and so are those of another length than most vectors have (ties: the longer).  Rows that repeat, and
    rows with a null id, each count.  A deviation beyond 64 bits is null.  A component with no variance has whitened null and
    is not in identity_error, which is null where no component has any; explained is null where the trace is 0.  There
    are no more components than dimensions.  No vectors give no rows.  Other columns are ignored.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    scaled = F.transform(F.col(vector_col), lambda c: c.cast("double") * SCALE)
    sound = (F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & (F.abs(c) < LIMIT))
    rows = vectors.select(F.col(id_col).alias("id"), scaled.alias("v")).filter(sound)
    rows = materialize(rows.select("id", F.transform("v", lambda c: F.floor(c) + SHIFT).alias("x")), "vectors")
    size = rows.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    id_type = vectors.schema[id_col].dataType
    if size is None:
        kind = [(id_col, id_type.simpleString()), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
        return spark.createDataFrame([], ", ".join(f"`{a}` {b}" for a, b in kind))
    dim = size["size"]
    rows = rows.filter(F.size("x") == dim)
    sums = rows.select("x").mapInArrow(_sum_up, "n long, sums array<decimal(38,0)>")
    totals = sums.select("n", F.posexplode("sums")).groupBy("pos").agg(F.sum("n"), F.sum("col").cast("decimal(38,0)")).orderBy("pos").collect()  # dim rows
    n, base, rest = totals[0][1], *(np.array(x, np.int64) for x in zip(*(divmod(int(s), totals[0][1]) for _, _, s in totals), strict=True))
    covariance = tiled_products(rows.select("x"), lambda x: (x - base) - rest / n, dim) / n
    e, u = np.linalg.eigh(covariance)
    e, u = e[::-1][:n_components], u[:, ::-1][:, :n_components]
    u = u * np.sign(u[np.abs(u).argmax(axis=0), np.arange(u.shape[1])])
    real = e > max(0.0, NO_VARIANCE * e[0])
    trace = float(np.trace(covariance))
    directions = u * np.where(real, 1 / np.sqrt(np.where(real, e, 1.0)), 0.0)
    kind = StructType([StructField("id", id_type), StructField("deviation", LongType()), StructField("white", ArrayType(DoubleType()))])
    out = materialize(rows.mapInArrow(_project(n, base, rest, directions), kind), "whitened")
    k = len(e)
    means = np.array(out.agg(*[F.avg(F.col("white")[i]) for i in range(k)]).first(), float)
    apart = np.abs(tiled_products(out.select("white"), lambda w: w - means, k) / n - np.eye(k))[np.ix_(real, real)]
    error = float(apart.max()) if real.any() else None
    told = F.array(*[F.struct(F.lit(i + 1).alias("component"), F.lit(bool(real[i])).alias("real"), F.lit(float(e[i] / trace) if trace > 0 else None).cast("double").alias("explained")) for i in range(k)])
    long = out.select("id", "deviation", F.inline(F.arrays_zip("white", told.alias("told")))).select("id", "deviation", "white", "told.*")
    return long.select(
        F.col("id").alias(id_col),
        "component",
        F.lit(n).cast("long").alias("n"),
        "deviation",
        F.when(F.col("real"), F.col("white")).alias("whitened"),
        "explained",
        F.lit(error).cast("double").alias("identity_error"),
    )
