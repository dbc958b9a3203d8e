"""Whitening of embedding vectors by principal components.

Vectors are made integers (x = floor(scale * entry)), the fit list is every distinct x once,
and its mean is S / n. The centred rows are indexed into the blocks of a distributed
BlockMatrix: block b has up to `rows_per_block` rows and all columns. A second matrix has the
same blocks with every row that repeats an earlier one set to zero, so that its transpose
times itself is the scatter of the fit list. That product splits its middle dimension over
many tasks, each of which adds up its own blocks, and only sums of one block meet. The small
covariance is decomposed locally (eigh) and the rows are projected by multiplying their
BlockMatrix with the whitening matrix, whose columns are eigenvectors over roots of eigenvalues.

Distinct vectors come from an aggregation with partial sums; blocks are dealt by number. A
vector that a third of all rows share therefore weighs no more than others. The driver gets
the row count of each input partition, the sums, and one covariance matrix; MLlib also keeps
the coordinates (not the contents) of all blocks there, one per 2^16 entries (`rows_per_block`).

Parameters: `components` (4), `scale` (256), `rows_per_block` (2^16 entries by default).

Defined results. Rows whose vector is null, empty, or holds a null or a non-finite entry are
dropped. Vectors of several lengths cannot be one matrix: the most frequent length stays, of
equally frequent ones the longest. Rows with null or repeated ids stay, one result each per
component. Components without variance (eigenvalue not above rounding) can't be whitened and
are left out, so a table with a single distinct vector gives no rows, as does an empty one.
Eigenvalues that tie have any orthogonal eigenvectors. A squared deviation beyond a long's
range is null. Other columns are not used, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix, MatrixUDT
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from repoloom.llm.tables import stage
from repoloom.sources.staging import Staging

COMPONENTS = 4
SCALE = 256
BLOCK_ENTRIES = 1 << 16  # 512 KB, below what a JVM's collector takes for huge
# Blocks that one task of a product's middle dimension adds up.
BLOCKS_PER_SPLIT = 32
_PARTITION_SHIFT = 33  # of monotonically_increasing_id
_LONG = np.iinfo(np.int64).max

_RESULT_DDL = (
    "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
)


def integers(vectors: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """(vec_id, x) of the rows whose vector is complete and finite."""
    entries = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("c"))
    complete = F.size("c") > 0
    complete &= F.forall("c", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    x = F.transform("c", lambda e: F.floor(e * scale).cast("long"))
    return entries.filter(F.coalesce(complete, F.lit(False))).select("vec_id", x.alias("x"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, width)


def _partial_sums(width: int):
    """Sums of both halves of the entries, so that no sum of 2^31 rows overflows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, high, low = 0, np.zeros(width, np.int64), np.zeros(width, np.int64)
        for batch in batches:
            x = _matrix(batch.column("x"), width)
            rows += len(x)
            high += (x >> 32).sum(axis=0)
            low += (x & 0xFFFFFFFF).sum(axis=0)
        yield pa.RecordBatch.from_arrays(
            [pa.array([rows]), pa.array([high.tolist()], pa.list_(pa.int64())), pa.array([low.tolist()], pa.list_(pa.int64()))],
            names=["rows", "high", "low"],
        )

    return run


def _sums(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    """(n, S) as exact integers."""
    parts = fit.select("x").mapInArrow(_partial_sums(width), "rows long, high array<long>, low array<long>")
    n = parts.agg(F.sum("rows")).first()[0] or 0
    entries = parts.select("rows", F.posexplode(F.arrays_zip("high", "low")).alias("k", "halves"))
    total = lambda half: F.sum(F.col("halves")[half].cast("decimal(38,0)"))
    found = entries.groupBy("k").agg(total("high").alias("high"), total("low").alias("low")).collect()  # one row per dimension
    sums = {r["k"]: (int(r["high"]) << 32) + int(r["low"]) for r in found}
    return n, [sums[k] for k in range(width)]


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """For each row the sum of (n * x - S)^2, exactly; null beyond a long."""
    if not len(x):
        return []
    largest = n * max(int(x.max()), -int(x.min())) + max(map(abs, sums))
    if len(sums) * largest * largest <= _LONG:
        return ((n * x - np.array(sums, dtype=np.int64)) ** 2).sum(axis=1).tolist()
    exact = ((n * x.astype(object) - np.array(sums, dtype=object)) ** 2).sum(axis=1).tolist()
    return [v if v <= _LONG else None for v in exact]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S / n, with the mean's whole part taken off in integers."""
    whole = [s // n for s in sums]
    part = np.array([(s % n) / n for s in sums])
    if max(map(abs, whole)) < 1 << 62 and len(x) and max(int(x.max()), -int(x.min())) < 1 << 62:
        return (x - np.array(whole, dtype=np.int64)) - part
    return (x.astype(object) - np.array(whole, dtype=object)).astype(np.float64) - part


_ROWS_DDL = "block int, vec_id array<long>, deviation array<long>, fit array<boolean>, x array<double>, fit_x array<double>"


def _one_list(values: np.ndarray) -> pa.Array:
    """A matrix by columns, as one list."""
    flat = pa.array(values.flatten("F"))
    return pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)


def _block_rows(n: int, sums: list[int]):
    """One block: its rows in order, centred, by columns; and the same with repeats zero."""
    width = len(sums)

    def run(key: tuple, rows: pa.Table, firsts: pa.Table) -> pa.Table:
        rows = rows.sort_by("row")
        x = _matrix(rows.column("x").combine_chunks(), width)
        fit = np.isin(rows.column("row").to_numpy(), firsts.column("row").to_numpy())
        values = centred(x, n, sums)
        return pa.table(
            {
                "block": pa.array([key[0].as_py()], pa.int32()),
                "vec_id": pa.array([rows.column("vec_id").to_pylist()], pa.list_(pa.int64())),
                "deviation": pa.array([deviations(x, n, sums)], pa.list_(pa.int64())),
                "fit": pa.array([fit.tolist()], pa.list_(pa.bool_())),
                "x": _one_list(values),
                "fit_x": _one_list(np.where(fit[:, None], values, 0.0)),
            }
        )

    return run


def _first_blocks(rows: DataFrame, height: int) -> DataFrame:
    """(p, low): the first block of each partition in which rows were numbered; no gaps."""
    place = F.col("row").bitwiseAND(F.lit((1 << _PARTITION_SHIFT) - 1))
    counts = rows.groupBy(F.shiftright("row", _PARTITION_SHIFT).alias("p")).agg(F.max(place).alias("last"))
    before, low = [], 0
    for r in counts.orderBy("p").collect():  # one row per partition
        before.append((r["p"], low))
        low += r["last"] // height + 1
    return rows.sparkSession.createDataFrame(before, "p long, low long")


def _numbered(rows: DataFrame, first_blocks: DataFrame, height: int) -> DataFrame:
    """`rows` with the number of the block that each row falls into."""
    place = F.col("row").bitwiseAND(F.lit((1 << _PARTITION_SHIFT) - 1))
    rows = rows.withColumn("p", F.shiftright("row", _PARTITION_SHIFT)).join(F.broadcast(first_blocks), "p")
    return rows.withColumn("block", (F.col("low") + F.floor(place / height)).cast("int")).drop("p", "low")


def _as_matrix(column: str, width: int) -> Column:
    """Entries by columns in the stored layout of MLlib's matrices."""
    fields = {
        "type": F.lit(1).cast("tinyint"),
        "numRows": (F.size(column) / width).cast("int"),
        "numCols": F.lit(width),
        "colPtrs": F.lit(None).cast("array<int>"),
        "rowIndices": F.lit(None).cast("array<int>"),
        "values": F.col(column),
        "isTransposed": F.lit(False),
    }
    return F.struct(*(value.alias(name) for name, value in fields.items())).alias(column)


def _staged_blocks(blocks: DataFrame, width: int) -> tuple[DataFrame, str]:
    """The blocks written to the shared folder, and where; `x` and `fit_x` are matrices."""
    path = Staging(blocks.sparkSession).path("blocks")
    place = F.struct(F.col("block").cast("long").alias("_1"), F.lit(0).cast("long").alias("_2")).alias("place")
    blocks.withColumns({"place": place, "x": _as_matrix("x", width), "fit_x": _as_matrix("fit_x", width)}).write.parquet(path)
    return blocks.sparkSession.read.parquet(path), path


def block_matrix(spark: SparkSession, path: str, column: str, height: int, width: int) -> BlockMatrix:
    """A BlockMatrix of one staged column of matrices. They are read as such, so that no
    entry passes through Python, as it would in the constructor from an RDD."""
    place = StructType([StructField("_1", LongType()), StructField("_2", LongType())])
    schema = StructType([StructField("place", place), StructField(column, MatrixUDT())])
    blocks = spark.read.schema(schema).parquet(path)
    return BlockMatrix(callMLlibFunc("createBlockMatrix", blocks, height, width, 0, 0), height, width)


def multiply(left: BlockMatrix, right: BlockMatrix, splits: int) -> BlockMatrix:
    """left x right, with the middle dimension dealt to `splits` tasks per result block. The
    Python method lacks that argument of the Scala one; without it one task would get all."""
    product = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, left.rowsPerBlock, right.colsPerBlock)


def principal(covariance: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors by columns) in falling order, without those of no variance."""
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(-values, kind="stable")[:components]
    values, vectors = values[order], vectors[:, order]
    some = values > max(float(values[0]), 0.0) * len(covariance) * np.finfo(float).eps
    return values[some], vectors[:, some]


def _unpacked(width: int):
    schema = pa.schema(
        [("vec_id", pa.int64()), ("deviation", pa.int64()), ("fit", pa.bool_()), ("whitened", pa.list_(pa.float64()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k] for name in ("vec_id", "deviation", "fit", "whitened")}
                rows = row["whitened"].values.to_numpy().reshape(width, -1).T
                flat = pa.array(np.ascontiguousarray(rows).reshape(-1))
                ends = pa.array(np.arange(0, len(flat) + 1, width), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [*(row[n].values for n in ("vec_id", "deviation", "fit")), pa.ListArray.from_arrays(ends, flat)], schema=schema
                )

    return run


def _identity_error(rows: DataFrame, width: int) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity."""
    pairs = [(i, j) for i in range(width) for j in range(i, width)]
    found = rows.filter("fit").agg(*(F.covar_pop(F.col("whitened")[i], F.col("whitened")[j]) for i, j in pairs)).first()
    return max(abs(value - (i == j)) for value, (i, j) in zip(found, pairs))


def whiten(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    components: int = COMPONENTS,
    scale: int = SCALE,
    rows_per_block: int | None = None,
) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row per vector
    and component, both numbered as given."""
    spark = vectors.sparkSession
    nothing = spark.createDataFrame([], _RESULT_DDL)
    rows = integers(vectors, key, vector, scale).withColumn("row", F.monotonically_increasing_id())
    rows = stage(rows, "vectors")
    size = F.size("x").alias("size")
    common = rows.groupBy(size).count().orderBy(F.desc("count"), F.desc("size")).first()
    if common is None:
        return nothing
    width = common["size"]
    height = rows_per_block or max(1, BLOCK_ENTRIES // width)
    rows = rows.filter(F.size("x") == width)
    fit = stage(rows.groupBy("x").agg(F.min("row").alias("row")), "distinct-vectors")
    n, sums = _sums(fit, width)

    first_blocks = _first_blocks(rows, height)
    numbered = _numbered(rows, first_blocks, height)
    firsts = _numbered(fit.select("row"), first_blocks, height)
    blocks = numbered.groupBy("block").cogroup(firsts.groupBy("block")).applyInArrow(_block_rows(n, sums), _ROWS_DDL)
    blocks, path = _staged_blocks(blocks, width)
    splits = blocks.count() // BLOCKS_PER_SPLIT + 1
    fitted = block_matrix(spark, path, "fit_x", height, width)
    scatter = multiply(fitted.transpose(), fitted, splits).toLocalMatrix().toArray()
    covariance = scatter / n
    values, directions = principal(covariance, components)
    kept = len(values)
    if not kept:
        return nothing

    whitening = DenseMatrix(width, kept, (directions / np.sqrt(values)).flatten("F"))
    whitening = BlockMatrix(spark.sparkContext.parallelize([((0, 0), whitening)], 1), width, kept)
    projected = block_matrix(spark, path, "x", height, width).multiply(whitening)
    projected = projected.blocks.map(lambda b: (b[0][0], b[1].toArray().flatten("F").tolist()))
    projected = spark.createDataFrame(projected, "block int, whitened array<double>")
    done = blocks.select("block", "vec_id", "deviation", "fit").join(projected, "block")
    done = stage(
        done.mapInArrow(_unpacked(kept), "vec_id long, deviation long, fit boolean, whitened array<double>"), "whitened"
    )
    explained = F.array(*(F.lit(float(v / np.trace(covariance))) for v in values))
    return done.select("vec_id", "deviation", F.posexplode("whitened").alias("k", "whitened")).select(
        "vec_id",
        (F.col("k") + 1).alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        explained[F.col("k")].alias("explained"),
        F.lit(_identity_error(done, kept)).alias("identity_error"),
    )
