"""Operator 11: whitening of embeddings with MLlib's block matrices.

Vectors become exact integers and rows get dense numbers. The distinct vectors are the fit list; their sums are exact,
so centred rows differ from x - S/n by rounding alone. Centred rows are dealt into the blocks of a distributed matrix, 1,024
rows a block, which are stored; no row passes through Python. The matrix's transpose times itself is the scatter; the driver finds the eigenvectors of that one small matrix, and the blocks times
the whitening matrix project every row. The products are split along the rows, a bounded number of blocks a task, so
what a task holds does not grow with the table. The projected fit list times itself gives the identity error; as the
fit list is centred exactly, so is its projection.

Copies of a vector are one row of the fit list and rows of the projection like any other; no key gathers them, for
copies are merged in each task first and the result is joined by row number, each of which stands once.

The driver holds sums and matrices of the dimension, and the coordinates of the blocks, one for 1,024 rows.

Defined results: vectors that are null, empty or hold entries that are null, not finite or too large for a long are left out, and so
are vectors of another length than the commonest; null and repeated ids keep a row each; equal
vectors get equal values up to rounding; a component without variance (an eigenvalue within rounding of zero: too few
distinct vectors, constant entries) has null as its whitened value, explains its share, 0 if nothing varies, and is left out of the
identity error; a deviation that does not fit a long is null; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices, MatrixUDT
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegerType, LongType, StructField, StructType

from nlimorph.llm._shared import new_folder
from nlimorph.llm.vectors import integers, numbered, of_one_length

ROWS_PER_BLOCK = 1024
BLOCKS_PER_TASK = 16


def _longs(values: list[int]) -> Column:
    return F.lit(values).cast("array<bigint>")


class Centre:
    """Exact sums of the fit list: S = n * base + rest by dimension, with 0 <= rest < n."""

    def __init__(self, fit: DataFrame):
        each = fit.select(F.posexplode("x").alias("k", "v"))
        low, high = F.col("v").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftright("v", 32)
        by = each.groupBy("k").agg(F.count("*").alias("n"), F.sum(low).alias("low"), F.sum(high).alias("high"), F.min("v").alias("least"), F.max("v").alias("most"))
        sums = sorted(by.collect())  # a row a dimension
        self.n = sums[0].n
        total = [(s.high << 32) + s.low for s in sums]
        self.base, self.rest = [t // self.n for t in total], [t % self.n for t in total]
        self.widest = max(max(s.most - b, b - s.least) for s, b in zip(sums, self.base, strict=True))

    def centred(self) -> Column:
        """x - S/n as doubles."""
        near = F.zip_with("x", _longs(self.base), lambda v, b: (v - b).cast("double"))
        return F.zip_with(near, F.lit([r / self.n for r in self.rest]), lambda v, r: v - r)

    def deviation(self) -> Column:
        """The sum over dimensions of (n * x - S)^2: plain longs where they are certain to hold it, else decimals."""
        off = F.zip_with("x", _longs(self.base), lambda v, b: v - b)
        if len(self.base) * (self.n * (self.widest + 1)) ** 2 < 1 << 63:
            times = F.zip_with(off, _longs(self.rest), lambda v, r: v * self.n - r)
            return F.aggregate(times, F.lit(0).cast("long"), lambda s, t: s + t * t)
        wide = "decimal(38,0)"
        times = F.zip_with(off, _longs(self.rest), lambda v, r: v.cast("decimal(19,0)") * F.lit(self.n).cast("decimal(19,0)") - r.cast("decimal(19,0)"))
        squares = F.transform(times, lambda t: F.try_multiply(t.cast(wide), t.cast(wide)).cast(wide))
        return F.aggregate(squares, F.lit(0).cast(wide), lambda s, t: F.try_add(s, t).cast(wide)).try_cast("long")


def _stored(df: DataFrame, label: str, schema: StructType) -> DataFrame:
    """df written and read back under another schema of the same layout: matrices as their fields or the other way round."""
    path = new_folder(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def _place(kind: DataType) -> StructType:
    return StructType([StructField("_1", kind), StructField("_2", kind)])


def _blocks(rows: DataFrame, values: Column, n: int, d: int) -> BlockMatrix:
    """A block matrix of n rows whose row number ``row`` holds ``values``. Blocks are stored, so they are made once."""
    each = rows.select(F.floor(F.col("row") / ROWS_PER_BLOCK).alias("block"), (F.col("row") % ROWS_PER_BLOCK).alias("at"), values.alias("v"))
    by = each.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("parts"))
    no_ints, in_rows = F.lit(None).cast("array<int>"), F.flatten(F.transform("parts", lambda p: p["v"]))
    made = (F.lit(1).cast("byte"), F.size("parts"), F.lit(d), no_ints, no_ints, in_rows, F.lit(True))  # a dense matrix, row by row
    matrix = F.struct(*[v.alias(f.name) for v, f in zip(made, MatrixUDT.sqlType().fields, strict=True)])
    blocks = by.select(F.struct(F.col("block").cast("long").alias("_1"), F.lit(0).cast("long").alias("_2")).alias("_1"), matrix.alias("_2"))
    read = _stored(blocks, "blocks", StructType([StructField("_1", _place(LongType())), StructField("_2", MatrixUDT())]))
    return BlockMatrix(callMLlibFunc("createBlockMatrix", read, ROWS_PER_BLOCK, d, n, d), ROWS_PER_BLOCK, d)


def _scatter(m: BlockMatrix) -> np.ndarray:
    """The transpose times the matrix, split along the rows."""
    splits = -(-m.numRowBlocks // BLOCKS_PER_TASK)
    product = m.transpose()._java_matrix_wrapper.call("multiply", m._java_matrix_wrapper._java_model, splits)
    d = m.numCols()
    return BlockMatrix(product, d, d).toLocalMatrix().toArray()


def _project(m: BlockMatrix, weights: np.ndarray, spark: SparkSession) -> BlockMatrix:
    d, k = weights.shape
    block = Matrices.dense(d, k, weights.ravel(order="F").tolist())
    return m.multiply(BlockMatrix(spark.sparkContext.parallelize([((0, 0), block)], 1), d, k))


def _rows_of(m: BlockMatrix, k: int) -> DataFrame:
    """(row, values) of a block matrix of k columns; its blocks are stored and opened where they are read."""
    found = callMLlibFunc("getMatrixBlocks", m._java_matrix_wrapper._java_model)
    blocks = _stored(found, "projected", StructType([StructField("_1", _place(IntegerType())), StructField("_2", MatrixUDT.sqlType())]))
    each = blocks.select(F.col("_1._1").alias("block"), "_2.*").select("*", F.explode(F.sequence(F.lit(0), F.col("numRows") - 1)).alias("at"))
    by_row = F.slice("values", F.col("at") * k + 1, k)
    by_column = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda c: F.get("values", c * F.col("numRows") + F.col("at")))
    return each.select((F.col("block").cast("long") * ROWS_PER_BLOCK + F.col("at")).alias("row"), F.when(F.col("isTransposed"), by_row).otherwise(by_column).alias("white"))


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 16, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of every row and component, the strongest first."""
    kept, d = of_one_length(integers(df, vector_col, {"_id": id_col}, scale, shift))
    schema = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not d:
        return df.sparkSession.createDataFrame([], schema)
    spark = df.sparkSession
    rows = numbered(kept, "vectors")
    fit = numbered(rows.select("x").distinct(), "fit")
    centre, k = Centre(fit), min(components, d)
    matrix = _blocks(fit, centre.centred(), centre.n, d)
    values, vectors = np.linalg.eigh(_scatter(matrix) / centre.n)
    values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
    trace = values.sum()
    varies = values[:k] > values[0] * d * np.finfo(float).eps
    weights = np.where(varies, vectors[:, :k] / np.sqrt(np.where(varies, values[:k], 1)), 0)
    error = np.abs(_scatter(_project(matrix, weights, spark)) / centre.n - np.eye(k))[np.ix_(varies, varies)].max(initial=0)
    shares = [float(v / trace) if trace else 0.0 for v in values[:k]]

    white = _rows_of(_project(_blocks(rows, centre.centred(), rows.count(), d), weights, spark), k)
    met = rows.select("row", "_id", centre.deviation().alias("deviation")).join(white, "row")
    each = met.select("_id", "deviation", F.posexplode("white").alias("at", "value"))
    at = F.col("at")
    whitened = F.when(F.get(F.lit(varies.tolist()), at), F.col("value"))
    return each.select(
        F.col("_id").alias(id_col),
        (at + 1).alias("component"),
        F.lit(centre.n).cast("long").alias("n"),
        "deviation",
        whitened.alias("whitened"),
        F.get(F.lit(shares), at).alias("explained"),
        F.lit(float(error)).alias("identity_error"),
    )
