"""Embedding whitening with MLlib's distributed block matrices.

Vectors become integers first, so counts, sums and deviations are exact. The distinct vectors are numbered, centred and put
into the blocks of a ``BlockMatrix`` C; C transposed times C is the scatter, whose eigenvectors are found on the driver (a
matrix of dimensions by dimensions); C times the whitening matrix projects the distinct vectors, and every row takes the
projection of its vector. Products are summed over ``SPLITS`` parts of the long side, so no task sees all blocks.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadplan.operators.spatial import checkpointed

COMPONENTS = 16
#: x = floor(SCALE * c) + SHIFT
SCALE, SHIFT = 64, 1_000_000
#: Rows of a block grow with the table between these bounds, so that the driver's list of blocks stays short.
LEAST_ROWS, MOST_ROWS, BLOCKS = 1024, 65_536, 20_000
COLUMNS = 1024
#: Parts of the long side whose products are summed apart.
SPLITS = 64
#: Eigenvalues up to this share of the largest one count as zero.
ZERO = 1e-12
RESULT = "{id}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id_col, x) of the rows with a finite vector of the commonest length (the shortest of equally common ones)."""
    v = F.col(vector_col)
    rows = vectors.select(F.col(id_col), v.cast("array<double>").alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = rows.where(F.coalesce(finite & (F.size("v") > 0), F.lit(False)))
    rows = checkpointed(rows.select(id_col, F.transform("v", lambda c: F.floor(c * SCALE).cast("long") + SHIFT).alias("x")))
    lengths = rows.groupBy(F.size("x").alias("length")).count().orderBy(F.desc("count"), "length").collect()
    return rows if len(lengths) < 2 else rows.where(F.size("x") == lengths[0].length)


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``index`` from 0 without gaps; written first, so that a lost task finds the same numbers again."""
    marked = checkpointed(rows.withColumn("_mark", F.monotonically_increasing_id()))
    part = F.shiftright("_mark", 33)
    counts = sorted(marked.groupBy(part.alias("part")).count().collect())
    before = np.concatenate(([0], np.cumsum([n for _, n in counts]))).tolist()
    offsets = rows.sparkSession.createDataFrame(
        [(p, before[i]) for i, (p, _) in enumerate(counts)], "_part long, _before long")
    joined = marked.join(F.broadcast(offsets), part == F.col("_part"))
    inside = F.col("_mark").bitwiseAND(F.lit((1 << 33) - 1))
    return joined.select(*rows.columns, (F.col("_before") + inside).alias("index"))


def block_matrix(rows: DataFrame, n: int, dim: int, block_rows: int) -> BlockMatrix:
    """Blocks of the rows (index, values)."""
    vectors = rows.select("index", array_to_vector("values").alias("vector"))
    matrix = IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "vector"), n, dim)
    return matrix.toBlockMatrix(block_rows, min(dim, COLUMNS))


def product(one: BlockMatrix, two: BlockMatrix, splits: int = 1) -> BlockMatrix:
    """``one`` times ``two``, the inner side cut into ``splits`` parts that are summed apart."""
    java = one._java_matrix_wrapper.call("multiply", two._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(java, one.rowsPerBlock, two.colsPerBlock)


def indexed_rows(matrix: BlockMatrix) -> DataFrame:
    """(index, values) of a block matrix's rows."""
    indexed = matrix.toIndexedRowMatrix()  # kept by name: the JVM's object is let go with the last reference to its wrapper
    rows = callMLlibFunc("getIndexedRows", indexed._java_matrix_wrapper._java_model)
    return rows.select("index", vector_to_array("vector").alias("values"))


def _exact(rows: DataFrame) -> tuple[int, list[int]]:
    """Number of rows and the sum of each dimension."""
    sums = rows.select(F.posexplode("x").alias("i", "value")).groupBy("i").agg(
        F.sum("value").alias("total"), F.count("*").alias("n")).collect()
    return (sums[0].n, [r.total for r in sorted(sums)]) if sums else (0, [])


def whiten(
    vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """(id_col, component, n, deviation, whitened, explained, identity_error), one row per vector and component.

    Sums, covariance and components are those of the distinct integer vectors (``n`` of them), so copies weigh nothing.
    ``deviation`` is the sum over the dimensions of (n*x - sum)**2, exact; ``whitened`` the centred vector's projection over
    the root of the component's eigenvalue; ``explained`` the eigenvalue's share of all variance; ``identity_error`` the largest
    deviation of the projections' covariance from the identity, over components with variance.

    Rows whose vector is null, empty, of another length than the commonest, or holds null or non-finite entries take
    no part; a null id is an id like any other; repeated rows are returned as often as they come; other columns aren't read.
    Vectors of fewer dimensions than ``components`` have as many components as dimensions. A component without variance
    (all of them if only one vector is distinct) has a null ``whitened``, its share is 0, or null if nothing varies.
    An empty table gives an empty table. Entries must be below 2**46 in size.
    """
    spark = vectors.sparkSession
    id_type = f"`{id_col}` {vectors.schema[id_col].dataType.simpleString()}"
    rows = integer_vectors(vectors, id_col, vector_col)
    fit = checkpointed(numbered(rows.select("x").distinct()))
    n, sums = _exact(fit)
    if not n:
        return spark.createDataFrame([], RESULT.format(id=id_type))
    dim, kept = len(sums), min(components, len(sums))
    total: Column = F.array(*[F.lit(s).cast("long") for s in sums])
    away = F.transform("x", lambda v, i: v * F.lit(n).cast("long") - total[i])
    fit = fit.select("index", "x", away.alias("away"))
    block_rows = min(MOST_ROWS, max(LEAST_ROWS, -(-n // BLOCKS)))
    centred = block_matrix(
        fit.select("index", F.transform("away", lambda a: a / F.lit(float(n))).alias("values")), n, dim, block_rows)

    scatter = product(centred.transpose(), centred, SPLITS).toLocalMatrix().toArray() / n
    values, directions = np.linalg.eigh((scatter + scatter.T) / 2)
    values, directions = values[::-1], directions[:, ::-1]
    trace = float(values.clip(0).sum())
    live = int((values[:kept] > values[0] * ZERO).sum()) if trace > 0 else 0
    explained = [float(max(values[k], 0) / trace) if trace > 0 else None for k in range(kept)]

    error = None
    if live:
        matrix = directions[:, :live] / np.sqrt(values[:live])
        local = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(matrix)], "index long, values array<double>")
        whitening = block_matrix(local, dim, live, centred.colsPerBlock)
        projected = product(centred, whitening)
        covariance = product(projected.transpose(), projected, SPLITS).toLocalMatrix().toArray() / n
        error = float(np.abs(covariance - np.eye(live)).max())
        fit = fit.join(indexed_rows(projected), "index")
    else:
        fit = fit.withColumn("values", F.array().cast("array<double>"))

    square = lambda a: a.cast("decimal(19,0)") * a.cast("decimal(19,0)")
    deviation = F.aggregate("away", F.lit(0).cast("decimal(38,0)"), lambda s, a: (s + square(a)).cast("decimal(38,0)"))
    shares = F.array(*[F.lit(s).cast("double") for s in explained])
    fit = checkpointed(fit.select("x", deviation.alias("deviation"), "values"))
    every = F.explode(F.sequence(F.lit(1), F.lit(kept)))
    return rows.join(fit, "x").select(id_col, "deviation", "values", every.alias("component")).select(
        id_col, "component", F.lit(n).cast("long").alias("n"), "deviation",
        F.get("values", F.col("component") - 1).alias("whitened"), F.get(shares, F.col("component") - 1).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"))


def whitening_report(vectors: DataFrame) -> DataFrame:
    """As ``whiten``, the deviation as a long (an error if it doesn't fit)."""
    return whiten(vectors).withColumn("deviation", F.col("deviation").cast("long"))
