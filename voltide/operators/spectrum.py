"""Spectra of array columns: the Gram matrix is summed in Spark, its eigenvectors are found on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Largest dimension: the Gram matrix of so many columns goes to the driver.
MAX_DIM = 1024


def _matrix(column, dim: int) -> np.ndarray:
    """The arrays that are not null as rows; arrays of different lengths, or with nulls in them, are an error."""
    import pyarrow.compute as pc

    known = column.drop_null()
    sizes = pc.list_value_length(known).to_numpy(zero_copy_only=False)
    if (sizes != dim).any():
        raise ValueError(f"arrays of {int(sizes.min())} and of {dim} numbers in one column")
    flat = known.flatten()
    if flat.null_count:
        raise ValueError("arrays with nulls in them")
    return flat.to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)


def moments(df: DataFrame, column: str = "embedding") -> tuple[int, np.ndarray, np.ndarray]:
    """Number of rows, mean and covariance (population). Each task sends one partial Gram matrix; they are added in Spark by row of the matrix."""
    dim = df.select(F.max(F.size(column))).first()[0] or 0
    if dim > MAX_DIM:
        raise ValueError(f"arrays of more than {MAX_DIM} numbers")

    def run(batches):
        total, gram, n = np.zeros(dim), np.zeros((dim, dim)), 0
        for b in batches:
            x = _matrix(b.column(0), dim)
            if len(x):
                total, gram, n = total + x.sum(axis=0), gram + x.T @ x, n + len(x)
        import pyarrow as pa

        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim, dtype=np.int32)), pa.array(np.full(dim, n)), pa.array(total), pa.array(gram.tolist(), type=pa.list_(pa.float64()))], names=["i", "n", "s", "g"])

    parts = df.select(column).mapInArrow(run, "i int, n bigint, s double, g array<double>")
    cells = parts.select("i", "n", "s", F.posexplode("g").alias("j", "v")).groupBy("i", "j").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("v").alias("v"))
    row = F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda x: x["v"])
    rows = cells.groupBy("i").agg(F.first("n").alias("n"), F.first("s").alias("s"), row.alias("g")).orderBy("i").toArrow()  # dim rows of dim numbers
    n = rows.column("n")[0].as_py() if rows.num_rows else 0
    mean, gram = np.zeros(dim), np.zeros((dim, dim))
    if rows.num_rows:
        mean, gram = rows.column("s").to_numpy(), rows.column("g").combine_chunks().flatten().to_numpy().reshape(dim, dim)
    mean = mean / max(n, 1)
    return n, mean, gram / max(n, 1) - np.outer(mean, mean)


def effective_rank(df: DataFrame, column: str = "embedding", dead: float = 1e-6) -> DataFrame:
    """One row: entropy rank, stable rank, components for 95 and 99 % of the variance, dead components, total variance."""
    n, _, cov = moments(df, column)
    values = np.clip(np.linalg.eigvalsh(cov)[::-1], 0, None)
    total = values.sum()
    share = values / total if total > 0 else np.zeros_like(values)
    pos = share[share > 0]
    entropy = float(np.exp(-(pos * np.log(pos)).sum())) if len(pos) else 0.0
    stable = float(total / values[0]) if total > 0 else 0.0
    upto = np.cumsum(share)
    k = lambda level: int(np.searchsorted(upto, level - 1e-12) + 1) if total > 0 else 0
    row = (n, len(values), entropy, stable, k(0.95), k(0.99), int((share < dead).sum()), float(total), values.tolist())
    return df.sparkSession.createDataFrame([row], "n bigint, dim int, entropy_rank double, stable_rank double, k95 int, k99 int, n_dead int, total_variance double, spectrum array<double>")


def trace(df: DataFrame, column: str = "embedding") -> DataFrame:
    """The total variance alone, without a Gram matrix: the sum of the columns' variances."""
    cells = df.select(F.posexplode(column).alias("d", "x")).groupBy("d").agg(F.var_pop(F.col("x").cast("double")).alias("v"))
    return cells.agg(F.sum("v").alias("total_variance"), F.count("*").alias("dim"))


def loadings(df: DataFrame, column: str = "embedding") -> tuple[np.ndarray, np.ndarray]:
    """Mean, and the components as columns, by falling variance; the largest entry of each is positive."""
    _, mean, cov = moments(df, column)
    _, v = np.linalg.eigh(cov)
    v = v[:, ::-1]
    return mean, v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])])


def _mapped(df: DataFrame, column: str, dim: int, out: str, f) -> DataFrame:
    """Adds ``out``: the rows' arrays of ``dim`` numbers put through ``f`` as one matrix for each batch; null where the array is."""
    import pyarrow as pa
    from pyspark.sql import types as T

    def run(batches):
        for b in batches:
            at = b.column(b.schema.get_field_index(column))
            y = f(_matrix(at, dim))
            ends = np.concatenate([[0], np.cumsum(at.is_valid().to_numpy(zero_copy_only=False))]).astype(np.int32) * y.shape[1]
            null = np.append(at.is_null().to_numpy(zero_copy_only=False), False)
            offsets = pa.array(ends, mask=null) if null.any() else pa.array(ends)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(offsets, pa.array(y.ravel()))], names=[*b.schema.names, out])

    df = df.drop(out)
    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))]))


def pc_project(df: DataFrame, mean: np.ndarray, v: np.ndarray, column: str = "embedding", out: str = "pcs") -> DataFrame:
    """Adds each row's coordinates in the basis of components."""
    return _mapped(df, column, len(mean), out, lambda x: (x - mean) @ v)


def pc_reconstruct(df: DataFrame, mean: np.ndarray, v: np.ndarray, k: int, pcs: str = "pcs", out: str = "reconstructed") -> DataFrame:
    """Adds the row built from its first k components."""
    return _mapped(df, pcs, v.shape[1], out, lambda x: x[:, :k] @ v[:, :k].T + mean)


def ablate_dim(df: DataFrame, column: str = "embedding") -> DataFrame:
    """For each dimension, the mean squared change of the rows when it is set to its mean: its variance, and its share of all."""
    cells = df.select(F.posexplode(column).alias("dim", "x")).groupBy("dim").agg(F.var_pop(F.col("x").cast("double")).alias("loss"))
    return cells.crossJoin(F.broadcast(cells.agg(F.sum("loss").alias("_t")))).select("dim", "loss", F.try_divide("loss", "_t").alias("share"))


def ablate_pc(df: DataFrame, column: str = "embedding") -> DataFrame:
    """The same for principal components: each one's variance."""
    mean, v = loadings(df, column)
    return ablate_dim(pc_project(df, mean, v, column), "pcs").withColumnRenamed("dim", "pc")
