"""A clustered index of vectors for nearest rows by cosine: trained cells, vectors stored by cell, probes, exact re-scoring.

Cells are centroids of k-means over a sample of rows, bounded by ``SAMPLE_ROWS``; every row is then stored in the cell of
its nearest centroid, in packed blocks of up to ``BLOCK_ROWS``, under a folder of that cell. How many cells a query must ask is
measured when the index is built: the fewest with which a sample of rows finds the share ``recall`` of its exact nearest
ones. Cells of vectors without clusters hold few of each other's neighbours, so the number may come near to all. A search
asks each query's ``probes`` nearest cells: blocks of queries meet blocks of rows by equality of cell and group of blocks (``GROUP_BLOCKS``, so
that a cell with a third of all rows is spread over many keys), matrix products score them, and the best of each meeting
are ranked once more. With ``probes=ALL`` every cell is asked and the result is exact.

Rows and queries without a vector, or whose vector holds a null or non-finite entry, are left out: they have no score. A
vector of zeros has the cosine 0 with every other. Repeated rows are stored each. A query doesn't meet the row of its own
id. Ties go to the smaller id. Vectors of different lengths raise. An empty table makes an index that finds nothing.
Columns other than id and vector are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.ranking import ranked
from quern.sources import publication
from quern.sources.scratch import written

#: Rows (expected) that the cells are trained on, and cells at most.
SAMPLE_ROWS, MOST_CELLS = 100_000, 4_096
#: Vectors in a packed block of rows, of queries, and blocks of a cell that share a join key.
BLOCK_ROWS, BLOCK_QUERIES, GROUP_BLOCKS = 1_024, 256, 32
#: Rows (expected) whose exact nearest ``DEPTH`` rows tell how many cells to ask.
CALIBRATION_ROWS, DEPTH = 200, 10
ALL = 1 << 30
BLOCKS = "cell int, part int, ids array<long>, vectors binary"


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(fine, F.lit(False))


def unit(matrix: np.ndarray) -> np.ndarray:
    """Rows of length one; rows of zeros stay."""
    norms = np.sqrt((matrix * matrix).sum(1, keepdims=True))
    return matrix / np.where(norms == 0, 1.0, norms)


def matrix(column: pa.Array) -> np.ndarray:
    widths = np.diff(np.asarray(column.offsets))
    if len(widths) and (widths != widths[0]).any():
        raise ValueError(f"vectors of {widths.min()} and {widths.max()} entries can't be compared")
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def trained(rows: DataFrame, cells: int | None = None, seed: int = 7) -> np.ndarray:
    """Centroids of unit length, one a row, from a sample by hash of id and vector. No row: none; only zeros: one of zeros."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    n, low, high = rows.agg(F.count(F.lit(1)), F.min(F.size("vector")), F.max(F.size("vector"))).first()
    if low != high:
        raise ValueError(f"vectors of {low} and {high} entries can't be compared")
    share = F.pmod(F.xxhash64("id", "vector", F.lit(seed)), F.lit(1 << 30)) < int(min(1.0, SAMPLE_ROWS / max(n, 1)) * (1 << 30))
    sample = rows.where(share & F.exists("vector", lambda c: c != 0)).select(array_to_vector(F.col("vector")).alias("features"))
    sample = written(sample.select(F.col("features")), "sample")
    held = sample.count()
    if not held:
        first = rows.select("vector").first()
        return np.zeros((1, len(first[0]))) if first else np.zeros((0, 0))
    k = min(held, cells or min(MOST_CELLS, math.ceil(math.sqrt(n))))
    if k == 1:
        return unit(np.array([sample.first()[0].toArray()]))
    fitted = KMeans(k=k, seed=seed, maxIter=10, distanceMeasure="cosine").fit(sample)
    return unit(np.array(fitted.clusterCenters(), np.float64))


def _rows(table: DataFrame, id_column: str, vector: str) -> DataFrame:
    held = table.where(usable(F.col(vector)) & F.col(id_column).isNotNull())
    return held.select(F.col(id_column).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))


def _packed(rows: DataFrame, centroids: np.ndarray, probes: int, most: int) -> DataFrame:
    """Vectors, of unit length, in blocks of their ``probes`` nearest cells."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                vectors = unit(matrix(batch.column(1)))
                cells = np.argsort(-(vectors @ centroids.T), axis=1, kind="stable")[:, :probes]
                of = np.repeat(np.arange(len(vectors)), cells.shape[1])
                packed = pa.array([v.tobytes() for v in vectors], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(cells.ravel(), pa.int32()), batch.column(0).take(pa.array(of)), packed.take(pa.array(of))], names=["cell", "id", "vector"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        kind = pa.schema([("cell", pa.int32()), ("part", pa.int32()), ("ids", pa.list_(pa.int64())), ("vectors", pa.binary())])
        cell, ids, vectors = None, [], []

        def block() -> Iterator[pa.RecordBatch]:
            if ids:
                yield pa.RecordBatch.from_pylist([{"cell": cell, "part": part, "ids": ids, "vectors": b"".join(vectors)}], schema=kind)

        for batch in batches:
            for c, i, v in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if c != cell or len(ids) == most:
                    yield from block()
                    cell, ids, vectors = c, [], []
                ids.append(i)
                vectors.append(v)
        yield from block()

    placed = rows.mapInArrow(near, "cell int, id long, vector binary")
    order = ["cell", "id", F.xxhash64("vector")]
    return placed.repartitionByRange(*order).sortWithinPartitions("cell", "id").mapInArrow(pack, BLOCKS)


def build(rows: DataFrame, folder: str, version: str, id_column: str = "vec_id", vector: str = "embedding", cells: int | None = None, recall: float = 0.95) -> int:
    """Trains the cells, stores every row by cell and publishes the index as a version; gives the cells that a query asks."""
    spark, held = rows.sparkSession, _rows(rows, id_column, vector)
    centroids = trained(held, cells)
    blocks = _packed(held, centroids, 1, BLOCK_ROWS) if len(centroids) else spark.createDataFrame([], BLOCKS)
    publication.publish(blocks, f"{folder}/blocks", version, by=("cell",))
    probes = _calibrated(held, publication.version_path(spark, f"{folder}/blocks", version), centroids, recall)
    kept = spark.createDataFrame([(k, c.tolist(), probes) for k, c in enumerate(centroids)], "cell int, centroid array<double>, probes int")
    publication.publish(kept, folder, version)
    return probes


def _calibrated(held: DataFrame, blocks: str, centroids: np.ndarray, recall: float) -> int:
    if len(centroids) < 2:
        return 1
    share = min(1.0, CALIBRATION_ROWS / max(held.count(), 1))
    sample = written(held.where(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 30)) < int(share * (1 << 30))), "calibration")
    exact = _met(sample, blocks, centroids, ALL, DEPTH)
    places = ranked(exact, DEPTH, F.desc("score"), F.asc("vec_id")).select(F.col("query_id").alias("id"), "cell").join(sample, "id").collect()
    if not places:
        return len(centroids)
    near = np.argsort(-(unit(np.array([r.vector for r in places])) @ centroids.T), axis=1, kind="stable")
    needed = np.sort((near == np.array([r.cell for r in places])[:, None]).argmax(1) + 1)
    return int(needed[min(len(needed) - 1, math.ceil(recall * len(needed)) - 1)])


def search(spark: SparkSession, folder: str, queries: DataFrame, top: int, probes: int | None = None, id_column: str = "query_id", vector: str = "embedding") -> DataFrame:
    """query_id, vec_id, score (cosine to six places) and rank of the ``top`` rows of each query in its ``probes`` nearest cells.

    Without ``probes`` as many as were measured when the index was built; ``ALL`` is exact.
    """
    kept = publication.current(spark, folder).orderBy("cell").collect()  # MOST_CELLS at most
    if not kept:
        found = spark.createDataFrame([], "query_id long, vec_id long, score double")
    else:
        centroids = np.array([r.centroid for r in kept], np.float64)
        blocks = publication.version_path(spark, f"{folder}/blocks", publication.current_version(spark, folder))
        found = _met(_rows(queries, id_column, vector), blocks, centroids, probes or kept[0].probes, top).drop("cell")
    return ranked(found, top, F.desc("score"), F.asc("vec_id"))


def _met(queries: DataFrame, path: str, centroids: np.ndarray, probes: int, top: int) -> DataFrame:
    """query_id, vec_id, score and cell of the best ``top`` rows in each meeting of a block of queries and one of rows."""
    spark = queries.sparkSession
    asked = _packed(queries, centroids, min(probes, len(centroids)), BLOCK_QUERIES)
    asked = written(asked.select("cell", F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors")), "asked")
    stored = spark.read.schema(BLOCKS).parquet(path)
    wanted = [r[0] for r in asked.select("cell").distinct().collect()]  # MOST_CELLS at most
    stored = stored.where(F.col("cell").isin(wanted)) if len(wanted) < len(centroids) else stored  # only the folders of these cells are read
    groups = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("n_blocks") / GROUP_BLOCKS))
    counts = F.broadcast(stored.groupBy(F.col("cell").alias("_cell")).agg(F.count(F.lit(1)).alias("n_blocks")))
    grouped = stored.join(counts, F.col("cell") == F.col("_cell")).select("cell", F.pmod(F.xxhash64("part", F.col("ids")[0]), groups).alias("block_group"), "ids", "vectors")
    spread = asked.join(counts, F.col("cell") == F.col("_cell")).select(F.col("cell").alias("q_cell"), F.explode(F.sequence(F.lit(0).cast("long"), groups - 1)).alias("q_group"), "q_ids", "q_vectors")
    met = grouped.join(spread, (F.col("cell") == F.col("q_cell")) & (F.col("block_group") == F.col("q_group"))).select("cell", "ids", "vectors", "q_ids", "q_vectors")
    width = centroids.shape[1]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell, ids, vectors, q_ids, q_vectors in zip(*(batch.column(k) for k in range(5)), strict=True):
                ids, q_ids = np.asarray(ids.values, np.int64), np.asarray(q_ids.values, np.int64)
                rows, q = (np.frombuffer(v.as_py(), np.float64).reshape(-1, width) for v in (vectors, q_vectors))
                by_id = np.argsort(ids, kind="stable")  # of equal scores the smaller id stands first
                ids = ids[by_id]
                micro = np.floor(q @ rows[by_id].T * 1e6 + 0.5)
                micro[q_ids[:, None] == ids[None, :]] = -np.inf
                best = np.argsort(-micro, axis=1, kind="stable")[:, :top]
                found = np.take_along_axis(micro, best, 1)
                keep = np.isfinite(found)
                query = np.broadcast_to(q_ids[:, None], found.shape)[keep]
                cells = pa.array(np.full(int(keep.sum()), cell.as_py()), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(ids[best][keep]), pa.array(found[keep] / 1e6), cells], names=["query_id", "vec_id", "score", "cell"])

    return met.mapInArrow(score, "query_id long, vec_id long, score double, cell int")
