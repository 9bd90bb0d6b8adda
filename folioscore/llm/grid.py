"""A stated query set against all rows, in blocks.

Index rows are packed into blocks of a fixed size, queries into groups; both are files
in the shared folder, and only their paths are ever dealt out. Blocks are joined into
slabs, and each (query group, slab) is one task, which reads its queries and streams the
slab's blocks past them, keeping the ``k`` best of each query. Tasks are dealt by number,
so cores have equally many. Then the slabs' lists of a query, ``k`` rows each, are merged.
Memory is a block and a group, whatever the table's size; no pair of rows is ever a row.

Vectors of different lengths have no inner product: each length is searched on its own.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import filesystem, new_path, staged

MAX_BLOCKS_IN_SLAB = 8
#: Beyond so many, a task takes several units, one after the other.
MAX_TASKS = 10_000


def dump(**arrays: np.ndarray) -> bytes:
    np.savez(out := io.BytesIO(), **arrays)
    return out.getvalue()


def load(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as f:
        return dict(f)


def usable(df: DataFrame, id_col: str, vec_col: str, zero: bool) -> DataFrame:
    """(id, vec) of the vectors that take part: not null, every component finite, and
    not all zero unless ``zero``."""
    vec = F.col(vec_col).cast("array<double>")
    ok = vec.isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    if not zero:
        ok &= F.exists(vec, lambda x: x != 0)
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")).filter(F.col("id").isNotNull() & ok)


def by_length(df: DataFrame, id_col: str, vec_col: str, zero: bool, run: Callable[[DataFrame, int, int], DataFrame]) -> DataFrame:
    """``run(rows, how many, their length)`` for the usable rows of each length, in one frame."""
    rows = staged(usable(df, id_col, vec_col, zero), "vectors")
    lengths = {r["d"]: r["n"] for r in rows.groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("n")).collect()} or {0: 0}  # one row for each length
    return reduce(DataFrame.unionByName, [run(rows.filter(F.size("vec") == d), n, d) for d, n in sorted(lengths.items())])


def vectors(column: pa.Array, d: int) -> np.ndarray:
    """Rows of an Arrow list column, each of length ``d``, as doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), d).astype(np.float64)


def packed(rows: DataFrame, n_rows: int, d: int, size: int, pack: Callable[[np.ndarray, np.ndarray], bytes]) -> DataFrame:
    """(part, path): ``rows`` (id, vec) dealt evenly, each part packed into one file. Rows are
    dealt in turn, not by a key, so repeated ids can't fill one part. A task that is run
    again writes a file of its own, and the lost one's path is nowhere."""
    parts, folder = max(1, -(-n_rows // size)), new_path(rows.sparkSession, "blocks")
    store, root = filesystem(folder)
    store.create_dir(root, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column(0).to_numpy(), vectors(b.column(1), d)) for b in batches if b.num_rows]
        if got:
            ids, vecs = np.concatenate([x[0] for x in got]), np.concatenate([x[1] for x in got])
            order = np.argsort(ids, kind="stable")
            store, root = filesystem(folder)
            name = f"{uuid.uuid4().hex}.npz"
            with store.open_output_stream(f"{root}/{name}") as out:
                out.write(pack(ids[order], vecs[order]))
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"])], names=["path"])

    files = staged(rows.repartition(parts).mapInArrow(run, "path string"), "block-paths")
    # One row for each block: numbered from 0, which deals blocks to slabs evenly.
    return files.select((F.row_number().over(Window.orderBy("path")) - 1).alias("part"), "path")


def fetch(path: str) -> dict[str, np.ndarray]:
    store, file = filesystem(path)
    with store.open_input_stream(file) as f:
        return load(f.read())


def search(index: DataFrame, queries: DataFrame, k: int, blocks: int, groups: int, scan: Callable[[dict, dict], Iterator[tuple[np.ndarray, np.ndarray]]], score_type: T.DataType) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` greatest scores of each query, ties to the
    smaller id. ``scan(block, group)`` yields for each query of the group the ids and
    scores of the block's best rows, at most ``k`` and without the query's own id."""
    per_slab = min(MAX_BLOCKS_IN_SLAB, max(1, blocks // 8))
    slabs = -(-blocks // per_slab)
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select(F.col("part").alias("grp"), numbers(slabs).alias("slab"), F.lit(0).alias("kind"), F.lit(0).alias("place"), "path")
    right = index.select(numbers(groups).alias("grp"), F.floor(F.col("part") / per_slab).cast("int").alias("slab"), F.lit(1).alias("kind"), F.col("part").alias("place"), "path")
    kind = pa.float64() if isinstance(score_type, T.DoubleType) else pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group, best = None, None, None
        for batch in batches:
            for i in range(batch.num_rows):
                grp, slab, what = (batch.column(c)[i].as_py() for c in range(3))
                if what == 0:
                    yield from flush(now, group, best)
                    now, group = (grp, slab), fetch(batch.column(4)[i].as_py())
                    best = [(np.zeros(0, np.int64), np.zeros(0))] * len(group["ids"])
                elif now == (grp, slab):
                    for q, (ids, scores) in enumerate(scan(fetch(batch.column(4)[i].as_py()), group)):
                        if len(ids):
                            ids, scores = (np.concatenate(x) for x in zip(best[q], (ids, scores), strict=True)) if len(best[q][0]) else (ids, scores)
                            order = np.lexsort((ids, -scores))[:k]
                            best[q] = (ids[order], scores[order])
        yield from flush(now, group, best)

    def flush(now, group, best) -> Iterator[pa.RecordBatch]:
        if now is None:
            return
        n = [len(b[0]) for b in best]
        if sum(n):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat([now[0]], sum(n)).astype(np.int32)), pa.array(np.repeat(np.arange(len(n)), n).astype(np.int32)), pa.array(np.repeat(group["ids"], n)), pa.array(np.concatenate([b[0] for b in best])), pa.array(np.concatenate([b[1] for b in best if len(b[0])]).astype(kind.to_pandas_dtype()))],
                names=["grp", "number", "query_id", "vec_id", "score"],
            )

    schema = T.StructType([T.StructField("grp", T.IntegerType()), T.StructField("number", T.IntegerType()), T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", score_type)])
    n = min(groups * slabs, MAX_TASKS)
    unit = F.pmod(F.col("grp").cast("long") * slabs + F.col("slab"), F.lit(n)).cast("int")
    found = left.unionByName(right).repartitionById(n, unit).sortWithinPartitions("grp", "slab", "kind", "place").mapInArrow(run, schema)
    by_score = Window.partitionBy("grp", "number").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def is_query(every: int) -> Column:
    return F.col("id") % every == 0
