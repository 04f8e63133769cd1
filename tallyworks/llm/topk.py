"""Exact top-k search by inner products of integer vectors.

Vectors are packed into tiles: shards of all rows and blocks of queries. Shards and query blocks meet
on a grid of cells, so neither side is copied to more than one row or column of the grid; in a cell
every pair of tiles is one matrix product, from which each query keeps its best ``k``. The lists of a
query are then merged in rounds, ``FAN`` cells at a time.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a tile.
TILE = 2048
#: Lists of a query merged at a time.
FAN = 16
#: Factor from components to integers.
SCALE = 256

_TILE = "dim int, tile long, ids binary, vectors binary"
_TILE_ARROW = pa.schema([("dim", pa.int32()), ("tile", pa.int64()), ("ids", pa.binary()), ("vectors", pa.binary())])
_LIST = "query_id long, cell int, vec_id long, score long"
_LIST_ARROW = pa.schema([("query_id", pa.int64()), ("cell", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])

_EXACT = float(1 << 53)
_LONG = (1 << 63) - 1


def _pack(batches):
    """Rows (vec_id, embedding) to tiles of vectors of one length."""
    held: dict[int, tuple[list, list]] = {}

    def tile(dim: int) -> pa.RecordBatch:
        ids, vectors = held.pop(dim)
        order = np.argsort(np.array(ids, np.int64), kind="stable")
        ids = np.array(ids, np.int64)[order]
        values = np.array(vectors, np.float64).reshape(len(ids), dim)[order]
        row = [[dim], [int(ids[0])], [ids.tobytes()], [np.floor(SCALE * values).tobytes()]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(row, _TILE_ARROW)], schema=_TILE_ARROW)

    for batch in batches:
        for vec_id, vector in zip(batch.column("vec_id").to_pylist(), batch.column("embedding").to_pylist()):
            ids, vectors = held.setdefault(len(vector), ([], []))
            ids.append(vec_id)
            vectors.append(vector)
            if len(ids) == TILE:
                yield tile(len(vector))
    for dim in list(held):
        yield tile(dim)


def scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Integer inner products. Sums beyond 64 bits stand at the nearest end of the range."""
    bound = np.abs(queries).max(initial=0) * np.abs(vectors).max(initial=0) * queries.shape[1]
    if bound < _EXACT:
        return (queries @ vectors.T).astype(np.int64)
    whole = [[int(x) for x in row] for row in vectors]
    out = [[sum(int(a) * b for a, b in zip(query, row)) for row in whole] for query in queries]
    return np.array([[max(-_LONG, min(_LONG, s)) for s in row] for row in out], np.int64).reshape(len(queries), len(vectors))


def best(query_ids, queries, ids, vectors, k: int):
    """The ``k`` best rows of a tile for each query: arrays of query ids, row ids and scores. ``ids`` ascend."""
    found = scores(queries, vectors)
    own = query_ids[:, None] == ids[None, :]
    number = min(k, len(ids))
    picked = []
    for row, skip in zip(found, own):
        if number < len(row):
            # Everything above the k-th best score, then ties with it in order of ids.
            order = np.argpartition(-row, min(len(row) - 1, number + int(skip.sum()) - 1))
            least = row[order[min(len(row), number + int(skip.sum())) - 1]]
            order = np.flatnonzero(row >= least)
        else:
            order = np.arange(len(row))
        order = order[~skip[order]]
        picked.append(order[np.argsort(-row[order], kind="stable")][:k])
    sizes = [len(p) for p in picked]
    where = np.concatenate(picked) if picked else np.zeros(0, np.int64)
    line = np.repeat(np.arange(len(query_ids)), sizes)
    return query_ids[line], ids[where], found[line, where]


def _search(k: int):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                dim = row["dim"]
                ids, query_ids = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["query_ids"], np.int64)
                vectors = np.frombuffer(row["vectors"], np.float64).reshape(len(ids), dim)
                queries = np.frombuffer(row["queries"], np.float64).reshape(len(query_ids), dim)
                found = best(query_ids, queries, ids, vectors, k)
                columns = [found[0], np.full(len(found[0]), row["cell"], np.int32), found[1], found[2]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=_LIST_ARROW)

    return run


def _valid(vector: str) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(vector).isNotNull() & finite


def _merge(lists: DataFrame, k: int, *keys: str) -> DataFrame:
    order = Window.partitionBy("query_id", *keys).orderBy(F.desc("score"), "vec_id")
    return lists.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: Column, k: int) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` of the ``k`` best rows for every query.

    ``vectors`` has vec_id and embedding; other columns are ignored. Components are scaled by ``SCALE``
    and floored. Every row with another vec_id and a vector of the same length is a candidate; ties go to the smaller vec_id.
    Rows with a null id, a null vector or a null or non-finite component take no part. Repeated rows are
    candidates each; queries that share an id share one list. No rows give no result.
    """
    rows = vectors.select(
        F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"), is_query.alias("asks")
    ).filter(F.col("vec_id").isNotNull() & _valid("embedding"))
    counted = rows.agg(F.count("*").alias("rows"), F.count_if("asks").alias("asking")).first()
    cells = 2 * vectors.sparkSession.sparkContext.defaultParallelism
    lines = max(1, round(math.sqrt(cells * counted.asking / max(1, counted.rows))))
    columns = min(math.ceil(cells / lines), max(1, math.ceil(counted.rows / TILE)))
    shards = rows.select("vec_id", "embedding").mapInArrow(_pack, _TILE)
    blocks = rows.filter("asks").select("vec_id", "embedding").mapInArrow(_pack, _TILE)
    column = F.pmod(F.xxhash64("tile", "ids"), F.lit(columns)).cast("int")
    line = F.pmod(F.xxhash64("tile", "ids"), F.lit(lines)).cast("int")
    shards = shards.select("*", column.alias("cell"), F.explode(F.sequence(F.lit(0), F.lit(lines - 1))).alias("line"))
    blocks = blocks.select(
        "dim",
        F.col("ids").alias("query_ids"),
        F.col("vectors").alias("queries"),
        line.alias("line"),
        F.explode(F.sequence(F.lit(0), F.lit(columns - 1))).alias("cell"),
    )
    paired = shards.join(blocks, ["dim", "cell", "line"])
    lists = paired.select("dim", "cell", "ids", "vectors", "query_ids", "queries").mapInArrow(_search(k), _LIST)
    while columns > 1:
        columns = math.ceil(columns / FAN)
        lists = _merge(lists.withColumn("cell", F.floor(F.col("cell") / FAN).cast("int")), k, "cell").drop("rank")
    return _merge(lists, k).select("query_id", "rank", "vec_id", "score")
