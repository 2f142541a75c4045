r"""Operator 9: exact top-k by inner product, columnar branch and bound.

*Numbers*: components become floor(256 * x) with x as double; sums are exact integers.

*Blocks*: rows are packed into blocks of at most ``block_rows`` vectors in vertical layout (one array for each dimension), queries
likewise. Every block of candidates meets every block of queries exactly once, in a cell of a grid (``grid``): a candidate block goes to all cells of
its row, a query block to all cells of its column. The grid has as many cells as the work asks for, at most ``cell_pairs`` pairs of blocks in a cell
on average, and the sides are chosen so that both sides together are copied least. No side has to be broadcast and no key is hot. The work is queries times rows, which the task asks for.

*Branch and bound* (``_search``): for a query, blocks of ``STEP`` dimensions are added in order of the query's mass. A candidate's score is at most
its sum so far plus the product of both vectors' remaining lengths (Cauchy-Schwarz), so candidates whose bound is below the
k-th best score known are dropped and the arrays are compacted. Before the blocks meet, each query has met the ``longest`` candidates of the whole table: its k-th best
score there is the floor that it carries to every block, so a block sends only what can still be among the k best, and whole blocks of short vectors are skipped.

Defined results: vectors that are null, empty or hold a null or non-finite component take no part, as query or candidate; a vector
meets only vectors of its own length; rows with the query's own vec_id are not its candidates, other repeated rows are; queries that repeat a
vec_id are one query, whose k best scores are those of all its vectors together; ties
go to the smaller vec_id; null vec_ids take no part; with fewer than k candidates all are returned. Sums beyond 2 ** 53 are computed with Python integers and held
to the range of long. Only the named columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STEP = 8
#: Fewest rows of the grid, so that small tables use all cores.
FEWEST = 64
_EXACT = 2.0**53


def _arrays(batch):
    """(dimension, ids, vectors) of a batch (id, vector), by dimension."""
    column = batch.column(1)
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    for d in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == d)
        yield d, ids[own], flat[(ends[own] - d)[:, None] + np.arange(d)]


def _longest(rows: int):
    """Batches (id, vector) to the longest vectors of the task: length, id, whole components."""

    def run(batches):
        best: list = []
        for batch in batches:
            for _, ids, x in _arrays(batch):
                x = np.floor(256 * x)
                length = (x * x).sum(axis=1)
                first = np.argsort(-length, kind="stable")[:rows]
                best += zip(length[first].tolist(), ids[first].tolist(), x[first].tolist(), strict=True)
            best = sorted(best, key=lambda r: (-r[0], r[1]))[:rows]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in best], pa.float64()), pa.array([r[1] for r in best], pa.int64()), pa.array([r[2] for r in best], pa.list_(pa.float64()))], ["length", "id", "vector"])

    return run


def _floors(ids: np.ndarray, q: np.ndarray, known: tuple, k: int) -> np.ndarray:
    """The k-th best score of each query (a column of q) among the known candidates; minus infinity without so many."""
    floor = np.full(len(ids), -np.inf)
    if known is None or len(known[0]) < k or len(q) * np.abs(q).max(initial=0) * np.abs(known[1]).max(initial=0) >= _EXACT:
        return floor
    score = q.T @ known[1]
    score[ids[:, None] == known[0][None, :]] = -np.inf
    return np.partition(score, -k, axis=1)[:, -k]


def _asked(rows: int, shared, k: int):
    """As ``_pack`` for queries, with the floor of each."""

    def run(batches):
        for block in _pack(rows)(batches):
            r = block.to_pylist()[0]
            ids, q = _unpack(r["d"], r["small"], r["ids"], r["data"])
            floor = _floors(ids, q, shared.value.get(r["d"]), k)
            yield pa.RecordBatch.from_arrays([*block.columns, pa.array([floor.tobytes()], pa.binary())], [*block.schema.names, "floors"])

    return run


def _pack(rows: int):
    """Batches (id, vector) to blocks: dimension, number, ids, components (a row for each dimension), as bytes."""

    def run(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for d, own, x in _arrays(batch):
                held.setdefault(d, []).append((own, x))
                while sum(len(i) for i, _ in held[d]) >= rows:
                    i, x = (np.concatenate(p) for p in zip(*held[d], strict=True))
                    held[d] = [(i[rows:], x[rows:])] if len(i) > rows else []
                    yield _block(d, i[:rows], x[:rows])
        for d, parts in held.items():
            if parts:
                yield _block(d, *(np.concatenate(p) for p in zip(*parts, strict=True)))

    return run


def _block(d: int, ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
    x = np.floor(256 * x)
    small = not x.size or np.abs(x).max() < 32768
    data = np.ascontiguousarray(x.T.astype(np.int16 if small else np.float64)).tobytes()
    return pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([small]), pa.array([ids.astype(np.int64).tobytes()], pa.binary()), pa.array([data], pa.binary())], ["d", "small", "ids", "data"])


def _unpack(d: int, small: bool, ids: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.int64), np.frombuffer(data, np.int16 if small else np.float64).reshape(d, -1).astype(np.float64)


def _exact_scores(q: np.ndarray, c: np.ndarray) -> list[int]:
    own = [int(v) for v in q]
    return [max(-(2**63), min(2**63 - 1, sum(a * int(b) for a, b in zip(own, c[:, j], strict=True)))) for j in range(c.shape[1])]


def _search(queries: tuple, candidates: tuple, k: int):
    """(query id, vec id, score) of the k best candidates of each query, by branch and bound; below a query's floor, if it has one, nothing."""
    query_ids, q, *floors = queries
    ids, c = candidates
    d = len(c)
    order = np.lexsort((ids, -(c * c).sum(axis=0)))
    ids, c = ids[order], np.ascontiguousarray(c[:, order])
    exact = d * (np.abs(q).max(initial=0) * np.abs(c).max(initial=0)) < _EXACT
    parts = [slice(i, min(i + STEP, d)) for i in range(0, d, STEP)]
    mass = np.array([(c[p] * c[p]).sum(axis=0) for p in parts])
    whole = mass.sum(axis=0)
    for j in range(q.shape[1]):
        query = q[:, j]
        if not exact:
            yield from _best(query_ids[j], ids, np.array(_exact_scores(query, c), object), k)
            continue
        own = np.array([float(query[p] @ query[p]) for p in parts])
        sequence = np.argsort(-own, kind="stable")
        first = min(len(ids), 16 * k)
        known = (query @ c[:, :first])[ids[:first] != query_ids[j]]
        least = max(np.partition(known, -k)[-k] if len(known) >= k else -np.inf, floors[0][j] if floors else -np.inf)
        left = float(own.sum())
        alive = np.flatnonzero(np.sqrt(left * whole) * (1 + 1e-9) + 1e-6 >= least)
        if not len(alive):
            continue
        score, rest = np.zeros(len(alive)), whole[alive]
        for b in sequence:
            score = score + query[parts[b]] @ (c[parts[b]] if len(alive) == len(ids) else c[parts[b]][:, alive])
            left = max(left - own[b], 0.0)
            rest = np.maximum(rest - mass[b][alive], 0)
            keep = score + np.sqrt(left * rest) * (1 + 1e-9) + 1e-6 >= least
            if not keep.all():
                alive, score, rest = alive[keep], score[keep], rest[keep]
        yield from _best(query_ids[j], ids[alive], score, k)


def _best(query_id, ids, score, k):
    other = ids != query_id
    ids, score = ids[other], score[other]
    if score.dtype != object and len(score) > 4 * k:
        near = np.flatnonzero(score >= np.partition(score, -k)[-k])
        ids, score = ids[near], score[near]
    for s, i in sorted(((-int(s), int(i)) for s, i in zip(score.tolist(), ids.tolist(), strict=True)))[:k]:
        yield int(query_id), i, -s


def _meet(k: int):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                asked = (*_unpack(row["d"], row["q_small"], row["q_ids"], row["q_data"]), np.frombuffer(row["floors"], np.float64))
                found = list(_search(asked, _unpack(row["d"], row["small"], row["ids"], row["data"]), k))
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in zip(*found, strict=True)] if found else [pa.array([], pa.int64())] * 3, ["query_id", "vec_id", "score"])

    return run


def grid(candidate_blocks: int, query_blocks: int, cell_pairs: int) -> tuple[int, int]:
    """Rows and columns: about cell_pairs pairs of blocks in a cell, and as few copies as that allows (cells near to square in blocks)."""
    cells = candidate_blocks * query_blocks / cell_pairs
    columns = min(max(round((cells * query_blocks / max(candidate_blocks, 1)) ** 0.5), 1), max(query_blocks, 1))
    return max(int(-(-cells // columns)), FEWEST), columns


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", block_rows: int = 2048, cell_pairs: int = 4096, longest: int = 1024) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of each query's k best rows."""
    one = F.col("vector")
    finite = ~F.exists(one, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    valid = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks")).where(F.col("id").isNotNull() & one.isNotNull() & (F.size(one) > 0) & finite)
    counted = valid.agg(F.count("*").alias("n"), F.count_if("asks").alias("q")).first()
    rows, columns = grid(-(-counted.n // block_rows), -(-counted.q // block_rows), cell_pairs)
    # a floor for each query from a set of ``longest`` rows: it bounds the search and leaves nothing out
    best = valid.select("id", "vector").mapInArrow(_longest(longest), "length double, id long, vector array<double>").orderBy(F.desc("length"), "id").limit(longest).collect()
    known: dict = {}
    for r in best:
        known.setdefault(len(r.vector), []).append((r.id, r.vector))
    known = {d: (np.array([i for i, _ in x]), np.array([v for _, v in x]).T) for d, x in known.items()}
    shared = vectors.sparkSession.sparkContext.broadcast(known)
    schema = "d int, small boolean, ids binary, data binary"
    candidates = valid.select("id", "vector").mapInArrow(_pack(block_rows), schema)
    asked = valid.where("asks").select("id", "vector").mapInArrow(_asked(block_rows, shared, k), f"{schema}, floors binary")
    place = lambda n: F.pmod(F.xxhash64("ids"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = asked.withColumn("column", place(columns)).select("d", "column", every(rows).alias("row"), F.col("small").alias("q_small"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), "floors")
    candidates = candidates.withColumn("row", place(rows)).withColumn("column", every(columns))
    met = candidates.join(asked, ["row", "column", "d"])
    found = met.select("d", "small", "ids", "data", "q_small", "q_ids", "q_data", "floors").mapInArrow(_meet(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([q.e[i] * c.e[i] FOR i IN range(1, len(q.e) + 1)]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
