"""Operator 11, approximate nearest neighbours: an inverted multi-index.

The two halves of each vector are quantised by codebooks of their own, so that a pair of centroids is a cell. A query
goes through the cells by the sum of its halves' distances to their centroids, taken from a heap, until they hold enough
candidates, which are then ranked by their true distances. How many are enough is measured: a few queries are answered
from all rows, and the budget is the number of candidates after which their neighbours were met with the recall asked.

Rows with one vector are one entry of the index that carries its smallest ids, so that copies, however many, are
searched once. Cells are packed into tiles of a bounded size, a large cell into several; a task ranks one block of
queries against one tile.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop, save, slices, table

#: Entries of a tile at least and at most, queries of a block, and distances that a task holds at once. A tile tells
#: k rows of each query, so that tiles of a few entries would tell more than they hold.
_LEAST, _TILE, _BLOCK, _HELD = 1 << 11, 1 << 16, 1 << 17, 1 << 22


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def _to_centroids(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2 * x @ centroids.T + (centroids * centroids).sum(axis=1)


def _codebook(x: np.ndarray, words: int, rounds: int = 15) -> np.ndarray:
    """Centroids by Lloyd's rounds, from rows spread over the sample; an empty centroid stays where it is."""
    centroids = x[np.random.default_rng(11).permutation(len(x))[:words]].copy()
    for _ in range(rounds):
        nearest = _to_centroids(x, centroids).argmin(axis=1)
        n = np.bincount(nearest, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, x)
        centroids[n > 0] = sums[n > 0] / n[n > 0, None]
    return centroids


class Codebooks:
    """Two codebooks, one for each half."""

    def __init__(self, x: np.ndarray, words: int):
        self.cut = x.shape[1] // 2
        self.halves = [_codebook(x[:, : self.cut], words), _codebook(x[:, self.cut :], words)]
        self.words = len(self.halves[1])

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _to_centroids(x[:, : self.cut], self.halves[0]), _to_centroids(x[:, self.cut :], self.halves[1])

    def cells(self, x: np.ndarray) -> np.ndarray:
        first, second = self.distances(x)
        return first.argmin(axis=1) * self.words + second.argmin(axis=1)


def cells_in_order(first: np.ndarray, second: np.ndarray):
    """Pairs of centroids by the sum of their distances, each once: the heap holds one pair for each row begun."""
    o1, o2 = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    a, b, words = first[o1].tolist(), second[o2].tolist(), len(second)
    names1, names2 = (o1 * words).tolist(), o2.tolist()
    heap = [(a[0] + b[0], 0, 0)]
    while heap:
        _, i, j = heapq.heappop(heap)
        yield names1[i] + names2[j]
        if j + 1 < words:
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))


class Tiles:
    """Which tiles hold a cell: neighbours in number share one, a cell over the size has several."""

    def __init__(self, counts: dict[int, int], cells: int, size: int):
        self.counts = np.zeros(cells, dtype=np.int64)
        self.first, self.splits = np.zeros(cells, dtype=np.int32), np.ones(cells, dtype=np.int32)
        tile = held = 0
        for cell in sorted(counts):
            n = self.counts[cell] = counts[cell]
            if held and held + n > size:
                tile, held = tile + 1, 0
            self.first[cell], self.splits[cell] = tile, max(1, -(-n // size))
            if n > size:
                tile, held = tile + int(self.splits[cell]), 0
            else:
                held += n


def _assigned(books):
    def run(batches):
        for batch in slices(batches, 4096):
            cells = books.value.cells(_matrix(batch.column("vec")))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.int32())], [*batch.schema.names, "cell"])

    return run


def _visiting(books, tiles, budget: int):
    """(q, vec, block) -> (tile, block, q, vec, cells): the cells to be searched, tile by tile."""

    def run(batches):
        held = tiles.value
        for batch in slices(batches, 1024):
            x, rows, tile_of, cells_of = _matrix(batch.column("vec")), [], [], []
            first, second = books.value.distances(x)
            for i in range(len(x)):
                cells, found = [], 0
                for cell in cells_in_order(first[i], second[i]):
                    if n := held.counts[cell]:
                        cells.append(cell)
                        found += n
                        if found >= budget:
                            break
                cells = np.array(cells, dtype=np.int32)
                splits = held.splits[cells]
                spread = np.repeat(cells, splits)
                at = held.first[spread] + np.arange(len(spread)) - np.repeat(np.cumsum(splits) - splits, splits)
                order = np.argsort(at, kind="stable")
                names, starts = np.unique(at[order], return_index=True)
                tile_of += names.tolist()
                cells_of += np.split(spread[order], starts[1:])
                rows += [i] * len(names)
            taken = batch.take(pa.array(rows, pa.int64()))
            offsets = np.concatenate([[0], np.cumsum([len(c) for c in cells_of])])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(cells_of) if cells_of else [], pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(tile_of, pa.int32()), *(taken.column(c) for c in ("block", "q", "vec")), lists], ["tile", "block", "q", "vec", "cells"])

    return run


def _ranked(k: int):
    """A tile's entries and the queries that search it: the k nearest entries of each, of the cells it goes through."""

    def run(entries: pa.Table, asked: pa.Table) -> pa.Table:
        out = {"q": [], "dist": [], "cls": [], "ids": [], "cell": []}
        if entries.num_rows and asked.num_rows:
            cell = entries.column("cell").to_numpy()
            order = np.argsort(cell, kind="stable")
            entries, cell = entries.take(pa.array(order)), cell[order]
            x, q = _matrix(entries.column("vec")), _matrix(asked.column("vec"))
            cls, ids, names = entries.column("cls").to_numpy(), entries.column("ids"), asked.column("q").to_pylist()
            present, starts = np.unique(cell, return_index=True)
            stops = np.append(starts[1:], len(cell))
            squares = (x * x).sum(axis=1)
            lists = asked.column("cells").combine_chunks()
            wanted, offsets = lists.flatten().to_numpy(), np.asarray(lists.offsets) - lists.offsets[0].as_py()
            step = max(1, _HELD // len(x))
            for at in range(0, len(q), step):
                some = q[at : at + step]
                asks = np.zeros((len(some), len(present)), dtype=bool)
                row = np.repeat(np.arange(len(some)), np.diff(offsets[at : at + len(some) + 1]))
                names_asked = wanted[offsets[at] : offsets[at + len(some)]]
                column = np.minimum(np.searchsorted(present, names_asked), len(present) - 1)
                there = present[column] == names_asked  # a split cell may have no entry in this tile
                asks[row[there], column[there]] = True
                close = np.full((len(some), len(x)), np.inf)
                for c in np.flatnonzero(asks.any(axis=0)):
                    rows = np.flatnonzero(asks[:, c])
                    part = slice(starts[c], stops[c])
                    close[rows, part] = squares[part] - 2 * some[rows] @ x[part].T
                least = np.partition(close, min(k, len(x)) - 1, axis=1)[:, min(k, len(x)) - 1]
                # what rounding may hide is looked at again
                slack = 1e-9 * (squares.max() + (some * some).sum(axis=1))
                for i in range(len(some)):
                    near = np.flatnonzero((close[i] <= least[i] + slack[i]) & np.isfinite(close[i]))
                    dist = np.sqrt(((x[near] - some[i]) ** 2).sum(axis=1))
                    best = np.lexsort((cls[near], dist))[:k]
                    out["q"] += [names[at + i]] * len(best)
                    out["dist"] += dist[best].tolist()
                    out["cls"] += cls[near[best]].tolist()
                    out["ids"] += ids.take(pa.array(near[best])).to_pylist()
                    out["cell"] += cell[near[best]].tolist()
        kinds = {"q": pa.int64(), "dist": pa.float64(), "cls": pa.int64(), "ids": pa.list_(pa.int64()), "cell": pa.int32()}
        return pa.table({c: pa.array(v, kinds[c]) for c, v in out.items()})

    return run


def _match(index: DataFrame, visits: DataFrame, blocks: int, k: int) -> DataFrame:
    """The k nearest entries of each query among those its cells hold: (q, dist, cls, ids, cell)."""
    entries = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))) if blocks > 1 else index.withColumn("block", F.lit(0))
    # dealt apart, so that both sides can be grouped where they are
    near = entries.groupBy("tile", "block").cogroup(visits.groupBy("tile", "block")).applyInArrow(_ranked(k), "q long, dist double, cls long, ids array<long>, cell int")
    order = Window.partitionBy("q").orderBy("dist", "cls")
    return near.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")


def nearest(
    vectors: DataFrame, every: int = 100, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", words: int = 64, recall: float = 0.97, sample: int = 20_000, probes: int = 256
) -> DataFrame:
    """The k nearest rows of each row whose id is divisible by `every`: (query_id, rank, vec_id, score).

    score is the Euclidean distance of the given vectors in double precision; equal distances go to the smaller id.
    words: centroids of each half, so that there are words * words cells. They are fitted on at most `sample` vectors,
    every row is indexed. The budget of candidates is the least at which `probes` queries (answered from all rows) meet
    `recall` of their neighbours.

    Null vectors and ids, vectors with a null or non-finite component and zero vectors take no part, nor do vectors of
    another length than the commonest (the longest of several). Rows with the same id count as one, with the smallest of
    their vectors. Rows of one vector are all found. With fewer than k other rows a query gets them all; an empty table
    gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")).where(
        F.col("id").isNotNull() & F.col("vec").isNotNull()
        & F.forall("vec", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
        & F.exists("vec", lambda x: x != 0)
    )
    saved = save(rows.groupBy("id").agg(F.min("vec").alias("vec")), "vectors")
    length = saved.groupBy(F.size("vec").alias("d")).count().orderBy(F.col("count").desc(), F.col("d").desc()).limit(1).collect()
    if not length:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    one = saved.where(F.size("vec") == length[0]["d"])
    smallest = one.withColumn("_r", F.row_number().over(Window.partitionBy("vec").orderBy("id"))).where(F.col("_r") <= k + 1)
    classes = save(smallest.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("cls", F.col("ids")[0]), "classes")
    asked = save(one.where(F.col("id") % every == 0).join(classes.select("vec", "cls"), "vec").select(F.col("id").alias("query_id"), F.col("cls").alias("q")), "asked")

    seen = classes.orderBy(F.xxhash64("cls"), "cls").limit(sample).select("vec").toArrow()  # `sample` vectors
    books = spark.sparkContext.broadcast(Codebooks(_matrix(seen.column("vec")), words))
    kind = one.schema["vec"].dataType.simpleString()
    cells = save(classes.mapInArrow(_assigned(books), f"vec {kind}, ids array<long>, cls long, cell int"), "cells")
    counts = {r["cell"]: r["n"] for r in cells.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # words * words at most
    total, parts = sum(counts.values()), max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    plan = Tiles(counts, words * words, min(_TILE, max(_LEAST, -(-total // parts))))
    tiles = spark.sparkContext.broadcast(plan)
    known = spark.createDataFrame([(c, int(plan.first[c]), int(plan.splits[c])) for c in counts], "cell int, first int, splits int")
    index = cells.join(F.broadcast(known), "cell").select("vec", "ids", "cls", "cell", (F.col("first") + F.pmod(F.xxhash64("cls"), F.col("splits"))).cast("int").alias("tile"))

    queries = classes.join(asked.select(F.col("q").alias("cls")).distinct(), "cls").select(F.col("cls").alias("q"), "vec")
    queries = save(queries, "queries")
    blocks = max(1, -(-queries.count() // _BLOCK))

    def visits(some: DataFrame, budget: int, blocks: int) -> DataFrame:
        dealt = some.withColumn("block", F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int"))
        return dealt.repartition(parts, "q").mapInArrow(_visiting(books, tiles, budget), f"tile int, block int, q long, vec {kind}, cells array<int>")

    tried = save(queries.orderBy(F.xxhash64("q"), "q").limit(probes), "probes")
    truth = _match(index, visits(tried, total, 1), 1, k + 1).where("cls <> q").select("q", "cell").collect()  # `probes` times k + 1 rows
    budget = _budget(books.value, plan, {r["q"]: np.array(r["vec"], dtype=np.float64) for r in tried.collect()}, truth, recall)

    near = _match(index, visits(queries, budget, blocks), blocks, k + 1)
    each = near.select("q", "dist", F.explode("ids").alias("id"))
    order = Window.partitionBy("q").orderBy("dist", "id")
    lists = each.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k + 1).groupBy("q").agg(F.sort_array(F.collect_list(F.struct("dist", "id"))).alias("near"))
    # one row each, less the query itself
    own = asked.join(lists, "q").select("query_id", F.slice(F.filter("near", lambda x: x["id"] != F.col("query_id")), 1, k).alias("near"))
    result = save(own.select("query_id", F.posexplode("near").alias("rank", "x")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.dist").alias("score")), "neighbours")
    drop(saved, classes, asked, cells, queries, tried)
    return result


def _budget(books: Codebooks, tiles: Tiles, vectors: dict[int, np.ndarray], truth: list, recall: float) -> int:
    """Candidates after which a share `recall` of the probes' neighbours are met."""
    wanted: dict[int, list[int]] = {}
    for r in truth:
        wanted.setdefault(r["q"], []).append(r["cell"])
    ranks = []
    for q, cells in wanted.items():
        first, second = books.distances(vectors[q][None])
        order = np.fromiter(cells_in_order(first[0], second[0]), dtype=np.int64)
        met = np.zeros(len(tiles.counts), dtype=np.int64)
        met[order] = np.cumsum(tiles.counts[order])
        ranks += met[cells].tolist()
    ranks.sort()
    return ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))) - 1)] if ranks else 1


def op11_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every hundredth vector."""
    return nearest(table(spark, sf_dir, "embeddings"))
