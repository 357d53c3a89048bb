"""Operator 5, n-gram Jaccard join: an exact metric-space join of word-shingle sets.

Jaccard distance is a metric, so distances to pivots bound the distance of two documents.

1. Equal sets are one node.
2. Distances between unrelated documents are all 1, where no pivot tells anything apart. So the join starts from
   the regions of single shingles: in any order of all shingles, two sets within the radius share one of the
   first |X| - ceil(t |X|) + 1 of each. The region of a shingle holds the nodes that have it there, each with the
   largest partner that its place allows if the shingle is the first one shared. Shingles of many documents come
   last in the order, so that nodes with many shingles of their own never enter the regions of common ones.
3. Regions join recursively. In the first turn, one document of each region is the pivot: the one whose place
   leaves the most room, which is the original among its copies. Nodes within the radius of it are linked.
4. A region whose nodes are all connected is done. Where few nodes are outside the largest component, all of them
   become pivots, and nothing is left. In others, several documents become pivots, and their distances to all nodes
   make Voronoi cells: a node belongs to the cell of its nearest pivot, and visits the cells of a smaller number
   whose pivot is no more than twice the radius farther (by the triangle inequality, a link between two cells
   joins a node to a visitor of its own cell). Two visitors need no test. Cells are regions of the next turn; where
   cells would hardly be smaller than their region, the region stays whole and takes more pivots.

Pairs inside one component are never compared, so a group of copies costs as many comparisons as it has nodes,
not their square.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import batch_shingles, drop, release, save, slices, table, text_bytes
from .components import components

_CHUNK = 4_000_000


def text_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    out = []
    for s in batch_shingles(texts, n):
        s = np.sort(s)
        out.append(s[np.append(True, s[1:] != s[:-1])] if len(s) else s)
    return out


def _node(shingles: np.ndarray) -> int | None:
    return int(np.uint64(xxh3_64_intdigest(shingles.tobytes())).view(np.int64)) if len(shingles) else None


_DOC = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.int64()), ("shingle", pa.int64()), ("times", pa.int64())])


def _scan(docs: DataFrame, n: int) -> DataFrame:
    """A row for each document, and rows (shingle, times) of those that a task found in several nodes."""

    def frequent(sets: dict[int, np.ndarray]) -> pa.RecordBatch:
        found, times = np.unique(np.concatenate(list(sets.values())), return_counts=True)
        found, times = found[times > 1].view(np.int64), times[times > 1]
        none = pa.nulls(len(found), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, none, none, pa.array(found), pa.array(times)], schema=_DOC)

    def scan(batches):
        sets, held = {}, 0
        for batch in slices(batches):
            sizes, nodes = [], []
            for s in text_sets(text_bytes(batch.column("text")), n):
                node = _node(s)
                sizes.append(len(s))
                nodes.append(node)
                if node is not None and node not in sets:
                    sets[node] = s
                    held += len(s)
            none = pa.nulls(len(sizes), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), none, none], schema=_DOC)
            if held > _CHUNK:
                yield frequent(sets)
                sets, held = {}, 0
        if sets:
            yield frequent(sets)

    return docs.mapInArrow(scan, "rid long, doc_id long, n_shingles long, node long, shingle long, times long")


def _prefixes(docs: DataFrame, n: int, percent: int, common: np.ndarray, levels: np.ndarray) -> DataFrame:
    """Rows (pivot, node, place) of each node's first shingles, common ones last; and a row (node, size, last, bits)
    of each node: its size, its last pivot, and a bitmap of its pivots."""
    schema = pa.schema([("pivot", pa.int64()), ("node", pa.int64()), ("place", pa.int32()), ("size", pa.int32()), ("last", pa.int64()), ("bits", pa.binary())])
    shared = docs.sparkSession.sparkContext.broadcast((common, levels))  # at most COMMON_MOST entries

    def scan(batches):
        common_, levels_ = shared.value
        seen: set[int] = set()
        for batch in slices(batches):
            pivots, nodes, places, about = [], [], [], []
            for s in text_sets(text_bytes(batch.column("text")), n):
                node = _node(s)
                if node is None or node in seen:
                    continue
                if len(seen) < 1_000_000:
                    seen.add(node)
                order = s >> np.uint64(6)
                if len(common_):
                    at = np.minimum(np.searchsorted(common_, s), len(common_) - 1)
                    order = order | (np.where(common_[at] == s, levels_[at], 0).astype(np.uint64) << np.uint64(58))
                k = len(s) - -(-percent * len(s) // 100) + 1
                own = np.sort(np.partition(order, k - 1)[:k] if k < len(s) else order)
                bits = np.zeros(64 << int(len(own) // 8).bit_length(), dtype=bool)  # over 8 bits a pivot
                bits[own & np.uint64(len(bits) - 1)] = True
                pivots.append(own)
                nodes.append(np.full(len(own), node, dtype=np.int64))
                places.append(np.arange(1, len(own) + 1, dtype=np.int32))
                about.append((node, len(s), int(own[-1]), np.packbits(bits).tobytes()))
            if pivots:
                pivots, nodes = np.concatenate(pivots).view(np.int64), np.concatenate(nodes)
                none = [pa.nulls(len(nodes), t) for t in schema.types[3:]]
                yield pa.RecordBatch.from_arrays([pa.array(pivots), pa.array(nodes), pa.array(np.concatenate(places)), *none], schema=schema)
                node, *rest = zip(*about, strict=True)
                cols = [pa.nulls(len(about), pa.int64()), pa.array(node), pa.nulls(len(about), pa.int32())]
                yield pa.RecordBatch.from_arrays([*cols, *(pa.array(c, t) for c, t in zip(rest, schema.types[3:], strict=True))], schema=schema)

    return docs.mapInArrow(scan, "pivot long, node long, place int, size int, last long, bits binary")


def _sets(docs: DataFrame, n: int) -> DataFrame:
    def scan(batches):
        for batch in slices(batches):
            sets = [s.view(np.int64) for s in text_sets(text_bytes(batch.column("text")), n)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.list_(pa.int64()))], names=["node", "set"])

    return docs.mapInArrow(scan, "node long, set array<long>")


def _possible(pairs: DataFrame, about: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) less those that cannot be linked, as their first shingles prove.

    Of the node whose pivots end first, all shingles up to there are known; the two share no more of these than
    their bitmaps (and the pivots lost in one) allow, and no more of the others than that node has.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    cols = ("size", "last", "bits")
    both = pairs.join(about.select(F.col("node").alias("a"), *(F.col(c).alias(f"{c}_a") for c in cols)), "a")
    both = both.join(about.select(F.col("node").alias("b"), *(F.col(c).alias(f"{c}_b") for c in cols)), "b")
    both = both.where(100 * F.least("size_a", "size_b") >= percent * F.greatest("size_a", "size_b"))

    def bound(a: bytes, b: bytes, k_a: int, k_b: int) -> int:
        """How many pivots two nodes share at most."""
        x, y = np.frombuffer(a, dtype=np.uint8), np.frombuffer(b, dtype=np.uint8)
        # places are low bits of the pivot, so that halves of the longer map lie on the shorter one
        while len(x) > len(y):
            x = x[: len(x) // 2] | x[len(x) // 2 :]
        while len(y) > len(x):
            y = y[: len(y) // 2] | y[len(y) // 2 :]
        lost = min(k_a - int(np.bitwise_count(x).sum()), k_b - int(np.bitwise_count(y).sum()))
        return int(np.bitwise_count(x & y).sum()) + lost

    def test(batches):
        for batch in batches:
            size, last = ([batch.column(f"{c}_{x}").to_pylist() for x in "ab"] for c in ("size", "last"))
            bits = [batch.column(f"bits_{x}").to_pylist() for x in "ab"]
            fine = []
            for n_a, n_b, l_a, l_b, b_a, b_b in zip(*size, *last, *bits, strict=True):
                k_a, k_b = (n - -(-percent * n // 100) + 1 for n in (n_a, n_b))
                rest = n_a - k_a if l_a <= l_b else n_b - k_b
                need = percent * (n_a + n_b) / (100 + percent)
                fine.append(min(k_a, k_b) + rest >= need and (rest >= need or bound(b_a, b_b, k_a, k_b) + rest >= need))
            fine = pa.array(fine, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(fine), batch.column("b").filter(fine)], schema=schema)

    return both.select("a", "b", *(f"{c}_{x}" for c in cols for x in "ab")).mapInArrow(test, "a long, b long")


#: Length of the list of common shingles that tasks get; it only orders them, so results don't depend on it.
COMMON_MOST = 1 << 18
#: Regions with so many nodes outside their largest component are compared as a whole; others first take so many pivots.
_FEW, _CELLS = 128, 16
#: Comparisons of one large region in one turn, about; and rows of a region that meet its pivots in one task.
_TURN, _PIECE = 2_000_000, 1024


def _compare(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, distance, linked) of pairs (a, b)."""
    one = sets.select(F.col("node").alias("b"), F.col("set").alias("set_b"))
    two = sets.select(F.col("node").alias("a"), F.col("set").alias("set_a"))
    met = F.size(F.array_intersect("set_a", "set_b"))
    union = F.size("set_a") + F.size("set_b") - F.col("met")
    return (
        pairs.join(one, "b").join(two, "a").withColumn("met", met)
        .select("a", "b", (1 - F.col("met") / union).alias("distance"), (100 * F.col("met") >= percent * union).alias("linked"))
    )


def _open(regions: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Rows of regions that still have work, with comp (of labels, else the node itself) and size of the region.

    A node goes where nobody in its region is small enough for it, or it is too large for everybody.
    """
    rows = regions.withColumn("comp", F.col("node"))
    if labels is not None:
        rows = regions.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    limits = rows.groupBy("region").agg(F.min("n").alias("least"), F.max("most").alias("roof"))
    rows = rows.join(limits, "region").where("most >= least and n <= roof").drop("least", "roof")
    sizes = rows.groupBy("region").agg(F.count("*").alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("own").alias("any_own"))
    return rows.join(sizes.where("lo != hi and any_own").select("region", "size"), "region")


def _pivots(rows: DataFrame, turn: int) -> DataFrame:
    """(region, pivot, pivot_comp, pivot_n, pivot_most, size, wide) of open rows; each is compared with its region.

    Large groups mostly fall together around a few pivots, so the number of those in wide regions grows from turn to
    turn. They are the first by hash of as many parts of the region, so that no region is sorted or gathered.
    """
    if turn == 1:
        # the node whose place leaves the most room has the fewest shingles of its own
        first = F.min(F.struct((F.col("n") / F.col("most")).alias("room"), F.xxhash64("node").alias("h"), "node", "comp", "n", "most"))
        found = rows.groupBy("region").agg(first.alias("p"), F.first("size").alias("size")).select("region", "p.node", "p.comp", "p.n", "p.most", "size", F.lit(False))
    else:
        counts = rows.groupBy("region", "comp").agg(F.count("*").alias("k"))
        largest = counts.groupBy("region").agg(F.max(F.struct("k", "comp")).alias("big"))
        outside = rows.join(largest, "region").where("comp != big.comp")
        outside = outside.select("region", "node", "comp", "n", "most", "size", (F.col("size") - F.col("big.k") > _FEW).alias("wide"))
        parts = F.least(F.lit(_CELLS * 4 ** (turn - 2)), F.greatest(F.lit(_CELLS), (F.lit(_TURN) / F.col("size")).cast("long")))
        some = (
            outside.where("wide")
            .groupBy("region", F.pmod(F.xxhash64("node"), parts).alias("part"))
            .agg(F.min(F.struct(F.xxhash64("node", F.lit(7)).alias("h"), "node", "comp", "n", "most")).alias("p"), F.first("size").alias("size"))
        )
        found = outside.where("not wide").unionByName(some.select("region", "p.node", "p.comp", "p.n", "p.most", "size", F.lit(True).alias("wide")))
    return found.toDF("region", "pivot", "pivot_comp", "pivot_n", "pivot_most", "size", "wide")


def _meet(rows: DataFrame, pivots: DataFrame) -> DataFrame:
    """Rows of regions beside each pivot of their region; a large region meets copies of its pivots in many pieces."""
    pieces = lambda size: F.ceil(size / _PIECE).cast("long")
    dealt = rows.withColumn("piece", F.pmod(F.xxhash64("node"), pieces(F.col("size"))))
    copied = pivots.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), pieces(F.col("size")) - 1))).drop("size")
    return dealt.join(copied, ["region", "piece"]).drop("piece")


def _cells(rows: DataFrame, pivots: DataFrame, tested: DataFrame, radius: float, turn: int) -> DataFrame:
    """Regions of the next turn: Voronoi cells of the pivots in wide regions, less the pivots, which are done."""
    pivots = pivots.where("wide")
    done = pivots.select("region", F.col("pivot").alias("node"))
    rest = rows.join(pivots.select("region").distinct(), "region").join(done, ["region", "node"], "left_anti").drop("comp")
    met = _meet(rest.select("region", "node", "size"), pivots.select("region", "pivot", "size"))
    met = met.withColumns({"a": F.least("pivot", "node"), "b": F.greatest("pivot", "node")}).join(tested.select("a", "b", "distance"), ["a", "b"])
    away = F.struct(F.col("distance").alias("d"), F.col("pivot").alias("p"))
    cells = met.groupBy("region", "node").agg(F.min(away).alias("near"), F.collect_list(away).alias("all"))
    visited = F.filter("all", lambda x: (x["p"] < F.col("near.p")) & (x["d"] <= F.col("near.d") + 2 * radius + 1e-9))
    cells = rest.join(cells.select("region", "node", F.col("near.p").alias("home"), F.transform(visited, lambda x: x["p"]).alias("visits")), ["region", "node"])
    load = cells.groupBy("region").agg((F.sum(F.size("visits")) <= F.count("*")).alias("split"))
    cells = cells.join(load, "region")
    split = cells.where("split").select("region", "node", "n", "most", F.explode(F.concat(F.array("home"), "visits")).alias("cell"), "home")
    split = split.select(F.xxhash64("region", "cell", F.lit(turn)).alias("region"), "node", "n", "most", (F.col("cell") == F.col("home")).alias("own"))
    return split.unionByName(cells.where("not split").select("region", "node", "n", "most", "own"))


def _join_regions(regions: DataFrame, about: DataFrame, sets_of, percent: int) -> DataFrame:
    """Links (a, b) that connect all nodes which chains of links inside regions (region, node, n, most) connect.

    sets_of: a function (nodes) -> their shingle sets (node, set).
    """
    spark, radius = regions.sparkSession, 1 - percent / 100
    regions = regions.withColumn("own", F.lit(True))
    tested: DataFrame | None = None
    sets: DataFrame | None = None
    labels: DataFrame | None = None
    turn = 0
    while True:
        turn += 1
        rows = save(_open(regions, labels), "region-rows")
        pivots = save(_pivots(rows, turn), "region-pivots")
        if not pivots.take(1):
            return spark.createDataFrame([], "a long, b long") if tested is None else tested.where("linked").select("a", "b")
        # in wide regions all distances are wanted, for the cells
        fits = (F.col("comp") != F.col("pivot_comp")) & (F.col("n") <= F.col("pivot_most")) & (F.col("pivot_n") <= F.col("most"))
        pairs = (
            _meet(rows, pivots)
            .where("node != pivot").where(F.col("wide") | fits)
            .select(F.least("pivot", "node").alias("a"), F.greatest("pivot", "node").alias("b"), F.col("wide").alias("all"))
            .groupBy("a", "b").agg(F.max("all").alias("all"))
        )
        if tested is not None:
            pairs = pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti")
        pairs = save(pairs, "pairs-met")
        pairs = save(_possible(pairs.where("not all"), about, percent).unionByName(pairs.where("all").select("a", "b")), "possible-pairs")
        nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        if sets is not None:
            nodes = save(nodes.join(sets.select("node"), "node", "left_anti"), "set-nodes")
        if sets is None or nodes.take(1):
            more = save(sets_of(nodes), "sets")
            sets = more if sets is None else sets.unionByName(more)
            release(spark)
        new = save(_compare(pairs, sets, percent), "pairs")
        tested = new if tested is None else tested.unionByName(new)
        labels = components(tested.where("linked").select("a", "b"))
        if turn == 1:
            regions = rows.select("region", "node", "n", "most", "own")
        else:
            regions = save(_cells(rows, pivots, tested, radius, turn), "regions")
        release(spark)


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles and component_id of docs (doc_id, text) under links of at least percent similarity.

    A set holds the distinct n-word shingles of the text with A-Z lower-cased; a shorter text is one
    shingle. Empty or null texts have none and link with nothing. Rows with the same id are rows of their
    own; a null id counts only where no other row of the component has an id. An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scanned = save(_scan(rows, n), "shingle-sets")
    nodes = scanned.where("times is null").select("rid", "doc_id", "n_shingles", "node")
    times = save(scanned.where("times is not null").groupBy("shingle").agg(F.sum("times").alias("times")), "common-shingles")
    # one row for each number of times, from which the smallest follows that leaves COMMON_MOST shingles
    kinds = sorted(((r["times"], r["n"]) for r in times.groupBy("times").agg(F.count("*").alias("n")).collect()), reverse=True)
    most = np.cumsum([n for _, n in kinds])
    enough = int(np.searchsorted(most, COMMON_MOST, "right"))
    least = kinds[enough - 1][0] if enough else (kinds[0][0] + 1 if kinds else 0)
    ranked = times.where(F.col("times") >= least).toPandas()
    drop(times)
    ranked = ranked.assign(shingle=ranked["shingle"].to_numpy(dtype=np.int64).view(np.uint64)).sort_values("shingle")
    levels = np.minimum(np.log2(np.maximum(ranked["times"].to_numpy(dtype=np.float64), 1)).astype(np.int64), 31)
    prefixes = save(_prefixes(rows, n, percent, ranked["shingle"].to_numpy(dtype=np.uint64), levels), "prefixes")
    pivots = prefixes.where("pivot is not null").select("pivot", "node", "place")
    shared = save(pivots.groupBy("pivot").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo != hi").select("pivot"), "shared-pivots")
    release(spark)
    # tasks that met a node each gave its rows
    met = save(pivots.join(shared, "pivot", "left_semi").groupBy(F.col("pivot").alias("region"), "node").agg(F.min("place").alias("place")), "regions")
    release(spark)
    about = save(
        prefixes.where("pivot is null").join(met.select("node").distinct(), "node", "left_semi").groupBy("node").agg(*(F.min(c).alias(c) for c in ("size", "last", "bits"))), "nodes"
    )
    drop(prefixes, shared)
    release(spark)
    # a pair whose first shared shingle is at this place shares what comes from there on; the size of a partner follows
    most = F.floor((F.col("n") - F.col("place") + 1) * (100 + percent) / percent + 1e-9) - F.col("n")
    regions = met.join(about.select("node", F.col("size").alias("n")), "node").select("region", "node", "n", most.cast("int").alias("most"))
    owners = save(nodes.where("node is not null").groupBy("node").agg(F.min("rid").alias("rid")), "owners")
    links = _join_regions(regions, about, lambda own: _sets(rows.select("rid", "text").join(owners.join(own, "node"), "rid").select("node", "text"), n), percent)
    labels = components(links).withColumnRenamed("comp", "root")
    rooted = nodes.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = rooted.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rooted.join(smallest, "root", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one_of_each(docs: DataFrame, n: int = 5, percent: int = 75) -> DataFrame:
    """docs without the documents that are linked, directly or by others, with one of a smaller id.

    Documents without words stay. Rows of one id stay or go together; rows with a null id stay.
    """
    found = jaccard_components(docs, n, percent)
    gone = save(found.where("doc_id != component_id").select("doc_id").distinct(), "copies")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents at 75 % of five-word shingles."""
    return jaccard_components(table(spark, sf_dir, "documents"))
