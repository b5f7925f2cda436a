"""Approximate nearest neighbours by inner product: an NN-descent graph built
with Spark joins, and greedy search on it.

Building.  Every vector gets a list of its K nearest known others.  The lists
start from the cells of sampled pivots, each vector being in the cells of its
NEAR most similar pivots of every table (cells that would hold more than BUCKET
are split by random hyperplanes), and improve by local joins: the
vectors that meet at a centre (its neighbours and those it is a neighbour of)
are compared with each other, so neighbours of neighbours find each other; only
pairs with an edge that is new since the last round are compared.  Rounds end
when fewer than DONE of the edges change.

Inner products are turned into distances by one more coordinate
sqrt(M^2 - |x|^2), M the largest norm, so that lists are also right for
vectors of unequal length.  The squared distance is taken in doubles, the
further coordinate less M, so that one long vector does not drown the others.

Searching.  A query starts at its own vector's node, if it has one, at the
nodes of its list, at the best vectors of its 3 SEEDS nearest cells of every
table and at the SEEDS longest vectors; each hop scores the neighbours (both directions)
of the best nodes not yet expanded and keeps the best; it ends when the
best EXPAND nodes are all expanded.  How many must be expanded depends on the
vectors (clustered ones few, uniform ones of many dimensions many), so the
search measures itself: the answers of SAMPLE queries are compared with all
vectors, and while they hold less than ENOUGH of the truly nearest, all queries
go on from where they stand with twice as many nodes and seeds.  Scores are
sums of double products in coordinate order on the original vectors.

Scale: equal vectors collapse into one node first (a vector held by a third of
the rows is one node) and are expanded again at the end, up to as many least
ids as a result can use.  A centre with many reverse neighbours is dealt into
groups of about GROUP members, a cell into groups of at most about 2 BUCKET.
Comparing a cell densely costs far less a pair (about 14 ns) than a local
join or a hop, which ship a vector for every few pairs: so the lists and the
searches start good and few rounds and hops are left.
Lists and beams are rows of arrays, and a task gets the parts of many centres
(JOIN_ROWS), lists of many ids (MERGE_ENTRIES) or the nodes of several queries
(SCORE_NODES expanded) at a time; a query of a wider search is dealt to several.
Nothing but counts,
at most TABLES * PIVOTS pivots and the SAMPLE queries' vectors reaches the driver; comparing these with all
vectors is one pass of the nodes.  Measured recall at 20 (``tests/llm``, README): over 0.9.

Edge cases: vectors that are null, zero, of another length than most, or hold
null or non-finite components take no part, nor do null ids; of rows that
repeat an id the least vector counts; with fewer candidates than asked for all
found are returned; ties go to the smaller id; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, ship, slices

K = 24
TABLES = 3
#: Pivots of a table at most; cells of a vector in each table; vectors of a cell.
PIVOTS, NEAR, BUCKET = 2048, 6, 2048
#: Vectors of a cell that are compared with the cell at a time.
CELL_ROWS = 256
GROUP = 128
#: Rows of local joins, entries of lists and expanded nodes of queries that a task handles at a time.
JOIN_ROWS, MERGE_ENTRIES, SCORE_NODES = 8192, 4096, 256
#: Candidates a member takes from one group.
BEST_OF_GROUP = 6
ROUNDS = 8
DONE = 0.01
EXPAND, SEEDS = 32, 8
#: Queries compared with all vectors, and the share of their nearest from which on a search is wide enough.
SAMPLE, ENOUGH = 200, 0.95
#: Vectors compared with the sample at a time.
SCAN_ROWS = 4096
SEED = 5


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, vec) of the vectors that take part."""
    v = F.col("vec")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(v, lambda x: x != 0)
    kind = vectors.select(F.col(vec_col).alias("vec")).schema["vec"].dataType.simpleString()
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    src = (vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast(kind).alias("vec"))
           .filter(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.coalesce(some, F.lit(False))))
    sizes = src.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    dim = sizes[0]["d"] if sizes else 0
    return src.filter(F.size("vec") == dim).groupBy("vec_id").agg(F.min("vec").alias("vec"))


def _matrix(vectors: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    flat = vectors.combine_chunks().flatten() if isinstance(vectors, pa.ChunkedArray) else vectors.flatten()
    return np.asarray(flat, np.float64).reshape(rows, -1)


def _codes(pivots: np.ndarray, planes: np.ndarray, near: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """pivots: (tables, pivots, dimensions) of unit vectors; planes: (tables,
    bits, dimensions).  The ``near`` cells of each vector, table by table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            if batch.num_rows:
                x = _matrix(batch.column("vec"), batch.num_rows)
                code = np.zeros((batch.num_rows, pivots.shape[0], near), np.int64)
                for t in range(pivots.shape[0]):
                    code[:, t] = np.argpartition(-(x @ pivots[t].T), near - 1, axis=1)[:, :near]
                    for plane in planes[t]:
                        code[:, t] = code[:, t] * 2 + (x @ plane > 0)[:, None]
                code = code.reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(code), pa.list_(pa.int64()))], names=[*batch.schema.names, "codes"])

    return run


def _pivots(nodes: DataFrame, n: int, dim: int) -> np.ndarray:
    """(TABLES, pivots, dimensions): directions of nodes drawn by their ids, as
    many a table as give cells of BUCKET vectors, PIVOTS at most."""
    each = min(PIVOTS, max(1, math.ceil(n * NEAR / BUCKET)))
    drawn = nodes.orderBy(F.xxhash64("id"), "id").limit(TABLES * each).collect()
    if not drawn:
        return np.zeros((TABLES, 1, dim))
    x = np.array([r["vec"] for r in drawn], np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x[np.arange(TABLES * each) % len(x)].reshape(TABLES, each, -1)


def _coded(vectors: DataFrame, id_col: str, pivots: np.ndarray, planes: np.ndarray, near: int) -> DataFrame:
    """(id, vec, codes): ``vectors`` with the codes of their ``near`` cells."""
    vectors = vectors.select(id_col, "vec")
    return vectors.mapInArrow(_codes(pivots, planes, near), f"{id_col} long, vec {vectors.schema['vec'].dataType.simpleString()}, codes array<long>")


def _cells(coded: DataFrame, near: int, *columns: str) -> DataFrame:
    """(columns, t, code), a row for each cell of each vector."""
    return coded.select(*columns, F.posexplode("codes").alias("at", "code")).select(*columns, F.expr(f"at div {near}").alias("t"), "code")


def _placed(coded: DataFrame, id_col: str, near: int, crowded: DataFrame) -> DataFrame:
    """(t, code, part, id, vec): each vector in its cells; of a crowded one in one part."""
    return (_cells(coded, near, id_col, "vec").join(F.broadcast(crowded), ["t", "code"], "left")
            .select("t", "code", F.pmod(F.xxhash64(id_col, "t"), F.coalesce("parts", F.lit(1))).alias("part"), id_col, "vec"))


def _lifted(vectors: pa.ChunkedArray, rows: int, top: float) -> tuple[np.ndarray, np.ndarray]:
    """The vectors, each with the coordinate that makes all squared norms
    ``top``, and halves of the squared norms.  The coordinate is taken less the
    root of ``top``, which changes no distance and keeps its differences exact
    beside one long vector."""
    x = _matrix(vectors, rows)
    norms = (x * x).sum(1)
    both = np.sqrt(np.maximum(top - norms, 0)) + math.sqrt(top)
    x = np.column_stack([x, -np.divide(norms, both, out=np.zeros_like(norms), where=both > 0)])
    return x, (x * x).sum(1) / 2


def _bounds(sims: np.ndarray, m: int) -> np.ndarray:
    """For each row a bound that at least ``m`` of its entries reach, and few
    more: the m-th largest of the maxima of eight columns each."""
    width = sims.shape[1]
    if width > 16 * m:
        sims = sims[:, :width // 8 * 8].reshape(len(sims), 8, -1).max(axis=1)
    at = sims.shape[1] - m
    return np.partition(sims, at, axis=1)[:, at]


def _best_places(sims: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of at least the ``m`` largest entries of each row, and few more."""
    r, c = np.nonzero(sims >= _bounds(sims, m)[:, None])
    if len(r) > 2 * m * len(sims):  # many are equal
        r, c = np.repeat(np.arange(len(sims)), m), np.argpartition(-sims, m - 1, axis=1)[:, :m].ravel()
    return r, c


#: ``new``: whether an entry has come since the last round (in a search: is yet to be expanded).
_LISTS = "id long, nbrs array<long>, sims array<double>, news array<boolean>"


def _list_table(ids: np.ndarray, rows: np.ndarray, nbrs: np.ndarray, sims: np.ndarray, news: np.ndarray) -> pa.Table:
    """Lists of the entries of each of ``ids``; ``rows``, ascending, are places in ``ids``."""
    held, sizes = np.unique(rows, return_counts=True)
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
    return pa.table({"id": pa.array(ids[held], pa.int64()), "nbrs": pa.ListArray.from_arrays(offsets, pa.array(nbrs, pa.int64())),
                     "sims": pa.ListArray.from_arrays(offsets, pa.array(sims, pa.float64())), "news": pa.ListArray.from_arrays(offsets, pa.array(news, pa.bool_()))})


def _joined(parts: list[np.ndarray], kind: type) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def _first_lists(top: float, most: int) -> Callable[[pa.Table], pa.Table]:
    """Each member's ``most`` nearest others of its cell."""

    def run(t: pa.Table) -> pa.Table:
        ids = t.column("id").to_numpy()
        x, half = _lifted(t.column("vec"), len(ids), top)
        left, right = np.column_stack([x, np.ones(len(x))]), np.column_stack([x, -half])
        m = min(most, len(ids) - 1)
        rows, cols, values = [], [], []
        for at in range(0, len(ids) if m > 0 else 0, CELL_ROWS):
            sims = left[at:at + CELL_ROWS] @ right.T
            sims[np.arange(len(sims)), at + np.arange(len(sims))] = -np.inf
            r, c = _best_places(sims, m)
            rows.append(at + r)
            cols.append(c)
            values.append(2 * (sims[r, c] - half[at + r]))
        row = _joined(rows, int)
        return _list_table(ids, row, ids[_joined(cols, int)], _joined(values, float), np.ones(len(row), bool))

    return run


def _local_join(top: float) -> Callable[[pa.Table], pa.Table]:
    """Compares the members of each centre's part with each other, if one of
    the two is new there; a table holds many parts."""

    def run(t: pa.Table) -> pa.Table:
        centre, part = t.column("centre").to_numpy(), t.column("part").to_numpy()
        order = np.lexsort((part, centre))
        centre, part = centre[order], part[order]
        ids, new = t.column("id").to_numpy()[order], t.column("new").to_numpy()[order]
        x, half = _lifted(t.column("vec"), len(ids), top)
        x, half = x[order], half[order]
        left, right = np.column_stack([x, np.ones(len(x))]), np.column_stack([x, -half])
        floor = t.column("floor").to_numpy()[order] / 2 + half
        ends = np.append(np.flatnonzero((centre[1:] != centre[:-1]) | (part[1:] != part[:-1])) + 1, len(ids))
        rows, cols, values, at = [], [], [], 0
        for end in ends.tolist():
            if end - at > 1 and (fresh := new[at:end]).any():
                sims = left[at:end] @ right[at:end].T
                if not fresh.all():
                    sims[~(fresh[:, None] | fresh)] = -np.inf
                np.fill_diagonal(sims, -np.inf)
                kept = sims > floor[at:end, None]
                if end - at > BEST_OF_GROUP:
                    kept &= sims >= _bounds(sims, BEST_OF_GROUP)[:, None]
                r, c = np.nonzero(kept)
                rows.append(at + r)
                cols.append(at + c)
                values.append(2 * (sims[r, c] - half[at + r]))
            at = end
        row = _joined(rows, int)
        return _list_table(ids, row, ids[_joined(cols, int)], _joined(values, float), np.ones(len(row), bool))

    return run


def _best_lists(most: int) -> Callable[[pa.Table], pa.Table]:
    """One list for each id: its ``most`` best entries; of equal ones the older."""

    def run(t: pa.Table) -> pa.Table:
        sizes = t.column("nbrs").combine_chunks().value_lengths().to_numpy()
        ids, row = np.unique(t.column("id").to_numpy(), return_inverse=True)
        row = np.repeat(row, sizes)
        nbrs, sims, news = (t.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("nbrs", "sims", "news"))
        order = np.lexsort((nbrs, row))
        row, nbrs, sims, news = row[order], nbrs[order], sims[order], news[order]
        if len(row):
            starts = np.append(0, np.flatnonzero((row[1:] != row[:-1]) | (nbrs[1:] != nbrs[:-1])) + 1)
            row, nbrs, sims, news = row[starts], nbrs[starts], np.maximum.reduceat(sims, starts), np.logical_and.reduceat(news, starts)
        order = np.lexsort((nbrs, -sims, row))
        order = order[np.arange(len(row)) - np.searchsorted(row, row) < most]
        return _list_table(ids, row[order], nbrs[order], sims[order], news[order])

    return run


def _merged(lists: DataFrame, most: int, groups: int) -> DataFrame:
    """_best_lists of ``lists``, the ids dealt into ``groups``."""
    return lists.groupBy(F.pmod(F.xxhash64("id"), F.lit(groups))).applyInArrow(_best_lists(most), _LISTS)


def _entries(lists: DataFrame) -> DataFrame:
    """(id, nbr, sim, new), a row for each entry."""
    return lists.select("id", F.inline(F.arrays_zip("nbrs", "sims", "news"))).toDF("id", "nbr", "sim", "new")


class Index:
    """Graph over distinct vectors.  nodes: (id, vec); edges: (id, nbr, sim);
    cells: (t, code, part, id, vec); crowded: (t, code, parts) of cells of several parts."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, cells: DataFrame, crowded: DataFrame, pivots: np.ndarray, planes: np.ndarray) -> None:
        self.nodes, self.edges, self.cells, self.crowded, self.pivots, self.planes = nodes, edges, cells, crowded, pivots, planes


def build(nodes: DataFrame) -> Index:
    """``nodes``: (id, vec) of distinct usable vectors, materialised."""
    ship(nodes.sparkSession)
    stats = nodes.agg(F.count(F.lit(1)).alias("n"), F.max(inner_product(F.col("vec"), F.col("vec"))).alias("top"), F.max(F.size("vec")).alias("d")).first()
    n, top, dim = stats["n"], float(stats["top"] or 0.0), stats["d"] or 1
    pivots = _pivots(nodes, n, dim)
    near = min(NEAR, pivots.shape[1])
    bits = math.floor(math.log2(max(1, n * near / (pivots.shape[1] * BUCKET))))
    planes = np.random.default_rng(SEED).normal(size=(TABLES, bits, dim))
    coded = materialise(_coded(nodes, "id", pivots, planes, near), "codes")
    crowded = materialise(_cells(coded, near).groupBy("t", "code").agg(F.ceil(F.count(F.lit(1)) / (2 * BUCKET)).alias("parts")).filter("parts > 1"), "crowded")
    cells = _placed(coded, "id", near, crowded)
    # the nearest are spread over many cells: of each, half a list is enough
    most = K if pivots.shape[1] == 1 else K // 2
    first = cells.groupBy("t", "code", "part").applyInArrow(_first_lists(top, most), _LISTS)
    groups = math.ceil((n * TABLES * near * most + 1) / MERGE_ENTRIES)
    lists = materialise(_merged(first, K, groups), "graph")
    for _ in range(ROUNDS):
        edges = _entries(lists)
        meets = (edges.select(F.col("id").alias("centre"), F.col("nbr").alias("id"), "new")
                 .union(edges.select(F.col("nbr").alias("centre"), "id", "new"))
                 .groupBy("centre", "id").agg(F.max("new").alias("new")))
        sizes = meets.groupBy("centre").agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("parts"), F.max("new").alias("any")).filter("any")
        floors = lists.filter(F.size("sims") == K).select("id", F.element_at("sims", K).alias("floor"))
        at = nodes.join(floors, "id", "left").select("id", "vec", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))
        together = F.pmod(F.xxhash64("centre", "part"), F.lit(math.ceil((2 * K * n + 1) / JOIN_ROWS)))
        dealt = (meets.join(sizes, "centre").withColumn("part", F.pmod(F.xxhash64("centre", "id"), "parts"))
                 .join(at, "id").select("centre", "part", "id", "new", "vec", "floor"))
        found = dealt.groupBy(together).applyInArrow(_local_join(top), _LISTS)
        old = lists.withColumn("news", F.transform("news", lambda x: F.lit(False)))
        lists = materialise(_merged(old.union(found), K, groups), "graph")
        changed = lists.agg(F.sum(F.size(F.filter("news", lambda x: x)))).first()[0] or 0
        if changed <= DONE * n * K:
            break
    return Index(nodes, _entries(lists).select("id", "nbr", "sim"), cells, crowded, pivots, planes)


def _nearest_of_batch(asked: np.ndarray, ids: np.ndarray, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of each batch of nodes the k of largest inner product for every row of
    ``asked``, whose nodes are ``ids``; a row's own node is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SCAN_ROWS):
                batch = whole.slice(at, SCAN_ROWS)
                x = np.asarray(batch.column("vec").flatten(), np.float64).reshape(batch.num_rows, -1)
                held = batch.column("id").to_numpy()
                scores = asked @ x.T
                scores[ids[:, None] == held] = -np.inf
                m = min(k, batch.num_rows)
                best = np.argpartition(-scores, m - 1, axis=1)[:, :m]
                values = np.take_along_axis(scores, best, axis=1).ravel()
                keep = values > -np.inf
                yield pa.record_batch({"query_id": pa.array(np.repeat(ids, m)[keep]), "id": pa.array(held[best].ravel()[keep]), "score": pa.array(values[keep])})

    return run


def _truth(nodes: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, floor, most) of SAMPLE queries, of which ``query_id`` is the
    node: the score of the k-th nearest other node of all, a little less for
    rounding, and how many there are (k, or all if fewer)."""
    # not drawn as the pivots are, whose own cells hold their nearest
    sample = queries.orderBy(F.xxhash64("query_id", F.lit(SEED)), "query_id").limit(SAMPLE).collect()
    schema = "query_id long, id long, score double"
    if sample:
        asked = np.array([r["vec"] for r in sample], np.float64)
        found = nodes.mapInArrow(_nearest_of_batch(asked, np.array([r["query_id"] for r in sample], np.int64), k), schema)
    else:
        found = nodes.sparkSession.createDataFrame([], schema)
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    best = found.withColumn("r", F.row_number().over(by)).filter(F.col("r") <= k)
    slack = F.max(F.abs("score")) * 1e-12
    return materialise(best.groupBy("query_id").agg((F.min("score") - slack).alias("floor"), F.count(F.lit(1)).alias("most")), "truth")


def _best_of_cell(most: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The ``most`` members of a cell of largest inner product for each query that asks there."""

    def run(members: pa.Table, asked: pa.Table) -> pa.Table:
        ids, queries = members.column("id").to_numpy(), asked.column("query_id").to_numpy()
        rows, cols, values = [], [], []
        if len(ids) and len(queries):
            x, q = _matrix(members.column("vec"), len(ids)), _matrix(asked.column("vec"), len(queries))
            for at in range(0, len(queries), CELL_ROWS):
                sims = q[at:at + CELL_ROWS] @ x.T
                r, c = _best_places(sims, min(most, len(ids)))
                rows.append(at + r)
                cols.append(c)
                values.append(sims[r, c])
        row = _joined(rows, int)
        return _list_table(queries, row, ids[_joined(cols, int)], _joined(values, float), np.ones(len(row), bool))

    return run


def _scores(most: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The ``most`` best of the nodes that are dealt to each query: sums of
    double products in coordinate order."""

    def run(pairs: pa.Table, asked: pa.Table) -> pa.Table:
        queries = asked.column("query_id").to_numpy()
        order = np.argsort(queries)
        row = np.searchsorted(queries[order], pairs.column("query_id").to_numpy())
        by_row = np.argsort(row, kind="stable")
        row, nbrs = row[by_row], pairs.column("id").to_numpy()[by_row]
        sims = np.zeros(len(row))
        if len(row):
            x = np.ascontiguousarray(_matrix(pairs.column("vec"), len(row)).T)
            q = np.ascontiguousarray(_matrix(asked.column("vec"), len(queries)).T)
            at = order[row]
            for a, b in zip(q, x, strict=True):
                sims += a[at] * b[by_row]
        best = np.lexsort((nbrs, -sims, row))
        best = best[np.arange(len(row)) - np.searchsorted(row, row) < most]
        return _list_table(queries[order], row[best], nbrs[best], sims[best], np.ones(len(best), bool))

    return run


def search(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """``queries``: (query_id, vec), ``query_id`` the node of ``vec``.
    (query_id, id, score): the k + 1 best nodes found for each query, or all,
    if fewer, unordered."""
    spark = queries.sparkSession
    ship(spark)
    both = index.edges.select("id", "nbr", "sim").union(index.edges.select(F.col("nbr").alias("id"), F.col("id").alias("nbr"), "sim")).distinct()
    by_sim = Window.partitionBy("id").orderBy(F.desc("sim"), "nbr")
    # a node's forward list and as many of its nearest reverse neighbours
    links = materialise(both.withColumn("r", F.row_number().over(by_sim)).filter(F.col("r") <= 2 * K).groupBy("id").agg(F.collect_list("nbr").alias("nbrs")), "links")
    queries = materialise(queries.select("query_id", "vec"), "queries")
    nodes = index.nodes
    n, n_queries = nodes.count(), queries.count()
    truth = _truth(nodes, queries, k)
    wanted = truth.agg(F.sum("most")).first()[0] or 0

    by_length = F.desc(inner_product(F.col("vec"), F.col("vec")))

    def starts(seeds: int, expand: int) -> DataFrame:
        near = min(3 * seeds, index.pivots.shape[1])
        asked = _placed(_coded(queries, "query_id", index.pivots, index.planes, near), "query_id", near, index.crowded)
        found = index.cells.groupBy("t", "code", "part").cogroup(asked.groupBy("t", "code", "part")).applyInArrow(_best_of_cell(k + 1), _LISTS)
        entries = _entries(_merged(found, 2 * expand, math.ceil((n_queries * TABLES * near * (k + 1) + 1) / MERGE_ENTRIES)))
        longest = nodes.orderBy(by_length, "id").limit(seeds).select("id")
        return entries.select(F.col("id").alias("query_id"), F.col("nbr").alias("id")).union(queries.select("query_id").crossJoin(F.broadcast(longest)))

    def scored(pairs: DataFrame, expand: int) -> DataFrame:
        # a group holds a few queries, of wide searches a share of one query's nodes
        groups, shares = math.ceil((n_queries * expand + 1) / SCORE_NODES), math.ceil(expand / SCORE_NODES)
        group, share = F.pmod(F.xxhash64("query_id"), F.lit(groups)).alias("group"), F.pmod(F.xxhash64("id"), F.lit(shares)).alias("share")
        dealt = pairs.join(nodes, "id").select("query_id", "id", "vec", group, share).groupBy("group", "share")
        each = queries.select("query_id", "vec", group, F.explode(F.sequence(F.lit(0), F.lit(shares - 1)).cast("array<long>")).alias("share"))
        return dealt.cogroup(each.groupBy("group", "share")).applyInArrow(_scores(4 * expand), _LISTS)

    def best(lists: DataFrame, expand: int) -> DataFrame:
        return _merged(lists, 4 * expand, math.ceil((n_queries * 8 * expand + 1) / MERGE_ENTRIES))

    def widened(beam: DataFrame, pairs: DataFrame, expand: int) -> DataFrame:
        # nodes that have fallen out of the beam may be scored again, which changes nothing
        held = _entries(beam).select(F.col("id").alias("query_id"), F.col("nbr").alias("id"), F.lit(True).alias("held"))
        fresh = pairs.withColumn("held", F.lit(False)).union(held).groupBy("query_id", "id").agg(F.max("held").alias("held")).filter("not held")
        return best(beam.union(scored(fresh, expand)), expand)

    own = queries.select("query_id", F.col("query_id").alias("id"))
    # the list of its own vector brings a query near its answers
    first = own.union(own.join(links, "id").select("query_id", F.explode("nbrs").alias("id")))
    expand, seeds = max(EXPAND, k + 1), SEEDS
    beam = materialise(best(scored(starts(seeds, expand).union(first).distinct(), expand), expand), "beam")
    while True:
        while True:
            head = beam.select(F.col("id").alias("query_id"), F.inline(F.arrays_zip(F.slice("nbrs", 1, expand).alias("id"), F.slice("news", 1, expand).alias("open")))).toDF("query_id", "id", "open")
            open_ = head.filter("open").select("query_id", "id")
            if open_.isEmpty():
                break
            reached = open_.join(links, "id").select("query_id", F.explode("nbrs").alias("id"))
            marked = beam.withColumn("news", F.transform("news", lambda x, i: x & (i >= expand)))
            beam = materialise(widened(marked, reached, expand), "beam")
        # of equal scores any will do
        held = (_entries(beam).toDF("query_id", "id", "score", "open").join(F.broadcast(truth), "query_id").filter("id <> query_id and score >= floor")
                .groupBy("query_id").agg(F.least(F.count(F.lit(1)), F.first("most")).alias("held")).agg(F.sum("held")).first()[0] or 0)
        if held >= ENOUGH * wanted or expand >= n:
            answers = beam.select("id", *(F.slice(c, 1, k + 1).alias(c) for c in ("nbrs", "sims", "news")))
            return _entries(answers).select(F.col("id").alias("query_id"), F.col("nbr").alias("id"), F.col("sim").alias("score"))
        expand, seeds = 2 * expand, 2 * seeds
        beam = materialise(widened(beam, starts(seeds, expand), expand), "beam")


def nearest(vectors: DataFrame, queries: Column, k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for every row of ``vectors`` for which
    ``queries`` (a condition on vec_id) holds, its k nearest other rows."""
    rows = materialise(usable(vectors, id_col, vec_col), "vectors")
    nodes = materialise(rows.groupBy("vec").agg(F.min("vec_id").alias("id")).select("id", "vec"), "nodes")
    index = build(nodes)
    # equal vectors have the same answers up to the ids: a query's vector is searched once
    asked = rows.filter(queries)
    asked_nodes = nodes.join(asked.select("vec").distinct(), "vec", "left_semi")
    found = search(index, asked_nodes.select(F.col("id").alias("query_id"), "vec"), k)

    # at most the k + 1 least ids of equal vectors can be in a result
    member = rows.join(nodes, "vec").select("vec_id", "id")
    salted = Window.partitionBy("id", F.pmod(F.xxhash64("vec_id"), F.lit(64))).orderBy("vec_id")
    whole = Window.partitionBy("id").orderBy("vec_id")
    least = (member.withColumn("r", F.row_number().over(salted)).filter(F.col("r") <= k + 1)
             .withColumn("r", F.row_number().over(whole)).filter(F.col("r") <= k + 1).select("id", "vec_id"))
    best = Window.partitionBy("node").orderBy(F.desc("score"), "vec_id")
    answers = (found.join(least, "id").select(F.col("query_id").alias("node"), "vec_id", "score")
               .withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k + 1).drop("r"))
    ask_ids = asked.join(nodes, "vec").select(F.col("vec_id").alias("query_id"), F.col("id").alias("node"))
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (ask_ids.join(answers, "node").filter("query_id <> vec_id")
            .withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
