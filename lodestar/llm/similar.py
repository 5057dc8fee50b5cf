"""Most similar vectors for every vector: permutation index with pivot inverted files.

A vector is represented by the order of its ``PREFIX`` nearest pivots and posted under each of them. A file of more than ``FILE`` postings is not kept: its vectors are posted
under the shared pivot together with each of their other ones, then under three pivots, and so on, so that files stay near one length while a vector is never posted
more than ten times (subsets of five pivots none of which holds another), however large the collection. Inside a file postings are ranked by the footrule distance of the two (truncated) permutations,
the ``CANDIDATES`` nearest of each vector are reranked by exact cosine, and the best of all its files are kept. Vectors that share all five pivots with more than ``FILE`` others
are compared exactly, by pairs of blocks. Pivots are a bounded sample of the vectors (one for every ``VECTORS_A_PIVOT``, between ``LEAST_PIVOTS`` and ``MOST_PIVOTS``);
every vector is indexed and every vector is a query. Equal vectors are one entry (a class), so copies never fill a file.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.operators.skew import heavy_keys
from lodestar.session import cut_lineage

DIMENSION = 64
PREFIX = 5
VECTORS_A_PIVOT, LEAST_PIVOTS, MOST_PIVOTS = 64, 32, 8192
CANDIDATES = 64
FILE = 1024
DECIMALS = 9


def usable_vectors(df: DataFrame, id_column: str, vector_column: str, dimension: int = DIMENSION) -> DataFrame:
    """(id, vec): vectors of ``dimension`` values, none null or NaN, not all zero; ids trimmed, blank and null ids dropped.

    Each id counts once; if its rows differ, the greatest usable vector stands for it.
    """
    v = F.col(vector_column)
    fine = (F.size(v) == dimension) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = df.filter(v.isNotNull()).filter(fine).select(F.trim(id_column).alias("id"), v.cast("array<float>").alias("vec"))
    return rows.filter(F.col("id") != "").groupBy("id").agg(F.max("vec").alias("vec"))


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension).astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def choose_pivots(classes: DataFrame, n: int, dimension: int) -> np.ndarray:
    """Unit pivots: the vectors with the smallest hashes, at most ``MOST_PIVOTS`` whatever the size of the table."""
    m = min(MOST_PIVOTS, max(LEAST_PIVOTS, 1 << max(0, (n // VECTORS_A_PIVOT)).bit_length()))
    rows = classes.orderBy(F.xxhash64("cls"), "cls").limit(m).select("vec").toArrow()
    if rows.num_rows == 0:
        return np.empty((0, dimension), np.float32)
    return _unit(_matrix(rows.column(0).combine_chunks(), dimension)).astype(np.float32)


def with_nearest_pivots(classes: DataFrame, pivots, prefix: int, dimension: int) -> DataFrame:
    """(cls, near, vec): the ``prefix`` nearest pivots of every vector in their order (ties: smaller pivot)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pivots.value
        k = min(prefix, len(p))
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                if not batch.num_rows:
                    continue
                x = _unit(_matrix(batch.column(1), dimension)).astype(np.float32)
                sims = x @ p.T
                near = np.argpartition(-sims, k - 1, axis=1)[:, :k]
                near = np.take_along_axis(near, np.lexsort((near, -np.take_along_axis(sims, near, 1)), axis=1), 1).astype(np.int32)
                orders = pa.ListArray.from_arrays(pa.array(np.arange(0, len(x) * k + 1, k, dtype=np.int32)), pa.array(near.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), orders, batch.column(1)], names=["cls", "near", "vec"])

    return classes.select("cls", "vec").mapInArrow(run, "cls bigint, near array<int>, vec array<float>")


def file_postings(placed: DataFrame, prefix: int, file: int) -> DataFrame:
    """(cls, near, vec, key, blocks): postings of (cls, near, vec), each under sets of its pivots; ``blocks`` is 1 but for files of whole prefixes that are longer than ``file``.

    Single pivots first (the list of long ones has at most ``MOST_PIVOTS`` rows and is broadcast); members of long files are posted under all sets of one pivot more that hold a long set.
    """
    posted = placed.withColumn("pivots", F.explode(F.transform("near", lambda p: F.array(p))))
    parts, open_, carried = [], posted, True
    for size in range(1, prefix + 1):
        long = open_.groupBy("pivots").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > file)
        if long.isEmpty():
            break
        marked = open_.join(F.broadcast(long) if size == 1 else long, "pivots", "left")
        last = size == prefix
        done = (marked if last else marked.filter("n is null")).withColumn("blocks", F.coalesce(F.ceil(F.col("n") / file).cast("int"), F.lit(1)))
        parts.append(_with_vectors(done, placed, carried))
        if last:
            open_ = None
            break
        kept = [] if size == 1 else [F.first("kept").alias("before")]
        more = marked.groupBy("cls").agg(F.collect_list(F.when(F.col("n").isNotNull(), F.col("pivots"))).alias("sets"), F.collect_list(F.when(F.col("n").isNull(), F.col("pivots"))).alias("now"), *kept)
        more = more.filter(F.size("sets") > 0).withColumn("kept", F.concat("before", "now") if kept else F.col("now"))
        grown = F.array_distinct(F.flatten(F.transform("sets", lambda s: F.transform(F.array_except("near", s), lambda p: F.array_sort(F.concat(s, F.array(p)))))))
        # vectors that share a set also share its parts: a set that holds one already posted is not needed, so the posted ones never hold each other
        fresh = F.filter(grown, lambda g: ~F.exists("kept", lambda e: F.size(F.array_except(e, g)) == 0))
        open_ = cut_lineage(more.join(placed.select("cls", "near"), "cls").select("cls", "kept", F.explode(fresh).alias("pivots")))
        carried = False
    if open_ is not None:
        parts.append(_with_vectors(open_.withColumn("blocks", F.lit(1)), placed, carried))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _with_vectors(postings: DataFrame, placed: DataFrame, carried: bool) -> DataFrame:
    rows = postings if carried else postings.join(placed, "cls")
    return rows.select("cls", "near", "vec", F.xxhash64("pivots").alias("key"), "blocks")


def footrule_gain(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Shared part of the footrule of truncated permutations (rows: ordered pivots); the larger, the nearer.

    With absent pivots at place k, the distance is k * (k + 1) minus twice the sum, over shared pivots, of the smaller of (k - place).
    """
    k = a.shape[1]
    out = np.zeros((len(a), len(b)), np.int16)
    for i in range(k):
        for j in range(k):
            out += (a[:, i, None] == b[None, :, j]) * np.int16(k - max(i, j))
    return out


def _best_of_each(query: np.ndarray, cosine: np.ndarray, k: int) -> np.ndarray:
    """Indices of each query's ``k`` highest cosines and of those equal to the last of them."""
    order = np.lexsort((-cosine, query))
    q = query[order]
    first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
    size = np.diff(np.r_[first, len(q)])
    least = np.repeat(cosine[order][first + np.minimum(k, size) - 1], size)
    return order[cosine[order] >= least]


def _search_cell(table: pa.Table, dimension: int, least_cosine: float, candidates: int, k: int) -> pa.Table:
    cls, block = table.column("cls").to_numpy(), table.column("block").to_numpy()
    width = len(table.column("near")[0])
    near = table.column("near").combine_chunks().flatten().to_numpy().reshape(-1, width)
    x = _unit(_matrix(table.column("vec").combine_chunks(), dimension))
    i, j, whole = table.column("i")[0].as_py(), table.column("j")[0].as_py(), table.column("blocks")[0].as_py() > 1
    out_q, out_x, out_c = [], [], []

    def search(queries: np.ndarray, data: np.ndarray) -> None:
        for at in range(0, len(queries), 256):
            q = queries[at : at + 256]
            if whole:  # all share their pivots: compared exactly
                r, c = np.nonzero(q[:, None] != data[None, :])
            else:
                gain = footrule_gain(near[q], near[data])
                gain[q[:, None] == data[None, :]] = -1
                chosen = gain >= 1
                if len(data) > candidates:
                    # ties at the last place are all taken, so the choice never depends on the order of arrival
                    cut = np.partition(gain, len(data) - candidates, axis=1)[:, len(data) - candidates, None]
                    chosen = gain >= np.maximum(cut, 1)
                r, c = np.nonzero(chosen)
            cosine = np.round(np.einsum("nd,nd->n", x[q[r]], x[data[c]]), DECIMALS)
            ok = cosine >= least_cosine - 1e-12
            r, c, cosine = r[ok], c[ok], cosine[ok]
            if len(r):
                keep = _best_of_each(r, cosine, k)
                out_q.append(cls[q[r[keep]]])
                out_x.append(cls[data[c[keep]]])
                out_c.append(cosine[keep])

    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    if len(left) and len(right):
        search(left, right)
        if i != j:
            search(right, left)
    cat = lambda z, t: np.concatenate(z).astype(t) if z else np.empty(0, t)
    return pa.table({"q": cat(out_q, np.int64), "x": cat(out_x, np.int64), "cosine": cat(out_c, np.float64)})


def class_neighbours(classes: DataFrame, k: int, least_cosine: float, dimension: int = DIMENSION, prefix: int = PREFIX, candidates: int = CANDIDATES) -> DataFrame:
    """(q, x, cosine): for every class of equal vectors its nearest other classes with at least ``least_cosine``, the ``k`` best (and ties) of each of its files."""
    spark = classes.sparkSession
    pivots = spark.sparkContext.broadcast(choose_pivots(classes, classes.count(), dimension))
    if not len(pivots.value):
        return spark.createDataFrame([], "q bigint, x bigint, cosine double")
    placed = cut_lineage(with_nearest_pivots(classes, pivots, prefix, dimension))
    posted = file_postings(placed, min(prefix, len(pivots.value)), FILE).withColumn("block", F.pmod(F.xxhash64("cls", F.lit(1)), F.col("blocks")).cast("int"))
    cells = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, "block").alias("i"), F.greatest(o, "block").alias("j")))
    grouped = posted.withColumn("cell", F.explode(cells)).select("key", "cell.i", "cell.j", "blocks", "block", "cls", "near", "vec").groupBy("key", "i", "j")

    def cell(table: pa.Table) -> pa.Table:
        return _search_cell(table, dimension, least_cosine, candidates, k)

    return grouped.applyInArrow(cell, "q bigint, x bigint, cosine double").groupBy("q", "x").agg(F.max("cosine").alias("cosine"))


def nearest(vectors: DataFrame, k: int = 5, least_cosine: float = 0.85, dimension: int = DIMENSION) -> DataFrame:
    """(id, other, cosine, place): up to ``k`` other ids with the highest cosine (rounded to 9 decimals; ties: smaller id) of every id of ``vectors`` (id, vec).

    Fewer than two usable vectors, or an empty table: no rows.
    """
    hashed = vectors.withColumn("cls", F.xxhash64("vec"))
    by_class = Window.partitionBy("cls").orderBy("id")
    # the first ids of each class: the group limit prunes before the exchange, a class of any size leaves a task with k + 1 rows
    first = hashed.select("cls", "id").withColumn("n", F.row_number().over(by_class)).filter(F.col("n") <= k + 1).drop("n")
    classes = cut_lineage(hashed.groupBy("cls").agg(F.max("vec").alias("vec")))
    links = class_neighbours(classes, k, least_cosine, dimension)
    itself = classes.select(F.col("cls").alias("q"), F.col("cls").alias("x"), F.lit(1.0).alias("cosine"))
    spread = links.unionByName(itself).join(first.select(F.col("cls").alias("x"), F.col("id").alias("other")), "x")
    order = Window.partitionBy("q").orderBy(F.col("cosine").desc(), "other")
    best = spread.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1)
    lists = cut_lineage(best.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("n", "other", "cosine"))).alias("best")))  # k + 1 entries
    # a class that holds many ids is one key: the lists of such classes (at most 1 / heavy_share) go to its rows instead
    heavy = heavy_keys(hashed.select(F.col("cls").alias("q")), ["q"])
    marked = hashed.select("id", F.col("cls").alias("q")).join(F.broadcast(heavy), "q", "left")
    few = lists.join(F.broadcast(heavy), "q", "left_semi")
    own = F.slice(F.filter("best", lambda e: e["other"] != F.col("id")), 1, k)
    with_lists = marked.filter("_heavy").join(F.broadcast(few), "q").unionByName(marked.filter("_heavy is null").join(lists, "q"))
    rows = with_lists.select("id", F.posexplode(own).alias("p", "e"))
    return rows.select("id", F.col("e.other").alias("other"), F.col("e.cosine").alias("cosine"), (F.col("p") + 1).alias("place"))


def pairs(found: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: each pair in which one is among the other's nearest, once."""
    return found.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()
