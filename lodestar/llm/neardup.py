"""Near-duplicate texts: MinHash bands, Bayesian pruning of candidates, exact verification.

Texts with the same set of shingles form a class and are one node (the fingerprint of the set). One pass over the texts writes, for each, its node, one key per
band and a sketch; everything up to the verification works on these. Nodes that share a band are candidates. A posting carries the sketch, so that candidates are compared
where they meet: 2 bits of each of ``SKETCH`` MinHash values, a chunk at a time. With m of n values equal, the posterior probability (uniform prior) that the similarity
reaches the threshold is a binomial tail, and a pair is dropped as soon as it falls below ``TOLERANCE``. Only what is left leaves the task; it is verified on the whole shingle sets.

Postings travel as packed blocks, one for each part of the key space, and the bands in rounds, so that the shuffle files of one round are gone before the next. A bucket of more than ``HOT``
nodes is not compared pair by pair: its nodes are banded again, each of their other bands joined to the one they share. Only nodes that share two bands with more than
``HOT`` others are compared by pairs of blocks.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm import shingles as sh
from lodestar.session import cut_lineage

WORDS, THRESHOLD, LEAST_WORDS = 5, 0.8, 5
MISSED, LEAST_BANDS, MOST_ROWS, MOST_HASHES = 1e-3, 24, 5, 200
SKETCH, CHUNK, TOLERANCE = 112, 16, 1e-4
HOT, BLOCK = 4096, 2048
TEXTS_A_STEP, NODES_A_BLOCK, BANDS_A_ROUND = 512, 16_384, 13
#: Postings a task holds before it sends large buckets on.
HELD = 4_000_000

POSTING = np.dtype([("key", "<u4"), ("node", "<i8"), *[(f"s{i}", "<u4") for i in range(SKETCH // CHUNK)]])


def banding(threshold: float) -> tuple[int, int]:
    """(bands, rows): the longest bands, of at most ``MOST_HASHES`` values in all, with which a pair at ``threshold`` shares none with probability ``MISSED`` at most."""
    for rows in range(MOST_ROWS, 0, -1):
        p = threshold**rows
        bands = max(LEAST_BANDS, math.ceil(math.log(MISSED) / math.log1p(-p)) if p < 1 else 1)
        if bands * rows <= MOST_HASHES:
            break
    return bands, rows


def least_matches(threshold: float, n: int, tolerance: float = TOLERANCE) -> int:
    """Fewest equal values of ``n`` with which the posterior of reaching ``threshold`` is at least ``tolerance``.

    Two bits of each value are kept, so unequal values agree with probability 1/4. Under a uniform prior the posterior is P(Bin(n + 1, p) <= m).
    """
    p, tail = threshold + (1 - threshold) / 4, 0.0
    for m in range(n + 1):
        tail += math.comb(n + 1, m) * p**m * (1 - p) ** (n + 1 - m)
        if tail >= tolerance:
            return m
    return n + 1


def _schedule(threshold: float) -> list[tuple[int, int]]:
    return [(n, least_matches(threshold, n)) for n in range(CHUNK, SKETCH + 1, CHUNK)]


def packed_sketch(values: np.ndarray) -> np.ndarray:
    """Two low bits of each of ``SKETCH`` values, ``CHUNK`` of them in a word: (rows, words) of 32 bits."""
    bits = (values & np.uint32(3)).reshape(len(values), -1, CHUNK)
    return (bits << (2 * np.arange(CHUNK, dtype=np.uint32))).sum(2, dtype=np.uint32)


def prune(x: list[np.ndarray], a: np.ndarray, b: np.ndarray, schedule: list[tuple[int, int]]) -> np.ndarray:
    """Indices of the pairs (a, b) of rows of the sketch ``x`` (one array per word) that survive; later words are compared only where earlier ones left the pair alive."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), np.int32)
    for word, (_, least) in zip(x, schedule):
        d = word[a[alive]] ^ word[b[alive]]
        now = matches[alive] + (CHUNK - np.bitwise_count((d | (d >> np.uint32(1))) & np.uint32(0x55555555)).astype(np.int32))
        keep = now >= least
        alive = alive[keep]
        matches[alive] = now[keep]
    return alive


def _binary(rows: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Slices of a structured array as binary values; ``cuts`` are the n + 1 borders."""
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * rows.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def _unpacked(column: pa.Array, kind: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(x for x in column.to_pylist() if x), kind)


def signatures(docs: DataFrame, words: int, least_words: int, threshold: float) -> DataFrame:
    """(field, id, digest, node, keys, sketch) of every text that takes part: its class, band keys (32 bits each) and sketch. One pass over the texts, no shuffle."""
    bands, length = banding(threshold)
    band_mults, sketch_mults = sh.multipliers(bands * length, 1), sh.multipliers(SKETCH, 2)
    least = max(least_words, words)

    def signed(rows: pa.RecordBatch, h: np.ndarray, t: np.ndarray) -> pa.RecordBatch:
        n = rows.num_rows
        fields = np.array(rows.column(0).to_pylist())
        h, t = sh.shingle_sets(h, t)
        salts = np.zeros(n, np.uint64)  # texts of different fields share neither classes nor buckets
        for f in sorted(set(fields)):
            salts[fields == f] = np.uint64(zlib.crc32(f.encode()))
        prints = sh.mix64(sh.fingerprints(h, t, n) + salts).view(np.int64)
        _, values = sh.minhash(h, t, np.r_[band_mults, sketch_mults])  # every text here has shingles
        keys = (sh.mix64(sh.band_keys(values[:, : bands * length], length).view(np.uint64) + salts[:, None]) >> np.uint64(32)).astype("<u4")
        sketch = packed_sketch(values[:, bands * length :]).astype("<u4")
        packed = [pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * x.shape[1]), n, [None, pa.py_buffer(np.ascontiguousarray(x).tobytes())]).cast(pa.binary()) for x in (keys, sketch)]
        return pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), rows.column(3), pa.array(prints), *packed], names=["field", "id", "digest", "node", "keys", "sketch"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS_A_STEP):
                batch = whole.slice(at, TEXTS_A_STEP)
                hashes, text, counts = sh.shingle_hashes(batch.column(2).to_pylist(), words)
                keep = counts >= least
                chosen = np.flatnonzero(keep)
                if len(chosen):
                    within = keep[text]
                    yield signed(batch.take(pa.array(chosen)), hashes[within], (np.cumsum(keep) - 1)[text[within]])

    # a text of w words has at least 2w - 1 characters; shorter ones need not leave the JVM
    return _digested(docs).filter(F.length("text") >= 2 * least - 1).mapInArrow(run, "field string, id string, digest bigint, node bigint, keys binary, sketch binary")


def _digested(docs: DataFrame) -> DataFrame:
    return docs.select("field", "id", "text", F.xxhash64("text").alias("digest"))


def _parts(df: DataFrame) -> int:
    """Parts of the key space: as many as the session has shuffle partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _blocks_of(postings: np.ndarray, parts: int) -> pa.RecordBatch:
    """One packed block for each part that has postings."""
    postings = postings[np.argsort(postings["key"], kind="stable")]
    part = ((postings["key"].astype(np.uint64) * np.uint64(parts)) >> np.uint64(32)).astype(np.int32)
    cuts = np.r_[np.flatnonzero(np.r_[True, part[1:] != part[:-1]]), len(part)]
    return pa.RecordBatch.from_arrays([pa.array(part[cuts[:-1]]), _binary(postings, cuts)], names=["part", "postings"])


def _filled(node: np.ndarray, sketch: np.ndarray, row: np.ndarray, keys: np.ndarray) -> np.ndarray:
    out = np.empty(len(row), POSTING)
    out["key"], out["node"] = keys, node[row]
    for i in range(sketch.shape[1]):
        out[f"s{i}"] = sketch[row, i]
    return out


def _postings(signed: DataFrame, lo: int, hi: int, parts: int) -> DataFrame:
    """Packed postings of the bands ``lo`` to ``hi`` - 1. Copies leave a block of nodes once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def block() -> pa.RecordBatch:
            node, keys, sketch = (np.concatenate(x) for x in zip(*held))
            held.clear()
            once = np.unique(node, return_index=True)[1]
            row = np.repeat(once, hi - lo)
            return _blocks_of(_filled(node, sketch, row, keys[once].reshape(-1)), parts)

        for batch in batches:
            n = batch.num_rows
            if n:
                keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u4").reshape(n, -1)[:, lo:hi]
                held.append((batch.column(0).to_numpy(), keys, np.frombuffer(b"".join(batch.column(2).to_pylist()), "<u4").reshape(n, -1)))
            if sum(len(x[0]) for x in held) >= NODES_A_BLOCK:
                yield block()
        if held:
            yield block()

    return signed.select("node", "keys", "sketch").mapInArrow(run, "part int, postings binary")


def _again(signed: DataFrame, hot: DataFrame, parts: int) -> DataFrame:
    """Packed postings of the nodes of large buckets, under the shared band together with each of their other bands."""
    keys_of = hot.groupBy("node").agg(F.collect_set("key").alias("hot"))  # one entry per band at most
    own = signed.select("node", "keys", "sketch").dropDuplicates(["node"]).join(keys_of, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                n = batch.num_rows
                keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u4").reshape(n, -1).astype(np.uint64)
                sketch = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<u4").reshape(n, -1)
                shared = np.stack([np.isin(k, h) for k, h in zip(keys, batch.column(3).to_pylist())])
                i, j = np.triu_indices(keys.shape[1], 1)
                row, at_pair = np.nonzero(shared[:, i] | shared[:, j])
                both = sh.mix64(sh.mix64(keys[row, i[at_pair]] + np.uint64(1)) + keys[row, j[at_pair]] * np.uint64(0x9E3779B97F4A7C15))
                if len(row):
                    yield _blocks_of(_filled(batch.column(0).to_numpy(), sketch, row, (both >> np.uint64(32)).astype("<u4")), parts)

    return own.select("node", "keys", "sketch", "hot").mapInArrow(run, "part int, postings binary")


def _bucket_pairs(postings: np.ndarray, schedule: list[tuple[int, int]]) -> np.ndarray:
    """Surviving pairs of postings sorted by key, as (n, 2) nodes; a step holds no more pairs than there are postings."""
    key, node, x = postings["key"], np.ascontiguousarray(postings["node"]), [np.ascontiguousarray(postings[f"s{i}"]) for i in range(SKETCH // CHUNK)]
    found, i, d = [], np.arange(len(key) - 1 if len(key) else 0), 1
    while True:
        i = i[i + d < len(key)]
        i = i[key[i] == key[i + d]]
        if not len(i):
            break
        keep = i[prune(x, i, i + d, schedule)]
        found.append(np.stack([np.minimum(node[keep], node[keep + d]), np.maximum(node[keep], node[keep + d])], 1))
        d += 1
    return np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), np.int64)


def _compact(postings: np.ndarray, hot: int) -> tuple[np.ndarray, np.ndarray]:
    """(postings of buckets with up to ``hot`` nodes, those of larger ones), sorted by key, each node of a bucket once."""
    order = np.lexsort((postings["node"], postings["key"]))
    p = postings[order]
    fresh = np.ones(len(p), bool)
    fresh[1:] = (p["key"][1:] != p["key"][:-1]) | (p["node"][1:] != p["node"][:-1])
    p = p[fresh]
    first = np.flatnonzero(np.r_[True, p["key"][1:] != p["key"][:-1]]) if len(p) else np.empty(0, np.int64)
    size = np.diff(np.r_[first, len(p)])
    large = np.repeat(size > hot, size)
    return p[~large], p[large]


def _candidates(postings: DataFrame, parts: int, threshold: float) -> DataFrame:
    """(pairs, large): packed surviving pairs of nodes, and packed postings of the buckets of more than ``HOT`` nodes."""
    schedule, hot, held_most = _schedule(threshold), HOT, HELD
    nothing = pa.nulls(1, pa.binary())

    def packed(pairs: np.ndarray | None, large: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        for rows, at in ((pairs, 0), (large, 1)):
            for a in range(0, 0 if rows is None else len(rows), 65_536):
                both = [nothing, nothing]
                both[at] = pa.array([np.ascontiguousarray(rows[a : a + 65_536]).tobytes()], pa.binary())
                yield pa.RecordBatch.from_arrays(both, names=["pairs", "large"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n, most, known = 0, held_most, np.empty(0, np.uint32)
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(_unpacked(batch.column(1), POSTING))
            n += len(held[-1])
            if n > most:  # large buckets pass through; what stays has at most ``hot`` nodes a bucket
                p = np.concatenate(held)
                sent = np.isin(p["key"], known)
                yield from packed(None, p[sent])
                small, large = _compact(p[~sent], hot)
                yield from packed(None, large)
                known = np.union1d(known, large["key"])
                held, n = [small], len(small)
                most = max(held_most, 2 * n)
        if held:
            p = np.concatenate(held)
            sent = np.isin(p["key"], known)
            small, large = _compact(p[~sent], hot)
            yield from packed(_bucket_pairs(small, schedule), np.concatenate([p[sent], large]))

    return postings.repartitionById(parts, "part").mapInArrow(run, "pairs binary, large binary")


def _pair_rows(found: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = _unpacked(batch.column(0), np.dtype("<i8")).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(p[:, 0])), pa.array(np.ascontiguousarray(p[:, 1]))], names=["a", "b"])

    return found.filter("pairs is not null").select("pairs").mapInArrow(run, "a bigint, b bigint")


def _large_rows(found: DataFrame) -> DataFrame:
    """(key, node, sketch) of large buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = _unpacked(batch.column(0), POSTING)
            sketch = np.stack([p[f"s{i}"] for i in range(SKETCH // CHUNK)], 1)
            width = 4 * sketch.shape[1]
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(p), [None, pa.py_buffer(sketch.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(p["key"].astype(np.int64)), pa.array(np.ascontiguousarray(p["node"])), packed], names=["key", "node", "sketch"])

    return found.filter("large is not null").select("large").mapInArrow(run, "key bigint, node bigint, sketch binary")


def _by_blocks(large: DataFrame, threshold: float) -> DataFrame:
    """Surviving pairs (a, b) of buckets of any size, by pairs of blocks of about ``BLOCK`` nodes."""
    schedule = _schedule(threshold)
    sizes = large.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    rows = large.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    cells = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, "block").alias("i"), F.greatest(o, "block").alias("j")))
    spread = rows.select("key", "node", "sketch", "block", F.explode(cells).alias("cell")).select("key", "node", "sketch", "block", "cell.i", "cell.j")

    def cell(table: pa.Table) -> pa.Table:
        node, at = table.column("node").to_numpy(), table.column("block").to_numpy()
        sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), "<u4").reshape(len(node), -1)
        x = [np.ascontiguousarray(sketch[:, i]) for i in range(sketch.shape[1])]
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        left, right = np.flatnonzero(at == i), np.flatnonzero(at == j)
        found = [np.empty((0, 2), np.int64)]
        for n, row in enumerate(left):
            others = right[n + 1 :] if i == j else right
            keep = others[prune(x, np.full(len(others), row), others, schedule)]
            found.append(np.stack([np.minimum(node[row], node[keep]), np.maximum(node[row], node[keep])], 1))
        pairs = np.concatenate(found)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return spread.groupBy("key", "i", "j").applyInArrow(cell, "a bigint, b bigint")


def _survivors(signed: DataFrame, threshold: float) -> DataFrame:
    """(a, b), each once: pairs of different nodes that share a band and whose sketches leave the threshold possible."""
    bands, parts = banding(threshold)[0], _parts(signed)
    found = []
    for lo in range(0, bands, BANDS_A_ROUND):
        once = cut_lineage(_candidates(_postings(signed, lo, min(bands, lo + BANDS_A_ROUND), parts), parts, threshold))
        found.append(_pair_rows(once))
        hot = _large_rows(once).select("key", "node").distinct()
        if not hot.isEmpty():
            twice = cut_lineage(_candidates(_again(signed, hot, parts), parts, threshold))
            found.append(_pair_rows(twice))
            left = _large_rows(twice).dropDuplicates(["key", "node"])
            if not left.isEmpty():
                found.append(_by_blocks(left, threshold))
    pairs = found[0]
    for f in found[1:]:
        pairs = pairs.unionByName(f)
    return cut_lineage(pairs.filter("a <> b").distinct())


def _verified(pairs: DataFrame, texts: DataFrame, words: int, threshold: float) -> DataFrame:
    """Pairs whose exact similarity reaches the threshold: (a, b, jaccard)."""

    def sets(column: pa.Array) -> list[np.ndarray]:
        encoded = column.dictionary_encode()  # a text that stands in many pairs of a batch is cut into shingles once
        h, t = sh.distinct(*sh.shingle_hashes(encoded.dictionary.to_pylist(), words)[:2])
        parts = np.split(h, np.searchsorted(t, np.arange(1, len(encoded.dictionary))))
        return [parts[i] for i in encoded.indices.to_numpy()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2 * TEXTS_A_STEP):
                batch = whole.slice(at, 2 * TEXTS_A_STEP)
                jac = np.empty(batch.num_rows)
                for i, (x, y) in enumerate(zip(sets(batch.column(2)), sets(batch.column(3)))):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    jac[i] = both / max(1, len(x) + len(y) - both)
                keep = pa.array(np.flatnonzero(jac >= threshold - 1e-12))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep), pa.array(jac).take(keep)], names=["a", "b", "jaccard"])

    with_a = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    with_b = with_a.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    return with_b.select("a", "b", "ta", "tb").mapInArrow(run, "a bigint, b bigint, jaccard double")


def _texts_of(docs: DataFrame, signed: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node, text): one text of every node of ``pairs``."""
    needed = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    first = signed.groupBy("node").agg(F.min(F.struct("field", "id", "digest")).alias("r")).join(needed, "node", "left_semi").select("node", "r.*")
    own = _digested(docs)
    same: Column = own["field"].eqNullSafe(first["field"]) & own["id"].eqNullSafe(first["id"]) & (own["digest"] == first["digest"])
    return own.join(first, same).select("node", "text").groupBy("node").agg(F.first("text").alias("text"))


def classes_and_links(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, least_words: int = LEAST_WORDS) -> tuple[DataFrame, DataFrame]:
    """((field, id, node): the class of every text that takes part; (a, b, jaccard), a < b: links between classes of one field at or above the threshold).

    ``docs`` has the columns field, id, text. Texts with fewer than ``least_words`` words (or fewer than one shingle), null and empty ones take no part. Links inside a class
    (similarity 1) are implied by its members. Empty table: no rows.
    """
    signed = cut_lineage(signatures(docs, words, least_words, threshold))
    pairs = _survivors(signed, threshold)
    return signed.select("field", "id", "node"), _verified(pairs, _texts_of(docs, signed, pairs), words, threshold)


def review_and_description_texts(reviews: DataFrame, meta: DataFrame) -> DataFrame:
    """(field, id, text): reviews by review_id; descriptions by trimmed product, each product once (of differing ones the greatest text)."""
    r = reviews.filter(F.col("text").isNotNull()).select(F.lit("reviews.text").alias("field"), F.col("review_id").alias("id"), "text")
    m = (
        meta.select(F.trim("parent_asin").alias("id"), "description")
        .filter((F.col("id") != "") & F.col("description").isNotNull())
        .groupBy("id")
        .agg(F.max("description").alias("text"))
        .select(F.lit("meta_clean.description").alias("field"), "id", "text")
    )
    return r.unionByName(m)


def similar_pairs(docs: DataFrame, words: int, threshold: float, least_words: int) -> DataFrame:
    """(field, id_a, id_b), id_a < id_b: every pair of different ids at or above the threshold, copies included.

    The result of a class of n copies has n * (n - 1) / 2 rows by definition; ``groups`` is the form that stays linear.
    """
    who, links = classes_and_links(docs, words, threshold, least_words)
    a, b = who.select("field", F.col("id").alias("ia"), F.col("node").alias("a")), who.select(F.col("id").alias("ib"), F.col("node").alias("b"))
    across = links.join(a, "a").join(b, "b").select("field", F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b"))
    inside = a.join(b, F.col("a") == F.col("b")).filter("ia < ib").select("field", F.col("ia").alias("id_a"), F.col("ib").alias("id_b"))
    return across.unionByName(inside)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b): the least node it is connected with, by alternating large and small stars until nothing changes."""
    now = cut_lineage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    state = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        now = cut_lineage(small)
        after = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if after == state:
            break
        state = after
    roots = now.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def groups(docs: DataFrame, words: int, threshold: float, least_words: int) -> DataFrame:
    """(field, id, group_id, n_links): one row per text that takes part.

    ``group_id`` is the least id of the texts connected with it by links; ``n_links`` counts the other texts at or above the threshold (its copies and all members of linked classes).
    """
    who, links = classes_and_links(docs, words, threshold, least_words)
    links = cut_lineage(links.select("a", "b"))
    sizes = who.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("least"))
    two = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = two.join(sizes.select(F.col("node").alias("b"), "size"), "b").groupBy(F.col("a").alias("node")).agg(F.sum("size").alias("near"))
    roots = components(links)
    nodes = sizes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).join(near, "node", "left")
    names = nodes.groupBy("root").agg(F.min("least").alias("group_id"))
    info = nodes.join(names, "root").select("node", "group_id", (F.col("size") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"))
    return who.join(info, "node").select("field", "id", "group_id", "n_links")
