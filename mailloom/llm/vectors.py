"""The k most similar vectors of every vector, by multi-index hashing.

A rotation learned on a bounded sample (iterative quantisation) gives each unit vector a BITS-bit code, cut into
TABLES substrings, each indexed. By the pigeonhole principle codes within Hamming distance
TABLES * (PROBE + 1) - 1 agree within PROBE bits in some substring, so probing every substring's ball of
radius PROBE retrieves all of them (and most beyond); candidates are reranked by their floats. A query whose
k-th found neighbour is less similar than SURE, where the ball is known to lose neighbours, or that found
fewer than k, is answered by an exact scan of the block instead, in tiles.

The normalised vectors are written in blocks to the shared folder; each task streams the blocks past its own
queries, so neither the driver nor a shuffle ever holds the collection, and a task's memory is one block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailloom.functions.text import let
from mailloom.session import scratch_path

BITS, TABLES, PROBE = 64, 4, 2
WIDTH = 64  # values of a vector that takes part
SAMPLE = 20_000
BLOCK = 131_072
QUERIES_AT_ONCE = 512
QUERIES_A_TASK = 50_000  # a task holds its own queries and one block
SURE = 0.90
PRUNE = 22  # Hamming distance beyond which a candidate isn't reranked: cosine 0.9 gives 9.2 +- 2.8


def learned_rotation(sample: np.ndarray, rounds: int = 30, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Mean and BITS directions that keep the signs of the rotated sample close to its values; fewer rows than values: random ones.

    Vectors of more than BITS values are rotated within their BITS principal components, those of fewer get random directions besides.
    """
    rng = np.random.default_rng(seed)
    width = sample.shape[1]
    bits = min(width, BITS)
    mean = sample.mean(0) if len(sample) else np.zeros(width)
    x = sample - mean
    basis = np.eye(width)
    if width > BITS and len(x):
        basis = np.linalg.eigh(x.T @ x)[1][:, -BITS:]
        x = x @ basis
    turn = np.linalg.qr(rng.normal(size=(bits, bits)))[0]
    for _ in range(rounds if len(x) >= width else 0):
        signs = np.where(x @ turn >= 0, 1.0, -1.0)
        u, _, v = np.linalg.svd(x.T @ signs)
        turn = u @ v
    return mean, np.concatenate([basis[:, :bits] @ turn if width > BITS else turn, rng.normal(size=(width, BITS - bits))], 1)


def balls(bits: int, radius: int) -> np.ndarray:
    """All masks of at most `radius` set bits."""
    masks = np.arange(1 << bits, dtype=np.uint32)
    return masks[np.bitwise_count(masks) <= radius].astype(np.int64)


class Block:
    """Index over one block of vectors: per substring, the rows sorted by its value and each value's start."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, mean: np.ndarray, turn: np.ndarray) -> None:
        self.ids, self.vectors = ids, vectors
        self.codes = codes(vectors, mean, turn)
        self.tables = []
        for t in range(TABLES):
            part = substring(self.codes, t)
            order = np.argsort(part, kind="stable").astype(np.int32)
            self.tables.append((order, np.searchsorted(part[order], np.arange((1 << BITS // TABLES) + 1)).astype(np.int32)))

    def candidates(self, query_codes: np.ndarray, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (query, row) pairs within PRUNE bits that share a probed substring."""
        found = []
        for t, (order, starts) in enumerate(self.tables):
            probes = substring(query_codes, t)[:, None] ^ masks[None, :]
            first = starts[probes]
            n = starts[probes + 1] - first
            q, p = np.nonzero(n)
            first, n = first[q, p], n[q, p]
            ends = np.cumsum(n)
            row = order[np.repeat(first - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
            q = np.repeat(q, n)
            near = np.bitwise_count(query_codes[q] ^ self.codes[row]) <= PRUNE
            found.append(q[near].astype(np.int64) * len(self.ids) + row[near])
        pairs = np.unique(np.concatenate(found))
        return pairs // len(self.ids), pairs % len(self.ids)


def codes(vectors: np.ndarray, mean: np.ndarray, turn: np.ndarray) -> np.ndarray:
    bits = (vectors - mean.astype(np.float32)) @ turn.astype(np.float32) >= 0
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()


def substring(code: np.ndarray, t: int) -> np.ndarray:
    width = BITS // TABLES
    return ((code >> np.uint64(t * width)) & np.uint64((1 << width) - 1)).astype(np.int64)


def best(query: np.ndarray, ids: np.ndarray, similarity: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of each query: by similarity, ties to the smaller id."""
    order = np.lexsort((ids, -similarity, query))
    query, ids, similarity = query[order], ids[order], similarity[order]
    place = np.arange(len(query)) - np.searchsorted(query, query)
    kept = place < k
    return query[kept], ids[kept], similarity[kept]


def usable(vectors: DataFrame, width: int = WIDTH) -> DataFrame:
    """(vec_id, embedding) of unit length in double precision, of the vectors that take part: not null, of the width, finite, not all zero. Repeated ids count once."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    square = F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v)
    # A null or non-finite element makes the sum of squares null or non-finite.
    kept = vectors.filter(F.size("embedding") == width).select("vec_id", x.alias("x"), F.sqrt(square).alias("norm"), *[c for c in ("label",) if c in vectors.columns])
    kept = kept.filter("norm > 0 and norm < double('infinity') and not isnan(norm) and vec_id is not null")
    return kept.select("vec_id", let(F.col("norm"), lambda n: F.transform("x", lambda v: v / n)).alias("embedding")).dropDuplicates(["vec_id"])


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), -1)


def nearest(vectors: DataFrame, k: int = 10, block: int = BLOCK, width: int = WIDTH) -> DataFrame:
    """(query_id, vec_id, similarity): the k most similar other vectors of every usable vector, cosine, ties to the smaller id.

    Vectors that are null, of another length than width, all zero or not finite take no part. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    path = scratch_path(spark, "vectors")
    # Rows in the order of a hash, so that blocks are alike; a file holds at most `block` rows.
    usable(vectors, width).write.option("maxRecordsPerFile", block).option("compression", "zstd").parquet(path)
    table = spark.read.schema("vec_id long, embedding array<double>").parquet(path)
    total = table.count()
    if not total:
        return spark.createDataFrame([], "query_id long, vec_id long, similarity double")
    share = min(1.0, SAMPLE / total)
    sample = [r[0] for r in table.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) < int(share * 1_000_000)).select("embedding").limit(2 * SAMPLE).collect()]
    mean, turn = learned_rotation(np.array(sample, np.float64).reshape(len(sample), -1) if sample else np.zeros((0, width)))
    masks = balls(BITS // TABLES, PROBE)

    def blocks() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        fs, root = pafs.FileSystem.from_uri(path)
        ids, rows, held = [], [], 0
        for f in sorted(fs.get_file_info(pafs.FileSelector(root)), key=lambda f: f.path):
            if not f.path.endswith(".parquet"):
                continue
            t = pq.read_table(f.path, filesystem=fs)
            if held and held + len(t) > block:
                yield np.concatenate(ids), np.concatenate(rows)
                ids, rows, held = [], [], 0
            if len(t):
                ids.append(t["vec_id"].to_numpy())
                rows.append(_matrix(t["embedding"]).astype(np.float32))
                held += len(t)
        if held:
            yield np.concatenate(ids), np.concatenate(rows)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column("vec_id").to_numpy(), _matrix(b.column("embedding"))) for b in batches if b.num_rows]
        if not held:
            return
        query_ids, queries = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
        single = queries.astype(np.float32)
        query_codes = codes(single, mean, turn)
        found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))
        for ids, rows in blocks():
            index, parts = Block(ids, rows, mean, turn), [found]
            for at in range(0, len(queries), QUERIES_AT_ONCE):
                span = slice(at, at + QUERIES_AT_ONCE)
                q, r = index.candidates(query_codes[span], masks)
                sim = np.einsum("ij,ij->i", single[span][q], rows[r])
                other = query_ids[span][q] != ids[r]
                q, i, sim = best(q[other], ids[r[other]], sim[other], k)
                parts.append((q + at, i, sim))
            found = best(*(np.concatenate(x) for x in zip(*parts)), k)
        # Queries whose neighbours, over all blocks, are too few or too far for the ball are scanned exactly.
        n, low = np.bincount(found[0], minlength=len(queries)), np.full(len(queries), 2.0)
        np.minimum.at(low, found[0], found[2])
        unsure = np.flatnonzero((n < min(k, total - 1)) | (low < SURE))
        if len(unsure):
            certain = ~np.isin(found[0], unsure)
            exact = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))
            for ids, rows in blocks():
                parts = [exact]
                for at in range(0, len(unsure), QUERIES_AT_ONCE // 4):
                    asked = unsure[at : at + QUERIES_AT_ONCE // 4]
                    dots = single[asked] @ rows.T
                    dots[query_ids[asked][:, None] == ids[None, :]] = -2
                    # All ties at the edge take part, so that the smaller id can win.
                    edge = -np.partition(-dots, k - 1, axis=1)[:, k - 1] if len(ids) > k else np.full(len(asked), -2.0)
                    q, r = np.nonzero((dots >= edge[:, None] - 1e-6) & (dots > -2))
                    parts.append(best(asked[q], ids[r], dots[q, r], k))
                exact = best(*(np.concatenate(x) for x in zip(*parts)), k)
            found = tuple(np.concatenate([f[certain], e]) for f, e in zip(found, exact))
        yield pa.RecordBatch.from_arrays([pa.array(query_ids[found[0]]), pa.array(found[1]), pa.array(found[2].astype(np.float64))], names=["query_id", "vec_id", "similarity"])

    tasks = max(-(-total // QUERIES_A_TASK), min(4 * spark.sparkContext.defaultParallelism, -(-total // 200)))
    return table.repartition(tasks, "vec_id").mapInArrow(scan, "query_id long, vec_id long, similarity double")
