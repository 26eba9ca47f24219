"""Exact nearest neighbours by inner product of unit vectors, in blocks.

The reference side is written in files of at most BLOCK rows to the shared folder; each task streams them past its
own queries with one matrix product per tile and keeps the k best, so memory is one tile and nothing is collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailloom.functions.text import let
from mailloom.session import scratch_path, spread, written

BLOCK, TILE = 65_536, 256  # a tile of similarities: 128 MB


def normalised(embedding: Column) -> Column:
    """Unit length in double precision; a zero vector stays zero, null stays null."""
    norm = lambda x: F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))
    divided = lambda x: let(norm(x), lambda n: F.transform(x, lambda v: F.when(n > 0, v / n).otherwise(v)))
    return let(F.transform(embedding, lambda v: v.cast("double")), divided)


def inner(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def masked_mean(tokens: Column, mask: Column, width: int) -> Column:
    """Mean of the token vectors whose mask is 1, per dimension; zeros where none is."""
    kept = F.transform(F.filter(F.arrays_zip(tokens.alias("t"), mask.alias("m")), lambda x: x["m"] == 1), lambda x: x["t"])
    dimension = lambda i: F.coalesce(F.aggregate(kept, F.lit(0.0), lambda s, v: s + F.get(v, i).cast("double")) / F.nullif(F.size(kept), F.lit(0)), F.lit(0.0))
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), dimension)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def knn(queries: DataFrame, reference: DataFrame, k: int, exclude_self: bool = False, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, neighbour_id, similarity): of (id, embedding) tables, the k best by cosine, ties to the smaller id.

    exclude_self drops the row of the same id (not rank 0, which among equal vectors need not be the row itself).
    Null and wrong-length vectors take no part: the width is the reference's most frequent one. Fewer than k
    neighbours give fewer rows; an empty side gives none.
    """
    spark = reference.sparkSession
    path = scratch_path(spark, "knn")
    usable = reference.filter("id is not null and embedding is not null").select("id", normalised(F.col("embedding")).alias("embedding"), F.size("embedding").alias("w"))
    width = usable.groupBy("w").count().orderBy(F.desc("count"), "w").limit(1).collect()
    if not width:
        return spark.createDataFrame([], "query_id long, rank int, neighbour_id long, similarity double")
    w = width[0][0]
    usable.filter(F.col("w") == w).select("id", "embedding").write.option("maxRecordsPerFile", block).parquet(path)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column("id").to_numpy(), _matrix(b.column("embedding"))) for b in batches if b.num_rows]
        if not held:
            return
        ids, x = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
        best = Best(len(ids), k)
        for ref_ids, ref in tiles(path):
            for at in range(0, len(ids), TILE):
                sim = x[at : at + TILE] @ ref.T
                if exclude_self:
                    sim[ids[at : at + TILE][:, None] == ref_ids[None, :]] = -np.inf
                best.take(at, sim, ref_ids)
        yield pa.RecordBatch.from_arrays([pa.array(ids[best.query]), pa.array(best.ranks()), pa.array(best.ids), pa.array(best.similarity)], names=["query_id", "rank", "neighbour_id", "similarity"])

    asked = queries.filter(F.col("id").isNotNull() & (F.size("embedding") == w)).select("id", normalised(F.col("embedding")).alias("embedding"))
    return spread(asked).mapInArrow(scan, "query_id long, rank int, neighbour_id long, similarity double")


def tiles(path: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The written rows (id, embedding), a file at a time."""
    fs, root = pafs.FileSystem.from_uri(path)
    for f in sorted(fs.get_file_info(pafs.FileSelector(root)), key=lambda f: f.path):
        if f.path.endswith(".parquet"):
            t = pq.read_table(f.path, filesystem=fs, columns=["id", "embedding"]).combine_chunks()
            if len(t):
                yield t["id"].to_numpy(), _matrix(t["embedding"].chunk(0))


class Best:
    """The k most similar of each query so far, by similarity (to 12 digits), ties to the smaller id; flat arrays in that order."""

    def __init__(self, queries: int, k: int) -> None:
        self.k = k
        self.query, self.ids, self.similarity = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.edge = np.full(queries, -np.inf)  # what a query's k-th has

    def take(self, at: int, sim: np.ndarray, ids: np.ndarray) -> None:
        """Similarities of the queries from `at` on to all ids. Only entries that reach the k-th found, here or before, are sorted."""
        edge = self.edge[at : at + len(sim)]
        if sim.shape[1] > self.k:
            edge = np.maximum(edge, np.partition(sim, sim.shape[1] - self.k, axis=1)[:, sim.shape[1] - self.k])
        q, r = np.nonzero((sim >= edge[:, None] - 1e-11) & (sim > -np.inf))
        query = np.concatenate([self.query, q + at])
        found, similarity = np.concatenate([self.ids, ids[r]]), np.concatenate([self.similarity, sim[q, r]])
        order = np.lexsort((found, -np.round(similarity, 12), query))
        query = query[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        kept = place < self.k
        self.query, self.ids, self.similarity = query[kept], found[order][kept], similarity[order][kept]
        last = place[kept] == self.k - 1
        self.edge[self.query[last]] = self.similarity[last]

    def ranks(self) -> np.ndarray:
        return (np.arange(len(self.query)) - np.searchsorted(self.query, self.query)).astype(np.int32)


def similarity_features(neighbours: DataFrame, labels: DataFrame, zero_fill: bool = False) -> DataFrame:
    """The eight similarity features per query of (query_id, neighbour_id, similarity) and (id, label in 0, 1 or other).

    Means by class are over the class's neighbours, zero without any; zero_fill divides by all neighbours instead.
    """
    known = labels.groupBy(F.col("id").alias("neighbour_id")).agg(F.first("label").alias("label"))
    rows = neighbours.join(known, "neighbour_id", "left")

    def mean(label: int) -> Column:
        hit = F.when(F.col("label") == label, F.col("similarity"))
        return F.sum(F.coalesce(hit, F.lit(0.0))) / F.count("*") if zero_fill else F.coalesce(F.avg(hit), F.lit(0.0))

    s = F.col("similarity")
    out = rows.groupBy(F.col("query_id").alias("id")).agg(
        F.max(s).alias("max_similarity"), F.avg(s).alias("mean_similarity"), F.stddev_pop(s).alias("std_similarity"),
        F.avg(s).alias("top_k_mean_similarity"), F.stddev_pop(s).alias("top_k_std_similarity"), mean(1).alias("top_k_pos_similarity"), mean(0).alias("top_k_neg_similarity"),
    )
    return out.withColumn("gap_similarity", F.col("top_k_pos_similarity") - F.col("top_k_neg_similarity"))


def without_first(neighbours: DataFrame) -> DataFrame:
    """Neighbours without rank 0, which among equal vectors need not be the row itself; the others move up."""
    return neighbours.filter("rank > 0").withColumn("rank", F.col("rank") - 1)


def in_sample_features(vectors: DataFrame, labels: DataFrame, k: int = 10, strict: bool = False) -> DataFrame:
    """Features of each row of (id, embedding) against all others; strict leaves out the nearest row instead of the row itself."""
    if strict:
        return similarity_features(without_first(knn(vectors, vectors, k + 1)), labels)
    return similarity_features(knn(vectors, vectors, k, exclude_self=True), labels)


def out_of_sample_features(queries: DataFrame, vectors: DataFrame, labels: DataFrame, k: int = 10) -> DataFrame:
    """Features of new rows against a fixed table; raises if that is empty."""
    if vectors.isEmpty():
        raise ValueError("the reference vectors are empty")
    return similarity_features(knn(queries, vectors, k), labels)


def max_similarity(texts: DataFrame, terms: DataFrame, group: str = "lexicon") -> DataFrame:
    """(id, group, similarity): largest cosine of each (id, embedding) row with the (group, id, embedding) terms of each group.

    All groups are read in one pass over the texts; the result is joined by key, never by position. Null and wrong-length vectors take no part.
    """
    spark = texts.sparkSession
    names = [r[0] for r in terms.select(group).distinct().orderBy(group).collect()]  # lexicons
    path = scratch_path(spark, "terms")
    number = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))])[F.col(group)] if names else F.lit(0)
    kept = terms.filter(F.col("embedding").isNotNull() & F.col(group).isNotNull())
    width = kept.groupBy(F.size("embedding").alias("w")).count().orderBy(F.desc("count"), "w").limit(1).collect()
    w = width[0][0] if width else 0
    kept.filter(F.size("embedding") == w).select(number.cast("long").alias("id"), normalised(F.col("embedding")).alias("embedding")).write.option("maxRecordsPerFile", BLOCK).parquet(path)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column("id").to_numpy(), _matrix(b.column("embedding"))) for b in batches if b.num_rows]
        if not held:
            return
        ids, x = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
        best = np.full((len(ids), len(names)), -np.inf)
        for numbers, ref in tiles(path):
            order = np.argsort(numbers, kind="stable")
            here, starts = np.unique(numbers[order], return_index=True)
            for at in range(0, len(ids), TILE):
                top = np.maximum.reduceat(x[at : at + TILE] @ ref[order].T, starts, axis=1)
                best[at : at + TILE, here] = np.maximum(best[at : at + TILE, here], top)
        for at in range(0, len(ids), TILE):
            q, g = np.nonzero(best[at : at + TILE] > -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(ids[at + q]), pa.array([names[i] for i in g.tolist()], pa.string()), pa.array(best[at + q, g])], names=["id", group, "similarity"])

    asked = texts.filter(F.col("id").isNotNull() & (F.size("embedding") == w)).select("id", normalised(F.col("embedding")).alias("embedding"))
    return spread(asked).mapInArrow(scan, f"id long, {group} string, similarity double")


def semantic_scores(texts: DataFrame, terms: DataFrame, group: str = "lexicon") -> DataFrame:
    """(id, semantic): a map of each lexicon's largest similarity, as the semantic labelling functions read it; one entry per lexicon."""
    rows = max_similarity(texts, terms, group)
    return rows.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct(group, "similarity"))).alias("semantic"))


def near_duplicates_removed(mail: DataFrame, vectors: DataFrame, keys: list[str], threshold: float = 0.95) -> DataFrame:
    """Rows without cross-folder near-duplicates: among rows whose key (null parts never match) lies in more than one folder, those whose nearest other candidate is more similar than the threshold keep one row per key, the first by _ordinal.

    vectors: (id, embedding) by _ordinal. Fewer than two candidates: nothing is similar.
    """
    from mailloom.operators.analytics import multi_folder
    from mailloom.operators.ordered import keep_first

    flagged = written(multi_folder(mail, keys), "folders")
    candidates = flagged.filter("in_folders").select(F.col("_ordinal").alias("id")).join(vectors, "id")
    near = knn(candidates, candidates, 1, exclude_self=True).filter(F.col("similarity") > threshold).select(F.col("query_id").alias("_ordinal"), F.lit(True).alias("_near"))
    marked = written(flagged.join(near, "_ordinal", "left").withColumn("_duplicate", F.col("in_folders") & F.coalesce("_near", F.lit(False))), "marked")
    kept = keep_first(marked.filter("_duplicate").drop("_near"), keys, "_ordinal")
    return marked.filter("not _duplicate").drop("_near").unionByName(kept).drop("_duplicate", "in_folders")
