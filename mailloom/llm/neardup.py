"""Near-duplicate records by meet-in-the-middle ball hashing.

A text's fingerprint is GROUPS groups of SYMBOLS symbols, each the minimum of one hash function over
the distinct word runs, so two texts of Jaccard similarity s agree in a symbol with probability s.
As a set of (position, symbol), two groups that differ in e positions have a symmetric difference of
2e: deleting the e differing symbols from either side meets in the middle, at half the distance. Each
group emits all variants within half the radius (its subsets of SYMBOLS - ERASED), the variants are
shuffled, and texts that share one are candidates. With 16 groups of 5 and one erasure a pair of
similarity 0.6 is missed with probability 0.0014, one of 0.7 with 6e-7. Candidates are verified exactly.

Texts of equal word sequence form one class first, so copies cost nothing. A variant that more than
HOT classes share doesn't emit its pairs: those classes are joined among themselves by an exact
prefix filter, under which a pair of the wanted similarity always shares one of its rarest runs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mailloom.llm.shingles import distinct_runs, runs, word_hashes
from mailloom.session import spread, written

GROUPS, SYMBOLS, ERASED = 16, 5, 1
HOT = 200
BLOCK = 512
BROADCAST_ROWS = 2_000_000  # of one long each: 16 MB
_RNG = np.random.default_rng(20240607)
MULTIPLIERS = _RNG.integers(1, 2**63, GROUPS * SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def fingerprints(texts: list[str | None], run: int, least: int, sketch: bool = True) -> tuple[np.ndarray, list[bytes | None], np.ndarray]:
    """Per text: whether it counts (words >= least), the digest of its word sequence, its symbols."""
    symbols = np.zeros((len(texts), len(MULTIPLIERS)), np.uint32)
    digests: list[bytes | None] = [None] * len(texts)
    counted = np.zeros(len(texts), bool)
    for at in range(0, len(texts), BLOCK):
        hashes, counts = word_hashes(texts[at : at + BLOCK], max(least, run))
        found, sizes = runs(hashes, counts, run)
        ends = np.cumsum(counts)
        full = np.flatnonzero(sizes)
        counted[at + full] = True
        for i in full:
            digests[at + i] = xxhash.xxh3_128_digest(hashes[ends[i] - counts[i] : ends[i]].tobytes())
        if sketch and len(full):
            starts = (np.cumsum(sizes) - sizes)[full]
            for j, a in enumerate(MULTIPLIERS):
                symbols[at + full, j] = np.minimum.reduceat(found * a, starts) >> np.uint64(32)
    return counted, digests, symbols


def fingerprinted(texts: DataFrame, run: int = 3, least: int = 20, symbols: bool = True) -> DataFrame:
    """(id, tag, text) to (id, tag, class binary, symbols array<int>) of the texts with at least `least` words; symbols are empty unless wanted."""
    sketch = symbols

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counted, digests, found = fingerprints(b.column("text").to_pylist(), run, least, sketch)
            at = np.flatnonzero(counted)
            found = found[at] if sketch else found[at, :0]
            flat = pa.array(found.view(np.int32).ravel())
            offsets = pa.array(np.arange(len(at) + 1, dtype=np.int32) * found.shape[1])
            kept = b.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([kept.column("id"), kept.column("tag"), pa.array([digests[i] for i in at], pa.binary()), pa.ListArray.from_arrays(offsets, flat)], names=["id", "tag", "class", "symbols"])

    return spread(texts.select("id", "tag", "text")).mapInArrow(scan, "id long, tag string, class binary, symbols array<int>")


def run_sets(texts: DataFrame, run: int) -> DataFrame:
    """(id, text) to (id, runs): the sorted distinct run hashes of each text."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, sizes = runs(*word_hashes(b.column("text").to_pylist()), run)
            sets = [np.unique(x) for x in np.split(found, np.cumsum(sizes)[:-1])] if len(sizes) else []
            flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))], names=["id", "runs"])

    return texts.select("id", "text").mapInArrow(scan, "id long, runs array<long>")


def variants(classes: DataFrame) -> DataFrame:
    """(rep, symbols) to (variant, rep): each group's subsets, hashed with their place."""
    symbols = F.col("symbols")
    keys = [
        F.xxhash64(F.lit(g * 64 + k), *[symbols[g * SYMBOLS + i] for i in kept])
        for g in range(GROUPS)
        for k, kept in enumerate(combinations(range(SYMBOLS), SYMBOLS - ERASED))
    ]
    return classes.select(F.explode(F.array(*keys)).alias("variant"), "rep")


def prefix_pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """Exact candidates (a, b) among (id, runs): a pair of at least `threshold` shares one of the rarest runs of both."""
    tokens = sets.select("id", F.size("runs").alias("n"), F.explode("runs").alias("token"))
    ranked = tokens.join(tokens.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1"), "token")
    # Runs of one text only can't be shared: they come first in the order, so they use up the prefix.
    shared = ranked.groupBy("id").agg(F.count("*").alias("held"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("df", "token")) + F.col("n") - F.col("held")
    prefix = ranked.join(shared, "id").withColumn("place", place).filter(F.col("place") <= F.col("n") - F.ceil(F.col("n") * threshold) + 1).select("token", "id", "n")
    a, b = prefix.toDF("token", "a", "na"), prefix.toDF("token", "b", "nb")
    fits = (F.col("a") < F.col("b")) & (F.col("na") >= F.col("nb") * threshold) & (F.col("nb") >= F.col("na") * threshold)
    return a.join(b, "token").filter(fits).select("a", "b").distinct()


def _small(keys: DataFrame) -> DataFrame:
    """The (written) keys of a join, broadcast up to BROADCAST_ROWS of them, counted first."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys


def only(texts: DataFrame, ids: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The texts of the (distinct) ids. Up to broadcast_rows ids (8 bytes each) are broadcast, counted first, so that the texts don't move; more are joined by shuffle."""
    few = ids.limit(broadcast_rows + 1).count() <= broadcast_rows
    return texts.join(F.broadcast(ids) if few else ids, "id", "left_semi")


def verified(pairs: DataFrame, texts: DataFrame, run: int, threshold: float) -> DataFrame:
    """(a, b, similarity) of the candidate pairs that reach the threshold. Only the candidates' texts move."""
    involved = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    held = written(only(texts.select("id", "text"), written(involved, "involved")).dropDuplicates(["id"]), "involved-texts")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sets = {}, {}
            for side in "ab":
                for i, text in zip(batch.column(side).to_pylist(), batch.column(f"text_{side}").to_pylist()):
                    ids.setdefault(i, text)
            sets = {i: distinct_runs(text, run) for i, text in ids.items()}
            a, b, kept = [], [], []
            for x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                if both and (s := both / (len(sets[x]) + len(sets[y]) - both)) >= threshold:
                    a.append(x), b.append(y), kept.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(kept, pa.float64())], names=["a", "b", "similarity"])

    both = pairs.join(held.toDF("a", "text_a"), "a").join(held.toDF("b", "text_b"), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(scan, "a long, b long, similarity double")


def similar_classes(records: DataFrame, run: int = 3, least: int = 20, threshold: float = 0.6, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """Of (id, tag, text): the members (id, tag, rep), and all pairs (a, b, similarity) of different texts' representatives.

    Texts under `least` words, null and empty ones have no class and no row among the members. rep is the
    smallest id of the texts of equal word sequence. Repeated ids are repeated members.
    """
    prints = written(fingerprinted(records, run, least), "prints")
    classes = prints.groupBy("class").agg(F.min("id").alias("rep"), F.first("symbols").alias("symbols"))
    classes = written(classes, "classes")
    every = variants(classes)
    # Combined before the shuffle, so that a variant of very many classes is no hot group: which are shared at all,
    # then by how many. Only rows of shared variants are joined.
    shared = written(every.groupBy("variant").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).filter("a < b").select("variant"), "shared")
    hits = written(every.join(_small(shared), "variant", "left_semi"), "hits")
    frequent = written(hits.groupBy("variant").agg(F.count("*").alias("texts")).filter(F.col("texts") > hot).select("variant"), "hot")
    cold = hits.join(_small(frequent), "variant", "left_anti")
    found = cold.toDF("variant", "a").join(cold.toDF("variant", "b"), "variant").filter("a < b").select("a", "b")
    crowded = hits.join(_small(frequent), "variant", "left_semi").select(F.col("rep").alias("id")).distinct()
    if not crowded.isEmpty():
        crowd = written(run_sets(only(records.select("id", "text"), crowded).dropDuplicates(["id"]), run), "crowd")
        found = found.union(prefix_pairs(crowd, threshold))
    pairs = written(found.distinct(), "candidates")
    members = prints.join(classes.select("class", "rep"), "class").select("id", "tag", "rep")
    return written(members, "members"), written(verified(pairs, records.select("id", "text"), run, threshold), "links")
