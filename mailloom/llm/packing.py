"""Filling fixed-capacity containers by bin completion.

Items only matter by their size, and sizes are whole tokens up to the capacity, so the search runs over a
histogram of at most `capacity` entries whatever the number of items. Containers are completed one after another
around the largest size left. The best-fit filling is the incumbent; where it wastes room, branch and bound goes
through the sizes in descending order and cuts a branch unless the smaller sizes left, as often as they are left, can
still reach the least waste there is (all their sums are known as bits). The bound is exact, so a branch that stays
always ends in a filling of least waste and the search needs no limit. Of fillings of equal waste the one with the
most of the largest sizes is taken: no other dominates it, for merging items of a filling into larger ones that it
could hold instead gives more of a larger size. The filling found is used as often as the histogram holds it. What
comes out is a list of patterns; items take their places in them by their rank within their size, computed by
counting, and frequent sizes are ranked in parts, so no size with a third of all items is a hot group.
"""

from __future__ import annotations

import bisect
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mailloom.session import written

ITEMS_A_SALT = 1_000_000  # of one size, ranked by one task


def sums(room: int, counts: dict[int, int], sizes: list[int]) -> list[int]:
    """For each k, as bits: the sums up to room of the first k sizes, each at most as often as it is left."""
    every = (1 << (room + 1)) - 1
    out = [1]
    for size in sizes:
        bits, n, step = out[-1], min(counts[size], room // size), 1
        while n > 0 and bits != every:
            step = min(step, n)
            bits |= (bits << (size * step)) & every
            n, step = n - step, step * 2
        out.append(bits)
    return out


def completion(room: int, counts: dict[int, int], sizes: list[int]) -> list[int]:
    """Sizes (descending) that fill `room` with least waste, undominated. sizes: ascending, with counts > 0."""
    best, space, used = [], room, Counter()
    at = len(sizes) - 1
    while at >= 0:  # the incumbent: best fit, one after another
        at = min(at, bisect.bisect_right(sizes, space) - 1)
        if at >= 0 and used[sizes[at]] < counts[sizes[at]]:
            best.append(sizes[at])
            used[sizes[at]] += 1
            space -= sizes[at]
        else:
            at -= 1
    if not space:
        return best
    reached = sums(room, counts, sizes)
    wanted = reached[-1].bit_length() - 1  # the bound: the largest sum of all
    if room - wanted >= space:
        return best
    out: list[int] = []
    for k in range(len(sizes) - 1, -1, -1):
        size = sizes[k]
        # The most of this size after which the smaller ones can still reach the rest.
        n = next(n for n in range(min(counts[size], wanted // size), -1, -1) if reached[k] >> (wanted - n * size) & 1)
        out += [size] * n
        wanted -= n * size
    return out


def patterns(histogram: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Fillings and how often each is used; together they hold the histogram exactly."""
    counts = {s: n for s, n in histogram.items() if n > 0 and 0 < s <= capacity}
    sizes = sorted(counts)
    out: list[tuple[list[int], int]] = []
    while sizes:
        size = sizes[-1]
        counts[size] -= 1
        filling = [size, *completion(capacity - size, counts, [s for s in sizes if s <= capacity - size and counts[s] > 0])]
        counts[size] += 1
        need = Counter(filling)
        times = min(counts[s] // n for s, n in need.items())
        for s, n in need.items():
            counts[s] -= n * times
            if not counts[s]:
                del counts[s]
                sizes.pop(bisect.bisect_left(sizes, s))
        out.append((filling, times))
    return out


def packed(items: DataFrame, capacities: list[tuple[str, int]]) -> DataFrame:
    """(doc_id, tokens) to (container, bin_no, doc_id, piece_no, tokens): every item in every container kind.

    An item over the capacity is cut into full pieces and a rest; no other is. Items of null size count as
    empty; an empty item takes no room and lies in some bin (bin 0 where there is no other). Bins are numbered
    from 0 in each container kind. Equal doc_ids are items of their own.
    """
    spark = items.sparkSession
    size = F.coalesce("tokens", F.lit(0))
    # Each container kind's items; the kinds are few (a literal list), so this is one map, not a join.
    cut = items.select("doc_id", size.alias("tokens"), F.explode(F.array(*[F.struct(F.lit(n).alias("container"), F.lit(c).alias("capacity")) for n, c in capacities if c and c > 0])).alias("k")).select("doc_id", "tokens", "k.*")
    pieces = cut.select("container", "capacity", "doc_id", "tokens", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("tokens") / F.col("capacity")) - 1, F.lit(0)).cast("int"))).alias("piece_no"))
    pieces = pieces.select("container", "doc_id", "piece_no", F.least(F.col("tokens") - F.col("piece_no") * F.col("capacity"), F.col("capacity")).cast("int").alias("size"))
    counts = pieces.groupBy("container", "size").agg(F.count("*").alias("n"))  # at most capacity rows a kind
    salts = counts.select("container", "size", F.ceil(F.col("n") / ITEMS_A_SALT).cast("int").alias("salts"))
    frequent = written(salts.filter("salts > 1"), "frequent")
    salted = pieces.join(F.broadcast(frequent), ["container", "size"], "left")
    pieces = salted.select("container", "doc_id", "piece_no", "size", F.pmod(F.xxhash64("doc_id", "piece_no"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt"))

    counted = pieces.groupBy("container", "size", "salt").agg(F.count("*").alias("n")).toPandas()  # at most capacity rows a kind, and one for every ITEMS_A_SALT items
    counted = counted.sort_values(["container", "size", "salt"])
    counted["before"] = counted.groupby(["container", "size"])["n"].cumsum() - counted["n"]
    slots, bins = [], {}
    for name, capacity in capacities:
        mine = counted[counted["container"] == name]
        held: Counter = Counter()
        bin_no = 0
        for filling, times in patterns(mine[mine["size"] > 0].groupby("size")["n"].sum().to_dict(), capacity):
            for s, n in Counter(filling).items():
                # Ranks held[s] .. held[s] + n * times - 1 of this size: n of them in each of `times` bins from bin_no.
                slots.append((name, int(s), int(held[s]), int(n), int(times), int(bin_no)))
                held[s] += n * times
            bin_no += times
        bins[name] = max(bin_no, 1)
        zero = int(mine[mine["size"] == 0]["n"].sum())
        if zero:
            each = -(-zero // bins[name])
            slots.append((name, 0, 0, each, -(-zero // each), 0))
    offsets = spark.createDataFrame(counted[["container", "size", "salt", "before"]], "container string, size int, salt int, before long") if len(counted) else spark.createDataFrame([], "container string, size int, salt int, before long")
    places = pd.DataFrame(slots, columns=["container", "size", "first", "each", "times", "bin"])
    grouped = [(c, int(s), g[["first", "each", "bin"]].values.tolist()) for (c, s), g in places.groupby(["container", "size"])]
    table = spark.createDataFrame(grouped, "container string, size int, slots array<array<long>>")
    # Both tables are as small as the counts, with as many slots as there are patterns.
    rank = F.row_number().over(Window.partitionBy("container", "size", "salt").orderBy("doc_id", "piece_no")) - 1
    ranked = pieces.withColumn("r", rank).join(F.broadcast(offsets), ["container", "size", "salt"]).withColumn("r", F.col("r") + F.col("before")).join(F.broadcast(table), ["container", "size"])
    slot = F.element_at(F.filter("slots", lambda s: s[0] <= F.col("r")), -1)
    return ranked.withColumn("slot", slot).select("container", (F.col("slot")[2] + F.floor((F.col("r") - F.col("slot")[0]) / F.col("slot")[1])).cast("long").alias("bin_no"), "doc_id", "piece_no", F.col("size").alias("tokens"))
