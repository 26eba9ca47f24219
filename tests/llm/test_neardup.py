"""Near-duplicates and cross-split overlap against brute force."""

import random
import re

import numpy as np
import pytest

from mailloom.llm import overlap
from mailloom.llm.graph import connected_components
from mailloom.llm.neardup import prefix_pairs, run_sets, similar_classes
from mailloom.llm.p3 import near_duplicate_groups, near_duplicate_pairs
from mailloom.llm.p4 import cross_split_pairs, split_records


def words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def shingles(t):
    w = words(t)
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)}


def similar(a, b, t=0.6):
    if len(words(a)) < 20 or len(words(b)) < 20:
        return False
    x, y = shingles(a), shingles(b)
    return len(x & y) >= t * len(x | y)


def corpus(n, seed, vocabulary=400, hot=0):
    rng = random.Random(seed)
    notice = " ".join(f"notice{i}" for i in range(60))
    base = [" ".join(f"w{rng.randrange(vocabulary)}" for _ in range(rng.choice([10, 20, 30, 60, 150]))) for _ in range(n // 5)]
    out = []
    for i in range(n):
        w = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(9999)}"
        text = " ".join(w)
        if i < hot:
            text = " ".join(f"h{rng.randrange(9999)}" for _ in range(rng.choice([8, 20, 60]))) + " " + notice
        out.append((i, rng.choice([None, "", f"<k{rng.randrange(n)}>", f" k{rng.randrange(n)}"]), text))
    out += [(n, "a", None), (n + 1, "b", ""), (n + 2, "c", "short text"), (n + 3, "d", out[0][2]), (n + 4, "d", out[0][2].upper() + "!!"), (n + 5, "e", "word " * 30), (n + 6, "f", "word " * 31)]
    return out


def key(m):
    return (m or "").strip().strip("<>").strip() or None


def pairs(rows):
    return {(a[0], b[0]) for i, a in enumerate(rows) for b in rows[i + 1 :] if similar(a[2], b[2]) and (key(a[1]) is None or key(a[1]) != key(b[1]))}


def table(spark, rows):
    return spark.createDataFrame([(*r, "z") for r in rows], "id long, message_id string, body string, text string")


@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_equal_brute_force(spark, seed):
    rows = corpus(200, seed)
    want = pairs(rows)
    got = {(r["id_a"], r["id_b"]) for r in near_duplicate_pairs(table(spark, rows)).collect()}
    assert got <= want and len(got) >= 0.99 * len(want)


def test_crowded_variants_take_the_exact_way(spark):
    rows = corpus(120, 3, hot=60)
    records = table(spark, rows).select("id", "message_id", "body").toDF("id", "tag", "text")
    members, links = similar_classes(records, hot=3)
    rep = {r["id"]: r["rep"] for r in members.collect()}
    got = {tuple(sorted((r["a"], r["b"]))) for r in links.collect()}
    texts = {i: t for i, _, t in rows}
    want = {tuple(sorted((rep[a], rep[b]))) for a in rep for b in rep if a < b and rep[a] != rep[b] and similar(texts[a], texts[b])}
    assert got == want


def test_prefix_filter_is_exact(spark):
    rows = [r for r in corpus(150, 4) if len(words(r[2])) >= 20]
    sets = run_sets(spark.createDataFrame([(i, t) for i, _, t in rows], "id long, text string"), 3)
    got = {(r["a"], r["b"]) for r in prefix_pairs(sets, 0.6).collect()}
    want = {(a[0], b[0]) for i, a in enumerate(rows) for b in rows[i + 1 :] if similar(a[2], b[2])}
    assert want <= got


def test_groups(spark):
    rows = corpus(120, 5)
    got = {r["id"]: r["group_id"] for r in near_duplicate_groups(table(spark, rows)).collect()}
    for a, b in {(a[0], b[0]) for i, a in enumerate(rows) for b in rows[i + 1 :] if similar(a[2], b[2], 0.61)}:
        assert got[a] == got[b]
    assert all(i not in got for i, _, t in rows if len(words(t)) < 20)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 30)] + [(100, 101), (103, 101), (200, 200)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 31)) and got[101] == got[103] == 100 and 200 not in got


def test_empty_tables(spark):
    empty = table(spark, corpus(10, 1)).limit(0)
    assert near_duplicate_pairs(empty).count() == 0 and near_duplicate_groups(empty).count() == 0


@pytest.mark.parametrize(("hot", "small"), [(0, False), (50, False), (50, True)])
def test_overlap_equals_brute_force(spark, monkeypatch, hot, small):
    if small:  # many shards and slices, single expansions
        for name, value in (("PASSAGES_A_SHARD", 300), ("PASSAGES_A_SLICE", 500), ("EXPANDED", 5), ("TEXTS_AT_ONCE", 3)):
            monkeypatch.setattr(overlap, name, value)
    rows = corpus(220, 6, hot=hot)
    rng = random.Random(9)
    place = {r[0]: rng.choice(["train", " Train ", "TEST", "eval", None, "other"]) for r in rows}
    place[223], place[224] = "train", "test"
    splits = spark.createDataFrame([(i, s) for i, s in place.items()] + [(0, place[0])], "id long, split_name string")
    emails = spark.createDataFrame([(*r, "f", "z") for r in rows], "id long, message_id string, body string, x_folder string, text string")
    side = {i: (s or "").strip().lower() for i, s in place.items()}
    want = {(a[0], b[0]) for a in rows for b in rows if side[a[0]] == "train" and side[b[0]] in ("test", "eval") and (similar(a[2], b[2]) or key(a[1]) and key(a[1]) == key(b[1]))}
    found = cross_split_pairs(emails, splits).collect()
    assert {(r["train_id"], r["eval_id"]) for r in found} == want
    text = {r[0]: r[2] for r in rows}
    for r in found:
        if r["similarity"] is None:
            assert r["by_identifier"] and not similar(text[r["train_id"]], text[r["eval_id"]])
            continue
        other, w = shingles(text[r["train_id"]]), words(text[r["eval_id"]])
        covered = {k for i in range(len(w) - 2) if tuple(w[i : i + 3]) in other for k in (i, i + 1, i + 2)}
        assert r["covered"] == len(covered) and r["coverage"] == pytest.approx(len(covered) / len(w))


def test_overlap_in_families_of_many_evaluation_versions(spark):
    """Every passage of a family is frequent, and excerpts hold few of them; no pair may be lost."""
    rng = random.Random(4)
    rows = []
    for family in range(8):
        base = [f"w{rng.randrange(5000)}" for _ in range(400)]
        for i in range(24):
            size = 400 if i < 12 else int(400 * rng.uniform(0.63, 0.68))
            at = rng.randrange(401 - size)
            w = base[at : at + size]
            for _ in range(2 if i < 12 else i % 2):
                w[rng.randrange(size)] = f"x{rng.randrange(99999)}"
            rows.append((100 * family + i, None, " ".join(w)))
    splits = spark.createDataFrame([(r[0], "eval" if r[0] % 100 < 12 else "train") for r in rows], "id long, split_name string")
    emails = spark.createDataFrame([(*r, "f") for r in rows], "id long, message_id string, body string, x_folder string")
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] % 100 >= 12 > b[0] % 100 and a[0] // 100 == b[0] // 100 and similar(a[2], b[2])}
    got = {(r["train_id"], r["eval_id"]) for r in cross_split_pairs(emails, splits).collect()}
    assert len(want) > 300 and got == want, (len(got), len(want))


def test_parts_by_length():
    got = overlap.parts_by_length([(3, 40), (1, 5), (2, 4), (4, 1), (5, 9), (6, 2)], 10)
    assert got == [(1, 0, 1), (2, 0, 1), (3, 1, 4), (4, 5, 1), (5, 5, 1), (6, 6, 1)]
    assert overlap.parts_by_length([], 10) == []


def test_overlap_without_one_side(spark):
    emails = spark.createDataFrame([(1, "a", "x " * 30, "f"), (2, "b", None, "f")], "id long, message_id string, body string, x_folder string")
    splits = spark.createDataFrame([(1, "train"), (2, None)], "id long, split_name string")
    assert cross_split_pairs(emails, splits).count() == 0
    assert split_records(emails, splits).count() == 1


@pytest.mark.parametrize("seed", range(4))
def test_index_loses_no_pair(monkeypatch, seed):
    monkeypatch.setattr(overlap, "ENTRIES_AT_ONCE", 7)
    rng = np.random.default_rng(seed)
    order = rng.integers(1, 2**63, 3000, dtype=np.uint64)  # the rarest first
    sets = []
    for _ in range(160):
        base = sets[rng.integers(len(sets))] if sets and rng.random() < 0.7 else rng.choice(3000, rng.choice([1, 3, 12, 40, 120]), replace=False)
        kept = base[rng.random(len(base)) < rng.choice([0.7, 0.9, 1])]
        sets.append(np.unique(np.concatenate([kept if len(kept) else base, rng.choice(3000, rng.choice([0, 0, 1, 5]), replace=False)])))
    n = np.array([len(x) for x in sets])
    held = overlap._early(n, 0.6)
    early = [order[x[:k]] for x, k in zip(sets, held)]
    index = overlap.Index(np.arange(80), n[:80], np.concatenate(early[:80]), 0.6)
    got = [(80 + a, b) for y, x in index.candidates(n[80:], np.concatenate(early[80:])) for a, b in zip(y.tolist(), x.tolist())]
    shared = {(a, b): len(np.intersect1d(sets[a], sets[b])) for a in range(80, 160) for b in range(80)}
    want = {(a, b) for (a, b), s in shared.items() if s >= 0.6 * (n[a] + n[b] - s)}
    assert len(got) == len(set(got)) and want and want <= set(got)


def test_training_texts_without_similar_ones_are_not_scanned(spark, monkeypatch):
    """Texts of one length and template: only pairs that are similar, or nearly so, reach the automata, however many there are."""
    for name, value in (("ENTRIES_A_SHARD", 2000), ("PASSAGES_A_SLICE", 3000)):
        monkeypatch.setattr(overlap, name, value)
    rng = random.Random(3)
    template = [f"t{i}" for i in range(40)]
    texts = [template + [f"w{rng.randrange(300)}" for _ in range(60)] for _ in range(300)]
    texts += [t[:-2] + ["new", "end"] for t in texts[:20]]
    rows = [(i < 100, i, " ".join(t), len(shingles(" ".join(t)))) for i, t in enumerate(texts)]
    found = overlap.candidates(spark.createDataFrame(rows, "evaluation boolean, rep long, line string, n int"), 3, 0.6)
    got = [(r["train"], r["evaluation"]) for r in found.collect()]
    assert set(got) == {(300 + i, i) for i in range(20)} and len(got) == 20
