"""Tokens, packing, personal information, new text, reading level."""

import itertools
import random
import time
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from mailloom.llm import newtext, packing, personal, reading, tokens

PATH = f"{tokens.FOLDER}/byte_bpe_50k.tiktoken"


# -- tokens

ODD = [None, "", " ", "\n\n  x", "a  b   c", "naïve café 😀🎉 été", "don't we'll", "é" * 50, "<|endoftext|>", "x " * 40_000, "a" * 70_000, "tab\tand\r\nline  ", "12345 6,789.00", " word next"]


def test_ids_round_trip(spark):
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(ODD)], "doc_id long, text string, ids string")
    enc = tokens.encoding(PATH)
    rows = {r["doc_id"]: r["ids"] for r in tokens.encoded(df).collect()}
    assert len(rows) == len(ODD)
    for i, t in enumerate(ODD):
        assert rows[i] == (enc.encode_ordinary(t) if t else [])
        assert tokens.decode(rows[i], PATH) == (t or "")
    back = {r["doc_id"]: r["text"] for r in tokens.decoded(tokens.encoded(df)).collect()}
    assert back[5] == ODD[5]


def test_pieces_never_change_the_ids():
    rng = random.Random(1)
    enc = tokens.encoding(PATH)
    for _ in range(200):
        text = "".join(rng.choice(["a", "B", " ", "  ", "\n", "1", ".", "'s", "é", " ", "word"]) for _ in range(rng.randrange(80)))
        parts = list(tokens.pieces(text, 7))
        assert "".join(parts) == text
        assert [i for p in parts for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text)


def test_counts(spark):
    df = spark.createDataFrame([(1, "one two"), (2, None)], "doc_id long, text string")
    assert {r["doc_id"]: r["tokens"] for r in tokens.token_counts(df).collect()} == {1: 2, 2: 0}
    assert tokens.encoded(df.limit(0)).count() == 0


# -- packing

@pytest.mark.parametrize("seed", range(4))
def test_patterns_hold_every_item(seed):
    rng = random.Random(seed)
    histogram = Counter(min(100, int(rng.lognormvariate(3, 1)) + 1) for _ in range(rng.choice([1, 30, 500])))
    got, room = Counter(), 0
    for filling, times in packing.patterns(dict(histogram), 100):
        assert sum(filling) <= 100
        room += times
        for s in filling:
            got[s] += times
    assert got == histogram
    assert room <= -(-sum(s * n for s, n in histogram.items()) // 100) * 1.15 + 1


def test_completion_finds_an_exact_fill():
    assert sum(packing.completion(100, {60: 1, 55: 1, 45: 1, 20: 3}, [20, 45, 55, 60])) == 100


def test_completion_is_bounded_by_reachable_sums():
    """The one odd size comes first and must be left out: all even fillings after it waste one."""
    counts = {s: 3 for s in range(200, 400, 2)} | {399: 1}
    assert sum(packing.completion(5000, counts, sorted(counts))) == 5000
    rng = random.Random(5)
    for _ in range(200):
        counts = {rng.randrange(1, 60): rng.randrange(1, 4) for _ in range(5)}
        reach = {0}
        for s, n in counts.items():
            reach = {r + s * k for r in reach for k in range(n + 1)}
        got = packing.completion(97, counts, sorted(s for s in counts))
        assert sum(got) == max(r for r in reach if r <= 97) and all(got.count(s) <= counts[s] for s in got)


def fillings(room, counts):
    """All fillings, by brute force."""
    if not counts:
        return [()]
    (size, n), *rest = counts
    return [(size,) * k + f for k in range(min(n, room // size) + 1) for f in fillings(room - k * size, rest)]


def dominates(a, b):
    """Whether the items of b can be put into the items of a as if those were bins."""
    if not b:
        return True
    return any(dominates(sorted([*a[:i], x - b[0], *a[i + 1 :]], reverse=True), b[1:]) for i, x in enumerate(a) if x >= b[0])


def test_no_filling_dominates_a_completion():
    rng = random.Random(8)
    for _ in range(60):
        counts = {rng.randrange(2, 20): rng.randrange(1, 3) for _ in range(4)}
        got = tuple(packing.completion(30, counts, sorted(counts)))
        assert list(got) == sorted(got, reverse=True)
        every = fillings(30, sorted(counts.items(), reverse=True))
        equal = [f for f in every if sum(f) == sum(got) and f != got]
        assert not any(dominates(list(f), list(got)) for f in equal)


@pytest.mark.parametrize("at_once", [1_000_000, 7])
def test_packed_rows(spark, monkeypatch, at_once):
    monkeypatch.setattr(packing, "ITEMS_A_SALT", at_once)
    rng = random.Random(7)
    rows = [(i, rng.choice([None, 0, 3, 7, 7, 7, 12, 20, 47]), "z") for i in range(300)] + [(5, 7, "z")]
    out = packing.packed(spark.createDataFrame(rows, "doc_id long, tokens int, bin_no string"), [("s", 20), ("l", 50)]).collect()
    for kind, capacity in (("s", 20), ("l", 50)):
        mine = [r for r in out if r["container"] == kind]
        load, held = defaultdict(int), defaultdict(int)
        for r in mine:
            load[r["bin_no"]] += r["tokens"]
            held[r["doc_id"]] += r["tokens"]
        assert max(load.values()) <= capacity
        want = defaultdict(int)
        for i, t, _ in rows:
            want[i] += t or 0
        assert held == want
        assert all(r["piece_no"] == 0 for r in mine if want[r["doc_id"]] <= capacity)
        assert len(load) <= -(-sum(load.values()) // capacity) * 1.1 + 1
    assert packing.packed(spark.createDataFrame([], "doc_id long, tokens int"), [("s", 20)]).count() == 0


# -- personal information

PEOPLE = personal.People({"ximena", "mark", "may", "will", "declan"}, {"kovova", "garsanumi", "kovanumi", "kovaridge", "garsova", "garsaridge"})


def seen(text):
    return [(k, text[s:e]) for k, s, e in personal.detect(text, PEOPLE)]


@pytest.mark.parametrize("text,want", [
    ("Call +1 713 555 0181 if", [("phone", "+1 713 555 0181")]), ("desk (918) 555-0102 ext. 44", [("phone", "(918) 555-0102")]), ("at 555-0161.", [("phone", "555-0161")]),
    ("fax 4155550130 or 1-800-555-0131", [("phone", "4155550130"), ("phone", "1-800-555-0131")]), ("+44 20 7946 0602", [("phone", "+44 20 7946 0602")]),
    ("Meter 000-7129-7, ticket 4471-3406-90, part 555-014036, invoice 71355549786013", []),
    ("SSN 666-50-5025 and SSN 000488830", [("id_number", "666-50-5025"), ("id_number", "000488830")]), ("number is QQ 33 24 11 A,", [("id_number", "QQ 33 24 11 A")]),
    ("Passport no. X53512767 belongs", [("id_number", "X53512767")]), ("Driver licence NM-00305090 was", [("id_number", "NM-00305090")]), ("deal DL-430582", []),
    ("to a.b+c@mail.x.test.", [("email", "a.b+c@mail.x.test")]), ("ann at x dot test for", [("email", "ann at x dot test")]), ("a.b (at) x.test", [("email", "a.b (at) x.test")]), ("use build@rev5083", []),
    ("at 9136 Beacon Birchmoor Ln, Suite 500, Westendale, ask", [("address", "9136 Beacon Birchmoor Ln, Suite 500, Westendale")]), ("1004 Saddle Road, Westcreek, CO 30921", [("address", "1004 Saddle Road, Westcreek, CO 30921")]),
    ("The 24 Hour Drive plan", []), ("Millweg 81, 46599 Dunmacreek", [("address", "Millweg 81, 46599 Dunmacreek")]),
    ("Loop in Ximena before", [("name", "Ximena")]), ("of L. Garsanumi is", [("name", "L. Garsanumi")]), ("Kovova, Ximena's note", [("name", "Kovova, Ximena")]), ("Mr. Kovova", [("name", "Kovova")]),
    ("Declan Q. Kovova wrote:", [("name", "Declan Q. Kovova")]), ("Mark the field; we will; in May 20", []), ("Hi Mark,", [("name", "Mark")]), ("May Garsova", [("name", "May Garsova")]),
    ("XIMENA KOVOVA", [("name", "XIMENA KOVOVA")]), ("ximena kovova", [("name", "ximena kovova")]), (None, []), ("", []), ("x " * 50_000, []),
])
def test_detection(text, want):
    assert seen(text) == want


def test_surrogates_keep_form_and_distinctness():
    by = personal.Surrogates(b"key")
    numbers = [f"555-{i:04d}" for i in range(500)]
    new = [by("phone", n) for n in numbers]
    assert len(set(new)) == 500 and all(len(n) == 8 and n[3] == "-" for n in new)
    assert by("name", "Ximena Kovova") == personal.Surrogates(b"key")("name", "Ximena Kovova") != personal.Surrogates(b"other")("name", "Ximena Kovova")
    assert by("name", "XIMENA").isupper() and by("name", "Kovova, Ximena").split(", ")[0] == by("name", "Ximena Kovova").split()[1]
    assert re.fullmatch(r"[a-z]{3}@[a-z]{5}\.co\.uk", by("email", "ann@smith.co.uk")) and by("email", "ann@smith.org").endswith(".org")
    name, mail = by("name", "Ximena Kovova").lower().split(), by("email", "ximena.kovova2 (at) kovova dot org")
    assert mail.startswith(f"{name[0]}.{name[1]}") and mail.endswith(f" (at) {name[1]} dot org") and mail[len(name[0]) + len(name[1]) + 1] != "2"
    assert by("phone", "+44 20 7946 0602").startswith("+44 ") and by("phone", "+1 713 555 0181").startswith("+1 ")
    assert re.fullmatch(r"[A-Z]{2} \d\d \d\d \d\d [A-Z]", by("id_number", "QQ 12 34 56 C")) and by("id_number", "QQ 12 34 56 C")[:2] != "QQ"
    with pytest.raises(ValueError):
        personal.Surrogates(b"")
    assert personal.replaced("a Ximena b", [("name", 2, 8)], lambda k, _: f"[{k}]") == "a [name] b" and personal.replaced(None, [], by) is None


@pytest.mark.parametrize("mention,kept", [
    ("2023 Drover Avenue, Brenabluff, CO 40047", "Avenue"), ("12 MAPLE ROAD", "ROAD"), ("7 Oak Ln", "Ln"), ("9136 Beacon Birchmoor Ln, Suite 500, Westendale", "Ln Suite"), ("12 N. Oak Hill St. Apt. 4B, St Ives TX", "St Apt"),
    ("Millweg 81, 46599 Dunmacreek", ""), ("P.O. Box 12, Westcreek, CO 30921", "P O Box"), ("5 O'Neil Court #6, Unitville", "Court"), ("31A Old Reed Way", "Way"),
])
def test_surrogate_addresses_keep_no_word(mention, kept):
    new = personal.Surrogates(b"key")("address", mention)
    before, after = (re.findall(r"[^\W\d_]+", x) for x in (mention, new))
    assert [a for a, b in zip(before, after) if a == b] == kept.split() and len(before) == len(after)
    assert re.sub(r"\w", "", new) == re.sub(r"\w", "", mention) and re.findall(r"\d+", new) != re.findall(r"\d+", mention)
    assert mention != "Millweg 81, 46599 Dunmacreek" or after[0].endswith("weg")


def test_surrogates_are_functions_of_key_and_word():
    """Whatever a task saw before, a word gets the same surrogate; different words get different ones, also across tasks."""
    rng = random.Random(3)
    given = [a + b + c for a in ("xim", "dor", "kal", "per", "lun") for b in ("en", "or", "ab", "it") for c in ("a", "e", "o", "n", "ur")]
    words = given + ["Müller".lower(), "andré", "o", "a", "ürük", "иван", "李", "a.b+c_1", "a.b+c_2"]
    whole = {w: personal.Surrogates(b"key").word(w) for w in words}
    assert len(set(whole.values())) == len(words) and all(w != n and len(w) == len(n) for w, n in whole.items())
    for _ in range(3):
        by = personal.Surrogates(b"key")
        for w in rng.sample(words, len(words)):
            assert by.word(w) == whole[w]
    assert all((w[-1] in "aei") == (whole[w][-1] in "aei") for w in given)
    assert personal.Surrogates(b"key").word("XimenA") == "".join(n.upper() if c.isupper() else n for n, c in zip(personal.Surrogates(b"key").word("ximena"), "XimenA"))
    small = [a + b for a in "bcdfghjklmnpqrstvwxyz" for b in "aei"]
    assert sorted(map(personal.Surrogates(b"key").word, small)) == sorted(small)


def test_surrogates_agree_between_partitionings(spark):
    given = [a + b + c for a in ("Xim", "Dor", "Kal", "Per", "Lun") for b in ("en", "or", "ab", "it") for c in ("a", "e")]
    rows = [(i, None, f"Call {g} Kovova or {given[-i]} Garsova", None, None, None) for i, g in enumerate(given, 1)]
    emails = spark.createDataFrame(rows, "id long, subject string, body string, x_from string, x_to string, x_cc string")
    path = personal.collected_people(emails, spark.createDataFrame([(f"{g} Kovova",) for g in given], "owner_name string"))
    one, many = ({r["id"]: r["body"] for r in personal.rewritten(emails.repartition(n, "id"), path, b"key").collect()} for n in (1, 7))
    assert one == many
    new = {g: one[i].split()[1] for i, g in enumerate(given, 1)}
    assert len(set(new.values())) == len(given) and all(one[i].split()[4] == new[given[-i]] for i in range(1, len(given) + 1))


def test_mentions(spark):
    emails = spark.createDataFrame([(1, "Call Ximena", "Call Ximena, Ximena", "Kovova, Ximena", None, None), (2, None, "", "Garsova, Ximena", None, None)], "id long, subject string, body string, x_from string, x_to string, x_cc string")
    boxes = spark.createDataFrame([("Declan Kovova",)], "owner_name string")
    path = personal.collected_people(emails, boxes)
    got = {tuple(r) for r in personal.mentions(emails, path).collect()}
    assert got == {(1, "body", "name", "Ximena"), (1, "subject", "name", "Ximena")}
    rows = {r["id"]: r for r in personal.rewritten(emails, path).collect()}
    assert rows[1]["body"] == "Call [NAME], [NAME]" and rows[2]["subject"] is None
    assert personal.mentions(emails.limit(0), path).count() == 0


# -- new text

def old(body, x_from="Kovova, Ximena"):
    lines, kinds = newtext.segmented(body, x_from, None)
    return [i for i, (line, k) in enumerate(zip(lines, kinds), 1) if k and newtext.ALNUM.search(newtext.TAG.sub("", line))]


@pytest.mark.parametrize("body,want", [
    ("Hi Ann,\n\nPlease send it.\n\nThanks,\nXimena\nCounsel, Legal\nX Ltd | 555-0100", [5, 6, 7, 8]),
    ("Done.\n\nOn Mon, Jan 1, 2024 at 10:00 AM Ann B <a@b.test> wrote:\n> first\nmy answer to this one\n> second", [3, 4, 6]),
    ("See below\n\n-----Original Message-----\nFrom: Ann\nSent: Monday, May 1, 2023 10:00 AM\nTo: Ximena\nSubject: x\n\nold text goes here and on\nmore", [3, 4, 5, 6, 7, 9, 10]),
    ("Fine.\n\nX is registered under number 5. This note is no offer to buy or sell.", [3]), ("[EXTERNAL] This mail came from outside X.\nreal text", [1]),
    ("Thanks, will do.\nBR\n~Ximena\n\nPS: one more thing to say", [2, 3]), ("On July 15 the desk wrote: the price is closed.\nFrom: Larkaton to Corvingfield, flows stay", []),
    ("<p>text here<br>\n<blockquote>\n<p>old<br>\n</blockquote>\n", [3]), ("a\rb\r\rThanks\rXimena", [4, 5]), ("", []), (None, []), ("word " * 40_000, []),
])
def test_segments(body, want):
    assert old(body) == want


def test_old_lines(spark):
    df = spark.createDataFrame([(1, "x\nThanks,\nXimena", "Kovova, Ximena", None, "z"), (2, None, None, None, "z")], "id long, body string, x_from string, sender string, line_no string")
    assert {tuple(r) for r in newtext.old_lines(df).collect()} == {(1, 2), (1, 3)}
    assert {r["id"]: r["new_text"] for r in newtext.new_texts(df).collect()} == {1: "x", 2: None}
    assert newtext.old_lines(df.limit(0)).count() == 0


@pytest.mark.parametrize("longest", [2, 10])
def test_decoding_finds_the_best_segments(monkeypatch, longest):
    """Against all labellings of up to six atoms."""
    monkeypatch.setattr(newtext, "LONG_SIGNATURE", longest)
    kinds = [newtext.TEXT, newtext.QUOTE, newtext.BLOCK, newtext.CLOSING, newtext.NAME, newtext.LEGALS, newtext.WARN, newtext.PS, newtext.LINK]
    rng = random.Random(6)

    def score(atoms, labels):
        total, start = 0.0, 0
        for kind, run in itertools.groupby(labels):
            n = len(list(run))
            part = atoms[start : start + n]
            if start:
                total -= 2.0 if labels[start - 1] == newtext.SIGNATURE and kind == newtext.NEW and part[0] != newtext.PS else 0
            total += newtext.START.get((kind, part[0]), newtext.START_ELSE[kind] if start or kind != newtext.NEW else 0.0)
            block = False
            for i, c in enumerate(part):
                block |= c == newtext.BLOCK and kind == newtext.HISTORY
                total += 0 if block else newtext.EMIT[c][kind]
                if i < n - 1 and newtext.EMIT[c][kind] <= -9 and not block:
                    return -1e9
            total -= max(0, n - longest) if kind == newtext.SIGNATURE else 0
            total -= 5 if block and start + n < len(atoms) else 0
            start += n
        return total

    for _ in range(40):
        atoms = [rng.choice(kinds)]
        while len(atoms) < rng.randrange(2, 7):
            atoms.append(rng.choice([k for k in kinds if k != atoms[-1]]))
        best = max(score(atoms, labels) for labels in itertools.product(range(5), repeat=len(atoms)))
        assert score(atoms, newtext.decode(list(atoms))) == pytest.approx(best)


def test_decoding_is_linear():
    rng = random.Random(7)
    began = time.time()
    newtext.decode([rng.choice([newtext.TEXT, newtext.QUOTE, newtext.NAME, newtext.LINK]) for _ in range(50_000)])
    assert time.time() - began < 10


# -- reading level

SIMPLE, HARD = "The cat can see it . We went to the shop today . It is red and new . ", "The proposition that irrevocable jurisdictional prerequisites must be construed pursuant to consequential liabilities presupposes an epistemological equivalence . "


def test_reading(spark):
    rng = random.Random(2)
    rows, marks = [], []
    for i in range(160):
        n = rng.randrange(5)
        rows.append((i, (SIMPLE * (4 - n) + HARD * n) * 3, rng.choice(["a", "b", "c", "d"]), "z"))
        marks.append((i, n + 1))
    rows += [(900, None, "a", "z"), (901, "", "a", "z"), (902, "short", "a", "z"), (903, "Die Sitzung ist am Montag und wir haben noch nicht den Bericht für die Leitung. " * 4, "a", "z"), (904, "DL-1\t59,494\t$395.66\t2023-10-12\n" * 20, "a", "z"), (905, HARD * 600, "a", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, band string")
    model = reading.trained(docs, spark.createDataFrame([*marks, (1, None), (2, 9), (None, 3)], "doc_id long, band int"))
    got = {r["doc_id"]: r["band"] for r in reading.reading_bands(docs, model).collect()}
    assert not {900, 901, 902, 903, 904} & set(got) and got[905] == 5
    assert np.mean([got[i] == b for i, b in marks]) > 0.9
    assert np.mean([b == p for _, b, p in model.held_out]) > 0.85
    assert reading.trained(docs, spark.createDataFrame([], "doc_id long, band int")) is None
    assert reading.reading_bands(docs, None).count() == 0 and reading.reading_bands(docs.limit(0), model).count() == 0


def test_trees_learn_a_step():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 5))
    y = (x[:, 2] > 0) * 2.0 + (x[:, 0] > 1)
    assert np.abs(reading.Trees().fit(x, y).predict(x) - y).mean() < 0.1


def test_other_spellings_are_no_english():
    rng = random.Random(3)
    words = "please send the signed copy of contract before friday and call our office about further changes in price because board members asked for another review this week".split()
    texts = [reading.analysed(" ".join(rng.choice(words) for _ in range(60)) + ".") for _ in range(40)]
    model = reading.fitted(texts, np.array([1 + i % 2 for i in range(40)]), [f"s{i % 7}" for i in range(40)])
    polish = "Rada zatwierdziła sprawozdanie roczne po długiej dyskusji nad budżetem spółki i wydatkami planowanymi na przyszły rok, prosząc odpowiedzialnych o przedstawienie do marca szczegółowego planu działań."
    russian = "Совет утвердил годовой отчет после долгого обсуждения бюджета компании и расходов, запланированных на следующий год, попросив ответственных представить до марта подробный план действий на весь период."
    assert all(model.english(t) for t in texts)
    for other in (polish, russian):
        parts = reading.analysed(other)
        assert parts is None or not model.english(parts)
    assert len(model.held_out) == len(model.nested) == 40


def _plain_segments(text):
    parts = re.split(r"(?<=[.!?])\s+|[\r\n]+|(?<=[a-z]) and (?=[A-Z])", text)
    return [w for s in parts if len(w := re.findall(r"[^\W\d_]+(?:['’][^\W\d_]+)?", s.lower())) >= 2]


def _plain_features(parts, grades):
    """The features by their definition, one array operation each."""
    segments, digits, commas, chars = parts
    sizes, flat = np.array([len(s) for s in segments], float), [w for s in segments for w in s]
    lengths, g = np.array([len(w) for w in flat], float), np.array([grades.get(w, np.nan) for w in flat])
    starts, known = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(int), ~np.isnan(g)
    total, n = np.add.reduceat(np.where(known, g, 0.0), starts), np.add.reduceat(known.astype(float), starts)
    weight, rated = np.add.reduceat(lengths, starts) + sizes, n > 0
    grade = total[rated] / n[rated] if rated.any() else np.array([3.0])
    share = weight[rated] / weight[rated].sum() if rated.any() else np.array([1.0])
    mean, order = float(grade @ share), np.argsort(grade)
    cum = np.cumsum(share[order])
    bands = np.bincount(np.clip(np.rint(grade), 1, 5).astype(int), share, 6)[1:]
    bins = np.bincount(np.digitize(sizes, [6, 12, 22]), weight, 4) / weight.sum()
    pairs = [len(set(a) & set(b)) / min(len(a), len(b)) for a, b in zip(segments, segments[1:])]
    m = len(flat)
    return [
        np.log1p(m), lengths.mean(), (lengths >= 7).mean(), (lengths >= 10).mean(), (lengths >= 13).mean(), float(sizes @ weight / weight.sum()), sizes.std(),
        sum(w in reading.EN for w in flat) / m, sum(w in reading.SUBORDINATORS for w in flat) / m, commas / m, digits / chars, len(set(flat)) / m ** 0.8,
        float(np.mean(pairs)) if pairs else 0.0, mean, float(np.sqrt(share @ (grade - mean) ** 2)), float(grade[order][np.searchsorted(cum, 0.25)]),
        float(grade[order][min(np.searchsorted(cum, 0.75), len(cum) - 1)]), *bands, *bins, 1 - known.mean(),
    ]


def test_reading_features_by_their_definition_and_cheaper():
    rng = random.Random(8)
    words = (SIMPLE + HARD).replace(".", "").split() + ["don't", "it’s", "naïve", "ΟΔΟΣ", "x1y", "a_b", "12"]
    texts = ["".join(rng.choice(words) + rng.choice([" "] * 12 + [". ", "!\n", "?  ", "\r\n\n", ", ", " and ", ". ", "\t", " and The "]) for _ in range(rng.choice([30, 60, 200]))) for _ in range(150)]
    texts += [t.encode("ascii", "ignore").decode() for t in texts]
    assert [reading.analysed(t, 0)[0] for t in texts] == [_plain_segments(t) for t in texts]
    parts = [reading.analysed(t, 0) for t in texts]
    for grades in ({w: rng.uniform(1, 5) for w in map(str.lower, words[::2])}, {}):
        assert [reading.features(p, grades) for p in parts] == [_plain_features(p, grades) for p in parts]

    def took(f):
        began = time.process_time()
        f()
        return time.process_time() - began

    new, plain = (min(took(lambda: [f(p, grades) for p in parts]) for _ in range(7)) for f in (reading.features, _plain_features))
    assert new < 0.85 * plain, (new, plain)
