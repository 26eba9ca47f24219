"""Term lexicons: loading, coverage, mining of frequent phrases, and growth from similar text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.feature import RegexTokenizer, StopWordsRemover
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailloom.functions.text import sentences, text, word_pattern
from mailloom.operators.knn import knn
from mailloom.operators.ordered import keep_first
from mailloom.schemas import require

# A small list of our own, of function words: (lexicon, prototype, source, similarity).
SEEDS = [
    ("request", "please", "Seed", 1.0), ("request", "can you", "Seed", 1.0), ("request", "could somebody", "Generated", 0.8),
    ("urgency", "urgent", "Seed", 1.0), ("urgency", "as soon as possible", "Seed", 1.0), ("urgency", "by end of day", "Generated", 0.8),
    ("financial", "invoice", "Seed", 1.0), ("financial", "price", "Seed", 1.0), ("financial", "deposit", "Generated", 0.8),
    ("legal", "contract", "Seed", 1.0), ("legal", "licence", "Generated", 0.7),
    ("notification", "maintenance", "Seed", 1.0), ("notification", "heads up", "Generated", 0.8),
    ("bulk", "no offer to buy", "Seed", 1.0), ("bulk", "do not open links", "Generated", 0.7),
    ("automated", "this mail came from outside", "Seed", 1.0), ("automated", "registered under number", "Generated", 0.7),
]

# The English stop words that scikit-learn's vectorisers remove.
STOP_WORDS = (
    "a about above across after afterwards again against all almost alone along already also although always am among amongst amoungst amount an and "
    "another any anyhow anyone anything anyway anywhere are around as at back be became because become becomes becoming been before beforehand behind being "
    "below beside besides between beyond bill both bottom but by call can cannot cant co con could couldnt cry de describe detail do done down due during "
    "each eg eight either eleven else elsewhere empty enough etc even ever every everyone everything everywhere except few fifteen fifty fill find fire "
    "first five for former formerly forty found four from front full further get give go had has hasnt have he hence her here hereafter hereby herein "
    "hereupon hers herself him himself his how however hundred i ie if in inc indeed interest into is it its itself keep last latter latterly least less "
    "ltd made many may me meanwhile might mill mine more moreover most mostly move much must my myself name namely neither never nevertheless next nine no "
    "nobody none noone nor not nothing now nowhere of off often on once one only onto or other others otherwise our ours ourselves out over own part per "
    "perhaps please put rather re same see seem seemed seeming seems serious several she should show side since sincere six sixty so some somehow someone "
    "something sometime sometimes somewhere still such system take ten than that the their them themselves then thence there thereafter thereby therefore "
    "therein thereupon these they thick thin third this those though three through throughout thru thus to together too top toward towards twelve twenty "
    "two un under until up upon us very via was we well were what whatever when whence whenever where whereafter whereas whereby wherein whereupon wherever "
    "whether which while whither who whoever whole whom whose why will with within without would yet you your yours yourself yourselves"
).split()


def normalised_lexicon(raw: DataFrame, name: Column, skip: bool = False) -> DataFrame:
    """(lexicon, prototype, source, similarity, _ordinal): lower-cased and stripped, similarity 0 where it is no number, first row per prototype; empty prototypes dropped.

    A table without these columns raises ValueError, or with skip gives no rows.
    """
    if skip and {"prototype", "source", "similarity"} - set(raw.columns):
        return raw.sparkSession.createDataFrame([], "lexicon string, prototype string, source string, similarity double, _ordinal long")
    require(raw, "prototype", "source", "similarity")
    ordinal = F.col("_ordinal") if "_ordinal" in raw.columns else F.monotonically_increasing_id()
    rows = raw.select(name.alias("lexicon"), F.lower(F.trim("prototype")).alias("prototype"), F.lower(F.trim("source")).alias("source"), F.coalesce(F.col("similarity").try_cast("double"), F.lit(0.0)).alias("similarity"), ordinal.alias("_ordinal"))
    return keep_first(rows.filter("prototype <> ''"), ["lexicon", "prototype"], "_ordinal")


def seed_lexicon(spark: SparkSession) -> DataFrame:
    rows = [(*r, i) for i, r in enumerate(SEEDS)]
    return spark.createDataFrame(rows, "lexicon string, prototype string, source string, similarity double, _ordinal long")


TERMS = 100_000  # prototypes of all lexicons that may come to the driver


def terms(lexicon: DataFrame) -> dict[str, dict[str, list[str]]]:
    """Prototypes by lexicon and lower-cased source; lexicons are small dictionaries, of TERMS terms in all at most."""
    out: dict[str, dict[str, list[str]]] = {}
    rows = lexicon.limit(TERMS + 1).collect()
    if len(rows) > TERMS:
        raise ValueError(f"a lexicon of more than {TERMS} terms is no small dictionary")
    for r in sorted(rows, key=lambda r: (r["lexicon"], r["_ordinal"])):
        out.setdefault(r["lexicon"], {}).setdefault(r["source"].lower(), []).append(r["prototype"])
    return out


def matches(c: Column, words: list[str]) -> Column:
    pattern = word_pattern(words)
    return F.coalesce(c.rlike(pattern), F.lit(False)) if pattern else F.lit(False)


def coverage(mail: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(lexicon, seed_rate, all_rate, gain): share of mails that a lexicon's seeds, and all its terms, occur in; one scan for all lexicons."""
    body = F.concat_ws(" ", text(F.col("subject")), text(F.col("body")))
    known = terms(lexicon)
    rate = lambda words: F.avg(matches(F.col("_text"), words).cast("double"))
    counted = mail.withColumn("_text", body).agg(*[a for n, w in known.items() for a in (rate(w.get("seed", [])).alias(f"{n}_seed"), rate([x for s in w.values() for x in s]).alias(f"{n}_all"))])
    rows = F.array(*[F.struct(F.lit(n).alias("lexicon"), F.col(f"{n}_seed").alias("seed_rate"), F.col(f"{n}_all").alias("all_rate")) for n in known])
    return counted.select(F.explode(rows).alias("r")).select("r.*", (F.col("r.all_rate") - F.col("r.seed_rate")).alias("gain"))


def phrase_counts(df: DataFrame, column: str, phrases: list[str]) -> DataFrame:
    """(phrase, n): rows that contain each phrase between non-word characters, case-blind."""
    counted = df.agg(*[F.count_if(matches(F.col(column), [p])).alias(str(i)) for i, p in enumerate(phrases)])
    return counted.select(F.explode(F.array(*[F.struct(F.lit(p).alias("phrase"), F.col(str(i)).alias("n")) for i, p in enumerate(phrases)])).alias("r")).select("r.*")


SLOT_BITS = 20
SLOTS = 1 << SLOT_BITS  # counters of a task's sketch of n-grams: 8 MB


def word_runs(lists: pa.ListArray, low: int, high: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, pa.Array]]:
    """For each n: n, and of every run of n words its 64-bit hash, list and place among all tokens; and the tokens."""
    tokens = lists.flatten()
    coded = tokens.dictionary_encode()
    known = np.array([xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
    words = known[coded.indices.to_numpy()] if len(tokens) else np.zeros(0, np.uint64)
    sizes = np.diff(lists.offsets.to_numpy())
    doc = np.repeat(np.arange(len(sizes)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(words))  # words from here to the end of the list
    h = np.zeros(len(words), np.uint64)
    for n in range(1, high + 1):
        at = np.flatnonzero(left >= n)
        longer = np.zeros_like(h)
        x = (h[at] ^ words[at + n - 1]) * np.uint64(0x9E3779B97F4A7C15)
        longer[at] = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        h = longer
        if n >= low:
            yield n, h[at], doc[at], at, tokens


def frequent_phrases(df: DataFrame, column: str, stop_words: list[str], low: int = 3, high: int = 6, min_docs: int = 10, max_share: float = 0.8, top: int = 50_000, least_rate: float = 0.01) -> DataFrame:
    """(ngram, rate): mean occurrences per document of word n-grams, stop words removed first, from both ends of each text (1000 characters), as the boilerplate rule defines them.

    Kept: in at least min_docs and at most max_share of the documents, among the `top` most frequent, and above least_rate. A first pass counts hashes of n-grams in a sketch of fixed size; the second counts
    exactly those n-grams whose slot reaches the limits, so rare ones are never shuffled.
    """
    ends = F.concat(F.substring(text(F.col(column)), 1, 1000), F.lit(" "), F.right(text(F.col(column)), F.lit(1000)))
    base = df.select(F.lower(ends).alias("_t"))
    words = RegexTokenizer(inputCol="_t", outputCol="_w", pattern=r"[\p{L}\p{N}_]{2,}", gaps=False).transform(base)
    words = StopWordsRemover(inputCol="_w", outputCol="_s", stopWords=stop_words or [""]).transform(words)
    words = words.select("_s")
    total = df.count()

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SLOTS, np.int64)
        for b in batches:
            for _, h, _, _, _ in word_runs(b.column("_s"), low, high):
                counts += np.bincount((h >> np.uint64(64 - SLOT_BITS)).astype(np.int64), minlength=SLOTS)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["slot", "n"])

    # A slot counts at least what each of its n-grams does, so those of other slots can't be kept.
    slots = words.mapInArrow(sketch, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).filter((F.col("n") > least_rate * total) & (F.col("n") >= min_docs))
    hot = np.zeros(SLOTS, bool)
    hot[slots.select("slot").toPandas()["slot"].to_numpy(np.int64)] = True
    packed = np.packbits(hot)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = np.unpackbits(packed).astype(bool)
        for b in batches:
            for n, h, doc, at, tokens in word_runs(b.column("_s"), low, high):
                kept = hot[(h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]
                _, first, which = np.unique(h[kept], return_index=True, return_inverse=True)
                pairs = np.unique(which * np.int64(len(b)) + doc[kept]) // max(1, len(b))
                runs = [" ".join(tokens[k : k + n].to_pylist()) for k in at[kept][first].tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(runs, pa.string()), pa.array(np.bincount(which, minlength=len(first))), pa.array(np.bincount(pairs, minlength=len(first)))], names=["ngram", "count", "docs"])

    per = words.mapInArrow(counted, "ngram string, count long, docs long").groupBy("ngram").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    per = per.filter((F.col("docs") >= min_docs) & (F.col("docs") <= max_share * total)).withColumn("rate", F.col("count") / total).filter(F.col("rate") > least_rate)
    return per.orderBy(F.desc("count"), "ngram").limit(top).select("ngram", "rate")


Embed = Callable[[list[str]], np.ndarray]


def key_phrases(rows: DataFrame, embed: Embed, diversity: float = 0.3, top: int = 5, high: int = 3) -> DataFrame:
    """(id, text) to (id, phrase, score): per text up to `top` phrases of 1 to `high` words by maximal marginal relevance. Null and empty texts give none."""
    import re

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for i, sentence in zip(b.column("id").to_pylist(), b.column("text").to_pylist()):
                words = re.findall(r"\w+", (sentence or "").lower())
                phrases = list(dict.fromkeys(" ".join(words[k : k + n]) for n in range(1, high + 1) for k in range(len(words) - n + 1)))
                if not phrases:
                    continue
                x = embed([sentence, *phrases])
                relevance, alike = x[1:] @ x[0], x[1:] @ x[1:].T
                chosen = [int(np.argmax(relevance))]
                while len(chosen) < min(top, len(phrases)):
                    value = (1 - diversity) * relevance - diversity * alike[:, chosen].max(1)
                    value[chosen] = -np.inf
                    chosen.append(int(np.argmax(value)))
                out.extend((i, phrases[k], float(relevance[k])) for k in chosen)
            cols = list(zip(*out)) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.float64())], names=["id", "phrase", "score"])

    return rows.select("id", "text").mapInArrow(scan, "id long, phrase string, score double")


def hashed_embedding(texts: list[str], width: int = 64) -> np.ndarray:
    """Offline text vectors: signed hashing of words, unit length; a stand-in where no encoder is installed."""
    import re

    import xxhash

    x = np.zeros((len(texts), width))
    for i, t in enumerate(texts):
        for w in re.findall(r"\w+", (t or "").lower()):
            h = xxhash.xxh64_intdigest(w)
            x[i, h % width] += 1 if h >> 63 else -1
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def embedded(df: DataFrame, column: str, out: str = "embedding", embed: Embed = hashed_embedding) -> DataFrame:
    """Adds vectors of a text column by Arrow batches; the embedding function is the extension point for real encoders."""
    @F.pandas_udf("array<double>")
    def vectors(s):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series(list(embed(s.fillna("").tolist())))

    return df.withColumn(out, vectors(column))


def grown(lexicon: DataFrame, mail: DataFrame, embed: Embed = hashed_embedding, neighbours: int = 100, least: float = 0.7, top: int = 5, strict: bool = False) -> DataFrame:
    """The lexicon with generated phrases: mails nearest to each seed, their sentences nearest to it, and those sentences' key phrases; first row per prototype wins. strict takes "Seed" in this case only for a seed."""
    seeds = lexicon.filter("source = 'Seed'" if strict else "lower(source) = 'seed'").withColumn("id", F.col("_ordinal"))
    seed_vectors = embedded(seeds, "prototype", embed=embed).select("id", "embedding")
    mails = embedded(mail.select(F.col("_ordinal").alias("id"), F.concat_ws(" ", text(F.col("subject")), text(F.col("body"))).alias("t")), "t", embed=embed)
    close = knn(seed_vectors, mails, neighbours).select(F.col("neighbour_id").alias("id")).distinct()
    rows = mail.select(F.col("_ordinal").alias("id"), "body").join(close, "id").select("id", F.explode(sentences(F.col("body"))).alias("text"))
    unique = rows.groupBy("text").agg(F.max("id").alias("row")).withColumn("id", F.xxhash64("text"))
    vectors = embedded(unique, "text", embed=embed)
    hits = knn(seed_vectors, vectors, neighbours).filter(F.col("similarity") > least)
    best = hits.join(seeds.select(F.col("id").alias("query_id"), "lexicon"), "query_id").groupBy("lexicon", F.col("neighbour_id").alias("id")).agg(F.max("similarity").alias("similarity"))
    phrases = key_phrases(unique.select("id", "text").join(best.select("id").distinct(), "id"), embed, top=top)
    new = best.join(phrases, "id").select("lexicon", F.col("phrase").alias("prototype"), F.lit("Generated").alias("source"), F.bround("similarity", 4).alias("similarity"), (F.lit(1 << 40) + F.pmod(F.xxhash64("phrase"), F.lit(1 << 40))).alias("_ordinal"))
    new = new.groupBy("lexicon", "prototype", "source", "_ordinal").agg(F.max("similarity").alias("similarity")).select(*new.columns)  # a phrase of several sentences: its best
    return keep_first(lexicon.select(*new.columns).unionByName(new), ["lexicon", "prototype"], "_ordinal")


def sentence_index(df: DataFrame) -> DataFrame:
    """(text, row, chunk): distinct sentences with the last row they occur in, numbered densely by row and text."""
    from mailloom.operators.ordered import with_position

    rows = df.select(F.col("_ordinal").alias("row"), F.explode(sentences(F.col("body"))).alias("text")).groupBy("text").agg(F.max("row").alias("row"))
    return with_position(rows, "chunk", F.col("row"), F.col("text")).withColumn("chunk", F.col("chunk") - 1)


