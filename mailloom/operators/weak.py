"""Weak supervision: labelling functions as native columns, a generative label model fitted on vote patterns."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailloom.config import EngineConfig
from mailloom.functions.text import text
from mailloom.operators.lexicon import matches, terms
from mailloom.session import Documents

ABSTAIN, CALM, URGENT = -1, 0, 1
# What a lexicon votes for; an unknown one votes urgent.
VOTES = {"automated": CALM, "bulk": CALM, "notification": CALM, "financial": URGENT, "legal": URGENT, "request": URGENT, "urgency": URGENT}


def labelling_functions(lexicon: DataFrame, semantic: float = 0.6, semantic_column: str | None = None) -> dict[str, Column]:
    """Per lexicon a seed, a generated and a semantic function: native columns with values 1, 0 or -1 (abstain).

    The semantic one reads a map column of largest similarities by lexicon; without it, it abstains. Users add
    functions of their own to the dictionary.
    """
    body = F.concat_ws(" ", text(F.col("subject")), text(F.col("body")))
    out: dict[str, Column] = {}
    for name, words in terms(lexicon).items():
        vote = VOTES.get(name, URGENT)
        for source in ("seed", "generated"):
            out[f"lf_{name}_{source}"] = F.when(matches(body, words.get(source, [])), vote).otherwise(ABSTAIN)
        score = F.coalesce(F.element_at(semantic_column, name), F.lit(0.0)) if semantic_column else F.lit(0.0)
        out[f"lf_{name}_semantic"] = F.when(score >= semantic, vote).otherwise(ABSTAIN) if semantic_column else F.lit(ABSTAIN)
    return out


def voted(mail: DataFrame, functions: dict[str, Column]) -> DataFrame:
    """Adds votes, an array in the order of the functions."""
    return mail.withColumn("votes", F.array(*[c.cast("int") for c in functions.values()]))


PATTERNS = 200_000  # distinct vote patterns that the fit takes to the driver


def vote_patterns(df: DataFrame, *by: Column) -> DataFrame:
    """(votes, n): distinct vote patterns; all the label model needs."""
    return df.groupBy("votes", *by).agg(F.count("*").alias("n"))


def collected_patterns(patterns: DataFrame) -> list:
    """The counted patterns on the driver; more than PATTERNS of them are refused, for they are no small table."""
    rows = patterns.limit(PATTERNS + 1).collect()
    if len(rows) > PATTERNS:
        raise ValueError(f"more than {PATTERNS} distinct vote patterns: use fewer labelling functions")
    return rows


def weighted_vote(weights: dict[str, float], functions: dict[str, Column]) -> Column:
    """The class of the larger total weight of its votes, -1 where none votes or both weigh the same; functions without a weight count 1."""
    def total(label: int) -> Column:
        parts = [F.when(c == label, F.lit(float(weights.get(name, 1.0)))).otherwise(F.lit(0.0)) for name, c in functions.items()]
        return reduce(lambda a, b: a + b, parts, F.lit(0.0))

    urgent, calm = total(URGENT), total(CALM)
    return F.when(urgent > calm, URGENT).when(calm > urgent, CALM).otherwise(ABSTAIN)


def vote_summary(df: DataFrame, names: list[str]) -> DataFrame:
    """(lf, coverage, urgent_rate, calm_rate) of each function."""
    votes = df.select(F.posexplode("votes").alias("i", "v"))
    rates = votes.groupBy("i").agg(F.avg((F.col("v") != ABSTAIN).cast("double")).alias("coverage"), F.avg((F.col("v") == URGENT).cast("double")).alias("urgent_rate"), F.avg((F.col("v") == CALM).cast("double")).alias("calm_rate"))
    return rates.select(F.element_at(F.array(*map(F.lit, names)), F.col("i") + 1).alias("lf"), "coverage", "urgent_rate", "calm_rate")


def covered_summary(df: DataFrame) -> DataFrame:
    """(n, covered, ratio): rows with any vote; ratio 0 of an empty table."""
    any_vote = F.exists("votes", lambda v: v != ABSTAIN)
    return df.agg(F.count("*").alias("n"), F.count_if(any_vote).alias("covered")).withColumn("ratio", F.when(F.col("n") > 0, F.col("covered") / F.col("n")).otherwise(F.lit(0.0)))


@dataclass
class LabelModel:
    """mu[i, v, y]: probability that function i votes v (0 or 1) given class y; a uniform prior."""

    names: list[str]
    mu: list = field(default_factory=list)
    semantic: float = 0.6
    threshold: float = 0.5

    def fit(self, patterns: list[tuple[list[int], int]], epochs: int = 500, rate: float = 0.05, seed: int = 42) -> LabelModel:
        """Matches the observed second moments of one-hot votes to mu diag(p) mu' off the blocks of single functions, by seeded gradient descent.

        patterns: distinct votes with counts, so the fit's size doesn't depend on the number of rows. The rate is for
        plain descent on exact moments; smaller ones, as are usual with stochastic optimisers, leave it short of the optimum after as many epochs.
        """
        m = len(self.names)
        total = sum(n for _, n in patterns)
        x = np.zeros((len(patterns), 2 * m))
        for r, (votes, _) in enumerate(patterns):
            for i, v in enumerate(votes):
                if v >= 0:
                    x[r, 2 * i + v] = 1
        weight = np.array([n for _, n in patterns], float) / max(total, 1)
        observed = (x * weight[:, None]).T @ x
        share = (x * weight[:, None]).sum(0)
        mask = np.ones((2 * m, 2 * m))
        for i in range(m):
            mask[2 * i : 2 * i + 2, 2 * i : 2 * i + 2] = 0
        rng = np.random.default_rng(seed)
        # Functions are taken to be better than chance at the start: that fixes which class is which.
        mu = np.stack([share * (1.4 if y == 0 else 0.6) for y in (0, 1)], 1)
        for i in range(m):
            mu[2 * i + 1] = mu[2 * i + 1][::-1]
        mu = np.clip(mu + rng.normal(0, 1e-3, mu.shape), 1e-4, 1)
        prior = np.array([0.5, 0.5])
        speed = np.zeros_like(mu)
        for _ in range(epochs):
            error = mask * ((mu * prior) @ mu.T - observed)
            gradient = 4 * error @ (mu * prior) + 2 * ((mu @ prior) - share)[:, None] * prior
            speed = 0.9 * speed - rate * gradient
            mu = np.clip(mu + speed, 1e-4, 1 - 1e-4)
        self.mu = mu.reshape(m, 2, 2).tolist()
        return self

    def log_odds(self) -> list[list[float]]:
        """Per function the log odds of class 1 for votes 0 and 1; an abstention says nothing."""
        return [[float(np.log(v[1] / v[0])) for v in f] for f in self.mu]

    def posterior(self, votes: Column) -> Column:
        """P(class 1 | votes); null where every function abstains."""
        odds = F.array(*[F.array(*map(F.lit, f)) for f in self.log_odds()])
        terms_ = F.zip_with(votes, odds, lambda v, o: F.when(v >= 0, F.get(o, v)).otherwise(F.lit(0.0)))
        total = F.aggregate(terms_, F.lit(0.0), lambda s, t: s + t)
        return F.when(F.exists(votes, lambda v: v >= 0), 1 / (1 + F.exp(-total)))

    def save(self, path: str) -> None:
        """On any file system Spark knows."""
        folder, _, name = path.rpartition("/")
        Documents(SparkSession.active(), folder).write(name, json.dumps(self.__dict__))

    @classmethod
    def load(cls, path: str) -> LabelModel:
        folder, _, name = path.rpartition("/")
        return cls(**json.loads(Documents(SparkSession.active(), folder).read(name)))


def silver(df: DataFrame, model: LabelModel, strict: bool = False) -> DataFrame:
    """Adds silver_proba and silver_label; an all-abstain row has none, or by strict counts as 0.5."""
    p = model.posterior(F.col("votes"))
    p = F.coalesce(p, F.lit(0.5)) if strict else p
    return df.withColumns({"silver_proba": p, "silver_label": (p >= model.threshold).cast("int")})


def final_label(gold: Column, silver_label: Column) -> Column:
    """The gold label if it is 0 or 1, else the silver one."""
    return F.when(gold.isin(0, 1), gold).otherwise(silver_label)


def searched(mail: DataFrame, lexicon: DataFrame, gold: str, semantic_column: str | None = None, config: EngineConfig = EngineConfig()) -> LabelModel:
    """The label model of the best semantic and label thresholds on the rows with gold labels: a seeded search over `label_trials` pairs, fitted on the unlabelled rows, then refitted on all.

    Only a new semantic threshold needs new votes; each trial reads vote patterns, not rows.
    """
    rng = np.random.default_rng(config.seed)
    known = F.coalesce(F.col(gold).isin(0, 1), F.lit(False))
    best, best_f1 = (config.semantic_threshold, config.label_threshold), -1.0
    for _ in range(config.label_trials if semantic_column else 1):
        semantic = float(rng.uniform(0.30, 0.90)) if semantic_column else config.semantic_threshold
        functions = labelling_functions(lexicon, semantic, semantic_column)
        counts = collected_patterns(vote_patterns(voted(mail, functions), F.when(known, F.col(gold)).alias("y")))
        free = [(list(r["votes"]), r["n"]) for r in counts if r["y"] is None] or [(list(r["votes"]), r["n"]) for r in counts]
        model = LabelModel(list(functions), semantic=semantic).fit(free, config.label_epochs)
        odds = model.log_odds()
        rows = [(1 / (1 + np.exp(-sum(odds[i][v] for i, v in enumerate(r["votes"]) if v >= 0))), r["y"], r["n"]) for r in counts if r["y"] is not None and any(v >= 0 for v in r["votes"])]
        for threshold in np.arange(0.50, 0.951, 0.05):
            tp = sum(n for p, y, n in rows if p >= threshold and y == 1)
            wrong = sum(n for p, y, n in rows if (p >= threshold) != (y == 1))
            f1 = 2 * tp / (2 * tp + wrong) if tp else 0.0
            if f1 > best_f1:
                best, best_f1 = (semantic, float(threshold)), f1
    functions = labelling_functions(lexicon, best[0], semantic_column)
    every = [(list(r["votes"]), r["n"]) for r in collected_patterns(vote_patterns(voted(mail, functions)))]
    return LabelModel(list(functions), semantic=best[0], threshold=best[1]).fit(every, config.label_epochs)
