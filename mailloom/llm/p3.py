"""Queries of problem 3: near-duplicate bodies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailloom.functions.identifiers import bare_identifier
from mailloom.llm.graph import connected_components
from mailloom.llm.neardup import similar_classes
from mailloom.session import read_table


def bodies(emails: DataFrame) -> DataFrame:
    return emails.select("id", bare_identifier(F.col("message_id")).alias("tag"), F.col("body").alias("text"))


def near_duplicate_pairs(emails: DataFrame, threshold: float = 0.6) -> DataFrame:
    """(id_a, id_b) of all e-mails of similar bodies that don't share an identifier; no identifier equals nothing."""
    members, links = similar_classes(bodies(emails), threshold=threshold)
    # A class is a link to itself: copies are pairs too.
    held = members.groupBy("rep").agg(F.count("*").alias("n"))
    pairs = links.select("a", "b").union(held.filter("n > 1").select(F.col("rep").alias("a"), F.col("rep").alias("b")))
    x = members.toDF("id_x", "tag_x", "a")
    y = members.toDF("id_y", "tag_y", "b")
    other = F.coalesce(F.col("tag_x") != F.col("tag_y"), F.lit(True))
    once = (F.col("a") != F.col("b")) | (F.col("id_x") < F.col("id_y"))
    return pairs.join(x, "a").join(y, "b").filter(other & once).select(F.least("id_x", "id_y").alias("id_a"), F.greatest("id_x", "id_y").alias("id_b"))


def near_duplicate_groups(emails: DataFrame, threshold: float = 0.6) -> DataFrame:
    """One row per e-mail with a class: id, group_id (smallest id of its group) and its class's number of links to other texts."""
    members, links = similar_classes(bodies(emails), threshold=threshold)
    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    roots = connected_components(links).toDF("rep", "root")
    return members.join(degree, "rep", "left").join(roots, "rep", "left").select("id", F.coalesce("root", "rep").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicate_pairs(read_table(spark, d, "emails"))


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicate_groups(read_table(spark, d, "emails"))


QUERIES = {"p3_found": p3_found, "p3_groups": p3_groups}
_WORDS = r"regexp_extract_all(lower(body), '[\p{L}\p{N}]+')"
PAIR_SQL = rf"""WITH w AS (SELECT id, nullif(regexp_replace(regexp_replace(message_id, '^[\s<]+', ''), '[\s>]+$', ''), '') AS tag, {_WORDS} AS w FROM emails),
  s AS (SELECT id, tag, list_distinct(list_transform(range(1, len(w) - 1), lambda i: concat_ws(' ', w[i], w[i + 1], w[i + 2]))) AS s FROM w WHERE len(w) >= 20),
  t AS (SELECT id, unnest(s) AS g FROM s),
  o AS (SELECT x.id AS id_a, y.id AS id_b, count(*) AS n FROM t x JOIN t y ON x.g = y.g AND x.id < y.id GROUP BY ALL),
  pairs AS (SELECT id_a, id_b, a.tag AS tag_a, b.tag AS tag_b FROM o JOIN s a ON a.id = id_a JOIN s b ON b.id = id_b WHERE n >= 0.6 * (len(a.s) + len(b.s) - n))"""
ORACLE = {
    "p3_found": f"{PAIR_SQL} SELECT id_a, id_b FROM pairs WHERE tag_a IS DISTINCT FROM tag_b OR tag_a IS NULL",
    "p3_groups": PAIR_SQL.replace("WITH w", "WITH RECURSIVE w", 1)
    + """, m AS (SELECT id, min(id) OVER (PARTITION BY w) AS rep FROM w WHERE len(w) >= 20),
  l AS (SELECT id_a AS a, id_b AS b FROM pairs JOIN m x ON x.id = id_a AND x.rep = id_a JOIN m y ON y.id = id_b AND y.rep = id_b),
  e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
  r AS (SELECT DISTINCT rep AS a, rep AS b FROM m UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
  SELECT m.id, g.root AS group_id, coalesce(n, 0) AS n_links FROM m JOIN (SELECT a, min(b) AS root FROM r GROUP BY 1) g ON g.a = m.rep LEFT JOIN (SELECT a, count(*) AS n FROM e GROUP BY 1) n ON n.a = m.rep""",
}
