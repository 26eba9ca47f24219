"""Queries on sending times and repeated deliveries, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailloom.functions.identifiers import bare_identifier
from mailloom.operators.deliveries import exactly_once, redundant_deliveries, replayed
from mailloom.operators.instants import corrected_hours, normalise_instants
from mailloom.session import read_table

IDENT = r"nullif(regexp_replace(regexp_replace(message_id, '^[\s<]+', ''), '[\s>]+$', ''), '')"


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return normalise_instants(read_table(spark, d, "emails").select("id", "date_text", "x_origin"), read_table(spark, d, "mailboxes")).filter("utc_us is not null").select("id", "utc_us")


def p1_sent_hour(spark: SparkSession, d: str) -> DataFrame:
    return corrected_hours(read_table(spark, d, "emails"), read_table(spark, d, "mailboxes"), read_table(spark, d, "meta_features"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return redundant_deliveries(read_table(spark, d, "emails"))


def p5_kept(spark: SparkSession, d: str) -> DataFrame:
    return exactly_once(read_table(spark, d, "emails")).select("id", bare_identifier(F.col("message_id")).alias("identifier"), "x_folder", "batch_no")


def p5_incremental(spark: SparkSession, d: str) -> DataFrame:
    """The same rows as p5_kept, by taking the batches one after another through a persisted index."""
    emails = read_table(spark, d, "emails")
    identifier = bare_identifier(F.col("message_id"))
    kept = emails.join(replayed(emails), "id", "left_semi").unionByName(emails.filter(identifier.isNull()))
    return kept.select("id", identifier.alias("identifier"), "x_folder", "batch_no")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p1_found": p1_found, "p1_sent_hour": p1_sent_hour, "p5_found": p5_found, "p5_kept": p5_kept, "p5_incremental": p5_incremental}
_RANKED = f"WITH k AS (SELECT *, {IDENT} AS identifier FROM emails), r AS (SELECT *, row_number() OVER (PARTITION BY identifier ORDER BY received_at NULLS LAST, id) AS n FROM k)"


def _instants_sql() -> str:
    """The same cascade by another engine: its own date casts and zone rules."""
    from mailloom.functions.instants import ABBREVIATIONS, CASCADE, MONTHS

    def replaced(pattern: str, form: str) -> str:
        p = "(?i)" + pattern.replace("(?!am|pm)", "")
        return f"WHEN regexp_matches(t, '{p}') THEN regexp_replace(t, '{p}', '{form.replace('$', chr(92))}')"

    cases = " ".join(replaced(p, f) for _, p, f in CASCADE)
    space = r"[\t-\r\x{85}\p{Z}]+"
    short = "CASE " + " ".join(f"WHEN lower(p[10]) = '{k}' THEN {v}" for k, v in ABBREVIATIONS.items()) + " END"
    shown = "epoch_us(timezone(z, make_timestamptz({})))"
    day = 86_400_000_000
    through = lambda d: f"l - ({shown.format(f'l + ({d})')} - (l + ({d})))"
    return rf"""WITH f AS (SELECT e.id, trim(regexp_replace(date_text, '{space}', ' ', 'g')) AS t, m.tz_name, m.day_first FROM emails e LEFT JOIN mailboxes m ON m.x_origin = e.x_origin),
  c AS (SELECT *, string_split(CASE {cases} END, '|') AS p FROM f),
  d AS (SELECT *, CASE WHEN length(p[2]) = 2 THEN (CASE WHEN p[2]::INT < 50 THEN '20' ELSE '19' END) || p[2] ELSE p[2] END AS y,
    coalesce(nullif(list_position({MONTHS}, lower(left(p[3], 3))), 0)::VARCHAR, p[3]) AS a, p[4] AS b, try_cast(p[5] AS INT) AS h, lower(p[9]) AS half FROM c),
  g AS (SELECT *, CASE WHEN p[1] = 'xxy' AND day_first THEN b ELSE a END AS mo, CASE WHEN p[1] = 'xxy' AND day_first THEN a ELSE b END AS dd,
    CASE WHEN half = '' AND h <= 23 THEN h WHEN half <> '' AND h BETWEEN 1 AND 12 THEN h % 12 + CASE half WHEN 'pm' THEN 12 ELSE 0 END END AS hh FROM d),
  k AS (SELECT *, CASE WHEN p[1] = 'ymd' OR day_first IS NOT NULL THEN epoch_us(try_cast(concat(y, '-', lpad(mo, 2, '0'), '-', lpad(dd, 2, '0')) AS DATE)::TIMESTAMP)
      + CASE WHEN p[6]::INT <= 59 AND coalesce(nullif(p[7], '')::INT, 0) <= 59 THEN (hh * 3600 + p[6]::INT * 60 + coalesce(nullif(p[7], '')::INT, 0))::BIGINT * 1000000 END + coalesce(rpad(left(nullif(p[8], ''), 6), 6, '0')::BIGINT, 0) END AS l,
    CASE WHEN p[10] <> '' THEN NULL WHEN p[11] <> '' THEN p[11] ELSE tz_name END AS zone FROM g WHERE p[1] <> 'epoch'),
  n AS (SELECT id, l, p, t.name AS z FROM k LEFT JOIN pg_timezone_names() t ON t.name = k.zone),
  u AS (SELECT id, l, p, z, CASE WHEN z IS NOT NULL THEN {through(-day)} END AS u1, CASE WHEN z IS NOT NULL THEN {through(day)} END AS u2 FROM n),
  v AS (SELECT *, z IS NOT NULL AND {shown.format("u1")} = l AS g1, z IS NOT NULL AND {shown.format("u2")} = l AS g2 FROM u),
  r AS (SELECT id, CASE WHEN p[10] <> '' THEN l - coalesce({short}, (CASE WHEN p[10][1] = '-' THEN -1 ELSE 1 END) * (try_cast(regexp_replace(p[10], '[^0-9]', '', 'g')[1:2] AS INT) * 60 + coalesce(try_cast(nullif(regexp_replace(p[10], '[^0-9]', '', 'g')[3:4], '') AS INT), 0)))::BIGINT * 60000000
      WHEN g1 AND g2 AND u1 <> u2 THEN NULL WHEN g1 THEN u1 WHEN g2 THEN u2 END AS utc_us FROM v
    UNION ALL SELECT id, p[2]::BIGINT * CASE WHEN length(p[2]) <= 10 THEN 1000000 WHEN length(p[2]) <= 13 THEN 1000 ELSE 1 END FROM c WHERE p[1] = 'epoch')
  SELECT id, utc_us::BIGINT AS utc_us FROM r WHERE utc_us IS NOT NULL"""


ORACLE: dict[str, str] = {
    "p1_found": _instants_sql(),
    "p1_sent_hour": rf"""WITH u AS ({_instants_sql()}), k AS (SELECT {IDENT} AS identifier, received_at, id, utc_us FROM emails JOIN u USING (id)),
      r AS (SELECT *, row_number() OVER (PARTITION BY identifier ORDER BY received_at NULLS FIRST, id) AS n FROM k WHERE identifier IS NOT NULL),
      m AS (SELECT {IDENT} AS identifier, min(sent_hour) AS recorded_hour FROM meta_features GROUP BY 1)
      SELECT identifier, utc_us, (utc_us // 3600000000 % 24)::INT AS sent_hour, recorded_hour, coalesce(recorded_hour = utc_us // 3600000000 % 24, false) AS agrees FROM r LEFT JOIN m USING (identifier) WHERE n = 1""",
    "p5_found": f"{_RANKED} SELECT id FROM r WHERE identifier IS NOT NULL AND n > 1",
    "p5_kept": f"{_RANKED} SELECT id, identifier, x_folder, batch_no FROM r WHERE identifier IS NULL OR n = 1",
    "p5_incremental": f"{_RANKED} SELECT id, identifier, x_folder, batch_no FROM r WHERE identifier IS NULL OR n = 1",
}
