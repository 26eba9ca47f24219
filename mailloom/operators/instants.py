"""One UTC instant per e-mail."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailloom.functions.identifiers import bare_identifier
from mailloom.functions.instants import with_utc_micros, zone_names


def normalise_instants(emails: DataFrame, mailboxes: DataFrame, mailbox_rows: int = 10_000) -> DataFrame:
    """The input e-mails with utc_us (null where date_text means no single instant) and sent_hour_utc.

    A row of any column null, a repeated row and an empty table keep their rows; an e-mail whose
    x_origin is no mailbox has no default zone. Extra columns stay. mailboxes with the same x_origin
    twice: the smallest (tz_name, day_first) counts, so rows are never multiplied.
    The lookup is broadcast only up to mailbox_rows rows; a larger one is joined by shuffle.
    """
    zone = F.when(F.col("tz_name").isin("UTC", *zone_names()), F.col("tz_name"))
    zones = mailboxes.groupBy(F.col("x_origin").alias("_origin")).agg(F.min(F.struct(zone.alias("z"), "day_first")).alias("_zone")).filter("_origin is not null")
    if zones.limit(mailbox_rows + 1).count() <= mailbox_rows:
        zones = F.broadcast(zones)
    joined = emails.join(zones, emails["x_origin"] == F.col("_origin"), "left").withColumns({"_z": F.col("_zone.z"), "_first": F.col("_zone.day_first")})
    out = with_utc_micros(joined, "date_text", "_z", "_first").drop("_origin", "_zone", "_z", "_first")
    return out.withColumn("sent_hour_utc", F.pmod(F.floor(F.col("utc_us") / 3_600_000_000), F.lit(24)).cast("int"))


def corrected_hours(emails: DataFrame, mailboxes: DataFrame, meta: DataFrame) -> DataFrame:
    """Per identifier: the UTC hour of its first copy with an instant, and whether meta's sent_hour agrees.

    Both sides are reduced to one row per identifier before they meet, so hot identifiers don't skew the join.
    """
    hours = (
        normalise_instants(emails.select("id", "message_id", "date_text", "x_origin", "received_at"), mailboxes)
        .filter("utc_us is not null")
        .groupBy(bare_identifier(F.col("message_id")).alias("identifier"))
        .agg(F.min(F.struct("received_at", "id", "utc_us", "sent_hour_utc")).alias("f"))
        .filter("identifier is not null")
    )
    recorded = meta.groupBy(bare_identifier(F.col("message_id")).alias("identifier")).agg(F.min("sent_hour").alias("recorded_hour"))
    return hours.join(recorded, "identifier", "left").select("identifier", F.col("f.utc_us").alias("utc_us"), F.col("f.sent_hour_utc").alias("sent_hour"), "recorded_hour", F.coalesce(F.col("recorded_hour") == F.col("f.sent_hour_utc"), F.lit(False)).alias("agrees"))
