"""Threads, meta features and the mail view they work on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailloom.config import EngineConfig
from mailloom.functions import text as X
from mailloom.functions.instants import micros
from mailloom.operators.ordered import with_neighbours, with_previous
from mailloom.schemas import META, require


def mail_view(emails: DataFrame) -> DataFrame:
    """E-mails with date (the time received, where no parsed one is given) and _ordinal, the source's order."""
    out = emails if "date" in emails.columns else emails.withColumn("date", F.col("received_at"))
    return out.withColumn("_ordinal", F.col("id"))


def threads(mail: DataFrame) -> DataFrame:
    """Adds reply and forward flags, cleaned subject, thread_id, parent_id, sequence and domains.

    Replies and forwards of one cleaned subject share a thread, which is a hash of it; any other mail is a
    thread of its own. Order within a thread: date, then _ordinal; null dates come first. Null subjects count
    as empty. Sequence and parent come from narrow rows in range-partitioned order, so a hot subject is no hot
    task; they are joined back by _ordinal, which must be unique.
    """
    require(mail, "message_id", "sender", "date", "subject", "_ordinal")
    flagged = mail.withColumns({"is_forward": X.is_forward(F.col("subject")), "is_reply": X.is_reply(F.col("subject")), "clean_subject": X.clean_subject(F.col("subject"))})
    key = F.when(F.col("is_forward") | F.col("is_reply"), F.col("clean_subject")).otherwise(F.concat(F.lit("missing-"), F.col("_ordinal").cast("string")))
    keyed = flagged.withColumn("thread_id", F.sha2(key, 256))
    places = with_neighbours(keyed.select("_ordinal", "thread_id", "date", "message_id"), "thread_id", "message_id", "parent_id", "sequence", "date", "_ordinal")
    return keyed.join(places.select("_ordinal", "sequence", "parent_id"), "_ordinal").withColumns({
        "sender_domain": X.domain(F.col("sender")), "recipient_domain": X.domains(F.col("to_list"), F.col("cc_list"), F.col("bcc_list")),
    })


def seconds_between(later: Column, earlier: Column) -> Column:
    """Whole seconds between two counts of microseconds, truncated."""
    return ((later - earlier) / 1_000_000).cast("long")


def meta_features(mail: DataFrame, config: EngineConfig = EngineConfig(), global_gap: bool = True) -> DataFrame:
    """The meta features of each mail, keyed by _ordinal and message_id.

    response_time is the gap to the mail before of anyone, time_since_last_email the gap to the sender's own mail
    before (null senders count as one), both by range-partitioned lags, so no sender is a hot group. strict: is_after_hours is always true,
    is_external means more than one recipient domain, and a null list counts as one recipient more.
    """
    domains, own = X.domains(F.col("to_list"), F.col("cc_list"), F.col("bcc_list")), X.domain(F.col("sender"))
    start, end = config.after_hours
    hour = F.hour("date")
    internal = F.coalesce(F.array_contains(domains, own), F.lit(False))
    other = F.size(F.filter(domains, lambda x: ~x.eqNullSafe(own))) > 0
    out = mail.select(
        "_ordinal", "message_id", micros(mail, "date").alias("date"), "sender", hour.alias("sent_hour"), F.weekday("date").alias("sent_weekday"),
        (F.lit(True) if config.strict_reference else (hour < start) | (hour >= end)).alias("is_after_hours"),
        (F.weekday("date") > 4).alias("is_weekend"),
        X.recipients(F.col("to_list"), F.col("cc_list"), F.col("bcc_list"), strict=config.strict_reference).alias("n_recipient"),
        F.size(domains).alias("n_recipient_domains"), X.n_words(F.col("body")).alias("n_words"), X.n_sentences(F.col("body")).alias("n_sentences"),
        internal.alias("is_internal"), (F.size(domains) > 1 if config.strict_reference else other).alias("is_external"),
    )
    # The gaps last, on narrow rows: bodies are not written or sorted.
    out = with_neighbours(out, "sender", "date", "_own", None, "date", "_ordinal")
    out = with_previous(out, "date", "_any", "date", "_ordinal") if global_gap else out.withColumn("_any", F.lit(None).cast("long"))
    gaps = {"response_time": seconds_between(F.col("date"), F.col("_any")), "time_since_last_email": seconds_between(F.col("date"), F.col("_own"))}
    return out.withColumns(gaps).select(*META.names[:1], "_ordinal", *META.names[1:])


def completed(partial: DataFrame) -> DataFrame:
    """A partial request record made whole: message_id api-<hex>, sender from x_from, date now, empty lists and texts."""
    have = set(partial.columns)
    get = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    array = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>")) if c in have else F.array().cast("array<string>")
    last = lambda a: F.lower(F.element_at(F.split(a, "@"), -1))
    made = partial.withColumns({
        "message_id": F.coalesce(get("message_id"), F.concat(F.lit("api-"), F.replace(F.uuid(), F.lit("-"), F.lit("")))),
        "sender": F.coalesce(get("sender"), get("x_from"), F.lit("")), "date": F.coalesce(F.col("date"), F.current_timestamp()) if "date" in have else F.current_timestamp(),
        "subject": X.text(get("subject")), "body": X.text(get("body")), **{c: array(c) for c in ("to_list", "cc_list", "bcc_list")},
    })
    return made.withColumns({"sender_domain": last(F.col("sender")), "recipient_domain": F.array_sort(F.array_distinct(F.transform(F.filter(F.concat("to_list", "cc_list", "bcc_list"), lambda x: x.contains("@")), last)))})
