"""Queries on threads, meta features, text cleaning and mail summaries, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailloom.config import EngineConfig
from mailloom.functions import text as X
from mailloom.operators import analytics as A
from mailloom.operators import mail as M
from mailloom.operators.knn import normalised, semantic_scores
from mailloom.operators.lexicon import STOP_WORDS, coverage, frequent_phrases, phrase_counts, seed_lexicon
from mailloom.operators.ordered import keep_first
from mailloom.operators.splits import stratified_folds, thread_split
from mailloom.operators.weak import covered_summary, labelling_functions, vote_patterns, vote_summary, voted
from mailloom.session import read_table, spread

STRICT = EngineConfig(strict_reference=True)
KEYS = ["sender", "to_key", "subject", "date_text"]


def view(s: SparkSession, d: str) -> DataFrame:
    return M.mail_view(spread(read_table(s, d, "emails")))


def keyed(s: SparkSession, d: str) -> DataFrame:
    to = F.array_join(F.array_sort("to_list"), ",")
    return view(s, d).withColumn("to_key", to)


def threads(s: SparkSession, d: str) -> DataFrame:
    return M.threads(view(s, d))


QUERIES = {
    "scan_bodies": lambda s, d: read_table(s, d, "emails").select("id", F.char_length("body").alias("n_chars")),
    "clean_subject": lambda s, d: view(s, d).select("_ordinal", X.clean_subject(F.col("subject")).alias("clean")),
    "reply_forward_flags": lambda s, d: view(s, d).select("_ordinal", X.is_reply(F.col("subject")).alias("is_reply"), X.is_forward(F.col("subject")).alias("is_forward")),
    "entity_removal": lambda s, d: view(s, d).select("_ordinal", X.single_punctuation(X.single_spaces(X.without_entities(F.lower(X.text(F.col("body")))))).alias("clean")),
    "thread_mark_cut": lambda s, d: view(s, d).select("_ordinal", X.before(F.regexp_replace(F.lower(X.text(F.col("body"))), r"\r\n?", "\n"), X.THREAD_MARK).alias("kept")),
    "signature_cut": lambda s, d: view(s, d).select("_ordinal", X.without_signature(X.text(F.col("body"))).alias("kept")),
    "html_to_text": lambda s, d: view(s, d).select("_ordinal", X.html_to_text(F.col("body")).alias("plain")),
    "clean_body": lambda s, d: view(s, d).select("_ordinal", X.clean_body(F.col("body")).alias("clean")),
    "clean_body_strict": lambda s, d: view(s, d).select("_ordinal", X.clean_body(F.col("body"), strict=True).alias("clean")),
    "thread_ids": lambda s, d: threads(s, d).select("_ordinal", "thread_id", "sequence", "parent_id"),
    "domains_recipients": lambda s, d: view(s, d).select("_ordinal", X.domain(F.col("sender")).alias("sender_domain"), F.array_join(X.domains(F.col("to_list"), F.col("cc_list"), F.col("bcc_list")), ",").alias("domains"), X.recipients(F.col("to_list"), F.col("cc_list"), F.col("bcc_list")).alias("n_recipient"), X.recipients(F.col("to_list"), F.col("cc_list"), F.col("bcc_list"), strict=True).alias("n_recipient_strict")),
    "domain_to_end": lambda s, d: view(s, d).select("_ordinal", X.domain_to_end(F.col("sender")).alias("domain")),
    "header_addresses": lambda s, d: view(s, d).select("_ordinal", F.array_join(X.addresses(F.col("x_cc")), ",").alias("found")),
    "meta_features": lambda s, d: M.meta_features(view(s, d)),
    "meta_features_strict": lambda s, d: M.meta_features(view(s, d), STRICT),
    "sender_gap": lambda s, d: M.meta_features(view(s, d), global_gap=False).select("_ordinal", "time_since_last_email"),
    "event_gap": lambda s, d: M.meta_features(read_table(s, d, "events").select(F.col("event_id").alias("_ordinal"), F.lit("").alias("message_id"), F.col("ts").alias("date"), F.col("user_id").cast("string").alias("sender"), *[F.array().cast("array<string>").alias(c) for c in ("to_list", "cc_list", "bcc_list")], F.lit("").alias("body"))).select("_ordinal", "response_time", "time_since_last_email"),
    "word_sentence_counts": lambda s, d: view(s, d).select("_ordinal", X.n_words(F.col("body")).alias("n_words"), X.n_sentences(F.col("body")).alias("n_sentences")),
    "path_segment": lambda s, d: view(s, d).select("_ordinal", X.last_segment(F.col("x_folder")).alias("folder")),
    "meta_join": lambda s, d: view(s, d).join(keep_first(read_table(s, d, "meta_features").withColumn("_h", F.coalesce("sent_hour", F.lit(-1))), ["message_id"], "_h", "n_words", nulls_match=False).select("message_id", "sent_hour"), "message_id", "left").select("_ordinal", "sent_hour"),
    "gold_join": lambda s, d: view(s, d).join(read_table(s, d, "gold_labels").groupBy("message_id").agg(F.max("gold_labels").alias("gold")), "message_id", "left").select("_ordinal", "gold", F.when(F.col("gold").isin(0, 1), F.col("gold")).otherwise((F.length("body") % 2).cast("int")).alias("label")),
    "duplicate_candidates": lambda s, d: A.multi_folder(keyed(s, d), KEYS).filter("in_folders").select("_ordinal"),
    "first_per_key": lambda s, d: keep_first(keyed(s, d), KEYS, "_ordinal").select("_ordinal"),
    "folder_duplicate_pivot": lambda s, d: A.pivot_counts(A.multi_folder(keyed(s, d), KEYS), X.last_segment(F.col("x_folder")), "folder", {"single": ~F.col("in_folders"), "repeated": F.col("in_folders")}),
    "volume_by_year": lambda s, d: A.counts_by(view(s, d), year=F.year("date"), unusual=F.year("date").isin(1980, 1997)),
    "volume_by_hour_pivot": lambda s, d: A.pivot_counts(view(s, d).filter("date is not null"), F.hour("date"), "hour", {"weekdays": F.weekday("date") < 5, "weekend": F.weekday("date") > 4}),
    "dense_hours": lambda s, d: A.dense(A.counts_by(read_table(s, d, "events").filter("ts is not null"), hour=F.hour("ts")), "hour", 24, "n"),
    "domain_activity_topk": lambda s, d: A.activity(threads(s, d), "sender_domain", 15),
    "sender_activity": lambda s, d: A.activity(threads(s, d), "sender"),
    "two_ended_topk": lambda s, d: A.two_ends(A.activity(threads(s, d), "sender").filter("sender is not null"), "total_volume", "sender", 15),
    "longest_bodies_topk": lambda s, d: view(s, d).select("_ordinal", F.char_length("body").alias("n")).orderBy(F.desc_nulls_last("n"), "_ordinal").limit(20),
    "clip_histogram": lambda s, d: A.clipped_histogram(view(s, d).select(F.char_length("body").cast("double").alias("v")).filter("v is not null"), "v", 0.99, 50),
    "length_by_label": lambda s, d: A.feature_summary(_labelled(s, d), "label", ["n_chars", "n_words"]),
    "length_quartiles": lambda s, d: A.quartiles(_labelled(s, d), "label", "n_chars"),
    "topic_top3": lambda s, d: A.top_per_group(_topics(s, d), "topic", 3, "vec_id", "topic_probability", "proba").select("topic", "rank", "vec_id"),
    "phrase_counts": lambda s, d: phrase_counts(view(s, d), "body", ["please", "heads up", "by end of day", "invoice"]),
    "lexicon_coverage": lambda s, d: coverage(view(s, d), seed_lexicon(s)),
    "lexicon_votes": lambda s, d: _votes(s, d).select("_ordinal", F.array_join("votes", ",").alias("votes")),
    "lexicon_votes_semantic": lambda s, d: _semantic_votes_of(s, d).select("_ordinal", F.array_join("votes", ",").alias("votes")),
    "vote_patterns": lambda s, d: vote_patterns(_votes(s, d)).select(F.array_join("votes", ",").alias("votes"), "n"),
    "vote_summary": lambda s, d: vote_summary(_votes(s, d), list(labelling_functions(seed_lexicon(s)))),
    "vote_coverage": lambda s, d: covered_summary(_votes(s, d)),
    "frequent_phrases": lambda s, d: frequent_phrases(view(s, d), "body", STOP_WORDS),
    "thread_split": lambda s, d: thread_split(threads(s, d)).select("_ordinal", "thread_id", "split"),
    "stratified_folds": lambda s, d: stratified_folds(_labelled(s, d), "label", "_ordinal").select("_ordinal", "label", "fold"),
    "union_all": lambda s, d: read_table(s, d, "emails").select("id", "subject").unionByName(read_table(s, d, "documents").select(F.col("doc_id").alias("id"), F.lit(None).cast("string").alias("subject"))),
    "duplicate_flag_join": lambda s, d: view(s, d).join(keep_first(keyed(s, d), KEYS, "_ordinal").select("_ordinal", F.lit(0).alias("duplicate")), "_ordinal", "left").select("_ordinal", F.coalesce("duplicate", F.lit(1)).alias("duplicate")),
    "semi_join_threads": lambda s, d: threads(s, d).join(threads(s, d).filter("is_reply").select("thread_id").distinct(), "thread_id", "left_semi").select("_ordinal"),
    "unit_vectors": lambda s, d: read_table(s, d, "embeddings").select("vec_id", F.round(F.aggregate(normalised(F.col("embedding")), F.lit(0.0), lambda a, v: a + v), 6).alias("total")),
}


def _labelled(s: SparkSession, d: str) -> DataFrame:
    gold = read_table(s, d, "gold_labels").groupBy("message_id").agg(F.max("gold_labels").alias("label"))
    return view(s, d).join(gold, "message_id").filter("label in (0, 1)").select("_ordinal", "label", F.char_length("body").cast("double").alias("n_chars"), X.n_words(F.col("body")).cast("double").alias("n_words"))


def _topics(s: SparkSession, d: str) -> DataFrame:
    return read_table(s, d, "mail_vectors").filter("label is not null").select("vec_id", F.col("label").alias("topic"), ((F.col("vec_id") * 37 % 1000).cast("double") / 1000).alias("proba"), ((F.col("vec_id") * 91 % 1000).cast("double") / 1000).alias("topic_probability"))


def _votes(s: SparkSession, d: str) -> DataFrame:
    return voted(view(s, d), labelling_functions(seed_lexicon(s)))


def with_semantic(s: SparkSession, d: str) -> DataFrame:
    """Mails with a map of similarities by lexicon: pairs of neighbouring ids share a vector of the embeddings table, and every ninth of these stands for a term of a lexicon."""
    v = read_table(s, d, "embeddings")
    names = F.array(*map(F.lit, LEXICON_NAMES))
    terms = v.filter("vec_id % 9 = 0").select(F.get(names, (F.col("vec_id") % len(LEXICON_NAMES)).cast("int")).alias("lexicon"), "embedding")
    scores = semantic_scores(v.select(F.col("vec_id").alias("id"), "embedding"), terms).withColumnRenamed("id", "_vec")
    n = max(1, v.count())
    return view(s, d).withColumn("_vec", F.floor(F.col("_ordinal") / 2 % n).cast("long")).join(scores, "_vec", "left")


def _semantic_votes_of(s: SparkSession, d: str) -> DataFrame:
    return voted(with_semantic(s, d), labelling_functions(seed_lexicon(s), 0.6, "semantic"))


# -- SQL ------------------------------------------------------------------------------------------

WS = r"[\t-\r\x{85}\p{Z}]"
NWS = r"[^\t-\r\x{85}\p{Z}]"
VIEW = "WITH m AS (SELECT *, id AS _ordinal, received_at AS date FROM emails)"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


SUBJECT = _strip(rf"regexp_replace(regexp_replace(lower(coalesce(subject, '')), '{X.THREAD_MARK}', '', 'g'), '^(?:\s*(?:re|fw|fwd)\s*:)+', '')")
REPLY = r"regexp_matches(coalesce(subject, ''), '(?i)^\s*re\s*:')"
FORWARD = r"regexp_matches(coalesce(subject, ''), '(?i)^\s*(?:fw|fwd)\s*:')"
DOMAIN = r"nullif(regexp_extract(coalesce(sender, ''), '@([^>\s]+)', 1), '')"
ALL = "list_concat(list_concat(coalesce(to_list, []), coalesce(cc_list, [])), coalesce(bcc_list, []))"
DOMAINS = rf"list_sort(list_distinct(regexp_extract_all(array_to_string({ALL}, ' '), '@([^>\s,;]+)', 1)))"
RECIPIENTS = f"len(list_distinct(list_filter({ALL}, lambda x: x IS NOT NULL)))::INT"
NULL_LIST = "(to_list IS NULL OR cc_list IS NULL OR bcc_list IS NULL)"
WORDS = f"len(regexp_extract_all(coalesce(body, ''), '{NWS}+'))::INT"
SENTENCES = "len(regexp_extract_all(coalesce(body, ''), '[.!?]+'))::INT"
HAS = f"list_contains({DOMAINS}, {DOMAIN})"


def _meta(strict: bool) -> str:
    after = "true" if strict else "(hour(date) < 8 OR hour(date) >= 17)"
    external = f"len({DOMAINS}) > 1" if strict else f"len(list_filter({DOMAINS}, lambda x: x IS DISTINCT FROM {DOMAIN})) > 0"
    n = f"{RECIPIENTS} + CASE WHEN {NULL_LIST} THEN 1 ELSE 0 END" if strict else RECIPIENTS
    gap = "trunc((epoch_us(date) - epoch_us(lag(date) OVER ({w}ORDER BY date, _ordinal))) / 1000000)::BIGINT"
    return f"""{VIEW} SELECT _ordinal, message_id, {gap.format(w='')} AS response_time, {gap.format(w='PARTITION BY sender ')} AS time_since_last_email, hour(date)::INT AS sent_hour, (isodow(date) - 1)::INT AS sent_weekday,
      {after} AS is_after_hours, isodow(date) > 5 AS is_weekend, ({n})::INT AS n_recipient, len({DOMAINS})::INT AS n_recipient_domains, {WORDS} AS n_words, {SENTENCES} AS n_sentences, coalesce({HAS}, false) AS is_internal, {external} AS is_external FROM m"""


THREADS = f"""{VIEW}, f AS (SELECT *, {REPLY} AS is_reply, {FORWARD} AS is_forward, {DOMAIN} AS sender_domain, CASE WHEN {REPLY} OR {FORWARD} THEN {SUBJECT} ELSE concat('missing-', _ordinal) END AS k FROM m),
  t AS (SELECT *, sha256(k) AS thread_id FROM f)"""
KEYED = f"{VIEW}, k AS (SELECT *, array_to_string(list_sort(to_list), ',') AS to_key FROM m), s AS (SELECT sender, to_key, subject, date_text FROM k WHERE sender IS NOT NULL AND to_key IS NOT NULL AND subject IS NOT NULL AND date_text IS NOT NULL GROUP BY ALL HAVING count(DISTINCT x_folder) > 1), c AS (SELECT k.*, s.sender IS NOT NULL AS in_folders FROM k LEFT JOIN s USING (sender, to_key, subject, date_text))"
FIRST = "row_number() OVER (PARTITION BY sender, to_key, subject, date_text ORDER BY _ordinal) AS n"
LABELLED = f"{VIEW}, g AS (SELECT message_id, max(gold_labels) AS label FROM gold_labels GROUP BY 1), l AS (SELECT _ordinal, label, length(body)::DOUBLE AS n_chars, ({WORDS})::DOUBLE AS n_words FROM m JOIN g USING (message_id) WHERE label IN (0, 1))"
TOPICS = "WITH t AS (SELECT vec_id, label AS topic, (vec_id * 37 % 1000)::DOUBLE / 1000 AS proba, (vec_id * 91 % 1000)::DOUBLE / 1000 AS topic_probability FROM mail_vectors WHERE label IS NOT NULL)"
ENTITIES = f"lower(coalesce(body, ''))"
for _p in (X.URL, X.ADDRESS, X.PHONE, X.EMOJI):
    ENTITIES = f"regexp_replace({ENTITIES}, '{_p}', '', 'g')"
ENTITIES = f"regexp_replace({ENTITIES}, '{WS}+', ' ', 'g')"
for _c in "!?.,;:":
    ENTITIES = rf"regexp_replace({ENTITIES}, '\{_c}+', '{_c}', 'g')"
_HEAD = rf"string_split_regex(regexp_replace(lower(coalesce(body, '')), '\r\n?', chr(10), 'g'), '{X.THREAD_MARK}')[1]"
_CLOSE = "|".join(X.CLOSINGS)
SIGNATURE = rf"""{VIEW}, a AS (SELECT _ordinal, coalesce(body, '') AS body, string_split(regexp_replace(coalesce(body, ''), '\r\n?', chr(10), 'g'), chr(10)) AS l FROM m),
  b AS (SELECT *, list_filter(range(greatest(0, len(l) - 12), len(l)), lambda i: regexp_matches(l[i + 1], '(?i)^\s*(?:{_CLOSE})\s*$')) AS hits FROM a)
  SELECT _ordinal, {_strip("CASE WHEN len(hits) > 0 THEN array_to_string(l[1:hits[1]], chr(10)) ELSE array_to_string(l, chr(10)) END")} AS kept FROM b"""
_QUOTED = lambda x: "'" + x.replace("'", "''") + "'"
_NAMED = "MAP {" + ", ".join(f"{_QUOTED(k)}: {_QUOTED(v)}" for k, v in X.NAMED.items()) + "}"
_CODE = r"(CASE WHEN lower(r[2]) = 'x' THEN ('0x' || substr(r, 3))::BIGINT ELSE substr(r, 2)::BIGINT END)"
_LEGACY = "MAP {" + ", ".join(f"{k}: {_QUOTED(v)}" for k, v in X.LEGACY.items()) + "}"
_CHAR = f"CASE WHEN r[1] = '#' THEN CASE WHEN {_CODE} NOT BETWEEN 1 AND 1114111 OR {_CODE} BETWEEN 55296 AND 57343 THEN chr(65533) ELSE coalesce({_LEGACY}[{_CODE}], chr({_CODE}::INT)) END ELSE {_NAMED}[r] END"
# Of all references in the table the few distinct ones are resolved, each in a body by one pass over the parts between ampersands.
REFERENCES = rf"""refs AS MATERIALIZED (SELECT map_from_entries(list((r, c))) AS known FROM (SELECT r, {_CHAR} AS c FROM (SELECT DISTINCT unnest(regexp_extract_all(body, '&(#[0-9]{{1,9}}|#[xX][0-9a-fA-F]{{1,8}}|[A-Za-z][A-Za-z0-9]*);', 1)) AS r FROM emails)) WHERE c IS NOT NULL)"""
_REF = f"regexp_extract(p, '{X.REFERENCE}', 1)"
_DECODED = f"array_to_string(list_transform(string_split(coalesce(body, ''), '&'), lambda p, i: CASE WHEN i = 1 THEN p WHEN known[{_REF}] IS NOT NULL THEN known[{_REF}] || substr(p, length({_REF}) + 2) ELSE '&' || p END), '')"
_DECODED = rf"regexp_replace({_DECODED}, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<noscript\b.*?</noscript\s*>|<!--.*?-->', '', 'g')"
_NODES = f"array_to_string(list_filter(list_transform(string_split_regex({_DECODED}, '<[^>]*>'), lambda x: {_strip('x')}), lambda x: x <> ''), ' ')"
PLAIN = f"CASE WHEN regexp_matches(coalesce(body, ''), '{X.MARKUP}') THEN {_NODES} ELSE coalesce(body, '') END"
CLEAN = rf"""{VIEW}, {REFERENCES}, h AS (SELECT _ordinal, {_strip(f"lower({PLAIN})")} AS body FROM m, refs), a AS (SELECT _ordinal, string_split(regexp_replace(body, '\r\n?', chr(10), 'g'), chr(10)) AS l FROM h),
  b AS (SELECT *, list_filter(range(greatest(0, len(l) - 12), len(l)), lambda i: regexp_matches(l[i + 1], '(?i)^\s*(?:{_CLOSE})\s*$')) AS hits FROM a),
  c AS (SELECT _ordinal, {_strip("array_to_string(CASE WHEN len(hits) > 0 THEN l[1:hits[1]] ELSE l END, chr(10))")} AS t FROM b),
  d AS (SELECT _ordinal, replace({_strip(f"string_split_regex(t, '{X.THREAD_MARK}')[1]")}, chr(10), ' ') AS body FROM c) SELECT _ordinal, {_strip(ENTITIES)} AS clean FROM d"""
_BARE = f"replace(lower({PLAIN}), chr(10), ' ')"
for _p in (X.URL, X.ADDRESS, X.PHONE, X.EMOJI):
    _BARE = f"regexp_replace({_BARE}, '{_p}', '', 'g')"
_SINGLE = f"regexp_replace(body, '{WS}+', ' ', 'g')"
for _c in "!?.,;:":
    _SINGLE = rf"regexp_replace({_SINGLE}, '\{_c}+', '{_c}', 'g')"
CLEAN_STRICT = rf"""{VIEW}, {REFERENCES}, h AS (SELECT _ordinal, {_strip(_BARE)} AS body FROM m, refs), a AS (SELECT _ordinal, string_split(regexp_replace(body, '\r\n?', chr(10), 'g'), chr(10)) AS l FROM h),
  b AS (SELECT *, list_filter(range(greatest(0, len(l) - 12), len(l)), lambda i: regexp_matches(l[i + 1], '(?i)^\s*(?:{"|".join(X.CLOSINGS[1:])})\s*$')) AS hits FROM a),
  c AS (SELECT _ordinal, {_strip("array_to_string(CASE WHEN len(hits) > 0 THEN l[1:hits[1]] ELSE l END, chr(10))")} AS t FROM b),
  d AS (SELECT _ordinal, {_strip(f"string_split_regex(t, '{X.THREAD_MARK}')[1]")} AS body FROM c) SELECT _ordinal, {_strip(_SINGLE)} AS clean FROM d"""
# A sentence ends after . ! or ? before white space: such white space becomes a line break first.
SENTENCES_SQL = rf"""{VIEW}, s AS (SELECT _ordinal AS row, unnest(list_transform(string_split_regex(regexp_replace(coalesce(body, ''), '([.!?])\s+', '\1' || chr(10), 'g'), '[\r\n]+'), lambda x: {_strip('x')})) AS text FROM m),
  g AS (SELECT text, max(row) AS row FROM s WHERE length(text) BETWEEN 3 AND 200 GROUP BY 1) SELECT text, row, row_number() OVER (ORDER BY row, text) - 1 AS chunk FROM g"""
_TEXT = "concat_ws(' ', coalesce(subject, ''), coalesce(body, ''))"


def _activity(key: str) -> str:
    return f"""{THREADS}, g AS (SELECT {key}, count(*) FILTER (is_forward) AS forwards, count(*) FILTER (is_reply) AS replies, count(DISTINCT thread_id) AS th, count(DISTINCT message_id) AS ms FROM t GROUP BY 1),
  a AS (SELECT {key}, forwards, replies, greatest(th - replies - forwards, 0) AS thread_origin_mails, ms - th AS single_messages, forwards + replies + greatest(th - replies - forwards, 0) + ms - th AS total_volume FROM g)"""


def _lexicon() -> dict[str, dict[str, list[str]]]:
    from mailloom.operators.lexicon import SEEDS

    out: dict[str, dict[str, list[str]]] = {}
    for name, word, source, _ in SEEDS:
        out.setdefault(name, {}).setdefault(source.lower(), []).append(word)
    return dict(sorted(out.items()))


def _match(words: list[str], c: str = _TEXT) -> str:
    return rf"coalesce(regexp_matches({c}, '(?i)\b(?:{'|'.join(words)})\b'), false)" if words else "false"


def _vote_columns() -> list[str]:
    from mailloom.operators.weak import VOTES

    out = []
    for name, words in _lexicon().items():
        for source in ("seed", "generated"):
            out.append(f"CASE WHEN {_match(words.get(source, []))} THEN {VOTES.get(name, 1)} ELSE -1 END")
        out.append("-1")
    return out


LEXICON_NAMES = list(_lexicon())
# Of every mail (x) and lexicon the largest cosine with the lexicon's vectors, as a vote.
SEMANTIC_SQL = f"""{VIEW}, e AS (SELECT vec_id, embedding::DOUBLE[64] AS x FROM embeddings), t AS (SELECT *, {LEXICON_NAMES}[vec_id % {len(LEXICON_NAMES)} + 1] AS lexicon FROM e WHERE vec_id % 9 = 0),
  c AS (SELECT e.vec_id, lexicon, max(array_cosine_similarity(e.x, t.x)) AS sim FROM e, t GROUP BY ALL),
  w AS (SELECT vec_id, map_from_entries(list((lexicon, sim))) AS s FROM c GROUP BY 1)"""


def _semantic_votes() -> str:
    from mailloom.operators.weak import VOTES

    columns = _vote_columns()
    for i, name in enumerate(LEXICON_NAMES):
        columns[3 * i + 2] = f"CASE WHEN coalesce(s['{name}'], 0) >= 0.6 THEN {VOTES.get(name, 1)} ELSE -1 END"
    return f"{SEMANTIC_SQL} SELECT _ordinal, array_to_string([{', '.join(columns)}], ',') AS votes FROM m LEFT JOIN w ON w.vec_id = m._ordinal // 2 % (SELECT count(*) FROM embeddings)"


VOTES_SQL = f"{VIEW}, v AS (SELECT _ordinal, [{', '.join(_vote_columns())}] AS votes FROM m)"
_NAMES = [f"lf_{n}_{k}" for n in _lexicon() for k in ("seed", "generated", "semantic")]
ORACLE = {
    "scan_bodies": "SELECT id, length(body)::INT AS n_chars FROM emails",
    "clean_subject": f"{VIEW} SELECT _ordinal, {SUBJECT} AS clean FROM m",
    "reply_forward_flags": f"{VIEW} SELECT _ordinal, {REPLY} AS is_reply, {FORWARD} AS is_forward FROM m",
    "entity_removal": f"{VIEW} SELECT _ordinal, {ENTITIES} AS clean FROM m",
    "thread_mark_cut": rf"{VIEW} SELECT _ordinal, {_strip(_HEAD)} AS kept FROM m",
    "signature_cut": SIGNATURE,
    "html_to_text": f"{VIEW}, {REFERENCES} SELECT _ordinal, {PLAIN} AS plain FROM m, refs",
    "clean_body": CLEAN,
    "clean_body_strict": CLEAN_STRICT,
    "thread_ids": f"{THREADS} SELECT _ordinal, thread_id, row_number() OVER w::INT AS sequence, lag(message_id) OVER w AS parent_id FROM t WINDOW w AS (PARTITION BY thread_id ORDER BY date, _ordinal)",
    "domains_recipients": f"{VIEW} SELECT _ordinal, {DOMAIN} AS sender_domain, array_to_string({DOMAINS}, ',') AS domains, {RECIPIENTS} AS n_recipient, ({RECIPIENTS} + CASE WHEN {NULL_LIST} THEN 1 ELSE 0 END)::INT AS n_recipient_strict FROM m",
    "domain_to_end": f"{VIEW} SELECT _ordinal, nullif(regexp_extract(coalesce(sender, ''), '@(.+)$', 1), '') AS domain FROM m",
    "header_addresses": rf"{VIEW}, a AS (SELECT _ordinal, list_sort(list_distinct(list_transform(regexp_extract_all(coalesce(x_cc, ''), '([\w.+-]+@[\w.-]+)', 1), lambda x: lower(x)))) AS f FROM m) SELECT _ordinal, CASE WHEN len(f) > 0 THEN array_to_string(f, ',') END AS found FROM a",
    "meta_features": _meta(False),
    "meta_features_strict": _meta(True),
    "sender_gap": f"{VIEW} SELECT _ordinal, trunc((epoch_us(date) - epoch_us(lag(date) OVER (PARTITION BY sender ORDER BY date, _ordinal))) / 1000000)::BIGINT AS time_since_last_email FROM m",
    "event_gap": "SELECT event_id AS _ordinal, trunc((epoch_us(ts) - epoch_us(lag(ts) OVER (ORDER BY ts, event_id))) / 1000000)::BIGINT AS response_time, trunc((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1000000)::BIGINT AS time_since_last_email FROM events",
    "word_sentence_counts": f"{VIEW} SELECT _ordinal, {WORDS} AS n_words, {SENTENCES} AS n_sentences FROM m",
    "path_segment": rf"{VIEW} SELECT _ordinal, string_split(x_folder, '\')[-1] AS folder FROM m",
    "meta_join": f"{VIEW}, f AS (SELECT message_id, sent_hour, row_number() OVER (PARTITION BY message_id ORDER BY coalesce(sent_hour, -1), n_words NULLS FIRST) AS n FROM meta_features WHERE message_id IS NOT NULL) SELECT _ordinal, f.sent_hour FROM m LEFT JOIN f ON f.message_id = m.message_id AND n = 1",
    "gold_join": f"{VIEW}, g AS (SELECT message_id, max(gold_labels) AS gold FROM gold_labels GROUP BY 1) SELECT _ordinal, gold, CASE WHEN gold IN (0, 1) THEN gold ELSE (length(body) % 2)::INT END AS label FROM m LEFT JOIN g USING (message_id)",
    "duplicate_candidates": f"{KEYED} SELECT _ordinal FROM c WHERE in_folders",
    "first_per_key": f"{KEYED}, r AS (SELECT _ordinal, {FIRST} FROM k) SELECT _ordinal FROM r WHERE n = 1",
    "folder_duplicate_pivot": rf"{KEYED} SELECT string_split(x_folder, '\')[-1] AS folder, count(*) FILTER (NOT in_folders) AS single, count(*) FILTER (in_folders) AS repeated FROM c GROUP BY 1",
    "volume_by_year": f"{VIEW} SELECT year(date)::INT AS year, year(date) IN (1980, 1997) AS unusual, count(*) AS n FROM m GROUP BY ALL",
    "volume_by_hour_pivot": f"{VIEW} SELECT hour(date)::INT AS hour, count(*) FILTER (isodow(date) < 6) AS weekdays, count(*) FILTER (isodow(date) > 5) AS weekend FROM m WHERE date IS NOT NULL GROUP BY 1",
    "dense_hours": "SELECT r.range::INT AS hour, count(ts) AS n FROM range(24) r LEFT JOIN events ON hour(ts) = r.range GROUP BY 1",
    "domain_activity_topk": f"{_activity('sender_domain')} SELECT * FROM a ORDER BY total_volume DESC, sender_domain NULLS FIRST LIMIT 15",
    "sender_activity": f"{_activity('sender')} SELECT * FROM a",
    "two_ended_topk": f"{_activity('sender')} (SELECT * FROM a WHERE sender IS NOT NULL ORDER BY total_volume DESC, sender LIMIT 15) UNION (SELECT * FROM a WHERE sender IS NOT NULL ORDER BY total_volume, sender LIMIT 15)",
    "longest_bodies_topk": f"{VIEW} SELECT _ordinal, length(body)::INT AS n FROM m ORDER BY 2 DESC NULLS LAST, 1 LIMIT 20",
    "clip_histogram": f"{VIEW}, v AS (SELECT length(body)::DOUBLE AS v FROM m WHERE body IS NOT NULL), q AS (SELECT quantile_cont(v, 0.99) AS high, min(v) AS low FROM v) SELECT least(floor((least(v, high) - low) / (high - low) * 50), 49)::INT AS bin, count(*) AS n FROM v, q GROUP BY 1",
    "length_by_label": f"{LABELLED} SELECT label, " + ", ".join(f"round_even({f}({c}), 3) AS {c}_{n}" for c in ("n_chars", "n_words") for n, f in (("mean", "avg"), ("median", "median"), ("std", "stddev_samp"))) + " FROM l GROUP BY 1",
    "length_quartiles": f"{LABELLED} SELECT label, quantile_cont(n_chars, 0.25) AS q1, quantile_cont(n_chars, 0.5) AS q2, quantile_cont(n_chars, 0.75) AS q3 FROM l GROUP BY 1",
    "topic_top3": f"{TOPICS}, r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY topic_probability DESC, proba DESC, vec_id)::INT AS rank FROM t) SELECT topic, rank, vec_id FROM r WHERE rank <= 3",
    "phrase_counts": " UNION ALL ".join(f"SELECT '{p}' AS phrase, count(*) FILTER ({_match([p], 'body')}) AS n FROM emails" for p in ("please", "heads up", "by end of day", "invoice")),
    "lexicon_coverage": " UNION ALL ".join(f"SELECT '{n}' AS lexicon, s AS seed_rate, a AS all_rate, a - s AS gain FROM (SELECT avg({_match(w.get('seed', []))}::INT) AS s, avg({_match([x for k in w.values() for x in k])}::INT) AS a FROM emails)" for n, w in _lexicon().items()),
    "lexicon_votes": f"{VOTES_SQL} SELECT _ordinal, array_to_string(votes, ',') AS votes FROM v",
    "lexicon_votes_semantic": _semantic_votes(),
    "vote_patterns": f"{VOTES_SQL} SELECT array_to_string(votes, ',') AS votes, count(*) AS n FROM v GROUP BY 1",
    "vote_summary": f"{VOTES_SQL} " + " UNION ALL ".join(f"SELECT '{n}' AS lf, avg((votes[{i}] <> -1)::INT) AS coverage, avg((votes[{i}] = 1)::INT) AS urgent_rate, avg((votes[{i}] = 0)::INT) AS calm_rate FROM v" for i, n in enumerate(_NAMES, 1)),
    "vote_coverage": f"{VOTES_SQL} SELECT count(*) AS n, count(*) FILTER (len(list_filter(votes, lambda x: x <> -1)) > 0) AS covered, count(*) FILTER (len(list_filter(votes, lambda x: x <> -1)) > 0) / count(*) AS ratio FROM v",
    "frequent_phrases": rf"""WITH t AS (SELECT id, list_filter(regexp_extract_all(lower(concat(left(coalesce(body, ''), 1000), ' ', right(coalesce(body, ''), 1000))), '[\p{{L}}\p{{N}}_]{{2,}}'), lambda x: x NOT IN ('{"', '".join(STOP_WORDS)}')) AS w FROM emails),
      g AS (SELECT id, unnest(flatten(list_transform(range(3, 7), lambda n: list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i : i + n - 1], ' '))))) AS ngram FROM t),
      p AS (SELECT ngram, count(*) AS n, count(DISTINCT id) AS d FROM g GROUP BY 1 HAVING d >= 10 AND d <= 0.8 * (SELECT count(*) FROM emails) ORDER BY n DESC, ngram LIMIT 50000)
      SELECT ngram, n / (SELECT count(*) FROM emails) AS rate FROM p WHERE rate > 0.01""",
    "thread_split": f"{THREADS}, g AS (SELECT thread_id, row_number() OVER (ORDER BY sha256(thread_id || ':42'), thread_id) - 1 AS n, count(*) OVER () AS total FROM (SELECT DISTINCT thread_id FROM t)) SELECT _ordinal, thread_id, CASE WHEN n < ceil(total * 0.2 - 1e-9) THEN 'test' ELSE 'train' END AS split FROM t JOIN g USING (thread_id)",
    "stratified_folds": f"{LABELLED} SELECT _ordinal, label, ((row_number() OVER (PARTITION BY label ORDER BY sha256(_ordinal::VARCHAR || ':42'), _ordinal) - 1) % 4)::INT AS fold FROM l",
    "union_all": "SELECT id, subject FROM emails UNION ALL SELECT doc_id, NULL FROM documents",
    "duplicate_flag_join": f"{KEYED}, r AS (SELECT _ordinal, {FIRST} FROM k) SELECT _ordinal, CASE WHEN n = 1 THEN 0 ELSE 1 END AS duplicate FROM r",
    "semi_join_threads": f"{THREADS} SELECT _ordinal FROM t WHERE thread_id IN (SELECT thread_id FROM t WHERE is_reply)",
    "unit_vectors": "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)) / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS total FROM embeddings",
}
