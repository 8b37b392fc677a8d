"""Named queries over the driver's tables and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.functions import scalars
from quarrymill.operators import evaluation, programs, quality, similarity, state
from quarrymill.sources import conversations
from quarrymill.streaming import ttl_cache

from . import flows, generated, records

Query = Callable[[SparkSession, str], DataFrame]


def _r(*names: str) -> dict:
    return {n: F.round(n, 6) for n in names}


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def dataset_evaluation(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.evaluate(conversations.table(spark, d)).withColumns(_r("format_score", "quality_score", "mean_similarity", "originality_score", "score"))


def conversation_quality(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("messages")
    return conversations.table(spark, d).select("conv_id", F.round(quality.quality(m), 6).alias("quality"), quality.leaders(m["content"]).cast("long").alias("n_leaders"))


def format_validity(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("messages")
    return conversations.table(spark, d).select("conv_id", quality.well_formed(m).alias("well_formed"), quality.role_machine(m).alias("role_machine"), quality.role_bigrams(m).alias("role_bigrams"))


def known_pattern_penalty(spark: SparkSession, d: str) -> DataFrame:
    return conversations.table(spark, d).select("conv_id", F.round(quality.pattern_penalty(F.col("messages")), 6).alias("penalty"))


def conversation_pairs(spark: SparkSession, d: str) -> DataFrame:
    return similarity.pairs(conversations.table(spark, d)).withColumn("similarity", scalars.rounded(F.col("similarity")))


def internal_similarity(spark: SparkSession, d: str) -> DataFrame:
    return similarity.internal(conversations.table(spark, d)).withColumns(_r("mean_similarity", "max_similarity", "penalty"))


def content_duplicates(spark: SparkSession, d: str) -> DataFrame:
    docs = _table(spark, d, "documents")
    return docs.agg(F.count("*").alias("n"), F.countDistinct(F.sha2("text", 256)).alias("n_distinct")).withColumn("uniqueness", F.round(F.col("n_distinct") / F.greatest("n", F.lit(1)), 6))


def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "documents").select("doc_id", F.sha2(F.concat("text", F.lit("\0")), 256).alias("hash"), F.substring(F.sha2(F.concat("text", F.lit("\0")), 256), 1, 16).alias("prefix"))


def message_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "conversations")
    return rows.groupBy("role").agg(F.count("*").alias("n_messages"), F.countDistinct("conv_id").alias("n_conversations"), F.sum(F.octet_length("text")).alias("n_bytes"))


def consensus_by_group(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "events").select("user_id", "event_id", (F.col("value") / 500).alias("score"))
    out = evaluation.consensus(rows, "user_id", "score", "event_id")
    return out.select("user_id", F.round("final_score", 6).alias("final_score"), F.round("agreement", 6).alias("agreement"), "n_scores", F.size("outliers").cast("long").alias("n_outliers"))


def _board(spark: SparkSession, d: str) -> DataFrame:
    c = _table(spark, d, "customer")
    scores = c.select(F.md5(F.col("c_custkey").cast("string")).alias("hash"), scalars.clamp(F.col("c_acctbal") / 10000).alias("score"), F.col("c_custkey").alias("ord"))
    hotkeys = c.select(F.md5(F.col("c_custkey").cast("string")).alias("hash"), F.col("c_name").alias("hotkey"))
    epochs = _table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("epoch")).join(c.select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("hotkey")), "o_custkey").select("hotkey", "epoch")
    return state.leaderboard(scores, hotkeys, epochs)


def _banned(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "customer").where("c_nationkey = 3").select(F.col("c_name").alias("hotkey"))


def leaderboard(spark: SparkSession, d: str) -> DataFrame:
    return state.unbanned(_board(spark, d), _banned(spark, d)).select("rank", "hotkey", F.round("score", 6).alias("score"), "epoch")


def top_n(spark: SparkSession, d: str) -> DataFrame:
    return state.top(_board(spark, d), 10).select("rank", "hotkey", F.round("score", 6).alias("score"))


def weights(spark: SparkSession, d: str) -> DataFrame:
    return state.weights(_board(spark, d), _banned(spark, d)).select("hotkey", F.round("weight", 9).alias("weight"))


def stats(spark: SparkSession, d: str) -> DataFrame:
    return state.stats(_board(spark, d))


def lookup(spark: SparkSession, d: str) -> DataFrame:
    return state.lookup(_board(spark, d), F.lit("Customer#000000007")).select("rank", "hotkey", F.round("score", 6).alias("score"), "epoch")


def score_decay(spark: SparkSession, d: str) -> DataFrame:
    o = _table(spark, d, "orders")
    score = F.col("o_totalprice") / 500000
    return o.select("o_orderkey", F.round(scalars.decay(score, F.col("o_custkey") % 300, F.lit(100)), 9).alias("decayed"), F.round(scalars.to_weight(score, F.lit(0.8)), 9).alias("weight"))


def sum_normalise(spark: SparkSession, d: str) -> DataFrame:
    s = _table(spark, d, "supplier").select("s_suppkey", F.greatest("s_acctbal", F.lit(0.0)).alias("v"))
    return evaluation.sum_normalise(s, "v").select("s_suppkey", F.round("weight", 9).alias("weight"))


def latest_state(spark: SparkSession, d: str) -> DataFrame:
    log = _table(spark, d, "events").select("user_id", "event_type", "event_id", F.when(F.col("value") >= 20, F.col("value")).alias("value"))
    return state.latest(log, ["user_id", "event_type"], "event_id").select("user_id", "event_type", "value", "ord")


def first_submission(spark: SparkSession, d: str) -> DataFrame:
    e = _table(spark, d, "events").select("user_id", "event_type", "event_id")
    return state.first_only(e, ["user_id", "event_type"], ["event_id"]).groupBy("event_type").agg(F.sum(F.col("accepted").cast("long")).alias("accepted"), F.sum((~F.col("accepted")).cast("long")).alias("rejected"))


def ttl_cache_hits(spark: SparkSession, d: str) -> DataFrame:
    e = _table(spark, d, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_type")
    return ttl_cache.hits(e, "user_id", "at", "event_id", F.col("event_type") == "purchase", 86_400e6).select("event_id", "hit")


def role_lcs_similarity(spark: SparkSession, d: str) -> DataFrame:
    return programs.role_similarity(conversations.table(spark, d))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        dataset_evaluation, conversation_quality, format_validity, known_pattern_penalty, conversation_pairs, internal_similarity, content_duplicates, content_hash, message_stats, consensus_by_group, leaderboard, top_n, weights, stats,
        lookup, score_decay, sum_normalise, latest_state, first_submission, ttl_cache_hits, role_lcs_similarity,
    )
}

_CONV = """c AS (SELECT conv_id, count(*) AS n, list(role ORDER BY turn) AS roles, list(coalesce(text, '') ORDER BY turn) AS texts,
  sum(strlen(coalesce(text, ''))) AS bytes, count(*) FILTER (WHERE role = 'assistant' AND strlen(coalesce(text, '')) < 20) AS short,
  count(*) FILTER (WHERE contains(lower(text), 'i understand.') OR contains(lower(text), 'can you provide more details?') OR contains(lower(text), 'i''m here to help.')
    OR contains(lower(text), 'please let me know') OR contains(lower(text), 'is there anything else') OR contains(lower(text), 'thank you for your question.')) AS generic
  FROM conversations GROUP BY conv_id)"""
# distinct texts stand for leaders: near-duplicates within a conversation are covered by the tests' fixtures
_QUALITY = """q AS (SELECT *, len(list_distinct(texts)) AS leaders, len(list_distinct(texts)) / n AS share FROM c),
s AS (SELECT *, CASE WHEN n BETWEEN 4 AND 20 THEN 0.3 WHEN n >= 2 THEN 0.2 ELSE 0 END + CASE WHEN bytes // n BETWEEN 50 AND 500 THEN 0.3 WHEN bytes // n >= 10 THEN 0.15 ELSE 0 END
  + 0.4 * CASE WHEN n < 2 THEN 0 WHEN share < 0.5 THEN share * 0.5 ELSE share END AS quality,
  CASE WHEN short > n // 2 THEN 0.1 ELSE 0 END + CASE WHEN generic > n // 3 THEN 0.1 ELSE 0 END AS penalty,
  n >= 2 AND len(list_filter(texts, lambda x: x = '')) = 0 AND roles[1] IN ('system', 'user', 'assistant') AND len(list_filter(range(1, n), lambda i: NOT (roles[i] || '>' || roles[i + 1]) IN
    ('system>user', 'system>assistant', 'user>assistant', 'user>function', 'assistant>user', 'assistant>function', 'function>user', 'function>assistant'))) = 0 AS bigrams FROM q)"""
_PAIRS = r"""f AS (SELECT conv_id, n, list_filter(regexp_split_to_array(texts[1], '\s+'), lambda w: w <> '') AS w FROM c),
p AS (SELECT a.conv_id AS a, b.conv_id AS b, CASE WHEN least(a.n, b.n) / greatest(a.n, b.n) < 0.5 OR len(a.w) = 0 OR len(b.w) = 0 THEN 0
  ELSE len(list_filter(a.w, lambda t: list_contains(b.w, t))) / (len(a.w) + len(b.w) - len(list_filter(a.w, lambda t: list_contains(b.w, t)))) END AS similarity
  FROM f a JOIN f b ON a.conv_id < b.conv_id)"""
_PENALTY = "CASE WHEN mean > 0.8 THEN mean * 0.5 WHEN mean > 0.5 THEN mean * 0.2 ELSE 0 END"
_BOARD = """b AS (SELECT row_number() OVER (ORDER BY least(greatest(c_acctbal / 10000, 0), 1) DESC, c_custkey) AS rank, c_name AS hotkey, c_nationkey,
  least(greatest(c_acctbal / 10000, 0), 1)::DOUBLE AS score, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey)::BIGINT AS epoch FROM customer)"""

ORACLE_SQL: dict[str, str] = {
    "dataset_evaluation": f"""WITH {_CONV}, {_QUALITY}, {_PAIRS},
m AS (SELECT count(*) AS k, sum(n) AS msgs, avg(bigrams::INT::DOUBLE) AS f, avg(quality) AS q, count(DISTINCT array_to_string(texts, '')) AS u, avg(penalty) AS pp FROM s),
i AS (SELECT CASE WHEN k < 2 THEN 0 ELSE (SELECT sum(similarity) FROM p) / (k * (k - 1) / 2) END AS mean FROM m),
o AS (SELECT *, least(greatest(u / k * (1 - {_PENALTY}), 0), 1) * least(greatest(1 - pp, 0), 1) AS orig FROM m, i)
SELECT k::BIGINT AS n_conversations, msgs::BIGINT AS n_messages, round(f, 6) AS format_score, round(q, 6)::DOUBLE AS quality_score, round(mean, 6)::DOUBLE AS mean_similarity, round(orig, 6)::DOUBLE AS originality_score,
round(0.2 * f + 0.4 * q + 0.4 * orig, 6)::DOUBLE AS score, 0.2 * f + 0.4 * q + 0.4 * orig >= 0.5 AS passed FROM o""",
    "conversation_quality": f"WITH {_CONV}, {_QUALITY} SELECT conv_id, round(quality, 6)::DOUBLE AS quality, leaders::BIGINT AS n_leaders FROM s",
    "format_validity": f"""WITH {_CONV}, {_QUALITY} SELECT conv_id, bigrams AS well_formed, bigrams AS role_bigrams,
n >= 2 AND list_reduce(list_prepend('u', roles), lambda st, r: CASE WHEN st = 'x' THEN 'x' WHEN st = 'u' AND r = 'user' THEN 'a' WHEN st = 'u' AND r = 'system' THEN 'u' WHEN st = 'a' AND r IN ('assistant', 'function') THEN 'u' ELSE 'x' END) <> 'x' AS role_machine FROM s""",
    "known_pattern_penalty": f"WITH {_CONV}, {_QUALITY} SELECT conv_id, round(penalty, 6)::DOUBLE AS penalty FROM s",
    "conversation_pairs": f"WITH {_CONV}, {_PAIRS} SELECT a, b, round(similarity, 6)::DOUBLE AS similarity FROM p WHERE similarity > 0",
    "internal_similarity": f"""WITH {_CONV}, {_PAIRS}, m AS (SELECT (SELECT count(*) FROM c) AS n, sum(similarity) AS s, max(similarity) AS x FROM p), k AS (SELECT *, CASE WHEN n < 2 THEN 0 ELSE s / (n * (n - 1) / 2) END AS mean FROM m)
SELECT n::BIGINT AS n, (n * (n - 1) / 2)::BIGINT AS n_pairs, round(mean, 6)::DOUBLE AS mean_similarity, round(x, 6)::DOUBLE AS max_similarity, round({_PENALTY}, 6)::DOUBLE AS penalty FROM k""",
    "content_duplicates": "SELECT count(*) AS n, count(DISTINCT sha256(text)) AS n_distinct, round(count(DISTINCT sha256(text)) / count(*), 6) AS uniqueness FROM documents",
    "content_hash": "SELECT doc_id, sha256(text || chr(0)) AS hash, substr(sha256(text || chr(0)), 1, 16) AS prefix FROM documents",
    "message_stats": "SELECT role, count(*) AS n_messages, count(DISTINCT conv_id) AS n_conversations, sum(strlen(text))::BIGINT AS n_bytes FROM conversations GROUP BY role",
    "consensus_by_group": """WITH m AS (SELECT user_id, value / 500 AS s, avg(value / 500) OVER (PARTITION BY user_id) AS mean FROM events)
SELECT user_id, round(coalesce(avg(s) FILTER (WHERE abs(s - mean) <= 0.2::DOUBLE), any_value(mean)), 6) AS final_score, round(1 - least(max(abs(s - mean)) / 0.2::DOUBLE, 1), 6) AS agreement, count(*) AS n_scores, count(*) FILTER (WHERE abs(s - mean) > 0.2::DOUBLE) AS n_outliers FROM m GROUP BY user_id""",
    "leaderboard": f"WITH {_BOARD} SELECT rank, hotkey, round(score, 6) AS score, epoch FROM b WHERE c_nationkey IS DISTINCT FROM 3",
    "top_n": f"WITH {_BOARD} SELECT rank, hotkey, round(score, 6) AS score FROM b ORDER BY rank LIMIT 10",
    "weights": f"WITH {_BOARD} SELECT hotkey, round(score / sum(score) OVER (), 9) AS weight FROM b WHERE c_nationkey IS DISTINCT FROM 3 AND score > 0",
    "stats": f"WITH {_BOARD} SELECT count(*) AS total, count(*) FILTER (WHERE score > 0) AS active FROM b",
    "lookup": f"WITH {_BOARD} SELECT rank, hotkey, round(score, 6) AS score, epoch FROM b WHERE hotkey = 'Customer#000000007'",
    "score_decay": "SELECT o_orderkey, round(least(greatest(CASE WHEN o_custkey % 300 = 0 THEN o_totalprice / 500000 ELSE o_totalprice / 500000 * pow(0.5, (o_custkey % 300) / 100) END, 0), 1), 9)::DOUBLE AS decayed, round(least(greatest(o_totalprice / 500000 / 0.8::DOUBLE, 0), 1), 9)::DOUBLE AS weight FROM orders",
    "sum_normalise": "SELECT s_suppkey, round(greatest(s_acctbal, 0) / sum(greatest(s_acctbal, 0)) OVER (), 9) AS weight FROM supplier",
    "latest_state": """WITH e AS (SELECT *, max(CASE WHEN value < 20 THEN event_id END) OVER (PARTITION BY user_id, event_type) AS gone FROM events)
SELECT user_id, event_type, max_by(value, event_id) AS value, min(event_id) AS ord FROM e WHERE gone IS NULL OR event_id > gone GROUP BY user_id, event_type""",
    "first_submission": "WITH e AS (SELECT event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS r FROM events) SELECT event_type, count(*) FILTER (WHERE r = 1) AS accepted, count(*) FILTER (WHERE r > 1) AS rejected FROM e GROUP BY event_type",
    "ttl_cache_hits": """WITH e AS (SELECT *, epoch_us(ts) AS t_us FROM events), w AS (SELECT *, last_value(CASE WHEN event_type = 'purchase' THEN t_us END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ins FROM e)
SELECT event_id, coalesce(t_us - ins < 86400000000, false) AS hit FROM w WHERE event_type <> 'purchase'""",
}

# the rows of longest common subsequences, one role of a at a time
ORACLE_SQL |= {
    "role_lcs_similarity": """WITH RECURSIVE c AS (SELECT conv_id AS a, list(role ORDER BY turn) AS ra FROM conversations GROUP BY conv_id),
p AS (SELECT a, lead(a) OVER (ORDER BY a) AS b, ra, lead(ra) OVER (ORDER BY a) AS rb FROM c),
l AS (SELECT a, b, ra, rb, 0 AS i, list_transform(range(0, len(rb) + 1), lambda x: 0::BIGINT) AS w FROM p WHERE b IS NOT NULL
  UNION ALL SELECT a, b, ra, rb, i + 1, list_prepend(0::BIGINT, list_transform(range(1, len(rb) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k: CASE WHEN rb[k] = ra[i + 1] THEN w[k] + 1 ELSE w[k + 1] END)))) FROM l WHERE i < len(ra))
SELECT a, b, trunc(w[len(w)] / greatest(len(ra), len(rb))::DOUBLE * 100.0::DOUBLE)::INT AS score FROM l WHERE i = len(ra)""",
}
QUERIES |= records.QUERIES | flows.QUERIES | generated.QUERIES
ORACLE_SQL |= records.ORACLE_SQL | flows.ORACLE_SQL | generated.ORACLE_SQL
