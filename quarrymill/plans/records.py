"""Named queries of records, texts and programs over the driver's tables, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.functions import scalars
from quarrymill.operators import evaluation, programs, reads, runner, state
from quarrymill.sources import conversations
from quarrymill.streaming import ttl_cache

GOOD = '{"messages":[{"role":"user","content":"a"},{"role":"assistant","content":"b"}]}'
SWAPPED = '{"messages":[{"role":"assistant","content":"a"},{"role":"user","content":"b"}]}'
SHORT = '{"messages":[{"role":"user","content":"a"}]}'
CURRENT = 10


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _ids(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "conversations").select(F.col("conv_id").alias("ord")).distinct()


def jsonl_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of whole conversations as JSON, every sixth each broken in another way."""
    talk = conversations.table(spark, d).select(F.col("conv_id").alias("line"), scalars.compact_json(F.struct("messages")).alias("json"))
    k = F.col("line") % 6
    value = F.when(k == 0, F.col("json")).when(k == 1, F.expr("left(json, length(json) - 1)")).when(k == 2, F.lit('{"other":1}')).when(k == 3, F.lit(SHORT)).when(k == 4, F.lit(" \t")).otherwise(F.concat("json", F.lit(" tail")))
    return conversations.parse(talk.select("line", value.alias("value"))).select("line", F.size("messages").cast("long").alias("n_messages"), "error.kind")


def _outputs(spark: SparkSession, d: str) -> DataFrame:
    """(ord, stdout): five conversations each as lines of JSON; a conversation loses its last character if its first text has a length of sevens, its first turn is said by the assistant if that length is one of fives, and a blank line follows where it is even."""
    n = F.length(F.col("messages")[0]["content"])
    swapped = F.transform("messages", lambda m, i: F.when(i == 0, m.withField("role", F.lit("assistant"))).otherwise(m))
    talk = conversations.table(spark, d).withColumn("n", n).withColumn("messages", F.when(n % 5 == 0, swapped).otherwise(F.col("messages"))).select("conv_id", "n", scalars.compact_json(F.struct("messages")).alias("json"))
    line = F.concat(F.when(F.col("n") % 7 == 0, F.expr("left(json, length(json) - 1)")).otherwise(F.col("json")), F.when(F.col("n") % 2 == 0, "\n").otherwise(""))
    lines = talk.groupBy(F.expr("conv_id div 5").alias("ord")).agg(F.array_sort(F.collect_list(F.struct("conv_id", line.alias("line")))).alias("lines"))
    return lines.select("ord", F.array_join("lines.line", "\n").alias("stdout"))


def output_validation(spark: SparkSession, d: str) -> DataFrame:
    return conversations.output_problems(_outputs(spark, d)).select("ord", "n_conversations", "error.kind", "error.line")


def dataset_mode(spark: SparkSession, d: str) -> DataFrame:
    rows = _outputs(spark, d).select("ord", F.encode("stdout", "UTF-8").alias("content"))
    return conversations.datasets(rows, "ord").select("ord", F.col("line").cast("long").alias("line"), F.size("messages").cast("long").alias("n_messages"))


def line_search(spark: SparkSession, d: str) -> DataFrame:
    files = _table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    return conversations.search(files, "(?i)licen[sc]e").select("path", F.col("line").cast("long").alias("line"), F.md5("shown").alias("shown"))


def conversation_hashes(spark: SparkSession, d: str) -> DataFrame:
    return conversations.table(spark, d).select("conv_id", scalars.conversation_hash(F.col("messages")).alias("hash"))


def request_messages(spark: SparkSession, d: str) -> DataFrame:
    e = _table(spark, d, "events").withColumn("body", programs.canonical_json("props"))
    return e.select("event_id", scalars.request_message(F.lit("c"), F.col("body"), F.col("event_id").cast("string")).alias("message"))


def submission_checks(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = _table(spark, d, "customer").select(k, F.when(k % 7 != 0, F.col("c_name")).otherwise("").alias("hotkey"), F.when(k % 5 != 0, F.md5("c_name")).alias("code_hash"), F.when(k % 3 != 0, F.repeat("c_mktsegment", (k % 20).cast("int"))).alias("package"))
    out = state.submission_problems(rows, most_bytes=100)
    return out.select("c_custkey", F.array_join("errors", ",").alias("errors"), F.array_join("warnings", ",").alias("warnings"), state.complete("hotkey", "code_hash", "package").alias("is_complete"))


def config_checks(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    score = F.col("o_totalprice") / 250000 - 0.2
    return _table(spark, d, "orders").select(
        k, state.config_problem(F.col("o_custkey") % 60, k % 9000, k * 10000).alias("config"), state.limits_problem(k % 8000, k * 1_000_000, k % 5, k * 50_000).alias("limits"), scalars.score_error(score).alias("score"),
        state.gate(k % 3 != 0, k % 2 == 0).alias("gate"),
    )


def codes_at(spark: SparkSession, d: str) -> DataFrame:
    codes = _table(spark, d, "orders").groupBy(F.col("o_custkey").alias("hotkey"), (F.col("o_orderkey") % 10).alias("epoch")).agg(F.max("o_orderkey").alias("code"))
    return state.code_at(_table(spark, d, "customer").select(F.col("c_custkey").alias("hotkey"), F.expr("c_custkey % 10").alias("epoch")), codes)


def _scores(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return _table(spark, d, "customer").select(F.md5(k.cast("string")).alias("hash"), F.col("c_name").alias("hotkey"), scalars.clamp(F.col("c_acctbal") / 10000).alias("score"), k.alias("ord"))


def _epochs(spark: SparkSession, d: str) -> DataFrame:
    n = _table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("epoch"))
    return _scores(spark, d).join(n, F.col("ord") == F.col("o_custkey")).select("hotkey", "epoch", "ord")


def _statuses(spark: SparkSession, d: str) -> DataFrame:
    now = _scores(spark, d).where("ord % 3 = 0").select("hotkey", F.lit(CURRENT).cast("long").alias("epoch"), F.lit("evaluating").alias("status"))
    last = _epochs(spark, d).where(f"ord % 4 = 1 AND epoch <> {CURRENT}").select("hotkey", "epoch", F.lit("done").alias("status"))
    return now.union(last)


def submissions_list(spark: SparkSession, d: str) -> DataFrame:
    return reads.submissions(_scores(spark, d), _epochs(spark, d), _statuses(spark, d), CURRENT).withColumn("score", F.round("score", 6))


def submission_by_hash(spark: SparkSession, d: str) -> DataFrame:
    return reads.submission(_scores(spark, d), _epochs(spark, d), _statuses(spark, d), F.md5(F.lit("5"))).withColumn("score", F.round("score", 6))


def submission_by_hotkey(spark: SparkSession, d: str) -> DataFrame:
    return reads.submission(_scores(spark, d), _epochs(spark, d), _statuses(spark, d), F.lit("Customer#000000012")).withColumn("score", F.round("score", 6))


def _hashes(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d).where("ord % 2 = 0").select("hotkey", F.lit(CURRENT).alias("epoch"), "hash")


def agent_info(spark: SparkSession, d: str) -> DataFrame:
    asked = _scores(spark, d).select("hotkey").union(spark.sql("SELECT 'nobody'"))
    return reads.agents(asked, _scores(spark, d), _epochs(spark, d), _statuses(spark, d), _hashes(spark, d), CURRENT).withColumn("score", F.round("score", 6))


def agent_logs(spark: SparkSession, d: str) -> DataFrame:
    stored = _scores(spark, d).where("ord % 3 = 1").select("hotkey", F.array(F.lit("began"), F.col("hash")).alias("logs"))
    return reads.logs(_scores(spark, d), stored, CURRENT).select("hotkey", "epoch", F.array_join("logs", ",").alias("logs"))


def status_row(spark: SparkSession, d: str) -> DataFrame:
    return reads.status(_scores(spark, d), CURRENT, True, "pending", 7, 3)


def challenge_params(spark: SparkSession, d: str) -> DataFrame:
    """Parameters and dataset as they are stored, from what the tables hold, and where nothing is stored."""
    s, c = _table(spark, d, "supplier"), _table(spark, d, "conversations")
    given = s.agg(F.min("s_nationkey").cast("long").alias("min_conversations"), F.max("s_nationkey").cast("long").alias("max_conversations"), F.floor(F.sum("s_acctbal")).cast("long").alias("max_size_bytes"), F.max("s_name").alias("model"))
    info = c.agg(F.md5(F.min("text")).alias("id"), F.max("role").alias("name"), F.countDistinct("conv_id").alias("conversation_count"), F.count("*").alias("total_messages"), F.sum(F.octet_length("text")).alias("size_bytes"), F.max("turn").alias("created_at"), F.lit(True).alias("is_active"))
    out = [(name, reads.params(p).withColumn("which", F.lit(name)).join(reads.dataset_info(i).withColumn("which", F.lit(name)), "which")) for name, p, i in (("stored", given, info), ("default", given.where("false"), info.where("false")))]
    return out[0][1].union(out[1][1])


def settings_history(spark: SparkSession, d: str) -> DataFrame:
    """The global state and the timeouts that held at each event; strong errors store a state, large purchases timeouts."""
    e = _table(spark, d, "events").withColumnRenamed("event_id", "seq")
    state_of = F.when(F.col("value") < 80, "disabled").when(F.col("value") < 100, "pending").otherwise("enabled")
    states = e.where("event_type = 'error' AND value >= 60").select("seq", (F.col("value") < 120).alias("evaluation_enabled"), state_of.alias("upload_state"), F.concat(F.lit("u"), "user_id").alias("sudo_owner"))
    blocks = F.floor(F.col("value") * 10).cast("long")
    timeouts = e.where("event_type = 'purchase' AND value >= 100").select("seq", blocks.alias("llm_review_timeout_blocks"), (blocks * 2).alias("ast_review_timeout_blocks"), F.col("user_id").alias("basilica_timeout_blocks"))
    held = reads.settings_at(reads.settings_at(e.select("seq"), states, reads.STATE), timeouts, reads.TIMEOUTS)
    return held.withColumn("upload_enabled", F.col("upload_state") == "enabled")


def hotkey_values(spark: SparkSession, d: str) -> DataFrame:
    """Scores and weights of users, from clicks and purchases; small values delete."""
    log = _table(spark, d, "events").select(F.when(F.col("event_type") == "click", "score").when(F.col("event_type") == "purchase", "wta_weight").otherwise("other").alias("namespace"), F.col("user_id").alias("hotkey"), F.when(F.col("value") >= 3, F.col("value")).alias("value"), F.col("event_id").alias("seq"))
    return reads.hotkey_values(_table(spark, d, "customer").select(F.col("c_custkey").alias("hotkey")), log)


def code_store(spark: SparkSession, d: str) -> DataFrame:
    o = _table(spark, d, "orders").select(F.col("o_custkey").alias("hotkey"), (F.col("o_orderkey") % 4).alias("epoch"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).otherwise("").alias("package"))
    asked = _table(spark, d, "customer").select(F.col("c_custkey").alias("hotkey"), F.lit(2).cast("long").alias("epoch"))
    return reads.has_submitted(asked, reads.stored_code(o).where("stored"))


def submission_deletions(spark: SparkSession, d: str) -> DataFrame:
    return reads.deletions(_table(spark, d, "supplier").select(F.col("s_suppkey").alias("hotkey"), F.lit(CURRENT).alias("epoch"))).withColumn("value", F.coalesce("value", F.lit("(none)")))


def direct_scores(spark: SparkSession, d: str) -> DataFrame:
    bodies = _scores(spark, d).select(F.when(F.col("ord") % 11 != 0, F.col("hotkey")).alias("hotkey"), F.when(F.col("ord") % 2 == 0, F.col("hash")).alias("agent_hash"), F.when(F.col("ord") % 5 != 0, F.round("score", 6)).alias("score"))
    records = _scores(spark, d).where("ord % 3 = 0").select("hotkey", F.lit(CURRENT).alias("epoch"), F.concat(F.lit("r"), "hash").alias("hash"))
    return reads.direct_scores(bodies, records, CURRENT)


def status_views(spark: SparkSession, d: str) -> DataFrame:
    """Replies about suppliers: finished ones have a score and a miner, those of small balance are under way, those of nation 0 say nothing."""
    # the quotient's own bits are rounded, as in the SQL; F.round by itself takes the shortest decimal that stands for them
    k, share = F.col("s_suppkey"), F.round(F.col("s_acctbal") / 10000 * 10000) / 10000
    done = F.format_string('{"submission_id":"%s","miner_hotkey":"n%d","status":"done","score":%s,"submitted_at":"t%d","evaluation_time_ms":%d}', "s_name", "s_nationkey", share.cast("string"), k, k * 3)
    under_way = F.format_string('{"status":"run","progress":{"total_tasks":%d,"completed_tasks":%d,"pending_tasks":%d,"percentage":%s}}', k + 1, k % 4, k + 1 - k % 4, F.round(F.col("s_nationkey") * 1.5, 1).cast("string"))
    body = F.when(F.col("s_nationkey") == 0, "{}").when(F.col("s_acctbal") >= 3000, done).otherwise(under_way)
    return reads.status_view(_table(spark, d, "supplier").select(k.cast("string").alias("id"), body.alias("body")))


def reviewer_scores(spark: SparkSession, d: str) -> DataFrame:
    """Replies whose overall score is the price of a part over 980 and whose criteria come from its size and name; promotions lack the summary, standard parts aren't JSON."""
    size, overall = F.col("p_size"), F.round(F.col("p_retailprice") / 980, 4)
    criteria = F.format_string('{"diversity_thematic":%s,"diversity_structural":0.5,"uniqueness":%s,"quality_semantic":%s}', F.round(size / 48, 4).cast("string"), F.round(size / 50, 4).cast("string"), F.round(F.length("p_name") / 20, 4).cast("string"))
    full = F.format_string('{"overall":%s,"criteria":%s,"reasoning":"%s"%s}', overall.cast("string"), criteria, F.col("p_name"), F.when(F.col("p_type") == "PROMO", "").otherwise(',"summary":"s"'))
    out = runner.parse_scores(_table(spark, d, "part").select("p_partkey", F.when(F.col("p_type") == "STANDARD", F.col("p_name")).otherwise(full).alias("reply")))
    mean = scalars.criteria_mean(*(F.col(f"score.criteria.{c}") for c in ("diversity_thematic", "diversity_structural", "uniqueness", "quality_semantic")))
    return out.select("p_partkey", "score.overall", F.round(mean, 6).alias("mean"), "score_error")


def reviewer_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Replies with a verdict somewhere in the text: confidence is the size of a part over 45, the reasoning its name, none for small parts; large ones say nothing."""
    say = F.format_string('Well: {"is_plagiarism":%s,"confidence":%s,"reasoning":"%s"} so.', (F.col("p_retailprice") >= 950).cast("string"), F.round(F.col("p_size") / 45, 4).cast("string"), F.when(F.col("p_type") == "SMALL", "").otherwise(F.col("p_name")))
    out = runner.verdicts(_table(spark, d, "part").select("p_partkey", F.when(F.col("p_type") == "LARGE", F.col("p_name")).otherwise(say).alias("reply")))
    good = F.col("verdict_error").isNull()
    return out.select("p_partkey", F.when(good, F.col("verdict.is_plagiarism")).alias("is_plagiarism"), F.when(good, F.col("verdict.confidence")).alias("confidence"), "verdict_error")


def similarity_labels(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("p_partkey") % 101
    return _table(spark, d, "part").select("p_partkey", scalars.fraction(s).alias("share"), scalars.percent(s).alias("shown"), scalars.status(s).alias("status"), scalars.threshold_verdict(s / 100.0)["is_plagiarism"].alias("is_plagiarism"))


def error_labels(spark: SparkSession, d: str) -> DataFrame:
    """How runs end whose time, memory and output are an order's: the first limit that one breaks, as a kind of error and its label; finished orders within the limits have none."""
    price, key = F.col("o_totalprice"), F.col("o_custkey")
    broken = state.limits_problem(price / 40, price * 9_000, F.length("o_orderpriority") - 5, key * 200_000)
    kinds = {"cpu": "Timeout", "memory": "MemoryExceeded", "processes": "ProcessSpawn", "file_size": "IoError"}
    kind = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in kinds.items() for x in pair)), broken), F.when(F.col("o_orderstatus") == "O", "InvalidOutput").when(F.col("o_orderstatus") == "P", F.col("o_orderpriority")))
    return _table(spark, d, "orders").select("o_orderkey", kind.alias("kind"), scalars.error_label(kind).alias("label"))


def fallback_hashes(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d).select("hotkey", scalars.submission_id(F.col("hotkey"), F.col("ord")).alias("id"), scalars.fallback_hash(F.col("hotkey"), F.col("ord")).alias("hash"))


def dataset_scores(spark: SparkSession, d: str) -> DataFrame:
    o = _table(spark, d, "orders").withColumn("score", F.col("o_totalprice") / 400000)
    mean = F.avg("score")
    return o.groupBy("o_orderpriority").agg(F.round(mean, 6).alias("dataset_score"), F.round(evaluation.mean_or(0.0, F.col("score")), 6).alias("clamped"))


def cache_alive(spark: SparkSession, d: str) -> DataFrame:
    e = _table(spark, d, "events").select("event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return ttl_cache.alive(e, "at", 1_706_000_000e6, 86_400e6 * 7).groupBy("event_type").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        jsonl_lines, output_validation, dataset_mode, line_search, conversation_hashes, request_messages, submission_checks, config_checks, codes_at, submissions_list, submission_by_hash, submission_by_hotkey, agent_info, agent_logs, status_row,
        challenge_params, settings_history, hotkey_values, code_store, submission_deletions, direct_scores, status_views, reviewer_scores, reviewer_verdicts, similarity_labels, error_labels, fallback_hashes, dataset_scores, cache_alive,
    )
}

_STATE = f"""s AS (SELECT md5(c_custkey::VARCHAR) AS hash, c_name AS hotkey, least(greatest(c_acctbal / 10000, 0), 1)::DOUBLE AS score, c_custkey AS ord FROM customer),
e AS (SELECT hotkey, ord, count(*) AS epoch FROM s JOIN orders ON o_custkey = ord GROUP BY hotkey, ord),
t AS (SELECT hotkey, {CURRENT}::BIGINT AS epoch, 'evaluating' AS status FROM s WHERE ord % 3 = 0 UNION ALL SELECT hotkey, epoch, 'done' FROM e WHERE ord % 4 = 1 AND epoch <> {CURRENT})"""
_ONE = f"""WITH {_STATE} SELECT hash, s.hotkey, round(score, 6) AS score, coalesce(e.epoch, 0)::BIGINT AS epoch, coalesce(t.status, 'scored') AS status
FROM s LEFT JOIN e USING (hotkey) LEFT JOIN t ON t.hotkey = s.hotkey AND t.epoch = coalesce(e.epoch, 0) WHERE """

# lines of outputs with their number, blank lines counted, and what is wrong with them
_OUTPUTS = """c AS (SELECT conv_id, conv_id // 5 AS ord, count(*) AS n, length(min_by(coalesce(text, ''), turn)) AS size, list(role ORDER BY turn) AS roles FROM conversations GROUP BY conv_id),
o AS (SELECT ord, n, coalesce(sum(1 + (size % 2 = 0)::INT) OVER (PARTITION BY ord ORDER BY conv_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + 1 AS line, size % 7 = 0 OR n < 2 AS bad, size % 5 = 0 AS swapped,
  list_reduce(list_prepend('u', roles), lambda st, r: CASE WHEN st = 'u' AND r = 'user' THEN 'a' WHEN st = 'u' AND r = 'system' THEN 'u' WHEN st = 'a' AND r IN ('assistant', 'function') THEN 'u' ELSE 'x' END) <> 'x' AS alternate FROM c)"""

ORACLE_SQL: dict[str, str] = {
    "jsonl_lines": """WITH c AS (SELECT conv_id AS line, count(*) AS n FROM conversations GROUP BY conv_id)
SELECT line, CASE WHEN line % 6 = 0 AND n >= 2 THEN n END AS n_messages, CASE line % 6 WHEN 0 THEN CASE WHEN n < 2 THEN 'InvalidFormat' END WHEN 2 THEN 'MissingField' WHEN 3 THEN 'InvalidFormat' ELSE 'InvalidJson' END AS kind FROM c WHERE line % 6 <> 4""",
    "output_validation": f"""WITH {_OUTPUTS} SELECT ord, CASE WHEN min(line) FILTER (WHERE bad) IS NULL THEN count(*) ELSE 0 END AS n_conversations, CASE WHEN bool_or(bad) THEN 'invalid_output' END AS kind, min(line) FILTER (WHERE bad) AS line FROM o GROUP BY ord""",
    "dataset_mode": f"""WITH {_OUTPUTS} SELECT ord, line, n AS n_messages FROM o WHERE ord NOT IN (SELECT ord FROM o WHERE bad OR swapped OR NOT alternate)""",
    "line_search": r"""WITH l AS (SELECT doc_id::VARCHAR AS path, unnest(string_split(text, chr(10))) AS text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM documents)
SELECT path, line::BIGINT AS line, md5(path || ':' || line || ':' || regexp_replace(text, '\r$', '')) AS shown FROM l WHERE regexp_matches(text, '(?i)licen[sc]e')""",
    "conversation_hashes": """SELECT conv_id, sha256('{"messages":[' || string_agg('{"role":' || to_json(role)::VARCHAR || ',"content":' || to_json(coalesce(text, ''))::VARCHAR || '}', ',' ORDER BY turn) || ']}') AS hash FROM conversations GROUP BY conv_id""",
    "request_messages": "SELECT event_id, 'challenge:c:POST:/submit:' || sha256(replace(props, ' ', '')) || ':' || event_id AS message FROM events",
    "submission_checks": """WITH r AS (SELECT c_custkey, c_custkey % 7 = 0 AS h, c_custkey % 5 = 0 AS c, c_custkey % 3 = 0 OR c_custkey % 20 = 0 AS p, c_custkey % 3 <> 0 AND length(c_mktsegment) * (c_custkey % 20) > 100 AS b FROM customer)
SELECT c_custkey, concat_ws(',', CASE WHEN h THEN 'hotkey is empty' END, CASE WHEN p THEN 'package is empty' END, CASE WHEN b THEN 'package is too large' END) AS errors, CASE WHEN c THEN 'code hash is missing' ELSE '' END AS warnings, NOT (h OR c OR p) AS is_complete FROM r""",
    "config_checks": """WITH r AS (SELECT o_orderkey, o_custkey % 60 AS n, o_orderkey % 9000 AS t, o_orderkey * 10000::BIGINT AS z, o_totalprice / 250000 - 0.2::DOUBLE AS s FROM orders)
SELECT o_orderkey, CASE WHEN n < 10 OR n > 50 THEN 'conversation_count' WHEN t > 7200 THEN 'timeout' WHEN z > 104857600 THEN 'size' END AS config,
CASE WHEN o_orderkey % 8000 > 7200 THEN 'cpu' WHEN o_orderkey * 1000000::BIGINT > 4000000000 THEN 'memory' WHEN o_orderkey % 5 < 1 THEN 'processes' WHEN o_orderkey * 50000::BIGINT > 200000000 THEN 'file_size' END AS limits,
CASE WHEN s < 0 THEN 'below_min' WHEN s > 1 THEN 'above_max' END AS score, CASE WHEN o_orderkey % 3 = 0 THEN 'forbidden' WHEN o_orderkey % 2 = 0 THEN 'queued' ELSE 'accepted' END AS gate FROM r""",
    "codes_at": """WITH c AS (SELECT o_custkey AS hotkey, o_orderkey % 10 AS epoch, max(o_orderkey) AS code FROM orders GROUP BY ALL)
SELECT c_custkey AS hotkey, c_custkey % 10 AS epoch, coalesce((SELECT code FROM c WHERE hotkey = c_custkey AND epoch = c_custkey % 10), (SELECT code FROM c WHERE hotkey = c_custkey AND epoch = greatest(c_custkey % 10 - 1, 0))) AS code FROM customer""",
    "submissions_list": f"""WITH {_STATE} SELECT hash, s.hotkey, round(score, 6) AS score, coalesce(e.epoch, {CURRENT})::BIGINT AS epoch, coalesce(t.status, 'pending') AS status FROM s LEFT JOIN e USING (hotkey) LEFT JOIN t ON t.hotkey = s.hotkey AND t.epoch = {CURRENT}""",
    "submission_by_hash": f"{_ONE} hash = md5('5')",
    "submission_by_hotkey": f"{_ONE} s.hotkey = 'Customer#000000012'",
    "agent_info": f"""WITH {_STATE}, a AS (SELECT hotkey FROM s UNION ALL SELECT 'nobody')
SELECT a.hotkey, coalesce(e.epoch, {CURRENT})::BIGINT AS epoch, round(score, 6) AS score, t.status, CASE WHEN s.ord % 2 = 0 THEN hash END AS code_hash FROM a LEFT JOIN s USING (hotkey) LEFT JOIN e ON e.hotkey = a.hotkey LEFT JOIN t ON t.hotkey = a.hotkey AND t.epoch = {CURRENT}""",
    "agent_logs": f"WITH {_STATE} SELECT hotkey, {CURRENT}::INT AS epoch, CASE WHEN ord % 3 = 1 THEN 'began,' || hash ELSE '' END AS logs FROM s",
    "status_row": f"SELECT {CURRENT}::INT AS epoch, true AS evaluation_enabled, 'pending' AS upload_state, false AS upload_enabled, count(*) AS total_submissions, 7::INT AS active_miners, 3::INT AS validator_count FROM customer",
    "challenge_params": """SELECT 'stored' AS which, min(s_nationkey)::BIGINT AS min_conversations, max(s_nationkey)::BIGINT AS max_conversations, floor(sum(s_acctbal))::BIGINT AS max_size_bytes, max(s_name) AS model, (SELECT md5(min(text)) FROM conversations) AS id, (SELECT max(role) FROM conversations) AS name,
  (SELECT count(DISTINCT conv_id) FROM conversations) AS conversation_count, (SELECT count(*) FROM conversations) AS total_messages, (SELECT sum(strlen(text))::BIGINT FROM conversations) AS size_bytes, (SELECT max(turn) FROM conversations) AS created_at, true AS is_active FROM supplier
UNION ALL SELECT 'default', 10, 50, 104857600, NULL, '', '', 0, 0, 0, 0, false""",
    "settings_history": """WITH s AS (SELECT event_id AS since, value < 120 AS evaluation_enabled, CASE WHEN value < 80 THEN 'disabled' WHEN value < 100 THEN 'pending' ELSE 'enabled' END AS upload_state, 'u' || user_id AS sudo_owner FROM events WHERE event_type = 'error' AND value >= 60),
t AS (SELECT event_id AS since, floor(value * 10)::BIGINT AS blocks, user_id FROM events WHERE event_type = 'purchase' AND value >= 100)
SELECT event_id AS seq, coalesce(evaluation_enabled, true) AS evaluation_enabled, coalesce(upload_state, 'enabled') AS upload_state, coalesce(sudo_owner, '') AS sudo_owner, coalesce(upload_state, 'enabled') = 'enabled' AS upload_enabled,
  coalesce(blocks, 3600) AS llm_review_timeout_blocks, coalesce(blocks * 2, 1800) AS ast_review_timeout_blocks, coalesce(t.user_id, 7200) AS basilica_timeout_blocks FROM events e ASOF LEFT JOIN s ON e.event_id >= s.since ASOF LEFT JOIN t ON e.event_id >= t.since""",
    "hotkey_values": """WITH e AS (SELECT *, CASE WHEN value >= 3 THEN value END AS kept FROM events),
l AS (SELECT user_id, event_type, arg_max_null(kept, event_id) AS value FROM e GROUP BY user_id, event_type)
SELECT c_custkey AS hotkey, max(value) FILTER (WHERE event_type = 'click') AS score, max(value) FILTER (WHERE event_type = 'purchase') AS wta_weight FROM customer LEFT JOIN l ON user_id = c_custkey GROUP BY c_custkey""",
    "code_store": "SELECT c_custkey AS hotkey, 2::BIGINT AS epoch, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderkey % 4 = 2 AND o_orderstatus = 'F') AS submitted FROM customer",
    "submission_deletions": f"SELECT unnest(['agent_code', 'submission_data', 'agent_hash', 'eval_status']) AS namespace, s_suppkey AS hotkey, {CURRENT}::INT AS epoch, '(none)' AS value FROM supplier",
    "direct_scores": f"""WITH {_STATE} SELECT CASE WHEN ord % 2 = 0 THEN hash ELSE 'r' || hash END AS hash, hotkey, round(score, 6) AS score, {CURRENT}::INT AS epoch, 'scored' AS status FROM s WHERE ord % 11 <> 0 AND ord % 5 <> 0 AND (ord % 2 = 0 OR ord % 3 = 0)""",
    "status_views": """WITH r AS (SELECT *, s_nationkey = 0 AS nothing, s_nationkey <> 0 AND s_acctbal >= 3000 AS done, s_nationkey <> 0 AND s_acctbal < 3000 AS run FROM supplier)
SELECT CASE WHEN done THEN s_name ELSE s_suppkey::VARCHAR END AS submission_id, CASE WHEN done THEN 'n' || s_nationkey ELSE '-' END AS hotkey, CASE WHEN nothing THEN '-' WHEN done THEN 'done' ELSE 'run' END AS status, CASE WHEN run THEN s_suppkey + 1 END::BIGINT AS total, CASE WHEN run THEN s_suppkey % 4 END::BIGINT AS completed,
  CASE WHEN run THEN s_suppkey + 1 - s_suppkey % 4 END::BIGINT AS pending, CASE WHEN run THEN printf('%.1f%%', s_nationkey * 1.5::DOUBLE) END AS progress, CASE WHEN done THEN printf('%.4f', round(s_acctbal / 10000, 4)) END AS score, CASE WHEN done THEN 't' || s_suppkey END AS submitted, CASE WHEN done THEN s_suppkey * 3 END::BIGINT AS evaluation_ms FROM r""",
    "reviewer_scores": """WITH r AS (SELECT p_partkey, p_type, round(p_retailprice / 980, 4) AS overall, round(p_size / 48::DOUBLE, 4) AS a, round(p_size / 50::DOUBLE, 4) AS b, round(length(p_name) / 20::DOUBLE, 4) AS c FROM part),
e AS (SELECT *, CASE WHEN p_type IN ('PROMO', 'STANDARD') THEN 'no_json' WHEN a > 1 OR b > 1 OR c > 1 THEN 'criteria' WHEN overall > 1 THEN 'overall' END AS score_error FROM r)
SELECT p_partkey, CASE WHEN score_error IS NULL THEN overall END AS overall, CASE WHEN score_error IS NULL THEN round((a + 0.5::DOUBLE + b + c) / 4, 6) END AS mean, score_error FROM e""",
    "reviewer_verdicts": """WITH r AS (SELECT p_partkey, p_retailprice >= 950 AS p, round(p_size / 45::DOUBLE, 4) AS c, CASE WHEN p_type = 'LARGE' THEN 'no_json' WHEN p_size > 45 THEN 'confidence' WHEN p_type = 'SMALL' THEN 'reasoning' END AS verdict_error FROM part)
SELECT p_partkey, CASE WHEN verdict_error IS NULL THEN p END AS is_plagiarism, CASE WHEN verdict_error IS NULL THEN c END AS confidence, verdict_error FROM r""",
    "similarity_labels": "SELECT p_partkey, p_partkey % 101 / 100.0::DOUBLE AS share, (p_partkey % 101)::VARCHAR || '%' AS shown, CASE WHEN p_partkey % 101 >= 97 THEN 'plagiarized' WHEN p_partkey % 101 >= 30 THEN 'needs_verification' ELSE 'clean' END AS status, p_partkey % 101 >= 97 AS is_plagiarism FROM part",
    "error_labels": """WITH k AS (SELECT o_orderkey, CASE WHEN o_totalprice / 40 > 7200 THEN 'Timeout' WHEN o_totalprice * 9000 > 4000000000 THEN 'MemoryExceeded' WHEN length(o_orderpriority) < 6 THEN 'ProcessSpawn' WHEN o_custkey * 200000 > 200000000 THEN 'IoError'
  WHEN o_orderstatus = 'O' THEN 'InvalidOutput' WHEN o_orderstatus = 'P' THEN o_orderpriority END AS kind FROM orders)
SELECT *, CASE kind WHEN 'Timeout' THEN 'timeout' WHEN 'MemoryExceeded' THEN 'memory_exceeded' WHEN 'ProcessSpawn' THEN 'process_spawn' WHEN 'IoError' THEN 'io_error' WHEN 'InvalidOutput' THEN 'invalid_output' END AS label FROM k""",
    "fallback_hashes": "SELECT c_name AS hotkey, c_name || ':' || c_custkey AS id, list_aggregate(list_transform(range(1, length(c_name || ':' || c_custkey) + 1), lambda i: printf('%02x', (ord(substr(c_name || ':' || c_custkey, i::INT, 1)) + i - 1) % 256)), 'string_agg', '') AS hash FROM customer",
    "dataset_scores": "SELECT o_orderpriority, round(avg(o_totalprice / 400000), 6) AS dataset_score, round(least(greatest(avg(o_totalprice / 400000), 0), 1), 6) AS clamped FROM orders GROUP BY o_orderpriority",
    "cache_alive": "SELECT event_type, count(*) AS n FROM events WHERE epoch_us(ts) + 604800000000 > 1706000000000000 GROUP BY event_type",
}
