"""Named queries of state, streams, workflows, scripts and reviews over the driver's tables, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrymill.functions import scalars
from quarrymill.operators import reads, reviews, script_table, workflow
from quarrymill.sources import conversations, jsonl_format, shared
from quarrymill.sources.consensus_table import ConsensusTable
from quarrymill.sources.rank_table import RankTable
from quarrymill.sources.state_table import StateTable
from quarrymill.streaming import cache_stream

from . import records

#: The streamed replay delays events by up to this, and waits as long for them.
LATE_S = 7200


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def ttl_cache_stream(spark: SparkSession, d: str) -> DataFrame:
    """The log as four files, each event in that of its time plus a delay by its id; a last file moves the watermark past all."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    e = _table(spark, d, "events").select("event_id", "user_id", (at / 1e6).alias("at"), (F.col("event_type") == "purchase").alias("is_insert"))
    low, high = e.agg(F.min("at"), F.max("at")).first()
    folder = shared.fresh(spark, "cache")
    if low is not None:
        come = F.col("at") + F.pmod(F.xxhash64("event_id"), F.lit(LATE_S - 1))
        file = F.least(F.lit(3), F.floor((come - low) / ((high - low) / 4 + 1)).cast("int"))
        for i in range(4):
            e.where(file == i).write.mode("append").parquet(f"{folder}/in")
        spark.createDataFrame([(None, None, high + 10 * LATE_S, True)], e.schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    else:
        e.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(e.schema).parquet(f"{folder}/in")
    # a trigger takes the files of one write, or some of them: the files' times come in order of the writes
    out = cache_stream.hits(stream, "user_id", "at", "event_id", "is_insert", 86_400.0, float(LATE_S))
    return cache_stream.replay(spark, out, f"{folder}/out", f"{folder}/check").select("event_id", "hit")


def compacted_state(spark: SparkSession, d: str) -> DataFrame:
    """latest_state by way of batches: two are folded, one is sent twice, one more is folded, the rest is the tail."""
    log = _table(spark, d, "events").select("user_id", "event_type", "event_id", F.when(F.col("value") >= 20, F.col("value")).alias("value"))
    table = StateTable(spark, shared.fresh(spark, "state"), "user_id long, event_type string, value double, event_id long", ["user_id", "event_type"], "value", "event_id")
    n = log.agg(F.max("event_id")).first()[0] or 0
    for i in range(5):
        part = log.where(F.col("event_id").between(n * i // 5 + (i > 0), n * (i + 1) // 5))
        table.append(part, i)
        if i in (1, 3):
            table.append(part, i)
            table.compact()
            table.vacuum()
    return table.read().select("user_id", "event_type", "value", "ord")


def ranks_by_batches(spark: SparkSession, d: str) -> DataFrame:
    """Ranks of the last values of users' event types, kept by five batches in order of event_id, one of them sent twice."""
    log = _table(spark, d, "events").select("user_id", "event_type", "event_id", F.when(F.col("value") >= 20, F.col("value")).alias("value"))
    # ranges of a 16th of the keys, so that there are some at any size
    most = max(1, log.select("user_id", "event_type").distinct().count() // 16)
    board = RankTable(spark, shared.fresh(spark, "ranks"), "user_id long, event_type string, value double, event_id long", ["user_id", "event_type"], "value", "event_id", most)
    n = log.agg(F.max("event_id")).first()[0] or 0
    for i in range(5):
        part = log.where(F.col("event_id").between(n * i // 5 + (i > 0), n * (i + 1) // 5))
        board.append(part, i)
        if i == 2:
            board.append(part, i)
            board.vacuum()
    return board.ranks()


def consensus_by_batches(spark: SparkSession, d: str) -> DataFrame:
    """consensus_by_group by way of batches: three are added up, one is sent twice, the rest is the tail."""
    log = _table(spark, d, "events").select("user_id", "event_id", (F.col("value") / 500).alias("score"))
    kept = ConsensusTable(spark, shared.fresh(spark, "consensus"), "user_id long, score double, event_id long", "user_id", "score", "event_id")
    n = log.agg(F.max("event_id")).first()[0] or 0
    for i in range(4):
        part = log.where(F.col("event_id").between(n * i // 4 + (i > 0), n * (i + 1) // 4))
        kept.append(part, i)
        if i == 2:
            kept.append(part, i)
            kept.compact()
    out = kept.read()
    return out.select("user_id", F.round("final_score", 6).alias("final_score"), F.round("agreement", 6).alias("agreement"), "n_scores", F.array_join("outliers", ",").alias("outliers"))


def _submissions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Events as what happens to submissions, and the strongest errors as changes of the upload gate. An epoch is 100 events."""
    e = _table(spark, d, "events")
    kind = F.when(F.col("event_type").isin("signup", "view"), "submit").when(F.col("event_type") == "click", "evaluate").when(F.col("event_type") == "purchase", "score").otherwise("fail")
    own = F.md5(F.concat_ws(":", "user_id", F.expr("event_id div 100")))
    # a score may name a hash; a submission without one isn't valid
    named = F.when((F.col("event_type") == "purchase") & (F.col("value") < 40), F.lit(None)).when(F.col("value") < 3, "").otherwise(own)
    events = e.select("event_id", F.col("user_id").alias("key"), F.expr("event_id div 100").alias("epoch"), F.col("event_id").alias("ord"), kind.alias("kind"), (F.col("value") >= 5).alias("valid"), named.alias("hash"), F.round(F.col("value") / 500, 6).alias("score"))
    gates = e.where("event_type = 'error' AND value >= 60").select(F.col("event_id").alias("ord"), F.element_at(F.array(*map(F.lit, ("enabled", "disabled", "pending", "enabled"))), (F.col("event_id") % 4 + 1).cast("int")).alias("gate"))
    return events, gates


def workflow_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return workflow.outcomes(*_submissions(spark, d)).select("event_id", "gate", "outcome", "target")


def workflow_states(spark: SparkSession, d: str) -> DataFrame:
    return workflow.states(workflow.outcomes(*_submissions(spark, d)))


def workflow_scores(spark: SparkSession, d: str) -> DataFrame:
    return workflow.scores(workflow.outcomes(*_submissions(spark, d)))


def script_rows(spark: SparkSession, d: str) -> DataFrame:
    """One script for every 20 conversations, which prints them as JSON lines; where a conversation is long its script ends with code 3, and where its first text has a question mark it prints what is no conversation."""
    talk = conversations.table(spark, d).select("conv_id", "messages", F.hex(F.encode(F.to_json(F.struct("messages")), "UTF-8")).alias("raw"))
    asks = F.col("messages")[0]["content"].startswith("W")
    line = F.concat(F.lit("print(bytes.fromhex('"), "raw", F.lit("').decode()"), F.when(asks, " + '?'").otherwise(""), F.lit(")"))
    lines = talk.groupBy(F.expr("conv_id div 20").alias("ord")).agg(F.array_sort(F.collect_list(F.struct("conv_id", line.alias("line")))).alias("lines"), F.max(F.size("messages")).alias("longest"))
    source = F.concat(F.array_join(F.col("lines.line"), "\n"), F.when(F.col("longest") >= 8, "\nraise SystemExit(3)").otherwise(""))
    script_table.register(spark, allow=True)
    name = f"scripts_{shared.fresh(spark, 's').rpartition('-')[2]}"
    lines.select("ord", source.alias("source")).createOrReplaceTempView(name)
    out = spark.sql(f"SELECT s.ord, r.line, r.messages, r.error, r.exit_code FROM {name} s, LATERAL run_script(s.source, 60) r")
    # written: the scripts run once, however often the rows are read
    done = shared.written(out, "script_rows")
    spark.catalog.dropTempView(name)
    return done.select("ord", "line", F.size("messages").cast("long").alias("n_messages"), F.md5(F.array_join(F.col("messages.content"), "\n")).alias("texts"), "error.kind", F.col("error.line").alias("bad_line"), "exit_code")


def plagiarism_reviews(spark: SparkSession, d: str) -> DataFrame:
    """Each part's name against its type, by an offline reviewer; its similarity is that of the key, and keys of sevens have one that no verdict may have."""
    p = _table(spark, d, "part")
    pairs = p.select("p_partkey", F.col("p_name").alias("code_a"), F.col("p_type").alias("code_b"), ((F.length("p_name") * 7 + F.length("p_type")) % 111 / 100).alias("similarity"))
    out = reviews.review(pairs, lambda: reviews.judge(0.5), "p_partkey", policy=reviews.Policy(first_delay_s=0.0))
    return out.select("p_partkey", "verdict.is_plagiarism", F.round("verdict.confidence", 6).alias("confidence"), "verdict.reasoning", "audit.recommendation", F.round("audit.structural_match", 6).alias("structural_match"), "error.kind", "calls")


def jsonl_source(spark: SparkSession, d: str) -> DataFrame:
    """All conversations as one file of lines, each text a line of its own, read in parts of 100,000 bytes: every third is cut short, and every seventh has a blank line before it."""
    talk = conversations.table(spark, d).select("conv_id", scalars.compact_json(F.struct("messages")).alias("json"))
    cut = F.when(F.col("conv_id") % 3 == 1, F.expr("left(json, length(json) - 2)")).otherwise(F.col("json"))
    line = F.concat(F.when(F.col("conv_id") % 7 == 0, "\n").otherwise(""), cut)
    folder = shared.fresh(spark, "lines")
    # a file for each range of conversations, in order of their names
    talk.select("conv_id", line.alias("value")).repartitionByRange(4, "conv_id").sortWithinPartitions("conv_id").select("value").write.text(folder)
    out = jsonl_format.read(spark, folder, splitBytes=100_000)
    rows = out.select(F.substring_index("path", "/", -1).alias("file"), "line", F.size("messages").cast("long").alias("n_messages"), F.md5(F.array_join("messages.content", "\n")).alias("texts"), "error.kind")
    # files hold unknown numbers of lines, so lines are shown by what comes before them in all files
    sizes = rows.groupBy("file").agg(F.max("line").alias("n"))
    earlier = F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(sizes.select("file", earlier.alias("earlier")), "file").select((F.col("earlier") + F.col("line")).alias("line"), "n_messages", "texts", "kind")


def agent_info_in_buckets(spark: SparkSession, d: str) -> DataFrame:
    """agent_info over state tables that are kept in buckets by hotkey."""
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    scores, epochs, statuses, hashes = (shared.bucketed(f(spark, d), name, "hotkey", buckets) for name, f in (("scores", records._scores), ("epochs", records._epochs), ("statuses", records._statuses), ("hashes", records._hashes)))
    asked = scores.select("hotkey").union(spark.sql("SELECT 'nobody'"))
    return reads.agents(asked, scores, epochs, statuses, hashes, records.CURRENT).withColumn("score", F.round("score", 6))


QUERIES = {f.__name__: f for f in (jsonl_source, agent_info_in_buckets, ttl_cache_stream, compacted_state, ranks_by_batches, consensus_by_batches, workflow_outcomes, workflow_states, workflow_scores, script_rows, plagiarism_reviews)}

# the gates and events, and each submission's events gone through one after another
_FLOW = """RECURSIVE e AS (SELECT event_id, user_id AS key, event_id // 100 AS epoch, CASE WHEN event_type IN ('signup', 'view') THEN 'submit' WHEN event_type = 'click' THEN 'evaluate' WHEN event_type = 'purchase' THEN 'score' ELSE 'fail' END AS kind,
  value >= 5 AS valid, CASE WHEN event_type = 'purchase' AND value < 40 THEN NULL WHEN value < 3 THEN '' ELSE md5(user_id || ':' || event_id // 100) END AS hash, round(value / 500, 6) AS score FROM events),
g AS (SELECT event_id AS since, ['enabled', 'disabled', 'pending', 'enabled'][event_id % 4 + 1] AS gate FROM events WHERE event_type = 'error' AND value >= 60),
n AS MATERIALIZED (SELECT e.*, coalesce(gate, 'enabled') AS gate, row_number() OVER (PARTITION BY key, epoch ORDER BY event_id) AS i FROM e ASOF LEFT JOIN g ON event_id >= since),
w AS (
  SELECT key, epoch, 0::BIGINT AS i, ''::VARCHAR AS known, NULL::VARCHAR AS state, NULL::DOUBLE AS last, 0::BIGINT AS submissions, 0::BIGINT AS rejected, NULL::BIGINT AS event_id, NULL::VARCHAR AS gate, NULL::VARCHAR AS outcome, NULL::VARCHAR AS target FROM n WHERE i = 1
  UNION ALL
  SELECT key, epoch, i, CASE WHEN outcome = 'accepted' THEN hash ELSE known END, coalesce(CASE outcome WHEN 'accepted' THEN 'pending' WHEN 'queued' THEN 'queued' WHEN 'evaluating' THEN 'evaluating' WHEN 'scored' THEN 'scored' WHEN 'failed' THEN 'failed' END, state),
    CASE WHEN outcome = 'scored' THEN score ELSE last END, submissions + (kind = 'submit')::INT, rejected + (outcome IN ('forbidden', 'invalid', 'duplicate'))::INT, event_id, gate, outcome, CASE WHEN outcome = 'scored' THEN t END
  FROM (SELECT w.key, w.epoch, n.i, n.event_id, n.gate, kind, hash, score, known, state, last, submissions, rejected, coalesce(nullif(hash, ''), nullif(known, '')) AS t,
    CASE kind WHEN 'submit' THEN CASE WHEN n.gate = 'disabled' THEN 'forbidden' WHEN n.gate = 'pending' THEN 'queued' WHEN NOT valid OR coalesce(hash, '') = '' THEN 'invalid' WHEN known <> '' THEN 'duplicate' ELSE 'accepted' END
      WHEN 'evaluate' THEN 'evaluating' WHEN 'fail' THEN 'failed' ELSE CASE WHEN coalesce(nullif(hash, ''), nullif(known, '')) IS NULL THEN 'ignored' ELSE 'scored' END END AS outcome
    FROM w JOIN n ON n.key = w.key AND n.epoch = w.epoch AND n.i = w.i + 1))"""

ORACLE_SQL: dict[str, str] = {
    "agent_info_in_buckets": records.ORACLE_SQL["agent_info"],
    "jsonl_source": """WITH c AS (SELECT conv_id, count(*) AS n, md5(string_agg(coalesce(text, ''), chr(10) ORDER BY turn)) AS texts, CASE WHEN conv_id % 3 = 1 THEN 'InvalidJson' WHEN count(*) < 2 THEN 'InvalidFormat' END AS kind FROM conversations GROUP BY conv_id)
SELECT sum(1 + (conv_id % 7 = 0)::INT) OVER (ORDER BY conv_id)::BIGINT AS line, CASE WHEN kind IS NULL THEN n END AS n_messages, CASE WHEN kind IS NULL THEN texts END AS texts, kind FROM c""",
    "ttl_cache_stream": """WITH e AS (SELECT event_id, user_id, event_type, epoch_us(ts) / 1e6::DOUBLE AS t FROM events),
w AS (SELECT *, last_value(CASE WHEN event_type = 'purchase' THEN t END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ins FROM e)
SELECT event_id, coalesce(t - ins < 86400, false) AS hit FROM w WHERE event_type <> 'purchase'""",
    "compacted_state": """WITH e AS (SELECT *, max(CASE WHEN value < 20 THEN event_id END) OVER (PARTITION BY user_id, event_type) AS gone FROM events)
SELECT user_id, event_type, max_by(value, event_id) AS value, min(event_id) AS ord FROM e WHERE gone IS NULL OR event_id > gone GROUP BY user_id, event_type""",
    "ranks_by_batches": """WITH e AS (SELECT *, max(CASE WHEN value < 20 THEN event_id END) OVER (PARTITION BY user_id, event_type) AS gone FROM events),
l AS (SELECT user_id, event_type, max_by(value, event_id) AS value, min(event_id) AS ord FROM e WHERE gone IS NULL OR event_id > gone GROUP BY user_id, event_type)
SELECT *, row_number() OVER (ORDER BY value DESC, ord) AS rank FROM l""",
    "consensus_by_batches": """WITH m AS (SELECT user_id, value / 500 AS s, avg(value / 500) OVER (PARTITION BY user_id) AS mean, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS place FROM events)
SELECT user_id, round(coalesce(avg(s) FILTER (WHERE abs(s - mean) <= 0.2::DOUBLE), any_value(mean)), 6) AS final_score, round(1 - least(max(abs(s - mean)) / 0.2::DOUBLE, 1), 6) AS agreement, count(*) AS n_scores,
coalesce(string_agg(place, ',' ORDER BY place) FILTER (WHERE abs(s - mean) > 0.2::DOUBLE), '') AS outliers FROM m GROUP BY user_id""",
    "workflow_outcomes": f"WITH {_FLOW} SELECT event_id, gate, outcome, target FROM w WHERE i > 0",
    "workflow_states": f"""WITH {_FLOW} SELECT key, epoch, max_by(state, i) AS state, nullif(max_by(known, i), '') AS hash, max_by(last, i) AS score, max(submissions) AS submissions, max(rejected) AS rejected FROM w GROUP BY key, epoch HAVING max_by(state, i) IS NOT NULL""",
    "workflow_scores": f"WITH {_FLOW} SELECT target AS hash, max_by(key, event_id) AS key, max_by(last, event_id) AS score, min(event_id) AS ord FROM w WHERE outcome = 'scored' GROUP BY target",
    "script_rows": """WITH c AS (SELECT conv_id, conv_id // 20 AS ord, count(*) AS n, md5(string_agg(coalesce(text, ''), chr(10) ORDER BY turn)) AS texts, starts_with(min_by(coalesce(text, ''), turn), 'W') AS odd FROM conversations GROUP BY conv_id),
l AS (SELECT *, row_number() OVER (PARTITION BY ord ORDER BY conv_id) AS line, CASE WHEN odd THEN 'InvalidJson' WHEN n < 2 THEN 'InvalidFormat' END AS bad, CASE WHEN max(n) OVER (PARTITION BY ord) >= 8 THEN 3 ELSE 0 END AS exit_code FROM c),
b AS (SELECT ord, min(line) FILTER (WHERE bad IS NOT NULL) AS bad_line, any_value(exit_code) AS exit_code FROM l GROUP BY ord)
SELECT ord, line, n AS n_messages, texts, NULL AS kind, NULL::BIGINT AS bad_line, exit_code::INT AS exit_code FROM l WHERE ord IN (SELECT ord FROM b WHERE bad_line IS NULL)
UNION ALL SELECT ord, NULL, NULL, NULL, 'invalid_output', bad_line, exit_code FROM b WHERE bad_line IS NOT NULL""",
    "plagiarism_reviews": """WITH p AS (SELECT p_partkey, (length(p_name) * 7 + length(p_type)) % 111 AS s FROM part)
SELECT p_partkey, CASE WHEN s <= 100 THEN s >= 50 END AS is_plagiarism, CASE WHEN s <= 100 THEN round(s / 100, 6) END AS confidence, CASE WHEN s <= 100 THEN CASE WHEN s >= 50 THEN 'structure' ELSE 'differs' END END AS reasoning,
CASE WHEN s <= 100 THEN CASE WHEN s >= 50 THEN 'CONFIRM_PLAGIARISM' ELSE 'CLEAR' END END AS recommendation, CASE WHEN s <= 100 THEN round(s / 100, 6) END AS structural_match, CASE WHEN s > 100 THEN 'invalid_response' END AS kind, CASE WHEN s <= 100 THEN 2 ELSE 1 END::INT AS calls FROM p""",
}
