"""One query for each operator, over its whole table, and the SQL that says the same where SQL can."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, centroids, chat, hmm, imatch, licenses, mixing, packing, repair, simhash, token_files, toxicity, vectors, word_pieces


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)


def op3_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    words = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return chat.read(chat.tree(rows.union(more), *words), *words)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_files.write(_documents(spark, sf_dir), word_pieces.maker(public_tokenizers.path("word_bpe_49k.json")), end_id=1)
    return token_files.read(files)


def op5_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(_documents(spark, sf_dir))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_documents(spark, sf_dir))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op8_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprints(_documents(spark, sf_dir))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    out = mixing.mix(docs.select("doc_id", "source", mixing.words("text").alias("size"), F.xxhash64("text").alias("tie")), tie="tie")
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_documents(spark, sf_dir))


def op11_exponion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.digest(repair.repair(repair.damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.read(packing.pack(_documents(spark, sf_dir), word_pieces.maker(public_tokenizers.path("word_bpe_49k.json")), end_id=2))


OP3_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, regexp_replace(regexp_replace(replace(role, '\', '\\'), '<(/?s>)', '<\\\1', 'g'), '\[(/?INST\])', '[\\\1', 'g') AS er,
         regexp_replace(regexp_replace(replace(text, '\', '\\'), '<(/?s>)', '<\\\1', 'g'), '\[(/?INST\])', '[\\\1', 'g') AS et
  FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length('<s>[INST]' || er || '[/INST]' || et || '</s>'))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


def _canonical(text: str) -> str:
    """A known text's canonical form by plain string methods, beside the operator's column functions."""
    low = text.lower().replace("\r\n", "\n").replace("\r", "\n")
    paragraphs: list[list[str]] = [[]]
    for line in low.split("\n"):
        if any(c.isalnum() for c in line):
            paragraphs[-1].append(" ".join(line.split()))
        elif paragraphs[-1]:
            paragraphs.append([])

    def noticed(words: list[str]) -> bool:
        """The paragraph or line begins with a mark of copyright and a year or second mark."""
        if words and words[0] in ("copyright", "copyright:"):
            words = words[1:]
        elif not words or not words[0].startswith(("(c)", "©")):
            return False
        elif words[0] in ("(c)", "©"):
            words = words[1:]
            return bool(words) and (words[0].startswith("copyright") or dated(words[0]))
        return bool(words) and (words[0].startswith(("(c)", "©")) or dated(words[0]))

    def dated(word: str) -> bool:
        return word[:4].isdigit() and len(word) >= 4 or word[1:5] in ("yyyy", "year") and word[0] in "[<{("

    kept = []
    for lines in paragraphs:
        words = " ".join(lines).split()
        if noticed(words) and len(words) <= 60:
            continue
        for _ in range(2):
            if len(lines) > 1 and noticed(lines[0].split()) and len(lines[0].split()) <= 24:
                lines = lines[1:]  # noqa: PLW2901
        kept.append(" ".join(lines))
    out = " ".join(kept)
    for a, b in licenses.EQUIVALENT:
        out = out.replace(a, b)
    return " ".join("".join(c if c.isalnum() else " " for c in out).split())


def _canonical_sql(text: str) -> str:
    start = r"(^|\x1e)[^\p{L}\p{N}©(\x1e]*(copyright:?[ \x1f]?(©|\(c\))|copyright:?[ \x1f]([0-9]{4}|[\[<{(](yyyy|year)[\]>})])|(©|\(c\))[ \x1f]?(copyright|[0-9]{4}|[\[<{(](yyyy|year)[\]>})]))[^ \x1e\x1f]*"
    out = rf"regexp_replace(regexp_replace(lower({text}), '\r\n?', chr(10), 'g'), '[ \t\x0b\f\x{{a0}}]+', ' ', 'g')"
    out = rf"replace(regexp_replace({out}, '\n[^\p{{L}}\p{{N}}\n]*\n[^\p{{L}}\p{{N}}©(]*', chr(30) || chr(30), 'g'), chr(10), chr(31))"
    out = rf"regexp_replace({out}, '{start}([ \x1f]+[^ \x1e\x1f]+){{0,60}}[ \x1f]*(\x1e|$)', '\1\8', 'g')"
    for _ in range(2):
        out = rf"regexp_replace({out}, '{start}( +[^ \x1e\x1f]+){{0,24}} *\x1f', '\1', 'g')"
    out = f"translate({out}, chr(30) || chr(31), '  ')"
    for a, b in licenses.EQUIVALENT:
        out = f"replace({out}, '{a}', '{b}')"
    return rf"trim(regexp_replace({out}, '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


def _known_sql(lists: dict[str, tuple[str, ...]]) -> str:
    found: dict[str, str] = {}
    for name, texts in lists.items():
        for text in texts:
            digest = hashlib.sha256(_canonical(text).encode()).hexdigest()
            found[digest] = min(name, found.get(digest, name))
    return ", ".join(f"('{digest}', '{name}')" for digest, name in found.items())


OP10_SQL = f"""
WITH short(digest, license) AS (VALUES {_known_sql(licenses.KNOWN)}),
long(digest, license) AS (VALUES {_known_sql(licenses.whole_texts())}),
known AS (SELECT * FROM short UNION ALL SELECT * FROM long WHERE digest NOT IN (SELECT digest FROM short)),
d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT row, unnest(string_split(text, chr(10))) AS line FROM d),
h AS (SELECT row, string_agg(DISTINCT license, ',' ORDER BY license) AS names, count(*) AS n FROM l JOIN short ON sha256({_canonical_sql("line")}) = digest GROUP BY row)
SELECT doc_id, known.license AS text_license, coalesce(names, '') AS line_licenses, coalesce(n, 0)::BIGINT AS n_license_lines
FROM d LEFT JOIN known ON sha256({_canonical_sql("d.text")}) = digest LEFT JOIN h USING (row)
"""

OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT AS hash
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w
  FROM d GROUP BY source),
o AS (
  SELECT *, 2.0::DOUBLE * source_size / w AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS budget,
         coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
         sum(w) OVER (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS remaining,
         row_number() OVER (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST) AS place
  FROM s),
r AS (SELECT arg_min((budget - capped) / remaining, place) FILTER (WHERE cap >= (budget - capped) / remaining) AS rate FROM o),
t AS (SELECT source, source_size, least(2.0::DOUBLE * source_size, w * rate) AS target FROM o, r),
q AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN source_size > 0 AND sum(size) OVER (PARTITION BY d.source ORDER BY hash) <= target - whole * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
"""


def _op11_sql(k: int = 8, rounds: int = 10) -> str:
    """Plain rounds, one table of centroids (c) and one of the vectors' places (a) each; distances in long form."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT row, min_by(k, d * {k} + k) AS k, min(d) AS d
  FROM (SELECT row, k, sum((x - y) * (x - y))::BIGINT AS d FROM x JOIN c{r} USING (i) GROUP BY row, k) GROUP BY row)""")
        if r < rounds:
            steps.append(f"""c{r + 1} AS MATERIALIZED (SELECT k, i, coalesce((t - (t % n + n) % n) // n, y) AS y FROM c{r}
  LEFT JOIN (SELECT k, i, sum(x)::BIGINT AS t, count(*) AS n FROM x JOIN a{r} USING (row) GROUP BY k, i) USING (k, i))""")
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, embedding FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64),
x AS MATERIALIZED (SELECT row, i, floor(1024 * embedding[i]::DOUBLE)::BIGINT AS x FROM v, range(1, 65) t(i)),
c0 AS MATERIALIZED (SELECT k, i, x AS y FROM (SELECT row, row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS k FROM v WHERE vec_id IS NOT NULL) JOIN x USING (row) WHERE k < {k}),
{", ".join(steps)},
h AS (SELECT k, sha256(string_agg(y::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY k)
SELECT vec_id, k::INT AS cluster, d AS distance, sum(d) OVER (PARTITION BY k)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, centroid_sha256
FROM v JOIN a{rounds} USING (row) JOIN h USING (k)
"""


OP11_SQL = _op11_sql()


def _op12_sql() -> str:
    """Costs-to-go with the least audit and the turns that it leaves, for the four states, from the last row back."""
    way = lambda cost, edit, after, line="": f"struct_pack(c := {after}.c + {cost}, a := '{edit}' || {after}.a, t := " + (f"list_prepend({line}, {after}.t))" if line else f"{after}.t)")
    least = lambda *ways: "list_sort([" + ", ".join(ways) + "], 'ASC', 'NULLS LAST')[1]"
    kept = lambda initial, to: f"CASE WHEN fault <> 'bad' AND role[1] = '{initial}' THEN {way('more', 'K', f'v[{to}]', line='said')} END"
    reroled = lambda name, to: "CASE WHEN fault <> 'bad' THEN " + way("2 + more", "R", f"v[{to}]", line=f"'{name}:' || text") + " END"
    user, assistant = (kept("u", 3), reroled("user", 3)), (kept("a", 4), reroled("assistant", 4))
    bases = [least(way(3, "D", "v[1]"), kept("s", 2), *user), least(way(3, "D", "v[2]"), *user), least(way(3, "D", "v[3]"), *assistant), least(way(3, "D", "v[4]"), *user)]
    to_user, to_assistant = (lambda x: way(2, "I", x, line="'user:'")), (lambda x: way(2, "I", x, line="'assistant:'"))
    crc = "list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, strlen(id) + 1), lambda i: ascii(id[i])::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, j: xor(x >> 1, 3988292384 * (x & 1))))"
    space = r"\x20\x09-\x0D"
    return rf"""
WITH RECURSIVE o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS id, dense_rank() OVER (ORDER BY conv_id) AS g FROM conversations),
k AS (SELECT *, xor({crc}, 4294967295) % 20 AS kind FROM o),
d AS (SELECT g, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM k JOIN (VALUES (1), (2)) c(copy) ON kind <> 0 AND (copy = 1 OR kind = 3)),
n AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^{space}]') THEN 'blank' WHEN row_number() OVER (PARTITION BY g, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][{space}]*$') THEN 'truncated' ELSE '' END AS first FROM n),
r AS MATERIALIZED (SELECT g, i, role, text, role || ':' || text AS said, CASE WHEN first IN ('blank', 'duplicate') THEN 'bad' ELSE '' END AS fault, (first = 'truncated')::INT AS more FROM f),
w AS (
  SELECT g, max(i) + 1 AS i, [struct_pack(c := 0, a := '', t := []::VARCHAR[]), struct_pack(c := 4, a := 'II', t := ['user:', 'assistant:']), struct_pack(c := 2, a := 'I', t := ['assistant:']), struct_pack(c := 0, a := '', t := []::VARCHAR[])] AS v FROM r GROUP BY g
  UNION ALL
  SELECT g, i, [{least("b[1]", to_user("u"))}, {least("b[2]", to_user("u"))}, u, a] AS v
  FROM (SELECT g, i, b, {least("b[3]", to_assistant("b[4]"))} AS u, {least("b[4]", to_user("b[3]"))} AS a
    FROM (SELECT w.g, r.i, [{", ".join(bases)}] AS b FROM w JOIN r ON r.g = w.g AND r.i = w.i - 1))),
s AS (SELECT g, (max(turn) - min(turn) + 1 - count(DISTINCT turn))::BIGINT AS gaps, count(*) FILTER (WHERE first = 'blank') AS blank, count(*) FILTER (WHERE first = 'duplicate') AS duplicate, count(*) FILTER (WHERE first = 'truncated') AS truncated FROM f GROUP BY g),
j AS (SELECT g, count(*) FILTER (WHERE NOT p IN ('su', 'ua', 'au')) AS illegal FROM (SELECT g, lag(role[1]) OVER (PARTITION BY g ORDER BY i) || role[1] AS p FROM n) GROUP BY g)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(v[1].c, 0)::BIGINT AS cost, coalesce(v[1].a, '') AS audit,
  sha256(coalesce(array_to_string(v[1].t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, g FROM o) LEFT JOIN s USING (g) LEFT JOIN j USING (g) LEFT JOIN (SELECT * FROM w WHERE i = 1) USING (g)
"""


OP12_SQL = _op12_sql()

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_near_dedup": op1_embedding_near_dedup,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_chat_tree": op3_chat_tree,
    "op4_token_files": op4_token_files,
    "op5_hmm": op5_hmm,
    "op6_simhash": op6_simhash,
    "op7_toxicity": op7_toxicity,
    "op8_imatch": op8_imatch,
    "op9_source_mix": op9_source_mix,
    "op10_licenses": op10_licenses,
    "op11_exponion": op11_exponion,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_packing": op13_packing,
}
ORACLE_SQL: dict[str, str] = {"op3_chat_tree": OP3_SQL, "op9_source_mix": OP9_SQL, "op10_licenses": OP10_SQL, "op11_exponion": OP11_SQL, "op12_conversation_repair": OP12_SQL}
