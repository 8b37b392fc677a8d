"""Running generator scripts as table functions. Nothing runs unless `allow` is set; limits hold in the child alone."""

from __future__ import annotations

import contextlib
import os
import resource
import signal
import subprocess
import sys
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.functions.scalars import outer_json, score_error
from quarrymill.sources.shared import written

from .programs import violations

MOST_OUTPUT, MOST_SECONDS, MOST_PROCESSES, MOST_FILE = 10 << 20, 7200, 4, 200_000_000
#: Tasks beyond those of the user at the start; the name of a script's mark.
BURST, MARK = 512, "QUARRYMILL_RUN"


def _processes(mark: bytes) -> list[int]:
    """Processes of this user that carry the mark in their environment: a script's own and all that it has started, in whatever group or session."""
    out = []
    for name in os.listdir("/proc"):
        if name.isdigit():
            with contextlib.suppress(OSError), open(f"/proc/{name}/environ", "rb") as file:  # gone by now, or another user's
                if mark in file.read():
                    out.append(int(name))
    return out


def _user_tasks() -> int:
    """Processes and threads that this user has now: what RLIMIT_NPROC counts."""
    n = 0
    for name in os.listdir("/proc"):
        if name.isdigit():
            with contextlib.suppress(OSError):
                if os.stat(f"/proc/{name}").st_uid == os.getuid():
                    n += len(os.listdir(f"/proc/{name}/task"))
    return n


def _end(mark: bytes, child: subprocess.Popen) -> None:
    """Kills the script and what it has started, until nothing is left."""
    with contextlib.suppress(ProcessLookupError):
        os.killpg(child.pid, signal.SIGKILL)
    while left := [p for p in _processes(mark) if p != child.pid]:
        for pid in left:
            with contextlib.suppress(OSError):
                os.kill(pid, signal.SIGKILL)
        time.sleep(0.01)
    child.wait()


def run_script(source: str, timeout_s: float = 3600, memory: int = 2_147_483_648, processes: int = MOST_PROCESSES) -> dict:
    """stdout, stderr, exit_code (null if killed), duration_ms, timed_out, error. Another exit code than 0 is no error; critical calls, output over 10 MiB and more processes than allowed are.

    Limits hold for the script alone: its processes are told by a mark in their environment and counted while it runs (threads aren't counted), and all of them end with it. The user's own limit
    on tasks is set above what the user has at the start, as a bound between two counts: it is the same for every process of the user, so it can't be the limit itself.
    """
    if any(v["severity"] == "critical" for v in violations(source) or []):
        return {"stdout": "", "stderr": "", "exit_code": None, "duration_ms": 0, "timed_out": False, "error": "security_violation"}
    mark = f"{MARK}={uuid.uuid4().hex}"
    room = _user_tasks() + BURST

    def limit() -> None:
        for what, most in ((resource.RLIMIT_CPU, MOST_SECONDS), (resource.RLIMIT_AS, memory), (resource.RLIMIT_FSIZE, MOST_FILE), (resource.RLIMIT_NPROC, room)):
            hard = resource.getrlimit(what)[1]
            most = most if hard == resource.RLIM_INFINITY else min(most, hard)
            resource.setrlimit(what, (most, most))

    began = time.monotonic()
    with tempfile.TemporaryDirectory(ignore_cleanup_errors=True) as folder:
        with open(os.path.join(folder, "harness.py"), "w", encoding="utf-8") as file:
            file.write(source)
        with open(os.path.join(folder, "out"), "w+b") as out, open(os.path.join(folder, "err"), "w+b") as err:
            env = {"PATH": os.environ.get("PATH", ""), MARK: mark.partition("=")[2]}
            child = subprocess.Popen([sys.executable, "harness.py"], cwd=folder, stdin=subprocess.DEVNULL, stdout=out, stderr=err, preexec_fn=limit, env=env, start_new_session=True)
            code, error, last, pause = None, None, began + min(timeout_s, MOST_SECONDS), 0.02
            try:
                while error is None and code is None:
                    try:
                        code = child.wait(max(0.0, min(pause, last - time.monotonic())))
                    except subprocess.TimeoutExpired:
                        late, pause = time.monotonic() >= last, min(0.1, pause * 2)
                        error = "timeout" if late else "process_limit" if len(_processes(mark.encode())) > processes else None
            finally:
                _end(mark.encode(), child)
            if error is None and os.fstat(out.fileno()).st_size > MOST_OUTPUT:
                error = "invalid_output"
            texts = []
            for file in (out, err):
                file.seek(0)
                texts.append(file.read(MOST_OUTPUT).decode(errors="replace"))
    return {"stdout": texts[0], "stderr": texts[1], "exit_code": code if code is None or code >= 0 else None, "duration_ms": int((time.monotonic() - began) * 1000), "timed_out": error == "timeout", "error": error}


def run_scripts(scripts: DataFrame, key: str = "ord", source: str = "source", timeout_s: float = 3600, allow: bool = False) -> DataFrame:
    """One row for each script. allow says that the scripts may run on the executors; without it this raises."""
    if not allow:
        raise PermissionError("scripts run only with allow=True")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [{"key": k} | run_script(s, timeout_s) for k, s in zip(batch["key"], batch["source"], strict=True)]
            yield pd.DataFrame(rows, columns=["key", "stdout", "stderr", "exit_code", "duration_ms", "timed_out", "error"]).astype({"exit_code": "Int32"})

    kind = scripts.schema[key].dataType.simpleString()
    return scripts.select(F.col(key).alias("key"), F.col(source).alias("source")).mapInPandas(run, f"key {kind}, stdout string, stderr string, exit_code int, duration_ms bigint, timed_out boolean, error string")


def run_batch(scripts: DataFrame, key: str = "ord", source: str = "source", timeout_s: float = 3600, allow: bool = False) -> dict[str, DataFrame]:
    """results and problems of each script, conversations (rows of outputs that are good throughout), first_failure (the script by key at which a strict run ends, no row if none), report and scores of all pairs."""
    from quarrymill.sources.conversations import output_problems, output_rows

    from .programs import report, similarities

    # written once: a lost executor mustn't run foreign scripts again and give other rows to one of the frames
    results = written(run_scripts(scripts, key, source, timeout_s, allow).withColumnRenamed("key", key), "results")
    return {
        "results": results, "problems": output_problems(results, key), "conversations": output_rows(results, key), "first_failure": results.where("error IS NOT NULL").agg(F.min(F.struct(key, "error")).alias("x")).where("x IS NOT NULL").select("x.*"),
        "report": report(scripts, key, source), "scores": similarities(scripts, key, source),
    }


def fixed_scorer(value: float) -> Callable[[str], dict]:
    """Scores every text alike; 1.0 and 0.0 give the perfect and the zero scorer."""
    return lambda text: {"overall": value, "diversity_thematic": value, "diversity_structural": value, "uniqueness": value, "quality_semantic": value, "error": None}


def with_retries(call: Callable[[str], dict], attempts: int = 3, first_delay_s: float = 1.0, again: type[Exception] = TimeoutError) -> Callable[[str], dict]:
    """call, tried up to `attempts` times in all with doubled delays while it raises `again`."""

    def tried(text: str) -> dict:
        for i in range(attempts):
            try:
                return call(text)
            except again as e:
                last = e
                if i + 1 < attempts:
                    time.sleep(first_delay_s * 2**i)
        return dict.fromkeys(("overall", "diversity_thematic", "diversity_structural", "uniqueness", "quality_semantic")) | {"error": str(last)}

    return tried


def score_texts(texts: DataFrame, scorer: Callable[[str], dict], key: str, text: str) -> DataFrame:
    """Criteria and overall score by an injected scorer, one call for each row; failures are in error."""
    names = ("overall", "diversity_thematic", "diversity_structural", "uniqueness", "quality_semantic", "error")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([{"key": k} | scorer(t) for k, t in zip(batch["key"], batch["text"], strict=True)], columns=["key", *names])

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(run, f"key {kind}, " + ", ".join(f"{n} {'string' if n == 'error' else 'double'}" for n in names))


SCORE = "struct<overall:double,criteria:struct<diversity_thematic:double,diversity_structural:double,uniqueness:double,quality_semantic:double>,reasoning:string,summary:string>"


def parse_scores(replies: DataFrame, text: str = "reply") -> DataFrame:
    """Replies with score and score_error: no_json (also for a missing field), criteria or overall out of 0 to 1, in this order. The overall score is taken as it is given."""
    rows = replies.withColumn("score", F.from_json(F.col(text), SCORE, {"mode": "PERMISSIVE"}))
    criteria = [F.col(f"score.criteria.{c}") for c in ("diversity_thematic", "diversity_structural", "uniqueness", "quality_semantic")]
    fields, bad = [F.col("score.overall"), *criteria, F.col("score.reasoning"), F.col("score.summary")], F.lit(False)
    for c in criteria:
        bad = bad | score_error(c).isNotNull()
    missing = F.lit(False)
    for c in fields:
        missing = missing | c.isNull()
    problem = F.when(missing, "no_json").when(bad, "criteria").when(score_error(F.col("score.overall")).isNotNull(), "overall")
    return rows.withColumn("score_error", problem).withColumn("score", F.when(F.col("score_error").isNull(), F.col("score")))


VERDICT = "struct<is_plagiarism:boolean,confidence:double,reasoning:string>"


def verdicts(replies: DataFrame, text: str = "reply") -> DataFrame:
    """Replies with verdict and verdict_error: no_json, confidence or reasoning out of range."""
    found = F.from_json(outer_json(F.col(text)), VERDICT)
    rows = replies.withColumn("verdict", found)
    confidence = F.col("verdict.confidence")
    problem = F.when(F.col("verdict").isNull() | F.col("verdict.is_plagiarism").isNull() | confidence.isNull(), "no_json").when(~F.isnan(confidence) & ~confidence.between(0, 1), "confidence").when(F.coalesce(F.octet_length("verdict.reasoning"), F.lit(0)) == 0, "reasoning")
    return rows.withColumn("verdict_error", problem)
