"""Generator scripts as a table function in SQL: each line of a script's output is a row."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from quarrymill.sources.conversations import CALL, MESSAGE, classify

from .runner import run_script

ROW = f"line bigint, messages array<{MESSAGE}>, function_calls array<{CALL}>, thinking string, error struct<kind:string,line:bigint,message:string>, exit_code int"


def _call(found: dict | None) -> tuple | None:
    return found and (found["name"], found["arguments"])


def _conversation(text: str) -> tuple:
    found = json.loads(text)
    messages = [(m["role"], m["content"], m.get("name"), _call(m.get("function_call"))) for m in found["messages"]]
    calls = found.get("function_calls")
    return messages, calls and [_call(c) for c in calls], found.get("thinking")


class ScriptRows:
    """run_script(source[, timeout_s]) in SQL: one row for each line that the script prints, if all are conversations; else one row that says what failed. Blank lines are no rows."""

    def eval(self, source: str | None, timeout_s: float | None = 3600.0) -> Iterator[tuple]:
        failed = lambda kind, line=None, message=None, code=None: (None, None, None, None, (kind, line, message), code)
        if source is None:
            yield failed("invalid_output", message="no script")
            return
        got = run_script(source, 3600.0 if timeout_s is None else float(timeout_s))
        if got["error"]:
            yield failed(got["error"], code=got["exit_code"])
            return
        lines = [(i, x.removesuffix("\r")) for i, x in enumerate(got["stdout"].split("\n"), 1) if x.strip()]
        if not lines:
            yield failed("invalid_output", message="Output is empty", code=got["exit_code"])
            return
        for i, x in lines:
            kind, message = classify(x)
            if kind:
                yield failed("invalid_output", i, message, got["exit_code"])
                return
        for i, x in lines:
            yield (i, *_conversation(x), None, got["exit_code"])


def register(spark: SparkSession, allow: bool = False, name: str = "run_script") -> None:
    """Makes the function known to the session's SQL, for `FROM scripts s, LATERAL run_script(s.source, 60)`. allow says that scripts may run on the executors; without it this raises.

    A script runs once for each row that reaches the function; where its rows are read more than once, write them first: a lost executor runs the scripts of its partitions again.
    """
    if not allow:
        raise PermissionError("scripts run only with allow=True")
    spark.udtf.register(name, udtf(ScriptRows, returnType=ROW))
