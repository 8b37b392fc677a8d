"""Scalar functions on columns. Lengths are UTF-8 bytes throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column) -> Column:
    """x held within 0 and 1; NaN and null stay."""
    return F.when(F.isnan(x), x).otherwise(F.when(x < 0, F.lit(0.0)).when(x > 1, F.lit(1.0)).otherwise(x))


def rounded(x: Column, places: int = 6) -> Column:
    """x of at least 0 to so many places, halves up, by the double's product as in DuckDB: Spark's round() makes a decimal of every row, which costs more than a pair itself. The product must fit a long."""
    by = F.lit(10.0**places)
    # the double below 0.5: what is just below a half isn't lifted by the sum
    return F.floor(x * by + F.lit(0.49999999999999994)) / by


def to_weight(score: Column, most: Column) -> Column:
    return F.when(most <= 0, F.lit(0.0)).otherwise(clamp(score / most))


def decay(score: Column, blocks: Column, half_life: Column) -> Column:
    """score halved every half_life blocks; unchanged where either number is 0."""
    return F.when((blocks == 0) | (half_life == 0), clamp(score)).otherwise(clamp(score * F.pow(F.lit(0.5), blocks / F.when(half_life != 0, half_life))))


def weighted_score(format_score: Column, quality: Column, originality: Column) -> Column:
    return F.lit(0.2) * clamp(format_score) + F.lit(0.4) * clamp(quality) + F.lit(0.4) * clamp(originality)


def criteria_mean(*criteria: Column) -> Column:
    """Four criteria, a quarter each, not clamped."""
    return sum((c * 0.25 for c in criteria[1:]), criteria[0] * 0.25)


def score_error(x: Column) -> Column:
    """Why x is no score: not_a_number, below_min, above_max; null if it is one."""
    return F.when(F.isnan(x), "not_a_number").when(x < 0, "below_min").when(x > 1, "above_max")


#: Similarities of 0 to 100 from which on a pair is plagiarized, or to be verified.
PLAGIARIZED, TO_VERIFY = 97, 30


def status(score: Column) -> Column:
    """Bucket of a similarity of 0 to 100."""
    return F.when(score >= PLAGIARIZED, "plagiarized").when(score >= TO_VERIFY, "needs_verification").otherwise("clean")


def words(text: Column) -> Column:
    """Runs of other characters than Unicode white space, in order, repeats included."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def outer_json(text: Column) -> Column:
    """From the first { to the last }; null if there is none."""
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(found != "", found)


def truncate(text: Column, most: int) -> Column:
    """Texts of more than `most` bytes cut to so many, with ... behind them; a character that doesn't fit whole is dropped."""
    cut = F.regexp_replace(F.make_valid_utf8(F.substring(F.encode(text, "UTF-8"), 1, most).cast("string")), "\ufffd+$", "")
    return F.when(F.octet_length(text) > most, F.concat(cut, F.lit("..."))).otherwise(text)


def submission_id(hotkey: Column, epoch: Column) -> Column:
    return F.concat_ws(":", hotkey, epoch.cast("string"))


def fallback_hash(hotkey: Column, epoch: Column) -> Column:
    """Hex of the bytes of hotkey:epoch, each plus its place, modulo 256."""
    raw = F.hex(F.encode(submission_id(hotkey, epoch), "UTF-8"))
    places = F.sequence(F.lit(0), (F.length(raw) / 2).cast("int") - 1)
    return F.lower(F.array_join(F.transform(places, lambda i: F.lpad(F.hex((F.conv(F.substring(raw, i * 2 + 1, F.lit(2)), 16, 10).cast("long") + i) % 256), 2, "0")), ""))


# fixed values: labels of run errors by their kind
ERROR_LABELS = {
    "ProcessSpawn": "process_spawn", "Timeout": "timeout", "MemoryExceeded": "memory_exceeded", "InvalidOutput": "invalid_output", "SandboxViolation": "sandbox_violation", "SecurityViolation": "security_violation",
    "SecurityValidation": "security_validation", "IoError": "io_error",
}


def error_label(kind: Column) -> Column:
    """The label of a kind of run error; null for another text."""
    table = F.create_map(*(F.lit(x) for pair in ERROR_LABELS.items() for x in pair))
    return F.try_element_at(table, kind)


def fraction(score: Column) -> Column:
    """A similarity of 0 to 100 as a number of 0 to 1."""
    return score / 100.0


def percent(score: Column) -> Column:
    return F.concat(score.cast("string"), F.lit("%"))


def threshold_verdict(similarity: Column) -> Column:
    """The verdict without a reviewer: plagiarism from 0.97 on."""
    return F.struct((similarity >= 0.97).alias("is_plagiarism"), similarity.alias("confidence"))


def compact_json(value: Column) -> Column:
    """A struct as JSON without spaces and nulls, fields as declared, control characters in lower-case hex."""
    out = F.to_json(value)
    for code in ("0B", "0E", "0F", "1A", "1B", "1C", "1D", "1E", "1F"):
        # an even number of backslashes in front: the escape isn't escaped itself
        out = F.regexp_replace(out, rf"(?<!\\)((?:\\\\)*)\\u00{code}", rf"$1\\u00{code.lower()}")
    return out


def conversation_hash(messages: Column, function_calls: Column | None = None, thinking: Column | None = None) -> Column:
    """SHA-256 of a conversation's compact JSON."""
    parts = [messages.alias("messages"), *([function_calls.alias("function_calls")] if function_calls is not None else []), *([thinking.alias("thinking")] if thinking is not None else [])]
    return F.sha2(compact_json(F.struct(*parts)), 256)


def request_message(challenge: Column, canonical_body: Column, nonce: Column) -> Column:
    """What a submission request signs."""
    return F.concat(F.lit("challenge:"), challenge, F.lit(":POST:/submit:"), F.sha2(canonical_body, 256), F.lit(":"), nonce)


def free(columns: list[str], name: str) -> str:
    """name, or a longer one that none of columns has in any spelling."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
