import random
from collections import defaultdict

from pyspark.sql import functions as F

from quarrymill.operators import neighbours, workflow

SCHEMA = "key string, epoch int, ord long, kind string, valid boolean, hash string, score double, gate string, _part int, n int"


def walked(events, gates):
    """The machine by a loop: outcomes by ord, final states, scores."""
    known, state, last, submissions, rejected, scores, out = {}, {}, {}, defaultdict(int), defaultdict(int), {}, {}
    for key, epoch, ord_, kind, valid, hash_, score in sorted(events, key=lambda e: (e[2], e[5] or "")):
        at = [g for o, g in sorted(gates) if o <= ord_]
        gate, own, target = at[-1] if at else "enabled", (key, epoch), None
        if kind == "submit":
            submissions[own] += 1
            if gate == "disabled":
                outcome = "forbidden"
            elif gate == "pending":
                outcome = "queued"
            elif not valid or not hash_:
                outcome = "invalid"
            else:
                outcome = "duplicate" if own in known else "accepted"
                known.setdefault(own, hash_)
            rejected[own] += outcome in ("forbidden", "invalid", "duplicate")
        elif kind in ("evaluate", "fail"):
            outcome = {"evaluate": "evaluating", "fail": "failed"}[kind]
        else:
            target = (hash_ or known.get(own)) if kind == "score" and score is not None else None
            outcome = "scored" if target else "ignored"
        if target:
            scores[target] = (key, score, scores.get(target, (0, 0, ord_))[2])
            last[own] = score
        if outcome in workflow.STATES:
            state[own] = workflow.STATES[outcome]
        out[ord_] = (gate, outcome, target)
    return out, {(*own, s, known.get(own), last.get(own), submissions[own], rejected[own]) for own, s in state.items()}, {(h, *v) for h, v in scores.items()}


def test_workflow_equals_a_walk(spark):
    rng = random.Random(4)
    events = [
        (rng.choice(["a", "b", "c", None]), rng.choice([1, 2, None]), i * 3, rng.choice(["submit", "submit", "evaluate", "score", "fail", "other", None]), rng.choice([True, True, False, None]), rng.choice(["h1", "h2", "h3", "", None]), rng.choice([0.5, 0.25, None]))
        for i in range(400)
    ]
    gates = [(rng.randrange(1200), rng.choice(["enabled", "disabled", "pending"])) for _ in range(25)]
    gates = list({o: (o, g) for o, g in gates}.values())
    df = spark.createDataFrame([(*e, "own", 1, 2) for e in rng.sample(events, len(events))], SCHEMA).repartition(3)
    done = workflow.outcomes(df.drop("gate"), spark.createDataFrame(gates, "ord long, gate string"))
    want, states, scores = walked(events, gates)
    assert {r["ord"]: (r["gate"], r["outcome"], r["target"]) for r in done.collect()} == want
    assert {"_part", "n"} <= set(done.columns) and done.where("_part = 1 AND n = 2").count() == 400
    assert {tuple(r) for r in workflow.states(done).select("key", "epoch", "state", "hash", "score", "submissions", "rejected").collect()} == states
    assert {tuple(r) for r in workflow.scores(done).collect()} == scores
    assert workflow.states(workflow.outcomes(df.drop("gate").where("false"), spark.createDataFrame([], "ord long, gate string"))).collect() == []


def test_as_of_in_many_ranges(spark):
    rng = random.Random(5)
    rows = [(rng.choice([None, *range(0, 3000)]), i) for i in range(500)]
    marks = [(rng.choice([None, *range(0, 3000)]), f"m{i}") for i in range(12)] + [(100, None), (2000, "x"), (2000, "y")]
    df = spark.createDataFrame(rows, "t int, i int").withColumn("value", F.lit(1)).repartition(3)
    got = {r["i"]: r["seen"] for r in neighbours.as_of(df, spark.createDataFrame(marks, "t int, m string"), "t", "m", "seen").collect()}
    for t, i in rows:
        known = [(o, v) for o, v in marks if o is not None and t is not None and o <= t]
        last = max((o for o, _ in known), default=None)
        want = max((v for o, v in known if o == last and v is not None), default=None)
        assert got[i] == want, (t, got[i], want)
