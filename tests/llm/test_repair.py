import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from quarrymill.llm import repair

SPACE = r"[^\x20\x09-\x0D]"


def damage(rows):
    out = []
    for key, turn, role, text in rows:
        shown = [" " if x is None else str(x) for x in (key, turn)]
        kind = zlib.crc32(":".join(shown).encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
        out += [(key, turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def cheapest(rows):
    """(cost, audit, turns) by a search forward that keeps the least (cost, audit) of every state, over faults worked out by regexes."""
    best, seen = {"": (0, "", ())}, set()
    after = lambda state, c: state + c if re.fullmatch("s?(ua)*u?", state + c) else None
    cut = lambda state: state[-1] if len(state) > 1 else state

    def put(to, state, found):
        if state is not None and (state not in to or found < to[state]):
            to[state] = found

    def insert(best):
        for _ in range(3):
            for state, (cost, audit, turns) in list(best.items()):
                c = "a" if state == "u" else "u"
                put(best, c, (cost + 2, audit + "I", (*turns, f"{'user' if c == 'u' else 'assistant'}:")))

    counts = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
    for role, text in rows:
        insert(best)
        fault = "blank" if not re.search(SPACE, text) else "duplicate" if (role, text) in seen else "truncated" if not re.search(r"[.!?][\x20\x09-\x0D]*\Z", text) else None
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        new = {}
        for state, (cost, audit, turns) in best.items():
            put(new, state, (cost + 3, audit + "D", turns))
            if fault in ("blank", "duplicate"):
                continue
            more = fault == "truncated"
            for name in ("user", "assistant"):
                if (name[0] == "a") == (state == "u"):
                    put(new, name[0], (cost + 2 + more, audit + "R", (*turns, f"{name}:{text}")))
            first = role[:1]
            if first == "s" and state == "" or first == "u" and state != "u" or first == "a" and state == "u":
                put(new, first, (cost + more, audit + "K", (*turns, f"{role}:{text}")))
        best = new
    insert(best)
    return min(found for state, found in best.items() if state in ("", "a")), counts


def expected(rows, order):
    """By key, of rows already damaged."""
    out = {}
    for key in {r[0] for r in order}:
        own = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is not None, r[1] or 0))
        (cost, audit, turns), counts = cheapest([r[2:] for r in own])
        known = [r[1] for r in own if r[1] is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        initials = [r[2][:1] for r in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        out[key] = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(turns).encode()).hexdigest())
    return out


SCHEMA = "conv_id long, turn long, role string, text string, key string, part int, row int, hash long, whole boolean, copies int"


def frame(spark, rows):
    rng = random.Random(1)
    return spark.createDataFrame([(*r, "k", 1, 2, 3, True, 9) for r in rng.sample(rows, len(rows))], SCHEMA).repartition(3)


def rows_of(rng, n, size):
    texts = ["Yes.", "No!", "Why?", "cut off", "", " \t\n", "Yes. ", "long " * 30 + ".", "é é?", "\x85.", "...", " . x"]
    out = []
    for key in range(n):
        turn = rng.choice((0, 5))
        for _ in range(rng.randint(1, size)):
            turn += rng.choice((1, 1, 1, 1, 3))
            out.append((key, turn, rng.choice(("user", "assistant", "user", "assistant", "system", "function", "", "umpire")), rng.choice(texts) if rng.random() < 0.5 else f"text {rng.random()}."))
    return out


@pytest.mark.parametrize("most_rows", [3, 4096])
def test_op12(spark, most_rows):
    rng = random.Random(5)
    rows = rows_of(rng, 60, 12) + [(70 + i, t, r, "Fine. " + str(t)) for i in range(3) for t, r in enumerate(("user", "assistant") * 60)]
    rows += [(None, None, None, None), (None, 2, "user", "Null key."), (None, 3, None, None), (90, None, "system", "No turn."), (90, 4, "user", None), (91, 2**62, "user", "Far."), (91, -(2**62) + 5, "assistant", "Far off.")]
    rows += [(92, 1, "user", "word. " * 100_000), (92, 2, "assistant", "x" * 500_000)]
    got = repair.digest(repair.repair(repair.damaged(frame(spark, rows)), most_rows)).collect()
    assert len(got) == len({r["conv_id"] for r in got})
    assert {r["conv_id"]: tuple(r)[1:] for r in got} == expected(damage(rows), rows)


def test_op12_of_dropped_repeated_and_no_rows(spark):
    drop = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    kept = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 > 4)
    rows = [(drop, 0, "user", "Gone."), *[(kept, 0, "user", "Same.")] * 300, *[(kept, 0, "assistant", "Also.")] * 5]
    for most in (7, 4096):
        got = {r["conv_id"]: r for r in repair.digest(repair.repair(repair.damaged(frame(spark, rows)), most)).collect()}
        assert tuple(got[drop])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
        # rows of one turn come by role: assistants before users
        (cost, audit, turns), counts = cheapest([("assistant", "Also.")] * 5 + [("user", "Same.")] * 300)
        assert (got[kept]["cost"], got[kept]["audit"], got[kept]["duplicate"]) == (cost, audit, 303) and got[kept]["gaps"] == 0
        assert got[kept]["repaired_sha256"] == hashlib.sha256("\n".join(turns).encode()).hexdigest()
    assert repair.digest(repair.repair(repair.damaged(frame(spark, rows).where("false")))).collect() == []


def test_pieces_are_the_repaired_turns(spark):
    rng = random.Random(8)
    rows = rows_of(rng, 30, 30)
    pieces = repair.repair(repair.damaged(frame(spark, rows)), 5)
    got = {}
    for r in sorted(pieces.collect(), key=lambda r: (r["key"], r["part"], r["seq"])):
        got.setdefault(r["key"], []).extend(r["repaired"])
    assert pieces.where("NOT whole").count() > 30
    for key in {r[0] for r in rows}:
        roles = "".join(t["role"][:1] for t in got[key])
        assert re.fullmatch("(s?(ua)+)?", roles) and all(len(t["text"]) == 0 or re.search(SPACE, t["text"]) for t in got[key])
    assert pieces.select(F.sum("cost")).first()[0] == sum(x[5] for x in expected(damage(rows), rows).values())


def test_costs_and_walk_equal_all_edits():
    """Every list of edits of short conversations, tried out."""
    rng = random.Random(9)

    for _ in range(60):
        codes = [(rng.choice("suaf"), rng.randrange(3)) for _ in range(rng.randint(0, 4))]
        to_go = repair.costs(codes, repair.END)

        def search(i, state, spent):
            """(cost, audit) of every way on from row i, at most two insertions in a row and no dearer than the best."""
            if spent > to_go[0][0]:
                return
            if i == len(codes) and state in (0, 3):
                yield spent, ""
            if not search.inserted >= 2:
                search.inserted += 1
                yield from ((c, "I" + a) for c, a in search(i, repair._NEXT[state], spent + 2))
                search.inserted -= 1
            if i < len(codes):
                initial, fault = codes[i]
                more, kept = int(fault == repair.CUT), repair.step(initial, state)
                held, search.inserted = search.inserted, 0
                yield from ((c, "D" + a) for c, a in search(i + 1, state, spent + 3))
                if fault != repair.BAD:
                    yield from ((c, "R" + a) for c, a in search(i + 1, repair._NEXT[state], spent + 2 + more))
                    if kept is not None:
                        yield from ((c, "K" + a) for c, a in search(i + 1, kept, spent + more))
                search.inserted = held

        search.inserted = 0
        best = min(search(0, 0, 0))
        assert best == (to_go[0][0], "".join(e for e, *_ in repair.walk(codes, to_go, 0, True)))
