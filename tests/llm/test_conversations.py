"""The repair of conversations against plain versions, over many partitions and on odd rows."""

import hashlib
import random
import re
from itertools import product

import pytest
from pyspark.sql import functions as F

from lattiq.llm import conversations

GOOD = re.compile(r"(s?(ua)+)?")


def plain_faults(rows):
    seen, found = set(), []
    for _, role, text in rows:
        last = text.strip(" \t\n\v\f\r")[-1:]
        found.append("blank" if not last else "duplicate" if (role, text) in seen else "" if last in ".!?" else "truncated")
        seen.add((role, text))
    return found


def plain_audit(rows, faults):
    """The cheapest audit among all strings of up to three inserts."""
    best = None
    for size in range(len(rows), len(rows) + 4):
        for edits in product("DIKR", repeat=size):
            if size - edits.count("I") != len(rows):
                continue
            ways = [("", 0, 0)]
            for e in edits:
                step = []
                for roles, cost, at in ways:
                    more = 3 if e in "KR" and faults[at] == "truncated" else 0
                    if e == "I":
                        step += [(roles + c, cost + 3, at) for c in "ua"]
                    elif e == "D":
                        step.append((roles, cost + 4, at + 1))
                    elif faults[at] not in ("blank", "duplicate"):
                        step += [(roles + rows[at][1][:1], cost + more, at + 1)] if e == "K" else [(roles + c, cost + 3 + more, at + 1) for c in "ua"]
                ways = step
            for roles, cost, _ in ways:
                if GOOD.fullmatch(roles) and (best is None or (cost, "".join(edits)) < best):
                    best = cost, "".join(edits)
    return best


def plain_scan(rows, faults):
    """(cost, audit, text) turn by turn, from the least ways to each string state."""
    ways = {"": (0, "", [])}
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}

    def closed(ways):
        ways = dict(ways)
        for _ in range(4):
            for state, (cost, audit, lines) in list(ways.items()):
                for c in follow[state]:
                    if c != "s":
                        new = (cost + 3, audit + "I", [*lines, {"u": "user:", "a": "assistant:"}[c]])
                        if c not in ways or new[:2] < ways[c][:2]:
                            ways[c] = new
        return ways

    for (_, role, text), fault in zip(rows, faults):
        step = {}
        for state, (cost, audit, lines) in closed(ways).items():
            options = [(state, cost + 4, "D", lines)]
            more = 3 if fault == "truncated" else 0
            if fault not in ("blank", "duplicate"):
                options += [(c, cost + more, "K", [*lines, f"{role}:{text}"]) for c in follow[state] if role[:1] == c]
                options += [(c, cost + 3 + more, "R", [*lines, f"{ {'u': 'user', 'a': 'assistant'}[c] }:{text}"]) for c in follow[state] if c != "s"]
            for c, price, edit, made in options:
                new = (price, audit + edit, made)
                if c not in step or new[:2] < step[c][:2]:
                    step[c] = new
        ways = step
    cost, audit, lines = min((v for s, v in closed(ways).items() if s in ("", "a")), key=lambda v: v[:2])
    return cost, audit, "\n".join(lines)


def plain_repair(rows):
    """A row of the result for each conversation of (conv_id, turn, role, text)."""
    found = {}
    for conv in {r[0] for r in rows}:
        own = [(t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c == conv]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        faults = plain_faults(own)
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, text = plain_scan(own, faults)
        found[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return found


def random_rows(seed, convs, most):
    r = random.Random(seed)
    rows = []
    for conv in convs:
        for turn in range(r.randint(1, most)):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = r.choice(["Yes.", "no", f"t{turn}!", f"t{turn}", "", " \n", None, "é?", "x. "])
            rows.append((conv, r.choice([turn, turn, turn + 3, None]), role, text))
    return rows


@pytest.mark.parametrize("seed", range(4))
def test_matrices_against_all_edits(seed):
    r = random.Random(seed)
    for _ in range(6):
        rows = [(k, r.choice(["user", "assistant", "system", "tool"]), r.choice(["a.", "b.", "c", " "])) for k in range(r.randint(0, 3))]
        part = conversations.Part()
        for row in rows:
            part.add(*row)
        matrix = part.summary()["matrix"] if rows else conversations.UNIT
        assert conversations.cheapest(matrix) == plain_audit(rows, plain_faults(rows)) == plain_scan(rows, plain_faults(rows))[:2]


def test_product_is_associative():
    r = random.Random(1)
    for _ in range(200):
        a, b, c = ("".join(r.choice("suaoSUAOx") for _ in range(r.randint(0, 5))) for _ in range(3))
        x, y, z = map(conversations.run_matrix, (a, b, c))
        left, right = conversations.product(conversations.product(x, y), z), conversations.product(x, conversations.product(y, z))
        assert left == right == conversations.run_matrix(a + b + c)


@pytest.mark.parametrize("partitions", ["1", "13"])
def test_repair(spark, partitions):
    """Long conversations lie in many partitions; one has a null id, one only null turns."""
    rows = random_rows(7, [1, 2, 3, None, 5, 6], 9) + random_rows(8, [10, None], 150) + [(11, None, "user", "same.")] * 40 + [(12, 5, "user", " ")] * 3
    frame = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumns({"cost": F.lit("x"), "part": F.lit(1)}).repartition(3)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = {r.conv_id: tuple(r[c] for c in (*conversations.COUNTS, "audit", "repaired_sha256")) for r in conversations.repair(frame).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert found == plain_repair(rows)


def test_repair_of_string_ids_and_nothing(spark):
    schema = "conv_id string, turn long, role string, text string"
    assert conversations.repair(spark.createDataFrame([], schema)).count() == 0
    rows = [("b", 0, "user", "Hi."), ("a", 0, "assistant", "Hi."), ("a", None, "system", "Be good." * 50_000)]
    found = {r.conv_id: (r.cost, r.audit) for r in conversations.repair(spark.createDataFrame(rows, schema)).collect()}
    assert found == {"b": (3, "KI"), "a": (3, "KIK")}


def test_damage_on_nulls(spark):
    rows = [(c, t, None, None) for c in (None, 1, 2) for t in [None, *range(60)]]
    damaged = conversations.damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    found = damaged.collect()
    assert {r.role for r in found} == {" ", "user"} and {r.text for r in found} == {" ", ""}
    assert damaged.columns == ["conv_id", "turn", "role", "text"] and any(found.count(r) == 2 for r in found)
