"""Conversation repair against all edit sequences, against SQL, and on awkward rows."""

import hashlib
import itertools
import random
import re
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from colex.llm import conversations as C

from ..oracle import connect, rows
from . import data

SCHEMA = "conv_id long, turn long, role string, text string"


def all_repairs(said, faults, most_inserts=2):
    """The cheapest (cost, audit, text) of every edit sequence with up to `most_inserts` inserts at a place."""
    gaps = [g for n in range(most_inserts + 1) for g in itertools.product(("user", "assistant"), repeat=n)]
    states = [(0, "", ())]
    for (role, text), fault in zip(said, faults, strict=True):
        after = []
        for cost, audit, out in states:
            for gap in gaps:
                c, a, o = cost + 3 * len(gap), audit + "I" * len(gap), out + tuple((r, "") for r in gap)
                after.append((c + 4, a + "D", o))
                if fault not in ("blank", "duplicate"):
                    more = 3 if fault == "truncated" else 0
                    after.append((c + more, a + "K", o + ((role, text),)))
                    after += [(c + 3 + more, a + "R", o + ((r, text),)) for r in ("user", "assistant")]
        # what can't be a prefix of a whole conversation goes
        states = [s for s in after if re.fullmatch("s?(ua)*u?", "".join(r[:1] or "?" for r, _ in s[2]))]
    ends = [(c + 3 * len(g), a + "I" * len(g), o + tuple((r, "") for r in g)) for c, a, o in states for g in gaps]
    cost, audit, out = min(e for e in ends if re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in e[2])))
    return cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()


def test_repair_against_all_edits():
    rng = random.Random(4)
    for n in (0, 1, 2, 3, 4, 4, 4) * 12:
        said = [(rng.choice(["user", "assistant", "system", "Pirate", "", " "]) if rng.random() < 0.5 else ["user", "assistant"][i % 2], f"t{i}.") for i in range(n)]
        faults = [rng.choice([None, None, None, "blank", "duplicate", "truncated"]) for _ in said]
        repair = C.Repair()
        for (role, text), fault in zip(said, faults, strict=True):
            repair.row(role, text, fault in ("blank", "duplicate"), fault == "truncated")
        assert repair.end() == all_repairs(said, faults), (said, faults)


AWKWARD = [
    (1, 0, "system", "Be kind."), (1, 1, "user", "Hello?"), (1, 2, "assistant", "Yes!"), (1, 2, "assistant", "Yes!"),  # a repeated row
    (1, None, "user", "no turn."), (1, 9, None, "no role."), (1, 10, "user", None), (1, 11, "Pirate", "arr"), (1, 12, "", "empty role."),
    (2, 3, "assistant", " \t\n"), (2, 3, "user", "tie."), (2, 3, "user", "a tie"), (None, 0, "user", "no id."), (None, None, None, None), (None, 1, "assistant", "é" * 70_000 + "."),
    (3, None, "user", "x."), (4, -5, "user", "x."), (4, 5, "assistant", "y。"),
]


@pytest.fixture(scope="module")
def many():
    rng = random.Random(8)
    some = [(c, t, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["a.", "b", "c!", "d?", " ", "e."])) for c in range(10, 90) for t in range(rng.randrange(9))]
    return AWKWARD + some


def test_rows_against_sql(spark, many):
    df = data.clashing(spark.createDataFrame(many, SCHEMA).repartition(3))
    con = connect("/nowhere")
    con.register("conversations", pd.DataFrame(many, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    found = rows(C.repaired(C.damaged(df)).toPandas().astype({"conv_id": "Int64"}))
    assert found == rows(con.execute(C.OP11_SQL).df())
    assert len(found) == len({r[0] for r in many})


def test_checksum_in_sql(spark):
    keys = ["", "0:0", "123456:7", "é: ", "𠮷"]
    found = [r[0] for r in spark.createDataFrame([(k,) for k in keys], "k string").select(F.crc32(F.col("k").cast("binary"))).collect()]
    con = connect("/nowhere")
    con.register("t", pd.DataFrame({"i": range(len(keys)), "k": keys}))
    assert [r[0] for r in con.execute(f"SELECT {C.crc32_sql('k')} FROM t, {C.CRC_TABLE_SQL} ORDER BY i").fetchall()] == found


def test_dropped_rows_leave_the_conversation(spark):
    df = spark.createDataFrame([(1, 0, "user", "x.", True), (2, 0, "user", "x", False)], SCHEMA + ", dropped boolean")
    one, two = sorted(C.repaired(df).collect())
    empty = hashlib.sha256(b"").hexdigest()
    assert tuple(one) == (1, 0, 0, 0, 0, 0, 0, "", empty)
    assert tuple(two) == (2, 0, 0, 0, 1, 0, 4, "D", empty)  # keeping costs 3 for the truncation and 3 for an answer


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert C.repaired(C.damaged(df)).collect() == []


def test_long_conversation_is_linear():
    def took(n):
        repair, began = C.Repair(), time.perf_counter()
        for i in range(n):
            repair.row(["user", "assistant", "user"][i % 3], f"t{i}.", i % 17 == 0, i % 5 == 0)
        cost, audit, _ = repair.end()
        assert len(audit) >= n and cost > 0
        return time.perf_counter() - began

    took(2_000)
    assert took(40_000) < 20 * max(took(4_000), 0.02)
