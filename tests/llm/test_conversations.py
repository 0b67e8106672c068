"""Repair of conversations against an exhaustive search over edits."""

import hashlib
import random
import re
from collections import defaultdict
from functools import lru_cache
from zlib import crc32

import pytest

from siftline.llm import conversations, queries

SCHEMA = "conv_id long, turn long, role string, text string, at int, present boolean, seen int, fault string, key int, audit string, cost int"
CLASH = (7, False, 7, "x", 7, "x", 7)
WHITE = " \t\n\x0b\f\r"


def brute_damage(rows):
    out, ids = [], {r[0] for r in rows}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out, ids


def brute_edits(rows):
    """(cost, audit, repaired rows) by trying every edit; ``rows`` of (role, text, fault)."""
    @lru_cache(None)
    def best(i, ending, put_in):
        found = []
        if i == len(rows) and (ending == "" or ending == "a"):
            found.append((0, "", ()))

        def then(cost, letter, at, role, text, more):
            if ending + role[:1] in ("s", "u", "su", "ua", "au"):
                later = best(at, role[:1], more)
                if later:
                    found.append((cost + later[0], letter + later[1], ((role, text), *later[2])))

        if put_in < 3:
            for role in ("user", "assistant"):
                then(2, "I", i, role, "", put_in + 1)
        if i < len(rows):
            role, text, fault = rows[i]
            later = best(i + 1, ending, 0)
            if later:
                found.append((3 + later[0], "D" + later[1], later[2]))
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                if role[:1] in ("s", "u", "a"):
                    then(extra, "K", i + 1, role, text, 0)
                for new in ("user", "assistant"):
                    then(2 + extra, "R", i + 1, new, text, 0)
        return min(found, default=None)

    return best(0, "", 0)


def brute(rows, damage=True):
    rows, ids = brute_damage(rows) if damage else (rows, {r[0] for r in rows})
    by_id = defaultdict(list)
    for conv, turn, role, text in rows:
        by_id[conv].append((turn is not None, turn or 0, role.encode(), text.encode(), turn, role, text))
    out = {}
    for conv in ids:
        seen, faulty, illegal = set(), [], 0
        own = sorted(by_id[conv], key=lambda r: r[:4])
        for *_, role, text in own:
            fault = "blank" if not text.strip(WHITE) else "duplicate" if (role, text) in seen else "truncated" if text.rstrip(WHITE)[-1] not in ".!?" else None
            seen.add((role, text))
            illegal += bool(faulty) and faulty[-1][0][:1] + role[:1] not in ("su", "ua", "au")
            faulty.append((role, text, fault))
        turns = [r[4] for r in own if r[4] is not None]
        cost, audit, left = brute_edits(tuple(faulty))
        kinds = [f for _, _, f in faulty]
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal,
                     cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest())
    return out


def summary(df):
    return {r[0]: tuple(r[1:]) for r in df.collect()}


@pytest.mark.parametrize("segment", [256, 3])
def test_paths_against_exhaustive_search(monkeypatch, segment):
    monkeypatch.setattr(conversations, "SEGMENT", segment)
    dice = random.Random(segment)
    for _ in range(1500):
        n = dice.randrange(10)
        roles = dice.choice((["user"], ["assistant"], ["user", "assistant"], ["system", "user", "assistant", "tool", ""]))
        rows = tuple((dice.choice(roles), "t", dice.choice((None, None, "truncated", "blank", "duplicate"))) for _ in range(n))
        cost, audit, _ = brute_edits(rows)
        assert conversations.cheapest((role[:1], fault) for role, _, fault in rows) == (cost, audit)


def test_long_conversations_take_linear_time():
    rows = [("u", None)] * 60_000
    assert conversations.cheapest(rows) == (60_000, "KR" * 30_000)
    assert conversations.cheapest([("s", None)] + [("a", "blank")] * 9_999) == (30_000, "D" * 10_000)


def test_query_against_exhaustive_search(spark):
    for sf in ("sf0.001", "sf0.01"):
        rows = [tuple(r) for r in spark.read.parquet(f"/root/testdata/{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
        got = queries.QUERIES["op12_conversation_repair"](spark, f"/root/testdata/{sf}")
        assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
        assert summary(got) == brute(rows)


def test_odd_rows(spark, tmp_path):
    dice = random.Random(5)
    words = ["Yes.", "No!", "so", "", " \n", None, "é?", "Yes. ", "　", "a\x0b", "x" * 100_000, "."]
    roles = ["user", "assistant", "system", "User", "", None, "unit", "user"]
    rows = [(dice.choice([None, *range(60)]), dice.choice([None, 0, 1, 2, 3, 5, 9]), dice.choice(roles), dice.choice(words)) for _ in range(400)]
    rows += [rows[0]] * 5 + [(99, None, "user", "a."), (98, -3, "system", "b."), (98, 4, "user", "c")]
    df = spark.createDataFrame([(*r, *CLASH) for r in rows], SCHEMA)
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    assert summary(queries.QUERIES["op12_conversation_repair"](spark, str(tmp_path))) == brute(rows)
    assert conversations.repair_summary(df.limit(0)).count() == 0


def test_repaired_rows_and_a_long_conversation(spark):
    rows = [(1, k, "user" if k % 3 else "assistant", f"{k}.") for k in range(3000)] + [(None, 0, "system", "s."), (None, 1, "user", "hm")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    faulty = conversations.faults(df)
    solved = conversations.plans(faulty)
    got = defaultdict(list)
    for r in conversations.repaired(faulty, solved).collect():
        assert r.turn == len(got[r.conv_id])
        got[r.conv_id].append((r.edit, r.role, r.text))
    audits = {r.conv_id: r.audit for r in solved.collect()}
    assert got[None] == [("K", "system", "s."), ("K", "user", "hm"), ("I", "assistant", "")] and audits[None] == "KKI"
    assert "".join(e for e, _, _ in got[1]) == audits[1].replace("D", "")
    assert re.fullmatch("(ua)+", "".join(role[0] for _, role, _ in got[1]))
    assert [t for e, _, t in got[1] if e != "I"] == [r[3] for r, e in zip(rows, audits[1].replace("I", "")) if e != "D"]
