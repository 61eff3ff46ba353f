"""Conversation repair against a plain search over whole repairs."""

import hashlib
import random
import zlib

import pytest

from tidemark.llm import conversations as C
from tidemark.llm.queries import QUERIES

STEP = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
WHITE = " \t\n\x0b\x0c\r"


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        end = text.rstrip(WHITE)
        out.append(1 if not end else 2 if (role, text) in seen else 3 if end[-1] not in ".!?" else 0)
        seen.add((role, text))
    return out


def cheapest(rows):
    """Cost, audit and repaired lines: the least pair over all repairs, by recursion from the end."""
    kinds = faults(rows)
    best = {"": (0, "", ()), "s": None, "u": None, "a": (0, "", ())}

    def insert(best):
        for _ in range(3):
            for now in ("", "s", "u", "a"):
                for new in "ua":
                    to = STEP.get((now, new))
                    if to and best[to]:
                        c, a, t = best[to]
                        found = (c + 3, "I" + a, (("user:" if new == "u" else "assistant:"), *t))
                        best[now] = min(best[now], found) if best[now] else found
        return best

    best = insert(best)
    for (role, text), kind in reversed(list(zip(rows, kinds, strict=True))):
        after = {}
        for now in ("", "s", "u", "a"):
            c, a, t = best[now]
            options = [(c + 4, "D" + a, t)]
            if kind not in (1, 2):
                more = 3 if kind == 3 else 0
                for letter, new in [("K", role), ("R", "user"), ("R", "assistant")]:
                    to = STEP.get((now, new[:1]))
                    if to and best[to]:
                        c, a, t = best[to]
                        options.append((c + more + (3 if letter == "R" else 0), letter + a, (f"{new}:{text}", *t)))
            after[now] = min(options)
        best = insert(after)
    return best[""]


def expected(rows):
    """By conversation, from (conv, turn, role, text) after damage."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted(((t, r, " " if x is None else x) for c, t, r, x in ((c, t, " " if r is None else r, x) for c, t, r, x in rows) if c == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = [t for t, _, _ in own if t is not None]
        pairs = [(r, x) for _, r, x in own]
        kinds, initials = faults(pairs), [r[:1] for r, _ in pairs]
        cost, audit, lines = cheapest(pairs)
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, kinds.count(1), kinds.count(2), kinds.count(3),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


NAMES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"


def found(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS place", "'x' AS code", "2 AS conv", "'y' AS audit")
    edits, facts = C.plan(df)
    got = facts.join(C.digests(C.repaired(edits)), "conv", "left").collect()
    assert len(got) == len({r[0] for r in rows})
    return {r.conv_id: tuple(r[n] if r[n] is not None else hashlib.sha256(b"").hexdigest() for n in NAMES) for r in got}


def random_rows(seed, convs, longest):
    rng = random.Random(seed)
    return [(c or None, rng.choice([i, i, i, rng.randrange(9), None]), rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None]), rng.choice(["a.", "b!", "c", "", " \t", "d?\n", f"own {i}.", f"own {i}", None, "é.漢"])) for c in range(convs) for i in range(rng.randrange(1, longest))]


@pytest.mark.parametrize("block, fan", [(2048, 1024), (3, 2)])
def test_equals_plain_search(spark, monkeypatch, block, fan):
    monkeypatch.setattr(C, "BLOCK", block)
    monkeypatch.setattr(C, "FAN", fan)
    rows = random_rows(block, 60, 12) + random_rows(7, 1, 90) + [(99, None, None, None)] * 3
    assert found(spark, rows) == expected(rows)


def test_one_conversation_with_most_rows(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 16)
    monkeypatch.setattr(C, "FAN", 4)
    rng = random.Random(4)
    rows = [(1, i, rng.choice(["user", "assistant"]), f"text {i}" + rng.choice([".", ""])) for i in range(1500)] + random_rows(2, 30, 9)
    assert found(spark, rows) == expected(rows)


def test_empty(spark):
    edits, facts = C.plan(spark.createDataFrame([], SCHEMA))
    assert facts.collect() == [] and C.repaired(edits).collect() == []


def damage(rows):
    for c, t, r, x in rows:
        key = f"{' ' if c is None else c}:{' ' if t is None else t}"
        case = zlib.crc32(key.encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        if case:
            x = "" if case == 1 else "".join(k for k in x if k not in ".!?") if case == 2 else x
            yield from [(c, t, "user" if case == 4 else r, x)] * (2 if case == 3 else 1)


def test_query(spark, tmp_path):
    odd = random_rows(11, 40, 8) + [(500 + i, i, "user", "x") for i in range(60)] + [(None, None, None, None)]
    spark.createDataFrame(odd, SCHEMA).coalesce(2).write.parquet(f"{tmp_path}/conversations.parquet")
    for sf in (str(tmp_path), "/root/testdata/sf0.001"):
        rows = [tuple(r[n] for n in ("conv_id", "turn", "role", "text")) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
        want = expected(list(damage(rows)))
        nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
        got = QUERIES["op12_conversation_repair"](spark, sf).collect()
        assert len(got) == len({r[0] for r in rows})
        assert {r.conv_id: tuple(r[n] for n in NAMES) for r in got} == {c: want.get(c, nothing) for c in {r[0] for r in rows}}


def test_query_equals_its_sql(spark):
    import duckdb

    from tidemark.llm.queries import ORACLES

    con = duckdb.connect()
    con.sql("CREATE VIEW conversations AS SELECT * FROM '/root/testdata/sf0.001/conversations.parquet'")
    want = con.sql(ORACLES["op12_conversation_repair"])
    got = QUERIES["op12_conversation_repair"](spark, "/root/testdata/sf0.001")
    assert sorted(tuple(r[c] for c in want.columns) for r in got.collect()) == sorted(want.fetchall())
