"""Conversation repair against whole audits compared as strings."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from propwise.llm import conversations as C
from propwise.llm.queries import op12_conversations

from .test_text_operators import SF

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
SPACES = " \t\n\x0b\x0c\r"
ALL = "suaoSUAOX"


def brute_audit(codes):
    """Costs and whole audits from the end, letter by letter."""
    ahead = {0: (0, ""), 1: (10, "II"), 2: (5, "I"), 3: (0, "")}
    fits = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
    for c in reversed(codes):
        now = {}
        for s in range(4):
            ways = [(ahead[s][0] + 2, "D" + ahead[s][1])]
            if c != "X":
                extra, to = 5 * c.isupper(), 3 if s == 2 else 2
                ways.append((ahead[to][0] + 1 + extra, "R" + ahead[to][1]))
                if (c.lower(), s) in fits:
                    ways.append((ahead[fits[c.lower(), s]][0] + extra, "K" + ahead[fits[c.lower(), s]][1]))
            now[s] = min(ways)
        for _ in range(3):
            for s in range(4):
                to = 3 if s == 2 else 2
                now[s] = min(now[s], (now[to][0] + 5, "I" + now[to][1]))
        ahead = now
    return ahead[0]


def brute(rows, damaged):
    convs = {}
    for conv, turn, role, text in rows:
        found = convs.setdefault(conv, [])
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20 if damaged else 99
        role, text = " " if role is None else role, " " if text is None else text
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            found += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, found in convs.items():
        digest = lambda r: hashlib.sha256(f"{len(r[1].encode())}:{r[1]}{r[2]}".encode()).hexdigest()
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, digest(r)))
        seen, codes, n = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in found:
            code, fault = role[:1] if role[:1] in set("sua") else "o", None
            if not text.strip(SPACES):
                code, fault = "X", "blank"
            elif (role, text) in seen:
                code, fault = "X", "duplicate"
            elif text.rstrip(SPACES)[-1] not in ".!?":
                code, fault = code.upper(), "truncated"
            if fault:
                n[fault] += 1
            seen.add((role, text))
            codes.append(code)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(found, found[1:]))
        turns = [r[0] for r in found if r[0] is not None]
        cost, audit = brute_audit(codes)
        left, lines, state = iter(found), [], 0
        for edit in audit:
            row = None if edit == "I" else next(left)
            if edit == "K":
                state = {"s": 1, "u": 2, "a": 3}[row[1][0]]
                lines.append(f"{row[1]}:{row[2]}")
            elif edit != "D":
                state = 3 if state == 2 else 2
                lines.append(f"{'user' if state == 2 else 'assistant'}:{row[2] if row else ''}")
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *n.values(), illegal, cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def result(df):
    rows = df.collect()
    found = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in rows}
    assert len(found) == len(rows)
    return found


def odd_rows(n=1500, seed=1):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", None, "", "tool", "User", "a"]
    texts = ["Hi.", "Yes!", "No", "  ", "", None, "ok?", "a . b", "x\n", "é. ", "."]
    rows = [(rng.choice([None, 1, 2, 3, 3, 3, 4, *range(6, 40)]), rng.choice([None, *range(30)]),
             rng.choices(roles, [9, 9, 3, 1, 1, 1, 1, 1])[0], rng.choice(texts)) for _ in range(n)]
    # one conversation with a third of all rows and more, its turns far apart, repeated rows among them
    rows += [(3, i * 3, "ua"[i % 2], f"t{i}" + rng.choice([".", ""])) for i in range(n // 2)]
    return rows + [(7, 5, "user", "Again.")] * 50


def test_short_audits_all_of_them():
    for n in range(4):
        for codes in itertools.product(ALL, repeat=n):
            assert C.repair("".join(codes)) == brute_audit(codes)


def test_long_audits_and_stretches():
    rng = random.Random(3)
    for _ in range(400):
        codes = "".join(rng.choices(ALL, k=rng.randint(4, 120)))
        want = brute_audit(codes)
        assert C.repair(codes) == want
        # the same from tables of stretches cut anywhere
        cuts = sorted(rng.sample(range(1, len(codes)), rng.randint(1, 3)))
        parts = [codes[i:j] for i, j in zip([0, *cuts], [*cuts, len(codes)])]
        tables = [*map(C.stretch_table, parts), C.end_table()]
        states = [0, *C.crossings(tables, 0, 0)]
        audit = "".join(C.audit_between(p, a, b) for p, a, b in zip(parts, states, states[1:]))
        assert audit + tables[-1][states[-2]][0][1] == want[1]


def test_only_vectors_of_four_meet():
    vector = {0: (0, 0)}
    for code in "usaoXUA" * 50:
        vector = C.forward(vector, C.row_table(code))
        assert len(vector) <= 4


@pytest.mark.parametrize("damaged", [True, False])
@pytest.mark.parametrize("tasks", [None, 9])
def test_odd_conversations_equal_brute_force(spark, damaged, tasks):
    rows = odd_rows()
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as audit", "'x' as digest").repartition(3)
    assert result(C.repair_conversations(df, damaged, tasks)) == brute(rows, damaged)


def test_table_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    assert result(op12_conversations(spark, SF)) == brute([tuple(r) for r in rows], True)


def test_repaired_rows_read_as_they_should(spark):
    rows = odd_rows(400)
    df = spark.createDataFrame(rows, SCHEMA)
    found = {}
    for r in sorted(C.repaired_rows(df, True, 5).collect(), key=lambda r: (str(r.conv_id), r.place)):
        assert r.place == len(found.setdefault(r.conv_id, []))
        found[r.conv_id].append(r)
        assert (r.edit == "I") == (r.turn is None and r.text == "") or r.turn is None
    want = brute(rows, True)
    for conv, lines in found.items():
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in lines))
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in lines).encode()).hexdigest() == want[conv][-1]
    assert all(want[c][-1] == hashlib.sha256(b"").hexdigest() for c in set(want) - set(found))


def test_long_runs_of_white_space(spark):
    rows = [(1, 0, "user", "Hi." + " \n" * 400_000 + "x"), (1, 1, "assistant", " " * 700_000), (1, 2, "assistant", "Yes." + "\t" * 300_000)]
    assert result(C.repair_conversations(spark.createDataFrame(rows, SCHEMA))) == brute(rows, False)


def test_turns_as_far_apart_as_can_be(spark):
    far = [(1, -2 ** 63, "user", "Hi."), (1, 2 ** 63 - 1, "assistant", "Yes."), (2, 0, "user", "Hi."), (2, 2 ** 62, "assistant", "Yes."),
           *((3, t, "user", "Hi.") for t in (-2 ** 63, 0, 2 ** 63 - 1)), (4, 7, "user", "Hi."), (4, 9, "assistant", "Yes.")]
    for tasks in (1, 5):
        got = result(C.repair_conversations(spark.createDataFrame(far, SCHEMA), tasks=tasks))
        assert [got[i][0] for i in (1, 2, 3, 4)] == [2 ** 63 - 1, 2 ** 62 - 1, 2 ** 63 - 1, 1]


def test_empty_and_dropped(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert C.repair_conversations(df, True).count() == 0 and C.repaired_rows(df).count() == 0
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    one = spark.createDataFrame([(gone, 0, "user", "Hi.")], SCHEMA)
    assert result(C.repair_conversations(one, True)) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
