import hashlib
import itertools
import random
import re
import zlib

import pytest

from oddlog.llm import conversations as conv
from oddlog.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, key string, audit int"
INITIALS = {0: "", 1: "s", 2: "u", 3: "a"}


def plain(letters):
    """Best (cost, edits) by a table over messages and states, without an agenda."""
    table = {0: (0, "")}
    for x in [*letters, None]:
        for _ in range(3):
            for (state, initial), after in conv.MOVES.items():
                if state in table and initial != "s":
                    cost, edits = table[state]
                    table[after] = min(table.get(after, (1 << 60, "")), (cost + 5, edits + "I"))
        if x is None:
            break
        new = {}

        def offer(state, value):
            new[state] = min(new.get(state, value), value)

        for state, (cost, edits) in table.items():
            offer(state, (cost + 2, edits + "D"))
            if x in conv.DOOMED:
                continue
            own = cost + 5 * (x in conv.TRUNCATED)
            for (before, initial), after in conv.MOVES.items():
                if before == state and x.lower() == initial:
                    offer(after, (own, edits + "K"))
                if before == state and initial != "s":
                    offer(after, (own + 1, edits + "R"))
        table = new
    return min(table[s] for s in (0, 3) if s in table)


def every_repair(letters, most=2):
    """All edits with at most ``most`` insertions, tried one by one."""
    best = None
    n = len(letters)
    for inserted in range(most + 1):
        for places in itertools.combinations_with_replacement(range(n + 1), inserted):
            for edits in itertools.product("KRD", repeat=n):
                audit, sets, cost = "", [], 5 * inserted
                for i in range(n + 1):
                    audit += "I" * places.count(i)
                    sets += ["ua"] * places.count(i)
                    if i < n:
                        audit += edits[i]
                        x = letters[i]
                        if edits[i] == "D":
                            cost += 2
                            continue
                        if x in conv.DOOMED:
                            break
                        cost += 5 * (x in conv.TRUNCATED) + (edits[i] == "R")
                        sets.append(x.lower() if edits[i] == "K" else "ua")
                else:
                    if any(re.fullmatch("(s?(ua)+)?", "".join(roles)) for roles in itertools.product(*sets)):
                        best = min(best or (cost, audit), (cost, audit))
    return best


def test_agenda_equals_trying_everything():
    rng = random.Random(4)
    texts = ["", *"suaoSUAw", *("".join(rng.choice("suauaosuUAw") for _ in range(rng.randint(2, 5))) for _ in range(60))]
    for letters in texts:
        assert conv.solve(letters) == every_repair(letters) == plain(letters), letters


def test_blocks_equal_one_derivation(monkeypatch):
    rng = random.Random(8)
    texts = ["".join(rng.choice("suauauaoUAw") for _ in range(rng.randint(0, 60))) for _ in range(80)]
    texts += ["ua" * 40, "s" * 30, "w" * 30, "o" * 31, "uuuuaaaa" * 5]
    want = [conv.solve(x) for x in texts]
    assert want == [plain(x) for x in texts]
    monkeypatch.setattr(conv, "BLOCK", 7)
    conv.across.cache_clear()
    assert [conv.solve(x) for x in texts] == want
    long = "".join(rng.choice("suauauaoUAw") for _ in range(5000))
    monkeypatch.setattr(conv, "BLOCK", 256)
    conv.across.cache_clear()
    assert conv.solve(long) == plain(long)


def brute(rows):
    out = {}
    for conv_id, turn, role, text in rows:
        known = [" " if v is None else v for v in (conv_id, turn, role, text)]
        fault = zlib.crc32(f"{known[0]}:{known[1]}".encode()) % 20
        role, text = known[2:]
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        role = "user" if fault == 4 else role
        out.setdefault(conv_id, []).extend([(turn is not None, turn or 0, role, text)] * {0: 0, 3: 2}.get(fault, 1))
    result = []
    for conv_id, messages in out.items():
        messages.sort()
        turns = [m[1] for m in messages if m[0]]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        seen, letters, counts = set(), "", [0, 0, 0]
        for _, _, role, text in messages:
            kept = text.strip(conv.SPACES)
            fault = 0 if not kept else 1 if (role, text) in seen else 2 if kept[-1] not in ".!?" else 3
            seen.add((role, text))
            at = "suao".find(role[:1] or "o") if role[:1] in ("s", "u", "a") else 3
            letters += [conv.DOOMED, conv.DOOMED, conv.TRUNCATED, conv.SOUND][fault][at]
            if fault < 3:
                counts[fault] += 1
        illegal = sum((a[2][:1] + b[2][:1]) not in ("su", "ua", "au") for a, b in zip(messages, messages[1:]))
        cost, audit = plain(letters)
        lines, at, first = [], 0, ""
        for edit in audit:
            if edit == "I":
                text, role = "", None
            else:
                _, _, role, text = messages[at]
                at += 1
                if edit == "D":
                    continue
                role = role if edit == "K" else None
            if role is None:
                role = "assistant" if (len(lines) - (first == "s")) % 2 else "user"
            first = first or role[0]
            lines.append(f"{role}:{text}")
        result.append((conv_id, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(result, key=repr)


def asked(spark, tmp_path, rows):
    spark.createDataFrame([(*r, "a key", 3) for r in rows], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    return sorted(map(tuple, QUERIES["op11_repair"](spark, str(tmp_path)).collect()), key=repr)


def sample(n, seed=2):
    rng = random.Random(seed)
    texts = ["Yes.", "No?", "cut off", "", " \t", "a. ", "b.\n\x0b", "c\xa0", "é!", "one\ntwo.", "v" * 100 + "1.", "v" * 100 + "2."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", "User", "a", None]
    return [(i // 7, rng.randint(0, 9) * (i % 7), rng.choice(roles), rng.choice(texts) + rng.choice(["", f" {i}."])) for i in range(n)]


def test_query_equals_a_plain_version(spark, tmp_path):
    rows = sample(400)
    rows += [(None, i % 3, "user", f"{i}.") for i in range(6)] + [(900, None, "user", None), (900, None, None, "x."), (901, None, None, None)]
    rows += [rows[3]] * 3 + [(902, 1, "user", "long. " * 50_000), (902, 2, "assistant", "y" * 300_000)]
    assert asked(spark, tmp_path, rows) == brute(rows)


def test_one_long_conversation_over_many_tasks(spark, tmp_path):
    rng = random.Random(1)
    rows = [(1, i + i // 300, rng.choice(["user", "assistant", "system"]), rng.choice(["a.", f"{i}!", "c", f"{i}"])) for i in range(3000)]
    rows += [(1, 2999 + 9, "user", f"end {i}.") for i in range(300)] + sample(50)
    assert asked(spark, tmp_path, rows) == brute(rows)


def test_dropped_and_empty(spark, tmp_path):
    alone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    assert asked(spark, tmp_path / "a", [(alone, 0, "user", "x.")]) == [(alone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert asked(spark, tmp_path / "b", []) == []


def test_messages_are_the_edits(spark):
    rows = [(1, 1, "user", "Hi."), (1, 2, "user", "Hi."), (1, 3, "user", "more."), (2, 0, "tool", "x!"), (2, 1, "tool", "y!"), (3, 5, "system", "be.")]
    fixed = conv.repair(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string"))
    got = [tuple(r)[1:6] for r in fixed.messages.orderBy("conv_id", "step").collect()]
    assert got == [(1, 1, "K", "user", "Hi."), (1, 2, "D", "user", "Hi."), (1, 3, "R", "assistant", "more."), (2, 1, "R", "user", "x!"), (2, 2, "R", "assistant", "y!"), (3, 1, "D", "system", "be.")]
    counts = {r.conv_id: (r.cost, r.audit, r.duplicate) for r in fixed.conversations.collect()}
    assert counts == {1: (3, "KDR", 1), 2: (2, "RR", 0), 3: (2, "D", 0)}


@pytest.mark.parametrize("letters", ["", "ua", "sua"])
def test_sound_conversations_are_left_alone(letters):
    assert conv.solve(letters) == (0, "K" * len(letters))
