"""Conversation repair against a plain search over unfolded rows."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from retail_lake.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string"


def plain_damage(rows):
    for conv, turn, role, text in rows:
        conv_name, turn_name = (" " if v is None else str(v) for v in (conv, turn))
        fault = zlib.crc32(f"{conv_name}:{turn_name}".encode()) % 20
        role, text = (" " if v is None else v for v in (role, text))
        if fault == 1:
            text = ""
        elif fault == 2:
            text = re.sub("[.!?]", "", text)
        elif fault == 4:
            role = "user"
        for _ in range({0: 0, 3: 2}.get(fault, 1)):
            yield conv, turn, role, text


def order(row):
    _, turn, role, text = row
    return (turn is not None, turn or 0, role, text[:32], hashlib.sha256(text.encode()).digest())


def judged(rows):
    """For each row in order its first fault or ''."""
    seen, out = set(), []
    for _, _, role, text in rows:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated"
        seen.add((role, text))
        out.append(fault)
    return out


def best_edit(rows, faults):
    """Least (cost, audit, repaired rows): every state after each row, inserts tried at most thrice in a row."""
    done = {"": (0, "", ())}  # by initials written, only the last and whether any counts

    def state(initials):
        return initials[-1:] if initials else ""

    def put(into, key, value):
        if key not in into or value[:2] < into[key][:2]:
            into[key] = value

    follow = {"": "su", "s": "u", "u": "a", "a": "u"}

    def with_inserts(states):
        for _ in range(3):
            for key, (cost, audit, said) in list(states.items()):
                for role in ("user", "assistant"):
                    if role[0] in follow[key]:
                        put(states, role[0], (cost + 2, audit + "I", (*said, (role, ""))))
        return states

    states = with_inserts(done)
    for (_, _, role, text), fault in zip(rows, faults, strict=True):
        after = {}
        for key, (cost, audit, said) in states.items():
            put(after, key, (cost + 3, audit + "D", said))
            if fault in ("blank", "duplicate"):
                continue
            extra = fault == "truncated"
            if role[:1] and role[:1] in follow[key]:
                put(after, state(role[:1]), (cost + extra, audit + "K", (*said, (role, text))))
            for to in ("user", "assistant"):
                if to[0] in follow[key]:
                    put(after, to[0], (cost + 2 + extra, audit + "R", (*said, (to, text))))
        states = with_inserts(after)
    return min(states[k] for k in ("", "a") if k in states)


def plain(rows):
    by_conv = {conv: [] for conv, *_ in rows}
    for row in plain_damage(rows):
        by_conv[row[0]].append(row)
    out = {}
    for conv, own in by_conv.items():
        own.sort(key=order)
        faults = judged(own)
        turns = [t for _, t, _, _ in own if t is not None]
        initials = [r[:1] for _, _, r, _ in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        cost, audit, said = best_edit(own, faults)
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest(),
        )
    return out


def made(seed, conversations=120):
    rng = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "umpire"]
    texts = ["Yes.", "No!", "Why? ", "cut off", "", " \n", None, "Long. " * 40, "Long. " * 40 + "x", "a.\u0085", "\u0085", "日本."]
    rows = []
    for conv in range(conversations):
        for turn in range(rng.randint(0, 9)):
            rows.append((conv, rng.choice([turn, turn, turn, turn * 3, None]), rng.choice(roles[: rng.randint(2, 9)]), rng.choice(texts)))
    rows += [(None, k, rng.choice(roles), rng.choice(texts)) for k in range(6)]
    rows += [(-5, k // 3, rng.choice(roles), f"{rng.choice(texts)} {k % 40}.") for k in range(700)]  # several blocks
    rows += [(-6, 1, "user", "Again.")] * 50 + [(-7, None, None, None)]
    rows += rows[:5]
    rng.shuffle(rows)
    return rows


def named(frame):
    return {r.conv_id: tuple(r)[1:] for r in frame.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_against_plain_search(spark, monkeypatch, seed):
    rows = made(seed)
    turns = spark.createDataFrame(rows, SCHEMA).withColumn("audit", F.lit("x")).withColumn("head", F.lit(1))
    if seed == 2:
        monkeypatch.setattr(repair, "BLOCK_ROWS", 3)
    found, wanted = named(repair.repair_report(repair.damaged(turns.repartition(3)), "copies")), plain(rows)
    assert found.keys() == wanted.keys()
    for conv, own in wanted.items():
        assert found[conv] == own, conv


def test_search_from_both_ends_is_exhaustive_search():
    rng = random.Random(8)
    for _ in range(400):
        block = [repair.Row(rng.choice("usatx"), rng.random() < 0.2, rng.random() < 0.3, rng.choice([1, 1, 1, 2])) for _ in range(rng.randint(1, 3))]
        letters = [[("D", 3)] if row.must_go else [("K", row.truncated), ("R", 2 + row.truncated), ("D", 3)] for row in block]
        for start, end in itertools.product(range(4), repeat=2):
            best = None
            for choice in itertools.product(*letters):
                for inserts in itertools.product(range(4), repeat=len(block) + 1):
                    cost, audit, states = 2 * sum(inserts), "", {start}
                    for k, n in enumerate(inserts):
                        audit += "I" * n
                        for _ in range(n):
                            states = {repair.STEPS[r][s] for s in states for r in "ua" if s in repair.STEPS[r]}
                        if k == len(block):
                            break
                        letter, price = choice[k]
                        copies = block[k].copies - 1
                        cost, audit = cost + price + 3 * copies, audit + letter + "D" * copies
                        allowed = {"K": block[k].initial, "R": "ua", "D": ""}[letter]
                        if letter != "D":
                            states = {repair.STEPS[r][s] for s in states for r in allowed if s in repair.STEPS.get(r, ())}
                    if end in states and (best is None or (cost, audit) < best):
                        best = (cost, audit)
            assert repair.cheapest(block, start, (end,)) == best


def test_blocks_put_together_equal_the_whole():
    rng = random.Random(9)
    for _ in range(60):
        block = [repair.Row(rng.choice("usaat"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(12)]
        whole = repair.cheapest(block, 0, (0, 3))
        conversation = repair._Conversation(1)
        for k in range(0, 12, 5):
            conversation.add(
                {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "first": "", "last": "", "low": None,
                 "paths": [dict(zip(("start", "end", "cost", "audit"), p, strict=True)) for p in repair.block_paths(block[k : k + 5])]}
            )
        assert tuple(conversation.result()[-2:]) == whole


def test_repaired_turns_alternate(spark):
    turns = spark.createDataFrame(made(3, 40), SCHEMA)
    found = {}
    for r in repair.repaired_turns(turns).orderBy("conv_id", "place").collect():
        found.setdefault(r.conv_id, []).append(r)
    for own in found.values():
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in own)) and [r.place for r in own] == list(range(len(own)))


def test_empty_table_and_dropped_rows(spark):
    assert repair.repair_report(spark.createDataFrame([], SCHEMA)).count() == 0
    turns = spark.createDataFrame([(4, 1, "user", "x.")], SCHEMA).withColumn("copies", F.lit(0))
    assert repair.repair_report(turns).first().audit == "KI"  # a column of that name alone changes nothing
    assert named(repair.repair_report(turns, "copies")) == {4: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_query(spark):
    from retail_lake.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert named(QUERIES["op11_conversation_repair"](spark, sf)) == plain(rows)
