"""Conversation repair against every edit script."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import cache

from pyspark.sql import functions as F

from pageloom.llm import turns

GRAMMAR = re.compile("(s?(ua)+)?")
BLANKS = " \t\n\x0b\f\r"


def cheapest(rows):
    """(cost, audit) over all scripts; rows are (initial, fault)."""
    @cache
    def rest(i, spelled):
        best = (0, "") if i == len(rows) and GRAMMAR.fullmatch(spelled) else (10**9, "")
        options = []
        if len(spelled) < len(rows) + 3:
            options += [(2, "I", i, spelled + c) for c in "ua"]
        if i < len(rows):
            role, fault = rows[i]
            options.append((3, "D", i + 1, spelled))
            if fault not in "bd":
                extra = int(fault == "t")
                options.append((extra, "K", i + 1, spelled + role))
                options += [(2 + extra, "R", i + 1, spelled + c) for c in "ua"]
        for cost, letter, j, s in options:
            if GRAMMAR.fullmatch(s) or GRAMMAR.fullmatch(s + "a") or GRAMMAR.fullmatch(s + "ua"):
                c, audit = rest(j, s)
                best = min(best, (cost + c, letter + audit))
        return best

    return rest(0, "")


def test_every_script():
    rng = random.Random(1)
    for n in [*range(6)] * 60:
        rows = [(rng.choice("uuaasx"), rng.choice("nnnbdt")) for _ in range(n)]
        assert turns._repair("".join(a + b for a, b in rows)) == cheapest(tuple(rows)), rows


def folded(rows):
    """The least (cost, audit) for each state of the grammar, a row at a time; for long conversations."""
    state = {"": (0, "")}

    def add(to, key, value):
        if key not in to or value < to[key]:
            to[key] = value

    def insert(state):
        for _ in range(2):
            for s, (c, a) in list(state.items()):
                add(state, "a" if s in ("", "s", "u") else "u", (c + 2, a + "I"))
        return state

    for role, fault in rows:
        new = {}
        for s, (c, a) in insert(state).items():
            add(new, s, (c + 3, a + "D"))
            if fault in "bd":
                continue
            c += fault == "t"
            if s == "" and role == "s":
                add(new, "s", (c, a + "K"))
            due = "a" if s == "a" else "u"
            add(new, "u" if due == "a" else "a", (c, a + "K") if role == due else (c + 2, a + "R"))
        state = new
    state = insert(state)
    return min(state[s] for s in ("", "u") if s in state)


def test_long_conversations():
    rng = random.Random(2)
    for n in (40, 300, 3_000):
        rows = [(rng.choice("uuuaaaas"), rng.choice("nnnnnnbdt")) for _ in range(n)]
        assert turns._repair("".join(a + b for a, b in rows)) == folded(rows)
        rows = [("ua"[i % 2], "n") for i in range(n) if i % 7]
        assert turns._repair("".join(a + b for a, b in rows)) == folded(rows)


def by_hand(rows):
    """The whole query on (conv_id, turn, role, text)."""
    rows = sorted(((c, t, r if r is not None else " ", x if x is not None else " ") for c, t, r, x in rows),
                  key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).hexdigest()))
    chats = defaultdict(list)
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        chats[c] += [(t, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = Counter()
    for c, own in chats.items():
        seen, coded, numbers = set(), [], {t for t, _, _ in own if t is not None}
        for _, role, text in own:
            bare = text.strip(BLANKS)
            fault = "b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "n"
            seen.add((role, text))
            coded.append((role[:1] if role[:1] and role[:1] in "sua" else "x", fault))
        cost, audit = folded(coded)
        kept, places = [], iter(own)
        length = sum(e != "D" for e in audit)
        for e in audit:
            due = "user" if (length - len(kept)) % 2 == 0 else "assistant"
            _, role, text = (None, due, "") if e == "I" else next(places)
            if e != "D":
                kept.append(f"{due if e == 'R' else role}:{text}")
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        roles = [r for r, _ in coded]
        out[(c, gaps, *(sum(f == k for _, f in coded) for k in "bdt"), sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:])),
             cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest())] += 1
    return out


def test_query(spark, tmp_path):
    rng = random.Random(3)
    rows = [(None, None, None, None), (None, 1, "user", "x"), (1, None, "user", "null turn."), (1, None, "user", "null turn."), (1, 5, "", "no role."),
            (2, 1, "system", None), (2, 2, "user", "\x0b \x1f"), (2, 2, "user", "tie?"), (2, 2, "assistant", "tie."), (3, -(2**63) + 9, "user", "a"), (3, 2**63 - 1, "assistant", "b"),
            (4, 1, "umpire", "kept by its initial."), (4, 2, "agent", "as well!"), (4, 3, "tool", "not.")]
    for c in range(10, 120):
        for t in range(rng.randrange(1, 9)):
            rows.append((c, t + rng.randrange(2), rng.choice(["user", "assistant", "system"] if t == 0 else ["user", "assistant"]),
                         rng.choice(["Same.", f"t{t}.", f"Long text {c} {t}", "", "a. \n", "漢字。", None])))
    rows += [(7, t, ("user", "assistant")[t % 2], f"turn {t}." if t % 9 else "turn") for t in range(400)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3, "text")
    df.withColumns({c: F.lit("clash") for c in ("conv", "times", "o1", "o2", "o3", "key", "place", "audit", "_kind", "_key", "no")}).write.parquet(
        f"{tmp_path}/conversations.parquet")
    got = Counter(tuple(r) for r in turns.op11_conversation_repair(spark, str(tmp_path)).collect())
    want = by_hand(rows)
    # conversations of which all rows were dropped
    nothing = {c for c, *_ in rows} - {w[0] for w in want}
    want.update((c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in nothing)
    assert got == Counter({(r[0], min(r[1], 2**63 - 1), *r[2:]): n for r, n in want.items()})
    empty = df.where("false")
    empty.write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert turns.op11_conversation_repair(spark, f"{tmp_path}/none").count() == 0


def test_repaired_turns(spark):
    rows = [(1, 1, "user", "Hi."), (1, 2, "user", "You there?"), (1, 3, "assistant", "Yes."), (2, 1, "assistant", "Alone.")]
    found, left = turns.repair_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert {r.conv: (r.cost, r.audit) for r in found.collect()} == {1: (2, "KIKK"), 2: (2, "IK")}
    assert {(r.conv, r.no): (r.role, r.text) for r in left.collect()} == {
        (1, 0): ("user", "Hi."), (1, 1): ("assistant", ""), (1, 2): ("user", "You there?"), (1, 3): ("assistant", "Yes."),
        (2, 0): ("user", ""), (2, 1): ("assistant", "Alone.")}
