"""Conversation repair against a search over whole audit strings."""

import hashlib
import random
import zlib
from functools import cache

import pytest

from parlance.llm import structure_repair as sr

SPACE = " \t\n\x0b\x0c\r"
NEXT = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}


def faults_of(rows):
    seen, out = set(), []
    for role, text in rows:
        kind = "blank" if not text.strip(SPACE) else "duplicate" if (role, text) in seen else None if text.strip(SPACE)[-1] in ".!?" else "truncated"
        seen.add((role, text))
        out.append(kind)
    return out


def by_strings(rows):
    """(cost, audit, repaired lines): every edit by itself, from the end, least cost and then least string."""
    faults = faults_of(rows)

    @cache
    def best(i, state, inserted):
        out = []
        if i == len(rows):
            if state in (0, 3):
                out.append((0, "", ()))
        else:
            (role, text), more = rows[i], int(faults[i] == "truncated")
            cost, audit, lines = best(i + 1, state, 0)
            out.append((cost + 3, "D" + audit, lines))
            if faults[i] not in ("blank", "duplicate"):
                for op, name, price in (("K", role, 0), ("R", "user", 2), ("R", "assistant", 2)):
                    if (to := NEXT.get((name[:1], state))) is not None:
                        cost, audit, lines = best(i + 1, to, 0)
                        out.append((cost + price + more, op + audit, (f"{name}:{text}", *lines)))
        if inserted < 3:
            for name in ("user", "assistant"):
                if (to := NEXT.get((name[:1], state))) is not None:
                    cost, audit, lines = best(i, to, inserted + 1)
                    out.append((cost + 2, "I" + audit, (f"{name}:", *lines)))
        return min(out, default=(10**9, "", ()))

    return best(0, 0, 0)


@pytest.mark.parametrize("settle_every", [1, 3, 64])
def test_search_is_exact_and_settles(monkeypatch, settle_every):
    monkeypatch.setattr(sr, "SETTLE_EVERY", settle_every)
    rng = random.Random(settle_every)
    for trial in range(700):
        n = 120 if trial % 100 == 0 else rng.randint(0, 9)
        word = lambda: rng.choice(["", "  ", "a.", "b", "c! \n", f"d{rng.randint(0, 99)}" + rng.choice(".x")])
        rows = [(rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", "s", "Assistant"]), word()) for _ in range(n)]
        search, edits = sr._Conversation(), []
        for role, text in rows:
            edits += search.add(1, role, text)
        if n == 120 and settle_every < 64:
            assert len(search.rows) < 60  # what all ways have in common has left
        edits = [e for e in [*edits, *search.finish()] if e[1]]
        cost = sum(sr.COST[e[1]] + (e[6] == "truncated" and e[1] != "D") for e in edits)
        assert (cost, "".join(e[1] for e in edits), tuple(f"{e[2]}:{e[3]}" for e in edits if e[1] != "D")) == by_strings(rows)


def by_hand(rows):
    """The digest's columns for one conversation's rows (conv_id, turn, role, text)."""
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = {1: "", 2: "".join(c for c in text if c not in ".!?")}.get(kind, text)
        out += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    said = [(r, t) for _, r, t in out]
    faults, turns = faults_of(said), {t for t, _, _ in out if t is not None}
    cost, audit, lines = by_strings(tuple(said))
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(said, said[1:]))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return (gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def test_digest_of_damaged_conversations(spark):
    rng = random.Random(9)
    rows = []
    for conv in range(300):
        for turn in rng.sample(range(12), rng.randint(0, 9)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", None, ""]), rng.choice(["Yes.", "no", "Ü! ", None, "", "a\nb?", "x" * 5000])))
    rows += [(400, None, "user", "hi."), (400, None, None, None), (400, 3, "assistant", "ok."), (None, 0, "user", "hi."), (None, 1, "assistant", "ok")] + [(401, 0, "user", "again.")] * 300
    dropped = next(c for c in range(1000, 9999) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((dropped, 0, "user", "gone"))
    frame = spark.createDataFrame([(*r, "own") for r in rows], "conv_id long, turn long, role string, text string, fault string")
    got = {r.conv_id: r for r in sr.repair_digest(frame).collect()}
    ids = {r[0] for r in rows}
    assert set(got) == ids and len(got) == sr.repair_digest(frame).count()
    for conv in ids:
        assert tuple(got[conv])[1:] == by_hand([r for r in rows if r[0] == conv])
    assert got[dropped].cost == 0 and got[dropped].audit == "" and got[dropped].repaired_sha256 == hashlib.sha256(b"").hexdigest()
    assert sr.repair_digest(frame.limit(0)).collect() == []


def test_repaired_conversations_alternate(spark):
    rows = [(1, 0, "system", "Be brief."), (1, 1, "assistant", "Hello."), (1, 2, "assistant", "Again."), (1, 3, "user", "")]
    edits = sr.repair(sr.undamaged(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string"))).orderBy("place").collect()
    assert [(e.edit, e.role) for e in edits] == [("K", "system"), ("I", "user"), ("K", "assistant"), ("I", "user"), ("K", "assistant"), ("D", None)] or sum(sr.COST[e.edit] for e in edits) == by_strings(tuple((r[2], r[3]) for r in rows))[0]
    assert edits[-1].fault == "blank" and edits[-1].was_role == "user"


def test_a_long_conversation_goes_by_as_a_stream(spark):
    rows = spark.range(40_000).selectExpr("7L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "concat('turn ', id, '.') as text")
    r = sr.repair_digest(rows).collect()
    assert len(r) == 1 and len(r[0].audit) >= 38_000 and r[0].blank > 1000 and r[0].gaps > 1000
