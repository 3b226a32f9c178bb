"""Conversation repair against a search over single edits, and on odd tables."""

import hashlib
import heapq
import random
import re
import zlib

from inkwell.llm import repair
from inkwell.llm.queries import op12_repair

SCHEMA = "conv_id long, turn long, role string, text string, piece int, audit string"
WHITE = " \t\n\x0b\x0c\r"


def cheapest(symbols):
    """(cost, audit) by Dijkstra's search over (rows read, state), edit by edit; ties by the audit."""
    todo, done = [(0, "", 0, repair.START)], set()
    while todo:
        cost, audit, at, state = heapq.heappop(todo)
        if at == len(symbols) and state in (repair.START, repair.ASSISTANT):
            return cost, audit
        if (at, state) in done:
            continue
        done.add((at, state))
        after = repair.ASSISTANT if state == repair.USER else repair.USER
        heapq.heappush(todo, (cost + 3, audit + "I", at, after))
        if at < len(symbols):
            c, extra = symbols[at].lower(), 3 * symbols[at].isupper()
            heapq.heappush(todo, (cost + 4, audit + "D", at + 1, state))
            if c != "x":
                heapq.heappush(todo, (cost + 3 + extra, audit + "R", at + 1, after))
                if c == "s" and state == repair.START:
                    heapq.heappush(todo, (cost + extra, audit + "K", at + 1, repair.SYSTEM))
                if (c == "u" and state != repair.USER) or (c == "a" and state == repair.USER):
                    heapq.heappush(todo, (cost + extra, audit + "K", at + 1, after))


def test_audits_equal_a_search():
    r = random.Random(3)
    sequences = ["".join(r.choice("xsuaoSUAO" if k % 2 else "uaua" "x") for _ in range(r.randrange(12 if k % 3 else 60))) for k in range(900)]
    grammar = repair.Grammar()
    found = grammar.audits(sequences[:500]) | grammar.audits(sequences[500:])
    assert grammar.rules
    for s in sequences:
        cost, audit = cheapest(s)
        assert found[s] == audit, s
        assert repair.edited([(None, "", "")] * len(s), s, audit, repair.START)[1] == cost
        roles = "".join(x["role"][:1] for x in repair.edited([(None, c.lower(), "") for c in s], s, audit, repair.START)[0])
        assert re.fullmatch("(s?(ua)+)?", roles)


def test_ropes_compare_as_strings():
    r = random.Random(4)
    ropes = [repair.Rope(r.choice(["", "D", "K", "KK", "KD" * 20])) for _ in range(20)]
    for _ in range(300):
        ropes.append(r.choice(ropes[-12:]) + r.choice(ropes[-12:]))
    for _ in range(3000):
        a, b = r.choice(ropes[:120]), r.choice(ropes[:120])
        assert (a < b) == (str(a) < str(b)) and a.size == len(str(a))


def test_a_pair_that_repeats_becomes_a_rule():
    grammar = repair.Grammar()
    packed = grammar.compress(["uauauaua", "uauaua", "xxxxx"])
    assert max(map(len, packed)) < 5
    pairs = [p for s in packed for p in zip(s, s[1:])]
    assert len(pairs) == len(set(pairs))


def by_hand(rows):
    """The contract, a conversation at a time."""
    out = {}
    conversations = {}
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        mine = conversations.setdefault(c, [])
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        mine += [] if fault == 0 else [(t, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    for c, mine in conversations.items():
        mine.sort(key=lambda x: (x[0] is not None, x[0] or 0))
        seen, symbols, counts = set(), "", {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in mine:
            body = text.strip(WHITE)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            letter = role[:1] if role[:1] in ("s", "u", "a") else "o"
            symbols += "x" if fault in ("blank", "duplicate") else letter.upper() if fault else letter
        cost, audit = cheapest(symbols)
        kept = repair.edited(mine, symbols, audit, repair.START)[0]
        turns = [t for t, _, _ in mine if t is not None]
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(mine, mine[1:])]
        out[c] = counts | {
            "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, "illegal": sum(p not in ("su", "ua", "au") for p in pairs), "cost": cost, "audit": audit,
            "repaired_sha256": hashlib.sha256("\n".join(f"{k['role']}:{k['text']}" for k in kept).encode()).hexdigest(),
        }
    return out


def conversations(n_long):
    r = random.Random(9)
    rows = [(c, t * r.choice([1, 1, 2]) + 100 * t, r.choice(["user", "assistant", "system", "tool", ""]) if r.random() < 0.3 else ("user", "assistant")[t % 2], r.choice(["Hi.", "So?", "and then", "", " \t", "One! "]) + str(r.randrange(4))) for c in range(60) for t in range(r.randrange(1, 9))]
    rows += [(99, t, ("user", "assistant")[t % 2], r.choice(["Yes.", f"{t} goes."])) for t in range(n_long)]
    return rows + [(500, None, "user", "No turn."), (500, 3, None, None), (None, 1, "user", "Whose?"), (None, 2, "assistant", "Nobody's.")]


def check(got, rows):
    expected = by_hand(rows)
    assert len(got) == len(expected)
    for row in got:
        assert {k: row[k] for k in expected[row.conv_id]} == expected[row.conv_id], row.conv_id


def test_repair(spark, tmp_path):
    rows = conversations(40)
    spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    check(op12_repair(spark, f"file://{tmp_path}").collect(), rows)


def test_conversations_over_many_pieces(spark):
    rows = conversations(900)
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(5)
    repaired = repair.repair_conversations(repair.damaged(table), piece_rows=7)
    assert repaired.where("conv_id = 99").count() > 90
    check(repair.repair_digests(repaired).collect(), rows)


def test_nothing_to_repair(spark):
    assert repair.repair_digests(repair.repair_conversations(repair.damaged(spark.createDataFrame([], SCHEMA)))).count() == 0
    dropped = next((c, t) for c in range(99) for t in range(99) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    row = repair.repair_digests(repair.repair_conversations(repair.damaged(spark.createDataFrame([(*dropped, "user", "Gone.", 1, "x")], SCHEMA)))).first()
    assert (row.gaps, row.blank, row.illegal, row.cost, row.audit, row.repaired_sha256) == (0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
