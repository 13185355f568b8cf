import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import pytest

from tidelake.llm import queries, repair

SCHEMA = "conv_id long, turn long, role string, text string, cost string"
NEXT = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}


def order(row):
    return row[0] is not None, row[0] or 0, row[1], row[2]


def cheapest(rows, faults):
    """(cost, audit, roles) by plain recursion over all edits from each row and state."""
    @lru_cache(None)
    def best(k, state, inserted):
        ways = []
        if k == len(rows) and state in ("", "a"):
            ways.append((0, "", ()))
        if inserted < 3:
            for role, name in (("u", "user"), ("a", "assistant")):
                if role in NEXT[state]:
                    c, audit, out = best(k, NEXT[state][role], inserted + 1)
                    ways.append((c + 5, "I" + audit, ((name, None), *out)))
        if k < len(rows):
            role, fault = rows[k][1], faults[k]
            c, audit, out = best(k + 1, state, 0)
            ways.append((c + 2, "D" + audit, out))
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                if role[:1] in NEXT[state]:
                    c, audit, out = best(k + 1, NEXT[state][role[:1]], 0)
                    ways.append((c + more, "K" + audit, ((role, k), *out)))
                for new in ("user", "assistant"):
                    if new[0] in NEXT[state]:
                        c, audit, out = best(k + 1, NEXT[state][new[0]], 0)
                        ways.append((c + more + 1, "R" + audit, ((new, k), *out)))
        return min(ways) if ways else (1 << 40, "~", ())
    for k in range(len(rows), 0, -1):  # from the back, so that no call goes deep
        for state in NEXT:
            best(k, state, 0)
    return best(0, "", 0)


def brute_report(rows):
    rows = sorted(rows, key=order)
    faults, seen = [], set()
    for _, role, text in rows:
        solid = re.sub(r"[\x20\x09-\x0D]", "", text)
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None)
        seen.add((role, text))
    cost, audit, out = cheapest(tuple(rows), tuple(faults))
    turns = [t for t, _, _ in rows if t is not None]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    repaired = "\n".join(f"{role}:{'' if k is None else rows[k][2]}" for role, k in out)
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(repaired.encode()).hexdigest())


def brute(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        own = convs[c]
        harm = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if harm:
            text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
            own += [(turn, "user" if harm == 4 else role, text)] * (2 if harm == 3 else 1)
    return {c: brute_report(own) for c, own in convs.items()}


def got(df):
    rows = df.collect()
    out = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in rows}
    assert len(out) == len(rows)
    return out


def some_rows(seed, convs=60, longest=12):
    rnd = random.Random(seed)
    rows = []
    for c in range(convs):
        for k in range(rnd.randint(1, longest)):
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""])
            text = rnd.choice(["Yes.", "No!", "Why?", "cut off", " \t", "", None, f"own {k}.", f"open {k}", "same. \n", "é漢.", "a.\x1c"])
            rows.append((c, rnd.choice([k, k, k, k + 3, None]), role, text))
    return rows


EDGE = [(None, 1, "user", "No conversation."), (None, 2, "assistant", "None."), (500, None, None, None), (501, 0, "user", "Long. " * 40000),
        (501, 1, "assistant", "Fine."), (502, 3, "user", "w" * 50 + "."), (502, 4, "assistant", "w" * 50 + ".")]


def test_edge_cases(spark):
    rows = some_rows(3) + EDGE
    df = spark.createDataFrame([(*r, "mine") for r in rows], SCHEMA).repartition(3, "text")
    assert got(repair.damage_report(df)) == brute(rows)
    assert repair.damage_report(df.where("false")).count() == 0


def test_a_conversation_of_many_blocks(spark, monkeypatch):
    """Checkpoints between blocks: long conversations beside short ones, tiny blocks."""
    monkeypatch.setattr(repair, "BLOCK", 3)
    rnd = random.Random(8)
    rows = some_rows(4, convs=15, longest=40)
    rows += [(900, k, rnd.choice(["user", "assistant", "system"]), rnd.choice([f"t{k}.", f"t{k}", "again."])) for k in range(300)]
    rows += [(None, k, rnd.choice(["user", "assistant"]), f"n{k}.") for k in range(20)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    assert got(repair.damage_report(df)) == brute(rows)


def test_repaired_turns(spark):
    rows = [(1, "user", "Hi."), (2, "user", "Hello."), (3, "assistant", "cut"), (4, "assistant", "Fine."), (5, "user", "Bye."), (5, "user", "Bye.")]
    df = spark.createDataFrame([(7, *r) for r in rows], "conv_id long, turn long, role string, text string")
    edits = repair.repair(df)
    out = [(r.role, r.text) for r in sorted(repair.repaired_turns(df, edits).collect(), key=lambda r: r.place)]
    _, audit, want = cheapest(tuple(rows), (None, None, "truncated", None, None, "duplicate"))
    assert "".join(r.edits for r in sorted(edits.collect(), key=lambda r: r["at"])) == audit
    assert out == [(role, "" if k is None else rows[k][2]) for role, k in want]
    assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in out))


@pytest.mark.parametrize("seed", range(5))
def test_walk_over_blocks_is_the_walk_over_all(seed):
    rnd = random.Random(seed)
    codes = [rnd.randrange(12) for _ in range(90)]
    ways = repair.vectors(codes, repair.LAST)
    whole = list(repair.walk(codes, ways, repair.START))
    ends = [repair.LAST]
    blocks = [codes[k:k + 10] for k in range(0, 90, 10)]
    for b in reversed(blocks):
        m = repair.matrix(b)
        ends.append(tuple(min(m[4 * s + e] + ends[-1][e] for e in range(4)) for s in range(4)))
    ends.reverse()
    assert list(ends[0]) == list(ways[0])
    state, parts = repair.START, []
    for b, end in zip(blocks, ends[1:], strict=True):
        parts += list(repair.walk(b, repair.vectors(b, end), state))
        state = parts[-1][3]
    assert parts == whole


def test_query(spark, small_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{small_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(queries.op13_conversation_repair(spark, small_dir)) == brute(rows)
