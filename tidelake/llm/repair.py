"""Structure repair of conversations: cheapest edits by a square-root checkpointed DP.

Roles are to read ``(s?(ua)+)?`` (initials). States of that pattern: nothing
yet, behind s, behind u, behind a. Keeping a row costs 0 (its initial must
fit), giving it the role user or assistant 1, deleting it 2 (blank and
duplicate rows must go), inserting an empty turn of user or assistant 5, and
each truncated row that stays 5. Of all cheapest edits the ASCII-least list of
initials (D, I, K, R) is taken.

A row's cost vector says what the rest of the conversation costs from each
state. Vectors run backward, the choice of edits forward:

1. A conversation of n rows is cut in blocks of about sqrt(n) rows (at least
   BLOCK). Each block on its own gives the least costs from each state at its
   start to each at its end; the blocks of a conversation are at most sqrt(n),
   and their matrices, passed from the last to the first, leave the vectors at
   the checkpoints between blocks. Only these are stored.
2. Walking forward, a block's vectors are worked out again from the checkpoint
   at its end, and at each row the ASCII-least of the tight edits (those that
   lie on a cheapest way) is taken. Where a walk leaves a block is first found
   for all four states at once, so that blocks need not wait for each other.

Blocks are the groups that Spark deals out, so no task holds a conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelake.llm.common import prepare, stash
from tidelake.llm.ordered import TURN_ORDER, numbered, turn_keys

#: Rows of a block, but for conversations of more than BLOCK squared rows.
BLOCK = 256
NEVER = 1 << 60
SPACE = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)
#: What may follow in each state: the initial and the state behind it.
FOLLOWS = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
FINE, CUT_SHORT, MUST_GO = range(3)
#: The last vector: nothing left, or the inserts that end the pattern.
LAST = (0, 2 * INSERT, INSERT, 0)
Vector = tuple[int, int, int, int]


def _code(initial: str, fault: int) -> int:
    return 3 * ("sua".find(initial) + 1 if initial else 0) + fault


@lru_cache(None)
def _moves(code: int) -> tuple[tuple[tuple[str, int, int, str], ...], ...]:
    """For each state the edits that consume a row of that code: (letter, cost, state, role initial)."""
    initial, fault = " sua"[code // 3], code % 3
    out = []
    for state in range(4):
        moves = [("D", DELETE, state, "-")]
        if fault != MUST_GO:
            more = TRUNCATED if fault == CUT_SHORT else 0
            moves += [("K", KEEP + more, then, "k") for role, then in FOLLOWS[state].items() if role == initial]
            moves += [("R", REROLE + more, then, role) for role, then in FOLLOWS[state].items() if role != "s"]
        out.append(tuple(moves))
    return tuple(out)


_INSERTS = tuple(next((("I", INSERT, then, role) for role, then in FOLLOWS[s].items() if role != "s")) for s in range(4))


@lru_cache(1 << 16)
def _back(code: int, after: Vector) -> Vector:
    """The vector before a row, from the one after it: inserts, then an edit of the row."""
    cost = [min(c + after[then] for _, c, then, _ in moves) for moves in _moves(code)]
    for _ in range(3):  # more inserts than states never pay
        cost = [min(cost[s], c + cost[then]) for s, (_, c, then, _) in enumerate(_INSERTS)]
    return tuple(min(c, NEVER) for c in cost)


def back(code: int, after: Vector) -> Vector:
    least = min(after)
    return tuple(min(c + least, NEVER) for c in _back(code, tuple(c - least if c < NEVER else NEVER for c in after)))


def vectors(codes: list[int], end: Vector) -> list[Vector]:
    """The vectors before each row of a block and, last, behind it."""
    out = [tuple(end)]
    for code in reversed(codes):
        out.append(back(code, out[-1]))
    return out[::-1]


def matrix(codes: list[int]) -> list[int]:
    """Least costs from each state before a block to each behind it, row by row."""
    columns = [vectors(codes, tuple(0 if s == end else NEVER for s in range(4)))[0] for end in range(4)]
    return [columns[end][start] for start in range(4) for end in range(4)]


def walk(codes: list[int], ways: list[Vector], state: int) -> Iterator[tuple[str, str, int, int]]:
    """(letters, role initials, cost, state behind) of the ASCII-least tight edits before and of each row."""
    for k, code in enumerate(codes):
        letters, roles, cost = "", "", 0
        now, after = ways[k], ways[k + 1]
        while True:
            tight = [m for m in _moves(code)[state] if m[1] + after[m[2]] == now[state]]
            insert = _INSERTS[state]
            if insert[1] + now[insert[2]] == now[state]:
                tight.append(insert)
            letter, c, state, role = min(tight)
            letters, roles, cost = letters + letter, roles + role, cost + c
            if letter != "I":
                break
        yield letters, roles, cost, state


def closing(state: int) -> tuple[str, str, int]:
    """Inserts that end the pattern."""
    letters, roles, cost = "", "", 0
    while LAST[state]:
        letter, c, state, role = _INSERTS[state]
        letters, roles, cost = letters + letter, roles + role, cost + c
    return letters, roles, cost


def damaged(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with the test damage that crc32 of "conv_id:turn" mod 20 names:
    0 drops the row, 1 empties its text, 2 takes out its ``[.!?]``, 3 repeats it, 4 makes it a user's.
    Nulls of role and text become one space, in the key those of conv_id and turn too."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    rows = turns.select(F.col("conv_id").cast("long"), "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"),
                        (F.crc32(key.cast("binary")) % 20).alias("harm")).where("harm <> 0")
    text = (F.when(F.col("harm") == 1, F.lit("")).when(F.col("harm") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")))
    return rows.select("conv_id", "turn", F.when(F.col("harm") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"),
                       F.explode(F.when(F.col("harm") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, dict[str, list]]]:
    """Runs of rows of one conversation and block, in order: its first row and its columns."""
    key, held = None, None
    for batch in batches:
        rows = batch.to_pydict()
        for k in range(batch.num_rows):
            here = rows["conv_id"][k], rows["block"][k]
            if held is None or here != key:
                if held is not None:
                    yield {n: v[0] for n, v in held.items()}, held
                key, held = here, {n: [] for n in rows}
            for n, v in rows.items():
                held[n].append(v[k])
    if held is not None:
        yield {n: v[0] for n, v in held.items()}, held


def _batches(rows: Iterator[tuple], fields: list[tuple], size: int = 2000) -> Iterator[pa.RecordBatch]:
    out: list = []

    def batch():
        columns = list(zip(*out, strict=True)) or [()] * len(fields)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])

    for row in rows:
        out.append(row)
        if len(out) >= size:
            yield batch()
    yield batch()


_ID = [("conv_id", pa.int64()), ("block", pa.int64())]


def _by_block(rows: DataFrame) -> DataFrame:
    return rows.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "at")


def _same_block(left: DataFrame, right: DataFrame) -> DataFrame:
    right = right.withColumnsRenamed({"conv_id": "_conv", "block": "_block"})
    return left.join(right, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("block") == F.col("_block"))).drop("_conv", "_block")


def _checkpoints(rows: DataFrame) -> DataFrame:
    """(conv_id, block, ends, start, final) for each block of the rows (conv_id, block, at, code): the
    vector behind the block, the state before it and whether it is the conversation's last."""
    def matrices(batches):
        yield from _batches(((b["conv_id"], b["block"], matrix(held["code"])) for b, held in _blocks(batches)),
                            [*_ID, ("costs", pa.list_(pa.int64()))])

    def backward(batches):
        def run():
            conv, end, first = None, LAST, True
            for batch in batches:
                for here, block, costs in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "block", "costs")), strict=True):
                    final = first or here != conv
                    if final:
                        conv, end, first = here, LAST, False
                    yield here, block, list(end), final
                    end = tuple(min(min(costs[4 * s + e] + end[e] for e in range(4)), NEVER) for s in range(4))
        yield from _batches(run(), [*_ID, ("ends", pa.list_(pa.int64())), ("final", pa.bool_())])

    def leave(batches):
        def run():
            for b, held in _blocks(batches):
                ways, behind = vectors(held["code"], tuple(b["ends"])), []
                for state in range(4):
                    if ways[0][state] < NEVER:
                        for *_, state in walk(held["code"], ways, state):
                            pass
                    behind.append(state)
                yield b["conv_id"], b["block"], b["ends"], b["final"], behind
        yield from _batches(run(), [*_ID, ("ends", pa.list_(pa.int64())), ("final", pa.bool_()), ("behind", pa.list_(pa.int64()))])

    def forward(batches):
        def run():
            conv, state, first = None, START, True
            for batch in batches:
                for here, block, ends, final, behind in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "block", "ends", "final", "behind")), strict=True):
                    if first or here != conv:
                        conv, state, first = here, START, False
                    yield here, block, ends, final, state
                    state = behind[state]
        yield from _batches(run(), [*_ID, ("ends", pa.list_(pa.int64())), ("final", pa.bool_()), ("start", pa.int64())])

    ids, vector = "conv_id long, block long", "ends array<long>, final boolean"
    costs = stash(_by_block(rows).mapInArrow(matrices, f"{ids}, costs array<long>"), "repair-matrices")
    ends = stash(costs.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("block")).mapInArrow(backward, f"{ids}, {vector}"), "repair-ends")
    left = stash(_by_block(_same_block(rows, ends)).mapInArrow(leave, f"{ids}, {vector}, behind array<long>"), "repair-left")
    return left.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(forward, f"{ids}, {vector}, start long")


def repair(rows: DataFrame) -> DataFrame:
    """The cheapest edits of every row (conv_id, turn, role, text; none of role and text null).

    Returns conv_id, the columns of ``ordered.TURN_ORDER`` that name the row, ``at`` (its place in its
    conversation), fault (blank, duplicate, truncated or null), edits (inserts before the row, its own edit,
    behind the last row the closing inserts), roles (one initial for each edit: the inserted or new role,
    ``k`` for one that stays, ``-`` for a deleted row) and cost.

    Rows of a conversation are in the order of ``ordered.turn_keys``; a null conv_id is a conversation of its
    own. A row's first fault counts: blank (no character but white space, empty included), duplicate (role and
    text stood earlier), truncated (the last such character is none of ``.!?``). Repeated rows are duplicates,
    a text of any length is known by its digest, an empty table gives no rows, further columns are ignored.
    """
    prepare(rows.sparkSession)
    last = F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1))
    rows = numbered(
        rows.select("conv_id", "turn", "role", "text").select(
            "conv_id", *turn_keys(), (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("cut")),
        "conv_id", TURN_ORDER, "repair-rows")
    seen = (rows.where("not blank").groupBy(F.col("conv_id").alias("c"), F.col("d1").alias("s1"), F.col("d2").alias("s2"))
            .agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    longer = (rows.groupBy(F.col("conv_id").alias("l")).agg(F.max("at").alias("n")).where(F.col("n") > BLOCK)
              .select("l", F.greatest(F.lit(BLOCK), F.ceil(F.sqrt("n"))).cast("long").alias("block_rows")))
    fault = F.when(F.col("blank"), "blank").when(F.col("at") > F.col("first"), "duplicate").when(F.col("cut"), "truncated")
    initial = F.substring("role", 1, 1)
    code = (3 * F.coalesce(*[F.when(initial == c, k + 1) for k, c in enumerate("sua")], F.lit(0))
            + F.when(F.col("fault").isin("blank", "duplicate"), MUST_GO).when(F.col("fault") == "truncated", CUT_SHORT).otherwise(FINE))
    rows = (rows.join(seen, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("d1") == F.col("s1")) & (F.col("d2") == F.col("s2")), "left")
            .join(longer, F.col("conv_id").eqNullSafe(F.col("l")), "left")
            .withColumn("fault", fault)
            .select("conv_id", *TURN_ORDER, "at", "fault", code.cast("long").alias("code"), F.col("block_rows").isNotNull().alias("long"),
                    F.when(F.col("block_rows").isNotNull(), F.expr("(at - 1) div block_rows")).otherwise(F.lit(0)).cast("long").alias("block")))
    rows = stash(rows, "repair-faults")
    points = stash(_checkpoints(rows.where("long").select("conv_id", "block", "at", "code")), "repair-checkpoints")
    alone = rows.where("not long").select("*", F.lit(None).cast("array<long>").alias("ends"), F.lit(True).alias("final"), F.lit(START).cast("long").alias("start"))
    parts = alone.unionByName(_same_block(rows.where("long"), points))

    kept = ["conv_id", *TURN_ORDER, "at", "fault"]
    kinds = dict(rows.dtypes)
    turn = rows.schema["turn"].dataType

    def emit(batches):
        from pyspark.sql.pandas.types import to_arrow_type
        fields = [("conv_id", pa.int64()), ("turn", to_arrow_type(turn)), ("role", pa.string()), ("head", pa.string()), ("d1", pa.int64()),
                  ("d2", pa.int64()), ("at", pa.int64()), ("fault", pa.string()), ("edits", pa.string()), ("roles", pa.string()), ("cost", pa.int64())]

        def run():
            for b, held in _blocks(batches):
                codes = held["code"]
                ways = vectors(codes, tuple(b["ends"] or LAST))
                for k, (letters, roles, cost, state) in enumerate(walk(codes, ways, b["start"])):
                    if k == len(codes) - 1 and b["final"]:
                        more = closing(state)
                        letters, roles, cost = letters + more[0], roles + more[1], cost + more[2]
                    yield *(held[n][k] for n in kept), letters, roles, cost
        yield from _batches(run(), fields)

    return stash(_by_block(parts).mapInArrow(
        emit, ", ".join(f"{c} {kinds[c]}" for c in kept) + ", edits string, roles string, cost long"), "repair-edits")


_ROLE = {"u": "user", "a": "assistant"}


def _merged(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits and texts of each conversation in one task's stream: an edit that keeps its row, the text of that
    row (further copies of the same row follow and go), then the edits of rows that go."""
    plan = edits.select("conv_id", *TURN_ORDER, F.when(F.col("edits").rlike("[KR]"), 0).otherwise(2).alias("kind"), "at", "fault", "edits", "roles", "cost",
                        F.lit(None).cast("string").alias("text"))
    texts = rows.select("conv_id", "turn", "role", "text").select("conv_id", *turn_keys(), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("at"), F.lit(None).cast("string").alias("fault"),
                        F.lit(None).cast("string").alias("edits"), F.lit(None).cast("string").alias("roles"), F.lit(None).cast("long").alias("cost"), "text")
    return (plan.union(texts).repartition("conv_id").sortWithinPartitions("conv_id", *TURN_ORDER, "kind", "at")
            .select("conv_id", "role", "kind", "fault", "edits", "roles", "cost", "text"))


def _turns(batches: Iterator[pa.RecordBatch], begin, row, turn, end) -> Iterator:
    """Stream merged rows: ``begin(conv)`` and ``end()`` frame a conversation, ``row(edit row)`` sees each damaged
    row, ``turn(role, text)`` each repaired turn in order."""
    conv, started, waiting = None, False, None
    for batch in batches:
        columns = [batch.column(n).to_pylist() for n in ("conv_id", "role", "kind", "fault", "edits", "roles", "cost", "text")]
        for here, role, kind, fault, edits, roles, cost, text in zip(*columns, strict=True):
            if not started or here != conv:
                if started:
                    yield from end()
                conv, started, waiting = here, True, None
                begin(here)
            if kind == 1:
                if waiting is not None:
                    old, letters, named = waiting
                    waiting = None
                    for letter, new in zip(letters, named, strict=True):
                        if letter != "D":
                            yield from turn(old if new == "k" else _ROLE[new], text if letter in "KR" else "")
                continue
            row(role, fault, edits, cost)
            if kind == 0:
                waiting = role, edits, roles
            else:
                for letter, new in zip(edits, roles, strict=True):
                    if letter == "I":
                        yield from turn(_ROLE[new], "")
    if started:
        yield from end()


def repaired_turns(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, place (from 1), role, text."""
    def run(batches):
        at: dict = {}

        def begin(conv):
            at.update(conv=conv, place=0)

        def turn(role, text):
            at["place"] += 1
            yield at["conv"], at["place"], role, text

        yield from _batches(_turns(batches, begin, lambda *_: None, turn, lambda: ()), [
            ("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())], 200)

    return _merged(rows, edits).mapInArrow(run, "conv_id long, place long, role string, text string")


def report(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """One row for each conversation with rows: counts of faults and of illegal neighbours, cost, the edits'
    initials, and the digest of the repaired ``role:text``, joined by newlines. A task streams over a
    conversation (a digest has to see it in order) and holds one text at a time."""
    def run(batches):
        now: dict = {}

        def begin(conv):
            now.update(conv=conv, blank=0, duplicate=0, truncated=0, illegal=0, cost=0, audit=[], sha=hashlib.sha256(), turns=0, before=None)

        def row(role, fault, edits, cost):
            if fault:
                now[fault] += 1
            if now["before"] is not None and now["before"] + role[:1] not in ("su", "ua", "au"):
                now["illegal"] += 1
            now["before"] = role[:1]
            now["cost"] += cost
            now["audit"].append(edits)

        def turn(role, text):
            now["sha"].update(("\n" * (now["turns"] > 0) + f"{role}:{text}").encode())
            now["turns"] += 1
            return ()

        def end():
            yield (*(now[n] for n in ("conv", "blank", "duplicate", "truncated", "illegal", "cost")), "".join(now["audit"]), now["sha"].hexdigest())

        yield from _batches(_turns(batches, begin, row, turn, end), [
            ("conv_id", pa.int64()), *((n, pa.int64()) for n in ("blank", "duplicate", "truncated", "illegal", "cost")),
            ("audit", pa.string()), ("repaired_sha256", pa.string())])

    return _merged(rows, edits).mapInArrow(
        run, "conv_id long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


def damage_report(turns: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of every conversation
    of ``turns`` after ``damaged``. gaps: turn numbers missing between the least and the greatest (nulls aside).
    A conversation that lost all its rows has zeros, no edits and the digest of the empty text."""
    rows = damaged(turns)
    edits = repair(rows)
    gaps = edits.groupBy(F.col("conv_id").alias("g")).agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"))
    said = report(rows, edits).withColumnRenamed("conv_id", "r")
    out = (turns.select(F.col("conv_id").cast("long")).distinct()
           .join(gaps, F.col("conv_id").eqNullSafe(F.col("g")), "left").join(said, F.col("conv_id").eqNullSafe(F.col("r")), "left"))
    numbers = [F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
