"""Repair of conversation structure at least cost, by divide and conquer in linear space (Hirschberg).

A repaired conversation has an optional system row first, then user and assistant in turn. Reading its role initials takes four states
(nothing yet, system, user, assistant), so what a row does to a conversation is a ``Step``: the least cost from every state to every state,
and how the edits behind these costs are ordered. Steps of neighbours compose to one. A row's edits are its inserts and then what happens
to the row itself, so all audits of the same rows have equally many final letters, none begins another, and audits can be compared by their order up to any border.

``crossings`` runs cost vectors forward from the front and backward from the end to the middle, takes the cheapest state there (of equally cheap
ones that with the least audit in front) and goes on in both halves: no table of rows times states is kept.

On Spark, rows are sorted by conversation and turn over ranges, so one conversation may lie in many tasks. A conversation that ends in the task where it begins
is solved there. Others are cut into blocks of bounded rows and text; their steps are composed upwards in groups of FAN, crossings between them are
chosen downwards, and then each block is solved between its own two states. The digest of a conversation over several blocks is the one
thing that SHA-256 makes sequential: it streams over the blocks' repaired texts and holds one at a time.

Defined results: a null in any column reads as one space, so a row without text is blank and a null ``conv_id`` is a conversation of its own; a null turn is no turn in
``gaps``; rows of one turn stand by role and then by the SHA-256 of role and text, so equal rows stand side by side; a role that is empty or whose initial isn't s, u or a can't be kept; empty
conversations have zeros; an empty table gives no rows. Only the four named columns are read, so others can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkstave.session import drop_stored, stored

NOTHING, SYSTEM, USER, ASSISTANT = STATES = range(4)
INITIALS = "sua"
BLANK, DUPLICATE, TRUNCATED, SOUND = range(4)
NEVER = float("inf")
KEEP, REROLE, DELETE, INSERT, CUT_SHORT = 0, 2, 3, 2, 1
#: A block ends at this many rows, or characters of text.
BLOCK_ROWS, BLOCK_CHARS = 1 << 12, 1 << 22
#: Blocks composed at once.
FAN = 64
SPACE = r"[\x20\x09-\x0D]"
BROADCAST_BYTES = 8 << 20

Step = tuple[tuple[float, ...], tuple[int, ...]]  # costs and orders, at 4 * from + to


def _after(state: int, initial: str) -> int | None:
    """The state after a role, None where it can't stand."""
    if initial == "s":
        return SYSTEM if state == NOTHING else None
    if initial == "u":
        return USER if state != USER else None
    return ASSISTANT if initial == "a" and state == USER else None


def _forced(state: int) -> int:
    """The state after an inserted row or one given a new role: only one of user and assistant can stand."""
    return ASSISTANT if state == USER else USER


def _row_edits(kind: int) -> dict[tuple[int, int], tuple[float, str]]:
    """For a kind of row, the cheapest edits (then the least letters) from state to state: inserts, then the row's own."""
    fault, initial = divmod(kind, 4)
    cut = CUT_SHORT if fault == TRUNCATED else 0
    best: dict[tuple[int, int], tuple[float, str]] = {}
    for state in STATES:
        at = state
        for inserts in range(3):  # three lead to the state of one
            own = [(at, DELETE, "D")]
            if fault in (TRUNCATED, SOUND):
                own.append((_forced(at), REROLE + cut, "R"))
                if initial < 3 and (to := _after(at, INITIALS[initial])) is not None:
                    own.append((to, KEEP + cut, "K"))
            for to, cost, letter in own:
                best[state, to] = min(best.get((state, to), (NEVER, "")), (inserts * INSERT + cost, "I" * inserts + letter))
            at = _forced(at)
    return best


def _step(edits: dict[tuple[int, int], tuple[float, str]]) -> Step:
    order = [sorted(letters for (p, _), (_, letters) in edits.items() if p == first) for first in STATES]
    costs = tuple(edits.get((p, s), (NEVER, ""))[0] for p in STATES for s in STATES)
    return costs, tuple(order[p].index(edits[p, s][1]) if (p, s) in edits else 9 for p in STATES for s in STATES)


EDITS = [_row_edits(kind) for kind in range(16)]
STEPS = [_step(edits) for edits in EDITS]
#: What is inserted behind the last row of a conversation that ends in each state, and its cost.
ENDS = ("", "II", "I", "")
END_COSTS = tuple(float(INSERT * len(x)) for x in ENDS)
IDENTITY: Step = (tuple(0.0 if p == s else NEVER for p in STATES for s in STATES), tuple(0 if p == s else 9 for p in STATES for s in STATES))

Vector = tuple[tuple[float, ...], tuple[int, ...]]  # cost and order of the audit so far, by state


def _only(state: int) -> Vector:
    return tuple(0.0 if s == state else NEVER for s in STATES), tuple(0 if s == state else 9 for s in STATES)


def _forward(vector: Vector, step: Step) -> Vector:
    """Costs one step later (the least is taken off), audits in order."""
    costs, order = vector
    found = []
    for s in STATES:
        cost, before, p = min((costs[p] + step[0][4 * p + s], order[p], p) for p in STATES)
        found.append((cost, before, step[1][4 * p + s]))
    least = min(c for c, _, _ in found)
    ranks = sorted(x[1:] for x in found if x[0] < NEVER)
    return tuple(c - least for c, _, _ in found), tuple(ranks.index(x[1:]) if x[0] < NEVER else 9 for x in found)


def _backward(costs: tuple[float, ...], step: Step) -> tuple[float, ...]:
    """Costs to the end one step earlier (the least is taken off)."""
    found = [min(step[0][4 * p + s] + costs[s] for s in STATES) for p in STATES]
    least = min(found)
    return tuple(c - least for c in found)


#: What steps of rows lead to, by (state of the search, kind of row): few differ. Plain tables, as functions travel to executors by value.
AHEAD: dict[tuple[Vector, int], Vector] = {}
BEHIND: dict[tuple[tuple[float, ...], int], tuple[float, ...]] = {}
MOST_KNOWN = 1 << 16


def _row_forward(vector: Vector, kind: int) -> Vector:
    found = AHEAD.get((vector, kind))
    if found is None:
        if len(AHEAD) >= MOST_KNOWN:
            AHEAD.clear()
        found = AHEAD[vector, kind] = _forward(vector, STEPS[kind])
    return found


def _row_backward(costs: tuple[float, ...], kind: int) -> tuple[float, ...]:
    found = BEHIND.get((costs, kind))
    if found is None:
        if len(BEHIND) >= MOST_KNOWN:
            BEHIND.clear()
        found = BEHIND[costs, kind] = _backward(costs, STEPS[kind])
    return found


def crossings(steps: Sequence, first: int, end: tuple[float, ...], forward: Callable = _row_forward, backward: Callable = _row_backward) -> list[int]:
    """The states at all borders of the cheapest way through ``steps`` whose audit is least: from ``first``, ending at the costs ``end``."""
    states = [first] * (len(steps) + 1)
    todo = [(0, len(steps), end)]
    while todo:
        low, high, end = todo.pop()
        if low == high:
            continue
        middle = (low + high + 1) // 2  # of one step the border behind it
        ahead = _only(states[low])
        for k in range(low, middle):
            ahead = forward(ahead, steps[k])
        behind = end
        for k in range(high - 1, middle - 1, -1):
            behind = backward(behind, steps[k])
        states[middle] = min(STATES, key=lambda s: (ahead[0][s] + behind[s], ahead[1][s]))
        if middle < high:  # the right half starts from the state that is now known
            todo.append((middle, high, end))
        if middle - low > 1:
            todo.append((low, middle, _only(states[middle])[0]))
    return states


def composed(steps: Sequence, forward: Callable = _row_forward, cost: Callable = lambda kind: STEPS[kind]) -> Step:
    """One step for several."""
    costs: list[float] = []
    orders: list[int] = []
    for first in STATES:
        vector, base = _only(first), 0.0
        for k in steps:
            step = cost(k)
            base += min(vector[0][p] + step[0][4 * p + s] for p in STATES for s in STATES)
            vector = forward(vector, k)
        costs += [c + base for c in vector[0]]
        orders += vector[1]
    return tuple(costs), tuple(orders)


def repaired(kinds: Sequence[int], roles: Sequence[str], texts: Sequence[str], first: int = NOTHING, last: int | None = None) -> tuple[int, str, list[str]]:
    """Cost, audit and ``role:text`` rows of a conversation, or of a block of one between two states."""
    states = crossings(kinds, first, END_COSTS if last is None else _only(last)[0])
    audit, cost, rows = [], 0.0, []
    for k, (p, s) in enumerate(zip(states[:-1], states[1:], strict=True)):
        own, letters = EDITS[kinds[k]][p, s]
        cost += own
        audit.append(letters)
        for letter in letters:
            p = p if letter in "DK" else _forced(p)
            if letter != "D":
                role = roles[k] if letter == "K" else "user" if p == USER else "assistant"
                rows.append(f"{role}:{'' if letter == 'I' else texts[k]}")
    if last is None:
        p = states[-1]
        for _ in ENDS[p]:
            p = _forced(p)
            rows.append("user:" if p == USER else "assistant:")
        audit.append(ENDS[states[-1]])
        cost += END_COSTS[states[-1]]
    return int(cost), "".join(audit), rows


def damaged(rows: DataFrame) -> DataFrame:
    """Rows after the damage, as conv (text), turn, role, text, fault (without duplicates), with their digest and number; dropped ones stay as marks (``gone``).

    To be written before use: the numbers hold only once they are stored.
    """
    space = F.lit(" ")
    label = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")])
    hurt = (F.crc32(label) % 20).alias("hurt")
    conv = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    out = rows.select(conv.alias("conv"), F.col("turn").cast("bigint").alias("turn"), *[F.coalesce(F.col(c), space).alias(c) for c in ("role", "text")], hurt)
    text = F.when(F.col("hurt") <= 1, "").when(F.col("hurt") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    out = out.withColumn("text", text).withColumn("role", F.when(F.col("hurt") == 0, "").when(F.col("hurt") == 4, "user").otherwise(F.col("role")))
    out = out.select("*", F.explode(F.when(F.col("hurt") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    fault = F.when(~F.col("text").rlike(SPACE.replace("[", "[^")), BLANK).when(~F.col("text").rlike(rf"[.!?]{SPACE}*\z"), TRUNCATED).otherwise(SOUND)
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    return out.select("conv", "turn", "role", "text", (F.col("hurt") == 0).alias("gone"), fault.alias("fault"), digest.alias("digest"), F.monotonically_increasing_id().alias("number"))


def small_side(side: DataFrame, width: int) -> DataFrame:
    """A written side of a join with rows of at most ``width`` bytes, marked for broadcast if all of it is small."""
    return F.broadcast(side) if side.count() * width <= BROADCAST_BYTES else side.hint("merge")


def with_kinds(rows: DataFrame) -> DataFrame:
    """``kind``: a row's first fault, duplicates now too, and its role's initial, as one number; -1 for marks."""
    place = F.struct(F.col("turn").isNotNull(), F.col("turn"), F.col("number"))
    seen = rows.filter(~F.col("gone") & (F.col("fault") != BLANK)).groupBy("conv", "digest").agg(F.count("*").alias("n"), F.min(place).alias("first"))
    # Written first, so that a hot text on the other side of the join can be split.
    again = stored(seen.filter("n > 1").select("conv", "digest", F.col("first.number").alias("first")), "repeated")
    joined = rows.join(small_side(again, 128), ["conv", "digest"], "left")
    fault = F.when((F.col("fault") != BLANK) & (F.col("first") != F.col("number")), DUPLICATE).otherwise(F.col("fault"))
    initial = F.coalesce(F.nullif(F.instr(F.lit(INITIALS), F.substring("role", 1, 1)), F.lit(0)) - 1, F.lit(3))
    initial = F.when(F.col("role") == "", 3).otherwise(initial)  # an empty string is found at 1
    return joined.select("conv", "turn", "role", "text", "digest", "number", F.when(F.col("gone"), -1).otherwise(fault * 4 + initial).cast("int").alias("kind"))


COUNTS = ["n_rows", "blank", "duplicate", "truncated", "illegal", "turns"]
SUMMARY = ", ".join(f"{c} bigint" for c in COUNTS) + ", least bigint, most bigint, head string, tail string, head_turn bigint, tail_turn bigint, costs array<double>, orders array<int>"
PARTS = f"conv string, part int, block int, at int, kind int, role string, text string, cost bigint, audit string, sha string, {SUMMARY}"
SUMMARY_NAMES = [c.split()[0] for c in SUMMARY.split(", ")]


def _illegal(a: str, b: str) -> bool:
    return a[:1] + b[:1] not in ("su", "ua", "au")


class Summary:
    """What a run of a conversation's rows tells its neighbours: counts, what stands at both ends, and its step."""

    def __init__(self, counts: list[int], turns: tuple, ends: tuple, step: Step):
        self.counts, self.turns, self.ends, self.step = counts, turns, ends, step

    @classmethod
    def of(cls, kinds: list[int], roles: list[str], turns: list[int | None]) -> Summary:
        known = [t for t in turns if t is not None]
        faults = [k // 4 for k in kinds]
        illegal = sum(map(_illegal, roles, roles[1:]))
        counts = [len(kinds), *[faults.count(f) for f in (BLANK, DUPLICATE, TRUNCATED)], illegal, sum(a != b for a, b in zip(known, [None, *known], strict=False))]
        span = (known[0], known[-1], known[0], known[-1]) if known else (None,) * 4  # sorted, so the ends are the least and the most
        return cls(counts, span, (roles[0][:1], roles[-1][:1]) if roles else (None, None), composed(kinds))

    @classmethod
    def read(cls, row) -> Summary:
        whole = lambda x: None if x is None or x != x else int(x)
        return cls(
            [int(row[c]) for c in COUNTS], tuple(whole(row[c]) for c in ("least", "most", "head_turn", "tail_turn")), (row["head"], row["tail"]), (tuple(row["costs"]), tuple(row["orders"]))
        )

    def __add__(self, other: Summary) -> Summary:
        if not other.counts[0] or not self.counts[0]:
            return self if self.counts[0] else other
        counts = [a + b for a, b in zip(self.counts, other.counts, strict=True)]
        counts[4] += _illegal(self.ends[1], other.ends[0])
        a, b = self.turns, other.turns
        counts[5] -= a[3] is not None and a[3] == b[2]
        turns = b if a[0] is None else a if b[0] is None else (a[0], b[1], a[2], b[3])
        step = composed([self.step, other.step], _forward, lambda s: s)
        return Summary(counts, turns, (self.ends[0], other.ends[1]), step)

    def row(self) -> dict:
        least, most, head_turn, tail_turn = self.turns
        ends = {"least": least, "most": most, "head": self.ends[0], "tail": self.ends[1], "head_turn": head_turn, "tail_turn": tail_turn}
        return dict(zip(COUNTS, self.counts, strict=True)) | ends | {"costs": list(self.step[0]), "orders": list(self.step[1])}


def _frame(rows: list[dict], schema: str) -> pd.DataFrame:
    """Rows as a frame whose whole numbers may be null."""
    kinds = dict(c.split() for c in schema.split(", "))
    out = pd.DataFrame({c: pd.Series([row.get(c) for row in rows], dtype="Int64" if kind in ("int", "bigint") else object) for c, kind in kinds.items()})
    return out


def solved_in_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted rows in; out come whole conversations as one row each (at -2), and of those that may go on in another task or fill more than a block the blocks' summaries (-1) and rows."""
    part, out, weight = TaskContext.get().partitionId(), [], 0
    conv, block, kinds, roles, texts, turns, chars, border = None, 0, [], [], [], [], 0, True

    def closed(whole: bool) -> None:
        nonlocal kinds, roles, texts, turns, chars, block, weight
        summary = Summary.of(kinds, roles, turns)
        own = {"conv": conv, "part": part, "block": block}
        if whole:
            cost, audit, rows = repaired(kinds, roles, texts)
            out.append(own | {"at": -2, "cost": cost, "audit": audit, "sha": hashlib.sha256("\n".join(rows).encode("utf-8", "surrogatepass")).hexdigest()} | summary.row())
        else:
            out.append(own | {"at": -1} | summary.row())
            out.extend(own | {"at": i, "kind": k, "role": r, "text": t} for i, (k, r, t) in enumerate(zip(kinds, roles, texts, strict=True)))
            weight += chars
        kinds, roles, texts, turns, chars, block = [], [], [], [], 0, block + 1

    for batch in batches:
        for c, t, r, x, k, known in zip(batch["conv"], batch["turn"], batch["role"], batch["text"], batch["kind"], batch["has_turn"], strict=True):
            if c != conv:
                if conv is not None:
                    closed(whole=not border and not block)
                    border = False
                conv, block = c, 0
            elif len(kinds) >= BLOCK_ROWS or chars >= BLOCK_CHARS:
                closed(whole=False)
            if k >= 0:
                kinds.append(k)
                roles.append(r)
                texts.append(x)
                turns.append(t if known else None)
                chars += len(x)
            if len(out) >= BLOCK_ROWS or weight >= BLOCK_CHARS:
                yield _frame(out, PARTS)
                out, weight = [], 0
    if conv is not None:
        closed(whole=False)
    if out:
        yield _frame(out, PARTS)


UP = f"conv string, place bigint, {SUMMARY}"
DOWN = "conv string, place bigint, first int, last int"


def composed_group(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    """Summaries of neighbours to one, whose place is the group's number."""
    rows = group.sort_values("place").to_dict("records")
    total = Summary.read(rows[0])
    for row in rows[1:]:
        total = total + Summary.read(row)
    return _frame([{"conv": key[0], "place": key[1]} | total.row()], UP)


def crossed_group(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    """The states on both sides of each of a group's runs, from those on both sides of the group (``last`` -1: the conversation's end)."""
    group = group.sort_values("place")
    first, last = int(group["first"].iloc[0]), int(group["last"].iloc[0])
    steps = [(tuple(c), tuple(o)) for c, o in zip(group["costs"], group["orders"], strict=True)]
    states = crossings(steps, first, END_COSTS if last < 0 else _only(last)[0], _forward, _backward)
    ends = [*states[1:-1], last]
    return pd.DataFrame({"conv": key[0], "place": group["place"].to_numpy(), "first": states[:-1], "last": ends})


def repaired_block(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("at")
    last = int(group["last"].iloc[0])
    kinds = [int(k) for k in group["kind"]]
    live = [k for k in range(len(kinds)) if kinds[k] >= 0]
    roles, texts = group["role"].tolist(), group["text"].tolist()
    cost, audit, rows = repaired([kinds[k] for k in live], [roles[k] for k in live], [texts[k] for k in live], int(group["first"].iloc[0]), None if last < 0 else last)
    return pd.DataFrame({"conv": [key[0]], "place": [key[1]], "cost": [cost], "audit": [audit], "piece": ["\n".join(rows)]})


def joined_pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks in order in; cost, audit and digest of each conversation out."""
    conv, cost, audit, sha, empty = None, 0, [], hashlib.sha256(), True
    for batch in batches:
        for c, own, letters, piece in zip(batch["conv"], batch["cost"], batch["audit"], batch["piece"], strict=True):
            if c != conv:
                if conv is not None:
                    yield pd.DataFrame({"conv": [conv], "cost": [cost], "audit": ["".join(audit)], "sha": [sha.hexdigest()]})
                conv, cost, audit, sha, empty = c, 0, [], hashlib.sha256(), True
            cost += own
            audit.append(letters)
            if piece:
                sha.update(piece.encode("utf-8", "surrogatepass") if empty else b"\n" + piece.encode("utf-8", "surrogatepass"))
                empty = False
    if conv is not None:
        yield pd.DataFrame({"conv": [conv], "cost": [cost], "audit": ["".join(audit)], "sha": [sha.hexdigest()]})


def over_blocks(parts: DataFrame) -> DataFrame:
    """Conversations that lie in several blocks: counts, cost, audit and digest of each."""
    # A block's place: its task and number. Groups: first a task's blocks, then FAN neighbours at a time.
    place = F.col("part").cast("bigint") * (1 << 32) + F.col("block")
    blocks = parts.filter("at = -1").select("conv", place.alias("place"), *SUMMARY_NAMES)
    levels, width = [blocks], 1 << 32
    while True:
        group = F.floor(F.col("place") / width).cast("bigint")
        up = levels[-1].withColumn("group", group).groupBy("conv", "group").applyInPandas(composed_group, UP)
        levels.append(stored(up, "composed"))
        if (levels[-1].agg(F.max("place")).first()[0] or 0) == 0:
            break
        width = FAN
    chosen = levels[-1].select("conv", "place", F.lit(NOTHING).alias("first"), F.lit(-1).alias("last"))
    for k in range(len(levels) - 2, -1, -1):
        above = chosen.withColumnRenamed("place", "group")
        own = levels[k].select("conv", "place", "costs", "orders", F.floor(F.col("place") / (FAN if k else 1 << 32)).cast("bigint").alias("group"))
        chosen = stored(own.join(above, ["conv", "group"]).groupBy("conv", "group").applyInPandas(crossed_group, DOWN), "crossed")
    rows = parts.filter("at >= 0").select("conv", place.alias("place"), "at", "kind", "role", "text")
    # A block without rows still has a place, as inserts may stand there.
    marks = blocks.select("conv", "place", F.lit(-1).alias("at"), F.lit(-1).alias("kind"), F.lit("").alias("role"), F.lit("").alias("text"))
    solved = rows.unionByName(marks).join(chosen, ["conv", "place"]).groupBy("conv", "place").applyInPandas(repaired_block, "conv string, place bigint, cost bigint, audit string, piece string")
    pieces = solved.repartition("conv").sortWithinPartitions("conv", "place").mapInPandas(joined_pieces, "conv string, cost bigint, audit string, sha string")
    return levels[-1].drop("place").join(pieces, "conv")


def repaired_conversations(rows: DataFrame) -> DataFrame:
    """One row per conversation: faults after the damage, cost and audit of the repair, and its digest."""
    numbered = stored(damaged(rows), "damaged")
    given = with_kinds(numbered)
    order = ["conv", "turn", "role", "digest", "number"]
    ranged = given.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = ranged.select("conv", F.coalesce("turn", F.lit(0)).alias("turn"), "role", "text", "kind", F.col("turn").isNotNull().alias("has_turn"))
    parts = stored(ranged.mapInPandas(solved_in_task, PARTS), "parts")
    drop_stored(numbered)
    columns = ["conv", *SUMMARY_NAMES, "cost", "audit", "sha"]
    out = parts.filter("at = -2").select(*columns).unionByName(over_blocks(parts).select(*columns))
    gaps = F.coalesce(F.col("most") - F.col("least") + 1 - F.col("turns"), F.lit(0))
    conv_id = F.when(F.col("conv") != "", F.substring("conv", 2, 1 << 30)).cast(rows.schema["conv_id"].dataType)
    counts = [F.col(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(conv_id.alias("conv_id"), gaps.alias("gaps"), *counts, "audit", F.col("sha").alias("repaired_sha256"))
