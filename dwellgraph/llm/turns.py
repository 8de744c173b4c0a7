"""Repair of conversations: the cheapest edits that make each an optional system turn and then pairs of user and assistant turns.

Rows are partitioned by conversation and sorted by turn; a conversation streams through one task, its state carried from one Arrow batch to the next, and
is never held as a whole. Backward, last turn first, dynamic programming over four states (nothing yet, after a system, user or assistant turn) leaves one byte
a row: for every state the edit to make there. These back-pointers are a column, so that for conversations of any size they spill to disk with the
rows when Spark sorts them the other way round. Forward, the state walks along them from the first turn and the edited rows come out.
Among the cheapest edits those are taken whose initials come first in ASCII, and the initials fix the edits.

A conversation is one stream because its digest is: a hash of all its text in order has no parts that could be made apart. Counts of faults and the search
for duplicates use the same partitioning, so there is one shuffle in all.

Defined cases: a null conversation id is a conversation; null turns come first; a null role or text is one space; rows with the same turn are ordered by role and
text, so a repeated row follows the row it repeats; a text without a character that is not white space is blank, whatever its length; a conversation
of which no row is left is empty and needs no edit; no rows give no rows. Columns other than the four are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

KEPT, RELABELLED, DELETED, INSERTED = 0, 3, 4, 3  # costs of the edits
OPEN_END = 3  # cost of leaving a row that breaks off
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
EDITS = "DIKR"  # in the order in which equally cheap ones are preferred
NEXT = (USER, USER, ASSISTANT, USER)  # the state after the only turn other than system that may follow a state
ROLE = {USER: "user", ASSISTANT: "assistant"}
ENDS = (0, 2 * INSERTED, INSERTED, 0)  # what it costs to end in a state
SPACES = " \t\n\x0b\x0c\r"
ORDER = ["conv_id", "turn", "role", "text"]


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with faults planted by a checksum of id and turn."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20
    role, text = shown("role"), shown("text")
    out = conversations.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 0, F.array().cast("array<int>")).when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))).alias("copies"),
    )
    return out.withColumn("copy", F.explode("copies")).select(*ORDER)


def faults(rows: DataFrame) -> DataFrame:
    """Rows partitioned by conversation, with `fault`: blank, duplicate, truncated or null."""
    role, text = (F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text"))
    placed = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role, text).repartition("conv_id")
    # The window keeps to the partitioning by conversation.
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy("turn")) > 1
    placed = placed.withColumn("_seen", seen)
    bare = F.rtrim("text", F.lit(SPACES))
    fault = F.when(bare == "", "blank").when(F.col("_seen"), "duplicate").when(~F.substring(bare, -1, 1).isin(".", "!", "?"), "truncated")
    return placed.withColumn("fault", fault).drop("_seen")


def _initial(role: str) -> int | None:
    return {"s": SYSTEM, "u": USER, "a": ASSISTANT}.get(role[:1])


def _after(state: int, turn: int | None) -> int | None:
    """The state after a turn of a role, if it may follow."""
    if turn == SYSTEM:
        return SYSTEM if state == NOTHING else None
    return turn if turn is not None and NEXT[state] == turn else None


def step_back(costs: tuple, turn: int | None, fault: str | None) -> tuple[tuple, int]:
    """From the costs of the rest after a row (by state) to those before it, and the row's back-pointers, two bits a state."""
    lost = fault in ("blank", "duplicate")
    extra = OPEN_END if fault == "truncated" else 0
    choices = []
    for state in range(4):
        to = _after(state, turn)
        keep = None if lost or to is None else costs[to] + KEPT + extra
        relabel = None if lost else costs[NEXT[state]] + RELABELLED + extra
        choices.append([costs[state] + DELETED, None, keep, relabel])
    best = [min(c for c in row if c is not None) for row in choices]
    # Two insertions in a row lead round the cycle of user and assistant, more lead nowhere new.
    once = [INSERTED + best[NEXT[s]] for s in range(4)]
    twice = [2 * INSERTED + best[NEXT[NEXT[s]]] for s in range(4)]
    total = tuple(min(x) for x in zip(best, once, twice))
    pointers = 0
    for state, row in enumerate(choices):
        row[1] = INSERTED + total[NEXT[state]]
        pointers |= row.index(total[state]) << (2 * state)
    return total, pointers


def _back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the last of each conversation first: adds `_pointers`."""
    costs, conv, known = ENDS, object(), {}
    for batch in batches:
        out = np.zeros(batch.num_rows, dtype=np.int16)
        columns = (batch.column(c).to_pylist() for c in ("conv_id", "role", "fault"))
        for k, (own, role, fault) in enumerate(zip(*columns)):
            if own != conv:
                conv, costs = own, ENDS
            least = min(costs)
            key = (tuple(c - least for c in costs), role[:1], fault)  # few differ, whatever the length
            if key not in known:
                known[key] = step_back(key[0], _initial(role), fault)
            costs, out[k] = known[key]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, "_pointers"])


REPAIRED = "position long, edit string, turn long, was string, role string, text string, fault string, cost long"


def _forth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order, with back-pointers: the repaired rows, deleted ones included."""
    conv, state, place, kind = None, None, 0, None
    pending: list[tuple] = []

    def insert():
        nonlocal state, place
        state = NEXT[state]
        pending.append((conv, place, "I", None, None, ROLE[state], "", None, INSERTED))
        place += 1

    def close():
        while state in (SYSTEM, USER):
            insert()

    def flush():
        columns = list(zip(*pending)) or [[]] * 9
        kinds = [kind, pa.int64(), pa.string(), pa.int64(), *[pa.string()] * 4, pa.int64()]
        names = ["conv_id", *[f.split()[0] for f in REPAIRED.split(", ")]]
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)
        pending.clear()
        return out

    for batch in batches:
        kind = batch.schema.field("conv_id").type
        columns = (batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "fault", "_pointers"))
        for own, turn, role, text, fault, pointers in zip(*columns):
            if state is None or own != conv:
                if state is not None:
                    close()
                conv, state, place = own, NOTHING, 0
            edit = pointers >> (2 * state) & 3
            while EDITS[edit] == "I":
                insert()
                edit = pointers >> (2 * state) & 3
            extra = OPEN_END if fault == "truncated" else 0
            if EDITS[edit] == "D":
                pending.append((conv, place, "D", turn, role, role, text, fault, DELETED))
            elif EDITS[edit] == "K":
                state = _after(state, _initial(role))
                pending.append((conv, place, "K", turn, role, role, text, fault, KEPT + extra))
            else:
                state = NEXT[state]
                pending.append((conv, place, "R", turn, role, ROLE[state], text, fault, RELABELLED + extra))
            place += 1
        yield flush()
    if state is not None:
        close()
        if pending:
            yield flush()


def repaired(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) to the rows of repaired conversations: conv_id, position, edit (Keep, Rerole, Delete or Insert by its initial), turn, was
    (the role before), role, text, fault, cost. Deleted rows are among them. Each conversation's rows are together and in order."""
    checked = faults(rows)
    kind = checked.schema["conv_id"].dataType.simpleString()
    fields = f"conv_id {kind}, turn long, role string, text string, fault string"
    order = [F.col(c) for c in ORDER]
    # Blank, duplicate and truncated rows with one turn, role and text: the first is the one that is no duplicate, as row numbers see it.
    first = F.when(F.col("fault") == "duplicate", 1).otherwise(0)
    back = checked.sortWithinPartitions(order[0], *[c.desc() for c in order[1:]], first.desc())
    pointed = back.mapInArrow(_back, f"{fields}, _pointers smallint")
    return pointed.sortWithinPartitions(*order, first).mapInArrow(_forth, f"conv_id {kind}, {REPAIRED}")


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, begun, now, kind = None, False, {}, None
    pairs = {"su", "ua", "au"}

    def fresh():
        return {"gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": [], "hash": hashlib.sha256(), "any": False, "before": None,
                "low": None, "high": None, "distinct": 0}

    def done():
        gaps = 0 if now["low"] is None else now["high"] - now["low"] + 1 - now["distinct"]
        row = {"conv_id": pa.array([conv], kind), "gaps": pa.array([gaps], pa.int64())}
        row |= {c: pa.array([now[c]], pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "cost")}
        return pa.RecordBatch.from_pydict(row | {"audit": ["".join(now["audit"])], "repaired_sha256": [now["hash"].hexdigest()]})

    for batch in batches:
        kind = batch.schema.field("conv_id").type
        columns = (batch.column(c).to_pylist() for c in ("conv_id", "edit", "turn", "was", "role", "text", "fault", "cost"))
        for own, edit, turn, was, role, text, fault, cost in zip(*columns):
            if not begun or own != conv:
                if begun:
                    yield done()
                conv, begun, now = own, True, fresh()
            now["audit"].append(edit)
            now["cost"] += cost
            if fault:
                now[fault] += 1
            if edit != "I":
                if now["before"] is not None and now["before"][:1] + was[:1] not in pairs:
                    now["illegal"] += 1
                now["before"] = was
                if turn is not None and turn != now["high"]:  # in ascending order
                    now["low"] = turn if now["low"] is None else now["low"]
                    now["high"] = turn
                    now["distinct"] += 1
            if edit != "D":
                now["hash"].update(f"{chr(10) if now['any'] else ''}{role}:{text}".encode())
                now["any"] = True
    if begun:
        yield done()


SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def summary(rows: DataFrame) -> DataFrame:
    """One row for each conversation in the rows that `repaired` gives, in the order it gives them: counts of faults, missing turns and pairs of roles that may not follow
    each other, the cost, the edits by their initials and a digest of the repaired turns."""
    return rows.mapInArrow(_summed, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, {SUMMARY}")


def audited(ids: DataFrame, rows: DataFrame) -> DataFrame:
    """A summary for every conv_id of ids, also of those of which rows hold nothing."""
    found = summary(repaired(rows)).withColumnRenamed("conv_id", "_conv")
    empty: dict[str, Column] = {"audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256().hexdigest())}
    names = [f.split()[0] for f in SUMMARY.split(", ")]
    every = ids.select("conv_id").distinct()
    return every.join(found, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").select(
        "conv_id", *[F.coalesce(c, empty.get(c, F.lit(0).cast("long"))).alias(c) for c in names]
    )
