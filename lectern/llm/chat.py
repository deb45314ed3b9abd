"""Chat formatting by minimum-cost repair of roles.

The automaton of legal turns: an optional system turn, then user and assistant
in alternation, the user first.  Each turn may keep its role, be relabelled,
or be merged into the turn before it (same role); empty turns may be inserted
where the automaton asks for one.  Dynamic programming finds the cheapest
repair; costs of a run of turns form a small min-plus matrix, so long
conversations are repaired in blocks of turn numbers (one block's rows at a
time, never a whole conversation): the blocks' matrices first, then the
blocks' entry states, then each block's path.

Result: one row per turn, with its role, what was done, the empty turns put
before it, and its rendered piece.  The pieces of a conversation, in order of
(turn, seq), are the rendered text.

Cases: a null text is empty.  A role is trimmed and lower-cased; aliases are
free; a null or unknown role must be relabelled.  Turns with equal numbers
follow each other by role, then text; null numbers come last.  Rows with a
null conv_id are one conversation.  An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

STATES = ("start", "system", "user", "assistant")
LEGAL = {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
MERGE, INSERT, RELABEL = 1.0, 2.0, 3.0
ALIASES = {"human": "user", "prompter": "user", "ai": "assistant", "bot": "assistant", "model": "assistant", "gpt": "assistant"}
#: Turn numbers in a block.
BLOCK = 256


def steps(role: str | None) -> list[list[tuple[float, str, tuple[str, ...]]]]:
    """[from][to]: (cost, what is done, roles inserted before)."""
    between = {}
    for a in STATES:
        between[a] = {b: () for b in LEGAL[a]}
        grown = True
        while grown:
            grown = False
            for via in list(between[a]):
                for b in LEGAL[via]:
                    if b not in between[a]:
                        between[a][b] = (*between[a][via], via)
                        grown = True
    out = []
    for a in STATES:
        row = []
        for b in STATES:
            base = 0.0 if role == b else RELABEL
            if b == "start":
                row.append((np.inf, "", ()))
                continue
            ways = []
            if a == b:
                ways.append((base + MERGE, "merge" if role == b else "relabel+merge", ()))
            if b in between[a]:
                ways.append((base + INSERT * len(between[a][b]), "keep" if role == b else "relabel", between[a][b]))
            row.append(min(ways, key=lambda w: w[0], default=(np.inf, "", ())))
        out.append(row)
    return out


def costs(role: str | None) -> np.ndarray:
    return np.array([[w[0] for w in row] for row in steps(role)])


def then(m: np.ndarray, n: np.ndarray) -> np.ndarray:
    return (m[:, :, None] + n[None]).min(axis=1)


def path(roles: list[str | None], entry: int, leave: int) -> list[int]:
    """States after each turn, from ``entry`` to ``leave``, at least cost; ties to the earlier state."""
    table = {r: costs(r) for r in set(roles)}
    value, back = np.full(4, np.inf), []
    value[entry] = 0
    for r in roles:
        reach = value[:, None] + table[r]
        back.append(reach.argmin(axis=0))
        value = reach.min(axis=0)
    out = [leave]
    for b in reversed(back[1:]):
        out.append(int(b[out[-1]]))
    return out[::-1]


def runs(batches, keys: int):
    """Yield (key, columns) of consecutive rows with equal first ``keys`` columns, over batches."""
    now, held = None, None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:keys] != now or held is None:
                if held:
                    yield now, held
                now, held = row[:keys], []
            held.append(row[keys:])
    if held:
        yield now, held


def repair(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, turn, seq, role, action, inserted, rendered, cost."""
    role = F.trim(F.lower(F.col("role").cast("string")))
    for a, b in ALIASES.items():
        role = F.when(role == a, F.lit(b)).otherwise(role)
    role = F.when(role.isin(*STATES[1:]), role)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("block", F.coalesce(F.floor(F.col("turn") / block), F.lit((1 << 62))).cast("long"))
    order = ["conv_id", "block", F.col("turn").asc_nulls_last(), "role", "text"]
    rows = materialize(rows, "turns")

    def matrices(batches):
        import pyarrow as pa

        table = {r: costs(r) for r in (*STATES[1:], None)}
        out = []
        now, m = None, None
        for batch in batches:
            for conv, blk, r in zip(*(batch.column(j).to_pylist() for j in (0, 1, 2))):
                if (conv, blk) != now:
                    if now is not None:
                        out.append((*now, m.ravel().tolist()))
                    now, m = (conv, blk), table[r]
                else:
                    m = then(m, table[r])
            if len(out) > 5000:
                yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.list_(pa.float64())))], ["conv_id", "block", "m"])
                out = []
        if now is not None:
            out.append((*now, m.ravel().tolist()))
        yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.list_(pa.float64())))], ["conv_id", "block", "m"])

    def ends(batches):
        import pyarrow as pa

        for (conv,), held in runs(batches, 1):
            ms = [np.array(m).reshape(4, 4) for _, m in held]
            value, back = np.array([0, np.inf, np.inf, np.inf]), []
            for m in ms:
                reach = value[:, None] + m
                back.append(reach.argmin(axis=0))
                value = reach.min(axis=0)
            leave = [int(value.argmin())]
            for b in reversed(back):
                leave.append(int(b[leave[-1]]))
            leave = leave[::-1]
            yield pa.RecordBatch.from_arrays(
                [pa.array([conv] * len(ms), pa.int64()), pa.array([x[0] for x in held], pa.int64()), pa.array(leave[:-1], pa.int32()), pa.array(leave[1:], pa.int32()), pa.array([float(value.min())] * len(ms))], ["conv_id", "block", "entry", "leave", "cost"]
            )

    def paths(batches):
        import pyarrow as pa

        made = {r: steps(r) for r in (*STATES[1:], None)}
        for (conv, blk, entry, leave, cost), held in runs(batches, 5):
            states = path([r for _, r, _ in held], entry, leave)
            out, before = [[] for _ in range(8)], entry
            for seq, ((turn, r, text), state) in enumerate(zip(held, states)):
                _, action, inserted = made[r][before][state]
                head = "".join(f"<|{x}|>\n\n" for x in inserted)
                piece = ("\n" if "merge" in action else f"{head}<|{STATES[state]}|>\n") + text + "\n"
                for v, x in zip(out, (conv, turn, seq, STATES[state], action, list(inserted), piece, cost)):
                    v.append(x)
                before = state
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds)], ["conv_id", "turn", "seq", "role", "action", "inserted", "rendered", "cost"])

    found = rows.select("conv_id", "block", "role", "turn", "text").repartition("conv_id", "block").sortWithinPartitions(*order).select("conv_id", "block", "role").mapInArrow(matrices, "conv_id long, block long, m array<double>")
    found = found.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(ends, "conv_id long, block long, entry int, leave int, cost double")
    found = materialize(found, "blocks")
    met = rows.join(found.withColumnsRenamed({"conv_id": "c", "block": "k"}), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("k")))
    met = met.select("conv_id", "block", "entry", "leave", "cost", "turn", "role", "text").repartition("conv_id", "block").sortWithinPartitions(*order)
    return met.mapInArrow(paths, "conv_id long, turn long, seq int, role string, action string, inserted array<string>, rendered string, cost double")
