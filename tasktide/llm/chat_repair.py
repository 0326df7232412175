"""Chat formatting by minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant turns in alternation, a user first. Each given
turn is kept or relabelled, at a cost; where its role may not follow the role before it, it is merged into the turn
before it (same role) or an empty turn is inserted between them. Dynamic programming over the automaton of last roles
finds the cheapest repair; the repaired turns are then rendered.

A conversation of up to `block` rows is repaired in one group. The rows of longer ones, however long, are put in order over
all partitions and cut into blocks. A block is a matrix of costs from each state before it to each state after it, with
matrices multiplied by (min, +); products over groups of blocks, level by level, give a conversation's best last state, and
the same levels downwards the states at every block's borders, so each block is repaired on its own. No group holds more
than `block` rows or `fan` matrices, whatever a conversation's length. The result has one row per fragment of the rendered
text; a conversation's text is its fragments in order of block and at.

Defined results: turns are ordered by turn, then role, nulls first, then by a hash of the text, so that any number of turns
may share a turn number; a null or unknown role costs `unknown` whatever it becomes; a null text is empty; rows with a null
conv_id are one conversation; a null turn comes before all others; repeated rows are turns of their own, one after the other;
an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import Workspace

ROLES = ("system", "user", "assistant")
#: States: 0 nothing yet, then 1 + the number of the last turn's role.
_STATES = 4
_FAR = 1 << 40
#: Roles that may follow a state as they are.
_NEXT = {0: (0, 1), 1: (1,), 2: (2,), 3: (1,)}
#: Order of a conversation's turns; tie is a hash of the text.
_ORDER = ("turn", "role", "tie")
#: Rows of a partition, in the numbers that Spark gives them.
_PLACES = 1 << 33


@dataclass(frozen=True)
class ChatRepair:
    """Costs of a merge, of changing one known role into another, of naming an unknown role, of an empty turn. block: rows
    of a block; fan: blocks whose matrices meet in one place. begin, end: what stands around a role's name; stop: behind a
    turn."""

    merge: int = 1
    relabel: int = 3
    unknown: int = 2
    insert: int = 2
    block: int = 256
    fan: int = 256
    begin: str = "<|"
    end: str = "|>\n"
    stop: str = "\n<|end|>\n"

    def _moves(self) -> list[list[list[tuple[int, str, tuple[int, ...]]]]]:
        """[state][role]: ways to add a turn of that role: (cost, keep or merge, roles inserted before)."""
        table = []
        for state in range(_STATES):
            row = []
            for role in range(3):
                ways = []
                if role in _NEXT[state]:
                    ways.append((0, "keep", ()))
                elif state == role + 1:
                    ways.append((self.merge, "merge", ()))
                for between in _NEXT[state]:
                    if role in _NEXT[between + 1] and role not in _NEXT[state]:
                        ways.append((self.insert, "keep", (between,)))
                row.append(ways)
            table.append(row)
        return table

    def steps(self, role: str | None) -> list[list[tuple[int, int, int, str, tuple[int, ...]]]]:
        """[state before]: (cost, state after, role, action, inserted) of a turn with that given role, cheapest first."""
        return _steps(self, role if role in ROLES else None)

    def _matrix(self, roles: list) -> np.ndarray:
        m, known = np.where(np.eye(_STATES, dtype=bool), 0, _FAR), {}
        for r in roles:
            if r not in known:
                known[r] = one = np.full((_STATES, _STATES), _FAR)
                for s, options in enumerate(self.steps(r)):
                    for cost, t, *_ in options:
                        one[s, t] = min(one[s, t], cost)
            m = (m[:, :, None] + known[r][None]).min(axis=1)
        return np.minimum(m, _FAR)

    def _end(self, cost: np.ndarray) -> int:
        """The cheapest legal last state: a user or assistant turn. After a system turn alone an empty user turn comes."""
        return int((cost + np.array([_FAR, self.insert, 0, 0])).argmin())

    def path(self, roles: list, enter: int, leave: int | None) -> list[tuple[int, int, str, tuple[int, ...]]]:
        """(cost, role, action, inserted) of each turn on the cheapest way from one state to another, or to a legal end."""
        steps = {r: self.steps(r) for r in set(roles)}
        cost, back = {enter: 0}, []
        for r in roles:
            best: dict[int, tuple] = {}
            for s in sorted(cost):
                for option in steps[r][s]:
                    total = cost[s] + option[0]
                    if option[1] not in best or (total, s, option) < best[option[1]]:
                        best[option[1]] = (total, s, option)
            back.append(best)
            cost = {t: b[0] for t, b in best.items()}
        if leave is None:
            leave = self._end(np.array([cost.get(s, _FAR) for s in range(_STATES)]))
        out = []
        for best in reversed(back):
            _, before, (c, _, role, action, inserted) = best[leave]
            out.append((c, role, action, inserted))
            leave = before
        return out[::-1]

    def _rows(self, turns: DataFrame, work: Workspace) -> tuple[DataFrame, DataFrame | None]:
        """The turns of conversations that fit in a block, and those of others with their block: turns of all long
        conversations in order over all partitions, cut into runs of `block` rows."""
        rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
        many = work.keep(rows.groupBy(F.col("conv_id").alias("c")).count().filter(F.col("count") > self.block).select("c"), "long")
        if many.isEmpty():
            return rows, None
        of_many = F.col("conv_id").eqNullSafe(F.col("c"))
        # Equal rows may stand in any order; the salt lets them go to different partitions. It is taken where rows are read,
        # so that a task that is run again after a loss takes the same.
        order = ["conv_id", *_ORDER, "salt"]
        long = rows.withColumn("salt", F.xxhash64(F.monotonically_increasing_id())).join(many, of_many, "left_semi")
        long = long.repartitionByRange(*order).sortWithinPartitions(*order).drop("salt").withColumn("place", F.monotonically_increasing_id())
        at = F.col("place").bitwiseAND(_PLACES - 1)
        long = long.withColumn("block", F.col("place") - at + F.floor(at / self.block))
        return rows.join(many, of_many, "left_anti"), work.keep(long, "placed")

    def _ends(self, long: DataFrame, conv: str, work: Workspace) -> DataFrame:
        """conv_id, block, enter and leave (states), final (the conversation's last block) of each block.

        Matrices of neighbouring blocks are multiplied in groups of `fan`, level by level, until a conversation has one; from
        there the states at the borders go down the same levels. So no group grows with a conversation."""
        by_block = [("block", "ascending")]
        schema = f"conv_id {conv}, block long, m array<long>"

        def one(group: pa.Table, name: str, m: np.ndarray) -> pa.Table:
            return pa.table({"conv_id": group.column("conv_id").slice(0, 1), "block": group.column(name).slice(0, 1), "m": pa.array([m.reshape(-1).tolist()], pa.list_(pa.int64()))})

        def matrices(group: pa.Table) -> pa.Table:
            roles = group.take(pc.sort_indices(group, sort_keys=[("place", "ascending")])).column("role").to_pylist()
            return one(group, "block", self._matrix(roles))

        def product(group: pa.Table) -> pa.Table:
            m = np.where(np.eye(_STATES, dtype=bool), 0, _FAR)
            for x in group.take(pc.sort_indices(group, sort_keys=by_block)).column("m").to_pylist():
                m = np.minimum((m[:, :, None] + np.array(x).reshape(_STATES, _STATES)[None]).min(axis=1), _FAR)
            return one(group, "up", m)

        def states(group: pa.Table, above: pa.Table) -> pa.Table:
            """States before and after each block on the cheapest way between those of the group."""
            group = group.take(pc.sort_indices(group, sort_keys=by_block))
            first, state, final = (above.column(c)[0].as_py() for c in ("enter", "leave", "final"))
            cost, back = np.full(_STATES, _FAR), []
            cost[first] = 0
            for x in group.column("m").to_pylist():
                total = cost[:, None] + np.array(x).reshape(_STATES, _STATES)
                back.append(total.argmin(axis=0))
                cost = total.min(axis=0)
            leave, enter, n = [], [], len(back)
            for b in reversed(back):
                leave.append(state)
                state = int(b[state])
                enter.append(state)
            return pa.table({"conv_id": group.column("conv_id"), "block": group.column("block"), "enter": pa.array(enter[::-1], pa.int32()), "leave": pa.array(leave[::-1], pa.int32()), "final": pa.array([final and i == n - 1 for i in range(n)])})

        def last(group: pa.Table) -> pa.Table:
            leave = self._end(np.array(group.column("m")[0].as_py()).reshape(_STATES, _STATES)[0])
            return pa.table({"conv_id": group.column("conv_id"), "block": group.column("block"), "enter": pa.array([0], pa.int32()), "leave": pa.array([leave], pa.int32()), "final": [True]})

        at, part = F.col("block").bitwiseAND(_PLACES - 1), F.floor(F.col("block") / _PLACES)
        levels = [work.keep(long.groupBy("conv_id", "block").applyInArrow(matrices, schema), "matrices-0")]
        most = levels[0].agg(F.max(at).alias("at"), F.max(part).alias("part")).first()
        n_at, n_part, ups = most.at, most.part, []
        while n_at or n_part:
            # First within the partitions of the order, then over these.
            up = F.col("block") - at + F.floor(at / self.fan) if n_at else F.floor(part / self.fan) * _PLACES
            n_at, n_part = (n_at // self.fan, n_part) if n_at else (0, n_part // self.fan)
            ups.append(levels[-1].withColumn("up", up.cast("long")))
            levels.append(work.keep(ups[-1].groupBy("conv_id", "up").applyInArrow(product, schema), f"matrices-{len(levels)}"))
        schema = f"conv_id {conv}, block long, enter int, leave int, final boolean"
        ends = levels[-1].groupBy("conv_id", "block").applyInArrow(last, schema)
        for below in reversed(ups):
            ends = below.groupBy("conv_id", "up").cogroup(ends.withColumnRenamed("block", "up").groupBy("conv_id", "up")).applyInArrow(states, schema)
        return work.keep(ends, "ends")

    def repair(self, turns: DataFrame) -> DataFrame:
        """conv_id, turn, at (order within the turn's block), block, role, action (keep, relabel, merge, insert), cost and
        fragment (rendered) of each repaired turn or part of one; turn is null for inserted turns."""
        work = Workspace(turns.sparkSession, "chat-repair")
        conv = turns.schema["conv_id"].dataType.simpleString()
        schema = f"conv_id {conv}, block long, at long, turn long, role string, action string, cost long, fragment string"
        short, long = self._rows(turns, work)

        def rendered(group: pa.Table, block: int, enter: int, leave: int | None, final: bool) -> pa.Table:
            given = group.column("role").to_pylist()
            out: list[tuple] = []
            opened = enter > 0

            def put(turn: int | None, role: int, action: str, cost: int, text: str) -> None:
                nonlocal opened
                out.append((turn, ROLES[role], action, cost, "\n" + text if action == "merge" else (self.stop if opened else "") + self.begin + ROLES[role] + self.end + text))
                opened = True

            for turn, old, text, (cost, role, action, inserted) in zip(group.column("turn").to_pylist(), given, group.column("text").to_pylist(), self.path(given, enter, leave), strict=True):
                for x in inserted:
                    put(None, x, "insert", self.insert, "")
                cost -= self.insert * len(inserted)
                put(turn, role, "merge" if action == "merge" else "keep" if old == ROLES[role] else "relabel", cost, text)
            if final:
                if role == 0:
                    put(None, 1, "insert", self.insert, "")
                out[-1] = (*out[-1][:4], out[-1][4] + self.stop)
            n = len(out)
            turn, role, action, cost, text = zip(*out, strict=True)
            return pa.table({"conv_id": pa.chunked_array([group.column("conv_id").slice(0, 1).combine_chunks().take(pa.array([0] * n))]), "block": pa.array([block] * n, pa.int64()), "at": pa.array(range(n), pa.int64()), "turn": pa.array(turn, pa.int64()), "role": role, "action": action, "cost": pa.array(cost, pa.int64()), "fragment": text})

        def whole(group: pa.Table) -> pa.Table:
            group = group.take(pc.sort_indices(group, sort_keys=[(c, "ascending") for c in _ORDER], null_placement="at_start"))
            return rendered(group, 0, 0, None, True)

        def part(group: pa.Table, ends: pa.Table) -> pa.Table:
            group = group.take(pc.sort_indices(group, sort_keys=[("place", "ascending")]))
            return rendered(group, *(ends.column(c)[0].as_py() for c in ("block", "enter", "leave", "final")))

        out = short.groupBy("conv_id").applyInArrow(whole, schema)
        if long is None:
            return out
        ends = self._ends(long, conv, work)
        return out.unionByName(long.groupBy("conv_id", "block").cogroup(ends.groupBy("conv_id", "block")).applyInArrow(part, schema))


@cache
def _steps(options: ChatRepair, role: str | None) -> list[list[tuple[int, int, int, str, tuple[int, ...]]]]:
    out = []
    for ways in options._moves():
        choices = []
        for new in range(3):
            change = options.unknown if role is None else 0 if ROLES[new] == role else options.relabel
            choices += [(change + cost, new + 1, new, action, inserted) for cost, action, inserted in ways[new]]
        out.append(sorted(choices))
    return out


def render(fragments: DataFrame) -> DataFrame:
    """conv_id, cost and text of each conversation; for conversations whose text fits in a row."""
    parts = F.array_sort(F.collect_list(F.struct("block", "at", "fragment")))
    return fragments.groupBy("conv_id").agg(F.sum("cost").alias("cost"), F.array_join(F.transform(parts, lambda x: x["fragment"]), "").alias("text"))
