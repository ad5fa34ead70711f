"""Repair of the turn structure of conversations by lazy weighted determinisation.

A repaired conversation is empty, or an optional system turn and then user and assistant turns
in pairs.  Edits make it so: keep a row, give it the role of a user or an assistant, delete it,
insert an empty turn; each has a cost, and blank and duplicate rows have to be deleted.  Which
edit leads where is a small weighted automaton.  A row is to it one of nine symbols, so a
vector of its states' costs of all that follows, less the least of them, becomes a state of a
deterministic automaton; states are numbered as they appear and cached with their steps in a
transition table, whose size doesn't depend on the data (costs of two states never differ by
more than what a few edits make up for).  A scan of the rows from last to first, one look-up a
row, gives the cost.  The trace runs against the scan, from the first row on: it follows arcs
that are tight (an edit's cost is just what the two vectors differ by), the least initial
first, which gives the ASCII-least audit among the cheapest; its moves are cached too.

A row's first fault counts: blank (no word), duplicate (role and text of an earlier row of the
conversation), truncated (the last word doesn't end in a mark of MARKS).

Rows come in the order of their turns, null turns first, those of one turn by role and text.  A
null role or text is one space, a null conversation id an id of its own, and repeated rows are
duplicates.  A conversation without rows (only such whose times are 0) has zeros and an empty
audit.  Extra columns don't matter; an empty table gives no rows; texts are taken whole.

A task repairs whole conversations of up to `long_rows` rows, one at a time.  Longer ones are cut
into chunks all over the cluster: a chunk's costs are a 4 x 4 matrix, a fold over the matrices
gives each chunk the vector behind it, and then each chunk is scanned and traced by itself.
Their results are the same; only the row of the result, with the audit and the turns, is whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweft.llm import common as C
from panelweft.llm.resample import CRC_OF, CRC_TABLE

MARKS = ".!?"
WORD = r"[^\x20\x09-\x0D]"
RETAG, DELETE, INSERT, UNFINISHED = 3, 4, 3, 3
_NEVER = 1 << 50
#: Rows up to which a conversation is left whole, and rows of a chunk of a longer one.
LONG_ROWS = 50_000
CHUNK_ROWS = 4096

#: Structure states: nothing yet, after the system turn, after a user's, after an assistant's turn.
ACCEPTING = (0, 3)
#: The state after an inserted or renamed turn, and that turn's role.
_NEXT = ((2, "user"), (2, "user"), (3, "assistant"), (2, "user"))
#: The state after a turn that is kept, by its role's initial.
_KEEP = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
_INITIALS = "sua"
#: Symbols: 0 for rows that have to go, else 1 + 2 * (place of the initial, 3 for others) + truncated.
GONE = 0


def symbol(initial: str, truncated: bool) -> int:
    place = _INITIALS.find(initial) if initial else -1
    return 1 + 2 * (place if place >= 0 else 3) + truncated


def _edits(sym: int) -> list[list[tuple[str, int, int]]]:
    """By structure state: (initial, cost, next state) of every edit of a row."""
    out = []
    for q in range(4):
        arcs = [("D", DELETE, q)]
        if sym != GONE:
            place, truncated = divmod(sym - 1, 2)
            more = UNFINISHED if truncated else 0
            if place < 3 and _INITIALS[place] in _KEEP[q]:
                arcs.append(("K", more, _KEEP[q][_INITIALS[place]]))
            arcs.append(("R", RETAG + more, _NEXT[q][0]))
        out.append(arcs)
    return out


class Repairer:
    """The deterministic automaton, built as rows ask for it."""

    def __init__(self) -> None:
        self.edits = [_edits(s) for s in range(9)]
        self.vectors: list[tuple[int, ...]] = []
        self.number: dict[tuple[int, ...], int] = {}
        self.table: list[list[tuple[int, int] | None]] = []
        self.moves: dict[tuple[int, int, int], tuple[str, int]] = {}
        self.end, _ = self._state([0 if q in ACCEPTING else _NEVER for q in range(4)])
        self.only = [self._state([0 if q == end else _NEVER for q in range(4)])[0] for end in range(4)]

    def _state(self, costs: list[int]) -> tuple[int, int]:
        """The state of a vector of costs, after insertions, and the least of them."""
        for _ in range(3):  # an insertion leads to its place from at most two others
            costs = [min(costs[q], INSERT + costs[_NEXT[q][0]], _NEVER) for q in range(4)]
        least = min(costs)
        vector = tuple(c - least if c < _NEVER else c for c in costs)
        if vector not in self.number:
            self.number[vector] = len(self.vectors)
            self.vectors.append(vector)
            self.table.append([None] * 9)
        return self.number[vector], least

    def step(self, state: int, sym: int) -> tuple[int, int]:
        """The state before a row of this symbol, and what its costs have in common."""
        if (got := self.table[state][sym]) is None:
            after = self.vectors[state]
            got = self.table[state][sym] = self._state([min(c + after[to] for _, c, to in arcs) for arcs in self.edits[sym]])
        return got

    def _move(self, state: int, sym: int, q: int) -> tuple[str, int]:
        """The edits up to a row's own, from structure state q, where state follows the row."""
        before, common = self.step(state, sym)
        left, right, made = self.vectors[before], self.vectors[state], ""
        while True:
            tight = [(e, to) for e, c, to in self.edits[sym][q] if c + right[to] == left[q] + common]
            if INSERT + left[_NEXT[q][0]] == left[q]:
                tight.append(("I", _NEXT[q][0]))
            e, q = min(tight)
            made += e
            if e != "I":
                return made, q

    def scan(self, symbols: Sequence[int], state: int) -> tuple[list[int], int]:
        """The states after each row and, at last, before the first, last row first; and what they have in common."""
        cost, states = 0, [state]
        for sym in reversed(symbols):
            state, more = self.step(state, sym)
            cost += more
            states.append(state)
        return states, cost

    def trace(self, symbols: Sequence[int], states: list[int], q: int) -> tuple[list[str], int]:
        """The edits up to each row's own from structure state q on, and the structure state after the last; states as of scan()."""
        out = []
        for sym, state in zip(symbols, reversed(states[:-1]), strict=True):
            key = state, sym, q
            if (got := self.moves.get(key)) is None:
                got = self.moves[key] = self._move(*key)
            out.append(got[0])
            q = got[1]
        return out, q

    def repair(self, symbols: Sequence[int]) -> tuple[int, list[str]]:
        """The least cost, and the edits up to each row's own, then those after the last row."""
        states, cost = self.scan(symbols, self.end)
        out, q = self.trace(symbols, states, 0)
        return cost + self.vectors[states[-1]][0], [*out, closing(q)]

    def span(self, symbols: Sequence[int]) -> list[int]:
        """Costs of rows as a 4 x 4 matrix, from the structure state before them to the one after: scans that only one end is good for."""
        out = [0] * 16
        for end in range(4):
            states, cost = self.scan(symbols, self.only[end])
            for q, c in enumerate(self.vectors[states[-1]]):
                out[4 * q + end] = min(c + cost, _NEVER)
        return out


def closing(q: int) -> str:
    """Insertions that end a conversation from structure state q."""
    out = ""
    while q not in ACCEPTING:
        out, q = out + "I", _NEXT[q][0]
    return out


def applied(edits: list[str], rows: Sequence[tuple[str, str]], q: int = 0) -> list[tuple[str, str]]:
    """The turns that edits, from structure state q on, make of rows (role, text); one more edit may follow the last row's."""
    out = []
    for made, row in zip(edits, [*rows, None], strict=False):
        for e in made:
            if e == "K":
                q = _KEEP[q][row[0][0]]
                out.append(row)
            elif e != "D":
                q, role = _NEXT[q]
                out.append((role, row[1] if e == "R" else ""))
    return out


def _faults(role: str, text: str, seen: set[bytes]) -> str:
    word = text.strip(" \t\n\x0b\x0c\r")
    key = hashlib.blake2b(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()
    again = key in seen
    seen.add(key)
    return "blank" if not word else "duplicate" if again else "" if word[-1] in MARKS else "truncated"


def _summary(machine: Repairer, rows: list[tuple[int | None, str, str]]) -> tuple:
    """gaps, blank, duplicate, truncated, illegal, cost, audit, turns of one conversation's rows (turn, role, text)."""
    seen: set[bytes] = set()
    faults = [_faults(role, text, seen) for _, role, text in rows]
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    initials = [role[:1] for _, role, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    cost, edits = machine.repair([GONE if f in ("blank", "duplicate") else symbol(i, f == "truncated") for f, i in zip(faults, initials, strict=True)])
    turned = applied(edits, [(role, text) for _, role, text in rows])
    return gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, "".join(edits), [{"role": r, "text": t} for r, t in turned]


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))


def repair(rows: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", times_col: str | None = None, long_rows: int = LONG_ROWS) -> DataFrame:
    """(conv_col, gaps, blank, duplicate, truncated, illegal, cost, audit, turns) of every conversation; turns: array of (role, text).

    times_col: how often a row stands, one after the other; 0 only tells that its conversation is there.
    """
    spark = rows.sparkSession
    C.ship(spark)
    times = F.col(f"`{times_col}`") if times_col else F.lit(1)
    held = rows.select(F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").cast("long").alias("turn"), F.coalesce(F.col(f"`{role_col}`"), F.lit(" ")).alias("role"), F.coalesce(F.col(f"`{text_col}`"), F.lit(" ")).alias("text"), times.cast("long").alias("times"))
    path = C.shared_dir(spark)
    long = C.stored(held.groupBy("conv").agg(F.sum("times").alias("n")).filter(F.col("n") > long_rows).select(F.col("conv").alias("of")), f"{path}/long")
    if long.isEmpty():
        return _whole(held).withColumnRenamed("conv", conv_col)
    same = F.col("conv").eqNullSafe(F.col("of"))
    out = _whole(held.join(long, same, "left_anti")).unionByName(_chunked(held.join(long, same, "left_semi"), path))
    return out.withColumnRenamed("conv", conv_col)


def _whole(held: DataFrame) -> DataFrame:
    """Conversations, each by one task."""

    def run(batches):
        machine, conv, own, open_ = Repairer(), None, [], False
        done: list[tuple] = []
        size, conv_type = 0, None

        def flush():
            convs, found = [c for c, _ in done], [s for _, s in done]
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(convs, conv_type), *(pa.array([s[i] for s in found], pa.int64()) for i in range(6)), pa.array([s[6] for s in found], pa.string()), pa.array([s[7] for s in found], _TURNS)], ["conv", *_COUNTS, "audit", "turns"])

        for batch in batches:
            conv_type = C.column(batch, "conv").type
            for c, turn, role, text, n in zip(*(C.column(batch, x).to_pylist() for x in ("conv", "turn", "role", "text", "times")), strict=True):
                if not open_ or c != conv:
                    if open_:
                        done.append((conv, _summary(machine, own)))
                        if size > C.BLOCK:
                            yield flush()
                            size = 0
                    conv, own, open_ = c, [], True
                own += [(turn, role, text)] * n
                size += len(text) * n + 64
        if open_:
            done.append((conv, _summary(machine, own)))
            yield flush()

    ordered = held.repartition("conv").sortWithinPartitions("conv", F.asc_nulls_first("turn"), "role", "text")
    kind = held.schema["conv"].dataType.simpleString()
    return ordered.mapInArrow(C.tidy(run), f"conv {kind}, {', '.join(f'{x} long' for x in _COUNTS)}, audit string, turns array<struct<role:string,text:string>>")


def _chunked(held: DataFrame, path: str) -> DataFrame:
    """Long conversations: equal rows as one with their number, then chunks of consecutive rows."""
    kind = held.schema["conv"].dataType.simpleString()
    one = held.groupBy("conv", "turn", "role", "text").agg(F.sum("times").alias("times")).filter("times > 0").withColumn("key", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    one = C.stored(one, f"{path}/distinct")
    at = F.struct(F.col("turn").isNotNull().alias("has"), F.col("turn").alias("turn"))
    first = one.groupBy(F.col("conv").alias("of"), F.col("key").alias("what")).agg(F.min(at).alias("first"))
    marked = one.join(first, F.col("conv").eqNullSafe(F.col("of")) & (F.col("key") == F.col("what"))).select("conv", "turn", "role", "text", "times", at.eqNullSafe(F.col("first")).alias("fresh"))
    keys = ["conv", F.asc_nulls_first("turn"), "role", "text"]
    cut = marked.repartitionByRange(C.width(held.sparkSession), *keys).sortWithinPartitions(*keys)
    stats = ("n", "blank", "duplicate", "truncated", "illegal", "turns", "low", "high")

    def chunk(batches):
        machine, part, seq = Repairer(), TaskContext.get().partitionId(), 0
        conv, rows, open_, conv_type = None, [], False, None

        def flush():
            nonlocal seq
            seq += 1
            faults = [f for *_, f in rows]
            initials = [role[:1] for _, role, _, _ in rows]
            symbols = bytes(GONE if f in ("blank", "duplicate") else symbol(i, f == "truncated") for f, i in zip(faults, initials, strict=True))
            known = [t for t, *_ in rows if t is not None]
            found = (len(rows), *map(faults.count, ("blank", "duplicate", "truncated")), sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)), len(set(known)), min(known, default=None), max(known, default=None))
            texts = [{"role": role, "text": text} if f not in ("blank", "duplicate") else {"role": "", "text": ""} for _, role, text, f in rows]
            return pa.RecordBatch.from_arrays([pa.array([conv], conv_type), pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([symbols], pa.binary()), pa.array([machine.span(symbols)], pa.list_(pa.int64())), *(pa.array([x], pa.int64()) for x in found), pa.array([initials[0]]), pa.array([initials[-1]]), pa.array([texts], _TURNS)], ["conv", "part", "seq", "symbols", "costs", *stats, "opens", "closes", "rows"])

        for batch in batches:
            conv_type = C.column(batch, "conv").type
            for c, turn, role, text, n, fresh in zip(*(C.column(batch, x).to_pylist() for x in ("conv", "turn", "role", "text", "times", "fresh")), strict=True):
                if rows and (c != conv or len(rows) >= CHUNK_ROWS):
                    yield flush()
                    rows = []
                conv = c
                for k in range(n):
                    if len(rows) >= CHUNK_ROWS:
                        yield flush()
                        rows = []
                    fault = _faults(role, text, set())
                    rows.append((turn, role, text, fault if fault == "blank" else "duplicate" if k or not fresh else fault))
        if rows:
            yield flush()

    turns = "array<struct<role:string,text:string>>"
    chunks = C.stored(cut.mapInArrow(C.tidy(chunk), f"conv {kind}, part int, seq int, symbols binary, costs array<long>, {', '.join(f'{x} long' for x in stats)}, opens string, closes string, rows {turns}"), f"{path}/chunks")
    small = chunks.drop("rows", "symbols")

    def behind(own: pd.DataFrame) -> pd.DataFrame:
        """The vector of costs behind each chunk, and the conversation's counts on each."""
        own = own.sort_values(["part", "seq"], ignore_index=True)
        right, ends = [0, 6, 3, 0], []
        for m in own["costs"][::-1]:
            ends.append(right)
            right = [min(int(m[4 * q + p]) + right[p] for p in range(4)) for q in range(4)]
        own["behind"] = ends[::-1]
        shared = (own["low"].to_numpy()[1:] == own["high"].to_numpy()[:-1]).sum()  # a turn on both sides of a cut
        n_turns = own["turns"].sum() - shared
        own["gaps"] = int(own["high"].max() - own["low"].min() + 1 - n_turns) if n_turns else 0
        own["illegal"] = int(own["illegal"].sum()) + sum(a + b not in ("su", "ua", "au") for a, b in zip(own["closes"], own["opens"][1:], strict=False))
        for c in ("blank", "duplicate", "truncated"):
            own[c] = own[c].sum()
        return own.assign(cost=right[0])[["conv", "part", "seq", "behind", *_COUNTS]]

    place = "conv", "part", "seq"
    folded = C.stored(small.groupBy("conv").applyInPandas(behind, f"conv {kind}, part int, seq int, behind array<long>, {', '.join(f'{x} long' for x in _COUNTS)}"), f"{path}/folded")

    def traced(batches):
        machine = Repairer()
        for batch in batches:
            made, ends = [], []
            for symbols, right in zip(C.column(batch, "symbols").to_pylist(), C.column(batch, "behind").to_pylist(), strict=True):
                states, _ = machine.scan(symbols, machine._state(right)[0])
                found = [machine.trace(symbols, states, q) for q in range(4)]
                made.append([",".join(e) for e, _ in found])
                ends.append([q for _, q in found])
            yield pa.RecordBatch.from_arrays([*(C.column(batch, x) for x in place), pa.array(made, pa.list_(pa.string())), pa.array(ends, pa.list_(pa.int32()))], [*place, "made", "ends"])

    # part and seq name a chunk: a null conversation needs no null-safe key
    paths = C.stored(chunks.select(*place, "symbols").join(folded.select("part", "seq", "behind"), ["part", "seq"]).select(*place, "symbols", "behind").mapInArrow(C.tidy(traced), f"conv {kind}, part int, seq int, made array<string>, ends array<int>"), f"{path}/paths")

    def chosen(own: pd.DataFrame) -> pd.DataFrame:
        """The structure state before each chunk, and the edits after the last."""
        own = own.sort_values(["part", "seq"], ignore_index=True)
        q, starts = 0, []
        for ends in own["ends"]:
            starts.append(q)
            q = int(ends[q])
        own["start"], own["tail"] = starts, ""
        own.loc[len(own) - 1, "tail"] = closing(q)
        return own[["part", "seq", "start", "tail"]]

    starts = paths.drop("made").groupBy("conv").applyInPandas(chosen, "part int, seq int, start int, tail string")

    def apply(batches):
        for batch in batches:
            audits, out = [], []
            for rows, made, start, tail in zip(*(C.column(batch, x).to_pylist() for x in ("rows", "made", "start", "tail")), strict=True):
                edits = made[start].split(",")
                audits.append("".join(edits) + tail)
                out.append([{"role": r, "text": t} for r, t in applied([*edits, tail], [(x["role"], x["text"]) for x in rows], start)])
            yield pa.RecordBatch.from_arrays([*(C.column(batch, x) for x in place), pa.array(audits), pa.array(out, _TURNS)], [*place, "audit", "turns"])

    done = chunks.select(*place, "rows").join(paths.select("part", "seq", "made"), ["part", "seq"]).join(starts, ["part", "seq"]).select(*place, "rows", "made", "start", "tail").mapInArrow(C.tidy(apply), f"conv {kind}, part int, seq int, audit string, turns {turns}")
    gathered = done.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("part", "seq", "audit", "turns"))).alias("x"))
    counts = folded.select(F.col("conv").alias("of"), *_COUNTS).dropDuplicates(["of"])
    return gathered.join(counts, F.col("conv").eqNullSafe(F.col("of"))).select("conv", *_COUNTS, F.array_join("x.audit", "").alias("audit"), F.flatten("x.turns").alias("turns"))


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, times): the query's damage, by a checksum of a row's place."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.pmod(F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))), F.lit(20))
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    text = F.when(fault == 0, "").when(fault == 1, "").when(fault == 2, F.translate(text, MARKS, "")).otherwise(text)
    return rows.select("conv_id", "turn", F.when(fault == 4, "user").otherwise(role).alias("role"), text.alias("text"), F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("times"))


def op12_conversations(spark, sf_dir: str) -> DataFrame:
    """Every conversation after damage and repair; the digest is of its turns, a line each."""
    out = repair(damaged(C.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")), times_col="times")
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(lines.cast("binary"), 256).alias("repaired_sha256"))


def _sql_row(q: int) -> str:
    """The best edit of a row from structure state q, before insertions, as {c, a}."""
    keep = " ".join(f"WHEN ini = '{i}' THEN {{'c': x + c{to}, 'a': 'K' || a{to}}}" for i, to in _KEEP[q].items())
    to = _NEXT[q][0]
    return f"list_min([{{'c': {DELETE} + c{q}, 'a': 'D' || a{q}}}, CASE WHEN gone THEN NULL {keep} END, CASE WHEN NOT gone THEN {{'c': {RETAG} + x + c{to}, 'a': 'R' || a{to}}} END])"


def _sql_inserted(q: int) -> str:
    one = _NEXT[q][0]
    two = _NEXT[one][0]
    return f"list_min([e{q}, {{'c': {INSERT} + e{one}.c, 'a': 'I' || e{one}.a}}, {{'c': {2 * INSERT} + e{two}.c, 'a': 'II' || e{two}.a}}])"


ORACLE = rf"""
WITH RECURSIVE d AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {CRC_OF.format(x="(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS k FROM conversations, {CRC_TABLE}),
f AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE WHEN k = 1 THEN '' WHEN k = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS rep FROM d WHERE k <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, rep) AS i, left(role, 1) AS ini FROM f),
g AS (SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS cut, lag(ini) OVER (PARTITION BY conv_id ORDER BY i) AS last_ini FROM o),
r AS (SELECT *, blank OR again AS gone, CASE WHEN cut THEN {UNFINISHED} ELSE 0 END AS x FROM g),
s AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate, count(*) FILTER (cut AND NOT blank AND NOT again) AS truncated, count(*) FILTER (last_ini IS NOT NULL AND last_ini || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id),
v AS (SELECT conv_id, n AS i, 0 AS c0, 6 AS c1, 3 AS c2, 0 AS c3, '' AS a0, 'II' AS a1, 'I' AS a2, '' AS a3 FROM s
 UNION ALL SELECT conv_id, i - 1, v0.c, v1.c, v2.c, v3.c, v0.a, v1.a, v2.a, v3.a FROM (SELECT conv_id, i, {_sql_inserted(0)} AS v0, {_sql_inserted(1)} AS v1, {_sql_inserted(2)} AS v2, {_sql_inserted(3)} AS v3
 FROM (SELECT v.conv_id, v.i, {_sql_row(0)} AS e0, {_sql_row(1)} AS e1, {_sql_row(2)} AS e2, {_sql_row(3)} AS e3 FROM v JOIN r ON r.conv_id IS NOT DISTINCT FROM v.conv_id AND r.i = v.i))),
best AS (SELECT conv_id, c0 AS cost, a0 AS audit FROM v WHERE i = 0),
e AS (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS p FROM best),
w AS (SELECT conv_id, p, substr(audit, p, 1) AS e, length(replace(substr(audit, 1, p), 'I', '')) AS i, length(replace(substr(audit, 1, p), 'D', '')) AS out FROM e),
t AS (SELECT w.conv_id, p, w.e, out, r.role, r.text, max(CASE WHEN w.e = 'K' AND out = 1 AND r.ini = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY w.conv_id) AS off FROM w LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i AND w.e <> 'I' WHERE w.e <> 'D'),
z AS (SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (out - off) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END, chr(10) ORDER BY p) AS repaired FROM t GROUP BY conv_id)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM c.conv_id
"""
