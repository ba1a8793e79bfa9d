"""Conversation structure repair: cheapest edits by a run-length dynamic program over min-plus matrices."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolake.llm.common import discard, keyed_join, materialized

#: What a value that is missing counts as.
MISSING = " "
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Rows of the sorted table that one task orders, at most (about).
PART_ROWS = 1 << 17
#: Fewer rows than these are not dealt to another task.
SMALL_PART_ROWS = 1 << 13
#: Adjacent role initials that may follow each other.
LEGAL = ("su", "ua", "au")

# The roles that are left are `(s?(ua)+)?`. States: nothing yet, behind s, behind u, behind a.
EMPTY, AFTER_S, AFTER_U, AFTER_A = range(4)
STATES = range(4)
FAR = 1 << 50
#: Which role may come next (`s` only by keeping one at the very start), and where it leads.
NEXT_ROLE = {EMPTY: "user", AFTER_S: "user", AFTER_U: "assistant", AFTER_A: "user"}
NEXT = {EMPTY: AFTER_U, AFTER_S: AFTER_U, AFTER_U: AFTER_A, AFTER_A: AFTER_U}
KEPT = {(EMPTY, "s"): AFTER_S, (EMPTY, "u"): AFTER_U, (AFTER_S, "u"): AFTER_U, (AFTER_U, "a"): AFTER_A, (AFTER_A, "u"): AFTER_U}
#: A row's symbol: initial of its role (o: another one), a capital if truncated, x if it has to go.
SYMBOLS = "suaoSUAOx"

Costs = tuple[int, ...]


def _closed(ahead: Costs) -> Costs:
    """Least cost from each state when roles may be inserted first."""
    out = list(ahead)
    for state in STATES:
        there, paid = state, 0
        for _ in STATES:
            there, paid = NEXT[there], paid + INSERT
            out[state] = min(out[state], paid + ahead[there])
    return tuple(min(FAR, c) for c in out)


#: Cost from each state behind the last row.
END: Costs = _closed((0, FAR, FAR, 0))


def choices(symbol: str, state: int) -> list[tuple[str, int, int]]:
    """Edits of one row without insertions, in the order of their initials: initial, cost, next state."""
    out = [("D", DELETE, state)]
    if symbol != "x":
        more = TRUNCATED if symbol.isupper() else 0
        if (state, symbol.lower()) in KEPT:
            out.append(("K", KEEP + more, KEPT[state, symbol.lower()]))
        out.append(("R", REROLE + more, NEXT[state]))
    return out


@cache
def _step(symbol: str, behind: Costs) -> tuple[int, Costs]:
    """Costs before a row from those behind it; both are given above their least one, whose change comes first."""
    ahead = _closed(tuple(min(cost + behind[there] for _, cost, there in choices(symbol, state)) for state in STATES))
    least = min(ahead)
    return least, tuple(c - least for c in ahead)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[:, :, None] + b[None]).min(axis=1), FAR)


@cache
def power(symbol: str, bit: int) -> np.ndarray:
    """Min-plus matrix of ``2 ** bit`` equal rows: cost from each state before to each state behind them."""
    if bit:
        half = power(symbol, bit - 1)
        return _times(half, half)
    out = np.full((4, 4), FAR, np.int64)
    for target in STATES:
        # One column: only ``target`` counts behind the row.
        behind = tuple(0 if s == target else FAR for s in STATES)
        ahead = _closed(tuple(min(cost + behind[there] for _, cost, there in choices(symbol, state)) for state in STATES))
        out[:, target] = ahead
    return out


def across(symbol: str, length: int, behind: Costs) -> Costs:
    """Costs before a run of equal rows from those behind it, by the binary powers of its matrix."""
    costs, bit = np.array(behind, np.int64), 0
    while length >> bit:
        if length >> bit & 1:
            costs = np.minimum((power(symbol, bit) + costs).min(axis=1), FAR)
        bit += 1
    return tuple(costs.tolist())


def costs_at_runs(symbols: str, lengths: list[int], behind: Costs) -> list[Costs]:
    """Costs before each run, and behind the last one."""
    out = [behind]
    for symbol, length in zip(reversed(symbols), reversed(lengths), strict=True):
        out.append(across(symbol, length, out[-1]))
    return out[::-1]


def unrolled(symbols: str, lengths: list[int], state: int, behind: Costs, last: bool) -> tuple[list[str], list[str], int]:
    """The edits of each row of some runs from ``state`` on, insertions before it included; the initials that they give
    (``-`` where the row's own stays or nothing does); the state behind them.

    Each step takes the first initial by which the least cost can still be reached, which makes the audit the least one of all that
    cost least: edit and state settle the next state. With ``last`` the edits of the last row include insertions behind it.
    """
    edits: list[str] = []
    roles: list[str] = []
    at_runs = costs_at_runs(symbols, lengths, behind)
    for symbol, length, after in zip(symbols, lengths, at_runs[1:], strict=True):
        # Costs above their least one at each row of the run, from its end, and how much the least one changes there.
        least = min(after)
        level, change = [tuple(c - least for c in after)], []
        for _ in range(length):
            up, costs = _step(symbol, level[-1])
            change.append(up)
            level.append(costs)
        for left in range(length, 0, -1):
            before, follow, up, own, given = level[left], level[left - 1], change[left - 1], "", ""
            while own[-1:] in ("", "I"):
                kinds = [(name, cost + follow[there], there) for name, cost, there in choices(symbol, state)]
                kinds.append(("I", INSERT + before[NEXT[state]] + up, NEXT[state]))
                goal = before[state] + up
                name, _, there = min(k for k in kinds if k[1] == goal)
                own += name
                given += NEXT_ROLE[state][0] if name in "IR" else "-"
                state = there
            edits.append(own)
            roles.append(given)
    while last and END[state]:
        edits[-1] += "I"
        roles[-1] += NEXT_ROLE[state][0]
        state = NEXT[state]
    return edits, roles, state


def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with planted faults, by a hash of conversation and turn: of 20 rows one is dropped, one loses its
    text, one its full stops, one is there twice, one is the user's. Missing values count as one space."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(MISSING))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    text, times = part("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    role = F.when(kind == 4, "user").otherwise(part("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), times)).alias("_once")).drop("_once")


def _symbol() -> Column:
    initial = F.substring("_role", 1, 1)
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    return F.when(F.col("_fault").isin("blank", "duplicate"), "x").when(F.col("_fault") == "truncated", F.upper(known)).otherwise(known)


def ordered_rows(rows: DataFrame) -> DataFrame:
    """All rows in order with their faults, written down: ``_conv, _turn, _role, _text, _fault, _symbol, _at``.

    ``_at`` grows in the order of conversation, turn (nulls first), and a hash of role and text. Rows are dealt in ranges of that order,
    so a long conversation lies in as many files as it fills. Rows alike in role and text are found by grouping hashes.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(MISSING))
    rows = rows.select(F.col("conv_id").cast("long").alias("_conv"), F.col("turn").alias("_turn"), part("role").alias("_role"), part("text").alias("_text"))
    same = F.sha2(F.concat(F.length("_role").cast("string"), F.lit(":"), "_role", "_text"), 256)
    rows = materialized(rows.select("*", same.alias("_same"), F.monotonically_increasing_id().alias("_nth")), "turns")
    place = F.struct(F.col("_turn").isNotNull().alias("known"), F.col("_turn").alias("turn"), F.col("_nth").alias("nth"))
    ending = F.right(F.rtrim("_text", F.lit(" \t\n\x0b\x0c\r")), F.lit(1))
    # A null conversation goes by a name that no number has.
    named = rows.withColumns({"_name": F.coalesce(F.col("_conv").cast("string"), F.lit("")), "_ending": ending})
    shown = named.where("_ending <> ''").groupBy("_name", "_same").agg(F.min(place).alias("_first"), F.count("*").alias("_n"))
    shown = materialized(shown.where("_n > 1").drop("_n"), "repeated")
    joined = keyed_join(named, shown, ["_name", "_same"], "left", ["_nth"])
    end = F.col("_ending")
    fault = F.when(end == "", "blank").when(F.col("_first") < place, "duplicate").when(~end.isin(".", "!", "?"), "truncated").otherwise("none")
    joined = joined.withColumn("_fault", fault)
    count, dealt = rows.count(), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, -(-count // PART_ROWS), min(dealt, -(-count // SMALL_PART_ROWS)))
    order = [F.asc_nulls_first("_conv"), F.asc_nulls_first("_turn"), "_same", "_nth"]
    placed = joined.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = placed.select("_conv", "_turn", "_role", "_text", "_fault", _symbol().alias("_symbol"), F.monotonically_increasing_id().alias("_at"))
    placed = materialized(placed, "ordered")
    for table in (rows, shown):
        discard(table)
    return placed


RUNS = "_conv long, _from long, _letters string, _lengths array<int>, _initials string, _illegal long"


def segments(ordered: DataFrame) -> DataFrame:
    """Consecutive rows of one conversation as far as a batch holds them, with equal symbols collapsed: ``RUNS``.

    ``_from`` is the first row's ``_at``; ``_initials`` are the first and the last row's, ``_illegal`` counts pairs in between.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            at = batch.column("_at").to_numpy()
            conv = batch.column("_conv").fill_null(0).to_numpy()
            none = batch.column("_conv").is_null().to_numpy(zero_copy_only=False)
            symbol, initial = (np.array(batch.column(c).to_pylist()) for c in ("_symbol", "_initial"))
            new = np.ones(n, bool)
            new[1:] = (conv[1:] != conv[:-1]) | (none[1:] != none[:-1]) | (at[1:] != at[:-1] + 1)
            turned = new.copy()
            turned[1:] |= symbol[1:] != symbol[:-1]
            first, runs = np.flatnonzero(new), np.flatnonzero(turned)
            lengths = np.diff(runs, append=n)
            edges = np.append(np.searchsorted(runs, first), len(runs))
            bad = np.zeros(n, np.int64)
            pairs = np.char.add(initial[:-1], initial[1:]) if n > 1 else np.zeros(0, "U2")
            bad[1:] = ~np.isin(pairs, LEGAL)
            bad[first] = 0
            letters = "".join(symbol[runs])
            ends = np.append(first[1:], n) - 1
            yield pa.RecordBatch.from_arrays(
                [batch.column("_conv").take(pa.array(first)), pa.array(at[first]),
                 pa.array([letters[a:b] for a, b in zip(edges, edges[1:], strict=False)]), pa.ListArray.from_arrays(edges.astype(np.int32), lengths.astype(np.int32)),
                 pa.array([f"{a}{b}" for a, b in zip(initial[first], initial[ends], strict=True)]), pa.array(np.add.reduceat(bad, first))],
                names=["_conv", "_from", "_letters", "_lengths", "_initials", "_illegal"],
            )

    # An initial of one letter for every row; roles without a letter count as a space.
    initial = F.coalesce(F.nullif(F.substring("_role", 1, 1), F.lit("")), F.lit(MISSING)).alias("_initial")
    return ordered.select("_conv", "_at", "_symbol", initial).mapInArrow(run, RUNS)


def _streamed(table: DataFrame, descending: bool, first, step, schema: str, columns: list[str]) -> DataFrame:
    """A fold over the segments of each conversation, in a task that sees them one after the other and keeps one value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, value, begun = None, None, False
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if not begun or row["_conv"] != conv:
                    conv, value, begun = row["_conv"], first(), True
                value, result = step(value, row)
                out.append({"_conv": conv, "_from": row["_from"], **result})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema([(n, k) for n, k in kinds]))

    kinds = [("_conv", pa.int64()), ("_from", pa.int64()), *columns]
    order = F.desc("_from") if descending else F.asc("_from")
    return table.repartition("_conv").sortWithinPartitions("_conv", order).mapInArrow(run, f"_conv long, _from long, {schema}")


def _ahead(long: DataFrame) -> DataFrame:
    """Costs behind each segment of the conversations that have several."""

    def step(value: Costs, row: dict) -> tuple[Costs, dict]:
        return costs_at_runs(row["_letters"], row["_lengths"], value)[0], {"_behind": list(value), "_last": value is END}

    return _streamed(long, True, lambda: END, step, "_behind array<long>, _last boolean", [("_behind", pa.list_(pa.int64())), ("_last", pa.bool_())])


def _entered(exits: DataFrame) -> DataFrame:
    """The state in which each segment is entered, and whether its first row and the one before may not follow each other."""

    def step(value: tuple, row: dict) -> tuple[tuple, dict]:
        state, before = value
        seam = before is not None and before + row["_initials"][0] not in LEGAL
        return (row["_exits"][state], row["_initials"][1]), {"_state": state, "_seam": int(seam)}

    return _streamed(exits, False, lambda: (EMPTY, None), step, "_state int, _seam long", [("_state", pa.int32()), ("_seam", pa.int64())])


def _exits(long: DataFrame) -> DataFrame:
    """For each state in which a segment may be entered, the one in which its cheapest edits leave it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            out = [[unrolled(r["_letters"], r["_lengths"], state, tuple(r["_behind"]), False)[2] for state in STATES] for r in rows]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("_conv", "_from", "_initials")), pa.array(out, pa.list_(pa.int32()))], names=["_conv", "_from", "_initials", "_exits"])

    return long.mapInArrow(run, "_conv long, _from long, _initials string, _exits array<int>")


def _edits(parts: DataFrame) -> DataFrame:
    """Edits and the initials they give, an item for each row of a segment, with their cost and the segment's illegal pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edits, roles, costs, illegal = [], [], [], []
            for r in batch.to_pylist():
                alone = r["_behind"] is None
                behind, state = (END, EMPTY) if alone else (tuple(r["_behind"]), r["_state"])
                last = alone or r["_last"]
                own, given, end = unrolled(r["_letters"], r["_lengths"], state, behind, last)
                edits.append(own)
                roles.append(given)
                costs.append(costs_at_runs(r["_letters"], r["_lengths"], behind)[0][state] - (0 if last else behind[end]))
                illegal.append(r["_illegal"] + (0 if alone else r["_seam"]))
            many = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("_conv"), batch.column("_from"), pa.array(edits, many), pa.array(roles, many), pa.array(costs, pa.int64()), pa.array(illegal, pa.int64())],
                names=["_conv", "_from", "_edits", "_roles", "_cost", "_illegal"],
            )

    return parts.mapInArrow(run, "_conv long, _from long, _edits array<string>, _roles array<string>, _cost long, _illegal long")


def plan_edits(ordered: DataFrame) -> DataFrame:
    """``_conv, _from, _edits, _roles, _cost, _illegal`` of every segment, written down.

    Conversations of one segment are settled by themselves. In those of several, costs are handed back from segment to segment, then
    the states in which segments are left are handed forward; each of these folds keeps one small value, and the
    rows themselves are edited segment by segment.
    """
    runs = materialized(segments(ordered), "runs")
    # At most two segments a batch are parts of a longer conversation.
    several = runs.groupBy("_conv").count().where("count > 1").select(F.col("_conv").alias("_other"))
    long = materialized(runs.join(several, F.col("_conv").eqNullSafe(F.col("_other")), "left_semi"), "long")
    ahead = materialized(_ahead(long), "ahead")
    with_costs = materialized(long.join(ahead.drop("_conv"), "_from"), "costs")
    entered = materialized(_entered(_exits(with_costs)), "entered")
    known = with_costs.select("_from", "_behind", "_last").join(entered.select("_from", "_state", "_seam"), "_from")
    planned = materialized(_edits(runs.join(known, "_from", "left")), "edits")
    for table in (runs, long, ahead, with_costs, entered):
        discard(table)
    return planned


def repaired_rows(ordered: DataFrame, planned: DataFrame) -> DataFrame:
    """Rows of the repaired conversations: ``conv_id, at, sub, turn, role, text, edit`` (``K``, ``R`` or ``I``); ``at, sub`` order them.

    Inserted rows have no turn. Rows and their edits meet by position, so no conversation meets in one task.
    """
    rows = planned.select("_from", F.posexplode(F.arrays_zip("_edits", "_roles")).alias("_row", "_own"))
    rows = rows.select((F.col("_from") + F.col("_row")).alias("_at"), F.col("_own._edits").alias("_names"), F.col("_own._roles").alias("_given"))
    both = ordered.select("_conv", "_turn", "_role", "_text", "_at").join(rows.where("_names <> 'D'"), "_at")
    each = both.select("*", F.explode(F.sequence(F.lit(1), F.length("_names"))).alias("_sub"))
    edit, given = F.expr("substring(_names, _sub, 1)"), F.expr("substring(_given, _sub, 1)")
    role = F.when(given == "u", "user").when(given == "a", "assistant").otherwise(F.col("_role"))
    return each.where(edit != "D").select(
        F.col("_conv").alias("conv_id"), F.col("_at").alias("at"), F.col("_sub").alias("sub"), F.when(edit != "I", F.col("_turn")).alias("turn"),
        role.alias("role"), F.when(edit == "I", "").otherwise(F.col("_text")).alias("text"), edit.alias("edit"),
    )


def fault_counts(ordered: DataFrame, planned: DataFrame) -> DataFrame:
    """Per conversation with rows: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit``."""
    faults = ("blank", "duplicate", "truncated")
    turns = ordered.groupBy("_conv", "_turn").agg(*(F.count_if(F.col("_fault") == f).alias(f) for f in faults))
    gaps = F.coalesce(F.max("_turn") - F.min("_turn") + 1 - F.count("_turn"), F.lit(0)).cast("long")
    counts = turns.groupBy("_conv").agg(gaps.alias("gaps"), *(F.sum(f).alias(f) for f in faults))
    pieces = F.array_sort(F.collect_list(F.struct("_from", F.array_join("_edits", "").alias("_piece"))))
    audit = F.array_join(F.transform(pieces, lambda p: p["_piece"]), "")
    plans = planned.groupBy(F.col("_conv").alias("_of")).agg(F.sum("_illegal").alias("illegal"), F.sum("_cost").alias("cost"), audit.alias("audit"))
    both = counts.join(plans, F.col("_conv").eqNullSafe(F.col("_of")))
    return both.select(F.col("_conv").alias("conv_id"), "gaps", *faults, "illegal", "cost", "audit")


def repaired(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``fault_counts`` per conversation and ``repaired_rows``, for rows with ``conv_id`` (an integer), ``turn``, ``role``, ``text``.

    A conversation's rows are taken by turn, nulls first (rows of one turn in the order of a hash of role and text). A row's fault
    is the first of: blank (no text), duplicate (role and text were there before), truncated (its last character ends no
    sentence). Keeping a row costs 0, giving it to user or assistant 1, deleting it 2 (blank and duplicate rows have to go), inserting
    an empty row of user or assistant 5; each truncated row that stays costs 5 more. The cheapest edits after which initials of roles
    match ``(s?(ua)+)?`` are taken, of several the ones whose initials come first.

    Missing roles and texts count as one space. Rows without a conversation are one conversation. Repeated rows are duplicates. Other
    columns, whatever their names, are ignored. An empty table gives empty results.
    """
    ordered = ordered_rows(conversations)
    planned = plan_edits(ordered)
    return fault_counts(ordered, planned), repaired_rows(ordered, planned)


def digests(rows: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256``: hash of the lines ``role:text`` of each conversation, fed row by row as they pass in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, out = None, None, []
        for batch in batches:
            for own, line in zip(batch.column("conv_id").to_pylist(), batch.column("_line").to_pylist(), strict=True):
                if state is None or own != conv:
                    if state is not None:
                        out.append((conv, state.hexdigest()))
                    conv, state = own, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(line.encode())
            yield _pairs(out)
            out = []
        if state is not None:
            yield _pairs([(conv, state.hexdigest())])

    def _pairs(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], pa.int64()), pa.array([h for _, h in out], pa.string())], names=["conv_id", "repaired_sha256"])

    lines = rows.select("conv_id", "at", "sub", F.concat("role", F.lit(":"), "text").alias("_line"))
    return lines.repartition("conv_id").sortWithinPartitions("conv_id", "at", "sub").drop("at", "sub").mapInArrow(run, "conv_id long, repaired_sha256 string")
