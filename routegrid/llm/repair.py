"""Conversation structure repair: the cheapest edits that make roles alternate.

A conversation is ``s?(ua)+`` in role initials, or nothing.  Node (i, state) of the edit lattice
stands for i rows read and what was written last; edits are its edges.  A bidirectional Dijkstra
search goes over it: a forward and a reverse heap, until no cheaper or equal crossing can come.

A conversation of any length is cut into slices.  Within a slice the search runs between every
pair of states; slices are then joined two by two, so no task ever holds a whole conversation.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ranking import numbered
from ..plans.staging import stage

_WHITE = " \t\n\x0b\x0c\r"
_PIECE = 512  # letters of an audit that are told apart at once
_KEEP, _ROLE, _DELETE, _INSERT, _CUT = 0, 3, 4, 3, 3  # costs; the last is for a truncated row that stays
START, SYSTEM, USER, ASSISTANT = range(4)  # what was written last
_AFTER = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
_BEFORE = {state: [(q, x) for (q, x), to in _AFTER.items() if to == state] for state in range(4)}
ENDS = (START, ASSISTANT)
_WRITTEN = "ua"  # what an insertion or a new role can write


def _row_edits(code: str) -> Iterator[tuple[str, str | None, int]]:
    """(audit letter, role initial or None, cost) of what can be done with a row.

    ``code`` is the row's role initial (x: another), a capital if truncated, d if it has to go.
    """
    yield "D", None, _DELETE
    if code != "d":
        extra = _CUT if code.isupper() else 0
        if code.lower() != "x":
            yield "K", code.lower(), _KEEP + extra
        for role in _WRITTEN:
            yield "R", role, _ROLE + extra


@lru_cache(maxsize=1 << 14)
def cheapest(pattern: str, entry: int, exits: tuple[int, ...]) -> tuple[int, str] | None:
    """Least cost, then least audit, of the ways from ``entry`` over all rows to one of ``exits``.

    Heaps are ordered by cost and then by rows read: a free edge leads to a node that comes later
    in that order, so a node's audit is final when it is taken.  Of two ways of one cost between
    the same nodes neither audit begins the other (it would hold insertions for nothing), so the
    least prefix and the least suffix make the least whole.
    """
    n = len(pattern)

    def onward(i: int, q: int) -> Iterator[tuple[tuple[int, int], str, int]]:
        if i < n:
            for letter, role, cost in _row_edits(pattern[i]):
                to = q if role is None else _AFTER.get((q, role))
                if to is not None:
                    yield (i + 1, to), letter, cost
        for role in _WRITTEN:
            if (q, role) in _AFTER:
                yield (i, _AFTER[q, role]), "I", _INSERT

    def back(i: int, q: int) -> Iterator[tuple[tuple[int, int], str, int]]:
        if i:
            for letter, role, cost in _row_edits(pattern[i - 1]):
                if role is None:
                    yield (i - 1, q), letter, cost
                else:
                    for p, x in _BEFORE[q]:
                        if x == role:
                            yield (i - 1, p), letter, cost
        for p, x in _BEFORE[q]:
            if x in _WRITTEN:
                yield (i, p), "I", _INSERT

    ahead: dict[tuple[int, int], tuple[int, str]] = {(0, entry): (0, "")}
    behind: dict[tuple[int, int], tuple[int, str]] = {(n, q): (0, "") for q in exits}
    forward, reverse = [(0, 0, entry)], [(0, -n, q) for q in exits]
    taken_ahead: set[tuple[int, int]] = set()
    taken_behind: set[tuple[int, int]] = set()
    best: tuple[int, str] | None = None

    def crossing(found: tuple[int, str] | None, left: tuple[int, str], letter: str, cost: int, right: tuple[int, str]) -> tuple[int, str]:
        whole = (left[0] + cost + right[0], left[1] + letter + right[1])
        return whole if found is None or whole < found else found

    while forward and reverse and (best is None or forward[0][0] + reverse[0][0] <= best[0]):
        if forward[0][0] <= reverse[0][0]:
            cost, i, q = heappop(forward)
            if (i, q) in taken_ahead:
                continue
            taken_ahead.add((i, q))
            label = ahead[i, q]
            if (i, q) in taken_behind:
                best = crossing(best, label, "", 0, behind[i, q])
            for node, letter, step in onward(i, q):
                if node in taken_behind:
                    best = crossing(best, label, letter, step, behind[node])
                new = (cost + step, label[1] + letter)
                if node not in ahead or new < ahead[node]:
                    ahead[node] = new
                    heappush(forward, (new[0], *node))
        else:
            cost, negative, q = heappop(reverse)
            i = -negative
            if (i, q) in taken_behind:
                continue
            taken_behind.add((i, q))
            label = behind[i, q]
            if (i, q) in taken_ahead:
                best = crossing(best, ahead[i, q], "", 0, label)
            for node, letter, step in back(i, q):
                if node in taken_ahead:
                    best = crossing(best, ahead[node], letter, step, label)
                new = (cost + step, letter + label[1])
                if node not in behind or new < behind[node]:
                    behind[node] = new
                    heappush(reverse, (new[0], -node[0], node[1]))
    return best


def _ways(pattern: pd.Series, is_first: pd.Series, is_last: pd.Series) -> pd.Series:
    """The cheapest ways through a slice; exit -1 is any state a conversation may end in."""
    def through(rows: str, first: bool, last: bool) -> list[dict]:
        out = []
        for entry in (START,) if first else range(4):
            for exit_, exits in ([(-1, ENDS)] if last else [(q, (q,)) for q in range(4)]):
                if (way := cheapest(rows, entry, exits)) is not None:
                    out.append({"entry": entry, "exit": exit_, "cost": way[0], "audit": way[1]})
        return out
    return pd.Series([through(*x) for x in zip(pattern, is_first, is_last)])


def _text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def keyed(conversations: DataFrame) -> DataFrame:
    """(_conv, conv_id, turn, role, text): a key that no two conversations share; a null role or text is one space."""
    key = F.when(F.col("conv_id").isNull(), "").otherwise(F.concat(F.lit("="), F.col("conv_id").cast("string")))
    return conversations.select(key.alias("_conv"), "conv_id", "turn", _text("role").alias("role"), _text("text").alias("text"))


def damage(conversations: DataFrame) -> DataFrame:
    """Rows with planted faults, told by crc32(conv_id:turn) % 20: 0 is left out, 1 loses its text, 2 its
    full stops, question and exclamation marks, 3 comes twice, 4 has the role user.  Nulls count as one space."""
    fault = F.crc32(F.concat(_text("conv_id"), F.lit(":"), _text("turn")).cast("binary")) % 20
    text = F.when(F.col("_fault") == 1, "").when(F.col("_fault") == 2, F.regexp_replace(_text("text"), "[.!?]", "")).otherwise(_text("text"))
    return (
        conversations.select("conv_id", "turn", "role", "text", fault.alias("_fault")).where("_fault <> 0")
        .select("conv_id", "turn", F.when(F.col("_fault") == 4, "user").otherwise(_text("role")).alias("role"), text.alias("text"),
                F.explode(F.sequence(F.lit(1), F.when(F.col("_fault") == 3, 2).otherwise(1))).alias("_copy"))
        .drop("_copy")
    )


def repair(conversations: DataFrame, slice_rows: int = 512) -> tuple[DataFrame, DataFrame]:
    """(summary, rows): what each conversation of ``conversations(conv_id, turn, role, text)`` needs, and what it becomes.

    ``summary(_conv, conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit)``;
    ``rows(_conv, place, role, text)`` of the repaired conversation, place counted from 0.

    Rows stand by turn, nulls first; rows of one turn by role and text.  A null role or text is one
    space, all rows of a null conv_id are one conversation, texts may be of any length, extra
    columns are left behind, an empty table gives two empty ones.  Ties of cost go to the audit
    that is least in ASCII.  A conversation may hold any share of the rows: it is numbered by
    ranges, searched in slices of ``slice_rows`` and joined in pairs of slices.
    """
    given = keyed(conversations).withColumn("_spread", F.monotonically_increasing_id())  # parts rows that are all equal
    same = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))
    rows = stage(numbered(given, ["_conv"], ["turn", "role", "text", "_spread"], "pos").select(
        "_conv", "conv_id", (F.col("pos") - 1).cast("bigint").alias("pos"), "turn", "role", "text", same.alias("_same")))
    slices = stage(_slices(rows, slice_rows))
    way = stage(_joined(slices))
    return _summary(rows, slices, way), _rewritten(rows, way)


def _slices(rows: DataFrame, slice_rows: int) -> DataFrame:
    """(_conv, slice, pattern, initials, blank, duplicate, truncated) of up to ``slice_rows`` rows each."""
    text = F.rtrim(F.col("text"), F.lit(_WHITE))
    initial = F.substring("role", 1, 1)
    once = rows.groupBy("_conv", "_same").agg(F.min("pos").alias("_first"))
    fault = F.when(F.col("_blank"), "blank").when(F.col("pos") > F.col("_first"), "duplicate").when(F.col("_open"), "truncated")
    code = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("x")
    code = F.when(F.col("fault").isin("blank", "duplicate"), "d").when(F.col("fault") == "truncated", F.upper(code)).otherwise(code)
    judged = (
        rows.select("_conv", "pos", "_same", initial.alias("initial"), (text == "").alias("_blank"), (~F.right(text, F.lit(1)).isin(".", "!", "?")).alias("_open"))
        .join(once, ["_conv", "_same"])
        .select("_conv", F.expr(f"pos div {slice_rows}").alias("slice"), "pos", "initial", fault.alias("fault"))
        .withColumn("code", code)
    )
    counts = [F.count_if(F.col("fault") == x).alias(x) for x in ("blank", "duplicate", "truncated")]
    listed = F.array_sort(F.collect_list(F.struct("pos", "code", "initial"))).alias("_rows")
    return judged.groupBy("_conv", "slice").agg(listed, *counts).select(
        "_conv", "slice", F.array_join(F.col("_rows.code"), "").alias("pattern"), F.col("_rows.initial").alias("initials"),
        "blank", "duplicate", "truncated")


def _joined(slices: DataFrame) -> DataFrame:
    """(_conv, cost, audit): ways through slices, joined two by two until one slice is left of each conversation."""
    search = F.pandas_udf(_ways, "array<struct<entry:int,exit:int,cost:bigint,audit:string>>")
    last = F.max("slice").over(Window.partitionBy("_conv"))
    ways = slices.select("_conv", "slice", "pattern", last.alias("_last")).select(
        "_conv", "slice", F.explode(search("pattern", F.col("slice") == 0, F.col("slice") == F.col("_last"))).alias("w")).select("_conv", "slice", "w.*")
    ways = stage(ways)
    top = ways.agg(F.max("slice")).first()[0] or 0
    while top:
        half = F.expr("slice div 2").alias("slice")
        left = ways.where("slice % 2 = 0").select("_conv", half, "entry", F.col("exit").alias("_at"), F.col("cost").alias("_cost"), F.col("audit").alias("_audit"))
        right = ways.where("slice % 2 = 1").select("_conv", half, F.col("entry").alias("_at"), "exit", "cost", "audit")
        both = left.join(right, ["_conv", "slice", "_at"]).groupBy("_conv", "slice", "entry", "exit").agg(
            F.min(F.struct((F.col("_cost") + F.col("cost")).alias("cost"), F.concat("_audit", "audit").alias("audit"))).alias("w"))
        alone = left.where("_at = -1").select("_conv", "slice", "entry", F.col("_at").alias("exit"), F.col("_cost").alias("cost"), F.col("_audit").alias("audit"))
        ways = stage(both.select("_conv", "slice", "entry", "exit", "w.*").unionByName(alone))
        top //= 2
    return ways.where(f"entry = {START} AND exit = -1").select("_conv", "cost", "audit")


def _summary(rows: DataFrame, slices: DataFrame, way: DataFrame) -> DataFrame:
    turns = rows.groupBy("_conv").agg(
        F.first("conv_id").alias("conv_id"),
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("bigint").alias("gaps"))
    legal = F.concat(F.lag("_end").over(Window.partitionBy("_conv").orderBy("slice")), F.col("initials")[0])
    inside = F.expr("size(filter(sequence(2, size(initials), 1), i -> concat(initials[i - 2], initials[i - 1]) NOT IN ('su', 'ua', 'au')))")
    faults = (
        slices.withColumn("_end", F.element_at("initials", -1))
        .withColumn("_seam", F.coalesce((~legal.isin("su", "ua", "au")).cast("bigint"), F.lit(0)))
        .withColumn("_inside", F.when(F.size("initials") > 1, inside).otherwise(0))
        .groupBy("_conv").agg(*[F.sum(x).alias(x) for x in ("blank", "duplicate", "truncated")], F.sum(F.col("_seam") + F.col("_inside")).alias("illegal"))
    )
    return turns.join(faults, "_conv").join(way, "_conv")


def _rewritten(rows: DataFrame, way: DataFrame) -> DataFrame:
    """(_conv, place, role, text): audits cut into pieces, each letter with the rows read and written before it."""
    pieces = way.where("audit <> ''").select("_conv", F.posexplode(F.expr(
        f"transform(sequence(0, length(audit) - 1, {_PIECE}), x -> substring(audit, x + 1, {_PIECE}))")).alias("_n", "piece"))

    def without(piece: Column, letter: str) -> Column:
        return F.length(F.replace(piece, F.lit(letter), F.lit("")))

    before = Window.partitionBy("_conv").orderBy("_n").rowsBetween(Window.unboundedPreceding, -1)
    read, written = without(F.col("piece"), "I"), without(F.col("piece"), "D")
    pieces = pieces.select(
        "_conv", "piece", F.coalesce(F.sum(read).over(before), F.lit(0)).alias("_read"), F.coalesce(F.sum(written).over(before), F.lit(0)).alias("_written"),
        (F.sum(written).over(Window.partitionBy("_conv")) % 2).alias("_odd"))
    letters = pieces.select("*", F.explode(F.sequence(F.lit(1), F.length("piece"))).alias("_k")).select(
        "_conv", "_odd", F.substring("piece", F.col("_k"), 1).alias("letter"),
        (F.col("_read") + without(F.substring("piece", F.lit(1), F.col("_k") - 1), "I")).alias("_row"),
        (F.col("_written") + without(F.substring("piece", F.lit(1), F.col("_k") - 1), "D")).alias("place")).where("letter <> 'D'")
    # an odd number of rows starts with a system row, then user and assistant take turns
    role = F.when((F.col("place") - F.col("_odd")) % 2 == 0, "user").otherwise("assistant")
    edits = letters.select("_conv", "place", "letter", role.alias("_role"), F.when(F.col("letter") == "I", -1 - F.col("place")).otherwise(F.col("_row")).alias("pos"))
    return edits.join(rows.select("_conv", "pos", "role", "text"), ["_conv", "pos"], "left").select(
        "_conv", "place", F.when(F.col("letter") == "K", F.col("role")).otherwise(F.col("_role")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def repaired_conversations(conversations: DataFrame, damaged: DataFrame) -> DataFrame:
    """One row per conv_id of ``conversations``: the summary of its rows in ``damaged`` and the text of what they become.

    ``text`` has one line ``role:text`` per repaired row.  A conversation without rows has zeros and empty texts.
    """
    summary, rows = repair(damaged)
    line = F.concat("role", F.lit(":"), "text")
    texts = rows.groupBy("_conv").agg(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))).alias("_lines")).select(
        "_conv", F.array_join(F.col("_lines.line"), "\n").alias("text"))
    whole = keyed(conversations).select("_conv", "conv_id").distinct().join(summary.drop("conv_id"), "_conv", "left").join(texts, "_conv", "left")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return whole.select("conv_id", *[F.coalesce(x, F.lit(0)).cast("bigint").alias(x) for x in numbers],
                        *[F.coalesce(x, F.lit("")).alias(x) for x in ("audit", "text")])
