"""Cheapest repair of conversations by the auction algorithm for shortest paths.

A conversation is a lattice. Its nodes are the number of rows read and the role that the repaired part ends with: none,
system, user or assistant. Its arcs are edits, each with its initial and an integer cost: Keep 0, Rerole to user or assistant 1, Delete 2,
Insert an empty user or assistant message 5; a truncated row that isn't deleted adds 5, and blank or duplicate rows
can only be deleted. The auction holds a price per node and a path from the start. The path is extended by the cheapest arc, cost
plus price behind it, if that equals the price of its last node; otherwise the price rises to it and the path loses
that node. When the path reaches the end, the start's price is the least cost and no arc is cheaper than the prices differ.
Every cheapest path then consists of tight arcs, those that cost just the difference, and the one with the least initials is
traced from the start over tight arcs that lead to the end.

Rows of a conversation go by turn, nulls first, then by role and by the hash of role and text. Conversations of at most BLOCK
rows and CHARS code points are repaired as they stream by, sorted, through the tasks that the shuffle deals them to. A longer one is
cut into blocks of BLOCK rows by position: the auction gives each block's cheapest edits from every role before to every role after it, these are
the arcs of a coarser lattice of up to BLOCK blocks, and so on until one block is left. That works on one byte a row; then the
rows of the conversation stream through one task, which holds one row at a time, as its hash needs them in order.

Defined results: a null conversation id is a conversation of its own, null roles and texts are one space, and a null turn is a turn before all
others that no gap counts. Only the first letter of a role decides: s, u, a; any other, or an empty role, can be reroled or deleted.
Repeated rows are duplicates. A conversation without rows has cost 0, an empty audit and no messages. An empty table gives an empty one.
Other columns are ignored, whatever their names. Texts may be of any length.
"""

from __future__ import annotations

import functools
import hashlib
import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessellex.llm.common import join_groups, written
from tessellex.operators.sizing import is_small, join_measured

BLOCK = 64
CHARS = 2_000_000
SPACE = " \t\n\x0b\x0c\r"
ENDS = ".!?"

# What the repaired part ends with.
NONE, SYSTEM, USER, ASSISTANT = range(4)
KEPT = {(NONE, "s"): SYSTEM, (NONE, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
NEXT = {NONE: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
NAMES = {USER: "user", ASSISTANT: "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5

Arc = tuple[int, str, int]  # cost, initials, node behind it
Lattice = list[list[Arc]]


def auction(lattice: Lattice, start: int, end: int, prices: list[float]) -> float:
    """Cost of the cheapest path, infinite if there is none; raises ``prices`` to what proves it.

    At first no price may exceed an arc's cost plus the price behind it, as zeros don't. Cycles must cost something and lead on to the end.
    """
    path = [start]
    while (node := path[-1]) != end:
        best, ahead = math.inf, -1
        for cost, _, to in lattice[node]:
            if cost + prices[to] < best:
                best, ahead = cost + prices[to], to
        if prices[node] < best:
            prices[node] = best
            if node != start:
                path.pop()
        elif ahead < 0:
            return math.inf
        else:
            path.append(ahead)
    return prices[start] - prices[end]


def trace(lattice: Lattice, start: int, end: int, prices: list[float]) -> str:
    """Least initials of a path of tight arcs from start to end.

    No initials of two arcs of one node begin with each other, so the least arc that leads to the end is part of the least path.
    """
    tight = lambda node: iter(sorted((x, to) for cost, x, to in lattice[node] if prices[node] == cost + prices[to]))
    path, initials, left, dead = [start], [], [tight(start)], set()
    while path[-1] != end:
        for x, to in left[-1]:
            if to not in dead:
                path.append(to)
                initials.append(x)
                left.append(tight(to))
                break
        else:
            dead.add(path.pop())
            left.pop()
            initials.pop()
    return "".join(initials)


def _rows_lattice(marks: str, states: set[int], finish: bool) -> Lattice:
    """Node ``4 * rows read + state``; with ``finish`` inserts may follow the last row, and the last node is the end."""
    lattice: Lattice = [[] for _ in range(4 * len(marks) + 5)]
    last = len(marks)
    for at in range(last + finish):
        for state in states:
            node = lattice[4 * at + state]
            if (after := NEXT[state]) in states:
                node.append((INSERT, "I", 4 * at + after))
            if at == last:
                if state in (NONE, ASSISTANT):
                    node.append((0, "", 4 * last + 4))
                continue
            mark = marks[at]
            node.append((DELETE, "D", 4 * at + 4 + state))
            if mark != "x":
                extra = TRUNCATED * mark.isupper()
                if (kept := KEPT.get((state, mark.lower()))) in states:
                    node.append((extra, "K", 4 * at + 4 + kept))
                if after in states:
                    node.append((REROLE + extra, "R", 4 * at + 4 + after))
    return lattice


@functools.lru_cache(100_000)
def settle(marks: str, start: int = NONE) -> tuple[int, str]:
    """Cost and initials of the cheapest edits of rows with these marks, with ties by ASCII.

    A mark is the first letter of the role, s, u, a or o for another, in upper case if the row is truncated; x is a row that must go.
    """
    lattice = _rows_lattice(marks, {NONE, SYSTEM, USER, ASSISTANT}, True)
    end = len(lattice) - 1
    prices = [0.0] * len(lattice)
    cost = auction(lattice, start, end, prices)
    return int(cost), trace(lattice, start, end, prices)


@functools.lru_cache(10_000)
def crossings(marks: str) -> list[tuple[int, int, int, str]]:
    """``(state before, state after, cost, initials)`` of the cheapest edits that read all rows of a block."""
    out = []
    for after in range(4):
        # Nothing leads back to the first two states, and what doesn't lead to the end must not be walked on.
        states = set(range(after + 1)) if after <= SYSTEM else {NONE, SYSTEM, USER, ASSISTANT}
        lattice = _rows_lattice(marks, states, False)
        end = 4 * len(marks) + after
        prices = [0.0] * len(lattice)
        for before in states:
            if (cost := auction(lattice, before, end, prices)) < math.inf:
                out.append((before, after, int(cost), trace(lattice, before, end, prices)))
    return out


def joined(blocks: list[list[tuple[int, int, int, str]]]) -> list[tuple[int, int, int, str]]:
    """The same for consecutive blocks, by the auction over the lattice that has a block's crossings as arcs."""
    lattice: Lattice = [[] for _ in range(4 * len(blocks) + 4)]
    for at, arcs in enumerate(blocks):
        for before, after, cost, initials in arcs:
            lattice[4 * at + before].append((cost, initials, 4 * at + 4 + after))
    out = []
    for after in range(4):
        end = 4 * len(blocks) + after
        prices = [0.0] * len(lattice)
        for before in range(4):
            if (cost := auction(lattice, before, end, prices)) < math.inf:
                out.append((before, after, int(cost), trace(lattice, before, end, prices)))
    return out


def finished(arcs: list[tuple[int, int, int, str]]) -> tuple[int, str]:
    """Cost and initials of a whole conversation from the crossings of its rows."""
    ends = [settle("", state) for state in range(4)]
    return min((cost + ends[after][0], initials + ends[after][1]) for before, after, cost, initials in arcs if before == NONE)


def applied(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """``(edit, role, text)`` of every message of the repaired conversation, in order."""
    state, rows = NONE, iter(rows)
    for edit in audit:
        if edit == "I":
            state = NEXT[state]
            yield edit, NAMES[state], ""
            continue
        role, text = next(rows)
        if edit == "K":
            state = KEPT[state, role[:1]]
            yield edit, role, text
        elif edit == "R":
            state = NEXT[state]
            yield edit, NAMES[state], text


def damage(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, gone`` with faults sown by the crc32 of ``conv_id:turn`` modulo 20.

    0 drops a row (it stays with ``gone``, so that its conversation is known), 1 empties its text, 2 removes ``[.!?]``, 3 repeats it, 4 sets role user.
    """
    blank = F.lit(" ")
    name = lambda c: F.coalesce(F.col(c).cast("string"), blank)
    rows = conversations.select(
        "conv_id", "turn", name("role").alias("role"), name("text").alias("text"),
        F.pmod(F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")), F.lit(20)).alias("_fault"),
    )
    text = F.when(F.col("_fault") == 1, "").when(F.col("_fault") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    sown = rows.select(
        "conv_id", "turn", F.when(F.col("_fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        (F.col("_fault") == 0).alias("gone"), F.when(F.col("_fault") == 3, 2).otherwise(1).alias("_n"),
    )
    return sown.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_n")))).drop("_n")


def _marked(rows: DataFrame) -> DataFrame:
    """Rows with a name of their conversation, their hash and their mark, but for duplicates."""
    conv = F.col("conv_id").cast("string")
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    first = F.substring("role", 1, 1)
    letter = F.when(first.isin("s", "u", "a"), first).otherwise("o")
    mark = F.when(bare == "", "x").when(F.substring(bare, -1, 1).isin(*ENDS), letter).otherwise(F.upper(letter))
    size = F.octet_length("role").cast("string")
    gone = F.coalesce(F.col("gone"), F.lit(False)) if "gone" in rows.columns else F.lit(False)
    return rows.select(
        F.when(conv.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), conv)).alias("_conv"),
        F.when(~gone, F.col("turn")).alias("_turn"), F.when(~gone, F.col("role")).alias("_role"), F.when(~gone, F.col("text")).alias("_text"),
        F.when(~gone, F.md5(F.concat(size, F.lit(":"), "role", "text").cast("binary"))).alias("_hash"),
        F.when(~gone, mark).alias("_mark"), "conv_id",
    )


ORDER = ("_turn", "_role", "_hash")
COUNTS = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint"
CROSSINGS = "array<struct<before int, after int, cost bigint, initials string>>"


def _unpacked(arcs) -> list[tuple[int, int, int, str]]:
    return [(a["before"], a["after"], a["cost"], a["initials"]) for a in arcs]


def _packed(arcs: list[tuple[int, int, int, str]]) -> list[dict]:
    return [dict(zip(("before", "after", "cost", "initials"), a)) for a in arcs]


def _long_audits(marked: DataFrame, long: DataFrame, small: bool, block: int) -> DataFrame:
    """``(_conv, _audit)`` of the conversations in ``long(_conv)``, on narrow rows; ``_audit`` has their counts as well, as JSON."""

    @F.pandas_udf(CROSSINGS)
    def arcs_of(rows: pd.Series) -> pd.Series:
        return pd.Series([_packed(crossings("".join(r["_mark"] for r in sorted(x, key=lambda r: r["_at"])))) for x in rows], dtype=object)

    @F.pandas_udf(CROSSINGS)
    def joined_arcs(parts: pd.Series) -> pd.Series:
        return pd.Series([_packed(joined([_unpacked(p["arcs"]) for p in sorted(x, key=lambda p: p["no"])])) for x in parts], dtype=object)

    @F.pandas_udf("struct<cost bigint, audit string>")
    def whole(arcs: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([finished(_unpacked(a)) for a in arcs], columns=["cost", "audit"])

    named = join_measured(marked.where("_mark is not null").drop("_text", "conv_id"), long.select("_conv"), "_conv", small, "left_semi")
    by = ["_conv", *ORDER]
    ranged = written(
        named.repartitionByRange(*by).sortWithinPartitions(*by)
        .select("_conv", "_turn", "_hash", "_mark", F.substring("_role", 1, 1).alias("_first"), F.spark_partition_id().alias("_part"),
                F.monotonically_increasing_id().alias("_id"))
    )
    parts = ranged.groupBy("_conv", "_part").agg(F.min("_id").alias("_from"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_conv").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    based = parts.withColumn("_base", F.coalesce(before, F.lit(0)) - F.col("_from")).drop("_from", "_n")
    at = join_measured(ranged, based, ["_conv", "_part"], is_small(based, F.lit(40))).withColumn("_at", F.col("_id") + F.col("_base"))
    placed = written(at.select("_conv", "_at", "_turn", "_hash", "_mark", "_first"))
    firsts = placed.groupBy("_conv", "_hash").agg(F.min("_at").alias("_seen"), F.count("*").alias("_n"))
    faults = join_groups(placed, firsts.where("_n > 1"), ["_conv", "_hash"], "_n", F.col("_at"))
    again = F.coalesce(F.col("_at") > F.col("_seen"), F.lit(False)) & (F.col("_mark") != "x")
    judged = written(
        faults.withColumn("_again", again).withColumn("_mark", F.when(again, "x").otherwise(F.col("_mark")))
        .select("_conv", "_at", "_turn", "_mark", "_first", "_again")
    )
    after = judged.select("_conv", (F.col("_at") - 1).alias("_at"), F.col("_first").alias("_next"))
    pairs = judged.join(after, ["_conv", "_at"], "left").withColumn("_pair", F.concat("_first", "_next"))
    turns = judged.select("_conv", "_turn").distinct().groupBy("_conv").agg(F.count("_turn").alias("_turns"))
    counts = pairs.groupBy("_conv").agg(
        F.max("_turn").alias("_max"), F.min("_turn").alias("_min"),
        F.count_if((F.col("_mark") == "x") & ~F.col("_again")).alias("blank"), F.count_if("_again").alias("duplicate"),
        F.count_if((F.col("_mark") != "x") & (F.col("_mark") == F.upper("_mark"))).alias("truncated"),
        F.count_if(F.col("_next").isNotNull() & ~F.col("_pair").isin("su", "ua", "au")).alias("illegal"),
    )
    gaps = F.coalesce(F.col("_max") - F.col("_min") + 1 - F.col("_turns"), F.lit(0)).cast("bigint").alias("gaps")
    counts = counts.join(turns, "_conv").select("_conv", gaps, "blank", "duplicate", "truncated", "illegal")
    level = written(
        judged.groupBy("_conv", F.floor(F.col("_at") / block).alias("no")).agg(F.collect_list(F.struct("_at", "_mark")).alias("rows"))
        .select("_conv", "no", arcs_of("rows").alias("arcs"))
    )
    while (level.agg(F.max("no")).first()[0] or 0) > 0:
        grouped = level.groupBy("_conv", F.floor(F.col("no") / block).alias("up")).agg(F.collect_list(F.struct("no", "arcs")).alias("parts"))
        level = written(grouped.select("_conv", F.col("up").alias("no"), joined_arcs("parts").alias("arcs")))
    fields = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    return level.withColumn("_w", whole("arcs")).select("_conv", "_w.*").join(counts, "_conv").select("_conv", F.to_json(F.struct(*fields)).alias("_audit"))


def _stream(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[object, dict, Iterator[tuple[str, str, str]]]]:
    """``(id, counts with cost and audit, repaired messages)`` of every conversation of sorted rows; the messages must be read before the next."""

    def rows() -> Iterator[tuple]:
        for b in batches:
            yield from zip(b["_conv"], b["_mark"], b["_role"], b["_text"], b["_hash"], b["_number"], b["_audit"], b["conv_id"])

    source = rows()
    ahead = [next(source, None)]

    def of(conv: str) -> Iterator[tuple]:
        while ahead[0] is not None and ahead[0][0] == conv:
            row = ahead[0]
            ahead[0] = next(source, None)
            yield row

    while ahead[0] is not None:
        own = of(ahead[0][0])
        ident = ahead[0][7]
        if ahead[0][6] is not None:  # a long conversation: its audit comes first
            known = json.loads(next(own)[6])
            yield ident, known, applied(known["audit"], ((r[2], r[3]) for r in own if isinstance(r[1], str)))
        else:
            here = [r for r in own if isinstance(r[1], str)]
            yield ident, *_short(here)
        for _ in own:
            pass


def _short(rows: list[tuple]) -> tuple[dict, Iterator[tuple[str, str, str]]]:
    marks, seen, duplicate = [], set(), 0
    for _, mark, _, _, key, *_ in rows:
        if key in seen and mark != "x":
            mark = "x"
            duplicate += 1
        seen.add(key)
        marks.append(mark)
    first = [r[2][:1] for r in rows]
    turns = {int(r[5]) for r in rows if r[5] is not None}
    cost, audit = settle("".join(marks))
    counts = {
        "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0,
        "blank": marks.count("x") - duplicate,
        "duplicate": duplicate,
        "truncated": sum(m != "x" and m.isupper() for m in marks),
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:])),
        "cost": cost,
        "audit": audit,
    }
    return counts, applied(audit, ((r[2], r[3]) for r in rows))


def _sorted(rows: DataFrame, block: int) -> DataFrame:
    """Rows of each conversation in order in one partition, the audit of a long one before them."""
    if block < 2:
        raise ValueError("a block needs two rows at least")
    marked = _marked(rows)
    sizes = marked.groupBy("_conv").agg(F.count("_mark").alias("_rows"), F.sum(F.length("_text")).alias("_chars"), F.first("conv_id").alias("conv_id"))
    long = written(sizes.where((F.col("_rows") > block) | (F.col("_chars") > CHARS)))
    every = marked.withColumn("_audit", F.lit(None).cast("string"))
    if not long.isEmpty():
        audits = _long_audits(marked, long, is_small(long, F.lit(64)), block).join(long.select("_conv", "conv_id"), "_conv")
        every = every.unionByName(audits, allowMissingColumns=True)
    every = every.withColumn("_number", F.col("_turn").cast("string"))  # exact beside nulls, too
    return every.repartition("_conv").sortWithinPartitions("_conv", F.col("_audit").isNull(), *ORDER)


def summarise(rows: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """One row per ``conv_id`` of ``rows(conv_id, turn, role, text)``: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    ``repaired_sha256`` is the hash of the repaired messages, ``role:text`` each, joined by newlines. Rows with a true ``gone`` only name their conversation.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for ident, known, messages in _stream(batches):
            digest, comma = hashlib.sha256(), b""
            for _, role, text in messages:
                digest.update(comma + role.encode() + b":")
                digest.update(text.encode())
                comma = b"\n"
            out.append({"conv_id": ident, **known, "repaired_sha256": digest.hexdigest()})
            if len(out) == 5000:
                yield pd.DataFrame(out).astype({"conv_id": object})
                out = []
        if out:
            yield pd.DataFrame(out).astype({"conv_id": object})

    kind = rows.schema["conv_id"].dataType
    named = rows.withColumn("conv_id", F.col("conv_id").cast("string"))
    found = _sorted(named, block).mapInPandas(run, f"conv_id string, {COUNTS}, cost bigint, audit string, repaired_sha256 string")
    return found.withColumn("conv_id", F.col("conv_id").cast(kind))


def repair(rows: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """The repaired conversations, one row per message: ``conv_id``, ``no`` from 1, ``edit`` (K, R or I), ``role`` and ``text``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, size = [], 0
        for ident, _, messages in _stream(batches):
            for no, (edit, role, text) in enumerate(messages, 1):
                out.append((ident, no, edit, role, text))
                size += len(text) + 100
                if size > CHARS:
                    yield pd.DataFrame(out, columns=["conv_id", "no", "edit", "role", "text"])
                    out, size = [], 0
        if out:
            yield pd.DataFrame(out, columns=["conv_id", "no", "edit", "role", "text"])

    kind = rows.schema["conv_id"].dataType
    named = rows.withColumn("conv_id", F.col("conv_id").cast("string"))
    found = _sorted(named, block).mapInPandas(run, "conv_id string, no bigint, edit string, role string, text string")
    return found.withColumn("conv_id", F.col("conv_id").cast(kind))
