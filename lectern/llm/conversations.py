"""Least-cost repair of conversations on an automaton that shares suffixes.

Each conversation becomes a signature, a character for each row: its role's initial and its fault. Equal signatures are one,
and distinct ones are sorted from their ends, so that those with a common suffix are neighbours: a task keeps the nodes of the current
suffix as a stack, goes back to the longest suffix shared with the next signature, and adds nodes from there. For each node and
state of the grammar ``(s?(ua)+)?`` the cost to go is found once, together with the best audit suffix, which is held as
its first edit and a link to the node and state that follow. Edits that can follow each other in one
node and state differ in their initials, so the least of the cheapest edits begins the ASCII-least audit.

A conversation of over ``PIECE`` rows is cut. What a piece costs from each state to each state
follows from its signature alone; going through these 4 x 4 tables from the last piece gives what each piece leads to, and then pieces are
repaired like conversations. So no task holds more than a piece of a signature. The digest of a repaired conversation is one
SHA-256 over all its text; the rows of a conversation stream through one task for it, sorted, and are never held.

Defined cases: a null role or text is one space, a null ``conv_id`` or ``turn`` one space in the hashed key; rows without
``conv_id`` are one conversation; rows of one turn follow each other by role and then by the MD5 of role and
text, so equal rows are neighbours; a role that is empty or begins with another letter than ``s``, ``u``, ``a`` can't be
kept; conversations of which no row is left have zeros, an empty audit and the digest of nothing; an empty table gives no rows. Other columns are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import storage

#: Rows of a conversation whose signature is one string.
PIECE = 4096
SEEN = r"[^\x20\x09-\x0D]"
ENDED = r"[.!?][\x20\x09-\x0D]*\z"

INSERT, REROLE, DELETE, TRUNCATED = 3, 3, 4, 3
NONE = 1 << 40
START, SYSTEM, USER, ASSISTANT = range(4)
#: State after a user or assistant row that an edit may put in each state.
NEXT = (USER, USER, ASSISTANT, USER)
#: State after a row kept, by its role's initial.
KEEP = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}, "x": {}}
#: Cost to go behind the last row, and the edits for it.
FINAL = (0, 2 * INSERT, INSERT, 0)
CLOSING = ("", "II", "I", "")
NAMES = {USER: "user", ASSISTANT: "assistant"}


def damaged(conversations: DataFrame) -> DataFrame:
    """``(conv, turn, role, text)``: rows dropped, emptied, stripped of ends, repeated or given to the user, by the CRC-32 of ``conv_id:turn``;
    ``conv`` names the conversation (empty where the id is null)."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    rows = conversations.select(named(F.col("conv_id")).alias("conv"), "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv", "turn", role.alias("role"), text.alias("text"), F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def named(conv_id: Column) -> Column:
    return F.coalesce(F.concat(F.lit("c"), conv_id.cast("string")), F.lit(""))


def digest() -> Column:
    return F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"))


def _with_faults(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows without their text, with their faults, sorted within conversations; and the stored table that this depends on.
    What occurs in several turns is found by a grouped aggregate, so a text that a long conversation repeats throughout is summed before it is shuffled."""
    first = F.substring("role", 1, 1)
    initial = F.when(first.isin("s", "u", "a"), first).otherwise("x")
    slim = rows.select("conv", "turn", "role", digest().alias("digest"), initial.alias("initial"), (~F.col("text").rlike(SEEN)).alias("blank"), (~F.col("text").rlike(ENDED)).alias("truncated"))
    place = F.struct(F.col("turn").isNotNull(), "turn")
    seen = slim.where("NOT blank").groupBy("conv", "digest").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    repeats = storage.keep(seen.where("first <> last").select("conv", "digest", "first"), "repeats")
    late = F.coalesce(place > F.col("first"), F.lit(False)).alias("late")
    flagged = slim.join(repeats, ["conv", "digest"], "left").select("conv", "turn", "role", "digest", "initial", "blank", "truncated", late)
    return flagged.repartition("conv").sortWithinPartitions("conv", "turn", "role", "digest"), repeats


PIECES = "conv string, piece long, signature string, last boolean, turn long, role string, digest string, low long, high long, turns long, blank long, duplicate long, truncated long, illegal long"


def _pieces(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Signatures of sorted rows, in pieces, with counts: a deleted row is ``d``, others their initial, in capitals if truncated."""
    names = [c.split()[0] for c in PIECES.split(", ")]
    schema = pa.schema([(c.split()[0], {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}[c.split()[1]]) for c in PIECES.split(", ")])
    out: list[list] = []
    signs: list[str] = []
    before = None  # the row before, of the same conversation
    n = 0
    row: list = []

    def begin(conv, number, turn, role, key):
        signs.clear()
        return [conv, number, None, False, turn, role, key, None, None, 0, 0, 0, 0, 0]

    def end(last):
        row[2], row[3] = "".join(signs), last
        out.append(row)

    for batch in batches:
        for conv, turn, role, key, initial, blank, truncated, late in zip(*(c.to_pylist() for c in batch.columns)):
            if before is None or before[0] != conv:
                if before is not None:
                    end(True)
                before, n = None, 0
                row = begin(conv, 0, turn, role, key)
            elif len(signs) == most:
                end(False)
                row = begin(conv, n // most, turn, role, key)
            if turn is not None:
                row[7] = turn if row[7] is None else row[7]
                row[8] = turn
                row[9] += before is None or before[1] != turn
            if blank:
                row[10] += 1
                signs.append("d")
            elif late or (before is not None and before[1:4] == (turn, role, key)):
                row[11] += 1
                signs.append("d")
            else:
                row[12] += truncated
                signs.append(initial.upper() if truncated else initial)
            row[13] += before is not None and before[4] + initial not in ("su", "ua", "au")
            before = (conv, turn, role, key, initial)
            n += 1
        if len(out) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), schema)], names=names)
            out.clear()
    if before is not None:
        end(True)
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), schema)], names=names)


def node(sign: str, after: tuple[int, ...]) -> tuple[tuple[int, ...], str, tuple[int, ...]]:
    """Of a row before a node with these costs to go: its own costs to go, and for each state the first edit and the state behind it."""
    costs, edits, states = [], [], []
    kept, more = KEEP.get(sign.lower(), {}), TRUNCATED * sign.isupper()
    for q in range(4):
        options = [(DELETE + after[q], "D", q)]
        if sign != "d":
            if q in kept:
                options.append((more + after[kept[q]], "K", kept[q]))
            options.append((REROLE + more + after[NEXT[q]], "R", NEXT[q]))
        cost, edit, state = min(options)
        costs.append(cost)
        edits.append(edit)
        states.append(state)
    for _ in range(2):  # an inserted row, or two: three would lead back to where the first led
        for q in range(4):
            cost = INSERT + costs[NEXT[q]]
            if cost < costs[q] or (cost == costs[q] and edits[q] > "I"):
                costs[q], edits[q], states[q] = cost, "I", NEXT[q]
    return tuple(costs), "".join(edits), tuple(states)


class Automaton:
    """Nodes of the current signature's suffixes; ``turn_to`` keeps those of the suffix that the last one shares."""

    def __init__(self):
        self.exit, self.signature, self.stack, self.made = None, "", [], 0

    def turn_to(self, exit_: tuple[int, ...], signature: str) -> None:
        shared = 0
        if exit_ == self.exit:
            most = min(len(signature), len(self.signature))
            while shared < most and signature[-1 - shared] == self.signature[-1 - shared]:
                shared += 1
            del self.stack[shared + 1 :]
        else:
            self.stack = [(exit_, "", ())]
        for sign in reversed(signature[: len(signature) - shared]):
            self.stack.append(node(sign, self.stack[-1][0]))
            self.made += 1
        self.exit, self.signature = exit_, signature

    def audit(self, state: int, last: bool) -> tuple[str, int, int]:
        """The best edits from a state on, what they cost, and the state behind them."""
        edits, at, cost = [], len(self.stack) - 1, 0
        while at:
            _, choice, states = self.stack[at]
            edit = choice[state]
            edits.append(edit)
            sign = self.signature[len(self.signature) - at]
            cost += INSERT if edit == "I" else DELETE if edit == "D" else REROLE * (edit == "R") + TRUNCATED * sign.isupper()
            state = states[state]
            at -= edit != "I"
        if last:
            edits.append(CLOSING[state])
            cost += INSERT * len(CLOSING[state])
        return "".join(edits), cost, state


def _text(costs: tuple[int, ...]) -> str:
    """Costs to go less the least of them; what can't be reached stays so."""
    least = min(costs)
    return ",".join(str(c - least if c < NONE else NONE) for c in costs)


def _costs(text: str) -> tuple[int, ...]:
    return tuple(map(int, text.split(",")))


def solve(asked: DataFrame) -> DataFrame:
    """Of each distinct ``(signature, exit, state, last)`` the ``costs`` at its beginning, its ``audit`` and ``cost``. Signatures are dealt and sorted by
    their ends; a task makes each node once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton()
        for batch in batches:
            rows = []
            for signature, exit_, state, last in zip(*(c.to_pylist() for c in batch.columns)):
                automaton.turn_to(_costs(exit_), signature)
                audit, cost, _ = automaton.audit(state, last) if state >= 0 else ("", 0, 0)
                rows.append((signature, exit_, state, last, ",".join(map(str, automaton.stack[-1][0])), audit, cost))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["signature", "exit", "state", "last", "costs", "audit", "cost"])

    distinct = asked.select("signature", "exit", F.col("state").cast("long").alias("state"), "last").distinct().withColumn("end", F.reverse("signature"))
    dealt = distinct.repartitionByRange("exit", "end").sortWithinPartitions("exit", "end").drop("end")
    return dealt.mapInArrow(run, "signature string, exit string, state long, last boolean, costs string, audit string, cost long")


UNITS = [_text(tuple(0 if p == q else NONE for p in range(4))) for q in range(4)]


def _composed(pieces: pd.DataFrame) -> pd.DataFrame:
    """Of a long conversation's pieces, with their costs from each state to each: what each leads to, and the state in which it begins."""
    pieces = pieces.sort_values("piece")
    tables = [[_costs(t) for t in row] for row in pieces[["to0", "to1", "to2", "to3"]].to_numpy()]
    exits, after = [], FINAL
    for table in reversed(tables):
        exits.append(after)
        before = tuple(min(table[p][q] + after[p] for p in range(4)) for q in range(4))
        least = min(before)
        after = tuple(min(c - least, NONE) for c in before)
    pieces["exit"] = [_text(e) for e in reversed(exits)]
    return pieces[["conv", "piece", "signature", "exit", "last"]]


def _in_states(asked: DataFrame) -> DataFrame:
    """Long conversations' pieces with the state each begins in: a piece is solved from all four states, and then the states are followed from the first piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton()
        for batch in batches:
            rows = []
            for signature, exit_ in zip(*(c.to_pylist() for c in batch.columns)):
                automaton.turn_to(_costs(exit_), signature)
                rows.append((signature, exit_, [automaton.audit(q, False)[2] for q in range(4)]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["signature", "exit", "into"])

    def follow(pieces: pd.DataFrame) -> pd.DataFrame:
        pieces = pieces.sort_values("piece")
        state, states = START, []
        for into in pieces["into"]:
            states.append(state)
            state = into[state]
        pieces["state"] = states
        return pieces[["conv", "piece", "signature", "exit", "last", "state"]]

    distinct = asked.select("signature", "exit").distinct().withColumn("end", F.reverse("signature"))
    ways = distinct.repartitionByRange("exit", "end").sortWithinPartitions("exit", "end").drop("end").mapInArrow(run, "signature string, exit string, into array<long>")
    return asked.join(ways, ["signature", "exit"]).groupBy("conv").applyInPandas(follow, "conv string, piece long, signature string, exit string, last boolean, state long")


def _asked(pieces: DataFrame) -> DataFrame:
    """``(conv, piece, signature, exit, last, state)`` of all pieces."""
    columns = ["conv", "piece", "signature", "exit", "last"]
    whole = pieces.where("last AND piece = 0").select("conv", "piece", "signature", F.lit(_text(FINAL)).alias("exit"), "last", F.lit(START).cast("long").alias("state"))
    long = pieces.where("NOT (last AND piece = 0)").select("conv", "piece", "signature", "last")
    ways = solve(long.select("signature", F.explode(F.array(*map(F.lit, UNITS))).alias("exit"), F.lit(-1).alias("state"), F.lit(False).alias("last")))
    tables = ways.groupBy("signature").agg(*(F.max(F.when(F.col("exit") == u, F.col("costs"))).alias(f"to{q}") for q, u in enumerate(UNITS)))
    exits = long.join(tables, "signature").groupBy("conv").applyInPandas(_composed, "conv string, piece long, signature string, exit string, last boolean")
    return whole.unionByName(_in_states(exits.select(columns)).select(*columns, "state"))


REPAIRED = "conv string, audit string, cost long, repaired_sha256 string"


def edited(state: int, edit: str, role: str) -> tuple[int, str]:
    """The state after an edit that leaves a row, and that row's role."""
    if edit == "K":
        return KEEP[role[:1]][state], role
    return NEXT[state], NAMES[NEXT[state]]


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows and, before each piece's first row, the piece's edits: the digest of what the edits make of the rows, whose texts stream by."""
    out: list[tuple] = []
    conv = todo = None
    audits: list[str] = []
    state = at = cost = count = 0
    sha = hashlib.sha256()

    def put(role, text):
        nonlocal count
        sha.update((f"\n{role}:{text}" if count else f"{role}:{text}").encode())
        count += 1

    def inserts():
        nonlocal at, state
        while at < len(todo) and todo[at] == "I":
            state, role = edited(state, "I", "")
            put(role, "")
            at += 1

    def end():
        inserts()
        out.append((conv, "".join(audits), cost, sha.hexdigest()))

    def batch_of(rows):
        columns = [*zip(*rows)]
        kinds = (pa.string(), pa.string(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["conv", "audit", "cost", "repaired_sha256"])

    for batch in batches:
        for own, kind, role, text, audit, price in zip(*(c.to_pylist() for c in batch.columns)):
            if own != conv:
                if conv is not None:
                    end()
                conv, todo, audits, state, at, cost, count, sha = own, "", [], START, 0, 0, 0, hashlib.sha256()
            if kind == 0:
                todo, at = todo[at:] + audit, 0
                audits.append(audit)
                cost += price
                continue
            inserts()
            edit = todo[at]
            at += 1
            if edit != "D":
                state, role = edited(state, edit, role)
                put(role, text)
        if len(out) >= 4096:
            yield batch_of(out)
            out.clear()
    if conv is not None:
        end()
    if out:
        yield batch_of(out)


def repair(conversations: DataFrame, most: int = PIECE) -> DataFrame:
    """``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)`` of every conversation of
    ``conv_id, turn, role, text``, after ``damaged``. A row's first fault counts, of blank, duplicate and truncated; ``audit``
    holds the initials of keep, rerole, delete and insert."""
    rows = damaged(conversations)
    faults, repeats = _with_faults(rows)
    pieces = storage.keep(faults.mapInArrow(lambda batches: _pieces(batches, most), PIECES), "pieces")
    storage.discard(repeats)
    asked = storage.keep(_asked(pieces), "asked")
    solved = storage.keep(solve(asked), "solved")
    audits = asked.join(solved, ["signature", "exit", "state", "last"]).select("conv", "piece", "audit", "cost")
    audits = audits.join(pieces.select("conv", "piece", "turn", "role", "digest"), ["conv", "piece"])
    none = F.lit(None)
    marks = audits.select("conv", "turn", "role", "digest", F.lit(0).alias("kind"), "piece", none.cast("string").alias("text"), "audit", "cost")
    texts = rows.select("conv", "turn", "role", digest().alias("digest"), F.lit(1).alias("kind"), F.lit(0).cast("long").alias("piece"), "text", none.cast("string").alias("audit"), none.cast("long").alias("cost"))
    order = ["conv", "turn", "role", "digest", "kind", "piece"]
    stream = marks.unionByName(texts).repartition("conv").sortWithinPartitions(*order).select("conv", "kind", "role", "text", "audit", "cost")
    fixed = stream.mapInArrow(_repaired, REPAIRED)
    total = lambda c: F.sum(c).alias(c)
    counts = pieces.groupBy("conv").agg((F.max("high") - F.min("low") + 1 - F.sum("turns")).alias("gaps"), *map(total, ["blank", "duplicate", "truncated", "illegal"]))
    every = conversations.select("conv_id").distinct().withColumn("conv", named(F.col("conv_id")))
    out = every.join(counts, "conv", "left").join(fixed, "conv", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select("conv_id", *map(zero, ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
