"""Conversation structure repair by a dynamic program over retained turns.

A repaired conversation has the roles s?(ua)+, or no turns. A turn is kept (free), reroled to user or assistant (1) or
deleted (2; blank turns and repeated ones must be); an empty turn of either role can be inserted (5); a truncated turn that
stays costs 5 more. The program chooses which turns are retained: those between two retained ones are deleted, priced by
prefix sums; the pair of roles around such a gap determines what is inserted in it; and with a running minimum for each
role the best next turn is known in constant time. Of equally cheap repairs that with the least string of edit initials is
taken (D before I before K before R): a walk forward takes the first edit that stays within the costs to go.

Turns are dealt out by ranges of (conversation, turn), so a long conversation is split like any others. A conversation
within one range is settled there. Those that touch an edge of a range, two a range at most, are settled in two more
passes over their segments: costs from each state to each, then the choices from each state; what is known of a segment,
4 x 4 numbers, is put together on the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, partitions, saved, shown_id, table, whole_id

RETAIN_TRUNCATED, REROLE, DELETE, INSERT = 5, 1, 2, 5
#: States: nothing yet, system, user, assistant. Codes of roles are the same; 0 is a role that can't be kept.
START, SYSTEM, USER, ASSISTANT = range(4)
FINE, BLANK, DUPLICATE, TRUNCATED, GONE = range(5)
NEVER = 1 << 40
#: Rows that a task hands on at once, about.
TOGETHER = 4096
#: What an insert leads to from each state; inserts between a state and a retained role, and after the last.
INSERTED = (USER, USER, ASSISTANT, USER)
GAP = tuple(tuple(NEVER if x is None else INSERT * x for x in row) for row in ((None, 0, 0, 1), (None, None, 0, 1), (None, None, 1, 0), (None, None, 0, 1)))
END = (0, 2 * INSERT, INSERT, 0)


def to_go(codes: list[int], faults: list[int], after: tuple[int, ...]) -> list[list[int]]:
    """For each place and state the least cost of the rest, after being the costs by state behind the last turn."""
    n = len(codes)
    end = [DELETE * n + x for x in after]
    least = [NEVER] * 4  # of retaining a turn at this place or later in a role, with the deletions before it
    out = [list(after)] * (n + 1)
    for i in range(n - 1, -1, -1):
        before, rest, fault, code = DELETE * i, out[i + 1], faults[i], codes[i]
        if fault != BLANK and fault != DUPLICATE:
            own = before + (RETAIN_TRUNCATED if fault == TRUNCATED else 0)
            if code == SYSTEM:
                least[SYSTEM] = min(least[SYSTEM], own + rest[SYSTEM])
            for role in (USER, ASSISTANT):
                least[role] = min(least[role], own + (0 if code == role else REROLE) + rest[role])
        _, s, u, a = least
        out[i] = [min(end[r], GAP[r][1] + s, GAP[r][2] + u, GAP[r][3] + a) - before for r in range(4)]
    return out


def choose(codes: list[int], faults: list[int], costs: list[list[int]], state: int, last: bool) -> tuple[str, int, str]:
    """The edits of each turn from a state on, the state behind them, and what is inserted then if they are the last.

    K keep, D delete, u and a rerole to user and assistant; v, b, w, c: insert user or assistant, then keep or rerole:
    v = user, K; b = assistant, K; w = user, a; c = assistant, u. Behind the last: 0 nothing, 1 assistant, 2 both.
    """
    out = []
    for i, (code, fault) in enumerate(zip(codes, faults)):
        here, rest, put = costs[i], costs[i + 1], ""
        while True:
            if here[state] == DELETE + rest[state]:
                out.append("D")
                break
            into = INSERTED[state]
            if here[state] == INSERT + here[into]:
                put, state = "u" if into == USER else "a", into
                continue
            own = RETAIN_TRUNCATED if fault == TRUNCATED else 0
            if code and GAP[state][code] == 0 and here[state] == own + rest[code]:
                out.append({"": "K", "u": "v", "a": "b"}[put])
                state = code
            else:
                state = into
                out.append({"": "u" if into == USER else "a", "u": "w", "a": "c"}[put])
            break
    return "".join(out), state, str(END[state] // INSERT) if last else ""


def judged(df: DataFrame, gone: Column | None = None) -> DataFrame:
    """Rows of (conv, turn, role, text) with what the program needs: sha, code, blank, cut, later (seen in an earlier turn).

    Rows that are gone only stand for their conversation.
    """
    rows = df.withColumn("gone", gone if gone is not None else F.lit(False)).withColumn("sha", F.sha2("text", 256))
    firsts = rows.where("NOT gone").groupBy("conv", "role", "sha").agg(F.min("turn").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    initial = lambda c, k: F.when(F.col("role").startswith(c), k)
    return rows.join(firsts, ["conv", "role", "sha"], "left").select(
        "conv",
        "turn",
        "role",
        "sha",
        F.coalesce(initial("s", SYSTEM), initial("u", USER), initial("a", ASSISTANT), F.lit(0)).cast("int").alias("code"),
        F.when(F.col("gone"), GONE)
        .when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), BLANK)
        .when(F.coalesce(F.col("turn") > F.col("first"), F.lit(False)), DUPLICATE)
        .when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), TRUNCATED)
        .otherwise(FINE)
        .alias("fault"),
        "text",
    )


def repair(df: DataFrame, gone: Column | None = None) -> DataFrame:
    """The edits of every conversation in order: conv, place, step, turn, was (old role), fault, edit, role, text.

    df: conv and turn (longs, NO_ID for null, which comes first), role and text (no nulls). Turns of equal number are in
    the order of role and SHA-256 of the text. Places are ascending within a conversation, steps within a place. edit is K,
    R, D or I, or null for rows that are gone; of deleted turns role and text are those that were deleted. Roles are told
    by their first letter: other roles can be reroled or deleted, not kept. Repeated rows are duplicates of the first. An
    empty table gives no rows.
    """
    spark, order = df.sparkSession, ["conv", "turn", "role", "sha"]
    n = partitions(spark)
    ranged = judged(df, gone).repartitionByRange(n, *order).sortWithinPartitions(*order)
    fields = "conv long, turn long, role string, code int, fault int, text string, place long, edge boolean, choice string, tail string"
    first = saved(ranged.mapInArrow(_settle, fields), "turns")
    inner, edge = first.where("NOT edge"), first.where("edge").drop("choice", "tail")
    # segments of conversations at the edges of ranges: two for each range at most
    edge = edge.withColumn("part", F.shiftright("place", 40).cast("int"))
    dealt = lambda x: x.repartition(n, "conv", "part").sortWithinPartitions("conv", "part", "place")
    known = dealt(edge.select("conv", "part", "place", "code", "fault")).mapInArrow(_matrix, "conv long, part int, costs array<long>").collect()
    behind: dict[tuple[int, int], list[int]] = {}
    rest: dict[int, list[int]] = {}
    for r in sorted(known, key=lambda r: (r["conv"], -r["part"])):
        behind[r["conv"], r["part"]] = after = rest.get(r["conv"], list(END))
        m = np.array(r["costs"]).reshape(4, 4)
        rest[r["conv"]] = (m + np.array(after)).min(axis=1).tolist()
    lasts = {c: p for c, p in sorted(behind)}
    after = spark.createDataFrame([(c, p, v, p == lasts[c]) for (c, p), v in behind.items()], "conv long, part int, after array<long>, last boolean")
    chosen = dealt(edge.join(F.broadcast(after), ["conv", "part"])).mapInArrow(_choices, "conv long, part int, place long, turn long, role string, fault int, text string, choice string, tail string, exits array<int>")
    chosen = saved(chosen, "choices")
    states, begin = {}, []
    for r in sorted(chosen.where("exits IS NOT NULL").select("conv", "part", "exits").collect(), key=lambda r: (r["conv"], r["part"])):
        s = states.get(r["conv"], START)
        begin.append((r["conv"], r["part"], s))
        states[r["conv"]] = r["exits"][s]
    begin = spark.createDataFrame(begin, "conv long, part int, state int")
    pick = lambda c: F.substring(c, F.col("state") + 1, F.lit(1)).alias(c)
    late = chosen.join(F.broadcast(begin), ["conv", "part"]).select("conv", "place", "turn", "role", "fault", "text", pick("choice"), pick("tail"))
    rows = inner.select(*late.columns).unionByName(late)
    step = lambda edit, role, text: F.struct(F.lit(edit).alias("edit"), role.alias("role"), text.alias("text"))
    user, assistant, none = F.lit("user"), F.lit("assistant"), F.lit("")
    role, text, c = F.col("role"), F.col("text"), F.col("choice")
    before = F.when(c.isin("v", "w"), F.array(step("I", user, none))).when(c.isin("b", "c"), F.array(step("I", assistant, none))).otherwise(F.array())
    own = F.when(c == "D", step("D", role, text)).when(c.isin("K", "v", "b"), step("K", role, text)).when(c.isin("u", "c"), step("R", user, text)).when(c.isin("a", "w"), step("R", assistant, text)).otherwise(step(None, role, text))
    behind_last = F.when(F.col("tail") == "2", F.array(step("I", user, none), step("I", assistant, none))).when(F.col("tail") == "1", F.array(step("I", assistant, none))).otherwise(F.array())
    steps = rows.select("conv", "place", "turn", F.col("role").alias("was"), "fault", F.posexplode(F.concat(before, F.array(own), behind_last)).alias("step", "s"))
    return steps.select("conv", "place", "step", "turn", "was", "fault", "s.edit", "s.role", "s.text")


def _runs(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """(whether it is the last, batch) for each run of rows with equal values of by, of sorted batches."""
    held: list[pa.RecordBatch] = []
    key = None
    ready = None

    def joined() -> pa.RecordBatch:
        return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(c).to_numpy() for c in by]
        cuts = [0, *(np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1).tolist(), batch.num_rows]
        for s, e in zip(cuts, cuts[1:]):
            now = tuple(int(c[s]) for c in cols)
            if now != key and held:
                if ready is not None:
                    yield False, ready
                ready, held = joined(), []
            key = now
            held.append(batch.slice(s, e - s))
    if held:
        if ready is not None:
            yield False, ready
        yield True, joined()


def _faults(run: pa.RecordBatch) -> np.ndarray:
    """Faults of a conversation's sorted turns: of rows equal to the one before them too."""
    fault = run.column("fault").to_numpy().copy()
    turn = run.column("turn").to_numpy()
    if (same := turn[1:] == turn[:-1]).any():
        for c in ("role", "sha"):
            x = run.column(c)
            same &= pc.equal(x[1:], x[:-1]).to_numpy(zero_copy_only=False)
        fault[1:][same & ((fault[1:] == FINE) | (fault[1:] == TRUNCATED))] = DUPLICATE
    return fault


def _lists(run: pa.RecordBatch, fault: np.ndarray) -> tuple[list[int], list[int], np.ndarray]:
    """Codes and faults of the turns that are there, and where they are."""
    there = np.flatnonzero(fault != GONE)
    return run.column("code").to_numpy()[there].tolist(), fault[there].tolist(), there


def _spread(choice: str, there: np.ndarray, n: int) -> list[str]:
    out = ["-"] * n
    for k, c in zip(there.tolist(), choice):
        out[k] = c
    return out


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Choices of the conversations that lie within this range; the first and the last one may go on in others."""
    place, begun = TaskContext.get().partitionId() << 40, False
    runs: list[pa.RecordBatch] = []
    new: list[list] = [[], [], [], []]  # fault, edge, choice, tail of the rows of runs

    def whole() -> pa.RecordBatch:
        nonlocal place
        rows = pa.Table.from_batches(runs).combine_chunks()
        at = np.arange(place, place + rows.num_rows)
        place += rows.num_rows
        fault, edge, choice, tail = (pa.array(c, t) for c, t in zip(new, (pa.int32(), pa.bool_(), pa.string(), pa.string())))
        out = [rows.column(c).combine_chunks() for c in ("conv", "turn", "role", "code")] + [fault, rows.column("text").combine_chunks(), pa.array(at), edge, choice, tail]
        runs.clear()
        for c in new:
            c.clear()
        return pa.RecordBatch.from_arrays(out, ["conv", "turn", "role", "code", "fault", "text", "place", "edge", "choice", "tail"])

    for last, run in _runs(batches, ["conv"]):
        n, fault = run.num_rows, _faults(run)
        edge, begun = last or not begun, True
        choice: list[str | None] = [None] * n
        tail = ["0"] * n
        if not edge:
            codes, faults, there = _lists(run, fault)
            text, _, tail[-1] = choose(codes, faults, to_go(codes, faults, END), START, True)
            choice = _spread(text, there, n)
        runs.append(run)
        for c, x in zip(new, (fault.tolist(), [edge] * n, choice, tail)):
            c.extend(x)
        if len(new[0]) >= TOGETHER:
            yield whole()
    if runs:
        yield whole()


def _matrix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each segment the least costs from each state to each."""
    for _, run in _runs(batches, ["conv", "part"]):
        codes, faults, _ = _lists(run, run.column("fault").to_numpy())
        ends = [to_go(codes, faults, tuple(0 if r == x else NEVER for r in range(4)))[0] for x in range(4)]
        yield pa.RecordBatch.from_arrays([run.column("conv")[:1], run.column("part")[:1], pa.array([[ends[x][r] for r in range(4) for x in range(4)]])], ["conv", "part", "costs"])


def _choices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each segment what is chosen from each state: four letters a turn, and the states behind on its first row."""
    for _, run in _runs(batches, ["conv", "part"]):
        n, last = run.num_rows, run.column("last")[0].as_py()
        codes, faults, there = _lists(run, run.column("fault").to_numpy())
        costs = to_go(codes, faults, tuple(run.column("after")[0].as_py()))
        found = [choose(codes, faults, costs, s, last) for s in range(4)]
        letters = ["".join(x) for x in zip(*[_spread(text, there, n) for text, _, _ in found])]
        tails = ["0000"] * (n - 1) + ["".join(t or "0" for _, _, t in found)]
        exits = [[s for _, s, _ in found]] + [None] * (n - 1)
        out = [run.column(c) for c in ("conv", "part", "place", "turn", "role", "fault", "text")]
        yield pa.RecordBatch.from_arrays([*out, pa.array(letters), pa.array(tails), pa.array(exits, pa.list_(pa.int32()))], ["conv", "part", "place", "turn", "role", "fault", "text", "choice", "tail", "exits"])


def damaged(df: DataFrame) -> DataFrame:
    """conversations, damaged by the hash of conversation and turn: conv, turn, role, text, gone.

    Nulls are read as one space, also in the hash. A row that is dropped stays as a row that is gone.
    """
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(named("conv_id"), F.lit(":"), named("turn")).cast("binary")) % 20
    rows = df.select(whole_id(F.col("conv_id")).alias("conv"), whole_id(F.col("turn")).alias("turn"), named("role").alias("role"), named("text").alias("text"), h.alias("h"))
    text = F.when(F.col("h") < 2, "").when(F.col("h") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("h") == 4, "user").otherwise(F.col("role"))
    twice = F.explode(F.when(F.col("h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv", "turn", role.alias("role"), text.alias("text"), (F.col("h") == 0).alias("gone"), twice.alias("copy")).drop("copy")


def digests(edits: DataFrame) -> DataFrame:
    """A row for each conversation of repair: its faults, cost, string of edits, and hash of the repaired text.

    The hash and the string are one value for a conversation, so its turns pass one task, in order and as a stream;
    what to do with them is known by then.
    """
    seen = edits.withColumn("text", F.when((F.col("edit") != "D") & F.col("edit").isNotNull(), F.col("text")))
    ordered = seen.repartition(partitions(edits.sparkSession), "conv").sortWithinPartitions("conv", "place", "step")
    longs = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    out = ordered.mapInArrow(_digest, "conv long, " + ", ".join(f"{c} long" for c in longs) + ", audit string, repaired_sha256 string")
    return out.select(shown_id(F.col("conv")).alias("conv_id"), *longs, "audit", "repaired_sha256")


class _Digest:
    """What is counted of one conversation while its edits pass by."""

    PRICE = {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}

    def __init__(self) -> None:
        self.faults, self.illegal, self.cost, self.audit = [0] * 5, 0, 0, []
        self.least = self.most = self.turn = self.initial = None
        self.turns, self.sha, self.begun = 0, hashlib.sha256(), False

    def add(self, turn: int, was: str, fault: int, edit: str | None, role: str, text: str | None) -> None:
        if edit is None:
            return
        self.audit.append(edit)
        self.cost += self.PRICE[edit] + (RETAIN_TRUNCATED if fault == TRUNCATED and edit in "KR" else 0)
        if edit != "D":
            self.sha.update((b"\n" if self.begun else b"") + f"{role}:{text}".encode())
            self.begun = True
        if edit == "I":
            return
        self.faults[fault] += 1
        if self.initial is not None and self.initial + was[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = was[:1]
        if turn != NO_ID:
            self.least = turn if self.least is None else self.least
            self.turns += turn != self.turn
            self.most = self.turn = turn

    def row(self) -> list:
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        return [gaps, self.faults[BLANK], self.faults[DUPLICATE], self.faults[TRUNCATED], self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest()]


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    out = lambda rows: pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names)
    now, one, done = None, _Digest(), []
    for batch in batches:
        for conv, *row in zip(*[batch.column(c).to_pylist() for c in ("conv", "turn", "was", "fault", "edit", "role", "text")]):
            if conv != now:
                if now is not None:
                    done.append([now, *one.row()])
                now, one = conv, _Digest()
            one.add(*row)
        if done:
            yield out(done)
            done = []
    if now is not None:
        yield out([[now, *one.row()]])


def repair_digests(df: DataFrame) -> DataFrame:
    """A row for each conv_id of conversations: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Null ids are one conversation, null turns come first, null roles and texts are one space. Repeated rows are turns that
    repeat the first one. Other columns don't matter. An empty table gives no rows.
    """
    return digests(repair(damaged(df), F.col("gone")))


def query(spark, sf_dir):
    """op12: every conversation damaged, repaired and summed up."""
    return repair_digests(table(spark, sf_dir, "conversations"))
