"""Conversation structure repair: the cheapest edits that make the roles of a conversation ``(s?(ua)+)?``.

A dynamic programme runs over the rows of a conversation in turn order with four states (nothing yet, after a
system, a user, an assistant row).  Each state holds its least cost, its edit string as a node of
``persistent_audit.Audits`` (ties go to the string that is ASCII-least) and the running SHA-256 of what it has kept, so
the pass needs neither the texts behind it nor a second pass for the digest."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from loanlens.llm.common import python_stage, table
from loanlens.llm.persistent_audit import Audits

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3  # costs; keeping a row costs nothing
START, SYSTEM, USER, ASSISTANT = range(4)
KEEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
NEXT = (USER, USER, ASSISTANT, USER)  # the state that a rerole or an insertion leads to
ROLE = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}
BLANK, DUPLICATE, CUT = 1, 2, 3  # faults of a row
TRIM_AT = 4096  # nodes of a conversation after which what all its states share is written out

_SCHEMA = ("blank long, duplicate long, truncated long, illegal long, gaps long, cost long, audit string, "
           "repaired_sha256 string")


class Repair:
    """The programme over one conversation: ``row`` for each row in order, then ``result``."""

    def __init__(self):
        self.audits = Audits()
        self.cost: list = [0, None, None, None]
        self.node = [0, 0, 0, 0]
        self.sha = [hashlib.sha256(), None, None, None]
        self.faults, self.illegal, self.last = [0, 0, 0, 0], 0, None
        self.low = self.high = None
        self.turns = 0
        self._insert()

    def _offer(self, best: dict, to: int, cost: int, source: int, letter: str, line: str | None) -> None:
        """Put the candidate at its state if it is cheaper than the one there, or as cheap and ASCII-less."""
        held = best.get(to)
        if held is not None and held[0] < cost:
            return
        node = self.audits.add(self.node[source], letter)
        if held is None or cost < held[0] or self.audits.less(node, held[1]):
            best[to] = (cost, node, source, line)
        else:
            self.audits.pop()

    def _digest(self, source: int, line: str | None):
        sha = self.sha[source]
        if line is not None:
            sha = sha.copy()
            sha.update((line if source == START else "\n" + line).encode())
        return sha

    def _insert(self) -> None:
        """Insertions in the gap behind the rows so far: first those that lead to a user row, then to an assistant's."""
        for to, sources in ((USER, (START, SYSTEM, ASSISTANT)), (ASSISTANT, (USER,))):
            best = {} if self.cost[to] is None else {to: (self.cost[to], self.node[to], to, None)}
            for s in sources:
                if self.cost[s] is not None:
                    self._offer(best, to, self.cost[s] + INSERT, s, "I", ROLE[to] + ":")
            if to in best and best[to][3] is not None:
                cost, node, source, line = best[to]
                self.cost[to], self.node[to], self.sha[to] = cost, node, self._digest(source, line)

    def row(self, turn, role: str, text: str, fault: int) -> None:
        initial = role[:1]
        self.faults[fault] += 1
        if self.last is not None and self.last + initial not in LEGAL:
            self.illegal += 1
        self.last = initial
        if turn is not None and turn != self.high:  # rows come by turn
            self.turns += 1
            self.low = turn if self.low is None else self.low
            self.high = turn
        best: dict = {}
        extra = TRUNCATED if fault == CUT else 0
        for s in range(4):
            if self.cost[s] is None:
                continue
            self._offer(best, s, self.cost[s] + DELETE, s, "D", None)
            if fault in (BLANK, DUPLICATE):
                continue
            if (s, initial) in KEEP:
                self._offer(best, KEEP[s, initial], self.cost[s] + extra, s, "K", f"{role}:{text}")
            self._offer(best, NEXT[s], self.cost[s] + REROLE + extra, s, "R", f"{ROLE[NEXT[s]]}:{text}")
        sha = {to: self._digest(source, line) for to, (_, _, source, line) in best.items()}
        for to in range(4):
            self.cost[to], self.node[to] = best[to][:2] if to in best else (None, 0)
            self.sha[to] = sha.get(to)
        self._insert()
        # From "assistant" everything goes on that goes on from "system", at no more; from "nothing yet" at most one
        # deletion more.  States that cost strictly more than that can't win, and without them histories meet.
        done = self.cost[ASSISTANT]
        if done is not None:
            for s, more in ((SYSTEM, 0), (START, DELETE)):
                if self.cost[s] is not None and self.cost[s] > done + more:
                    self.cost[s], self.sha[s] = None, None
        if len(self.audits) > TRIM_AT:
            live = [s for s in range(4) if self.cost[s] is not None]
            for s, node in zip(live, self.audits.trim([self.node[s] for s in live])):
                self.node[s] = node

    def result(self) -> tuple:
        ends = [s for s in (START, ASSISTANT) if self.cost[s] is not None]
        end = ends[0]
        for s in ends[1:]:
            if self.cost[s] < self.cost[end] or self.cost[s] == self.cost[end] and self.audits.less(self.node[s], self.node[end]):
                end = s
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (*self.faults[1:], self.illegal, gaps, self.cost[end], self.audits.text(self.node[end]), self.sha[end].hexdigest())


def repair(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
           present: Column | None = None) -> DataFrame:
    """One row per conversation: id, ``blank``, ``duplicate``, ``truncated`` (rows by their first fault), ``illegal``
    (neighbours whose role initials are not su, ua or au), ``gaps`` (missing turns), ``cost`` and ``audit`` of the
    cheapest edits, ``repaired_sha256`` of the repaired ``role:text`` lines (``repaired_rows`` gives the rows themselves).

    Rows where ``present`` is false only announce their conversation: one without rows has zeros, an empty audit and
    the digest of the empty text.  Null roles and texts are one space; a null turn comes first; a null id is a
    conversation of its own; rows of one turn go by role and text, equal rows are alike.  A role with another
    initial than s, u or a (or none) can only be changed or deleted.  Other columns are not read; an empty
    table gives an empty result.

    One shuffle by conversation.  Numbering equal rows and the programme both use it, sorted on disk where memory
    does not do, and the programme streams: a conversation of any length costs one batch of texts and a few nodes.  Its
    rows pass one after another, as the SHA-256 chain that the result asks for does."""
    spark = rows.sparkSession
    python_stage(spark)
    there = F.lit(True) if present is None else present
    cols = rows.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{turn_col}`").cast("long").alias("_turn"),
                       F.coalesce(F.col(f"`{role_col}`"), F.lit(" ")).alias("_role"),
                       F.coalesce(F.col(f"`{text_col}`"), F.lit(" ")).alias("_text"), F.coalesce(there, F.lit(False)).alias("_there"))
    cols = cols.select("_id", "_there", *[F.when(F.col("_there"), F.col(c)).alias(c) for c in ("_turn", "_role", "_text")])
    said = r"\x20\x09-\x0D"
    seen = F.row_number().over(Window.partitionBy("_id", "_there", "_role", "_text").orderBy(F.asc_nulls_first("_turn")))
    fault = (F.when(~F.col("_text").rlike(f"[^{said}]"), BLANK).when(F.col("_seen") > 1, DUPLICATE)
             .when(~F.col("_text").rlike(f"[.!?][{said}]*\\z"), CUT).otherwise(0))
    ready = (cols.repartition(F.col("_id")).withColumn("_seen", seen).withColumn("_fault", F.when(F.col("_there"), fault))
             .select("_id", "_turn", "_role", "_text", "_fault")
             .sortWithinPartitions(F.asc_nulls_first("_id"), F.col("_fault").isNull(), F.asc_nulls_first("_turn"), "_role", "_text"))

    def run(batches):
        held, now = None, None
        out: list = []

        def flush():
            cols = list(zip(*out))
            fields = [("_id", pa.int64()), *[(n.split()[0], pa.int64() if n.endswith("long") else pa.string()) for n in _SCHEMA.split(", ")]]
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, fields)], [n for n, _ in fields])
            out.clear()
            return made

        for b in batches:
            for i, turn, role, text, fault in zip(*(b.column(k).to_pylist() for k in range(5))):
                if now is None or i != held:
                    if now is not None:
                        out.append((held, *now.result()))
                    held, now = i, Repair()
                if fault is not None:
                    now.row(turn, role, text, fault)
            if len(out) >= 1000:
                yield flush()
        if now is not None:
            out.append((held, *now.result()))
        if out:
            yield flush()

    return ready.mapInArrow(run, f"_id long, {_SCHEMA}").withColumnRenamed("_id", id_col)


def repaired_rows(rows: DataFrame, audits: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                  text_col: str = "text") -> DataFrame:
    """The repaired conversations, a row each: id, ``position`` (from 0), role, text, ``edit`` (K, R or I).

    ``audits`` is the result of ``repair`` on the same rows.  Edits and rows meet by conversation and number, so both
    spread over (conversation, number) in the join; a null id has its rows like any other."""
    order = Window.partitionBy("_id").orderBy(F.asc_nulls_first("_turn"), "_role", "_text")
    cols = rows.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{turn_col}`").cast("long").alias("_turn"),
                       F.coalesce(F.col(f"`{role_col}`"), F.lit(" ")).alias("_role"),
                       F.coalesce(F.col(f"`{text_col}`"), F.lit(" ")).alias("_text"))
    numbered = cols.select(F.col("_id").alias("_rid"), "_role", "_text", F.row_number().over(order).alias("_rn"))
    edits = (audits.where("audit <> ''").select(F.col(id_col).alias("_id"), F.posexplode(F.split("audit", "(?<=.)(?=.)")).alias("_at", "_edit")))
    so_far = Window.partitionBy("_id").orderBy("_at")
    edits = edits.withColumn("_n", F.sum((F.col("_edit") != "I").cast("long")).over(so_far)).where("_edit <> 'D'")
    met = edits.join(numbered, F.col("_id").eqNullSafe(F.col("_rid")) & (F.col("_n") == F.col("_rn")) & (F.col("_edit") != "I"), "left")
    place = F.row_number().over(so_far) - 1
    first = F.first(F.when(F.col("_edit") == "K", F.substring("_role", 1, 1))).over(so_far)
    put = met.withColumn("position", place.cast("long")).withColumn("_s", (first == "s").cast("long"))
    made = F.when((F.col("position") - F.coalesce("_s", F.lit(0))) % 2 == 0, "user").otherwise("assistant")
    return put.select(F.col("_id").alias(id_col), "position", F.when(F.col("_edit") == "K", F.col("_role")).otherwise(made).alias("role"),
                      F.when(F.col("_edit") == "I", "").otherwise(F.col("_text")).alias("text"), F.col("_edit").alias("edit"))


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, there): conversations with planted faults, chosen by crc32 of ``conv_id:turn`` (a null
    is one space) modulo 20: dropped (``there`` false), emptied, without ``.!?``, repeated, from the user."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    text = F.coalesce("text", F.lit(" "))
    return (rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"), kind.alias("_kind"))
            .select("conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"),
                    F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", ""))
                    .otherwise(F.col("text")).alias("text"), (F.col("_kind") != 0).alias("there"),
                    F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("_copy"))
            .drop("_copy"))


def op11(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repair(damaged(rows), present=F.col("there")).select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
