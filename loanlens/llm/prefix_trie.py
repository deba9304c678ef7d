"""Prefix trie of conversations, with a count-min sketch that keeps private tails out of the shuffle.

Every prefix of a conversation (its first d turns) has a chained digest.  A count-min sketch over all of them never
estimates too low, so a prefix estimated at one belongs to one conversation: its node is complete where it stands and
is emitted there.  Only prefixes that may be shared are grouped exactly.  What a node says about its subtree is a
sum over its members, because a conversation is the smallest member of a tail of its own path: from depth r on
the nodes are "its" nodes, and each node of the trie is counted by exactly one conversation."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from loanlens.llm.common import Scratch, python_stage, table

ROOT = bytes(16)
SKETCH_ROWS = 4
MOST_CELLS = 1 << 24  # cells of a sketch row at most (64 MB a worker, 8 MB sent): more prefixes only pass the screen more often
BLOCK = 1 << 16  # cells that travel together
_CHAIN = "c long, depth int, more boolean, digest binary, parent binary, n_bytes long, upto long"


def chains(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
           base: Column | None = None, shared: Column | None = None, most_shared: int = 8) -> DataFrame:
    """One row per conversation and depth from 0: ``c``, ``depth``, ``more`` (another turn follows), ``digest`` of the
    turns so far, ``parent`` digest, ``n_bytes`` of the turn's text and their sum ``upto`` here.

    With ``base`` and ``shared`` (expressions of the id) a conversation's first ``shared`` turns, at most
    ``most_shared``, are replaced by as many of conversation ``base`` (its own first ones there are; none if it is
    absent); a base must be its own base.  One shuffle, by ``base``; conversations stream through in
    turn order (null first; then role, text), so a task holds a batch and the first turns of one base."""
    spark = rows.sparkSession
    python_stage(spark)
    own = F.col(f"`{id_col}`").cast("long")
    blank = lambda c: F.coalesce(F.col(f"`{c}`"), F.lit(""))
    cols = rows.where(own.isNotNull()).select((own if base is None else base.cast("long")).alias("_base"), own.alias("_id"),
                                              (F.lit(0) if shared is None else shared).cast("int").alias("_shared"),
                                              F.col(f"`{turn_col}`").alias("_turn"), blank(role_col).alias("_role"),
                                              blank(text_col).alias("_text"))
    ready = (cols.repartition(F.col("_base")).sortWithinPartitions(
        "_base", F.col("_id") != F.col("_base"), "_id", F.asc_nulls_first("_turn"), "_role", "_text")
        .select("_base", "_id", "_shared", "_role", "_text"))

    def run(batches):
        out: list = []
        held = group = None  # conversation, base
        first: list = []  # first turns of the group's base
        state: list = []  # [digest, depth, upto, row that waits for its "more"]

        def step(role: str, text: str) -> None:
            raw, kind = text.encode(), role.encode()
            digest, depth, upto, wait = state
            out.append((*wait[:2], True, *wait[2:]))
            new = hashlib.blake2b(digest + len(kind).to_bytes(8, "little") + kind + raw, digest_size=16).digest()
            upto += len(raw)
            state[:] = [new, depth + 1, upto, (held, depth + 1, new, digest, len(raw), upto)]

        def close() -> None:
            wait = state[3]
            out.append((*wait[:2], False, *wait[2:]))

        def flush():
            types = (pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)],
                                              [f.split()[0] for f in _CHAIN.split(", ")])
            out.clear()
            return made

        for b in batches:
            for g, i, h, role, text in zip(*(b.column(k).to_pylist() for k in range(5))):
                if i != held:
                    if held is not None:
                        close()
                    if g != group:
                        group, first = g, []
                    held, at = i, 0
                    state[:] = [ROOT, 0, 0, (i, 0, ROOT, None, 0, 0)]
                    if i != g:
                        for turn in first[:h]:
                            step(*turn)
                if i == g:
                    if len(first) < most_shared:
                        first.append((role, text))
                    step(role, text)
                elif at >= h:
                    step(role, text)
                at += 1
            if len(out) >= 2000:
                yield flush()
        if held is not None:
            close()
        if out:
            yield flush()

    return ready.mapInArrow(run, _CHAIN)


def _cells(digests: pa.Array, width: int) -> list[np.ndarray]:
    """The cell of each digest in each row of a sketch; a digest is as good as random, so its halves give all."""
    halves = np.frombuffer(b"".join(digests.to_pylist()), "<u8").reshape(-1, 2)
    return [((halves[:, 0] + np.uint64(k) * halves[:, 1]) & np.uint64(width - 1)).astype(np.int64) for k in range(SKETCH_ROWS)]


def crowded(chained: DataFrame, most_cells: int = MOST_CELLS) -> list[np.ndarray]:
    """A count-min sketch of all digests below the root, as a bitmap per row of the cells that count two or more.

    Tasks count in arrays of two cells per prefix (a power of two, ``most_cells`` at most) that stop at two; blocks of
    them meet by (row, block) and are added one after another, so neither a task nor the driver holds more than one sketch."""
    spark = chained.sparkSession
    rows = chained.where("depth > 0").select("digest")
    n = rows.count()
    width = max(1 << 10, min(most_cells, 1 << (2 * n).bit_length()))
    block = min(BLOCK, width)

    def count(batches):
        cells = np.zeros((SKETCH_ROWS, width), np.uint8)
        some = False
        for b in batches:
            if b.num_rows:
                some = True
                for k, at in enumerate(_cells(b.column(0), width)):
                    where, times = np.unique(at, return_counts=True)
                    cells[k, where] = np.minimum(cells[k, where] + times, 2)
        if some:
            for k in range(SKETCH_ROWS):
                parts = cells[k].reshape(-1, block)
                for at in np.flatnonzero(parts.any(1)).tolist():
                    yield pa.RecordBatch.from_pydict({"k": pa.array([k], pa.int32()), "at": pa.array([at], pa.int32()),
                                                      "cells": pa.array([parts[at].tobytes()], pa.binary())})

    def add(batches):
        key, total = None, None

        def done():
            return pa.RecordBatch.from_pydict({"k": pa.array([key[0]], pa.int32()), "at": pa.array([key[1]], pa.int32()),
                                               "bits": pa.array([np.packbits(total >= 2).tobytes()], pa.binary())})

        for b in batches:
            for k, at, raw in zip(*(b.column(j).to_pylist() for j in range(3))):
                part = np.frombuffer(raw, np.uint8)
                if (k, at) != key:
                    if key is not None:
                        yield done()
                    key, total = (k, at), part.copy()
                else:
                    total = np.minimum(total + part, 2)
        if key is not None:
            yield done()

    merged = (rows.mapInArrow(count, "k int, at int, cells binary").repartition("k", "at").sortWithinPartitions("k", "at")
              .mapInArrow(add, "k int, at int, bits binary").collect())  # SKETCH_ROWS x width bits at most
    bits = [np.zeros(width // 8, np.uint8) for _ in range(SKETCH_ROWS)]
    for r in merged:
        bits[r["k"]][r["at"] * block // 8:(r["at"] + 1) * block // 8] = np.frombuffer(r["bits"], np.uint8)
    return bits


def screened(chained: DataFrame, bits: list[np.ndarray]) -> DataFrame:
    """Rows below the root with ``single`` and ``parent_single``: the sketch proves that one conversation has this prefix."""
    sent = chained.sparkSession.sparkContext.broadcast(bits)
    width = len(bits[0]) * 8

    def alone(digests: pa.Array, maps) -> np.ndarray:
        out = np.zeros(len(digests), bool)
        for at, m in zip(_cells(digests, width), maps):
            out |= (m[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 0
        return out

    def run(batches):
        for b in batches:
            single, before = alone(b.column("digest"), sent.value), alone(b.column("parent"), sent.value)
            before &= np.asarray(b.column("depth")) > 1  # the root belongs to all
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(single), pa.array(before)], [*b.schema.names, "single", "parent_single"])

    return chained.where("depth > 0").mapInArrow(run, _CHAIN + ", single boolean, parent_single boolean")


def _ends(rows: DataFrame) -> DataFrame:
    """(digest, ends_sha256): SHA-256 of the ascending ids, comma-joined, streamed from a sort by digest and id."""
    ready = rows.select("digest", "c").repartition("digest").sortWithinPartitions("digest", "c")

    def run(batches):
        held, sha = None, None
        for b in batches:
            keys, sums = [], []
            for digest, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if digest != held:
                    if held is not None:
                        keys.append(held)
                        sums.append(sha.hexdigest())
                    held, sha = digest, hashlib.sha256(str(c).encode())
                else:
                    sha.update(f",{c}".encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sums, pa.string())], ["digest", "ends_sha256"])
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([held], pa.binary()), pa.array([sha.hexdigest()])], ["digest", "ends_sha256"])

    return ready.mapInArrow(run, "digest binary, ends_sha256 string")


def prefix_trie(chained: DataFrame, most_cells: int = MOST_CELLS) -> DataFrame:
    """The nodes of the trie of ``chains``, one row each: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``
    (smallest member of the parent; null at the root), ``n_convs``, ``n_children``, ``n_leaves`` and ``saved_tokens`` of
    its subtree, ``ends_sha256`` of the members that end there.

    Rows with a null id are no conversation and are left out; null roles and texts are empty; a null turn comes first;
    rows of one turn go by role and text, repeated rows are turns of their own; equal conversations share all nodes; a
    conversation without turns is a member of the root; an empty table has no nodes.

    Rows without texts (about 80 bytes) are grouped by digest with partial sums, so a prefix that a third of all
    conversations begin with is a row per task; joins put one row per node or conversation beside them."""
    spark = chained.sparkSession
    scratch = Scratch(spark)
    turns = scratch.write(chained, "chains")
    marked_turns = screened(turns, crowded(turns, most_cells))
    heads = scratch.write(marked_turns.where("not single").drop("single"), "heads")
    # exact groups of what may be shared; the root is one row that all conversations meet
    least = heads.groupBy("digest").agg(F.min("c").alias("m"), F.count_if("more").alias("n_more"))
    start = turns.where("depth = 0")
    root = start.agg(F.min("c").alias("m"), F.count_if("more").alias("n_more")).first()
    at_root = start.withColumns({"m": F.lit(root["m"]).cast("long"), "n_more": F.lit(root["n_more"]).cast("long"),
                                 "parent_single": F.lit(False)})
    marked = scratch.write(heads.join(least, "digest").select(*heads.columns, "m", "n_more").unionByName(at_root), "marked")
    own = F.col("m") == F.col("c")
    edge = (marked_turns.where("single and not parent_single")
            .select("c", F.col("depth").alias("r"), (F.col("upto") - F.col("n_bytes")).alias("before"), "upto", F.lit(1).alias("leaf")))
    convs = (marked.select("c", F.when(own, F.col("depth")).alias("r"), F.when(own, F.col("upto") - F.col("n_bytes")).alias("before"), "upto",
                           (own & ~F.col("more") & (F.col("n_more") == 0)).cast("int").alias("leaf")).unionByName(edge)
             .groupBy("c").agg(F.min("r").alias("r"), F.min("before").alias("_b"), F.max("upto").alias("_all"), F.max("leaf").alias("leaf"))
             .select("c", "r", F.coalesce("_b", "_all").alias("before"), "leaf"))
    # a conversation's own nodes start at depth r, and `before` bytes come before them; without any, r is null
    rows = scratch.write(marked.join(convs, "c").withColumn("child", F.col("more") & F.coalesce(F.col("r") <= F.col("depth") + 1, F.lit(False))),
                         "rows")
    nodes = rows.groupBy("digest").agg(
        F.min("c").alias("conv_id"), F.min("depth").alias("depth"), F.count(F.lit(1)).alias("n_convs"),
        F.count_if("child").alias("n_children"), F.sum(F.col("leaf").cast("long")).alias("n_leaves"),
        F.sum(F.greatest(F.col("before") - (F.col("upto") - F.col("n_bytes")), F.lit(0))).alias("saved_tokens"),
        F.max(F.when(F.col("parent_single"), F.col("c"))).alias("_known"))
    parents = rows.where("child").select(F.col("c").alias("conv_id"), (F.col("depth") + 1).alias("depth"), F.col("m").alias("_parent"))
    empty = F.sha2(F.lit("").cast("binary"), 256)
    shared = (nodes.join(_ends(rows.where("not more")), "digest", "left")
              .select("conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens",
                      F.coalesce("ends_sha256", empty).alias("ends_sha256"), "_known"))
    tails = marked_turns.where("single").select(
        F.col("c").alias("conv_id"), "depth", F.lit(1).cast("long").alias("n_convs"), F.col("more").cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
        F.when(F.col("more"), empty).otherwise(F.sha2(F.col("c").cast("string").cast("binary"), 256)).alias("ends_sha256"),
        F.when(F.col("parent_single"), F.col("c")).alias("_known"))
    # only nodes whose parent may be shared look it up; a parent that one conversation has is that one's
    asking = shared.unionByName(tails.where("_known is null")).join(parents, ["conv_id", "depth"], "left")
    out = asking.unionByName(tails.where("_known is not null").withColumn("_parent", F.col("_known")))
    out = out.withColumn("_parent", F.coalesce("_known", "_parent"))
    return out.select("conv_id", F.col("depth").cast("long").alias("depth"), F.col("_parent").alias("parent_conv_id"), "n_convs", "n_children",
                      "n_leaves", "saved_tokens", "ends_sha256")


def op13(spark, sf_dir: str) -> DataFrame:
    """The trie of conversations that begin with the first crc32(id) % 9 turns of the conversation id - id % 5."""
    c = F.col("conv_id")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return prefix_trie(chains(rows, base=c - c % 5, shared=F.crc32(c.cast("string").cast("binary")) % 9))
