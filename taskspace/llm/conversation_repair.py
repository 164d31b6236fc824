"""Conversations diagnosed and repaired at least cost, by dynamic programming over time-major tensors.

What a repaired conversation may be is a small automaton over the roles so far (nothing, system, user, assistant). Conversations of
like length form a tensor (turn, conversation, state): costs to go are updated for all of them a turn at a time, from the last turn
to the first, and kept; the edits are then traced forwards, again for all of them at once.

A conversation beyond ``LONG_ROWS`` turns or ``LONG_BYTES`` of text is cut into blocks, each a lane of the same tensors: blocks give
the cost from each state to each, these are folded a conversation, and then each block is traced on its own. Results are the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Stored

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: States: nothing yet, s, ...u, ...a. By state: the state after an insert or rerole, and its role; by state and role code
#: (s, u, a, other) the state after a kept row, or -1.
AFTER = np.array([2, 2, 3, 2])
ROLE = np.array([1, 1, 2, 1])
KEPT = np.array([[1, 2, -1, -1], [-1, 2, -1, -1], [-1, -1, 3, -1], [-1, 2, -1, -1]])
NAMES = ("", "user", "assistant")
FAR = 1 << 40
#: Costs to go at the end of a conversation: nothing and ...a may end it.
END = np.array([0, FAR, FAR, 0], np.int64)
LONG_ROWS, LONG_BYTES = 1 << 12, 16 << 20
#: Turns and bytes of text that a task holds before it repairs them.
HELD_ROWS, HELD_BYTES = 1 << 15, 32 << 20
SPACES = " \t\n\x0b\f\r"
OUT = "{key}, block int, blocks int, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, messages array<struct<role: string, text: string>>"


def _closed(v: np.ndarray) -> np.ndarray:
    """Costs to go where any number of inserts may come first."""
    v = v.copy()
    v[..., 2:] = np.minimum(v[..., 2:], INSERT + v[..., [3, 2]])
    v[..., :2] = np.minimum(v[..., :2], INSERT + v[..., 2:3])
    return v


def costs_to_go(code: np.ndarray, must: np.ndarray, open_: np.ndarray, sizes: np.ndarray, end: np.ndarray) -> np.ndarray:
    """(turns + 1, lanes, 4) costs to go. code, must and open_ are (turns, lanes); a lane has ``sizes`` turns and ends with the costs ``end``."""
    turns, lanes = code.shape
    out = np.empty((turns + 1, lanes, 4), np.int64)
    out[turns] = end
    for t in range(turns - 1, -1, -1):
        then = out[t + 1]
        extra = (TRUNCATED * open_[t])[:, None]
        to = KEPT[:, code[t]].T
        keep = np.where(to >= 0, np.take_along_axis(then, np.maximum(to, 0), 1) + extra + KEEP, FAR)
        stay = np.where(must[t][:, None], FAR, np.minimum(keep, then[:, AFTER] + extra + REROLE))
        out[t] = np.where((t < sizes)[:, None], np.minimum(_closed(np.minimum(stay, then + DELETE)), FAR), then)
    return out


def traced(code, must, open_, sizes, togo, state, last) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(letters, roles, states at the end): the edits from ``state`` on that reach the costs to go, least in ASCII at each step. letters
    and roles are (3 * turns + 2, lanes): up to two inserts and an edit for each turn, and inserts at the end of ``last`` lanes; 0 is none."""
    turns, lanes = code.shape
    at, state = np.arange(lanes), state.copy()
    letters, roles = np.zeros((3 * turns + 2, lanes), np.uint8), np.zeros((3 * turns + 2, lanes), np.uint8)
    for t in range(turns):
        open_lanes = t < sizes
        then, now = togo[t + 1], togo[t]
        for k in range(3):
            cost, after = now[at, state], AFTER[state]
            kept = KEPT[state, code[t]]
            extra = TRUNCATED * open_[t]
            drop = open_lanes & (DELETE + then[at, state] == cost)
            add = open_lanes & ~drop & (INSERT + now[at, after] == cost)
            keep = open_lanes & ~drop & ~add & ~must[t] & (kept >= 0) & (KEEP + extra + then[at, np.maximum(kept, 0)] == cost)
            other = open_lanes & ~drop & ~add & ~keep
            letters[3 * t + k] = 68 * drop + 73 * add + 75 * keep + 82 * other
            roles[3 * t + k] = np.where(add | other, ROLE[state], 0)
            state = np.where(add | other, after, np.where(keep, kept, state))
            open_lanes = add
    for k in range(2):
        add = last & ((state == 1) | (state == 2))
        letters[3 * turns + k] = 73 * add
        roles[3 * turns + k] = np.where(add, ROLE[state], 0)
        state = np.where(add, AFTER[state], state)
    return letters, roles, state


def tensors(flags: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(which lanes, code, must, open, sizes) for lanes of like length; a turn's flags are its role code, 4 if it must go, 8 if it is truncated."""
    sizes = np.array([len(f) for f in flags], np.int64)
    bucket = np.array([int(n).bit_length() for n in sizes])
    for b in np.unique(bucket):
        which = np.flatnonzero(bucket == b)
        full = np.full((int(sizes[which].max()), len(which)), 3, np.int64)
        for lane, w in enumerate(which):
            full[: sizes[w], lane] = flags[w]
        yield which, full & 3, (full & 4) > 0, (full & 8) > 0, sizes[which]


def repaired(flags: list[np.ndarray]) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """(number, cost, edits, the role each edit gives or 0) of whole conversations."""
    for which, code, must, open_, sizes in tensors(flags):
        togo = costs_to_go(code, must, open_, sizes, _closed(END))
        n = len(which)
        letters, roles, _ = traced(code, must, open_, sizes, togo, np.zeros(n, np.int64), np.ones(n, bool))
        for lane, w in enumerate(which):
            hit = letters[:, lane] > 0
            yield int(w), int(togo[0, lane, 0]), letters[hit, lane].tobytes(), roles[hit, lane]


def messages_of(edits: bytes, gives: np.ndarray, roles: list[str], texts: list[str]) -> list[dict]:
    """The conversation after its edits."""
    out, row = [], 0
    for letter, role in zip(edits, gives.tolist(), strict=True):
        if letter == 73:
            out.append({"role": NAMES[role], "text": ""})
            continue
        if letter != 68:
            out.append({"role": NAMES[role] or roles[row], "text": texts[row]})
        row += 1
    return out


def illegal_pairs(code: np.ndarray) -> int:
    """Adjacent rows whose roles don't begin with s and u, u and a, or a and u."""
    a, b = code[:-1], code[1:]
    return int(len(a) - (((b == 1) & ((a == 0) | (a == 2))) | ((a == 1) & (b == 2))).sum())


def _gaps(turns: list) -> int:
    own = {t for t in turns if t is not None}
    return max(own) - min(own) + 1 - len(own) if own else 0


def _repair_held(held: list[tuple]) -> list[tuple]:
    """Rows of the result for whole conversations (key, turns, roles, texts, codes, open flags, blank flags)."""
    flags, found = [], []
    for _, turns, roles, texts, codes, open_, blank in held:
        code, no_text = np.array(codes, np.int64), np.array(blank, bool)
        seen: set[tuple[str, str]] = set()
        again = np.zeros(len(turns), bool)
        for k, pair in enumerate(zip(roles, texts, strict=True)):
            again[k] = pair in seen
            seen.add(pair)
        again &= ~no_text
        cut = np.array(open_, bool) & ~no_text & ~again
        flags.append(code + 4 * (no_text | again) + 8 * cut)
        found.append((_gaps(turns), int(no_text.sum()), int(again.sum()), int(cut.sum()), illegal_pairs(code)))
    out: list = [None] * len(held)
    for i, cost, edits, gives in repaired(flags):
        key, _, roles, texts, *_ = held[i]
        out[i] = (key, 0, 1, *found[i], cost, edits.decode(), messages_of(edits, gives, roles, texts))
    return out


def _features(rows: DataFrame) -> DataFrame:
    """Role, text (null: one space), role code, truncated and blank flags, and the order of rows that share a turn."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    first = F.substring(role, 1, 1)
    code = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    words = F.rtrim(text, F.lit(SPACES))
    return rows.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), "there", code.alias("code"),
        (~F.right(words, F.lit(1)).isin(".", "!", "?")).alias("open"), (F.length(words) == 0).alias("blank"), F.xxhash64(text).alias("tie"),
    )


def _whole(rows: DataFrame) -> DataFrame:
    """Conversations within the limits: each in one task, which holds a bounded number of them."""
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        n_rows = n_bytes = 0
        names = ["turn", "role", "text", "code", "open", "blank"]

        def result() -> pa.RecordBatch:
            found = _repair_held(held)
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], schema.field(k).type) for k in range(len(schema))], schema=schema)

        schema = None
        for batch in batches:
            if schema is None:
                long, small = pa.int64(), pa.int32()
                message = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
                schema = pa.schema([("conv_id", batch.schema.field("conv_id").type), ("block", small), ("blocks", small), *[(n, long) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string()), ("messages", message)])
            keys, there = batch["conv_id"].to_pylist(), batch["there"].to_pylist()
            for key, on, *row in zip(keys, there, *[batch[n].to_pylist() for n in names], strict=True):
                if not held or key != held[-1][0]:
                    if n_rows >= HELD_ROWS or n_bytes >= HELD_BYTES:
                        yield result()
                        held, n_rows, n_bytes = [], 0, 0
                    held.append((key, *[[] for _ in names]))
                n_rows += 1
                if on:
                    for column, x in zip(held[-1][1:], row, strict=True):
                        column.append(x)
                    n_bytes += len(row[2])
        if held:
            yield result()

    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "tie", "text")
    return dealt.select("conv_id", "there", "turn", "role", "text", "code", "open", "blank").mapInArrow(run, OUT.format(key=f"conv_id {kind}"))


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows with ``pos``, their place in their conversation from 0. Ranges of rows are sorted, however many a conversation takes."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, "conv_id", "turn", "role", "tie").sortWithinPartitions("conv_id", "turn", "role", "tie", "text")
    made = Stored(ranged.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))).df
    runs = made.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    runs = runs.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), "first", before.alias("before"))
    joined = made.join(runs, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")))
    return joined.withColumn("pos", F.col("at") - F.col("first") + F.col("before")).drop("c", "p", "part", "at", "first", "before", "tie")


def _in_blocks(rows: DataFrame) -> DataFrame:
    """Conversations beyond the limits, a row for each block of ``LONG_ROWS`` turns. Keys of joins hold the block or the text, so that no
    task gets a conversation; what is folded a conversation is sixteen numbers a block."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    same = F.col("conv_id").eqNullSafe(F.col("c"))
    placed = Stored(_numbered(rows).withColumn("digest", F.sha2("text", 256))).df
    firsts = placed.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(F.min("pos").alias("earliest"))
    judged = placed.join(firsts, same & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))).drop("c", "r", "d", "digest")
    again = ~F.col("blank") & (F.col("pos") > F.col("earliest"))
    judged = judged.withColumn("again", again).withColumn("cut", F.col("open") & ~F.col("blank") & ~again).withColumn("block", F.floor(F.col("pos") / LONG_ROWS).cast("int"))
    flag = F.col("code") + F.when(F.col("blank") | F.col("again"), 4).otherwise(0) + F.when(F.col("cut"), 8).otherwise(0)
    rows_of = F.sort_array(F.collect_list(F.struct("pos", flag.alias("flag"), "role", "text")))
    blocks = Stored(judged.groupBy("conv_id", "block").agg(rows_of.alias("rows"))).df
    light = blocks.select("conv_id", "block", F.transform("rows", lambda r: r["flag"]).alias("flags"))

    def transfers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            flags = [np.array(f, np.int64) for f in batch["flags"]]
            cost, bad = [None] * len(flags), [illegal_pairs(f & 3) for f in flags]
            for which, code, must, open_, sizes in tensors(flags):
                by_end = [costs_to_go(code, must, open_, sizes, np.where(np.arange(4) == k, 0, FAR).astype(np.int64))[0] for k in range(4)]
                for lane, w in enumerate(which):
                    cost[w] = np.stack([c[lane] for c in by_end], 1).ravel().tolist()
            yield pd.DataFrame({"conv_id": batch["conv_id"], "block": batch["block"], "cost": cost, "bad": bad, "first": [int(f[0] & 3) for f in flags], "last": [int(f[-1] & 3) for f in flags]})

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("block")
        v, ends = _closed(END), []
        for cost in group["cost"][::-1]:
            ends.append(v.tolist())
            v = np.minimum((np.array(cost, np.int64).reshape(4, 4) + v).min(1), FAR)
        borders = [illegal_pairs(np.array(x)) for x in zip(group["last"][:-1], group["first"][1:], strict=True)]
        return pd.DataFrame({"conv_id": group["conv_id"], "block": group["block"], "ends": ends[::-1], "blocks": len(group), "illegal": int(group["bad"].sum()) + sum(borders), "cost": int(v[0])})

    cost = Stored(light.mapInPandas(transfers, f"conv_id {kind}, block int, cost array<long>, bad long, first int, last int").groupBy("conv_id").applyInPandas(fold, f"conv_id {kind}, block int, ends array<long>, blocks int, illegal long, cost long")).df
    ends = cost.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), "ends", "blocks")

    def trace(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            flags = [np.array(f, np.int64) for f in batch["flags"]]
            found: list = [None] * len(flags)
            finish = (batch["block"] == batch["blocks"] - 1).to_numpy(bool)
            for which, code, must, open_, sizes in tensors(flags):
                togo = costs_to_go(code, must, open_, sizes, np.array(batch["ends"].iloc[which].to_list(), np.int64))
                ways = [traced(code, must, open_, sizes, togo, np.full(len(which), s), finish[which]) for s in range(4)]
                for lane, w in enumerate(which):
                    hits = [(x[:, lane][x[:, lane] > 0], y[:, lane][x[:, lane] > 0], int(z[lane])) for x, y, z in ways]
                    found[w] = [x.tobytes() for x, _, _ in hits], [y.tobytes() for _, y, _ in hits], [z for _, _, z in hits]
            yield pd.DataFrame({"conv_id": batch["conv_id"], "block": batch["block"], "letters": [f[0] for f in found], "gives": [f[1] for f in found], "exits": [f[2] for f in found]})

    ways = Stored(light.join(ends, same & (F.col("block") == F.col("b"))).select("conv_id", "block", "flags", "ends", "blocks").mapInPandas(trace, f"conv_id {kind}, block int, letters array<binary>, gives array<binary>, exits array<int>")).df

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("block")
        state, entries = 0, []
        for exits in group["exits"]:
            entries.append(state)
            state = int(exits[state])
        return pd.DataFrame({"c": group["conv_id"], "b": group["block"], "entry": entries})

    entries = ways.select("conv_id", "block", "exits").groupBy("conv_id").applyInPandas(walk, f"c {kind}, b int, entry int")
    chosen = ways.join(entries, same & (F.col("block") == F.col("b"))).select(F.col("conv_id").alias("c"), F.col("block").alias("b"), F.col("letters")[F.col("entry")].alias("letters"), F.col("gives")[F.col("entry")].alias("gives"))

    @F.pandas_udf("array<struct<role: string, text: string>>")
    def apply(letters: pd.Series, gives: pd.Series, rows_: pd.Series) -> pd.Series:
        return pd.Series([messages_of(x, np.frombuffer(y, np.uint8), [r["role"] for r in own], [r["text"] for r in own]) for x, y, own in zip(letters, gives, rows_, strict=True)])

    made = blocks.join(chosen, same & (F.col("block") == F.col("b"))).select("conv_id", "block", F.col("letters").cast("string").alias("audit"), apply("letters", "gives", "rows").alias("messages"))
    count = lambda c: F.sum(F.col(c).cast("long")).alias(c)
    totals = judged.groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0).cast("long")).alias("gaps"), count("blank"), count("again"), count("cut"))
    totals = totals.select(F.col("conv_id").alias("c"), "gaps", "blank", F.col("again").alias("duplicate"), F.col("cut").alias("truncated"))
    wide = cost.join(totals, same).select(F.col("conv_id").alias("c"), F.col("block").alias("b"), "blocks", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return made.join(wide, same & (F.col("block") == F.col("b"))).select("conv_id", "block", "blocks", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "messages")


def repair_parts(conversations: DataFrame, there: Column | None = None) -> tuple[DataFrame, DataFrame | None]:
    """What :func:`repair` returns, as conversations of one block and those of several (None if there are none)."""
    rows = _features(conversations.select("conv_id", "turn", "role", "text", (F.lit(True) if there is None else F.coalesce(there, F.lit(False))).alias("there")))
    size = conversations.groupBy(F.col("conv_id").alias("c")).agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    large = size.where((F.col("n") > LONG_ROWS) | (F.col("bytes") > LONG_BYTES)).select("c")
    if large.isEmpty():
        return _whole(rows), None
    large = Stored(large).df
    same = F.col("conv_id").eqNullSafe(F.col("c"))
    long = rows.join(large, same, "left_semi")
    # one without any row there is whole: it has nothing to cut
    named = Stored(long.where("there").select(F.col("conv_id").alias("c")).distinct()).df
    return _whole(rows.join(named, same, "left_anti")), _in_blocks(long.where("there").join(named, same, "left_semi").drop("there"))


def repair(conversations: DataFrame, there: Column | None = None) -> DataFrame:
    """Diagnose and repair conversations (conv_id, turn, role, text), at least cost.

    Rows are taken by turn, nulls first; rows of one turn by role and then in an order that their texts decide. A null role or text
    counts as one space, a null conv_id as a conversation. A row's first fault counts: blank (no character but white space), duplicate (an earlier row has its role
    and text), truncated (the last character that isn't white space is none of ``.!?``). Edits: Keep 0, Rerole to user or assistant 3,
    Delete 4 (blank and duplicate rows must go), Insert an empty user or assistant turn 3; a truncated row that stays adds 3. The
    edits found give roles whose initials are ``(s?(ua)+)?``; of edits as cheap, those whose initials come first in ASCII.

    Returns one row a conversation: gaps (turns missing between the least and the greatest), blank, duplicate, truncated, illegal
    (adjacent roles that can't follow each other), cost, audit (the edits' initials) and messages (role and text after the
    repair). A conversation of more than LONG_ROWS rows or LONG_BYTES of text has a row for each block (of ``blocks``, from 0), with
    the block's audit and messages; the counts are the conversation's. Rows where ``there`` is false only name their conversation,
    so that one that lost all rows has zeros, an empty audit and no message. An empty table gives no row; other columns are not read.
    """
    whole, blocks = repair_parts(conversations, there)
    return whole if blocks is None else whole.unionByName(blocks)


def text_of(messages: Column) -> Column:
    """``role:text`` of each message, joined by line ends."""
    return F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(":"), m["text"])), "\n")


def with_sha256(whole: DataFrame, blocks: DataFrame | None) -> DataFrame:
    """One row a conversation, with the hash of its text for messages, and the whole audit. SHA-256 takes its input in order: the texts of
    a conversation in blocks pass one task, a block at a time, without being held."""
    counts = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    out = whole.select(*counts, "audit", F.sha2(text_of(F.col("messages")), 256).alias("repaired_sha256"))
    if blocks is None:
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def result() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([held[0] | {"audit": "".join(held[1]), "repaired_sha256": held[2].hexdigest()}], schema=schema)

        for batch in batches:
            schema = pa.schema([*[batch.schema.field(c) for c in counts], ("audit", pa.string()), ("repaired_sha256", pa.string())])
            for row in range(batch.num_rows):
                own = batch.slice(row, 1).to_pylist()[0]
                if own["block"] == 0:
                    if held:
                        yield result()
                    held = [{c: own[c] for c in counts}, [], hashlib.sha256(), False]
                held[1].append(own["audit"])
                if own["some"]:
                    held[2].update((("\n" if held[3] else "") + own["text"]).encode())
                    held[3] = True
        if held:
            yield result()

    dealt = blocks.select(*counts, "block", "audit", (F.size("messages") > 0).alias("some"), text_of(F.col("messages")).alias("text")).repartition("conv_id").sortWithinPartitions("conv_id", "block")
    kind = out.schema["conv_id"].dataType.simpleString()
    return out.unionByName(dealt.mapInArrow(run, f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"))
