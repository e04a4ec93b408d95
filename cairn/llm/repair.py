"""Cheapest repair of conversations to the shape ``(system? (user assistant)+)?``.

A conversation's rows are taken by turn (null turns first; equal turns by role, then text; rows alike in all are
interchangeable). A row's first fault counts: blank, duplicate (role and text seen earlier in the conversation),
truncated (its last character that is not white space is none of ``.!?``). A row may be kept (0), get another role
(2) or be deleted (3; blank and duplicate rows must be); a message without text may be inserted anywhere (2); a truncated
row that stays costs 1 more. Of the cheapest repairs the one whose edits' initials (D, I, K, R) come first in ASCII order is taken.

What the output has so far is one of four states, so a row is a 4 x 4 matrix over (min, +), and equal consecutive rows are a power of
it. A stretch of rows is cut into blocks of ``BLOCK``; a block's runs of equal role and fault are advanced by cached binary
powers, blocks are combined over a tree of ``FAN`` children a node, and every block then unrolls its own choices from
the costs behind it. So a conversation of any length is repaired by many tasks, and no group has more than ``BLOCK`` rows of
one character each, or ``FAN`` small matrices. Only ``digests`` goes through a conversation in one task, a batch at a time, as
SHA-256 has to; its memory does not grow.

Null conversation ids are one conversation; null roles and texts count as one space. Roles count by their first
character. Texts of any length are only trimmed and hashed. Of extra columns none is read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import freeze, with_group_stats
from cairn.plans.ordered import number_rows

BLOCK = 4096
FAN = 256
WHITE = " \t\n\x0b\f\r"
DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1
FAR = 1 << 40

# States: nothing yet, after system, after user, after assistant. The role that may come next, and the state after it.
NEXT = (("u", 2), ("u", 2), ("a", 3), ("u", 2))
# Cost from a state to a finished conversation when no rows are left, and what is inserted for it.
END = (0, 2 * INSERT, INSERT, 0)
TAIL = ("", "ua", "a", "")


@lru_cache(maxsize=None)
def _moves(symbol: str, state: int) -> list[tuple[int, str, str, int]]:
    """(cost, audit, token, state after) of each way past one row: insertions before it, then its own edit.

    Symbols: x must go; s, u, a, o are the role's first character, in upper case for truncated rows. Tokens: inserted
    roles, then K, D, or the new role in upper case.
    """
    role, extra = symbol.lower(), TRUNCATED * symbol.isupper()
    out, inserted, cost = [], "", 0
    for _ in range(3):  # a third insertion is back in a state that one insertion reaches
        audit = "I" * len(inserted)
        out.append((cost + DELETE, audit + "D", inserted + "D", state))
        if symbol != "x":
            if (role, state) == ("s", 0):
                out.append((cost + extra, audit + "K", inserted + "K", 1))
            if role == NEXT[state][0]:
                out.append((cost + extra, audit + "K", inserted + "K", NEXT[state][1]))
            out.append((cost + REROLE + extra, audit + "R", inserted + NEXT[state][0].upper(), NEXT[state][1]))
        inserted, cost, state = inserted + NEXT[state][0], cost + INSERT, NEXT[state][1]
    return out


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[:, :, None] + b[None]).min(axis=1), FAR)


@lru_cache(maxsize=None)
def _power(symbol: str, k: int) -> np.ndarray:
    """The transition over 2^k rows of one symbol."""
    if k:
        return _times(_power(symbol, k - 1), _power(symbol, k - 1))
    out = np.full((4, 4), FAR, np.int64)
    for state in range(4):
        for cost, _, _, after in _moves(symbol, state):
            out[state, after] = min(out[state, after], cost)
    return out


def _bits(n: int) -> Iterator[int]:
    return (k for k in range(n.bit_length()) if n >> k & 1)


def _runs(symbols: str) -> list[tuple[str, int]]:
    return [(s, sum(1 for _ in rows)) for s, rows in groupby(symbols)]


def block_matrix(symbols: str) -> list[int]:
    """The transition over a block of rows, by rows of the matrix."""
    out = np.where(np.eye(4, dtype=bool), 0, FAR)
    for symbol, rows in _runs(symbols):
        for k in _bits(rows):
            out = _times(out, _power(symbol, k))
    return out.ravel().tolist()


def _advance(symbol: str, rows: int, behind: np.ndarray) -> np.ndarray:
    """Costs to the end before ``rows`` rows of a symbol, from those after them."""
    for k in _bits(rows):
        behind = (_power(symbol, k) + behind).min(axis=1)
    return behind


@lru_cache(maxsize=1 << 16)
def _choice(symbol: str, behind: tuple[int, ...]) -> tuple[tuple[int, ...], tuple[tuple[str, int], ...]]:
    """Costs before one row relative to the least of them, and the best (token, state after) from each state."""
    best = [min((cost + behind[after], audit, token, after) for cost, audit, token, after in _moves(symbol, state)) for state in range(4)]
    least = min(b[0] for b in best)
    return tuple(b[0] - least for b in best), tuple((token, after) for _, _, token, after in best)


def _relative(costs: np.ndarray) -> tuple[int, ...]:
    return tuple((costs - costs.min()).tolist())


def unroll(symbols: str, behind: list[int], state: int) -> tuple[list[str], int, int]:
    """Tokens of the rows of a block entered in ``state`` with costs ``behind`` it, the state after it and its cost."""
    runs = _runs(symbols)
    ends = [np.asarray(behind, np.int64)]
    for symbol, rows in reversed(runs):
        ends.append(_advance(symbol, rows, ends[-1]))
    before, tokens = int(ends[-1][state]), []
    for (symbol, rows), end in zip(runs, ends[-2::-1]):
        costs, choices = _relative(end), []
        for _ in range(rows):
            costs, choice = _choice(symbol, costs)
            choices.append(choice)
        for choice in reversed(choices):
            token, state = choice[state]
            tokens.append(token)
    return tokens, state, before - int(behind[state])


def _scan(nodes: DataFrame, combine: Callable, apply: Callable, start: list[int], backward: bool) -> DataFrame:
    """``nodes(first, at, v)`` with ``given``: what the nodes before (or behind) a node in its group make of ``start``.

    ``combine`` joins a list of values in order, ``apply`` takes a carried value over a value. Nodes are
    combined ``FAN`` at a time until a group is one node, then what each node is given goes down again.
    """
    levels, kind = [nodes], "array<bigint>"
    joined = F.udf(lambda vs: combine([list(v) for v in vs]), kind, useArrow=True)

    def carried(vs, given):
        out = []
        for v in reversed(vs) if backward else vs:
            out.append(given)
            given = apply(list(v), list(given))
        return out[::-1] if backward else out

    spread = F.udf(carried, f"array<{kind}>", useArrow=True)
    up = lambda df: df.groupBy("first", F.floor(F.col("at") / F.lit(FAN)).alias("at")).agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("kids"))
    values = lambda: F.transform("kids", lambda k: k["v"])
    while (levels[-1].agg(F.max("at")).first()[0] or 0) > 0:
        levels.append(freeze(up(levels[-1]).select("first", "at", "kids", joined(values()).alias("v"))))
    out = levels[-1].select("first", "at", F.array(*[F.lit(s).cast("bigint") for s in start]).alias("given"))
    for level in reversed(levels[1:]):
        told = level.join(out, ["first", "at"]).select("first", "kids", spread(values(), F.col("given")).alias("gives"))
        out = told.select("first", F.explode(F.arrays_zip(F.transform("kids", lambda k: k["at"]).alias("at"), F.col("gives").alias("given"))).alias("x")).select("first", "x.at", "x.given")
    return nodes.join(out, ["first", "at"])


def _over(matrix: list[int], behind: list[int]) -> list[int]:
    return (np.asarray(matrix, np.int64).reshape(4, 4) + np.asarray(behind, np.int64)).min(axis=1).tolist()


def _product(matrices: list[list[int]]) -> list[int]:
    out = np.asarray(matrices[0], np.int64).reshape(4, 4)
    for m in matrices[1:]:
        out = _times(out, np.asarray(m, np.int64).reshape(4, 4))
    return out.ravel().tolist()


def _chain(maps: list[list[int]]) -> list[int]:
    out = maps[0]
    for m in maps[1:]:
        out = [m[s] for s in out]
    return out


@dataclass
class Repair:
    """``summary``: a row per conversation. ``messages``: first, at, k, role, text in the order at, k. ``first`` names a conversation."""

    summary: DataFrame
    messages: DataFrame


def _name(conv: Column) -> list[Column]:
    return [conv.isNotNull().alias("_known"), F.coalesce(conv.cast("string"), F.lit("")).alias("_name")]


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> Repair:
    """The cheapest repair of every conversation of ``rows``."""
    conv = F.col(conv_col)
    taken = rows.select(
        *_name(conv), conv.alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit(" ")).alias("role"), F.coalesce(F.col(text_col), F.lit(" ")).alias("text"),
        F.monotonically_increasing_id().alias("_any"),
    )
    ranked = number_rows(taken, ["_known", "_name", F.col("turn").asc_nulls_first(), "role", "text", "_any"], "n").drop("_any")
    trimmed, initial = F.rtrim("text", F.lit(WHITE)), F.left("role", F.lit(1))
    slim = ranked.select(
        "_known", "_name", "conv_id", "n", "turn", F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("initial"), (F.length(trimmed) == 0).alias("empty"),
        (~F.right(trimmed, F.lit(1)).isin(*".!?")).alias("open"), F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("said"),
    )
    placed = with_group_stats(slim, ["_known", "_name"], {"first": ("min", F.col("n")), "rows": ("count", F.lit(1))}, ["n"])
    seen = with_group_stats(placed, ["first", "said"], {"earliest": ("min", F.col("n"))}, ["n"])
    fault = F.when(F.col("empty"), "blank").when(F.col("n") > F.col("earliest"), "duplicate").when(F.col("open"), "truncated")
    faults = freeze(seen.select("first", "conv_id", "rows", "n", "turn", "initial", fault.alias("fault")))
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper("initial")).otherwise(F.col("initial"))
    at = F.floor((F.col("n") - F.col("first")) / F.lit(BLOCK)).alias("at")
    gathered = faults.groupBy("first", at).agg(F.array_sort(F.collect_list(F.struct("n", "initial", symbol.alias("symbol")))).alias("x"), F.first("rows").alias("rows"))
    text = lambda name: F.array_join(F.transform("x", lambda x: x[name]), "").alias(f"{name}s")
    blocks = freeze(gathered.select("first", "at", "rows", text("initial"), text("symbol")))

    matrix = F.udf(block_matrix, "array<bigint>", useArrow=True)
    behind = freeze(_scan(blocks.withColumn("v", matrix("symbols")), _product, _over, list(END), True).select("first", "at", "rows", "initials", "symbols", F.col("given").alias("behind")))
    maps = F.udf(lambda s, b: [unroll(s, list(b), state)[1] for state in range(4)], "array<bigint>", useArrow=True)
    entered = _scan(behind.withColumn("v", maps("symbols", "behind")), _chain, lambda m, s: [m[s[0]]], [0], False)

    def edits(symbols: str, costs: list[int], state: int, last: bool) -> dict:
        tokens, after, cost = unroll(symbols, list(costs), state)
        # Behind the last row comes what finishes the conversation, as a token without an edit of a row.
        return {"tokens": " ".join([*tokens, TAIL[after]] if last else tokens), "cost": cost + (END[after] if last else 0)}

    last = (F.col("at") + 1) * BLOCK >= F.col("rows")
    done = F.udf(edits, "tokens string, cost bigint", useArrow=True)("symbols", "behind", F.col("given")[0].cast("int"), last)
    chosen = freeze(entered.select("first", "at", "initials", done.alias("done")).select("first", "at", "initials", "done.*"))

    # Pairs of neighbours: within a block, and a block's first row with the last one of the block before.
    ends = chosen.select("first", (F.col("at") + 1).alias("at"), F.right("initials", F.lit(1)).alias("_left"))
    pairs = F.concat(F.coalesce("_left", F.lit("")), "initials")
    legal = F.length(pairs) - F.length(F.regexp_replace(pairs, "(?<=[sa])u|(?<=u)a", ""))
    blockwise = chosen.join(ends, ["first", "at"], "left").select(
        "first", "at", "cost", (F.length(pairs) - 1 - legal).cast("bigint").alias("illegal"), F.translate("tokens", "uaUA ", "IIRR").alias("audit")
    )
    audits = blockwise.groupBy("first").agg(
        F.sum("cost").alias("cost"), F.sum("illegal").alias("illegal"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "audit"))), lambda x: x["audit"]), "").alias("audit"),
    )
    counted = faults.groupBy("first").agg(
        F.first("conv_id").alias("conv_id"), F.max("turn").alias("_hi"), F.min("turn").alias("_lo"), *[F.count(F.when(F.col("fault") == f, 1)).alias(f) for f in ("blank", "duplicate", "truncated")]
    )
    turns = faults.groupBy("first", "turn").agg(F.count("*").alias("_")).groupBy("first").agg(F.count("turn").alias("_turns"))
    summary = counted.join(turns, "first").join(audits, "first").select(
        "first", "conv_id", F.coalesce(F.col("_hi") - F.col("_lo") + 1 - F.col("_turns"), F.lit(0)).cast("bigint").alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit"
    )

    tokens = chosen.select("first", "at", F.posexplode(F.split("tokens", " "))).select("first", (F.col("at") * BLOCK + F.col("pos")).alias("at"), F.col("col").alias("token"))
    spoken = ranked.join(faults.select("n", "first"), "n").select("first", (F.col("n") - F.col("first")).alias("at"), "role", "text")
    edit = F.right("token", F.lit(1))
    own = F.when(edit == "K", F.col("role")).when(edit == "U", "user").when(edit == "A", "assistant")
    inserted = F.transform(F.filter(F.split("token", ""), lambda c: c.isin("u", "a")), lambda c: F.struct(F.when(c == "u", "user").otherwise("assistant").alias("role"), F.lit("").alias("text")))
    said = F.concat(inserted, F.when(own.isNull(), F.array().cast("array<struct<role: string, text: string>>")).otherwise(F.array(F.struct(own.alias("role"), F.col("text").alias("text")))))
    told = tokens.join(spoken, ["first", "at"], "left").select("first", "at", F.posexplode(said).alias("k", "m"))
    messages = told.select("first", "at", "k", "m.role", "m.text")
    return Repair(summary, messages)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, held = None, None
    for batch in batches:
        firsts, lines = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()
        names, sums = [], []
        for first, line in zip(firsts, lines):
            if first != at:
                if held is not None:
                    names.append(at)
                    sums.append(held.hexdigest())
                at, held = first, hashlib.sha256(line)
            else:
                held.update(b"\n")
                held.update(line)
        if names:
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(sums, pa.string())], names=["first", "repaired_sha256"])
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([held.hexdigest()], pa.string())], names=["first", "repaired_sha256"])


def digests(messages: DataFrame) -> DataFrame:
    """``(first, repaired_sha256)`` of each conversation's ``role:text`` lines, joined by newlines."""
    lines = messages.select("first", F.concat_ws(":", "role", "text").alias("line"), "at", "k")
    ordered = lines.repartition("first").sortWithinPartitions("first", "at", "k").select("first", "line")
    return ordered.mapInArrow(_hashed, "first long, repaired_sha256 string")


def damage(conversations: DataFrame) -> DataFrame:
    """``conversations`` with faults laid in by the CRC-32 of ``conv_id:turn`` modulo 20 (nulls: one space).

    0 drops the row, 1 empties its text, 2 takes ``.!?`` out of it, 3 repeats the row, 4 makes its role user.
    """
    plain = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    code = F.crc32(F.concat(plain["conv_id"], F.lit(":"), plain["turn"]).cast("binary")) % 20
    text = F.when(code == 1, "").when(code == 2, F.translate(plain["text"], ".!?", "")).otherwise(plain["text"])
    copies = F.when(code == 0, 0).when(code == 3, 2).otherwise(1)
    rows = conversations.select("conv_id", "turn", F.when(code == 4, "user").otherwise(plain["role"]).alias("role"), text.alias("text"), F.array_repeat(F.lit(0), copies).alias("_copies"))
    return rows.withColumn("_copies", F.explode("_copies")).drop("_copies")


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """One row per original conversation: its faults after ``damage``, the cheapest repair's cost and audit, and the hash of what it gives."""
    fixed = repair(damage(conversations))
    found = fixed.summary.join(digests(fixed.messages), "first", "left").select(*_name(F.col("conv_id")), *[c for c in fixed.summary.columns if c not in ("first", "conv_id")], "repaired_sha256")
    original = conversations.select("conv_id").distinct().select("conv_id", *_name(F.col("conv_id")))
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return original.join(found, ["_known", "_name"], "left").select(
        "conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256")
    )
