"""Conversation structure repair: the cheapest edits that make the roles of a conversation alternate.

Edits are paths through a lattice of (row, role before it) with integer costs. The auction algorithm extends and contracts a
path from its origin while it raises node prices; when the path arrives, the prices are an optimal dual solution, so an arc
lies on a cheapest path only if it is tight, and the first path in ASCII order is traced along tight arcs alone.

Long conversations are cut into stretches, at range partition bounds and at BLOCK_ROWS rows. A stretch is summed up as its
cost between every two states; stretches are the arcs of a coarser lattice that the same auction solves, level by level.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparklog.llm.common import join_counted, stored

SPACE = " \t\n\x0b\x0c\r"
ENDS = ".!?"
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States: nothing yet, after system, after user, after assistant.
STATES = range(4)
BY_INITIAL = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: The state after a user or assistant row that the state admits.
ANSWER = (2, 2, 3, 2)
ROLES = {2: "user", 3: "assistant"}
LEGAL = {"su", "ua", "au"}
#: Rows of the finest lattice and stretches of a coarser one.
WIDTH = 16
#: A task holds this many rows or bytes of one conversation.
BLOCK_ROWS = 4096
BLOCK_BYTES = 4 << 20
#: Code points of a text that take part in the order of rows with equal turn and role, before its digest.
HEAD = 64
RESULT = ("gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
          "repaired_sha256 string, repaired string")
COUNTS = ("blank", "duplicate", "truncated", "illegal")

Arcs = list[list[tuple]]


# --- the auction ----------------------------------------------------------------------------------------

def auction(arcs: Arcs, origins: list[int], target: int) -> list[int]:
    """Prices under which the path from each origin to ``target`` costs the difference of their prices.

    ``arcs`` lists (key, cost, head) per node; each origin must reach the target and every cycle must cost something.
    Prices start at zero and only rise, and always ``price[node] <= cost + price[head]``.
    """
    price = [0] * len(arcs)
    for origin in origins:
        path = [origin]
        while path[-1] != target:
            node = path[-1]
            least, head = min((cost + price[head], head) for _, cost, head in arcs[node])
            if price[node] < least:
                price[node] = least
                if len(path) > 1:
                    path.pop()
            else:
                path.append(head)
    return price


def first_path(arcs: Arcs, price: list[int], origin: int, target: int) -> list[tuple]:
    """The tight arcs, as (key, head), of the cheapest path whose keys come first; arcs of a node are in key order."""
    path, choice, dead = [], [iter(arcs[origin])], set()
    node = origin
    while node != target:
        for key, cost, head in choice[-1]:
            if head not in dead and price[node] == cost + price[head]:
                path.append((key, head, node))
                node = head
                choice.append(iter(arcs[head]))
                break
        else:
            dead.add(node)
            choice.pop()
            node = path.pop()[2]
    return [(key, head) for key, head, _ in path]


def only_reaching(arcs: Arcs, target: int) -> tuple[Arcs, set[int]]:
    """The arcs on ways to ``target``, and the nodes that have such a way."""
    into: list[list[int]] = [[] for _ in arcs]
    for node, out in enumerate(arcs):
        for _, _, head in out:
            into[head].append(node)
    reach, open_ = {target}, [target]
    while open_:
        for node in into[open_.pop()]:
            if node not in reach:
                reach.add(node)
                open_.append(node)
    return [[arc for arc in out if arc[2] in reach] for out in arcs], reach


@dataclass(frozen=True)
class Stretch:
    """Cost, place among the stretch's ways in key order, and keys of the best way between each two states it joins."""

    cost: dict[tuple[int, int], int]
    rank: dict[tuple[int, int], int]
    keys: dict[tuple[int, int], tuple]


def summed(arcs: Arcs, last: int) -> Stretch:
    """The stretch of a lattice whose entries are nodes 0 to 3 and whose exits begin at node ``last``."""
    cost, keys, rank = {}, {}, {}
    for end in STATES:
        own, reach = only_reaching(arcs, last + end)
        entries = [q for q in STATES if q in reach]
        price = auction(own, entries, last + end)
        for q in entries:
            cost[q, end] = price[q] - price[last + end]
            keys[q, end] = tuple(first_path(own, price, q, last + end))
    for q in STATES:
        for place, way in enumerate(sorted((way for way in keys if way[0] == q), key=lambda w: [k for k, _ in keys[w]])):
            rank[way] = place
    return Stretch(cost, rank, keys)


# --- lattices -------------------------------------------------------------------------------------------

def row_lattice(codes: str, closing: bool) -> Arcs:
    """Nodes 4 * rows read + state. Codes: the role's initial (``-`` for others), upper case (``_``) where truncated, X where
    the row must go. With ``closing``, rows may be inserted at the end and a last node accepts."""
    arcs: Arcs = []
    for i, code in enumerate(codes):
        extra = TRUNCATED if code.isupper() or code == "_" else 0
        for q in STATES:
            out = [("D", DELETE, 4 * i + 4 + q), ("I", INSERT, 4 * i + ANSWER[q])]
            if code != "X":
                if (q, code.lower()) in BY_INITIAL:
                    out.append(("K", extra, 4 * i + 4 + BY_INITIAL[q, code.lower()]))
                out.append(("R", REROLE + extra, 4 * i + 4 + ANSWER[q]))
            arcs.append(out)
    end = 4 * len(codes)
    for q in STATES:
        arcs.append(([("", 0, end + 4)] if q in (0, 3) else []) + [("I", INSERT, end + ANSWER[q])] if closing else [])
    return arcs + [[]] if closing else arcs


def stretch_lattice(parts: list[Stretch]) -> Arcs:
    """Nodes 4 * stretches passed + state; the key of an arc is its place among the stretch's ways."""
    arcs: Arcs = []
    for i, part in enumerate(parts):
        for q in STATES:
            arcs.append(sorted((part.rank[way], part.cost[way], 4 * i + 4 + way[1]) for way in part.cost if way[0] == q))
    return arcs + [[] for _ in STATES]


@lru_cache(1 << 14)
def rows_stretch(codes: str) -> Stretch:
    return summed(row_lattice(codes, False), 4 * len(codes))


@lru_cache(1)
def endings() -> tuple[tuple[int, str], ...]:
    """Cost and edits that end a conversation in each state."""
    arcs = row_lattice("", True)
    price = auction(arcs, list(STATES), 4)
    return tuple((price[q] - price[4], "".join(k for k, _ in first_path(arcs, price, q, 4))) for q in STATES)


def levels(parts: list[Stretch]) -> list[list[Stretch]]:
    """The parts, and coarser and coarser stretches up to a single one."""
    found = [parts]
    while len(found[-1]) > 1:
        fine = found[-1]
        found.append([summed(stretch_lattice(fine[i: i + WIDTH]), 4 * len(fine[i: i + WIDTH])) for i in range(0, len(fine), WIDTH)])
    return found


def ways(tree: list[list[Stretch]], entry: int, end: int) -> list[tuple[int, int]]:
    """Entry and exit of each part on the first best way of the whole."""
    found = [(entry, end)]
    for coarse, fine in zip(tree[:0:-1], tree[-2::-1]):
        finer = []
        for at, (q, last) in enumerate(found):
            for _, head in coarse[at].keys[q, last]:
                finer.append((q, head % 4))
                q = head % 4
        assert len(finer) == len(fine)
        found = finer
    return found


def whole_way(tree: list[list[Stretch]]) -> tuple[int, int]:
    """Cost of the whole conversation and the state in which its last part ends."""
    top = tree[-1][0]
    ends = [(top.cost[0, q] + endings()[q][0], top.rank[0, q], q) for q in STATES if (0, q) in top.cost]
    cost, _, end = min(ends)
    return cost, end


def edits(codes: str, entry: int, end: int) -> str:
    """The first cheapest edits between two states over any number of rows."""
    pieces = [codes[i: i + WIDTH] for i in range(0, len(codes), WIDTH)]
    if not pieces:
        return ""
    tree = levels([rows_stretch(piece) for piece in pieces])
    return "".join("".join(k for k, _ in part.keys[way]) for part, way in zip(tree[0], ways(tree, entry, end)))


@lru_cache(1 << 16)
def _short_audit(codes: str) -> tuple[int, str]:
    arcs, target = row_lattice(codes, True), 4 * len(codes) + 4
    price = auction(arcs, [0], target)
    return price[0] - price[target], "".join(k for k, _ in first_path(arcs, price, 0, target))


def audit(codes: str) -> tuple[int, str]:
    """Cost and edits of a whole conversation."""
    if len(codes) <= WIDTH:
        return _short_audit(codes)
    cost, end = whole_way(levels([rows_stretch(codes[i: i + WIDTH]) for i in range(0, len(codes), WIDTH)]))
    return cost, edits(codes, 0, end) + endings()[end][1]


# --- rows -----------------------------------------------------------------------------------------------

def coded(rows: list[tuple]) -> tuple[str, dict[str, int], list[bytes | None]]:
    """Codes of rows (turn, role, text), counts of their faults, and the key of each row that is the first with its role and text."""
    codes, n, seen, keys = [], dict.fromkeys(COUNTS, 0), set(), []
    for at, (_, role, text) in enumerate(rows):
        tail, key, code = text.rstrip(SPACE), None, "X"
        if not tail:
            n["blank"] += 1
        elif (role, text) in seen:
            n["duplicate"] += 1
        else:
            seen.add((role, text))
            key = hashlib.md5(f"{len(role)} {role}{text}".encode()).digest()
            code = role[:1] if role[:1] in ("s", "u", "a") else "-"
            if tail[-1] not in ENDS:
                n["truncated"] += 1
                code = "_" if code == "-" else code.upper()
        codes.append(code)
        keys.append(key)
        n["illegal"] += at > 0 and rows[at - 1][1][:1] + role[:1] not in LEGAL
    return "".join(codes), n, keys


def repaired(rows: list[tuple], edited: str, state: int = 0) -> str:
    """``role:text`` lines after the edits."""
    lines, at = [], iter(rows)
    for edit in edited:
        if edit == "D":
            next(at)
            continue
        if edit == "K":
            _, role, text = next(at)
            state = BY_INITIAL[state, role[:1]]
        else:
            state = ANSWER[state]
            role, text = ROLES[state], next(at)[2] if edit == "R" else ""
        lines.append(f"{role}:{text}")
    return "\n".join(lines)


def turn_span(rows: list[tuple]) -> tuple[int | None, int | None, int]:
    turns = {row[0] for row in rows} - {None}
    return min(turns, default=None), max(turns, default=None), len(turns)


def damage(turns: DataFrame) -> DataFrame:
    """Turns with planted faults, chosen by a checksum of conversation and turn; ``gone`` marks a row that was dropped.

    Null roles and texts become one space, in the checksum null ids and turns too.
    """
    hit = F.crc32(F.concat(*[
        part for name in ("conv_id", "turn") for part in (F.coalesce(F.col(name).cast("string"), F.lit(" ")), F.lit(":"))][:-1]
    ).cast("binary")) % 20
    role, text = (F.coalesce(F.col(name), F.lit(" ")) for name in ("role", "text"))
    return turns.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.when(hit == 4, "user").otherwise(role).alias("role"),
        F.when(hit == 1, "").when(hit == 2, F.translate(text, ENDS, "")).otherwise(text).alias("text"),
        F.explode(F.when(hit == 3, F.array(F.lit(False), F.lit(False))).otherwise(F.array(hit == 0))).alias("gone"))


def _result(conv_id, span, n: dict[str, int], cost: int, edited: str, digest: str, text: str | None) -> dict:
    low, high, distinct = span
    return {"conv_id": conv_id, "gaps": 0 if low is None else high - low + 1 - distinct, **n, "cost": cost, "audit": edited,
            "repaired_sha256": digest, "repaired": text}


def repair(turns: DataFrame, with_text: bool = False) -> DataFrame:
    """One row per conv_id: gaps, the counts of faults, cost, audit, repaired_sha256 and, ``with_text``, the repaired text.

    ``turns`` has conv_id, turn (long), role, text and perhaps ``gone`` (rows that only tell that the conversation exists).
    Rows are taken by turn, nulls first, then role, the first HEAD code points of the text and its digest; equal rows are
    duplicates. A role whose initial is not s, u or a cannot be kept; null roles and texts are one space; a null conv_id is a
    conversation of its own. A conversation without rows has zeros and empty texts; an empty table gives an empty result.

    One range shuffle deals the rows; a conversation that lies inside a partition is done there, and its lattice is solved once
    per task. The others, at most two per partition and those of over BLOCK_ROWS rows, go on as blocks: their duplicates are
    found by key, their summaries (32 small numbers a block) meet per conversation, and every block is traced by itself.
    Only the digest of the repaired text is a chain by nature: a task reads the blocks of one conversation in order and
    holds one of them at a time.
    """
    kind = turns.schema["conv_id"].dataType
    gone = F.col("gone") if "gone" in turns.columns else F.lit(False)
    text = F.coalesce("text", F.lit(" "))
    order = ["conv_id", "turn", "role", "head", "digest"]
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"),
                        gone.alias("gone"), F.substring(text, 1, HEAD).alias("head"), F.md5(text.cast("binary")).alias("digest"),
                        F.spark_partition_id().alias("salt"))  # equal rows of a hot conversation are spread by where they come from
    dealt = rows.repartitionByRange(*order, "salt").sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "gone")

    block_fields = T._parse_datatype_string(
        "conv_key string, part int, block int, codes string, keys array<binary>, turns array<long>, roles array<string>, texts array<string>")
    schema = T.StructType([T.StructField("conv_id", kind), *T._parse_datatype_string(RESULT).fields, *block_fields.fields])
    names = schema.fieldNames()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        shape, part = to_arrow_schema(schema), TaskContext.get().partitionId()
        out: list[dict] = []
        held: list[tuple] = []
        conv, started, first, block, size = None, False, True, 0, 0

        def cut() -> None:
            nonlocal held, block, size
            codes, _, keys = coded(held)
            out.append({
                "conv_id": conv, "conv_key": "null" if conv is None else f"={conv}", "part": part, "block": block, "codes": codes,
                "keys": keys, "turns": [r[0] for r in held], "roles": [r[1] for r in held], "texts": [r[2] for r in held]})
            held, block, size = [], block + 1, 0

        def end(last: bool) -> None:
            nonlocal held, block, size
            if first or last or block:
                cut()
            else:
                codes, n, _ = coded(held)
                cost, edited = audit(codes)
                lines = repaired(held, edited)
                out.append(_result(conv, turn_span(held), n, cost, edited, hashlib.sha256(lines.encode()).hexdigest(),
                                   lines if with_text else None))
            held, block, size = [], 0, 0

        def batch_of() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in out], shape.field(c).type) for c in names], schema=shape)
            out.clear()
            return made

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "gone")]
            for own, turn, role, said, lost in zip(*columns):
                if started and own != conv:
                    end(False)
                    first = False
                conv, started = own, True
                if not lost:
                    if len(held) >= BLOCK_ROWS or held and size + len(said) > BLOCK_BYTES:
                        cut()
                    held.append((turn, role, said))
                    size += len(said)
                if len(out) >= 2000 or len(out) and "texts" in out[-1]:
                    yield batch_of()
        if started:
            end(True)
        if out:
            yield batch_of()

    found = stored(dealt.mapInArrow(deal, schema), "repair-dealt")
    result = [f.name for f in T._parse_datatype_string(RESULT).fields]
    done = found.filter(F.col("part").isNull()).select("conv_id", *result)
    blocks = found.filter(F.col("part").isNotNull())
    joined = done.unionByName(_across(blocks, with_text, schema))
    return joined if with_text else joined.drop("repaired")


def _across(blocks: DataFrame, with_text: bool, schema: T.StructType) -> DataFrame:
    """The results of conversations that lie in several blocks."""
    at = ["conv_key", "part", "block"]
    keys = blocks.select(*at, F.posexplode("keys").alias("pos", "key")).filter(F.col("key").isNotNull()).select(
        *at, "pos", F.md5(F.concat(F.col("conv_key").cast("binary"), F.lit(b"\0"), "key")).alias("key"))
    again = keys.groupBy("key").agg(F.min(F.struct("part", "block")).alias("earliest"), F.count("*").alias("n")).filter(F.col("n") > 1)
    later = join_counted(keys, again, "key", "n", keys.count()).filter(F.struct("part", "block") > F.col("earliest"))
    narrow = blocks.select(*at, "codes").join(later.groupBy(*at).agg(F.collect_list("pos").alias("seen")), at, "left").select(
        *at, "codes", F.coalesce("seen", F.array().cast("array<int>")).alias("seen"))

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = {"codes": [], "duplicate": [], "truncated": [], "cost": [], "rank": []}
            for codes, seen in zip(batch.column("codes").to_pylist(), batch.column("seen").to_pylist()):
                lost = set(seen)
                made["duplicate"].append(len(lost))
                made["truncated"].append(-sum(codes[i].isupper() or codes[i] == "_" for i in lost))
                codes = "".join("X" if i in lost else c for i, c in enumerate(codes))
                made["codes"].append(codes)
                pieces = [codes[i: i + WIDTH] for i in range(0, len(codes), WIDTH)] or [""]
                top = levels([rows_stretch(piece) for piece in pieces])[-1][0]
                for name, of in (("cost", top.cost), ("rank", top.rank)):
                    made[name].append([of.get((q, e), -1) for q in STATES for e in STATES])
            yield pa.record_batch({
                **{c: batch.column(c) for c in at}, "codes": pa.array(made["codes"], pa.string()),
                "duplicate": pa.array(made["duplicate"], pa.int64()), "truncated": pa.array(made["truncated"], pa.int64()),
                "cost": pa.array(made["cost"], pa.list_(pa.int64())), "rank": pa.array(made["rank"], pa.list_(pa.int32()))})

    summaries = stored(narrow.mapInArrow(sum_up, "conv_key string, part int, block int, codes string, duplicate long, truncated long, "
                                         "cost array<long>, rank array<int>"), "repair-blocks")

    def choose(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["part", "block"])
        pairs = [(q, e) for q in STATES for e in STATES]
        parts = [Stretch({w: int(c) for w, c in zip(pairs, cost) if c >= 0}, {w: int(r) for w, r in zip(pairs, rank) if r >= 0}, {})
                 for cost, rank in zip(own["cost"], own["rank"])]
        tree = levels(parts)
        cost, end = whole_way(tree)
        way = ways(tree, 0, end)
        own["entry"], own["leave"] = np.array([w[0] for w in way], np.int32), np.array([w[1] for w in way], np.int32)
        own["paid"] = np.where(np.arange(len(own)) == len(own) - 1, cost, 0).astype(np.int64)
        own["closing"] = [None] * (len(own) - 1) + [endings()[end][1]]
        return own[[*at, "entry", "leave", "paid", "closing"]]

    routed = summaries.select(*at, "cost", "rank").groupBy("conv_key").applyInPandas(
        choose, "conv_key string, part int, block int, entry int, leave int, paid long, closing string")
    planned = blocks.select("conv_id", *at, "turns", "roles", "texts").join(
        summaries.select(*at, "codes", "duplicate", "truncated"), at).join(routed, at)

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in (one for i in range(batch.num_rows) for one in batch.slice(i, 1).to_pylist()):
                rows = list(zip(r["turns"], r["roles"], r["texts"]))
                _, n, _ = coded(rows)
                edited = edits(r["codes"], r["entry"], r["leave"]) + (r["closing"] or "")
                low, high, distinct = turn_span(rows)
                yield pa.RecordBatch.from_pylist([{
                    **{c: r[c] for c in ("conv_id", *at)}, "low": low, "high": high, "distinct": distinct,
                    "last_turn": r["turns"][-1] if rows else None, "first_turn": r["turns"][0] if rows else None, "rows": len(rows),
                    "opens": r["roles"][0][:1] if rows else None, "ends": r["roles"][-1][:1] if rows else None,
                    "blank": n["blank"], "duplicate": n["duplicate"] + r["duplicate"], "truncated": n["truncated"] + r["truncated"],
                    "illegal": n["illegal"], "cost": r["paid"], "audit": edited, "lines": repaired(rows, edited, r["entry"])}], shape)

    from pyspark.sql.pandas.types import to_arrow_schema
    traced_schema = T.StructType([schema["conv_id"], *T._parse_datatype_string(
        "conv_key string, part int, block int, low long, high long, distinct long, first_turn long, last_turn long, rows long, opens string, "
        "ends string, blank long, duplicate long, truncated long, illegal long, cost long, audit string, lines string").fields])
    shape = to_arrow_schema(traced_schema)
    traced = planned.mapInArrow(trace, traced_schema)
    out_schema = T.StructType([schema["conv_id"], *T._parse_datatype_string(RESULT).fields])
    out_shape = to_arrow_schema(out_schema)

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                if own is not None and own["key"] != r["conv_key"]:
                    yield finished(own)
                    own = None
                if own is None:
                    own = {"key": r["conv_key"], "conv_id": r["conv_id"], "sha": hashlib.sha256(), "any": False, "audit": [], "lines": [],
                           "n": dict.fromkeys(COUNTS, 0), "cost": 0, "low": None, "high": None, "distinct": 0, "ends": None, "turn": None}
                if r["rows"]:
                    own["n"]["illegal"] += own["ends"] is not None and own["ends"] + r["opens"] not in LEGAL
                    own["distinct"] -= own["turn"] is not None and own["turn"] == r["first_turn"]
                    own["ends"], own["turn"] = r["ends"], r["last_turn"]
                for name in COUNTS:
                    own["n"][name] += r[name]
                if r["low"] is not None:
                    own["low"] = r["low"] if own["low"] is None else min(own["low"], r["low"])
                    own["high"] = r["high"] if own["high"] is None else max(own["high"], r["high"])
                own["distinct"] += r["distinct"]
                own["cost"] += r["cost"]
                own["audit"].append(r["audit"])
                if r["lines"]:
                    for piece in (("\n" if own["any"] else "") + r["lines"],):
                        own["sha"].update(piece.encode())
                        if with_text:
                            own["lines"].append(piece)
                    own["any"] = True
        if own is not None:
            yield finished(own)

    def finished(own: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([_result(
            own["conv_id"], (own["low"], own["high"], own["distinct"]), own["n"], own["cost"], "".join(own["audit"]),
            own["sha"].hexdigest(), "".join(own["lines"]) if with_text else None)], out_shape)

    return traced.repartition("conv_key").sortWithinPartitions(*at).mapInArrow(chain, out_schema)
