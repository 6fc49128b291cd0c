"""Conversation structure repair by a suffix-shared automaton.

A conversation's rows, in order, become a signature: one symbol per row, which
says the role's initial and whether the row is truncated, or that it must go.
What the cheapest repair of the rest of a conversation costs depends only on
the rest of its signature and on the state of the role grammar, so equal
suffixes of all signatures share one automaton node.  The distinct signatures
are sorted by their reversals (a range partitioning, which hot signatures
cannot skew as each occurs once); in that order signatures with a common suffix
are neighbours, and a task needs only the nodes of the current path: for each
node and grammar state the cost to the end and the first edit of the best audit
are computed once (nodes on the border of two ranges twice).

Rows travel without texts (hashes and a short prefix) to find the signatures,
and once with texts to be repaired: each conversation's audit precedes its rows
in one sorted partition, and the repaired text is hashed as it streams by.

A conversation's rows go by turn (nulls first), role and text; rows of one turn
and role whose texts agree in their first 32 characters go by a hash of the text.

Edits are Keep (0), Rerole to user or assistant (2), Delete (3), Insert of an
empty user or assistant row (2); a truncated row that stays adds 1; blank and
duplicate rows must be deleted.  The repaired roles' initials match
``(s?(ua)+)?``.  An edit's role follows from the grammar state, and the edits
possible in a state have different initials, so the least audit among the
cheapest is found by first letters: Delete, Insert, Keep, Rerole.

Memory: a task holds one signature (a byte per row) and one path; rows stream
through sorted partitions that spill.  One conversation's hash is one sequence,
so its rows pass one task, however many there are.

Defined cases: null ids and turns are one conversation and turn of their own
(in the damage key and as values, nulls of ``role`` and ``text`` count as one
space, so such texts are blank); rows that repeat are duplicates; a role without
characters adds nothing to the initials when kept; conversations without rows
have zeros, an empty audit and the hash of the empty string; an empty table
gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.llm.frames import materialize, ship_package

PREFIX = 32
SPACES = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
START, SYSTEM, USER, ASSISTANT = range(4)
#: state after a row of an initial, by state; initials that are absent cannot follow
NEXT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
#: state after an inserted or reroled row
FILL = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: symbols: a kept row's initial (o another, e none), in upper case if truncated; x for rows that must go
GONE, NONE = "x", "e"


def rows_of(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
            damaged: bool = False) -> DataFrame:
    """``(conv, turn, role, text, live, copy)`` of every row; with ``damaged`` by the damage rule, dropped rows being not ``live``."""
    space = F.lit(" ")
    t = conversations.select(F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").cast("long").alias("turn"),
                             F.coalesce(F.col(f"`{role_col}`").cast("string"), space).alias("role"),
                             F.coalesce(F.col(f"`{text_col}`").cast("string"), space).alias("text"))
    if not damaged:
        return t.select("*", F.lit(True).alias("live"), F.lit(0).alias("copy"))
    key = F.concat(F.coalesce(F.col("conv").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(key.cast("binary")) % 20
    text = (F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return t.withColumn("kind", kind).select("conv", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
                                             text.alias("text"), (F.col("kind") != 0).alias("live"), F.explode(copies).alias("copy"))


def order() -> list[Column]:
    """Order of the rows of one conversation; needs ``turn, role, start, h1, h2``."""
    return [F.asc_nulls_first("turn"), F.asc("role"), F.asc("start"), F.asc("h1"), F.asc("h2"), F.asc("copy")]


def with_order(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"start": F.substring("text", 1, PREFIX), "h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit("text"), "text", F.length("text"))})


def symbols(rows: DataFrame) -> DataFrame:
    """Rows without texts: order columns, ``live``, ``initial``, and ``fault`` (blank, duplicate, truncated or null)."""
    body = F.rtrim(F.col("text"), F.lit(SPACES))
    t = with_order(rows).withColumns({"last": F.substring(body, -1, 1), "initial": F.substring("role", 1, 1)})
    t = t.select("conv", "turn", "role", "start", "h1", "h2", "copy", "live", "initial", "last")
    same = Window.partitionBy("conv", "role", "h1", "h2", "live").orderBy(*order())
    fault = (F.when(F.col("last") == "", "blank").when(F.row_number().over(same) > 1, "duplicate")
             .when(~F.col("last").isin(".", "!", "?"), "truncated"))
    return t.withColumn("fault", F.when(F.col("live"), fault)).drop("last")


HEAD = "turns long, gaps long, blank long, duplicate long, truncated long, illegal long, signature string"


def signatures(marked: DataFrame, kind: str) -> DataFrame:
    """``(conv, gaps, blank, duplicate, truncated, illegal, signature)`` of every conversation; ``kind`` is the type of ``conv``."""
    ship_package(marked.sparkSession)
    part = marked.select("conv", "turn", "role", "start", "h1", "h2", "copy", "live", "initial", "fault")
    part = part.repartition(F.col("conv")).sortWithinPartitions("conv", *order()).select("conv", "turn", "live", "initial", "fault")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, conv = False, None
        out: list[tuple] = []

        def fresh() -> None:
            nonlocal signature, counts, turns, least, most, turn, before, illegal
            signature, counts = bytearray(), {"blank": 0, "duplicate": 0, "truncated": 0}
            turns, least, most, turn, before, illegal = 0, None, None, None, None, 0

        def close() -> None:
            gaps = most - least + 1 - turns if turns else 0
            out.append((conv, turns, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, signature.decode()))

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out))
            out.clear()
            return pa.record_batch([pa.array(columns[0], kinds), *(pa.array(c, pa.int64()) for c in columns[1:-1]), pa.array(columns[-1], pa.string())],
                                   names=["conv", "turns", "gaps", "blank", "duplicate", "truncated", "illegal", "signature"])

        signature, counts = bytearray(), {}
        turns, least, most, turn, before, illegal = 0, None, None, None, None, 0
        for batch in batches:
            kinds = batch.column(0).type
            for c, t, live, initial, fault in zip(*(x.to_pylist() for x in batch.columns)):
                if not begun or c != conv:
                    if begun:
                        close()
                    begun, conv = True, c
                    fresh()
                if not live:
                    continue
                if t is not None:
                    least, most = t if least is None else least, t
                    turns, turn = turns + (t != turn), t
                if before is not None and before + initial not in ("su", "ua", "au"):
                    illegal += 1
                before = initial
                if fault:
                    counts[fault] += 1
                if fault in ("blank", "duplicate"):
                    signature += GONE.encode()
                else:
                    mark = initial if initial in ("s", "u", "a") else "o" if initial else NONE
                    signature += (mark.upper() if fault else mark).encode()
                if len(out) >= 10_000:
                    yield flush()
            if out:
                yield flush()
        if begun:
            close()
            yield flush()

    return part.mapInArrow(run, f"conv {kind}, {HEAD}")


class Node:
    """A suffix of signatures: per grammar state the cost to the end and the first edit of the best audit."""

    __slots__ = ("cost", "edit")

    def __init__(self, symbol: str, rest: Node | None):
        found = [self._here(symbol, rest, state) for state in range(4)]
        for _ in range(2):  # a row is inserted at most twice before the first other edit
            found = [min(found[q], (INSERT + found[FILL[q]][0], "I")) for q in range(4)]
        self.cost = [c for c, _ in found]
        self.edit = [e for _, e in found]

    @staticmethod
    def _here(symbol: str, rest: Node | None, state: int) -> tuple[float, str]:
        """The best edit that uses up the row, as (cost, initial)."""
        if rest is None:
            return (0, "") if state in (START, ASSISTANT) else (float("inf"), "")
        found = [(DELETE + rest.cost[state], "D")]
        if symbol != GONE:
            low = symbol.lower()
            more = TRUNCATED if symbol != low else 0
            after = state if low == NONE else NEXT[state].get(low)
            if after is not None:
                found.append((KEEP + more + rest.cost[after], "K"))
            found.append((REROLE + more + rest.cost[FILL[state]], "R"))
        return min(found)


END = Node("", None)


def step(edit: str, symbol: str, state: int) -> int:
    """Grammar state after an edit of a row of ``symbol``."""
    if edit in ("I", "R"):
        return FILL[state]
    if edit == "K" and symbol.lower() != NONE:
        return NEXT[state][symbol.lower()]
    return state


def audits(signatures: DataFrame) -> DataFrame:
    """``(signature, cost, audit)`` of distinct signatures."""
    ship_package(signatures.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, last = [END], ""  # path[i] is the node of the last i symbols
        for batch in batches:
            costs, found = [], []
            backwards = batch.column(0).to_pylist()
            for b in backwards:
                same = 0
                while same < len(b) and same < len(last) and b[same] == last[same]:
                    same += 1
                del path[same + 1:]
                for symbol in b[same:]:
                    path.append(Node(symbol, path[-1]))
                last = b
                audit, state, at = [], START, len(b)
                costs.append(path[at].cost[START])
                while edit := path[at].edit[state]:
                    audit.append(edit)
                    symbol = b[at - 1] if at else ""
                    state = step(edit, symbol, state)
                    at -= edit != "I"
                found.append("".join(audit))
            yield pa.record_batch([pa.array([b[::-1] for b in backwards], pa.string()), pa.array(costs, pa.int64()), pa.array(found, pa.string())],
                                  names=["signature", "cost", "audit"])

    backwards = signatures.select(F.reverse("signature").alias("backwards"))
    return backwards.repartitionByRange("backwards").sortWithinPartitions("backwards").mapInArrow(run, "signature string, cost long, audit string")


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _walk(heads_and_rows: DataFrame, kind: str, with_text: bool) -> DataFrame:
    """Applies every conversation's audit to its rows, which follow it in a partition sorted by conversation."""
    ship_package(heads_and_rows.sparkSession)
    schema = (f"conv {kind}, place long, role string, text string, edit string" if with_text else
              f"conv {kind}, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0
        head, digest, at, state, place = None, hashlib.sha256(), 0, START, 0

        def put(role: str, text: str, edit: str) -> None:
            nonlocal place, size
            if with_text:
                out.append((head[0], place, role, text, edit))
                size += len(text)
            else:
                digest.update((("\n" if place else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
            place += 1

        def insert() -> None:
            nonlocal at, state
            while at < len(head[1]) and head[1][at] == "I":
                at, state = at + 1, FILL[state]
                put(ROLES[state], "", "I")

        def close() -> None:
            insert()
            if not with_text:
                out.append((head[0], *head[2], head[1], digest.hexdigest()))

        def flush() -> pa.RecordBatch:
            nonlocal size
            columns = list(zip(*out))
            out.clear()
            size = 0
            kinds_ = [ids] + ([pa.int64(), pa.string(), pa.string(), pa.string()] if with_text else [pa.int64()] * len(COUNTS) + [pa.string()] * 2)
            names = ["conv", "place", "role", "text", "edit"] if with_text else ["conv", *COUNTS, "audit", "repaired_sha256"]
            return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds_)], names=names)

        for batch in batches:
            ids = batch.column(0).type
            for c, is_head, audit, counts, role, text in zip(*(x.to_pylist() for x in batch.columns)):
                if is_head:
                    if head is not None:
                        close()
                    head, digest, at, state, place = (c, audit, counts), hashlib.sha256(), 0, START, 0
                else:
                    insert()
                    edit, at = head[1][at], at + 1
                    if edit == "R":
                        state = FILL[state]
                        put(ROLES[state], text, edit)
                    elif edit == "K":
                        state = NEXT[state][role[0]] if role else state
                        put(role, text, edit)
                if len(out) >= 10_000 or size > 1 << 24:
                    yield flush()
            if out:
                yield flush()
        if head is not None:
            close()
            if out:
                yield flush()

    return heads_and_rows.mapInArrow(run, schema)


def _prepared(rows: DataFrame) -> tuple[DataFrame, str]:
    """Heads (counts, cost, audit) and live rows of every conversation, sorted for :func:`_walk`."""
    spark = rows.sparkSession
    kind = rows.schema["conv"].dataType.simpleString()
    heads = materialize(signatures(symbols(rows), kind), spark, "signatures")
    found = materialize(audits(heads.select("signature").distinct()), spark, "audits")
    heads = heads.join(found, "signature")
    nothing = [F.lit(None).cast("string").alias(c) for c in ("role", "start")] + [F.lit(None).cast("long").alias(c) for c in ("h1", "h2")]
    top = heads.select("conv", F.lit(None).cast("long").alias("turn"), *nothing, F.lit(0).alias("copy"), F.lit(True).alias("head"), "audit",
                       F.array(*COUNTS).alias("counts"), F.lit(None).cast("string").alias("text"))
    body = with_order(rows.where("live")).select("conv", "turn", "role", "start", "h1", "h2", "copy", F.lit(False).alias("head"),
                                                 F.lit(None).cast("string").alias("audit"), F.lit(None).cast("array<long>").alias("counts"), "text")
    both = top.unionByName(body).repartition(F.col("conv")).sortWithinPartitions("conv", F.desc("head"), *order())
    return both.select("conv", "head", "audit", "counts", "role", "text"), kind


def report(rows: DataFrame) -> DataFrame:
    """Per conversation of :func:`rows_of`: faults, the cost and audit of the cheapest repair, and the hash of the repaired rows."""
    both, kind = _prepared(rows)
    return _walk(both, kind, with_text=False)


def repair(rows: DataFrame) -> DataFrame:
    """``(conv, place, role, text, edit)``: the repaired conversations of :func:`rows_of`, row by row."""
    both, kind = _prepared(rows)
    return _walk(both, kind, with_text=True)
