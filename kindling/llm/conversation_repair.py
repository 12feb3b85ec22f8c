"""Operator 11: cheapest edits that give a conversation's roles the order ``(s?(ua)+)?``.

A path through the edits is weighed by one integer: its high digits are the cost, below them
stands one octal digit per audit letter, the first letter in the highest place, zeros after the
last.  The smaller integer is the cheaper path and, at equal cost, the one of the ASCII-least
audit, so a plain minimum over the edges of a DAG (row by row, four states of the pattern)
decides everything.  A minimum per state is enough: of two paths to one state over the same rows,
neither's audit starts with the other's unless their costs differ (only inserts could follow).

Conversations are cut into stretches of ``STRETCH`` rows along one sorted order, whatever their
length: each stretch gives the least weight from every state to every state, and stretches are
folded ``FAN`` at a time until one is left.  Texts take no part in this; they are read once more to
hash the repaired text, streamed in order (SHA-256 is sequential, so one conversation's text
passes through one task, of which only the hash's state is held).

Defined cases: a null role or text is one space, a null id or turn is one space in the key that
``damage`` hashes; rows without an id form one conversation; turns come null first, equal turns by role and a
digest of the text (so repeated rows are neighbours); an empty role has no initial and can't be
kept; an empty table gives no row; texts may be of any length.  Extra columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindling.llm.common import Scratch, table
from kindling.llm.prefix_trie import CRC_TABLE, crc_sql

#: Rows that one stretch of the DAG covers, and stretches folded into one.
STRETCH, FAN = 256, 64
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1  # costs
LETTERS = "\0DIKR"  # an octal digit is a letter's place here; zero pads the end
_D, _I, _K, _R = 1, 2, 3, 4
#: States of the pattern: nothing yet, after s, after u, after a pair.  The role that each takes next by an insert or a new role.
STATES, ENDS = 4, (0, 3)
STEP = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
NEXT_ROLE = ("user", "user", "assistant", "user")
_NEXT = tuple(STEP[r[0]][s] for s, r in enumerate(NEXT_ROLE))
_INSERTS = ((0, 2), (1, 2), (3, 2), (2, 3))  # in this order one pass reaches every least weight
OK, CUT, MUST_GO = 0, 1, 2  # a row's kind: sound, truncated, blank or duplicate


def _scalar(path: tuple[int, int, int], width: int) -> int:
    """The weight of (cost, digits, letters): the cost above ``width`` octal places, the audit's digits from the highest on."""
    cost, digits, used = path
    return cost << 3 * width | digits << 3 * (width - used)


def _relax(best: list, to: int, weight: int, used: int) -> None:
    if best[to] is None or weight < best[to][0]:
        best[to] = (weight, used)


def stretch_table(rows: list[tuple[str, int]], entries: Iterable[int], at_start: bool) -> list[list[tuple | None]]:
    """Per entry state the least path (cost, digits, letters) to each state over ``rows`` of (initial, kind).

    ``at_start``: inserts may precede the first row (elsewhere the stretch before has done them).
    """
    width = 3 * len(rows) + 3  # a letter per row, and two inserts at most before, between and after
    out: list[list[tuple | None]] = [[None] * STATES for _ in range(STATES)]

    def edge(path: tuple[int, int], cost: int, letter: int) -> tuple[int, int]:
        weight, used = path
        return weight + (cost << 3 * width) + (letter << 3 * (width - 1 - used)), used + 1

    def inserts(best: list) -> None:
        for s, t in _INSERTS:
            if best[s] is not None:
                _relax(best, t, *edge(best[s], INSERT, _I))

    for e in entries:
        best: list[tuple[int, int] | None] = [None] * STATES
        best[e] = (0, 0)
        if at_start:
            inserts(best)
        for initial, kind in rows:
            new: list[tuple[int, int] | None] = [None] * STATES
            step, more = STEP.get(initial, {}), TRUNCATED if kind == CUT else 0
            for s, path in enumerate(best):
                if path is None:
                    continue
                _relax(new, s, *edge(path, DELETE, _D))
                if kind != MUST_GO:
                    _relax(new, _NEXT[s], *edge(path, REROLE + more, _R))
                    if s in step:
                        _relax(new, step[s], *edge(path, KEEP + more, _K))
            inserts(new)
            best = new
        low = (1 << 3 * width) - 1
        out[e] = [None if p is None else (p[0] >> 3 * width, (p[0] & low) >> 3 * (width - p[1]), p[1]) for p in best]
    return out


def fold(first: list[list[tuple | None]], then: list[list[tuple | None]]) -> list[list[tuple | None]]:
    """Least paths over two neighbouring stretches."""
    width = sum(max(p[2] for row in t for p in row if p) for t in (first, then))
    out: list[list[tuple | None]] = [[None] * STATES for _ in range(STATES)]
    for e in range(STATES):
        for m, head in enumerate(first[e]):
            if head is None:
                continue
            for t, tail in enumerate(then[m]):
                if tail is None:
                    continue
                cand = (head[0] + tail[0], head[1] << 3 * tail[2] | tail[1], head[2] + tail[2])
                if out[e][t] is None or _scalar(cand, width) < _scalar(out[e][t], width):
                    out[e][t] = cand
    return out


#: What may precede a conversation's first row: nothing, one insert or two.
START: list[list[tuple | None]] = stretch_table([], [0], True)


def letters(path: tuple) -> str:
    digits = oct(path[1])[2:] if path[2] else ""
    return "".join(LETTERS[int(c)] for c in digits)


def cheapest(t: list[list[tuple | None]]) -> tuple[int, str]:
    """(cost, audit) of a conversation's whole table."""
    ends = [t[0][s] for s in ENDS if t[0][s]]
    width = max(p[2] for p in ends)
    path = min(ends, key=lambda p: _scalar(p, width))
    return path[0], letters(path)


def least_edits(rows: list[tuple[str, int]]) -> tuple[int, str]:
    """(cost, audit) of a whole conversation of (initial, kind)."""
    return cheapest(stretch_table(rows, [0], True))


def _packed(t: list[list[tuple | None]]) -> list[bytes | None]:
    """A table as 16 cells: cost, a colon and the audit's octal digits."""
    return [None if p is None else b"%d:%s" % (p[0], oct(p[1])[2:].encode() if p[2] else b"") for row in t for p in row]


def _unpacked(cells: list[bytes | None]) -> list[list[tuple | None]]:
    flat = []
    for c in cells:
        if c is None:
            flat.append(None)
        else:
            cost, _, digits = c.partition(b":")
            flat.append((int(cost), int(digits, 8) if digits else 0, len(digits)))
    return [flat[s * STATES:(s + 1) * STATES] for s in range(STATES)]


def _legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


def damage(df: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after the damage that the contract sets, by crc32 of ``conv_id:turn``."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    fault = (F.crc32(key.cast("binary")) % 20).cast("int")
    role, text = (F.coalesce(F.col(c).cast("string"), space) for c in ("role", "text"))
    rows = df.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), fault.alias("fault"), role.alias("role"), text.alias("text"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("fault") == 0, 0).when(F.col("fault") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(True), copies)).alias("one")).drop("one")


_ORDER = ["turn", "role", "digest"]
_BLANK = "\x20\x09\x0a\x0b\x0c\x0d"


def coded_rows(rows: DataFrame) -> DataFrame:
    """Rows without their texts: conv_id, turn, role, digest of the text, last (its last character that isn't blank), initial."""
    last = F.substring(F.rtrim(F.col("text"), F.lit(_BLANK)), -1, 1)
    return rows.select("conv_id", "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"), last.alias("last"), F.substring("role", 1, 1).alias("initial"))


def _with_kinds(coded: DataFrame) -> DataFrame:
    """Distinct rows with their number, ``kind`` of the first of them, and its first fault."""
    same = coded.groupBy("conv_id", "turn", "role", "digest", "last", "initial").agg(F.count(F.lit(1)).alias("copies"))
    # a text that comes again in a later turn: only those groups are joined back
    again = same.groupBy("conv_id", "role", "digest").agg(F.min(F.struct("turn")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again = again.select(F.col("conv_id").alias("a_conv"), F.col("role").alias("a_role"), F.col("digest").alias("a_digest"), "first")
    same = same.join(again, same["conv_id"].eqNullSafe(again["a_conv"]) & (same["role"] == again["a_role"]) & (same["digest"] == again["a_digest"]), "left")
    blank = F.col("last") == ""
    later = F.col("first").isNotNull() & ~F.struct("turn").eqNullSafe(F.col("first"))
    fault = F.when(blank, "blank").when(later, "duplicate").when(~F.col("last").isin(".", "!", "?"), "truncated").otherwise("none")
    return same.select("conv_id", "turn", "role", "digest", "initial", "copies", fault.alias("fault"))


_STRETCHES = pa.schema([("conv_id", pa.int64()), ("task", pa.int64()), ("k", pa.int64()), ("whole", pa.bool_()), ("cells", pa.list_(pa.binary())),
                        ("head", pa.string()), ("tail", pa.string()), ("illegal", pa.int64())])
_STRETCH_DDL = "conv_id long, task long, k long, whole boolean, cells array<binary>, head string, tail string, illegal long"


def _stretches(rows: DataFrame, stretch: int) -> DataFrame:
    """Tables of all stretches, cut along the rows' sorted order; a hot conversation spans several tasks.

    ``whole``: the stretch has a conversation's first row and the inserts before it.
    """

    def stream(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, out = TaskContext.get().partitionId(), []
        conv, k, rows, seen, first = None, 0, [], False, False

        def close() -> None:
            whole = first and k == 0
            got = stretch_table(rows, [0] if whole else range(STATES), whole)
            bad = sum(not _legal(a[0], b[0]) for a, b in zip(rows, rows[1:], strict=False))
            out.append({"conv_id": conv, "task": task, "k": k, "whole": whole, "cells": _packed(got), "head": rows[0][0], "tail": rows[-1][0], "illegal": bad})

        for batch in batches:
            for c, initial, copies, fault in zip(*[col.to_pylist() for col in batch.columns], strict=True):
                if not seen or c != conv:
                    if rows:
                        close()
                    # the first conversation of a task may have begun in the task before
                    conv, k, rows, first, seen = c, 0, [], seen, True
                kind = {"none": OK, "truncated": CUT}.get(fault, MUST_GO)
                for copy in range(copies):
                    if len(rows) >= stretch:
                        close()
                        k, rows = k + 1, []
                    rows.append((initial, MUST_GO if copy else kind))
            if out:
                yield pa.RecordBatch.from_pylist(out, _STRETCHES)
                out.clear()
        if rows:
            close()
            yield pa.RecordBatch.from_pylist(out, _STRETCHES)

    by = ["conv_id", *_ORDER]
    rows = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    return rows.select("conv_id", "initial", "copies", "fault").mapInArrow(stream, _STRETCH_DDL)


def _join_stretches(parts: list[dict]) -> dict:
    """Neighbouring stretches as one."""
    whole, t = dict(parts[0]), _unpacked(parts[0]["cells"])
    for p in parts[1:]:
        t = fold(t, _unpacked(p["cells"]))
        whole["illegal"] += p["illegal"] + (not _legal(whole["tail"], p["head"]))
        whole["tail"] = p["tail"]
    return whole | {"cells": _packed(t)}


def _join_groups(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, held = None, []
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            now = (r["conv_id"], r.pop("group"))
            if held and now != key:
                out.append(_join_stretches(held))
                held = []
            key = now
            held.append(r)
        if out:
            yield pa.RecordBatch.from_pylist(out, _STRETCHES)
    if held:
        yield pa.RecordBatch.from_pylist([_join_stretches(held)], _STRETCHES)


def _folded(parts: DataFrame, scratch: Scratch, fan: int) -> DataFrame:
    """One table per conversation.  At most ``fan`` stretches are folded into one at a time: first
    those that one task cut, by their number there, then those of neighbouring tasks."""
    while True:
        counts = parts.groupBy("conv_id", "task").agg(F.count(F.lit(1)).alias("n")).groupBy("conv_id").agg(F.sum("n").alias("all"), F.max("n").alias("n"))
        most = counts.agg(F.max("all").alias("all"), F.max("n").alias("n")).first()
        if (most["all"] or 0) <= 1:
            return parts
        task, k = F.col("task"), F.col("k")
        if most["all"] <= fan:
            group = F.lit("")
        elif most["n"] > 1:
            k = F.floor(k / fan)
            group = F.concat_ws(":", task, k)
        else:
            task = F.floor(task / fan)
            group = task.cast("string")
        keyed = parts.withColumn("group", group).repartition("conv_id", "group").sortWithinPartitions("conv_id", "group", "task", "k")
        folded = keyed.mapInArrow(_join_groups, _STRETCH_DDL)
        parts = scratch.write(folded.withColumns({"task": task.cast("long"), "k": k.cast("long")}), "folded")


def _audits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            t = _unpacked(r["cells"])
            cost, audit = cheapest(t if r["whole"] else fold(START, t))
            out.append((r["conv_id"], cost, audit, r["illegal"]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.int64()), strict=True)],
                                             ["conv_id", "cost", "audit", "illegal"])


def _replay(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, is_row, role, text): a conversation's audit (as text), then its rows, to the hash of its repaired text."""
    out: list = []
    conv, audit, at, state, sha, started = None, None, 0, 0, None, False

    def emit(role: str, text: bytes) -> None:
        nonlocal started, state
        if started:
            sha.update(b"\n")
        sha.update(role.encode() + b":")
        sha.update(text)
        started, state = True, STEP[role[0]][state]

    def inserts() -> None:
        nonlocal at
        while at < len(audit) and audit[at] == "I":
            emit(NEXT_ROLE[state], b"")
            at += 1

    def finish() -> None:
        inserts()
        out.append((conv, sha.hexdigest()))

    def made() -> pa.RecordBatch:
        got = pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], pa.int64()), pa.array([h for _, h in out])], ["conv_id", "repaired_sha256"])
        out.clear()
        return got

    for batch in batches:
        cols = [batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()]
        for c, is_row, role, text in zip(*cols, batch.column(3).cast(pa.binary()), strict=True):
            if not is_row:
                if audit is not None:
                    finish()
                conv, audit, at, state, sha, started = c, text.as_py().decode(), 0, 0, hashlib.sha256(), False
                continue
            inserts()
            letter = audit[at]
            at += 1
            if letter != "D":
                emit(role if letter == "K" else NEXT_ROLE[state], text.as_py())
        if out:
            yield made()
    if audit is not None:
        finish()
        yield made()


def repair_conversations(df: DataFrame, stretch: int = STRETCH, fan: int = FAN) -> DataFrame:
    """The cheapest repair of each conversation of (conv_id, turn, role, text): counts of faults, cost, audit and the hash of its text."""
    scratch = Scratch(df.sparkSession, "repair")
    df = df.select("conv_id", "turn", "role", "text")
    kinds = scratch.write(_with_kinds(coded_rows(df)), "kinds")
    repeats = F.when(F.col("fault").isin("blank", "duplicate"), 0).otherwise(F.col("copies") - 1)
    of = lambda fault, n: F.sum(F.when(F.col("fault") == fault, n).otherwise(0))
    counts = kinds.groupBy("conv_id", "turn").agg(of("blank", F.col("copies")).alias("blank"), (of("duplicate", F.col("copies")) + F.sum(repeats)).alias("duplicate"),
                                                  of("truncated", F.lit(1)).alias("truncated"))
    counts = counts.groupBy("conv_id").agg(*[F.sum(c).cast("long").alias(c) for c in ("blank", "duplicate", "truncated")],
                                           F.coalesce(F.try_add(F.try_subtract(F.max("turn"), F.min("turn")), 1 - F.count("turn")), F.lit(0)).alias("gaps"))
    parts = _folded(scratch.write(_stretches(kinds, stretch), "stretches"), scratch, fan)
    audits = scratch.write(parts.mapInArrow(_audits, "conv_id long, cost long, audit string, illegal long"), "audits")
    texts = df.select("conv_id", F.lit(True).alias("is_row"), "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"), "text")
    none = F.lit(None)
    led = audits.select("conv_id", F.lit(False).alias("is_row"), none.cast("long").alias("turn"), none.cast("string").alias("role"), none.cast("binary").alias("digest"), F.col("audit").alias("text"))
    told = led.unionByName(texts).repartition("conv_id").sortWithinPartitions("conv_id", "is_row", *_ORDER)
    hashes = told.select("conv_id", "is_row", "role", "text").mapInArrow(_replay, "conv_id long, repaired_sha256 string")
    out = counts
    for other in (audits, hashes):
        other = other.withColumnRenamed("conv_id", "_other")
        out = out.join(other, out["conv_id"].eqNullSafe(other["_other"])).drop("_other")
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return repaired_after_damage(conversations)


def repaired_after_damage(conversations: DataFrame, stretch: int = STRETCH, fan: int = FAN) -> DataFrame:
    """Every conversation of the table, damaged and repaired; one that loses all rows has zeros and the empty text's hash."""
    ids = conversations.select(F.col("conv_id").cast("long").alias("id")).distinct()
    got = repair_conversations(damage(conversations), stretch, fan)
    got = ids.join(got, ids["id"].eqNullSafe(got["conv_id"]), "left")
    zeros = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return got.select(F.col("id").alias("conv_id"), *zeros, F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def _sql() -> str:
    """The DP row by row: per state the least (cost, audit), which carries the repaired text along."""
    path = lambda s, cost, letter, text: f"{{'c': {s}.c + {cost}, 'a': {s}.a || '{letter}', 'x': {text}}}"
    line = lambda s, role, text: f"CASE WHEN {s}.x IS NULL THEN {role} || ':' || {text} ELSE {s}.x || chr(10) || {role} || ':' || {text} END"
    put = lambda s, role: path(s, INSERT, "I", line(s, f"'{role}'", "''"))

    def closed(source: str, keys: str) -> str:
        two = f"SELECT {keys}, x0, x1, x3, list_min([x2, {put('x0', 'user')}, {put('x1', 'user')}, {put('x3', 'user')}]) AS x2 FROM ({source})"
        return f"SELECT {keys}, x0, x1, x2, list_min([x3, {put('x2', 'assistant')}]) AS x3 FROM ({two})"

    far = f"{{'c': {1 << 40}, 'a': '', 'x': NULL::VARCHAR}}"
    less = lambda cond, p: f"CASE WHEN {cond} THEN {p} ELSE {far} END"
    may, cut = "kind <> 2", "(kind = 1)::INT"
    cand: list[list[str]] = [[path(f"p.x{s}", DELETE, "D", f"p.x{s}.x")] for s in range(STATES)]
    for s in range(STATES):
        cand[_NEXT[s]].append(less(may, path(f"p.x{s}", f"{REROLE} + {cut}", "R", line(f"p.x{s}", f"'{NEXT_ROLE[s]}'", "o.text"))))
        for initial, steps in STEP.items():
            if s in steps:
                cand[steps[s]].append(less(f"{may} AND o.role[1] = '{initial}'", path(f"p.x{s}", f"{KEEP} + {cut}", "K", line(f"p.x{s}", "o.role", "o.text"))))
    row = "SELECT o.conv_id, o.rn, " + ", ".join(f"list_min([{', '.join(c)}]) AS x{t}" for t, c in enumerate(cand)) + " FROM p JOIN o ON o.conv_id IS NOT DISTINCT FROM p.conv_id AND o.rn = p.rn + 1"
    start = f"SELECT conv_id, 0::BIGINT AS rn, {{'c': 0::BIGINT, 'a': '', 'x': NULL::VARCHAR}} AS x0, {far} AS x1, {far} AS x2, {far} AS x3 FROM (SELECT DISTINCT conv_id FROM conversations)"
    blank = "[ \t\n\v\f\r]"
    return f"""
WITH RECURSIVE {CRC_TABLE},
f AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
             ({crc_sql("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")}) % 20 AS fault
      FROM conversations, crc),
d AS (SELECT conv_id, turn, CASE fault WHEN 4 THEN 'user' ELSE role END AS role,
             CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
      FROM f, range(2) AS t(i) WHERE fault <> 0 AND (i = 0 OR fault = 3)),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS rn FROM d),
k AS (SELECT *, regexp_replace(text, '{blank}+$', '') AS body, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY rn) AS seen,
             lag(role) OVER (PARTITION BY conv_id ORDER BY rn) AS was FROM n),
o AS (SELECT conv_id, turn, rn, role, text, CASE WHEN body = '' OR seen > 1 THEN 2 WHEN right(body, 1) IN ('.', '!', '?') THEN 0 ELSE 1 END AS kind,
             (body = '')::INT AS blank, (body <> '' AND seen > 1)::INT AS duplicate,
             (rn > 1 AND coalesce(was[1] || role[1] NOT IN ('su', 'ua', 'au'), true))::INT AS illegal FROM k),
p AS ({closed(start, 'conv_id, rn')} UNION ALL {closed(row, 'conv_id, rn')}),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, sum(blank) AS blank, sum(duplicate) AS duplicate,
             count(*) FILTER (kind = 1) AS truncated, sum(illegal) AS illegal, max(rn) AS rn FROM o GROUP BY conv_id),
e AS (SELECT p.conv_id, list_min([x0, x3]) AS best, c.* EXCLUDE (conv_id, rn) FROM p LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM p.conv_id
      WHERE p.rn = coalesce(c.rn, 0))
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, best.c::BIGINT AS cost, best.a AS audit,
       sha256(coalesce(best.x, '')) AS repaired_sha256
FROM e
"""


OP11_SQL = _sql()
