"""Repair of the structure of conversations by target alignment.

A conversation is well formed when the initials of its roles spell ``(s?(ua)+)?``.
Its rows are aligned to the grammar's string of every feasible length by Wagner and
Fischer's table: keep a row (cost 0), give it the role that is due (2), delete it (3, and
nothing else for a blank or repeated row) or insert an empty turn (2); a truncated row
that stays costs 1.  Read from its end the string of every even length is ``...uaua``,
so one table from the end holds the alignments to all lengths, a column each; an odd
length starts with a kept system row, before which all is deleted.

Only cells whose cheapest beginning leaves them within the incumbent cost are filled
(Ukkonen's band): the beginning is bounded by a walk over the rows that remembers only
what is due next, and its cost at the end is the incumbent.  From every length that
meets it the audit, the initials of the edits, is traced back, the least letter first,
and the least audit of all lengths is taken.

One conversation is one row of the result, its audit and digest included, so it is read
in order by one task; but it is streamed.  The alignment sees one letter for each turn
(about 200 bytes of table each), and texts pass by one at a time in a second reading that
applies the audit.  Repeated rows are found by grouped keys, not by a set in memory.

Defined results: a null conv_id is a conversation; a null role or text is one space; null
turns come first, and rows of one turn are ordered by role and text hash; a role without
a character has no initial and cannot be kept; equal rows are different turns of which
only the first is no duplicate.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import row_id, stored, table, user_id

RESET, DELETE, INSERT, CUT = 2, 3, 2, 1
NEVER = 1 << 60
BLANKS = " \t\n\x0b\f\r"
LEGAL = {"su", "ua", "au"}
LONG_MAX = 2**63 - 1

#: letters of a row: initial of its role (x: none of the grammar's), and what is wrong with it
FINE, BLANK, REPEATED, TRUNCATED = "nbdt"


def _walk(rows: str) -> tuple[list[tuple[int, int]], int]:
    """Cheapest beginnings before each row, by what is due next (u or a), and the cheapest whole."""
    none, opened, due_u, due_a = 0, NEVER, NEVER, NEVER
    before = []
    for at in range(0, len(rows) + 1, 2):
        due_a = min(due_a, none + INSERT, opened + INSERT, due_u + INSERT)
        due_u = min(due_u, due_a + INSERT)
        before.append((min(none, opened, due_u), due_a))
        if at == len(rows):
            break
        role, fault = rows[at], rows[at + 1]
        kept = NEVER if fault in (BLANK, REPEATED) else CUT * (fault == TRUNCATED)
        to_a = min(none, opened, due_u) + kept + RESET * (role != "u")
        to_u = due_a + kept + RESET * (role != "a")
        begun = none + kept if role == "s" else NEVER
        none, opened = none + DELETE, min(opened + DELETE, begun)
        due_u, due_a = min(due_u + DELETE, to_u), min(due_a + DELETE, to_a)
    return before, min(none, due_u)


def _table(rows: str, before: list[tuple[int, int]], incumbent: int) -> list[dict[int, int]]:
    """Cost to align the rows from i on with the last k roles of ``...uaua``, for the cells in the band."""
    n = len(rows) // 2
    cells: list[dict[int, int]] = [{} for _ in range(n + 1)]
    for i in range(n, -1, -1):
        after, here = (cells[i + 1], cells[i]) if i < n else ({}, cells[n])
        low, high = (min(after, default=0), max(after, default=-1) + 1) if i < n else (0, 0)
        k = low
        while True:
            cost = 0 if i == n and k == 0 else NEVER
            if i < n:
                cost = after.get(k, NEVER) + DELETE
                if k:
                    cost = min(cost, after.get(k - 1, NEVER) + _stay(rows, i, k))
            if k:
                cost = min(cost, here.get(k - 1, NEVER) + INSERT)
            if cost + before[i][k % 2] <= incumbent:
                here[k] = cost
            elif k > high:
                break
            k += 1
    return cells


def _stay(rows: str, i: int, k: int) -> int:
    """Cost of a row in the place with k roles from it to the end."""
    role, fault = rows[2 * i], rows[2 * i + 1]
    if fault in (BLANK, REPEATED):
        return NEVER
    return RESET * (role != "ua"[k % 2]) + CUT * (fault == TRUNCATED)


def _trace(rows: str, cells: list[dict[int, int]], i: int, k: int) -> str:
    """Least of the cheapest audits from a cell on: D, then I, then K or R."""
    out, n = [], len(rows) // 2
    while i < n or k:
        cost = cells[i][k]
        if i < n and cells[i + 1].get(k, NEVER) + DELETE == cost:
            out.append("D")
            i += 1
        elif k and cells[i].get(k - 1, NEVER) + INSERT == cost:
            out.append("I")
            k -= 1
        else:
            out.append("K" if rows[2 * i] == "ua"[k % 2] else "R")
            i, k = i + 1, k - 1
    return "".join(out)


def _repair(rows: str) -> tuple[int, str]:
    before, incumbent = _walk(rows)
    cells = _table(rows, before, incumbent)
    # even lengths
    audits = [_trace(rows, cells, 0, k) for k, cost in cells[0].items() if k % 2 == 0 and cost == incumbent]
    # odd lengths: a system row first, nothing before it
    for i in range(len(rows) // 2):
        if DELETE * i > incumbent:
            break
        if rows[2 * i] == "s" and rows[2 * i + 1] in (FINE, TRUNCATED):
            rest = incumbent - DELETE * i - CUT * (rows[2 * i + 1] == TRUNCATED)
            audits += ["D" * i + "K" + _trace(rows, cells, i + 1, k) for k, cost in cells[i + 1].items() if k and k % 2 == 0 and cost == rest]
    return incumbent, min(audits)


#: most conversations are short and alike
_repair_short = lru_cache(100_000)(_repair)


def repair(rows: str) -> tuple[int, str]:
    """Cost and audit of a conversation, given two letters for each of its rows."""
    return _repair_short(rows) if len(rows) <= 64 else _repair(rows)


# ---------------------------------------------------------------------------
# tables
# ---------------------------------------------------------------------------

def turns_of(chats: DataFrame, change: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """conv (see ``row_id``), turn, o1, o2, o3 (order within a turn), role, text: a row per turn, nulls filled.

    ``change`` may alter role and text of (conv_id, turn, role, text, times) and how many
    ``times`` a row stands there (0: it is gone).
    """
    text = [F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")]
    rows = chats.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), *text)
    # equal rows are counted, and told apart again by their number
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("times"))
    rows = rows.withColumns({"o1": F.col("role"), "o2": F.md5("text")})
    rows = change(rows) if change else rows
    return rows.select(
        row_id("conv_id").alias("conv"), "turn", "o1", "o2",
        F.explode(F.when(F.col("times") > 0, F.sequence(F.lit(1), F.col("times").cast("int")))).alias("o3"),
        "role", "text")


ORDER = ["turn", "o1", "o2", "o3"]


def _letters(role: Column, stripped: Column, repeated: Column) -> Column:
    first = F.substring(role, 1, 1)
    fault = F.when(stripped == "", BLANK).when(repeated, REPEATED).when(~F.right(stripped, F.lit(1)).isin(".", "!", "?"), TRUNCATED)
    return F.concat(F.when(first.isin("s", "u", "a"), first).otherwise("x"), F.coalesce(fault, F.lit(FINE)))


AUDIT = "conv long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _groups(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple[int, Iterator[tuple]]]:
    """Each conversation of sorted rows, as a stream."""
    rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in columns)))
    row = next(rows, None)
    while row is not None:
        conv = row[0]

        def own() -> Iterator[tuple]:
            nonlocal row
            while row is not None and row[0] == conv:
                yield row
                row = next(rows, None)

        group = own()
        yield conv, group
        for _ in group:  # what the caller left
            pass


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, out = [c.split()[0] for c in AUDIT.split(", ")], []

    def flush() -> pa.RecordBatch:
        kinds = [pa.int64()] * 7 + [pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    for conv, rows in _groups(batches, ("conv", "turn", "letters")):
        low = high = None
        letters, turns = [], 0
        for _, turn, pair in rows:
            if turn is not None and turn != high:
                low, high, turns = turn if low is None else low, turn, turns + 1
            letters.append(pair)
        gaps = 0 if low is None else min(high - low + 1 - turns, LONG_MAX)
        roles = [p[0] for p in letters]
        illegal = sum(a + b not in LEGAL for a, b in zip(roles, roles[1:]))
        faults = [sum(p[1] == f for p in letters) for f in (BLANK, REPEATED, TRUNCATED)]
        out.append((conv, gaps, *faults, illegal, *repair("".join(letters))))
        if len(out) == 4096:
            yield flush()
            out = []
    if out:
        yield flush()


def audits(turns: DataFrame) -> DataFrame:
    """A row per conversation that has rows: faults, cost and audit."""
    rows = turns.withColumn("place", F.struct(F.col("turn").isNotNull().alias("known"), *ORDER)).withColumn(
        "key", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))
    # rows that say the same are grouped before they are shuffled; the first of them is no duplicate
    first = rows.groupBy("conv", "key").agg(F.min("place").alias("first"))
    lined = rows.select("conv", *ORDER, "place", "key", "role", F.rtrim("text", F.lit(BLANKS)).alias("stripped")).join(first, ["conv", "key"]).select(
        "conv", *ORDER, _letters(F.col("role"), F.col("stripped"), F.col("place") != F.col("first")).alias("letters"))
    return lined.repartition("conv").sortWithinPartitions("conv", *ORDER).select("conv", "turn", "letters").mapInArrow(_audits, AUDIT)


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a conversation after its audit -> conv, no, role, text: what is left, in order, with its number."""
    names, out, size = ("conv", "no", "role", "text"), [], 0

    def flush() -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    for conv, rows in _groups(batches, ("conv", "role", "text")):
        audit = next(rows)[2]
        kept = len(audit) - audit.count("D")
        no = 0
        for edit in audit:
            role, text = ("", "") if edit == "I" else next(rows)[1:]
            if edit == "D":
                continue
            if edit != "K":
                # the place counted from the end says what is due
                role = ("user", "assistant")[(kept - no) % 2]
            out.append((conv, no, role, text))
            size += len(text) + 32
            no += 1
            if size > 4 << 20:
                yield flush()
                out, size = [], 0
    if out:
        yield flush()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of ``_apply`` -> conv, repaired_sha256; a conversation of which nothing is left has no row."""
    last, digest, out = None, hashlib.sha256(), []
    for batch in batches:
        for conv, no, role, text in zip(*(c.to_pylist() for c in batch.columns)):
            if no == 0:
                if last is not None:
                    out.append((last, digest.hexdigest()))
                last, digest = conv, hashlib.sha256()
            digest.update((("\n" if no else "") + f"{role}:{text}").encode())
    if last is not None:
        out.append((last, digest.hexdigest()))
    conv, sha = zip(*out) if out else ((), ())
    yield pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array(sha, pa.string())], names=["conv", "repaired_sha256"])


def repaired(turns: DataFrame, found: DataFrame) -> DataFrame:
    """conv, no, role, text: the turns after their audits, numbered in order; each conversation lies in one partition, in order."""
    none = F.lit(None)
    heads = found.select("conv", F.lit(0).alias("part"), none.cast("long").alias("turn"), none.cast("string").alias("o1"),
                         none.cast("string").alias("o2"), none.cast("int").alias("o3"), F.lit("").alias("role"), F.col("audit").alias("text"))
    both = heads.unionByName(turns.select("conv", F.lit(1).alias("part"), *ORDER, "role", "text"))
    return both.repartition("conv").sortWithinPartitions("conv", "part", *ORDER).select("conv", "role", "text").mapInArrow(
        _apply, "conv long, no long, role string, text string")


def damaged(rows: DataFrame) -> DataFrame:
    """Rows of ``turns_of`` with one in twenty dropped, emptied, unpunctuated, repeated, or given to the user."""
    key = F.concat(*(x for c in ("conv_id", "turn") for x in (F.coalesce(F.col(c).cast("string"), F.lit(" ")), F.lit(":"))))
    kind = F.crc32(F.expr("substring(_key, 1, length(_key) - 1)")) % 20
    out = rows.withColumn("_key", key).withColumn("_kind", kind)
    return out.withColumns({
        "times": F.when(F.col("_kind") == 0, 0).when(F.col("_kind") == 3, 2 * F.col("times")).otherwise(F.col("times")),
        "text": F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")),
        "role": F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")),
    })


def repair_conversations(chats: DataFrame, change: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(a row of faults, cost and audit per conversation; its turns after repair)."""
    turns = stored(turns_of(chats, change))
    found = stored(audits(turns))
    return found, repaired(turns, found)


def op11_conversation_repair(spark, sf_dir: str) -> DataFrame:
    chats = table(spark, sf_dir, "conversations")
    found, turns = repair_conversations(chats, damaged)
    digests = turns.mapInArrow(_digests, "conv long, repaired_sha256 string")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    every = chats.select(row_id("conv_id").alias("conv")).distinct()
    return every.join(found, "conv", "left").join(digests, "conv", "left").select(
        user_id("conv").alias("conv_id"), *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


# ---------------------------------------------------------------------------
# SQL twin: the cheapest (cost, audit) for each state of the grammar, a row at a time
# ---------------------------------------------------------------------------

_NONE = "{'k': '900000000', 'o': ''}"


def _sql_edit(state: str, cost: str, letter: str, line: str | None = None) -> str:
    """A state (nine digits of cost and the audit; the repaired text) after one edit."""
    out = f"{state}.o" if line is None else f"{state}.o || CASE WHEN {state}.o = '' THEN '' ELSE chr(10) END || {line}"
    return (f"{{'k': lpad(CAST(CAST(left({state}.k, 9) AS BIGINT) + ({cost}) AS VARCHAR), 9, '0') || substr({state}.k, 10) || {letter}, "
            f"'o': {out}}}")


def _sql_least(*states: str) -> str:
    return f"list_sort([{', '.join(states)}])[1]"


def _sql_turn(state: str, due: str) -> str:
    """A state after a row that stays where ``due`` is due."""
    kept = f"i = '{due[0]}'"
    edit = _sql_edit(state, f"CASE WHEN {kept} THEN 0 ELSE {RESET} END + CASE WHEN fault = 't' THEN {CUT} ELSE 0 END",
                     f"CASE WHEN {kept} THEN 'K' ELSE 'R' END", f"CASE WHEN {kept} THEN role ELSE '{due}' END || ':' || text")
    return f"CASE WHEN fault IN ('b', 'd') THEN {_NONE} ELSE {edit} END"


_INSERTED = [_sql_edit(s, str(INSERT), "'I'", "'user:'") for s in "bsu"]
_CRC = "lambda c, b: list_reduce(range(8), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(c, b))"

OP11_SQL = f"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS r0, coalesce(text, ' ') AS t0,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
h AS (
  SELECT *, xor(list_reduce(list_transform(range(1, length(key) + 1), lambda j: CAST(ord(substr(key, CAST(j AS INTEGER), 1)) AS BIGINT)),
    {_CRC}, 4294967295), 4294967295) % 20 AS kind FROM k),
d AS (
  SELECT conv_id, turn, r0, md5(t0) AS m, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy,
    CASE WHEN kind = 4 THEN 'user' ELSE r0 END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(t0, '[.!?]', '', 'g') ELSE t0 END AS text FROM h),
o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r0, m, copy) AS n,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM d),
f AS MATERIALIZED (
  SELECT conv_id, turn, n, role, text, left(role, 1) AS i,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) || left(role, 1) AS pair,
    CASE WHEN bare = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'd'
      WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 't' ELSE 'n' END AS fault FROM o),
c AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
step AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS n, {{'k': '000000000', 'o': ''}} AS b, {_NONE} AS s, {_NONE} AS u, {_NONE} AS a FROM c
  UNION ALL
  SELECT conv_id, n, {_sql_edit('b', str(DELETE), "'D'")},
    {_sql_least(_sql_edit('s', str(DELETE), "'D'"), f"CASE WHEN i = 's' THEN {_sql_turn('b', 's')} ELSE {_NONE} END")},
    {_sql_least(_sql_edit('u1', str(DELETE), "'D'"), _sql_turn('a1', 'assistant'))},
    {_sql_least(_sql_edit('a1', str(DELETE), "'D'"), _sql_turn('e', 'user'))}
  FROM (SELECT *, {_sql_least('b', 's', 'u1')} AS e FROM (
    SELECT *, {_sql_least('u', _sql_edit('a1', str(INSERT), "'I'", "'assistant:'"))} AS u1 FROM (
      SELECT f.*, b, s, u, {_sql_least('a', *_INSERTED)} AS a1
      FROM step JOIN f ON f.conv_id IS NOT DISTINCT FROM step.conv_id AND f.n = step.n + 1)))),
last AS (
  SELECT c.*, {_sql_least('b', 'u', _sql_edit('a1', str(INSERT), "'I'", "'assistant:'"))} AS best
  FROM (SELECT *, {_sql_least('a', *_INSERTED)} AS a1 FROM step) z JOIN c ON c.conv_id IS NOT DISTINCT FROM z.conv_id AND c.n = z.n)
SELECT q.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(CAST(left(best.k, 9) AS BIGINT), 0) AS cost,
  coalesce(substr(best.k, 10), '') AS audit, sha256(coalesce(best.o, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) q LEFT JOIN last ON last.conv_id IS NOT DISTINCT FROM q.conv_id
"""
