"""Conversation structure repair: a generalised LR parse of roles with weighted edits.

The role grammar, an optional system turn and then pairs of a user and an assistant turn, is
compiled to LR tables.  A conversation's rows are the input; between and at the rows the parser
may also insert a turn, delete a row or give it another role, each at a price.  All parses go on
side by side as a graph-structured stack: a stack shares what lies below its top, and where two
stacks reach an equal top, the one with the smaller (cost, audit) stays.  That is exact: what may
follow depends on the top alone, and of two audits of one length of input neither is a prefix
of the other, so the order that they have now is the order that they will have.

Rows reach the parser as a stream sorted by conversation and turn, and each live stack carries
its repaired text as a running SHA-256, so memory follows a conversation's number of rows by a few
bytes each (the audit), never its texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import CRC_TABLE_SQL, SPACE_CHARS, crc32_sql, table

#: The grammar: what each production's left side stands for.
GRAMMAR = (("session", ""), ("session", "P"), ("session", "sP"), ("P", "ua"), ("P", "Pua"))
#: The initials that it knows; any other role has to be changed or deleted.
TERMINALS = frozenset("sua")
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: The roles that a row may be given, or a new row have, by their initials.
GIVEN = {"u": "user", "a": "assistant"}
#: No stack costs more to turn into another: undo a system row or wait for it (a delete), and at most
#: three inserts.  A stack that is dearer than the cheapest by more can't win.
SLACK = DELETE + 3 * INSERT
#: Damages, by the remainder of the row's checksum.
DAMAGES, DROP, EMPTY, UNSTOP, REPEAT, RECAST = 20, 0, 1, 2, 3, 4
#: Characters of an audit's open piece.
PIECE = 256

# ------------------------------------------------------------------ LR tables


def _closure(items: frozenset) -> frozenset:
    items, before = set(items), None
    while before != len(items):
        before = len(items)
        for rule, dot in list(items):
            after = GRAMMAR[rule][1][dot : dot + 1]
            items |= {(i, 0) for i, (left, _) in enumerate(GRAMMAR) if left == after}
    return frozenset(items)


@lru_cache(1)
def tables() -> tuple[list[dict[str, int]], list[list[int]]]:
    """For each state, the states that its symbols lead to, and the rules that it may reduce by."""
    first = _closure(frozenset((i, 0) for i, (left, _) in enumerate(GRAMMAR) if left == "session"))
    states, moves, reduces = [first], [], []
    for state in states:
        to = {}
        for symbol in sorted({GRAMMAR[rule][1][dot] for rule, dot in state if dot < len(GRAMMAR[rule][1])}):
            after = _closure(frozenset((rule, dot + 1) for rule, dot in state if GRAMMAR[rule][1][dot : dot + 1] == symbol))
            if after not in states:
                states.append(after)
            to[symbol] = states.index(after)
        moves.append(to)
        reduces.append(sorted(rule for rule, dot in state if dot == len(GRAMMAR[rule][1])))
    return moves, reduces


#: A stack is its top state and the stack below, or None; equal lower parts are shared.
Stack = tuple
START: Stack = (0, None)


@lru_cache(None)
def shifted(stack: Stack, symbol: str) -> Stack | None:
    """The stack after the symbol, reduced as long as only that lets it go on; None if it can't."""
    moves, reduces = tables()
    if symbol in moves[stack[0]]:
        return (moves[stack[0]][symbol], stack)
    for rule in reduces[stack[0]]:
        left, right = GRAMMAR[rule]
        if left == "session":
            continue
        below = stack
        for _ in right:
            below = below[1]
        onward = shifted((moves[below[0]][left], below), symbol)
        if onward is not None:
            return onward
    return None


@lru_cache(None)
def accepts(stack: Stack) -> bool:
    """Whether the input may end here."""
    moves, reduces = tables()
    for rule in reduces[stack[0]]:
        left, right = GRAMMAR[rule]
        if left == "session":
            return True
        below = stack
        for _ in right:
            below = below[1]
        if accepts((moves[below[0]][left], below)):
            return True
    return False


@lru_cache(None)
def _inserted(stack: Stack) -> tuple[tuple[Stack, str], ...]:
    """(stack, inserted initials) of the stacks that inserts alone lead to, the fewest to each top; itself first."""
    found, last = {stack[0]: (stack, "")}, [(stack, "")]
    while last:
        last = [(after, made + i) for now, made in last for i in GIVEN if (after := shifted(now, i)) is not None and after[0] not in found]
        found |= {s[0]: (s, made) for s, made in last}
    return tuple(found.values())


@lru_cache(None)
def steps(stack: Stack, initial: str, must_go: bool, truncated: bool) -> tuple[tuple[Stack, int, str, str, str], ...]:
    """What may be done with a row on this stack: (stack after, cost, audit, roles inserted before, role given:
    an initial, "" to keep the row's own, or "-" for none), for each top the least (cost, audit)."""
    best = {}
    for now, made in _inserted(stack):
        ahead, cost = "I" * len(made), INSERT * len(made)
        ways = [(now, cost + DELETE, ahead + "D", made, "-")]
        if not must_go:
            more = TRUNCATED if truncated else 0
            if initial in TERMINALS and (after := shifted(now, initial)) is not None:
                ways.append((after, cost + more, ahead + "K", made, ""))
            ways += [(after, cost + REROLE + more, ahead + "R", made, i) for i in GIVEN if (after := shifted(now, i)) is not None]
        for way in ways:
            top = way[0][0]
            if top not in best or way[1:3] < best[top][1:3]:
                best[top] = way
    return tuple(best.values())


class _Live:
    """A live stack of a conversation: what it cost, its place among the audits, its audit and its repaired text."""

    __slots__ = ("audit", "cost", "first", "rank", "repaired", "stack", "tail")

    def __init__(self, stack: Stack, cost: int, audit: tuple | None, tail: str, repaired, first: bool):
        self.stack, self.cost, self.audit, self.tail, self.repaired, self.first, self.rank = stack, cost, audit, tail, repaired, first, 0

    def grown(self, stack: Stack, cost: int, made: str) -> _Live:
        audit, tail = self.audit, self.tail + made
        if len(tail) >= PIECE:
            audit, tail = (audit, tail), ""
        return _Live(stack, self.cost + cost, audit, tail, self.repaired.copy(), self.first)

    def say(self, role: str, text: str) -> None:
        self.repaired.update((f"{role}:{text}" if self.first else f"\n{role}:{text}").encode("utf-8", "surrogatepass"))
        self.first = False

    def whole_audit(self) -> str:
        pieces, at = [self.tail], self.audit
        while at is not None:
            pieces.append(at[1])
            at = at[0]
        return "".join(reversed(pieces))


class Repair:
    """The parse of one conversation, row by row."""

    def __init__(self):
        self.live = [_Live(START, 0, None, "", hashlib.sha256(), True)]

    def row(self, role: str, text: str, must_go: bool, truncated: bool) -> None:
        best = {}
        for at in self.live:
            for step in steps(at.stack, role[:1], must_go, truncated):
                key, top = (at.cost + step[1], at.rank, step[2]), step[0][0]
                if top not in best or key < best[top][0]:
                    best[top] = (key, at, step)
        limit = min(key[0] for key, _, _ in best.values()) + SLACK
        after = []
        for key, at, (stack, cost, made, inserted, given) in sorted(best.values(), key=lambda x: x[0][1:]):
            if key[0] > limit:
                continue
            new = at.grown(stack, cost, made)
            for i in inserted:
                new.say(GIVEN[i], "")
            if given != "-":
                new.say(GIVEN.get(given, role), text)
            new.rank = len(after)
            after.append(new)
        self.live = after

    def end(self) -> tuple[int, str, str]:
        """cost, audit, SHA-256 of the cheapest repair."""
        ends = [(at.cost + INSERT * len(made), at.rank, made, at, stack) for at in self.live for stack, made in _inserted(at.stack) if accepts(stack)]
        _, _, made, at, stack = min(ends, key=lambda x: x[:3])
        last = at.grown(stack, INSERT * len(made), "I" * len(made))
        for i in made:
            last.say(GIVEN[i], "")
        return last.cost, last.whole_audit(), last.repaired.hexdigest()


# ------------------------------------------------------------------ rows

COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_LEGAL = {"su", "ua", "au"}


class _Conversation:
    """Counts of one conversation's rows, fed in order."""

    def __init__(self, conv_id):
        self.conv_id, self.n = conv_id, dict.fromkeys(COUNTS, 0)
        self.repair, self.turns, self.first_turn, self.turn, self.role = Repair(), 0, None, None, None

    def add(self, turn, role: str, text: str, seen: bool) -> None:
        if turn is not None and turn != self.turn:
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.turn, self.turns = turn, self.turns + 1
        if self.role is not None and self.role[:1] + role[:1] not in _LEGAL:
            self.n["illegal"] += 1
        self.role = role
        said = text.rstrip(SPACE_CHARS)
        fault = "blank" if not said else "duplicate" if seen else "truncated" if said[-1] not in ".!?" else None
        if fault:
            self.n[fault] += 1
        self.repair.row(role, text, fault in ("blank", "duplicate"), fault == "truncated")

    def result(self) -> tuple:
        self.n["gaps"] = self.turn - self.first_turn + 1 - self.turns if self.turns else 0
        self.n["cost"], audit, digest = self.repair.end()
        return (self.conv_id, *self.n.values(), audit, digest)


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, dropped: the rows as the contract damages them.  A dropped row stays, marked,
    so that its conversation does."""
    space = F.lit(" ")
    conv, turn, role, text = (F.col(c) for c in ("conv_id", "turn", "role", "text"))
    key = F.concat_ws(":", F.coalesce(conv.cast("string"), space), F.coalesce(turn.cast("string"), space))
    rows = conversations.select(conv, turn, F.coalesce(role, space).alias("role"), F.coalesce(text, space).alias("text"), (F.crc32(key.cast("binary")) % DAMAGES).alias("damage"))
    damage = F.col("damage")
    copies = F.explode(F.when(damage == REPEAT, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select(
        "conv_id", "turn", F.when(damage == RECAST, "user").otherwise(role).alias("role"),
        F.when(damage == EMPTY, "").when(damage == UNSTOP, F.translate("text", ".!?", "")).otherwise(text).alias("text"),
        (damage == DROP).alias("dropped"), copies.alias("copy"),
    ).drop("copy")


def repaired(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 for every conv_id of
    (conv_id, turn, role, text, dropped).

    Rows are taken by turn, nulls first, equal turns by role, then text; a null role or text is one space, a
    null conv_id a conversation of its own.  A blank row is deleted whatever it costs, and so is one whose role and
    text came before; a conversation without rows that aren't dropped has zeros, an empty audit and the empty
    string's hash; an empty table gives no rows.  Very long texts pass once.  Other columns are ignored.

    One shuffle, by conversation; whether a row came before follows from a window inside that partitioning.
    A conversation is one stream in any case, for its hash has an order.
    """
    space = F.lit(" ")
    rows = rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), "dropped")
    placed = rows.repartition("conv_id")
    same = W.partitionBy("conv_id", "role", "text", "dropped").orderBy(F.col("turn").asc_nulls_first())
    placed = placed.withColumn("nth", F.row_number().over(same))
    placed = placed.sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text", "nth")
    kinds = [("conv_id", rows.schema["conv_id"].dataType), *((c, T.LongType()) for c in COUNTS), ("audit", T.StringType()), ("repaired_sha256", T.StringType())]
    schema = T.StructType([T.StructField(*k) for k in kinds])
    arrow = to_arrow_schema(schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, []
        for batch in batches:
            for conv_id, turn, role, text, dropped, nth in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        out.append(now.result())
                    now = _Conversation(conv_id)
                if not dropped:
                    now.add(turn, role, text, nth > 1)
            if len(out) > 1000:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema=arrow)
                out = []
        if now is not None:
            out.append(now.result())
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema=arrow)

    return placed.mapInArrow(work, schema)


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's damage and repair over the whole conversations table."""
    return repaired(damaged(table(spark, sf_dir, "conversations")))


# ------------------------------------------------------------------ SQL


#: A plain shortest-path statement: states are the last role's initial (z: none yet), an edit is any inserts and one action.
OP11_SQL = f"""WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
d AS (SELECT k.*, {crc32_sql("key")} % 20 AS damage FROM k, {CRC_TABLE_SQL}),
w AS (SELECT conv_id, turn, CASE damage WHEN 4 THEN 'user' ELSE role END AS role, CASE damage WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE damage WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM d WHERE damage <> 0),
q AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS nth, regexp_replace(text, '[\\x20\\x09-\\x0D]+$', '') AS said FROM w),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, nth) AS n FROM q),
f AS (SELECT *, CASE WHEN said = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN NOT regexp_matches(said, '[.!?]$') THEN 'truncated' ELSE '' END AS fault, lag(role) OVER (PARTITION BY conv_id ORDER BY n) AS before FROM o),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (before IS NOT NULL AND left(before, 1) || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal, max(n) AS size FROM f GROUP BY 1),
ins AS (SELECT * FROM (VALUES ('z','z',''), ('z','u','u'), ('z','a','ua'), ('s','s',''), ('s','u','u'), ('s','a','ua'), ('u','u',''), ('u','a','a'), ('u','u','au'), ('a','a',''), ('a','u','u'), ('a','a','ua')) AS t(was, mid, made)),
act AS (SELECT * FROM (VALUES ('z','s','s','K'), ('z','u','u','K'), ('s','u','u','K'), ('u','a','a','K'), ('a','u','u','K'), ('z','u','u','R'), ('s','u','u','R'), ('u','a','a','R'), ('a','u','u','R'), ('z','','z','D'), ('s','','s','D'), ('u','','u','D'), ('a','','a','D')) AS t(mid, said_as, now, kind)),
e AS (SELECT was, now, kind, said_as, repeat('I', length(made)) || kind AS audit, 3 * length(made) + CASE kind WHEN 'R' THEN 3 WHEN 'D' THEN 4 ELSE 0 END AS price,
  array_to_string(list_transform(string_split(made, ''), lambda x: CASE x WHEN 'u' THEN 'user:' WHEN 'a' THEN 'assistant:' END), chr(10)) AS ahead FROM ins JOIN act USING (mid)),
r AS (SELECT conv_id, CAST(0 AS BIGINT) AS n, 'z' AS state, CAST(0 AS BIGINT) AS cost, '' AS audit, '' AS body FROM c
  UNION ALL SELECT conv_id, n, state, cost, audit, body FROM (
    SELECT r.conv_id, r.n + 1 AS n, e.now AS state, r.cost + e.price + CASE WHEN kind <> 'D' AND fault = 'truncated' THEN 3 ELSE 0 END AS cost, r.audit || e.audit AS audit,
      r.body || CASE WHEN ahead <> '' THEN chr(10) || ahead ELSE '' END || CASE kind WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || role || ':' || text ELSE chr(10) || CASE said_as WHEN 'u' THEN 'user' ELSE 'assistant' END || ':' || text END AS body,
      row_number() OVER (PARTITION BY r.conv_id, e.now ORDER BY r.cost + e.price + CASE WHEN kind <> 'D' AND fault = 'truncated' THEN 3 ELSE 0 END, r.audit || e.audit) AS best
    FROM r JOIN f ON f.conv_id IS NOT DISTINCT FROM r.conv_id AND f.n = r.n + 1 JOIN e ON e.was = r.state AND (kind = 'D' OR fault NOT IN ('blank', 'duplicate')) AND (kind <> 'K' OR left(role, 1) = said_as)) WHERE best = 1),
l AS (SELECT r.conv_id, r.cost + 3 * length(made) AS cost, r.audit || repeat('I', length(made)) AS audit, r.body || CASE made WHEN 'a' THEN chr(10) || 'assistant:' WHEN 'ua' THEN chr(10) || 'user:' || chr(10) || 'assistant:' ELSE '' END AS body
  FROM r JOIN c ON c.conv_id IS NOT DISTINCT FROM r.conv_id AND size = r.n JOIN ins ON was = state AND (mid = 'a' OR mid = 'z' AND made = '')),
p AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY cost, audit) = 1)
SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit,
  sha256(coalesce(substr(body, 2), '')) AS repaired_sha256 FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN p ON p.conv_id IS NOT DISTINCT FROM i.conv_id"""
