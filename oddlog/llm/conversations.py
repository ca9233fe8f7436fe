"""Repair of conversations: the cheapest edits after which roles read ``(s?(ua)+)?``, by Knuth's lightest derivations.

A message is kept (K, 0), gets the role user or assistant (R, 1), is deleted (D, 2) or has an empty message inserted
before it (I, 5). Blank messages and repeats of an earlier role and text must go; truncated ones that stay add 5. Of equal
costs the edits whose initials sort first win.

What a repair depends on is one letter a message, so a conversation is a short string of letters, and equal strings are
solved once. Messages are sorted by range: letters are put together per task of the sort, then per conversation, so a
conversation that holds a large part of all rows is spread over many tasks until only its letters are left. Texts meet
again in the last step, which passes through the sorted messages of a conversation, as its running SHA-256 must, with one
batch and the edits in memory.

Null roles and texts are a space. Rows without a conversation are one conversation of their own. Rows of equal turns are
ordered by role and text, null turns come first; repeated rows are duplicates. A role that does not begin with s, u or a
cannot be kept. Conversations without messages have none in the result. An empty table gives empty results. Other columns
are ignored, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from oddlog.session import join_side

from .common import crc32_sql, group_key, stage, text_batches

SPACES = " \t\n\x0b\x0c\r"
PREFIX = 64  # characters of a text by which equal turns and roles are dealt out
BLOCK = 256  # letters derived at once

# Letters of messages: initial s, u, a or another one; sound, truncated, or to be deleted.
SOUND, TRUNCATED, DOOMED = "suao", "SUAO", "wxyz"
START, S, U, A = range(4)  # what has been read: nothing, s, then u and a in turn
MOVES = {(START, "s"): S, (START, "u"): U, (S, "u"): U, (U, "a"): A, (A, "u"): U}
RENAME, DELETE, INSERT, CUT = 1, 2, 5, 5

Value = tuple[int, str]  # cost, initials of the edits


def lightest(axioms: dict[tuple, Value], conclusions: Callable[[tuple, dict], Iterable], goal: tuple | None) -> dict:
    """The least value of every item, popped from an agenda in the order of values, up to ``goal`` if there is one.

    ``conclusions(item, done)`` yields what follows from ``item`` and the items in ``done``. A conclusion is worth no less
    than each of its premises, and no more if a premise gets cheaper, so an item's first value is its least (Knuth 1977).
    """
    agenda = [(value, item) for item, value in axioms.items()]
    heapq.heapify(agenda)
    done: dict[tuple, Value] = {}
    while agenda and goal not in done:
        value, item = heapq.heappop(agenda)
        if item not in done:
            done[item] = value
            for conclusion, worth in conclusions(item, done):
                if conclusion not in done:
                    heapq.heappush(agenda, (worth, conclusion))
    return done


def rules(letters: str, closed: bool) -> tuple[dict[tuple, Value], Callable]:
    """Axioms and deductions over ``letters``.

    Items are ``("at", i, state)``: the first i messages are repaired so that state is reached; ``("kept", i)`` and
    ``("gone", i)``: message i stays or goes, worth its own cost and no edits. From ``at`` and one of these follows the
    next ``at``; from ``at`` alone an insertion and, if ``closed``, the goal. Both premises precede the conclusion: costs
    add up, and the edits of ``at`` are the beginning of the conclusion's.
    """
    axioms: dict[tuple, Value] = {("gone", i): (DELETE, "") for i in range(len(letters))}
    axioms |= {("kept", i): (CUT * (x in TRUNCATED), "") for i, x in enumerate(letters) if x not in DOOMED}

    def combined(i: int, state: int, what: str, done: dict) -> Iterator:
        (cost, edits), (own, _) = done["at", i, state], done[what, i]
        if what == "gone":
            yield ("at", i + 1, state), (cost + own, edits + "D")
            return
        for (before, initial), after in MOVES.items():
            if before == state:
                if letters[i].lower() == initial:
                    yield ("at", i + 1, after), (cost + own, edits + "K")
                if initial != "s":
                    yield ("at", i + 1, after), (cost + own + RENAME, edits + "R")

    def conclusions(item: tuple, done: dict) -> Iterator:
        what, i = item[:2]
        if what == "at":
            state, (cost, edits) = item[2], done[item]
            for other in ("kept", "gone"):
                if (other, i) in done:
                    yield from combined(i, state, other, done)
            for (before, initial), after in MOVES.items():
                if before == state and initial != "s":
                    yield ("at", i, after), (cost + INSERT, edits + "I")
            if closed and i == len(letters) and state in (START, A):
                yield ("goal", i), (cost, edits)
        elif what != "goal":
            for state in range(4):
                if ("at", i, state) in done:
                    yield from combined(i, state, what, done)

    return axioms, conclusions


@lru_cache(maxsize=4096)
def across(letters: str, state: int) -> dict[int, Value]:
    """The least value of every state after a block of ``letters`` that is entered in ``state``."""
    axioms, conclusions = rules(letters, False)
    done = lightest(axioms | {("at", 0, state): (0, "")}, conclusions, None)
    return {after: done["at", len(letters), after] for after in range(4) if ("at", len(letters), after) in done}


def solve(letters: str) -> Value:
    """Cost and initials of the cheapest repair.

    Long conversations are derived block by block: two repairs of the same messages that reach the same state at the same
    cost differ before either ends, so the better beginning stays the better one whatever follows.
    """
    if len(letters) <= BLOCK:
        axioms, conclusions = rules(letters, True)
        goal = ("goal", len(letters))
        return lightest(axioms | {("at", 0, START): (0, "")}, conclusions, goal)[goal]
    reached: dict[int, Value] = {START: (0, "")}
    for start in range(0, len(letters), BLOCK):
        after: dict[int, Value] = {}
        for state, (cost, edits) in reached.items():
            for target, (more, own) in across(letters[start : start + BLOCK], state).items():
                value = (cost + more, edits + own)
                after[target] = min(after.get(target, value), value)
        reached = after
    return min(reached[state] for state in (START, A) if state in reached)


@F.arrow_udf(StructType([StructField("cost", LongType()), StructField("audit", StringType())]))
def solved(letters: pa.Array) -> pa.Array:
    values = [solve(x) for x in letters.to_pylist()]
    kinds = [pa.field("cost", pa.int64()), pa.field("audit", pa.string())]
    return pa.StructArray.from_arrays([pa.array([v[k] for v in values], kinds[k].type) for k in (0, 1)], fields=kinds)


class Repair(NamedTuple):
    """``conversations``: (key, conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of each with messages.

    ``messages``: (key, conv_id, step, edit, role, text, digest) of every edit; ``text`` and ``role`` of a deleted message
    are its own, ``digest`` is the SHA-256 of the repaired conversation up to here, ``role:text`` joined by newlines.
    """

    conversations: DataFrame
    messages: DataFrame


def letter(initial: Column, doomed: Column, truncated: Column) -> Column:
    at = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    cut = F.upper(at)
    return F.when(doomed, F.translate(at, SOUND, DOOMED)).when(truncated, cut).otherwise(at)


def ordered(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """The messages in their order, which is that of ``at``, stored."""
    role, text = F.coalesce(F.col(role_col), F.lit(" ")), F.coalesce(F.col(text_col), F.lit(" "))
    trimmed = F.rtrim(text, F.lit(SPACES))
    plain = rows.select(
        group_key(F.col(conv_col)).alias("key"),
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        role.alias("role"),
        text.alias("text"),
        (trimmed == "").alias("blank"),
        (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("truncated"),
        F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("content"),
        F.substring(text, 1, PREFIX).alias("prefix"),
    )
    placed = plain.repartitionByRange("key", "turn", "role", "prefix").sortWithinPartitions("key", "turn", "role", "text")
    return stage(placed.drop("prefix").withColumn("at", F.monotonically_increasing_id()), "messages")


def described(messages: DataFrame) -> DataFrame:
    """A row per conversation: its faults and its letters."""
    narrow = messages.select("key", "conv_id", "at", "turn", F.left("role", F.lit(1)).alias("initial"), "blank", "truncated", "content")
    twice = narrow.groupBy("key", "content").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1")
    marked = narrow.join(join_side(twice.drop("n"), "repeated"), ["key", "content"], "left")
    again = (~F.col("blank")) & F.coalesce(F.col("at") > F.col("first"), F.lit(False))
    cut = (~F.col("blank")) & ~again & F.col("truncated")
    marked = marked.withColumns({"again": again, "cut": cut, "letter": letter(F.col("initial"), F.col("blank") | again, cut)})
    in_order = F.array_sort(F.collect_list(F.struct("at", "letter")))
    parts = marked.groupBy("key", F.shiftright("at", 33).alias("part")).agg(
        F.first("conv_id").alias("conv_id"),
        F.array_join(F.transform(in_order, lambda x: x["letter"]), "").alias("letters"),
        F.size(F.array_distinct(F.collect_list("turn"))).alias("turns"),
        F.min("turn").alias("low"),
        F.max("turn").alias("high"),
        *(F.sum(F.col(c).cast("long")).alias(c) for c in ("blank", "again", "cut")),
    )
    piece = F.struct("part", "letters", "low", "high")
    whole = parts.groupBy("key").agg(
        F.first("conv_id").alias("conv_id"),
        F.array_sort(F.collect_list(piece)).alias("pieces"),
        F.sum("turns").alias("turns"),
        *(F.sum(c).alias(c) for c in ("blank", "again", "cut")),
    )
    # A turn at the end of one part and the beginning of the next was counted in both.
    dated = F.filter("pieces", lambda p: p["low"].isNotNull())
    whole = whole.withColumns({"dated": dated, "letters": F.array_join(F.transform("pieces", lambda p: p["letters"]), "")})
    follows = F.zip_with(dated, F.slice(dated, F.lit(2), F.greatest(F.size(dated), F.lit(1))), lambda a, b: a["high"] == b["low"])
    shared = F.size(F.filter(follows, lambda same: F.coalesce(same, F.lit(False))))
    span = F.array_max(F.transform("dated", lambda p: p["high"])) - F.array_min(F.transform("dated", lambda p: p["low"])) + 1
    initials = F.translate("letters", TRUNCATED + DOOMED, SOUND * 2)
    return whole.select(
        "key",
        "conv_id",
        F.coalesce(span - (F.col("turns") - shared), F.lit(0)).cast("long").alias("gaps"),
        "blank",
        F.col("again").alias("duplicate"),
        F.col("cut").alias("truncated"),
        (F.length("letters") - 1 - F.regexp_count(initials, F.lit("(?=su|ua|au)"))).cast("long").alias("illegal"),
        F.translate("letters", DOOMED, DOOMED[0] * 4).alias("letters"),
    )


class Editor:
    """The edits of one conversation, applied to its messages as they come."""

    def __init__(self, audit: str):
        self.audit, self.step, self.emitted, self.leading = audit, 0, 0, 0
        self.so_far = hashlib.sha256()

    def out(self, edit: str, role: str | None, text: str) -> tuple:
        if edit != "D":
            if role is None:
                role = "assistant" if (self.emitted - self.leading) % 2 else "user"
            elif not self.emitted and role[:1] == "s":
                self.leading = 1
            self.so_far.update(("\n" * bool(self.emitted) + f"{role}:{text}").encode())
            self.emitted += 1
        self.step += 1
        return self.step, edit, role, text, self.so_far.hexdigest()

    def inserted(self) -> Iterator[tuple]:
        while self.audit[self.step : self.step + 1] == "I":
            yield self.out("I", None, "")

    def message(self, role: str, text: str) -> Iterator[tuple]:
        yield from self.inserted()
        edit = self.audit[self.step]
        yield self.out(edit, None if edit == "R" else role, text)


def edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits in order; each conversation's audit (``at`` -1) comes before its messages."""
    editor, own = None, ()
    kind = None

    def table(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), kind, pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
        names = ["key", "conv_id", "step", "edit", "role", "text", "digest"]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    for rows in batches:
        kind = rows.schema.field("conv_id").type
        found: list[tuple] = []
        for key, conv, at, role, text in zip(*(column.to_pylist() for column in rows.columns)):
            if at < 0:
                found += [own + row for row in editor.inserted()] if editor else []
                editor, own = Editor(text), (key, conv)
            else:
                found += [own + row for row in editor.message(role, text)]
        yield table(found)
    if editor:
        yield table([own + row for row in editor.inserted()])


def repair(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> Repair:
    """The faults, cheapest edits and repaired messages of all conversations."""
    text_batches(rows.sparkSession)
    messages = ordered(rows, conv_col, turn_col, role_col, text_col)
    found = stage(described(messages), "conversations")
    answers = found.select("letters").distinct().select("letters", solved("letters").alias("best"))
    whole = found.join(join_side(answers, "repairs"), "letters").select(*found.columns, "best.*").drop("letters")
    whole = stage(whole, "repaired")
    audits = whole.select("key", "conv_id", F.lit(-1).cast("long").alias("at"), F.lit(None).cast("string").alias("role"), F.col("audit").alias("text"))
    both = audits.union(messages.select("key", "conv_id", "at", "role", "text"))
    names = ("edit", "role", "text", "digest")
    schema = StructType([StructField("key", StringType()), messages.schema["conv_id"], StructField("step", LongType()), *(StructField(n, StringType()) for n in names)])
    streamed = both.repartition("key").sortWithinPartitions("key", "at").mapInArrow(edited, schema)
    return Repair(whole, streamed)


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) with the faults that op11 asks for, by the checksum of conversation and turn."""
    known = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    fault = F.crc32(F.concat(known["conv_id"], F.lit(":"), known["turn"]).cast("binary")) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.translate(known["text"], ".!?", "")).otherwise(known["text"])
    role = F.when(fault == 4, "user").otherwise(known["role"])
    copies = F.when(fault == 3, 2).otherwise(1)
    kept = rows.where(fault != 0)
    return kept.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), copies)).alias("copy")).drop("copy")


# The same as SQL over ``conversations``: a table of best beginnings, grown message by message.
SQL = f"""WITH RECURSIVE faults AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc32_sql("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS fault FROM conversations),
damaged AS (SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
    CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(CASE fault WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM faults WHERE fault <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) - 1 AS i,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS trimmed FROM damaged),
marked AS (SELECT *, left(role, 1) AS initial, trimmed = '' AS blank,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS earlier FROM placed),
messages AS (SELECT *, coalesce('=' || conv_id, '') AS key, NOT blank AND again AS duplicate,
    NOT blank AND NOT again AND right(trimmed, 1) NOT IN ('.', '!', '?') AS truncated FROM marked),
moves(state, initial, after) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
added(state, after, n, edits, lines) AS (VALUES (0, 0, 0, '', ''), (0, 2, 1, 'I', 'user:' || chr(10)),
    (0, 3, 2, 'II', 'user:' || chr(10) || 'assistant:' || chr(10)), (1, 1, 0, '', ''), (1, 2, 1, 'I', 'user:' || chr(10)),
    (1, 3, 2, 'II', 'user:' || chr(10) || 'assistant:' || chr(10)), (2, 2, 0, '', ''), (2, 3, 1, 'I', 'assistant:' || chr(10)),
    (3, 3, 0, '', ''), (3, 2, 1, 'I', 'user:' || chr(10))),
edits AS (SELECT key, i, state, after, 0 + 5 * truncated::INT AS cost, 'K' AS edit, role || ':' || text || chr(10) AS line
    FROM messages JOIN moves USING (initial) WHERE NOT blank AND NOT duplicate
    UNION ALL SELECT key, i, state, after, 1 + 5 * truncated::INT, 'R',
    CASE moves.initial WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text || chr(10)
    FROM messages, moves WHERE moves.initial <> 's' AND NOT blank AND NOT duplicate
    UNION ALL SELECT key, i, state, state, 2, 'D', '' FROM messages, range(4) states(state)),
walk AS (SELECT DISTINCT key, 0::BIGINT AS i, 0::BIGINT AS state, {{'cost': 0::BIGINT, 'audit': ''}} AS best, '' AS lines FROM messages
    UNION ALL SELECT key, i + 1, after, min(value), arg_min(lines, value) FROM (
    SELECT w.key, w.i, e.after::BIGINT AS after, w.lines || a.lines || e.line AS lines,
    {{'cost': w.best.cost + 5 * a.n + e.cost, 'audit': w.best.audit || a.edits || e.edit}} AS value
    FROM walk w JOIN added a ON a.state = w.state JOIN edits e ON e.key = w.key AND e.i = w.i AND e.state = a.after)
    GROUP BY key, i, after),
finals AS (SELECT key, min(value) AS best, arg_min(lines, value) AS lines FROM (
    SELECT w.key, w.lines || a.lines AS lines, {{'cost': w.best.cost + 5 * a.n, 'audit': w.best.audit || a.edits}} AS value
    FROM walk w JOIN added a ON a.state = w.state
    JOIN (SELECT key, max(i) + 1 AS n FROM messages GROUP BY key) s ON s.key = w.key AND s.n = w.i
    WHERE a.after IN (0, 3)) GROUP BY key),
counted AS (SELECT key, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
    count(*) FILTER (earlier || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM messages GROUP BY key)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
    coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0) AS cost,
    coalesce(best.audit, '') AS audit, sha256(coalesce(left(lines, length(lines) - 1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN counted n ON n.key = coalesce('=' || c.conv_id, '')
    LEFT JOIN finals f ON f.key = n.key"""
