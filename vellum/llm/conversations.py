"""Repair of conversation structure by a cost-to-go programme over turns and grammar.

A conversation's rows, by turn (null turns first), have faults: blank texts, rows whose
role and text came earlier, texts that end without a mark.  Edits turn the roles into
`(s?(ua)+)?`: keep a row (0), give it the role the grammar wants (1), delete it (2;
blank and repeated rows always), put an empty-text turn anywhere (5); a truncated row
that stays costs 5 more.  A backward pass computes the least cost from each row and
grammar state to the end, and with it the ASCII-least edit among those whose costs are
tight; the forward walk follows these edits.  The walk rebuilds the turns for hashing.

Plan.  Equal rows are counted before anything moves.  Rows travel without their texts,
as digests, to find repeats (a minimum of turns, joined back) and to run the programme:
one byte for each row and state of one conversation is held at a time, of the order of the
audit string that is its result.  Texts are reduced to one for each different row, and
stream through the hash in order, so no conversation's texts are ever held together.
A conversation's audit is one value and its digest is a chain, so each conversation ends
in one task; a conversation with a third of all rows makes that task long but not large.

Null roles and texts are one space, so a null text is blank.  An
empty role has no initial and fits nowhere in the grammar.  Null turns come first and
are in no gap; turns that are no integers count as null.  A null conversation id is a
conversation.  Rows of one turn are ordered by role, then by the text's SHA-256.
Conversations without rows left give zeros, an empty audit and the digest of the empty
string.  An empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import small_batches

#: Grammar states: nothing yet, after a system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
#: What a row's initial leads to from each state (None: the grammar has no such turn there).
STEP = {"s": (SYSTEM, None, None, None), "u": (USER, USER, None, USER), "a": (None, None, ASSISTANT, None)}
#: Where an inserted or re-roled turn leads, and its role.
WANTED = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
FAR = 1 << 60
#: Kinds of rows.
GOOD, CUT, BLANK, REPEATED = range(4)

OUT = ("blank", "duplicate", "truncated", "illegal", "gaps", "cost")


def _closed(base: list[int]) -> list[int]:
    """Costs to go once turns may be inserted first; more than two in a row never pay."""
    user = min(base[USER], INSERT + base[ASSISTANT])
    return [min(base[START], INSERT + user), min(base[SYSTEM], INSERT + user), user, min(base[ASSISTANT], INSERT + base[USER])]


def plan(rows: list[tuple[str, int, int]]) -> tuple[int, str, str]:
    """(cost, audit, steps) for rows of (initial, kind, further copies).

    steps has a letter for each row that is neither blank nor repeated, K kept, D
    deleted, u or a re-roled, and U or A for each turn put in before it.
    """
    n = len(rows)
    to_go = _closed([0, FAR, FAR, 0])
    choice = bytearray(4 * (n + 1))
    for s in range(4):
        choice[4 * n + s] = ord("." if s in (START, ASSISTANT) else "I")
    for i in range(n - 1, -1, -1):
        initial, kind, copies = rows[i]
        then = [v + DELETE * copies for v in to_go]
        base, kept = [v + DELETE for v in then], [FAR] * 4
        if kind in (GOOD, CUT):
            extra, step = TRUNCATED * (kind == CUT), STEP.get(initial, (None,) * 4)
            for s in range(4):
                if step[s] is not None:
                    kept[s] = extra + KEEP + then[step[s]]
                base[s] = min(base[s], kept[s], extra + REROLE + then[WANTED[s]])
        to_go = _closed(base)
        for s in range(4):
            v = to_go[s]
            choice[4 * i + s] = ord("D" if v == DELETE + then[s] else "I" if v == INSERT + to_go[WANTED[s]] else "K" if v == kept[s] else "R")
    audit, steps, i, s = [], [], 0, START
    while (c := chr(choice[4 * i + s])) != ".":
        audit.append(c)
        if c == "I":
            s = WANTED[s]
            steps.append("U" if s == USER else "A")
            continue
        initial, kind, copies = rows[i]
        if kind in (GOOD, CUT):
            if c == "R":
                s = WANTED[s]
                steps.append("u" if s == USER else "a")
            else:
                steps.append(c)
                s = STEP[initial][s] if c == "K" else s
        audit.append("D" * copies)
        i += 1
    return to_go[START], "".join(audit), "".join(steps)


class _Conversation:
    """Counts and rows of the conversation at hand."""

    def __init__(self, name):
        self.name, self.rows = name, []
        self.blank = self.repeated = self.cut = self.illegal = self.turns = 0
        self.first = self.last = self.before = None

    def add(self, turn: int | None, initial: str, kind: int, copies: int) -> None:
        if not copies:
            return
        if turn is not None and turn != self.last:
            self.turns, self.last = self.turns + 1, turn
            self.first = turn if self.first is None else self.first
        self.illegal += (self.before is not None and self.before + initial not in ("su", "ua", "au")) + copies - 1
        self.before = initial
        self.blank += copies if kind == BLANK else 0
        self.repeated += copies if kind == REPEATED else copies - 1 if kind in (GOOD, CUT) else 0
        self.cut += kind == CUT
        self.rows.append((initial, kind, copies - 1))

    def result(self) -> tuple:
        cost, audit, steps = plan(self.rows)
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return self.name, self.blank, self.repeated, self.cut, self.illegal, gaps, cost, audit, steps


def _plans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each conversation from rows sorted by conversation and place."""
    at, kind, out = None, None, []

    def flush() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True))
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(cols[0], kind), *(pa.array(c, pa.int64()) for c in cols[1:7]), pa.array(cols[7]), pa.array(cols[8])], names=["conv_id", *OUT, "audit", "steps"])

    for batch in batches:
        kind = batch.schema[0].type
        for name, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if at is None or at.name != name:
                if at is not None:
                    out.append(at.result())
                at = _Conversation(name)
            at.add(*row)
        if len(out) >= 512:
            yield flush()
    if at is not None:
        out.append(at.result())
    if out:
        yield flush()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The plan rows with the digest of the repaired conversation, from each plan and the texts behind it."""
    head, hashed, steps, at, some, out, kinds = None, None, "", 0, False, [], None

    def feed(line: bytes) -> None:
        nonlocal some
        hashed.update(b"\n" + line if some else line)
        some = True

    def inserts() -> None:
        nonlocal at
        while at < len(steps) and steps[at] in "UA":
            feed(b"user:" if steps[at] == "U" else b"assistant:")
            at += 1

    def flush() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True))
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["conv_id", *OUT, "audit", "repaired_sha256"])

    for batch in batches:
        kinds = [batch.schema[0].type, *[pa.int64()] * len(OUT), pa.string(), pa.string()]
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            *mine, planned, role, text = row
            if planned is not None:  # the next conversation
                if head is not None:
                    inserts()
                    out.append((*head, hashed.hexdigest()))
                head, hashed, steps, at, some = mine, hashlib.sha256(), planned, 0, False
                continue
            inserts()
            c = steps[at]
            at += 1
            if c != "D":
                feed(f"{role if c == 'K' else 'user' if c == 'u' else 'assistant'}:{text}".encode())
        if len(out) >= 512:
            yield flush()
    if head is not None:
        inserts()
        out.append((*head, hashed.hexdigest()))
    if out:
        yield flush()


def damage(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, text, copies: rows damaged by the CRC-32 of `conv_id:turn`, modulo 20 (0: no copy is left)."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how = F.crc32(F.concat(space(conv_col), F.lit(":"), space(turn_col)).cast("binary")) % 20
    rows = rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), space(role_col).alias("role"), space(text_col).alias("text"), how.alias("how"))
    role = F.when(F.col("how") == 4, F.lit("user")).otherwise(F.col("role"))
    text = F.when(F.col("how") == 1, F.lit("")).when(F.col("how") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("how") == 0, 0).when(F.col("how") == 3, 2).otherwise(1).alias("copies"))


def repair(rows: DataFrame, copies: str | Column | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, blank, duplicate, truncated, illegal, gaps, cost, audit, repaired_sha256 for each conversation.

    copies: how often a row counts; a row of no copies only names its conversation.
    """
    small_batches(rows.sparkSession)
    own = F.lit(1) if copies is None else F.col(copies) if isinstance(copies, str) else copies
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).try_cast("long").alias("turn"), space(role_col).alias("role"), space(text_col).alias("text"), own.cast("long").alias("copies"))
    has_word, ended = F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    kind = F.when(~has_word, BLANK).when(~ended, CUT).otherwise(GOOD)
    digest = F.unhex(F.sha2("text", 256))
    # rows without their texts, equal ones counted
    light = rows.select("conv_id", "turn", "role", "copies", digest.alias("digest"), kind.alias("kind"))
    light = light.groupBy("conv_id", "turn", "role", "digest").agg(F.sum("copies").alias("copies"), F.first("kind").alias("kind"))
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn"))  # nulls first
    first = light.where((F.col("kind") != BLANK) & (F.col("copies") > 0)).groupBy("conv_id", "role", "digest").agg(F.min(place).alias("first"))
    first = first.toDF("f_conv", "f_role", "f_digest", "first")
    marked = light.join(first, light["conv_id"].eqNullSafe(first["f_conv"]) & (light["role"] == first["f_role"]) & (light["digest"] == first["f_digest"]), "left")
    later = (F.col("kind") != BLANK) & (place > F.col("first"))
    marked = marked.select("conv_id", "turn", "role", "digest", F.substring("role", 1, 1).alias("initial"), F.when(later, REPEATED).otherwise(F.col("kind")).alias("kind"), "copies")
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    dealt = marked.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "turn", "initial", "kind", "copies")
    name = rows.schema["conv_id"].dataType.simpleString()
    counts = ", ".join(f"{c} long" for c in OUT)
    plans = dealt.mapInArrow(_plans, f"conv_id {name}, {counts}, audit string, steps string")
    # one text for each different row, in its first place
    texts = rows.where(has_word & (F.col("copies") > 0)).groupBy("conv_id", "role", "text").agg(F.min(place).alias("first"))
    texts = texts.select("conv_id", *(F.lit(None).cast("long").alias(c) for c in OUT), *(F.lit(None).cast("string").alias(c) for c in ("audit", "steps")), "role", "text", F.lit(1).alias("part"), F.col("first.turn").alias("turn"), digest.alias("digest"))
    heads = plans.select("*", *(F.lit(None).cast("string").alias(c) for c in ("role", "text")), F.lit(0).alias("part"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("binary").alias("digest"))
    stream = heads.unionByName(texts).repartition("conv_id").sortWithinPartitions("conv_id", "part", F.col("turn").asc_nulls_first(), "role", "digest")
    return stream.select("conv_id", *OUT, "audit", "steps", "role", "text").mapInArrow(_digests, f"conv_id {name}, {counts}, audit string, repaired_sha256 string")
