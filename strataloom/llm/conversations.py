"""Conversation structure repair (operator 13).

A conversation's turns should read `(system)? (user assistant)+`. Turns are kept, given another role, deleted, or
turns without text are inserted, at the least cost. The rows of a conversation are brought together, sorted by
turn, and streamed: mapInPandas carries the state of a dynamic program across Arrow batches, so a conversation
of any length is read once and is never held. The state is small: for each of four places in the grammar (start,
after the system turn, after a user turn, after an assistant turn) the least cost, the rank of its edits among
those of the other places, and a running hash of the repaired text. Edits are backpointers of one byte for each turn
and place; beyond SPILL bytes they go to a temporary file of the task, which is removed with the conversation.

Ranks suffice to break ties: the edits of two places after the same turn never begin one with the other, as
both end with the edit of that turn, so whatever follows can't change their order.

Whether an equal turn came before is not remembered in the stream: the first turn of every (conversation, role, text)
that occurs twice or more is counted beforehand by an aggregate, and joined. All turns of one conversation are read
by one task, since the hash of the repaired text is sequential; its memory does not grow with the conversation, but
for the edits that it returns.

Defined results: null roles and texts are one space. Turns that are null come first; equal turns go by role, then by text.
A null conv_id is a conversation of its own. Equal rows are duplicates but for the first. A role whose initial is none
of s, u, a can't be kept. Rows whose `present` is false only name their conversation. An empty table gives no rows.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.llm.common import materialise

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Backpointers of a conversation that are held in memory, in bytes.
SPILL = 1 << 20
START, SYSTEM, USER, ASSISTANT = range(4)
#: What may follow each place, by the initial of a role.
NEXT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
_NAME = {"u": "user", "a": "assistant"}
_FAR = 1 << 60
_WORD = r"[^\x20\x09-\x0D]"
REPORT = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
TURNS = "conv_id bigint, place bigint, edit string, turn bigint, role string, text string"


def _insertions() -> tuple[tuple[tuple[int, str], ...], ...]:
    """For each place the (place, roles) that inserting turns alone reaches, each by the fewest."""
    out = []
    for place in range(4):
        found, edge = {place: ""}, [place]
        while edge:
            edge = [found.setdefault(to, found[at] + c) and to for at in edge for c, to in NEXT[at].items() if c in _NAME and to not in found]
        out.append(tuple(found.items()))
    return tuple(out)


INSERTIONS = _insertions()


def _steps() -> tuple[tuple[tuple[int, int, int, str, str, int], ...], ...]:
    """For each initial of a role (s, u, a, other) all (from, to, cost, edits, roles inserted, code) that consume one turn."""
    out = []
    for initial in "sua ":
        steps = []
        for at in range(4):
            for place, roles in INSERTIONS[at]:
                cost, edits = INSERT * len(roles), "I" * len(roles)
                steps.append((at, place, cost + DELETE, edits + "D", roles, ""))
                if initial in NEXT[place]:
                    steps.append((at, NEXT[place][initial], cost + KEEP, edits + "K", roles, initial))
                for c in _NAME:
                    if c in NEXT[place]:
                        steps.append((at, NEXT[place][c], cost + REROLE, edits + "R", roles, c))
        out.append(tuple(steps))
    return tuple(out)


STEPS = dict(zip("sua ", _steps(), strict=True))
#: All distinct (from, edits) of a turn; a backpointer is a number in this list.
MOVES = sorted({(s[0], s[3]) for steps in STEPS.values() for s in steps})
_MOVE = {m: i for i, m in enumerate(MOVES)}


class Backpointers:
    """Four moves a turn, in memory up to a bound and then in a temporary file; read from the end."""

    def __init__(self, spill: int = SPILL):
        self.young, self.file, self.spill, self.turns = bytearray(), None, spill, 0

    def add(self, moves: bytes) -> None:
        self.young += moves
        self.turns += 1
        if len(self.young) >= self.spill:
            self.file = self.file or tempfile.TemporaryFile()
            self.file.write(self.young)
            self.young = bytearray()

    def backwards(self) -> Iterator[bytes]:
        for i in range(len(self.young) - 4, -1, -4):
            yield self.young[i : i + 4]
        at = self.file.tell() if self.file else 0
        while at:
            size = min(at, self.spill - self.spill % 4 or 4)
            at -= size
            self.file.seek(at)
            block = self.file.read(size)
            for i in range(len(block) - 4, -1, -4):
                yield block[i : i + 4]

    def close(self) -> None:
        if self.file:
            self.file.close()


class Repair:
    """The dynamic program over one conversation, fed turn by turn."""

    def __init__(self, conv_id: int | None, spill: int = SPILL):
        self.conv_id = conv_id
        self.cost, self.rank, self.hash = [0, _FAR, _FAR, _FAR], [0, 1, 2, 3], [hashlib.sha256(), None, None, None]
        self.begun = [False] * 4
        self.moves = Backpointers(spill)
        self.least = self.most = None
        self.distinct = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.before = self.last = None

    def feed(self, turn: int | None, role: str, text: str, blank: bool, truncated: bool, earlier: bool) -> None:
        """One turn; `earlier` says that an equal one stands at a smaller turn."""
        duplicate = earlier or self.last == (turn, role, text)
        self.last = (turn, role, text)
        if turn is not None:
            self.distinct += turn != self.most
            self.least, self.most = turn if self.least is None else self.least, turn
        self.blank += blank
        duplicate = duplicate and not blank
        self.duplicate += duplicate
        truncated = truncated and not blank and not duplicate
        self.truncated += truncated
        initial = role[:1] if role[:1] in ("s", "u", "a") else " "
        if self.before is not None:
            self.illegal += self.before + initial not in ("su", "ua", "au")
        self.before = initial

        best: list = [None] * 4
        for at, to, cost, edits, roles, c in STEPS[initial]:
            if self.cost[at] >= _FAR:
                continue
            if c:
                if blank or duplicate:
                    continue
                cost += TRUNCATED * truncated
            key = (self.cost[at] + cost, self.rank[at], edits)
            if best[to] is None or key < best[to][0]:
                best[to] = (key, at, roles, c)
        hashes, begun, moves = [None] * 4, [False] * 4, bytearray(4)
        for to, found in enumerate(best):
            if found is None:
                continue
            (_, _, edits), at, roles, c = found
            moves[to] = _MOVE[at, edits]
            lines = [f"{_NAME[r]}:" for r in roles]
            if c:
                lines.append(f"{role if edits[-1] == 'K' else _NAME[c]}:{text}")
            hashes[to] = self.hash[at].copy()
            if lines:
                hashes[to].update((("\n" if self.begun[at] else "") + "\n".join(lines)).encode())
            begun[to] = self.begun[at] or bool(lines)
        order = sorted((x[0][1:], to) for to, x in enumerate(best) if x is not None)
        self.rank = [9] * 4
        for k, (_, to) in enumerate(order):
            self.rank[to] = k
        self.cost = [x[0][0] if x else _FAR for x in best]
        self.hash, self.begun = hashes, begun
        self.moves.add(moves)

    def result(self) -> tuple:
        best = None
        for at in range(4):
            for place, roles in INSERTIONS[at]:
                if self.cost[at] < _FAR and place in (START, ASSISTANT):
                    key = (self.cost[at] + INSERT * len(roles), self.rank[at], "I" * len(roles))
                    if best is None or key < best[0]:
                        best = (key, at, roles)
        (cost, _, tail), at, roles = best
        digest = self.hash[at].copy()
        if roles:
            digest.update((("\n" if self.begun[at] else "") + "\n".join(f"{_NAME[r]}:" for r in roles)).encode())
        edits, place = [tail], at
        for moves in self.moves.backwards():
            place, made = MOVES[moves[place]]
            edits.append(made)
        self.moves.close()
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.distinct
        return (self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, "".join(reversed(edits)), digest.hexdigest())


def _streamed(spill: int):
    """A function for mapInPandas over rows that are sorted by conversation and turn."""
    names = [x.split()[0] for x in REPORT.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, known, done = None, False, []
        for frame in batches:
            for conv, turn, role, text, blank, truncated, earlier, present in frame.itertuples(index=False, name=None):
                conv = None if pd.isna(conv) else int(conv)
                if not known or conv != current.conv_id:
                    if known:
                        done.append(current.result())
                    current, known = Repair(conv, spill), True
                if present:
                    current.feed(None if pd.isna(turn) else int(turn), role, text, blank, truncated, earlier)
            if done:
                yield pd.DataFrame(done, columns=names).astype({"conv_id": "Int64"})
                done = []
        if known:
            yield pd.DataFrame([current.result()], columns=names).astype({"conv_id": "Int64"})

    return run


def _plain(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, present) without nulls in role and text."""
    present = F.coalesce(F.col("present"), F.lit(False)) if "present" in turns.columns else F.lit(True)
    text = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    return turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), text("role"), text("text"), present.alias("present"))


def repair(turns: DataFrame, spill: int = SPILL) -> DataFrame:
    """One row of REPORT for each conversation of (conv_id, turn, role, text[, present])."""
    rows = _plain(turns)
    # the length keeps role and text apart
    same = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    rows = rows.withColumn("same", F.when(F.col("present"), same))
    first = rows.where("present").groupBy("conv_id", "same").agg(F.count("*").alias("n"), F.count("turn").alias("turns"), F.min("turn").alias("first"))
    first = first.where("n > 1").select(F.col("conv_id").alias("c"), F.col("same").alias("h"), F.when(F.col("n") == F.col("turns"), F.col("first")).alias("first"), F.lit(True).alias("again"))
    joined = rows.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("same") == F.col("h")), "left")
    earlier = F.coalesce(F.col("again") & F.col("turn").isNotNull() & (F.col("first").isNull() | (F.col("turn") > F.col("first"))), F.lit(False))
    last = F.regexp_extract("text", rf"({_WORD})[\x20\x09-\x0D]*\z", 1)
    judged = joined.select(
        "conv_id", "turn", "role", "text", (last == "").alias("blank"), (~last.isin("", ".", "!", "?")).alias("truncated"), earlier.alias("earlier"), "present"
    )
    dealt = judged.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    return dealt.mapInPandas(_streamed(spill), REPORT)


def _rebuilt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The repaired turns of conversations whose first row holds the edits."""
    audit, at, place, before = "", 0, 0, ""
    names = [x.split()[0] for x in TURNS.split(", ")]

    def inserted(conv, out):
        nonlocal at, place, before
        while at < len(audit) and audit[at] == "I":
            before = "a" if before == "u" else "u"
            out.append((conv, place, "I", None, _NAME[before], ""))
            at, place = at + 1, place + 1

    for frame in batches:
        out = []
        for conv, turn, role, text, edits, left in frame.itertuples(index=False, name=None):
            conv = None if pd.isna(conv) else int(conv)
            if edits is not None:
                audit, at, place, before = edits, 0, 0, ""
            else:
                inserted(conv, out)
                edit, at = audit[at], at + 1
                if edit != "D":
                    before = role[:1] if edit == "K" else "a" if before == "u" else "u"
                    out.append((conv, place, edit, None if pd.isna(turn) else int(turn), role if edit == "K" else _NAME[before], text))
                    place += 1
            if not left:
                inserted(conv, out)
        yield pd.DataFrame(out, columns=names).astype({"conv_id": "Int64", "turn": "Int64", "place": "int64"})


def repaired(turns: DataFrame, report: DataFrame) -> DataFrame:
    """The turns of TURNS that the edits in a report leave, numbered from 0; the report goes ahead of a conversation's turns in the stream."""
    rows = _plain(turns).where("present")
    head = report.select("conv_id", F.lit(None).cast("bigint").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), F.col("audit").alias("edits"), (F.regexp_count("audit", F.lit("[^I]"))).alias("turns"))
    body = rows.select("conv_id", "turn", "role", "text", F.lit(None).cast("string").alias("edits"), F.lit(None).cast("int").alias("turns"))
    both = head.unionByName(body)
    dealt = both.repartition("conv_id").sortWithinPartitions("conv_id", F.col("edits").isNull(), F.col("turn").asc_nulls_first(), "role", "text")
    return dealt.mapInPandas(_counted, TURNS)


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Replace the number of turns in a conversation's first row by how many are left after each row, and rebuild."""

    def numbered():
        left = 0
        for frame in batches:
            rest = []
            for edits, turns in zip(frame["edits"], frame["turns"], strict=True):
                left = int(turns) if edits is not None else left - 1
                rest.append(left)
            yield frame.assign(turns=rest)

    return _rebuilt(numbered())


def damage(turns: DataFrame) -> DataFrame:
    """Damaged rows (conv_id, turn, role, text, present), by crc32 of `conv_id:turn`; a dropped row stays as one that is not present."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind: Column = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(said("text"), "[.!?]", "")).otherwise(said("text"))
    role = F.when(kind == 4, "user").otherwise(said("role"))
    gone = kind == 0
    none = F.lit(None).cast("string")
    made = turns.select("conv_id", "turn", F.when(~gone, role).otherwise(none).alias("role"), F.when(~gone, text).otherwise(none).alias("text"), (~gone).alias("present"), kind.alias("kind"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return made.select("conv_id", "turn", "role", "text", "present", copies.alias("copy")).drop("copy")


def op13_conversation_repair(conversations: DataFrame) -> DataFrame:
    return repair(damage(conversations))
