"""Repair of conversation structure: the cheapest edits that make the roles of a conversation an optional system turn and then
pairs of user and assistant, by a Viterbi search that emits an edit as soon as all survivors agree on it.

1. Faults of rows are found by Spark: blank text, role and text seen earlier in the conversation (a window over conversation, role and
   text), no closing mark. A row counts under its first fault.
2. Conversations are dealt by their id and sorted by turn; a task streams its rows and holds one conversation's open part only.
3. Search. Four states (nothing yet, after system, after user, after assistant) each keep one survivor: the cheapest edits so far, of equal
   ones the least as text. Survivors are leaves of a tree of backpointers. A node knows how many children and survivors refer to it; one that
   nothing refers to goes, with all above it that only it held. When all survivors descend from one child of the root, that child's edit is
   final: it is emitted, the row it took is freed and the child becomes the root.
   What follows the assistant state costs no more than what follows the system state, and at most one deletion (of a system turn) more than
   what follows nothing; the user state is an insert from it. A survivor that is dearer than another by more than that can't win, nor tie, and goes.
4. Ties. Survivors are compared by their whole open parts. Two open parts that end with a row's edit differ before their ends, so what is appended later
   doesn't change their order: the order of the at most four is carried from row to row as ranks, and a tie is decided by
   rank, then by the few edits after it. That is the order of the whole texts, at a constant cost a row.

A conversation's digest is one SHA-256 over all its turns in order, so one task must read it whole; memory stays bounded by its open
part, however long it is.

Nulls in any column are one space (a row without conv_id belongs to the conversation without one). Rows of one turn are ordered by role and text, and
those that repeat are duplicates. A conversation without rows left gives zeros and an empty audit. Roles other than the three can be
kept where their first letter fits. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from airlens.llm.common import small_batches, trimmed

SPACE = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
NEW, SYSTEM, USER, ASSISTANT = range(4)
#: From each state, the state and the role that the next user or assistant turn leads to.
AFTER = (USER, USER, ASSISTANT, USER)
ROLE = ("user", "user", "assistant", "user")
LEGAL = {"su", "ua", "au"}


class _Node:
    __slots__ = ("above", "edit", "below", "held")

    def __init__(self, above: _Node | None, edit: str):
        self.above, self.edit, self.below, self.held = above, edit, [], 0
        if above is not None:
            above.below.append(self)


class Survivors:
    """The search over one conversation. put() takes a row and returns the edits that are final by then; end() returns the rest."""

    def __init__(self):
        self.root = _Node(None, "")
        # Of each state: cost, rank of its open part up to the last row's edit, inserts after that, and its leaf.
        self.best: dict[int, tuple[int, int, int, _Node]] = {}
        self._grown({NEW: (0, 0, self.root)})

    def _grown(self, ends: dict[int, tuple[int, int, _Node]]) -> None:
        """Adds what inserts reach: at most three of them, for more lead back to a state at a higher cost."""
        best = {state: (cost, rank, 0, node, state) for state, (cost, rank, node) in ends.items()}
        for _ in range(3):
            for state, (cost, rank, many, node, origin) in list(best.items()):
                to, new = AFTER[state], (cost + INSERT, rank, many + 1, node, origin)
                if to not in best or new[:3] < best[to][:3]:
                    best[to] = new
        cost = lambda state, more: best[state][0] + more if state in best else float("inf")
        for state, least in ((NEW, min(cost(ASSISTANT, DELETE), cost(USER, INSERT + DELETE))), (SYSTEM, min(cost(ASSISTANT, 0), cost(USER, INSERT)))):
            if cost(state, 0) > least:
                best.pop(state, None)
        old, self.best = self.best, {}
        for state, (cost, rank, many, node, _) in best.items():
            for _ in range(many):
                node = next((x for x in node.below if x.edit == "I"), None) or _Node(node, "I")
            node.held += 1
            self.best[state] = (cost, rank, many, node)
        for *_, node in old.values():
            node.held -= 1
        # What no survivor refers to any more: old leaves, and new row ends that inserts made dearer than another way.
        for node in [x[3] for x in old.values()] + [x[2] for x in ends.values()]:
            while node.above is not None and not node.held and not node.below:
                node.above.below.remove(node)
                node.above, node = None, node.above

    def put(self, initial: str, must_go: bool, cut: bool) -> list[str]:
        tries: dict[int, tuple] = {}

        def offer(to: int, cost: int, state: int, edit: str) -> None:
            had, rank, many, node = self.best[state]
            new = (had + cost, rank, "I" * many + edit, node, edit)
            if to not in tries or new[:3] < tries[to][:3]:
                tries[to] = new

        extra = TRUNCATED * cut
        for state in self.best:
            offer(state, DELETE, state, "D")
            if not must_go:
                offer(AFTER[state], REROLE + extra, state, "R")
                if initial == "s" and state == NEW:
                    offer(SYSTEM, KEEP + extra, state, "K")
                elif initial == ROLE[state][0]:
                    offer(AFTER[state], KEEP + extra, state, "K")
        order = sorted({x[1:3] for x in tries.values()})
        ends = {to: (cost, order.index((rank, tail)), _Node(node, edit)) for to, (cost, rank, tail, node, edit) in tries.items()}
        self._grown(ends)
        return self._final()

    def _final(self) -> list[str]:
        out = []
        while not self.root.held and len(self.root.below) == 1:
            self.root = self.root.below[0]
            self.root.above = None
            out.append(self.root.edit)
        return out

    def open_nodes(self) -> int:
        """Nodes of the tree, the root left out: what the search holds."""
        todo, many = [self.root], -1
        while todo:
            many += 1
            todo += todo.pop().below
        return many

    def end(self) -> tuple[int, list[str]]:
        cost, _, _, node = min((self.best[s] for s in (NEW, ASSISTANT) if s in self.best), key=lambda x: x[:3])
        out = []
        while node is not self.root:
            out.append(node.edit)
            node = node.above
        return cost, out[::-1]


class Conversation:
    """Rows of a conversation in order, to repaired turns (edit, role, text) as they become final, and its figures."""

    def __init__(self):
        self.search, self.waiting, self.state = Survivors(), deque(), NEW
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.least = self.most = self.last_turn = None
        self.turns = self.illegal = self.cost = 0
        self.before: str | None = None
        self.audit: list[str] = []

    def put(self, turn: int | None, role: str, text: str | None, fault: str | None) -> list[tuple[str, str, str]]:
        if turn is not None:
            self.least = turn if self.least is None else self.least
            self.turns += turn != self.last_turn
            self.most = self.last_turn = turn
        if fault:
            self.counts[fault] += 1
        self.illegal += self.before is not None and self.before + role[:1] not in LEGAL
        self.before = role[:1]
        self.waiting.append((role, text))
        return self._turned(self.search.put(role[:1], fault in ("blank", "duplicate"), fault == "truncated"))

    def end(self) -> list[tuple[str, str, str]]:
        self.cost, rest = self.search.end()
        return self._turned(rest)

    def _turned(self, edits: list[str]) -> list[tuple[str, str, str]]:
        out = []
        self.audit += edits
        for edit in edits:
            role, text = ("", "") if edit == "I" else self.waiting.popleft()
            if edit == "D":
                continue
            to = SYSTEM if edit == "K" and self.state == NEW and role[:1] == "s" else AFTER[self.state]
            out.append((edit, role if edit == "K" else ROLE[self.state], text))
            self.state = to
        return out

    @property
    def gaps(self) -> int:
        return 0 if self.least is None else self.most - self.least + 1 - self.turns


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, live: rows with nulls as one space, damaged by the checksum of conversation and turn. Rows
    that are dropped stay as not live, so that their conversation is known."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how = F.crc32(F.encode(F.concat(space("conv_id"), F.lit(":"), space("turn")), "UTF-8")) % 20
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), how.alias("how"))
    text = F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("how") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.array_repeat(F.lit(True), F.when(F.col("how") == 3, 2).otherwise(1))).alias("_")
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("how") != 0).alias("live"), times).drop("_")


def with_faults(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text, live) with `fault`, dealt by conversation and in its order."""
    body = F.rtrim("text", F.lit(SPACE))
    seen = F.row_number().over(Window.partitionBy("live", "conv_id", "role", "text").orderBy(F.col("turn").asc_nulls_first())) > 1
    fault = F.when(~F.col("live"), None).when(body == "", "blank").when(seen, "duplicate").when(~F.substring(body, -1, 1).isin(".", "!", "?"), "truncated")
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text", F.coalesce(F.col("fault") == "duplicate", F.lit(False))]
    return rows.withColumn("fault", fault).repartition("conv_id").sortWithinPartitions(*order)


def _streamed(begin: Callable, put: Callable, end: Callable) -> Callable:
    """A function of sorted batches: begin(conv_id) at each new conversation, put(it, conversation, turns), end(it, conversation)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator:
        own = talk = None
        started = False
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "fault", "live")]
            for conv_id, turn, role, text, fault, live in zip(*columns):
                if not started or conv_id != own:
                    if started:
                        yield end(held, talk)
                    started, own, talk, held = True, conv_id, Conversation(), begin(conv_id)
                if live:
                    for row in put(held, talk.put(turn, role, text, fault)):
                        yield row
        if started:
            yield end(held, talk)

    return run


_SUMMARY = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())])


class _Digest:
    def __init__(self, conv_id: int | None):
        self.conv_id, self.sha, self.some = conv_id, hashlib.sha256(), False

    def put(self, turns: list[tuple[str, str, str]]) -> list:
        for _, role, text in turns:
            self.sha.update(f"{chr(10) * self.some}{role}:{text}".encode())
            self.some = True
        return []

    def end(self, talk: Conversation) -> dict:
        self.put(talk.end())
        return {"conv_id": self.conv_id, "gaps": talk.gaps, **talk.counts, "illegal": talk.illegal, "cost": talk.cost, "audit": "".join(talk.audit), "repaired_sha256": self.sha.hexdigest()}


def _batched(rows: Iterator[dict], schema: pa.Schema, size: int = 2048) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    yield pa.RecordBatch.from_pylist(held, schema)


def repair(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256: a row a conversation. rows: conv_id,
    turn, role, text, live."""
    small_batches(rows.sparkSession)
    run = _streamed(_Digest, lambda held, turns: held.put(turns), lambda held, talk: held.end(talk))
    return with_faults(rows).mapInArrow(trimmed(lambda batches: _batched(run(batches), _SUMMARY)), "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


_TURNS = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])


class _Turns:
    def __init__(self, conv_id: int | None):
        self.conv_id, self.place = conv_id, 0

    def put(self, turns: list[tuple[str, str, str]]) -> Iterator[dict]:
        for edit, role, text in turns:
            yield {"conv_id": self.conv_id, "place": self.place, "edit": edit, "role": role, "text": text}
            self.place += 1


def repaired_turns(rows: DataFrame) -> DataFrame:
    """conv_id, place, edit, role, text: the repaired conversations themselves, turn by turn."""
    small_batches(rows.sparkSession)
    run = _streamed(_Turns, lambda held, turns: held.put(turns), lambda held, talk: list(held.put(talk.end())))

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for row in run(batches):
            yield from row if isinstance(row, list) else [row]

    return with_faults(rows).mapInArrow(trimmed(lambda batches: _batched(flat(batches), _TURNS)), "conv_id long, place long, edit string, role string, text string")
