"""Repair of conversation structure: sorted streams with the state carried across batches.

A conversation is right when its role initials match ``(s?(ua)+)?``. The cheapest
edits that make it so are found by two streams over rows that are dealt by
conversation and sorted by turn:

1. Newest row first. The state is the cheapest cost of all that follows, for each of
   the four states of the pattern. What a state would do at a row is one of four
   edits, so a row leaves one byte, and the bytes of a conversation of any length go
   out as rows of a table (``decisions``) whenever a run of them is full.
2. Oldest row first. The rows of that table are sorted in between the messages, each
   run in front of the rows it decides, so the stream reads its own decisions as it
   goes, and neither texts nor decisions of a conversation are ever held at once.

A conversation is one stream, since the digest of its text has to be read in order;
it takes the memory of one Arrow batch and one run of decisions, however long it is.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from passagework.llm.common import slices, stored

REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
RUN_ROWS = 1 << 16
BLANK, DUPLICATE, CUT_OFF = 1, 2, 3
SPACES = " \t\n\x0b\x0c\r"
EDITS = "DIKR"

# States of the pattern: nothing yet, after s, after u, after a. The first and the
# last may end. What an inserted or renamed turn is follows from the state.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
AFTER_EDIT = (USER, USER, ASSISTANT, USER)
NAMES = {USER: "user", ASSISTANT: "assistant"}
KEEP = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER},
        "a": {USER: ASSISTANT}}
INITIALS = ("", "s", "u", "a")
_NEVER = 1 << 40


def _row_costs(after: tuple, initial: str, must_go: bool, cut_off: bool) -> list[dict]:
    """For each state the cost of each edit of a row, given the costs after it."""
    extra = TRUNCATED if cut_off else 0
    found = []
    for state in range(4):
        costs = {"D": DELETE + after[state]}
        if not must_go:
            costs["R"] = REROLE + extra + after[AFTER_EDIT[state]]
            kept = KEEP.get(initial, {}).get(state)
            if kept is not None:
                costs["K"] = extra + after[kept]
        found.append(costs)
    return found


def _with_inserts(costs: list[int]) -> list[int]:
    """Costs that may begin with inserted turns; two in a row are the most that help."""
    costs = list(costs)
    for _ in range(2):
        costs = [min(c, INSERT + costs[AFTER_EDIT[s]]) for s, c in enumerate(costs)]
    return costs


class _Backward:
    """The newest-first stream of one conversation.

    Only differences of costs decide, and these take few values, so a step is
    looked up once it has been made.
    """

    steps: dict = {}

    def __init__(self):
        self.costs = tuple(_with_inserts([0 if s in ENDS else _NEVER for s in range(4)]))

    def step(self, code: int) -> int:
        """The byte of decisions of a row: two bits per state."""
        known = self.steps.get((self.costs, code))
        if known is None:
            must_go, cut_off, initial = code >> 3 & 1, code >> 2 & 1, INITIALS[code & 3]
            rows = _row_costs(self.costs, initial, bool(must_go), bool(cut_off))
            best = _with_inserts([min(r.values()) for r in rows])
            byte = 0
            for state, costs in enumerate(rows):
                costs["I"] = INSERT + best[AFTER_EDIT[state]]
                edit = min(e for e, c in costs.items() if c == best[state])
                byte |= EDITS.index(edit) << 2 * state
            low = min(best)
            known = self.steps[self.costs, code] = (tuple(c - low for c in best), byte)
        self.costs, byte = known
        return byte


DECISIONS = "conv_id {kind}, turn {turn}, run binary"


def _decide(run_rows: int, schema: pa.Schema):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, conv, turn, run = None, None, None, bytearray()

        def spilled():
            return pa.RecordBatch.from_arrays(
                [pa.array([conv], schema.field(0).type), pa.array([turn], schema.field(1).type),
                 pa.array([bytes(reversed(run))], pa.binary())],
                schema=schema,
            )

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "code")]
            for own, own_turn, code in zip(*columns):
                if stream is None or own != conv:
                    if run:
                        yield spilled()
                    stream, conv, run = _Backward(), own, bytearray()
                elif len(run) >= run_rows and own_turn != turn:
                    yield spilled()
                    run = bytearray()
                turn = own_turn
                run.append(stream.step(code))
        if run:
            yield spilled()

    return read


def _arrow_schema(df: DataFrame) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df.schema)


class _Forward:
    """The oldest-first stream of one conversation: faults, edits, repaired turns."""

    def __init__(self):
        self.runs: deque[memoryview] = deque()
        self.place = 0
        self.state = START
        self.audit: list[str] = []
        self.cost = 0
        self.faults = [0, 0, 0, 0]
        self.illegal = 0
        self.initial = None
        self.turns = 0
        self.first_turn = self.last_turn = None
        self.digest = hashlib.sha256()
        self.lines = 0

    def _decision(self) -> int:
        while self.place == len(self.runs[0]):
            self.runs.popleft()
            self.place = 0
        self.place += 1
        return self.runs[0][self.place - 1]

    def _say(self, role: str, text: str):
        line = f"{role}:{text}".encode("utf-8", "surrogatepass")
        self.digest.update(b"\n" + line if self.lines else line)
        self.lines += 1
        return role, text

    def _insert(self):
        self.audit.append("I")
        self.cost += INSERT
        self.state = AFTER_EDIT[self.state]
        return "I", *self._say(NAMES[self.state], "")

    def message(self, turn, role: str, text: str, fault: int):
        """The repaired turns (edit, role, text) up to and with this row."""
        self.faults[fault] += 1
        initial = role[:1]
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = initial
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        decision = self._decision()
        out = []
        while (edit := EDITS[decision >> 2 * self.state & 3]) == "I":
            out.append(self._insert())
        self.audit.append(edit)
        if edit == "D":
            self.cost += DELETE
            return out
        self.cost += TRUNCATED if fault == CUT_OFF else 0
        if edit == "R":
            self.cost += REROLE
            self.state = AFTER_EDIT[self.state]
            role = NAMES[self.state]
        else:
            self.state = KEEP[initial][self.state]
        out.append((edit, *self._say(role, text)))
        return out

    def end(self):
        out = []
        while self.state not in ENDS:
            out.append(self._insert())
        return out

    def summary(self) -> tuple:
        gaps = 0 if self.turns == 0 else self.last_turn - self.first_turn + 1 - self.turns
        return (gaps, self.faults[BLANK], self.faults[DUPLICATE], self.faults[CUT_OFF],
                self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest())


SUMMARY = ("gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
           "audit string, repaired_sha256 string")
TURNS = "place long, edit string, role string, text string"


def _replay(summary: bool, schema: pa.Schema):
    """One row per conversation, or one per repaired turn."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, conv, rows, place = None, None, [], 0

        def said(turns):
            nonlocal place
            if not summary:
                for turn in turns:
                    rows.append((conv, place, *turn))
                    place += 1

        def closed():
            said(stream.end())
            if summary:
                rows.append((conv, *stream.summary()))

        def batch_of():
            columns = list(zip(*rows)) or [()] * len(schema)
            arrays = [pa.array(c, f.type) for c, f in zip(columns, schema)]
            rows.clear()
            return pa.RecordBatch.from_arrays(arrays, schema=schema)

        names = ("conv_id", "turn", "role", "text", "fault", "present", "run")
        for batch in slices(batches, 1024):
            for own, turn, role, text, fault, present, run in zip(
                *[batch.column(c).to_pylist() for c in names]
            ):
                if stream is None or own != conv:
                    if stream is not None:
                        closed()
                    stream, conv, place = _Forward(), own, 0
                if run is not None:
                    stream.runs.append(memoryview(run))
                elif present:
                    said(stream.message(turn, role, text, fault))
            yield batch_of()
        if stream is not None:
            closed()
            yield batch_of()

    return read


def faulty(conversations: DataFrame, present: Column | None = None) -> DataFrame:
    """conv_id, turn, role, text, present, fault: the first fault of every row, 0 for none."""
    there = F.lit(True) if present is None else F.coalesce(present, F.lit(False))
    rows = conversations.select(
        "conv_id", "turn",
        *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")],
        there.alias("present"),
    )
    core = F.rtrim("text", F.lit(SPACES))
    blank = core == ""
    # Blank and absent rows need no comparison, and may be very many.
    aside = F.when(blank | ~F.col("present"), F.pmod(F.xxhash64("turn"), F.lit(4096)))
    same = Window.partitionBy("conv_id", "role", "text", "present", "aside")
    nth = F.row_number().over(same.orderBy(F.asc_nulls_first("turn")))
    fault = (
        F.when(~F.col("present"), 0)
        .when(blank, BLANK)
        .when(F.col("nth") > 1, DUPLICATE)
        .when(~F.right(core, F.lit(1)).isin(*".!?"), CUT_OFF)
        .otherwise(0)
    )
    return rows.withColumn("aside", aside).withColumn("nth", nth).select(
        "conv_id", "turn", "role", "text", "present", fault.cast("int").alias("fault")
    )


def _code() -> Column:
    """What decides the edits of a row: whether it must go, is cut off, and its initial."""
    initial = F.left("role", F.lit(1))
    number = F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(0)
    gone = F.col("fault").isin(BLANK, DUPLICATE).cast("int")
    return gone * 8 + (F.col("fault") == CUT_OFF).cast("int") * 4 + number


def _streamed(conversations: DataFrame, present, summary: bool, run_rows: int) -> DataFrame:
    rows = stored(faulty(conversations, present), "faults")
    # Of rows alike in turn, role and text the one seen first is no duplicate.
    order = [F.col("role"), F.col("text"), F.col("fault") == DUPLICATE]
    newest_first = (
        rows.filter("present")
        .repartition("conv_id")
        .sortWithinPartitions(
            "conv_id", F.desc_nulls_last("turn"), *[F.desc(c) for c in order]
        )
        .select("conv_id", "turn", _code().alias("code"))
    )
    shape = rows.select("conv_id", "turn", F.lit(b"").alias("run"))
    decisions = stored(
        newest_first.mapInArrow(_decide(run_rows, _arrow_schema(shape)), shape.schema), "decisions"
    )
    messages = rows.withColumn("run", F.lit(None).cast("binary"))
    both = messages.unionByName(decisions.withColumn("present", F.lit(True)),
                                allowMissingColumns=True)
    oldest_first = both.repartition("conv_id").sortWithinPartitions(
        "conv_id", F.asc_nulls_first("turn"), F.col("run").isNull(), *order
    )
    kind = rows.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, {SUMMARY if summary else TURNS}"
    empty = rows.sparkSession.createDataFrame([], schema)
    return oldest_first.select(
        "conv_id", "turn", "role", "text", "fault", "present", "run"
    ).mapInArrow(_replay(summary, _arrow_schema(empty)), schema)


def repairs(
    conversations: DataFrame, present: Column | None = None, run_rows: int = RUN_ROWS
) -> DataFrame:
    """One row per conv_id: what is wrong, and the cheapest edits that mend it.

    Columns gaps, blank, duplicate, truncated, illegal, cost, audit (the edits' initials:
    Keep, Rerole, Delete, Insert) and the digest of the repaired ``role:text`` lines.
    Rows go by turn (nulls first), those of one turn by role and text; null roles and
    texts count as one space. Of equal cost the audit that is least in ASCII counts.
    Rows for which ``present`` is not true only make their conversation appear: one
    without any other row has zeros, an empty audit and the digest of nothing. A null
    conv_id is a conversation. An empty table gives no rows; other columns are not read.
    ``run_rows`` decisions are written at a time (rows of one turn are not parted).
    """
    return _streamed(conversations, present, True, run_rows)


def repaired_turns(
    conversations: DataFrame, present: Column | None = None, run_rows: int = RUN_ROWS
) -> DataFrame:
    """The repaired conversations: conv_id, place (from 0), edit (K, R or I), role, text.

    Rows and edits are those of :func:`repairs`; conversations that end up empty give
    no row.
    """
    return _streamed(conversations, present, False, run_rows)


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with known faults, by the CRC-32 of ``conv_id:turn`` modulo 20.

    0 takes the row away (``present`` false), 1 its text, 2 its full stops, exclamation
    and question marks; 3 repeats the row, 4 makes its role user. Nulls of role and
    text, and in the checked string, count as one space.
    """
    parts = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    rows = conversations.select(
        "conv_id", "turn",
        *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")],
        (F.crc32(F.concat_ws(":", *parts).cast("binary")) % 20).alias("damage"),
    )
    text = (
        F.when(F.col("damage") == 1, "")
        .when(F.col("damage") == 2, F.translate("text", ".!?", ""))
        .otherwise(F.col("text"))
    )
    times = F.array_repeat(F.col("damage") != 0, F.when(F.col("damage") == 3, 2).otherwise(1))
    return rows.select(
        "conv_id", "turn",
        F.when(F.col("damage") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"),
        F.explode(times).alias("present"),
    )
