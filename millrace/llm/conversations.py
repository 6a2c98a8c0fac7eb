"""Conversation structure repair: faults of messages, and the cheapest edits that give user and assistant turns."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import staged

from .auction import DELETE, END, ROLES, STATES, before, crossing, edits, kept, joined, NEXT
from .common import pick, tasks
from .rows import by_row, shape, streaming

#: Messages and characters after which a run of messages is handed on.
RUN_ROWS, RUN_CHARS = 4096, 4_000_000
#: Characters of a text that decide which task gets a message, among those of one turn and role.
HEAD = 64
#: White space, and signs that end a message.
SPACE, ENDS = " \t\n\x0b\x0c\r", ".!?"
#: Fixed value: pairs of role initials that may follow each other.
LEGAL = {"su", "ua", "au"}

RUNS = shape(
    "conv_id bigint, part int, run int, live string, gap_at int[], gap_n bigint[], roles string[], texts string[], costs bigint[], "
    "turns bigint, least_turn bigint, most_turn bigint, first_turn bigint, last_turn bigint, first_role string, last_role string, "
    "blank bigint, duplicate bigint, truncated bigint, illegal bigint, dead bigint")
FACTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
CHAINED = shape("part int, run int, n_runs bigint, after bigint[], " + ", ".join(f"{f} bigint" for f in FACTS))
EXITS = shape("conv_id bigint, part int, run int, exits int[]")
ENTRIES = shape("part int, run int, entry int")
TRACED = shape("conv_id bigint, part int, run int, n_runs bigint, " + ", ".join(f"{f} bigint" for f in FACTS) + ", audit string, body string")
REPAIRED = shape("conv_id bigint, " + ", ".join(f"{f} bigint" for f in FACTS) + ", audit string, repaired_sha256 string")


def damaged(conversations: DataFrame, kinds: int = 20) -> DataFrame:
    """Messages (conv_id, turn, role, text, copies) with faults made by the crc32 of conv_id:turn modulo kinds.

    0 drops a message, 1 empties its text, 2 removes its .!?, 3 doubles it, 4 gives it to the user.
    Nulls count as one space, also in the checksum; conv_id and turn stay null.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = pick(conversations, "conv_id", "turn", "role", "text").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), space("role").alias("role"), space("text").alias("text"))
    kind = F.crc32(F.concat_ws(":", space("conv_id"), space("turn"))) % kinds
    return (
        rows.withColumn("kind", kind).where(F.col("kind") != 0)
        .select(
            "conv_id", "turn",
            F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
            F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text")).alias("text"),
            F.when(F.col("kind") == 3, 2).otherwise(1).cast("bigint").alias("copies")))


def judged(messages: DataFrame) -> DataFrame:
    """Equal messages as one, each with blank, truncated and again (its role and text stand in an earlier turn).

    The first turn of a role and text is a minimum, found from digests, and only those that have more
    than one turn are joined back.
    """
    digest = F.sha2("text", 256)
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    whole = messages.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    # A null turn is the first of all.
    firsts = (
        messages.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), digest.alias("d"))
        .agg(F.min("turn").alias("least"), F.max("turn").alias("most"), F.max(F.col("turn").isNull()).alias("untimed"))
        .where((F.col("least") < F.col("most")) | F.col("untimed") & F.col("least").isNotNull())
        .select("c", "r", "d", F.when(~F.col("untimed"), F.col("least")).alias("first"), F.lit(True).alias("many")))
    marked = whole.withColumn("digest", digest).join(
        firsts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left")
    return marked.select(
        "conv_id", "turn", "role", "text", "copies", (bare == "").alias("blank"),
        (~F.right(bare, F.lit(1)).isin(*ENDS)).alias("truncated"),
        (F.col("many").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first"))).alias("again"))


class Run:
    """Consecutive messages of one conversation in one task: those to repair, and between them those that must go."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.live, self.gaps, self.roles, self.texts = [], {}, [], []
        self.turns, self.least, self.most, self.first_turn, self.last_turn = 0, None, None, None, None
        self.first_role, self.last_role = None, ""
        self.blank = self.duplicate = self.truncated = self.illegal = self.dead = self.chars = 0

    def add(self, turn, role, text, copies, blank, truncated, again) -> None:
        initial = role[:1]
        if self.first_role is None:
            self.first_role, self.first_turn = initial, turn
        else:
            self.illegal += self.last_role + initial not in LEGAL
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.least = turn if self.least is None else self.least
            self.most = turn
        self.last_role, self.last_turn = initial, turn
        self.illegal += (copies - 1) * (2 * initial not in LEGAL)
        if not blank and not again:
            kind = initial if initial in ("s", "u", "a") else "o"
            self.live.append(kind.upper() if truncated else kind)
            self.roles.append(role)
            self.texts.append(text)
            self.chars += len(text)
            self.truncated += truncated
            self.duplicate += copies - 1
            gone = copies - 1
        else:
            self.blank += copies * blank
            self.duplicate += copies * (not blank)
            gone = copies
        if gone:
            self.gaps[len(self.live)] = self.gaps.get(len(self.live), 0) + gone
            self.dead += gone

    def row(self, part: int, run: int) -> tuple:
        live = "".join(self.live)
        costs = [c for line in crossing(live) for c in line]
        return (
            self.conv_id, part, run, live, list(self.gaps), list(self.gaps.values()), self.roles, self.texts, costs,
            self.turns, self.least, self.most, self.first_turn, self.last_turn, self.first_role, self.last_role,
            self.blank, self.duplicate, self.truncated, self.illegal, self.dead)


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Sorted messages to runs."""
    part, number, held = TaskContext.get().partitionId(), 0, None
    for conv_id, *message in by_row(batches):
        if held and (held.conv_id != conv_id or len(held.live) >= RUN_ROWS or len(held.gaps) >= RUN_ROWS or held.chars >= RUN_CHARS):
            yield held.row(part, number)
            held, number = None, number + 1
        held = held or Run(conv_id)
        held.add(*message)
    if held:
        yield held.row(part, number)


def square(costs: list) -> tuple:
    return tuple(tuple(costs[4 * q : 4 * q + 4]) for q in STATES)


def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """For each run of a conversation the costs from its end on, beside what holds for the whole conversation."""
    for _, parts in by_row(batches):
        after, cost = [END], 0
        for p in reversed(parts):
            after.append(before(square(p["costs"]), after[-1]))
            cost += DELETE * p["dead"]
        cost += after.pop()[0]
        after.reverse()
        least = [p["least_turn"] for p in parts if p["least_turn"] is not None]
        most = [p["most_turn"] for p in parts if p["most_turn"] is not None]
        pairs = list(zip(parts, parts[1:]))
        turns = sum(p["turns"] for p in parts) - sum(
            a["last_turn"] is not None and a["last_turn"] == b["first_turn"] for a, b in pairs)
        facts = {f: sum(p[f] for p in parts) for f in ("blank", "duplicate", "truncated", "illegal")}
        facts["illegal"] += sum(a["last_role"] + b["first_role"] not in LEGAL for a, b in pairs)
        facts |= {"gaps": max(most) - min(least) + 1 - turns if least else 0, "cost": cost}
        for p, costs in zip(parts, after, strict=True):
            yield p["part"], p["run"], len(parts), list(costs), *(facts[f] for f in FACTS)


def exits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Where the cheapest edits of a run end, for each state before it."""
    for conv_id, part, run, live, after in by_row(batches):
        ways = before(crossing(live), tuple(after))
        yield conv_id, part, run, [edits(live, q, tuple(after))[1] if ways[q] is not None else None for q in STATES]


def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The state before each run of a conversation."""
    for _, parts in by_row(batches):
        state = 0
        for p in parts:
            yield p["part"], p["run"], state
            state = p["exits"][state]


def edited(live: str, gaps: dict[int, int], roles: list, texts: list, entry: int, after: tuple) -> tuple[str, list[str]]:
    """The letters of all edits of a run, and its messages after them. Messages that must go do so before any insertion."""
    letters, _ = edits(live, entry, after)
    audit, lines, at, state = ["D" * gaps.get(0, 0)], [], 0, entry
    for letter in letters:
        audit.append(letter)
        if letter == "K":
            state = kept(live[at], state)
            lines.append(f"{roles[at]}:{texts[at]}")
        elif letter != "D":
            state = NEXT[state]
            lines.append(f"{ROLES[state]}:{texts[at] if letter == 'R' else ''}")
        if letter != "I":
            at += 1
            if at in gaps:
                audit.append("D" * gaps[at])
    return "".join(audit), lines


def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Edits of each run; the body is null if no message is left."""
    for conv_id, part, run, n_runs, *facts, live, gap_at, gap_n, roles, texts, after, entry in by_row(batches):
        audit, lines = edited(live, dict(zip(gap_at, gap_n, strict=True)), roles, texts, entry, tuple(after))
        yield conv_id, part, run, n_runs, *facts, audit, "\n".join(lines) if lines else None


def closed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Runs in order to one row per conversation; of the messages only their digest is held."""
    held, begun = None, False
    for conv_id, _, _, _, *facts, audit, body in by_row(batches):
        if not begun or held[0] != conv_id:
            if begun:
                yield held[0], *held[1], "".join(held[2]), held[3].hexdigest()
            held, begun, some = (conv_id, facts, [], hashlib.sha256()), True, False
        held[2].append(audit)
        if body is not None:
            held[3].update((("\n" if some else "") + body).encode())
            some = True
    if begun:
        yield held[0], *held[1], "".join(held[2]), held[3].hexdigest()


def repair(messages: DataFrame) -> DataFrame:
    """One row per conversation of messages (conv_id, turn, role, text, copies): faults, and the cheapest edits.

    A conversation's messages stand by turn, nulls first, equal turns by role and text. Each is blank,
    else a duplicate of an earlier one, else truncated, else sound. The edits keep, delete, re-role or
    insert messages so that the roles' initials are empty or an optional s and then ua repeated. Of equally cheap
    ones those with the first letters in ASCII order count. gaps counts turns that are missing
    between the least and the greatest; an empty role has no initial and is never legal beside another.

    Messages are dealt out by range, so a long conversation lies in runs in several tasks. A run
    is repaired in blocks by auctions. What meets per conversation are 16 costs of each run and at last
    the letters of its edits, which its row holds anyway; its texts pass one by one for the digest.
    """
    spark = messages.sparkSession
    n = tasks(spark)
    order = ["conv_id", "turn", "role", "head"]
    found = staged(
        judged(messages).withColumn("head", F.left("text", F.lit(HEAD)))
        .repartitionByRange(n, *order).sortWithinPartitions(*order, "text")
        .select("conv_id", "turn", "role", "text", "copies", "blank", "truncated", "again")
        .mapInArrow(streaming(runs, RUNS, 256), RUNS), "runs")
    told = ["part", "run", "costs", "turns", "least_turn", "most_turn", "first_turn", "last_turn", "first_role", "last_role",
            "blank", "duplicate", "truncated", "illegal", "dead"]
    in_order = lambda *names: F.sort_array(F.collect_list(F.struct(*names)))
    chain = staged(
        found.groupBy("conv_id").agg(in_order(*told).alias("parts")).mapInArrow(streaming(chained, CHAINED, 4096), CHAINED), "chain")
    placed = found.select("conv_id", "part", "run", "live", "gap_at", "gap_n", "roles", "texts").join(chain, ["part", "run"])
    several = placed.where(F.col("n_runs") > 1).select("conv_id", "part", "run", "live", "after")
    entry = (
        several.mapInArrow(streaming(exits, EXITS, 1024), EXITS)
        .groupBy("conv_id").agg(in_order("part", "run", "exits").alias("parts"))
        .mapInArrow(streaming(entries, ENTRIES, 4096), ENTRIES))
    inputs = ["conv_id", "part", "run", "n_runs", *FACTS, "live", "gap_at", "gap_n", "roles", "texts", "after", "entry"]
    alone = placed.where(F.col("n_runs") == 1).withColumn("entry", F.lit(0)).select(*inputs)
    others = placed.where(F.col("n_runs") > 1).join(entry, ["part", "run"]).select(*inputs)
    trace = streaming(traced, TRACED, 256)
    apart = others.mapInArrow(trace, TRACED).repartition(n, "conv_id").sortWithinPartitions("conv_id", "part", "run")
    close = streaming(closed, REPAIRED, 1024)
    return alone.mapInArrow(trace, TRACED).mapInArrow(close, REPAIRED).unionByName(apart.mapInArrow(close, REPAIRED))


def audit(conversations: DataFrame, kinds: int = 20) -> DataFrame:
    """Damage conversations (see :func:`damaged`), repair them (see :func:`repair`), one row for every conv_id there was.

    A conversation of which nothing is left has zeros, an empty audit and the digest of the empty
    string. Rows without conv_id are one conversation. Rows that repeat count as often as they
    occur. An empty table gives no rows; other columns play no part.
    """
    ids = pick(conversations, "conv_id").select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
    done = repair(damaged(conversations, kinds)).withColumnRenamed("conv_id", "c")
    return ids.join(done, F.col("conv_id").eqNullSafe(F.col("c")), "left").select(
        "conv_id", *[F.coalesce(f, F.lit(0).cast("bigint")).alias(f) for f in FACTS], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
