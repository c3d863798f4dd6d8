r"""Conversation structure repair by a square-root checkpointed dynamic program.

The rows of a conversation, by turn, are edited until their roles' initials read
``(s?(ua)+)?``: a row is kept (cost 0), gets the role user or assistant (2) or is deleted (3), and
turns of user or assistant without text are inserted anywhere (2). Blank rows and
duplicates have to be deleted; a truncated row that stays costs 1 more. Of the cheapest edits those
whose letters (D, I, K, R) sort first in ASCII are chosen; in each state of the
pattern the letters say everything, as only one role can be inserted there.

From the back, a vector holds the cheapest cost to the end from every state. Only vectors
at checkpoints, a square root of the rows apart, are stored; walking forward, the
vectors of one block at a time are computed again, and the first letter whose cost fits is
taken. Vectors are kept less their minimum, so few different ones occur and steps are remembered.

Rows are range-partitioned by conversation and turn, so a conversation of any size is
spread over tasks. For conversations in several partitions every part is first summed up as a matrix (costs from
each state to each state; the vector at its end is a checkpoint, too), then as the state it
leaves for each state it is entered in. Two such rows a partition at most pass through the driver.

Null role or text is one blank. Null turns come first, null conv_id is a conversation. Rows of
equal turn are ordered by role, then text; equal rows are counted before anything else, so that
they are one row with ``copies``, the later ones being duplicates. Very long texts are only passed through. Extra columns are
not read. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import lru_cache
from math import isqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchgrid.llm.common import tidy
from matchgrid.sources.store import discard, stored

# Fixed values of the contract: white space, marks that end a text, costs, pairs of initials.
WHITE = " \t\n\v\f\r"
MARKS = ".!?"
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}

# States of the pattern: nothing yet, after s, after u, after a.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
#: The state that an initial leads to; others end in no state.
TAKES = {"s": {NOTHING: SYSTEM}, "u": {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}, "": {}}
#: The role that can be inserted in a state, and the state after it.
INSERTED = ["user", "user", "assistant", "user"]
AFTER = [USER, USER, ASSISTANT, USER]
FAR = 1 << 40
#: Kinds of rows; a row's code is kind * 4 + initial.
FINE, CUT_SHORT, FORCED = range(3)
INITIALS = ["s", "u", "a", ""]

Vector = tuple[int, ...]


def closed(costs: list[int]) -> list[int]:
    """Costs when turns may be inserted first: two at most, as a third leads back."""
    for _ in range(2):
        costs = [min(c, INSERT + costs[AFTER[s]]) for s, c in enumerate(costs)]
    return costs


def normal(costs: list[int]) -> tuple[Vector, int]:
    """Costs less their minimum, and the minimum."""
    least = min(costs)
    return tuple(min(c - least, FAR) for c in costs), least


END, _ = normal(closed([0, FAR, FAR, 0]))


def choices(code: int, ahead: Vector, state: int):
    """(letter, cost, next state) of the edits of a row, in ASCII order but for insertion."""
    kind, initial = code >> 2, INITIALS[code & 3]
    yield "D", DELETE + ahead[state], state
    if kind != FORCED:
        more = TRUNCATED if kind == CUT_SHORT else 0
        if state in TAKES[initial]:
            to = TAKES[initial][state]
            yield "K", more + ahead[to], to
        yield "R", REROLE + more + ahead[AFTER[state]], AFTER[state]


@lru_cache(maxsize=1 << 16)
def step(code: int, ahead: Vector) -> tuple[Vector, int]:
    """The vector in front of a row, less its minimum, and the minimum."""
    return normal(closed([min(c for _, c, _ in choices(code, ahead, s)) for s in range(STATES)]))


@lru_cache(maxsize=1 << 16)
def walked(code: int, ahead: Vector, state: int) -> tuple[str, tuple[str | None, ...], int, int]:
    """Letters, roles of what they leave (None: the row's own), next state and cost at one row."""
    here, least = step(code, ahead)
    letters, roles, cost = "", [], 0
    while True:
        left = here[state] + least
        options = {k: (c, to) for k, c, to in choices(code, ahead, state)}
        options["I"] = (INSERT + here[AFTER[state]] + least, AFTER[state])
        letter = min(k for k, (c, _) in options.items() if c == left)
        to = options[letter][1]
        letters += letter
        if letter == "I":
            roles.append(INSERTED[state])
            cost, state = cost + INSERT, to
            continue
        if letter != "D":
            roles.append(None if letter == "K" else INSERTED[state])
        return letters, tuple(roles), to, cost + left - ahead[to]


def at_the_end(state: int) -> tuple[str, list[str]]:
    """Letters and roles of what is inserted after the last row."""
    letters, roles = "", []
    while END[state]:
        letters, state, roles = letters + "I", AFTER[state], [*roles, INSERTED[state]]
    return letters, roles


def repaired(codes: bytes, end: Vector, state: int):
    """What walked() gives for every row, with vectors stored at checkpoints only."""
    size = isqrt(len(codes)) + 1
    checkpoints = [end]  # from the back
    ahead = end
    for at in range(len(codes) - 1, 0, -1):
        ahead, _ = step(codes[at], ahead)
        if at % size == 0:
            checkpoints.append(ahead)
    for start in range(0, len(codes), size):
        block = codes[start : start + size]
        vectors = [checkpoints.pop()]
        for code in reversed(block[1:]):
            vectors.append(step(code, vectors[-1])[0])
        for code in block:
            found = walked(code, vectors.pop(), state)
            state = found[2]
            yield found


def matrix(codes: bytes) -> list[int]:
    """The least cost from each state in front of the rows to each state after them, row by row."""
    columns = []
    for e in range(STATES):
        ahead, total = normal([0 if s == e else FAR for s in range(STATES)])
        for code in reversed(codes):
            ahead, least = step(code, ahead)
            total += least
        columns.append([c + total if c < FAR else FAR for c in ahead])
    return [columns[e][s] for s in range(STATES) for e in range(STATES)]


def initial(role: Column) -> Column:
    return F.substr(role, F.lit(1), F.lit(1))


def runs(conversations: DataFrame) -> DataFrame:
    """Equal rows put together, with copies, fault and code."""
    row = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    counted = row.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies")).withColumn("_said", F.md5(F.concat("role", F.lit("\0"), "text")))
    # Texts that occur at several turns of a conversation: few, and one row each.
    again = counted.groupBy(F.col("conv_id").alias("_conv"), F.col("_said").alias("_again")).agg(F.min(F.struct("turn", "role", "text")).alias("_first"), F.count("*").alias("_times"))
    again = again.filter("_times > 1").select("_conv", "_again", F.col("_first.turn").alias("_first"))
    found = counted.join(again, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_said") == F.col("_again")), "left")
    body = F.rtrim("text", F.lit(WHITE))
    later = F.col("_again").isNotNull() & ~F.col("turn").eqNullSafe(F.col("_first"))
    fault = F.when(body == "", "blank").when(later, "duplicate").when(~F.right(body, F.lit(1)).isin(*MARKS), "truncated").otherwise("")
    kind = F.when(F.col("fault").isin("blank", "duplicate"), FORCED).when(F.col("fault") == "truncated", CUT_SHORT).otherwise(FINE)
    place = F.coalesce(F.array_position(F.array(*map(F.lit, INITIALS[:3])), initial(F.col("role"))), F.lit(0)).cast("int")
    code = kind * 4 + F.when(place == 0, 3).otherwise(place - 1)
    return found.withColumn("fault", fault).withColumn("code", code.cast("int")).select("conv_id", "turn", "role", "text", "copies", "fault", "code")


def fragments(batches, columns: list[str]):
    """(number of the partition, conv_id, record batches) of each run of equal conversations in rows sorted by place."""
    open_key, held = None, []
    for batch in batches:
        keys = list(zip(batch.column("part").to_pylist(), batch.column("conv_id").to_pylist(), strict=True))
        start = 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[start]:
                if held and keys[start] != open_key:
                    yield open_key, pa.Table.from_batches(held)
                    held = []
                open_key = keys[start]
                held.append(batch.select(columns).slice(start, i - start))
                start = i
    if held:
        yield open_key, pa.Table.from_batches(held)


def codes_of(rows: pa.Table) -> bytes:
    return bytes(rows.column("code").to_pylist())


def by_partition(placed: DataFrame) -> DataFrame:
    return placed.repartition("part").sortWithinPartitions("place")


def over_borders(placed: DataFrame) -> dict[tuple, tuple]:
    """{(part, conv_id): (state, end vector, whether rows follow, initial before)} of conversations in several partitions.

    Two a partition at most, as the partitions are ranges.
    """
    spark = placed.sparkSession
    ends = placed.groupBy("part").agg(F.min(F.struct("conv_id")).alias("a"), F.max(F.struct("conv_id")).alias("b"))
    both = ends.select("part", F.explode(F.array_distinct(F.array("a", "b"))).alias("c")).select("part", F.col("c.conv_id").alias("conv_id"))
    several = both.groupBy("conv_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("conv_id").alias("_conv"))
    parts = placed.select("part", "place", "conv_id", "code").join(F.broadcast(several), F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    parts = by_partition(parts)

    def sums(batches):
        for (part, conv), rows in fragments(batches, ["code"]):
            codes = codes_of(rows)
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "conv_id": pa.array([conv]).cast(conv_type), "m": pa.array([matrix(codes)], pa.list_(pa.int64())), "last": pa.array([codes[-1] & 3], pa.int32())})

    from pyspark.sql.pandas.types import to_arrow_type

    conv_type = to_arrow_type(placed.schema["conv_id"].dataType)
    conv_field = T.StructField("conv_id", placed.schema["conv_id"].dataType)
    schema = T.StructType([T.StructField("part", T.IntegerType()), conv_field, T.StructField("m", T.ArrayType(T.LongType())), T.StructField("last", T.IntegerType())])
    found: dict = {}
    for r in sorted(parts.mapInArrow(tidy(sums), schema).collect(), key=lambda r: r.part):
        found.setdefault(r.conv_id, []).append(r)
    ahead = {}
    for conv, each in found.items():
        end = END
        for r in reversed(each):
            ahead[r.part, conv] = end
            end, _ = normal([min(r.m[STATES * s + e] + end[e] for e in range(STATES)) for s in range(STATES)])
    if not ahead:
        return {}
    kept = spark.sparkContext.broadcast(ahead)

    def leaves(batches):
        for (part, conv), rows in fragments(batches, ["code"]):
            codes, to = codes_of(rows), []
            for s in range(STATES):
                for _, _, state, _ in repaired(codes, kept.value[part, conv], s):
                    pass
                to.append(state)
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "conv_id": pa.array([conv]).cast(conv_type), "to": pa.array([to], pa.list_(pa.int32()))})

    schema = T.StructType([T.StructField("part", T.IntegerType()), conv_field, T.StructField("to", T.ArrayType(T.IntegerType()))])
    moves = {(r.part, r.conv_id): r.to for r in parts.mapInArrow(tidy(leaves), schema).collect()}
    out = {}
    for conv, each in found.items():
        state, before = NOTHING, None
        for i, r in enumerate(each):
            out[r.part, conv] = (state, ahead[r.part, conv], i + 1 < len(each), before)
            state, before = moves[r.part, conv][state], r.last
    return out


def repair(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, table to discard after use): the distinct rows in order of ``place``, each with what the repair does there.

    fault is empty, blank, duplicate or truncated, that of the first of ``copies``; illegal counts the pairs of
    neighbours, ending in this row or its copies, whose initials are not su, ua or au; edits are the letters up to the
    row's own, a D for each further copy and, at a conversation's last row, what is inserted after it; cost is what they cost;
    after (array of role and text) are the turns that they leave.
    """
    order = ["conv_id", "turn", "role"]
    rows = runs(conversations).repartitionByRange(*order, F.substr("text", F.lit(1), F.lit(64))).sortWithinPartitions(*order, "text")
    placed = stored(rows.withColumn("place", F.monotonically_increasing_id()), "conversation-rows")
    placed = placed.withColumn("part", F.shiftright("place", 33).cast("int"))
    borders = placed.sparkSession.sparkContext.broadcast(over_borders(placed))
    fields = [f for f in placed.schema.fields if f.name not in ("part", "code")]
    names = [f.name for f in fields]
    new = T.StructType.fromDDL("illegal long, edits string, cost long, roles array<string>")

    def edited(batches):
        for key, table in fragments(batches, [*names, "code"]):
            codes, copies = codes_of(table), table.column("copies").to_pylist()
            state, end, follows, before = borders.value.get(key, (NOTHING, END, False, None))
            illegal, edits, costs, roles = [], [], [], []
            for code, n, (letters, said, state, cost) in zip(codes, copies, repaired(codes, end, state), strict=True):  # noqa: B007
                pair = None if before is None else (INITIALS[before], INITIALS[code & 3])
                illegal.append((pair is not None and pair not in LEGAL) + n - 1)
                edits.append(letters + "D" * (n - 1))
                costs.append(cost + DELETE * (n - 1))
                roles.append(list(said))
                before = code & 3
            if not follows:
                letters, said = at_the_end(state)
                edits[-1] += letters
                costs[-1] += INSERT * len(letters)
                roles[-1] += said
            made = [pa.array(illegal, pa.int64()), pa.array(edits, pa.string()), pa.array(costs, pa.int64()), pa.array(roles, pa.list_(pa.string()))]
            whole = table.select(names).combine_chunks()
            for name, values in zip(new.names, made, strict=True):
                whole = whole.append_column(name, values)
            yield from whole.to_batches(max_chunksize=1024)

    found = by_partition(placed).mapInArrow(tidy(edited), T.StructType([*fields, *new.fields]))
    kept = F.replace("edits", F.lit("D"), F.lit(""))
    turn = lambda r, i: F.struct(F.coalesce(r, "role").alias("role"), F.when(F.substr(kept, i + 1, F.lit(1)) == "I", "").otherwise(F.col("text")).alias("text"))
    return found.withColumn("after", F.transform("roles", turn)).drop("roles"), placed


def damaged(conversations: DataFrame) -> DataFrame:
    """The contract's damage, drawn from a checksum of conv_id and turn: a row is dropped, emptied, loses its marks, is repeated or says user."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    what = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), what.alias("what")).filter("what <> 0")
    text = F.when(F.col("what") == 1, "").when(F.col("what") == 2, F.translate("text", MARKS, "")).otherwise(F.col("text"))
    role = F.when(F.col("what") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.array_repeat(F.lit(0), F.when(F.col("what") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("time")).drop("time")


DIGESTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def digests(rows: DataFrame) -> DataFrame:
    """One row for each conversation of repair(): its rows pass in order, and only sums, letters and a running hash are held.

    The hash of a conversation has to see its texts one after the other, so this (and not the repair) takes one task for each.
    """
    import hashlib

    lines = F.transform("after", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    said = F.when(F.size("after") > 0, F.array_join(lines, "\n"))
    narrow = rows.select("conv_id", "place", "turn", "fault", "copies", "illegal", "cost", "edits", said.alias("said"))
    field = rows.schema["conv_id"]
    new = T.StructType.fromDDL(DIGESTS)

    def finished(conv, k, edits, digest, turns):
        gaps = turns[1] - turns[0] + 1 - turns[2] if turns else 0
        return (conv, gaps, k["blank"], k["duplicate"], k["truncated"], k["illegal"], k["cost"], "".join(edits), digest.hexdigest())

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        types = [to_arrow_type(f.dataType) for f in [field, *new.fields]]
        names = [field.name, *new.names]
        begun, conv, out = False, None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key, _, turn, fault, copies, illegal, cost, letters, text = row
                if not begun or key != conv:
                    if begun:
                        out.append(finished(conv, counts, edits, digest, turns))
                    begun, conv, turns, edits, digest, empty = True, key, None, [], hashlib.sha256(), True
                    counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost"), 0)
                counts["illegal"] += illegal
                counts["cost"] += cost
                if fault == "blank":
                    counts["blank"] += copies
                else:
                    counts["duplicate"] += copies - 1
                    if fault:
                        counts[fault] += 1
                edits.append(letters)
                if text is not None:
                    digest.update((text if empty else "\n" + text).encode())
                    empty = False
                if turn is not None:
                    turns = (turn, turn, 1) if turns is None else (turns[0], turn, turns[2] + (turn != turns[1]))
            if len(out) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                out = []
        if begun:
            out.append(finished(conv, counts, edits, digest, turns))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return narrow.repartition("conv_id").sortWithinPartitions("conv_id", "place").mapInArrow(tidy(run), T.StructType([field, *new.fields]))


def query(spark, sf_dir: str) -> DataFrame:
    """op11: faults, cheapest edits and digests of every conversation of ``conversations`` after the damage."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    found, placed = repair(damaged(rows))
    found = stored(digests(found), "conversation-digests").withColumnRenamed("conv_id", "_conv")
    discard(placed)
    every = rows.groupBy("conv_id").agg(F.count("*").alias("_n")).join(found, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    none = {"audit": "", "repaired_sha256": "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"}
    return every.select("conv_id", *(F.coalesce(F.col(f.name), F.lit(none.get(f.name, 0)).cast(f.dataType)).alias(f.name) for f in T.StructType.fromDDL(DIGESTS).fields))
