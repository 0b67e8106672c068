"""Repair of conversation structure: the cheapest edits as a shortest path whose scalar weights carry cost and audit."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .tables import written

WHITE = " \t\n\x0b\f\r"
EMPTY_HASH = hashlib.sha256(b"").hexdigest()

#: What the rows so far end in: nothing, a system row, a user row, an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
FOLLOWS = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # the role that an inserted or changed row gets
KEEPS = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
ROLE = {USER: "user", ASSISTANT: "assistant"}

LETTERS = " DIKR"  # a letter's digit is its place, so that digits compare as letters do; 0 pads the end
BITS = 3  # of a digit
INSERTS = 2  # before a row; a third one leads back to where one has been
SEGMENT = 256  # rows whose letters one integer holds


def damaged(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, present): rows with faults planted by crc32 of ``conv_id:turn``, modulo 20.

    0 drops a row (``present`` is false), 1 empties its text, 2 removes the ends of its sentences, 3 repeats it, 4 makes it a
    user's. A null role or text is one space, as is a null id or turn within the key.
    """
    def spaced(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(spaced(conv_id), F.lit(":"), spaced(turn)).cast("binary")) % 20
    new_text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(spaced(text), "[.!?]", "")).otherwise(spaced(text))
    rows = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.when(kind == 4, "user").otherwise(spaced(role)).alias("role"),
                        new_text.alias("text"), (kind != 0).alias("present"), F.when(kind == 3, 2).otherwise(1).alias("times"))
    return rows.withColumn("times", F.explode(F.sequence(F.lit(1), "times"))).drop("times")


def faults(turns: DataFrame, present: Column | None = None, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
           text: str = "text") -> DataFrame:
    """(conv_id, present, turn, role, text, at, fault, illegal, another): the rows of each conversation numbered from 1, with what is wrong.

    Order: by turn, nulls first; rows of one turn by role and text, so that equal rows are neighbours. ``fault`` is the first of
    ``blank`` (white space only), ``duplicate`` (role and text seen earlier) and ``truncated`` (doesn't end in ``.``, ``!`` or ``?``).
    ``illegal``: the role may not follow the one before. ``another``: the first row of its turn. A null role or text is one space.
    Rows for which ``present`` is false only make sure that their conversation is listed.

    One shuffle by conversation. The windows number and look back only, so that a conversation of any length spills instead
    of being held.
    """
    rows = turns.select(F.col(conv_id).alias("conv_id"), (F.lit(True) if present is None else present).alias("present"), F.col(turn).cast("long").alias("turn"),
                        *[F.coalesce(F.col(name).cast("string"), F.lit(" ")).alias(new) for name, new in ((role, "role"), (text, "text"))])
    by_turn = F.col("turn").asc_nulls_first()
    same = Window.partitionBy("conv_id", "present", "role", "text").orderBy(by_turn)
    order = Window.partitionBy("conv_id", "present").orderBy(by_turn, "role", "text", "seen")
    rows = rows.repartition("conv_id").withColumn("seen", F.row_number().over(same))
    rows = rows.withColumn("at", F.row_number().over(order)).withColumn("before", F.lag(F.struct("role", "turn")).over(order))
    said = F.rtrim("text", F.lit(WHITE))
    fault = F.when(said == "", "blank").when(F.col("seen") > 1, "duplicate").when(~F.right(said, F.lit(1)).isin(".", "!", "?"), "truncated")
    pair = F.concat(F.left("before.role", F.lit(1)), F.left("role", F.lit(1)))
    illegal = F.col("before").isNotNull() & ~pair.isin("su", "ua", "au")
    another = F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.col("before.turn"))
    return rows.select("conv_id", "present", "turn", "role", "text", "at", fault.alias("fault"), illegal.alias("illegal"), another.alias("another"))


def best_paths(rows: list[tuple[str, str | None]], start: int) -> dict[int, tuple[int, str]]:
    """{end: (cost, letters)}: the cheapest edits of ``rows`` (initial of the role, fault) that lead from ``start`` to each end.

    Each path has one integer: its cost in the high digits, then its letters from the left at a fixed width, then zeros. The least
    integer is the cheapest path, and of equally cheap ones that with the least letters. The letters that follow a node
    decide the node that is reached, so no two paths to a node have letters of which one begins with the other, and
    the least integer so far remains the least whatever comes after.
    """
    width = (1 + INSERTS) * len(rows)

    def relax(nodes: dict, end: int, path: tuple[int, int], letter: str, cost: int) -> None:
        weight, length = path
        weight += (cost << BITS * width) + (LETTERS.index(letter) << BITS * (width - 1 - length))
        if end not in nodes or weight < nodes[end][0]:
            nodes[end] = weight, length + 1

    nodes = {start: (0, 0)}
    for initial, fault in rows:
        for _ in range(INSERTS):
            for state, path in list(nodes.items()):
                relax(nodes, FOLLOWS[state], path, "I", 2)
        after: dict[int, tuple[int, int]] = {}
        for state, path in nodes.items():
            relax(after, state, path, "D", 3)
            if fault not in ("blank", "duplicate"):
                extra = int(fault == "truncated")
                relax(after, FOLLOWS[state], path, "R", 2 + extra)
                if (initial, state) in KEEPS:
                    relax(after, KEEPS[initial, state], path, "K", extra)
        nodes = after
    low, names = (1 << BITS * width) - 1, str.maketrans("01234", LETTERS)
    return {end: (weight >> BITS * width, f"{weight & low:0{width}o}"[:length].translate(names)) for end, (weight, length) in nodes.items()}


def cheapest(rows: Iterable[tuple[str, str | None]]) -> tuple[int, str]:
    """(cost, audit) of a whole conversation, in time linear in its rows.

    Its segments are solved from every state they may start in, then put together from the end by their costs.
    """
    segments: list[dict[int, dict[int, tuple[int, str]]]] = []
    held: list[tuple[str, str | None]] = []

    def solve() -> None:
        segments.append({start: best_paths(held, start) for start in (FOLLOWS if segments else (START,))})
        held.clear()

    for row in rows:
        held.append(row)
        if len(held) == SEGMENT:
            solve()
    if held:
        solve()
    rest = {START: (0, ""), SYSTEM: (4, "II"), USER: (2, "I"), ASSISTANT: (0, "")}  # the end: complete rows only
    chosen: list[dict[int, tuple[str, int | None]]] = [{state: (letters, None) for state, (_, letters) in rest.items()}]
    costs = {state: cost for state, (cost, _) in rest.items()}
    for paths in reversed(segments):
        best = {start: min((cost + costs[end], letters, end) for end, (cost, letters) in ends.items()) for start, ends in paths.items()}
        costs = {start: cost for start, (cost, _, _) in best.items()}
        chosen.append({start: (letters, end) for start, (_, letters, end) in best.items()})
    total, audit, state = costs[START], [], START
    for choice in reversed(chosen):
        letters, state = choice[state]
        audit.append(letters)
    return total, "".join(audit)


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns)))


def _sent(rows: Iterable[tuple], schema: pa.Schema, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as batches of about ``size`` bytes, or of one row that is larger."""
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += 64 + sum(len(x) for x in row if isinstance(x, str))
        if weight >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _in_order(rows: DataFrame, solve, columns: str) -> DataFrame:
    """``solve`` over the rows of each partition as tuples, those of one conversation one after another by ``at``; its tuples are the result."""
    schema = StructType([rows.schema["conv_id"], *StructType.fromDDL(columns)])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _sent(solve(_streamed(batches)), arrow)

    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "at").mapInArrow(run, schema)


def plans(faulty: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of every conversation of ``faults``.

    ``gaps``: turns missing between the first and the last. ``audit``: the initials of the cheapest edits in order, of equally cheap
    ones the least. Keep costs 0, Rerole to user or assistant 2, Delete 3 (the only choice for blank and duplicate rows), Insert of an empty
    row of user or assistant 2, a truncated row that stays 1 more; what remains is ``(s?(ua)+)?`` by initials of roles.
    Counts are grouped before they are shuffled. The audit of a conversation is solved in one task, which holds a few letters a row.
    """
    def solve(rows: Iterator[tuple]) -> Iterator[tuple]:
        for key, own in groupby(rows, key=lambda row: row[0]):
            yield key, *cheapest((initial, fault) for _, _, present, initial, fault in own if present)

    solved = _in_order(faulty.select("conv_id", "at", "present", F.left("role", F.lit(1)).alias("initial"), "fault"), solve, "cost long, audit string")

    def number(condition: Column) -> Column:
        return F.count(F.when(F.col("present") & condition, 1))

    turn = F.when(F.col("present"), F.col("turn"))
    counted = faulty.groupBy("conv_id").agg(
        F.coalesce(F.max(turn) - F.min(turn) + 1 - number(F.col("another")), F.lit(0)).cast("long").alias("gaps"),
        *[number(F.col("fault") == name).alias(name) for name in ("blank", "duplicate", "truncated")], number(F.col("illegal")).alias("illegal"))
    return counted.join(solved, counted["conv_id"].eqNullSafe(solved["conv_id"])).drop(solved["conv_id"])


def repaired(faulty: DataFrame, solved: DataFrame) -> DataFrame:
    """(conv_id, turn, edit, role, text): the rows of each repaired conversation, renumbered from 0; each was kept (K), got another role (R) or
    was put in (I).

    The rows of a conversation come in order, one after another in one partition. Its audit goes before them, so a task holds an
    audit and a row at a time, however long the conversation is.
    """
    def apply(rows: Iterator[tuple]) -> Iterator[tuple]:
        for key, own in groupby(rows, key=lambda row: row[0]):
            audit, state, turn = next(own)[3], START, 0
            for letter in audit:
                role, text = (None, "") if letter == "I" else next(own)[2:]
                if letter == "D":
                    continue
                state = KEEPS[role[:1], state] if letter == "K" else FOLLOWS[state]
                yield key, turn, letter, role if letter == "K" else ROLE[state], text
                turn += 1

    audits = solved.select("conv_id", F.lit(0).alias("at"), F.lit(None).cast("string").alias("role"), F.col("audit").alias("text"))
    both = audits.unionByName(faulty.where("present").select("conv_id", "at", "role", "text"))
    return _in_order(both, apply, "turn long, edit string, role string, text string")


def hashes(turns: DataFrame) -> DataFrame:
    """(conv_id, sha256) of the rows of ``repaired`` as ``role:text``, joined by line feeds; conversations without rows are not listed."""
    def digest(rows: Iterator[tuple]) -> Iterator[tuple]:
        for key, own in groupby(rows, key=lambda row: row[0]):
            whole = hashlib.sha256()
            for _, turn, role, text in own:
                whole.update(("\n" * (turn > 0) + f"{role}:{text}").encode("utf-8", "surrogatepass"))
            yield key, whole.hexdigest()

    schema = StructType([turns.schema["conv_id"], *StructType.fromDDL("sha256 string")])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _sent(digest(_streamed(batches)), arrow)

    return turns.select("conv_id", "turn", "role", "text").mapInArrow(run, schema)


def repair_summary(turns: DataFrame, present: Column | None = None) -> DataFrame:
    """One row of every conversation: ``plans`` and ``repaired_sha256``, the hash of the repaired rows (of the empty string, where none is left)."""
    faulty = written(faults(turns, present), "faulty")
    solved = written(plans(faulty), "plans")
    hashed = hashes(repaired(faulty, solved))
    both = solved.join(hashed, solved["conv_id"].eqNullSafe(hashed["conv_id"]), "left").drop(hashed["conv_id"])
    return both.select(*solved.columns, F.coalesce("sha256", F.lit(EMPTY_HASH)).alias("repaired_sha256"))
