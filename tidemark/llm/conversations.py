"""Cheapest repair of conversations whose turns are damaged, by the optimal arcs of a graph.

A repaired conversation's roles begin with at most one system turn and then
alternate user and assistant, ending with assistant; or nothing is left. A node
of the graph is a place between two rows together with a state of the automaton
for such sequences; an arc is an edit: K keeps a row, R gives it the other role
that fits, D deletes it, I inserts an empty turn. With the least costs from the
front to each node and from each node to the end, the arcs that lie on a
cheapest path are those where cost so far, the arc's cost and cost to come add up
to the total. From the first node on, the least letter among such arcs out of
the frontier's nodes is taken, and the frontier moves along all arcs with that
letter. That spells the least of all cheapest repairs.

An edit's costs are sums, so the costs across a run of rows are a matrix over the
states, and matrices combine by minimum and sum in any grouping. Rows are put in
order by range partitions and cut into blocks of at most BLOCK rows; blocks of a
long conversation combine over levels of FAN, so no task ever holds more than a
block of rows or FAN matrices, however many rows a conversation has. The states
at the blocks' fronts are found by a second such pass.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from ..staging import with_place
from .common import sized, stage, table, unstage

BLOCK, FAN = 2048, 1024
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: States: nothing yet, after system, after user, after assistant; the sequence may end in the first and the last.
STATES, ENDS = 4, (0, 3)
NEXT = (2, 2, 3, 2)  # the state after the turn that inserting or reroling makes
ROLE = ("user", "user", "assistant", "user")  # and that turn's role
NEVER = 1 << 40
FAULTS = ("", "blank", "duplicate", "truncated")
WHITE = " \t\n\x0b\x0c\r"
LEGAL = {(0, 1), (1, 2), (2, 1)}  # initials by their places in "sua"


# --- arcs --------------------------------------------------------------------------------------------------------------


def _row_arcs(code: int, state: int) -> list[tuple[str, int, int]]:
    """Arcs (letter, cost, next state) past a row; code is 4 * initial (0 to 2 in "sua", 3: another) + fault."""
    initial, fault = divmod(code, 4)
    arcs = [("D", DELETE, state)]
    if fault not in (1, 2):
        more = TRUNCATED if fault == 3 else 0
        if initial == 0 and state == 0:
            arcs.append(("K", KEEP + more, 1))
        elif initial in (1, 2) and NEXT[state] == initial + 1:
            arcs.append(("K", KEEP + more, NEXT[state]))
        arcs.append(("R", REROLE + more, NEXT[state]))
    return arcs


ARCS = [[_row_arcs(code, q) for q in range(STATES)] for code in range(16)]


def _with_inserts(costs: list[int]) -> list[int]:
    """Least costs from the front after inserts at the same place (two at most help)."""
    out = list(costs)
    for _ in range(2):
        for q in range(STATES):
            out[NEXT[q]] = min(out[NEXT[q]], out[q] + INSERT)
    return out


def _before_inserts(costs: list[int]) -> list[int]:
    """Least costs to the end before inserts at the same place."""
    out = list(costs)
    for _ in range(2):
        for q in range(STATES):
            out[q] = min(out[q], out[NEXT[q]] + INSERT)
    return out


def forward(codes: list[int], start: list[int]) -> list[list[int]]:
    """Least costs from the front to each place's states, inserts there included; one list more than rows."""
    out = [_with_inserts(start)]
    for code in codes:
        here, after = out[-1], [NEVER] * STATES
        for q in range(STATES):
            for _, cost, to in ARCS[code][q]:
                after[to] = min(after[to], here[q] + cost)
        out.append(_with_inserts(after))
    return out


def backward(codes: list[int], rest: list[int]) -> list[list[int]]:
    """Least costs from each place's states to the end, inserts there included."""
    out = [_before_inserts(rest)]
    for code in reversed(codes):
        out.append(_before_inserts([min(cost + out[-1][to] for _, cost, to in ARCS[code][q]) for q in range(STATES)]))
    return out[::-1]


def traverse(codes: list[int], start: list[int], rest: list[int], frontier: set[int], last: bool) -> tuple[list[tuple[list[str], str, str | None]], list[str], set[int], int]:
    """Edits of the rows (roles inserted before, letter, role if it is made anew), roles inserted at the end, the frontier after, the total cost.

    Inserts behind the rows are made only if these are the conversation's last:
    else they belong to the next rows' front.
    """
    ahead, behind = forward(codes, start), backward(codes, rest)
    total = min(a + b for a, b in zip(ahead[0], behind[0], strict=True))
    edits, inserted, at = [], [], 0
    while True:
        arcs = [(("I", INSERT, NEXT[q]), q, at) for q in frontier] if at < len(codes) or last else []
        if at < len(codes):
            arcs += [(arc, q, at + 1) for q in frontier for arc in ARCS[codes[at]][q]]
        tight = [(letter, q, to) for (letter, cost, to), q, place in arcs if ahead[at][q] + cost + behind[place][to] == total]
        if not tight:
            return edits, inserted, frontier, total
        least = min(letter for letter, _, _ in tight)
        q = min(q for letter, q, _ in tight if letter == least)
        frontier = {to for letter, _, to in tight if letter == least}
        if least == "I":
            inserted.append(ROLE[q])
        else:
            edits.append((inserted, least, ROLE[q] if least == "R" else None))
            inserted, at = [], at + 1


# --- blocks and levels ---------------------------------------------------------------------------------------------------

LONGS = T.ArrayType(T.LongType())


def _mapped(rows: DataFrame, fields: list[T.StructField], work: Callable) -> DataFrame:
    """rows without their payload, with the fields that work makes of each row (a dict)."""
    gone = {"codes", "children", "entry", "state", "final"}
    keep = [c for c in rows.columns if c not in gone | {f.name for f in fields}]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        for batch in batches:
            made = [work(row) for row in batch.to_pylist()]
            columns = [pa.array([m[i] for m in made], to_arrow_type(f.dataType)) for i, f in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *columns], names=[*keep, *names])

    return rows.mapInArrow(run, T.StructType([*(rows.schema[c] for c in keep), *fields]))


def _code_list(codes: str) -> list[int]:
    return [ord(c) - 65 for c in codes]


def _matrix(codes: list[int]) -> list[int]:
    """Costs from each state at the front to each behind the rows (inserts behind them not counted twice), and the last row's initial."""
    rows = [forward(codes, [0 if q == p else NEVER for p in range(STATES)])[-1] for q in range(STATES)]
    return [*(x for r in rows for x in r), codes[-1] // 4]


def _times(left: list[int], right: list[int]) -> list[int]:
    n = range(STATES)
    return [*(min(NEVER, *(left[4 * i + k] + right[4 * k + j] for k in n)) for i in n for j in n), right[16]]


def _all(values: list[list[int]], join: Callable) -> list[int]:
    out = values[0]
    for v in values[1:]:
        out = join(out, v)
    return out


def _cost_entries(entry: list[int], values: list[list[int]]) -> list[list[int]]:
    """For each child: costs from the front to its front, from its end to the end, and the initial before it."""
    n, start, before = range(STATES), entry[:4], entry[8]
    starts = []
    for v in values:
        starts.append((start, before))
        start, before = [min(NEVER, *(start[k] + v[4 * k + j] for k in n)) for j in n], v[16]
    rest, out = entry[4:8], []
    for (start, before), v in zip(reversed(starts), reversed(values), strict=True):
        out.append([*start, *rest, before])
        rest = [min(NEVER, *(v[4 * i + k] + rest[k] for k in n)) for i in n]
    return out[::-1]


def _state_entries(entry: list[int], values: list[list[int]]) -> list[list[int]]:
    out = [entry]
    for v in values[:-1]:
        out.append([v[out[-1][0]]])
    return out


def _swept(items: DataFrame, join: Callable, entries: Callable, first: list[int]) -> DataFrame:
    """conv, block, entry of every item (conv, block, value): what `entries` hands down from `first`.

    Values of a conversation combine over levels of FAN upwards until one is
    left, and entries go down the same levels.
    """
    levels = [stage(items, "repair-level")]
    value = T.StructField("value", LONGS)
    while levels[-1].groupBy("conv").count().where("count > 1").limit(1).count():
        grouped = levels[-1].groupBy("conv", F.floor(F.col("block") / FAN).alias("block")).agg(F.sort_array(F.collect_list(F.struct("block", "value"))).alias("children"))
        levels.append(stage(_mapped(grouped, [value], lambda r: (_all([c["value"] for c in r["children"]], join),)), "repair-level"))
    out = levels[-1].select("conv", "block", F.array(*(F.lit(x).cast("long") for x in first)).alias("entry"))
    handed = T.StructField("handed", T.ArrayType(LONGS))
    for below in reversed(levels[:-1]):
        above = out.select("conv", F.col("block").alias("up"), "entry")
        grouped = below.groupBy("conv", F.floor(F.col("block") / FAN).alias("up")).agg(F.sort_array(F.collect_list(F.struct("block", "value"))).alias("children"))
        met = grouped.join(above, ["conv", "up"]).withColumn("blocks", F.expr("transform(children, c -> c.block)"))
        each = _mapped(met, [handed], lambda r: (entries(r["entry"], [c["value"] for c in r["children"]]),))
        out = stage(each.select("conv", F.explode(F.arrays_zip("blocks", "handed")).alias("x")).select("conv", F.col("x.blocks").alias("block"), F.col("x.handed").alias("entry")), "repair-entries")
    unstage(*(levels if len(levels) > 1 else []))
    return out


START, REST = [0, NEVER, NEVER, NEVER], _before_inserts([0 if q in ENDS else NEVER for q in range(STATES)])
FIRST = [*START, *REST, -1]


def _block_map(row: dict) -> tuple[list[int]]:
    """For each state at the block's front, the one behind it (itself if no cheapest path meets it)."""
    codes, entry = _code_list(row["codes"]), row["entry"]
    start, rest = entry[:4], entry[4:8]
    ahead, behind = _with_inserts(start), backward(codes, rest)[0]
    total = min(a + b for a, b in zip(ahead, behind, strict=True))
    out = []
    for q in range(STATES):
        met = start[q] + behind[q] == total
        out.append(min(traverse(codes, start, rest, {q}, False)[2]) if met else q)
    return (out,)


EDITS = T.ArrayType(T.StructType([T.StructField("before", T.ArrayType(T.StringType())), T.StructField("letter", T.StringType()), T.StructField("role", T.StringType()), T.StructField("after", T.ArrayType(T.StringType()))]))


def _block_edits(row: dict) -> tuple:
    codes, entry = _code_list(row["codes"]), row["entry"] or FIRST
    edits, behind, _, total = traverse(codes, entry[:4], entry[4:8], {row["state"] or 0}, row["final"])
    letters = "".join("I" * len(before) + letter for before, letter, _ in edits) + "I" * len(behind)
    initials = [entry[8], *(c // 4 for c in codes)] if entry[8] >= 0 else [c // 4 for c in codes]
    illegal = sum(p not in LEGAL for p in zip(initials, initials[1:], strict=False))
    made = [{"before": b, "letter": x, "role": r, "after": behind if i == len(edits) - 1 else []} for i, (b, x, r) in enumerate(edits)]
    return made, letters, illegal, total


def plan(rows: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Rows in order with their edits, and each conversation's facts.

    First: conv (a key that is never null), place, role, text, fault, letter,
    new_role (null: as it is), before and after (roles of turns to insert).
    Second: conv, conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit.

    Null roles and texts are one space; a null conversation is one of its own.
    Rows go by turn, nulls first, then by role and text, so ties and repeated
    rows have one order. A row's first fault counts: blank, duplicate (role and
    text came before in the conversation), truncated. Further columns of `rows`
    are not read; an empty table gives empty results.
    """
    ship(rows.sparkSession)
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    tidy = rows.select(F.coalesce(F.concat(F.lit("="), F.col(conv_col).cast("string")), F.lit("")).alias("conv"), F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), space(role_col).alias("role"), space(text_col).alias("text"))
    placed, _ = with_place(tidy, ["conv", "turn", "role", "text"])
    said = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    ends = F.rtrim("text", F.lit(WHITE))
    firsts = placed.groupBy("conv", said.alias("said")).agg(F.min("place").alias("first")).select("first")
    light = placed.select("conv", "conv_id", "turn", "place", F.substring("role", 1, 1).alias("initial"), (ends == "").alias("is_blank"), (~F.right(ends, F.lit(1)).isin(".", "!", "?")).alias("is_cut"))
    met = light.join(firsts, F.col("place") == F.col("first"), "left")
    fault = F.when(F.col("is_blank"), 1).when(F.col("first").isNull(), 2).when(F.col("is_cut"), 3).otherwise(0)
    initial = F.when(F.col("initial") == "s", 0).when(F.col("initial") == "u", 1).when(F.col("initial") == "a", 2).otherwise(3)
    coded = stage(met.select("conv", "conv_id", "turn", "place", fault.alias("fault"), (4 * initial + fault).alias("code")), "repair-rows")

    count = lambda k: F.sum((F.col("fault") == k).cast("long"))
    span = F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn")
    facts = coded.groupBy("conv").agg(F.first("conv_id").alias("conv_id"), F.coalesce(span, F.lit(0)).alias("gaps"), *(count(k).alias(name) for k, name in enumerate(FAULTS) if name))

    block = F.floor(F.col("place") / BLOCK)
    letters = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "code"))), lambda x: F.char(x["code"] + 65)), "")
    blocks = stage(coded.groupBy("conv", block.alias("block")).agg(F.min("place").alias("base"), letters.alias("codes")), "repair-blocks")
    long = blocks.groupBy("conv").agg(F.count("*").alias("n"), F.max("block").alias("end")).where("n > 1").select("conv", "end")
    many = stage(blocks.join(long, "conv").select("conv", "block", "codes", "end"), "repair-long")
    value = T.StructField("value", LONGS)
    entries = _swept(_mapped(many.select("conv", "block", "codes"), [value], lambda r: (_matrix(_code_list(r["codes"])),)), _times, _cost_entries, FIRST)
    known = many.join(entries, ["conv", "block"])
    states = _swept(_mapped(known.select("conv", "block", "codes", "entry"), [value], _block_map), lambda a, b: [b[x] for x in a], _state_entries, [0])
    known = known.select("conv", "block", "entry", "end").join(states.select("conv", "block", F.col("entry")[0].cast("int").alias("state")), ["conv", "block"])
    ready = blocks.join(sized(stage(known, "repair-known")), ["conv", "block"], "left").withColumn("final", F.coalesce(F.col("block") == F.col("end"), F.lit(True))).drop("end")
    fields = [T.StructField("edits", EDITS), T.StructField("letters", T.StringType()), T.StructField("illegal", T.LongType()), T.StructField("cost", T.LongType())]
    done = stage(_mapped(ready, fields, _block_edits), "repair-edits")

    told = done.groupBy("conv").agg(F.sum("illegal").alias("illegal"), F.max("cost").alias("cost"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "letters"))), lambda x: x["letters"]), "").alias("audit"))
    each = done.select(F.col("base"), F.posexplode("edits").alias("i", "e")).select((F.col("base") + F.col("i")).alias("place"), "e.letter", F.col("e.role").alias("new_role"), "e.before", "e.after")
    edits = placed.select("conv", "place", "role", "text").join(each, "place")
    return edits, facts.join(told, "conv")


def repaired(edits: DataFrame) -> DataFrame:
    """Turns after the repair: conv, place, role, text; inserted turns share the place of the row that they stand beside, `step` orders them."""
    empty = lambda c: F.transform(c, lambda r: F.struct(r.alias("role"), F.lit("").alias("text")))
    own = F.when(F.col("letter") != "D", F.array(F.struct(F.coalesce("new_role", "role").alias("role"), "text"))).otherwise(F.array().cast("array<struct<role:string,text:string>>"))
    turns = F.concat(empty("before"), own, empty("after"))
    return edits.select("conv", "place", F.posexplode(turns).alias("step", "x")).select("conv", "place", "step", "x.role", "x.text")


def digests(turns: DataFrame) -> DataFrame:
    """conv, repaired_sha256 of each conversation's `role:text`, joined by newlines.

    SHA-256 has to read a conversation from front to end: its turns pass sorted
    through one task, an Arrow batch at a time, so that no task holds a
    conversation.
    """
    line = F.concat("role", F.lit(":"), "text").alias("line")
    ordered = turns.select("conv", "place", "step", line).repartition("conv").sortWithinPartitions("conv", "place", "step").select("conv", "line")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            convs, hashes = [], []
            for conv, text in zip(batch.column("conv").to_pylist(), batch.column("line").to_pylist(), strict=True):
                if conv == now:
                    state.update(b"\n")
                else:
                    if state is not None:
                        convs.append(now)
                        hashes.append(state.hexdigest())
                    now, state = conv, hashlib.sha256()
                state.update(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array(convs, pa.string()), pa.array(hashes, pa.string())], names=["conv", "repaired_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([state.hexdigest()])], names=["conv", "repaired_sha256"])

    return ordered.mapInArrow(run, "conv string, repaired_sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with damage that a checksum of conversation and turn decides: rows lost, emptied, cut, repeated, or given to the user."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    case = F.crc32(key.cast("binary")) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    text = F.when(case == 1, F.lit("")).when(case == 2, F.translate(text, ".!?", "")).otherwise(text)
    role = F.when(case == 4, F.lit("user")).otherwise(role)
    times = F.array_repeat(F.lit(0), F.when(case == 3, 2).otherwise(1))
    return rows.where(case != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("__copy")).drop("__copy")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation's facts, cheapest repair and digest of what it gives, after the damage; one that lost all rows has zeros."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    edits, facts = plan(damaged(rows))
    found = facts.join(digests(repaired(edits)), "conv", "left").drop("conv")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    every = rows.select(F.col("conv_id").alias("__id")).distinct()
    out = every.join(found, F.col("__id").eqNullSafe(F.col("conv_id")), "left")
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return out.select(F.col("__id").alias("conv_id"), *(F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in numbers), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))
