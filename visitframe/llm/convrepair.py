"""Repair of the role order of conversations, as cheapest edits found by auction.

A conversation is well formed if the initials of its roles read ``(s?(ua)+)?``.
Its rows are edited in order: Keep costs 0, Rerole (to user or assistant) 2,
Delete 3, and Insert (an empty user or assistant row, before any row or at the
end) 2. Blank and duplicate rows must go; a truncated row that stays adds 1.

**Lattice.** Node (i, s): rows before ``i`` are edited, the kept roles left the
automaton in state ``s`` (nothing yet, system, user, assistant). Delete, Keep
and Rerole lead to layer i + 1, Insert to another state of layer i.

**Auction.** Node prices p never exceed the cost to the end, as p(x) <= c(x, y)
+ p(y) holds on every arc and with equality on the path. The path's last node
either raises its price to the best of its arcs (*contraction*: it leaves the
path) or, if an arc is tight, the path goes on over it (*extension*). Prices
are integers, cycles have positive cost. Every node is an origin once, from
the last layer back, and prices stay from one origin to the next; so a path
ends as soon as it reaches a layer that has converged. At the end all prices
are exact duals, the tight arcs are the optimal ones, and following the
ASCII-least tight letter (Delete, Insert, Keep, Rerole) gives the least audit.

**Long conversations.** Rows are range-partitioned in order, whatever the
conversation, and cut into blocks of ``BLOCK_ROWS``. Of a conversation of
several blocks each block's costs between states are found first (one auction
for each exit state); a stream over the blocks, last first, gives the prices
at each block's end; blocks are solved with these prices for every entry
state, all in parallel; a second stream, first block first, picks the entry.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from visitframe.llm.common import written

BLOCK_ROWS = 64
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
ROLE_OF = {2: "user", 3: "assistant"}
#: The states nothing, system, user, assistant: what Insert and Rerole lead to, and Keep by initial.
FILL = (2, 2, 3, 2)
KEEP = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
INITIALS = "sua"  # codes 0 to 2; 3 is any other
#: Cost from each state to the end by inserts alone, and their number.
END = (0, 4, 2, 0)
NEVER = 1 << 40


def _arcs(initial: int, fault: int, state: int) -> list[tuple[str, bool, int, int]]:
    """(letter, stays in its layer, state, cost) in ASCII order of letters."""
    out = [("D", False, state, 3), ("I", True, FILL[state], 2)]
    if fault not in (BLANK, DUPLICATE):
        extra = 1 if fault == TRUNCATED else 0
        kept = KEEP[state].get(INITIALS[initial]) if initial < 3 else None
        if kept is not None:
            out.append(("K", False, kept, extra))
        out.append(("R", False, FILL[state], 2 + extra))
    return out


#: By row code (4 * initial + fault) and state.
ARCS = [[_arcs(code >> 2, code & 3, s) for s in range(4)] for code in range(16)]


def auction(codes: bytes, end: list[int], usable: tuple[int, ...] = (2, 3, 1, 0)) -> list[list[int]]:
    """Exact prices of all nodes, given those of the last layer.

    ``usable``: the states from which the end can be reached at all.
    """
    prices = [list(end)]
    for code in reversed(codes):
        later = prices[-1]
        # The least price of the next layer is a price that no arc forbids.
        now = [NEVER] * 4
        for s in usable:
            now[s] = min(later)
        prices.append(now)
        arcs = ARCS[code]
        for origin in usable:
            path = [origin]
            while path:
                s = path[-1]
                best, inside, to = NEVER, False, s
                for _, stays, target, cost in arcs[s]:
                    value = cost + (now if stays else later)[target]
                    if value < best:
                        best, inside, to = value, stays, target
                if now[s] < best:
                    now[s] = best
                    if len(path) > 1 or best >= NEVER:
                        path.pop()
                elif inside:
                    path.append(to)
                else:
                    break
    prices.reverse()
    return prices


def trace(codes: bytes, prices: list[list[int]], state: int) -> tuple[list[str], int]:
    """Per row its letters, with the role behind Insert and Rerole, and the state at the end."""
    pieces = []
    for i, code in enumerate(codes):
        piece, inside = [], True
        while inside:
            here = prices[i][state]
            for letter, inside, target, cost in ARCS[code][state]:
                if cost + prices[i if inside else i + 1][target] == here:
                    break
            state = target
            piece.append(letter + (ROLE_OF[state][0] if letter in "IR" else ""))
        pieces.append("".join(piece))
    return pieces, state


def finish(pieces: list[str], state: int) -> None:
    """Add the inserts that a conversation needs behind its last row."""
    while state in (1, 2):
        state = FILL[state]
        pieces[-1] += "I" + ROLE_OF[state][0]


def between(codes: bytes) -> list[list[int]]:
    """Costs from each entry state to each exit state of a block."""
    out = [[NEVER] * 4 for _ in range(4)]
    for exit_state, usable in ((0, (0,)), (1, (1, 0)), (2, (2, 3, 1, 0)), (3, (2, 3, 1, 0))):
        end = [NEVER] * 4
        end[exit_state] = 0
        for s, cost in enumerate(auction(codes, end, usable)[0]):
            out[s][exit_state] = min(cost, NEVER)
    return out


# --- rows and blocks ---------------------------------------------------------------

def _fault(text: str, key: bytes, seen: set[bytes]) -> int:
    bare = text.rstrip(SPACE)
    if not bare:
        return BLANK
    if key in seen:
        return DUPLICATE
    seen.add(key)
    return 0 if bare[-1] in ".!?" else TRUNCATED


def _line_up():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seen: set[bytes] = set()
        conv, started = None, False
        block = rows = at = -1
        own: dict[int, list[bool]] = {}  # of the open and the latest blocks: surely first, surely last
        held, lists = None, ([], [], [])

        def out(batch, end):
            """Rows before ``end`` leave, with what is known of their blocks."""
            places, blocks, codes = (x[:end] for x in lists)
            alone = [all(own[b]) for b in blocks]
            columns = [
                pa.array([part] * end, pa.int32()), pa.array(blocks, pa.int64()), pa.array(places, pa.int64()),
                pa.array(codes, pa.int32()), pa.array(alone, pa.bool_()),
            ]
            names = ["part", "block", "at", "code", "alone", *batch.schema.names]
            return pa.RecordBatch.from_arrays([*columns, *batch.slice(0, end).columns], names)

        for batch in chain(batches, [None]):
            if batch is None:
                if held is not None and held.num_rows:
                    yield out(held, held.num_rows)  # whether its conversation goes on is not known here
                return
            for c, role, text, key in zip(*(batch.column(n).to_pylist() for n in ("conv", "role", "text", "key"))):
                at += 1
                if not started or c != conv:
                    if started:
                        own[block][1] = True
                    block, rows = block + 1, 0
                    own[block] = [started, False]
                    conv, started, seen = c, True, set()
                elif rows == BLOCK_ROWS:
                    block, rows = block + 1, 0
                    own[block] = [False, False]
                rows += 1
                initial = INITIALS.find(role[0]) if role else -1
                lists[0].append(at)
                lists[1].append(block)
                lists[2].append(4 * (initial if initial >= 0 else 3) + _fault(text, key, seen))
            if held is not None and held.num_rows:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            ready = len(lists[1]) - rows  # all but the open block
            if ready:
                yield out(batch, ready)
            held = batch.slice(ready)
            lists = tuple(x[ready:] for x in lists)
            own = {block: own[block]}

    return run


def lined_up(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Rows in order with partition, block, place and row code; written.

    Ordered by conversation, turn (NULL first), role and the text's checksum;
    of equal rows any order is the same. The order is cut into ranges by
    rows, so one conversation may fill many partitions.
    """
    blank = F.lit(" ")
    plain = rows.select(
        F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role), blank).alias("role"), F.coalesce(F.col(text), blank).alias("text"),
    )
    order = ["conv", "turn", "role", "key", "tie"]
    keyed = plain.withColumns(
        {
            "key": F.unhex(F.md5(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"))),
            "tie": F.monotonically_increasing_id(),
        }
    )
    kind = plain.schema["conv"].dataType.simpleString()
    placed = keyed.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie")
    schema = f"part int, block long, at long, code int, alone boolean, conv {kind}, turn long, role string, text string, key binary"
    return written(placed.mapInArrow(_line_up(), schema), "lined")


def _later_copies(lined: DataFrame) -> DataFrame:
    """(conv, part, block, at) of rows whose like is in an earlier partition.

    Only conversations that span partitions are looked at, at most one more
    than there are partitions, and of each partition only first occurrences;
    so no group has more rows than there are partitions.
    """
    spanning = lined.select("conv", "part").distinct().groupBy("conv").count().where("count > 1").select(F.col("conv").alias("c"))
    firsts = lined.where(~(F.col("code") % 4).isin(BLANK, DUPLICATE)).select("conv", "part", "block", "at", "key")
    firsts = firsts.join(F.broadcast(spanning), F.col("conv").eqNullSafe(F.col("c")), "left_semi")
    order = Window.partitionBy("conv", "key").orderBy("part")
    return firsts.withColumn("r", F.row_number().over(order)).where("r > 1").drop("r", "key")


def blocks_of(lined: DataFrame) -> DataFrame:
    """(conv, part, block, alone, codes): one byte per row of each block; written."""
    rows = lined.select("conv", "part", "block", "alone", "at", "code")
    marks = _later_copies(lined).select("conv", "part", "block", F.lit(None).cast("boolean").alias("alone"), "at", F.lit(-1).alias("code"))
    grouped = rows.unionByName(marks).groupBy("conv", "part", "block").agg(
        F.max("alone").alias("alone"), F.min("at").alias("first_at"), F.collect_list(F.struct("at", "code")).alias("rows")
    )
    return written(grouped, "blocks")


def _codes(rows: list[dict]) -> bytes:
    """Row codes in order; a mark of -1 beside a row makes it a duplicate."""
    code, copies = {}, set()
    for r in rows:
        if r["code"] < 0:
            copies.add(r["at"])
        else:
            code[r["at"]] = r["code"]
    return bytes(c & 12 | DUPLICATE if at in copies else c for at, c in sorted(code.items()))


def _emit(batch: pa.RecordBatch, names: list[str], new: dict[str, tuple[list, pa.DataType]]) -> pa.RecordBatch:
    arrays = [batch.column(n) for n in names] + [pa.array(values, kind) for values, kind in new.values()]
    return pa.RecordBatch.from_arrays(arrays, [*names, *new])


PLACE = ["conv", "part", "block"]
COSTS, PIECES = pa.list_(pa.int64()), pa.list_(pa.string())


def _between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codes = [_codes(r) for r in batch.column("rows").to_pylist()]
        costs = [[c for row in between(block) for c in row] for block in codes]
        yield _emit(batch, [*PLACE, "first_at"], {"codes": (codes, pa.binary()), "costs": (costs, COSTS)})


def _from_the_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Prices at the end of each block; blocks of a conversation come last first."""
    conv, started, start = None, False, None
    for batch in batches:
        ends, last = [], []
        for c, costs in zip(batch.column("conv").to_pylist(), batch.column("costs").to_pylist()):
            final = not started or c != conv
            end = list(END) if final else start
            ends.append(end)
            last.append(final)
            start = [min(NEVER, min(costs[4 * s + t] + end[t] for t in range(4))) for s in range(4)]
            conv, started = c, True
        yield _emit(batch, [*PLACE, "first_at", "codes"], {"ends": (ends, COSTS), "last": (last, pa.bool_())})


def _solve_alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for rows in batch.column("rows").to_pylist():
            codes = _codes(rows)
            pieces, state = trace(codes, auction(codes, list(END)), 0)
            finish(pieces, state)
            found.append((pieces, codes))
        yield _emit(
            batch, [*PLACE, "first_at"],
            {"codes": ([c for _, c in found], pa.binary()), "pieces": ([p for p, _ in found], PIECES)},
        )


def _solve_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        answers, exits = [], []
        for codes, ends, last in zip(*(batch.column(n).to_pylist() for n in ("codes", "ends", "last"))):
            prices = auction(codes, ends)
            solved = [trace(codes, prices, s) for s in range(4)]
            if last:
                for pieces, state in solved:
                    finish(pieces, state)
            answers.append([pieces for pieces, _ in solved])
            exits.append([state for _, state in solved])
        new = {"answers": (answers, pa.list_(PIECES)), "exits": (exits, COSTS)}
        yield _emit(batch, [*PLACE, "first_at", "codes"], new)


def _from_the_start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The answer for the state in which each block is entered; blocks come first first."""
    conv, started, state = None, False, 0
    for batch in batches:
        pieces = []
        for c, answers, exits in zip(*(batch.column(n).to_pylist() for n in ("conv", "answers", "exits"))):
            if not started or c != conv:
                state = 0
            pieces.append(answers[state])
            state = exits[state]
            conv, started = c, True
        yield _emit(batch, [*PLACE, "first_at", "codes"], {"pieces": (pieces, PIECES)})


def solved(blocks: DataFrame) -> DataFrame:
    """(conv, part, block, first_at, codes, pieces): the edits of every row of every block."""
    kind = blocks.schema["conv"].dataType.simpleString()
    place = f"conv {kind}, part int, block long, first_at long, codes binary"
    answer = f"{place}, pieces array<string>"
    alone = blocks.where("alone").select(*PLACE, "first_at", "rows").mapInArrow(_solve_alone, answer)
    costs = written(blocks.where("NOT alone").select(*PLACE, "first_at", "rows").mapInArrow(_between, f"{place}, costs array<long>"), "costs")
    falling = [F.col("conv"), F.desc("part"), F.desc("block")]
    ended = costs.repartition("conv").sortWithinPartitions(*falling).mapInArrow(_from_the_end, f"{place}, ends array<long>, last boolean")
    entries = ended.repartition("part", "block").mapInArrow(_solve_entries, f"{place}, answers array<array<string>>, exits array<long>")
    picked = entries.repartition("conv").sortWithinPartitions(*PLACE).mapInArrow(_from_the_start, answer)
    return alone.unionByName(picked)


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per edit: (conv, part, at, k, edit, turn, was, fault, role, text).

    ``part, at, k`` order the edits of a conversation; ``edit`` is K, R, D or I.
    ``was`` and ``fault`` (0, or blank 1, duplicate 2, truncated 3) describe the
    row edited (NULL of an Insert), ``role`` and ``text`` the row that results
    (NULL if deleted).

    NULL roles and texts are one space, a NULL conversation is one of its own,
    NULL turns come first. Rows of one turn are ordered by role and a checksum
    of role and text, so the result does not depend on the input's order.
    Texts are whole, however long. Columns besides the four are not looked
    at. An empty table gives none.
    """
    lined = lined_up(rows, conv, turn, role, text)
    answers = solved(blocks_of(lined)).select(
        F.col("part").alias("p"), F.col("block").alias("b"), "first_at", "codes", "pieces"
    )
    joined = lined.drop("key", "alone").join(answers, (F.col("part") == F.col("p")) & (F.col("block") == F.col("b")))
    place = (F.col("at") - F.col("first_at")).cast("int")
    fault = F.conv(F.hex(F.substr(F.col("codes"), place + 1, F.lit(1))), 16, 10).cast("int") % 4
    edits = F.regexp_extract_all(F.get("pieces", place), F.lit("[DK]|[IR][ua]"), F.lit(0))
    each = joined.select(
        "conv", "part", "at", "turn", F.col("role").alias("was"), "text", fault.alias("fault"), F.posexplode(edits).alias("k", "e")
    )
    letter = F.substr("e", F.lit(1), F.lit(1))
    named = F.when(F.endswith("e", F.lit("u")), "user").otherwise("assistant")
    old = {c: F.when(letter != "I", F.col(c)).alias(c) for c in ("turn", "was", "fault")}
    return each.select(
        "conv", "part", "at", "k", letter.alias("edit"), *old.values(),
        F.when(letter == "K", F.col("was")).when(letter != "D", named).alias("role"),
        F.when(letter.isin("K", "R"), F.col("text")).when(letter == "I", "").alias("text"),
    )


# --- damage and digests ------------------------------------------------------------

def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with planted faults, chosen by crc32(``conv_id:turn``) % 20.

    0 drops the row, 1 empties its text, 2 takes away its ``[.!?]``, 3 repeats
    it, 4 makes its role user. NULLs count as one space, also in the checksum.
    """
    space = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    h = F.crc32(name) % 20
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    rows = conversations.select(
        "conv_id", "turn",
        F.when(h == 4, "user").otherwise(role).alias("role"),
        F.when(h == 1, "").when(h == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(h == 0, 0).when(h == 3, 2).otherwise(1).alias("copies"),
    )
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).drop("col")


SUMMARY = [
    ("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()),
    ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string()),
]
EDIT_COST = {"K": 0, "R": 2, "D": 3, "I": 2}


class _Summary:
    """Running facts of one conversation: a few numbers, a hash state and the audit so far."""

    def __init__(self):
        import hashlib

        self.faults, self.illegal, self.cost, self.audit = [0, 0, 0, 0], 0, 0, []
        self.first_turn = self.turn = self.before = None
        self.turns, self.empty, self.hash = 0, True, hashlib.sha256()

    def add(self, edit: str, turn: int | None, was: str, fault: int, role: str, text: str) -> None:
        self.audit.append(edit)
        self.cost += EDIT_COST[edit]
        if edit != "I":
            if self.before is not None and self.before + was[:1] not in ("su", "ua", "au"):
                self.illegal += 1
            self.before = was[:1]
            self.faults[fault] += 1
            self.cost += fault == TRUNCATED and edit != "D"
            if turn is not None and turn != self.turn:
                self.first_turn = turn if self.turns == 0 else self.first_turn
                self.turn, self.turns = turn, self.turns + 1
        if edit != "D":
            self.hash.update((("" if self.empty else "\n") + role + ":" + text).encode())
            self.empty = False

    def values(self) -> list:
        gaps = self.turn - self.first_turn + 1 - self.turns if self.turns else 0
        return [gaps, *self.faults[1:], self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest()]


def _summaries(kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, now = None, None
        for batch in batches:
            done = []
            columns = [batch.column(n).to_pylist() for n in ("conv", "edit", "turn", "was", "fault", "role", "text")]
            for c, edit, *row in zip(*columns):
                if now is None or c != conv:
                    if now is not None:
                        done.append([conv, *now.values()])
                    conv, now = c, _Summary()
                if edit is not None:
                    now.add(edit, *row)
            yield rows_of(done, kind)
        if now is not None:
            yield rows_of([[conv, *now.values()]], kind)

    def rows_of(done: list[list], kind: pa.DataType) -> pa.RecordBatch:
        names, kinds = zip(("conv", kind), *SUMMARY)
        columns = zip(*done) if done else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], list(names))

    return run


def summary(edits: DataFrame, conversations: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Per conversation of ``conversations``: faults, cost, audit and hash of the repaired rows.

    One without rows has zeros, an empty audit and the hash of nothing. A hash
    reads its conversation in order, so the rows of one conversation pass
    through one task; they are streamed, and only the audit's letters are
    held.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = conversations.schema[conv].dataType
    none = {n: F.lit(None).cast(edits.schema[n].dataType) for n in ("edit", "turn", "was", "fault", "role", "text")}
    place = {"part": F.lit(-1), "at": F.lit(-1).cast("long"), "k": F.lit(-1)}
    listed = conversations.select(F.col(conv).alias("conv")).distinct().withColumns(place | none)
    ordered = edits.unionByName(listed).repartition("conv").sortWithinPartitions("conv", "part", "at", "k")
    fields = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    out = ordered.mapInArrow(_summaries(to_arrow_type(kind)), f"conv {kind.simpleString()}, {fields}")
    return out.withColumnRenamed("conv", conv)
