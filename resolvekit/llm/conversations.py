"""Repair of the turn structure of conversations: a Viterbi decoder that runs in parallel along each conversation.

A repaired conversation is empty or an optional system row and then pairs of user and assistant rows. Each row is
kept, given the other role, or deleted, and rows may be inserted; of the cheapest ways that with the least audit counts.

1. Rows are dealt into ranges by conversation and turn, so that a conversation of any length is cut into chunks.
2. The costs to go from the four states (STEP) are a vector. Up to a constant few vectors can occur (Machine finds
   them by the edit costs). Each chunk starts from all of them at its end, as what follows isn't known yet; vectors
   that come to differ by a constant alone are one from there on, mostly after a few rows.
3. A chunk for which more than one vector is left is fixed up: passes take in what follows, each time twice as far,
   until its vectors differ only by constants. Then the costs at every chunk's end are known.
4. Forward, the same: a chunk is traced from each of the four states by those costs, and passes stitch the states.
5. With the state at its start and the costs at its end, a chunk gives its edits. Texts meet them once, by conversation.

What a task holds is a chunk. Only a conversation's own result (its audit, and the digest, which SHA-256 makes in order)
is made by one task, and that as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby, pairwise

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .store import keep, small_batches

#: Costs of the edits.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Initials of roles that matter, and all others.
KINDS = "suax"
#: What is repaired so far: nothing, a system row, up to a user row, up to a whole pair; and the state after a further row.
EMPTY, SYSTEM, USER, PAIR = range(4)
STEP = {(EMPTY, "s"): SYSTEM, (EMPTY, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): PAIR, (PAIR, "u"): USER}
NAMES = {"u": "user", "a": "assistant"}
INK = r"[^\x20\x09-\x0D]"
#: A row as a number: its kind, and bits.
CUT, DEAD = 4, 8


def _added(state: int) -> str:
    """The role that a new row has in a state."""
    return "a" if state == USER else "u"


def _with_inserts(costs: list[int]) -> tuple[int, ...]:
    for _ in range(2):  # more than two insertions at one place are of no use
        costs = [min(c, INSERT + costs[STEP[s, _added(s)]]) for s, c in enumerate(costs)]
    return tuple(costs)


def _before(after: tuple[int, ...], row: int) -> tuple[int, ...]:
    """Costs to go before a row, from those after it."""
    kind, fault = KINDS[row % CUT], TRUNCATED if row & CUT else 0
    out = []
    for state, cost in enumerate(after):
        ways = [DELETE + cost, REROLE + fault + after[STEP[state, _added(state)]]]
        if (state, kind) in STEP:
            ways.append(fault + after[STEP[state, kind]])
        out.append(min(ways))
    return _with_inserts(out)


def _least(after: tuple[int, ...], row: int, state: int) -> tuple[str, int]:
    """The cheapest way past a row with the least audit, and the state behind it.

    Letters: D delete, K keep, U and A other role, u and a a new row before it. In an audit D < I < K < R.
    """
    before, kind, fault, out = _before(after, row), KINDS[row % CUT], TRUNCATED if row & CUT else 0, ""
    while before[state] != DELETE + after[state]:
        then = STEP[state, _added(state)]
        if before[state] == INSERT + before[then]:
            out, state = out + _added(state), then
        elif (state, kind) in STEP and before[state] == fault + after[STEP[state, kind]]:
            return out + "K", STEP[state, kind]
        else:
            return out + _added(state).upper(), then
    return out + "D", state


class Machine:
    """All vectors that can occur, by number (0 is a conversation's end), and what a row makes of them."""

    def __init__(self):
        self.vectors = [_with_inserts([0 if s in (EMPTY, PAIR) else 1000 for s in range(4)])]
        number = {self.vectors[0]: 0}
        self.back = [bytearray(256) for _ in range(8)]
        for i, after in enumerate(self.vectors):  # grows
            for row in range(8):
                costs = _before(after, row)
                plain = tuple(c - min(costs) for c in costs)
                if plain not in number:
                    number[plain] = len(self.vectors)
                    self.vectors.append(plain)
                self.back[row][i] = number[plain]
        self.least = [[[_least(v, row, s) for s in range(4)] for row in range(8)] for v in self.vectors]
        self.forth = [[bytes([s for _, s in ways]).ljust(256, b"\0") for ways in rows] for rows in self.least]

    def start(self, rows: bytes) -> list[int]:
        """The vector before the rows, for each vector after them."""
        ids = bytes(range(len(self.vectors)))
        for row in reversed(rows):
            if row < DEAD:
                ids = ids.translate(self.back[row])
        return list(ids)

    def after(self, rows: bytes, end: int) -> list[int]:
        """The vector after each row."""
        out = [end] * len(rows)
        for i in range(len(rows) - 1, 0, -1):
            out[i - 1] = out[i] if rows[i] >= DEAD else self.back[rows[i]][out[i]]
        return out

    def end(self, rows: bytes, end: int) -> list[int]:
        """The state after the rows, for each state before them."""
        states = bytes(range(4))
        for row, after in zip(rows, self.after(rows, end), strict=True):
            if row < DEAD:
                states = states.translate(self.forth[after][row])
        return list(states)

    def trace(self, rows: bytes, end: int, state: int, last: bool) -> list[str]:
        """Edits of each row, and what is put in behind the last one of a conversation."""
        out = []
        for row, after in zip(rows, self.after(rows, end), strict=True):
            edit, state = ("D", state) if row >= DEAD else self.least[after][row][state]
            out.append(edit)
        return [*out, {EMPTY: "", SYSTEM: "ua", USER: "a", PAIR: ""}[state] if last else ""]


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): the rows with faults planted by a checksum of conversation and turn.

    Nulls of role and text become one blank, and so do those of conversation and turn in the checksum. A row that is
    repeated has two copies.
    """
    name = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    fault = F.pmod(F.crc32(F.concat(name[0], F.lit(":"), name[1]).cast("binary")), F.lit(20))
    role = F.when(fault == 4, "user").otherwise(name[2])
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(name[3], "[.!?]", "")).otherwise(name[3])
    return rows.where(fault != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(fault == 3, 2).otherwise(1).alias("copies"))


KEY = ["conv_id", "turn", "role", "th"]


def _marked(rows: DataFrame) -> DataFrame:
    """A row for each different (conv_id, turn, role, text): how many there are, and whether the first one is a fault."""
    last = F.right(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), F.lit(1))
    one = rows.select("conv_id", "turn", "role", F.md5("text").alias("th"), "copies", (~F.col("text").rlike(INK)).alias("blank"), (~last.isin(".", "!", "?")).alias("cut"))
    each = one.groupBy(*KEY).agg(F.sum("copies").alias("copies"), F.max("blank").alias("blank"), F.max("cut").alias("cut"))
    first = each.where("not blank").groupBy("conv_id", "role", "th").agg(F.min(F.struct(F.col("turn").isNotNull(), "turn")).alias("f"))
    first = first.select("conv_id", F.col("f.turn").alias("turn"), "role", "th", F.lit(0).alias("copies"), F.lit(False).alias("blank"), F.lit(False).alias("cut"), F.lit(True).alias("new"))
    both = each.withColumn("new", F.lit(False)).unionByName(first)  # a join by key, nulls included
    return both.groupBy(*KEY).agg(F.sum("copies").alias("copies"), *(F.max(c).alias(c) for c in ("blank", "cut", "new")))


def _chunks(marked: DataFrame) -> DataFrame:
    """Chunks of conversations in order: rows and copies, and the vectors at the start by those at the end (back)."""
    kind = F.coalesce(F.array_position(F.array(*map(F.lit, KINDS)), F.substring("role", 1, 1)), F.lit(0))
    row = F.when(kind > 0, kind - 1).otherwise(len(KINDS) - 1) + F.when(F.col("new"), F.when(F.col("cut"), CUT).otherwise(0)).otherwise(DEAD)
    ordered = marked.select(*KEY, "copies", row.cast("int").alias("row")).repartitionByRange(*KEY).sortWithinPartitions(*KEY)
    ordered = ordered.withColumn("part", F.spark_partition_id())
    schema = StructType([*(ordered.schema[c] for c in ("part", *KEY)), *StructType.fromDDL("idx long, rows binary, copies array<long>, first int, last int, illegal long, back array<int>")])
    arrow, legal = to_arrow_schema(schema), {(KINDS.index(a), KINDS.index(b)) for a, b in ("su", "ua", "au")}

    def chunk(batches):
        machine, idx = Machine(), 0
        for batch in batches:
            out = []
            cols = [batch.column(c).to_pylist() for c in (*KEY, "copies", "row", "part")]
            for conv, own in groupby(zip(*cols, strict=True), key=lambda r: r[0]):
                own = list(own)
                rows, copies = bytes(r[5] for r in own), [r[4] for r in own]
                kinds = [r % CUT for r in rows]
                illegal = sum(copies) - len(copies) + sum(p not in legal for p in pairwise(kinds))
                out.append((own[0][6], conv, *own[0][1:4], idx, rows, copies, kinds[0], kinds[-1], illegal, machine.start(rows)))
                idx += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*out, strict=True), arrow, strict=True)] if out else [pa.nulls(0, f.type) for f in arrow], schema=arrow)

    chunks = keep(ordered.mapInArrow(chunk, schema), "chunks")
    # one row a range
    starts = chunks.groupBy("part").count().select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("before"))
    chunks = chunks.join(F.broadcast(starts), "part").withColumn("k", F.col("before") + F.col("idx")).drop("part", "idx", "before")
    beside = lambda step, *more: chunks.select((F.col("k") + step).alias("k"), F.col("conv_id").alias("other"), *more)
    same = F.col("conv_id").eqNullSafe(F.col("other")) & F.col("there").isNotNull()
    chunks = chunks.join(beside(1, F.col("last").alias("there")), "k", "left").withColumn("head", ~same)
    joint = F.when(F.col("head") | F.array_contains(F.array(*(F.lit(4 * a + b) for a, b in legal)), 4 * F.col("there") + F.col("first")), 0).otherwise(1)
    chunks = chunks.withColumn("illegal", F.col("illegal") + joint).drop("other", "there")
    chunks = chunks.join(beside(-1, F.col("first").alias("there")), "k", "left").withColumn("tail", ~same).drop("other", "there")
    return keep(chunks, "chunks")


def _stitched(chunks: DataFrame, values: str, edge: str, start: int, step: int) -> DataFrame:
    """(k, value): what each chunk passes on, where values has that for whatever its neighbour (k + step) passes to it.

    At an edge of a conversation that is start. Each pass takes in twice as many neighbours, and only chunks whose
    values still differ need it.
    """
    known = F.array_repeat(F.element_at(values, F.lit(start + 1)), F.size(values))
    maps = chunks.select("k", F.when(F.col(edge), known).otherwise(F.col(values)).alias("f"), (F.col("k") + step).alias("to")).checkpoint()
    differ = F.size(F.array_distinct("f")) > 1
    while not (left := maps.where(differ)).isEmpty():
        beyond = maps.select(F.col("k").alias("to"), F.col("f").alias("g"), F.col("to").alias("then"))
        fixed = left.join(beyond, "to").select("k", F.transform("g", lambda x: F.col("f")[x]).alias("f"), F.col("then").alias("to"))
        maps = maps.where(~differ).unionByName(fixed).checkpoint()
    return maps.select("k", F.col("f")[0].alias("value"))


def find_edits(marked: DataFrame) -> DataFrame:
    """A row for each chunk k, in order: its edits (see _least, one entry for each different row, and what follows the last), their audit and cost."""
    chunks = _chunks(marked)
    costs = _stitched(chunks, "back", "tail", 0, 1).select((F.col("k") - 1).alias("k"), F.col("value").alias("end"))
    chunks = keep(chunks.join(costs, "k", "left").withColumn("end", F.when(F.col("tail"), 0).otherwise(F.col("end"))), "costs")

    def forth(batches):
        machine = Machine()
        for batch in batches:
            ends = [machine.end(r, e) for r, e in zip(batch.column("rows").to_pylist(), batch.column("end").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("head"), pa.array(ends, pa.list_(pa.int32()))], names=["k", "head", "forth"])

    states = chunks.select("k", "head", "rows", "end").mapInArrow(forth, "k long, head boolean, forth array<int>")
    states = _stitched(states, "forth", "head", EMPTY, -1).select((F.col("k") + 1).alias("k"), F.col("value").alias("state"))
    chunks = chunks.join(states, "k", "left").withColumn("state", F.when(F.col("head"), EMPTY).otherwise(F.col("state")))
    chunks = chunks.select("k", *KEY, "illegal", "rows", "copies", "end", "state", "tail")
    schema = StructType([*chunks.schema.fields[:6], *StructType.fromDDL("edits array<string>, audit string, cost long")])
    arrow = to_arrow_schema(schema)
    letter = str.maketrans("uaUA", "IIRR")
    price = {"D": DELETE, "K": 0, "U": REROLE, "A": REROLE, "u": INSERT, "a": INSERT}

    def trace(batches):
        machine = Machine()
        for batch in batches:
            found = []
            for rows, copies, end, state, tail in zip(*(batch.column(c).to_pylist() for c in ("rows", "copies", "end", "state", "tail")), strict=True):
                edits = machine.trace(rows, end, state, tail)
                audit = "".join(e.translate(letter) + "D" * (n - 1) for e, n in zip(edits, copies, strict=False)) + edits[-1].translate(letter)
                cost = sum(price[c] for e in edits for c in e) + DELETE * (sum(copies) - len(copies))
                cost += sum(TRUNCATED for e, r in zip(edits, rows, strict=False) if r & CUT and r < DEAD and e[-1] != "D")
                found.append((edits, audit, cost))
            cols = list(zip(*found, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], *(pa.array(list(x), f.type) for x, f in zip(cols, list(arrow)[6:], strict=True))], schema=arrow)

    return keep(chunks.mapInArrow(trace, schema), "edits")


def repaired_rows(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """(conv_id, at, role, text) of the repaired conversations; at counts from 0. Each lies in one partition, in order.

    rows are those that the edits were found for.
    """
    texts = rows.select("conv_id", "turn", "role", F.md5("text").alias("th"), "text", F.lit(1).alias("step"), F.lit(None).cast("array<string>").alias("edits"))
    steps = edits.select(*KEY, F.lit(None).cast("string").alias("text"), F.lit(0).alias("step"), "edits")
    both = texts.unionByName(steps).repartition("conv_id").sortWithinPartitions(*KEY, "step")
    schema = StructType([rows.schema["conv_id"], *StructType.fromDDL("at long, role string, text string")])
    arrow = to_arrow_schema(schema)

    def apply(batches):
        conv, key, at, todo = object(), None, 0, iter([""])
        for batch in batches:
            out = []

            def add(role, text):
                nonlocal at
                out.append((conv, at, role, text))  # noqa: B023
                at += 1

            for *own, text, step, more in zip(*(batch.column(c).to_pylist() for c in (*KEY, "text", "step", "edits")), strict=True):
                if step == 0:
                    for c in next(todo):  # behind the rows of the chunk before
                        add(NAMES[c], "")
                    conv, key, at, todo = own[0], None, at if own[0] == conv else 0, iter(more)
                elif own != key:
                    key, edit = own, next(todo)
                    for c in edit[:-1]:
                        add(NAMES[c], "")
                    if edit[-1] != "D":
                        add(own[2] if edit[-1] == "K" else NAMES[edit[-1].lower()], text)
            yield pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*out, strict=True), arrow, strict=True)] if out else [pa.nulls(0, f.type) for f in arrow], schema=arrow)
        last = [(conv, at + i, NAMES[c], "") for i, c in enumerate(next(todo))]
        if last:
            yield pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*last, strict=True), arrow, strict=True)], schema=arrow)

    return both.mapInArrow(apply, schema)


def _digests(repaired: DataFrame) -> DataFrame:
    """(conv_id, sha): of `role:text` lines, of rows that lie in order."""
    schema = StructType([repaired.schema["conv_id"], *StructType.fromDDL("sha string")])
    arrow = to_arrow_schema(schema)

    def digest(batches: Iterator[pa.RecordBatch]):
        conv, sha = None, None
        for batch in batches:
            out = []
            for c, at, role, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if at == 0:
                    out += [(conv, sha.hexdigest())] if sha else []
                    conv, sha = c, hashlib.sha256()
                else:
                    sha.update(b"\n")
                sha.update(f"{role}:{text}".encode())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(arrow)], schema=arrow)
        if sha:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((conv, sha.hexdigest()), arrow, strict=True)], schema=arrow)

    return repaired.mapInArrow(digest, schema)


def repair_report(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """A row for each conv_id of conversations: faults of its rows (conv_id, turn, role, text, copies), edits, and the digest of the repaired ones.

    conv_id, gaps, blank, duplicate, truncated, illegal, cost (long), audit, repaired_sha256. A conv_id of null is one of
    its own. Rows go by turn, nulls first; ties by role and then the text's MD5. Repeated rows are duplicates from the
    second on. A conversation without rows has zeros, an empty audit and the digest of an empty text; an empty table gives
    an empty result. Texts and conversations may have any length; other columns are ignored.
    """
    small_batches(conversations.sparkSession)
    marked = keep(_marked(rows), "marked")
    edits = find_edits(marked)
    n = lambda condition, k="copies": F.sum(F.when(condition, F.col(k)).otherwise(0))
    turns = marked.groupBy("conv_id", "turn").agg(n(F.col("blank")).alias("blank"), n(~F.col("blank")).alias("whole"), F.count_if("new").alias("new"), F.count_if(F.col("new") & F.col("cut")).alias("truncated"))
    faults = turns.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"), F.sum("blank").alias("blank"), (F.sum("whole") - F.sum("new")).alias("duplicate"), F.sum("truncated").alias("truncated"))
    pieces = F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("k", "audit"))), lambda x: x["audit"]))
    ways = edits.groupBy("conv_id").agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"), pieces.alias("audit"))
    out = conversations.select("conv_id").distinct()
    for part in (faults, ways, _digests(repaired_rows(rows, edits))):
        part = part.withColumnRenamed("conv_id", "own")
        out = out.join(part, out["conv_id"].eqNullSafe(part["own"]), "left").drop("own")
    zeros = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
