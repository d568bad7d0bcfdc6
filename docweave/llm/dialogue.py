"""Repair the turn structure of conversations by a rank-convergence parallel Viterbi.

Every conversation gets the cheapest edits (keep, rerole, delete, insert) after which
its role initials read ``(s?(ua)+)?``. The states of that pattern are the columns of a
backward cost vector per row. Rows are range-partitioned in conversation order, so one
conversation may lie in many partitions; it is cut into chunks of bounded size:

* each chunk runs backwards from a speculative cost vector at its end;
* fix-up passes give it the vector its successor ends with. A rerun stops as soon as
  the new and the old vector differ by a constant: all rows before then differ by the
  same constant. Passes go on until no chunk gets a vector of other shape;
* with the backward costs stitched, each chunk traces the smallest cheapest edits for
  any entry state, and the entry states are passed on in the same way.

Conversations that lie whole in one chunk of a partition are solved where they are read.
Costs need one vector per chunk; texts of cut conversations are moved once more, when
their repaired pieces are hashed. A conversation's hash and audit are single values: its
pieces meet in one task as a sorted stream that never holds them together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.llm.blocks import stored

CHUNK_ROWS = 1024
CHUNK_BYTES = 4 << 20
BATCH_BYTES = 8 << 20

SPACES = " \t\n\x0b\x0c\r"
DELETE, RECAST, INSERT = 3, 2, 2
#: After: nothing, a system row, a user row, an assistant row. The first and the last may end.
STATES = 4
_KEEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: The only user or assistant row that may follow a state, and the state after it.
_NEXT = [("user", 2), ("user", 2), ("assistant", 3), ("user", 2)]
_LEGAL = {"su", "ua", "au"}
FINAL = (0, 4, 2, 0)
SPECULATIVE = (0, 0, 0, 0)

_INITIALS = "sua"
OTHER, EMPTY = 3, 4
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3

_STATS = "rows long, blank long, duplicate long, truncated long, illegal long"
_SOLVED = "cost long, audit string, repaired_sha256 string"
_CHUNK = (
    "part int, seq long, conv_id long, open boolean, roles array<string>, texts array<string>, faults binary, "
    f"low long, high long, turns long, gaps long, {_STATS}, {_SOLVED}"
)


def damage(rows: DataFrame) -> DataFrame:
    """Fixed damage by ``crc32('conv_id:turn') % 20``; a dropped row stays as one with a null role.

    ``rows`` has conv_id, turn, role and text; a null in the hashed key, role or text is one space.
    """
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    rows = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), blank).alias("role"),
        F.coalesce(F.col("text").cast("string"), blank).alias("text"),
        (F.crc32(key.cast("binary")) % 20).alias("_kind"),
    )
    kind = F.col("_kind")
    return rows.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").when(kind != 0, F.col("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).when(kind != 0, F.col("text")).alias("text"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
    ).drop("_copy")


def _fault(text: Column) -> Column:
    tail = F.right(F.rtrim(text, F.lit(SPACES)), F.lit(1))
    return F.when(tail == "", BLANK).when(~tail.isin(".", "!", "?"), TRUNCATED).otherwise(0)


def _symbol(initial: int, fault: int) -> int:
    return initial * 4 + fault


def _initial(role: str) -> int:
    at = _INITIALS.find(role[:1]) if role else EMPTY
    return OTHER if at < 0 else at


class Steps:
    """Steps of the cost vectors, worked out once per (vector, symbol).

    Vectors are normalised to a least entry of 0; from any state every other one is at
    most two insertions away, so only few different vectors exist.
    """

    def __init__(self) -> None:
        self._back: dict = {}
        self._trace: dict = {}

    @staticmethod
    def _choices(after: tuple, symbol: int, q: int) -> list[tuple[int, str, int]]:
        """(cost to the end, letter, next state) without insertions."""
        initial, fault = divmod(symbol, 4)
        found = [(DELETE + after[q], "D", q)]
        if fault not in (BLANK, DUPLICATE):
            extra = int(fault == TRUNCATED)
            to = q if initial == EMPTY else _KEEP.get((q, _INITIALS[initial : initial + 1]))
            if to is not None:
                found.append((extra + after[to], "K", to))
            to = _NEXT[q][1]
            found.append((RECAST + extra + after[to], "R", to))
        return found

    def _costs(self, after: tuple, symbol: int) -> list[int]:
        plain = [min(self._choices(after, symbol, q))[0] for q in range(STATES)]
        costs = list(plain)
        for _ in range(2):
            costs = [min(plain[q], INSERT + costs[_NEXT[q][1]]) for q in range(STATES)]
        return costs

    def back(self, after: tuple, symbol: int) -> tuple[tuple, int]:
        """Normalised vector before a row from the one after it, and the constant taken out."""
        found = self._back.get((after, symbol))
        if found is None:
            costs = self._costs(after, symbol)
            least = min(costs)
            found = self._back[after, symbol] = (tuple(c - least for c in costs), least)
        return found

    def trace(self, after: tuple, symbol: int, q: int) -> tuple[str, int]:
        """Smallest letters of the cheapest edits up to and with a row, and the state after it."""
        found = self._trace.get((after, symbol, q))
        if found is None:
            costs, letters, at = self._costs(after, symbol), "", q
            while True:
                options = [(letter, to) for cost, letter, to in self._choices(after, symbol, at) if cost == costs[at]]
                if INSERT + costs[_NEXT[at][1]] == costs[at]:
                    options.append(("I", _NEXT[at][1]))
                letter, to = min(options)
                letters, at = letters + letter, to
                if letter != "I":
                    break
            found = self._trace[after, symbol, q] = (letters, at)
        return found


def run_back(steps: Steps, symbols: bytes, end: tuple) -> tuple[list[tuple], tuple, int]:
    """Vectors after each row, the vector before the first, and the sum of constants."""
    after, total, vectors = end, 0, [end] * len(symbols)
    for i in range(len(symbols) - 1, -1, -1):
        vectors[i] = after
        after, least = steps.back(after, symbols[i])
        total += least
    return vectors, after, total


def rerun_back(steps: Steps, symbols: bytes, old: tuple, new: tuple, start: tuple, total: int) -> tuple[tuple, int]:
    """As ``run_back`` from ``new``, known to give ``start`` and ``total`` from ``old``; stops where both meet."""
    for i in range(len(symbols) - 1, -1, -1):
        if old == new:
            return start, total
        old, before = steps.back(old, symbols[i])
        new, now = steps.back(new, symbols[i])
        total += now - before
    return new, total


def run_forward(steps: Steps, symbols: bytes, vectors: list[tuple], q: int) -> tuple[list[str], int]:
    """Letters per row and the state after the last, from entry state ``q``."""
    letters = []
    for symbol, after in zip(symbols, vectors):
        found, q = steps.trace(after, symbol, q)
        letters.append(found)
    return letters, q


def closing(q: int) -> str:
    """Insertions after the last row of a conversation."""
    letters = ""
    while FINAL[q]:
        letters, q = letters + "I", _NEXT[q][1]
    return letters


def repaired(roles: list[str], texts: list[str], letters: list[str], q: int) -> tuple[list[str], int]:
    """Lines ``role:text`` that the letters leave or make; ``letters`` may have one closing entry more."""
    lines = []
    for i, some in enumerate(letters):
        for letter in some:
            if letter == "D":
                continue
            if letter == "K":
                lines.append(f"{roles[i]}:{texts[i]}")
                initial = roles[i][:1]
                q = _KEEP[q, initial] if initial else q
                continue
            role, to = _NEXT[q]
            lines.append(f"{role}:" if letter == "I" else f"{role}:{texts[i]}")
            q = to
    return lines, q


class _Rows:
    """Rows of one conversation, or of a piece of it, as they come in order."""

    def __init__(self, conv) -> None:
        self.conv, self.roles, self.texts, self.faults, self.turns, self.bytes = conv, [], [], bytearray(), [], 0

    def add(self, turn, role, text, fault) -> None:
        if role is None:  # a dropped row only shows that the conversation exists
            return
        self.roles.append(role)
        self.texts.append(text)
        self.faults.append(fault)
        if turn is not None:
            self.turns.append(turn)
        self.bytes += len(text)

    def stats(self) -> dict:
        initials = [r[:1] for r in self.roles]
        return {
            "rows": len(self.roles),
            "blank": self.faults.count(BLANK),
            "duplicate": self.faults.count(DUPLICATE),
            "truncated": self.faults.count(TRUNCATED),
            "illegal": sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:])),
            "low": self.turns[0] if self.turns else None,
            "high": self.turns[-1] if self.turns else None,
            "turns": len(set(self.turns)),
        }

    def opened(self) -> dict:
        return {"conv_id": self.conv, "open": True, "roles": self.roles, "texts": self.texts, "faults": bytes(self.faults)} | self.stats()

    def solved(self, steps: Steps) -> dict:
        seen = set()
        for i, row in enumerate(zip(self.roles, self.texts)):
            if row in seen and self.faults[i] != BLANK:
                self.faults[i] = DUPLICATE
            seen.add(row)
        out = self.stats()
        symbols = symbols_of(self.roles, self.faults)
        vectors, start, total = run_back(steps, symbols, FINAL)
        letters, q = run_forward(steps, symbols, vectors, 0)
        letters.append(closing(q))
        text = "\n".join(repaired(self.roles, self.texts, letters, 0)[0])
        gaps = out["high"] - out["low"] + 1 - out["turns"] if self.turns else 0
        return out | {
            "conv_id": self.conv,
            "open": False,
            "gaps": gaps,
            "cost": total + start[0],
            "audit": "".join(letters),
            "repaired_sha256": hashlib.sha256(text.encode()).hexdigest(),
        }


def symbols_of(roles: list[str], faults) -> bytes:
    return bytes(_symbol(_initial(role), fault) for role, fault in zip(roles, faults))


def _chunks(limit_rows: int, limit_bytes: int, schema: pa.Schema):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, steps = TaskContext.get().partitionId(), 0, Steps()
        now, straddles, out, size = None, True, [], 0
        names = ("conv_id", "turn", "role", "text", "fault")

        def take(row: dict) -> None:
            nonlocal seq, size
            row = dict.fromkeys(schema.names) | row | {"part": part, "seq": seq}
            seq += row["open"]
            size += 200 + sum(map(len, row["texts"] or ()))
            out.append(row)

        for batch in batches:
            for conv, turn, role, text, fault in zip(*(batch.column(n).to_pylist() for n in names)):
                if now is None:
                    now = _Rows(conv)
                elif now.conv != conv:
                    take(now.opened() if straddles else now.solved(steps))
                    now, straddles = _Rows(conv), False
                elif len(now.roles) >= limit_rows or now.bytes >= limit_bytes:
                    take(now.opened())
                    now, straddles = _Rows(conv), True
                now.add(turn, role, text, fault)
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out.clear()
                    size = 0
        if now is not None:
            take(now.opened())
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return cut


_TYPES = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
_TYPES |= {f"array<{k}>": pa.list_(v) for k, v in _TYPES.items()}


def _arrow(columns: str) -> pa.Schema:
    """Arrow schema of ``name type, name type``."""
    return pa.schema([(name, _TYPES[kind]) for name, kind in (c.split() for c in columns.split(","))])


def _mapped(df: DataFrame, fn, ddl: str) -> DataFrame:
    """``mapInArrow`` of a function from one row (a dict) to an iterable of rows."""
    schema = _arrow(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = Steps()
        for batch in batches:
            rows, size = [], 0
            for i in range(batch.num_rows):
                for out in fn(steps, batch.slice(i, 1).to_pylist()[0]):
                    rows.append(out)
                    size += 100 + len(out.get("text") or "")
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    return df.mapInArrow(run, ddl)


def _with_duplicates(chunks: DataFrame) -> DataFrame:
    """Chunks with the positions whose role and text were not seen earlier in the conversation.

    First places come from a partially aggregated table of hashes, and meet their
    chunk by its key, so a row repeated very often is no hot key.
    """
    rows = chunks.select("conv_id", "part", "seq", F.posexplode(F.arrays_zip("roles", "texts")).alias("at", "row"))
    keys = [F.xxhash64("row.roles", "row.texts").alias("_h1"), F.xxhash64(F.lit(1), "row.texts", "row.roles").alias("_h2")]
    first = rows.groupBy("conv_id", *keys).agg(F.min(F.struct("part", "seq", "at")).alias("place"))
    first = first.groupBy("place.part", "place.seq").agg(F.collect_list("place.at").alias("firsts"))
    return chunks.join(first, ["part", "seq"], "left")


def _code(steps: Steps, row: dict) -> list[dict]:
    firsts, faults, n = set(row["firsts"] or ()), bytearray(row["faults"]), len(row["roles"])
    for i in range(n):
        if i not in firsts and faults[i] != BLANK:
            faults[i] = DUPLICATE
    symbols = symbols_of(row["roles"], faults)
    counts = {"blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE), "truncated": faults.count(TRUNCATED)}
    head = {k: row[k] for k in ("ix", "part", "seq", "conv_id", "rows", "illegal", "low", "high", "turns")}
    ends = {"first": row["roles"][0][:1] if n else None, "last": row["roles"][-1][:1] if n else None}
    return [head | counts | ends | {"symbols": symbols}]


_CODED = (
    f"ix long, part int, seq long, conv_id long, {_STATS}, low long, high long, turns long, "
    "first string, last string, symbols binary"
)
_VECTORS = "ix long, conv_id long, symbols binary, final boolean, end array<int>, start array<int>, total long"


def _speculate(steps: Steps, row: dict) -> list[dict]:
    end = FINAL if row["final"] else SPECULATIVE
    _, start, total = run_back(steps, row["symbols"], end)
    return [{k: row[k] for k in ("ix", "conv_id", "symbols", "final")} | {"end": end, "start": start, "total": total}]


def _fix(steps: Steps, row: dict) -> list[dict]:
    old, new = tuple(row["end"]), tuple(row["wanted"] or row["end"])
    start, total = rerun_back(steps, row["symbols"], old, new, tuple(row["start"]), row["total"])
    return [{k: row[k] for k in ("ix", "conv_id", "symbols", "final")} | {"end": new, "start": start, "total": total}]


def backward_costs(coded: DataFrame, on_pass=None) -> DataFrame:
    """Stitched backward vectors of ``coded(ix, conv_id, symbols)``, chunks numbered in order.

    ``on_pass`` is told how many chunks each fix-up pass reran.
    """
    after = coded.select((F.col("ix") - 1).alias("ix"), F.col("conv_id").alias("_conv"), F.lit(True).alias("_more"))
    ends = coded.join(after, "ix", "left").select(
        "ix", "conv_id", "symbols", (F.col("_more").isNull() | ~F.col("conv_id").eqNullSafe(F.col("_conv"))).alias("final")
    )
    now = stored(_mapped(ends, _speculate, _VECTORS), "vectors")
    while True:
        succ = now.select((F.col("ix") - 1).alias("ix"), F.col("start").alias("_start"))
        met = now.join(succ, "ix", "left").withColumn("wanted", F.when(~F.col("final"), F.col("_start"))).drop("_start")
        changed = met.where(F.col("wanted") != F.col("end")).count()
        if not changed:
            return now
        if on_pass:
            on_pass(changed)
        now = stored(_mapped(met, _fix, _VECTORS), "vectors")


def _exits(steps: Steps, row: dict) -> list[dict]:
    vectors, _, _ = run_back(steps, row["symbols"], tuple(row["end"]))
    exits = [run_forward(steps, row["symbols"], vectors, q)[1] for q in range(STATES)]
    return [{"ix": row["ix"], "conv_id": row["conv_id"], "exits": exits}]


def entry_states(vectors: DataFrame) -> DataFrame:
    """``ix, entry``: the state in which the smallest cheapest edits enter each chunk.

    A chunk first guesses that its predecessor was entered in state 0; passes put the
    true exit in its place until no entry changes.
    """
    exits = _mapped(vectors, _exits, "ix long, conv_id long, exits array<int>")
    before = exits.select((F.col("ix") + 1).alias("ix"), F.col("conv_id").alias("_conv"), F.col("exits").alias("_before"))
    met = exits.join(before, "ix", "left")
    linked = F.when(F.col("conv_id").eqNullSafe(F.col("_conv")), F.col("_before"))
    now = stored(met.select("ix", "exits", linked.alias("before"), F.coalesce(linked[0], F.lit(0)).alias("entry")), "entries")
    while True:
        out = now.select((F.col("ix") + 1).alias("ix"), F.col("entry").alias("_prior"))
        met = now.join(out, "ix", "left").withColumn("_true", F.coalesce(F.expr("before[_prior]"), F.lit(0)))
        if met.where(F.col("_true") != F.col("entry")).isEmpty():
            return now.select("ix", "entry")
        now = stored(met.select("ix", "exits", "before", F.col("_true").alias("entry")), "entries")


def _pieces(steps: Steps, row: dict) -> list[dict]:
    vectors, _, _ = run_back(steps, row["symbols"], tuple(row["end"]))
    letters, q = run_forward(steps, row["symbols"], vectors, row["entry"])
    if row["final"]:
        letters.append(closing(q))
    lines, _ = repaired(row["roles"], row["texts"], letters, row["entry"])
    text = "\n".join(lines) if lines else None
    return [{"ix": row["ix"], "conv_id": row["conv_id"], "audit": "".join(letters), "text": text}]


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hash and audit of each conversation, from its pieces in order."""
    schema = _arrow("conv_id long, audit string, repaired_sha256 string")
    now, audit, digest, any_line, begun = None, [], None, False, False

    def ended() -> dict:
        return {"conv_id": now, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}

    for batch in batches:
        out = []
        for conv, piece, text in zip(*((x.as_py() for x in batch.column(n)) for n in ("conv_id", "audit", "text"))):
            if not begun or conv != now:
                if begun:
                    out.append(ended())
                now, audit, digest, any_line, begun = conv, [], hashlib.sha256(), False, True
            audit.append(piece)
            if text is not None:
                digest.update(("\n" + text if any_line else text).encode())
                any_line = True
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)
    if begun:
        yield pa.RecordBatch.from_pylist([ended()], schema)


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _numbered(chunks: DataFrame) -> DataFrame:
    """Number open chunks in order: whole partitions before, then the place in the partition."""
    parts = chunks.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()  # one row per partition of the sort
    offset, rows = 0, []
    for part, n in sorted((r["part"], r["n"]) for r in parts):
        rows.append((part, offset))
        offset += n
    offsets = chunks.sparkSession.createDataFrame(rows, "part int, _offset long")
    return chunks.join(F.broadcast(offsets), "part").withColumn("ix", F.col("_offset") + F.col("seq")).drop("_offset")


def _solve_open(chunks: DataFrame) -> DataFrame:
    """Results of conversations that were cut."""
    chunks = _numbered(chunks)
    coded = stored(_mapped(_with_duplicates(chunks).drop("texts"), _code, _CODED), "coded")
    vectors = backward_costs(coded.select("ix", "conv_id", "symbols"))
    entries = entry_states(vectors)
    traced = vectors.select("ix", "symbols", "end", "final").join(entries, "ix")
    pieces = _mapped(traced.join(chunks.select("ix", "conv_id", "roles", "texts"), "ix"), _pieces, "ix long, conv_id long, audit string, text string")
    texts = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "ix").mapInArrow(
        _joined, "conv_id long, audit string, repaired_sha256 string"
    )
    # What two chunks have between them: a pair of rows and perhaps one turn counted twice. A chunk
    # without rows occurs only where all rows of the conversation in its partition were dropped.
    full = stored(coded.where("rows > 0").withColumn("_at", F.col("ix")), "full")
    linked = _before(full, coded)
    legal = F.concat("_last", "first").isin(*_LEGAL)
    sums = linked.groupBy("conv_id").agg(
        *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")),
        F.sum(F.col("illegal") + F.when(F.col("_last").isNotNull() & ~legal, 1).otherwise(0)).alias("illegal"),
        F.coalesce(
            F.max("high") - F.min("low") + 1 - F.sum(F.col("turns") - F.when(F.col("_high") == F.col("low"), 1).otherwise(0)),
            F.lit(0),
        ).alias("gaps"),
    )
    first = F.min_by("start", "ix")[0]
    costs = vectors.groupBy("conv_id").agg((F.sum("total") + first).alias("cost"))
    costs, sums = costs.withColumnRenamed("conv_id", "_c"), sums.withColumnRenamed("conv_id", "_s")
    found = texts.join(costs, F.col("conv_id").eqNullSafe(F.col("_c"))).join(sums, F.col("conv_id").eqNullSafe(F.col("_s")), "left")
    return found.select("conv_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in _COUNTS), "audit", "repaired_sha256")


def _before(full: DataFrame, coded: DataFrame) -> DataFrame:
    """Chunks with rows, joined to the last initial and turn of the one before in the conversation.

    Empty chunks between two others (all rows dropped) are stepped over in passes.
    """
    empty = coded.where("rows = 0").select("ix", "conv_id")
    steps = full.withColumn("_prior", F.col("ix") - 1)
    while True:
        skip = empty.select(F.col("ix").alias("_prior"), F.col("conv_id").alias("_conv"), F.lit(1).alias("_skip"))
        met = steps.join(skip, "_prior", "left")
        moves = F.col("_skip").isNotNull() & F.col("conv_id").eqNullSafe(F.col("_conv"))
        met = met.withColumn("_moves", moves)
        if met.where("_moves").isEmpty():
            break
        steps = stored(met.withColumn("_prior", F.when(F.col("_moves"), F.col("_prior") - 1).otherwise(F.col("_prior"))).drop("_conv", "_skip", "_moves"), "steps")
    prior = full.select(F.col("ix").alias("_prior"), F.col("conv_id").alias("_conv"), F.col("last").alias("_last0"), F.col("high").alias("_high0"))
    met = steps.join(prior, "_prior", "left")
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & F.col("_last0").isNotNull()
    return met.withColumn("_last", F.when(same, F.col("_last0"))).withColumn("_high", F.when(same, F.col("_high0")))


def repair(rows: DataFrame, chunk_rows: int = CHUNK_ROWS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Repair all conversations of ``rows(conv_id, turn, role, text)``; a row with a null role only names its conversation.

    Returns per conv_id (a null one included): gaps, blank, duplicate, truncated, illegal,
    cost, audit, repaired_sha256. Rows are taken by turn, nulls first; rows of one turn by
    role, then text. Repeated rows are duplicates. An empty role keeps the state and adds
    nothing to the pattern. An empty table gives no rows; other columns are ignored. No
    text is cut: a chunk ends after the text that fills it.
    """
    keyed = rows.select("conv_id", "turn", "role", "text", _fault(F.col("text")).alias("fault")).withColumn(
        "_id", F.monotonically_increasing_id()
    )
    order = [
        F.col("conv_id").asc_nulls_first(),
        F.col("turn").asc_nulls_first(),
        F.col("role"),
        F.left("text", F.lit(64)),
        F.xxhash64("text"),
        F.col("_id"),
    ]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("_id")
    chunks = stored(ranged.mapInArrow(_chunks(chunk_rows, chunk_bytes, _arrow(_CHUNK)), _CHUNK), "chunks")
    whole = chunks.where("not open").select("conv_id", *_COUNTS, "audit", "repaired_sha256")
    return whole.unionByName(_solve_open(chunks.where("open")))
