"""Conversation structure repair: the cheapest edits that make the roles follow ``(s?(ua)+)?``, by an integer DAG program.

A weight is one integer: the cost stands in the high digits, the letters of the edits in a fixed number of octal digits
below it, first letter first, zeros at the end. The letters' digits follow their ASCII order and zero is less than any, so
the plain integer minimum decides by cost and then by the least audit. Putting a letter in front of an audit moves its
digits one place to the right, which keeps the order, so minima are taken from the last row to the first.

A conversation is cut into stretches of bounded length. A stretch gives one weight for each pair of automaton states (before,
after); an insertion always belongs to the row that follows it, so of two audits of one stretch neither is a
beginning of the other and the weights of neighbouring stretches can be joined in any grouping. No task holds more
than a stretch, or FAN of them, while the edits are decided.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hourgrid.llm.common import rows_mapped, stored, to_batch

STRETCH_BITS = 9  # a stretch is at most 512 rows
FAN = 64  # stretches joined at once
LETTERS = "\0DIKR"  # the digit of a letter is its place; the order is that of ASCII
BITS = 3
# What edits cost.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
ROLES = {"u": "user", "a": "assistant"}
# States: 0 nothing yet, 1 after s, 2 after u, 3 after a.
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ENDS = (0, 3)
INITIALS = "suao"  # o: any other role
CODES = INITIALS + INITIALS.upper() + "0123"  # as they are, truncated, to be deleted
LEGAL = ("su", "ua", "au")
SPACES = " \t\n\x0b\x0c\r"

Weights = list[list[int | None]]


def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` after the damage that ``crc32("conv_id:turn") % 20`` names: 0 drops the row, 1 empties
    its text, 2 takes ``. ! ?`` out, 3 repeats it, 4 makes the role user. A null counts as one space."""
    space = F.lit(" ")
    key = F.concat(*[F.coalesce(rows[c].cast("string"), space) if c else F.lit(":") for c in ("conv_id", "", "turn")])
    role, text = (F.coalesce(rows[c].cast("string"), space) for c in ("role", "text"))
    told = rows.select(rows["conv_id"].cast("long").alias("conv_id"), rows["turn"].cast("long").alias("turn"),
                       role.alias("role"), text.alias("text"), (F.crc32(key.cast("binary")) % 20).alias("kind"))
    return told.where("kind <> 0").select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
        .alias("text"), F.explode(F.when(F.col("kind") == 3, F.expr("array(0, 1)")).otherwise(F.expr("array(0)"))).alias("copy")
    ).drop("copy")


def placed(rows: DataFrame) -> DataFrame:
    """Rows with ``at``, a number that follows the order (conv_id, turn, role, text), nulls first; stored.

    The order is a range sort, so the rows of one conversation spread over tasks; 32 characters of the text
    are enough to deal the rows out, the order itself is by whole texts. Equal rows are interchangeable.
    """
    space = F.lit(" ")
    told = rows.select(rows["conv_id"].cast("long").alias("conv_id"), rows["turn"].cast("long").alias("turn"),
                       *[F.coalesce(rows[c].cast("string"), space).alias(c) for c in ("role", "text")])
    dealt = told.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 32))
    return stored(dealt.sortWithinPartitions("conv_id", "turn", "role", "text")
                  .withColumn("at", F.monotonically_increasing_id()), "turns")


def faults(turns: DataFrame) -> DataFrame:
    """``conv_id, at, turn, code, fault`` of ``placed`` rows; fault is blank, duplicate, truncated or null, code as in CODES."""
    cut = F.rtrim(F.col("text"), F.lit(SPACES))
    last = F.substring(cut, -1, 1)
    own = turns.select("conv_id", "at", "turn", (cut == "").alias("blank"), (~last.isin(".", "!", "?")).alias("cut"),
                       F.expr(f"coalesce(nullif(instr('{INITIALS[:3]}', nullif(substring(role, 1, 1), '')), 0), 4)").alias("initial"))
    # The first row of each (conversation, role, text); joined by its place, so no key is hot.
    first = (turns.where(cut != "").groupBy("conv_id", "role", F.sha2(F.col("text"), 256).alias("digest"))
             .agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first")))
    fault = (F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate").when(F.col("cut"), "truncated"))
    kind = F.when(F.col("fault").isin("blank", "duplicate"), 2).when(F.col("fault") == "truncated", 1).otherwise(0)
    return (own.join(first, "at", "left").withColumn("fault", fault)
            .select("conv_id", "at", "turn", "fault",
                    F.substring(F.lit(CODES), kind * 4 + F.col("initial"), F.lit(1)).alias("code")))


def inserted(state: int) -> list[tuple[int, int]]:
    """(state after, insertions) for up to two insertions; a third would repeat a state."""
    found = [(state, 0)]
    for _ in range(2):
        found.append((next(STEP[found[-1][0], c] for c in "ua" if (found[-1][0], c) in STEP), found[-1][1] + 1))
    return found


def row_edges(code: str) -> list[list[tuple[int, int, str]]]:
    """For each state the ways to treat a row: (state after, cost, letters)."""
    kind, initial = divmod(CODES.index(code), 4)
    extra = TRUNCATED if kind == 1 else 0
    edges = []
    for state in range(4):
        ways = []
        for q, n in inserted(state):
            letters, cost = "I" * n, INSERT * n
            ways.append((q, cost + DELETE, letters + "D"))
            if kind < 2:
                if (q, INITIALS[initial]) in STEP:
                    ways.append((STEP[q, INITIALS[initial]], cost + extra, letters + "K"))
                ways += [(STEP[q, c], cost + REROLE + extra, letters + "R") for c in "ua" if (q, c) in STEP]
        edges.append(ways)
    return edges


def packed(letters: str) -> int:
    value = 0
    for c in letters:
        value = value << BITS | LETTERS.index(c)
    return value


@lru_cache(maxsize=64)
def weighted_edges(width: int) -> dict[str, list[list[tuple[int, int, int]]]]:
    """``row_edges`` as (state after, bits to move right, weight to add) for audits of ``width`` letters."""
    low = BITS * width
    return {code: [[(q, BITS * len(x), cost << low | packed(x) << (low - BITS * len(x))) for q, cost, x in ways]
                   for ways in row_edges(code)] for code in CODES}


def stretch_weights(codes: str) -> tuple[int, Weights]:
    """The width of the audits and the least weight from each state to each state over rows of these codes."""
    width = 3 << max(0, len(codes) - 1).bit_length()
    low = BITS * width
    mask, edges = (1 << low) - 1, weighted_edges(width)
    table: Weights = [[None] * 4 for _ in range(4)]
    for end in range(4):
        best: list[int | None] = [0 if q == end else None for q in range(4)]
        for code in reversed(codes):
            best = [min((((v & ~mask) + ((v & mask) >> move) + add) for q, move, add in ways
                         if (v := best[q]) is not None), default=None) for ways in edges[code]]
        for state in range(4):
            table[state][end] = best[state]
    return width, table


def joined(one: tuple[int, Weights], two: tuple[int, Weights]) -> tuple[int, Weights]:
    """Weights over two neighbouring stretches: the letters of the second follow those of the first without a gap."""
    (w1, a), (w2, b) = one, two
    low1, low2 = BITS * w1, BITS * w2
    low = low1 + low2

    def then(x: int, y: int) -> int:
        digits = x & ((1 << low1) - 1)
        free = ((digits & -digits).bit_length() - 1) // BITS if digits else w1  # places without a letter
        return ((((x >> low1) + (y >> low2)) << low) + (digits << low2) + ((y & ((1 << low2) - 1)) << (BITS * free)))
    return w1 + w2, [[min((then(a[s][m], b[m][e]) for m in range(4) if a[s][m] is not None and b[m][e] is not None),
                          default=None) for e in range(4)] for s in range(4)]


def ending() -> tuple[int, Weights]:
    """Insertions after the last row, up to a state in which a conversation may end."""
    table: Weights = [[None] * 4 for _ in range(4)]
    for state in range(4):
        for q, n in inserted(state):
            if q in ENDS and table[state][q] is None:
                table[state][q] = (INSERT * n) << (2 * BITS) | packed("I" * n) << (BITS * (2 - n))
    return 2, table


def best_audit(width: int, table: Weights) -> tuple[int, str]:
    _, whole = joined((width, table), ending())
    low = BITS * (width + 2)
    least = min(whole[0][q] for q in ENDS if whole[0][q] is not None)
    digits = format(least & ((1 << low) - 1), "o").zfill(width + 2)
    return least >> low, "".join(LETTERS[int(d)] for d in digits.rstrip("0"))


STRETCH = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("first", pa.string()), ("last", pa.string()),
                     ("illegal", pa.int64()), ("width", pa.int64()), ("weights", pa.list_(pa.binary()))])
STRETCH_SQL = "conv_id long, part long, first string, last string, illegal long, width long, weights array<binary>"


def _bytes(table: Weights) -> list[bytes | None]:
    return [None if v is None else v.to_bytes((v.bit_length() + 7) // 8, "big") for row in table for v in row]


def _table(cells: list[bytes | None]) -> Weights:
    values = [None if c is None else int.from_bytes(c, "big") for c in cells]
    return [values[k:k + 4] for k in range(0, 16, 4)]


def _of_stretch(_, conv_id, part, codes: str) -> tuple:
    initials = "".join(INITIALS[CODES.index(c) % 4] for c in codes)
    illegal = sum(initials[k:k + 2] not in LEGAL for k in range(len(initials) - 1))
    width, table = stretch_weights(codes)
    return conv_id, part, initials[0], initials[-1], illegal, width, _bytes(table)


def _of_several(_, conv_id, part, stretches: list[dict]) -> tuple:
    head, *rest = stretches
    last, illegal, held = head["last"], head["illegal"], (head["width"], _table(head["weights"]))
    for s in rest:
        illegal += s["illegal"] + (last + s["first"] not in LEGAL)
        last, held = s["last"], joined(held, (s["width"], _table(s["weights"])))
    return conv_id, part, head["first"], last, illegal, held[0], _bytes(held[1])


def _of_conversation(_, conv_id, illegal, width, weights) -> tuple:
    cost, audit = best_audit(width, _table(weights))
    return conv_id, illegal, cost, audit


def audits(known: DataFrame) -> DataFrame:
    """``conv_id, illegal, cost, audit`` from ``faults``: one row for each conversation that has rows."""
    part = F.shiftright("at", STRETCH_BITS).alias("part")
    codes = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "code"))), lambda r: r["code"]), "")
    table = stored(known.groupBy("conv_id", part).agg(codes.alias("codes"))
                   .mapInArrow(rows_mapped(STRETCH, _of_stretch, ["conv_id", "part", "codes"]), STRETCH_SQL), "stretches")
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy("part")) - 1
    table = table.withColumn("part", number.cast("long"))
    more = True
    while more:
        inside = F.struct("part", "first", "last", "illegal", "width", "weights")
        table = stored(table.groupBy("conv_id", F.floor(F.col("part") / FAN).alias("up"))
                       .agg(F.array_sort(F.collect_list(inside), lambda a, b: (a["part"] - b["part"]).cast("int"))
                            .alias("stretches"))
                       .mapInArrow(rows_mapped(STRETCH, _of_several, ["conv_id", "up", "stretches"]), STRETCH_SQL), "joined")
        more = bool(table.agg(F.max("part")).first()[0])
    out = pa.schema([("conv_id", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string())])
    return table.mapInArrow(rows_mapped(out, _of_conversation, ["conv_id", "illegal", "width", "weights"]),
                            "conv_id long, illegal long, cost long, audit string")


REPAIRED = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()),
                      ("text", pa.string())])


class _Editor:
    """Carries out one conversation's audit as its rows come by."""

    def __init__(self, conv_id, audit: str):
        self.conv_id, self.audit, self.at, self.place = conv_id, audit, 0, 0
        self.odd = (len(audit) - audit.count("D")) % 2

    def _role(self) -> str:
        return ROLES["ua"[(self.place + self.odd) % 2]]

    def insertions(self) -> Iterator[tuple]:
        while self.audit[self.at:self.at + 1] == "I":
            yield self.conv_id, self.place, "I", self._role(), ""
            self.at, self.place = self.at + 1, self.place + 1

    def row(self, role: str, text: str) -> Iterator[tuple]:
        yield from self.insertions()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            yield self.conv_id, self.place, edit, self._role() if edit == "R" else role, text
            self.place += 1


def _edited(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    editor = None
    for batch in batches:
        rows: list[tuple] = []
        for conv_id, at, role, text, audit in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "at", "role", "text", "audit"))):
            if at < 0:
                rows += editor.insertions() if editor else ()
                editor = _Editor(conv_id, audit)
            else:
                rows += editor.row(role, text)
        yield to_batch(rows, REPAIRED)
    if editor:
        yield to_batch(list(editor.insertions()), REPAIRED)


def repaired(turns: DataFrame, found: DataFrame) -> DataFrame:
    """The repaired turns, ``conv_id, place, edit, role, text``, from ``placed`` rows and their ``audits``.

    A conversation's rows come in order through one task, behind its audit, batch by batch.
    """
    both = (turns.select("conv_id", "at", "role", "text", F.lit(None).cast("string").alias("audit"))
            .union(found.select("conv_id", F.lit(-1).cast("long"), F.lit(None).cast("string"), F.lit(None).cast("string"), "audit")))
    return (both.repartition("conv_id").sortWithinPartitions("conv_id", "at")
            .mapInArrow(_edited, "conv_id long, place long, edit string, role string, text string"))


def _digested(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])
    held = None
    for batch in batches:
        rows = []
        for conv_id, place, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "place", "role", "text"))):
            if place == 0:
                rows += [(held[0], held[1].hexdigest())] if held else []
                held = conv_id, hashlib.sha256()
            held[1].update((f"{role}:{text}" if place == 0 else f"\n{role}:{text}").encode("utf-8", "surrogatepass"))
        yield to_batch(rows, schema)
    if held:
        yield to_batch([(held[0], held[1].hexdigest())], schema)


def digests(turns: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256`` of what ``repaired`` gives, straight behind it: its order within a task is used."""
    return turns.mapInArrow(_digested, "conv_id long, repaired_sha256 string")


def report(conversations: DataFrame) -> DataFrame:
    """One row for each conv_id of ``conversations``: the faults after ``damaged``, the cheapest repair and its digest.

    Columns ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``. Rows are taken by turn
    (nulls first), equal turns by role and text. A null conv_id is a conversation of its own; null roles and texts are
    one space, a role that is neither system, user nor assistant by its first letter can be kept nowhere. A conversation
    with no row left has zeros, an empty audit and the digest of the empty text. An empty table gives no rows.
    """
    turns = placed(damaged(conversations))
    known = stored(faults(turns), "faults")
    found = stored(audits(known), "audits")

    def count(fault: str):
        return F.count(F.when(F.col("fault") == fault, 1)).alias(fault)
    span = (F.max("turn").cast("decimal(20,0)") - F.min("turn").cast("decimal(20,0)") + 1 - F.count_distinct("turn"))
    told = known.groupBy("conv_id").agg(span.alias("span"), count("blank"), count("duplicate"), count("truncated"))
    told = told.withColumn("gaps", F.expr("try_cast(span as long)"))
    out = conversations.select(conversations["conv_id"].cast("long").alias("conv_id")).distinct()
    for part in (told, found, digests(repaired(turns, found))):
        part = part.withColumnRenamed("conv_id", "_conv")
        out = out.join(part, out["conv_id"].eqNullSafe(part["_conv"]), "left").drop("_conv")
    return out.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in
                                   ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                      F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
