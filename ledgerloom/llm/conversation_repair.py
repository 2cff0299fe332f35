"""Conversation structure repair: the cheapest edits that make the roles alternate, found by integer minima.

Rows of a conversation, in order of turn, each get a class: role initial (s, u, a or other) and first fault (blank, duplicate, truncated or
none). Edits are Keep (0), Rerole to user or assistant (2), Delete (3; the only one for blank and duplicate rows) and Insert of an empty user or
assistant text (2); a truncated row that is not deleted adds 1. The initials that are left must match ``(s?(ua)+)?``. The
audit is the letters of the edits in order; of equally cheap edits the ASCII-least audit wins.

A path's weight is one integer. Its high digits are the cost; its low digits, 3 bits each and as many as a path can have letters, are the audit, the
first letter in the highest place and zeros behind the last, so a shorter audit is less than its extensions. The DAG has a node for
(row, state) with four states: nothing yet, after s, after u, after a. It is walked from the last row to the first: an edge adds its cost to the high digits,
moves the low digits one place down and puts its letter in front. The minimum of integers decides everything, ties included.

Cost is a function of the letters, so of two paths of one cost through the same rows neither audit begins the other. Hence
minima of pieces compose: a long conversation is cut into pieces of at most PIECE rows, each gives the least weight from every state to every
state, and the pieces are joined by minima of the same kind.

Conversations of at most MOST_ROWS rows and MOST_CHARS characters are dealt by id and streamed through each task, one conversation in memory. Longer
ones are counted by equal rows before a shuffle, dealt by ranges of (id, turn, role, text) over all tasks, and worked on by piece; one
task sees of a whole conversation only the letters of its audit, a digit a row, and, one piece at a time, the texts that its digest is of.

Defined results: a null id is a conversation of its own; null roles and texts are one space, a null turn comes first; rows of one turn are ordered by
role and text; equal rows are repeats, of which all but the first are duplicates; the initial of an empty role, or of one that begins with
another letter than s, u or a, is none of those; turns of equal number count once for gaps; a conversation without
rows has zeros, an empty audit and the digest of nothing; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.session import Scratch, arrow_rows, read_table

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Digits in ASCII order of their letters; 0 pads.
DIGIT = {"D": 1, "I": 2, "K": 3, "R": 4}
LETTER = {d: c for c, d in DIGIT.items()}
#: A row's class is one character: 4 x initial (s, u, a, other) + fault (none, blank, duplicate, truncated), from "A".
INITIALS = "sua"
NONE, BLANK, DUPLICATE, CUT = range(4)
#: States: nothing yet, after s, after u, after a. What an initial leads to from each state.
STEP = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
START, ACCEPTED = 0, (0, 3)
MOST_ROWS, MOST_CHARS, PIECE, BATCH = 2_000, 16_000_000, 256, 1_000
SPACE = "\\x20\\x09-\\x0D"


class Weights:
    """Integers of paths with at most ``places`` letters."""

    def __init__(self, places: int):
        self.low = 3 * places
        self.digits = (1 << self.low) - 1

    def before(self, letter: str, cost: int, rest: int) -> int:
        """The path of one edge and the rest."""
        return (((rest >> self.low) + cost) << self.low) | (DIGIT[letter] << (self.low - 3)) | ((rest & self.digits) >> 3)

    def letters(self, weight: int) -> str:
        digits = weight & self.digits
        return "".join(LETTER[d] for i in range(self.low - 3, -1, -3) if (d := (digits >> i) & 7))

    def cost(self, weight: int) -> int:
        return weight >> self.low


def _inserted(w: Weights, ends: list[int | None]) -> list[int | None]:
    """Least weights when texts may be inserted first. Two are enough: a longer run has a pair that can be left out."""
    for _ in range(2):
        out = list(ends)
        for initial in "ua":
            for a, b in STEP[initial].items():
                if ends[b] is not None:
                    x = w.before("I", INSERT, ends[b])
                    out[a] = x if out[a] is None else min(out[a], x)
        ends = out
    return ends


def _backward(w: Weights, classes: str, ends: list[int | None]) -> list[int | None]:
    """Least weights from each state through the rows to ends, the least weights from each state behind them."""
    for c in reversed(classes):
        initial, fault = divmod(ord(c) - 65, 4)
        out: list[int | None] = [None if x is None else w.before("D", DELETE, x) for x in ends]
        if fault not in (BLANK, DUPLICATE):
            more = TRUNCATED if fault == CUT else 0
            edits = [("R", REROLE + more, STEP[i]) for i in "ua"]
            if initial < 3:
                edits.append(("K", KEEP + more, STEP[INITIALS[initial]]))
            for letter, cost, step in edits:
                for a, b in step.items():
                    if ends[b] is not None:
                        x = w.before(letter, cost, ends[b])
                        out[a] = x if out[a] is None else min(out[a], x)
        ends = _inserted(w, out)
    return ends


@functools.lru_cache(maxsize=20_000)
def cheapest(classes: str) -> tuple[int, str]:
    """Cost and audit of a whole conversation."""
    w = Weights(3 * len(classes) + 3)
    ends: list[int | None] = [0 if s in ACCEPTED else None for s in range(4)]
    best = _backward(w, classes, _inserted(w, ends))[START]
    return w.cost(best), w.letters(best)


def piece_paths(classes: str) -> list[tuple[int, int, int, str]]:
    """(from, to, cost, letters) of the least path of a piece between each two states."""
    w, out = Weights(3 * len(classes) + 3), []
    for to in range(4):
        found = _backward(w, classes, [0 if s == to else None for s in range(4)])
        out += [(a, to, w.cost(x), w.letters(x)) for a, x in enumerate(found) if x is not None]
    return out


def joined_paths(pieces: list[list[tuple[int, int, int, str]]]) -> tuple[int, list[tuple[int, str]]]:
    """Cost, and the state before and letters of each piece, of the least path through all; the letters of a last piece are what is inserted at the end."""
    w = Weights(3)
    ends = _inserted(w, [0 if s in ACCEPTED else None for s in range(4)])
    tail = [None if x is None else (w.cost(x), w.letters(x)) for x in ends]
    # Letters are compared piece by piece: of one cost, none begins the other. A choice is (cost, letters here, what it leads to).
    best: list[tuple | None] = [None if t is None else (t[0], t[1], None, None) for t in tail]
    for paths in reversed(pieces):
        out: list[tuple | None] = [None] * 4
        for a, b, cost, letters in paths:
            if best[b] is None:
                continue
            x = (cost + best[b][0], letters, b, best[b])
            if out[a] is None or x[0] < out[a][0] or (x[0] == out[a][0] and _less(x, out[a])):
                out[a] = x
        best = out
    at, chosen = best[START], [(START, best[START][1])]
    cost = at[0]
    while at[3] is not None:
        chosen.append((at[2], at[3][1]))
        at = at[3]
    return cost, chosen


def _letters(way: tuple | None) -> Iterator[str]:
    while way is not None:
        yield from way[1]
        way = way[3]


def _less(x: tuple, y: tuple) -> bool:
    """Whether the letters from here to the end are ASCII-less."""
    return next((a < b for a, b in itertools.zip_longest(_letters(x), _letters(y), fillvalue="") if a != b), False)


def faults_of(classes: str) -> tuple[int, int, int, int]:
    """Blank, duplicate and truncated rows, and neighbours whose initials are none of su, ua, au."""
    kinds = [(ord(c) - 65) % 4 for c in classes]
    return kinds.count(BLANK), kinds.count(DUPLICATE), kinds.count(CUT), illegal(classes)


def illegal(classes: str) -> int:
    initials = [(ord(c) - 65) // 4 for c in classes]
    return sum((a, b) not in ((0, 1), (1, 2), (2, 1)) for a, b in zip(initials, initials[1:], strict=False))


def repaired(rows: list[tuple[str, str]], letters: str, state: int = START) -> tuple[list[str], int]:
    """`role:text` of what the edits leave of rows (role, text), and the state behind them."""
    out, at = [], iter(rows)
    for i, letter in enumerate(letters):
        if letter == "D":
            next(at)
        elif letter == "K":
            role, text = next(at)
            out.append(f"{role}:{text}")
            state = STEP[role[0]][state]
        else:
            text = next(at)[1] if letter == "R" else ""
            initial = "u" if state in STEP["u"] else "a"
            out.append(f"{'user' if initial == 'u' else 'assistant'}:{text}")
            state = STEP[initial][state]
    return out, state


def damaged(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``_conv``, ``_turn``, ``_role`` and ``_text`` after the damage by crc32(conv:turn) % 20."""
    name = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(name(conv), F.lit(":"), name(turn)).cast("binary")) % 20
    body = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("_text", "[.!?]", "")).otherwise(F.col("_text"))
    rows = conversations.select(F.col(f"`{conv}`").alias("_conv"), F.col(f"`{turn}`").alias("_turn"), name(role).alias("_role"), name(text).alias("_text"), kind.alias("_kind"))
    rows = rows.where("_kind <> 0").select("_conv", "_turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("_role")).alias("_role"), body.alias("_text"), "_kind")
    return rows.withColumn("_n", F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("_kind", "_n")


def class_of(role: Column, text: Column) -> Column:
    """The class of a row that is no duplicate, as a number."""
    first = F.substring(role, 1, 1)
    initial = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    fault = F.when(~text.rlike(f"[^{SPACE}]"), BLANK).when(~text.rlike(f"[.!?][{SPACE}]*\\z"), CUT).otherwise(NONE)
    return initial * 4 + fault


_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _result(conv: T.StructField) -> T.StructType:
    return T.StructType([T.StructField("_conv", conv.dataType), *(T.StructField(c, T.LongType()) for c in _COUNTS), T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])


def _whole(rows: list[tuple], conv) -> tuple:
    """The result of one conversation; rows are (turn, role, text, class)."""
    turns, seen, classes = {r[0] for r in rows if r[0] is not None}, set(), []
    for _, role, text, kind in rows:
        if kind % 4 != BLANK and (role, text) in seen:
            kind += DUPLICATE - kind % 4
        seen.add((role, text))
        classes.append(chr(65 + kind))
    joined = "".join(classes)
    cost, audit = cheapest(joined)
    left, _ = repaired([(r[1], r[2]) for r in rows], audit)
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return conv, gaps, *faults_of(joined), cost, audit, hashlib.sha256("\n".join(left).encode()).hexdigest()


def _short(rows: DataFrame) -> DataFrame:
    """Results of conversations that fit in memory, one after another in each task."""
    schema = _result(rows.schema["_conv"])
    columns = ["_turn", "_role", "_text", "_class"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, names = None, [f.name for f in schema]
        held, conv, done = [], None, []

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)], names=names)

        for b in batches:
            kinds = [b.schema.field("_conv").type, *[pa.int64()] * 6, pa.string(), pa.string()]
            for c, *row in zip(b.column("_conv").to_pylist(), *(b.column(x).to_pylist() for x in columns), strict=True):
                if held and c != conv:
                    done.append(_whole(held, conv))
                    held = []
                conv = c
                held.append(tuple(row))
            if len(done) >= 1000:
                yield flush()
                done = []
        if held:
            done.append(_whole(held, conv))
        if done:
            yield flush()

    rows = rows.select("_conv", "_turn", "_role", "_text", class_of(F.col("_role"), F.col("_text")).alias("_class"))
    return rows.repartition("_conv").sortWithinPartitions("_conv", "_turn", "_role", "_text").mapInArrow(work, schema)


def _pieces(most: int):
    """Numbers the pieces of a task's rows: at most that many rows of one conversation."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, piece, size, last = TaskContext.get().partitionId(), 0, 0, object()
        for b in batches:
            numbers = []
            for conv, n in zip(b.column("_conv").to_pylist(), b.column("_n").to_pylist(), strict=True):
                if conv != last or size + n > most:
                    piece, size, last = piece + 1, 0, conv
                size += n
                numbers.append(piece)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([task] * len(numbers), type=pa.int32()), pa.array(numbers, type=pa.int64())], names=[*b.schema.names, "_task", "_piece"])

    return work


def _fields(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])


_TEXTS, _LONG = T.ArrayType(T.StringType()), T.LongType()


@F.udf(T.ArrayType(_fields(a=T.IntegerType(), b=T.IntegerType(), cost=_LONG, letters=T.StringType())))
def _piece_paths(classes: str):
    return piece_paths(classes)


@F.udf(_fields(cost=_LONG, ways=T.ArrayType(_fields(state=T.IntegerType(), letters=T.StringType()))))
def _joined(pieces):
    cost, chosen = joined_paths([[tuple(p) for p in x] for x in pieces])
    return cost, chosen


@F.udf(_TEXTS)
def _left(roles, texts, ns, letters, state):
    rows = [(r, t) for r, t, n in zip(roles, texts, ns, strict=True) for _ in range(n)]
    return repaired(rows, letters, state)[0]


@F.udf(_fields(blank=_LONG, duplicate=_LONG, truncated=_LONG, illegal=_LONG))
def _faults(classes: str):
    return faults_of(classes)


def _long(rows: DataFrame, scratch: Scratch, most: int = PIECE) -> DataFrame:
    """Results of conversations of any size, by piece."""
    conv = rows.schema["_conv"]
    counted = scratch.written(rows.groupBy("_conv", "_turn", "_role", "_text").agg(F.count("*").alias("_n")), "repair-rows")
    # The first row of equal role and text, by turn; nulls are first.
    text = F.sha2("_text", 256)
    firsts = counted.groupBy("_conv", "_role", text.alias("_digest")).agg(F.min(F.struct(F.col("_turn").isNotNull().alias("has"), "_turn")).alias("_first"))
    own = counted.withColumn("_digest", text).alias("r").join(firsts.alias("f"), F.col("r._conv").eqNullSafe(F.col("f._conv")) & (F.col("r._role") == F.col("f._role")) & (F.col("r._digest") == F.col("f._digest")))
    kind = class_of(F.col("r._role"), F.col("r._text"))
    again = (kind % 4 != BLANK) & ~F.col("r._turn").eqNullSafe(F.col("f._first._turn"))
    same = kind - kind % 4 + DUPLICATE
    marked = own.select("r._conv", "r._turn", "r._role", "r._text", "r._n", F.when(again, same).otherwise(kind).alias("_class"))
    # A row that stands for very many equal ones is cut, so that a piece has at most so many of them; only the first may be no duplicate.
    cut = F.transform(F.sequence(F.lit(0), F.ceil((F.col("_n") - 1) / most)), lambda i: F.struct(i.alias("_i"), F.when(i == 0, 1).otherwise(F.least(F.lit(most), F.col("_n") - 1 - (i - 1) * most)).cast("int").alias("_n")))
    later = F.when(F.col("_class") % 4 == BLANK, F.col("_class")).otherwise(F.col("_class") - F.col("_class") % 4 + DUPLICATE)
    dealt = marked.withColumn("_c", F.explode(cut)).select("_conv", "_turn", "_role", "_text", "_c._i", "_c._n", F.when(F.col("_c._i") == 0, F.col("_class")).otherwise(later).cast("int").alias("_class"))
    dealt = dealt.repartitionByRange("_conv", "_turn", "_role", "_text", "_i").sortWithinPartitions("_conv", "_turn", "_role", "_text", "_i").drop("_i")
    placed = T.StructType([*dealt.schema, T.StructField("_task", T.IntegerType()), T.StructField("_piece", T.LongType())])
    placed = scratch.written(dealt.mapInArrow(_pieces(most), placed), "repair-pieces")
    in_order = F.array_sort(F.collect_list(F.struct("_turn", "_role", "_text", F.expr("_class % 4 = 2").alias("_again"), "_n", "_class")))
    codes = F.transform("_rows", lambda r: F.repeat(F.char(r["_class"] + 65), r["_n"]))
    pieces = placed.groupBy("_conv", "_task", "_piece").agg(in_order.alias("_rows")).withColumn("_classes", F.array_join(codes, ""))
    pieces = scratch.written(pieces.withColumns({"_paths": _piece_paths("_classes"), "_found": _faults("_classes")}), "repair-paths")

    small = pieces.select("_conv", "_task", "_piece", "_paths", "_found", F.substring("_classes", 1, 1).alias("_from"), F.substring("_classes", -1, 1).alias("_to"))
    whole = small.groupBy("_conv").agg(F.array_sort(F.collect_list(F.struct("_task", "_piece", "_paths", "_from", "_to"))).alias("_all"), *(F.sum(f"_found.{c}").alias(c) for c in ("blank", "duplicate", "truncated", "illegal")))
    code = lambda c: F.floor((F.ascii(c) - 65) / 4)
    pairs = F.transform(F.sequence(F.lit(1), F.size("_all") - 1), lambda i: code(F.element_at("_all", i)["_to"]) * 4 + code(F.element_at("_all", i + 1)["_from"]))
    between = F.when(F.size("_all") > 1, F.size(F.filter(pairs, lambda p: ~p.isin(1, 6, 9)))).otherwise(0)
    whole = whole.withColumns({"illegal": F.col("illegal") + between, "_way": _joined(F.transform("_all", lambda p: p["_paths"]))})
    whole = scratch.written(whole.withColumn("_at", F.transform("_all", lambda p: F.struct(p["_task"].alias("_task"), p["_piece"].alias("_piece")))).drop("_all"), "repair-ways")

    ways = whole.select("_conv", F.posexplode("_way.ways").alias("_i", "_w"), F.col("_at")).withColumn("_a", F.get("_at", F.col("_i")))
    texts = pieces.alias("p").join(ways.alias("w"), F.col("p._conv").eqNullSafe(F.col("w._conv")) & (F.col("p._task") == F.col("w._a._task")) & (F.col("p._piece") == F.col("w._a._piece")))
    part = lambda name: F.transform("p._rows", lambda r: r[name])
    lines = texts.select(F.col("p._conv"), F.col("w._i").alias("_i"), _left(part("_role"), part("_text"), part("_n"), "w._w.letters", "w._w.state").alias("_lines"))
    # What is inserted at the end: the state before it is known, so it is u or a in turn.
    last = ways.where("_a is null").select("_conv", "_i", _left(F.array().cast("array<string>"), F.array().cast("array<string>"), F.array().cast("array<int>"), "_w.letters", "_w.state").alias("_lines"))
    digests = _digests(lines.unionByName(last), conv)

    turns = rows.where("_turn is not null").select("_conv", "_turn").distinct().groupBy("_conv").agg((F.max("_turn") - F.min("_turn") + 1 - F.count("*")).alias("gaps"))
    out = whole.alias("w").join(turns.alias("t"), F.col("w._conv").eqNullSafe(F.col("t._conv")), "left").join(digests.alias("d"), F.col("w._conv").eqNullSafe(F.col("d._conv")), "left")
    audit = F.array_join(F.transform("w._way.ways", lambda x: x["letters"]), "")
    return out.select(F.col("w._conv"), F.coalesce("t.gaps", F.lit(0)).cast("long").alias("gaps"), "w.blank", "w.duplicate", "w.truncated", "w.illegal", F.col("w._way.cost").alias("cost"), audit.alias("audit"), F.coalesce("d.repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def _digests(lines: DataFrame, conv: T.StructField) -> DataFrame:
    """SHA-256 of each conversation's lines, one after another; a task holds one digest and one batch."""
    schema = T.StructType([T.StructField("_conv", conv.dataType), T.StructField("repaired_sha256", T.StringType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, digest, kind, begun = None, None, None, False
        for b in batches:
            kind, done = b.schema.field("_conv").type, []
            for c, line in zip(b.column("_conv").to_pylist(), b.column("_line").to_pylist(), strict=True):
                if digest is None or c != last:
                    if digest is not None:
                        done.append((last, digest.hexdigest()))
                    last, digest, begun = c, hashlib.sha256(), False
                digest.update((f"\n{line}" if begun else line).encode())
                begun = True
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], type=kind), pa.array([x for _, x in done], type=pa.string())], names=["_conv", "repaired_sha256"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last], type=kind), pa.array([digest.hexdigest()], type=pa.string())], names=["_conv", "repaired_sha256"])

    each = lines.select("_conv", "_i", F.posexplode("_lines").alias("_j", "_line"))
    return each.repartition("_conv").sortWithinPartitions("_conv", "_i", "_j").mapInArrow(work, schema)


def repair(rows: DataFrame, all_ids: DataFrame, most_rows: int = MOST_ROWS, most_chars: int = MOST_CHARS, piece: int = PIECE) -> DataFrame:
    """One row for each id of ``all_ids`` (``_conv``): faults, cost, audit and digest of what the edits leave of rows (``_conv``, ``_turn``, ``_role``, ``_text``)."""
    spark = rows.sparkSession
    sizes = rows.groupBy("_conv").agg(F.count("*").alias("_rows"), F.sum((F.length("_text") + F.length("_role")).cast("long")).alias("_chars"))
    with Scratch(spark) as scratch, arrow_rows(spark, BATCH):
        large = scratch.written(sizes.where((F.col("_rows") > most_rows) | (F.col("_chars") > most_chars)).select(F.col("_conv").alias("_large")), "repair-large")
        same = F.col("_conv").eqNullSafe(F.col("_large"))
        found = _short(rows.join(large, same, "left_anti"))
        if large.limit(1).count():
            found = found.unionByName(_long(rows.join(large, same, "left_semi"), scratch, piece))
        found = scratch.keep(scratch.written(found, "repaired"))
    ids = all_ids.select("_conv").distinct().withColumnRenamed("_conv", "_id")
    joined = ids.join(found, F.col("_id").eqNullSafe(F.col("_conv")), "left")
    nothing = {**{c: F.lit(0).cast("long") for c in _COUNTS}, "audit": F.lit(""), "repaired_sha256": F.sha2(F.lit(""), 256)}
    return joined.select(F.col("_id").alias("_conv"), *(F.coalesce(F.col(c), v).alias(c) for c, v in nothing.items()))


def op12_conversation_repair(spark, sf_dir):
    """Faults, cheapest edits and digest of every conversation after the damage."""
    conversations = read_table(spark, sf_dir, "conversations")
    found = repair(damaged(conversations), conversations.select(F.col("conv_id").alias("_conv")))
    return found.withColumnRenamed("_conv", "conv_id")
