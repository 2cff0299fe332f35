"""Conversation repair against all edits tried out, and long conversations against short ones."""

import hashlib
import itertools
import random
import re
import zlib

from pyspark.sql import functions as F

from ledgerloom.llm import conversation_repair as R

PATTERN = re.compile(r"(s?(ua)+)?")


def tried_out(kinds):
    """Least (cost, audit) and the roles left, over all edits; kinds are (initial, fault), fault one of '', b, d, t."""
    best = None
    gaps = ["", "u", "a", "ua", "au"]
    each = []
    for initial, fault in kinds:
        options = [("D", 3, "")]
        if fault not in ("b", "d"):
            more = int(fault == "t")
            options += [("K", more, initial), ("R", 2 + more, "u"), ("R", 2 + more, "a")]
        each.append(options)
    for chosen in itertools.product(*each):
        for put in itertools.product(gaps, repeat=len(kinds) + 1):
            roles, audit, cost = put[0], "I" * len(put[0]), 2 * len(put[0])
            for (letter, c, role), more in zip(chosen, put[1:], strict=True):
                roles, audit, cost = roles + role + more, audit + letter + "I" * len(more), cost + c + 2 * len(more)
            if PATTERN.fullmatch(roles) and (best is None or (cost, audit) < best[:2]):
                best = cost, audit, roles
    return best


def coded(kinds):
    return "".join(chr(65 + "suax".index(i) * 4 + ["", "b", "d", "t"].index(f)) for i, f in kinds)


def test_cheapest_edits_are_those_of_all_edits():
    all_kinds = [(i, f) for i in "suax" for f in ("", "b", "d", "t")]
    rng = random.Random(5)
    cases = [[]] + [[k] for k in all_kinds] + [list(k) for k in itertools.product(all_kinds, repeat=2)]
    cases += [[rng.choice(all_kinds) for _ in range(3)] for _ in range(60)] + [[(rng.choice("suax"), rng.choice(["", "", "t", "d"])) for _ in range(4)] for _ in range(8)]
    for kinds in cases:
        cost, audit, _ = tried_out(kinds)
        assert R.cheapest(coded(kinds)) == (cost, audit), kinds


def test_pieces_give_the_whole():
    rng = random.Random(6)
    for n in (0, 1, 2, 7, 40):
        for _ in range(60):
            classes = "".join(chr(65 + rng.choice([0, 4, 4, 8, 8, 12]) + rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(n))
            pieces, at = [], 0
            while at < n:
                size = rng.randint(1, 5)
                pieces.append(R.piece_paths(classes[at : at + size]))
                at += size
            cost, ways = R.joined_paths(pieces)
            assert (cost, "".join(x for _, x in ways)) == R.cheapest(classes)


def plain(rows):
    """The contract row by row; rows are (conv, turn, role, text)."""
    by = {}
    for conv, turn, role, text in rows:
        mine = by.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        mine += [(turn, "user" if kind == 4 else role, text)] * (1 + (kind == 3))
    out = {}
    for conv, mine in by.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        kinds, seen = [], set()
        for _, role, text in mine:
            body = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
            fault = "b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            kinds.append((role[:1] if role[:1] in ("s", "u", "a") and role else "x", fault))
        turns = {r[0] for r in mine if r[0] is not None}
        cost, audit = R.cheapest(coded(kinds))  # held against all edits above
        left, at, state = [], iter(mine), ""
        for x in audit:
            if x == "D":
                next(at)
                continue
            role, text = next(at)[1:] if x != "I" else (None, "")
            if x != "K":
                role = "user" if state in ("", "s", "a") else "assistant"
            left.append(f"{role}:{text}")
            state = role[0]
        assert PATTERN.fullmatch("".join(x[0] for x in left))
        faults = [f for _, f in kinds]
        bad = sum(a + b not in ("su", "ua", "au") for (a, _), (b, _) in zip(kinds, kinds[1:], strict=False))
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("b"), faults.count("d"), faults.count("t"), bad, cost, audit, hashlib.sha256("\n".join(left).encode()).hexdigest())
    return out


def generated():
    rng = random.Random(9)
    rows = []
    for conv in [None, *range(40)]:
        for turn in range(rng.randint(1, 12)):
            role = rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None])
            text = rng.choice(["Well.", "So what?", "cut off", "", None, " \t", "Fine!\n", "né.", "a\x85", f"Turn {turn}."])
            rows += [(conv, rng.choice([turn, turn, turn, None, turn + 3]), role, text)] * rng.choice([1, 1, 1, 2])
    return rows + [(99, 0, "user", "Same.")] * 700 + [(99, t, "assistant", "Same.") for t in range(300)]


def result(frame):
    return {r[0]: tuple(r)[1:] for r in frame.collect()}


def test_the_query_on_the_table(spark, sf):
    found = R.op12_conversation_repair(spark, sf)
    assert found.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert result(found) == plain(rows)


def test_short_and_long_conversations(spark):
    """Nulls, ties, repeats, very many equal rows and extra columns; each conversation in memory, then each in pieces."""
    rows = generated()
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, _n int, _conv string").repartition(5)
    ids, want = table.select(F.col("conv_id").alias("_conv")), plain(rows)
    setting = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert result(R.repair(R.damaged(table), ids)) == want
    assert result(R.repair(R.damaged(table), ids, most_rows=6, piece=4)) == want
    assert result(R.repair(R.damaged(table), ids, most_chars=30, piece=64)) == want
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == setting


def test_empty_and_dropped_conversations(spark):
    conv = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    table = spark.createDataFrame([(conv, 0, "user", "Gone.")], "conv_id long, turn long, role string, text string")
    ids = table.select(F.col("conv_id").alias("_conv"))
    nothing = hashlib.sha256(b"").hexdigest()
    assert result(R.repair(R.damaged(table), ids)) == {conv: (0, 0, 0, 0, 0, 0, "", nothing)}
    assert R.repair(R.damaged(table.limit(0)), ids.limit(0)).count() == 0
