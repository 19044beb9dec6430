"""Conversation repair against enumeration of all edits, a plain tuple program, and a row-by-row twin of the whole report."""
from __future__ import annotations

import hashlib
import random
import re
import zlib
from itertools import groupby, product

import pytest

from hourgrid.llm import conversations as C
from hourgrid.llm import queries

GRAMMAR = re.compile(r"(s?(ua)+)?")
SPACE = " \t\n\x0b\x0c\r"


def all_edits(codes: str) -> tuple[int, str]:
    """The least (cost, audit) over every way to edit at most four rows with up to two insertions at each place."""
    gaps = [(), ("u",), ("a",), ("u", "a"), ("a", "u")]
    best = None
    for row_edits in product("DKua", repeat=len(codes)):
        cost, ok = 0, True
        for e, c in zip(row_edits, codes):
            kind = C.CODES.index(c) // 4
            ok &= kind < 2 or e == "D"
            cost += (2 if e == "D" else 0 if e == "K" else 1) + (5 if kind == 1 and e != "D" else 0)
        if not ok or (best and cost > best[0]):
            continue
        for put in product(gaps, repeat=len(codes) + 1):
            total = cost + 5 * sum(map(len, put))
            if best and total > best[0]:
                continue
            roles, audit = "", ""
            for k, places in enumerate(put):
                roles, audit = roles + "".join(places), audit + "I" * len(places)
                if k < len(codes):
                    e = row_edits[k]
                    audit += e if e in "DK" else "R"
                    roles += "" if e == "D" else C.INITIALS[C.CODES.index(codes[k]) % 4] if e == "K" else e
            if GRAMMAR.fullmatch(roles) and (best is None or (total, audit) < best):
                best = total, audit
    return best


def tuple_program(codes: str) -> tuple[int, str]:
    """The same choice with (cost, text) pairs, last row first."""
    best = {q: min((C.INSERT * n, "I" * n) for p, n in C.inserted(q) if p in C.ENDS) for q in range(4)}
    for code in reversed(codes):
        best = {q: min((cost + best[p][0], letters + best[p][1]) for p, cost, letters in ways)
                for q, ways in enumerate(C.row_edges(code))}
    return best[0]


def by_stretches(codes: str, length: int) -> tuple[int, str]:
    parts = [C.stretch_weights(codes[k:k + length]) for k in range(0, len(codes), length)]
    while len(parts) > 1:
        parts = [C.joined(*parts[k:k + 2]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
    return C.best_audit(*parts[0])


def test_integer_weights_equal_enumeration():
    for n in (1, 2):
        for codes in product(C.CODES, repeat=n):
            assert by_stretches("".join(codes), 8) == all_edits("".join(codes)), codes
    rng = random.Random(5)
    for _ in range(40):
        codes = "".join(rng.choices("suaoSUA0", k=3))
        assert by_stretches(codes, 2) == all_edits(codes), codes


@pytest.mark.parametrize("length", [1, 3, 64, 512])
def test_any_cut_gives_the_same_audit(length):
    rng = random.Random(length)
    for n in (1, 5, 40, 700):
        codes = "".join(rng.choices(C.CODES, weights=[1, 6, 6, 1] + [1] * 8, k=n))
        assert by_stretches(codes, length) == tuple_program(codes)


def plain_report(rows: list[tuple]) -> dict:
    """conv_id -> the report's values, row by row; rows are (conv_id, turn, role, text)."""
    after: dict = {r[0]: [] for r in rows}
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        after[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    found = {}
    for conv, held in after.items():
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = [r[0] for r in held if r[0] is not None]
        seen, codes, counts = set(), "", {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in held:
            cut = text.rstrip(SPACE)
            fault = ("blank" if not cut else "duplicate" if (role, text) in seen else
                     "truncated" if cut[-1] not in ".!?" else None)
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            initial = max("sua".find(role[:1]) if role[:1] else 3, -1) % 4
            codes += C.CODES[{"truncated": 1, None: 0}.get(fault, 2) * 4 + initial]
        initials = [r[1][:1] for r in held]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit = tuple_program(codes)
        out, source = [], iter(held)
        kept = len(audit) - audit.count("D")
        for e in audit:
            role, text = ("", "") if e == "I" else next(source)[1:]
            if e != "D":
                put = ("user", "assistant")[(len(out) + kept) % 2]
                out.append(f"{put if e in 'IR' else role}:{text}")
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        found[conv] = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit,
                       hashlib.sha256("\n".join(out).encode()).hexdigest())
    return found


def as_dict(df) -> dict:
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


def test_query_equals_plain_report(spark):
    sf = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{sf}/conversations.parquet")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in table.collect()]
    got = queries.op12_conversations(spark, sf)
    assert got.columns[:9] == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
                               "repaired_sha256"]
    assert as_dict(got) == plain_report(rows)


def test_odd_and_hot_conversations(spark):
    rng = random.Random(1)
    texts = ["Yes.", "No", "", " \t", "What?", "été!", "漢字", "Yes.", None, "x" * 20000 + ".", "a.b\x1c", "end. \n"]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "User"]
    rows = [(c, rng.choice([None, *range(6)]), rng.choice(roles), rng.choice(texts)) for c in [None, *range(40)]
            for _ in range(rng.randrange(1, 9))]
    rows += [(77, t, ("user", "assistant")[t % 2], f"turn {t}" + rng.choice([".", "?", ""])) for t in range(3000)]
    rows += [(None, None, "user", "the same.")] * 50
    rows += [(500 + t, t, "user", None) for t in range(40)]  # some of these lose their only row
    table = spark.createDataFrame([(*r, "x", 1) for r in rows],
                                  "conv_id long, turn long, role string, text string, at string, part int")
    assert as_dict(C.report(table)) == plain_report(rows)
    assert C.report(table.where("false")).count() == 0


def test_repaired_turns_follow_the_grammar(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    turns = C.placed(C.damaged(table))
    found = C.audits(C.faults(turns))
    rows = sorted((tuple(r) for r in C.repaired(turns, found).collect()))
    assert rows
    for _, held in groupby(rows, key=lambda r: r[0]):
        held = list(held)
        assert [r[1] for r in held] == list(range(len(held)))
        assert GRAMMAR.fullmatch("".join(r[3][0] for r in held))
