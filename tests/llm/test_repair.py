"""Conversation repair against an exhaustive search and a plain fold, with the awkward rows."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from fieldspark.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, digest string, copies string, kind int"
FINAL = re.compile(r"(s?(ua)+)?")


def rank(r):
    return (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest())


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        kind = "blank" if not re.search(r"[^\x20\x09-\x0D]", text) else "duplicate" if (role, text) in seen else ""
        out.append(kind or ("" if re.search(r"[.!?][\x20\x09-\x0D]*\Z", text) else "truncated"))
        seen.add((role, text))
    return out


def fold(rows, kinds):
    """Cost and audit by dynamic programming over plain strings of initials, not over states."""
    best = {"": (0, "")}

    def closed(best):
        for _ in range(2):
            for k, (c, x) in list(best.items()):
                for i in "ua":
                    if re.fullmatch("(s?(ua)*u?)?", k + i) and len(k) < 14:
                        w = (c + 3, x + "I")
                        best[k + i] = min(best.get(k + i, w), w)
        return best

    best = closed(best)
    for (_, role, _), kind in zip(rows, kinds):
        new = {}
        for k, (c, x) in best.items():
            options = [(k, c + 4, "D")]
            if kind in ("", "truncated"):
                more = 3 * (kind == "truncated")
                options += [(k + (role[:1] or "?"), c + more, "K")] + [(k + i, c + more + 3, "R") for i in "ua"]
            for k2, c2, e in options:
                if re.fullmatch("(s?(ua)*u?)?", k2):
                    new[k2] = min(new.get(k2, (c2, x + e)), (c2, x + e))
        best = closed(new)
    return min(w for k, w in best.items() if FINAL.fullmatch(k))


def expected(rows):
    """conv_id -> the row of the query, from undamaged rows."""
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv]
        role, text = (" " if role is None else role), (" " if text is None else text)
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fate:
            text = {1: "", 2: re.sub("[.!?]", "", text)}.get(fate, text)
            groups[conv] += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    out = {}
    for conv, g in groups.items():
        g.sort(key=rank)
        kinds = faults(g)
        cost, audit = fold(g, kinds)
        rest, seq, lines = iter(g), "", []
        for e in audit:
            row = None if e == "I" else next(rest)
            if e != "D":
                seq += row[1][:1] if e == "K" else "ua"[seq[-1:] == "u"]
                lines.append(f"{row[1] if e == 'K' else {'u': 'user', 'a': 'assistant'}[seq[-1]]}:{row[2] if row else ''}")
        turns = [t for t, _, _ in g if t is not None]
        out[conv] = ((max(turns) - min(turns) + 1 - len(set(turns))) if turns else 0, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"),
                     sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(g, g[1:])), cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
        assert FINAL.fullmatch(seq) and next(rest, None) is None
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    words = ["", "  \n", "Yes.", "No", "Why? ", "Well\x0b!\t", "…", "é.", None, "a\n.b", "x" * 50_000 + "."]
    out = [(c if c else None, rng.choice([t, t, t, t // 2, None]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "u2"]), rng.choice(words))
           for c in range(150) for t in range(rng.randint(1, 9))]
    return out + out[:40] + [(1000, 7, "user", None), (1001, -3, "assistant", "Fine.")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA).repartition(5)


@pytest.mark.parametrize("size", [1, 3, 256])
def test_digest_matches_a_plain_fold(spark, rows, size):
    got = repair.digest(repair.damaged(frame(spark, rows)), frame(spark, rows), size).collect()
    assert {r.conv_id: tuple(r)[1:] for r in got} == expected(rows)
    assert len(got) == len({r[0] for r in rows})


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert repair.digest(repair.damaged(none), none).count() == 0
    assert repair.repaired(none.drop("copies")).count() == 0


def test_agenda_against_every_derivation():
    """All edit sequences of short conversations, written out."""
    rng = random.Random(8)
    for _ in range(60):
        codes = "".join(rng.choice("SUAXsuax-") for _ in range(rng.randint(0, 3)))
        best = None
        for slots in itertools.product(["", "I", "II"], repeat=len(codes) + 1):
            for edits in itertools.product("KRD", repeat=len(codes)):
                audit = slots[0] + "".join(e + s for e, s in zip(edits, slots[1:]))
                if any(c == "-" and e != "D" for c, e in zip(codes, edits)):
                    continue
                cost = sum({"K": 0, "R": 3, "D": 4}[e] + 3 * (e != "D" and c.islower()) for c, e in zip(codes, edits)) + 3 * audit.count("I")
                places = iter(zip(codes, edits))
                options = [""]
                for letter in audit:
                    c, e = next(places) if letter != "I" else ("", "I")
                    if e != "D":
                        options = [o + i for o in options for i in (c.lower() if e == "K" else "ua")]
                if any(FINAL.fullmatch(o) for o in options):
                    best = min(best or (cost, audit), (cost, audit))
        assert repair.short_repair(codes) == best, codes


def test_fragments_join_to_the_same_repair():
    rng = random.Random(9)
    for _ in range(20):
        codes = "".join(rng.choice("SUAUAXsua-") for _ in range(rng.randint(1, 60)))
        cut = [codes[k:k + 2] for k in range(0, len(codes), 2)]
        old, repair.JOINED = repair.JOINED, 3
        try:
            parts = [repair.span_parts([repair.turn_parts(c) for c in f], repair.INSERTS) for f in cut]
            assert repair.long_repair(parts) == repair.short_repair(codes)
        finally:
            repair.JOINED = old


def test_one_long_conversation(spark):
    """A conversation of many fragments over several ranges, with repeated turns."""
    rng = random.Random(10)
    rows = [(5, t, rng.choice(["user", "assistant"]), rng.choice(["One.", "Two", f"{t}."])) for t in range(3000)]
    got = repair.digest(repair.damaged(frame(spark, rows)), frame(spark, rows), 100).collect()
    cost, audit = None, None
    kept = [(t, r, x) for _, t, r, x in rows]
    groups = []
    for t, role, text in kept:
        fate = zlib.crc32(f"5:{t}".encode()) % 20
        if fate:
            text = {1: "", 2: re.sub("[.!?]", "", text)}.get(fate, text)
            groups += [(t, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    kinds = faults(groups)
    codes = "".join("-" if k in ("blank", "duplicate") else g[1][0] if k else g[1][0].upper() for g, k in zip(groups, kinds))
    states = {0: (0, "")}
    for code in [*codes, None]:
        for _ in range(2):
            for q, r, c, x in repair.INSERTS:
                if q in states:
                    w = (states[q][0] + c, states[q][1] + x)
                    states[r] = min(states.get(r, w), w)
        if code is None:
            break
        new = {}
        for q, r, c, x in repair.turn_parts(code):
            if q in states:
                w = (states[q][0] + c, states[q][1] + x)
                new[r] = min(new.get(r, w), w)
        states = new
    cost, audit = min(states[q] for q in (0, 3) if q in states)
    assert (got[0].cost, got[0].audit) == (cost, audit)
    lines = repair.repaired(repair.damaged(frame(spark, rows)), 100).orderBy("slot").collect()
    assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in lines).encode()).hexdigest() == got[0].repaired_sha256
    assert [r.slot for r in lines] == list(range(len(lines)))
