"""Repair of conversation structure: the lightest derivation of a well-formed sequence of roles.

A conversation may read ``(s?(ua)+)?`` in the initials of its roles.  Every turn is kept, given the
role user or assistant, or deleted, and empty turns may be inserted; the cheapest such edits are
wanted, of equal costs those with the least letters.  Turns and inserts are parts that lead from one
grammar state to another; a prefix of the conversation in a state, joined with a part that starts
there, gives a longer prefix.  These are the hyperedges, each with two tails, and an agenda pops
items by falling lightness (Knuth's generalisation of Dijkstra's algorithm): the weight (cost, turns
covered, audit) of a result is never below that of a tail, and two prefixes that cover the same
turns at the same cost are never one the beginning of the other, so joining keeps their order.

Turns travel as small facts (digest, faults, initial) that are ordered once by ranges; a long
conversation lies in several tasks, which solve its fragments for every pair of states.  Fragments
are parts of the same kind and are joined by the same agenda.  Texts are exchanged once, by
conversation, and streamed in order behind the edits, so that no task holds a conversation's texts;
what a task does hold is the audit, which is a value of the result.  (The hash of a conversation is
sequential by its definition, so that a giant one is streamed by one task.)

Defined cases: a null role or text is one space; null turns come first and equal turns are ordered by
role and then by the SHA-256 of the text (identical rows are interchangeable); a null conversation id
is a conversation of its own; a role with another initial, or none, cannot be kept; conversations without rows
have zeros, an empty audit and the hash of the empty string; empty tables give no rows; further
columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.llm.common import arrow_type, narrow, sql_type, tidy

BLANK = r"[\x20\x09-\x0D]"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Grammar states: nothing yet, after the system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
STEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
FINAL = (START, ASSISTANT)
LEGAL = {"su", "ua", "au"}
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: Turns of a fragment, and fragments that one agenda joins.
FRAGMENT = 256
JOINED = 64

Part = tuple[int, int, int, str]  # state before, state after, cost, letters
INSERTS: list[Part] = [(q, r, INSERT, "I") for (q, initial), r in STEP.items() if initial in "ua"]


def turn_parts(code: str) -> list[Part]:
    """Edits of one turn: ``-`` must go, a capital initial is sound, a small one truncated, x is any other role."""
    parts: list[Part] = [(q, q, DELETE, "D") for q in range(4)]
    if code != "-":
        extra, own = (TRUNCATED, code) if code.islower() else (0, code.lower())
        parts += [(q, r, KEEP + extra, "K") for (q, initial), r in STEP.items() if initial == own]
        parts += [(q, r, REROLE + extra, "R") for (q, initial), r in STEP.items() if initial in "ua"]
    return parts


def lightest(parts: list[list[Part]], start: int, inserts: Iterable[Part] = (), goal: bool = False) -> dict[int, tuple[int, str]]:
    """Lightest (cost, audit) of all the parts in a row, by final state; with ``goal`` only that of the goal item.

    Items are prefixes (0, place, state) and parts (1, place, state, state after, places covered).
    """
    n = len(parts)
    agenda: list[tuple] = [(0, 0, "", (0, 0, start))]
    agenda += [(cost, 1, audit, (1, k, q, r, 1)) for k, edits in enumerate(parts) for q, r, cost, audit in edits]
    agenda += [(cost, 0, audit, (1, k, q, r, 0)) for k in range(n + 1) for q, r, cost, audit in inserts]
    heapq.heapify(agenda)
    final, prefixes, ready, out = set(), {}, {}, {}
    while agenda:
        cost, width, audit, item = heapq.heappop(agenda)
        if item in final:
            continue
        final.add(item)
        place = item[1:3]
        if item[0] == 2:
            return {START: (cost, audit)}
        if item[0] == 0:
            prefixes[place] = cost, width, audit
            pairs = [((cost, width, audit), other) for other in ready.get(place, ())]
            if place[0] == n:
                out[place[1]] = cost, audit
                if goal and place[1] in FINAL:
                    heapq.heappush(agenda, (cost, width, audit, (2, n, START)))
        else:
            ready.setdefault(place, []).append((cost, width, audit, item))
            pairs = [(prefixes[place], (cost, width, audit, item))] if place in prefixes else []
        for (c, w, x), (d, v, y, (_, k, _, r, covers)) in pairs:
            if (0, k + covers, r) not in final:
                heapq.heappush(agenda, (c + d, w + v, x + y, (0, k + covers, r)))
    return out


@lru_cache(50_000)
def short_repair(codes: str) -> tuple[int, str]:
    """Cost and audit of a conversation of one fragment."""
    return lightest([turn_parts(c) for c in codes], START, INSERTS, goal=True)[START]


def span_parts(parts: list[list[Part]], inserts: Iterable[Part] = ()) -> list[Part]:
    """The parts in a row as one part for every pair of states."""
    return [(q, r, cost, audit) for q in range(4) for r, (cost, audit) in lightest(parts, q, inserts).items()]


def long_repair(fragments: list[list[Part]]) -> tuple[int, str]:
    """Cost and audit from the parts of a conversation's fragments, joined in rounds, so that letters are copied few times."""
    while len(fragments) > JOINED:
        fragments = [span_parts(fragments[k:k + JOINED]) for k in range(0, len(fragments), JOINED)]
    return lightest(fragments, START, goal=True)[START]


def damaged(conversations: DataFrame) -> DataFrame:
    """The planted damage: rows with ``copies``, those of a dropped row left out."""
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    label = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    fate = F.crc32(label.cast("binary")) % 20
    text = F.when(fate == 1, F.lit("")).when(fate == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.filter(fate != 0).select("conv_id", "turn", F.when(fate == 4, "user").otherwise(F.col("role")).alias("role"),
                                         text.alias("text"), F.when(fate == 3, 2).otherwise(1).cast("long").alias("copies"))


def _clean(rows: DataFrame) -> DataFrame:
    copies = F.col("copies").cast("long") if "copies" in rows.columns else F.lit(1).cast("long")
    rows = narrow(rows.withColumn("copies", copies), conv_id="conv_id", turn="turn", role="role", text="text", copies="copies")
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), "copies")
    return rows.withColumn("digest", F.unhex(F.sha2("text", 256)))


def _facts(rows: DataFrame) -> DataFrame:
    """Distinct turns without their texts: how often, blank, whole, and whether an earlier turn says the same."""
    blank: Column = ~F.col("text").rlike(f"[^{BLANK[1:]}")
    facts = rows.groupBy("conv_id", "turn", "role", "digest", blank.alias("blank"), F.col("text").rlike(rf"[.!?]{BLANK}*\z").alias("ends")).agg(
        F.sum("copies").alias("copies"))
    first = facts.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(
        F.min(F.struct(F.col("turn").isNotNull().alias("any"), F.col("turn").alias("turn"))).alias("f"))
    same = facts.conv_id.eqNullSafe(first.c) & (facts.role == first.r) & (facts.digest == first.d) & facts.turn.eqNullSafe(first.f.turn)
    return facts.join(first, same, "left").select(
        "conv_id", "turn", "role", "digest", "blank", "ends", "copies", F.col("d").isNull().alias("seen"))


PART = pa.struct([("q", pa.int8()), ("r", pa.int8()), ("cost", pa.int64()), ("audit", pa.string())])
COUNTS = ("blank", "duplicate", "truncated", "illegal", "turns")


class Fragment:
    """Facts of turns in a row, as a row of the fragment table."""

    def __init__(self, row: dict):
        self.conv, self.at = row["conv_id"], (row["turn"], row["role"], row["digest"])
        self.codes: list[str] = []
        self.n = dict.fromkeys(COUNTS, 0)
        self.initials = [row["role"][:1], None]
        self.first = self.last = None

    def add(self, row: dict, again: bool) -> None:
        """One copy of a turn; ``again`` for all copies but the first."""
        initial, turn = row["role"][:1], row["turn"]
        if row["blank"] or row["seen"] or again:
            self.n["blank" if row["blank"] else "duplicate"] += 1
            self.codes.append("-")
        else:
            code = initial if initial in ("s", "u", "a") else "x"
            self.n["truncated"] += not row["ends"]
            self.codes.append(code.upper() if row["ends"] else code)
        if self.initials[1] is not None:
            self.n["illegal"] += self.initials[1] + initial not in LEGAL
        self.initials[1] = initial
        if turn is not None and turn != self.last:
            self.n["turns"] += 1
            self.first = turn if self.first is None else self.first
            self.last = turn

    def row(self, full: bool) -> dict:
        codes = "".join(self.codes)
        parts = span_parts([turn_parts(c) for c in codes], INSERTS) if full else []
        return {"conv_id": self.conv, "turn": self.at[0], "role": self.at[1], "digest": self.at[2], "codes": codes, "first": self.first, "last": self.last,
                "head": self.initials[0], "tail": self.initials[1], "parts": [dict(zip("qr", p[:2])) | {"cost": p[2], "audit": p[3]} for p in parts], **self.n}


def _fragments(facts: DataFrame, size: int) -> DataFrame:
    """One row for each stretch of at most ``size`` turns of a conversation within a range of the order."""
    order = ["conv_id", "turn", "role", "digest"]
    numbers = ", ".join(f"{c} long" for c in COUNTS)
    turn = sql_type(facts, "turn")
    schema = (f"conv_id {sql_type(facts, 'conv_id')}, turn {turn}, role string, digest binary, codes string, first {turn}, last {turn}, head string, "
              f"tail string, parts array<struct<q: tinyint, r: tinyint, cost: bigint, audit: string>>, {numbers}")
    kind = pa.schema([("conv_id", arrow_type(facts, "conv_id")), ("turn", t := arrow_type(facts, "turn")), ("role", pa.string()), ("digest", pa.binary()),
                      ("codes", pa.string()), ("first", t), ("last", t), ("head", pa.string()), ("tail", pa.string()), ("parts", pa.list_(PART)),
                      *[(c, pa.int64()) for c in COUNTS]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, []
        for batch in batches:
            for row in batch.to_pylist():
                for again in range(row["copies"]):
                    if now is not None and (now.conv != row["conv_id"] or len(now.codes) >= size):
                        out.append(now.row(len(now.codes) >= size))
                        now = None
                    now = now or Fragment(row)
                    now.add(row, again > 0)
                    if len(out) >= 1000:
                        yield pa.RecordBatch.from_pylist(out, kind)
                        out = []
        if now is not None:
            out.append(now.row(False))
        yield pa.RecordBatch.from_pylist(out, kind)

    return facts.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(tidy(run), schema)


class Repair:
    """Counts and edits of one conversation, then its repaired turns as the rows come by."""

    def __init__(self, fragments: list[dict]):
        self.n = {c: sum(f[c] for f in fragments) for c in COUNTS}
        last = None
        for before, after in zip(fragments, fragments[1:]):
            self.n["illegal"] += before["tail"] + after["head"] not in LEGAL
        for f in fragments:
            self.n["turns"] -= f["first"] is not None and f["first"] == last
            last = f["last"] if f["last"] is not None else last
        first = next((f["first"] for f in fragments if f["first"] is not None), None)
        self.gaps = min(last - first + 1 - self.n["turns"], 2**63 - 1) if first is not None else 0
        if not any(f["parts"] for f in fragments):
            self.cost, self.audit = short_repair("".join(f["codes"] for f in fragments))
        else:
            parts = [[(p["q"], p["r"], p["cost"], p["audit"]) for p in f["parts"]] or span_parts([turn_parts(c) for c in f["codes"]], INSERTS)
                     for f in fragments]
            self.cost, self.audit = long_repair(parts)
        self.at, self.state = 0, START

    def _grown(self, edit: str, role: str) -> str:
        """The role that an edit puts behind the turns so far."""
        if edit == "K":
            self.state = STEP[self.state, role[:1]]
            return role
        self.state = ASSISTANT if self.state == USER else USER
        return ROLES[self.state]

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.at:self.at + 1] == "I":
            self.at += 1
            yield "I", self._grown("I", ""), ""

    def turns(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of the repaired conversation up to the next row, which is given."""
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            yield edit, self._grown(edit, role), text


def _streamed(rows: DataFrame, originals: DataFrame, fragment: int) -> DataFrame:
    """Conversation ids, then fragments, then turns of each conversation, in order, with all of a conversation in one stream."""
    fragments = _fragments(_facts(rows), fragment)
    payload = F.struct(*[c for c in fragments.columns if c not in ("conv_id", "turn", "role", "digest")])
    fragments = fragments.select("conv_id", F.lit(1).alias("kind"), "turn", "role", "digest", payload.alias("fragment"))
    turns = rows.select("conv_id", F.lit(2).alias("kind"), "turn", "role", "digest", "text", "copies")
    ids = originals.select("conv_id").distinct().withColumn("kind", F.lit(0))
    every = ids.unionByName(fragments, allowMissingColumns=True).unionByName(turns, allowMissingColumns=True)
    return every.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "digest")


def _conversations(batches: Iterator[pa.RecordBatch], row) -> Iterator:
    """Rows that the generator ``row`` gives for (conversation id, Repair or None, turn rows or None at its end)."""
    conv, waiting, repair, begun = None, [], None, False

    def ended():
        return row(conv, Repair(waiting) if repair is None else repair, None)

    for batch in batches:
        for r in batch.to_pylist():
            if begun and r["conv_id"] != conv:
                yield from ended()
                begun = False
            if not begun:
                conv, waiting, repair, begun = r["conv_id"], [], None, True
            if r["kind"] == 1:
                waiting.append(r["fragment"])
            elif r["kind"] == 2:
                repair = Repair(waiting) if repair is None else repair
                for _ in range(r["copies"]):
                    yield from row(conv, repair, r)
    if begun:
        yield from ended()


def _batched(rows: Iterator[dict], kind: pa.Schema, size: int = 2000, chars: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    out, held = [], 0
    for r in rows:
        out.append(r)
        held += len(r.get("text") or r.get("audit") or "")
        if len(out) >= size or held >= chars:
            yield pa.RecordBatch.from_pylist(out, kind)
            out, held = [], 0
    yield pa.RecordBatch.from_pylist(out, kind)


def repaired(rows: DataFrame, fragment: int = FRAGMENT) -> DataFrame:
    """The repaired conversations: conv_id, slot (from 0), edit (K, R or I), role, text."""
    rows = _clean(rows)
    kind = pa.schema([("conv_id", arrow_type(rows, "conv_id")), ("slot", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])

    def run(batches):
        slot = 0

        def row(conv, repair, r):
            nonlocal slot
            for edit, role, text in repair.turns(r["role"], r["text"]) if r else repair.inserted():
                yield {"conv_id": conv, "slot": slot, "edit": edit, "role": role, "text": text}
                slot += 1
            slot = slot if r else 0

        yield from _batched(_conversations(batches, row), kind)

    return _streamed(rows, rows, fragment).mapInArrow(tidy(run), f"conv_id {sql_type(rows, 'conv_id')}, slot long, edit string, role string, text string")


def digest(rows: DataFrame, originals: DataFrame, fragment: int = FRAGMENT) -> DataFrame:
    """Counts, cost, audit and the hash of the repaired ``role:text`` lines, for every conversation id of ``originals``."""
    rows = _clean(rows)
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    kind = pa.schema([("conv_id", arrow_type(rows, "conv_id")), *[(c, pa.int64()) for c in numbers], ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def run(batches):
        sha, lines = hashlib.sha256(), 0

        def row(conv, repair, r):
            nonlocal sha, lines
            for _, role, text in repair.turns(r["role"], r["text"]) if r else repair.inserted():
                sha.update(f"{chr(10) if lines else ''}{role}:{text}".encode())
                lines += 1
            if r is None:
                yield {"conv_id": conv, "gaps": repair.gaps, **{c: repair.n[c] for c in numbers[1:5]}, "cost": repair.cost, "audit": repair.audit,
                       "repaired_sha256": sha.hexdigest()}
                sha, lines = hashlib.sha256(), 0

        yield from _batched(_conversations(batches, row), kind)

    return _streamed(rows, originals, fragment).mapInArrow(
        tidy(run), f"conv_id {sql_type(rows, 'conv_id')}, {', '.join(f'{c} long' for c in numbers)}, audit string, repaired_sha256 string")


def _more(weight: str, cost: str, letter: str) -> str:
    """SQL: a weight (nine digits of cost, then letters) after one more edit."""
    return f"lpad((substr({weight}, 1, 9)::INT + {cost})::VARCHAR, 9, '0') || substr({weight}, 10) || '{letter}'"


def _closed(s: str, y: str, u: str, a: str) -> str:
    """SQL: the weights of the four states, with inserts behind them."""
    once = f"least({u}, {_more(s, '3', 'I')}, {_more(y, '3', 'I')}, {_more(a, '3', 'I')})"
    return f"{s} AS s, {y} AS y, {once} AS u, least({a}, {_more(once, '3', 'I')}) AS a"


#: The same repair in DuckDB, by columns of the four states and one recursion step a turn.
SQL = f"""
WITH RECURSIVE step AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce("text", ' ') AS t, hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))) AS x FROM conversations),
f AS (SELECT o.*, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
  lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1])), 4294967295)::BIGINT % 20 AS fate FROM o, step),
d AS (SELECT conv_id, turn, CASE fate WHEN 4 THEN 'user' ELSE role END AS role, CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(t, '[.!?]', '', 'g') ELSE t END AS t
  FROM f, unnest(range(CASE fate WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END))),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(t)) AS k FROM d),
v AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, t ORDER BY k) AS copy FROM n),
g AS (SELECT *, CASE WHEN NOT regexp_matches(t, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN copy > 1 THEN 'duplicate' WHEN NOT regexp_matches(t, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 'truncated' ELSE '' END AS fault,
  substr(role, 1, 1) AS i, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY k) AS h FROM v),
w AS (SELECT conv_id, 0::BIGINT AS k, {_closed("'000000000'", "NULL::VARCHAR", "NULL::VARCHAR", "NULL::VARCHAR")} FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL SELECT conv_id, k, {_closed("s", "y", "u", "a")} FROM (
    SELECT w.conv_id, w.k + 1 AS k, {_more("w.s", "4", "D")} AS s,
      least({_more("w.y", "4", "D")}, CASE WHEN e AND i = 's' THEN {_more("w.s", "x", "K")} END) AS y,
      least({_more("w.u", "4", "D")}, CASE WHEN e AND i = 'u' THEN least({_more("w.s", "x", "K")}, {_more("w.y", "x", "K")}, {_more("w.a", "x", "K")}) END,
        CASE WHEN e THEN least({_more("w.s", "x + 3", "R")}, {_more("w.y", "x + 3", "R")}, {_more("w.a", "x + 3", "R")}) END) AS u,
      least({_more("w.a", "4", "D")}, CASE WHEN e AND i = 'a' THEN {_more("w.u", "x", "K")} END, CASE WHEN e THEN {_more("w.u", "x + 3", "R")} END) AS a
    FROM w JOIN (SELECT *, fault IN ('', 'truncated') AS e, CASE fault WHEN 'truncated' THEN 3 ELSE 0 END AS x FROM g) r ON w.conv_id IS NOT DISTINCT FROM r.conv_id AND r.k = w.k + 1)),
z AS (SELECT conv_id, max_by(least(s, a), k) AS best FROM w GROUP BY conv_id),
l AS (SELECT conv_id, substr(best, 10) AS audit, p, substr(best, 9 + p, 1) AS edit FROM z, unnest(range(1, len(best) - 8)) v(p)),
m AS (SELECT *, sum(CAST(edit <> 'I' AS INT)) OVER (PARTITION BY conv_id ORDER BY p) AS k, sum(CAST(edit <> 'D' AS INT)) OVER (PARTITION BY conv_id ORDER BY p) AS j FROM l),
q AS (SELECT m.conv_id, p, j, edit, role, t, max(CAST(j = 1 AND edit = 'K' AND role[1] = 's' AS INT)) OVER (PARTITION BY m.conv_id) AS sys
  FROM m LEFT JOIN g ON m.conv_id IS NOT DISTINCT FROM g.conv_id AND m.k = g.k AND m.edit <> 'I'),
h AS (SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (j - sys) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(t, ''), chr(10) ORDER BY p)) AS sha FROM q WHERE edit <> 'D' GROUP BY conv_id),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (h IS NOT NULL AND h || i NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY conv_id)
SELECT z.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, substr(best, 1, 9)::BIGINT AS cost, substr(best, 10) AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM z LEFT JOIN c ON z.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN h ON z.conv_id IS NOT DISTINCT FROM h.conv_id
"""
