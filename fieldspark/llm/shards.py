"""Near-equal shards by histogram sort, in DataFrame operations alone.

Rows are ordered by a key of two 60-bit halves, the digest of the text and that of the id, so equal
texts stand together.  The splitters between shards are found by counting: exact bytes below every
candidate boundary of a round (the prefixes of some bits within the intervals that still hold a
wanted place), then finer candidates where the best one misses its place by more than the tolerance.
A splitter inside the second half cuts a group of equal texts, which happens only where no boundary
between texts meets the tolerance.  When all splitters stand, rows are exchanged once, into parts of
bounded size within each shard, and numbered there.

Defined cases: a null text has no bytes (its size is the overhead alone) and the CRC of the empty
text; rows equal in text and id have equal keys and stay in one shard; empty tables give no rows;
fewer rows than shards leave shards empty; extra columns may have any names but the three new ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.llm.common import written

SHARDS = 40
OVERHEAD = 16
#: A splitter may miss its place by this share of a shard's bytes.
TOLERANCE = 0.02
#: Bits of a half that a round of counting adds; the halves have LEVELS times as many.
BITS = 12
LEVELS = 5
#: Rows of a part in the exchange, about.
PART_ROWS = 200_000


def _half(c: Column) -> Column:
    """60 bits of a digest."""
    return F.conv(F.substring(F.md5(c.cast("binary")), 1, 15), 16, 10).cast("long")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> dict[str, Column]:
    text = F.coalesce(docs[text_col], F.lit(""))
    return {"__h1": _half(text), "__h2": _half(F.concat(F.lit("id:"), F.coalesce(docs[id_col].cast("string"), F.lit("")))),
            "__size": (F.octet_length(text) + OVERHEAD).cast("long")}


def _prefix(level: int) -> list[Column]:
    """The two parts of the key that are known at a level: first bits of the first half, then of the second."""
    unit = BITS * LEVELS
    if level <= LEVELS:
        return [F.shiftright("__h1", unit - BITS * level), F.lit(0).cast("long")]
    return [F.col("__h1"), F.shiftright("__h2", unit - BITS * (level - LEVELS))]


def _start(level: int, a: int, b: int) -> tuple[int, int]:
    """The smallest key with the given prefix."""
    unit = BITS * LEVELS
    return (a << (unit - BITS * level), 0) if level <= LEVELS else (a, b << (unit - BITS * (level - LEVELS)))


def splitters(keys: DataFrame, shards: int, tolerance: float) -> list[tuple[int, int]]:
    """The first key of every shard but the first, from a table of __h1, __h2, __size.

    Each round returns at most ``shards * 2 ** BITS`` counts, whatever the input.
    """
    total = keys.agg(F.sum("__size")).first()[0] or 0
    wanted = {k: total * k / shards for k in range(1, shards)}
    found: dict[int, tuple[int, int]] = {}
    open_: dict[tuple[int, int], tuple[int, list[int]]] = {(0, 0): (0, list(wanted))}  # interval -> bytes below it, its places
    for level in range(1, 2 * LEVELS + 1):
        if not open_ or not total:
            break
        rows = keys
        if level > 1:
            up = keys.sparkSession.createDataFrame([*open_], "a long, b long")
            a, b = _prefix(level - 1)
            rows = keys.withColumns({"a": a, "b": b}).join(F.broadcast(up), ["a", "b"], "left_semi").drop("a", "b")
        a, b = _prefix(level)
        counts = rows.groupBy(a.alias("a"), b.alias("b")).agg(F.sum("__size").alias("n")).collect()
        unit = BITS * LEVELS
        parts: dict[tuple[int, int], list] = {}
        for r in sorted(counts):
            if level == 1:
                parent = (0, 0)
            elif level <= LEVELS:
                parent = (r["a"] >> BITS, 0)
            elif level == LEVELS + 1:
                parent = (r["a"], 0)
            else:
                parent = (r["a"], r["b"] >> BITS)
            parts.setdefault(parent, []).append((r["a"], r["b"], r["n"]))
        following: dict[tuple[int, int], tuple[int, list[int]]] = {}
        for parent, (below, places) in open_.items():
            at, edges = below, []
            for x, y, n in parts[parent]:
                edges.append((at, x, y, n))
                at += n
            for k in places:
                # the interval with the wanted place; candidates are its start and the start of what follows it
                i = max(j for j, e in enumerate(edges) if e[0] <= wanted[k])
                start, x, y, n = edges[i]
                best = min((abs(start - wanted[k]), 0), (abs(start + n - wanted[k]), 1))
                if best[0] <= tolerance * total / shards or level == 2 * LEVELS:
                    key = _start(level, x, y)
                    if best[1]:
                        key = _start(level, x + 1, y) if level <= LEVELS else (key[0], key[1] + (1 << (unit - BITS * (level - LEVELS))))
                    found[k] = key
                else:
                    following.setdefault((x, y), (start, []))[1].append(k)
        open_ = following
    return [found[k] for k in sorted(found)]


def sharded(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", tolerance: float = TOLERANCE) -> DataFrame:
    """The rows of ``docs`` with ``size``, ``shard`` and ``slot`` (numbers from 0 in each shard, without gaps)."""
    keys = written(docs.select(*[c.alias(n) for n, c in _keyed(docs, id_col, text_col).items()]), "keys")
    first = splitters(keys, shards, tolerance)
    rows = keys.count()
    parts = max(1, rows // (shards * PART_ROWS) + 1)
    order = F.struct("__h1", "__h2")
    bounds = F.array(*[F.struct(F.lit(a).cast("long").alias("__h1"), F.lit(b).cast("long").alias("__h2")) for a, b in first]) if first else None
    shard = F.size(F.filter(bounds, lambda s: s <= order)) if first else F.lit(0)
    part = F.pmod(F.col("__h2"), F.lit(parts)).cast("int")
    sizes = keys.groupBy(shard.alias("__shard"), part.alias("__part")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(_before("__shard", "__part"))
    offsets = sizes.select("__shard", "__part", F.coalesce(before, F.lit(0)).alias("__offset"))
    placed = docs.withColumns(_keyed(docs, id_col, text_col)).withColumns({"__shard": shard, "__part": part})
    numbered = placed.withColumn("__n", F.row_number().over(_within()))
    return numbered.join(offsets, ["__shard", "__part"]).select(
        *[docs[c] for c in docs.columns if c not in ("size", "shard", "slot")], F.col("__size").alias("size"),
        F.col("__shard").cast("int").alias("shard"), (F.col("__offset") + F.col("__n") - 1).cast("long").alias("slot"))


def _before(*columns: str):
    from pyspark.sql import Window as W

    return W.partitionBy(columns[0]).orderBy(columns[1]).rowsBetween(W.unboundedPreceding, -1)


def _within():
    from pyspark.sql import Window as W

    return W.partitionBy("__shard", "__part").orderBy("__h1", "__h2")


def digest(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return sharded(docs.select(id_col, text_col, F.crc32(F.coalesce(docs[text_col], F.lit("")).cast("binary")).alias("text_crc32")), shards, id_col, text_col).select(
        F.col(id_col).alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: The same law in DuckDB: at each level of the key's prefixes the boundary next to a wanted place, from the first level that meets the tolerance.
SQL = f"""
WITH step AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
d AS (SELECT doc_id, coalesce(text, '') AS t, (strlen(coalesce(text, '')) + {OVERHEAD})::BIGINT AS size, ('0x' || substr(md5(coalesce(text, '')), 1, 15))::BIGINT AS h1,
  ('0x' || substr(md5('id:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS h2 FROM documents),
c AS (SELECT d.*, hex(encode(t)) AS x, crc FROM d, step),
s AS (SELECT doc_id, size, h1, h2, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
  lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1])), 4294967295)::BIGINT AS text_crc32 FROM c),
l AS (SELECT level, CASE WHEN level <= {LEVELS} THEN h1 >> ({BITS} * ({LEVELS} - level)) ELSE h1 END AS a, CASE WHEN level <= {LEVELS} THEN 0 ELSE h2 >> ({BITS} * ({2 * LEVELS} - level)) END AS b, size
  FROM s, range(1, {2 * LEVELS + 1}) v(level)),
g AS (SELECT level, a, b, sum(size) AS n FROM l GROUP BY ALL),
e AS (SELECT level, a, b, n, sum(n) OVER (PARTITION BY level ORDER BY a, b) - n AS start FROM g),
w AS (SELECT k, (SELECT sum(size) FROM s) * k / {float(SHARDS)} AS wanted FROM range(1, {SHARDS}) v(k)),
m AS (SELECT k, wanted, level, max_by({{'a': a, 'b': b, 'n': n, 'start': start}}, start) AS i FROM w JOIN e ON start <= wanted GROUP BY ALL),
p AS (SELECT k, level, i, abs(i.start + i.n - wanted) < abs(i.start - wanted) AS behind, least(abs(i.start - wanted), abs(i.start + i.n - wanted)) AS miss FROM m),
q AS (SELECT k, min_by({{'level': level, 'i': i, 'behind': behind}}, level) AS f FROM p WHERE miss <= {TOLERANCE} * (SELECT sum(size) FROM s) / {SHARDS} OR level = {2 * LEVELS} GROUP BY k),
b AS (SELECT k, CASE WHEN f.level <= {LEVELS} THEN (f.i.a + CAST(f.behind AS INT)) << ({BITS} * ({LEVELS} - f.level)) ELSE f.i.a END AS k1,
  CASE WHEN f.level <= {LEVELS} THEN 0 ELSE (f.i.b + CAST(f.behind AS INT)) << ({BITS} * ({2 * LEVELS} - f.level)) END AS k2 FROM q),
r AS (SELECT s.doc_id, s.size, s.text_crc32, s.h1, s.h2, CAST((SELECT count(*) FROM b WHERE k1 < s.h1 OR (k1 = s.h1 AND k2 <= s.h2)) AS INT) AS shard FROM s)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, (row_number() OVER (PARTITION BY shard ORDER BY h2 % ((SELECT count(*) FROM s) // {SHARDS * PART_ROWS} + 1), h1, h2) - 1)::BIGINT AS slot,
  CAST(NULL AS INT) AS grown_shard FROM r
"""
