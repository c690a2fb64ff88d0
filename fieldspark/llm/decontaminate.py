"""Benchmark decontamination over a distributed positional inverted index.

The index is partitioned by document: each row of the written table is a shard of some megabytes of
text with the sorted postings (word position) of its terms, so building it shuffles nothing.  A
search takes the document frequency of the test terms from the index, and in each shard intersects
the offset-adjusted postings of every test window from its rarest term to its most common one.

Terms are kept for the words of the tests alone (no other word can take part in a match) while
these stay below ``TEST_BYTES``; larger test sets get a full index and are searched in blocks.

Defined cases: a null or empty text has no words and no hits; a null item id is no item; equal rows
give equal results; an item without words has no window; an item of fewer words than the window is
one window; extra columns of either table are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspark.llm import arrays as A
from fieldspark.llm.common import arrow_type, narrow, sql_type, tidy, written

WINDOW = 13
#: Words within which a proximity match has all words of a window, on either side of its rarest one.
REACH = 26
TEST_BYTES = 32 << 20
SHARD_BYTES = 3 << 18
GAP = 64  # positions left free between documents, more than REACH
STRIDE = 1 << 32


def _words(column: pa.Array) -> Iterator[tuple[int, int, A.Words]]:
    for i, j, data, offs in A.text_slices(column, SHARD_BYTES):
        yield i, j, A.words_of(data, offs, A.ALNUM, lower=True)


def build_index(docs: DataFrame, terms: np.ndarray | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Written table of shards: documents, their lengths, and the postings of ``terms`` (None: of all terms)."""
    docs = narrow(docs, doc=id_col, text=text_col)
    schema = pa.schema([("docs", pa.list_(arrow_type(docs, "doc"))), ("lengths", pa.binary()), ("terms", pa.binary()),
                        ("ends", pa.binary()), ("positions", pa.binary())])

    def shards(batches):
        for batch in batches:
            ids = batch.column(0)
            for i, j, w in _words(batch.column(1)):
                h = w.hash
                pos = np.arange(len(h)) + GAP * w.doc
                if terms is not None:
                    at = np.minimum(np.searchsorted(terms, h), max(0, len(terms) - 1))
                    keep = terms[at] == h if len(terms) else np.zeros(len(h), bool)
                    h, pos = h[keep], pos[keep]
                order = np.argsort(h, kind="stable")
                h, pos = h[order], pos[order]
                head = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
                ends = np.r_[head[1:], len(h)] if len(h) else head
                yield A.batch_of(schema, docs=pa.array([ids.slice(i, j - i).to_pylist()], schema.field("docs").type),
                                 lengths=[w.count.astype(np.int64).tobytes()], terms=[h[head].tobytes()],
                                 ends=[ends.astype(np.int64).tobytes()], positions=[pos.astype(np.int64).astype(np.uint32).tobytes()])

    return written(docs.mapInArrow(tidy(shards), f"docs array<{sql_type(docs, 'doc')}>, lengths binary, terms binary, "
                                           "ends binary, positions binary"), "positions")


def term_counts(index: DataFrame, terms: np.ndarray) -> np.ndarray:
    """Occurrences in the whole index of each of the (bounded, sorted) test terms."""

    def sums(batches):
        total = np.zeros(len(terms), np.int64)
        for batch in batches:
            for t, e in zip(batch.column(0), batch.column(1)):
                t, n = np.frombuffer(t.as_py(), A.U), np.diff(np.frombuffer(e.as_py(), np.int64), prepend=0)
                at = np.searchsorted(terms, t)
                ok = at < len(terms)
                ok[ok] = terms[at[ok]] == t[ok]
                total[at[ok]] += n[ok]
        has = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(total[has])], ["term", "n"])

    out = np.zeros(len(terms), np.int64)
    if len(terms):
        for row in index.select("terms", "ends").mapInArrow(tidy(sums), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
            out[row["term"]] = row["n"]
    return out


def test_blocks(tests: DataFrame, id_col: str, text_col: str) -> tuple[list[DataFrame], bool]:
    """The test items in blocks of at most about TEST_BYTES, and whether one block holds all of them."""
    tests = narrow(tests, item=id_col, text=text_col).where(F.col("item").isNotNull() & F.col("text").isNotNull())
    size = tests.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = max(1, -(-size // TEST_BYTES))
    if n == 1:
        return [tests], True
    n *= 2  # blocks by hash are not all alike
    part = F.pmod(F.xxhash64("item", "text"), F.lit(n))
    return [tests.where(part == k) for k in range(n)], False


class Windows:
    """The windows of one block of test items, term numbers in the order of rising frequency."""

    def __init__(self, block: DataFrame, window: int):
        rows = block.select(F.col("item").cast("string").alias("item"), "text").collect()
        texts = pa.array([r["text"] for r in rows], pa.string())
        items, spans, hashes = [], [], []
        for i, _, w in _words(texts):
            for d in range(len(w.count)):
                n, f = int(w.count[d]), int(w.first[d])
                size = min(n, window)
                for s in range(f, f + n - size + 1) if n else ():
                    items.append(rows[i + d]["item"])
                    spans.append((len(hashes), size))
                    hashes.append(w.hash[s:s + size])
        self.names = sorted(set(items))
        number = {x: k for k, x in enumerate(self.names)}
        self.item = np.array([number[x] for x in items], np.int64)
        self.size = np.array([n for _, n in spans], np.int64)
        self.terms = np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, A.U)
        self.window = window
        self.flat = [np.searchsorted(self.terms, h) for h in hashes]

    def rank(self, counts: np.ndarray) -> None:
        """Order the terms of each window by their frequency in the index."""
        n = len(self.flat)
        self.term = np.full((n, self.window), -1, np.int64)
        self.offset = np.zeros((n, self.window), np.int64)
        for k, t in enumerate(self.flat):
            order = np.argsort(counts[t], kind="stable")
            self.term[k, :len(t)], self.offset[k, :len(t)] = t[order], order


def _matches(q: Windows, keys: np.ndarray, head: np.ndarray, tail: np.ndarray, reach: int) -> tuple[np.ndarray, ...]:
    """Exact matches (window, start) and windows with the position of a proximity match, in one shard."""
    n = tail[q.term[:, 0]] - head[q.term[:, 0]]
    win = np.repeat(np.arange(len(n)), n)
    nth = np.arange(len(win)) - np.repeat(np.cumsum(n) - n, n)
    anchor = keys[head[q.term[win, 0]] + nth] % STRIDE
    exact, start = win, anchor - q.offset[win, 0]
    near, centre = win, anchor
    for j in range(1, q.window):
        if len(exact):
            t = q.term[exact, j]
            want = t * STRIDE + start + q.offset[exact, j]
            at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
            ok = (t < 0) | (keys[at] == want)
            exact, start = exact[ok], start[ok]
        if len(near):
            t = q.term[near, j]
            at = np.minimum(np.searchsorted(keys, t * STRIDE + np.maximum(centre - reach, 0)), len(keys) - 1)
            ok = (t < 0) | ((keys[at] >= t * STRIDE) & (keys[at] <= t * STRIDE + centre + reach))
            near, centre = near[ok], centre[ok]
    return exact, start, near, centre


def search(index: DataFrame, blocks: list[DataFrame], window: int = WINDOW, reach: int = REACH) -> DataFrame:
    """One row per document: its length, the words inside exact matches, and the matched items.

    ``hits`` are the merged word spans of exact matches, ``items`` the ids with an exact match and
    ``near_items`` those with all words of a window within ``reach`` words of its rarest one.
    """
    id_type = index.schema["docs"].dataType.elementType.simpleString()
    pair = "array<struct<doc: long, item: string>>"
    schema = (f"docs array<{id_type}>, lengths binary, terms binary, ends binary, positions binary, "
              f"hit binary, exact {pair}, near {pair}")
    frame = index.select("*", F.lit(None).cast("binary").alias("hit"), F.array().cast(pair).alias("exact"),
                         F.array().cast(pair).alias("near"))
    report = _report(arrow_type(index, "docs").value_type)
    out = (f"doc_id {id_type}, n_words long, n_hit long, hits array<struct<start: long, length: long>>, "
           "items array<string>, near_items array<string>")
    for k, block in enumerate(blocks):
        q = Windows(block, window)
        q.rank(term_counts(index, q.terms))
        last = k == len(blocks) - 1
        frame = frame.mapInArrow(tidy(_then(_probe(q, reach), report) if last else _probe(q, reach)), out if last else schema)
    return frame


def _then(first, second):
    return lambda batches: second(first(batches))


def _probe(q: Windows, reach: int):
    def run(batches):
        for batch in batches:
            cols = {f.name: batch.column(k) for k, f in enumerate(batch.schema)}
            hit, exact, near = [], cols["exact"].to_pylist(), cols["near"].to_pylist()
            for r in range(batch.num_rows):
                lengths = np.frombuffer(cols["lengths"][r].as_py(), np.int64)
                base = np.cumsum(lengths) - lengths + GAP * np.arange(len(lengths))
                mask = np.zeros(int(base[-1] + lengths[-1]) if len(lengths) else 0, bool)
                if (before := cols["hit"][r].as_py()) is not None:
                    mask = np.unpackbits(np.frombuffer(before, np.uint8), count=len(mask)).astype(bool)
                terms = np.frombuffer(cols["terms"][r].as_py(), A.U)
                if len(terms) and len(q.terms):
                    ends = np.frombuffer(cols["ends"][r].as_py(), np.int64)
                    n = np.diff(ends, prepend=0)
                    at = np.minimum(np.searchsorted(q.terms, terms), len(q.terms) - 1)
                    known = q.terms[at] == terms
                    keys = (np.repeat(at, n) * STRIDE + np.frombuffer(cols["positions"][r].as_py(), np.uint32))[np.repeat(known, n)]
                    edge = np.searchsorted(keys, np.arange(len(q.terms) + 1) * STRIDE)
                    if len(keys):
                        win, start, nwin, centre = _matches(q, keys, edge[:-1], edge[1:], reach)
                        step = np.zeros(len(mask) + 1, np.int64)
                        np.add.at(step, start, 1)
                        np.add.at(step, start + q.size[win], -1)
                        mask |= np.cumsum(step)[:-1] > 0
                        for found, w, p in ((exact, win, start), (near, nwin, centre)):
                            d = np.searchsorted(base, p, "right") - 1
                            pairs = np.unique(np.stack([d, q.item[w]], 1), axis=0) if len(w) else []
                            found[r] += [{"doc": int(x), "item": q.names[y]} for x, y in pairs]
                hit.append(np.packbits(mask).tobytes())
            out = [*batch.columns[:5], pa.array(hit, pa.binary()), pa.array(exact, batch.schema.field("exact").type),
                   pa.array(near, batch.schema.field("near").type)]
            yield pa.RecordBatch.from_arrays(out, [f.name for f in batch.schema])

    return run


def _report(id_type: pa.DataType):
    schema = pa.schema([("doc_id", id_type), ("n_words", pa.int64()), ("n_hit", pa.int64()),
                        ("hits", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))),
                        ("items", pa.list_(pa.string())), ("near_items", pa.list_(pa.string()))])

    def run(batches):
        for batch in batches:
            cols = {f.name: batch.column(k) for k, f in enumerate(batch.schema)}
            for r in range(batch.num_rows):
                lengths = np.frombuffer(cols["lengths"][r].as_py(), np.int64)
                base = np.cumsum(lengths) - lengths + GAP * np.arange(len(lengths))
                mask = np.unpackbits(np.frombuffer(cols["hit"][r].as_py(), np.uint8)) if len(lengths) else np.zeros(0, np.uint8)
                n_hit = A.by_doc(mask, np.r_[base, len(mask)])
                edge = np.flatnonzero(np.diff(mask.astype(np.int8), prepend=np.int8(0), append=np.int8(0)))
                hits, items, near = [[] for _ in lengths], [set() for _ in lengths], [set() for _ in lengths]
                for s, e in zip(edge[0::2].tolist(), edge[1::2].tolist()):
                    d = int(np.searchsorted(base, s, "right")) - 1
                    hits[d].append({"start": s - int(base[d]), "length": e - s})
                for found, name in ((items, "exact"), (near, "near")):
                    for p in cols[name][r].as_py():
                        found[p["doc"]].add(p["item"])
                yield A.batch_of(schema, doc_id=cols["docs"][r].values if cols["docs"][r].values is not None else pa.array([], id_type),
                                 n_words=lengths, n_hit=n_hit, hits=hits, items=[sorted(x) for x in items], near_items=[sorted(x) for x in near])

    return run


def decontaminate(docs: DataFrame, tests: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  test_text_col: str = "text", window: int = WINDOW, reach: int = REACH) -> DataFrame:
    """Index ``docs`` and search every window of ``tests`` in it: see :func:`search` for the columns."""
    blocks, whole = test_blocks(tests, item_col, test_text_col)
    terms = Windows(blocks[0], window).terms if whole else None
    return search(build_index(docs, terms, id_col, text_col), blocks, window, reach)


def without_contaminated(docs: DataFrame, tests: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", test_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not contaminated; rows are told apart by id and text."""
    key = F.struct(docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("hash"))
    found = decontaminate(docs.select(key.alias("key"), docs[text_col].alias("text")), tests, "key", "text", item_col, test_text_col)
    bad = written(found.where(contaminated()).select("doc_id.id", "doc_id.hash").distinct(), "contaminated")
    return docs.join(bad, docs[id_col].eqNullSafe(bad["id"]) & (F.xxhash64(docs[text_col]) == bad["hash"]), "left_anti")


def contaminated() -> F.Column:
    return (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))


def digest(found: DataFrame) -> DataFrame:
    """The digest columns of a search."""
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), contaminated().alias("contaminated"),
                        F.size("near_items").cast("long").alias("n_near_items"))


SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS g FROM (SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, n, s, array_to_string(w[s:s + n - 1], ' ') AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT r, s, dw.n, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM m) GROUP BY r),
i AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM m GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN i USING (r)
"""
