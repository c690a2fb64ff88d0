"""Exact n-gram Jaccard join by T-occurrence search over inverted lists.

A document is the set of its distinct word shingles; texts with equal sets are one node.  A pair of
similarity t shares at least T = ceil(t * n) of the n shingles of either side, so the T - k longest
lists of a node may be skipped: any partner has k or more of the remaining, short ones in common with
it.  Short lists are merged by one sort of their postings (the lists of frequent shingles, found as
heavy hitters in blocks of the corpus, come last in everybody's order and are hardly ever merged);
pairs with too few common entries fall out, and the others are decided by binary probes of the
skipped shingles.  Every order of the shingles gives the same result, so the heavy hitters are a
matter of speed alone.

Long lists that still are merged do not emit all their pairs.  Neighbours in a list are decided
first.  Lists above a fixed length that then still hold several components get a centre, the member that shares most with
the others, and every member is compared with it: near copies of one text meet in that text.  What is
left are pairs of which one side at least is not similar to the centre.  How many differences from the
centre two members share decides them exactly.  These are counted block against block within tasks:
pairs never become rows, neither sets nor pairs are shuffled, and a block gives fewer links than it
has members.  The arithmetic, a few operations for each pair of a group, is all that grows faster than the group.

Defined cases: null and empty texts, and texts without words, have no shingles and are linked with
nothing; fewer words than a shingle are one shingle; equal rows are in one component; a null id is
never the smallest; extra columns are not read.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspark.llm import arrays as A
from fieldspark.llm.common import arrow_type, drop, narrow, sql_type, tidy, written
from fieldspark.llm.components import components

WORDS = 5
PERCENT = 75
#: Shingles of a block of texts in which heavy hitters are counted; those in LOCAL or more of its texts are reported.
BLOCK = 2_000_000
LOCAL = 3
HOT = 24
#: Heavy hitters that are sent to the tasks; further ones only make lists longer.
HOT_ENTRIES = 200_000
#: Lists up to this length emit all their pairs.
SHORT = 6
#: Long lists in which two nodes must be neighbours to be decided first.
CLOSE = 4
#: Bands of long lists up to this length count their pairs, which are linear in the entries; longer ones get a centre.
MEDIUM = 32
#: Members of a block of a centre's group, differences of a block, columns of its dense products, and pairs counted at once.
GROUP = 2048
GROUP_ITEMS = 1 << 20
COLUMNS = 512
PAIRS = 1 << 20
#: Items in more than this part of a block are frequent there.
DENSE = 16
#: Long lists are cut into bands of set sizes of this ratio, above that of similar sets.
BAND = 1.4
#: Share of the shingles that is merged beyond the shortest sufficient prefix, to demand several common entries.
EXTRA = 10
#: Passes over the texts that merge the lists, each those of a part of the shingles: a pass shuffles that part only.
PASSES = 2
#: Parts of the nodes on either side of the pairs whose sets are compared at a time.
SLICES = 2
#: Bits of the node filter of the set scan.
FILTER_BITS = 1 << 26


def _sets(column: pa.Array):
    """(row, sorted distinct shingle hashes) of every text with words."""
    for i, _, data, offs in A.text_slices(column):
        w = A.words_of(data, offs, A.NONBLANK, lower=True)
        at, h = A.windows(w, WORDS, short=False)
        edge = np.searchsorted(w.doc[at], np.arange(len(w.count) + 1))
        for d in np.flatnonzero(w.count):
            if w.count[d] < WORDS:
                yield i + d, A.window_hash(w.hash, w.first[d:d + 1], int(w.count[d]))
            else:
                yield i + d, np.unique(h[edge[d]:edge[d + 1]])


def _node(shingles: np.ndarray) -> int:
    """64-bit signature of a set."""
    total = np.add.reduce(A.mix(shingles)) + A.U(len(shingles))
    return int(A.mix(np.array([total], A.U)).view(np.int64)[0])


def least_common(n: int) -> int:
    """Shingles that a partner shares at least with a set of n."""
    return -(-PERCENT * n // 100)


def merged_lists(n: int) -> tuple[int, int]:
    """How many of the n lists are merged, and how many entries a partner has in them at least."""
    t = least_common(n)
    k = min(t, 1 + n // EXTRA)
    return n - t + k, k


def profile(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Written rows of two kinds: documents (doc, text_hash, n, node), and heavy hitters of a block (hot, n)."""
    docs = docs.withColumn("__text_hash", F.xxhash64(docs[text_col]))
    docs = narrow(docs, doc=id_col, text=text_col, text_hash="__text_hash")
    schema = pa.schema([("doc", arrow_type(docs, "doc")), ("text_hash", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("hot", pa.int64())])

    def run(batches):
        pile, size, seen = [], 0, set()

        def heavy():
            h, c = np.unique(np.concatenate(pile), return_counts=True)
            h, c = h[c >= LOCAL], c[c >= LOCAL]
            none = pa.nulls(len(h))
            return pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip((none, none, pa.array(c), none, pa.array(h.view(np.int64))), schema)], schema=schema)

        for batch in batches:
            n, node = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for r, s in _sets(batch.column(1)):
                n[r], node[r] = len(s), _node(s)
                if node[r] not in seen:
                    seen.add(int(node[r]))
                    pile.append(s)
                    size += len(s)
                if size >= BLOCK:
                    yield heavy()
                    pile, size, seen = [], 0, set()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n), pa.array(node, mask=n == 0),
                                              pa.nulls(batch.num_rows, pa.int64())], schema=schema)
        if pile:
            yield heavy()

    return written(docs.mapInArrow(tidy(run), f"doc {sql_type(docs, 'doc')}, text_hash long, n long, node long, hot long"), "sets")


def _postings(docs: DataFrame, hot: np.ndarray, rank: np.ndarray, part: int) -> DataFrame:
    """(shingle, node) of one part of the lists that are merged; ``hot`` is sorted, ``rank`` orders it by frequency."""
    schema = pa.schema([("shingle", pa.int64()), ("node", pa.int64())])

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            out, nodes, sizes = [], [], []
            for _, s in _sets(batch.column(0)):
                node = _node(s)
                if node in seen:
                    continue
                seen.add(node)
                m, _ = merged_lists(len(s))
                if len(hot):
                    at = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
                    cold = hot[at] != s
                    if cold.sum() < m:
                        s = np.concatenate([s[cold], s[~cold][np.argsort(rank[at[~cold]], kind="stable")]])
                    else:
                        s = s[cold]
                s = s[:m]
                s = s[s % A.U(PASSES) == part]
                out.append(s)
                nodes.append(node)
                sizes.append(len(s))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64)), pa.array(np.repeat(np.array(nodes, np.int64), sizes))], schema=schema)

    return docs.select("text").mapInArrow(tidy(run), "shingle long, node long")


def _lists(postings: DataFrame) -> DataFrame:
    """The merged lists: pairs (a, b) of short ones, and entries (shingle, a, b = its neighbour) of long ones."""
    schema = pa.schema([("shingle", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])

    def emit(h, v, open_hash, open_node):
        """Whole runs of (h, v); the first one may go on a long run that was given out before."""
        start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        n = np.diff(np.r_[start, len(h)])
        long_run = n > SHORT
        if open_hash is not None and h[0] == open_hash:
            long_run[0] = True
        is_long = np.repeat(long_run, n)
        a, b = [], []
        for lag in range(1, SHORT):
            ok = (h[lag:] == h[:-lag]) & ~is_long[lag:]
            a.append(v[:-lag][ok])
            b.append(v[lag:][ok])
        a, b = np.concatenate(a), np.concatenate(b)
        head = np.r_[True, h[1:] != h[:-1]]
        before = np.r_[v[:1], v[:-1]]
        if open_hash is not None and h[0] == open_hash:
            before[0], head[0] = open_node, False
        return pa.RecordBatch.from_arrays([pa.array(np.r_[np.zeros(len(a), np.int64), h[is_long]], mask=np.r_[np.ones(len(a), bool), np.zeros(is_long.sum(), bool)]),
                                           pa.array(np.r_[a, v[is_long]]),
                                           pa.array(np.r_[b, before[is_long]], mask=np.r_[np.zeros(len(a), bool), head[is_long]])], schema=schema)

    def run(batches):
        h, v, open_hash, open_node = np.zeros(0, np.int64), np.zeros(0, np.int64), None, None
        for batch in batches:
            h = np.r_[h, batch.column(0).to_numpy()]
            v = np.r_[v, batch.column(1).to_numpy()]
            new = np.r_[True, (h[1:] != h[:-1]) | (v[1:] != v[:-1])][:len(h)]
            h, v = h[new], v[new]
            if open_hash is not None and len(h) and h[0] == open_hash and v[0] == open_node:
                h, v = h[1:], v[1:]
            if not len(h):
                continue
            cut = int(np.searchsorted(h, h[-1]))
            if len(h) - cut > SHORT or h[-1] == open_hash:
                cut = len(h)
            if cut:
                yield emit(h[:cut], v[:cut], open_hash, open_node)
                open_hash, open_node = (h[-1], v[-1]) if cut == len(h) else (None, None)
                h, v = h[cut:], v[cut:]
        if len(h):
            yield emit(h, v, open_hash, open_node)

    return postings.sortWithinPartitions("shingle", "node").mapInArrow(tidy(run), "shingle long, a long, b long")


def _node_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, set) of the wanted nodes and a few more: a bitmap of fixed size tells which texts to read again."""
    spot = F.pmod("node", F.lit(FILTER_BITS)) + 1  # Spark numbers buckets of 32768 bits from 1 for positive values
    maps = wanted.select(spot.alias("s")).groupBy(F.bitmap_bucket_number("s").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("m"))
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in maps.collect():
        bits[(row["k"] - 1) * 4096:row["k"] * 4096] = np.frombuffer(row["m"], np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    schema = pa.schema([("node", pa.int64()), ("set", pa.binary())])

    def run(batches):
        seen: set[int] = set()
        have = shared.value
        for batch in batches:
            nodes, sets = [], []
            for _, s in _sets(batch.column(0)):
                node = _node(s)
                spot = node % FILTER_BITS
                if node not in seen and have[spot // 8] >> (spot % 8) & 1:
                    seen.add(node)
                    nodes.append(node)
                    sets.append(s.tobytes())
            if nodes:
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], schema=schema)

    return docs.select("text").mapInArrow(tidy(run), "node long, set binary").groupBy("node").agg(F.first("set").alias("set"))


def _linked(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Written pairs (a, b) whose sets are similar enough, by probing the smaller in the larger."""
    pairs = written(pairs.select("a", "b").distinct(), "pairs")
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(SLICES))
    # in which parts a node has partners b, and a: only these comparisons get its set
    partners = (pairs.select(F.col("a").alias("node"), part("b").alias("with_b"), F.lit(None).cast("long").alias("with_a"))
                .union(pairs.select(F.col("b"), F.lit(None).cast("long"), part("a")))
                .groupBy("node").agg(F.collect_set("with_b").alias("with_b"), F.collect_set("with_a").alias("with_a")))
    sets = written(_node_sets(docs, partners).join(partners, "node"), "sets")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for r, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = np.frombuffer(x.as_py(), A.U), np.frombuffer(y.as_py(), A.U)
                x, y = (x, y) if len(x) <= len(y) else (y, x)
                common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                keep[r] = 100 * common >= PERCENT * (len(x) + len(y) - common)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], schema=schema)

    def compared(i, j):
        """The similar ones of the pairs between two parts of the nodes."""
        sa = sets.where((part("node") == i) & F.array_contains("with_b", F.lit(j).cast("long"))).select(F.col("node").alias("a"), F.col("set").alias("sa"))
        sb = sets.where((part("node") == j) & F.array_contains("with_a", F.lit(i).cast("long"))).select(F.col("node").alias("b"), F.col("set").alias("sb"))
        both = pairs.where((part("a") == i) & (part("b") == j)).join(sa, "a").join(sb, "b").select("a", "b", "sa", "sb")
        return both.mapInArrow(tidy(run), "a long, b long")

    first, *more = (compared(i, j) for i in range(SLICES) for j in range(SLICES))
    out = written(first, "links", *more)
    drop(pairs, sets)
    return out


def _open_lists(entries: DataFrame, links: DataFrame, sizes: DataFrame) -> DataFrame:
    """Written entries (shingle, band, length, node, n, own, root) of the lists that hold nodes of several components.

    A list is cut into bands of sizes; a node is in its own band and the next, so two nodes whose sizes fit
    meet in the larger of their own bands.
    """
    root = components(links)
    placed = (entries.join(sizes, "node").join(root, "node", "left")
              .withColumn("own", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(BAND))))
              .select("shingle", "node", "n", "own", F.coalesce("root", "node").alias("root"), F.explode(F.array(F.col("own"), F.col("own") + 1)).alias("band")))
    mixed = (placed.groupBy("shingle", "band").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("length"))
             .where("lo <> hi").select("shingle", "band", "length"))
    out = written(placed.join(mixed, ["shingle", "band"]), "open")
    drop(root)
    return out


def _pairs_of_lists(placed: DataFrame) -> DataFrame:
    """(a, b, na, nb, c): nodes of different components with the number of lists in which they meet."""
    side = lambda x: placed.select("shingle", "band", F.col("node").alias(x), *(F.col(c).alias(c + x) for c in ("n", "own", "root")))
    meet = (F.col("a") < F.col("b")) & (F.col("roota") != F.col("rootb")) & (F.col("band") == F.greatest("owna", "ownb"))
    fit = PERCENT * F.greatest("na", "nb") <= 100 * F.least("na", "nb")
    return side("a").join(side("b"), ["shingle", "band"]).where(meet & fit).groupBy("a", "b", "na", "nb").agg(F.count("*").alias("c"))


def _centres(placed: DataFrame) -> DataFrame:
    """(node, centre): the members of every band of a list with that member whose lists are longest in sum."""
    score = placed.groupBy("node").agg(F.sum("length").alias("score"))
    centre = (placed.join(score, "node").groupBy("shingle", "band").agg(F.max(F.struct("score", "node")).alias("top"))
              .select("shingle", "band", F.col("top.node").alias("centre")))
    return placed.join(centre, ["shingle", "band"]).where("node <> centre").select("node", "centre").distinct()


def _residuals(docs: DataFrame, members: DataFrame) -> DataFrame:
    """Written rows of (node, centre): whether they are linked, the sizes n and n_centre, how many shingles of the
    centre the node lacks, and its differences from the centre (additions as they are, what is lacking inverted)."""
    members = written(members, "members")
    sets = written(_node_sets(docs, members.select(F.explode(F.array("node", "centre")).alias("node"))), "sets")
    both = (members.join(sets.select("node", F.col("set").alias("x")), "node")
            .join(sets.select(F.col("node").alias("centre"), F.col("set").alias("c")), "centre").select("node", "centre", "x", "c"))
    schema = pa.schema([("node", pa.int64()), ("centre", pa.int64()), ("linked", pa.bool_()), ("n", pa.int64()), ("n_centre", pa.int64()),
                        ("lacking", pa.int64()), ("items", pa.binary())])

    def run(batches):
        for batch in batches:
            linked, n, n_centre, lacks, items = [], [], [], [], []
            for x, c in zip(batch.column(2), batch.column(3)):
                x, c = np.frombuffer(x.as_py(), A.U), np.frombuffer(c.as_py(), A.U)
                added, lacking = np.setdiff1d(x, c, assume_unique=True), np.setdiff1d(c, x, assume_unique=True)
                common = len(c) - len(lacking)
                linked.append(100 * common >= PERCENT * (len(x) + len(c) - common))
                n.append(len(x))
                n_centre.append(len(c))
                lacks.append(len(lacking))
                items.append(np.concatenate([added, ~lacking]).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(v, f.type) for v, f in zip((linked, n, n_centre, lacks, items), list(schema)[2:]))], schema=schema)

    out = written(both.mapInArrow(tidy(run), "node long, centre long, linked boolean, n long, n_centre long, lacking long, items binary"), "residuals")
    drop(members, sets)
    return out


def shared_items(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """[left, right]: how many items two sorted or unsorted sets of distinct items share."""
    out = np.zeros((len(left), len(right)), np.int32)
    item, of = np.concatenate([*left, *right]), np.repeat(np.arange(len(left) + len(right)), [len(x) for x in (*left, *right)])
    order = np.argsort(item, kind="stable")
    item, of = item[order], of[order]
    edge = np.flatnonzero(np.r_[True, item[1:] != item[:-1], True]) if len(item) else np.zeros(1, np.int64)
    lo, hi = edge[:-1], edge[1:]
    mid = lo + np.add.reduceat((of < len(left)).astype(np.int64), lo) if len(lo) else lo  # those of the left come first
    met = (mid > lo) & (hi > mid)
    lo, mid, hi = lo[met], mid[met], hi[met]
    many = hi - lo > max(2, len(out) // DENSE, len(out.T) // DENSE)
    for a in range(0, int(many.sum()), COLUMNS):  # frequent items: products of matrices of zeros and ones
        l, m, h = (x[many][a:a + COLUMNS] for x in (lo, mid, hi))
        sides = []
        for begin, end, size, base in ((l, m, len(left), 0), (m, h, len(right), len(left))):
            column = np.repeat(np.arange(len(begin)), end - begin)
            at = np.arange(len(column)) - np.repeat(np.cumsum(end - begin) - (end - begin), end - begin) + np.repeat(begin, end - begin)
            table = np.zeros((size, len(begin)), np.float32)
            table[of[at] - base, column] = 1
            sides.append(table)
        out += (sides[0] @ sides[1].T).astype(np.int32)
    flat = out.reshape(-1)
    lo, mid, hi = lo[~many], mid[~many], hi[~many]
    work = np.cumsum((mid - lo) * (hi - mid))
    for a, b in _steps(work, PAIRS):  # rare ones: their pairs are counted, some at a time
        l, m, h = lo[a:b], mid[a:b], hi[a:b]
        size = (m - l) * (h - m)
        k = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        width = np.repeat(h - m, size)
        x, y = of[np.repeat(l, size) + k // width], of[np.repeat(m, size) + k % width] - len(left)
        cell, times = np.unique(x * len(right) + y, return_counts=True)
        flat[cell] += times.astype(np.int32)
    return out


def _steps(work: np.ndarray, most: int):
    """Runs of items with about ``most`` work each, from its running sums."""
    a = 0
    while a < len(work):
        b = max(a + 1, int(np.searchsorted(work, (work[a - 1] if a else 0) + most, "right")))
        yield a, b
        a = b


def _residual_links(stars: DataFrame, links: DataFrame) -> DataFrame:
    """Written links (a, b) between members of one centre that lie in different components, as few as connect the same ones.

    With o differences from the centre c in common, x and y share |c| - |Dx| - |Dy| + o shingles, where D is what they
    lack of c; so the differences alone decide every pair.  A group is dealt into blocks, and a task has two of them:
    its pairs are counted there and never become rows, and what comes out are fewer links than members.
    """
    root = components(links)
    placed = stars.join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    blocks = F.ceil(F.greatest(F.count("*") / GROUP, F.sum(F.octet_length("items")) / 8 / GROUP_ITEMS)).cast("int")
    groups = (placed.groupBy("centre").agg(blocks.alias("blocks"), F.min("root").alias("lo"), F.max("root").alias("hi"))
              .where("lo <> hi").select("centre", "blocks"))
    own = placed.join(groups, "centre").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    cells = own.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).select(
        "centre", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "root", "n", "n_centre", "lacking", "items")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(cell: pa.Table) -> pa.Table:
        i, j, own, node, root, n, n_centre, lacking = (cell[c].to_numpy() for c in ("i", "j", "own", "node", "root", "n", "n_centre", "lacking"))
        items = [np.frombuffer(x.as_py(), A.U) for x in cell["items"]]
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        a, b = [], []
        if len(left) and len(right):
            group = np.unique(root, return_inverse=True)[1]
            common = shared_items([items[k] for k in left], [items[k] for k in right])
            for k, x in enumerate(left):
                both = n_centre[x] - lacking[x] - lacking[right] + common[k]
                near = right[100 * both >= PERCENT * (n[x] + n[right] - both)]
                new, at = np.unique(group[near], return_index=True)
                at = at[new != group[x]]
                a += [node[x]] * len(at)
                b += node[near[at]].tolist()
                if len(at):
                    group[np.isin(group, new)] = group[x]
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)

    out = written(cells.groupBy("centre", "i", "j").applyInArrow(run, "a long, b long"), "links")
    drop(root)
    return out


def node_links(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Written links (a, b) that connect exactly the components of all similar pairs of nodes."""
    found = (rows.where("hot IS NOT NULL").groupBy("hot").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT)
             .orderBy(F.desc("n"), "hot").limit(HOT_ENTRIES).collect())
    hot = np.array([r["hot"] for r in found], np.int64).view(A.U)
    order = np.argsort(hot)
    hot, rank = hot[order], np.array([r["n"] for r in found], np.int64)[order]
    lists, *more = (_lists(_postings(docs, hot, rank, part).repartition(F.col("shingle"))) for part in range(PASSES))
    lists = written(lists, "lists", *more)

    sizes = rows.where("node IS NOT NULL").groupBy("node").agg(F.first("n").alias("n"))
    na, nb = sizes.select(F.col("node").alias("a"), F.col("n").alias("na")), sizes.select(F.col("node").alias("b"), F.col("n").alias("nb"))
    fit = PERCENT * F.greatest("na", "nb") <= 100 * F.least("na", "nb")

    def kept_back(n):
        """Shingles of a node that are not merged."""
        t = F.floor((PERCENT * F.col(n) + 99) / 100)
        return t - F.least(t, 1 + F.floor(F.col(n) / EXTRA))

    # similar sets share so many; what is not merged holds the rest at most, and the first of them are merged on both sides
    common = F.ceil(PERCENT * (F.col("na") + F.col("nb")) / (100 + PERCENT))
    least = F.greatest(F.lit(1), common - F.greatest(kept_back("na"), kept_back("nb")))
    counted = written(lists.where("shingle IS NULL").groupBy("a", "b").agg(F.count("*").alias("c")), "pairs")
    sized = written(counted.join(na, "a").join(nb, "b").where(fit)
                    .select("a", "b", "c", least.alias("k")), "pairs")
    entries = lists.where("shingle IS NOT NULL")
    chain = (entries.where("b IS NOT NULL").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
             .groupBy("a", "b").agg(F.count("*").alias("c")).where(F.col("c") >= CLOSE).join(na, "a").join(nb, "b").where(fit))
    first = _linked(docs, chain.select("a", "b").union(sized.where("c >= k").select("a", "b")))
    if entries.isEmpty():
        drop(lists, counted, sized)
        return first
    placed = _open_lists(entries.select("shingle", F.col("a").alias("node")), first, sizes)
    # a pair that meets in no list above MEDIUM is counted in all lists it shares
    cross = _pairs_of_lists(placed.where(F.col("length") <= MEDIUM)).select("a", "b", "c", least.alias("k"))
    rest = written(cross.union(sized.where("c < k")).groupBy("a", "b").agg(F.sum("c").alias("c"), F.first("k").alias("k")).where("c >= k").select("a", "b"), "rest")
    drop(lists, counted, sized)
    stars = _residuals(docs, _centres(placed.where(F.col("length") > MEDIUM)))
    drop(placed)
    near = stars.where("linked").select(F.col("node").alias("a"), F.col("centre").alias("b"))
    found = written(first.union(near), "links")
    of_groups = _residual_links(stars, found)
    drop(first, stars)
    of_pairs = _linked(docs, rest)
    links = written(found.union(of_groups).union(of_pairs), "links")
    drop(rest, found, of_groups, of_pairs)
    return links


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, n_shingles and component_id of every row, and the signature ``grp`` of its component."""
    rows = profile(docs, id_col, text_col)
    links = node_links(narrow(docs, text=text_col), rows)
    root = components(links)
    placed = rows.where("hot IS NULL").join(root, "node", "left").select(
        F.col("doc").alias("doc_id"), "text_hash", F.col("n").alias("n_shingles"), F.coalesce("root", "node").alias("grp"))
    placed = written(placed, "placed")
    drop(rows, links, root)
    least = placed.where("grp IS NOT NULL").groupBy("grp").agg(F.min("doc_id").alias("component_id"))
    return placed.join(least, "grp", "left").select("doc_id", "text_hash", "n_shingles",
                                                    F.when(F.col("grp").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "grp")


def digest(groups: DataFrame) -> DataFrame:
    return groups.select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each component that with the smallest id, once; texts without words all stay."""
    groups = written(jaccard_groups(docs, id_col, text_col), "groups")
    first = groups.where("grp IS NOT NULL").groupBy("grp").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first"), )
    keys = first.select(F.col("first.doc_id").alias("__id"), F.col("first.text_hash").alias("__hash"))
    many = groups.groupBy("doc_id", "text_hash").agg(F.count("*").alias("rows"))
    keys = keys.join(many, F.col("__id").eqNullSafe(F.col("doc_id")) & (F.col("__hash") == F.col("text_hash"))).select("__id", "__hash", "rows")
    same = docs[id_col].eqNullSafe(F.col("__id")) & (F.xxhash64(docs[text_col]) == F.col("__hash"))
    wordless = groups.where("grp IS NULL").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    once = docs.join(keys.where("rows = 1").select("__id", "__hash").union(wordless), same, "left_semi")
    several = docs.join(keys.where("rows > 1"), same, "left_semi")
    return once.union(several.dropDuplicates([id_col, text_col]))


SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
o AS (SELECT x.r AS a, y.r AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.r <> y.r GROUP BY 1, 2),
e AS (SELECT a, b FROM o JOIN n na ON na.r = a JOIN n nb ON nb.r = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
t(a, b) AS (SELECT a, b FROM e UNION SELECT t.a, e.b FROM t JOIN e ON t.b = e.a),
m AS (SELECT t.a AS r, min(d.doc_id) AS least_id FROM t JOIN d ON d.r = t.b GROUP BY 1)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(least(doc_id, least_id), doc_id) AS component_id FROM d LEFT JOIN n USING (r) LEFT JOIN m USING (r)
"""
