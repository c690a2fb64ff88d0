"""Toxicity by weak supervision.

Many weak voters look at a text: counts of words from general lexicons of abuse, patterns of shouting
and insult, word lists mined from the labelled training rows, and voters for clean text.  Each votes
toxic, clean or abstains.  A generative label model learns from the votes alone how often each voter
casts which vote on toxic and on clean texts: the different vote patterns are counted over all documents,
one aggregation, and expectation and maximisation run on these counts.  Voters that vote together more
than the class explains are correlated and share their weight in the posterior.  A linear classifier on
hashed words and the voters' counts is fitted on the posteriors of a bounded sample of rows and scores
every text.

Labels, language, source and id are no inputs of a score.  Labels are read of rows with
``crc32(doc_id) % 5 <> 0`` alone, to mine word lists and to estimate the share of toxic rows.

Defined cases: null, empty and wordless texts have no votes and get the score of the classifier's
constant; equal texts get equal scores; a null id is never held out; without labels the mined lists
are empty and the share of toxic rows is ``PRIOR``; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspark.llm import arrays as A
from fieldspark.llm.common import arrow_type, narrow, sql_type, tidy, written

#: General word lists of abuse, by kind.
LEXICONS = {
    "insult": "idiot idiots idiotic moron morons moronic stupid dumb imbecile fool fools loser losers clown clowns cretin dimwit halfwit jerk",
    "contempt": "scum trash garbage filth vermin worthless pathetic disgusting disgrace useless repulsive vile despicable pig pigs",
    "threat": "kill shoot stab burn beat hurt destroy murder rape",
    "profane": "damn shit shitty crap fuck fucking fucker bastard bitch asshole bullshit ass dick piss whore slut",
    "hate": "hate hates hated loathe despise detest subhuman savages parasite parasites",
    "mocking": "ugly fat lazy coward liar liars creep freak weirdo psycho crazy ridiculous laughable shut",
    "german": "idiot dumm dumme dummkopf trottel depp arschloch scheiße scheisse abschaum wertlos hure drecksau mistkerl",
    "french": "idiot imbécile stupide connard connasse salaud salope merde ordure crétin débile pute",
    "spanish": "idiota imbécil estúpido estúpida tonto mierda cabrón puta basura asqueroso inútil pendejo",
}
PRIOR = 0.05
#: Mined words: in so many toxic training rows, such a share of the rows that have them, before so many
#: different words for each row (copies of one toxic text teach nothing); so many at most, of so many candidates.
MINED_ROWS, MINED_SHARE, MINED_SPREAD, MINED_WORDS, MINED_TRIED = 8, 0.75, 0.5, 200, 5000
#: Listed words that so many training rows have are dropped if less than this share of these rows is toxic.
VET_ROWS, VET_SHARE = 20, 0.5
#: Pairs of (row, word) that a task counts before it merges them, and then sends them if most are different words.
WORDS_HELD = 4_000_000
#: Steps of the label model, if it does not rest before.
STEPS = 500
#: Rows of the classifier's sample, about, of each likely class, by the least hashes of their texts; its hashed words.
SAMPLE = 4000
BUCKETS = 1 << 16
EPOCHS = 60
VOTERS = [*LEXICONS, "several_lists", "many_hits", "dense", "mined_a", "mined_b", "shouted", "no_hit", "long_clean"]
M = len(VOTERS)


def _hashes(words: list[str]) -> np.ndarray:
    column = pa.array([" ".join(words)])
    return next(A.words_of(d, o, A.ALNUM, lower=True).hash for _, _, d, o in A.text_slices(column)) if words else np.zeros(0, A.U)


def _member(h: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(h), bool)
    return table[np.minimum(np.searchsorted(table, h), len(table) - 1)] == h


class Voters:
    """Votes of all voters on the documents of a slice; ``mined`` are two halves of the mined words, ``dropped`` listed ones."""

    def __init__(self, mined: tuple[list[int], list[int]], dropped: list[int]):
        out = np.array(dropped, np.int64).view(A.U)
        self.lists = [np.setdiff1d(_hashes(words.split()), out) for words in LEXICONS.values()]
        self.mined = [np.unique(np.array(m, np.int64).view(A.U)) for m in mined]

    def votes(self, w: A.Words, shouted: np.ndarray) -> np.ndarray:
        docs = len(w.count)
        hits = [np.bincount(w.doc[_member(w.hash, t)], minlength=docs) for t in (*self.lists, *self.mined)]
        lex, mined = np.stack(hits[:len(self.lists)]), hits[len(self.lists):]
        total, kinds = lex.sum(0), (lex > 0).sum(0)
        rate = total / np.maximum(w.count, 1)
        any_hit = total + mined[0] + mined[1] > 0
        out = np.zeros((docs, M), np.int8)
        for k in range(len(self.lists)):
            out[:, k] = lex[k] >= 2
        k = len(self.lists)
        out[:, k] = kinds >= 2
        out[:, k + 1] = total >= 4
        out[:, k + 2] = (rate > 0.01) & (total >= 2)
        out[:, k + 3] = mined[0] >= 2
        out[:, k + 4] = mined[1] >= 2
        out[:, k + 5] = shouted & (total >= 1)
        out[:, k + 6] = np.where(any_hit, 0, -1)
        out[:, k + 7] = np.where((w.count >= 100) & (total <= 1) & (mined[0] + mined[1] <= 1), -1, 0)
        out[w.count == 0] = 0
        return out


def _slices(column: pa.Array):
    for i, j, data, offs in A.text_slices(column):
        w = A.words_of(data, offs, A.ALNUM, lower=True)
        marks = np.bincount(np.searchsorted(w.bounds, np.flatnonzero(w.data == 33), "right") - 1, minlength=j - i)
        yield i, j, w, marks >= 3


def mined_words(labelled: DataFrame) -> tuple[tuple[list[int], list[int]], list[int]]:
    """Words of toxic training rows (columns text, toxic), in two halves by their hash; listed words that are common in clean rows."""

    def flushed(tables):
        """The tables of some batches as one: a word, its rows, its toxic rows."""
        words, inverse = np.unique(np.concatenate([t[0] for t in tables]), return_inverse=True)
        return [words, *[np.bincount(inverse, weights=np.concatenate([t[k] for t in tables])).astype(np.int64) for k in (1, 2)]]

    def count(batches):
        tables, held = [], 0
        for batch in batches:
            toxic = np.array(batch.column(1).to_pylist(), np.int64)
            for i, j, w, _ in _slices(batch.column(0)):
                pair = np.unique(np.stack([w.doc.astype(A.U), w.hash]), axis=1)
                tables.append((pair[1], np.ones(pair.shape[1]), toxic[i + pair[0].astype(np.int64)]))
                held += pair.shape[1]
            if held > WORDS_HELD and tables:
                tables = [flushed(tables)]
                held = 2 * len(tables[0][0])
                if held > WORDS_HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(tables[0][0].view(np.int64)), *map(pa.array, tables[0][1:])], ["word", "n", "t"])
                    tables, held = [], 0
        if tables:
            table = flushed(tables)
            yield pa.RecordBatch.from_arrays([pa.array(table[0].view(np.int64)), *map(pa.array, table[1:])], ["word", "n", "t"])

    words = written(labelled.select("text", "toxic").mapInArrow(tidy(count), "word long, n long, t long").groupBy("word")
                    .agg(F.sum("n").alias("n"), F.sum("t").alias("t")).where((F.col("t") >= MINED_ROWS) | (F.col("n") >= VET_ROWS)), "rates")
    listed = _hashes(" ".join(LEXICONS.values()).split()).view(np.int64).tolist()
    dropped = [r["word"] for r in words.where(F.col("word").isin(listed) & (F.col("n") >= VET_ROWS) & (F.col("t") < VET_SHARE * F.col("n"))).collect()]
    tried = (words.where((F.col("t") >= MINED_ROWS) & (F.col("t") >= MINED_SHARE * F.col("n")))
             .orderBy((F.col("t") / F.col("n")).desc(), F.desc("t"), "word").limit(MINED_TRIED).collect())
    if not tried:
        return ([], []), dropped
    times = {r["word"]: r["t"] for r in tried}
    table = np.sort(np.array(list(times), np.int64).view(A.U))

    def followers(batches):
        for batch in batches:
            toxic = np.array(batch.column(1).to_pylist(), np.int64)
            for i, j, w, _ in _slices(batch.column(0)):
                at = np.flatnonzero(_member(w.hash, table) & (toxic[i + w.doc] == 1))
                pair = np.unique(np.stack([w.hash[at], np.r_[w.hash, A.U(0)][at + 1]]), axis=1).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], ["word", "next"])

    spread = (labelled.select("text", "toxic").mapInArrow(tidy(followers), "word long, next long").distinct().groupBy("word").agg(F.count("*").alias("f")).collect())
    good = sorted((-r["f"], r["word"]) for r in spread if r["f"] >= max(MINED_ROWS, MINED_SPREAD * times[r["word"]]))[:MINED_WORDS]
    found = sorted(word for _, word in good)
    return (found[0::2], found[1::2]), dropped


class LabelModel:
    """Class-conditional rates of the voters, their correlations, and posteriors, from counted vote patterns.

    A voter has a rate for each of toxic, clean and no vote given either class; abstaining tells as well.  Rates
    and posteriors of the patterns are found by expectation and maximisation from the votes alone, with the share
    of toxic texts held fixed.  Voters that vote together more than the class explains are correlated: in the
    posterior each has the share 1 / (1 + sum of its correlations) of its weight.
    """

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, prior: float):
        self.prior, m = prior, patterns.shape[1]
        total = max(float(counts.sum()), 1.0)
        votes = np.stack([patterns == c for c in (-1, 0, 1)], axis=2).astype(np.float64)  # patterns, voters, votes
        base = (counts @ votes.reshape(len(counts), 3 * m)).reshape(m, 3) / total
        post = 1 / (1 + np.exp(-2.0 * patterns.sum(1) - np.log(prior / (1 - prior))))  # to begin with, every vote counts alike
        self.table, self.rates, self.correlation, self.rested = np.zeros((m, 3)), np.stack([base, base]), np.zeros((m, m)), not len(counts)
        for _ in range(STEPS):
            mass = [counts * (1 - post), counts * post]
            self.rates = np.stack([((w @ votes.reshape(len(w), 3 * m)).reshape(m, 3) + base) / (w.sum() + 1) for w in mass])  # one text's worth of the mean
            active = np.abs(patterns).astype(np.float64)
            self.correlation = np.maximum(*[self._correlation(active, w) for w in mass])
            share = 1 / (1 + self.correlation.sum(1))
            self.table = share[:, None] * (np.log(np.maximum(self.rates[1], 1e-9)) - np.log(np.maximum(self.rates[0], 1e-9)))
            new = self.posterior(patterns)
            if not len(new) or np.abs(new - post).max() < 1e-7:
                self.rested = True
                break
            post = new

    @staticmethod
    def _correlation(active: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Positive correlations of casting a vote, within a class."""
        n = max(w.sum(), 1e-9)
        mean = w @ active / n
        cov = (active * w[:, None]).T @ active / n - np.outer(mean, mean)
        var = np.maximum(np.diag(cov), 0)
        scale = np.sqrt(np.outer(var, var))
        out = np.divide(cov, scale, out=np.zeros(cov.shape), where=(scale > 1e-12) & (np.outer(mean, mean) * n * n >= 400))
        np.fill_diagonal(out, 0)
        return np.clip(out, 0, 1)

    @property
    def precision(self) -> np.ndarray:
        """How likely a text is toxic, given each voter's toxic vote (clean, given its clean vote)."""
        toxic, clean = self.prior * self.rates[1], (1 - self.prior) * self.rates[0]
        sure = np.where(self.rates[:, :, 2].sum(0) > self.rates[:, :, 0].sum(0), toxic[:, 2] / (toxic[:, 2] + clean[:, 2] + 1e-12), clean[:, 0] / (toxic[:, 0] + clean[:, 0] + 1e-12))
        return sure

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        z = self.table[np.arange(votes.shape[1])[None, :], votes.astype(np.int64) + 1].sum(1) + np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def vote_patterns(docs: DataFrame, voters: Voters) -> tuple[np.ndarray, np.ndarray]:
    """The different votes on all documents and how many documents have each; a task counts before it sends.

    The voters are functions of few counts, so there are some hundreds of patterns, whatever the corpus (2 ** M at most).
    """

    def run(batches):
        total: dict[bytes, int] = {}
        for batch in batches:
            for _, _, w, shouted in _slices(batch.column(0)):
                found, n = np.unique(voters.votes(w, shouted), axis=0, return_counts=True)
                for row, k in zip(found, n.tolist()):
                    total[row.tobytes()] = total.get(row.tobytes(), 0) + k
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], ["votes", "n"])

    rows = docs.select("text").mapInArrow(tidy(run), "votes binary, n long").groupBy("votes").agg(F.sum("n").alias("n")).orderBy("votes").collect()
    return (np.array([np.frombuffer(r["votes"], np.int8) for r in rows], np.int8).reshape(-1, M), np.array([r["n"] for r in rows], np.float64))


def _features(w: A.Words, mined: list[np.ndarray], lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, bucket, value) of the hashed words of each document; the last two buckets are for listed and mined words."""
    listed = np.zeros(len(w.hash), bool)
    for t in lists:
        listed |= _member(w.hash, t)
    found = np.zeros(len(w.hash), bool)
    for t in mined:
        found |= _member(w.hash, t)
    bucket = (w.hash % A.U(BUCKETS)).astype(np.int64)
    key, n = np.unique(np.r_[w.doc * (BUCKETS + 2) + bucket, w.doc[listed] * (BUCKETS + 2) + BUCKETS, w.doc[found] * (BUCKETS + 2) + BUCKETS + 1], return_counts=True)
    doc, bucket = key // (BUCKETS + 2), key % (BUCKETS + 2)
    distinct = np.bincount(doc, minlength=len(w.count))
    damp = np.where(bucket < BUCKETS, np.sqrt(np.maximum(distinct[doc] / 64, 1)), 1)  # long texts do not outvote their listed words
    return doc, bucket, np.minimum(n, 4) / 4 / damp


class Linear:
    """Logistic regression on hashed words."""

    def __init__(self, weights: np.ndarray, constant: float):
        self.weights, self.constant = weights, constant

    def scores(self, doc: np.ndarray, bucket: np.ndarray, value: np.ndarray, docs: int) -> np.ndarray:
        z = self.constant + np.bincount(doc, weights=self.weights[bucket] * value, minlength=docs)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    @classmethod
    def fit(cls, rows: list[tuple[np.ndarray, np.ndarray, float, float]]) -> Linear:
        """Full-batch descent with per-weight steps on (buckets, values, target, weight) rows."""
        w, b = np.zeros(BUCKETS + 2), -2.0
        if not rows:
            return cls(w, b)
        doc = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
        bucket, value = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
        y, weight = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
        seen, seen_b = np.full(len(w), 1.0), 1.0
        for _ in range(EPOCHS):
            z = b + np.bincount(doc, weights=w[bucket] * value, minlength=len(rows))
            err = weight * (y - 1 / (1 + np.exp(-np.clip(z, -30, 30))))
            grad = np.bincount(bucket, weights=err[doc] * value, minlength=len(w)) - 0.5 * w
            seen += grad**2
            seen_b += err.sum() ** 2
            w += 1.0 * grad / np.sqrt(seen)
            b += 0.3 * err.sum() / np.sqrt(seen_b)
        return cls(w, b)


def _maybe_labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id is in ``labels``, and few others, without moving any.

    A bitmap of the labelled ids' hashes, 16 bits an id and 2^27 bits (2^21 rows to broadcast) at most, is a filter
    before the join, so that texts without labels stay where they are; beyond that size more of them pass.
    """
    bits = 1 << min(27, max(10, (16 * labels.count()).bit_length()))
    at = F.pmod(F.xxhash64("doc"), F.lit(bits))
    word, bit = F.shiftright(at, 6), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(64)).cast("int"))
    bitmap = labels.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits"))
    return docs.withColumns({"word": word, "bit": bit}).join(F.broadcast(bitmap), "word").where(F.col("bits").bitwiseAND(F.col("bit")) != 0).drop("word", "bit", "bits")


def fitted(docs: DataFrame, labels: DataFrame, train: F.Column, id_col: str = "doc_id", text_col: str = "text",
           label_col: str = "toxic") -> tuple[Voters, LabelModel, Linear]:
    """Voters, label model and classifier; ``train`` (over columns of ``docs``) says which rows' labels may be read."""
    docs = docs.select(docs[id_col].alias("doc"), docs[text_col].alias("text"), train.alias("learn"))
    docs = narrow(docs, doc="doc", text="text", learn="learn")
    labels = (labels.select(labels[id_col].alias("doc"), labels[label_col].cast("int").alias("toxic")).where("doc IS NOT NULL AND toxic IN (0, 1)")
              .groupBy("doc").agg(F.max("toxic").alias("toxic")))
    # the same join at every size: a few labels would be broadcast, many not
    labelled = written(_maybe_labelled(docs.where("learn"), labels).join(labels.hint("merge"), "doc").select("text", "toxic"), "labelled")
    mined, dropped = mined_words(labelled)
    share = labelled.agg(F.avg("toxic")).first()[0]
    voters = Voters(mined, dropped)
    model = LabelModel(*vote_patterns(docs, voters), float(np.clip(PRIOR if share is None else share, 0.005, 0.5)))

    def likely(batches):
        n = np.zeros(2, np.int64)
        for batch in batches:
            for _, _, w, shouted in _slices(batch.column(0)):
                p = model.posterior(voters.votes(w, shouted).astype(np.float64)) >= 0.5
                n += (len(p) - p.sum(), p.sum())
        yield pa.RecordBatch.from_arrays([pa.array([0, 1]), pa.array(n)], ["likely", "n"])

    count = dict.fromkeys((0, 1), 0)
    for row in docs.where("learn").select("text").mapInArrow(tidy(likely), "likely long, n long").groupBy("likely").agg(F.sum("n").alias("n")).collect():
        count[row["likely"]] = row["n"]
    below = [min(1.0, SAMPLE / max(1, count[x])) * 2.0**64 for x in (0, 1)]
    sample_type = pa.schema([("at", pa.int64()), ("p", pa.float64()), ("bucket", pa.binary()), ("value", pa.binary())])

    def sample(batches):
        """Rows whose text's hash is below the limit of their likely class."""
        for batch in batches:
            for i, j, w, shouted in _slices(batch.column(0)):
                p = model.posterior(voters.votes(w, shouted).astype(np.float64))
                whole = A.mix(w.span_hash(w.bounds[:-1], w.bounds[1:] - 1) + A.U(11))
                want = np.flatnonzero(whole < np.where(p >= 0.5, below[1], below[0]))
                if not len(want):
                    continue
                doc, bucket, value = _features(w, voters.mined, voters.lists)
                edge = np.searchsorted(doc, np.arange(j - i + 1))
                part = [slice(edge[d], edge[d + 1]) for d in want]
                yield pa.RecordBatch.from_arrays([pa.array(whole[want].view(np.int64)), pa.array(p[want]), pa.array([bucket[s].astype(np.int32).tobytes() for s in part], pa.binary()),
                                                  pa.array([value[s].astype(np.float32).tobytes() for s in part], pa.binary())], schema=sample_type)

    rows = docs.where("learn").select("text").mapInArrow(tidy(sample), "at long, p double, bucket binary, value binary").dropDuplicates(["at"])
    # about 2 * SAMPLE rows, whatever the corpus
    classifier = Linear.fit([(np.frombuffer(r["bucket"], np.int32), np.frombuffer(r["value"], np.float32).astype(np.float64), float(r["p"]), 1.0)
                             for r in written(rows, "sample").orderBy("at").toLocalIterator()])
    return voters, model, classifier


def toxicity(docs: DataFrame, labels: DataFrame, train: F.Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """doc_id, learned, posterior of the label model, score and verdict of the classifier."""
    voters, model, classifier = fitted(docs, labels, train, id_col, text_col, label_col)
    docs = docs.select(docs[id_col].alias("doc"), docs[text_col].alias("text"), train.alias("learn"))
    docs = narrow(docs, doc="doc", text="text", learn="learn")
    schema = pa.schema([("doc_id", arrow_type(docs, "doc")), ("learned", pa.bool_()), ("posterior", pa.float64()), ("score", pa.float64())])

    def score(batches):
        for batch in batches:
            for i, j, w, shouted in _slices(batch.column(1)):
                doc, bucket, value = _features(w, voters.mined, voters.lists)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i),
                                                  pa.array(model.posterior(voters.votes(w, shouted).astype(np.float64))),
                                                  pa.array(classifier.scores(doc, bucket, value, j - i))], schema=schema)

    out = docs.mapInArrow(tidy(score), f"doc_id {sql_type(docs, 'doc')}, learned boolean, posterior double, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame, train: F.Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """The rows of ``docs``, with all their columns, that the classifier does not find toxic."""
    voters, _, classifier = fitted(docs, labels, train, id_col, text_col, label_col)
    at = docs.columns.index(text_col)

    def keep(batches):
        for batch in batches:
            clean = []
            for i, j, w, _ in _slices(batch.column(at)):
                clean.append(classifier.scores(*_features(w, voters.mined, voters.lists), j - i) < 0.5)
            yield batch.filter(pa.array(np.concatenate(clean))) if clean else batch

    return docs.mapInArrow(tidy(keep), docs.schema)


def held_out(id_col: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def digest(scored: DataFrame) -> DataFrame:
    return scored.select("doc_id", (~F.col("learned")).alias("held_out"), "score", "predicted", "posterior")
