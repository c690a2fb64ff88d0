"""Quality rules and robust multivariate outliers per language and source.

Statistics of every whole text are counted in Arrow batches.  Their transformed vectors get a
minimum-covariance-determinant estimate per (language, source): from three deterministic starts,
concentration steps refit mean and covariance to the ``SHARE`` of the group's rows with the smallest
Mahalanobis distances.  A step is one aggregation of moments by (group, start, distance bin), so a
group of any size is reduced map-side; what is read by one task are at most some hundred bins of a
group.  The last bin that is needed counts with the fraction that fills the share.  The start with
the smallest determinant wins, is reweighted once, and rows beyond ``CUTOFF`` are rejected.

Groups of fewer than ``MIN_ROWS`` usable rows are pooled by language, and what is left by itself;
where even that is too little, nothing is rejected.  Defined cases: null and empty texts have no
words and fail the base rule; null languages or sources form groups of their own; equal rows get
equal verdicts; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspark.llm import arrays as A
from fieldspark.llm.common import arrow_type, narrow, sql_type, tidy, written

SHARE = 0.75
MIN_ROWS = 60
STEPS = 12
#: Squared distance beyond which a row is rejected: the chi-square quantile of this probability.
CUTOFF = 1 - 1e-7
SYMBOLS = b"#*$%&|<>"
REPEAT = 8
#: Smallest spread that counts for each transformed statistic: many of them are constant in clean text.
FLOOR = (0.3, 0.05, 0.15, 0.15, 0.15, 0.05)
P = len(FLOOR)
X = [f"x{k}" for k in range(P)]
PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct")

_symbol = np.zeros(256, bool)
_symbol[list(SYMBOLS)] = True


def _repeats(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Masks: equal to an earlier entry of the same document; equal to any other one of it."""
    key = h ^ A.mix(doc.astype(A.U) + A.U(1))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    later, any_ = np.zeros(len(key), bool), np.zeros(len(key), bool)
    later[order[1:][same]] = True
    any_[order[1:][same]] = any_[order[:-1][same]] = True
    return later, any_


def text_counts(data: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of one slice of documents."""
    w = A.words_of(data, offs, A.NONBLANK, lower=False)
    docs, bounds = len(offs) - 1, w.bounds
    starts_char = A.NONBLANK[w.data] & ((w.data & 0xC0) != 0x80)
    end = np.flatnonzero(w.data == 10)
    begin = np.r_[0, end[:-1] + 1]
    full = np.searchsorted(w.start, begin) < np.searchsorted(w.start, end)
    begin, end = begin[full], end[full]
    line_doc = np.searchsorted(bounds, begin, "right") - 1
    line_later, _ = _repeats(line_doc, w.span_hash(begin, end))
    at, h = A.windows(w, REPEAT, short=False)
    _, twice = _repeats(w.doc[at], h)
    step = np.zeros(len(w.start) + 1, np.int64)
    np.add.at(step, at[twice], 1)
    np.add.at(step, at[twice] + REPEAT, -1)
    covered = np.cumsum(step)[:-1] > 0
    word_later, _ = _repeats(w.doc, w.hash)
    count = lambda d: np.bincount(d, minlength=docs).astype(np.int64)
    return {"n_words": w.count, "word_chars": A.by_doc(starts_char, bounds), "n_symbols": A.by_doc(_symbol[w.data], bounds),
            "n_dup_lines": count(line_doc[line_later]), "n_repeat_words": count(w.doc[covered]), "n_lines": count(line_doc),
            "n_distinct": w.count - count(w.doc[word_later])}


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per document: id, language, source, the counts of its text."""
    docs = narrow(docs, doc_id=id_col, text=text_col, lang=lang_col, source=source_col)
    schema = pa.schema([("doc_id", arrow_type(docs, "doc_id")), ("lang", arrow_type(docs, "lang")), ("source", arrow_type(docs, "source")),
                        *((c, pa.int64()) for c in COUNTS)])

    def run(batches):
        for batch in batches:
            for i, j, data, offs in A.text_slices(batch.column(1)):
                yield A.batch_of(schema, doc_id=batch.column(0).slice(i, j - i), lang=batch.column(2).slice(i, j - i),
                                 source=batch.column(3).slice(i, j - i), **text_counts(data, offs))

    types = ", ".join(f"{c} {sql_type(docs, c)}" for c in ("doc_id", "lang", "source"))
    return docs.mapInArrow(tidy(run), types + "".join(f", {c} long" for c in COUNTS))


def base_failed() -> F.Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _vector() -> dict[str, F.Column]:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {"x0": F.log1p("n_words"), "x1": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n),
            "x2": F.asinh(20 * F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))),
            "x3": F.asin(F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)))),
            "x4": F.asin(F.sqrt(F.least(F.col("n_repeat_words") / n, F.lit(1.0)))),
            "x5": F.log(F.greatest(F.col("n_distinct"), F.lit(1)) / F.pow(n, F.lit(0.9)))}


def _chi2_cdf(x: float, dof: int) -> float:
    """For even degrees of freedom, in closed form."""
    term = total = 1.0
    for k in range(1, dof // 2):
        term *= x / 2 / k
        total += term
    return 1 - float(np.exp(-x / 2)) * total


def chi2_quantile(p: float, dof: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _chi2_cdf(mid, dof) < p else (lo, mid)
    return (lo + hi) / 2


def _grouped(stats: DataFrame) -> DataFrame:
    """Adds ``grp``, the group whose estimate holds for the row, and ``usable``."""
    usable = stats.withColumns({"usable": ~base_failed(), "own": F.to_json(F.struct("lang", "source"), {"ignoreNullFields": "false"}),
                                "tongue": F.to_json(F.struct("lang"), {"ignoreNullFields": "false"})})
    own = usable.groupBy("own", "tongue").agg(F.count_if("usable").alias("n"))
    own = own.withColumn("at", F.when(F.col("n") >= MIN_ROWS, F.col("own")).otherwise(F.col("tongue")))
    rest = own.where(F.col("n") < MIN_ROWS).groupBy("tongue").agg(F.sum("n").alias("rest"))
    level = own.join(rest, "tongue", "left").select(
        F.col("own"), F.when(F.col("n") >= MIN_ROWS, F.col("own")).when(F.col("rest") >= MIN_ROWS, F.col("tongue")).otherwise("").alias("grp"))
    return usable.join(level, "own").drop("own", "tongue")


def _grid_medians(rows: DataFrame, values: list[F.Column], width: float) -> DataFrame:
    """Per group: the medians of some columns on a grid of the given width, by counts of its cells."""
    long = rows.select("grp", F.posexplode(F.array(*[F.floor(v / width).cast("long") for v in values])).alias("k", "cell"))
    cells = long.groupBy("grp", "k", "cell").agg(F.count("*").alias("n"))

    def middle(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, g in pdf.sort_values(["k", "cell"]).groupby("k"):
            c = g["n"].cumsum().to_numpy()
            out.append((g["cell"].to_numpy()[np.searchsorted(c, c[-1] / 2)] + 0.5) * width)
        return pd.DataFrame({"grp": [pdf["grp"].iloc[0]], "mid": [out]})

    return cells.groupBy("grp").applyInPandas(middle, "grp string, mid array<double>")


def _moments(cols: list[F.Column]) -> list[F.Column]:
    return [F.count("*").cast("double").alias("n"), F.array(*[F.sum(c) for c in cols]).alias("s"),
            F.array(*[F.sum(cols[i] * cols[j]) for i, j in PAIRS]).alias("ss")]


def _square(flat) -> np.ndarray:
    out = np.zeros((P, P))
    for v, (i, j) in zip(flat, PAIRS):
        out[i, j] = out[j, i] = v
    return out


def _params(mean: np.ndarray, cov: np.ndarray) -> tuple[list, list, float]:
    """Centre, the coefficients of the squared distance, log determinant; spreads are at least FLOOR."""
    cov = cov + np.diag(np.square(FLOOR))
    inv = np.linalg.inv(cov)
    return mean.tolist(), [float(inv[i, j] * (1 if i == j else 2)) for i, j in PAIRS], float(np.linalg.slogdet(cov)[1])


def _distance() -> F.Column:
    d = [F.col(x) - F.col("m")[k] for k, x in enumerate(X)]
    total = F.lit(0.0)
    for k, (i, j) in enumerate(PAIRS):
        total = total + F.col("a")[k] * d[i] * d[j]
    return F.greatest(total, F.lit(1e-6))


def _starts(rows: DataFrame) -> DataFrame:
    """Three starts per group: scaled medians, bounded scores, spatial signs."""
    mid = _grid_medians(rows, [F.col(x) for x in X], 0.005)
    off = written(rows.join(mid, "grp").select("grp", *X, "mid"), "centred")
    mad = _grid_medians(off, [F.abs(F.col(x) - F.col("mid")[k]) for k, x in enumerate(X)], 0.005).withColumnRenamed("mid", "mad")
    scale = [F.greatest(1.4826 * F.col("mad")[k], F.lit(FLOOR[k])) for k in range(P)]
    z = [(F.col(x) - F.col("mid")[k]) / scale[k] for k, x in enumerate(X)]
    norm = F.sqrt(F.greatest(sum((c * c for c in z[1:]), z[0] * z[0]), F.lit(1e-12)))
    kinds = F.explode(F.array(F.struct(F.lit(1).alias("start"), F.array(*[F.tanh(c) for c in z]).alias("y")),
                              F.struct(F.lit(2).alias("start"), F.array(*[c / norm for c in z]).alias("y")))).alias("v")
    both = off.join(mad, "grp").select("grp", "mid", "mad", kinds)
    table = both.groupBy("grp", "mid", "mad", "v.start").agg(*_moments([F.col("v.y")[k] for k in range(P)]))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in pdf.itertuples():
            mid_, scale_ = np.array(r.mid), np.maximum(1.4826 * np.array(r.mad), FLOOR)
            mean = np.array(r.s) / r.n
            cov = _square(r.ss) / r.n - np.outer(mean, mean)
            cov *= P / max(np.trace(cov), 1e-9)  # the shape counts, the scale follows from the first step
            out.append((r.grp, r.start, *_params(mid_, cov * np.outer(scale_, scale_))))
            if r.start == 1:
                out.append((r.grp, 0, *_params(mid_, np.diag(scale_**2))))
        return pd.DataFrame(out, columns=["grp", "start", "m", "a", "logdet"])

    return table.groupBy("grp").applyInPandas(fit, "grp string, start int, m array<double>, a array<double>, logdet double")


def _step(rows: DataFrame, params: DataFrame, best: bool) -> DataFrame:
    """One concentration step of all groups and starts; ``best`` keeps the smallest determinant of each group."""
    cell = F.floor(8 * F.log2(_distance())).cast("int")
    table = rows.join(params, "grp").groupBy("grp", "start", cell.alias("cell")).agg(*_moments([F.col(x) for x in X]))
    factor = SHARE / _chi2_cdf(chi2_quantile(SHARE, P), P + 2)

    def refit(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for start, g in pdf.sort_values(["start", "cell"]).groupby("start"):
            n = g["n"].to_numpy()
            before = np.cumsum(n) - n
            weight = np.clip((SHARE * n.sum() - before) / n, 0, 1)
            total = (weight * n).sum()
            mean = weight @ np.stack(g["s"].to_numpy()) / total
            cov = _square(weight @ np.stack(g["ss"].to_numpy()) / total) - np.outer(mean, mean)
            out.append((g["grp"].iloc[0], start, *_params(mean, factor * cov)))
        out = pd.DataFrame(out, columns=["grp", "start", "m", "a", "logdet"])
        return out.sort_values(["logdet", "start"]).head(1) if best else out

    return table.groupBy("grp").applyInPandas(refit, "grp string, start int, m array<double>, a array<double>, logdet double")


def estimates(rows: DataFrame, steps: int = STEPS) -> DataFrame:
    """Centre and distance coefficients per group, from usable rows with columns grp, x0 … x5."""
    params = written(_starts(rows), "mcd")
    last = None
    for k in range(steps):
        params = written(_step(rows, params, best=k == steps - 1), "mcd")
        now = params.agg(F.sum("logdet")).first()[0] or 0.0
        if k < steps - 1 and last is not None and abs(now - last) < 1e-3:
            params = written(_step(rows, params, best=True), "mcd")
            break
        last = now
    inside = rows.join(params, "grp").where(_distance() <= chi2_quantile(0.975, P))
    table = inside.groupBy("grp").agg(*_moments([F.col(x) for x in X]))
    factor = 0.975 / _chi2_cdf(chi2_quantile(0.975, P), P + 2)

    def reweight(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]
        mean = np.array(r["s"]) / r["n"]
        return pd.DataFrame([(r["grp"], *_params(mean, factor * (_square(r["ss"]) / r["n"] - np.outer(mean, mean))))],
                            columns=["grp", "m", "a", "logdet"])

    return table.groupBy("grp").applyInPandas(reweight, "grp string, m array<double>, a array<double>, logdet double")


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
            cutoff: float = CUTOFF) -> DataFrame:
    """Counts, squared robust distance and verdict of every document."""
    stats = written(statistics(docs, id_col, text_col, lang_col, source_col), "statistics")
    rows = written(_grouped(stats).withColumns(_vector()), "vectors")
    fit = rows.where("usable").select("grp", *X)
    enough = fit.groupBy("grp").agg(F.count("*").alias("rows")).where(F.col("rows") >= MIN_ROWS).select("grp")
    params = written(estimates(fit.join(enough, "grp", "left_semi")), "estimates")
    scored = rows.join(params, "grp", "left").withColumn("distance", _distance())
    return scored.select("doc_id", *COUNTS, (~F.col("usable")).alias("base_failed"), "distance",
                         (F.col("usable") & (F.coalesce("distance", F.lit(0.0)) <= chi2_quantile(cutoff, P))).alias("kept"))


def digest(scored: DataFrame) -> DataFrame:
    return scored.select("doc_id", *COUNTS[:5], "base_failed", "kept", "distance")
