"""Quality rules: statistic vectors per document, rejected as robust multivariate outliers."""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .store import drop_rows, mark, materialize, small_side
from .textbytes import WORD, chunks, distinct_slices, gram_hashes, inside, mix, owners, runs, word_table

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Share of a group that the estimates are made from; starts of a group, the rows that a start is drawn from, and concentration steps of every start and of the best.
SHARE, STARTS, SUBSET, STEPS, LAST_STEPS = 0.75, 4, 40, 2, 3
#: What the covariance of SHARE of a normal distribution lacks in spread, and the documents at which a group's own estimate weighs as much as its language's.
SPREAD, PRIOR = 1.5, 50.0
#: Estimates, of about 400 bytes each, that are broadcast to the statistics; more are joined by shuffles.
MAX_ESTIMATES = 50_000
#: The squared distance of a document that is rejected. 6 dimensions; the chi-square quantile of one in 10**9 is 54.
CUTOFF = 54.0
#: Of each transformed statistic, the standard deviation that no estimate goes below.
FEATURES = {"x_words": 0.5, "x_length": 0.8, "x_symbols": 0.25, "x_lines": 0.4, "x_repeats": 0.5, "x_upper": 0.3}

SYMBOL = np.zeros(256, bool)
SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
_STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper"]


def _counts(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return sums[offsets[1:]] - sums[offsets[:-1]]


def text_statistics(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of every document of a chunk."""
    n = len(offsets) - 1
    starts, ends, before, hashes = word_table(data, offsets)
    word = WORD[data]

    line_starts, line_ends, lines_before = runs(data != 10, offsets)
    words_to = np.searchsorted(starts, np.concatenate((line_starts, line_ends)))
    has_word = words_to[len(line_starts) :] > words_to[: len(line_starts)]
    doc = owners(lines_before)[has_word]
    number, lines = distinct_slices(data, line_starts[has_word], line_ends[has_word])
    key = doc * max(1, len(lines)) + number
    again = np.ones(len(key), bool)
    again[np.unique(key, return_index=True)[1]] = False

    repeated = np.zeros(len(starts) + 1, np.int64)
    grams = gram_hashes(hashes, WINDOW)
    whole = inside(before, WINDOW)
    at = np.flatnonzero(whole)
    key = mix(grams[at] + mix(owners(before)[at].astype(np.uint64)))
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    np.add.at(repeated, at[twice], 1)
    np.add.at(repeated, at[twice] + WINDOW, -1)
    covered = np.cumsum(repeated[:-1]) > 0

    return {
        "n_words": np.diff(before),
        "word_chars": _counts(word & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": _counts(SYMBOL[data], offsets),
        "n_dup_lines": np.bincount(doc[again], minlength=n),
        "n_repeat_words": _counts(covered, before),
        "n_upper": _counts((data >= 65) & (data <= 90), offsets),
    }


def _statistics(batches):
    for batch in batches:
        for lo, hi, data, offsets in chunks(batch.column("text")):
            counts = text_statistics(data, offsets)
            kept = [batch.column(c).slice(lo, hi - lo) for c in ("doc_id", "text_hash", "lang", "source")]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(counts[c].astype(np.int64)) for c in _STATS)], ["doc_id", "text_hash", "lang", "source", *_STATS])


def document_statistics(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", source_col="source") -> DataFrame:
    named = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), F.col(text_col).alias("text"),
    )
    return named.mapInArrow(_statistics, "doc_id long, text_hash long, lang string, source string, " + ", ".join(f"{c} long" for c in _STATS))


def _transformed(stats: DataFrame) -> DataFrame:
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return stats.withColumns({
        "x_words": F.log1p("n_words"),
        "x_length": F.col("word_chars") / words,
        "x_symbols": F.log1p(100 * F.col("n_symbols") / chars),
        "x_lines": F.log1p(F.col("n_dup_lines").cast("double")),
        "x_repeats": F.log1p(100 * F.col("n_repeat_words") / words),
        "x_upper": F.log1p(100 * F.col("n_upper") / chars),
    })


def _distance():
    """Squared Mahalanobis distance by the columns `center` and `precision` (row by row)."""
    x, p = list(FEATURES), len(FEATURES)
    centred = [F.col(c) - F.element_at("center", i + 1) for i, c in enumerate(x)]
    terms = [centred[i] * centred[j] * F.element_at("precision", i * p + j + 1) * (1 if i == j else 2) for i in range(p) for j in range(i, p)]
    return sum(terms[1:], terms[0])


def _moments_of(n, sums, squares) -> tuple[np.ndarray, np.ndarray]:
    p, n = len(FEATURES), max(n, 1)
    center, square = np.asarray(sums, float) / n, np.zeros((p, p))
    square[np.triu_indices(p)] = np.asarray(squares, float) / n
    return center, square + np.triu(square, 1).T - np.outer(center, center)


def _matrix(cov: np.ndarray) -> np.ndarray:
    """The covariance of a subset, widened, and held up by the floors; the subset with the least determinant of this is sought."""
    return SPREAD * cov + np.diag(np.square(list(FEATURES.values())))


def _estimates(batches):
    """Centre, precision and log determinant of each start of each group."""
    for frame in batches:
        rows = []
        for r in frame.itertuples(index=False):
            center, cov = _moments_of(r.n, r.sums, r.squares)
            matrix = _matrix(cov)
            rows.append((r.lang, r.source, r.start, center.tolist(), np.linalg.inv(matrix).ravel().tolist(), float(np.linalg.slogdet(matrix)[1])))
        yield pd.DataFrame(rows, columns=["lang", "source", "start", "center", "precision", "logdet"])


def _leaning(batches):
    """Centre and precision of each group, between its own and its language's."""
    for frame in batches:
        rows = []
        for r in frame.itertuples(index=False):
            wide, spread = _moments_of(r.lang_n, r.lang_sums, r.lang_squares)
            center, cov = _moments_of(r.n, r.sums, r.squares)
            own = r.n / (r.n + PRIOR)
            matrix = _matrix(own * cov + (1 - own) * spread)
            rows.append((r.lang, r.source, (own * center + (1 - own) * wide).tolist(), np.linalg.inv(matrix).ravel().tolist()))
        yield pd.DataFrame(rows, columns=["lang", "source", "center", "precision"])


_ESTIMATE = "lang string, source string, center array<double>, precision array<double>"
_STARTED = "lang string, source string, start int, center array<double>, precision array<double>, logdet double"


def _moments(rows: DataFrame, *keys: str) -> DataFrame:
    x, p = list(FEATURES), len(FEATURES)
    sums = F.array(*[F.sum(c) for c in x])
    squares = F.array(*[F.sum(F.col(x[i]) * F.col(x[j])) for i in range(p) for j in range(i, p)])
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("n"), sums.alias("sums"), squares.alias("squares"))


def _nearest(stats: DataFrame, estimate: DataFrame, share: float) -> DataFrame:
    """The moments of the `share` of each group that is nearest to each of its estimates (lang, source, start)."""
    begin, keys = mark(), ["lang", "source", "start"]
    ranked = stats.join(small_side(estimate, MAX_ESTIMATES), ["lang", "source"]).withColumn("d2", _distance()).select(*keys, *FEATURES, "d2")
    limits = materialize(ranked.groupBy(*keys).agg(F.percentile_approx("d2", share, 10000).alias("limit")), "rules-limit")
    return materialize(_moments(ranked.join(small_side(limits, MAX_ESTIMATES), keys).filter("d2 <= limit"), *keys), "rules-moments", since=begin)


def robust_estimates(stats: DataFrame, share: float = SHARE) -> DataFrame:
    """lang, source, center, precision by minimum covariance determinant.

    A group has several starts: its medians and quartiles, and the moments of
    STARTS subsets of about SUBSET rows, drawn by a hash of the id. A
    concentration step ranks every document of the group by its distance from
    an estimate and estimates anew from the nearest `share`. As the sought
    matrix is a multiple of the subset's covariance and a fixed diagonal, a step
    does not raise its determinant, up to the ranks that percentile_approx
    misses. After STEPS steps the start with the least determinant goes on for
    LAST_STEPS more. Only then do groups of few documents lean on their
    language's estimate.

    Groups only meet as sums of their rows, which Spark adds up before it
    shuffles them.
    """
    first, x = mark(), list(FEATURES)
    quartile = [F.percentile_approx(c, [0.25, 0.5, 0.75], 10000) for c in x]
    begin = materialize(stats.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("rows"), *[q.alias(f"q_{c}") for q, c in zip(quartile, x)]), "rules-begin")
    variance = [F.pow(F.greatest((F.col(f"q_{c}")[2] - F.col(f"q_{c}")[0]) / 1.349, F.lit(floor)), 2) for c, floor in FEATURES.items()]
    flat = [1 / variance[i] if i == j else F.lit(0.0) for i in range(len(x)) for j in range(len(x))]
    middle = begin.select("lang", "source", F.lit(0).alias("start"), F.array(*[F.col(f"q_{c}")[1] for c in x]).alias("center"), F.array(*flat).alias("precision"))
    tried = stats.join(small_side(begin.select("lang", "source", "rows"), MAX_ESTIMATES), ["lang", "source"]).withColumn("start", F.explode(F.sequence(F.lit(1), F.lit(STARTS))))
    drawn = F.crc32(F.concat_ws(":", F.col("start").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))) % F.ceil(F.col("rows") / SUBSET) == 0
    subsets = _moments(tried.filter(drawn), "lang", "source", "start").mapInPandas(_estimates, _STARTED).drop("logdet")
    estimate = materialize(middle.unionByName(subsets), "rules-starts")
    for step in range(STEPS + LAST_STEPS):
        own = _nearest(stats, estimate, share)
        if step == STEPS + LAST_STEPS - 1:
            break
        estimate = materialize(own.mapInPandas(_estimates, _STARTED), "rules-estimate")
        if step == STEPS - 1:
            best = estimate.groupBy("lang", "source").agg(F.min_by(F.struct("start", "center", "precision"), F.struct("logdet", "start")).alias("x"))
            estimate = materialize(best.select("lang", "source", "x.start", "x.center", "x.precision"), "rules-best")
        estimate = estimate.select("lang", "source", "start", "center", "precision")
    lang = own.groupBy("lang").agg(
        F.sum("n").alias("lang_n"),
        F.array(*[F.sum(F.col("sums")[i]) for i in range(len(x))]).alias("lang_sums"),
        F.array(*[F.sum(F.col("squares")[i]) for i in range(len(x) * (len(x) + 1) // 2)]).alias("lang_squares"),
    )
    return materialize(own.join(lang, "lang").mapInPandas(_leaning, _ESTIMATE), "rules-estimate", since=first)


def quality_rules(docs: DataFrame, cutoff: float = CUTOFF, **columns) -> DataFrame:
    """One row per document: doc_id, text_hash (xxhash64 of the text), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance.

    kept is false where base_failed (n_words < 10, or repeated words over 20 %)
    or where the squared distance from the documents of the same language and
    source is over `cutoff`. Null texts count as empty, null languages and
    sources as ''. Repeated rows give a row each; no rows give no rows; other
    columns are ignored. A hot source is only ever summed up, never gathered.
    """
    stats = materialize(_transformed(document_statistics(docs, **columns)), "rules-stats")
    judged = stats.join(small_side(robust_estimates(stats), MAX_ESTIMATES), ["lang", "source"], "left").withColumn("distance", _distance())
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return judged.select(
        "doc_id", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & (F.col("distance") <= cutoff)).alias("kept"), "distance",
    )


def drop_poor_documents(docs: DataFrame) -> DataFrame:
    """docs without those that quality_rules() rejects, null ids among them.

    Of rows with one id only those go whose own text is poor; rows with one id and text go together.
    """
    begin = mark()
    poor = quality_rules(docs).filter("not kept").select("doc_id", "text_hash").distinct()
    return drop_rows(docs, materialize(poor, "rules-dropped", since=begin))


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text_hash")
