"""Quality rules with DataFrame functions only: text statistics, base rules, robust multivariate outliers.

The statistics of each document are transformed into a vector. For each language and source, each language and all
rows, the minimum-covariance-determinant estimate is found by concentration steps from two starts (medians, and the
plain mean and covariance): the half of the rows with the smallest Mahalanobis distances gives the next mean and
covariance, until no determinant moves; of the starts the smaller determinant counts. One reweighting by the
chi-squared quantile follows, and a consistency factor that brings the median distance to the chi-squared median.
The estimate of a language and source is shrunk towards that of its language, and that towards the one of all rows, by
their numbers of rows (``PRIOR`` rows' worth of the wider one), so that groups of every size go the same way. Rows beyond
the cut-off are rejected.

Means, covariances and quantiles are grouped aggregates with partial sums over all groups at once, so a hot group is no
harder than many small ones. Quantiles are approximate (rank error of one in QUANTILE); the estimates carry that error.

Rates of short texts are uncertain: each is smoothed by SMOOTH words (and as many characters) of the median document, the
repetition shares by SMOOTH words without repetition, and the mean sampling variance of the statistics is added to the
covariances: for the shares that of a single chance repetition, which counts TWICE words or one line.

Defined results: a null text has no words and fails the base rules; rows with null language or source form groups
of their own; repeated ids are judged row by row; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.llm.common import SPACE, checkpoint, words_of

DIMS = 5
#: Concentration steps at most (they end when no group's log determinant moves by more than STILL).
STEPS, STILL = 12, 0.02
#: Chi-squared quantiles with DIMS degrees of freedom.
CHI2_HALF = 4.351
CHI2_975 = 12.833
#: Squared robust distance beyond which a row is rejected. Real clouds have longer tails than normal ones.
CUT = 100.0
#: Words of the median document that each document's rates are smoothed by; rows of a wider group that each estimate is shrunk by.
SMOOTH, PRIOR = 100, 50
#: Words of a three-word window that a text has twice by chance, both places counted.
TWICE = 6
QUANTILE = 2000
#: Groups whose values are broadcast at most, of under 300 bytes each; rows of statistics that a task takes.
BROADCAST_GROUPS, PER_TASK = 10_000, 100_000
NONE, ALL = "\0", "\1"  # stand for a null language or source, and for all of them


def text_statistics(text: Column) -> dict[str, Column]:
    """Counts over whole texts; ``words`` and ``windows`` are the intermediate arrays."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "words": words_of(text),
        "word_chars": F.length(F.regexp_replace(t, SPACE, "")).cast("bigint"),
        "n_symbols": F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("bigint"),
        "n_upper": F.regexp_count(t, F.lit(r"[A-ZÀ-ÖØ-Þ!]")).cast("bigint"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint"),
    }


def repeated_words(words: Column) -> Column:
    """Words within 3-word windows that occur twice or more.

    Window hashes carry their place in the low digits; sorted, equal windows are neighbours, and neighbours whose
    hashes agree are compared word by word. Texts whose window hashes are all different need none of this."""
    n = F.greatest(F.size(words) - 2, F.lit(0)).cast("bigint")
    place = F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), n - 1)).otherwise(F.array().cast("array<bigint>"))

    def code(i: Column) -> Column:
        at = i.cast("int")
        h = F.shiftright(F.xxhash64(F.get(words, at), F.get(words, at + 1), F.get(words, at + 2)), 2)
        return h - F.pmod(h, n) + i

    def same(a: Column, b: Column) -> Column:
        i, j = F.pmod(a, n).cast("int"), F.pmod(b, n).cast("int")
        return (a - i == b - j) & F.coalesce((F.get(words, i) == F.get(words, j)) & (F.get(words, i + 1) == F.get(words, j + 1)) & (F.get(words, i + 2) == F.get(words, j + 2)), F.lit(False))

    def covered(codes: Column) -> Column:
        twice = F.filter(codes, lambda x, k: F.coalesce(same(x, F.get(codes, k + 1)), F.lit(False)) | F.coalesce(same(x, F.get(codes, k - 1)), F.lit(False)))
        starts = F.sort_array(F.transform(twice, lambda x: F.pmod(x, n)))
        return _let(starts, lambda s: F.aggregate(s, F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-3).cast("bigint").alias("last")), lambda acc, x: F.struct((acc["n"] + F.least(F.lit(3).cast("bigint"), x - acc["last"])).alias("n"), x.alias("last")), lambda acc: acc["n"]))

    none = F.lit(0).cast("bigint")
    hashes = F.transform(place, lambda i: F.xxhash64(F.get(words, i.cast("int")), F.get(words, i.cast("int") + 1), F.get(words, i.cast("int") + 2)))
    differ = _let(hashes, lambda h: F.size(F.array_distinct(h)) == F.size(h))
    return F.when((n <= 1) | differ, none).otherwise(_let(F.sort_array(F.transform(place, code)), covered))


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def document_statistics(docs: DataFrame, id_col: str, text_col: str, group_cols: list[str]) -> DataFrame:
    parts = text_statistics(F.col(text_col))
    wide = docs.select(F.col(id_col), *group_cols, *(c.alias(k) for k, c in parts.items()))
    counted = wide.select(id_col, *group_cols, F.size("words").cast("bigint").alias("n_words"), "word_chars", "n_symbols", "n_upper", "n_dup_lines", repeated_words(F.col("words")).alias("n_repeat_words"))
    return counted.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def vector(letters: float, symbols: float, upper: float) -> list[Column]:
    """The transformed statistics, with the median document's letters a word, symbols and capitals a letter."""
    n, chars = F.col("n_words") + SMOOTH, F.col("word_chars") + SMOOTH * letters
    return [
        F.log((F.col("word_chars") + SMOOTH * letters) / n),
        F.sqrt((F.col("n_symbols") + SMOOTH * letters * symbols) / chars),
        F.sqrt((F.col("n_upper") + SMOOTH * letters * upper) / chars),
        F.col("n_repeat_words") / n,
        F.col("n_dup_lines") / n,
    ]


def _distance(center: Column, factor: Column) -> Column:
    """Squared Mahalanobis distance of columns x0.. by forward substitution with a packed lower triangle."""
    y: list[Column] = []
    for i in range(DIMS):
        row = i * (i + 1) // 2
        v = F.col(f"x{i}") - center[i]
        for j in range(i):
            v = v - factor[row + j] * y[j]
        y.append(v / factor[row + i])
    total = y[0] * y[0]
    for v in y[1:]:
        total = total + v * v
    return total


PAIRS = [(i, j) for i in range(DIMS) for j in range(i + 1)]


def _moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows n, mean ``center`` and packed lower triangle ``cov`` of the covariance of each group."""
    sums = [F.count("*").alias("n"), *(F.avg(f"x{i}").alias(f"m{i}") for i in range(DIMS)), *(F.covar_pop(f"x{i}", f"x{j}").alias(f"c{i}{j}") for i, j in PAIRS)]
    return rows.groupBy(*keys).agg(*sums).select(*keys, "n", F.array(*(F.col(f"m{i}") for i in range(DIMS))).alias("center"), F.array(*(F.col(f"c{i}{j}") for i, j in PAIRS)).alias("cov"))


def _factored(g: DataFrame, tolerance: list[float]) -> DataFrame:
    """With ``factor``, the packed Cholesky factor of the covariance and the tolerance, and its ``logdet``."""
    names = {}
    kept = g.columns
    for k, (i, j) in enumerate(PAIRS):
        v = F.col("cov")[k] + (tolerance[i] if i == j else 0.0)
        for m in range(j):
            v = v - names[i, m] * names[j, m]
        g = g.withColumn(f"_l{i}{j}", F.sqrt(F.greatest(v, F.lit(1e-12))) if i == j else v / names[j, j])
        names[i, j] = F.col(f"_l{i}{j}")
    logdet = sum((2 * F.log(names[i, i]) for i in range(DIMS)), F.lit(0.0))
    return g.select(*[c for c in kept if c not in ("factor", "logdet")], F.array(*(names[p] for p in PAIRS)).alias("factor"), logdet.alias("logdet"))


def _beside(rows: DataFrame, per_group: DataFrame, keys: list[str], n_groups: int) -> DataFrame:
    """Rows with the values of their group; the groups are broadcast only where their counted number is small."""
    return rows.join(F.broadcast(per_group) if n_groups <= BROADCAST_GROUPS else per_group, keys)


def robust_estimates(rows: DataFrame, keys: list[str], n_groups: int, tolerance: list[float]) -> DataFrame:
    """``keys``, n, center, cov: the reweighted minimum-covariance-determinant estimate of each group of rows (keys, x0..)."""
    coordinates = [f"x{i}" for i in range(DIMS)]
    by = [*keys, "_start"]
    rows = rows.select(*keys, *coordinates)

    def measured(estimate: DataFrame, over: list[str]) -> DataFrame:
        return _beside(rows, estimate, keys, n_groups).select(*over, *coordinates, _distance(F.col("center"), F.col("factor")).alias("d2"))

    def median(m: DataFrame, over: list[str]) -> DataFrame:
        return m.groupBy(*over).agg(F.percentile_approx("d2", 0.5, QUANTILE).alias("h"))

    medians = rows.groupBy(*keys).agg(*(F.percentile_approx(x, 0.5, QUANTILE).alias(f"q{x}") for x in coordinates))
    spread = _beside(rows, medians, keys, n_groups).groupBy(*keys).agg(F.count("*").alias("n"), *(F.first(f"q{x}").alias(f"q{x}") for x in coordinates), *(F.percentile_approx(F.abs(F.col(x) - F.col(f"q{x}")), 0.5, QUANTILE).alias(f"s{x}") for x in coordinates))
    one = spread.select(*keys, "n", F.array(*(F.col(f"q{x}") for x in coordinates)).alias("center"), F.array(*(F.pow(F.col(f"sx{i}") * 1.4826, 2) if i == j else F.lit(0.0) for i, j in PAIRS)).alias("cov"))
    starts = one.withColumn("_start", F.lit(0)).unionByName(_moments(rows, keys).withColumn("_start", F.lit(1)))
    estimate = checkpoint(_factored(starts, tolerance))
    for _ in range(STEPS):
        m = measured(estimate, by)
        half = _moments(_beside(m, median(m, by), by, n_groups).filter("d2 <= h"), by)
        last, estimate = estimate, checkpoint(_factored(half, tolerance))
        moved = estimate.join(last.select(*by, F.col("logdet").alias("_before")), by).filter(F.abs(F.col("logdet") - F.col("_before")) > STILL)
        if not moved.limit(1).count():
            break
    best = checkpoint(estimate.groupBy(*keys).agg(F.min_by(F.struct("n", "center", "cov", "factor"), F.struct("logdet", "_start")).alias("_b")).select(*keys, "_b.*"))
    m = measured(best, keys)
    # at the model the median distance is the chi-squared median
    inside = _beside(m, median(m, keys), keys, n_groups).filter(F.col("d2") <= F.col("h") * (CHI2_975 / CHI2_HALF))
    weighed = checkpoint(_factored(_moments(inside, keys), tolerance))
    factor = median(measured(weighed, keys), keys).withColumn("h", F.col("h") / CHI2_HALF)
    return checkpoint(weighed.join(factor, keys).select(*keys, "n", "center", F.transform("cov", lambda c: c * F.col("h")).alias("cov")))


def _blended(narrow: DataFrame, wide: DataFrame, keys: list[str]) -> DataFrame:
    """Estimates shrunk towards those of the wider group by PRIOR rows."""
    w = F.col("n") / (F.col("n") + PRIOR)
    both = narrow.join(wide.select(*keys, F.col("center").alias("_m"), F.col("cov").alias("_c")), keys)
    mixed = {c: F.zip_with(c, o, lambda x, y: w * x + (1 - w) * y) for c, o in (("center", "_m"), ("cov", "_c"))}
    return both.select(*[c for c in narrow.columns if c not in mixed], *(v.alias(c) for c, v in mixed.items()))


def shrunk_estimates(rows: DataFrame, keys: list[str], n_groups: int, tolerance: list[float]) -> DataFrame:
    """Center and factor of each group, with the groups that hold it shrunk into it: languages and sources, languages, all."""
    levels = F.array(*(F.struct(*(F.col(k).alias(k) if i < depth else F.lit(ALL).alias(k) for i, k in enumerate(keys))) for depth in range(len(keys) + 1)))
    many = rows.withColumn("_g", F.explode(levels)).select("_g.*", *(f"x{i}" for i in range(DIMS)))
    found = robust_estimates(many, keys, 2 * (n_groups * (len(keys) + 1)), tolerance)
    wide = found.filter(" and ".join(f"{k} = '{ALL}'" for k in keys)).drop(*keys).withColumn("_one", F.lit(1))
    above: list[str] = ["_one"]
    for depth in range(1, len(keys) + 1):
        at = [f"{k} <> '{ALL}'" for k in keys[:depth]] + [f"{k} = '{ALL}'" for k in keys[depth:]]
        level = found.filter(" and ".join(at)).drop(*keys[depth:]).withColumn("_one", F.lit(1))
        wide, above = _blended(level, wide, above), [*keys[:depth], "_one"]
    return checkpoint(_factored(wide.drop("_one", "n"), tolerance).select(*keys, "center", "factor"))


def quality_rules(docs: DataFrame, cut: float = CUT, id_col: str = "doc_id", text_col: str = "text", group_cols: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """Per row: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, d2, kept."""
    keys = [f"_g{i}" for i in range(len(group_cols))]
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *(F.coalesce(F.col(c).cast("string"), F.lit(NONE)).alias(k) for c, k in zip(group_cols, keys, strict=True)))
    stats = checkpoint(document_statistics(source, "_id", "_text", keys))
    # rows failing the base rules take no part in the estimates
    good = stats.filter(~F.col("base_failed"))
    letters = F.col("word_chars") / F.col("n_words")
    n, medians, per_word, per_square = good.agg(
        F.count("*"), F.array(*(F.percentile_approx(x, 0.5, QUANTILE) for x in (letters, F.col("n_symbols") / F.col("word_chars"), F.col("n_upper") / F.col("word_chars")))), F.avg(0.25 / (F.col("n_words") + SMOOTH)), F.avg(F.pow(F.col("n_words") + SMOOTH, -2.0))
    ).first()
    columns = [F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "d2", "kept"]
    failed = stats.filter("base_failed").withColumn("d2", F.lit(None).cast("double")).withColumn("kept", F.lit(False))
    if not n:
        return failed.select(*columns)
    # sampling variances of the log mean, of square roots of rates, and of shares by one repetition
    tolerance = [per_word, *[per_word / max(medians[0], 1.0)] * 2, TWICE**2 * per_square, per_square]
    good = good.select("*", *(x.alias(f"x{i}") for i, x in enumerate(vector(*medians)))).coalesce(n // PER_TASK + 1)
    n_groups = good.select(*keys).distinct().count()
    judged = _beside(good, shrunk_estimates(good, keys, n_groups, tolerance), keys, n_groups)
    judged = judged.withColumn("d2", _distance(F.col("center"), F.col("factor"))).withColumn("kept", F.col("d2") <= cut)
    return judged.select(*columns).unionByName(failed.select(*columns))
