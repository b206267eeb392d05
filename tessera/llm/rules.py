"""Quality rules: robust multivariate outliers by the minimum covariance determinant, in DataFrame operations only.

Words are runs without ASCII white space. Each text gets base counts, from which two base rules follow, and a vector of
transformed statistics: log mean word length, log share of marks (no letter, digit or space) and of capitals among the
characters, and log distinct words by log words. SMOOTH words of ordinary make are added to the first three, so that a
short text's shares, which chance moves far, stay near the centre.

The minimum-covariance-determinant (MCD) estimate of centre and scatter is fitted on the distinct vectors of the texts
that pass the base rules (copies count once), at three levels: all texts, each language, each language and source.
Concentration steps take the COVER share of vectors nearest under the previous estimate, from two deterministic starts
(medians with quartile spreads, plain moments), until no log determinant falls by more than SETTLED or STEPS are done;
the start of smaller determinant holds, and a last step takes all vectors within the REWEIGHT quantile. Every estimate
is shrunk towards its parent's as if SHRINK rows of the parent had been seen (all texts: towards their own medians and
quartile spreads), at every size alike, so that a source of few texts is judged mostly by its language. A text whose
squared Mahalanobis distance under its group's estimate is over the chi-square quantile KEEP is rejected.

A step is one scan: vectors are summed by pool and by bin of their distance (BINS a factor of e), whole bins are taken
up to the COVER share and of the last bin the fraction that completes it, so nothing is sorted and every task sends a
bounded number of rows for each pool. A coordinate without spread once the others are known (variance under ROUNDING)
is projected out; a vector that departs from it is rejected, as the exact-fit case of MCD has it.

Defined cases: a null or wordless text has zero counts and fails the base rules; a null language or source is a group
of its own; with no text that passes the base rules there is no fit and no distance; with no rows the result is empty;
ids may repeat or be null, each row is judged by itself, equal texts of a group alike; columns of any other name may
be there and are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import SPACE, discard, join_small, staged

NAMES = ("word_length", "marks", "capitals", "variety")
D = len(NAMES)
COVER, REWEIGHT, KEEP, SMOOTH, SHRINK = 0.75, 0.975, 0.99999, 50, 50.0
STEPS, SETTLED, BINS, ROUNDING = 5, 0.05, 32, 1e-10
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_LOWER = [(i, j) for i in range(D) for j in range(i + 1)]
_CENTRE, _SCATTER = [f"m{i}" for i in range(D)], [f"c{i}{j}" for i, j in _LOWER]
_FORM = [f"p{i}{j}" for i, j in _LOWER] + [f"g{i}" for i in range(D)] + [f"e{i}{j}" for i in range(D) for j in range(D) if i != j]


def _bound(value: Column, then) -> Column:
    """then(value), with value evaluated once: the optimiser copies a column's expression into every use."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _repeated_words(words: Column) -> Column:
    """Words in five-word windows found twice or more in the text."""
    size = F.size(words)
    window = F.transform(F.sequence(F.lit(1), size - 4), lambda i: F.xxhash64(*[F.element_at(words, i + k) for k in range(5)]))

    def cover(h: Column) -> Column:
        order = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def starts(o: Column) -> Column:
            n = F.size(o)
            same = F.transform(o, lambda x, k: F.when((k > 0) & (F.get(o, k - 1)["h"] == x["h"]) | (k < n - 1) & (F.get(o, k + 1)["h"] == x["h"]), x["i"]))
            return F.array_sort(F.filter(same, lambda x: x.isNotNull()))

        zero = F.struct(F.lit(0).alias("n"), F.lit(-5).alias("last"))
        add = lambda a, i: F.struct((a["n"] + F.least(F.lit(5), i - a["last"])).alias("n"), i.alias("last"))
        count = F.aggregate(_bound(order, starts), zero, add, lambda a: a["n"])
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(count)

    return F.when(size < 6, 0).otherwise(_bound(window, cover))


def base_counts(text: Column) -> Column:
    """Struct of BASE, and of n_distinct (words), n_marks and n_capitals for the vector."""
    text = F.coalesce(text, F.lit(""))

    def counts(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.aggregate(words, F.lit(0), lambda a, w: a + F.length(w)).cast("long").alias("word_chars"),
            _repeated_words(words).cast("long").alias("n_repeat_words"),
            F.size(F.array_distinct(words)).cast("long").alias("n_distinct"),
        )

    def lines(x: Column) -> Column:
        return F.size(x) - F.size(F.array_distinct(x))

    def found(pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern)).cast("long")

    of_words = _bound(F.filter(F.split(text, SPACE + "+"), lambda w: w != ""), counts)
    dup = _bound(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lines).cast("long")
    rest = {"n_symbols": found("[#*$%&|<>]"), "n_dup_lines": dup, "n_marks": found(r"[^\p{L}\p{M}\p{N}\x20\x09-\x0D]"), "n_capitals": found(r"\p{Lu}")}

    def joined(w: Column) -> Column:
        own = {n: w[n] for n in ("n_words", "word_chars", "n_repeat_words", "n_distinct")} | rest
        return F.struct(*[own[n].alias(n) for n in (*BASE, "n_distinct", "n_marks", "n_capitals")])

    return _bound(of_words, joined)


def vector(b: dict[str, Column]) -> list[Column]:
    """The transformed statistics; a word of ordinary make is taken to have 5 characters, 0.15 marks and 0.1 capitals."""
    n, chars = b["n_words"], b["word_chars"] + 5 * SMOOTH + 0.5
    x = (
        F.log((b["word_chars"] + 5 * SMOOTH) / (n + SMOOTH)),
        F.log((b["n_marks"] + 0.15 * SMOOTH + 0.5) / chars),
        F.log((b["n_capitals"] + 0.1 * SMOOTH + 0.5) / chars),
        F.log(F.greatest(b["n_distinct"], F.lit(1))) / F.log(F.greatest(n, F.lit(2))),
    )
    return [F.round(c, 9) for c in x]


def with_statistics(docs: DataFrame) -> DataFrame:
    """_text, _lang_of and _source_of give way to _b (the counts), _base_failed, the keys of the pools and the vector _x0, _x1, ..."""
    docs = docs.withColumn("_b", base_counts(F.col("_text")))
    b = {n: F.col("_b")[n] for n in (*BASE, "n_distinct", "n_marks", "n_capitals")}
    failed = (b["n_words"] < 10) | (100 * b["n_repeat_words"] > 20 * b["n_words"])
    lang, source = ((F.col(c).isNull(), F.col(c)) for c in ("_lang_of", "_source_of"))
    keys = {"_group": F.xxhash64(*lang, *source), "_lang": F.xxhash64(F.lit("lang"), *lang)}
    return docs.withColumns({"_base_failed": failed} | keys | {f"_x{i}": c for i, c in enumerate(vector(b))}).drop("_text", "_lang_of", "_source_of")


def _gamma(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function, by its series."""
    term = total = 1 / a
    k = a
    while term > 1e-16 * total:
        k += 1
        term *= x / k
        total += term
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a))


def chi_square(p: int, q: float) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _gamma(p / 2, mid / 2) < q else (low, mid)
    return low


def _inverted(df: DataFrame) -> DataFrame:
    """df with p_ij (the scatter's inverse), g_i (1 if the coordinate has spread of its own), e_ij and the log determinant.

    The sweep operator takes one coordinate after the other; one of variance under ROUNDING, given those before it, is left
    out, and e_i then has its regression on the others.
    """
    flat = ", ".join(f"c{max(i, j)}{min(i, j)}" for i in range(D) for j in range(D))
    d = f"acc.a[k * {D + 1}]"
    cell = f"""case when n div {D} = k and n % {D} = k then -1 / {d} when n div {D} = k or n % {D} = k then x / {d}
        else x - acc.a[int(n div {D}) * {D} + k] * acc.a[k * {D} + n % {D}] / {d} end"""
    step = f"""named_struct('a', case when {d} > {ROUNDING}D then transform(acc.a, (x, n) -> {cell}) else acc.a end,
        'log', acc.log + ln(greatest({d}, {ROUNDING}D)))"""
    swept = df.selectExpr("*", f"aggregate(sequence(0, {D - 1}), named_struct('a', array({flat}), 'log', 0D), (acc, k) -> {step}) as _s")
    free = swept.selectExpr(*df.columns, "_s", *[f"if(_s.a[{i * D + i}] < -1e-8D, 1D, 0D) as g{i}" for i in range(D)])
    inverse = [f"-_s.a[{i * D + j}] * g{i} * g{j} as p{i}{j}" for i, j in _LOWER]
    slopes = [f"_s.a[{i * D + j}] * (1 - g{i}) * g{j} as e{i}{j}" for i in range(D) for j in range(D) if i != j]
    return free.selectExpr(*df.columns, *inverse, *[f"g{i}" for i in range(D)], *slopes, "_s.log as logdet")


def _distance(df: DataFrame) -> DataFrame:
    """df with d2; off a coordinate without spread the distance is beyond any quantile."""
    gap = [f"(_x{i} - m{i})" for i in range(D)]
    inside = " + ".join(f"{1 if i == j else 2} * p{i}{j} * {gap[i]} * {gap[j]}" for i, j in _LOWER)
    off = " or ".join(f"g{i} = 0 and abs({gap[i]} - ({' + '.join(f'e{i}{j} * {gap[j]}' for j in range(D) if j != i)})) > {10 * math.sqrt(ROUNDING)}D" for i in range(D))
    return df.selectExpr("*", f"case when {' + '.join(f'g{i}' for i in range(D))} < {D} and ({off}) then 1e12D else {inside} end as d2")


def _moments(share: str | None = None) -> list[Column]:
    """Aggregates n, s_i and s_ij over vectors, or over rows of such sums that count by a share."""
    if share is None:
        sums = {"n": "double(count(*))"} | {f"s{i}": f"sum(_x{i})" for i in range(D)} | {f"s{i}{j}": f"sum(_x{i} * _x{j})" for i, j in _LOWER}
    else:
        sums = {c: f"sum({c} * {share})" for c in ["n", *[f"s{i}" for i in range(D)], *[f"s{i}{j}" for i, j in _LOWER]]}
    return [F.expr(f"{e} as {c}") for c, e in sums.items()]


def _estimates(sums: DataFrame, keys: list[str], scale: float) -> DataFrame:
    """Centre and scatter of sums."""
    scatter = [f"{scale}D * (s{i}{j} / n - s{i} / n * s{j} / n) as c{i}{j}" for i, j in _LOWER]
    return sums.selectExpr(*keys, *[f"s{i} / n as m{i}" for i in range(D)], *scatter)


def _shrunk(own: DataFrame, up: DataFrame, on: list[str], rows: float = SHRINK) -> DataFrame:
    """own (with _n, the pool's rows) mixed with rows as many of up's: the moments of the mixture."""
    held = up.selectExpr(*on, *[f"{c} as _{c}" for c in _CENTRE + _SCATTER])
    w = f"({rows}D / (_n + {rows}D))"
    centre = [f"m{i} - {w} * (m{i} - _m{i}) as m{i}" for i in range(D)]
    scatter = [f"(1 - {w}) * c{i}{j} + {w} * _c{i}{j} + {w} * (1 - {w}) * (m{i} - _m{i}) * (m{j} - _m{j}) as c{i}{j}" for i, j in _LOWER]
    # one row a pool on both sides; the smaller is broadcast where Spark knows it to be small
    return own.join(held, on).selectExpr(*[c for c in own.columns if c not in _CENTRE + _SCATTER], *centre, *scatter)


def _levels(own: DataFrame, target: DataFrame) -> DataFrame:
    """own, all levels of pools together, each shrunk towards its parent; the top towards target."""
    top = _shrunk(own.filter("_level = 0"), target, ["_start"])
    langs = _shrunk(own.filter("_level = 1"), top.withColumn("_up", F.col("_pool")), ["_up", "_start"])
    groups = _shrunk(own.filter("_level = 2"), langs.withColumn("_up", F.col("_pool")), ["_up", "_start"])
    return _inverted(top.unionByName(langs).unionByName(groups))


def _consistent(share: float) -> float:
    """What the covariance of the share nearest of a normal sample is too small by."""
    return share / _gamma(D / 2 + 1, chi_square(D, share) / 2)


def _near(vectors: DataFrame, params: DataFrame) -> DataFrame:
    """Each vector under each estimate (of each start) of its pools: _pool, _start, logdet, _x, d2."""
    held = params.groupBy("_pool").agg(F.collect_list(F.struct("_start", "logdet", *_CENTRE, *_FORM)).alias("_p"))
    x = [f"_x{i}" for i in range(D)]
    return _distance(join_small(vectors, held, ["_pool"]).select("_pool", *x, F.explode("_p").alias("_p")).select("_pool", *x, "_p.*"))


def fit(stats: DataFrame, cover: float = COVER, reweight: bool = True) -> DataFrame:
    """MCD estimates, one row for each _group: m_i, c_ij, p_ij, g_i, e_ij, logdet. stats has _base_failed, _group, _lang and _x0, ..."""
    x = [f"_x{i}" for i in range(D)]
    distinct = stats.filter("not _base_failed").select("_group", "_lang", *x).distinct()
    pool = lambda level, key, up: F.struct(F.lit(level).alias("_level"), key.alias("_pool"), up.alias("_up"))
    whole = F.lit(0).cast("long")
    at = F.explode(F.array(pool(0, whole, whole), pool(1, F.col("_lang"), whole), pool(2, F.col("_group"), F.col("_lang"))))
    vectors = staged(distinct.select(at.alias("_at"), *x).select("_at.*", *x), "mcd-vectors")
    quart = [F.percentile_approx(f"_x{i}", [0.25, 0.5, 0.75], 10_000).alias(f"q{i}") for i in range(D)]
    start = staged(vectors.groupBy("_pool", "_level", "_up").agg(*quart, *_moments()).withColumn("_n", F.col("n")), "mcd-start")
    tree, keys = ["_level", "_pool", "_up", "_n"], ["_pool", "_start"]
    spread = [f"q{i}[1] as m{i}" for i in range(D)] + [(f"pow((q{i}[2] - q{i}[0]) / 1.349D, 2)" if i == j else "0D") + f" as c{i}{j}" for i, j in _LOWER]
    robust = start.selectExpr(*tree, "1 as _start", *spread)
    plain = _estimates(start, tree, 1.0).select(*tree, F.lit(0).alias("_start"), *_CENTRE, *_SCATTER)
    top = robust.filter("_level = 0").select(F.explode(F.array(F.lit(0), F.lit(1))).alias("_start"), *_CENTRE, *_SCATTER)
    target, sizes = staged(top, "mcd-target"), start.select(*tree)
    params = staged(_levels(plain.unionByName(robust), target), "mcd")
    for _ in range(STEPS):
        near = _near(vectors.select("_pool", *x), params)
        bins = near.groupBy(*keys, F.floor(BINS * F.log(F.greatest("d2", F.lit(1e-9)))).cast("int").alias("_bin")).agg(*_moments(), F.max("logdet").alias("_old"))
        upto = join_small(bins.withColumn("_c", F.sum("n").over(Window.partitionBy(*keys).orderBy("_bin"))), sizes, ["_pool"])
        share = (F.ceil(cover * F.col("_n")) - (F.col("_c") - F.col("n"))) / F.col("n")
        inner = upto.withColumn("_share", F.least(share, F.lit(1.0))).filter("_share > 0").groupBy(*tree, "_start").agg(*_moments("_share"), F.max("_old").alias("_old"))
        own = staged(_estimates(inner, [*tree, "_start", "_old"], _consistent(cover)), "mcd-own")
        last, params = params, staged(_levels(own, target), "mcd")
        discard(last, own)
        if (params.agg(F.max(F.abs(F.col("logdet") - F.col("_old")))).first()[0] or 0.0) <= SETTLED:
            break
    best = params.groupBy(*tree).agg(F.min_by(F.struct(*_CENTRE, *_SCATTER, *_FORM, "logdet"), F.struct("logdet", "_start")).alias("p")).select(*tree, "p.*", F.lit(0).alias("_start"))
    over = [vectors, start, target, params]
    if reweight:
        best = staged(best, "mcd-best")
        inner = _near(vectors.select("_pool", *x), best).filter(F.col("d2") <= chi_square(D, REWEIGHT)).groupBy("_pool").agg(*_moments())
        own = staged(_estimates(join_small(inner, sizes, ["_pool"]), tree, _consistent(REWEIGHT)).withColumn("_start", F.lit(0)), "mcd-own")
        over += [best, own]
        best = _levels(own, target)
    found = staged(best.filter("_level = 2").select(F.col("_pool").alias("_group"), *_CENTRE, *_SCATTER, *_FORM, "logdet"), "mcd")
    discard(*over)
    return found


def judged(df: DataFrame, params: DataFrame, keep: float = KEEP) -> DataFrame:
    """df (with_statistics) with d2, and kept: false for base failures and for outliers of their group."""
    held = params.select("_group", F.struct(*_CENTRE, *_FORM).alias("_fit"))
    # every group has a row, so that the join may be an inner one
    held = df.select("_group").distinct().join(held, "_group", "left")
    got = join_small(df, staged(held, "mcd-all"), ["_group"]).select("*", "_fit.*")
    most = F.expr(f"array(0D, {', '.join(f'{chi_square(p, keep)}D' for p in range(1, D + 1))})[int({' + '.join(f'g{i}' for i in range(D))})]")
    got = _distance(got).withColumn("kept", ~F.col("_base_failed") & (F.col("d2").isNull() | (F.col("d2") <= most)))
    return got.drop("_fit", *_CENTRE, *_FORM)


def op3(docs: DataFrame) -> DataFrame:
    plain = docs.select("doc_id", F.col("text").alias("_text"), F.col("lang").alias("_lang_of"), F.col("source").alias("_source_of"))
    stats = staged(with_statistics(plain), "rules")
    counts = [F.col("_b")[n].alias(n) for n in BASE]
    return judged(stats, fit(stats)).select("doc_id", *counts, F.col("_base_failed").alias("base_failed"), "kept", F.col("d2").alias("distance2"))


def filtered(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of docs that the rules keep, with their columns.

    A null or wordless text goes; equal rows are kept or go together; ids are not read.
    """
    columns = [F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang_of"), F.col(source_col).alias("_source_of")]
    stats = staged(with_statistics(docs.select(F.struct("*").alias("_row"), *columns)), "rules")
    return judged(stats, fit(stats.drop("_row"))).filter("kept").select("_row.*")
