"""Statistics of stored survey answers: cleaning, distributions, regressions, contingency."""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from popweave.operators.aggregates import beside, with_totals
from popweave.operators.windows import spearman, top_k
from popweave.plans.ranking import join_keys, quantiles
from popweave.session import cut_lineage


def latent_band(score, low: int = 3, high: int = 7) -> Column:
    c = F.col(score) if isinstance(score, str) else score
    return F.when(c <= low, "LOW").when(c < high, "MED").when(c.isNotNull(), "HIGH")


def cleaning(df: DataFrame, keys: Sequence[str], value: str, clean: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(F.col(clean).cast("double")).alias("clean"), F.avg(F.col(value).isNull().cast("double")).alias("missing"))


def choice_shares(df: DataFrame, keys: Sequence[str], choice: str) -> DataFrame:
    g = df.filter(F.col(choice).isNotNull()).groupBy(*keys, choice).agg(F.count("*").alias("n"))
    return with_totals(g, keys, {"__t": F.sum("n")}).withColumn("share", F.col("n") / F.col("__t")).drop("__t")


def muteness(df: DataFrame, keys: Sequence[str], choice: str, above: float = 0.95) -> DataFrame:
    """Most frequent answer per key and whether it crowds out the others."""
    s = choice_shares(df, keys, choice)
    return s.groupBy(*keys).agg(F.max(F.struct("share", choice)).alias("m")).select(*keys, F.col(f"m.{choice}").alias("top"), F.col("m.share").alias("share"), (F.col("m.share") > above).alias("mute"))


def replica_stability(df: DataFrame, keys: Sequence[str], agent: str, choice: str, value: str) -> DataFrame:
    """Share of agents with one answer across replicas, and the mean within-agent SD."""
    a = df.groupBy(*keys, agent).agg(F.min(choice).alias("lo"), F.max(choice).alias("hi"), F.count("*").alias("k"), F.stddev_samp(value).alias("sd")).filter("k > 1")
    return a.groupBy(*keys).agg(F.count("*").alias("agents"), F.avg((F.col("lo") == F.col("hi")).cast("double")).alias("identical"), F.avg("sd").alias("mean_sd"))


def anchors(df: DataFrame, keys: Sequence[str], value: str, step: int = 10, k: int = 3) -> tuple[DataFrame, DataFrame]:
    """Share of answers on multiples of ``step`` and the most frequent answers."""
    c = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    round_ = c.groupBy(*keys).agg(F.sum("n").alias("n"), (F.sum(F.when(F.col(value) % step == 0, F.col("n")).otherwise(0)) / F.sum("n")).alias("on_anchor"))
    return round_, top_k(c, keys, [F.desc("n"), F.col(value)], k)


def by_axis(df: DataFrame, axes: Sequence[str], choice: str, wanted: str, prob: str) -> DataFrame:
    """Per axis and level: n, share of a choice, mean probability. Cells first, then opened per axis."""
    full = df.groupBy(*axes).agg(F.count("*").alias("n"), F.count(choice).alias("nc"), F.sum((F.col(choice) == wanted).cast("bigint")).alias("k"), F.count(prob).alias("np"), F.sum(prob).alias("sp"))
    pairs = F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).cast("string").alias("level")) for a in axes])
    g = full.withColumn("p", F.explode(pairs)).groupBy("p.axis", "p.level").agg(*[F.sum(c).alias(c) for c in ("n", "nc", "k", "np", "sp")])
    return g.select("axis", "level", "n", F.try_divide(F.col("k"), F.col("nc")).alias("share"), F.try_divide(F.col("sp"), F.col("np")).alias("prob"))


def logit(df: DataFrame, y: str, categorical: dict[str, Sequence[str]], numeric: Sequence[str], ridge: float = 1e-6, far: float = 8.0, steps: int = 60) -> DataFrame:
    """Logistic regression on a dummy-coded design by Newton steps: coefficient, SE and a separation flag.

    ``categorical`` lists the levels per factor, the reference first. Rows are reduced to weighted design points once;
    each step adds up the gradient and the upper half of the information matrix over them in one aggregate, whose single
    row is all that leaves the cluster. Half of ``ridge`` times the squared coefficients is taken off the likelihood, so
    coefficients stay finite where a term separates the outcomes; a term beyond ``far`` is flagged. Rows with a null
    outcome or term are left out; without rows, or where terms depend on each other and ``ridge`` is 0, there are none.
    """
    import numpy as np
    terms = [(f"{c}={l}", (F.col(c) == l).cast("double")) for c, levels in categorical.items() for l in levels[1:]] + [(n, F.col(n).cast("double")) for n in numeric] + [("intercept", F.lit(1.0))]
    k = len(terms)
    x = [F.col(f"t{i}") for i in range(k)]
    pts = cut_lineage(df.select(F.col(y).cast("double").alias("y"), *[e.alias(f"t{i}") for i, (_, e) in enumerate(terms)]).dropna()
                      .groupBy("y", *[f"t{i}" for i in range(k)]).agg(F.count("*").cast("double").alias("w")))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    beta = np.zeros(k)
    for _ in range(steps):
        eta = reduce(lambda a, b: a + b, [c * F.lit(float(v)) for c, v in zip(x, beta)])
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-eta))
        row = pts.select("*", (F.col("w") * (F.col("y") - p)).alias("g"), (F.col("w") * p * (1 - p)).alias("v")).agg(*[F.sum(F.col("g") * c) for c in x], *[F.sum(F.col("v") * x[i] * x[j]) for i, j in pairs]).first()
        if row[0] is None:
            return df.sparkSession.createDataFrame([], "term string, beta double, se double, separated boolean")
        info = np.zeros((k, k))
        for (i, j), v in zip(pairs, row[k:]):
            info[i, j] = info[j, i] = v
        info += ridge * np.eye(k)
        if np.linalg.matrix_rank(info) < k:
            return df.sparkSession.createDataFrame([], "term string, beta double, se double, separated boolean")
        step = np.linalg.solve(info, np.array(row[:k]) - ridge * beta)
        step *= min(1.0, 5.0 / max(np.abs(step).max(), 1e-300))         # far steps overshoot where the likelihood is flat
        beta = beta + step
        if np.abs(step).max() < 1e-10:
            break
    se = np.sqrt(np.diag(np.linalg.inv(info)))
    rows = [(n, float(b), float(s), bool(abs(b) > far)) for (n, _), b, s in zip(terms, beta, se)]
    return df.sparkSession.createDataFrame(rows, "term string, beta double, se double, separated boolean")


def linear_fit(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Slope ("gain"), intercept, Pearson and Spearman per condition."""
    d = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    g = d.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.corr(x, y).alias("pearson"))
    s = spearman(d, keys, x, y)
    return join_keys(g, s, list(keys)) if keys else beside(g, s)


def latent_table(df: DataFrame, keys: Sequence[str], band: str, value: str) -> DataFrame:
    """Per band: n, median, mean, population SD and histogram text."""
    c = df.filter(F.col(value).isNotNull()).groupBy(*keys, band, value).agg(F.count("*").alias("c"))
    v, n = F.col(value), F.col("c")
    g = c.groupBy(*keys, band).agg(F.sum("c").alias("n"), (F.sum(v * n) / F.sum(n)).alias("mean"), (F.sum(v * v * n) / F.sum(n)).alias("__q"),
                                   F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(v.alias("v"), n.alias("c")))), lambda s: F.concat(s["v"].cast("string"), F.lit(":"), s["c"].cast("string"))), " ").alias("histogram"))
    g = g.withColumn("sd", F.sqrt(F.greatest(F.col("__q") - F.col("mean") * F.col("mean"), F.lit(0.0)))).drop("__q")
    return join_keys(g, quantiles(df, [*keys, band], value, {"median": 0.5}), [*keys, band])


def paired_difference(df: DataFrame, agent: str, condition: str, first: str, second: str, band: str, value: str) -> DataFrame:
    """Mean of (first - second) on the same agent by band, with the number above and below 0."""
    m = lambda c: F.avg(F.when(F.col(condition) == c, F.col(value)))
    a = df.groupBy(agent, band).agg(m(first).alias("a"), m(second).alias("b")).filter("a is not null and b is not null").withColumn("d", F.col("a") - F.col("b"))
    return a.groupBy(band).agg(F.count("*").alias("agents"), F.avg("d").alias("mean_diff"), F.sum((F.col("d") > 0).cast("bigint")).alias("above"), F.sum((F.col("d") < 0).cast("bigint")).alias("below"))


def within_correlation(df: DataFrame, keys: Sequence[str], band: str, x: str, y: str) -> DataFrame:
    """Correlation after removing band means, from per-band moments."""
    X, Y = F.col(x).cast("double"), F.col(y).cast("double")
    m = df.filter(X.isNotNull() & Y.isNotNull()).groupBy(*keys, band).agg(F.count("*").alias("n"), F.covar_pop(X, Y).alias("cxy"), F.var_pop(X).alias("vx"), F.var_pop(Y).alias("vy"))
    n = F.col("n")
    g = m.groupBy(*keys).agg(F.sum(n * F.col("cxy")).alias("c"), F.sum(n * F.col("vx")).alias("a"), F.sum(n * F.col("vy")).alias("b"), F.sum(n).alias("n"))
    return g.select(*keys, "n", F.when((F.col("a") > 0) & (F.col("b") > 0), F.col("c") / F.sqrt(F.col("a") * F.col("b"))).alias("r"))


def chi_square(df: DataFrame, keys: Sequence[str], row: str, col: str) -> DataFrame:
    """Chi-square, degrees of freedom and the number of sparse cells (expected below 5).

    Cells nobody fills count too, so the column margin, a short dictionary, is opened on every row category.
    """
    c = df.filter(F.col(row).isNotNull() & F.col(col).isNotNull()).groupBy(*keys, row, col).agg(F.count("*").cast("double").alias("o"))
    rows = c.groupBy(*keys, row).agg(F.sum("o").alias("__r"))
    cols = c.groupBy(*keys, col).agg(F.sum("o").alias("__c")).groupBy(*keys).agg(F.collect_list(F.struct(col, "__c")).alias("__m"), F.sum("__c").alias("__n"))
    wide = join_keys(rows, cols, list(keys)) if keys else beside(rows, cols)
    wide = wide.withColumn("__m", F.explode("__m")).select(*keys, row, "__r", "__n", f"__m.{col}", "__m.__c")
    c = join_keys(wide, c, [*keys, row, col], "left").withColumn("o", F.coalesce("o", F.lit(0.0)))
    e = F.col("__r") * F.col("__c") / F.col("__n")
    g = c.groupBy(*keys).agg(F.sum(F.pow(F.col("o") - e, F.lit(2.0)) / e).alias("chi2"),
                             ((F.countDistinct(row) - 1) * (F.countDistinct(col) - 1)).alias("df"), F.max("__n").cast("bigint").alias("n"),
                             F.sum((e < 5).cast("bigint")).alias("sparse"))
    return g


def chi_square_p(df: DataFrame, row: str, col: str) -> DataFrame:
    """Chi-square test with its p-value through the ML statistic."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import StringIndexer, VectorAssembler
    from pyspark.ml.stat import ChiSquareTest
    d = df.filter(F.col(row).isNotNull() & F.col(col).isNotNull()).select(F.col(row).cast("string").alias("a"), F.col(col).cast("string").alias("b"))
    steps = [StringIndexer(inputCols=["a", "b"], outputCols=["ia", "ib"], stringOrderType="alphabetAsc"), VectorAssembler(inputCols=["ia"], outputCol="x")]
    r = ChiSquareTest.test(Pipeline(stages=steps).fit(d).transform(d), "x", "ib", flatten=True)
    return r.select(F.col("statistic").alias("chi2"), F.col("degreesOfFreedom").alias("df"), F.col("pValue").alias("p"))


def cell_distances(df: DataFrame, cell: str, choice: str, ground: str) -> DataFrame:
    """TVD of every prompt cell from the ground cell."""
    g = choice_shares(df, [cell], choice)
    base = g.filter(F.col(cell) == ground).select(choice, F.col("share").alias("__q"))
    j = g.join(base, choice, "left")
    q = F.coalesce(F.col("__q"), F.lit(0.0))
    return j.groupBy(cell).agg(F.sum("n").alias("n"), ((F.sum(F.abs(F.col("share") - q)) + F.greatest(F.lit(1.0) - F.sum(q), F.lit(0.0))) / 2).alias("tvd"))


def level_effects(df: DataFrame, variable: str, choice: str) -> DataFrame:
    """Largest TVD between any two levels of a variable; levels are few, so pairs are too."""
    g = cut_lineage(choice_shares(df, [variable], choice))
    levels = g.groupBy(choice).agg(F.map_from_entries(F.collect_list(F.struct(F.col(variable).cast("string"), F.col("share")))).alias("m"))
    names = g.agg(F.array_sort(F.collect_set(F.col(variable).cast("string"))).alias("l"))
    p = levels.withColumn("l", names.scalar()).withColumn("a", F.explode("l")).withColumn("b", F.explode("l")).filter(F.col("a") < F.col("b"))
    z = lambda x: F.coalesce(F.try_element_at("m", F.col(x)), F.lit(0.0))
    t = p.groupBy("a", "b").agg((F.sum(F.abs(z("a") - z("b"))) / 2).alias("tvd"))
    return t.agg(F.max(F.struct("tvd", "a", "b")).alias("m")).select(F.col("m.a").alias("level_a"), F.col("m.b").alias("level_b"), F.col("m.tvd").alias("tvd"))


def interaction_gap(df: DataFrame, a: str, b: str, choice: str) -> DataFrame:
    """Share in (a, b) minus the additive guess a + b - all, per choice."""
    full = df.filter(F.col(choice).isNotNull()).groupBy(a, b, choice).agg(F.count("*").alias("n"))
    share = lambda keys, name: with_totals(full.groupBy(*keys, choice).agg(F.sum("n").alias("__s")), keys, {"__t": F.sum("__s")}).select(*keys, choice, (F.col("__s") / F.col("__t")).alias(name))
    j = share([a, b], "p").join(share([a], "pa"), [a, choice]).join(share([b], "pb"), [b, choice]).join(share([], "p0"), choice)
    return j.select(a, b, choice, (F.col("p") - (F.col("pa") + F.col("pb") - F.col("p0"))).alias("gap"))


def migration(df: DataFrame, agent: str, condition: str, cold: str, warm: str, cell: str, choice: str, wanted: str, belief: str) -> DataFrame:
    """Per cell: belief and choice share at two temperatures on the same agents, and their moves."""
    m = lambda e, c: F.avg(F.when(F.col(condition) == c, e))
    pick_ = (F.col(choice) == wanted).cast("double")
    a = df.groupBy(cell, agent).agg(m(pick_, cold).alias("c0"), m(pick_, warm).alias("c1"), m(F.col(belief), cold).alias("b0"), m(F.col(belief), warm).alias("b1")).filter("c0 is not null and c1 is not null")
    g = a.groupBy(cell).agg(F.count("*").alias("agents"), F.avg("c0").alias("choice_cold"), F.avg("c1").alias("choice_warm"), F.avg("b0").alias("belief_cold"), F.avg("b1").alias("belief_warm"))
    return g.withColumn("choice_move", F.col("choice_warm") - F.col("choice_cold")).withColumn("belief_move", F.col("belief_warm") - F.col("belief_cold"))


def position_effect(df: DataFrame, options: Sequence[str], replica: str, choice: str) -> DataFrame:
    """How often the answer was shown at each position."""
    from popweave.functions.scalars import shown_position
    d = df.select(shown_position(options, F.col(replica), F.col(choice)).alias("position")).filter("position is not null")
    g = d.groupBy("position").agg(F.count("*").alias("n"))
    return with_totals(g, [], {"__t": F.sum("n")}).select("position", "n", (F.col("n") / F.col("__t")).alias("share"))


def link_regression(df: DataFrame, keys: Sequence[str], x: str, y: str, eps: float = 0.01) -> DataFrame:
    """logit(y) on logit(x), both clipped away from 0 and 1."""
    clip = lambda c: F.least(F.greatest(F.col(c), F.lit(eps)), F.lit(1 - eps))
    lg = lambda c: F.ln(clip(c) / (1 - clip(c)))
    d = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, lg(x).alias("lx"), lg(y).alias("ly"))
    return d.groupBy(*keys).agg(F.count("*").alias("n"), F.regr_intercept("ly", "lx").alias("intercept"), F.regr_slope("ly", "lx").alias("slope"), F.regr_r2("ly", "lx").alias("r2"))


def model_concordance(df: DataFrame, agent: str, model: str, models: Sequence[str], value: str) -> DataFrame:
    """Spearman between two models on per-agent means, for every pair of models."""
    w = df.groupBy(agent).pivot(model, list(models)).agg(F.avg(value))
    parts = [spearman(w, [], a, b).withColumn("pair", F.lit(f"{a}~{b}")) for i, a in enumerate(models) for b in models[i + 1:]]
    return reduce(lambda x, y: x.unionByName(y), parts)


def guess_outcomes(df: DataFrame, city: str, truth: Column, guess: str, unknown: Column) -> DataFrame:
    d = df.withColumn("outcome", F.when(unknown, "unknown").when(truth, "right").otherwise("wrong"))
    g = d.groupBy(city, "outcome").agg(F.count("*").alias("n"))
    return with_totals(g, [city], {"__t": F.sum("n")}).select(city, "outcome", "n", (F.col("n") / F.col("__t")).alias("share"))


def wrong_guesses(df: DataFrame, city: str, truth: Column, guess: str, unknown: Column, k: int) -> DataFrame:
    return top_k(df.filter(~truth & ~unknown).groupBy(city, guess).agg(F.count("*").alias("n")), [city], [F.desc("n"), F.col(guess)], k)


def story_problems(df: DataFrame, key: str, text: str, forbidden: Sequence[str], worn: Sequence[str], shortest: int = 50, longest: int = 220) -> DataFrame:
    """One row per problem of a text; it lists, it does not correct."""
    low = F.lower(text)
    words = F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")
    n = F.size(words)
    digits = F.filter(words, lambda w: w.rlike("[0-9]"))
    hits = lambda lst: F.concat_ws(",", *[F.when(low.contains(s), F.lit(s)) for s in lst])
    items = [(hits(forbidden) != "", "forbidden", hits(forbidden)), (F.size(digits) > 0, "digits", F.array_join(digits, " ")), (n < shortest, "short", n.cast("string")),
             (n > longest, "long", n.cast("string")), (hits(worn) != "", "scene", hits(worn))]
    arr = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(p).alias("problem"), d.alias("detail"))) for c, p, d in items]))
    return df.select(key, F.explode(arr).alias("p")).select(key, "p.*")


def call_metrics(df: DataFrame, keys: Sequence[str], latency: str, tok_in: Column, tok_out: Column) -> DataFrame:
    g = df.groupBy(*keys).agg(F.count("*").alias("calls"), F.avg(latency).alias("mean_latency"), F.sum(tok_in).alias("tokens_in"), F.sum(tok_out).alias("tokens_out"))
    return join_keys(g, quantiles(df, list(keys), latency, {"p50": 0.5, "p95": 0.95}), list(keys))


def item_by_band(df: DataFrame, keys: Sequence[str], band: str, choice: str) -> DataFrame:
    return choice_shares(df, [*keys, band], choice)


def profile_contingency(df: DataFrame, profile: DataFrame, key: str, bands: dict[str, Column], item: str) -> DataFrame:
    """Bands derived from the profile, crossed with an item."""
    p = profile.select(key, *[c.alias(n) for n, c in bands.items()])
    return df.join(p, key).groupBy(*bands, item).agg(F.count("*").alias("n"))


def largest_deviations(df: DataFrame, key: str, latent: str, answer: str, n: int) -> DataFrame:
    d = df.withColumn("diff", F.col(answer) - F.col(latent)).filter("diff is not null")
    return d.orderBy(F.desc(F.abs("diff")), key).limit(n).select(key, latent, answer, "diff")
