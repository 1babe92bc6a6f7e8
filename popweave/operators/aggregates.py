"""Compositions, rescaling, blocks, weighted moments and reuse statistics.

Rows are always reduced to cells before anything is compared or normalised; totals come
from a second small aggregation, not from a window over raw rows.
"""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from popweave.operators.filters import exact_filter
from popweave.operators.joins import completed
from popweave.plans.intervals import range_lookup
from popweave.plans.ranking import join_keys, quantiles
from popweave.session import cut_lineage


def with_totals(df: DataFrame, keys: Sequence[str], totals: dict[str, Column]) -> DataFrame:
    """Add one column per aggregate of ``totals`` taken over ``keys`` (whole table when empty).

    For frames that are already reduced to cells. Without keys the totals are one scalar subquery over the same cells,
    which shares their exchange; nothing runs before the action.
    """
    agg = df.groupBy(*keys).agg(*[e.alias(n) for n, e in totals.items()])
    return join_keys(df, agg, list(keys)) if keys else beside(df, agg)


def beside(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Put the columns of a one-row frame next to every row: one scalar subquery, evaluated once."""
    s = one_row.select(F.struct(*one_row.columns)).scalar()
    return df.withColumns({c: s[c] for c in one_row.columns})


def share_of(part: Column, whole: Column) -> Column:
    """part / whole, null when the whole is 0."""
    return part / F.nullif(whole.cast("double"), F.lit(0.0))


def composition(df: DataFrame, variable: str, weight: str | None = None, spec: dict | None = None,
                keys: Sequence[str] = ()) -> DataFrame:
    """Counts or weights of a variable under a filter, positive ones only."""
    d = exact_filter(df, spec or {})
    agg = F.sum(weight) if weight else F.count("*")
    return d.groupBy(*keys, variable).agg(agg.alias("w")).filter("w > 0")


def conditional_rescale(groups: DataFrame, census: DataFrame, keys: Sequence[str], attr: str, value: str) -> DataFrame:
    """Census shares inside each group times the register total ``total`` of the group."""
    g = census.groupBy(*keys, attr).agg(F.sum(value).alias("__v"))
    g = with_totals(g, keys, {"__t": F.sum("__v")})
    return (g.join(groups, list(keys)).select(*keys, attr, (share_of(F.col("__v"), F.col("__t")) * F.col("total")).alias("count")))


def rounding_residual(df: DataFrame, keys: Sequence[str], attr: str, total_code: str, value: str) -> DataFrame:
    """Published total minus the sum of its categories, per group."""
    tot = F.sum(F.when(F.col(attr) == total_code, F.col(value)))
    parts = F.sum(F.when(F.col(attr) != total_code, F.col(value)))
    return (df.groupBy(*keys).agg(parts.alias("parts"), tot.alias("published"))
            .filter("parts is not null and published is not null").withColumn("residual", F.col("published") - F.col("parts")))


def demographic_block(df: DataFrame, where: Column, columns: dict[str, Column], value: Column,
                      groups: DataFrame | None = None, attr: str | None = None) -> DataFrame:
    """One constraint block: filter, recode (null = drop), aggregate, and rescale when groups are given."""
    names = list(columns)
    d = df.filter(where).select(*[c.alias(n) for n, c in columns.items()], value.alias("__v")).dropna(subset=names)
    cells = d.groupBy(*names).agg(F.sum("__v").alias("count"))
    return cells if groups is None else conditional_rescale(groups, cells, [n for n in names if n != attr], attr, "count")


def harmonise(block: DataFrame, target: DataFrame, keys: Sequence[str], value: str = "count") -> DataFrame:
    """Scale a block so that its margin equals the target's; the factor is kept."""
    own = block.groupBy(*keys).agg(F.sum(value).alias("__o"))
    f = own.join(target, list(keys)).select(*keys, share_of(F.col("target"), F.col("__o")).alias("factor"))
    return block.join(f, list(keys)).withColumn(value, F.col(value) * F.col("factor"))


def difference_category(df: DataFrame, keys: Sequence[str], attr: str, total: str, part: str, rest: str, value: str) -> DataFrame:
    """Add the missing category as total - part, never below 0."""
    s = lambda code: F.coalesce(F.sum(F.when(F.col(attr) == code, F.col(value))), F.lit(0.0))
    w = df.groupBy(*keys).agg(s(total).alias("__t"), s(part).alias("__p"))
    return w.select(*keys, F.explode(F.array(F.struct(F.lit(part).alias(attr), F.col("__p").alias(value)),
                                             F.struct(F.lit(rest).alias(attr), F.greatest(F.col("__t") - F.col("__p"), F.lit(0.0)).alias(value)))
                                     ).alias("r")).select(*keys, "r.*")


def country_shares(df: DataFrame, country: str, value: str, aggregates: str, keys: Sequence[str] = ()) -> DataFrame:
    """Positive country counts without aggregate codes (regex), with their share."""
    g = df.filter(~F.col(country).rlike(aggregates)).groupBy(*keys, country).agg(F.sum(value).alias("n")).filter("n > 0")
    return with_totals(g, keys, {"__t": F.sum("n")}).withColumn("share", share_of(F.col("n"), F.col("__t"))).drop("__t")


def zone_table(df: DataFrame, zone: str, columns: dict[str, Column], residual: tuple[str, str, str] | None = None) -> DataFrame:
    """Wide unit columns summed by zone, then one row per (zone, category).

    ``residual=(name, whole, part)`` adds whole - part floored at 0 and removes the whole.
    """
    w = df.groupBy(zone).agg(*[F.sum(c).alias(n) for n, c in columns.items()])
    names = list(columns)
    if residual:
        name, whole, part = residual
        w = w.withColumn(name, F.greatest(F.col(whole) - F.col(part), F.lit(0))).drop(whole)
        names = [n for n in names if n != whole] + [name]
    return w.unpivot([zone], names, "category", "count")


def zone_shares(df: DataFrame, keys: Sequence[str], zone: str, value: str) -> DataFrame:
    """P(zone | keys); groups with no mass are left out."""
    g = df.groupBy(*keys, zone).agg(F.sum(value).alias("__v"))
    g = with_totals(g, keys, {"__t": F.sum("__v")})
    return g.filter("__t <> 0").select(*keys, zone, share_of(F.col("__v"), F.col("__t")).alias("share"))


def expand_shares(counts: DataFrame, shares: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Coarse shares applied to finer counts; ``missing`` marks cells without a share."""
    return (counts.join(shares, list(keys), "left").withColumn("missing", F.col("share").isNull())
            .withColumn(value, F.col("share") * F.col(value)))


def rebin(df: DataFrame, age: str, bands: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Single ages into bands ``(band, lo, hi)``, summed."""
    return range_lookup(df, age, bands, "lo", "hi").groupBy(*keys, "band").agg(F.sum(value).alias(value))


def capped_redistribution(cells: DataFrame, keys: Sequence[str], item: str) -> DataFrame:
    """Split ``target`` by ``share`` without passing ``cap``; what overflows goes to the cells
    that still have room, in proportion to their share.

    One pass: sort by cap/share, find the level t with sum(min(cap, t*share)) = target.
    Cells of one group are the zones of a municipality.
    """
    c = cells.filter("share > 0").withColumn("__r", F.col("cap") / F.col("share"))
    w = W.partitionBy(*keys).orderBy("__r", item)
    before = w.rowsBetween(W.unboundedPreceding, -1)
    rest = w.rowsBetween(W.currentRow, W.unboundedFollowing)
    c = (c.withColumn("__cap", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("__sh", F.sum("share").over(rest))
         .withColumn("__t", (F.col("target") - F.col("__cap")) / F.col("__sh")))
    lvl = c.groupBy(*keys).agg(F.max(F.when(F.col("__t") <= F.col("__r"), F.col("__t"))).alias("__level"))
    return (join_keys(c, lvl, list(keys)).select(*keys, item, "share", "cap", "target",
            F.least(F.col("cap"), F.coalesce(F.col("__level") * F.col("share"), F.col("cap"))).alias("value")))


def crosstab(df: DataFrame, row: str, col: str, values: Sequence[str], weight: Column) -> DataFrame:
    """Two-way table with zero fill; ``values`` are the wanted columns."""
    return df.groupBy(row).pivot(col, list(values)).agg(F.sum(weight)).na.fill(0)


def partition_check(df: DataFrame, keys: Sequence[str], code: str, total: str, leaves: Sequence[str], value: str) -> DataFrame:
    """Do the leaves add up to the declared total? Gap in per cent."""
    g = df.groupBy(*keys).agg(F.sum(F.when(F.col(code) == total, F.col(value)).otherwise(0)).alias("declared"),
                              F.sum(F.when(F.col(code).isin(list(leaves)), F.col(value)).otherwise(0)).alias("leaves"))
    return g.withColumn("gap_pct", (F.col("leaves") - F.col("declared")) * 100.0 / F.nullif(F.col("declared").cast("double"), F.lit(0.0)))


def candidate_leaf_sets(df: DataFrame, code: str, codes: Sequence[str], total: str, value: str, tol: float = 0.005) -> DataFrame:
    """Subsets of the codes, however many, whose sum meets the total within ``tol``.

    Codes are decided one after the other. A partial choice is given up as soon as the codes that are left cannot
    bring it to the total, so the rows are those choices that can still succeed; they are dealt out anew on the way.
    """
    sums = df.agg(F.sum(F.when(F.col(code) == total, F.col(value))).alias("total"),
                  *[F.coalesce(F.sum(F.when(F.col(code) == c, F.col(value))), F.lit(0)).alias(f"s{i}") for i, c in enumerate(codes)])
    slack = F.lit(tol) * F.abs(F.col("total"))
    ends = lambda side, i: reduce(lambda a, b: a + b, [side(F.col(f"s{j}"), F.lit(0)) for j in range(i, len(codes))], F.lit(0))
    d = sums.withColumns({"sum": F.lit(0).cast(sums.schema["s0"].dataType), "chosen": F.array().cast("array<string>")})
    for i, c in enumerate(codes):
        d = d.withColumn("__take", F.explode(F.array(F.lit(False), F.lit(True))))
        d = d.withColumns({"sum": F.when(F.col("__take"), F.col("sum") + F.col(f"s{i}")).otherwise(F.col("sum")),
                           "chosen": F.when(F.col("__take"), F.array_append("chosen", F.lit(c))).otherwise(F.col("chosen"))}).drop("__take")
        d = d.filter((F.col("sum") + ends(F.least, i + 1) <= F.col("total") + slack) & (F.col("sum") + ends(F.greatest, i + 1) >= F.col("total") - slack))
        if i % 8 == 7:
            d = d.repartition("chosen")
    return (d.filter(F.size("chosen") > 0).select(F.array_join("chosen", ",").alias("codes"), "sum", "total")
            .filter(F.abs(F.col("sum") - F.col("total")) <= slack))


def weighted_moments(df: DataFrame, variables: Sequence[str], weight: str, least: int = 100, design: float = 1.66) -> DataFrame:
    """Per variable on its own non-null universe: n, coverage, mean, SD, Kish size, SE and clustered SE."""
    w = F.col(weight)
    base = df.agg(F.sum(w).alias("__all"), *[e for v in variables for e in (
        F.count(v).alias(f"n_{v}"), F.sum(F.when(F.col(v).isNotNull(), w)).alias(f"w_{v}"),
        F.sum(w * F.col(v)).alias(f"x_{v}"), F.sum(w * F.col(v) * F.col(v)).alias(f"q_{v}"),
        F.sum(F.when(F.col(v).isNotNull(), w * w)).alias(f"k_{v}"), F.min(v).alias(f"lo_{v}"), F.max(v).alias(f"hi_{v}"))])
    rows = F.explode(F.array(*[F.struct(F.lit(v).alias("variable"), F.col(f"n_{v}").alias("n"), F.col(f"w_{v}").alias("w"),
                                        F.col(f"x_{v}").alias("x"), F.col(f"q_{v}").alias("q"), F.col(f"k_{v}").alias("k"),
                                        F.col(f"lo_{v}").cast("double").alias("min"), F.col(f"hi_{v}").cast("double").alias("max"))
                               for v in variables]))
    r = base.select("__all", rows.alias("r")).select("__all", "r.*").filter(F.col("n") >= least)
    mean = F.col("x") / F.col("w")
    sd = F.sqrt(F.greatest(F.col("q") / F.col("w") - mean * mean, F.lit(0.0)))
    neff = F.col("w") * F.col("w") / F.col("k")
    return r.select("variable", "n", (F.col("w") / F.col("__all")).alias("coverage"), mean.alias("mean"), sd.alias("sd"),
                    neff.alias("n_eff"), (sd / F.sqrt(neff)).alias("se"),
                    (sd / F.sqrt(neff) * F.sqrt(F.lit(design))).alias("se_cluster"), "min", "max")


def kish_reuse(df: DataFrame, donor: str, keys: Sequence[str] = ()) -> DataFrame:
    """Donor reuse per subpopulation: n, donors, effective donors and the error band factor."""
    m = df.groupBy(*keys, donor).agg(F.count("*").alias("m"))
    g = m.groupBy(*keys).agg(F.sum("m").alias("n"), F.count("*").alias("donors"),
                             (F.pow(F.sum("m"), F.lit(2.0)) / F.sum(F.col("m") * F.col("m"))).alias("n_eff"))
    return g.withColumn("band", F.sqrt(F.col("n") / F.col("n_eff")))


def signature(columns: Sequence[str]) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns])


def signature_reuse(df: DataFrame, columns: Sequence[str], cell: str) -> DataFrame:
    """How often each answer vector occurs: summary over vectors, and how many stay in one cell."""
    s = df.groupBy(signature(columns).alias("sig"), cell).agg(F.count("*").alias("c"))
    m = cut_lineage(s.groupBy("sig").agg(F.sum("c").alias("m"), F.count("*").alias("cells")))
    q = quantiles(m, [], "m", {"q50": 0.5, "q90": 0.9})
    top = m.groupBy().agg(F.max(F.struct("m", "sig")).alias("t")).select(F.col("t.sig").alias("heaviest"))
    g = m.agg(F.count("*").alias("signatures"), F.avg("m").alias("mean"), F.min("m").alias("min"), F.max("m").alias("max"),
              F.sum((F.col("m") == 1).cast("bigint")).alias("singletons"), F.avg((F.col("cells") == 1).cast("double")).alias("one_cell"))
    return beside(beside(g, q.withColumnRenamed("q50", "median")), top)


def correlation_gap(a: DataFrame, b: DataFrame, variables: Sequence[str], least: int = 100) -> DataFrame:
    """Pearson per pair of variables in two tables and the gap; pairs need ``least`` joint rows."""
    pairs = list(combinations(variables, 2))
    def side(df, p):
        g = df.agg(*[e for i, (x, y) in enumerate(pairs) for e in (
            F.corr(x, y).alias(f"r{i}"), F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)).alias(f"n{i}"))])
        return g.select(F.explode(F.array(*[F.struct(F.lit(f"{x}~{y}").alias("pair"), F.col(f"r{i}").alias(f"r_{p}"),
                                                     F.col(f"n{i}").alias(f"n_{p}")) for i, (x, y) in enumerate(pairs)])).alias("s")).select("s.*")
    return (side(a, "a").join(side(b, "b"), "pair").filter((F.col("n_a") >= least) & (F.col("n_b") >= least))
            .withColumn("gap", F.abs(F.col("r_a") - F.col("r_b"))))


def intraclass(df: DataFrame, cluster: str, value: str) -> DataFrame:
    """One-way ANOVA intraclass correlation over clusters of two or more, with the mean size n0."""
    c = (df.filter(F.col(value).isNotNull()).groupBy(cluster)
         .agg(F.count("*").alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q")).filter("n > 1"))
    t = c.agg(F.count("*").alias("k"), F.sum("n").alias("N"), F.sum(F.col("n") * F.col("n")).alias("n2"),
              F.sum("s").alias("S"), F.sum("q").alias("Q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("B"))
    msb = (F.col("B") - F.col("S") * F.col("S") / F.col("N")) / (F.col("k") - 1)
    msw = (F.col("Q") - F.col("B")) / (F.col("N") - F.col("k"))
    n0 = (F.col("N") - F.col("n2") / F.col("N")) / (F.col("k") - 1)
    return t.select(F.col("k").alias("clusters"), F.col("N").alias("persons"), n0.alias("n0"),
                    ((msb - msw) / (msb + (n0 - 1) * msw)).alias("icc"))


def column_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: rows, castable share, min, max, negatives, distinct values; one scan, no row is multiplied
    except for the distinct count, which works on distinct (column, value) pairs."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value"))
                                         for c in columns])).alias("r")).select("r.*")
    v = long.groupBy("name", "value").agg(F.count("*").alias("c"))
    x = F.col("value").try_cast("double")
    g = v.groupBy("name").agg(F.sum("c").alias("rows"), F.sum(F.when(x.isNotNull(), F.col("c")).otherwise(0)).alias("num"),
                              F.sum(F.when(F.col("value").isNotNull(), F.col("c")).otherwise(0)).alias("filled"),
                              F.min(x).alias("lo"), F.max(x).alias("hi"),
                              F.sum(F.when(x < 0, F.col("c")).otherwise(0)).alias("neg"), F.count("value").alias("distinct"))
    numeric = F.col("num") >= 0.9 * F.col("filled")
    return g.select("name", "rows", numeric.alias("numeric"), F.when(numeric, F.col("lo")).alias("min"),
                    F.when(numeric, F.col("hi")).alias("max"), F.when(numeric, F.col("neg")).otherwise(0).alias("negatives"), "distinct")


def column_shape(profile: DataFrame, few: int, many: int, lo: float, hi: float) -> DataFrame:
    """Numeric columns with a distinct count and a range that fit a code list."""
    return profile.filter(F.col("numeric") & F.col("distinct").between(few, many) & (F.col("min") >= lo) & (F.col("max") <= hi))


def fit_to_census(synthetic: DataFrame, census: DataFrame, unit: str, measures: Sequence[str]) -> DataFrame:
    """Per measure: totals, mean absolute error and Pearson over units; a unit nobody was put in counts as 0."""
    s = synthetic.select(unit, *[F.col(m).alias(f"s_{m}") for m in measures])
    j = census.join(s, unit, "left").na.fill(0, [f"s_{m}" for m in measures])
    g = j.agg(*[e for m in measures for e in (F.sum(f"s_{m}").alias(f"a_{m}"), F.sum(m).alias(f"b_{m}"),
              F.avg(F.abs(F.col(f"s_{m}") - F.col(m))).alias(f"e_{m}"), F.corr(f"s_{m}", m).alias(f"r_{m}"))])
    return g.select(F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(f"a_{m}").cast("double").alias("synthetic"),
                    F.col(f"b_{m}").cast("double").alias("census"), F.col(f"e_{m}").alias("mae"), F.col(f"r_{m}").alias("pearson"))
                    for m in measures])).alias("r")).select("r.*")


def variance_split(units: DataFrame, zone: str, n: str, k: str) -> DataFrame:
    """Between-zone, within-zone and binomial-noise variance of a share k/n over units, weighted by n."""
    u = units.filter(F.col(n) > 0).withColumn("__p", F.col(k) / F.col(n))
    z = u.groupBy(zone).agg(F.sum(n).alias("N"), F.sum(k).alias("K"), F.sum(F.col(n) * F.col("__p") * F.col("__p")).alias("Q"),
                            F.sum(F.col("__p") * (1 - F.col("__p"))).alias("E"))
    p = F.col("K") / F.col("N")
    t = z.agg(F.sum("N").alias("N"), F.sum("K").alias("K"), F.sum(F.col("N") * p * p).alias("B"),
              F.sum("Q").alias("Q"), F.sum("E").alias("E"))
    between = F.col("B") / F.col("N") - F.pow(F.col("K") / F.col("N"), F.lit(2.0))
    within = (F.col("Q") - F.col("B")) / F.col("N")
    noise = F.col("E") / F.col("N")
    return t.select(between.alias("between"), within.alias("within"), noise.alias("noise"),
                    (between / (between + F.greatest(within - noise, F.lit(0.0)))).alias("ratio"))


def class_residuals(synthetic: DataFrame, wide: DataFrame, unit: str, classes: dict[str, str]) -> DataFrame:
    """Wide unit table (one column per class) against counts of persons: one row per (unit, class)."""
    long = wide.select(unit, *[F.col(c).alias(k) for k, c in classes.items()]).unpivot([unit], list(classes), "klass", "census")
    s = synthetic.groupBy(unit, "klass").agg(F.count("*").alias("synthetic"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    return (long.join(s, [unit, "klass"], "full_outer")
            .select(unit, "klass", z("census").alias("census"), z("synthetic").alias("synthetic"),
                    (z("synthetic") - z("census")).alias("residual")))


def residual_summary(res: DataFrame, by: str) -> DataFrame:
    return res.groupBy(by).agg(F.count("*").alias("n"), F.avg(F.abs("residual")).alias("mae"), F.avg("residual").alias("bias"))


def design_cells(df: DataFrame, place: str, places: Sequence[str], cell: str, take: int) -> DataFrame:
    """Sub-sample report: per design cell the count in every place, the pooled count and how many are taken."""
    p = df.groupBy(cell).pivot(place, list(places)).count().na.fill(0)
    pooled = reduce(lambda a, b: a + b, [F.col(str(x)) for x in places])
    return p.withColumn("pooled", pooled).withColumn("take", F.least(F.col("pooled"), F.lit(take)))
