"""Total variation distances, conditional profiles, information measures and null models.

Everything starts from cells ``(unit, category, n)``. A category a unit lacks needs no row: its
share of the base is added through one minus the sum of the base shares that are present.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from popweave.functions import fixed_values as V
from popweave.functions.draws import draw
from popweave.operators.aggregates import beside, share_of, with_totals
from popweave.operators.cube import all_subsets, margins
from popweave.plans.intervals import cumulative_table, pick
from popweave.plans.ranking import join_keys, quantiles, rank_by_draw
from popweave.session import cut_lineage

LEAST_SUPPORT = 0.5


def _sum_if(cond: Column, v: Column) -> Column:
    return F.sum(F.when(cond, v).otherwise(0))


def tvd(a: DataFrame, b: DataFrame, category: str, keys: Sequence[str] = (), weight: str = "w",
        least_support: float = LEAST_SUPPORT) -> DataFrame:
    """Distance of two compositions per key; null when they share too few categories."""
    tag = lambda d, x, y: d.filter(F.col(weight) > 0).select(*keys, category, x.alias("a"), y.alias("b"))
    w, z = F.col(weight).cast("double"), F.lit(0.0)
    cells = tag(a, w, z).unionByName(tag(b, z, w)).groupBy(*keys, category).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    t = with_totals(cells, keys, {"__a": F.sum("a"), "__b": F.sum("b")})
    g = t.groupBy(*keys).agg(
        (F.sum(F.abs(share_of(F.col("a"), F.col("__a")) - share_of(F.col("b"), F.col("__b")))) / 2).alias("d"),
        F.sum((F.col("a") > 0).cast("bigint")).alias("support_a"), F.sum((F.col("b") > 0).cast("bigint")).alias("support_b"),
        F.sum(((F.col("a") > 0) & (F.col("b") > 0)).cast("bigint")).alias("common"), F.count("*").alias("__u"))
    ok = F.col("common") >= F.lit(least_support) * F.col("__u")
    return g.select(*keys, F.when(ok, F.col("d")).alias("tvd"), "support_a", "support_b", "common",
                    F.when(F.col("d").isNull(), "no mass").when(~ok, "supports too different").otherwise("").alias("note"))


def unit_distances(cells: DataFrame, base: Sequence[str], unit: str, category: str, n: str, least: float = 0,
                   extra: Sequence[str] = (), leave_out: bool = False) -> DataFrame:
    """TVD of every unit against its base composition (minus the unit itself with ``leave_out``).

    ``cells`` has one row per (extra, base, unit, category). Result per (extra, base, unit): n, tvd.
    """
    kb, ku = [*extra, *base], [*extra, *base, unit]
    g = cells.groupBy(*kb, category).agg(F.sum(n).cast("double").alias("__gc"))
    g = with_totals(g, kb, {"__g": F.sum("__gc")})
    u = with_totals(cells.groupBy(*ku, category).agg(F.sum(n).cast("double").alias("__uc")), ku, {"__n": F.sum("__uc")})
    j = join_keys(u, g, [*kb, category])
    q = (F.col("__gc") - F.col("__uc")) / F.nullif(F.col("__g") - F.col("__n"), F.lit(0.0)) if leave_out else F.col("__gc") / F.col("__g")
    rest = F.lit(1.0) - F.sum(q)
    d = (F.sum(F.abs(F.col("__uc") / F.col("__n") - q)) + F.greatest(rest, F.lit(0.0))) / 2
    return j.groupBy(*ku).agg(F.max("__n").alias("n"), d.alias("tvd")).filter((F.col("n") >= least) & (F.col("n") > 0))


def weighted_distance(units: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """n-weighted mean of unit distances."""
    return units.filter("tvd is not null").groupBy(*keys).agg((F.sum(F.col("n") * F.col("tvd")) / F.sum("n")).alias("mean_tvd"),
                                                              F.count("*").alias("units"))


def conditional_profile(df: DataFrame, variable: str, conditioners: Sequence[str], weight: Column | None = None, least: float = 0,
                        totals: Sequence[str] = tuple(V.TOTAL_CODES), least_support: float = LEAST_SUPPORT) -> DataFrame:
    """Distance of the variable's composition in every (conditioner, value) from the marginal one.

    One scan: rows are reduced to cells of all columns first, then opened per conditioner.
    """
    w = F.count("*").cast("double") if weight is None else F.sum(weight)
    full = df.groupBy(variable, *conditioners).agg(w.alias("__w"))
    every = F.struct(F.lit("*").alias("conditioner"), F.lit("*").alias("value"))      # the marginal is one more conditioner
    pairs = F.array(every, *[F.struct(F.lit(c).alias("conditioner"), F.col(c).cast("string").alias("value")) for c in conditioners])
    cells = (full.select(variable, "__w", F.explode(pairs).alias("p")).select(variable, "__w", "p.*")
             .groupBy("conditioner", "value", variable).agg(F.sum("__w").alias("__c")).filter(F.col("__c") > 0))
    cells = cells.filter(F.col("value").isNotNull() & ~F.col("value").isin(list(totals)))
    u = with_totals(cells, ["conditioner", "value"], {"__n": F.sum("__c"), "__s": F.count("*")})
    marg = u.filter("conditioner = '*'").select(variable, F.col("__c").alias("__m"), F.col("__n").alias("__t"), F.col("__s").alias("__k"))
    j = join_keys(u.filter("conditioner <> '*'").drop("__s"), marg, [variable])
    q = F.col("__m") / F.col("__t")
    g = j.groupBy("conditioner", "value").agg(F.max("__n").alias("n"), F.count("*").alias("support"), F.max("__k").alias("__k"),
        ((F.sum(F.abs(F.col("__c") / F.col("__n") - q)) + F.greatest(F.lit(1.0) - F.sum(q), F.lit(0.0))) / 2).alias("d"))
    ok = F.col("support") >= F.lit(least_support) * F.col("__k")
    return (g.filter(F.col("n") >= least)
            .select("conditioner", "value", "n", "support", F.when(ok, F.col("d")).alias("tvd"),
                    F.when(ok, "").otherwise("supports too different").alias("note")))


def conditioner_ranking(profile: DataFrame) -> DataFrame:
    """min / median / max distance per conditioner and how many values could not be measured."""
    profile = cut_lineage(profile)      # one row per conditioner value
    base = profile.groupBy("conditioner").agg(F.count("*").alias("cells"), F.min("tvd").alias("min"), F.max("tvd").alias("max"),
                                              F.sum(F.col("tvd").isNull().cast("bigint")).alias("unmeasured"))
    return base.join(quantiles(profile, ["conditioner"], "tvd", {"median": 0.5}), "conditioner", "left")


def independence_gap(df: DataFrame, x: str, y: str, keys: Sequence[str] = (), weight: Column | None = None) -> DataFrame:
    """TVD between P(x, y) and P(x)P(y); absent pairs enter through the total of the products."""
    w = F.count("*").cast("double") if weight is None else F.sum(weight)
    c = df.groupBy(*keys, x, y).agg(w.alias("__c"))
    c = with_totals(with_totals(with_totals(c, [*keys, x], {"__x": F.sum("__c")}), [*keys, y], {"__y": F.sum("__c")}), keys, {"__n": F.sum("__c")})
    p, pq = F.col("__c") / F.col("__n"), F.col("__x") * F.col("__y") / (F.col("__n") * F.col("__n"))
    return c.groupBy(*keys).agg(((F.sum(F.abs(p - pq)) + F.greatest(F.lit(1.0) - F.sum(pq), F.lit(0.0))) / 2).alias("tvd"), F.count("*").alias("cells"))


def margin_distances(df: DataFrame, run: str, a: str, b: str, variables: Sequence[str], k: int) -> DataFrame:
    """TVD of two runs on every subset of up to k variables; one scan, grouping sets over cells."""
    flag = lambda r: F.when(F.col(run) == r, 1).otherwise(0)
    d = df.filter(F.col(run).isin(a, b)).groupBy(*variables).agg(F.sum(flag(a)).alias("__a"), F.sum(flag(b)).alias("__b"))
    j = margins(d, all_subsets(variables, k), {"na": F.col("__a"), "nb": F.col("__b")})
    t = with_totals(j, ["block"], {"__ta": F.sum("na"), "__tb": F.sum("nb")})
    return t.groupBy("block").agg((F.sum(F.abs(share_of(F.col("na"), F.col("__ta")) - share_of(F.col("nb"), F.col("__tb")))) / 2).alias("tvd"),
                                  F.count("*").alias("cells"))


def against_null_pair(real: DataFrame, null: DataFrame) -> DataFrame:
    """Distance of two runs per margin over the distance of a null pair of runs."""
    j = real.join(null.select("block", F.col("tvd").alias("null_tvd")), "block", "left")
    return j.withColumn("ratio", F.try_divide(F.col("tvd"), F.col("null_tvd")))


def holdout_position(truth: DataFrame, full: DataFrame, held: DataFrame, independent: DataFrame, category: str) -> DataFrame:
    """Where the held-out run lies between the constrained floor (0) and independence (1)."""
    truth = cut_lineage(truth)
    d = lambda x: tvd(truth, x, category, least_support=0.0).select("tvd").scalar()
    one = truth.groupBy().agg(F.countDistinct(category).alias("cells"))
    o = one.withColumn("floor", d(full)).withColumn("holdout", d(held)).withColumn("independence", d(independent))
    span = F.col("independence") - F.col("floor")
    return o.withColumn("position", F.when(span > 0, (F.col("holdout") - F.col("floor")) / span))


def cell_audit(observed: DataFrame, constraints: DataFrame, size: Column) -> DataFrame:
    """z-score, relative error and sampling floor of every constrained cell.

    ``observed(block, cell, n)``, ``constraints(block, cell, alpha)``.
    """
    j = constraints.join(observed, ["block", "cell"], "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("__N", size)
    a, n_ = F.col("alpha"), F.col("__N")
    e = a * n_
    return j.select("block", "cell", "alpha", "n", e.alias("expected"),
                    F.when((a > 0) & (a < 1), (F.col("n") - e) / F.sqrt(n_ * a * (1 - a))).alias("z"),
                    F.when(a > 0, F.abs(F.col("n") - e) / e).alias("rel_error"),
                    F.when((a > 0) & (a < 1), F.sqrt((1 - a) / (a * n_))).alias("floor"), ((a <= 0) & (F.col("n") > 0)).alias("violation"))


def audit_summary(cells: DataFrame, keys: Sequence[str] = ("block",)) -> DataFrame:
    return cells.groupBy(*keys).agg(F.count("*").alias("cells"), F.avg("rel_error").alias("mre"), F.avg("floor").alias("floor"),
                                    F.avg(F.abs("z")).alias("mean_abs_z"), F.max(F.abs("z")).alias("max_abs_z"),
                                    F.avg((F.abs("z") > 3).cast("double")).alias("share_above_3"), F.sum(F.col("violation").cast("bigint")).alias("violations"))


def information(cells: DataFrame, group: str, category: str, n: str, keys: Sequence[str] = ()) -> DataFrame:
    """Mutual information, entropy of the category and the analytic bias, in nats."""
    c = cells.groupBy(*keys, group, category).agg(F.sum(n).cast("double").alias("__c")).filter(F.col("__c") > 0)
    c = with_totals(with_totals(with_totals(c, [*keys, group], {"__g": F.sum("__c")}), [*keys, category], {"__k": F.sum("__c")}), keys, {"__n": F.sum("__c")})
    mi = F.sum(F.col("__c") / F.col("__n") * F.log(F.col("__c") * F.col("__n") / (F.col("__g") * F.col("__k"))))
    h = F.sum(-F.col("__c") / F.col("__n") * F.log(F.col("__k") / F.col("__n")))
    return c.groupBy(*keys).agg(mi.alias("mi"), h.alias("entropy"), F.countDistinct(group).alias("groups"), F.countDistinct(category).alias("categories"),
                                F.max("__n").alias("n")).withColumn("bias", (F.col("groups") - 1) * (F.col("categories") - 1) / (2 * F.col("n")))


def drawn_units(members: DataFrame, base: Sequence[str], unit: str, category: str, key: str, replicates: int, channel: str = "floor") -> DataFrame:
    """Cells of B replicates in which every member draws its category from the base composition."""
    comp = members.groupBy(*base, category).agg(F.count("*").alias("__w"))
    table = cumulative_table(comp, base, "__w", [category])
    reps = members.select(*base, unit, key).withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    got = pick(reps, table, base, [category], u=draw(channel, "replicate", key))
    return got.groupBy("replicate", *base, unit, category).agg(F.count("*").alias("n"))


def permuted_units(members: DataFrame, base: Sequence[str], unit: str, category: str, key: str, replicates: int, channel: str = "perm") -> DataFrame:
    """Cells of B shuffles of the category labels inside the base: counts per label are kept.

    A shuffle is a rank by hash draw, cut at the running label counts.
    """
    comp = members.groupBy(*base, category).agg(F.count("*").alias("__w"))
    table = cumulative_table(comp, base, "__w", [category])
    reps = (members.select(*base, unit, key).withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
            .withColumn("__u", draw(channel, "replicate", key)))
    ranked = rank_by_draw(reps, ["replicate", *base], "__u", [key], "__r")
    got = pick(ranked, table, base, [category], position=F.col("__r") - 1)
    return got.groupBy("replicate", *base, unit, category).agg(F.count("*").alias("n"))


def against_null(observed: Column, null: DataFrame, value: str) -> DataFrame:
    """Excess, z and p of an observed statistic over its replicates, with the null's centre and p95.

    The replicates are written once (one row each), because the statistics below read them several times.
    """
    null = cut_lineage(null)
    q = quantiles(null, [], value, {"median": 0.5, "p95": 0.95})
    g = null.withColumn("__o", observed).agg(F.max("__o").alias("observed"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"),
             F.sum((F.col(value) >= F.col("__o")).cast("bigint")).alias("__ge"), F.count("*").alias("replicates"))
    return (beside(g, q).withColumn("excess", F.col("observed") - F.col("median")).withColumn("z", F.try_divide(F.col("observed") - F.col("mean"), F.col("sd")))
            .withColumn("p", (1 + F.col("__ge")) / (1 + F.col("replicates"))).drop("__ge"))


def weighted_correlation(df: DataFrame, a: str, b: str, w: str, keys: Sequence[str] = ()) -> DataFrame:
    """Weighted Pearson of two shares over units where both exist; null under four units."""
    d = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(w) > 0))
    A, B, W_ = F.col(a), F.col(b), F.col(w)
    g = d.groupBy(*keys).agg(F.count("*").alias("units"), F.sum(W_).alias("sw"), F.sum(W_ * A).alias("sa"), F.sum(W_ * B).alias("sb"),
                             F.sum(W_ * A * B).alias("sab"), F.sum(W_ * A * A).alias("saa"), F.sum(W_ * B * B).alias("sbb"))
    c = F.col
    cov = c("sab") / c("sw") - c("sa") * c("sb") / (c("sw") * c("sw"))
    va = c("saa") / c("sw") - c("sa") * c("sa") / (c("sw") * c("sw"))
    vb = c("sbb") / c("sw") - c("sb") * c("sb") / (c("sw") * c("sw"))
    return g.select(*keys, "units", F.when((c("units") >= 4) & (va > 0) & (vb > 0), cov / F.sqrt(va * vb)).alias("pearson"))


def age_against_register(cells: DataFrame, sex: str, age: str, block: str, synthetic: str, register: str) -> DataFrame:
    """TVD of single ages, split between blocks and within blocks, and the ratio range where the register has 50."""
    c = with_totals(cells, [], {"__r": F.sum(register), "__s": F.sum(synthetic)})
    c = c.withColumn("__pa", F.col(register) / F.col("__r")).withColumn("__pt", F.col(synthetic) / F.col("__s"))
    b = c.groupBy(sex, block).agg(F.sum("__pa").alias("__ba"), F.sum("__pt").alias("__bt"))
    j = join_keys(c, b, [sex, block])
    within = F.col("__pt") - F.col("__bt") * F.coalesce(F.try_divide(F.col("__pa"), F.col("__ba")), F.lit(0.0))
    ratio = F.when(F.col(register) >= 50, F.col(synthetic) / F.col(register))
    g = j.agg(F.sum(synthetic).alias("n"), (F.sum(F.abs(F.col("__pa") - F.col("__pt"))) / 2).alias("tvd"), (F.sum(F.abs(within)) / 2).alias("within"),
              F.min(ratio).alias("ratio_min"), F.max(ratio).alias("ratio_max"))
    return g.withColumn("between", b.agg(F.sum(F.abs(F.col("__ba") - F.col("__bt"))) / 2).scalar())


def denominators_agree(df: DataFrame, keys: Sequence[str], a: str, b: str, tol: float = 0.02) -> DataFrame:
    g = df.groupBy(*keys).agg(F.sum(a).alias("a"), F.sum(b).alias("b"))
    ratio = F.try_divide(F.col("a").cast("double"), F.col("b").cast("double"))
    return g.withColumn("ratio", ratio).withColumn("ok", F.coalesce(F.abs(ratio - 1) <= tol, F.lit(False)))


def snapshot_change(a: DataFrame, b: DataFrame, key: str, variables: Sequence[str]) -> DataFrame:
    """Share of ids whose value changed and H(new | old) per variable, from cells of (old, new)."""
    j = a.select(key, *[F.col(v).alias(f"__a_{v}") for v in variables]).join(b.select(key, *[F.col(v).alias(f"__b_{v}") for v in variables]), key)
    pairs = F.array(*[F.struct(F.lit(v).alias("variable"), F.col(f"__a_{v}").cast("string").alias("old"), F.col(f"__b_{v}").cast("string").alias("new")) for v in variables])
    c = j.select(F.explode(pairs).alias("p")).select("p.*").groupBy("variable", "old", "new").agg(F.count("*").alias("c"))
    c = with_totals(with_totals(c, ["variable", "old"], {"__o": F.sum("c")}), ["variable"], {"__n": F.sum("c")})
    changed = F.sum(F.when(F.col("old").eqNullSafe(F.col("new")), 0).otherwise(F.col("c"))) / F.max("__n")
    h = F.sum(-F.col("c") / F.col("__n") * F.log(F.col("c") / F.col("__o")))
    return c.groupBy("variable").agg(changed.alias("changed"), F.abs(h).alias("conditional_entropy"), F.max("__n").alias("ids"))
