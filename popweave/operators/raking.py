"""Iterative proportional fitting as Spark jobs.

The table itself never changes: the state is one factor per margin cell, a small frame. Every pass
scans the cells, adds them up by margin (reduced inside each task) and yields the next factors, so
the cells are neither shuffled whole nor rewritten.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from popweave.operators.aggregates import with_totals
from popweave.plans.ranking import join_keys
from popweave.session import cut_lineage

SUPPORT = 1e-9


def _factors(cells: DataFrame, mass: Column, keys: Sequence[str], target: DataFrame, keep_missing: bool) -> DataFrame:
    """target / achieved per margin cell; 1 for classes without a target when ``keep_missing``, else 0."""
    got = cells.groupBy(*keys).agg(F.sum(mass).alias("__s"))
    j = join_keys(got, target.select(*keys, F.col("target").cast("double").alias("__t")), list(keys), "left")
    f = F.col("__t") / F.when(F.col("__s") == 0, F.lit(1.0)).otherwise(F.col("__s"))
    return j.select(*keys, F.coalesce(f, F.lit(1.0 if keep_missing else 0.0)).alias("__f"))


def rake_two(cells: DataFrame, value: str, rows: Sequence[str], cols: Sequence[str], row_target: DataFrame, col_target: DataFrame,
             sweeps: int = 300, tolerance: float | None = None, keep_missing: bool = False, cut_every: int = 8, out: str = "fitted") -> DataFrame:
    """Fit cells to two margins. Shared key columns in ``rows`` and ``cols`` make strata that rake together.

    Targets are ``(keys..., target)``. Without ``tolerance`` exactly ``sweeps`` sweeps are run. With it, the
    largest row miss is looked at every ``cut_every`` sweeps. Cells and targets are written once at the
    start, because every sweep reads them again.
    """
    m = F.col(value).cast("double")
    cells, row_target, col_target = cut_lineage(cells), cut_lineage(row_target), cut_lineage(col_target)
    col_f = None
    for i in range(1, sweeps + 1):
        d = cells if col_f is None else join_keys(cells, col_f.withColumnRenamed("__f", "__fc"), list(cols))
        row_f = _factors(d, m if col_f is None else m * F.col("__fc"), rows, row_target, keep_missing)
        d = join_keys(cells, row_f.withColumnRenamed("__f", "__fr"), list(rows))
        col_f = _factors(d, m * F.col("__fr"), cols, col_target, keep_missing)
        if i % cut_every == 0 and i < sweeps:
            row_f, col_f = cut_lineage(row_f), cut_lineage(col_f)
            if tolerance is not None and _row_miss(cells, m, rows, cols, row_f, col_f, row_target) < tolerance:
                break
    d = join_keys(join_keys(cells, row_f.withColumnRenamed("__f", "__fr"), list(rows)), col_f.withColumnRenamed("__f", "__fc"), list(cols))
    return d.withColumn(out, m * F.col("__fr") * F.col("__fc")).drop("__fr", "__fc")


def _row_miss(cells, m, rows, cols, row_f, col_f, row_target) -> float:
    d = join_keys(join_keys(cells, row_f.withColumnRenamed("__f", "__fr"), list(rows)), col_f.withColumnRenamed("__f", "__fc"), list(cols))
    got = d.groupBy(*rows).agg(F.sum(m * F.col("__fr") * F.col("__fc")).alias("__s"))
    miss = join_keys(got, row_target.withColumnRenamed("target", "__t"), list(rows)).agg(F.max(F.abs(F.col("__s") - F.col("__t"))))
    return miss.first()[0] or 0.0


def release_dead_targets(cells: DataFrame, allowed: Column, col_keys: Sequence[str], target: DataFrame) -> DataFrame:
    """Allowed cells, plus all cells of a positive target that no cell could serve."""
    ok = cells.withColumn("__ok", allowed)
    dead = ok.groupBy(*col_keys).agg(F.bool_or("__ok").alias("__any"))
    dead = join_keys(dead, target, list(col_keys)).filter((~F.col("__any")) & (F.col("target") > 0)).select(*col_keys, F.lit(True).alias("__dead"))
    return join_keys(ok, dead, list(col_keys), "left").filter(F.col("__ok") | F.coalesce("__dead", F.lit(False))).drop("__ok", "__dead")


def country_seed(local: DataFrame, margin: DataFrame, units: DataFrame, residual: str) -> DataFrame:
    """(paese, sesso, geo, seed) from a local source in the common layout ``(geo, sesso, paese, n)``.

    Named countries keep their local count. The residual of a (geo, sex) is spread over the countries not
    named there by their census share; a missing sex is split by the country's census sex quota. Cells the
    source does not reach get a tiny seed. ``margin(paese, sesso, n)`` has few rows: countries by sex.
    """
    nat = with_totals(margin.groupBy("paese").agg(F.sum("n").alias("__p")), [], {"__all": F.sum("__p")}).select("paese", (F.col("__p") / F.col("__all")).alias("nat"))
    sexes = F.explode(F.array(F.lit("M"), F.lit("F")))
    grid = nat.withColumn("sesso", sexes).join(margin.groupBy("paese", "sesso").agg(F.sum("n").alias("__ps")), ["paese", "sesso"], "left")
    grid = with_totals(grid, ["paese"], {"__pp": F.sum("__ps")})
    grid = grid.select("paese", "sesso", "nat", F.coalesce(F.try_divide(F.coalesce("__ps", F.lit(0)).cast("double"), F.col("__pp").cast("double")), F.lit(0.5)).alias("quota"))
    packed = grid.agg(F.collect_list(F.struct("paese", "sesso", "nat", "quota")).alias("g"))
    cells = units.select("geo").distinct().withColumn("g", F.explode(packed.scalar())).select("geo", "g.*")
    loc = local.withColumn("slot", F.coalesce("sesso", F.lit("*"))).groupBy("geo", "slot", "paese").agg(F.sum("n").alias("n"))
    rest = loc.filter(F.col("paese") == residual).select("geo", "slot", F.col("n").alias("__rest"))
    named = loc.filter(F.col("paese") != residual).select("geo", "slot", "paese", F.col("n").alias("__n"))
    wide = cells.withColumn("slot", F.explode(F.array(F.col("sesso"), F.lit("*"))))
    j = wide.join(named, ["geo", "slot", "paese"], "left").join(rest, ["geo", "slot"], "left")
    j = with_totals(j, ["geo", "slot", "sesso"], {"__free": F.sum(F.when(F.col("__n").isNull(), F.col("nat")).otherwise(0.0))})
    got = F.when(F.col("__n").isNotNull(), F.col("__n")).otherwise(F.coalesce(F.col("__rest") * F.try_divide(F.col("nat"), F.col("__free")), F.lit(0.0)))
    part = got * F.when(F.col("slot") == "*", F.col("quota")).otherwise(F.lit(1.0))
    return j.groupBy("paese", "sesso", "geo").agg(F.greatest(F.sum(part), F.lit(1e-12)).alias("seed"))


def usable_margin(df: DataFrame, keys: Sequence[str], klass: str, value: str, classes: int = 6, least: float = 300) -> DataFrame:
    """A margin can calibrate only when it has all classes and enough units."""
    g = df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.countDistinct(klass).alias("classes"), F.sum(value).alias("units"))
    return g.withColumn("usable", (F.col("classes") >= classes) & (F.col("units") >= least))


def calibrate(joint: DataFrame, weight: str, strata: Sequence[str], a: str, b: str, target_a: DataFrame, target_b: DataFrame, sweeps: int = 100,
              tolerance: float | None = None, out: str = "calibrated") -> DataFrame:
    """Rake a joint to two grouped margins given as counts; classes without a target are left alone, mass is restored."""
    norm = lambda t, k: with_totals(t, list(strata), {"__t": F.sum("target")}).select(*strata, k, (F.col("target") / F.col("__t")).alias("target"))
    j = with_totals(joint, list(strata), {"__m": F.sum(weight)}).withColumn("__w", F.col(weight) / F.col("__m"))
    f = rake_two(j, "__w", [*strata, a], [*strata, b], norm(target_a, a), norm(target_b, b), sweeps, tolerance, keep_missing=True, out="__w2")
    f = with_totals(f, list(strata), {"__s": F.sum("__w2")})
    return f.withColumn(out, F.col("__w2") * F.col("__m") / F.col("__s")).drop("__w", "__w2", "__m", "__s")


def calibration_miss(df: DataFrame, weight: str, strata: Sequence[str], klass: str, target: DataFrame) -> DataFrame:
    """Half the L1 distance between achieved and wanted shares over the classes with a target."""
    got = with_totals(df.groupBy(*strata, klass).agg(F.sum(weight).alias("__g")), list(strata), {"__gt": F.sum("__g")})
    want = with_totals(target, list(strata), {"__tt": F.sum("target")})
    j = join_keys(want, got, [*strata, klass], "left")
    diff = F.abs(F.coalesce(F.col("__g") / F.col("__gt"), F.lit(0.0)) - F.col("target") / F.col("__tt"))
    return j.groupBy(*strata).agg((F.sum(diff) / 2).alias("miss"))


def rake_blocks(lattice: DataFrame, blocks: Sequence[tuple[Sequence[str], DataFrame]], sweeps: int = 100, tolerance: float | None = None, out: str = "p") -> DataFrame:
    """Cell probabilities over a lattice that meet many blocks of constraints.

    A block is ``(attributes, frame(attributes..., alpha))`` with one row per constrained cell. One pass per
    block scales its cells to alpha; cells the block does not list share the rest, 1 - sum(alpha). The start
    is uniform on the allowed lattice. ``p`` stays on the rows: a pass adds it up by block, writes the factors (a small
    table) and multiplies by one join; the rows are written anew after each sweep. With ``tolerance`` the sweeps end
    once the mean relative error of all constraints is below it.
    """
    lattice = cut_lineage(lattice)
    blocks = [(list(attrs), cut_lineage(alpha.select(*attrs, "alpha"))) for attrs, alpha in blocks]
    d = lattice.withColumn("__p", F.lit(1.0 / max(1, lattice.count())))
    for s in range(1, sweeps + 1):
        for attrs, alpha in blocks:
            q = d.groupBy(*attrs).agg(F.sum("__p").alias("__q"))
            j = cut_lineage(join_keys(q, alpha.withColumnRenamed("alpha", "__a"), attrs, "left"))
            t = with_totals(j, [], {"__sa": F.sum("__a"), "__sq": F.sum(F.when(F.col("__a").isNotNull(), F.col("__q")))})
            outside = F.try_divide(F.greatest(1 - F.col("__sa"), F.lit(0.0)), F.when(1 - F.col("__sq") > 1e-15, 1 - F.col("__sq")))
            scale = F.when(F.col("__a").isNotNull(), F.coalesce(F.try_divide(F.col("__a"), F.col("__q")), F.lit(0.0))).otherwise(F.coalesce(outside, F.lit(1.0)))
            d = join_keys(d, t.select(*attrs, scale.alias("__f")), attrs).withColumn("__p", F.col("__p") * F.col("__f")).drop("__f")
        if s < sweeps or tolerance is not None:
            d = cut_lineage(d)
        if tolerance is not None and (block_error(d, "__p", blocks).agg(F.avg("rel_error")).first()[0] or 0.0) < tolerance:
            break
    return with_totals(d.select(*lattice.columns, "__p"), [], {"__t": F.sum("__p")}).withColumn(out, F.col("__p") / F.col("__t")).drop("__p", "__t")


def block_error(fitted: DataFrame, p: str, blocks: Sequence[tuple[Sequence[str], DataFrame]]) -> DataFrame:
    """Relative error of every positive constraint."""
    parts = []
    for i, (attrs, alpha) in enumerate(blocks):
        q = fitted.groupBy(*attrs).agg(F.sum(p).alias("__q"))
        j = join_keys(alpha.filter("alpha > 0").select(*attrs, "alpha"), q, list(attrs), "left")
        parts.append(j.select(F.lit(i).alias("block"), (F.abs(F.coalesce("__q", F.lit(0.0)) - F.col("alpha")) / F.col("alpha")).alias("rel_error")))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def fit_diagnostics(fitted: DataFrame, p: str, blocks: Sequence[tuple[Sequence[str], DataFrame]], forbidden: Column) -> DataFrame:
    """Mean relative error, mass on forbidden cells, entropy in nats and support."""
    P_ = F.col(p)
    g = fitted.agg(F.sum(F.when(forbidden, P_).otherwise(0.0)).alias("forbidden_mass"), F.sum(F.when(P_ > 0, -P_ * F.log(P_)).otherwise(0.0)).alias("entropy"),
                   F.sum((P_ > 1e-12).cast("bigint")).alias("support"), F.count("*").alias("states"))
    return g.withColumn("mre", block_error(fitted, p, blocks).agg(F.avg("rel_error")).scalar())


def divergence(a: DataFrame, b: DataFrame, keys: Sequence[str], p: str) -> DataFrame:
    """Kullback-Leibler divergence both ways over the shared support."""
    j = a.select(*keys, F.col(p).alias("__a")).join(b.select(*keys, F.col(p).alias("__b")), list(keys)).filter("__a > 0 and __b > 0")
    return j.agg(F.sum(F.col("__a") * F.log(F.col("__a") / F.col("__b"))).alias("kl_ab"), F.sum(F.col("__b") * F.log(F.col("__b") / F.col("__a"))).alias("kl_ba"))


def national_mix(units: DataFrame, unit: str, weight: str, shares: DataFrame, item: str) -> DataFrame:
    """No local source: every unit gets the national mix in proportion to its weight.

    ``shares`` is a dictionary-sized table; it rides along as one array.
    """
    packed = shares.agg(F.collect_list(F.struct(item, "share")).alias("g"))
    return (units.withColumn("g", F.explode(packed.scalar())).select(unit, F.col(f"g.{item}").alias(item), (F.col(weight) * F.col("g.share")).alias("n")))
