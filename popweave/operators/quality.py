"""Source registry, fingerprints, certification and data-quality gates."""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from popweave.functions import fixed_values as V
from popweave.operators.aggregates import beside, with_totals
from popweave.plans.ranking import join_keys, quantiles
from popweave.session import cut_lineage

_n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("bigint")


def notes(*pairs: tuple[Column, Column | str], sep: str = " · ") -> Column:
    """Messages whose condition holds, joined; empty when none does."""
    text = lambda m: m if isinstance(m, Column) else F.lit(m)
    return F.concat_ws(sep, *[F.when(c, text(m)) for c, m in pairs])


def problems(*pairs: tuple[Column, Column | str]) -> Column:
    text = lambda m: m if isinstance(m, Column) else F.lit(m)
    return F.array_compact(F.array(*[F.when(c, text(m)) for c, m in pairs]))


def fingerprint(table: DataFrame, keys: Sequence[str] = (), key: str = "chiave", weight: str = "peso", top: int = 5) -> DataFrame:
    """Categories, mass, max, min, weights equal to 1, deciles and the heaviest entries, per instance.

    The table is written once, and the top list keeps only the best ``top`` rows per task.
    """
    table = cut_lineage(table)
    from popweave.operators.windows import top_k
    g = table.groupBy(*keys).agg(F.count("*").alias("categories"), F.sum(weight).alias("n"), F.max(weight).alias("w_max"), F.min(weight).alias("w_min"),
                                 _n(F.col(weight) == 1).alias("hapax"))
    q = quantiles(table, keys, weight, {f"d{i}": i / 10 for i in range(1, 10)})
    best = top_k(table.withColumn("__a", F.lit(1)), list(keys) or ["__a"], [F.desc(weight), F.col(key)], top)
    head = best.groupBy(*keys).agg(F.concat_ws("|", F.transform(F.array_sort(F.collect_list(F.struct("rank", key))), lambda s: s[key])).alias("head"))
    if keys:
        return g.join(q, list(keys)).join(head, list(keys))
    return beside(beside(g, q), head)


def instance_drift(now: DataFrame, stored: DataFrame, instance: str, hash_: str, rows: str) -> DataFrame:
    """new / lost / empty / changed / same per instance against the stored fingerprint."""
    s = stored.select(instance, F.col(hash_).alias("__h"))
    j = now.join(s, instance, "full_outer")
    state = (F.when(F.col("__h").isNull(), "new").when(F.col(hash_).isNull(), "lost").when(F.col(rows) == 0, "empty")
             .when(F.col(hash_) != F.col("__h"), "changed").otherwise("same"))
    return j.select(instance, state.alias("state"))


def drift_verdict(states: DataFrame) -> DataFrame:
    """ok, NUOVE when only new instances appeared, DIVERGE when something was lost, emptied or changed."""
    c = lambda s: _n(F.col("state") == s)
    g = states.agg(c("new").alias("new"), c("lost").alias("lost"), c("changed").alias("changed"), c("empty").alias("empty"))
    bad = F.col("lost") + F.col("changed") + F.col("empty") > 0
    return g.withColumn("verdict", F.when(bad, "DIVERGE").when(F.col("new") > 0, "NUOVE").otherwise("ok"))


def declared_vs_measured(registry: DataFrame, measured: DataFrame, required: Sequence[str], tol: float = 0.5) -> DataFrame:
    """Verdict per source from required fields, hash, counts and categories, with the reasons joined."""
    j = registry.join(measured, "id", "left")
    missing = F.concat_ws(",", *[F.when(F.coalesce(F.trim(F.col(c)), F.lit("")).isin(V.PLACEHOLDERS), F.lit(c)) for c in required])
    off = lambda a, b: F.col(a).isNotNull() & (F.abs(F.col(a) - F.col(b)) > tol)
    note = notes((missing != "", F.concat(F.lit("missing: "), missing)), (F.col("n_measured").isNull(), "not measured"),
                 (F.col("sha256") != F.col("hash_measured"), "hash differs"),
                 (off("n_declared", "n_measured"), F.format_string("n %.0f declared, %.0f measured", "n_declared", "n_measured")),
                 (off("categories_declared", "categories_measured"), "categories differ"))
    return j.select("id", F.when(note == "", "ok").otherwise("DIVERGE").alias("verdict"), note.alias("note"))


def content_hash(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Order-free content hash per key: sums of the four 32-bit parts of the row hash, reduced inside each task, plus the row count.

    Each field goes into the row hash with its length before it (a null as a dash), so no two different rows read alike.
    """
    field = lambda c: F.coalesce(F.concat(F.octet_length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-"))       # noqa: E731
    row = F.md5(F.concat(*map(field, columns)))
    part = lambda i: F.sum(F.conv(F.substring(row, 8 * i + 1, 8), 16, 10).cast("bigint")).alias(f"hash_{'abcd'[i]}")       # noqa: E731
    return df.groupBy(*keys).agg(F.count("*").alias("rows"), *map(part, range(4)))


def file_hashes(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """SHA-256 and size of every file of a folder, empty files marked."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(folder)
    return f.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), (F.col("length") == 0).alias("empty"))


def compare_outputs(a: DataFrame, b: DataFrame, key: str, hash_: str) -> DataFrame:
    """same / different / missing per file of two output sets."""
    j = a.select(key, F.col(hash_).alias("__a")).join(b.select(key, F.col(hash_).alias("__b")), key, "full_outer")
    return j.select(key, F.when(F.col("__a").isNull(), "missing left").when(F.col("__b").isNull(), "missing right").when(F.col("__a") == F.col("__b"), "same").otherwise("different").alias("outcome"))


def uncovered(wanted: DataFrame, have: DataFrame, key: str) -> DataFrame:
    return wanted.join(have, key, "left_anti")


def publishable(storage: Column, licence: Column) -> tuple[Column, Column]:
    """(outcome, reason) of a raw source: kept in the repository or not, licence verified or not."""
    lic = F.trim(F.coalesce(licence, F.lit("")))
    kept = storage == "git"
    open_ = lic.isin("", "DA_VERIFICARE", "NON_NOTA")
    shut = lic.startswith("NON_REDISTRIBUIBILE")
    outcome = F.when(~kept, "solo impronta").when(open_ | shut, "BLOCCANTE").otherwise("ok")
    reason = F.when(~kept, "raw file not versioned").when(open_, "licence not verified").when(shut, "not redistributable").otherwise(F.concat(F.lit("with attribution ("), lic, F.lit(")")))
    return outcome, reason


def missing_fields(df: DataFrame, key: str, groups: dict[str, Sequence[str]]) -> DataFrame:
    """Fields left open (null or a placeholder) per group."""
    open_ = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")).isin(V.PLACEHOLDERS)
    return df.select(key, *[F.concat_ws(",", *[F.when(open_(c), F.lit(c)) for c in cols]).alias(g) for g, cols in groups.items()])


def attribution(title: Column, fields: dict[str, Column], quote: Column | None = None) -> Column:
    """Markdown block of one source; blanks in values are squeezed."""
    squeeze = lambda c: F.trim(F.regexp_replace(c.cast("string"), r"\s+", " "))
    parts = [F.concat(F.lit("## "), title), F.lit("")] + [F.concat(F.lit(f"- **{n}:** "), squeeze(c)) for n, c in fields.items()]
    if quote is not None:
        parts.append(F.when(squeeze(quote) != "", F.concat(F.lit("\n> "), squeeze(quote))))
    return F.concat_ws("\n", *parts)


def table_gate(df: DataFrame, table: str, place: str, territory: str, expected: DataFrame, rules: DataFrame, value: str, year: str, total: Column, k: float = 1.6, bias: float = 0.0) -> DataFrame:
    """C1-C5 per (table, place): the first failure is the verdict, with the measured number.

    ``place`` is what was asked for, ``territory`` the code inside the rows (leading zeros may be lost).
    ``expected(table, place, pop)`` lists what should exist; ``rules(table, exact, floor, ceiling, multiple)`` the row
    counts. C5 compares the total of the latest year with the reference population, within k / sqrt(pop).
    """
    v = F.col(value).cast("string").try_cast("double")
    bare = lambda c: F.regexp_replace(F.trim(F.col(c).cast("string")), "^0+(?=.)", "")
    per_year = df.groupBy(table, place, year).agg(F.count("*").alias("rows"), F.count(v).alias("numeric"), _n(v < 0).alias("negative"), F.sum(v).alias("sum"),
                                                  F.sum(F.when(total, v)).alias("tot"), _n(bare(territory) != bare(place)).alias("elsewhere"))
    g = per_year.groupBy(table, place).agg(*[F.sum(c).alias(c) for c in ("rows", "numeric", "negative", "sum", "elsewhere")], F.max_by("tot", year).alias("latest"))
    j = expected.join(g, [table, place], "left").join(rules, table, "left")
    rows = F.col("rows")
    dev = (F.col("latest") - F.col("pop")) / F.col("pop") - bias
    verdict = F.coalesce(
        F.when(rows.isNull(), "C1: absent or empty"),
        F.when(rows != F.col("exact"), F.format_string("C2: %d rows, not %d", rows, "exact")),
        F.when(rows % F.col("multiple") != 0, F.format_string("C2: %d rows, not a multiple of %d", rows, "multiple")),
        F.when(rows > F.col("ceiling"), F.format_string("C2: %d rows above %d", rows, "ceiling")), F.when(rows < F.col("floor"), F.format_string("C2: %d rows below %d", rows, "floor")),
        F.when(F.col("elsewhere") > 0, F.format_string("C3: %d rows of another territory", "elsewhere")),
        F.when((F.col("numeric") == 0) | (F.col("negative") > 0) | (F.coalesce("sum", F.lit(0.0)) <= 0), F.format_string("C4: %d negative", "negative")),
        F.when(F.abs(dev) > k / F.sqrt("pop"), F.lit("C5: latest total off")), F.lit("ok"))
    return j.select(table, place, verdict.alias("verdict"))


def gate_state(cells: DataFrame, unit: str, table: str, state: str, done: str) -> DataFrame:
    """Closed when every table of a unit is done; counts per state and the divergent list."""
    return cells.groupBy(unit).agg(F.bool_and(F.col(state) == done).alias("closed"), F.count("*").alias("tables"), _n(F.col(state) == done).alias("done"), _n(F.col(state) == "DIVERGE").alias("divergent"))


def candidates(population: DataFrame, unit: str, age: str, value: str, above: float, done: DataFrame, top_age: int = 100) -> DataFrame:
    """Units whose single ages 0..100 sum above the threshold and that are not done yet."""
    g = population.filter(F.col(age).between(0, top_age)).groupBy(unit).agg(F.sum(value).alias("pop")).filter(F.col("pop") > above)
    return g.join(done, unit, "left_anti")


def ladder_check(df: DataFrame, unit: str, step: str, parts: Sequence[str], total: str, steps: int) -> DataFrame:
    """Exact number of steps per unit, all distinct, and parts adding up to the total on every row."""
    row_ok = reduce(lambda a, b: a + b, [F.col(p) for p in parts]) == F.col(total)
    s = df.groupBy(unit, step).agg(F.count("*").alias("__c"), F.bool_and(row_ok).alias("__ok"))
    return s.groupBy(unit).agg(F.sum("__c").alias("rows"), F.count("*").alias("steps"), F.bool_and("__ok").alias("adds_up")).withColumn("complete", (F.col("rows") == steps) & (F.col("steps") == steps))


def preflight(observed: DataFrame, rules: DataFrame) -> DataFrame:
    """Per table: years present, required year there or not, and how hard the miss is.

    ``observed(table, year)``, ``rules(table, required, hard)``.
    """
    o = observed.select("table", "year").distinct()
    g = o.groupBy("table").agg(F.min("year").alias("first"), F.max("year").alias("last"), F.count("*").alias("years"))
    hit = rules.join(o.withColumnRenamed("year", "required"), ["table", "required"], "left_semi").select("table", F.lit(True).alias("hit"))
    j = rules.join(g, "table", "left").join(hit, "table", "left")
    return j.select("table", "first", "last", F.coalesce("years", F.lit(0)).alias("years"), F.when(F.col("hit"), "ok").when(F.col("hard"), "STOP").otherwise("warning").alias("outcome"))


def common_years(observed: DataFrame, rules: DataFrame) -> DataFrame:
    """Years every hard table has."""
    hard = rules.filter("hard").select("table")
    k = hard.agg(F.count("*")).scalar()
    return observed.select("table", "year").distinct().join(hard, "table").groupBy("year").agg(F.count("*").alias("tables")).filter(F.col("tables") == k).select("year")


def canonical(df: DataFrame) -> DataFrame:
    """Columns in name order, numbers as plain text."""
    def text(c):
        n = F.col(c).cast("string")
        return F.regexp_replace(n, r"\.0+$", "").alias(c)
    return df.select(*[text(c) for c in sorted(df.columns)])


def table_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Schema, row count and number of differing rows each way, duplicates counted; one aggregation, no sort."""
    if sorted(a.columns) != sorted(b.columns):
        only = sorted(set(a.columns) ^ set(b.columns))
        return a.limit(0).agg(F.lit(False).alias("same_schema"), F.lit(",".join(only)).alias("columns"))
    cols = sorted(a.columns)
    t = canonical(a).withColumn("__d", F.lit(1)).unionByName(canonical(b).withColumn("__d", F.lit(-1)))
    g = t.groupBy(*cols).agg(F.sum("__d").alias("d"), _n(F.col("__d") == 1).alias("ra"), _n(F.col("__d") == -1).alias("rb"))
    return g.agg(F.lit(True).alias("same_schema"), F.sum("ra").alias("rows_a"), F.sum("rb").alias("rows_b"), F.sum(F.greatest("d", F.lit(0))).alias("only_a"), F.sum(F.greatest(-F.col("d"), F.lit(0))).alias("only_b"))


def dimension_profile(df: DataFrame, dims: Sequence[str], value: str) -> DataFrame:
    """(dim, code, rows, total, codes, varies): cells first, then opened per dimension."""
    full = df.groupBy(*dims).agg(F.count("*").alias("__n"), F.sum(value).alias("__v"))
    pairs = F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("code")) for d in dims])
    g = full.select("__n", "__v", F.explode(pairs).alias("p")).select("__n", "__v", "p.*").groupBy("dim", "code").agg(F.sum("__n").alias("rows"), F.sum("__v").alias("total"))
    return with_totals(g, ["dim"], {"codes": F.count("*")}).withColumn("varies", F.col("codes") > 1)


def recover_codes(codes: DataFrame, codelist: DataFrame, code: str) -> DataFrame:
    """Codes that lost leading zeros, matched to a list entry when only one fits."""
    bare = lambda c: F.regexp_replace(F.col(c), "^0+(?=.)", "")
    one = codelist.select(bare(code).alias("__b"), F.col(code).alias("__full")).groupBy("__b").agg(F.count("*").alias("__n"), F.min("__full").alias("__full"))
    j = codes.withColumn("__b", bare(code)).join(one, "__b", "left")
    return j.select(*codes.columns, F.when(F.col("__n") == 1, F.col("__full")).alias("resolved"), F.when(F.col("__n").isNull(), "unknown").when(F.col("__n") > 1, "ambiguous").otherwise("ok").alias("status"))


def level_check(codes: DataFrame, levels: DataFrame) -> DataFrame:
    """Share of the observed codes covered by each candidate level, best first. ``codes(code)``, ``levels(level, code)``."""
    obs = cut_lineage(codes.select("code").filter("code is not null").distinct())
    n = obs.agg(F.count("*")).scalar()
    hit = levels.distinct().join(obs, "code").groupBy("level").agg(F.count("*").alias("hits"))
    g = levels.select("level").distinct().join(hit, "level", "left").select("level", (F.coalesce("hits", F.lit(0)) / n).alias("share"))
    return g.withColumn("best", F.col("level") == g.agg(F.max(F.struct("share", "level"))["level"]).scalar())


def impossible_combinations(df: DataFrame, title: str, age: str, band_top: str, rules: dict[str, int], group: str) -> DataFrame:
    """Titles held below their minimum age: at risk, impossible, certain already from the band, and the conditional rate."""
    from popweave.functions.scalars import mapped
    least = mapped(title, {k: v for k, v in rules.items()})
    d = df.withColumn("__min", least)
    bad = F.col(age) < F.col("__min")
    return d.groupBy(group).agg(F.count("*").alias("persons"), _n(F.col("__min").isNotNull()).alias("at_risk"), _n(bad).alias("impossible"), _n(F.col(band_top) < F.col("__min")).alias("certain"),
                                F.try_divide(_n(bad), _n(F.col("__min").isNotNull())).alias("rate"))


def exclusion_coverage(exclusions: DataFrame, cube: DataFrame, key: str) -> DataFrame:
    """Forbidden cells the cube holds at zero, holds with mass, or does not hold at all."""
    j = exclusions.select(key).distinct().join(cube.groupBy(key).agg(F.max("alpha").alias("__a")), key, "left")
    return j.groupBy(F.when(F.col("__a").isNull(), "not covered").when(F.col("__a") > 0, "has mass").otherwise("zero").alias("coverage")).agg(F.count("*").alias("cells"))


def log_metrics(lines: DataFrame, run: str, line: str, patterns: dict[str, str]) -> DataFrame:
    """One row per run: the largest number each pattern's first group captures anywhere in its lines."""
    most = lambda p: F.array_max(F.transform(F.regexp_extract_all(line, F.lit(p), 1), lambda x: x.try_cast("double")))
    return lines.groupBy(run).agg(*[F.max(most(p)).alias(n) for n, p in patterns.items()])


def size_bands(runs: DataFrame, size: str, bounds: Sequence[float], metric: str) -> DataFrame:
    """Median of a metric per size band."""
    band = F.lit(len(bounds))
    for i in range(len(bounds) - 1, -1, -1):
        band = F.when(F.col(size) < bounds[i], F.lit(i)).otherwise(band)
    d = runs.filter(F.col(size).isNotNull()).withColumn("band", band)
    return d.groupBy("band").agg(F.count("*").alias("runs")).join(quantiles(d, ["band"], metric, {"median": 0.5}), "band", "left")


def config_vs_data(config: DataFrame, observed: DataFrame, unit: str, code: str) -> DataFrame:
    """Codes without a name and names without a code, per unit. ``config(unit, code, name)``, ``observed(unit, code)``."""
    o = observed.select(unit, code).distinct().withColumn("__seen", F.lit(True))
    j = config.join(o, [unit, code], "full_outer")
    p = problems((F.col("__seen").isNull(), F.concat(F.lit("name without code: "), F.col(code).cast("string"))),
                 (F.col("__seen") & (F.coalesce("name", F.lit("")) == ""), F.concat(F.lit("code without name: "), F.col(code).cast("string"))))
    return j.select(unit, F.explode(p).alias("problem"))


def tag_routing(sources: DataFrame, source: str, tags: str, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sources per destination of their tags, and tags nobody maps. ``mapping(tag, destination)``."""
    t = sources.select(source, F.explode(tags).alias("tag"))
    return (t.join(mapping, "tag").select("destination", source).distinct().groupBy("destination").agg(F.count("*").alias("sources")),
            t.join(mapping, "tag", "left_anti").groupBy("tag").agg(F.countDistinct(source).alias("sources")))


def published_check(published: DataFrame, computed: DataFrame, keys: Sequence[str], absolute: float = 0.006, relative: float = 0.002) -> DataFrame:
    """Each published cell against the computed one, within the larger of two tolerances."""
    j = join_keys(published.withColumnRenamed("value", "published"), computed.withColumnRenamed("value", "computed"), list(keys), "left")
    ok = F.abs(F.col("published") - F.col("computed")) <= F.greatest(F.lit(absolute), F.abs(F.col("computed")) * relative)
    return j.select(*keys, "published", "computed", F.coalesce(ok, F.lit(False)).alias("ok"))


def metric_extremes(cells: DataFrame, metric: str, who: str, value: str) -> DataFrame:
    """Smallest and largest value of every metric and who attains it."""
    return cells.groupBy(metric).agg(F.min(F.struct(value, who)).alias("lo"), F.max(F.struct(F.col(value), F.col(who))).alias("hi")).select(
        metric, F.col(f"lo.{value}").alias("min"), F.col(f"lo.{who}").alias("min_at"), F.col(f"hi.{value}").alias("max"), F.col(f"hi.{who}").alias("max_at"))


def run_index(runs: DataFrame, run: str, knobs: str, steps: str, measures: str, wanted: Sequence[str]) -> DataFrame:
    """One row per run: knobs as sorted text, total seconds over the steps map and the wanted measures."""
    k = F.concat_ws(" ", F.array_sort(F.transform(F.map_entries(knobs), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))))
    secs = F.aggregate(F.map_values(steps), F.lit(0.0), lambda s, x: s + x)
    return runs.select(run, k.alias("knobs"), secs.alias("seconds"), *[F.try_element_at(measures, F.lit(m)).alias(m) for m in wanted])
