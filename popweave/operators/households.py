"""Households: repertoire, census size constraints, signatures, assembly, coherence."""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from popweave.functions import fixed_values as V
from popweave.functions.draws import draw
from popweave.operators.aggregates import beside, with_totals
from popweave.operators.allocation import weighted_draw
from popweave.operators.windows import consecutive_gaps
from popweave.plans.ranking import join_keys, quantiles, rank_by_draw, running_total, sizes_of_slices, slices_by_draw
from popweave.session import cut_lineage, salt_count


def signature_of(counts: dict[str, Column]) -> Column:
    """``RPFF`` from role counts: one letter a member, so its length is the size of the household."""
    return F.concat(*[F.repeat(F.lit(r), n.cast("int")) for r, n in counts.items()])


def household_signatures(members: DataFrame, hh: Sequence[str], role: str, weight: str) -> DataFrame:
    """One row per household: size, signature, weight of the household and number of references."""
    n = lambda r: F.sum(F.when(F.col(role) == r, 1).otherwise(0))
    g = members.groupBy(*hh).agg(F.count("*").alias("size"), F.max(weight).alias("weight"), *[n(r).alias(f"__{r}") for r in V.ROLE_ORDER])
    sig = signature_of({r: F.col(f"__{r}") for r in V.ROLE_ORDER})
    return g.select(*hh, "size", "weight", sig.alias("signature"), F.col("__R").alias("references"))


def repertoire(households: DataFrame) -> DataFrame:
    """Weighted share of every signature within its size, households with exactly one reference."""
    ok = households.filter("references = 1").groupBy("size", "signature").agg(F.sum("weight").alias("w"), F.count("*").alias("households"))
    return with_totals(ok, ["size"], {"__t": F.sum("w")}).select("size", "signature", "households", (F.col("w") / F.col("__t")).alias("share"))


def male_reference(members: DataFrame, households: DataFrame, hh: Sequence[str], role: str, male: Column, weight: str, least: int = 20) -> DataFrame:
    """P(the reference is male | signature) where at least ``least`` households were seen."""
    r = members.filter(F.col(role) == "R").join(households.select(*hh, "signature"), list(hh))
    return (r.groupBy("signature").agg(F.count("*").alias("n"), (F.sum(F.when(male, F.col(weight)).otherwise(0)) / F.sum(weight)).alias("p_male"))
            .filter(F.col("n") >= least))


def generation_gaps(members: DataFrame, hh: Sequence[str], role: str, age: str, weight: str, qs: dict[str, float]) -> DataFrame:
    """Weighted quantiles of reference age minus child age."""
    ref = members.filter(F.col(role) == "R").groupBy(*hh).agg(F.max(age).alias("__ra"))
    g = members.filter(F.col(role) == "F").join(ref, list(hh)).select((F.col("__ra") - F.col(age)).alias("gap"), weight)
    return quantiles(g, [], "gap", qs, F.col(weight), "first")


def sibling_gaps(members: DataFrame, hh: Sequence[str], role: str, age: str, pid: str, weight: str, qs: dict[str, float]) -> DataFrame:
    g = consecutive_gaps(members.filter(F.col(role) == "F"), hh, age, pid)
    return quantiles(g, [], "gap", qs, F.col(weight), "first")


def mixed_homogeneity(members: DataFrame, hh: Sequence[str], citizenship: str, native: str, foreign: str) -> DataFrame:
    """Share of households with a foreigner whose known members all have one citizenship."""
    k = members.filter(F.col(citizenship).isin(native, foreign)).groupBy(*hh).agg(
        F.count("*").alias("n"), F.min(citizenship).alias("lo"), F.max(citizenship).alias("hi"), F.bool_or(F.col(citizenship) == foreign).alias("f"))
    m = k.filter(F.col("f") & (F.col("n") > 1))
    return m.agg(F.count("*").alias("households"), F.avg((F.col("lo") == F.col("hi")).cast("double")).alias("homogeneous"))


def size_tail(persons: DataFrame, size: str, above: int = V.LARGEST_CENSUS_SIZE) -> DataFrame:
    """Households per size from persons (n / size), normalised over the sizes above the census classes."""
    g = persons.filter(F.col(size) > above).groupBy(size).agg((F.count("*") / F.col(size)).alias("households"))
    return with_totals(g, [], {"__t": F.sum("households")}).select(size, "households", (F.col("households") / F.col("__t")).alias("share"))


def repertoire_validity(rep: DataFrame, tail: DataFrame, tol: float = 0.005) -> DataFrame:
    """One row per check of the repertoire and its tail."""
    s = rep.groupBy("size").agg(F.sum("share").alias("t"), F.bool_and(F.col("share").isNotNull() & ~F.isnan("share") & (F.col("share") >= 0)).alias("ok"))
    a = s.agg(F.bool_and(F.abs(F.col("t") - 1) <= tol).alias("sums_to_one"), F.bool_and("ok").alias("non_negative"))
    b = tail.agg(F.bool_and(F.col("size") > V.LARGEST_CENSUS_SIZE).alias("tail_above_census"), (F.abs(F.sum("share") - 1) <= tol).alias("tail_sums_to_one"))
    return beside(a, b)


def size_constraints(sections: DataFrame, sizes: Sequence[str], persons: str) -> DataFrame:
    """Households per size that the persons of a section can fill, with the case it falls in.

    Over-estimate: the largest households give up one place at a time, which ends at a common level L with the
    remainder at L + 1, so it is computed in closed form. Truncation: ``widen`` places go to the open class.
    Beyond six per open household the rest lives in institutions.
    """
    n = [F.col(c) for c in sizes]
    k = len(sizes)
    asked = reduce(lambda a, b: a + b, [(i + 1) * x for i, x in enumerate(n)])
    residual = F.col(persons) - asked
    level_sum = lambda L: reduce(lambda a, b: a + b, [F.lit(min(i + 1, L)) * x for i, x in enumerate(n)])
    d = sections.withColumn("residual", residual)
    level = F.lit(1)
    for L in range(2, k + 1):
        level = F.when(level_sum(L) <= F.col(persons), L).otherwise(level)
    d = d.withColumn("__L", F.when(F.col("residual") >= 0, F.lit(k)).otherwise(level))
    above = lambda L: reduce(lambda a, b: a + b, [n[i] for i in range(k) if i + 1 > L], F.lit(0))
    extra = cut = None
    for L in range(1, k + 1):
        c = F.col("__L") == L
        e = F.least(F.greatest(F.col(persons) - level_sum(L), F.lit(0)), above(L)) if L < k else F.lit(0)
        extra = F.when(c, e) if extra is None else extra.when(c, e)
        cut = F.when(c, above(L)) if cut is None else cut.when(c, above(L))
    d = d.withColumn("__x", extra).withColumn("__above", cut)
    out = []
    for s in range(1, k + 1):
        own = n[s - 1]
        v = (F.when(F.col("__L") > s, own)
             .when(F.col("__L") == s, own + F.col("__above") - F.col("__x"))
             .when(F.col("__L") == s - 1, F.col("__x")).otherwise(F.lit(0)))
        out.append(v.cast("bigint").alias(f"k{s}"))
    room = F.lit(k) * n[-1]
    case = (F.when(F.col("residual") == 0, "exact").when(F.col("residual") < 0, "overestimate")
            .when(F.col("residual") <= room, "truncation").otherwise("institution"))
    return d.select(*sections.columns, "residual", case.alias("case"), F.greatest(F.least(F.col("residual"), room), F.lit(0)).alias("widen"),
                    F.greatest(F.col("residual") - room, F.lit(0)).alias("institution"), *out)


def open_households(constraints: DataFrame, section: str, households: str, tail: DataFrame, largest: int = V.LARGEST_CENSUS_SIZE) -> DataFrame:
    """Open-class households widened from the tail until the ``widen`` places of the section are used up."""
    h = constraints.filter((F.col(households) > 0) & (F.col("widen") > 0)).select(section, "widen", F.explode(F.sequence(F.lit(1), F.col(households).cast("int"))).alias("no"))
    h = h.withColumn("__id", F.concat_ws("|", F.col(section).cast("string"), F.col("no").cast("string")))
    d = weighted_draw(h, tail, [], "size", "__id", "tail", "share")
    d = d.withColumn("__add", (F.col("size") - largest).cast("bigint")).withColumn("__u", draw("tail-order", "__id"))
    before = running_total(d, [section], [F.col("__u"), F.col("no")], F.floor(F.col("__u") * salt_count(d.sparkSession)).cast("int"), F.col("__add"), "__b", inclusive=False)
    add = F.greatest(F.least(F.col("__add"), F.col("widen") - F.col("__b")), F.lit(0))
    return before.select(section, "no", (F.lit(largest) + add).alias("size"))


def draw_signature(households: DataFrame, rep: DataFrame, size: str, key: str) -> DataFrame:
    """Signature by size; a size the repertoire lacks takes the largest smaller one, padded with F or cut."""
    known = rep.select(F.col("size").alias("__k")).distinct()
    sizes = households.select(F.col(size).alias("__s")).distinct()
    near = sizes.withColumn("__x", F.explode(F.sequence(F.lit(1), F.col("__s").cast("int")))).join(known, F.col("__x") == F.col("__k")).groupBy("__s").agg(F.max("__k").alias("__use"))
    h = households.join(near, F.col(size) == F.col("__s"), "left").drop("__s")
    got = weighted_draw(h, rep.withColumnRenamed("size", "__use"), ["__use"], "signature", key, "signature", "share", how="left")
    s = F.coalesce(F.col("signature"), F.lit("R"))
    return got.withColumn("signature", F.substring(F.rpad(s, F.greatest(F.length(s), F.col(size).cast("int")), F.lit("F")), F.lit(1), F.col(size).cast("int"))).drop("__use")


# ------------------------------------------------------------------ assembly

def _match(slots: DataFrame, people: DataFrame, keys: Sequence[str], accept: Column, channel: str) -> DataFrame:
    """Pair the i-th slot with the i-th person of every key group (both in hash order), keep accepted pairs.

    Only rows whose slice begins within the other side's number of rows are ranked; the others have no partner.
    """
    s, p = slots.withColumn("__u", draw(channel + "-s", "slot")), people.withColumn("__u", draw(channel + "-p", "uid"))
    in_s, in_p = (cut_lineage(slices_by_draw(d, keys, "__u")) for d in (s, p))
    s = rank_by_draw(s, keys, "__u", ["slot"], "__rk", in_s, sizes_of_slices(in_p, keys)).drop("__u")
    p = rank_by_draw(p, keys, "__u", ["uid"], "__rk", in_p, sizes_of_slices(in_s, keys)).drop("__u")
    j = s.join(p.select(*keys, "__rk", "uid", "age", "male", "status"), [*keys, "__rk"])
    return j.filter(accept).select("slot", "hh", "role", "uid", "age", "male", "status")


def _match_below(slots: DataFrame, people: DataFrame, section: str, limit: Column, value: Column, channel: str) -> DataFrame:
    """As many pairs as can be: a slot takes a person of its section whose ``value`` (a whole number) is at most ``limit``.

    What a slot accepts, every slot with a higher limit accepts too. So with S(v) slots of a limit up to v and C(v)
    persons up to v, M(v) = S(v) + min(0, min over u <= v of C(u) - S(u)) slots up to v can be filled, by the M(v)
    persons that come first. The window runs over counts by (section, value); slots and persons meet by rank.
    """
    s = slots.withColumn("__at", limit.cast("bigint")).withColumn("__draw", draw(channel + "-s", "slot"))
    p = people.withColumn("__at", value.cast("bigint")).withColumn("__draw", draw(channel + "-p", "uid"))
    count = lambda d, ns, np: d.groupBy(section, "__at").agg(F.count("*").alias("n")).select(section, "__at", (F.col("n") * ns).alias("s"), (F.col("n") * np).alias("p"))
    cells = count(s, 1, 0).unionByName(count(p, 0, 1)).groupBy(section, "__at").agg(F.sum("s").alias("s"), F.sum("p").alias("p"))
    upto = W.partitionBy(section).orderBy("__at")
    run = upto.rowsBetween(W.unboundedPreceding, W.currentRow)
    cells = cells.withColumn("S", F.sum("s").over(run)).withColumn("C", F.sum("p").over(run))
    cells = cells.withColumn("M", F.col("S") + F.least(F.lit(0), F.min(F.col("C") - F.col("S")).over(run)))
    cells = cut_lineage(cells.withColumn("m0", F.lag("M", 1, 0).over(upto)).select(section, "__at", "m0", (F.col("M") - F.col("m0")).alias("k"), (F.col("C") - F.col("p")).alias("c0")))
    s = rank_by_draw(s, [section, "__at"], "__draw", ["slot"], "__nth").join(cells, [section, "__at"]).filter("__nth <= k").withColumn("__rk", F.col("m0") + F.col("__nth"))
    p = rank_by_draw(p, [section, "__at"], "__draw", ["uid"], "__nth").join(cells, [section, "__at"]).withColumn("__rk", F.col("c0") + F.col("__nth"))
    return s.join(p.select(section, "__rk", "uid", "age", "male", "status"), [section, "__rk"]).select("slot", "hh", "role", "uid", "age", "male", "status")


def assemble(persons: DataFrame, households: DataFrame, section: str, gen: tuple[int, int] = (V.PARENT_MIN_GAP, V.PARENT_MAX_GAP),
             partner_gap: int = V.PARTNER_MAX_GAP, widowed: str = V.WIDOWED, married: str = V.MARRIED, same_sex: float = V.SAME_SEX_UNIONS, band: int = 5) -> DataFrame:
    """Persons into household slots by rounds of rank matching: (uid, hh, role, tier).

    ``persons(section, uid, age, male, status)``, ``households(section, hh, signature)``. In a round, slots and
    free persons of the same (section, pool) are ranked by hash and paired by rank; pairs out of tolerance wait
    for a looser round (tier). Order R, F, P, G, then the rest. The last round of every role fills as many slots as
    can be, so a slot stays open only when nobody left in the section fits it. Sections are only a shuffle key, and a
    big one is cut into slices by the ranks.

    The reference of a couple is wanted male, any other wanted female, with probability ``p_male`` (a column of
    ``households`` when present); else either sex will do. A share ``same_sex`` of the married references looks for
    a married partner of its own sex first.
    """
    couple = F.contains(F.col("signature"), F.lit("P"))
    wish = F.col("p_male") if "p_male" in households.columns else F.when(couple, V.MALE_REFERENCE_COUPLE).otherwise(V.MALE_REFERENCE_OTHER)
    wanted = F.when(draw("ref-sex", "hh") < wish, couple).otherwise(draw("ref-any", "hh") < 0.5)
    slots = (households.withColumn("n", F.length("signature")).withColumn("pos", F.explode(F.sequence(F.lit(1), F.col("n"))))
             .select(section, "hh", F.substring(F.col("signature"), F.col("pos"), F.lit(1)).alias("role"),
                     F.concat_ws("#", "hh", "pos").alias("slot"), F.contains(F.col("signature"), F.lit("F")).alias("kids"),
                     couple.alias("couple"), wanted.cast("int").alias("sx")))
    slots, everyone = cut_lineage(slots), cut_lineage(persons.select(section, "uid", "age", "male", "status"))
    placed: list[DataFrame] = []

    def keep(got, open_slots, tier, last=False):
        """Write the pairs, and once each for the rounds to come the persons and (but after a role's last round) the slots that they leave."""
        nonlocal everyone
        got = cut_lineage(got.withColumn("tier", F.lit(tier)))
        placed.append(got)
        everyone = cut_lineage(everyone.join(got.select("uid"), "uid", "left_anti"))
        return None if last else cut_lineage(open_slots.join(got.select("slot"), "slot", "left_anti"))

    def take(open_slots, tier, keys, s_cols, p_cols, accept, channel, pool=F.lit(True), last=False):
        s, p = open_slots, everyone.filter(pool)
        for n, c in s_cols.items():
            s = s.withColumn(n, c)
        for n, c in p_cols.items():
            p = p.withColumn(n, c)
        return keep(_match(s, p, [section, *keys], accept, channel), open_slots, tier, last)

    yes = F.lit(True)
    adult = F.col("age") >= 18
    r = slots.filter("role = 'R'")
    # references: parents of children from the plausible ages, couples without the widowed, singles from the widowed first
    pool = {"c": (F.col("status") != widowed).cast("int"), "sx": F.col("male").cast("int")}
    kind = {"c": F.col("couple").cast("int")}
    rest = take(r.filter("kids"), 0, ["c", "sx"], kind, pool, yes, "R0", F.col("age").between(25, 60))
    rest = rest.unionByName(r.filter("not kids"))
    rest = take(rest, 0, ["c", "sx"], kind, pool, yes, "R1", adult)
    rest = take(rest, 1, [], {}, {}, yes, "R3", adult)
    take(rest, 2, [], {}, {}, yes, "R4", last=True)
    ref = cut_lineage(reduce(lambda a, b: a.unionByName(b), placed).select("hh", F.col("age").alias("ra"), F.col("male").alias("rm"), F.col("status").alias("rs")))
    withref = lambda role: slots.filter(F.col("role") == role).join(ref, "hh")
    gap = F.col("ra") - F.col("age")

    kids = withref("F")
    for tier, width in ((0, band), (0, 2 * band), (1, 4 * band)):
        aim = F.col("ra") - (F.lit(gen[0]) + F.floor(draw(f"kid{tier}{width}", "slot") * (gen[1] - gen[0] + 1)))
        kids = take(kids, tier, ["b"], {"b": F.floor(aim / width)}, {"b": F.floor(F.col("age") / width)}, gap.between(*gen) if tier == 0 else gap >= 15, f"F{width}")
    keep(_match_below(kids, everyone, section, F.col("ra") - 15, F.col("age"), "F9"), kids, 2, True)

    mates = withref("P")
    opposite = {"m": (~F.col("rm")).cast("int")}
    own = (F.col("rs") == married) & (draw("same-sex", "hh") < same_sex)
    mates = take(mates.filter(own), 0, ["m"], {"m": F.col("rm").cast("int")}, {"m": F.col("male").cast("int")}, yes, "PS", adult & (F.col("status") == married)).unionByName(mates.filter(~own))
    who = {"m": F.col("male").cast("int")}
    ok = F.abs(gap) <= partner_gap
    for shift in (0, 1):
        off = shift * band // 2
        mates = take(mates, 0, ["m", "st", "b"], {**opposite, "st": F.col("rs"), "b": F.floor((F.col("ra") + off) / (2 * band))},
                     {**who, "st": F.col("status"), "b": F.floor((F.col("age") + off) / (2 * band))}, ok, f"P{shift}", (F.col("status") != widowed) & adult)
    mates = take(mates, 1, ["m", "b"], {**opposite, "b": F.floor(F.col("ra") / (2 * band))}, {**who, "b": F.floor(F.col("age") / (2 * band))}, ok, "P5", (F.col("status") != widowed) & adult)
    take(mates, 2, ["m"], opposite, who, yes, "P9", (F.col("status") != widowed) & adult, True)

    olds = take(withref("G"), 0, ["b"], {"b": F.floor((F.col("ra") + 28) / (4 * band))}, {"b": F.floor(F.col("age") / (4 * band))}, (-gap).between(*gen), "G0")
    keep(_match_below(olds, everyone, section, -F.col("ra") - 1, -F.col("age"), "G1"), olds, 1, True)
    take(slots.filter("role in ('A', 'N')"), 0, [], {}, {}, yes, "A0", last=True)
    return reduce(lambda a, b: a.unionByName(b), placed).select("uid", "hh", "role", "tier", "age", "male", "status")


def open_slots(placed: DataFrame, persons: DataFrame, households: DataFrame, section: str) -> DataFrame:
    """Per role: slots, filled slots, and open ones for which a free person of the section would do even by the loosest test."""
    slots = households.select(section, "hh", F.explode(F.split("signature", "")).alias("role")).filter("role <> ''").groupBy(section, "hh", "role").agg(F.count("*").alias("slots"))
    got = placed.groupBy("hh", "role").agg(F.count("*").alias("filled"))
    ref = placed.filter("role = 'R'").groupBy("hh").agg(F.max("age").alias("ra"), F.bool_or("male").alias("rm"))
    fits = (F.col("age") >= 18) & (F.col("status") != V.WIDOWED)
    free = persons.join(placed.select("uid"), "uid", "left_anti").groupBy(section).agg(
        F.min("age").alias("youngest"), F.max("age").alias("oldest"), F.bool_or(fits & F.col("male")).alias("men"), F.bool_or(fits & ~F.col("male")).alias("women"))
    d = slots.join(got, ["hh", "role"], "left").join(ref, "hh", "left").join(free, section, "left").withColumn("filled", F.coalesce("filled", F.lit(0).cast("bigint")))
    would = (F.when(F.col("role") == "F", F.col("youngest") <= F.col("ra") - 15).when(F.col("role") == "G", F.col("oldest") > F.col("ra"))
             .when(F.col("role") == "P", F.when(F.col("rm"), F.col("women")).otherwise(F.col("men"))).otherwise(F.col("youngest").isNotNull()))
    open_ = F.when(F.coalesce(would, F.lit(False)), F.col("slots") - F.col("filled")).otherwise(0)
    return d.groupBy("role").agg(F.sum("slots").alias("slots"), F.sum("filled").alias("filled"), F.sum(open_).cast("bigint").alias("fillable"))


def assembly_summary(placed: DataFrame, persons: DataFrame, households: DataFrame) -> DataFrame:
    """Households, share assembled without a loose tier and in full, unplaced share, gap percentiles."""
    size = households.select("hh", F.length("signature").alias("n"))
    h = size.join(placed.groupBy("hh").agg(F.count("*").alias("got"), F.max("tier").alias("tier")), "hh", "left")
    ref = placed.filter("role = 'R'").select("hh", F.col("age").alias("ra"))
    gaps = placed.filter("role = 'F'").join(ref, "hh").select((F.col("ra") - F.col("age")).alias("gap"))
    q = quantiles(gaps, [], "gap", {"g05": 0.05, "g50": 0.5, "g95": 0.95})
    s = h.agg(F.count("*").alias("households"), F.avg(((F.coalesce(F.col("got"), F.lit(0)) == F.col("n")) & (F.col("tier") == 0)).cast("double")).alias("perfect"),
              F.avg("n").alias("mean_size"))
    total, in_ = persons.agg(F.count("*")).scalar(), placed.agg(F.count("*")).scalar()
    return s.select("households", F.coalesce("perfect", F.lit(0.0)).alias("perfect"), "mean_size", (1 - in_ / total).alias("unplaced")).transform(lambda x: beside(x, q))


# ------------------------------------------------------------------ audits

def couple_coherence(members: DataFrame, hh: str, role: str, status: str, married: str) -> DataFrame:
    """Married persons by role: coherent when alone, or when both partners are married."""
    m = F.col(status) == married
    g = members.groupBy(hh).agg(F.count("*").alias("__n"), F.bool_or((F.col(role) == "R") & m).alias("__rm"), F.bool_or((F.col(role) == "P") & m).alias("__pm"))
    j = members.filter(m).join(g, hh)
    ok = (F.col("__n") == 1) | (F.col(role).isin("R", "P") & F.col("__rm") & F.col("__pm"))
    return j.groupBy(role).agg(F.count("*").alias("married"), F.sum((~ok).cast("bigint")).alias("incoherent"))


def homogeneous_couples(members: DataFrame, hh: str, role: str, status: str) -> DataFrame:
    v = lambda r: F.max(F.when(F.col(role) == r, F.col(status)))
    c = members.groupBy(hh).agg(v("R").alias("r"), v("P").alias("p")).filter("r is not null and p is not null")
    return c.agg(F.count("*").alias("couples"), F.avg((F.col("r") == F.col("p")).cast("double")).alias("homogeneous"))


def size_distribution(members: DataFrame, naive: str, wave: str, weight: str, census: DataFrame, top: int = V.LARGEST_CENSUS_SIZE) -> DataFrame:
    """Household sizes, raw and weighted, against the census; the id alone repeats across waves."""
    h = members.groupBy(wave, naive).agg(F.count("*").alias("n"), F.max(weight).alias("w"))
    s = h.groupBy(F.least("n", F.lit(top)).alias("size")).agg(F.count("*").alias("raw"), F.sum("w").alias("weighted"))
    s = with_totals(s, [], {"__r": F.sum("raw"), "__w": F.sum("weighted")})
    c = with_totals(census, [], {"__c": F.sum("households")})
    j = s.join(c, "size", "full_outer")
    z = lambda x, t: F.coalesce(F.col(x) / F.col(t), F.lit(0.0))
    return j.select("size", z("raw", "__r").alias("raw"), z("weighted", "__w").alias("weighted"), z("households", "__c").alias("census"))


def repeated_ids(members: DataFrame, naive: str, wave: str) -> DataFrame:
    return members.agg(F.countDistinct(naive).alias("naive"), F.countDistinct(F.struct(wave, naive)).alias("composite"))


def role_profile(members: DataFrame, role: str, klass: str, foreign: Column, weight: str) -> DataFrame:
    """Per role: weighted median class, foreign share and mass share."""
    g = members.groupBy(role).agg(F.sum(weight).alias("__w"), F.sum(F.when(foreign, F.col(weight)).otherwise(0)).alias("__f"))
    g = with_totals(g, [], {"__t": F.sum("__w")})
    q = quantiles(members, [role], klass, {"median_class": 0.5}, F.col(weight), "first")
    return g.join(q, role).select(role, "median_class", (F.col("__f") / F.col("__w")).alias("foreign_share"), (F.col("__w") / F.col("__t")).alias("mass_share"))


def parents_and_siblings(members: DataFrame, hh: str, pid: str, role: str, age: str, level: str) -> DataFrame:
    """For every child: number of siblings, parents, best parent level and age gap to the eldest parent; for a
    reference with a parent in the house, the parents are the G members. One aggregate per household."""
    s = members.groupBy(hh).agg(
        F.sum((F.col(role) == "F").cast("bigint")).alias("__kids"),
        F.sum(F.col(role).isin("R", "P").cast("bigint")).alias("__np"), F.max(F.when(F.col(role).isin("R", "P"), F.col(level))).alias("__lp"), F.max(F.when(F.col(role).isin("R", "P"), F.col(age))).alias("__ap"),
        F.sum((F.col(role) == "G").cast("bigint")).alias("__ng"), F.max(F.when(F.col(role) == "G", F.col(level))).alias("__lg"), F.max(F.when(F.col(role) == "G", F.col(age))).alias("__ag"))
    j = members.filter(F.col(role).isin("F", "R")).join(s, hh)
    kid = F.col(role) == "F"
    return j.select(hh, pid, role, F.when(kid, F.col("__kids") - 1).otherwise(0).alias("siblings"), F.when(kid, F.col("__np")).otherwise(F.col("__ng")).alias("parents"),
                    F.when(kid, F.col("__lp")).otherwise(F.col("__lg")).alias("parent_level"), (F.when(kid, F.col("__ap")).otherwise(F.col("__ag")) - F.col(age)).alias("age_gap"))


def fractional_households(persons: DataFrame, section: str, size: str) -> DataFrame:
    """Sum of 1/size per section; whole households give a whole number."""
    g = persons.groupBy(section).agg(F.sum(F.lit(1.0) / F.col(size)).alias("households"))
    return g.withColumn("off", F.abs(F.col("households") - F.round("households")))


def role_confusion(df: DataFrame, truth: str, assigned: str) -> DataFrame:
    """Counts of (true, assigned) with the overall agreement share."""
    g = df.groupBy(truth, assigned).agg(F.count("*").alias("n"))
    return with_totals(g, [], {"agreement": F.sum(F.when(F.col(truth) == F.col(assigned), F.col("n")).otherwise(0)) / F.sum("n")})
