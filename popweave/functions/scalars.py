"""Scalar helpers as Column expressions: codes, labels, answers, short texts."""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from popweave.functions import fixed_values as V

OPEN_END = 199


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def age_bounds(code) -> Column:
    """``Y7`` -> (7,7), ``Y9-24`` -> (9,24), ``Y_GE65`` -> (65,199), else null."""
    c = _c(code)
    num = lambda p, g=1: F.regexp_extract(c, p, g).try_cast("int")
    single, span, top = r"^Y(\d+)$", r"^Y(\d+)-(\d+)$", r"^Y_GE(\d+)$"
    lo = F.coalesce(num(single), num(span), num(top))
    hi = F.coalesce(num(single), num(span, 2), F.when(num(top).isNotNull(), F.lit(OPEN_END)))
    return F.when(lo.isNotNull(), F.struct(lo.alias("lo"), hi.alias("hi")))


def band_bounds(label: str) -> tuple[int, int]:
    """``0-8`` -> (0,8), ``75+`` -> (75,199)."""
    return (int(label[:-1]), OPEN_END) if label.endswith("+") else tuple(int(x) for x in label.split("-"))


def band_of(value, labels: Sequence[str] = V.AGE_BANDS, low: int = 0, high: int = OPEN_END) -> Column:
    """Label of the first band that holds the value, bands clipped to [low, high]."""
    v, out = _c(value), None
    for lab in labels:
        a, b = band_bounds(lab)
        a, b = max(a, low), min(b, high)
        if a <= b:
            cond = v.between(a, b)
            out = F.when(cond, lab) if out is None else out.when(cond, lab)
    return out


def five_year(value) -> Column:
    """Five-year class code, open from 75."""
    lo = F.least(F.floor(_c(value) / 5) * 5, F.lit(75))
    return F.when(lo == 75, "Y_GE75").otherwise(F.concat(F.lit("Y"), lo, F.lit("-"), lo + 4))


def macro_age(value) -> Column:
    v = _c(value)
    return F.when(v <= 14, "Y0-14").when(v <= 64, "Y15-64").otherwise("Y_GE65")


def survey_age_class(value, upper: Sequence[int] = V.SURVEY_AGE_UPPER) -> Column:
    """1-based class number: how many upper bounds lie below the value, plus one."""
    v = _c(value)
    return reduce(lambda a, b: a + b, [(v > u).cast("int") for u in upper]) + 1


def contains_ladder(label, ladder, total: str | None = None) -> Column:
    """First rung whose words occur in the lower-cased label; unknown labels become ``?label``."""
    raw = _c(label)
    s = F.lower(raw)
    any_of = lambda words: reduce(lambda a, b: a | b, [s.contains(w) for w in words])
    out = F.when(s.contains(total), F.lit(None).cast("string")) if total else None
    for words, res in ladder:
        out = F.when(any_of(words), res) if out is None else out.when(any_of(words), res)
    return out.otherwise(F.concat(F.lit("?"), raw))


def mapped(value, table: dict, default: Column | None = None) -> Column:
    """Constant lookup; null (or ``default``) when the key is missing."""
    items = [F.lit(x) for kv in table.items() for x in kv]
    got = F.try_element_at(F.create_map(*items), _c(value))
    return got if default is None else F.coalesce(got, default)


def zone_code(value, prefix: str) -> Column:
    """Strip ``.0``, the municipality prefix and leading zeros; empty becomes 0."""
    s = F.regexp_replace(F.trim(_c(value).cast("string")), r"\.0$", "")
    s = F.regexp_replace(s, f"^{prefix}(?=.)", "")
    s = F.regexp_replace(s, "^0+", "")
    return F.when(s == "", "0").otherwise(s)


def six_digits(value) -> Column:
    return F.lpad(_c(value).try_cast("bigint").cast("string"), 6, "0")


def province(code) -> Column:
    return F.substring(_c(code), 1, 3)


def plain_name(value) -> Column:
    """Base letters and digits only, lower case."""
    s = F.lower(F.translate(_c(value), V.ACCENTED, V.BASE))
    return F.regexp_replace(s, "[^a-z0-9]", "")


def coordinate(value) -> Column:
    """Text with blanks and a decimal comma to a number."""
    s = F.regexp_replace(_c(value), r"[\s\x{00a0}]", "")
    return F.regexp_replace(s, ",", ".").try_cast("double")


def first_rule(rules: Sequence[tuple[Column, str]], default: str | None = None) -> Column:
    """Result of the first rule whose condition holds."""
    out = None
    for cond, res in rules:
        out = F.when(cond, res) if out is None else out.when(cond, res)
    return out if default is None else out.otherwise(default)


def three_digit_groups(code) -> Column:
    """Digit groups of a code padded to six, or to nine when longer than six."""
    c = _c(code).cast("string")
    p = F.when(F.length(c) <= 6, F.lpad(c, 6, "0")).otherwise(F.lpad(c, 9, "0"))
    return F.transform(F.sequence(F.lit(1), F.length(p), F.lit(3)), lambda i: F.substring(p, i, F.lit(3)))


def conditions_hold(attributes: dict[str, Sequence[str]]) -> Column:
    """All ``column in values`` tests of one routing rule."""
    tests = [F.col(k).isin(list(v)) for k, v in attributes.items()]
    return reduce(lambda a, b: a & b, tests) if tests else F.lit(True)


def routed(rules: Sequence[tuple[dict, str]]) -> tuple[Column, Column]:
    """(target, reason) of the first routing rule that holds; an empty rule is the default."""
    target = first_rule([(conditions_hold(c), use) for c, use in rules])
    reason = None
    for cond, _ in rules:
        text = F.concat_ws(", ", *[F.concat(F.lit(f"{k}="), F.col(k)) for k in cond]) if cond else F.lit("default")
        test = conditions_hold(cond)
        reason = F.when(test, text) if reason is None else reason.when(test, text)
    return target, reason


def readable_title(title, abbreviations: dict[str, str], prefixes: Sequence[str], groups: dict[str, str],
                   exceptions: dict[str, str]) -> Column:
    """Squeeze blanks, expand each abbreviation once, cut the first matching prefix,
    reword groups and apply whole-title exceptions. Abbreviations must be literal text."""
    t = F.trim(F.regexp_replace(_c(title), r"\s+", " "))
    for short, full in abbreviations.items():
        at = F.locate(short, F.lower(t))
        t = F.when(at > 0, F.concat(F.substring(t, F.lit(1), at - 1), F.lit(full),
                                    F.substring(t, at + len(short), F.length(t)))).otherwise(t)
    cut = None
    for p in prefixes:
        body = F.substring(t, F.lit(len(p) + 1), F.length(t))
        cond = F.lower(t).startswith(p)
        cut = F.when(cond, body) if cut is None else cut.when(cond, body)
    t = cut.otherwise(t) if cut is not None else t
    rest = F.trim(F.substring(t, F.lit(8), F.length(t)))
    t = F.when(F.lower(t).startswith("gruppo "),
               F.concat(F.lit("discipline "), mapped(F.lower(rest), groups, rest) if groups else rest)).otherwise(t)
    return F.trim(mapped(F.lower(t), exceptions, t) if exceptions else t)


def clean_answer(raw) -> Column:
    """Lower case, trimmed, punctuation removed."""
    return F.regexp_replace(F.lower(F.trim(_c(raw))), r"[^\p{L}\p{N}_\s]", "")


def rating(raw, top: int = 10) -> tuple[Column, Column]:
    """(first whole number 0..top in the text, was the text only that number)."""
    pat = {10: r"\b(10|[0-9])\b", 100: r"\b(100|[0-9]{1,2})\b"}[top]
    v = F.regexp_extract(_c(raw), pat, 1).try_cast("int")
    return v, F.coalesce(clean_answer(raw) == v.cast("string"), F.lit(False))


def choice(raw, options: Sequence[str]) -> tuple[Column, Column]:
    """(option, clean): equal, else contained, else its first word contained."""
    b = clean_answer(raw)
    opts = F.array(*[F.lit(o) for o in options])
    first = lambda test: F.get(F.filter(opts, test), F.lit(0))
    exact = first(lambda o: clean_answer(o) == b)
    inside = first(lambda o: b.contains(clean_answer(o)))
    word = first(lambda o: b.contains(F.get(F.split(clean_answer(o), r"\s+"), F.lit(0))))
    return F.coalesce(exact, inside, word), exact.isNotNull()


def toponym_core(name, generic: Sequence[str], shortest: int = 3) -> Column:
    """Upper-cased words that are neither generic nor short."""
    words = F.split(F.upper(_c(name)), r"[^\p{L}0-9]+")
    return F.array_join(F.filter(words, lambda w: (F.length(w) >= shortest) & ~w.isin(list(generic))), " ")


def sentence(*parts: Column) -> Column:
    """Join the clauses that apply; a null clause is left out."""
    return F.concat_ws(" ", *parts)


def whole_number(value) -> Column:
    """Integer-looking text (``12`` or ``12.0``) to a number, anything else null."""
    return F.regexp_extract(F.trim(_c(value).cast("string")), r"^(-?\d+)(\.0+)?$", 1).try_cast("bigint")


def title_case(value) -> Column:
    """Title-case names that are all capitals, leave the others."""
    c = _c(value)
    return F.when(c == F.upper(c), F.initcap(F.lower(c))).otherwise(c)


def cut_at_word(value, n: int) -> Column:
    """Longest run of whole words that fits in n characters; a longer text gets an ellipsis."""
    c = _c(value)
    head = F.regexp_replace(F.substring(c, 1, n), r"\s+\S*$", "")
    return F.when(F.length(c) <= n, c).otherwise(F.concat(head, F.lit("…")))


def rotated(options: Sequence[str], replica) -> Column:
    """The option list as shown in a replica: turned left by replica mod its length."""
    k = len(options)
    arr = F.array(*[F.lit(o) for o in options])
    r = F.pmod(_c(replica), F.lit(k)).cast("int")
    return F.concat(F.slice(arr, r + 1, F.lit(k)), F.slice(arr, F.lit(1), r))


def shown_position(options: Sequence[str], replica, answer) -> Column:
    """1-based place at which the answer was shown, null when it is no option."""
    return F.nullif(F.array_position(rotated(options, replica), _c(answer)), F.lit(0).cast("bigint"))


def resolve_labels(df: DataFrame, label: str, synonyms: DataFrame, reference: DataFrame,
                   not_places: Sequence[str]) -> DataFrame:
    """Normalised label -> reference code through a synonym table; null when it is no place.

    ``synonyms(name, same_as)`` and ``reference(name, code)`` hold normalised names, one row each.
    """
    key = plain_name(label)
    got = (df.withColumn("__k", F.when(~key.isin(list(not_places)), key))
           .join(synonyms.withColumnRenamed("name", "__k"), "__k", "left")
           .withColumn("__k", F.coalesce("same_as", "__k")).drop("same_as"))
    return got.join(reference.withColumnRenamed("name", "__k"), "__k", "left").drop("__k")


def dictionary(df: DataFrame, column: str) -> DataFrame:
    """(cat, ord): distinct labels with their 0-based place in sorted order.

    One row per label; meant for category columns.
    """
    from pyspark.sql import Window as W
    cats = df.select(F.col(column).alias("cat")).filter("cat is not null").distinct()
    return cats.select("cat", (F.row_number().over(W.orderBy("cat")) - 1).alias("ord"))


def encode(df: DataFrame, columns: dict[str, DataFrame]) -> DataFrame:
    """Add ``<column>_ord`` from each dictionary; labels outside it become null."""
    for c, d in columns.items():
        df = df.join(d.select(F.col("cat").alias(c), F.col("ord").alias(f"{c}_ord")), c, "left")
    return df


def mixed_radix(ords: Sequence[str], sizes: Sequence[int]) -> Column:
    """One code per cell from ordinals, first column slowest."""
    out = F.lit(0).cast("bigint")
    for o, n in zip(ords, sizes):
        out = out * n + F.col(o)
    return out


def translated(df: DataFrame, column: str, table: DataFrame, out: str) -> DataFrame:
    """``table(src, dst)``: population value to source value, uncovered stays null."""
    return df.join(table.select(F.col("src").alias(column), F.col("dst").alias(out)), column, "left")
