"""Feature recipes: encoders that are fitted once, kept as plain data and compiled to columns."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clean import is_date, is_numeric, null_count, null_flag, number, parse_date, tokens


def _lookup(c: Column, values: dict, default) -> Column:
    if not values:
        return F.lit(default)
    pairs = F.create_map(*(F.lit(x) for kv in values.items() for x in kv))
    return F.coalesce(F.element_at(pairs, c), F.lit(default))


def column_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, rows, non_null, numeric (texts that are numbers), distinct; in one pass."""
    one = [F.struct(F.lit(c).alias("column"), F.count("*").alias("rows"), F.count(F.col(c)).alias("non_null"), F.count(number(F.col(c))).alias("numeric"), F.count_distinct(F.col(c)).alias("distinct")) for c in columns]
    return df.agg(F.array(*one).alias("x")).select(F.inline("x"))


def kinds(stats: DataFrame, levels: int = 50, share: float = 0.95) -> DataFrame:
    """What a text column is: numbers in text, few levels, or many."""
    return stats.withColumn("kind", F.when(F.col("numeric") >= F.lit(share) * F.greatest("non_null", F.lit(1)), "numeric_str").when(F.col("distinct") <= levels, "lowcard").otherwise("highcard"))


def label_codes(df: DataFrame, column: str) -> dict[str, int]:
    """Level to its place in order. Only for columns of few levels."""
    levels = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).collect()]
    return {v: k for k, v in enumerate(levels)}


def label_encode(c: Column, codes: dict[str, int]) -> Column:
    """Unknown levels come after the known ones; null stays null."""
    return F.when(c.isNotNull(), _lookup(c, codes, len(codes)))


def frequencies(df: DataFrame, column: str, count_nulls: bool = False) -> DataFrame:
    """value, share among the rows that have one (or all rows)."""
    known = df.where(F.col(column).isNotNull())
    counts = known.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    total = (df if count_nulls else known).agg(F.greatest(F.count("*"), F.lit(1)).alias("total"))
    return counts.join(F.broadcast(total)).select("value", (F.col("n") / F.col("total")).alias("share"))


def frequency_encode(df: DataFrame, column: str, table: DataFrame, name: str, null_is_zero: bool = False) -> DataFrame:
    """Share of the value; unseen is 0; null is null or 0. Joined, so the table may have any size."""
    out = df.join(table.withColumnRenamed("value", "_v").withColumnRenamed("share", "_s"), F.col(column) == F.col("_v"), "left")
    share = F.coalesce("_s", F.lit(0.0))
    return out.withColumn(name, share if null_is_zero else F.when(F.col(column).isNotNull(), share)).drop("_v", "_s")


def one_hot(column: str, levels: list[str]) -> list[Column]:
    return [F.coalesce((F.trim(column) == v).cast("int"), F.lit(0)).alias(f"{column}=={v}") for v in levels]


def date_pairs(anchor: str, others: list[str], cap: int = 60) -> list[tuple[str, str]]:
    """(later, earlier): the anchor against each other date, then all pairs."""
    pairs = [(anchor, o) for o in others]
    pairs += [(b, a) for i, a in enumerate(others) for b in others[i + 1 :]]
    return pairs[:cap]


def date_gaps(pairs: list[tuple[str, str]]) -> list[Column]:
    return [F.datediff(F.col(a), F.col(b)).alias(f"days__{a}_minus_{b}") for a, b in pairs]


def calendar(column: str) -> list[Column]:
    """Monday is 1."""
    c = F.col(column)
    return [(F.weekday(c) + 1).alias("weekday"), F.dayofmonth(c).alias("day"), F.date_format(c, "yyyy-MM").alias("month")]


def multi_hot(column: str, vocabulary: list[str], delimiter: str = "|") -> list[Column]:
    """A flag per token, one for tokens beyond the vocabulary, and their number (null where the text is)."""
    own = tokens(F.col(column), delimiter)
    out = [F.array_contains(own, t).cast("int").alias(f"{column}__{t}") for t in vocabulary]
    out.append((F.size(F.array_except(own, F.array(*map(F.lit, vocabulary)))) > 0).cast("int").alias(f"{column}__other"))
    return out + [F.when(F.col(column).isNotNull(), F.size(own)).alias(f"{column}__n_tokens")]


def vocabulary(df: DataFrame, column: str, least: int = 30, most: int = 200, delimiter: str = "|") -> list[str]:
    t = df.select(F.explode(F.array_distinct(tokens(F.col(column), delimiter))).alias("t")).groupBy("t").count().where(F.col("count") >= least)
    return [r[0] for r in t.orderBy(F.desc("count"), "t").limit(most).collect()]


@dataclass
class Recipe:
    """How features are made from raw columns; JSON both ways."""

    numeric: list[str] = field(default_factory=list)
    numeric_str: list[str] = field(default_factory=list)
    lowcard: dict[str, dict[str, int]] = field(default_factory=dict)
    null_flags: list[str] = field(default_factory=list)
    counted: list[str] = field(default_factory=list)
    anchor: str | None = None
    dates: list[str] = field(default_factory=list)

    def dumps(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def loads(cls, text: str) -> "Recipe":
        return cls(**json.loads(text))

    def sources(self) -> list[str]:
        """Raw columns that the recipe reads."""
        return list(dict.fromkeys([*self.numeric, *self.numeric_str, *self.lowcard, *self.null_flags, *self.counted, *([self.anchor] if self.anchor else []), *self.dates]))

    def columns(self) -> list[Column]:
        out = [F.col(c).cast("double").alias(c) for c in self.numeric]
        out += [number(F.col(c)).alias(c) for c in self.numeric_str]
        out += [label_encode(F.col(c), codes).cast("double").alias(f"cat__{c}") for c, codes in self.lowcard.items()]
        if self.anchor:
            out += [c.cast("double") for c in date_gaps(date_pairs(self.anchor, self.dates))]
        out += [null_flag(F.col(c)).cast("double").alias(f"isnull__{c}") for c in self.null_flags]
        return out + ([null_count(*self.counted).cast("double").alias("n_null_raw")] if self.counted else [])

    def pruned(self, kept: list[str]) -> "Recipe":
        """The recipe that makes only the kept features (and what they need)."""
        dates = [p for p in (date_pairs(self.anchor, self.dates) if self.anchor else []) if f"days__{p[0]}_minus_{p[1]}" in kept]
        used = {x for p in dates for x in p}
        return Recipe(
            [c for c in self.numeric if c in kept], [c for c in self.numeric_str if c in kept], {c: v for c, v in self.lowcard.items() if f"cat__{c}" in kept}, [c for c in self.null_flags if f"isnull__{c}" in kept],
            self.counted if "n_null_raw" in kept else [], self.anchor if used else None, [c for c in self.dates if c in used],
        )

    def names(self, df: DataFrame) -> list[str]:
        return df.select(*self.columns()).columns

    def apply(self, df: DataFrame, keep: list[str]) -> DataFrame:
        """keep and the features; a column that df lacks is null."""
        missing = [c for c in self.sources() if c not in df.columns]
        return df.withColumns({c: F.lit(None).cast("string") for c in missing}).select(*keep, *self.columns())


def fit_recipe(df: DataFrame, features: list[str], label: str, anchor: str | None = None, dates: tuple[str, ...] = (), levels: int = 50) -> Recipe:
    """Routes columns by type and screens null flags. Only schemas, rates and levels come to the driver."""
    recipe = Recipe(anchor=anchor, dates=list(dates), counted=list(features))
    texts = []
    for c in features:
        kind = df.schema[c].dataType
        if is_numeric(kind):
            recipe.numeric.append(c)
        elif not is_date(kind):
            texts.append(c)
    if texts:
        for r in kinds(column_stats(df, texts), levels).collect():
            if r.kind == "numeric_str":
                recipe.numeric_str.append(r.column)
            elif r.kind == "lowcard":
                recipe.lowcard[r.column] = label_codes(df, r.column)
    rates = null_rates(df, features, label).collect()
    recipe.null_flags = [r.column for r in rates if 0.01 <= max(r.rate_0 or 0, r.rate_1 or 0) <= 0.99 and abs((r.rate_0 or 0) - (r.rate_1 or 0)) >= 0.05]
    return recipe


def null_rates(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """column, rate_0, rate_1: the share of nulls in each class; in one pass."""
    def rate(c: str, y: int) -> Column:
        return F.avg(F.when(F.col(label) == y, null_flag(F.col(c)).cast("double"))).alias(f"rate_{y}")

    return df.agg(F.array(*(F.struct(F.lit(c).alias("column"), rate(c, 0), rate(c, 1)) for c in columns)).alias("x")).select(F.inline("x"))


def null_verdicts(rates: DataFrame, leak: float = 0.9, empty: float = 0.95) -> DataFrame:
    a, b = F.coalesce("rate_0", F.lit(0.0)), F.coalesce("rate_1", F.lit(0.0))
    return rates.withColumn("verdict", F.when(F.abs(a - b) >= leak, "leak").when((a >= empty) & (b >= empty), "empty").otherwise("keep"))


def date_ranges(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    one = [F.struct(F.lit(c).alias("column"), F.min(F.col(c).cast("date")).alias("first"), F.max(F.col(c).cast("date")).alias("last"), F.avg(F.col(c).isNotNull().cast("double")).alias("coverage")) for c in columns]
    return df.groupBy(label).agg(F.array(*one).alias("x")).select(label, F.inline("x"))


def unpivot(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """keys, column, value (double)."""
    return df.select(*keys, F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns))))


def top_shares(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, share of its most frequent value; null counts as a value."""
    long = df.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns))))
    counts = long.groupBy("column", "value").agg(F.count("*").alias("n"))
    return counts.groupBy("column").agg((F.max("n") / F.sum("n")).alias("share"))


def screened(stats: DataFrame, auc_leak: float = 0.995, constant: float = 0.9995) -> DataFrame:
    """Verdict on features with auc and share: leak, constant or keep."""
    return stats.withColumn("verdict", F.when((F.col("auc") >= auc_leak) | (F.col("auc") <= 1 - auc_leak), "leak").when((F.col("share") >= constant) & (F.abs(F.col("auc") - 0.5) < 0.01), "constant").otherwise("keep"))


def correlation_filter(pairs: list[tuple[str, str, float]], order: list[str], most: float = 0.95) -> list[str]:
    """Greedy, in the given order: a feature stays unless it correlates with one that stayed."""
    rho = {(a, b): r for a, b, r in pairs} | {(b, a): r for a, b, r in pairs}
    kept: list[str] = []
    for c in order:
        if all(abs(rho.get((c, k), 0.0)) < most for k in kept):
            kept.append(c)
    return kept


def any_of(*columns: Column) -> Column:
    return reduce(lambda a, b: a | b, columns)


def binary_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, binary (all values are 0 or 1), has_null; in one pass."""
    def one(c: str) -> Column:
        x = F.col(c).cast("double")
        return F.struct(F.lit(c).alias("column"), F.coalesce(F.min(x.isin(0.0, 1.0).cast("int")), F.lit(0)).alias("binary"), F.coalesce(F.max(F.col(c).isNull().cast("int")), F.lit(0)).alias("has_null"))

    return df.agg(F.array(*map(one, columns)).alias("x")).select(F.inline("x"))


def column_roles(df: DataFrame, columns: list[str], reserved: tuple[str, ...] = (), id_share: float = 0.5) -> DataFrame:
    """column, rows, distinct and what speaks against it: reserved, constant, id-like (nearly every row its own value), else keep."""
    s = column_stats(df, columns).select("column", "rows", "distinct")
    why = F.when(F.col("column").isin(*reserved) if reserved else F.lit(False), "reserved").when(F.col("distinct") <= 1, "constant").when(F.col("distinct") > F.col("rows") * id_share, "id_like")
    return s.withColumn("role", why.otherwise("keep"))


def asymmetric(df: DataFrame, built: list[str], label: str, most: float = 0.9) -> DataFrame:
    """Built features that are missing in one class and not in the other: rates and verdict."""
    return null_verdicts(null_rates(df, built, label), most, 2.0)


def leak_report(aucs: DataFrame, leak: float = 0.995, top: int = 60) -> DataFrame:
    """The features of the strongest single-feature AUC (max of auc and 1 - auc) and whether they leak. A top-k report."""
    a = F.greatest("auc", 1 - F.col("auc"))
    return aucs.select("column", a.alias("strength")).withColumn("leak", (F.col("strength") >= leak).cast("int")).orderBy(F.desc("strength"), "column").limit(top)


def fit_levels(df: DataFrame, column: str, least: int = 30, most: int = 30) -> list[str]:
    """Levels for one_hot: those of enough rows, the most frequent first; columns of more than `most` levels have none."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.trim(column).alias("v")).agg(F.count("*").alias("n"))
    found = counts.orderBy(F.desc("n"), "v").limit(most + 1).collect()
    return [] if len(found) > most else [r.v for r in found if r.n >= least]


def multi_label(df: DataFrame, columns: list[str], delimiter: str = "|", names: str = "(?i)(types|list|tags|codes)$", least: float = 0.01) -> DataFrame:
    """column, share of its values that hold the delimiter, and whether it holds several labels: by its name or that share."""
    share = lambda c: F.coalesce(F.avg(F.contains(F.col(c).cast("string"), F.lit(delimiter)).cast("double")), F.lit(0.0))
    t = df.agg(F.array(*(F.struct(F.lit(c).alias("column"), share(c).alias("share")) for c in columns)).alias("x")).select(F.inline("x"))
    return t.withColumn("multi", ((F.col("share") >= least) | F.col("column").rlike(names)).cast("int"))


def any_category(columns: list[str], vocabularies: dict[str, list[str]], delimiter: str = "|") -> list[Column]:
    """A flag for each token that the vocabularies of two columns or more have: whether any of these holds it."""
    held: dict[str, list[str]] = {}
    for c in columns:
        for t in vocabularies[c]:
            held.setdefault(t, []).append(c)
    return [F.greatest(*(F.array_contains(tokens(F.col(c), delimiter), t).cast("int") for c in own)).alias(f"anycat__{t}") for t, own in sorted(held.items()) if len(own) > 1]


def custom_features(df: DataFrame, hook, keys: list[str], reserved: tuple[str, ...] = ()) -> tuple[DataFrame, list[str]]:
    """(hook(df), the features it added). A hook may add and drop columns; it must keep the keys and the rows' grain, and new names
    must be plain and not reserved."""
    import re

    out = hook(df)
    lost = [k for k in keys if k not in out.columns]
    new = [c for c in out.columns if c not in df.columns]
    bad = [c for c in new if c in reserved or not re.fullmatch(r"[A-Za-z]\w*", c)]
    if lost or bad or len(set(out.columns)) < len(out.columns):
        raise ValueError(f"custom features: lost keys {lost}, unusable names {bad}")
    return out, new


def named(df: DataFrame, prefixes: tuple[str, ...]) -> list[str]:
    """Numeric columns whose names begin with one of the prefixes."""
    return [f.name for f in df.schema if f.name.startswith(prefixes) and is_numeric(f.dataType)]


__all__ = [n for n in dir() if not n.startswith("_")]
