"""Winsorising, imputing and z-scoring with parameters fitted once and applied anywhere.

Parameters are a small table (feature, sector, lo, hi, mean, std), one row per feature and, for
sector-normalised features, per sector; it is saved as Parquet and joined by broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Features that are normalised within their sector.
SECTOR_FEATURES = frozenset(
    "pe_ratio forward_pe pb_ratio ps_ratio ev_ebitda peg_ratio pe_vs_sector_avg ev_revenue price_to_fcf earnings_yield fcf_yield "
    "price_to_tangible_book roe roa roic gross_margin operating_margin net_margin ebitda_margin fcf_margin revenue_growth_yoy earnings_growth_yoy "
    "debt_to_equity current_ratio quick_ratio net_debt_ebitda altman_z_score piotroski_f_score asset_turnover inventory_turnover".split()
)


def _clip(x: Column, lo: Column, hi: Column) -> Column:
    """x within [lo, hi]; null stays null and null bounds do not bind."""
    return F.when(x.isNull(), None).otherwise(F.greatest(F.least(x, hi), lo))


def exact_quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], accuracy: int = 10_000) -> DataFrame:
    """(feature, quantiles): exact interpolated quantiles of every column, null where it has no value.

    Each order statistic is bracketed by a sketch (its rank is off by at most 1 in ``accuracy``) and the
    bracket by another, until it holds at most 10 x ``accuracy`` rows or one value; only values inside
    brackets are grouped and ranked.  The driver gets counts and bounds by column, and the result is a
    local table.  Nulls do not count.  ``df`` is read two to four times: write it first if it is costly.
    """
    columns, limit = list(columns), 10 * accuracy
    if not columns:
        return df.sparkSession.createDataFrame([], "feature string, quantiles array<double>")
    first = df.agg(*[F.struct(F.count(c).alias("n"), F.min(c).cast("double").alias("lo"), F.max(c).cast("double").alias("hi")).alias(c) for c in columns]).first()
    ranks = {(c, i): q * (first[c]["n"] - 1) for c in columns for i, q in enumerate(probabilities) if first[c]["n"]}
    held = {p: (first[p[0]]["lo"], first[p[0]]["hi"], 0, first[p[0]]["n"]) for p in ranks}  # lo, hi, rows below, rows inside
    inside = lambda p: F.col(p[0]).between(F.lit(held[p][0]), F.lit(held[p][1]))
    while wide := [p for p, (lo, hi, _, n) in held.items() if n > limit and lo < hi]:
        ends = {p: [min(1.0, max(0.0, (ranks[p] - held[p][2]) / held[p][3] + side * 3 / accuracy)) for side in (-1, 1)] for p in wide}
        found = df.agg(*[F.percentile_approx(F.when(inside(p), F.col(p[0]).cast("double")), ends[p], accuracy).alias(f"p{k}") for k, p in enumerate(wide)]).first()
        before = dict(held)
        for k, p in enumerate(wide):
            held[p] = (*found[f"p{k}"], 0, 0)
        counts = [x for k, p in enumerate(wide) for x in (F.count(F.when(F.col(p[0]) < held[p][0], 1)).alias(f"b{k}"), F.count(F.when(inside(p), 1)).alias(f"n{k}"))]
        found = df.agg(*counts).first()
        for k, p in enumerate(wide):
            held[p] = (*held[p][:2], found[f"b{k}"], found[f"n{k}"])
        if all(held[p] == before[p] for p in wide):
            break
    brackets = {x: k for k, x in enumerate(dict.fromkeys((p[0], *held[p][:2]) for p in held))}
    wanted: dict[int, set[int]] = {}
    for p, (lo, hi, below, _) in held.items():
        wanted.setdefault(brackets[p[0], lo, hi], set()).update((math.floor(ranks[p]) - below, math.ceil(ranks[p]) - below))
    values: dict[tuple[int, int], float] = {}
    if brackets:
        each = F.array(*[F.struct(F.lit(k).alias("bracket"), F.when(F.col(c).between(F.lit(lo), F.lit(hi)), F.col(c).cast("double")).alias("value")) for (c, lo, hi), k in brackets.items()])
        tall = df.select(F.explode(F.filter(each, lambda x: x["value"].isNotNull())).alias("v")).groupBy("v.bracket", "v.value").count()
        places = df.sparkSession.createDataFrame([(k, sorted(v)) for k, v in wanted.items()], "bracket int, places array<long>")
        ranked = tall.withColumn("seen", F.sum("count").over(W.partitionBy("bracket").orderBy("value").rowsBetween(W.unboundedPreceding, 0)))
        here = F.filter("places", lambda x: (x < F.col("seen")) & (x >= F.col("seen") - F.col("count")))
        for r in ranked.join(F.broadcast(places), "bracket").select("bracket", "value", here.alias("at")).filter(F.size("at") > 0).collect():  # two places a quantile
            values.update({(r["bracket"], k): r["value"] for k in r["at"]})

    def quantile(p: tuple[str, int]) -> float | None:
        if p not in held:
            return None
        lo, hi, below, _ = held[p]
        a, b = (values[brackets[p[0], lo, hi], f(ranks[p]) - below] for f in (math.floor, math.ceil))
        part = ranks[p] - math.floor(ranks[p])
        return a if part == 0 else (1 - part) * a + part * b

    rows = [(c, [quantile((c, i)) for i in range(len(probabilities))]) for c in columns]
    return df.sparkSession.createDataFrame(rows, "feature string, quantiles array<double>")


@dataclass
class FeatureScaler:
    """Fitted state: ``parameters`` has feature, sector (null: all), lo, hi, mean, std; it is a local table, applied as literals."""

    parameters: DataFrame
    features: list[str]
    sector_col: str | None = None
    _rows: list | None = field(default=None, repr=False)

    @classmethod
    def fit(cls, df: DataFrame, features: Sequence[str], sector_col: str | None = None, quantile: float = 0.01) -> "FeatureScaler":
        """Bounds are exact quantiles, means and sample deviations those of the clipped and filled values.

        All features are aggregated together; no task holds the values of a whole feature.
        """
        features = list(features)
        bounds = {r["feature"]: r["quantiles"] for r in exact_quantiles(df, features, (quantile, 1 - quantile)).collect()}
        filled = [F.coalesce(_clip(F.col(c), *map(F.lit, bounds[c])), F.lit(0.0)).alias(c) for c in features]
        kept = df.select(*([sector_col] if sector_col else []), *filled)
        by_sector = [c for c in features if sector_col and c in SECTOR_FEATURES]
        rows = []
        for names, keys in (([c for c in features if c not in by_sector], []), (by_sector, [sector_col])):
            if not names:
                continue
            for r in kept.groupBy(*keys).agg(*[F.struct(F.avg(c).alias("mean"), F.stddev_samp(c).alias("std")).alias(c) for c in names]).collect():  # a row per sector
                rows += [(c, r[sector_col] if keys else None, *bounds[c], r[c]["mean"], r[c]["std"] if (r[c]["std"] or 0) > 0 else 1.0) for c in names]
        sector = df.schema[sector_col].dataType.simpleString() if sector_col else "string"
        return cls(df.sparkSession.createDataFrame(rows, f"feature string, sector {sector}, lo double, hi double, mean double, std double"), features, sector_col)

    def _known(self) -> list:
        """The parameters on the driver: a row per feature and sector."""
        if self._rows is None:
            self._rows = self.parameters.collect()
        return self._rows

    def transform(self, df: DataFrame) -> DataFrame:
        """Clip, fill and scale the fitted features of ``df``; other columns pass through, unseen sectors get 0 and 1."""
        names = [c for c in self.features if c in df.columns]
        by_sector = [c for c in names if self.sector_col and c in SECTOR_FEATURES]
        known = {r["feature"]: r for r in self._known()}
        mean, std = ({c: F.lit(known[c][x]) if c in known else F.lit(None).cast("double") for c in names} for x in ("mean", "std"))
        out = df
        if by_sector:
            value = lambda c, x: F.max(F.when(F.col("feature") == c, F.col(x))).alias(f"__{x}_{c}")
            found = self.parameters.filter("sector is not null").groupBy(F.col("sector").alias(self.sector_col)).agg(*[value(c, x) for c in by_sector for x in ("mean", "std")])
            out = out.join(F.broadcast(found), self.sector_col, "left")  # one row per sector
            mean |= {c: F.col(f"__mean_{c}") for c in by_sector}
            std |= {c: F.col(f"__std_{c}") for c in by_sector}

        def scaled(c: str) -> Column:
            lo, hi = (F.lit(known[c][x] if c in known else None).cast("double") for x in ("lo", "hi"))
            return (F.coalesce(_clip(F.col(c), lo, hi), F.lit(0.0)) - F.coalesce(mean[c], F.lit(0.0))) / F.coalesce(std[c], F.lit(1.0))

        return out.select(*[scaled(c).alias(c) if c in names else F.col(c) for c in df.columns])

    def save(self, path: str) -> None:
        order = F.create_map(*[x for i, c in enumerate(self.features) for x in (F.lit(c), F.lit(i))])
        self.parameters.withColumns({"place": F.element_at(order, F.col("feature")), "sector_col": F.lit(self.sector_col)}).coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "FeatureScaler":
        saved = spark.read.parquet(path)
        rows = saved.select("feature", "place", "sector_col").distinct().orderBy("place").collect()  # one row per feature
        return cls(saved.drop("place", "sector_col"), [r["feature"] for r in rows], rows[0]["sector_col"] if rows else None)


def grouped_quantiles(df: DataFrame, group: str, columns: Sequence[str], probabilities: Sequence[float], accuracy: int = 10_000) -> DataFrame:
    """(group, feature, quantiles): exact interpolated quantiles of every column within each group, null where it has no value.

    As :func:`exact_quantiles`, for all groups together: brackets come from one sketch a group, and only
    values inside them are ranked.  The driver gets a row per group, so groups must be few.
    """
    columns, slack = list(columns), 3 / accuracy
    ends = [e for q in probabilities for e in (max(q - slack, 0.0), min(q + slack, 1.0))]
    parts = [F.struct(F.count(c).alias("n"), F.min(c).cast("double").alias("lo"), F.max(c).cast("double").alias("hi"), F.percentile_approx(F.col(c).cast("double"), ends, accuracy).alias("at")).alias(c) for c in columns]
    rows = []
    for r in df.groupBy(group).agg(*parts).collect():  # a row per group
        for c in columns:
            few = r[c]["n"] < accuracy
            for i, q in enumerate(probabilities):
                lo, hi = (r[c]["lo"], r[c]["hi"]) if few else r[c]["at"][2 * i : 2 * i + 2]
                rows.append((r[group], c, i, lo, hi, q * (r[c]["n"] - 1)))
    kind = df.schema[group].dataType.simpleString()
    brackets = df.sparkSession.createDataFrame(rows, f"`{group}` {kind}, feature string, i int, lo double, hi double, place double")
    each = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])
    tall = df.select(group, F.explode(F.filter(each, lambda x: x["value"].isNotNull())).alias("v")).select(group, "v.feature", "v.value")
    keys = [group, "feature", "i"]
    met = tall.join(F.broadcast(brackets), [group, "feature"]).filter(F.col("value") <= F.col("hi"))  # a row per group, feature and quantile
    counted = met.groupBy(*keys, "place", F.when(F.col("value") >= F.col("lo"), F.col("value")).alias("value")).count()  # values below the bracket together, as null
    reached = F.sum("count").over(W.partitionBy(*keys).orderBy(F.asc_nulls_first("value")).rowsBetween(W.unboundedPreceding, 0))
    ranked = counted.withColumn("reached", reached)
    found = ranked.groupBy(*keys).agg(
        F.min(F.when(F.col("reached") > F.floor("place"), F.col("value"))).alias("a"), F.min(F.when(F.col("reached") > F.ceil("place"), F.col("value"))).alias("b"), F.first(F.col("place") - F.floor("place")).alias("part")
    )
    value = F.when(F.col("part") == 0, F.col("a")).otherwise((1 - F.col("part")) * F.col("a") + F.col("part") * F.col("b"))
    values = found.groupBy(group, "feature").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", value.alias("value")))), lambda x: x["value"]).alias("quantiles"))
    return brackets.select(group, "feature").distinct().join(values, [group, "feature"], "left")


@dataclass
class FoldScaler:
    """Bounds and moments of each fold's own training rows: ``parameters`` has fold, feature, lo, hi, mean, std, n."""

    parameters: DataFrame
    features: list[str]

    @classmethod
    def fit(cls, training: DataFrame, features: Sequence[str], quantile: float = 0.01) -> "FoldScaler":
        """From ``training`` (fold, features), all folds in one plan; nulls count as 0 in the moments, as they do when scaled.  It is read three times."""
        features = list(features)
        bounds = grouped_quantiles(training, "fold", features, (quantile, 1 - quantile))
        bounds = bounds.select("fold", "feature", F.col("quantiles")[0].alias("lo"), F.col("quantiles")[1].alias("hi"))
        each = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in features])
        tall = training.select("fold", F.explode(each).alias("v")).select("fold", "v.feature", "v.x").join(F.broadcast(bounds), ["fold", "feature"])  # a row per fold and feature
        x = F.coalesce(_clip(F.col("x"), F.col("lo"), F.col("hi")), F.lit(0.0))
        std = F.stddev_samp(x)
        found = tall.groupBy("fold", "feature", "lo", "hi").agg(F.avg(x).alias("mean"), F.when(std > 0, std).otherwise(1.0).alias("std"), F.count(F.lit(1)).alias("n")).collect()
        schema = "fold int, feature string, lo double, hi double, mean double, std double, n long"
        return cls(training.sparkSession.createDataFrame(found, schema), features)

    def transform(self, df: DataFrame) -> DataFrame:
        """Rows (fold, features) clipped, filled and scaled by their fold's parameters; rows of folds without any get 0 and 1."""
        value = lambda c, x: F.max(F.when(F.col("feature") == c, F.col(x))).alias(f"__{x}_{c}")
        wide = self.parameters.groupBy("fold").agg(*[value(c, x) for c in self.features for x in ("lo", "hi", "mean", "std")])
        out = df.join(F.broadcast(wide), "fold", "left")  # one row per fold
        scaled = lambda c: (F.coalesce(_clip(F.col(c), F.col(f"__lo_{c}"), F.col(f"__hi_{c}")), F.lit(0.0)) - F.coalesce(f"__mean_{c}", F.lit(0.0))) / F.coalesce(f"__std_{c}", F.lit(1.0))
        return out.select(*[scaled(c).alias(c) if c in self.features else F.col(c) for c in df.columns])


def coverage(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """feature, non_null_pct, nulls, mean, std, p01, p99; least covered first."""
    stats = df.agg(
        *[
            F.struct(
                (F.avg(F.col(c).isNotNull().cast("double")) * 100).alias("non_null_pct"),
                F.sum(F.col(c).isNull().cast("long")).alias("nulls"),
                F.avg(c).alias("mean"),
                F.stddev_samp(c).alias("std"),
            ).alias(c)
            for c in columns
        ]
    )
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("s")) for c in columns])).alias("r")
    ends = exact_quantiles(df, columns, (0.01, 0.99)).select("feature", F.col("quantiles")[0].alias("p01"), F.col("quantiles")[1].alias("p99"))
    return stats.select(rows).select("r.feature", "r.s.*").join(F.broadcast(ends), "feature", "left").orderBy("non_null_pct", "feature")  # a row per feature
