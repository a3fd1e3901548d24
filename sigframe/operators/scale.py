"""Channel scaling without leaking held-out rows (AG-6, FN-9, FN-14..FN-16, D8, D9)."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigframe.functions.arrays import vector_element
from sigframe.schemas import CHANNELS


def scaler_stats(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """AG-6: one row with n, mean, sample std and population std of each column.
    A global aggregate: partial sums per task, one tiny final merge."""
    cols = cols or CHANNELS
    aggs = [F.count(F.lit(1)).alias("n")]
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std_samp"),
                 F.stddev_pop(c).alias(f"{c}_std_pop")]
    return df.agg(*aggs)


def moments(df: DataFrame, by: str = "patient", cols: list[str] | None = None) -> DataFrame:
    """One row per ``by`` with n, mean and the sum of squared deviations (``_m2``) of each column,
    NULLs left out. Store it once: the statistics of any set of recordings follow from it."""
    aggs = []
    for c in cols or CHANNELS:
        x = F.col(c).cast("double")
        aggs += [F.count(c).alias(f"{c}_n"), F.avg(x).alias(f"{c}_mean"), (F.var_pop(x) * F.count(c)).alias(f"{c}_m2")]
    return df.groupBy(by).agg(*aggs)


def merge_moments(parts: DataFrame, by: list[str] | None = None, cols: list[str] | None = None) -> DataFrame:
    """Moments of all rows of ``parts`` together (of each group of ``by``), by the parallel rule
    m2 = sum(m2) + sum(n (mean - all mean)^2), which does not subtract large numbers."""
    by, cols = by or [], cols or CHANNELS
    means = parts.groupBy(*by).agg(*[F.sum(F.col(f"{c}_n") * F.col(f"{c}_mean")).alias(f"_sf_{c}_sum") for c in cols],
                                   *[F.sum(f"{c}_n").alias(f"_sf_{c}_n") for c in cols])
    means = means.select(*by, *[(F.col(f"_sf_{c}_sum") / F.nullif(F.col(f"_sf_{c}_n"), F.lit(0))).alias(f"_sf_{c}_mean") for c in cols])
    if by:
        both = parts.join(means, by)
    else:
        both = parts.withColumn("_sf_all", means.select(F.struct(*means.columns)).scalar()).select("*", "_sf_all.*")
    out = []
    for c in cols:
        apart = F.col(f"{c}_mean") - F.col(f"_sf_{c}_mean")
        out += [F.sum(f"{c}_n").alias(f"{c}_n"), F.max(f"_sf_{c}_mean").alias(f"{c}_mean"),
                F.sum(F.col(f"{c}_m2") + F.col(f"{c}_n") * apart * apart).alias(f"{c}_m2")]
    return both.groupBy(*by).agg(*out)


def leave_one_out(parts: DataFrame, by: str = "patient", cols: list[str] | None = None) -> DataFrame:
    """For each row of ``parts`` the n, mean and population std of all other rows together, from
    the stored moments alone: no pass over samples whatever is held out."""
    cols = cols or CHANNELS
    total = merge_moments(parts, cols=cols)
    rows = parts.withColumn("_sf_all", total.select(F.struct(*total.columns)).scalar())
    out = []
    for c in cols:
        n, mean, m2 = (F.col(f"{c}_{x}") for x in ("n", "mean", "m2"))
        all_n, all_mean, all_m2 = (F.col(f"_sf_all.{c}_{x}") for x in ("n", "mean", "m2"))
        rest = F.nullif(all_n - n, F.lit(0))
        apart = F.coalesce(mean, all_mean) - all_mean
        left = F.greatest(all_m2 - F.coalesce(m2, F.lit(0.0)) - n * apart * apart * all_n / rest, F.lit(0.0))
        out += [(all_n - n).alias(f"{c}_n"), (all_mean - n * apart / rest).alias(f"{c}_mean"), F.sqrt(left / rest).alias(f"{c}_std_pop")]
    return rows.select(by, *out)


class ChannelScaler:
    """Fit on one DataFrame (the training rows), apply to any other.

    mode='scale_only': x / sample std, no centring (Spark ML's StandardScaler
    defaults); a constant column gives 0.
    mode='zscore_pop': (x - mean) / population std (scikit-learn's rule); a
    constant column gives x - mean = 0.
    ``fit`` runs one aggregate job and keeps a handful of numbers; ``transform``
    applies them as literals, so no join or broadcast is needed.
    """

    def __init__(self, cols: list[str] | None = None, mode: str = "scale_only",
                 suffix: str = ""):
        if mode not in ("scale_only", "zscore_pop"):
            raise ValueError(mode)
        self.cols, self.mode, self.suffix = cols or CHANNELS, mode, suffix
        self.stats: dict[str, tuple[float, float]] | None = None

    def fit(self, df: DataFrame) -> "ChannelScaler":
        row = scaler_stats(df, self.cols).first()
        std = "std_samp" if self.mode == "scale_only" else "std_pop"
        self.stats = {c: (row[f"{c}_mean"], row[f"{c}_{std}"]) for c in self.cols}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        if self.stats is None:
            raise RuntimeError("fit first")
        exprs = {}
        for c, (mean, std) in self.stats.items():
            x = F.col(c).cast("double")
            if self.mode == "scale_only":
                v = x / F.lit(std) if std else F.lit(0.0) * x
            else:
                v = (x - F.lit(mean)) / F.lit(std if std else 1.0)
            exprs[c + self.suffix] = v
        return df.withColumns(exprs)


def scale_tagged(df: DataFrame, side: str = "side", cols: list[str] | None = None,
                 mode: str = "scale_only", scope: str = "train") -> DataFrame:
    """D9 on one table whose ``side`` column says 'train' or not: statistics of the
    training rows (of all rows with scope='all'), applied to every row."""
    fit_on = df if scope == "all" else df.filter(F.col(side) == "train")
    return ChannelScaler(cols, mode).fit(fit_on).transform(df)


def scale_channels(train: DataFrame, others: list[DataFrame] | None = None,
                   cols: list[str] | None = None, mode: str = "scale_only",
                   scope: str = "train") -> list[DataFrame]:
    """D9: fit on ``train`` (scope='train') or on train plus the others
    (scope='all', the leaky parity setting), then transform every input."""
    others = others or []
    fit_on = train
    if scope == "all":
        for o in others:
            fit_on = fit_on.unionByName(o)
    sc = ChannelScaler(cols, mode).fit(fit_on)
    return [sc.transform(d) for d in [train, *others]]


def ml_scaled_channels(df: DataFrame, cols: list[str] | None = None,
                       prefix: str = "scaled_") -> DataFrame:
    """FN-14/FN-15/FN-9 with Spark ML: assemble the channels into a vector (rows
    with a NULL channel skipped), StandardScaler (std only), then take each
    element back out as a float column."""
    cols = cols or CHANNELS
    asm = VectorAssembler(inputCols=cols, outputCol="_sf_features", handleInvalid="skip")
    scaler = StandardScaler(inputCol="_sf_features", outputCol="_sf_scaled")
    model = Pipeline(stages=[asm, scaler]).fit(df)
    out = model.transform(df)
    return (out.withColumns({prefix + c: vector_element("_sf_scaled", i) for i, c in enumerate(cols)})
               .drop("_sf_features", "_sf_scaled"))
