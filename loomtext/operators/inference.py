"""Interrupted time series, split tests, mixed and count models.

Large data is reduced by Spark first (panels, sufficient statistics); the small dense algebra runs in grouped Arrow
functions, one group per series, or on the driver for one model's cross-products.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import benjamini_hochberg, chi2_2x2, chi2_p, chi2_sf, erfc_p, normal_quantile, t_p, t_sf2, welch
from ..shared import discard, stored
from .panel import direction_column

COEFFICIENTS = "term string, estimate double, std_error double, statistic double, p_value double, n_obs long, r_squared double"


def ols(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients, residuals and the inverse cross-product."""
    inv = np.linalg.pinv(x.T @ x)
    beta = inv @ x.T @ y
    return beta, y - x @ beta, inv


def newey_west(x: np.ndarray, e: np.ndarray, inv: np.ndarray, lag: int = 3, prewhite: bool = False) -> np.ndarray:
    """Autocorrelation-robust covariance with the Bartlett kernel; prewhitened by a first-order vector autoregression."""
    g = x * e[:, None]
    recolour = None
    if prewhite:
        a, *_ = np.linalg.lstsq(g[:-1], g[1:], rcond=None)
        g = g[1:] - g[:-1] @ a
        recolour = np.linalg.pinv(np.eye(g.shape[1]) - a.T)
    s = g.T @ g
    for k in range(1, lag + 1):
        c = g[k:].T @ g[:-k]
        s += (1 - k / (lag + 1)) * (c + c.T)
    if recolour is not None:
        s = recolour @ s @ recolour.T * len(x) / len(g)
    return inv @ s @ inv * len(x) / (len(x) - x.shape[1])


def fit_series(pdf: pd.DataFrame, y: str, terms: list[str], minimum: int, lag: int, prewhite: bool, order: str) -> pd.DataFrame:
    names = [c.split()[0] for c in COEFFICIENTS.split(", ")]
    d = pdf.sort_values(order, kind="stable")[[y, *terms]].astype(float).dropna()
    if len(d) < max(minimum, len(terms) + 2):
        return pd.DataFrame(columns=names)
    x = np.column_stack([np.ones(len(d)), d[terms].to_numpy()])
    v = d[y].to_numpy()
    beta, e, inv = ols(x, v)
    se = np.sqrt(np.maximum(np.diag(newey_west(x, e, inv, lag, prewhite)), 0))
    with np.errstate(divide="ignore", invalid="ignore"):
        t = np.where(se > 0, beta / se, np.nan)
    total = ((v - v.mean()) ** 2).sum()
    df = len(d) - x.shape[1]
    p = [t_sf2(k, df) if np.isfinite(k) else np.nan for k in t]
    return pd.DataFrame({"term": ["(Intercept)", *terms], "estimate": beta, "std_error": se, "statistic": t, "p_value": p, "n_obs": len(d), "r_squared": 1 - (e @ e) / total if total > 0 else np.nan})


ITS_TERMS = ["time", "intervention", "time_after"]


def its(
    panel: DataFrame, metrics: list[str], by: list[str], covariates: list[str] = ("mean_words",), minimum: int = 20, lag: int = 3, prewhite: bool = False,
    steps: list[str] = ITS_TERMS,
) -> DataFrame:
    """Segmented regression (terms ``steps`` and covariates) of every metric in every group, all series at once: BH per
    term, expected direction.  A series is in the order of year_month where the panel has it (truncated month numbers
    repeat), else of time."""
    terms = [*steps, *covariates]
    order = "year_month" if "year_month" in panel.columns else "time"
    kinds = ", ".join(f"{k} {panel.schema[k].dataType.simpleString()}" for k in by)
    own = [k for k in metrics if k not in terms]
    shared = panel.select(*by, *terms, F.col(order).alias("__order"), F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in own])).alias("x"))
    long = shared.select(*by, *terms, "__order", "x.metric", "x.value")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = fit_series(pdf, "value", terms, minimum, lag, prewhite, "__order")
        for name, value in zip([*by, "metric"], key):
            out[name] = value
        return out

    fitted = long.groupBy(*by, "metric").applyInPandas(run, f"{COEFFICIENTS}, {kinds}, metric string")
    done = benjamini_hochberg(fitted, "p_value", ["term"])
    expected = direction_column("metric")
    return done.withColumns({"expected_direction": expected, "direction_match": F.signum("estimate") == expected, "significant": F.col("p_adj") < 0.05})


def homogenization_its(sd_panel: DataFrame, metrics: list[str], by: list[str], min_articles: int = 5, min_months: int = 15) -> DataFrame:
    """The same on within-group standard deviations; a fall is homogenisation."""
    kept = sd_panel.where(F.col("n_articles") >= min_articles)
    return its(kept, metrics, by, ["n_articles"], min_months, prewhite=True).withColumn("homogenizing", F.col("estimate") < 0)


def split_ttest(df: DataFrame, metrics: list[str], period: str, by: list[str] = (), minimum: int = 10) -> DataFrame:
    """Welch tests post against pre for every metric, pooled and per group, BH per metric."""
    x = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]))
    long = df.select(*by, period, x.alias("x")).select(*by, period, "x.metric", "x.value").where("value is not null")
    part = long.groupBy(*by, "metric", period).agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.var_samp("value").alias("v"))
    out = _sides(part, [*by, "metric"], period, minimum).withColumn("scope", F.lit("group"))
    if by:
        pooled = long.groupBy("metric", period).agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.var_samp("value").alias("v"))
        out = out.unionByName(_sides(pooled, ["metric"], period, minimum).withColumn("scope", F.lit("pooled")), allowMissingColumns=True)
    out = benjamini_hochberg(out.withColumn("p_value", t_p("t", "df")), "p_value", ["metric"])
    expected = direction_column("metric")
    return out.withColumns({"expected_direction": expected, "direction_match": F.signum("t") == expected})


def _sides(part: DataFrame, keys: list[str], period: str, minimum: int) -> DataFrame:
    side = lambda p, c: F.max(F.when(F.col(period) == p, F.col(c)))
    wide = part.groupBy(*keys).agg(*[side(p, c).alias(f"{c}{i}") for i, p in ((1, "pre"), (2, "post")) for c in ("n", "m", "v")])
    t, df = welch({k: F.col(k) for k in ("n1", "m1", "v1", "n2", "m2", "v2")})
    enough = (F.col("n1") >= minimum) & (F.col("n2") >= minimum)
    return wide.where(enough).select(*keys, "n1", "n2", F.col("m1").alias("pre_mean"), F.col("m2").alias("post_mean"), ((F.col("m2") - F.col("m1")) * 100 / F.nullif(F.abs("m1"), F.lit(0.0))).alias("pct_change"), t.alias("t"), df.alias("df"))


def split_chi2(df: DataFrame, count: str, total: str, period: str, by: list[str] = (), yates: bool = True) -> DataFrame:
    """Counts of marked words against totals, pre and post, pooled and per group, Yates-corrected."""
    side = lambda c, p: F.sum(F.when(F.col(period) == p, F.col(c)).otherwise(0))
    aggs = [side(count, "pre").alias("a"), side(count, "post").alias("b"), side(total, "pre").alias("n1"), side(total, "post").alias("n2")]
    per = df.groupBy(*by).agg(*aggs).withColumn("scope", F.lit("group" if by else "pooled"))
    if by:  # pooled sums come from the groups' sums
        pooled = per.agg(*[F.sum(k).alias(k) for k in ("a", "b", "n1", "n2")]).withColumn("scope", F.lit("pooled"))
        per = per.unionByName(pooled, allowMissingColumns=True)
    return per.withColumn("chi2", chi2_2x2(F.col("a"), F.col("b"), F.col("n1"), F.col("n2"), yates)).withColumn("p_value", chi2_p("chi2"))


def compare_flagged(df: DataFrame, flagged: DataFrame, on: list[str], metrics: list[str]) -> DataFrame:
    """Welch tests of flagged against other articles."""
    marks = flagged.select(*on).distinct().withColumn("__f", F.lit(True))
    sides = df.join(marks, on, "left").withColumn("side", F.when(F.col("__f"), "post").otherwise("pre"))
    return split_ttest(sides, metrics, "side")


def wilcoxon_less(x: np.ndarray, y: np.ndarray) -> float:
    """One-sided rank-sum p-value that y tends to be smaller than x (normal approximation with ties)."""
    v = np.concatenate([x, y])
    r = pd.Series(v).rank().to_numpy()
    n1, n2 = len(x), len(y)
    u = r[n1:].sum() - n2 * (n2 + 1) / 2
    _, t = np.unique(v, return_counts=True)
    n = n1 + n2
    sd = np.sqrt(n1 * n2 / 12 * (n + 1 - (t**3 - t).sum() / (n * (n - 1))))
    z = (u - n1 * n2 / 2 + 0.5) / sd if sd > 0 else 0.0
    tail = erfc_p(z) / 2
    return tail if z < 0 else 1 - tail


def fligner(groups: list[np.ndarray]) -> tuple[float, float]:
    """Fligner-Killeen statistic and p-value: normal scores of ranked absolute deviations from group medians."""
    dev = [np.abs(g - np.median(g)) for g in groups]
    n = sum(map(len, dev))
    r = pd.Series(np.concatenate(dev)).rank().to_numpy()
    a = np.array([normal_quantile((1 + k / (n + 1)) / 2) for k in r])
    parts = np.split(a, np.cumsum([len(g) for g in groups])[:-1])
    var = a.var(ddof=1)
    stat = sum(len(p) * (p.mean() - a.mean()) ** 2 for p in parts) / var if var > 0 else 0.0
    return float(stat), chi2_sf(float(stat), len(groups) - 1)


def homogenization_tests(series: DataFrame, value: str, period: str, by: list[str], minimum: int = 5) -> DataFrame:
    """Pre and post means of monthly deviations with Fligner-Killeen and one-sided rank tests, BH over the groups."""
    kinds = ", ".join(f"{k} {series.schema[k].dataType.simpleString()}" for k in by)
    schema = f"{kinds}, pre_mean double, post_mean double, fligner double, fligner_p double, wilcoxon_p double"

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pre, post = (pdf.loc[pdf[period] == p, value].dropna().to_numpy(float) for p in ("pre", "post"))
        if len(pre) < minimum or len(post) < minimum:
            return pd.DataFrame(columns=[k.rsplit(" ", 1)[0] for k in schema.split(", ")])
        stat, p = fligner([pre, post])
        return pd.DataFrame([(*key, pre.mean(), post.mean(), stat, p, wilcoxon_less(pre, post))], columns=[k.rsplit(" ", 1)[0] for k in schema.split(", ")])

    tests = series.groupBy(*by).applyInPandas(run, schema)
    return benjamini_hochberg(tests, "wilcoxon_p").withColumn("direction", F.when(F.col("post_mean") < F.col("pre_mean"), "homogenizing").otherwise("diverging"))


# --- mixed and count models ----------------------------------------------------------------------------------------


def cross_products(df: DataFrame, y: str, terms: list[str], group: str, nested: str | None = None) -> DataFrame:
    """Per group: n, X'X, X'y and y'y of the design (1, terms), as columns s_i_j; one pass with partial sums."""
    own = [F.col(f"`{t}`").cast("double") for t in (*terms, y)]
    rows = df.where(F.col(group).isNotNull())
    for c in own:
        rows = rows.where(c.isNotNull() & ~F.isnan(c))
    cols = [F.lit(1.0), *own]
    sums = [F.sum(cols[i] * cols[j]).alias(f"s_{i}_{j}") for i in range(len(cols)) for j in range(i, len(cols))]
    keys = [group, nested] if nested else [group]
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *sums)


def _stack(pdf: pd.DataFrame, k: int) -> np.ndarray:
    """Cross-products of all groups: (groups, k + 1, k + 1)."""
    out = np.zeros((len(pdf), k + 1, k + 1))
    for i in range(k + 1):
        for j in range(i, k + 1):
            out[:, i, j] = out[:, j, i] = pdf[f"s_{i}_{j}"].to_numpy(float)
    return out


def dummies(df: DataFrame, columns: list[str]) -> tuple[DataFrame, list[str]]:
    """df with a 0/1 column for each level of each categorical column but the first in order; their names, 'column=level'.
    Levels are a bounded list (outlet types, topics)."""
    names = []
    for c in columns:
        levels = sorted(r[0] for r in df.where(F.col(c).isNotNull()).select(c).distinct().collect())
        for level in levels[1:]:
            names.append(f"{c}={level}")
            df = df.withColumn(names[-1], F.when(F.col(c).isNull(), None).otherwise((F.col(c) == level).cast("int")))
    return df, names


class _Rounds:
    """One pass over the groups' cross-products: sums that a round of EM needs, from tables of any number of groups."""

    def __init__(self, k: int, pick: list[int], levels: int):
        self.k, self.pick, self.levels = k, pick, levels  # fixed terms, those with a random part, levels of the upper grouping

    def _parts(self, sums: np.ndarray, level: np.ndarray, s2: float, ginv: np.ndarray):
        k, pick = self.k, self.pick
        xx, xy, yy = sums[:, :k, :k], sums[:, :k, k], sums[:, k, k]
        zz, zx, zy = xx[:, pick][:, :, pick], xx[:, pick], xy[:, pick]
        v = np.linalg.pinv(zz / s2 + ginv)
        if self.levels:  # the upper level's indicator is the group's intercept
            wide = [*range(k), 0]
            xx, xy, zx = xx[:, wide][:, :, wide], xy[:, wide], zx[:, :, wide]
        return xx, xy, yy, zz, zx, zy, v

    def _places(self, level: np.ndarray) -> np.ndarray:
        k = self.k
        return np.concatenate((np.tile(np.arange(k), (len(level), 1)), k + level[:, None]), 1) if self.levels else np.tile(np.arange(k), (len(level), 1))

    def equations(self, sums: np.ndarray, level: np.ndarray, s2: float, ginv: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Left and right side of the fixed effects' equations (with those of the upper level)."""
        xx, xy, _, _, zx, zy, v = self._parts(sums, level, s2, ginv)
        m, at = self.k + self.levels, self._places(level)
        left, right = np.zeros((m, m)), np.zeros(m)
        vzx = v @ zx
        np.add.at(left, (at[:, :, None], at[:, None, :]), (xx - np.einsum("gqa,gqb->gab", zx, vzx) / s2) / s2)
        np.add.at(right, at, (xy - np.einsum("gqa,gq->ga", vzx, zy) / s2) / s2)
        return left, right

    def moments(self, sums: np.ndarray, level: np.ndarray, s2: float, ginv: np.ndarray, beta: np.ndarray, cov: np.ndarray):
        """Random effects of each group, and the sums that new variances come from."""
        xx, xy, yy, zz, zx, zy, v = self._parts(sums, level, s2, ginv)
        at = self._places(level)
        b, c = beta[at], cov[at[:, :, None], at[:, None, :]]
        gap = zy - np.einsum("gqa,ga->gq", zx, b)
        u = np.einsum("gpq,gq->gp", v, gap) / s2
        vzx = v @ zx
        w = v + np.einsum("gpa,gab,gqb->gpq", vzx, c, vzx) / s2**2  # restricted likelihood
        rss = (
            yy - 2 * np.einsum("ga,ga->g", b, xy) + np.einsum("ga,gab,gb->g", b, xx, b) - 2 * np.einsum("gq,gq->g", u, gap)
            + np.einsum("gp,gpq,gq->g", u, zz, u) + np.einsum("gpq,gqp->g", zz, w) + np.einsum("gab,gba->g", xx, c)
            - 2 * np.einsum("gqa,gab,gqb->g", zx, c, vzx) / s2
        )
        return u, np.einsum("gp,gq->pq", u, u) + w.sum(0), rss.sum()


def mixed_model(
    df: DataFrame, y: str, terms: list[str], group: str, random: list[str] = (), outlet: str | None = None, categorical: list[str] = (),
    minimum: int = 200, steps: int = 200, driver_groups: int = 50_000,
) -> tuple[pd.DataFrame, pd.DataFrame | DataFrame]:
    """Linear mixed model by EM (restricted likelihood) on per-group cross-products: a random intercept and random slopes
    per group, and with ``outlet`` a random intercept per outlet that groups lie in (if there are several).

    ``categorical`` columns enter as 0/1 terms, the first level being the base.  Returns fixed effects (term, estimate,
    std_error, statistic, p_value by the normal approximation) and the random effects per group.  Up to
    ``driver_groups`` small matrices come to the driver; of more groups the matrices stay in a table, each round adds up
    on the executors what it needs, and the random effects are a DataFrame.  Too few rows give empty results.
    """
    df, more = dummies(df, list(categorical))
    terms = [*terms, *more]
    k = len(terms) + 1
    stats = stored(df.sparkSession, cross_products(df, y, terms, group, outlet), "cross-products")
    whole = stats.agg(F.sum("n").alias("n"), F.count("*").alias("g")).first()
    if (whole.n or 0) < minimum:
        return pd.DataFrame(columns=["term", "estimate", "std_error", "statistic", "p_value"]), pd.DataFrame(columns=[group])
    levels = sorted(r[0] for r in stats.select(outlet).distinct().collect()) if outlet else []  # a bounded list
    levels = levels if len(levels) > 1 else []
    number = {v: i for i, v in enumerate(levels)}
    pick = [0, *[1 + terms.index(t) for t in random]]
    rounds = _Rounds(k, pick, len(levels))
    of = lambda pdf: pdf[outlet].map(number).to_numpy(int) if levels else np.zeros(len(pdf), int)
    if whole.g <= driver_groups:
        pdf = stats.toPandas()
        held = (_stack(pdf, k), of(pdf))
        run = lambda f: f(*held)
    else:
        run = lambda f: _summed(stats, lambda pdf: f(_stack(pdf, k), of(pdf)))
    n, m = int(whole.n), k + len(levels)
    total = run(lambda s, level: (s.sum(0),))[0]
    beta = np.linalg.pinv(total[:k, :k]) @ total[:k, k]
    s2 = max((total[k, k] - beta @ total[:k, k]) / max(n - k, 1), 1e-12)
    g, top = np.eye(len(pick)) * s2 / 10, s2 / 10
    for _ in range(steps):
        ginv = np.linalg.pinv(g)
        left, right = run(lambda s, level: rounds.equations(s, level, s2, ginv))
        if levels:
            left = left + np.diag([0.0] * k + [1 / top] * len(levels))
        cov = np.linalg.pinv(left)
        beta = cov @ right
        gg, rss = run(lambda s, level: rounds.moments(s, level, s2, ginv, beta, cov)[1:])
        new_g, new_s2 = gg / whole.g, max(float(rss) / n, 1e-12)
        new_top = float(beta[k:] @ beta[k:] + np.trace(cov[k:, k:])) / len(levels) if levels else top
        moved = np.abs(new_g - g).max() + abs(new_s2 - s2) + abs(new_top - top)
        g, s2, top = new_g, new_s2, max(new_top, 1e-12)
        if moved < 1e-9 * (1 + s2):
            break
    se = np.sqrt(np.diag(cov)[:k])
    z = beta[:k] / se
    fixed = pd.DataFrame({"term": ["(Intercept)", *terms], "estimate": beta[:k], "std_error": se, "statistic": z, "p_value": [erfc_p(v) for v in z]})
    ginv = np.linalg.pinv(g)
    names = [group, "intercept", *random]

    def effects(part: pd.DataFrame) -> pd.DataFrame:
        u = rounds.moments(_stack(part, k), of(part), s2, ginv, beta, cov)[0]
        return pd.concat([part[[group]].reset_index(drop=True), pd.DataFrame(u, columns=names[1:])], axis=1)

    if whole.g <= driver_groups:
        discard(stats)
        return fixed, effects(pdf)
    kinds = ", ".join([f"{group} {stats.schema[group].dataType.simpleString()}", *[f"{x} double" for x in names[1:]]])
    return fixed, stats.mapInPandas(lambda parts: (effects(p) for p in parts if len(p)), kinds)


def _summed(stats: DataFrame, f) -> tuple[np.ndarray, ...]:
    """f of every part of a table, added up: a row of numbers for each task comes to the driver."""

    def run(parts):
        sums = None
        for pdf in parts:
            if len(pdf):
                got = [np.asarray(x, float) for x in f(pdf)]
                sums = got if sums is None else [a + b for a, b in zip(sums, got)]
        if sums is not None:
            yield pd.DataFrame({"i": range(len(sums)), "shape": [list(x.shape) for x in sums], "x": [x.ravel().tolist() for x in sums]})

    rows = stats.mapInPandas(run, "i int, shape array<int>, x array<double>").toPandas()
    return tuple(np.sum([np.array(x) for x in own["x"]], axis=0).reshape(own["shape"].iat[0]) for _, own in rows.groupby("i"))


def journalist_its(
    df: DataFrame, metrics: list[str], journalist: str = "journalist_id", outlet: str = "outlet", outlet_type: str | None = "outlet_type",
    topic: str | None = "predicted_topic", words: str = "total_words", **options,
) -> tuple[DataFrame, dict[str, pd.DataFrame]]:
    """Mixed segmented regressions of every metric: random intercept and time slope per journalist, random intercept per
    outlet, fixed time, intervention, time_after, words, outlet type (if several) and topic.

    Returns the three time terms of all metrics, BH-adjusted within a term over the metrics, with expected direction; and
    the random effects by metric.  Metrics without enough rows are left out."""
    fitted, random = [], {}
    several = lambda c: c and c in df.columns and df.select(c).where(F.col(c).isNotNull()).distinct().limit(2).count() > 1
    kinds = [c for c in (outlet_type, topic) if several(c)]
    for m in metrics:  # a bounded list
        fixed, effects = mixed_model(df, m, [*ITS_TERMS, words], journalist, ["time"], outlet, kinds, **options)
        if len(fixed):
            fitted.append(fixed[fixed["term"].isin(ITS_TERMS)].assign(metric=m))
            random[m] = effects
    schema = "term string, estimate double, std_error double, statistic double, p_value double, metric string"
    out = df.sparkSession.createDataFrame(pd.concat(fitted) if fitted else [], schema)
    return with_direction(benjamini_hochberg(out, "p_value", ["term"])), random


def with_direction(df: DataFrame) -> DataFrame:
    """Expected direction of each metric, whether the estimate has it (null without one), and significance."""
    expected = direction_column("metric")
    match = F.when(expected != 0, F.signum("estimate") == expected)
    sig = F.col("p_adj") < 0.05
    return df.withColumns({"expected_direction": expected, "direction_match": match, "significant": sig, "significant_correct_direction": sig & F.coalesce(match, F.lit(False))})


def outlet_type_its(df: DataFrame, metrics: list[str], journalist: str = "journalist_id", outlet: str = "outlet", outlet_type: str = "outlet_type", base: str = "national", words: str = "total_words", **options) -> DataFrame:
    """Mixed models with interactions of intervention and time_after with the outlet type (``base`` is the base level):
    all fixed terms of every metric, with 95 % intervals.  Random intercepts per journalist and outlet."""
    types = [t for t in sorted(r[0] for r in df.where(F.col(outlet_type).isNotNull()).select(outlet_type).distinct().collect()) if t != base]  # a few
    rows, terms = df.where(F.col(outlet_type).isNotNull()), [*ITS_TERMS, words]
    for t in types:
        own = (F.col(outlet_type) == t).cast("int")
        for name, value in ((f"outlet_type{t}", own), (f"intervention:outlet_type{t}", own * F.col("intervention")), (f"outlet_type{t}:time_after", own * F.col("time_after"))):
            rows, terms = rows.withColumn(name, value), [*terms, name]
    fitted = []
    for m in metrics:  # a bounded list
        fixed, _ = mixed_model(rows, m, terms, journalist, [], outlet, [], **options)
        fitted.append(fixed.assign(metric=m))
    schema = "term string, estimate double, std_error double, statistic double, p_value double, metric string"
    out = df.sparkSession.createDataFrame(pd.concat(fitted) if fitted and sum(map(len, fitted)) else [], schema)
    return out.withColumns({"conf_low": F.col("estimate") - 1.959963984540054 * F.col("std_error"), "conf_high": F.col("estimate") + 1.959963984540054 * F.col("std_error")})


def topic_its(df: DataFrame, metrics: list[str], topic: str = "predicted_topic", outlet: str = "outlet", **options) -> DataFrame:
    """Segmented regressions per outlet and topic over their monthly panel."""
    by = [outlet, topic, "year_month", "time"]
    panel = df.groupBy(*by).agg(F.max("intervention").alias("intervention"), F.max("time_after").alias("time_after"), F.avg("total_words").alias("mean_words"), *[F.avg(m).alias(m) for m in metrics])
    return its(panel, metrics, [outlet, topic], **options)


def detector_analysis(df: DataFrame, score: str, metrics: list[str], outlet: str = "outlet", words: str = "total_words", minimum: int = 100, **options) -> tuple[DataFrame, pd.DataFrame]:
    """Segmented regression of monthly mean detector scores per outlet, and the regression of the score on all metrics
    and words (empty up to ``minimum`` rows)."""
    scored = df.where(F.col(score).isNotNull())
    panel = scored.groupBy(outlet, "year_month", "time").agg(F.max("intervention").alias("intervention"), F.max("time_after").alias("time_after"), F.avg(words).alias("mean_words"), F.avg(score).alias(score))
    check = linear_model(scored, score, [*metrics, words])
    return its(panel, [score], [outlet], **options), check if len(check) and check["n_obs"].iat[0] > minimum else check.iloc[:0]


def homogenization(df: DataFrame, metrics: list[str], outlet: str = "outlet", topic: str | None = None, month: str = "year_month") -> dict[str, DataFrame]:
    """All of the homogenisation analysis: within-group deviations per outlet and month (and per topic), their segmented
    regressions, deviations between outlets per month, and tests of these before against after."""
    keys = [month, "time", "intervention", "time_after"]
    levels = {"outlet": [outlet]} | ({"topic": [outlet, topic]} if topic else {})
    out: dict[str, DataFrame] = {}
    for name, by in levels.items():
        sds = df.groupBy(*by, *keys).agg(F.count("*").alias("n_articles"), *[F.stddev_samp(m).alias(f"sd_{m}") for m in metrics])
        out[f"within_{name}"] = sds
        out[f"its_{name}"] = homogenization_its(sds, [f"sd_{m}" for m in metrics], by)
    means = df.groupBy(outlet, month, "intervention").agg(*[F.avg(m).alias(m) for m in metrics])
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]))
    cross = means.select(month, "intervention", pairs.alias("x")).select(month, "intervention", "x.*").groupBy("metric", month).agg(
        F.count("value").alias("n_outlets"), F.stddev_samp("value").alias("cross_sd"), F.when(F.max("intervention") == 1, "post").otherwise("pre").alias("period"),
    )
    out["between"] = cross.where("n_outlets >= 3")
    out["tests"] = homogenization_tests(out["between"], "cross_sd", "period", ["metric"])
    return out


def negative_binomial(pdf: pd.DataFrame, y: str, terms: list[str], offset: str | None = None, steps: int = 50) -> pd.DataFrame:
    """Log-link negative binomial regression of one small panel by reweighted least squares and moment dispersion."""
    d = pdf.dropna(subset=[y, *terms])
    x = np.column_stack([np.ones(len(d)), d[terms].to_numpy(float)])
    v = d[y].to_numpy(float)
    off = np.log(d[offset].to_numpy(float)) if offset else np.zeros(len(d))
    beta = np.zeros(x.shape[1])
    beta[0] = np.log(max(v.mean(), 1e-9)) - off.mean()
    theta = 1e6
    for _ in range(steps):
        eta = np.clip(x @ beta + off, -30, 30)
        mu = np.exp(eta)
        w = mu / (1 + mu / theta)
        z = eta - off + (v - mu) / mu
        inv = np.linalg.pinv(x.T @ (x * w[:, None]))
        new = inv @ x.T @ (w * z)
        excess = (((v - mu) ** 2 - mu) / mu**2).sum() / max(len(d) - x.shape[1], 1)
        theta = 1 / excess if excess > 1e-9 else 1e6
        if np.abs(new - beta).max() < 1e-9:
            beta = new
            break
        beta = new
    se = np.sqrt(np.diag(inv))
    stat = beta / se
    return pd.DataFrame({"term": ["(Intercept)", *terms], "estimate": beta, "std_error": se, "statistic": stat, "p_value": [erfc_p(s) for s in stat], "theta": theta})


def linear_model(df: DataFrame, y: str, terms: list[str]) -> pd.DataFrame:
    """Ordinary least squares over any number of rows from one row of cross-products."""
    k = len(terms) + 1
    stats = cross_products(df.withColumn("__all", F.lit(1)), y, terms, "__all").toPandas()
    if stats.empty or stats["n"][0] <= k:
        return pd.DataFrame(columns=["term", "estimate", "std_error", "statistic", "p_value", "r_squared", "n_obs"])
    s, n = _stack(stats, k)[0], int(stats["n"][0])
    xx, xy, yy = s[:k, :k], s[:k, k], s[k, k]
    inv = np.linalg.pinv(xx)
    beta = inv @ xy
    rss = max(yy - beta @ xy, 0.0)
    se = np.sqrt(np.maximum(np.diag(inv) * rss / (n - k), 0))
    t = beta / np.where(se > 0, se, np.nan)
    tss = yy - xy[0] ** 2 / n
    return pd.DataFrame({"term": ["(Intercept)", *terms], "estimate": beta, "std_error": se, "statistic": t, "p_value": [t_sf2(v, n - k) if np.isfinite(v) else np.nan for v in t], "r_squared": 1 - rss / tss if tss > 0 else np.nan, "n_obs": int(n)})
