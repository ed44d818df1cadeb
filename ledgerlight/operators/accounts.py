"""Per-account blocks from events: timing, composition, transitions, dates, scale, self-excitation, small signals.

Events are (account, time, tie-break, amount, channel); windows run per account with an explicit order.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import stats
from ..functions.clean import band, days
from . import kernels, ranks


def ordered(account: str, *order: str):
    return Window.partitionBy(account).orderBy(*order)


def timing(events: DataFrame, account: str, t: str, tie: str, periods: tuple[float, ...] = (7.0, 30.44)) -> DataFrame:
    """t in days. Rate, burstiness, variation and spread of gaps, span, share of same-time gaps, rhythms, night share."""
    w = ordered(account, t, tie)
    gaps = events.withColumn("_gap", F.col(t) - F.lag(t).over(w))
    log_gap = F.ln(F.greatest(F.col("_gap"), F.lit(0.0)) + 1)
    rhythm = {p: 2 * math.pi * F.col(t) / p for p in periods}
    hour = F.floor(F.pmod(F.col(t), F.lit(1.0)) * 24)
    a = gaps.groupBy(account).agg(
        F.count("*").alias("n"), F.coalesce(F.avg("_gap"), F.lit(0.0)).alias("m"), F.coalesce(F.stddev_pop("_gap"), F.lit(0.0)).alias("sd"),
        F.coalesce(F.stddev_pop(log_gap), F.lit(0.0)).alias("log_sd"), (F.max(t) - F.min(t)).alias("span"),
        F.coalesce(F.avg((F.col("_gap") <= 0).cast("double")), F.lit(0.0)).alias("same"), F.avg(((hour < 6) | (hour >= 23)).cast("double")).alias("night"),
        *(F.sqrt(F.pow(F.avg(F.cos(x)), 2) + F.pow(F.avg(F.sin(x)), 2)).alias(f"r{k}") for k, x in enumerate(rhythm.values())),
    )
    m, sd = F.col("m"), F.col("sd")
    return a.select(
        account, F.log1p(F.col("n") / F.greatest("span", F.lit(1.0))).alias("tm_log_rate"), ((sd - m) / F.greatest(sd + m, F.lit(stats.EPS))).alias("tm_burstiness"),
        (sd / F.greatest(m, F.lit(stats.EPS))).alias("tm_cv"), F.col("log_sd").alias("tm_log_gap_sd"), F.log1p("span").alias("tm_active_span"), F.col("same").alias("tm_same_day_share"),
        *(F.col(f"r{k}").alias(f"tm_rhythm_{k}") for k in range(len(periods))), F.col("night").alias("tm_night_share"),
    )


def composition(events: DataFrame, account: str, channel: str, amount: str, channels: list[str]) -> DataFrame:
    """Centred log-ratios of channel shares, their entropy, amounts' log mean and spread, largest share, share of round ones.

    channels are frozen when fitted, so that columns do not depend on the batch."""
    a = F.greatest(F.col(amount), F.lit(0.0))
    g = events.groupBy(account).agg(
        F.array(*(F.avg((F.col(channel) == c).cast("double")) for c in channels)).alias("p"), F.avg(F.log1p(a)).alias("log_mean"), F.coalesce(F.stddev_samp(F.log1p(a)), F.lit(0.0)).alias("log_sd"),
        F.max(amount).alias("most"), F.sum(amount).alias("sum"), F.avg((F.col(amount) % 1000 == 0).cast("double")).alias("round"),
    )
    g = g.withColumn("c", stats.clr(F.col("p")))
    return g.select(
        account, *(F.col("c")[k].alias(f"cp_clr_{c}") for k, c in enumerate(channels)), stats.entropy(F.col("p")).alias("cp_channel_entropy"), F.col("log_mean").alias("cp_log_amt_mean"), F.col("log_sd").alias("cp_log_amt_sd"),
        F.least(F.greatest(F.col("most") / F.greatest("sum", F.lit(stats.EPS)), F.lit(0.0)), F.lit(1.0)).alias("cp_max_share"), F.col("round").alias("cp_round_share"),
    )


def transitions(events: DataFrame, account: str, t: str, tie: str, state: str, states: list[str], alpha: float = 0.5) -> DataFrame:
    """account, from_state, to_state, p: smoothed transition shares over the full grid of states."""
    pairs = events.withColumn("_next", F.lead(state).over(ordered(account, t, tie)))
    counts = pairs.groupBy(account).agg(*(F.sum(((F.col(state) == a) & (F.col("_next") == b)).cast("double")).alias(f"n_{i}_{j}") for i, a in enumerate(states) for j, b in enumerate(states)))
    rows = []
    for i, a in enumerate(states):
        total = sum((F.coalesce(F.col(f"n_{i}_{j}"), F.lit(0.0)) + alpha for j in range(len(states))), F.lit(0.0))
        rows += [F.struct(F.lit(a).alias("from_state"), F.lit(b).alias("to_state"), ((F.coalesce(F.col(f"n_{i}_{j}"), F.lit(0.0)) + alpha) / total).alias("p")) for j, b in enumerate(states)]
    return counts.select(account, F.inline(F.array(*rows)))


def transition_features(grid: DataFrame, account: str, n_states: int) -> DataFrame:
    """Share of staying and mean entropy of the rows."""
    return grid.groupBy(account).agg(
        (F.sum(F.when(F.col("from_state") == F.col("to_state"), F.col("p")).otherwise(0.0)) / n_states).alias("dy_self_trans"),
        (-F.sum(F.col("p") * F.ln("p")) / n_states).alias("dy_entropy"),
    )


def scale(events: DataFrame, account: str, amount: str) -> DataFrame:
    return events.groupBy(account).agg(F.log1p(F.count("*")).alias("sc_log_n"), F.log1p(F.sum(F.greatest(F.col(amount), F.lit(0.0)))).alias("sc_log_sum"))


def numeric(events: DataFrame, account: str, columns: list[str]) -> DataFrame:
    return events.groupBy(account).agg(*(F.coalesce(F.avg(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))), F.lit(0.0)).alias(f"nm_{c}") for c in columns))


def dates(rows: DataFrame, account: str, primary: str, others: list[str], as_of: float) -> DataFrame:
    """Recency of each date at as_of (days, frozen when fitted), whether it is missing, its gap to the primary one, seasons."""
    g = rows.groupBy(account).agg(*(F.min(days(F.col(c))).alias(c) for c in [primary, *others]))
    out = [F.col(account)]
    for c in [primary, *others]:
        x = F.col(c)
        out += [F.coalesce(F.log1p(F.greatest(F.lit(as_of) - x, F.lit(0.0))), F.lit(0.0)).alias(f"dt_recency_{c}"), x.isNull().cast("int").alias(f"dt_missing_{c}")]
        if c != primary:
            out.append(F.coalesce(F.log1p(F.greatest(x - F.col(primary), F.lit(0.0))), F.lit(0.0)).alias(f"dt_gap_{c}"))
        for name, p in (("week", 7.0), ("year", 365.25)):
            turn = 2 * math.pi * F.pmod(x, F.lit(p)) / p
            out += [F.coalesce(F.sin(turn), F.lit(0.0)).alias(f"dt_{name}_sin_{c}"), F.coalesce(F.cos(turn), F.lit(0.0)).alias(f"dt_{name}_cos_{c}")]
    return g.select(*out)


def excitation(events: DataFrame, account: str, t: str, tie: str, tau: float) -> DataFrame:
    """Rows with r: the decayed number of earlier events of the account, r_i = exp(-gap / tau) (1 + r_{i-1}).

    In closed form over time slices of 100 tau: a running sum within the slice and one number from the slice
    before, so an account may have any number of events. Rows without a time are left out."""
    span = 100.0 * tau
    e = events.where(F.col(t).isNotNull()).select(account, tie, F.col(t).cast("double").alias("_t")).withColumn("_b", F.floor(F.col("_t") / span))
    x = (F.col("_t") - F.col("_b") * span) / tau
    w = Window.partitionBy(account, "_b").orderBy("_t", tie).rowsBetween(Window.unboundedPreceding, -1)
    # what the slice before gives, as of the start of this one; anything older has decayed by e^-100 and more
    carried = e.groupBy(account, (F.col("_b") + 1).alias("_b")).agg(F.sum(F.exp(x - 100.0)).alias("_c"))
    e = e.withColumn("_x", x).withColumn("_s", F.coalesce(F.sum(F.exp("_x")).over(w), F.lit(0.0)))
    return e.join(carried, [account, "_b"], "left").select(account, tie, ((F.col("_s") + F.coalesce("_c", F.lit(0.0))) / F.exp("_x")).alias("r"))


def em(times: np.ndarray, tau: float, rounds: int = 30) -> tuple[float, float, float]:
    """Background rate, branching ratio and gain in log-likelihood per event over a constant rate, by EM."""
    n, beta = len(times), 1 / tau
    t = np.sort(times)
    span = t[-1] - t[0] if n else 0.0
    if n < 5 or span <= 0:
        return np.nan, np.nan, 0.0
    r = np.zeros(n)
    for i in range(1, n):
        r[i] = math.exp(-beta * (t[i] - t[i - 1])) * (1 + r[i - 1])
    s = np.sum(1 - np.exp(-beta * (t[-1] - t))) / beta
    mu, alpha = n / (2 * span), beta / 2
    for _ in range(rounds):
        own = mu / (mu + alpha * r)
        mu = own.sum() / span
        alpha = min(max((1 - own).sum() / max(s, 1e-12), 0.0), 0.999 * beta)
    ll = np.log(np.maximum(mu + alpha * r, 1e-300)).sum() - mu * span - alpha * s
    return mu, alpha / beta, (ll - (n * math.log(n / span) - n)) / n


def self_excitation(events: DataFrame, account: str, t: str, taus: tuple[float, ...] = (1.0, 7.0, 30.0), prior: float | None = None, strength: float = 8.0) -> DataFrame:
    """Branching ratio (shrunk to the mean of accounts with enough events, or to a frozen prior), background rate and gain per time scale.

    Accounts are fitted one by one in Arrow batches of whole accounts."""
    names = [f"{x}_{k}" for k in range(len(taus)) for x in ("mu", "branch", "gain")]

    def fit(key, rows: pd.DataFrame) -> pd.DataFrame:
        x = rows["t"].to_numpy(float)
        span = max(float(x.max() - x.min()), 1e-9) if len(x) else 1.0
        return pd.DataFrame([[key[0], len(x), len(x) / span, *(v for tau in taus for v in em(x, tau))]], columns=[account, "n", "rate", *names])

    kind = events.schema[account].dataType.simpleString()
    fitted = events.select(account, F.col(t).cast("double").alias("t")).groupBy(account).applyInPandas(fit, f"{account} {kind}, n long, rate double, " + ", ".join(f"{c} double" for c in names))
    fitted = fitted.select(account, "n", "rate", *(F.when(~F.isnan(c), F.col(c)).alias(c) for c in names))
    out = [F.col(account)]
    every = Window.partitionBy()
    for k in range(len(taus)):
        b = F.col(f"branch_{k}")
        mean = F.lit(prior) if prior is not None else F.col(f"_p{k}")
        out += [((F.col("n") * F.coalesce(b, F.lit(0.0)) + strength * mean) / (F.col("n") + strength)).alias(f"hk_branch_{k}"), F.log1p(F.coalesce(f"mu_{k}", "rate")).alias(f"hk_bg_rate_{k}"), F.coalesce(f"gain_{k}", F.lit(0.0)).alias(f"hk_llr_pois_{k}")]
    if prior is None:
        means = fitted.agg(*(F.coalesce(F.avg(f"branch_{k}"), F.lit(0.0)).alias(f"_p{k}") for k in range(len(taus))))
        fitted = fitted.join(F.broadcast(means))
    return fitted.select(*out)


def small_signals(events: DataFrame, account: str, ts: str, tie: str, amount: str) -> DataFrame:
    """Amount and habit features of each account: levels, spikes, spread, night, tiny, round and burst shares, pace, late against early."""
    w = ordered(account, ts, tie)
    a = F.greatest(F.col(amount), F.lit(0.0))
    seconds = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
    gap = seconds - F.lag(seconds).over(w)
    e = events.select(
        account, a.alias("a"), seconds.alias("s"), (F.hour(ts) < 6).cast("double").alias("night"), (a <= 3).cast("double").alias("tiny"),
        ((a >= 50) & (F.abs(a - F.bround(a / 10) * 10) < 0.005)).cast("double").alias("round"), F.coalesce((gap < 3600).cast("double"), F.lit(0.0)).alias("burst"),
        ((F.row_number().over(w) - 1) / F.count("*").over(Window.partitionBy(account)) >= 0.8).alias("late"),
    )
    g = e.groupBy(account).agg(
        F.count("*").alias("n"), F.avg("a").alias("mean"), F.max("a").alias("most"), F.min("a").alias("least"), F.coalesce(F.stddev_samp("a"), F.lit(0.0)).alias("sd"),
        *(F.avg(c).alias(c) for c in ("night", "tiny", "round", "burst")), F.greatest((F.max("s") - F.min("s")) / 86400 / 30, F.lit(1.0)).alias("months"),
        F.avg(F.when(F.col("late"), F.col("a"))).alias("late"), F.avg(F.when(~F.col("late"), F.col("a"))).alias("early"),
    )
    late = F.coalesce(F.ln((F.col("late") + 1) / (F.col("early") + 1)), F.lit(0.0))
    return g.select(
        account, "n", F.log1p("mean").alias("log_avg"), F.ln((F.col("most") + 0.01) / (F.col("mean") + 0.01)).alias("spikiness"), F.ln((F.col("least") + 0.01) / (F.col("mean") + 0.01)).alias("floor"),
        (F.col("sd") / (F.col("mean") + 0.01)).alias("cv"), F.col("night").alias("night_rate"), F.col("tiny").alias("tiny_rate"), F.col("round").alias("round_rate"), F.col("burst").alias("burst_rate"),
        F.ln(F.col("n") / F.col("months")).alias("log_tx_per_month"), late.alias("late_vs_early"),
    )


def mixes(events: DataFrame, account: str, category: str, levels: list[str]) -> DataFrame:
    """account, mix (shares of the levels in order), entropy."""
    g = events.groupBy(account).agg(F.array(*(F.avg((F.col(category) == c).cast("double")) for c in levels)).alias("mix"))
    return g.withColumn("entropy", stats.entropy(F.col("mix")))


def token_degrees(edges: DataFrame, account: str, token: str, most: int | None = None) -> DataFrame:
    """account, degree: other accounts that share a token. Tokens of more than `most` accounts, if given, say nothing and are left out."""
    e = edges.select(account, token).where(F.col(token).isNotNull())
    if most is not None:
        e = e.distinct()
        e = e.join(e.groupBy(token).agg(F.count("*").alias("_n")).where(F.col("_n") <= most).drop("_n"), token)
    degree = kernels.degrees(e.where(F.col(account).isNotNull()).select(F.col(account).alias("a"), F.col(token).alias("t"))).withColumnRenamed("a", account)
    return edges.select(account).distinct().join(degree, account, "left").select(account, F.coalesce("degree", F.lit(0)).alias("degree"))


def new_token_shares(events: DataFrame, account: str, ts: str, tie: str, token: str) -> DataFrame:
    """account, tokens, late_new_share: of late events those with a token first met in the late part."""
    w = ordered(account, ts, tie)
    e = events.withColumn("_pos", (F.row_number().over(w) - 1) / F.count("*").over(Window.partitionBy(account)))
    e = e.withColumn("_first", F.min("_pos").over(Window.partitionBy(account, token)))
    late = F.col("_pos") >= 0.8
    return e.groupBy(account).agg(F.count_distinct(token).alias("tokens"), F.coalesce(F.avg(F.when(late, (F.col("_first") >= 0.8).cast("double"))), F.lit(0.0)).alias("late_new_share"))


def group_residuals(df: DataFrame, key: str, value: str, age: str, group: str) -> DataFrame:
    """key, residual: percentile of value less its median in (group, age band)."""
    e = ranks.with_average_rank(df.where(F.col(value).isNotNull()), value, "_p", share=True).withColumn("_band", band(F.col(age), (0, 25, 35, 45, 55, 65, 200))).withColumn("_g", F.col(group))
    # medians are one row per group: no group is held whole
    middle = e.groupBy("_g", "_band").agg(F.median("_p").alias("_m"))
    same = e["_g"].eqNullSafe(middle["_g"]) & e["_band"].eqNullSafe(middle["_band"])
    return e.join(middle, same).select(key, (F.col("_p") - F.col("_m")).alias("residual"))


def type_surprisal(df: DataFrame, key: str, kind: str, given: str) -> DataFrame:
    """key, surprisal: -ln of the share of its kind within its group."""
    p = F.count("*").over(Window.partitionBy(given, kind)) / F.count("*").over(Window.partitionBy(given))
    return df.withColumn("surprisal", -F.ln(p + 1e-4)).select(key, "surprisal")


def peer_ranks(df: DataFrame, key: str, value: str, levels: list[list[str]], is_ref: str, least: int = 150) -> DataFrame:
    """key, u: mid-rank of value among the references of the finest peer group that has `least` of them.

    levels: groupings from fine to coarse; [] is everybody."""
    out = df
    ref = F.col(is_ref).cast("long")
    for k, g in enumerate(levels):
        # by distinct (group, value); counts up to it in all groups, less those of the groups before
        counts = df.groupBy(*(F.col(c).alias(f"_g{i}") for i, c in enumerate(g)), F.col(value).alias("_v")).agg(F.sum(ref).alias("_c"))
        by = [f"_g{i}" for i in range(len(g))]
        to = ranks.running(counts, [*map(F.col, by), F.col("_v")], {"_to": F.col("_c")})
        of = to.groupBy(*by).agg(F.min(F.col("_to") - F.col("_c")).alias("_before"), F.sum("_c").alias(f"_m{k}"))
        t = to.alias("t").join(of.alias("o"), [F.col(f"t.{c}").eqNullSafe(F.col(f"o.{c}")) for c in by]) if by else to.join(F.broadcast(of))
        hi = F.col("_to") - F.col("_before")
        t = t.select(*(F.col(f"t.{c}") if by else F.col(c) for c in by), "_v", f"_m{k}", (((hi - F.col("_c")) + hi) / 2.0 + 0.5).alias("_h"))
        t = t.withColumn(f"_u{k}", F.col("_h") / (F.col(f"_m{k}") + 1)).drop("_h")
        out = out.join(t, [F.col(value).eqNullSafe(F.col("_v")), *(F.col(c).eqNullSafe(F.col(x)) for c, x in zip(g, by))]).drop("_v", *by)
    u = F.col(f"_u{len(levels) - 1}")
    for k in range(len(levels) - 2, -1, -1):
        u = F.when(F.col(f"_m{k}") >= least, F.col(f"_u{k}")).otherwise(u)
    return out.select(key, u.alias("u"))


def normal_score(u, clip: float = 3.5, least: float = 1e-9):
    """Inverse normal distribution, between -clip and clip; null stays null."""
    z = stats.inverse_normal(F.least(F.greatest(F.col(u) if isinstance(u, str) else u, F.lit(least)), F.lit(1 - least)))
    return F.when(z.isNotNull(), F.least(F.greatest(z, F.lit(-clip)), F.lit(clip)))


def risky_share(events: DataFrame, account: str, category: str, risky: list[str]) -> DataFrame:
    """account, risky_share: the share of its rows in the given categories."""
    return events.groupBy(account).agg(F.avg(F.coalesce(F.col(category).isin(*risky), F.lit(False)).cast("double")).alias("risky_share"))


def transition_log_ratios(grid: DataFrame, account: str, states: list[str]) -> DataFrame:
    """account and dy_clr_<from>__<to>: centred log-ratios of each row of its transitions."""
    rows = grid.groupBy(account, "from_state").agg(F.array(*(F.max(F.when(F.col("to_state") == b, F.col("p"))) for b in states)).alias("p")).withColumn("c", stats.clr(F.col("p"), 1e-9))
    return rows.groupBy(account).agg(*(F.max(F.when(F.col("from_state") == a, F.col("c")[j])).alias(f"dy_clr_{a}__{b}") for a in states for j, b in enumerate(states)))


def spend_ratios(per: DataFrame, account: str, total: str, most: str, income: str, opened: str | None = None, as_of: str | None = None) -> DataFrame:
    """account, spend_to_income, max_to_income (log ratios) and, with opened, account_age in days at as_of."""
    i = F.greatest(F.coalesce(F.col(income).cast("double"), F.lit(0.0)), F.lit(1.0))
    out = [F.ln((F.col(total) + 1) / i).alias("spend_to_income"), F.ln((F.col(most) + 1) / i).alias("max_to_income")]
    if opened is not None:
        out.append(F.greatest(F.datediff(F.lit(as_of).cast("date"), F.col(opened)), F.lit(0)).alias("account_age"))
    return per.select(account, *out)
