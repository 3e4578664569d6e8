"""Residuals, counterfactuals, change points and sequential confirmation."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def standardised(metrics: DataFrame, onset: int) -> DataFrame:
    """Each metric against its mean and deviation before the onset; missing values are that mean, so nothing later leaks in."""
    w = Window.partitionBy("case_id", "metric")
    before = F.when(F.col("ts") < onset, F.nanvl(F.col("value"), F.lit(None).cast("double")))
    mu, sd = F.avg(before).over(w), F.stddev_pop(before).over(w)
    sd = F.when(F.coalesce(sd, F.lit(0.0)) < 1e-6, 1.0).otherwise(sd)
    return metrics.select("case_id", "entity", "metric", "ts", F.coalesce((F.nanvl(F.col("value"), F.lit(None).cast("double")) - mu) / sd, F.lit(0.0)).alias("y"))


def ridge_residuals(metrics: DataFrame, edges: DataFrame, onset: int, penalty: float = 1.0, early: float = 0.4) -> DataFrame:
    """(case_id, entity, mean_z, max_z, early_share): residuals of each metric given the mean signal of its entity's callers.

    With one regressor the ridge fit is a ratio of sums, so all of it is aggregates: fitted before the onset, intercept free,
    residuals over their own deviation there.  An entity without callers is compared with its mean.
    """
    s = standardised(metrics, onset)
    signal = s.groupBy("case_id", "entity", "ts").agg(F.avg("y").alias("e"))
    callers = edges.select(F.col("case_id").alias("_c"), F.col("src").alias("_s"), F.col("dst").alias("_d")).where("_s <> _d").distinct()
    x = signal.join(callers, (F.col("case_id") == F.col("_c")) & (F.col("entity") == F.col("_s"))).groupBy(F.col("_c").alias("case_id"), F.col("_d").alias("entity"), "ts").agg(F.avg("e").alias("x"))
    xy = s.join(x, ["case_id", "entity", "ts"], "left").withColumn("x", F.coalesce("x", F.lit(0.0)))
    w = Window.partitionBy("case_id", "metric")
    pre = lambda c: F.when(F.col("ts") < onset, c)
    n, sx, sy = F.count(pre(F.col("x"))).over(w), F.sum(pre(F.col("x"))).over(w), F.sum(pre(F.col("y"))).over(w)
    sxx, sxy = F.sum(pre(F.col("x") * F.col("x"))).over(w), F.sum(pre(F.col("x") * F.col("y"))).over(w)
    fit = xy.withColumns({"_n": n, "_sx": sx, "_sy": sy, "_sxx": sxx, "_sxy": sxy}).where("_n > 0")
    slope = (F.col("_sxy") - F.col("_sx") * F.col("_sy") / F.col("_n")) / (F.col("_sxx") - F.col("_sx") * F.col("_sx") / F.col("_n") + penalty)
    res = fit.withColumn("_b", slope).withColumn("_r", F.col("y") - (F.col("_sy") / F.col("_n") + F.col("_b") * (F.col("x") - F.col("_sx") / F.col("_n"))))
    z = F.abs("_r") / (F.coalesce(F.stddev_pop(pre(F.col("_r"))).over(w), F.lit(0.0)) + 1e-6)
    last = F.max("ts").over(Window.partitionBy("case_id"))
    inc = res.withColumns({"_z": z, "_last": last}).where(F.col("ts") >= onset)
    first = F.col("ts") < onset + (F.col("_last") - onset) * early
    return inc.groupBy("case_id", "entity").agg(F.round(F.avg("_z"), 6).alias("mean_z"), F.round(F.max("_z"), 6).alias("max_z"), F.round(F.coalesce(F.try_divide(F.sum(F.when(first, F.col("_z")).otherwise(0.0)), F.sum("_z")), F.lit(0.0)), 6).alias("early_share"))


def entity_signals(metrics: DataFrame, onset: int) -> DataFrame:
    """(case_id, ts, entity, signal): mean standardised metric of every entity and step."""
    return standardised(metrics, onset).groupBy("case_id", "ts", "entity").agg(F.avg("y").alias("signal"))


def topological(nodes: Sequence[str], parents: dict[str, list[str]]) -> list[str]:
    """Parents before children, by name among the free; what lies on cycles comes last, by name."""
    left, done = {n: set(parents.get(n, ())) & set(nodes) for n in nodes}, []
    while free := sorted(n for n, p in left.items() if not p):
        take = free[0]
        done.append(take)
        del left[take]
        for p in left.values():
            p.discard(take)
    return done + sorted(left)


def counterfactual_relief(metrics: DataFrame, edges: DataFrame, onset: int, target: str, penalty: float = 1e-5) -> DataFrame:
    """(case_id, entity, relief): how much closer to normal the target would be without the entity's own disturbance.

    Every entity is a ridge-fitted linear function of its callers, fitted before the onset; the entity's residual is set to
    its mean and the change goes down in topological order.  It is one grouped map per case: a case is a fixed window
    of steps and some dozens of entities, a matrix of bounded size.
    """
    sig = entity_signals(metrics, onset)
    pack = sig.groupBy("case_id", "ts").agg(F.map_from_entries(F.collect_list(F.struct("entity", "signal"))).alias("signals"))
    graph = edges.where("src <> dst").groupBy("case_id").agg(F.collect_set(F.struct("src", "dst")).alias("edges"))
    joined = pack.join(graph, "case_id", "left")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts")
        names = sorted({k for m in pdf["signals"] for k in dict(m)})
        x = np.array([[dict(m).get(k, 0.0) for k in names] for m in pdf["signals"]])
        es = pdf["edges"].iloc[0]
        parents: dict[str, list[str]] = {n: [] for n in names}
        for e in es if es is not None else []:
            a, b = (e["src"], e["dst"]) if isinstance(e, dict) else (e[0], e[1])
            if a in parents and b in parents:
                parents[b].append(a)
        pre = (pdf["ts"] < onset).to_numpy()
        order, at = topological(names, parents), {n: i for i, n in enumerate(names)}
        beta, mean, resid = {}, {}, {}
        for n in names:
            ps = [at[p] for p in sorted(parents[n])]
            y, xs = x[:, at[n]], x[:, ps]
            my, mx = y[pre].mean() if pre.any() else 0.0, xs[pre].mean(0) if pre.any() else np.zeros(len(ps))
            b = np.linalg.solve((xs[pre] - mx).T @ (xs[pre] - mx) + penalty * np.eye(len(ps)), (xs[pre] - mx).T @ (y[pre] - my)) if ps else np.zeros(0)
            beta[n], mean[n] = (ps, b, mx), my
            resid[n] = y - (my + (xs - mx) @ b if ps else my)
        rows = []
        t = at.get(target)
        for c in names:
            if t is None:
                break
            cf = x.copy()
            place = {n: i for i, n in enumerate(order)}
            for n in order[place[c] :]:
                ps, b, mx = beta[n]
                base = mean[n] + ((cf[:, ps] - mx) @ b if ps else 0.0)
                cf[:, at[n]] = base + (resid[n][pre].mean() if n == c and pre.any() else 0.0 if n == c else resid[n])
            y, mu = x[:, t], x[pre, t].mean() if pre.any() else 0.0
            sd = max(x[pre, t].std() if pre.any() else 0.0, 1e-6)
            gain = (np.abs(y - mu) - np.abs(cf[:, t] - mu))[~pre] / sd
            rows.append((pdf["case_id"].iloc[0], c, round(float(gain.mean()) if len(gain) else 0.0, 6)))
        return pd.DataFrame(rows, columns=["case_id", "entity", "relief"])

    return joined.groupBy("case_id").applyInPandas(run, "case_id string, entity string, relief double")


def bocpd(x: np.ndarray, hazard: float = 100.0, warmup: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(most likely run length, probability of a run of at most 2) after each row.

    Normal-Wishart for every run length with rank-one updates of inverse and determinant, Student-t prediction, constant hazard.
    Rows are standardised by the warm-up; missing values are its mean.
    """
    t_n, d = x.shape
    base = x[:warmup]
    mu = np.nan_to_num(np.nanmean(base, 0)) if len(base) else np.zeros(d)
    sd = np.nan_to_num(np.nanstd(base, 0)) if len(base) else np.ones(d)
    z = np.nan_to_num((x - mu) / np.where(sd < 1e-6, 1.0, sd))
    kappa, nu = np.ones(1), np.full(1, d + 1.0)
    m, inv, logdet = np.zeros((1, d)), np.eye(d)[None], np.zeros(1)
    logp = np.zeros(1)
    lg = np.vectorize(math.lgamma)
    best, short = np.zeros(t_n, int), np.zeros(t_n)
    for t in range(t_n):
        dof = nu - d + 1
        diff = z[t] - m
        quad = np.einsum("ri,rij,rj->r", diff, inv, diff)
        scale = (kappa + 1) / kappa
        pred = lg((dof + d) / 2) - lg(dof / 2) - 0.5 * d * np.log(math.pi) - 0.5 * (logdet + d * np.log(scale)) - 0.5 * (dof + d) * np.log1p(quad / scale)
        joint = logp + pred
        grown = joint + math.log(1 - 1 / hazard)
        top = joint.max()
        fresh = top + math.log(np.exp(joint - top).sum()) + math.log(1 / hazard)
        new = np.concatenate(([fresh], grown))
        new -= new.max()
        new -= math.log(np.exp(new).sum())
        # Rank-one update of every run's scatter, then the prior for the run that starts here.
        c = kappa / (kappa + 1)
        iv = np.einsum("rij,rj->ri", inv, diff)
        den = 1 + c * quad
        inv2 = inv - (c / den)[:, None, None] * np.einsum("ri,rj->rij", iv, iv)
        logdet2, m2 = logdet + np.log(den), (kappa[:, None] * m + z[t]) / (kappa + 1)[:, None]
        kappa, nu = np.concatenate(([1.0], kappa + 1)), np.concatenate(([d + 1.0], nu + 1))
        m, inv, logdet = np.concatenate((np.zeros((1, d)), m2)), np.concatenate((np.eye(d)[None], inv2)), np.concatenate(([0.0], logdet2))
        logp = new
        best[t], short[t] = int(np.argmax(new)), float(np.exp(new[:3]).sum())
    return best, short


def bocpd_onsets(metrics: DataFrame, hazard: float = 100.0, warmup: int = 60, threshold: float = 0.5) -> DataFrame:
    """(case_id, onset_ts, rule): the first jump of the most likely run length with a short run at least as likely as the threshold.

    Without such a jump, the first step with a likely short run; else null.  The recursion is sequential: one grouped map per
    case, whose matrix of steps and metrics is bounded by the case's window; metrics are in order of name.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot_table(index="ts", columns="metric", values="value", aggfunc="first", dropna=False).sort_index()
        wide = wide[sorted(wide.columns)]
        best, short = bocpd(wide.to_numpy(dtype=float), hazard, warmup)
        jump = np.abs(np.diff(best, prepend=best[:1])) > 1
        late = np.arange(len(best)) >= warmup
        for rule, hit in (("jump", jump & late & (short >= threshold)), ("short_run", late & (short >= threshold))):
            if hit.any():
                return pd.DataFrame([(pdf["case_id"].iloc[0], int(wide.index[int(np.argmax(hit))]), rule)], columns=["case_id", "onset_ts", "rule"])
        return pd.DataFrame({"case_id": [pdf["case_id"].iloc[0]], "onset_ts": pd.array([None], "Int64"), "rule": ["none"]})

    return metrics.select("case_id", "ts", "metric", "value").groupBy("case_id").applyInPandas(run, "case_id string, onset_ts bigint, rule string")


def sequential_confirmation(steps: DataFrame, edges: DataFrame, horizon_s: int = 60, need: int = 3) -> DataFrame:
    """(case_id, suspect_ts, confirmed_ts, entities): normal, suspect, confirmed.

    The first entity in an episode, by name, is suspected; in every step at most one more joins, by name: in an episode, with an
    onset strictly later than a suspect's, over an edge that is visible by then.  ``need`` suspects of which one is active
    confirm, judged before the step's own addition; no activity for over ``horizon_s`` seconds starts anew.  The automaton is sequential
    in time, so it is a grouped map over the steps that have activity; a case has a bounded window.
    """
    act = steps.where("in_episode").select("case_id", "ts", "entity", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("other"))
    # Edges enter the timeline at the moment from which they can be seen.
    seen = edges.select("case_id", F.ceil(F.col("first_visible_us") / 1_000_000).cast("bigint").alias("ts"), F.col("src").alias("entity"), F.lit(-1).alias("kind"), F.col("dst").alias("other"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        near: dict[str, set[str]] = {}
        onset: dict[str, int] = {}
        last_in: dict[str, int] = {}
        suspects: list[str] = []
        since = last = None
        case = pdf["case_id"].iloc[0]
        for ts, g in pdf.sort_values(["ts", "kind", "entity"]).groupby("ts", sort=True):
            for r in g[g["kind"] < 0].itertuples():
                near.setdefault(r.entity, set()).add(r.other)
                near.setdefault(r.other, set()).add(r.entity)
            active = sorted(g.loc[g["kind"] == 0, "entity"])
            if not active:
                continue
            for e in active:
                if e not in last_in:
                    onset.setdefault(e, int(ts))
                last_in[e] = int(ts)
            if suspects and ts - last > horizon_s and not set(active) & set(suspects):
                suspects, since, onset, last_in = [], None, {e: int(ts) for e in active}, {e: int(ts) for e in active}
            if not suspects:
                suspects, since, last = [active[0]], int(ts), int(ts)
                continue
            alive = bool(set(active) & set(suspects))
            if alive:
                last = int(ts)
            if alive and len(suspects) >= need:
                return pd.DataFrame([(case, since, int(ts), ",".join(sorted(suspects)))], columns=["case_id", "suspect_ts", "confirmed_ts", "entities"])
            for e in active:
                if e not in suspects and any(e in near.get(s, ()) and onset[e] > onset[s] for s in suspects):
                    suspects.append(e)
                    break
        return pd.DataFrame({"case_id": [case], "suspect_ts": pd.array([since], "Int64"), "confirmed_ts": pd.array([None], "Int64"), "entities": [",".join(sorted(suspects))]})

    return act.unionByName(seen).groupBy("case_id").applyInPandas(run, "case_id string, suspect_ts bigint, confirmed_ts bigint, entities string")
