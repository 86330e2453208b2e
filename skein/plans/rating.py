"""Queries of the rating operators, batch and online."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators import calibrate, fit, models, online, ratings, trees
from skein.plans import inputs
from skein.plans.inputs import HELD, RATINGS, SPLIT, STREAM
from skein.plans.registry import Registry
from skein.sources import text
from skein.stage import read, stage, stage_bucketed
from skein.streaming import online as streaming

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles
MU = 2.5
ENDS = "ends as (select avg(rating) as mu, min(rating) as low, max(rating) as high from fit)"


def _split(spark, d, by=None):
    """Rows to fit and held ones; ``by`` names the id that they are laid out by."""
    rows = stage_bucketed(inputs.ratings(spark, d, by), by) if by else stage(inputs.ratings(spark, d))
    return inputs.fit(rows), inputs.held(rows)


def _out(df, *names):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes if not names or c in names])


@query(f"with {RATINGS} select 'user' as side, u as id, count(*) as n from ratings group by u union all select 'item', i, count(*) from ratings group by i")
def rate_counts(spark, d):
    return ratings.counts(inputs.ratings(spark, d))


@query(f"""with {SPLIT}, f as (select count(distinct u) as users, count(distinct i) as items, count(*) as n, min(rating) as low, max(rating) as high, round(avg(rating), 6) as mean from fit)
select f.*, round(1 - n / (users * items), 6) as sparsity, (select count(distinct u) from held) as request_users, (select count(*) from held) as requests from f""")
def rate_stats(spark, d):
    return _out(ratings.stats(*_split(spark, d)))


@query(f"with {RATINGS} select cast(round_even(rating, 0) as int) as value, count(*) as n from ratings group by 1")
def rate_hist(spark, d):
    return ratings.histogram(inputs.ratings(spark, d))


@query(f"""with {RATINGS}, h as (select cast(round_even(rating, 0) as int) as v, count(*) as n from ratings group by 1)
select (select count(*) from ratings) as n, (select string_agg(v || ':' || n, ',' order by v) from h) as histogram""")
def rate_describe(spark, d):
    rows = stage(inputs.ratings(spark, d))
    h = ratings.histogram(rows).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("value", "n")))).alias("m"))
    joined = F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string"))), ",")
    return rows.agg(F.count("*").alias("n")).crossJoin(h.select(joined.alias("histogram")))  # one row each


@query(f"""with {SPLIT}, nu as (select u, count(*) as nu from fit group by u), ni as (select i, count(*) as ni from fit group by i)
select count(*) as pairs, count(*) filter (nu is null) as new_user_pairs, count(*) filter (ni is null) as new_item_pairs, count(*) filter (nu is not null and ni is not null) as known_pairs,
min(nu) as least_user, max(nu) as most_user, min(ni) as least_item, max(ni) as most_item, count(*) filter (nu <= 20) as user_le_20, count(*) filter (nu <= 50) as user_le_50,
count(*) filter (nu <= 100) as user_le_100, count(*) filter (ni <= 1) as item_le_1, count(*) filter (ni <= 5) as item_le_5
from held left join nu using (u) left join ni using (i)""")
def rate_coverage(spark, d):
    return ratings.coverage(*_split(spark, d))


@query(f"with {RATINGS} select u, i, (u * 7919 + i * 104729) % 10000 < 2500 as validation from ratings")
def rate_split(spark, d):
    a, b = ratings.split(inputs.ratings(spark, d), 0.25)
    return a.select("u", "i", F.lit(True).alias("validation")).unionByName(b.select("u", "i", F.lit(False).alias("validation")))


@query(f"with {SPLIT} select round(sqrt(avg(pow((select avg(rating) from fit) - rating, 2))), 6) as rmse, count(*) as n from held")
def eval_rmse(spark, d):
    f, h = _split(spark, d)
    mean = f.agg(F.avg("rating").alias("score"))
    return _out(ratings.rmse(ratings.disjoint(f, h).crossJoin(F.broadcast(mean))))


def bias_sql(rounds: int, shrink: float = 5.0) -> str:
    parts = [f"with {SPLIT}", ENDS]
    for k in range(rounds):
        left = "select u, rating - mu as e from fit, ends" if k == 0 else f"select fit.u, rating - mu - bi as e from fit join bi{k - 1} using (i), ends"
        parts.append(f"bu{k} as materialized (select u, sum(e) / ({shrink}::double + count(*)) as bu from ({left}) t group by u)")
        parts.append(f"bi{k} as materialized (select i, sum(rating - mu - bu) / ({shrink}::double + count(*)) as bi from fit join bu{k} using (u), ends group by i)")
    last = rounds - 1
    parts.append(f"base as (select held.u, held.i, rating, greatest(low, least(high, mu + coalesce(bu, 0) + coalesce(bi, 0))) as score from held left join bu{last} using (u) left join bi{last} using (i), ends)")
    return ", ".join(parts)


def _bias(spark, d, rounds=3, by=None):
    f, h = _split(spark, d, by)
    return f, h, models.bias_tables(f, 5.0, rounds)


@query(bias_sql(3) + " select u, i, round(score, 6) as score from base")
def bias_baseline(spark, d):
    _, h, bias = _bias(spark, d)
    return _out(models.score_bias(h, *bias), "u", "i", "score")


MEANS = ", mu_i as (select i, avg(rating) as m from fit group by i), other as (select held.u, held.i, coalesce(m, mu) as score from held left join mu_i using (i), ends)"


def _means(f, h, ends):
    m = f.groupBy("i").agg(F.avg("rating").alias("m"))
    return h.join(m, "i", "left").select("u", "i", F.coalesce("m", F.lit(ends[0])).alias("score"))


@query(bias_sql(1) + MEANS + """ select base.u, base.i, round(greatest(low, least(high, 0.7 * base.score + 0.3 * greatest(low, least(high, other.score)))), 6) as score
from base join other on base.u = other.u and base.i = other.i, ends""")
def blend(spark, d):
    f, h, bias = _bias(spark, d, 1)
    return _out(models.blend(models.score_bias(h, *bias), _means(f, h, bias[2]), 0.3, bias[2]))


@query(bias_sql(1) + MEANS + """ select base.u, base.i, round(greatest(low, least(high, 0.9 * base.score - 0.2 * other.score + 0.3 * mu + 0.1)), 6) as score
from base join other on base.u = other.u and base.i = other.i, ends""")
def weighted_ensemble(spark, d):
    f, h, bias = _bias(spark, d, 1)
    flat = h.select("u", "i", F.lit(bias[2][0]).alias("score"))
    return _out(models.ensemble([(0.9, models.score_bias(h, *bias)), (-0.2, _means(f, h, bias[2])), (0.3, flat)], bias[2], 0.1))


def profile_sql(key: str) -> str:
    return f"""select {key}, count(*) as n, avg(rating) as mean, var_pop(rating) as variance, quantile_cont(rating, 0.5) as median, quantile_cont(rating, 0.75) - quantile_cont(rating, 0.25) as iqr,
min(rating) as low, max(rating) as high, case when var_pop(rating) > 1e-12 then (avg(rating ** 3) - 3 * avg(rating) * avg(rating ** 2) + 2 * avg(rating) ** 3) / (sqrt(var_pop(rating)) ** 3 + 1e-9) else 0.0 end as skewness
from fit group by {key}"""


@query(f"""with {SPLIT}, p as ({profile_sql('i')}) select i, n, round(mean, 6) as mean, round(variance, 6) as variance, round(median, 6) as median, round(iqr, 6) as iqr, low, high, round(skewness, 5) as skewness from p""")
def entity_profile(spark, d):
    f, _ = _split(spark, d)
    return _out(ratings.profile(f, "i").withColumn("skewness", F.round("skewness", 5)))


FEATURES = {
    "pred": "base.score", "log_uc": "ln(1 + un)", "inv_ic": "1 / sqrt(inn + 1)", "umean_g": "um - mu", "mean_inter": "(um - mu) * (im - mu) / 100", "ivar": "iv", "std_sum": "sqrt(uv) + sqrt(iv)",
    "iqr_diff": "uq - iq", "urange": "uh - ul", "ic_le_15": "case when inn <= 15 then 1.0 else 0.0 end", "uc_gt_50": "case when un > 50 then 1.0 else 0.0 end", "pred_mid_40_60": "case when base.score >= 40 and base.score < 60 then 1.0 else 0.0 end",
    "pred_bin_2": "case when floor(base.score / 10) = 2 then 1.0 else 0.0 end", "pred3": "base.score ** 3 / 10000", "base_minus_imed": "(base.score - imed) / 100", "log_uc_log_ic2": "ln(1 + un) * ln(1 + inn) ** 2",
    "pred_std_abs_diff": "base.score * abs(sqrt(uv) - sqrt(iv)) / 100", "inv_uc_imean_g": "1 / sqrt(un + 1) * (im - mu)", "pred_center2": "(base.score - mu) ** 2 / 100", "uc30_ic15": "case when un <= 30 and inn <= 15 then 1.0 else 0.0 end",
}
_P = f""", pu as ({profile_sql('u')}), pi as ({profile_sql('i')}), wide as (select base.u, base.i, base.score, mu, low, high, coalesce(pu.n, 0) as un, coalesce(pi.n, 0) as inn, coalesce(pu.mean, mu) as um, coalesce(pi.mean, mu) as im,
coalesce(pu.variance, 0) as uv, coalesce(pi.variance, 0) as iv, coalesce(pu.iqr, 0) as uq, coalesce(pi.iqr, 0) as iq, coalesce(pi.median, mu) as imed, coalesce(pu.high, mu) as uh, coalesce(pu.low, mu) as ul
from base left join (select u, n, mean, variance, iqr, median, high, low from pu) pu on pu.u = base.u left join (select i, n, mean, variance, iqr, median from pi) pi on pi.i = base.i, ends)"""


@query((bias_sql(1) + _P.replace("mu, low, high, coalesce(pu.n", "mu, coalesce(pu.n") + " select u, i, " + ", ".join(f"cast(round(({v.replace('base.', '')}) + 1e-9, 5) as double) + 0.0 as {k}" for k, v in FEATURES.items()) + " from wide"))
def feature_values(spark, d):
    """A choice of the calibration features, by value."""
    f, h, bias = _bias(spark, d, 1)
    known = calibrate.features(bias[2][0])
    wide = calibrate.joined_profiles(models.score_bias(h, *bias).select("u", "i", "score"), f)
    return wide.select("u", "i", *[(F.round(known[k] + 1e-9, 5) + 0.0).alias(k) for k in FEATURES])


COEFFICIENTS = {k: (0.9 if k == "pred" else 0.002 * (n % 5 - 2)) for n, k in enumerate(FEATURES)}


@query(bias_sql(1) + _P.replace("mu, low, high, coalesce(pu.n", "mu, ends.low as lo, ends.high as hi, coalesce(pu.n") + " select u, i, round(greatest(lo, least(hi, 1.5 + " + " + ".join(f"({v.replace('base.', '')}) * {COEFFICIENTS[k]}" for k, v in FEATURES.items()) + ")), 5) as score from wide")
def feature_calibrate(spark, d):
    f, h, bias = _bias(spark, d, 1)
    base = models.score_bias(h, *bias).select("u", "i", "score")
    return calibrate.calibrate(base, f, COEFFICIENTS, 1.5, bias[2]).select("u", "i", F.round("score", 5).alias("score"))


@query()
def feature_calibrate_all(spark, d):
    """The sum of all 222 features with small coefficients."""
    f, h, bias = _bias(spark, d, 1)
    names = list(calibrate.features(0.0))
    base = models.score_bias(h, *bias).select("u", "i", "score")
    return calibrate.calibrate(base, f, {k: (0.9 if k == "pred" else 1e-5 * (n % 7 - 3)) for n, k in enumerate(names)}, 1.0, bias[2])


KNN = """, res as materialized (select fit.u, fit.i, rating - greatest(low, least(high, mu + coalesce(bu, 0) + coalesce(bi, 0))) as e from fit left join bu0 using (u) left join bi0 using (i), ends ),
norms as (select u, sqrt(sum(e * e)) as n from res group by u), sim as materialized (select a.u, b.u as v, sum(a.e * b.e) / (max(x.n) * max(y.n) + 1e-6) as s
from res a join res b on a.i = b.i and a.u <> b.u join norms x on x.u = a.u join norms y on y.u = b.u group by a.u, b.u),
ranked as (select h.u, h.i, s, e, row_number() over (partition by h.u, h.i order by round(abs(s), 9) desc, v) as n from base h join res on res.i = h.i and res.u <> h.u join sim on sim.u = h.u and sim.v = res.u),
change as (select u, i, sum(s * e) / (sum(abs(s)) + 1.0) as c from ranked where n <= 10 group by u, i)"""


@query(bias_sql(1) + KNN + " select base.u, base.i, round(greatest(low, least(high, score + coalesce(c, 0))), 5) as score from base left join change using (u, i), ends")
def user_knn_all(spark, d):
    """Every request, from residuals of every fitted rating."""
    f, h, bias = _bias(spark, d, 1, by="u")
    return models.user_knn(h, f, 10, 1.0, bias).select("u", "i", F.round("score", 5).alias("score"))


@query()
def mf_als(spark, d):
    """RMSE on rows that weren't fitted: bias model, then with factors by alternating least squares."""
    f, h, bias = _bias(spark, d, by="u")
    base = ratings.rmse(models.score_bias(ratings.disjoint(f, h), *bias)).select(F.lit("bias").alias("model"), F.round("rmse", 4).alias("rmse"))
    scored = models.als_scores(h, f, weight=0.5, keep=("rating",))
    return base.unionByName(ratings.rmse(scored).select(F.lit("als").alias("model"), F.round("rmse", 4).alias("rmse")))


@query()
def mf_sgd(spark, d):
    """Scores of factors by gradient descent in strata of blocks."""
    f, h = _split(spark, d)
    return models.score_factors(h, models.sgd_factors(f, epochs=2, blocks=3), models.limits(f))


@query()
def residual_mf(spark, d):
    """The bias model with factors of what it leaves, by gradient descent."""
    f, h, bias = _bias(spark, d, 1, by="u")
    return models.residual_factors(h, f, bias, 0.5, epochs=2, blocks=3)


@query(f"with {SPLIT} select u, u || '|' || count(*) || chr(10) || string_agg(i || ' ' || cast(cast(round_even(rating, 0) as bigint) as varchar), chr(10) order by i) as value from held group by u")
def sink_predictions_grouped(spark, d):
    _, h = _split(spark, d)
    return text.prediction_text(h.select("u", F.col("i").alias("pos"), "i", F.col("rating").alias("score")))


@query(f"with {STREAM} select pos // 1000 as batch, count(*) as n, min(pos) as first, max(pos) as last from stream group by 1")
def on_batching(spark, d):
    return inputs.stream(spark, d).groupBy(online.batch_of(F.col("pos"), 1000).alias("batch")).agg(F.count("*").alias("n"), F.min("pos").alias("first"), F.max("pos").alias("last"))


def state_sql(key: str, stride: int, phase: int, scale: int = 1, where: str = "true") -> str:
    return f"select {key}, sum((rating - {MU}) * {scale}) as s, count(*) * {scale} as n from stream where pos % {stride} = {phase} and {where} group by {key}"


USERS, ITEMS = state_sql("u", 10, 0), state_sql("i", 4, 2, 4)
#: Numbers of the published score. Fixed values.
SCORE = {"intercept": 3.29021835, "log_user": 0.00526042003, "log_item": 0.0137246884, "root_user": 0.156752408, "root_item": 0.143476963, "user_weight": 1.15040135, "item_weight": 0.881480813, "user_shrink": 20.0, "item_shrink": 5.0}
P = online.Scoring(mean=MU, low=0.0, high=5.0, **SCORE)
SHARED = f"with {STREAM}, us as ({USERS}), its as ({ITEMS}), req as (select u, i, rating, pos from stream)"


def component_sql(s: str, n: str, p: tuple) -> str:
    return f"({p[0]} * ln(1 + coalesce({n}, 0)) + {p[1]} / sqrt(coalesce({n}, 0) + 1.0::double) + case when coalesce({n}, 0) > 0 then {p[2]} * {s} / ({n} + {p[3]}) else 0 end)"


CU = component_sql("us.s", "us.n", (P.log_user, P.root_user, P.user_weight, P.user_shrink))
CI = component_sql("its.s", "its.n", (P.log_item, P.root_item, P.item_weight, P.item_shrink))
JOINED = " from req left join us on us.u = req.u left join its on its.i = req.i"


def _requests(spark, d):
    return inputs.stream(spark, d).select("u", "i", "rating", "pos")


@query(f"with {STREAM} select 'u' as side, u as id, round(s, 6) as s, n from ({USERS}) t union all select 'i', i, round(s, 6), n from ({ITEMS}) t")
def on_update_sampled(spark, d):
    u, i = online.fit_states(inputs.stream(spark, d), P)
    both = u.select(F.lit("u").alias("side"), F.col("u").alias("id"), "s", "n").unionByName(i.select(F.lit("i").alias("side"), F.col("i").alias("id"), "s", "n"))
    return _out(both)


@query(f"with {STREAM} select u, round(sum(rating - {MU}), 6) as s, count(*) as n from (select *, row_number() over (partition by pos // 999 order by pos) - 1 as k from stream) t where k % 2 = 0 group by u")
def on_update_fallback(spark, d):
    return _out(online.fallback_user_state(inputs.stream(spark, d), MU, 999))


@query(f"with {STREAM}, us as ({USERS}) select u, round({CU}, 6) as component from us")
def on_user_component(spark, d):
    u, _ = online.fit_states(inputs.stream(spark, d), P)
    return u.select("u", F.round(online.component(F.col("n"), F.col("s"), P.log_user, P.root_user, P.user_weight, P.user_shrink), 6).alias("component"))


@query(f"with {STREAM}, its as ({ITEMS}) select i, round({CI}, 6) as component from its")
def on_item_component(spark, d):
    _, i = online.fit_states(inputs.stream(spark, d), P)
    return i.select("i", F.round(online.component(F.col("n"), F.col("s"), P.log_item, P.root_item, P.item_weight, P.item_shrink), 6).alias("component"))


THRESHOLDS, VALUES = (20.0, 50.0, 90.0, 120.0), (0.1, -0.2, 0.0, 0.3, -0.1)
SEGMENT = "case " + " ".join(f"when req.u <= {t} then {v}" for t, v in zip(THRESHOLDS, VALUES)) + f" else {VALUES[-1]} end"


@query(f"with {STREAM}, req as (select distinct u from stream) select u, cast({SEGMENT} as double) as value from req")
def on_segment_prior(spark, d):
    return inputs.stream(spark, d).select("u").distinct().select("u", online.segment(F.col("u"), THRESHOLDS, VALUES).alias("value"))


@query(SHARED + f""", cuts as (select i as threshold, avg(rating - {MU}) as value from stream group by i), ids as (select distinct u from stream)
select u, round(coalesce(value, 0.5), 6) as value from ids asof left join cuts on ids.u > cuts.threshold""")
def on_segment_join(spark, d):
    """As many segments as there are items: users' ids fall between the items' ids, whose mean residuals are the values."""
    stream = inputs.stream(spark, d)
    cuts = stage(stream.groupBy(F.col("i").alias("threshold")).agg(F.avg(F.col("rating") - MU).alias("value")))
    return _out(online.segment_join(stream.select("u").distinct(), cuts, "u", 0.5))


@query(SHARED + f" select pos, round(greatest(0.0, least(5.0, {P.intercept} + {SEGMENT} + {CU} + {CI})), 6) as score" + JOINED)
def on_predict(spark, d):
    p = online.Scoring(mean=MU, low=0.0, high=5.0, thresholds=THRESHOLDS, values=VALUES, **SCORE)
    return _out(online.score(_requests(spark, d), *online.fit_states(inputs.stream(spark, d), p), p), "pos", "score")


@query(SHARED + f" select pos, round(greatest(0.5, least(5.0, {MU} + coalesce(0.8 * us.s / (us.n + 5), 0) + coalesce(0.9 * its.s / (its.n + 3), 0))), 6) as score" + JOINED)
def on_fallback_score(spark, d):
    return _out(online.fallback_score(_requests(spark, d), *online.fit_states(inputs.stream(spark, d), P), MU, 0.5, 5.0), "pos", "score")


@query(SHARED + f" select pos, round(greatest(0.5, least(5.0, {MU} + coalesce(its.s / (its.n + 5), 0))), 6) as score" + JOINED)
def on_item_only(spark, d):
    _, i = online.fit_states(inputs.stream(spark, d), P)
    return _out(online.shrunken(_requests(spark, d), [("i", i, 1.0, 5.0)], MU, 0.5, 5.0), "pos", "score")


@query(SHARED + f" select pos, round(greatest(0.5, least(5.0, {MU} + coalesce(0.85 * us.s / (us.n + 30), 0) + coalesce(0.95 * its.s / (its.n + 4), 0))), 6) as score" + JOINED)
def on_bias_only(spark, d):
    u, i = online.fit_states(inputs.stream(spark, d), P)
    return _out(online.shrunken(_requests(spark, d), [("u", u, 0.85, 30.0), ("i", i, 0.95, 4.0)], MU, 0.5, 5.0), "pos", "score")


@query(SHARED + f" select pos, round(greatest(0.5, least(5.0, {MU} + coalesce(0.5 * us.s / (us.n + 5) - 0.2 * us.s / (us.n + 50), 0) + coalesce(0.6 * its.s / (its.n + 3) + 0.3 * its.s / (its.n + 40), 0))), 6) as score" + JOINED)
def on_multishrink(spark, d):
    u, i = online.fit_states(inputs.stream(spark, d), P)
    return _out(online.shrunken(_requests(spark, d), [("u", u, 0.5, 5.0), ("u", u, -0.2, 50.0), ("i", i, 0.6, 3.0), ("i", i, 0.3, 40.0)], MU, 0.5, 5.0), "pos", "score")


@query(f"with {STREAM} select i, count(*) as n, round(sum(rating - {MU}), 6) as s1, round(sum((rating - {MU}) ** 2), 6) as s2, round(sum((rating - {MU}) ** 3), 5) as s3 from stream group by i")
def on_moment_calibrated(spark, d):
    return _out(online.moments(inputs.stream(spark, d), "i", MU).withColumn("s3", F.round("s3", 5)))


#: Numbers of the published score. Fixed values.
MOMENTS = online.MomentScoring(
    mean=MU,
    intercept=2.8272202,
    own={
        "u": (0.8282023, 0.0724656, 0.3500099, -0.1483637, -0.0694664, 0.1128627, 0.1603299, 0.0333305, -0.1111785, -0.1682727, -0.0045373, 0.2081790, 0.0260719, -0.1280049, 1.2661248, 0.2241798, -0.0694539, -0.0854149, -0.6939124, -0.0405988),
        "i": (0.9197124, 0.0934311, 1.2312059, 0.1891792, -0.1821118, 0.0284896, 0.2473170, -0.0467627, 0.0903438, -0.4104867, -0.0004702, -0.1444060, 0.0460050, 0.3323592, -1.2649461, -0.4601425, 0.0403028, -0.0054509, 0.6714242, 0.0815008),
    },
    steps={"u": ((0, 10, -0.0462231), (101, None, -0.0106357)), "i": ((0, 3, -0.1327588), (0, 10, -0.0963986), (21, None, 0.0254704))},
    absent={"u": -0.1528766, "i": -0.4050162},
    pairs={"ll": -0.0041441, "bb": -1.6734969, "mm": -0.5421882, "bm": 1.0260082, "mb": 0.7570391, "ss": 0.3827873, "vv": -0.2084104, "tt": 0.0061272, "tm": -0.0862444, "mt": 0.0641967, "ts": 0.1059355, "st": 0.0212622},
    log_difference=-0.0209655,
    bounds=(4, 8, 16, 32),
    segment_weights=(0.6753163, 0.8459537, 0.8912842, 0.6222440),
    segment_constant=-0.00090916,
    user_shrink=24.0,
    item_shrink=4.5,
    damping=(0.90, 0.97),
)


@query()
def on_moment_calibrated_all(spark, d):
    """The score of every row of the stream from both sides' moments over the whole stream, with the vectors at u and i."""
    s = inputs.stream(spark, d)
    return _out(online.moment_score(inputs.with_vectors(spark, d, s, "u", "i"), s, MOMENTS).select("pos", "score"))


def _batch_rows(spark, d):
    """A third of the event table: three batches, and a short fourth where it isn't divisible."""
    return max(1, read(spark, d, "events").count() // 3)


def _batches(spark, d):
    return streaming.batched_ratings(spark, f"{d}/events.parquet", _batch_rows(spark, d))


_BATCHED = f"{STREAM}, batched as (select *, pos // (select greatest(1, count(*) // 3) from stream) as batch from stream)"


@query(f"with {_BATCHED} select batch, count(*) as n, min(pos) as first, max(pos) as last, round(sum(rating), 5) as total from batched group by batch")
def stream_batches(spark, d):
    """The stream as a source of fixed batches of rows, the last one shorter."""
    rows = streaming.updates(_batches(spark, d), "append")
    return rows.groupBy(F.col("batch").cast("long").alias("batch")).agg(F.count("*").alias("n"), F.min("pos").alias("first"), F.max("pos").alias("last"), F.round(F.sum("rating"), 5).alias("total"))


@query(f"""with {_BATCHED}, sums as (select batch, i, sum((rating - {MU}) * 4) as s, count(*) * 4 as n from batched where pos % 4 = 2 group by batch, i)
select batch, i, round(sum(s) over w, 6) as s, cast(sum(n) over w as bigint) as n from sums window w as (partition by i order by batch)""")
def on_refresh_touched(spark, d):
    """What each batch refreshes: the new state of the items that it touched."""
    rows = streaming.updates(online.state(_batches(spark, d), "i", MU, 4, 2, True))
    return _out(rows.withColumn("batch", F.col("batch").cast("long")))


@query(f"""with {_BATCHED}, sums as (select batch, u, count(*) as n, sum(rating - {MU}) as s1, sum((rating - {MU}) ** 2) as s2, sum((rating - {MU}) ** 3) as s3 from batched group by batch, u)
select batch, u, cast(sum(n) over w as bigint) as n, round(sum(s1) over w, 5) as s1, round(sum(s2) over w, 5) as s2, round(sum(s3) over w, 4) as s3 from sums window w as (partition by u order by batch)""")
def stream_moments(spark, d):
    """Count and power sums of users over batches: the state of each user that a batch touched."""
    rows = streaming.updates(online.moments(_batches(spark, d), "u", MU)).withColumn("batch", F.col("batch").cast("long"))
    return rows.select("batch", "u", "n", F.round("s1", 5).alias("s1"), F.round("s2", 5).alias("s2"), F.round("s3", 4).alias("s3"))


def _moment_sql(key: str) -> str:
    """Terms of a side from its power sums, with the bias left out."""
    return f"""m{key} as (select {key}, n, s1 / n as m, greatest(0, s2 / n - (s1 / n) ** 2) as v, s3 / n - 3 * s1 / n * s2 / n + 2 * (s1 / n) ** 3 as c
  from (select {key}, count(*)::double as n, sum(rating - {MU}) as s1, sum((rating - {MU}) ** 2) as s2, sum((rating - {MU}) ** 3) as s3 from stream group by {key}))"""


@query(f"""with {STREAM}, {_moment_sql("u")}, {_moment_sql("i")}, f as (select 'u' as side, u as id, n, m, v, c from mu union all select 'i', i, n, m, v, c from mi)
select side, id, cast(n as bigint) as n, round(ln(1 + n), 6) as l, round(m + 1e-10, 6) as m, round(v + 1e-10, 6) as v, round(sqrt(v), 5) as s, round(case when abs(c) < 1e-9 then 0 else sign(c) * cbrt(abs(c)) end, 4) as t from f""")
def on_moment_features(spark, d):
    """Mean, variance, deviation and cube root of the third central moment of each key, from sums kept over batches."""
    out = None
    for key in "ui":
        sums = streaming.drain(online.moments(_batches(spark, d), key, MU), "update", [key])
        made = online.moment_features(sums, key, sums.select(key, F.lit(0.0).alias(f"b{key}")), MOMENTS).join(sums.select(key, "n"), key)
        t = F.col(f"{key}t")
        one = made.select(F.lit(key).alias("side"), F.col(key).cast("long").alias("id"), "n", F.round(f"{key}l", 6).alias("l"), *[F.round(F.col(f"{key}{c}") + 1e-10, 6).alias(c) for c in "mv"], F.round(f"{key}s", 5).alias("s"), F.round(F.when(F.abs(t) < 1e-3, 0.0).otherwise(t), 4).alias("t"))
        out = one if out is None else out.unionByName(one)
    return out


def dot_sql(first: int = 1, last: int = 64) -> str:
    return f"list_sum(list_transform(range({first}, {last + 1}), lambda k: pv[k]::double * qv[k]::double))"


_N = "(select count(*) from embeddings)"
REQUESTS = f"""{STREAM}, v as (select row_number() over (order by vec_id) - 1 as at, embedding from embeddings),
req as (select pos, u, pos as i, p.embedding as pv, q.embedding as qv from stream join v p on p.at = u % {_N} join v q on q.at = pos % {_N})"""


@query(f"with {REQUESTS} select pos, u, i, round(greatest(0.5, least(5.0, 3.0 + {dot_sql()})), 6) as score from req")
def on_dot_predict_all(spark, d):
    """Every request, as all the following."""
    return inputs.requests(spark, d).select("pos", "u", "i", F.round(F.greatest(F.lit(0.5), F.least(F.lit(5.0), 3.0 + online.dot())), 6).alias("score"))


@query(f"with {REQUESTS} select pos, u, i, round(1.5 * {dot_sql(1, 2)}, 6) as head from req")
def on_pq_head_all(spark, d):
    return inputs.requests(spark, d).select("pos", "u", "i", F.round(1.5 * online.dot(length=2), 6).alias("head"))


@query(f"with {REQUESTS} select pos, u, i, round(0.5 * {dot_sql(1, 16)} + 1.0 * {dot_sql(17, 40)} - 0.5 * {dot_sql(41, 64)}, 6) as score from req")
def on_segment_dot_all(spark, d):
    return inputs.requests(spark, d).select("pos", "u", "i", F.round(online.segment_dot([16, 40, 64], [0.5, 1.0, -0.5]), 6).alias("score"))


@query("select vec_id, round(list_sum(list_transform(range(1, 65), lambda k: embedding[k]::double * (k % 5 - 2))), 6) as head from embeddings")
def on_linear_head_all(spark, d):
    """The heads of all vectors."""
    return read(spark, d, "embeddings").select("vec_id", F.round(online.linear_head("embedding", [float(k % 5 - 2) for k in range(1, 65)]), 6).alias("head"))


@query("""with hid as (select vec_id, h, greatest(0, 0.1 * h + list_sum(list_transform(range(1, 65), lambda k: embedding[k]::double * ((k + h) % 3 - 1)))) * (h - 1) as v from embeddings, range(4) t(h)),
s as (select vec_id, sum(v) as v from hid group by vec_id)
select embeddings.vec_id, round(list_sum(list_transform(range(1, 65), lambda k: embedding[k]::double)) + s.v, 6) as head from embeddings join s using (vec_id)""")
def on_mlp_head_all(spark, d):
    """Over all 64 components."""
    hidden = [[(k + h) % 3 - 1 for k in range(1, 65)] for h in range(4)]
    heads = online.mlp_head(read(spark, d, "embeddings"), "vec_id", "embedding", [1.0] * 64, hidden, [0.1 * h for h in range(4)], [h - 1.0 for h in range(4)])
    return heads.select("vec_id", F.round("head", 6).alias("head"))


@query(f"with {STREAM}, us as (select distinct u from stream) select u, cast((u * 8 // 1000 + 1) * 0.5 * ((u % 7) - 3) + 2.0 * (u % 7) as double) as prior from us")
def on_factor_user(spark, d):
    users = inputs.stream(spark, d).select("u").distinct()
    ends = users.agg(F.coalesce(F.max("u"), F.lit(0)).alias("last"))  # ids from 1000 on have bins beyond the eighth
    high = ends.select(F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(7), F.expr("last * 8 div 1000")))).alias("id"))
    high = high.select(F.col("id").alias("h"), F.array((F.col("id") + 1) * 0.5, F.lit(2.0)).alias("a"))
    low = spark.range(7).select(F.col("id").alias("l"), F.array((F.col("id") - 3).cast("double"), F.col("id").cast("double")).alias("b"))
    return online.factor_user(users, high, low, 1000, 8).select("u", F.round("prior", 6).alias("prior"))


@query(f"with {STREAM} select pos, {MU}::double as score from stream")
def on_noop(spark, d):
    return online.score(_requests(spark, d), None, None, P).select("pos", "score")


@query(f"with {STREAM} select i, round(s, 6) as s, n from ({ITEMS}) t")
def stream_update_sampled(spark, d):
    """The item state as Structured Streaming, in update mode: each batch emits touched keys only."""
    return _out(streaming.drain(online.state(_batches(spark, d), "i", MU, 4, 2, True), "update", ["i"]))


@query(f"with {STREAM} select u, round(s, 6) as s, n from ({USERS}) t")
def stream_user_state(spark, d):
    return _out(streaming.drain(online.state(_batches(spark, d), "u", MU, 10, 0), "complete", ["u"]))


@query('select date_trunc(\'hour\', ts) as start, event_type, count(*) as n from events group by 1, 2')
def stream_windows(spark, d):
    return streaming.windowed_counts(spark, f"{d}/events.parquet", late="3650 days")


@query(SHARED + f""", s as (select pos, rating, {P.intercept} + {CU} + {CI} as full_, {P.intercept} + {CU} + {P.root_item} as no_item, {P.intercept} + {CI} + {P.root_user} as no_user{JOINED})
select 'full' as variant, round(sqrt(avg((greatest(0, least(5, full_)) - rating) ** 2)), 6) as rmse, count(*) as n from s
union all select 'no user', round(sqrt(avg((greatest(0, least(5, no_user - {P.root_user})) - rating) ** 2)), 6), count(*) from s
union all select 'no item', round(sqrt(avg((greatest(0, least(5, no_item - {P.root_item})) - rating) ** 2)), 6), count(*) from s""")
def rep_ablation(spark, d):
    """The score with a component switched off at a time."""
    u, i = online.fit_states(inputs.stream(spark, d), P)
    out = None
    for name, users, items in (("full", u, i), ("no user", None, i), ("no item", u, None)):
        row = ratings.rmse(online.score(_requests(spark, d), users, items, P)).select(F.lit(name).alias("variant"), F.round("rmse", 6).alias("rmse"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@query(f"""with {STREAM}, f as (select *, rating - {MU} as e, u / 150.0 as x1, i / 97.0 as x2, 1.0 as one from stream)
select 'e' as a, 'e' as b, round(sum(e * e), 5) as value from f union all select 'one', 'one', round(sum(one), 5) from f union all select 'one', 'x1', round(sum(x1), 5) from f
union all select 'one', 'x2', round(sum(x2), 5) from f union all select 'one', 'e', round(sum(e), 5) from f union all select 'x1', 'x1', round(sum(x1 * x1), 5) from f union all select 'x1', 'x2', round(sum(x1 * x2), 5) from f
union all select 'x1', 'e', round(sum(x1 * e), 5) from f union all select 'x2', 'x2', round(sum(x2 * x2), 5) from f union all select 'x2', 'e', round(sum(x2 * e), 5) from f""")
def fit_ridge(spark, d):
    """The sums of the normal equations."""
    return fit.gram(_design(spark, d), ["one", "x1", "x2"], "e").withColumn("value", F.round("value", 5))


@query()
def fit_ridge_all(spark, d):
    """Coefficients over the whole stream."""
    found = fit.ridge(_columns(inputs.stream(spark, d)), ["one", "x1", "x2"], "e", 1e-4)
    return spark.createDataFrame([(k, float(v)) for k, v in found.items()], "name string, value double")


@query()
def fit_mixed_segments_all(spark, d):
    """Segments of user and item ids in turns over the whole stream."""
    s = stage(_columns(inputs.stream(spark, d)))
    widths = tuple(m // fit.MOST_BINS + 1 for m in s.agg(F.max("u"), F.max("i")).first())
    sides = zip("ui", fit.mixed_segments(s, "e", 6, 4, 2, widths), strict=True)
    return spark.createDataFrame([(side, k, v, c) for side, (cuts, values) in sides for k, (v, c) in enumerate(zip(values, [*cuts, None], strict=True))], "side string, segment int, value double, last double")


def _columns(s):
    return s.select("*", (F.col("rating") - MU).alias("e"), (F.col("u") / 150.0).alias("x1"), (F.col("i") / 97.0).alias("x2"), F.lit(1.0).alias("one"))


def _design(spark, d):
    s = inputs.stream(spark, d)
    return s.select("*", (F.col("rating") - MU).alias("e"), (F.col("u") / 150.0).alias("x1"), (F.col("i") / 97.0).alias("x2"), F.lit(1.0).alias("one"))


@query(f"with {STREAM} select u, round(sum(rating - {MU}), 6) as s, count(*) as n from stream where pos % 10 = 0 and pos < 5000 group by u")
def fit_stats_prefix(spark, d):
    return _out(online.state(inputs.stream(spark, d).where("pos < 5000"), "u", MU, 10, 0))


@query(f"with {STREAM} select u, count(*) as n, round(sum(rating - {MU}), 6) as s, round(sum((rating - {MU}) ** 2), 6) as s2, count(*) filter (rating >= 4) as high, count(*) filter (rating <= 2) as low from stream group by u")
def fit_stats_rich(spark, d):
    return _out(fit.rich_stats(inputs.stream(spark, d), "u", MU))


@query(f"with {STREAM}, b as (select i, sum(rating - {MU}) / (count(*) + 5.0::double) as b from stream group by i) select u, round(avg(b), 6) as m from stream join b using (i) group by u")
def fit_neighbour_means(spark, d):
    return _out(fit.neighbour_means(inputs.stream(spark, d), "u", "i", MU, 5.0))


@query(f"with {STREAM} select greatest(0, least(19, cast(trunc(rating * 20 / 5.0) as int))) as bin, round(sum(rating - {MU}) / (count(*) + 10.0::double), 6) as value from stream group by 1")
def fit_table(spark, d):
    rows = inputs.stream(spark, d).select((F.col("rating") - MU).alias("e"), fit.uniform_bin(F.col("rating"), 0.0, 5.0, 20).alias("bin"))
    return _out(fit.table(rows, "bin", "e", 10.0))


@query(f"with {STREAM} select pos, cast((row_number() over (order by rating, pos) - 1) * 16 // (select count(*) from stream) as int) as bin from stream")
def bin_rank(spark, d):
    rows = inputs.stream(spark, d).select("pos", F.struct("rating", "pos").alias("k"))
    return fit.rank_bin(rows, "k", 16).select("pos", "bin")


@query(f"""with {STREAM} select pos, cast(u * 16 // 1000 as int) as by_id, cast(u % 7 as int) as by_mod, cast((u * 16 // 1000) + 16 * (u % 7) as int) as both_, cast(((u * 7919 + 13) % 104729) % 32 as int) as hashed from stream""")
def bin_combine(spark, d):
    by_id, by_mod = F.floor(F.col("u") * 16 / 1000), F.col("u") % 7
    cols = {"by_id": by_id, "by_mod": by_mod, "both_": fit.combine_bins([by_id, by_mod], [16, 7]), "hashed": fit.hash_bin(F.col("u"), 7919, 13, 104729, 32)}
    return inputs.stream(spark, d).select("pos", *[c.cast("int").alias(n) for n, c in cols.items()])


@query(f"""with {STREAM}, r as (select u % 8 as a, i % 6 as b, rating - {MU} as e from stream), a1 as (select a, sum(e) / (count(*) + 10.0::double) as v from r group by a),
b1 as (select r.b, sum(e - v) / (count(*) + 10.0::double) as v from r join a1 using (a) group by r.b), a2 as (select r.a, sum(e - v) / (count(*) + 10.0::double) as v from r join b1 using (b) group by r.a),
b2 as (select r.b, sum(e - v) / (count(*) + 10.0::double) as v from r join a2 using (a) group by r.b)
select 'a' as side, a as bin, round(v, 6) as value from a2 union all select 'b', b, round(v, 6) from b2""")
def fit_backfit(spark, d):
    rows = stage(inputs.stream(spark, d).select((F.col("u") % 8).alias("a"), (F.col("i") % 6).alias("b"), (F.col("rating") - MU).alias("e")))
    a, b = fit.backfit(rows, ["a", "b"], "e", 10.0, 2)
    return _out(a.select(F.lit("a").alias("side"), "bin", "value").unionByName(b.select(F.lit("b").alias("side"), "bin", "value")))


@query()
def fit_greedy_tables(spark, d):
    """Tables taken forward, one by one."""
    s = inputs.stream(spark, d)
    bins = {f"u{n}": F.col("u") % n for n in (4, 8, 16)} | {f"i{n}": F.col("i") % n for n in (4, 8, 16)}
    rows = s.select((F.col("rating") - MU).alias("e"), *[c.alias(n) for n, c in bins.items()])
    chosen = fit.greedy_tables(rows, list(bins), "e", 10.0, 40, 1.0)
    return spark.createDataFrame(list(enumerate(chosen)), "round int, bins string")


@query()
def fit_segments_dp(spark, d):
    """Optimal segments of user ids for the mean residual."""
    rows = _design(spark, d)
    cuts, values = fit.segments(fit.bounded_points(rows, "u", "e"), 6)
    return spark.createDataFrame([(k, v, float(c) if c is not None else None) for k, (v, c) in enumerate(zip(values, [*cuts, None], strict=True))], "segment int, value double, last double")


@query(f"""with {STREAM}, w as (select row_number() over (order by vec_id) - 1 as at, embedding from embeddings),
r as (select w.embedding as v, rating - {MU} as e from stream join w on w.at = u % (select count(*) from embeddings)), l as (select e, k, v[k]::double as x from r, range(1, 65) t(k)),
m as (select 'v' as kind, k - 1 as dim, e, x from l union all select 'v2', k - 1, e, x * x from l),
s as (select kind, cast(dim as int) as dim, abs(avg(x * e) - avg(x) * avg(e)) / sqrt(avg(x * x) - avg(x) ** 2) as strength from m group by kind, dim)
select kind, dim, round(strength, 6) as strength from s order by s.strength desc limit 10""")
def fit_feature_screen(spark, d):
    """The ten strongest components of users' vectors, over every row of the stream."""
    rows = inputs.with_vectors(spark, d, inputs.stream(spark, d), "u", "pos").select(F.col("pv").alias("v"), (F.col("rating") - MU).alias("e"))
    return _out(fit.screen(stage(rows), {"v": "v"}, "e", 10))


@query(f"with {STREAM} select pos, round(sin(u * 2 * pi() / 150 * 3), 6) + 0.0 as sin3, round(cos(u * 2 * pi() / 150 * 3), 6) + 0.0 as cos3, round(2 * (2 * u / 1000.0 - 1) ** 2 - 1, 6) as t2 from stream")
def fit_fourier_basis(spark, d):
    """Bases of given frequencies for every row."""
    f = fit.fourier_basis(F.col("u"), 150.0, [3])
    t = fit.chebyshev_basis(F.col("u"), 0.0, 1000.0, 2)
    return inputs.stream(spark, d).select("pos", *[(F.round(c, 6) + 0.0).alias(n) for n, c in f.items()], F.round(t["t2"], 6).alias("t2"))


def _fourier_sql(keep: int, rho: float) -> str:
    """Amplitudes by the sums of the discrete Fourier transform, and the ridge fit by elimination."""
    parts = [f"with recursive {STREAM}, s as (select pos, u, i, rating - {MU} as e from stream), size as (select max(u) + 1 as nu, max(i) + 1 as ni from s)"]
    for k in "ui":
        angle = f"2 * pi() * ((k * x) % n{k}) / n{k}"
        parts.append(f"p{k} as (select {k} as x, avg(e) * sqrt(count(*)) as m from s group by {k}), k{k} as (select unnest(range(1, n{k} // 2 + 1)) as k from size)")
        parts.append(f"a{k} as (select k, sqrt(sum(m * cos({angle})) ** 2 + sum(m * sin({angle})) ** 2) as a from p{k}, k{k}, size group by k)")
        parts.append(f"f{k} as (select list(k order by a desc, k) as f from (select * from a{k} order by a desc, k limit {keep}) t)")
    waves = [(k, n, g) for k in "ui" for n in range(keep) for g in ("sin", "cos")]
    basis = ", ".join(f"{g}({k} * (2 * pi() / n{k}) * f{k}.f[{n + 1}]) as x{c}" for c, (k, n, g) in enumerate(waves, 1))
    parts.append(f"b as materialized (select pos, u, nu, e, fu.f as fu, fi.f as fi, 1.0::double as x0, {basis} from s, size, fu, fi)")
    m = len(waves) + 1
    gram = ", ".join("[" + ", ".join([f"sum(x{r} * x{c})" + (f" + {rho}" if r == c else "") for c in range(m)] + [f"sum(x{r} * e)"]) + "]" for r in range(m))
    parts.append(f"g as (select [{gram}] as a from b)")
    step = f"[[case when r = k then a[k][c] / a[k][k] else a[r][c] - a[r][k] * a[k][c] / a[k][k] end for c in range(1, {m + 2})] for r in range(1, {m + 1})]"
    parts.append(f"solved(k, a) as (select 1::bigint, a from g union all select k + 1, {step} from solved where k <= {m}), w as (select a from solved where k = {m + 1})")
    shown = ", ".join([f"f{k}[{n + 1}] as {k}_f{n}" for k in "ui" for n in range(keep)] + [f"round(x{c}, 6) + 0.0 as {k}_{g}{n}" for c, (k, n, g) in enumerate(waves, 1)])
    return ", ".join(parts) + f" select pos, {shown}, round(2 * (2 * u / nu - 1) ** 2 - 1, 6) + 0.0 as t2, round(" + " + ".join(f"w.a[{c + 1}][{m + 1}] * x{c}" for c in range(m)) + ", 6) + 0.0 as fit from b, w"


@query(_fourier_sql(3, 1.0))
def fit_fourier(spark, d):
    """The three strongest frequencies of each side's mean residuals, their bases for every row, and the ridge fit of the residual by them."""
    s = inputs.stream(spark, d).withColumn("e", F.col("rating") - MU)
    n = s.agg(F.max("u") + 1, F.max("i") + 1).first()
    columns, waves = [], {"one": F.lit(1.0)}
    for key, size in zip(("u", "i"), n, strict=True):
        keys = fit.top_frequencies(fit.frequency_points(s, key, "e", size), 3)
        basis = list(fit.fourier_basis(F.col(key), float(size), keys).items())  # sine and cosine of each in turn
        waves |= {f"{key}_{name}": c for name, c in basis}
        for k, frequency in enumerate(keys):
            columns += [F.lit(frequency).cast("long").alias(f"{key}_f{k}"), *[(F.round(c, 6) + 0.0).alias(f"{key}_{name[:3]}{k}") for name, c in basis[2 * k : 2 * k + 2]]]
    found = fit.ridge(s.select("e", *[c.alias(k) for k, c in waves.items()]), list(waves), "e", 1.0)
    t = fit.chebyshev_basis(F.col("u"), 0.0, float(n[0]), 2)
    value = sum((float(found[k]) * c for k, c in waves.items()), F.lit(0.0))
    return s.select("pos", *columns, (F.round(t["t2"], 6) + 0.0).alias("t2"), (F.round(value, 6) + 0.0).alias("fit"))


@query()
def fit_fourier_all(spark, d):
    return fit_fourier(spark, d)


@query(f"with {STREAM} select case when pos < 0.6 * n then 'statistics' when pos < 0.8 * n then 'fit' else 'eval' end as part, count(*) as n, round(avg(rating), 6) as mean from stream, (select count(*) as n from stream) t group by 1")
def fit_holdout(spark, d):
    s = inputs.stream(spark, d)
    n = s.count()
    part = F.when(F.col("pos") < 0.6 * n, "statistics").when(F.col("pos") < 0.8 * n, "fit").otherwise("eval")
    return _out(s.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.avg("rating").alias("mean")))


@query(f"""with {STREAM} select pos % 4 as phase, count(*) filter (rating < 4) as kept, round(coalesce(sum(rating - {MU}) filter (rating < 4), 0), 6) as s from stream group by 1""")
def fit_gate_scan(spark, d):
    """Residual sums for each sampling phase, with ratings from 4 up skipped: the whole grid in one pass."""
    low = F.when(F.col("rating") < 4, F.col("rating") - MU)
    return _out(inputs.stream(spark, d).groupBy((F.col("pos") % 4).alias("phase")).agg(F.count(low).alias("kept"), F.coalesce(F.sum(low), F.lit(0.0)).alias("s")))


@query()
def fit_gbdt(spark, d):
    """RMSE of boosted trees, grown leaf by leaf on statistics of earlier rows, on rows after those fitted."""
    s = inputs.stream(spark, d)
    n = s.count()
    x = s.where(F.col("pos") >= 0.6 * n)
    for k, shrink in (("u", 20), ("i", 5)):
        known = online.state(s.where(F.col("pos") < 0.6 * n), k, MU).select(k, (F.col("s") / (F.col("n") + shrink)).alias(f"x{k}"), F.log1p("n").alias(f"l{k}"))
        x = x.join(known, k, "left")
    x = x.na.fill(0.0)
    first = trees.boost(x.where(F.col("pos") < 0.8 * n), ["xu", "xi", "lu", "li", "u"], "rating", 3, 8)
    forest = trees.boost(x.where(F.col("pos") < 0.8 * n), ["xu", "xi", "lu", "li", "u"], "rating", 2, 8, start=first)
    return ratings.rmse(x.where(F.col("pos") >= 0.8 * n).withColumn("score", forest.score()))


query.also({n: f"{n}_all" for n in ("user_knn", "on_dot_predict", "on_pq_head", "on_segment_dot", "on_linear_head", "on_mlp_head")})
