"""Queries of composed models, runs, designs, fitted heads and priors."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators import compose, design, fit, models, online, ratings
from skein.operators.compose import Bias, Blend, Ensemble, Fitted, ItemMean
from skein.plans import inputs
from skein.plans.inputs import HELD, RATINGS, STREAM
from skein.plans.rating import MEANS, MU, SCORE, SEGMENT, THRESHOLDS, VALUES, P, _batches, _out, _split, bias_sql, component_sql, state_sql
from skein.plans.registry import Registry
from skein.stage import read, scratch, stage
from skein.streaming import online as streaming

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

_ONE = """, one as (select held.u, held.i, greatest(low, least(high, mu + coalesce(bu, 0) + coalesce(bi, 0))) as score from held left join bu0 using (u) left join bi0 using (i), ends),
blended as (select one.u, one.i, greatest(low, least(high, 0.7 * one.score + 0.3 * greatest(low, least(high, other.score)))) as score from one join other on other.u = one.u and other.i = one.i, ends)"""
BLEND = Blend(Bias(5.0, 1), ItemMean(), 0.3)


@query(bias_sql(3) + MEANS + _ONE + """ select base.u, base.i, round(greatest(low, least(high, 0.6 * base.score + 0.4 * blended.score + 0.1)), 6) as score
from base join blended on blended.u = base.u and blended.i = base.i, ends""")
def make_model(spark, d):
    """An ensemble of a bias model and a blend."""
    f, h = _split(spark, d)
    return _out(Fitted(f).scores(Ensemble(((0.6, Bias(5.0, 3)), (0.4, BLEND)), 0.1), h))


@query()
def make_model_ensemble(spark, d):
    """The composition of all kinds, whose parts share one strong bias model, against that model by itself."""
    f, h = _split(spark, d, by="u")
    fitted, out = Fitted(f), None
    for name in ("baseline", "ensemble"):
        row = ratings.rmse(fitted.scores(compose.make_model(name, Bias(2.0, 20), 4), h).join(h, ["u", "i"])).select(F.lit(name).alias("model"), F.round("rmse", 4).alias("rmse"))
        out = row if out is None else out.unionByName(row)
    return out


@query()
def make_model_stack(spark, d):
    """A stack of biases and item means whose weights are fitted to ratings that its parts weren't, and each part, on ratings that took no part."""
    f, h = _split(spark, d)
    fitted = Fitted(f)
    parts = (Bias(5.0, 1), Bias(50.0, 2), ItemMean())
    stack = compose.Stack(parts, groups=((0, 1), (1, 2)), folds=3, calibration=("inv_uc", "inv_ic"))
    out = None
    for name, model in (("stack", stack), *((f"part {k}", p) for k, p in enumerate(parts))):
        row = ratings.rmse(fitted.scores(model, h).join(h, ["u", "i"])).select(F.lit(name).alias("model"), F.round("rmse", 4).alias("rmse"))
        out = row if out is None else out.unionByName(row)
    return out


_FOLD = "((u % 10007) * 31 + (i % 10007) * 17) % 3"


@query(f"""with {RATINGS}, r as (select u, i, rating, {_FOLD} as fold from ratings),
x as (select a.u, a.i, a.rating, a.fold, coalesce((select avg(b.rating) from r b where b.i = a.i and b.fold <> a.fold), (select avg(c.rating) from r c where c.fold <> a.fold)) as x from r a),
s as (select fold, count(*)::double as n, sum(x) as sx, sum(x * x) as sxx, sum(rating) as sy, sum(x * rating) as sxy from x group by fold),
t as (select sum(n) as n, sum(sx) as sx, sum(sxx) as sxx, sum(sy) as sy, sum(sxy) as sxy from s),
w as (select (n * sxy - sx * sy) / (n * sxx - sx * sx) as slope, * from t)
select 'intercept' as term, round((sy - slope * sx) / n, 4) as weight from w union all select 'item mean', round(slope, 4) from w""")
def fit_stack_weights(spark, d):
    """Weights of one part by the normal equations over out-of-fold scores."""
    model = Fitted(inputs.ratings(spark, d)).stacked(compose.Stack((ItemMean(),), folds=3, ridge=0.0))
    rows = [("intercept", round(model.intercept, 4)), ("item mean", round(model.parts[0][0], 4))]
    return spark.createDataFrame(rows, "term string, weight double")


@query(bias_sql(1) + MEANS + _ONE + " select u, i, round(score, 6) as score from blended")
def predict_run(spark, d):
    """A model fitted to all ratings that are known scores requests; repeated ones are one row."""
    f, h = _split(spark, d)
    return _out(compose.predict_run(f, h.unionByName(h), BLEND))


_EVAL = "(u * 7919 + i * 104729) % 10000 < 2500"


@query(bias_sql(1).replace(HELD, _EVAL) + " select (select count(*) from fit) as fitted, round(sqrt(avg((score - rating) ** 2)), 6) as rmse, count(*) as held from base")
def eval_run(spark, d):
    return _out(compose.eval_run(inputs.ratings(spark, d), Bias(5.0, 1), 0.25))


@query(bias_sql(1) + """, e as (select round(sqrt(avg((mu - rating) ** 2)), 6) as base, round(sqrt(avg((score - rating) ** 2)), 6) as model from base, ends)
select base, model, least_gain, base - model >= least_gain as valid from e, (values (-1000.0::double), (0.0), (1000.0)) t(least_gain)""")
def eval_valid(spark, d):
    """Whether a model's gain over the mean is enough, for three limits."""
    f, h = _split(spark, d)
    fitted = Fitted(f)
    scored = fitted.scores(Bias(5.0, 1), h).join(h, ["u", "i"])
    error = lambda c: F.round(F.sqrt(F.avg(F.pow(c - F.col("rating"), F.lit(2)))), 6)
    metrics = stage(scored.agg(error(F.lit(fitted.ends[0])).alias("base"), error(F.col("score")).alias("model")))
    out = None
    for least in (-1000.0, 0.0, 1000.0):
        row = compose.eval_valid(metrics, "base", "model", least).select("base", "model", F.lit(least).alias("least_gain"), "valid")
        out = row if out is None else out.unionByName(row)
    return out


@query(bias_sql(1) + " select 'u' as side, u as id, round(bu, 6) as value from bu0 union all select 'i', i, round(bi, 6) from bi0")
def sink_model_tables(spark, d):
    """A model's tables, saved and loaded again."""
    f, _ = _split(spark, d)
    bu, bi, _ = models.bias_tables(f, 5.0, 1)
    path = scratch(spark, "model")
    compose.save_tables({"users": bu, "items": bi}, path)
    t = compose.load_tables(spark, path, ["users", "items"])
    return _out(t["users"].select(F.lit("u").alias("side"), F.col("u").alias("id"), F.col("bu").alias("value")).unionByName(t["items"].select(F.lit("i").alias("side"), F.col("i").alias("id"), F.col("bi").alias("value"))))


US, IS = state_sql("u", 2, 0), state_sql("i", 1, 0)
USER_SHRINKS, ITEM_SHRINKS = [5.0, 20.0, 80.0], [3.0, 8.0]


def _term_sql() -> dict[str, str]:
    un, inn = "coalesce(us.n, 0)", "coalesce(its.n, 0)"
    out = {"one": "1.0::double", "log_u": f"ln(1 + {un})", "log_i": f"ln(1 + {inn})", "log2_u": f"ln(1 + {un}) ** 2", "log2_i": f"ln(1 + {inn}) ** 2", "root_u": f"1 / sqrt({un} + 1.0::double)", "root_i": f"1 / sqrt({inn} + 1.0::double)"}
    out |= {f"mean_u_{k}": f"coalesce(us.s / (us.n + {x}), 0)" for k, x in enumerate(USER_SHRINKS)}
    return out | {f"mean_i_{k}": f"coalesce(its.s / (its.n + {x}), 0)" for k, x in enumerate(ITEM_SHRINKS)}


_DESIGN = f"with {STREAM}, us as ({US}), its as ({IS}), design as (select pos, rating - {MU} as e, " + ", ".join(f"{v} as {k}" for k, v in _term_sql().items()) + " from stream left join us on us.u = stream.u left join its on its.i = stream.i)"


def _design(spark, d):
    s = inputs.stream(spark, d)
    us = online.state(s, "u", MU, 2, 0).select("u", F.col("s").alias("us"), F.col("n").alias("un"))
    its = online.state(s, "i", MU).select("i", F.col("s").alias("is"), F.col("n").alias("in"))
    made = design.terms(("us", "un"), ("is", "in"), USER_SHRINKS, ITEM_SHRINKS)
    rows = s.join(us, "u", "left").join(its, "i", "left").select("pos", "u", "i", (F.col("rating") - MU).alias("e"), *[c.alias(n) for n, c in made.items()])
    return rows, list(made)


@query(_DESIGN + " select pos, " + ", ".join(f"round({k}, 6) + 0.0 as {k}" for k in _term_sql()) + " from design")
def fit_features(spark, d):
    rows, names = _design(spark, d)
    return rows.select("pos", *[(F.round(n, 6) + 0.0).alias(n) for n in names])


_NAMES = [*_term_sql(), "e"]


@query(_DESIGN + ", sums as (select " + ", ".join(f"sum({a} * {b}) as g{k}" for k, (a, b) in enumerate((x, y) for n, x in enumerate(_NAMES) for y in _NAMES[n:])) + " from design) "
       + " union all ".join(f"select '{a}' as a, '{b}' as b, round(g{k}, 4) + 0.0 as value from sums" for k, (a, b) in enumerate((x, y) for n, x in enumerate(_NAMES) for y in _NAMES[n:])))
def fit_design_gram(spark, d):
    """The sums of the normal equations of the whole design."""
    rows, names = _design(spark, d)
    return fit.gram(rows, names, "e").withColumn("value", F.round("value", 4) + 0.0)


@query()
def fit_ridge_grid(spark, d):
    """Errors over a grid of rho, of clipped predictions, on a fifth of the rows that wasn't fitted."""
    rows, names = _design(spark, d)
    rows = stage(rows.withColumn("mean", F.lit(MU)).withColumn("_held", F.pmod(F.xxhash64(*names), F.lit(5)) == 0))
    fitted, held = (rows.where(side).drop("_held") for side in (~F.col("_held"), F.col("_held")))
    grid, _ = design.ridge_grid(fitted, names, "e", [1e-4, 1e-2, 1.0, 100.0], 0.0, 5.0, "mean", held)
    return _out(grid)


_SAFE = f"with {STREAM}, us as ({state_sql('u', 7, 3)}), its as (select distinct u from stream)"


@query(_SAFE + " select its.u, round(case when coalesce(n, 0) > 0 then s / (n + 4.0::double) else 0 end + 1e-9, 6) as mean from its left join us on us.u = its.u")
def fit_safe_avg(spark, d):
    s = inputs.stream(spark, d)
    known = s.select("u").distinct().join(online.state(s, "u", MU, 7, 3), "u", "left")
    return known.select("u", F.round(fit.safe_mean(F.col("s"), F.coalesce("n", F.lit(0)), 4.0) + 1e-9, 6).alias("mean"))


MULTIPLIERS = [7919, 104729, 15485863, 32452843, 49979687, 67867967]


@query(f"with {STREAM} select pos, cast((u * 7919 + i * 104729) % 1299709 % 256 as int) as pair, " + ", ".join(f"cast((u * {a} + {k}) % 1299709 % 64 as int) as h{k}" for k, a in enumerate(MULTIPLIERS)) + " from stream")
def bin_multi_hash(spark, d):
    made = {f"h{k}": c for k, c in enumerate(fit.multi_hash_bins(F.col("u"), MULTIPLIERS, 1299709, 64))}
    made["pair"] = fit.pair_hash_bin(F.col("u"), F.col("i"), 7919, 104729, 1299709, 256)
    return inputs.stream(spark, d).select("pos", *[c.cast("int").alias(n) for n, c in made.items()])


def _vectors(spark, d):
    """Every row of the stream with a residual, its user's vector as ``p``, another by its position as ``q``, and the user's mean residual."""
    s = inputs.stream(spark, d).withColumn("e", F.col("rating") - MU).withColumn("other", F.col("pos") * 7 + 3)
    m = s.groupBy("u").agg(F.avg("e").alias("m"))
    return inputs.with_vectors(spark, d, s, "u", "other").withColumnsRenamed({"pv": "p", "qv": "q"}).join(m, "u")


@query(f"""with {STREAM}, r0 as (select *, rating - {MU} as e from stream), um as (select u, avg(e) as m from r0 group by u), w as (select row_number() over (order by vec_id) - 1 as at, embedding from embeddings),
c as (select count(*) as n from embeddings), r as (select r0.pos, e, um.m, a.embedding as p, b.embedding as q from r0 join c on true join w a on a.at = r0.u % c.n join w b on b.at = (r0.pos * 7 + 3) % c.n join um on um.u = r0.u),
l as (select e, k - 1 as dim, p[k]::double as x, p[k]::double * q[k]::double as y, p[k]::double * m as z from r, range(1, 65) t(k)),
k as (select 'p' as kind, dim, e, x from l union all select 'p2', dim, e, x * x from l union all select 'pq', dim, e, y from l union all select 'abs_pq', dim, e, abs(y) from l union all select 'pu', dim, e, z from l),
s as (select kind, cast(dim as int) as dim, abs(avg(x * e) - avg(x) * avg(e)) / sqrt(avg(x * x) - avg(x) ** 2) as strength from k group by kind, dim)
select kind, dim, round(strength, 6) as strength from s order by s.strength desc limit 10""")
def fit_feature_screen_products(spark, d):
    rows = stage(_vectors(spark, d).select("e", "p", "q", "m"))
    return _out(fit.screen(rows, {"p": "p"}, "e", 10, {"pq": ("p", "q")}, {"pu": ("p", "m")}))


@query()
def fit_heads(spark, d):
    """Errors of the fitted mean, of a linear, a pair and a small MLP head, fitted to the first four fifths of the stream, on the rest."""
    n = inputs.stream(spark, d).count()
    every = stage(_vectors(spark, d).select("pos", "e", "p", "q"))
    rows, later = (every.where(side).drop("pos") for side in (F.col("pos") < 0.8 * n, F.col("pos") >= 0.8 * n))
    mean = rows.agg(F.avg("e")).first()[0]
    linear = design.linear_head(rows, ["p", "q"], "e", 1.0)
    a, b = design.pair_head(rows, "p", "q", "e", 2, 1.0, 2)
    w, hidden, bias, out, c = design.mlp_head(rows, ["p", "q"], "e", 4, 20)
    both = later.withColumn("x", F.concat("p", "q"))
    made = {"mean": F.lit(mean), "linear": linear[0] + online.linear_head("x", linear[1:].tolist()), "pair": design.pair_score("p", "q", a, b)}
    relu = F.lit(c) + online.linear_head("x", w.tolist())
    for h, o, m in zip(hidden.tolist(), out.tolist(), bias.tolist(), strict=True):
        relu = relu + o * F.greatest(F.lit(0.0), online.linear_head("x", h) + m)
    made["mlp"] = relu
    long = both.select("e", F.explode(F.array(*[F.struct(F.lit(n_).alias("head"), c_.alias("s")) for n_, c_ in made.items()])).alias("x"))
    return long.groupBy("x.head").agg(F.round(F.sqrt(F.avg(F.pow(F.col("x.s") - F.col("e"), F.lit(2)))), 5).alias("rmse"))


@query()
def fit_p_prior(spark, d):
    """Users' mean residuals by their vectors: the first and the strongest components, each with its best rho."""
    s = inputs.with_vectors(spark, d, inputs.stream(spark, d), "u", "i").withColumn("e", F.col("rating") - MU)
    found = design.p_prior(s.select("u", "e"), s.select("u", F.col("pv").alias("v")).dropDuplicates(["u"]), "u", "e", [8, 16, 32], [1e-3, 1.0, 100.0])
    return spark.createDataFrame([(n, len(dims), float(error)) for n, (error, dims, _, _) in found.items()], "prior string, components int, error double")


@query()
def fit_factor_id(spark, d):
    """Factorised tables of users' residuals, and the prior of each user from them."""
    s = inputs.stream(spark, d).withColumn("e", F.col("rating") - MU)
    n = s.agg(F.max("u")).first()[0] + 1
    high, low = design.factor_tables(s, "u", "e", n, 12, 9, 2, 4)
    return _out(online.factor_user(s.select("u").distinct(), high, low, n, 12))


@query()
def fit_greedy_pairs(spark, d):
    """Tables over single bins and pairs of them, with several shrinkages, until two rounds gain too little."""
    s = inputs.stream(spark, d)
    bins = {f"u{n}": F.col("u") % n for n in (4, 8)} | {f"i{n}": F.col("i") % n for n in (4, 8)}
    rows = s.select((F.col("rating") - MU).alias("e"), *[c.alias(n) for n, c in bins.items()])
    pairs = [(a, b) for a in ("u4", "u8") for b in ("i4", "i8")]
    chosen = fit.greedy_tables(rows, [*bins, *pairs], "e", [10.0, 50.0], 120, 1.0, 2)
    return spark.createDataFrame([(k, " x ".join(c), lam) for k, (c, lam) in enumerate(chosen)], "round int, bins string, shrink double")


@query()
def fit_backfit_until(spark, d):
    """Errors of back-fitting, round by round, until three rounds in turn bring nothing."""
    rows = inputs.stream(spark, d).select((F.col("u") % 8).alias("a"), (F.col("i") % 6).alias("b"), (F.col("rating") - MU).alias("e"))
    _, errors = fit.backfit_until(rows, ["a", "b"], "e", 10.0, 3, 1e-9, 12)
    return spark.createDataFrame([(k + 1, round(e, 6)) for k, e in enumerate(errors)], "round int, rmse double")


@query()
def fit_fourier_ridge(spark, d):
    """A ridge fit of both axes' strongest frequencies and their products to four fifths of the stream; errors on the rest."""
    s = stage(inputs.stream(spark, d).withColumn("e", F.col("rating") - MU))
    later = s.where("pos % 5 = 4")
    s = s.where("pos % 5 <> 4")
    n = s.agg(F.max("u") + 1, F.max("i") + 1).first()
    axes = [fit.fourier_basis(F.col(k), float(size), fit.top_frequencies(fit.frequency_points(s, k, "e", size), 2)) for k, size in zip(("u", "i"), n, strict=True)]
    made = fit.product_basis(*axes)
    rows, held = (stage(r.select("e", F.lit(1.0).alias("one"), *[c.alias(k) for k, c in made.items()])) for r in (s, later))
    grid, _ = design.ridge_grid(rows, ["one", *made], "e", [1e-3, 1.0], -5.0, 5.0, held=held)
    return _out(grid)


@query()
def on_full_sgd(spark, d):
    """After each batch, factors are fitted anew to all rows so far, and score the requests."""
    requests = inputs.stream(spark, d).select("u", "i")

    def refit(history):
        factors = models.sgd_factors(history, 4, 2, 0.008, 0.04, mean=P.mean)
        return models.score_factors(requests, factors, (P.mean, 0.5, 5.0))

    return streaming.refit_per_batch(_batches(spark, d), refit)


#: The score with parts of it switched off: parameters, sides that have a state, strides of users and items with their phases.
_FULL = {"thresholds": THRESHOLDS, "values": VALUES}
VARIANTS = {
    "full": (_FULL, "ui", (10, 0, 4, 2)),
    "no prior": ({}, "ui", (10, 0, 4, 2)),
    "no counts": (_FULL | {"log_user": 0.0, "log_item": 0.0, "root_user": 0.0, "root_item": 0.0}, "ui", (10, 0, 4, 2)),
    "no user residual": (_FULL | {"user_weight": 0.0}, "ui", (10, 0, 4, 2)),
    "no item residual": (_FULL | {"item_weight": 0.0}, "ui", (10, 0, 4, 2)),
    "item only": (_FULL, "i", (10, 0, 4, 2)),
    "constant": (_FULL, "", (10, 0, 4, 2)),
    "other strides": (_FULL, "ui", (5, 1, 2, 1)),
}


def _variant_sql(name: str) -> str:
    changed, sides, (us, up, its, ip) = VARIANTS[name]
    p = SCORE | changed
    users, items = state_sql("u", us, up), state_sql("i", its, ip, its)
    of = {"u": component_sql("x.s", "x.n", (p["log_user"], p["root_user"], p["user_weight"], p["user_shrink"])), "i": component_sql("y.s", "y.n", (p["log_item"], p["root_item"], p["item_weight"], p["item_shrink"]))}
    total = " + ".join([str(p["intercept"]), SEGMENT if "thresholds" in p else "0.0", *[of[k] for k in sides]]) if sides else str(MU)
    return f"select '{name}' as variant, greatest(0.0, least(5.0, {total})) as score, req.rating from stream req left join ({users}) x on x.u = req.u left join ({items}) y on y.i = req.i"


@query(f"with {STREAM}, s as (" + " union all ".join(map(_variant_sql, VARIANTS)) + ") select variant, round(sqrt(avg((score - rating) ** 2)), 6) as rmse, count(*) as n from s group by variant")
def rep_ablation_grid(spark, d):
    """The score's error with each of its parts switched off."""
    s, out = inputs.stream(spark, d), None
    for name, (changed, sides, (us, up, its, ip)) in VARIANTS.items():
        p = online.Scoring(mean=MU, low=0.0, high=5.0, user_stride=us, user_phase=up, item_stride=its, item_phase=ip, **(SCORE | changed))
        users, items = online.fit_states(s, p)
        row = ratings.rmse(online.score(s.select("u", "i", "rating"), users if "u" in sides else None, items if "i" in sides else None, p)).select(F.lit(name).alias("variant"), F.round("rmse", 6).alias("rmse"), "n")
        out = row if out is None else out.unionByName(row)
    return out


MASKS = {"all": (0.0, 9.0), "below 4": (0.0, 4.0), "from 4": (4.0, 9.0), "2 to 4": (2.0, 4.0)}


@query(f"""with {STREAM}, m(mask, lo, hi) as (values {", ".join(f"('{n}', {a}::double, {b}::double)" for n, (a, b) in MASKS.items())})
select side, mask, phase, count(*) filter (rating >= lo and rating < hi) as kept, round(coalesce(sum(rating - {MU}) filter (rating >= lo and rating < hi), 0), 6) as s
from (select 'item' as side, pos % 4 as phase, rating from stream union all select 'user', pos % 10, rating from stream) t, m group by side, mask, phase""")
def fit_gate_grid(spark, d):
    """Residual sums for each mask of ratings and each sampling phase of items and users: the whole grid in one pass."""
    sides = F.explode(F.array(F.struct(F.lit("item").alias("side"), (F.col("pos") % 4).alias("phase")), F.struct(F.lit("user").alias("side"), (F.col("pos") % 10).alias("phase"))))
    masks = F.explode(F.array(*[F.struct(F.lit(n).alias("mask"), ((F.col("rating") >= a) & (F.col("rating") < b)).alias("keep")) for n, (a, b) in MASKS.items()]))
    rows = inputs.stream(spark, d).select("rating", "pos", sides.alias("x")).select("rating", "x.*").select("*", masks.alias("m")).select("rating", "side", "phase", "m.*")
    e = F.when(F.col("keep"), F.col("rating") - MU)
    return _out(rows.groupBy("side", "mask", "phase").agg(F.count(e).alias("kept"), F.coalesce(F.sum(e), F.lit(0.0)).alias("s")))
