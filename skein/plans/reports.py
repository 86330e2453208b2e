"""Queries of the report operators, over event values as if they were runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators import report
from skein.plans.registry import Registry
from skein.sources import text
from skein.stage import read

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles
RUNS = 'runs as (select event_type as grp, event_id as run, "value" from events)'


def _runs(spark, d):
    return read(spark, d, "events").select(F.col("event_type").alias("grp"), F.col("event_id").alias("run"), "value")


@query(f'with {RUNS} select grp, round(quantile_cont("value", 0.5), 6) as p50, round(quantile_cont("value", 0.9), 6) as p90, round(quantile_cont("value", 0.99), 6) as p99 from runs group by grp')
def rep_percentile(spark, d):
    p = report.percentiles(_runs(spark, d), [0.5, 0.9, 0.99])
    return p.select("grp", *[F.round(c, 6).alias(c) for c in p.columns[1:]])


MARKED = f"""{RUNS}, mid as (select grp, median("value") as med, quantile_cont("value", 0.25) as q1, quantile_cont("value", 0.75) as q3 from runs group by grp),
mads as (select runs.grp, median(abs("value" - med)) as mad from runs join mid on mid.grp = runs.grp group by runs.grp),
marked as (select runs.grp, run, "value", case when mad > 0 then abs(0.6745 * ("value" - med) / mad) <= 3.5 when q3 > q1 then "value" between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1) else true end as keep
from runs join mid on mid.grp = runs.grp join mads on mads.grp = runs.grp)"""


@query(f'with {MARKED} select grp, run, "value", keep from marked')
def rep_outlier_mad(spark, d):
    return report.outliers(_runs(spark, d))


@query(f"""with {MARKED} select grp, count(*) as runs, count(*) filter (keep) as kept, round(avg("value"), 6) as mean, round(avg("value") filter (keep), 6) as kept_mean, round(median("value"), 6) as median,
round(median("value") filter (keep), 6) as kept_median, round(sum("value"), 4) as total from marked group by grp""")
def rep_summary(spark, d):
    s = report.summary(report.outliers(_runs(spark, d)))
    return s.select("grp", "runs", "kept", *[F.round(c, 6).alias(c) for c in ("mean", "kept_mean", "median", "kept_median")], F.round("total", 4).alias("total"))


@query(f'with {RUNS} select grp, round(avg("value"), 6) as mean, round(coalesce(stddev_samp("value"), 0), 6) as std from runs group by grp')
def summary_mean_std(spark, d):
    return report.mean_std(_runs(spark, d)).select("grp", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query(f"""with {RUNS} select grp, round(avg("value") filter (run % 3 = 0), 6) as k0, round(avg("value") filter (run % 3 = 1), 6) as k1, round(avg("value") filter (run % 3 = 2), 6) as k2 from runs group by grp""")
def summary_pivot(spark, d):
    wide = _runs(spark, d).withColumn("k", F.concat(F.lit("k"), (F.col("run") % 3).cast("string"))).groupBy("grp").pivot("k", ["k0", "k1", "k2"]).agg(F.avg("value"))
    return wide.select("grp", *[F.round(c, 6).alias(c) for c in ("k0", "k1", "k2")])


@query(f"""with {RUNS}, p as (select grp, run % 1000 as "time", min("value") as error from runs group by 1, 2), w as (select *, min(error) over (partition by grp order by "time" rows between unbounded preceding and 1 preceding) as b from p)
select grp, "time", error from w where b is null or error < b""")
def rep_pareto(spark, d):
    points = _runs(spark, d).select("grp", (F.col("run") % 1000).alias("time"), F.col("value").alias("error"))
    return report.pareto(points, "grp")


_MEANS = f'{RUNS}, m as (select grp, round(avg("value"), 6) as v from runs group by grp), base as (select v as b from m where grp = (select min(grp) from m))'


def _means(spark, d):
    m = _runs(spark, d).groupBy(F.col("grp").alias("variant")).agg(F.round(F.avg("value"), 6).alias("value"))
    return m, m.agg(F.min("variant")).first()[0]


@query(f'with {_MEANS} select grp as variant, v as "value", round(b / v, 8) as change from m, base')
def rep_speedup(spark, d):
    m, base = _means(spark, d)
    return report.against(m, "variant", base).withColumn("change", F.round("change", 8))


@query(f'with {_MEANS} select grp as variant, v as "value", round(v - b, 8) as change from m, base')
def rep_component_loss(spark, d):
    m, base = _means(spark, d)
    return report.against(m, "variant", base, "loss").withColumn("change", F.round("change", 8))


@query(f'with {RUNS} select case when run % 2 = 0 then \'update\' else \'predict\' end as stage, count(*) as n, round(sum("value"), 4) as total from runs group by 1')
def rep_stage_profile(spark, d):
    stage = F.when(F.col("run") % 2 == 0, "update").otherwise("predict")
    return _runs(spark, d).groupBy(stage.alias("stage")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def parse_last_json_all(spark, d):
    """The logs of all events."""
    logs = read(spark, d, "events").select("event_id", F.concat(F.lit("starting\n"), "props", F.lit("\n \n")).alias("log"))
    return report.last_json(logs, "k bigint")


@query("select '{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}' as json from region")
def sink_json(spark, d):
    return text.json_lines(read(spark, d, "region").select("r_regionkey", "r_name"))


query.also({"parse_last_json": "parse_last_json_all"})
