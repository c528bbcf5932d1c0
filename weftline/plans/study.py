"""Queries of the study steps: match filters, examples, labelling queues, merged classes, sweeps over windows and thresholds, comparison of estimators."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from weftline.functions import maths, text as t
from weftline.functions.maths import two_sided_p
from weftline.operators import acquire as a
from weftline.operators import labeling, regress as r
from weftline.operators import measures as m
from weftline.operators import panel as p
from weftline.plans.acquire import _ONCE, _TRUE
from weftline.plans.models import _paired_cells
from weftline.plans.panels import _E, _LAB, _events
from weftline.session import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f
    return add


_WORD = "regexp_matches(lower(coalesce(actor1name, '') || ' ' || coalesce(actor2name, '')), '(^|[^a-z0-9])({})([^a-z0-9]|$)')"
_MODES = {"any_rebel": "u or r or y", "actor_terms_only": "u or r", "ucdp_only": "u", "rad_only": "r", "both_terms": "u and r", "gdelt_type_only": "y and not (u or r)"}


@query(f"with {_ONCE}, f as (select globaleventid, {_WORD.format('front|army')} as u, {_WORD.format('guard|army')} as r, {_TRUE} as y from once) "
       + " union all ".join(f"select '{mode}' as mode, globaleventid from f where {rule}" for mode, rule in _MODES.items()))
def match_modes(spark, folder):
    """The articles that each of the six match filters keeps."""
    once = a.once_per_article(table(spark, folder, "articles_raw"))
    both = once.withColumn("_both", F.concat(F.coalesce("actor1name", F.lit("")), F.lit(" "), F.coalesce("actor2name", F.lit(""))))
    flags = [a.names_match(["_both"], ["front", "army"]), a.names_match(["_both"], ["guard", "army"]), t.truthy(F.col("involves_rebel"))]
    kept = F.array(*[F.when(a.match_filter(mode, *flags), F.lit(mode)) for mode in a.MATCH_FILTERS])
    return both.select("globaleventid", F.explode(F.array_compact(kept)).alias("mode"))


@query("""select year, count(*) as n_rows, count(distinct globaleventid) as n_articles from (select unnest([2019, 2021, 2023]) as year) y
join articles_raw on starts_with(cast(sqldate as varchar), cast(year as varchar)) or starts_with(cast(dateadded as varchar), cast(year as varchar)) group by 1""")
def year_filter(spark, folder):
    """Rows of which either date column begins with a year."""
    years = F.array_compact(F.array(*[F.when(a.of_year([F.col("sqldate"), F.col("dateadded")], y), F.lit(y)) for y in (2019, 2021, 2023)]))
    return table(spark, folder, "articles_raw").select("globaleventid", F.explode(years).alias("year")).groupBy("year").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("globaleventid").alias("n_articles"))


@query(f"""with {_ONCE}, f as (select globaleventid, {_TRUE} as involves, row_number() over (partition by {_TRUE} order by md5(cast(globaleventid as varchar) || '|42'), globaleventid) as place from once)
select globaleventid, involves, place from f where place <= 50""")
def match_examples(spark, folder):
    """Fifty examples each of articles with and without a rebel actor."""
    once = a.once_per_article(table(spark, folder, "articles_raw")).select("globaleventid", t.truthy(F.col("involves_rebel")).alias("involves"))
    return a.stratified(once, ["involves"], "globaleventid", 42, 50).withColumn("place", F.col("place").cast("long"))


@query("""with l as (select globaleventid, coder_1_id as who from inter_annotator union all select globaleventid, coder_2_id from inter_annotator), me as (select min(who) as who from l),
k as (select globaleventid, max(case when l.who = me.who then 1 else 0 end) as own, max(case when l.who <> me.who then 1 else 0 end) as others from l, me where globaleventid is not null group by 1),
s as (select sum(own * others) < cast(floor((sum(own) + 1) * 0.1) as bigint) as allowed from k)
select i.globaleventid, coalesce(k.others, 0) = 1 as by_others from (select distinct globaleventid from articles_raw where globaleventid is not null) i left join k on k.globaleventid = i.globaleventid, s
where coalesce(k.own, 0) = 0 and (s.allowed or coalesce(k.others, 0) = 0)""")
def next_label_items(spark, folder):
    """Articles that the first coder by name may get next, with the cap of a tenth on double work."""
    i = table(spark, folder, "inter_annotator")
    labels = i.select("globaleventid", F.col("coder_1_id").alias("who")).unionByName(i.select("globaleventid", F.col("coder_2_id").alias("who")))
    first = labels.agg(F.min("who")).first()[0] or ""
    return labeling.next_items(table(spark, folder, "articles_raw"), labels, "globaleventid", "who", first)


_CLASS = "case when lower(trim(coalesce(eventrootcode, ''))) in ('18', '19', '20') then lower(trim(eventrootcode)) else 'other' end"


@query(f"select {_CLASS} as four, case when {_CLASS} in ('18', '19') then 'violent' else {_CLASS} end as three, count(*) as n from articles_raw group by 1, 2")
def merged_classes(spark, folder):
    """Event classes merged to four and to three."""
    four = m.collapsed(F.col("eventrootcode"), ("18", "19", "20"))
    three = m.collapsed(F.col("eventrootcode"), ("18", "19", "20"), {"18": "violent", "19": "violent"})
    return table(spark, folder, "articles_raw").groupBy(four.alias("four"), three.alias("three")).agg(F.count(F.lit(1)).alias("n"))


WINDOWS, THRESHOLDS = (1, 2, 4), (1, 2)
_A, _B = _LAB.format("any_fatalities_mentioned_coder_1"), _LAB.format("any_fatalities_mentioned_coder_2")
_RATES = f"""cells as (select distinct * from inter_annotator where {_A} <> '' and {_B} <> ''), rates as (select count(*) filter ({_A} = 'yes' and {_B} = 'yes') / count(*) filter ({_B} = 'yes') as tpr,
count(*) filter ({_A} = 'yes' and {_B} <> 'yes') / count(*) filter ({_B} <> 'yes') as fpr from cells)"""


def _window_sql(weeks: int) -> str:
    return f"""select {weeks} as weeks, g.actor_id, g.i, coalesce(n, 0) as n, deadly / nullif(n, 0) as raw, lead(ln(1 + coalesce(f, 0.0))) over (partition by g.actor_id order by g.i) as y
from (select actor_id, unnest(range(0, floor((date '2026-01-01' - date '2019-12-30') / {7.0 * weeks})::int))::int as i from (select distinct side_a as actor_id from ev where side_a is not null and day is not null)) g
left join (select side_a as actor_id, floor((day - date '2019-12-30') / {7.0 * weeks})::int as i, count(*) as n, count(*) filter (best > 0) as deadly, coalesce(sum(best), 0.0) as f from ev where side_a is not null and day is not null group by 1, 2) c
on c.actor_id = g.actor_id and c.i = g.i"""


@query(f"""with {_E}, {_RATES}, w as ({' union all '.join(map(_window_sql, WINDOWS))}),
s as (select weeks, least, n, raw, least(greatest((raw - fpr) / (tpr - fpr), 0), 1) as x, y, tpr, fpr from w join (select unnest([{', '.join(map(str, THRESHOLDS))}]) as least) q on w.n >= least, rates where raw is not null and y is not null),
a as (select weeks, least, count(*) as k, regr_slope(y, raw) as raw_beta, regr_slope(y, x) as beta, regr_r2(y, x) as partial_r2, var_pop(x) as v, avg(x) as mx, avg(x * x) as sq, sum(1.0 / n) / sqrt(count(*)) as kappa, any_value(tpr) as tpr, any_value(fpr) as fpr from s group by 1, 2),
o as (select *, greatest(0.0, ((fpr + (tpr - fpr) * mx) * (1 - 2 * fpr) + fpr * fpr) / ((tpr - fpr) * (tpr - fpr)) - sq) as omega from a), z as (select *, kappa / sqrt(k) * omega / v as shift from o)
select weeks, least as least_events, k as n, raw_beta, beta as calibrated_beta, partial_r2, (1 + shift) * beta as bca_beta, case when shift < 1 then beta / (1 - shift) end as bcm_beta, 100 * (exp(0.1 * beta) - 1) as ten_point_effect from z""")
def window_threshold_sweep(spark, folder):
    """The next block's log fatalities on the share of deadly events, over block widths and least numbers of events: raw, calibrated and corrected for the error of the labels."""
    tp, fn, fp, tn = _paired_cells(spark, folder)
    tpr, fpr = tp / (tp + fn), fp / (fp + tn)
    events, rows = _events(spark, folder), []
    for weeks in WINDOWS:
        panel = p.leads_and_lags(p.block_panel(events, weeks, "2026-01-01"), "actor_id", "period_index", "log_fatalities", 1, 0).withColumn("x", maths.calibrated(F.col("deadly_share"), tpr, fpr))
        for least in THRESHOLDS:
            s = r.complete(panel, ["deadly_share", "log_fatalities_lead1"], ("n_events", least))
            one = s.agg(F.expr("regr_slope(log_fatalities_lead1, deadly_share)").alias("raw"), F.avg("x").alias("mx"), F.avg(F.col("x") * F.col("x")).alias("sq")).first()
            f = r.fit(s, "log_fatalities_lead1", ["x"], "actor_id", "period_index", 6)
            c = r.corrected(f, "x", r.index_omega(one["mx"], one["sq"], tpr, fpr), r.count_kappa(s, "n_events"))
            rows.append((weeks, least, f.n, one["raw"], c["naive"], 1 - f.sse / f.sst, c["bca"], c["bcm"]))
    df = spark.createDataFrame(rows, "weeks int, least_events int, n long, raw_beta double, calibrated_beta double, partial_r2 double, bca_beta double, bcm_beta double")
    return df.withColumn("ten_point_effect", maths.ten_point_effect(F.col("calibrated_beta")))


@query()
def sweep_significance(spark, folder):
    """HAC tests of the calibrated share in all cells of the sweep, adjusted within each block width and over all."""
    tp, fn, fp, tn = _paired_cells(spark, folder)
    events, rows = _events(spark, folder), []
    for weeks in WINDOWS:
        panel = p.leads_and_lags(p.block_panel(events, weeks, "2026-01-01"), "actor_id", "period_index", "log_fatalities", 1, 1).withColumn("x", maths.calibrated(F.col("deadly_share"), tp / (tp + fn), fp / (fp + tn)))
        for least in THRESHOLDS:
            s = r.complete(panel, ["x", "log_fatalities", "log_fatalities_lag1", "log_fatalities_lead1"], ("n_events", least))
            f = r.fit(s, "log_fatalities_lead1", ["x", "log_fatalities", "log_fatalities_lag1"], "actor_id", "period_index", 6)
            i = f.names.index("x")
            se = math.sqrt(max(f.cov[i, i], 0))
            rows.append((weeks, least, f.n, float(f.beta[i]), se, two_sided_p(f.beta[i] / se) if se else None))
    return m.fdr_in_and_across(spark.createDataFrame(rows, "weeks int, least_events int, n long, beta double, se double, p double"), ["weeks"], "p", ["least_events"])


@query(f"""with d as (select coding_round, coder_1_id, abs(count(*) filter ({_A} = 'yes') - 0.4 * count(*)) / count(*) as p from inter_annotator group by 1, 2),
x as (select *, row_number() over (partition by coding_round order by p, coder_1_id) as r, count(*) over (partition by coding_round) as c, row_number() over (order by p, coding_round, coder_1_id) as ra, count(*) over () as ca from d)
select coding_round, coder_1_id, p, least(1.0, min(p * c / r) over (partition by coding_round order by r desc rows unbounded preceding)) as p_fdr_within, least(1.0, min(p * ca / ra) over (order by ra desc rows unbounded preceding)) as p_fdr_across from x""")
def fdr_families(spark, folder):
    """Tests of `fdr_bh` adjusted within rounds and over all rounds."""
    tests = table(spark, folder, "inter_annotator").groupBy("coding_round", "coder_1_id").agg(
        (F.abs(F.count_if(t.label_form(F.col("any_fatalities_mentioned_coder_1")) == "yes") - 0.4 * F.count(F.lit(1))) / F.count(F.lit(1))).alias("p"))
    return m.fdr_in_and_across(tests, ["coding_round"], "p", ["coder_1_id"])
