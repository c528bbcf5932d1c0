"""Queries on panels and measures."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.functions import dates, maths, text as t
from weftline.operators import measures as m
from weftline.operators import panel as p
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


FIRST, LAST = 2018 * 12 + 1, 2025 * 12 + 12
_ID = r"try_cast(regexp_extract(trim({0}), '^0*(\d{{1,18}})(?:\.0*)?$', 1) as bigint)"
_E = rf"""ev as (select id, {_ID.format('side_a_new_id')} as side_a, {_ID.format('side_b_new_id')} as side_b, case when isnan(best) or best < 0 then null else best end as best, country, adm_1, latitude, longitude, where_prec,
  coalesce(try_cast(nullif(regexp_extract(trim(date_start), '^(\d{{4}}-\d{{2}}-\d{{2}})([T ]\d{{2}}:\d{{2}}(:\d{{2}}(\.\d+)?)?)?$', 1), '') as date), cast(try_strptime(nullif(regexp_extract(trim(date_start), '^(\d{{8}})$', 1), ''), '%Y%m%d') as date),
    cast(try_strptime(nullif(regexp_extract(trim(date_start), '^(\d{{1,2}}\.\d{{1,2}}\.\d{{4}})$', 1), ''), '%d.%m.%Y') as date)) as day
  from (select *, row_number() over (partition by id order by loaded_at desc) as rn from ged_event where id is not null) where rn = 1)"""
_MO = "(extract(year from day) * 12 + extract(month from day))::int"
_MONTHLY = f"mon as (select side_a as actor_id, {_MO} as month, count(*) as n_events, coalesce(sum(best), 0.0) as fatalities from ev where side_a is not null and day is not null group by 1, 2)"
_GRID = f"grid as (select actor_id, unnest(range({FIRST}, {LAST + 1}))::int as month from (select distinct actor_id from mon)), bal as (select g.actor_id, g.month, coalesce(n_events, 0) as n_events, coalesce(fatalities, 0.0) as fatalities, ln(1 + coalesce(fatalities, 0.0)) as y from grid g left join mon m on m.actor_id = g.actor_id and m.month = g.month)"
_SIDES = "sides as (select distinct id, day, best, country, adm_1, latitude, longitude, where_prec, unnest([side_a, side_b]) as actor_id from ev)"
_PANEL = f"with {_E}, {_MONTHLY}, {_GRID}"


def _events(spark, folder):
    return p.clean_events(table(spark, folder, "ged_event"))


def _panel(spark, folder):
    return p.balanced(p.monthly(_events(spark, folder)), "actor_id", "month", FIRST, LAST, ["n_events", "fatalities"]).withColumn("y", F.log1p("fatalities"))


@query(f"with {_E} select id, day, date '2019-12-30' + (floor((day - date '2019-12-30') / 7.0) * 7)::int as week, date '2019-12-30' + (floor((day - date '2019-12-30') / 14.0) * 14)::int as two_weeks, date '2019-12-30' + (floor((day - date '2019-12-30') / 28.0) * 28)::int as four_weeks from ev where day is not null")
def two_week_blocks(spark, folder):
    return _events(spark, folder).where("day is not null").select("id", "day", *[dates.block_start(F.col("day"), w).alias(n) for w, n in ((1, "week"), (2, "two_weeks"), (4, "four_weeks"))])


@query(f"""with {_E}, c as (select side_a as actor_id, floor((day - date '2019-12-30') / 14.0)::int as period_index, count(*) as n_events, count(*) filter (best > 0) as n_deadly, coalesce(sum(best), 0.0) as fatalities from ev where side_a is not null and day is not null group by 1, 2),
g as (select actor_id, unnest(range(0, floor((date '2026-01-01' - date '2019-12-30') / 14.0)::int))::int as period_index from (select distinct side_a as actor_id from ev where side_a is not null and day is not null))
select g.actor_id, g.period_index, date '2019-12-30' + g.period_index * 14 as period_start, coalesce(n_events, 0) as n_events, coalesce(n_deadly, 0) as n_deadly, coalesce(fatalities, 0.0) as fatalities,
n_deadly / nullif(n_events, 0) as deadly_share, ln(1 + coalesce(fatalities, 0.0)) as log_fatalities from g left join c on c.actor_id = g.actor_id and c.period_index = g.period_index""")
def balanced_grid_panel(spark, folder):
    return p.block_panel(_events(spark, folder), 2, "2026-01-01")


@query(f"""{_PANEL} select actor_id, month, y, lead(y) over w as y_lead1, lag(y) over w as y_lag1, lag(y, 2) over w as y_lag2,
(make_date((month - 1) // 12, (month - 1) % 12 + 1, 1) < date '2021-08-15' and make_date((month - 1) // 12, (month - 1) % 12 + 1, 1) + 30 > date '2021-08-15')::int as regime_transition,
(make_date((month - 1) // 12, (month - 1) % 12 + 1, 1) >= date '2021-08-15')::int as regime_post, (make_date((month - 1) // 12, (month - 1) % 12 + 1, 1) + 30 > date '2021-08-15')::int as regime_touched
from bal window w as (partition by actor_id order by month)""")
def panel_lead_lag(spark, folder):
    wide = p.leads_and_lags(_panel(spark, folder).select("actor_id", "month", "y"), "actor_id", "month", "y")
    start = F.expr("make_date(cast(floor((month - 1) / 12) as int), cast(pmod(month - 1, 12) as int) + 1, 1)")
    return wide.withColumns(p.regimes(start, 30, "2021-08-15"))


@query(f"""{_PANEL} select actor_id, month, case when count(y) over (w rows between 2 preceding and current row) = 3 then sum(y) over (w rows between 2 preceding and current row) end as y_bin0,
case when count(y) over (w rows between 5 preceding and 3 preceding) = 3 then sum(y) over (w rows between 5 preceding and 3 preceding) end as y_bin1 from bal window w as (partition by actor_id order by month)""")
def history_bins(spark, folder):
    return p.history_bins(_panel(spark, folder).select("actor_id", "month", "y"), "actor_id", "month", "y", 3, 2).drop("y")


@query(f"""{_PANEL} select b.actor_id, b.month, b.y, m2.y as y_hm2, m1.y as y_hm1, p1.y as y_h1, p2.y as y_h2 from bal b left join bal m2 on m2.actor_id = b.actor_id and m2.month = b.month - 2
left join bal m1 on m1.actor_id = b.actor_id and m1.month = b.month - 1 left join bal p1 on p1.actor_id = b.actor_id and p1.month = b.month + 1 left join bal p2 on p2.actor_id = b.actor_id and p2.month = b.month + 2""")
def offset_profile(spark, folder):
    return p.at_offsets(_panel(spark, folder).select("actor_id", "month", "y"), "actor_id", "month", "y", (-2, -1, 1, 2))


def _sets_sql(months: int) -> str:
    return f"""{_PANEL}, seen as (select distinct side_a as actor_id, {_MO} as month, country from ev where side_a is not null and day is not null and trim(coalesce(country, '')) <> ''),
gs as (select actor_id, unnest(range({FIRST}, {LAST + 1}))::int as month from (select distinct actor_id from seen)),
sets as (select g.actor_id, g.month, coalesce(list_sort(list_distinct(list(s.country) filter (s.country is not null))), []) as countries from gs g left join seen s on s.actor_id = g.actor_id and s.month between g.month - {months - 1} and g.month group by 1, 2)"""


@query(_sets_sql(12) + " select actor_id, month, array_to_string(countries, '; ') as countries from sets")
def lookback_risk_set_12(spark, folder):
    return p.lookback_sets(_events(spark, folder), FIRST, LAST, 12).select("actor_id", "month", F.array_join("countries", "; ").alias("countries"))


@query(_sets_sql(25) + " select actor_id, month, array_to_string(countries, '; ') as countries from sets")
def lookback_risk_set_24(spark, folder):
    return p.lookback_sets(_events(spark, folder), FIRST, LAST, 25).select("actor_id", "month", F.array_join("countries", "; ").alias("countries"))


@query(_sets_sql(6) + f""", meta as (select actorid as actor_id, list_distinct(list_filter(list_transform(string_split(coalesce(actor_location, ''), ','), lambda c: trim(c)), lambda c: c <> '')) as places from actor),
ch as (select s.actor_id, s.month, case when len(countries) > 0 then countries when len(coalesce(places, [])) > 0 then places else [] end as c, case when len(countries) > 0 then 'rolling' when len(coalesce(places, [])) > 0 then 'metadata' else 'empty_no_metadata' end as source from sets s left join meta on meta.actor_id = s.actor_id),
d as (select country, {_MO} as month, coalesce(sum(best), 0.0) as deaths from ev where day is not null group by 1, 2)
select ch.actor_id, ch.month, ch.source, coalesce(sum(d.deaths), 0.0) as fatalities from (select actor_id, month, source, unnest(case when len(c) = 0 then [null] else c end) as country from ch) ch left join d on d.country = ch.country and d.month = ch.month group by 1, 2, 3""")
def risk_set_fallback(spark, folder):
    ev = _events(spark, folder)
    meta = table(spark, folder, "actor").select(F.col("actorid").alias("actor_id"), p.places(F.col("actor_location")).alias("places"))
    return p.risk_fatalities(p.lookback_sets(ev, FIRST, LAST, 6), ev, meta)


_KEYS = [("front", 492, None, "2021-08-15"), ("front", 1423, "2021-08-15", None), ("army", 240, None, None), ("army", 352, "2020-01-01", "2023-01-01")]


@query(f"""with {_E}, {_SIDES}, k as (select * from (values {', '.join(f"('{k}', {i}, {f"date '{a}'" if a else 'null::date'}, {f"date '{b}'" if b else 'null::date'})" for k, i, a, b in _KEYS)}) v(actor_key, actor_id, valid_from, valid_to))
select distinct actor_key, id, day, best from sides join k on k.actor_id = sides.actor_id where day >= coalesce(valid_from, date '0001-01-01') and day < coalesce(valid_to, date '9999-12-31')""")
def temporal_identity_join(spark, folder):
    rows = [(k, i, a, b) for k, i, a, b in _KEYS]
    ids = spark.createDataFrame(rows, "actor_key string, actor_id long, a string, b string").select("actor_key", "actor_id", F.col("a").cast("date").alias("valid_from"), F.col("b").cast("date").alias("valid_to"))
    return p.identity_join(p.by_side(_events(spark, folder)), F.broadcast(ids))


@query(f"""with {_E}, {_SIDES}, ok as (select * from sides where actor_id is not null and latitude between -90 and 90 and longitude between -180 and 180 and trim(coalesce(country, '')) <> '' and trim(coalesce(adm_1, '')) <> '')
select actor_id, country, adm_1, latitude, longitude from (select *, row_number() over (partition by actor_id, country, adm_1 order by coalesce(where_prec, 99), coalesce(day, date '9999-12-31'), id) as rn from ok) where rn = 1""")
def representative_regions(spark, folder):
    return p.first_region(p.by_side(_events(spark, folder)))


@query()
def risk_region_features(spark, folder):
    return p.risk_features(p.first_region(p.by_side(_events(spark, folder))))


_LAB = "lower(trim(coalesce({0}, '')))"


@query(f"""with w as (select *, 1.0 / count(*) over (partition by globaleventid) as weight from inter_annotator), g as (select coding_round, count(*) as n_rows, sum(weight) as weight,
sum(case when {_LAB.format('any_fatalities_mentioned_coder_1')} = 'yes' then weight else 0.0 end) as f, sum(case when {_LAB.format('any_weapon_mentioned_coder_1')} = 'yes' then weight else 0.0 end) as w,
sum(case when {_LAB.format('conflict_relevance_coder_1')} = 'direct' then weight else 0.0 end) as d, sum(case when {_LAB.format('conflict_relevance_coder_1')} = 'irrelevant' then weight else 0.0 end) as i from w group by 1)
select coding_round, n_rows, weight, f / weight as share_fatal, w / weight as share_weapon, d / weight as share_relevance_direct, i / weight as share_relevance_irrelevant from g""")
def weighted_label_shares(spark, folder):
    i = table(spark, folder, "inter_annotator").withColumn("w", F.lit(1.0) / F.count(F.lit(1)).over(Window.partitionBy("globaleventid")))
    return p.label_shares(i, ["coding_round"], F.col("w"), {"fatal": (F.col("any_fatalities_mentioned_coder_1"), "yes"), "weapon": (F.col("any_weapon_mentioned_coder_1"), "yes")},
                          {"relevance": (F.col("conflict_relevance_coder_1"), ("direct", "irrelevant"))})


_PAIRS = f"pairs as (select coding_round, {_LAB.format('conflict_relevance_coder_1')} as a, {_LAB.format('conflict_relevance_coder_2')} as b from inter_annotator where {_LAB.format('conflict_relevance_coder_1')} <> '' and {_LAB.format('conflict_relevance_coder_2')} <> '')"


@query(f"""with {_PAIRS}, cell as (select coding_round, a, b, count(*) as n from pairs group by 1, 2, 3), tot as (select coding_round, sum(n) as n, sum(case when a = b then n else 0 end) as same from cell group by 1),
ma as (select coding_round, a as v, sum(n) as na from cell group by 1, 2), mb as (select coding_round, b as v, sum(n) as nb from cell group by 1, 2),
x as (select ma.coding_round, sum(na * nb) as x from ma join mb on mb.coding_round = ma.coding_round and mb.v = ma.v group by 1)
select t.coding_round, cast(t.n as bigint) as n, same / t.n as agreement, (same / t.n - x / (t.n * t.n)) / (1 - x / (t.n * t.n)) as kappa from tot t join x on x.coding_round = t.coding_round""")
def kappa_multiclass(spark, folder):
    return m.kappa(m.paired(table(spark, folder, "inter_annotator"), F.col("conflict_relevance_coder_1"), F.col("conflict_relevance_coder_2")), ["coding_round"])


@query(f"""with pairs as (select coding_round, {_LAB.format('any_fatalities_mentioned_coder_1')} as a, {_LAB.format('any_fatalities_mentioned_coder_2')} as b from inter_annotator where {_LAB.format('any_fatalities_mentioned_coder_1')} <> '' and {_LAB.format('any_fatalities_mentioned_coder_2')} <> ''),
c as (select coding_round, count(*) filter (a = 'yes' and b = 'yes') as tp, count(*) filter (a <> 'yes' and b <> 'yes') as tn, count(*) filter (a <> 'yes' and b = 'yes') as fp, count(*) filter (a = 'yes' and b <> 'yes') as fn, count(*) as n from pairs group by 1),
e as (select *, (tp + tn) / n as acc, ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / (n * n) as ex from c)
select coding_round, tp, tn, fp, fn, tp / nullif(tp + fp, 0) as precision, tp / nullif(tp + fn, 0) as recall, 2 * tp / nullif(2 * tp + fp + fn, 0) as f1, acc as accuracy, (acc - ex) / (1 - ex) as kappa, fp / nullif(fp + tn, 0) as fpr from e""")
def confusion_and_metrics(spark, folder):
    pairs = m.paired(table(spark, folder, "inter_annotator"), F.col("any_fatalities_mentioned_coder_1"), F.col("any_fatalities_mentioned_coder_2"))
    return m.confusion(pairs, ["coding_round"], "yes")


@query(f"""with c as (select coder_1_id, count(*) as n, count(*) filter ({_LAB.format('any_fatalities_mentioned_coder_1')} = 'yes') as k from inter_annotator group by 1)
select coder_1_id, n, k, k / n as raw_share, least(greatest((k / n - 0.15) / (0.9 - 0.15), 0.0), 1.0) as calibrated_share,
((k / n) + 1.96 * 1.96 / (2.0 * n)) / (1 + 1.96 * 1.96 / n) - 1.96 * sqrt((k / n) * (1 - k / n) / n + 1.96 * 1.96 / (4.0 * n * n)) / (1 + 1.96 * 1.96 / n) as wilson_low,
((k / n) + 1.96 * 1.96 / (2.0 * n)) / (1 + 1.96 * 1.96 / n) + 1.96 * sqrt((k / n) * (1 - k / n) / n + 1.96 * 1.96 / (4.0 * n * n)) / (1 + 1.96 * 1.96 / n) as wilson_high from c""")
def calibrated_share(spark, folder):
    c = table(spark, folder, "inter_annotator").groupBy("coder_1_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(t.label_form(F.col("any_fatalities_mentioned_coder_1")) == "yes").alias("k"))
    low, high = maths.wilson(F.col("k"), F.col("n"))
    return c.withColumn("raw_share", F.col("k") / F.col("n")).withColumns({"calibrated_share": maths.calibrated(F.col("raw_share"), 0.9, 0.15), "wilson_low": low, "wilson_high": high})


@query(f"""with d as (select coding_round, coder_1_id, abs(count(*) filter ({_LAB.format('any_fatalities_mentioned_coder_1')} = 'yes') - 0.4 * count(*)) / count(*) as p from inter_annotator group by 1, 2),
r as (select *, row_number() over (partition by coding_round order by p, coder_1_id) as r, count(*) over (partition by coding_round) as m from d), q as (select *, p * m / r as q from r)
select coding_round, coder_1_id, p, least(1.0, min(q) over (partition by coding_round order by r desc rows unbounded preceding)) as p_fdr from q""")
def fdr_bh(spark, folder):
    """A number between 0 and 1 per coder and round stands for a p value; rounds are families."""
    yes = F.count_if(t.label_form(F.col("any_fatalities_mentioned_coder_1")) == "yes")
    n = F.count(F.lit(1))
    tests = table(spark, folder, "inter_annotator").groupBy("coding_round", "coder_1_id").agg((F.abs(yes - 0.4 * n) / n).alias("p"))
    return m.bh_adjusted(tests, ["coding_round"], "p", ["coder_1_id"]).select("coding_round", "coder_1_id", "p", "p_fdr")


@query(f"""{_PANEL}, r as (select actor_id, rank() over (partition by actor_id order by n_events) + (count(*) over (partition by actor_id, n_events) - 1) / 2.0 as rx, rank() over (partition by actor_id order by fatalities) + (count(*) over (partition by actor_id, fatalities) - 1) / 2.0 as ry from bal)
select actor_id, corr(rx, ry) as spearman, count(*) as n from r group by 1""")
def spearman_by_actor(spark, folder):
    return m.spearman(_panel(spark, folder), ["actor_id"], "n_events", "fatalities")


@query(f"""{_PANEL}, l as (select actor_id, y, lag(y) over w as y1, lag(y, 2) over w as y2, lag(y, 3) over w as y3 from bal window w as (partition by actor_id order by month)),
c as (select actor_id, corr(y, y1) as c1, corr(y, y2) as c2, corr(y, y3) as c3 from l group by 1) select actor_id, 1 as lag, c1 as acf from c union all select actor_id, 2, c2 from c union all select actor_id, 3, c3 from c""")
def acf_by_actor(spark, folder):
    return m.autocorrelation(_panel(spark, folder), "actor_id", "month", "y", 3)


@query(f"""with l as (select case when coded_at < timestamp '2025-07-01' then 'pre' else 'post' end as regime, unnest([struct_pack(label := 'fatal', v := {_LAB.format('any_fatalities_mentioned_coder_1')}), struct_pack(label := 'weapon', v := {_LAB.format('any_weapon_mentioned_coder_1')})]) as l from inter_annotator),
g as (select l.label as label, regime, count(*) as n, count(*) filter (l.v = 'yes') as k, count(*) filter (l.v not in ('unclear', '', '?')) as c from l group by 1, 2)
select label, regime, n, k / n as positive_share, k / nullif(c, 0) as clear_share, (n - c) / n as unresolved_share from g""")
def regime_summary(spark, folder):
    regime = F.when(F.col("coded_at") < F.lit("2025-07-01").cast("timestamp"), "pre").otherwise("post")
    return m.regime_shares(table(spark, folder, "inter_annotator"), regime, {"fatal": F.col("any_fatalities_mentioned_coder_1"), "weapon": F.col("any_weapon_mentioned_coder_1")})


@query("""with c as (select eventrootcode as v, count(*) filter (sqldate < 20220101) as na, count(*) filter (sqldate >= 20220101) as nb from articles_raw group by 1),
p as (select na / sum(na) over () as p, nb / sum(nb) over () as q from c)
select sqrt(0.5 * sum(case when p > 0 then p * log2(p / ((p + q) / 2)) else 0.0 end) + 0.5 * sum(case when q > 0 then q * log2(q / ((p + q) / 2)) else 0.0 end)) as js_distance, max(abs(p - q) * 100) as max_change_pp from p""")
def category_divergence(spark, folder):
    side = F.when(F.col("sqldate") < 20220101, "pre").otherwise("post")
    return m.divergence(table(spark, folder, "articles_raw").where("sqldate is not null"), side, F.col("eventrootcode"), "pre", "post")


@query(f"""{_PANEL} select actor_id, count(*) as n_periods, median(fatalities) as median_fatalities, min(fatalities) as least, max(fatalities) as most, stddev_samp(fatalities) as sd, quantile_cont(fatalities, 0.025) as q025, quantile_cont(fatalities, 0.975) as q975, avg(case when fatalities = 0 then 1.0 else 0.0 end) as zero_share from bal group by 1""")
def sample_summary(spark, folder):
    q = F.percentile("fatalities", F.array(F.lit(0.025), F.lit(0.975)))
    return _panel(spark, folder).groupBy("actor_id").agg(
        F.count(F.lit(1)).alias("n_periods"), F.median("fatalities").alias("median_fatalities"), F.min("fatalities").alias("least"), F.max("fatalities").alias("most"), F.stddev_samp("fatalities").alias("sd"),
        q[0].alias("q025"), q[1].alias("q975"), F.avg(F.when(F.col("fatalities") == 0, 1.0).otherwise(0.0)).alias("zero_share"))


@query(f"{_PANEL} select actor_id, month, avg(y) over (partition by actor_id order by month rows between 1 preceding and 1 following) as smooth from bal")
def centered_mean(spark, folder):
    w = Window.partitionBy("actor_id").orderBy("month").rowsBetween(-1, 1)
    return _panel(spark, folder).select("actor_id", "month", F.avg("y").over(w).alias("smooth"))
