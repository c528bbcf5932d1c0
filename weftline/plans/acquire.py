"""Queries on event and mention tables with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.functions import dates, text, urls
from weftline.operators import acquire as a
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


_ONCE = """once as (select * exclude (rn) from (select *, row_number() over (partition by globaleventid order by scraped_at desc nulls last) as rn from articles_raw) where rn = 1)"""
_DAY = "cast(try_strptime(cast(sqldate as varchar), '%Y%m%d') as date)"
_TRUE = "lower(trim(coalesce(involves_rebel, ''))) in ('1', 'true', 'yes', 'y', 'on')"
_MOMENT = "try_strptime(case when length(cast({0} as varchar)) = 14 then cast({0} as varchar) end, '%Y%m%d%H%M%S')"
_HOST = "nullif(regexp_replace(lower(regexp_extract(trim({0}), '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1)), '^www\\.', ''), '')"
_URL = ("case when trim({0}) = '' then null when " + _HOST + " is null then trim({0}) else "
        "concat(case when lower(regexp_extract(trim({0}), '^([A-Za-z][A-Za-z0-9+.\\-]*)://', 1)) in ('http', 'https') then 'https' else lower(regexp_extract(trim({0}), '^([A-Za-z][A-Za-z0-9+.\\-]*)://', 1)) end, '://', coalesce(" + _HOST + ", ''), "
        "regexp_replace(regexp_extract(trim({0}), '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*([^?#]*)', 1), '/+$', ''), "
        "case when len(list_filter(string_split(regexp_extract(trim({0}), '^[^?#]*\\?([^#]*)', 1), '&'), lambda p: not regexp_full_match(regexp_extract(lower(p), '^([^=]*)', 1), 'utm_.*|fbclid|gclid|mc_.*') and regexp_matches(p, '^[^=]+=.+'))) > 0 "
        "then '?' || array_to_string(list_filter(string_split(regexp_extract(trim({0}), '^[^?#]*\\?([^#]*)', 1), '&'), lambda p: not regexp_full_match(regexp_extract(lower(p), '^([^=]*)', 1), 'utm_.*|fbclid|gclid|mc_.*') and regexp_matches(p, '^[^=]+=.+')), '&') else '' end) end")
_PAGE = "not regexp_matches(lower(coalesce({0}, '')), '\\.(jpg|jpeg|png|gif|webp|pdf)(\\?|$)')"
_ORDER = ("coalesce(confidence, 0) desc, coalesce(mentiondoclen, 0) desc, coalesce(sentenceid, 9999), mentionidentifier nulls last, mentiontimedate nulls last, "
          "mentionsourcename nulls last, coalesce(mentiondoctone, 0), coalesce(mentiontype, 0)")
_SCORE = ("100.0 * (case when coalesce(url = own_url, false) then 1 else 0 end) + 20.0 * (case when coalesce(mentiontype, 0) = 1 then 1 else 0 end) + coalesce(confidence, 0) "
          "+ least(greatest(coalesce(mentiondoclen, 0) / 1000.0, 0.0), 20.0) + 0.1 * (100 - least(greatest(coalesce(sentenceid, 9999), 0), 100))")


@query(f"""with {_ONCE}, w as (select *, cast(date_trunc('week', {_DAY}) as date) as week_start from once where trim(coalesce(actiongeo_countrycode, '')) <> '')
select actiongeo_countrycode, week_start, count(*) as n_events, count(*) filter ({_TRUE}) as n_rebel, avg(avgtone) as mean_tone, median(goldsteinscale) as median_scale,
  cast(sum(nummentions) as bigint) as n_mentions, max(numsources) as max_sources, count(*) filter ({_TRUE}) / count(*) as rebel_share, extract(week from week_start) as iso_week
from w where week_start is not null group by 1, 2""")
def country_week_panel(spark: SparkSession, folder: str) -> DataFrame:
    return a.week_panel(a.once_per_article(table(spark, folder, "articles_raw")))


@query(f"""with {_ONCE} select actiongeo_countrycode, count(*) filter (quadclass = 1) as quad_1, count(*) filter (quadclass = 2) as quad_2,
count(*) filter (quadclass = 3) as quad_3, count(*) filter (quadclass = 4) as quad_4 from once group by 1""")
def quadclass_pivot(spark, folder):
    return a.count_pivot(a.once_per_article(table(spark, folder, "articles_raw")), ["actiongeo_countrycode"], "quadclass", (1, 2, 3, 4), "quad_")


@query("""select globaleventid, sqldate, eventcode, count(*) as n_rows from articles_raw where sqldate >= 20210101 and sqldate < 20230701 and numarticles > 1
and (eventrootcode in ('18', '19', '20') or eventbasecode in ('036', '138') or eventcode in ('036', '138'))
and (regexp_matches(lower(coalesce(actor1name, '')), '(^|[^a-z0-9])(liberation|front|guard)([^a-z0-9]|$)') or regexp_matches(lower(coalesce(actor2name, '')), '(^|[^a-z0-9])(liberation|front|guard)([^a-z0-9]|$)'))
group by 1, 2, 3""")
def partition_window_scan(spark, folder):
    kept = a.event_scan(table(spark, folder, "articles_raw"), 20210101, 20230701, ("18", "19", "20"), ("036", "138"), ("front", "liberation", "guard"))
    return kept.groupBy("globaleventid", "sqldate", "eventcode").agg(F.count(F.lit(1)).alias("n_rows"))


@query("""select globaleventid, eventcode, sqldate from articles_raw where lower(coalesce(actor1countrycode, '')) in ('anv', 'hos') or lower(coalesce(actor2countrycode, '')) in ('anv', 'hos') group by all""")
def code_membership(spark, folder):
    return table(spark, folder, "articles_raw").where(a.any_of(["actor1countrycode", "actor2countrycode"], ["ANV", "HOS"])).select("globaleventid", "eventcode", "sqldate").distinct()


@query(f"""select globaleventid, mentionidentifier, confidence, candidate_rank from (
select *, row_number() over (partition by globaleventid order by {_ORDER}) as candidate_rank from (select distinct * from mention)
where mentiontimedate = eventtimedate and {_PAGE.format('mentionidentifier')}) where candidate_rank <= 3""")
def topk_mentions_per_event(spark, folder):
    m = a.first_window(table(spark, folder, "mention").distinct()).where(urls.is_page(F.col("mentionidentifier")))
    return a.top_per_key(m, ["globaleventid"], a.mention_order(), 3).select("globaleventid", "mentionidentifier", "confidence", "candidate_rank")


@query(f"""with t as (select *, datesub('minute', {_MOMENT.format('eventtimedate')}, {_MOMENT.format('mentiontimedate')}) as gap,
  {_MOMENT.format('mentiontimedate')} >= {_MOMENT.format('eventtimedate')} as later from (select distinct * from mention))
select globaleventid, """ + ", ".join(f"count(*) filter (later and gap <= {m}) as n_mentions_{m}m, count(distinct mentionsourcename) filter (later and gap <= {m}) as n_sources_{m}m, "
                                       f"count(distinct mentionidentifier) filter (later and gap <= {m} and mentiontype = 1) as n_pages_{m}m" for m in (15, 60, 1440)) + " from t group by 1")
def windowed_conditional_counts(spark, folder):
    return a.timed_counts(table(spark, folder, "mention").distinct())


@query(f"select distinct final_url, {_URL.format('final_url')} as url, {_HOST.format('final_url')} as domain, (lower(coalesce(final_url, '')) like '%.pdf' or lower(coalesce(final_url, '')) like '%.pdf?%') as pdf from articles_raw")
def url_normalize(spark, folder):
    u = F.col("final_url")
    return table(spark, folder, "articles_raw").select(u, urls.normal_url(u).alias("url"), urls.host(u).alias("domain"), urls.is_pdf(u).alias("pdf")).distinct()


_CAND = f"""{_ONCE}, own as (select globaleventid, {_URL.format('used_url')} as own_url, {_PAGE.format('used_url')} as own_page from once),
told as (select m.globaleventid, {_URL.format('mentionidentifier')} as url, mentiontype, confidence, mentiondoclen, sentenceid from mention m where {_PAGE.format('mentionidentifier')}),
scored as (select t.globaleventid, url, max({_SCORE}) as candidate_score, bool_or(coalesce(url = own_url, false)) as is_primary from told t join own o on o.globaleventid = t.globaleventid where url is not null group by 1, 2),
every as (select globaleventid, url, candidate_score, is_primary from scored union all
  select o.globaleventid, own_url, 100.0, true from own o where own_url is not null and own_page and not exists (select 1 from scored s where s.globaleventid = o.globaleventid and s.is_primary)),
hosted as (select *, {_HOST.format('url')} as domain from every),
best as (select * from (select *, row_number() over (partition by globaleventid, domain order by candidate_score desc, url) as rn from hosted) where rn = 1),
ranked as (select globaleventid, url, domain, candidate_score, is_primary, row_number() over (partition by globaleventid order by candidate_score desc, url) as candidate_rank from best)"""


@query(f"with {_CAND} select globaleventid, url, domain, candidate_score, is_primary, candidate_rank from ranked where candidate_rank <= 5")
def url_candidates_ranked(spark, folder):
    return a.url_candidates(a.once_per_article(table(spark, folder, "articles_raw")), table(spark, folder, "mention")).select(
        "globaleventid", "url", "domain", "candidate_score", "is_primary", "candidate_rank")


@query(f"""with {_CAND}, s as (select *, row_number() over (partition by globaleventid, domain order by is_primary desc, candidate_rank, url) as seq from ranked where candidate_rank <= 5)
select globaleventid, url, row_number() over (partition by globaleventid order by is_primary desc, seq > 1, candidate_rank, url) as diverse_rank from s""")
def domain_diverse_rank(spark, folder):
    c = a.url_candidates(a.once_per_article(table(spark, folder, "articles_raw")), table(spark, folder, "mention"))
    return a.diverse_rank(c).select("globaleventid", "url", "diverse_rank")


@query("""select globaleventid, min(used_candidate_rank) filter (http_status between 200 and 399) as success_rank,
coalesce(min(used_candidate_rank) filter (http_status between 200 and 399), max(used_candidate_rank)) as n_attempts from articles_raw group by 1""")
def candidate_fallback(spark, folder):
    return a.first_success(table(spark, folder, "articles_raw"), "globaleventid", "used_candidate_rank", F.col("http_status").between(200, 399))


@query(f"""with {_ONCE}, agg as (select globaleventid, count(*) as n, count(distinct mentionsourcename) as s from mention group by 1)
select o.globaleventid, coalesce(n, 0) as n_mentions, coalesce(s, 0) as n_sources from agg a right join once o on a.globaleventid = o.globaleventid""")
def right_join_padding(spark, folder):
    agg = table(spark, folder, "mention").groupBy("globaleventid").agg(F.count(F.lit(1)).alias("n_mentions"), F.count_distinct("mentionsourcename").alias("n_sources"))
    ids = a.once_per_article(table(spark, folder, "articles_raw")).select("globaleventid")
    return agg.join(ids, "globaleventid", "right").na.fill(0, ["n_mentions", "n_sources"])


@query("""select distinct globaleventid from articles_raw r where not exists (select 1 from inter_annotator i where i.globaleventid = r.globaleventid and i.any_fatalities_mentioned_coder_1 is not null)""")
def anti_resume(spark, folder):
    done = table(spark, folder, "inter_annotator").where("any_fatalities_mentioned_coder_1 is not null").select("globaleventid").distinct()
    return table(spark, folder, "articles_raw").select("globaleventid").distinct().join(done, "globaleventid", "left_anti")


@query("""select globaleventid, mentionidentifier, count(*) as n_rows from mention m where exists (select 1 from inter_annotator i where i.globaleventid = m.globaleventid) group by 1, 2""")
def semi_ids(spark, folder):
    ids = table(spark, folder, "inter_annotator").select("globaleventid").distinct()
    return table(spark, folder, "mention").join(ids, "globaleventid", "left_semi").groupBy("globaleventid", "mentionidentifier").agg(F.count(F.lit(1)).alias("n_rows"))


@query(f"with {_ONCE} select i.globaleventid, i.coding_round, i.coder_1_id, o.domain, o.sqldate from (select distinct globaleventid, coding_round, coder_1_id from inter_annotator) i left join once o on o.globaleventid = i.globaleventid")
def left_many_to_one(spark, folder):
    labels = table(spark, folder, "inter_annotator").select("globaleventid", "coding_round", "coder_1_id").distinct()
    return a.left_one(labels, a.once_per_article(table(spark, folder, "articles_raw")).select("globaleventid", "domain", "sqldate"), ["globaleventid"])


@query(f"with {_ONCE} select globaleventid, domain from once order by md5(cast(globaleventid as varchar) || '|42'), globaleventid limit 100")
def hash_sample(spark, folder):
    return a.hash_sample(a.once_per_article(table(spark, folder, "articles_raw")), "globaleventid", 42, 100).select("globaleventid", "domain")


@query("""select coalesce(http_status, -1) as http_status, count(*) as n, count(*) filter (length(coalesce(text, '')) < 200) as n_short, count(*) / sum(count(*)) over () as share from articles_raw group by 1""")
def failure_counts(spark, folder):
    g = table(spark, folder, "articles_raw").groupBy(F.coalesce("http_status", F.lit(-1)).alias("http_status")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.length(F.coalesce("text", F.lit(""))) < 200).alias("n_short"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


@query("""select count(distinct globaleventid) as n_events, count(distinct globaleventid) filter (http_status between 200 and 399) as n_success,
sum(used_candidate_rank) as n_attempts, count(distinct globaleventid) filter (http_status between 200 and 399) / count(distinct globaleventid) as success_rate from articles_raw""")
def scrape_summary(spark, folder):
    ok = F.col("http_status").between(200, 399)
    return table(spark, folder, "articles_raw").agg(
        F.count_distinct("globaleventid").alias("n_events"), F.count_distinct(F.when(ok, F.col("globaleventid"))).alias("n_success"), F.sum("used_candidate_rank").alias("n_attempts")
    ).withColumn("success_rate", F.col("n_success") / F.col("n_events"))


@query("""select final_url, count(*) as n from articles_raw where trim(coalesce(final_url, '')) <> '' group by 1 having count(*) > 1 order by n desc, final_url limit 10""")
def duplicate_urls(spark, folder):
    u = table(spark, folder, "articles_raw").where(F.trim(F.coalesce("final_url", F.lit(""))) != "")
    return u.groupBy("final_url").agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy(F.desc("n"), "final_url").limit(10)


@query(f"""with {_ONCE}, f as (select globaleventid, regexp_matches(lower(coalesce(actor1name, '') || ' ' || coalesce(actor2name, '')), '(^|[^a-z0-9])(front|army|guard)([^a-z0-9]|$)') as term, {_TRUE} as typed from once)
select concat_ws(';', case when term then 'actor_term' end, case when typed then 'type_code' end) as match_sources, count(*) as n, count(*) / sum(count(*)) over () as share from f group by 1""")
def match_sources(spark, folder):
    e = a.once_per_article(table(spark, folder, "articles_raw"))
    both = e.withColumn("_both", F.concat(F.coalesce("actor1name", F.lit("")), F.lit(" "), F.coalesce("actor2name", F.lit(""))))
    s = F.concat_ws(";", F.when(a.names_match(["_both"], ["front", "army", "guard"]), "actor_term"), F.when(text.truthy(F.col("involves_rebel")), "type_code"))
    return both.groupBy(s.alias("match_sources")).agg(F.count(F.lit(1)).alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


@query("""select mentionsourcename, count(*) as n_rows, count(distinct globaleventid) as n_events, min(mentiontimedate) as first_seen, max(mentiontimedate) as last_seen,
sum(mentiondoctone) as total_tone from mention group by 1""")
def mention_sources(spark, folder):
    return table(spark, folder, "mention").groupBy("mentionsourcename").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("globaleventid").alias("n_events"), F.min("mentiontimedate").alias("first_seen"),
        F.max("mentiontimedate").alias("last_seen"), F.sum("mentiondoctone").alias("total_tone"))
