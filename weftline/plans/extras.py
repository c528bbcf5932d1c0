"""Further queries: correlations, joint confusion states, dynamic pivots, work slices, language by function words, incremental windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import text as t
from weftline.functions import urls
from weftline.operators import acquire as a
from weftline.operators import entities as e
from weftline.operators import labeling, regress
from weftline.operators import measures as m
from weftline.plans.panels import _LAB, _PANEL, _panel
from weftline.plans.texts import _FORM
from weftline.session import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

# Common function words by language.
FUNCTION_WORDS = {
    "en": "the of and in to was with for that from said were", "es": "el los las de del que en para una con por", "fr": "les des du une est et dans pour avec sur ont",
    "de": "der die das und den von mit nach bei zu ein eine", "it": "gli della dei il di che con una per sono hanno", "pt": "os as dos das não uma com para em ao foram",
    "tr": "ve bir bu için ile sonra kadar olan günü", "ru": "и в на не что из при во с по его как", "uk": "і та у що з від до його біля після", "ar": "في من على إلى أن قرب بعد دون",
    "fa": "در از به را که با این برای است", "hi": "के में की ने को से और का है",
}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f
    return add


@query(f"{_PANEL}, l as (select actor_id, y, lag(y) over (partition by actor_id order by month) as p from bal) select actor_id, corr(y, p) as ar1 from l group by 1")
def ar1_by_actor(spark, folder):
    return regress.lagged_correlation(_panel(spark, folder), "actor_id", "month", "y")


@query("""with v as (select avgtone as a, goldsteinscale as b, cast(nummentions as double) as c from articles_raw where avgtone is not null and goldsteinscale is not null and nummentions is not null)
select 'tone-scale' as pair, corr(a, b) as r from v union all select 'tone-mentions', corr(a, c) from v union all select 'scale-mentions', corr(b, c) from v""")
def signal_correlation(spark, folder):
    v = table(spark, folder, "articles_raw").select(F.col("avgtone").alias("a"), F.col("goldsteinscale").alias("b"), F.col("nummentions").cast("double").alias("c")).dropna()
    one = v.agg(F.corr("a", "b").alias("x"), F.corr("a", "c").alias("y"), F.corr("b", "c").alias("z"))
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("pair"), F.col(c).alias("r")) for n, c in (("tone-scale", "x"), ("tone-mentions", "y"), ("scale-mentions", "z"))])).alias("p")).select("p.*")


def _bits_sql(seat: int) -> str:
    return " || ".join(f"(case when {_LAB.format(f'{f}_coder_{seat}')} = 'yes' then '1' else '0' end)" for f in ("any_fatalities_mentioned", "any_injuries_mentioned", "any_physical_violence_mentioned"))


@query(f"""with s as (select {_bits_sql(1)} as a, {_bits_sql(2)} as b from inter_annotator), c as (select a, b, count(*) as n from s group by 1, 2)
select a, b, n, n / sum(n) over (partition by a) as row_share from c""")
def joint_state_confusion(spark, folder):
    """Three yes/no labels of both seats as one of eight states each: counts and shares within the first seat's state."""
    fields = ("any_fatalities_mentioned", "any_injuries_mentioned", "any_physical_violence_mentioned")
    bits = lambda seat: F.concat(*[F.when(t.label_form(F.col(f"{f}_coder_{seat}")) == "yes", "1").otherwise("0") for f in fields])
    cells = table(spark, folder, "inter_annotator").groupBy(bits(1).alias("a"), bits(2).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    return cells.join(cells.groupBy("a").agg(F.sum("n").alias("s")), "a").select("a", "b", "n", (F.col("n") / F.col("s")).alias("row_share"))


@query("""select domain, count(*) filter (eventrootcode = '14') as root_14, count(*) filter (eventrootcode = '18') as root_18, count(*) filter (eventrootcode = '19') as root_19, count(*) filter (eventrootcode = '20') as root_20 from articles_raw where domain is not null group by 1""")
def root_code_pivot(spark, folder):
    return a.count_pivot(table(spark, folder, "articles_raw").where("domain is not null"), ["domain"], "eventrootcode", ("14", "18", "19", "20"), "root_")


@query("""select globaleventid, used_url from (select globaleventid, min(used_url) as used_url, row_number() over (order by globaleventid) - 1 as n from articles_raw group by 1) where n >= 50 and n < 150""")
def work_slice(spark, folder):
    """Items 50 to 149 of the work queue in the order of their ids."""
    once = table(spark, folder, "articles_raw").groupBy("globaleventid").agg(F.min("used_url").alias("used_url"))
    return e.slice_by_order(once, [F.col("globaleventid")], 50, 100)


_WORD_LISTS = ", ".join(f"('{k}', ['" + "', '".join(w.split()) + "'])" for k, w in FUNCTION_WORDS.items())


@query(f"""with d as (select doc_id, length(coalesce(text, '')) as n_chars, list_distinct(string_split({_FORM}, ' ')) as words from documents), h as (select doc_id, n_chars, lang, len(list_intersect(words, own)) as n from d, (values {_WORD_LISTS}) v(lang, own)),
b as (select doc_id, n_chars, max(n) as top from h group by 1, 2), w as (select b.doc_id, b.n_chars, b.top, count(*) as ties, min(lang) as lang from b join h on h.doc_id = b.doc_id and h.n = b.top group by 1, 2, 3)
select doc_id, n_chars, case when n_chars < 40 or top = 0 or ties > 1 then 'unknown' else lang end as language from w""")
def language_detect(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("n_chars"), labeling.function_word_language(F.col("text"), FUNCTION_WORDS).alias("language"))


@query(f"""select 'fatal' as field, count(*) as n, count(*) filter (a = b) as n_match, count(*) filter (a = b) / count(*) as share from (select {_LAB.format('any_fatalities_mentioned_coder_1')} as a, {_LAB.format('any_fatalities_mentioned_coder_2')} as b from inter_annotator)
union all select 'weapon', count(*), count(*) filter (a = b), count(*) filter (a = b) / count(*) from (select {_LAB.format('any_weapon_mentioned_coder_1')} as a, {_LAB.format('any_weapon_mentioned_coder_2')} as b from inter_annotator)""")
def label_comparison(spark, folder):
    i = table(spark, folder, "inter_annotator")
    both = i.select(F.explode(F.array(*[F.struct(F.lit(n).alias("field"), (t.label_form(F.col(f"{c}_coder_1")) == t.label_form(F.col(f"{c}_coder_2"))).alias("same")) for n, c in (("fatal", "any_fatalities_mentioned"), ("weapon", "any_weapon_mentioned"))])).alias("x")).select("x.*")
    g = both.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.count_if("same").alias("n_match"))
    return g.withColumn("share", F.col("n_match") / F.col("n"))


@query("""with h as (select mentionsourcename, mentionidentifier, nullif(lower(regexp_extract(trim(mentionidentifier), '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1)), '') as raw from (select distinct mentionsourcename, mentionidentifier from mention))
select raw as raw_host, count(*) as n_urls, count(distinct mentionsourcename) as n_sources from h group by 1""")
def host_summary(spark, folder):
    d = table(spark, folder, "mention").select("mentionsourcename", "mentionidentifier").distinct().withColumn("raw_host", urls.raw_host(F.col("mentionidentifier")))
    return d.groupBy("raw_host").agg(F.count(F.lit(1)).alias("n_urls"), F.count_distinct("mentionsourcename").alias("n_sources"))


@query(f"""with v as (select coder_1_id, {_LAB.format('any_physical_violence_mentioned_coder_1')} as a, {_LAB.format('any_physical_violence_mentioned_coder_2')} as b from inter_annotator where {_LAB.format('any_physical_violence_mentioned_coder_1')} <> '' and {_LAB.format('any_physical_violence_mentioned_coder_2')} <> '')
select coder_1_id, count(*) filter (a = 'yes' and b = 'yes') as tp, count(*) filter (a <> 'yes' and b = 'yes') as fp from v group by 1""")
def coder_rates(spark, folder):
    p = m.paired(table(spark, folder, "inter_annotator"), F.col("any_physical_violence_mentioned_coder_1"), F.col("any_physical_violence_mentioned_coder_2"))
    return m.confusion(p, ["coder_1_id"], "yes").select("coder_1_id", "tp", "fp")
