"""Queries on names, lexicon, groups and collapses."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.functions import text as t
from weftline.operators import acquire as a
from weftline.operators import entities as e
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


_ONCE = "once as (select * exclude (rn) from (select *, row_number() over (partition by globaleventid order by scraped_at desc nulls last) as rn from articles_raw) where rn = 1)"
_BROAD = ", ".join(f"'{v}'" for v in t.BROAD_ALIASES)
_VAGUE = ", ".join(f"'{v}'" for v in t.VAGUE_TERMS)
_TERMS = f"""stacked as (select cast(actorid as varchar) as actor_id, 'namedata' as source_column, namedata as raw from actor union all select cast(actorid as varchar), 'nameorigfulleng', nameorigfulleng from actor),
parts as (select actor_id, source_column, trim(unnest(regexp_split_to_array(coalesce(raw, ''), '(?i)\\s*[;,/|:]\\s*|\\s+\\baka\\b\\s+|\\s+\\ba\\.k\\.a\\.\\s+'))) as term from stacked),
terms as (select distinct actor_id, source_column, term from parts where term <> '' and length(term) >= 3 and lower(term) not in ({_VAGUE}) and not regexp_full_match(term, '\\d+') and not starts_with(lower(term), 'government of '))"""


def _phrase(c: str) -> str:
    return f"regexp_replace(trim(regexp_replace(regexp_replace(replace(strip_accents(lower(coalesce({c}, ''))), '&', ' and '), '[''’]', '', 'g'), '[^a-z0-9]+', ' ', 'g')), '^(the|a|an) ', '')"


def _keys(c: str, short: str) -> str:
    p = _phrase(c)
    compact = f"replace({p}, ' ', '')"
    acro = f"case when len(string_split({p}, ' ')) >= 2 and len(list_filter(string_split({p}, ' '), lambda w: length(w) <> 1)) = 0 then {compact} when {short.format(compact=compact)} then {compact} else '' end"
    return f"unnest([struct_pack(kind := 'phrase', key := {p}), struct_pack(kind := 'compact', key := {compact}), struct_pack(kind := 'acronym', key := {acro})])"


_MATCH = f"""{_TERMS},
tk as (select distinct term, actor_id, k.kind as kind, k.key as key from (select term, actor_id, {_keys('term', "term not like '% %' and length(term) <= 4")} as k from terms) where k.key <> ''),
{_ONCE}, stack as (select globaleventid, 'actor1' as side, actor1name as name from once union all select globaleventid, 'actor2', actor2name from once),
asked as (select name, k.kind as kind, k.key as key from (select name, {_keys('name', "length({compact}) <= 4")} as k from (select distinct name from stack where trim(name, ' ') <> '')) where k.key <> ''),
hits as (select name, actor_id, min(struct_pack(o := case asked.kind when 'phrase' then 0 when 'compact' then 1 else 2 end, kind := asked.kind, term := tk.term)) as b from asked join tk on tk.kind = asked.kind and tk.key = asked.key group by 1, 2),
matches as (select s.globaleventid, s.side, s.name, h.actor_id, h.b.kind as kind, h.b.term as term from stack s join hits h on h.name = s.name)"""


def _lexicon(spark, folder):
    return e.lexicon(table(spark, folder, "actor"), "actorid", ("namedata", "nameorigfulleng"), "ucdp")


def _matches(spark, folder):
    names = a.once_per_article(table(spark, folder, "articles_raw")).select("globaleventid", "actor1name", "actor2name")
    return e.strict_matches(names, e.lexicon_keys(_lexicon(spark, folder)), "globaleventid", {"actor1": "actor1name", "actor2": "actor2name"})


@query(f"""with {_TERMS} select sha1(concat_ws('||', 'ucdp', actor_id, source_column, term)) as term_id, term, lower(term) as term_lower, 'ucdp' as source_dataset, source_column, actor_id,
term not like '% %' as is_single_token, length(term) as term_len, term not like '% %' and length(term) <= 4 as is_short_single_token from terms""")
def actor_terms(spark, folder):
    return _lexicon(spark, folder)


@query(f"with {_MATCH} select * from matches")
def strict_matches(spark, folder):
    return _matches(spark, folder)


@query(f"""with {_MATCH}, n as (select name, count(distinct actor_id) as n_actors from matches group by 1)
select m.name, m.actor_id, m.kind, n.n_actors, count(*) as n_rows, {_phrase('m.name')} not in ({_BROAD}) as high_confidence,
coalesce(nullif(concat_ws(';', case when {_phrase('m.name')} in ({_BROAD}) then 'suspicious_broad_or_geographic_alias' end, case when n_actors > 1 then 'alias_maps_to_multiple_rebel_ids' end), ''), 'clean_exact_alias') as review
from matches m join n on n.name = m.name group by all""")
def ambiguous_aliases(spark, folder):
    m = e.ambiguity(_matches(spark, folder))
    return m.groupBy("name", "actor_id", "kind", "n_actors", "review", "high_confidence").agg(F.count(F.lit(1)).alias("n_rows"))


@query(f"""with {_MATCH}, per as (select actor_id, count(*) as n_matches, count(distinct globaleventid) as n_articles, count(*) filter (side = 'actor1') as n_side1 from matches group by 1)
select p.actor_id, n_matches, n_articles, n_side1, n_matches / sum(n_matches) over () as share, a.nameorigfulleng as full_name, a.actor_location from per p left join actor a on cast(a.actorid as varchar) = p.actor_id""")
def actor_summary(spark, folder):
    per = _matches(spark, folder).groupBy("actor_id").agg(F.count(F.lit(1)).alias("n_matches"), F.count_distinct("globaleventid").alias("n_articles"), F.count_if(F.col("side") == "actor1").alias("n_side1"))
    per = per.withColumn("share", F.col("n_matches") / F.sum("n_matches").over(Window.partitionBy()))
    return e.enriched(per, (table(spark, folder, "actor"), "actorid", ("nameorigfulleng", "actor_location"))).withColumnRenamed("nameorigfulleng", "full_name")


@query(f"""with {_MATCH}, c as (select actor_id, term as value, count(*) as n from matches group by 1, 2) select actor_id, value, n from (select *, row_number() over (partition by actor_id order by n desc, value) as rn from c) where rn = 1""")
def frequent_alias(spark, folder):
    return e.frequent(_matches(spark, folder), ["actor_id"], "term")


_PLAIN = "regexp_replace(trim(coalesce(cast({0} as varchar), '')), '\\.0+$', '')"
_GROUPS = f"""one as (select {_PLAIN.format('constituent_ucdp_actor_id')} as id, min(struct_pack(k := analysis_actor_key, n := analysis_actor_name, r := {_PLAIN.format('representative_ucdp_actor_id')})) as g from actor_group_crosswalk where {_PLAIN.format('constituent_ucdp_actor_id')} <> '' group by 1),
ged as (select distinct id as event_id, {_PLAIN.format('side_a_new_id')} as id, country from ged_event where id is not null),
joined as (select ged.event_id, ged.id, ged.country, coalesce(one.g.k, ged.id) as group_key, one.g.n as group_name, coalesce(one.g.r, ged.id) as representative_id from ged left join one on one.id = ged.id)"""


def _grouped(spark, folder):
    ged = table(spark, folder, "ged_event").where("id is not null").select(F.col("id").alias("event_id"), e.plain_id(F.col("side_a_new_id")).alias("id"), "country").distinct()
    return e.grouped(ged, table(spark, folder, "actor_group_crosswalk"), "id")


@query(f"with {_GROUPS} select group_key, group_name, representative_id, count(*) as n_events, count(distinct id) as n_ids from joined group by 1, 2, 3")
def crosswalk_grouping(spark, folder):
    return _grouped(spark, folder).groupBy("group_key", "group_name", "representative_id").agg(F.count(F.lit(1)).alias("n_events"), F.count_distinct("id").alias("n_ids"))


@query(f"""with {_GROUPS}, n as (select country from joined group by 1 having count(distinct group_key) > 0), many as (select event_id from joined group by 1 having count(distinct group_key) = 1)
select j.event_id, j.group_key, j.country from joined j where j.event_id in (select event_id from many)""")
def multi_actor_exclusion(spark, folder):
    return e.without_several(_grouped(spark, folder), "event_id", "group_key").select("event_id", "group_key", "country")


@query(f"""with {_ONCE} select domain, count(*) as n_rows, coalesce(array_to_string(list_sort(list_distinct(list(actiongeo_countrycode) filter (trim(actiongeo_countrycode) <> ''))), '; '), '') as actiongeo_countrycode_list,
(case when count(distinct eventcode) > 5 then array_to_string(list_slice(list_sort(list_distinct(list(eventcode) filter (trim(eventcode) <> ''))), 1, 5), '; ') || '; ... (+' || cast(count(distinct eventcode) - 5 as varchar) || ')'
 else coalesce(array_to_string(list_sort(list_distinct(list(eventcode) filter (trim(eventcode) <> ''))), '; '), '') end) as eventcode_list, count(distinct eventrootcode) as n_eventrootcode,
 arg_min(actor1name, globaleventid) filter (trim(coalesce(actor1name, ''), ' ') <> '') as actor1name from once group by domain""")
def collapse_join_unique(spark, folder):
    return e.collapse(a.once_per_article(table(spark, folder, "articles_raw")), ["domain"], [F.col("globaleventid")], ["actor1name"], {"actiongeo_countrycode": None, "eventcode": 5}, ["eventrootcode"])


@query("""with k as (select globaleventid, coding_round from inter_annotator group by 1, 2 having count(*) > 1) select i.globaleventid, i.coding_round, count(*) as n_rows from inter_annotator i join k on k.globaleventid = i.globaleventid and k.coding_round = i.coding_round group by 1, 2""")
def duplicate_keys(spark, folder):
    return e.repeated_keys(table(spark, folder, "inter_annotator"), ["globaleventid", "coding_round"]).groupBy("globaleventid", "coding_round").agg(F.count(F.lit(1)).alias("n_rows"))


@query("""select globaleventid, coding_round, coder_1_id, coded_at from (select *, row_number() over (partition by globaleventid, coding_round order by coded_at desc nulls last, coder_1_id, coder_2_id) as rn from inter_annotator) where rn = 1""")
def label_dedup_last(spark, folder):
    return a.latest(table(spark, folder, "inter_annotator"), ["globaleventid", "coding_round"], [F.col("coded_at").desc_nulls_last(), F.col("coder_1_id"), F.col("coder_2_id")]).select(
        "globaleventid", "coding_round", "coder_1_id", "coded_at")


@query("""select globaleventid from inter_annotator where coder_1_id = 'c01' intersect select globaleventid from inter_annotator where coder_1_id = 'c12'""")
def annotator_overlap(spark, folder):
    return e.overlap(table(spark, folder, "inter_annotator"), "globaleventid", "coder_1_id", "c01", "c12")


@query("""with old as (select distinct globaleventid, coding_round, coder_1_id as coder, any_fatalities_mentioned_coder_1 as label from inter_annotator where coding_round <= 2),
new as (select distinct globaleventid, 1 as coding_round, 'review' as coder, 'yes' as label from inter_annotator where coding_round = 3)
select * from old o where not exists (select 1 from new n where n.globaleventid = o.globaleventid and n.coding_round = o.coding_round) union all select * from new""")
def label_upsert(spark, folder):
    i = table(spark, folder, "inter_annotator")
    old = i.where("coding_round <= 2").select("globaleventid", "coding_round", F.col("coder_1_id").alias("coder"), F.col("any_fatalities_mentioned_coder_1").alias("label")).distinct()
    new = i.where("coding_round = 3").select("globaleventid", F.lit(1).alias("coding_round"), F.lit("review").alias("coder"), F.lit("yes").alias("label")).distinct()
    return e.upserted(old, new, ["globaleventid", "coding_round"])
