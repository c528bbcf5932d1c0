"""Queries on texts: features, flags, duplicates, chunks, labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.functions import text as t
from weftline.operators import acquire as a
from weftline.operators import dedup
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


_WS = r"[\s\x0B\x1C-\x1F\x85\p{Z}]+"
_FORM = rf"trim(regexp_replace(regexp_replace(replace(lower(coalesce(text, '')), '_', ' '), '[^\p{{L}}\p{{N}}\s\x0B\x1C-\x1F\x85\p{{Z}}]', ' ', 'g'), '{_WS}', ' ', 'g'))"
_SQUEEZED = rf"trim(regexp_replace(coalesce(text, ''), '{_WS}', ' ', 'g'))"
_WORDS = f"(case when {_FORM} = '' then 0 else len(string_split({_FORM}, ' ')) end)"
_HITS = "(" + " + ".join(f"(case when contains(lower(coalesce(text, '')), '{b}') then 1 else 0 end)" for b in t.BOILERPLATE) + ")"
_TIMES = "(" + " + ".join(f"cast((length(lower(coalesce(text, ''))) - length(replace(lower(coalesce(text, '')), '{b}', ''))) / {len(b)} as int)" for b in t.BOILERPLATE) + ")"
_SENT = "len(list_filter(regexp_split_to_array(coalesce(text, ''), '[.!?]+'), lambda p: trim(p, ' ') <> ''))"
_M = f"length(regexp_replace({_SQUEEZED}, '[^{t.MOJIBAKE}]', '', 'g'))"
_H = f"length(regexp_replace({_SQUEEZED}, '[^{t.SEVERE_MOJIBAKE}]', '', 'g'))"
_SEQ = f"len(regexp_extract_all({_SQUEEZED}, '{t.MOJIBAKE_SEQUENCE}'))"
_BAD = f"(({_SEQ} >= 3 and {_M} >= 3) or ({_M} >= 20 and {_M} / greatest(length({_SQUEEZED}), 1) >= 0.02) or ({_H} >= 8 and {_H} / greatest(length({_SQUEEZED}), 1) >= 0.01))"
_RATIO = f"(case when {_WORDS} > 0 then {_TIMES} / {_WORDS} else 0.0 end)"
_ONCE = "once as (select * exclude (rn) from (select *, row_number() over (partition by globaleventid order by scraped_at desc nulls last) as rn from articles_raw) where rn = 1)"


@query(f"select doc_id, length(coalesce(text, '')) as text_len, {_WORDS} as word_count, {_SENT} as sentence_count, {_HITS} as boilerplate_hits, round({_RATIO}, 6) as boilerplate_ratio, "
       f"nullif(sha1({_FORM}), sha1('')) as text_hash, (case when {_FORM} = '' then 0 else len(string_split({_FORM}, ' ')) end) as n_tokens from documents")
def text_clean_features(spark: SparkSession, folder: str) -> DataFrame:
    x = F.col("text")
    return table(spark, folder, "documents").select(
        "doc_id", F.length(F.coalesce(x, F.lit(""))).alias("text_len"), t.word_count(x).alias("word_count"), t.sentence_count(x).alias("sentence_count"),
        t.boilerplate_hits(x).alias("boilerplate_hits"), F.round(t.boilerplate_ratio(x), 6).alias("boilerplate_ratio"), t.text_key(x, None).alias("text_hash"), F.size(t.tokens(x)).alias("n_tokens"))


@query(f"""with f as (select doc_id, length(coalesce(text, '')) < 500 as flag_short_text, {_SENT} < 3 as flag_few_sentences, {_HITS} > 2 as flag_boilerplate_hits, {_RATIO} > 0.03 as flag_boilerplate_ratio, {_BAD} as flag_mojibake_text from documents)
select *, case when flag_short_text or flag_few_sentences or flag_boilerplate_hits or flag_boilerplate_ratio or flag_mojibake_text then 1 else 0 end as quality_bad_score,
concat_ws(',', case when flag_short_text then 'short_text' end, case when flag_few_sentences then 'few_sentences' end, case when flag_boilerplate_hits then 'boilerplate_hits' end,
 case when flag_boilerplate_ratio then 'boilerplate_ratio' end, case when flag_mojibake_text then 'mojibake_text' end) as quality_bad_reason from f""")
def quality_flags(spark, folder):
    return table(spark, folder, "documents").select("doc_id", *[c.alias(n) for n, c in t.quality_flags(F.col("text")).items()])


@query()
def boilerplate_sentence_filter(spark, folder):
    return a.once_per_article(table(spark, folder, "articles_raw")).select("globaleventid", t.mended(F.col("text")).alias("text")).select("globaleventid", t.content_sentences(F.col("text")).alias("clean_text"))


@query()
def mojibake_repair(spark, folder):
    return a.once_per_article(table(spark, folder, "articles_raw")).where(t.looks_misdecoded(F.col("text"))).select("globaleventid", t.mended(F.col("text")).alias("mended_text"))


@query(f"""with h as (select doc_id, nullif({_FORM}, '') as form from documents), s as (select form, min(doc_id) as class_id, count(*) as class_size from h where form is not null group by 1)
select h.doc_id, coalesce(s.class_id, h.doc_id) as class_id, coalesce(s.class_size, 1) as class_size from h left join s on s.form = h.form""")
def exact_duplicates(spark, folder):
    return dedup.exact_classes(table(spark, folder, "documents"))


def _pairs(source: str) -> str:
    return f"""forms as (select doc_id, {_FORM} as form from {source}), reps as (select min(doc_id) as id, string_split(form, ' ') as w from forms where form <> '' group by form having len(string_split(form, ' ')) >= 80),
sh as (select distinct id, len(w) as nw, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) as g from reps), size as (select id, any_value(nw) as nw, count(*) as n from sh group by 1),
common as (select a.id as id_1, b.id as id_2, count(*) as c from sh a join sh b on a.g = b.g and a.id < b.id group by 1, 2),
pairs as (select id_1, id_2, round(c / (x.n + y.n - c), 4) as similarity from common join size x on x.id = id_1 join size y on y.id = id_2 where c / (x.n + y.n - c) >= 0.85 and greatest(x.nw, y.nw) <= 1.6 * least(x.nw, y.nw))"""


def _classes(source: str) -> str:
    return f"""{_pairs(source)}, own as (select doc_id, coalesce(first_id, doc_id) as rep from forms left join (select form as f, min(doc_id) as first_id from forms where form <> '' group by 1) on f = form),
edges as (select id_1 as a, id_2 as b from pairs union select id_2, id_1 from pairs), reach as (select a, b from edges union select r.a, e.b from reach r join edges e on e.a = r.b),
roots as (select a, least(a, min(b)) as root from reach group by a), degree as (select a, count(*) as k from edges group by a),
classes as (select doc_id, coalesce(root, rep) as class_id, coalesce(k, 0) as n_links from own left join roots on roots.a = rep left join degree on degree.a = rep)"""


# Documents and, under other ids, a later version of each: without its first words, with a line added, so that near copies are there to be found.
_LATER = 1_000_000_000_000
_VERSIONS = f"""versions as (select doc_id, text, source, published_at from documents
union all select doc_id + {_LATER}, concat(regexp_replace(text, '^([^ ]+ ){{4}}', ''), ' Corrected version of this report'), source, published_at from documents)"""


def _versions(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "source", "published_at")
    later = F.concat(F.regexp_replace("text", "^([^ ]+ ){4}", ""), F.lit(" Corrected version of this report"))
    return docs.unionByName(docs.select((F.col("doc_id") + _LATER).alias("doc_id"), later.alias("text"), "source", "published_at"))


@query(f"with {_VERSIONS}, {_pairs('versions')} select id_1, id_2, similarity from pairs")
def near_duplicate_pairs(spark, folder):
    """Near copies among all documents and a later version of each."""
    return dedup.near_pairs(dedup.representatives(_versions(spark, folder)))


@query(f"with recursive {_classes('documents')} select doc_id, class_id, n_links from classes")
def near_duplicate_classes(spark, folder):
    return dedup.near_classes(table(spark, folder, "documents"))


@query(f"""with recursive {_VERSIONS}, {_classes('versions')}, scored as (select c.doc_id, c.class_id, length(coalesce(text, '')) as len, {_HITS} as hits from classes c join versions d on d.doc_id = c.doc_id)
select doc_id, class_id, count(*) over (partition by class_id) as class_size, row_number() over (partition by class_id order by len desc, hits, doc_id) = 1 as is_canonical from scored""")
def canonical_articles(spark, folder):
    docs = _versions(spark, folder)
    return dedup.canonical(docs, dedup.near_classes(docs))


@query(f"""with {_VERSIONS}, {_pairs('versions')} select p.*, a.source as source_1, a.published_at as published_1, b.source as source_2, b.published_at as published_2 from pairs p join versions a on a.doc_id = id_1 join versions b on b.doc_id = id_2""")
def duplicate_pair_export(spark, folder):
    docs = _versions(spark, folder)
    pairs = dedup.near_pairs(dedup.representatives(docs))
    side = lambda n: docs.select(F.col("doc_id").alias(f"id_{n}"), F.col("source").alias(f"source_{n}"), F.col("published_at").alias(f"published_{n}"))
    return pairs.join(side(1), "id_1").join(side(2), "id_2")


@query("""with x as (select doc_id, case when lower(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) = '' then null else text end as text from documents)
select doc_id, lower(trim(coalesce(lang, ''))) as lang, regexp_replace(regexp_replace(lower(trim(source)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') as source_slug,
strftime(published_at, '%Y_%m') as source_month, coalesce(nullif(lower(trim(coalesce(lang, ''))), ''), 'unknown') as lang_known from documents""")
def label_forms(spark, folder):
    d = table(spark, folder, "documents")
    lang = t.label_form(F.col("lang"))
    return d.select("doc_id", lang.alias("lang"), t.slug(F.col("source")).alias("source_slug"), F.date_format("published_at", "yyyy_MM").alias("source_month"),
                    F.when(lang == "", "unknown").otherwise(lang).alias("lang_known"))


@query("""with l as (select case when lower(trim(coalesce(lang, ''))) = '' then 'unknown' else lower(trim(lang)) end as language, length(coalesce(text, '')) as n, source from documents)
select language, count(*) as n_docs, avg(n) as mean_chars, count(distinct source) as n_sources, count(*) / sum(count(*)) over () as share,
(language = 'en') as is_english from l group by 1""")
def language_summary(spark, folder):
    lang = t.label_form(F.col("lang"))
    d = table(spark, folder, "documents").select(F.when(lang == "", "unknown").otherwise(lang).alias("language"), F.length(F.coalesce("text", F.lit(""))).alias("n"), "source")
    return d.groupBy("language").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("n").alias("mean_chars"), F.count_distinct("source").alias("n_sources")).withColumn(
        "share", F.col("n_docs") / F.sum("n_docs").over(Window.partitionBy())).withColumn("is_english", F.col("language") == "en")


@query("""select doc_id, case when length(trim(coalesce(text, ''))) > 0 then text when length(trim(coalesce(source, ''))) > 0 then source end as chosen_text,
case when lower(trim(coalesce(lang, ''))) = 'en' then 'english_original' when lower(trim(coalesce(lang, ''))) in ('', 'unknown') then 'unknown_language'
when trim(coalesce(text, '')) = '' then 'empty' else 'needs_translation' end as text_source from documents""")
def llm_text_source(spark, folder):
    lang = t.label_form(F.col("lang"))
    kind = F.when(lang == "en", "english_original").when(lang.isin("", "unknown"), "unknown_language").when(F.trim(F.coalesce("text", F.lit(""))) == "", "empty").otherwise("needs_translation")
    return table(spark, folder, "documents").select("doc_id", t.first_text(F.col("text"), F.col("source")).alias("chosen_text"), kind.alias("text_source"))


@query()
def chunk_text(spark, folder):
    d = table(spark, folder, "documents").select("doc_id", F.posexplode(t.chunk_array(2000)(F.col("text"))).alias("chunk_no", "chunk"))
    return d.select("doc_id", "chunk_no", "chunk")


@query(f"""with {_ONCE} select globaleventid, concat('Actors: ', array_to_string(list_sort(list_distinct(list_filter([trim(actor1name), trim(actor2name)], lambda n: n is not null and n <> ''))), '; '), chr(10), 'Date: ', coalesce(cast(sqldate as varchar), 'unknown'), chr(10), 'Text: ', coalesce(text, '')) as prompt from once""")
def render_prompt(spark, folder):
    names = t.join_unique(F.array("actor1name", "actor2name"))
    return a.once_per_article(table(spark, folder, "articles_raw")).select("globaleventid", F.concat(
        F.lit("Actors: "), names, F.lit("\nDate: "), F.coalesce(F.col("sqldate").cast("string"), F.lit("unknown")), F.lit("\nText: "), F.coalesce("text", F.lit(""))).alias("prompt"))


_LOW = f"lower({_SQUEEZED})"


def _signal(column: str) -> str:
    n = f"lower(trim(regexp_replace(coalesce({column}, ''), '{_WS}', ' ', 'g')))"
    vague = ", ".join(f"'{v}'" for v in t.VAGUE_ACTORS)
    return f"({n} not in ({vague}) and length({n}) >= 4 and (contains({n}, ' ') or length({n}) >= 6) and contains({_LOW}, {n}))"


@query(f"""with {_ONCE} select globaleventid, ({' or '.join(f"contains({_LOW}, '{w}')" for w in t.CONFLICT_WORDS)}) as has_rebel_keyword,
{_signal('actor1name')} as has_actor1_signal, {_signal('actor2name')} as has_actor2_signal from once""")
def keyword_signals(spark, folder):
    low = F.lower(t.squeeze(F.coalesce("text", F.lit(""))))
    named = lambda c: t.useful_actor(F.col(c)) & low.contains(F.lower(t.squeeze(F.coalesce(c, F.lit("")))))
    rebel = F.lit(False)
    for word in t.CONFLICT_WORDS:
        rebel = rebel | low.contains(word)
    return a.once_per_article(table(spark, folder, "articles_raw")).select("globaleventid", rebel.alias("has_rebel_keyword"), named("actor1name").alias("has_actor1_signal"), named("actor2name").alias("has_actor2_signal"))
