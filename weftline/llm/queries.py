"""Queries of the training-text operators over the project's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.session import table


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    from weftline.llm import consensus as c

    return c.consensus(*c.fit(table(spark, folder, "inter_annotator"))).select("globaleventid", "field_name", "answer")


def p2_agreement(spark: SparkSession, folder: str) -> DataFrame:
    from weftline.llm import consensus as c

    return c.field_agreement(c.votes(table(spark, folder, "inter_annotator"))).withColumn("alpha", F.round("alpha", 6))


def p2_reliability(spark: SparkSession, folder: str) -> DataFrame:
    from weftline.llm import consensus as c

    return c.coder_reliability(c.fit(table(spark, folder, "inter_annotator"))[1])


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    from weftline.llm import names

    articles, groups = table(spark, folder, "articles_raw"), table(spark, folder, "actor_group_crosswalk")
    typed = articles.select(F.explode(F.array("actor1name", "actor2name")).alias("n")).distinct().unionByName(groups.select(F.col("constituent_actor_name").alias("n")))
    return names.map_names(typed, table(spark, folder, "actor"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    from weftline.llm import siteblocks

    return siteblocks.repeated_lines(table(spark, folder, "articles_raw")).select("globaleventid", "line_no").distinct()


def p3_cleaned(spark: SparkSession, folder: str) -> DataFrame:
    from weftline.llm import siteblocks

    articles = table(spark, folder, "articles_raw")
    return siteblocks.without_lines(articles, siteblocks.boilerplate_lines(articles))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    from weftline.llm import residue

    return residue.no_story_articles(table(spark, folder, "articles_raw"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    from weftline.llm import mainbody

    return mainbody.furniture_lines(table(spark, folder, "articles_raw"))


def p6_body(spark: SparkSession, folder: str) -> DataFrame:
    from weftline.llm import mainbody

    return mainbody.main_text(table(spark, folder, "articles_raw"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    from weftline.llm import langtags

    return langtags.wrong_or_mixed(table(spark, folder, "articles_raw"))


def p7_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    from weftline.llm import langtags

    return langtags.story_paragraphs(table(spark, folder, "articles_raw")).dropDuplicates(["globaleventid", "line_no"])


def p8_packed(spark: SparkSession, folder: str) -> DataFrame:
    from weftline.llm import packing

    return packing.packed(table(spark, folder, "documents"))


def p8_fill(spark: SparkSession, folder: str) -> DataFrame:
    from weftline.llm import packing

    return packing.fill_report(packing.packed(table(spark, folder, "documents")))


def p8_sizes(spark: SparkSession, folder: str) -> DataFrame:
    from weftline.llm import packing

    return packing.pieces(table(spark, folder, "documents"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    from weftline.llm import leakage

    return leakage.leaked(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p9_items(spark: SparkSession, folder: str) -> DataFrame:
    from weftline.llm import leakage

    items = table(spark, folder, "eval_items")
    return leakage.leaked_items(leakage.leaked(table(spark, folder, "documents"), items), items)


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    from weftline.llm import sentences

    return sentences.unit_ends(table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        p1_found, p2_found, p2_agreement, p2_reliability, p3_found, p3_cleaned, p4_found, p6_found, p6_body, p7_found, p7_paragraphs,
        p8_packed, p8_fill, p8_sizes, p9_found, p9_items, p10_found,
    )
}

#: SQL for queries that SQL can state; the others are tested against brute force.
ORACLE_SQL: dict[str, str] = {
    "p8_sizes": """
with sized as (select doc_id, max(coalesce(strlen(text), 0) + 1) as size from documents where doc_id is not null group by 1),
cut as (select doc_id, size, unnest(range(0, cast(ceil(size / 8192.0) as bigint))) as piece_no from sized)
select doc_id, cast(piece_no as int) as piece_no, least(8192, size - piece_no * 8192) as n_tokens from cut""",
    "p2_agreement": """
with seats as (
  select globaleventid, coding_round, trim(coder_1_id) as coder, 'any_fatalities_mentioned' as field_name, any_fatalities_mentioned_coder_1 as raw from inter_annotator
  union all select globaleventid, coding_round, trim(coder_2_id), 'any_fatalities_mentioned', any_fatalities_mentioned_coder_2 from inter_annotator
  union all select globaleventid, coding_round, trim(coder_1_id), 'any_physical_violence_mentioned', any_physical_violence_mentioned_coder_1 from inter_annotator
  union all select globaleventid, coding_round, trim(coder_2_id), 'any_physical_violence_mentioned', any_physical_violence_mentioned_coder_2 from inter_annotator),
votes as (
  select distinct globaleventid, coding_round, coder, field_name,
    case when lower(trim(raw)) in ('yes', 'y') then 'yes' when lower(trim(raw)) in ('no', 'n') then 'no' when lower(trim(raw)) in ('unclear', '?') then 'unclear' end as answer
  from seats where coder is not null and coder <> '' and globaleventid is not null),
per as (
  select field_name, globaleventid, count(*) filter (answer = 'yes') as a, count(*) filter (answer = 'no') as b, count(*) filter (answer = 'unclear') as c, count(*) as m
  from votes where answer is not null group by all having count(*) > 1),
t as (
  select field_name, sum((a * (m - a) + b * (m - b) + c * (m - c)) / (m - 1)) as d, sum(m) as n, sum(a) as ta, sum(b) as tb, sum(c) as tc, count(*) as n_items from per group by 1)
select field_name, n_items, cast(n as bigint) as n_ratings, round(1 - d / ((ta * (n - ta) + tb * (n - tb) + tc * (n - tc)) / (n - 1)), 6) as alpha from t""",
}
