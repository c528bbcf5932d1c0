"""Event and mention scans, ranked URL candidates, and their panels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.functions import dates, maths, text, urls


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first by ``order`` (give a total order; a null key is a key of its own)."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "candidate_rank") -> DataFrame:
    """The first ``k`` rows per key with their rank; planned as partial and final group limits, so a hot key is cut before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def once_per_article(articles: DataFrame) -> DataFrame:
    """The newest row of each article id."""
    return latest(articles, ["globaleventid"], [F.col("scraped_at").desc_nulls_last(), F.xxhash64("text")])


def any_of(columns: Sequence[str], codes: Sequence[str]) -> Column:
    """Whether any of the columns is one of the codes, in any case; nulls never are."""
    wanted = [c.lower() for c in codes]
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.lower(F.col(c)).isin(*wanted), F.lit(False))
    return hit


def names_match(columns: Sequence[str], terms: Sequence[str]) -> Column:
    """Whether a column has one of the terms between word bounds, in any case. Longer terms are tried first."""
    ordered = sorted({t.lower() for t in terms}, key=lambda t: (-len(t), t))
    quoted = "|".join("".join("\\" + c if c in r".^$*+?()[]{}|\\" else c for c in t) for t in ordered)
    pattern = f"(^|[^a-z0-9])({quoted})([^a-z0-9]|$)"
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.lower(F.coalesce(F.col(c), F.lit(""))).rlike(pattern)
    return hit


def event_scan(events: DataFrame, start: int, end: int, roots: Sequence[str] = (), codes: Sequence[str] = (), terms: Sequence[str] | None = None, least_articles: int = 1) -> DataFrame:
    """Events of the half-open day range [start, end) with more than ``least_articles`` articles and, if given, one of the
    root or full codes (kept as text: leading zeros count) and a term in an actor's name."""
    kept = events.where((F.col("sqldate") >= start) & (F.col("sqldate") < end) & (F.col("numarticles") > least_articles))
    if roots or codes:
        kept = kept.where(F.col("eventrootcode").isin(*roots) | F.col("eventbasecode").isin(*codes) | F.col("eventcode").isin(*codes))
    return kept if terms is None else kept.where(names_match(["actor1name", "actor2name"], terms))


def week_panel(events: DataFrame) -> DataFrame:
    """Country-week panel of once-per-id events: counts, rebel events and share, mean tone, median scale, mentions."""
    day = dates.day_of(F.col("sqldate"))
    return events.where(F.trim(F.coalesce("actiongeo_countrycode", F.lit(""))) != "").withColumn("week_start", dates.week_start(day)).where("week_start is not null").groupBy(
        "actiongeo_countrycode", "week_start"
    ).agg(
        F.count(F.lit(1)).alias("n_events"), F.sum(text.truthy(F.col("involves_rebel")).cast("long")).alias("n_rebel"), F.avg("avgtone").alias("mean_tone"),
        F.median("goldsteinscale").alias("median_scale"), F.sum("nummentions").alias("n_mentions"), F.max("numsources").alias("max_sources"),
    ).withColumn("rebel_share", maths.share(F.col("n_rebel"), F.col("n_events"))).withColumn("iso_week", F.weekofyear("week_start"))


def count_pivot(df: DataFrame, keys: Sequence[str], column: str, values: Sequence, prefix: str) -> DataFrame:
    """Counts of given values of a column per key in one aggregate, 0 where a value is missing."""
    return df.groupBy(*keys).agg(*[F.count_if(F.col(column) == v).alias(f"{prefix}{v}") for v in values])


def first_window(mentions: DataFrame) -> DataFrame:
    """Mentions made in the interval in which the event was first seen."""
    return mentions.where(F.col("mentiontimedate") == F.col("eventtimedate"))


def mention_order() -> list[Column]:
    """Best mention first: confidence, length of the text, place in it; then the URL and time, for a total order."""
    return [
        F.coalesce("confidence", F.lit(0)).desc(), F.coalesce("mentiondoclen", F.lit(0)).desc(), F.coalesce("sentenceid", F.lit(9999)).asc(),
        F.col("mentionidentifier").asc_nulls_last(), F.col("mentiontimedate").asc_nulls_last(), F.col("mentionsourcename").asc_nulls_last(),
        F.coalesce("mentiondoctone", F.lit(0.0)).asc(), F.coalesce("mentiontype", F.lit(0)).asc(),
    ]


def timed_counts(mentions: DataFrame, minutes: Sequence[int] = (15, 60, 1440)) -> DataFrame:
    """Per event: mentions, sources and web pages within so many whole minutes of the event; mentions before it do not count."""
    a, b = dates.moment_of(F.col("eventtimedate")), dates.moment_of(F.col("mentiontimedate"))
    gap = F.floor((F.unix_timestamp(b) - F.unix_timestamp(a)) / 60)
    aggregates = []
    for m in minutes:
        within = (F.col("gap") >= 0) & (F.col("gap") <= m)
        aggregates += [
            F.count_if(within).alias(f"n_mentions_{m}m"),
            F.count_distinct(F.when(within, F.col("mentionsourcename"))).alias(f"n_sources_{m}m"),
            F.count_distinct(F.when(within & (F.col("mentiontype") == 1), F.col("mentionidentifier"))).alias(f"n_pages_{m}m"),
        ]
    return mentions.withColumn("gap", gap).groupBy("globaleventid").agg(*aggregates)


def url_candidates(events: DataFrame, mentions: DataFrame, k: int = 5) -> DataFrame:
    """(globaleventid, url, domain, candidate_score, is_primary, candidate_rank): at most ``k`` pages per event.

    A mention whose normal URL is the event's own gets the primary bonus; the
    event's own URL joins as a candidate where no mention has it. Image and PDF
    URLs are left out, the best candidate of each domain is kept, and ties fall
    to the URL in byte order. Events without any URL have no row.
    """
    own = events.select("globaleventid", urls.normal_url(F.col("used_url")).alias("own_url"), urls.is_page(F.col("used_url")).alias("own_page"))
    told = mentions.where(urls.is_page(F.col("mentionidentifier"))).select(
        "globaleventid", urls.normal_url(F.col("mentionidentifier")).alias("url"), "mentiontype", "confidence", "mentiondoclen", "sentenceid"
    ).where("url is not null").join(own.select("globaleventid", "own_url"), "globaleventid")
    score = maths.candidate_score(F.coalesce(F.col("url") == F.col("own_url"), F.lit(False)), F.col("mentiontype"), F.col("confidence"), F.col("mentiondoclen"), F.col("sentenceid"))
    scored = told.groupBy("globaleventid", "url").agg(F.max(score).alias("candidate_score"), F.first(F.coalesce(F.col("url") == F.col("own_url"), F.lit(False))).alias("is_primary"))
    missing = own.where("own_url is not null and own_page").join(scored.where("is_primary").select("globaleventid"), "globaleventid", "left_anti").select(
        "globaleventid", F.col("own_url").alias("url"), maths.candidate_score(F.lit(True), F.lit(0), F.lit(0), F.lit(0), F.lit(9999)).alias("candidate_score"), F.lit(True).alias("is_primary"))
    every = scored.unionByName(missing).withColumn("domain", urls.host(F.col("url")))
    best = latest(every, ["globaleventid", "domain"], [F.col("candidate_score").desc(), F.col("url").asc()])
    return top_per_key(best, ["globaleventid"], [F.col("candidate_score").desc(), F.col("url").asc()], k)


def diverse_rank(candidates: DataFrame, key: str = "globaleventid") -> DataFrame:
    """A new rank per key: primary candidates, then the first of each domain, then the rest, each by the old rank and URL."""
    seq = F.row_number().over(Window.partitionBy(key, "domain").orderBy(F.col("is_primary").desc(), "candidate_rank", "url"))
    order = [F.col("is_primary").desc(), (F.col("_seq") > 1).asc(), F.col("candidate_rank").asc(), F.col("url").asc()]
    return candidates.withColumn("_seq", seq).withColumn("diverse_rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).drop("_seq")


def first_success(attempts: DataFrame, key: str, rank: str, ok: Column) -> DataFrame:
    """Per key: the rank of the first success (null if none) and the attempts made until then."""
    won = F.min(F.when(ok, F.col(rank)))
    return attempts.groupBy(key).agg(won.alias("success_rank"), F.coalesce(won, F.max(rank)).alias("n_attempts"))


#: Which rows each match filter keeps, given its flags: a term of one list, a term of the other list, the actor's type code.
MATCH_FILTERS = {
    "any_rebel": lambda one, other, typed: one | other | typed,
    "actor_terms_only": lambda one, other, typed: one | other,
    "ucdp_only": lambda one, other, typed: one,
    "rad_only": lambda one, other, typed: other,
    "both_terms": lambda one, other, typed: one & other,
    "gdelt_type_only": lambda one, other, typed: typed & ~(one | other),
}


def match_filter(mode: str, ucdp: Column, rad: Column, typed: Column) -> Column:
    """Whether a row is kept by a match filter; null flags are false, an unknown mode raises."""
    if mode not in MATCH_FILTERS:
        raise ValueError(f"unknown match filter {mode}; one of {', '.join(MATCH_FILTERS)}")
    return MATCH_FILTERS[mode](*[F.coalesce(c, F.lit(False)) for c in (ucdp, rad, typed)])


def of_year(columns: Sequence[Column], year: int) -> Column:
    """Whether any of the columns, as text, begins with the year."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.trim(c.cast("string")).startswith(str(year)), F.lit(False))
    return hit


def stratified(df: DataFrame, strata: Sequence[str], key: str, seed: int, n: int) -> DataFrame:
    """At most ``n`` rows of each stratum in the order of the MD5 of key and seed, with their place."""
    return top_per_key(df, strata, [F.md5(F.concat(F.col(key).cast("string"), F.lit("|"), F.lit(str(seed)))).asc(), F.col(key).asc()], n, "place")


def hash_sample(df: DataFrame, key: str, seed: int, n: int) -> DataFrame:
    """``n`` rows in the order of the MD5 of key and seed: the same sample wherever it is drawn."""
    return df.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit("|"), F.lit(str(seed)))), F.col(key)).limit(n)


def left_one(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join that asserts at most one right row per key when it runs; a second one raises."""
    many = F.when(F.count(F.lit(1)).over(Window.partitionBy(*keys)) > 1, F.raise_error(F.lit("right side has several rows of a key"))).otherwise(F.lit(1))
    checked = right.withColumn("_one", many).where("_one = 1").drop("_one")
    return left.join(checked, list(keys), "left")
