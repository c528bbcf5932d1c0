"""Alias lexicon, strict phrase matching, ambiguity, collapses and group crosswalks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.functions import text as t

#: Rows up to which a lexicon side is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 200_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else as it is (then the join shuffles)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def plain_id(value: Column) -> Column:
    """An id written as number text, without '.0' and blanks; '' for null."""
    return F.regexp_replace(F.trim(F.coalesce(value.cast("string"), F.lit(""))), r"\.0+$", "")


def lexicon(entries: DataFrame, id_column: str, name_columns: Sequence[str], source: str) -> DataFrame:
    """(term_id, term, term_lower, source_column, actor_id, flags): every usable alternative in the name columns, once per actor and column."""
    stacked = entries.select(F.col(id_column).cast("string").alias("actor_id"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("source_column"), F.col(c).cast("string").alias("raw")) for c in name_columns])).alias("n")).select("actor_id", "n.*")
    terms = stacked.select("actor_id", "source_column", F.explode(t.split_terms(F.col("raw"))).alias("term")).where(t.useful_term(F.col("term"))).distinct()
    low = F.lower(F.col("term"))
    one = ~F.col("term").contains(" ")
    return terms.select(
        F.sha1(F.concat_ws("||", F.lit(source), "actor_id", "source_column", "term")).alias("term_id"), "term", low.alias("term_lower"), F.lit(source).alias("source_dataset"), "source_column", "actor_id",
        one.alias("is_single_token"), F.length("term").alias("term_len"), (one & (F.length("term") <= 4)).alias("is_short_single_token"))


def lexicon_keys(terms: DataFrame) -> DataFrame:
    """(key, kind, term, actor_id): the phrase, compact and, for short single words, acronym keys of each term."""
    kinds = F.array(
        F.struct(F.lit("phrase").alias("kind"), t.phrase_key(F.col("term")).alias("key")),
        F.struct(F.lit("compact").alias("kind"), t.compact_key(F.col("term")).alias("key")),
        F.struct(F.lit("acronym").alias("kind"), F.coalesce(t.acronym_key(F.col("term")), F.when(F.col("is_short_single_token"), t.compact_key(F.col("term"))), F.lit("")).alias("key")),
    )
    return terms.select("term", "actor_id", F.explode(kinds).alias("k")).select("k.key", "k.kind", "term", "actor_id").where("key <> ''").distinct()


def strict_matches(names: DataFrame, keys: DataFrame, id_column: str, sides: dict[str, str]) -> DataFrame:
    """(id, side, name, actor_id, kind, term): names equal to a lexicon term by one of the keys; one hit per actor, phrase before compact before acronym.

    Parts of names never match. ``sides`` maps a side's name to its column.
    """
    stacked = names.select(id_column, F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(c).alias("name")) for s, c in sides.items()])).alias("n")).select(id_column, "n.*").where("trim(name) <> ''")
    distinct = stacked.select("name").distinct()
    kinds = F.array(
        F.struct(F.lit("phrase").alias("kind"), t.phrase_key(F.col("name")).alias("key")),
        F.struct(F.lit("compact").alias("kind"), t.compact_key(F.col("name")).alias("key")),
        F.struct(F.lit("acronym").alias("kind"), F.coalesce(t.acronym_key(F.col("name")), F.when(F.length(t.compact_key(F.col("name"))) <= 4, t.compact_key(F.col("name"))), F.lit("")).alias("key")),
    )
    asked = distinct.select("name", F.explode(kinds).alias("k")).select("name", "k.kind", "k.key").where("key <> ''")
    order = F.when(F.col("kind") == "phrase", 0).when(F.col("kind") == "compact", 1).otherwise(2)
    hits = asked.join(small(keys), ["kind", "key"]).groupBy("name", "actor_id").agg(F.min(F.struct(order.alias("o"), "kind", "term")).alias("b")).select("name", "actor_id", "b.kind", "b.term")
    return stacked.join(hits, "name").select(id_column, "side", "name", "actor_id", "kind", "term")


def ambiguity(matches: DataFrame, review_columns: Sequence[str] = ("namealliance",)) -> DataFrame:
    """Matches with the actors per alias, reasons for review ('clean_exact_alias' if none), and whether they are safe to use.

    If the matches have a ``source_column``, aliases from ``review_columns`` are marked as alliances.
    """
    n = matches.groupBy("name").agg(F.count_distinct("actor_id").alias("n_actors"))
    broad = t.phrase_key(F.col("name")).isin(*t.BROAD_ALIASES)
    alliance = F.lower("source_column").isin(*review_columns) if "source_column" in matches.columns else F.lit(False)
    review = F.concat_ws(";", F.when(broad, "suspicious_broad_or_geographic_alias"), F.when(alliance, "alliance_alias"), F.when(F.col("n_actors") > 1, "alias_maps_to_multiple_rebel_ids"))
    return matches.join(n, "name").withColumn("review", F.when(review == "", "clean_exact_alias").otherwise(review)).withColumn("high_confidence", ~broad & ~alliance)


def collapse(df: DataFrame, keys: Sequence[str], order: Sequence[Column], first: Sequence[str], lists: dict[str, int | None], distinct: Sequence[str] = ()) -> DataFrame:
    """One row per key (null keys count): the first non-blank of some columns by ``order``, others as distinct lists, counts of distinct values."""
    stamp = F.struct(*order)
    aggregates = [F.min_by(F.col(c), F.when(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != "", stamp)).alias(c) for c in first]
    aggregates += [t.join_unique(F.collect_set(F.col(c).cast("string")), most).alias(f"{c}_list") for c, most in lists.items()]
    aggregates += [F.count_distinct(c).alias(f"n_{c}") for c in distinct]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), *aggregates)


def grouped(df: DataFrame, crosswalk: DataFrame, id_column: str) -> DataFrame:
    """Rows with their group's key, name and representative where the crosswalk has the id; else the id stands for itself.

    The crosswalk is reduced to one group per constituent (the least key) first.
    """
    one = crosswalk.select(plain_id(F.col("constituent_ucdp_actor_id")).alias("_id"), F.struct("analysis_actor_key", "analysis_actor_name", plain_id(F.col("representative_ucdp_actor_id")).alias("representative_id")).alias("g")).where(
        "_id <> ''").groupBy("_id").agg(F.min("g").alias("g"))
    return df.withColumn("_id", plain_id(F.col(id_column))).join(small(one), "_id", "left").select(
        *df.columns, F.coalesce("g.analysis_actor_key", "_id").alias("group_key"), F.col("g.analysis_actor_name").alias("group_name"), F.coalesce("g.representative_id", "_id").alias("representative_id"))


def without_several(df: DataFrame, key: str, group: str) -> DataFrame:
    """Rows of keys with exactly one distinct group."""
    one = df.groupBy(key).agg(F.count_distinct(group).alias("_n")).where("_n = 1").select(key)
    return df.join(one, key, "left_semi")


def enriched(matches: DataFrame, *dimensions: tuple[DataFrame, str, Sequence[str]], id_column: str = "actor_id") -> DataFrame:
    """Left joins of (dimension, its id column, its columns) on the plain id; each dimension is reduced to one row per id (the least) first."""
    out = matches.withColumn("_id", plain_id(F.col(id_column)))
    for dimension, key, columns in dimensions:
        one = dimension.select(plain_id(F.col(key)).alias("_id"), F.struct(*columns).alias("d")).where("_id <> ''").groupBy("_id").agg(F.min("d").alias("d")).select("_id", "d.*")
        out = out.join(small(one), "_id", "left")
    return out.drop("_id")


def frequent(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """(keys, value, n): the most frequent value per key; ties to the least value, nulls do not count."""
    counts = df.where(F.col(column).isNotNull()).groupBy(*keys, F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("m"), "value")).alias("b")).select(*keys, "b.value", (-F.col("b.m")).alias("n"))


def upserted(current: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Current rows without those whose keys change, and the changed rows."""
    return current.join(changes.select(*keys).distinct(), list(keys), "left_anti").unionByName(changes)


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key stands on several rows."""
    return df.join(df.groupBy(*keys).count().where("count > 1").drop("count"), list(keys), "left_semi")


def overlap(df: DataFrame, item: str, who: str, a: str, b: str) -> DataFrame:
    """Items that both of two annotators have."""
    return df.where(F.col(who) == a).select(item).intersect(df.where(F.col(who) == b).select(item))


def slice_by_order(df: DataFrame, order: Sequence[Column], start: int, size: int) -> DataFrame:
    """Rows start .. start + size - 1 of a total order (a work chunk), as a bounded sort."""
    first = df.orderBy(*order).limit(start + size)
    return first.withColumn("_n", F.row_number().over(Window.orderBy(*order)) - 1).where((F.col("_n") >= start)).drop("_n")
