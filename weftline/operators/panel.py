"""Actor-by-period panels: balanced grids, leads and lags, look-back sets, label shares."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.functions import dates, maths, text
from weftline.operators.grid_series import event_date, source_number


def clean_events(ged: DataFrame) -> DataFrame:
    """The newest row per event id with its day, numeric actor ids and count; unusable days and counts become null."""
    best = F.col("best").cast("double")
    row = F.struct(F.coalesce(F.col("loaded_at").cast("timestamp"), F.lit("0001-01-01").cast("timestamp")).alias("at"), event_date(F.col("date_start")).alias("day"),
                   source_number(F.col("side_a_new_id")).alias("side_a"), source_number(F.col("side_b_new_id")).alias("side_b"),
                   F.when(F.isnan(best) | (best < 0), None).otherwise(best).alias("best"), "country", "adm_1", "latitude", "longitude", "where_prec")
    return ged.where("id is not null").groupBy("id").agg(F.max(row).alias("r")).select("id", "r.*").drop("at")


def by_side(events: DataFrame) -> DataFrame:
    """Events once per actor on either side (an actor on both sides counts once)."""
    both = F.explode(F.array_distinct(F.array("side_a", "side_b"))).alias("actor_id")
    return events.select("id", "day", "best", "country", "adm_1", "latitude", "longitude", "where_prec", both).where("actor_id is not null")


def monthly(events: DataFrame) -> DataFrame:
    """(actor_id, month, n_events, fatalities) of actors on side a; month is year * 12 + month."""
    return events.where("side_a is not null and day is not null").groupBy(F.col("side_a").alias("actor_id"), dates.month_ordinal(F.col("day")).alias("month")).agg(
        F.count(F.lit(1)).alias("n_events"), F.coalesce(F.sum("best"), F.lit(0.0)).alias("fatalities"))


def balanced(counts: DataFrame, key: str, period: str, first: int, last: int, fill: Sequence[str]) -> DataFrame:
    """Every period first..last for each key, missing counts 0. The grid is each key's own sequence, not a cross join."""
    grid = counts.select(key).distinct().select(key, F.explode(F.sequence(F.lit(first), F.lit(last))).alias(period))
    return grid.join(counts, [key, period], "left").na.fill(0, list(fill))


def block_panel(events: DataFrame, weeks: int, end: str) -> DataFrame:
    """Balanced actor-by-block panel over complete blocks up to ``end`` (exclusive): events, fatalities, share of deadly events (null without events), log outcome."""
    last = f"cast(floor(datediff(date '{end}', date '{dates.ORIGIN}') / {7 * weeks}) as int) - 1"
    index = F.floor(F.datediff("day", F.lit(dates.ORIGIN).cast("date")) / (7 * weeks)).cast("int")
    counts = events.where("side_a is not null and day is not null").select(F.col("side_a").alias("actor_id"), index.alias("period_index"), "best").groupBy("actor_id", "period_index").agg(
        F.count(F.lit(1)).alias("n_events"), F.count_if(F.col("best") > 0).alias("n_deadly"), F.coalesce(F.sum("best"), F.lit(0.0)).alias("fatalities"))
    grid = events.where("side_a is not null and day is not null").select(F.col("side_a").alias("actor_id")).distinct().select("actor_id", F.explode(F.sequence(F.lit(0), F.expr(last))).alias("period_index"))
    full = grid.join(counts, ["actor_id", "period_index"], "left").na.fill(0, ["n_events", "n_deadly", "fatalities"])
    return full.select("actor_id", "period_index", F.date_add(F.lit(dates.ORIGIN).cast("date"), (F.col("period_index") * 7 * weeks).cast("int")).alias("period_start"), "n_events", "n_deadly", "fatalities",
                       maths.share(F.col("n_deadly"), F.col("n_events")).alias("deadly_share"), F.log1p("fatalities").alias("log_fatalities"))


def leads_and_lags(panel: DataFrame, key: str, order: str, column: str, leads: int = 1, lags: int = 2) -> DataFrame:
    w = Window.partitionBy(key).orderBy(order)
    more = {f"{column}_lead{h}": F.lead(column, h).over(w) for h in range(1, leads + 1)} | {f"{column}_lag{h}": F.lag(column, h).over(w) for h in range(1, lags + 1)}
    return panel.withColumns(more)


def regimes(start: Column, days: int, cut: str) -> dict[str, Column]:
    """Dummies of a period of ``days`` days around a cut date: it holds the cut, it starts after it, it ends after it; nulls are false."""
    c, end = F.lit(cut).cast("date"), F.date_add(start, days)
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("int")
    return {"regime_transition": flag((start < c) & (end > c)), "regime_post": flag(start >= c), "regime_touched": flag(end > c)}


def history_bins(panel: DataFrame, key: str, order: str, column: str, width: int, bins: int) -> DataFrame:
    """Sums of ``width`` consecutive past values, bin 0 the latest with the present; null where a value of the bin is missing."""
    w = Window.partitionBy(key).orderBy(order)
    made = {}
    for b in range(bins):
        frame = w.rowsBetween(-(b * width + width - 1), -(b * width))
        made[f"{column}_bin{b}"] = F.when(F.count(column).over(frame) == width, F.sum(column).over(frame))
    return panel.withColumns(made)


def at_offsets(panel: DataFrame, key: str, period: str, column: str, offsets: Sequence[int]) -> DataFrame:
    """Values at the period plus each offset by lookup (a gap gives null), from one grouped map per key."""
    values = panel.select(key, F.col(period).alias("_p"), F.col(column).alias("_v"))
    asked = panel.select(key, period, F.explode(F.array(*map(F.lit, offsets))).alias("h")).withColumn("_p", F.col(period) + F.col("h"))
    found = asked.join(values, [key, "_p"], "left").groupBy(key, period).agg(*[F.max(F.when(F.col("h") == h, F.col("_v"))).alias(f"{column}_h{h}".replace("-", "m")) for h in offsets])
    return panel.join(found, [key, period])


def lookback_sets(events: DataFrame, first: int, last: int, months: int) -> DataFrame:
    """(actor_id, month, countries): countries with events of the actor in the last ``months`` months, the present one with them.

    Months are pre-aggregated, so a window row holds a month's countries, not events.
    """
    seen = events.where("side_a is not null and day is not null and trim(coalesce(country, '')) <> ''").groupBy(F.col("side_a").alias("actor_id"), dates.month_ordinal(F.col("day")).alias("month")).agg(F.collect_set("country").alias("c"))
    grid = seen.select("actor_id").distinct().select("actor_id", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("month")).join(seen, ["actor_id", "month"], "left")
    w = Window.partitionBy("actor_id").orderBy("month").rowsBetween(-(months - 1), 0)
    return grid.select("actor_id", "month", F.array_sort(F.array_distinct(F.flatten(F.collect_list("c").over(w)))).alias("countries"))


def risk_fatalities(sets: DataFrame, events: DataFrame, metadata: DataFrame) -> DataFrame:
    """(actor_id, month, source, fatalities): deaths in the month over the look-back countries, else over the actor's own places, else 0."""
    deaths = events.where("day is not null").groupBy("country", dates.month_ordinal(F.col("day")).alias("month")).agg(F.coalesce(F.sum("best"), F.lit(0.0)).alias("deaths"))
    chosen = sets.join(metadata, "actor_id", "left").select("actor_id", "month", F.when(F.size("countries") > 0, F.col("countries")).when(F.size(F.coalesce("places", F.array())) > 0, F.col("places")).otherwise(F.array().cast("array<string>")).alias("c"),
        F.when(F.size("countries") > 0, "rolling").when(F.size(F.coalesce("places", F.array())) > 0, "metadata").otherwise("empty_no_metadata").alias("source"))
    flat = chosen.select("actor_id", "month", "source", F.explode_outer("c").alias("country"))
    return flat.join(deaths, ["country", "month"], "left").groupBy("actor_id", "month", "source").agg(F.coalesce(F.sum("deaths"), F.lit(0.0)).alias("fatalities"))


def places(value: Column) -> Column:
    """Distinct places of a comma list in order, blanks left out."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), ","), text.squeeze), lambda c: c != ""))


def identity_join(sides: DataFrame, identities: DataFrame) -> DataFrame:
    """(actor_key, id, day, best) once per key and event: identities are (actor_key, actor_id, valid_from, valid_to), the end exclusive, null open."""
    inside = (F.col("day") >= F.coalesce("valid_from", F.lit("0001-01-01").cast("date"))) & (F.col("day") < F.coalesce("valid_to", F.lit("9999-12-31").cast("date")))
    return sides.join(identities, "actor_id").where(inside).select("actor_key", "id", "day", "best").distinct()


def label_shares(rows: DataFrame, keys: Sequence[str], weight: Column, positives: dict[str, tuple[Column, str]], categories: dict[str, tuple[Column, Sequence[str]]]) -> DataFrame:
    """Weighted shares per key in one aggregate: labels equal to their positive class (null counts as negative), and each category of others; null where the weight is 0."""
    aggregates = [F.sum(weight).alias("weight")]
    for name, (column, positive) in positives.items():
        aggregates.append(F.sum(F.when(text.label_form(column) == positive, weight).otherwise(0.0)).alias(f"w_{name}"))
    for name, (column, values) in categories.items():
        aggregates += [F.sum(F.when(text.label_form(column) == v, weight).otherwise(0.0)).alias(f"w_{name}_{v}") for v in values]
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), *aggregates)
    shares = [maths.share(F.col(c), F.col("weight")).alias(f"share_{c[2:]}") for c in out.columns if c.startswith("w_")]
    return out.select(*keys, "n_rows", "weight", *shares)


def first_region(sides: DataFrame) -> DataFrame:
    """(actor_id, country, adm_1, latitude, longitude): the most precise and earliest place of each actor's region with usable coordinates."""
    ok = F.col("latitude").between(-90, 90) & F.col("longitude").between(-180, 180) & (F.trim(F.coalesce("country", F.lit(""))) != "") & (F.trim(F.coalesce("adm_1", F.lit(""))) != "")
    key = F.struct(F.coalesce("where_prec", F.lit(99)).alias("p"), F.coalesce("day", F.lit("9999-12-31").cast("date")).alias("d"), F.col("id"))
    best = sides.where(ok).groupBy("actor_id", "country", "adm_1").agg(F.min_by(F.struct("latitude", "longitude"), key).alias("b"))
    return best.select("actor_id", "country", "adm_1", "b.latitude", "b.longitude")


def risk_features(regions: DataFrame) -> DataFrame:
    """(actor_id, n_regions, feature): each actor's regions as a GeoJSON MultiPoint, points in order of country and region; one bounded row per region."""
    points = F.array_sort(F.collect_list(F.struct("country", "adm_1", F.array("longitude", "latitude").alias("xy"))))
    shaped = regions.groupBy("actor_id").agg(points.alias("p"))
    return shaped.select("actor_id", F.size("p").alias("n_regions"), F.to_json(F.struct(F.lit("MultiPoint").alias("type"), F.transform("p", lambda x: x["xy"]).alias("coordinates"))).alias("feature"))
