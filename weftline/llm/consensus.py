"""Consensus of several coders' labels by iteratively reweighted voting.

Coders differ in quality and in kind: some answer always the same, some turn
answers round, some guess. So a coder's accuracy is kept per consensus answer
(the smoothed share of each given answer among articles whose consensus by the
*other* coders is yes, no or unclear) and a vote counts for each answer with
the log of that share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.session import cut

ANSWERS = ("yes", "no", "unclear")
FIELDS = ("any_fatalities_mentioned", "any_physical_violence_mentioned")
#: Coder tables (coders times fields) up to which they travel as maps.
MAP_ROWS = 1_000


def clean_answer(text: Column) -> Column:
    """yes, no, unclear or null; short forms and spelling variants are folded."""
    t = F.lower(F.trim(F.regexp_replace(text, r"[\s .!]+", " ")))
    return (
        F.when(t.isin("yes", "y", "true", "1"), "yes")
        .when(t.isin("no", "n", "false", "0"), "no")
        .when(t.isin("unclear", "?", "u", "unsure", "unknown"), "unclear")
    )


def votes(rounds: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(globaleventid, field_name, coder, answer), one per coder, round and field; repeats, nulls and unknown words drop out."""
    seats = F.explode(F.array(*[
        F.struct(
            F.lit(field).alias("field_name"),
            F.trim(F.col(f"coder_{seat}_id")).alias("coder"),
            clean_answer(F.col(f"{field}_coder_{seat}")).alias("answer"),
        )
        for field in fields for seat in (1, 2)
    ])).alias("v")
    return (
        rounds.select("globaleventid", "coding_round", seats)
        .select("globaleventid", "coding_round", "v.*")
        .where("globaleventid is not null and coder is not null and coder <> '' and answer is not null")
        .distinct()
        .select("globaleventid", "field_name", "coder", F.array_position(F.array(*map(F.lit, ANSWERS)), F.col("answer")).cast("int").alias("answer"))
    )


def _add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def _total(votes: Column) -> Column:
    """Sum of the logs of votes, each as often as it was given."""
    zero = F.array(*[F.lit(0.0)] * len(ANSWERS))
    return F.aggregate(votes, zero, lambda s, v: _add(s, F.transform(v["logs"], lambda x: x * v["n"])))


def _shares(df: DataFrame, logs: list[Column]) -> DataFrame:
    """``df`` with p0.. , the softmax of the logs, in plain columns that code generation covers."""
    n = range(len(logs))
    told = df.withColumns({f"_o{k}": logs[k] for k in n})
    told = told.withColumn("_top", F.greatest(*[f"_o{k}" for k in n])).withColumns({f"_e{k}": F.exp(F.col(f"_o{k}") - F.col("_top")) for k in n})
    told = told.withColumn("_sum", sum((F.col(f"_e{k}") for k in n), F.lit(0.0))).withColumns({f"p{k}": F.col(f"_e{k}") / F.col("_sum") for k in n})
    return told.drop("_top", "_sum", *[f"_o{k}" for k in n], *[f"_e{k}" for k in n])


def _scored(ballots: DataFrame, model: DataFrame, as_map: bool) -> DataFrame:
    """Ballots with each vote's log shares and the sum over the item.

    With few coders their tables travel as one map per field, and no vote is
    shuffled; else votes join their coder's table. The results are the same.
    """
    logs = lambda table, answer: F.transform(table, lambda row: F.log(F.element_at(row, answer)))
    if as_map:
        maps = model.groupBy("field_name").agg(F.map_from_entries(F.collect_list(F.struct("coder", "table"))).alias("tables"), F.first("prior").alias("prior"))
        told = ballots.join(F.broadcast(maps), "field_name").withColumn(
            "vs", F.transform("votes", lambda v: F.struct(v["coder"].alias("coder"), v["answer"].alias("answer"), v["n"].alias("n"), logs(F.element_at("tables", v["coder"]), v["answer"]).alias("logs")))).drop("tables", "votes")
    else:
        flat = ballots.select("globaleventid", "field_name", F.explode("votes").alias("v")).select("globaleventid", "field_name", "v.coder", "v.answer", "v.n")
        told = flat.join(model, ["field_name", "coder"]).withColumn("logs", logs(F.col("table"), F.col("answer"))).groupBy("globaleventid", "field_name").agg(
            F.collect_list(F.struct("coder", "answer", "n", "logs")).alias("vs"), F.first("prior").alias("prior"))
    return told.withColumn("total", _total(F.col("vs")))


def _model(soft: DataFrame, smoothing: float) -> DataFrame:
    """Per field and coder: table[k][a], the smoothed share of answer a where the other coders say k; prior logs per field."""
    n = len(ANSWERS)
    cells = [F.sum(F.when(F.col("answer") == a + 1, F.col(f"p{k}") * F.col("n")).otherwise(0.0)).alias(f"c{k}{a}") for k in range(n) for a in range(n)]
    sums = soft.groupBy("field_name", "coder").agg(*cells, F.sum("n").alias("n_votes"))
    row = lambda k: F.array(*[
        (F.col(f"c{k}{a}") + smoothing * (2.0 if a == k else 1.0)) / (sum((F.col(f"c{k}{b}") for b in range(n)), F.lit(0.0)) + smoothing * (n + 1.0))
        for a in range(n)
    ])
    shares = [sum((F.col(f"c{k}{a}") for a in range(n)), F.lit(1.0)) for k in range(n)]
    totals = sums.groupBy("field_name").agg(*[F.sum(shares[k]).alias(f"p{k}") for k in range(n)])
    prior = F.array(*[F.log(F.col(f"p{k}") / sum((F.col(f"p{b}") for b in range(n)), F.lit(0.0))) for k in range(n)]).alias("prior")
    tables = sums.select("field_name", "coder", "n_votes", F.array(*[row(k) for k in range(n)]).alias("table"))
    return tables.join(totals.select("field_name", prior), "field_name").select("field_name", "coder", "n_votes", "table", "prior")


def fit(rounds: DataFrame, fields: tuple[str, ...] = FIELDS, most_rounds: int = 100, tolerance: float = 2e-3, smoothing: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(ballots, model): (globaleventid, field_name, votes) and each coder's table, after alternating consensus and coder accuracy until no table cell moves more than ``tolerance``.

    Equal votes of a coder on an article count together, so an article's votes are at most its coders times the answers.
    A coder's accuracy is measured against the votes of the others, without any of their own on the article, in whatever round.
    Raises if ``most_rounds`` do not suffice.
    """
    counted = votes(rounds, fields).groupBy("globaleventid", "field_name", "coder", "answer").agg(F.count(F.lit(1)).alias("n"))
    ballots = cut(counted.groupBy("globaleventid", "field_name").agg(F.array_sort(F.collect_list(F.struct("coder", "answer", "n"))).alias("votes")))
    start = F.array(*[F.array(*[F.lit(0.6 if a == k else 0.2) for a in range(len(ANSWERS))]) for k in range(len(ANSWERS))])
    model = cut(ballots.select("field_name", F.explode("votes").alias("v")).select("field_name", "v.coder", "v.n").groupBy("field_name", "coder").agg(F.sum("n").alias("n_votes")).select(
        "field_name", "coder", "n_votes", start.alias("table"), F.array(*[F.lit(0.0)] * len(ANSWERS)).alias("prior")))
    as_map = model.limit(MAP_ROWS + 1).count() <= MAP_ROWS
    kept: list = []
    for _ in range(most_rounds):
        own = F.transform("vs", lambda v: F.struct(v["coder"].alias("coder"), v["answer"].alias("answer"), v["n"].alias("n"), _total(F.filter("vs", lambda u: u["coder"] == v["coder"])).alias("own")))
        each = _scored(ballots, model, as_map).select("field_name", "prior", "total", F.explode(own).alias("v"))
        others = [F.col("prior")[k] + F.col("total")[k] - F.col("v.own")[k] for k in range(len(ANSWERS))]
        soft = _shares(each, others).select("field_name", "v.coder", "v.answer", "v.n", *[f"p{k}" for k in range(len(ANSWERS))])
        if as_map:  # few coder tables: kept on the driver between rounds
            rows = sorted(_model(soft, smoothing).collect())
            cells = lambda rs: [x for r in rs for row in r["table"] for x in row]
            before, now = cells(kept), cells(rows)
            moved = max((abs(x - y) for x, y in zip(before, now)), default=0.0) if len(before) == len(now) else 1.0
            kept, model = rows, rounds.sparkSession.createDataFrame(rows, model.schema)
        else:
            new = cut(_model(soft, smoothing))
            moved = new.select("field_name", "coder", F.flatten("table").alias("new")).join(
                model.select("field_name", "coder", F.flatten("table").alias("old")), ["field_name", "coder"]
            ).agg(F.max(F.array_max(F.zip_with("new", "old", lambda a, b: F.abs(a - b))))).first()[0]
            model = new
        if moved is None or moved < tolerance:
            return ballots, model
    raise RuntimeError(f"the votes did not settle in {most_rounds} rounds")


def consensus(ballots: DataFrame, model: DataFrame) -> DataFrame:
    """One row per article and field: answer, its share among the three, votes and observed agreement of voter pairs.

    Ties go to the first of yes, no, unclear. Articles without any usable vote have no row.
    """
    scored = _scored(ballots, model, model.limit(MAP_ROWS + 1).count() <= MAP_ROWS)
    s = _shares(scored, [F.col("prior")[k] + F.col("total")[k] for k in range(len(ANSWERS))])
    best = F.greatest(*[f"p{k}" for k in range(len(ANSWERS))])
    answer = F.when(F.col("p0") == best, ANSWERS[0]).when(F.col("p1") == best, ANSWERS[1]).otherwise(ANSWERS[2])
    counted = lambda i: F.aggregate(F.filter("vs", lambda v: v["answer"] == i + 1), F.lit(0).cast("long"), lambda x, v: x + v["n"])
    counts = [counted(i) for i in range(len(ANSWERS))]
    n = sum(counts[1:], counts[0])
    pairs = sum((c * (c - 1) for c in counts), F.lit(0))
    return s.select(
        "globaleventid", "field_name",
        answer.alias("answer"),
        best.alias("confidence"), n.alias("n_votes"),
        F.when(n > 1, pairs / (n * (n - 1))).alias("pair_agreement"),
    )


def field_agreement(flat: DataFrame) -> DataFrame:
    """Krippendorff's alpha per field of ``votes`` for nominal answers with missing ratings; null where it is undefined."""
    per = flat.groupBy("field_name", "globaleventid").agg(
        *[F.sum((F.col("answer") == i + 1).cast("double")).alias(f"n{i}") for i in range(len(ANSWERS))], F.count(F.lit(1)).alias("m")
    ).where("m > 1")
    disagree = sum((F.col(f"n{i}") * (F.col("m") - F.col(f"n{i}")) for i in range(len(ANSWERS))), F.lit(0.0)) / (F.col("m") - 1)
    t = per.groupBy("field_name").agg(
        F.sum(disagree).alias("d"), F.sum("m").alias("n"), *[F.sum(f"n{i}").alias(f"t{i}") for i in range(len(ANSWERS))], F.count(F.lit(1)).alias("n_items")
    )
    expected = sum((F.col(f"t{i}") * (F.col("n") - F.col(f"t{i}")) for i in range(len(ANSWERS))), F.lit(0.0)) / (F.col("n") - 1)
    return t.select("field_name", "n_items", F.col("n").alias("n_ratings"), (F.lit(1.0) - F.try_divide(F.col("d"), expected)).alias("alpha"))


def coder_reliability(model: DataFrame) -> DataFrame:
    """Per coder and field: votes and accuracy, the prior-weighted share of right answers."""
    n = range(len(ANSWERS))
    hit = sum((F.exp(F.col("prior")[k]) * F.col("table")[k][k] for k in n), F.lit(0.0)) / sum((F.exp(F.col("prior")[k]) for k in n), F.lit(0.0))
    return model.select("field_name", F.col("coder").alias("coder_id"), "n_votes", hit.alias("accuracy"))
