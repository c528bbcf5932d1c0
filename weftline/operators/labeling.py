"""Work queues for outside labellers and translators, answer parsing, and comparison with manual labels.

Outside services are functions that the caller gives; errors are caught per row
and come back as failure rows, so a queue is resumed by leaving out what is done.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import text as t


class StopLabelling(RuntimeError):
    """Raised by a labeller that cannot go on at all (no access, no quota): ends the job instead of failing row by row."""


def queue(rows: DataFrame, done: DataFrame, keys: Sequence[str], ok: Column | None = None) -> DataFrame:
    """Rows whose keys are not done; with ``ok``, only done rows for which it holds count (failed ones come again)."""
    return rows.join((done if ok is None else done.where(ok)).select(*keys).distinct(), list(keys), "left_anti")


def next_items(items: DataFrame, labels: DataFrame, key: str, who: str, annotator: str, share: float = 0.1, last: Column | None = None) -> DataFrame:
    """(key, by_others) of the items that an annotator may get next: none labelled by them, and none that others labelled
    once such items have reached ``share`` of their labels. ``last`` marks the item at hand, which does not come again."""
    marks = labels.where(F.col(key).isNotNull()).groupBy(key).agg(F.max((F.col(who) == annotator).cast("int")).alias("_own"), F.max((F.col(who) != annotator).cast("int")).alias("_others"))
    spent = marks.agg(F.sum("_own").alias("n"), F.sum(F.col("_own") * F.col("_others")).alias("both")).first()
    allowed = (spent["both"] or 0) < int(((spent["n"] or 0) + 1) * share)
    left = items.select(key).where(F.col(key).isNotNull() if last is None else F.col(key).isNotNull() & ~last).distinct().join(marks, key, "left").where(F.coalesce("_own", F.lit(0)) == 0)
    told = left.select(key, (F.coalesce("_others", F.lit(0)) == 1).alias("by_others"))
    return told if allowed else told.where("not by_others")


def translation_queue(rows: DataFrame, language: str, text: str) -> DataFrame:
    """Rows in a known language other than English with a text; nothing else is ever sent out."""
    lang = t.label_form(F.col(language))
    return rows.where(~lang.isin("", "en", "unknown", "und") & (F.trim(F.coalesce(text, F.lit(""))) != ""))


def outside(rows: DataFrame, work: Callable[[str], str], key: str, text: str, chunk: int | None = None) -> DataFrame:
    """(key, answer, error): ``work`` on each text (in chunks joined by blanks if ``chunk`` is given)."""

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, x in zip(pdf[key], pdf[text]):
                try:
                    parts = t.chunks(x, chunk) if chunk else [x or ""]
                    out.append((k, " ".join(work(p) for p in parts), None))
                except StopLabelling:
                    raise
                except Exception as problem:
                    out.append((k, None, f"{type(problem).__name__}: {problem}"[:500]))
            yield pd.DataFrame(out, columns=[key, "answer", "error"])

    return rows.select(key, text).mapInPandas(go, f"{key} {dict(rows.dtypes)[key]}, answer string, error string")


def parsed(answers: DataFrame, schema: str, allowed: dict[str, Sequence[str]]) -> DataFrame:
    """Answers (JSON objects) as columns, with ``problem``: 'malformed' (no object, or none of the checked columns), the first column outside its allowed values, or null."""
    rows = answers.withColumn("_j", F.from_json("answer", schema))
    given = F.lit(False)
    for name in allowed:
        given = given | F.col(f"_j.{name}").isNotNull()
    bad = F.when(F.col("_j").isNull() | ~given, "malformed")
    for name, values in allowed.items():
        bad = bad.when(~F.coalesce(t.label_form(F.col(f"_j.{name}")).isin(*values), F.lit(False)), name)
    return rows.withColumn("problem", bad).select(*[c for c in answers.columns], "_j.*", "problem")


def records(column: Column, schema: str) -> Column:
    """A JSON list as an array of structs; malformed or null gives an empty one."""
    return F.coalesce(F.from_json(column, f"array<{schema}>"), F.from_json(F.lit("[]"), f"array<{schema}>"))


def with_defaults(labels: DataFrame, when: Column, defaults: dict[str, str]) -> DataFrame:
    """Labels with fixed values for the fields of rows where ``when`` holds."""
    return labels.withColumns({c: F.when(when, F.lit(v)).otherwise(F.col(c)) for c, v in defaults.items()})


def compared(manual: DataFrame, predicted: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """(field, n, n_match, share): normalised agreement per field over rows that both have."""
    m = manual.select(*keys, *[t.label_form(F.col(f)).alias(f"m_{f}") for f in fields])
    p = predicted.select(*keys, *[t.label_form(F.col(f)).alias(f"p_{f}") for f in fields])
    long = m.join(p, list(keys)).select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), (F.col(f"m_{f}") == F.col(f"p_{f}")).alias("same")) for f in fields])).alias("x")).select("x.*")
    g = long.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.count_if("same").alias("n_match"))
    return g.withColumn("share", F.try_divide(F.col("n_match"), F.col("n")))


def function_word_language(text: Column, words: dict[str, str], least_chars: int = 40) -> Column:
    """The language whose function words a text has most distinct ones of; 'unknown' for short texts, ties and texts without any.

    For scripts of one language the words can be its letters. Stays in the JVM.
    """
    tokens = F.array_distinct(t.tokens(text))
    hits = F.array_sort(F.array(*[F.struct((-F.size(F.array_intersect(tokens, F.array(*map(F.lit, w.split()))))).alias("n"), F.lit(k).alias("lang")) for k, w in sorted(words.items())]))
    clear = (hits[0]["n"] < 0) & (hits[0]["n"] < hits[1]["n"])
    return F.when((F.length(F.coalesce(text, F.lit(""))) < least_chars) | ~clear, "unknown").otherwise(hits[0]["lang"])
