"""Readers with explicit schemas: parquet, CSV in any encoding, JSON lines, optional and twin files, page fetches."""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

EVENT = ("globaleventid long, sqldate int, dateadded long, actor1name string, actor2name string, actor1countrycode string, actor2countrycode string, eventcode string, eventbasecode string, "
         "eventrootcode string, quadclass int, goldsteinscale double, nummentions int, numsources int, numarticles int, avgtone double, actiongeo_fullname string, actiongeo_countrycode string, "
         "actiongeo_lat double, actiongeo_long double, sourceurl string")
MENTION = ("globaleventid long, eventtimedate long, mentiontimedate long, mentiontype int, mentionsourcename string, mentionidentifier string, confidence int, mentiondoclen int, mentiondoctone double, sentenceid int")
GED = ("id long, date_start string, side_a_new_id string, side_a string, side_b_new_id string, side_b string, country string, adm_1 string, latitude double, longitude double, where_prec int, best double")
CROSSWALK = "analysis_actor_key string, analysis_actor_name string, representative_ucdp_actor_id string, constituent_ucdp_actor_id string, constituent_actor_name string, group_note string"


def csv(spark: SparkSession, path: str | Sequence[str], schema: StructType | str, encoding: str = "UTF-8", columns: Sequence[str] | None = None) -> DataFrame:
    """CSV with header, quoted line breaks and doubled quotes; ``columns`` prunes what is read."""
    df = spark.read.schema(schema).options(header=True, multiLine=True, quote='"', escape='"', encoding=encoding).csv(list(path) if not isinstance(path, str) else path)
    return df.select(*columns) if columns else df


def header(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV file."""
    return spark.read.option("header", True).csv(path).columns


def json_lines(spark: SparkSession, path: str, schema: StructType | str, error: str | None = "error") -> DataFrame:
    """JSON lines, without blank lines, unreadable lines and, if the column exists, records with an error."""
    df = spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)
    given = F.lit(False)
    for c in df.columns:
        given = given | F.col(c).isNotNull()
    df = df.where(given)
    return df.where(F.coalesce(F.trim(error), F.lit("")) == "") if error and error in df.columns else df


def optional(spark: SparkSession, path: str, schema: StructType | str, form: str = "parquet") -> DataFrame:
    """A table, or an empty one of the schema if the path does not exist."""
    try:
        return getattr(spark.read.schema(schema), form)(path)
    except Exception as problem:
        if "PATH_NOT_FOUND" not in str(problem):
            raise
        return spark.createDataFrame([], schema)


def fresher_twin(csv_path: str) -> tuple[str, str]:
    """('parquet', path) of a file's parquet twin if that exists and is not older, else ('csv', path)."""
    twin = os.path.splitext(csv_path)[0] + ".parquet"
    if os.path.exists(twin) and (not os.path.exists(csv_path) or os.path.getmtime(twin) >= os.path.getmtime(csv_path)):
        return "parquet", twin
    return "csv", csv_path


def last_file_wins(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of rows with equal keys the one from the last file by name; within a file by the greatest row."""
    order = [F.col("_file").desc(), *[F.col(c).desc_nulls_last() for c in df.columns]]
    named = df.withColumn("_file", F.input_file_name())
    return named.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r", "_file")


def first_column(df: DataFrame, names: Sequence[str], needed: bool = True) -> str | None:
    """The first of the names that the frame has."""
    found = next((n for n in names if n in df.columns), None)
    if found is None and needed:
        raise ValueError(f"none of {list(names)} is a column")
    return found


def with_retries(call: Callable[[], object], tries: int = 5, first_wait: float = 5.0, again: Callable[[Exception], bool] = lambda e: True, sleep: Callable[[float], None] = time.sleep):
    """The result of a call; waits twice as long before each new try."""
    for n in range(tries):
        try:
            return call()
        except Exception as problem:
            if n == tries - 1 or not again(problem):
                raise
            sleep(first_wait * 2**n)


def fetched(urls: DataFrame, fetch: Callable[[str], tuple[int, str, str]], key: str, url: str) -> DataFrame:
    """(key, url, http_status, content_type, html, failure): pages by a given fetch function, one client per task; any error becomes a failure row."""

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, u in zip(pdf[key], pdf[url]):
                try:
                    status, kind, body = with_retries(lambda u=u: fetch(u), tries=2, first_wait=0.1)
                    failure = "http_error" if status >= 400 else None if "html" in (kind or "").lower() else "not_html"
                    rows.append((k, u, status, kind, body if failure is None else None, failure))
                except Exception as problem:
                    rows.append((k, u, None, None, None, type(problem).__name__))
            yield pd.DataFrame(rows, columns=[key, url, "http_status", "content_type", "html", "failure"])

    kind = dict(urls.dtypes)[key]
    return urls.select(key, url).mapInPandas(go, f"{key} {kind}, {url} string, http_status int, content_type string, html string, failure string")
