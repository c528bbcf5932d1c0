"""Queries of the incremental forms; on a batch table they give what the stream gives after its last file."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from weftline.session import table
from weftline.streaming import incremental as s

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f
    return add


@query("""select event_type, timestamp '2019-12-30' + interval 1 day * (floor((cast(ts as date) - date '2019-12-30') / 14.0) * 14)::int as block_start, count(*) as n, sum(value) as total from events group by 1, 2""")
def incremental_blocks(spark, folder):
    """Streamed file by file into a memory table, complete mode; equals the batch aggregate."""
    path = f"{folder}/events.parquet"
    batch = table(spark, folder, "events")
    source, pattern = (path, None) if os.path.isdir(path) else (folder, "events.parquet")
    stream = s.block_counts(s.new_files(spark, source, batch.schema, 10, pattern).withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type", 2, "1 day", "value")
    name = f"blocks_{uuid.uuid4().hex[:12]}"
    stream.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).withColumn("block_start", F.col("block_start").cast("timestamp_ntz"))


_AT = "try_strptime(cast({0} as varchar), '%Y%m%d%H%M%S')"


@query(f"""with m as (select *, {_AT.format('mentiontimedate')} as told from mention), e as (select distinct globaleventid, {_AT.format('eventtimedate')} as seen from mention)
select m.globaleventid, count(*) as n_rows, min(told) as first_told from m join e on e.globaleventid = m.globaleventid where told >= seen and told <= seen + interval 24 hours group by 1""")
def mentions_within_day(spark, folder):
    from weftline.functions.dates import moment_of

    m = table(spark, folder, "mention").withColumn("told", moment_of(F.col("mentiontimedate")).cast("timestamp_ntz"))
    e = m.select("globaleventid", moment_of(F.col("eventtimedate")).cast("timestamp_ntz").alias("seen")).distinct()
    return s.mentions_in_time(e, m, "globaleventid", "seen", "told").groupBy("globaleventid").agg(F.count(F.lit(1)).alias("n_rows"), F.min("told").alias("first_told"))
