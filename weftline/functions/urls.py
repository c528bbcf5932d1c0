"""URL columns: normal form, host, PDF and image tests; all in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track the reader.
TRACKERS = r"^(utm_.*|fbclid|gclid|mc_.*)$"


def host(url: Column) -> Column:
    """Lower-case host (with a port, if any) without 'www.'; null if there is none."""
    raw = F.lower(F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))
    return F.nullif(F.regexp_replace(raw, r"^www\.", ""), F.lit(""))


def raw_host(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)), F.lit(""))


def normal_url(url: Column) -> Column:
    """https, lower-case host without www, no fragment, no trackers or blank parameters, no slash at the end; null for null or blank."""
    u = F.trim(url)
    path = F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda p: ~F.regexp_extract(F.lower(p), "^([^=]*)", 1).rlike(TRACKERS) & p.rlike("^[^=]+=.+"))
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1))
    head = F.concat(F.when(scheme.isin("http", "https"), "https").otherwise(scheme), F.lit("://"), F.coalesce(host(url), F.lit("")))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    whole = F.concat(head, F.regexp_replace(path, "/+$", ""), tail)
    return F.when(u == "", None).when(host(url).isNull(), u).otherwise(whole)


def is_pdf(url: Column) -> Column:
    low = F.lower(F.coalesce(url, F.lit("")))
    return low.endswith(".pdf") | low.contains(".pdf?")


def is_page(url: Column) -> Column:
    """No image and no PDF by its ending."""
    return ~F.lower(F.coalesce(url, F.lit(""))).rlike(r"\.(jpg|jpeg|png|gif|webp|pdf)(\?|$)")
