"""Not-modified revisits of web captures, resolved to the response they repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebars.sources.storage import materialize

# Headers that a not-modified response may update.
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]
# Query parameters that name where a visitor came from, not a page.
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid|msclkid|mc_cid|mc_eid|sessionid|phpsessid|jsessionid)(=|$)"

_URL = r"^(?i)https?://([^/?]*)([^?]*)\??(.*)$"


def canonical_url(url: Column) -> Column:
    """One form of an address: no scheme, user, default port, leading www, fragment or
    tracking parameters; lower-case host, parameters in order, no slash at the end.
    What is no web address is only trimmed."""
    bare = F.regexp_replace(F.trim(url), r"(?s)#.*$", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, _URL, 1)), r"^[^@]*@", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, _URL, 2), r"/+$", "")
    wanted = F.filter(F.split(F.regexp_extract(bare, _URL, 3), "&"), lambda p: (p != "") & ~F.regexp_like(F.lower(p), F.lit(TRACKING)))
    query = F.array_join(F.sort_array(wanted), "&")
    full = F.concat(F.regexp_replace(host, r"^www\.", ""), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(bare.rlike(_URL), full).otherwise(bare)


def _header(headers: Column, name: str) -> Column:
    return F.try_element_at(headers, F.lit(name))


def _lowered(headers: Column) -> Column:
    """Header names in lower case; of names that then coincide the last in order."""
    entries = F.array_sort(F.map_entries(headers))
    names = F.array_distinct(F.transform(entries, lambda e: F.lower(e["key"])))
    last = lambda n: F.element_at(F.filter(entries, lambda e: F.lower(e["key"]) == n), -1)["value"]
    return F.coalesce(F.map_from_arrays(names, F.transform(names, last)), F.create_map().cast("map<string,string>"))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Every not-modified record (status 304) with the response it stands for.

    ``records``: ``record_id, url, ts, status, headers`` (map of text) and ``digest`` of
    the payload; the project keeps no captures, so this is general. One row per 304
    record: ``record_id, url, canonical, ts, resolution, refers_to, matched_by,
    headers, digest``. The latest earlier full response (status 200) of the same
    canonical address, by time and then record id, is looked up as of the revisit.
    ``resolution`` is ``resolved`` if the validators agree (entity tags, weak or not, if
    both sides have one, else the times of last modification; ``matched_by`` says
    which), ``mismatch`` if they differ, ``unchecked`` if there is none to compare and
    ``missing`` without an earlier response. Resolved records carry the response's
    headers, updated by those a not-modified response may change, and its digest; the
    others their own headers and no digest. Missing addresses and times resolve to
    nothing; repeated rows are rows of their own; other columns are left out.

    Rows are dealt out by ranges of (address, time), so an address with a third of all
    captures spans many tasks: each task looks back within its range, and one row per
    range and address carries the last response on.
    """
    full = F.struct("record_id", "headers", "digest")
    rows = records.select("record_id", "url", F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("status").cast("int").alias("status"),
                          _lowered(F.col("headers")).alias("headers"), F.col("digest").cast("string").alias("digest"))
    rows = rows.withColumn("canonical", canonical_url(F.col("url"))).withColumn(
        "full", F.when((F.col("status") == 200) & F.col("canonical").isNotNull() & F.col("ts").isNotNull(), full))
    rows = rows.where("full is not null or status = 304")
    dealt = rows.repartitionByRange("canonical", "ts", "record_id").withColumn("part", F.spark_partition_id())
    dealt = materialize(dealt, "captures")
    # Of rows with the same time and id, the revisit comes first: such a response is not earlier.
    order = [F.col("ts"), F.col("record_id")]
    marked = dealt.withColumn("near", F.last("full", ignorenulls=True).over(
        Window.partitionBy("part", "canonical").orderBy(*order, F.coalesce("status", F.lit(0)).desc()).rowsBetween(Window.unboundedPreceding, -1)))
    ends = dealt.where("full is not null").groupBy("canonical", "part").agg(F.max_by("full", F.struct("ts", "record_id")).alias("full"))
    revisits = dealt.where("status = 304").select("canonical", "part").distinct()
    steps = revisits.join(ends, ["canonical", "part"], "full_outer")
    carried = steps.withColumn("far", F.last("full", ignorenulls=True).over(
        Window.partitionBy("canonical").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).select("canonical", "part", "far").where("far is not null")
    found = marked.where("status = 304").join(carried, ["canonical", "part"], "left").withColumn("hit", F.when(F.col("ts").isNotNull(), F.coalesce("near", "far")))
    weak = lambda tag: F.regexp_replace(tag, r"^W/", "")
    tags = [weak(_header(F.col(h), "etag")) for h in ("headers", "hit.headers")]
    times = [_header(F.col(h), "last-modified") for h in ("headers", "hit.headers")]
    by = F.when(tags[0].isNotNull() & tags[1].isNotNull(), "etag").when(times[0].isNotNull() & times[1].isNotNull(), "last-modified")
    checked = found.withColumn("matched_by", by).withColumn("resolution", F.when(F.col("hit").isNull(), "missing").when(F.col("matched_by").isNull(), "unchecked").when(
        F.when(F.col("matched_by") == "etag", tags[0] == tags[1]).otherwise(times[0] == times[1]), "resolved").otherwise("mismatch"))
    ok = F.col("resolution") == "resolved"
    news = F.map_filter("headers", lambda k, v: k.isin(PERMITTED))
    olds = F.map_filter("hit.headers", lambda k, v: F.try_element_at(news, k).isNull())
    return checked.select(
        "record_id", "url", "canonical", "ts", "resolution", F.when(F.col("hit").isNotNull(), F.col("hit.record_id")).alias("refers_to"),
        F.when(ok, F.col("matched_by")).alias("matched_by"), F.when(ok, F.map_concat(olds, news)).otherwise(F.col("headers")).alias("headers"),
        F.when(ok, F.col("hit.digest")).alias("digest"))
