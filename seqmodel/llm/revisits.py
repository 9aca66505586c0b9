"""Not-modified revisits of web captures resolved to the full responses they refer to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqmodel.sources.scratch import written

# Headers that describe the stored body or the one connection; a 304 does not change them.
KEPT_HEADERS = (
    "connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive",
    "proxy-authenticate", "proxy-authentication-info", "proxy-authorization", "proxy-connection", "te", "trailer",
    "transfer-encoding", "upgrade",
)
#: Query parameters that do not change the page.
TRACKING = r"(?:utm_[a-z]+|ref|fbclid|gclid|sessionid|phpsessid)"
_SEGMENT = "__segment"


def canonical_url(url: Column) -> Column:
    """Scheme, ``www.`` and default port dropped, host lower-cased, no fragment, no tracking parameters, the other
    parameters sorted, no slash at the end. Null and empty stay null and empty."""
    plain = F.regexp_replace(F.regexp_replace(url, r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(plain, r"^([^/?]*)", 1)), r"^www\.|:(?:80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(plain, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(plain, r"^[^?]*\?(.*)$", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(rf"^(?i:{TRACKING})(?:=|$)"))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(kept), "&"))).otherwise("")
    return F.concat(host, path, tail)


def merged_headers(stored: Column, fresh: Column) -> Column:
    """``stored`` with those of ``fresh`` that a 304 may change. Names are lower-cased; of one name the last counts."""

    def lowered(m: Column) -> Column:
        entries = F.map_entries(F.coalesce(m, F.expr("cast(map() as map<string,string>)")))
        return F.transform(entries, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))

    new = F.filter(lowered(fresh), lambda e: ~e["key"].isin(*KEPT_HEADERS))
    both = F.concat(lowered(stored), new)
    last = F.filter(both, lambda e, i: ~F.exists(F.slice(both, i + 2, F.greatest(F.size(both) - i - 1, F.lit(0))), lambda o: o["key"] == e["key"]))
    return F.map_from_entries(F.array_sort(last))


def _header(headers: Column, name: str) -> Column:
    found = F.filter(F.map_entries(headers), lambda e: F.lower(e["key"]) == name)
    return F.get(found, F.lit(0))["value"]


def _weak(etag: Column) -> Column:
    return F.regexp_replace(etag, r"^W/", "")


def resolve_revisits(captures: DataFrame, url_col: str = "url") -> DataFrame:
    """A row per revisit: the capture with ``response_id``, ``status`` and ``merged`` headers.

    ``captures`` has ``record_id``, ``url_col``, ``ts``, ``kind`` (``response``, ``revisit``; others are ignored),
    ``digest`` of the payload and ``headers`` (map). A revisit belongs to the latest full response of its
    canonical URL at an earlier time; of responses at one time the largest record id counts. It is ``resolved``
    if the ETags agree (weak comparison), or without both ETags the Last-Modified, or without both of these the
    digests; ``mismatch`` if they differ or nothing can be compared; ``no_response`` if there is no earlier
    response. Only resolved revisits get merged headers. Revisits without url or time have no response.

    Captures are range-partitioned on (url, time), so that one URL may fill many tasks; the latest response at the
    end of each segment is carried into the next. Bodies are not moved. Other columns are not read.
    """
    url, kind = F.col(url_col), F.col("kind")
    slim = captures.where(kind.isin("response", "revisit")).select(
        "record_id", canonical_url(url).alias("curl"), F.col("ts"), (kind == "response").alias("full"), "digest", "headers"
    )
    usable = F.col("curl").isNotNull() & F.col("ts").isNotNull()
    good = slim.where(usable)
    # a response at the time of a revisit is not earlier: revisits come first
    order = ["curl", "ts", "full", "record_id"]
    parts = max(1, int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = good.repartitionByRange(parts, *order).withColumn(_SEGMENT, F.spark_partition_id())
    ranged = written(ranged, "captures")
    response = F.when(F.col("full"), F.struct("ts", "record_id", "digest", "headers"))
    inside = Window.partitionBy("curl", _SEGMENT).orderBy("ts", "full", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    within = ranged.withColumn("own", F.last(response, ignorenulls=True).over(inside)).where("not full")
    ends = ranged.where("full").groupBy("curl", _SEGMENT).agg(
        F.max_by(F.struct("ts", "record_id", "digest", "headers"), F.struct("ts", "record_id")).alias("end")
    )
    asked = within.select("curl", _SEGMENT).distinct().withColumn("asked", F.lit(True))
    chain = Window.partitionBy("curl").orderBy(_SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        ends.join(asked, ["curl", _SEGMENT], "full").withColumn("carried", F.last("end", ignorenulls=True).over(chain))
        .where("asked and carried is not null").select("curl", _SEGMENT, "carried")
    )
    joined = within.join(carried, ["curl", _SEGMENT], "left").withColumn("found", F.coalesce("own", "carried"))
    lost = slim.where(~usable & ~F.col("full"))
    none = F.lit(None).cast(joined.schema["found"].dataType)
    rows = joined.select("record_id", "curl", "ts", "digest", "headers", "found").union(
        lost.select("record_id", "curl", "ts", "digest", "headers", none.alias("found"))
    )
    old, new = F.col("found.headers"), F.col("headers")
    e0, e1, m0, m1 = _weak(_header(old, "etag")), _weak(_header(new, "etag")), _header(old, "last-modified"), _header(new, "last-modified")
    same = (
        F.when(e0.isNotNull() & e1.isNotNull(), e0 == e1).when(m0.isNotNull() & m1.isNotNull(), m0 == m1)
        .otherwise(F.coalesce(F.col("found.digest") == F.col("digest"), F.lit(False)))
    )
    status = F.when(F.col("found").isNull(), "no_response").when(same, "resolved").otherwise("mismatch")
    return rows.withColumn("status", status).select(
        "record_id", F.col("curl").alias("canonical_url"), "ts", F.col("found.record_id").alias("response_id"), "status",
        F.when(F.col("status") == "resolved", merged_headers(old, new)).alias("merged"),
    )


def header_text(headers: Column) -> Column:
    """``name: value`` lines in the order of names."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")


def captures_of(pages: DataFrame) -> DataFrame:
    """A crawl over all of ``pages``: each page's visit in the order of page ids, and a revisit of the same URL later.

    Visits of URLs whose digest begins with 0 or 1 got a 304 themselves. Revisits carry the ETag of the page, every fifth
    another one, every third none but the Last-Modified; header names vary in case. Null ids and urls stay null.
    """
    no, md5 = F.col("page_id"), F.md5(F.coalesce(F.col("html"), F.lit("")))
    known = F.left(F.md5(F.coalesce(F.col("url"), F.lit(""))), F.lit(1)).isin("0", "1")
    first = pages.select(
        (no * 2).alias("record_id"), "url", (no * 10).alias("ts"), F.when(known, "revisit").otherwise("response").alias("kind"),
        md5.alias("digest"),
        F.create_map(
            F.lit("Content-Type"), F.lit("text/html"), F.lit("ETag"), F.concat(F.lit('"'), F.left(md5, F.lit(16)), F.lit('"')),
            F.lit("Last-Modified"), F.concat(F.lit("day "), no.cast("string")), F.lit("Cache-Control"), F.lit("max-age=60"),
        ).alias("headers"),
    )
    tag = F.when(no % 5 == 0, F.lit('"other"')).otherwise(F.concat(F.lit('W/"'), F.left(md5, F.lit(16)), F.lit('"')))
    shared = [F.lit("content-type"), F.lit("text/plain"), F.lit("cache-control"), F.lit("max-age=3600"), F.lit("Date"), F.concat(F.lit("day "), (no + 500).cast("string"))]
    again = pages.select(
        (no * 2 + 1).alias("record_id"), "url", (no * 10 + 5000).alias("ts"), F.lit("revisit").alias("kind"), md5.alias("digest"),
        F.when(no % 3 == 0, F.create_map(*shared, F.lit("last-modified"), F.concat(F.lit("day "), no.cast("string"))))
        .otherwise(F.create_map(*shared, F.lit("etag"), tag)).alias("headers"),
    )
    return first.union(again)


def sql() -> str:
    """``resolve_revisits(captures_of(pages))`` in DuckDB SQL, merged headers as text."""
    return rf"""
    with named as (select page_id as no, url, '"' || left(md5(coalesce(html, '')), 16) || '"' as tag,
        regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') as plain from pages),
    cut as (select *, list_sort(list_filter(string_split(regexp_extract(plain, '^[^?]*\?(.*)$', 1), '&'),
            lambda p: p <> '' and not regexp_matches(p, '^(?i:{TRACKING})(?:=|$)'))) as kept from named),
    page as (select no, tag, left(md5(coalesce(url, '')), 1) in ('0', '1') as known,
        regexp_replace(lower(regexp_extract(plain, '^([^/?]*)', 1)), '^www\.|:(?:80|443)$', '', 'g')
        || regexp_replace(regexp_extract(plain, '^[^/?]*([^?]*)', 1), '/+$', '')
        || case when len(kept) > 0 then '?' || array_to_string(kept, '&') else '' end as curl from cut),
    full_ as (select curl, no * 10 as ts, max(no * 2) as response_id, arg_max(tag, no) as old_tag, arg_max('day ' || no, no) as old_day
        from page where not known group by all),
    revisit as (
        select no * 2 as record_id, curl, no * 10 as ts, tag as new_tag, 'day ' || no as new_day, 'max-age=60' as cache, null as date from page where known
        union all
        select no * 2 + 1, curl, no * 10 + 5000, case when no % 3 = 0 then null when no % 5 = 0 then '"other"' else 'W/' || tag end,
            case when no % 3 = 0 then 'day ' || no end, 'max-age=3600', 'day ' || (no + 500) from page),
    found as (select r.*, response_id, old_tag, old_day, case when response_id is null then 'no_response'
            when case when new_tag is not null then regexp_replace(new_tag, '^W/', '') = old_tag else new_day = old_day end then 'resolved'
            else 'mismatch' end as status
        from revisit r asof left join full_ f on r.curl = f.curl and r.ts > f.ts)
    select record_id, curl as canonical_url, ts, response_id, status, case when status = 'resolved' then
        'cache-control: ' || cache || chr(10) || 'content-type: text/html' || coalesce(chr(10) || 'date: ' || date, '') || chr(10)
        || 'etag: ' || coalesce(new_tag, old_tag) || chr(10) || 'last-modified: ' || coalesce(new_day, old_day) end as merged
    from found"""
