"""Not-modified revisits of a web archive, resolved to the full responses they stand for.

A revisit is matched to the latest earlier full response of the same canonical URL (an as-of join).
Its validators are checked against that response, and the headers that a not-modified answer may
update are merged into the stored ones. The as-of join runs over slices of time with equal shares of
the records: the last response of
each slice is carried forward in a small table, so that a URL with very many captures is spread over
as many tasks as it has slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retailcast.session import materialize

SLICES = 256
# Headers that a 304 answer may update, in lower case.
UPDATED_HEADERS = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
# Parts of URLs that do not change what is served.
IDLE_PARAMETERS = r"(^|&)(utm_[^=&]*|ref|fbclid|gclid)(=[^&]*)?"


def canonical_url(url: Column) -> Column:
    """Scheme, the scheme's own port (80 without a scheme), leading www. or m., fragment, idle parameters,
    trailing slash and .html left out; the host in lower case, the parameters in order. Null stays null."""
    whole = F.regexp_replace(F.trim(url), r"#.*$", "")
    bare = F.regexp_replace(whole, r"^(?i:https?)://", "")
    named = F.regexp_replace(F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1)), r"^(www|m)\.", "")
    secure = F.lower(F.substring(whole, 1, 8)) == "https://"
    host = F.when(secure, F.regexp_replace(named, ":443$", "")).otherwise(F.regexp_replace(named, ":80$", ""))
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"(\.html)?/*$", "")
    query = F.regexp_replace(F.regexp_extract(bare, r"\?(.*)$", 1), IDLE_PARAMETERS, "")
    query = F.array_join(F.array_sort(F.split(F.regexp_replace(query, r"^&", ""), "&")), "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def _merged(stored: Column, fresh: Column) -> Column:
    """Stored headers, with those of ``fresh`` that may be updated in their place."""
    allowed = F.map_filter(F.coalesce(fresh, F.create_map().cast("map<string,string>")), lambda k, v: F.lower(k).isin(*UPDATED_HEADERS))
    names = F.transform(F.map_keys(allowed), lambda k: F.lower(k))
    kept = F.map_filter(F.coalesce(stored, F.create_map().cast("map<string,string>")), lambda k, v: ~F.array_contains(names, F.lower(k)))
    return F.map_concat(kept, allowed)


def _slice(time: Column, edges: list) -> Column:
    """How many of the ordered ``edges`` lie below a time, by halving."""

    def between(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(time <= F.lit(edges[middle]), between(low, middle)).otherwise(between(middle + 1, high))

    return between(0, len(edges))


def resolve_revisits(records: DataFrame, slices: int = SLICES) -> DataFrame:
    """One row per revisit: revisit_id, canonical, response_id, response_time, status, validator, headers.

    ``records`` has record_id, kind ('response' or 'revisit'), url, time (a number), etag,
    last_modified, digest and headers (a map). The response is the latest one of the same canonical
    URL with an earlier time; of responses at the same time the one with the largest record_id.
    ``status`` is 'resolved' if the first validator that both have (digest, etag, last_modified, named
    in ``validator``) agrees, 'mismatch' if it differs, 'unchecked' if they share none, 'missing' if
    there is no earlier response. ETags agree by weak comparison: ``W/`` before them does not count.
    Headers are merged when resolved, else they are the revisit's own, also when nothing was checked. Records without url or time match nothing; their revisits are 'missing'. Null
    headers are empty ones. Repeated revisits are resolved one by one. An empty table gives an empty
    result. Other columns, whatever their names, are not read.
    """
    own = records.select("record_id", "kind", canonical_url(F.col("url")).alias("canonical"), "time", "etag", "last_modified", "digest", "headers")
    own = own.where(F.col("kind").isin("response", "revisit"))
    own = materialize(own, "archive-records")
    usable = F.col("canonical").isNotNull() & F.col("time").isNotNull()
    # Edges between equal shares of the records, so that no odd time leaves one slice with all others.
    shares = [F.lit(i / slices) for i in range(1, slices)]
    edges = own.where(usable).agg(F.percentile_approx("time", F.array(*shares)) if shares else F.array()).first()[0]
    placed = own.where(usable).withColumn("slice", _slice(F.col("time"), sorted(set(edges or []))))
    answer = F.struct("time", "record_id", "etag", "last_modified", "digest", "headers")
    is_response = F.col("kind") == "response"
    # The last response of each URL and slice, carried to the next slices in which the URL occurs.
    ends = placed.groupBy("canonical", "slice").agg(F.max_by(answer, F.when(is_response, F.struct("time", "record_id"))).alias("end"))
    before = F.last("end", ignorenulls=True).over(Window.partitionBy("canonical").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    carried = ends.select(F.col("canonical").alias("c"), F.col("slice").alias("s"), before.alias("carried"))
    inside = Window.partitionBy("canonical", "slice").orderBy("time", F.when(is_response, 1).otherwise(0), "record_id").rowsBetween(Window.unboundedPreceding, -1)
    latest = F.last(F.when(is_response, answer), ignorenulls=True).over(inside)
    seen = placed.withColumn("latest", latest).where(~is_response)
    met = seen.join(carried, (F.col("canonical") == F.col("c")) & (F.col("slice") == F.col("s")), "left")
    met = met.withColumn("to", F.coalesce("latest", "carried")).drop("latest", "carried", "c", "s", "slice")
    rest = own.where(~usable & ~is_response).withColumn("to", F.lit(None).cast(met.schema["to"].dataType))
    return _checked(met.unionByName(rest))


def _checked(met: DataFrame) -> DataFrame:
    shared, agrees = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    for name in ("last_modified", "etag", "digest"):
        both = F.col(name).isNotNull() & F.col(f"to.{name}").isNotNull()
        shared = F.when(both, name).otherwise(shared)
        own, other = F.col(name), F.col(f"to.{name}")
        if name == "etag":
            own, other = F.regexp_replace(own, "^W/", ""), F.regexp_replace(other, "^W/", "")
        agrees = F.when(both, own == other).otherwise(agrees)
    status = F.when(F.col("to").isNull(), "missing").when(shared.isNull(), "unchecked").when(agrees, "resolved").otherwise("mismatch")
    with_status = met.withColumns({"status": status, "validator": shared})
    headers = F.when(F.col("status") == "resolved", _merged(F.col("to.headers"), F.col("headers"))).otherwise(F.coalesce("headers", F.create_map().cast("map<string,string>")))
    return with_status.select(
        F.col("record_id").alias("revisit_id"),
        "canonical",
        F.col("to.record_id").alias("response_id"),
        F.col("to.time").alias("response_time"),
        "status",
        "validator",
        headers.alias("headers"),
    )
