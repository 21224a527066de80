"""WARC: not-modified revisits resolved against the captures they stand for.

A revisit with the server-not-modified profile has no body. It belongs to the latest earlier full response of its canonical
URL, if the validators agree: entity tags by weak comparison, or Last-Modified where the revisit has no tag. The stored
headers are then updated with those of the 304 answer that HTTP lets it change.

The as-of join is a running last value, in three levels so that neither a URL nor its day is a task of its own: records are
ordered within (URL, ten seconds), the last response of each ten seconds is carried over its day, and that of each day over
days. Bodies do not move; a resolved record names the one that holds its body.

Defined results: records without a URL or a time, and revisits with nothing earlier, are unresolved (`no_response`); of
responses at one time the largest id counts as the latest; a response at the revisit's own time is not earlier; disagreeing
validators give `mismatch`, none at all on the revisit `unvalidated`. Repeated records are resolved alike; an empty table gives
an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.session import ensure_checkpoint_dir

DAY, SLOT = 86_400, 10
# Fields that an answer without a body must not change.
FIXED_HEADERS = ("connection", "content-encoding", "content-length", "content-location", "content-range", "content-type", "keep-alive", "proxy-authenticate", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade")
# Query parameters that do not change what is served.
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid|sessionid|phpsessid|jsessionid)(=.*)?$"


def canonical_url(url: Column) -> Column:
    """Scheme and leading www. dropped, host in lower case, no default port, fragment, tracking parameters or trailing slash,
    and the other parameters sorted."""
    plain = F.regexp_replace(F.trim(url), r"#.*$", "")
    host = F.lower(F.regexp_extract(plain, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(plain, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?]*([^?]*)", 1), r"(/index\.html?|/)$", "")
    query = F.regexp_extract(plain, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike(TRACKING)))
    return F.when(host != "", F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit(""))))


def headers(block: Column) -> Column:
    """The fields of a header block as a map from lower-case names; the last of repeated fields counts."""
    fields = F.filter(F.split(block, "\r?\n"), lambda line: line.rlike(r"^[!-9;-~]+:"))
    pairs = F.transform(fields, lambda line: F.struct(F.lower(F.regexp_extract(line, r"^([^:]+):", 1)).alias("name"), F.trim(F.regexp_extract(line, r"^[^:]+:(.*)$", 1)).alias("value")))
    # A map of lists has each name once: names are sorted with their places, and of neighbours with one name the last stays.
    ordered = F.array_sort(F.transform(pairs, lambda p, i: F.struct(p["name"].alias("name"), i.alias("at"), p["value"].alias("value"))))
    last = F.element_at(F.transform(F.array(ordered), lambda o: F.filter(o, lambda p, i: F.coalesce(F.get(o, i + 1)["name"] != p["name"], F.lit(True)))), 1)
    return F.map_from_entries(F.transform(last, lambda p: F.struct(p["name"], p["value"])))


def parsed(records: DataFrame, raw: str = "raw") -> DataFrame:
    """The columns that `resolve` reads, from whole WARC records: their own header block, the HTTP header block, a body.

    A record is split once, at its first two blank lines; every further step is a projection of its own, so that no block is
    parsed for each field anew.
    """
    parts = records.select(F.split(raw, r"\r?\n\r?\n", 3).alias("parts"))
    blocks = parts.select(headers(F.col("parts")[0]).alias("warc"), F.coalesce(F.get("parts", F.lit(1)), F.lit("")).alias("http"))
    status = F.regexp_extract("http", r"^HTTP/[0-9.]+ ([0-9]{3})", 1)
    warc = F.col("warc")
    # To the second, or with up to nine digits of fraction, of which microseconds count.
    date = F.when(warc["warc-date"].rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{1,9})?Z?$"), F.regexp_replace(warc["warc-date"], "Z$", ""))
    moment = F.try_to_timestamp(date).cast("timestamp_ntz")
    return blocks.select(
        warc["warc-record-id"].alias("record_id"), warc["warc-target-uri"].alias("url"), moment.alias("time"),
        warc["warc-type"].alias("kind"), warc["warc-profile"].alias("profile"), F.when(status != "", status.cast("int")).alias("status"), headers(F.col("http")).alias("headers"),
    )


def _tag(value: Column) -> Column:
    return F.regexp_replace(value, "^W/", "")


def resolve(records: DataFrame) -> DataFrame:
    """A row for each not-modified revisit of `records` (record_id, url, time, kind, profile, status, headers):
    revisit_id, url, time, outcome, response_id and merged headers (null unless resolved)."""
    revisit = (F.col("kind") == "revisit") & F.coalesce(F.col("profile").contains("server-not-modified"), F.lit(False))
    full = (F.col("kind") == "response") & (F.col("status") == 200)
    # Kept without bodies, once: the branches below would else parse all records again, and a filter would work the fields out twice.
    ensure_checkpoint_dir(records.sparkSession)
    told = records.select("record_id", "time", "headers", canonical_url(F.col("url")).alias("key"), "url", revisit.alias("revisit"), full.alias("full"))
    known = told.checkpoint().where("revisit or full")
    lost = known.where("revisit and (key is null or time is null)").withColumn("found", F.lit(None))
    usable = known.where("key is not null and time is not null").withColumn("seconds", F.unix_micros(F.col("time").cast("timestamp")) / F.lit(1_000_000.0)).withColumn("day", F.floor(F.col("seconds") / DAY)).withColumn("slot", F.floor(F.col("seconds") / SLOT))
    stored = F.when(F.col("full"), F.struct("time", "record_id", "headers"))
    usable = usable.withColumn("stored", stored)

    def before(level: str, within: list[str], lasts: DataFrame) -> DataFrame:
        """For every step of `level` in which revisits lie, the last response of the steps before it in the same group."""
        asked = usable.where("revisit").select(*within, level).distinct().join(lasts, [*within, level], "full")
        earlier = W.partitionBy(*within).orderBy(level).rowsBetween(W.unboundedPreceding, -1)
        return asked.select(*within, level, F.last("last", ignorenulls=True).over(earlier).alias(f"before_{level}"))

    latest = F.max_by("stored", F.struct("time", "record_id")).alias("last")
    slots = usable.where("full").groupBy("key", "day", "slot").agg(latest)
    days = slots.groupBy("key", "day").agg(F.max_by("last", F.struct("last.time", "last.record_id")).alias("last"))
    earlier = W.partitionBy("key", "day", "slot").orderBy("time", F.col("full").cast("int"), "record_id").rowsBetween(W.unboundedPreceding, -1)
    now = usable.withColumn("now", F.last("stored", ignorenulls=True).over(earlier)).where("revisit")
    joined = now.join(before("slot", ["key", "day"], slots), ["key", "day", "slot"], "left").join(before("day", ["key"], days), ["key", "day"], "left")
    joined = joined.withColumn("found", F.coalesce("now", "before_slot", "before_day"))
    found = joined.select("record_id", "url", "time", "headers", "found").unionByName(lost.select("record_id", "url", "time", "headers", F.lit(None).cast(joined.schema["found"].dataType).alias("found")))

    tag, old_tag = F.col("headers")["etag"], F.col("found.headers")["etag"]
    date, old_date = F.col("headers")["last-modified"], F.col("found.headers")["last-modified"]
    outcome = (
        F.when(F.col("found").isNull(), "no_response")
        .when(tag.isNotNull(), F.when(_tag(tag) == F.coalesce(_tag(old_tag), F.lit("")), "resolved").otherwise("mismatch"))
        .when(date.isNotNull(), F.when(date == F.coalesce(old_date, F.lit("")), "resolved").otherwise("mismatch"))
        .otherwise("unvalidated")
    )
    fresh = F.map_filter("headers", lambda k, v: ~k.isin(*FIXED_HEADERS))
    merged = F.map_concat(F.map_filter("found.headers", lambda k, v: ~F.array_contains(F.map_keys(fresh), k)), fresh)
    told = found.withColumn("outcome", outcome)
    resolved = F.col("outcome") == "resolved"
    return told.select(F.col("record_id").alias("revisit_id"), "url", "time", "outcome", F.when(resolved, F.col("found.record_id")).alias("response_id"), F.when(resolved, merged).alias("headers"))


def header_text(fields: Column) -> Column:
    """A map of headers as sorted lines; null for null."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(fields), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "\n")


def captures(pages: DataFrame) -> DataFrame:
    """Raw WARC records made from pages: for each a full response, and a 304 revisit some days later whose tag disagrees for
    every seventh page and is missing for every fifth."""
    eol = F.lit("\r\n")
    n = F.col("page_id")
    moment = lambda t: F.date_format(F.timestamp_seconds(F.lit(1_704_067_200) + t), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    first, later = n * 60, n * 60 + (n % 5 + 1) * DAY + 30
    tag = F.concat(F.lit('"'), F.substring(F.md5(F.coalesce("html", F.lit(""))), 1, 16), F.lit('"'))
    date = F.concat(F.lit("day "), (n % 30).cast("string"))

    def record(kind: str, ident: Column, t: Column, lines: list[Column], http: list[Column], body: Column) -> Column:
        own = [F.lit("WARC/1.0"), F.lit(f"WARC-Type: {kind}"), F.concat(F.lit("WARC-Record-ID: "), ident), F.concat(F.lit("WARC-Target-URI: "), F.col("url")), F.concat(F.lit("WARC-Date: "), moment(t)), *lines]
        return F.concat(F.concat_ws("\r\n", *own), eol, eol, F.concat_ws("\r\n", *http), eol, eol, body)

    length = F.concat(F.lit("Content-Length: "), F.length(F.coalesce("html", F.lit(""))).cast("string"))
    response = record(
        "response", F.concat(F.lit("r"), n.cast("string")), first, [],
        [F.lit("HTTP/1.1 200 OK"), F.lit("Content-Type: text/html"), length, F.concat(F.lit("ETag: "), tag), F.concat(F.lit("Last-Modified: "), date), F.lit("Cache-Control: max-age=60")], F.coalesce("html", F.lit("")),
    )
    answered = F.when(n % 7 == 0, F.lit('ETag: "other"')).when(n % 5 != 0, F.concat(F.lit("ETag: W/"), tag))
    revisit = record(
        "revisit", F.concat(F.lit("v"), n.cast("string")), later, [F.lit("WARC-Profile: http://netpreserve.org/warc/1.0/revisit/server-not-modified")],
        [F.lit("HTTP/1.1 304 Not Modified"), answered, F.concat(F.lit("Last-Modified: "), date), F.lit("Cache-Control: max-age=600"), F.lit("Content-Length: 0"), F.concat(F.lit("X-Seen: "), (n % 3).cast("string"))], F.lit(""),
    )
    return pages.where("page_id is not null and url is not null").select(F.explode(F.array(response, revisit)).alias("raw"))
