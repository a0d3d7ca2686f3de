"""Not-modified revisits of web archives, resolved to the latest earlier full response of the same canonical address.

The as-of join cuts each address into time buckets. Inside a bucket a window finds the latest earlier response; revisits
that find none take the last response of an earlier bucket, carried over one row per bucket. No group holds more than one
bucket of one address, or one address's buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window

#: Header fields of a not-modified answer that never replace those of the stored response.
NOT_MERGED = ("connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate",
              "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade")
BUCKET_SECONDS = 6 * 3600


def canonical(url: Column) -> Column:
    """Lower-case scheme and host, without user, default port and fragment; query parameters in order; empty path as /.

    Text that is no absolute address stays as it is, trimmed; null stays null.
    """
    url = F.trim(url)
    pattern = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:]*)(?::(\d*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
    scheme, host, port, path, query = (F.regexp_extract(url, pattern, i) for i in range(1, 6))
    scheme, host = F.lower(scheme), F.regexp_replace(F.lower(host), r"\.$", "")
    standard = (port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    path = F.when(path == "", "/").otherwise(path)
    ordered = F.array_join(F.array_sort(F.split(query, "&")), "&")
    whole = F.concat(scheme, F.lit("://"), host, F.when(standard, "").otherwise(F.concat(F.lit(":"), port)), path,
                     F.when(query == "", "").otherwise(F.concat(F.lit("?"), ordered)))
    return F.when(url.rlike(pattern), whole).otherwise(url)


def _lower_names(headers: Column) -> Column:
    """Header names in lower case; of names that differ by case only the last counts."""
    names = F.transform(F.map_keys(headers), F.lower)
    last = F.filter(F.arrays_zip(names.alias("k"), F.map_values(headers).alias("v"), F.sequence(F.lit(1), F.size(names)).alias("i")),
                    lambda e: ~F.exists(F.slice(names, e["i"] + 1, F.greatest(F.size(names), F.lit(1))), lambda other: other == e["k"]))
    return F.when(F.size(names) > 0, F.map_from_entries(F.transform(last, lambda e: F.struct(e["k"], e["v"]))))


def merged_headers(stored: Column, fresh: Column) -> Column:
    """The stored fields, replaced or joined by those of the not-modified answer that may change them."""
    none = F.create_map().cast("map<string,string>")
    stored, fresh = F.coalesce(stored, none), F.coalesce(fresh, none)
    allowed = F.map_filter(fresh, lambda name, _: ~name.isin(*NOT_MERGED))
    return F.map_concat(F.map_filter(stored, lambda name, _: ~F.map_contains_key(allowed, name)), allowed)


def _weak(etag: Column) -> Column:
    return F.regexp_replace(F.trim(etag), "^W/", "")


def resolve(records: DataFrame, bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """One row for each revisit of records(record_id, kind, url, at, headers, digest): its state and merged headers.

    kind is response (full) or revisit; at is in seconds; headers a map. state: resolved (the latest strictly earlier response
    has an equal ETag, compared weakly, or if one side has none an equal Last-Modified), unverified (no validator on both
    sides), conflict (validators differ), missing (no earlier response, or no url or time). Of responses at one time the
    largest record_id counts. Headers are merged and the digest taken over only where resolved or unverified. Rows of other
    kinds are ignored; repeated revisits repeat their result; no rows give none; other columns are ignored.
    """
    rows = records.select(
        F.col("record_id").cast("long"), "kind", canonical(F.col("url")).alias("key"), F.col("at").cast("long"), _lower_names(F.col("headers")).alias("headers"),
        F.col("digest").cast("string")).where(F.col("kind").isin("response", "revisit"))
    rows = rows.withColumn("bucket", F.floor(F.col("at") / bucket_seconds))
    timed = F.col("key").isNotNull() & F.col("at").isNotNull()
    found = F.when((F.col("kind") == "response") & timed, F.struct("at", "record_id"))
    fresh = F.when(F.col("kind") == "revisit", F.col("headers"))
    slim = rows.select("record_id", "kind", "key", "at", "bucket", found.alias("found"), fresh.alias("fresh"))
    earlier = Window.partitionBy("key", "bucket").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    near = slim.withColumn("near", F.max("found").over(earlier)).where("kind = 'revisit'")
    last = slim.groupBy("key", "bucket").agg(F.max("found").alias("last"))
    before = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.withColumn("carried", F.last("last", ignorenulls=True).over(before)).where("carried IS NOT NULL").select("key", "bucket", "carried")
    target = F.when(timed, F.coalesce("near", "carried")["record_id"])
    both = near.join(carried, ["key", "bucket"], "left").select("record_id", "key", "at", "fresh", target.alias("target_id"))
    stored = rows.where("kind = 'response'").groupBy(F.col("record_id").alias("target_id")).agg(
        F.max_by("headers", "at").alias("stored"), F.max_by("digest", "at").alias("stored_digest"))
    both = both.join(stored, "target_id", "left")
    tags = F.col("stored")["etag"], F.col("fresh")["etag"]
    dates = F.col("stored")["last-modified"], F.col("fresh")["last-modified"]
    same = F.coalesce(_weak(tags[0]) == _weak(tags[1]), dates[0] == dates[1])
    state = F.when(F.col("target_id").isNull(), "missing").when(same.isNull(), "unverified").when(same, "resolved").otherwise("conflict")
    usable = F.col("state").isin("resolved", "unverified")
    return both.withColumn("state", state).select(
        "record_id", "key", "at", "target_id", "state", F.when(usable, merged_headers(F.col("stored"), F.col("fresh"))).alias("headers"),
        F.when(usable, F.col("stored_digest")).alias("digest"))


def archive_records(pages: DataFrame) -> DataFrame:
    """Records of an archive of the pages: every page as a full response, every third again a day later with another body,
    and each revisited several times at other spellings of its address, some without, some with other validators."""
    first = 1_700_000_000 + F.col("page_id") * 60
    tag = F.md5(F.coalesce(F.col("html"), F.lit("")))
    host = F.regexp_replace(F.col("url"), "^http://([^/:?#]+)", "HTTP://$1:80")

    def record(number: int, kind: str, url: Column, at: Column, headers: dict[str, Column]) -> Column:
        return F.struct((F.col("page_id") * 8 + number).alias("record_id"), F.lit(kind).alias("kind"), url.alias("url"), at.cast("long").alias("at"),
                        F.map_filter(F.create_map(*[x for k, v in headers.items() for x in (F.lit(k), v)]), lambda _, v: v.isNotNull()).alias("headers"),
                        (tag if kind == "response" else F.lit(None).cast("string")).alias("digest"))

    size = F.length("html").cast("string")
    day = F.when(F.col("page_id") % 2 == 0, (first - 86400).cast("string"))
    quoted = F.concat(F.lit('"'), tag, F.lit('"'))
    full = {"ETag": quoted, "Content-Length": size, "Content-Type": F.lit("text/html"), "Cache-Control": F.lit("max-age=60"), "Last-Modified": day}
    again = full | {"ETag": F.concat(F.lit('"2'), tag, F.lit('"'))}
    fresh = {"etag": F.concat(F.lit("W/"), quoted), "Content-Length": F.lit("0"), "cache-control": F.concat(F.lit("max-age="), (F.col("page_id") % 7).cast("string"))}
    records = F.array(
        record(0, "response", F.col("url"), first, full),
        record(1, "revisit", host, first + 3600 * (1 + F.col("page_id") % 40), fresh),
        record(2, "revisit", F.concat(F.regexp_replace("url", "#.*$", ""), F.lit("#again")), first + 7200, {"Last-Modified": day, "Vary": F.lit("Accept")}),
        record(3, "revisit", F.col("url"), first - 3600, fresh),
        F.when(F.col("page_id") % 3 == 0, record(4, "response", F.col("url"), first + 86400, again)))
    return pages.select(F.explode(F.filter(records, lambda r: r.isNotNull())).alias("r")).select("r.*")
