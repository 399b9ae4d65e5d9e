"""URL filters by a temporal list join.

A list is a history of dated entries: from a date on a key is blocked, allowed, or no longer listed. Entries become validity intervals,
and every capture is judged by the entry that was in force when it was fetched. Keys are a host, a domain with all its hosts, or the
beginning of a path; the most specific entry in force decides.

The as-of join is an equality join on the key and a period of ``DAYS`` days, with the interval as a further condition. An interval
stands in each period that it touches. So a capture meets only the entries of its key in its own period, the captures of a frequent
host are spread over periods, and Spark can split what is left of them. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Days of a period.
DAYS = 32
#: Kinds of keys, the most specific first.
KINDS = ("prefix", "host", "domain")

_HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)"
_PATH = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^/?#]*)"


def host_of(url: F.Column) -> F.Column:
    """Lower-case host; null if there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, _HOST, 1)), F.lit(""))


def keys_of(url: F.Column) -> dict[str, F.Column]:
    """The key of each kind that an entry must have to cover the URL."""
    host, path = host_of(url), F.regexp_extract(url, _PATH, 1)
    return {
        "prefix": F.when(path != "", F.concat(host, path)),
        "host": host,
        "domain": F.nullif(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1), F.lit("")),
    }


def validity(entries: DataFrame) -> DataFrame:
    """kind, key, action, valid_from and valid_to (null: still in force) of the entries (kind, key, action, listed_at).

    An entry holds from its date until the next one of its key; an action other than block and allow ends the listing. Of entries of
    one key and date block beats allow and allow beats the rest; repeated entries are one. Entries with a null play no part.
    """
    key = F.when(F.col("kind") == "prefix", F.col("key")).otherwise(F.lower("key"))  # paths tell cases apart
    known = entries.select("kind", key.alias("key"), "action", "listed_at").dropna()
    strength = F.when(F.col("action") == "block", 2).when(F.col("action") == "allow", 1).otherwise(0)
    once = known.groupBy("kind", "key", "listed_at").agg(F.max(F.struct(strength.alias("s"), "action")).alias("top"))
    after = F.lead("listed_at").over(Window.partitionBy("kind", "key").orderBy("listed_at"))
    return once.select(
        "kind", "key", F.col("top.action").alias("action"), F.col("listed_at").alias("valid_from"), after.alias("valid_to")
    ).where(F.col("action").isin("block", "allow"))


def _period(day: F.Column) -> F.Column:
    return F.floor(F.unix_date(day.cast("date")) / DAYS)


def judged(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """Each row of ``captures`` (page_id, url, fetched_at) with kind, key, action and listed_at of the entry that decides, and blocked.

    An entry is in force from its own instant on, that included, until the next of its key. Captures without a URL, host or date and
    those that no entry covers are not blocked, and the four columns are null. Repeated captures come back as often. Other
    columns of both tables play no part. Empty lists block nothing; no captures give no rows.
    """
    rows = captures.select("page_id", "url", "fetched_at")
    # as text, so that no time zone of the driver comes in
    latest = rows.agg(F.max("fetched_at").cast("string")).first()[0]
    last = F.lit(latest).cast(rows.schema["fetched_at"].dataType)
    held = validity(entries)
    if latest is not None:
        ends = F.least(F.coalesce("valid_to", last), last)
        held = held.where(F.col("valid_from") <= last).withColumn(
            "period", F.explode(F.sequence(_period(F.col("valid_from")), F.greatest(_period(ends), _period(F.col("valid_from")))))
        )
    else:
        held = held.withColumn("period", F.lit(0).cast("long")).limit(0)
    rows = rows.withColumn("period", _period(F.col("fetched_at")))
    # a URL without a key meets nothing: the made-up key spreads such rows
    spread = F.concat(F.lit("\0"), F.xxhash64("page_id", "url").cast("string"))
    for kind, key in keys_of(F.col("url")).items():
        own = held.where(F.col("kind") == kind).select(
            F.col("key").alias(f"{kind}_key"),
            F.col("period").alias(f"{kind}_period"),
            F.struct("kind", "key", "action", F.col("valid_from").alias("listed_at")).alias(kind),
            F.col("valid_from").alias(f"{kind}_from"),
            F.col("valid_to").alias(f"{kind}_to"),
        )
        rows = (
            rows.withColumn("of_key", F.coalesce(key, spread))
            .join(
                own,
                (F.col("of_key") == F.col(f"{kind}_key"))
                & (F.col("period") == F.col(f"{kind}_period"))
                & (F.col("fetched_at") >= F.col(f"{kind}_from"))
                & (F.col(f"{kind}_to").isNull() | (F.col("fetched_at") < F.col(f"{kind}_to"))),
                "left",
            )
            .drop("of_key", f"{kind}_key", f"{kind}_period", f"{kind}_from", f"{kind}_to")
        )
    found = rows.withColumn("found", F.coalesce(*KINDS))
    return found.select(
        "page_id",
        "url",
        "fetched_at",
        "found.kind",
        "found.key",
        "found.action",
        "found.listed_at",
        F.coalesce(F.col("found.action") == "block", F.lit(False)).alias("blocked"),
    )
