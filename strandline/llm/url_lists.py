"""Temporal URL lists: dated entries become validity intervals, and every capture is judged by what held when it was fetched.

An entry says that a list takes up or strikes a key (a host or a parent domain) from a moment on.  `intervals` turns
the entries of each (list, key, action) into [from, to) intervals.  `judge` looks up every capture's host and
parent domains among the intervals that hold its fetch time, and lets the longest key decide; at equal length an
allow entry wins over a block entry, then the first list by name, then the earlier interval.

Plan.  Distinct (host, time) pairs are exploded to at most as many keys as the host has labels and joined by key; the
time is a residual condition.  The join is a plain shuffled join: Spark may broadcast it where the measured size of
a side allows, and splits hot keys otherwise, since nothing above the join needs a key's rows together.

Cases.  A null or hostless URL, or a null time, gives verdict `none`.  Rows that repeat are all kept.  Entries with a null key,
time or list are ignored; of entries with equal times, a strike comes last.  No entries: every verdict is `none`.
Other columns of either table pass or are ignored without regard to their names.  Native: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import unused

#: Captures of the query are dated within this year, and lists change within it.
YEAR_START, YEAR = 1_704_067_200, 31_536_000
DAY = 86_400
#: A host is a name, or an address: four numbers, or anything in square brackets.  Addresses have no parents.
HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^/?#\]]*\]|[^/:?#]+)"
ADDRESS = r"^(([0-9]+[.]){3}[0-9]+|\[.*\])$"


def host_of(url: Column) -> Column:
    return F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), HOST, 1)


def keys_of(host: Column) -> Column:
    """The host and its parent domains of two labels or more."""
    labels = F.split(host, r"\.")
    return F.when((F.size(labels) >= 2) & ~host.rlike(ADDRESS), F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).otherwise(F.array(host))


def intervals(entries: DataFrame) -> DataFrame:
    """entries: list, key, action (block or allow), change (add or strike), at (seconds).  Gives list, key, action, from_s, to_s (null: still open)."""
    e = entries.select("list", "key", "action", "change", "at").where("list is not null and key is not null and at is not null")
    w = Window.partitionBy("key", "list", "action").orderBy("at", "change")  # `add` before `strike`
    return e.withColumn("to_s", F.lead("at").over(w)).where("change = 'add' and (to_s is null or to_s > at)").select("list", "key", "action", F.col("at").alias("from_s"), "to_s")


def judge(captures: DataFrame, entries: DataFrame, url: str = "url", at: str = "fetch_s") -> DataFrame:
    """captures with host, n_active, verdict, rule_key, rule_list, rule_from and rule_to."""
    host, when = unused("__host", captures.columns), unused("__at", captures.columns)
    own = captures.withColumns({host: host_of(F.col(url)), when: F.col(at)})
    pairs = own.select(F.col(host).alias("__host"), F.col(when).alias("__at")).where("__host <> '' and __at is not null").distinct()
    asked = pairs.select("__host", "__at", F.explode(keys_of(F.col("__host"))).alias("key"))
    met = asked.join(intervals(entries), "key").where("__at >= from_s and (to_s is null or __at < to_s)")
    rank = F.struct((-F.length("key")).alias("n"), (F.col("action") == "block").alias("b"), "list", "from_s", "key", "action", "to_s")
    best = met.groupBy("__host", "__at").agg(F.count(F.lit(1)).alias("__n"), F.min(rank).alias("__r"))
    best = best.select(F.col("__host").alias("__h"), F.col("__at").alias("__t"), "__n", "__r")
    out = own.join(best, (F.col(host) == F.col("__h")) & (F.col(when) == F.col("__t")), "left")
    return out.select(
        *captures.columns,
        F.col(host).alias("host"),
        F.coalesce("__n", F.lit(0)).cast("long").alias("n_active"),
        F.coalesce("__r.action", F.lit("none")).alias("verdict"),
        F.col("__r.key").alias("rule_key"),
        F.col("__r.list").alias("rule_list"),
        F.col("__r.from_s").alias("rule_from"),
        F.col("__r.to_s").alias("rule_to"),
    )


def number_of(text: Column, first: int) -> Column:
    """24 bits of a text's md5, the same in any engine."""
    return F.conv(F.substring(F.md5(text), first, 6), 16, 10).cast("long")


def dated(pages: DataFrame) -> DataFrame:
    """Captures with a fetch time, which the `pages` table lacks: a moment of the year that follows from the URL."""
    return pages.select("page_id", "url", (YEAR_START + number_of(F.coalesce("url", F.lit("")), 1) % YEAR).alias("fetch_s"))


def feed(captures: DataFrame) -> DataFrame:
    """A feed of dated entries about the captures' own hosts and domains, so that lists grow with the table: a quarter of the hosts is blocked from
    some day, half of those are struck later, and half of these return; a ninth is allowed for a while; each domain is blocked for a month."""
    hosts = captures.select(host_of(F.col("url")).alias("host")).where("host <> ''").distinct()
    a, b, c = number_of(F.col("host"), 1), number_of(F.col("host"), 7), number_of(F.col("host"), 13)
    first, second = YEAR_START + b % 300 * DAY, YEAR_START + b % 300 * DAY + (1 + c % 60) * DAY

    def entry(name: str, action: str, change: str, at: Column, when: Column) -> Column:
        return F.when(when, F.struct(F.lit(name).alias("list"), F.col("host").alias("key"), F.lit(action).alias("action"), F.lit(change).alias("change"), at.alias("at")))

    rows = hosts.select(
        F.explode(
            F.filter(
                F.array(
                    entry("abuse", "block", "add", first, a % 4 == 0),
                    entry("abuse", "block", "strike", second, a % 8 == 0),
                    entry("abuse", "block", "add", second + 30 * DAY, a % 16 == 0),
                    entry("trusted", "allow", "add", YEAR_START + c % 200 * DAY, a % 9 == 1),
                    entry("trusted", "allow", "strike", YEAR_START + (c % 200 + 90) * DAY, a % 9 == 1),
                ),
                lambda x: x.isNotNull(),
            )
        ).alias("e")
    ).select("e.*")
    domains = hosts.select(F.element_at(keys_of(F.col("host")), -1).alias("host")).distinct()
    month = domains.select(
        F.explode(
            F.array(
                entry("outage", "block", "add", YEAR_START + number_of(F.col("host"), 1) % 300 * DAY, F.lit(True)),
                entry("outage", "block", "strike", YEAR_START + (number_of(F.col("host"), 1) % 300 + 30) * DAY, F.lit(True)),
            )
        ).alias("e")
    ).select("e.*")
    return rows.unionByName(month)


ORACLE = f"""
WITH cap AS (
  SELECT page_id, url, {YEAR_START} + ('0x' || substr(md5(coalesce(url, '')), 1, 6))::BIGINT % {YEAR} AS fetch_s,
         regexp_extract(lower(coalesce(url, '')), '{HOST}', 1) AS host
  FROM pages),
hosts AS (
  SELECT host, ('0x' || substr(md5(host), 1, 6))::BIGINT AS a, ('0x' || substr(md5(host), 7, 6))::BIGINT AS b, ('0x' || substr(md5(host), 13, 6))::BIGINT AS c
  FROM (SELECT DISTINCT host FROM cap WHERE host <> '')),
domains AS (
  SELECT host, ('0x' || substr(md5(host), 1, 6))::BIGINT AS a
  FROM (SELECT DISTINCT CASE WHEN regexp_matches(host, '{ADDRESS}') THEN host ELSE array_to_string(string_split(host, '.')[-2:], '.') END AS host FROM hosts)),
entries AS (
  SELECT 'abuse' AS list, host AS key, 'block' AS action, 'add' AS change, {YEAR_START} + b % 300 * {DAY} AS "at" FROM hosts WHERE a % 4 = 0
  UNION ALL SELECT 'abuse', host, 'block', 'strike', {YEAR_START} + b % 300 * {DAY} + (1 + c % 60) * {DAY} FROM hosts WHERE a % 8 = 0
  UNION ALL SELECT 'abuse', host, 'block', 'add', {YEAR_START} + b % 300 * {DAY} + (1 + c % 60) * {DAY} + 30 * {DAY} FROM hosts WHERE a % 16 = 0
  UNION ALL SELECT 'trusted', host, 'allow', 'add', {YEAR_START} + c % 200 * {DAY} FROM hosts WHERE a % 9 = 1
  UNION ALL SELECT 'trusted', host, 'allow', 'strike', {YEAR_START} + (c % 200 + 90) * {DAY} FROM hosts WHERE a % 9 = 1
  UNION ALL SELECT 'outage', host, 'block', 'add', {YEAR_START} + a % 300 * {DAY} FROM domains
  UNION ALL SELECT 'outage', host, 'block', 'strike', {YEAR_START} + (a % 300 + 30) * {DAY} FROM domains),
spans AS (
  SELECT * FROM (SELECT list, key, action, change, "at" AS from_s, lead("at") OVER (PARTITION BY key, list, action ORDER BY "at", change) AS to_s FROM entries)
  WHERE change = 'add' AND (to_s IS NULL OR to_s > from_s)),
asked AS (
  SELECT host, fetch_s, unnest(CASE WHEN len(string_split(host, '.')) >= 2 AND NOT regexp_matches(host, '{ADDRESS}')
    THEN list_transform(range(1, len(string_split(host, '.'))), lambda i: array_to_string(string_split(host, '.')[i:], '.')) ELSE [host] END) AS key
  FROM (SELECT DISTINCT host, fetch_s FROM cap WHERE host <> '')),
met AS (
  SELECT a.host, a.fetch_s, s.*, row_number() OVER (PARTITION BY a.host, a.fetch_s ORDER BY length(s.key) DESC, s.action = 'block', s.list, s.from_s) AS k,
         count(*) OVER (PARTITION BY a.host, a.fetch_s) AS n
  FROM asked a JOIN spans s ON a.key = s.key AND a.fetch_s >= s.from_s AND (s.to_s IS NULL OR a.fetch_s < s.to_s))
SELECT c.page_id, c.url, c.fetch_s, c.host, coalesce(m.n, 0)::BIGINT AS n_active, coalesce(m.action, 'none') AS verdict, m.key AS rule_key,
       m.list AS rule_list, m.from_s AS rule_from, m.to_s AS rule_to
FROM cap c LEFT JOIN met m ON c.host = m.host AND c.fetch_s = m.fetch_s AND m.k = 1
"""


def verdicts(pages: DataFrame) -> DataFrame:
    captures = dated(pages)
    return judge(captures, feed(captures))
