"""URL filters by a temporal join with dated list entries.

List entries are dated events: from ``at`` on, a pattern is on a list or off it.  They become
validity intervals, and every capture is judged by the entries that were active when it was
fetched.  A pattern without a slash is a host and its subdomains; one with a slash is a host
and a path prefix that ends at a segment.  A capture is looked up under all patterns that can
match it, by plain equality on pattern and month, so the as-of join is an equi join: the
months split a hot host over tasks, adaptive execution splits what is still large, and an
interval costs a row per month that holds captures at most.

Of the active matches the longest pattern decides, and of equal patterns an allow list wins,
then the list whose name is last.

Defined results: null, relative or malformed URLs match nothing; captures without a time are
judged by no entry.  Entries with a null list, pattern, time or action are ignored; at one
time "add" wins over "remove"; adding what is on the list or removing what is not changes
nothing.  Repeated captures (same id, URL and time) give one row.  Empty tables give an
empty result or captures without matches.  Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..missing import quoted
from .common import corpus_table

PERIOD = 30 * 86_400  # seconds


def url_host(url: Column) -> Column:
    """Lower-case host without user, port and final dot; empty if the URL has none."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.rtrim(host, F.lit("."))


def path_segments(url: Column) -> Column:
    """Non-empty segments of the path, without query and fragment."""
    path = F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1)
    return F.filter(F.split(path, "/"), lambda s: s != "")


def _patterns(host: Column, segments: Column, labels: int, depth: int) -> Column:
    """Patterns that can match: the last 1 to ``labels`` labels of the host, and the host with
    the first 1 to ``depth`` segments."""
    parts = F.split(host, r"\.")
    most = F.least(F.size(parts), F.lit(labels))
    hosts = F.when(
        most > 0, F.transform(F.sequence(F.lit(1), most), lambda n: F.array_join(F.slice(parts, -n, n), "."))
    )
    deep = F.least(F.size(segments), F.lit(depth))
    paths = F.when(
        deep > 0,
        F.transform(
            F.sequence(F.lit(1), deep), lambda n: F.concat(host, F.lit("/"), F.array_join(F.slice(segments, 1, n), "/"))
        ),
    )
    none = F.array().cast("array<string>")
    return F.when(host != "", F.concat(F.coalesce(hosts, none), F.coalesce(paths, none))).otherwise(none)


def list_intervals(entries: DataFrame) -> DataFrame:
    """``list_name, pattern, since, until`` (until is exclusive, null if open) from entries
    ``list_name, pattern, action, at`` with action ``add`` or ``remove``.

    The intervals of one list and pattern do not overlap.
    """
    known = entries.where("list_name IS NOT NULL AND pattern IS NOT NULL AND at IS NOT NULL AND action IN ('add', 'remove')")
    dated = known.groupBy("list_name", "pattern", "at").agg(F.max(F.col("action") == "add").alias("on"))
    history = Window.partitionBy("list_name", "pattern").orderBy("at")
    turns = dated.withColumn("was", F.coalesce(F.lag("on").over(history), F.lit(False))).where("`on` <> was")
    spans = turns.select("list_name", "pattern", F.col("at").alias("since"), "on", F.lead("at").over(history).alias("until"))
    return spans.where("`on`").drop("on")


def _period(time: Column) -> Column:
    return F.floor(F.unix_seconds(time.cast("timestamp")) / PERIOD)


def judge_captures(
    captures: DataFrame,
    entries: DataFrame,
    allow_lists: tuple[str, ...] = (),
    id_col: str = "page_id",
    url_col: str = "url",
    time_col: str = "fetched_at",
) -> DataFrame:
    """``id_col, url_col, time_col, host, n_lists, list_name, pattern, blocked`` per capture;
    ``n_lists`` lists hold an active match;
    ``list_name`` and ``pattern`` are those that decide, null without a match.

    Four numbers are read from the data first: how many labels and segments the patterns
    have, and the first and the last month with captures.
    """
    spans = list_intervals(entries)
    asked = captures.select(
        quoted(id_col).alias("id"), quoted(url_col).cast("string").alias("url"), quoted(time_col).alias("time")
    )
    prefix = F.split("pattern", "/")
    size = entries.agg(
        F.max(F.size(F.split(prefix[0], r"\."))).alias("labels"), F.max(F.size(prefix) - 1).alias("depth")
    ).first()
    begin, last = asked.agg(F.min(_period(F.col("time"))), F.max(_period(F.col("time")))).first()

    placed = asked.withColumn("host", url_host(F.coalesce("url", F.lit(""))))
    found = spans.withColumn("first", F.greatest(_period(F.col("since")), F.lit(begin))).withColumn(
        "final", F.least(F.coalesce(_period(F.col("until")), F.lit(last)), F.lit(last))
    )
    monthly = found.where("first <= final").select(
        "list_name", "pattern", "since", "until", F.explode(F.sequence("first", "final")).alias("period")
    )
    keys = _patterns(
        F.col("host"), path_segments(F.coalesce("url", F.lit(""))), size["labels"] or 0, size["depth"] or 0
    )
    lookups = placed.where("time IS NOT NULL").select(
        "id", "url", "time", F.explode(F.array_distinct(keys)).alias("pattern"), _period(F.col("time")).alias("period")
    )
    active = (F.col("time") >= F.col("since")) & (F.col("until").isNull() | (F.col("time") < F.col("until")))
    best = F.struct(
        F.length("pattern").alias("specific"),
        F.col("list_name").isin(list(allow_lists)).alias("allowed"),
        "list_name",
        "pattern",
    )
    matched = lookups.join(monthly, ["pattern", "period"]).where(active).select(
        "id", "url", "time", F.lit(None).cast("string").alias("host"), F.lit(1).alias("one"), best.alias("best")
    )
    # Captures and matches are folded together, so captures without a match need no outer join.
    none = placed.select(
        "id", "url", "time", "host", F.lit(0).alias("one"), F.lit(None).cast(matched.schema["best"].dataType).alias("best")
    )
    folded = none.unionByName(matched).groupBy("id", "url", "time").agg(
        # Repeated captures meet every entry once each.
        F.max("host").alias("host"), F.max("best").alias("best"), F.collect_set("best.list_name").alias("lists"),
    )
    return folded.select(
        F.col("id").alias(id_col),
        F.col("url").alias(url_col),
        F.col("time").alias(time_col),
        "host",
        F.size("lists").cast("bigint").alias("n_lists"),
        F.col("best.list_name").alias("list_name"),
        F.col("best.pattern").alias("pattern"),
        (F.col("best").isNotNull() & ~F.coalesce("best.allowed", F.lit(False))).alias("blocked"),
    )


# The query dates captures and entries by fixed rules, as the tables hold no times: a page is
# fetched at a second of 2024 that follows from its id, and hosts and path prefixes that occur
# in the pages enter and leave three lists on days that follow from their MD5.
EPOCH = 1_704_067_200
YEAR = 366 * 86_400
DAY = 86_400


def _number(pattern: Column) -> Column:
    return F.conv(F.substring(F.md5(pattern.cast("binary")), 1, 8), 16, 10).cast("bigint")


def _events(patterns: DataFrame, list_name: str, chosen: str, days: list[tuple[str, str, str]]) -> DataFrame:
    """Entries of the patterns that ``chosen`` (SQL over n) takes: (action, day, condition)."""
    numbered = patterns.distinct().withColumn("n", _number(F.col("pattern"))).where(chosen)
    events = F.array(
        *[
            F.when(F.expr(when), F.struct(F.lit(action).alias("action"), F.expr(day).alias("day")))
            for action, day, when in days
        ]
    )
    return (
        numbered.select("pattern", F.explode(events).alias("e"))
        .where("e IS NOT NULL")
        .select(
            F.lit(list_name).alias("list_name"),
            "pattern",
            "e.action",
            F.timestamp_seconds(F.lit(EPOCH) + F.col("e.day") * DAY).alias("at"),
        )
    )


LISTS = {
    "malware": ("host", "n % 3 = 0", [("add", "n % 200", "true"), ("remove", "n % 200 + 60", "n % 2 = 0"), ("add", "n % 200 + 120", "n % 4 = 0")]),
    "adult": ("one", "n % 5 = 0", [("add", "n % 300", "true"), ("remove", "n % 300 + 30 + n % 50", "n % 2 = 1")]),
    "allow": ("two", "n % 7 = 0", [("add", "n % 100", "true")]),
}


def derived_lists(pages: DataFrame) -> DataFrame:
    """Dated entries for the hosts and path prefixes that occur in the pages."""
    host, segments = url_host(F.col("url")), path_segments(F.col("url"))
    found = pages.select(
        host.alias("host"),
        *[
            F.when(F.size(segments) >= n, F.concat(host, F.lit("/"), F.array_join(F.slice(segments, 1, n), "/"))).alias(name)
            for n, name in ((1, "one"), (2, "two"))
        ],
    ).where("host <> ''")
    out = None
    for name, (column, chosen, days) in LISTS.items():
        patterns = found.select(F.col(column).alias("pattern")).where("pattern IS NOT NULL")
        events = _events(patterns, name, chosen, days)
        out = events if out is None else out.unionByName(events)
    return out


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = corpus_table(spark, sf_dir, "pages").select("page_id", "url")
    fetched = F.timestamp_seconds(F.lit(EPOCH) + F.pmod(F.col("page_id") * 7919, F.lit(YEAR)))
    found = judge_captures(pages.withColumn("fetched_at", fetched), derived_lists(pages), ("allow",))
    return found.drop("fetched_at", "url")


def _sql_events() -> str:
    parts = []
    for name, (column, chosen, days) in LISTS.items():
        for action, day, when in days:
            parts.append(
                f"SELECT '{name}' AS list_name, pattern, '{action}' AS action, {EPOCH} + ({day}) * {DAY} AS dated_at "
                f"FROM {column}_patterns WHERE {chosen} AND {when}"
            )
    return "\nUNION ALL ".join(parts)


_N = "('0x' || substr(md5(pattern), 1, 8))::BIGINT AS n"
OP9_SQL = f"""
WITH pages_at AS (
  SELECT DISTINCT page_id, url, {EPOCH} + (page_id * 7919) % {YEAR} AS fetched,
         rtrim(regexp_extract(lower(url), '^[a-z][a-z0-9+.\\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1), '.') AS host,
         list_filter(string_split(regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS segs
  FROM pages),
hosted AS (SELECT * FROM pages_at WHERE host <> ''),
host_patterns AS (SELECT *, {_N} FROM (SELECT DISTINCT host AS pattern FROM hosted)),
one_patterns AS (SELECT *, {_N} FROM (SELECT DISTINCT host || '/' || segs[1] AS pattern FROM hosted WHERE len(segs) >= 1)),
two_patterns AS (SELECT *, {_N} FROM
  (SELECT DISTINCT host || '/' || segs[1] || '/' || segs[2] AS pattern FROM hosted WHERE len(segs) >= 2)),
entries AS ({_sql_events()}),
dated AS (SELECT list_name, pattern, dated_at, bool_or(action = 'add') AS is_on FROM entries GROUP BY ALL),
turns AS (SELECT *, coalesce(lag(is_on) OVER (PARTITION BY list_name, pattern ORDER BY dated_at), false) AS was FROM dated),
spans AS (SELECT * FROM (SELECT list_name, pattern, dated_at AS since, is_on,
            lead(dated_at) OVER (PARTITION BY list_name, pattern ORDER BY dated_at) AS until FROM turns WHERE is_on <> was) WHERE is_on),
lookups AS (
  SELECT page_id, url, fetched, unnest(list_concat(
    list_transform(range(1, len(string_split(host, '.')) + 1), lambda n: array_to_string(list_slice(string_split(host, '.'), -n, -1), '.')),
    list_transform(range(1, len(segs) + 1), lambda n: host || '/' || array_to_string(list_slice(segs, 1, n), '/')))) AS pattern FROM hosted),
matches AS (
  SELECT l.page_id, l.url, s.list_name, s.pattern, row_number() OVER (PARTITION BY l.page_id, l.url
           ORDER BY length(s.pattern) DESC, s.list_name = 'allow' DESC, s.list_name DESC) AS place
  FROM lookups l JOIN spans s ON l.pattern = s.pattern AND l.fetched >= s.since AND (s.until IS NULL OR l.fetched < s.until)),
counted AS (SELECT page_id, url, count(DISTINCT list_name) AS n_lists FROM matches GROUP BY ALL)
SELECT p.page_id, p.host, coalesce(c.n_lists, 0) AS n_lists, m.list_name, m.pattern,
       coalesce(m.list_name <> 'allow', false) AS blocked
FROM pages_at p LEFT JOIN (SELECT * FROM matches WHERE place = 1) m ON p.page_id = m.page_id AND p.url = m.url
LEFT JOIN counted c ON p.page_id = c.page_id AND p.url = c.url
"""

QUERIES = {"op9_url_filter": op9_url_filter}
ORACLE = {"op9_url_filter": OP9_SQL}
