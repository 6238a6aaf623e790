"""URL filters by a temporal list join.

A list is a table of dated entries: on some day a domain was added to it or taken off. Entries become validity intervals,
from their own date to that of the next entry of the same domain and category. A capture is evaluated against what was
active when it was fetched: its host and every parent domain are looked up, and of all intervals that hold the fetch time
the one of the longest domain decides (ties: the smaller category).

The as-of join is an equality join on the domain with one row per domain, whose intervals are an array in the order of
time; so a capture meets each domain once, however long that domain's history is, and a host with a third of all captures
is a skewed join that Spark can split. Captures equal in id, URL and time are counted first, so copies are joined once.

Edge cases: a null URL, or one without a host, or a null time, is allowed, since no entry can hold for it; entries with a
null domain or date are ignored; of two entries of one domain, category and date the later action by name ("remove") holds;
ports, user names and a final dot are not part of the host, and case does not matter; repeated captures are all returned;
a URL
of any length is one row; a page without an id is fetched at no time; empty tables give no rows, or no entry; columns of the
input other than those named are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.native import quoted

#: A host has at most 127 labels; none of them is left out.
FOREVER = "9999-12-31"
#: Seconds of 2024.
_YEAR = 366 * 86400


def host_of(url: Column) -> Column:
    """The host in lower case, or '' if there is none."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    return F.regexp_replace(F.lower(found), r"\.+$", "")


def domains_of(host: Column) -> Column:
    """The host and all its parent domains, longest first."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def intervals(entries: DataFrame) -> DataFrame:
    """(domain, category, valid_from, valid_to) from entries (domain, category, action add/remove, day)."""
    known = entries.where(F.col("domain").isNotNull() & F.col("day").isNotNull()).groupBy(F.lower("domain").alias("domain"), "category", "day").agg(F.max("action").alias("action"))
    until = F.lead("day").over(Window.partitionBy("domain", "category").orderBy("day"))
    ranged = known.withColumn("valid_to", F.coalesce(until, F.lit(FOREVER).cast("date")))
    return ranged.where("action = 'add'").select("domain", "category", F.col("day").alias("valid_from"), "valid_to")


def evaluate(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """id, url, fetched_at, host, blocked and the deciding entry (null if none) for every capture."""
    history = intervals(entries).groupBy("domain").agg(F.sort_array(F.collect_list(F.struct("valid_from", "valid_to", "category"))).alias("history"))
    once = captures.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(url_col)).alias("url"), F.col(quoted(time_col)).alias("fetched_at")).groupBy("id", "url", "fetched_at").agg(F.count("*").alias("copies"))
    once = once.withColumn("host", host_of(F.col("url")))
    asked = once.select("*", F.explode(domains_of(F.col("host"))).alias("domain"))
    day = F.col("fetched_at").cast("date")
    active = F.filter("history", lambda h: (h["valid_from"] <= day) & (day < h["valid_to"]))
    best = F.array_min(F.transform(active, lambda h: F.struct(h["category"].alias("category"), h["valid_from"].alias("valid_from"), h["valid_to"].alias("valid_to"))))
    joined = asked.join(history, "domain", "left").withColumn("best", best)
    joined = joined.withColumn("rank", F.when(F.col("best").isNotNull(), F.struct(F.length("domain").alias("n"), F.col("domain").alias("domain"))))
    decided = joined.groupBy("id", "url", "fetched_at", "copies", "host").agg(F.max_by(F.struct("domain", "best"), "rank").alias("entry"))
    rows = decided.select(
        "id",
        "url",
        "fetched_at",
        "host",
        F.col("entry").isNotNull().alias("blocked"),
        F.col("entry.domain").alias("entry_domain"),
        F.col("entry.best.category").alias("category"),
        F.col("entry.best.valid_from").alias("valid_from"),
        F.col("entry.best.valid_to").alias("valid_to"),
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
    )
    return rows.drop("copy")


def with_fetch_times(pages: DataFrame) -> DataFrame:
    """The tables have no fetch time: one in 2024 is derived from the page's id."""
    second = F.pmod(F.pmod(F.col("page_id").cast("long"), F.lit(_YEAR)) * 7919, F.lit(_YEAR))
    return pages.withColumn("fetched_at", F.timestamp_seconds(F.lit(1_704_067_200) + second).cast("timestamp_ntz"))


def entries_of(pages: DataFrame) -> DataFrame:
    """The tables have no list either: about a quarter of the hosts and of their parents are listed by a hash of their name.

    Each is added on a day of 2024, most are removed 90 days later, and some of these are added again after 60 more.
    """
    names = pages.select(host_of(F.col("url")).alias("host")).where("host <> ''").distinct().select(F.explode(domains_of(F.col("host"))).alias("domain")).distinct()
    h = lambda i: F.conv(F.substring(F.md5(F.col("domain").cast("binary")), i, 2), 16, 10).cast("int")
    listed = names.where((h(1) < 64) & (F.length("domain") > 3)).select("domain", h(3).alias("d"), h(5).alias("k"), F.element_at(F.array(*map(F.lit, ("malware", "phishing", "spam", "adult"))), F.pmod(h(7), F.lit(4)) + 1).alias("category"))
    start = F.date_add(F.lit("2024-01-01").cast("date"), F.col("d"))
    steps = F.array(
        F.struct(F.lit("add").alias("action"), start.alias("day"), F.lit(0).alias("least")),
        F.struct(F.lit("remove").alias("action"), F.date_add(start, 90).alias("day"), F.lit(64).alias("least")),
        F.struct(F.lit("add").alias("action"), F.date_add(start, 150).alias("day"), F.lit(192).alias("least")),
    )
    return listed.select("domain", "category", "k", F.inline(steps)).where("k >= least").select("domain", "category", "action", "day")


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    rows = evaluate(with_fetch_times(pages), entries_of(pages)).withColumnRenamed("id", "page_id")
    return rows.withColumns({c: F.col(c).cast("string") for c in ("valid_from", "valid_to")})


OP7_SQL = r"""
WITH captures AS (
  SELECT row_number() OVER () AS row_id, page_id, url,
         TIMESTAMP '2024-01-01' + to_seconds((((page_id % 31622400) + 31622400) % 31622400 * 7919) % 31622400) AS fetched_at,
         regexp_replace(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '\.+$', '') AS host
  FROM pages
), hosts AS (
  SELECT DISTINCT host, string_split(host, '.') AS labels FROM captures
), parents AS (
  SELECT host, array_to_string(labels[i :], '.') AS domain FROM hosts, LATERAL (SELECT unnest(range(1, len(labels) + 1)) AS i)
), names AS (
  SELECT DISTINCT domain, md5(domain) AS h FROM parents WHERE host <> ''
), listed AS (
  SELECT domain, DATE '2024-01-01' + CAST(('0x' || h[3:4]) AS INTEGER) AS start, CAST(('0x' || h[5:6]) AS INTEGER) AS k,
         ['malware', 'phishing', 'spam', 'adult'][CAST(('0x' || h[7:8]) AS INTEGER) % 4 + 1] AS category
  FROM names WHERE CAST(('0x' || h[1:2]) AS INTEGER) < 64 AND length(domain) > 3
), entries AS (
  SELECT domain, category, 'add' AS action, start AS day FROM listed
  UNION ALL SELECT domain, category, 'remove', start + 90 FROM listed WHERE k >= 64
  UNION ALL SELECT domain, category, 'add', start + 150 FROM listed WHERE k >= 192
), spans AS (
  SELECT domain, category, action, day AS valid_from,
         coalesce(lead(day) OVER (PARTITION BY domain, category ORDER BY day), DATE '9999-12-31') AS valid_to
  FROM entries
), active AS (
  SELECT c.row_id, s.domain, s.category, s.valid_from, s.valid_to,
         row_number() OVER (PARTITION BY c.row_id ORDER BY length(s.domain) DESC, s.category, s.valid_from, s.valid_to) AS r
  FROM captures c JOIN parents p ON p.host = c.host
  JOIN spans s ON s.domain = p.domain AND s.action = 'add' AND s.valid_from <= CAST(c.fetched_at AS DATE) AND CAST(c.fetched_at AS DATE) < s.valid_to
)
SELECT c.page_id, c.url, c.fetched_at, c.host, a.domain IS NOT NULL AS blocked, a.domain AS entry_domain, a.category, CAST(a.valid_from AS VARCHAR) AS valid_from, CAST(a.valid_to AS VARCHAR) AS valid_to
FROM captures c LEFT JOIN active a ON a.row_id = c.row_id AND a.r = 1
"""
