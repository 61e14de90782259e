"""URL filters: dated list entries become validity intervals, and each capture is held against those of its fetch time.

An entry names a host ("spam.example.com", which also covers hosts below it) or a host and leading path segments
("example.com/ads"), and says from when on it is listed or no longer listed. Between two changes an entry is valid; of the
valid entries that cover a capture, the longest decides. Upper and lower case are not told apart, in hosts and in paths.

Cases: of changes of one entry at one time, "remove" wins, and of equal actions the last category by name; entries with a null in
pattern, time or action are left out; a capture with a null or unreadable url or a null time is not listed; equal captures stay
as many rows; an entry that is never removed stays valid; a url of any number of segments is looked up by as many as entries have;
empty tables give no listings; columns listed, pattern, category and since are replaced, other columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from banditframe.llm.common import cut


def _host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_replace(F.lower(url), r"^\s*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?", "")
    path = F.filter(F.split(F.regexp_extract(rest, r"^[^/?#]*/([^?#]*)", 1), "/"), lambda s: s != "")
    return F.regexp_extract(rest, r"^([^/?#:\s]*)", 1), path


def patterns(url: Column, labels: int, segments: int) -> Column:
    """What entries of at most so many host labels and path segments could cover a url: its host and the hosts above it, each
    alone and with the leading path segments."""
    host, path = _host_and_path(url)
    parts = F.split(host, r"\.")
    n = F.size(parts)
    hosts = F.transform(F.sequence(F.greatest(n - (labels - 1), F.lit(1)), F.greatest(n - 1, n - (labels - 1), F.lit(1))), lambda k: F.array_join(F.slice(parts, k, n), "."))
    heads = F.transform(F.sequence(F.lit(0), F.least(F.size(path), F.lit(segments))), lambda k: F.array_join(F.transform(F.slice(path, 1, k), lambda s: F.concat(F.lit("/"), s)), ""))
    both = F.flatten(F.transform(hosts, lambda h: F.transform(heads, lambda p: F.concat(h, p))))
    return F.when(host != "", F.array_distinct(both)).otherwise(F.array().cast("array<string>"))


def changes(entries: DataFrame) -> DataFrame:
    """entries (pattern, category, action 'add' or 'remove', at) -> one change for each pattern and time, with its month."""
    one = entries.filter("pattern is not null and at is not null and action is not null").withColumn("pattern", F.lower("pattern"))
    one = one.groupBy("pattern", "at").agg(F.max_by("category", F.struct("action", "category")).alias("category"), F.max("action").alias("action"))
    return one.withColumn("month", F.date_trunc("month", "at"))


def intervals(entries: DataFrame, asked: DataFrame) -> DataFrame:
    """(pattern, month, category, since, until) for the patterns and months of asked, until null if open in that month.

    What is valid in a month is either added in it or was added by the last change of an earlier month. That is looked up among
    the months of a pattern, the next change among those of one month, so no task sorts all changes of an entry that has very
    many, and no interval is spread over months that nobody asks for.
    """
    one = cut(changes(entries))
    inside = one.withColumn("next", F.lead("at").over(Window.partitionBy("pattern", "month").orderBy("at")))
    ends = one.groupBy("pattern", "month").agg(F.max(F.struct("at", "action", "category")).alias("last"), F.min("at").alias("first"))
    months = asked.select("pattern", "month").distinct().withColumn("asked", F.lit(True)).join(ends, ["pattern", "month"], "full")
    before = F.last("last", ignorenulls=True).over(Window.partitionBy("pattern").orderBy("month").rowsBetween(Window.unboundedPreceding, -1))
    carried = months.withColumn("c", before).filter("asked and c.action = 'add'")
    carried = carried.select("pattern", "month", "c.category", F.col("c.at").alias("since"), F.col("first").alias("until"))
    return carried.unionByName(inside.filter("action = 'add'").select("pattern", "month", "category", F.col("at").alias("since"), F.col("next").alias("until")))


def listed(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched") -> DataFrame:
    """captures with listed, pattern, category and since of the entry that decides.

    Captures and intervals meet by pattern and month, so a capture is compared with the changes of one month at most.
    """
    captures = captures.drop("listed", "pattern", "category", "since")
    base = captures.withColumn("__key", F.xxhash64(id_col, url_col, time_col))
    host, path = F.split_part(F.col("pattern"), F.lit("/"), F.lit(1)), F.regexp_count("pattern", F.lit("/"))
    labels, segments = entries.agg(F.max(F.size(F.split(host, r"\."))), F.max(path)).first()
    asked = base.filter(F.col(time_col).isNotNull() & F.col(url_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(url_col).alias("__url"), F.col(time_col).alias("__time"), "__key").distinct()
    asked = asked.withColumn("pattern", F.explode(patterns(F.col("__url"), labels or 1, segments or 0)))
    named = cut(entries.select(F.lower("pattern").alias("pattern")).distinct())
    asked = cut(asked.join(named, "pattern", "left_semi").withColumn("month", F.date_trunc("month", "__time")))
    met = asked.join(cut(intervals(entries, asked)), ["pattern", "month"]).filter((F.col("since") <= F.col("__time")) & (F.col("until").isNull() | (F.col("__time") < F.col("until"))))
    best = F.max_by(F.struct("pattern", "category", "since"), F.struct(F.length("pattern"), "pattern"))
    found = cut(met.groupBy("__key", "__id", "__url", "__time").agg(best.alias("__e")).withColumnRenamed("__key", "__k"))
    same = (base["__key"] == found["__k"]) & base[id_col].eqNullSafe(found["__id"]) & (base[url_col] == found["__url"]) & (base[time_col] == found["__time"])
    return base.join(found, same, "left").select(*captures.columns, F.col("__e").isNotNull().alias("listed"), "__e.pattern", "__e.category", "__e.since")
