"""URL filters over dated lists, by a temporal join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def host_of(url: Column) -> Column:
    """Lower-cased host of a URL: no scheme, user, port or trailing dots; empty where there is none."""
    authority = F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":[0-9]*$", ""), r"\.+$", ""))


def intervals(changes: DataFrame) -> DataFrame:
    """(list_name, domain, valid_from, valid_to) from dated changes (list_name, domain, action, changed_at).

    A change holds until the next one of the same list and domain; 'add' opens an interval, 'remove' ends it, and an add that follows an
    add opens none anew. Of changes at one moment the removal wins. The last interval has no end (null). Domains lose spaces around
    them and dots at their end, as hosts do. Changes with a null in any column, or without a domain, take no part.
    """
    known = changes.select("list_name", F.lower(F.regexp_replace(F.trim("domain"), r"\.+$", "")).alias("domain"), "action", "changed_at").dropna().where(F.col("action").isin("add", "remove") & (F.col("domain") != ""))
    once = known.groupBy("list_name", "domain", "changed_at").agg(F.max("action").alias("action"))
    inside = Window.partitionBy("list_name", "domain").orderBy("changed_at")
    turns = once.withColumn("was", F.lag("action").over(inside)).where("action = 'add' and coalesce(was, 'remove') = 'remove' or action = 'remove' and was = 'add'")
    return turns.withColumn("valid_to", F.lead("changed_at").over(inside)).where("action = 'add'").select("list_name", "domain", F.col("changed_at").alias("valid_from"), "valid_to")


def temporal_filter(captures: DataFrame, changes: DataFrame, id_col: str, url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """(id, url, fetched_at, host, n_active, blocked, first_list, matched_domain): each capture against the entries active when it was fetched.

    An entry matches its host and all hosts below it. A capture's suffixes are joined by equality, with valid_from <= time < valid_to on the join, and
    the matches are summed per distinct (host, time) first: a host with many captures is evaluated once for each moment, and the join back to
    captures can be split. first_list and matched_domain belong to the match of the longest domain, ties to the first list by name. A null URL, a URL
    without host or a null time is blocked by nothing; repeated captures stay repeated. Everything is DataFrame functions.
    """
    rows = captures.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(time_col).alias("fetched_at"), F.coalesce(host_of(F.col(url_col)), F.lit("")).alias("host"))
    moments = rows.where("host <> '' and fetched_at is not null").select("host", "fetched_at").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    probes = moments.select("host", "fetched_at", F.explode(suffixes).alias("domain"))
    active = intervals(changes)
    hit = (probes["domain"] == active["domain"]) & (probes["fetched_at"] >= active["valid_from"]) & (active["valid_to"].isNull() | (probes["fetched_at"] < active["valid_to"]))
    best = F.struct((-F.length(active["domain"])).alias("order"), active["list_name"].alias("list_name"), active["domain"].alias("domain"))
    verdicts = probes.join(active, hit).groupBy("host", "fetched_at").agg(F.count("*").alias("n_active"), F.min(best).alias("best"))
    return rows.join(verdicts, ["host", "fetched_at"], "left").select(
        "id",
        "url",
        "fetched_at",
        "host",
        F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"),
        F.col("n_active").isNotNull().alias("blocked"),
        F.col("best.list_name").alias("first_list"),
        F.col("best.domain").alias("matched_domain"),
    )
