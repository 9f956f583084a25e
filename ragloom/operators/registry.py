"""Users and their folders as tables.

A registry is two tables: users (username, collection) and folders (username, folder, pos).  A folder is a row,
so a user's folders are no value of any row and no group is gathered; ``pos`` (then the name) gives their order,
and a folder that is added stands behind the user's greatest ``pos``.  Requests are batches (DataFrames), not calls.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import collection_name


@dataclass(frozen=True)
class Registry:
    users: DataFrame        # username, collection
    folders: DataFrame      # username, folder, pos


def users_from_documents(documents: DataFrame, order_col: str = "doc_id") -> Registry:
    """One user per ``lang``, whose folders are the distinct ``source`` values in order of arrival (the least
    ``order_col``, where the documents have it; a null source is no folder)."""
    names = documents.select(F.col("lang").alias("username"), F.col("source").alias("folder"),
                             (F.col(order_col) if order_col in documents.columns else F.lit(0)).cast("bigint").alias("pos"))
    users = names.select("username").distinct().withColumn("collection", collection_name(F.col("username")))
    return Registry(users, names.where("folder IS NOT NULL").groupBy("username", "folder").agg(F.min("pos").alias("pos")))


def _asked(registry: Registry, requests: DataFrame) -> DataFrame:
    """Requested usernames with ``found`` and ``folder_count``."""
    counts = registry.folders.groupBy("username").agg(F.count(F.lit(1)).alias("_n"))
    known = registry.users.select("username", F.lit(True).alias("_known"))
    return (requests.select("username").distinct().join(known, "username", "left").join(counts, "username", "left")
            .select("username", F.coalesce("_known", F.lit(False)).alias("found"),
                    F.coalesce("_n", F.lit(0)).cast("bigint").alias("folder_count")))


def lookup(registry: Registry, requests: DataFrame) -> DataFrame:
    """Per requested username, whether the user exists and the folder count."""
    return _asked(registry, requests)


def user_folders(registry: Registry, requests: DataFrame) -> DataFrame:
    """The user's folders as rows with their ``pos``; a user without any, or unknown, has one row, folder NULL."""
    return requests.select("username").distinct().join(registry.folders, "username", "left").select("username", "folder", "pos")


def add_folders(registry: Registry, requests: DataFrame, order_col: str = "seq") -> DataFrame:
    """K12 statuses for a batch of (username, folder) requests: ``unknown_user``, ``exists`` (already a folder) or
    ``added``.  With ``order_col`` (the requests' order of arrival) its least value of each pair comes along."""
    order = [F.min(order_col).alias(order_col)] if order_col in requests.columns else []
    pairs = requests.groupBy("username", "folder").agg(F.lit(0).alias("_"), *order).drop("_")
    known = registry.users.select("username", F.lit(True).alias("_known"))
    have = registry.folders.select("username", "folder", F.lit(True).alias("_have"))
    r = pairs.join(known, "username", "left").join(have, ["username", "folder"], "left")
    status = (F.when(F.col("_known").isNull(), F.lit("unknown_user"))
              .when(F.col("_have"), F.lit("exists")).otherwise(F.lit("added")))
    return r.select("username", "folder", status.alias("status"), *([order_col] if order else []))


def apply_folder_adds(registry: Registry, statuses: DataFrame, order_col: str = "seq") -> Registry:
    """The registry after the adds: new folders behind the user's known ones, in order of arrival."""
    last = registry.folders.groupBy("username").agg(F.max("pos").alias("_last"))
    arrived = F.col(order_col).cast("bigint") if order_col in statuses.columns else F.lit(0)
    added = statuses.where("status = 'added' AND folder IS NOT NULL")
    # numbers start at the batch's least, so they stay small however requests are numbered
    least = added.groupBy("username").agg(F.min(arrived).alias("_least"))
    new = added.join(last, "username", "left").join(least, "username").select(
        "username", "folder", (F.coalesce("_last", F.lit(0)) + 1 + arrived - F.col("_least")).cast("bigint").alias("pos"))
    return Registry(registry.users, registry.folders.unionByName(new))


def apply_folder_clears(registry: Registry, requests: DataFrame) -> Registry:
    """The registry after the clears: the requested users have no folders, the others are unchanged."""
    return Registry(registry.users, registry.folders.join(requests.select("username").distinct(), "username", "left_anti"))


def clear_folders(registry: Registry, requests: DataFrame) -> DataFrame:
    """Folder count before clearing; status True only when something
    was cleared (an already empty list is not modified)."""
    return _asked(registry, requests).select("username", "folder_count", (F.col("folder_count") > 0).alias("status"))


def clear_all(registry: Registry, chunk_result: DataFrame, requests: DataFrame) -> DataFrame:
    """Both the chunk clear (K8 rows keyed by collection) and the folder
    clear must succeed."""
    f = clear_folders(registry, requests).withColumn("collection", collection_name(F.col("username")))
    j = f.join(chunk_result.select("collection", F.col("status").alias("_docs")), "collection", "left")
    return j.select("username", (F.coalesce("_docs", F.lit(False)) & F.col("status")).alias("status"))
