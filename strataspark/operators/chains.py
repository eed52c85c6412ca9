"""Resource chains: files of different roles about one thing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataspark.functions import names


def named(files: DataFrame, chains: bool = True) -> DataFrame:
    """(resource, role, file, language) of files that have a resource and a role."""
    rows = files.select(names.resource_name("path", chains).alias("resource"), names.role("path", chains).alias("role"), F.col("path").alias("file"), "language")
    return rows.where("resource is not null and role <> 'other'")


def chain_links(files: DataFrame, chains: bool = True) -> DataFrame:
    """(resource, role, role_ord, file, language): the least file of each role, of resources with two roles or more."""
    rows = named(files, chains).groupBy("resource", "role").agg(F.min(F.struct("file", "language")).alias("f"))
    many = rows.groupBy("resource").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("resource")
    return rows.join(many, "resource", "left_semi").select("resource", "role", names.role_order("role").alias("role_ord"), "f.file", "f.language")


def chains(links: DataFrame) -> DataFrame:
    """(resource, files, roles, languages, links, is_cross_stack): one row a chain, its links in the order of roles."""
    ordered = F.array_sort(F.collect_list(F.struct("role_ord", "role", "file", "language")))
    out = links.groupBy("resource").agg(ordered.alias("l"), F.array_sort(F.collect_set("language")).alias("languages"))
    return out.select("resource", F.col("l.file").alias("files"), F.col("l.role").alias("roles"), "languages", F.size("l").alias("links"), (F.size("languages") > 1).alias("is_cross_stack"))


def cross_pairs(files: DataFrame) -> DataFrame:
    """(resource, file_a, file_b): files about one thing in different languages."""
    rows = files.select(names.resource_name("path", False).alias("resource"), F.col("path").alias("file"), "language").where("resource is not null")
    a, b = rows.select("resource", F.col("file").alias("file_a"), F.col("language").alias("la")), rows.select("resource", F.col("file").alias("file_b"), F.col("language").alias("lb"))
    return a.join(b, "resource").where("file_a < file_b and la <> lb").select("resource", "file_a", "file_b")


def consecutive(links: DataFrame) -> DataFrame:
    """(resource, file_a, file_b): neighbours in each chain."""
    from pyspark.sql import Window

    w = Window.partitionBy("resource").orderBy("role_ord")
    return links.select("resource", F.col("file").alias("file_a"), F.lead("file").over(w).alias("file_b")).where("file_b is not null")
