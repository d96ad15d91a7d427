"""Relationships and the part catalogue: S4-S8, S10, S12-S14."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Relationship types whose parts hold text, in the order in which sections are joined.
SECTIONS = ("header", "officeDocument", "footer", "footnotes", "endnotes")


def relationships(rels: DataFrame) -> DataFrame:
    """doc_id, rels_path, rel_id, type_uri, target, mode of the nodes of .rels members (doc_id, path): every Relationship, and one row (rel_id 'none') for the .rels member itself, whose type is its root's namespace."""
    rels = rels.withColumnRenamed("path", "rels_path")
    row = rels.filter("level = 1").select("doc_id", "rels_path", F.col("attrs")["Id"].alias("rel_id"), F.col("attrs")["Type"].alias("type_uri"), F.col("attrs")["Target"].alias("target"), F.col("attrs")["TargetMode"].alias("mode"))
    own = rels.filter("level = 0").select("doc_id", "rels_path", F.lit("none").alias("rel_id"), F.col("attrs")["xmlns"].alias("type_uri"), F.col("rels_path").alias("target"), F.lit(None).cast("string").alias("mode"))
    return row.unionByName(own)


def inferred_path(rels_path: Column, target: Column) -> Column:
    """Where a target lies in the package: below the parent of the .rels member's folder unless it says so itself; leading '/' and '.' dropped.  Interior '..' stays."""
    parent = F.regexp_replace(F.regexp_replace(rels_path, "/?[^/]*$", ""), "/?_rels$", "")
    joined = F.when((parent == "") | target.startswith("/") | target.startswith(F.concat(parent, F.lit("/"))), target).otherwise(F.concat(parent, F.lit("/"), target))
    return F.regexp_replace(joined, "^[/.]+", "")


def rels_path_of(path: Column) -> Column:
    """The .rels member that belongs to a part."""
    return F.concat(F.regexp_replace(path, "[^/]*$", ""), F.lit("_rels/"), F.element_at(F.split(path, "/"), -1), F.lit(".rels"))


def catalogue(rels: DataFrame) -> DataFrame:
    """One row for each relationship: doc_id, rel_id, type (last segment of the URI), target, dir, path.  Two relationships to one part give two rows."""
    return rels.select("doc_id", "rel_id", F.element_at(F.split("type_uri", "/"), -1).alias("type"), "target", F.regexp_replace("rels_path", "/?[^/]*$", "").alias("dir"), inferred_path(F.col("rels_path"), F.col("target")).alias("path"))


def files_of_type(parts: DataFrame, *types: str) -> DataFrame:
    """The parts of these types (default: SECTIONS), to be ordered by path as text."""
    return parts.filter(F.col("type").isin(*(types or SECTIONS)))


def file_of_type(parts: DataFrame, kind: str) -> DataFrame:
    """The first part of a type by path, one for each document; documents without one have no row."""
    first = Window.partitionBy("doc_id").orderBy("path", "rel_id")
    return parts.filter(F.col("type") == kind).withColumn("_r", F.row_number().over(first)).filter("_r = 1").drop("_r")


def rels_of_parts(parts: DataFrame, rels: DataFrame) -> DataFrame:
    """doc_id, path, rel_id, target for every part that has exactly one .rels member."""
    paths = parts.select("doc_id", "path").distinct().withColumn("rels_path", rels_path_of(F.col("path")))
    return paths.join(rels.filter("rel_id <> 'none'").select("doc_id", "rels_path", "rel_id", "target").hint("merge"), ["doc_id", "rels_path"]).select("doc_id", "path", "rel_id", "target")


def images(media: DataFrame) -> DataFrame:
    """doc_id, name, bytes of image parts (doc_id, path, bytes, error), of which one name stands once in a document; parts that cannot be read are left out."""
    return media.filter("error is null").select("doc_id", F.element_at(F.split("path", "/"), -1).alias("name"), "bytes")


def core_properties(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id and properties, local name to text of each child of the first core properties part by path; an empty map for those of docs (doc_id) without one.  Of equal names the last wins; empty text is null."""
    own = nodes.filter("level = 1").select("doc_id", "path", "pre", F.element_at(F.split("name", ":"), -1).alias("key"), F.when(F.col("text") != "", F.col("text")).alias("v"))
    last = own.groupBy("doc_id", "path", "key").agg(F.max_by(F.struct("v"), "pre")["v"].alias("v"))
    maps = last.groupBy("doc_id", "path").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "v")))).alias("properties"))
    first = maps.groupBy("doc_id").agg(F.min_by("properties", "path").alias("properties"))
    none = F.expr("cast(map() as map<string,string>)")
    return docs.select(F.col("doc_id").cast("string").alias("doc_id")).distinct().join(first.hint("merge"), "doc_id", "left").select("doc_id", F.coalesce("properties", none).alias("properties"))
