"""Code tables of languages, scripts and countries, read from the folder that holds them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tab(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated table with a header; quotes are plain characters; empty fields are empty texts."""
    return spark.read.csv(path, sep="\t", header=True, quote="", nullValue="\x00", emptyValue="")


def languages(spark: SparkSession, folder: str) -> DataFrame:
    t = tab(spark, f"{folder}/iso-639-3.tab")
    return t.select(F.col("Id").alias("code"), F.col("Ref_Name").alias("name"), F.col("Scope").alias("scope"), F.col("Language_Type").alias("type"))


def language_names(spark: SparkSession, folder: str) -> DataFrame:
    """code, kind, text, seq of reference names and of the name index, ready for operators.registry.name_index()."""
    own = languages(spark, folder).select("code", F.lit("name").alias("kind"), F.col("name").alias("text"), F.lit(0).alias("seq"))
    t = tab(spark, f"{folder}/iso-639-3_Name_Index.tab")
    both = t.select(F.col("Id").alias("code"), F.posexplode(F.array("Print_Name", "Inverted_Name")).alias("seq", "text"))
    more = both.join(own.select("code", F.col("text").alias("own")), "code").where("text <> own AND text <> ''").select("code", F.lit("alternate_name").alias("kind"), "text", F.col("seq") + 1)
    return own.union(more)


def retirements(spark: SparkSession, folder: str) -> DataFrame:
    t = tab(spark, f"{folder}/iso-639-3_Retirements.tab")
    return t.select(F.col("Id").alias("code"), F.coalesce("Change_To", F.lit("")).alias("change_to"), F.coalesce("Ret_Reason", F.lit("")).alias("reason"))


def macrolanguages(spark: SparkSession, folder: str) -> DataFrame:
    return tab(spark, f"{folder}/iso-639-3-macrolanguages.tab").select(F.col("M_Id").alias("parent"), F.col("I_Id").alias("code"))


def scripts(spark: SparkSession, folder: str) -> DataFrame:
    """code, number, name, seq of scripts, in the order of the file."""
    lines = spark.read.text(f"{folder}/iso15924.txt").where("value <> '' AND NOT startswith(value, '#')")
    p = F.split("value", ";")
    return lines.where(F.size(p) >= 3).select(F.get(p, F.lit(0)).alias("code"), F.get(p, F.lit(1)).alias("number"), F.get(p, F.lit(2)).alias("name"), F.monotonically_increasing_id().alias("seq"))


def countries(spark: SparkSession, folder: str) -> DataFrame:
    return tab(spark, f"{folder}/countries.tsv").select("alpha_2", "name")


def details(spark: SparkSession, path: str) -> DataFrame:
    """More about languages from a CSV with lists in fields: countries by ;, dialects and names by |."""
    t = spark.read.csv(path, header=True, emptyValue="", nullValue="\x00")
    parts = lambda c, by: F.filter(F.split(F.coalesce(c, F.lit("")), by), lambda x: x != "")
    return t.select(
        F.col("iso").alias("code"), "glottocode", F.col("name").alias("glottolog_name"), "family", "classification", "macroarea", parts("countries", ";").alias("countries"),
        parts("dialects", r"\|").alias("dialects"), parts("names", r"\|").alias("names"), F.col("likely_script").alias("script"), F.col("aes").alias("endangerment"), F.col("med").alias("documentation"),
    )
