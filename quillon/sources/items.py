"""Readers and writers of items, clusters and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ITEM = "struct<gps_info:map<string,string>,exif_info:map<string,string>,label:array<string>>"


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """(item_id, gps, exif, event_id, scene_id) of a dataset file: JSON encoded twice, its first element a map of items."""
    text = spark.read.text(path, wholetext=True)
    once = text.select(F.from_json(F.concat(F.lit('{"v":'), F.col("value"), F.lit("}")), "v string")["v"].alias("inner"))
    first = once.select(F.get_json_object("inner", "$[0]").alias("info"))
    items = first.select(F.explode(F.from_json("info", f"map<string,{ITEM}>")).alias("item_id", "x"))
    label = lambda k: F.get("x.label", F.lit(k))
    return items.select("item_id", F.col("x.gps_info").alias("gps"), F.col("x.exif_info").alias("exif"), label(0).alias("event_id"), label(1).alias("scene_id"))


def list_files(spark: SparkSession, path: str, suffix: str = ".jpg", keyword: str = "") -> DataFrame:
    """(path, name) of all files below ``path`` by suffix, in any case, and a part of the name; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    named = files.withColumn("name", F.element_at(F.split("path", "/"), -1))
    return named.where(F.lower("name").endswith(suffix.lower()) & F.col("name").contains(keyword))


def folder_labels(files: DataFrame) -> DataFrame:
    """``files`` with event and scene from ``…/Event<e>/Scene_<s>/<file>``; null where the path has none."""
    part = lambda p: F.nullif(F.regexp_extract("path", p, 1), F.lit(""))
    return files.withColumn("event", part(r"/Event([^/]*)/")).withColumn("scene", part(r"/Scene_([^/]*)/"))


def result_json(clusters: DataFrame, key: str, item: str, most: int = 10_000) -> DataFrame:
    """(key, part, value): each cluster's items as a JSON string of its key and ascending items, encoded once more as a string.

    A cluster of over ``most`` items has several parts, of about that many each by a hash of the item, so that no row grows
    with a cluster.
    """
    sizes = clusters.groupBy(key).agg(F.ceil(F.count("*") / most).cast("long").alias("_parts"))
    dealt = clusters.join(sizes, key).withColumn("part", F.pmod(F.xxhash64(item), F.col("_parts")))
    groups = dealt.groupBy(key, "part").agg(F.sort_array(F.collect_list(item)).alias("items"))
    return groups.select(key, "part", F.to_json(F.struct(F.col(key).alias("cluster"), "items")).alias("value"))


#: The columns of the pair tables, in order, with what stands for a missing value (fixed values): with places, by time alone.
PAIRS = (
    "first string 'xx', second string 'xx', distance double -1, time double -1, exposure_time double -1, flash double -1, focal_length double -1, "
    "shutter_speed double -1, scene_type int -1, sensing_method int -1, holiday int -1, delta_closest_holiday double -1, "
    "average_closest_holiday double -1, average_city_prop double -1, delta_time_freq double -1, label_e int 0, label_s int 0"
)
TIME_PAIRS = (
    "first string 'xx', second string 'xx', sec double -1, day double -1, sec_in_day double -1, time_freq double -1, exposure_time double -1, "
    "flash double -1, focal_length double -1, shutter_speed double -1, scene_type int -1, sensing_method int -1, holiday int -1, "
    "delta_closest_holiday double -1, average_closest_holiday double -1, label_e int 1, label_s int 1"
)


def _declared(columns: str) -> tuple[str, dict[str, object]]:
    """(schema, what stands for a missing value) of a list of ``name type default``."""
    parts = [c.split() for c in columns.split(", ")]
    return ", ".join(f"{n} {t}" for n, t, _ in parts), {n: d.strip("'") if t == "string" else float(d) if t == "double" else int(d) for n, t, d in parts}


def read_pairs(spark: SparkSession, *paths: str, columns: str = PAIRS, header: bool = False) -> DataFrame:
    """A typed table of pairs from one or more CSV files, read as one; a value that is missing or of another type is the default."""
    schema, defaults = _declared(columns)
    return spark.read.schema(schema).option("header", header).option("enforceSchema", True).csv(list(paths)).na.fill(defaults)


def write_pairs(pairs: DataFrame, path: str, header: bool = True) -> None:
    """Pair features as CSV; without a header they are what ``read_pairs`` reads."""
    pairs.write.mode("overwrite").option("header", header).csv(path)


def write_predictions(scored: DataFrame, path: str) -> None:
    """Scored pairs as CSV with a header, by the order of their names (first, second), each part of the order a file."""
    scored.repartitionByRange("first", "second").sortWithinPartitions("first", "second").write.mode("overwrite").option("header", True).csv(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header; blanks around names and values go. predicted_label is an int and probability a double."""
    rows = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    kinds = {"predicted_label": "int", "true_label": "int", "probability": "double"}
    return rows.select(*[(F.col(f"`{c}`").try_cast(kinds[c.strip()]) if c.strip() in kinds else F.col(f"`{c}`")).alias(c.strip()) for c in rows.columns])


def read_lookup(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """A small CSV with a header as strings, its columns renamed in order."""
    return spark.read.option("header", True).csv(path).toDF(*names)


def write_lookup(known: DataFrame, path: str) -> None:
    """A lookup table as CSV with a header, replacing what was there."""
    known.write.mode("overwrite").option("header", True).csv(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Is there a file or folder at the path, in whatever file system it names?"""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def kept(spark: SparkSession, path: str, make) -> DataFrame:
    """The Parquet table at ``path``; if it isn't there yet, ``make()`` is written to it first."""
    if not exists(spark, f"{path.rstrip('/')}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def labelled_items(items: DataFrame, labels: DataFrame, item: str = "item_id") -> tuple[DataFrame, DataFrame]:
    """(items with their labels, items without one), joined by name."""
    return items.join(labels, item), items.join(labels.select(item), item, "left_anti")


def write_clusters(assigned: DataFrame, path: str, *keys: str) -> None:
    """A cluster assignment as Parquet in a folder for each value of the keys."""
    assigned.write.mode("overwrite").partitionBy(*keys).parquet(path)


def write_lines(df: DataFrame, path: str) -> None:
    """A single string column as text lines."""
    df.write.mode("overwrite").text(path)
