"""Readers of profiler output: stacks with costs, as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators.graph import nearest_ancestor

#: Fixed values of the formats.
PERF_FRAME = r"(?m)^\s+[0-9a-fA-F]+\s+(.*?)(?:\+0x[0-9a-fA-F]+)?\s+\("
JSON_SCHEMA = "version int, functions array<struct<name:string,module:string,process:string>>, events array<struct<callchain:array<int>,cost:array<double>>>"


def perf_stack(block: Column) -> Column:
    """The frames, leaf first, of one sample of a text trace: lines of address, symbol (offset cut off) and module in parentheses."""
    return F.regexp_extract_all(block, F.lit(PERF_FRAME), F.lit(1))


def read_perf(spark: SparkSession, path: str) -> DataFrame:
    """(stack, cost) of a text trace whose samples are separated by blank lines; the file is split at them, so it is read in parallel."""
    blocks = spark.read.option("lineSep", "\n\n").text(path)
    return blocks.select(perf_stack(F.col("value")).alias("stack"), F.lit(1.0).alias("cost")).where(F.size("stack") > 0)


def xperf_stack(stack: Column, module: Column, function: Column) -> Column:
    """The frames, leaf first, of a ``[Root]/a!f/b!g`` column; module!function alone where the stack is unknown (``?``)."""
    frames = F.reverse(F.filter(F.split(stack, "/"), lambda f: (f != "[Root]") & (f != "")))
    return F.when(stack == "?", F.array(F.concat_ws("!", module, function))).otherwise(frames)


def read_xperf(spark: SparkSession, path: str) -> DataFrame:
    """(stack, cost, calls) of a CSV with Process Name, Module, Function, Weight, Count, Stack: cost is Weight times Count, calls
    is Count, by which the stack's calls are weighed. Rows of the idle process are left out; the sampled function is added
    to a stack that ends without it."""
    rows = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    busy = rows.where(F.coalesce(~F.col("Process Name").rlike(r"^Idle( \(\d+\))?$"), F.lit(True)))
    number = lambda c: F.coalesce(F.regexp_replace(c, ",", "").try_cast("double"), F.lit(0.0))
    own, frames = F.concat_ws("!", "Module", "Function"), xperf_stack(F.col("Stack"), F.col("Module"), F.col("Function"))
    whole = F.when(F.try_element_at(frames, F.lit(1)).eqNullSafe(own), frames).otherwise(F.concat(F.array(own), frames))
    return busy.select(whole.alias("stack"), (number("Weight") * number("Count")).alias("cost"), number("Count").alias("calls"))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """(stack, cost) of the JSON form: functions by index and events with a call chain, leaf first, and its first cost."""
    doc = spark.read.schema(JSON_SCHEMA).option("multiLine", True).json(path)
    e = doc.select("functions", F.explode("events").alias("e"))
    return e.select(F.transform("e.callchain", lambda k: F.get("functions", k)["name"]).alias("stack"), F.try_element_at("e.cost", F.lit(1)).alias("cost"))


def read_hprof(spark: SparkSession, path: str) -> DataFrame:
    """(stack, cost) of a text dump: TRACE blocks joined with the CPU SAMPLES table by trace number."""
    text = spark.read.text(path, wholetext=True)
    trace = text.select(F.explode(F.regexp_extract_all("value", F.lit(r"(?m)^TRACE \d+:.*(?:\n\t.*)*"), F.lit(0))).alias("t"))
    stacks = trace.select(F.regexp_extract("t", r"^TRACE (\d+):", 1).cast("long").alias("trace"), F.regexp_extract_all("t", F.lit(r"\n\t(\S+?)\("), F.lit(1)).alias("stack"))
    row = r"(?m)^\s*\d+\s+[\d.]+%\s+[\d.]+%\s+\d+\s+\d+\s+\S+\s*$"
    line = text.select(F.explode(F.regexp_extract_all("value", F.lit(row), F.lit(0))).alias("l")).select(F.split(F.trim("l"), r"\s+").alias("c"))
    return stacks.join(line.select(F.col("c")[4].cast("long").alias("trace"), F.col("c")[3].cast("double").alias("cost")), "trace").select("stack", "cost")


def read_sysprof(spark: SparkSession, path: str) -> DataFrame:
    """(object, name, self) of an XML profile's object list."""
    rows = spark.read.format("xml").option("rowTag", "object").schema("_id long, name string, self long").load(path)
    return rows.select(F.col("_id").alias("object"), F.regexp_replace("name", r"^In file ", "").alias("name"), "self")


def read_sysprof_nodes(spark: SparkSession, path: str) -> DataFrame:
    """(node, object, self, parent) of an XML profile's call tree; parent 0 at the roots."""
    return spark.read.format("xml").option("rowTag", "node").schema("_id long, object long, self long, parent long").load(path).withColumnRenamed("_id", "node")


def sysprof_graph(objects: DataFrame, tree: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a call graph from the objects and the call tree: objects without samples of their own (processes,
    modules) are passed over, a tree node's samples are a call from its nearest ancestor that is not one of them."""
    real = objects.where("self <> 0")
    live = tree.join(real.select("object", F.col("name").alias("own_name")), "object", "left")
    up = nearest_ancestor(live.select("node", F.when(F.col("parent") != 0, F.col("parent")).alias("parent"), F.col("own_name").isNotNull().alias("live")))
    called = live.where((F.col("self") != 0) & F.col("own_name").isNotNull()).select("node", F.col("own_name").alias("dst"), "self").join(up.where("ancestor is not null"), "node")
    by = live.select(F.col("node").alias("ancestor"), F.col("own_name").alias("src"))
    edges = called.join(by, "ancestor").groupBy("src", "dst").agg(F.sum("self").cast("double").alias("weight"))
    return real.groupBy("name").agg(F.sum("self").cast("double").alias("self")), edges
