"""Queries on what stands around jobs: variables, secrets in command lines, plans, work shared out; and charts of results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from featlake.functions import svg
from featlake.functions import workflow as W
from featlake.plans.registry import query
from featlake.sources import views as V


@query("C13_redacted_commands", "SELECT s_suppkey, 'run --api-key *** --token=*** --name ' || s_name || ' --size=3' AS command FROM supplier")
def redacted(spark, d):
    argv = F.array(F.lit("run"), F.lit("--api-key"), F.col("s_name"), F.concat(F.lit("--token="), F.col("s_suppkey").cast("string")), F.lit("--name"), F.col("s_name"), F.lit("--size=3"))
    return V.table(spark, d, "supplier").select("s_suppkey", F.array_join(W.redacted(argv), " ").alias("command"))


@query("J34_substitution", "SELECT s_suppkey, '/data/' || s_name || '/' || s_suppkey || '/${other}' AS path FROM supplier")
def substitution(spark, d):
    template = F.lit("${root}/${name}/${key}/$${other}")
    values = {"root": F.lit("/data"), "name": F.col("s_name"), "key": F.col("s_suppkey").cast("string")}
    return V.table(spark, d, "supplier").select("s_suppkey", W.substituted(template, values).alias("path"))


@query("H11_balanced_tasks")
def balanced(spark, d):
    """Sources of documents to three workers, by characters, the largest first to whoever has least."""
    costs = V.table(spark, d, "documents").groupBy("source").agg(F.sum("n_chars").alias("cost")).collect()  # a row a shard
    shares = W.balanced({r["source"]: float(r["cost"] or 0) for r in costs}, 3)
    return spark.createDataFrame([(s, k) for k, names in enumerate(shares) for s in names], "source string, worker int")


@query("N10_workflow_plan", "SELECT 'fit ' || k || ' ' || r_name || ' --token ***' AS command, CAST(k = 'flat' AS INTEGER) AS missing FROM region, (SELECT unnest(['flat', 'tree']) AS k)")
def plan(spark, d):
    """The commands of a matrix of parameters, without secrets, and which of them lack their input."""
    names = [r["r_name"] for r in V.table(spark, d, "region").collect()]  # five rows
    commands = W.expand(["fit", "${kind}", "${region}", "--token", "t"], {"kind": ["flat", "tree"], "region": names})
    made = W.plan(commands, ["/no/such/flat"])
    lacks = {p.rsplit("/", 1)[1] for p in made["missing"]}
    return spark.createDataFrame([(" ".join(c), int(c[1] in lacks)) for c in made["commands"]], "command string, missing int")


@query("B08_chart", "SELECT 'bars' AS chart, count(DISTINCT lang) AS marks FROM documents UNION ALL SELECT 'line', count(DISTINCT user_id % 7) FROM events")
def chart(spark, d):
    """Small result tables as SVG charts; the marks in them are counted back."""
    langs = [(r["lang"], r["n"]) for r in V.table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").collect()]  # a row a language
    days = [(r["k"], r["n"]) for r in V.table(spark, d, "events").groupBy((F.col("user_id") % 7).alias("k")).agg(F.count("*").alias("n")).orderBy("k").collect()]  # seven rows
    charts = {"bars": svg.bars(langs, "documents by language"), "line": svg.line(days, "events")}
    parts = [spark.createDataFrame([(n, x.count("<title>") - 1)], "chart string, marks long") for n, x in charts.items()]
    return reduce(lambda a, b: a.unionAll(b), parts)
