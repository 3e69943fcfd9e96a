"""Queries on streams: events arrive as files in order of time, and results equal those of one batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from featlake.operators import cooccurrence as C
from featlake.plans.registry import query
from featlake.sources import views as V
from featlake.sources.files import fresh
from featlake.streaming import streams as S


#: Days of a file of the feed; a file's rows are in no order, so watermarks wait longer than that.
DAYS, LATE = 6, "8 days"


def events(spark, d):
    """A feed of files in order of time, one written after the other, as the source takes them by their age."""
    e = V.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    folder = fresh(spark, "events")
    cut = F.floor(F.unix_timestamp("ts") / (DAYS * 86400))
    for k in sorted(r[0] for r in e.select(cut).distinct().collect() if r[0] is not None):  # one a file of the feed
        e.filter(cut == k).write.mode("append").parquet(folder)
    return S.read_files(spark, folder, e.schema, 2)


@query("P01_mergeable_moments", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS s1, round(sum(value * value), 2) AS s2, max(value) AS largest FROM events GROUP BY event_type")
def moments(spark, d):
    out = S.drain(S.moments(events(spark, d), "event_type", F.col("value")), "complete")
    return out.select("event_type", "n", F.round("s1", 4).alias("s1"), F.round("s2", 2).alias("s2"), "largest")


@query("P02_reservoir_merge", "SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY sha256('4' || chr(0) || event_id), event_id) AS r FROM events) WHERE r <= 20")
def reservoir(spark, d):
    from pyspark.sql import Window

    from featlake.operators.sampling import hash_order

    def merge(batch, so_far):
        new = batch.select("event_type", "event_id")
        w = Window.partitionBy("event_type").orderBy(hash_order(4, "event_id"), "event_id")
        all_ = new if so_far is None else new.unionByName(so_far)
        return all_.withColumn("r", F.row_number().over(w)).filter("r <= 20").drop("r")

    return spark.read.parquet(S.merge_batches(events(spark, d), fresh(spark, "reservoir"), merge))


@query("P03_cooccurrence_accumulation", "WITH b AS (SELECT DISTINCT user_id, event_type FROM events) SELECT x.event_type AS i, y.event_type AS j, count(*) AS n FROM b x JOIN b y ON x.user_id = y.user_id AND x.event_type <= y.event_type GROUP BY 1, 2")
def accumulate(spark, d):
    def merge(batch, so_far):
        new = batch.select(F.col("user_id").alias("row_id"), F.col("event_type").alias("feature"))
        return (new if so_far is None else new.unionByName(so_far)).distinct()

    return C.counts(spark.read.parquet(S.merge_batches(events(spark, d), fresh(spark, "baskets"), merge)))


@query("P04_last_active", "SELECT event_type AS key, max(event_id) AS last, count(*) AS n FROM events GROUP BY event_type")
def last_active(spark, d):
    out = S.drain(S.last_seen(events(spark, d), "event_type", "event_id"), "update")
    return out.groupBy("key").agg(F.max("last").alias("last"), F.max("n").alias("n"))


@query("P05_progressive_files", "SELECT count(*) AS n, count(DISTINCT user_id) AS users FROM events")
def progressive(spark, d):
    def merge(batch, so_far):
        new = batch.select("event_id", "user_id")
        return new if so_far is None else new.unionByName(so_far)

    return spark.read.parquet(S.merge_batches(events(spark, d), fresh(spark, "files"), merge)).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query("P06_additive_checkpoint", "SELECT user_id % 4 AS shard, count(*) AS n, round(sum(value), 4) AS s FROM events GROUP BY 1")
def additive(spark, d):
    def merge(batch, so_far):
        new = batch.groupBy((F.col("user_id") % 4).alias("shard")).agg(F.count("*").alias("n"), F.sum("value").alias("s"))
        return new if so_far is None else new.unionByName(so_far).groupBy("shard").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))

    out = spark.read.parquet(S.merge_batches(events(spark, d), fresh(spark, "sums"), merge))
    return out.select("shard", "n", F.round("s", 4).alias("s"))


@query("P07_tumbling_windows", "SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling(spark, d):
    out = S.drain(S.windowed(events(spark, d), "ts", "1 day", LATE, "event_type"), "complete")
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query("P07_sliding_windows", "SELECT strftime(s, '%Y-%m-%d %H') AS start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '1970-01-01') - INTERVAL 12 HOUR]) AS s FROM events) GROUP BY 1")
def sliding(spark, d):
    out = S.drain(S.windowed(events(spark, d), "ts", "24 hours", LATE, slide="12 hours"), "complete")
    return out.select(F.date_format("start", "yyyy-MM-dd HH").alias("start"), "n")


@query("P07_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k")
def sessions(spark, d):
    out = S.drain(S.sessions(events(spark, d), "ts", "6 hours", LATE, "user_id"), "complete")
    return out.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")
