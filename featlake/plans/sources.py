"""Queries on sources and sinks: tables written in a format and read back through the library's readers."""

from __future__ import annotations

import io
import zipfile
from pathlib import Path

from pyspark.sql import Window
from pyspark.sql import functions as F

from featlake.functions import text as T
from featlake.plans.registry import query
from featlake.sources import bundles as B
from featlake.sources import encode as E
from featlake.sources import files as S
from featlake.sources import npy
from featlake.sources import views as V


def _strings(df):
    return df.select(*(F.col(c).cast("string").alias(c) for c in df.columns))


@query("A01_csv_scan", "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation")
def csv_scan(spark, d):
    path = S.fresh(spark, "nation")
    S.write_csv(_strings(V.table(spark, d, "nation")), path)
    return S.read_csv(spark, path)


@query("A02_tsv_required", "SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name FROM supplier")
def tsv(spark, d):
    path = S.fresh(spark, "supplier")
    S.write_csv(_strings(V.table(spark, d, "supplier")), path, "\t")
    return S.read_csv(spark, path, ["s_suppkey", "s_name"], "\t").select("s_suppkey", "s_name")


@query("A03_schema_union", "SELECT 'a.tsv' AS path, n_name AS category, '' AS level FROM nation UNION ALL SELECT 'b.tsv', r_name, 'region' FROM region")
def schema_union(spark, d):
    a = V.table(spark, d, "nation").select(F.col("n_name").alias("category"))
    b = V.table(spark, d, "region").select(F.col("r_name").alias("category"), F.lit("region").alias("level"))
    return S.union_of_schemas({"b.tsv": b, "a.tsv": a})


@query("A04_shard_discovery", "SELECT doc_id, source FROM documents WHERE lang = 'de' AND source = 'src5'")
def discovery(spark, d):
    root = S.fresh(spark, "tree")
    V.table(spark, d, "documents").select("doc_id", "lang", "source").repartition("lang", "source").write.partitionBy("lang", "source").parquet(root)
    return S.discover(spark, root, lang="de", source="src5").select("doc_id", "source")


@query("A05_target_discovery", "SELECT lang AS config, count(*) AS n FROM documents GROUP BY lang")
def targets(spark, d):
    root = S.fresh(spark, "configs")
    V.table(spark, d, "documents").select("doc_id", F.col("lang").alias("config")).write.partitionBy("config").parquet(root)
    return S.discover(spark, root).groupBy("config").agg(F.count("*").alias("n"))


@query("A06_npy_scan", "SELECT vec_id AS global_row, round(CAST(embedding[3] AS DOUBLE), 5) AS x FROM embeddings")
def npy_scan(spark, d):
    npy.register(spark)
    folder = S.fresh(spark, "npy")
    npy.write(V.table(spark, d, "embeddings").select("vec_id", "embedding"), "vec_id", "embedding", folder)
    return spark.read.format("npy").option("rows", 64).load(folder).select("global_row", F.round(F.get("embedding", F.lit(2)).cast("double"), 5).alias("x"))


@query("A07_csr_scan", f"WITH {V.ACTS} SELECT row_id, count(*) AS n, CAST(sum(feature) AS BIGINT) AS s FROM acts GROUP BY row_id")
def csr(spark, d):
    """Rows as (indices, data) arrays, unrolled to long form."""
    a = V.acts(spark, d).groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("feature", "value"))).alias("e"))
    csr = S.stage(a.select("row_id", F.transform("e", lambda x: x["feature"]).alias("indices"), F.transform("e", lambda x: x["value"]).alias("data")), "csr")
    long = csr.select("row_id", F.inline(F.arrays_zip("indices", "data"))).withColumnRenamed("indices", "feature")
    return long.groupBy("row_id").agg(F.count("*").alias("n"), F.sum("feature").cast("long").alias("s"))


@query("A09_coo_scan", f"WITH {V.ACTS} SELECT feature, count(*) AS n FROM acts WHERE feature BETWEEN 10 AND 12 GROUP BY feature")
def coo(spark, d):
    path = S.fresh(spark, "coo")
    S.write_sorted(V.acts(spark, d), path, "feature", 4)
    return spark.read.parquet(path).filter("feature between 10 and 12").groupBy("feature").agg(F.count("*").alias("n"))


@query("A11_incomplete_shards", "SELECT DISTINCT source AS shard FROM documents WHERE source LIKE 'src1%'")
def incomplete(spark, d):
    shards = V.table(spark, d, "documents").select(F.col("source").alias("shard")).distinct()
    path = S.fresh(spark, "markers")
    shards.filter("shard not like 'src1%'").withColumn("status", F.lit("complete")).write.json(path)
    return S.incomplete(shards, spark.read.schema("shard string, status string").json(path).filter("status = 'complete'"), "shard")


@query("A13_pruned_point_set", "SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT vec_id * 7 FROM embeddings)")
def point_set(spark, d):
    """Only files and row groups within the wanted range are read: their least and largest id are pushed to the scan."""
    path = S.fresh(spark, "catalog")
    S.write_sorted(V.table(spark, d, "documents").select("doc_id", "n_chars", "text"), path, "doc_id", 4)
    wanted = V.table(spark, d, "embeddings").select((F.col("vec_id") * 7).alias("doc_id"))
    low, high = wanted.agg(F.min("doc_id"), F.max("doc_id")).first()
    return spark.read.parquet(path).select("doc_id", "n_chars").filter(F.col("doc_id").between(low, high)).join(wanted, "doc_id", "left_semi")


@query("A14_pushed_in_filter", "SELECT doc_id, lang FROM documents WHERE doc_id IN (3, 77, 205, 901)")
def pushed(spark, d):
    return V.table(spark, d, "documents").filter(F.col("doc_id").isin(3, 77, 205, 901)).select("doc_id", "lang")


@query("A15_text_resolution", "SELECT v.vec_id, coalesce(nullif(trim(d.text), ''), '[EMPTY]') AS text FROM embeddings v JOIN documents d ON d.doc_id = v.vec_id * 3")
def resolution(spark, d):
    metadata = V.rows(spark, d).select(F.col("row_id").alias("vec_id"), (F.col("row_id") * 3).alias("doc_id"))
    docs = V.table(spark, d, "documents").select("doc_id", "text")
    return V.rows(spark, d).select(F.col("row_id").alias("vec_id")).join(metadata, "vec_id").join(docs, "doc_id").select("vec_id", F.coalesce(F.nullif(F.trim("text"), F.lit("")), F.lit(T.EMPTY)).alias("text"))


@query("A16_jsonl_shards", "SELECT doc_id, lang FROM documents WHERE lang IN ('fr', 'es')")
def jsonl(spark, d):
    root = S.fresh(spark, "jsonl")
    V.table(spark, d, "documents").select("doc_id", "lang").write.partitionBy("lang").option("compression", "gzip").json(root)
    return spark.read.schema("doc_id long, lang string").json(root).filter(F.col("lang").isin("fr", "es"))


@query("A17_zipped_tsv", "SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_brand FROM part WHERE p_brand = 'Brand#12'")
def zipped(spark, d):
    rows = V.table(spark, d, "part").filter("p_brand = 'Brand#12'").select("p_partkey", "p_brand").collect()  # the writer of a test file
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("parts.tsv", "p_partkey\tp_brand\n" + "".join(f"{a}\t{b}\n" for a, b in rows))
    path = S.fresh(spark, "zip")
    at, folder = npy.located(path)
    at.create_dir(folder, recursive=True)
    with at.open_output_stream(f"{folder}/parts.zip") as f:
        f.write(buffer.getvalue())
    return S.read_zipped(spark, path, "parts.tsv", ["p_partkey", "p_brand"])


@query("A18_comment_tsv", "SELECT CAST(r_regionkey AS VARCHAR) AS r_regionkey, r_name FROM region")
def comments(spark, d):
    path = S.fresh(spark, "comments")
    lines = V.table(spark, d, "region").select(F.concat_ws("\t", F.col("r_regionkey").cast("string"), "r_name").alias("value"))
    head = spark.createDataFrame([("# a comment",), ("r_regionkey\tr_name",)], "value string")
    head.coalesce(1).unionAll(lines).coalesce(1).write.text(path)
    return S.read_csv(spark, path, ["r_regionkey", "r_name"], "\t", "#").select("r_regionkey", "r_name")


@query("A19_word_list", "SELECT word, n FROM (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents) GROUP BY word) ORDER BY n DESC, word LIMIT 500")
def word_list(spark, d):
    w = V.table(spark, d, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word"))
    return w.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(500)


@query("A21_embedding_source")
def embedding_source(spark, d):
    """Texts in requests of bounded tokens through an encoder; a deterministic hashing encoder stands in for a service."""
    out = E.embed(V.table(spark, d, "documents"), "doc_id", "text", E.Hashing)
    return out.select("doc_id", F.posexplode("embedding").alias("i", "x"))


class Small:
    """An encoder that takes few texts at a time, as a model does whose memory is short."""

    def __init__(self, most: int):
        self.most, self.inner = most, E.Hashing()

    def __call__(self, texts):
        if len(texts) > self.most:
            raise MemoryError
        return self.inner(texts)


@query("A23_local_encoder")
def local_encoder(spark, d):
    """The same through a local encoder that runs out of memory above three texts, loaded once a task."""
    out = E.embed(V.table(spark, d, "documents"), "doc_id", "text", lambda: Small(3))
    return out.select("doc_id", F.posexplode("embedding").alias("i", "x"))


@query("A22_keyed_reorder", "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS place, 0::BIGINT AS faults FROM documents")
def keyed(spark, d):
    """Batch jobs: keyed requests, answers in no order, and every row's answer back in the order of the keys."""
    docs = V.table(spark, d, "documents").select("doc_id", "text")
    rows, faults = E.collect_jobs(docs, "doc_id", E.run_jobs(spark, E.submit(docs, "doc_id", "text", 4), E.Hashing))
    return rows.select("doc_id", "place").withColumn("faults", F.lit(faults.count()).cast("long"))


@query("B04_npy_shards", "SELECT count(*) AS rows, round(sum(CAST(embedding[1] AS DOUBLE)), 4) AS s FROM embeddings")
def npy_shards(spark, d):
    """Vectors as NPY shards, each renamed into place whole, written twice to the same folder and read back."""
    npy.register(spark)
    folder = S.fresh(spark, "shards")
    e = V.table(spark, d, "embeddings").select("vec_id", "embedding")
    for _ in range(2):
        npy.write(e, "vec_id", "embedding", folder)
    return spark.read.format("npy").load(folder).agg(F.count("*").alias("rows"), F.round(F.sum(F.get("embedding", F.lit(0)).cast("double")), 4).alias("s"))


@query("A25_ranked_table", "SELECT p_partkey, CAST(row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS INTEGER) AS rank FROM part QUALIFY rank IN (1, 5, 9)")
def ranked(spark, d):
    top = V.table(spark, d, "part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(9).select("p_partkey", "p_retailprice")
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("p_retailprice"), "p_partkey"))).filter(F.col("rank").isin(1, 5, 9)).select("p_partkey", "rank")


@query("B02_parquet_zstd", "SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def zstd(spark, d):
    path = S.fresh(spark, "zstd")
    V.table(spark, d, "documents").select("doc_id", "lang").write.option("compression", "zstd").partitionBy("lang").parquet(path)
    return spark.read.parquet(path).groupBy("lang").agg(F.count("*").alias("n"))


@query("B03_ordered_catalog", "SELECT 0::BIGINT AS overlaps, count(*) AS rows FROM documents")
def catalog(spark, d):
    path = S.fresh(spark, "ordered")
    S.write_sorted(V.table(spark, d, "documents").select("doc_id", "text"), path, "doc_id", 4)
    parts = spark.read.parquet(path).groupBy(F.input_file_name().alias("f")).agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n"))
    w = Window.orderBy("lo")
    return parts.withColumn("bad", (F.lag("hi").over(w) >= F.col("lo")).cast("int")).agg(F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("overlaps"), F.sum("n").alias("rows"))


def _tree(spark, d, name):
    """A folder with a file of JSON lines for each region."""
    root = Path(S.fresh(spark, name).removeprefix("file://"))  # bundles lie on mounted paths
    root.mkdir(parents=True)
    for r in V.table(spark, d, "region").orderBy("r_regionkey").collect():  # five rows
        (root / f"{r['r_name'].lower().replace(' ', '-')}.json").write_text(r["r_name"] + "\n")
    return root


@query("B06_bundle_round_trip", "SELECT lower(replace(r_name, ' ', '-')) || '.json' AS name, length(r_name) + 1 AS bytes, sha256(r_name || chr(10)) AS sha256, 1 AS same_bytes FROM region")
def bundle(spark, d):
    """Seal, archive twice, unpack: the archives are equal byte by byte and the members are those of the folder."""
    root = _tree(spark, d, "bundle")
    B.seal(root, "regions", {"of": "region"})
    digests = [B.archive(root, root.with_name(n)) for n in ("one.tar.gz", "two.tar.gz")]
    manifest = B.unpack(root.with_name("two.tar.gz"), root.with_name("unpacked"))
    rows = [(f["path"], f["bytes"], f["sha256"], int(len(set(digests)) == 1)) for f in manifest["files"]]
    return spark.createDataFrame(rows, "name string, bytes long, sha256 string, same_bytes int")


@query("N08_bundle_checks", "SELECT * FROM (VALUES ('europe.json', 'changed'), ('asia.json', 'missing'), ('more.txt', 'unlisted'), ('africa.json', 'listed twice'), ('../out', 'unsafe'), ('../out', 'missing')) AS t(name, problem)")
def bundle_checks(spark, d):
    """A sealed folder with a fault of each kind put in, checked by Spark over its files."""
    root = _tree(spark, d, "checked")
    rows = [(f["path"], f["bytes"], f["sha256"]) for f in B.seal(root, "regions")["files"]]
    twice = [r for r in rows if r[0] == "africa.json"]
    manifest = spark.createDataFrame([*rows, *twice, ("../out", 1, "00")], "name string, bytes long, sha256 string")
    (root / "europe.json").write_text("other")
    (root / "asia.json").unlink()
    (root / "more.txt").write_text("more")
    return S.verify_bundle(manifest, S.digests(spark, f"file://{root}").filter(F.col("name") != B.MANIFEST))


@query("N11_idempotent_resume", "SELECT DISTINCT source AS shard FROM documents WHERE source >= 'src5'")
def resume(spark, d):
    all_ = V.table(spark, d, "documents").select(F.col("source").alias("shard")).distinct()
    done = S.stage(all_.filter("shard < 'src5'"), "done")
    return S.incomplete(all_, done, "shard")


@query("N12_single_model_view", f"WITH {V.ACTS} SELECT count(*) AS slots, count(DISTINCT row_id) AS rows FROM acts WHERE feature % 2 = 0")
def single_view(spark, d):
    V.acts(spark, d).withColumn("model", F.when(F.col("feature") % 2 == 0, "a").otherwise("b")).createOrReplaceTempView("featlake_cache")
    return spark.sql("SELECT count(*) AS slots, count(DISTINCT row_id) AS rows FROM featlake_cache WHERE model = 'a'")


@query("N14_snapshot_hashes", "SELECT r_name FROM region WHERE r_regionkey <> 2")
def snapshot(spark, d):
    r = V.table(spark, d, "region").select("r_regionkey", "r_name", F.sha2(F.col("r_name").cast("binary"), 256).alias("sha"))
    recorded = r.filter("r_regionkey <> 2").select("sha")
    return r.join(recorded, "sha", "left_semi").select("r_name")


#: Names by the remainder of an id: whether each is safe.
_NAMES = [("a/b-", 1), ("../escape-", 0), ("/absolute-", 0), ("x/../../escape-", 0), ("a\\b-", 0), ("a//b-", 0), ("./a-", 0), ("a.b/..c-", 1)]


@query("J28_safe_paths", f"SELECT s_suppkey, ([{', '.join(str(ok) for _, ok in _NAMES)}])[s_suppkey % {len(_NAMES)} + 1] AS safe FROM supplier")
def safe_paths(spark, d):
    start = F.element_at(F.array(*(F.lit(n) for n, _ in _NAMES)), (F.col("s_suppkey") % len(_NAMES) + 1).cast("int"))
    return V.table(spark, d, "supplier").select("s_suppkey", S.safe_path(F.concat(start, "s_name")).cast("int").alias("safe"))
