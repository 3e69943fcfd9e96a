"""Queries on scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from featlake.functions import color as K
from featlake.functions import hashing as HS
from featlake.functions import text as T
from featlake.operators import sampling as SM
from featlake.operators.order import placed
from featlake.plans.registry import query
from featlake.sources import views as V


def docs(spark, d):
    return V.table(spark, d, "documents").select("doc_id", "text", "lang", "source")


def _simple(name, sql, column):
    @query(name, f"SELECT doc_id, {sql} AS y FROM documents")
    def run(spark, d):
        return docs(spark, d).select("doc_id", column().alias("y"))

    return run


t = lambda: F.col("text")
ONE = f"trim(regexp_replace(text, '{T.WHITE}+', ' ', 'g'))"
#: SQL of a focused excerpt of 40 characters around `the `.
FOCUSED = f"""(SELECT CASE WHEN a < 0 THEN p ELSE CASE WHEN stop < length(p) THEN substring(head, 1, length(head) - 3) || '...' ELSE head END END FROM (SELECT *, CASE WHEN start > 0 THEN '...' || substring(p, CAST(start + 4 AS BIGINT), CAST(stop - start - 3 AS BIGINT)) ELSE substring(p, CAST(start + 1 AS BIGINT), CAST(stop - start AS BIGINT)) END AS head
 FROM (SELECT *, greatest(0, stop - 40) AS start FROM (SELECT *, least(length(p), greatest(0, a - 20) + 40) AS stop FROM (SELECT p, instr(replace(replace(lower(p), 'ß', 'ss'), 'ς', 'σ'), 'the ') - 1 AS a FROM (SELECT coalesce(nullif({ONE}, ''), '[EMPTY]') AS p))))))"""
#: One character after each text, by its id: the ends of every range and what stands beside them.
_ENDS = [c for a, b in T.EXCLUDED_SCRIPTS for c in (a - 1, a, b, b + 1) if not 0xD800 <= c <= 0xDFFF]
ODD = lambda: F.element_at(F.array(*(F.lit(chr(c)) for c in _ENDS)), (F.col("doc_id") % len(_ENDS) + 1).cast("int"))
ODD_SQL = f"chr(([{', '.join(map(str, _ENDS))}])[doc_id % {len(_ENDS)} + 1])"
_simple("J01_normalise_space", f"coalesce(nullif(trim(regexp_replace(text, '{T.WHITE}+', ' ', 'g')), ''), '[EMPTY]')", lambda: T.normalise_space(t()))
_simple("J03_excerpt", "CASE WHEN length(text) <= 80 THEN text ELSE rtrim(substring(text, 1, 77), ' ') || '...' END", lambda: T.excerpt(t(), 80))
_simple("J04_word_excerpt", f"CASE WHEN length({ONE}) <= 60 THEN {ONE} ELSE rtrim(regexp_replace(substring({ONE}, 1, 59), ' [^ ]*$', '')) || '…' END", lambda: T.word_excerpt(t(), 60))
_simple("J05_focused_excerpt", FOCUSED, lambda: T.focused_excerpt(t(), F.lit("The "), 40))
_simple("J08_sanitise", r"coalesce(nullif(regexp_replace(substring(text, 1, 10000), '^[\t-\r ]+|[\t-\r ]+$', '', 'g'), ''), '[EMPTY]')", lambda: T.sanitise(t(), 10000))
_simple("J10_template", "'What is said in ' || lang || ' by ' || source || '?'", lambda: F.format_string("What is said in %s by %s?", "lang", "source"))
_simple("J11_category_id", "lang || ':' || source", lambda: T.category_id(F.col("lang"), F.col("source")))
_simple("J12_stable_id", "substring(sha1('docs' || chr(0) || text), 1, 24)", lambda: HS.stable_id("docs", t()))
_simple("J13_sha256", "sha256(text)", lambda: F.sha2(t().cast("binary"), 256))
_simple("J30_token_estimate", "CAST(ceil(length(text) / 3.5::DOUBLE) AS BIGINT)", lambda: T.token_estimate(t(), 3.5))
_simple("J33_script", "CASE WHEN regexp_matches(text, '[Ѐ-ӿ]') THEN 'cyrillic' WHEN regexp_matches(text, '[Ͱ-Ͽ]') THEN 'greek' WHEN regexp_matches(text, '" + T.EXCLUDED + "') THEN 'cjk' WHEN regexp_matches(text, '[À-ɏ]') THEN 'latin-extended' ELSE 'latin' END", lambda: T.script(t()))
_simple("C06_excluded_script", f"CAST(regexp_matches(text || {ODD_SQL}, '{T.EXCLUDED}') AS INTEGER)", lambda: T.excluded_script(F.concat("text", ODD())).cast("int"))
_simple("C05_ascii_text", "CAST(regexp_full_match(lower(trim(source)), '[a-z]+') AS INTEGER)", lambda: T.ascii_word(F.col("source")).cast("int"))


@query("J02_folded")
def folded(spark, d):
    return docs(spark, d).select("doc_id", F.sha2(T.folded(t()).cast("binary"), 256).alias("y"))


@query("J06_repaired")
def repaired(spark, d):
    return docs(spark, d).select("doc_id", F.length(T.repaired(t())).alias("y"))


@query("J07_latex", "SELECT p_partkey, replace(replace(replace(p_name || '_50%' || p_brand || '#', '%', '\\%'), '#', '\\#'), '_', '\\_') AS y FROM part")
def latex(spark, d):
    return V.table(spark, d, "part").select("p_partkey", T.latex(F.concat("p_name", F.lit("_50%"), "p_brand", F.lit("#"))).alias("y"))


@query("J14_crc32")
def crc(spark, d):
    return docs(spark, d).groupBy(F.crc32(F.col("lang").cast("binary")).alias("seed")).agg(F.count("*").alias("n"))


@query("J17_activation_bin", f"WITH {V.ACTS} SELECT CASE WHEN value > 0.3::FLOAT THEN 6 WHEN value > 0.2::FLOAT THEN 5 WHEN value > 0.1::FLOAT THEN 4 WHEN value > 0.05::FLOAT THEN 3 WHEN value > 0.02::FLOAT THEN 2 WHEN value > 0.01::FLOAT THEN 1 ELSE 0 END AS bin, count(*) AS n FROM acts GROUP BY 1")
def bins(spark, d):
    return V.acts(spark, d).groupBy(SM.activation_bin(F.col("value")).alias("bin")).agg(F.count("*").alias("n"))


@query("J19_percent", "SELECT l_orderkey, l_linenumber, CAST(greatest(0, least(100, round_even(l_discount * 100, 0))) AS INTEGER) AS y FROM lineitem")
def percent(spark, d):
    return V.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", T.percent(F.col("l_discount")).alias("y"))


COLORS = "WITH c AS (SELECT p_partkey, CAST(p_partkey * 37 % 256 AS INTEGER) AS r, CAST(p_partkey * 91 % 256 AS INTEGER) AS g, CAST(p_partkey * 53 % 256 AS INTEGER) AS b FROM part), k AS (SELECT *, greatest(r, g, b) / 255.0::DOUBLE AS v, (greatest(r, g, b) + least(r, g, b)) / 510.0::DOUBLE AS l, CASE WHEN greatest(r, g, b) = 0 THEN 0 ELSE (greatest(r, g, b) - least(r, g, b)) / CAST(greatest(r, g, b) AS DOUBLE) END AS s FROM c)"


def colors(spark, d):
    of = lambda n: ((F.col("p_partkey") * n) % 256).cast("int")
    return V.table(spark, d, "part").select("p_partkey", of(37).alias("r"), of(91).alias("g"), of(53).alias("b"))


@query("J25_color_space", COLORS + " SELECT p_partkey, '#' || lower(lpad(to_hex(r), 2, '0')) || lower(lpad(to_hex(g), 2, '0')) || lower(lpad(to_hex(b), 2, '0')) AS code, round(s, 6) AS s, round(v, 6) AS v, round(l, 6) AS l FROM k")
def color_space(spark, d):
    p = K.hsv_l(F.col("r"), F.col("g"), F.col("b"))
    return colors(spark, d).select("p_partkey", K.hex_code(F.col("r"), F.col("g"), F.col("b")).alias("code"), *(F.round(p[c], 6).alias(c) for c in "svl"))


@query("C07_chromatic", COLORS + " SELECT p_partkey FROM k WHERE round(s, 9) >= 0.6 AND round(v, 9) >= 0.5 AND round(l, 9) <= 0.7")
def chromatic(spark, d):
    p = {k: F.round(c, 9) for k, c in K.hsv_l(F.col("r"), F.col("g"), F.col("b")).items()}
    return colors(spark, d).filter(K.chromatic(p)).select("p_partkey")


@query("H06_hue_order", COLORS + ", h AS (SELECT *, CASE WHEN s < 0.15 THEN 1 ELSE 0 END AS gray, greatest(r, g, b) AS m, greatest(r, g, b) - least(r, g, b) AS span FROM k), u AS (SELECT *, CASE WHEN span = 0 THEN 0::DOUBLE WHEN m = r THEN (CASE WHEN g >= b THEN 0 ELSE 6 END + (g - b) / CAST(span AS DOUBLE)) WHEN m = g THEN (b - r) / CAST(span AS DOUBLE) + 2 ELSE (r - g) / CAST(span AS DOUBLE) + 4 END / 6 AS hue FROM h) SELECT p_partkey, CAST(row_number() OVER (ORDER BY gray, round(hue, 9), p_partkey) AS INTEGER) AS place FROM u")
def hue_order(spark, d):
    p = K.hsv_l(F.col("r"), F.col("g"), F.col("b"))
    c = colors(spark, d).select("p_partkey", (p["s"] < 0.15).cast("int").alias("gray"), F.round(p["h"], 9).alias("hue"))
    laid = placed(c, [F.col("gray").asc(), F.col("hue").asc(), F.col("p_partkey").asc()], "place")
    return laid.select("p_partkey", (F.col("place") + 1).cast("int").alias("place"))


@query("J26_date_sequence", "SELECT strftime(d, '%B') || ' ' || day(d) AS label, CAST(row_number() OVER (ORDER BY d) AS INTEGER) AS place FROM (SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-12-31', INTERVAL 1 DAY)) AS DATE) AS d)")
def dates(spark, d):
    s = spark.range(1).select(F.posexplode(F.expr("sequence(date'2024-01-01', date'2024-12-31')")).alias("p", "day"))
    return s.select(F.date_format("day", "MMMM d").alias("label"), (F.col("p") + 1).alias("place"))


@query("J27_json_round_trip", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_round_trip(spark, d):
    e = V.table(spark, d, "events").select("event_id", F.from_json("props", "k long").alias("p"))
    return e.select("event_id", F.from_json(F.to_json("p"), "k long").alias("p")).select("event_id", "p.k")


@query("J28_path_parts", "SELECT doc_id, lang AS config, source AS split FROM documents")
def path_parts(spark, d):
    p = F.concat(F.lit("data/config="), "lang", F.lit("/split="), "source", F.lit("/shard-000001"))
    return docs(spark, d).select("doc_id", F.regexp_extract(p, "config=([^/]+)", 1).alias("config"), F.regexp_extract(p, "split=([^/]+)", 1).alias("split"))


@query("J32_gather", "SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS largest FROM embeddings")
def gather(spark, d):
    order = F.array_sort(F.transform("embedding", lambda x, i: F.struct((-x).alias("x"), i.alias("i"))))
    return V.table(spark, d, "embeddings").select("vec_id", F.get(order, F.lit(0))["i"].alias("largest"))


@query("J35_longest_prefix", "SELECT doc_id, CASE WHEN starts_with(source, 'src1') THEN replace(source, 'src1', '/b/') ELSE replace(source, 'src', '/a/') END AS y FROM documents")
def longest_prefix(spark, d):
    table = [("src1", "/b/"), ("src", "/a/")]  # longest first
    y = F.col("source")
    for old, new in reversed(table):
        y = F.when(F.col("source").startswith(old), F.concat(F.lit(new), F.substr("source", F.lit(len(old) + 1)))).otherwise(y)
    return docs(spark, d).select("doc_id", y.alias("y"))


@query("C08_predicates", "SELECT doc_id FROM documents WHERE lang = 'en' AND source = 'src3' AND n_chars > 100")
def predicates(spark, d):
    return V.table(spark, d, "documents").filter("lang = 'en' and source = 'src3' and n_chars > 100").select("doc_id")


@query("C04_validity", "SELECT vec_id FROM embeddings WHERE label BETWEEN 0 AND 8 AND embedding[1] >= 0.1::FLOAT AND isfinite(embedding[1])")
def validity(spark, d):
    x = F.get("embedding", F.lit(0))
    return V.table(spark, d, "embeddings").filter(F.col("label").between(0, 8) & ~F.isnan(x) & (F.abs(x) != float("inf")) & (x >= F.lit(0.1).cast("float"))).select("vec_id")


@query("J29_floor_float32", "SELECT l_orderkey, l_linenumber, CASE WHEN CAST(CAST(l_extendedprice / 7 AS FLOAT) AS DOUBLE) > l_extendedprice / 7 THEN nextafter(CAST(l_extendedprice / 7 AS FLOAT), '-infinity'::FLOAT) ELSE CAST(l_extendedprice / 7 AS FLOAT) END::DOUBLE AS y FROM lineitem")
def floor_float32(spark, d):
    return V.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", T.floor_float32(F.col("l_extendedprice") / 7).cast("double").alias("y"))


@query("C14_text_columns", "SELECT item_id AS id, 'text' AS column_name, text FROM benchmark")
def text_columns(spark, d):
    b = V.table(spark, d, "benchmark")
    chosen = [c for c in ("text", "sentence", "query", "document", "title") if c in b.columns]
    return b.select(F.col("item_id").alias("id"), F.inline(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("text")) for c in chosen))))


@query("C15_metadata_columns", "SELECT doc_id, lang, source FROM documents")
def metadata_columns(spark, d):
    df = V.table(spark, d, "documents")
    return df.select(*(c for c in df.columns if c not in ("text", "n_chars")))
