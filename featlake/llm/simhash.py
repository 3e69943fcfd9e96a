"""Document fingerprints by SimHash, in DataFrame operations only.

Terms are runs of TERM words; each occurrence votes on the 64 bits of its hash, set bits for and clear bits against,
with a weight that grows with the length of its first word. A document's votes are counted 32 bits at a time: a sum
of longs holds two counters of 32 bits each, so 32 sums give all 64 and partial aggregation leaves one row a document
and task. Permuted block tables find fingerprints within a radius: of radius + 1 + SPARE blocks at least 1 + SPARE are
equal in two fingerprints that close, so the tables are keyed by the combinations of 1 + SPARE blocks and every
meeting is verified on all 64 bits, under the first table that the two share.

The ring of documents is made of keys (id and hash of the text), sorted by range partitions whose ends are joined.
Each text then moves once, and the part of it that its predecessor needs once more.

Defined cases: null text counts as empty; a text without words has fingerprint zero; rows that repeat a doc_id stand
one after the other in the ring, ordered by a hash of their texts (equal rows side by side); null ids come after all
others; a single row is its own next document; an empty table gives an empty result; further columns do not matter.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featlake.llm.common import SPACES, stage, text_files

TERM = 3
MOST_WEIGHT = 8
RADIUS, SPARE = 3, 1
#: Rows whose doc_id is divisible by EVERY ask the block tables; tables' keys are split in SALTS.
EVERY, SALTS = 100, 8


def _terms(text: Column) -> Column:
    """(h, w) of each term of a text: hash and weight."""
    words = F.filter(F.split(F.lower(text), SPACES, -1), lambda w: w != "")
    # the outer lambda binds the words, so that they are split once and not for each term
    of = lambda ws: F.transform(
        ws,
        lambda w, i: F.struct(
            F.xxhash64(w, *(F.get(ws, i + k) for k in range(1, TERM))).alias("h"),
            F.least(F.length(w), F.lit(MOST_WEIGHT)).cast("long").alias("w"),
        ),
    )
    return F.get(F.transform(F.array(words), of), F.lit(0))


def _bits(total: Column) -> Column:
    """The fingerprint from the sums s0 to s31 and the total weight."""
    fp = F.lit(0).cast("long")
    for j in range(32):
        s = F.col(f"s{j}")
        low, high = s.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(s, 32)
        for bit, votes in ((j, low), (j + 32, high)):
            one = (1 << bit) - (1 << 64 if bit == 63 else 0)
            fp = fp.bitwiseOR(F.when(votes * 2 > total, F.lit(one)).otherwise(F.lit(0)).cast("long"))
    return fp


def fingerprints(rows: DataFrame, key: list[str], text: str) -> DataFrame:
    """The key columns and fp (a long) of each row; the key must tell rows apart."""
    terms = rows.select(*key, F.inline_outer(_terms(F.coalesce(F.col(text), F.lit("")))))
    mask = F.lit((1 << 32) + 1)
    sums = [F.sum(F.shiftrightunsigned("h", j).bitwiseAND(mask) * F.col("w")).alias(f"s{j}") for j in range(32)]
    votes = terms.groupBy(*key).agg(F.sum("w").alias("total"), *sums)
    return votes.select(*key, F.when(F.col("total").isNull(), F.lit(0)).otherwise(_bits(F.col("total"))).cast("long").alias("fp"))


def hex16(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def likeness(a: str, b: str) -> Column:
    """Share of equal bits."""
    return (F.lit(64) - F.bit_count(F.col(a).bitwiseXOR(F.col(b)))) / F.lit(64.0)


def ring(keys: DataFrame, files: int | None = None) -> DataFrame:
    """The rows of keys (doc_id, th, key, n and others, one row a document) with key and n of the one before, and the key of the next.

    The next is that of the next smaller doc_id, after the last the first. No task sorts more than a range partition,
    but for the list of partitions.
    """
    order = [F.col("doc_id").desc_nulls_last(), F.col("th").asc()]
    parts = stage(keys.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ring", files)
    one = F.struct("key", "n")
    w = Window.partitionBy("part").orderBy(*order)
    near = parts.withColumn("before", F.lag(one).over(w))
    # one row for each partition
    place = F.struct(F.col("doc_id").isNull(), -F.col("doc_id").cast("decimal(20,0)"), "th")
    ends = parts.groupBy("part").agg(F.max_by(one, place).alias("last"))
    line = Window.orderBy("part")
    whole = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select(F.col("part").alias("p"), F.coalesce(F.lag("last").over(line), F.last("last").over(whole)).alias("from"))
    near = near.join(F.broadcast(ends), F.col("part") == F.col("p"))
    return near.withColumn("before", F.coalesce("before", "from")).drop("part", "p", "from")


def _half(n: Column) -> Column:
    return F.floor(n / 2).cast("int")


def edited_pairs(documents: DataFrame, every: int = EVERY) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness (the columns of the contract).

    n_within: for rows whose doc_id is divisible by `every`, the number of all rows whose fingerprint is within RADIUS
    bits of theirs, found by the block tables, themselves included; null for others.
    """
    d = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    # rows equal in id and text are one class; all that follows is dealt by this one column
    d = d.withColumn("key", F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.hex("th")))
    keys = d.groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.first("th").alias("th"), F.count("*").alias("copies"), F.max(F.length("text")).alias("n"))
    files = text_files(documents)
    keys = stage(ring(keys, files).select("key", "doc_id", "copies", "n", "before"), "ring", files)
    texts = d.groupBy("key").agg(F.first("text").alias("text"))
    both = texts.join(keys, "key")
    heads = both.select(F.col("before.key").alias("of"), F.substring("text", 1, _half(F.col("before.n"))).alias("head"))
    r = both.join(heads, F.col("key") == F.col("of"))
    half = _half(F.col("n"))
    start = F.substring("text", 1, F.col("n") - half)
    own = F.concat(start, F.substring("text", 1, half))  # of all copies but the last: the next is equal
    kinds = F.array(*(F.struct(F.lit(e).alias("e"), t.alias("t")) for e, t in enumerate((F.col("text"), F.concat(start, "head"), own))))
    r = r.select("key", F.explode(F.when(F.col("copies") > 1, kinds).otherwise(F.slice(kinds, 1, 2))).alias("x"))
    rows = r.select("key", "x.e", F.unhex(F.sha2(F.col("x.t").cast("binary"), 256)).alias("sha"), F.col("x.t").alias("t"))
    fps = fingerprints(rows, ["key", "e", "sha"], "t")
    at = lambda e, c: F.max(F.when(F.col("e") == e, F.col(c)))
    fps = stage(fps.groupBy("key").agg(at(0, "fp").alias("fp"), *(at(e, c).alias(f"{c}{e}") for e in (1, 2) for c in ("fp", "sha"))), "fingerprints", files)
    facts = fps.join(keys, "key")
    small = stage(fps.select("key", "fp").join(keys.select("key", "doc_id", "copies", F.col("before.key").alias("of")), "key"), "small", files)
    asked = small.filter(F.col("doc_id") % every == 0)
    within = asked.join(count_within(asked, small, "copies"), F.col("query") == F.col("fp")).select(F.col("key").alias("asked"), "n_within")
    out = facts.join(small.select("of", F.col("fp").alias("nfp")), F.col("key") == F.col("of")).join(within, F.col("key") == F.col("asked"), "left")
    last = F.struct(F.lit(1).cast("long").alias("times"), F.col("sha1").alias("sha"), F.col("fp1").alias("efp"), F.col("nfp").alias("nfp"))
    others = F.struct((F.col("copies") - 1).alias("times"), F.col("sha2").alias("sha"), F.col("fp2").alias("efp"), F.col("fp").alias("nfp"))
    out = out.select("doc_id", "n", "fp", "n_within", F.inline(F.when(F.col("copies") > 1, F.array(last, others)).otherwise(F.array(last))))
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    return out.select(
        "doc_id",
        F.col("n").cast("long").alias("n_chars"),
        F.lower(F.hex("sha")).alias("edited_sha256"),
        hex16("fp").alias("fingerprint"),
        hex16("efp").alias("edited_fingerprint"),
        likeness("fp", "efp").alias("near_edited"),
        likeness("fp", "nfp").alias("near_next"),
        "n_within",
    )


def _blocks(n: int) -> list[tuple[int, int]]:
    """n blocks of the 64 bits, as (start, width), as even as can be."""
    cut = [round(64 * i / n) for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cut, cut[1:], strict=False)]


def tables(fps: DataFrame, radius: int = RADIUS, spare: int = SPARE) -> DataFrame:
    """The columns of fps (fp among them) with t and v: its key in every permuted block table t."""
    blocks = _blocks(radius + 1 + spare)
    keys = []
    for t, chosen in enumerate(combinations(blocks, 1 + spare)):
        keys.append(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(_mask(chosen)).alias("v")))
    return fps.select(*fps.columns, F.inline(F.array(*keys)))


def _mask(blocks) -> Column:
    m = sum(((1 << w) - 1) << a for a, w in blocks)
    return F.lit(m - (1 << 64) if m >> 63 else m).cast("long")


def _first_table(radius: int, spare: int) -> Column:
    """Whether t is the first of the tables in which query and fp have equal keys: no block before its last is equal but its own."""
    blocks = _blocks(radius + 1 + spare)
    apart = F.col("query").bitwiseXOR(F.col("fp"))
    out = F.lit(True)
    for t, chosen in enumerate(combinations(range(len(blocks)), 1 + spare)):
        others = [k for k in range(chosen[-1]) if k not in chosen]
        if others:
            none = F.lit(True)
            for k in others:
                none = none & (apart.bitwiseAND(_mask([blocks[k]])) != 0)
            out = F.when(F.col("t") == t, none).otherwise(out)
    return out


def _met(q: DataFrame, x: DataFrame, radius: int, spare: int) -> DataFrame:
    """Pairs of a query and a row of x within the radius, each under its first table; x's keys are split in SALTS."""
    some = tables(x, radius, spare)
    some = some.withColumn("at", F.xxhash64("t", "v", F.pmod(F.xxhash64("fp"), F.lit(SALTS)))).drop("v")
    asked = tables(q, radius, spare).withColumnRenamed("fp", "query").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    asked = asked.select("query", F.xxhash64("t", "v", "salt").alias("at"))
    near = F.bit_count(F.col("query").bitwiseXOR(F.col("fp"))) <= radius
    # rows of the queries compress so well that their size in a shuffle says nothing of a broadcast
    joined = asked.hint("merge").join(some, (asked["at"] == some["at"]) & near & _first_table(radius, spare))
    return joined.select("query", *x.columns)


def within_radius(queries: DataFrame, fps: DataFrame, radius: int = RADIUS, spare: int = SPARE) -> DataFrame:
    """(query, fp, distance): for each distinct fingerprint of queries the distinct ones of fps within radius bits.

    Equal fingerprints are one class on either side: members of a class are found by their fingerprint, not paired.
    """
    met = _met(queries.select("fp").distinct(), fps.select("fp").distinct(), radius, spare)
    return met.select("query", "fp", F.bit_count(F.col("query").bitwiseXOR(F.col("fp"))).cast("int").alias("distance"))


def count_within(queries: DataFrame, fps: DataFrame, weight: str, radius: int = RADIUS, spare: int = SPARE) -> DataFrame:
    """(query, n_within): for each distinct fingerprint of queries the sum of weight over the rows of fps within radius bits."""
    members = fps.groupBy("fp").agg(F.sum(weight).cast("long").alias("m"))
    return _met(queries.select("fp").distinct(), members, radius, spare).groupBy("query").agg(F.sum("m").alias("n_within"))
