"""The engine's relations over the tables at hand, in Spark and (as WITH parts) in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnloom.functions import signals as S

#: Grid points a second, lag, shortest turn and time bucket for relations whose clock runs over days.
HZ, MAX_LAG_S, MIN_TURN_S, BUCKET_S = 1 / 3600, 3 * 3600.0, 4 * 3 * 3600.0, 259200.0
BLOCK_S, BLOCKS = 259200, 10
EPOCH_US = 1704067200000000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file, idx, role, speaker, text, start, end: blanks and runs of one speaker are put in by turn number."""
    c = read(spark, sf_dir, "conversations")
    before = F.coalesce(F.sum(F.length("text")).over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    role = F.when(F.col("role") == "user", "client").when(F.col("role") == "assistant", "therapist").otherwise("other")
    return c.select(
        F.col("conv_id").alias("file"), F.col("turn").alias("idx"), role.alias("role"), F.when(F.col("turn") % 3 < 2, " Client").otherwise("THERAPIST").alias("speaker"),
        F.when(F.col("turn") % 5 == 3, "  ").otherwise(F.col("text")).alias("text"), (before * 60).alias("start"), (before * 60 + F.length("text") * 60).alias("end"),
    )


RAW_TURNS = """raw_turns AS (
  SELECT conv_id AS file, turn AS idx,
         CASE role WHEN 'user' THEN 'client' WHEN 'assistant' THEN 'therapist' ELSE 'other' END AS role,
         CASE WHEN turn % 3 < 2 THEN ' Client' ELSE 'THERAPIST' END AS speaker,
         CASE WHEN turn % 5 = 3 THEN '  ' ELSE text END AS text,
         CAST(60 * coalesce(sum(length(text)) OVER w, 0) AS BIGINT) AS start,
         CAST(60 * coalesce(sum(length(text)) OVER w, 0) + 60 * length(text) AS BIGINT) AS "end"
  FROM conversations
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
)"""


def _seconds(ts: Column) -> Column:
    return (F.unix_micros(ts.cast("timestamp")) - EPOCH_US) / 1e6


def raw_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dyad, side, ts and four units; some units are missing."""
    e = read(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    return e.select(
        F.floor(F.col("user_id") / 2).alias("dyad"), (F.col("user_id") % 2).cast("int").alias("side"), _seconds(F.col("ts")).alias("ts"),
        F.when(F.col("event_id") % 17 != 0, F.col("value") / 100).alias("au06_r"), F.when(F.col("event_id") % 13 != 0, k / 20).alias("au12_r"),
        F.when(F.col("event_id") % 17 != 0, F.when(F.col("value") >= 60, 1.0).otherwise(0.0)).alias("au06_c"),
        F.when(F.col("event_id") % 13 != 0, F.when(k >= 25, 1.0).otherwise(0.0)).alias("au12_c"),
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_frames(spark, sf_dir)
    return raw.select(
        "dyad", "side", "ts", S.smile_intensity(F.col("au06_r"), F.col("au12_r")).alias("intensity"), S.smile_presence(F.col("au06_c"), F.col("au12_c")).alias("presence")
    )


FRAMES = """raw_frames AS (
  SELECT user_id // 2 AS dyad, CAST(user_id % 2 AS INTEGER) AS side, (epoch_us(ts) - 1704067200000000) / 1e6 AS ts,
         CASE WHEN event_id % 17 <> 0 THEN value / 100 END AS au06_r,
         CASE WHEN event_id % 13 <> 0 THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) / 20 END AS au12_r,
         CASE WHEN event_id % 17 <> 0 THEN CASE WHEN value >= 60 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS au06_c,
         CASE WHEN event_id % 13 <> 0 THEN CASE WHEN CAST(json_extract_string(props, '$.k') AS DOUBLE) >= 25 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS au12_c
  FROM events
), frames AS (
  SELECT dyad, side, ts, coalesce((au06_r + au12_r) / 2, au06_r, au12_r) AS intensity,
         CASE WHEN au06_c IS NOT NULL AND au12_c IS NOT NULL
              THEN CASE WHEN au06_c >= 0.5 AND au12_c >= 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS presence
  FROM raw_frames
)"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dyad, interviewer, turn_index, sentiment, start_s, end_s: one turn for each block of three days."""
    dyads = read(spark, sf_dir, "events").select(F.floor(F.col("user_id") / 2).alias("dyad")).distinct()
    b = F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("turn_index")
    each = dyads.select("dyad", b)
    label = F.element_at(F.array(*map(F.lit, ("positive", "neutral", "negative"))), ((F.col("dyad") * 7 + F.col("turn_index")) % 3 + 1).cast("int"))
    at = F.col("turn_index").cast("double") * BLOCK_S
    return each.select("dyad", (F.col("dyad") % 10).alias("interviewer"), "turn_index", label.alias("sentiment"), at.alias("start_s"), (at + BLOCK_S).alias("end_s"))


TURNS = """turns AS (
  SELECT dyad, dyad % 10 AS interviewer, turn_index,
         CASE (dyad * 7 + turn_index) % 3 WHEN 0 THEN 'positive' WHEN 1 THEN 'neutral' ELSE 'negative' END AS sentiment,
         CAST(turn_index AS DOUBLE) * 259200 AS start_s, CAST(turn_index AS DOUBLE) * 259200 + 259200 AS end_s
  FROM (SELECT DISTINCT user_id // 2 AS dyad FROM events), (SELECT CAST(range AS INTEGER) AS turn_index FROM range(10))
)"""

GRID = """ends AS (
  SELECT dyad, greatest(min(ts) FILTER (side = 0), min(ts) FILTER (side = 1)) AS t0,
         least(max(ts) FILTER (side = 0), max(ts) FILTER (side = 1)) AS t1,
         count(*) FILTER (side = 0) AS n0, count(*) FILTER (side = 1) AS n1
  FROM frames GROUP BY dyad
), spans AS (
  SELECT dyad, t0, CAST(floor((t1 - t0) * (1.0::DOUBLE / 3600.0::DOUBLE) + 1e-9::DOUBLE) AS BIGINT) AS last FROM ends WHERE n0 > 0 AND n1 > 0
), grid AS (
  SELECT dyad, i, t0 + i / (1.0::DOUBLE / 3600.0::DOUBLE) AS t FROM (SELECT dyad, t0, unnest(range(last + 1)) AS i FROM spans WHERE last >= 2)
)"""

NEAREST = """sides AS (SELECT unnest([0, 1])::INTEGER AS side), points AS (SELECT g.dyad, s.side, g.i, g.t FROM grid g, sides s), na AS (
  SELECT p.dyad, p.side, p.i, p.t, a.ts AS prev_t, a.presence AS av FROM points p ASOF LEFT JOIN frames a ON p.dyad = a.dyad AND p.side = a.side AND p.t >= a.ts
), nb AS (
  SELECT p.*, b.ts AS bt, b.presence AS bv FROM na p ASOF LEFT JOIN frames b ON p.dyad = b.dyad AND p.side = b.side AND p.t <= b.ts
), nearest AS (
  SELECT dyad, side, i, t, CASE WHEN bt IS NULL OR (prev_t IS NOT NULL AND t - prev_t <= bt - t) THEN av ELSE bv END AS v FROM nb
)"""

LINEAR = """lsides AS (SELECT unnest([0, 1])::INTEGER AS side), lpoints AS (SELECT g.dyad, s.side, g.i, g.t FROM grid g, lsides s),
known AS (SELECT * FROM frames WHERE intensity IS NOT NULL), la AS (
  SELECT p.dyad, p.side, p.i, p.t, a.ts AS prev_t, a.intensity AS av FROM lpoints p ASOF LEFT JOIN known a ON p.dyad = a.dyad AND p.side = a.side AND p.t >= a.ts
), lb AS (
  SELECT p.*, b.ts AS bt, b.intensity AS bv FROM la p ASOF LEFT JOIN known b ON p.dyad = b.dyad AND p.side = b.side AND p.t <= b.ts
), linear AS (
  SELECT dyad, side, i, t, CASE WHEN prev_t IS NULL THEN bv WHEN bt IS NULL OR bt <= prev_t THEN av
                                ELSE av + (bv - av) * ((t - prev_t) / (bt - prev_t)) END AS v FROM lb
)"""


def stats_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sentiment, participant_id, interviewer_id, y, k, n and a total order (ordinal columns) for the statistics."""
    x = read(spark, sf_dir, "lineitem")
    label = F.when(F.col("l_returnflag") == "A", "positive").when(F.col("l_returnflag") == "N", "neutral").otherwise("negative")
    return x.select(
        label.alias("sentiment"), F.col("l_suppkey").alias("participant_id"), (F.col("l_suppkey") % 8).alias("interviewer_id"), F.col("l_discount").alias("y"),
        (F.col("l_quantity") % 10).cast("int").alias("k"), F.col("l_quantity").cast("int").alias("n"), "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_tax", "l_shipdate",
    )


STATS = """stats AS (
  SELECT CASE l_returnflag WHEN 'A' THEN 'positive' WHEN 'N' THEN 'neutral' ELSE 'negative' END AS sentiment,
         l_suppkey AS participant_id, l_suppkey % 8 AS interviewer_id, l_discount AS y,
         CAST(trunc(l_quantity % 10) AS INTEGER) AS k, CAST(trunc(l_quantity) AS INTEGER) AS n,
         l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_tax, l_shipdate
  FROM lineitem
)"""


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interviews from orders: some without bindung, some with an empty one, some without transcript."""
    o = read(spark, sf_dir, "orders")
    code = F.concat(F.lit(" p"), F.col("o_custkey").cast("string"))
    return o.select(
        F.col("o_orderkey").alias("interview"), code.alias("patient_id"), (F.col("o_orderkey") % 5 != 0).alias("names_bindung"),
        (F.col("o_orderkey") % 10 > 0).alias("has_bindung"), F.when(F.col("o_orderkey") % 7 != 0, F.concat(F.lit("t"), F.col("o_orderkey").cast("string"))).alias("transcript"),
    ).withColumn("has_bindung", F.col("names_bindung") & F.col("has_bindung"))


CATALOG = """catalog AS (
  SELECT o_orderkey AS interview, ' p' || CAST(o_custkey AS VARCHAR) AS patient_id, o_orderkey % 5 <> 0 AS names_bindung,
         o_orderkey % 5 <> 0 AND o_orderkey % 10 > 0 AS has_bindung,
         CASE WHEN o_orderkey % 7 <> 0 THEN 't' || CAST(o_orderkey AS VARCHAR) END AS transcript
  FROM orders
)"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path and code of labelled files, one or two for a customer; every fourth customer's code is in no catalog."""
    c = read(spark, sf_dir, "customer")
    code = F.concat(F.when(F.col("c_custkey") % 4 == 0, "x").otherwise("p"), F.col("c_custkey").cast("string"))
    name = F.concat(F.lit("translate_"), code, F.lit("_"), F.col("v").cast("string"), F.lit("_bindung_sentiment.json"))
    twice = c.withColumn("v", F.explode(F.sequence(F.lit(0).cast("long"), F.col("c_custkey") % 2)))
    return twice.select(name.alias("path"), F.upper(code).alias("code"))


FILES = """files AS (
  SELECT 'translate_' || c || '_' || CAST(v AS VARCHAR) || '_bindung_sentiment.json' AS path, upper(c) AS code
  FROM (SELECT CASE WHEN c_custkey % 4 = 0 THEN 'x' ELSE 'p' END || CAST(c_custkey AS VARCHAR) AS c, unnest(range(c_custkey % 2 + 1)) AS v FROM customer)
), idx AS (SELECT code, min(path) AS path FROM files GROUP BY code)"""


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file, speaker, start_s, dur_s, role: speech segments from events; three speakers a file."""
    e = read(spark, sf_dir, "events")
    who = F.concat(F.lit("SPEAKER_0"), (F.col("user_id") % 3).cast("string"))
    return e.select(
        F.floor(F.col("user_id") / 6).alias("file"), who.alias("speaker"), (_seconds(F.col("ts")) / 600).alias("start_s"), (F.col("value") / 100).alias("dur_s"),
        F.when(F.col("user_id") % 3 == 0, "client").when(F.col("user_id") % 3 == 1, "therapist").otherwise("other").alias("role"), "event_id",
    )


SEGMENTS = """segments AS (
  SELECT user_id // 6 AS file, 'SPEAKER_0' || CAST(user_id % 3 AS VARCHAR) AS speaker,
         (epoch_us(ts) - 1704067200000000) / 1e6 / 600 AS start_s, value / 100 AS dur_s,
         CASE user_id % 3 WHEN 0 THEN 'client' WHEN 1 THEN 'therapist' ELSE 'other' END AS role, event_id
  FROM events
)"""
