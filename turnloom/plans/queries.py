"""Named queries over the driver's tables, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.functions import signals as S
from turnloom.functions import text as T
from turnloom.operators import bootstrap, dyad, effects, jobs, turns
from turnloom.plans import adapters as A

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def with_(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + "\n"


def r9(name: str) -> Column:
    return F.round(name, 9).alias(name)


# --- texts and turns -----------------------------------------------------------------------------------

CANON = """CASE WHEN s IN ('client', 'patient', 'pr', 'p') OR contains(s, 'client') OR contains(s, 'patient') THEN 'client'
       WHEN s IN ('therapist', 'in', 'therapeut', 'therapeutin', 't') OR contains(s, 'therap') THEN 'therapist' ELSE 'other' END"""
NAMES = "['Patient_1', ' Therapeut ', 'in', 'PR', 't', 'Co-Therapist', 'client therapist', 'speaker 3', '', 'The rapist', 'p']"


@query(f"""SELECT event_id, raw, {CANON} AS speaker FROM (
  SELECT event_id, raw, replace(replace(replace(lower(trim(raw)), '_', ''), '-', ''), ' ', '') AS s
  FROM (SELECT event_id, {NAMES}[event_id % 11 + 1] AS raw FROM events))""")
def canonical_speaker(spark, sf_dir):
    names = F.array(*map(F.lit, ["Patient_1", " Therapeut ", "in", "PR", "t", "Co-Therapist", "client therapist", "speaker 3", "", "The rapist", "p"]))
    e = A.read(spark, sf_dir, "events").select("event_id", F.element_at(names, (F.col("event_id") % 11 + 1).cast("int")).alias("raw"))
    return e.select("event_id", "raw", T.canonical_speaker(F.col("raw")).alias("speaker"))


RAWS = ["Positive.", "not sure", "very negative!", "NEUTRAL\n", "other, positive", "", "Label: neutral2", "po sitive", "(negative)", "neutral/positive"]


@query("""SELECT event_id, coalesce(list_filter(regexp_split_to_array(regexp_replace(lower(raw), '[^a-z\\s]', ' ', 'g'), '\\s+'),
         lambda w: w IN ('positive', 'neutral', 'negative', 'other'))[1], 'other') AS label
FROM (SELECT event_id, event_type || ' ' || %s[event_id %% 10 + 1] AS raw FROM events)""" % str(RAWS).replace("'NEUTRAL\\n'", "'NEUTRAL' || chr(10)"))
def parse_sentiment(spark, sf_dir):
    raws = F.array(*map(F.lit, RAWS))
    raw = F.concat("event_type", F.lit(" "), F.element_at(raws, (F.col("event_id") % 10 + 1).cast("int")))
    return A.read(spark, sf_dir, "events").select("event_id", T.parse_sentiment(raw).alias("label"))


@query(with_(A.FILES) + "SELECT path, nullif(upper(regexp_extract(path, '^translate_([A-Za-z0-9]+)', 1)), '') AS code FROM files")
def patient_code(spark, sf_dir):
    return A.files(spark, sf_dir).select("path", T.patient_code(F.col("path")).alias("code"))


MS = ["12", " 7 ", "12.5", "-3", "", "abc", "--5", "1e3", "007"]


@query("""SELECT event_id, CASE WHEN regexp_matches(trim(raw), '^-?[0-9]+$') THEN CAST(trim(raw) AS BIGINT) ELSE event_id END AS ms
FROM (SELECT event_id, %s[event_id %% 9 + 1] AS raw FROM events)""" % MS)
def coerce_ms(spark, sf_dir):
    raw = F.element_at(F.array(*map(F.lit, MS)), (F.col("event_id") % 9 + 1).cast("int"))
    return A.read(spark, sf_dir, "events").select("event_id", T.coerce_ms(raw, F.col("event_id")).alias("ms"))


JSON_MS = ["12", "1.9", "-1.9", "true", "false", "null", '" 7 "', '"12.5"', '"x"', "[1]", "2.5e3"]


@query("""SELECT event_id, CASE WHEN k IN ('UBIGINT', 'BIGINT') THEN CAST(raw AS BIGINT) WHEN k = 'DOUBLE' THEN CAST(trunc(CAST(raw AS DOUBLE)) AS BIGINT)
  WHEN k = 'BOOLEAN' THEN CAST(CAST(raw AS BOOLEAN) AS BIGINT) WHEN k = 'VARCHAR' AND regexp_matches(trim(t), '^-?[0-9]+$') THEN CAST(trim(t) AS BIGINT) ELSE event_id END AS ms
FROM (SELECT event_id, raw, json_type(raw::JSON) AS k, json_extract_string(raw::JSON, '$') AS t FROM (SELECT event_id, %s[event_id %% 11 + 1] AS raw FROM events))""" % JSON_MS)
def coerce_json_ms(spark, sf_dir):
    raw = F.element_at(F.array(*map(F.lit, JSON_MS)), (F.col("event_id") % 11 + 1).cast("int"))
    return A.read(spark, sf_dir, "events").select("event_id", T.coerce_json_ms(F.try_parse_json(raw), F.col("event_id")).alias("ms"))


@query("""SELECT event_id, greatest(a, 0) AS start_ms, greatest(coalesce(b, greatest(a, 0)), greatest(a, 0)) AS end_ms
FROM (SELECT event_id, user_id - 50 AS a, CASE WHEN event_id % 5 <> 0 THEN event_id % 100 - 20 END AS b FROM events)""")
def clamp_ms(spark, sf_dir):
    lo, hi = T.clamp_span(F.col("user_id") - 50, F.when(F.col("event_id") % 5 != 0, F.col("event_id") % 100 - 20))
    return A.read(spark, sf_dir, "events").select("event_id", lo.alias("start_ms"), hi.alias("end_ms"))


@query("SELECT doc_id, regexp_replace(source || ' ' || lang || chr(9) || '  x', '\\s+', '_', 'g') AS uri FROM documents")
def sanitize_uri(spark, sf_dir):
    d = A.read(spark, sf_dir, "documents")
    return d.select("doc_id", T.sanitize_uri(F.concat("source", F.lit(" "), "lang", F.lit("\t  x"))).alias("uri"))


@query("""SELECT line_no, parts[2] AS uri, CAST(parts[4] AS DOUBLE) AS start_s, CAST(parts[5] AS DOUBLE) AS dur_s, parts[8] AS speaker FROM (
  SELECT event_id AS line_no, regexp_split_to_array(CASE WHEN event_id % 4 = 0 THEN 'NOTE x' ELSE
    'SPEAKER ev' || CAST(user_id AS VARCHAR) || ' 1 ' || CAST(event_id AS VARCHAR) || '.5  ' || CAST(user_id AS VARCHAR) || '.25 <NA> <NA> S' || CAST(user_id % 2 AS VARCHAR) || ' <NA>' END, '\\s+') AS parts
  FROM events) WHERE parts[1] = 'SPEAKER'""")
def rttm_parse(spark, sf_dir):
    from turnloom.sources.readers import parse_rttm

    e = A.read(spark, sf_dir, "events")
    s = lambda c: F.col(c).cast("string")
    line = F.when(F.col("event_id") % 4 == 0, "NOTE x").otherwise(
        F.concat(F.lit("SPEAKER ev"), s("user_id"), F.lit(" 1 "), s("event_id"), F.lit(".5  "), s("user_id"), F.lit(".25 <NA> <NA> S"), (F.col("user_id") % 2).cast("string"), F.lit(" <NA>"))
    )
    return parse_rttm(e.select(F.col("event_id").alias("line_no"), line.alias("value")), ["line_no"])


@query(with_(A.SEGMENTS) + """SELECT event_id, file, start_ms, end_ms FROM (
  SELECT *, CAST(trunc(start_s * 1000) AS BIGINT) AS start_ms, CAST(trunc((start_s + dur_s) * 1000) AS BIGINT) AS end_ms FROM segments)
WHERE end_ms - start_ms >= 1500 AND role <> 'therapist'""")
def segment_filter(spark, sf_dir):
    return turns.segment_filter(A.segments(spark, sf_dir), F.col("role")).select("event_id", "file", "start_ms", "end_ms")


@query(with_(A.SEGMENTS) + "SELECT event_id, file, row_number() OVER (PARTITION BY file ORDER BY start_s, dur_s, event_id) - 1 AS place FROM segments")
def segments_in_order(spark, sf_dir):
    s = A.segments(spark, sf_dir)
    ordered = turns.in_time_order(s.withColumn("dur_s", F.struct("dur_s", "event_id")))
    return ordered.select("event_id", "file", "place")


@query(with_(A.SEGMENTS, """marked AS (
  SELECT *, start_s + dur_s AS end_s, max(start_s + dur_s) OVER (PARTITION BY file, speaker ORDER BY start_s, dur_s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM segments
), covered AS (
  SELECT file, speaker, sum(greatest(end_s - greatest(start_s, coalesce(reached, start_s)), 0)) AS c FROM marked GROUP BY file, speaker
), ranked AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY round(c, 9) DESC, speaker) AS rk FROM covered),
nth AS (SELECT *, row_number() OVER (PARTITION BY file, rk = 1 ORDER BY speaker) AS nth FROM ranked)""") + """
SELECT file, speaker, round(c, 9) AS covered_s, CASE WHEN rk = 1 THEN 'client' WHEN nth = 1 THEN 'therapist' END AS role FROM nth""")
def speaker_roles(spark, sf_dir):
    return turns.speaker_roles(A.segments(spark, sf_dir)).select("file", "speaker", r9("covered_s"), "role")


@query(with_(A.RAW_TURNS) + """SELECT file, idx, part, text FROM (SELECT file, idx, unnest(range(len(w))) AS part, unnest(w) AS text FROM (
  SELECT file, idx, list_filter(string_split(text, '.'), lambda x: x <> '') AS w FROM raw_turns))""")
def asr_explode(spark, sf_dir):
    parts = F.filter(F.split("text", r"\."), lambda x: x != "")
    out = turns.asr_explode(A.raw_turns(spark, sf_dir), parts, ["file", "idx"])
    return out.select("file", "idx", F.col("part").cast("long").alias("part"), "text")


ISLANDS = with_(A.RAW_TURNS, """kept AS (
  SELECT file, idx, lower(trim(speaker)) AS speaker, trim(text) AS text, greatest(start, 0) AS start_ms, greatest("end", greatest(start, 0)) AS end_ms
  FROM raw_turns WHERE trim(text) <> ''
), marked AS (
  SELECT *, CASE WHEN speaker IS DISTINCT FROM lag(speaker) OVER (PARTITION BY file ORDER BY idx) THEN 1 ELSE 0 END AS change FROM kept
), runs AS (SELECT *, sum(change) OVER (PARTITION BY file ORDER BY idx) - 1 AS island FROM marked)""")


@query(ISLANDS + """SELECT file, CAST(island AS INTEGER) AS turn_index, speaker AS speaker_id, string_agg(text, ' ' ORDER BY idx) AS text,
  min_by(start_ms, idx) AS start_ms, max_by(end_ms, idx) AS end_ms, string_agg(CAST(idx AS VARCHAR), ',' ORDER BY idx) AS original_turn_indices
FROM runs GROUP BY file, island, speaker""")
def speaker_islands(spark, sf_dir):
    out = turns.speaker_islands(A.raw_turns(spark, sf_dir))
    return out.withColumn("original_turn_indices", F.array_join(F.transform("original_turn_indices", lambda x: x.cast("string")), ","))


@query(ISLANDS + """SELECT file, row_number() OVER (PARTITION BY file ORDER BY first_idx) - 1 AS turn_index, first_idx FROM (
  SELECT file, island, min(idx) AS first_idx FROM runs GROUP BY file, island)""")
def turn_index(spark, sf_dir):
    out = turns.speaker_islands(A.raw_turns(spark, sf_dir))
    return out.select("file", F.col("turn_index").cast("long").alias("turn_index"), F.col("original_turn_indices")[0].alias("first_idx"))


def _context_sql(frame: str) -> str:
    return with_(A.RAW_TURNS) + f"""SELECT file, idx, text, coalesce(array_to_string(ctx, '|'), '') AS context FROM (
  SELECT file, idx, speaker, text, list(text) OVER (PARTITION BY file ORDER BY idx ROWS BETWEEN {frame} PRECEDING AND 1 PRECEDING) AS ctx
  FROM (SELECT * REPLACE (trim(text) AS text) FROM raw_turns WHERE trim(text) <> '')) WHERE lower(trim(speaker)) = 'client'"""


@query(_context_sql("2"))
def context_window(spark, sf_dir):
    return turns.context_window(A.raw_turns(spark, sf_dir)).withColumn("context", F.array_join("context", "|"))


@query(_context_sql("UNBOUNDED"))
def context_window_zero(spark, sf_dir):
    return turns.context_window(A.raw_turns(spark, sf_dir), 0).withColumn("context", F.array_join("context", "|"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_PROMPT_HEAD = "\n".join([f"system: {T.SYSTEM_PROMPT}", *(x for a, b in T.FEW_SHOT for x in (f"user: Speech turn: {a}", f"assistant: {b}"))])


@query(with_(A.RAW_TURNS) + f"""SELECT file, idx, {_quoted(_PROMPT_HEAD)} || chr(10) || 'user: ' ||
  CASE WHEN len(ctx) > 0 THEN array_to_string(list_transform(ctx, lambda s, i: 'Previous snippet ' || CAST(i AS VARCHAR) || ': ' || s), chr(10)) || chr(10) || chr(10) ELSE '' END
  || 'Speech turn: ' || text || chr(10) AS prompt, CAST(18 AS INTEGER) AS n_messages FROM (
  SELECT file, idx, speaker, text, coalesce(list(text) OVER (PARTITION BY file ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), []) AS ctx
  FROM (SELECT * REPLACE (trim(text) AS text) FROM raw_turns WHERE trim(text) <> '')) WHERE lower(trim(speaker)) = 'client'""")
def build_prompt(spark, sf_dir):
    seen = turns.context_window(A.raw_turns(spark, sf_dir)).withColumn("m", T.build_prompt(F.col("text"), F.col("context")))
    flat = F.array_join(F.transform("m", lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")
    return seen.select("file", "idx", flat.alias("prompt"), F.size("m").alias("n_messages"))


WORDS = "list_filter(regexp_split_to_array(coalesce({}, ''), '[\\s\\x{{85}}\\p{{Z}}]+'), lambda w: w <> '')"


@query(f"SELECT doc_id, CAST(len({WORDS.format('text')}) AS INTEGER) AS n FROM documents")
def token_len(spark, sf_dir):
    return A.read(spark, sf_dir, "documents").select("doc_id", T.token_len(F.col("text")).alias("n"))


@query(f"""SELECT doc_id, CAST(i AS INTEGER) AS part, array_to_string(w[i * 24 + 1 : i * 24 + 24], ' ') AS chunk FROM (
  SELECT doc_id, w, unnest(range((len(w) + 23) // 24)) AS i FROM (SELECT doc_id, {WORDS.format('text')} AS w FROM documents))""")
def split_oversized(spark, sf_dir):
    d = A.read(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(T.split_oversized(F.col("text"), 24)).alias("part", "chunk"))


SPACES = "[\\s\\x{85}\\p{Z}]+"
CHUNKS = f"""WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '^{SPACES}|{SPACES}$', '', 'g') AS t FROM documents),
s AS (SELECT doc_id, t, list_filter(list_transform(string_split(regexp_replace(t, '([.!?]){SPACES}', '\\1' || chr(1), 'g'), chr(1)),
  lambda x: regexp_replace(x, '^{SPACES}|{SPACES}$', '', 'g')), lambda x: x <> '') AS ss FROM d),
p AS (SELECT doc_id, t, flatten(list_transform(ss, lambda x: CASE WHEN len({WORDS.format('x')}) > 192
  THEN list_transform(range((len({WORDS.format('x')}) + 191) // 192), lambda i: array_to_string(({WORDS.format('x')})[i * 192 + 1 : i * 192 + 192], ' ')) ELSE [x] END)) AS pp FROM s),
c AS (SELECT doc_id, CASE WHEN t = '' THEN [] WHEN len({WORDS.format('t')}) <= 192 THEN [t] ELSE string_split(list_reduce(pp, lambda a, x:
  CASE WHEN len({WORDS.format('string_split(a, chr(2))[-1]')}) + len({WORDS.format('x')}) > 192 THEN a || chr(2) || x ELSE a || ' ' || x END), chr(2)) END AS cc FROM p)
SELECT doc_id, CAST(unnest(range(len(cc))) AS INTEGER) AS part, unnest(cc) AS chunk FROM c"""


@query(CHUNKS)
def chunk_text(spark, sf_dir):
    d = A.read(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(T.chunk_text(F.col("text"), 192)).alias("part", "chunk"))


@query(with_(A.RAW_TURNS) + """SELECT file, role AS label, count(*) AS n FROM raw_turns WHERE role <> 'other' GROUP BY GROUPING SETS ((file, role), (role), ())""")
def label_summary(spark, sf_dir):
    labels = A.raw_turns(spark, sf_dir).select("file", F.when(F.col("role") != "other", F.col("role")).otherwise("").alias("label"))
    return turns.label_summary(labels)


@query(with_(A.RAW_TURNS) + """SELECT file, batch, count(*) AS n, max(place) + 1 AS done FROM (
  SELECT file, CAST(place // 2 AS INTEGER) AS batch, place FROM (
    SELECT file, row_number() OVER (PARTITION BY file ORDER BY idx) - 1 AS place FROM raw_turns WHERE trim(text) <> '' AND lower(trim(speaker)) = 'client')) GROUP BY file, batch""")
def progress_batches(spark, sf_dir):
    return turns.progress(A.raw_turns(spark, sf_dir), 2)


@query(with_(A.RAW_TURNS) + """SELECT file, count(*) AS turns, count(*) FILTER (lower(trim(speaker)) = 'client') AS client_turns,
  count(*) FILTER (lower(trim(speaker)) <> 'client') AS other_turns FROM raw_turns GROUP BY file""")
def turn_totals(spark, sf_dir):
    return turns.turn_totals(A.raw_turns(spark, sf_dir))


@query(with_(A.RAW_TURNS) + """SELECT file, idx, CASE WHEN lower(trim(speaker)) = 'client' AND trim(text) <> '' THEN
  CASE WHEN length(trim(text)) % 4 = 0 THEN 'positive' WHEN length(trim(text)) % 4 = 1 THEN 'neutral' WHEN length(trim(text)) % 4 = 2 THEN 'negative' ELSE 'other' END END AS sentiment_label
FROM raw_turns""")
def label_turns(spark, sf_dir):
    from turnloom.operators import inference

    raw = A.raw_turns(spark, sf_dir)
    return inference.label_turns(raw, inference.length_scorer).select("file", "idx", "sentiment_label")


# --- catalog ---------------------------------------------------------------------------------------------

STATUS = with_(A.CATALOG, A.FILES, """st AS (
  SELECT c.*, i.path, CASE WHEN transcript IS NULL THEN 'transcript_null' WHEN i.path IS NULL THEN 'missing_labeled' ELSE 'job' END AS status
  FROM catalog c LEFT JOIN idx i ON upper(trim(c.patient_id)) = i.code WHERE has_bindung)""")


@query(STATUS + "SELECT interview, patient_id, transcript, path FROM st WHERE status = 'job'")
def build_jobs(spark, sf_dir):
    return jobs.build_jobs(A.catalog(spark, sf_dir), jobs.labelled_index(A.files(spark, sf_dir))).select("interview", "patient_id", "transcript", "path")


@query(STATUS + "SELECT status, count(*) AS n FROM st GROUP BY status")
def job_status_counts(spark, sf_dir):
    return jobs.status_counts(A.catalog(spark, sf_dir), jobs.labelled_index(A.files(spark, sf_dir)))


@query(with_(A.CATALOG, A.FILES) + "SELECT DISTINCT code FROM idx WHERE code NOT IN (SELECT upper(trim(patient_id)) FROM catalog WHERE has_bindung)")
def orphan_anti(spark, sf_dir):
    return jobs.orphaned(jobs.labelled_index(A.files(spark, sf_dir)), A.catalog(spark, sf_dir))


@query(with_(A.CATALOG, A.FILES) + "SELECT code, path FROM files WHERE code IN (SELECT upper(trim(patient_id)) FROM catalog WHERE names_bindung)")
def strict_semi(spark, sf_dir):
    return jobs.strict_match(A.files(spark, sf_dir), A.catalog(spark, sf_dir)).select("code", "path")


@query(with_(A.FILES) + "SELECT path, code FROM files WHERE path NOT IN (SELECT path FROM files WHERE length(path) % 2 = 0)")
def resume_anti(spark, sf_dir):
    f = A.files(spark, sf_dir)
    return jobs.resume(f, f.where(F.length("path") % 2 == 0), "path").select("path", "code")


@query(with_(A.FILES) + "SELECT path, code FROM files ORDER BY path LIMIT 25")
def max_files(spark, sf_dir):
    return jobs.first_files(A.files(spark, sf_dir), 25)


@query("""SELECT job, reason IS NULL AS ok, reason FROM (SELECT o_orderkey AS job, CASE
  WHEN o_orderkey % 11 = 0 OR o_orderkey % 13 = 0 OR o_orderkey % 17 = 0 THEN 'missing_paths'
  WHEN c.n IS NULL OR o_orderkey % 5 = 0 THEN 'empty_openface' WHEN o_orderkey % 3 = 0 THEN 'no_labeled_turns' END AS reason
  FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) c ON o_orderkey = l_orderkey)""")
def load_status(spark, sf_dir):
    o = A.read(spark, sf_dir, "orders")
    path = lambda k, n: F.when(F.col("o_orderkey") % k != 0, F.lit("x")).alias(n)
    j = o.select(F.col("o_orderkey").alias("job"), path(11, "patient_path"), path(13, "therapist_path"), path(17, "labelled_path"))
    n = A.read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("job")).agg(F.count("*").alias("patient_frames"))
    n = n.withColumn("therapist_frames", F.when(F.col("job") % 5 == 0, 0).otherwise(1))
    return jobs.load_status(j, n, o.select(F.col("o_orderkey").alias("job"), (F.col("o_orderkey") % 3).alias("turns")))


@query("""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 11 = 0 THEN 'missing_paths' WHEN o_orderkey % 13 = 0 THEN 'exception:ValueError:bad'
  WHEN o_orderkey % 5 = 0 THEN 'empty_openface' WHEN o_orderkey % 7 = 0 THEN 'no_labeled_turns' END AS reason FROM orders) WHERE reason IS NOT NULL GROUP BY reason""")
def failure_histogram(spark, sf_dir):
    o = A.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job"))
    path = F.when(F.col("job") % 11 != 0, "x")
    listed = o.select("job", path.alias("patient_path"), path.alias("therapist_path"), path.alias("labelled_path"))
    counts = o.select("job", F.when(F.col("job") % 5 != 0, 3).alias("patient_frames"), F.lit(3).alias("therapist_frames"))
    errors = o.where("job % 13 = 0").select("job", F.lit("ValueError").alias("kind"), F.lit("bad").alias("message"))
    return jobs.failure_histogram(jobs.load_status(listed, counts, o.select("job", F.when(F.col("job") % 7 != 0, 2).alias("turns")), errors))


@query(with_(A.CATALOG, A.FILES) + """SELECT count(*) AS found, count(*) FILTER (k) AS kept, CAST(0 AS BIGINT) AS skipped_name, count(*) FILTER (NOT k) AS skipped_patient FROM (
  SELECT code IN (SELECT upper(trim(patient_id)) FROM catalog WHERE names_bindung) AS k FROM files)""")
def bindung_counts(spark, sf_dir):
    from turnloom.sources.readers import bindung_counts

    return bindung_counts(A.files(spark, sf_dir), A.catalog(spark, sf_dir))


@query(with_(A.STATS) + """SELECT participant_id, count(*) AS n FROM stats WHERE participant_id IN (
  SELECT participant_id FROM stats GROUP BY 1 HAVING count(*) FILTER (sentiment = 'positive') >= 130 AND count(*) FILTER (sentiment = 'neutral') >= 130
  AND count(*) FILTER (sentiment = 'negative') >= 130) GROUP BY participant_id""")
def inclusion_filter(spark, sf_dir):
    return jobs.inclusion_filter(A.stats_rows(spark, sf_dir), 130, "participant_id").groupBy("participant_id").agg(F.count("*").alias("n"))


# --- signals and dyads -----------------------------------------------------------------------------------

@query(with_(A.FRAMES) + "SELECT dyad, side, ts, intensity FROM frames")
def smile_intensity(spark, sf_dir):
    return A.frames(spark, sf_dir).select("dyad", "side", "ts", "intensity")


@query(with_(A.FRAMES) + "SELECT dyad, side, ts, presence FROM frames")
def smile_presence(spark, sf_dir):
    return A.frames(spark, sf_dir).select("dyad", "side", "ts", "presence")


MEANS = ("client_smile_intensity", "therapist_smile_intensity", "client_smile_freq", "therapist_smile_freq")
TURN_ROWS = with_(A.FRAMES, A.TURNS, """m AS (
  SELECT t.dyad, t.interviewer, t.turn_index, t.sentiment, t.start_s, t.end_s,
    CASE WHEN count(f.intensity) FILTER (side = 0) >= 3 THEN avg(f.intensity) FILTER (side = 0) END AS client_smile_intensity,
    CASE WHEN count(f.intensity) FILTER (side = 1) >= 3 THEN avg(f.intensity) FILTER (side = 1) END AS therapist_smile_intensity,
    CASE WHEN count(f.presence) FILTER (side = 0) >= 3 THEN avg(f.presence) FILTER (side = 0) END AS client_smile_freq,
    CASE WHEN count(f.presence) FILTER (side = 1) >= 3 THEN avg(f.presence) FILTER (side = 1) END AS therapist_smile_freq
  FROM turns t LEFT JOIN frames f ON t.dyad = f.dyad AND f.ts >= t.start_s AND f.ts < t.end_s GROUP BY ALL)""")


def _turn_rows(spark, sf_dir):
    return dyad.turn_means(A.turns(spark, sf_dir), A.frames(spark, sf_dir), bucket=A.BUCKET_S)


@query(TURN_ROWS + "SELECT dyad AS patient_id, interviewer AS therapist_id, turn_index, sentiment, start_s, end_s, "
       + ", ".join(f"round({c}, 9) AS {c}" for c in MEANS) + " FROM m")
def turn_rows(spark, sf_dir):
    t = _turn_rows(spark, sf_dir)
    return t.select(F.col("dyad").alias("patient_id"), F.col("interviewer").alias("therapist_id"), "turn_index", "sentiment", "start_s", "end_s", *map(r9, MEANS))


@query(TURN_ROWS + "SELECT sentiment, count(*) AS n_turns, count(client_smile_intensity) AS n_defined, round(avg(client_smile_intensity), 9) AS mean_intensity FROM m GROUP BY sentiment")
def turn_mean_smile(spark, sf_dir):
    t = _turn_rows(spark, sf_dir)
    return t.groupBy("sentiment").agg(F.count("*").alias("n_turns"), F.count("client_smile_intensity").alias("n_defined"), F.round(F.avg("client_smile_intensity"), 9).alias("mean_intensity"))


@query(TURN_ROWS + """SELECT count(*) AS n_turns, count(DISTINCT dyad) AS n_patients, count(DISTINCT interviewer) AS n_therapists, round(avg(client_smile_freq), 9) AS grand_mean_raw
FROM m WHERE client_smile_freq IS NOT NULL""")
def a1_descriptives(spark, sf_dir):
    t = _turn_rows(spark, sf_dir).where("client_smile_freq is not null")
    return t.agg(F.count("*").alias("n_turns"), F.countDistinct("dyad").alias("n_patients"), F.countDistinct("interviewer").alias("n_therapists"), F.round(F.avg("client_smile_freq"), 9).alias("grand_mean_raw"))


@query(with_(A.FRAMES, A.GRID) + "SELECT dyad, i, round(t, 6) AS t FROM grid")
def common_grid(spark, sf_dir):
    return dyad.common_grid(A.frames(spark, sf_dir), A.HZ).select("dyad", "i", F.round("t", 6).alias("t"))


@query(with_(A.FRAMES, A.GRID, A.TURNS) + "SELECT t.dyad, t.turn_index, count(g.i) AS n FROM turns t LEFT JOIN grid g ON t.dyad = g.dyad AND g.t BETWEEN t.start_s AND t.end_s GROUP BY ALL")
def grid_turn_closed(spark, sf_dir):
    met = dyad.range_join(A.turns(spark, sf_dir), dyad.common_grid(A.frames(spark, sf_dir), A.HZ), "t", closed=True, bucket=A.BUCKET_S)
    return met.groupBy("dyad", "turn_index").agg(F.count("i").alias("n"))


@query(with_(A.FRAMES, A.GRID, A.NEAREST) + "SELECT dyad, side, i, v FROM nearest")
def resample_nearest(spark, sf_dir):
    f = A.frames(spark, sf_dir)
    return dyad.resample_nearest(dyad.spans(f, A.HZ), f, bucket=A.BUCKET_S, hz=A.HZ).select("dyad", "side", "i", "v")


@query(with_(A.FRAMES, A.GRID, A.LINEAR) + "SELECT dyad, side, i, round(v, 9) AS v FROM linear")
def resample_linear(spark, sf_dir):
    f = A.frames(spark, sf_dir)
    return dyad.resample_linear(dyad.spans(f, A.HZ), f, bucket=A.BUCKET_S, hz=A.HZ).select("dyad", "side", "i", r9("v"))


SIMUL = """co AS (
  SELECT dyad, i, t, CASE WHEN max(v) FILTER (side = 0) >= 0.5 AND max(v) FILTER (side = 1) >= 0.5 THEN 1 ELSE 0 END AS both_smile FROM nearest GROUP BY dyad, i, t
), ssn AS (
  SELECT t.dyad, t.turn_index, count(c.i) AS n, coalesce(sum(c.both_smile), 0) AS k FROM turns t LEFT JOIN co c ON t.dyad = c.dyad AND c.t BETWEEN t.start_s AND t.end_s GROUP BY ALL
), ss AS (
  SELECT dyad, turn_index, CAST(CASE WHEN n >= 3 THEN k ELSE 0 END AS BIGINT) AS simul_smile_frames, n AS simul_smile_n_frames,
         CASE WHEN n >= 3 THEN CAST(k AS DOUBLE) / n END AS simul_smile_freq FROM ssn
)"""
CORR = """CASE WHEN count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) >= 3 AND stddev_pop(x) FILTER (y IS NOT NULL) >= 1e-12 AND stddev_pop(y) FILTER (x IS NOT NULL) >= 1e-12
  THEN covar_pop(x, y) / (stddev_pop(x) FILTER (y IS NOT NULL) * stddev_pop(y) FILTER (x IS NOT NULL)) END"""
CROSS = f"""al AS (
  SELECT dyad, i, t, max(v) FILTER (side = 0) AS p, max(v) FILTER (side = 1) AS q FROM linear GROUP BY dyad, i, t
), pts AS (SELECT t.dyad, t.turn_index, t.start_s, t.end_s, a.i, a.p, a.q FROM turns t LEFT JOIN al a ON t.dyad = a.dyad AND a.t BETWEEN t.start_s AND t.end_s),
nf AS (SELECT dyad, turn_index, start_s, end_s, count(i) AS n_frames FROM pts GROUP BY ALL),
fit AS (SELECT dyad, turn_index, least(3, n_frames - 3) AS mk FROM nf WHERE n_frames >= 3 AND end_s - start_s >= 43200),
lags AS (SELECT dyad, turn_index, mk, CAST(unnest(range(-mk, mk + 1)) AS BIGINT) AS k FROM fit),
pairs AS (
  SELECT l.dyad, l.turn_index, l.k, a.p AS x, b.q AS y FROM lags l JOIN pts a ON a.dyad = l.dyad AND a.turn_index = l.turn_index
  JOIN pts b ON b.dyad = l.dyad AND b.turn_index = l.turn_index AND b.i = a.i + l.k
), rs AS (SELECT dyad, turn_index, k, {CORR} AS r FROM pairs GROUP BY dyad, turn_index, k),
ranked AS (SELECT *, row_number() OVER (PARTITION BY dyad, turn_index ORDER BY round(abs(r), 12) DESC, k) AS rk FROM rs WHERE r IS NOT NULL),
cc AS (
  SELECT n.dyad, n.turn_index, n.n_frames, z.r AS cc_r, b.k / (1.0::DOUBLE / 3600.0::DOUBLE) AS peak_lag_s, b.r AS cc_r_peak FROM nf n
  LEFT JOIN rs z ON z.dyad = n.dyad AND z.turn_index = n.turn_index AND z.k = 0
  LEFT JOIN ranked b ON b.dyad = n.dyad AND b.turn_index = n.turn_index AND b.rk = 1
)"""


def _simul(spark, sf_dir):
    return dyad.simul_smile(A.turns(spark, sf_dir), A.frames(spark, sf_dir), A.HZ, bucket=A.BUCKET_S)


def _cross(spark, sf_dir):
    return dyad.cross_lag(A.turns(spark, sf_dir), A.frames(spark, sf_dir), A.HZ, A.MAX_LAG_S, A.MIN_TURN_S, bucket=A.BUCKET_S)


def _sync(spark, sf_dir):
    return dyad.synchrony(A.turns(spark, sf_dir), A.frames(spark, sf_dir), A.HZ, A.MAX_LAG_S, A.MIN_TURN_S, bucket=A.BUCKET_S)


@query(with_(A.FRAMES, A.GRID, A.NEAREST, A.TURNS, SIMUL) + "SELECT dyad, turn_index, simul_smile_frames, simul_smile_n_frames, round(simul_smile_freq, 9) AS simul_smile_freq FROM ss")
def simul_smile(spark, sf_dir):
    return _simul(spark, sf_dir).select("dyad", "turn_index", "simul_smile_frames", "simul_smile_n_frames", r9("simul_smile_freq"))


@query(with_(A.FRAMES, A.GRID, A.LINEAR, A.TURNS, CROSS) + "SELECT dyad, turn_index, n_frames, round(cc_r, 9) AS cc_r, round(peak_lag_s, 6) AS peak_lag_s, round(cc_r_peak, 9) AS cc_r_peak FROM cc")
def cross_lag(spark, sf_dir):
    return _cross(spark, sf_dir).select("dyad", "turn_index", "n_frames", r9("cc_r"), F.round("peak_lag_s", 6).alias("peak_lag_s"), r9("cc_r_peak"))


@query(with_(A.FRAMES, A.GRID, A.LINEAR, A.TURNS, CROSS) + "SELECT dyad, turn_index, k, round(r, 9) AS r FROM ranked WHERE rk = 1")
def cross_lag_peak(spark, sf_dir):
    c = _cross(spark, sf_dir).where("cc_r_peak is not null")
    return c.select("dyad", "turn_index", F.round(F.col("peak_lag_s") * A.HZ).cast("long").alias("k"), F.round("cc_r_peak", 9).alias("r"))


def _at_30_hz(sql: str) -> str:
    """The same SQL on a clock on which an hour is a thirtieth of a second."""
    sql = sql.replace("/ 1e6 AS ts", "/ 1e6 / 108000 AS ts").replace("(1.0::DOUBLE / 3600.0::DOUBLE)", "(30.0::DOUBLE)")
    return sql.replace("least(3, n_frames - 3)", "least(75, n_frames - 3)").replace("end_s - start_s >= 43200", "end_s - start_s >= 4.0")


#: Turns as long as a dyad's whole record, so that the longest lag fits.
WHOLE = "turns AS (SELECT DISTINCT user_id // 2 AS dyad, 0 AS turn_index, 0.0::DOUBLE AS start_s, 24.0::DOUBLE AS end_s FROM events)"


@query(_at_30_hz(with_(A.FRAMES, A.GRID, A.LINEAR, WHOLE, CROSS) + "SELECT dyad, turn_index, n_frames, round(cc_r, 9) AS cc_r, round(peak_lag_s, 6) AS peak_lag_s, round(cc_r_peak, 9) AS cc_r_peak FROM cc"))
def cross_lag_151(spark, sf_dir):
    """All 151 lags at 30 Hz."""
    quick = A.frames(spark, sf_dir).withColumn("ts", F.col("ts") / 108_000)
    turns_ = A.turns(spark, sf_dir).withColumns({c: F.col(c) / 108_000 for c in ("start_s", "end_s")})
    whole = turns_.groupBy("dyad").agg(F.lit(0).alias("turn_index"), F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"))
    cc = dyad.cross_lag(whole, quick, min_turn_s=4.0)
    return cc.select("dyad", "turn_index", "n_frames", r9("cc_r"), F.round("peak_lag_s", 6).alias("peak_lag_s"), r9("cc_r_peak"))


SYNC = with_(A.FRAMES, A.GRID, A.NEAREST, A.LINEAR, A.TURNS, SIMUL, CROSS, """sync AS (
  SELECT t.dyad AS participant_id, t.interviewer AS interviewer_id, t.turn_index, t.sentiment, round(t.end_s - t.start_s, 3) AS duration_s, coalesce(c.n_frames, 0) AS n_frames,
    'synchrony' AS level, 'duchenne_smile' AS au, c.cc_r, c.peak_lag_s, c.cc_r_peak, coalesce(s.simul_smile_frames, 0) AS simul_smile_frames,
    coalesce(s.simul_smile_n_frames, 0) AS simul_smile_n_frames, s.simul_smile_freq
  FROM turns t LEFT JOIN cc c USING (dyad, turn_index) LEFT JOIN ss s USING (dyad, turn_index))""")


@query(SYNC + "SELECT * REPLACE (round(cc_r, 9) AS cc_r, round(peak_lag_s, 6) AS peak_lag_s, round(cc_r_peak, 9) AS cc_r_peak, round(simul_smile_freq, 9) AS simul_smile_freq) FROM sync")
def sync_turns(spark, sf_dir):
    s = _sync(spark, sf_dir)
    return s.withColumns({"cc_r": F.round("cc_r", 9), "peak_lag_s": F.round("peak_lag_s", 6), "cc_r_peak": F.round("cc_r_peak", 9), "simul_smile_freq": F.round("simul_smile_freq", 9)})


@query(with_(A.TURNS) + "SELECT dyad, turn_index, round(end_s - start_s, 3) AS duration_s, 'synchrony' AS level, 'duchenne_smile' AS au FROM turns")
def sync_projection(spark, sf_dir):
    return A.turns(spark, sf_dir).select("dyad", "turn_index", F.round(F.col("end_s") - F.col("start_s"), 3).alias("duration_s"), F.lit("synchrony").alias("level"), F.lit("duchenne_smile").alias("au"))


@query(SYNC + """SELECT count(*) AS n_turns, count(cc_r_peak) AS n_cc, count(*) FILTER (simul_smile_n_frames > 0) AS n_ss,
  count(cc_r_peak) / CAST(count(*) AS DOUBLE) AS share_cc, count(*) FILTER (simul_smile_n_frames > 0) / CAST(count(*) AS DOUBLE) AS share_ss FROM sync""")
def coverage(spark, sf_dir):
    return effects.coverage(_sync(spark, sf_dir))


# --- statistics ------------------------------------------------------------------------------------------

@query(with_(A.STATS) + f"SELECT participant_id, round({CORR}, 9) AS r FROM (SELECT participant_id, y AS x, CAST(n AS DOUBLE) AS y FROM stats) GROUP BY participant_id")
def signed_corr(spark, sf_dir):
    s = A.stats_rows(spark, sf_dir)
    return s.groupBy("participant_id").agg(F.round(S.signed_corr(F.col("y"), F.col("n").cast("double")), 9).alias("r"))


@query(with_(A.STATS) + "SELECT sentiment, count(*) AS n FROM stats WHERE sentiment IN ('negative', 'positive') AND y IS NOT NULL GROUP BY sentiment")
def focal_filter(spark, sf_dir):
    s = A.stats_rows(spark, sf_dir).where(F.col("sentiment").isin(*effects.FOCAL) & F.col("y").isNotNull())
    return s.groupBy("sentiment").agg(F.count("*").alias("n"))


@query(with_(A.STATS) + """SELECT n_obs, n_sentiments, n_interviewers, n_participants, n_sentiments >= 2 AND n_interviewers >= 2 AND n_participants >= 2 AND n_obs >= 10 AS fittable FROM (
  SELECT count(*) AS n_obs, count(DISTINCT sentiment) AS n_sentiments, count(DISTINCT interviewer_id) AS n_interviewers, count(DISTINCT participant_id) AS n_participants
  FROM stats WHERE sentiment IN ('negative', 'positive'))""")
def fittable(spark, sf_dir):
    return effects.fittable(A.stats_rows(spark, sf_dir).where(F.col("sentiment").isin(*effects.FOCAL)))


@query(with_(A.STATS) + "SELECT sentiment, round(avg(y), 9) AS mean, round(stddev_samp(y), 9) AS sd, count(y) AS n FROM stats GROUP BY sentiment")
def desc_freq(spark, sf_dir):
    return effects.by_sentiment(A.stats_rows(spark, sf_dir), F.col("y")).select("sentiment", r9("mean"), r9("sd"), "n")


@query(with_(A.STATS) + "SELECT sentiment, round(avg(a), 9) AS mean, round(stddev_samp(a), 9) AS sd, count(a) AS n FROM (SELECT sentiment, CASE WHEN k > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS a FROM stats) GROUP BY sentiment")
def desc_any(spark, sf_dir):
    return effects.by_sentiment(A.stats_rows(spark, sf_dir), (F.col("k") > 0).cast("double")).select("sentiment", r9("mean"), r9("sd"), "n")


@query(with_(A.STATS) + """SELECT sentiment, round(avg(z), 9) AS mean_z, round(tanh(avg(z)), 9) AS mean_r, round(stddev_samp(z), 9) AS sd_z, count(z) AS n FROM (
  SELECT sentiment, atanh(least(greatest(abs(y * 12 - 0.6), -0.999), 0.999)) AS z FROM stats) GROUP BY sentiment""")
def desc_fisherz(spark, sf_dir):
    s = A.stats_rows(spark, sf_dir).withColumn("r", F.col("y") * 12 - 0.6)
    return effects.fisher_descriptives(s, "r").select("sentiment", r9("mean_z"), r9("mean_r"), r9("sd_z"), "n")


@query(with_(A.STATS) + "SELECT l_orderkey, l_linenumber, l_partkey, round(atanh(least(greatest(y * 12 - 0.6, -0.999), 0.999)), 9) AS z FROM stats")
def fisher_z(spark, sf_dir):
    return A.stats_rows(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", F.round(S.fisher_z(F.col("y") * 12 - 0.6), 9).alias("z"))


@query(with_(A.STATS) + "SELECT l_orderkey, l_linenumber, l_partkey, k AS succ, greatest(n - k, 0) AS fail, CAST(k > 0 AS INTEGER) AS \"any\" FROM stats")
def succ_fail_any(spark, sf_dir):
    return A.stats_rows(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", *S.succ_fail_any(F.col("k"), F.col("n")))


@query(with_(A.STATS) + """SELECT n1, n2, round((m1 - m2) / sqrt(((n1 - 1) * s1 * s1 + (n2 - 1) * s2 * s2) / (n1 + n2 - 2)), 9) AS d FROM (
  SELECT count(y) FILTER (sentiment = 'positive') AS n1, avg(y) FILTER (sentiment = 'positive') AS m1, stddev_samp(y) FILTER (sentiment = 'positive') AS s1,
         count(y) FILTER (sentiment = 'negative') AS n2, avg(y) FILTER (sentiment = 'negative') AS m2, stddev_samp(y) FILTER (sentiment = 'negative') AS s2 FROM stats)""")
def cohens_d(spark, sf_dir):
    return effects.cohens_d(A.stats_rows(spark, sf_dir), "y", "positive", "negative").select("n1", "n2", r9("d"))


@query(with_(A.STATS) + """SELECT round(atanh(avg(y) FILTER (sentiment = 'positive')) - atanh(avg(y) FILTER (sentiment = 'negative')), 9) AS q FROM stats""")
def cohens_q(spark, sf_dir):
    m = A.stats_rows(spark, sf_dir).agg(*[F.avg(F.when(F.col("sentiment") == s, F.col("y"))).alias(s) for s in effects.FOCAL])
    return m.select(F.round(S.cohens_q(F.col("positive"), F.col("negative")), 9).alias("q"))


@query("""SELECT p_partkey, family, p, round(min(least(1.0::DOUBLE, p * m / rk)) OVER (PARTITION BY family ORDER BY p DESC NULLS LAST RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 9) AS q
FROM (SELECT *, count(p) OVER (PARTITION BY family) AS m, count(p) OVER (PARTITION BY family ORDER BY p NULLS FIRST RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rk
  FROM (SELECT p_partkey, p_brand AS family, (p_partkey * 37 % 1000) / 1000.0::DOUBLE AS p FROM part WHERE p_partkey % 9 <> 0))
UNION ALL SELECT p_partkey, p_brand, NULL, NULL FROM part WHERE p_partkey % 9 = 0""")
def bh_fdr(spark, sf_dir):
    p = A.read(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("family"), F.when(F.col("p_partkey") % 9 != 0, (F.col("p_partkey") * 37 % 1000) / 1000.0).alias("p"))
    return effects.bh_fdr(p).select("p_partkey", "family", "p", r9("q"))


ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_tax", "y", "n", "sentiment", "l_shipdate")


@query(with_(A.STATS, f"""nat AS (SELECT *, row_number() OVER (PARTITION BY participant_id ORDER BY {', '.join(f'{c} NULLS FIRST' for c in ORDER)}) AS rk FROM stats),
perms AS (SELECT nat.*, perm FROM nat, (SELECT CAST(range AS INTEGER) AS perm FROM range(3))),
dealt AS (SELECT perm, participant_id, sentiment AS shuffled, row_number() OVER (PARTITION BY perm, participant_id
  ORDER BY md5('42|' || CAST(perm AS VARCHAR) || '|' || CAST(participant_id AS VARCHAR) || '|' || CAST(rk AS VARCHAR))) AS at_rk FROM perms)""") + """
SELECT p.perm, p.participant_id, d.shuffled, count(*) AS n, CAST(sum(p.rk) AS BIGINT) AS ranks FROM perms p JOIN dealt d ON p.perm = d.perm AND p.participant_id = d.participant_id AND p.rk = d.at_rk GROUP BY ALL""")
def perm_shuffle(spark, sf_dir):
    s = effects.shuffled(A.stats_rows(spark, sf_dir), "participant_id", "sentiment", ORDER, 3)
    return s.groupBy("perm", "participant_id", "shuffled").agg(F.count("*").alias("n"), F.sum("rank").cast("long").alias("ranks"))


@query("""SELECT measure, n_positive, mean_freq_positive, mean_r_positive FROM (
  SELECT 'simul_smile' AS measure, count(*) FILTER (l_returnflag = 'A') AS n_positive, round(avg(l_discount) FILTER (l_returnflag = 'A'), 9) AS mean_freq_positive, NULL::DOUBLE AS mean_r_positive FROM lineitem
  UNION ALL SELECT 'duchenne_smile', count(*) FILTER (l_returnflag = 'A'), NULL, round(avg(l_tax) FILTER (l_returnflag = 'A'), 9) FROM lineitem)""")
def union_measures(spark, sf_dir):
    x, positive = A.read(spark, sf_dir, "lineitem"), F.col("l_returnflag") == "A"
    n = F.count_if(positive).alias("n_positive")
    one = x.agg(F.lit("simul_smile").alias("measure"), n, F.round(F.avg(F.when(positive, F.col("l_discount"))), 9).alias("mean_freq_positive"))
    two = x.agg(F.lit("duchenne_smile").alias("measure"), n, F.round(F.avg(F.when(positive, F.col("l_tax"))), 9).alias("mean_r_positive"))
    return one.unionByName(two, allowMissingColumns=True)


def _wcb_rows(spark, sf_dir):
    s = A.stats_rows(spark, sf_dir).where(F.col("sentiment").isin(*effects.FOCAL))
    return s.withColumn("D", (F.col("sentiment") == "positive").cast("int"))


WCB = with_(A.STATS, """cl AS (
  SELECT row_number() OVER (ORDER BY interviewer_id) - 1 AS g, count(*) AS n, CAST(count(*) FILTER (sentiment = 'positive') AS DOUBLE) AS d, sum(y) AS s,
         sum(y) FILTER (sentiment = 'positive') AS sd FROM stats WHERE sentiment IN ('negative', 'positive') GROUP BY interviewer_id
), w AS (
  SELECT count(*) AS gg, CAST(sum(n) AS DOUBLE) AS nn, sum(d) AS dt, sum(s) AS ss, sum(sd) AS sdt FROM cl
), f AS (
  SELECT *, nn * dt - dt * dt AS det, (dt * ss - dt * sdt) / (nn * dt - dt * dt) AS b0, (nn * sdt - dt * ss) / (nn * dt - dt * dt) AS b1, ss / nn AS yb,
         gg / (gg - 1.0::DOUBLE) * (nn - 1) / (nn - 2) AS c FROM w
), o AS (SELECT sqrt(any_value(c) * sum(power((nn * (sd - b0 * d - b1 * d) - dt * (s - b0 * n - b1 * d)) / det, 2))) AS se FROM cl, f),
dr AS (
  SELECT x.draw, cl.*, f.*, yb * n + z * (s - yb * n) AS a0r, yb * d + z * (sd - yb * d) AS a1r,
         (b0 * n + b1 * d) + z * (s - b0 * n - b1 * d) AS a0u, (b0 * d + b1 * d) + z * (sd - b0 * d - b1 * d) AS a1u
  FROM cl, f, (SELECT CAST(range AS BIGINT) AS draw FROM range(256)) x, LATERAL (SELECT 1.0::DOUBLE - 2.0::DOUBLE * ((x.draw >> cl.g) % 2) AS z)
), bs AS (
  SELECT draw, any_value(dt) * (sum(a0r) - sum(a1r)) / any_value(det) AS b0r, (any_value(nn) * sum(a1r) - any_value(dt) * sum(a0r)) / any_value(det) AS b1r,
         any_value(dt) * (sum(a0u) - sum(a1u)) / any_value(det) AS b0u, (any_value(nn) * sum(a1u) - any_value(dt) * sum(a0u)) / any_value(det) AS b1u FROM dr GROUP BY draw
), v AS (
  SELECT draw, any_value(b1) AS b1, any_value(b1r) AS b1r, any_value(b1u) AS b1u,
    any_value(c) * sum(power((nn * (a1r - b0r * d - b1r * d) - dt * (a0r - b0r * n - b1r * d)) / det, 2)) AS vr,
    any_value(c) * sum(power((nn * (a1u - b0u * d - b1u * d) - dt * (a0u - b0u * n - b1u * d)) / det, 2)) AS vu FROM dr JOIN bs USING (draw) GROUP BY draw
)""")


@query(WCB + """SELECT round((SELECT b1 FROM f), 9) AS wcb_beta, round(count(*) FILTER (vr > 0 AND abs(b1r / sqrt(vr)) >= abs(b1 / se) - 1e-12) / CAST(count(*) AS DOUBLE), 9) AS wcb_p,
  round(any_value(b1) - any_value(se) * quantile_cont((b1u - b1) / sqrt(vu), 0.975) FILTER (vu > 0), 7) AS wcb_ci_lo,
  round(any_value(b1) - any_value(se) * quantile_cont((b1u - b1) / sqrt(vu), 0.025) FILTER (vu > 0), 7) AS wcb_ci_hi,
  (SELECT gg FROM f) AS wcb_n_clusters, (SELECT gg FROM f) <= 12 AS wcb_exact FROM v, o""")
def wcb(spark, sf_dir):
    out = bootstrap.wild_cluster_bootstrap(_wcb_rows(spark, sf_dir), "y", "D", "interviewer_id")
    return out.select(r9("wcb_beta"), r9("wcb_p"), F.round("wcb_ci_lo", 7).alias("wcb_ci_lo"), F.round("wcb_ci_hi", 7).alias("wcb_ci_hi"), "wcb_n_clusters", "wcb_exact")


# --- result tables; the models in them have no SQL, tests hold those against dense likelihoods -----------------

def _smile(spark, sf_dir):
    return _turn_rows(spark, sf_dir).withColumnsRenamed({"dyad": "patient_id", "interviewer": "therapist_id"})


@query()
def smile_sentiment_lmm(spark, sf_dir):
    from turnloom.plans import analyses

    return analyses.smile_by_sentiment(_smile(spark, sf_dir))


def _pooled(a: str, b: str) -> str:
    return f"(m_{a} - m_{b}) / sqrt(((n_{a} - 1) * s_{a} * s_{a} + (n_{b} - 1) * s_{b} * s_{b}) / (n_{a} + n_{b} - 2))"


_LABELS = ("positive", "neutral", "negative")
_BY_LABEL = ", ".join(f"avg(v) FILTER (sentiment = '{s}') AS m_{s}, stddev_samp(v) FILTER (sentiment = '{s}') AS s_{s}, count(v) FILTER (sentiment = '{s}') AS n_{s}" for s in _LABELS)
_SMILE_LONG = " UNION ALL ".join(
    f"SELECT '{p}' AS person, '{m}' AS measure, '{f}' AS fdr_family, dyad, interviewer, sentiment, {c} AS v FROM m"
    for p, m, c, f in (("client", "duchenne_smile_freq", "client_smile_freq", "frequency"), ("therapist", "duchenne_smile_freq", "therapist_smile_freq", "frequency"),
                       ("client", "duchenne_smile_intensity", "client_smile_intensity", "intensity"), ("therapist", "duchenne_smile_intensity", "therapist_smile_intensity", "intensity"))
)


@query(TURN_ROWS + f"""SELECT person, measure, fdr_family, n_turns, n_patients, n_therapists, round(grand, 9) AS grand_mean_raw, {', '.join(f'round(m_{s}, 9) AS mean_{s}, n_{s} AS n_turns_{s}' for s in _LABELS)},
  round({_pooled('positive', 'neutral')}, 9) AS d_positive, round({_pooled('negative', 'neutral')}, 9) AS d_negative, round({_pooled('positive', 'negative')}, 9) AS d_pos_vs_neg
FROM (SELECT person, measure, fdr_family, count(*) AS n_turns, count(DISTINCT dyad) AS n_patients, count(DISTINCT interviewer) AS n_therapists, avg(v) AS grand, {_BY_LABEL}
      FROM ({_SMILE_LONG}) WHERE v IS NOT NULL GROUP BY person, measure, fdr_family)""")
def smile_descriptives(spark, sf_dir):
    from turnloom.plans import analyses

    d = analyses.smile_descriptives(_smile(spark, sf_dir)).drop("i")
    return d.select(*[r9(c) if t == "double" else F.col(c) for c, t in d.dtypes])


@query()
def synchrony_lmm(spark, sf_dir):
    from turnloom.plans import analyses

    return analyses.synchrony_by_sentiment(_sync(spark, sf_dir))


_FREQ = ", ".join(f"round(m_{s}, 9) AS mean_freq_{s}, round(s_{s}, 9) AS sd_freq_{s}, CAST(NULL AS DOUBLE) AS mean_r_{s}, CAST(NULL AS DOUBLE) AS mean_z_{s}, CAST(NULL AS DOUBLE) AS sd_z_{s}, n_{s}" for s in _LABELS)
_ZED = ", ".join(f"CAST(NULL AS DOUBLE) AS mean_freq_{s}, CAST(NULL AS DOUBLE) AS sd_freq_{s}, round(tanh(m_{s}), 9) AS mean_r_{s}, round(m_{s}, 9) AS mean_z_{s}, round(s_{s}, 9) AS sd_z_{s}, n_{s}" for s in _LABELS)
_SHARE = "sync WHERE simul_smile_freq IS NOT NULL AND simul_smile_n_frames > 0"


@query(SYNC + f"""SELECT 'simul_smile' AS measure, 'identity' AS transform, {_FREQ}, round({_pooled('positive', 'negative')}, 9) AS cohens_d, CAST(NULL AS DOUBLE) AS cohens_q
FROM (SELECT {_BY_LABEL} FROM (SELECT sentiment, simul_smile_freq AS v FROM {_SHARE}))
UNION ALL SELECT 'simul_smile_any', 'binary', {_FREQ}, round({_pooled('positive', 'negative')}, 9), CAST(NULL AS DOUBLE)
FROM (SELECT {_BY_LABEL} FROM (SELECT sentiment, CASE WHEN simul_smile_frames > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM {_SHARE}))
UNION ALL SELECT 'duchenne_smile', 'fisherz', {_ZED}, CAST(NULL AS DOUBLE), round(m_positive - m_negative, 9)
FROM (SELECT {_BY_LABEL} FROM (SELECT sentiment, atanh(least(abs(cc_r_peak), 0.999)) AS v FROM sync WHERE cc_r_peak IS NOT NULL))""")
def synchrony_descriptives(spark, sf_dir):
    from turnloom.plans import analyses

    d = analyses.synchrony_descriptives(_sync(spark, sf_dir))
    return d.select(*[r9(c) if t == "double" else F.col(c) for c, t in d.dtypes])


@query()
def permutation_test(spark, sf_dir):
    """The permutation p of one measure with 3000 shuffles within patients."""
    from turnloom.operators import permutations
    from turnloom.scratch import cut

    rows = cut(_smile(spark, sf_dir).where(F.col("client_smile_freq").isNotNull()).select("patient_id", "turn_index", "sentiment", "client_smile_freq"))
    return permutations.permutation_test(rows, "client_smile_freq", "patient_id", 3000, 100_042)


@query()
def stats_lmm(spark, sf_dir):
    """A random-intercept fit on many rows: cells only come to the driver."""
    from turnloom.operators import models

    fit = models.sentiment_model(A.stats_rows(spark, sf_dir), "y", "participant_id")
    return spark.createDataFrame([(k, float(v)) for k, v in fit.items() if isinstance(v, int | float)], "name string, value double")


@query("""SELECT count(l_discount) AS n, round(avg(power(l_discount - m, 3)) / power(stddev_pop(l_discount), 3), 6) AS skewness,
  round(avg(power(l_discount - m, 4)) / power(var_pop(l_discount), 2) - 3, 6) AS kurtosis FROM lineitem, (SELECT avg(l_discount) AS m FROM lineitem)""")
def residual_moments(spark, sf_dir):
    from turnloom.operators import models

    m = models.moments(A.read(spark, sf_dir, "lineitem"), "l_discount")
    return m.select("n", F.round("skewness", 6).alias("skewness"), F.round("kurtosis", 6).alias("kurtosis"))
