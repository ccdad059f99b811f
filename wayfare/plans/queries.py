"""A query for each operator over the test tables' check-in views, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.functions import scalars
from wayfare.operators import audit, encoder, examples, index, metrics, monitoring, scoring, serving
from wayfare.plans.views import e_view, l_view, line_visits, order_lines
from wayfare.session import BRIEF_SHUFFLES, discard_stored, settings, stored

PROTOCOL = "p1"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

E_SQL = """e AS (SELECT CAST(user_id AS VARCHAR) AS u, CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y-%m-%d') AS s, ts,
  'poi-' || lpad(json_extract_string(props, '$.k'), 3, '0') AS p, event_type AS c,
  CASE WHEN ts < TIMESTAMP '2024-01-24' THEN 'train' WHEN ts < TIMESTAMP '2024-01-27' THEN 'validation' ELSE 'test' END AS split FROM events)"""
L_SQL = """e AS (SELECT CAST(o_custkey AS VARCHAR) AS u, CAST(o_custkey AS VARCHAR) || '-' || CAST(year(l_shipdate) AS VARCHAR) AS s, CAST(l_shipdate AS TIMESTAMP) AS ts,
  lpad(CAST(l_partkey AS VARCHAR), 8, '0') AS p, p_brand AS c,
  CASE WHEN l_shipdate < TIMESTAMP '1999-12-01' THEN 'train' WHEN l_shipdate < TIMESTAMP '2000-09-01' THEN 'validation' ELSE 'test' END AS split
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""
M_SQL = L_SQL.replace("p_brand AS c", "CASE WHEN l_linenumber > 2 THEN 'kind-' || CAST(l_partkey % 40 AS VARCHAR) ELSE p_brand END AS c")
STAMP = "strftime({0}, '%Y-%m-%dT%H:%M:%S.%fZ')"
DAY = "CASE WHEN isodow({0}) >= 6 THEN 'weekend' ELSE 'weekday' END"
BUCKET = DAY + " || ':' || CASE WHEN hour({0}) BETWEEN 5 AND 11 THEN 'morning' WHEN hour({0}) BETWEEN 12 AND 16 THEN 'afternoon' WHEN hour({0}) BETWEEN 17 AND 21 THEN 'evening' ELSE 'night' END"
SAMPLE = f"sha256(concat_ws('|', 'synthetic', '{PROTOCOL}', u, s, {STAMP.format('ts')}, p))"

INDEX_SQL = f"""tr AS (SELECT *, {BUCKET.format("ts")} AS b FROM e WHERE split = 'train'),
poi AS (SELECT p, count(*) AS n FROM tr GROUP BY 1),
cat AS (SELECT c, p, count(*) AS n FROM tr GROUP BY 1, 2),
vote AS (SELECT p, c FROM (SELECT p, c, row_number() OVER (PARTITION BY p ORDER BY n DESC, c) AS r FROM cat) WHERE r = 1),
tm AS (SELECT b, p, count(*) AS n FROM tr GROUP BY 1, 2),
mv AS (SELECT src, dst, count(*) AS n FROM (SELECT p AS src, lead(p) OVER (PARTITION BY u, s ORDER BY ts, p, c) AS dst FROM tr) WHERE dst IS NOT NULL GROUP BY 1, 2)"""
EXAMPLES_SQL = f"""ev AS (SELECT *, row_number() OVER (PARTITION BY split, u, s ORDER BY ts, p, c) - 1 AS nb FROM e WHERE split <> 'train'),
sm AS (SELECT {SAMPLE} AS sid, * FROM ev WHERE nb >= 1),
hi AS (SELECT sm.sid, ev.p, ev.c, sm.nb - ev.nb AS pos FROM sm JOIN ev ON sm.split = ev.split AND sm.u = ev.u AND sm.s = ev.s AND ev.nb < sm.nb AND ev.nb >= sm.nb - 128)"""


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _train(events: DataFrame) -> DataFrame:
    return events.filter(F.col("split") == "train")


def _rest(events: DataFrame) -> DataFrame:
    return events.filter(F.col("split") != "train")


def _of_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What encoders need of the order lines, held by the executors: they read it once for each mapping, and encode it then, so
    lines, orders and parts would be dealt for each reading."""
    return l_view(spark, sf_dir).select("split", "raw_user_id", "raw_poi_id", "category").persist()


# B: expressions


@query("b1_parse_timestamp", f"SELECT event_id, {STAMP.format('ts')} AS iso, {STAMP.format('date_trunc(' + chr(39) + 'second' + chr(39) + ', ts)')} AS text_form, CAST(NULL AS VARCHAR) AS naive FROM events")
def b1(spark, sf_dir):
    ts = F.col("ts").cast("timestamp")
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", ts.alias("ts"))
    # written as text in three forms and parsed again; the one without an offset is refused
    forms = e.select(
        "event_id", F.date_format(F.col("ts") + F.expr("interval 2 hours"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+02:00'").alias("iso"),
        F.concat(F.lit("Tue "), F.date_format("ts", "MMM dd HH:mm:ss '+0000' yyyy")).alias("text_form"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("naive"),
    )
    return forms.select("event_id", *(scalars.canonical_timestamp(scalars.parse_timestamp(F.col(c))).alias(c) for c in ("iso", "text_form", "naive")))


@query("b2_time_bucket", f"WITH {E_SQL} SELECT {BUCKET.format('ts')} AS bucket, count(*) AS n FROM e GROUP BY 1")
def b2(spark, sf_dir):
    return e_view(spark, sf_dir).groupBy(scalars.time_bucket(F.col("timestamp_utc")).alias("bucket")).agg(F.count("*").alias("n"))


@query("b4_sample_id", f"WITH {E_SQL} SELECT {SAMPLE} AS sample_id, {STAMP.format('ts')} AS ts FROM e")
def b4(spark, sf_dir):
    e = e_view(spark, sf_dir)
    c = F.col
    return e.select(scalars.sample_id(c("dataset"), F.lit(PROTOCOL), c("raw_user_id"), c("session_id"), c("timestamp_utc"), c("raw_poi_id")).alias("sample_id"), scalars.canonical_timestamp(c("timestamp_utc")).alias("ts"))


@query("b5_identities", f"WITH {E_SQL} SELECT sha256(concat_ws('|', 'synthetic', u, {STAMP.format('ts')}, p)) AS event_identity, sha256(concat_ws('|', 'synthetic', u, s)) AS session_identity FROM e")
def b5(spark, sf_dir):
    return e_view(spark, sf_dir).select(scalars.event_identity().alias("event_identity"), scalars.session_identity().alias("session_identity"))


_edges = lambda pairs, rest: "CASE " + " ".join(f"WHEN n <= {a} THEN '{b}'" for a, b in pairs) + f" ELSE '{rest}' END"


@query(
    "b6_b7_b8_count_buckets",
    f"""WITH {E_SQL}, k AS (SELECT u, count(*) AS n FROM e GROUP BY 1) SELECT u AS raw_user_id, n,
    {_edges([(1, "1"), (4, "2-4"), (9, "5-9")], "10+")} AS evaluation_bucket,
    {_edges([(0, "0"), (1, "1"), (5, "2-5"), (10, "6-10"), (20, "11-20"), (50, "21-50"), (100, "51-100")], "101+")} AS monitoring_bucket,
    {_edges([(0, "0"), (1, "1"), (5, "2-5")], "6+")} AS small_bucket,
    {_edges([(0, "0"), (10, "1-10"), (25, "11-25"), (50, "26-50"), (100, "51-100")], "101+")} AS candidate_bucket,
    {_edges([(0, "unseen"), (1, "rare")], "frequent")} AS rarity FROM k""",
)
def b678(spark, sf_dir):
    n = F.col("n")
    k = e_view(spark, sf_dir).groupBy("raw_user_id").agg(F.count("*").alias("n"))
    return k.select(
        "raw_user_id", "n", scalars.evaluation_history_bucket(n).alias("evaluation_bucket"), scalars.monitoring_history_bucket(n).alias("monitoring_bucket"),
        scalars.small_count_bucket(n).alias("small_bucket"), scalars.candidate_count_bucket(n).alias("candidate_bucket"), scalars.rarity(n).alias("rarity"),
    )


def _digest_sql(text: str, source: str, by: str) -> str:
    """Rows as JSON text, their SHA-256 as 16 limbs of 16 bits, the limbs' sums carried into 256 bits, and the digest of both."""
    limb = lambda i: f"CAST(sum(CAST('0x' || substr(h, {61 - 4 * i}, 4) AS BIGINT)) AS BIGINT) AS s{i}"
    carried = "s0 AS c0, " + ", ".join(f"s{i} + c{i - 1} // 65536 AS c{i}" for i in range(1, audit.LIMBS))
    digits = ", ".join(f"c{i} % 65536" for i in reversed(range(audit.LIMBS)))
    return f"""SELECT {by}, sha256(n || ':' || format('{"{:04x}" * audit.LIMBS}', {digits})) AS fingerprint FROM (SELECT *, {carried} FROM (
    SELECT {by}, count(*) AS n, {", ".join(map(limb, range(audit.LIMBS)))} FROM (SELECT {by}, sha256({text}) AS h FROM {source}) GROUP BY 1))"""


_EVENT_TEXT = """'{"dataset":"synthetic","split":"' || split || '","raw_user_id":"' || u || '","session_id":"' || s || '","timestamp_utc":"' || """ + STAMP.format("ts") + """ || '","raw_poi_id":"' || p || '","model_poi_id":null,"category":"' || c || '","latitude":null,"longitude":null}'"""
_CODE_TEXT = """'{"mapping":"' || mapping || '","value":"' || value || '","id":' || id || '}'"""


@query("b9_fingerprint", f"WITH {E_SQL} " + _digest_sql(_EVENT_TEXT, "e", "split"))
def b9(spark, sf_dir):
    return audit.fingerprint(e_view(spark, sf_dir), audit.EVENT_COLUMNS, ["split"])


@query(
    "d8_d10_merged_days",
    f"WITH {E_SQL}, prints AS ({_digest_sql(_EVENT_TEXT, 'e', 'split')}) SELECT split, count(*) AS events, {STAMP.format('min(ts)')} AS first_ts, {STAMP.format('max(ts)')} AS last_ts, any_value(prints.fingerprint) AS fingerprint FROM e JOIN prints USING (split) GROUP BY 1",
)
def merged_days(spark, sf_dir):
    """Counts, times and fingerprints of the splits from the states of their days."""
    found = audit.merged_days(audit.daily_states(e_view(spark, sf_dir)))
    return found.select("split", "events", *(scalars.canonical_timestamp(F.col(c)).alias(c) for c in ("first_ts", "last_ts")), "fingerprint")


@query("b10_taxonomy_hash", f"WITH {E_SQL} SELECT sha256('[\"' || string_agg(c, '\",\"' ORDER BY c) || '\"]') AS taxonomy_sha256 FROM (SELECT DISTINCT c FROM e)")
def b10(spark, sf_dir):
    return audit.taxonomy_hash(e_view(spark, sf_dir))


@query("b11_category_key", f"WITH {L_SQL} SELECT 'category_' || substr(sha256(c), 1, 16) AS category_key, count(*) AS n FROM e GROUP BY 1")
def b11(spark, sf_dir):
    return l_view(spark, sf_dir).groupBy(scalars.category_key(F.col("category")).alias("category_key")).agg(F.count("*").alias("n"))


@query("b16_history_lines", f"WITH {E_SQL} SELECT u AS raw_user_id, count(*) AS n, count(*) AS valid, min(p) AS first_poi, max({STAMP.format('ts')}) AS last_ts FROM e GROUP BY 1")
def b16(spark, sf_dir):
    line = F.concat_ws(" | ", "raw_poi_id", "category", scalars.canonical_timestamp(F.col("timestamp_utc")))
    text = e_view(spark, sf_dir).groupBy("raw_user_id").agg(F.array_join(F.collect_list(line), "\n\n").alias("text"))
    rows = text.select("raw_user_id", F.explode(scalars.parse_history_lines(F.col("text"))).alias("h")).select("raw_user_id", "h.*")
    return rows.groupBy("raw_user_id").agg(F.count("*").alias("n"), F.count_if("valid").alias("valid"), F.min("poi_id").alias("first_poi"), F.max(scalars.canonical_timestamp(F.col("timestamp"))).alias("last_ts"))


# D, E: count tables


@query("d1_popularity", f"WITH {L_SQL}, {INDEX_SQL} SELECT poi.p AS poi_id, vote.c AS category, poi.n AS n FROM poi JOIN vote USING (p)")
def d1(spark, sf_dir):
    return index.fit_index(_train(l_view(spark, sf_dir))).poi_stats.select("poi_id", "category", "n")


@query("d2_time_popularity", f"WITH {E_SQL}, {INDEX_SQL} SELECT b AS bucket, p AS poi_id, n FROM tm")
def d2(spark, sf_dir):
    return index.fit_index(_train(e_view(spark, sf_dir))).time_counts.select("bucket", "poi_id", "n")


@query("d3_category_popularity", f"WITH {E_SQL}, {INDEX_SQL} SELECT c AS category, p AS poi_id, n FROM cat")
def d3(spark, sf_dir):
    return index.fit_index(_train(e_view(spark, sf_dir))).category_counts.select("category", "poi_id", "n")


@query("d4_category_vote", f"WITH {E_SQL}, {INDEX_SQL} SELECT p AS poi_id, c AS category FROM vote")
def d4(spark, sf_dir):
    return index.fit_index(_train(e_view(spark, sf_dir))).poi_stats.select("poi_id", "category")


@query(
    "d5_model_id_vote",
    f"WITH {E_SQL}, m AS (SELECT p, CASE WHEN hour(ts) < 12 THEN hour(ts) % 3 END AS m FROM e WHERE split = 'train'), k AS (SELECT p, m, count(*) AS n FROM m WHERE m IS NOT NULL GROUP BY 1, 2) "
    "SELECT a.p AS poi_id, CAST(b.m AS BIGINT) AS model_poi_id FROM (SELECT DISTINCT p FROM m) a LEFT JOIN (SELECT p, m FROM (SELECT p, m, row_number() OVER (PARTITION BY p ORDER BY n DESC, m) AS r FROM k) WHERE r = 1) b USING (p)",
)
def d5(spark, sf_dir):
    hour = F.hour("timestamp_utc")
    e = _train(e_view(spark, sf_dir)).withColumn("model_poi_id", F.when(hour < 12, (hour % 3).cast("long")))
    return index.fit_index(e).poi_stats.select("poi_id", "model_poi_id")


@query("d6_transitions", f"WITH {L_SQL}, {INDEX_SQL} SELECT src, dst, n FROM mv")
def d6(spark, sf_dir):
    return index.fit_index(_train(l_view(spark, sf_dir))).transition_counts.select("src", "dst", "n")


@query("d7_fit_guard", f"WITH {E_SQL} SELECT 'synthetic' AS dataset, count(*) AS n FROM e WHERE split = 'train'")
def d7(spark, sf_dir):
    train = _train(e_view(spark, sf_dir))
    return train.agg(F.lit(index.guard_training_rows(train)).alias("dataset"), F.count("*").alias("n"))


@query("e1_pairs", f"WITH {E_SQL} SELECT src, dst FROM (SELECT p AS src, lead(p) OVER (PARTITION BY u, s ORDER BY ts, p, c) AS dst FROM e) WHERE dst IS NOT NULL")
def e1(spark, sf_dir):
    return index.consecutive_pairs(e_view(spark, sf_dir))


@query(
    "e2_examples",
    f"WITH {E_SQL}, {EXAMPLES_SQL} SELECT sm.sid AS sample_id, sm.split, sm.p AS target_poi_id, sm.c AS target_category, h.n AS history_size, h.places FROM sm "
    "JOIN (SELECT sid, count(*) AS n, string_agg(p, ',' ORDER BY pos DESC) AS places FROM hi GROUP BY 1) h USING (sid)",
)
def e2(spark, sf_dir):
    rows = examples.build_examples(_rest(e_view(spark, sf_dir)), PROTOCOL)
    return rows.select("sample_id", "split", "target_poi_id", "target_category", F.size("history").cast("long").alias("history_size"), F.array_join("history.poi_id", ",").alias("places"))


@query("d25_duplicate_samples", f"WITH {L_SQL}, {EXAMPLES_SQL} SELECT sid AS sample_id, count(*) AS n FROM (SELECT sid FROM sm UNION ALL SELECT sid FROM sm WHERE sid < '4') GROUP BY 1 HAVING count(*) > 1")
def d25(spark, sf_dir):
    rows = examples.build_examples(_rest(l_view(spark, sf_dir)), PROTOCOL)
    return examples.duplicate_samples(rows.unionAll(rows.filter(F.col("sample_id") < "4")))  # some come twice


# C, D: audits


@query("c2_unknown_categories", f"WITH {L_SQL} SELECT DISTINCT c AS category FROM e WHERE split = 'test' AND c NOT IN (SELECT c FROM e WHERE split = 'train' AND c < 'Brand#4')")
def c2(spark, sf_dir):
    e = l_view(spark, sf_dir)
    return index.unknown_categories(e.filter(F.col("split") == "test"), index.taxonomy(_train(e).filter(F.col("category") < "Brand#4")))


_PAIRS = "(VALUES ('train', 'validation'), ('train', 'test'), ('validation', 'test')) AS k(left_split, right_split)"


@query(
    "c3_split_overlap",
    f"""WITH {L_SQL}, i AS (SELECT DISTINCT 'event' AS kind, u || '|' || {STAMP.format("ts")} || '|' || p AS id, split FROM e UNION ALL SELECT DISTINCT 'session', u || '|' || s, split FROM e)
    SELECT kinds.kind, left_split, right_split, (SELECT count(*) FROM i a JOIN i b ON a.kind = b.kind AND a.id = b.id WHERE a.kind = kinds.kind AND a.split = left_split AND b.split = right_split) AS overlap
    FROM {_PAIRS}, (VALUES ('event'), ('session')) AS kinds(kind)""",
)
def c3(spark, sf_dir):
    return audit.overlap_counts(l_view(spark, sf_dir))


@query(
    "d8_split_summary",
    f"WITH {L_SQL} SELECT split, count(*) AS events, count(DISTINCT u || '|' || s) AS sessions, {STAMP.format('min(ts)')} AS first_ts, {STAMP.format('max(ts)')} AS last_ts FROM e GROUP BY 1",
)
def d8(spark, sf_dir):
    s = audit.split_summary(l_view(spark, sf_dir))
    return s.select("split", "events", "sessions", *(scalars.canonical_timestamp(F.col(c)).alias(c) for c in ("first_ts", "last_ts")))


@query(
    "d9_temporal_order",
    f"WITH {L_SQL}, m AS (SELECT split, min(ts) AS a, max(ts) AS b FROM e GROUP BY 1) SELECT x.split AS earlier, y.split AS later, x.b <= y.a AS ordered FROM m x, m y WHERE (x.split, y.split) IN (('train', 'validation'), ('validation', 'test'))",
)
def d9(spark, sf_dir):
    return audit.temporal_boundaries(audit.split_summary(l_view(spark, sf_dir)))


@query(
    "d9_overall_order",
    f"WITH {L_SQL}, m AS (SELECT split, min(ts) AS a, max(ts) AS b FROM e GROUP BY 1) SELECT bool_and(x.b <= y.a) AS temporal_splits_ordered FROM m x, m y WHERE (x.split, y.split) IN (('train', 'validation'), ('validation', 'test'))",
)
def d9_all(spark, sf_dir):
    return audit.temporal_order(audit.temporal_boundaries(audit.split_summary(l_view(spark, sf_dir))))


_CODES_SQL = " UNION ALL ".join(f"SELECT 1 AS one, '{m}' AS mapping, v AS value, row_number() OVER (ORDER BY v) - 1 AS id FROM (SELECT DISTINCT {c} AS v FROM e{w})" for m, c, w in (("poi", "p", " WHERE split = 'train'"), ("user", "u", " WHERE split = 'train'"), ("category", "c", "")))


@query(
    "d10_manifest",
    f"""WITH {E_SQL}, codes AS ({_CODES_SQL}), prints AS ({_digest_sql(_EVENT_TEXT, "e", "split")}), coded AS ({_digest_sql(_CODE_TEXT, "codes", "one")}),
    sums AS (SELECT split, count(*) AS events, count(DISTINCT u || '|' || s) AS sessions, {STAMP.format("min(ts)")} AS first_ts, {STAMP.format("max(ts)")} AS last_ts FROM e GROUP BY 1)
    SELECT split, events, sessions, first_ts, last_ts, prints.fingerprint AS fingerprint, (SELECT sha256('["' || string_agg(c, '","' ORDER BY c) || '"]') FROM (SELECT DISTINCT c FROM e)) AS taxonomy_sha256,
    '{PROTOCOL}' AS split_protocol, coded.fingerprint AS encoder_fingerprint FROM sums JOIN prints USING (split), coded""",
)
def d10(spark, sf_dir):
    e = e_view(spark, sf_dir)
    found = audit.manifest(e, PROTOCOL, encoder.fit_encoder(_train(e), index.taxonomy(e)), index.taxonomy(e))
    return found.withColumns({c: scalars.canonical_timestamp(F.col(c)) for c in ("first_ts", "last_ts")})


@query(
    "e6_input_order",
    "SELECT 'all' AS split, NOT coalesce(bool_or(back), false) AS input_time_ordered FROM (SELECT ts < lag(ts) OVER (ORDER BY event_id) AS back FROM events)",
)
def e6(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("timestamp_utc"), F.lit("all").alias("split"))
    return audit.input_ordered(e, "event_id")


_BROKEN = {
    "time_sum": "(SELECT count(*) FROM poi WHERE p < 'poi-010')", "category_sum": "(SELECT count(*) FROM poi WHERE p < 'poi-010')", "voted_category": "(SELECT count(*) FROM poi WHERE p >= 'poi-090')",
    "outgoing": "(SELECT count(*) FROM (SELECT 1 FROM mv WHERE src = 'poi-030' LIMIT 1))", "buckets": "(SELECT count(*) FROM tm WHERE p = 'poi-020')",
    "transition_sources": "(SELECT count(*) FROM mv WHERE src = 'poi-030')", "taxonomy": "(SELECT count(DISTINCT c) FROM cat WHERE c = 'click')",
}
_RULES = ["time_sum", "category_sum", "voted_category", "outgoing", "incoming", "positive", "model_ids", "buckets", "time_pois", "category_pois", "transition_sources", "transition_targets", "taxonomy"]


@query("d24_index_audit", f"WITH {E_SQL}, {INDEX_SQL} " + " UNION ALL ".join(f"SELECT '{r}' AS rule, CAST({_BROKEN.get(r, '0')} AS BIGINT) AS violations" for r in _RULES))
def d24(spark, sf_dir):
    """Of an index with planted errors: counts, votes, a bucket, a source and a category that aren't those of its rows."""
    e = e_view(spark, sf_dir)
    idx, p = index.fit_index(_train(e)), F.col("poi_id")
    planted = index.Index(
        idx.dataset,
        idx.poi_stats.withColumn("n", F.col("n") + (p < "poi-010").cast("long")).withColumn("category", F.when(p >= "poi-090", "none").otherwise(F.col("category"))),
        idx.time_counts.withColumn("bucket", F.when(p == "poi-020", "noon").otherwise(F.col("bucket"))),
        idx.category_counts,
        idx.transition_counts.withColumn("src", F.when(F.col("src") == "poi-030", "lost").otherwise(F.col("src"))),
    )
    return index.audit_index(planted, index.taxonomy(e).filter("category <> 'click'"))


@query(
    "c1_e5_encode",
    f"""WITH {L_SQL}, pe AS (SELECT p, row_number() OVER (ORDER BY p) + 2 AS id FROM (SELECT DISTINCT p FROM e WHERE split = 'train')), ue AS (SELECT u, row_number() OVER (ORDER BY u) + 2 AS id FROM (SELECT DISTINCT u FROM e WHERE split = 'train')),
    ce AS (SELECT c, row_number() OVER (ORDER BY c) + 2 AS id FROM (SELECT DISTINCT c FROM e))
    SELECT split, pe.id AS poi_code, ue.id AS user_code, ce.id AS category_code, count(*) AS n FROM e LEFT JOIN pe USING (p) LEFT JOIN ue USING (u) LEFT JOIN ce USING (c) GROUP BY 1, 2, 3, 4""",
)
def c1(spark, sf_dir):
    e = _of_codes(spark, sf_dir)
    coded = encoder.encode(e, encoder.fit_encoder(_train(e), index.taxonomy(e), 3))
    return coded.groupBy("split", "poi_code", "user_code", "category_code").agg(F.count("*").alias("n"))


@query("d26_id_check", f"WITH {L_SQL} SELECT * FROM (SELECT 'poi' AS mapping, count(DISTINCT p) AS n, true AS contiguous FROM e WHERE split = 'train' UNION ALL SELECT 'user', count(DISTINCT u), true FROM e WHERE split = 'train' UNION ALL SELECT 'category', count(DISTINCT c), true FROM e)")
def d26(spark, sf_dir):
    e = _of_codes(spark, sf_dir)
    return encoder.check_ids(encoder.fit_encoder(_train(e), index.taxonomy(e), 3), 3)


@query("f4_taxonomy", f"WITH {L_SQL} SELECT DISTINCT c AS category FROM e")
def f4(spark, sf_dir):
    return index.taxonomy(l_view(spark, sf_dir))


@query("f7_unseen_pois", f"WITH {L_SQL} SELECT DISTINCT p AS raw_poi_id FROM e WHERE split <> 'train' AND p NOT IN (SELECT p FROM e WHERE split = 'train' AND p NOT LIKE '%7')")
def f7(spark, sf_dir):
    e = l_view(spark, sf_dir)
    return encoder.unseen_values(_train(e).filter(~F.col("raw_poi_id").endswith("7")), _rest(e), "raw_poi_id")  # some are held back


# G: scores. The SQL scores every place for every request.

_TERMS = {"global_popularity": "ln(1 + g)", "time_popularity": "1.25 * ln(1 + t)", "transition": "2.0 * ln(1 + m)", "recent_revisit": "1.5 * r", "history_category": "0.75 * ln(1 + k)"}
_COLUMN = {"global_popularity": "g", "time_popularity": "t", "transition": "m", "recent_revisit": "r", "history_category": "k"}
DENSE_SQL = f"""WITH {E_SQL}, {INDEX_SQL}, {EXAMPLES_SQL},
rv AS (SELECT sid, p, max(1.0 / pos) AS r FROM hi GROUP BY 1, 2),
rc AS (SELECT DISTINCT sid, c FROM hi WHERE pos <= 10),
ck AS (SELECT rc.sid, cat.p, sum(cat.n) AS k FROM rc JOIN cat USING (c) GROUP BY 1, 2),
sg AS (SELECT sm.sid, poi.p, vote.c, poi.n AS g, coalesce(tm.n, 0) AS t, coalesce(mv.n, 0) AS m, coalesce(rv.r, 0.0) AS r, coalesce(ck.k, 0) AS k
  FROM sm CROSS JOIN poi JOIN vote ON vote.p = poi.p LEFT JOIN tm ON tm.b = {BUCKET.format("sm.ts")} AND tm.p = poi.p
  LEFT JOIN hi ON hi.sid = sm.sid AND hi.pos = 1 LEFT JOIN mv ON mv.src = hi.p AND mv.dst = poi.p
  LEFT JOIN rv ON rv.sid = sm.sid AND rv.p = poi.p LEFT JOIN ck ON ck.sid = sm.sid AND ck.p = poi.p)"""


def _score_sql(variant: str) -> str:
    names = scoring.VARIANTS[variant]
    sources = " || ".join(["'global_popularity'"] + [f"CASE WHEN {_COLUMN[s]} > 0 THEN ',{s}' ELSE '' END" for s in names[1:]])
    return f"""{DENSE_SQL}, sc AS (SELECT sid, p, c, {" + ".join(_TERMS[s] for s in names)} AS score, {sources} AS sources FROM sg),
rk AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY round(score, 12) DESC, p) AS rank FROM sc)"""


def _lists(spark: SparkSession, sf_dir: str, variants: list[str], view: Callable = e_view, depth: int = scoring.TRACE, **beside: Column):
    """(index, examples, ordered places of each request); beside: columns of the examples that are passed on."""
    e = view(spark, sf_dir)
    idx = index.fit_index(_train(e)).kept()
    lists = serving.build_lists(idx, depth).kept()
    rows = examples.build_examples(_rest(e), PROTOCOL)
    asked = rows.select("sample_id", "dataset", "history", "target_time", "top_k", "profile", *(c.alias(n) for n, c in beside.items() if n != "target_time"))
    return idx, asked, scoring.scored_lists(asked, idx, variants, depth, lists, tuple(beside))


def _observed(spark: SparkSession, sf_dir: str, variants: list[str]):
    labels = {c: F.col(c) for c in metrics.LABELS if c not in ("target_time", "history_size")}
    idx, _, lists = _lists(spark, sf_dir, variants, **labels, target_time=F.col("target_time"), history_size=F.size("history"))
    return idx, metrics.observed(lists, idx)


def _summary(idx: index.Index, observed: DataFrame, catalog: DataFrame, slices: bool = False) -> DataFrame:
    """Of a catalog that is its own pool in one pass; else observations are kept, as they are read several times."""
    return metrics.summarise_once(observed, catalog, slices) if serving.is_whole(idx) else metrics.summarise(observed.persist(), catalog, slices)


def _shown(top: DataFrame) -> DataFrame:
    return top.select("sample_id", F.col("rank").cast("long").alias("rank"), "poi_id", "category", scalars.rounded(F.col("score"), 6).alias("score"), F.array_join("candidate_sources", ",").alias("candidate_sources"))


def _top10_of(view: Callable, spark: SparkSession, sf_dir: str, variant: str = "b3") -> DataFrame:
    return _shown(scoring.recommended(_lists(spark, sf_dir, [variant], view, 10)[2]))


def _top10_of_lines(spark: SparkSession, sf_dir: str, several: bool = False) -> DataFrame:
    """Of the order lines' many places: the joined lines are stored once, and so is each step, so that only one step's shuffle
    files are there at a time; what the last step doesn't read is deleted."""
    with settings(spark, BRIEF_SHUFFLES | {"spark.sql.files.maxPartitionBytes": "32m"}):
        lines = stored(order_lines(spark, sf_dir, several))
        e = line_visits(lines)
        idx = index.fit_index(_train(e), large=True)
        lists = serving.build_lists(idx, 10).kept()
        asked = examples.requests_of(examples.build_examples(_rest(e), PROTOCOL))
        top = scoring.recommended(scoring.scored_lists(asked, idx, ["b3"], 10, lists, heads=False))
    if lists.whole is None:
        discard_stored(lines, *lists.tables().values())
    return _shown(top)


def _top10(variant: str):
    return lambda spark, sf_dir: _top10_of(e_view, spark, sf_dir, variant)


for _n, _v in enumerate(scoring.VARIANTS, 1):
    query(f"g{_n}_rank_{_v}", f"{_score_sql(_v)} SELECT sid AS sample_id, rank, p AS poi_id, c AS category, round(score, 6) AS score, sources AS candidate_sources FROM rk WHERE rank <= 10")(_top10(_v))


_TOP_SQL = " SELECT sid AS sample_id, rank, p AS poi_id, c AS category, round(score, 6) AS score, sources AS candidate_sources FROM rk WHERE rank <= 10"


@query("g4_rank_b3_places", _score_sql("b3").replace(E_SQL, L_SQL) + _TOP_SQL)
def g4_places(spark, sf_dir):
    """On the view of many places of one category each, where the pool is a small part of the catalog."""
    return _top10_of_lines(spark, sf_dir)


@query("g4_rank_b3_several", _score_sql("b3").replace(E_SQL, M_SQL) + _TOP_SQL)
def g4_several(spark, sf_dir):
    """On the view of many places of two categories each: the best come from blocks that their bounds leave."""
    return _top10_of_lines(spark, sf_dir, several=True)


_MACRO_SQL = "hd AS (SELECT sid, c, min(rank) AS first FROM rk GROUP BY 1, 2), mc AS (SELECT sid, c, row_number() OVER (PARTITION BY sid ORDER BY first) AS rank FROM hd)"


@query("e8_macro_categories", f"{_score_sql('b3')}, {_MACRO_SQL} SELECT sid AS sample_id, rank, c AS category FROM mc WHERE rank <= 3")
def e8(spark, sf_dir):
    lists = _lists(spark, sf_dir, ["b3"])[2]
    found = lists.select("sample_id", F.posexplode(scoring.first_categories(F.col("best"), 3)).alias("at", "category"))
    return found.select("sample_id", (F.col("at") + 1).cast("long").alias("rank"), "category")


_OBS_SQL = f"""{_MACRO_SQL},
ob AS (SELECT sm.sid AS sid, CASE WHEN rk.rank <= 10 THEN rk.rank END AS top, CASE WHEN rk.rank <= 100 THEN rk.rank END AS trace, CASE WHEN mc.rank <= 3 THEN mc.rank END AS macro, coalesce(poi.n, 0) AS tn, hn, rk.sources, {DAY.format("sm.ts")} AS day_type
  FROM sm LEFT JOIN rk ON rk.sid = sm.sid AND rk.p = sm.p LEFT JOIN mc ON mc.sid = sm.sid AND mc.c = sm.c LEFT JOIN poi ON poi.p = sm.p JOIN (SELECT sid, count(*) AS hn FROM hi GROUP BY 1) hc ON hc.sid = sm.sid),
sl AS (SELECT *, CASE WHEN hn <= 1 THEN '1' WHEN hn <= 4 THEN '2-4' WHEN hn <= 9 THEN '5-9' ELSE '10+' END AS history_length, CASE WHEN tn = 0 THEN 'unseen' WHEN tn <= 1 THEN 'rare' ELSE 'frequent' END AS target_rarity FROM ob)"""
_METRIC_SQL = ", ".join(
    [f"round(avg(CASE WHEN {c} <= {k} THEN 1.0 ELSE 0.0 END), 9) AS {n}" for c, k, n in (("top", 1, "hit_at_1"), ("top", 5, "hit_at_5"), ("top", 10, "hit_at_10"), ("trace", 50, "candidate_recall_at_50"), ("trace", 100, "candidate_recall_at_100"), ("macro", 1, "macro_hit_at_1"), ("macro", 3, "macro_hit_at_3"))]
    + [f"round(avg(coalesce(1.0 / {c}, 0.0)), 9) AS {n}" for c, n in (("top", "mrr"), ("macro", "macro_mrr"))]
    + [f"round(avg(CASE WHEN top <= {k} THEN 1.0 / log2(top + 1) ELSE 0.0 END), 9) AS ndcg_at_{k}" for k in (5, 10)]
)
_METRIC_NAMES = ["hit_at_1", "hit_at_5", "hit_at_10", "candidate_recall_at_50", "candidate_recall_at_100", "macro_hit_at_1", "macro_hit_at_3", "mrr", "macro_mrr", "ndcg_at_5", "ndcg_at_10"]


def _matrix_sql() -> str:
    parts = []
    for v in scoring.VARIANTS:
        parts.append(f"SELECT '{v}' AS variant, * FROM ({_score_sql(v)}, {_OBS_SQL} SELECT count(*) AS samples, {_METRIC_SQL}, round((SELECT count(DISTINCT p) FROM rk WHERE rank <= 10) / (SELECT count(*) FROM poi), 9) AS coverage, 1.0::DOUBLE AS validity_rate FROM sl)")
    return " UNION ALL ".join(parts)


@query("d12_d27_variant_matrix", _matrix_sql())
def d12(spark, sf_dir):
    idx, observed = _observed(spark, sf_dir, list(scoring.VARIANTS))
    summary = _summary(idx, observed, idx.poi_stats)
    return summary.select("variant", "samples", *(F.round(c, 9).alias(c) for c in [*_METRIC_NAMES, "coverage"]), "validity_rate")


@query(
    "d13_validity",
    f"""{_score_sql("b3")}, pr AS (SELECT sid, count(*) AS n, count(*) FILTER (WHERE NOT p < 'poi-050') AS bad, count(DISTINCT p) AS d FROM rk WHERE rank <= 10 GROUP BY 1)
    SELECT round(avg(CASE WHEN n > 0 AND bad = 0 AND n = d THEN 1.0 ELSE 0.0 END), 9) AS validity_rate, round(sum(bad) / sum(n), 9) AS invalid_rate, round(sum(n - d) / sum(n), 9) AS duplicate_rate,
    round((SELECT count(DISTINCT p) FROM rk WHERE rank <= 10 AND p < 'poi-050') / (SELECT count(*) FROM poi WHERE p < 'poi-050'), 9) AS coverage FROM pr""",
)
def d13(spark, sf_dir):
    """Against a catalog that lacks half of the places, so that some predictions are invalid."""
    idx, observed = _observed(spark, sf_dir, ["b3"])
    summary = _summary(idx, observed, idx.poi_stats.filter("poi_id < 'poi-050'"))
    return summary.select(*(F.round(c, 9).alias(c) for c in ("validity_rate", "invalid_rate", "duplicate_rate", "coverage")))


@query(
    "d14_slices",
    f"{_score_sql('b3')}, {_OBS_SQL} "
    + " UNION ALL ".join(f"SELECT '{d}' AS dimension, {d} AS value, count(*) AS samples, {_METRIC_SQL} FROM sl GROUP BY 2" for d in metrics.SLICES),
)
def d14(spark, sf_dir):
    idx, observed = _observed(spark, sf_dir, ["b3"])
    summary = _summary(idx, observed, idx.poi_stats, slices=True)
    return summary.select("dimension", "value", "samples", *(F.round(c, 9).alias(c) for c in _METRIC_NAMES))


@query(
    "d15_failures",
    f"{_score_sql('b3')}, {_OBS_SQL}, pr AS (SELECT sid, string_agg(p, ',' ORDER BY rank) AS predictions FROM rk WHERE rank <= 10 GROUP BY 1) "
    "SELECT sid AS sample_id, 'target_miss_at_10' AS reasons, predictions, CASE WHEN trace IS NULL THEN '' ELSE sources END AS target_sources FROM sl JOIN pr USING (sid) WHERE top IS NULL",
)
def d15(spark, sf_dir):
    idx, observed = _observed(spark, sf_dir, ["b3"])
    bad = metrics.failures(observed, idx.poi_stats)
    return bad.select("sample_id", *(F.array_join(c, ",").alias(c) for c in ("reasons", "predictions", "target_sources")))


# D: monitoring

_EVENT_SQL = f"""{_score_sql("b3")},
tp AS (SELECT sid, max(score) AS top FROM rk WHERE rank <= 10 GROUP BY 1), wt AS (SELECT sid, exp(score - top) AS w FROM rk JOIN tp USING (sid) WHERE rank <= 10),
en AS (SELECT sid, CASE WHEN count(*) < 2 THEN 0.0 ELSE ln(sum(w)) - sum(w * ln(w)) / sum(w) END AS entropy FROM wt GROUP BY 1),
un AS (SELECT hi.sid, count(*) FILTER (WHERE poi.p IS NULL) AS unknown, count(*) AS h FROM hi LEFT JOIN poi USING (p) GROUP BY 1),
ev2 AS (SELECT sm.sid, sm.split, {_edges([(0, "0"), (1, "1"), (5, "2-5"), (10, "6-10"), (20, "11-20"), (50, "21-50"), (100, "51-100")], "101+").replace("n <=", "h <=")} AS hb, unknown, (SELECT count(*) FROM poi) AS cc, entropy FROM sm JOIN un USING (sid) JOIN en USING (sid))"""
_DIST_SQL = f"""{_EVENT_SQL},
ds AS (SELECT split, 'history_length' AS dimension, hb AS key, count(*) AS weight FROM ev2 GROUP BY ALL
 UNION ALL SELECT split, 'unknown_count', {_edges([(0, "0"), (1, "1"), (5, "2-5")], "6+").replace("n <=", "unknown <=")}, count(*) FROM ev2 GROUP BY ALL
 UNION ALL SELECT split, 'candidate_count', {_edges([(0, "0"), (10, "1-10"), (25, "11-25"), (50, "26-50"), (100, "51-100")], "101+").replace("n <=", "cc <=")}, count(*) FROM ev2 GROUP BY ALL
 UNION ALL SELECT split, 'status', 'ok', count(*) FROM ev2 GROUP BY ALL
 UNION ALL SELECT split, 'candidate_source', x, count(*) FROM (SELECT split, unnest(string_split(sources, ',')) AS x FROM rk JOIN sm USING (sid) WHERE rank <= 100) GROUP BY ALL
 UNION ALL SELECT split, 'category', 'category_' || substr(sha256(rk.c), 1, 16), count(*) FROM rk JOIN sm USING (sid) WHERE rank <= 10 GROUP BY ALL),
sh AS (SELECT *, weight / sum(weight) OVER (PARTITION BY split, dimension) AS share FROM ds)"""
_DRIFT_SQL = """ff AS (SELECT coalesce(a.dimension, b.dimension) AS dimension, coalesce(a.share, 0) AS r, coalesce(b.share, 0) AS q FROM (SELECT * FROM {ref}) a FULL JOIN (SELECT * FROM {cur}) b ON a.dimension = b.dimension AND a.key = b.key),
dr AS (SELECT dimension, greatest(0, sum(CASE WHEN r > 0 THEN r / 2 * ln(r / ((r + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q / 2 * ln(q / ((r + q) / 2)) ELSE 0 END)) AS js,
 sum((greatest(q, 1e-6) - greatest(r, 1e-6)) * ln(greatest(q, 1e-6) / greatest(r, 1e-6))) AS psi FROM ff GROUP BY 1)
SELECT dimension, round(js, 9) AS js, round(psi, 9) AS psi, js > 0.1 OR psi > 0.2 AS alert FROM dr"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monitoring events of the validation and of the test requests, with their split."""
    beside = {"split": F.col("split"), "history_size": F.size("history"), "digest": monitoring.request_digest(), "visited": F.col("history.poi_id")}
    idx, _, lists = _lists(spark, sf_dir, ["b3"], **beside)
    return monitoring.events_of_lists(lists, idx, ("r1", "d1", "m1"), extra=("split",))


@query("g10_batch_scoring", f"{_EVENT_SQL} SELECT split, hb AS history_length_bucket, unknown AS unknown_count, cc AS candidate_count, count(*) AS n, round(sum(entropy), 4) AS entropy FROM ev2 GROUP BY ALL")
def g10(spark, sf_dir):
    return _events(spark, sf_dir).groupBy("split", "history_length_bucket", "unknown_count", "candidate_count").agg(F.count("*").alias("n"), F.round(F.sum("score_entropy"), 4).alias("entropy"))


@query("d16_distributions", f"{_DIST_SQL} SELECT dimension, key, CAST(weight AS BIGINT) AS weight, round(share, 9) AS share FROM sh WHERE split = 'test'")
def d16(spark, sf_dir):
    return monitoring.distributions(_events(spark, sf_dir).filter("split = 'test'")).withColumn("share", F.round("share", 9))


_NUMBERS = [("unknown_count", "unknown"), ("candidate_count", "cc"), ("score_entropy", "entropy"), ("total_latency_ms", "0"), ("stage_latency_ms.total", "0")]


@query(
    "d17_numeric_summaries",
    f"{_EVENT_SQL} "
    + " UNION ALL ".join(
        f"SELECT '{n}' AS name, count(*) AS count, round(avg(x), 6) AS mean, round(min(x), 6) AS min, round(max(x), 6) AS max, round(quantile_cont(x, 0.5), 6) AS p50, round(quantile_cont(x, 0.95), 6) AS p95 FROM (SELECT CAST({c} AS DOUBLE) AS x FROM ev2 WHERE split = 'test')"
        for n, c in _NUMBERS
    ),
)
def d17(spark, sf_dir):
    rows = monitoring.numeric_summaries(_events(spark, sf_dir).filter("split = 'test'"))
    return rows.select("name", "count", *(F.round(c, 6).alias(c) for c in ("mean", "min", "max", "p50", "p95")))


@query("d18_drift", f"{_DIST_SQL}, {_DRIFT_SQL.format(ref='sh WHERE split = ' + chr(39) + 'validation' + chr(39), cur='sh WHERE split = ' + chr(39) + 'test' + chr(39))}")
def d18(spark, sf_dir):
    rows = monitoring.drift_between(_events(spark, sf_dir), "split", "validation", "test")
    return rows.select("dimension", F.round("js", 9).alias("js"), F.round("psi", 9).alias("psi"), "alert")


_INJECTED_SQL = """top AS (SELECT key FROM ds WHERE split = 'test' AND dimension = 'history_length' ORDER BY weight DESC, list_position(['0', '1', '2-5', '6-10', '11-20', '21-50', '51-100', '101+'], key) LIMIT 1),
dx AS (SELECT split, dimension, CASE WHEN split <> 'test' THEN key WHEN dimension = 'category' THEN 'category_' || substr(sha256('injected-drift'), 1, 16)
  WHEN dimension = 'history_length' AND key = (SELECT key FROM top) THEN CASE key WHEN '101+' THEN '51-100' ELSE '101+' END ELSE key END AS key, sum(weight) AS weight FROM ds GROUP BY ALL),
shx AS (SELECT *, weight / sum(weight) OVER (PARTITION BY split, dimension) AS share FROM dx)"""


@query("j2_replay_injected", f"{_DIST_SQL}, {_INJECTED_SQL}, {_DRIFT_SQL.format(ref='shx WHERE split = ' + chr(39) + 'validation' + chr(39), cur='shx WHERE split = ' + chr(39) + 'test' + chr(39))}")
def j2(spark, sf_dir):
    events = _events(spark, sf_dir).persist()
    rows = monitoring.replay(events.filter("split = 'validation'"), events.filter("split = 'test'"), inject=True)
    return rows.select("dimension", F.round("js", 9).alias("js"), F.round("psi", 9).alias("psi"), "alert")


@query("c4_unknown_history", f"WITH {L_SQL}, {INDEX_SQL}, {EXAMPLES_SQL} SELECT unknown AS unknown_count, count(*) AS n FROM (SELECT hi.sid, count(*) FILTER (WHERE poi.p IS NULL OR hi.p LIKE '%7') AS unknown FROM hi LEFT JOIN poi USING (p) GROUP BY 1) GROUP BY 1")
def c4(spark, sf_dir):
    e = l_view(spark, sf_dir)
    rows = examples.build_examples(_rest(e), PROTOCOL).dropDuplicates(["sample_id"])
    known = _train(e).select(F.col("raw_poi_id").alias("poi_id")).filter(~F.col("poi_id").endswith("7")).distinct()  # some are held back
    counts = monitoring.unknown_history(examples.requests_of(rows), known)
    return counts.groupBy("unknown_count").agg(F.count("*").alias("n"))


@query("d21_latency", "SELECT event_type, count(value) AS count, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(max(value), 6) AS max FROM events GROUP BY 1")
def d21(spark, sf_dir):
    rows = metrics.latency_summary(spark.read.parquet(f"{sf_dir}/events.parquet"), "value", ["event_type"])
    return rows.select("event_type", "count", *(F.round(c, 6).alias(c) for c in ("mean", "p50", "p95", "max")))


_ENDPOINTS = ["click", "view", "purchase", "signup"]


@query(
    "d22_endpoint_metrics",
    f"SELECT k.endpoint, count(x) AS requests, round(coalesce(sum(x), 0), 3) AS latency_sum, round(coalesce(avg(x), 0), 3) AS latency_avg, round(coalesce(max(x), 0), 3) AS latency_max FROM (SELECT unnest({[*_ENDPOINTS, 'other']}) AS endpoint) k "
    f"LEFT JOIN (SELECT CASE WHEN event_type IN ({', '.join(repr(x) for x in _ENDPOINTS)}) THEN event_type ELSE 'other' END AS endpoint, value AS x FROM events) USING (endpoint) GROUP BY 1",
)
def d22(spark, sf_dir):
    log = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("endpoint"), F.col("value").alias("latency_ms"))
    return metrics.endpoint_metrics(log, _ENDPOINTS)


@query(
    "d22_status_classes",
    "SELECT k.status_class, count(e.status_class) AS responses FROM (SELECT unnest(['2xx', '4xx', '5xx']) AS status_class) k LEFT JOIN (SELECT CASE user_id % 10 WHEN 0 THEN '4xx' ELSE '2xx' END AS status_class FROM events) e USING (status_class) GROUP BY 1",
)
def d22b(spark, sf_dir):
    status = F.when(F.col("user_id") % 10 == 0, 404).otherwise(200)
    return metrics.status_classes(spark.read.parquet(f"{sf_dir}/events.parquet").select(status.alias("status")))
