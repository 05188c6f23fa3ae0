"""Queries on dated and undated text, point-in-time joins and vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions.text import FUTURE_WORDS, is_valid, normalise, tells_future
from tidemark.operators import pit, terms
from tidemark.plans import query
from tidemark.plans.series import SERIES_SQL, positioned, rounded
from tidemark.sources.shared import spread
from tidemark.sources.tables import DOMAINS, dated_facts, table

#: Documents say nothing of the future and none is missing: some are made so by doc_id, in queries and SQL alike.
DOCS_SQL = """raw AS (SELECT doc_id, source, lang AS domain, CASE WHEN doc_id % 7 = 0 THEN ' NA ' || split_part(text, chr(10), 1) WHEN doc_id % 11 = 0 THEN '   ' WHEN doc_id % 13 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN text || ' will' ELSE text END AS fact,
TIMESTAMP '2020-01-01' + to_days(CAST(doc_id % 365 AS INT)) AS start_ts, TIMESTAMP '2020-01-01' + to_days(CAST(doc_id % 365 + doc_id % 4 AS INT)) AS end_ts FROM documents)"""
VALID_SQL = "NOT regexp_full_match(coalesce(fact, ''), '(?is)^[ \\t\\n\\r]*(NA\\b[^\\n]*)?$')"
FUTURE_SQL = "regexp_matches(fact, '(?i)\\b(?:" + "|".join(FUTURE_WORDS) + ")\\b')"
CORPUS_SQL = (
    DOCS_SQL
    + f""", clean AS (SELECT doc_id, domain, source, start_ts, end_ts, regexp_replace(regexp_replace(fact, '\\s+', ' ', 'g'), '^ | $', '', 'g') AS fact FROM raw WHERE {VALID_SQL}),
corpus AS (SELECT *, substr(sha1(concat_ws('|', domain, source, strftime(start_ts, '%Y-%m-%dT%H:%M:%S'), strftime(end_ts, '%Y-%m-%dT%H:%M:%S'), fact)), 1, 16) AS text_id FROM clean
 QUALIFY row_number() OVER (PARTITION BY domain, source, fact ORDER BY end_ts, start_ts, doc_id) = 1)"""
)


def raw_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.col("lang").alias("domain"), "text")
    k = F.col("doc_id")
    fact = (
        F.when(k % 7 == 0, F.concat(F.lit(" NA "), F.substring_index("text", "\n", 1))).when(k % 11 == 0, "   ").when(k % 13 == 0, F.lit(None).cast("string")).when(k % 5 == 0, F.concat("text", F.lit(" will"))).otherwise(F.col("text"))
    )
    day = lambda n: (F.lit("2020-01-01").cast("timestamp") + F.make_dt_interval(n.cast("int")))
    return docs.select("doc_id", k.alias("fact_id"), "domain", "source", fact.alias("fact"), day(k % 365).alias("start_ts"), day(k % 365 + k % 4).alias("end_ts"))


@query(f"""WITH {DOCS_SQL} SELECT source, count(*) AS rows, count(*) FILTER ({VALID_SQL}) AS usable, round(100.0 * count(*) FILTER (NOT ({VALID_SQL})) / count(*), 3) AS missing_pct,
count(DISTINCT CASE WHEN {VALID_SQL} THEN fact END) AS distinct_facts, CAST(median(length(fact)) FILTER ({VALID_SQL}) AS DOUBLE) AS median_length FROM raw GROUP BY source""")
def valid_text_audit(spark, sf_dir):
    texts = raw_texts(spark, sf_dir).withColumn("valid", is_valid(F.col("fact")))
    fact = F.when(F.col("valid"), F.col("fact"))
    return texts.groupBy("source").agg(
        F.count("*").alias("rows"), F.count_if("valid").alias("usable"), F.round(100.0 * F.count_if(~F.col("valid")) / F.count("*"), 3).alias("missing_pct"), F.countDistinct(fact).alias("distinct_facts"), F.median(F.length(fact)).alias("median_length")
    )


@query(f"""WITH {DOCS_SQL} SELECT domain, count(*) AS rows, count(*) FILTER ({FUTURE_SQL}) AS flagged, round(100.0 * count(*) FILTER ({FUTURE_SQL}) / count(*), 6) AS flagged_pct FROM raw GROUP BY domain""")
def future_language(spark, sf_dir):
    texts = raw_texts(spark, sf_dir).withColumn("flag", tells_future(F.col("fact")))
    return texts.groupBy("domain").agg(F.count("*").alias("rows"), F.count_if("flag").alias("flagged"), rounded(100.0 * F.count_if("flag") / F.count("*")).alias("flagged_pct"))


@query(f"WITH {CORPUS_SQL} SELECT text_id, domain, source, doc_id, length(fact) AS characters, {FUTURE_SQL} AS future FROM corpus")
def dedup_facts(spark, sf_dir):
    return pit.corpus(raw_texts(spark, sf_dir)).select("text_id", "domain", "source", "doc_id", F.col("characters").cast("long").alias("characters"), "future")


@query(f"""WITH {CORPUS_SQL}, a AS (SELECT domain, count(*) AS raw_rows, count(*) FILTER ({VALID_SQL}) AS valid_rows FROM raw GROUP BY domain),
b AS (SELECT domain, count(*) AS kept_rows, round(100.0 * count(*) FILTER ({FUTURE_SQL}) / count(*), 3) AS future_pct, count(*) - count(DISTINCT text_id) AS id_collisions FROM corpus GROUP BY domain) SELECT * FROM a JOIN b USING (domain)""")
def corpus_audit(spark, sf_dir):
    raw = raw_texts(spark, sf_dir)
    before = raw.groupBy("domain").agg(F.count("*").alias("raw_rows"), F.count_if(is_valid(F.col("fact"))).alias("valid_rows"))
    after = pit.corpus(raw).groupBy("domain").agg(F.count("*").alias("kept_rows"), F.round(100.0 * F.count_if("future") / F.count("*"), 3).alias("future_pct"), (F.count("*") - F.countDistinct("text_id")).alias("id_collisions"))
    return before.join(after, "domain")


@query("""WITH t AS (SELECT doc_id, source, lang, text FROM documents), r AS (SELECT source, lang, text, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS k FROM t)
SELECT source, lang, count(*) AS facts, sha256(string_agg(regexp_replace(text, '\\s+', ' ', 'g'), ' [SEP] ' ORDER BY k)) AS digest FROM r WHERE k <= 32 GROUP BY source, lang""")
def assembled_documents(spark, sf_dir):
    """The first 32 facts of each source and language, joined in order, as a digest."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.regexp_replace("text", "\\s+", " ").alias("fact"))
    first = docs.withColumn("k", F.row_number().over(pit.W.partitionBy("source", "lang").orderBy("doc_id"))).where("k <= 32")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "fact"))), lambda x: x["fact"]), " [SEP] ")
    return first.groupBy("source", "lang").agg(F.count("*").alias("facts"), F.sha2(joined, 256).alias("digest"))


FACTS_SQL = "facts AS (SELECT event_id AS fact_id, CASE user_id % 5 " + " ".join(f"WHEN {k} THEN '{d}'" for k, d in enumerate(DOMAINS)) + " END AS domain, CASE WHEN event_type = 'error' THEN 'report' ELSE 'search' END AS source, ts AS end_ts, props AS fact FROM events WHERE event_type IN ('error', 'purchase'))"
#: Rows of history of an origin and facts kept per source.
HISTORY, KEEP = 24, 4
PIT_SQL = (
    SERIES_SQL
    + ", "
    + FACTS_SQL
    + f""", o AS (SELECT domain, i, n, lag(start_ts, {HISTORY}) OVER (PARTITION BY domain ORDER BY i) AS history_start, start_ts AS cutoff FROM series QUALIFY history_start IS NOT NULL),
pairs AS (SELECT o.domain, i, history_start, cutoff, source, fact_id, fact, end_ts, row_number() OVER (PARTITION BY o.domain, i, source ORDER BY end_ts DESC, fact_id) AS rank, (epoch_us(cutoff) - epoch_us(end_ts)) / 86400e6 AS age FROM o JOIN facts f ON o.domain = f.domain AND f.end_ts >= history_start AND f.end_ts < cutoff),
agg AS (SELECT domain, i, count(*) FILTER (source = 'report') AS report_available, count(*) FILTER (source = 'search') AS search_available, count(*) FILTER (source = 'report' AND rank <= {KEEP}) AS report_selected, count(*) FILTER (source = 'search' AND rank <= {KEEP}) AS search_selected,
 string_agg(CAST(fact_id AS VARCHAR), ',' ORDER BY rank) FILTER (source = 'report' AND rank <= {KEEP}) AS report_ids, string_agg(CAST(fact_id AS VARCHAR), ',' ORDER BY rank) FILTER (source = 'search' AND rank <= {KEEP}) AS search_ids,
 min(age) FILTER (rank <= {KEEP}) AS latest_age, avg(age) FILTER (rank <= {KEEP}) AS mean_age, avg(CASE WHEN source = 'report' AND rank <= {KEEP} THEN CASE WHEN fact LIKE '%7%' THEN 1.0 ELSE 0.0 END END) AS report_future, avg(CASE WHEN source = 'search' AND rank <= {KEEP} THEN CASE WHEN fact LIKE '%7%' THEN 1.0 ELSE 0.0 END END) AS search_future FROM pairs GROUP BY domain, i),
idx AS (SELECT o.domain, o.i, n, history_start, cutoff, coalesce(report_available, 0) AS report_available, coalesce(search_available, 0) AS search_available, coalesce(report_selected, 0) AS report_selected, coalesce(search_selected, 0) AS search_selected,
 coalesce(report_ids, '') AS report_ids, coalesce(search_ids, '') AS search_ids, latest_age, mean_age, report_future, search_future FROM o LEFT JOIN agg USING (domain, i))"""
)


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pit.text_index(pit.origins(positioned(spark, sf_dir), HISTORY), dated_facts(spark, sf_dir), KEEP, fact_id="fact_id")


@query(f"""WITH {PIT_SQL} SELECT domain, i, report_available, search_available, CAST(report_selected AS INT) AS report_selected, CAST(search_selected AS INT) AS search_selected, report_ids, search_ids, round(latest_age, 6) AS latest_age, round(mean_age, 6) AS mean_age FROM idx""")
def pit_topk(spark, sf_dir):
    joined = {f"{s}_ids": F.array_join(f"{s}_ids", ",") for s in pit.SOURCES}
    return index(spark, sf_dir).withColumns(joined).select(
        "domain", "i", *(f"{s}_available" for s in pit.SOURCES), *(f"{s}_selected" for s in pit.SOURCES), *(f"{s}_ids" for s in pit.SOURCES), F.round("latest_age", 6).alias("latest_age"), F.round("mean_age", 6).alias("mean_age")
    )


@query(f"""WITH {SERIES_SQL}, spans AS (SELECT domain, i, start_ts, start_ts + INTERVAL 1 HOUR AS end_ts FROM series), {FACTS_SQL}, iv AS (SELECT domain, end_ts AS s, end_ts + to_hours(CAST(fact_id % 40 AS INT)) AS e FROM facts)
SELECT sp.domain, i, count(iv.s) AS n_overlaps FROM spans sp LEFT JOIN iv ON sp.domain = iv.domain AND start_ts <= e AND s <= end_ts GROUP BY sp.domain, i""")
def interval_overlap(spark, sf_dir):
    spans = positioned(spark, sf_dir).select("domain", "i", "start_ts", (F.col("start_ts") + F.expr("INTERVAL 1 HOUR")).alias("end_ts"))
    facts = dated_facts(spark, sf_dir).select("domain", F.col("end_ts").alias("start_ts"), (F.col("end_ts") + F.make_dt_interval(F.lit(0), (F.col("fact_id") % 40).cast("int"))).alias("end_ts"))
    return pit.overlap_counts(spans, facts, "i").select("domain", "i", "n_overlaps")


@query(f"""WITH {PIT_SQL}, h(horizon) AS (VALUES (6), (12), (24)), s AS (SELECT *, CASE WHEN i + horizon <= floor(n * 0.7::DOUBLE) THEN 'train' WHEN i >= floor(n * 0.7::DOUBLE) AND i + horizon <= floor(n * 0.8::DOUBLE) THEN 'validation' WHEN i >= floor(n * 0.8::DOUBLE) AND i + horizon <= n THEN 'test' END AS split FROM idx, h)
SELECT domain, horizon, split, count(*) AS origins, round(100.0 * avg(CASE WHEN report_available + search_available > 0 THEN 1.0 ELSE 0.0 END), 6) AS covered_pct, round(median(report_selected + search_selected), 6) AS median_selected, round(median(latest_age), 6) AS median_latest_age FROM s WHERE split IS NOT NULL GROUP BY domain, horizon, split""")
def coverage(spark, sf_dir):
    rows = index(spark, sf_dir).join(positioned(spark, sf_dir).select("domain", "n").distinct(), "domain").withColumn("horizon", F.explode(F.array(F.lit(6), F.lit(12), F.lit(24))))
    a, b, n, end = pit_cut("n", 0.7), pit_cut("n", 0.8), F.col("n"), F.col("i") + F.col("horizon")
    split = F.when(end <= a, "train").when((F.col("i") >= a) & (end <= b), "validation").when((F.col("i") >= b) & (end <= n), "test")
    rows = rows.withColumn("split", split).where("split is not null")
    some = ((F.col("report_available") + F.col("search_available")) > 0).cast("double")
    return rows.groupBy("domain", "horizon", "split").agg(F.count("*").alias("origins"), F.round(100.0 * F.avg(some), 6).alias("covered_pct"), F.round(F.median(F.col("report_selected") + F.col("search_selected")), 6).alias("median_selected"), F.round(F.median("latest_age"), 6).alias("median_latest_age"))


def pit_cut(n: str, fraction: float):
    return F.floor(F.col(n) * F.lit(fraction))


@query(f"""WITH {PIT_SQL}, d AS (SELECT *, greatest(floor((epoch_us(cutoff) - epoch_us(history_start)) / 86400e6), 1.0) AS days FROM idx)
SELECT domain, i, round(ln(1 + report_available), 6) AS report_log_available, round(ln(1 + search_available), 6) AS search_log_available, round(ln(1 + report_selected), 6) AS report_log_selected, round(ln(1 + search_selected), 6) AS search_log_selected,
CASE WHEN report_selected = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS report_missing, CASE WHEN search_selected = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS search_missing, round(coalesce(latest_age / days, 1.0), 6) AS latest_age_ratio, round(coalesce(mean_age / days, 1.0), 6) AS mean_age_ratio,
round(coalesce(report_future, 0.0), 6)::DOUBLE AS report_future_fraction, round(coalesce(search_future, 0.0), 6)::DOUBLE AS search_future_fraction FROM d""")
def quality_features(spark, sf_dir):
    """Ten features of each origin's texts; facts that hold a 7 stand for those that tell of the future."""
    pairs = pit.top_facts(pit.eligible(pit.origins(positioned(spark, sf_dir), HISTORY), dated_facts(spark, sf_dir)), KEEP, "fact_id")
    flag = F.contains("fact", F.lit("7")).cast("double")
    future = pairs.groupBy("domain", "i").agg(*(F.avg(F.when(F.col("source") == s, flag)).alias(f"{s}_future") for s in pit.SOURCES))
    out = pit.quality(index(spark, sf_dir), future)
    return out.select("domain", "i", *(F.round(c, 6).alias(c) for c in out.columns[2:]))


@query("""WITH w AS (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS e, exp(-ln(2) * (vec_id % 30) / greatest(30 / 4, 1)) AS w FROM embeddings),
p AS (SELECT label, pos, sum(w * e[pos]) / sum(w) AS m FROM w, range(1, 65) t(pos) GROUP BY label, pos), n AS (SELECT label, sqrt(sum(m * m)) AS norm FROM p GROUP BY label)
SELECT label, CAST(pos - 1 AS INT) AS pos, round(CASE WHEN norm > 1e-8 THEN m / norm ELSE m END, 6) + 0.0 AS value FROM p JOIN n USING (label)""")
def weighted_embedding(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("embedding"), pit.decay(F.col("vec_id") % 30, F.lit(30.0)).alias("w"))
    return pit.weighted_mean(vectors, ["label"]).select("label", F.posexplode("mean").alias("pos", "v")).select("label", "pos", rounded("v").alias("value"))


@query("""SELECT d.source, count(*) AS facts, count(l.doc_id) AS reused, count(*) - count(l.doc_id) AS to_encode FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY d.source""")
def encode_split(spark, sf_dir):
    """Facts whose vector is known already, by id, and those still to encode."""
    docs, known = table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels").select("doc_id").distinct()
    split = docs.join(known.withColumn("old", F.lit(True)), "doc_id", "left").withColumn("old", F.coalesce("old", F.lit(False)))
    return split.groupBy("source").agg(F.count("*").alias("facts"), F.count_if("old").alias("reused"), F.count_if(~F.col("old")).alias("to_encode"))


TFIDF_SQL = """w AS (SELECT doc_id, pos, tok FROM (SELECT doc_id, generate_subscripts(t, 1) AS pos, unnest(t) AS tok FROM (SELECT doc_id, regexp_extract_all(lower(translate(text, 'áéíóúñäöüàèçêÉÁÍÓÚÑÄÖÜÀÈÇÊ', 'aeiounaouaeceEAIOUNAOUAECE')), '[a-z0-9]{2,}') AS t FROM documents))),
g AS (SELECT doc_id, tok AS term FROM w UNION ALL SELECT a.doc_id, a.tok || ' ' || b.tok FROM w a JOIN w b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1),
tf AS (SELECT doc_id, term, count(*) AS c FROM g GROUP BY doc_id, term), df AS (SELECT term, count(*) AS df, sum(c) AS total FROM tf GROUP BY term HAVING count(*) >= 2 ORDER BY total DESC, term LIMIT 1024),
n AS (SELECT count(*) AS n FROM documents), x AS (SELECT doc_id, term, (1 + ln(c)) * (ln((1 + n) / (1 + df)) + 1) AS x FROM tf JOIN df USING (term), n)"""


@query(f"""WITH {TFIDF_SQL} SELECT doc_id, count(*) AS terms, round(max(x) / sqrt(sum(x * x)), 6) AS top_weight, arg_max(term, (x, term)) AS top_term FROM x GROUP BY doc_id""")
def tfidf(spark, sf_dir):
    """Unit TF-IDF vectors of words and word pairs, as each document's number of terms and its weightiest one."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", terms.plain("text").alias("text"))
    known = terms.vocabulary(docs)
    n = docs.count()

    def run(batches):
        place, idf = {t: k for k, (t, _) in enumerate(known)}, terms.idf_of(np.array([df for _, df in known], float), n)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                at, w = terms.weights(text, place, idf)
                if len(w):
                    # The weightiest, the last in order among equals to twelve digits
                    k, top = max(zip(at.tolist(), w.tolist()), key=lambda x: (round(x[1], 12), known[x[0]][0]))
                    out.append((doc_id, len(w), top, known[k][0]))
            yield pa.RecordBatch.from_pylist([dict(zip(("doc_id", "terms", "top_weight", "top_term"), r)) for r in out], schema=pa.schema([("doc_id", pa.int64()), ("terms", pa.int64()), ("top_weight", pa.float64()), ("top_term", pa.string())]))

    return docs.mapInArrow(run, "doc_id long, terms long, top_weight double, top_term string").withColumn("top_weight", rounded("top_weight"))
