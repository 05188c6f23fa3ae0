"""Queries on keys, sets and versions of result tables."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from tidemark.plans import query
from tidemark.plans.forecast import LONG_SQL, error_table
from tidemark.plans.series import rounded
from tidemark.sources.tables import table


@query("""WITH t AS (SELECT event_type AS task, count(*) AS n FROM events GROUP BY 1) SELECT task, n AS rows, round(sum(n) OVER () / (count(*) OVER () * n), 6) AS weight FROM t""")
def balanced_weights(spark, sf_dir):
    """The weight of a task's rows that makes every task weigh the same in a sum; the window runs over a row per task."""
    by = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("task")).agg(F.count("*").alias("rows"))
    every = W.partitionBy()
    return by.select("task", "rows", F.round(F.sum("rows").over(every) / (F.count("*").over(every) * F.col("rows")), 6).alias("weight"))


@query("""WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders), b AS (SELECT DISTINCT c_custkey AS k FROM customer)
SELECT (SELECT count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b)) AS only_left, (SELECT count(*) FROM (SELECT k FROM b EXCEPT SELECT k FROM a)) AS only_right, (SELECT count(*) FROM (SELECT k FROM a INTERSECT SELECT k FROM b)) AS shared""")
def key_set_difference(spark, sf_dir):
    """Keys that two tables don't share: both counts are 0 if the sets are equal."""
    a = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")).distinct().withColumn("in_a", F.lit(1))
    b = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).distinct().withColumn("in_b", F.lit(1))
    both = a.join(b, "k", "full")
    left, right = F.col("in_a").isNotNull(), F.col("in_b").isNotNull()
    return both.agg(F.count_if(left & ~right).alias("only_left"), F.count_if(right & ~left).alias("only_right"), F.count_if(left & right).alias("shared"))


@query("""WITH a AS (SELECT lang AS domain, doc_id // 1000 AS k, count(*) AS n, sha256(string_agg(doc_id || chr(31) || sha256(text), chr(10) ORDER BY doc_id)) AS h FROM documents GROUP BY ALL), b AS (SELECT domain, k // 1000 AS k, sum(n) AS n, sha256(string_agg(h, chr(10) ORDER BY k)) AS h FROM a GROUP BY domain, k // 1000)
SELECT domain, CAST(sum(n) AS BIGINT) AS facts, sha256(string_agg(h, chr(10) ORDER BY k)) AS digest FROM b GROUP BY domain""")
def corpus_digest(spark, sf_dir):
    """One digest per domain over ids and texts in order: of ids and digests of texts by the thousand, of a thousand such
    digests, and of these. No group holds more than a thousand lines, but for the last, one line for a million ids."""
    rows = table(spark, sf_dir, "documents").select(F.col("lang").alias("domain"), F.col("doc_id").alias("k"), F.lit(1).alias("n"), F.concat(F.col("doc_id").cast("string"), F.lit("\x1f"), F.sha2("text", 256)).alias("h"))
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "h"))), lambda x: x["h"]), "\n")
    for _ in range(2):
        rows = rows.groupBy("domain", F.floor(F.col("k") / 1000).alias("up")).agg(F.sum("n").alias("n"), F.sha2(ordered, 256).alias("h")).withColumnRenamed("up", "k")
    return rows.groupBy("domain").agg(F.sum("n").alias("facts"), F.sha2(ordered, 256).alias("digest"))


@query(f"""WITH {LONG_SQL}, v AS (SELECT *, CASE WHEN horizon = 24 THEN mse * 0.9 ELSE mse END AS other FROM e)
SELECT domain, horizon, model, round(mse, 6) AS mse_old, round(other, 6) AS mse_new, round(100 * (mse - other) / mse, 6) + 0.0 AS change_pct, other < mse AS improved FROM v""")
def version_comparison(spark, sf_dir):
    """A result table beside another version of it, joined on its keys; the other version is the first one, altered."""
    old = error_table(spark, sf_dir).select("domain", "horizon", "model", "mse")
    new = old.withColumn("mse", F.when(F.col("horizon") == 24, F.col("mse") * 0.9).otherwise(F.col("mse")))
    both = old.withColumnRenamed("mse", "mse_old").join(new.withColumnRenamed("mse", "mse_new"), ["domain", "horizon", "model"])
    change = 100 * (F.col("mse_old") - F.col("mse_new")) / F.col("mse_old")
    return both.select("domain", "horizon", "model", rounded("mse_old").alias("mse_old"), rounded("mse_new").alias("mse_new"), rounded(change).alias("change_pct"), (F.col("mse_new") < F.col("mse_old")).alias("improved"))


@query("""SELECT n_name, count(*) AS suppliers, count(s_acctbal) AS with_balance, round(coalesce(sum(s_acctbal), 0), 2) AS balance FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey WHERE r_name <> 'AFRICA' GROUP BY n_name""")
def chained_join(spark, sf_dir):
    """A chain of equal joins that keeps nations without a supplier."""
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region").where("r_name <> 'AFRICA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = nations.join(table(spark, sf_dir, "supplier"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return rows.groupBy("n_name").agg(F.count("*").alias("suppliers"), F.count("s_acctbal").alias("with_balance"), F.round(F.coalesce(F.sum("s_acctbal"), F.lit(0.0)), 2).alias("balance"))


@query("""WITH r AS (SELECT conv_id, turn, role, length(text) AS n, lag(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS before, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS so_far FROM conversations)
SELECT conv_id, turn, role, n, coalesce(n - before, 0) AS step, CAST(so_far AS BIGINT) AS so_far FROM r""")
def turn_steps(spark, sf_dir):
    """Lag differences and running sums over the turns of a conversation."""
    w = W.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").cast("long").alias("n"))
    return rows.withColumn("step", F.coalesce(F.col("n") - F.lag("n").over(w), F.lit(0))).withColumn("so_far", F.sum("n").over(w))
