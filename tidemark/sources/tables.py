"""Readers: typed Parquet and CSV scans, series from events, values that are not finite made null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Names that a series file may give its start column, the first present one wins.
START_COLUMNS = ("start_date", "date", "Date", "MapDate", "Month")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def finite(value: Column) -> Column:
    """NaN and infinities as null, so that aggregates skip them as missing."""
    return F.when(~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), value)


def coerce(value: Column) -> Column:
    """A string or number as a finite double, or null where it is none."""
    return finite(value.cast("string").try_cast("double"))


def hourly_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(domain, start_ts, ot): hourly sums of events' values, one series per event type.

    Sums are taken in decimals, so that they don't depend on the order of rows.
    """
    events = table(spark, sf_dir, "events").select("event_type", "ts", "value")
    hour = F.date_trunc("hour", "ts").cast("timestamp")
    return events.groupBy(F.col("event_type").alias("domain"), hour.alias("start_ts")).agg(F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("ot"))


#: The series that events make up, in order.
DOMAINS = ("click", "error", "purchase", "signup", "view")


def dated_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fact_id, domain, source, end_ts, fact): errors are reports, purchases search results, props their text; users are
    dealt to domains."""
    events = table(spark, sf_dir, "events").where(F.col("event_type").isin("error", "purchase"))
    source = F.when(F.col("event_type") == "error", "report").otherwise("search")
    domain = F.element_at(F.array(*map(F.lit, DOMAINS)), (F.col("user_id") % len(DOMAINS) + 1).cast("int"))
    return events.select(F.col("event_id").alias("fact_id"), domain.alias("domain"), source.alias("source"), F.col("ts").cast("timestamp").alias("end_ts"), F.col("props").alias("fact"))


#: The most columns of a file that has a header of its own.
MOST_COLUMNS = 256


def read_untyped_csv(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, file_row, cells) of CSV files, each with a header of its own: cells maps its columns to texts, all untyped.

    A file is one split, so that file_row, its order of lines, is the order in it. Empty cells are null; cells beyond a
    file's header, and a file without lines, give nothing. A file of more columns than MOST_COLUMNS fails the job.
    """
    names = [f"c{k}" for k in range(MOST_COLUMNS + 1)]
    raw = spark.read.schema(", ".join(f"{n} string" for n in names)).option("header", False).option("multiLine", True).option("escape", '"').csv(paths)
    rows = raw.select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("file_row"), F.array(*names).alias("values"))
    head = rows.groupBy("file").agg(F.min(F.struct("file_row", "values")).alias("h"))
    head = head.select("file", F.col("h.file_row").alias("_first"), F.when(F.get("h.values", F.lit(MOST_COLUMNS)).isNull(), F.filter("h.values", lambda v: v.isNotNull())).otherwise(F.raise_error(F.lit("too many columns"))).alias("_names"))
    body = rows.join(head, "file").where(F.col("file_row") > F.col("_first"))
    return body.select("file", "file_row", F.map_from_arrays("_names", F.slice("values", F.lit(1), F.size("_names"))).alias("cells"))


def read_series_csv(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(domain, start_ts, end_ts, ot, channels, file_row) of series files: domain is the folder, channels the other columns.

    Every cell is read as text and coerced, so that one odd cell makes one null. Files may differ in their columns: the
    first name of START_COLUMNS that a file has is its start. A file without one, or without OT, raises ValueError.
    """
    raw = read_untyped_csv(spark, paths)
    has = lambda c: F.array_contains(F.map_keys("cells"), c)
    some_start = F.exists(F.map_keys("cells"), lambda k: k.isin(*START_COLUMNS))
    lacking = raw.where(~some_start | ~has("OT")).select("file", F.map_keys("cells").alias("names")).first()
    if lacking:
        raise ValueError(f"a series needs one of {START_COLUMNS} and OT; {lacking['file']} has {lacking['names']}")
    cell = lambda c: F.element_at("cells", F.lit(c))
    start = F.when(F.lit(False), F.lit(None).cast("string"))
    for c in START_COLUMNS:
        start = start.when(has(c), cell(c))
    # The names that are no channels: the start that counts, the end, the target.
    own = F.element_at(F.filter(F.array(*map(F.lit, START_COLUMNS)), lambda c: F.array_contains(F.map_keys("cells"), c)), 1)
    end = F.when(has("end_date"), cell("end_date")).otherwise(start)
    channels = F.transform_values(F.map_filter("cells", lambda k, v: (k != own) & ~k.isin("OT", "end_date")), lambda k, v: coerce(v))
    domain = F.element_at(F.split("file", "/"), -2)
    return raw.select(domain.alias("domain"), F.try_to_timestamp(start).alias("start_ts"), F.try_to_timestamp(end).alias("end_ts"), coerce(cell("OT")).alias("ot"), channels.alias("channels"), "file_row")


def read_text_csv(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(domain, source, start_ts, end_ts, fact) of text files named <domain>_<source>.csv. Prediction columns are never read."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(paths)
    missing = {"start_date", "end_date", "fact"} - set(raw.columns)
    if missing:
        raise ValueError(f"text files lack {sorted(missing)}")
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)\.csv$", 1)
    return raw.select(
        F.element_at(F.split(F.input_file_name(), "/"), -2).alias("domain"), F.element_at(F.split(name, "_"), -1).alias("source"),
        F.try_to_timestamp("start_date").alias("start_ts"), F.try_to_timestamp("end_date").alias("end_ts"), "fact",
    )


def file_digests(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, bytes, sha256) of the files below a folder: a manifest to compare with a stored one."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def read_lists(df: DataFrame, *columns: str) -> DataFrame:
    """df with JSON lists of texts in these columns as arrays; a null or broken list is null."""
    return df.withColumns({c: F.from_json(c, "array<string>") for c in columns})


def read_settings(spark: SparkSession, path: str) -> DataFrame:
    """(domain, input_len, horizons, seasonal_period) of a JSON file of settings by domain."""
    schema = "domains map<string,struct<input_len:int,horizons:array<int>,seasonal_period:int>>"
    raw = spark.read.schema(schema).json(path, multiLine=True)
    return raw.select(F.explode("domains").alias("domain", "s")).select("domain", "s.*")


def task_grid(settings: DataFrame, folds: int) -> DataFrame:
    """Every task of the settings: domain, input_len, seasonal_period, horizon, fold, and the length of its blocks."""
    each = settings.withColumn("horizon", F.explode("horizons")).withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(folds)))).drop("horizons")
    return each.withColumn("block", F.greatest("horizon", F.least("seasonal_period", F.lit(24))))
