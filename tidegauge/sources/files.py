"""Provider payloads: readers over landing folders and parsers over text columns.

Readers use Spark's CSV, JSON and XML sources; parsers are `from_csv` / `from_json` / `from_xml`
expressions, so a table of raw payloads is decoded where it lies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions import text as T
from tidegauge.functions.scalar import positive

ISO_DAY = r"^\d{4}-\d{2}-\d{2}$"
HISTORY_CSV = "Date string, Open string, High string, Low string, Close string, Volume string"
QUOTE_CSV = "Symbol string, Date string, Time string, Open string, High string, Low string, Close string, Volume string"
HISTORY_JSON = "date string, close double, adjClose double"
CHART_JSON = (
    "chart struct<result: array<struct<timestamp: array<bigint>, meta: struct<currency: string>, indicators: struct<"
    "quote: array<struct<close: array<double>>>, adjclose: array<struct<adjclose: array<double>>>>>>>")
FACT = "struct<start: string, `end`: string, val: double, fp: string, form: string>"
HITS_JSON = ("hits struct<hits: array<struct<_id: string, _source: struct<display_names: array<string>, form: string, "
             "file_date: string, cik: string>>>>")
RECENT_JSON = ("accessionNumber array<string>, form array<string>, filingDate array<string>, items array<string>, "
               "primaryDocument array<string>")

# Labels of the filing items worth showing, and the forms worth watching.
ITEM_LABELS = {
    "1.01": "Material agreement", "1.02": "Termination of material agreement",
    "2.01": "Completed acquisition/disposition", "2.02": "Results / guidance", "2.03": "New material debt",
    "2.05": "Costs from exit/disposal", "3.02": "Unregistered equity sale", "5.02": "Exec/board change",
    "7.01": "Reg FD disclosure", "8.01": "Other material event",
}
WATCH_FORMS = ["8-K", "8-K/A", "10-Q", "10-Q/A", "10-K", "10-K/A", "6-K", "20-F", "20-F/A"]
WATCH_FORMS_WIDE = [*WATCH_FORMS, "S-1", "S-1/A", "424B4", "424B5", "SC 13D", "SC 13D/A", "SC 13G", "SC 13G/A", "DEF 14A"]


def iso_day(c: Column) -> Column:
    return F.when(c.rlike(ISO_DAY), c.try_cast("date"))


def _bars(df: DataFrame, d: Column, close: Column, *keep: str) -> DataFrame:
    out = df.select(*keep, iso_day(d).alias("d"), positive(close).alias("close"))
    return out.where(F.col("d").isNotNull() & F.col("close").isNotNull())


# ---- price history -------------------------------------------------------------------------------------

def read_history_csv(spark: SparkSession, path: str) -> DataFrame:
    """Daily files named after their ticker, or in folders ticker=...; malformed lines are dropped row by row."""
    raw = spark.read.option("header", True).option("mode", "PERMISSIVE").schema(HISTORY_CSV).csv(path)
    return _bars(_named(raw, "csv"), F.col("Date"), F.col("Close"), "ticker")


def _named(raw: DataFrame, ending: str) -> DataFrame:
    """The ticker of a file's folder, or else of its name."""
    if "ticker" in raw.columns:
        return raw.withColumn("ticker", F.upper(F.col("ticker").cast("string")))
    return raw.withColumn("ticker", F.upper(F.regexp_extract(F.col("_metadata.file_name"), rf"^(.+?)(?:\.{ending}.*)?$", 1)))


def parse_history_lines(df: DataFrame, line: str, *keep: str) -> DataFrame:
    """History lines held in a column, with fewer than five fields or bad values dropped."""
    parsed = df.where(F.size(F.split(line, ",")) >= 5).withColumn("_r", F.from_csv(F.col(line), HISTORY_CSV))
    return _bars(parsed, F.col("_r.Date"), F.col("_r.Close"), *keep)


def parse_quote_lines(df: DataFrame, line: str, *keep: str) -> DataFrame:
    """Last-quote lines: a bad price drops the row, a bad date only leaves `as_of` null."""
    r = df.withColumn("_r", F.from_csv(F.col(line), QUOTE_CSV))
    return r.select(*keep, positive(F.col("_r.Close")).alias("price"), iso_day(F.col("_r.Date")).alias("as_of")).where(
        F.col("price").isNotNull())


def read_history_json(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(HISTORY_JSON).json(path)
    return _bars(_named(raw, "json"), F.substring("date", 1, 10), F.coalesce("adjClose", "close"), "ticker")


def parse_history_json(df: DataFrame, payload: str, *keep: str) -> DataFrame:
    """History objects held in a column; the adjusted close is preferred."""
    r = df.withColumn("_r", F.from_json(F.col(payload), HISTORY_JSON))
    return _bars(r, F.substring("_r.date", 1, 10), F.coalesce("_r.adjClose", "_r.close"), *keep)


def parse_chart(df: DataFrame, payload: str, *keep: str) -> DataFrame:
    """Chart payloads with parallel arrays; adjusted closes are used when they line up with the raw
    ones and are not all missing."""
    res = F.try_element_at(F.from_json(F.col(payload), CHART_JSON)["chart"]["result"], F.lit(1))
    raw = F.try_element_at(res["indicators"]["quote"], F.lit(1))["close"]
    adj = F.try_element_at(res["indicators"]["adjclose"], F.lit(1))["adjclose"]
    use_adj = (F.size(adj) == F.size(raw)) & F.exists(adj, lambda x: x.isNotNull())
    rows = df.select(*keep, res["timestamp"].alias("_t"), F.when(use_adj, adj).otherwise(raw).alias("_c"))
    points = rows.select(*keep, F.inline(F.arrays_zip("_t", "_c"))).where(F.col("_c") > 0)
    return points.select(*keep, F.to_date(F.timestamp_seconds("_t")).alias("d"), F.col("_c").alias("close"))


# ---- company facts ---------------------------------------------------------------------------------------

def parse_company_facts(df: DataFrame, payload: str, *keep: str, concepts: list[str] | None = None) -> DataFrame:
    """One row per reported value: concept, unit, period, value, fiscal period and form.

    The payload becomes a VARIANT once, and only the concepts asked for (all by default) are taken out of it, value by
    value: a payload that is no JSON, a concept of another shape or a value of another type costs itself, nothing else."""
    tvf = df.sparkSession.tvf
    get = lambda v, path, kind: F.try_variant_get(v, path, kind)
    body = df.select(*keep, F.try_parse_json(payload).alias("_v"))
    listed = body.select(*keep, F.coalesce(get(F.col("_v"), "$.cik", "string"), F.lit(None)).alias("cik"), get(F.col("_v"), "$.facts['us-gaap']", "variant").alias("_g"))
    if concepts is None:
        named = listed.lateralJoin(tvf.variant_explode(F.col("_g").outer())).select(*keep, "cik", F.col("key").alias("concept"), get(F.col("value"), "$.units", "variant").alias("_u"))
    else:
        one = lambda c: F.struct(F.lit(c).alias("concept"), get(F.col("_g"), f"$['{c}'].units", "variant").alias("_u"))
        named = listed.select(*keep, "cik", F.inline(F.array(*[one(c) for c in concepts])))
    units = named.where("_u is not null").lateralJoin(tvf.variant_explode(F.col("_u").outer())).select(*keep, "cik", "concept", F.col("key").alias("unit"), F.col("value").alias("_w"))
    values = units.lateralJoin(tvf.variant_explode(F.col("_w").outer())).select(*keep, "cik", "concept", "unit", F.col("value").alias("_x"))
    text = lambda name: get(F.col("_x"), f"$.{name}", "string")
    rows = values.select(*keep, "cik", "concept", "unit", iso_day(text("start")).alias("start_d"), iso_day(text("end")).alias("end_d"),
                         get(F.col("_x"), "$.val", "double").alias("val"), text("fp").alias("fp"), text("form").alias("form"))
    return rows.where("val is not null")


# ---- feeds -----------------------------------------------------------------------------------------------

def feed_day(c: Column) -> Column:
    """Day of an RSS date such as `Mon, 01 Jan 2001 00:00:00 GMT`."""
    return F.try_to_timestamp(F.regexp_extract(c, r"(\d{1,2} [A-Za-z]{3} \d{4})", 1), F.lit("d MMM yyyy")).cast("date")


def read_rss(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.format("xml").option("rowTag", "item").schema("title string, link string, pubDate string").load(path)
    return rss_items(raw)


def parse_rss(df: DataFrame, payload: str, *keep: str) -> DataFrame:
    r = df.withColumn("_r", F.from_xml(F.col(payload), "title string, link string, pubDate string"))
    return rss_items(r.select(*keep, "_r.*"), *keep)


def rss_items(raw: DataFrame, *keep: str) -> DataFrame:
    items = raw.select(*keep, T.decode_inline(F.coalesce("title", F.lit(""))).alias("title"),
                       T.decode_inline(F.coalesce("link", F.lit(""))).alias("link"), feed_day(F.col("pubDate")).alias("date"))
    return items.where(F.col("title") != "")


def read_atom(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.format("xml").option("rowTag", "entry").schema("title string, summary string, published string").load(path)
    plain = lambda c: T.squeeze(F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]+>", ""))
    return raw.select(plain("title").alias("title"), plain("summary").alias("summary"),
                      T.strip(F.col("published")).alias("published")).where(F.col("title") != "")


# ---- filings ---------------------------------------------------------------------------------------------

NAMED = r"^(.*?)\s+\(([A-Z0-9.\-]+)\)\s+\(CIK\s*(\d*)"


def parse_hit_counts(df: DataFrame, payload: str, *keep: str) -> DataFrame:
    """Mentions per named company over full-text-search payloads."""
    hit = df.select(*keep, F.explode(F.from_json(F.col(payload), HITS_JSON)["hits"]["hits"]).alias("_h"))
    names = hit.select(*keep, F.explode("_h._source.display_names").alias("_n")).where(F.col("_n").rlike(NAMED))
    return names.groupBy(*keep, F.regexp_extract("_n", NAMED, 2).alias("ticker")).agg(
        F.min(F.trim(F.regexp_extract("_n", NAMED, 1))).alias("company"), F.count("*").alias("mentions"))


def parse_hit_filings(df: DataFrame, payload: str, *keep: str) -> DataFrame:
    """Filing references out of the same payloads, with the document's address."""
    hit = df.select(*keep, F.explode(F.from_json(F.col(payload), HITS_JSON)["hits"]["hits"]).alias("_h"))
    name = F.coalesce(F.try_element_at(F.col("_h._source.display_names"), F.lit(1)), F.lit(""))
    rows = hit.withColumn("_n", name).where(F.col("_n").rlike(NAMED))
    parts = F.split(F.coalesce(F.col("_h._id"), F.lit("")), ":")
    accession, doc = F.element_at(parts, 1), F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit(""))
    digits = F.regexp_extract("_n", NAMED, 3)
    cik = F.coalesce(F.when(digits != "", digits), F.col("_h._source.cik"), F.lit("0")).try_cast("bigint")
    plain = F.replace(accession, F.lit("-"), F.lit(""))
    url = F.when((cik > 0) & (plain != ""), F.concat(
        F.lit("https://www.sec.gov/Archives/edgar/data/"), cik.cast("string"), F.lit("/"), plain, F.lit("/"), doc))
    return rows.select(*keep, F.regexp_extract("_n", NAMED, 2).alias("ticker"),
                       F.trim(F.regexp_extract("_n", NAMED, 1)).alias("company"), F.col("_h._source.form").alias("form"),
                       iso_day(F.col("_h._source.file_date")).alias("date"), cik.alias("cik"), accession.alias("accession"),
                       url.alias("url"))


def parse_recent_filings(df: DataFrame, payload: str, since: Column, *keep: str, forms: list[str] = WATCH_FORMS) -> DataFrame:
    """Watched forms filed on or after `since`, out of the parallel arrays of a filing index; item
    codes become labels where there is one."""
    rows = df.select(*keep, F.from_json(F.col(payload), RECENT_JSON).alias("_r")).select(
        *keep, F.inline(F.arrays_zip("_r.accessionNumber", "_r.form", "_r.filingDate", "_r.items", "_r.primaryDocument")))
    labels = F.create_map(*[F.lit(x) for kv in ITEM_LABELS.items() for x in kv])
    codes = F.filter(F.transform(F.split(F.coalesce("items", F.lit("")), ","), lambda c: F.trim(c)), lambda c: c != "")
    return rows.withColumn("date", iso_day(F.col("filingDate"))).where(
        F.col("form").isin(forms) & (F.col("date") >= since)).select(
        *keep, "form", "date", F.transform(codes, lambda c: F.coalesce(F.try_element_at(labels, c), c)).alias("items"),
        F.replace("accessionNumber", F.lit("-"), F.lit("")).alias("accession"), F.col("primaryDocument").alias("document"))


def parse_ticker_map(df: DataFrame, payload: str) -> DataFrame:
    """(ticker, cik) dimension out of the registry's map of rows."""
    row = F.explode(F.map_values(F.from_json(F.col(payload), "map<string, struct<cik_str: bigint, ticker: string>>"))).alias("_r")
    return df.select(row).where(F.col("_r.ticker").isNotNull()).select(
        F.upper("_r.ticker").alias("ticker"), F.lpad(F.col("_r.cik_str").cast("string"), 10, "0").alias("cik"))
