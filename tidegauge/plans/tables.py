"""Domain tables derived from the driver's parquet tables (see FIXTURES.md part B)."""

from __future__ import annotations

import hashlib
import threading
from functools import cached_property

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.operators import technicals
from tidegauge.session import shared_dir

PRICED_LEVELS = ["low", "medium", "high", "crowded"]
BIND_LEVELS = ["now", "2027", "2028-29", "2030+", "physics-floor"]
DURABILITY_LEVELS = ["low", "medium", "high", "very-high"]
RISK_LEVELS = ["low", "medium", "high"]
SCAN_DATE = "2001-11-05"


def pick(levels: list[str], index) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in levels]), (index + 1).cast("int"))


def cents(x) -> F.Column:
    """Whole cents. The odd offset keeps quotients of whole quantities off the rounding boundary, so
    that the last bit of a sum, which depends on its order, cannot change the price."""
    return F.floor(x * 100 + 0.2871) / F.lit(100.0)


_WRITING = threading.RLock()
#: Order lines behind one bucket of a stored table, and the range of bucket numbers. A task reads a bucket, so its
#: memory stays what these lines need however large the tables are.
ROWS_PER_BUCKET, LEAST_BUCKETS, MOST_BUCKETS = 200_000, 8, 16_384


def bucket_count(lines: int) -> int:
    return max(LEAST_BUCKETS, min(MOST_BUCKETS, lines // ROWS_PER_BUCKET))


class Tables:
    """Views over the driver tables.

    The tables most operators start from (daily bars, holdings, positions, claims, latest quotes) are
    derived once per session and kept in the shared folder, as a price store would be. Bars are
    bucketed and sorted by ticker, so that per-ticker windows and joins need no shuffle at all.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def stored(self, name: str, build, bucket: str | None = None, order: str | None = None, dealt: bool = False) -> DataFrame:
        """The derived table `name`, written on first use; `dealt` if its rows come dealt by bucket."""
        spark = self.spark
        root = shared_dir(spark)
        owner = f"{spark.sparkContext.applicationId}|{self.sf_dir}"
        table = f"tg_{hashlib.md5(owner.encode()).hexdigest()[:10]}_{name}"
        path = f"{root}/{table}"
        with _WRITING:
            try:
                spark.read.parquet(path)
                if spark.catalog.tableExists(table):
                    return spark.table(table)
            except AnalysisException:
                pass
            df = build()
            # from the footers' row counts, so that two sessions lay the same table out alike
            parts = bucket_count(self._lines.count()) if bucket else None
            writer = (df.repartition(parts, bucket) if bucket and not dealt else df).write.mode("overwrite").format("parquet").option("path", path)
            if bucket:
                writer = writer.bucketBy(parts, bucket).sortBy(*([bucket, order] if order else [bucket]))
            spark.sql(f"DROP TABLE IF EXISTS {table}")
            writer.saveAsTable(table)
        return spark.table(table)

    @property
    def scan_date(self):
        return F.lit(SCAN_DATE).cast("date")

    def _dealt(self, rows: DataFrame, key: str) -> DataFrame:
        """Rows dealt to the buckets of the stored table before they are summed: few of them have a key in common, so sums
        made before the shuffle would only fill the memory of a task, which reads more lines the larger the table."""
        return rows.repartition(bucket_count(self._lines.count()), key)

    def _daily(self, rows: DataFrame, *keys, deal: str | None = None) -> DataFrame:
        rows = rows.select(*keys, F.to_date("l_shipdate").alias("d"), "l_extendedprice", "l_quantity")
        names = rows.columns[:-2]
        return (
            (self._dealt(rows, deal) if deal else rows).groupBy(*names)
            .agg(cents(F.sum("l_extendedprice") / F.sum("l_quantity")).alias("close"))
        )

    @cached_property
    def _lines(self) -> DataFrame:
        return self.read("lineitem")

    @cached_property
    def bars(self) -> DataFrame:
        return self.stored("bars", self._bars, "ticker", "d", dealt=True)

    def _bars(self) -> DataFrame:
        return self._daily(self._lines, F.concat(F.lit("S"), F.col("l_suppkey")).alias("ticker"), deal="ticker")

    @cached_property
    def _placed(self) -> DataFrame:
        places = self.read("supplier").join(
            self.read("nation"), F.col("s_nationkey") == F.col("n_nationkey")
        ).select("s_suppkey", "n_nationkey", "n_regionkey")
        return self._lines.join(places, F.col("l_suppkey") == F.col("s_suppkey"))

    @cached_property
    def theme_bars(self) -> DataFrame:
        return self.stored("theme_bars", self._theme_bars, "ticker", "d")

    def _theme_bars(self) -> DataFrame:
        return self._daily(
            self._placed,
            F.concat(F.lit("N"), F.col("n_nationkey")).alias("ticker"),
            F.concat(F.lit("R"), F.col("n_regionkey")).alias("grp"))

    @cached_property
    def complex_bars(self) -> DataFrame:
        return self.stored("complex_bars", self._complex_bars, "ticker", "d")

    def _complex_bars(self) -> DataFrame:
        return self._daily(self._placed, F.concat(F.lit("R"), F.col("n_regionkey")).alias("ticker"))

    @cached_property
    def market_bars(self) -> DataFrame:
        return self.stored("market_bars", self._market_bars)

    def _market_bars(self) -> DataFrame:
        return self._daily(self._lines, F.lit("M").alias("ticker"))

    @cached_property
    def raw_bars(self) -> DataFrame:
        """Closes by provider; a ticker's are in one bucket, so that no later step deals them again."""
        return self.stored("raw_bars", self._raw_bars, "ticker", "d", dealt=True)

    def _raw_bars(self) -> DataFrame:
        provider = (F.when(F.col("l_returnflag") == "A", "yahoo")
                    .when(F.col("l_returnflag") == "N", "stooq").otherwise("tiingo"))
        return self._daily(self._lines, provider.alias("provider"),
                           F.concat(F.lit("S"), F.col("l_suppkey")).alias("ticker"), deal="ticker")

    @cached_property
    def price_rows(self) -> DataFrame:
        """Rows offered to the store: some from a source that is not trusted."""
        source = (F.when(F.col("l_returnflag") == "A", "yahoo")
                  .when(F.col("l_returnflag") == "N", "consensus").otherwise("scraped"))
        return self._daily(self._lines, F.concat(F.lit("S"), F.col("l_suppkey")).alias("ticker"),
                           source.alias("source"))

    @cached_property
    def securities(self) -> DataFrame:
        k, n = F.col("s_suppkey"), F.col("s_nationkey")
        return self.read("supplier").select(
            F.concat(F.lit("S"), k).alias("ticker"),
            F.when(k % 4 == 0, "etf").when(k % 4 == 1, "adr").otherwise("stock").alias("type"),
            (k % 7 == 0).alias("is_foreign"),
            F.when(n % 4 == 0, "USD").when(n % 4 == 1, "EUR").when(n % 4 == 2, "JPY").alias("currency"),
            F.concat(F.lit("N"), n).alias("theme"))

    @cached_property
    def quotes(self) -> DataFrame:
        """Latest technicals per ticker."""
        return self.stored("quotes", self._quotes)

    def _quotes(self) -> DataFrame:
        return technicals.snapshot(self.bars)

    @cached_property
    def themes(self) -> DataFrame:
        k = F.col("n_nationkey")
        kill_by = (F.when(k % 4 == 0, "2001").when(k % 4 == 1, "2001-06")
                   .when(k % 4 == 2, "2001-03-15").otherwise("someday"))
        return (
            self.read("nation").join(self.read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(
                F.concat(F.lit("N"), k).alias("theme"),
                F.col("r_name").alias("sector"),
                F.col("n_name").alias("scarcity"),
                pick(BIND_LEVELS, k % 5).alias("bind_window"),
                pick(PRICED_LEVELS, k % 4).alias("priced_in"),
                pick(DURABILITY_LEVELS, F.floor(k / 2) % 4).alias("durability"),
                pick(RISK_LEVELS, k % 3).alias("substitution_risk"),
                (k % 2 == 0).alias("non_consensus"),
                F.when(k % 6 == 5, "diversifier").otherwise("deep-tech").alias("axis"),
                F.concat(F.lit("supply of "), F.col("n_name"), F.lit(" recovers")).alias("kill_condition"),
                kill_by.alias("kill_by"))
        )

    @cached_property
    def theme_members(self) -> DataFrame:
        """A supplier belongs to its nation's theme, every third one to the next theme as well."""
        k, n = F.col("s_suppkey"), F.col("s_nationkey")
        themes = F.array_compact(F.array(n, F.when(k % 3 == 0, (n + 1) % 25)))
        return self.read("supplier").select(
            F.concat(F.lit("S"), k).alias("ticker"), F.explode(themes).alias("_n")).select(
            F.concat(F.lit("N"), F.col("_n")).alias("theme"), "ticker")

    @cached_property
    def _fills(self) -> DataFrame:
        orders = self.read("orders").select("o_orderkey", "o_custkey", "o_orderstatus")
        return self._lines.select("l_orderkey", "l_suppkey", "l_quantity", "l_extendedprice").join(
            orders, F.col("l_orderkey") == F.col("o_orderkey"))

    @cached_property
    def holdings(self) -> DataFrame:
        """One row per portfolio, account and ticker."""
        return self.stored("holdings", self._holdings, "portfolio_id", dealt=True)

    def _holdings(self) -> DataFrame:
        k = F.col("l_suppkey")
        return (
            self._dealt(self._fills, "o_custkey").groupBy(
                F.col("o_custkey").alias("portfolio_id"), k,
                F.when(F.col("o_orderstatus") == "F", "taxable").otherwise("ira").alias("account"))
            .agg(F.floor(F.sum("l_extendedprice")).alias("target_usd"))
            .select(
                "portfolio_id", F.concat(F.lit("S"), k).alias("ticker"), "account",
                F.when(k % 5 == 0, "diversifier").otherwise("deep-tech").alias("axis"),
                F.when(k % 10 == 3, "Tactical de-correlator").otherwise("core").alias("role"),
                "target_usd",
                pick(["A", "B", "C", "D", "DRY"], k % 5).alias("tier"))
        )

    @cached_property
    def positions(self) -> DataFrame:
        return self.stored("positions", self._positions, "portfolio_id", dealt=True)

    def _positions(self) -> DataFrame:
        k = F.col("l_suppkey")
        return (
            self._dealt(self._fills, "o_custkey").groupBy(F.col("o_custkey").alias("portfolio_id"), k)
            .agg(F.sum("l_quantity").alias("shares"),
                 cents(F.sum("l_extendedprice") / F.sum("l_quantity")).alias("cost_basis"))
            .select("portfolio_id", F.concat(F.lit("S"), k).alias("ticker"), "shares", "cost_basis",
                    F.when(k % 3 != 0, (k % 90).cast("double")).alias("forward_pe"))
        )

    @cached_property
    def cash(self) -> DataFrame:
        """Cash per portfolio; every third one reports none."""
        return self.read("customer").where(F.col("c_custkey") % 3 > 0).select(
            F.col("c_custkey").alias("portfolio_id"), F.col("c_acctbal").cast("double").alias("cash_usd"))

    @cached_property
    def claims(self) -> DataFrame:
        return self.stored("claims", self._claims)

    def _claims(self) -> DataFrame:
        first = self._lines.groupBy("l_orderkey").agg(F.min("l_suppkey").alias("k"))
        return self.read("orders").join(first, F.col("o_orderkey") == F.col("l_orderkey")).select(
            F.col("o_orderkey").alias("id"),
            F.concat(F.lit("S"), F.col("k")).alias("subject"),
            F.when(F.col("o_orderkey") % 2 == 0, "up").otherwise("down").alias("claim"),
            F.to_date("o_orderdate").alias("date"),
            F.date_add(F.to_date("o_orderdate"), 21).alias("resolve_on"))

    @cached_property
    def ticks(self) -> DataFrame:
        return self.read("events").select(
            F.concat(F.lit("U"), F.col("user_id")).alias("ticker"), "event_id", "ts",
            F.col("value").alias("price"))

    @cached_property
    def filings(self) -> DataFrame:
        return self.read("documents").select("doc_id", F.upper("source").alias("filer"), "text")

    @cached_property
    def news(self) -> DataFrame:
        """Page titles as headlines, one theme each."""
        return self.read("pages").select(
            F.col("page_id").alias("news_id"),
            F.concat(F.lit("N"), F.col("page_id") % 25).alias("theme"),
            F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
            F.col("url").alias("link"),
            F.date_add(F.lit("2001-01-01").cast("date"), (F.col("page_id") % 300).cast("int")).alias("date"))
