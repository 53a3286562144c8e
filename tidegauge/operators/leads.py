"""Lead generation over text: phrase sweeps, clustering, proxies, news matching and drafts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from tidegauge.functions import text as T
from tidegauge.functions.scalar import fixed
from tidegauge.session import cut

# Seed phrases used until reviewed ones exist.
SEED_PHRASES = [
    "lead times extended", "unable to secure allocation", "qualified a second source",
    "capacity-constrained supplier", "on allocation", "took-or-pay", "single source of supply",
    "extended delivery lead times", "supply remains constrained", "unable to obtain sufficient quantities",
]


# ---- phrase sweep ------------------------------------------------------------------------------------

def approved_phrases(phrases: DataFrame, seed: list[str] = SEED_PHRASES) -> DataFrame:
    """The approved phrases (phrase), or the seed list when none is approved yet."""
    approved = phrases.where(F.col("status") == "approved").select("phrase").distinct()
    return phrases.sparkSession.createDataFrame([(p,) for p in seed], "phrase string") if approved.isEmpty() else approved


#: Characters of phrases sent to the tasks at once, and texts searched at once in a task.
BLOCK, ROWS = 1 << 22, 256


def phrase_blocks(phrases: DataFrame, chars: int = BLOCK) -> Iterator[list[str]]:
    """The different phrases in lists of at most about `chars` characters; one list is on the driver at a time."""
    block, size = [], 0
    for (phrase,) in phrases.select("phrase").where("phrase is not null").distinct().toLocalIterator():
        if block and size + len(phrase) > chars:
            yield block
            block, size = [], 0
        block.append(phrase)
        size += len(phrase)
    if block:
        yield block


def holding(texts: DataFrame, text: str, phrases: DataFrame, chars: int = BLOCK) -> DataFrame:
    """texts without their text but with `phrase`: one row per text and different phrase (phrase) that its
    lower-case form contains; a null text contains none.

    The phrases are indexed as one automaton, so a text is read once for all phrases of a block, and the work is that
    of the text and its hits however many phrases there are. Texts do not leave their task. A block's size is
    bounded; a longer list takes one pass a block."""
    spark, kept = texts.sparkSession, [c for c in texts.columns if c != text]
    low = texts.select(*kept, F.lower(text).alias("_low")).where(F.col("_low").isNotNull())
    fields = ST.StructType([*[texts.schema[c] for c in kept], ST.StructField("phrase", ST.StringType())])
    found = spark.createDataFrame([], fields)

    for block in phrase_blocks(phrases, chars):
        held = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            everywhere = [p for p in held.value if not p]
            index = ahocorasick.Automaton()
            for phrase in held.value:
                if phrase:
                    index.add_word(phrase, phrase)
            index.make_automaton()
            for whole in batches:
                for start in range(0, whole.num_rows, ROWS):
                    batch = whole.slice(start, ROWS)
                    rows, hits = [], []
                    for i, body in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                        own = {phrase for _, phrase in index.iter(body)} if len(index) else set()
                        own.update(everywhere)
                        rows += [i] * len(own)
                        hits += sorted(own)
                    taken = batch.select(kept).take(pa.array(rows, pa.int64()))
                    yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(hits, pa.string())], names=[*kept, "phrase"])

        found = found.unionByName(low.mapInArrow(run, fields))
    return found


def phrase_hits(filings: DataFrame, phrases: DataFrame) -> DataFrame:
    """(filer, phrase, mentions): filings of each filer that contain each phrase (phrase). Hits are counted in each task
    before they are shuffled, so a filer with a third of the corpus sends one row per phrase and task."""
    found = holding(filings.select("filer", "text"), "text", phrases)
    return found.groupBy("filer", "phrase").agg(F.count("*").alias("mentions"))


def cluster_hits(hits: DataFrame, known: DataFrame, min_phrases: int = 2) -> DataFrame:
    """Candidates among filers not known yet: breadth of distinct phrases first, volume breaks ties."""
    novel = hits.join(known.select(F.col("ticker").alias("filer")).distinct(), "filer", "left_anti")
    out = novel.groupBy("filer").agg(F.count("*").alias("phrase_count"), F.sum("mentions").alias("mentions"),
                                     F.array_sort(F.collect_set("phrase")).alias("phrases"))
    score = F.col("phrase_count") + F.least(F.lit(0.99), F.log1p(F.col("mentions").cast("double")) / 10)
    return out.where(F.col("phrase_count") >= min_phrases).withColumn("score", fixed(score, 3))


def top_candidates(clustered: DataFrame, limit: int = 12) -> DataFrame:
    return clustered.orderBy(F.desc("score"), F.desc("phrase_count"), "filer").limit(limit)


# ---- proxies -----------------------------------------------------------------------------------------

def proxy_tally(hits: DataFrame, terms: DataFrame) -> DataFrame:
    """Mentions per (chokepoint, ticker) over the chokepoint's search terms (chokepoint, phrase)."""
    return hits.join(terms, "phrase").groupBy("chokepoint", F.col("filer").alias("ticker")).agg(
        F.sum("mentions").alias("mentions"))


def top_proxies(tally: DataFrame, limit: int = 6) -> DataFrame:
    k = F.row_number().over(Window.partitionBy("chokepoint").orderBy(F.desc("mentions"), "ticker"))
    return tally.withColumn("_k", k).where(F.col("_k") <= limit).drop("_k")


def specificity(tally: DataFrame) -> DataFrame:
    """Score each proxy by how much it is about this chokepoint and few others; a name in more than
    half of the chokepoints is generic."""
    peak = tally.groupBy("chokepoint").agg(F.greatest(F.max("mentions"), F.lit(1)).alias("_peak"))
    spread = tally.groupBy("ticker").agg(F.count("*").alias("_df"))
    points = tally.select(F.count_distinct("chokepoint")).scalar()
    rows = tally.join(peak, "chokepoint").join(spread, "ticker")
    return rows.select("chokepoint", "ticker", "mentions",
                       fixed(F.sqrt(F.col("mentions") / F.col("_peak")) / F.col("_df"), 3).alias("score"),
                       (F.col("_df") > points / 2).alias("generic"))


def exposure(scored: DataFrame) -> DataFrame:
    """Per ticker: how many chokepoints it touches and how specifically. The edges themselves stay in
    the scored table. Scores have three decimals; their thousandths are summed, so no order shows."""
    thousandths = F.round(F.col("score") * 1000).cast("long")
    return scored.groupBy("ticker").agg(
        F.count("*").alias("degree"), (fixed(F.avg(thousandths), 0) / 1000).alias("avg_specificity")).withColumns({
            "pure_play": F.col("degree") == 1, "hub": F.col("degree") >= 3})


def novel_proxies(leads: DataFrame, known: DataFrame) -> DataFrame:
    """Leads (lead, named, found) with the union of named and found tickers minus the known ones; a
    lead whose tickers are all known is dropped."""
    union = F.array_union(F.coalesce("named", F.array()), F.coalesce("found", F.array()))
    rows = leads.select("lead", F.explode_outer(union).alias("ticker"))
    marked = rows.join(known.select("ticker", F.lit(True).alias("_known")).distinct(), "ticker", "left")
    fresh = F.col("ticker").isNotNull() & F.col("_known").isNull()
    out = marked.groupBy("lead").agg(
        F.array_sort(F.collect_set(F.when(fresh, F.col("ticker")))).alias("tickers"),
        F.count("ticker").alias("_all"))
    return out.where((F.size("tickers") > 0) | (F.col("_all") == 0)).drop("_all")


# ---- news --------------------------------------------------------------------------------------------

def by_rarity(rows: DataFrame, keys: list[str], counts: DataFrame, shared: int) -> DataFrame:
    """rows (keys, word) gathered as `words`, rarest first, for keys with at least `shared` of the counted words."""
    listed = rows.join(counts, "word").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("n", "word"))).alias("words"))
    return listed.where(F.size("words") >= shared).withColumn("words", F.col("words.word"))


def match_news(news: DataFrame, queries: DataFrame, as_of: Column, max_age: int = 45, shared: int = 2) -> DataFrame:
    """Headlines (news_id, title, date) that share at least `shared` significant words with a query
    (trigger, query): distinct (trigger, news_id, date).

    A prefix-filtered join: words are ranked by rarity, the same on both sides, and of each side's words all but
    the `shared` - 1 most frequent ones are join keys, so a common word pairs nothing by itself. Of the words
    a pair shares, the rarest is a key on both sides; the pair is counted there and nowhere else.
    """
    fresh = news.where(F.col("date").isNull() | (F.col("date") >= F.date_sub(as_of, max_age)))
    titles = fresh.select("news_id", F.coalesce(F.col("date"), F.lit("9999-12-31").cast("date")).alias("date"), F.explode(T.significant_tokens(F.col("title"))).alias("word"))
    asked = queries.select("trigger", "query").distinct().select("trigger", "query", F.explode(T.significant_tokens(F.col("query"))).alias("word"))
    counts = cut(titles.groupBy("word").agg(F.count("*").alias("n")).join(asked.select("word").distinct(), "word"))
    heads = by_rarity(titles, ["news_id", "date"], counts, shared)
    wants = by_rarity(asked, ["trigger", "query"], counts, shared)
    key = F.explode(F.slice("words", F.lit(1), F.size("words") - (shared - 1))).alias("w")
    pairs = heads.select("news_id", "date", F.col("words").alias("_h"), key).join(wants.select("trigger", F.col("words").alias("_q"), key), "w")
    both = F.array_intersect("_h", "_q")
    hits = pairs.where((F.size(both) >= shared) & (F.get(both, F.lit(0)) == F.col("w")))
    date = F.when(F.col("date") != F.lit("9999-12-31").cast("date"), F.col("date")).alias("date")
    return hits.select("trigger", "news_id", date).distinct()


def watchable(triggers: DataFrame) -> DataFrame:
    """Manual triggers that name at least one query."""
    return triggers.where((F.col("type") == "manual") & (F.size("queries") > 0))


def host(link: Column) -> Column:
    name = F.regexp_replace(F.try_parse_url(link, F.lit("HOST")), r"^www\.", "")
    return F.coalesce(name, F.concat(F.lit("__nolink_"), F.coalesce(link, F.lit(""))))


def cap_per_host(items: DataFrame, order: str, per_host: int = 2) -> DataFrame:
    """At most `per_host` items of one site, the first ones. The rank limit is applied before the
    shuffle too, so a site with a third of the pages sends only its first few rows per task."""
    k = F.row_number().over(Window.partitionBy("_host").orderBy(order))
    return items.withColumn("_host", host(F.col("link"))).withColumn("_k", k).where(
        F.col("_k") <= per_host).drop("_k").withColumnRenamed("_host", "host")


def cap_headlines(items: DataFrame, per_theme: int = 2, total: int = 24) -> DataFrame:
    """Headlines accepted theme by theme: an item is taken unless its title was taken before or its
    theme is full, until `total` are taken. Items have theme_order, position and title.

    The acceptance is sequential, but few rows can matter before it is complete. A title not yet taken
    is passed over only at a theme that is full, which happens at most total/per_theme times, so only
    that many repeats of a title (and one more) count. Of a theme's titles at most `total` can be taken
    already, so only its first total+per_theme count. Rows of taken titles and rows of full themes are
    then bounded, and the first rows up to that bound are folded in one ordered pass.
    """
    full_themes = total // per_theme
    repeats, width = full_themes + 1, total + per_theme
    bound = total * repeats + full_themes * width + width
    one = items.groupBy("theme_order", F.lower("title").alias("key")).agg(
        F.min_by(F.struct("theme", "title", "position"), "position").alias("_i")).select("theme_order", "key", "_i.*")
    repeat = F.row_number().over(Window.partitionBy("key").orderBy("theme_order"))
    in_theme = F.row_number().over(Window.partitionBy("theme_order").orderBy("position"))
    near = one.withColumn("_p", in_theme).where(F.col("_p") <= width)
    near = one.withColumn("_r", repeat).where(F.col("_r") <= repeats).join(
        near.select("theme_order", "key"), ["theme_order", "key"], "left_semi")
    first = near.orderBy("theme_order", "position").limit(bound)
    rows = first.agg(F.array_sort(F.collect_list(F.struct(
        *at_fields(), "theme", "title", "key"))).alias("rows"))
    entry = "array<struct<theme_order:int,position:bigint,theme:string,title:string,key:string>>"

    def take(done: Column, x: Column) -> Column:
        known = F.exists(done, lambda y: y["key"] == x["key"])
        full = F.size(F.filter(done, lambda y: y["theme_order"] == x["theme_order"])) >= per_theme
        return F.when(known | full | (F.size(done) >= total), done).otherwise(F.array_append(done, x))

    taken = rows.select(F.explode(F.aggregate(F.col("rows").cast(entry), F.array().cast(entry), take)).alias("x"))
    return taken.select("x.theme", "x.title", "x.position")


def at_fields() -> list[Column]:
    return [F.col("theme_order").cast("int").alias("theme_order"), F.col("position").cast("bigint").alias("position")]


def interleave(leads: DataFrame, limit: int | None = None) -> DataFrame:
    """Round robin over engines in the order they first appear (engine, position): adds `turn`."""
    turn = F.row_number().over(Window.partitionBy("engine").orderBy("position"))
    first = leads.groupBy("engine").agg(F.min("position").alias("_first"))
    ranked = leads.withColumn("turn", turn)
    if limit is not None:
        # no engine can fill more than the whole list: the rank limit runs before the shuffle too
        ranked = ranked.where(F.col("turn") <= limit)
    out = ranked.join(first, "engine").orderBy("turn", "_first")
    return (out if limit is None else out.limit(limit)).drop("_first")


# ---- leads and drafts ----------------------------------------------------------------------------------

def topic_leads(papers: DataFrame, topics: DataFrame, proxies: DataFrame, min_papers: int = 5) -> DataFrame:
    """Topics (topic) named by enough papers (text) that also have a public proxy (topic, ticker)."""
    named = topics.where("topic is not null").select("topic", F.lower("topic").alias("phrase")).distinct()
    counts = holding(papers.select(F.lit(1).alias("one"), "text"), "text", named).groupBy("phrase").agg(F.count("*").alias("papers")) \
        .join(named, "phrase").select("topic", "papers")
    return counts.where(F.col("papers") >= min_papers).join(proxies.select("topic"), "topic", "left_semi")


def draft_candidates(leads: DataFrame) -> DataFrame:
    """Draft themes from leads (engine, subject, ticker, company, phrases, ladder_from, papers), with
    neutral priors a reviewer has to correct."""
    name = T.clean_name(F.col("subject"))
    who = T.clean_name(F.coalesce("company", "ticker"))
    phrases = F.array_join(F.coalesce("phrases", F.array().cast("array<string>")), "; ")
    thesis = (
        F.when(F.col("papers").isNotNull(), F.concat(F.lit("research activity around "), "subject", F.lit(": "), F.col("papers").cast("string"), F.lit(" papers")))
        .when(F.col("ladder_from").isNotNull(), F.concat(F.col("subject"), F.lit(" is upstream of "), F.col("ladder_from")))
        .otherwise(F.concat(F.lit("filers report stress around "), F.when(name != "", name).otherwise("this input"), F.lit(" ("), phrases, F.lit(")"))))
    return leads.select(
        T.slug(F.when(name != "", name).otherwise(F.col("ticker"))).alias("theme"), F.lit("Unknown (scout)").alias("sector"),
        F.when(name != "", name).otherwise(F.concat(F.lit("Constraint flagged by "), who)).alias("scarcity"),
        F.lit("2027").alias("bind_window"), F.lit("low").alias("priced_in"), F.lit("medium").alias("durability"),
        F.lit("medium").alias("substitution_risk"), F.lit(True).alias("non_consensus"), thesis.alias("thesis"),
        F.coalesce("engine", F.lit("constraint-shadow")).alias("engine"), F.col("ticker"))
