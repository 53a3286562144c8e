"""Combining votes, evidence and proposals into decisions. Votes arrive as tables, one row per seat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.scalar import clamp, fixed, ordinal

PRICED = ["low", "medium", "high", "crowded"]
BIND = ["now", "2027", "2028-29", "2030+", "physics-floor"]
DURABILITY = ["low", "medium", "high", "very-high"]
RISK = ["low", "medium", "high"]
FIELDS = ["priced_in", "bind_window", "non_consensus"]

# Capital words that look like tickers but are not.
ACRONYMS = ["US", "USA", "CEO", "CFO", "AI", "ML", "EW", "RF", "GIT", "EV", "EVS", "GAN", "SIC", "DOE", "SEC", "OEM",
            "OEMS", "CDU", "CDUS", "HBM", "HVDC", "RL", "GMP", "II", "III", "IV", "MOU", "YTD", "DR", "DRS", "ADR",
            "ADRS", "MW", "GW", "EU", "UK", "PJM", "SBSP", "CIGS", "GAAS", "PIC", "PICS", "CPO", "LPO"]


# ---- parsing replies -------------------------------------------------------------------------------

def json_object(text: Column) -> Column:
    """The text from the first opening to the last closing brace; null when there is none."""
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(found != "", found)


def parse_verdict(text: Column) -> Column:
    """Struct (met, confidence, citations, rationale) from a reply, preferring the last object that
    has a "met" field. Anything unreadable is a vote of not met with zero confidence."""
    objects = F.filter(F.regexp_extract_all(text, F.lit(r"(?s)\{.*?\}"), F.lit(0)), lambda o: o.rlike(r'"met"\s*:'))
    picked = F.coalesce(F.try_element_at(objects, F.lit(-1)), json_object(text))
    fields = F.from_json(picked, "met boolean, confidence string, citations array<string>, rationale string")
    confidence = F.coalesce(fields["confidence"].try_cast("double"), F.lit(0.0))
    citations = F.slice(F.filter(F.coalesce(fields["citations"], F.array().cast("array<string>")),
                                 lambda c: c.isNotNull() & (c != "")), 1, 6)
    return F.struct(
        F.coalesce(fields["met"], F.lit(False)).alias("met"), clamp(confidence, 0.0, 1.0).alias("confidence"),
        citations.alias("citations"), F.coalesce(F.substring(fields["rationale"], 1, 240), F.lit("")).alias("rationale"))


def sanitize_edit(raw: DataFrame) -> DataFrame:
    """Keep only valid values of the fields a proposal may touch; out-of-range confidence is clamped
    and a missing one is zero; a kill criterion needs a condition and a dated deadline."""
    kill_ok = (F.length(F.trim("kill_condition")) > 0) & F.trim("kill_by").rlike(r"^\d{4}(-\d{2}(-\d{2})?)?$")
    return raw.withColumns({
        "priced_in": F.when(F.col("priced_in").isin(PRICED), F.col("priced_in")),
        "bind_window": F.when(F.col("bind_window").isin(BIND), F.col("bind_window")),
        "confidence": F.coalesce(clamp(F.col("confidence"), 0.0, 1.0), F.lit(0.0)),
        "kill_condition": F.when(kill_ok, F.substring(F.trim("kill_condition"), 1, 300)),
        "kill_by": F.when(kill_ok, F.trim("kill_by"))})


# ---- votes -------------------------------------------------------------------------------------------

def consensus(votes: DataFrame, key: str = "item", allowed: list[str] = PRICED) -> DataFrame:
    """Strict-majority value, agreement and dispersion per item from votes (item, value). An item without
    a valid vote has no value, agreement 0 and level wide."""
    counts = votes.where(F.col("value").isin(allowed)).groupBy(key, "value").agg(F.count("*").alias("c"))
    out = counts.groupBy(key).agg(
        F.sum("c").alias("n"), F.max("c").alias("_top"), F.max_by("value", F.struct("c", "value")).alias("_value"),
        F.count("*").alias("_kinds"))
    majority = F.col("_top") * 2 > F.col("n")
    level = F.when(F.col("_kinds") == 1, "tight").when(majority, "moderate").otherwise("wide")
    return votes.select(key).distinct().join(out, key, "left").select(
        key, F.coalesce("n", F.lit(0)).alias("n"), F.when(majority, F.col("_value")).alias("value"),
        F.coalesce(fixed(F.col("_top") / F.col("n"), 2), F.lit(0.0)).alias("agreement"), level.alias("level"))


def panel_health(votes: DataFrame, key: str = "item") -> DataFrame:
    """One row: how many items each role answered, degraded when a challenging role missed half."""
    answered = F.col("value").isNotNull()

    def role(name: str) -> Column:
        return F.count_distinct(F.when(answered & (F.col("seat") == name), F.col(key)))

    out = votes.agg(F.count_distinct(key).alias("items"), *[role(r).alias(r) for r in ("bull", "bear", "skeptic")])
    half = F.col("items") / 2
    return out.withColumn("degraded", (F.col("items") > 0) & ((F.col("bear") <= half) | (F.col("skeptic") <= half)))


def catalyst_consensus(verdicts: DataFrame, evidence: DataFrame, previous: DataFrame, key: str = "trigger",
                       min_confidence: float = 0.6, min_seats: int = 2, min_sources: int = 2) -> DataFrame:
    """Status of each trigger from seat verdicts (met, confidence), fetched evidence (filings, news) and
    the previous status. Citations claimed by a seat are not evidence; firing takes two runs. Triggers
    known from any of the three inputs keep a row; without a verdict they are monitored."""
    v = verdicts.where(F.col("met").isNotNull()).groupBy(key).agg(
        F.count("*").alias("seats"), F.count_if("met").alias("met_seats"),
        F.coalesce(fixed(F.avg(F.when(F.col("met"), F.coalesce("confidence", F.lit(0.0)))), 2), F.lit(0.0)).alias("confidence"))
    asked = verdicts.select(key).union(evidence.select(key)).union(previous.select(key)).distinct()
    zero = F.lit(0)
    v = asked.join(v, key, "left").withColumns({
        "seats": F.coalesce("seats", zero), "met_seats": F.coalesce("met_seats", zero), "confidence": F.coalesce("confidence", F.lit(0.0))})
    rows = v.join(evidence, key, "left").join(previous.select(key, F.col("status").alias("_prev")), key, "left")
    corroborated = (F.col("seats") > 0) & ((F.coalesce("filings", zero) >= 1) | (F.coalesce("news", zero) >= min_sources))
    majority = F.col("met_seats") * 2 > F.col("seats")
    met = (F.col("met_seats") >= min_seats) & majority & corroborated & (F.col("confidence") >= min_confidence)
    status = (F.when(met & F.coalesce(F.col("_prev").isin("likely-met", "fired"), F.lit(False)), "fired")
              .when(met, "likely-met").when(majority | (F.col("confidence") >= 0.4), "approaching").otherwise("monitoring"))
    return rows.select(key, status.alias("status"), met.alias("met"), "confidence", "seats", "met_seats",
                       corroborated.alias("corroborated"))


# ---- evidence ------------------------------------------------------------------------------------------

def evidence_counts(themes: DataFrame, news: DataFrame, filings: DataFrame) -> DataFrame:
    """Evidence per theme, counted and not collected: news (theme, excerpt), filings (theme, passages)."""
    n = news.groupBy("theme").agg(F.count("*").alias("news"),
                                  F.count_if(F.length("excerpt") > 0).alias("news_with_excerpt"))
    f = filings.groupBy("theme").agg(F.count("*").alias("filings"), F.sum("passages").alias("filing_passages"))
    out = themes.select("theme").join(n, "theme", "left").join(f, "theme", "left")
    return out.na.fill(0, ["news", "news_with_excerpt", "filings", "filing_passages"])


def evidence_rows(news: DataFrame, filings: DataFrame, limit: int = 12) -> DataFrame:
    """The evidence a reviewer reads: at most `limit` rows a theme and lane, the latest first, of news (theme, id, date, body)
    and filings (theme, id, date, body). The rank limit holds before the shuffle too."""
    lanes = news.select("theme", F.lit("news").alias("lane"), "id", "date", "body").unionByName(
        filings.select("theme", F.lit("filing").alias("lane"), "id", "date", "body")).where(F.length("body") > 0)
    order = Window.partitionBy("theme", "lane").orderBy(F.desc_nulls_last("date"), "id")
    return lanes.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)


def member_tape(members: DataFrame, quotes: DataFrame) -> DataFrame:
    """Per theme: quoted members, their mean month and distance to the long average (a missing value
    counts as zero), and whether any of them is extended."""
    zero = F.lit(0.0)
    extended = F.coalesce(F.col("ytd") >= 0.5, F.lit(False)) | F.coalesce(F.col("pct_vs_ma200") >= 0.2, F.lit(False))
    return members.join(quotes.select("ticker", "ytd", "mom_1m", "pct_vs_ma200"), "ticker").groupBy("theme").agg(
        F.count("*").alias("quoted"),
        (F.avg(F.coalesce("mom_1m", zero)) + F.avg(F.coalesce("pct_vs_ma200", zero))).alias("momentum"),
        F.max(extended).alias("extended"))


def triangulate(themes: DataFrame) -> DataFrame:
    """Tape lean and divergence per theme from priced_in, flag, counts and member tape columns."""
    zero = F.lit(0)
    derating = F.coalesce(F.col("flag") == "de-rating", F.lit(False))
    mom = F.coalesce("momentum", F.lit(0.0))
    lean = F.when(derating | (mom < -0.05), "weak").when(mom > 0.05, "strong").otherwise("neutral")
    news = F.when(F.coalesce("news_with_excerpt", zero) > 0, F.col("news_with_excerpt")).otherwise(F.coalesce("news", zero))
    substance = (F.coalesce("filing_passages", zero) > 0) | (news > 0) | (F.coalesce("quoted", zero) > 0)
    loved = F.col("priced_in").isin("high", "crowded")
    return themes.withColumns({
        "lean": lean, "news_lane": news, "filings_lane": F.coalesce("filing_passages", zero),
        "divergence": F.when(~substance, "thin-evidence").when(loved & (lean == "weak"), "fundamentals-vs-price")})


def verify(proposals: DataFrame) -> DataFrame:
    """Flags, confidence penalty and hard failure of proposed edits.

    Reads the current and proposed labels (new_*), confidence, variant_view, coverage (the theme's
    tickers as text), extended and the evidence counts.
    """
    cheaper = ordinal("new_priced_in", PRICED) < ordinal("priced_in", PRICED)
    contradiction = F.coalesce(cheaper & F.col("extended"), F.lit(False))
    earlier = F.coalesce(ordinal("new_bind_window", BIND) < ordinal("bind_window", BIND), F.lit(False))
    cited = F.array_distinct(F.regexp_extract_all(F.coalesce("variant_view", F.lit("")), F.lit(r"\b[A-Z]{2,5}\b"), F.lit(0)))
    covered = F.regexp_extract_all(F.coalesce("coverage", F.lit("")), F.lit("[A-Z]{2,5}"), F.lit(0))
    unknown = F.array_except(F.array_except(cited, covered), F.array(*[F.lit(a) for a in ACRONYMS]))
    grounded = F.coalesce("news_with_excerpt", F.lit(0)) + F.coalesce("filing_passages", F.lit(0))
    thin = (grounded == 0) & F.coalesce(F.col("confidence") >= 0.65, F.lit(False))
    flags = F.array_compact(F.concat(
        F.array(F.when(contradiction, F.lit("price-contradiction")), F.when(earlier, F.lit("bind-acceleration"))),
        F.transform(unknown, lambda t: F.concat(F.lit("unverified-ticker "), t)),
        F.array(F.when(thin, F.lit("thin-evidence-overconfident")))))
    penalty = F.when(earlier, 0.1).otherwise(0.0) + F.size(unknown) * 0.05
    return proposals.withColumns({"flags": flags, "penalty": fixed(penalty, 3), "hard_fail": contradiction | thin})


def decide(proposals: DataFrame, min_confidence: float = 0.5) -> DataFrame:
    """One outcome per theme. `answered` says whether there is a proposal at all; review is approve,
    revise or veto with a confidence adjustment that can only lower."""
    changed = F.lit(False)
    for f in FIELDS:
        changed = changed | F.coalesce(F.col(f"new_{f}") != F.col(f), F.lit(False))
    after_checks = F.when(F.col("penalty") > 0, fixed(F.greatest(F.lit(0.0), F.col("confidence") - F.col("penalty")), 3)
                          ).otherwise(F.col("confidence"))
    down = F.least(F.lit(0.0), F.coalesce("review_adj", F.lit(0.0)))
    reviewed = F.when(F.col("review") == "revise", fixed(F.greatest(F.lit(0.0), F.col("_checked") + down), 3)
                      ).otherwise(F.col("_checked"))
    rows = proposals.withColumn("_changed", changed).withColumn("_checked", after_checks).withColumn("_final", reviewed)
    candidate = F.col("_changed") & (F.col("_checked") >= min_confidence)
    outcome = (
        F.when(~F.col("answered"), "no-response").when(F.col("hard_fail"), "verification-failed")
        .when(candidate & F.coalesce(F.col("review") == "veto", F.lit(False)), "vetoed")
        .when(candidate & (F.col("_final") >= min_confidence), "proposal")
        .when(~F.col("_changed"), "no-change").otherwise("below-confidence"))
    return rows.select("theme", outcome.alias("outcome"),
                       F.when(candidate, F.col("_final")).otherwise(F.col("_checked")).alias("confidence"))


# ---- proposals against the current themes --------------------------------------------------------------

def _valid(field: Column, value: Column) -> Column:
    return (F.when(field == "priced_in", value.isin(PRICED)).when(field == "bind_window", value.isin(BIND))
            .when(field == "non_consensus", value.isin("true", "false")).otherwise(False))


def proposal_diffs(proposals: DataFrame, themes: DataFrame) -> DataFrame:
    """Field-level changes (theme, field, from_value, to_value) a proposal would make."""

    def long(df: DataFrame, value: str) -> DataFrame:
        text = df.select("theme", *[F.col(f).cast("string").alias(f) for f in FIELDS])
        return text.unpivot(["theme"], FIELDS, "field", value)

    both = long(proposals, "to_value").join(long(themes, "from_value"), ["theme", "field"])
    return both.where(_valid(F.col("field"), F.col("to_value")) & ~F.col("to_value").eqNullSafe(F.col("from_value"))).select(
        "theme", "field", "from_value", "to_value")


def accept_proposals(themes: DataFrame, proposals: DataFrame, today: Column) -> DataFrame:
    """Themes with the valid proposed fields applied; a changed theme is stamped as reviewed today."""
    p = proposals.select("theme", *[F.col(f).alias(f"_{f}") for f in FIELDS])
    rows = themes.join(p, "theme", "left")
    ok = {"priced_in": F.col("_priced_in").isin(PRICED), "bind_window": F.col("_bind_window").isin(BIND),
          "non_consensus": F.col("_non_consensus").isNotNull()}
    moved = F.lit(False)
    new = {}
    for f in FIELDS:
        take = F.coalesce(ok[f] & ~F.col(f"_{f}").eqNullSafe(F.col(f)), F.lit(False))
        moved = moved | take
        new[f] = F.when(take, F.col(f"_{f}")).otherwise(F.col(f))
    return rows.withColumns({**new, "last_reviewed": F.when(moved, today).otherwise(F.col("last_reviewed"))}).drop(
        *[f"_{f}" for f in FIELDS])


def append_themes(themes: DataFrame, candidates: DataFrame, today: Column) -> DataFrame:
    """Add candidates whose id is new, with neutral defaults for anything missing or invalid."""
    new = candidates.join(themes.select("theme"), "theme", "left_anti")

    def level(c: str, allowed: list[str], default: str) -> Column:
        return F.when(F.col(c).isin(allowed), F.col(c)).otherwise(default).alias(c)

    added = new.select(
        "theme", F.coalesce("sector", F.lit("Unknown (scout)")).alias("sector"),
        F.coalesce("scarcity", "theme").alias("scarcity"), level("bind_window", BIND, "2027"),
        level("priced_in", PRICED, "low"), level("durability", DURABILITY, "medium"),
        level("substitution_risk", RISK, "medium"), F.coalesce("non_consensus", F.lit(True)).alias("non_consensus"),
        today.alias("last_reviewed"), F.lit("scout").alias("source"))
    kept = themes.select("theme", "sector", "scarcity", "bind_window", "priced_in", "durability", "substitution_risk",
                         "non_consensus", "last_reviewed", F.lit("curated").alias("source"))
    return kept.unionByName(added)


def merge_phrases(existing: DataFrame, generated: DataFrame, today: Column) -> DataFrame:
    """Existing phrases keep their status; unseen ones (ignoring case) become pending."""
    fresh = generated.groupBy(F.lower("phrase").alias("_k")).agg(F.min("phrase").alias("phrase")).join(
        existing.select(F.lower("phrase").alias("_k")), "_k", "left_anti")
    return existing.select("phrase", "status", "added").unionByName(
        fresh.select("phrase", F.lit("pending").alias("status"), today.alias("added")))


def approve_pending(phrases: DataFrame) -> DataFrame:
    return phrases.withColumn("status", F.when(F.col("status") == "pending", "approved").otherwise(F.col("status")))


def suggested_action(action: Column, weight: Column, posture: Column) -> Column:
    """The policy action with the live weight and posture appended."""
    size = F.when(weight.isNotNull(), F.concat(F.lit(" Current weight ~"), F.format_number(weight * 100, 1), F.lit("%.")))
    regime = F.when(posture.isNotNull(), F.concat(F.lit(" Regime: "), posture, F.lit(".")))
    return F.trim(F.concat(F.coalesce(action, F.lit("")), F.coalesce(size, F.lit("")), F.coalesce(regime, F.lit(""))))

