"""Reports over all profiles: search, quality, tiers, coverage, dashboard."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.functions import expr
from kinloom.schemas import COVERAGE_AGENCIES, ENGAGEMENT_TIERS, MASTER_ID, RECORD_ID, require


def with_tier_and_age(profiles: DataFrame, as_of: str | None = None) -> DataFrame:
    return profiles.withColumns(
        {
            "engagement_tier": expr.engagement_tier(F.col("agency_count")),
            "age": expr.age(F.col("date_of_birth"), expr.as_date(as_of)),
        }
    )


def profile_by_id(profiles: DataFrame, master_id: str, as_of: str | None = None) -> DataFrame:
    return with_tier_and_age(profiles.filter(F.col(MASTER_ID) == master_id), as_of)


def matching_ids(linked: DataFrame, profiles: DataFrame, text: str) -> DataFrame:
    """Clusters with any linked spelling, or the display name, containing `text`."""
    spelled = linked.filter(expr.ilike_contains(expr.full_name(), text)).select(MASTER_ID)
    shown = profiles.filter(expr.ilike_contains(F.col("preferred_name"), text)).select(MASTER_ID)
    return spelled.union(shown).distinct()


def search(linked: DataFrame, profiles: DataFrame, text: str, as_of: str | None = None) -> DataFrame:
    """All matches; a blank text browses everyone. Take a page with `page`."""
    text = text.strip()
    hits = profiles.join(matching_ids(linked, profiles, text), MASTER_ID, "left_semi") if text else profiles
    return with_tier_and_age(hits, as_of)


def page(results: DataFrame, limit: int = 50) -> DataFrame:
    return results.orderBy(F.col("preferred_name").asc_nulls_last(), MASTER_ID).limit(limit)


def page_with_total(results: DataFrame, limit: int = 50) -> DataFrame:
    """One page, each row carrying the uncapped number of matches."""
    total = results.agg(F.count(F.lit(1)).alias("total_matches")).withColumn("_one", F.lit(1))
    return page(results, limit).withColumn("_one", F.lit(1)).join(total, "_one").drop("_one")


def check_tier(tier: str) -> str:
    if tier not in ENGAGEMENT_TIERS:
        raise ValueError(f"unknown engagement tier '{tier}', known: {', '.join(ENGAGEMENT_TIERS)}")
    return tier


def tier_members(profiles: DataFrame, tier: str, as_of: str | None = None) -> DataFrame:
    low, high = ENGAGEMENT_TIERS[check_tier(tier)]
    n = F.col("agency_count")
    # Every count up to the first ceiling is in the first tier, as in `engagement_tier`.
    inside = n <= high if low == 1 else (n >= low if high is None else n.between(low, high))
    return with_tier_and_age(profiles.filter(inside), as_of)


def tier_page(members: DataFrame, limit: int = 50) -> DataFrame:
    return members.orderBy(
        F.desc("agency_count"), F.col("preferred_name").asc_nulls_last(), MASTER_ID
    ).limit(limit)


def engagement_tiers(profiles: DataFrame) -> DataFrame:
    """All five tiers, also the empty ones, with share and averages."""
    spark = profiles.sparkSession
    bounds = spark.createDataFrame(
        [(i, t, lo, hi) for i, (t, (lo, hi)) in enumerate(ENGAGEMENT_TIERS.items())],
        "tier_order int, engagement_tier string, min_agency_count int, max_agency_count int",
    )
    counted = (
        profiles.groupBy(expr.engagement_tier(F.col("agency_count")).alias("engagement_tier"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg("agency_count").alias("agencies"),
            F.avg("confidence_score").alias("confidence"),
        )
    )
    # Five rows on either side: the window below spans the tiers, not the data.
    joined = F.broadcast(bounds).join(counted, "engagement_tier", "left")
    totals = counted.agg(F.sum("n").alias("total")).withColumn("_one", F.lit(1))
    return (
        joined.withColumn("_one", F.lit(1))
        .join(totals, "_one", "left")
        .select(
            "tier_order",
            "engagement_tier",
            "min_agency_count",
            "max_agency_count",
            F.coalesce("n", F.lit(0)).alias("citizen_count"),
            F.coalesce(F.round(F.col("n") / F.col("total") * 100, 2), F.lit(0.0)).alias("pct_of_population"),
            F.coalesce(F.round("agencies", 2), F.lit(0.0)).alias("avg_agency_count"),
            F.coalesce(F.round("confidence", 6), F.lit(0.0)).alias("avg_confidence_score"),
        )
    )


def engagement_overall(profiles: DataFrame) -> DataFrame:
    """The tiers' citizen-weighted averages, taken directly over the profiles."""
    return profiles.agg(
        F.lit("All Citizens").alias("engagement_tier"),
        F.count(F.lit(1)).alias("citizen_count"),
        F.round(F.coalesce(F.avg("agency_count"), F.lit(0.0)), 6).alias("avg_agency_count"),
        F.round(F.coalesce(F.avg("confidence_score"), F.lit(0.0)), 6).alias("avg_confidence_score"),
    )


def _with_all_labels(counts: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    rows = [(i, label) for i, label in enumerate(labels)]
    frame = counts.sparkSession.createDataFrame(rows, "label_order int, label string")
    return F.broadcast(frame).join(counts, "label", "left").select(
        "label_order", "label", F.coalesce("n", F.lit(0)).alias("n")
    )


def probability_histogram(clusters: DataFrame) -> DataFrame:
    """Records (not clusters) per confidence bucket."""
    counts = clusters.groupBy(expr.probability_bucket(F.col("match_probability")).alias("label")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return _with_all_labels(counts, tuple(expr.PROBABILITY_BUCKETS))


def size_distribution(clusters: DataFrame) -> DataFrame:
    """Clusters per size bucket."""
    sizes = clusters.groupBy(MASTER_ID).agg(F.count(F.lit(1)).alias("size"))
    counts = sizes.groupBy(expr.size_bucket(F.col("size")).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return _with_all_labels(counts, expr.SIZE_BUCKETS)


def review_candidates(profiles: DataFrame) -> DataFrame:
    return profiles.filter("record_count > 1").select(
        MASTER_ID,
        F.col("preferred_name").alias("name"),
        F.round("confidence_score", 6).alias("match_probability"),
        "record_count",
        "linked_agencies",
        "confidence_score",
    )


def review_queue(profiles: DataFrame, limit: int = 10) -> DataFrame:
    """The least confident multi-record profiles, worst first."""
    return review_candidates(profiles).orderBy("match_probability", MASTER_ID).limit(limit).drop("confidence_score")


def quality_totals(clusters: DataFrame) -> DataFrame:
    sizes = clusters.groupBy(MASTER_ID).agg(
        F.count(F.lit(1)).alias("size"),
        F.sum("match_probability").alias("p"),
        F.count_if(F.col("match_probability") >= 0.99).alias("sure"),
    )
    return sizes.agg(
        F.count(F.lit(1)).alias("total_clusters"),
        F.round(F.coalesce(F.sum("p") / F.sum("size"), F.lit(0.0)), 6).alias("avg_match_probability"),
        F.count_if(F.col("size") > 1).alias("multi_record_cluster_count"),
        F.round(F.coalesce(F.sum("sure") / F.sum("size") * 100, F.lit(0.0)), 2).alias("high_confidence_pct"),
    )


def dashboard(citizens: DataFrame, records: DataFrame, clusters: DataFrame, profiles: DataFrame) -> DataFrame:
    """One row of headline figures; each input is aggregated once."""
    clusters_by_id = clusters.groupBy(MASTER_ID).agg(
        F.count(F.lit(1)).alias("size"), F.sum("match_probability").alias("p")
    )
    one = lambda df: df.withColumn("_one", F.lit(1))
    by_agency = records.groupBy("agency").agg(F.count(F.lit(1)).alias("n"))
    parts = [
        citizens.agg(F.count(F.lit(1)).alias("total_citizens")),
        by_agency.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("government_records"),
            F.count("agency").alias("participating_agencies"),
        ),
        clusters_by_id.agg(
            F.count(F.lit(1)).alias("resolved_citizens"),
            F.round(F.coalesce(F.sum("p") / F.sum("size"), F.lit(0.0)), 6).alias("avg_match_probability"),
            F.greatest(F.coalesce(F.sum("size"), F.lit(0)) - F.count(F.lit(1)), F.lit(0)).alias("duplicates_eliminated"),
        ),
        profiles.agg(F.round(F.coalesce(F.avg("agency_count"), F.lit(0.0)), 2).alias("avg_agencies_per_citizen")),
    ]
    out = one(parts[0])
    for part in parts[1:]:
        out = out.join(one(part), "_one")
    rate = F.col("duplicates_eliminated") / F.nullif(F.col("government_records"), F.lit(0))
    return out.drop("_one").withColumn("duplicate_rate", F.round(F.coalesce(rate, F.lit(0.0)), 6))


def records_per_agency(records: DataFrame) -> DataFrame:
    return records.groupBy("agency").agg(F.count(F.lit(1)).alias("n"))


def service_coverage(profiles: DataFrame) -> DataFrame:
    """Per candidate agency: people without a record, and whose first gap it is."""
    gaps = expr.coverage_gaps(F.col("linked_agencies"))
    first = F.get(F.col("gaps"), F.lit(0))
    counted = profiles.select(gaps.alias("gaps")).agg(
        F.count(F.lit(1)).alias("total_profiles"),
        F.count_if(F.size("gaps") == 0).alias("fully_covered"),
        *[F.count_if(F.array_contains("gaps", a)).alias(f"missing_{i}") for i, a in enumerate(COVERAGE_AGENCIES)],
        *[F.count_if(first == a).alias(f"first_{i}") for i, a in enumerate(COVERAGE_AGENCIES)],
    )
    rows = [
        F.struct(
            F.lit(i).alias("agency_order"),
            F.lit(a).alias("agency"),
            F.col(f"missing_{i}").alias("missing_records"),
            F.col(f"first_{i}").alias("first_gaps"),
        )
        for i, a in enumerate(COVERAGE_AGENCIES)
    ]
    return counted.select(F.inline(F.array(*rows)), "total_profiles", "fully_covered")


def coverage_headline(profiles: DataFrame) -> DataFrame:
    order = F.struct("missing_records", -F.col("agency_order"))
    return service_coverage(profiles).agg(
        F.max("total_profiles").alias("total_profiles"),
        F.max("fully_covered").alias("fully_covered"),
        F.max(F.col("total_profiles") - F.col("fully_covered")).alias("with_any_gap"),
        F.max_by("agency", order).alias("most_common_gap"),
        F.max("missing_records").alias("most_common_gap_count"),
    )


def gap_cells(profiles: DataFrame) -> DataFrame:
    gaps = expr.coverage_gaps(F.col("linked_agencies"))
    return profiles.select(MASTER_ID, gaps.alias("gaps")).withColumn("gap_count", F.size("gaps"))


def showcase(clusters: DataFrame, records: DataFrame) -> DataFrame:
    """One presentable cluster: 3-4 records under differing first names, never a
    criminal record; otherwise the largest cluster without one."""
    require(records, (RECORD_ID, "record_type"), "generation")
    shape = (
        clusters.select(RECORD_ID, MASTER_ID)
        .join(records.select(RECORD_ID, "first_name", "agency", "record_type"), RECORD_ID)
        .groupBy(MASTER_ID, F.lower("first_name").alias("spelling"), "agency")
        .agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("record_type") == "CRIMINAL_RECORD").alias("criminal"))
        .groupBy(MASTER_ID)
        .agg(
            F.sum("n").alias("record_count"),
            F.count_distinct("spelling").alias("spellings"),
            F.count_distinct("agency").alias("agencies"),
            F.bool_or("criminal").alias("criminal"),
        )
        .filter(~F.col("criminal"))
    )
    preferred = F.col("record_count").between(3, 4) & (F.col("spellings") >= 2)
    return (
        shape.withColumn("preferred", preferred)
        .orderBy(
            F.desc("preferred"),
            F.when(F.col("preferred"), F.col("agencies")).desc_nulls_last(),
            F.desc("record_count"),
            MASTER_ID,
        )
        .limit(1)
        .select(MASTER_ID, "record_count", "spellings", "agencies", "preferred")
    )
