"""Coverage gaps of every person, ranked by how common each service is among peers.

A footprint is the set of candidate agencies a person is linked to, as eight bits;
there are at most 256 of them. Everything about peers is worked out on that table
and joined back, so the population is read once to count and once to answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinloom.functions.expr import coverage_gaps
from kinloom.schemas import COVERAGE_AGENCIES, MASTER_ID

# Fixed value: the smallest peer group a figure is shown for.
MIN_PEERS = 100

# Advice per missing service (title, text, office).
SERVICES = {
    "Healthcare": (
        "Register with a GP practice",
        "Ensures ongoing access to primary care and prescriptions.",
        "Ferngate Community Health Office",
    ),
    "Revenue & Tax": (
        "Register for Self Assessment",
        "Keeps tax filings and payments up to date.",
        "Northshire Revenue Office",
    ),
    "Employment": (
        "Register with Jobcentre Plus",
        "Unlocks employment support and job-matching services.",
        "Aldermoor Employment Office",
    ),
    "Driver Licensing": (
        "Apply for a driving licence",
        "Needed for driving eligibility and identity verification.",
        "Aldermoor Licensing Centre",
    ),
    "Passport Office": (
        "Apply for a passport",
        "Required for international travel and identity verification.",
        "Rosewell Passport Office",
    ),
    "Social Security": (
        "Check benefit entitlement",
        "May be eligible for support such as Universal Credit or a pension.",
        "Kingsmere Social Security Office",
    ),
    "Education": (
        "Register for further education",
        "Explore adult education, apprenticeships, or training programmes.",
        "Aldergate Sixth Form College",
    ),
    "Housing": (
        "Apply for housing assistance",
        "May qualify for housing benefit or social housing support.",
        "Kingsmere Housing Authority",
    ),
}


def footprint(linked: Column) -> Column:
    bits = [F.when(F.array_contains(linked, a), 1 << i).otherwise(0) for i, a in enumerate(COVERAGE_AGENCIES)]
    return sum(bits[1:], bits[0]).cast("int")


def _subset(small: Column, large: Column) -> Column:
    return small.bitwiseAND(large) == small


def _names(mask: Column) -> Column:
    held = [F.when(mask.bitwiseAND(F.lit(1 << i)) != 0, a) for i, a in enumerate(COVERAGE_AGENCIES)]
    return F.array_compact(F.array(*held))


def footprint_counts(profiles: DataFrame) -> DataFrame:
    return profiles.groupBy(footprint(F.col("linked_agencies")).alias("mask")).agg(F.count(F.lit(1)).alias("n"))


def peer_counts(profiles: DataFrame) -> DataFrame:
    """People linked to at least the agencies of each set: one row per set, <= 256."""
    every = F.sequence(F.lit(0), F.lit(255))
    inside = F.explode(F.filter(every, lambda s: _subset(s, F.col("mask")))).alias("set")
    return footprint_counts(profiles).select(inside, "n").groupBy("set").agg(F.sum("n").alias("peers"))


def peer_groups(profiles: DataFrame, min_peers: int = MIN_PEERS) -> DataFrame:
    """Per footprint: the conditioning set in use after backing off, and its size.

    Agencies are dropped rarest first (ties in candidate order) until the group is
    large enough or nothing is left, which is the whole population.
    """
    peers = peer_counts(profiles)
    masks = footprint_counts(profiles).select("mask")
    bits = [(i, 1 << i) for i in range(len(COVERAGE_AGENCIES))]
    held = F.array(*[F.struct(F.lit(b).alias("bit"), F.lit(i).alias("i")) for i, b in bits])
    single = peers.filter(F.col("set").isin(*[b for _, b in bits])).select(F.col("set").alias("bit"), F.col("peers").alias("freq"))
    # All frames below hold at most 256 footprints times nine steps.
    rarest_first = (
        masks.select("mask", F.inline(F.filter(held, lambda h: F.col("mask").bitwiseAND(h["bit"]) != 0)))
        .join(F.broadcast(single), "bit")
        .groupBy("mask")
        .agg(F.array_sort(F.collect_list(F.struct("freq", "i", "bit"))).alias("order"))
    )
    dropped = F.aggregate(F.slice("order", 1, F.col("step")), F.lit(0), lambda acc, h: acc + h["bit"])
    steps = (
        masks.join(F.broadcast(rarest_first), "mask", "left")
        .withColumn("order", F.coalesce("order", F.array().cast("array<struct<freq:bigint,i:int,bit:int>>")))
        .withColumn("step", F.explode(F.sequence(F.lit(0), F.size("order"))))
        .withColumn("used", F.col("mask") - dropped)
        .join(F.broadcast(peers.withColumnRenamed("set", "used")), "used")
        .filter((F.col("peers") >= min_peers) | (F.col("used") == 0))
    )
    return steps.groupBy("mask").agg(F.min_by(F.struct("used", "peers"), "step").alias("g")).select(
        "mask", F.col("g.used").alias("used"), F.col("g.peers").alias("peer_group_size")
    )


def _footprint_answers(profiles: DataFrame, min_peers: int) -> DataFrame:
    """One row per footprint with its ranked gaps: at most 256 rows."""
    groups = peer_groups(profiles, min_peers)
    peers = peer_counts(profiles)
    missing = F.array(
        *[F.struct(F.lit(i).alias("i"), F.lit(1 << i).alias("bit"), F.lit(a).alias("agency")) for i, a in enumerate(COVERAGE_AGENCIES)]
    )
    population = peers.filter(F.col("set") == 0).select(F.col("peers").alias("population"), F.lit(1).alias("_one"))
    with_gap = (
        groups.select("*", F.inline(F.filter(missing, lambda m: F.col("mask").bitwiseAND(m["bit"]) == 0)))
        .withColumn("set", F.col("used").bitwiseOR(F.col("bit")))
        .join(F.broadcast(peers), "set", "left")
        .withColumn("having", F.coalesce("peers", F.lit(0)))
        .withColumn("share", F.round(F.col("having") / F.col("peer_group_size"), 4))
        .groupBy("mask")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        (-F.col("share")).alias("order"),
                        "i",
                        "agency",
                        F.col("having").alias("peers_with_record"),
                        F.col("share").alias("peer_prevalence"),
                    )
                )
            ).alias("gaps")
        )
    )
    return (
        groups.join(F.broadcast(with_gap), "mask", "left")
        .withColumn("_one", F.lit(1))
        .join(F.broadcast(population), "_one")
        .drop("_one")
    )


def recommendations(profiles: DataFrame, min_peers: int = MIN_PEERS) -> DataFrame:
    """Per person: ranked gaps with peer prevalence, and how the group was formed."""
    answers = _footprint_answers(profiles, min_peers)
    people = profiles.select(MASTER_ID, "linked_agencies", footprint(F.col("linked_agencies")).alias("mask"))
    empty = "array<struct<agency:string,peers_with_record:bigint,peer_prevalence:double>>"
    ranked = F.transform(
        "gaps", lambda g: F.struct(g["agency"].alias("agency"), g["peers_with_record"].alias("peers_with_record"), g["peer_prevalence"].alias("peer_prevalence"))
    )
    return people.join(F.broadcast(answers), "mask").select(
        MASTER_ID,
        "linked_agencies",
        F.coalesce(ranked, F.array().cast(empty)).alias("recommendations"),
        (F.size(coverage_gaps(F.col("linked_agencies"))) == 0).alias("fully_covered"),
        "peer_group_size",
        _names(F.col("used")).alias("peer_group_definition"),
        (F.col("used") == 0).alias("peer_group_is_population"),
        (F.col("used") != F.col("mask")).alias("backed_off"),
        "population",
    )


def recommendation_rows(recommended: DataFrame) -> DataFrame:
    """Long form: one row per person and gap, in rank order."""
    return recommended.select(
        MASTER_ID, F.posexplode("recommendations").alias("pos", "rec"), "peer_group_size", "backed_off"
    ).select(MASTER_ID, (F.col("pos") + 1).alias("gap_rank"), "rec.*", "peer_group_size", "backed_off")


def with_service_advice(rows: DataFrame) -> DataFrame:
    """Title, text and office for each recommended agency, its name as fallback."""
    lookup = F.create_map(
        *[
            c
            for agency, (title, text, office) in SERVICES.items()
            for c in (F.lit(agency), F.struct(F.lit(title).alias("title"), F.lit(text).alias("text"), F.lit(office).alias("office")))
        ]
    )
    return rows.withColumn("_s", F.try_element_at(lookup, F.col("agency"))).select(
        *rows.columns,
        F.coalesce("_s.title", "agency").alias("service_title"),
        F.coalesce("_s.text", F.lit("")).alias("service_text"),
        F.col("_s.office").alias("service_office"),
    )
