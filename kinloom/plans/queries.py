"""One registered query per operator of the inventory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.functions import expr
from kinloom.operators import (
    anomaly,
    blocking,
    compare,
    coverage,
    dossier,
    evaluate,
    graph,
    link,
    lof,
    population,
    profile,
    score,
    train,
)
from kinloom.operators.ranking import ranking_metrics
from kinloom.operators.train import TRAINING_RULES
from kinloom.plans import inputs, noise
from kinloom.schemas import COMPARED, MASTER_ID, RECORD_ID, TRUTH
from kinloom.session import materialize
from kinloom.sources import export, synth
from kinloom.sources.tables import read_table

AS_OF = "2025-06-01"
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def flat(df: DataFrame) -> DataFrame:
    """Lists as joined text, doubles rounded: comparable across engines."""
    out = {}
    for field in df.schema:
        kind = field.dataType.simpleString()
        if kind == "array<string>":
            out[field.name] = F.array_join(field.name, "|")
        elif kind == "double":
            out[field.name] = F.round(field.name, 6)
    return df.withColumns(out) if out else df


# ---- evaluation ---------------------------------------------------------------


@query
def baseline_metrics(spark, sf):
    return evaluate.partition_metrics(evaluate.baseline_partitions(inputs.records(spark, sf)), by=("method",))


@query
def coarse_partition_metrics(spark, sf):
    return evaluate.partition_metrics(
        evaluate.linkage_partition(inputs.surname_clusters(spark, sf), inputs.records(spark, sf))
    )


@query
def contingency_sums(spark, sf):
    return evaluate.contingency(evaluate.baseline_partitions(inputs.records(spark, sf)), by=("method",))


@query
def linkage_vs_baselines(spark, sf):
    return evaluate.evaluate_linkage(inputs.surname_clusters(spark, sf), inputs.records(spark, sf))


@query
def null_key_singletons(spark, sf):
    part = evaluate.baseline_partition(inputs.records(spark, sf), "exact_email")
    sizes = part.groupBy("predicted_id").agg(F.count(F.lit(1)).alias("n"))
    alone = F.col("predicted_id").startswith("SINGLETON:")
    return sizes.groupBy(alone.alias("declined")).agg(
        F.count(F.lit(1)).alias("clusters"), F.sum("n").alias("records"), F.max("n").alias("largest")
    )


# ---- blocking, comparison, model ----------------------------------------------


@query
def block_sizes(spark, sf):
    return blocking.block_sizes(inputs.records(spark, sf)).withColumn("block", F.replace("block", F.lit("\u0001"), F.lit("/")))


@query
def blocking_rule_counts(spark, sf):
    return blocking.union_pair_counts(inputs.records(spark, sf))


@query
def candidate_pairs(spark, sf):
    pairs = blocking.candidate_pairs(inputs.vectors(spark, sf), carried=("rep", "copies"))
    return pairs.select(
        "rule",
        F.col("l.rep").alias("rep_l"),
        F.col("r.rep").alias("rep_r"),
        F.col("l.copies").alias("copies_l"),
        F.col("r.copies").alias("copies_r"),
    )


@query
def gamma_vectors(spark, sf):
    pairs = compare.gammas(blocking.candidate_pairs(inputs.vectors(spark, sf), carried=("rep", *compare.READ)))
    return pairs.select(F.col("l.rep").alias("rep_l"), F.col("r.rep").alias("rep_r"), *score.GAMMA_COLUMNS)


def patterns_of(spark, sf, rule):
    return train.gamma_patterns(inputs.vectors(spark, sf), rule, tuple(f for f in COMPARED if f not in rule))


@query
def gamma_patterns_names(spark, sf):
    return patterns_of(spark, sf, TRAINING_RULES[0])


@query
def gamma_patterns(spark, sf):
    return patterns_of(spark, sf, TRAINING_RULES[1])


@query
def gamma_patterns_postcode(spark, sf):
    return patterns_of(spark, sf, TRAINING_RULES[2])


@query
def prior_estimate(spark, sf):
    return train.prior_estimate(inputs.records(spark, sf)).withColumn("prior", F.round("prior", 9))


@query
def term_frequencies(spark, sf):
    vectors = inputs.vectors(spark, sf)
    tables = [
        score.term_frequencies(vectors, f).withColumn("field", F.lit(f)) for f in score.FREQUENCY_FIELDS
    ]
    return tables[0].unionByName(tables[1]).withColumn("tf", F.round("tf", 9))


@query
def fixed_param_scores(spark, sf):
    return flat(score.score_pairs(inputs.vectors(spark, sf), inputs.FIXED_MODEL))


@query
def copy_scores(spark, sf):
    return flat(score.score_copies(inputs.vectors(spark, sf), inputs.FIXED_MODEL))


# ---- clustering ----------------------------------------------------------------


@query
def components(spark, sf):
    lk = inputs.linkage(spark, sf)
    return link.cluster_edges(lk.members, lk.edges, lk.copies).select(RECORD_ID, "component")


@query
def master_ids(spark, sf):
    return flat(inputs.linkage(spark, sf).clusters)


@query
def record_edges(spark, sf):
    lk = inputs.linkage(spark, sf)
    return flat(link.record_edges(lk.members, lk.edges, lk.copies))


@query
def linkage_summary(spark, sf):
    return link.linkage_summary(inputs.linkage(spark, sf).clusters)


@query
def linkage_quality(spark, sf):
    return evaluate.partition_metrics(
        evaluate.linkage_partition(inputs.linkage(spark, sf).clusters, inputs.records(spark, sf))
    )


@query
def threshold_sweep(spark, sf):
    lk = inputs.linkage(spark, sf)
    return link.threshold_sweep(inputs.records(spark, sf), lk.members, lk.edges, lk.copies)


@query
def sweep_readings(spark, sf):
    return evaluate.sweep_readings(threshold_sweep(spark, sf))


@query
def trained_link(spark, sf):
    """Trained end to end on the table itself: a row of quality next to the best rule's."""
    rec = inputs.records(spark, sf)
    trained = inputs.stage(spark, sf, "trained", lambda: link.link(rec))
    return evaluate.evaluate_linkage(trained.clusters, rec)


# ---- profiles --------------------------------------------------------------------


@query
def profile_build(spark, sf):
    return flat(inputs.profiles(spark, sf))


@query
def best_name(spark, sf):
    return profile.survivors(inputs.linked(spark, sf)).select(MASTER_ID, "preferred_name")


@query
def best_dob(spark, sf):
    return profile.survivors(inputs.surname_linked(spark, sf)).select(MASTER_ID, "date_of_birth")


@query
def best_address(spark, sf):
    place = F.col("place")
    return profile.survivors(inputs.surname_linked(spark, sf)).select(
        MASTER_ID, place["a"].alias("current_address"), place["b"].alias("current_city"), place["c"].alias("current_postcode")
    )


@query
def linked_profile_build(spark, sf):
    """Profiles over the linkage's own clusters."""
    lk = inputs.linkage(spark, sf)
    return flat(profile.build_profiles(profile.linked_records(lk.clusters, inputs.records(spark, sf))))


@query
def event_profiles(spark, sf):
    """The same aggregation over another source: one profile per event user."""
    ev = read_table(spark, sf, "events").select(
        F.col("user_id"), "event_type", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"), "value", "event_id"
    )
    kinds = F.array_sort(F.collect_set("event_type"))
    newest = lambda t: F.max_by("value", F.when(F.col("event_type") == t, F.struct("at", "event_id")))
    return flat(
        ev.groupBy("user_id").agg(
            F.count(F.lit(1)).alias("record_count"),
            F.size(kinds).cast("long").alias("agency_count"),
            kinds.alias("linked_agencies"),
            F.count_if(F.col("event_type") == "purchase").alias("purchases"),
            newest("purchase").alias("latest_purchase"),
            newest("signup").alias("latest_signup"),
            F.max("at").alias("last_seen"),
        )
    )


# ---- dossier ---------------------------------------------------------------------


@query
def dossier_records(spark, sf):
    return flat(dossier.dossier_records(inputs.linked(spark, sf))).withColumn(
        "attributes", expr.attributes_text(F.col("attributes"))
    )


@query
def field_agreement(spark, sf):
    return dossier.field_agreement(inputs.linked(spark, sf))


@query
def field_agreement_values(spark, sf):
    return flat(dossier.agreement_lists(inputs.linked(spark, sf)))


@query
def fact_tags(spark, sf):
    return dossier.fact_tags(inputs.linked(spark, sf), inputs.profiles(spark, sf), AS_OF)


@query
def case_file(spark, sf):
    return flat(dossier.case_file(inputs.linked(spark, sf))).withColumn(
        "attributes", expr.attributes_text(F.col("attributes"))
    )


@query
def dossiers(spark, sf):
    """The nested dossier, shown by its size, ends and parts."""
    d = dossier.dossiers(inputs.linked(spark, sf), inputs.profiles(spark, sf), AS_OF)
    rec = F.col("records")
    return d.select(
        MASTER_ID,
        "page",
        "age",
        "engagement_tier",
        F.size(rec).alias("records"),
        F.get(rec, F.lit(0))[RECORD_ID].alias("first_record"),
        F.element_at(rec, -1)[RECORD_ID].alias("last_record"),
        F.size(F.filter("field_agreement", lambda a: ~a["is_consistent"])).alias("disputed_fields"),
        F.array_join(F.transform("summary", lambda t: t["tag"]), "|").alias("tags"),
    )


# ---- population ------------------------------------------------------------------


@query
def quality_histogram(spark, sf):
    return population.probability_histogram(inputs.clusters(spark, sf))


@query
def size_distribution(spark, sf):
    return population.size_distribution(inputs.clusters(spark, sf))


@query
def quality_totals(spark, sf):
    return population.quality_totals(inputs.clusters(spark, sf))


@query
def review_queue(spark, sf):
    return flat(population.review_queue(inputs.profiles(spark, sf)))


@query
def dashboard(spark, sf):
    people = read_table(spark, sf, "customer")
    return population.dashboard(
        people, inputs.records(spark, sf), inputs.clusters(spark, sf), inputs.profiles(spark, sf)
    )


@query
def records_per_agency(spark, sf):
    return population.records_per_agency(inputs.records(spark, sf))


@query
def engagement_tiers(spark, sf):
    return population.engagement_tiers(inputs.profiles(spark, sf))


@query
def engagement_overall(spark, sf):
    return population.engagement_overall(inputs.profiles(spark, sf))


@query
def tier_members(spark, sf):
    members = population.tier_members(inputs.profiles(spark, sf), "High Engagement", AS_OF)
    return flat(members).select(MASTER_ID, "preferred_name", "agency_count", "engagement_tier", "age")


@query
def tier_page(spark, sf):
    members = population.tier_members(inputs.profiles(spark, sf), "Moderate Engagement", AS_OF)
    return population.tier_page(members, 50).select(MASTER_ID, "preferred_name", "agency_count", "engagement_tier", "age")


@query
def search(spark, sf):
    found = population.search(inputs.linked(spark, sf), inputs.profiles(spark, sf), " bob ash ", AS_OF)
    return found.select(MASTER_ID, "preferred_name", "engagement_tier", "age", "record_count")


@query
def search_page(spark, sf):
    found = population.search(inputs.linked(spark, sf), inputs.profiles(spark, sf), "thomas", AS_OF)
    return population.page_with_total(found, 50).select(MASTER_ID, "preferred_name", "total_matches")


@query
def profile_lookup(spark, sf):
    one = population.profile_by_id(inputs.profiles(spark, sf), "MC00007", AS_OF)
    return flat(one).select(MASTER_ID, "preferred_name", "age", "engagement_tier", "linked_agencies", "confidence_score")


@query
def service_coverage(spark, sf):
    return population.service_coverage(inputs.profiles(spark, sf))


@query
def coverage_headline(spark, sf):
    return population.coverage_headline(inputs.profiles(spark, sf))


@query
def first_gap(spark, sf):
    return inputs.profiles(spark, sf).groupBy(expr.first_gap(F.col("linked_agencies")).alias("next_gap")).agg(
        F.count(F.lit(1)).alias("citizen_count")
    )


@query
def gap_cells(spark, sf):
    return flat(population.gap_cells(inputs.profiles(spark, sf)))


@query
def showcase(spark, sf):
    return population.showcase(inputs.clusters(spark, sf), inputs.records(spark, sf))


# ---- exports ---------------------------------------------------------------------


@query
def export_directory(spark, sf):
    return export.directory(inputs.linked(spark, sf), inputs.profiles(spark, sf), "", AS_OF)


@query
def export_tier_members(spark, sf):
    return export.tier_directory(inputs.profiles(spark, sf), "Limited Engagement", AS_OF)


@query
def export_review(spark, sf):
    return export.review_rows(inputs.profiles(spark, sf), 500)


@query
def report_profiles(spark, sf):
    return export.report_profiles(population.with_tier_and_age(inputs.profiles(spark, sf), AS_OF))


@query
def report_table(spark, sf):
    return export.report_records(inputs.linked(spark, sf))


@query
def report_agreement(spark, sf):
    rows = inputs.linked(spark, sf)
    return export.report_agreement(dossier.field_agreement(rows), dossier.agreement_lists(rows))


# ---- coverage --------------------------------------------------------------------


@query
def peer_groups(spark, sf):
    return coverage.peer_groups(inputs.profiles(spark, sf)).select(
        F.array_join(coverage._names(F.col("mask")), "|").alias("footprint"),
        F.array_join(coverage._names(F.col("used")), "|").alias("peer_group_definition"),
        "peer_group_size",
    )


@query
def peer_prevalence(spark, sf):
    return coverage.recommendation_rows(coverage.recommendations(inputs.profiles(spark, sf)))


@query
def peer_backoff(spark, sf):
    rows = coverage.recommendations(inputs.profiles(spark, sf))
    return flat(rows.drop("recommendations"))


@query
def service_advice(spark, sf):
    rows = coverage.recommendation_rows(coverage.recommendations(inputs.profiles(spark, sf)))
    return coverage.with_service_advice(rows.select(MASTER_ID, "gap_rank", "agency"))


# ---- evidence graph --------------------------------------------------------------


def _graph(spark, sf):
    def build():
        lk = inputs.linkage(spark, sf)
        inside = graph.inner_edges(lk.clusters, graph.compact_edges(lk.edges, lk.copies, lk.members))
        return materialize(graph.graph_edges(inside, graph.bridges(inside)), "graph")

    return inputs.linkage(spark, sf), inputs.stage(spark, sf, "graph", build)


@query
def cluster_graph(spark, sf):
    """Inner edges with evidence, the evidence shown as text."""
    _, edges = _graph(spark, sf)
    shown = graph.edge_evidence(edges, inputs.records(spark, sf))
    text = F.transform("evidence", lambda e: F.concat(e["field"], F.lit("="), e["agreement"]))
    values = F.transform(
        "evidence", lambda e: F.concat(F.coalesce(e["left_value"], F.lit("-")), F.lit("~"), F.coalesce(e["right_value"], F.lit("-")))
    )
    return shown.select(
        MASTER_ID, "source_record_id_l", "source_record_id_r", "match_probability", "pairs", "is_load_bearing",
        F.array_join(text, "|").alias("evidence"),
        F.array_join(values, "|").alias("side_values"),
        F.array_join("agreeing_fields", "|").alias("agreeing_fields"),
    )


@query
def graph_nodes(spark, sf):
    lk, edges = _graph(spark, sf)
    return graph.graph_nodes(lk.clusters, inputs.records(spark, sf), edges, lk.members)


@query
def bridges(spark, sf):
    """Record-level bridges per cluster."""
    _, edges = _graph(spark, sf)
    return edges.filter("is_bridge").select(
        MASTER_ID, "source_record_id_l", "source_record_id_r", "match_probability", "bridges"
    )


@query
def graph_summary(spark, sf):
    lk, edges = _graph(spark, sf)
    return graph.graph_summary(lk.clusters, edges)


# ---- anomalies -------------------------------------------------------------------


def _features(spark, sf):
    def build():
        linked = inputs.surname_linked(spark, sf)
        return materialize(anomaly.features(linked, profile.cluster_aggregates(linked)), "features")

    return inputs.stage(spark, sf, "features", build)


def _forest(spark, sf):
    return inputs.stage(spark, sf, "forest", lambda: materialize(anomaly.forest_scores(_features(spark, sf)), "forest"))


@query
def features(spark, sf):
    linked = inputs.surname_linked(spark, sf)
    return flat(anomaly.features(linked, profile.cluster_aggregates(linked)))


@query
def robust_z(spark, sf):
    return flat(anomaly.robust_z(_features(spark, sf)))


@query
def error_labels(spark, sf):
    return anomaly.error_labels(inputs.surname_linked(spark, sf))


@query
def detector_metrics(spark, sf):
    scores = anomaly.robust_z(_features(spark, sf)).withColumn("detector", F.lit("max_robust_zscore"))
    return anomaly.detector_metrics(scores, anomaly.error_labels(inputs.surname_linked(spark, sf)))


@query
def detector_comparison(spark, sf):
    linked = inputs.surname_linked(spark, sf)
    return anomaly.compare_detectors(linked, profile.build_profiles(linked))


@query
def identity_conflicts(spark, sf):
    return anomaly.identity_conflicts(inputs.surname_linked(spark, sf))


@query
def forest_scores(spark, sf):
    return flat(_forest(spark, sf).drop("top_factors", "raw"))


@query
def forest_factors(spark, sf):
    return flat(anomaly.factor_rows(_forest(spark, sf)))


@query
def anomaly_totals(spark, sf):
    return anomaly.anomaly_totals(_forest(spark, sf))


@query
def score_histogram(spark, sf):
    return anomaly.score_histogram(_forest(spark, sf))


@query
def anomaly_queue(spark, sf):
    linked = inputs.surname_linked(spark, sf)
    queue = anomaly.anomaly_queue(_forest(spark, sf), profile.build_profiles(linked), linked)
    return queue.withColumns(
        {
            "top_factors": F.array_join(F.transform("top_factors", lambda f: f["feature"]), "|"),
            "conflicts": F.array_join(
                F.transform("conflicts", lambda c: F.concat(c["field"], F.lit("="), F.array_join(c["values"], ","))), "|"
            ),
        }
    )


@query
def lof_scores(spark, sf):
    return flat(anomaly.lof_scores(_features(spark, sf)))


@query
def embedding_outliers(spark, sf):
    """The density detector on dense vectors: equal vectors share one point."""
    rows = read_table(spark, sf, "embeddings").select(
        F.col("vec_id").cast("string").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("vector")
    )
    points = rows.groupBy("vector").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("weight"))
    return lof.local_outlier_factors(points, 20).withColumn("lof", F.round("lof", 6))


@query
def label_ranking(spark, sf):
    """Ranking quality of text length as a score for the labelled quality."""
    docs = read_table(spark, sf, "documents").select("doc_id", "n_chars")
    scored = read_table(spark, sf, "labels").join(docs, "doc_id").select(
        F.lit("n_chars").alias("detector"),
        F.lpad(F.col("doc_id").cast("string"), 20, "0").alias("id"),
        F.col("n_chars").cast("double").alias("score"),
        (F.col("quality") == 1).alias("label"),
    )
    return ranking_metrics(scored, 0.05)


# ---- generated population --------------------------------------------------------


def _people(spark, sf):
    """Person ids for the generator: the customers of the table."""
    return read_table(spark, sf, "customer").select(F.col("c_custkey").alias(TRUTH))


def _population(spark, sf, level="default"):
    """(citizens, records) as they are drawn: a reader computes the columns it asks for and no others."""
    return synth.generate(_people(spark, sf), noise=synth.noise_level(level))


def _generated(spark, sf):
    """The default population with its records written, for readers of all columns."""

    def build():
        persons, records = _population(spark, sf)
        return persons, materialize(records, "generated")

    return inputs.stage(spark, sf, "generated", build)


@query
def generated_citizens(spark, sf):
    return _population(spark, sf)[0]


@query
def generated_records(spark, sf):
    records = _generated(spark, sf)[1]
    return records.withColumn("attributes", expr.attributes_text(F.col("attributes")))


@query
def generated_invariants(spark, sf):
    """What must hold of any generated population, counted as violations."""
    persons, records = _generated(spark, sf)
    per_person = records.groupBy(TRUTH).agg(
        F.count_distinct("agency").alias("agencies"),
        F.count_if(F.col("record_type") == "HOSPITAL_VISIT").alias("visits"),
        F.count_if(F.col("record_type") == "PRESCRIPTION").alias("prescriptions"),
        F.count_if(F.col("agency") == "Healthcare").alias("health"),
        F.count(F.lit(1)).alias("n"),
    )
    covered = persons.join(per_person, TRUTH, "left")
    wrong_person = covered.agg(
        F.count(F.lit(1)).alias("people"),
        F.count_if(F.coalesce("n", F.lit(0)) == 0).alias("without_record"),
        F.count_if(F.col("agencies") > 6).alias("too_many_agencies"),
        F.count_if((F.col("health") > 0) & ~F.col("visits").between(1, 3)).alias("wrong_visits"),
        F.count_if(F.col("prescriptions") > 2).alias("wrong_prescriptions"),
    )
    kind = F.col("record_type")
    wrong_record = records.agg(
        (F.count(F.lit(1)) - F.count_distinct(RECORD_ID)).alias("repeated_ids"),
        F.count_if(F.col("expiry_date").isNotNull() != kind.isin("DRIVING_LICENCE", "PASSPORT")).alias("wrong_expiry"),
        F.count_if(F.col("amount").isNotNull() != kind.isin("TAX_RECORD", "BENEFITS_RECORD", "EMPLOYMENT_REGISTRATION", "HOUSING_BENEFIT")).alias("wrong_amount"),
        F.count_if(F.col("marital_status").isNotNull() != kind.isin("TAX_RECORD", "BENEFITS_RECORD")).alias("wrong_marital"),
        F.count_if(F.col("detail").isNull() != kind.isin("TAX_RECORD", "HEALTHCARE_REGISTRATION", "PASSPORT")).alias("wrong_detail"),
        F.count_if(F.col("record_date") > "2025-06-01").alias("future_records"),
        F.count_if(F.size("attributes") < 3).alias("thin_attributes"),
        F.count_if((kind == "DRIVING_LICENCE") & ((F.col("attributes")["points"] == "0") != (F.col("attributes")["endorsements"] == "None"))).alias("wrong_endorsements"),
    )
    return wrong_person.withColumn("_one", F.lit(1)).join(wrong_record.withColumn("_one", F.lit(1)), "_one").drop("_one")


@query
def pristine_capture(spark, sf):
    """Without noise every record repeats its person exactly: mismatches per field."""
    persons, records = _population(spark, sf, "pristine")
    fields = [*COMPARED, "city"]
    true = persons.select(TRUTH, *[F.col(c).alias(f"p_{c}") for c in fields])
    joined = records.select(TRUTH, *fields).join(true, TRUTH)
    return joined.agg(
        F.count_distinct(TRUTH).alias("people"),
        *[F.count_if(~F.col(c).eqNullSafe(F.col(f"p_{c}"))).alias(f"differs_{c}") for c in fields],
    )


@query
def noise_rises(spark, sf):
    """Missing values and name variants must grow with every noise level."""
    rows = None
    for i, level in enumerate(("pristine", "light", "default", "heavy", "severe")):
        of_person = _population(spark, sf, level)[1].groupBy(TRUTH).agg(
            F.count_distinct("first_name").alias("variants"),
            F.sum(F.expr("int(email is null) + int(phone is null) + int(address is null)")).alias("missing"),
            F.count(F.lit(1)).alias("n"),
        )
        measured = of_person.agg((F.sum("missing") / F.sum("n")).alias("missing"), F.avg("variants").alias("variants"))
        row = measured.select(F.struct(F.lit(i).alias("level"), "missing", "variants").alias("m"))
        rows = row if rows is None else rows.unionByName(row)
    steps = F.array_sort(F.collect_list("m"))
    rising = lambda c: F.forall(F.sequence(F.lit(1), F.lit(4)), lambda i: F.get("s", i)[c] > F.get("s", i - 1)[c])
    return rows.agg(steps.alias("s")).select(
        F.size("s").alias("levels"), rising("missing").alias("missing_rises"), rising("variants").alias("variants_rise")
    )


@query
def noise_benchmark(spark, sf):
    return noise.noise_benchmark(_people(spark, sf))
