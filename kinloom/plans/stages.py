"""The stored pipeline: generate, link, profile, rank; finished stages are skipped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.operators.anomaly import features, forest_scores
from kinloom.operators.link import link
from kinloom.operators.profile import build_profiles, linked_records
from kinloom.sources.synth import citizens, noisy_records, people
from kinloom.sources.synth_values import NOISE_LEVELS, PEOPLE, SEED
from kinloom.sources.tables import persist

# The noise benchmark has a population of its own, so its results stay.
KEPT = ("benchmark_results",)
# Tables that describe the generated records and go stale with them.
DOWNSTREAM = ("clusters", "linkage_edges", "linkage_copies", "linkage_members", "citizen_profiles", "anomaly_results")


class Store:
    """Derived tables in a folder, one sub-folder per version of the inputs."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _version_path(self) -> str:
        return f"{self.root}/version"

    def version(self) -> int:
        if not self._exists(self._version_path()):
            return 0
        return self.spark.read.schema("version long").json(self._version_path()).agg(F.max("version")).first()[0] or 0

    def new_version(self) -> int:
        """Leave every downstream table behind: readers look under the new number."""
        number = self.version() + 1
        self.spark.range(1).select(F.lit(number).alias("version")).write.mode("append").json(self._version_path())
        return number

    def path(self, table: str) -> str:
        if table in KEPT:
            return f"{self.root}/{table}"
        return f"{self.root}/v{self.version()}/{table}"

    def _exists(self, path: str) -> bool:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(target)

    def has(self, table: str) -> bool:
        """A finished table; a write that broke off leaves no success marker."""
        return self._exists(f"{self.path(table)}/_SUCCESS")

    def read(self, table: str) -> DataFrame:
        if not self.has(table):
            raise ValueError(f"table '{table}' is missing: run the stage that writes it first")
        return self.spark.read.parquet(self.path(table))

    def save(self, table: str, df: DataFrame) -> DataFrame:
        return persist(df, self.path(table))


def generate_stage(store: Store, n_people: int = PEOPLE, seed: int = SEED, level: str = "default") -> None:
    """A new population; everything derived from the old one becomes stale."""
    store.new_version()
    noise = NOISE_LEVELS[level]
    persons = store.save("citizens", citizens(people(store.spark, n_people), seed, noise))
    store.save("records", noisy_records(persons, seed, noise))


def link_stage(store: Store) -> None:
    found = link(store.read("records"))
    store.save("linkage_members", found.members)
    store.save("linkage_copies", found.copies)
    store.save("linkage_edges", found.edges)
    store.save("clusters", found.clusters)


def profile_stage(store: Store) -> None:
    store.save("citizen_profiles", build_profiles(linked_records(store.read("clusters"), store.read("records"))))


def anomaly_stage(store: Store) -> None:
    linked = linked_records(store.read("clusters"), store.read("records"))
    found = forest_scores(features(linked, store.read("citizen_profiles")))
    store.save("anomaly_results", found.drop("raw"))


def run(store: Store, n_people: int = PEOPLE) -> list[str]:
    """Run what is missing, in order; returns the names of the stages that ran."""
    stages: list[tuple[str, str, Callable[[], None]]] = [
        ("generate", "records", lambda: generate_stage(store, n_people)),
        ("link", "clusters", lambda: link_stage(store)),
        ("profiles", "citizen_profiles", lambda: profile_stage(store)),
        ("anomalies", "anomaly_results", lambda: anomaly_stage(store)),
    ]
    ran = []
    for name, table, build in stages:
        if not store.has(table):
            build()
            ran.append(name)
    return ran
