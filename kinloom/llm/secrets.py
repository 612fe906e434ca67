"""Secret scan with corpus-wide ownership frequency.

Candidates are the matches of three fixed kinds and long mixed tokens. A candidate's hash is
counted over the corpus by distinct owners and repositories: what many owners hold is a copied
example, what one owner holds looks live. Live tokens are added to the fixed kinds as `owned`.

All of it is column expressions and joins of narrow rows. The places of matches come from
cutting the text at them: piece lengths and match lengths add up. Only hashes of candidates
are stored on the way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinloom.session import Scratch

# Kinds in their order, pattern, the group that is measured, its least length.
KINDS = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
)
OWNED = ("owned", r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}", 0, 20)
LEAST_ENTROPY = 3.0
EXAMPLE_OWNERS = 2  # a candidate of so many owners is a copied example


def entropy(value: Column) -> Column:
    """Bits per character."""
    size = F.length(value)
    share = lambda c: (size - F.length(F.replace(value, c, F.lit("")))) / size
    parts = F.transform(F.array_distinct(F.split(value, "")), lambda c: F.when(c == "", 0.0).otherwise(-share(c) * F.log2(share(c))))
    return F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)


def _matches(text: Column, rank: int, pattern: str, group: int, least: int) -> Column:
    """Array of (kind, n, gap, size, hash, good): n-th match, characters since the one before, characters of it.

    hash is null where the match is too short.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    rows = F.transform(
        F.arrays_zip(whole.alias("m"), value.alias("v"), F.slice(F.split(text, pattern), 1, F.size(whole)).alias("g")),
        lambda x, n: F.struct(
            F.lit(rank).alias("kind"), n.alias("n"), F.length(x["g"]).alias("gap"), F.length(x["m"]).alias("size"),
            F.when(F.length(x["v"]) >= least, F.sha2(x["v"].cast("binary"), 256)).alias("hash"),
            ((entropy(x["v"]) >= LEAST_ENTROPY) & x["v"].rlike("[0-9]") & x["v"].rlike("[A-Za-z]")).alias("mixed"),
        ),
    )
    return F.when(F.regexp_like(text, F.lit(pattern)), rows)


def candidates(docs: DataFrame, scratch: Scratch, owner: Column, repository: Column) -> DataFrame:
    """One row per row of `docs`: (row, doc_id, owner, repository, found); written, so that `row` is a fact."""
    text = F.coalesce("text", F.lit(""))
    found = [F.coalesce(_matches(text, rank, *kind[1:]), F.array()) for rank, kind in enumerate((*KINDS, OWNED))]
    return scratch.put(
        docs.select(
            F.monotonically_increasing_id().alias("row"), "doc_id", owner.alias("owner"), repository.alias("repository"),
            F.flatten(F.array(*found)).alias("found"),
        ),
        "candidates",
    )


def placed(found: DataFrame) -> DataFrame:
    """A row per candidate, with its place in the text in characters: (row, owner, repository, kind, start, end, hash, mixed)."""
    so_far = Window.partitionBy("row", "kind").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    rows = found.select("row", "owner", "repository", F.inline("found")).withColumn("end", F.sum(F.col("gap") + F.col("size")).over(so_far))
    return rows.filter("hash is not null").select(
        "row", "owner", "repository", "kind", (F.col("end") - F.col("size")).alias("start"), "end", "hash", "mixed"
    )


def ownership(rows: DataFrame) -> DataFrame:
    """(hash, owners, repositories) of every candidate; occurrences are reduced to distinct holders before they are counted."""
    holders = rows.groupBy("hash", "owner", "repository").agg(F.lit(1).alias("one"))
    by_owner = holders.groupBy("hash", "owner").agg(F.count("*").alias("repositories"))
    return by_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"))


def classified(docs: DataFrame, owner: Column | None = None, repository: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Per row of `docs`, and per candidate: the places of all candidates with owners, repositories and `live`.

    By default the owner is `source` and the repository is source and language; a null is an owner of its own.
    """
    scratch = Scratch(docs.sparkSession, "secrets")
    owner = F.col("source") if owner is None else owner
    repository = F.concat_ws("/", "source", "lang") if repository is None else repository
    found = candidates(docs, scratch, owner, repository)
    rows = scratch.put(placed(found), "placed")
    counted = scratch.put(ownership(rows), "ownership")
    live = (F.col("owners") < EXAMPLE_OWNERS) & F.col("mixed")
    return found, rows.join(counted, "hash").withColumn("live", live)


def secret_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example): one row per row of `docs`.

    Places count characters (code points), the end is exclusive. A null text counts as empty
    and has no spans; ids are passed through, null or repeated. `owned` spans do not overlap
    those of the fixed kinds.
    """
    found, rows = classified(docs)
    base = F.col("kind") < len(KINDS)
    in_row = Window.partitionBy("row").orderBy("start", "kind")
    rows = (
        rows.withColumns(
            {
                "_before": F.max(F.when(base, F.col("end"))).over(in_row.rowsBetween(Window.unboundedPreceding, -1)),
                "_after": F.min(F.when(base, F.col("start"))).over(in_row.rowsBetween(1, Window.unboundedFollowing)),
            }
        )
        .filter(
            base
            | F.col("live")
            & (F.coalesce("_before", F.lit(-1)) <= F.col("start"))
            & (F.coalesce(F.col("_after") >= F.col("end"), F.lit(True)))
        )
    )
    names = F.array(*[F.lit(k[0]) for k in (*KINDS, OWNED)])
    told = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    spans = F.sort_array(F.collect_list(F.struct("start", "kind", "end")))
    per_row = rows.groupBy("row").agg(
        spans.alias("all"),
        *[F.count_if(F.col("kind") == k).alias(f"n_{kind[0]}") for k, kind in enumerate(KINDS)],
        F.count_if(F.col("live")).alias("n_live"), F.count_if(~F.col("live")).alias("n_example"),
    )
    listed = lambda a: F.array_join(F.transform(a, told), ",")
    none = F.coalesce("all", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return found.select("row", "doc_id").join(per_row, "row", "left").select(
        "doc_id", zero("n_assign"), zero("n_access"), zero("n_hex"),
        F.sha2(listed(F.filter(none, lambda s: s["kind"] < len(KINDS))).cast("binary"), 256).alias("base_sha256"),
        listed(none).alias("spans"), zero("n_live"), zero("n_example"),
    )
