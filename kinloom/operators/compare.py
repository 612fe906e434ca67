"""Agreement levels of a pair, one integer per field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinloom.functions.text import similarities
from kinloom.schemas import COMPARED

# Highest agreement level per field; 0 disagrees, -1 cannot be compared.
TOP_LEVEL = {
    "first_name": 4,
    "last_name": 4,
    "date_of_birth": 4,
    "email": 4,
    "phone": 3,
    "address": 4,
    "postcode": 3,
}


# The lowest similarity any ladder asks about.
NAME_FLOOR, EMAIL_FLOOR = 0.70, 0.88
NAME_STEPS = (0.92, 0.88, 0.70)


def _ladder(left: Column, right: Column, *steps: tuple[int, Column]) -> Column:
    level = F.when(left.isNull() | right.isNull(), -1)
    for value, condition in steps:
        level = level.when(condition, value)
    return level.otherwise(0).cast("int")


def _name(left: Column, right: Column, similarity: Column) -> Column:
    steps = [(3 - i, similarity >= step) for i, step in enumerate(NAME_STEPS)]
    return _ladder(left, right, (4, left == right), *steps)


def with_parts(captured: DataFrame) -> DataFrame:
    """What the ladders look at, derived once per capture instead of once per pair."""
    code = F.replace(F.col("postcode"), F.lit(" "), F.lit(""))
    return captured.withColumns(
        {
            "initial": F.substring("first_name", 1, 1),
            "born": F.unix_date(F.try_to_date("date_of_birth", "yyyy-MM-dd")),
            "user": F.substring_index("email", "@", 1),
            "code": code,
            "outward": F.when(F.length(code) > 3, F.left(code, F.length(code) - 3)),
            "area": F.nullif(F.regexp_extract(code, "^([A-Za-z]+)", 1), F.lit("")),
        }
    )


PARTS = ("initial", "born", "user", "code", "outward", "area")
READ = (*COMPARED, *PARTS[1:])  # what `gammas` looks at


def _birth_date(left: Column, right: Column, distance: Column) -> Column:
    """Structs of the text and its day number; an unreadable date is missing."""
    a, b = left["date_of_birth"], right["date_of_birth"]
    swapped = F.concat(F.substring(a, 1, 5), F.substring(a, 9, 2), F.lit("-"), F.substring(a, 6, 2)) == b
    days = F.abs(left["born"] - right["born"])
    return _ladder(
        left["born"],
        right["born"],
        (4, a == b),
        (3, swapped | (distance >= 0)),
        (2, days <= 31),
        (1, days <= 366),
    )


EDIT_LIMITS = {"phone": (1, 2), "address": (2, 5, 10), "date_of_birth": (1,)}


def _distance(left: Column, right: Column, limit: int) -> Column:
    """Edit distance up to `limit`, -1 beyond it; only for values that differ."""
    return F.when(left != right, F.levenshtein(left, right, limit))


def _edits(left: Column, right: Column, distance: Column, limits: tuple[int, ...]) -> Column:
    """Exact on top, then one level per edit limit.

    The level is looked up by distance, so the expression holds the distance once
    and stays cheap where the optimizer copies it, for instance into a filter.
    """
    by_distance = [0] + [sum(d <= limit for limit in limits) for d in range(max(limits) + 1)]
    level = F.when(left.isNull() | right.isNull(), -1).when(left == right, len(limits) + 1)
    return level.otherwise(F.get(F.array(*[F.lit(v) for v in by_distance]), distance + 1)).cast("int")


def gammas(pairs: DataFrame, fields: tuple[str, ...] = COMPARED) -> DataFrame:
    """Add `gamma_<field>` for the fields of the structs `l` and `r`."""
    left, right = F.col("l"), F.col("r")
    fuzzy = {f: (left[f], right[f], NAME_FLOOR) for f in ("first_name", "last_name") if f in fields}
    if "email" in fields:
        other_user = left["user"] != right["user"]
        fuzzy["email"] = (F.when(other_user, left["email"]), F.when(other_user, right["email"]), EMAIL_FLOOR)
        fuzzy["user"] = (left["user"], right["user"], EMAIL_FLOOR)
    out = pairs.withColumn("sim", similarities(fuzzy)) if fuzzy else pairs
    distance = {f: _distance(left[f], right[f], max(d)) for f, d in EDIT_LIMITS.items()}
    levels: dict[str, Column] = {}
    for f in fields:
        a, b, s = left[f], right[f], F.col(f"sim.{f}")
        if f in ("first_name", "last_name"):
            levels[f] = _name(a, b, s)
        elif f == "date_of_birth":
            levels[f] = _birth_date(left, right, distance[f])
        elif f == "email":
            same_user = left["user"] == right["user"]
            levels[f] = _ladder(a, b, (4, a == b), (3, same_user), (2, s >= 0.88), (1, F.col("sim.user") >= 0.88))
        elif f in EDIT_LIMITS:
            levels[f] = _edits(a, b, distance[f], EDIT_LIMITS[f])
        else:
            steps = [(3, "code"), (2, "outward"), (1, "area")]
            levels[f] = _ladder(a, b, *[(v, left[part] == right[part]) for v, part in steps])
    return out.withColumns({f"gamma_{f}": g for f, g in levels.items()}).drop("sim")


def own_gammas(vectors: DataFrame) -> DataFrame:
    """Levels of a capture against its own copies: top where present, else -1."""
    present = {f: F.col("born" if f == "date_of_birth" else f).isNotNull() for f in COMPARED}
    return vectors.withColumns(
        {f"gamma_{f}": F.when(present[f], TOP_LEVEL[f]).otherwise(-1).cast("int") for f in COMPARED}
    )
