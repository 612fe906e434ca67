"""Personal data replaced by surrogates: keyed, of the same type and format, one to one.

Detected entities get a surrogate that depends on a secret key and the entity alone, so an
entity reads the same wherever it occurs. Digits become digits and letters become letters of
the same script and case; a name after a title gets names of that title's gender; a card
number stays (in)valid by its check digit; an address of the net stays one.

Surrogates are checked over the whole corpus: if two entities would share one, or one equals
an entity that occurs, all but the smallest try again with the next draw. Short formats that
run out of room get longer ones after GROW draws: letters or digits more with every draw (parts
of an ip first lose their number of digits, and from 2 * GROW draws on a part is added).

All of it is column expressions and joins of narrow rows; texts without entities pass by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinloom.llm.common import fresh
from kinloom.session import Scratch

# Kinds with their patterns in order of precedence, titles by gender, names to draw from.
MALE_TITLES, FEMALE_TITLES = "Mr|Herr|Señor|Sr|Monsieur|M", "Mrs|Ms|Miss|Frau|Señora|Sra|Madame|Mme"
MALE = ("Adam", "Bruno", "Carlos", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Louis", "Marco", "Nils", "Oscar", "Paul")
FEMALE = ("Alice", "Berta", "Clara", "Diana", "Elena", "Frida", "Greta", "Helena", "Irene", "Julia", "Klara", "Laura", "Maria", "Nora", "Olga", "Paula")
PERSON = rf"(?<!\p{{L}})(?:{MALE_TITLES}|{FEMALE_TITLES})\.?\x20\p{{Lu}}\p{{L}}+(?:\x20\p{{Lu}}\p{{L}}+)?"
KINDS = (
    # Tried where a run of its characters begins, and no character is given back: long runs take one look.
    # A name in the net has at most 127 parts.
    ("email", r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++){0,126}\.\p{L}{2,}"),
    ("ip", r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d.]*\d)"),
    ("card", r"(?<![\p{L}\d])\d{4}(?:[\x20-]?\d{4}){3}(?![\p{L}\d])"),
    ("phone", r"(?<![\p{L}\d])(?:\+\d{1,3}[\x20-]?)?\(?\d{3}\)?[\x20-]\d{3}[\x20-]\d{4}(?![\p{L}\d])"),
    ("person", PERSON),
)
ENTITY = "|".join(f"(?:{pattern})" for _, pattern in KINDS)
SCRIPTS = (
    (r"[a-z]", "abcdefghijklmnopqrstuvwxyz"),
    (r"[A-Z]", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    (r"[\p{IsLatin}&&\p{Ll}]", "àâäçéèêëîïñôöùûü"),
    (r"[\p{IsLatin}&&\p{Lu}]", "ÀÂÄÇÉÈÊËÎÏÑÔÖÙÛÜ"),
    (r"[\p{IsCyrillic}&&\p{Ll}]", "абвгдежзиклмнопрстуфхцчшэюя"),
    (r"[\p{IsCyrillic}&&\p{Lu}]", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ"),
    (r"[\p{IsGreek}&&\p{Ll}]", "αβγδεζηθικλμνξοπρστυφχψω"),
    (r"[\p{IsGreek}&&\p{Lu}]", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"),
    (r"\p{IsHan}", "安白程丁方高何江林马宁彭秦任宋田"),
    (r"\p{IsArabic}", "ابتثجحدرزسشصطعفقكلمنهوي"),
    (r"\p{IsHebrew}", "אבגדהוזחטיכלמנסעפצקרשת"),
)
GROW = 4  # draws after which a surrogate may be longer than what it replaces
MAX_DRAWS = 40


def _kind(entity: Column) -> Column:
    """Of the kinds, the first whose pattern fits all of the entity."""
    out = F.lit(KINDS[-1][0])
    for name, pattern in reversed(KINDS[:-1]):
        out = F.when(entity.rlike(f"^(?:{pattern})$"), F.lit(name)).otherwise(out)
    return out


def _draw(seed: Column, place: Column, size: int | Column) -> Column:
    return F.pmod(F.xxhash64(seed, place), F.lit(size)).cast("int")


def _shuffled_text(text: Column, seed: Column) -> Column:
    """Character for character: digits to digits, letters to letters of their script and case; the rest stays."""

    def one(c: Column, i: Column) -> Column:
        out = c
        for pattern, letters in reversed(SCRIPTS):
            out = F.when(c.rlike(pattern), F.substring(F.lit(letters), _draw(seed, i, len(letters)) + 1, F.lit(1))).otherwise(out)
        return F.when(c.rlike("[0-9]"), _draw(seed, i, 10).cast("string")).otherwise(out)

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn_sum(digits: Column) -> Column:
    """Check sum of a number whose last digit is the check digit."""
    values = F.transform(
        F.split(F.reverse(digits), ""),
        lambda c, i: F.when(i % 2 == 0, c.try_cast("int")).otherwise((c.try_cast("int") * 2) % 10 + F.floor(c.try_cast("int") / 5).cast("int")),
    )
    return F.aggregate(values, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10


def _card(entity: Column, seed: Column) -> Column:
    """All digits drawn anew but the last, which keeps the check sum as right or wrong as it was."""
    drawn = F.substring(_shuffled_text(entity, seed), F.lit(1), F.length(entity) - 1)
    check = lambda body: F.pmod(_luhn_sum(_digits(entity)) - _luhn_sum(F.concat(_digits(body), F.lit("0"))), F.lit(10))
    return F.get(F.transform(F.array(drawn), lambda body: F.concat(body, check(body).cast("string"))), 0)


def _ip(entity: Column, seed: Column, any_size: Column) -> Column:
    """Each part drawn among those with as many digits, or among all."""
    part = lambda p, i: F.when(any_size, _draw(seed, i, 256)).when(F.length(p) == 1, _draw(seed, i, 9) + 1).when(F.length(p) == 2, _draw(seed, i, 90) + 10).otherwise(_draw(seed, i, 156) + 100)
    return F.array_join(F.transform(F.split(entity, r"\."), lambda p, i: part(p, i).cast("string")), ".")


def _name(title: Column, names: Column, seed: Column) -> Column:
    """Names of the title's gender in Latin script, otherwise letters of the script they are in."""
    female = title.rlike(f"^(?:{FEMALE_TITLES})\\.?$")
    pick = lambda i: F.when(female, F.element_at(F.array(*map(F.lit, FEMALE)), _draw(seed, i, len(FEMALE)) + 1)).otherwise(
        F.element_at(F.array(*map(F.lit, MALE)), _draw(seed, i, len(MALE)) + 1)
    )
    # A given name and, for the last word, an invented surname.
    words = F.split(names, " ")
    surname = F.concat(F.initcap(_shuffled_text(F.lit("bcdaf"), seed)), F.lit("er"))
    latin = F.array_join(F.transform(words, lambda w, i: F.when(i == F.size(words) - 1, surname).otherwise(pick(i))), " ")
    return F.when(names.rlike(r"^[\p{IsLatin} ]+$"), latin).otherwise(_shuffled_text(names, seed))


def surrogate(kind: Column, entity: Column, key: str, draw: Column) -> Column:
    """The replacement of an entity in its `draw`-th draw."""
    seed = F.sha2(F.concat_ws("\0", F.lit(key), kind, entity, draw.cast("string")).cast("binary"), 256)
    longer = F.when(draw >= GROW, _shuffled_text(F.repeat(F.lit("x"), F.least(draw - GROW + 1, F.lit(20))), seed)).otherwise("")
    zeros = lambda since: F.when(draw >= since, F.repeat(F.lit("0"), F.least(draw - since + 1, F.lit(20)))).otherwise("")
    local, domain = F.regexp_extract(entity, "^([^@]*)@", 1), F.regexp_extract(entity, "@(.*)$", 1)
    # A domain reads the same in every address of it; its last part stays.
    of_domain = F.sha2(F.concat_ws("\0", F.lit(key), F.lit("domain"), domain).cast("binary"), 256)
    host = F.concat(_shuffled_text(F.regexp_extract(domain, r"^(.*)\.[^.]*$", 1), of_domain), F.regexp_extract(domain, r"(\.[^.]*)$", 1))
    title, names = F.regexp_extract(entity, r"^(\S+) ", 1), F.regexp_extract(entity, r"^\S+ (.*)$", 1)
    prefix = F.regexp_extract(entity, r"^(\+\d{1,3})?", 0)
    return (
        F.when(kind == "email", F.concat(_shuffled_text(local, seed), longer, F.lit("@"), host))
        .when(
            kind == "ip",
            F.concat(_ip(entity, seed, draw >= GROW), F.when(draw >= 2 * GROW, F.concat(F.lit("."), _shuffled_text(zeros(2 * GROW), seed))).otherwise("")),
        )
        .when(kind == "card", _card(F.concat(zeros(GROW), entity), seed))
        .when(kind == "phone", F.concat(prefix, _shuffled_text(F.concat(F.substring(entity, F.length(prefix) + 1, F.length(entity)), zeros(GROW)), seed)))
        .otherwise(F.concat(title, F.lit(" "), _name(title, names, seed), longer))
    )


def surrogates(entities: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """(kind, entity, surrogate) for distinct (kind, entity): no two alike, none equal to an entity of its kind.

    Spellings that differ only in case or punctuation draw for themselves.
    """
    taken = entities.select("kind", F.col("entity").alias("surrogate")).withColumn("_real", F.lit(True))
    settled, open_ = None, entities.withColumn("draw", F.lit(0))
    for draw in range(MAX_DRAWS):
        drawn = scratch.put(open_.withColumn("surrogate", surrogate(F.col("kind"), F.col("entity"), key, F.col("draw"))), f"drawn{draw % 2}")
        held = taken if settled is None else taken.unionByName(settled.select("kind", "surrogate", F.lit(True).alias("_real")))
        first = drawn.groupBy("kind", "surrogate").agg(F.min("entity").alias("first"))
        free = first.join(held, ["kind", "surrogate"], "left_anti")
        judged = scratch.put(
            drawn.join(free.withColumnRenamed("first", "entity"), ["kind", "surrogate", "entity"], "left_semi").select("kind", "entity", "surrogate"),
            f"won{draw}",
        )
        settled = judged if settled is None else settled.unionByName(judged)
        lost = drawn.join(judged.select("kind", "entity"), ["kind", "entity"], "left_anti")
        open_ = scratch.put(lost.select("kind", "entity", (F.col("draw") + 1).alias("draw")), f"open{draw % 2}")
        if open_.isEmpty():
            return settled
    raise ValueError(f"{open_.count()} entities found no surrogate of their own in {MAX_DRAWS} draws")


def replace(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """`docs` with entities in `text` replaced and a column `entities`, an array of (kind, start, surrogate).

    `start` counts characters of the new text. Texts that are null, empty or without entities
    stay as they are, with an empty array. Repeated rows are rewritten alike. A column
    `entities` that `docs` has is replaced.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    kept = docs.drop("entities")
    column = F.col(text)
    some = F.coalesce(F.regexp_like(column, F.lit(ENTITY)), F.lit(False))
    row, found, gaps, told = (fresh(kept, n) for n in ("_row", "_found", "_gaps", "_told"))
    struct = "array<struct<kind:string,start:int,surrogate:string>>"
    plain = kept.filter(~some).withColumn("entities", F.array().cast(struct))
    hit = scratch.put(
        kept.filter(some).withColumns(
            {row: F.monotonically_increasing_id(), found: F.regexp_extract_all(column, F.lit(ENTITY), F.lit(0)), gaps: F.split(column, ENTITY)}
        ).drop(text),
        "hit",
    )
    before = F.transform(F.slice(gaps, 1, F.size(found)), lambda g: F.length(g))
    places = scratch.put(
        hit.select(F.col(row).alias("row"), F.posexplode(F.arrays_zip(F.col(found).alias("entity"), before.alias("gap"))).alias("n", "e"))
        .select("row", "n", "e.entity", "e.gap")
        .withColumn("kind", _kind(F.col("entity"))),
        "places",
    )
    named = surrogates(places.select("kind", "entity").distinct(), key, scratch)
    so_far = Window.partitionBy("row").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    size = F.length("surrogate")
    placed = places.join(named, ["kind", "entity"]).withColumn("start", (F.sum(F.col("gap") + size).over(so_far) - size).cast("int"))
    per_row = placed.groupBy(F.col("row").alias(row)).agg(F.sort_array(F.collect_list(F.struct("n", "kind", "start", "surrogate"))).alias(told))
    back = hit.join(per_row, row)
    pieces = F.flatten(F.zip_with(F.slice(gaps, 1, F.size(told)), told, lambda g, s: F.array(g, s["surrogate"])))
    rewritten = F.concat(F.array_join(pieces, ""), F.get(gaps, F.size(told)))
    listed = F.transform(told, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["surrogate"].alias("surrogate")))
    changed = back.withColumns({text: rewritten, "entities": listed})
    return plain.unionByName(changed.select(*plain.columns))


def surrogate_report(docs: DataFrame, key: str) -> DataFrame:
    """(doc_id, text, n_email, n_ip, n_card, n_phone, n_person, surrogates): one row per row of `docs`, text rewritten."""
    out = replace(docs.select("doc_id", "text"), key)
    count = lambda k: F.size(F.filter("entities", lambda e: e["kind"] == k)).cast("long").alias(f"n_{k}")
    told = F.array_join(F.transform("entities", lambda e: F.concat_ws(":", e["kind"], e["start"].cast("string"), e["surrogate"])), ",")
    return out.select("doc_id", "text", *[count(k) for k, _ in KINDS], told.alias("surrogates"))
