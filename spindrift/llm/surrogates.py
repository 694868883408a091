"""Surrogates for personal data and secrets, in DataFrame operations alone.

A pattern finds the entities of a text.  Each is replaced by another value of its
type, drawn by a keyed function of its canonical form alone, so that an entity has
one surrogate wherever it stands, in any spelling.  Numbers go through keyed
permutations of their digits, which keep punctuation, length and check digits;
names keep title, gender and script.  Over the whole corpus, two entities with one
surrogate, or a surrogate that is somebody's real value, count as a collision: all
but one of the entities are drawn again until none is left.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .lines import let

#: Given names by script and gender, and titles by gender.
NAMES = {
    "latin": {
        "m": "James John Robert Michael William David Richard Thomas Charles Daniel Matthew Anthony Pierre Jean Hans Klaus Carlos Miguel Antonio Javier".split(),
        "f": "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Margaret Marie Sophie Ingrid Petra Carmen Lucia Isabel Elena".split(),
    },
    "cyrillic": {
        "m": "Иван Дмитрий Сергей Алексей Николай Михаил Андрей Владимир Павел Олег".split(),
        "f": "Анна Мария Ольга Елена Наталья Татьяна Ирина Светлана Екатерина Юлия".split(),
    },
}
TITLES = {"m": ["Mr", "Herr", "Monsieur", "Señor", "Господин"], "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Señora", "Госпожа"], "n": ["Dr", "Prof"]}
CONSONANTS = {"latin": "b d f g k l m n p r s t v z".split(), "cyrillic": "б д ж з к л м н п р с т в ш".split()}
VOWELS = {"latin": "a e i o u".split(), "cyrillic": "а е и о у".split()}

_every = lambda groups: "|".join(w for g in groups for w in g)
_TITLE = f"(?:{_every(TITLES.values())})"
_GIVEN = f"(?:{_every(n for s in NAMES.values() for n in s.values())})"
#: First letters of all titles and given names: a quick look before anything else.
_FIRST = "".join(sorted({w[0] for g in (*TITLES.values(), *(n for s in NAMES.values() for n in s.values())) for w in g}))
_SURNAME = r"\p{Lu}\p{Ll}{1,30}+(?:[-'’]\p{Lu}\p{Ll}{1,30}+)?"
_BYTE = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
#: Pattern of each type, in the order in which they are tried at a place.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]{1,64}+@[\p{L}\p{N}](?:[\p{L}\p{N}\-]{0,62})(?:\.[\p{L}\p{N}\-]{1,63})*\.\p{L}{2,24}",
    "secret": r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64}|AKIA[0-9A-Z]{16}|gh[opsu]_[0-9A-Za-z]{36})(?![0-9A-Za-z])",
    "ip": rf"(?<![\d.])(?:{_BYTE}\.){{3}}{_BYTE}(?!\d|\.\d)",
    "phone": r"(?<![\d+])(?:\+\d{1,3}(?:[ .\-]?\(\d{1,4}\))?(?:[ .\-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}[ .\-]\d{4}|\d{3}[.\-]\d{3}[.\-]\d{4})(?!\d)",
    "ssn": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    "card": r"(?<!\d)(?:\d{4} \d{4} \d{4} \d{4}|\d{4}-\d{4}-\d{4}-\d{4}|\d{13,19})(?!\d)",
    "iban": r"(?<![0-9A-Z])[A-Z]{2}\d{2}[0-9A-Z]{11,30}(?![0-9A-Za-z])",
    "person": rf"(?=[{_FIRST}])(?<!\p{{L}})(?:{_TITLE}\.? (?:{_GIVEN} )?{_SURNAME}|{_GIVEN} {_SURNAME})(?!\p{{L}})",
}
PATTERN = "|".join(PATTERNS.values())
#: Every entity but a person holds a digit or one of these; other texts, most of them, need the one pattern alone.
MARKS = r"[0-9@]|AKIA|gh[opsu]_|[A-Fa-f]{32}"


def kind(value: Column) -> Column:
    """Type of a whole match; the first that fits it, as in the joint pattern."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(PATTERNS.items()):
        out = F.when(value.rlike(f"^(?:{pattern})$"), name).otherwise(out)
    return out


def canonical(value: Column, of: Column) -> Column:
    """What all spellings of an entity have in common."""
    return (
        F.when(of == "email", F.lower(value))
        .when(of.isin("phone", "ssn", "card"), F.regexp_replace(value, r"\D", ""))
        .when(of == "person", F.regexp_replace(value, rf"^(?:{_TITLE}\.? )?(?:{_GIVEN} )?", ""))
        .otherwise(value)
    )


def draw(n: int, *seed: Column) -> Column:
    """A number below n, from a hash of the seed."""
    return F.pmod(F.xxhash64(*seed), F.lit(n))


def feistel(left: Column, right: Column, size: Column, seed: list[Column], then: Callable[[Column, Column], Column]) -> Column:
    """A keyed permutation of pairs of numbers below ``size``."""

    def round_(s: Column, i: Column) -> Column:
        return F.struct(s["r"].alias("l"), F.pmod(s["l"] + F.pmod(F.xxhash64(s["r"], i, *seed), size), size).alias("r"))

    start = F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r"))
    return F.aggregate(F.array(*map(F.lit, range(4))), start, round_, lambda s: then(s["l"], s["r"]))


def permuted(digits: Column, seed: list[Column]) -> Column:
    """A keyed permutation of digit strings of one length; the first digit stays if the length is odd, and so do digits beyond 34."""

    def of(d: Column) -> Column:
        half = F.least(F.floor(F.length(d) / 2), F.lit(17)).cast("int")
        head = F.length(d) - 2 * half
        size = F.rpad(F.lit("1"), half + 1, F.lit("0")).cast("bigint")
        a, b = F.substring(d, head + 1, half), F.substring(d, head + half + 1, half)
        # the length is part of the key
        return F.when(half == 0, d).otherwise(F.concat(F.substring(d, F.lit(1), head), feistel(a, b, size, [*seed, half], lambda x, y: F.concat(F.lpad(x.cast("string"), half, F.lit("0")), F.lpad(y.cast("string"), half, F.lit("0"))))))

    return let(digits, of)


def refilled(template: Column, digits: Column) -> Column:
    """The template with its digits replaced in order."""

    def step(s: Column, c: Column) -> Column:
        digit = c.rlike("^[0-9]$")
        return F.struct(F.concat(s["out"], F.when(digit, F.substring(digits, s["i"] + 1, F.lit(1))).otherwise(c)).alias("out"), (s["i"] + digit.cast("int")).alias("i"))

    return F.aggregate(F.split(template, ""), F.struct(F.lit("").alias("out"), F.lit(0).alias("i")), step, lambda s: s["out"])


def check_digit(digits: Column) -> Column:
    """The digit that makes ``digits`` and it pass the Luhn check."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, F.when(c.cast("int") > 4, 2 * c.cast("int") - 9).otherwise(2 * c.cast("int"))).otherwise(c.cast("int")))
    return F.pmod(-F.aggregate(each, F.lit(0), lambda s, x: s + x), F.lit(10))


def card(digits: Column, seed: list[Column]) -> Column:
    """First digit kept, the body permuted, and a check digit that is as right or as wrong as the old one."""

    def of(d: Column) -> Column:
        n = F.length(d)
        body = F.substring(d, F.lit(1), n - 1)
        off = F.substring(d, n, F.lit(1)).cast("int") - check_digit(body)
        fresh = F.concat(F.substring(d, F.lit(1), F.lit(1)), permuted(F.substring(d, F.lit(2), n - 2), seed))
        return let(fresh, lambda f: F.concat(f, F.pmod(check_digit(f) + off, F.lit(10)).cast("string")))

    return let(digits, of)


def syllables(n: int, script: str, seed: list[Column]) -> Column:
    """A made-up word of n syllables."""
    c, v = CONSONANTS[script], VOWELS[script]
    parts = []
    for i in range(n):
        parts += [F.element_at(F.array(*map(F.lit, c)), (draw(len(c), *seed, F.lit(2 * i)) + 1).cast("int")), F.element_at(F.array(*map(F.lit, v)), (draw(len(v), *seed, F.lit(2 * i + 1)) + 1).cast("int"))]
    return F.concat(*parts)


def is_cyrillic(value: Column) -> Column:
    return value.rlike(r"\p{IsCyrillic}")


def person(value: Column, seed: list[Column]) -> Column:
    """Title kept; a given name of the same script and gender; a made-up surname, the same for all who share one.

    Given names go round their list by a keyed step, so that no two become one; the
    surnames are kept apart by ``collisions``.  Drawn again, a surname is longer.
    """
    title = F.regexp_extract(value, rf"^({_TITLE}\.? )?", 1)
    rest = F.regexp_replace(value, rf"^{_TITLE}\.? ", "")
    given = F.regexp_extract(rest, rf"^({_GIVEN}) ", 1)
    surname = F.regexp_replace(rest, rf"^{_GIVEN} ", "")
    drawn = lambda script: F.concat(syllables(4, script, [surname, *seed]), F.when(seed[-1] > 0, syllables(3, script, [surname, *seed, F.lit("more")])).otherwise(""))
    fresh = F.initcap(F.when(is_cyrillic(surname), drawn("cyrillic")).otherwise(drawn("latin")))
    first = F.lit("")
    for script, genders in NAMES.items():
        for gender, names in genders.items():
            listed = F.array(*map(F.lit, names))
            step = 1 + draw(len(names) - 1, *seed[:-1])
            pick = F.element_at(listed, (F.pmod(F.array_position(listed, given) - 1 + step, F.lit(len(names))) + 1).cast("int"))
            first = F.when(given.isin(names), F.concat(pick, F.lit(" "))).otherwise(first)
    return F.concat(title, first, fresh)


def secret(value: Column, seed: list[Column]) -> Column:
    """Hexadecimal digits of the same length and case; a prefix that tells the kind stays."""
    prefix = F.regexp_extract(value, r"^(AKIA|gh[opsu]_)?", 1)
    hexes = F.concat(F.sha2(F.concat_ws("|", *seed, value), 256), F.sha2(F.concat_ws("|", value, *seed), 256))
    fresh = F.concat(prefix, F.substring(hexes, F.lit(1), F.length(value) - F.length(prefix)))
    return F.when(F.upper(value) == value, F.upper(fresh)).otherwise(fresh)


def iban(value: Column, seed: list[Column]) -> Column:
    """Country kept, each kind of character replaced by its kind."""
    digest = F.sha2(F.concat_ws("|", *seed, value), 512)
    return F.concat(
        F.substring(value, F.lit(1), F.lit(2)),
        F.array_join(
            F.transform(
                F.split(F.substring(value, F.lit(3), F.length(value)), ""),
                lambda c, i: let(F.conv(F.substring(digest, 3 * i + 1, F.lit(3)), 16, 10).cast("int"), lambda x: F.when(c.rlike("[0-9]"), (x % 10).cast("string")).otherwise(F.char(65 + x % 26))),
            ),
            "",
        ),
    )


def address(value: Column, seed: list[Column]) -> Column:
    parts = F.split(value, r"\.")
    number = lambda i: F.get(parts, F.lit(i)).cast("int")
    text = lambda x: F.concat((x / 256).cast("int").cast("string"), F.lit("."), (x % 256).cast("string"))
    return feistel(number(0) * 256 + number(1), number(2) * 256 + number(3), F.lit(65536), seed, lambda x, y: F.concat(text(x), F.lit("."), text(y)))


def surrogate(value: Column, of: Column, key: str, attempt: Column) -> Column:
    seed = [of, F.lit(key), attempt]
    digits = F.regexp_replace(value, r"\D", "")
    lower = F.lower(value)
    domain = F.substring_index(lower, "@", -1)
    # the country code, as long as the first digit, stays
    phone = let(digits, lambda d: F.concat(F.substring(d, F.lit(1), F.lit(1)), permuted(F.substring(d, F.lit(2), F.length(d)), seed)))
    return (
        F.when(of == "email", F.concat(syllables(6, "latin", [lower, *seed]), F.lit("@"), syllables(3, "latin", [domain, of, F.lit(key)]), F.lit(".example.com")))
        .when(of == "secret", secret(value, seed))
        .when(of == "ip", address(value, seed))
        .when(of == "phone", refilled(value, phone))
        .when(of == "ssn", refilled(value, permuted(digits, seed)))
        .when(of == "card", refilled(value, card(digits, seed)))
        .when(of == "iban", iban(value, seed))
        .when(of == "person", person(value, seed))
    )


def marked(text: Column) -> Column:
    """Whether a text can hold anything but persons."""
    return text.rlike(MARKS)


def found(text: Column) -> Column:
    """The entities of a text in order, as (value, kind, canonical)."""
    matches = F.when(marked(text), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.regexp_extract_all(text, F.lit(PATTERNS["person"]), F.lit(0)))
    typed = F.transform(matches, lambda m: F.struct(m.alias("value"), kind(m).alias("kind")))
    return F.transform(typed, lambda x: F.struct(x["value"].alias("value"), x["kind"].alias("kind"), canonical(x["value"], x["kind"]).alias("canonical")))


def crowded(entities: DataFrame) -> DataFrame:
    """The cells (kind, cell) of digit strings that hold over a tenth of all that such a string can be.

    A permutation of digits keeps the length and the first ones; a cell is what
    agrees in these.
    """
    n = F.length("canonical")
    moved = F.when(F.col("kind") == "phone", n - 1).when(F.col("kind") == "card", n - 2).otherwise(n)
    free = 2 * F.least(F.floor(moved / 2), F.lit(17))
    cells = in_cells(entities).groupBy("kind", "cell").agg(F.count("*").alias("n"), F.max(F.when(F.col("kind") == "ip", F.lit(2.0**32)).otherwise(F.pow(F.lit(10.0), free))).alias("size"))
    return cells.filter(F.col("kind").isin("phone", "ssn", "card", "ip") & (F.col("n") > F.col("size") / 10)).select("kind", "cell")


def in_cells(entities: DataFrame) -> DataFrame:
    n = F.length("canonical")
    digits = F.col("kind").isin("phone", "ssn", "card")
    kept = F.when(F.col("kind") == "phone", 1 + (n - 1) % 2).when(F.col("kind") == "card", 1 + n % 2).otherwise(n % 2)
    return entities.withColumn("cell", F.when(digits, F.concat_ws("-", n.cast("string"), F.substring("canonical", F.lit(1), kept))).otherwise(""))


def collisions(entities: DataFrame, key: str) -> DataFrame:
    """Entities (kind, canonical) that need another draw, with its number ``attempt``.

    entities: kind and canonical, each pair once.  Of the entities with one
    surrogate the least keeps it.  A surrogate that is a real value is drawn again,
    so that a round leaves a tenth of the entities at most, until none collides.
    In a cell of digit strings so crowded that other strings are scarce, the first
    draw stands: it is a permutation, which keeps all apart, though some surrogate
    can be another's real value.
    """
    dense = common.staged(crowded(entities), "crowded")
    drawn = in_cells(entities).join(dense, ["kind", "cell"], "left_anti").select("kind", "canonical", F.lit(0).alias("attempt"))
    while True:
        # within a function of one row, the long expression is not compiled, which would take much memory
        fresh = let(F.struct("canonical", "kind", "attempt"), lambda x: canonical(surrogate(x["canonical"], x["kind"], key, x["attempt"]), x["kind"]))
        named = common.staged(drawn.withColumn("surrogate", fresh), "surrogates")
        first = named.groupBy("kind", "surrogate").agg(F.min(F.struct("attempt", "canonical")).alias("keeps"), F.count("*").alias("n")).filter("n > 1").drop("n")
        real = entities.select("kind", F.col("canonical").alias("surrogate"), F.lit(True).alias("real"))
        again = named.join(first, ["kind", "surrogate"], "left").join(real, ["kind", "surrogate"], "left")
        collides = F.coalesce("real", F.lit(False)) | (F.col("keeps").isNotNull() & (F.col("keeps.canonical") != F.col("canonical")))
        flagged = again.select("kind", "canonical", (F.col("attempt") + collides.cast("int")).alias("attempt"), collides.alias("collides"))
        flagged = common.staged(flagged, "draws")
        if not flagged.filter("collides").limit(1).count():
            return flagged.filter("attempt > 0").select("kind", "canonical", "attempt")
        drawn = flagged.drop("collides")


def replace(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text with surrogates for its entities, as (doc_id, text, n_entities).

    A null text counts as empty; a null id stays null; one row comes out for each
    row, none for an empty table, and repeated rows get the same result; other
    columns are ignored, whatever their names; texts are treated whole, however
    long.  Persons are known again by their surname, numbers by their digits: a
    phone number with and without its country code is two entities.  The key decides
    all draws: keep it secret and use it again to treat more documents alike.
    """
    rows = common.documents(docs, id_col, text_col)
    each = rows.select(F.explode(found(F.col("text"))).alias("x")).select("x.kind", "x.canonical")
    since = len(common.paths())
    entities = common.staged(each.groupBy("kind", "canonical").count().drop("count"), "entities")
    redrawn = common.concluded(collisions(entities, key), "redrawn", since)
    if redrawn.limit(1).count():
        # only documents that hold such an entity are joined
        spread = rows.withColumn("copy", F.xxhash64("text"))
        held = spread.select("doc_id", "copy", F.explode(found(F.col("text"))).alias("x")).select("doc_id", "copy", "x.kind", "x.canonical").distinct().join(redrawn, ["kind", "canonical"])
        maps = held.groupBy("doc_id", "copy").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "kind", "canonical"), "attempt"))).alias("attempts"))
        maps = maps.select(F.col("doc_id").alias("held_id"), F.col("copy").alias("held_copy"), "attempts")
        rows = spread.join(maps, F.col("doc_id").eqNullSafe(F.col("held_id")) & (F.col("copy") == F.col("held_copy")), "left")
        attempt = lambda x: F.coalesce(F.try_element_at(F.col("attempts"), F.concat_ws("|", x["kind"], x["canonical"])), F.lit(0))
    else:
        attempt = lambda x: F.lit(0)
    rows = rows.withColumn("found", found(F.col("text"))).withColumn("between", F.when(F.size("found") > 0, F.when(marked(F.col("text")), F.split("text", PATTERN, -1)).otherwise(F.split("text", PATTERNS["person"], -1))))
    fresh = F.transform("found", lambda x, i: F.concat(F.get("between", i), surrogate(x["value"], x["kind"], key, attempt(x))))
    text = F.when(F.size("found") > 0, F.concat(F.array_join(fresh, ""), F.element_at("between", -1))).otherwise(F.col("text"))
    return rows.select("doc_id", text.alias("text"), F.size("found").cast("long").alias("n_entities"))
