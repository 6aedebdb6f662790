"""Personal data replaced by keyed surrogates, with built-in functions only.

Entities are found by patterns; every distinct one gets a surrogate of its own kind from a keyed hash. A collision
check over the whole corpus gives two entities never the same surrogate, and none that is an entity itself.
One entity has one surrogate everywhere, whatever its spelling; case, separators, script and gender stay.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from obsframe.llm import common
from obsframe.session import cut_lineage

KEY = "surrogates"
TRIES = 64

# Titles by gender and script, given names, syllables of family names.
TITLES = {("m", "Latin"): ["Mr", "Sir", "Herr", "Monsieur", "Señor", "Sr"],
          ("f", "Latin"): ["Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Señora", "Sra"],
          ("n", "Latin"): ["Dr", "Prof"],
          ("m", "Cyrillic"): ["Господин", "г-н"], ("f", "Cyrillic"): ["Госпожа", "г-жа"]}
GIVEN = {("m", "Latin"): ["James", "John", "Robert", "Michael", "William", "David", "Thomas", "Pierre", "Jean", "Carlos",
                          "José", "Juan", "Hans", "Peter", "Paul", "Daniel"],
         ("f", "Latin"): ["Mary", "Anna", "Linda", "Sarah", "Laura", "Julia", "Emma", "Marie", "Sophie", "María",
                          "Carmen", "Elena", "Heidi", "Claire", "Lucy", "Alice"],
         ("m", "Cyrillic"): ["Иван", "Пётр", "Сергей", "Алексей", "Дмитрий", "Николай", "Павел", "Олег"],
         ("f", "Cyrillic"): ["Анна", "Мария", "Ольга", "Елена", "Ирина", "Наталья", "Светлана", "Вера"]}
SYLLABLES = {"Latin": ["bar", "ben", "bro", "cal", "dan", "del", "dor", "fal", "fen", "gar", "hol", "kel", "lan", "lor", "mar",
                       "mel", "mor", "nel", "nor", "pel", "ral", "ren", "sal", "sen", "tal", "tor", "val", "ven", "wal", "wen",
                       "yor", "zan"],
             "Cyrillic": ["бар", "вел", "гор", "дан", "зел", "кал", "лам", "мар", "нев", "пол", "рад", "сал", "тор", "вор",
                          "лен", "сев"]}
NEUTRAL = "n"


def any_of(names: list[str]) -> str:
    return "(?:" + "|".join(sorted(names, key=lambda n: (-len(n), n))) + ")"


NAME = r"\p{Lu}[\p{L}'-]+"
TITLE = any_of([t for names in TITLES.values() for t in names])
GROUP = "[0-9A-Fa-f]{1,4}"
# Prefixes of common keys, which stay.
PREFIX = r"(?:AKIA|ASIA|(?:sk|pk|rk)[-_](?:live_|test_|proj-)?|gh[pousr]_|github_pat_|glpat-|xox[abprs]-|AIza|eyJ)"
# Numbers of 13 to 19 digits but 16, whole or in groups as on cards; only those with a valid check sum are entities.
NUMBER = (r"\b(?:[0-9]{4}(?:[ -][0-9]{4}){3}[ -][0-9]{1,3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5}|[0-9]{4}(?:[ -][0-9]{3}){3}"
          r"|[0-9]{17,19}|[0-9]{13,15})\b")
# What is looked for, in order of precedence. Each pattern must match the whole entity.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "ipv6": (rf"(?<![0-9A-Za-z:.])(?!::1(?![0-9A-Fa-f:]))(?=[A-Fa-f:]*[0-9])(?:(?:{GROUP}:){{7}}{GROUP}"
             rf"|(?:{GROUP}(?::{GROUP}){{0,5}})?::(?:{GROUP}(?::{GROUP}){{0,5}})?)(?![0-9A-Za-z:])"),
    "key": (r"\b(?:(?:AKIA|ASIA)[0-9A-Z]{16}\b|(?:sk|pk|rk)[-_](?:live_|test_|proj-)?(?=[A-Za-z_-]*[0-9])[A-Za-z0-9_-]{16,}"
            r"|gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,}|glpat-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}"
            r"|AIza[0-9A-Za-z_-]{35}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})"
            r"|(?<![A-Za-z0-9+/=._-])(?=[A-Za-z+/]*[0-9])(?=[a-z0-9+/]*[A-Z])(?=[A-Z0-9+/]*[a-z])[A-Za-z0-9+][A-Za-z0-9+/]{39,}={0,2}"),
    "phone": (r"\+[0-9][0-9 ()-]{7,}[0-9]"
              r"|(?<![0-9A-Za-z.+-])(?:1[ .-])?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9]|[.-][0-9])"
              r"|(?<![0-9A-Za-z.+-])(?![0-9]{2}[ /-][0-9]{2}[ /-][0-9]{4}(?![0-9]))(?=(?:[ ()/-]{0,2}[0-9]){9})"
              r"(?:\(0[0-9]{1,4}\) ?|0[0-9]{1,4}[ /-])[0-9]{2,8}(?:[ -][0-9]{2,8}){0,4}(?![0-9]|[.-][0-9])"),
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "secret": r"\b(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})\b",
    "number": NUMBER,
    "card": r"\b[0-9]{4}(?:[ -]?[0-9]{4}){3}\b",
    "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    "name": rf"\b{TITLE}\.? {NAME}(?: {NAME})?|\b{any_of([n for names in GIVEN.values() for n in names])} {NAME}",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
# Every entity holds a digit or an @, or is a name or a prefixed key; most texts are done with after this.
HINT = rf"[0-9@]|{PREFIX}|{TITLE}\.? \p{{Lu}}|\b{any_of([n for names in GIVEN.values() for n in names])} \p{{Lu}}"


def entities(text: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.when(F.coalesce(F.rlike(text, F.lit(HINT)), F.lit(False)), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(none)


def kind_of(entity: Column) -> Column:
    """The kind of an entity; null for a number that is no card."""
    found = reduce(lambda c, kv: c.when(F.rlike(entity, F.lit(f"^(?:{kv[1]})$")), F.lit(kv[0])), list(PATTERNS.items())[1:],
                   F.when(F.rlike(entity, F.lit(f"^(?:{PATTERNS['email']})$")), F.lit("email")))
    return common.let(found.otherwise("name"), lambda k: F.when(k != "number", k).when(is_card(entity), F.lit("card")))


def is_card(number: Column) -> Column:
    return luhn(F.regexp_replace(number, "[^0-9]", "")) == 0


def full_address(text: Column) -> Column:
    """Eight groups of four digits for any spelling of an IPv6 address."""
    groups = lambda t: F.filter(F.split(F.coalesce(t, F.lit("")), ":"), lambda g: g != "")
    sides = common.let(F.split(F.lower(text), "::"), lambda p: F.struct(
        groups(common.nth(p, F.lit(0))).alias("a"), groups(common.nth(p, F.lit(1))).alias("b")))
    return common.let(sides, lambda p: F.array_join(F.transform(F.concat(
        p["a"], F.array_repeat(F.lit("0"), 8 - F.size(p["a"]) - F.size(p["b"])), p["b"]), lambda g: F.lpad(g, 4, "0")), ":"))


def untitled(entity: Column) -> Column:
    return F.regexp_replace(entity, rf"^{TITLE}\.? ", "")


def canonical(kind: Column, entity: Column) -> Column:
    """What two spellings of one entity have in common. A title is no part of a name."""
    return (F.when(kind.isin("phone", "card", "ssn"), F.regexp_replace(entity, "[^0-9]", ""))
            .when(kind == "iban", F.replace(entity, F.lit(" "), F.lit("")))
            .when(kind == "ipv6", full_address(entity)).when(kind == "key", entity)
            .when(kind == "name", F.lower(untitled(entity))).otherwise(F.lower(entity)))


def script_of(text: Column) -> Column:
    return F.when(F.rlike(text, F.lit(r"\p{IsCyrillic}")), "Cyrillic").otherwise("Latin")


def gender_of(entity: Column) -> Column:
    """m or f by title, else by given name; n where neither tells."""
    def starts(names: list[str], end: str) -> Column:
        return F.rlike(entity, F.lit(rf"^{any_of(names)}{end}"))
    rules = [(g, starts(n, r"\.? ")) for (g, _), n in TITLES.items() if g != NEUTRAL]
    rules += [(g, F.rlike(entity, F.lit(rf"^(?:{TITLE}\.? )?{any_of(n)} "))) for (g, _), n in GIVEN.items()]
    return reduce(lambda c, r: c.when(r[1], F.lit(r[0])), rules[1:], F.when(rules[0][1], F.lit(rules[0][0]))).otherwise(NEUTRAL)


def byte_at(stream: Column, i: Column | int) -> Column:
    at = F.lit(i) if isinstance(i, int) else i
    return F.conv(F.substring(stream, F.pmod(at, F.lit(64)) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def pick(values: Column | list[str], n: Column) -> Column:
    array = F.array(*map(F.lit, values)) if isinstance(values, list) else values
    return F.get(array, F.pmod(n, F.size(array)))


def chars(text: Column) -> Column:
    return F.split(text, "")


def spelled(kind: Column, plain: Column, stream: Column) -> Column:
    """Character by character: digits to digits, letters to letters, hexadecimal for secrets; marks stay.

    Kept as they are: the first digit of cards and phones, the country of an IBAN, the last label of a domain, the
    prefix of a key.
    """
    digit = lambda b: F.pmod(b, F.lit(10)).cast("string")
    letter = lambda b: F.char(F.pmod(b, F.lit(26)) + 97)
    prefix = F.length(F.regexp_extract(plain, rf"^{PREFIX}", 0))
    last = F.length(plain) - F.length(F.substring_index(plain, ".", -1))
    return F.array_join(F.transform(chars(plain), lambda c, i: common.let(byte_at(stream, i), lambda b: F.when(
        kind.isin("card", "phone") & (i == 0), c).when((kind == "iban") & (i < 2), c)
        .when((kind == "email") & (i >= last), c).when((kind == "key") & (i < prefix), c)
        .when(kind == "secret", F.lower(F.hex(F.pmod(b, F.lit(16)))))
        .when(c.between("0", "9"), digit(b)).when(c.between("a", "z"), letter(b))
        .when(c.between("A", "Z"), F.upper(letter(b))).otherwise(c))), "")


def luhn(digits: Column) -> Column:
    """The check sum of a card number; valid ones give 0."""
    n = F.length(digits)
    return F.pmod(F.aggregate(F.transform(chars(digits), lambda c, i: common.let(c.cast("int"), lambda d: F.when(
        F.pmod(n - i, F.lit(2)) == 0, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d))),
        F.lit(0), lambda a, b: a + b), F.lit(10))


def card(plain: Column, made: Column) -> Column:
    """A valid number gets a valid one: the last digit makes up the sum."""
    front = F.left(made, F.length(made) - 1)
    fixed = F.concat(front, F.pmod(10 - luhn(F.concat(front, F.lit("0"))), F.lit(10)).cast("string"))
    return F.when(luhn(plain) == 0, fixed).otherwise(made)


def address(plain: Column, stream: Column) -> Column:
    """Another public address, or another one of the same private network."""
    def octet(i: int) -> Column:
        return F.pmod(byte_at(stream, i) * 256 + byte_at(stream, i + 8), F.lit(256)).cast("string")
    first = F.concat((F.pmod(byte_at(stream, 20), F.lit(99)) + 11).cast("string"))
    return (F.when(F.rlike(plain, F.lit(r"^192\.168\.")), F.concat_ws(".", F.lit("192.168"), octet(2), octet(3)))
            .when(F.rlike(plain, F.lit(r"^(10|127)\.")), F.concat_ws(".", F.substring_index(plain, ".", 1), octet(1), octet(2), octet(3)))
            .otherwise(F.concat_ws(".", first, octet(1), octet(2), octet(3))))


def person(plain: Column, gender: Column, stream: Column, attempt: Column) -> Column:
    """As many words as the name has: a given name of its gender and script before a family name of syllables."""
    def family(script: str) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.least(attempt + 2, F.lit(40))), lambda i: pick(SYLLABLES[script], byte_at(stream, i + 10)))
        return F.initcap(F.array_join(parts, ""))

    def given(script: str) -> Column:
        n = byte_at(stream, 1) * 256 + byte_at(stream, 2)
        both = GIVEN["m", script] + GIVEN["f", script]
        return F.when(gender == "m", pick(GIVEN["m", script], n)).when(gender == "f", pick(GIVEN["f", script], n)).otherwise(pick(both, n))

    def whole(script: str) -> Column:
        return F.when(F.contains(plain, F.lit(" ")), F.concat_ws(" ", given(script), family(script))).otherwise(family(script))
    return F.when(script_of(plain) == "Cyrillic", whole("Cyrillic")).otherwise(whole("Latin"))


def surrogate(kind: Column, plain: Column, gender: Column, attempt: Column, key: str) -> Column:
    stream = F.sha2(F.concat_ws("\u0001", F.lit(key), kind, plain, attempt.cast("string")), 512)
    made = common.let(stream, lambda s: F.when(kind == "name", F.lower(person(plain, gender, s, attempt)))
                      .when(kind == "ip", address(plain, s))
                      .when(kind == "ipv6", F.concat_ws(":", F.lit("2001"), *(F.substring(s, 4 * i + 1, 4) for i in range(7))))
                      .otherwise(spelled(kind, plain, s)))
    return common.let(made, lambda m: F.when(kind == "card", card(plain, m)).otherwise(m))


def assign(known: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, plain, made) for distinct (kind, plain, gender): different entities of a kind get different surrogates,
    and none of them is an entity of that kind itself.

    Each round hashes the open entities anew; of those that meet, the smallest keeps its surrogate. The rounds end
    when none is open; 64 without an end mean that a kind has too few possible values, and raise an error.
    """
    open_ = cut_lineage(known)
    real = open_.select("kind", F.col("plain").alias("made"))
    done = None
    for attempt in range(TRIES):
        tried = open_.withColumn("made", surrogate(F.col("kind"), F.col("plain"), F.col("gender"), F.lit(attempt), key))
        winners = (tried.groupBy("kind", "made").agg(F.min("plain").alias("plain"))
                   .join(real, ["kind", "made"], "left_anti"))
        if done is not None:
            winners = winners.join(done.select("kind", "made"), ["kind", "made"], "left_anti")
        won = cut_lineage(winners.select("kind", "plain", "made"))
        done = won if done is None else done.union(won)
        open_ = cut_lineage(open_.join(won.select("kind", "plain"), ["kind", "plain"], "left_anti"))
        if open_.isEmpty():
            return done
    raise ValueError("too few surrogates for the entities of a kind")


def rendered(kind: Column, entity: Column, made: Column) -> Column:
    """The surrogate in the spelling of this mention: title, separators and case as they were."""
    def walk(taken: Column) -> Column:
        start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
        return F.aggregate(chars(entity), start, lambda a, c: common.let(taken_char(c, taken), lambda t: F.struct(
            F.concat(a["out"], F.when(t, common.let(F.substring(made, a["at"] + 1, F.lit(1)), lambda m: F.when(
                c.between("A", "Z"), F.upper(m)).otherwise(m))).otherwise(c)).alias("out"),
            (a["at"] + t.cast("int")).alias("at"))), lambda a: a["out"])

    def taken_char(c: Column, pattern: Column) -> Column:
        return (F.when(pattern == "digits", c.between("0", "9")).when(pattern == "spaced", c != " ").otherwise(F.lit(True)))

    how = F.when(kind.isin("phone", "card", "ssn"), "digits").when(kind == "iban", "spaced").otherwise("all")
    title = F.left(entity, F.length(entity) - F.length(untitled(entity)))
    bare = untitled(entity)
    name = F.concat(title, F.when(F.upper(bare) == bare, F.upper(made)).otherwise(F.initcap(made)))
    return (F.when(kind == "name", name).when(kind.isin("ip", "ipv6"), made)
            .when(kind == "secret", F.when(F.upper(entity) == entity, F.upper(made)).otherwise(made)).otherwise(walk(how)))


def replace_entities(docs: DataFrame, text: str = "text", key: str = KEY, out: str | None = None) -> DataFrame:
    """`docs` with every entity in `text` replaced, and `n_entities`.

    Null texts stay null, texts without entities as they are; these never leave their partition. Others meet the
    surrogates of their entities by a hash of the text, so ids may be null or repeated, and equal texts get equal
    results. One entity in a third of all texts is one row of the surrogate table; the join to it can be split.
    """
    name = out or text
    # The patterns are the dear part: texts are written with what was found, and read again by each step.
    found = cut_lineage(docs.withColumn("_found", entities(F.col(text))))
    own = docs.columns
    clean = found.filter(F.size("_found") == 0).withColumn("n_entities", F.lit(0)).withColumn(name, F.col(text)).drop("_found")
    hit = found.filter(F.size("_found") > 0).withColumn("_row", F.xxhash64(text, F.length(text)))
    mentions = cut_lineage(hit.select("_row", F.explode(F.array_distinct("_found")).alias("entity")).distinct())
    kind = kind_of(F.col("entity"))
    spellings = cut_lineage(mentions.select("entity").distinct().withColumn("kind", kind)
                            .withColumn("plain", canonical(F.col("kind"), F.col("entity")))
                            .withColumn("gender", F.when(F.col("kind") == "name", gender_of(F.col("entity"))).otherwise(NEUTRAL)))
    known = spellings.filter("kind IS NOT NULL").groupBy("kind", "plain").agg(F.min("gender").alias("gender"))
    table = (spellings.filter("kind IS NOT NULL").drop("gender").join(assign(known, key), ["kind", "plain"])
             .select("entity", rendered(F.col("kind"), F.col("entity"), F.col("made")).alias("made"))
             .unionByName(spellings.filter("kind IS NULL").select("entity", F.col("entity").alias("made"))))
    of_row = (mentions.join(table, "entity").groupBy("_row")
              .agg(F.map_from_entries(F.collect_list(F.struct("entity", "made"))).alias("_map")))
    between = F.split(text, ANY, -1)
    new = F.transform(F.col("_found"), lambda e: F.element_at(F.col("_map"), e))
    whole = F.array_join(F.zip_with(between, new, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    joined = hit.join(of_row, "_row").withColumn("n_entities", F.size(F.filter(
        "_found", lambda e: ~F.rlike(e, F.lit(f"^{NUMBER}$")) | is_card(e)))).withColumn(name, whole)
    columns = own if name in own else [*own, name]
    return joined.select(*columns, "n_entities").unionByName(clean.select(*columns, "n_entities"))


def op2_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return replace_entities(docs)
