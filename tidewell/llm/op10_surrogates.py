"""Surrogates for personal data: keyed, type-consistent replacements, from DataFrame expressions only.

Every entity found (mail and network addresses, phone, card, account and social-security numbers, keys, tokens,
passwords, titled names) gets a replacement drawn by an HMAC of its normal form, so one entity has one surrogate
in every document, however it is punctuated. Digits become digits, letters letters of the same script and case,
and the marks between them stay; an entity of marks only becomes letters. A person is a family name with a given
name; given names keep the gender that the titles of all mentions tell. A full name that stands behind a title somewhere in a text is found
everywhere in that text. A surrogate that another entity has too,
or that is an entity of the corpus itself, is drawn anew until all are distinct; where short ones run out they
grow longer.
"""

from __future__ import annotations

import hashlib
import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.frames import free_names, let
from tidewell.tables import materialize, table

# Titles that mark names, by gender of the given name that follows ("n": not told).
TITLES = {"m": ("Mr", "Herr", "Monsieur", "Señor", "Sir"), "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Señora", "Lady"), "n": ("Dr", "Prof")}
# Given names by gender.
GIVEN = {
    "m": ("Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Louis", "Martin", "Noel", "Oscar", "Paul"),
    "f": ("Anna", "Berta", "Clara", "Diana", "Emma", "Flora", "Greta", "Helen", "Irene", "Julia", "Klara", "Laura", "Maria", "Nora", "Olga", "Paula"),
    "n": ("Alex", "Chris", "Dominique", "Eden", "Francis", "Jamie", "Kim", "Lee", "Marion", "Noa", "Pat", "Quinn", "Robin", "Sam", "Toni", "Val"),
}
# Letters and digits that stand for each other, by script and case.
BASIC = (
    "0123456789",
    "abcdefghijklmnopqrstuvwxyz",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "абвгдежзийклмнопрстуфхцчшщъыьэюя",
    "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ",
    "αβγδεζηθικλμνξοπρστυφχψω",
    "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ",
)
# First and last code points of further letters: Latin with marks, Greek, Cyrillic, Armenian, Hebrew,
# Arabic, Devanagari, Bengali, Tamil, Thai, Georgian, Hiragana, Katakana, Han, Hangul.
BLOCKS = (
    (0xC0, 0x17F), (0x370, 0x3FF), (0x400, 0x52F), (0x531, 0x587), (0x5D0, 0x5EA), (0x620, 0x64A), (0x904, 0x939), (0x985, 0x9B9),
    (0xB85, 0xBB9), (0xE01, 0xE2E), (0x10D0, 0x10FA), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3),
)


def _blocks() -> list[str]:
    """The letters of each block that no basic alphabet has, capitals apart."""
    known, out = set("".join(BASIC)), []
    for first, last in BLOCKS:
        own = [c for c in map(chr, range(first, last + 1)) if unicodedata.category(c) in ("Ll", "Lu", "Lo") and c not in known]
        out += [part for part in ("".join(c for c in own if not c.isupper()), "".join(c for c in own if c.isupper())) if part]
    return out


ALPHABETS = (*BASIC, *_blocks())
SMALL = 1
HEX = ("0123456789abcdef",)
#: A block of more letters than this is told by its ends, and gives every n-th letter: a draw is one byte.
DRAWN = 256

_TITLE = "|".join(t for group in TITLES.values() for t in group)
_MAIL = r"[A-Za-z0-9._%+\-]"
#: Words in small letters that a name may have before one of its parts.
_PARTICLE = "van|von|vom|de|del|della|der|den|des|di|da|do|dos|du|la|le|ten|ter|zu|zum|zur|af|av|bin|ibn|al|el"
#: A part of a name: O'Brien, McDonald, Anna-Maria. A mark is within it only before a capital or after a single one.
_PART = r"\p{Lu}(?:['’]\p{L})?[\p{L}\p{M}]++(?:['’\-]\p{Lu}[\p{L}\p{M}]*+)*+"
#: Parts of a name, any number, each behind a space and perhaps initials and particles. Possessive loops need no stack.
_NAME = rf"(?: (?:(?:(?:\p{{Lu}}\.)++|{_PARTICLE}) )*+{_PART})++"
#: One title or several in a row; the last is not one if no name follows.
_TITLES = rf"(?:{_TITLE})\.?(?: (?:{_TITLE})\.?(?= (?:\p{{Lu}}|(?:{_PARTICLE}) )))*+"
#: What counts as an entity; of two that begin at one place, the first in this list.
PATTERNS = (
    # Tried only where such a run begins or a match has ended, so that a long run is read once.
    rf"(?:\G|(?<!{_MAIL})){_MAIL}++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)++",
    r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b",
    r"(?<=password=|passwd=|secret=|api_key=)[^\s\"'&;,]{4,}+",
    r"(?<=token = \"|token=\"|secret = \"|api_key = \")[^\"\s]{8,}+(?=\")",
    r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    r"\b[0-9]{4}(?:[ \-]?[0-9]{4}){2}[ \-]?[0-9]{1,7}\b",
    r"\b(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})){3}\b",
    r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b",
    r"\+[0-9]{1,3}(?:[ .\-]?\(?[0-9]{1,4}\)?){2,6}|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}|\b[0-9]{3}-[0-9]{3}-[0-9]{4}\b",
    rf"\b{_TITLES}{_NAME}",
)
ANY = "|".join(f"(?:{p})" for p in PATTERNS)
#: A text in which this is nowhere has no entity; the long pattern is then skipped.
HINT = rf"[@:=+]|[0-9][0-9 .()\-]{{6}}|AKIA|ASIA|\b(?:{_TITLE})\b|[A-Z]{{2}}[0-9]{{2}}"
#: Rows up to which a counted table is broadcast.
BROADCAST_ROWS = 200_000
#: After so many draws, and again after as many more, surrogates get a character more.
WIDEN = 8
#: The setting that holds the secret key, and the published one for tests that is used where it is unset.
KEY_SETTING, TEST_KEY = "spark.tidewell.pii.key", "not a secret"


def session_key(spark: SparkSession) -> str:
    return spark.conf.get(KEY_SETTING, None) or TEST_KEY


def kind_of(entity: Column) -> Column:
    """The type of an entity, from its form."""
    digits = F.length(F.regexp_replace(entity, "[^0-9]", ""))
    return (
        F.when(entity.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"), F.lit("email"))
        .when(entity.rlike(rf"^{_TITLES}{_NAME}"), F.lit("person"))
        .when(entity.rlike(r"^(AKIA|ASIA)[A-Z0-9]{16}$"), F.lit("aws"))
        .when(entity.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), F.lit("ssn"))
        .when(entity.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), F.lit("ip"))
        .when(entity.rlike(r"^([0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}$"), F.lit("ip6"))
        .when(entity.rlike(r"^[A-Z]{2}[0-9]{2}( ?[A-Z0-9]{1,4}){3,8}$"), F.lit("iban"))
        .when(entity.rlike(r"^[0-9][0-9 \-]+$") & digits.between(13, 19), F.lit("card"))
        .when(entity.rlike(r"^[+(0-9][0-9 .()\-]+$"), F.lit("phone"))
        .when(entity.rlike(rf"^{_PART}{_NAME}$"), F.lit("person"))
        .otherwise(F.lit("secret"))
    )


def unit_of(kind: Column, entity: Column) -> Column:
    """The normal form that tells entities apart: of a person the family name, of numbers what is not punctuation."""
    return (
        F.when(kind.isin("email", "ip6"), F.lower(entity))
        .when(kind == "person", F.substring_index(entity, " ", -1))
        .when(kind.isin("phone", "card", "ssn", "iban"), F.regexp_replace(entity, "[^0-9A-Za-z+]", ""))
        .otherwise(entity)
    )


def _title(entity: Column) -> Column:
    """The titles a name begins with, and the space after them."""
    return F.regexp_extract(entity, rf"^{_TITLES} ", 0)


def gender_of(entity: Column) -> Column:
    """The place in GIVEN of the gender that a name's title tells."""
    told = lambda g: _title(entity).rlike(rf"(?:^| )(?:{'|'.join(TITLES[g])})\.? ")
    return F.when(told("m"), F.lit(0)).when(told("f"), F.lit(1)).otherwise(F.lit(2))


def person_of(entity: Column) -> Column:
    """Family and given names of a titled name with both, as one unit of the kind "given"; null without given names."""
    name = F.substr(entity, F.length(_title(entity)) + 1, F.length(entity))
    family = F.substring_index(name, " ", -1)
    return F.when(name.contains(" "), F.concat(family, F.lit(" "), F.substr(name, F.lit(1), F.length(name) - F.length(family) - 1)))


def draw_given(key: str, unit: Column, attempt: Column) -> Column:
    """The given name of a person, whose gender is ``attempt`` modulo 3. Each third attempt adds a name, so they never run out."""
    pools = F.array(*(F.array(*map(F.lit, names)) for names in GIVEN.values()))
    pool = F.get(pools, (attempt % 3).cast("int"))
    one = lambda i: F.get(pool, _byte(_hash(key, unit, F.lit("g"), attempt, i), F.lit(0)) % F.size(pool))
    return F.array_join(F.transform(F.sequence(F.lit(0), F.floor(attempt / 3).cast("int")), one), "-")


def _hash(key: str, unit: Column, *parts: Column) -> Column:
    """HMAC-SHA-256 of the parts and the unit, in hexadecimal."""
    block = key.encode()
    block = (hashlib.sha256(block).digest() if len(block) > 64 else block).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ pad for b in block)) for pad in (0x36, 0x5C))
    said = F.concat_ws("|", *(p.cast("string") for p in parts), unit).cast("binary")
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, said), 256))), 256)


def _byte(bits: Column, i: Column) -> Column:
    return F.conv(F.substr(bits, i * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _disguise(key: str, value: Column, seed: Column, attempt: Column, alphabets: tuple[str, ...] = ALPHABETS) -> Column:
    """``value`` with each digit and letter replaced by a keyed one of its own alphabet; other characters stay.

    Letters of scripts that are not listed become small Latin ones; so does everything where there is no letter or digit.
    """
    stream = F.transform(F.sequence(F.lit(0), F.floor(F.length(value) / 32).cast("int")), lambda i: _hash(key, seed, attempt, i))
    given = F.array(*(F.lit(a[:: -(-len(a) // DRAWN)]) for a in alphabets))

    def known(c: Column) -> Column:
        out = F.when(F.lit(False), 0)
        for k, a in enumerate(alphabets):
            out = out.when(F.instr(F.lit(a), c) > 0 if len(a) <= DRAWN else (c >= a[0]) & (c <= a[-1]), F.lit(k))
        return out

    def one(use: Column):
        def swap(c: Column, i: Column) -> Column:
            which = F.coalesce(known(c), F.when(use["bare"] | c.rlike(r"[\p{L}\p{N}]"), F.lit(min(SMALL, len(alphabets) - 1))))
            own = F.get(given, which)
            drawn = F.substr(own, _byte(F.get(use["bits"], F.floor(i / 32).cast("int")), i % 32) % F.length(own) + 1, F.lit(1))
            return F.when((c == "") | which.isNull(), c).otherwise(drawn)

        return swap

    use = F.struct(stream.alias("bits"), (~value.rlike(r"[\p{L}\p{N}]")).alias("bare"))
    return let(use, lambda u: F.array_join(F.transform(F.split(value, ""), one(u)), ""))


def draw(key: str, kind: Column, unit: Column, attempt: Column) -> Column:
    """The surrogate of a normal form: of a person a family name, of "given" the unit with another given name; cards keep first digit and check, phones and accounts their country."""
    plain = _disguise(key, unit, unit, attempt)
    hexadecimal = _disguise(key, unit, unit, attempt, HEX)
    more = lambda c, alphabets: F.when(attempt >= WIDEN, _disguise(key, F.repeat(F.lit(c), F.floor(attempt / WIDEN).cast("int")), F.concat(unit, F.lit("+")), attempt, alphabets)).otherwise("")
    letters, digits, hexits = more("a", (BASIC[SMALL],)), more("0", (BASIC[0],)), more("0", HEX)

    def email(domain: Column) -> Column:
        top = F.concat(F.lit("."), F.substring_index(domain, ".", -1))
        host = F.substr(domain, F.lit(1), F.length(domain) - F.length(top))
        return F.concat(_disguise(key, F.substring_index(unit, "@", 1), unit, attempt), letters, F.lit("@"), _disguise(key, host, domain, F.lit(0)), top)

    def card(p: Column) -> Column:
        body = F.concat(F.substr(unit, F.lit(1), F.lit(1)), F.substr(p, F.lit(2), F.length(unit) - 2), digits)
        tails = F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.concat(body, d.cast("string"))), lambda t: F.call_function("luhn_check", t) == F.call_function("luhn_check", unit))
        return let(tails, lambda t: F.get(t, _byte(_hash(key, unit, attempt, F.lit("n")), F.lit(0)) % F.size(t)))

    octets = let(_hash(key, unit, attempt, F.lit("n")), lambda bits: F.concat_ws(".", *((_byte(bits, F.lit(k)) % 254 + 1).cast("string") for k in range(4))))
    country = F.regexp_extract(unit, r"^(\+1|\+[0-9]{2}|)", 1)
    apart = lambda mark, c: F.when(attempt >= WIDEN, F.concat(F.lit(mark), c)).otherwise("")
    return (
        F.when(kind == "email", let(F.substring_index(unit, "@", -1), email))
        .when(kind == "given", F.concat_ws(" ", F.substring_index(unit, " ", 1), draw_given(key, unit, attempt)))
        .when(kind == "ip", F.concat(octets, apart(".", digits)))
        .when(kind == "card", let(plain, card))
        .when(kind == "ip6", F.concat(hexadecimal, apart(":", hexits)))
        .when(kind == "aws", F.concat(let(plain, lambda p: F.concat(F.substr(unit, F.lit(1), F.lit(4)), F.substr(p, F.lit(5), F.lit(16)))), digits))
        .when(kind == "iban", F.concat(let(plain, lambda p: F.concat(F.substr(unit, F.lit(1), F.lit(2)), F.substr(p, F.lit(3), F.length(unit)))), digits))
        .when(kind == "phone", F.concat(let(plain, lambda p: F.concat(country, F.substr(p, F.length(country) + 1, F.length(unit)))), digits))
        .when(kind == "ssn", F.concat(plain, digits))
        .when((kind == "secret") & unit.rlike("^[0-9a-f]+$"), F.concat(hexadecimal, hexits))
        .otherwise(F.concat(plain, letters))
    )


def render(kind: Column, entity: Column, drawn: Column, given: Column) -> Column:
    """``drawn`` in the punctuation and case of the mention; of a person, with title and ``given`` unless that is null."""
    number = kind.isin("phone", "card", "ssn", "iban")
    figures = lambda c: F.length(F.regexp_replace(c, "[^0-9A-Za-z+]", ""))

    def lay(c: Column, i: Column) -> Column:
        own = F.substr(drawn, figures(F.substr(entity, F.lit(1), i + 1)), F.lit(1))
        return F.when(~c.rlike("[0-9A-Za-z+]"), c).otherwise(own)

    raise_case = lambda c, own: F.when(c.rlike("[A-Z]"), F.upper(own)).otherwise(own)
    spelled = lambda how: F.array_join(F.transform(F.split(entity, ""), how), "")
    return (
        F.when(kind == "person", F.concat(_title(entity), F.concat_ws(" ", given, drawn)))
        .when(number, F.concat(spelled(lay), F.substr(drawn, figures(entity) + 1, F.length(drawn))))
        .when(kind.isin("email", "ip6") & (entity != F.lower(entity)), F.array_join(F.zip_with(F.split(entity, ""), F.split(drawn, ""), raise_case), ""))
        .otherwise(drawn)
    )


def _entities(text: str) -> Column:
    """``all`` entities of a text in order, and the pattern ``by`` which they are found; a null text has none.

    Full names that are told by a title are looked for without one too, in a second pass over texts that have any.
    """

    def again(found: Column) -> Column:
        told = F.transform(found, lambda e: F.when(e.rlike(rf"^{_TITLES}{_NAME}"), F.substr(e, F.length(_title(e)) + 1, F.length(e))))
        names = F.array_distinct(F.filter(told, lambda n: n.contains(" ")))
        return let(names, lambda n: F.struct(F.when(F.size(n) > 0, F.regexp_extract_all(F.col(text), pattern(n), F.lit(0))).otherwise(found).alias("all"), pattern(n).alias("by")))

    def pattern(names: Column) -> Column:
        quoted = F.array_join(F.transform(names, lambda n: F.concat(F.lit("\\Q"), n, F.lit("\\E"))), "|")
        return F.when(F.size(names) > 0, F.concat(F.lit(rf"{ANY}|(?<![\p{{L}}\p{{N}}])(?:"), quoted, F.lit(r")(?![\p{L}\p{N}])"))).otherwise(F.lit(ANY))

    none = F.struct(F.array().cast("array<string>").alias("all"), F.lit(ANY).alias("by"))
    return F.when(F.col(text).rlike(HINT), let(F.regexp_extract_all(F.col(text), F.lit(ANY), F.lit(0)), again)).otherwise(none)


def attempts(units: DataFrame, key: str) -> DataFrame:
    """(kind, unit, attempt, drawn) of distinct units, with all ``drawn`` of a kind distinct and none a unit itself.

    Of units that draw alike the one that drew first keeps it, and of those of one round the least. The first round is
    an aggregation over all units; later ones take only units that lost, which shrink quickly, so the others are not
    shuffled again. It always ends, as draws grow longer. ``units`` may have the first attempt of each, and other
    columns, which stay.
    """
    again = lambda df: df.withColumn("drawn", draw(key, F.col("kind"), F.col("unit"), F.col("attempt")))
    trying = materialize(again(units if "attempt" in units.columns else units.withColumn("attempt", F.lit(0))))
    real = trying.select("kind", F.col("unit").alias("drawn"))
    settled: list[DataFrame] = []
    while True:
        first = trying.groupBy("kind", "drawn").agg(F.min("unit").alias("unit"))
        wanted = _small(materialize(first.select("kind", "drawn"))) if settled else first.select("kind", "drawn")
        taken = real.join(wanted, ["kind", "drawn"], "left_semi")
        for done in settled:
            taken = taken.unionByName(done.select("kind", "drawn").join(wanted, ["kind", "drawn"], "left_semi"))
        won = materialize(first.join(taken.distinct(), ["kind", "drawn"], "left_anti").select("kind", "unit"))
        lost = trying.join(won, ["kind", "unit"], "left_anti")
        lost = materialize(again(lost.withColumn("attempt", F.col("attempt") + F.when(F.col("kind") == "given", 3).otherwise(1)).drop("drawn")))
        if lost.isEmpty():
            settled.append(trying)
            break
        settled.append(trying.join(won, ["kind", "unit"], "left_semi"))
        trying = lost
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return out


def replace_entities(docs: DataFrame, key: str, text: str = "text", found: str = "_found") -> DataFrame:
    """``docs`` with surrogates in ``text`` and, added as ``found``, the kinds of what was replaced in order.

    Equal keys give equal surrogates in the same corpus. A null text stays null, an empty or repeated one is treated like
    others, an empty table stays empty. A column of the name ``found`` is replaced. A text is rewritten where it stands: it is never shuffled unless one of its entities needed a second
    draw and such documents are too many to broadcast.
    """
    seen = docs.select(F.explode(_units(text)).alias("u")).select("u.kind", "u.unit", "u.attempt").groupBy("kind", "unit")
    seen = seen.agg(F.bool_or(F.col("attempt") == 0).alias("m"), F.bool_or(F.col("attempt") == 1).alias("f"), (F.min("attempt") < F.max("attempt")).alias("mixed"))
    # A person whose titles tell no gender, or both, has a given name of either.
    settled = F.when(F.col("m") & F.col("f"), 2).when(F.col("m"), 0).when(F.col("f"), 1).otherwise(2)
    done = attempts(seen.select("kind", "unit", settled.alias("attempt"), "mixed"), key)
    odd = materialize(done.where((F.col("attempt") >= F.when(F.col("kind") == "given", 3).otherwise(1)) | F.col("mixed")).select("kind", "unit", "attempt"))
    k1, k2, other, finished = free_names(docs, "__k1", "__k2", "__again", "__done")
    work, again = docs, F.lit(None).cast("map<string,int>")
    if not odd.isEmpty():
        keys = {k1: F.xxhash64(text), k2: F.xxhash64(F.lit(3), F.col(text))}
        keyed = docs.select(F.col(text)).withColumns(keys).select(k1, k2, F.explode(_units(text)).alias("u")).select(k1, k2, "u.kind", "u.unit").distinct()
        hit = keyed.join(_small(odd), ["kind", "unit"]).groupBy(k1, k2)
        hit = _small(materialize(hit.agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws(":", "kind", "unit"), F.col("attempt")))).alias(other))))
        work, again = docs.withColumns(keys).join(hit, [k1, k2], "left").drop(k1, k2), F.col(other)

    def mention(e: Column) -> Column:
        def known(kind: Column) -> Column:
            def of(unit: Column) -> Column:
                attempt = F.coalesce(again[F.concat_ws(":", kind, unit)], F.lit(0))
                given = F.when(kind == "person", let(person_of(e), lambda p: F.when(p.isNotNull(), draw_given(key, p, F.coalesce(again[F.concat_ws(":", F.lit("given"), p)], gender_of(e))))))
                new = let(draw(key, kind, unit, attempt), lambda drawn: render(kind, e, drawn, given))
                return F.struct(kind.alias("kind"), new.alias("new"))

            return let(unit_of(kind, e), of)

        return let(kind_of(e), known)

    def rewrite(all_: Column, by: Column) -> Column:
        # Pieces between the matches, with a surrogate after each but the last.
        filled = F.zip_with(F.split(F.col(text), by, F.lit(-1)), all_, lambda p, s: F.concat(p, F.coalesce(s["new"], F.lit(""))))
        return F.struct(F.when(F.size(all_) > 0, F.array_join(filled, "")).otherwise(F.col(text)).alias("text"), F.transform(all_, lambda f: f["kind"]).alias("kinds"))

    work = work.withColumn(finished, let(_entities(text), lambda found: let(F.transform(found["all"], mention), lambda own: rewrite(own, found["by"]))))
    order = [F.col(f"{finished}.text").alias(c) if c == text else F.col(c) for c in docs.columns if c != found]
    return work.select(*order, F.col(f"{finished}.kinds").alias(found))


def _units(text: str) -> Column:
    """The distinct (kind, unit, first attempt) of a text; a name with given names is two, of the kinds person and given."""

    def of(e: Column) -> Column:
        own = lambda k: F.struct(k.alias("kind"), unit_of(k, e).alias("unit"), F.lit(0).alias("attempt"))
        both = lambda k: F.array(own(k), F.when(k == "person", F.struct(F.lit("given").alias("kind"), person_of(e).alias("unit"), gender_of(e).alias("attempt"))))
        return let(kind_of(e), both)

    return F.array_distinct(F.filter(F.flatten(F.transform(_entities(text)["all"], of)), lambda u: u["unit"].isNotNull()))


def _small(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if it has proved small."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def op10_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced: doc_id, text, n_replaced and the kinds in order. Null texts stay null."""
    done = replace_entities(table(spark, sf_dir, "documents").select("doc_id", "text"), session_key(spark))
    return done.select("doc_id", "text", F.size("_found").cast("long").alias("n_replaced"), F.array_join("_found", ",").alias("kinds"))
