"""Replacing personal data by surrogates (DataFrame operations only).

Detected entities - e-mail addresses, phone numbers, IPv4 addresses, payment
cards, social security numbers, access keys, hexadecimal secrets, values behind
password= / token= in any case, and names behind a form of address - are replaced by
keyed values of the same type and format.  Phone numbers are North American or
international (+, 8 to 15 digits), cards have 13 to 19 digits; unbroken ones
of other than 16 digits count only with a valid check digit.  Digits become digits, letters
letters of the same case and script, cards keep their first digit and get a
valid check digit, octets stay in 1..254, an e-mail's domain has one surrogate
everywhere, names get the same gender (from the form of address) and script.

The same entity gets the same surrogate in all documents (coreference).
Distinct entities get distinct surrogates: surrogates are checked against each
other and against all originals, and those that collide are derived anew with
the next attempt number until none collides.  Invented names get one syllable
more with each attempt, so that there are enough for any number of names.

Scale: texts are scanned by expressions only; the distinct entities are a
grouped table (copies are summed map-side), checked by grouped minima and
anti-joins.  Surrogates go back to the documents through one small map per
document that has any.

Edge cases: null texts stay null; texts without entities stay as they are;
rows with a null id are left out; rows that repeat an id are each rewritten;
an empty table gives no rows; other columns are kept by ``protect`` and
ignored by ``surrogate_table``.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, unused_name

#: Attempts after which the check raises instead of leaving a collision.
MAX_ATTEMPTS = 50

# Forms of address by gender.
MALE = ("Mr", "Mister", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Господин")
FEMALE = ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа")

# Syllables of invented names, by script.
LATIN_SYLLABLES = ("ba", "den", "dor", "fel", "gar", "hol", "jen", "kar", "lan", "mer", "nor", "pel", "ros", "sel", "tam", "ver")
CYRILLIC_SYLLABLES = ("ба", "вел", "гор", "дар", "жен", "зор", "кал", "лен", "мир", "ник", "пол", "рад", "сав", "тим", "фед", "яр")
#: Endings by gender and script.
ENDINGS = {("male", "latin"): "o", ("female", "latin"): "a", ("male", "cyrillic"): "ов", ("female", "cyrillic"): "ова"}


def _address(words: tuple[str, ...]) -> str:
    return rf"(?<!\p{{L}})(?:{'|'.join(sorted(words, key=len, reverse=True))})\.? \p{{Lu}}\p{{Ll}}+(?: \p{{Lu}}\p{{Ll}}+)?(?!\p{{L}})"


_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
#: type -> pattern, in order of precedence.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}",
    "access_key": r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])",
    "secret": r"(?<=(?i:password|passwd|token|secret|api_key)(?: ?[=:] ?)[\"']?)[A-Za-z0-9+/_\-]{8,}",
    "hex_secret": r"(?<![A-Za-z0-9])(?=[0-9a-f]*[a-f])(?=[0-9a-f]*[0-9])[0-9a-f]{32,64}(?![A-Za-z0-9])",
    "ip": rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\d|\.\d)",
    "phone": r"(?<![\w+])(?:(?:\+\d{1,3}[ .\-]?)?(?:\(\d{3}\) ?|\d{3}[ .\-])\d{3}[ .\-]\d{4}|\+\d(?:[ .\-/()]{0,3}\d){7,14})(?!\w)",
    "card": r"(?<!\w)(?:\d{4}[ \-]?\d{4}(?:[ \-]?\d{4}){2}(?:[ \-]\d{1,3})?|\d{4}[ \-]\d{6}[ \-]\d{4,5}|\d{4}(?:[ \-]\d{3}){3}|\d{13,19})(?!\w)",
    "ssn": r"(?<!\w)\d{3}-\d{2}-\d{4}(?!\w)",
    "male": _address(MALE),
    "female": _address(FEMALE),
}
_UNBROKEN = r"^(?:\d{13,15}|\d{17,19})$"
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Words one of which stands in every text that holds an entity without a digit or @.
CLUES = (*MALE, *FEMALE)
#: The same, in any case.
SECRET_CLUES = ("password", "passwd", "token", "secret", "api_key")


def entities(text: Column) -> Column:
    """All entities of a text in order."""
    maybe = reduce(or_, (text.contains(w) for w in CLUES), text.rlike("[0-9@]"))
    maybe = reduce(or_, (F.lower(text).contains(w) for w in SECRET_CLUES), maybe)
    found = F.regexp_extract_all(text, F.lit(ANY), F.lit(0))
    # a number without spaces that only its check digit could make a card
    loose = F.exists(found, lambda e: e.rlike(_UNBROKEN))
    secrets = F.regexp_extract_all(text, F.lit(PATTERNS["secret"]), F.lit(0))
    cards = F.filter(found, lambda e: ~e.rlike(_UNBROKEN) | (_check_digit(F.substring(e, F.lit(1), F.length(e) - 1)) == F.substring(e, -1, 1))
                     | F.array_contains(secrets, e))
    return F.when(maybe, F.when(loose, cards).otherwise(found)).otherwise(F.array().cast("array<string>"))


def entity_type(value: Column) -> Column:
    """Type of a detected value, by the first pattern that covers it."""
    out = F.lit("secret")
    for name, p in reversed(list(PATTERNS.items())):
        if name != "secret":
            out = F.when(value.rlike(f"^(?:{p})$"), F.lit(name)).otherwise(out)
    return out


def _number(hex_digits: Column, at: Column) -> Column:
    """A number below 2^16 from four digits of a digest, at a position."""
    return F.conv(F.substring(hex_digits, at % 29 * 2 + 1, F.lit(4)), 16, 10).cast("long")


def _from(alphabet: str, n: Column) -> Column:
    return F.substring(F.lit(alphabet), (n % len(alphabet) + 1).cast("int"), F.lit(1))


_DIGITS, _NONZERO = "0123456789", "123456789"
_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_HEX = "0123456789abcdef"


def _digest(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("\u0001", F.lit(key), *parts), 256)


def _letterwise(value: Column, digest: Column, digits: str = _DIGITS, lower: str = _LOWER, upper: str = _UPPER) -> Column:
    """Every digit and ASCII letter replaced by one of its kind."""

    def one(c: Column, i: Column) -> Column:
        # longer values than the digest go on with a digest of their own per stretch
        n = _number(F.sha2(F.concat(digest, F.floor(i / 29).cast("string")), 256), i)
        return (F.when(c.rlike("[0-9]"), _from(digits, n)).when(c.rlike("[a-z]"), _from(lower, n))
                .when(c.rlike("[A-Z]"), _from(upper, n)).otherwise(c))

    return F.array_join(F.transform(F.split(value, ""), one), "")


def _check_digit(body: Column) -> Column:
    """The check digit that the digits of ``body`` call for."""
    digits = F.split(F.regexp_replace(body, "[^0-9]", ""), "")
    doubled = F.transform(F.reverse(digits), lambda c, i: F.when(i % 2 == 0, c.cast("int") * 2).otherwise(c.cast("int")))
    total = F.aggregate(doubled, F.lit(0), lambda s, x: s + F.when(x > 9, x - 9).otherwise(x))
    return ((10 - total % 10) % 10).cast("string")


def _card(value: Column, digest: Column) -> Column:
    """First digit kept, last one the check digit of the others."""
    body = F.concat(F.substring(value, 1, 1), _letterwise(F.substring(value, F.lit(2), F.length(value) - 2), digest))
    return F.concat(body, _check_digit(body))


def _name(value: Column, digest: Column, gender: str, attempt: Column) -> Column:
    """Form of address kept; as many invented words as the name has, of three
    syllables and one for each earlier attempt."""
    address = F.regexp_extract(value, r"^(\S+ )", 1)
    script = value.rlike(r"\p{IsCyrillic}+$")

    def word(i: Column, syllables: tuple[str, ...], ending: str) -> Column:
        def pick(k: Column) -> Column:
            at = i * (attempt + 3) + k
            # more syllables than the digest has numbers go on with a digest of their own per stretch
            n = _number(F.when(at < 29, digest).otherwise(F.sha2(F.concat(digest, F.floor(at / 29).cast("string")), 256)), at)
            return F.element_at(F.array(*map(F.lit, syllables)), (n % len(syllables) + 1).cast("int"))

        return F.concat(F.initcap(F.array_join(F.transform(F.sequence(F.lit(0), attempt + 2), pick), "")), F.lit(ending))

    words = F.sequence(F.lit(0), F.size(F.split(value, " ")) - 2)
    latin = F.array_join(F.transform(words, lambda i: word(i, LATIN_SYLLABLES, ENDINGS[gender, "latin"])), " ")
    cyrillic = F.array_join(F.transform(words, lambda i: word(i, CYRILLIC_SYLLABLES, ENDINGS[gender, "cyrillic"])), " ")
    return F.concat(address, F.when(script, cyrillic).otherwise(latin))


def surrogate(kind: Column, value: Column, attempt: Column, key: str) -> Column:
    """Surrogate of one entity at one attempt."""
    digest = _digest(key, kind, value, attempt.cast("string"))
    domain = F.substring_index(value, "@", -1)
    top = F.substring_index(domain, ".", -1)
    inner = F.substring(domain, F.lit(1), F.length(domain) - F.length(top) - 1)
    email = F.concat(_letterwise(F.substring_index(value, "@", 1), digest), F.lit("@"),
                     _letterwise(inner, _digest(key, F.lit("domain"), F.lower(domain))), F.lit("."), top)
    ip = F.array_join(F.transform(F.split(value, r"\."), lambda _, i: (_number(digest, i) % 254 + 1).cast("string")), ".")
    country = F.regexp_extract(value, r"^(\+\d{1,3}[ .\-]?)", 1)
    phone = F.concat(country, _letterwise(F.substring(value, F.length(country) + 1, F.length(value)), digest, digits=_NONZERO))
    access = F.concat(F.lit("AKIA"), _letterwise(F.substring(value, F.lit(5), F.length(value)), digest))
    is_hex = value.rlike("^[0-9a-f]+$")
    hexed = _letterwise(value, digest, digits=_DIGITS, lower="abcdef")
    return (F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "phone", phone).when(kind == "card", _card(value, digest))
            .when(kind == "access_key", access).when(kind == "male", _name(value, digest, "male", attempt)).when(kind == "female", _name(value, digest, "female", attempt))
            .when(is_hex, hexed).otherwise(_letterwise(value, digest)))


def surrogate_table(values: DataFrame, key: str) -> DataFrame:
    """(value, kind, surrogate) for every distinct ``value``; raises if some
    still collide after MAX_ATTEMPTS."""
    todo = materialise(values.filter("value is not null").groupBy("value").agg(F.count(F.lit(1)).alias("uses")).select("value", entity_type(F.col("value")).alias("kind")), "entities")
    originals = todo.select(F.col("value").alias("surrogate"))
    done = None
    for attempt in range(MAX_ATTEMPTS):
        tried = materialise(todo.select("value", "kind", surrogate(F.col("kind"), F.col("value"), F.lit(attempt), key).alias("surrogate")), "surrogates")
        # of the entities that share a surrogate the least keeps it, unless it is taken or is an original
        winners = tried.groupBy("surrogate").agg(F.min("value").alias("value"), F.min_by("kind", "value").alias("kind"))
        winners = winners.join(originals, "surrogate", "left_anti")
        if done is not None:
            winners = winners.join(done.select("surrogate"), "surrogate", "left_anti")
        winners = materialise(winners.select("value", "kind", "surrogate"), "surrogates")
        done = winners if done is None else done.union(winners)
        todo = tried.join(winners.select("value"), "value", "left_anti").select("value", "kind")
        if todo.isEmpty():
            return done
    raise RuntimeError(f"surrogates still collide after {MAX_ATTEMPTS} attempts")


def protect(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the text rewritten and a column n_replaced added (in place
    of one of that name)."""
    text = F.col(text_col).cast("string")
    docs = docs.filter(F.col(id_col).isNotNull())
    found = materialise(docs.select(F.col(id_col).alias("id"), entities(text).alias("found")).filter(F.size("found") > 0)
                        .select("id", F.explode(F.array_distinct("found")).alias("value")), "found")
    table = surrogate_table(found.select("value"), key)
    map_id, map_ = unused_name(docs, "map_id"), unused_name(docs, "map")
    maps = found.distinct().join(table, "value").groupBy(F.col("id").alias(map_id)).agg(
        F.map_from_entries(F.collect_list(F.struct("value", "surrogate"))).alias(map_))
    whole = F.regexp_extract_all(text, F.lit(ANY), F.lit(0))
    between = F.split(text, ANY, -1)
    rewritten = F.concat(between[0], F.array_join(F.transform(
        whole, lambda e, i: F.concat(F.coalesce(F.col(map_)[e], e), F.get(between, i + 1))), ""))
    out = docs.join(maps, F.col(id_col) == F.col(map_id), "left")
    hit = F.col(map_).isNotNull()
    return out.select(*[F.col(f"`{c}`") for c in docs.columns if c not in (text_col, "n_replaced")],
                      F.when(hit, rewritten).otherwise(text).alias(text_col), F.when(hit, F.size(F.filter(whole, lambda e: F.col(map_)[e].isNotNull()))).otherwise(0).alias("n_replaced"))
