"""Personal data replaced by keyed surrogates of the same type, script and format.

One pattern finds the entities. Every different entity gets one surrogate, derived from a keyed hash,
wherever it occurs, so coreference holds; a check over all entities keeps surrogates distinct from
each other and from every real value, and the losers of a collision try again with the next number.
Surrogates keep what the type needs: character classes and separators, country codes, card brands and
check digits, valid address numbers, key prefixes, and, for names after a title, gender and script.
Each word of a name is an entity of its own, so "Mr John Smith" and "Mr Smith" stay related.

Types: e-mail addresses; values of password, token, secret and key settings; AKIA access keys; phone
numbers with a country code or of ten digits; IPv4 and IPv6 addresses; payment cards of 15 and 16 digits;
IBANs; US social security numbers; names of one to three words after a title (Latin, Cyrillic, Greek).
Everything is built-in functions and joins; the pattern runs over each text once, and only texts that
hold entities are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeharbor.llm.common import fresh_name, written

ROUNDS = 8
MARK = "\ue0f0"  # stands around what is found; the text's own are set apart by a semicolon meanwhile
TITLES = {
    "m": ["Mr", "Herr", "Monsieur", "Señor", "Sr", "г-н", "Dr", "Prof", "κ"],
    "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "г-жа", "κα"],
}
NAMES = {
    ("m", "latin"): "Adler Brandt Castro Dupont Ellis Ferrer Garnier Hughes Ibarra Jansen Keller Lambert Moreau Norris Ortega Parker".split(),
    ("f", "latin"): "Alonso Bennett Clarke Durand Engel Fischer Gomez Hansen Irwin Jimenez Krause Laurent Mercer Navarro Olsen Petit".split(),
    ("m", "cyrillic"): "Белов Громов Жуков Зимин Котов Лавров Носов Седов".split(),
    ("f", "cyrillic"): "Белова Громова Жукова Зимина Котова Лаврова Носова Седова".split(),
    ("m", "greek"): "Αλεξίου Βλάχος Γεωργίου Δήμου Ζήσης Κώστας Λάμπρου Μάνος".split(),
    ("f", "greek"): "Αλεξάκη Βλάχου Γρίβα Δούκα Ζέρβα Κόκκαλη Λάππα Μακρή".split(),
}
SCRIPTS = {"cyrillic": (r"\p{IsCyrillic}", "аеиоувклмнрстдпя"), "greek": (r"\p{IsGreek}", "αειουβκλμνρστδπω"), "latin": (".", "aeioulmnrstdkvpy")}
_HEX = "[0-9A-Fa-f]{1,4}"
_NAME = r"\p{Lu}\p{L}*+(?:['’](?!s(?!\p{L}))\p{L}++)*+(?:-\p{Lu}\p{L}*+)*+"
SECRET = r"(?i:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key)\s?[=:]\s?[\"']?"
_TITLE = "|".join(sorted((t for ts in TITLES.values() for t in ts), key=len, reverse=True))
PATTERN = "|".join([
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]++\.)+[A-Za-z]{2,}",
    r"(?<![\p{L}\p{N}_])" + SECRET + r"[A-Za-z0-9+/_-]{8,}+",
    r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])",
    r"(?<![\d+])\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})[ .-]?\d{3}[ .-]?\d{3,4}(?!\d)",
    r"(?<![\d(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)",
    r"(?<![\d.-])\d{3}([.-])\d{3}[.-]\d{4}(?![\d-])",
    rf"(?<![0-9A-Fa-f:.])(?=[0-9A-Fa-f:]*\d)(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}}|(?:{_HEX}:){{2,7}}:)(?![0-9A-Za-z:.])",
    r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)",
    r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    r"(?<!\d)\d{4}(?:[ -]?\d{4}){3}(?!\d)",
    r"(?<!\d)3[47]\d{2}[ -]?\d{6}[ -]?\d{5}(?!\d)",
    r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    rf"(?<![\p{{L}}])(?:{_TITLE})\.? {_NAME}(?: {_NAME}){{0,2}}+",
]).replace("([.-])", "[.-]")


def _kind(m: Column) -> Column:
    return (
        F.when(m.rlike(r"^[^=:\s\"']*@"), "email").when(m.rlike("^" + SECRET), "secret").when(m.rlike(r"^AKIA[0-9A-Z]{16}$"), "key")
        .when(m.rlike(r"^[+(]|^\d{3}[.-]\d{3}[.-]\d{4}$"), "phone").when(m.rlike("^[0-9A-Fa-f:]*:[0-9A-Fa-f:]*$"), "address6").when(m.rlike(r"^[A-Z]{2}\d{2}[ A-Z0-9]+$"), "iban").when(m.rlike(r"^\d+\.\d+\.\d+\.\d+$"), "address").when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), "number")
        .when(m.rlike(r"^\d"), "card").otherwise("person")
    )


def _head(m: Column, kind: Column) -> Column:
    """What stands before the value and stays: the name of a secret, the title of a person."""
    return F.when(kind == "secret", F.regexp_extract(m, "^" + SECRET, 0)).when(kind == "person", F.regexp_extract(m, r"^(?:%s)\.? " % _TITLE, 0)).otherwise("")


def _identities(m: Column, kind: Column) -> Column:
    """What makes two mentions the same, one text for each word of a name and one for any other: letters' case
    and separators do not count where the type ignores them."""
    value = F.substr(m, F.length(_head(m, kind)) + 1)
    gender = F.when(F.regexp_replace(_head(m, kind), r"\.? $", "").isin(TITLES["f"]), "f").otherwise("m")
    one = (
        F.when(kind.isin("email", "address6"), F.lower(value))
        .when((kind == "phone") & ~value.startswith("+"), F.concat(F.lit(" "), F.regexp_replace(value, r"\D", "")))
        .when(kind == "iban", F.replace(value, F.lit(" "), F.lit("")))
        .when(kind == "phone", F.concat(F.regexp_extract(value, r"^(\+\d{1,3}?)(?:[ .-]|\(|\d{9,}$|\d{2,4}[ .-])", 1), F.lit(" "), F.regexp_replace(F.regexp_replace(value, r"^\+\d{1,3}?(?=[ .-]|\(|\d{9,}$|\d{2,4}[ .-])", ""), r"\D", "")))
        .when(kind == "card", F.regexp_replace(value, r"\D", ""))
        .otherwise(value)
    )
    names = F.transform(F.split(value, " "), lambda w: F.concat(gender, F.lit(":"), w))
    return F.when(kind == "person", names).otherwise(F.array(one))


def marked(text: Column) -> Column:
    """The text with marks around every entity."""
    own = F.replace(text, F.lit(MARK), F.lit(MARK + ";"))
    return F.regexp_replace(own, PATTERN, f"{MARK}<$0{MARK}>")


def _unmarked(text: Column) -> Column:
    return F.replace(text, F.lit(MARK + ";"), F.lit(MARK))


def mentions(text: Column) -> Column:
    """array of struct(kind, head, value, ids, rest) of a marked text: its entities in order, and the text after each."""
    found = F.slice(F.split(text, MARK + "<"), 2, F.length(text))

    def parts(piece):
        m = F.substring_index(piece, MARK + ">", 1)
        kind = _kind(m)
        return F.struct(
            kind.alias("kind"), _head(m, kind).alias("head"), F.substr(m, F.length(_head(m, kind)) + 1).alias("value"), _identities(m, kind).alias("ids"),
            F.substr(piece, F.length(m) + len(MARK) + 2).alias("rest"))

    return F.transform(found, parts)


def _stream(secret: str, kind: Column, identity: Column, attempt: int) -> Column:
    """Two hexadecimal digits of keyed hash for each character of the identity."""
    def block(i):
        return F.sha2(F.concat_ws("|", F.lit(secret), kind, identity, F.lit(str(attempt)), i.cast("string")), 256)

    return F.array_join(F.transform(F.sequence(F.lit(0), F.floor(F.length(identity) / 32).cast("int")), block), "")


def _at(stream: Column, i: Column) -> Column:
    return F.conv(F.substring(stream, 2 * i - 1, F.lit(2)), 16, 10).cast("int")


def _scramble(value: Column, stream: Column) -> Column:
    """Each digit and ASCII letter for another of its class (hexadecimal text stays that), the rest as it is."""
    hexadecimal = value.rlike("^[0-9a-f]+$") & value.rlike("[a-f]")

    def one(i):
        c, n = F.substring(value, i, F.lit(1)), _at(stream, i)
        return (
            F.when(hexadecimal, F.substring(F.lit("0123456789abcdef"), n % 16 + 1, F.lit(1)))
            .when(c.rlike("[0-9]"), F.char(48 + n % 10)).when(c.rlike("[a-z]"), F.char(97 + n % 26)).when(c.rlike("[A-Z]"), F.char(65 + n % 26)).otherwise(c)
        )

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(value)), one), "")


def _check_digit(body: Column) -> Column:
    """The closing digit that makes a card number of this body pass the usual mod 10 test."""
    def add(acc, i):
        d = F.substring(body, F.length(body) - i, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 0, F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(0), F.length(body) - 1), F.lit(0), add)
    return F.pmod(F.lit(10) - total % 10, F.lit(10)).cast("string")


def _passes(number: Column) -> Column:
    return _check_digit(F.substr(number, F.lit(1), F.length(number) - 1)) == F.substr(number, F.length(number), F.lit(1))


def _iban(country: Column, body: Column) -> Column:
    """The account number with the check digits that belong to it."""
    spelled = F.concat(body, country, F.lit("00"))

    def add(acc, i):
        c = F.substring(spelled, i, F.lit(1))
        letter = F.ascii(c) - 55
        return F.when(c.rlike("[0-9]"), (acc * 10 + c.cast("int")) % 97).otherwise((acc * 100 + letter) % 97)

    rest = F.aggregate(F.sequence(F.lit(1), F.length(spelled)), F.lit(0), add)
    return F.concat(country, F.lpad((98 - rest).cast("string"), 2, "0"), body)


def _hex_scramble(value: Column, stream: Column) -> Column:
    """Each hexadecimal digit for another, colons as they are."""
    def one(i):
        c = F.substring(value, i, F.lit(1))
        return F.when(c == ":", c).otherwise(F.substring(F.lit("123456789abcdef"), _at(stream, i) % 15 + 1, F.lit(1)))

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(value)), one), "")


def surrogate(secret: str, kind: Column, identity: Column, attempt: int) -> Column:
    """The candidate of an entity for one attempt, in the form of its identity."""
    stream = _stream(secret, kind, identity, attempt)
    mixed = _scramble(identity, stream)
    local = F.substring_index(identity, "@", 1)
    domain = F.substring_index(identity, "@", -1)
    place = F.substring_index(domain, ".", -1)  # the last label stays
    site = F.substr(domain, F.lit(1), F.length(domain) - F.length(place) - 1)
    site = _scramble(site, _stream(secret, F.lit("domain"), site, 0))  # one domain, one surrogate domain
    email = F.concat(F.substr(mixed, F.lit(1), F.length(local)), F.lit("@"), site, F.lit("."), place)
    code = F.substring_index(identity, " ", 1)
    after = F.length(code) + 2
    phone = F.concat(code, F.lit(" "), F.char(50 + _at(stream, after) % 8), F.substr(mixed, after + 1))
    octet = [(1 + _at(stream, F.lit(i)) % 254).cast("string") for i in (1, 2, 3, 4)]
    private = F.regexp_extract(identity, r"^(10\.|192\.168\.|127\.)", 1)
    kept = F.size(F.split(private, r"\.")) - 1
    address = F.concat(private, F.array_join(F.slice(F.array(*octet), kept + 1, 4 - kept), "."))
    body = F.concat(F.substr(identity, F.lit(1), F.lit(1)), F.substr(mixed, F.lit(2), F.length(identity) - 2))
    card = F.when(_passes(identity), F.concat(body, _check_digit(body))).otherwise(F.concat(F.substr(identity, F.lit(1), F.lit(1)), F.substr(mixed, F.lit(2))))
    gender = F.substr(identity, F.lit(1), F.lit(1))
    person = F.lit(None).cast("string")
    for (sex, script), names in sorted(NAMES.items(), key=lambda x: x[0][1] != "latin"):  # the last that fits counts, Latin fits all
        pool = F.array(*[F.lit(n) for n in names])
        fits = (gender == sex) & F.substr(identity, F.lit(3)).rlike(SCRIPTS[script][0])
        first = F.element_at(pool, F.pmod(F.conv(F.substring(stream, 1, 6), 16, 10).cast("int"), F.lit(len(names))) + 1)
        second = F.element_at(pool, F.pmod(F.conv(F.substring(stream, 7, 6), 16, 10).cast("int"), F.lit(len(names))) + 1)
        ending = F.translate(F.substring(stream, 13, 2 + 2 * attempt), "0123456789abcdef", SCRIPTS[script][1])
        name = [first, F.concat(first, F.lit("-"), second)][min(attempt, 1)]
        made = F.concat(gender, F.lit(":"), name if attempt < 2 else F.concat(name, ending))
        person = F.when(fits, made).otherwise(person)
    key = F.concat(F.lit("AKIA"), F.substr(mixed, F.lit(5)))
    return (
        F.when(kind == "email", email).when(kind == "phone", phone).when(kind == "address", address).when(kind == "card", card)
        .when(kind == "person", person).when(kind == "key", key)
        .when(kind == "iban", _iban(F.substr(identity, F.lit(1), F.lit(2)), F.substr(mixed, F.lit(5)))).when(kind == "address6", _hex_scramble(identity, stream)).otherwise(mixed)
    )


def registry(entities: DataFrame, secret: str, rounds: int = ROUNDS) -> DataFrame:
    """(kind, id, sub) for entities(kind, id), one row each: distinct surrogates, none of them a real value.

    A candidate wins if no smaller entity wants it, no earlier round gave it away and no entity is called
    so. The few that lose every round get a longer surrogate that ends in their own hash.
    """
    real = entities.select("kind", F.col("id").alias("sub"))
    tasks = int(min(200, 1 + entities.count() // 1000))  # a candidate takes half a millisecond
    open_rows, given = entities.repartition(tasks, "kind", "id"), None
    for attempt in range(rounds):
        wanted = open_rows.withColumn("sub", surrogate(secret, F.col("kind"), F.col("id"), attempt))
        won = wanted.groupBy("kind", "sub").agg(F.min("id").alias("id")).join(real, ["kind", "sub"], "left_anti")
        if given is not None:
            won = won.join(given.select("kind", "sub"), ["kind", "sub"], "left_anti")
        won = written(won.select("kind", "id", "sub"))
        given = won if given is None else given.union(won)
        open_rows = written(open_rows.join(won, ["kind", "id"], "left_anti"))
        if open_rows.isEmpty():
            return given
    rest = F.concat("id", F.substring(F.sha2(F.concat_ws("|", F.lit(secret), "kind", "id"), 256), 1, 24))
    last = F.concat(surrogate(secret, F.col("kind"), F.col("id"), rounds), F.substring(F.sha2(F.concat_ws("|", F.lit(secret), "kind", rest), 256), 1, 24))
    return given.union(open_rows.select("kind", "id", last.alias("sub")))


def _render(kind: Column, value: Column, sub: Column) -> Column:
    """The surrogate in the format of one mention."""
    digits = F.regexp_replace(sub, r"\D", "")

    def one(i):
        c = F.substring(value, i, F.lit(1))
        return F.when(c.rlike(r"\d"), F.substring(digits, F.length(F.regexp_replace(F.substr(value, F.lit(1), i), r"\D", "")), F.lit(1))).otherwise(c)

    def spread(i):
        c = F.substring(value, i, F.lit(1))
        return F.when(c == " ", c).otherwise(F.substring(sub, F.length(F.replace(F.substr(value, F.lit(1), i), F.lit(" "), F.lit(""))), F.lit(1)))

    each = F.sequence(F.lit(1), F.length(value))
    spaced, grouped = (F.array_join(F.transform(each, f), "") for f in (one, spread))
    return F.when(kind.isin("phone", "card"), spaced).when(kind == "iban", grouped).when(kind == "person", F.substr(sub, F.lit(3))).otherwise(sub)


def replace(docs: DataFrame, secret: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The documents with their entities replaced, and _n_entities, the mentions replaced in each.

    Texts without an entity, null and empty ones stay as they are. Rows with the same key and repeated
    rows are treated each; the same entity has the same surrogate in all of them. Where a column is named
    _n_entities already, the added one has more underscores. The marked texts are written once, so the
    pattern runs over each text once; key is not looked at.
    """
    place = docs.columns.index(text)
    inner = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    body = f"c{place}"
    seen = inner.withColumn("m", marked(F.col(body).cast("string"))).withColumn("row", F.monotonically_increasing_id())
    seen = written(seen.withColumn("m", F.when(F.contains("m", F.lit(MARK + "<")), F.col("m"))))
    held = seen.filter("m IS NOT NULL")
    entities = F.flatten(F.transform(mentions(F.col("m")), lambda m: F.transform(m["ids"], lambda i: F.struct(m["kind"].alias("kind"), i.alias("id")))))
    found = written(held.select("row", F.inline(F.array_distinct(entities))))
    subs = registry(written(found.select("kind", "id").distinct()), secret)
    label = F.concat("kind", F.lit(":"), "id")
    maps = found.join(subs, ["kind", "id"]).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct(label, "sub"))).alias("subs"))

    def swap(m):
        given = F.transform(m["ids"], lambda i: F.element_at("subs", F.concat(m["kind"], F.lit(":"), i)))
        names = F.array_join(F.transform(given, lambda g: F.substr(g, F.lit(3))), " ")
        return F.concat(m["head"], F.when(m["kind"] == "person", names).otherwise(_render(m["kind"], m["value"], given[0])), m["rest"])

    clean = held.join(maps, "row").withColumn("all", mentions(F.col("m")))
    made = F.concat(F.substring_index("m", MARK + "<", 1), F.array_join(F.transform("all", swap), ""))
    clean = clean.withColumn(body, _unmarked(made)).withColumn("n", F.size("all").cast("long"))
    plain = seen.filter("m IS NULL").withColumn("n", F.lit(0).cast("long"))
    return plain.select(*inner.columns, "n").unionByName(clean.select(*inner.columns, "n")).toDF(*docs.columns, fresh_name(docs, "n_entities"))


def protect(docs: DataFrame, secret: str) -> DataFrame:
    """The documents with surrogates; n_chars, where there is one, follows the new text."""
    made, count = replace(docs, secret), fresh_name(docs, "n_entities")
    if "n_chars" in docs.columns:
        made = made.withColumn("n_chars", F.when(F.col(count) > 0, F.length("text")).otherwise(F.col("n_chars")))
    return made.select(*docs.columns)
