"""Keyed surrogates for personal data, with DataFrame functions only.

Entities are found by one pattern and told apart by their own; each is replaced by a surrogate drawn from a keyed hash of its kind
and value, so an entity has the same surrogate wherever it occurs (coreference). Surrogates keep kind and format: digits
stay digits, letters letters of their case, valid card and account numbers (IBAN) stay valid, addresses stay in range, e-mail addresses
keep their top-level domain; parts of names keep gender and script.

Names are found after a form of address of the lists below, as one of the 40 given names below and the name behind it, or behind a
phrase that introduces a speaker. A name may have apostrophes and hyphens, whose sides are replaced each on its own (O'Brien,
Jean-Pierre), inner capitals (McDonald), particles and initials, which stay (van der Berg, J. Smith), and capitals throughout (JOHN
SMITH), which keep the surrogate of the same name in other letters. Other names are not found and stay: given names not listed
without a form of address or such a phrase, a surname or given name alone, names in other scripts, and what follows the second word
of a name. In texts in capitals, a word behind a listed given name is taken for a surname, but for the few of NO_SURNAMES.
Telephone numbers of fewer than 8 digits are found only in three groups, or as 555-1234 behind a word of telephones; those with
neither a plus sign nor a leading 0 only in such groups. A social security number with spaces is found behind its name, and
an IPv6 address where its first group has 3 or 4 digits, which it keeps.

Collision check: over the distinct entities of the whole corpus, two values with one surrogate, or a surrogate that is itself
some entity's value, are drawn anew until none is left. Formats with few digits must leave room for that: a corpus in which more
than half of all ten million seven-digit numbers occur is refused with an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brinework.llm import common

# Forms of address and given names by gender, and syllables that surrogate names are made of.
FEMALE_TITLES = ["Mrs", "Ms", "Miss", "Mme", "Madame", "Mlle", "Frau", "Señora", "Sra", "Doña", "госпожа", "г-жа"]
MALE_TITLES = ["Mr", "Sir", "Monsieur", "Herr", "Señor", "господин", "г-н"]
NEUTRAL_TITLES = ["Dr", "Prof", "Professor", "Доктор", "Проф"]
FEMALE_NAMES = ["Anna", "Maria", "Sophie", "Emma", "Julia", "Laura", "Sarah", "Claire", "Elena", "Carmen", "Ingrid", "Alice", "Jane", "Mary", "Anne", "Анна", "Мария", "Елена", "Ольга", "Наталья"]
MALE_NAMES = ["John", "James", "Peter", "Paul", "Hans", "Karl", "Pierre", "Jean", "Luis", "Carlos", "Thomas", "David", "Michael", "Robert", "William", "Иван", "Пётр", "Сергей", "Алексей", "Дмитрий"]
SYLLABLES = {"latin": ["ba", "den", "fe", "gar", "hol", "ki", "lan", "mor", "ne", "pel", "ros", "sal", "tor", "ul", "ven", "wes"], "cyrillic": ["ба", "ден", "фе", "гар", "хол", "ки", "лан", "мор", "не", "пел", "рос", "сал", "тор", "ул", "вен", "зар"]}
ENDINGS = {
    "latin": {"female": ["a", "ia", "ina", "ella"], "male": ["o", "an", "us", "ek"], "neutral": ["i", "en", "el", "y"], "surname": ["man", "son", "berg", "ley"]},
    "cyrillic": {"female": ["а", "ия", "ина", "елла"], "male": ["ий", "ан", "ор", "ек"], "neutral": ["и", "ен", "ел", "ю"], "surname": ["ко", "ук", "енко", "ец"]},
}

# Forms of address also found in capitals, particles of surnames, words that are no surnames, phrases before a name.
CAPITAL_TITLES = ["MR", "MRS", "MME", "MADAME", "FRAU", "SEÑORA", "MONSIEUR", "HERR", "SEÑOR"]
PARTICLES = ["van", "von", "der", "den", "de", "la", "le", "du", "di", "da", "del", "dos", "ten", "ter", "zu", "af", "bin", "ibn", "al", "el"]
NO_SURNAMES = ["AND", "OR", "THE", "IS", "WAS", "HAS", "HAD", "SAID", "WITH", "FROM", "FOR", "TO", "IN", "OF", "ON", "AT", "BY", "ET", "EST", "UND", "IST", "Y", "ES", "И"]
INTRODUCED = ["my name is", "mein name ist", "ich heiße", "je m'appelle", "je m’appelle", "me llamo", "mi nombre es", "меня зовут"]

_NAME = r"(?:[\p{Lu}dl]['’])?\p{Lu}\p{Ll}+(?:[-'’]?\p{Lu}\p{Ll}+)*+"
_CAPITALS = rf"(?!(?:{'|'.join(NO_SURNAMES)})(?!\p{{L}}))(?:\p{{Lu}}['’])?\p{{Lu}}{{2,}}+(?:[-'’]\p{{Lu}}{{2,}}+)*+(?!\p{{L}})"
_TITLE = "(?:" + "|".join(FEMALE_TITLES + MALE_TITLES + NEUTRAL_TITLES) + ")"
_GIVEN = "(?:" + "|".join(FEMALE_NAMES + MALE_NAMES + [n.upper() for n in FEMALE_NAMES + MALE_NAMES]) + r")(?:-(?:\p{Lu}\p{Ll}+|\p{Lu}{2,}))?"
#: What may stand before a surname: initials, then particles.
_BEFORE = rf"(?:\p{{Lu}}\. )*(?:(?:{'|'.join(PARTICLES + [x.capitalize() for x in PARTICLES] + [x.upper() for x in PARTICLES])}) ){{0,3}}"
#: Patterns of the kinds, in order of precedence where two begin at one place.
KINDS = {
    "secret": r"(?i:(?:token|secret|passwd|password|pwd|api[_-]?key|access[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?)[A-Za-z0-9_+/=.-]{8,}|AKIA[0-9A-Z]{16}\b",
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "iban": r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)",
    # not a telephone number that begins with 00 and a country code
    "card": r"(?<![\w.-])(?!00[1-9](?:[ ./()-]{0,2}\d){5,12}(?![ -]?\d\d))\d(?:[ -]?\d){12,18}(?![\w-])",
    # eight groups, or fewer with two colons; the first has 3 or 4 digits, so that times and names of programs are none
    "ip6": r"(?<![\w:.])(?=[A-Fa-f:]*\d)(?:[0-9A-Fa-f]{3,4}(?::[0-9A-Fa-f]{1,4}){7}|(?=[0-9A-Fa-f:]*::)(?!(?:[0-9A-Fa-f]*:){8})[0-9A-Fa-f]{3,4}(?::[0-9A-Fa-f]{1,4}){0,5}::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?)(?![\w:])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    # a North American number, any other with a country code or a leading 0 (8 to 15 digits; not a date), and the older forms
    "phone": r"(?<![\w+])\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}(?!\w)"
    r"|(?<![\w+])\+(?=\d(?:[ ./()-]{0,2}\d){7})\d{1,3}(?:[ ./()-]{1,2}\d)?(?:\d|[ ./()-]{1,2}(?=\d\d)\d){4,11}(?!\w)"
    r"|(?<![\w+.,/-])\(?0(?!\d[./-]\d{1,2}[./-](?:\d{4}(?!\d)|\d{2}(?![./-]?\d)))\d(?:\d|[ ./()-]{1,2}(?=\d\d)\d){6,13}(?!\w)"
    r"|(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}(?!\w)|(?<![\w+])\+\d{8,15}(?!\w)",
    "name": rf"{_TITLE}\.? (?:{_GIVEN} {_BEFORE}{_CAPITALS}|{_BEFORE}{_NAME}(?: {_BEFORE}{_NAME})?|{_BEFORE}{_CAPITALS}(?: {_BEFORE}{_CAPITALS})?)"
    rf"|(?:{'|'.join(CAPITAL_TITLES)})\.? {_BEFORE}{_CAPITALS}(?: {_BEFORE}{_CAPITALS})?|{_GIVEN} {_BEFORE}(?:{_NAME}|{_CAPITALS})",
}
#: Kinds that are found also behind a word that announces them: the word, and the pattern.
ANNOUNCED = {
    "ssn": (r"(?i:ssn|social security(?: number| no\.?)?)(?: is)?[:#]?[ ]", r"\d{3} \d{2} \d{4}(?![\w-])"),
    "phone": (r"(?i:telephone|phone|tel|call|fax|mobile|cell)(?: is| me at| us at| at)?[.:]?[ ]", r"\d{3}[ .-]\d{4}(?![\w-])"),
    "name": (rf"(?iu:{'|'.join(INTRODUCED)}) ", rf"{_NAME}(?: {_BEFORE}{_NAME})?"),
}
#: Kinds whose values are told apart without their separators, which stay where they are.
_GROUPED = ("iban", "card", "ssn", "phone")
#: Country codes of telephone numbers.
_COUNTRY = r"(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
#: No entity begins inside a word, so the alternatives are tried at few places.
ENTITY = r"(?<![\p{L}\p{N}])(?:" + "|".join([f"(?:{p})" for p in KINDS.values()] + [rf"(?=[\d\p{{Lu}}])(?<={word})(?:{p})" for word, p in ANNOUNCED.values()]) + ")"
_SECRET_VALUE = r"[A-Za-z0-9_+/=.-]{8,}$"


def entities(text: Column) -> Column:
    """The entities of a text, in order; an empty array for null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0)), F.array().cast("array<string>"))


def _kind(entity: Column) -> Column:
    out = F.lit("name")
    for kind in reversed([k for k in KINDS if k != "name"]):
        shapes = f"{KINDS[kind]}|{ANNOUNCED[kind][1]}" if kind in ANNOUNCED else KINDS[kind]
        out = F.when(entity.rlike(f"^(?:{shapes})$"), kind).otherwise(out)
    return out


def _pieces(name: Column) -> Column:
    """A name's words, the sides of their hyphens and apostrophes, and what is between, in order."""
    return F.regexp_extract_all(name, F.lit("[^ '’-]+|[ '’-]"), F.lit(0))


def _stays(piece: Column, led: Column, surname: Column) -> Column:
    """Whether a piece of a name stays: the form of address, particles before a surname, initials, and what is between words."""
    return led | ~piece.rlike(r"^\p{Lu}\p{L}") | (~surname & F.initcap(piece).isin([x.capitalize() for x in PARTICLES]))


def _titled(name: Column) -> Column:
    """The form of address of a name, in the letters of its list; empty without one."""
    found = F.regexp_extract(name, rf"^({_TITLE}|{'|'.join(CAPITAL_TITLES)})\.? ", 1)
    return F.when(found.isin(CAPITAL_TITLES), F.initcap(found)).otherwise(found)


def _parts_of_name(name: Column, every: bool) -> Column:
    """The pieces of a name as (kind, value, piece); of those that stay kind is null, and they are left out unless `every`."""
    script = lambda w: F.when(w.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")
    title, pieces = _titled(name), _pieces(name)
    said = F.when(title.isin(FEMALE_TITLES), "female").when(title.isin(MALE_TITLES), "male").otherwise("neutral")
    gender = lambda w: F.when(w.isin(FEMALE_NAMES), "female").when(w.isin(MALE_NAMES), "male").otherwise(said)
    # what follows the last space is the surname
    last = F.size(pieces) - F.array_position(F.reverse(pieces), " ")
    kind = lambda w, i: F.when(~_stays(w, (title != "") & (i == 0), i > last), F.concat_ws("-", script(w), F.when(i > last, "surname").otherwise(gender(F.initcap(w)))))
    told = F.transform(pieces, lambda w, i: F.struct(kind(w, i).alias("kind"), F.initcap(w).alias("value"), w.alias("piece")))
    return told if every else F.filter(told, lambda p: p["kind"].isNotNull())


def parts(entity: Column) -> Column:
    """What of an entity is replaced on its own: array of (kind, value). Words of names are apart, so they keep their surrogates
    in other combinations; of a secret it is the value; numbers are without separators, so each format has the same surrogate."""
    name = F.transform(_parts_of_name(entity, every=False), lambda p: F.struct(p["kind"].alias("kind"), p["value"].alias("value")))
    kind = _kind(entity)
    value = F.when(kind == "secret", F.regexp_extract(entity, _SECRET_VALUE, 0)).when(kind.isin("email", "ip6"), F.lower(entity)).when(kind.isin(*_GROUPED), F.regexp_replace(entity, "[^0-9A-Z+]", "")).otherwise(entity)
    return F.when(kind == "name", name).otherwise(F.array(F.struct(kind.alias("kind"), value.alias("value"))))


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _luhn(digits: Column) -> Column:
    """The check sum of an array of digit characters; valid numbers give a multiple of 10."""
    n = F.size(digits)
    twice = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    values = F.transform(digits, lambda c, i: F.when((n - i) % 2 == 0, twice(c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(values, F.lit(0), lambda a, v: a + v)


def _mod97(text: Column) -> Column:
    """The remainder by 97 of a text of digits and capital letters, which count as 10 to 35."""
    step = lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(_chars(text), F.lit(0), lambda a, c: step(a, c).cast("int"))


def _iban_moved(iban: Column) -> Column:
    return F.concat(F.substr(iban, F.lit(5)), F.substring(iban, 1, 4))


def drawn(values: DataFrame, key: str) -> DataFrame:
    """values (kind, value, attempt) with `new`, each part's surrogate at its attempt-th draw."""
    seed = F.concat_ws("\x1f", F.lit(key), "kind", "value", F.col("attempt").cast("string"))
    rows = values.withColumn("h", F.concat(F.sha2(seed, 256), F.sha2(F.concat(seed, F.lit("+")), 256)))
    kind, value, attempt = F.col("kind"), F.col("value"), F.col("attempt")
    byte = lambda i: F.conv(F.substr(F.col("h"), (i * 2) % 128 + 1, F.lit(2)), 16, 10).cast("int")
    pick = lambda chars, i: F.substr(F.lit(chars), byte(i) % len(chars) + 1, F.lit(1))
    # what stays in front: a country code or leading 0, a country, a card's first digit; and behind: a top-level domain
    front = F.when(kind == "phone", F.regexp_extract(value, rf"^(?:\+|00){_COUNTRY}|^0", 0)).when(kind == "iban", F.substring(value, 1, 2)).when(kind == "card", F.substring(value, 1, 1)).otherwise("")
    back = F.when(kind == "email", F.regexp_extract(value, r"\.[^.]*$", 0)).otherwise("")
    rows = rows.withColumn("front", front).withColumn("back", back)
    inner = F.substr(value, F.length("front") + 1, F.length(value) - F.length("front") - F.length("back"))
    hexed = value.rlike("^[0-9a-f]+$") & (kind == "secret")
    masked = F.transform(
        _chars(inner),
        lambda c, i: F.when(F.col("hexed"), pick("0123456789abcdef", i)).when(c.rlike("[0-9]"), pick("0123456789", i)).when(c.rlike("[a-z]"), pick("abcdefghijklmnopqrstuvwxyz", i)).when(c.rlike("[A-Z]"), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", i)).otherwise(c),
    )
    rows = rows.withColumn("hexed", hexed).withColumn("plain", F.concat("front", F.array_join(masked, ""), "back"))
    digits = lambda text: F.filter(_chars(text), lambda c: c.rlike("[0-9]"))
    rows = rows.withColumn("valid", F.when(kind == "card", _luhn(digits(value)) % 10 == 0).otherwise(False))
    rows = rows.withColumn("zeroed", F.when(F.col("valid"), F.regexp_replace("plain", "[0-9]$", "0")))
    fixed = F.concat(F.regexp_replace("zeroed", "0$", ""), ((10 - _luhn(digits(F.col("zeroed"))) % 10) % 10).cast("string"))
    rows = rows.withColumn("iban", F.when(kind == "iban", _mod97(_iban_moved(value)) == 1).otherwise(False))
    check = 98 - _mod97(_iban_moved(F.concat(F.substring("plain", 1, 2), F.lit("00"), F.substr(F.col("plain"), F.lit(5)))))
    iban = F.concat(F.substring("plain", 1, 2), F.lpad(check.cast("string"), 2, "0"), F.substr(F.col("plain"), F.lit(5)))
    ip = F.array_join(F.transform(F.array(*map(F.lit, range(4))), lambda i: (byte(i) % 254 + 1).cast("string")), ".")
    # an IPv6 address keeps its first group and its form; all eight groups are drawn where that left no other
    group = lambda i: F.lpad(F.lower(F.conv((byte(i * 2) * 256 + byte(i * 2 + 1)).cast("string"), 10, 16)), 4, "0")
    groups = F.split(value, ":")
    short = F.array_join(F.transform(groups, lambda g, i: F.when((i == 0) | (g == ""), g).otherwise(group(i))), ":")
    ip6 = F.when(attempt <= 3, short).otherwise(F.concat_ws(":", groups[0], *[group(F.lit(i)) for i in range(1, 8)]))
    cyrillic = kind.startswith("cyrillic")
    part = lambda k: F.when(cyrillic, F.element_at(F.array(*map(F.lit, SYLLABLES["cyrillic"])), byte(F.lit(k)) % 16 + 1)).otherwise(F.element_at(F.array(*map(F.lit, SYLLABLES["latin"])), byte(F.lit(k)) % 16 + 1))
    ends = F.create_map(*[x for script, by in ENDINGS.items() for what, chosen in by.items() for x in (F.lit(f"{script}-{what}"), F.array(*map(F.lit, chosen)))])
    more = F.when(attempt + byte(F.lit(2)) % 2 > 0, part(3)).otherwise("")
    name = F.initcap(F.concat(part(0), part(1), more, F.when(attempt > 1, part(5)).otherwise(""), F.element_at(F.element_at(ends, kind), byte(F.lit(4)) % 4 + 1)))
    new = F.when(kind == "ip", ip).when(kind == "ip6", ip6).when(F.col("valid"), fixed).when(F.col("iban"), iban).when(kind.rlike("^(latin|cyrillic)-"), name).otherwise(F.col("plain"))
    return rows.select("kind", "value", "attempt", new.alias("new"))


def surrogates(values: DataFrame, key: str, max_rounds: int = 100) -> DataFrame:
    """(kind, value, new): distinct surrogates of distinct values (kind, value), none of them a value itself."""
    values = common.written(values, "values")
    now = common.written(drawn(values.select("kind", "value", F.lit(0).alias("attempt")), key), "surrogates")
    taken = values.select(F.col("kind").alias("k"), F.col("value").alias("v"))
    for _ in range(max_rounds):
        # who keeps a surrogate: the earliest drawn, then the smallest value
        first = now.groupBy("kind", "new").agg(F.min(F.struct("attempt", "value")).alias("keeper"), F.count("*").alias("n"))
        bad = now.join(first.where("n > 1").drop("n"), ["kind", "new"]).where("value != keeper.value").select("kind", "value")
        real = now.join(taken, (now["kind"] == taken["k"]) & (now["new"] == taken["v"]), "left_semi").select("kind", "value")
        bad = common.written(bad.union(real).distinct().withColumn("again", F.lit(1)), "clashes")
        if bad.isEmpty():
            return now.select("kind", "value", "new")
        again = now.join(bad, ["kind", "value"]).select("kind", "value", (F.col("attempt") + 1).alias("attempt"))
        now = common.written(now.join(bad, ["kind", "value"], "left_anti").unionByName(drawn(again, key)), "surrogates")
    raise RuntimeError("surrogates still collide")


def _name_of(part: Column) -> Column:
    return F.concat_ws("\x1f", part["kind"], part["value"])


def _formatted(entity: Column, new: Column) -> Column:
    """The entity with its letters, digits and plus sign taken from new in turn."""
    start = F.struct(F.lit("").alias("out"), new.alias("rest"))
    keeps = lambda c: c.rlike("[0-9A-Z+]")
    step = lambda a, c: F.struct(F.concat(a["out"], F.when(keeps(c), F.substring(a["rest"], 1, 1)).otherwise(c)).alias("out"), F.when(keeps(c), F.substr(a["rest"], F.lit(2))).otherwise(a["rest"]).alias("rest"))
    return F.aggregate(_chars(entity), start, step, lambda a: a["out"])


def _rebuilt(text: Column, found: Column, new: Column) -> Column:
    """The text with each entity's parts replaced; new maps a part's name to its surrogate."""

    def one(entity: Column) -> Column:
        own = F.element_at(new, _name_of(parts(entity)[0]))
        cased = lambda p: F.when(p["piece"] == F.upper(p["piece"]), F.upper(F.element_at(new, _name_of(p)))).otherwise(F.element_at(new, _name_of(p)))
        name = F.array_join(F.transform(_parts_of_name(entity, every=True), lambda p: F.when(p["kind"].isNull(), p["piece"]).otherwise(cased(p))), "")
        return F.when(_kind(entity) == "secret", F.concat(F.regexp_replace(entity, _SECRET_VALUE, ""), own)).when(_kind(entity) == "name", name).when(_kind(entity).isin(*_GROUPED), _formatted(entity, own)).otherwise(own)

    between = F.split(text, ENTITY, -1)
    return F.concat(F.array_join(F.zip_with(F.slice(between, 1, F.size(found)), F.transform(found, one), lambda a, b: F.concat(a, b)), ""), F.element_at(between, -1))


def replaced(docs: DataFrame, key: str, found: str = "_entities") -> DataFrame:
    """docs (all columns, whatever their names) with the entities of text replaced, and a column named `found` (in place of one that
    is there), an array of the entities as they were.

    Null texts stay null and have none; empty texts stay empty; repeated rows are replaced alike; empty tables stay empty. Only
    texts with entities, which are written with what was found in them, are joined with their surrogates. The same key gives the
    same surrogates for the same entities, but for those that other corpora make clash.
    """
    docs = docs.drop(found)
    columns = docs.columns
    whole = F.struct(*[F.col(f"`{c}`") for c in columns])  # one column, so that no name of theirs meets one of ours
    some = F.coalesce(docs["text"].rlike(ENTITY), F.lit(False))
    told = docs.where(some).select(whole.alias("doc"), docs["text"].alias("told"))
    told = common.written(told.select("doc", F.md5("told").alias("name"), entities(F.col("told")).alias("entities")), "told")
    each = told.select("name", F.explode("entities").alias("e")).select("name", F.explode(parts(F.col("e"))).alias("p"))
    each = common.written(each.select("name", "p.kind", "p.value").distinct(), "occurrences")
    new = common.written(surrogates(each.select("kind", "value").distinct(), key), "chosen")
    own = each.join(new, ["kind", "value"]).groupBy("name").agg(F.map_from_entries(F.collect_list(F.struct(_name_of(F.struct("kind", "value")), F.col("new")))).alias("new"))
    told = told.join(common.written(own, "own"), "name").withColumn("text", _rebuilt(F.col("doc.text"), F.col("entities"), F.col("new")))
    rebuilt = told.select(*[F.col("text") if c == "text" else F.col(f"doc.`{c}`").alias(c) for c in columns], F.col("entities").alias(found))
    return docs.where(~some).withColumn(found, F.array().cast("array<string>")).unionByName(rebuilt)


def pseudonymised(docs: DataFrame, key: str) -> DataFrame:
    """(doc_id, text, n_entities, kinds) of each row; kinds are those found, sorted and comma-joined."""
    out = replaced(docs.select("doc_id", "text"), key)
    kinds = F.array_join(F.array_sort(F.array_distinct(F.transform("_entities", _kind))), ",")
    return out.select("doc_id", "text", F.size("_entities").alias("n_entities"), kinds.alias("kinds"))
