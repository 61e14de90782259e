"""Surrogates for personal data, in DataFrame functions only.

Mail and IP addresses, account, card and phone numbers, secrets, and titled, known or announced names are replaced where they stand
by values made from a keyed hash: digits for digits, letters for letters of the same case and alphabet, names for names of the same
gender and script, with check digits that hold where the original's do. One value has one surrogate in the whole table, whatever
document it is in and however it is written: a phone number with or without country code and separators, an account or card number
with or without spaces, a name in capitals or not, a surname with or without a first name. Names found in a document are also
replaced where they stand alone in it. Surrogates that two values would share, or that are themselves values of the table, are made
again with the next attempt number until all are distinct; later attempts are longer, so there is always one that is free.

Cases: null texts stay null and empty ones empty; texts without such data are unchanged, byte for byte; texts of any length
are read whole; repeated rows get the same text; ids are not looked at; an empty table gives an empty result; a column
n_entities is replaced, other columns are kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from banditframe.llm.common import cut

#: Fixed lists. Given names by script and gender; surrogates begin with one of them.
GIVEN = {
    ("latin", "f"): ["Anna", "Clara", "Elena", "Emma", "Ida", "Julia", "Laura", "Maria", "Mary", "Nora", "Paula", "Sarah", "Sofia", "Vera"],
    ("latin", "m"): ["Adam", "Carlos", "David", "Erik", "Felix", "Hugo", "James", "John", "Leo", "Martin", "Oscar", "Paul", "Peter", "Thomas"],
    ("cyrillic", "f"): ["Анна", "Вера", "Елена", "Ирина", "Мария", "Ольга", "Софья"],
    ("cyrillic", "m"): ["Антон", "Борис", "Иван", "Кирилл", "Олег", "Павел", "Юрий"],
}
TITLES = {"f": ["Mrs", "Ms", "Miss", "Frau", "Señora", "Madame", "Mme", "Г-жа", "Госпожа"], "m": ["Mr", "Mister", "Sir", "Herr", "Señor", "Monsieur", "Г-н", "Господин"], "n": ["Dr", "Prof", "Professor", "Доктор"]}
#: What announces a name of two or three words.
BEFORE = ["name is ", "Name is ", "name: ", "Name: ", "Dear ", "Sincerely, ", "Regards, ", "Contact: ", "Author: ", "Attn: ", "Signed, "]
PARTICLES = ["van", "von", "der", "den", "de", "del", "da", "di", "la", "le", "bin", "al"]
#: Capitalised words that are no part of a name before them.
STOPS = ["The", "A", "An", "In", "On", "At", "He", "She", "It", "And", "But", "We", "They", "This", "That", "Der", "Die", "Das", "Er", "Sie", "Es", "Und", "El", "Los", "Las", "Il", "Elle", "Les", "Et"]
#: Letters by alphabet, and the parts of made-up syllables.
ALPHABETS = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзиклмнопрстуфхцчшэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}
SYLLABLE = {"latin": ("bdfghklmnprstvwz", "aeiou", "lnrsmtkd"), "cyrillic": ("бвгджзклмнпрстфх", "аеиоу", "лнрсмткд")}

# Each pattern begins with what fails fast: a run's start, one class of characters, or a word boundary.
_RUN = r"[\p{L}\p{N}._%+-]"
_HEX = "[0-9A-Fa-f]{1,4}"
_ALONE, _END = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
_SECRET = r"[A-Za-z0-9_+/=.-]{7,}[A-Za-z0-9_+/=]"
#: What stands before a secret and stays.
_LABEL = r"(?i:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key)"
MAIL = rf"(?<!{_RUN}){_RUN}++@[\p{{L}}\p{{N}}-]+(?:\.[\p{{L}}\p{{N}}-]+)+"
KEYED = rf"(?=[tspaTSPA])(?<![A-Za-z0-9]){_LABEL}(?:\s{{0,2}}=\s{{0,2}}[\"']?|\s{{0,2}}:\s{{0,2}}[\"']?(?=[A-Za-z_+/=.-]*[0-9])){_SECRET}"
BARE = r"(?=[A-Fa-f0-9])\b(?=[A-Fa-f]*[0-9])[0-9a-fA-F]{32,}\b|(?=[Agsx])\b(?:AKIA|ghp_|sk-|xox[bp]-)(?=[A-Za-z_-]*[0-9])[A-Za-z0-9_-]{12,}"
IBAN = rf"(?=[A-Z]){_ALONE}[A-Z]{{2}}[0-9]{{2}}(?=(?:[A-Z ]*[0-9]){{6}})(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?{_END}"
IP6 = rf"(?=[0-9A-Fa-f])(?<![\p{{L}}\p{{N}}:])(?:(?:{_HEX}:){{7}}{_HEX}|(?=[A-Fa-f:]*[0-9]){_HEX}(?::{_HEX}){{0,6}}::(?:{_HEX}(?::{_HEX}){{0,6}})?)(?![\p{{L}}\p{{N}}:])"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
IP = rf"(?=[0-9])(?<![\p{{L}}\p{{N}}.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?[0-9])"
CARD = rf"(?=[0-9]){_ALONE}(?:(?:[0-9]{{4}}[ -]){{3}}[0-9]{{1,7}}|[0-9]{{13,19}}){_END}"
_GROUP = r"[ .-]?[0-9]{2,4}(?![0-9])(?!\.[0-9]{1,3}\.[0-9])"
PHONE = "|".join([
    rf"\+[0-9]{{1,3}}[ .-]?(?:\([0-9]{{1,4}}\)[ .-]?)?[0-9]{{2,4}}(?:{_GROUP}|[0-9]{{2,4}}(?=[0-9])){{1,3}}(?![0-9])",
    r"\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])",
    r"(?=[0-9])(?<![\p{L}\p{N}.-])(?:[0-9]{3}-[0-9]{3}-[0-9]{4}|[0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9]{3}\.[0-9]{3}\.[0-9]{4}|0[0-9]{2,4}[ /-][0-9]{3,4}[ -]?[0-9]{3,5})(?![\p{L}0-9-]|\.[0-9])",
])
_T = "|".join(w for ts in TITLES.values() for t in ts for w in (t, t.upper()))
_G = "|".join(w for ns in GIVEN.values() for n in ns for w in (n, n.upper()))
_FIRST = "".join(sorted({x[0] for x in f"{_T}|{_G}".split("|")}))
_WORD = rf"(?!(?:{'|'.join(STOPS)})\b)(?:\p{{Lu}}['’])?\p{{Lu}}\p{{L}}+(?:['’-]\p{{L}}+)*"
_NEXT = rf" (?:\p{{Lu}}\. )?(?:(?:{'|'.join(PARTICLES)}) ){{0,2}}{_WORD}"
NAME = rf"(?=[{_FIRST}])(?<!\p{{L}})(?:(?:{_T})\.?(?:{_NEXT}){{1,3}}|(?:{_G})(?:{_NEXT}){{1,2}})|(?=\p{{Lu}})(?<={'|'.join(BEFORE)}){_WORD}(?:{_NEXT}){{1,2}}"
ANY = "|".join(f"(?:{p})" for p in (MAIL, KEYED, BARE, IBAN, IP6, IP, CARD, PHONE, NAME))
#: What every entity has: a digit, one of @ = : , or a title, given name or announcement. Texts without are not searched.
MAY = rf"[0-9@=:]|(?=[{_FIRST}])(?<!\p{{L}})(?:{_T}|{_G})(?!\p{{L}})|{'|'.join(b for b in BEFORE if ':' not in b)}"


def _array(words: list[str]) -> Column:
    """words as one literal."""
    return F.split(F.lit(" ".join(words)), " ")


def let(x: Column, body: Callable[[Column], Column]) -> Column:
    """body of x, which is computed once however often body uses it."""
    return F.get(F.transform(F.array(x), body), 0)


def find(text: Column) -> Column:
    """The entities of a text in order, as they stand in it."""
    return F.when(text.rlike(MAY), F.regexp_extract_all(text, F.lit(f"({ANY})"), F.lit(1))).otherwise(F.array().cast("array<string>"))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _country(phone: Column) -> Column:
    """The digits of a phone number that are kept: its country code, or the zeros of a national number."""
    return F.regexp_extract(phone, r"^\+(1|7|[0-9]{1,3}(?=[ .(-])|[0-9]{2})|^(0+)", 0)


def _named(entity: Column) -> Column:
    """(token, kind, value) of each word of a name: titles, initials and particles have no kind; the last word is the surname."""

    def words(parts: Column) -> Column:
        def one(w: Column, i: Column, title: Column) -> Column:
            is_title = lambda *sexes: F.array_contains(_array([w for s in sexes for t in TITLES[s] for w in (t, t.upper())]), title)
            plain = ((i == 0) & is_title("f", "m", "n")) | w.rlike(r"^\p{Lu}\.$") | F.array_contains(_array(PARTICLES), w)
            script = F.when(w.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")
            known = [F.when(F.array_contains(_array([n.lower() for s in SYLLABLE for n in GIVEN[s, x]]), F.lower(w)), x) for x in "fm"]
            sex = F.coalesce(*known, *[F.when(is_title(x), x) for x in "fm"], F.lit("n"))
            kind = F.when(plain, None).when(i == F.size(parts) - 1, F.concat(F.lit("surname-"), script)).otherwise(F.concat(F.lit("given-"), script, F.lit("-"), sex))
            return F.struct(w.alias("token"), kind.alias("kind"), F.lower(w).alias("value"))

        return let(F.regexp_replace(F.get(parts, F.lit(0)), r"\.$", ""), lambda title: F.transform(parts, lambda w, i: one(w, i, title)))

    return let(F.split(entity, " "), words)


def units(entity: Column) -> Column:
    """(token, kind, value) of what an entity holds: a name has a unit for each word, all others are one. value is what is the same
    in all ways to write it."""
    one = lambda kind, value=entity: F.array(F.struct(entity.alias("token"), F.lit(kind).alias("kind"), value.alias("value")))
    is_ = lambda pattern: entity.rlike(rf"^(?:{pattern})$")
    return (
        F.when(entity.contains("@"), one("mail"))
        .when(is_(IP), one("ip"))
        .when(is_(CARD), one("card", _digits(entity)))
        .when(is_(PHONE), one("phone", F.substring(_digits(entity), F.length(_digits(_country(entity))) + 1, F.length(entity))))
        .when(is_(IBAN), one("iban", F.replace(entity, F.lit(" "), F.lit(""))))
        .when(is_(IP6), one("ip6"))
        .when(is_(f"(?:{KEYED})|(?:{BARE})"), one("secret", F.regexp_extract(entity, rf"^(?:{_LABEL}\s{{0,2}}[=:]\s{{0,2}}[\"']?)?(.*)$", 1)))
        .otherwise(_named(entity))
    )


def _luhn(digits: Column) -> Column:
    """The digit that makes digits and itself pass the checksum of card numbers."""
    worth = lambda d, twice: F.when(twice, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)
    one = lambda s, k: (s + let(F.substring(digits, k, F.lit(1)).cast("int"), lambda d: worth(d, (F.length(digits) - k) % 2 == 0))).cast("int")
    total = F.when(F.length(digits) > 0, F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), one)).otherwise(0)
    return F.pmod(-total, F.lit(10)).cast("string")


def _mod97(text: Column) -> Column:
    """text, letters as 10 to 35, modulo 97."""
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    step = lambda s, c: ((s * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97).cast("int")
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), step)


def surrogate(kind: Column, value: Column, attempt: Column, key: str) -> Column:
    """What stands for value: a function of the key, the kind, the value and the attempt number only."""
    number = lambda h, k: F.conv(F.substring(h, 4 * k + 1, 4), 16, 10).cast("int")
    letter = lambda text, h, k: F.substring(F.lit(text), number(h, k) % len(text) + 1, F.lit(1))
    syllable = lambda script, h, k: F.concat(*[letter(text, h, k + j) for j, text in enumerate(SYLLABLE[script])])
    port = F.when(attempt > 8, F.concat(F.lit(":"), F.repeat(F.lit("1"), attempt - 8))).otherwise("")

    def more(seed: Column, fill: Callable[[Column], Column]) -> Column:
        """What makes later attempts longer: a short value has few surrogates of its length."""
        parts = F.sequence(F.lit(1), 2 * F.greatest(attempt - 3, F.lit(1)))
        made = F.array_join(F.transform(parts, lambda k: fill(F.sha2(F.concat_ws("\x1f", seed, F.lit("more"), k.cast("string")), 256))), "")
        return F.when(attempt > 3, made).otherwise("")

    def shaped(seed: Column, stream: Column) -> Column:
        """value with each letter and digit replaced by one of its kind."""
        hexed = kind.isin("secret", "ip6")
        pick = lambda text, n: F.substring(F.lit(text), n % len(text) + 1, F.lit(1))

        def same(c: Column, n: Column) -> Column:
            out = F.when(c.rlike(r"[0-9]"), pick("0123456789", n)).when(hexed & c.rlike("[a-f]"), pick("abcdef", n)).when(hexed & c.rlike("[A-F]"), pick("ABCDEF", n))
            for script in ("cyrillic", "greek"):
                name = script.capitalize()
                out = out.when(c.rlike(rf"[\p{{Is{name}}}&&\p{{Lu}}]"), pick(ALPHABETS[script].upper(), n)).when(c.rlike(rf"\p{{Is{name}}}"), pick(ALPHABETS[script], n))
            return out.when(c.rlike(r"\p{Lu}"), pick(ALPHABETS["latin"].upper(), n)).when(c.rlike(r"\p{L}"), pick(ALPHABETS["latin"], n)).otherwise(c)

        # a mail address keeps its last two domain labels, an account number its country and check digits' place
        fixed = F.when(kind == "mail", F.length(F.regexp_extract(value, r"(?:@|\.)([^.@]+\.[^.@]+)$", 1))).otherwise(0)
        lead = F.when(kind == "iban", 4).otherwise(0)
        byte = lambda i: F.conv(F.substring(stream, 2 * i + 1, F.lit(2)), 16, 10).cast("int")
        one = lambda c, i: F.when((i < lead) | (i >= F.length(value) - fixed), c).otherwise(let(byte(i), lambda n: same(c, n)))
        return F.array_join(F.transform(F.filter(F.split(value, ""), lambda c: c != ""), one), "")

    def formatted(seed: Column) -> Column:
        # two hex digits for each character, from as many SHA-512 digests as the value's length asks for
        blocks = F.sequence(F.lit(0), F.floor(F.length(value) / 64).cast("int"))
        stream = F.array_join(F.transform(blocks, lambda b: F.sha2(F.concat_ws("\x1f", seed, b.cast("string")), 512)), "")
        letters, digits = more(seed, lambda h: letter(ALPHABETS["latin"], h, 0)), more(seed, lambda h: letter("0123456789", h, 0))

        def grown(x: Column) -> Column:
            longer = F.when(kind == "mail", F.concat(letters, x)).when(kind.isin("phone", "card", "iban"), F.concat(x, digits)).when(kind == "ip6", F.concat(x, port)).otherwise(F.concat(x, letters))
            return let(longer, checked)

        return let(stream, lambda s: let(shaped(seed, s), grown))

    def checked(x: Column) -> Column:
        """x with the check digits that its kind has; those of a card only if the value's hold."""
        body = lambda v: F.substring(v, F.lit(1), F.length(v) - 1)
        card = F.when(_luhn(body(value)) == F.substring(value, -1, 1), let(body(x), lambda v: F.concat(v, _luhn(v)))).otherwise(x)
        country = F.substring(value, 1, 2)
        iban = let(F.substring(x, F.lit(5), F.length(x)), lambda v: F.concat(country, F.lpad((98 - _mod97(F.concat(v, country, F.lit("00")))).cast("string"), 2, "0"), v))
        return F.when(kind == "card", card).when(kind == "iban", iban).otherwise(x)

    def named(seed: Column, deep: Column) -> Column:
        # an address space can be full: then a port comes after it
        out = F.when(kind == "ip", F.concat(F.concat_ws(".", *[(number(deep, k) % 254 + 1).cast("string") for k in range(4)]), port))
        for script in SYLLABLE:
            end = more(seed, lambda h, script=script: syllable(script, h, 0))
            for sex in "fmn":
                names = [n.lower() for x in ("fm" if sex == "n" else sex) for n in GIVEN[script, x]]
                base = F.get(_array(names), number(deep, 0) % len(names))
                out = out.when(kind == f"given-{script}-{sex}", F.concat(base, syllable(script, deep, 1), syllable(script, deep, 4), end))
            out = out.when(kind == f"surname-{script}", F.concat(*[syllable(script, deep, 3 * k) for k in range(3)], end))
        return out

    seed = F.concat_ws("\x1f", F.lit(key), kind, value, attempt.cast("string"))
    return let(seed, lambda s: F.when(kind.rlike("^(given|surname|ip$)"), let(F.sha2(s, 512), lambda deep: named(s, deep))).otherwise(formatted(s)))


def _space(kind: Column) -> Column:
    """Kinds among which surrogates must be distinct: a given name is one of any gender and script."""
    return F.regexp_extract(kind, "^([a-z0-9]+)", 1)


def assignments(found: DataFrame, key: str) -> DataFrame:
    """(kind, value) -> the same, distinct, with attempt and surrogate, all surrogates distinct among kinds of a space and none
    a value of the table. Each pass is one aggregation and one join over the distinct values."""
    now = cut(found.select("kind", "value").distinct().withColumn("attempt", F.lit(0)))
    make = surrogate(F.col("kind"), F.col("value"), F.col("attempt"), key)
    while True:
        made = cut(now.withColumn("surrogate", make).withColumn("space", _space(F.col("kind"))))
        keep = made.groupBy("space", "surrogate").agg(F.min(F.struct("attempt", "kind", "value")).alias("first"), F.count("*").alias("n"))
        taken = made.select(F.col("space").alias("k"), F.col("value").alias("v")).distinct()
        clash = keep.join(taken, (keep["space"] == taken["k"]) & (keep["surrogate"] == taken["v"]), "left").filter("n > 1 or v is not null")
        clash = cut(clash.select(F.col("space").alias("ck"), F.col("surrogate").alias("cs"), F.when(F.col("v").isNull(), F.struct("first.kind", "first.value")).alias("stays")))
        if clash.isEmpty():
            return made.drop("space")
        again = (made["space"] == clash["ck"]) & (made["surrogate"] == clash["cs"]) & ~F.struct("kind", "value").eqNullSafe(clash["stays"])
        hit = made.join(clash, again, "left")
        now = cut(hit.select("kind", "value", (F.col("attempt") + F.col("ck").isNotNull().cast("int")).alias("attempt")))


def _over(text: Column, new: Column, kept: Column) -> Column:
    """text with its letters and digits, but for the first `kept` of them, replaced by those of new in turn; what is over comes after."""
    size = lambda x: F.length(F.regexp_replace(x, "[^A-Za-z0-9]", ""))
    one = lambda c, i: F.when(c.rlike("[A-Za-z0-9]"), let(size(F.substring(text, F.lit(1), i + 1)) - kept, lambda k: F.when(k > 0, F.substring(new, k, F.lit(1))).otherwise(c))).otherwise(c)
    laid = F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), one), "")
    return F.concat(laid, F.substring(new, size(text) - kept + 1, F.length(new)))


def written(unit: Column, made: Column) -> Column:
    """A unit's surrogate in the way the unit is written: with its separators, label, country code and capitals."""
    token, kind = unit["token"], unit["kind"]
    capital = F.concat(F.upper(F.substring(made, 1, 1)), F.substring(made, F.lit(2), F.length(made)))
    label = F.regexp_extract(token, rf"^({_LABEL}\s{{0,2}}[=:]\s{{0,2}}[\"']?)?.*$", 1)
    return (
        F.when(kind.isNull(), token)
        .when(kind.rlike("^(given|surname)"), F.when(token == F.upper(token), F.upper(made)).otherwise(capital))
        .when(kind == "secret", F.concat(label, made))
        .when(kind == "phone", _over(token, made, F.length(_digits(_country(token)))))
        .when(kind.isin("card", "iban"), _over(token, made, F.lit(0)))
        .otherwise(made)
    )


def surrogate_key(spark: SparkSession) -> str:
    """The key set as spark.banditframe.surrogateKey. It must be kept secret, or values can be tried; the default is for tests."""
    return spark.conf.get("spark.banditframe.surrogateKey", "surrogate-key")


def pseudonymize(docs: DataFrame, text_col: str = "text", key: str | None = None) -> DataFrame:
    """docs with every entity of text_col replaced, and n_entities.

    First surrogates are made where the text is read. Those that clashed, few as the first space is large, are looked up by a join on
    the text's hash; what a text needs of them is a map of its own entities."""
    key = surrogate_key(docs.sparkSession) if key is None else key
    docs = docs.drop("n_entities")
    found, mark = find(F.col(text_col)), F.xxhash64(text_col)
    holds = docs.select(mark.alias("mark"), F.explode(F.array_distinct(found)).alias("entity")).select("mark", F.explode(units(F.col("entity"))).alias("u"))
    holds = cut(holds.select("mark", "u.kind", "u.value").filter("kind is not null"))
    moved = cut(assignments(holds, key).filter("attempt > 0").select(F.col("kind").alias("k"), F.col("value").alias("v"), "surrogate"))
    per = holds.distinct().join(moved, (holds["kind"] == moved["k"]) & (holds["value"] == moved["v"])).groupBy(F.col("mark").alias("__mark"))
    per = cut(per.agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws(":", "kind", "value").alias("key"), F.col("surrogate").alias("value")))).alias("__moved")))
    rows = docs.join(per, mark == per["__mark"], "left").withColumn("__found", found)

    def stand_in(u: Column) -> Column:
        made = F.coalesce(F.try_element_at(F.col("__moved"), F.concat_ws(":", u["kind"], u["value"])), surrogate(u["kind"], u["value"], F.lit(0), key))
        return F.struct(u["token"].alias("token"), u["kind"].alias("kind"), let(made, lambda m: written(u, m)).alias("new"))

    rows = rows.withColumn("__new", F.transform("__found", lambda e: F.transform(units(e), stand_in)))
    names = F.array_distinct(F.filter(F.flatten("__new"), lambda u: F.coalesce(u["kind"].rlike("^(given|surname)") & (F.length(u["token"]) > 2), F.lit(False))))
    alone = lambda text, n: F.regexp_replace(text, F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), n["token"], F.lit(r"\E(?![\p{L}\p{N}])")), n["new"])
    between = F.split(F.col(text_col), ANY, -1)
    between = F.when(F.size("__names") > 0, F.transform(between, lambda x: F.aggregate("__names", x, alone))).otherwise(between)
    new = F.concat(F.transform("__new", lambda us: F.array_join(F.transform(us, lambda u: u["new"]), " ")), F.array(F.lit("")))
    whole = F.array_join(F.zip_with(between, new, lambda a, b: F.concat(a, b)), "")
    text = F.when(F.size("__found") > 0, whole).otherwise(F.col(text_col))
    rows = rows.withColumn("__names", names)
    return rows.select(*[text.alias(c) if c == text_col else F.col(c) for c in docs.columns], F.size("__found").alias("n_entities"))
