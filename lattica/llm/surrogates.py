"""PII (operator 3): keyed surrogates that keep type, gender, script and format. DataFrame functions only."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import store

# Words that introduce a person, and some given names, by gender.
MALE_TITLES = ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Don", "Κύριος", "MR", "HERR", "SEÑOR"]
FEMALE_TITLES = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Doña", "Κυρία", "MRS", "FRAU", "SEÑORA"]
OPEN_TITLES = ["Dr", "Prof"]
# Small words before a surname, and those that may follow them.
PARTICLES, ARTICLES = ["de", "del", "da", "do", "dos", "das", "di", "della", "du", "van", "von", "zu", "ter", "ten", "bin", "ibn", "al", "af"], ["la", "las", "los", "der", "den", "dem", "het"]
# Labels before a colon that announce a person.
LABELS = ["Name", "Author", "Contact", "Signed", "Kontakt", "Ansprechpartner", "Autor", "Auteur", "Nom", "Nombre", "Contacto", "Имя", "Автор", "Όνομα"]
MALE_NAMES = ["James", "John", "Robert", "Michael", "William", "David", "Richard", "Thomas", "Daniel", "Matthew", "Hans", "Peter", "Klaus", "Jürgen", "Pierre", "Jean", "Louis", "Carlos", "José", "Juan", "Miguel", "Иван", "Сергей", "Дмитрий", "Γιώργος", "Νίκος"]
FEMALE_NAMES = ["Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Susan", "Jessica", "Sarah", "Emma", "Anna", "Ursula", "Heike", "Sabine", "Marie", "Claire", "Sophie", "María", "Carmen", "Lucía", "Isabel", "Анна", "Мария", "Елена", "Ольга", "Ελένη", "Κατερίνα"]
# The syllables that surrogate names are made of, and endings by gender, for each script.
SYLLABLES = {"latin": ["ba", "be", "bo", "da", "de", "do", "fa", "fe", "ga", "go", "ha", "ja", "ka", "ke", "la", "le", "lo", "ma", "me", "mo", "na", "ne", "no", "pa", "pe", "ra", "re", "ro", "sa", "se", "ta", "to"], "cyrillic": ["ба", "бе", "бо", "да", "де", "до", "фа", "фе", "га", "го", "ха", "жа", "ка", "ке", "ла", "ле", "ло", "ма", "ме", "мо", "на", "не", "но", "па", "пе", "ра", "ре", "ро", "са", "се", "та", "то"], "greek": ["βα", "βε", "βο", "δα", "δε", "δο", "φα", "φε", "γα", "γο", "χα", "ζα", "κα", "κε", "λα", "λε", "λο", "μα", "με", "μο", "να", "νε", "νο", "πα", "πε", "ρα", "ρε", "ρο", "σα", "σε", "τα", "το"]}
ENDINGS = {"latin": {"m": ["n", "s", "rd", "lf"], "f": ["lia", "na", "ria", "tta"], "x": ["n", "s", "l", "r"], "surname": ["mann", "son", "ler", "ard"]}, "cyrillic": {"m": ["н", "р", "й", "м"], "f": ["ля", "на", "рия", "тта"], "x": ["н", "р", "л", "м"], "surname": ["нов", "рин", "ский", "лев"]}, "greek": {"m": ["ος", "ης", "ας", "ων"], "f": ["ία", "να", "λη", "ρα"], "x": ["ν", "ς", "ρ", "λ"], "surname": ["πουλος", "ίδης", "άκης", "ου"]}}

#: A name, with what follows a hyphen or an apostrophe but for a lone letter, as in Smith's; and initials between names.
NAME = r"\p{Lu}(?:\p{L}|['’](?=\p{L}{2}))++(?:-\p{Lu}(?:\p{L}|['’](?=\p{L}{2}))++){0,4}+"
INITIALS = r"(?:(?:\p{Lu}\.){1,3}[  ]){0,2}"
PARTICLE = rf"(?:(?:{'|'.join(PARTICLES)})[  ](?:(?:{'|'.join(ARTICLES)})[  ])?)?"
#: A further name of a person, and how many may follow.
MORE, MOST = rf"(?:[  ]{INITIALS}{PARTICLE}{NAME})", 3
TITLES = "|".join(MALE_TITLES + FEMALE_TITLES + OPEN_TITLES)
GIVEN = "|".join(MALE_NAMES + FEMALE_NAMES)
#: The letters that a title or a listed name begins with: a cheap test that comes first.
INITIAL = "[" + "".join(sorted({n[0] for n in MALE_TITLES + FEMALE_TITLES + OPEN_TITLES + MALE_NAMES + FEMALE_NAMES})) + "]"
PERSON = rf"(?={INITIAL})(?<![\p{{L}}\p{{N}}])(?:(?:{TITLES})\.?[  ](?:(?:{'|'.join(OPEN_TITLES)})\.?[  ]){{0,2}}{INITIALS}{PARTICLE}{NAME}{MORE}{{0,{MOST}}}|(?:{GIVEN}){MORE}{{1,{MOST}}})|(?=\p{{Lu}})(?<=(?:{'|'.join(LABELS)}): ){NAME}{MORE}{{1,{MOST}}}"
EMAIL = r"(?=[A-Za-z0-9._%+-])(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
KEY = r"(?=[A-Za-z0-9])(?<![A-Za-z0-9])(?=[A-Za-z_-]*+[0-9])(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+|AKIA[0-9A-Z]{16}|(?:sk|pk|ghp|xox[bp])[-_][A-Za-z0-9_-]{16,})(?![A-Za-z0-9])"
IP = r"(?=[0-9])(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)"
IPV6 = r"(?=[0-9A-Fa-f])(?<![\w:.])[0-9A-Fa-f]{4}(?:(?::[0-9A-Fa-f]{1,4}){7}+|(?::[0-9A-Fa-f]{1,4}){0,5}+::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5}+)?)(?![\w:])"
IBAN = r"(?=[A-Z])(?<![A-Za-z0-9])(?=[A-Z]{2}\d{2}(?:[A-Z ]*+\d){6})[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
BARE_SSN = r"\d{9}"
SSN = rf"(?=[0-9])(?:(?<![\w-])\d{{3}}-\d{{2}}-\d{{4}}|(?<=\b(?:SSN|ssn)[: ]{{1,2}}){BARE_SSN})(?![\w-])"
CARD = r"(?=[0-9])(?<![\w-])\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?![\w-])"
PHONE = r"(?=[0-9+(])(?<![\w+])(?:(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]?\d{3,4}(?![\w-])|\+\d{8,14}(?!\w))"
KINDS = {"email": EMAIL, "key": KEY, "iban": IBAN, "ip": IP, "ipv6": IPV6, "ssn": SSN, "card": CARD, "phone": PHONE, "person": PERSON}
ANY = "|".join(KINDS.values())
#: Cheaper than ANY, and one of them met by every text that ANY is found in. Each begins with a class of a few ranges.
HINTS = ["[@0-9]", rf"(?=[A-Z])(?:{TITLES}|{GIVEN})[.  ]", rf"(?=[А-ЯΑ-Ω])(?:{TITLES}|{GIVEN})[.  ]", rf"(?=[A-ZА-ЯΑ-Ω])(?:{'|'.join(LABELS)}): "]
ROUNDS = 40
#: The session setting that holds the key.
KEY_SETTING = "spark.lattica.surrogates.key"


def _hex(key: str, *parts: Column) -> Column:
    """A keyed digest: 64 hexadecimal digits."""
    inner = F.sha2(F.concat_ws("\x1f", F.lit(key), *parts), 256)
    return F.sha2(F.concat_ws("\x1f", F.lit(key), inner), 256)


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _pick(values: list[str], number: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), F.pmod(number, F.lit(len(values))).cast("int"))


def _number(digest: Column, at: int, width: int = 4) -> Column:
    return F.conv(F.substring(digest, at, width), 16, 10).cast("long")


def _same_shape(value: Column, stream: Column, letters: str = "abcdefghijklmnopqrstuvwxyz") -> Column:
    """Letters and digits replaced by letters (of the same case) and digits, character by character; the rest stays.

    stream is a column of hexadecimal digits: an expression would be computed again for each character.
    """

    def one(c: Column, i: Column) -> Column:
        n = F.conv(F.substring(stream, F.pmod(2 * i, F.lit(250)).cast("int") + 1, 2), 16, 10).cast("int")
        digit = F.substring(F.lit("0123456789"), F.pmod(n, F.lit(10)).cast("int") + 1, 1)
        small = F.substring(F.lit(letters), F.pmod(n, F.lit(len(letters))).cast("int") + 1, 1)
        return F.when(c.rlike("[0-9]"), digit).when(c.rlike("[a-z]"), small).when(c.rlike("[A-Z]"), F.upper(small)).otherwise(c)

    return F.array_join(F.transform(_chars(value), one), "")


def _luhn_digit(digits: Column) -> Column:
    """The check digit that follows digits."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, 1).cast("int") * F.when(F.pmod(n - i, F.lit(2)) == 0, 2).otherwise(1)
        return total + d - F.when(d > 9, 9).otherwise(0)

    return F.pmod(-F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add), F.lit(10)).cast("string")


def _modulo_97(text: Column) -> Column:
    """Digits and capitals, which stand for 10 to 35, as a number modulo 97."""

    def add(total: Column, c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), F.pmod(total * 10 + c.cast("int"), F.lit(97))).otherwise(F.pmod(total * 100 + F.ascii(c) - 55, F.lit(97)))

    return F.aggregate(_chars(text), F.lit(0), add)


def _drawn(entities: DataFrame, key: str) -> DataFrame:
    """entities (kind, canon, round) with the canonical ``surrogate`` of each in its round; every step is a column of its own, so that none is computed twice."""
    kind, canon, round_ = F.col("kind"), F.col("canon"), F.col("round")
    longer = lambda d: F.concat(d, F.sha2(d, 256), F.sha2(F.concat(d, F.lit("+")), 256), F.sha2(F.concat(d, F.lit("-")), 256))
    digest, stream, shaped, digits, body, host, host_stream = (F.col(c) for c in ("digest", "stream", "shaped", "digits", "body", "host", "host_stream"))
    out = entities.withColumns({"digest": _hex(key, kind, canon, round_.cast("string")), "host": F.when(kind == "email", F.regexp_extract(canon, r"@(.*)\.[^.]+$", 1))})
    out = out.withColumns({"stream": longer(digest), "host_stream": F.when(kind == "email", _hex(key, F.lit("host"), host))})
    out = out.withColumn("host_stream", longer(F.col("host_stream")))
    out = out.withColumns({"shaped": F.when(kind.isin("key", "ipv6"), _same_shape(canon, stream, "abcdef")).when(kind == "iban", _same_shape(F.substring(canon, F.lit(5), F.length(canon)), stream)).when(kind == "email", _same_shape(F.substring_index(canon, "@", 1), stream)).when(kind.isin("card", "phone", "ssn"), _same_shape(canon, stream)), "host": F.when(kind == "email", _same_shape(host, host_stream))})
    out = out.withColumn("digits", F.concat(F.substring(canon, 1, 1), F.substring(shaped, F.lit(2), F.length(canon))))
    out = out.withColumns({"body": F.substring(digits, F.lit(1), F.length(canon) - 1), "issued": F.substring(canon, F.lit(1), F.length(canon) - 1)})
    valid = _luhn_digit(F.col("issued")) == F.substring(canon, -1, 1)
    country = F.substring(canon, 1, 2)
    iban_valid = _modulo_97(F.concat(F.substring(canon, F.lit(5), F.length(canon)), F.substring(canon, 1, 4))) == 1
    iban_check = F.when(iban_valid, F.lpad((98 - _modulo_97(F.concat(shaped, country, F.lit("00")))).cast("string"), 2, "0")).otherwise(F.substring(canon, 3, 2))
    octets = F.concat_ws(".", (_number(digest, 1) % 223 + 1).cast("string"), *[(_number(digest, at) % 256).cast("string") for at in (9, 17, 25)])

    def name(script: str, ending: str) -> Column:
        """Syllables, one more every other round, and an ending."""
        syllables = F.transform(F.sequence(F.lit(0), 2 + F.floor(round_ / 2).cast("int")), lambda i: _pick(SYLLABLES[script], _number(stream, 8 * i + 1)))
        return F.concat(F.array_join(syllables, ""), _pick(ENDINGS[script][ending], _number(stream, 249)))

    cyrillic, greek = canon.rlike(r"\p{IsCyrillic}"), canon.rlike(r"\p{IsGreek}")
    value = F.when(kind == "email", F.concat(shaped, F.lit("@"), host, F.lit("."), F.substring_index(canon, ".", -1))).when(kind == "ip", octets).when(kind.isin("key", "ipv6", "ssn"), shaped).when(kind == "iban", F.concat(F.substring(canon, 1, 2), iban_check, shaped))
    value = value.when((kind == "card") & valid, F.concat(body, _luhn_digit(body)))
    for unit, ending in (("given_m", "m"), ("given_f", "f"), ("given_x", "x"), ("surname", "surname")):
        value = value.when(kind == unit, F.when(cyrillic, name("cyrillic", ending)).when(greek, name("greek", ending)).otherwise(name("latin", ending)))
    return out.select("kind", "canon", "round", value.otherwise(digits).alias("surrogate"))


def _kind(mention: Column) -> Column:
    return reduce(lambda w, k: w.when(mention.rlike(f"^(?:{KINDS[k]})$"), k), list(KINDS)[1:-1], F.when(mention.rlike(f"^(?:{EMAIL})$"), "email").when(mention.rlike(f"^{BARE_SSN}$"), "ssn")).otherwise("person")


def _units(mention: Column) -> Column:
    """The parts of a mention that are replaced or kept: structs of kind, canonical form and text."""
    unit = lambda kind, canon, text: F.struct(kind.alias("kind"), canon.alias("canon"), text.alias("text"))
    kind = _kind(mention)
    digits = F.regexp_replace(mention, "[^0-9]", "")
    canon = F.when(kind.isin("email", "ipv6"), F.lower(mention)).when(kind == "iban", F.regexp_replace(mention, " ", "")).when(kind.isin("card", "phone", "ssn"), digits).otherwise(mention)
    words = F.split(mention, "[  ]")
    undotted = lambda i: F.regexp_replace(F.coalesce(F.get(words, F.lit(i)), F.lit("")), r"\.$", "")
    titled = undotted(0).isin(MALE_TITLES + FEMALE_TITLES + OPEN_TITLES)
    open_title = lambda i: titled & undotted(i).isin(OPEN_TITLES)
    n_titles = F.when(open_title(1) & open_title(2), 3).when(open_title(1), 2).when(titled, 1).otherwise(0)
    gender = F.when(undotted(0).isin(MALE_TITLES), "m").when(undotted(0).isin(FEMALE_TITLES), "f")
    given = F.get(words, n_titles)
    gender = gender.when(given.isin(MALE_NAMES), "m").when(given.isin(FEMALE_NAMES), "f").otherwise("x")

    def part(word: Column, i: Column) -> Column:
        kept = (i < n_titles) | word.rlike(rf"^(?:(\p{{Lu}}\.)+|{'|'.join(PARTICLES + ARTICLES)})$")
        first = (i == n_titles) | word.isin(MALE_NAMES + FEMALE_NAMES)
        role = F.when(kept, "title").when(first & (i < F.size(words) - 1), F.concat(F.lit("given_"), gender)).otherwise("surname")
        return unit(role, F.lower(word), word)

    return F.when(kind == "person", F.transform(words, part)).otherwise(F.array(unit(kind, canon, mention)))


def _dressed(kind: Column, text: Column, surrogate: Column) -> Column:
    """A canonical surrogate in the format of the text it replaces: punctuation of numbers, case of names and of each letter of an address."""
    at = lambda i, kept: F.length(F.regexp_replace(F.substring(text, F.lit(1), i), f"[^{kept}]", ""))
    spaced = lambda kept: F.array_join(F.transform(_chars(text), lambda c, i: F.when(c.rlike(f"[{kept}]"), F.substring(surrogate, at(i + 1, kept), F.lit(1))).otherwise(c)), "")
    cased = F.when(text == F.upper(text), F.upper(surrogate)).when(F.substring(text, 1, 1) == F.upper(F.substring(text, 1, 1)), F.concat(F.upper(F.substring(surrogate, 1, 1)), F.substring(surrogate, F.lit(2), F.length(surrogate)))).otherwise(surrogate)
    letter = lambda i: F.substring(surrogate, i + 1, F.lit(1))
    mail = F.array_join(F.transform(_chars(text), lambda c, i: F.when(c.rlike("[A-Z]"), F.upper(letter(i))).otherwise(letter(i))), "")
    return F.when(kind.isin("card", "phone", "ssn"), spaced("0-9")).when(kind == "iban", spaced("A-Z0-9")).when(kind.isin("email", "ipv6"), mail).when(kind.isin("key", "ip"), surrogate).otherwise(cased)


def entity_surrogates(entities: DataFrame, key: str) -> DataFrame:
    """kind, canon and surrogate of each distinct entity.

    Two entities of a kind never share a surrogate, and no surrogate is itself an entity of that kind in the corpus: in
    each round an entity that meets a value taken in an earlier round, a real one, or one that a smaller canonical form
    drew in the same round, draws again; the others are settled. An error if some are left after ROUNDS rounds: the
    format of numbers as short as theirs has too few values for so many entities.
    """
    todo = store(entities.select("kind", "canon").distinct().withColumn("round", F.lit(0)), "entities")
    family = F.when(F.col("kind").startswith("given"), "given").otherwise(F.col("kind")).alias("family")
    taken = todo.select(family, F.col("canon").alias("surrogate")).distinct()
    settled = None
    for _ in range(ROUNDS):
        drawn = store(_drawn(todo, key).select("*", family), "drawn")
        first = drawn.groupBy("family", "surrogate").agg(F.min(F.struct("kind", "canon")).alias("keeps"))
        own = drawn.join(first, ["family", "surrogate"]).where(F.struct("kind", "canon") == F.col("keeps")).join(taken, ["family", "surrogate"], "left_anti")
        own = store(own.select("kind", "canon", "surrogate", "family"), "settled")
        settled = own if settled is None else settled.unionByName(own)
        todo = store(drawn.join(own, ["kind", "canon"], "left_anti").select("kind", "canon", (F.col("round") + 1).alias("round")), "redraw")
        if todo.isEmpty():
            return settled.drop("family")
        taken = taken.unionByName(own.select("family", "surrogate"))
    raise RuntimeError(f"surrogates still collide after {ROUNDS} rounds: the names or numbers of a kind are too few for so many entities")


def replace_entities(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: a struct column ``row`` (the input row), ``clean`` (the text with surrogates) and ``n_entities``.

    E-mail addresses, telephone numbers, payment cards and IBANs (valid check digits stay valid), social security
    numbers, IP addresses of both kinds, access keys and persons (titles or a listed given name, then a name; two names
    after a label as in "Author: "; in each case up to MOST further names that follow, with particles as in "van der",
    which stay) are found by patterns. The first name and listed ones are given names, the others surnames. An
    entity, in whatever format it is written, has one surrogate in the whole corpus, drawn with the key; a given
    name keeps its gender and script. A name alone, with a capital, is replaced too in a text that has it in a full
    mention (not counted in n_entities), and gets what it gets there; initials between names stay. Texts without an entity
    are neither joined nor shuffled. Null texts stay null; repeated rows and null ids are treated like any row.
    """
    text = F.col(f"row.`{text_col}`").cast("string")
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).withColumn("mentions", F.when(reduce(or_, [text.rlike(h) for h in HINTS]), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))))
    some = F.coalesce(F.size("mentions"), F.lit(0)) > 0
    met = store(base.where(some).withColumn("copy", F.md5(text)), "met")
    units = met.select("copy", F.explode(F.array_distinct("mentions")).alias("mention")).distinct().select("copy", "mention", F.posexplode(_units(F.col("mention"))).alias("at", "unit")).select("copy", "mention", "at", "unit.*")
    units = store(units, "units")
    surrogates = store(entity_surrogates(units.where("kind != 'title'"), key), "surrogates")
    known = units.join(surrogates, ["kind", "canon"], "left")
    part = F.when(F.col("surrogate").isNull(), F.col("text")).otherwise(_dressed(F.col("kind"), F.col("text"), F.col("surrogate")))
    parts = known.groupBy("copy", "mention").agg(F.array_sort(F.collect_list(F.struct("at", part.alias("text")))).alias("parts"))
    pairs = parts.select("copy", F.struct("mention", F.array_join(F.transform("parts", lambda p: p["text"]), " ").alias("by")).alias("pair"))
    maps = pairs.groupBy("copy").agg(F.map_from_entries(F.collect_list("pair")).alias("by"))
    # what else a text says of the persons it names: their names alone, a surname before a given name
    person = known.where("surrogate IS NOT NULL AND (kind = 'surname' OR kind LIKE 'given%')").groupBy("copy", "canon").agg(F.max(F.struct("kind", "surrogate")).alias("best"))
    names = person.groupBy("copy").agg(F.map_from_entries(F.collect_list(F.struct("canon", "best.surrogate"))).alias("names"))

    def bare(word: Column) -> Column:
        surrogate = F.element_at("names", F.lower(word))
        return F.when(word.rlike(r"^\p{Lu}") & surrogate.isNotNull(), _dressed(F.lit("surname"), word, surrogate)).otherwise(word)

    words = lambda gap: F.array_join(F.transform(F.regexp_extract_all(gap, F.lit(rf"{NAME}|[\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+"), F.lit(0)), bare), "")
    gaps = F.split(text, ANY, -1)
    gaps = F.when(F.col("names").isNull(), gaps).otherwise(F.transform(gaps, words))
    clean = F.array_join(F.flatten(F.zip_with(gaps, F.col("mentions"), lambda gap, m: F.array(gap, F.coalesce(F.element_at("by", m), F.lit(""))))), "")
    done = met.join(maps, "copy").join(names, "copy", "left").select("row", clean.alias("clean"), F.size("mentions").cast("long").alias("n_entities"))
    return done.unionByName(base.where(~some).select("row", text.alias("clean"), F.lit(0).cast("long").alias("n_entities")))


def op3_surrogates(spark, sf_dir: str) -> DataFrame:
    """Every document's text with surrogates in place of personal data, by the key in KEY_SETTING; one for tests if unset."""
    found = replace_entities(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.conf.get(KEY_SETTING, "a key for tests"))
    return found.select(F.col("row.doc_id").alias("doc_id"), F.col("clean").alias("text"), "n_entities")
