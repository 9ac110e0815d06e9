"""Surrogates for personal data. DataFrame operations only.

Detected entities get keyed replacements of their own type and format: digits for digits, letters of the
same case for letters, dates for dates of birth, valid octets in addresses, check digits where the
original has right ones (cards, IBANs), a leading zero of a national number, names with the same gender,
script and capitals. Every distinct entity of the corpus gets one surrogate, so mentions that mean the
same (a number with and without separators, an address in other case, a name in capitals, a given or
family name alone, with a title or, in a text that names the person in full or by title, without) still
agree; a distributed check gives entities whose surrogates coincide with each other or with anything that
really occurs another try, until all are distinct. Formats with few values (a short number, an address of
two letters) can run out of them: after some tries surrogates grow by a character a try. A secret of one
repeated mark (``********``) hides nothing and stays; other secrets of marks only get other marks.

Only texts with an entity are cut and put together again; all others pass unchanged and unshuffled.

Cases: a null text stays null and an empty one empty, both with no entities; very long texts are handled
whole, in time that grows with their length, as are values of very many parts; repeated rows get equal
texts; a value that occurs in a large share of the rows is one row of the table of surrogates and is
joined without a hot partition; an empty table gives an empty result; all other columns pass through
(``n_entities`` and ``entities`` replace columns of these names).
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import join_skewed, materialize

# Titles and given names by gender and script, and parts of invented names.
TITLES_F = ["Mrs", "Ms", "Miss", "Madame", "Mme", "Mlle", "Frau", "Señora", "Sra", "Doña", "госпожа"]
TITLES_M = ["Mr", "Mister", "Sir", "Monsieur", "Herr", "Señor", "Don", "господин"]
TITLES_N = ["Dr", "Prof", "доктор"]
GIVEN_F = "Mary Anna Maria Elizabeth Susan Karen Laura Julia Emma Olivia Sophie Claire Camille Chantal Ingrid Heike Ursula Petra Carmen Lucía Pilar Isabel Мария Анна Елена Ольга Наталья Ирина Татьяна Екатерина".split()
GIVEN_M = "James John Robert Michael William David Richard Thomas Daniel Peter Paul Pierre Jacques Philippe Hans Klaus Jürgen Wolfgang José Carlos Miguel Javier Иван Алексей Дмитрий Сергей Николай Андрей Михаил Павел".split()
SYLLABLES = {"latin": "ba be bi bo da de di do fa fe fi ga go ka ke ki ko la le li lo ma me mi mo na ne ni no pa pe ra re ri ro sa se si so ta te ti to va ve vi vo".split(), "cyrillic": "ба бе би бо да де ди до за зе зи ка ке ки ко ла ле ли ло ма ме ми мо на не ни но па пе ра ре ри ро са се си со та те ти то ва ве ви во".split()}
ENDINGS = {("latin", "f"): ["na", "ra", "lia", "ria"], ("latin", "m"): ["ner", "ron", "las", "dor"], ("latin", "n"): ["man", "son", "berg", "mont"], ("cyrillic", "f"): ["на", "ра", "лия", "рия"], ("cyrillic", "m"): ["мир", "лав", "дор", "ран"], ("cyrillic", "n"): ["енко", "чук", "ян", "их"]}

#: A family or given name: capitalised or all in capitals, with an apostrophe, an inner capital or a hyphen.
_NAME = r"(?:\p{Lu}['’])?\p{Lu}\p{Ll}++(?:\p{Lu}\p{Ll}++)?(?:-\p{Lu}\p{Ll}++)?"
_CAPS = r"(?:\p{Lu}['’])?\p{Lu}{2,}+(?:-\p{Lu}{2,}+)?"
#: Small words before a family name; they stay.
PARTICLES = "van von der den de del della di da dos du la le ten ter zu".split()
_FAMILY = "(?:(?:%s)[ ]){0,3}%s" % ("|".join(PARTICLES), _NAME)
_GIVEN = r"(?:\p{Lu}\p{Ll}++-)?(?:%s)(?:-\p{Lu}\p{Ll}++)?" % "|".join(GIVEN_F + GIVEN_M)
_TITLE = r"(?:%s)\.?" % "|".join(TITLES_F + TITLES_M + TITLES_N)
#: Each kind and its pattern, in order of preference. Each begins with a look at its first character, the cheapest
#: test. Repeated groups are possessive or bounded: others recurse once a repetition, and a long value ends the stack.
PATTERNS: list[tuple[str, str]] = [
    ("email", r"(?=[\p{L}\p{N}._%+-])(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)++"),
    ("secret", r"(?=[pPtTsSaA])(?i:(?<![a-z])(?:password|passwd|pwd|token|secret|api[_-]?key))[ ]?[=:][ ]?[\"']?[^\s\"']{6,}+"),
    ("key", r"(?=[A0-9a-s])(?<![\p{L}\p{N}])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9_-]{20,200}+|[0-9a-f]{32,128}+)(?![\p{L}\p{N}])"),
    ("ip", r"(?=\d)(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)"),
    ("ip6", r"(?=[0-9A-Fa-f])(?<![\p{L}\p{N}:])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[A-Fa-f:]{0,30}[0-9])(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\p{L}\p{N}:])"),
    ("iban", r"(?=[A-Z])(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){3,7}(?:[ ]?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])"),
    ("card", r"(?=\d)(?<![\d-])(?:\d{4}(?:[ -]?\d{4}){3}|3[47]\d{2}[ -]?\d{6}[ -]?\d{5})(?![\d-])"),
    ("ssn", r"(?=\d)(?<![\d-])(?:\d{3}-\d{2}-\d{4}|(?<!\d )\d{3} \d{2} \d{4}(?! \d))(?![\d-])"),
    ("birth", r"(?=[bBdDgGnN])(?<!\p{L})(?i:born(?: on)?|date of birth|dob|birthday|geboren(?: am)?|geburtsdatum|née? le|nacid[oa] el)[ ]?[:=]?[ ]?(?:\d{1,2}[./-]\d{1,2}[./-]\d{4}|\d{4}-\d{2}-\d{2})(?!\d)"),
    ("phone", r"(?=[\d+(])(?<![\p{L}\p{N}+])(?:0\d{2,4}[ ]\d{3,4}[ ]\d{3,4}|\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\)[ ]?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\p{L}\p{N}])"),
    ("name", r"(?=[\p{Lu}гд])(?<!\p{L}-)(?<![\p{L}\p{N}])(?:%s[ ](?:%s(?:[ ]%s)?|%s(?:[ ]%s)?)|%s[ ]%s|(?:%s)[ ]%s)(?!\p{L})" % (_TITLE, _NAME, _FAMILY, _CAPS, _CAPS, _GIVEN, _FAMILY, "|".join(GIVEN_F + GIVEN_M).upper(), _CAPS)),
]
#: A title, a given name and a family name.
_TITLED = "^%s (?:%s %s|%s %s)$" % (_TITLE, _NAME, _FAMILY, _CAPS, _CAPS)
ANY = "|".join(p for _, p in PATTERNS)
#: What any entity but a name holds; most texts are passed by this cheap test.
TRIGGER = "[0-9@=:]|AKIA|ASIA|gh[pousr]_|sk-|[a-f]{32}"
_LETTERS, _CAPITALS, _HEX = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"
_MARKS = "!#$%&*+-./?@^_~"
#: A value of one mark, repeated.
MASK = r"^([^\p{L}\p{N}])\1*$"
#: Tries within the format of a value; each further one adds a character, :data:`MOST_ADDED` at most.
TRIES_IN_FORMAT, MOST_ADDED = 5, 40
#: What the pieces of entities are counted and joined by.
ENTITY = ["kind", "canonical"]


#: The session's setting that holds the key.
KEY_SETTING = "tessella.surrogates.key"


def session_key(spark: SparkSession) -> str:
    """The key that the session sets; where none is set, a random one that holds for this session only."""
    key = spark.conf.get(KEY_SETTING, None) or spark.sparkContext.getConf().get(KEY_SETTING)
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set(KEY_SETTING, key)
    return key


def has_entity(text: Column) -> Column:
    others = "|".join(p for kind, p in PATTERNS if kind != "name")
    return F.coalesce((text.rlike(TRIGGER) & text.rlike(others)) | text.rlike(dict(PATTERNS)["name"]), F.lit(False))


def _kind(mention: Column) -> Column:
    out = None
    for kind, pattern in PATTERNS:
        hit = mention.rlike(f"^(?:{pattern})$")
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.when(mention.rlike(f"^(?:{_NAME}|{_CAPS})$"), "name").otherwise("phone")  # a name alone


def _names(body: Column) -> Column:
    """The names in a text that follow a title or have a given name."""
    return F.filter(F.regexp_extract_all(body, F.lit(ANY), F.lit(0)), lambda m: m.rlike("^(?:%s)$" % dict(PATTERNS)["name"]))


def _lone_words(names: Column) -> Column:
    """The given and family names among them, which may stand alone elsewhere in the text."""
    words = F.flatten(F.transform(names, lambda m: F.filter(F.split(m, " "), lambda w, i: w.rlike(f"^(?:{_NAME}|{_CAPS})$") & ~((i == 0) & w.isin(TITLES_F + TITLES_M + TITLES_N)))))
    return F.array_distinct(words)


def entity_pattern(names: Column) -> Column:
    """The pattern of a text's entities: all kinds, and the names in it wherever they stand alone."""
    words = _lone_words(names)
    alone = F.concat(F.lit(ANY + r"|(?=[\p{Lu}])(?<![\p{L}\p{N}]|\p{L}-)(?:"), F.array_join(words, "|"), F.lit(r")(?![\p{L}\p{N}]|-\p{L})"))
    return F.when(F.size(words) > 0, alone).otherwise(F.lit(ANY))


def _given_by_title(names: Column) -> Column:
    """``(word, gender)`` of given names that stand between a title and a family name."""
    titled = F.filter(names, lambda m: m.rlike(_TITLED))
    return F.array_distinct(F.transform(titled, lambda m: F.struct(F.lower(F.split(m, " ")[1]).alias("word"), _gender(F.split(m, " ")[0]).alias("gender"))))


def _is_one_of(word: Column, words: list[str]) -> Column:
    return F.regexp_replace(word, r"\.$", "").isin(words)


def _gender(title: Column) -> Column:
    return F.when(_is_one_of(title, TITLES_F), "f").when(_is_one_of(title, TITLES_M), "m").otherwise("n")


def mention_pieces(mentions: DataFrame) -> DataFrame:
    """Pieces of each mention ``(hid, pos)``: text kept before it, kind, value, and the value's canonical form.

    A name falls into its title, given names with their gender and family names; all others are one piece.
    ``givens``: the text's given names that only a title gives away, with their gender.
    """
    kinds = mentions.withColumn("whole", _kind(F.col("mention")))
    split = kinds.withColumn("words", F.when(F.col("whole") == "name", F.split("mention", " ")).otherwise(F.array("mention")))
    rows = split.withColumn("title", _gender(F.element_at("words", 1))).select("hid", "pos", "whole", "title", "givens", F.size("words").alias("many"), F.posexplode("words").alias("at", "word"))
    script = F.when(F.col("word").rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")
    is_title = ((F.col("at") == 0) & (F.col("many") > 1) & _is_one_of(F.col("word"), TITLES_F + TITLES_M + TITLES_N)) | F.col("word").isin(PARTICLES)
    own = lambda names: F.exists(F.split(F.lower("word"), "-"), lambda w: w.isin([n.lower() for n in names]))
    by_title = F.get(F.filter("givens", lambda g: g["word"] == F.lower("word")), F.lit(0))["gender"]
    given = F.when(own(GIVEN_F), "f").when(own(GIVEN_M), "m").otherwise(by_title)
    name_kind = F.when(is_title, "title").when(given.isNotNull(), F.concat(F.lit("given-"), given, F.lit("-"), script)).otherwise(F.concat(F.lit("family-n-"), script))
    lead = F.when(F.col("whole") == "secret", F.regexp_extract("word", r"^(?i:[a-z_-]+)[ ]?[=:][ ]?[\"']?", 0)).when(F.col("whole") == "birth", F.regexp_extract("word", r"^\P{N}*", 0)).when(F.col("whole") == "phone", F.regexp_extract("word", r"^\+\d{1,3}[ .-]?", 0)).otherwise("")
    pieces = rows.withColumn("kind", F.when(F.col("whole") == "name", name_kind).otherwise(F.col("whole"))).withColumn("lead", lead)
    pieces = pieces.withColumn("value", F.substr("word", F.length("lead") + 1))
    canonical = F.when(F.col("kind").isin("phone", "card", "ssn"), F.regexp_replace("value", r"\D", "")).when(F.col("kind").isin("email", "ip6") | F.col("kind").rlike("^(?:given|family)-"), F.lower("value")).when(F.col("kind") == "iban", F.regexp_replace("value", " ", "")).otherwise(F.col("value"))
    return pieces.withColumn("canonical", canonical).select("hid", "pos", "at", "lead", "kind", "value", "canonical")


def _draws(seed: Column) -> Column:
    """A number from 0 to 65535 for each character of the canonical form, and 64 more."""
    blocks = F.sequence(F.lit(0), (F.length("canonical") / 32).cast("int") + 2)
    digits = F.transform(blocks, lambda j: F.sha2(F.concat(seed, j.cast("string")), 512))
    return F.flatten(F.transform(digits, lambda d: F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.conv(F.substr(d, i * 4 + 1, F.lit(4)), 16, 10).cast("int"))))


def with_draws(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` with what the replacement reads at every character, each computed once a row.

    The generator keeps the formulas from being put in place of their names within the loops over characters.
    """
    canonical = F.col("canonical")
    seed = F.sha2(F.concat_ws("\x1f", F.lit(key), "kind", "canonical", F.col("attempt").cast("string")), 256)
    kept = F.when(canonical.rlike("^(?:AKIA|ASIA|gh[pousr]_)"), 4).when(canonical.rlike("^sk-"), 3).otherwise(0)
    seeded = rows.select("*", F.explode(F.array(F.struct(seed.alias("seed"), canonical.rlike("^[0-9a-f]+$").alias("hexadecimal"), kept.alias("kept")))).alias("of"))
    return seeded.select(*rows.columns, "of", F.explode(F.array(_draws(F.col("of.seed")))).alias("draws"))


def _draw(at: Column) -> Column:
    """A number from 0 to 65535 for a place."""
    return F.get("draws", at)


def _pick(letters: str, at: Column) -> Column:
    return F.substr(F.lit(letters), F.pmod(_draw(at), F.lit(len(letters))) + 1, F.lit(1))


def _chars(value: Column, keep: Column | None = None, hexadecimal: Column | None = None, zero: bool = False) -> Column:
    """``value`` with each digit and letter replaced by one of its class; places below ``keep`` stay.

    A number begins with no zero; ``zero``: but with the one it has in the original.
    """
    chars = F.split(value, "")
    pairs = F.arrays_zip(chars.alias("own"), F.slice(F.concat(F.array(F.lit("")), chars), 1, F.size(chars)).alias("before"))

    def one(pair: Column, i: Column) -> Column:
        ch = pair["own"]
        first = ~pair["before"].rlike("[0-9]")
        digit = F.when(first, F.substr(F.lit("123456789"), F.pmod(_draw(i), F.lit(9)) + 1, F.lit(1))).otherwise(_pick("0123456789", i))
        out = F.when(ch.rlike(r"^\p{N}$"), F.when(first & (ch == "0"), ch).otherwise(digit) if zero else digit)
        out = out.when(ch.rlike(r"^\p{Ll}$"), _pick(_LETTERS, i)).when(ch.rlike(r"^\p{L}$"), _pick(_CAPITALS, i)).otherwise(ch)
        if hexadecimal is not None:
            out = F.when(hexadecimal & ch.rlike("^[0-9a-f]$"), _pick(_HEX, i)).otherwise(out)
        return out if keep is None else F.when(i < keep, ch).otherwise(out)

    return F.array_join(F.transform(pairs, one), "")


def _marks(value: Column) -> Column:
    """``value`` with each character replaced by a mark."""
    return F.array_join(F.transform(F.split(value, ""), lambda ch, i: _pick(_MARKS, i)), "")


def _added(letters: str) -> Column:
    """The characters by which a surrogate outgrows its format; empty for the first tries."""
    many = F.least(F.col("attempt") - TRIES_IN_FORMAT, F.lit(MOST_ADDED))
    places = F.when(many > 0, F.sequence(F.lit(1), F.greatest(many, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.array_join(F.transform(places, lambda j: _pick(letters, F.length("canonical") + j)), "")


def is_mask() -> Column:
    return (F.col("kind") == "secret") & F.col("canonical").rlike(MASK)


def _luhn_sum(digits: Column, others: Column) -> Column:
    """Luhn sum of ``digits``; ``others``: 1 doubles every other digit from the last but one, 0 from the last."""
    values = F.transform(F.reverse(F.split(digits, "")), lambda c, i: F.when(i % 2 == others, F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), c.cast("int") + 1)).otherwise(c.cast("int")))
    return F.aggregate(values, F.lit(0), lambda a, b: a + b)


def _card() -> Column:
    """Digits of the same length; valid by its check digit if the original is."""
    drawn = _chars(F.col("canonical"))
    body = F.substr(drawn, F.lit(1), F.length("canonical") - 1)
    check = F.pmod(10 - F.pmod(_luhn_sum(body, F.lit(0)), F.lit(10)), F.lit(10))
    return F.when(F.pmod(_luhn_sum(F.col("canonical"), F.lit(1)), F.lit(10)) == 0, F.concat(body, check.cast("string"))).otherwise(drawn)


def _remainder(text: Column) -> Column:
    """Remainder by 97 of digits and of capitals, which count as 10 to 35."""
    value = lambda ch: F.when(ch.rlike("^[0-9]$"), ch.cast("int")).otherwise(F.ascii(ch) - 55)
    return F.aggregate(F.split(text, ""), F.lit(0), lambda a, ch: F.pmod(a * F.when(ch.rlike("^[0-9]$"), 10).otherwise(100) + value(ch), F.lit(97)))


def _iban() -> Column:
    """The country stays; check digits are right where the original's are."""
    c = F.col("canonical")
    drawn = _chars(c, keep=F.lit(2))
    country, body = F.substr(c, F.lit(1), F.lit(2)), F.substr(drawn, F.lit(5), F.length("canonical"))
    valid = _remainder(F.concat(F.substr(c, F.lit(5), F.length("canonical")), F.substr(c, F.lit(1), F.lit(4)))) == 1
    check = F.lpad((98 - _remainder(F.concat(body, country, F.lit("00")))).cast("string"), 2, "0")
    return F.when(valid, F.concat(country, check, body)).otherwise(drawn)


def _email() -> Column:
    """The last label of the domain stays."""
    last = F.substring_index("canonical", ".", -1)
    return F.concat(_added(_LETTERS), _chars(F.substr("canonical", F.lit(1), F.length("canonical") - F.length(last))), last)


def _ip() -> Column:
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (F.pmod(_draw(i), F.lit(254)) + 1).cast("string")), ".")


def _name(script: str, gender: str) -> Column:
    """Two or three syllables and an ending of the gender."""
    parts = SYLLABLES[script]
    syllable = lambda i: F.element_at(F.array(*map(F.lit, parts)), F.pmod(_draw(i), F.lit(len(parts))) + 1)
    endings = ENDINGS[script, gender]
    ending = F.element_at(F.array(*map(F.lit, endings)), F.pmod(_draw(F.lit(9)), F.lit(len(endings))) + 1)
    more = F.transform(F.sequence(F.lit(0), 1 + F.least(F.col("attempt"), F.lit(4)) + F.pmod(_draw(F.lit(12)), F.lit(2))), syllable)
    return F.initcap(F.concat(F.array_join(more, ""), ending))


def _birth() -> Column:
    """A date in the same form; where dates run short the year grows by digits."""
    c = F.col("canonical")
    day, month = 1 + F.pmod(_draw(F.lit(0)), F.lit(28)), 1 + F.pmod(_draw(F.lit(4)), F.lit(12))
    year = F.concat((1930 + F.pmod(_draw(F.lit(8)), F.lit(75))).cast("string"), _added("0123456789"))
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    iso, mark = c.rlike(r"^\d{4}-"), F.regexp_extract(c, r"^\d+(\D)", 1)
    return F.when(iso, F.concat_ws("-", year, two(month), two(day))).otherwise(F.concat(two(day), mark, two(month), mark, year))


def surrogate() -> Column:
    """The replacement of a row's ``canonical`` at its ``attempt``, from what :func:`with_draws` adds."""
    hexadecimal, c = F.col("of.hexadecimal"), F.col("canonical")
    out = F.when(F.col("kind") == "email", _email()).when(F.col("kind") == "ip", _ip()).when(F.col("kind") == "card", _card())
    out = out.when(F.col("kind") == "iban", _iban()).when(F.col("kind") == "key", _chars(c, keep=F.col("of.kept"), hexadecimal=hexadecimal))
    out = out.when(is_mask(), c).when((F.col("kind") == "secret") & ~c.rlike(r"[\p{L}\p{N}]"), F.concat(_marks(c), _added(_MARKS)))
    secret = F.concat(_chars(c, hexadecimal=hexadecimal), F.when(hexadecimal, _added(_HEX)).otherwise(_added(_LETTERS)))
    out = out.when(F.col("kind") == "secret", secret).when(F.col("kind") == "ip6", _chars(c, hexadecimal=F.lit(True)))
    out = out.when(F.col("kind") == "birth", _birth()).when(F.col("kind") == "phone", F.concat(_chars(c, zero=True), _added("0123456789")))
    for script in SYLLABLES:
        for gender in "fmn":
            out = out.when(F.col("kind").isin(f"given-{gender}-{script}", f"family-{gender}-{script}"), _name(script, gender))
    return out.otherwise(_chars(F.col("canonical")))


def assign_surrogates(entities: DataFrame, key: str) -> DataFrame:
    """``entities(kind, canonical, ...)``, one row each, with ``surrogate``: distinct, and unlike all that occurs.

    Each round finds the surrogates held more than once, of which the least entity keeps its own, and
    those that occur as entities; only these rows try again. Masks keep their value.
    """
    known = entities.select(F.lower("canonical").alias("taken")).distinct()
    rows = entities.withColumn("attempt", F.lit(0))
    while True:
        drawn = materialize(with_draws(rows, key).select(*rows.columns, surrogate().alias("surrogate")), "pii-surrogates")
        taken = F.lower("surrogate")
        first = drawn.filter(~is_mask()).groupBy(taken.alias("taken")).agg(F.min(F.struct(*ENTITY)).alias("first"), F.count("*").alias("n"))
        bad = first.filter("n > 1").select("taken", "first").unionByName(first.join(known, "taken", "left_semi").select("taken", F.lit(None).cast(first.schema["first"].dataType).alias("first")))
        bad = materialize(bad.groupBy("taken").agg(F.min("first").alias("first"), F.count("first").alias("firsts"), F.count("*").alias("n")), "pii-collisions")
        if not bad.head(1):
            return drawn
        joined = drawn.withColumn("taken", taken).join(bad, "taken", "left")
        again = F.col("n").isNotNull() & ((F.col("firsts") < F.col("n")) | (F.struct(*ENTITY) != F.col("first")))
        rows = joined.withColumn("attempt", F.col("attempt") + again.cast("int")).select(*rows.columns)


def _rendered() -> Column:
    """The surrogate in the mention's own format."""
    chars = F.split("value", "")
    start = F.struct(F.lit(0).alias("i"), F.lit("").alias("out"))
    source = lambda skip: F.aggregate(chars, start, lambda a, ch: F.when(ch.rlike(skip), F.struct(a["i"].alias("i"), F.concat(a["out"], ch).alias("out"))).otherwise(F.struct((a["i"] + 1).alias("i"), F.concat(a["out"], F.substr("surrogate", a["i"] + 1, F.lit(1))).alias("out"))))["out"]
    places = F.length(F.regexp_replace("value", "[^0-9]", ""))
    number = F.concat(source("[^0-9]"), F.substr("surrogate", places + 1, F.length("surrogate")))  # what outgrew the format comes last
    shouted = (F.col("value") == F.upper("value")) & (F.col("kind").isin("email", "ip6") | F.col("kind").rlike("^(?:given|family)-"))
    return F.when(F.col("kind") == "title", F.col("value")).when(F.col("kind").isin("phone", "card", "ssn"), number).when(F.col("kind") == "iban", source(" ")).when(shouted, F.upper("surrogate")).otherwise(F.col("surrogate"))


def replace_pii(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with all its columns, surrogates in the text, ``n_entities`` and ``entities`` (mentions by kind, as JSON text)."""
    names = [c for c in docs.columns if c not in ("n_entities", "entities")]
    rows = docs.select(*(f"`{n}`" for n in names))
    body = F.col(f"`{text}`")
    clean = rows.filter(~has_entity(body)).withColumns({"n_entities": F.lit(0).cast("long"), "entities": F.lit("{}")})
    others = [n for n in names if n != text]
    own = F.struct(*(F.col(f"`{n}`") for n in others)) if others else F.struct(F.lit(0).alias("none"))
    hits = rows.filter(has_entity(body)).select(own.alias("row"), body.alias("body"), F.explode(F.array(_names(body))).alias("names"))
    hits = hits.select("row", "body", F.explode(F.array(F.struct(entity_pattern(F.col("names")).alias("pattern"), _given_by_title(F.col("names")).alias("givens")))).alias("by")).select("row", "body", "by.pattern", "by.givens")
    hits = hits.select("row", "givens", F.split("body", F.col("pattern"), -1).alias("plain"), F.regexp_extract_all("body", F.col("pattern"), F.lit(0)).alias("mentions"))
    hits = materialize(hits.withColumn("hid", F.monotonically_increasing_id()), "pii-hits")
    pieces = materialize(mention_pieces(hits.select("hid", "givens", F.posexplode("mentions").alias("pos", "mention"))), "pii-mentions")
    entities = pieces.filter("kind <> 'title'").groupBy(*ENTITY).agg(F.count("*").alias("mentions"))
    assigned = assign_surrogates(materialize(entities, "pii-entities"), key)
    named = assigned.select(F.struct(*ENTITY).alias("entity"), "mentions", "surrogate")
    replaced = join_skewed(pieces.filter("kind <> 'title'").withColumn("entity", F.struct(*ENTITY)), named, "entity", "mentions").drop("entity", "mentions")
    titles = pieces.filter("kind = 'title'").withColumn("surrogate", F.col("value"))
    words = replaced.unionByName(titles.select(*replaced.columns)).withColumn("new", F.concat("lead", _rendered()))
    mentions = words.groupBy("hid", "pos").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "new"))), lambda x: x["new"]), " ").alias("new"), F.max_by(F.substring_index("kind", "-", 1), "at").alias("kind"))
    texts = mentions.groupBy("hid").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "new"))), lambda x: x["new"]).alias("news"), F.collect_list(F.when(F.col("kind").isin("given", "family", "title"), "name").otherwise(F.col("kind"))).alias("kinds"))
    joined = hits.join(texts.hint("merge"), "hid")
    new_text = F.array_join(F.transform("plain", lambda p, i: F.concat(p, F.coalesce(F.get("news", i), F.lit("")))), "")
    kinds = F.array_sort(F.array_distinct("kinds"))
    counted = F.to_json(F.map_from_arrays(kinds, F.transform(kinds, lambda k: F.size(F.filter("kinds", lambda x: x == k)))))
    done = joined.select("row", F.struct(new_text.alias("text"), F.size("kinds").cast("long").alias("n_entities"), counted.alias("entities")).alias("done"))
    dirty = done.select(*(F.col("done.text").alias(n) if n == text else F.col(f"row.`{n}`") for n in names), "done.n_entities", "done.entities")
    return clean.unionByName(dirty)
