"""Surrogates for personal data, in DataFrame functions only.

Detected entities (mail and IP addresses, phone, card, bank and social security numbers, personal names) are replaced by values of
the same kind and format. A surrogate is a function of a secret key and the entity's canonical form (case and
separators taken out), so an entity has one surrogate in the whole corpus, and every detected mention of it gets that surrogate in its own
case and separators. Listed given names keep their gender and script: each list of names is put into a ring by keyed hashes
and a name is replaced by the next one. All other surrogates are checked: where two entities meet in one
surrogate, or a surrogate equals a detected entity, all but one try again with the next number until none meet.

Names are found in two passes. ``PERSON`` finds whole names: after a title; a listed given name (also in capitals) before a capitalised word;
and two or three capitalised words that stand in a list of such names, or beside a word that goes with people (``AFTER``, ``BEFORE``). Initials and
particles may stand between the words. Then every capitalised word of the same text that equals a word of such a name, in any
case, is replaced, so that later mentions by one name keep pointing at the same person. Parts of names with hyphens or apostrophes are words of their own.
Not seen: a name in lower case, a single name without a title, and two unlisted words with nothing beside them that tells a person. Initials
and particles stay. A listed word that is also a common one (``STOP``) is never a name.

Defined cases: a null text stays null, an empty one empty. Equal entities have equal surrogates in all rows. Rows equal in
doc_id and text get equal results. Other columns pass through unchanged (n_chars follows the text). An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentinel.functions.storage import cut_lineage
from sentinel.llm.common import row_key, unpacked, whole_row

# Given names by gender and script, titles before names, and syllables of surnames by script.
GIVEN = {
    ("f", "latin"): ("Anna", "Maria", "Laura", "Sophie", "Emma", "Julia", "Clara", "Elena", "Sarah", "Marie", "Alice", "Lucia", "Mary", "Linda", "Susan", "Karen"),
    ("m", "latin"): ("John", "James", "Robert", "Michael", "David", "Thomas", "Peter", "Hans", "Klaus", "Pierre", "Jean", "Carlos", "Miguel", "Paul", "Daniel", "William"),
    ("f", "cyrillic"): ("Анна", "Мария", "Елена", "Ольга", "Наталья", "Ирина", "Татьяна", "Светлана"),
    ("m", "cyrillic"): ("Иван", "Сергей", "Алексей", "Дмитрий", "Николай", "Андрей", "Михаил", "Павел"),
    ("f", "greek"): ("Μαρία", "Ελένη", "Αικατερίνη", "Σοφία", "Άννα", "Ειρήνη"),
    ("m", "greek"): ("Γιώργος", "Δημήτρης", "Νίκος", "Κώστας", "Παναγιώτης", "Ιωάννης"),
}
TITLES = ("Mr", "Mrs", "Ms", "Miss", "Sir", "Dr", "Prof", "Doctor", "Professor", "Herr", "Herrn", "Frau", "Doktor", "Señor", "Señora", "Sr", "Sra", "Monsieur",
          "Madame", "Mme", "Mlle", "господин", "госпожа", "κύριος", "κυρία")
SYLLABLES = {
    "latin": (("Bar", "Cor", "Den", "Fal", "Gar", "Hol", "Kel", "Lan", "Mor", "Nor", "Pel", "Ros", "Sel", "Tor", "Val", "Wen"),
              ("a", "be", "di", "ga", "la", "me", "ni", "ra", "ri", "so", "ta", "ve", "wi", "lo", "ke", "mo"),
              ("berg", "dorf", "ford", "ham", "land", "ley", "man", "mont", "ner", "rez", "son", "ston", "ter", "ville", "wood", "worth")),
    "cyrillic": (("Бар", "Вол", "Гор", "Дан", "Жар", "Кал", "Лев", "Мар", "Ник", "Пет", "Рам", "Сол", "Тар", "Фед", "Чер", "Яр"),
                 ("а", "е", "и", "о", "ла", "на", "ра", "ти", "ми", "ни", "ри", "до", "ко", "ле", "ме", "ве"),
                 ("ков", "лев", "мин", "нин", "ров", "сов", "тин", "цев", "шин", "енко", "ский", "чук", "дзе", "ян", "ин", "ов")),
    "greek": (("Αλ", "Βασ", "Γερ", "Δημ", "Ζαφ", "Θεο", "Καρ", "Λαμ", "Μαν", "Νικ", "Παπ", "Ραλ", "Σταμ", "Τσαλ", "Φωτ", "Χρισ"),
              ("α", "ε", "ι", "ο", "λα", "να", "ρα", "τι", "μι", "νι", "ρι", "δο", "κο", "λε", "με", "βε"),
              ("κης", "δης", "πουλος", "ίδης", "άκης", "ακος", "ας", "ης", "ου", "έας", "τος", "λος", "νης", "ρος", "σης", "λας")),
}
SCRIPTS = {"cyrillic": r"\p{IsCyrillic}", "greek": r"\p{IsGreek}"}


def _any_of(words: Iterable[str]) -> str:
    """Alternatives grouped by their first letter, longest first, so that a matcher tries few of them at one place."""
    groups: dict[str, list[str]] = {}
    for w in sorted(words, key=len, reverse=True):
        groups.setdefault(w[0], []).append(w[1:])
    return "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in groups.items())


# Particles within names; words that end or begin no name; words that only people do or have done to them.
PARTICLES = ("von", "van", "der", "den", "de", "da", "di", "del", "la", "le", "bin", "al")
STOP = ("The", "This", "That", "These", "Those", "And", "But", "For", "From", "With", "When", "Where", "While", "What", "Who", "Why", "How", "Then", "There", "Here",
        "His", "Her", "Their", "Our", "Your", "My", "He", "She", "They", "We", "You", "It", "In", "On", "At", "By", "Of", "To", "As", "Is", "Are", "Was", "If", "Or",
        "Not", "No", "Yes", "Der", "Die", "Das", "Den", "Dem", "Des", "Ein", "Eine", "Und", "Aber", "Wenn", "Ich", "Wir", "Sie", "Er", "Es", "Ist", "Im", "Am", "Mit",
        "Le", "La", "Les", "Un", "Une", "Et", "Mais", "Il", "Elle", "Nous", "Vous", "Dans", "El", "Los", "Las", "Una", "Pero", "Que", "Del", "Su", "Para", "Por",
        "Later", "Yesterday", "Today", "Tomorrow", "Now", "Once", "Soon", "Finally", "Meanwhile", "However", "Perhaps", "Maybe", "Also", "Even", "Only", "Some", "Many",
        "All", "Every", "After", "Before", "Since", "Because", "So", "Dear", "Hello", "Please", "Gestern", "Heute", "Später", "Dann", "Auch", "Hier", "Hoy", "Ayer",
        "New", "North", "South", "East", "West", "United", "Saint", "San", "Great", "City", "River", "Street", "Road", "University", "Institute", "Company",
        "Foundation", "License", "Licence", "Public", "General", "Software", "Version", "President", "Minister", "Monday", "Tuesday", "Wednesday",
        "Thursday", "Friday", "Saturday", "Sunday", "January", "February", "March", "April", "June", "July", "August", "September", "October", "November", "December")
DETERMINERS = ("the", "a", "an", "this", "that", "our", "der", "die", "das", "den", "dem", "des", "ein", "eine", "le", "les", "un", "une", "el", "los", "las", "una")
AFTER = ("said", "says", "told", "asked", "called", "wrote", "spoke", "speaks", "lives", "lived", "replied", "answered", "married", "met", "smiled", "died", "was born",
         "sagte", "sagt", "fragte", "schrieb", "wohnt", "lebt", "antwortete", "traf", "starb", "dit", "habite", "demanda", "répondit", "écrivit",
         "dijo", "dice", "vive", "escribió", "preguntó", "respondió", "сказал", "сказала", "живёт", "ответил", "ответила")
BEFORE = ("met", "told", "asked", "called", "married", "named", "name is", "I am", "Dear", "traf", "fragte", "namens", "heißt", "Name ist", "rencontra",
          "nommé", "nommée", "appelle", "conoció", "llamado", "llamada", "llamo")
AND = ("and", "und", "et", "y", "и", "και")
_GIVEN_NAMES = [name for names in GIVEN.values() for name in names]


def _both_cases(words: Iterable[str]) -> list[str]:
    return sorted({form for w in words for form in (w, w.upper())})


_END = r"(?!\p{L})"
_NO_STOP = rf"(?!(?:{_any_of(_both_cases((*STOP, *TITLES)))}){_END})"
_NAME = rf"(?=\p{{Lu}}['’]?\p{{L}}){_NO_STOP}\p{{L}}++(?:['’-](?!s(?!\p{{L}}))\p{{L}}++)*+"
_CASED = rf"(?=\p{{Lu}}(?:['’]\p{{Lu}})?\p{{Ll}}){_NAME}"
_MIDDLE = rf"(?:\p{{Lu}}\. ?|(?:{_any_of(PARTICLES)}) ){{0,3}}+"
_TITLE = rf"(?:{_any_of(_both_cases(TITLES))})\.? "
_FULL = rf"{_CASED} {_MIDDLE}(?!(?:{_any_of(_GIVEN_NAMES)}){_END}){_CASED}(?: {_MIDDLE}{_CASED})?+"
_UNLISTED = rf"(?<!\p{{Lu}}\p{{L}}{{0,30}} )(?<!(?<!\p{{L}})(?:{_any_of(DETERMINERS)}) )(?!(\p{{L}}++) \1{_END})"
_TOGETHER = rf"(?:, | (?:{_any_of(AND)}) |, (?:{_any_of(AND)}) )"
PERSON = (rf"(?=\p{{Lu}}|[{''.join(sorted({w[0] for w in TITLES if w[0].islower()}))}])(?<![\p{{L}}0-9])(?:"
          rf"(?:{_TITLE})++{_MIDDLE}{_NAME}(?: {_MIDDLE}{_NAME}){{0,2}}+"
          rf"|(?:{_any_of(_both_cases(_GIVEN_NAMES))}){_END} {_MIDDLE}{_NAME}(?: {_MIDDLE}{_CASED})?+"
          rf"|{_UNLISTED}{_FULL}(?:(?:{_TOGETHER}{_FULL})++|(?= (?:{_any_of(AFTER)}){_END}|['’]s{_END}|, (?:born|aged|geboren){_END}))"
          rf"|{_UNLISTED}(?<=(?<!\p{{L}})(?:{_any_of(BEFORE)}) ){_FULL})")
# What counts as an entity, in order of preference at one position. An entity does not begin inside a word
# or number, which ``ANY`` checks once for all; every part is linear in the text.
PATTERNS = {
    "email": r"(?<![._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+(?<=\.[A-Za-z]{2,24})",
    "iban": r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![A-Za-z0-9])",
    "ssn": r"(?<!-)[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "card": r"(?<!\+)[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])",
    "phone": r"(?<!\+)(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ ]?|[0-9]{3}[ .-])[0-9]{3}[ .-]?[0-9]{4}(?![0-9A-Za-z])"
             r"|(?<!\+)\+[0-9]{1,3}(?:[ .-]?[0-9]){7,12}(?![0-9A-Za-z])",
    "ip": r"(?<!\.)(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?![0-9A-Za-z]|\.[0-9])",
}
ANY = r"(?=[A-Za-z0-9(+._%-])(?<![\p{L}0-9])(?:" + "|".join(f"(?:{p})" for p in PATTERNS.values()) + ")"
WORD = r"\p{Lu}\p{L}++"
# For texts with names: an entity, or else a capitalised word. No entity begins within a word, so both patterns see the same entities.
WIDE = ANY + rf"|(?<![\p{{L}}0-9]){WORD}"
# A cheap test that holds for every text with an entity: all kinds but names have a digit or an @, and a name goes on after a capitalised word or title.
_LOWER_TITLES = _any_of([w for w in TITLES if w[0].islower()])
MARKS = rf"[0-9@]|(?=\p{{L}})(?<!\p{{L}})(?:\p{{Lu}}[\p{{L}}'’-]*+|{_LOWER_TITLES})\.? (?:\p{{Lu}}|(?:{_any_of(PARTICLES)}) )"
MAX_ROUNDS = 40


def _kind(value: Column) -> Column:
    digits = F.length(F.regexp_replace(value, "[^0-9]", ""))
    return (F.when(value.contains("@"), "email").when(value.rlike(r"^[A-Z]{2}[0-9]{2}"), "iban").when(value.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
            .when(value.rlike(r"^[0-9]+(\.[0-9]+){3}$"), "ip").when(value.rlike(r"^[0-9][0-9 -]*$") & (digits >= 13), "card")
            .when(value.rlike("[0-9]"), "phone").when(F.lower(value).isin([n.lower() for n in _GIVEN_NAMES]), "given").otherwise("surname"))


def _canonical(value: Column, kind: Column) -> Column:
    return (F.when(kind == "email", F.lower(value)).when(kind.isin("card", "phone", "ssn"), F.regexp_replace(value, "[^0-9]", ""))
            .when(kind == "iban", F.replace(value, F.lit(" "), F.lit(""))).when(kind.isin("given", "surname"), F.lower(value)).otherwise(value))


def _script(value: Column) -> Column:
    out = F.lit("latin")
    for name, letters in SCRIPTS.items():
        out = F.when(value.rlike(letters), name).otherwise(out)
    return out


def _numbers(secret: str, *parts: Column) -> Column:
    """Function from a position (Column) to a keyed number from 0 to 65535 for these parts."""
    message = F.concat_ws("\u0001", F.lit(secret), *[p.cast("string") for p in parts])
    return lambda i: F.conv(F.substr(F.sha2(F.concat(message, F.lit("\u0001"), F.floor(i / 16).cast("string")), 256), (i % 16 * 4 + 1).cast("int"), F.lit(4)), 16, 10).cast("int")


def _mapped(text: Column, number, first: int | Column = 0) -> Column:
    """Digits become digits and letters letters of the same case, by keyed numbers; characters before ``first`` and all others stay."""
    def change(c: Column, i: Column) -> Column:
        n = number(i)
        new = (F.when(c.rlike("[0-9]"), (n % 10).cast("string")).when(c.rlike("[a-z]"), F.chr(97 + n % 26)).when(c.rlike("[A-Z]"), F.chr(65 + n % 26)).otherwise(c))
        return F.when(i < first, c).otherwise(new)
    return F.array_join(F.transform(F.split(text, ""), change), "")


def _luhn(digits: Column) -> Column:
    """Remainder of the Luhn sum of a string of digits."""
    def add(total: Column, x: Column) -> Column:
        return total + x
    values = F.transform(F.reverse(F.split(digits, "")), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
        (d.cast("int") * 2) - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(values, F.lit(0), add) % 10


def _proposal(secret: str) -> Column:
    """Surrogate of (kind, canonical, attempt) in canonical form."""
    kind, value, attempt = F.col("kind"), F.col("canonical"), F.col("attempt")
    number = _numbers(secret, kind, value, attempt)
    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    zone = F.regexp_replace(domain, r"\.[^.]*$", "")
    email = F.concat(_mapped(local, number), F.lit("@"), _mapped(zone, _numbers(secret, F.lit("domain"), domain, attempt)), F.lit(".example"))
    octets = F.split(value, r"\.")
    private = value.rlike(r"^(10\.|192\.168\.|127\.)")
    octet = lambda i: (number(F.lit(i)) % 254 + 1).cast("string")
    ip = F.concat_ws(".", F.when(private, octets[0]).otherwise((number(F.lit(0)) % 200 + 11).cast("string")),
                     F.when(value.startswith("192.168."), octets[1]).otherwise(octet(1)), octet(2), octet(3))
    body = F.left(_mapped(value, number, 1), F.length(value) - 1)
    check = F.pmod(F.lit(10) - _luhn(F.concat(body, F.lit("0"))), F.lit(10))
    off = F.when(_luhn(value) == 0, 0).otherwise(number(F.lit(40)) % 9 + 1)
    card = F.concat(body, ((check + off) % 10).cast("string"))
    def pick(words: tuple[str, ...], at) -> Column:
        return F.element_at(F.array(*map(F.lit, words)), number(at) % len(words) + 1)

    def surname(script: str) -> Column:
        head, middle, tail = SYLLABLES[script]
        more = F.transform(F.sequence(F.lit(0), F.floor(attempt / 4).cast("int")), lambda j: pick(middle, j + 5))
        return F.lower(F.concat(pick(head, F.lit(0)), F.array_join(more, ""), pick(tail, F.lit(1))))

    parts = surname("latin")
    for script in SCRIPTS:
        parts = F.when(_script(value) == script, surname(script)).otherwise(parts)
    return (F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", card).when(kind == "surname", parts)
            .when(kind == "iban", _mapped(value, number, 2)).otherwise(_mapped(value, number, F.when(F.length(value) > 10, F.length(value) - 10).otherwise(0))))


def rings(secret: str) -> dict[str, str]:
    """Each given name to the next one of its gender and script, in an order that the key decides."""
    out = {}
    for names in GIVEN.values():
        order = sorted(names, key=lambda n: hashlib.sha256(f"{secret}\u0001{n}".encode()).hexdigest())
        out.update(zip(order, order[1:] + order[:1]))
    return out


def entity_surrogates(entities: DataFrame, secret: str) -> DataFrame:
    """kind, canonical, surrogate for distinct entities; no two of a kind share a surrogate and none equals an entity."""
    known = cut_lineage(entities.select("kind", "canonical").distinct())
    table = cut_lineage(known.withColumn("attempt", F.lit(0)).withColumn("surrogate", _proposal(secret)))
    for _ in range(MAX_ROUNDS):
        best = table.groupBy("kind", "surrogate").agg(F.min(F.struct("attempt", "canonical")).alias("_best"), F.count(F.lit(1)).alias("_n"))
        taken = known.select(F.col("kind"), F.col("canonical").alias("surrogate"), F.lit(True).alias("_real"))
        met = best.join(taken, ["kind", "surrogate"], "left").where("_n > 1 OR _real")
        lose = table.join(met, ["kind", "surrogate"]).where("_real OR canonical <> _best.canonical").select("kind", "canonical", F.lit(True).alias("_again"))
        if lose.isEmpty():
            return table.select("kind", "canonical", "surrogate")
        moved = table.join(lose, ["kind", "canonical"], "left").withColumn("attempt", F.when(F.col("_again"), F.col("attempt") + 1).otherwise(F.col("attempt")))
        moved = moved.withColumn("surrogate", F.when(F.col("_again"), _proposal(secret)).otherwise(F.col("surrogate")))
        table = cut_lineage(moved.select("kind", "canonical", "attempt", "surrogate"))
    raise RuntimeError("surrogates still collide")


def _in_form(mention: Column, kind: Column, surrogate: Column) -> Column:
    """The canonical surrogate with the separators and the case of the mention."""
    spaced = F.array_join(F.transform(F.split(mention, ""), lambda c, i: F.when(c.rlike("[A-Z0-9]"), F.substr(
        surrogate, F.length(F.regexp_replace(F.left(mention, i), "[^A-Z0-9]", "")) + 1, F.lit(1))).otherwise(c)), "")
    # Local parts keep their length, so case is copied place by place; what follows is lower case.
    cased = F.array_join(F.transform(F.split(surrogate, ""), lambda c, i: F.when(F.substr(mention, i + 1, F.lit(1)).rlike("[A-Z]"), F.upper(c)).otherwise(c)), "")
    name = F.when((F.length(mention) > 1) & (F.upper(mention) == mention), F.upper(surrogate)).otherwise(F.initcap(surrogate))
    return (F.when(kind.isin("card", "phone", "ssn", "iban"), spaced).when(kind == "email", cased).when(kind == "surname", name).otherwise(surrogate))


def mention_table(mentions: DataFrame, secret: str) -> DataFrame:
    """mention, kind and replacement for every distinct mention."""
    kinds = cut_lineage(mentions.select("mention").distinct().withColumn("kind", _kind(F.col("mention"))).withColumn(
        "canonical", _canonical(F.col("mention"), F.col("kind"))))
    pairs = [F.lit(x) for name, other in rings(secret).items() for x in (name.lower(), other)]
    other, capitals = F.element_at(F.create_map(*pairs), F.col("canonical")), F.upper("mention") == F.col("mention")
    names = kinds.where("kind = 'given'").select("mention", "kind", F.when(capitals, F.upper(other)).otherwise(other).alias("replacement"))
    rest = kinds.where("kind <> 'given'")
    found = rest.join(entity_surrogates(rest, secret), ["kind", "canonical"])
    return names.union(found.select("mention", "kind", _in_form(F.col("mention"), F.col("kind"), F.col("surrogate")).alias("replacement")))


def name_words(text: Column) -> Column:
    """Distinct words, in lower case, of the whole names in a text."""
    words = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(PERSON), F.lit(0)), lambda span: F.regexp_extract_all(span, F.lit(WORD), F.lit(0))))
    no_names = [w.lower() for w in (*TITLES, *STOP)]
    return F.array_distinct(F.filter(F.transform(words, F.lower), lambda w: ~w.isin(no_names)))


def replace(docs: DataFrame, secret: str, salts: int = 16) -> DataFrame:
    """``docs`` with surrogates in the texts, and n_entities (in place of such a column of ``docs``). Only rows with entities are shuffled; a mention that very many rows hold is joined in parts."""
    may = F.coalesce(F.col("text").rlike(MARKS), F.lit(False))
    named = docs.where(may).select(row_key("doc_id", "text").alias("_key"), "text", name_words(F.col("text")).alias("_names"))
    wide = F.size("_names") > 0
    tokens = F.when(wide, F.regexp_extract_all("text", F.lit(WIDE), F.lit(0))).otherwise(F.regexp_extract_all("text", F.lit(ANY), F.lit(0)))
    found = named.select("_key", "_names", tokens.alias("_all")).groupBy("_key").agg(F.first("_names").alias("_names"), F.first("_all").alias("_all"))
    # Filtered after the grouping: before it, the optimizer would compute the patterns a second time for the filter.
    found = cut_lineage(found.where(F.size("_all") > 0))
    every = found.select("_key", (F.size("_names") > 0).alias("_wide"), F.posexplode("_all").alias("_at", "mention"))
    every = every.withColumn("_salt", F.pmod(F.xxhash64("_key"), F.lit(salts)).cast("int"))
    word = F.col("mention").rlike(rf"^{WORD}$")
    persons = found.select("_key", F.explode("_names").alias("_word"), F.lit(True).alias("_person"))
    words = every.where(word).withColumn("_word", F.lower("mention")).join(persons, ["_key", "_word"], "left").drop("_word")
    marked = cut_lineage(every.where(~word).withColumn("_person", F.lit(True)).unionByName(words))
    single = marked.where("_person").drop("_person")
    table = cut_lineage(mention_table(single, secret)).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    new = single.join(table, ["mention", "_salt"]).select("_key", "_wide", "_at", "replacement", F.lit(1).alias("_hit"))
    stay = marked.where("_person IS NULL").select("_key", "_wide", "_at", F.col("mention").alias("replacement"), F.lit(0).alias("_hit"))
    lists = new.unionByName(stay).groupBy("_key", "_wide").agg(
        F.array_sort(F.collect_list(F.struct("_at", "replacement"))).alias("_new"), F.sum("_hit").alias("_hits"))
    lists = lists.select("_key", "_wide", "_hits", F.transform("_new", lambda x: x["replacement"]).alias("_new"))
    columns = [c for c in docs.columns if c != "n_entities"]
    rest = docs.where(~may).select(*(f"`{c}`" for c in columns), F.lit(0).cast("long").alias("n_entities"))
    text, suspects = F.col("_doc.text"), docs.where(may).select(row_key("doc_id", "text").alias("_key"), whole_row(docs))
    pieces = F.when(F.col("_wide"), F.split(text, WIDE, -1)).otherwise(F.split(text, ANY, -1))
    new = F.concat(F.array_join(F.zip_with(F.slice(pieces, F.lit(1), F.size("_new")), "_new", lambda p, r: F.concat(p, r)), ""), F.element_at(pieces, -1))
    joined = suspects.join(lists, "_key", "left").select("_doc", "_new", "_hits", F.when(F.col("_new").isNull(), text).otherwise(new).alias("_text"))
    changed = {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("_new").isNull(), F.col("_doc.n_chars")).otherwise(F.length("_text").cast(docs.schema["n_chars"].dataType))
    found_in = F.coalesce("_hits", F.lit(0)).cast("long").alias("n_entities")
    return rest.unionByName(joined.select(*unpacked(joined, columns, changed), found_in))
