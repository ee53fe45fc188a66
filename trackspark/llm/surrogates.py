"""Personal data replaced by keyed surrogates, in DataFrame functions only.

Entities are found by one pattern. A mention is reduced to its type and a canonical value, so
that differently written mentions of one thing share a surrogate. The surrogate of a value
is drawn from a keyed digest: digits for digits, letters for letters of the same case, names
from names of the same gender and script, check digits valid where they were. Surrogates are
then checked over the whole corpus: two values of a type never share one, and none equals a
value that occurs. Losers draw again until all are distinct. Each mention is rendered from
its value's surrogate in its own writing and put in its place. A person is found by a title or
a given name of a list, with the capitalised words that follow; every word of the name has its
own surrogate, which also replaces the word where it stands alone in the same text. Persons
without a title or a listed given name anywhere in the text are not found.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackspark.llm.common import discard, settled

# Given names by gender and script, and titles by gender.
GIVEN = {
    ("f", "latin"): ["Alice", "Anna", "Carla", "Elena", "Emma", "Greta", "Helen", "Ingrid", "Julia", "Laura",
                     "Maria", "Nora", "Paula", "Sarah", "Sofia", "Teresa"],
    ("m", "latin"): ["Adam", "Anton", "Bruno", "Carlos", "David", "Felix", "Henry", "Jonas", "Karl", "Louis",
                     "Martin", "Oscar", "Peter", "Robert", "Thomas", "Victor"],
    ("f", "cyrillic"): ["Анна", "Вера", "Дарья", "Елена", "Ирина", "Мария", "Нина", "Ольга"],
    ("m", "cyrillic"): ["Антон", "Борис", "Виктор", "Дмитрий", "Иван", "Михаил", "Олег", "Павел"],
    ("f", "greek"): ["Άννα", "Ελένη", "Ειρήνη", "Μαρία", "Σοφία", "Χριστίνα"],
    ("m", "greek"): ["Αλέξανδρος", "Γιώργος", "Δημήτρης", "Κώστας", "Νίκος", "Πέτρος"],
}
# Further names by which persons are recognised.
KNOWN = {
    ("f", "latin"): """Abigail Ada Adele Agnes Aisha Alexandra Alicia Alina Alison Amanda Amelia Amy Ana Andrea Angela Anita Anja
        Ann Anne Annette Annie Antonia Ashley Astrid Audrey Barbara Beatrice Beatriz Bella Bernadette Beth Betty Bianca Birgit
        Bridget Brigitte Camila Camille Carmen Carol Caroline Catherine Cecilia Chantal Charlotte Chiara Chloe Christina
        Christine Claire Clara Claudia Colette Cynthia Daniela Danielle Deborah Denise Diana Diane Dolores Donna Doris Dorothy
        Edith Eleanor Elisabeth Elise Elizabeth Ella Ellen Elsa Emilia Emily Erika Esther Eva Evelyn Fatima Fiona Franziska
        Frances Francesca Frida Gabriela Gabriele Gertrud Gina Giulia Gloria Hanna Hannah Harriet Heather Heidi Heike Helena
        Helga Hilda Ida Ilse Ines Irene Irina Iris Isabel Isabella Jacqueline Jana Jane Janet Janice Jean Jennifer Jessica Joan
        Joanna Josephine Joyce Juana Judith Judy Julie Karen Karin Katarina Kate Katharina Katherine Kathleen Katie Katrin
        Kelly Kimberly Kirsten Lara Lea Leila Lena Leonie Lily Linda Lisa Lois Lorena Louise Lucia Lucy Luisa Lydia Magdalena
        Margaret Margarita Margot Maria Marie Marina Marion Marlene Marta Martha Martina Mary Mathilde Megan Melanie Melissa
        Mia Michelle Mila Monica Monika Nadia Nancy Natalia Natalie Natasha Nicole Nina Olga Olivia Pamela Patricia Petra
        Pilar Priya Rachel Rebecca Regina Renate Rita Rosa Rosemary Ruth Sabine Samantha Sandra Sara Sharon Shirley Silvia
        Simone Sonia Sophia Sophie Stefanie Stella Stephanie Susan Susanne Sylvia Tamara Tanja Tanya Tatiana Theresa Tina Ursula
        Valentina Valerie Vanessa Vera Veronica Vivian Wendy Xiulan Yolanda Yvonne Zoe""",
    ("m", "latin"): """Aaron Abdul Abraham Adrian Ahmed Alan Albert Alberto Alejandro Alessandro Alex Alexander Alfred Ali Allan
        Alvaro Andre Andreas Andrew Andy Angelo Anthony Antoine Antonio Arnold Arthur Arturo Axel Barry Bastian Ben Benjamin
        Bernard Bernd Bernhard Bill Bjorn Bob Brandon Brian Bruce Bryan Carl Charles Charlie Chris Christian Christoph
        Christopher Claude Claus Colin Craig Curtis Dan Daniel Danny Dave Dennis Derek Detlef Diego Dieter Dietrich Dirk
        Dmitri Dominik Donald Douglas Eberhard Eduardo Edward Edwin Emil Enrique Eric Erich Erik Ernest Ernst Ethan Eugene
        Fabian Federico Ferdinand Fernando Florian Francesco Francis Francisco Franz Fred Frederick Friedrich Fritz Gabriel
        Gareth Gary Geoffrey Georg George Gerald Gerard Gerhard Giorgio Giovanni Giuseppe Gordon Graham Greg Gregory
        Guillaume Gunther Gustav Guy Hans Harald Harold Harry Hassan Heinrich Heinz Helmut Herbert Hermann Horst Howard Hugo Ian
        Ibrahim Isaac Ivan Jack Jacob Jacques Jaime Jakob James Jan Jason Javier Jeff Jeffrey Jens Jeremy Jerome Jerry Jesse Jim
        Jimmy Joachim Joe Joel Johan Johann Johannes John Johnny Jonathan Jorge Jose Josef Joseph Joshua Juan Julian Julien
        Jurgen Justin Kai Keith Ken Kenneth Kevin Klaus Konrad Kurt Larry Lars Laurent Lawrence Leo Leon Leonard Leonardo Lorenzo
        Luca Lucas Ludwig Luigi Luis Lukas Luke Magnus Manfred Manuel Marc Marcel Marco Marcus Mario Mark Markus Mathias Matt
        Matteo Matthew Matthias Max Maximilian Michael Michel Miguel Mike Mohamed Mohammed Moritz Muhammad Nathan Neil Nicholas
        Nick Nicolas Nigel Nikolai Nils Noah Norbert Norman Olaf Oliver Olivier Omar Otto Pablo Paolo Pascal Patrick Paul Pedro
        Philip Philipp Pierre Rafael Ralf Ralph Ramon Raymond Reinhard Ricardo Richard Rick Roberto Rodrigo Roger Roland Rolf
        Roman Ronald Ross Roy Rudolf Russell Ryan Salvatore Sam Samuel Scott Sean Sebastian Sergei Sergio Siegfried Simon Stefan
        Stephen Steve Steven Stuart Sven Terry Theo Theodor Theodore Tim Timothy Tobias Todd Tom Tommy Tony Ulrich Uwe Vincent
        Vladimir Walter Wayne Werner Wilhelm William Wolfgang Xavier Yusuf Zachary""",
    ("f", "cyrillic"): """Александра Алина Алла Анастасия Валентина Валерия Вероника Виктория Галина Евгения Екатерина Елизавета Зоя
        Инна Ксения Лариса Лидия Людмила Маргарита Марина Надежда Наталья Оксана Полина Светлана София Татьяна Юлия Яна""",
    ("m", "cyrillic"): """Александр Алексей Анатолий Андрей Артём Артем Вадим Валентин Валерий Василий Виталий Владимир Вячеслав Геннадий
        Георгий Григорий Денис Евгений Егор Игорь Илья Кирилл Константин Леонид Максим Николай Никита Петр Пётр Роман Сергей
        Степан Фёдор Юрий Ярослав""",
    ("f", "greek"): "Αικατερίνη Αναστασία Βασιλική Γεωργία Δήμητρα Ευαγγελία Ιωάννα Κατερίνα Παρασκευή",
    ("m", "greek"): "Αθανάσιος Ανδρέας Βασίλης Γεώργιος Γιάννης Δημήτριος Ιωάννης Κωνσταντίνος Μιχάλης Νικόλαος Παναγιώτης Σπύρος",
}
#: All given names by which persons are recognised.
GIVEN_NAMES = {group: list(dict.fromkeys([*names, *KNOWN[group].split()])) for group, names in GIVEN.items()}
TITLES = {"f": ["Mrs", "Ms", "Miss", "Frau", "Señora", "Madame", "Mme", "Lady", "Signora", "Sra", "госпожа", "Κυρία"],
          "m": ["Mr", "Mister", "Herr", "Señor", "Monsieur", "Sir", "Lord", "Signor", "Sr", "господин", "Κύριος"],
          "n": ["Dr", "Doctor", "Prof", "Professor", "Mx", "Rev", "Reverend", "Judge", "Senator", "Captain", "Capt", "Dra", "Dott"]}
#: Words between the parts of a name, and capitalised words that are no part of one.
PARTICLES = "von van der den de del della di da dos du la le bin ibn al ter zu zum zur".split()
NO_NAMES = """A About According After All Although Also An And Any Apache April Are As At August Because Before But By CC Call
    Copyright Contact Creative December Der Die Das During Each Email February For Friday From GNU GPL Has Have He Her Here Hers
    His How However I If In Is It Its January July June Licensed License Mail March May MIT Monday Neither No Nor Not November
    October Of On Or Our Permission Phone Released Said Saturday See September She Since So Sunday Tel That The Their Then There
    These They This Those Thursday To Tuesday Und Until Was We Wednesday Were What When Where Which While Who Why Will With
    Would You Your""".split()
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga ha ka ke la le lo ma me mo na ne ra re ro sa se ta te to va vo wa ze",
    "cyrillic": "ба бе бо ва ве во га го да де до за зо ка ко ла ле ло ма ме мо на но ра ро са со та то фа ха ша",
    "greek": "βα βε βο γα γο δα δε δο θα θε κα κε κο λα λε λο μα με μο να νε νο πα πε ρα ρο σα σε τα τε φα χα",
}

#: Attempts after which surrogates get longer, by one place an attempt.
GROWS = 2

_FREE = r"(?<![\p{L}\p{N}])"
_END = r"(?![\p{L}\p{N}])"


def _any_of(words: list[str]) -> str:
    """A pattern of the words by common beginnings, longer ones first: few steps at a place where none stands."""
    tails: dict[str, list[str]] = {}
    for w in words:
        if w:
            tails.setdefault(w[0], []).append(w[1:])
    found = [c + (_any_of(rest) if any(rest) else "") for c, rest in sorted(tails.items())]
    return f"(?:{'|'.join(found)})" + ("?" if "" in words else "")


_NAMES = _any_of([n for names in GIVEN_NAMES.values() for n in names])
_TITLES = _any_of([t for titles in TITLES.values() for t in titles])
#: One word of a name: with its prefix or second half, and as the next part of a name with what may precede it.
WORD = r"(?<![\p{L}\p{N}])(?:\p{Lu}['’])?\p{Lu}\p{L}+(?:[-'’]\p{Lu}\p{L}+)?(?![\p{L}\p{N}])"
_PART = rf"(?!{_any_of(NO_NAMES)}(?![\p{{L}}\p{{N}}])){WORD}"
_NEXT = rf" (?:\p{{Lu}}\.? ){{0,2}}(?:{_any_of(PARTICLES)} ){{0,2}}{_PART}"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}][\p{L}\p{N}._%+-]*@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+",
    "address": rf"(?<![0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?[0-9])",
    "phone": r"(?<![0-9+])\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,3}(?![0-9])"
             r"|(?<![0-9(])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])"
             r"|(?<![\p{L}0-9+.-])(?:1[ .-])?[2-9][0-9]{2}([ .-])[0-9]{3}\1[0-9]{4}(?![0-9]|[.-][0-9])"
             r"|(?<![\p{L}0-9+.-])\(?0[1-9][0-9]{1,4}\)?[ /-]{1,3}[0-9]{3,4}(?:[ -]?[0-9]{2,4}){1,2}(?![0-9]|[.-][0-9])",
    "social": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9.-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
    "account": _FREE + r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?" + _END,
    "secret": r"(?<=(?:password|passwd|secret|token|api_key)=)[^\s\"',;]{6,}"
              rf"|{_FREE}AKIA[0-9A-Z]{{16}}{_END}|{_FREE}gh[pousr]_[A-Za-z0-9]{{36}}{_END}"
              rf"|{_FREE}sk-[A-Za-z0-9]{{20,}}{_END}"
              rf"|{_FREE}(?=[a-fA-F]*[0-9])(?:[0-9a-f]{{32,64}}|[0-9A-F]{{32,64}}){_END}",
    "person": rf"(?=\p{{Lu}}|госпо){_FREE}(?:(?:{_TITLES}\.? )+(?:\p{{Lu}}\.? ){{0,2}}(?:{_any_of(PARTICLES)} ){{0,2}}{_PART}(?:{_NEXT}){{0,3}}"
              rf"|{_NAMES}(?:{_NEXT}){{1,3}})",
}
#: Order of preference where two types could match at one place.
ORDER = ["email", "secret", "account", "phone", "social", "address", "card", "person"]
ENTITY = "|".join(PATTERNS[t] for t in ORDER)
_TITLED = rf"^(?:{_TITLES}\.? )*"

def suspect(text: Column) -> Column:
    """Whether a text can hold an entity at all: every pattern needs one of these.

    Costs a fraction of the full pattern, which then runs on few texts.
    """
    return F.coalesce(text.rlike("[0-9@=]") | text.contains("sk-") | text.contains("AKIA")
                      | text.rlike("gh[pousr]_") | text.rlike(PATTERNS["person"]), F.lit(False))


def mentions(text: Column) -> Column:
    """All entities of a text, in order; none for null."""
    return F.when(suspect(text), F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))).otherwise(
        F.array().cast("array<string>"))


def kind_of(mention: Column) -> Column:
    """The first type whose pattern covers the whole mention."""
    def covers(t: str) -> Column:
        bare = PATTERNS[t].replace("(?<=(?:password|passwd|secret|token|api_key)=)", "")
        return mention.rlike(f"^(?:{bare})$")
    order = [t for t in ORDER if t != "secret"] + ["secret"]          # what a password field holds can be anything
    chain = F.when(covers(order[0]), order[0])
    for t in order[1:]:
        chain = chain.when(covers(t), t)
    return chain.otherwise("secret")


def name_words(mention: Column) -> Column:
    """The words of a person's name, in lower case and without titles."""
    return F.array_distinct(F.transform(F.regexp_extract_all(
        F.regexp_replace(mention, _TITLED, ""), F.lit(WORD), F.lit(0)), F.lower))


def given_surrogates(key: str) -> dict[str, str]:
    """Given names in lower case to their surrogates: keyed rotations, one-to-one within gender and script."""
    out: dict[str, str] = {}
    for names in [*GIVEN.values(), *[[n for n in names if n not in GIVEN[g]] for g, names in GIVEN_NAMES.items()]]:
        shift = int(hashlib.sha512("\u0001".join([key, "given", names[0]]).encode()).hexdigest()[:4], 16) % (len(names) - 1) + 1
        for i, n in enumerate(names):
            out.setdefault(n.lower(), names[(i + shift) % len(names)])
    return out


def renamed(text: Column, names: Column) -> Column:
    """``text`` with the words that ``names`` (lower case to surrogate) holds exchanged, in their own case."""
    def fresh(w: Column) -> Column:
        new = F.element_at(names, F.lower(w))
        return F.coalesce(F.when((F.length(w) > 1) & (w == F.upper(w)), F.upper(new)).otherwise(new), w)
    swapped = F.array_join(F.zip_with(F.split(text, WORD, -1), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)),
                                      lambda gap, w: F.concat(gap, F.coalesce(fresh(w), F.lit("")))), "")
    return F.when(F.size(names) > 0, swapped).otherwise(text)


def bare_names(text: Column, names: Column) -> Column:
    """How many words of ``text`` are names of ``names``."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return F.when(F.size(names) > 0, F.size(F.filter(words, lambda w: F.element_at(names, F.lower(w)).isNotNull()))).otherwise(0)


def canonical_of(kind: Column, mention: Column) -> Column:
    digits = F.regexp_replace(mention, "[^0-9]", "")
    return (F.when(kind == "email", F.lower(mention))
            .when(kind.isin("card", "social"), digits)
            .when(kind == "phone", F.concat(F.when(mention.startswith("+"), F.regexp_extract(mention, r"^\+([0-9]+)", 1))
                                            .otherwise(""), F.lit("|"), digits))
            .when(kind == "account", F.regexp_replace(mention, " ", ""))
            .otherwise(mention))


def _digest(key: str, *parts: Column) -> Column:
    """128 hexadecimal digits that depend on the key."""
    return F.sha2(F.concat_ws("\u0001", F.lit(key), *[p.cast("string") for p in parts]), 512)


def _draw(digest: Column, i: Column) -> Column:
    """A number from 0 to 65535 for place ``i`` (from 0); longer values hash further."""
    block = F.when(i < 32, digest).otherwise(F.sha2(F.concat(digest, F.floor(i / 32).cast("string")), 512))
    return F.conv(F.substring(block, (i % 32).cast("int") * 4 + 1, 4), 16, 10).cast("int")


def _at(chars: str, n: Column) -> Column:
    return F.substring(F.lit(chars), (n % len(chars)) + 1, 1)


def shaped(value: Column, digest: Column, hexadecimal: Column | bool = False) -> Column:
    """``value`` with digits, lower and upper letters drawn anew and all else kept."""
    hexadecimal = F.lit(hexadecimal) if isinstance(hexadecimal, bool) else hexadecimal
    lower, upper = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

    def one(c: Column, i: Column) -> Column:
        n = _draw(digest, i)
        return (F.when(hexadecimal & c.rlike("[0-9a-f]"), _at("0123456789abcdef", n))
                .when(hexadecimal & c.rlike("[A-F]"), _at("0123456789ABCDEF", n))
                .when(c.rlike("[0-9]"), _at("0123456789", n))
                .when(c.rlike(r"\p{Lu}"), _at(upper, n))
                .when(c.rlike(r"\p{L}"), _at(lower, n))
                .otherwise(c))
    return F.array_join(F.transform(F.split(value, ""), one), "")


def _longer(value: Column, digest: Column, attempt: Column, hexadecimal: Column | bool = False) -> Column:
    """:func:`shaped`, which on attempts after GROWS adds characters of the last one's class.

    A value without any letter or digit keeps only its length: all of it is drawn as letters.
    """
    body = F.when(value.rlike(r"[0-9\p{L}]"), value).otherwise(F.regexp_replace(value, "(?s).", "x"))
    last = F.regexp_extract(body, r"([0-9\p{L}])[^0-9\p{L}]*$", 1)
    return shaped(F.concat(body, F.repeat(last, F.greatest(attempt - GROWS, F.lit(0)))), digest, hexadecimal)


def luhn_digit(digits: Column) -> Column:
    """The check digit that makes ``digits`` + it pass the Luhn test."""
    n = F.length(digits)
    total = F.aggregate(
        F.transform(F.split(digits, ""), lambda c, i: F.when((n - i) % 2 == 1, c.cast("int") * 2).otherwise(c.cast("int"))),
        F.lit(0), lambda s, d: s + F.when(d > 9, d - 9).otherwise(d))
    return ((10 - total % 10) % 10).cast("string")


def _script(name: Column) -> Column:
    return (F.when(name.rlike(r"^\p{IsCyrillic}"), "cyrillic").when(name.rlike(r"^\p{IsGreek}"), "greek")
            .otherwise("latin"))


def surrogate_of(kind: Column, value: Column, attempt: Column, key: str) -> Column:
    """The surrogate of a canonical value on one attempt, itself in canonical form."""
    h = _digest(key, kind, value, attempt)
    user, host = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    host_h = _digest(key, F.lit("host"), host)                 # mail of one host stays mail of one host
    tld = F.substring_index(host, ".", -1)
    email = F.concat(_longer(user, h, attempt), F.lit("@"),
                     shaped(F.substring(host, F.lit(1), F.length(host) - F.length(tld)), host_h), tld)
    body = _longer(F.substring(value, F.lit(1), F.length(value) - 1), h, attempt)
    valid = luhn_digit(F.substring(value, F.lit(1), F.length(value) - 1)) == F.substring(value, F.lit(-1), F.lit(1))
    card = F.concat(body, F.when(valid, luhn_digit(body))
                    .otherwise(((luhn_digit(body).cast("int") + 1 + _draw(h, F.lit(30)) % 9) % 10).cast("string")))
    country = F.substring_index(value, "|", 1)
    phone = F.concat(country, F.lit("|"), country, _longer(
        F.substring(F.substring_index(value, "|", -1), F.length(country) + 1, F.length(value)), h, attempt))
    octets = F.concat_ws(".", (_draw(h, F.lit(0)) % 126 + 1).cast("string"),
                         *[(_draw(h, F.lit(i)) % 256).cast("string") for i in (1, 2)],
                         (_draw(h, F.lit(3)) % 254 + 1).cast("string"),
                         F.transform(F.slice(F.sequence(F.lit(3), F.greatest(attempt - GROWS, F.lit(0)) + 3), 2, GROWS + 2**20),
                                     lambda i: (_draw(h, i) % 256).cast("string")))
    account = F.concat(F.substring(value, 1, 2), _longer(F.substring(value, F.lit(3), F.length(value)), h, attempt))
    prefix = F.regexp_extract(value, r"^(AKIA|gh[pousr]_|sk-|)", 1)
    secret = F.concat(prefix, _longer(F.substring(value, F.length(prefix) + 1, F.length(value)), h, attempt,
                                      value.rlike("^([0-9a-f]+|[0-9A-F]+)$")))
    # a name of four syllables of its script; each further attempt adds one
    name = F.lit(None).cast("string")
    for script, syllables in SYLLABLES.items():
        pool = F.array(*[F.lit(s) for s in syllables.split()])
        made = F.array_join(F.transform(F.sequence(F.lit(0), attempt + 3), lambda i: F.element_at(
            pool, _draw(h, i) % len(syllables.split()) + 1)), "")
        name = F.when(_script(value) == script, made).otherwise(name)
    return (F.when(kind == "email", email).when(kind == "card", card).when(kind == "phone", phone)
            .when(kind == "social", _longer(value, h, attempt)).when(kind == "address", octets)
            .when(kind == "account", account).when(kind == "person", name).otherwise(secret))


def distinct_surrogates(values: DataFrame, key: str) -> DataFrame:
    """(kind, value, surrogate) for distinct (kind, value): one-to-one and clear of real values.

    Rounds: everyone without a surrogate draws; of those who drew the same one the smallest
    value keeps it, unless it is taken already or occurs as a value; the others draw again, from
    a space that grows with the attempt, so that the rounds end however many values there are.
    """
    values = settled(values, "values")
    real = values.select("kind", F.col("value").alias("surrogate"))
    done: list[DataFrame] = []
    pending, attempt = values, 0
    while True:
        drawn = settled(pending.withColumn("surrogate", surrogate_of(
            F.col("kind"), F.col("value"), F.lit(attempt), key)), "drawn")
        first = (drawn.groupBy("kind", "surrogate").agg(F.min("value").alias("value"))
                 .join(real, ["kind", "surrogate"], "left_anti"))
        for earlier in done:
            first = first.join(earlier.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        kept = settled(first.select("kind", "value", "surrogate"), "surrogates")
        done.append(kept)
        rest = settled(drawn.join(kept, ["kind", "value"], "left_anti").select("kind", "value"), "pending", drawn)
        if attempt:
            discard(pending)
        pending, attempt = rest, attempt + 1
        if pending.isEmpty():
            return reduce(DataFrame.unionByName, done)


def rendered(kind: Column, mention: Column, surrogate: Column) -> Column:
    """The surrogate in the writing of one mention."""
    fresh = F.when(kind == "phone", F.substring_index(surrogate, "|", -1)).otherwise(surrogate)
    # the i-th digit or letter of the mention becomes the i-th of the surrogate
    chars = F.split(mention, "")
    counted = F.when(kind == "account", "[A-Z0-9]").otherwise("[0-9]")
    spread = F.array_join(F.transform(chars, lambda c, i: F.when(
        c.rlike("[0-9A-Z]") & F.regexp_like(c, counted),
        F.substring(fresh, F.size(F.filter(F.slice(chars, 1, i + 1), lambda d: F.regexp_like(d, counted))), F.lit(1)),
    ).otherwise(c)), "")
    # a surrogate longer than its value goes on after the mention's last place
    places = F.size(F.filter(chars, lambda c: F.regexp_like(c, counted)))
    spread = F.concat(spread, F.substring(fresh, places + 1, F.length(fresh)))
    return (F.when(kind.isin("card", "social", "phone", "account"), spread)
            .when((kind == "email") & (mention == F.upper(mention)), F.upper(surrogate))
            .otherwise(surrogate))


def replaced(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text",
             counts: str | None = None) -> DataFrame:
    """``docs`` with every entity of the text replaced; ``counts`` names a column of how many.

    Null texts stay null and texts without entities come back unchanged, untouched by any
    exchange; repeated rows are treated alike; all other columns are kept (one named like ``counts`` is replaced).
    """
    fp = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    found = settled(
        docs.select(fp.alias("_fp"), mentions(F.col(text_col)).alias("m")).filter(F.size("m") > 0)
        .select("_fp", F.explode(F.array_distinct("m")).alias("mention")).distinct(), "mentions")
    kinds = found.select("mention").distinct().withColumn("kind", kind_of(F.col("mention")))
    kinds = settled(kinds.withColumn("value", canonical_of(F.col("kind"), F.col("mention"))), "kinds")
    # a person is replaced by the words of the name, so that each stands for itself elsewhere in the text
    words = kinds.filter("kind = 'person'").select("mention", F.explode(name_words(F.col("mention"))).alias("value"))
    others = kinds.filter("kind <> 'person'")
    table = F.create_map(*[F.lit(x) for pair in given_surrogates(key).items() for x in pair])
    words = settled(words.withColumn("given", F.element_at(table, F.col("value"))), "words")
    surrogates = distinct_surrogates(
        others.select("kind", "value").unionByName(
            words.filter(F.col("given").isNull()).select(F.lit("person").alias("kind"), "value")).distinct(), key)
    names = (words.join(surrogates.filter("kind = 'person'").select("value", "surrogate"), "value", "left")
             .select("mention", F.lit(True).alias("name"), F.col("value").alias("was"),
                     F.coalesce("given", F.initcap("surrogate")).alias("fresh")))
    texts = settled(
        others.join(surrogates, ["kind", "value"])
        .select("mention", F.lit(False).alias("name"), F.col("mention").alias("was"),
                rendered(F.col("kind"), F.col("mention"), F.col("surrogate")).alias("fresh")).unionByName(names), "fresh")
    # what a text needs, by the fingerprint of the text: copies need it once
    pair = F.struct("was", "fresh")
    needed = settled(found.join(texts, "mention").groupBy("_fp")
                     .agg(F.map_from_entries(F.collect_set(F.when(~F.col("name"), pair))).alias("_fresh"),
                          F.map_from_entries(F.collect_set(F.when(F.col("name"), pair))).alias("_names")),
                     "needed", found, texts, kinds, words)
    keep = [c for c in docs.columns if c != counts]
    here = mentions(F.col(text_col))
    # only texts with entities meet the table of surrogates; the others stay where they are
    touched = docs.filter(F.size(here) > 0).select(*keep, fp.alias("_fp")).join(needed, "_fp")
    gaps = F.split(F.col(text_col), ENTITY, -1)
    names = F.col("_names")
    rebuilt = F.array_join(F.zip_with(gaps, here, lambda part, m: F.concat(
        renamed(part, names), F.coalesce(F.element_at("_fresh", m), renamed(m, names), F.lit("")))), "")
    count = F.size(here) + F.aggregate(gaps, F.lit(0), lambda n, part: n + bare_names(part, names))
    changed = touched.select(*[rebuilt.alias(c) if c == text_col else F.col(c) for c in keep],
                             *[count.alias(c) for c in [counts] if c])
    same = docs.filter(F.size(here) == 0).select(*keep, *[F.lit(0).alias(c) for c in [counts] if c])
    return changed.unionByName(same)
