"""Personal data replaced by keyed surrogates, with DataFrame functions only.

Detected entities (e-mail addresses, telephone, card and IPv4 numbers, names after a
form of address and their later mentions in the text without one) are made of parts:
an address of mailbox and host, a name of given names, surname and initials.  Each
part gets a replacement drawn from a keyed hash of it:

* the same part gets the same surrogate everywhere, in upper or lower case and in
  other groupings of a number too (coreference): ``Mrs Smith`` stays the surname of
  ``Mrs Anna Smith``, and addresses of one host keep one host in common;
* its type, format, case and script stay, and a given name's gender, which is that of
  the forms of address it is met with;
* different parts get different surrogates, and none that is itself a part of that
  kind in the corpus.  That is checked over the whole corpus: of the parts that meet in
  one surrogate all but the smallest draw again, and so do those that meet one drawn
  before or a real one, until none is left (distinctness).  Only these losers move.

Redrawing always ends: from the fourth attempt on a surrogate is longer than its part,
by one more letter or digit each time (an IPv4 number, which can't be, then takes
octets of any length), and names gain a syllable from the first on.

A surrogate is a function of key, part and attempt, so only parts that drew more than
once, and given names met with several forms of address, need a table.  If that
table's counted rows fit ``small`` it goes along as one map; otherwise it is joined.
Texts are shuffled in neither case unless they hold such a part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm._common import Scratch, named, numbered, table

KEY = "surrogate-key-1"
#: Redrawn parts that may travel as one map.
SMALL = 20_000
#: Attempts before surrogates grow; rounds at most (the IPv4 numbers alone can be used up).
SAME_LENGTH, ATTEMPTS = 4, 200


def _titles(words: str) -> str:
    """Forms of address, in capitals too."""
    each = words.split()
    return "|".join(dict.fromkeys(w + x for w in [*each, *map(str.upper, each)] for x in (["\\.?"] if w.isascii() and len(w) < 5 else [""])))


_FEMALE_TITLE = _titles("Mrs Ms Miss Madame Mme Mlle Frau Señora Sra Señorita Госпожа Κυρία")
_MALE_TITLE = _titles("Mr Monsieur Herr Herrn Señor Sr Господин Κύριος")
_ANY_TITLE = _titles("Dr Prof Доктор")
#: One look at the first letter spares most places the choice.
_TITLE = f"(?=[{''.join(sorted({t[0] for t in '|'.join((_FEMALE_TITLE, _MALE_TITLE, _ANY_TITLE)).split('|')}))}])(?:{_FEMALE_TITLE}|{_MALE_TITLE}|{_ANY_TITLE})"
_NAME = "\\p{Lu}[\\p{L}\\p{M}'’-]*[\\p{L}\\p{M}]"
_INITIAL = "\\p{Lu}(?:\\.|(?![\\p{L}\\p{M}'’]))"
_PARTICLE = "(?:van|von|vom|zu|zur|de|del|della|der|den|di|da|dos|du|la|le|ter|bin|al|el)"
_OCTET = "(?:25[0-5]|2[0-4]\\d|1?\\d?\\d)"
EMAIL = "(?<![\\p{L}\\d._%+-])[\\p{L}\\d._%+-]*[\\p{L}\\d]@[\\p{L}\\d](?:[\\p{L}\\d-]*[\\p{L}\\d])?(?:\\.[\\p{L}\\d](?:[\\p{L}\\d-]*[\\p{L}\\d])?)*\\.\\p{L}{2,}"
IP = f"(?=\\d)(?<![\\d.]){_OCTET}(?:\\.{_OCTET}){{3}}(?![\\d]|\\.\\d)"
CARD = "(?=\\d)(?<![\\d+-])\\d{4}(?:[ -]?\\d{4}){2}[ -]?\\d{1,7}(?![\\d-])"
#: International; national with a leading 0; grouped as in North America; bare after a word that says so.
PHONE = (
    "(?=[+(\\d])(?<![\\d.+-])(?:"
    "\\+(?=(?:[ .()/-]{0,2}\\d){7,15}(?!\\d))\\d{1,4}(?:[ ./-]?(?:\\(\\d{1,4}\\)|\\d{1,4})){1,6}(?!\\d)"
    "|0(?=(?:[ ./-]?\\d){8,10}(?![\\d]|[./-]\\d))\\d{1,4}(?:(?:[ ./-]\\d{2,4}){2,4}|[ /-]\\d{5,8})(?!\\d)"
    "|(?:\\+\\d{1,3}[ .-]?)?(?:\\(\\d{2,4}\\)[ .-]?|\\d{2,4}[ .-])?\\d{3}[ .-]\\d{4}(?![\\d-]|\\.\\d)"
    "|(?=\\d)(?<=(?i:tel|phone|call|mobile|cell|fax)[.:]{0,2} {0,2})\\d{9,11}(?!\\d)"
    ")"
)
PERSON = f"(?<![\\p{{L}}]){_TITLE} (?:(?:{_INITIAL}|{_NAME}|{_PARTICLE}) ){{0,3}}{_NAME}"
#: A cheap sign that a text can hold any entity at all.
HINT = f"@|\\d{{3}}|\\d\\.\\d|\\d\\d[ ./-]\\d\\d[ ./-]\\d|(?<![\\p{{L}}]){_TITLE} "
ENTITY = f"{EMAIL}|{IP}|{CARD}|{PHONE}|{PERSON}"
#: Country codes of one and two digits; the others have three.
_COUNTRY = "^\\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\\d{3})"

_GIVEN = {
    ("latin", "f"): "Alba Anna Carla Clara Elena Emma Greta Helena Ida Irene Julia Karla Laura Lena Lina Lola Luisa Maria Marta Mia Nadia Nina Nora Olga Paula Rita Rosa Sara Silvia Sonia Vera Zoe",
    ("latin", "m"): "Adam Alan Anton Artur Bruno Carlos David Diego Emil Erik Felix Frank Hugo Ivan Jan Jonas Karl Leo Luis Marco Mario Martin Max Niklas Oscar Otto Paul Pedro Robert Rolf Simon Victor",
    ("cyrillic", "f"): "Алла Анна Вера Галина Дарья Елена Жанна Зоя Инна Ирина Лидия Майя Мария Нина Ольга Раиса",
    ("cyrillic", "m"): "Антон Борис Вадим Глеб Денис Егор Захар Иван Игорь Лев Марк Никита Олег Павел Роман Юрий",
    ("greek", "f"): "Άννα Βάσω Γεωργία Δάφνη Ελένη Ζωή Ηρώ Θάλεια Ιωάννα Κατερίνα Λίνα Μαρία Νίκη Ξένια Όλγα Σοφία",
    ("greek", "m"): "Άγγελος Βασίλης Γιώργος Δήμος Ηλίας Θωμάς Ιάσων Κώστας Λευτέρης Μάρκος Νίκος Ορέστης Παύλος Σπύρος Τάσος Φώτης",
}
_SYLLABLES = {"latin": "ba bel bor dan del dor fal fer gan gor hal har kal kel kor lan mar mel mon nar nel or pal ral ros san sel tal tor val ver zan", "cyrillic": "ба бел бор ва гор дан дол жар зор кал кос лан мар мел нар ор", "greek": "βα γκα δελ δορ θα καλ κορ λαν μαρ μελ ναρ παλ ρος σαν ταλ φερ"}


def _hex(seed: Column) -> Column:
    """256 hex digits from a keyed hash."""
    return F.concat(*(F.sha2(F.concat(F.lit(f"{i}\x1f"), seed).cast("binary"), 512) for i in range(2)))


def _draw(hexes: Column, i: Column | int) -> Column:
    """The i-th (from 0, cyclic) number below 65536 of the stream."""
    at = (F.pmod(i * F.lit(4) if isinstance(i, Column) else F.lit(i * 4), F.lit(252)) + 1).cast("int")
    return F.conv(F.substr(hexes, at, F.lit(4)), 16, 10).cast("int")


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), where value is worked out once."""
    return F.element_at(F.transform(F.array(value), lambda x: f(x)), 1)


def _pick(words: str, number: Column) -> Column:
    w = words.split()
    return F.element_at(F.array(*map(F.lit, w)), F.pmod(number, F.lit(len(w))) + 1)


_SMALL_LETTERS, _LARGE_LETTERS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


_HAN = "伟芳娜敏静丽强磊军洋勇艳杰涛明超秀霞平刚"
_ALPHABETS = (
    ("[0-9]", "0123456789"), ("[a-z]", _SMALL_LETTERS), ("[A-Z]", _LARGE_LETTERS), ("[а-яё]", "абвгдежзиклмнопрстуфхцчшэюя"), ("[А-ЯЁ]", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ"), ("[α-ωά-ώ]", "αβγδεζηθικλμνξοπρστυφχψω"), ("[Α-ΩΆ-Ώ]", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"),
    ("\\p{IsHan}", _HAN), ("\\p{Lu}", _LARGE_LETTERS), ("\\p{L}", _SMALL_LETTERS),
)


def _chars(text: Column) -> Column:
    return F.split(text, "(?<=.)(?=.)", -1)


def _shaped(text: Column, seed: Column) -> Column:
    """Digits for digits, letters for letters of the same case and script; all else stays."""

    def one(hexes, c, i):
        k, out = _draw(hexes, i), None
        for test, letters in _ALPHABETS:
            letter = F.substr(F.lit(letters), F.pmod(k, F.lit(len(letters))) + 1, F.lit(1))
            out = F.when(c.rlike(test), letter) if out is None else out.when(c.rlike(test), letter)
        return out.otherwise(c)

    return _let(_hex(seed), lambda h: F.array_join(F.transform(_chars(text), lambda c, i: one(h, c, i)), ""))


def _longer(attempt: Column, char: str, start: int = SAME_LENGTH) -> Column:
    """One more character to draw for each attempt from ``start`` on."""
    return F.repeat(F.lit(char), F.greatest(F.lit(0), attempt - (start - 1)))


def kind_of(entity: Column) -> Column:
    return (
        F.when(entity.contains("@"), "email").when(entity.rlike(f"^{IP}$"), "ip").when(entity.rlike(f"^{CARD}$"), "card").when(entity.rlike("^[+(\\d]"), "phone").otherwise("person")
    )


def _luhn_sum(digits: Column) -> Column:
    """Luhn's sum of the digits before a check digit."""
    backwards = F.transform(_chars(F.reverse(digits)), lambda c, i: F.when(F.pmod(i, F.lit(2)) == 0, F.floor(c.cast("int") * 2 / 10).cast("int") + F.pmod(c.cast("int") * 2, F.lit(10))).otherwise(c.cast("int")))
    return F.aggregate(backwards, F.lit(0), lambda a, x: a + x)


def _check_digit(digits: Column) -> Column:
    return F.pmod(F.lit(10) - F.pmod(_luhn_sum(digits), F.lit(10)), F.lit(10)).cast("string")


def _seed(key: str, kind: str, known: Column, attempt: Column) -> Column:
    return F.concat_ws("\x1f", F.lit(key), F.lit(kind), known, attempt.cast("string"))


def _digits_of(text: Column) -> Column:
    return F.concat(F.when(text.startswith("+"), "+").otherwise(""), F.regexp_replace(text, "\\D", ""))


# parts and their surrogates


def _mailbox(local: Column, host: Column, attempt: Column, key: str) -> Column:
    return _shaped(F.concat(local, _longer(attempt, "a")), _seed(key, "email", F.lower(F.concat(local, F.lit("@"), host)), attempt))


def _host(host: Column, attempt: Column, key: str) -> Column:
    """Its top-level label stays."""
    top = F.substring_index(host, ".", -1)
    stem = F.substr(host, F.lit(1), F.length(host) - F.length(top) - 1)
    return F.concat(_shaped(F.concat(stem, _longer(attempt, "a")), _seed(key, "host", F.lower(host), attempt)), F.lit("."), top)


def _ip(ip: Column, attempt: Column, key: str) -> Column:
    def octet(hexes, c, i):
        k, size = _draw(hexes, i), F.when(attempt >= SAME_LENGTH, 0).otherwise(F.length(c))
        return F.when(size == 0, F.pmod(k, F.lit(254)) + 1).when(size == 1, F.pmod(k, F.lit(9)) + 1).when(size == 2, F.pmod(k, F.lit(90)) + 10).otherwise(F.pmod(k, F.lit(154)) + 100).cast("string")

    return _let(_hex(_seed(key, "ip", ip, attempt)), lambda h: F.array_join(F.transform(F.split(ip, "\\."), lambda c, i: octet(h, c, i)), "."))


def _phone(digits: Column, attempt: Column, key: str) -> Column:
    """Its country code stays."""
    code = F.regexp_extract(digits, _COUNTRY, 0)
    return F.concat(code, _shaped(F.concat(F.substr(digits, F.length(code) + 1, F.length(digits)), _longer(attempt, "0")), _seed(key, "phone", digits, attempt)))


def _card(digits: Column, attempt: Column, key: str) -> Column:
    """A valid check digit stays valid."""
    but_last = lambda d: F.substr(d, F.lit(1), F.length(d) - 1)
    valid = _check_digit(but_last(digits)) == F.substr(digits, F.length(digits), F.lit(1))
    drawn = _shaped(F.concat(digits, _longer(attempt, "0", 2 * SAME_LENGTH)), _seed(key, "card", digits, attempt))
    return _let(drawn, lambda d: F.when(valid, F.concat(but_last(d), _check_digit(but_last(d)))).otherwise(d))


def _by_script(word: Column, made: Callable[[str], Column]) -> Column:
    return F.when(word.rlike("\\p{IsCyrillic}"), made("cyrillic")).when(word.rlike("\\p{IsGreek}"), made("greek")).otherwise(made("latin"))


def _cased(word: Column, drawn: Column) -> Column:
    return F.when((F.length(word) > 1) & (F.upper(word) == word), F.upper(drawn)).otherwise(drawn)


def _syllables(script: str, hexes: Column, first: int, n: Column | int) -> Column:
    numbers = F.sequence(F.lit(1), n if isinstance(n, Column) else F.lit(n))
    return F.array_join(F.transform(numbers, lambda i: _pick(_SYLLABLES[script], _draw(hexes, i + first))), "")


def _grown(script: str, hexes: Column, attempt: Column) -> Column:
    """A syllable for each attempt."""
    return F.when(attempt > 0, _syllables(script, hexes, 20, F.least(F.lit(40), attempt))).otherwise("")


def _surname(word: Column, attempt: Column, key: str) -> Column:
    def made(script, h):
        second = F.when(word.contains("-"), F.concat(F.lit("-"), F.initcap(_syllables(script, h, 10, 2)))).otherwise("")
        return F.concat(F.initcap(F.concat(_syllables(script, h, 0, 3), _grown(script, h, attempt))), second)

    return _cased(word, _let(_hex(_seed(key, "surname", F.lower(word), attempt)), lambda h: _by_script(word, lambda script: made(script, h))))


def _given(word: Column, gender: Column, attempt: Column, key: str) -> Column:
    def name(script, h, i):
        woman = (gender == "f") | (gender != "m") & (F.pmod(_draw(h, 7), F.lit(2)) == 0)
        return F.when(woman, _pick(_GIVEN[script, "f"], _draw(h, i))).otherwise(_pick(_GIVEN[script, "m"], _draw(h, i)))

    def made(script, h):
        second = F.when(word.contains("-"), F.concat(F.lit("-"), name(script, h, 1))).otherwise("")
        return F.concat(name(script, h, 0), _grown(script, h, attempt), second)

    return _cased(word, _let(_hex(_seed(key, "given", F.lower(word), attempt)), lambda h: _by_script(word, lambda script: made(script, h))))


def _initial(word: Column, key: str) -> Column:
    """Another letter of its alphabet, by one keyed rotation, so that different ones stay different."""
    by = F.conv(F.substring(F.md5(F.lit(f"{key}\x1finitial").cast("binary")), 1, 4), 16, 10).cast("int")
    out = None
    for letters in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"):
        at = F.call_function("instr", F.lit(letters), F.substr(word, F.lit(1), F.lit(1)))
        new = F.substr(F.lit(letters), F.pmod(at - 1 + F.pmod(by, F.lit(len(letters) - 1)) + 1, F.lit(len(letters))) + 1, F.lit(1))
        out = F.when(at > 0, new) if out is None else out.when(at > 0, new)
    return F.concat(out.otherwise(F.lit("X")), F.substr(word, F.lit(2), F.length(word)))


def _name_of(entity: Column) -> Column:
    return F.regexp_replace(entity, f"^{_TITLE} ", "")


def _gender_of(entity: Column) -> Column:
    return F.when(entity.rlike(f"^(?:{_FEMALE_TITLE}) "), "f").when(entity.rlike(f"^(?:{_MALE_TITLE}) "), "m").otherwise("u")


def _is_given(word: Column) -> Column:
    return ~word.rlike(f"^(?:{_INITIAL}|{_PARTICLE})$")


_PART = "array<struct<known:string,e:string,g:string>>"


def parts_of(entity: Column) -> Column:
    """The parts of an entity that get a surrogate: what all their spellings have in common, the spelling, the gender."""
    part = lambda kind, known, e, g=None: F.struct(F.concat(F.lit(kind + ":"), F.lower(known)).alias("known"), e.alias("e"), (F.lit("") if g is None else g).alias("g"))
    kind, host, digits = kind_of(entity), F.substring_index(entity, "@", -1), _digits_of(entity)
    words = F.split(_name_of(entity), " ")
    given = F.transform(F.filter(F.slice(words, 1, F.size(words) - 1), _is_given), lambda w: part("g", w, w, _gender_of(entity)))
    last = F.element_at(words, -1)
    person = F.concat(given, F.array(part("s", last, last)))
    return (
        F.when(kind == "email", F.array(part("h", host, host), part("e", entity, entity))).when(kind == "ip", F.array(part("i", entity, entity)))
        .when(kind == "card", F.array(part("c", digits, digits))).when(kind == "phone", F.array(part("p", digits, digits))).otherwise(person).cast(_PART)
    )


def part_surrogate(known: Column, e: Column, gender: Column, attempt: Column, key: str = KEY) -> Column:
    """What a part's surrogates have in common, like ``known`` of real ones."""
    kind = F.substr(known, F.lit(1), F.lit(1))
    local, host = F.substring_index(e, "@", 1), F.substring_index(e, "@", -1)
    drawn = (
        F.when(kind == "h", _host(e, attempt, key)).when(kind == "e", F.concat(_mailbox(local, host, attempt, key), F.lit("@"), host)).when(kind == "i", _ip(e, attempt, key))
        .when(kind == "c", _card(e, attempt, key)).when(kind == "p", _phone(e, attempt, key)).when(kind == "s", _surname(e, attempt, key)).otherwise(_given(e, gender, attempt, key))
    )
    return F.concat(kind, F.lit(":"), F.lower(drawn))


def _regrouped(entity: Column, digits: Column) -> Column:
    """An entity's digits replaced by others in order; what is left over follows."""
    plain = F.regexp_replace(digits, "\\D", "")
    place = lambda i: F.length(F.regexp_replace(F.substr(entity, F.lit(1), i + 1), "\\D", ""))
    shown = F.transform(_chars(entity), lambda c, i: F.when(c.rlike("[0-9]"), F.substr(plain, place(i), F.lit(1))).otherwise(c))
    return F.concat(F.array_join(shown, ""), F.substr(plain, F.length(F.regexp_replace(entity, "\\D", "")) + 1, F.length(plain)))


def surrogate(entity: Column, look: Callable[[Column, str], Column], key: str = KEY) -> Column:
    """The replacement of an entity. ``look``: a part's attempt ("a") or gender ("g") by what is known of it; null if there is nothing to know."""
    kind = kind_of(entity)
    attempt = lambda k, known: F.coalesce(look(F.concat(F.lit(k + ":"), F.lower(known)), "a"), F.lit(0))
    local, host, digits = F.substring_index(entity, "@", 1), F.substring_index(entity, "@", -1), _digits_of(entity)
    email = F.concat(_mailbox(local, host, attempt("e", entity), key), F.lit("@"), _host(host, attempt("h", host), key))
    card, phone = (_let(f(digits, attempt(k, digits), key), lambda d: _regrouped(entity, d)) for f, k in ((_card, "c"), (_phone, "p")))
    name = _name_of(entity)
    title = F.substr(entity, F.lit(1), F.length(entity) - F.length(name))
    words = F.split(name, " ")

    def word(w, i):
        gender = F.coalesce(look(F.concat(F.lit("g:"), F.lower(w)), "g"), _gender_of(entity))
        given = F.when(w.rlike(f"^{_PARTICLE}$"), w).when(w.rlike(f"^{_INITIAL}$"), _initial(w, key)).otherwise(_given(w, gender, attempt("g", w), key))
        return F.when(i == F.size(words) - 1, _surname(w, attempt("s", w), key)).otherwise(given)

    person = F.concat(title, F.array_join(F.transform(words, word), " "))
    return F.when(kind == "email", email).when(kind == "ip", _ip(entity, attempt("i", entity), key)).when(kind == "card", card).when(kind == "phone", phone).otherwise(person)


def redrawn(parts: DataFrame, scratch: Scratch, key: str = KEY) -> DataFrame:
    """(known, attempt) of the parts that can't have their first surrogate.

    ``parts``: (known, e, g), one spelling of each. Each round draws for the losers of
    the one before only; a drawn surrogate loses if it is a real part or one that has
    been drawn before, and else unless it is the smallest of those that drew it.
    """
    real = parts.select(F.col("known").alias("s"))
    held: list[DataFrame] = []  # (known, attempt, s) of the parts that have found theirs, by round
    open_ = parts.withColumn("attempt", F.lit(0))
    for attempt in range(ATTEMPTS):
        new = scratch.cut(open_.select("known", "e", "g", "attempt", part_surrogate(F.col("known"), F.col("e"), F.col("g"), F.col("attempt"), key).alias("s")))
        first = new.groupBy("s").agg(F.min("known").alias("known"))
        taken = real
        for h in held:
            taken = taken.union(h.select("s"))
        # of the many that are taken only those that were drawn now: few after the first round
        taken = taken.join(new.select("s").distinct(), "s", "left_semi").distinct()
        won = scratch.cut(first.join(scratch.cut(taken), "s", "left_anti").select("known", F.lit(attempt).alias("attempt"), "s"))
        held.append(won)
        # as a column the attempt leaves each round's generated code the same
        lost = scratch.cut(new.join(won.select("known"), "known", "left_anti").select("known", "e", "g", (F.col("attempt") + 1).alias("attempt")))
        scratch.drop(new)
        if attempt:
            scratch.drop(open_)
        open_ = lost
        if lost.isEmpty():
            again = held[0].where("false")
            for h in held[1:]:
                again = again.union(h)
            return again.select("known", "attempt")
    raise ValueError("there are too few IPv4 numbers for the corpus's own")


def _found(text: Column, untitled: Column) -> tuple[Column, Column]:
    """The entities of a text in order, and the pattern that cuts it at them."""
    any_name = F.array_join(F.transform(untitled, lambda n: F.concat(F.lit("\\Q"), n, F.lit("\\E"))), "|")
    pattern = F.when(F.size(untitled) > 0, F.concat(F.lit("(?<![\\p{L}\\p{M}])(?:"), any_name, F.lit(f")(?![\\p{{L}}\\p{{M}}])|{ENTITY}"))).otherwise(F.lit(ENTITY))
    return F.regexp_extract_all(text, pattern, F.lit(0)), pattern


def replace_private(docs: DataFrame, key: str = KEY, text: str = "text", small: int = SMALL) -> DataFrame:
    """``docs`` with its texts' entities replaced, and ``n_entities``, the number of replaced places.

    Replaces a column of that name; others may have any name.  Null texts stay null and
    have 0; rows without entities stay as they are; repeated rows get equal texts.  A
    text's length isn't limited.  Two spellings that differ only in case are one part.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    at = f"c{docs.columns.index(text)}"
    t = F.col(at)
    none = F.array().cast("array<string>")
    titled = F.when(t.rlike(HINT), F.regexp_extract_all(t, F.lit(ENTITY), F.lit(0)))
    rows = numbered(docs).withColumn("titled", F.coalesce(titled, none))
    # names of two words or more are looked for without their form of address too, longer ones first
    full = F.transform(F.filter("titled", lambda e: e.rlike(f"^{_TITLE} .* ")), _name_of)
    full = F.reverse(F.array_sort(F.transform(F.array_distinct(F.concat(full, F.transform(full, F.upper))), lambda n: F.struct(F.length(n).alias("l"), n.alias("n")))))
    rows = rows.withColumn("untitled", F.when(F.size("titled") > 0, full["n"]).otherwise(none))
    found, pattern = _found(t, F.col("untitled"))
    rows = rows.withColumn("listed", F.when(F.size("untitled") > 0, found).otherwise(F.col("titled")))

    spelled = rows.select(F.explode("listed").alias("e")).select(F.explode(parts_of(F.col("e"))).alias("p")).select("p.*")
    known = spelled.groupBy("known").agg(F.min("e").alias("e"), F.min("g").alias("least"), F.max("g").alias("most"), F.max((F.col("g") == "f").cast("int")).alias("f"))
    gender = F.when(F.col("f") == 1, "f").when(F.col("least") == "m", "m").otherwise(F.col("most"))
    parts = scratch.cut(known.select("known", "e", gender.alias("g"), (F.col("least") != F.col("most")).alias("mixed")))
    again = redrawn(parts.select("known", "e", "g"), scratch, key)
    entry = F.struct(F.coalesce("attempt", F.lit(0)).alias("a"), F.when(F.col("mixed"), F.col("g")).alias("g")).alias("entry")
    table_of = scratch.finish(parts.join(again, "known", "left").where("attempt is not null or mixed").select("known", entry))
    n = table_of.count()

    def replaced(look: Callable[[Column, str], Column]) -> Column:
        gaps = F.split(t, pattern, -1)
        new = F.concat(F.transform("listed", lambda e: surrogate(e, look, key)), F.array(F.lit("")))
        return F.when(F.size("listed") > 0, F.array_join(F.zip_with(gaps, new, lambda a, b: F.concat(a, b)), "")).otherwise(t)

    by_map = lambda known, what: F.col("again")[known][what]
    if n == 0:
        out = rows.withColumn("new", replaced(lambda known, what: F.lit(None).cast("int" if what == "a" else "string")))
    elif n <= small:
        one = table_of.agg(F.map_from_entries(F.collect_list(F.struct("known", "entry"))).alias("again"))
        out = rows.crossJoin(F.broadcast(one)).withColumn("new", replaced(by_map))
    else:
        keyed = rows.withColumn("digest", F.sha2(t.cast("binary"), 256))
        per_text = keyed.where(F.size("listed") > 0).select("digest", F.explode("listed").alias("e")).select("digest", F.explode(parts_of(F.col("e"))["known"]).alias("known")).distinct()
        met = per_text.join(table_of, "known").groupBy("digest").agg(F.map_from_entries(F.collect_list(F.struct("known", "entry"))).alias("again"))
        out = keyed.join(met, "digest", "left").withColumn("new", replaced(by_map))
    names = docs.columns
    done = out.withColumn(at, F.col("new")).withColumn("n_entities", F.size("listed").cast("long"))
    return named(done, names, "n_entities")


def op8_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_private(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_entities", "text")


QUERIES = {"op8_surrogates": op8_surrogates}
ORACLES: dict[str, str] = {}
