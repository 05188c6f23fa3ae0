"""Personal data: detection, and keyed surrogates that keep type, format, script and gender.

A surrogate is a keyed permutation of all values of the same type and format, one that leaves no value in place. So equal
values get equal surrogates wherever they stand (coreference), different values different ones (distinctness), with no
table of what was seen. collisions() checks that over a corpus, and audited_key() takes another key if it fails.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from collections.abc import Iterator
from functools import lru_cache
from math import isqrt, prod

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm.common import as_parquet, map_rows

# Alphabets within which a character is replaced, so that script, case and kind stay.
ALPHABETS = (
    "0123456789",
    "abcdefghijklmnopqrstuvwxyz",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "àáâãäåçèéêëìíîïñòóôõöùúûüý",
    "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ",
    "αβγδεζηθικλμνξοπρστυφχψω",
    "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ",
    "абвгдежзийклмнопрстуфхцчшщъыьэюя",
    "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ",
)
VOWELS = "aeiou"
CONSONANTS = "bcdfghjklmnpqrstvwxyz"
# Given names by gender and script, family names that come first, and titles with the gender they tell.
GIVEN = {
    "f": ("Alice", "Amelia", "Amy", "Angela", "Anna", "Astrid", "Camille", "Carla", "Carmen", "Charlotte", "Clara", "Claire", "Elena", "Emily", "Emma", "Eva", "Greta", "Hannah", "Helen", "Ines", "Ingrid", "Isabel", "Jane", "Julia", "Karen", "Laura", "Linda", "Lucy", "Maria", "Marie", "Marta", "Mary", "Nicole", "Olivia", "Paula", "Pilar", "Rachel", "Rosa", "Sarah", "Sofia", "Sophie", "Susan", "Teresa", "Ursula", "Abigail", "Agnes", "Alexandra", "Andrea", "Barbara", "Beatrice", "Brenda", "Caroline", "Catherine", "Chloe", "Christina", "Deborah", "Diana", "Donna", "Dorothy", "Eleanor", "Elizabeth", "Frances", "Gabriela", "Heidi", "Jennifer", "Jessica", "Kathleen", "Katrin", "Kimberly", "Lucia", "Manuela", "Margaret", "Melissa", "Michelle", "Monika", "Nancy", "Natalie", "Patricia", "Priya", "Rebecca", "Sandra", "Sharon", "Silvia", "Stephanie", "Valentina", "Veronica", "Victoria", "Yvonne"),
    "m": ("Adam", "Alejandro", "Andrew", "Antoine", "Bernd", "Brian", "Carlos", "Charles", "Daniel", "David", "Diego", "Edward", "Erik", "Felix", "Fernando", "Frank", "George", "Hans", "Henry", "Hugo", "Jack", "James", "Javier", "John", "Jorge", "Jürgen", "Karl", "Kevin", "Klaus", "Luis", "Martin", "Michael", "Miguel", "Oscar", "Paul", "Pedro", "Peter", "Pierre", "Robert", "Stefan", "Steven", "Thomas", "William", "Wolfgang", "Alan", "Albert", "Alexander", "Alfred", "Anthony", "Arthur", "Benjamin", "Bob", "Bruno", "Christopher", "Dennis", "Dieter", "Donald", "Eduardo", "Emilio", "Enrique", "Eric", "Francisco", "Gary", "Gerhard", "Günter", "Heinrich", "Jacob", "Jason", "Jeffrey", "Jim", "Joe", "Jonathan", "Joseph", "Joshua", "Kenneth", "Larry", "Manuel", "Mario", "Matthew", "Mohammed", "Nicolas", "Patrick", "Philippe", "Raj", "Ricardo", "Richard", "Roberto", "Ronald", "Ryan", "Samuel", "Scott", "Sergio", "Stephen", "Timothy", "Tom", "Walter"),
    "f-cyrillic": ("Александра", "Алина", "Анастасия", "Анна", "Валентина", "Вера", "Галина", "Дарья", "Екатерина", "Елена", "Ирина", "Ксения", "Людмила", "Мария", "Надежда", "Наталья", "Ольга", "Светлана", "Татьяна", "Юлия"),
    "m-cyrillic": ("Александр", "Алексей", "Андрей", "Антон", "Борис", "Виктор", "Владимир", "Дмитрий", "Евгений", "Иван", "Игорь", "Константин", "Максим", "Михаил", "Николай", "Олег", "Павел", "Пётр", "Сергей", "Юрий"),
    "first": ("Cao", "Chen", "Feng", "Gao", "Huang", "Liang", "Lin", "Liu", "Luo", "Nguyen", "Tang", "Wang", "Xiao", "Xie", "Yamamoto", "Yang", "Zhang", "Zhao", "Zheng", "Zhou", "Zhu"),
}
TITLES = {"Mr": "m", "Sir": "m", "Herr": "m", "Señor": "m", "Monsieur": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Señora": "f", "Madame": "f", "Mme": "f", "Dr": "", "Prof": ""}

SECRET_CUE = r"(?:api[_-]?key|access[_-]?key|secret(?:[_-]?key)?|auth[_-]?token|token|passwd|password|pwd|bearer)"
PATTERNS = {
    "email": re.compile(r"(?<![\w.+-])[\w.+-]{1,64}@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![\w-])"),
    # After a sign that assigns, any value; after white space, one with a digit.
    "secret": re.compile(rf"\b{SECRET_CUE}\b[\"']?[ \t]*(?:[=:][ \t]*[\"']?|\s[ \t]*[\"']?(?=[A-Za-z+/_.=-]*\d))(?P<v>[A-Za-z0-9+/_.=-]{{8,}}+)(?=[\"'\s,;)]|$)", re.I),
    "key": re.compile(r"\b(?:AKIA|ASIA|ghp_|gho_|sk-|xox[abp]-)(?P<v>[A-Za-z0-9_-]{12,})\b"),
    "iban": re.compile(r"\b(?P<v>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?|[a-z]{2}\d{2}(?: ?[a-z0-9]{4}){2,7}(?: ?[a-z0-9]{1,3})?)\b"),
    "card": re.compile(r"(?<![\d.-])(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,19})(?![\d-])"),
    "ssn": re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])|(?i:\bSSN|\bsocial security(?: number| no\.?)?)[ \t:#]{1,3}(?P<w>\d{3}[ -]?\d{2}[ -]?\d{4})(?![\d-])"),
    "ip": re.compile(r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d]|\.\d)"),
    "phone": re.compile(r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}(?![\w-])|(?<![\w.])\+\d{9,15}(?!\w)"
        r"|(?<![\w.])\+\d{1,3}(?:[ .-]?\(?\d{2,4}\)?){2,5}(?![\w-])|(?<![\w.-])[2-9]\d{2}555\d{4}(?![\w-])|(?i:\b(?:tel|phone|call|mobile|cell|fax|whatsapp|telefon|teléfono|téléphone)\b[.:]?[ \t]{0,3}(?:is|at|no\.?|number)?[ \t:]{0,3})(?P<w>[2-9]\d{8,9})(?![\w-])"),
}
# Months by language and form, and the words of street addresses.
MONTHS = (
    ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"),
    ("Jan", "Feb", "Mar", "Apr", "Jun", "Jul", "Aug", "Sep", "Sept", "Oct", "Nov", "Dec"),
    ("Januar", "Februar", "März", "Mai", "Juni", "Juli", "Oktober", "Dezember"),
    ("janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre"),
    ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre"),
)
BIRTH = r"(?:born(?: on)?|date of birth|birth ?date|birthday|dob|d\.o\.b\.|geboren(?: am)?|geburtsdatum|née? le|date de naissance|nacid[oa] el|fecha de nacimiento)"
_MONTH = "|".join(sorted({m for row in MONTHS for m in row}, key=lambda m: (-len(m), m)))
_CAPITAL = r"[A-ZÄÖÜÀ-Ý][\w'’-]+"
PATTERNS |= {
    "ipv6": re.compile(r"(?<![\w:.])(?=[0-9A-Fa-f:]*[0-9A-Fa-f]{2})[0-9A-Fa-f]{0,4}(?::{1,2}[0-9A-Fa-f]{1,4}){2,7}(?:::)?(?![\w:])"),
    "birth": re.compile(rf"\b{BIRTH}[ \t]*[:=]?[ \t]*(?P<v>\d{{4}}-\d{{2}}-\d{{2}}|\d{{1,2}}([./-])\d{{1,2}}\2\d{{4}}|\d{{1,2}}\.?[ \t](?:de[ \t])?(?:{_MONTH})[ \t](?:de[ \t])?\d{{4}}|(?:{_MONTH})[ \t]\d{{1,2}},?[ \t]\d{{4}})(?!\d)", re.I),
    "address": re.compile(
        rf"(?<![\w.])(?:\d{{1,5}}[ \t](?:{_CAPITAL}[ \t]){{1,3}}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Boulevard|Blvd|Court|Ct|Way|Square|Place|Terrace)"
        rf"|[A-ZÄÖÜ][a-zäöüß]+(?:straße|strasse|weg|platz|allee|gasse)[ \t]\d{{1,4}}"
        rf"|\d{{1,4}},?[ \t](?:[Rr]ue|[Aa]venue|[Bb]oulevard|[Pp]lace|[Cc]hemin|[Aa]llée)[ \t](?:d[eu]s?[ \t](?:la[ \t])?)?{_CAPITAL}(?:[ \t]{_CAPITAL}){{0,2}}"
        rf"|(?:Calle|Avenida|Plaza|Paseo)[ \t](?:del?[ \t](?:la[ \t])?)?{_CAPITAL}(?:[ \t]{_CAPITAL}){{0,2}},?[ \t]\d{{1,4}})(?!\w)"
    ),
}
#: What stays of an address: the words that make it one.
STREET = re.compile(r"^(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Boulevard|Blvd|Court|Ct|Way|Square|Place|Terrace|[Rr]ue|avenue|boulevard|place|[Cc]hemin|[Aa]llée|Calle|Avenida|Plaza|Paseo|d[eu]s?|del|la)$")
STREET_END = re.compile(r"(?:straße|strasse|weg|platz|allee|gasse)$")
_WORDS = r"[A-ZÀ-ÝА-ЯΑ-Ω][\w'’-]+"
_GIVEN = [n for pool in GIVEN.values() for n in pool]
_SHOUTED = [n.upper() for n in _GIVEN]
KNOWN_NAMES = frozenset(TITLES) | frozenset(_GIVEN) | frozenset(_SHOUTED)
CAPITALISED = re.compile(r"[A-ZÀ-ÝА-ЯΑ-Ω]\w*").findall


@lru_cache(maxsize=1024)
def name_pattern(known: tuple[str, ...]) -> re.Pattern:
    """A name after a title, or a given name (or a family name that comes first) with more names after it, in capitals throughout or not,
    of those titles and names that a text has."""
    some = lambda names: "|".join(n for n in known if n in names) or "(?!)"
    return re.compile(
        rf"\b(?:(?:{some(TITLES)})\.?[ \t]+(?P<v>{_WORDS}(?:[ \t]{_WORDS}){{0,2}})|(?P<u>(?:{some(_GIVEN)})(?:[ \t]{_WORDS}){{1,2}}|(?:{some(_SHOUTED)})(?:[ \t][A-ZÀ-ÝА-ЯΑ-Ω]{{2,}}){{1,2}})(?![\w]))"
    )


POSSESSIVE = re.compile(r"['’]s?(?=\s|$)")
#: The pool of a given name, by its small letters.
POOL = {n.lower(): (group, n) for group, pool in GIVEN.items() for n in pool}
#: Where two finds overlap, the earlier type here keeps the text.
ORDER = ("email", "key", "secret", "iban", "card", "ssn", "ipv6", "ip", "phone", "birth", "address", "name")


class Permutation:
    """A keyed permutation of 0 to n - 1 without fixed points: q(q^-1(x) + 1), q being a Feistel network, walked until inside."""

    ROUNDS = 6

    def __init__(self, key: bytes, label: str, n: int):
        self.n, self.a = n, isqrt(n - 1) + 1
        self.key = hashlib.blake2b(f"{label}/{n}".encode(), key=key, digest_size=32).digest()

    def _f(self, k: int, x: int) -> int:
        return int.from_bytes(hashlib.blake2b(x.to_bytes((x.bit_length() + 7) // 8 or 1, "big"), key=self.key, salt=bytes([k]), digest_size=32).digest(), "big") % self.a

    def _q(self, x: int, ahead: bool) -> int:
        while True:
            left, right = divmod(x, self.a)
            for k in range(self.ROUNDS) if ahead else reversed(range(self.ROUNDS)):
                if ahead:
                    left, right = right, (left + self._f(k, right)) % self.a
                else:
                    left, right = (right - self._f(k, left)) % self.a, left
            x = left * self.a + right
            if x < self.n:
                return x

    def __call__(self, x: int) -> int:
        return x if self.n < 2 else self._q((self._q(x, False) + 1) % self.n, True)


class WidePermutation:
    """The same for the product of many choices, given by their sizes, in time in proportion to their number.

    The Feistel network's halves are rows of digits, to which rows of keyed digits are added, so no number is ever made.
    """

    ROUNDS = 6

    def __init__(self, key: bytes, label: str, sizes: list[int]):
        self.key, self.label, self.sizes, self.middle = key, label.encode(), sizes, len(sizes) // 2

    def _q(self, digits: list[int], ahead: bool) -> list[int]:
        halves, sizes = [digits[: self.middle], digits[self.middle :]], (self.sizes[: self.middle], self.sizes[self.middle :])
        for k in range(self.ROUNDS) if ahead else reversed(range(self.ROUNDS)):
            to, sign = k % 2, 1 if ahead else -1
            other = b"".join(x.to_bytes(4, "big") for x in halves[1 - to])
            seed = hashlib.blake2b(self.label + b"/%d/" % k + other, key=self.key[:64], digest_size=64).digest()
            drawn = memoryview(hashlib.shake_256(seed).digest(8 * len(halves[to]))).cast("Q").tolist()
            halves[to] = [(x + sign * y) % n for x, y, n in zip(halves[to], drawn, sizes[to], strict=True)]
        return halves[0] + halves[1]

    def __call__(self, digits: list[int]) -> list[int]:
        digits = self._q(digits, False)
        for k in reversed(range(len(digits))):  # plus one
            digits[k] = (digits[k] + 1) % self.sizes[k]
            if digits[k]:
                break
        return self._q(digits, True)


@lru_cache(maxsize=4096)
def permutation(key: bytes, label: str, n: int) -> Permutation:
    return Permutation(key, label, n)


#: Values of more characters that change are permuted digit by digit; a number's halves are no longer than a hash up to here.
WIDE = 64


def permute(key: bytes, label: str, values: list[str], choices: list[str]) -> list[str]:
    """Values, each one of its choices (one-character strings or words), replaced within the product of the choices."""
    shape = hashlib.blake2b("|".join("".join(c) for c in choices).encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()
    if sum(len(c) > 1 for c in choices) > WIDE:
        digits = WidePermutation(key, f"{label}/{shape}", [len(c) for c in choices])([c.index(v) for v, c in zip(values, choices, strict=True)])
        return [c[k] for c, k in zip(choices, digits, strict=True)]
    number = 0
    for v, c in zip(values, choices, strict=True):
        number = number * len(c) + c.index(v)
    number = permutation(key, f"{label}/{shape}", prod(map(len, choices)))(number)
    out = []
    for c in reversed(choices):
        number, k = divmod(number, len(c))
        out.append(c[k])
    return out[::-1]


@lru_cache(maxsize=4096)
def alphabet(c: str) -> str:
    return next((a for a in ALPHABETS if c in a), c)


def by_class(key: bytes, label: str, text: str) -> str:
    """Every letter and digit replaced by one of its alphabet; other characters stay."""
    return "".join(permute(key, label, list(text), [alphabet(c) for c in text]))


def luhn(digits: str) -> int:
    """The Luhn sum modulo 10; 0 for a valid number."""
    return sum(sum(divmod(2 * int(d), 10)) if k % 2 else int(d) for k, d in enumerate(reversed(digits))) % 10


def refill(text: str, digits: str) -> str:
    """text with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if "0" <= c <= "9" else c for c in text)


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _card(key: bytes, text: str) -> str:
    """The brand digit and whether the Luhn sum holds stay."""
    d = digits_of(text)
    body = d[0] + "".join(permute(key, f"card{d[0]}", list(d[1:-1]), ["0123456789"] * (len(d) - 2)))
    return refill(text, body + str((luhn(d) - luhn(body + "0")) % 10))


EXCHANGES = (["555"], [f"{k:03d}" for k in range(200, 1000) if k != 555], [f"{k:03d}" for k in range(200)])


def _phone(key: bytes, text: str) -> str:
    """The country code, a first digit's class and the exchange 555 of invented numbers stay; the format too."""
    d = digits_of(text)
    national = d[-10:] if len(d) > 10 else d
    values, choices = list(national), ["0123456789"] * len(national)
    choices[0] = "23456789" if national[0] in "23456789" else "01"
    if len(national) == 10:  # each exchange stays in its class, so that no two classes meet
        values[3:6], choices[3:6] = [national[3:6]], [next(e for e in EXCHANGES if national[3:6] in e)]
    return refill(text, d[: len(d) - len(national)] + "".join(permute(key, "phone", values, choices)))


PUBLIC = [str(k) for k in range(1, 224) if k not in (10, 127, 169, 172, 192)]
OCTETS = [str(k) for k in range(256)]


def _ip(key: bytes, text: str) -> str:
    """Private and other special ranges keep their first octets."""
    parts = [str(int(p)) for p in text.split(".")]
    choices = [PUBLIC if parts[0] in PUBLIC else [parts[0]], OCTETS if parts[0] in PUBLIC or parts[0] in ("10", "127") else [parts[1]], OCTETS, OCTETS]
    return ".".join(permute(key, "ip", parts, choices))


def _email(key: bytes, text: str) -> str:
    """Names before the @ and domain labels change; the top-level domain and reserved example domains stay."""
    local, domain = text.rsplit("@", 1)
    *labels, top = domain.split(".")
    keep = len(labels) - 1 if labels and labels[-1].lower() == "example" else len(labels)
    body = f"{local}@{'.'.join(labels[:keep])}"
    low = body.lower() if len(body.lower()) == len(body) else body
    new = by_class(key, "email", low)
    new = "".join(n.upper() if c.isupper() and len(n.upper()) == 1 else n for c, n in zip(body, new, strict=True))
    return ".".join([new, *labels[keep:], top]) if keep else f"{new}{'.'.join([*labels, top])}"


def _secret(key: bytes, text: str) -> str:
    if not text.strip("0123456789abcdef"):
        return "".join(permute(key, "hex", list(text), ["0123456789abcdef"] * len(text)))
    new = by_class(key, "secret", text)
    while not new.strip("0123456789abcdef"):  # on along the permutation's one cycle, past the values that are permuted above
        new = by_class(key, "secret", new)
    return new


def _iban(key: bytes, text: str) -> str:
    """The country stays and, where the check digits held, they hold."""
    flat = text.replace(" ", "")
    number = lambda s: int("".join(str(int(c, 36)) for c in s))
    body = by_class(key, "iban" + flat[:2], flat[4:])
    valid = number(flat[4:] + flat[:4]) % 97 == 1
    check = f"{98 - number(body + flat[:2] + '00') % 97:02d}" if valid else flat[2:4]
    it = iter(flat[:2] + check + body)
    return "".join(c if c == " " else next(it) for c in text)


def _word(key: bytes, word: str) -> str:
    """A name that can be spoken, of the same length, case and script; its last letter, which often tells gender, stays."""
    choices = []
    for k, c in enumerate(word):
        low = c.lower()
        kind = VOWELS if low in VOWELS else CONSONANTS if low in CONSONANTS else alphabet(low)
        choices.append(low if k == len(word) - 1 and k else kind)
    new = permute(key, "name", list(word.lower()), choices) if len(word.lower()) == len(word) else list(word)
    return "".join(n.upper() if c.isupper() and len(n.upper()) == 1 else n for c, n in zip(word, new, strict=True))


def _name(key: bytes, word: str) -> str:
    """A name of the pool for one of the pool, in the same case; another word for one that is in no pool."""
    if word.lower() in POOL:
        group, name = POOL[word.lower()]
        new = permute(key, f"given-{group}", [name], [list(GIVEN[group])])[0]
        return new if word == name else new.upper() if word == word.upper() else new.lower() if word == word.lower() else new
    new = _word(key, word)
    while new.lower() in POOL:  # on along the cycle
        new = _word(key, new)
    return new


def _ipv6(key: bytes, text: str) -> str:
    """Groups and their lengths stay; capital digits stay capital."""
    return "".join(permute(key, "ipv6", list(text), [c if c == ":" else "ABCDEF" if c in "ABCDEF" else "0123456789abcdef" for c in text]))


LONG_MONTHS = (1, 3, 5, 7, 8, 10, 12)


def _date(key: bytes, text: str) -> str:
    """Another date in the same form and century: days to the 28th, the 29th and 30th, and the 31st stay among themselves."""
    parts = re.findall(r"\d+|[^\W\d_]+|[\W_]+", text)
    at = [k for k, p in enumerate(parts) if p.isdigit()]
    year = next(k for k in at if len(parts[k]) == 4)
    named = next((k for k, p in enumerate(parts) if any(p.lower() == m.lower() for row in MONTHS for m in row)), None)
    rest = [k for k in at if k != year]
    day = rest[0] if named is not None else max(rest) if rest[0] > year else next((k for k in rest if int(parts[k]) > 12), None)
    choices: list[list[str]] = [[p] for p in parts]
    form = lambda k, values: [v for n in values if len(v := f"{n:0{len(parts[k])}d}") == len(parts[k])]
    choices[year] = [f"{parts[year][:2]}{k:02d}" for k in range(100)]
    if named is not None:
        row = next(r for r in MONTHS if any(parts[named].lower() == m.lower() for m in r))
        parts[named] = next(m for m in row if m.lower() == parts[named].lower())
        choices[named] = list(row) if int(parts[day]) <= 28 else [parts[named]]
        choices[day] = form(day, range(1, 29)) if int(parts[day]) <= 28 else [parts[day]]
    elif day is None:  # both could be the month
        for k in rest:
            choices[k] = form(k, range(1, 13))
    else:
        month, n = next(k for k in rest if k != day), int(parts[day])
        span = range(1, 29) if n <= 28 else (29, 30) if n <= 30 else (31,)
        if rest[0] < year and 12 < n <= 28:  # its order is told by a day beyond 12
            span = range(13, 29)
        months = range(1, 13) if n <= 28 else [m for m in range(1, 13) if m != 2] if n <= 30 else LONG_MONTHS
        if n > 28 and int(parts[month]) == 2:
            months, span = (2,), (29,)
            choices[year] = [y for y in choices[year] if int(y) % 4 == 0 and (int(y) % 100 or int(y) % 400 == 0)]
        choices[day], choices[month] = form(day, span), form(month, months)
    if any(p not in c for p, c in zip(parts, choices, strict=True)):  # no date: its digits change as any would
        return by_class(key, "birth", text)
    return "".join(permute(key, "birth", parts, choices))


def _address(key: bytes, text: str) -> str:
    """House number, of the same length, and the street's own words change; the words that make it an address stay."""

    def change(m: re.Match) -> str:
        word = m[0]
        if word.isdigit():
            return "".join(permute(key, "house", list(word), ["123456789" if word[0] != "0" else "0", *["0123456789"] * (len(word) - 1)]))
        if STREET.match(word):
            return word
        end = STREET_END.search(word)
        return _name(key, word[: end.start()]) + end[0] if end and end.start() else _name(key, word)

    return re.sub(r"[\w’']+", change, text)


MAKE = {"ipv6": _ipv6, "birth": _date, "address": _address, "email": _email, "key": by_class, "secret": _secret, "iban": _iban, "card": _card, "ssn": _phone, "ip": _ip, "phone": _phone}


@lru_cache(maxsize=65536)
def surrogate(key: bytes, kind: str, value: str) -> str:
    if kind == "name":
        return re.sub(r"[\w’']+", lambda m: _name(key, m[0]), value)
    if kind == "key":
        return by_class(key, "key", value)
    return MAKE[kind](key, value)


def _checks(iban: str) -> bool:
    flat = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1


def _is_ipv6(text: str) -> bool:
    try:
        ipaddress.IPv6Address(text)
    except ValueError:
        return False
    return True


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, type) of the personal data in a whole text, in order and without overlaps."""
    found: list[tuple[int, int, str]] = []

    def add(kind: str) -> None:
        for m in PATTERNS[kind].finditer(text):
            at = next((m.span(g) for g in ("v", "w") if g in PATTERNS[kind].groupindex and m[g] is not None), m.span())
            value = text[slice(*at)]
            if kind == "ip" and not all(int(p) < 256 and (p == "0" or p[0] != "0") for p in value.split(".")):
                continue
            if kind == "ipv6" and not _is_ipv6(value):
                continue
            if kind == "phone" and not 7 <= len(digits_of(value)) <= 15:
                continue
            if kind == "iban" and (len(value.replace(" ", "")) < 15 or value == value.lower() and not _checks(value)):
                continue
            found.append((*at, kind))

    if "@" in text:
        add("email")
    for kind in ("key", "secret"):
        if GUARDS[kind](text):
            add(kind)
    if DIGIT(text):
        for kind in ("iban", "card", "ssn", "ipv6", "ip", "phone", "birth", "address"):
            if GUARDS[kind](text):
                add(kind)
    names: set[str] = set()
    known = KNOWN_NAMES.intersection(CAPITALISED(text))
    for m in name_pattern(tuple(sorted(known))).finditer(text) if known else ():
        which = "v" if m["v"] else "u"
        value = POSSESSIVE.split(m[which], maxsplit=1)[0]
        start = m.start(which)
        found.append((start, start + len(value), "name"))
        parts = value.split()
        names |= {value, parts[-1]} if len(parts) > 1 else set(parts)
    if names:  # mentions without the title, in the possessive too; of more names than one, in any case
        whole = [n for n in names if " " in n]
        some = lambda names: "|".join(map(re.escape, sorted(names, key=lambda n: (-len(n), n))))
        each = ([f"(?i:{some(whole)})"] if whole else []) + [some({n for n in names} | {n.upper() for n in names})]
        again = re.compile(r"(?<![\w'’-])(?:" + "|".join(each) + r")(?=['’]s?(?!\w)|(?![\w'’-]))")
        found += [(*m.span(), "name") for m in again.finditer(text)]
    found.sort(key=lambda x: (ORDER.index(x[2]), x[0], -x[1]))
    taken: list[tuple[int, int, str]] = []
    for kind in ORDER:
        mine = [x for x in found if x[2] == kind]
        if mine:
            old = iter(sorted(taken))
            free, near = [], next(old, None)
            last = 0
            for x in sorted(mine, key=lambda x: (x[0], -x[1])):
                while near and near[1] <= x[0]:
                    near = next(old, None)
                if x[0] >= last and not (near and near[0] < x[1]):
                    free.append(x)
                    last = x[1]
            taken += free
    return sorted(taken)


DIGIT = re.compile(r"\d").search
GUARDS = {
    "key": re.compile(r"AKIA|ASIA|gh[po]_|sk-|xox").search,
    "secret": re.compile(r"token|secret|key|passw|pwd|bearer", re.I).search,
    "iban": re.compile(r"[A-Z]{2}\d\d|[a-z]{2}\d\d").search,
    "card": re.compile(r"\d{4}").search,
    "ssn": re.compile(r"\d-\d\d-|\b(?:SSN|social security)", re.I).search,
    "ip": re.compile(r"\d\.\d+\.").search,
    "phone": re.compile(r"\d{3,4}[ .-]\d{3,4}|\+\d|\d{9}").search,
    "ipv6": re.compile(r"[0-9A-Fa-f]:[0-9A-Fa-f:]").search,
    "birth": re.compile(rf"\b{BIRTH}", re.I).search,
    "address": re.compile(r"\d,?[ \t][\w]|\w[ \t]\d").search,
}


def replace(text: str | None, key: bytes) -> tuple[str | None, list[dict]]:
    """The text with surrogates, and the entities: type, place in the new text, and a keyed digest of what stood there."""
    if not text:
        return text, []
    out, entities, last, length = [], [], 0, 0
    for start, end, kind in find(text):
        old = text[start:end]
        new = surrogate(key, kind, old)
        out += [text[last:start], new]
        length += start - last
        entities.append({"type": kind, "start": length, "end": length + len(new), "digest": hashlib.blake2b(f"{kind}:{old}".encode("utf-8", "surrogatepass"), key=key, digest_size=8).hexdigest(), "surrogate": new})
        length += len(new)
        last = end
    return "".join(out) + text[last:], entities


ENTITIES = "array<struct<type:string,start:int,end:int,digest:string,surrogate:string>>"


def pseudonymise(docs: DataFrame, key: bytes) -> DataFrame:
    """All columns of the documents with surrogates in text (and n_chars after it), and the column entities.

    Null and empty texts stay as they are and have no entities; texts of any length are read whole, in one task each. Where
    finds of two types overlap, the type that ORDER names first keeps the text. A column that is itself named entities is
    replaced. Repeated rows and equal values in any rows get the same surrogates.
    """
    docs = docs.drop("entities")
    names = docs.columns

    def run(rows: Iterator[dict]) -> Iterator[dict]:
        for row in rows:
            text, entities = replace(row["text"], key)
            if entities and "n_chars" in names:
                row["n_chars"] = len(text)
            yield row | {"text": text, "entities": entities}

    return map_rows(docs, run, ", ".join(f"`{n}` {t}" for n, t in docs.dtypes) + f", entities {ENTITIES}")


def collisions(found: DataFrame) -> DataFrame:
    """(type, surrogate) that stand for different values, over a whole corpus: none, or distinctness is lost.

    Two extremes of the digests are enough, so that a value found in a third of all rows is combined before the shuffle.
    """
    each = found.select(F.explode("entities").alias("e")).select("e.type", "e.surrogate", "e.digest")
    return each.groupBy("type", "surrogate").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).where("a != b").select("type", "surrogate")


#: Where a session keeps the key, put there from a secret store, and the key of tests and checks where it has none.
KEY_SETTING, DEFAULT_KEY = "spark.tidemark.pii.key", "tidemark-surrogates"


def session_key(spark: SparkSession) -> bytes:
    return spark.conf.get(KEY_SETTING, DEFAULT_KEY).encode()


def audited(docs: DataFrame, key: bytes, tries: int = 4) -> DataFrame:
    """pseudonymise(docs, key), written and audited: if its surrogates collide, with the first of the keys derived from it whose
    don't. Texts are searched once; only surrogates and digests are shuffled, combined before. Raises ValueError if every key
    has collisions."""
    for k in range(tries):
        out = as_parquet(pseudonymise(docs, _derived(key, k)))
        if collisions(out).isEmpty():
            return out
    raise ValueError(f"surrogates of different values collide under {tries} keys")


def _derived(key: bytes, k: int) -> bytes:
    return hashlib.blake2b(b"key %d" % k, key=key[:64], digest_size=32).digest() if k else key


def audited_key(docs: DataFrame, key: bytes, tries: int = 4) -> bytes:
    """key if its surrogates of these documents don't collide, else the first of the keys derived from it that has none.

    Only surrogates and digests are shuffled, combined before. Raises ValueError if every key has collisions.
    """

    def run(rows: Iterator[dict]) -> Iterator[dict]:
        for row in rows:
            entities = replace(row["text"], use)[1]
            if entities:
                yield {"entities": entities}

    for k in range(tries):
        use = _derived(key, k)
        if collisions(map_rows(docs.select("text"), run, f"entities {ENTITIES}")).isEmpty():
            return use
    raise ValueError(f"surrogates of different values collide under {tries} keys")
