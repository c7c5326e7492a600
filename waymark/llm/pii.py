"""Private data: detection, and surrogates that are keyed, type-consistent and distinct.

Entities: e-mail addresses of any script, IBANs (with a right checksum), IPv4 addresses, social security numbers, card-like numbers of
13 to 19 digits, telephone numbers, in ASCII or other decimal digits, and personal names (after a title, or a known given name before
a capitalised word; then the same words wherever the text has them again, unless it also has them in lower case). Every entity of a
text is replaced; what is written the same (but for case) gets the same surrogate in all documents, as long as the key stays.

The key comes from the session's setting SETTING. Without one, a key is drawn for the application: surrogates then agree in all its
documents and queries, but not with those of another application.

Distinctness: numbers and addresses go through a keyed permutation of all values of their form that leaves none as it is (a rotation
between a Feistel network and its inverse, walked to the next allowed value), so no two meet: letters stay letters of their script,
digits digits, case and separators stay, checksums and public or valid ranges hold. Known given names go through a keyed cycle of the
names of their gender and script. Other given names, whose gender is that of their title, and surnames get syllables of their script
from a keyed hash, with an ending of their gender; surnames that agree in gender share a stem. As these could meet, all of the corpus
are checked, and those that meet, or would become a word that is there, are drawn again.

Edge cases: null texts stay null, empty ones empty; overlapping finds: the earlier kind in KINDS wins; null and repeated doc_ids make
no difference, as nothing depends on them; equal texts become equal; a very long text is read whole, in time near linear; extra
columns stay whatever their names, but those named like an added one are replaced; an empty table gives none; clean texts stay as they
are, byte for byte.
"""

from __future__ import annotations

import functools
import hashlib
import hmac
import os
import re
import sys
import unicodedata
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, mapped, materialise, packed, small_batches, table, unpacked

#: The setting that names the key; its name is one that Spark redacts.
SETTING = "spark.waymark.surrogate.secret"
KINDS = ("email", "iban", "ip", "ssn", "card", "phone", "name")
NAMES = ("given", "called", "surname")

# Given names by script and gender, in the cycle's order before the key shuffles them.
GIVEN = {
    ("latin", "f"): "Alice Anna Barbara Catherine Charlotte Claire Elena Elizabeth Emma Eva Hannah Helen Isabel Jennifer Julia Karen Laura Linda Lucia Margaret Maria Martha Mary Nicole Patricia Sarah Sofia Susan Teresa Victoria".split(),
    ("latin", "m"): "Albert Alexander Andrew Anthony Antonio Carlos Charles Christopher Daniel David Edward Francisco George Hans Henry James Jean John Joseph Lucas Martin Michael Pablo Paul Peter Richard Robert Stefan Thomas William".split(),
    ("cyrillic", "f"): "Анна Вера Елена Ирина Мария Надежда Наталья Ольга Светлана Татьяна".split(),
    ("cyrillic", "m"): "Александр Алексей Андрей Борис Виктор Дмитрий Иван Михаил Николай Сергей".split(),
    ("greek", "f"): "Αικατερίνη Άννα Βασιλική Γεωργία Ελένη Ευαγγελία Ιωάννα Μαρία Σοφία Χριστίνα".split(),
    ("greek", "m"): "Αθανάσιος Βασίλειος Γεώργιος Δημήτριος Ευάγγελος Ιωάννης Κωνσταντίνος Νικόλαος Παναγιώτης Χρήστος".split(),
    ("arabic", "f"): "عائشة فاطمة خديجة زينب سلمى ليلى منى نادية هدى ياسمين".split(),
    ("arabic", "m"): "أحمد إبراهيم حسن حسين خالد سعيد عبدالله علي عمر محمد محمود مصطفى يوسف".split(),
}
# Titles by the gender they tell; n: either.
TITLES = {
    "m": "Mr Sir Herr Monsieur Señor Sr Г-н Господин Κύριος السيد".split(),
    "f": "Mrs Ms Miss Frau Madame Mme Señora Sra Doña Г-жа Госпожа Κυρία السيدة".split(),
    "n": "Dr Prof الدكتور الدكتورة".split(),
}
# Endings of surnames that agree with their bearer, masculine and feminine.
AGREEING = (("ский", "ская"), ("цкий", "цкая"), ("ов", "ова"), ("ев", "ева"), ("ёв", "ёва"), ("ин", "ина"), ("ын", "ына"), ("ski", "ska"), ("cki", "cka"), ("όπουλος", "οπούλου"), ("ίδης", "ίδου"), ("άδης", "άδου"), ("άκης", "άκη"))
SYLLABLES = {
    "latin": [c + v for c in "bdfgklmnprstvz" for v in ("a", "e", "i", "o", "u", "an", "er")],
    "cyrillic": [c + v for c in "бвгдзклмнпрст" for v in "аеиоу"],
    "greek": [c + v for c in "βγδζκλμνπρστφ" for v in "αειου"],
    "arabic": [c + v for c in "بتجدرزسشعفقكلمنه" for v in "اوي"],
}
#: What given names out of syllables end in.
ENDINGS = {("latin", "f"): "na", ("latin", "m"): "rik", ("cyrillic", "f"): "на", ("cyrillic", "m"): "мир", ("greek", "f"): "νη", ("greek", "m"): "νος", ("arabic", "f"): "ة", ("arabic", "m"): "ن"}
_GIVEN_OF = {n.casefold(): (s, g, i) for (s, g), names in GIVEN.items() for i, n in enumerate(names)}

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_MARK = "\u0300-\u036f"
EMAIL = re.compile(rf"(?<![\w{_MARK}.%+-])[\w%+-][\w{_MARK}.%+'-]*@(?:[^\W_](?:[\w{_MARK}-]*[^\W_][{_MARK}]*)?\.)+(?:[^\W\d_]{{2,}}|xn--[a-z0-9-]+)")
IBAN = re.compile(r"(?<!\w)[A-Za-z]{2}\d{2}(?: ?[A-Za-z0-9]{4}){2,7}(?: ?[A-Za-z0-9]{1,4})?(?!\w)", re.A)

IP = re.compile(rf"(?<![\w.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\w|\.\d)", re.A)
SSN = re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])", re.A)
CARD = re.compile(r"(?<![\w.-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){2}[ -]\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?![\w-])", re.A)
PHONE = re.compile(r"(?<![\w.-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}(?![\w-])|(?<![\w.-])\+\d{9,14}(?![\w-])", re.A)
#: Forms by country: a code and groups of any size; an area code in brackets, after Russia's 8 or not; a trunk zero, with a slash or not.
PHONES = re.compile(
    r"(?<![\w.+-])(?:\+\d{1,3}(?:[ ./-]?\(\d{1,5}\)|[ ./-]\d{1,5})(?:[ ./-]?\d{2,8}){1,4}|(?:8[ -]?)?\(\d{2,5}\)[ ./-]?\d{2,4}(?:[ .-]\d{2,4}){1,3}|(?:8[ -]\d{3}[ -]\d{3}(?:[ -]\d{2}){2})|0\d{2,5}(?:[/ -]| / )\d{5,9}(?:[ -]\d{1,5})?|0\d{1,5}(?:[/ -]| / )\d{2,4}(?:[ -]\d{2,5}){2,4})(?![\w-]|[./]\d)", re.A,
)
#: A number without separators is one of a telephone only after a word that says so.
PHONE_WORD = re.compile(r"(?<!\w)(?:tele(?:ph|f)one?|t[eé]l[eé](?:ph|f)on[eo]?|tel|t[eé]l|phone|mobile|mobil|handy|cell|fax|call|text|anrufen|ruf|телефон|тел|моб|звоните|τηλ[έε]φωνο|τηλ|κινητό|هاتف|جوال|تلفون)(?!\w)\.?(?: (?:no\.?|nr\.?|number|nummer|is|at|me at|us at|on))?:? ?(\d{7,14})(?!\w|[.-]\d)", re.I)
# Country codes of one and two digits; all others have three.
CODES = ("1", "7", *"20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())

def _runs(numbers: Iterator[int]) -> Iterator[tuple[int, int]]:
    """(first, last) of runs of numbers that follow each other."""
    first = last = None
    for n in numbers:
        if last is not None and n == last + 1:
            last = n
            continue
        if first is not None:
            yield first, last
        first = last = n
    if first is not None:
        yield first, last


_UPPER = "".join(f"{chr(a)}-{chr(b)}" if a < b else chr(a) for a, b in _runs(c for c in range(0x10000) if unicodedata.category(chr(c)) in ("Lu", "Lt")))
_LETTER = rf"[^\W\d_][{_MARK}]*"
_CAP = rf"(?:[{_UPPER}](?:[{_MARK}]*(?:{_LETTER})+(?:['’-](?:{_LETTER})+)*|(?:['’-](?:{_LETTER})+)+))"
_WORD = rf"(?:(?:{_LETTER})+(?:['’-](?:{_LETTER})+)*)"
_ARABIC = "[\u0621-\u064a\u064b-\u0652]+"
_KNOWN = [x for (s, _), names in GIVEN.items() if s != "arabic" for n in names for x in (n, n.upper())]
_TITLED = [x for titles in TITLES.values() for t in titles if t.isascii() or t[0].upper() != t[0].lower() for x in dict.fromkeys((t, t.upper()))]
_GENDER = {t.casefold(): g for g, titles in TITLES.items() for t in titles}
_either = lambda words: "|".join(map(re.escape, words))
NAME = re.compile(rf"(?<!\w)(?:(?P<title>{_either(_TITLED)})\.? (?P<titled>{_CAP}(?: {_CAP})?)|(?P<known>(?:{_either(_KNOWN)}) {_CAP}))(?![\w{_MARK}])")
#: Without capitals only a title before a known given name is taken for one.
LOW_TITLES = ("mr", "mrs", "ms", "miss", "dr", "prof", "herr", "frau")
LOW_NAME = re.compile(rf"(?<!\w)(?P<title>{'|'.join(LOW_TITLES)})\.? (?P<titled>(?:{_either(n.lower() for (s, _), names in GIVEN.items() if s == 'latin' for n in names)})(?: {_WORD})?)(?![\w{_MARK}])")
#: Arabic has no capitals: words after a title, or a known given name before a word with the article.
ARABIC_NAME = re.compile(rf"(?<!\w)(?:(?P<title>{_either(t for ts in TITLES.values() for t in ts if t > 'ء')}) (?P<titled>{_ARABIC}(?: {_ARABIC})?)|(?P<known>(?:{_either(n for (s, _), names in GIVEN.items() if s == 'arabic' for n in names)}) ال{_ARABIC}))(?!\w)")
#: A text without any of these words has no name; finding that out is much faster than the pattern.
_TRIGGERS = {re.split("-", w)[0] for w in (*_TITLED, *_KNOWN)}
_CAPITAL = re.compile("[A-ZÀ-ÞΆ-ΫЀ-Я][^\\W\\d_]*")
_MENTION = re.compile(rf"(?<![\w{_MARK}])(?:{_CAP}|{_ARABIC})(?![\w{_MARK}])")


def mac(key: str, *parts: str) -> int:
    return int.from_bytes(hmac.new(key.encode(), "\0".join(parts).encode("utf-8", "surrogatepass"), hashlib.blake2b).digest()[:16], "little")


_DRAWN: dict[str, str] = {}


def secret_of(spark: SparkSession) -> str:
    """The session's key, or one drawn for the application where none is set."""
    return spark.conf.get(SETTING, None) or _DRAWN.setdefault(spark.sparkContext.applicationId, os.urandom(32).hex())


def permuted(key: str, kind: str, x: int, n: int, allowed: Callable[[int], bool] = lambda _: True) -> int:
    """A keyed permutation of the allowed numbers below n that moves each: x goes to the one after it on a keyed cycle of all."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1

    def walked(x: int, rounds: range, back: bool) -> int:
        """Feistel rounds over enough bits, walked until the number is below n."""
        while True:
            a, b = x >> half, x & mask
            for r in rounds:
                if back:
                    a, b = b ^ (mac(key, kind, str(n), str(r), str(a)) & mask), a
                else:
                    a, b = b, a ^ (mac(key, kind, str(n), str(r), str(b)) & mask)
            x = a << half | b
            if x < n:
                return x

    while n > 1:
        x = walked((walked(x, range(8), False) + 1) % n, range(7, -1, -1), True)
        if allowed(x):
            break
    return x


def _simple(c: str) -> bool:
    """Whether a letter has a lower and an upper form of one character each that lead to each other."""
    low, up = c.lower(), c.upper()
    return low != up and len(low) == len(up) == 1 and low.upper() == up and up.lower() == low and c in (low, up)


@functools.lru_cache(maxsize=1)
def _classes() -> dict[tuple, str]:
    """The letters, digits and marks beyond ASCII by block, category and case; classes of few members are one for all blocks."""
    found: dict[tuple, list[str]] = {}
    for k in range(128, sys.maxunicode + 1):
        c = chr(k)
        cat = unicodedata.category(c)
        if cat[0] in "LMN" and not (_simple(c) and c != c.lower()):
            found.setdefault(_class(c), []).append(c)
    out: dict[tuple, list[str]] = {}
    for name, members in found.items():
        out.setdefault(name if len(members) >= 10 else (-1, *name[1:]), []).extend(members)
    return {name: "".join(members) for name, members in out.items()}


def _class(c: str) -> tuple:
    usual = next((a for a, b in (("а", "я"), ("α", "ω"), ("à", "þ")) if a <= c <= b and _simple(c)), "")
    return (ord(c) >> 8, unicodedata.category(c), _simple(c), usual)


@functools.lru_cache(maxsize=65536)
def alphabet(c: str) -> str:
    """The characters that this one, in lower case where it has one, may become; empty where it stays. They share their alphabet."""
    if c.isascii():
        return "0123456789" if c.isdigit() else "abcdefghijklmnopqrstuvwxyz" if c.isalpha() else ""
    if unicodedata.category(c)[0] not in "LMN":
        return ""
    name = _class(c)
    return _classes().get(name) or _classes()[(-1, *name[1:])]


def reformed(key: str, kind: str, text: str, fixed: Callable[[int, str], bool] = lambda i, c: False) -> str:
    """A keyed permutation of texts of one form: letters, digits and marks change within their alphabet, all else stays; case stays."""
    low = [c.lower() if _simple(c) else c for c in text]
    places = [(i, a) for i, c in enumerate(low) if not fixed(i, text[i]) and (a := alphabet(c))]
    at, form = dict(places), []
    x, n = 0, 1
    for i, c in enumerate(low):
        if i in at:
            form.append("a" + at[i][0])
            x, n = x * len(at[i]) + at[i].index(c), n * len(at[i])
        else:
            form.append("=" + c)
    x = permuted(key, f"{kind}:{''.join(form)}", x, n)
    out = list(text)
    for i, a in reversed(places):
        x, d = divmod(x, len(a))
        out[i] = a[d] if low[i] == text[i] else a[d].upper()
    return "".join(out)


def email(key: str, t: str) -> str:
    """Local part and labels change together; the last label stays, and so do the reserved example domains."""
    low = t.lower() if len(t.lower()) == len(t) else t
    tail = next((d for d in (".example.com", ".example.org", ".example.net", "@example.com", "@example.org", "@example.net") if low.endswith(d)), t[t.rindex(".") :])
    return reformed(key, "email", t, lambda i, c: i >= len(t) - len(tail))


def luhn(digits: str) -> int:
    """The check digit that belongs after these digits."""
    return -sum(sum(divmod(int(c) * (2 - i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10


def card(key: str, t: str) -> str:
    """The last digit keeps its distance from the check digit, so valid numbers stay valid and others stay others."""
    digits = re.sub(r"\D", "", t)
    body = str(permuted(key, f"card:{len(digits)}", int(digits[:-1]), 10 ** (len(digits) - 1))).zfill(len(digits) - 1)
    new = iter(body + str((luhn(body) + int(digits[-1]) - luhn(digits[:-1])) % 10))
    return "".join(next(new) if c.isdigit() else c for c in t)


def phone(key: str, t: str) -> str:
    """Country code, a trunk 0 or 8 and the exchange 555, of which no number is in use, stay; a code that runs on into the number is a known one."""
    held = {i for m in re.finditer(r"^\+\d{1,3}(?=[ ./(-])|^0(?=\d)|^8(?=[ (-])|(?<!\d)555(?=[ .-])", t) for i in range(*m.span())}
    if t.startswith("+") and 0 not in held:
        held |= set(range(1 + next((len(c) for c in CODES if t.startswith(c, 1)), 3)))
    return reformed(key, "phone", t, lambda i, c: i in held)


def _public(x: int) -> bool:
    a, b = x >> 24, x >> 16 & 255
    return 0 < a < 224 and a not in (10, 127) and not (a == 192 and b == 168 or a == 172 and 16 <= b < 32 or a == 169 and b == 254)


def ip(key: str, t: str) -> str:
    """Public addresses become public ones; others keep their kind's first two numbers."""
    o = [int(x) for x in t.split(".")]
    x = o[0] << 24 | o[1] << 16 | o[2] << 8 | o[3]
    x = permuted(key, "ip", x, 1 << 32, _public) if _public(x) else x >> 16 << 16 | permuted(key, f"ip:{x >> 16}", x & 65535, 65536)
    return ".".join(str(x >> s & 255) for s in (24, 16, 8, 0))


def _ssn_ok(x: int) -> bool:
    a, g, s = x // 10**6, x // 10**4 % 100, x % 10**4
    return 0 < a < 900 and a != 666 and g > 0 and s > 0


def ssn(key: str, t: str) -> str:
    x = int(t.replace("-", ""))
    ok = _ssn_ok(x)
    s = f"{permuted(key, 'ssn', x, 10**9, lambda y: _ssn_ok(y) == ok):09d}"
    return f"{s[:3]}-{s[3:5]}-{s[5:]}"


def iban_ok(t: str) -> bool:
    s = t.replace(" ", "")
    return 15 <= len(s) <= 34 and 2 <= int(s[2:4]) <= 98 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def iban(key: str, t: str) -> str:
    """The country stays, the account changes within its form, of which the check digits are no part: they are made anew."""
    s = reformed(key, "iban", t[:2] + t[4:], lambda i, c: i < 2)
    plain = s.replace(" ", "")
    check = 98 - int("".join(str(int(c, 36)) for c in plain[2:] + plain[:2] + "00")) % 97
    return f"{s[:2]}{check:02d}{s[2:]}"


def script(word: str) -> str:
    return "cyrillic" if re.search("[Ѐ-ӿ]", word) else "greek" if re.search("[Ͱ-Ͽἀ-῿]", word) else "arabic" if re.search("[\u0621-\u064a]", word) else "latin"


def cased(like: str, word: str) -> str:
    return word.upper() if like.isupper() and len(like) > 1 else word.capitalize() if like[:1].isupper() else word.lower()


def _syllables(key: str, kind: str, word: str, attempt: int, count: int) -> str:
    parts, out = SYLLABLES[script(word)], ""
    x, n = divmod(mac(key, kind, word, str(attempt)), 2)
    for _ in range(count + n):
        x, i = divmod(x, len(parts))
        out += parts[i]
    return out


def stem(word: str, gender: str = "n") -> tuple[str, str]:
    """(lemma, ending): the masculine form of an agreeing surname, casefolded, and the ending that the word itself has, or none."""
    low = word.casefold()
    for m, f in AGREEING:
        if low.endswith(f.casefold()) and len(low) > len(f) + 1 and gender != "m":
            return low[: -len(f)] + m.casefold(), f
        if low.endswith(m.casefold()) and len(low) > len(m) + 1:
            return low, m
    return low, ""


def surname(key: str, word: str, attempt: int = 0, gender: str = "n") -> str:
    """Syllables of the word's script, in its case, and the ending of an agreeing surname where the word has one."""
    lemma, ending = stem(word, gender)
    if ending:
        return cased(word, _syllables(key, "agreeing", lemma, attempt, 3) + ending)
    out, k = _syllables(key, "surname", lemma, attempt, 4), 0
    while any(out.endswith(e) for pair in AGREEING for e in pair):  # it would look like another's feminine form
        k += 1
        out = _syllables(key, f"surname-{k}", lemma, attempt, 4)
    return cased(word, out)


def called(key: str, word: str, attempt: int = 0, gender: str = "n") -> str:
    """A given name of syllables, for one that no list has; it ends as names of its gender do."""
    return cased(word, _syllables(key, f"called-{gender}", word.casefold(), attempt, 2) + ENDINGS.get((script(word), gender), ""))


def entity(kind: str, word: str, gender: str) -> str:
    """What names a drawn word in the whole corpus: a surname's lemma, or the gender and the given name."""
    return stem(word, gender)[0] if kind == "surname" else f"{gender}:{word.casefold()}"


@functools.lru_cache(maxsize=64)
def _cycle(key: str, s: str, g: str) -> list[int]:
    return sorted(range(len(GIVEN[s, g])), key=lambda k: mac(key, "given", s, g, str(k)))


def given(key: str, word: str) -> str:
    """The next name of the keyed cycle of the same gender and script; no name is its own."""
    s, g, i = _GIVEN_OF[word.casefold()]
    order = _cycle(key, s, g)
    return cased(word, GIVEN[s, g][order[(order.index(i) + 1) % len(order)]])


_POSSESSIVE = re.compile("['’][sS]?$")


def owner(word: str) -> str:
    """A name without the possessive's ending, which stays in the text."""
    return _POSSESSIVE.sub("", word)


def name_parts(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, gender) of the words of each name, and of the same words elsewhere in the text."""
    patterns = []
    if not _TRIGGERS.isdisjoint(_CAPITAL.findall(text)):
        patterns.append(NAME)
    if any(f"{t} " in text or f"{t}." in text for t in LOW_TITLES):
        patterns.append(LOW_NAME)
    if not text.isascii() and re.search("[\u0621-\u064a]", text):
        patterns.append(ARABIC_NAME)
    out: list[tuple[int, int, str, str]] = []
    for pattern in patterns:
        for m in pattern.finditer(text):
            a, b = m.span("titled") if m["titled"] else m.span("known")
            parts = [(a + w.start(), a + w.start() + len(x := owner(w[0])), x) for w in re.finditer(r"\S+", text[a:b])]
            own = _GIVEN_OF.get(parts[0][2].casefold())
            gender = own[1] if own else _GENDER[m["title"].casefold()] if m["titled"] else "n"
            for k, (x, y, w) in enumerate(parts):
                out.append((x, y, "given" if w.casefold() in _GIVEN_OF else "called" if k == 0 and len(parts) > 1 else "surname", gender))
    if out:
        known = {text[a:b].casefold(): (kind, gender) for a, b, kind, gender in reversed(out)}
        there = {(a, b) for a, b, _, _ in out}
        low = {m[0] for m in re.finditer(r"[^\W\d_]+", text) if m.span() not in there}
        for m in _MENTION.finditer(text):
            word = owner(m[0])
            if word.casefold() not in known and word[-1] in "sS" and len(word) > 4 and known.get(word[:-1].casefold(), ("",))[0] == "surname":
                word = word[:-1]  # the Smiths
            got, at = known.get(word.casefold()), (m.start(), m.start() + len(word))
            if got and at not in there and (word.lower() not in low or word.lower() == word.upper()):
                out.append((*at, *got))
    return out


_DECIMAL = re.compile(r"(?=[^\x00-\x7f])\d")


def spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, gender of a name), in order, without overlaps; an earlier kind keeps its place."""
    found: list[tuple[int, int, str, str]] = []

    def add(kind: str, a: int, b: int, gender: str = "") -> None:
        k = bisect_left(found, (a,))
        if (not k or found[k - 1][1] <= a) and (k == len(found) or found[k][0] >= b):
            insort(found, (a, b, kind, gender))

    if "@" in text:
        for m in EMAIL.finditer(text):
            add("email", *m.span())
    plain = text if text.isascii() else _DECIMAL.sub(lambda m: str(unicodedata.decimal(m[0])), text)
    if re.search(r"\d", plain, re.A):
        for m in IBAN.finditer(plain):
            t = m[0]
            while not iban_ok(t) and " " in t:  # the words behind it may look like more of it
                t = t[: t.rindex(" ")]
            if iban_ok(t):
                add("iban", m.start(), m.start() + len(t))
        for kind, pattern in (("ip", IP), ("ssn", SSN), ("card", CARD)):
            for m in pattern.finditer(plain):
                add(kind, *m.span())
        told = [m.span() for m in PHONES.finditer(plain) if 7 <= sum(map(str.isdigit, m[0])) <= 15]
        for a, b in sorted([*told, *(m.span() for m in PHONE.finditer(plain)), *(m.span(1) for m in PHONE_WORD.finditer(plain))], key=lambda s: (s[0], -s[1])):
            add("phone", a, b)
    for a, b, kind, gender in name_parts(text):
        add(kind, a, b, gender)
    return found


_MAKERS = {"iban": iban, "ip": ip, "ssn": ssn, "card": card, "phone": phone}


def number(key: str, kind: str, t: str) -> str:
    """The surrogate of a number in the decimal digits that it came in."""
    other = _DECIMAL.search(t)
    if not other:
        return _MAKERS[kind](key, t)
    zero = ord(other[0]) - unicodedata.decimal(other[0])
    new = _MAKERS[kind](key, _DECIMAL.sub(lambda m: str(unicodedata.decimal(m[0])), t))
    return "".join(chr(zero + int(c)) if c.isascii() and c.isdigit() else c for c in new)


def replaced(text: str, key: str, redrawn: dict[str, int] | None = None) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with surrogates, and the spans found in the text that came in. redrawn: the attempt of drawn words that met others."""
    found, out, at = spans(text), [], 0
    for a, b, kind, gender in found:
        t = text[a:b]
        if kind in ("surname", "called"):
            new = (surname if kind == "surname" else called)(key, t, (redrawn or {}).get(entity(kind, t, gender), 0), gender)
        else:
            new = given(key, t) if kind == "given" else email(key, t) if kind == "email" else number(key, kind, t)
        out += [text[at:a], new]
        at = b
    return "".join(out) + text[at:] if found else text, [(a, b, "name" if kind in NAMES else kind) for a, b, kind, _ in found]


def drawn_words(texts: DataFrame) -> DataFrame:
    """(id, word) from (id, text): the entities of each text that get drawn words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, words = [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for w in sorted({entity(k, t[x:y], g) for x, y, k, g in spans(t) if k in ("surname", "called")} if t and name_parts(t) else ()):
                    ids.append(i)
                    words.append(w)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(words, pa.string())], ["id", "word"])

    return texts.mapInArrow(run, "id bigint, word string")


def redraws(words: DataFrame, secret: str, rounds: int = 20) -> DataFrame | None:
    """(word, attempt) of the entities to be drawn again, or None without any; words: distinct (word)."""
    def drawn(name: str, attempt: int) -> str:
        gender, _, word = name.rpartition(":")
        return (called(secret, word, attempt, gender) if gender else surname(secret, word, attempt)).casefold()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            to = [drawn(w, k) for w, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(to, pa.string())], ["word", "attempt", "to"])

    known = words.sparkSession.createDataFrame([(n,) for n in sorted(_GIVEN_OF)], "_is string")
    with_to = lambda d: materialise(d.mapInArrow(run, "word string, attempt int, to string"))
    now = with_to(words.select("word", F.lit(0).alias("attempt")))
    changed = False
    for _ in range(rounds):
        firsts = now.groupBy("to").agg(F.min(F.struct("attempt", "word"))["word"].alias("first")).withColumnRenamed("to", "_to")
        taken = now.select(F.substring_index("word", ":", -1).alias("_is")).union(known).distinct()
        met = now.join(firsts, F.col("to") == F.col("_to")).join(taken, F.col("to") == F.col("_is"), "left")
        met = met.withColumn("again", (F.col("word") != F.col("first")) | F.col("_is").isNotNull())
        if not met.where("again").limit(1).count():
            return now.where("attempt > 0").select("word", "attempt") if changed else None
        changed = True
        now = with_to(met.select("word", (F.col("attempt") + F.col("again").cast("int")).alias("attempt")))
    raise RuntimeError("drawn words still meet")


def surrogates(docs: DataFrame, text: str = "text", secret: str | None = None, report: bool = True) -> DataFrame:
    """Every row with its text replaced; with a report, n_<kind> columns and spans (kind:start:end of the text that came in) too."""
    key = secret or secret_of(docs.sparkSession)
    # Rows meet their redrawn words by a hash of the text, which every row has; texts that share one just share the words of both.
    body, added = F.col(f"`{text}`"), [*(f"n_{k}" for k in KINDS), "spans"] if report else []
    words = materialise(drawn_words(docs.select(F.xxhash64(body).alias("id"), body)))
    again = redraws(words.select("word").distinct(), key)
    d = packed(docs, id=F.xxhash64(body), redrawn=F.lit(None).cast("map<string,int>"))
    if again is not None:
        own = words.join(again.withColumnRenamed("word", "_w"), F.col("word") == F.col("_w")).select("id", "word", "attempt").distinct()
        own = own.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("word", "attempt"))).alias("redrawn")).withColumnRenamed("id", "_id")
        d = d.drop("redrawn").join(own, F.col("id") == F.col("_id"), "left")
    keep = [c for c in docs.columns if c not in added]
    d = unpacked(d, keep, **{fresh(keep, "redrawn"): F.col("redrawn")})
    at, width = keep.index(text), len(keep)
    schema = d.select(*[F.col(f"`{c}`") for c in keep], *[F.lit(0 if c != "spans" else "").cast("bigint" if c != "spans" else "string").alias(c) for c in added]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, rows = [], []
            for t, m in zip(b.column(at).to_pylist(), b.column(width).to_pylist(), strict=True):
                new, found = replaced(t, key, dict(m) if m else None) if t else (t, [])
                texts.append(new)
                kinds = [k for _, _, k in found]
                rows.append((*(kinds.count(k) for k in KINDS), ",".join(f"{k}:{x}:{y}" for x, y, k in found)))
            new = list(zip(*rows, strict=True)) or [[]] * (len(KINDS) + 1)
            columns = [pa.array(texts, pa.string()) if i == at else b.column(i) for i in range(width)]
            if report:
                columns += [*(pa.array(v, pa.int64()) for v in new[:-1]), pa.array(new[-1], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return mapped(d, run, schema)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return surrogates(table(spark, sf_dir, "documents").select("doc_id", "text"))
