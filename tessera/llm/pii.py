"""PII surrogates: detected entities get keyed replacements of the same type.

A surrogate is the image of the entity under a keyed permutation of all
strings of its shape, so equal entities always get equal surrogates
(coreference, in a text and across the corpus) and different ones different
surrogates (distinctness): no table of pairs is kept anywhere.  The
permutation has no fixed point, so no entity stays as it is.

Permutation of 0 .. n-1: the conjugate P^-1(P(x) + s) of a cyclic shift by a
keyed s that isn't 0, where P is a keyed Feistel network over a mixed radix.
What must not change keeps its place: separators, letter case, script, the
class of each character, country codes, mail providers' top domains, the kind
of an address, and whether a check digit is right.  Names come from lists by
gender and script; surnames off the lists are permuted letter by letter, vowel
for vowel, and walked on until no listed name is met (the collision check).
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import _text
from tessera.llm._io import fresh

ROUNDS = 8
KINDS = ("email", "iban", "card", "ssn", "phone", "ip", "name")

#: Character classes that permute within themselves, by script and case.
ALPHABETS = (
    "0123456789",
    "aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ",
    "àáâäãåèéêëìíîïòóôöõùúûü", "ÀÁÂÄÃÅÈÉÊËÌÍÎÏÒÓÔÖÕÙÚÛÜ", "çñýÿßðþøæœ", "ÇÑÝŸÐÞØÆŒ",
    "αεηιουω", "βγδζθκλμνξπρστφχψ", "ΑΕΗΙΟΥΩ", "ΒΓΔΖΘΚΛΜΝΞΠΡΣΤΦΧΨ",
    "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "АЕЁИОУЫЭЮЯ", "БВГДЖЗЙКЛМНПРСТФХЦЧШЩ",
)
_CLASS = {c: (k, i) for k, a in enumerate(ALPHABETS) for i, c in enumerate(a)}

#: Given names by (script, gender); titles that tell a name and its gender.
GIVEN = {
    ("latin", "f"): "Anna Maria Laura Julia Sophie Emma Clara Helena Nina Sara Eva Lucia Marta Elena Paula Irene Alice Camille Louise Claire Mary Linda Susan Karen Lisa Sandra Alicia Carmen".split(),
    ("latin", "m"): "Peter Thomas Martin David Daniel Paul Lukas Felix Simon Jonas Carlos Pablo Diego Miguel Javier Pierre Louis Antoine Hugo James John Robert Michael William Richard Hans Klaus José".split(),
    ("latin", "n"): "Alex Robin Kim Sascha Noel Andrea Dominique Camilo Jordan Taylor".split(),
    ("cyrillic", "f"): "Анна Мария Ольга Елена Наталья Ирина Татьяна Светлана".split(),
    ("cyrillic", "m"): "Иван Пётр Сергей Андрей Дмитрий Николай Михаил Алексей".split(),
    ("greek", "f"): "Μαρία Ελένη Κατερίνα Σοφία".split(),
    ("greek", "m"): "Γιώργος Νίκος Κώστας Δημήτρης".split(),
}
SURNAMES = {
    "latin": "Smith Johnson Brown Miller Davis Wilson Moore Taylor Clark Lewis Müller Schmidt Schneider Fischer Weber Meyer Wagner Becker Hoffmann Schulz García Martínez López Sánchez Pérez Gómez Fernández Ruiz Díaz Moreno Martin Bernard Dubois Durand Leroy Moreau Simon Laurent Lefebvre Roux".split(),
    "cyrillic": "Иванов Петров Смирнов Кузнецов Попов Соколов Лебедев Козлов".split(),
    "greek": "Παπαδόπουλος Νικολάου Γεωργίου Ιωάννου".split(),
}
TITLES = {
    "Mr": "m", "Herr": "m", "Herrn": "m", "Señor": "m", "Sr": "m", "Monsieur": "m", "Sir": "m", "Don": "m", "Господин": "m", "Κύριος": "m",
    "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Señora": "f", "Sra": "f", "Señorita": "f", "Madame": "f", "Mme": "f", "Mlle": "f", "Lady": "f", "Doña": "f", "Госпожа": "f", "Κυρία": "f",
    "Dr": "n", "Prof": "n", "Professor": "n",
}
_CAP = "[A-ZÀ-ÖØ-ÞΑ-ΩΆΈΉΊΌΎΏА-ЯЁ]"
_LOW = "[a-zà-öø-ÿα-ωάέήίόύώςа-яё]"
_NAME = rf"{_CAP}{_LOW}+(?:-{_CAP}{_LOW}+)*"

EMAIL = re.compile(r"(?<![\w.+-])(?:[^\W_]|[_.+%-](?=[\w@.+%-]))+@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![\w])")
NUMBERS = re.compile(
    r"(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))"
    r"|(?P<ip6>(?<![\w:.])(?=[0-9A-Fa-f:.]*:[0-9A-Fa-f.]*:)[0-9A-Fa-f:]{2,39}(?:(?<=:)[0-9]{1,3}(?:\.[0-9]{1,3}){3})?(?![\w:]|\.[0-9]))"
    r"|(?P<ip>(?<![\w.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![\w]|\.[0-9]))"
    r"|(?P<ssn>(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-]))"
    r"|(?P<phone>(?<![\w+])\+1[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?!\w)"
    r"|(?<![\w+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,5}\)|[0-9]{1,5})(?:[ .-]?[0-9]{2,9}(?![0-9]|\.[0-9]{1,3}\.[0-9])){1,5}(?!\w)|(?<![\w+])\+[0-9]{7,15}(?!\w)|(?<![\w(])\([0-9]{3}\)[ ]?[0-9]{3}[ .-][0-9]{4}(?!\w)|(?<![\w.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![\w-]))"
    # with a trunk 0: 06 12 34 56 78, 0171 2345678, (030) 123456; Spanish: 612 345 678, 91 123 45 67
    r"|(?P<national>(?<![\w.,/+-])0[1-9](?:(?P<gap>[ .-])[0-9]{2})(?:(?P=gap)[0-9]{2}){3}(?![\w/-]|[.,][0-9])"
    r"|(?<![\w.,/+-])(?:\(0[1-9][0-9]{1,4}\)[ ]?|0[1-9][0-9]{1,4}(?:[ ]?[/-][ ]?|[ ]))[0-9]{3,8}(?:[ -][0-9]{2,6}){0,3}(?![\w/-]|[.,][0-9])"
    r"|(?<![\w.,/+-])0[1-9][0-9]{8,9}(?![\w/-]|[.,][0-9])"
    r"|(?<![\w.,/+-])[6789][0-9]{2}(?P<space>[ .-])[0-9]{3}(?P=space)(?!000)[0-9]{3}(?![\w/-]|[ .,-][0-9])"
    r"|(?<![\w.,/+-])(?:[6789][0-9]{2}(?:[ ][0-9]{2}){3}|[89][0-9][ ][0-9]{3}(?:[ ][0-9]{2}){2})(?![\w/-]|[ .,-][0-9]))"
    r"|(?P<card>(?<![\w-])[0-9](?:[ -]?[0-9]){12,18}(?![\w-]))"
)
PERSON = re.compile(rf"\b(?P<title>{'|'.join(sorted(TITLES, key=len, reverse=True))})\b\.?[ ](?P<name>{_NAME}(?:[ ](?:{_NAME}|(?:von|van|de|del|la)(?=[ ]{_CAP})))*)")
#: A listed given name, further names, a listed surname: a person without a title.
UNTITLED = re.compile(
    "|".join(
        rf"\b(?:{'|'.join(sorted({n for (s, _), v in GIVEN.items() if s == script for n in v}))})(?:-{_NAME})?(?:[ ](?:{_NAME}|{_CAP}\.|von|van|de|del|la)){{0,3}}?[ ](?:{'|'.join(SURNAMES[script])})\b"
        for script in SURNAMES
    )
)
#: Length of an IBAN by country.
IBAN = {c: n for n, cs in {15: "NO", 16: "BE", 18: "DK FI NL", 19: "SI MK", 20: "AT BA EE LT LU XK", 21: "CH HR LI LV", 22: "BG DE GB GE IE ME RS", 23: "AE GI IL", 24: "AD CZ ES MD PK RO SA SE SK TN", 25: "PT", 26: "IS TR", 27: "FR GR IT MC SM", 28: "AL AZ CY HU LB PL", 29: "BR UA", 31: "MT"}.items() for c in cs.split()}
_DIGIT_OR_AT = re.compile("[0-9@]|[A-Fa-f:]::|::[A-Fa-f]|[A-Fa-f]:[A-Fa-f]").search
_TITLE = re.compile("|".join(rf"{t}\b" for t in sorted(TITLES, key=len, reverse=True))).search


class Surrogates:
    """Keyed permutations by kind; the key never leaves the tasks."""

    def __init__(self, key: bytes):
        self.key = key
        self.map = lru_cache(1 << 16)(self._map)

    def _number(self, *parts: object) -> int:
        return int.from_bytes(hmac.new(self.key, "\x1f".join(map(str, parts)).encode(), hashlib.sha256).digest(), "big")

    def permute(self, x: int, n: int, tweak: str) -> int:
        """A keyed permutation of 0 .. n-1 without fixed points (n > 1)."""
        if n < 2:
            return x
        left = max(1, round(n**0.5)) if n < 1 << 100 else 1 << (n.bit_length() // 2)
        right = -(-n // left)
        name = f"{tweak}/{n}"

        def feistel(v: int, back: bool) -> int:
            # over left * right >= n values, walked until inside: still a permutation of 0 .. n-1
            while True:
                a, b = divmod(v, right)
                for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
                    sign = -1 if back else 1
                    if r % 2:
                        b = (b + sign * self._number(name, r, a)) % right
                    else:
                        a = (a + sign * self._number(name, r, b)) % left
                v = a * right + b
                if v < n:
                    return v

        shift = 1 + self._number(name, "shift") % (n - 1)
        return feistel((feistel(x, False) + shift) % n, True)

    def text(self, value: str, tweak: str, fixed: frozenset[int] = frozenset()) -> str:
        """Permute a string among all of its shape: every character keeps its class; ``fixed`` places stay."""
        sizes, digits, at = [], [], []
        for i, c in enumerate(value):
            if i not in fixed and c in _CLASS:
                k, d = _CLASS[c]
                at.append((i, k))
                sizes.append(len(ALPHABETS[k]))
                digits.append(d)
        n = x = 0
        if sizes:
            n, x = 1, 0
            for s, d in zip(sizes, digits, strict=True):
                n, x = n * s, x * s + d
        shape = "".join(c if i in fixed or c not in _CLASS else f"\x00{_CLASS[c][0]}" for i, c in enumerate(value))
        y = self.permute(x, n, f"{tweak}|{shape}") if n > 1 else x
        out = list(value)
        for (i, k), s in zip(reversed(at), reversed(sizes), strict=True):
            y, d = divmod(y, s)
            out[i] = ALPHABETS[k][d]
        return "".join(out)

    def _map(self, kind: str, value: str) -> str:
        return getattr(self, f"_{kind}")(value)

    def _email(self, value: str) -> str:
        local, domain = value.rsplit("@", 1)
        last = domain.rfind(".")
        # mail addresses are one whether upper or lower case: the surrogate follows the lower-case one
        low = f"{local}@{domain[:last]}".lower()
        new = self.text(low, f"email|{domain[last:].lower()}")
        if len(low) == last + len(local) + 1:
            new = "".join(n.upper() if o.isupper() and len(n.upper()) == 1 else n for n, o in zip(new, value, strict=False))
        return new + domain[last:]

    def _ip(self, value: str) -> str:
        """Addresses of one kind (private, loopback, link-local, multicast, public) stay of that kind."""
        if ":" in value:
            return self._ip6(value)
        x = 0
        for part in value.split("."):
            x = x << 8 | int(part)
        for low, bits in ((0x0A000000, 24), (0xAC100000, 20), (0xC0A80000, 16), (0x7F000000, 24), (0xA9FE0000, 16)):
            if low <= x < low + (1 << bits):
                y = low + self.permute(x - low, 1 << bits, f"ip{low}")
                break
        else:
            top = x >= 0xE0000000
            y = x
            while True:  # walk past the kinds above: still a permutation of the rest
                y = 0xE0000000 + self.permute(y - 0xE0000000, 1 << 29, "ip-top") if top else self.permute(y, 0xE0000000, "ip")
                if not any(low <= y < low + (1 << bits) for low, bits in ((0x0A000000, 24), (0xAC100000, 20), (0xC0A80000, 16), (0x7F000000, 24), (0xA9FE0000, 16))):
                    break
            if y == x:  # the walk came full round
                return value
        return ".".join(str(y >> s & 255) for s in (24, 16, 8, 0))

    def _ip6(self, value: str) -> str:
        """The first group, which tells the kind of an address, and zero groups but the last stay."""
        number = int(ipaddress.IPv6Address(value))
        groups = [number >> 16 * (7 - i) & 0xFFFF for i in range(8)]
        free = [i for i in range(1, 7) if groups[i]]
        shape = "".join("x" if i in free or i == 7 else f":{g:x}" for i, g in enumerate(groups))
        x = 0
        for i in free:
            x = x * 0xFFFF + groups[i] - 1
        y = self.permute(x << 16 | groups[7], 0xFFFF ** len(free) << 16, f"ip6|{shape}")
        y, groups[7] = y >> 16, y & 0xFFFF
        for i in reversed(free):
            y, d = divmod(y, 0xFFFF)
            groups[i] = d + 1
        new = ipaddress.IPv6Address(":".join(f"{g:x}" for g in groups)).compressed
        return new.upper() if value.isupper() else new

    def _digits(self, value: str, kind: str, keep: int, check: Callable[[str], int] | None = None) -> str:
        digits = "".join(c for c in value if c.isdigit())
        head, body = digits[:keep], digits[keep:]
        if check:
            # the last digit's distance from a right check digit stays what it is
            wrong = (int(body[-1]) - check(digits[:-1])) % 10
            body = self.text(body[:-1], f"{kind}|{head}|{len(body)}")
            body += str((check(head + body) + wrong) % 10)
        else:
            body = self.text(body, f"{kind}|{head}|{len(body)}")
        new = iter(head + body)
        return "".join(next(new) if c.isdigit() else c for c in value)

    def _card(self, value: str) -> str:
        return self._digits(value, "card", 1, luhn)

    def _phone(self, value: str) -> str:
        # a trunk 0, and the first digit of a Spanish number, show that it is a national one
        keep = int(value.lstrip("(")[0] == "0" or sum(c.isdigit() for c in value) == 9)
        if value.startswith("+"):
            keep = len(re.match(r"\+([0-9]{1,3})(?=[ .(-])|\+([0-9]{1,2})", value)[0]) - 1
        return self._digits(value, "phone", keep)

    def _ssn(self, value: str) -> str:
        return self._digits(value, "ssn", 0)

    def _iban(self, value: str) -> str:
        """Country and grouping stay; a right check number is made right again, a wrong one is wrong again."""
        plain = value.replace(" ", "")
        right = iban_check(plain) == int(plain[2:4])
        body = self.text(plain[4:], f"iban|{plain[:2]}|{right}|{'' if right else plain[2:4]}")
        number = iban_check(plain[:4] + body)
        if not right:
            number = int(plain[2:4]) if int(plain[2:4]) != number else (number + 1) % 97
        new = iter(f"{plain[:2]}{number:02d}{body}")
        return "".join(c if c == " " else next(new) for c in value)

    def name_part(self, word: str, role: str) -> str:
        """The surrogate of one word of a name, the same in every ``role`` (a gender or ``s`` for a surname) and after every title.

        A listed word maps within its list, and the lists share no word; other
        words map among the words that no list has.  So no two words have one
        surrogate.
        """
        script = script_of(word)
        for kind, names in _name_lists(script).items():
            if word in names:
                return names[self.permute(names.index(word), len(names), f"name|{kind}|{script}")]
        new = word
        listed = _listed(script)
        for _ in range(64):  # the collision check: never land on a listed name
            # the last letter often shows a gender: it stays
            new = self.text(new, "name", frozenset() if len(new) < 3 else frozenset({len(new) - 1}))
            if new not in listed and new != word:
                break
        return new


def luhn(digits: str) -> int:
    """The check digit that makes ``digits`` plus it valid."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def iban_check(plain: str) -> int:
    return 98 - int("".join(str(int(c, 36)) for c in plain[4:] + plain[:2] + "00")) % 97


def script_of(word: str) -> str:
    c = word[0]
    return "cyrillic" if "Ѐ" <= c <= "ӿ" else "greek" if "Ͱ" <= c <= "Ͽ" else "latin"


@lru_cache(8)
def _name_lists(script: str) -> dict[str, list[str]]:
    """Lists of names without common words: those that are given names and surnames alike are a list of their own."""
    surnames = SURNAMES.get(script, [])
    given = {g: names for (s, g), names in GIVEN.items() if s == script}
    both = sorted({n for names in given.values() for n in names if n in surnames})
    lists = {"b": both, "s": [n for n in surnames if n not in both]}
    seen = set(both)
    for g, names in given.items():
        lists[g] = [n for n in names if n not in seen]
        seen.update(names)
    return lists


def _overlaps(spans: list[tuple], start: int, stop: int) -> bool:
    """Whether any of ``spans``, which are in order and apart from one another, meets start .. stop."""
    i = bisect_left(spans, (stop,))
    return i > 0 and spans[i - 1][1] > start


@lru_cache(8)
def _listed(script: str) -> frozenset[str]:
    return frozenset(SURNAMES.get(script, [])).union(*(v for (s, _), v in GIVEN.items() if s == script))


def _gender(word: str) -> str:
    """The gender of the list that a given name is on."""
    return next((g for (_, g), names in GIVEN.items() if word in names), "n")


def _is_given(word: str) -> bool:
    """Whether a word is listed as a given name and not as a surname."""
    return word not in SURNAMES[script_of(word)] and any(word in names for names in GIVEN.values())


def _ip6(value: str) -> ipaddress.IPv6Address | None:
    """An address of two groups at least, one of three digits or more: not a slice, a time or a scope in code."""
    groups = [g for g in re.split("[:.]", value) if g]
    try:
        return ipaddress.IPv6Address(value) if len(groups) > 1 and max(map(len, groups)) > 2 else None
    except ValueError:
        return None


def _iban_end(shape: str, text: str, start: int) -> int:
    """Where the IBAN that ``shape`` begins with ends in ``text``; 0 for none.

    Of a country's length it is one whether its check number is right or wrong;
    of another length only if that is right.
    """
    places = [i for i, c in enumerate(shape) if c != " "]
    size = IBAN.get(shape[:2])
    if size and size <= len(places):
        stop = start + places[size - 1] + 1
        if not text[stop : stop + 1].isalnum():
            return stop
    plain = shape.replace(" ", "")
    return start + len(shape) if iban_check(plain) == int(plain[2:4]) else 0


def detect(text: str) -> list[tuple[int, int, str, str]]:
    """(start, stop, kind, role) of all entities, in order, without overlaps.  Places are code points."""
    found: list[tuple[int, int, str, str]] = []
    if _DIGIT_OR_AT(text):
        if "@" in text:
            found += [(m.start(), m.end(), "email", "") for m in EMAIL.finditer(text)]
        taken = [(a, b) for a, b, _, _ in found]
        at = 0
        while m := NUMBERS.search(text, at):
            kind, start, stop = m.lastgroup, m.start(), m.end()
            at = stop
            digits = sum(c.isdigit() for c in m[0])
            if kind == "iban":
                stop = _iban_end(m[0], text, start)
            elif kind == "ip6":
                kind, stop = "ip", stop if _ip6(m[0]) is not None else 0
            elif kind in ("phone", "national"):
                kind, stop = "phone", stop if 7 <= digits <= 15 else 0
            if not stop:
                # not what it looks like: what its shape covers may hold others
                at = start + (4 if kind == "iban" else 1)
                continue
            at = stop
            if not _overlaps(taken, start, stop):
                found.append((start, stop, kind, ""))
    titled, untitled = _TITLE(text), UNTITLED.search(text)
    if titled or untitled:
        surnames: set[str] = set()
        given: dict[str, str] = {}
        people: list[tuple[int, int, str, str]] = []
        known: set[int] = set()
        spans = [(m.start(), m[0], "") for m in UNTITLED.finditer(text)] if untitled else []
        spans += [(m.start("name"), m["name"], TITLES[m["title"]]) for m in PERSON.finditer(text)] if titled else []
        for start, name, gender in spans:
            words = [(w.start() + start, w[0]) for w in re.finditer(r"[^\s-]+", name)]
            words = [(a, w) for a, w in words if w[0].isupper() and not w.endswith(".")]
            gender = gender or _gender(words[0][1])
            # a title may stand before a given name alone
            only = len(words) == 1 and _is_given(words[0][1])
            for k, (a, w) in enumerate(words):
                last = k == len(words) - 1 and not only
                if a in known:
                    continue
                known.add(a)
                people.append((a, a + len(w), "name", "s" if last else gender))
                if last:
                    surnames.add(w)
                else:
                    given.setdefault(w, gender)
        if surnames or given:
            # the same surname or given name elsewhere in the text is the same person's
            roles = given | dict.fromkeys(surnames, "s")
            again = re.compile(rf"\b(?:{'|'.join(map(re.escape, sorted(roles, key=len, reverse=True)))})\b")
            people += [(m.start(), m.end(), "name", roles[m[0]]) for m in again.finditer(text) if m.start() not in known]
        found.sort()
        found += [p for p in people if not _overlaps(found, p[0], p[1])]
    return sorted(found)


def replace(text: str | None, surrogates: Surrogates) -> tuple[str | None, list[tuple[int, int, str]]]:
    """The text with surrogates, and where they stand in it.  Null stays null."""
    if not text:
        return text, []
    found = detect(text)
    if not found:
        return text, []
    out, spans, at, length = [], [], 0, 0
    for start, stop, kind, role in found:
        new = surrogates.name_part(text[start:stop], role) if kind == "name" else surrogates.map(kind, text[start:stop])
        out += [text[at:start], new]
        length += start - at
        spans.append((length, length + len(new), kind))
        length += len(new)
        at = stop
    return "".join([*out, text[at:]]), spans


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType()), T.StructField("kind", T.StringType())]))


def pseudonymise(df: DataFrame, key: str, *, text_col: str = "text", spans_col: str = "entities") -> DataFrame:
    """Replace ``text_col`` by its text with surrogates, and add ``spans_col``: where they stand.

    Null texts stay null and empty ones empty, without spans.  All other
    columns are kept (one named ``spans_col`` is replaced); one row out for
    each row in, and rows with equal texts get equal texts.
    """
    df = df.drop(spans_col)
    at = df.columns.index(text_col)
    if not isinstance(df.schema[text_col].dataType, T.StringType):
        df = df.withColumn(text_col, F.col(text_col).cast("string"))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("kind", pa.string())]))

    @_text.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        surrogates = Surrogates(key.encode())
        for batch in (part for b in batches for part in _text.slices(b, at)):
            texts, spans = [], []
            for t in batch.column(at).to_pylist():
                new, where = replace(t, surrogates)
                texts.append(new)
                spans.append([{"start": a, "stop": b, "kind": k} for a, b, k in where])
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, kind)], names=[*batch.schema.names, spans_col])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(spans_col, SPANS)]))


def surrogate_texts(docs: DataFrame, key: str) -> DataFrame:
    """Every document with its surrogate text, number of entities and their spans."""
    out = pseudonymise(docs.select("doc_id", F.col("text").cast("string").alias("text")), key)
    return out.select("doc_id", "text", F.size("entities").cast("long").alias("n_entities"), F.array_join(F.transform("entities", lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",").alias("spans"))


def without_pii(docs: DataFrame, key: str, *, text_col: str = "text") -> DataFrame:
    """The documents, same columns, with surrogates in their texts."""
    name = fresh("_entities", docs.columns)
    return pseudonymise(docs, key, text_col=text_col, spans_col=name).drop(name)
