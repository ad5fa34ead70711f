"""Personal data replaced by keyed surrogates of the same type, gender, script and format.

A detected entity is normalised (a phone number to its digits, an address to lower case),
and the surrogate is a keyed permutation of the normalised form within its own format: the
same country code and number of digits, the same letters-and-digits pattern, a Luhn-valid
card number for a valid one, an address of the same network class, a known given name of the same
gender and script.  Equal entities so get equal surrogates in every document and every run
with the key (coreference), and as each mapping is one-to-one within its format, distinct
entities get distinct surrogates, with no table of the entities seen.  The permutation has
no fixed point.  Names that are not listed are permuted under their shape alone, whatever
title stands before them, so this holds for them over all titles too.

A person is found by a title; once found, the bare mentions of either name in the same
document are replaced alike.  A phone number is found by a plus, brackets, a phone word or
groups that numbers grouped by threes don't have.

Null texts stay null, texts without entities are unchanged, repeated rows change alike,
extra columns pass through (a column named like entities_col is replaced); an empty table
gives none.  A text of any length is searched about its digits, signs and titles only.
"""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame

from panelweft.llm import common as C

ROUNDS = 10


class Permutation:
    """Keyed permutations of the integers below n, without fixed points, by a Feistel network on a product of two moduli."""

    def __init__(self, key: bytes, label: str, n: int) -> None:
        self.n = n
        self.left = max(1, math.isqrt(n))
        while self.left * self.left < n:
            self.left += 1
        self.right = -(-n // self.left)
        self.key = hashlib.blake2b(label.encode(), key=key, digest_size=32).digest()
        self.shift = 1 + int.from_bytes(hashlib.blake2b(b"shift", key=self.key, digest_size=16).digest(), "big") % max(1, n - 1)

    def _round(self, i: int, x: int, m: int) -> int:
        raw = hashlib.blake2b(x.to_bytes((x.bit_length() + 7) // 8 or 1, "big"), key=self.key, digest_size=48, person=i.to_bytes(2, "big")).digest()
        return int.from_bytes(raw, "big") % m

    def _once(self, x: int) -> int:
        a, b = divmod(x, self.right)
        for i in range(0, ROUNDS, 2):
            a = (a + self._round(i, b, self.left)) % self.left
            b = (b + self._round(i + 1, a, self.right)) % self.right
        return a * self.right + b

    def _back(self, x: int) -> int:
        a, b = divmod(x, self.right)
        for i in range(ROUNDS - 2, -1, -2):
            b = (b - self._round(i + 1, a, self.right)) % self.right
            a = (a - self._round(i, b, self.left)) % self.left
        return a * self.right + b

    def _walk(self, x: int, f) -> int:
        x = f(x)
        while x >= self.n:
            x = f(x)
        return x

    def __call__(self, x: int) -> int:
        """A shift seen through the permutation: one cycle through all n values."""
        if self.n < 2:
            return x
        return self._walk((self._walk(x, self._once) + self.shift) % self.n, self._back)


#: Alphabets of format classes; a letter stays in its class.
CLASSES = ("0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "áéíóúàèìòùâêîôûäëïöü", "çñß", "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "АЕЁИОУЫЭЮЯ", "БВГДЖЗЙКЛМНПРСТФХЦЧШЩ", "αεηιουω", "βγδζθκλμνξπρστφχψ", "ΑΕΗΙΟΥΩ", "ΒΓΔΖΘΚΛΜΝΞΠΡΣΤΦΧΨ")
_CLASS = {c: s for s in CLASSES for c in s}
_VOWELS = frozenset(c for s in CLASSES if s[0] in "aáаα" for c in s)
_HEX = {**{c: "0123456789abcdef" for c in "0123456789abcdef"}}

#: Given names by gender and script.
GIVEN = {
    ("f", "LATIN"): ("Alice", "Anna", "Carla", "Clara", "Elena", "Emma", "Eva", "Ines", "Jane", "Julia", "Laura", "Lucy", "Maria", "Marie", "Mary", "Nina", "Olivia", "Paula", "Sarah", "Sofia", "Sophie", "Susan"),
    ("m", "LATIN"): ("Adam", "Carlos", "Daniel", "David", "Felix", "Hans", "Hugo", "Jack", "James", "Jean", "John", "Jorge", "Karl", "Louis", "Lucas", "Mark", "Martin", "Max", "Paul", "Pedro", "Peter", "Robert", "Thomas"),
    ("f", "CYRILLIC"): ("Анна", "Елена", "Ирина", "Мария", "Наталья", "Ольга", "Светлана", "Татьяна"),
    ("m", "CYRILLIC"): ("Алексей", "Андрей", "Дмитрий", "Иван", "Михаил", "Николай", "Павел", "Сергей"),
    ("f", "GREEK"): ("Άννα", "Ελένη", "Κατερίνα", "Μαρία", "Σοφία"),
    ("m", "GREEK"): ("Γιώργος", "Δημήτρης", "Κώστας", "Νίκος", "Πέτρος"),
}
_GENDER_OF = {n: k for k, names in GIVEN.items() for n in names}
#: Titles that announce a person, with the gender they tell (None: either).
TITLES = {"Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Sir": "m", "Madam": "f", "Dr": None, "Prof": None, "Herr": "m", "Herrn": "m", "Frau": "f", "Monsieur": "m", "Madame": "f", "Mademoiselle": "f", "Señor": "m", "Señora": "f", "Don": "m", "Doña": "f", "господин": "m", "госпожа": "f", "Κύριος": "m", "Κυρία": "f"}

#: Small words before a family name, which stay as they are.
PARTICLES = ("af", "al", "ben", "bin", "da", "de", "del", "della", "den", "der", "di", "do", "dos", "du", "el", "la", "le", "ten", "ter", "van", "vom", "von", "zu", "zur")
_NAME = r"[^\W\d_]+"
_SMALL = rf"(?:(?:{'|'.join(PARTICLES)})\s){{0,3}}"
_EMAIL = r"(?<![\w.+-])[A-Za-z0-9](?:[\w.+-]*[A-Za-z0-9_+-])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![A-Za-z0-9_])"
_IP = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)"
_SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
_CARD = r"(?<![\d-])(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{13,19})(?![\d-])"
#: Country calling codes (ITU-T E.164); no code begins another, so digits alone tell the code.
_CODE = r"(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-9]\d\d)"
#: What stands between the digits of a phone number, and what a group of its digits can't be.
_GAP = r"(?:[ \u00a0./-]?\(|\)[ \u00a0./-]?|[ \u00a0./-])"
_OTHER = rf"(?!{_IP}|{_SSN}|{_CARD}|(?:19|20)\d\d-\d\d-\d\d(?!\d))"
_DIGIT = rf"(?:{_GAP}{_OTHER}(?=\d\d))?\d"
#: Words that announce a phone number.
_PHONE_WORD = r"\b(?:(?:tele|cell)?phones?|tel|mobile|cell|fax|whatsapp|call|dial|telefon|telefax|handy|mobil|rufnummer|tel[eé]fono|m[oó]vil|t[eé]l[eé]phone|portable|телефон|тел|моб|τηλ[εέ]φωνο|τηλ|κινητό)\b"
PATTERNS = {
    "email": _EMAIL,
    "secret": r"""(?i:\b(?:token|secret|passwd|password|api[_-]?key|access[_-]?key|auth)\b["']?\s*[:=]\s*["']?)(?P<secret_value>[A-Za-z0-9+/_=-]{12,})""",
    "ip": _IP,
    "ssn": _SSN,
    "card": _CARD,
    # With a plus: ten digits after 1 and 7, 6 to 12 after other codes, in any groups.  After a phone word: 7 to 14 digits in any
    # groups.  Else brackets, a group of four at the end, hyphens or a zero at the start: numbers grouped by threes have none of these.
    "phone": rf"(?<![\w+])(?:\+(?:[17](?:{_GAP})?\d{_DIGIT * 9}|(?![17]){_CODE}(?:{_GAP}{_OTHER})?\d(?:{_DIGIT}){{5,11}})(?!\d)"
    r"|(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|\+\d{1,3}[ .-]?\d{2,4}[ .-]\d{3}[ .-]\d{3,4}(?!\d)"
    r"|\d{2,4}(?:-\d{3}[ .-]|[ .]\d{3}-)\d{3,4}(?!\d)"
    r"|(?:(?:(?<!\d[ .,-])|(?<=\b1[ .-]))\d{2,4}[ .]\d{3}[ .]\d{4}|(?<!\d[ .,-])0\d{1,3}[ .]\d{3}[ .]\d{3})(?!\d|[.,-]\d)"
    rf"|(?i:{_PHONE_WORD})[^\w\n+(]{{0,3}}(?:(?i:number|nummer|numéro|número|no|nr|num|is|at|on|me|us|ist|est|es)\b[^\w\n+(]{{0,3}}){{0,3}}(?P<phone_value>\+?\(?{_OTHER}\d(?:{_DIGIT}){{6,13}})(?!\d|-\d))",
    "person": rf"\b(?P<title>{'|'.join(TITLES)})\b\.?\s(?P<name>{_SMALL}{_NAME}(?:\s{_SMALL}{_NAME})?)",
}
DETECT = re.compile("|".join(f"(?P<{k}>{v})" for k, v in PATTERNS.items()))
#: Every entity has one of these, or a title before it.
_ANCHOR = re.compile(r"[\d@=:]")
_CODE_OF = re.compile(rf"\+({_CODE})")
_WORD = re.compile(rf"(?<!\w){_NAME}(?!\w)")
_REACH = 64


def _windows(text: str) -> list[tuple[int, int]]:
    """Parts of a text that hold all its entities: whole words about every anchor, with _REACH characters on either side."""
    spots = [m.start() for m in _ANCHOR.finditer(text)]
    for t in TITLES:
        at = text.find(t)
        while at >= 0:
            spots.append(at)
            at = text.find(t, at + len(t))
    out: list[tuple[int, int]] = []
    for p in sorted(spots):
        if out and p < out[-1][1] - _REACH:
            continue
        a = b = p
        while a > 0 and not text[a - 1].isspace():
            a -= 1
        while b < len(text) and not text[b].isspace():
            b += 1
        a, b = max(0, a - _REACH), min(len(text), b + _REACH)
        while a > 0 and not text[a - 1].isspace():
            a -= 1
        while b < len(text) and not text[b].isspace():
            b += 1
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _script(ch: str) -> str:
    return unicodedata.name(ch, "LATIN").split(" ")[0]


class Surrogates:
    """Keyed surrogates of normalised entities."""

    def __init__(self, key: bytes) -> None:
        self.key = hashlib.blake2b(key, digest_size=32).digest()
        self.made: dict[tuple, Permutation] = {}
        self.known: dict[tuple[str, str], str] = {}

    def _perm(self, label: str, n: int) -> Permutation:
        if (label, n) not in self.made:
            if len(self.made) > 10_000:
                self.made.clear()
            self.made[label, n] = Permutation(self.key, f"{label}/{n}", n)
        return self.made[label, n]

    def shaped(self, label: str, text: str, classes: dict[str, str] = _CLASS) -> str:
        """text with every character of a class permuted jointly within its format; others stay."""
        places = [i for i, c in enumerate(text) if c in classes]
        if not places:
            return text
        n = x = 0
        n, x = 1, 0
        for i in places:
            s = classes[text[i]]
            n, x = n * len(s), x * len(s) + s.index(text[i])
        shape = "".join(classes[c][0] if c in classes else c for c in text)
        y = self._perm(f"{label}/{shape}", n)(x)
        out = list(text)
        for i in reversed(places):
            s = classes[text[i]]
            y, r = divmod(y, len(s))
            out[i] = s[r]
        return "".join(out)

    def digits(self, label: str, text: str) -> str:
        return str(self._perm(f"{label}/{len(text)}", 10 ** len(text))(int(text))).zfill(len(text)) if text else text

    def card(self, d: str) -> str:
        valid = luhn(d)
        if valid:
            body = d[0] + self.digits(f"card/{d[0]}", d[1:-1])
            return next(body + c for c in "0123456789" if luhn(body + c))
        out = d
        while True:  # walks on until the number is as invalid as the one given
            out = d[0] + self.digits(f"plain/{d[0]}", out[1:])
            if not luhn(out):
                return out

    def ip(self, text: str) -> str:
        x = int.from_bytes(bytes(map(int, text.split("."))), "big")
        for base, bits in ((10 << 24, 24), (172 << 24 | 16 << 16, 20), (192 << 24 | 168 << 16, 16), (127 << 24, 24)):
            if x >> bits == base >> bits:
                y = base | self._perm(f"ip/{base}", 1 << bits)(x - base)
                break
        else:
            y = x
            while True:
                y = self._perm("ip", 1 << 32)(y)
                if not any(y >> bits == base >> bits for base, bits in ((10 << 24, 24), (172 << 24 | 16 << 16, 20), (192 << 24 | 168 << 16, 16), (127 << 24, 24))):
                    break
        return ".".join(map(str, y.to_bytes(4, "big")))

    def email(self, text: str) -> str:
        host, _, tld = text.rpartition(".")
        return self.shaped("email/" + tld, host) + "." + tld

    def name(self, name: str) -> str:
        """One surrogate for a name, be it a given or a family name: after a title it may be either."""
        if name in _GENDER_OF:
            names = GIVEN[_GENDER_OF[name]]
            return names[self._perm(f"given/{names[0]}", len(names))(names.index(name))]
        # A last vowel stays, as it tells the gender in many languages.
        end = name[-1] if len(name) > 2 and name[-1] in _VOWELS else ""
        out = name
        while True:  # a made-up name is never one of the known ones
            out = self.shaped(f"name/{end}", out[: len(out) - len(end)]) + end
            if out not in _GENDER_OF:
                return out

    def secret(self, text: str) -> str:
        if text.isascii() and text.isdigit():
            return self.digits("secret", text)
        out = text
        if all(c in _HEX for c in text):
            while True:  # never one of decimal digits alone: those have surrogates of their own
                out = self.shaped("hex", out, _HEX)
                if not out.isdigit():
                    return out
        while True:  # never one of hexadecimal digits alone: those have surrogates of their own
            out = self.shaped("secret", out)
            if not all(c in _HEX for c in out):
                return out

    def of(self, kind: str, text: str) -> str:
        """The surrogate of a normalised entity; remembered for as long as some thousands are in use."""
        if (got := self.known.get((kind, text))) is None:
            if len(self.known) > 50_000:
                self.known.clear()
            base = kind.partition("/")[0]
            if base == "email":
                got = self.email(text)
            elif base == "ip":
                got = self.ip(text)
            elif base == "card":
                got = self.card(text)
            elif base == "secret":
                got = self.secret(text)
            elif base == "name":
                got = self.name(text)
            else:
                got = self.digits(kind, text)
            self.known[kind, text] = got
        return got


def _refilled(shape: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def _phone(raw: str, made: Surrogates) -> str:
    """A phone number's surrogate: its country code and the bracketed zero that isn't dialled stay, whatever its groups are."""
    code = _CODE_OF.match(raw)
    cc = code[1] if code else ""
    kept = raw.replace("(0)", "()") if cc else raw
    d = "".join(c for c in kept if c.isdigit())
    return _refilled(kept, cc + made.of(f"phone/{cc}", d[len(cc) :])).replace("()", "(0)")


def _mentions(text: str, found: list[tuple[str, int, int, str]]) -> list[tuple[str, int, int, str]]:
    """found, and the bare mentions of its persons' names: both names in a row, or either alone."""
    names: dict[str, str] = {}
    first: dict[str, str] = {}
    pairs: set[tuple[str, str]] = set()
    for kind, a, b, new in found:
        if kind == "person":
            old, new = ([w for w in x.split() if w not in PARTICLES] for x in (text[a:b], new))
            if len(old) == 2:
                pairs.add((old[0], old[1]))
                first[old[0]] = new[0]
            names[old[-1]] = new[-1]
    if not names:
        return found
    spans = [(a, b) for _, a, b, _ in found] + [(len(text) + 1, len(text) + 1)]
    out, k, skip = list(found), 0, 0
    words = [m.span() for m in _WORD.finditer(text)]
    for i, (a, b) in enumerate(words):
        while spans[k][1] <= a:
            k += 1
        w = text[a:b]
        if a < skip or b > spans[k][0] or w not in names and w not in first:
            continue
        if i + 1 < len(words) and (w, text[slice(*words[i + 1])]) in pairs and text[b : words[i + 1][0]].isspace() and words[i + 1][1] <= spans[k][0]:
            skip = words[i + 1][1]
            out.append(("person", a, skip, first[w] + text[b : words[i + 1][0]] + names[text[slice(*words[i + 1])]]))
        else:
            out.append(("person", a, b, names.get(w) or first[w]))
    return sorted(out, key=lambda f: f[1])


def _cased(like: str, text: str) -> str:
    return "".join(b.upper() if a.isupper() and not b.isupper() else b for a, b in zip(like, text, strict=True)) if len(like) == len(text) else text


def scrub_text(text: str, made: Surrogates) -> tuple[str, list[tuple[str, int, int, str]]]:
    """The text with its entities replaced, and (type, start, end in the old text, surrogate) of each."""
    if not text:
        return text, []
    found: list[tuple[str, int, int, str]] = []
    for m in (m for a, b in _windows(text) for m in DETECT.finditer(text, a, b)):
        kind = m.lastgroup if m.lastgroup in PATTERNS else next(k for k in PATTERNS if m[k] is not None)
        a, b = m.span()
        raw = m[0]
        if kind == "email":
            low = raw.lower()
            new = _cased(raw, made.of(kind, low))
        elif kind == "secret":
            a, b = m.span("secret_value")
            raw = m["secret_value"]
            new = made.of(kind, raw)
        elif kind == "ip":
            low = ".".join(str(int(x)) for x in raw.split("."))
            new = made.of(kind, low)
        elif kind == "person":
            a, b = m.span("name")
            parts = m["name"].split()
            capital = [k for k, p in enumerate(parts) if p[0].isupper()]
            if not capital:
                continue
            # Up to the last capital; a small word that isn't a particle ends the name.
            last = capital[-1]
            if any(p not in PARTICLES for p in parts[: last + 1] if not p[0].isupper()):
                last = capital[0]
                if any(p not in PARTICLES for p in parts[:last]):
                    continue
            capital = [k for k in capital if k <= last]
            b = a + [w.end() for w in re.finditer(r"\S+", m["name"])][last]
            new = "".join(made.of("name", p) + gap if k in capital else p + gap for k, (p, gap) in enumerate(re.findall(r"(\S+)(\s*)", text[a:b])))
        else:
            d = "".join(c for c in raw if c.isdigit())
            if kind == "phone":
                if m["phone_value"]:
                    a, b = m.span("phone_value")
                new = _phone(text[a:b], made)
            elif kind == "ssn":
                new = _refilled(raw, made.of("ssn", d))
            else:
                new = _refilled(raw, made.of("card", d))
        found.append((kind, a, b, new))
    if not found:
        return text, found
    found = _mentions(text, found)
    out, at = [], 0
    for _, a, b, new in found:
        out += [text[at:a], new]
        at = b
    out.append(text[at:])
    return "".join(out), found


def scrub(docs: DataFrame, key: bytes, *, text_col: str = "text", entities_col: str | None = "entities") -> DataFrame:
    """docs with text_col scrubbed; entities_col: array of (type, start, stop, surrogate), code points of the old text (None: no such column)."""
    C.ship(docs.sparkSession)
    columns = [c for c in docs.columns if c != entities_col]
    held = docs.select(*[f"`{c}`" for c in columns])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema.fields)
    if entities_col:
        schema += f", `{entities_col}` array<struct<type:string,start:int,stop:int,surrogate:string>>"
    kind = pa.list_(pa.struct([("type", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("surrogate", pa.string())]))

    def run(batches):
        made = Surrogates(key)
        for batch in batches:
            for part in C.blocks(batch, text_col):
                texts = C.column(part, text_col).to_pylist()
                entities: list = [[] for _ in texts]
                for i, t in enumerate(texts):
                    if t:
                        texts[i], found = scrub_text(t, made)
                        entities[i] = [dict(zip(("type", "start", "stop", "surrogate"), f, strict=True)) for f in found]
                arrays = [pa.array(texts, pa.string()) if c == text_col else C.column(part, c) for c in columns]
                yield pa.RecordBatch.from_arrays([*arrays, *([pa.array(entities, kind)] if entities_col else [])], [*columns, *([entities_col] if entities_col else [])])

    return held.mapInArrow(C.tidy(run), schema)


#: The key of the registered queries; a production run passes its own secret.
QUERY_KEY = b"panelweft surrogate key"


def op5_pii(spark, sf_dir: str) -> DataFrame:
    """documents with scrubbed texts and what was found."""
    return scrub(C.table(spark, sf_dir, "documents").select("doc_id", "text"), QUERY_KEY).selectExpr("doc_id", "text", "cast(size(entities) as long) AS n_entities", "array_join(transform(entities, e -> e.type), ',') AS types")
