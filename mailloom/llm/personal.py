"""Personal information in free text: detection, typed placeholders, and keyed surrogates.

Addresses, numbers and streets are found by patterns; people by a dictionary of given names and surnames that
is collected from the corpus's own header fields and mailboxes, extended by the word beginnings and endings
its surnames are made of. A given name that is also an ordinary word counts only beside another name or in
a place where a person is addressed or named. Spans are found on the text exactly as it stands.
"""

from __future__ import annotations

import hashlib
import hmac
import json
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailloom.session import scratch_path, spread, written

KINDS = ("email", "phone", "id_number", "address", "name")
GAP = r"[ \t\xa0  ]"

EMAIL = re.compile(
    rf"""(?<![\w.+-])[A-Za-z0-9][\w.+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{{2,}}(?![\w-])
    | (?<![\w.+-])[A-Za-z0-9][\w.+-]*{GAP}?[(\[{{]{GAP}?at{GAP}?[)\]}}]{GAP}?[A-Za-z0-9-]+(?:(?:\.|{GAP}?[(\[{{]{GAP}?dot{GAP}?[)\]}}]{GAP}?|{GAP}dot{GAP})[A-Za-z0-9-]+)+
    | (?<![\w.+-])[A-Za-z0-9][\w.+-]*{GAP}at{GAP}[A-Za-z0-9-]+(?:{GAP}dot{GAP}[A-Za-z0-9-]+)+""",
    re.X | re.I,
)
PHONE = re.compile(
    r"""(?<![\w.+/=-])(?:
      \+44[ .-]?\(?0?\)?\d{2,4}[ .-]?\d{3,4}[ .-]?\d{3,4}
    | \+\d{1,3}[ .-]?\(?\d{2,4}\)?[ .-]?\d{3}[ .-]?\d{4}
    | (?:1[ .-])?\(?[2-9]\d{2}\)?[ .-]\d{3}[ .-]\d{4}
    | \([2-9]\d{2}\)\d{3}[ .-]?\d{4}
    | [2-9]\d{2}[2-9]\d{6}
    | [2-9]\d{2}[-.]\d{4}
    )(?![\w/=-]|\.\d)""",
    re.X,
)
SSN = re.compile(r"(?<![\w.-])\d{3}([-. ])\d{2}\1\d{4}(?![\w-]|\.\d)")
SSN_NEAR = re.compile(r"(?i)(?:\bSSN|\bbadge form|social[ -]security(?:[ -](?:number|no\.?))?)\W{0,3}(?:is |no\.? |number |of )?(\d{9})(?!\w)|(?<![\w-])(\d{9})(?= as the social[ -]security)")
INSURANCE = re.compile(r"(?<![\w-])[A-Za-z]{2}([- ]?)\d{2}([- ]?)\d{2}([- ]?)\d{2}[- ]?[A-Da-d](?![\w-])")
DOCUMENT = re.compile(r"(?i)\b(?:passport|driver'?s?'? licen[cs]e)(?:\s+(?:no\.?|number|nr\.?|#))?\s*:?\s*((?=[A-Z-]*\d)[A-Z]{0,3}-?\d[\dA-Z-]{4,16}[\dA-Z])(?![\w-])")
LICENCE = re.compile(r"(?<![\w-])[A-Z]\d{3}-\d{4}-\d{4}(?![\w-])")

# Street types, and units that make "24 Hour Drive" no address.
STREET_TYPES = "Street|St|Road|Rd|Avenue|Ave|Boulevard|Blvd|Lane|Ln|Drive|Dr|Court|Ct|Terrace|Ter|Way|Place|Pl|Square|Sq|Parkway|Pkwy|Circle|Cir|Highway|Hwy|Close|Crescent|Row|Walk"
NO_STREET = "Hour|Point|Day|Week|Month|Year|Minute|Mile|Step|Way|Man|Page|Star|Percent|Lot|Lots|Plan"
NO_TOWN = "ASK|SINCE|BECAUSE|WHENEVER|ALTHOUGH|UNLESS|GIVEN|SO|AS|IF|NOW|WHILE|EVEN|PLEASE|THE|AND|BY|ON|BEFORE|AFTER|SUITE|UNIT|APT|ROOM|FLOOR"
_WORD = r"[A-Z][A-Za-z'’]+"
_PLACE = rf"(?:,?{GAP}+[A-Z]{{2}}(?:{GAP}+\d{{5}}(?:-\d{{4}})?)?(?![\w]))"
ADDRESS = re.compile(
    rf"""(?<![\w.,/#-])\d{{1,5}}[A-Z]?{GAP}+(?:(?:[NSEW]|NE|NW|SE|SW|North|South|East|West|Old|New)\.?{GAP}+)?(?!(?:{NO_STREET})\b)(?:(?!(?:{STREET_TYPES})\b){_WORD}{GAP}+){{1,3}}(?:{STREET_TYPES}|{STREET_TYPES.upper()})\b\.?
        (?:,?{GAP}*(?:(?:Suite|Ste\.?|Apt\.?|Apartment|Unit|Room|Floor|SUITE|APT|UNIT){GAP}+[\dA-Z]+|\#{GAP}?\w+))?
        (?:,{GAP}*(?!(?:{NO_TOWN})\b){_WORD}(?:{GAP}(?!(?:{NO_TOWN})\b)[A-Z][a-z]+)?{_PLACE}?|{_PLACE})?
    | \b[A-Z][A-Za-zäöüß]+(?:weg|straße|strasse|str\.|platz|allee|gasse|WEG|STRASSE|PLATZ){GAP}+\d{{1,4}}[a-zA-Z]?\b(?:,{GAP}*\d{{5}}{GAP}+[A-ZÄÖÜ][\wäöüß]+)?
    | \bP\.?{GAP}?O\.?{GAP}?Box{GAP}+\d+(?:,{GAP}*{_WORD}{_PLACE}?)?""",
    re.X,
)

# Given names that are also ordinary words.
WORD_NAMES = frozenset(
    "may mark will art rich rose grace faith hope drew dawn dean frank bill jack penny pat sunny chase miles bob rob sue gene ray june april august lance "
    "wade grant joy iris ivy lily ruby pearl jade violet olive holly ginger basil clay cliff dale glen heath reed forest brook lane stone chance rusty skip "
    "buddy chip chuck dick don guy hank harry herb jay jerry jim josh ken kit lee les marina max mike mort nick norm ned pierce rex rod roman sandy sky sterling "
    "terry tony victor virginia wally ward warren woody melody star summer autumn charity constance prudence patience victoria angel christian daisy".split()
)
MONTH_NAMES = frozenset(("may", "june", "april", "august"))
_ADDRESSED = re.compile(
    r"(?:(?:\b(?:hi|hello|hey|dear|morning|afternoon|evening|greetings|ask|loop in|cc|belongs to|number of|contact|attn|tell|call|thanks|thank you|thx|regards|rgds|best|br|cheers|sincerely|soon|wishes|"
    r"letter for|file for|both|it was|by|mr|mrs|ms|dr|prof|miss|with|from|to|herr|frau)\b\.?[,:]?|[,;])[ \t\xa0]*[-/~*]{0,3}[ \t\xa0]*|(?:^|[\r\n>]|>>|\|)[ \t\xa0]*(?:(?:From|To|Cc|Von|An|De|Sent by)[ \t]*:[ \t]*|[-/~*–—]{1,3}[ \t]*)?)$",
    re.I,
)
_DAY = re.compile(r"[ \t ]*\d")
_ASKED = re.compile(r"(?i)\b(?:hi|hello|hey|dear|good morning|good afternoon|good evening|ask|loop in|cc|belongs to|number of|letter for|file for|call|mr|mrs|ms|dr)\.?[ \t ]+$")
_CLOSING = re.compile(r"(?i)\b(?:thanks|thank you|thx|regards|rgds|best|br|cheers|sincerely|soon|wishes)[,.]?\s*[-/~]{0,2}\s*$")
_SUBJECT = re.compile(r"['’]s (?:note|desk|mail)|[ \t\xa0]+(?:now lives|is at|is out|has|had|was|said|wrote|sent|took|put)\b|[ \t\xa0]+[a-z]{2,}ed the\b")
_LINE_BEFORE = re.compile(r"(?:^|[\r\n])(?:[A-Z]{0,3}[>|][ \t]*)*(?:<[^<>]*>)*[ \t\xa0]*[-/~*–—]{0,3}[ \t\xa0]*$")
_LINE_AFTER = re.compile(r"[ \t\xa0]*(?:<[^<>]*>)*[ \t\xa0]*(?:$|[\r\n])")
_SENTENCE = re.compile(r"(?:^|[.!?>|:*-]|[\r\n])[\s>|*-]*$")
_NAMED = re.compile(r"[ \t\xa0]+(?:and|when|before|to)\b|['’]s note|[ \t\xa0]+(?:now lives|wrote|a écrit|said|writes)\b|[ \t\xa0]*[.](?:\s|$)|, not\b|[ \t\xa0]*[,:!]?[ \t\xa0]*(?:[-–—]{1,2}[ \t\xa0]*)?(?:$|[\r\n<])|,[ \t\xa0]", re.M)
TOKEN = re.compile(r"[^\W\d_]+(?:[-][^\W\d_]+)*")
_INITIALS = re.compile(rf"(?<![\w.@])(?:[A-Z]\.{GAP}?){{1,3}}$")
_BETWEEN = re.compile(rf"{GAP}{{1,3}}(?:[A-Z]\.?{GAP}{{1,2}}){{0,2}}$")
_COMMA = re.compile(rf",{GAP}{{1,2}}(?:[A-Z]\.?{GAP}{{1,2}}){{0,2}}$")


class People:
    """Given names, surnames, and the endings surnames are made with."""

    def __init__(self, given: set[str], surnames: set[str]) -> None:
        self.given, self.surnames = given, surnames - given
        begins = Counter(s[:4] for s in self.surnames if len(s) > 6)
        ends = Counter(s[-k:] for s in self.surnames if len(s) > 6 for k in (3, 4, 5))
        floor = max(3, len(self.surnames) // 200)
        self.begins = {b for b, n in begins.items() if n >= floor}
        self.ends = {e for e, n in ends.items() if n >= floor}
        self._made: dict[str, bool] = {}

    def surname(self, word: str) -> bool:
        """A known surname, or one made of a usual beginning and a usual ending."""
        if word in self.surnames:
            return True
        if len(word) < 7 or word[:4] not in self.begins:
            return False
        if len(self._made) > 100_000:
            self._made.clear()
        if word not in self._made:
            self._made[word] = any(word[-k:] in self.ends for k in (3, 4, 5))
        return self._made[word]


def names(text: str, people: People) -> list[tuple[int, int]]:
    """Spans of people's names, in runs of given name, surname and initials."""
    found: list[tuple[int, int, str, bool]] = []  # start, end, lower-cased word, is a given name
    given, surname = people.given, people.surname
    begins = people.begins
    for m in TOKEN.finditer(text):
        word = m[0].lower()
        if word in given:
            found.append((m.start(), m.end(), word, True))
        elif (word in people.surnames or word[:4] in begins) and surname(word):
            found.append((m.start(), m.end(), word, False))
    out, i = [], 0
    while i < len(found):
        start, end, word, is_given = found[i]
        kinds, last = [is_given], i
        while last + 1 < len(found) and found[last + 1][0] - end <= 10 and len(kinds) < 3:
            between, other = text[end : found[last + 1][0]], found[last + 1]
            if text[end - 1].islower() != text[other[1] - 1].islower() and not text[other[0]].isupper():
                break
            if _BETWEEN.fullmatch(between) and (kinds[-1] != other[3]) or _COMMA.fullmatch(between) and not is_given and other[3] and len(kinds) == 1:
                kinds.append(other[3])
                end, last = other[1], last + 1
                if len(kinds) == 2:
                    break
            else:
                break
        first = text[start]
        if len(kinds) == 1:
            before, after = text[max(0, start - 40) : start], text[end : end + 24]
            if is_given:
                if word in WORD_NAMES or not first.isupper():
                    alone = _LINE_BEFORE.search(before) and _LINE_AFTER.match(text, end)
                    if not alone and not text[start:end].isupper() and (word not in MONTH_NAMES or not _DAY.match(after)):
                        closing = _CLOSING.search(before) and _NAMED.match(after)
                        alone = closing if not first.isupper() else (
                            closing or _ASKED.search(before) or _ADDRESSED.search(before) and _NAMED.match(after) or _SUBJECT.match(after)
                        )
                        if word in MONTH_NAMES and alone and not closing and not _ASKED.search(before) and not _SUBJECT.match(after):
                            alone = re.match(r"[ \t ]*[,-]", after) and _SENTENCE.search(before)
                    if not alone:
                        i += 1
                        continue
                elif text[start:end].isupper() and len(word) > 1 and word in WORD_NAMES:
                    i += 1
                    continue
            elif not first.isupper():
                i += 1
                continue
        elif not first.isupper() and word in WORD_NAMES and not text[end - 1].isalpha():
            i += 1
            continue
        if lead := _INITIALS.search(text, max(0, start - 12), start):
            start = lead.start()
        out.append((start, end))
        i = last + 1
    return out


def detect(text: str | None, people: People) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every mention, without overlaps, in order; none of a null or empty text."""
    if not text:
        return []
    spans: list[tuple[int, int, str]] = []

    def add(kind: str, start: int, end: int) -> None:
        if all(end <= s or start >= e for s, e, _ in spans):
            spans.append((start, end, kind))

    if "@" in text or "at" in text and (" dot " in text or "(at)" in text or "[at]" in text or " DOT " in text or "(AT)" in text):
        for m in EMAIL.finditer(text):
            add("email", *m.span())
    for m in SSN.finditer(text):
        add("id_number", *m.span())
    for m in INSURANCE.finditer(text):
        if m[0][:2].isupper() and m[0][-1].isupper():
            add("id_number", *m.span())
    for m in LICENCE.finditer(text):
        add("id_number", *m.span())
    if re.search(r"(?i)passport|licen|ssn|social|badge form", text):
        for m in SSN_NEAR.finditer(text):
            add("id_number", *m.span(1 if m[1] else 2))
        for m in DOCUMENT.finditer(text):
            add("id_number", *m.span(1))
    for m in ADDRESS.finditer(text):
        add("address", *m.span())
    for m in PHONE.finditer(text):
        add("phone", *m.span())
    hidden = text
    if spans:
        parts, at = [], 0
        for s, e, _ in sorted(spans):
            parts += [text[at:s], "\x01" * (e - s)]
            at = e
        hidden = "".join([*parts, text[at:]])
    for s, e in names(hidden, people):
        spans.append((s, e, "name"))
    return [(k, s, e) for s, e, k in sorted(spans)]


def replaced(text: str | None, spans: list[tuple[str, int, int]], by: object) -> str | None:
    """The text with by(kind, mention) in each mention's place."""
    if text is None:
        return None
    out, at = [], 0
    for kind, s, e in spans:
        out += [text[at:s], by(kind, text[s:e])]
        at = e
    return "".join([*out, text[at:]])


_LETTERS = re.compile(r"[^\W\d_]+")
_RUNS = re.compile(r"[^\W\d_]+|\d+")
_AT = re.compile(rf"({GAP}?[(\[{{]{GAP}?at{GAP}?[)\]}}]{GAP}?|{GAP}at{GAP}|@)", re.I)
_DOT = re.compile(rf"({GAP}?[(\[{{]{GAP}?dot{GAP}?[)\]}}]{GAP}?|{GAP}dot{GAP}|\.)", re.I)
_COUNTRY = re.compile(r"\+\d{1,3}(?=\D)")
_TYPES = frozenset(STREET_TYPES.lower().split("|"))
_FUSED = re.compile(r"(?<=..)(?:weg|straße|strasse|str|platz|allee|gasse)$", re.I)
_UNIT = re.compile(rf"(?:Suite|Ste|Apt|Apartment|Unit|Room|Floor|SUITE|APT|UNIT)\b\.?{GAP}+[\dA-Z]+\b")
_BOX = re.compile(rf"P\.?{GAP}?O\.?{GAP}?Box\b")


@lru_cache(maxsize=4096)
def alphabet(c: str, last: bool) -> str:
    """The characters that may stand for the lower-cased c: vowels for vowels, consonants for consonants, digits for digits, other letters for those of their block.

    The last letter tells the gender of a given name, so a, e, i and o, u are apart there. Other characters stand for themselves.
    """
    for group in ("aei", "ou") if last else ("aeiou",):
        if c in group:
            return group
    for group in ("bcdfghjklmnpqrstvwxyz", "0123456789"):
        if c in group:
            return group
    cased = lambda d: d.isalpha() and d.lower() == d and len(d.upper()) == 1 and d.upper().lower() == d
    if c.isascii() or not cased(c):
        return c
    block = ord(c) & ~0xFF
    return "".join(d for d in map(chr, range(block, block + 256)) if cased(d))


class Surrogates:
    """Keyed, type-consistent replacements: equal mentions get equal ones, different ones different ones.

    All are functions of the key and the mention alone, so tasks, retries and partitionings agree without sharing
    anything. Digits go through a keyed permutation of digit strings of their length (a Feistel network); words go
    through a keyed cycle over all words of their form (alphabet() of each place), which can neither collide nor
    leave a word as it is. Case, order, separators and the form of each mention stay; given names keep the gender
    their ending suggests.
    """

    ROUNDS = 4  # each way

    def __init__(self, key: bytes) -> None:
        if not key:
            raise ValueError("surrogates need a secret key")
        self.key = key
        self.short = hashlib.blake2b(key).digest()
        self.words: dict[str, str] = {}

    def number(self, *parts: object) -> int:
        return int.from_bytes(hmac.digest(self.key, "\x1f".join(map(str, parts)).encode(), "sha256")[:8], "big")

    def digits(self, digits: str, kind: str) -> str:
        if len(digits) < 2:
            return digits
        h = len(digits) // 2
        a, b = digits[:h], digits[h:]
        for k in range(4):
            a, b = b, str((int(a) + self.number(kind, len(digits), k, b)) % 10 ** len(a)).zfill(len(a))
            if len(a) == len(b):
                continue
        return a + b

    def large(self, *parts: object) -> int:
        return int.from_bytes(hashlib.blake2b("\x1f".join(map(str, parts)).encode(), key=self.short).digest(), "big")

    def cycled(self, low: str) -> str:
        """The next word in a keyed cycle over all words of this one's form: a Feistel network's places, counted one up."""
        letters = [i for i, c in enumerate(low) if c.isalpha()]
        sets = [alphabet(c, bool(letters) and i == letters[-1]) for i, c in enumerate(low)]
        half = (len(low) + 1) // 2
        sizes = [math.prod(map(len, sets[:half])), math.prod(map(len, sets[half:]))]
        form = "\x1f".join(x if len(x) == 1 else x[0] + str(len(x)) for x in sets)
        x = [0, 0]
        for i, (c, group) in enumerate(zip(low, sets)):
            x[i >= half] = x[i >= half] * len(group) + group.index(c)

        def turned(sign: int) -> None:
            for k in range(self.ROUNDS)[::sign]:
                x[k % 2] = (x[k % 2] + sign * self.large("word", form, k, x[1 - k % 2])) % sizes[k % 2]

        turned(1)
        x[:] = divmod((x[0] * sizes[1] + x[1] + 1) % (sizes[0] * sizes[1]), sizes[1])
        turned(-1)
        out = []
        for i in reversed(range(len(low))):
            x[i >= half], k = divmod(x[i >= half], len(sets[i]))
            out.append(sets[i][k])
        return "".join(reversed(out))

    def word(self, word: str) -> str:
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in word)
        if low not in self.words:
            if len(self.words) > 100_000:
                self.words.clear()
            self.words[low] = self.cycled(low)
        return "".join(n.upper() if c != d and len(n.upper()) == 1 else n for n, c, d in zip(self.words[low], word, low))

    def address(self, mention: str) -> str:
        """Every number and word is replaced, of any length and case, but the street type, unit words before a unit, and "P.O. Box"."""
        digits = "".join(filter(str.isdigit, mention))
        new = iter(self.digits(digits, "address") if len(digits) > 1 else self.word(digits))
        mention = "".join(next(new) if c.isdigit() else c for c in mention)
        box = _BOX.match(mention)
        out, at, typed = [mention[: box.end() if box else 0]], box.end() if box else 0, box is not None
        for m in _LETTERS.finditer(mention, at):
            word, out, at = m[0], [*out, mention[at : m.start()]], m.end()
            fused = _FUSED.search(word) if m.start() == 0 else None
            if fused:
                word, typed = self.word(word[: fused.start()]) + fused[0], True
            elif not typed and out[-1] and m.start() > 0 and word.lower() in _TYPES:
                typed = True
            elif not (typed and _UNIT.match(mention, m.start())):
                word = self.word(word)
            out.append(word)
        return "".join([*out, mention[at:]])

    def email(self, mention: str) -> str:
        """Words by the mapping that names have, so that a person's name and address still belong together, and numbers; the ends of the domain stay."""
        parts = _AT.split(mention, maxsplit=1)
        local, joint, domain = parts if len(parts) == 3 else (mention, "", "")
        labels = _DOT.split(domain)  # labels and what is between them, by turns
        last = len(labels) - 1
        keep = {last, last - 2} if last >= 4 and len(labels[last - 2]) <= 3 else {last}  # "org", "co.uk"
        done = [x if k % 2 or k in keep else self.mixed(x) for k, x in enumerate(labels)]
        return self.mixed(local) + joint + "".join(done)

    def mixed(self, text: str) -> str:
        """Runs of letters as words, runs of digits as digits of one kind; the rest stays."""
        return _RUNS.sub(lambda m: self.word(m[0]) if m[0][0].isalpha() else self.digits(m[0], "mixed") if len(m[0]) > 1 else self.word(m[0]), text)

    def __call__(self, kind: str, mention: str) -> str:
        if kind == "phone":
            country = _COUNTRY.match(mention)
            at = country.end() if country else 0
            new = iter(self.digits("".join(filter(str.isdigit, mention[at:])), kind))
            return mention[:at] + "".join(next(new) if c.isdigit() else c for c in mention[at:])
        if kind == "id_number":
            new = iter(self.digits("".join(filter(str.isdigit, mention)), kind))
            return "".join(next(new) if c.isdigit() else c for c in _LETTERS.sub(lambda m: self.word(m[0]), mention))
        if kind == "email":
            return self.email(mention)
        if kind == "address":
            return self.address(mention)
        return "".join(self.word(part) if len(part) > 1 and part.isalpha() else part for part in re.split(r"([^\W\d_]{2,})", mention))


HEADER = re.compile(r"^\s*([^\W\d_][\w'’-]+),\s*([^\W\d_][\w'’-]+)\s*$|^\s*([^\W\d_][\w'’-]+)\s+(?:[A-Z]\.?\s+)*([^\W\d_][\w'’-]+)\s*$")


def collected_people(emails: DataFrame, mailboxes: DataFrame, most: int = 3_000_000) -> str:
    """Path of the name dictionary: (part, word) from x_from, x_to, x_cc and owner_name, written once to the shared folder.

    A given name counts if it stands beside at least two surnames, or in a mailbox, and a surname beside such a given
    name; the parts of a name are told from its form ("Surname, Given" or "Given Surname"). Its size is the number of different names, not of rows; it is counted before any worker loads it.
    """
    spark = emails.sparkSession
    listed = emails.select(F.explode(F.split(F.concat_ws(";", "x_from", "x_to", "x_cc"), ";")).alias("n")).filter("n not like '%@%' and n <> ''").groupBy(F.trim("n").alias("n")).agg(F.count("*").alias("c"), F.lit(False).alias("owner"))
    owners = mailboxes.select(F.trim("owner_name").alias("n"), F.lit(1).cast("long").alias("c"), F.lit(True).alias("owner")).filter("n is not null")
    comma = r"^([\p{L}'’-]+), *([\p{L}'’-]+)$"
    plain = r"^([\p{L}'’-]+) +(?:[A-Z]\.? +)*([\p{L}'’-]+)$"
    both = listed.unionByName(owners)
    swapped = F.col("n").rlike(comma)
    named = both.filter(swapped | F.col("n").rlike(plain)).select(
        F.lower(F.when(swapped, F.regexp_extract("n", comma, 2)).otherwise(F.regexp_extract("n", plain, 1))).alias("given"),
        F.lower(F.when(swapped, F.regexp_extract("n", comma, 1)).otherwise(F.regexp_extract("n", plain, 2))).alias("surname"), "c", "owner")
    full = named.groupBy("given", "surname").agg(F.sum("c").alias("c"), F.max("owner").alias("owner"))
    partners = full.groupBy("given").agg(F.count("*").alias("partners"), F.max("owner").alias("owner"))
    parts = full.drop("owner").join(partners, "given")
    path = scratch_path(spark, "people")
    pairs = written(parts, "names")
    given = pairs.filter("owner or partners >= 2").select("given").distinct()
    kept = pairs.join(F.broadcast(given) if given.count() <= 100_000 else given, "given", "left_semi")
    words = kept.select(F.explode(F.array(F.struct(F.lit("given").alias("part"), F.col("given").alias("word")), F.struct(F.lit("surname").alias("part"), F.col("surname").alias("word")))).alias("p"), "c")
    votes = words.groupBy("p.part", "p.word").agg(F.sum("c").alias("c"))
    named = written(votes.groupBy("word").agg(F.max_by("part", F.struct("c", "part")).alias("part")).filter("length(word) > 1").select("part", "word"), "people")
    if (n := named.count()) > most:
        raise ValueError(f"{n} names are more than the {most} that every worker may load; raise `most` where workers have the memory (about 100 bytes a name)")
    named.write.json(path)
    return path


@lru_cache(maxsize=2)
def loaded_people(path: str) -> People:
    fs, root = pafs.FileSystem.from_uri(path)
    sets: dict[str, set[str]] = {"given": set(), "surname": set()}
    for f in fs.get_file_info(pafs.FileSelector(root)):
        if f.path.endswith(".json"):
            for line in fs.open_input_stream(f.path).read().decode().splitlines():
                row = json.loads(line)
                sets[row["part"]].add(row["word"])
    return People(sets["given"], sets["surname"])


def mentions(emails: DataFrame, people: str, fields: tuple[str, ...] = ("body", "subject")) -> DataFrame:
    """(id, field_name, kind, found_text): each distinct mention of each field once per row."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = loaded_people(people)
        for b in batches:
            out: list[tuple] = []
            ids = b.column("id").to_pylist()
            for field in fields:
                for i, text in zip(ids, b.column(field).to_pylist()):
                    for kind, mention in dict.fromkeys((k, text[s:e]) for k, s, e in detect(text, known)):
                        out.append((i, field, kind, mention))
            cols = list(zip(*out)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *[pa.array(c, pa.string()) for c in cols[1:]]], names=["id", "field_name", "kind", "found_text"])

    return spread(emails.select("id", *fields)).mapInArrow(scan, "id long, field_name string, kind string, found_text string")


def rewritten(emails: DataFrame, people: str, key: bytes | None = None, fields: tuple[str, ...] = ("body", "subject")) -> DataFrame:
    """(id, fields): the texts with typed placeholders such as [NAME], or with surrogates of the key (None: placeholders; an empty one is refused). Null texts stay null."""
    if key is not None:
        Surrogates(key)
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = loaded_people(people)
        by = Surrogates(key) if key is not None else lambda kind, _: f"[{kind.upper()}]"
        for b in batches:
            texts = [pa.array([replaced(t, detect(t, known), by) for t in b.column(f).to_pylist()], pa.string()) for f in fields]
            yield pa.RecordBatch.from_arrays([b.column("id"), *texts], names=["id", *fields])

    return spread(emails.select("id", *fields)).mapInArrow(scan, "id long, " + ", ".join(f"{f} string" for f in fields))
