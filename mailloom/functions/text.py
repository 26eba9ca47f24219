"""Text functions in native column expressions. SPACE is Unicode white space, spelled out so that SQL engines agree on it."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\t-\r\x{85}\p{Z}]"
NOT_SPACE = r"[^\t-\r\x{85}\p{Z}]"
# What counts as a link, an address, a phone number and an emoji when entities are removed.
URL = rf"(?i)(https?://{NOT_SPACE}+|www\.{NOT_SPACE}+)"
ADDRESS = r"[\p{L}\p{N}_.-]+@[\p{L}\p{N}_.-]+"
PHONE = r"\d{3}-\d{3}-\d{4}"
EMOJI = r"[\x{1F600}-\x{1F64F}]"
# What begins an earlier message within a body.
THREAD_MARK = (
    r"(?im)^\s*(?:-{2,}\s*original\s+message\s*-{2,}|-{2,}\s*forwarded\s+by.*?-{2,}|-{2,}\s*forwarded\s+message\s*-{2,}"
    r"|on\s+.+?\s+wrote:|from:\s*.+\n\s*(?:sent|date):\s*.+\n\s*to:\s*.+)"
)
# Closing lines of a message.
CLOSINGS = ["thanks", "thank you", "many thanks", "thx", "regards", "best regards", "kind regards", "best", "all the best", "sincerely", "cheers", "br", "rgds", "talk soon"]
# What shows that a body holds markup.
MARKUP = r"(?i)</?[a-z][\s\S]*?>|&(?:amp|lt|gt|quot|nbsp);"
REFERENCE = r"^(#[0-9]{1,9}|#[xX][0-9a-fA-F]{1,8}|[A-Za-z][A-Za-z0-9]*);"
# Named and numeric references by the rules of HTML 5: names that end in a semicolon; 80 to 9F mean Windows 1252.
NAMED = {name[:-1]: char for name, char in html5.items() if name.endswith(";")}
LEGACY = {n: bytes([n]).decode("cp1252", "replace") for n in range(0x80, 0xA0)}


def let(c: Column, body: Callable[[Column], Column]) -> Column:
    """body(c) with c evaluated once, however often body names it: c is bound as the variable of a one-element transform."""
    return F.get(F.transform(F.array(c), body), F.lit(0))


def text(c: Column) -> Column:
    """Null as empty."""
    return F.coalesce(c.cast("string"), F.lit(""))


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def any_of(terms: list[str], whole_line: bool = False) -> str | None:
    """Line-start alternation of literal terms, case-blind; None without terms."""
    terms = [t for t in terms if t.strip()]
    return rf"(?im)^\s*(?:{'|'.join(map(re.escape, terms))})" + (r"\s*$" if whole_line else "") if terms else None


def word_pattern(terms: list[str]) -> str | None:
    """Word-boundary alternation of literal terms, case-blind; None without terms."""
    terms = [t.strip() for t in terms if t.strip()]
    return rf"(?i)\b(?:{'|'.join(map(re.escape, terms))})\b" if terms else None


def unescaped(c: Column) -> Column:
    """Character references resolved once; what is none, or names nothing, stays."""
    names = F.from_json(F.lit(json.dumps(NAMED)), "map<string,string>")  # folded to a literal
    legacy = F.from_json(F.lit(json.dumps(LEGACY)), "map<string,string>")

    def number(reference: Column) -> Column:
        hexed = F.lower(F.substring(reference, 2, 1)) == "x"
        code = F.when(hexed, F.conv(F.substring(reference, 3, 8), 16, 10)).otherwise(F.substring(reference, 2, 9)).cast("long")
        valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.when(~valid, F.lit("\ufffd")).otherwise(F.coalesce(F.element_at(legacy, code.cast("string")), char))

    def part(p: Column, i: Column) -> Column:
        def resolved(reference: Column) -> Column:
            char = F.when(reference.startswith("#"), number(reference)).otherwise(F.element_at(names, reference))
            found = (i > 0) & (reference != "") & char.isNotNull()
            return F.when(found, F.concat(char, F.substring(p, F.length(reference) + 2, F.length(p)))).when(i > 0, F.concat(F.lit("&"), p)).otherwise(p)

        return let(F.regexp_extract(p, REFERENCE, 1), resolved)

    return F.when(c.contains("&"), F.array_join(F.transform(F.split(c, "&"), part), "")).otherwise(c)


def html_to_text(c: Column) -> Column:
    """Text nodes joined by blanks if there is markup, else the text as it is; scripts and styles are dropped. Null gives empty."""
    def nodes(plain: Column) -> Column:
        decoded = F.regexp_replace(unescaped(plain), r"(?is)<(script|style|noscript)\b.*?</\1\s*>|<!--.*?-->", "")
        kept = F.transform(F.split(decoded, r"<[^>]*>"), stripped)
        return F.when(plain.rlike(MARKUP), F.array_join(F.filter(kept, lambda x: x != ""), " ")).otherwise(plain)

    return let(text(c), nodes)


def without_entities(c: Column) -> Column:
    for pattern in (URL, ADDRESS, PHONE, EMOJI):
        c = F.regexp_replace(c, pattern, "")
    return c


def single_spaces(c: Column) -> Column:
    return F.regexp_replace(c, rf"{SPACE}+", " ")


def single_punctuation(c: Column) -> Column:
    return F.regexp_replace(c, r"([!?.,;:])\1+", "$1")


def before(c: Column, pattern: str | None) -> Column:
    """What stands before the first match, stripped."""
    return stripped(F.split(c, pattern, 2)[0]) if pattern else stripped(c)


def without_signature(c: Column, terms: list[str] = CLOSINGS, last: int = 12) -> Column:
    """The lines before the first of the last twelve that is nothing but a closing term."""
    pattern = any_of(terms, whole_line=True)

    def cut(lines: Column) -> Column:
        marks = F.transform(F.slice(lines, F.greatest(F.size(lines) - (last - 1), F.lit(1)), F.lit(last)), lambda x, i: F.when(x.rlike(pattern), i))
        first = F.array_min(F.filter(marks, lambda x: x.isNotNull())) + F.greatest(F.lit(0), F.size(lines) - last)
        return stripped(F.array_join(let(first, lambda f: F.when(f.isNotNull(), F.slice(lines, F.lit(1), F.coalesce(f, F.lit(0)))).otherwise(lines)), "\n"))

    return let(F.split(F.regexp_replace(c, r"\r\n?", "\n"), "\n"), cut)


def clean_subject(c: Column) -> Column:
    """Lower case, without thread markers and any chain of reply and forward prefixes."""
    c = F.regexp_replace(F.lower(text(c)), THREAD_MARK, "")
    return stripped(F.regexp_replace(c, r"^(?:\s*(?:re|fw|fwd)\s*:)+", ""))


def clean_body(c: Column, boilerplate: list[str] = (), closings: list[str] = CLOSINGS, strict: bool = False) -> Column:
    """Body without markup, links, addresses, phones, boilerplate, signature and earlier messages.

    The line-anchored rules come before the lines are joined; strict joins them first, so that a rule only
    sees the body's start, as the original system does. Null gives empty.
    """
    c = F.lower(html_to_text(c))
    if strict:
        closings = list(closings)[1:]  # the original system reads the first line of its list as a heading
        c = without_entities(F.replace(c, F.lit("\n"), F.lit(" ")))
        c = before(before(c, any_of(list(boilerplate))), None)
        c = before(without_signature(c, closings), THREAD_MARK)
    else:
        c = before(without_signature(before(c, any_of(list(boilerplate))), closings), THREAD_MARK)
        c = without_entities(F.replace(c, F.lit("\n"), F.lit(" ")))
    return stripped(single_punctuation(single_spaces(c)))


def domain_to_end(address: Column) -> Column:
    """All after the first @ of an address, to its end; null without one."""
    return F.nullif(F.regexp_extract(text(address), r"@(.+)$", 1), F.lit(""))


def is_forward(subject: Column) -> Column:
    return text(subject).rlike(r"(?i)^\s*(?:fw|fwd)\s*:")


def is_reply(subject: Column) -> Column:
    return text(subject).rlike(r"(?i)^\s*re\s*:")


def domain(address: Column) -> Column:
    """First domain, as written; null if there is none."""
    return F.nullif(F.regexp_extract(text(address), r"@([^>\s]+)", 1), F.lit(""))


def domains(*lists: Column) -> Column:
    """Sorted distinct domains of all recipient lists; empty if there are none."""
    joined = F.concat_ws(" ", *lists)
    return F.array_sort(F.array_distinct(F.regexp_extract_all(joined, F.lit(r"@([^>\s,;]+)"), F.lit(1))))


def addresses(c: Column) -> Column:
    """Sorted distinct lower-cased addresses in a header text; null if there are none."""
    found = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text(c), F.lit(r"([\w.+-]+@[\w.-]+)"), F.lit(1)), F.lower)))
    return F.when(F.size(found) > 0, found)


def recipients(*lists: Column, strict: bool = False) -> Column:
    """Number of different recipients; strict counts one more if any list is null."""
    empty = F.array().cast("array<string>")
    missing = F.lit("") if strict else F.lit(None).cast("string")
    every = F.concat(*[F.coalesce(x, F.array(missing)) for x in lists])
    return F.size(F.array_distinct(F.filter(every, lambda x: x.isNotNull()))) if lists else F.size(empty)


def n_words(c: Column) -> Column:
    return F.regexp_count(text(c), F.lit(rf"{NOT_SPACE}+"))


def n_sentences(c: Column) -> Column:
    return F.regexp_count(text(c), F.lit(r"[.!?]+"))


def last_segment(path: Column) -> Column:
    return F.element_at(F.split(path, r"\\"), -1)


def sentences(c: Column) -> Column:
    """Sentences of 3 to 200 characters."""
    return F.filter(F.transform(F.split(text(c), r"(?<=[.!?])\s+|[\r\n]+"), stripped), lambda s: F.length(s).between(3, 200))
