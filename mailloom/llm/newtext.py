"""The text an e-mail's sender newly wrote, by semi-Markov segmentation.

Lines are classed by their cues (quote mark, introduction, header, closing formula, name, contact, legal
wording, ...), and runs of lines of one class are the atoms. A semi-Markov model then decodes the most likely
sequence of segments: new text, quoted history, signature, legal notice, gateway warning. A segment's score is
made of its lines' cues, of the cue at its boundary, of its length, and of features of the whole span: a quoted
block without marks runs to the end of the body, a signature begins with a closing formula, name or contact.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from mailloom.session import spread

LINE_END = re.compile(r"\r\n|\r|\n")
TAG = re.compile(r"<(?:/?[A-Za-z][^<>@]*|!--[^<>]*--)>")
ALNUM = re.compile(r"[^\W_]")
MARK = re.compile(r"\s*(?:(?:[A-Z]{0,3}>|\||&gt;)\s*)+")

# Wordings that open or close parts of an e-mail.
_CLOSINGS = r"(?:many thanks|thank you|thanks(?: again)?|thx|tks|(?:best|kind|warm|with kind|with best) regards|regards|rgds|all the best|best wishes|best|br|cheers|sincerely|yours (?:truly|sincerely|faithfully)|talk soon|take care|mit freundlichen gr[üu](?:ß|ss)en|viele gr[üu](?:ß|ss)e|cordialement|bien à vous|saludos)"
_DATE = r"(?:\d{1,4}[-./]\d{1,2}[-./]\d{2,4}|\d{1,2}\.? [A-Za-zÀ-ÿ]{3,9}\.?,? \d{4}|[A-Za-zÀ-ÿ]{3,9}\.? \d{1,2},? \d{4})"
_NAME = r"[^\W\d_][\w.'’-]*(?:,? [^\W\d_][\w.'’-]*){0,3}"
_CLOSINGS, _DATE, _NAME = (x.replace(" ", r"\ ") for x in (_CLOSINGS, _DATE, _NAME))
CLASSES = re.compile(
    rf"""(?:
      (?P<warning>\[(?:external|extern|ext)\]|(?:caution|warning|achtung)\s*:.*\b(?:sender|external|outside|click|links?)\b|\*{{3}}.*\b(?:internal|external|use\ only|confidential)\b.*\*{{3}}\s*$)
    | (?P<block>-{{2,}}\s*(?:original\ message|urspr.ngliche\ nachricht|message\ d.origine|forwarded\ message|mensaje\ original)\s*-{{2,}}|-{{3,}}\s*forwarded\ by\b.*|>>>\s.*|{_NAME}\s+\d{{1,2}}/\d{{1,2}}/\d{{2,4}}\s+\d{{1,2}}:\d{{2}}(?::\d\d)?\s*(?:am|pm)?(?:\s*>>>)?\s*$)
    | (?P<intro>begin\ forwarded\ message:|(?:on|am|le|el)\ .{{0,12}}{_DATE}.{{0,160}}(?:wrote|schrieb(?:\ {_NAME})?|a\ écrit|escribió)(?:\ {_NAME})?\s*:\s*$|(?:on|am|le|el)\ .{{0,12}}{_DATE},?\ \d{{1,2}}:\d{{2}}(?:\ ?[ap]m)?,\ {_NAME}\s*$|<?[\w.+-]+@[\w.-]+>?\ wrote:\s*$|{_NAME}(?:\s+<[^<>]*>)?\s+(?:wrote|writes|schrieb|a\ écrit)\s*:\s*$|wrote:\s*$)
    | (?P<header>(?:from|von|de)\s*:\s*(?:{_NAME}\s*(?:<[^<>]*>|\[[^\[\]]*\])?|<?[\w.+-]+@[\w.-]+>?)\s*$|(?:sent|date|datum|gesendet|envoyé)\s*:\s*.*\d{{1,2}}:\d{{2}}.*$|(?:to|an|à|cc|bcc)\s*:(?:\s*(?:{_NAME}|<?[\w.+-]+@[\w.-]+>?)(?:\s*<[^<>]*>)?[;,]?)*\s*$|(?:subject|betreff|objet)\s*:.*$)
    | (?P<closing>{_CLOSINGS}\s*[,.!]?\s*(?:[-/~]*\s*(?P<who>{_NAME}))?\s*[.,]?\s*$)
    | (?P<note>(?:sent\ from\ (?:my|a|an)|get\ the\ mail\ app|get\ outlook|von\ meinem\ .*\ gesendet|envoyé\ de\ mon)\b.*$)
    | (?P<ps>p\.?\s?s\.?(?=[\s:.]).*)
    | (?P<legal>(?:confidentiality\ (?:notice|note)|legal\ (?:notice|disclaimer)|disclaimer)\s*:?.*)
    )""",
    re.X | re.I,
)
LEGAL = re.compile(
    r"(?i)this (?:message|e-?mail|mail|note|communication)\b.{0,40}\b(?:and any (?:file|attachment)|is (?:confidential|private|privileged|intended|meant)|may (?:hold|contain|be)|is no offer)|information (?:above|below|in this|contained)\b.{0,60}\b(?:private|privileged|secret|restricted|confidential|protected)|"
    r"(?:reached|received|have) (?:you |it |this (?:message |mail )?)?(?:by|in|through) (?:accident|mistake|error|misrouting)|erase it and tell the sender|(?:remove|delete|destroy) (?:every|all|any) cop|named reader alone|intended (?:only |solely )?for the (?:named )?(?:recipient|addressee|person)|"
    r"unauthori[sz]ed use is|(?:copying|disclosure|onward sharing|distribution)\b.{0,60}\b(?:prohibited|forbidden|not allowed|barred)|electronic mail is not secure|e-?mail (?:is not|cannot be guaranteed) |takes? no (?:duty|responsibility|liability) for|views given here|those of the (?:writer|author) and not|check for viruses|viruses before|"
    r"in this e-?mail binds|no offer to buy|terms need a signed|is registered under number|think of the (?:trees|environment)|before printing this|diese nachricht ist vertraulich|nur f(?:ü|ue)r den empf|ce message est confidentiel|este mensaje es confidencial|by anyone but the addressee"
)
CONTACT = re.compile(
    r"""(?:[\w.+-]+(?:@|\s?\(at\)\s?)[\w.-]+(?:\.\w+)+ | .{0,60}\|\s*\+?[\d(][\d\s().+-]{5,} | (?:tel|phone|fax|mobile|cell|mob|t|m|f|direct)\b[.:]?\s*\+?[\d(][\d\s().+-]{5,}.{0,30} | \+?[\d(][\d\s().+-]{6,}
    | \d{1,5}[A-Z]?\s(?:[A-Z][\w.]*\s){1,4}?(?:Street|St|Road|Rd|Avenue|Ave|Boulevard|Blvd|Lane|Ln|Drive|Dr|Court|Ct|Terrace|Ter|Way|Place|Pl|Square)\b\.?.{0,60} | [A-Z]\w+(?:weg|stra(?:ß|ss)e|str\.|platz|allee)\s\d+.{0,50}
    | (?:https?://|www\.)\S+)\s*$""",
    re.X,
)
TITLE = re.compile(r"(?:[A-Z][\w&/-]*\s?){1,4},\s(?:[A-Z][\w&/-]*(?:\s(?:and\s)?|$)){1,4}\s*$|(?:[A-Z][\w&-]*\s){1,4}(?:Ltd|Inc|LLC|GmbH|AG|plc|Corp|Co)\.?\s*$")
NAME_LINE = re.compile(r"(?P<mark>[-/~*–—]*)\s*(?P<name>[^\W\d_][\w.'’-]*(?:,?\s[^\W\d_][\w.'’-]*){0,3})\s*$")
WORD = re.compile(r"[^\W\d_]{2,}")
SEPARATOR = re.compile(r"\s*(?:-- ?|_{3}|\* \* \*)\s*$")

BLANK, TEXT, QUOTE, INTRO, BLOCK, HEADER, CLOSING, NAME, WEAK, LINK, NOTE, PS, LEGALS, WARN, DASHES = range(15)
NEW, HISTORY, SIGNATURE, NOTICE, GATEWAY = range(5)
# Log scores of a line of each class within each segment kind: new, history, signature, notice, gateway.
EMIT = [
    (0, 0, 0, 0, 0),  # BLANK
    (0, -1.5, -5, -2.5, -9),  # TEXT
    (-9, 0, -9, -9, -9),  # QUOTE
    (-5, 0, -9, -9, -9),  # INTRO
    (-7, 0, -9, -9, -9),  # BLOCK
    (-2.5, 0, -7, -9, -9),  # HEADER
    (-4, -0.5, 0, -9, -9),  # CLOSING
    (-3, -0.5, 0, -9, -9),  # NAME
    (-0.6, -0.5, -0.8, -9, -9),  # WEAK
    (-2, -0.5, 0, -5, -9),  # LINK: contact lines and titles
    (-5, -0.5, 0, -9, -9),  # NOTE
    (0.5, -1.5, -9, -9, -9),  # PS
    (-6, -0.5, -3, 0, -9),  # LEGALS
    (-7, -0.5, -9, -5, 0),  # WARN
    (-0.5, 0, 0.5, 0, 0),  # DASHES: a signature separator
]
# Log scores of a segment that begins with a line of each class (where not given, by kind: START_ELSE).
START = {
    (HISTORY, QUOTE): 0, (HISTORY, INTRO): 1, (HISTORY, BLOCK): 1.5, (HISTORY, HEADER): 0.5,
    (SIGNATURE, CLOSING): 0.5, (SIGNATURE, NAME): 0, (SIGNATURE, WEAK): -1.2, (SIGNATURE, LINK): -1.5, (SIGNATURE, NOTE): 0, (SIGNATURE, DASHES): 0.5,
    (NOTICE, LEGALS): 0, (GATEWAY, WARN): 0,
}
START_ELSE = (-0.5, -8, -5, -6, -9)
LONG_SIGNATURE = 10
LOST = -1e9


def _score(segment: tuple) -> float:
    return segment[0]


def classes(lines: list[str], sender: frozenset[str]) -> list[int]:
    """The class of each line."""
    out, depth = [], 0
    for raw in lines:
        line = raw
        if "<" in raw:
            low = raw.lower()
            opened = low.count("<blockquote")
            inside = depth > 0
            depth = max(0, depth + opened - low.count("</blockquote"))
            line = TAG.sub("", raw)
            if inside or opened:
                out.append(QUOTE if ALNUM.search(line) else BLANK)
                continue
        s = line.strip()
        if not ALNUM.search(s):
            out.append(DASHES if s and SEPARATOR.match(s) else BLANK)
            continue
        if s[0] in ">|&" and MARK.match(s) and not s.startswith(">>> ") or s[:4].find(">") > 0 and MARK.match(s):
            out.append(QUOTE)
            continue
        if len(s) <= 220 and (m := CLASSES.match(s)):
            kind = m.lastgroup if m.lastgroup != "who" else "closing"
            if kind == "closing" and m["who"] and not _name_like(m["who"], sender):
                kind = None
            if kind:
                out.append({"warning": WARN, "block": BLOCK, "intro": INTRO, "header": HEADER, "closing": CLOSING, "note": NOTE, "ps": PS, "legal": LEGALS}[kind])
                continue
        if LEGAL.search(s):
            out.append(LEGALS)
        elif len(s) > 90:
            out.append(TEXT)
        elif (m := NAME_LINE.match(s)) and len(s) <= 40 and (known := _name_class(m, sender)):
            out.append(known)
        elif CONTACT.match(s) or TITLE.match(s):
            out.append(LINK)
        else:
            out.append(TEXT)
    if WEAK in out and (not sender or LINK in out):
        # A bare name after the text is the signature of a role mailbox, or stands above contact lines.
        text = out.index(TEXT) if TEXT in out else len(out)
        for i, k in enumerate(out):
            if k == WEAK and i > text and (not sender or LINK in out[i + 1 : i + 3]):
                out[i] = NAME
    return out


def _name_like(text: str, sender: frozenset[str]) -> bool:
    found = WORD.findall(text)
    return bool(found) and len(found) <= 3 and (all(w.lower() in sender for w in found) or all(w[0].isupper() for w in found))


def _name_class(m: re.Match, sender: frozenset[str]) -> int | None:
    found = WORD.findall(m["name"])
    if found and sender and all(w.lower() in sender for w in found):
        return NAME
    if not found or len(found) > 2 or m["name"].endswith("."):
        return None
    if m["mark"] and (all(w[0].isupper() for w in found) or len(found) == 1 and not sender):
        return NAME if not sender or m["mark"] in "~/" else WEAK
    return WEAK if all(w[0].isupper() and w[1:].islower() for w in found) else None


def decode(kinds: list[int]) -> list[int]:
    """The segment kind of each line: the best path over segments of atoms."""
    # Atoms: runs of lines of one class; a blank run joins what stands before it.
    atoms: list[list[int]] = []  # class, first line, end line
    for i, k in enumerate(kinds):
        if atoms and (k == BLANK or k == atoms[-1][0]):
            atoms[-1][2] = i + 1
        else:
            atoms.append([k, i, i + 1])
    n = len(atoms)
    # An introduction that no marked line follows opens a block without marks, as two header lines do.
    for a in range(n):
        following = atoms[a + 1][0] if a + 1 < n else BLANK
        if atoms[a][0] == INTRO and following not in (QUOTE, INTRO):
            atoms[a][0] = BLOCK
        elif atoms[a][0] == HEADER and sum(k == HEADER for k in kinds[atoms[a][1] : atoms[a][2]]) >= 2:
            atoms[a][0] = BLOCK
    lengths = [sum(k != BLANK for k in kinds[s:e]) or 1 for _, s, e in atoms]
    best = [[LOST] * 5 for _ in range(n + 1)]
    back: list[list[tuple[int, int]]] = [[(0, 0)] * 5 for _ in range(n + 1)]
    best[0] = [0.0, LOST, LOST, LOST, LOST]
    # Open segments by kind: (score, start, origin). All scores but a signature's length are sums over lines, so of
    # segments of one kind (and, of history, with or without an unmarked block) only the best open one can win;
    # signatures are kept by start up to LONG_SIGNATURE lines, beyond which each further line costs the same.
    nothing = (LOST, 0, 0)
    new = notice = gateway = plain = blocked = long = nothing
    short: list[tuple[float, int, int, int]] = []  # with its lines
    for end in range(n):
        c, lines = atoms[end][0], lengths[end]
        weight = min(lines, 6)
        arrivals = []
        for kind in range(5):
            # A segment never follows one of its own kind, except at the start.
            arrive, origin = LOST, 0
            for k in range(5):
                if k != kind or not end:
                    step = best[end][k] - (2.0 if k == SIGNATURE and kind == NEW and c not in (PS, BLANK) else 0)
                    if step > arrive:
                        arrive, origin = step, k
            arrivals.append((arrive + START.get((kind, c), START_ELSE[kind] if end or kind != NEW else 0.0), end, origin) if arrive > LOST / 2 else nothing)

        def grown(open_: tuple, kind: int, arrivals: list = arrivals, c: int = c, weight: int = weight) -> tuple:
            """The better of the open segment and one that starts here, with this atom."""
            at = max(open_, arrivals[kind], key=_score)
            emit = EMIT[c][kind]
            return (at[0] + emit * weight, at[1], at[2])

        emits = EMIT[c]
        new, notice, gateway = grown(new, NEW), grown(notice, NOTICE), grown(gateway, GATEWAY)
        # Within a block without marks ordinary text costs nothing, but it must run to the end.
        starts = arrivals[HISTORY]
        if c == BLOCK:
            blocked, plain = max(blocked, plain, starts, key=_score), nothing
        else:
            plain = grown(plain, HISTORY)
        short = [(s + emits[SIGNATURE] * weight, at, origin, held + lines) for s, at, origin, held in [*short, (*arrivals[SIGNATURE], 0)] if s > LOST / 2]
        long = (long[0] + emits[SIGNATURE] * weight - lines, *long[1:]) if long is not nothing else long
        over = [(s - (held - LONG_SIGNATURE), at, origin) for s, at, origin, held in short if held > LONG_SIGNATURE]
        long = max([long, *over], key=_score)
        short = [x for x in short if x[3] <= LONG_SIGNATURE]
        signature = max([long, *[x[:3] for x in short]], key=_score)
        history = max(plain, (blocked[0] - (5 if end < n - 1 else 0), *blocked[1:]), key=_score)
        closed = (new, history, signature, notice, gateway)
        for kind, (s, at, origin) in enumerate(closed):
            if s > LOST / 2:
                best[end + 1][kind], back[end + 1][kind] = s, (at, origin)
        # What a kind can't hold ends its open segments.
        if emits[NEW] <= -9:
            new = nothing
        if emits[NOTICE] <= -9:
            notice = nothing
        if emits[GATEWAY] <= -9:
            gateway = nothing
        if emits[SIGNATURE] <= -9:
            short, long = [], nothing
        if emits[HISTORY] <= -9:
            plain = nothing
    out = [NEW] * len(kinds)
    at, kind = n, max(range(5), key=lambda k: best[n][k])
    while at > 0:
        start, origin = back[at][kind]
        for i in range(atoms[start][1], atoms[at - 1][2]):
            out[i] = kind
        at, kind = start, origin
    return out


GREETING = re.compile(r"(?:(?:hi|hello|hey|dear|good (?:morning|afternoon|evening))\b.{0,50}|[^\W\d_][\w.'’-]*(?: [^\W\d_][\w.'’-]*)?)\s*[,:!–-]+\s*$", re.I)


def below(kinds: list[int], lines: list[str], out: list[int]) -> None:
    """An answer below an unmarked block that opens the body: the paragraph above the sender's own signature is new.

    The block must come first (after warnings), and the sender's name must stand under it. The paragraph begins
    after the last blank or quoted line; a greeting above it belongs to it. Postscripts after the signature are new.
    Without an own signature the last paragraph is new if something of the block stands above it.
    """
    first = next((i for i, k in enumerate(kinds) if k not in (BLANK, DASHES, WARN, LEGALS)), None)
    if first is None or kinds[first] not in (BLOCK, INTRO, HEADER) or out[first] != HISTORY:
        return
    named = [i for i, k in enumerate(kinds) if i > first and out[i] == HISTORY and (k == NAME)]
    if not named:
        # Without an own signature, the last paragraph is new if it follows a marked quote, the quoted
        # writer's signature, or another paragraph of the block.
        end = len(kinds)
        while end > first and kinds[end - 1] in (BLANK, DASHES, LEGALS):
            end -= 1
        top = end
        while top > first and kinds[top - 1] in (TEXT, PS):
            top -= 1
        gap = top
        while gap > first and kinds[gap - 1] == BLANK:
            gap -= 1
        before = kinds[gap - 1] if gap else BLANK
        if top < end and (before == QUOTE or gap < top and (before in (CLOSING, NAME, WEAK, LINK, NOTE) and gap > first + 1 or before == TEXT)):
            for i in range(top, len(kinds)):
                out[i] = NOTICE if kinds[i] == LEGALS else NEW
        return
    signed = start = named[-1]
    while start > first and kinds[start - 1] in (BLANK, CLOSING, DASHES):
        start -= 1
    top = start
    while top > first and kinds[top - 1] in (TEXT, PS, LINK, WEAK):
        top -= 1
    if top == start:
        return
    above = top
    while above > first and kinds[above - 1] == BLANK:
        above -= 1
    if above > first + 1 and GREETING.match(TAG.sub("", lines[above - 1]).strip()) and kinds[above - 1] in (TEXT, WEAK):
        top = above - 1
    for i in range(top, start):
        out[i] = NEW
    after = SIGNATURE
    for i in range(start, len(kinds)):
        after = NEW if kinds[i] == PS and i > signed else after if kinds[i] != BLANK else SIGNATURE
        out[i] = after if kinds[i] in (PS, TEXT) and i > signed else NOTICE if kinds[i] == LEGALS else SIGNATURE


def sender_words(x_from: str | None, sender: str | None) -> frozenset[str]:
    """Lower-cased parts of the sender's name."""
    local = (sender or "").split("@")[0]
    return frozenset(w.lower() for w in WORD.findall(f"{x_from or ''} {local.replace('_', ' ')}".split("@")[0]) if w.lower() not in ("notices", "operations", "noreply", "info", "desk"))


def segmented(body: str | None, x_from: str | None = None, sender: str | None = None) -> tuple[list[str], list[int]]:
    """Lines of a body and the segment kind of each; a null body has none."""
    if not body:
        return [], []
    lines = LINE_END.split(body)
    kinds = classes(lines, sender_words(x_from, sender))
    if all(k in (BLANK, TEXT) for k in kinds):
        return lines, [NEW] * len(lines)
    out = decode(kinds)
    if BLOCK in kinds or HEADER in kinds or INTRO in kinds:
        below(kinds, lines, out)
    return lines, out


def old_lines(emails: DataFrame) -> DataFrame:
    """(id, line_no): the lines not newly written, numbered from 1; lines without a letter or digit outside tags never count. Null and empty bodies have none."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids: list[int] = []
            numbers: list[int] = []
            for i, body, x_from, sender in zip(*(b.column(c).to_pylist() for c in ("id", "body", "x_from", "sender"))):
                lines, kinds = segmented(body, x_from, sender)
                for n, (line, kind) in enumerate(zip(lines, kinds), 1):
                    if kind != NEW and ALNUM.search(TAG.sub("", line) if "<" in line else line):
                        ids.append(i), numbers.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(numbers, pa.int64())], names=["id", "line_no"])

    return spread(emails.select("id", "body", "x_from", "sender")).mapInArrow(scan, "id long, line_no long")


def new_texts(emails: DataFrame) -> DataFrame:
    """(id, new_text): the lines newly written, joined by line feeds and stripped; null of a null body."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for body, x_from, sender in zip(*(b.column(c).to_pylist() for c in ("body", "x_from", "sender"))):
                lines, kinds = segmented(body, x_from, sender)
                out.append(None if body is None else "\n".join(l for l, k in zip(lines, kinds) if k == NEW).strip())
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, pa.string())], names=["id", "new_text"])

    return spread(emails.select("id", "body", "x_from", "sender")).mapInArrow(scan, "id long, new_text string")
