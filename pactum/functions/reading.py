"""Fields and clauses of one text in plain Python: what the Arrow functions of ``fields`` and ``clauses`` run for each row.

The patterns are those of ``patterns``, compiled for Python's engine. All work is linear in the
number of matches; a list that has a limit stops at it.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from datetime import datetime
from functools import lru_cache

from pactum.functions import patterns as P
from pactum.functions import vocab as V


def compiled(pattern: str) -> re.Pattern[str]:
    """A pattern of ``patterns`` for Python: flags by its prefix, groups that ignore case in Python's form."""
    flags = {P.I: re.IGNORECASE, P.M: re.MULTILINE, P.PLAIN: re.NOFLAG}
    prefix = next((p for p in sorted(flags, key=len, reverse=True) if pattern.startswith(p)), "")
    return re.compile(pattern.removeprefix(prefix).replace("(?iu:", "(?i:"), flags.get(prefix, re.NOFLAG))


_LABELED, _EFFECTIVE, _EXPIRATION = compiled(P.EFFECTIVE_LABELED), compiled(P.EFFECTIVE), compiled(P.EXPIRATION)
_TERM, _NOTICE, _RENEWS, _RENEWS_NOT = compiled(P.TERM_LENGTH), compiled(P.NOTICE), compiled(P.RENEWS), compiled(P.RENEWS_NOT)
_LAW, _PLACE_PREFIX, _MONEY = compiled(P.LAW), compiled(P.PLACE_PREFIX), compiled(P.MONEY)
_LABEL_OF_DATE = re.compile(r"effective\s+date", re.IGNORECASE)
_CURRENCIES = ("$", "usd", "eur", "gbp")
_QUOTED, _PAREN = compiled(P.TERM_QUOTED), compiled(P.TERM_PAREN)
_PARTIES, _ROLE = compiled(P.PARTY_BLOCK), re.compile(P.ROLE)
_CUTS = [re.compile(cut, re.IGNORECASE) for cut in P.PARTY_CUTS]
_ANY_CUT = re.compile("|".join(P.PARTY_CUTS), re.IGNORECASE)
_SIGNATORY, _SIGNATORY_TITLE, _LABEL = compiled(P.SIGNATORY), compiled(P.SIGNATORY_TITLE), compiled(P.SIGNATURE_LABEL)
_H1, _NUMBER_PREFIX = compiled(P.H1), compiled(P.NUMBER_PREFIX)
_NOISE = [compiled(p) for p in (P.NOISE_DIGITS, P.NOISE_PREFIX, P.NOISE_PLACEHOLDER)]
_H2, _BOLD, _NUMBERED, _ARTICLE, _CAPS = (compiled(p) for p in (P.H2, P.BOLD, P.NUMBERED, P.ARTICLE, P.CAPS))
_LINE = re.compile(r"\r\n|[\n\r\x0b\f\x1c-\x1e\x85  ]")
_ORDINAL, _DAY_OF = re.compile(r"(\d+)(?:st|nd|rd|th)", re.IGNORECASE), re.compile(r"\bday\s+of\s+", re.IGNORECASE)
#: The date formats of ``patterns`` in Python's letters, longest letters first.
_LETTERS = {"yyyy": "%Y", "MMMM": "%B", "MMM": "%b", "MM": "%m", "dd": "%d", "yy": "%y", "M": "%m", "d": "%d"}
_FORMATS = [re.sub("|".join(_LETTERS), lambda m: _LETTERS[m[0]], f) for f in P.DATE_FORMATS]


def squeeze(text: str) -> str:
    return " ".join(text.split())


def _scalar(value: object, confidence: float) -> dict:
    found = value is not None
    return {"value": value, "confidence": confidence if found else 0.0, "source": "deterministic" if found else "none"}


def _may_hold(text: str, *words: str) -> bool:
    """False if a pattern that can't match without one of these words in any case needn't be tried.

    Texts beyond ASCII are always tried: other letters can count as the same in another case.
    """
    return not text.isascii() or any(w in low for low in (text.lower(),) for w in words)


def _first(pattern: re.Pattern[str], text: str, group: int = 1) -> str | None:
    m = pattern.search(text)
    return (m[group] or None) if m else None


def _distinct(values: Iterable[str], most: int) -> list[str]:
    out: dict[str, None] = {}
    for v in values:
        out.setdefault(v)
        if len(out) == most:
            break
    return list(out)


# --- scalars ---------------------------------------------------------------------------------


def number(token: str | None) -> int | None:
    """Digits or a number word as int; anything else None."""
    t = (token or "").strip().lower()
    if t.isdecimal():
        return n if (n := int(t)) < 1 << 31 else None
    return V.NUMBER_WORDS.get(t)


@lru_cache(maxsize=100_000)
def iso_date(raw: str) -> str | None:
    """yyyy-mm-dd of a date as matched, or None if no format fits."""
    clean = squeeze(_DAY_OF.sub("", _ORDINAL.sub(r"\1", raw.strip().rstrip("."))).replace(",", " "))
    for fmt in _FORMATS:
        try:
            return datetime.strptime(clean, fmt).date().isoformat()
        except ValueError:
            continue
    return None


def _date(raw: str | None, parsed: float, unparsed: float) -> dict:
    if raw is None:
        return _scalar(None, 0.0)
    raw = squeeze(raw)
    day = iso_date(raw)
    return _scalar(day or raw, parsed if day else unparsed)


def effective_date(flat: str) -> dict:
    if _LABEL_OF_DATE.search(flat) and (raw := _first(_LABELED, flat)) is not None:
        return _date(raw, V.DATE_LABELED, V.DATE_LABELED_RAW)
    return _date(_first(_EFFECTIVE, flat), V.DATE_KEYWORD, V.DATE_KEYWORD_RAW)


def expiration_date(flat: str) -> dict:
    return _date(_first(_EXPIRATION, flat), V.DATE_KEYWORD, V.DATE_KEYWORD_RAW)


def term_length(flat: str) -> dict:
    m = _TERM.search(flat)
    n = number(m[1]) if m else None
    return _scalar(None if n is None else f"{n} {m[2].lower().rstrip('s')}{'' if n == 1 else 's'}", V.TERM)


def notice_days(flat: str) -> dict:
    return _scalar(number(_first(_NOTICE, flat)) if _may_hold(flat, "notice") else None, V.TERM)


def auto_renew(flat: str) -> dict:
    if not _may_hold(flat, "renew", "successive"):
        return _scalar(None, V.TERM)
    return _scalar(False if _RENEWS_NOT.search(flat) else True if _RENEWS.search(flat) else None, V.TERM)


def governing_law(flat: str) -> dict:
    return _scalar(squeeze((_first(_LAW, flat) or "").strip().rstrip(".,")) or None if _may_hold(flat, "law") else None, V.LAW)


_CODES = {name: code for _, name, code in V.places()}
_CONTAINED = [(name, code) for _, name, code in V.places() if len(name) >= V.MIN_CONTAINED]


@lru_cache(maxsize=100_000)
def place_code(law: str) -> str | None:
    """Code of a place: its exact name, else the first name of the table, of 5 letters or more, that it contains."""
    key = squeeze(_PLACE_PREFIX.sub("", law.strip()).lower())
    if not law.strip():
        return None
    return _CODES.get(key) or next((code for name, code in _CONTAINED if name in key), None)


def jurisdiction(law: str) -> dict:
    return _scalar(place_code(law), V.JURISDICTION)


def headline_value(flat: str) -> dict:
    m = _MONEY.search(flat) if _may_hold(flat, *_CURRENCIES) else None
    return _scalar(squeeze(m[0]) if m else None, V.WEAK)


# --- lists -----------------------------------------------------------------------------------


def amounts(flat: str) -> list[dict]:
    found = _MONEY.finditer(flat) if _may_hold(flat, *_CURRENCIES) else ()
    return [_scalar(a, V.WEAK) for a in _distinct((squeeze(m[0]) for m in found), V.MAX_AMOUNTS)]


def defined_terms(flat: str) -> list[dict]:
    """Quoted terms, then those in parentheses; at the limit one more of the latter can follow."""
    kept = lambda p: (t for m in p.finditer(flat) if len(t := squeeze(m[1])) >= 2 and t.count(" ") < 6)
    quoted = _distinct(kept(_QUOTED), V.MAX_TERMS)
    if len(quoted) < V.MAX_TERMS:
        found = _distinct([*quoted, *kept(_PAREN)], V.MAX_TERMS)
    else:
        found = _distinct([*quoted, *[t for t, _ in zip(kept(_PAREN), range(1))]], V.MAX_TERMS + 1)
    return [{"term": t, "confidence": V.WEAK, "source": "deterministic"} for t in found]


def _without_commas(text: str) -> str:
    return text.strip().strip(",").strip()


def party_name(raw: str) -> str:
    """The name of an entity, without what describes it."""
    name = _without_commas(squeeze(raw))
    if _ANY_CUT.search(name):
        for cut in _CUTS:
            if m := cut.search(name):
                name = _without_commas(name[: m.start()])
    if "(" in name and ")" not in name:
        name = _without_commas(name.partition("(")[0])
    return name.strip("\"“”").strip()


def _party(raw: str) -> dict:
    raw = _without_commas(squeeze(raw))
    m, role = _ROLE.search(raw), None
    if m and (inside := m[1].strip()):
        role = inside if len(inside) <= 40 and inside.lower() not in ("a", "an", "the") else None
        raw = (raw[: m.start()] + raw[m.end() :]).strip().rstrip(",").strip()
    return {"name": party_name(raw), "role": role, "confidence": V.PARTIES, "source": "deterministic"}


def parties(flat: str) -> list[dict]:
    m = _PARTIES.search(flat)
    both = [_party(p) for p in m.groups()[:2] if p] if m else []
    return [p for p in both if 2 <= len(p["name"]) <= 120]


def _signature(raw: str) -> str | None:
    v = re.sub(r"\s+", " ", raw).strip(" .,:")
    return v if len(v) >= 2 and v.lower() != "the" and any(map(str.isalpha, v)) and not _LABEL.search(v) else None


def signatories(text: str) -> list[dict]:
    """Names of signature blocks, each with the first usable title that starts after it and before the next one's end."""
    names = [(m.end(), _signature(m[1])) for m in _SIGNATORY.finditer(text)]
    if not names:
        return []
    titles = [(m.start(), t) for m in _SIGNATORY_TITLE.finditer(text) if (t := _signature(m[1]))]
    starts = [s for s, _ in titles]
    out: dict[str, str | None] = {}
    for (end, name), (until, _) in zip(names, [*names[1:], (len(text) + 1, None)], strict=True):
        if name and name not in out and len(out) < V.MAX_SIGNATORIES:
            i = bisect_left(starts, end)
            out[name] = titles[i][1] if i < len(titles) and starts[i] < until else None
    return [{"name": n, "title": t, "confidence": V.SIGNATORY, "source": "deterministic"} for n, t in out.items()]


def title_case(text: str) -> str:
    """Each word capitalised; in a text that isn't all upper case, upper-case words of up to 4 characters stay."""
    upper = lambda w: w == w.upper() and any(map(str.isalpha, w))
    whole = upper(text)
    return " ".join(w if not whole and upper(w) and len(w) <= 4 else w[0].upper() + w[1:].lower() for w in text.split())


def title(text: str, path: str | None) -> str:
    """H1, else the first line with text that isn't markup, if short enough, else the file's name."""
    if named := (_first(_H1, text) or "").strip():
        return named
    at = 0
    while at <= len(text):
        m = _LINE.search(text, at)
        line = text[at : m.start() if m else len(text)].strip().lstrip("#").strip()
        if line and not line.startswith("<"):
            if len(line) <= V.MAX_TITLE:
                return line
            break
        if m is None:
            break
        at = m.end()
    stem = (path or "").rpartition("/")[2]
    stem = stem.rpartition(".")[0] or stem
    return title_case(stem.replace("_", " ").replace("-", " "))


# --- clauses ---------------------------------------------------------------------------------


def strip_number(text: str) -> str:
    """A title without its leading number."""
    return _NUMBER_PREFIX.sub("", text, count=1).strip()


def clause_key(text: str) -> str:
    return strip_number(text).lower().rstrip(" .:;,")


def is_heading_like(text: str) -> bool:
    """1 to 9 words, each capitalised, a connector or not a word; a single word has 4 letters or more."""
    parts = text.strip().rstrip(".").split()
    capital = lambda w: unicodedata.category(w[0]) == "Lu"
    if len(parts) == 1:
        return capital(parts[0]) and sum(map(str.isalpha, parts[0])) >= 4
    return 1 < len(parts) <= 9 and all(capital(w) or not w[0].isalpha() or w.lower() in V.HEADING_STOPWORDS for w in parts)


def is_caps_heading(text: str) -> bool:
    return len(text.split()) >= 2 or sum("A" <= c <= "Z" for c in text) >= 4


def is_noise(text: str) -> bool:
    """Codes, front and back matter, fragments of definitions and placeholders."""
    t = text.strip()
    return not t or t[0] in P.NOISE_OPENERS or any(p.search(t) for p in _NOISE)


def _on_line(text: str, pattern: re.Pattern[str]) -> Iterator[tuple[int, int, str, str]]:
    """(where the match starts, where its title's line starts, raw title, line)."""
    for m in pattern.finditer(text):
        start = max(m.start(), text.rfind("\n", m.start(), m.start(1)) + 1)
        end = text.find("\n", start)
        yield m.start(), start, m[1], text[start : end if end >= 0 else len(text)]


def _caps(text: str) -> Iterator[tuple[int, int, str, str]]:
    for m in _CAPS.finditer(text):
        start = m.start(1)
        yield m.start(), start, m[1], text[start : text.find("\n", start)]


def _spanned(found: list[tuple[int, int, str, str]], text: str) -> list[dict]:
    """Each heading ends where the next match starts."""
    ends = [*[at for at, _, _, _ in found[1:]], len(text)]
    return [{"title": strip_number(raw.strip()), "detected": line.strip(), "start": start, "end": end} for (_, start, raw, line), end in zip(found, ends, strict=True)]


def _articles(text: str) -> list[dict]:
    """Marker lines whose title is the next line with text."""
    found = list(_ARTICLE.finditer(text))
    if len(found) < 2:
        return []
    out = []
    for m, end in zip(found, [n.start() for n in found[1:]] + [len(text)], strict=True):
        line = next((x for x in map(str.strip, _LINE.split(text[m.end() : end])) if x), "")
        name = strip_number(line)
        if name and is_heading_like(name):
            out.append({"title": name, "detected": line, "start": m.start(), "end": end})
    return out


def detected(text: str) -> dict:
    """The first detector with enough headings; later ones aren't tried."""
    if found := list(_on_line(text, _H2)):
        return {"tier": "h2", "headings": _spanned(found, text)}
    if len(found := list(_on_line(text, _BOLD))) >= 2:
        return {"tier": "bold-numbered", "headings": _spanned(found, text)}
    if len(found := [x for x in _on_line(text, _NUMBERED) if is_heading_like(x[2])]) >= 2:
        return {"tier": "numbered", "headings": _spanned(found, text)}
    if len(articles := _articles(text)) >= 2:
        return {"tier": "numbered", "headings": articles}
    if len(found := [x for x in _caps(text) if is_caps_heading(x[2])]) >= 2:
        return {"tier": "all-caps", "headings": _spanned(found, text)}
    return {"tier": None, "headings": []}


_NAMES = {key: name for _, key, name in V.aliases()}
_ALIAS_TEXT, _ANY_ALIAS = "\n".join(_NAMES), re.compile("|".join(re.escape(k) for k in _NAMES if len(k) >= V.MIN_CONTAINED))
#: Longest first, so that the first that fits is the arg-max.
_LONG = [(key, name) for _, key, name in sorted((a for a in V.aliases() if len(a[1]) >= V.MIN_CONTAINED), key=lambda a: (-len(a[1]), a[0]))]


@lru_cache(maxsize=100_000)
def canonical(text: str) -> tuple[str | None, bool]:
    """(name, whether the vocabulary knows it): exact key, else the longest alias that contains or is contained, else the title itself."""
    key = clause_key(text)
    if not key:
        return None, False
    name = _NAMES.get(key)
    if name is None and (key in _ALIAS_TEXT or _ANY_ALIAS.search(key)):
        name = next((n for k, n in _LONG if k in key or key in k), None)
    return (name, True) if name else (title_case(text.strip().rstrip(" .:;,")), False)


def clause_map(found: dict) -> list[dict]:
    """Clauses of what ``detected`` gives: without headings that repeat three times or more, without noise, named and scored."""
    keys = [clause_key(h["title"]) for h in found["headings"]]
    times = Counter(keys)
    out = []
    for h, key in zip(found["headings"], keys, strict=True):
        if times[key] < 3 and not is_noise(h["title"]):
            name, mapped = canonical(h["title"])
            yes, no = V.TIER_CONFIDENCE[found["tier"]]
            out.append({"canonical_title": name, "detected_title": h["detected"], "tier": found["tier"], "span": {"start": h["start"], "end": h["end"]}, "confidence": yes if mapped else no, "source": "deterministic", "mapped": mapped})
    return out
