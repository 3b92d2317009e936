"""Lines of saved pages: masks, hashes, and what a line looks like taken alone."""

from __future__ import annotations

import functools
import html
import re
from urllib.parse import urlsplit

import numpy as np
import pandas as pd

RESIDUE, ITEM, PARAGRAPH, CODE, OTHER, DOUBTFUL, BYLINE = range(1, 8)
#: Added to the class of a line's first part where the line names the page's own topic (last part of its address), and where the part is a label before a colon.
OWN_TOPIC, LABEL = 16, 32
#: Marks of a part of a line: furniture, heading over other articles, message.
MARK_FURNITURE, MARK_HEAD, MARK_MESSAGE = 1, 2, 4

#: An unfilled field of the usual template languages and mail merges.
FIELD = re.compile(
    r"\{\{[^{}]{1,60}\}\}|\{%[^{}]{1,80}%\}|<%=?[^<>]{1,60}%>|\$\{[\w. ]{1,40}\}|\$\[[\w. ]{1,40}\]|\[\[[A-Z_ ]{2,40}\]\]|###?[A-Z_]{2,40}###?|%[A-Z_]{2,40}%|%%[A-Za-z_]{2,40}%%|__[A-Z]+(?:_[A-Z]+)*__"
    r"|\[(?:[Ii]nsert|[Yy]our|[Aa]dd|[Ee]nter)\b[^\[\]]{0,50}\]|&lt;[a-z_]{2,30}&gt;|\*\|[A-Z_:]{2,40}\|\*|<<[A-Za-z_ ]{2,40}>>|@@[A-Za-z_]{2,40}@@|\b[A-Z]+(?:_[A-Z]+)*_HERE\b|\{\d{1,2}\}"
)
_CODE = re.compile(r"[;{}]\s*$|^\s*(?:let|const|var|def|return|import|from|for|while|if|else|fn|func|print)\b.*[(){}=:]|^\s*[#$>]\s?\w+ .*(?:--?\w)|^\s*</?\w+[^>]*>\s*$")
_MARKS = re.compile(r"[;{}()=<>#$%\[\]_*&@]")
_NUMBERED = re.compile(r"\d+[.)] ")
_TAG = re.compile(r"</?[A-Za-z][^<>]*>|<!--.*?-->")
_ENDS = re.compile(r"[.!?…。](?:[\"'”»)\]]*)(?:\s|$)")
_DIGIT = re.compile(r"\d")
_NUMBER = re.compile(r"(?<![^\W\d_])\d+(?:[.,:]\d+)*")
_ADDRESS = re.compile(r"https?://\S+|www\.\S+|\S+@\S+\.\w+|(?<=\s)/[\w/.-]+|\b[0-9a-f]{8,}\b")
_HEX = re.compile(r"\b[0-9a-f]{8,}\b")
_DATE = re.compile(r"\b\d{4}-\d\d?-\d\d?\b|\b\d\d?[./]\d\d?[./]\d{2,4}\b")
_WIDE, _WORDS, _LEFT = re.compile(r"[ \t]{2,}"), re.compile(r"\w+"), re.compile(r"<[a-z_]{2,30}>")
# Words that only stand in for text.
FILLER = frozenset("xxx test tests blah tbd asdf qwerty foo bar baz lorem ipsum dolor todo placeholder filler dummy".split())
# Words of messages shown in place of content.
_WEAK = re.compile(r"\b(?:errors?|fehler|erreur|not found|forbidden|denied|unavailable|expired|suspended|timeout|too many requests|scripts?|javascript|loading|reload|try again|no longer)\b", re.I)
_BYLINE = re.compile(r"(?:By|Von|Por|Par|Door) (?:[A-Z][\w.'’-]+ ?){1,4}|[A-ZÀ-Þ][a-zß-ÿ]+ [A-ZÀ-Þ][a-zß-ÿ]+")
_EDGES = str.maketrans(dict.fromkeys(".,;:!?\"'()[]…", " "))
#: Between the parts of a row of labels.
_BETWEEN = re.compile(r"\s+[·|/›»>•–—]\s+|\s{2,}|(?<=:)\s+")
_SENTENCE = re.compile(r"(?<=[.!?…])\s+")
_GLUED = re.compile(r"(?<=[a-zß-öø-ÿ])(?=[A-ZÀ-ÖØ-Þ])")
_CAPITAL = re.compile(r"(?<=\s)(?=[A-ZÀ-ÖØ-Þ])")
_LIST_MARK = re.compile(r"[-*•‣◦▪+]\s+")
#: Words in a row of labels at most, and capitals from which on labels may be set apart by blanks alone.
ROW_WORDS, ROW_CAPITALS = 24, 4
#: Words up to which a paragraph is taken apart by sentences: notices are put together from them.
NOTE_WORDS = 40
#: Share of the parts of a row that makes it furniture.
MOST_PARTS = 0.6


@functools.lru_cache(4096)
def site_pattern(host: str) -> re.Pattern | None:
    """Matches the site's name as its host spells it, with or without blanks."""
    labels = [x for x in host.lower().split(".") if x != "www"]
    stem = re.sub(r"[^\w]", "", labels[0]) if labels else ""
    if len(stem) < 3:
        return None
    return re.compile(r"\b" + r"[\s-]?".join(map(re.escape, stem)) + r"\b", re.I)


def address_parts(url: str | None) -> tuple[str, str, str]:
    """(host, first part of the path, last part of the path), lower-cased; empty where there is none."""
    try:
        got = urlsplit(url or "")
    except ValueError:
        return "", "", ""
    parts = [p for p in got.path.lower().split("/") if p]
    return (got.hostname or "").removeprefix("www."), parts[0] if len(parts) > 1 else "", parts[-1] if parts else ""


def plain_line(line: str) -> str:
    """The line's text: without tags, entities resolved, blanks collapsed (but two or more stay two, as they set labels apart)."""
    text = " ".join(_TAG.sub(" ", line).split()) if "<" in line else line
    if "&" in text:
        text = html.unescape(text)
    return "  ".join(" ".join(x.split()) for x in _WIDE.split(text.strip())) if "  " in text or "\t" in text else " ".join(text.split())


def masked(text: str, site: re.Pattern | None) -> str:
    """Unfilled fields, dates, addresses, numbers and the site's own name replaced by marks."""
    if site is not None:
        text = site.sub("SITE", text)
    if _MARKS.search(text):
        text = _LEFT.sub("FIELD", FIELD.sub("FIELD", text))
    if _DIGIT.search(text):
        text = _DATE.sub("0", text)
        # without these signs only the last kind of address, long hexadecimal words, can occur
        address = _ADDRESS if "/" in text or "@" in text or "www." in text else _HEX
        text = _NUMBER.sub("0", address.sub("ADDRESS", text))
    elif "/" in text or "@" in text or "www." in text:
        text = _ADDRESS.sub("ADDRESS", text)
    return text


def line_parts(mask: str, words: int) -> list[str]:
    """The labels of a row, however they are set apart, the sentences of a short paragraph, or the whole line; case folded, without list mark."""
    body = _LIST_MARK.sub("", mask, 1) if mask[0] in "-*•‣◦▪+" else mask
    if words > NOTE_WORDS:
        return [body.casefold()]
    if body[-1:] in ".!?…":
        return [x for x in _SENTENCE.split(body.casefold()) if x]
    if words > ROW_WORDS:
        return [body.casefold()]
    parts = _BETWEEN.split(body)
    if len(parts) == 1:
        if len(glued := _GLUED.split(body)) > 2:
            parts = glued
        elif words >= ROW_CAPITALS and len(apart := _CAPITAL.split(body)) >= max(ROW_CAPITALS, 0.6 * words):
            parts = apart
    return [x for p in parts if (x := p.strip().casefold())]


def looks_filler(folded: str) -> bool:
    """Whether a case-folded text is filler: the usual dummy Latin or dummy words, or the same few words over and over."""
    words = folded.translate(_EDGES).split()
    if words[:2] == ["lorem", "ipsum"]:
        return True
    if len(words) >= 3 and not FILLER.isdisjoint(words) and sum(w in FILLER for w in words) >= 0.7 * len(words):
        return True
    few = len(set(words))
    return len(words) >= 12 and few <= len(words) / 4 or len(words) >= 6 and few <= 3


def mostly_fields(raw: str) -> bool:
    """Whether at least half the words of a line stand in sentences that hold unfilled fields and little else."""
    total = unfilled = 0
    for x in _ENDS.split(raw):
        hits = len(FIELD.findall(x))
        words = len(_WORDS.findall(_TAG.sub(" ", FIELD.sub(" ", x))))
        total += words + hits
        unfilled += (words + hits) * (hits > 0 and words <= 3 + 3 * hits)
    return total > 0 and 2 * unfilled >= total


def classify(raw: str, text: str, folded: str, words: int) -> int:
    """Class of one line by its shape alone."""
    if not text:
        return RESIDUE if FIELD.search(raw) else OTHER
    if _MARKS.search(raw):
        field = FIELD.search(raw) is not None
        code = _CODE.search(plain_line(FIELD.sub(" ", raw)) if field else text) is not None
        if field and not code and mostly_fields(raw):
            return RESIDUE
        if code:
            return CODE
    if looks_filler(folded):
        return RESIDUE
    if text[0] in "-*•‣◦▪+" and _LIST_MARK.match(text) or _NUMBERED.match(text):
        return ITEM
    if words <= 6 and _BYLINE.fullmatch(text):
        return BYLINE
    if words > 30 or len(_ENDS.findall(text)) >= 2:
        return PARAGRAPH
    return DOUBTFUL if words <= 20 and _WEAK.search(text) is not None else OTHER


#: Lines that don't name their site, with what was found for them; bounded, per worker.
_SEEN: dict[str, tuple[str, list[str], int, int]] = {}


def describe_pages(urls: list[str | None], bodies: list[str]) -> list[tuple[str, str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per page: host, section, and for each part of a line that isn't blank: its hash, its line's number, class and number of words."""
    texts: list[str] = []
    pages = []
    for url, body in zip(urls, bodies, strict=True):
        host, section, topic = address_parts(url)
        stem = host.split(".")[0][:3]
        at, classes, sizes = [], [], []
        for number, raw in enumerate(body.split("\n"), 1):
            if not raw or raw.isspace():
                continue
            short = len(raw) < 240
            got = _SEEN.get(raw) if short else None
            if got is None or (stem and stem in got[0]):
                text = plain_line(raw)
                words = len(text.split())
                folded = text.casefold()
                named = stem != "" and stem in folded
                parts = line_parts(masked(text, site_pattern(host) if named else None), words) if text else [""]
                kind = classify(raw, text, folded, words)
                if short and not named:
                    if len(_SEEN) > 100_000:
                        _SEEN.clear()
                    _SEEN[raw] = folded, parts, kind, words
            else:
                folded, parts, kind, words = got
            texts.extend(parts)
            n = len(parts)
            at.extend([number] * n)
            sizes.extend([words] * n)
            classes.extend([kind] * n)
            label = n > 1 and parts[0][-1] == ":"
            # the path to a page in a row of labels names its topic too
            if len(topic) >= 4 and (n == 1 or label) and kind in (OTHER, DOUBTFUL, PARAGRAPH, ITEM) and topic in folded:
                classes[-n] += OWN_TOPIC
            if label:
                classes[-n] += LABEL
        pages.append((host, section, at, classes, sizes))
    codes, names = pd.factorize(np.array(texts, dtype=object))
    hashes = pd.util.hash_array(np.asarray(names, dtype=object), categorize=False).view(np.int64)[codes] if len(codes) else np.zeros(0, np.int64)
    out, start = [], 0
    for host, section, at, classes, sizes in pages:
        n = len(classes)
        out.append((host, section, hashes[start : start + n], np.array(at, np.int32), np.array(classes, np.int8), np.minimum(np.array(sizes), 32000).astype(np.int16)))
        start += n
    return out


def judge_pages(ends: np.ndarray, at: np.ndarray, kinds: np.ndarray, sizes: np.ndarray, marks: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """(numbers of the lines outside the main body, whether residue stands in place of content) of each page.

    Pages are ranges of parts between ``ends``; marks say what the corpus shows
    of each part. A row of labels is furniture if most of its parts are, or the
    label before its colon is.
    """
    n_pages = len(ends) - 1
    if len(at) == 0:
        return [at] * n_pages, np.zeros(n_pages, bool)
    page = np.repeat(np.arange(n_pages), np.diff(ends))
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (page[1:] != page[:-1])
    starts = np.flatnonzero(new)
    parts = np.diff(np.append(starts, len(at)))
    share = lambda bit: np.add.reduceat((marks & bit > 0).astype(np.int64), starts) / parts
    at, kind, sizes, page = at[starts], kinds[starts], sizes[starts], page[starts]
    own = kind & OWN_TOPIC > 0
    labelled = (kind & LABEL > 0) & ~own & (marks[starts] & MARK_FURNITURE > 0)
    kind = kind & 15
    said = (share(MARK_MESSAGE) > 0) & (share(MARK_MESSAGE | MARK_FURNITURE) == 1) & ~own & (kind != CODE)
    residue = (kind == RESIDUE) | said
    head = (share(MARK_HEAD) == 1) & ~own & ~residue
    out = ~residue & (head | ((share(MARK_FURNITURE | MARK_HEAD) >= MOST_PARTS) & (kind != CODE) & ((parts > 1) | ~own)) | labelled)
    sure = ~out & ~residue & (np.isin(kind, (CODE, PARAGRAPH)) | own)
    lines = np.searchsorted(page, np.arange(n_pages + 1))
    for p in np.unique(page[head]):
        lo, hi = lines[p], lines[p + 1]
        later = np.logical_or.accumulate(sure[lo:hi][::-1])[::-1]
        for i in np.flatnonzero(head[lo:hi]) + lo:
            j = i + 1
            while j < hi and not sure[j] and at[j] == at[j - 1] + 1 and not out[j]:
                j += 1
            more = j < hi and later[j - lo]
            # amid an article one teaser stands under its heading, after it a whole list
            last = min(j, i + 2) if more else j
            if more and j == i + 1 and at[j] == at[i] + 1 and not own[j] and kind[j] == PARAGRAPH and sizes[j] <= 34:
                last = i + 2
            out[i + 1 : last] |= ~residue[i + 1 : last]
    text = ~out & ~residue
    blocked = np.zeros(n_pages, bool)
    for p in np.unique(page[residue]):
        lo, hi = lines[p], lines[p + 1]
        left = text[lo:hi]
        blocked[p] = not (left & (sure[lo:hi] | (sizes[lo:hi] > 6))).any() and sizes[lo:hi][left].sum() <= 8
    out |= blocked[page]
    return [at[lo:hi][out[lo:hi]] for lo, hi in zip(lines[:-1], lines[1:], strict=True)], blocked
