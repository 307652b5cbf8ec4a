"""Keyword-stuffed and link-list pages.

A page is cut into runs of list lines (links, tags, short groups of words) and into sentences;
markup only tells where items begin.  Two measurements on the terms of each decide.  Regular
repetition: autocorrelation per lag, against what the term frequencies give by chance, and the
gaps at which terms recur with their variance.  Distinct lists: many different nouns and hardly
any function words, against the share of function words in the page's own sentences.  A page is
spam when more than half of its characters lie in stretches that meet one of them.
"""

from __future__ import annotations

import itertools
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from graphloom.session import spread

# Function words of the corpus languages (articles, prepositions, conjunctions, pronouns, auxiliaries).
FUNCTION_WORDS = frozenset(
    """the a an of to in on and or is are was were be been for with from by at as it its this that which when if then than so no not can has have must each every any our your until because unless after before since into out even most will would should could do does did we you they he she i but there here how what who whose why because these those while where their them his her my me us again about against between during both more other only own same too very just
    der die das und ist ein eine einen einem einer den dem des zu mit von für auf nicht wird werden als nach im in bei wenn muss aus sich danach beim ob war sind hat haben kann oder aber auch denn dass wer was wie es er sie wir man nur noch seit über unter ohne um bis durch jede jeder jedes zum zur vom am
    le la les de des du un une et est en dans pour par sur que qui ne pas au aux avec ce cette se si plus il elle ils elles doit être sont ou mais donc car sans sous après avant lorsque depuis l d c s qu n j m à y a
    que el los las una unos unas y en con por para del al se su sus como más pero sin sobre entre cuando""".split()
)

#: Longest gap at which a term counts as coming back: in sentences, and in lists, whose vocabulary turns around more slowly.
LAGS, LIST_LAGS = 7, 28
#: Share of content terms that come back within the lags, from which a sentence or a run is stuffed.
RECURRENT_SHARE = 0.5
#: A term with at least so many gaps whose standard deviation is at most this share of their mean recurs regularly.
REGULAR_GAPS, REGULAR_SPREAD = 2, 0.5
#: Share of terms that recur regularly, and excess of the autocorrelation at its best lag, from which a run is stuffed.
REGULAR_SHARE, LAG_EXCESS = 0.3, 0.25
#: A list holds so many nouns at least, so many of them different from those in the window before.
MIN_NOUNS, DISTINCT_SHARE = 6, 0.55
#: Share of function words in a list against that of the page's sentences; pages without sentences count as having this many.
FUNCTION_RATIO, FUNCTION_SHARE = 1 / 3, 0.3
MIN_ITEMS = 4
MIN_RUN = 3
#: Share of terms in a list line that may be function words or damaged.
ODD_SHARE = 0.1

_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")
# Japanese sentences by their ends and object marks; keyword lists have none.
_CJK_PROSE = re.compile(r"[぀-ヿ㐀-鿿].*(?:。|です|ます|ません|ください|でした|である)")
_URL = r"(?:https?://|www\.)[^\s<>\"'\])|]+"
_MARKUP = re.compile(
    rf"\[url=[^\]]*\]|\[/url\]|<a\s[^>]*>|</a>|!?\[!?\[[^\]]*\]\({_URL}\)\]\({_URL}\)|\[([^\]\n]{{0,60}})\]\(\s*{_URL}\s*\)|{_URL}|\{{[\w -]+\}}\[[\w -]+\]|<[^\W_][\w -]*>|\[[^\W_][\w -]*\]|(?<!\S)#[^\W_][\w-]*"
)
#: What a line needs to be anything but a list of keywords.
_MARKED = re.compile(r"[\[<{#|]|https?:|www\.")
_LINK = re.compile(_URL)
_SEPARATOR = re.compile(r"\s*[,;|·•»/~→+、・，；]+\s*|\s+(?:-+|–|—|>+|\*|=>|::)\s+|\s*[()]\s*|:\s+")
_BULLET = re.compile(r"^\s*(?:[-*•+>·]+|\d+[.)])\s+")
_SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
_NUMBER = re.compile(r"[$€£]?\d+(?:[.,]\d+)*[%€]?")
_PLAIN = re.compile(r"^[^\W_]+(?:['’-][^\W_]+)*$")
# Lines of other honest kinds: logs, table rows, configuration, code, traces, headings.
_STRUCTURE = re.compile(
    r"^\s*(?:\d{4}-\d\d-\d\d[T ]\d|\||[\w.\"'-]+\s*(?:=|:=)\s*\S|\[[\w-]+\.[\w.-]+\]|at \S+ \(|#{1,6}\s|```|//|/\*|\*/|<\?|import\b|from \S+ import\b|(?:def|func|fn|function|class|return|package|use|pub|end)\b|[{}\[\]()];?\s*$)|[{;]\s*$|\w\([^)]*\)\s*(?:->.*|:|\{)?$|\"\s*:\s"
)


# What every address has: scheme, top level and extension.
_ADDRESS = re.compile(r"\[/?url=?|https?://(?:www\.)?|\.[a-z]{2,7}(?=[/?\s)\]\"]|$)|\bhref=|</?a\b")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")


def _items(line: str, terms: list[str], functions: int) -> tuple[int, int, list[str]]:
    """(items, marks, terms) of a list line; no items if it is none.

    A list line is made of links, tags and short groups of plain words, without function words.
    Links are bare or barely labelled; the words of their address are terms too.
    """
    if functions > ODD_SHARE * (len(terms) + line.count(",") + line.count("|")) and "<a " not in line:
        return 0, 0, []
    labels: list[str] = []
    nouns: list[str] = []
    marks = links = 0

    def take(m: re.Match) -> str:
        nonlocal marks, links
        marks += 1
        if _LINK.search(m[0]) or m[0].startswith(("[url", "<a")):
            links += 1
        if m[1]:
            labels.append(m[1])
        nouns.extend(_WORD.findall(_CAMEL.sub(" ", _ADDRESS.sub(" ", m[0])).lower()))
        return " , "

    rest = _MARKUP.sub(take, _BULLET.sub("", line))
    pieces = [p for p in _SEPARATOR.split(rest.rstrip(" .")) if p]
    words = odd = groups = 0
    for piece in [*pieces, *labels]:
        terms = piece.split()
        groups += max(1, len(terms) // 3)
        odd += sum(t.lower() in FUNCTION_WORDS or not _PLAIN.match(t) and not _NUMBER.fullmatch(t) for t in terms)
        words += len(terms)
    if odd > ODD_SHARE * (words + marks) or links and words > 6 * links + 2:
        return 0, 0, []
    for piece in pieces:
        nouns += _WORD.findall(piece.lower())
    return (marks + len(pieces) if links else marks + groups), marks, nouns


def _gaps(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(gap, place): the gaps at which terms recur, with the places of the recurrences, in order of terms."""
    order = np.argsort(codes, kind="stable")
    same = codes[order][1:] == codes[order][:-1]
    return np.diff(order)[same], order[1:][same]


def _recurrent(codes: np.ndarray, lags: int) -> np.ndarray:
    """For each term: does it recur within so many places on either side?"""
    hit = np.zeros(len(codes), bool)
    gaps, places = _gaps(codes)
    near = gaps <= lags
    hit[places[near]] = True
    hit[places[near] - gaps[near]] = True
    return hit


def _numbered(terms: list[str]) -> tuple[np.ndarray, Iterable[str]]:
    """The terms as numbers in order of their first appearance, and the terms in that order."""
    code: defaultdict[str, int] = defaultdict(itertools.count().__next__)
    return np.fromiter(map(code.__getitem__, terms), np.int64, len(terms)), code.keys()


def _coded(terms: list[str]) -> np.ndarray:
    return _numbered(terms)[0]


def autocorrelation(codes: np.ndarray) -> np.ndarray:
    """For each lag the share of places whose term stood there a lag before, less what chance gives."""
    n = len(codes)
    chance = float((np.bincount(codes) / n) @ (np.bincount(codes) / n))
    return np.array([np.mean(codes[lag:] == codes[:-lag]) - chance for lag in range(1, min(LIST_LAGS, n // 2) + 1)] or [0.0])


def regular_share(codes: np.ndarray) -> float:
    """Share of the places whose term recurs at gaps that hardly vary."""
    n = len(codes)
    gaps, places = _gaps(codes)
    if not len(gaps):
        return 0.0
    owner, gaps = codes[places], gaps.astype(float)
    count = np.bincount(owner, minlength=n)
    mean = np.bincount(owner, gaps, n) / np.maximum(count, 1)
    spread_ = np.sqrt(np.maximum(np.bincount(owner, gaps * gaps, n) / np.maximum(count, 1) - mean * mean, 0))
    regular = (count >= REGULAR_GAPS) & (spread_ <= REGULAR_SPREAD * mean)
    return float((count[regular] + 1).sum() / n)


def run_signals(terms: list[str]) -> tuple[float, float, float]:
    """(recurrence, regularity, distinctness) of the terms of a run of list lines.

    recurrence: share that comes back within the lags.  regularity: the greater of the share that
    recurs regularly and the autocorrelation at its best lag, each against its bound.
    distinctness: share of the nouns that do not stand in the window before them, none without
    enough of them; a window, as any vocabulary turns around in a list that is long enough.
    """
    if len(terms) < 2:
        return 0.0, 0.0, 0.0
    codes = _coded(terms)
    nouns = [t for t in terms if not t.isdigit()]
    distinct = 1 - float((_gaps(_coded(nouns))[0] <= LIST_LAGS).sum()) / len(nouns) if len(nouns) >= MIN_NOUNS else 0.0
    regularity = max(regular_share(codes) / REGULAR_SHARE, float(autocorrelation(codes).max()) / LAG_EXCESS)
    return float(_recurrent(codes, LIST_LAGS).mean()), regularity, distinct


def _solid(text: str) -> int:
    """Characters without white space."""
    return len("".join(text.split()))


def profile(text: str, repetition: bool = True, lists: bool = True) -> dict[str, float]:
    """Characters of a page: all, in stretches of regular repetition, in distinct lists only; and its greatest signals.

    Either measurement can be switched off.
    """
    out = {"all": _solid(text), "repeated": 0, "listed": 0, "items": 0, "recurrence": 0.0, "regularity": 0.0, "distinctness": 0.0, "function_share": 0.0}
    prose: list[str] = []
    run: list[tuple[int, int, int]] = []
    run_terms: list[str] = []
    runs: list[tuple[int, int, int, list[str]]] = []
    fenced = False
    words = functions = 0

    def close() -> None:
        """A run of list lines counts when it has enough items; single short lines are headings."""
        nonlocal run_terms
        if not run:
            return
        items = sum(n for n, _, _ in run)
        if items >= MIN_ITEMS and (len(run) >= MIN_RUN or max(n for n, _, _ in run) >= MIN_ITEMS or any(m for _, m, _ in run)):
            runs.append((items, sum(c for _, _, c in run), sum(t in FUNCTION_WORDS for t in run_terms), run_terms))
        run.clear()
        run_terms = []

    for line in text.split("\n"):
        if line.lstrip().startswith("```"):
            fenced = not fenced
            close()
            continue
        if not line.strip():
            continue
        if fenced:
            close()
            continue
        if not line.isascii() and _CJK_PROSE.search(line):
            close()
            continue
        plain = not _MARKED.search(line)
        if plain and _STRUCTURE.search(line):
            close()
            continue
        terms = line.lower().split()
        known = sum(map(FUNCTION_WORDS.__contains__, terms))
        n, marks, nouns = _items(line, terms, known)
        if not plain and not marks and _STRUCTURE.search(line):
            close()
        elif n:
            run.append((n, marks, _solid(line)))
            run_terms += nouns
        else:
            close()
            prose.append(line)
            words += len(terms)
            functions += known
    close()

    own = functions / words if words and functions > 0.05 * words else FUNCTION_SHARE
    out["function_share"] = own
    for items, chars, odd, terms in runs:
        recurrence, regularity, distinct = run_signals(terms)
        out["items"] += items
        for name, value in (("recurrence", recurrence), ("regularity", regularity), ("distinctness", distinct)):
            out[name] = max(out[name], value)
        if repetition and (recurrence >= RECURRENT_SHARE or regularity >= 1):
            out["repeated"] += chars
        elif lists and distinct >= DISTINCT_SHARE and odd <= FUNCTION_RATIO * own * len(terms):
            out["listed"] += chars

    # Sentences: stuffed ones consist of terms that keep coming back.
    spans, terms = [], []
    for line in prose:
        for m in _SENTENCE.finditer(line):
            found = _WORD.findall(m[0].lower())
            if found:
                spans.append((len(terms), len(terms) + len(found), _solid(m[0])))
                terms += found
    if terms and repetition:
        codes, known = _numbered(terms)
        hit = _recurrent(codes, LAGS)
        content = np.fromiter((t not in FUNCTION_WORDS for t in known), bool)[codes]
        counts, hits = np.zeros((2, len(codes) + 1), np.int64)
        np.cumsum(content, out=counts[1:])
        np.cumsum(content & hit, out=hits[1:])
        counts, hits = counts.tolist(), hits.tolist()
        for a, b, chars in spans:
            n = counts[b] - counts[a]
            if n and (hits[b] - hits[a]) >= RECURRENT_SHARE * n and (b - a < 2 * n + 6):
                out["repeated"] += chars
        out["recurrence"] = max(out["recurrence"], hits[-1] / max(1, counts[-1]))
    return out


_PROFILE = "doc_id long, n_solid long, repeated_chars long, listed_chars long, items long, recurrence double, regularity double, distinctness double, function_share double, spam_share double"
_NAMES = [x.split()[0] for x in _PROFILE.split(", ")]


def _profiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
            p = profile((text or "").replace("\r\n", "\n").replace("\r", "\n"))
            spam = p["repeated"] + p["listed"]
            rows.append((doc_id, p["all"], p["repeated"], p["listed"], p["items"], p["recurrence"], p["regularity"], p["distinctness"], p["function_share"], spam / p["all"] if p["all"] else 0.0))
        yield pd.DataFrame(rows, columns=_NAMES)


def page_profiles(documents: DataFrame) -> DataFrame:
    """One row per document: its solid characters, those in spam stretches by measurement, their share, its greatest signals.

    repeated_chars are in stretches of regular repetition, listed_chars in distinct lists that
    do not repeat.  Null and empty texts have zeros.  Repeated documents give repeated rows; whole texts count.
    """
    return spread(documents.select("doc_id", "text")).mapInPandas(_profiles, _PROFILE)


def spam_pages(documents: DataFrame, share: float = 0.5, least_chars: int = 60) -> DataFrame:
    """Documents of which more than ``share`` of the characters are spam; tiny texts are honest."""
    return page_profiles(documents).where(f"spam_share > {share} and n_solid >= {least_chars}")
