"""Personal information in free text, found by weak supervision.

Generous patterns propose spans of five kinds; names also wherever capitals stand in a row. Labelers look at each span from
different sides: its shape, gazetteers, the words before and after it. Each votes for, against, or abstains. How reliable the labelers are is estimated by expectation
maximisation over the vote patterns of all spans, counted over the whole corpus. The posteriors so gained train the final span
classifier, a logistic model over votes, shape and neighbouring words, on a bounded sample; it decides every span. What words
stand around the details of a corpus is learned there; the lists below hold general English only.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quernstone.llm.names import describing
from quernstone.plans.session import checkpointed

KINDS = ["email", "phone", "identity_number", "street_address", "person_name"]
#: Spans on which the final classifier is fitted, about: those whose hash lies below a threshold worked out from their number.
SAMPLE = 20_000
#: Buckets of the classifier's features.
BUCKETS = 1 << 12

# Given names that are no ordinary words (a gazetteer; other names are found by their surroundings).
GIVEN = frozenset(
    """aaron adam adele ahmed aisha alan albert alejandro alice amara amelia amina amy ana andrea andrew angela anita anna anneke antonio arthur
    barbara ben bernice beth bjorn brian bruno callum carla carlos carol cedric charles chloe chris clara claire colin daniel david deborah desmond diego
    donna dwayne edith edward elena elias emeka emily emma eric ernest esther ethan eva farah fatima felix fiona francis gareth george greta
    hannah harold hassan heidi helen henry hollis hugo ian ignacio ines ingrid irene isaac ivan jacob james jane jason javier jean jennifer john jorge
    jose joseph jovan juan julia karen karl keisha kevin kofi laila laura leon linda lucia lucinda luis marco maria marisol martin mary maya michael
    mireille mohammed monica nadia naomi nina noah odette olga oliver omar oscar otis pablo patricia paul pedro peter petra priya rachel rashad
    renée renee robert rosa ruben ruth samuel sandra sarah silas simon sofia søren soren susan tamsin teresa thomas tobias victor walter wren yusuf zoe""".split()
)
# Words that end a name rather than belong to it.
COMMON = frozenset(
    """a about after again all although an and any around as asked at back be because been before being best but by call called came can cc charge contact dear did do
    does during each early either even every everyone for from gave had has have he help her him his home hung i if in into is it its just kindly last late
    least left me mine more my neither nobody nor not now of off on once one or our out over paid please regards right send she shortly signed since
    sincerely so some somebody someone ssn state tel text that thank thanks the their them then there these they this those though to today took two under until up us
    always often never already soon later went saw said says told got paid made knew thought wanted needed lives works wrote took lost found kept moved first second third new old same other very well
    was we were what when where which while who whose why will with within without would yes you your yours xxxx""".split()
)
# What streets end in, and titles before names.
STREETS = "street st avenue ave road rd lane ln drive dr court ct place pl terrace ter boulevard blvd parkway pkwy way circle cir square sq highway hwy trail trl".split()
TITLES = "mr mrs ms miss dr prof sir".split()

_W = r"[^\W\d_]"
_DIGIT = re.compile(r"\d")
_LONG = re.compile(r"\d[\d .()/\-]{4,}\d")
_EMAIL = re.compile(
    r"[^\W_][\w.+\-]*(?:\s?@\s?|\s?[(\[]\s?at\s?[)\]]\s?)[^\W_][\w\-]*(?:(?:\.|\s?[(\[]\s?dot\s?[)\]]\s?|\s+dot\s+)[^\W_][\w\-]*)+|[^\W_][\w.+\-]*\s+at\s+[^\W_][\w\-]*(?:\s+dot\s+[^\W_][\w\-]*)+",
    re.I,
)
_EMAIL_MARKS = ("at)", "at]", "at )", "at ]", " dot ")
_PHONE = re.compile(r"(?<![\w$.,\-/+])(?:\+\d{1,3}[ .\-]?|1[ .\-])?(?:\(\d{3}\) ?|\d{3}[ .\-/]?)\d{3}[ .\-]?\d{4}(?!\w|[\-/]\w|\.\d)|(?<![\w$.,\-/])\+\d{1,3}(?:[ .\-]?\d{2,5}){2,4}(?![\w\-])|(?<![\w$.,\-/+])\d{3}[.\-]\d{4}(?!\w|[\-/]\w|\.\d)")
_NUMBER = re.compile(r"(?<![\w$.,\-/+])(?:\d{3}([ .\-]?)\d{2}\1\d{4}|[A-Za-z]{1,2}[ \-]?\d{6,9}|[A-Za-z]\d{3}-\d{4}-\d{2}|[A-Za-z] \d{4} \d{4}|\d{3} \d{3} \d{3} [A-Za-z]|\d{7,9})(?!\w|[\-/]\w|\.\d)")
_STREET = re.compile(rf"(?<![\w$.,\-#])\d{{1,5}}[A-Za-z]?\s+(?:(?:[NSEW]\.?|North|South|East|West|No\.)\s+)?((?:{_W}[\w'\-]*\s+){{1,3}}?)({'|'.join(STREETS)})\b\.?", re.I)
_UNIT = re.compile(r"(?:,?\s+(?:apt|unit|suite|ste)\b\.?\s*#?\w{1,5}|,?\s+#\w{1,5})?(?:,\s+[A-Z][\w']+(?:\s[A-Z][\w']+)?)?(?:,\s+[A-Z]{2}\s+\d{5})?", re.I)
_WORDS = re.compile(r"[^\W\d_]+")
_INITIAL = re.compile(r"\b[A-Z]\. [A-Z][\w'\-]+ [a-z]")
_TOKEN = re.compile(rf"{_W}(?:['’\-]?{_W})*")

_NAME_LEFT = re.compile(
    r"(?:my (?:late )?(?:mother|father|husband|wife|son|daughter|brother|sister|uncle|aunt|cousin|friend|neighbor|landlady|landlord|roommate)|called (?:him|her)self|(?:supervisor|agent|clerk|manager|representative|man|woman|person|teller) (?:called|named)|(?:spoke|talked|dealt|met) (?:with|to)|went to|letter is from|made out to|ask(?:ed)? for|name is|name on the \w+ is|payee on the \w+ is|signed:|signed by|regards\s?[\-,:]|sincerely,|told by|attention:|attn:?|dear|met)\s+(?:(?:mr|mrs|ms|miss|dr)\b\.?\s+)?"
)
# Every pattern of _NAME_LEFT and _NAME_TITLE ends in one of these.
_CUE_ENDS = """ mother| father| husband| wife| son| daughter| brother| sister| uncle| aunt| cousin| friend| neighbor| landlady| landlord| roommate|himself|herself| called| named|spoke with|spoke to|talked with|talked to|dealt with|met with|went to|letter is from|made out to|
ask for|asked for| is|signed:|signed by|regards|sincerely,|told by|attention:|attn|dear| met|mr.|mrs.|ms.|dr.|prof.|mr |mrs |ms |miss |dr |sir """.replace("\n", "").split("|")
_NAME_RIGHT = re.compile(r"[\s]*(?:who )?(?:said|says|told|tells|took|takes|promised|promises|signed|asked|answered|called|wrote|refused|explained|helped|hung|works|worked|held|picked|spoke|claimed|insisted|apologi[sz]ed|from the \w+ (?:desk|office|team|department|branch))\b")
# Words after which capitals in a row are rather a person, or rather a place or firm.
_PERSON_BEFORE = frozenset("met with by to and asked told called named contacted emailed thank saw dear".split())
_PLACE_BEFORE = frozenset("at from in near of on via through inside outside the a an this that your our using".split())
_UPPER, _LOWER = "A-ZÀ-ÖØ-ÞĀĂĄĆĈĊČĎĐĒĘĚĞİŁŃŇŐŘŚŞŠŢŤŮŰŹŻŽ", "a-zß-öø-ÿāăąćĉċčďđēęěğıłńňőřśşšţťůűźżž"
_CAPITALS = re.compile(rf"(?<![\w@.&'’\-])[{_UPPER}][{_LOWER}]+(?:[\-'’][{_UPPER}][{_LOWER}]+)? (?:[{_UPPER}]\. )?(?:[{_UPPER}]['’])?[{_UPPER}][{_LOWER}]+(?:\-[{_UPPER}][{_LOWER}]+)?(?![\w@&'’\-]| &)")
_SENTENCE = re.compile(r"(?:^|[.!?:]\s*|\n\s*)$")
# Capitalised words that are no names.
_CALENDAR = frozenset("january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday christmas thanksgiving easter".split())
_NAME_TITLE = re.compile(rf"(?<![^\W_])(?:{'|'.join(TITLES)})\b\.?\s+")
_NAME_LEFT_END = re.compile(f"(?:{_NAME_LEFT.pattern}|{_NAME_TITLE.pattern})$")
_PHONE_LEFT = re.compile(r"(?:call(?:ed)?(?: me)?(?: back)?(?: on| at)?|ring(?: me)?|phone|ph|tel|cell(?: is)?|mobile|reached at|callback|text(?:ed)?(?: the code)?(?: to| came from)?|came from|caller used|listed|fax|i left|number is|line is|dial|contact)[\s:.(#]*$")
_PHONE_RIGHT = re.compile(r"[\s)]*(?:as a callback|is (?:the|my|a|our) (?:\w+ )?(?:line|number|phone|cell)|after work|at night|before noon|in the (?:morning|evening)|any ?time|if you)\b")
_OTHER_LEFT = re.compile(r"(?:ticket|order|case|case number|carries number|(?:carries|case) \w+|reference|ref|item|account|acct|card|part|section|invoice|tracking|policy|plan|case really number|confirmation)(?: number| no| ending in)?[\s.:#]*$")
_IDENTITY_LEFT = re.compile(r"(?:\bssn|\bss ?#|social(?: security)?(?: number| no| #)?|taxpayer(?: id| number)?|\bi?tin|passport(?: no| number)?|licen[cs]e(?: no| number)?|state id(?: no| number)?|tax id)[\s.,:#]*(?:is |was )?$")
_IDENTITY_RIGHT = re.compile(r"[\s,)]*(?:back to me )?as (?:my|the) social\b|[\s,]*(?:is|was) (?:my (?:social|ssn|passport|licen[cs]e)|refused|scanned|copied|printed)")
_HOME_LEFT = re.compile(r"(?:live at|lives at|lived at|mailed to|shipped to|moved (?:from|to)|came to|address:?(?: is)?|home is|shows?|check to|reside at|resident at|send it to|deliver(?:ed)? to|house at)\s*$")
_HOME_RIGHT = re.compile(r"[\s\w,.#]{0,60}?(?:is where (?:i|we|my)|where (?:i|we|my))\b")


def _lowered(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


@functools.lru_cache(maxsize=1)
def _spotter() -> ahocorasick.Automaton:
    """Finds given names, and the ends of what stands before names, in one walk over a text."""
    a = ahocorasick.Automaton()
    for word in GIVEN:
        a.add_word(word, (len(word), False))
    for word in _CUE_ENDS:
        a.add_word(word, (len(word), True))
    a.make_automaton()
    return a


def _cues(text: str, low: str, mixed: bool) -> tuple[set[int], bool]:
    """Where a name may begin by what stands before it, and whether any given name occurs."""
    cues: set[int] = set()
    given, n = False, len(low)
    for end, (size, cue) in _spotter().iter(low):
        if not cue:
            if not given and (end + 1 == n or not low[end + 1].isalpha()) and (end < size or not low[end - size].isalpha()):
                given = True
            continue
        # the pattern decides; it ends in white space after the word that was spotted
        near = [*_NAME_LEFT.finditer(low, max(0, end - 48), min(n, end + 12)), *_NAME_TITLE.finditer(low, max(0, end - 4), min(n, end + 6))]
        for m in near:
            # "my son saw": after a relation a name must look like one, or be in the gazetteer
            if not m.group().startswith("my ") or m.group().startswith("my name") or not mixed or text[m.end() : m.end() + 1].isupper():
                cues.add(m.end())
    return cues, given


def _names(text: str, low: str, taken: list[tuple[int, int]], streets: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Spans that may be names: from a given name or after a cue, to one family name at most."""
    mixed = text != low
    cues, given_name = _cues(text, low, mixed)
    if streets:  # "Vesper Dr" is no title, and what belongs to an address is no name
        cues = {c for c in cues if not any(a < c <= b + 2 for a, b in streets)}
        taken = [*taken, *streets]
    found: list[tuple[int, int]] = []
    if cues or given_name or _INITIAL.search(text):
        yield from _near_cues(text, low, taken, mixed, cues, found)
    if not mixed or text.isupper():
        return
    for m in _CAPITALS.finditer(text):
        words, behind = _WORDS.findall(m.group().lower()), _WORDS.match(low, m.end() + 1)
        if any(a < m.end() and m.start() < b for a, b in [*taken, *found]) or any(w in COMMON or w in _CALENDAR or w in STREETS or w in TITLES or _organisation(w) for w in words):
            continue
        if behind and (_organisation(behind.group()) or behind.group() in STREETS):
            continue
        # what begins a sentence is capital anyway: there only what people do speaks for a name
        if _SENTENCE.search(text[max(0, m.start() - 8) : m.start()]) and not _NAME_RIGHT.match(low, m.end()):
            continue
        yield m.start(), m.end()


def _near_cues(text: str, low: str, taken: list[tuple[int, int]], mixed: bool, cues: set[int], found: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Those that begin with a given name or after a cue; they are kept in ``found`` too."""
    tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(text)]
    n, last = len(tokens), -1

    def gap(i: int) -> str:
        return text[tokens[i][1] : tokens[i + 1][0]] if i + 1 < n else "."

    def family(i: int) -> bool:
        """Whether token i can be a family name."""
        s, e = tokens[i]
        word = low[s:e]
        return e - s > 2 and word not in COMMON and word not in STREETS and (text[s].isupper() or not mixed or text[s : s + 1].islower() and text[tokens[i - 1][0]].islower())

    i = 0
    while i < n:
        s, e = tokens[i]
        word = low[s:e]
        given = word in GIVEN
        initial = e - s == 1 and text[e : e + 2] == ". " and i + 1 < n and family(i + 1) and (s in cues or bool(_NAME_RIGHT.match(low, tokens[i + 1][1])))
        if not (given or initial or s in cues and word not in COMMON and word not in TITLES) or s <= last or any(a < e and s < b for a, b in taken):
            i += 1
            continue
        end, j = e, i
        if initial:
            j += 1
            end = tokens[j][1]
        elif gap(j) == ", " and j + 1 < n and low[tokens[j + 1][0] : tokens[j + 1][1]] in GIVEN:  # family name first
            j += 1
            end = tokens[j][1]
        else:
            while j + 1 < n and j < i + 2:
                a, b = tokens[j + 1]
                nxt = low[a:b]
                if gap(j) == " " and b - a == 1 and text[b : b + 1] == "." and j + 2 < n:  # middle initial
                    j += 1
                    end = b + 1
                elif gap(j) in (" ", ". ") and nxt in ("de", "van", "von", "la", "di", "del", "al", "da") and j + 2 < n:
                    j += 1
                elif gap(j) in (" ", ". ") and family(j + 1):
                    j += 1
                    end = b
                    break
                else:
                    break
        if not given and j + 1 < n and gap(j) == " " and _organisation(low[tokens[j + 1][0] : tokens[j + 1][1]]):
            i = j + 1
            continue
        start = s
        if given and i > 0 and gap(i - 1) == ", " and family(i - 1) and end == e and tokens[i - 1][0] in cues:
            start = tokens[i - 1][0]
        elif given and i > 0 and text[s - 2 : s] == ", " and family(i - 1) and _NAME_RIGHT.match(low[e : e + 40]) and (i < 2 or gap(i - 2) not in (" ",)):
            start = tokens[i - 1][0]
        found.append((start, end))
        yield start, end
        last = end
        i = max(j, i) + 1


def _organisation(word: str) -> bool:
    return word in _FIRMS or describing(word) is not None


@dataclass(frozen=True)
class Span:
    kind: int
    start: int
    end: int
    votes: tuple[int, ...]
    features: list[int]


def _vote(yes: object, no: object = False) -> int:
    return 1 if yes else -1 if no else 0


def _digits(s: str) -> str:
    return re.sub(r"\D", "", s)


def _last_word(before: str) -> str:
    return m.group(1) if (m := re.search(r"([^\W\d_]+) $", before)) else ""


# Labelers by kind: each sees (span, before, after), all lower case, 48 characters on either side; original span last.
_Labeler = Callable[[str, str, str, str], int]
LABELERS: dict[str, list[_Labeler]] = {
    "email": [
        lambda s, b, a, o: _vote("@" in s or "at)" in s or "at]" in s, " at " in s and " dot " not in s),
        lambda s, b, a, o: _vote(re.search(r"(?:\.|dot\W*)[a-z]{2,8}$", s), not re.search(r"[a-z]$", s)),
        lambda s, b, a, o: _vote(re.search(r"(?:contact|cc|to|with|is|at|e-?mail\w*|address)\W*$", b)),
    ],
    "phone": [
        lambda s, b, a, o: _vote(len(_digits(s)) in (10, 11, 12) and re.search(r"[()+]", s) or re.search(r"\d{3}[ .\-/]\d{3}[ .\-]\d{4}$", s), len(_digits(s)) < 7),
        lambda s, b, a, o: _vote(_PHONE_LEFT.search(b)),
        lambda s, b, a, o: _vote(_PHONE_RIGHT.match(a)),
        lambda s, b, a, o: _vote(False, _OTHER_LEFT.search(b)),
        lambda s, b, a, o: _vote(len(_digits(s)) == 7 and "-" in s or re.match(r"^[2-9]", _digits(s)[-10:]) and len(_digits(s)) >= 10, re.match(r"^[01]", _digits(s)[-10:]) and not s.startswith("+")),
        lambda s, b, a, o: _vote(False, _IDENTITY_LEFT.search(b) or _IDENTITY_RIGHT.match(a)),
    ],
    "identity_number": [
        lambda s, b, a, o: _vote(re.match(r"^\d{3}[ .\-]\d{2}[ .\-]\d{4}$", s)),
        lambda s, b, a, o: _vote(_IDENTITY_LEFT.search(b)),
        lambda s, b, a, o: _vote(_IDENTITY_RIGHT.match(a)),
        lambda s, b, a, o: _vote(False, _OTHER_LEFT.search(b)),
        lambda s, b, a, o: _vote(re.search(r"^[a-z]|[a-z]$", s) and re.search(r"passport|licen[cs]e|state id", b), not re.search(r"^[a-z]|[a-z]$", s) and len(_digits(s)) != 9),
        lambda s, b, a, o: _vote(False, _PHONE_LEFT.search(b) or re.search(r"[$#]$|reference $", b)),
    ],
    "street_address": [
        lambda s, b, a, o: _vote(not any(w in COMMON for w in re.findall(r"[a-z]+", s)[:-1]), True),
        lambda s, b, a, o: _vote(_HOME_LEFT.search(b) or _HOME_RIGHT.match(a)),
        lambda s, b, a, o: _vote(re.match(r"\W*(?:apt|unit|suite|ste|#)|,\s+[a-z ]+,\s+[a-z]{2}\s+\d{5}", a)),
        lambda s, b, a, o: _vote(re.search(r"[A-Z]", o) and all(w[0].isupper() for w in re.findall(r"[A-Za-z]{2,}", o)), re.search(r"\b(?:days|weeks|dollars|charges|minutes|hours|times|percent|plan)\b", s)),
    ],
    "person_name": [
        lambda s, b, a, o: _vote(re.split(r"[\s.,]+", s)[0] in GIVEN or re.split(r"[\s,]+", s)[-1] in GIVEN),
        lambda s, b, a, o: _vote(_NAME_LEFT_END.search(b) or _last_word(b) in _PERSON_BEFORE, _last_word(b) in _PLACE_BEFORE),
        lambda s, b, a, o: _vote(_NAME_RIGHT.match(a), re.match(r" (?:at table|period|account|bank|wallet|street|st|lane|road|clerk|charged)\b", a)),
        lambda s, b, a, o: _vote(len(re.findall(r"[^\W\d_]{2,}", s)) >= 2),
        lambda s, b, a, o: _vote(o[:1].isupper() and not o.isupper(), re.match(r"^(?:the|this|that|your|our)\b", s) or o[:1].islower() and len(s) < 4),
        lambda s, b, a, o: _vote(False, any(w in COMMON or w in _FIRMS for w in re.findall(r"[^\W\d_]+", s) if len(w) > 2)),
    ],
}
# Words that mark an organisation or an office rather than a person.
_FIRMS = frozenset("bank bancorp trust financial wallet payments credit union savings services remittance group holdings inc llc ltd company corp records toys grill shoes games motel outfitters desk office customer supply depot sir madam team manager supervisor".split())
WIDTH = max(len(x) for x in LABELERS.values())


def _bucket(s: str) -> int:
    return zlib.crc32(s.encode("utf-8", "surrogatepass")) % BUCKETS


def _features(kind: int, s: str, before: str, after: str, original: str, votes: tuple[int, ...]) -> list[int]:
    left, right = re.findall(r"[^\W\d_]+|[#:$(]", before)[-3:], re.findall(r"[^\W\d_]+|[):]", after)[:3]
    shape = re.sub(r"(.)\1+", r"\1", re.sub(r"[^\W\d_]", "a", re.sub(r"\d", "9", s)))[:12]
    named = [f"v{i}{v}" for i, v in enumerate(votes) if v] + [f"l{w}" for w in left] + [f"r{w}" for w in right] + [f"s{shape}", f"n{min(3, len(s.split()))}", f"u{original[:1].isupper()}", "1"]
    return [_bucket(f"{kind}{x}") for x in named]


def candidates(text: str | None) -> list[Span]:
    """Every proposed span with its votes and features, by start; spans of one kind don't overlap."""
    if not text:
        return []
    low = _lowered(text)
    found: list[tuple[int, int, int]] = []
    taken: list[tuple[int, int]] = []
    if "@" in text or any(mark in low for mark in _EMAIL_MARKS):
        for m in _EMAIL.finditer(text):
            found.append((0, m.start(), m.end()))
            taken.append((m.start(), m.end()))
    if _DIGIT.search(text):
        matches = {(3, m.start(), _UNIT.match(text, m.end()).end()) for m in _STREET.finditer(text)}
        for long in _LONG.finditer(text):
            # what a number begins with and what must not follow it lies near its digits
            for k, pattern in ((1, _PHONE), (2, _NUMBER)):
                matches |= {(k, m.start(), m.end()) for m in pattern.finditer(text, max(0, long.start() - 4), long.end() + 12)}
        found += [x for x in matches if not any(a < x[2] and x[1] < b for a, b in taken)]
    streets = [(s, e) for k, s, e in found if k == 3]
    found += [(4, s, e) for s, e in _names(text, low, taken, streets)]
    out = []
    for k, start, end in sorted(found, key=lambda x: (x[1], x[0])):
        core = end
        if k == 3:  # the part behind the street is judged as what comes after
            core = _STREET.match(text, start).end() if _STREET.match(text, start) else end
        s, b, a = low[start:core], low[max(0, start - 48) : start], low[core : core + 80]
        votes = tuple(f(s, b, a, text[start:core]) for f in LABELERS[KINDS[k]])
        out.append(Span(k, start, end, votes, _features(k, s, b, a, text[start:core], votes)))
    return out


def _pattern(votes: tuple[int, ...]) -> int:
    return sum((v + 1) * 3**i for i, v in enumerate(votes))


def reliabilities(counts: dict[int, float], labelers: int, rounds: int = 60) -> tuple[dict[int, float], np.ndarray]:
    """Posterior of each vote pattern, and each labeler's chance of each vote when a span is (1) or isn't (0) a case.

    Expectation maximisation from a start where labelers are thought right more often than not; abstaining counts too.
    """
    patterns = sorted(counts)
    votes = np.array([[p // 3**i % 3 for i in range(labelers)] for p in patterns])
    n = np.array([counts[p] for p in patterns], float)
    score = (votes - 1).sum(1)
    post = 1 / (1 + np.exp(-1.5 * (score - 0.5)))
    chance = np.zeros((2, labelers, 3))
    for _ in range(rounds):
        for y in (0, 1):
            w = n * (post if y else 1 - post)
            for i in range(labelers):
                # a small count in favour of a labeler's being right keeps EM from exchanging the classes
                prior = np.array([0.5, 2.0, 3.0]) if y else np.array([3.0, 2.0, 0.5])
                chance[y, i] = np.bincount(votes[:, i], weights=w, minlength=3) + prior
                chance[y, i] /= chance[y, i].sum()
        share = np.clip((n * post).sum() / max(n.sum(), 1), 0.02, 0.98)
        logit = np.log(share / (1 - share)) + sum(np.log(chance[1, i, votes[:, i]] / chance[0, i, votes[:, i]]) for i in range(labelers))
        post = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return dict(zip(patterns, post.tolist())), chance


def _fit(features: list[list[int]], y: np.ndarray, steps: int = 300) -> np.ndarray:
    lens = np.array([len(f) for f in features])
    row, col = np.repeat(np.arange(len(features)), lens), np.array([c for f in features for c in f])
    w = np.zeros(BUCKETS)
    m = np.zeros(BUCKETS)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.bincount(row, weights=w[col], minlength=len(features))))
        g = np.bincount(col, weights=(p - y)[row], minlength=BUCKETS) / len(features) + 1e-5 * w
        m = 0.9 * m + g
        w -= 0.5 * m
    return w


_CANDIDATES = "id {kind}, kinds array<int>, starts array<int>, ends array<int>, patterns array<int>, features array<array<int>>"


def propose(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row for each text with any proposed span."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [candidates(t) for t in batch.column("text").to_pylist()]
            some = pa.array([bool(s) for s in spans])
            spans = [s for s in spans if s]
            ints = pa.list_(pa.int32())
            columns = [pa.array([[x.kind for x in s] for s in spans], ints), pa.array([[x.start for x in s] for s in spans], ints), pa.array([[x.end for x in s] for s in spans], ints), pa.array([[_pattern(x.votes) for x in s] for s in spans], ints), pa.array([[x.features for x in s] for s in spans], pa.list_(ints))]
            yield pa.RecordBatch.from_arrays([batch.column("id").filter(some), *columns], names=["id", "kinds", "starts", "ends", "patterns", "features"])

    return df.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(run, _CANDIDATES.format(kind=dict(df.dtypes)[key]))


def train(proposed: DataFrame) -> np.ndarray:
    """Weights of the span classifier. Vote patterns are counted over all spans; at most 5 * 3**6 counts reach the driver."""
    each = proposed.select(F.explode(F.arrays_zip("kinds", "patterns", "features")).alias("x")).select("x.*")
    posterior: dict[tuple[int, int], float] = {}
    counts: dict[int, dict[int, float]] = {}
    for r in each.groupBy("kinds", "patterns").count().collect():
        counts.setdefault(r["kinds"], {})[r["patterns"]] = r["count"]
    for k, c in counts.items():
        posts, _ = reliabilities(c, len(LABELERS[KINDS[k]]))
        posterior |= {(k, p): v for p, v in posts.items()}
    # by a threshold of a hash, so that about SAMPLE rows in all reach the driver, the same ones however rows are stored
    unit = F.xxhash64("kinds", "patterns", "features").bitwiseAND(F.lit((1 << 53) - 1)) / float(1 << 53)
    distinct = each.agg(F.approx_count_distinct(unit, 0.02).alias("n")).first()["n"]
    share = min(1.0, SAMPLE / max(distinct, 1))
    rows = each.where(unit < share).select("kinds", "patterns", "features").distinct().collect()
    rows.sort()
    if not rows:
        return np.zeros(BUCKETS)
    return _fit([r["features"] for r in rows], np.array([posterior[r["kinds"], r["patterns"]] for r in rows]))


def accepted(starts: list[int], ends: list[int], features: list[list[int]], weights: np.ndarray) -> list[int]:
    """Positions of the spans that are taken: likely ones, and of those that overlap the likelier, at equal chance the earlier."""
    score = [float(weights[f].sum()) for f in features]
    taken: list[int] = []
    for i in sorted((i for i, z in enumerate(score) if z > 0), key=lambda i: (-score[i], starts[i], i)):
        if all(ends[i] <= starts[j] or ends[j] <= starts[i] for j in taken):
            taken.append(i)
    return sorted(taken, key=lambda i: starts[i])


def find(df: DataFrame, key: str, text: str) -> tuple[DataFrame, np.ndarray]:
    """``(found, weights)``; found: (key, kind, start_pos), one row for each detail.

    Positions count characters (code points) from 0. Null and empty texts have no details. Rows with equal or null keys are
    searched each for itself. Further columns play no part. An empty table gives no rows.
    """
    proposed = checkpointed(propose(df, key, text))
    weights = train(proposed)
    shared = df.sparkSession.sparkContext.broadcast(weights)  # BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, kind, start = [], [], []
            for i, (k, s, e, f) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("kinds", "starts", "ends", "features")))):
                for j in accepted(s, e, f, shared.value):
                    row.append(i)
                    kind.append(KINDS[k[j]])
                    start.append(s[j])
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(row, pa.int32())), pa.array(kind, pa.string()), pa.array(start, pa.int64())], names=[key, "kind", "start_pos"])

    return proposed.mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, kind string, start_pos long"), weights


def redacted(text: str | None, weights: np.ndarray) -> str | None:
    """The text with each accepted span replaced by its kind in brackets; null stays null."""
    if not text:
        return text
    spans = candidates(text)
    keep = accepted([s.start for s in spans], [s.end for s in spans], [s.features for s in spans], weights)
    out, at = [], 0
    for s in (spans[i] for i in keep):
        if s.start >= at:
            out += [text[at : s.start], f"[{KINDS[s.kind].upper()}]"]
            at = s.end
    return "".join([*out, text[at:]])


def redact(df: DataFrame, text: str, weights: np.ndarray) -> DataFrame:
    """``df`` with typed placeholders for the details in column ``text``; all else stays as it is."""
    shared = df.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            yield batch.set_column(at, text, pa.array([redacted(t, shared.value) for t in batch.column(at).to_pylist()], pa.string()))

    return df.mapInArrow(run, df.schema)
