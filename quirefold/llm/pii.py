"""Personal data: fixed patterns, and spans that a semi-Markov conditional random field adds."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterable, Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: What the field tells apart: the kinds of the fixed patterns, and keys and passwords.
LABELS = (*KINDS, "secret")
#: The longest candidate segment of several parts in code points, its most parts (names, digit groups), and the context that is read before it. A single run of letters and digits may be of any length, as its boundaries are known.
LONGEST, PARTS, CONTEXT = 160, 6, 24
#: How many digits a number of a kind may have, and how many groups.
SHAPES = {"ip": (4, 12, 4, 4), "card": (13, 19, 1, PARTS), "phone": (7, 15, 1, PARTS)}
MARGIN = 0.5
#: Documents drawn by hash from which contexts are learned, at most about so many, with windows of so many code points.
WEAK_DOCS, WINDOW = 2000, 60

_local = re.compile(r"[A-Za-z0-9._%+-]")
_domain = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_ip = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_hint = re.compile(r"[0-9@=]|[\[(]at[\])]|\bdot\b|(?:key|word|wd|token|secret)[\"']?\s?:")

# Where segments may begin and end: numbers are chains of digit groups, addresses are names about an at sign, and
# secrets are runs of letters and digits with single joints. Repeats that could be tried again are possessive or bounded.
_DOT = r"(?: ?\[\.\] ?| ?[\[(]dot[\])] ?| dot | \. )"
_chain = re.compile(rf"(?<![A-Za-z0-9])[0-9]++(?:(?:[ .()/_+-]{{1,3}}|{_DOT})[0-9]++)*+(?![A-Za-z0-9])")
_group = re.compile("[0-9]+")
_at = re.compile(r"@|[\[(]at[\])]|(?<= )at(?= )")
_before_at = re.compile(r"[A-Za-z0-9._%+-]*[A-Za-z0-9] ?\Z")
_after_at = re.compile(rf" ?[A-Za-z0-9-]+(?:(?:{_DOT}|\.)[A-Za-z0-9-]+){{0,4}}")
_name = re.compile("[A-Za-z0-9]+")
_mixed = re.compile(r"(?<![A-Za-z0-9])(?=[A-Za-z]*+[0-9])(?=[0-9]*+[A-Za-z])[A-Za-z0-9]{8,}+")
_assigned = re.compile(r"(?:token|secret|passw(?:or)?d|pwd|key)[\"']?\s{0,2}\Z", re.I)
_value = re.compile(r"\s{0,2}[\"']?([A-Za-z0-9]+)")
_joint = "-_./+="
_known = re.compile(r"AKIA|ASIA|ghp|gho|sk|xox|eyJ|AIza")
_TRIGGER = {
    "email": re.compile(r"\b(?:e-?mail|mail|contact|write)\b[^0-9]{0,12}\Z", re.I),
    "ip": re.compile(r"\b(?:ip|host|address|server)\b[^0-9]{0,12}\Z", re.I),
    "card": re.compile(r"\b(?:card|visa|mastercard|amex|credit|cc)\b[^0-9]{0,12}\Z", re.I),
    "phone": re.compile(r"\b(?:tel|phone|call|fax|mobile|cell)\b[^0-9]{0,12}\Z", re.I),
    "secret": re.compile(r"(?:token|secret|passw(?:or)?d|pwd|key)[\"']?\s{0,2}[:=]\s{0,2}[\"']?\Z", re.I),
}


def luhn(digits: str) -> bool:
    twice = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(int(d) for d in digits[-1::-2]) + sum(x - 9 * (x > 9) for x in twice)) % 10 == 0


def _digits(s: str) -> str:
    return "".join([c for c in s if "0" <= c <= "9"])


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The spans of the fixed patterns, by kind and then start. Every pattern is run in time linear in the text.

    An address is found from its @: the local part is the whole run before it, down to the end of the match before.
    """
    out = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _local.match(text[start - 1]):
            start -= 1
        found = _domain.match(text, at) if start < at else None
        if found:
            out.append(("email", start, found.end()))
        done = found.end() if found else at + 1
        at = text.find("@", done)
    out += [("ip", m.start(), m.end()) for m in _ip.finditer(text) if all(_byte(p) for p in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in _card.finditer(text) if 16 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _phone.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


def _byte(part: str) -> bool:
    part = part.lstrip("0") or "0"
    return len(part) <= 3 and int(part) <= 255


_COMMON = ("bias", "trigger", "other_trigger", "glued", "goes_on_before", "goes_on_after", "near_before", "near_after")
_OWN = {
    "email": ("at_sign", "at_mark", "at_word", "ending", "no_ending", "spaced", "dotted_word", "short_name"),
    "ip": ("bytes", "not_bytes", "one_joint", "wide_joint", "plain_dots"),
    "card": ("luhn", "not_luhn", "digits_13_15", "digits_16", "digits_17_19", "quads", "one_joint", "one_group", "groups_off", "wide_joint"),
    "phone": ("digits_7_9", "digits_10_11", "digits_12_15", "ends_3_4", "groups_off", "one_group", "plus", "zeros", "parens", "one_joint", "wide_joint", "date_like", "quads", "bytes"),
    "secret": ("known", "hex", "upper", "mixed", "turns", "under_16", "from_32", "joined", "letters", "digits", "assigned_letters", "date_like"),
}
NAMES = [(k, n) for k in LABELS for n in (*_COMMON, *_OWN[k])]
_PLACE = {x: i for i, x in enumerate(NAMES)}
_date = re.compile(r"(?:19|20)[0-9]{2}\D[0-9]{1,2}\D[0-9]{1,2}|[0-9]{1,2}\D[0-9]{1,2}\D(?:19|20)?[0-9]{2}|(?:19|20)[0-9]{2}\D{1,3}(?:19|20)[0-9]{2}")


def segment_features(text: str, start: int, end: int, kind: str) -> list[int]:
    """The places in NAMES of what holds for text[start:end] as a whole, taken as kind."""
    return [_PLACE[kind, n] for n in (*_around(kind, *_before(text[max(0, start - CONTEXT) : start]), text[end : end + 2]), *_inside_any(text[start:end], kind))] + _assigned_letters(text, start, end, kind)


def _assigned_letters(text: str, start: int, end: int, kind: str) -> list[int]:
    return [_PLACE["secret", "assigned_letters"]] if kind == "secret" and text[start:end].isalpha() and _TRIGGER["secret"].search(text, max(0, start - CONTEXT), start) else []


@lru_cache(50_000)
def _before(context: str) -> tuple[frozenset[str], tuple[str, ...]]:
    """Which kinds the words before a segment announce, and how it begins."""
    how = [n for n, yes in (("glued", context[-1:].isalnum() or context[-1:] in tuple("$€£")), ("goes_on_before", _open.search(context)), ("near_before", _near.search(context))) if yes]
    return frozenset(k for k in LABELS if _TRIGGER[k].search(context)), tuple(how)


_open, _near, _more = re.compile(r"[A-Za-z0-9][-_./+(@]+\Z"), re.compile(r"[0-9] \Z"), re.compile(r"[-_./+(@][A-Za-z0-9]|\[\.")


@lru_cache(50_000)
def _around(kind: str, announced: frozenset[str], how: tuple[str, ...], after: str) -> list[str]:
    has = ["bias", *how]
    if kind in announced:
        has.append("trigger")
    if announced - {kind}:
        has.append("other_trigger")
    if after[:1].isalnum() and "glued" not in has:
        has.append("glued")
    if _more.match(after):
        has.append("goes_on_after")
    if after[:1] == " " and "0" <= after[1:] <= "9":
        has.append("near_after")
    return has


@lru_cache(50_000)
def _inside(s: str, kind: str) -> list[str]:
    has = []
    groups = _group.findall(s)
    if kind == "email":
        has.append("at_sign" if "@" in s else "at_mark" if re.search(r"[\[(]at[\])]", s) else "at_word")
        has.append("ending" if re.search(rf"(?:\.|{_DOT})[A-Za-z]{{2,6}}\Z", s) else "no_ending")
        if " " in s:
            has.append("spaced")
        if re.search(r"[\[(]dot[\])]| dot ", s):
            has.append("dotted_word")
        if len(s) < 7:
            has.append("short_name")
    elif kind == "secret":
        turns = len(re.findall(r"[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])", s))
        letters, digits = bool(re.search("[A-Za-z]", s)), bool(groups)
        holds = {
            "known": _known.match(s), "hex": re.fullmatch("[0-9a-f]+|[0-9A-F]+", s) and letters and digits, "upper": re.fullmatch("[0-9A-Z]+", s) and letters and digits,
            "mixed": re.search("[a-z]", s) and re.search("[A-Z]", s) and digits, "turns": turns >= 4, "under_16": len(s) < 16, "from_32": len(s) >= 32, "joined": not s.isalnum(),
            "letters": not digits, "digits": not letters, "date_like": _date.search(s),
        }
        has += [n for n, yes in holds.items() if yes]
    else:
        d, joints = "".join(groups), re.findall("[^0-9]+", s.lstrip("+("))
        n, size = len(d), [len(g) for g in groups]
        same = len(set(joints)) == 1
        if same:
            has.append("one_joint")
        if any(len(x.strip()) > 1 or len(x) > 2 for x in joints):
            has.append("wide_joint")
        bytes_ = len(groups) == 4 and all(_byte(g) for g in groups)
        quads = len(groups) > 1 and all(x == 4 for x in size[:-1])
        if kind == "ip":
            has.append("bytes" if bytes_ else "not_bytes")
            if same and joints[0] == ".":
                has.append("plain_dots")
        elif len(groups) == 1:
            has.append("one_group")
        elif quads:
            has.append("quads")
        if kind == "card":
            has.append("luhn" if luhn(d) else "not_luhn")
            has.append("digits_13_15" if n <= 15 else "digits_16" if n == 16 else "digits_17_19")
            if len(groups) > 5 or min(size) < 3:
                has.append("groups_off")
        if kind == "phone":
            has.append("digits_7_9" if n <= 9 else "digits_10_11" if n <= 11 else "digits_12_15")
            holds = {
                "ends_3_4": size[-2:] == [3, 4], "groups_off": max(size) > 5 or min(size[1:], default=2) < 2, "plus": s.startswith("+"), "zeros": s.startswith("00"),
                "parens": "(" in s and ")" in s, "date_like": _date.fullmatch(s), "bytes": bytes_,
            }
            has += [n for n, yes in holds.items() if yes]
    return has


def _inside_any(s: str, kind: str) -> list[str]:
    """Long runs are not kept, so what is kept is bounded."""
    return _inside(s, kind) if len(s) <= LONGEST else _inside.__wrapped__(s, kind)


def _numbers(text: str) -> Iterator[tuple[int, int, str]]:
    for m in _chain.finditer(text):
        groups = [x.span() for x in _group.finditer(text, *m.span())]
        for i, (s, _) in enumerate(groups):
            starts = [s]
            lead = s
            while lead and text[lead - 1] in "+(" and s - lead < 2:
                lead -= 1
                starts.append(lead)
            n = 0
            for parts, (a, e) in enumerate(groups[i : i + PARTS], 1):
                n += e - a
                if n > 19 or e - s > LONGEST:
                    break
                for kind, (least, most, few, many) in SHAPES.items():
                    if least <= n <= most and few <= parts <= many:
                        yield from ((at, e, kind) for at in starts)


def _addresses(text: str) -> Iterator[tuple[int, int, str]]:
    spoken = "dot" in text
    for m in _at.finditer(text):
        if m[0] == "at" and not spoken:
            continue
        low = max(0, m.start() - LONGEST // 2)
        left = _before_at.search(text, low, m.start())
        right = _after_at.match(text, m.end(), m.end() + LONGEST // 2)
        if left and right:
            starts = [x.start() for x in _name.finditer(text, left.start(), m.start()) if not text[x.start() - 1 : x.start()].isalnum()]
            ends = [x.end() for x in _name.finditer(text, *right.span()) if not text[x.end() : x.end() + 1].isalnum()]
            yield from ((s, e, "email") for s in starts for e in ends)


def _secrets(text: str) -> Iterator[tuple[int, int, str]]:
    seeds = {m.span() for m in _mixed.finditer(text)}
    for mark in re.finditer("[:=]", text):
        if _assigned.search(text, max(0, mark.start() - CONTEXT), mark.start()) and (m := _value.match(text, mark.end())):
            seeds.add(m.span(1))
    for a, b in seeds:
        if b - a > LONGEST:
            yield a, b, "secret"
            continue
        starts, ends, at = [a], [b], a
        while (m := re.search(r"[A-Za-z0-9]+[-_./+=]\Z", text[max(0, at - 66) : at])) and b - at <= LONGEST // 2 and len(starts) < PARTS:
            at -= len(m[0])
            starts.append(at)
        at = b
        while at < len(text) and text[at] in _joint and (m := _name.match(text, at + 1)) and m.end() - a <= LONGEST and len(ends) < PARTS:
            at = m.end()
            ends.append(at)
        yield from ((s, e, "secret") for s in starts for e in ends if 6 <= e - s <= LONGEST)


def segments(text: str) -> list[tuple[int, int, str]]:
    """Candidate segments by end: for each kind, all from a beginning to an end of a name or digit group, within the bounds of that kind."""
    found = {*_numbers(text), *_addresses(text), *_secrets(text)}
    return sorted(found, key=lambda x: (x[1], x[0], LABELS.index(x[2])))


def best_segments(text: str, weights: np.ndarray | list[float], taken: list[tuple[int, int]] | None = None) -> list[tuple[str, int, int]]:
    """The best choice of segments that overlap neither each other nor what is taken, boundaries and kinds jointly: a dynamic program over the candidates' ends."""
    cands = segments(text)
    if taken:
        starts = [s for s, _ in taken]
        reach = np.maximum.accumulate([e for _, e in taken])
        free = np.searchsorted(starts, [e for _, e, _ in cands]) - 1
        cands = [c for c, i in zip(cands, free, strict=True) if i < 0 or reach[i] <= c[0]]
    ends = [0, *sorted({e for _, e, _ in cands})]
    best: list[tuple[float, int, tuple[str, int, int] | None]] = [(0.0, 0, None)]
    at = 0
    for i, end in enumerate(ends[1:], 1):
        top: tuple[float, int, tuple[str, int, int] | None] = (best[i - 1][0], i - 1, None)
        while at < len(cands) and cands[at][1] == end:
            s, e, k = cands[at]
            at += 1
            j = i - 1
            while ends[j] > s:
                j -= 1
            score = best[j][0] + sum([weights[f] for f in segment_features(text, s, e, k)]) - MARGIN
            if score > top[0]:
                top = score, j, (k, s, e)
        best.append(top)
    out, i = [], len(best) - 1
    while i > 0:
        _, j, span = best[i]
        if span:
            out.append(span)
        i = j
    return out[::-1]


Line = tuple[str, set[tuple[int, int, str]]]


def _lines(rng: random.Random) -> Line:
    """A line made up from personal data in several dresses, decoys and words, with its gold segments."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    of = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    word = lambda: of("abcdefghinorstu", rng.randint(2, 8))

    def card(sep: str) -> str:
        body = "4" + d(14)
        body += next(c for c in "0123456789" if luhn(body + c))
        return sep.join(body[i : i + 4] for i in range(0, 16, 4))

    def coded(letters: str, n: int) -> str:
        return of(letters, n - 4) + d(2) + of("abcdef" if letters.islower() else "ABCDEF", 1) + d(1)

    byte = lambda: str(rng.randint(0, 255))
    hexes, capitals, both = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    gold = {
        "email": [lambda: f"{word()}@{word()}.com", lambda: f"{word()}.{d(2)}@{word()}.example.org", lambda: f"{word()} [at] {word()} [dot] net", lambda: f"{word()} (at) {word()}.com", lambda: f"{word()}@ {word()}.org", lambda: f"{word()} at {word()} dot com"],
        "ip": [lambda: ".".join(byte() for _ in range(4)), lambda: "[.]".join(byte() for _ in range(4)), lambda: " . ".join(byte() for _ in range(4))],
        "card": [lambda: card(""), lambda: card(" "), lambda: card("-"), lambda: card("."), lambda: card("/")],
        "phone": [lambda: f"({d(3)}) {d(3)}-{d(4)}", lambda: f"{d(3)}-{d(3)}-{d(4)}", lambda: f"0049 {d(3)} {d(3)} {d(4)}", lambda: f"{d(3)}.{d(3)}.{d(4)}", lambda: f"+1 ({d(3)}) {d(3)}-{d(4)}", lambda: f"+{rng.randint(30, 49)} {d(3)} {d(7)}"],
        "secret": [lambda: coded(hexes, 40), lambda: coded(hexes, 32), lambda: "AKIA" + of(capitals, 16), lambda: "ghp_" + of(both, 36), lambda: "sk-" + of(both, 32), lambda: f"{word()}{d(3)}X{d(2)}"],
    }
    decoy = [
        lambda: f"version {rng.randint(1, 9)}.{d(1)}", lambda: f"{rng.randint(1990, 2030)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}", lambda: f"{rng.randint(1, 28):02d}.{rng.randint(1, 12):02d}.{rng.randint(1990, 2030)}",
        lambda: f"${d(2)}.{d(2)}", lambda: f"{rng.randint(1, 9)}{d(15)}", lambda: f"item{d(4)}", lambda: f"{rng.randint(300, 999)}.{d(3)}.{d(3)}.{d(3)}", lambda: f"{word()} at {word()}. {word()}", lambda: f"{d(2)}-{d(2)}", lambda: f"pages {d(2)}-{d(3)}",
        lambda: f"{d(3)} {d(3)}", lambda: f"{d(2)} {d(2)} {d(2)}", lambda: f"{word()} dot {word()}", lambda: f"{d(13)}", lambda: f"{rng.randint(1900, 2000)}-{rng.randint(2001, 2030)}", lambda: d(18), lambda: f"{d(1)}.{d(1)}.{d(1)}.{d(1)}.{d(2)}",
        lambda: f"{word()}{d(2)}-{word()}/{d(4)}", lambda: f"key: {word()}", lambda: f"{word()}2vec model", lambda: f"https://{word()}.com/{rng.randint(2000, 2030)}/{word()}-{word()}", lambda: " ".join(d(rng.randint(1, 3)) for _ in range(rng.randint(4, 16))), lambda: rng.choice([" ", ", "]).join(map(str, [*range(60)][rng.randint(0, 30) :][: rng.randint(5, 16)])), lambda: f"{d(4)} {d(4)}", lambda: f"{d(1)},{d(3)},{d(3)}",
    ]
    lead = {"email": ["mail "], "ip": ["host "], "card": ["card "], "phone": ["call "], "secret": ['token = "', "password: ", "api_key="]}
    text, spans = word(), set()
    for _ in range(rng.randint(1, 3)):
        if rng.random() < 0.6:
            kind = rng.choice(LABELS)
            which = rng.randrange(len(gold[kind]))
            assigned = kind == "secret" and (which in (0, 1, 5) or rng.random() < 0.5)
            said = rng.choice(lead[kind]) if assigned or (kind != "secret" and rng.random() < 0.4) else ""
            text += f" {said}"
            for more in range(1 + (not assigned and kind != "email" and rng.random() < 0.2)):  # some stand side by side
                span = gold[kind][which]()
                text += " " * more
                spans.add((len(text), len(text) + len(span), kind))
                text += span
            text += '"' * said.count('"')
            text += rng.choice([", ", " ", " ", " ", ". "])
            text += "" if rng.random() < 0.3 else word()
        else:
            text += f" {rng.choice(decoy)()}, {word()}"
    return text, spans


def weak_lines(text: str) -> list[Line]:
    """Windows of a real text with the segments that the fixed patterns are sure of; and windows of short numbers, which hold none."""
    out = []
    for k, s, e in base_spans(text):
        low, high = max(0, s - WINDOW), min(len(text), e + WINDOW)
        part = text[low:high]
        marked = {(b - low, c - low, x) for x, b, c in base_spans(text) if low <= b and c <= high}
        if all(c in {*segments(part)} for c in marked) and not any(m.end() - m.start() > 4 and not any(b < m.end() and m.start() < c for b, c, _ in marked) for m in re.finditer("[0-9]+", part)) and not _mixed.search(part):
            out.append((part, marked))
    if not out:
        for m in _chain.finditer(text):
            part = text[max(0, m.start() - WINDOW) : m.end() + WINDOW]
            if len(_digits(part)) < 7 and "@" not in part and not _mixed.search(part):
                out.append((part, set()))
    return out


@cache
def trained(weak: tuple[tuple[str, frozenset], ...] = (), lines: int = 1200, epochs: int = 8, seed: int = 7) -> tuple[float, ...]:
    """Weights by stochastic gradient ascent on the likelihood of the gold segmentations of made-up lines and of weakly labelled ones, with forward and backward sums over the candidates."""
    rng = random.Random(seed)
    data = []
    for text, gold in [*(_lines(rng) for _ in range(lines)), *weak]:
        cands = segments(text)
        if gold <= {*cands}:
            data.append((*_lattice(cands), [segment_features(text, *c) for c in cands], np.array([c in gold for c in cands], float)))
    w, seen = np.zeros(len(NAMES)), np.full(len(NAMES), 1e-6)
    for _ in range(epochs):
        rng.shuffle(data)
        for froms, tos, n, feats, gold in data:
            if not feats:
                continue
            off = gold - _marginals(froms, tos, n, [sum(w[f] for f in fs) for fs in feats])
            grad = -1e-4 * w
            for x, fs in zip(off, feats, strict=True):
                if abs(x) > 1e-6:
                    grad[fs] += x
            seen += grad * grad
            w += 0.5 * grad / np.sqrt(seen)
    return tuple(float(x) for x in w)


def _lattice(cands: list[tuple[int, int, str]]) -> tuple[list[int], list[int], int]:
    """For candidates by end: the numbers of the points where they begin and end, and how many points there are."""
    points = sorted({0, *(s for s, _, _ in cands), *(e for _, e, _ in cands)})
    place = {p: i for i, p in enumerate(points)}
    return [place[s] for s, _, _ in cands], [place[e] for _, e, _ in cands], len(points)


def _plus(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a + math.log1p(math.exp(b - a)) if b > -math.inf else a


def _marginals(froms: list[int], tos: list[int], n: int, score: list[float]) -> np.ndarray:
    """The chance of each candidate segment, from the sums over all segmentations up to and from every point."""
    ahead, behind = [0.0] + [-math.inf] * (n - 1), [-math.inf] * (n - 1) + [0.0]
    k = 0
    for i in range(1, n):
        ahead[i] = ahead[i - 1]
        while k < len(tos) and tos[k] == i:
            ahead[i] = _plus(ahead[i], ahead[froms[k]] + score[k])
            k += 1
    k = len(tos) - 1
    for i in range(n - 1, 0, -1):
        behind[i - 1] = _plus(behind[i - 1], behind[i])
        while k >= 0 and tos[k] == i:
            behind[froms[k]] = _plus(behind[froms[k]], behind[i] + score[k])
            k -= 1
    return np.exp(np.array([ahead[a] + x + behind[b] for a, b, x in zip(froms, tos, score, strict=True)]) - ahead[-1])


def find(text: str, weights: np.ndarray | list[float]) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and all spans by kind and then start: those and the field's segments, which are chosen around them."""
    if not _hint.search(text):
        return [], []
    base = base_spans(text)
    added = best_segments(text, weights, sorted((s, e) for _, s, e in base))
    return base, sorted(base + added, key=lambda x: (LABELS.index(x[0]), x[1]))


def _joined(spans: Iterable[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def learned(docs: DataFrame, key: str = "doc_id", text: str = "text", weak_docs: int = WEAK_DOCS) -> tuple[float, ...]:
    """Weights from made-up lines and from the windows of about weak_docs documents, drawn by a hash of their key and text's length; those without an at sign or a digit give none."""
    share = max(1, docs.count() // weak_docs)
    rows = docs.where(F.pmod(F.xxhash64(F.col(key), F.length(text)), F.lit(share)) == 0).where(F.col(text).rlike("[0-9@]")).select(F.col(text).alias("t"))

    def windows(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("t", pa.string()), ("s", pa.list_(pa.string()))]))
        return pa.array([[{"t": t, "s": [f"{a}:{b}:{k}" for a, b, k in sorted(gold)]} for t, gold in weak_lines(x.as_py())[:4]] for x in texts], kind)

    found = rows.select(F.inline(F.arrow_udf(windows, "array<struct<t: string, s: array<string>>>")("t"))).distinct().collect()  # a few short windows of each drawn document
    lines = sorted((r["t"], tuple(r["s"])) for r in found)
    part = lambda x: (int(x.split(":")[0]), int(x.split(":")[1]), x.split(":")[2])
    return trained(tuple((t, frozenset(map(part, s))) for t, s in lines))


def spans_of(text: Column, weights: tuple[float, ...] | None = None) -> Column:
    """A struct of base and all: lists of spans as kind:start:end in code points, joined by commas."""
    held = list(weights or trained())

    def spans(texts: pa.Array) -> pa.Array:
        found = [find(x.as_py() or "", held) for x in texts]
        return pa.StructArray.from_arrays([pa.array([_joined(x[i]) for x in found], pa.string()) for i in (0, 1)], ["base", "all"])

    return F.arrow_udf(spans, "base string, all string")(F.coalesce(text, F.lit("")))


def personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, the numbers of base spans by kind, base_sha256 and spans.

    Null and empty texts have no spans. Every whole text is read by itself, so repeated rows get equal results. The dynamic
    program goes over all segments between boundaries of names and digit groups, of at most LONGEST code points and PARTS parts (single runs of letters and digits: of any length), with base spans as
    what it can't cross; its work is linear in a text's boundaries. Spans of the field may be of the kind secret, which sorts last.
    """
    rows = docs.select(F.col(key).alias("doc_id"), spans_of(F.col(text), learned(docs, key, text)).alias("s"))
    count = lambda k: F.regexp_count("s.base", F.lit(f"{k}:")).cast("long").alias(f"n_{k}")
    return rows.select("doc_id", *[count(k) for k in KINDS], F.sha2("s.base", 256).alias("base_sha256"), F.col("s.all").alias("spans"))


def sha256_of(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(_joined(spans).encode()).hexdigest()
