"""Personal data by exact patterns and a semi-Markov conditional random field.

The base patterns (e-mail, IP address, payment card, phone) always count.  The
field then reads the *sequences* of a text: digit groups that stand close together, the
words around an at sign (``@``, ``[at]``, ``(at)``), the capitalised words behind a title or
"name is", and long opaque words behind a word such as ``token``.  Candidate segments of up to ``LONGEST`` atoms
are scored as whole spans (digit count, shape of the atoms, separators, checksum, range of
the parts, the words beside them), and dynamic programming over segments of
bounded length chooses boundaries and types jointly.  It adds personal data
that no base pattern covers: national phone and identity numbers, addresses
written with ``[at]`` and ``[dot]``, names behind a title, and secrets such as keys.

Two rules hold for every candidate, whatever the weights say: an address
``ip`` has four groups joined by single points, and no segment begins or ends beside a point or
comma that joins it to a further digit, nor is two groups joined by a point or comma; decimals
of any length therefore are no candidates.

The weights are trained on the driver by the exact conditional likelihood over
generated sequences of fixed number, so they depend on no table.

Defined results: null and empty texts have no spans; offsets are code points,
ends exclusive; repeated rows give repeated results; an empty table gives an
empty result; other columns are not read, or pass through ``redact``.
"""

from __future__ import annotations

import functools
import hashlib
import math
import random
import re
from collections import defaultdict
from collections.abc import Iterator

from pyspark.sql import DataFrame

from .common import per_document, rewritten

KINDS = ("email", "ip", "card", "phone", "id", "secret", "name")
BASE_KINDS = KINDS[:4]
#: Atoms in a segment at most.
LONGEST = 8

_DIGIT = re.compile("[0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_GROUP = re.compile("[0-9]+")
_GAP = re.compile(r"[\x20().+/-]{1,3}")
#: Address characters, for walking left of an at sign.
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: At signs in words or brackets, the word before and what may be a domain behind them.
_AT = re.compile(r"(?:@|[\[({] ?at ?[\])}]) ?")
_DOT = r"(?:\.| ?[\[({] ?dot ?[\])}] ?)"
_BEFORE_AT = re.compile(r"[A-Za-z0-9._%+-]{1,64}\Z")
_AFTER_AT = re.compile(rf"[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{1,63}}){{0,5}}")
_JOINT = re.compile(_DOT)
#: A word that announces a secret, and an opaque word behind it.
_SECRET = re.compile(r"(?i:(?<![a-z])((?:[a-z]+[_-])?(?:token|key|secret|password|passwd|pwd|bearer|credential)s?)[\"']?)(?:\s?[=:]\s?|\s(?:is\s)?)[\"']?([A-Za-z0-9_./+=~-]{7,511}[A-Za-z0-9_/+=~-])")
#: A title or phrase before a name, and up to four capitalised words behind it.
_NAMED = re.compile(r"\b((?:Mr|Mrs|Ms|Dr|Prof)\.|(?:Mr|Mrs|Ms|Miss|Dr|Herr|Frau|Monsieur|Madame|Mme|Mlle|Señora?|Sra?\.)|[Mm]y name is|[Jj]e m'appelle|[Ii]ch heiße|[Mm]e llamo) ((?:[^\W\d_a-z][^\W\d_]+(?:-[^\W\d_]+)?)(?: [^\W\d_a-z][^\W\d_]+(?:-[^\W\d_]+)?){0,3})")
#: A text without any of these has no match of the two patterns above.
_SECRET_WORDS = ("token", "key", "secret", "pass", "pwd", "bearer", "credential")
_TITLE_WORDS = ("Mr", "Ms", "Miss", "Dr", "Prof", "Herr ", "Frau ", "Monsieur ", "Madame ", "Mme ", "Mlle ", "Señor", "Sr", "y name is", "e m'appelle", "ch heiße", "e llamo")
# Words that stand before numbers of each kind, in four languages.
CUES = {
    "phone": "tel telephone phone call mobile fax cell telefon téléphone tél portable móvil movil teléfono telefono handy whatsapp ruf appelez llame anruf".split(),
    "id": "ssn id dni nie nir passport sécu social identity ausweis steuernummer insurance tax".split(),
    "card": "card visa carte tarjeta kreditkarte mastercard".split(),
    "other": "isbn order invoice version page nr no number article figure section price total euro usd lat lon pi about".split(),
}
_CUE_OF = {w: k for k, words in CUES.items() for w in words}
_CUE_WORD = re.compile(r"([^\W\d_]{2,16})[.:#=]{0,2} ?\Z")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    """The checksum of payment cards."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    """Leftmost matches, found from their at signs, so that long words cost no backtracking."""
    out: list[Span] = []
    free = 0
    at = text.find("@")
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in _LOCAL_CHARS:
            begin -= 1
        m = _DOMAIN.match(text, at) if begin < at else None
        if m:
            out.append(("email", begin, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> list[Span]:
    """The spans of the base patterns, by kind, then start."""
    out = _emails(text) if "@" in text else []
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        parts = m[0].split(".")
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return out


class Sequence:
    """Atoms (begin, end) of a text that stand together, and what they are: numbers, address, secret or name."""

    def __init__(self, family: str, atoms: list[tuple[int, int]], mark: tuple[int, int] = (-1, -1)):
        self.family, self.atoms, self.mark = family, atoms, mark


def _numbers(text: str) -> list[Sequence]:
    """Runs of digit groups with at most three separators between neighbours."""
    out: list[Sequence] = []
    last = -9
    for m in _GROUP.finditer(text):
        if out and m.start() - last <= 3 and _GAP.fullmatch(text, last, m.start()):
            out[-1].atoms.append(m.span())
        else:
            out.append(Sequence("numbers", [m.span()]))
        last = m.end()
    return out


def _addresses(text: str) -> list[Sequence]:
    """For each at sign: the word before it and the labels behind it."""
    out = []
    for m in _AT.finditer(text):
        begin = m.start() - (m.start() > 0 and text[m.start() - 1] == " ")
        before = _BEFORE_AT.search(text, max(0, begin - 64), begin)
        after = _AFTER_AT.match(text, m.end())
        if before and after:
            atoms, at = [before.span()], m.end()
            for joint in [*_JOINT.finditer(text, m.end(), after.end()), None]:
                atoms.append((at, joint.start() if joint else after.end()))
                at = joint.end() if joint else at
            out.append(Sequence("address", atoms, (begin, m.end())))
    return out


def sequences(text: str) -> list[Sequence]:
    """All sequences of a text, each family in order."""
    out = _numbers(text) if _DIGIT.search(text) else []
    if "@" in text or "at" in text and ("[" in text or "(" in text or "{" in text):
        out += _addresses(text)
    lower = text.lower()
    if any(w in lower for w in _SECRET_WORDS):
        out += [Sequence("secret", [m.span(2)], m.span(1)) for m in _SECRET.finditer(text)]
    for m in _NAMED.finditer(text) if any(w in text for w in _TITLE_WORDS) else ():
        out.append(Sequence("name", [(m.start(2) + w.start(), m.start(2) + w.end()) for w in re.finditer(r"\S+", m[2])], m.span(1)))
    return out


def segment(text: str, s: Sequence, i: int, j: int) -> tuple[int, int]:
    """The place of atoms i to j; numbers with a plus sign or bracket before them."""
    begin, end = s.atoms[i][0], s.atoms[j][1]
    if s.family == "numbers":
        while begin and text[begin - 1] in "(+" and s.atoms[i][0] - begin < 2:
            begin -= 1
    return begin, end


def _joined(text: str, at: int, step: int) -> bool:
    """Whether a point or comma at a place joins a number to a further digit."""
    return 0 <= at < len(text) and text[at] in ".," and 0 <= at + step < len(text) and text[at + step] in "0123456789"


def kinds_of(text: str, s: Sequence, i: int, j: int) -> tuple[str, ...]:
    """The kinds that a segment may have at all."""
    if s.family == "address":
        return ("email",) if i == 0 and j >= 2 else ()
    if s.family == "secret":
        return ("secret",)
    if s.family == "name":
        return ("name",) if i == 0 else ()
    begin, end = segment(text, s, i, j)
    between = [text[s.atoms[k][1] : s.atoms[k + 1][0]] for k in range(i, j)]
    digits = sum(e - b for b, e in s.atoms[i : j + 1])
    if _joined(text, begin - 1, -1) or _joined(text, end, 1) or between in (["."], [","]):
        return ()
    address = ("ip",) if between == ["."] * 3 else ()
    return (*address, "card", "phone", "id") if 7 <= digits <= 19 else address


def features(text: str, s: Sequence, i: int, j: int) -> list[str]:
    """Features of a whole segment."""
    begin, end = segment(text, s, i, j)
    sizes = [e - b for b, e in s.atoms[i : j + 1]]
    between = [text[s.atoms[k][1] : s.atoms[k + 1][0]] for k in range(i, j)]
    word = begin and text[begin - 1].isalnum() or end < len(text) and text[end].isalnum()
    if s.family == "address":
        last = text[slice(*s.atoms[j])]
        mark = text[slice(*s.mark)]
        return [
            "address", f"mark={mark.strip()[0]}", f"spaced={mark != mark.strip()}", f"labels={min(j, 4)}", f"written dots={sum(b != '.' for b in between[1:]) > 0}", f"top={'letters' if last.isalpha() and len(last) <= 6 else 'other'}",
            f"top size={min(len(last), 7)}", f"rest={len(s.atoms) - 1 - j}", f"local={'digits' if text[slice(*s.atoms[0])].isdigit() else 'word'}", *(["inside a word"] if word else []),
        ]
    value = text[begin:end]
    if s.family == "secret":
        classes = "".join(c for c, found in (("d", re.search("[0-9]", value)), ("u", re.search("[A-Z]", value)), ("l", re.search("[a-z]", value))) if found)
        kinds = sum(a.isdigit() != b.isdigit() for a, b in zip(value, value[1:], strict=False))
        announced = text[s.mark[0] : s.mark[1]].lower().strip("\"'")
        return ["secret", f"classes={classes}", f"size={'short' if len(value) < 12 else 'middle' if len(value) < 20 else 'long'}", f"changes={min(kinds, 3)}", f"sign={next((c for c in text[s.mark[1] : begin] if c in '=:'), 'none')}", f"pass={'pass' in announced or 'pwd' in announced}"]
    if s.family == "name":
        phrase = text[slice(*s.mark)]
        return ["name", f"words={j + 1}", f"rest={len(s.atoms) - 1 - j}", f"title={len(phrase.split()) == 1}", f"shouted={value.isupper()}"]
    digits = sum(sizes)
    kinds = "".join(sorted(set("".join(between))))
    shape = "-".join(map(str, sizes)) if len(sizes) <= LONGEST and max(sizes) <= 19 else "other"
    lead = text[s.atoms[i][0]]
    cue = _CUE_WORD.search(text, max(0, begin - 20), begin)
    out = [
        "bias", f"digits={digits}", f"shape={shape}", f"between={kinds}", f"first={text[begin]}" if text[begin] in "+(" else "first=digit",
        f"shape={shape} lead={lead if lead == '0' else '679' if lead in '679' else 'other'} between={kinds}", f"cue={_CUE_OF.get(cue[1].lower(), 'none') if cue else 'none'}", f"groups={len(sizes)}",
        f"cue={_CUE_OF.get(cue[1].lower(), 'none') if cue else 'none'} groups={min(len(sizes), 2)}",
    ]
    if 13 <= digits <= 19:
        out.append(f"luhn={luhn(''.join(text[b:e] for b, e in s.atoms[i : j + 1]))}")
    if len(sizes) == 4 and kinds == ".":
        out.append(f"octets={all(n <= 3 and int(text[b:e]) <= 255 for n, (b, e) in zip(sizes, s.atoms[i : j + 1], strict=True))}")
    if kinds in ("-", "/", ".", " ") and len(sizes) in (2, 3):
        years = [text[b:e] for b, e in s.atoms[i : j + 1]]
        out.append(f"date={any(len(y) == 4 and y[:2] in ('19', '20') for y in years)}")
    if word:
        out.append("inside a word")
    if i and s.atoms[i][0] - s.atoms[i - 1][1] == 1 and text[s.atoms[i - 1][1]] in "-/" or j + 1 < len(s.atoms) and s.atoms[j + 1][0] - s.atoms[j][1] == 1 and text[s.atoms[j][1]] in "-/":
        out.append("goes on")
    return out


class SemiMarkovCRF:
    """Weights of (feature, kind); kind "" is a single atom outside all spans, of score 0."""

    def __init__(self, weights: dict[tuple[str, str], float]):
        self.weights = weights

    def _lattice(self, text: str, s: Sequence) -> Iterator[list[tuple[int, str, list[str]]]]:
        """For each atom in turn: the segments that end there, as (first atom, kind, features)."""
        for j in range(len(s.atoms)):
            here: list[tuple[int, str, list[str]]] = [(j, "", [])]
            digits = 0
            for i in range(j, max(-1, j - LONGEST), -1):
                if s.family == "numbers":
                    digits += s.atoms[i][1] - s.atoms[i][0]
                    if digits > 19:
                        break
                    if digits < 4:
                        continue
                if kinds := kinds_of(text, s, i, j):
                    found = features(text, s, i, j)
                    here += [(i, kind, found) for kind in kinds]
            yield here

    def _score(self, kind: str, found: list[str]) -> float:
        get = self.weights.get
        return sum([get((f, kind), 0.0) for f in found])

    def best(self, text: str, s: Sequence) -> list[Span]:
        """The best segmentation; ties go to fewer and earlier spans.  Memory: three numbers an atom."""
        reach: list[tuple[float, int, str]] = [(0.0, -1, "")]
        for here in self._lattice(text, s):
            top = max(((reach[i][0] + self._score(kind, found), -n) for n, (i, kind, found) in enumerate(here)), key=lambda t: (t[0], t[1]))
            i, kind, _ = here[-top[1]]
            reach.append((top[0], i, kind))
        out: list[Span] = []
        j = len(s.atoms)
        while j:
            _, i, kind = reach[j]
            if kind:
                out.append((kind, *segment(text, s, i, j - 1)))
            j = i
        return out[::-1]

    def expectation(self, lattice: list, into: dict[tuple[str, str], float]) -> float:
        """Adds the expected feature counts, by forward and backward sums; returns log Z."""
        n = len(lattice)
        scores = [[self._score(kind, found) for _, kind, found in here] for here in lattice]
        forward, backward = [0.0] * (n + 1), [-math.inf] * n + [0.0]
        for j in range(n):
            forward[j + 1] = _log_sum([forward[i] + s for (i, _, _), s in zip(lattice[j], scores[j], strict=True)])
        for j in range(n - 1, -1, -1):
            for (i, _, _), s in zip(lattice[j], scores[j], strict=True):
                backward[i] = _log_sum([backward[i], backward[j + 1] + s])
        for j in range(n):
            for (i, kind, found), s in zip(lattice[j], scores[j], strict=True):
                if kind:
                    p = math.exp(forward[i] + s + backward[j + 1] - forward[n])
                    for f in found:
                        into[f, kind] += p
        return forward[n]

    @classmethod
    def fitted(cls, examples: list[tuple[str, list[Span]]], *, rounds: int = 25, rate: float = 0.5, decay: float = 0.01) -> SemiMarkovCRF:
        """Adagrad on the conditional log likelihood."""
        field = cls({})
        prepared = []
        for text, spans in examples:
            for sequence in sequences(text):
                lattice = list(field._lattice(text, sequence))
                if all(len(here) == 1 for here in lattice):
                    continue
                truth: dict[tuple[str, str], float] = defaultdict(float)
                for j, here in enumerate(lattice):
                    for i, kind, found in here:
                        if kind and (kind, *segment(text, sequence, i, j)) in spans:
                            for f in found:
                                truth[f, kind] += 1
                prepared.append((lattice, truth))
        past: dict[tuple[str, str], float] = defaultdict(lambda: 1e-3)
        for _ in range(rounds):
            for begin in range(0, len(prepared), 40):
                slope: dict[tuple[str, str], float] = defaultdict(float)
                for lattice, truth in prepared[begin : begin + 40]:
                    expected: dict[tuple[str, str], float] = defaultdict(float)
                    field.expectation(lattice, expected)
                    for k, v in truth.items():
                        slope[k] += v
                    for k, v in expected.items():
                        slope[k] -= v
                for k, v in slope.items():
                    v -= decay * field.weights.get(k, 0.0)
                    past[k] += v * v
                    field.weights[k] = field.weights.get(k, 0.0) + rate * v / math.sqrt(past[k])
        return field


def _log_sum(values: list[float]) -> float:
    top = max(values)
    return top if top == -math.inf else top + math.log(sum([math.exp(v - top) for v in values]))


def generated(n: int = 1600, seed: int = 7) -> list[tuple[str, list[Span]]]:
    """Texts with their spans: personal data beside dates, prices, decimals, versions, plain numbers and words."""
    rng = random.Random(seed)
    pick = rng.choice
    d = lambda k: "".join(pick("0123456789") for _ in range(k))
    letters = lambda k, among="abcdefghijklmnopqrstuvwxyz": "".join(pick(among) for _ in range(k))
    mixed = lambda k: letters(k, "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
    word = lambda: letters(rng.randrange(2, 9))
    capital = lambda: word().capitalize()

    def card() -> str:
        body = pick("3456") + d(pick([14, 14, 14, 13, 12, 17]))
        digits = next(body + c for c in "0123456789" if luhn(body + c))
        sep = pick(["", "", " ", "-"])
        return sep.join(digits[k : k + 4] for k in range(0, len(digits), 4)) if sep and len(digits) == 16 else digits

    def phone() -> str:
        area, a, b = d(3), d(3), d(4)
        world = [f"+{pick(['1', '33', '49'])} ({area}) {a}-{b}", f"({area}) {a}-{b}", f"{area}-{a}-{b}", f"+{d(2)} {d(3)} {d(3)} {d(3)}", f"({area}) {a} {b}"]
        s = pick(" .-")
        french = pick([f"0{pick('123456789')}{s}{d(2)}{s}{d(2)}{s}{d(2)}{s}{d(2)}", f"0033 {pick('123456789')} {d(2)} {d(2)} {d(2)} {d(2)}"])
        german = pick([f"0{pick('123456789')}{d(1)} {d(8)}", f"0{pick('123456789')}{d(2)} {d(pick([6, 7]))}", f"0{pick('123456789')}{d(2)}/{d(pick([6, 7]))}", f"0{pick('123456789')}{d(3)} {d(6)}", f"0049 {d(2)} {d(8)}", f"0{pick('123456789')}{d(2)}-{d(7)}"])
        spanish = pick([f"{pick('679')}{d(2)} {d(3)} {d(3)}", f"{pick('679')}{d(2)} {d(2)} {d(2)} {d(2)}", f"{pick('679')}{d(2)}-{d(3)}-{d(3)}"])
        return pick([pick(world), pick(world), french, german, spanish])

    def spelled() -> str:
        at, dot = pick([" [at] ", "[at]", " (at) ", "(at)", " {at} ", "@", "@"]), pick([" [dot] ", "[dot]", " (dot) ", ".", "."])
        return word() + pick(["", f".{word()}", d(2)]) + at + dot.join([letters(rng.randrange(2, 9)) for _ in range(pick([1, 1, 2]))] + [pick(["com", "org", "de", "fr", "es", "net", "info"])])

    announced = lambda: pick(["token", "api_key", "secret", "key", "password", "access-token", "Bearer"]) + pick([' = "', "=", ": ", " "])
    secret = lambda: pick([letters(pick([32, 40, 64]), "0123456789abcdef"), mixed(pick([20, 24, 36, 40])), f"ghp_{mixed(36)}", f"AKIA{letters(16, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')}", f"sk-{mixed(32)}", mixed(12) + d(2)])
    titled = lambda: pick(["Mr. ", "Mrs. ", "Dr. ", "Herr ", "Frau ", "Madame ", "Señor ", "My name is ", "ich heiße ", "me llamo "])
    cue = lambda kind: pick(CUES[kind]) + pick([" ", ": ", ". "]) if rng.random() < 0.3 else ""
    personal = {
        "ip": lambda: ("", ".".join(str(rng.randrange(256)) for _ in range(4))),
        "card": lambda: (cue("card"), card()),
        "phone": lambda: (cue("phone"), phone()),
        "id": lambda: (cue("id"), pick([f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)} {d(2)} {d(4)}", f"{pick('12')} {d(2)} {d(2)} {d(2)} {d(3)} {d(3)} {d(2)}"])),
        "email": lambda: ("", spelled()),
        "secret": lambda: (announced(), secret()),
        "name": lambda: (titled(), " ".join(capital() for _ in range(pick([1, 2, 2, 3])))),
    }
    broken = lambda: next(x for x in iter(lambda: d(16), None) if not luhn(x))
    decimal = lambda: f"{pick(['', '-'])}{d(rng.randrange(1, 4))}{pick('..,')}{d(rng.randrange(1, 16))}"
    other = [
        lambda: f"{pick(['19', '20'])}{d(2)}-{d(2)}-{d(2)}", lambda: f"{d(2)}/{d(2)}/20{d(2)}", lambda: f"{d(2)}.{d(2)}.19{d(2)}", lambda: f"20{d(2)}-{d(2)}-{d(2)} {d(2)}:{d(2)}:{d(2)}",
        broken, broken, decimal, decimal, lambda: f"{decimal()} {decimal()}", lambda: f"{decimal()}, {decimal()}", lambda: f"{decimal()} {pick(['kg', 'cm', '%', 'EUR'])}", lambda: d(rng.randrange(1, 13)), lambda: d(rng.randrange(7, 22)),
        lambda: f"{rng.randrange(300, 999)}.{d(3)}.{d(3)}.{d(3)}", lambda: f"{d(1)}.{d(1)}.{d(2)}", lambda: f"{d(2)}.{d(2)}.{d(4)}", lambda: f"20{d(2)}-20{d(2)}", lambda: f"{pick('123458')}{d(2)} {d(3)} {d(3)}", lambda: f"{d(pick([1, 2]))} {d(3)} {d(3)}",
        lambda: f"{d(4)} {d(4)}", lambda: f"{d(3)}.{d(2)}", lambda: " ".join(d(4) for _ in range(3)), lambda: f"{d(pick([1, 2, 3]))}.{d(3)}.{d(3)}", lambda: f"{d(pick([1, 2, 3]))}.{d(3)}.{d(3)}", lambda: " ".join(d(rng.randrange(1, 8)) for _ in range(rng.randrange(2, 7))),
        lambda: f"{d(5)}-{d(4)}", lambda: f"{d(1)}-{d(3)}-{d(5)}-{d(1)}", lambda: f"{d(3)}-{d(1)}-{d(2)}-{d(6)}-{d(1)}", lambda: f"{pick(CUES['other'])} {d(rng.randrange(5, 14))}", lambda: f"{d(4)}/{d(4)}", lambda: f"{d(3)}/{d(5)}",
        lambda: f"{word()} (at) {word()}", lambda: f"{word()} [at] {d(2)}", lambda: f"{word()}@{word()}", lambda: f"{word()} @ {d(2)}.{d(2)}", lambda: f"{word()} (at) {word()}.{word()}ish", lambda: f"{announced()}{word()}{word()}", lambda: f"{announced()}{letters(10)}", lambda: f"key {d(10)}", lambda: f"the password {letters(8)}",
        lambda: f"Dr. {capital().upper()}S THE",
    ]
    out = []
    for _ in range(n):
        text, spans = pick(["", "at ", "so "]), []
        for k in range(pick([1, 1, 2, 3])):
            text += " " * (k > 0)
            if rng.random() < 0.5:
                kind = pick(list(personal))
                before, value = personal[kind]()
                text += before
                spans.append((kind, len(text), len(text) + len(value)))
            else:
                value = pick(other)()
            text += value
        out.append((text + pick(["", " on", ".", '"']), spans))
    return out


@functools.lru_cache(1)
def trained() -> SemiMarkovCRF:
    """The field fitted on the generated sequences."""
    return SemiMarkovCRF.fitted(generated())


def find(text: str, field: SemiMarkovCRF) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans by kind and start; added spans overlap no base span and none another."""
    base = base_spans(text)
    more = [span for sequence in sequences(text) for span in field.best(text, sequence)]
    out = list(base)
    if more:  # added spans in order of place; each must be free of base spans and of the one added before
        base_places = sorted((b, e) for _, b, e in base)
        at = reach = free = 0
        for kind, b, e in sorted(more, key=lambda s: (s[1], -s[2])):
            while at < len(base_places) and base_places[at][0] < e:
                reach = max(reach, base_places[at][1])
                at += 1
            if b >= reach and b >= free:
                out.append((kind, b, e))
                free = e
    return base, sorted(out, key=lambda s: (KINDS.index(s[0]), s[1]))


def listed(spans: list[Span]) -> str:
    """kind:start:end, joined by commas."""
    return ",".join(f"{k}:{b}:{e}" for k, b, e in spans)


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans, base_sha256 and spans of every whole text."""
    field = docs.sparkSession.sparkContext.broadcast(trained())

    def prepare():
        def digest(texts: list[bytes]) -> dict[str, list]:
            out: dict[str, list] = {f"n_{k}": [] for k in BASE_KINDS} | {"base_sha256": [], "spans": []}
            for t in texts:
                base, spans = find(t.decode("utf-8", "replace"), field.value)
                for k in BASE_KINDS:
                    out[f"n_{k}"].append(sum(s[0] == k for s in base))
                out["base_sha256"].append(hashlib.sha256(listed(base).encode()).hexdigest())
                out["spans"].append(listed(spans))
            return out

        return digest

    return per_document(docs, ", ".join(f"n_{k} long" for k in BASE_KINDS) + ", base_sha256 string, spans string", prepare)


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in angle brackets; overlapping spans go together."""
    out, at = [], 0
    for kind, b, e in sorted(spans, key=lambda s: (s[1], -s[2])):
        if b >= at:
            out += [text[at:b], f"<{kind.upper()}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` with personal data masked in the texts."""
    field = docs.sparkSession.sparkContext.broadcast(trained())

    def prepare():
        def decide(texts: list[bytes]) -> tuple[list[bool], dict[int, str]]:
            new = {}
            for i, t in enumerate(texts):
                text = t.decode("utf-8", "replace")
                spans = find(text, field.value)[1]
                if spans:
                    new[i] = masked(text, spans)
            return [True] * len(texts), new

        return decide

    return rewritten(docs, prepare)
