"""Personal data by patterns and a semi-Markov conditional random field.

The base patterns (email, ip, card, phone) are found first and always stay. In
the windows between them a semi-Markov CRF looks for what they miss: written-out
addresses ("ann at example dot com"), numbers without a plus, spaced octets,
national numbers and bank accounts. A candidate segment is up to max_atoms atoms
long (that bound on an entity is the method's; None lifts it, and segments then
end where their digits or gaps allow no entity) and is scored whole: its digit groups, checksums, cue words to its left and
what adjoins it, each with a weight for each kind. Viterbi over segments picks
boundaries and kinds jointly; an atom outside any entity scores 0, so a segment
is only kept where the model finds it likelier than none.

The weights are trained here, by gradient ascent on the conditional likelihood
over windows that sentences() writes from a seed: entities of each kind among
words, and numbers that are none (versions, dates, prices, hashes, keys). Their
number is the parameter EXAMPLES; no corpus rows are used.

Free style: one Arrow pass, no shuffle; whole texts.

Defined results: a null text is an empty one and has no span; spans are in code
points, end exclusive; added spans overlap neither base spans nor each other;
repeated rows each keep their row, null ids stay null, an empty table gives no
row, further columns are not read (redacted keeps them).
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import map_rows, table

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "ssn", "iban")
EXAMPLES, EPOCHS, SEED = 400, 40, 7
MAX_ATOMS = 20
#: No kind has more digits.
MAX_DIGITS = 34

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+$")
#: A run of digits is only entered at its first: the match from there is the leftmost.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """By their at sign: no other character of the pattern can be one."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > end and (c := text[begin - 1]).isascii() and (c.isalnum() or c in "._%+-"):
            begin -= 1
        if begin < at and (m := DOMAIN.match(text, at)):
            out.append((begin, m.end()))
            end = m.end()
        at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if DIGITS.search(text):
        out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(d := p.lstrip("0")) < 4 and int(d or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and luhn(d):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 10 <= sum(map(str.isdigit, m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


# --- the segment model -------------------------------------------------------

ATOM = re.compile(r"[^\W\d_]+|[0-9]+|[^\s]")
SEEDS = re.compile(r"[0-9]{3}|[0-9][ .()-]{1,2}[0-9]|@|[\[({] ?at ?[\])}]")
SPOKEN = re.compile(r"\bat\b.{1,60}\bdot\b", re.I)
EMAIL_LIKE = re.compile(r"[\w.%+-]+ ?(?:@|[\[({] ?at ?[\])}]|\bat\b) ?[\w-]+(?: ?(?:\.|[\[({] ?dot ?[\])}]|\bdot\b) ?[\w-]+)* ?(?:\.|[\[({] ?dot ?[\])}]|\bdot\b) ?[A-Za-z]{2,}", re.I)
IBAN_LIKE = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?")
IBAN_START = re.compile(r"[A-Z]{2}[0-9]{2}")
OCTETS = re.compile(r"([0-9]{1,3})(?: ?\[?\.\]? ?([0-9]{1,3})){3}")
CUES = {"email": {"email", "mail", "contact", "write"}, "ip": {"ip", "host", "server"}, "card": {"card", "visa", "credit", "pan"}, "phone": {"phone", "tel", "call", "mobile", "fax", "telephone", "cell"}, "ssn": {"ssn", "social", "security"}, "iban": {"iban", "account"}}
TLDS = {"com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "eu"}
WINDOW = 60
#: By the number of letters in a segment, three for more.
LETTERS = ("no_letters", "few_letters", "few_letters", "letters")
#: Longer shapes are no feature; separators are alike in them.
MAX_SHAPE = 16
SHAPED = str.maketrans(dict.fromkeys(" .\u2011-", "-"))
#: Segments starting at so many atoms are scored at a time.
BLOCK = 2048


def left_features(text: str, a: int) -> list[str]:
    """What stands before a segment that starts at a."""
    before = text[max(0, a - 24) : a]
    cues = set(re.findall(r"[a-z]+", before.lower())[-3:])
    out = [f"cue:{k}" for k, words in CUES.items() if cues & words]
    if before and not before[-1].isspace() and before[-1] not in "(\"':":
        out.append("joined_left")
    if re.search(r"[0-9][ )-]{0,2}$", before):
        out.append("digits_precede")
    return out


def right_features(text: str, b: int) -> list[str]:
    """What follows a segment that ends at b."""
    out, after = [], text[b : b + 2]
    if after[:1].isalnum() or (len(after) == 2 and after[0] in "-./@_=" and after[1].isalnum()):
        out.append("joined_right")
    if re.match(r" ?[(-]? ?[0-9]", text[b : b + 4]):
        out.append("digits_follow")
    return out


def email_features(s: str) -> list[str]:
    if not EMAIL_LIKE.fullmatch(s):
        return []
    # by its ASCII end: the pattern's folded case takes a long s or a Kelvin sign too
    return ["email_like", "tld" if re.search("[A-Za-z]*$", s)[0].lower() in TLDS else "no_tld"]


def iban_features(s: str) -> list[str]:
    if not IBAN_LIKE.fullmatch(s):
        return []
    moved = (t := s.replace(" ", ""))[4:] + t[:4]
    return ["iban_like", "iban_ok" if int("".join(str(int(c, 36)) for c in moved)) % 97 == 1 else "iban_off"]


def octets(s: str) -> bool:
    return bool(OCTETS.fullmatch(s)) and all(int(x) < 256 for x in re.findall("[0-9]+", s))


def span_features(text: str, a: int, b: int) -> list[str]:
    """Features of text[a:b] as a whole."""
    s = text[a:b]
    d = re.sub("[^0-9]", "", s)
    letters = sum(map(str.isalpha, s))
    out = [f"digits{min(len(d), 20)}", LETTERS[min(letters, 3)]]
    shape = re.sub("[0-9]+", lambda m: str(min(len(m[0]), 9)), s)
    if not letters and len(shape) <= MAX_SHAPE:
        out.append("shape:" + shape.translate(SHAPED))
    out += email_features(s) + iban_features(s)
    if octets(s):
        out.append("octets")
    if 13 <= len(d) <= 19 and not letters:
        out.append("luhn" if luhn(d) else "no_luhn")
    return out + left_features(text, a) + right_features(text, b)


class Atoms:
    """The atoms of text[lo:hi], with running sums by which the digits, letters,
    shape and checksum of any segment are known without reading it again."""

    def __init__(self, text: str, lo: int, hi: int):
        self.text = text
        self.spans = [m.span() for m in ATOM.finditer(text, lo, hi)]
        self.digits = [e - b if text[b] in "0123456789" else 0 for b, e in self.spans]
        self.opens = [text[b].isalnum() or text[b] in "+(" for b, _ in self.spans]
        self.closes = [text[e - 1].isalnum() for _, e in self.spans]
        self.says_at = [text[b] == "@" or (e - b == 2 and text[b:e].lower() == "at") for b, e in self.spans]
        gaps = [text[e:b] for (_, e), (b, _) in zip(self.spans, self.spans[1:])]
        #: No segment spans the gap before such an atom.
        self.parted = [False, *(len(g) > 1 or g == "\n" for g in gaps)]
        pieces = [str(min(n, 9)) if n else text[b:e].translate(SHAPED) for n, (b, e) in zip(self.digits, self.spans)]
        self.shape = "".join(g.translate(SHAPED) + x for g, x in zip(["", *gaps], pieces))
        sums = lambda of: np.concatenate(([0], np.cumsum(of, dtype=np.int64)))
        self.n_digits, self.n_runs, self.n_at = sums(self.digits), sums([n > 0 for n in self.digits]), sums(self.says_at)
        self.n_letters = sums([0 if n else sum(map(str.isalpha, text[b:e])) for n, (b, e) in zip(self.digits, self.spans)])
        self.shape_end = np.cumsum([len(g) + len(x) for g, x in zip(["", *gaps], pieces)], dtype=np.int64)
        self.shape_start = self.shape_end - [len(x) for x in pieces]
        values = np.array([int(c) for n, (b, e) in zip(self.digits, self.spans) if n for c in text[b:e]], np.int64)
        twice = 2 * values - 9 * (values > 4)
        odd = np.arange(len(values)) % 2 == 1
        #: Luhn sums with the digits at even, or odd, places doubled.
        self.luhn = np.stack([sums(np.where(odd, values, twice)), sums(np.where(odd, twice, values))])

    def segments(self, first: int, last: int, max_atoms: int | None) -> list[tuple[int, int]]:
        """(first, last + 1) atoms of each segment that could be an entity and
        starts at one of the atoms first to last - 1."""
        out = []
        digits_of, closes, says_at, parted, spans = self.digits, self.closes, self.says_at, self.parted, self.spans
        for i in range(first, last):
            if not self.opens[i]:
                continue
            digits, spoken = 0, False
            for j in range(i, len(spans) if max_atoms is None else min(i + max_atoms, len(spans))):
                if j > i and parted[j]:
                    break
                if digits_of[j]:
                    digits += digits_of[j]
                    if digits > MAX_DIGITS:
                        break
                elif says_at[j]:
                    spoken = True
                if closes[j] and (7 <= digits or (spoken and EMAIL_LIKE.fullmatch(self.text, spans[i][0], spans[j][1]))):
                    out.append((i, j + 1))
        return out


def candidates(text: str, lo: int, hi: int, max_atoms: int | None = MAX_ATOMS) -> tuple[list, list]:
    """Atoms of text[lo:hi], and (first, last + 1) atoms of each segment that
    could be an entity."""
    atoms = Atoms(text, lo, hi)
    return atoms.spans, atoms.segments(0, len(atoms.spans), max_atoms)


def seeds_of(text: str) -> list[tuple[int, int]]:
    found = [m.span() for m in SEEDS.finditer(text)]
    if "dot" in text.lower():
        found += [m.span() for m in SPOKEN.finditer(text)]
    return sorted(found)


def windows(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Stretches around what could be an entity, without the base spans."""
    walls = [(0, 0), *((a, b) for _, a, b in sorted(spans, key=lambda s: s[1])), (len(text), len(text))]
    found = seeds_of(text)
    if not found:
        return []
    out: list[list[int]] = []
    for a, b in found:  # by their start: what the last window reaches isn't walked again
        a, b = max(0, a - WINDOW), min(len(text), b + WINDOW)
        end = out[-1][1] if out else -1
        if b <= end:
            continue
        while a > end and a and not text[a - 1].isspace():
            a -= 1
        while b < len(text) and not text[b].isspace():
            b += 1
        if a <= end:
            out[-1][1] = b
        else:
            out.append([a, b])
    parts, end, w = [], 0, 0
    for a, b in walls:
        while w < len(out) and out[w][0] < a:
            lo, hi = max(out[w][0], end), min(out[w][1], a)
            if lo < hi:
                parts.append((lo, hi))
            if out[w][1] > a:
                break
            w += 1
        end = max(end, b)
    return parts


def sentences(n: int, seed: int):
    """(text, [(kind, start, end)]): what the model learns from."""
    r = random.Random(seed)
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice(["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "it", "st", "io", "le", "is", "ou", "ar", "as", "de", "rt", "ve"]) for _ in range(r.randint(1, 4)))

    def with_luhn(k):
        d = r.choice("3456") + num(k - 2)
        return next(d + c for c in "0123456789" if luhn(d + c))

    def card():
        d = with_luhn(r.choice((13, 15, 16, 16)))
        return r.choice((d, ".".join(d[i : i + 4] for i in range(0, len(d), 4)), " - ".join(d[i : i + 4] for i in range(0, len(d), 4))))

    def phone():
        a, b, c = r.choice("23456789") + num(2), r.choice("23456789") + num(2), num(4)
        return r.choice((f"{a}-{b}-{c}", f"({a}) {b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"1-{a}-{b}-{c}", f"00{num(2)} {a} {b} {c}", f"0{num(3)} {num(3)} {num(4)}", f"+ 1 {a} {b} {c}"))

    def email():
        who, at, dot = r.choice((word(), word() + num(2), f"{word()}.{word()}")), r.choice((" at ", " (at) ", "(at)", " [at] ", "[at]", " AT ", "@")), r.choice((" dot ", " (dot) ", "(dot)", "[dot]", " [dot] ", " DOT "))
        return f"{who}{at}{word()}{dot}{r.choice(('com', 'org', 'net', 'de', 'fr'))}"

    def iban():
        code, rest = r.choice(("DE", "FR", "ES", "GB", "NL")), num(r.choice((14, 18, 20)))
        check = 98 - int("".join(str(int(c, 36)) for c in rest + code + "00")) % 97
        s = f"{code}{check:02d}{rest}"
        return r.choice((s, " ".join(s[i : i + 4] for i in range(0, len(s), 4))))

    def ip():
        o = [str(r.randint(0, 255)) for _ in range(4)]
        return r.choice(("[.]", " . ", " [.] ")).join(o)

    entity = {"card": card, "phone": phone, "email": email, "iban": iban, "ip": ip, "ssn": lambda: f"{r.randint(100, 899)}{(sep := r.choice('- '))}{num(2)}{sep}{num(4)}"}
    nothing = [lambda: f"Version {r.randint(1, 9)}.{r.randint(0, 9)}", lambda: f"{r.randint(1900, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}", lambda: f"{r.randint(1, 28)}.{r.randint(1, 12)}.{r.randint(1900, 2030)}", lambda: f"${r.randint(1, 999)},{num(3)}.{num(2)}", lambda: num(r.randint(7, 20)), lambda: hashlib.sha1(num(9).encode()).hexdigest(), lambda: "AKIA" + "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)), lambda: f"password={hashlib.sha1(num(9).encode()).hexdigest()[:18]}", lambda: f'token = "{hashlib.sha1(num(9).encode()).hexdigest()}"', lambda: f"{word()} at {word()} dot", lambda: f"{r.randint(1900, 2030)} {r.randint(1900, 2030)} {num(3)}", lambda: f"https://{word()}.com/{num(7)}", lambda: f"{num(4)}.{num(4)}.{num(3)}", lambda: " ".join(num(r.randint(1, 5)) for _ in range(6)), lambda: f"{num(3)},{num(3)},{num(3)}", lambda: f"{r.randint(10, 23)}:{r.randint(10, 59)}:{r.randint(10, 59)} {num(6)}", lambda: f"978-{num(1)}-{num(4)}-{num(4)}-{num(1)}"]
    kinds = list(entity)
    for _ in range(n):
        parts, gold, at = [], [], 0
        for _ in range(r.randint(1, 2)):
            for _ in range(r.randint(2, 5)):
                parts.append(word())
            if r.random() < 0.6:
                kind = r.choice(kinds)
                if r.random() < 0.4:
                    parts.append(r.choice(sorted(CUES[kind])) + r.choice(("", ":")))
                at = len(" ".join(parts)) + 1
                parts.append(x := entity[kind]())
                gold.append((kind, at, at + len(x)))
            else:
                parts.append(r.choice(nothing)())
        parts += [word(), word() + "."]
        yield " ".join(parts), gold


class Model:
    """Weights of each (kind, feature); what wasn't seen in training weighs as
    little as `unseen`, which keeps strange segments out."""

    unseen = -2.0

    def __init__(self, weights: dict[tuple[str, str], float]):
        #: Ties go to the last kind by name.
        self.kinds = sorted(KINDS, reverse=True)
        self.bias = np.array([weights.get((k, "bias"), 0.0) for k in self.kinds])
        self.rows = {f: np.array([weights.get((k, f), 0.0) for k in self.kinds]) for f in {f for _, f in weights}}

    def sums(self, features: list[str]) -> np.ndarray:
        """What features weigh for each of self.kinds."""
        out = np.zeros(len(KINDS))
        for f in features:
            out += self.rows.get(f, self.unseen)
        return out

    def score(self, features: list[str]) -> tuple[float, str]:
        """The best kind of a segment and its score."""
        sums = self.sums(features) + self.bias
        return float(sums.max()), self.kinds[int(sums.argmax())]

    def scores(self, atoms: Atoms, segments: list[tuple[int, int]]) -> np.ndarray:
        """For each segment what span_features weigh for each of self.kinds. What
        stands before and after is looked at once an atom, digits and letters
        are differences of running sums, and the patterns are tried only where
        a segment's counts allow a match."""
        text, spans = atoms.text, atoms.spans
        i, j = np.array(segments, np.int64).T
        digits, letters = atoms.n_digits[j] - atoms.n_digits[i], atoms.n_letters[j] - atoms.n_letters[i]
        total = self.bias + np.stack([self.sums([f"digits{n}"]) for n in range(21)])[np.minimum(digits, 20)]
        total += np.stack([self.sums([x]) for x in LETTERS])[np.minimum(letters, 3)]
        starts, at = np.unique(i, return_inverse=True)
        total += np.stack([self.sums(left_features(text, spans[k][0])) for k in starts.tolist()])[at]
        stops, at = np.unique(j, return_inverse=True)
        total += np.stack([self.sums(right_features(text, spans[k - 1][1])) for k in stops.tolist()])[at]
        bare = letters == 0
        begin, end = atoms.shape_start[i], atoms.shape_end[j - 1]
        if len(at := np.flatnonzero(bare & (end - begin <= MAX_SHAPE))):
            strange = np.full(len(KINDS), self.unseen)
            total[at] += np.stack([self.rows.get("shape:" + atoms.shape[a:b], strange) for a, b in zip(begin[at].tolist(), end[at].tolist())])
        if len(at := np.flatnonzero(bare & (digits >= 13) & (digits <= 19))):
            low, high = atoms.n_digits[i[at]], atoms.n_digits[j[at]]
            doubled = high % 2  # the last digit, at place high - 1, isn't doubled
            off = (atoms.luhn[doubled, high] - atoms.luhn[doubled, low]) % 10 > 0
            total[at] += np.stack([self.sums(["luhn"]), self.sums(["no_luhn"])])[off.astype(int)]
        capital = np.array([IBAN_START.match(text, spans[k][0]) is not None for k in starts.tolist()])[np.searchsorted(starts, i)]
        tried = (
            ((atoms.n_at[j] > atoms.n_at[i]) & ~bare, email_features),
            (capital, iban_features),
            (bare & (atoms.n_runs[j] - atoms.n_runs[i] == 4) & (digits <= 12), lambda s: ["octets"] * octets(s)),
        )
        for where, features in tried:
            for k in np.flatnonzero(where).tolist():
                if found := features(text[spans[i[k]][0] : spans[j[k] - 1][1]]):
                    total[k] += self.sums(found)
        return total

    def spans(self, text: str, lo: int, hi: int, max_atoms: int | None = MAX_ATOMS) -> list[tuple[str, int, int]]:
        """Viterbi over segments; a tie goes to fewer entities."""
        atoms = Atoms(text, lo, hi)
        n = len(atoms.spans)
        ends: dict[int, list] = {}
        for first in range(0, n, BLOCK):
            if not (segments := atoms.segments(first, min(first + BLOCK, n), max_atoms)):
                continue
            scores = self.scores(atoms, segments)
            values, kinds = scores.max(axis=1), scores.argmax(axis=1)
            for k in np.flatnonzero(values > 0).tolist():
                i, j = segments[k]
                ends.setdefault(j, []).append((float(values[k]), i, self.kinds[kinds[k]]))
        if not ends:
            return []
        best, back = [0.0], [None]
        for j in range(1, n + 1):
            value, step = best[j - 1], None
            for own, i, kind in ends.get(j, ()):
                if best[i] + own > value:
                    value, step = best[i] + own, (i, kind)
            best.append(value)
            back.append(step)
        out, j = [], n
        while j:
            if back[j]:
                i, kind = back[j]
                out.append((kind, atoms.spans[i][0], atoms.spans[j - 1][1]))
                j = i
            else:
                j -= 1
        return out[::-1]


def log_sum(a: float, more: list[float]) -> float:
    if not more:
        return a
    top = max(a, *more)
    return top + math.log(math.exp(a - top) + sum(math.exp(v - top) for v in more))


@lru_cache
def trained(examples: int = EXAMPLES, epochs: int = EPOCHS, seed: int = SEED, rate: float = 0.3, decay: float = 1e-3) -> Model:
    """Full-batch gradient ascent with momentum on the conditional likelihood."""
    names: dict[str, int] = {"bias": 0}
    data = []
    for text, gold in sentences(examples, seed):
        atoms, cand = candidates(text, 0, len(text))
        feats = [[0, *(names.setdefault(f, len(names)) for f in span_features(text, atoms[i][0], atoms[j - 1][1]))] for i, j in cand]
        true = {(a, b): KINDS.index(k) for k, a, b in gold}
        at = [true.get((atoms[i][0], atoms[j - 1][1]), -1) for i, j in cand]
        if cand:
            data.append((len(atoms), cand, feats, at))
    # one row for each candidate segment of all windows
    first = np.cumsum([0, *(len(cand) for _, cand, _, _ in data)])
    x = np.zeros((first[-1], len(names)), np.float32)
    gold = np.zeros((first[-1], len(KINDS)), np.float32)
    for row, f, at in ((first[w] + s, f, at) for w, (_, _, feats, gold_at) in enumerate(data) for s, (f, at) in enumerate(zip(feats, gold_at))):
        x[row, f] = 1
        if at >= 0:
            gold[row, at] = 1
    weights = np.zeros((len(KINDS), len(names)), np.float32)
    speed = np.zeros_like(weights)
    shapes = [(n, cand) for n, cand, _, _ in data]
    for _ in range(epochs):
        speed = 0.8 * speed + rate * (likelihood(x, gold, shapes, weights)[1] / len(data) * 10 - decay * weights)
        weights += speed
    return Model({(k, f): float(weights[y, c]) for y, k in enumerate(KINDS) for f, c in names.items()})


def likelihood(x: np.ndarray, gold: np.ndarray, shapes: list, weights: np.ndarray) -> tuple[float, np.ndarray]:
    """Log likelihood of the gold segments of all windows, and its gradient. x and
    gold have a row for each candidate segment; shapes: (atoms, segments) of each
    window. Forward and backward sums over all segmentations."""
    scores = x @ weights.T
    total = np.logaddexp.reduce(scores, axis=1)
    within, value, first = np.empty(len(x), scores.dtype), float((gold * scores).sum()), 0
    for n, cand in shapes:
        own = total[first : first + len(cand)].tolist()
        fore, back = [0.0] + [-np.inf] * n, [-np.inf] * n + [0.0]
        ends, starts = [[] for _ in range(n + 1)], [[] for _ in range(n + 1)]
        for (i, j), v in zip(cand, own):
            ends[j].append((i, v))
            starts[i].append((j, v))
        for j in range(1, n + 1):
            fore[j] = log_sum(fore[j - 1], [fore[i] + v for i, v in ends[j]])
        for i in range(n - 1, -1, -1):
            back[i] = log_sum(back[i + 1], [back[j] + v for j, v in starts[i]])
        within[first : first + len(cand)] = [fore[i] + back[j] - fore[n] for i, j in cand]
        value -= fore[n]
        first += len(cand)
    return value, (gold - np.exp(scores + within[:, None])).T @ x


def all_spans(text: str, model: Model, max_atoms: int | None = MAX_ATOMS) -> tuple[list, list]:
    """(base spans, all spans), by start, then kind as in KINDS."""
    base = base_spans(text)
    more = [s for lo, hi in windows(text, base) for s in model.spans(text, lo, hi, max_atoms)]
    return base, sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0]), s[2])) if more else base


def written_out(spans: list) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def pii_spans(docs: DataFrame, examples: int = EXAMPLES, max_atoms: int | None = MAX_ATOMS) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans)."""
    model = trained(examples)

    def make():
        def each(doc_id, text):
            base, spans = all_spans(text or "", model, max_atoms)
            kinds = [k for k, _, _ in base]
            return doc_id, *(kinds.count(k) for k in BASE), hashlib.sha256(written_out(base).encode()).hexdigest(), written_out(spans)

        return each

    return map_rows(docs, ["doc_id", "text"], "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string", make)


def redacted(docs: DataFrame, examples: int = EXAMPLES, max_atoms: int | None = MAX_ATOMS) -> DataFrame:
    """docs with each span's text replaced by its kind in brackets, n_chars
    after it; spans that overlap are replaced as one, by the first's kind."""
    model = trained(examples)
    rest = [c for c in docs.columns if c not in ("text", "n_chars")]

    def make():
        def each(text, *others):
            if text is None:
                return *others, None, None
            out, end = [], 0
            for kind, a, b in all_spans(text, model, max_atoms)[1]:
                if a >= end:
                    out += [text[end:a], f"[{kind.upper()}]"]
                end = max(end, b)
            text = "".join([*out, text[end:]])
            return *others, text, len(text)

        return each

    fields = [docs.schema[c] for c in rest] + [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    return map_rows(docs, ["text", *rest], T.StructType(fields), make).select(*docs.columns)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
