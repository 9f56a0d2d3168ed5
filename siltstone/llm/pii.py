"""Operator 12: personal data by a linear-chain conditional random field over word shapes, beside fixed base patterns.

Base patterns find addresses, IP numbers, card and phone numbers in their usual spelling, the leftmost first, in time that
grows with the text; what fails its check is dropped. The field labels words (O, or begin and inside of each kind) by
their shapes and those of their neighbours and finds other spellings: `name at host dot org`, `10[.]0[.]0[.]1`, `(030)
1234 5678`. It reads the words within RADIUS of a trigger (a digit, an @ or a word for it in brackets, a word for a dot); all others are
O by the rules of the model. A labelled stretch becomes a span if it passes the exact check of its kind and shares no
place with a base span; base spans always stay.

Training: the log likelihood with a weak L2 prior, gradients by scaled forward-backward sums, Adam, in numpy on the driver,
over at most `most` rows of a table (text, spans); `examples` makes a small one from patterns with seeded fillings.
Decoding: Viterbi over all stretches of a batch that have one length, side by side. Stretches of more than WINDOW words are
decoded in windows that overlap by twice MARGIN; a word takes its label from the window in which it lies further inside.

Defined cases: null and empty texts have no span; places are code points of the whole text, ends exclusive; repeated rows
are each read; an empty table gives an empty one; a column with the name of the result is replaced, all others are carried.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.shared import WORD
from siltstone.sources.tables import table

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{part}-{kind}" for kind in KINDS for part in "BI"))
#: Words on either side of a trigger that are labelled; words of a window, and those that its neighbours label at its ends.
RADIUS, WINDOW, MARGIN = 6, 256, 32
#: Texts of the training table that a feature must occur in; step of Adam.
LEAST_SEEN, RATE = 2, 0.1
SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])

WORDS = re.compile(WORD)
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
CHAIN = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
AT_WORDS, DOT_WORDS = "at|arobase|arroba|klammeraffe", "dot|punkt|point|punto"
TRIGGER = re.compile(rf"[0-9@]|[\[({{<]\s?(?:{AT_WORDS})\s?[\])}}>]|(?<![^\W_])(?:{DOT_WORDS})(?![^\W_])", re.I)


def luhn(digits: str) -> bool:
    """Whether the check digit of a card number fits."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def octets(parts: list[str]) -> bool:
    """Whether all parts (digits) are at most 255."""
    return all(len(x := p.lstrip("0")) <= 3 and int(x or "0") <= 255 for p in parts)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, by start, then kind."""
    found = []
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            end = m.end()
            found.append((start, end, "email"))
        at = text.find("@", max(at + 1, end))
    for m in CHAIN.finditer(text):
        parts = m.group().split(".")
        start = m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            length = sum(map(len, four)) + 3
            if octets(four):
                found.append((start, start + length, "ip"))
            start += length + 1
    for pattern, kind, least, most in ((CARD, "card", 14, 19), (PHONE, "phone", 10, 15)):
        for m in pattern.finditer(text):
            digits = digits_of(m.group())
            if least <= len(digits) <= most and (kind == "phone" or luhn(digits)):
                found.append((m.start(), m.end(), kind))
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


# exact checks of spellings that the base patterns do not have

_OPEN, _CLOSE = r"\s*[\[({<]\s*", r"\s*[\])}>]\s*"
_SPELLED = rf"(?:{_OPEN}(?:\.|{DOT_WORDS}){_CLOSE}|\s+(?:{DOT_WORDS})\s+)"
SPELLED = re.compile(_SPELLED, re.I)
EMAIL = re.compile(rf"[a-z0-9._%+-]+(?:{_OPEN}(?:@|{AT_WORDS}){_CLOSE}|\s*@\s*|(?P<word>\s+(?:{AT_WORDS})\s+))(?P<host>[a-z0-9-]+(?:(?:\.|{_SPELLED})[a-z0-9-]+)*(?:\.|{_SPELLED})[a-z]{{2,}})", re.I)
IP_GAP = rf"(?:{_SPELLED}|\s+\.\s+)"
IP = re.compile(rf"[0-9]{{1,3}}(?:{IP_GAP}[0-9]{{1,3}}){{3}}", re.I)
CARD_GROUPS = re.compile(r"[0-9]{3,7}(?:(?:[\s\xA0]{1,3}|[\s\xA0]?[./_‐-—-][\s\xA0]?)[0-9]{3,7}){2,4}")
PHONE_GROUPS = re.compile(r"(?:\([0-9]{2,5}\)|0[0-9]{1,6}|[0-9]{3}(?=[-. ][0-9]{3}[-. ][0-9]{4}\Z))(?:[\s./()-]{1,3}[0-9]{1,8}){1,5}")


def passes(kind: str, text: str) -> bool:
    """Whether a labelled stretch is of its kind."""
    digits = digits_of(text)
    if kind == "email":
        m = EMAIL.fullmatch(text)
        return bool(m) and (m["word"] is None or bool(SPELLED.search(m["host"])))
    if kind == "ip":
        return bool(IP.fullmatch(text)) and octets(re.findall("[0-9]+", text))
    if kind == "card":
        return bool(CARD_GROUPS.fullmatch(text)) and 14 <= len(digits) <= 19 and luhn(digits)
    return bool(PHONE_GROUPS.fullmatch(text)) and 10 <= len(digits) <= 15


def trimmed(kind: str, text: str, start: int, end: int) -> tuple[int, int]:
    """The stretch without marks at its ends that are no part of its kind."""
    first = LOCAL if kind == "email" else frozenset("0123456789(") if kind == "phone" else frozenset("0123456789")
    last = LOCAL - frozenset(".%+-") if kind == "email" else frozenset("0123456789")
    while start < end and text[start] not in first:
        start += 1
    while end > start and text[end - 1] not in last:
        end -= 1
    return start, end


# features

PIECES = re.compile(r"[0-9]+|[^\W\d_]+|.", re.S)
SIZES = ("", "1", "2", "3", "4", "5", *["6-9"] * 4, *["10-13"] * 4, *["14-19"] * 6)
MARKS = {w: name for name, group in (("<at>", AT_WORDS), ("<dot>", DOT_WORDS)) for w in group.split("|")}


def shape(word: str) -> str:
    """Runs of digits with their length and whether a zero leads, of letters without, words for @ and dot, and all other characters."""
    out = []
    for piece in PIECES.findall(word[:80]):
        if "0" <= piece[0] <= "9":
            out.append("d" + "z" * (piece[0] == "0") + (SIZES[len(piece)] if len(piece) < len(SIZES) else "20"))
        elif len(piece) > 1 or piece.isalpha():
            out.append(MARKS.get(piece.lower(), "a"))
        else:
            out.append(piece if piece.isascii() else "?")
    return "".join(out)


def coarse(of: str) -> str:
    """The kinds of signs in a shape."""
    bare = of.rstrip(".,;:!?")
    if bare in ("a", "<at>", "<dot>"):
        return bare
    signs = ["@" if "@" in of or "<at>" in of else "", "<dot>" if "<dot>" in of else "", "d" if "d" in of else "", "a" if "a" in of.replace("<at>", "") else "", "." if "." in bare else ""]
    return "".join(signs) or "-"


PLAIN = re.compile(r"dz?[0-9-]+")


class Shapes(dict):
    """(shape, coarse shape, shape without lengths and marks at the end) of words, kept while there are few enough."""

    def __missing__(self, word: str) -> tuple[str, str, str]:
        if len(self) > 200_000:
            self.clear()
        s = shape(word)
        self[word] = out = (s, coarse(s), PLAIN.sub("d", s.rstrip(".,;:!?")))
        return out


def features(words: list[str], shapes: Shapes) -> list[tuple[str, ...]]:
    """The features of each word of a stretch."""
    told = [("", "", "")] * 2 + [shapes[w] for w in words] + [("", "", "")] * 2
    lower = ["", ""] + [w.lower().strip(".,:;()#") for w in words]
    out = []
    for i in range(2, len(told) - 2):
        (a, ca, _), (b, cb, plain), (c, cc, _) = told[i - 1 : i + 2]
        out.append((f"0{b}", f"1{a}", f"2{c}", f"3{ca}|{cb}", f"4{cb}|{cc}", f"5{told[i - 2][1]}|{ca}|{cb}", f"6{cb}|{cc}|{told[i + 2][1]}", f"7{plain}", f"8{lower[i - 1]}", f"9{lower[i - 2]}"))
    return out


# the field

ALLOWED = np.array([[b % 2 == 1 or b == 0 or (a and (a - 1) // 2 == (b - 1) // 2) for b in range(len(LABELS))] for a in range(len(LABELS))])
FIRST = np.array([b == 0 or b % 2 == 1 for b in range(len(LABELS))])


def sums(scores: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """log Z of each of the label scores (number, time, labels), the labels' marginals, and the expected number of moves."""
    n, steps, _ = scores.shape
    top = scores.max(axis=2, keepdims=True)
    e, m = np.exp(scores - top), np.exp(moves) * ALLOWED
    forward, scale = np.empty_like(e), np.empty((n, steps))
    for t in range(steps):
        x = e[:, t] * (FIRST if t == 0 else forward[:, t - 1] @ m)
        scale[:, t] = x.sum(axis=1)
        forward[:, t] = x / scale[:, t, None]
    backward, expected = np.ones_like(e), np.zeros_like(m)
    for t in range(steps - 2, -1, -1):
        x = e[:, t + 1] * backward[:, t + 1] / scale[:, t + 1, None]
        expected += m * (forward[:, t].T @ x)
        backward[:, t] = x @ m.T
    return np.log(scale).sum(axis=1) + top[:, :, 0].sum(axis=1), forward * backward, expected


def viterbi(scores: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The best labels (number, time) for label scores (number, time, labels); of equal paths the one with smaller labels at
    its end."""
    n, steps, _ = scores.shape
    allowed = np.where(ALLOWED, moves, -np.inf)
    best, came = np.where(FIRST, scores[:, 0], -np.inf), np.zeros(scores.shape, np.int8)
    for t in range(1, steps):
        x = best[:, :, None] + allowed
        came[:, t] = x.argmax(axis=1)
        best = x.max(axis=1) + scores[:, t]
    out = np.empty((n, steps), np.int8)
    out[:, -1] = best.argmax(axis=1)
    for t in range(steps - 1, 0, -1):
        out[:, t - 1] = came[np.arange(n), t, out[:, t]]
    return out


def stretches_of(words: list[tuple[int, int]], triggers: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges [from, to) of words within RADIUS of a trigger (numbers of words, rising)."""
    lo = hi = None
    for i in triggers:
        if hi is not None and i - RADIUS <= hi:
            hi = i + RADIUS + 1
            continue
        if hi is not None:
            yield max(0, lo), min(hi, len(words))
        lo, hi = i - RADIUS, i + RADIUS + 1
    if hi is not None:
        yield max(0, lo), min(hi, len(words))


def windows_of(lo: int, hi: int) -> Iterator[tuple[int, int, int, int]]:
    """(from, to, first, last): windows of a range of words, and the range that each labels."""
    if hi - lo <= WINDOW:
        yield lo, hi, lo, hi
        return
    inner = WINDOW - 2 * MARGIN
    for at in range(lo, hi, inner):
        yield max(lo, at - MARGIN), min(hi, at + inner + MARGIN), at, min(hi, at + inner)


def cut(text: str) -> tuple[list[tuple[int, int]], list[tuple[int, int, int, int]]]:
    """The words of a text and the windows that are to be labelled; none of either without a trigger."""
    if not TRIGGER.search(text):
        return [], []
    words = [m.span() for m in WORDS.finditer(text)]
    starts = [s for s, _ in words]
    triggers = sorted({bisect_right(starts, m.start()) - 1 for m in TRIGGER.finditer(text)})
    return words, [w for lo, hi in stretches_of(words, triggers) for w in windows_of(lo, hi)]


class Field:
    """A trained field: numbers of the features, weights (features + 1, labels) whose last row is 0, and scores of moves."""

    def __init__(self, numbers: dict[str, int], weights: np.ndarray, moves: np.ndarray):
        self.numbers, self.weights, self.moves = numbers, weights, moves

    def rows(self, words: list[str], shapes: Shapes) -> list[list[int]]:
        """The features' numbers of each word of a stretch."""
        unknown, get = len(self.numbers), self.numbers.get
        return [[get(f, unknown) for f in fs] for fs in features(words, shapes)]

    def label(self, stretches: list[list[str]], shapes: Shapes) -> list[np.ndarray]:
        """The labels of each stretch of words; those of one length go through Viterbi together."""
        out: list[np.ndarray] = [np.zeros(0, np.int8)] * len(stretches)
        by_length: dict[int, list[int]] = {}
        for i, words in enumerate(stretches):
            by_length.setdefault(len(words), []).append(i)
        for length, which in by_length.items():
            step = max(1, (1 << 16) // length)
            for at in range(0, len(which), step):
                part = which[at : at + step]
                scores = self.weights[np.array([self.rows(stretches[i], shapes) for i in part])].sum(axis=2)
                for i, labels in zip(part, viterbi(scores, self.moves)):
                    out[i] = labels
        return out


def labels_of(words: list[tuple[int, int]], spans: list[tuple[int, int, str]]) -> list[int]:
    """The label of each word: begin or inside of the span that it shares a place with."""
    out = [0] * len(words)
    for start, end, kind in spans:
        inside = [i for i, (s, e) in enumerate(words) if s < end and e > start]
        for i in inside:
            out[i] = LABELS.index(("B-" if i == inside[0] else "I-") + kind)
    return out


def train(rows: list[tuple[str, list[tuple[int, int, str]]]], steps: int = 120, prior: float = 0.02) -> Field:
    """The field fitted to texts with their spans; the same rows give the same field."""
    shapes, seen, read, groups = Shapes(), Counter(), [], {}
    for text, spans in rows:
        if words := [m.span() for m in WORDS.finditer(text)]:
            read.append((features([text[s:e] for s, e in words], shapes), labels_of(words, spans)))
            seen.update({f for fs in read[-1][0] for f in fs})
    numbers = {f: i for i, f in enumerate(f for f, n in seen.items() if n >= LEAST_SEEN)}
    for told, labels in read:
        groups.setdefault(len(told), []).append(([[numbers.get(f, len(numbers)) for f in fs] for fs in told], labels))
    weights, moves = np.zeros((len(numbers) + 1, len(LABELS))), np.zeros((len(LABELS), len(LABELS)))
    batches = [(np.array([x for x, _ in g]), np.array([y for _, y in g])) for g in groups.values()]
    n = max(1, sum(y.size for _, y in batches))
    first, second = [[np.zeros_like(weights), np.zeros_like(moves)] for _ in range(2)]
    for i in range(1, steps + 1):
        gw, gm = prior * weights / n, prior * moves / n
        for x, y in batches:
            _, marginals, expected = sums(weights[x].sum(axis=2), moves)
            np.subtract.at(marginals, (np.arange(len(y))[:, None], np.arange(y.shape[1])[None], y), 1)
            for slot in range(x.shape[2]):
                at = x[:, :, slot].ravel()
                for label in range(len(LABELS)):
                    gw[:, label] += np.bincount(at, marginals[:, :, label].ravel(), len(gw)) / n
            np.subtract.at(expected, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
            gm += expected / n
        for k, (p, g) in enumerate(((weights, gw), (moves, gm))):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            p -= RATE * (first[k] / (1 - 0.9**i)) / (np.sqrt(second[k] / (1 - 0.99**i)) + 1e-8)
        weights[-1] = 0
    return Field(numbers, weights, moves * ALLOWED)


# the labelled table

#: {x} is filled in by a rule of `examples`; what stands between two | after its kind is personal data.
PATTERNS = (
    "{t} email|{n} at {h} dot {d}| {t}", "{t} email|{n} AT {h} DOT {d}| {t}", "{t} email|{n} (at) {h} (dot) {d}|. {t}", "write email|{n}[at]{h}[dot]{d}| {t}", "{t} email|{n}(at){h}.{d}|, {t}",
    "{t} email|{n} at {h} dot {h} dot {d}| {t}", "{t} email|{n} [at] {h}.{d}| {t}", "{t} email|{n} @ {h}.{d}|. {t}", "{t} email|{n}.{n} at {h} punkt {d}| {t}", "{t} email|{n}@{h}.{d}| {t}", "{t} email|{n} arobase {h} point {d}| {t}",
    "{t} ip|{o}[.]{o}[.]{o}[.]{o}| {t}", "{t} ip|{o}(.){o}(.){o}(.){o}|, {t}", "{t} ip|{o} dot {o} dot {o} dot {o}| {t}", "{t} ip|{o} . {o} . {o} . {o}| {t}", "{t} ip|{o}.{o}.{o}.{o}| {t}", "host ip|{o}[dot]{o}[dot]{o}[dot]{o}|; {t}",
    "{t} card|{c.}| {t}", "{t} card|{c/}|. {t}", "{t} card|{c_}| {t}", "{t} card|{c - }| {t}", "card card|{c  }|, {t}", "{t} card|{c}| {t}", "{t} card|{c }| {t}",
    "{t} phone|({3}) {3}-{4}| {t}", "{t} phone|({3}) {3} {4}|. {t}", "{t} phone|{3}-{3}-{4}| {t}", "call phone|{3}.{3}.{4}|, {t}", "{t} phone|0{2} {4} {4}| {t}", "{t} phone|0{3}/{7}| {t}", "tel phone|0049 {2} {7}| {t}",
    "{t} phone|(0{2}) {4} {4}| {t}", "{t} phone|+{2} {2} {7}| {t}", "{t} phone|+1 ({3}) {3}-{4}| {t}", "{t} phone|0{1} {2} {2} {2} {2}| {t}", "{t} phone|0{3}-{4} {3}|. {t}",
    "{t}", "{t} at {t}", "{t} at the {h} dot {t}", "meet at {h}. Then {t}", "{t} {4}-{2}-{2} {t}", "{t} {2}.{2}.{4} {2}:{2} {t}", "version {1}.{1}.{2} {t}", "{t} {1}.{1}. {t}", "ISBN {3}-{1}-{2}-{6}-{1} {t}",
    "{t} order {10} {t}", "{t} {7} {t} {3}", "{t} {2} {2} {2} {2} {t}", "pages {2}-{3} {t}", "{t} {1} {2} {3} {4} {t}", "{t} password={n}{5}{n}{2} {t}", "key {N}{2}{N}{1}{N} {t}", '{t} "{n}{4}{n}{8}{n}" {t}', "{t} {2},{3}.{2} EUR {t}",
    "{t} {6} {6} {6} {t}", "{t} {4} {4} {t}", "on {1}/{1}/{4} at {2}:{2} {t}", "{t} {o} , {o} , {o} , {o} {t}", "{t} point {t} {3} {t}", "{t} {3}-{4} {t}", "{t} ({4}) {t}", "{t} {12} {t}", "{t} @{n} {t}", "# {4}.{4} {t}",
)


def examples(number: int = 500, seed: int = 12) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """`number` texts with their spans (start, end, kind), made from the patterns in turn."""
    rnd = random.Random(seed)
    letters, capitals = "abcdefghijklmnopqrstuvwxyzéñü", "ABCDEFGHJKLMNPQRSTUVWXYZ"

    def word(of: str, least: int, most: int) -> str:
        return "".join(rnd.choices(of, k=rnd.randint(least, most)))

    def filled(rule: str) -> str:
        if rule == "t":
            return " ".join((rnd.choice(("at", "the", "de", "point")) if rnd.random() < 0.08 else word(letters, 1, 9)) + rnd.choice(("", "", "", "", ".", ",")) for _ in range(rnd.randint(1, 7)))
        if rule in "nhd":
            return word(letters[:26], 2, 3) if rule == "d" else word(letters[:26], 2, 9)
        if rule == "N":
            return word(capitals, 2, 5)
        if rule == "o":
            return str(rnd.randint(0, 255))
        if rule[0] == "c":
            digits = word("0123456789", 15, 15)
            digits += next(d for d in "0123456789" if luhn(digits + d))
            return rule[1:].join(digits[i : i + 4] for i in range(0, 16, 4))
        return word("0123456789", int(rule), int(rule))

    out = []
    for i in range(number):
        text, spans = "", []
        for k, part in enumerate(PATTERNS[i % len(PATTERNS)].split("|")):
            part = re.sub(r"\{([^}]*)\}", lambda m: filled(m[1]), part)
            if k % 2:
                kind = next(x for x in KINDS if text.endswith(x))
                text = text.removesuffix(kind)
                spans.append((len(text), len(text) + len(part), kind))
            text += part
        out.append((text, spans))
    return out


LABELLED = "text string, spans array<struct<start:long,end:long,kind:string>>"


def labelled_table(spark: SparkSession, number: int = 500, seed: int = 12) -> DataFrame:
    """The examples as a table (text, spans)."""
    return spark.createDataFrame(examples(number, seed), LABELLED)


def fit(labelled: DataFrame, most: int = 2000) -> Field:
    """The field from a small labelled table (text, spans); of more than `most` rows those with the smallest hashes count."""
    rows = labelled.select("text", "spans").filter("text IS NOT NULL").orderBy(F.xxhash64("text"), "text").limit(most).collect()
    return train([(r.text, [(s.start, s.end, s.kind) for s in r.spans or []]) for r in rows])


def all_spans(texts: list[str | None], field: Field, shapes: Shapes) -> list[list[dict]]:
    """The spans of each text: those of the base patterns and, where they leave room, the field's that pass their check."""
    held, stretches = [], []
    for text in texts:
        words, windows = cut(text or "")
        held.append((words, windows))
        stretches += [[text[s:e] for s, e in words[lo:hi]] for lo, hi, _, _ in windows]
    labels = iter(field.label(stretches, shapes))
    out = []
    for text, (words, windows) in zip(texts, held):
        base = base_spans(text) if windows else []
        taken, ends = [s for s, _, _ in base], list(accumulate((e for _, e, _ in base), max))
        found = [(s, e, kind, True) for s, e, kind in base]
        told: dict[int, int] = {}
        for lo, _, first, last in windows:
            of = next(labels)
            told.update((i, int(of[i - lo])) for i in range(first, last) if of[i - lo])
        at = sorted(told)
        k = 0
        while k < len(at):
            end = k + 1
            while end < len(at) and at[end] == at[end - 1] + 1 and told[at[end]] and told[at[end]] % 2 == 0 and (told[at[end]] - 1) // 2 == (told[at[k]] - 1) // 2:
                end += 1
            kind = KINDS[(told[at[k]] - 1) // 2]
            s, e = trimmed(kind, text, words[at[k]][0], words[at[end - 1]][1])
            if s < e and passes(kind, text[s:e]):
                i = bisect_right(taken, s)
                if (i == 0 or ends[i - 1] <= s) and (i == len(taken) or taken[i] >= e):
                    found.append((s, e, kind, False))
            k = end
        found.sort(key=lambda x: (x[0], KINDS.index(x[2])))
        out.append([{"kind": kind, "start": s, "end": e, "base": b} for s, e, kind, b in found])
    return out


def find_private(docs: DataFrame, field: Field, text: str = "text", spans: str = "spans") -> DataFrame:
    """`docs` with all spans (kind, start, end, base) of the text, by start, then kind. Nothing is shuffled."""
    rest = docs.drop(*[c for c in (spans,) if c != text])
    schema = rest.drop(text).withColumn(text, F.lit(None).cast("string")).withColumn(spans, F.lit(None).cast("array<struct<kind:string,start:long,end:long,base:boolean>>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = Shapes()
        for batch in batches:
            found = []
            texts = batch.column(text)
            for i in range(0, len(texts), 256):
                found += all_spans(texts[i : i + 256].to_pylist(), field, shapes)
            columns = {name: batch.column(name) for name in batch.schema.names if name != text}
            yield pa.RecordBatch.from_pydict(columns | {text: texts, spans: pa.array(found, pa.list_(SPAN))})

    return rest.mapInArrow(run, schema).select(*rest.columns, spans)


def joined_spans(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat(s["kind"], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def number_of(spans: str, kind: str) -> Column:
    """How many of the spans are of a kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def op12_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in all documents: numbers by kind and a digest of the base patterns' spans, and all spans."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    told = find_private(docs, fit(labelled_table(spark))).withColumn("base", F.filter("spans", lambda s: s["base"]))
    counts = [number_of("base", kind).alias(f"n_{kind}") for kind in KINDS]
    return told.select("doc_id", *counts, F.sha2(joined_spans(F.col("base")), 256).alias("base_sha256"), joined_spans(F.col("spans")).alias("spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_added"))


QUERIES = {"op12_private_data": op12_private_data}
ORACLES: dict[str, str] = {}
