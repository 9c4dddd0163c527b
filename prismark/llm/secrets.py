"""Secret scans: fixed patterns, and guess costs of values in credential contexts."""

from __future__ import annotations

import json
import math
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import cache

import ahocorasick
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismark.llm.common import add_columns, as_texts, field, table

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # with the greedy run: the runs of 32 and more
#: What names a credential besides the words of ASSIGN; the value follows after : or =, or after "is".
CONTEXT = re.compile(r"(?ai:(?<![a-z])(?:pass(?:word|wd|phrase|code)|pwd|pin|secret|token|api[_-]?key|credentials?|auth(?:orization)?|bearer|login|private[_-]?key))[\"']?(?:\x20*[:=]>?\x20*|\x20+(?i:is)\x20+)[\"']?([^\s\"'<>,;]{6,})")
HINTS = ("pass", "pwd", "pin", "secret", "token", "key", "credential", "auth", "bearer", "login")

ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
LEET = str.maketrans("013457@$!", "oleastasi")
_MONTH, _DAY, _SEP = "(?:0[1-9]|1[0-2])", "(?:0[1-9]|[12][0-9]|3[01])", "[-/.]?"
#: Pattern of a date and how many there are of it, in the two centuries that start with 19 and 20. Each has one length at most at a place.
DATES = tuple((re.compile(p), n) for p, n in (
    ("(?:19|20)[0-9]{2}", 200),
    (f"(?:19|20)[0-9]{{2}}{_SEP}{_MONTH}", 200 * 12),
    (f"(?:19|20)[0-9]{{2}}{_SEP}{_MONTH}{_SEP}{_DAY}", 200 * 365),
    (f"{_DAY}{_SEP}{_MONTH}{_SEP}(?:19|20)[0-9]{{2}}", 200 * 365),
))
#: Words that passwords are made of before all others (fixed values, most frequent first).
COMMON = "password 123456 qwerty admin welcome login letmein monkey dragon master secret changeme default test user root guest pass hello sunshine shadow princess football baseball superman example sample dummy placeholder your token key".split()
#: log10 of what a choice between kinds, of a letter for a digit, and of a turn of a walk costs.
CHOICE, SPELT, TURN = math.log10(2), math.log10(4), math.log10(4)
REPEAT, WALK, SEQUENCE = 3, 4, 3  # the least characters of each


def _near() -> dict[str, set[str]]:
    """Neighbours on a keyboard: beside each other in a row, or across rows at the same or the next place."""
    out: dict[str, set[str]] = {}
    for r, row in enumerate(ROWS):
        for i, c in enumerate(row):
            near = {row[j] for j in (i - 1, i + 1) if 0 <= j < len(row)}
            for other, shift in ((r - 1, (0, 1)), (r + 1, (-1, 0))):
                if 0 <= other < len(ROWS):
                    near |= {ROWS[other][i + s] for s in shift if 0 <= i + s < len(ROWS[other])}
            out[c] = near
    return out


NEAR = _near()
PLACE = {c: (r, i) for r, row in enumerate(ROWS) for i, c in enumerate(row)}


class Words:
    """A dictionary by rank, and an automaton that names all its words that end at each place of a string."""

    def __init__(self, rank: dict[str, int]):
        self.rank = rank
        self.auto = ahocorasick.Automaton()
        for w, r in rank.items():
            self.auto.add_word(w, (len(w), math.log10(r)))
        self.auto.make_automaton()

    def ends(self, s: str) -> Iterator[tuple[int, tuple[int, float]]]:
        """(end, (length, log10 of the rank)) of every word anywhere in s, by end."""
        return ((at + 1, found) for at, found in self.auto.iter(s)) if self.rank else iter(())


def ranked(words: Iterable[str]) -> Words:
    out: dict[str, int] = {}
    for w in words:
        out.setdefault(w, len(out) + 1)
    return Words(out)


@cache
def ranks(path: str | None) -> Words:
    """The common words, then all whole words of a public vocabulary file in its order (frequent first)."""
    words = list(COMMON)
    if path:
        vocab = json.load(open(path, encoding="utf-8"))["model"]["vocab"]
        words += [w[:-4] for w, _ in sorted(vocab.items(), key=lambda x: x[1]) if w.endswith("</w>") and len(w) > 6 and w[:-4].isascii() and w[:-4].isalpha()]
    return ranked(words)


def _alphabet(c: str) -> int:
    return 10 if c.isdigit() else 26 if c.isalpha() and c.isascii() else 33 if c.isascii() else 100


def lowered(value: str) -> str:
    """value in lower case, character by character, so that places stay."""
    low = value.lower()
    return low if len(low) == len(value) else "".join(x if len(x := c.lower()) == 1 else c for c in value)


def _case(value: str, low: str) -> float:
    """log10 of the ways to write a word with capitals: first or all, else any of its first eight letters."""
    if value == low:
        return 0.0
    return CHOICE if value[0].isupper() and value[1:] == low[1:] or value.isupper() else CHOICE * min(len(value), 8)


class _Run:
    """Segments inside one run, of any start and end in it, whose cost is f(start) + log10(length) + g(end).

    offer() gives the best start. All starts are tried, but one that loses to an earlier start is dropped: the difference of their
    logarithms only shrinks as the end moves on, so it loses to that start for ever. What is left are starts where
    other segments reach into the run, so a long run costs no more than its length.
    """

    def __init__(self, least: int):
        self.least, self.starts = least, []

    def reset(self) -> None:
        self.starts = []

    def offer(self, end: int, start: int, f: float | None) -> tuple[float, int]:
        """start, end - least of the run with its f, is new (None: it lies before the run)."""
        if f is not None:
            self.starts.append((start, f))
        best, at, left = math.inf, -1, []
        for j, c in self.starts:
            cost = c + math.log10(end - j)
            if cost < best - 1e-12:
                best, at = cost, j
                left.append((j, c))
        self.starts = left
        return best, at


def guesses(value: str, words: Words) -> tuple[array, array, bytearray]:
    """best, back and kind of each prefix: the least log10 of guesses, where its last segment starts, and that one's kind (of PARTS)."""
    n = len(value)
    low = lowered(value)
    plain = low.translate(LEET)
    best, back, kind = array("d", [0.0]) + array("d", [math.inf]) * n, array("q", bytes(8 * (n + 1))), bytearray(n + 1)
    dates: dict[int, list[tuple[int, float]]] = {}
    met = [(words.ends(low), 0.0)] + ([(words.ends(plain), SPELT)] if plain != low else [])
    met = [[it, next(it, None), extra] for it, extra in met]
    repeats, walks, lines = _Run(REPEAT), _Run(WALK), _Run(SEQUENCE)
    same = walk = line = 0  # where the run of the character, the walk and the sequence up to here start
    way, rise = None, 0  # the walk's last direction, the sequence's
    turns = array("i", bytes(4 * n))  # how often the walk up to each character has turned

    for i in range(1, n + 1):
        c, low_end = low[i - 1], best[i - 1]
        if i > 1:
            p = low[i - 2]
            if c != p:
                same = i - 1
                repeats.reset()
            if c not in NEAR.get(p, ()):
                walk, way = i - 1, None
                walks.reset()
            else:
                step = (PLACE[c][0] - PLACE[p][0], PLACE[c][1] - PLACE[p][1])
                turns[i - 1] = turns[i - 2] + (way is not None and way != step)
                way = step
            up = ord(c) - ord(p) if c.isalnum() and p.isalnum() else 0
            if up not in (1, -1):
                line, rise = i - 1, 0
                lines.reset()
            elif up != rise:
                line, rise = i - 2, up
                lines.reset()
        least, at, what = low_end + math.log10(_alphabet(value[i - 1])) + (CHOICE if value[i - 1].isupper() else 0.0), i - 1, 0
        if i - same >= REPEAT:
            cost, j = repeats.offer(i, i - REPEAT, best[i - REPEAT])
            if cost + CHOICE + math.log10(_alphabet(c)) < least - 1e-12:
                least, at, what = cost + CHOICE + math.log10(_alphabet(c)), j, 1
        if i - walk >= WALK:
            cost, j = walks.offer(i, i - WALK, best[i - WALK] - turns[i - WALK + 1] * TURN)
            cost += CHOICE + math.log10(36) + turns[i - 1] * TURN
            if cost < least - 1e-12:
                least, at, what = cost, j, 2
        if i - line >= SEQUENCE:
            cost, j = lines.offer(i, i - SEQUENCE, best[i - SEQUENCE])
            cost += CHOICE + math.log10(2 * _alphabet(c))
            if cost < least - 1e-12:
                least, at, what = cost, j, 3
        if "0" <= c <= "9":
            for pattern, many in DATES:
                if m := pattern.match(low, i - 1):
                    dates.setdefault(m.end(), []).append((i - 1, math.log10(many)))
        for j, many in dates.pop(i, ()):
            if best[j] + many + CHOICE < least - 1e-12:
                least, at, what = best[j] + many + CHOICE, j, 4
        for found in met:
            while found[1] is not None and found[1][0] == i:
                size, rank = found[1][1]
                j = i - size
                if not found[2] or plain[j:i] != low[j:i]:
                    cost = best[j] + rank + found[2] + _case(value[j:i], low[j:i]) + CHOICE
                    if cost < least - 1e-12:
                        least, at, what = cost, j, 5
                found[1] = next(found[0], None)
        best[i], back[i], kind[i] = least, at, what
    return best, back, kind


PARTS = ("brute", "repeat", "walk", "sequence", "date", "word")


def segments(value: str, words: Words) -> tuple[float, list[tuple[int, int, str]]]:
    """(log10 of guesses, spans and their kinds) of the segmentation that takes the fewest guesses.

    best[i] is the least cost of the first i characters. A segment that ends at i is a dictionary word (also with
    capitals, or with digits for letters), a date, a repeat of one character, a walk on the keyboard, a sequence, or
    one character by brute force; each may start anywhere, inside a longer run too. Costs are logarithms, so they add;
    every segment that is not brute force adds a factor 2 for the choice. Of segments that tie, the first in
    the order of PARTS is named. Time is in proportion to the length.
    """
    best, back, kind = guesses(value, words)
    out: list[tuple[int, int, str]] = []
    at = len(value)
    while at:
        j, name = back[at], PARTS[kind[at]]
        if out and name == "brute" and out[-1][2] == "brute":
            out[-1] = (j, out[-1][1], name)
        else:
            out.append((j, at, name))
        at = j
    return best[len(value)], out[::-1]


def scan(text: str, words: Words, least: float) -> tuple[list[tuple[str, int, int]], list[float]]:
    """Spans (kind, start, end) by start, then kind; and the guess cost of every credential value met."""
    low = text.lower()
    spans: list[tuple[str, int, int]] = []
    costs: list[float] = []
    cost: dict[str, float] = {}
    if any(h in low for h in HINTS):
        spans += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
        for m in CONTEXT.finditer(text):
            value = m[1]
            if value not in cost:
                cost[value] = guesses(value, words)[0][-1]
            costs.append(cost[value])
            if cost[value] >= least:
                spans.append(("guess", m.start(1), m.end(1)))
    if "AKIA" in text:
        spans += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    spans += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])), costs


def secrets(df: DataFrame, text: str = "text", keep: list[str] | None = None, words: str | None = None, least: float = 8.0) -> DataFrame:
    """df with kinds, starts, ends (arrays: spans in code points, by start, then kind), n_values and max_guesses.

    Fixed patterns give assign, access and hex spans. Values in credential contexts are cut into words, dates,
    repeats, keyboard walks and brute force at least cost; those that take 10^least guesses or more give guess
    spans, cheaper ones (placeholders) none. `words` is the path of a public vocabulary file on every executor, all of whose
    whole words join the dictionary. max_guesses is the log10 of the costliest value (null: no value).

    Null and empty texts have no spans. Whole texts and whole values count, however long. Repeated rows give equal
    spans, an empty table stays empty. Columns pass through; those named like new ones are replaced.
    """

    def make():
        known = ranks(words)

        def run(texts):
            found = [scan(t, known, least) for t in as_texts(texts)]
            return [[s[0] for s in f] for f, _ in found], [[s[1] for s in f] for f, _ in found], [[s[2] for s in f] for f, _ in found], [len(c) for _, c in found], [max(c, default=None) for _, c in found]

        return run

    return add_columns(df, [text], [field("kinds", "array<string>"), field("starts", "array<bigint>"), field("ends", "array<bigint>"), field("n_values", "long"), field("max_guesses", "double")], make, keep)


def op7_guess_cost_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = secrets(table(spark, sf_dir, "documents"), keep=["doc_id"], words=public_tokenizers.path("word_bpe_49k.json"))
    spans = F.transform(F.arrays_zip("kinds", "starts", "ends"), lambda s: F.concat_ws(":", s["kinds"], s["starts"].cast("string"), s["ends"].cast("string")))
    base = F.filter(spans, lambda s: ~s.startswith("guess:"))
    count = lambda kind: F.size(F.filter("kinds", lambda k: k == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(spans, ",").alias("spans"), count("guess"), "n_values", F.round("max_guesses", 6).alias("max_guesses"))
