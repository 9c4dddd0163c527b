"""Toxicity scores: Levenshtein automata met with a lexicon trie, and windows that tell quotation from abuse."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prismark.llm.common import LONGEST, add_columns, as_texts, cut, field, table

EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”„‘’‚‹›¡¿…–—"
QUOTES = "\"«»“”„‹›"
POINTS = "".join(c for c in EDGE if c not in QUOTES)
#: Words that introduce somebody else's words (fixed values).
REPORTING = frozenset("said says wrote quoted called named dit écrit appelé sagte schrieb nannte dijo escribió llamó".split())


@dataclass(frozen=True)
class Fit:
    """Bounds of the sample a lexicon is learned from, and what a term must show to enter it."""

    toxic_docs: int = 2500
    clean_docs: int = 7500
    min_docs: int = 4
    min_precision: float = 0.9
    chance: float = 0.05  # of one false term in the whole lexicon
    stems: tuple[int, ...] = (4, 5, 6)


@dataclass
class Lexicon:
    """terms: word, or stem with a trailing *. weights: (term, kind of match) -> log odds that a text with it gains.

    prior: log odds of any text; bias: of a text without any term."""

    terms: list[str]
    weights: dict[tuple[str, int], float]
    bias: float
    prior: float = 0.0


def tokens(text: str) -> list[str]:
    return text.lower().split()


def allowed(term: str, one: int = 5, two: int = 9) -> int:
    """How many edits a term may be met with, by its length: none under `one` characters, two from `two` on, else one."""
    size = len(term.rstrip("*"))
    return 0 if size < one else 1 if size < two else 2


class Matcher:
    """The trie of a lexicon, met with the Levenshtein automaton of its terms, made deterministic as words come by.

    An edit is a character more, less or other, or two neighbours swapped (no character is edited twice). An item is
    (trie node, edits used, the character owed by a swap); a state is the set of items that the characters so far can
    have led to. States and their steps are kept, so a word costs a few look-ups, and most words reach the empty
    state after a few characters. A stem (a term with a trailing *) matches any word that has a beginning within
    the stem's edits of it.
    """

    MOST = 500_000  # items of all states held

    def __init__(self, terms: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.words: list[str | None] = [None]
        self.stems: list[str | None] = [None]
        self.deep: list[int] = [0]  # the most edits of a term that runs through the node
        self.edits = {t: allowed(t) for t in terms}
        for term in terms:
            node, most = 0, self.edits[term]
            self.deep[0] = max(self.deep[0], most)
            for c in term.rstrip("*"):
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.words.append(None)
                    self.stems.append(None)
                    self.deep.append(0)
                node = self.next[node][c]
                self.deep[node] = max(self.deep[node], most)
            (self.stems if term.endswith("*") else self.words)[node] = term
        self._reset()

    def _reset(self) -> None:
        self.of: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.whole: list[tuple[int, str] | None] = []  # (edits, word) if the word ends here
        self.begun: list[tuple[int, str] | None] = []  # (edits, stem) whatever follows
        self.held = 0
        self.start = self._state({(0, 0, "")})

    def _closed(self, items: set[tuple[int, int, str]]) -> frozenset:
        """With the trie nodes that characters left out lead to, and without what another item reaches with fewer edits."""
        least: dict[tuple[int, str], int] = {}
        todo = sorted(items, key=lambda x: x[1])
        for node, used, owed in todo:  # grows as it is read, by edits
            if used >= least.get((node, owed), 99):
                continue
            least[node, owed] = used
            if not owed:
                todo += [(n, used + 1, "") for n in self.next[node].values() if used < self.deep[n]]
        return frozenset((n, u, o) for (n, o), u in least.items())

    def _state(self, items: set[tuple[int, int, str]]) -> int:
        closed = self._closed(items)
        at = self.of.get(closed)
        if at is None:
            at = self.of[closed] = len(self.sets)
            self.sets.append(closed)
            self.steps.append({})
            self.held += len(closed)
            for ends, out in ((self.words, self.whole), (self.stems, self.begun)):
                out.append(min(((u, ends[n]) for n, u, o in closed if not o and ends[n] is not None and u <= self.edits[ends[n]]), default=None))
        return at

    def _step(self, state: int, c: str) -> int:
        out: set[tuple[int, int, str]] = set()
        for node, used, owed in self.sets[state]:
            if owed:
                if c == owed:
                    out.add((node, used, ""))
                continue
            child = self.next[node].get(c)
            if child is not None and used <= self.deep[child]:
                out.add((child, used, ""))
            if used < self.deep[node]:
                out.add((node, used + 1, ""))  # c is one too many
                for x, n in self.next[node].items():
                    if used < self.deep[n]:
                        out.add((n, used + 1, ""))  # c stands for x
                        over = self.next[n].get(c)
                        if over is not None and x != c and used < self.deep[over]:
                            out.add((over, used + 1, x))  # c came before x
        at = self.steps[state][c] = self._state(out) if out else -1
        return at

    def match(self, word: str) -> tuple[str, int] | None:
        """(term, edits) that the word matches best, or None: fewest edits, then words before stems, then by name."""
        if self.held > self.MOST:
            self._reset()
        state, begun = self.start, self.begun[self.start]
        for c in word:
            to = self.steps[state].get(c)
            state = self._step(state, c) if to is None else to
            if state < 0:
                break
            found = self.begun[state]
            if found is not None and (begun is None or found < begun):
                begun = found
        whole = self.whole[state] if state >= 0 else None
        best = whole if begun is None or whole is not None and whole[0] <= begun[0] else begun
        return None if best is None else (best[1], best[0])


def kind(word: str, term: str, edits: int) -> int:
    """How a word matches a term, as weights tell it apart (KINDS): as it is, with one edit though it begins alike, with one
    edit and another beginning, or with two."""
    return 0 if not edits else 3 if edits > 1 else 1 if word.startswith(beginning(term)) else 2


KINDS = range(4)


def beginning(term: str) -> str:
    bare = term.rstrip("*")
    return bare[: 4 if len(bare) < 8 else 6]


def marks(word: str, depth: int) -> tuple[int, int]:
    """How many quotations the word's quotation marks open before it and close after it, where `depth` are open.

    A mark's place tells which it does, as languages differ; one that stands alone goes by its kind, and a straight one by depth.
    """
    bare = word.strip(POINTS)
    if not bare:
        return 0, 0
    if not bare.strip(QUOTES):
        opens = not depth if bare[0] == '"' else bare[0] in "«“„‹"
        return int(opens), int(not opens or len(bare) > 1)
    return int(bare[0] in QUOTES), int(bare[-1] in QUOTES)


def quoted(words: list[str], at: int, window: int = 8) -> float:
    """How far the words around say that the term is quoted: 0.3 inside quotation marks or after a reporting word, else 1."""
    before = words[max(0, at - window) : at + 1]
    depth = 0
    for w in before[:-1]:
        opens, closes = marks(w, depth)
        depth = max(0, depth + opens - closes)
    depth += marks(words[at], depth)[0]
    held = depth
    if depth:
        depth -= marks(words[at], depth)[1]
        for w in words[at + 1 : at + window + 1]:
            if depth < held:
                break
            opens, closes = marks(w, depth)
            depth += opens - closes
    inside = depth < held
    reported = any(w.strip(EDGE) in REPORTING for w in before[-4:-1])
    return 0.3 if inside or reported else 1.0


class Scorer:
    def __init__(self, lexicon: Lexicon, window: int = 8, most: int = 250_000):
        self.lexicon, self.window, self.most = lexicon, window, most
        self.matcher = Matcher(lexicon.terms)
        self.none: set[str] = set()

    def found(self, text: str) -> dict[tuple[str, int], float]:
        """(term, kind) -> the strongest context factor it has in the whole text."""
        words = tokens(text)
        none, out = self.none, {}
        hits = {}
        for w in set(words) - none:
            bare = w.strip(EDGE)
            m = self.matcher.match(bare)
            if m is not None:
                hits[w] = m[0], kind(bare, *m)
            elif len(w) <= LONGEST:
                if len(none) >= self.most:
                    none.clear()
                none.add(w)
        if hits:
            for at, w in enumerate(words):
                if w in hits and out.get(hits[w], 0.0) < 1.0:
                    out[hits[w]] = max(out.get(hits[w], 0.0), quoted(words, at, self.window))
        return out

    def score(self, text: str) -> float:
        """From the log odds of a text without terms to those of one with them, as far as the terms are not quoted."""
        found = self.found(text)
        lex, far = self.lexicon, max(found.values(), default=0.0)
        evidence = (1 - far) * lex.bias + far * lex.prior + sum(lex.weights.get(k, 0.0) * f for k, f in found.items())
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, evidence))))


def sample(docs: DataFrame, labels: DataFrame, fit: Fit, id_col: str, text: str, label: str) -> DataFrame:
    """text and label of at most fit.toxic_docs and fit.clean_docs labelled rows, those of least hash, none held out.

    Of several texts under one id, the one of least hash is taken; so is it of copies and near copies (texts that share a
    signature and a label), which are one witness. The same rows give the same sample, in whatever order they come.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull()).where(~held_out(F.col(id_col))).groupBy(id_col).agg(F.max(label).alias("__label"))
    pick = lambda value, n: known.where(F.col("__label") == value).orderBy(F.xxhash64(id_col), id_col).limit(n)
    chosen = pick(1, fit.toxic_docs).unionByName(pick(0, fit.clean_docs))
    rows = docs.select(id_col, F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(chosen), id_col)  # as many rows as Fit says
    least = F.min_by("text", F.struct(F.xxhash64("text"), F.octet_length("text"))).alias("text")
    rows = rows.groupBy(id_col, F.col("__label").cast("long").alias("label")).agg(least).drop(id_col)
    rows = add_columns(rows, ["text"], [field(f"m{k}", "long") for k in range(len(MIXES))], lambda: lambda texts: list(zip(*[signatures(t) for t in as_texts(texts)], strict=True)))
    for k in range(len(MIXES)):
        others = [f"m{j}" for j in range(k + 1, len(MIXES))]
        first = F.min_by(F.struct("text", *others), F.struct(F.xxhash64("text"), F.octet_length("text"))).alias("x")
        rows = rows.groupBy("label", f"m{k}").agg(first).select("label", "x.*")
    return cut(rows.select("text", "label"), "sample")


#: Odd multipliers, one for each signature.
MIXES = tuple((2 * k + 1) * 0x9E3779B97F4A7C15 % (1 << 64) | 1 for k in range(3))


def signatures(text: str) -> list[int]:
    """The least hash of a text's runs of four words, under each of MIXES: near copies share most of them."""
    words = tokens(text)
    h = np.array([xxhash.xxh64_intdigest(" ".join(words[i : i + 4])) for i in range(max(1, len(words) - 3))], dtype=np.uint64)
    return [int((h * np.uint64(m)).min() >> np.uint64(1)) for m in MIXES]


def held_out(id_col):
    return F.crc32(id_col.cast("string").cast("binary")) % 5 == 0


def _terms(stems: tuple[int, ...], most: int = 150_000):
    """(term, toxic, clean) counts of texts, summed within a task until `most` terms are held, then sent on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {}

        def flush() -> pa.RecordBatch:
            names = ["term", "clean", "toxic"]
            out = pa.RecordBatch.from_arrays([pa.array(counts.keys(), type=pa.string()), *[pa.array([c[k] for c in counts.values()], type=pa.int64()) for k in (0, 1)]], names=names)
            counts.clear()
            return out.select(["term", "toxic", "clean"])

        for b in batches:
            for text, label in zip(as_texts(b.column(0)), b.column(1).to_pylist(), strict=True):
                words = {w.strip(EDGE) for w in tokens(text)} - {""}
                found = words | {w[:k] + "*" for k in stems for w in words if len(w) > k} | {""}
                for term in found:
                    counts.setdefault(term, [0, 0])[label] += 1
                if len(counts) > most:
                    yield flush()
        yield flush()

    return run


def learn(docs: DataFrame, labels: DataFrame, fit: Fit = Fit(), id_col: str = "doc_id", text: str = "text", label: str = "toxic") -> Lexicon:
    """A lexicon from a bounded sample of labelled rows (Fit). Scores never see labels, ids or other columns.

    Terms are words and word stems whose share of toxic texts can't be chance over all terms tried; as many as the sample
    gives. A stem stands for the words it begins that are no terms themselves; those that are stay. Words and stems
    are met misspelled too. Weights are log odds; a misspelt word starts from a little evidence for abuse, which clean texts
    that hold it, or (where it begins like the term) words that begin alike, soon outweigh; a misspelt stem, which
    stands for many words, starts from none. Terms that tie are all taken, in order of gain, then name.
    Without labels, or with labels of one kind only, the lexicon is empty and scores are the share of toxic
    labels (0 if there are none). Null labels, ids and texts, and labels of no document, are ignored.
    """
    rows = sample(docs, labels, fit, id_col, text, label)
    counted = rows.mapInArrow(_terms(fit.stems), "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counted = cut(counted.where((F.col("term") == "") | (F.col("toxic") + F.col("clean") >= fit.min_docs)), "terms")
    # of a bounded sample: as many rows as toxic texts have common terms
    got = counted.where((F.col("term") == "") | ((F.col("toxic") >= fit.min_docs) & (F.col("toxic") >= fit.min_precision * (F.col("toxic") + F.col("clean"))))).collect()
    totals = next(((r["toxic"], r["clean"]) for r in got if r["term"] == ""), (0, 0))
    nt, nc = totals
    if not nt or not nc:
        return Lexicon([], {}, -40.0 if not nt else 40.0)
    prior = nt / (nt + nc)
    tried = max(1, counted.count())

    def gain(t: int, c: int) -> float:
        p = t / (t + c)
        return t * math.log(p / prior) + (c * math.log((1 - p) / (1 - prior)) if c else 0.0)

    strong = [(r["term"], r["toxic"], r["clean"]) for r in got if r["term"] and gain(r["toxic"], r["clean"]) >= math.log(tried / fit.chance)]
    best_word: dict[str, int] = {}
    for term, t, _ in strong:
        if not term.endswith("*"):
            for k in fit.stems:
                if len(term) > k:
                    best_word[term[:k] + "*"] = max(best_word.get(term[:k] + "*", 0), t)
    kept: list[str] = []
    counts: dict[str, tuple[int, int]] = {}
    for term, t, c in sorted(strong, key=lambda x: (-round(gain(x[1], x[2]), 6), x[0].endswith("*"), -len(x[0]), x[0])):
        stem = term.endswith("*")
        if stem and t < 1.25 * best_word.get(term, 0):
            continue
        bare = term.rstrip("*")
        under = any(k.endswith("*") and bare.startswith(k[:-1]) for k in kept)
        if stem and (under or any(k.endswith("*") and k.startswith(bare) for k in kept)):
            continue
        kept.append(term)
        counts[term] = (t, c)
    begins = {t: beginning(t) + "*" for t in kept if not t.endswith("*")}
    asked = rows.sparkSession.createDataFrame([(b,) for b in sorted(set(begins.values()))], "term string")
    clean = {r["term"]: r["clean"] for r in counted.join(F.broadcast(asked), "term").collect()}
    return _weighed(rows, kept, nt, nc, {t: clean.get(b, 0) - counts[t][1] for t, b in begins.items()}, fit.min_precision)


def _weighed(rows: DataFrame, terms: list[str], nt: int, nc: int, alike: dict[str, int], least: float) -> Lexicon:
    """alike: in how many clean texts a word begins like the term; where such words are usual, a near match is no misspelling."""
    plain = Lexicon(terms, {}, 0.0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(plain)
        seen: Counter = Counter()
        for b in batches:
            for text, label in zip(as_texts(b.column(0)), b.column(1).to_pylist(), strict=True):
                found = scorer.found(text)
                for term, how in found:
                    seen[(term, how, label)] += 1
                if not found:
                    seen[("", 0, label)] += 1
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen]), pa.array([k[1] for k in seen], type=pa.int64()), pa.array([k[2] for k in seen], type=pa.int64()), pa.array(list(seen.values()), type=pa.int64())], names=["term", "how", "label", "n"])

    got = rows.mapInArrow(count, "term string, how long, label long, n long").groupBy("term", "how", "label").agg(F.sum("n").alias("n")).collect()
    n = {(r["term"], r["how"], r["label"]): r["n"] for r in got}
    of = lambda term, how, label: n.get((term, how, label), 0)
    prior = math.log(nt / nc)
    weights = {}
    for term in terms:
        for how in KINDS:
            t, c = of(term, how, 1), of(term, how, 0)
            start = (0.5, 0.05) if how == 0 else (0.5, 1.0) if term.endswith("*") else (1.0, 0.1 + alike.get(term, 0) * (how == 1) + 0.2 * (how == 3))
            gained = math.log((t + start[0]) / nt) - math.log((c + start[1]) / nc)
            sure = how == 0 or t >= least * (t + c)  # a misspelling must tell as much as a term
            weights[term, how] = gained if gained + prior > 0 and sure else 0.0  # what alone would not tell abuse tells nothing
    bias = math.log((of("", 0, 1) + 0.5) / (of("", 0, 0) + 0.5))
    return Lexicon(terms, weights, bias, prior)


def score(df: DataFrame, lexicon: Lexicon, text: str = "text", keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """df with a score between 0 and 1 for each whole text (null: empty). The lexicon is bounded by the sample it is learned from.

    A text is read word by word, however long; words over LONGEST characters are matched anew each time. Repeated rows score alike, an empty table stays empty, columns pass through; one named like the score is replaced.
    """

    def make():
        scorer = Scorer(lexicon)
        return lambda texts: [[scorer.score(t) for t in as_texts(texts)]]

    return add_columns(df, [text], [field(name, "double")], make, keep)


def op5_levenshtein_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, learn(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
