"""Exact byte-pair encoding by one table entry for each prefix, and decoding."""

from __future__ import annotations

import gc
import json
import re
from array import array
from collections.abc import Callable
from functools import cache
from struct import pack

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismark.llm.common import LONGEST, add_columns, as_texts, field, table


def _alphabet() -> dict[int, str]:
    """Byte -> the character that stands for it in byte-level vocabularies: printable bytes stand for themselves, the others for code points from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


#: The word pattern that byte-level vocabularies of this kind are defined with (a fixed value).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class PrefixEncoder:
    """Byte-pair encoding of words without a merge loop.

    The encoding of every prefix of a word ends in exactly one token. Going left to right, the automaton over the
    vocabulary names all tokens that end at a position; the one whose predecessor (the last token of the prefix
    before it) is compatible with it is that prefix's last token. Two tokens are compatible when merging the
    bytes of both would yield just these two: no merge that crosses their border comes before those inside
    that it competes with. Back-pointers (token lengths) from the end give the ids.
    """

    def __init__(self, path: str, most: int = 600_000):
        self.most = most  # entries, of up to LONGEST characters, of each table of what was met: bounds a worker's memory; the rest is computed again
        spec = json.load(open(path, encoding="utf-8"))
        vocab: dict[str, int] = spec["model"]["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.rank: dict[int, int] = {}  # both tokens of a merge in one integer -> its place
        self.parts: dict[int, tuple[int, int, int]] = {}  # token -> left, right, place of the merge that makes it
        for r, (a, b) in enumerate(merges):
            left, right = vocab[a], vocab[b]
            self.rank.setdefault(left << 32 | right, r)
            self.parts.setdefault(vocab[a + b], (left, right, r))
        self._fits: dict[int, bool] = {}
        alphabet = _alphabet()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        back = {c: b for b, c in alphabet.items()}
        self.bytes = {i: bytes(back[c] for c in s) for s, i in vocab.items()} | {i: s.encode() for s, i in self.special.items()}
        top = max(self.bytes) + 1
        self.sizes = np.array([len(self.bytes.get(i, b"")) for i in range(top)], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(self.bytes.get(i, b"") for i in range(top)), dtype=np.uint8)
        self.table = str.maketrans({chr(b): c for b, c in alphabet.items() if chr(b) != c})
        self.auto = ahocorasick.Automaton()
        for s, i in vocab.items():
            if len(s) == 1 or (i in self.parts and self._reachable(i)):
                self.auto.add_word(s, (i, len(s)))
        self.auto.make_automaton()
        self.split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.words = regex.compile(WORDS)
        self.runs = re.compile(r"\s\s")
        self.known: dict[str, bytes] = {}  # word -> ids
        self.spans: dict[str, bytes] = {}  # what lies between two spaces -> ids with the space before it
        gc.freeze()  # these tables stay: the collector need not walk them again and again

    def _reachable(self, token: int) -> bool:
        """Whether the token's own characters merge into it: at its merge, both halves stand whole."""
        a, b, r = self.parts[token]
        return self._border(a, b, r)

    def _border(self, a: int, b: int, limit: int) -> bool:
        """No merge across the border of a and b happens before rank `limit`, in the course of merging both.

        Undo the merges of a and b from the last to the first: before each, the tokens at the border are a and b;
        their merge across (if there is one) must not come before the merge undone last.
        """
        whole = (-1, -1, -1)
        while True:
            across = self.rank.get(a << 32 | b)
            if across is not None and across < limit:
                return False
            left, right = self.parts.get(a, whole), self.parts.get(b, whole)
            if left[2] < 0 and right[2] < 0:
                return True
            # a merge on the right that ends at rank r is beaten by one across of the same rank that starts further left
            if left[2] > right[2]:
                a, limit = left[1], left[2]
            else:
                b, limit = right[0], right[2] + 1

    def word(self, s: str) -> list[int]:
        """Ids of one word, written in the vocabulary's alphabet."""
        fits = self._fits
        last, size = array("i", [-1]) * (len(s) + 1), array("i", [0]) * (len(s) + 1)
        for end, (token, n) in self.auto.iter(s):
            end += 1
            if size[end]:
                continue
            if end > n:
                before = last[end - n]
                if before < 0:
                    continue
                key = before << 32 | token
                fit = fits.get(key)
                if fit is None:
                    if len(fits) >= self.most:
                        fits.clear()
                    fit = fits[key] = self._border(before, token, 1 << 60)
                if not fit:
                    continue
            last[end], size[end] = token, n
        out, at = [], len(s)
        while at:
            out.append(last[at])
            at -= size[at]
        return out[::-1]

    def _ordinary(self, text: str, out: list[bytes]) -> None:
        """Where white space stands alone, a space starts a new word whatever is around it, so what lies between spaces is looked up whole."""
        if self.runs.search(text):
            return self._words(text, out)
        first, *rest = text.split(" ")
        self._words(first, out)
        ids = list(map(self.spans.get, rest))
        if None in ids:
            if len(self.spans) >= self.most:
                self.spans.clear()
            for i, x in enumerate(ids):
                if x is None:
                    x = self.spans.get(rest[i])
                    if x is None:
                        got: list[bytes] = []
                        self._words(" " + rest[i], got)
                        x = b"".join(got)
                        if len(rest[i]) <= LONGEST:
                            self.spans[rest[i]] = x
                    ids[i] = x
        out += ids

    def _words(self, text: str, out: list[bytes]) -> None:
        words = self.words.findall(text)
        ids = list(map(self.known.get, words))
        if None in ids:
            if len(self.known) >= self.most:
                self.known.clear()
            for i, (w, x) in enumerate(zip(words, ids, strict=True)):
                if x is None:
                    x = self.known.get(w)
                    if x is None:
                        key = w if w.isascii() and w.isprintable() and w[0] != " " else w.encode().decode("latin-1").translate(self.table)
                        got = self.word(key)
                        x = pack(f"<{len(got)}I", *got)
                        if len(w) <= LONGEST:
                            self.known[w] = x
                    ids[i] = x
        out += ids

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        pieces = self.split.split(text) if self.split and any(s in text for s in self.special) else [text]
        for p in pieces:
            if p in self.special:
                out.append(np.array([self.special[p]], dtype="<u4").tobytes())
            elif p:
                self._ordinary(p, out)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The text of ids: their bytes in a row, read as UTF-8 (what is no UTF-8 becomes U+FFFD)."""
        token = np.frombuffer(ids, dtype="<u4")
        size = self.sizes[token]
        ends = np.cumsum(size)
        if not len(token) or not ends[-1]:
            return ""
        at = np.arange(ends[-1]) + np.repeat(self.starts[token] - (ends - size), size)
        return self.flat[at].tobytes().decode("utf-8", "replace")


@cache
def encoder(path: str) -> PrefixEncoder:
    return PrefixEncoder(path)


def _coder(path: str) -> Callable[[], Callable]:
    def make():
        enc = encoder(path)

        def run(texts):
            ids = [enc.encode(t) for t in as_texts(texts)]
            return ids, [len(x) // 4 for x in ids], [enc.decode(x) for x in ids]

        return run

    return make


def encode_and_decode(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """df with ids (binary: little-endian unsigned 32-bit integers), n_tokens and decoded (the text from the ids).

    `path` names a byte-level BPE vocabulary file that every executor has. Whole texts, however long, are encoded
    word by word; a worker holds a bounded table of words met. Null texts count as empty, with no ids. Repeated
    rows give equal ids, an empty table stays empty. Columns of df pass through; ids, n_tokens and decoded are
    replaced.
    """
    return add_columns(df, [text], [field("ids", "binary"), field("n_tokens", "long"), field("decoded", "string")], _coder(path), keep)


def op9_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coded = encode_and_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), keep=["doc_id"])
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
