"""Vector bin packing of tokenised examples into training sequences."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from struct import pack as _pack

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prismark.llm.common import LONGEST, as_bytes, field, pieces, table


class WordTokenizer:
    """Ids of a tokenizers file whose text is lower-cased and parted at white space, by a table of pieces.

    Text between ASCII white spaces stands alone, so it is looked up whole. What a text holds that is new and plain
    (printable, below U+0250, where NFC changes nothing) is cut by the file's own pattern in one go and its words go to
    the file's model; all else goes through the library's whole encode(). A table keeps words of up to LONGEST bytes; once
    it has `most` it becomes the older one, from which words that are met again come back, and the oldest goes.
    """

    PLAIN = re.compile(r"[ -~¡-įı-ɏ]+")
    WORD = regex.compile(r" |'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    #: Between the ids of two pieces. Ids are under 2^24, so their fourth byte is 0 and no ids hold these bytes.
    PART = b"\xff\xff\xff\xff"

    def __init__(self, path: str, most: int = 200_000):
        from tokenizers import Tokenizer

        from prismark.llm.bpe import _alphabet

        self.lib = Tokenizer.from_file(path)
        top = max(self.lib.get_vocab().values())
        if top >= 1 << 24:
            raise ValueError(f"{path} has 2^24 ids or more")
        self.model = self.lib.model
        self.packed = [_pack("<I", i) for i in range(top + 1)]
        self.special = [t.content.encode() for t in self.lib.get_added_tokens_decoder().values()]
        self.letters = str.maketrans({chr(b): c for b, c in _alphabet().items() if chr(b) != c})
        self.most = most
        self.known, self.known_before = {}, {}
        self.words, self.words_before = {}, {}

    def _word(self, w: str) -> bytes:
        key = w if w.isascii() else w.encode().decode("latin-1").translate(self.letters)
        return b"".join([self.packed[t.id] for t in self.model.tokenize(key)])

    def _plain(self, text: str) -> list[bytes]:
        """Ids of each of the pieces that single spaces part in a plain text."""
        words = self.WORD.findall(text.lower())
        table, before = self.words, self.words_before
        table[" "] = self.PART
        new = set(words).difference(table)
        table.update([(w, before.get(w) or self._word(w)) for w in new])
        out = b"".join(map(table.get, words)).split(self.PART)
        for w in [w for w in new if len(w) > LONGEST]:
            del table[w]
        if len(table) > self.most:
            self.words, self.words_before = {}, table if len(table) <= 2 * self.most else {}
        return out

    def _new(self, chunks: list[bytes]) -> list[bytes]:
        texts = [c.decode() for c in chunks]
        if self.PLAIN.fullmatch(joined := " ".join(texts)):
            return self._plain(joined)
        return [self._plain(t)[0] if self.PLAIN.fullmatch(t) else self._by_lib(t) for t in texts]

    def _by_lib(self, text: str) -> bytes:
        got = self.lib.encode(text, add_special_tokens=False).ids
        return _pack(f"<{len(got)}I", *got)

    def encode(self, text: bytes) -> bytes:
        """Ids of a whole text (UTF-8) as little-endian unsigned 32-bit integers."""
        if any(s in text for s in self.special):
            return self._by_lib(text.decode())
        chunks, table, before = text.split(), self.known, self.known_before
        missing = set(chunks).difference(table)
        table.update([(c, x) for c in missing if (x := before.get(c)) is not None])
        new = [c for c in missing if c not in before]
        if new:
            table.update(zip(new, self._new(new), strict=True))
        out = b"".join(map(table.get, chunks))
        for c in [c for c in new if len(c) > LONGEST]:
            del table[c]
        if len(table) > self.most:
            self.known, self.known_before = {}, table if len(table) <= 2 * self.most else {}
        return out


@cache
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


@dataclass(frozen=True)
class Limits:
    """What one sequence holds at most."""

    tokens: int = 4096
    segments: int = 256
    loss: int = 4096


@dataclass
class Item:
    """What is left of one example: `at` of its `size` tokens are placed already; its first `free` tokens bear no loss."""

    key: int
    size: int
    free: int = 0
    at: int = 0


def pack_items(items: list[Item], limits: Limits, last: bool) -> Iterator[list[tuple[Item, int, int]]]:
    """Sequences, each a list of (item, start, length). What an unfinished sequence would hold stays in items unless last.

    One sequence is open at a time. Demands are vectors (tokens, one segment, loss-bearing tokens) as parts of the
    limits; of the items that fit whole, the one whose vector has the largest dot product with what is left goes in.
    When none fits whole, the item of which most fits is cut there; of several, the one whose cut bears most loss, so
    that prompts are left for later. Ties go to the item that came first. Where
    nothing more fits into a sequence that isn't full, it is cut to a multiple of SHORT tokens, and what follows stays an item.
    """
    cap = np.array([limits.tokens, limits.segments, limits.loss], dtype=float)
    size = np.array([i.size - i.at for i in items], dtype=np.int64)
    free = np.array([max(0, i.free - i.at) for i in items], dtype=np.int64)
    at = {i.key: k for k, i in enumerate(items)}

    def put(k: int, n: int) -> None:
        items[k].at += n
        size[k] -= n

    while True:
        left = cap.copy()
        row: list[tuple[Item, int, int]] = []
        if not last and size.sum() < 4 * limits.tokens:
            break
        while left[0] >= 1 and left[1] >= 1 and size.any():
            rest = left / cap
            bears = np.maximum(size - free, 0)
            score = (size / cap[0]) * rest[0] + rest[1] / cap[1] + (bears / cap[2]) * rest[2]
            score[(size == 0) | (size > left[0]) | (bears > left[2])] = -1
            k = int(score.argmax())
            n = int(size[k])
            if score[k] < 0:
                fits = np.minimum(np.minimum(size, int(left[0])), free + int(left[2]))
                n = int(fits.max())
                k = int(np.where(fits == n, np.maximum(fits - free, 0), -1).argmax())
                if not n:
                    break
            put(k, n)
            row.append((items[k], items[k].at - n, n))
            left -= (n, 1, max(0, n - int(free[k])))
            free[k] = max(0, items[k].free - items[k].at)
        if not row:
            break
        total = sum(n for *_, n in row)
        back = total % SHORT if SHORT <= total < limits.tokens else 0
        while back:  # a short sequence's odd end goes back, for others to fill
            item, start, n = row.pop()
            less = min(n, back)
            k = at[item.key]
            put(k, -less)
            free[k] = max(0, item.free - item.at)
            back -= less
            if less < n:
                row.append((item, start, n - less))
        yield row
    items[:] = [i for i, n in zip(items, size, strict=True) if n]


#: Short sequences are of this many tokens, or a multiple of it, unless fewer are left.
SHORT = 64


def halves(row: list[tuple[Item, int, int]]) -> Iterator[list[tuple[Item, int, int]]]:
    """A sequence that no more fits in, as sequences whose lengths are powers of two (no padding there)."""
    total = sum(n for *_, n in row)
    while total:
        part = 1 << (total.bit_length() - 1)
        out, room = [], part
        while room:
            item, start, n = row[0]
            take = min(n, room)
            out.append((item, start, take))
            room -= take
            row = row[1:] if take == n else [(item, start + take, n - take), *row[1:]]
        total -= part
        yield out


PIECES = [field("start", "long"), field("length", "long"), field("ids", "binary"), field("doc_tokens", "long"), field("sequence_id", "long"), field("offset", "long")]


def pack(df: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", end_id: int = 2, limits: Limits = Limits(), pool_tokens: int = 1 << 20, pool_items: int = 2048, loss_from: str | None = None, prompt: float = 0.0) -> DataFrame:
    """One row for each piece: id_col, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    Texts are tokenised with the file at `path` (on every executor), end_id follows each. Every task packs what it
    reads, from a pool of bounded tokens and examples, with no shuffle; sequence_id is the task's number times 2^32
    plus a count, so a task that runs again gives the same rows. Tokens before the place in the integer column
    loss_from bear no loss (null: all do); without such a column, the first `prompt` of a text's tokens, rounded down.
    A sequence that nothing more fits in goes out in lengths of powers of two.

    Null and empty texts are the end id alone. Texts of any length are cut into as many pieces as it takes. Ids may
    repeat or be null; pieces keep them. Examples that tie go in as they came. An empty table gives none. Other columns
    are left out.
    """
    read = [id_col, text] + ([loss_from] if loss_from else [])
    src = df.select(*[F.col(f"`{c}`") for c in read])
    schema = T.StructType([src.schema[id_col], *PIECES])
    key_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[src.schema[id_col].dataType.simpleString()]
    tail = _pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, base, count = tokenizer(path), TaskContext.get().partitionId() << 32, 0
        held: dict[int, tuple[object, bytes]] = {}  # key -> (id, token ids) of the items
        items: list[Item] = []
        seen = held_tokens = 0

        def emit(rows: Iterator[list[tuple[Item, int, int]]]) -> Iterator[pa.RecordBatch]:
            nonlocal count
            out: list[tuple] = []
            for made in rows:
                for row in halves(made) if sum(n for *_, n in made) < limits.tokens else [made]:
                    offset = 0
                    for item, start, n in row:
                        name, ids = held[item.key]
                        out.append((name, start, n, ids[4 * start : 4 * (start + n)], item.size, base + count, offset))
                        offset += n
                    count += 1
            if out:
                kinds = [key_type, *(pa.binary() if f.name == "ids" else pa.int64() for f in PIECES)]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[f.name for f in schema])
            for k in held.keys() - {i.key for i in items}:
                del held[k]

        for batch in (part for whole in batches for part in pieces(whole, [1])):
            prompts = batch.column(2).to_pylist() if loss_from else [None] * batch.num_rows
            for name, t, free in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), prompts, strict=True):
                held[seen] = name, tok.encode(t) + tail
                size = len(held[seen][1]) // 4
                items.append(Item(seen, size, (free or 0) if loss_from else int(prompt * (size - 1))))
                seen += 1
                held_tokens += items[-1].size
                if len(items) >= pool_items or held_tokens >= pool_tokens:
                    yield from emit(pack_items(items, limits, False))
                    held_tokens = sum(i.size - i.at for i in items)
        yield from emit(pack_items(items, limits, True))

    return src.mapInArrow(run, schema)


#: Of a sequence of 4096 tokens, 256 at least are no answers, and it mixes 32 examples at most.
QUERY_LIMITS = Limits(tokens=4096, segments=32, loss=3840)
QUERY_PROMPT = 0.25


def op8_vector_bin_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as instruction data: the first quarter of a text's tokens is its prompt, what follows the answer that bears loss."""
    import public_tokenizers

    return digests(pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), limits=QUERY_LIMITS, prompt=QUERY_PROMPT))


def digests(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
