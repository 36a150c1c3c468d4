"""BPE encoding by dynamic programming over prefixes, and decoding.

A vocabulary of merges gives every prefix of a word exactly one last token: the token that ends
there, starts where another prefix ends, and stays apart from that prefix's own last token when
both are merged as one text. Tokens that end at a place come from a suffix automaton of the whole
vocabulary; whether two tokens stay apart comes from their merge ranks alone. The ids are read
off by following the last tokens back. Time is linear in the word, and no merge list is replayed.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from array import array
from collections import deque
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, functions as F

from evenkeel.session import ship_package

FINAL = 256  # symbols are byte values; with a vocabulary of word ends the last one of a word is 256 higher
NEVER = 1 << 60


@lru_cache(1)
def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1
    characters stand for themselves, the rest for the code points from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Merges, ids and the suffix automaton of a tokenizer file; plain lists, so it can be broadcast."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        self.ids: dict[str, int] = model["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names: dict[int, str] = {i: t for t, i in (self.ids | self.added).items()}
        parts: dict[int, list[int]] = {}
        for byte, letter in enumerate(byte_letters()):
            if letter in self.ids:
                parts[self.ids[letter]] = [byte]
            if self.end and letter + self.end in self.ids:
                parts[self.ids[letter + self.end]] = [byte + FINAL]
        self.single = {p[0]: i for i, p in parts.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int, int]] = {}  # token: left, right, rank
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left, right = self.ids[a], self.ids[b]
            token = self.ids[a + b]
            self.rank[left, right] = rank
            if token not in self.halves and token not in self.single.values():
                self.halves[token] = (left, right, rank)
                parts[token] = parts[left] + parts[right]
        # A token whose own text merges otherwise never comes out of an encoding.
        whole = {t: p for t, p in parts.items() if t not in self.halves or self.stays_whole(t)}
        self.build(whole)

    def stays_whole(self, token: int) -> bool:
        """Its two halves meet before any other merge takes a part of them."""
        left, right, rank = self.halves[token]
        return all(
            m >= rank
            for u, u_gone in self.edge(left, 1)
            for v, v_gone in self.edge(right, 0)
            if (m := self.rank.get((u, v), NEVER)) < min(u_gone, v_gone + 1)
        )

    def edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """Tokens that stand at the left (0) or right (1) edge while ``token`` is built, each with
        the rank of the merge that takes it; the whole token is never taken."""
        out, gone = [(token, NEVER)], NEVER
        while token in self.halves:
            gone = self.halves[token][2]
            token = self.halves[token][side]
            out.append((token, gone))
        return out

    def build(self, whole: dict[int, list[int]]) -> None:
        """The suffix automaton of all tokens, and for each state the tokens that end there."""
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        own: dict[int, int] = {}
        for token, symbols in whole.items():
            state = 0
            for symbol in symbols:
                state = self.extend(state, symbol)
            own[state] = token
        # A token's state holds its whole text as the longest one, as nothing comes before it there.
        self.own = [own.get(s, -1) for s in range(len(self.next))]
        # The tokens (with their lengths) that end where a state is reached: of its whole text, or of less than that.
        self.whole: list[tuple[tuple[int, int], ...]] = [()] * len(self.next)
        self.below: list[tuple[tuple[int, int], ...]] = [()] * len(self.next)
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            up = self.link[s]
            self.below[s] = self.whole[up]
            self.whole[s] = ((self.own[s], self.length[s]), *self.below[s]) if self.own[s] >= 0 else self.below[s]

    def extend(self, last: int, symbol: int) -> int:
        """The state of the text of ``last`` followed by ``symbol``."""
        nxt, link, length = self.next, self.link, self.length
        if (q := nxt[last].get(symbol)) is not None:
            return q if length[q] == length[last] + 1 else self.split(last, q, symbol)
        new = self.state(length[last] + 1, {})
        p = last
        while p >= 0 and symbol not in nxt[p]:
            nxt[p][symbol] = new
            p = link[p]
        if p < 0:
            link[new] = 0
        else:
            q = nxt[p][symbol]
            link[new] = q if length[q] == length[p] + 1 else self.split(p, q, symbol)
        return new

    def split(self, p: int, q: int, symbol: int) -> int:
        """Of state q, the texts that are no longer than p and the symbol get a state of their own."""
        nxt, link, length = self.next, self.link, self.length
        copy = self.state(length[p] + 1, dict(nxt[q]))
        link[copy], link[q] = link[q], copy
        while p >= 0 and nxt[p].get(symbol) == q:
            nxt[p][symbol] = copy
            p = link[p]
        return copy

    def state(self, length: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.link.append(0)
        self.length.append(length)
        return len(self.next) - 1


class Pieces:
    """Ids of single words, by a Vocabulary. What is found for the first characters of a word is
    kept for other words that begin alike, up to a bounded number of beginnings."""

    def __init__(self, vocabulary: Vocabulary, most_pairs: int = 1 << 19, most_heads: int = 1 << 18, deepest: int = 12):
        self.v, self.most_pairs, self.most_heads, self.deepest = vocabulary, most_pairs, most_heads, deepest
        self.pairs: dict[int, bool] = {}
        self.forget()

    def forget(self) -> None:
        self.heads: list[tuple[int, int, int, int]] = [(0, 0, 0, 0)]  # state, matched length, last token, its length
        self.longer: dict[int, int] = {}  # (head, symbol) to the head that is longer by it

    def apart(self, a: int, b: int) -> bool:
        """Neighbours a and b are not merged across: no merge of tokens at their edges comes up
        while both tokens are there. Of two merges of one rank, the left one comes first."""
        rank, right = self.v.rank, self.v.edge(a, 1)
        fits = not any(
            rank.get((x, y), NEVER) < min(x_gone, y_gone + 1) for y, y_gone in self.v.edge(b, 0) for x, x_gone in right
        )
        if len(self.pairs) >= self.most_pairs:
            self.pairs.clear()
        self.pairs[a << 32 | b] = fits
        return fits

    def encode(self, word: bytes) -> list[int]:
        """Ids of one word, given in bytes."""
        v = self.v
        nxt, link, length, whole, below = v.next, v.link, v.length, v.whole, v.below
        known, apart, heads, longer, deepest = self.pairs.get, self.apart, self.heads, self.longer, self.deepest
        symbols = list(word)
        if v.end and symbols:
            symbols[-1] += FINAL
        last, size = [0], [0]  # of each prefix: its last token, and that token's length
        state = matched = head = i = 0
        for symbol in symbols:
            i += 1
            if head is not None:
                known_head = longer.get(head << 9 | symbol)
                if known_head is not None:
                    head = known_head
                    state, matched, t, n = heads[head]
                    last.append(t)
                    size.append(n)
                    continue
            while (to := nxt[state].get(symbol)) is None:
                state = link[state]
                matched = length[state]
            state, matched = to, matched + 1
            for t, n in whole[state] if matched == length[state] else below[state]:
                if n == i:
                    break
                a = last[i - n]
                if (fits := known(a << 32 | t)) is None:
                    fits = apart(a, t)
                if fits:
                    break
            last.append(t)
            size.append(n)
            if head is not None and i <= deepest and symbol < FINAL:
                longer[head << 9 | symbol] = len(heads)
                head = len(heads)
                heads.append((state, matched, t, n))
            else:
                head = None
        if len(heads) > self.most_heads:
            self.forget()
        out = []
        while i:
            out.append(last[i])
            i -= size[i]
        out.reverse()
        return out


class Remembered(dict):
    """What a function gives for a key, for the keys of late: the older half of them is dropped
    when there are too many, so memory is bounded and frequent keys stay."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value

    def turn(self) -> None:
        """Between batches: keep at most ``most`` keys twice over."""
        if len(self) > self.most:
            self.older = dict(self)
            self.clear()



# Fixed values of the word vocabulary: how its normalised text falls into words.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
ENDS = set(",.;:!?|")  # of these WORDS makes words of their own after letters
SPACES = regex.compile(r"\p{White_Space}+")
SEPARATORS = re.compile("[\x1c-\x1f]")  # white space to Python, not to the vocabulary


class WordEncoder:
    """Ids of whole texts: NFC, lower case, white space dropped, words split by WORDS.

    What is a letter is as the installed Unicode tables have it; code points that they don't
    assign yet may fall into words otherwise than in a library with newer tables.
    """

    def __init__(self, vocabulary: Vocabulary, most_words: int = 400_000):
        self.pieces = Pieces(vocabulary)
        self.words = Remembered(lambda word: array("I", self.pieces.encode(word.encode())).tobytes(), most_words // 2)
        self.chunks = Remembered(self.chunk, most_words)
        self.added = regex.compile("(" + "|".join(map(regex.escape, vocabulary.added)) + ")")
        self.added_ids = {t: array("I", [i]).tobytes() for t, i in vocabulary.added.items()}

    def turn(self) -> None:
        self.words.turn()
        self.chunks.turn()

    def chunk(self, text: str) -> bytes:
        """Ids of a run without white space, as native unsigned 32-bit integers."""
        if text.isalpha():
            return self.words[text]
        if text[:-1].isalpha() and text[-1] in ENDS:
            return self.words[text[:-1]] + self.words[text[-1]]
        return b"".join(map(self.words.__getitem__, WORDS.findall(text)))

    def plain(self, text: str) -> bytes:
        if not text.isascii():
            # Character by character: a capital sigma is never a final one.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        runs = SPACES.split(text) if SEPARATORS.search(text) else text.split()
        return b"".join(map(self.chunks.__getitem__, runs))

    def encode(self, text: str) -> bytes:
        """Ids as native unsigned 32-bit integers. Added tokens are found in the raw text."""
        if not any(t in text for t in self.added_ids):
            return self.plain(text)
        return b"".join(
            self.added_ids.get(part) or self.plain(part) for part in self.added.split(text) if part
        )


def load(spark: SparkSession, path: str, names_only: bool = False) -> Broadcast:
    """The vocabulary of a tokenizer file (or just its tokens by id), sent to the executors once.
    Its size is that of the file's vocabulary, whatever the data."""
    ship_package(spark)
    with open(path, encoding="utf-8") as f:
        text = f.read()
    key = (spark.sparkContext.applicationId, text, names_only)
    if key not in _LOADED:
        vocabulary = Vocabulary(text)
        _LOADED[key] = spark.sparkContext.broadcast(vocabulary.names if names_only else vocabulary)
    return _LOADED[key]


_LOADED: dict[tuple[str, str, bool], Broadcast] = {}
_ENCODERS: deque[WordEncoder] = deque(maxlen=2)


def slices(batches, rows: int = 256):
    """The same rows in smaller batches, so that what is made of them stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def encoder_of(vocabulary: Broadcast) -> WordEncoder:
    """One encoder for each vocabulary in a worker, so that its words outlive a task."""
    value = vocabulary.value
    for encoder in _ENCODERS:
        if encoder.pieces.v is value:
            return encoder
    _ENCODERS.append(WordEncoder(value))
    return _ENCODERS[-1]


def little_endian(ids: bytes) -> bytes:
    return ids if sys.byteorder == "little" else np.frombuffer(ids, "=u4").astype("<u4").tobytes()


def encode(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False
) -> DataFrame:
    """id and ``ids``: the token ids of the whole text as little-endian unsigned 32-bit integers.
    With ``decoded`` also ``text``: those ids decoded again, in the same pass.

    One row per row of ``docs``, in one pass and without a shuffle. A null or empty text has no
    ids (an empty value); a null id stays null.
    """
    vocabulary = load(docs.sparkSession, path)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        encoder = encoder_of(vocabulary)
        for batch in slices(batches):
            ids = [little_endian(encoder.encode(t or "")) for t in batch.column(1).to_pylist()]
            encoder.turn()
            out = [batch.column(0), pa.array(ids, pa.binary())]
            if decoded:
                out.append(texts_of(ids, encoder.pieces.v.names))
            yield pa.RecordBatch.from_arrays(out, ["id", "ids", "text"][: len(out)])

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    text = ", text string" if decoded else ""
    return narrow.mapInArrow(run, f"id {kind}, ids binary{text}").withColumnRenamed("id", id_col)


def texts_of(ids_column: list[bytes | None], names: dict[int, str]) -> pa.Array:
    """The tokens of each value joined with spaces; ids outside the vocabulary are left out."""
    texts = []
    for ids in ids_column:
        known = np.frombuffer(ids or b"", "<u4").tolist()
        try:
            texts.append(" ".join(map(names.__getitem__, known)))
        except KeyError:
            texts.append(" ".join(names[i] for i in known if i in names))
    return pa.array(texts, pa.string())


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and ``text``: the tokens of ``ids`` joined with spaces, as the vocabulary has no decoder
    of its own. Null ids count as none; ids outside the vocabulary are left out."""
    sent = load(encoded.sparkSession, path, names_only=True)
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in slices(batches):
            texts = texts_of(batch.column(1).to_pylist(), sent.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], ["id", "text"])

    narrow = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return narrow.mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)
