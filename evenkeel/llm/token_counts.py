"""Edit-aware token counts.

A text is cut into pre-tokens, which are encoded one by one; runs of pre-tokens are the leaves of
a segment tree that keeps the sums of characters and of tokens below each node. An edit finds its
leaves by their character sums, cuts only these anew, together with as much of the text around
them as decides where pre-tokens end, and updates the sums on the way up. All other leaves keep
their counts.

Where a pre-token ends depends on no more than the character after next, and nothing before its
start. So cutting may begin at the last leaf that starts two characters before the edit, and it
is over when a pre-token ends where an untouched leaf begins.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterable
from functools import cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, functions as F

from evenkeel.llm.bpe import Remembered, slices
from evenkeel.session import ship_package

LEAF = 64  # pre-tokens of a new leaf
FULL = 4 * LEAF  # mean number in edited leaves beyond which the tree is laid out anew
AHEAD = 2  # characters after its end that a pre-token depends on
MOST_PIECES = 300_000  # pre-tokens whose counts a worker remembers
# Fixed value: how the rank file's vocabulary cuts texts, with white space spelled out.
PRE_TOKENS = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)

Edit = tuple[int, int, str]  # start, end, replacement


@cache
def counter(path: str) -> Remembered:
    """Number of tokens of a pre-token, by a rank file; kept for a worker's life."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("counts", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
    return Remembered(lambda piece: len(encoding.encode_ordinary(piece)), MOST_PIECES)


class TokenTree:
    """The segment tree of one text."""

    def __init__(self, leaves: list[str], counts: list[int], pieces: list[int], count: Remembered):
        self.count = count
        self.encoded = 0  # pre-tokens encoded since the tree was made
        self.lay_out(leaves, counts, pieces)

    @classmethod
    def of(cls, text: str, count: Remembered) -> TokenTree:
        out = cls([], [], [], count)
        out.lay_out(*out.cut(PRE_TOKENS.findall(text)))
        return out

    def cut(self, pieces: list[str]) -> tuple[list[str], list[int], list[int]]:
        """Leaves of LEAF pre-tokens: texts, token counts, numbers of pre-tokens."""
        tokens = list(map(self.count.__getitem__, pieces))
        at = range(0, len(pieces), LEAF)
        return ["".join(pieces[i : i + LEAF]) for i in at], [sum(tokens[i : i + LEAF]) for i in at], [len(pieces[i : i + LEAF]) for i in at]

    def lay_out(self, leaves: list[str], counts: list[int], pieces: list[int]) -> None:
        self.leaves, self.pieces = leaves, pieces
        self.size = 1
        while self.size < len(leaves):
            self.size *= 2
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        self.chars[self.size : self.size + len(leaves)] = map(len, leaves)
        self.tokens[self.size : self.size + len(leaves)] = counts
        for node in range(self.size - 1, 0, -1):
            self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
            self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    @property
    def text(self) -> str:
        return "".join(self.leaves)

    def find(self, place: int) -> tuple[int, int]:
        """(leaf that holds the character at ``place``, where that leaf starts)."""
        node, start = 1, 0
        while node < self.size:
            node *= 2
            if place >= start + self.chars[node]:
                start += self.chars[node]
                node += 1
        return node - self.size, start

    def put(self, leaf: int, text: str, tokens: int, pieces: int) -> None:
        self.leaves[leaf], self.pieces[leaf] = text, pieces
        node = leaf + self.size
        more_chars, more_tokens = len(text) - self.chars[node], tokens - self.tokens[node]
        while node:
            self.chars[node] += more_chars
            self.tokens[node] += more_tokens
            node //= 2

    def edit(self, start: int, end: int, replacement: str) -> None:
        """Replace the characters from start to end (exclusive); places beyond the text are its end."""
        n = self.n_chars
        start = min(max(0, start), n)
        end = min(max(start, end), n)
        if not n:
            self.encoded += len(pieces := PRE_TOKENS.findall(replacement))
            self.lay_out(*self.cut(pieces))
            return
        first, at = self.find(min(max(0, start - AHEAD), n - 1))
        last, last_at = self.find(min(end, n - 1))
        old = "".join(self.leaves[first : last + 1])
        new = old[: start - at] + replacement + old[end - at :]
        pieces = None
        while pieces is None:
            ahead, after = last + 1, ""
            while ahead < len(self.leaves) and len(after) < AHEAD:
                after += self.leaves[ahead]
                ahead += 1
            pieces = self.until(new, new + after)
            if pieces is None:  # a pre-token goes on in the next leaf that has text
                last += 1
                while not self.leaves[last]:
                    last += 1
                new += self.leaves[last]
        self.encoded += len(pieces)
        slots = last - first + 1
        if len(pieces) > FULL * slots:
            texts, counts, sizes = self.cut(pieces)
            rest = range(last + 1, len(self.leaves))
            self.lay_out(
                self.leaves[:first] + texts + self.leaves[last + 1 :],
                self.tokens[self.size : self.size + first] + counts + [self.tokens[self.size + i] for i in rest],
                self.pieces[:first] + sizes + self.pieces[last + 1 :],
            )
            return
        each = -(-len(pieces) // slots)
        for slot in range(slots):
            part = pieces[slot * each : (slot + 1) * each]
            self.put(first + slot, "".join(part), sum(map(self.count.__getitem__, part)), len(part))

    @staticmethod
    def until(text: str, context: str) -> list[str] | None:
        """Pre-tokens of ``text`` within its context; None if none ends where the text does."""
        pieces, at = [], 0
        for m in PRE_TOKENS.finditer(context):
            if m.end() > len(text):
                break
            pieces.append(m.group())
            at = m.end()
        return pieces if at == len(text) else None

    def state(self) -> tuple[bytes, bytes, bytes]:
        """Characters, tokens and pre-tokens of the leaves, to be kept beside the text."""
        n = len(self.leaves)
        return tuple(np.array(x, "<i4").tobytes() for x in (self.chars[self.size : self.size + n], self.tokens[self.size : self.size + n], self.pieces))

    @classmethod
    def restored(cls, text: str, state: tuple[bytes, bytes, bytes], count: Remembered) -> TokenTree:
        """The tree of a text from its state; nothing is encoded."""
        chars, tokens, pieces = (np.frombuffer(x, "<i4").tolist() for x in state)
        ends = np.cumsum(chars).tolist()
        return cls([text[e - n : e] for e, n in zip(ends, chars)], tokens, pieces, count)


STATE = ["leaf_chars", "leaf_tokens", "leaf_pieces"]
TREE = "text string, " + ", ".join(f"{c} binary" for c in STATE) + ", n_tokens long"
EDITS = "array<struct<start:int,end:int,replacement:string>>"


def _tree_columns(trees: list[TokenTree]) -> list[pa.Array]:
    states = [t.state() for t in trees]
    return [
        pa.array([t.text for t in trees], pa.string()),
        *(pa.array([s[k] for s in states], pa.binary()) for k in range(3)),
        pa.array([t.n_tokens for t in trees], pa.int64()),
    ]


def token_trees(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text (null: empty), the state of its tree (STATE) and n_tokens, to be kept for later edits."""
    ship_package(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        count = counter(path)
        for batch in slices(batches):
            trees = [TokenTree.of(t or "", count) for t in batch.column(1).to_pylist()]
            count.turn()
            yield pa.RecordBatch.from_arrays([batch.column(0), *_tree_columns(trees)], ["id", "text", *STATE, "n_tokens"])

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, f"id {kind}, {TREE}").withColumnRenamed("id", id_col)


def with_edits(trees: DataFrame, edits: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``trees`` plus ``edits``: those of a table (id, seq, start, end, replacement), by seq. Each
    edit's places are those of the text after the edits before it. Edits without a tree are left out."""
    listed = edits.groupBy(F.col(id_col).alias("_id")).agg(F.sort_array(F.collect_list(F.struct("seq", "start", "end", "replacement"))).alias("_edits"))
    listed = listed.select("_id", F.transform("_edits", lambda e: F.struct(e["start"].cast("int").alias("start"), e["end"].cast("int").alias("end"), e["replacement"].alias("replacement"))).alias("edits"))
    return trees.join(listed, F.col(id_col) == F.col("_id"), "left").drop("_id")


def edited(trees: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """Trees (see token_trees) after the edits of their column ``edits``, with n_before and
    n_encoded: the tokens before, and how many pre-tokens had to be encoded. A null list or
    replacement is an empty one; an edit with a null place is left out."""
    ship_package(trees.sparkSession)
    kind = trees.schema[id_col].dataType.simpleString()

    def run(batches):
        count = counter(path)
        for batch in slices(batches):
            before, done = batch.column(5).to_pylist(), []
            columns = [batch.column(k).to_pylist() for k in (1, 2, 3, 4, 6)]
            for text, *state, edits in zip(*columns):
                tree = TokenTree.restored(text, state, count)
                for e in edits or ():
                    if e["start"] is not None and e["end"] is not None:
                        tree.edit(e["start"], e["end"], e["replacement"] or "")
                done.append(tree)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *_tree_columns(done), pa.array(before, pa.int64()), pa.array([t.encoded for t in done], pa.int64())],
                ["id", "text", *STATE, "n_tokens", "n_before", "n_encoded"],
            )

    narrow = trees.select(F.col(id_col).alias("id"), "text", *STATE, "n_tokens", "edits")
    return narrow.mapInArrow(run, f"id {kind}, {TREE}, n_before long, n_encoded long").withColumnRenamed("id", id_col)


# Things that a corpus is cleaned of after it was counted: addresses and long numbers.
PRIVATE = regex.compile(r"(?<![\w.+-])[\w.+-]++@[\w-]++(?:\.[\w-]++)+|\d(?:[ .-]?\d){8,}")


def cleaning(text: str) -> list[Edit]:
    """Edits that mask addresses and long numbers and drop lines equal to an earlier one, from the
    last to the first, so that no edit moves another."""
    out = [(m.start(), m.end(), "[masked]") for m in PRIVATE.finditer(text)]
    seen, at, dropped = set(), 0, []
    for line in text.split("\n"):
        if at and line in seen and line.strip():
            dropped.append((at - 1, at + len(line), ""))
        seen.add(line)
        at += len(line) + 1
    spans = iter(dropped)
    span, kept = next(spans, None), []
    for e in sorted(out):  # what a dropped line holds needs no mask
        while span and span[1] <= e[0]:
            span = next(spans, None)
        if not (span and e[0] < span[1] and span[0] < e[1]):
            kept.append(e)
    return sorted(kept + dropped, reverse=True)


def counts_after(
    docs: DataFrame, path: str, rule: Callable[[str], Iterable[Edit]] = cleaning, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """id, n_chars, n_tokens, n_pieces of every text, and after the edits of ``rule``: n_edits,
    edited_chars, edited_tokens, n_encoded (pre-tokens that the edits made anew).

    Trees and edits in one pass, without a shuffle. Null texts count as empty; rows are independent.
    """
    ship_package(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["n_chars", "n_tokens", "n_pieces", "n_edits", "edited_chars", "edited_tokens", "n_encoded"]

    def run(batches):
        count = counter(path)
        for batch in slices(batches):
            rows = []
            for text in batch.column(1).to_pylist():
                tree = TokenTree.of(text or "", count)
                row = [tree.n_chars, tree.n_tokens, sum(tree.pieces)]
                edits = rule(text or "")
                for e in edits:
                    tree.edit(*e)
                rows.append((*row, len(edits), tree.n_chars, tree.n_tokens, tree.encoded))
            count.turn()
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in zip(*rows))], ["id", *names])

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, f"id {kind}, " + ", ".join(f"{n} long" for n in names)).withColumnRenamed("id", id_col)
