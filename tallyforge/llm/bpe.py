"""BPE encoding and decoding.

A pre-token's symbols stand in a linked list; a segment tree holds the rank of each adjacent pair at the place of its
left symbol. The root is the leftmost pair of lowest rank; a merge changes three leaves, each in logarithmic time, and
the loop ends when the root holds no pair. The few leaves of a short pre-token stand right under the root. So a pre-token of n bytes costs O(n log n), also if it has no white space
for a megabyte.

Texts are cut at white space, where no pre-token can begin before it, and what a piece encodes to is kept in a bounded
table per task, since most pieces repeat. Nothing is shuffled.

Defined cases: a null text counts as empty and gives no ids; repeated rows are encoded alike, each by itself; special
tokens spelled inside a text become their ids, as the library does by default. An empty table gives an empty one. A text of any
length is encoded whole, a slice of rows at a time; one piece without white space costs O(n log n). Of pairs with one rank the leftmost merges first. ``keep`` names the columns that
are carried; others are ignored, whatever their names, but none that is carried may be called token_ids or decoded.
"""

from __future__ import annotations

import functools
import itertools
import json
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import list_array, slices

#: No pair: larger than any rank with a place.
NONE = 1 << 62
#: Bits for a pair's place below its rank.
PLACE = 40
#: Symbols of a pre-token whose pairs stand right under the root of its tree.
FLAT = 48
#: Words and pieces kept per task, twice: a full table becomes the older one, from which what is asked for moves on.
WORDS, PIECES = 60_000, 30_000
#: Characters of text that are encoded and decoded at a time.
SLICE = 2_000_000


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    for extra, b in enumerate(b for b in range(256) if b not in letters):
        letters[b] = chr(256 + extra)
    return [letters[b] for b in range(256)]


def merge_under_root(symbols: list[int], rank_of: dict[int, int], merged: list[int]) -> list[int]:
    """The same as ``merge`` where a few leaves stand right under the root, which is their first minimum."""
    get, out = rank_of.get, symbols[:]
    ranks = [get(a << 17 | b, NONE) for a, b in itertools.pairwise(out)]
    while ranks and (top := min(ranks)) != NONE:
        i = ranks.index(top)
        del ranks[i], out[i]
        out[i] = new = merged[top]
        if i:
            ranks[i - 1] = get(out[i - 1] << 17 | new, NONE)
        if i < len(ranks):
            ranks[i] = get(new << 17 | out[i + 1], NONE)
    return out


def merge(symbols: list[int], rank_of: dict[int, int], merged: list[int]) -> list[int]:
    """Ids after all merges. rank_of: rank by left id << 17 | right id; merged: new id by rank."""
    return (merge_under_root if len(symbols) <= FLAT else merge_in_tree)(symbols, rank_of, merged)


def merge_in_tree(symbols: list[int], rank_of: dict[int, int], merged: list[int]) -> list[int]:
    """The same with a binary tree, whose cost of a merge is logarithmic."""
    n = len(symbols)
    if n < 2:
        return symbols
    size = 1 << (n - 2).bit_length() if n > 2 else 1
    tree = [NONE] * (2 * size)
    get = rank_of.get
    left = symbols[0]
    found = False
    for i in range(n - 1):
        right = symbols[i + 1]
        rank = get(left << 17 | right)
        if rank is not None:
            tree[size + i] = rank << PLACE | i
            found = True
        left = right
    if not found:
        return symbols
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
    symbols = symbols[:]
    mask = (1 << PLACE) - 1

    while (top := tree[1]) != NONE:
        i = top & mask
        j = after[i]
        symbols[i] = new = merged[top >> PLACE]
        symbols[j] = -1
        k = after[i] = after[j]
        changed = []
        if k < n:
            before[k] = i
            rank = get(new << 17 | symbols[k])
            changed.append((size + i, NONE if rank is None else rank << PLACE | i))
            changed.append((size + j, NONE))
        else:
            changed.append((size + i, NONE))
        if (h := before[i]) >= 0:
            rank = get(symbols[h] << 17 | new)
            changed.append((size + h, NONE if rank is None else rank << PLACE | h))
        for at, value in changed:  # each leaf, then its ancestors up to the first that stays as it was
            while tree[at] != value:
                tree[at] = value
                if at == 1:
                    break
                other = tree[at ^ 1]
                at >>= 1
                if other < value:
                    value = other
    return [s for s in symbols if s >= 0]


class Bpe:
    """A byte-level BPE tokenizer read from a vocabulary file of the ``tokenizers`` library.

    Two families are understood: with word ends (lower case, white space dropped) and with leading spaces.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for text, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = text
        self.vocab = vocab
        self.rank_of: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, (a, b) in enumerate(model["merges"]):
            self.rank_of[vocab[a] << 17 | vocab[b]] = rank
            self.merged.append(vocab[a + b])
        letters = byte_letters()
        self.byte_id = [vocab[c] for c in letters]
        self.last_id = [vocab[c + self.end] for c in letters]
        self.letters = letters
        self.special_at = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        if self.end:
            pattern = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        else:
            pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?![^\p{White_Space}])|\p{White_Space}+"
        self.pretokens: Callable[[str], list[str]] = regex.compile(pattern.replace(r"^\s", r"^\p{White_Space}")).findall

    def word(self, pretoken: str) -> list[int]:
        raw = pretoken.encode("utf-8", "replace")
        ids = [self.byte_id[b] for b in raw]
        if self.end:
            ids[-1] = self.last_id[raw[-1]]
        return merge(ids, self.rank_of, self.merged)

    def clean(self, text: str) -> str:
        """What the vocabulary's normalizer does, but for white space, which is dropped later."""
        if not self.end:
            return text
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # sigma is lowered without its context
        return text.lower()

    def sections(self, text: str) -> Iterator[tuple[str, int]]:
        """Stretches of ordinary text, each with the special id that follows it, or -1."""
        at = 0
        if self.special_at and "<|" in text:
            for m in self.special_at.finditer(text):
                yield text[at : m.start()], self.special[m[0]]
                at = m.end()
        yield text[at:], -1

    def pieces(self, text: str) -> list[str]:
        """The text, cut where a pre-token surely begins: before white space."""
        if _SEPARATORS.search(text):  # white space for Python, but not for the vocabulary's pattern
            return [text]
        if self.end:
            return text.split()
        if _RUNS.search(text):
            return _UNITS.findall(text)
        first, *rest = text.split(" ")
        return [first, *[" " + x for x in rest]]


_SEPARATORS = regex.compile(r"[\x1c-\x1f]")
_RUNS = regex.compile(r" \s|\s |^ | $")
_UNITS = regex.compile(r"\s*\S+|\s+$")


@functools.lru_cache(maxsize=4)
def load(path: str) -> Bpe:
    return Bpe(path)


class Kept(dict):
    """Results by string, bounded: computed when first asked for, and forgotten after two full tables."""

    def __init__(self, compute: Callable[[str], object], most: int):
        self.compute, self.most, self.older = compute, most, {}

    def __missing__(self, key: str):
        if len(key) > 100:  # a repeated one is rare
            return self.compute(key)
        out = self.older.get(key)
        if out is None:
            out = self.compute(key)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = out
        return out


class Encoder:
    """Ids of texts as raw 32-bit integers."""

    def __init__(self, bpe: Bpe):
        self.bpe = bpe
        self.word = Kept(lambda w: np.array(bpe.word(w), dtype="<i4").tobytes(), WORDS).__getitem__
        self.piece = Kept(lambda p: b"".join(map(self.word, bpe.pretokens(p))), PIECES).__getitem__

    def encode(self, text: str) -> bytes:
        bpe, parts = self.bpe, []
        for section, special in bpe.sections(text):
            parts += map(self.piece, bpe.pieces(bpe.clean(section)))
            if special >= 0:
                parts.append(np.array([special], dtype="<i4").tobytes())
        return b"".join(parts)


def decode_batch(ids: pa.ListArray, tokens: pa.Array, byte_level: bool) -> pa.Array:
    """Texts of lists of ids. Without a decoder of bytes, tokens are joined by one space, as the library does."""
    words = pa.ListArray.from_arrays(ids.offsets, tokens.take(ids.values))
    if not byte_level:
        return pc.binary_join(words, " ")
    back = {ord(c): b for b, c in enumerate(byte_letters())}
    return pa.array([bytes(back[ord(c)] for c in t).decode("utf-8", "replace") for t in pc.binary_join(words, "").to_pylist()], pa.string())


def encode_documents(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in ``keep``, then token_ids array<int> and decoded string, for every row of ``docs``."""
    source = docs.select(*keep, F.col(text).alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        encoder = Encoder(bpe)
        tokens = pa.array(bpe.tokens, pa.string())
        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            for a, b in slices(texts, SLICE):
                ids = list_array([encoder.encode(t) if t else b"" for t in texts[a:b]], pa.int32(), 4)
                rest = [batch.column(i).slice(a, b - a) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*rest, ids, decode_batch(ids, tokens, not bpe.end)], [*keep, "token_ids", "decoded"])

    return source.mapInArrow(run, f"{fields}, token_ids array<int>, decoded string")


def digests(encoded: DataFrame, *keep: str) -> DataFrame:
    """n_tokens and the digests of ids and decoded text."""
    return encoded.select(
        *keep,
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("token_ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
