"""Byte-level BPE encoding and decoding by a traversal of the trie of a task's distinct words.

The encoding of a word's first i bytes ends in just one token, and what stands before that token is the encoding of
the bytes before it, since a list of tokens is an encoding if and only if each two neighbours are left alone when
merged by themselves. So a trie's node needs one state, the last token of its prefix, which follows from the states
of its ancestors; a word's ids are read off its path from the end. Prefixes that words share are computed once.

Every task encodes its own texts: the words new to it are sorted, which is the trie's depth-first order, and a stack
holds the states of the path. Nothing is shuffled, nothing depends on how often a word or a document occurs, and a
lost task costs only itself.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sunfold.llm.batches import slices

_KNOWN = 1_000_000  # distinct words that a task remembers before it forgets them
_PAIRS = 2_000_000  # pairs of tokens, likewise
_SLICE = 2 << 20  # bytes of text that are encoded at once

#: The pattern that byte-level models split texts by; a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# Characters whose class is the same in every Unicode version in use; texts with others are split by the library itself,
# whose tables may be older than those of `regex`.
_SETTLED = re.compile("[\x00-՗‐-⁤₠-₹←-⏳─-⛿　-〿ぁ-ゖゝ-ヿ一-鿋가-힣！-～]*")


def _byte_of_char() -> dict[str, int]:
    """The byte that each character of byte-level vocabularies stands for: itself if it is visible Latin-1, else from 256 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """A byte-level BPE model in the tokenizers library's JSON: encodes words and texts, decodes ids.

    special: whether the strings of added tokens inside texts are those tokens, as the library has it by default, or plain
    text. ValueError for a model with a normalizer, another pre-tokenizer, dropout, affixes or added tokens that take in their surroundings."""

    def __init__(self, spec: str, special: bool = True):
        import regex
        from tokenizers import Tokenizer

        x = json.loads(spec)
        model, pre, added = x["model"], x.get("pre_tokenizer") or {}, x.get("added_tokens") or []
        plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges", "fuse_unk"))
        if not plain or x.get("normalizer") or pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space") or any(a[k] for a in added for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("only plain byte-level models can be traversed")
        byte = _byte_of_char()
        as_bytes = lambda s: bytes(map(byte.__getitem__, s))
        names = {a["id"]: a["content"].encode() for a in added}
        self.bytes_of = [b""] * (1 + max([*model["vocab"].values(), *names]))
        for s, i in model["vocab"].items():
            self.bytes_of[i] = names[i] if i in names else as_bytes(s)
        for i, s in names.items():
            self.bytes_of[i] = s
        self.id_of = {as_bytes(s): i for s, i in model["vocab"].items() if i not in names}
        self.rank: dict[int, int] = {}  # of a merge, by its two tokens
        self._halves = {i: (-1, -1, -1) for i in range(len(self.bytes_of))}  # of a token: its merge's rank, its left and right part
        for at, m in enumerate(model["merges"]):
            x, y = (self.id_of[as_bytes(h)] for h in (m.split(" ") if isinstance(m, str) else m))
            made = self.id_of[self.bytes_of[x] + self.bytes_of[y]]
            self.rank.setdefault(x << 32 | y, at)
            if self._halves[made][0] < 0:
                self._halves[made] = (at, x, y)
        if any(bytes([b]) not in self.id_of for b in range(256)):
            raise ValueError("a byte has no token")
        # a token that merges don't build from its own bytes occurs in no encoding
        self.built = {s: i for s, i in self.id_of.items() if len(s) == 1}
        for made, (at, x, y) in sorted(self._halves.items(), key=lambda h: h[1][0]):
            if at >= 0 and self.bytes_of[x] in self.built and self.bytes_of[y] in self.built and self._uncrossed(x, y, True):
                self.built[self.bytes_of[made]] = made
        self._longer: dict[bytes, list[int]] = {}  # by a token's last three bytes, the lengths above three, falling
        for x in {(t[-3:], len(t)) for t in self.built if len(t) > 3}:
            self._longer.setdefault(x[0], []).append(x[1])
        for lengths in self._longer.values():
            lengths.sort(reverse=True)
        self._tails: dict[bytes, tuple[tuple[int, int], ...]] = {}
        self.table = pa.array(self.bytes_of, pa.binary())
        self.sizes = np.fromiter(map(len, self.bytes_of), np.int64, len(self.bytes_of))
        self.special = {a["content"]: a["id"] for a in added} if special else {}
        self._marks = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._find = regex.compile(PATTERN).findall
        self._library = Tokenizer.from_str(spec).pre_tokenizer
        self._apart: dict[int, bool] = {}
        self.forget()

    def forget(self) -> None:
        """Drop the words seen so far."""
        self.number: dict[str | tuple[str], int] = {}
        self._flat, self._ends = np.empty(0, np.int32), np.zeros(1, np.int64)

    def _uncrossed(self, a: int, b: int, inside: bool = False) -> bool:
        """Whether no merge ever joins the end of token a with the start of token b, as their bytes are merged from the lowest rank
        on, the leftmost of equal ranks first. inside: but for a merge of a and b themselves.

        From both tokens back to their bytes, the later made is undone first; left and right are the tokens that touched, and each
        was there until the rank at which its own side took it."""
        left, right, left_until, right_until = a, b, 1 << 62, 1 << 62
        while True:
            rank = self.rank.get(left << 32 | right)
            if rank is not None and not inside and rank < left_until and rank <= right_until:
                return False
            inside = False
            (x, _, x_right), (y, y_left, _) = self._halves[left], self._halves[right]
            if x < 0 and y < 0:
                return True
            if x > y:
                left, left_until = x_right, x
            else:
                right, right_until = y_left, y

    def stay_apart(self, a: int, b: int) -> bool:
        """Whether the bytes of tokens a and b, merged by themselves, come out as a and b."""
        key = a << 32 | b
        known = self._apart.get(key)
        if known is None:
            if len(self._apart) >= _PAIRS:
                self._apart.clear()
            known = self._apart[key] = self._uncrossed(a, b)
        return known

    def words(self, text: str) -> list[str | tuple[str]]:
        """The words that merges stay within, in order; an added token is a tuple of its string."""
        if not self._marks or not self._marks.search(text):
            return self._split(text)
        out: list[str | tuple[str]] = []
        for i, part in enumerate(self._marks.split(text)):
            out += [(part,)] if i % 2 else self._split(part)
        return out

    def _split(self, text: str) -> list[str]:
        if _SETTLED.fullmatch(text):
            return self._find(text)
        return [text[a:b] for _, (a, b) in self._library.pre_tokenize_str(text)]

    def _tail(self, tail: bytes) -> tuple[tuple[int, int], ...]:
        """What a prefix that ends in these three bytes, or is these fewer, may end in: lengths, falling, each with its token, or -1
        if that depends on the bytes before."""
        longer = [(n, -1) for n in self._longer.get(tail, ())] if len(tail) == 3 else []
        known = self._tails[tail] = (*longer, *((n, self.built[tail[-n:]]) for n in range(len(tail), 0, -1) if tail[-n:] in self.built))
        return known

    def traverse(self, words: list[bytes]) -> Iterator[list[int]]:
        """The ids of each of the distinct, sorted words. The stack `last` has the last token of each prefix on the path from the trie's root."""
        token, tails, sizes, apart = self.built.get, self._tails, self.sizes.tolist(), self._apart
        before, last = b"", [-1]
        for word in words:
            shared, most = 0, min(len(word), len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del last[shared + 1 :]
            for depth in range(shared + 1, len(word) + 1):
                tail = word[depth - 3 if depth > 3 else 0 : depth]
                for n, t in tails.get(tail) or self._tail(tail):
                    if t < 0 and (n > depth or (t := token(word[depth - n : depth], -1)) < 0):
                        continue
                    if n == depth or apart.get(last[depth - n] << 32 | t) or self.stay_apart(last[depth - n], t):
                        last.append(t)
                        break
            ids, at = [], len(word)
            while at:
                ids.append(last[at])
                at -= sizes[last[at]]
            yield ids[::-1]
            before = word

    def _learn(self, words: list[str | tuple[str]]) -> None:
        """Number words that are new, and keep their ids."""
        new = [w for w in dict.fromkeys(words) if w not in self.number]
        if not new:
            return
        plain = sorted((w.encode(), w) for w in new if isinstance(w, str))
        marks = [w for w in new if not isinstance(w, str)]
        got = [*self.traverse([b for b, _ in plain]), *([self.special[w[0]]] for w in marks)]
        for w in (*(w for _, w in plain), *marks):
            self.number[w] = len(self.number)
        self._flat = np.concatenate([self._flat, np.fromiter(chain.from_iterable(got), np.int32)])
        self._ends = np.concatenate([self._ends, self._ends[-1] + np.cumsum(np.fromiter(map(len, got), np.int64, len(got)))])

    def encode(self, texts: list[str | None], lead: str = "") -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts with `lead` before each, one after another, and where each text's begin, with the end of the last. A null counts as
        empty; empty texts have no ids, nor a lead."""
        if len(self.number) > _KNOWN:
            self.forget()
        words = [self.words(lead + t) if t else [] for t in texts]
        flat = list(chain.from_iterable(words))
        self._learn(flat)
        use = np.fromiter(map(self.number.__getitem__, flat), np.int64, len(flat))
        n = self._ends[use + 1] - self._ends[use]
        ends = np.r_[0, np.cumsum(n)]
        ids = self._flat[np.repeat(self._ends[use] - ends[:-1], n) + np.arange(ends[-1])]
        return ids, ends[np.r_[0, np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))]]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        data = self.table.take(pa.array(ids)).buffers()[2] if len(ids) else None
        return data.to_pybytes().decode("utf-8", "replace") if data else ""


@lru_cache(maxsize=2)
def loaded(spec: str, special: bool = True) -> ByteBpe:
    """The model, kept by a Python worker from task to task."""
    return ByteBpe(spec, special)


def encode_decode(docs: DataFrame, model_path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded", special: bool = True) -> DataFrame:
    """docs with two more columns: the ids of each whole text (array of int) and the text decoded from them.

    Nulls and empty texts have no ids and decode to "". Repeated rows stay, each with its ids, in the order of docs. Columns of
    docs that are named like the two new ones are replaced; all others are carried, whatever their names. An empty table gives an
    empty result. A text may be of any length; a task holds one text, or 2 MB of shorter ones, with its ids. Strings of
    added tokens are those tokens if `special`, else plain text."""
    spec = open(model_path, encoding="utf-8").read()  # on the driver; executors get the text
    ByteBpe(spec, special)
    docs = docs.drop(ids, decoded) if text not in (ids, decoded) else docs
    at = f"c{docs.columns.index(text)}"
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    schema = T.StructType([*plain.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(spec, special)
        for batch in batches:
            for part in slices(batch, at, _SLICE, 2000):
                got, starts = bpe.encode(part[at].to_pylist())
                back = [bpe.decode(got[a:b]) for a, b in zip(starts, starts[1:], strict=False)]
                lists = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(got))
                yield pa.record_batch([*part.columns, lists, pa.array(back, pa.string())], [*part.schema.names, "ids", "decoded"])

    return plain.mapInArrow(run, schema).toDF(*docs.columns, ids, decoded)
