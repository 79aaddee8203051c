"""Operator 1: byte-pair encoding and decoding over a trie of distinct words.

The encoding of a word's prefix ends in one token that is fixed by the prefix alone, and the
tokens before it are the encoding of a shorter prefix. So each trie node needs only its last
token: the longest vocabulary entry that ends there and may follow the last token of the node
where it starts. A depth-first walk over the sorted distinct words of a batch visits each
shared prefix once; reading the last tokens backwards from a word's end gives its encoding.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import quoted, small_batches, whole

# Fixed values of the public byte-level pre-tokenizer.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of text that are walked as one trie; bounds a worker's memory.
BATCH_CHARS = 4_000_000
#: Words that a worker remembers from batch to batch.
KEPT_WORDS = 100_000


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def check_kind(spec: dict) -> None:
    """Refuses files of other kinds: what is encoded here is byte-level BPE, words split by WORDS, nothing normalised."""
    model, before = spec.get("model", {}), spec.get("pre_tokenizer") or {}
    plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    by_words = before.get("type") == "ByteLevel" and not before.get("add_prefix_space", True) and before.get("use_regex", True)
    if model.get("type", "BPE") != "BPE" or not plain or not by_words or spec.get("normalizer"):
        raise ValueError("not a file of byte-level BPE over the usual words")


class WordBpe:
    """The vocabulary of one tokenizer file, with trie encoding and table decoding."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        check_kind(spec)
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.ids = {raw(t): i for t, i in spec["model"]["vocab"].items() if t not in self.added}
        self.rank: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int, int]] = {}
        for order, pair in enumerate(spec["model"]["merges"]):
            left, right = (raw(x) for x in (pair.split(" ") if isinstance(pair, str) else pair))
            a, b, made = self.ids[left], self.ids[right], self.ids[left + right]
            self.rank[a, b] = order
            self.halves.setdefault(made, (order, a, b))
        self.automaton()
        self.bytes_of = [b""] * (1 + max([*self.ids.values(), *self.added.values()]))
        for token, i in self.ids.items():
            self.bytes_of[i] = token
        for token, i in self.added.items():
            self.bytes_of[i] = token.encode()
        self.text_of = [str(i) for i in range(len(self.bytes_of))]
        self.words = regex.compile(WORDS)
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.follows: dict[int, bool] = {}
        self.kept: dict[str, tuple[int, ...]] = {}

    def may_follow(self, a: int, b: int) -> bool:
        """Whether merging the bytes of a and b from scratch gives a, b again.

        Undoes merges at the seam, youngest first; if the two halves that meet have a merge
        that would have run earlier than those undone so far, the seam would have closed.
        """
        never = len(self.rank)
        limit = never
        while True:
            if self.rank.get((a, b), never) < limit:
                return False
            up, down = self.halves.get(a), self.halves.get(b)
            if up is None and down is None:
                return True
            # A merge on the left of equal order runs first, so the seam must be judged before it.
            if down is None or (up is not None and up[0] > down[0]):
                limit, a = up[0], up[2]
            else:
                limit, b = down[0] + 1, down[1]

    def automaton(self) -> None:
        """Matches all vocabulary entries at once: for each state the entries that end there."""
        self.child: list[dict[int, int]] = [{}]
        own = [-1]
        depth = [0]
        for token, i in self.ids.items():
            at = 0
            for byte in token:
                if byte not in self.child[at]:
                    self.child[at][byte] = len(own)
                    self.child.append({})
                    own.append(-1)
                    depth.append(depth[at] + 1)
                at = self.child[at][byte]
            own[at] = i
        self.shorter = [0] * len(own)
        self.endings: list[tuple[tuple[int, int], ...]] = [()] * len(own)  # (token, length), longest first
        level = [0]
        while level:
            following = []
            for at in level:
                if at:
                    self.endings[at] = (((own[at], depth[at]),) if own[at] >= 0 else ()) + self.endings[self.shorter[at]]
                for byte, to in self.child[at].items():
                    up = self.shorter[at]
                    while up and byte not in self.child[up]:
                        up = self.shorter[up]
                    self.shorter[to] = self.child[up].get(byte, 0) if at else 0
                    following.append(to)
            level = following
        self.steps: dict[int, int] = {}

    def step(self, state: int, byte: int) -> int:
        """The automaton's next state."""
        at = state
        while at and byte not in self.child[at]:
            at = self.shorter[at]
        to = self.steps[state << 8 | byte] = self.child[at].get(byte, 0)
        return to

    def encode_words(self, words: list[bytes]) -> Iterator[tuple[int, ...]]:
        """Encodings of sorted distinct words: a depth-first walk of their trie."""
        follows, may, steps, endings = self.follows, self.may_follow, self.steps, self.endings
        if len(follows) > 1_000_000:
            follows.clear()
        # Of the nodes from the root to the current word's end: last token, its length, state.
        last, length, states = [-1], [0], [0]
        before = b""
        for word in words:
            shared = len(commonprefix((before, word)))
            del last[shared + 1 :], length[shared + 1 :], states[shared + 1 :]
            state, end = states[-1], shared
            for byte in word[shared:]:
                end += 1
                at = steps.get(state << 8 | byte)
                state = self.step(state, byte) if at is None else at
                for token, size in endings[state]:  # noqa: B007
                    if size == end:
                        break
                    pair = last[end - size] << 32 | token
                    fits = follows.get(pair)
                    if fits is None:
                        fits = follows[pair] = may(last[end - size], token)
                    if fits:
                        break
                last.append(token)
                length.append(size)
                states.append(state)
            back, at = [], len(word)
            while at:
                back.append(last[at])
                at -= length[at]
            yield tuple(back[::-1])
            before = word

    def pieces(self, text: str) -> list[str]:
        """Words of a text; an added token stands alone."""
        if self.split_added is None or not any(t in text for t in self.added):
            return self.words.findall(text)
        parts = self.split_added.split(text)
        return [w for i, part in enumerate(parts) for w in ([part] if i % 2 else self.words.findall(part))]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; all texts share one trie."""

        class Numbers(dict):
            def __missing__(self, word: str) -> int:
                n = self[word] = len(self)
                return n

        numbers = Numbers()
        number = numbers.__getitem__
        docs = [np.fromiter(map(number, self.pieces(t)), dtype=np.int32) for t in texts]
        table: list[tuple[int, ...]] = [()] * len(numbers)
        new = []
        for word, n in numbers.items():
            if word in self.added:
                table[n] = (self.added[word],)
            elif (known := self.kept.get(word)) is not None:
                table[n] = known
            else:
                new.append((word.encode("utf-8", "replace"), n, word))
        new.sort()
        for (_, n, word), got in zip(new, self.encode_words([w for w, _, _ in new]), strict=True):
            table[n] = got
            if len(self.kept) < KEPT_WORDS and len(word) < 24:
                self.kept[word] = got
        counts = np.fromiter(map(len, table), dtype=np.int64, count=len(table))
        flat = np.fromiter((i for ids in table for i in ids), dtype=np.int32, count=int(counts.sum()))
        starts = np.concatenate(([0], np.cumsum(counts)))
        out = []
        for doc in docs:
            n = counts[doc]
            ends = np.cumsum(n)
            total = int(ends[-1]) if len(ends) else 0
            out.append(flat[np.repeat(starts[doc] - (ends - n), n) + np.arange(total)])
        return out

    def decode(self, ids: np.ndarray | list[int]) -> str:
        """Text of ids, added tokens included; an unknown id gives nothing, broken UTF-8 U+FFFD."""
        table = self.bytes_of
        return b"".join([table[i] for i in ids if 0 <= i < len(table)]).decode("utf-8", "replace")


_loaded: dict[str, WordBpe] = {}


def tokenizer(path: str) -> WordBpe:
    """The worker's one copy of a tokenizer."""
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def slices(texts: list[str | None], most: int = BATCH_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` characters, one text at least."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t or "") > most:
            yield start, i
            start, size = i, 0
        size += len(t or "")
    if start < len(texts):
        yield start, len(texts)


def bpe_encode(df: DataFrame, path: str, text_col: str = "text", out: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """Adds `out`, an array<int> of token ids of the whole text, in one pass without a shuffle.

    Null and empty texts give an empty array; very long texts are encoded whole; repeated rows
    give equal arrays; an empty table gives an empty table. The columns of `keep` pass through,
    all if it is None; others are neither read nor sent back by the workers. A column named like
    `out` gives way to it.
    """
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() != out.lower()]
    small_batches(df.sparkSession)
    # Workers know columns by place: not every name can be handed to them.
    df = df.select(*(quoted(c).alias(f"_{i}") for i, c in enumerate(keep)), quoted(text_col).alias("_text"))
    schema = T.StructType([*df.schema.fields[:-1], T.StructField("_ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            values = [t or "" for t in batch.column(len(keep)).to_pylist()]
            for a, b in slices(values):
                ids = bpe.encode(values[a:b])
                ends = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns[:-1], lists], names=schema.names)

    return df.mapInArrow(run, schema).toDF(*keep, out)


def bpe_decode(df: DataFrame, path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds `out`, the text that the ids stand for; null ids give an empty text. A column named like `out` gives way to it."""

    @F.pandas_udf("string")
    def text_of(ids):
        import pandas as pd

        return pd.Series([tokenizer(path).decode([] if x is None else x) for x in ids], dtype=object)

    return df.withColumn(out, text_of(ids_col))


def bpe_round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes each whole text, decodes the ids, and returns digests of both.

    One row for each row of df: id, n_tokens, ids_sha256 (decimal ids joined by commas),
    decoded_sha256 (UTF-8). Null counts as empty: 0 tokens and the digests of nothing. Very long
    texts are worked on whole, repeated rows alike; an empty table gives an empty table; other
    columns don't matter.
    The ids don't leave the worker that makes them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        text_of, sha = bpe.text_of, hashlib.sha256
        for batch in batches:
            values = [t or "" for t in batch.column(1).to_pylist()]
            n, coded, decoded = [], [], []
            for a, b in slices(values):
                for ids in bpe.encode(values[a:b]):
                    ids = ids.tolist()
                    n.append(len(ids))
                    coded.append(sha(",".join([text_of[i] for i in ids]).encode()).hexdigest())
                    decoded.append(sha(bpe.decode(ids).encode("utf-8", "replace")).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())], names=["_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    small_batches(df.sparkSession)
    schema = f"_id {df.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return df.select(quoted(id_col).alias("_id"), whole(quoted(text_col)).alias("_text")).mapInArrow(run, schema).toDF(id_col, "n_tokens", "ids_sha256", "decoded_sha256")
