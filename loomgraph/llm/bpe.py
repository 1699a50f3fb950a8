"""Byte-level BPE encoding and decoding with a segment tree over adjacent pair ranks.

Over the parts of a pre-token lies a segment tree whose leaves are the ranks of adjacent pairs; the root is the lowest rank, and going down to the left child where that holds it finds its leftmost pair. A merge changes three leaves, each in logarithmic
time, until the root holds no rank. So a run of any length without white space costs n log n. Every pre-token that a worker doesn't remember goes through a tree.
Pre-tokens come from the tokenizer file's pattern, special tokens are split out first, as the tokenizers library does. The file is a parameter and is read on the executors.

Defined cases: a null text counts as empty and has no tokens; the digest of no ids is that of the empty string; texts of any length are encoded whole; repeated rows each get their result;
an empty table gives an empty one; further columns are kept (encode) or ignored (digests).
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.sources.tables import spread

from .common import map_arrow

#: Bytes of the pre-tokens, with their ids, that a worker remembers, and their length in characters at most; what an entry takes besides both.
CACHE_BYTES, CACHE_CHARS, ENTRY_BYTES = 224 << 20, 48, 200
#: The byte-level pre-tokenizer's pattern, a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII).findall
NONE = 1 << 62


def byte_chars() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else one from 256 on, in order."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b if b in shown else next(rest)) for b in range(256)]


def merge(ids: list[int], ranks: dict[int, int], merged: list[int]) -> list[int]:
    """ids after all merges; ranks: a pair, as one number, to its rank; merged: the id that the pair of each rank becomes. The tree is one array: node k has the children 2 k and 2 k + 1, leaf i is the rank of the pair that begins at part i, and a
    node is the least of both children."""
    n = len(ids)
    if n < 2:
        return ids
    get = ranks.get
    size = 1 << (n - 2).bit_length()
    tree = [NONE] * size
    tree += [get(a << 32 | b, NONE) for a, b in zip(ids, ids[1:], strict=False)]
    tree += [NONE] * (2 * size - len(tree))
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while (low := tree[1]) != NONE:
        k = 1
        while k < size:  # down to the leftmost leaf that holds the root's rank
            k *= 2
            if tree[k] != low:
                k += 1
        i = k - size
        j = after[i]
        ids[i] = now = merged[low]
        ids[j] = -1
        k = after[i] = after[j]
        changed = [(j, NONE)] if j < n - 1 else []
        if k < n:
            before[k] = i
            changed.append((i, get(now << 32 | ids[k], NONE)))
        else:
            changed.append((i, NONE))
        if (h := before[i]) >= 0:
            changed.append((h, get(ids[h] << 32 | now, NONE)))
        for at, least in changed:
            k = size + at
            while k and tree[k] != least:
                tree[k] = least
                k >>= 1
                if k:
                    a, b = tree[2 * k], tree[2 * k + 1]
                    least = a if a < b else b
    return [x for x in ids if x >= 0]


class ByteLevelBPE:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, chars = spec["model"], byte_chars()
        pre = spec["pre_tokenizer"] or {}
        plain = model["type"] == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        plain = plain and not (spec.get("normalizer") or model.get("ignore_merges") or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"))
        if not plain or any(t.get(k) for t in spec["added_tokens"] for k in ("lstrip", "rstrip", "single_word")):
            raise ValueError(f"{path} isn't a plain byte-level BPE")
        vocab = model["vocab"]
        self.bytes_ids = [vocab[c] for c in chars]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {vocab[a] << 32 | vocab[b]: r for r, (a, b) in reversed(list(enumerate(pairs)))}
        self.merged = [vocab[a + b] for a, b in pairs]
        back = {c: b for b, c in enumerate(chars)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        spelled = {i: bytes(back[c] for c in t) for t, i in vocab.items() if all(c in back for c in t)} | {i: t.encode() for t, i in self.special.items()}
        self.bytes_of = [spelled.get(i, b"") for i in range(max(spelled) + 1)]
        self.decimals = list(map(str, range(len(self.bytes_of))))
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else lambda t: [t]
        self.any_word, self.cache, self.older = regex.compile(PATTERN).findall, {}, {}
        self.known = {t: array("I", [i]).tobytes() for t, i in self.special.items()}
        self.bytes = 0

    def word(self, w: str) -> bytes:
        """The ids of a pre-token that is not in the younger half of the memory: from the older half, or merged. When the younger half is full it becomes the older."""
        found = self.older.get(w)
        if found is None:
            found = array("I", merge(list(map(self.bytes_ids.__getitem__, w.encode())), self.ranks, self.merged)).tobytes()
        if len(w) <= CACHE_CHARS:
            self.cache[w] = found
            self.bytes += ENTRY_BYTES + 2 * len(w) + len(found)
            if self.bytes > CACHE_BYTES // 2:
                self.older, self.cache, self.bytes = self.cache, {}, 0
        return found

    def words(self, text: str) -> list[str]:
        """Pre-tokens. In ASCII the pattern's classes are spelled out for the faster engine; its white space is the same there."""
        return _ASCII_WORDS(text) if text.isascii() else self.any_word(text)

    def encode(self, text: str) -> list[int]:
        out = []
        for part in self.split(text) if self.special else [text]:
            if part in self.known:
                out.append(self.known[part])
                continue
            words = self.words(part)
            found = list(map(self.cache.get, words))
            if None in found:
                word = self.word
                found = [x if x is not None else self.cache.get(w) or word(w) for w, x in zip(words, found, strict=True)]
            out += found
        return array("I", b"".join(out)).tolist()

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(2)
def tokenizer(path: str) -> ByteLevelBPE:
    return ByteLevelBPE(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """docs with ids (array of int) for every row; a column of that name is replaced."""
    own = [c for c in docs.columns if c.lower() != "ids"]

    def run(batches):
        bpe = tokenizer(path)
        for b in batches:
            i = b.schema.names.index("text")
            ids = pa.array([bpe.encode(x.as_py() or "") for x in b.column(i)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns, ids], [*b.schema.names, "ids"])

    schema = docs.select(*own).schema
    return map_arrow(docs.select(*own), run, schema.add("ids", T.ArrayType(T.IntegerType())))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row: encoded, then the ids are decoded to a text again, whatever the text was."""

    def run(batches):
        bpe = tokenizer(path)
        for b in batches:
            n, sha, back = [], [], []
            for x in b.column(1):
                ids = bpe.encode(x.as_py() or "")
                n.append(len(ids))
                sha.append(hashlib.sha256(",".join(map(bpe.decimals.__getitem__, ids)).encode()).hexdigest())
                back.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_arrow(spread(docs.select(F.col("doc_id").cast("long"), "text")), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
