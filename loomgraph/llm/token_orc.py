"""Token ids of documents in ORC files: stripes of integers in run-length encoding, row indexes, and Bloom filters on doc_id.

Rows (doc_id, start, n_tokens, ids) are dealt by ranges of doc_id and sorted, then encoded where they lie, and each range is one file. `start` counts the ids of the rows before in the same file; a small table of files, written last and
without which nothing is read, has how many ids the files before hold. So no pass over all tokens is needed to place one, files are written and read independently, and a reader of some doc_ids skips files, stripes and row groups by their
least and greatest ids and by the Bloom filters.

The tokenizers library encodes pieces between spaces and line feeds, which no token of such a vocabulary crosses; a worker remembers the ids of the latest pieces and words, each within a bound of bytes.

Defined cases: a null text is empty and has the end id alone; texts of any length are encoded whole; rows without doc_id come first; rows of one doc_id are ordered by a hash of their texts and may lie in several files; repeated rows each get
their place; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import byte_chars
from .common import map_arrow

#: Text bytes of a file, about, while there are enough files for all cores; bytes of the pieces, and of the words, that a worker remembers; what is longer than so many characters isn't remembered.
FILE_BYTES, PIECE_BYTES, WORD_BYTES, CACHE_CHARS = 128 << 20, 64 << 20, 192 << 20, 64
#: What a remembered piece takes besides its characters and ids.
ENTRY_BYTES = 200
OPTIONS = {"compression": "zstd", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "orc.row.index.stride": "1000", "orc.stripe.size": str(32 << 20)}
SCHEMA = "doc_id long, start long, n_tokens long, ids array<int>"


class Memory:
    """A dictionary of the latest entries, within `most` bytes: when its younger half is full, that becomes the older half, and what the older one had is forgotten."""

    def __init__(self, most: int):
        self.most = most
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.bytes = 0

    def put(self, key: str, found: bytes) -> None:
        if len(key) <= CACHE_CHARS:
            self.young[key] = found
            self.bytes += ENTRY_BYTES + len(key) + len(found)
            if self.bytes > self.most // 2:
                self.old, self.young, self.bytes = self.young, {}, 0


class Encoder:
    """Texts to ids as little-endian 32-bit integers. What is ASCII and Latin-1 letters, whose normal form is its lower case, is cut to words, which the library's model merges; any other text is cut at spaces and line feeds, and the pieces that are not so plain go
    through the whole library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if not _drops_white_space(spec):
            raise ValueError(f"{path}: its tokens may cross white space")
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.chars = {b: c for b, c in enumerate(byte_chars()) if chr(b) != c}
        self.pieces, self.words = Memory(PIECE_BYTES), Memory(WORD_BYTES)

    def _word(self, word: str) -> bytes:
        found = self.words.young.get(word) or self.words.old.get(word)
        if found is None:
            shown = word if word.isascii() else word.encode().decode("latin-1").translate(self.chars)
            found = array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()
        self.words.put(word, found)
        return found

    def _plainly(self, text: str) -> bytes:
        words = _words(text.lower())
        found = list(map(self.words.young.get, words))
        if None in found:
            word = self._word
            found = [x if x is not None else word(w) for w, x in zip(words, found, strict=True)]
        return b"".join(found)

    def _piece(self, piece: str) -> bytes:
        found = self.pieces.old.get(piece)
        if found is None:
            if _plain(piece) and not any(t in piece for t in self.special):
                found = self._plainly(piece)
            else:
                found = array("I", self.library.encode(piece, add_special_tokens=False).ids).tobytes()
        self.pieces.put(piece, found)
        return found

    def encode(self, text: str) -> bytes:
        if _plain(text) and not any(t in text for t in self.special):
            return self._plainly(text)
        pieces = text.replace("\n", " ").split(" ")
        found = list(map(self.pieces.young.get, pieces))
        if None in found:
            piece = self._piece
            found = [x if x is not None else piece(p) for p, x in zip(pieces, found, strict=True)]
        return b"".join(found)


#: ASCII without control characters but white space, and the letters of Latin-1 with a diacritic: composed already, and lower-cased one by one.
_plain = re.compile("[ -~\t-\r\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*").fullmatch
#: PATTERN for such text in lower case.
_words = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\\sa-z0-9\u00df-\u00f6\u00f8-\u00ff]+").findall


def _drops_white_space(spec: dict) -> bool:
    """Whether text may be cut at spaces and line feeds: white space is all one, a pattern that matches none of it keeps its matches alone, and nothing is added before, after or between."""
    steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
    normal = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
    split = bool(steps) and steps[0]["type"] == "Split" and steps[0]["behavior"] == "Removed" and steps[0]["invert"]
    level = len(steps) == 2 and steps[1]["type"] == "ByteLevel" and not steps[1]["add_prefix_space"] and not steps[1]["use_regex"]
    plain = normal == ["NFC", "Replace", "Lowercase"] and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or " " in t["content"] or "\n" in t["content"] for t in spec["added_tokens"])
    return split and level and plain and steps[0]["pattern"].get("Regex") == PATTERN


#: The pattern of the word vocabulary's pre-tokenizer, a fixed value: none of its matches holds white space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def write(docs: DataFrame, folder: str, path: str, end: int = 2) -> None:
    """docs (doc_id, text) to `folder`: token files under tokens, their table under files. `end` follows each document's ids."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    files = max(4 * spark.sparkContext.defaultParallelism, -(-size // FILE_BYTES))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("row")]
    rows = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(files, *order).sortWithinPartitions(*order)

    def run(batches):
        encode, start, tail = encoder(path).encode, 0, np.array([end], "<u4").tobytes()
        for b in batches:
            found = [encode(x.as_py()) + tail for x in b.column(1)]
            n = np.fromiter((len(x) // 4 for x in found), np.int64, len(found))
            after = np.cumsum(n)
            ids = pa.Array.from_buffers(pa.int32(), int(after[-1]) if len(n) else 0, [None, pa.py_buffer(b"".join(found))])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], after)), pa.int32()), ids)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(start + after - n), pa.array(n), lists], ["doc_id", "start", "n_tokens", "ids"])
            start += int(after[-1]) if len(n) else 0

    map_arrow(rows.select("doc_id", "text"), run, SCHEMA).write.options(**OPTIONS).orc(f"{folder}/tokens")
    own = _tokens(spark, folder).groupBy("file").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
    before = F.sum("tokens").over(Window.orderBy("file")) - F.col("tokens")  # a row for each file
    own.select("file", "docs", "tokens", before.alias("before"), "first_id", "last_id").coalesce(1).write.orc(f"{folder}/files")


def _tokens(spark: SparkSession, folder: str) -> DataFrame:
    # The name begins with the number of the range, in digits of fixed width, and so orders the files.
    return spark.read.schema(SCHEMA).orc(f"{folder}/tokens").withColumn("file", F.col("_metadata.file_name"))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids of every row. A filter on doc_id reaches the files' indexes and Bloom filters; without ids, their stripes aren't read."""
    files = spark.read.orc(f"{folder}/files").select("file", "before")
    return _tokens(spark, folder).join(F.broadcast(files), "file").select("doc_id", (F.col("before") + F.col("start")).alias("start"), "n_tokens", "ids")


def checksums(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (of the ids as little-endian 32-bit integers) of what read() gives."""

    def run(batches):
        for b in batches:
            ids = b.column(3)
            at, values = ids.offsets.to_numpy(), np.ascontiguousarray(ids.values.to_numpy(), "<i4")
            crc = [zlib.crc32(values[a:z]) for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            n = pa.array(np.diff(at).astype(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), n, pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return map_arrow(tokens.select("doc_id", "start", "n_tokens", "ids"), run, "doc_id long, start long, n_tokens long, ids_crc32 long")
