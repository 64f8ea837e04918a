"""Token-ID output: whole texts encoded to Parquet list columns, in ascending document order.

File format: Parquet, columns (doc_id, n_tokens int, tokens array<int>). Files are range-partitioned and
sorted by doc_id, so file order and row order together are document order. Token ids are
dictionary-encoded, ids and counts delta-encoded (writer version 2); row groups and pages have a set
size and the column and page indexes that Parquet writes let a reader fetch the tokens of some documents,
or the metadata columns alone, without the rest.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from codecs import charmap_decode
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from planloom.llm.common import kept, map_batches, texts_in, work_path

END_ID = 2
#: Words whose ids a Python worker keeps, in each of two generations: some 100 MB for every 250,000. Fewer only cost time.
CACHE_WORDS = 600_000
FORMAT = {
    "parquet.writer.version": "v2",
    "parquet.enable.dictionary": "true",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "compression": "snappy",
}


#: Byte-level vocabularies write printable Latin-1 bytes as themselves and the others as letters from U+0100 on.
_UNPRINTED = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)]
BYTE_LETTERS = "".join(chr(0x100 + _UNPRINTED.index(b) if b in _UNPRINTED else b) for b in range(256))


#: The kind of tokenizer whose texts may be cut into words: white space is dropped, letters are lowered, pieces are split off (fixed values of the format).
WORD_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
WORD_SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
WORD_PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [WORD_SPLIT, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}


def takes_words(tokenizer_path: str) -> bool:
    """Whether a text's ids are those of its words in turn, by what the tokenizer's file says of itself."""
    with open(tokenizer_path, encoding="utf-8") as f:
        said = json.load(f)
    model = said["model"]
    plain = model.get("type", "BPE") == "BPE" and model.get("dropout") is None and model.get("end_of_word_suffix") == "</w>" and model.get("continuing_subword_prefix") is None and not model.get("byte_fallback") and not model.get("ignore_merges")
    added = all(x["content"].startswith("<|") and not x["lstrip"] and not x["rstrip"] and not x["single_word"] and not x["normalized"] for x in said["added_tokens"])
    return plain and added and said["normalizer"] == WORD_NORMALIZER and said["pre_tokenizer"] == WORD_PRE_TOKENIZER


class _Recent:
    """Values for keys, made where lacking and kept if used of late: at most two generations of ``size`` keys, and those of one call."""

    def __init__(self, size: int, make):
        self.size, self.make, self.new, self.old = size, make, {}, {}

    def get(self, key):
        value = self.new.get(key)
        return self.old.get(key) if value is None else value

    def __call__(self, keys: list) -> list:
        """The values of distinct ``keys``; ``make`` gives those of a list of keys as a map, which may hold more."""
        if len(self.new) > self.size:
            self.old, self.new = self.new, {}
        values = list(map(self.new.get, keys))
        lacking = [i for i, value in enumerate(values) if value is None]
        for i in lacking:
            value = self.old.get(keys[i])
            if value is not None:
                self.new[keys[i]] = values[i] = value
        lacking = [i for i in lacking if values[i] is None]
        if lacking:
            self.new.update(self.make([keys[i] for i in lacking]))
            for i in lacking:
                values[i] = self.new[keys[i]]
        return values


#: Bytes of UTF-8 texts; LEAD and TRAIL together are a letter of Latin-1. OTHER: apostrophes, openings of special tokens, control characters and all other characters.
BLANK, LETTER, DIGIT, PUNCT, LEAD, TRAIL, OTHER = range(7)


def _byte_kinds() -> np.ndarray:
    kinds = np.full(256, OTHER, np.uint8)
    for kind, chars in ((PUNCT, bytes(range(0x21, 0x7F))), (DIGIT, b"0123456789"), (LETTER, bytes(c for c in range(128) if chr(c).isalpha())), (OTHER, b"'<"), (BLANK, b" \t\n\x0b\x0c\r")):
        kinds[list(chars)] = kind
    kinds[0x80:0xC0] = TRAIL
    kinds[[0x97, 0xB7]] = OTHER  # as second bytes, the signs for times and divided by
    kinds[0xC3] = LEAD
    return kinds


BYTE_KINDS = _byte_kinds()


def units(data: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Where the units of ``data`` begin, and the units. ``data`` holds bytes of texts that begin at ``firsts``; it is cut at white space only.

    A unit is a lowered piece, or the whole of a word with a byte that is OTHER, as it is.
    """
    kind = BYTE_KINDS[data]
    blank, first = kind == BLANK, np.zeros(len(data), bool)
    first[firsts] = True
    start = ~blank
    start[1:] &= blank[:-1] | first[1:]
    at = np.flatnonzero(start)
    trail, odd, whole = kind == TRAIL, kind >= LEAD, np.zeros(len(data), bool)
    trail[:1] = False
    trail[1:] &= (kind[:-1] == LEAD) & ~first[1:]
    odd &= ~trail
    odd[:-1] &= ~trail[1:]
    kind[(kind >= LEAD) & ~odd] = LETTER
    if odd.any():
        whole[at[0] :] = np.repeat(np.logical_or.reduceat(odd, at), np.diff(at, append=len(data)))
    start[1:] |= ((kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)) & ~blank[1:] & ~whole[1:]
    capital = ((data >= 0x41) & (data <= 0x5A) | trail & (data <= 0x9E)) & ~whole
    at, body = np.flatnonzero(start), ~blank
    shown = (data + (capital.view(np.uint8) << 5))[body]
    offsets = np.append(np.flatnonzero(start[body]), len(shown)).astype(np.int32)
    return at, pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(shown)])


class Encoder:
    """Encodes UTF-8 texts, looking up the ids of words that it has met of late.

    Only for tokenizers whose file names just this normalizer and split (``takes_words``): they drop white space and
    never merge across it, or across ``PIECE``s, so a text's ids are the ids of its pieces in turn. With any other
    file, whole texts go to the library. Words with characters beyond Latin-1, where case and
    composition take care, with control characters, and words that may hold a special token, go to the
    tokenizer as they are.
    A column is cut into ``units`` as arrays of bytes, some ``SPAN`` bytes at a time, so each different unit of a span is looked up once.
    Tests compare all this with whole-text encoding.
    """

    PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
    SPACE = re.compile(rb"[ \t-\r]")
    LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
    SPAN = 2 << 20

    def __init__(self, tokenizer_path: str, words: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.model = self.tokenizer.model
        self.by_word = takes_words(tokenizer_path)
        self.words = _Recent(words, self._made)

    def _ids(self, text: str) -> bytes:
        return array("i", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _pieces(self, word: bytes) -> list[bytes] | None:
        """The lowered pieces of a word, or None if the tokenizer must see it as it is."""
        if word.isalpha():  # ASCII letters: one piece
            return [word.lower()]
        text = word.decode("utf-8", "replace")
        if not text.isprintable() or not word.isascii() and max(word) >= 0xC4 or b"<|" in word:
            return None
        text = text.lower()
        return [text.encode()] if text.isalpha() else [p.encode() for p in self.PIECE.findall(text)]

    def _made(self, words: list[bytes]) -> dict[bytes, bytes]:
        """The ids of ``words`` and of their pieces, those of pieces from the tokenizer's merge model alone, for byte-level tokenizers."""
        out, parts, plain = {}, {}, {}
        for word in words:
            if word.isalpha() and word.islower() or self.LETTERS.fullmatch(word):
                plain[word] = None
                continue
            pieces = self._pieces(word)
            if pieces is None:
                out[word] = self._ids(word.decode("utf-8", "replace"))
                continue
            if pieces != [word]:
                parts[word] = pieces
            for p in pieces:
                known = self.words.get(p)
                if known is None:
                    plain[p] = None
                else:
                    out[p] = known
        ids, ends, tokenize = [], [0], self.model.tokenize
        for piece in plain:
            text = piece.decode() if piece.isascii() else charmap_decode(piece, "strict", BYTE_LETTERS)[0]
            ids += [token.id for token in tokenize(text)]
            ends.append(len(ids))
        ids = array("i", ids).tobytes()
        out.update((piece, ids[4 * i : 4 * j]) for piece, i, j in zip(plain, ends, ends[1:]))
        out.update((word, b"".join([out[p] for p in pieces])) for word, pieces in parts.items())
        return out

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a binary Arrow column, null as empty, one text after the other, and how many each text has."""
        if not self.by_word:
            rows = [self._ids(text.decode("utf-8", "replace")) for text in texts_in(texts)]
            return np.frombuffer(b"".join(rows), np.int32), np.fromiter((len(x) // 4 for x in rows), np.int64, len(rows))
        texts = texts.fill_null(b"").cast(pa.large_binary())
        _, offsets, data = texts.buffers()
        at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if offsets else np.zeros(1, np.int64)
        data = np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]]
        at, ids, start = at - at[0], [np.empty(0, np.int32)], 0
        before = np.zeros(len(at), np.int64)
        while start < len(data):
            gap = self.SPACE.search(data, start + self.SPAN)
            stop = gap.start() if gap else len(data)
            found, words = units(data[start:stop], at[(at >= start) & (at < stop)] - start)
            words = words.dictionary_encode()
            values = self.words(words.dictionary.to_numpy(zero_copy_only=False).tolist())
            sizes = np.fromiter(map(len, values), np.int32, len(values)) // 4
            firsts, which = np.cumsum(sizes, dtype=np.int32) - sizes, words.indices.to_numpy()
            n = sizes[which]
            ends = np.cumsum(n, dtype=np.int32)
            total = int(ends[-1]) if len(ends) else 0
            ids.append(np.frombuffer(b"".join(values), np.int32)[np.arange(total, dtype=np.int32) + np.repeat(firsts[which] - ends + n, n)])
            before += np.append(0, ends)[np.searchsorted(found, at - start)]
            start = stop
        return np.concatenate(ids), np.diff(before)

    def __call__(self, texts: Iterable[bytes]) -> list[bytes]:
        """The ids of each text as 32-bit integers in the machine's order."""
        ids, sizes = self.column(pa.array(texts, pa.binary()))
        return [x.tobytes() for x in np.split(ids, np.cumsum(sizes)[:-1])] if len(sizes) else []


def tokenize(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", cache_words: int = CACHE_WORDS) -> DataFrame:
    """(``id_col``, n_tokens, tokens) for every row: the ids of the whole text, then ``end_id``."""

    def run(batches):
        encode = kept(Encoder, tokenizer_path, cache_words)
        for batch in batches:
            ids, sizes = encode.column(batch.column(1))
            ends = np.cumsum(sizes)
            ids, sizes = np.insert(ids, ends, end_id), (sizes + 1).astype(np.int32)
            tokens = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends + np.arange(1, len(ends) + 1))).astype(np.int32)), pa.array(ids))
            rows = pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), tokens], names=[id_col, "n_tokens", "tokens"])
            for start in range(0, rows.num_rows, 200):
                yield rows.slice(start, 200)

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(id_col, F.col(text_col).cast("binary")), run, f"`{id_col}` {kind}, n_tokens int, tokens array<int>", keeps=True)


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", mode: str = "errorifexists", cache_words: int = CACHE_WORDS) -> None:
    """Write the ids of every row of ``docs`` to ``path`` in ascending ``id_col`` order.

    Null texts are empty: they hold the end id alone. Null ids come first. Repeated ids stay together,
    ordered by their text. Other columns are ignored; an empty table writes files without rows.
    """
    ordered = docs.select(F.col(id_col), F.col(text_col)).repartitionByRange(id_col).sortWithinPartitions(id_col, text_col)
    tokenize(ordered, tokenizer_path, end_id, id_col, text_col, cache_words).write.options(**FORMAT).mode(mode).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The written rows. Select n_tokens alone, or filter by id, and only that is read."""
    return spark.read.parquet(path)


def token_digest(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """(``id_col``, start, n_tokens, ids_crc32) from the files at ``path``.

    ``start`` counts the ids of all rows before, in file order. File totals are read from the count
    column alone; their running sum is one short table (a row for each file), and the sum within a
    file is a window over that file's rows, so no task sees more than one file.
    """

    def run(batches):
        for batch in batches:
            lists = batch.column(2)
            offsets, ids = lists.offsets.to_numpy(), lists.values.to_numpy()
            data = memoryview(np.ascontiguousarray(ids, "<i4").view(np.uint8))
            sums = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(offsets).astype(np.int64)), pa.array(sums, pa.int64()), batch.column(3)], names=["id", "file", "n_tokens", "ids_crc32", "place"])

    files = read_tokens(spark, path)
    file = F.xxhash64(F.col("_metadata.file_path")).alias("file")
    kind = files.schema[id_col].dataType.simpleString()
    rows = map_batches(files.select(F.col(id_col).alias("id"), file, "tokens", F.col("_metadata.row_index").alias("place")), run, f"id {kind}, file bigint, n_tokens bigint, ids_crc32 bigint, place bigint")
    totals = files.select(F.col(id_col).alias("id"), file, F.col("_metadata.file_path").alias("path"), "n_tokens").groupBy("file", "path").agg(F.sum("n_tokens").alias("total"), F.min("id").alias("first"))
    before = Window.orderBy("first", "path").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("file", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("file").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(bases, "file").select(
        F.col("id").alias(id_col), (F.col("base") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).alias("start"), "n_tokens", "ids_crc32"
    )


def encode_and_read_back(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", cache_words: int = CACHE_WORDS) -> DataFrame:
    """Write ``docs`` as token files in the shared folder and return the digest of what is read back."""
    path = work_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer_path, end_id, id_col, text_col, cache_words=cache_words)
    return token_digest(docs.sparkSession, path, id_col)
