"""Sum-of-squares online packing of tokenised documents into fixed windows.

A document's full windows are cut off its front; what is left is placed whole at the fill level that
minimises the sum of squared counts of partially filled windows. A level array holds the counts, so
a placement looks at no window, only at levels. Each task packs its own documents: there is no
shuffle, and a task holds its partially filled windows only. When a task ends, the emptiest window is
dissolved again and again: its pieces are cut to fill others, at the levels that lower the sum of squares most, until
one window is left; that is closed at powers of two, so that hardly any padding remains.
"""

from __future__ import annotations

import sys
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import python_batches, table

WINDOW, END_ID = 2048, 1
TOKENIZER = "word_bpe_49k.json"

# ---------------------------------------------------------------- tokens


class _Chunks(dict):
    """Ids, as little-endian unsigned 32-bit numbers, of chunks between white space, with a bound on what is kept: some 200 MB in a worker.

    What was asked for lately stays: at MOST entries they become the old ones, and an old one that is asked for comes back.
    """

    MOST, LONGEST = 250_000, 32

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall  # fixed value: the vocabulary file's own pattern
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.bytes = {i: level.pre_tokenize_str(chr(i))[0][0] for i in range(256) if not chr(i).isspace()}
        self.words: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.old_words: dict[str, bytes] = {}

    def __missing__(self, chunk: str) -> bytes:
        if (out := self.old.get(chunk)) is None:
            if chunk.isalpha():
                out = self._word(chunk)
            elif chunk[:-1].isalpha() and chunk[-1] in ",.;:!?":
                out = self._word(chunk[:-1]) + self._word(chunk[-1])
            else:
                out = b"".join(map(self._word, self.split(chunk)))
        if len(chunk) <= self.LONGEST:
            if len(self) >= self.MOST:
                self.old = dict(self)
                self.clear()
            self[chunk] = out
        return out

    def _word(self, word: str) -> bytes:
        if (ids := self.words.get(word)) is not None:
            return ids
        if (ids := self.old_words.get(word)) is None:
            plain = word if word.isascii() and word.isprintable() else word.translate(self.bytes)
            ids = array("I", [t.id for t in self.model.tokenize(plain)])
            if sys.byteorder == "big":
                ids.byteswap()
            ids = ids.tobytes()
        if len(word) <= self.LONGEST:
            if len(self.words) >= self.MOST:
                self.old_words, self.words = self.words, {}
            self.words[word] = ids
        return ids


#: Characters for which the vocabulary's normaliser does more, or splits otherwise, than lower() and split() do.
_ODD = "\x1c\x1d\x1e\x1f"


@lru_cache(maxsize=2)
def _chunks(path: str) -> _Chunks:
    return _Chunks(path)


def word_bpe(path: str) -> Callable[[str], bytes]:
    """text -> ids as bytes, equal to Tokenizer.encode(text, add_special_tokens=False).ids.

    Latin-1 text goes by a cache of the chunks between white space, which the vocabulary never joins;
    any other text, or one that may hold a special token, goes to the library whole.
    """

    def encode(text: str) -> bytes:
        known = _chunks(path)
        try:
            text.encode("latin-1")
            plain = "<|" not in text and not any(c in text for c in _ODD)
        except UnicodeEncodeError:
            plain = False
        if plain:
            return b"".join(map(known.__getitem__, text.lower().split()))
        return np.array(known.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    return encode


# ---------------------------------------------------------------- packing


class SumOfSquares:
    """Windows of one task. Pieces are (document, start, ids as bytes); close() gets a closed window's pieces."""

    def __init__(self, window: int, close: Callable[[list], None]):
        self.window, self.close = window, close
        self.count = np.zeros(window + 1, np.int64)
        self.open: dict[int, list[list]] = {}

    def add(self, document: object, ids: bytes) -> None:
        n, at = len(ids) // 4, 0
        while n - at >= self.window:
            self.close([(document, at, ids[4 * at : 4 * (at + self.window)])])
            at += self.window
        if at < n:
            self._place((document, at, ids[4 * at :]), n - at)

    def _place(self, piece: tuple, size: int) -> None:
        count, top = self.count, self.window
        levels = np.flatnonzero(count[1 : top - size + 1]) + 1
        best, level = 2 * count[size] + 1, 0
        if len(levels):
            change = 2 * (count[levels + size] - count[levels]) + 2
            change[levels + size == top] -= 1
            i = len(change) - 1 - int(np.argmin(change[::-1]))  # ties: the fuller window
            if change[i] <= best:
                level = int(levels[i])
        if level:
            held = self.open[level].pop()
            count[level] -= 1
        else:
            held = []
        held.append(piece)
        if level + size == top:
            self.close(held)
        else:
            count[level + size] += 1
            self.open.setdefault(level + size, []).append(held)

    def finish(self, spare: int) -> None:
        """Close what is open: windows with at most spare padding as they are; the emptiest of the others is dissolved into those left, as long as there are two."""
        for level in range(self.window - spare, self.window):
            for pieces in self.open.pop(level, []):
                self.close(pieces)
            self.count[level] = 0
        while self.count.sum() > 1:
            low = int(np.flatnonzero(self.count)[0])
            self.count[low] -= 1
            for piece in self.open[low].pop():
                self._spread(piece, spare)
        for level in np.flatnonzero(self.count):
            self._halve(self.open.pop(int(level))[0], int(level))
        self.open, self.count = {}, np.zeros(self.window + 1, np.int64)

    def _spread(self, piece: tuple, spare: int) -> None:
        """Put a piece into open windows, cut to fill them where it can; a new window is opened only if there is none."""
        document, start, ids = piece
        while ids:
            n, count = len(ids) // 4, self.count
            levels = np.flatnonzero(count)
            if not len(levels):
                self._place((document, start, ids), n)
                return
            full = levels[self.window - levels <= n]
            if len(full):  # a filled window takes 2 * count - 1 off the sum
                best = len(full) - 1 - int(np.argmax(count[full][::-1]))
                level = int(full[best])
            else:
                change = 2 * (count[levels + n] - count[levels]) + 2
                level = int(levels[len(levels) - 1 - int(np.argmin(change[::-1]))])
            cut = min(n, self.window - level)
            held = self.open[level].pop()
            count[level] -= 1
            held.append((document, start, ids[: 4 * cut]))
            if self.window - level - cut <= spare:
                self.close(held)
            else:
                count[level + cut] += 1
                self.open.setdefault(level + cut, []).append(held)
            start, ids = start + cut, ids[4 * cut :]

    def _halve(self, pieces: list, left: int) -> None:
        """Close pieces of left ids together in windows that are powers of two."""
        held, room = [], 1 << (left.bit_length() - 1)
        for document, start, ids in pieces:
            while ids:
                cut, ids = ids[: 4 * room], ids[4 * room :]
                held.append((document, start, cut))
                n = len(cut) // 4
                start, room, left = start + n, room - n, left - n
                if not room:
                    self.close(held)
                    held, room = [], 1 << (left.bit_length() - 1) if left else 0


def pack(docs: DataFrame, doc_id: str, text: str, tokens: Callable[[str], bytes], window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Pack every row's ids, closed by end_id, into sequences of at most window ids; one row per piece.

    tokens: text -> ids as little-endian unsigned 32-bit bytes. A null text counts as empty and is
    packed as end_id alone; repeated rows and null ids are packed each; an empty table gives no rows; extra
    columns are left out. Sequence ids are task numbers and counts: unique, but not gapless.
    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.
    """
    python_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        out: list[tuple] = []
        serial = TaskContext.get().partitionId() << 32

        def close(pieces: list) -> None:
            nonlocal serial
            offset = 0
            for (key, total), start, ids in pieces:
                n = len(ids) // 4
                out.append((key, start, n, zlib.crc32(ids), total, serial, offset))
                offset += n
            serial += 1

        def drained() -> pa.RecordBatch:
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            columns = list(zip(*out, strict=True)) or [()] * 7
            made = pa.RecordBatch.from_arrays([pa.array(columns[0], id_type), *[pa.array(c, pa.int64()) for c in columns[1:]]], names)
            out.clear()
            return made

        packer = SumOfSquares(window, close)
        id_type = None
        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = tokens(text or "") + end
                packer.add((key, len(ids) // 4), ids)
            yield drained()
        packer.finish(window // 100)
        if out:
            yield drained()

    return rows.mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(TOKENIZER))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text", word_bpe(vocabulary()))
