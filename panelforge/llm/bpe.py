"""BPE encoding and decoding with a contiguous array of ranks.

A word is an array of part boundaries and, beside it, the rank of the pair that starts at each
part. The smallest rank is found by a scan, its boundary deleted and the two neighbouring ranks
looked up again, until no pair has a rank. Words are short, so the scan over one small array
beats a heap. Each task keeps a bounded cache of encoded words.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .vocabulary import WORD_BPE, byte_alphabet, default_path, has_new, library_classes, vocabulary_json

CACHE_WORDS = 200_000
#: Bytes of a word that is merged by scans, and that is worth a place in the cache.
SHORT = 128
BATCH_BYTES = 4_000_000
#: Larger than any rank: no such pair.
NONE = 1 << 40


class WordBpe:
    """A word-end BPE vocabulary with its normalisation, word pattern and special tokens."""

    def __init__(self, vocabulary: str, cache_words: int = CACHE_WORDS):
        spec = json.loads(vocabulary)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.ids = dict(model["vocab"])
        self.ranks = {tuple(pair): i for i, pair in enumerate(model["merges"])}
        self.alphabet = byte_alphabet()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in (self.ids | self.special).items()}
        longest_first = sorted(self.special, key=len, reverse=True)
        self.split_special = regex.compile("|".join(regex.escape(s) for s in longest_first)) if longest_first else None
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.normalizer = Tokenizer.from_str(vocabulary).normalizer
        self.cache: dict[str, tuple[int, bytes, str]] = {}
        self.cache_words = cache_words

    def parts(self, word: str) -> list[str]:
        """The tokens of one word."""
        parts = [self.alphabet[b] for b in word.encode()]
        parts[-1] += self.suffix
        if len(parts) > SHORT:
            return self._long(parts)
        rank = self.ranks.get
        adjacent = [rank(p, NONE) for p in zip(parts, parts[1:])]
        while adjacent:
            least = min(adjacent)
            if least == NONE:
                break
            i = adjacent.index(least)
            parts[i] += parts.pop(i + 1)
            adjacent.pop(i)
            if i < len(adjacent):
                adjacent[i] = rank((parts[i], parts[i + 1]), NONE)
            if i:
                adjacent[i - 1] = rank((parts[i - 1], parts[i]), NONE)
        return parts

    def _long(self, parts: list[str]) -> list[str]:
        """The same merges, least rank first and leftmost of equal ones, in n log n steps."""
        n, rank = len(parts), self.ranks.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        gone = [False] * n
        heap = [(r, i) for i, p in enumerate(zip(parts, parts[1:])) if (r := rank(p)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j == n or rank((parts[i], parts[j])) != r:
                continue  # one of the two has been merged since
            parts[i] += parts[j]
            gone[j], after[i] = True, after[j]
            for left, right in ((i, after[i]), (before[i], i)):
                if left >= 0 and right < n:
                    before[right] = left
                    if (new := rank((parts[left], parts[right]))) is not None:
                        heapq.heappush(heap, (new, left))
        return [p for p, out in zip(parts, gone) if not out]

    def word(self, word: str) -> tuple[int, bytes, str]:
        """(number of ids, ids as little-endian 32-bit integers, tokens joined by blanks)."""
        parts = self.parts(word)
        ids = np.array([self.ids[p] for p in parts], dtype="<u4")
        found = (len(parts), ids.tobytes(), " ".join(parts))
        if len(word) <= SHORT:
            if len(self.cache) >= self.cache_words:
                self.cache.clear()
            self.cache[word] = found
        return found

    def normalised(self, text: str) -> str:
        """NFC and lower case; white space needs no change, as no word holds any."""
        if text.isascii():
            return text.lower()
        if has_new(text):
            return self.normalizer.normalize_str(text)
        text = unicodedata.normalize("NFC", text)
        # lower() turns a final capital sigma into another letter than the library's rule by character
        return "".join(c.lower() for c in text) if "Σ" in text else text.lower()

    def pieces(self, text: str) -> list[str]:
        text = self.normalised(text)
        if has_new(text):
            return [text[m.start() : m.end()] for m in self.words.finditer(library_classes(text))]
        return self.words.findall(text)

    def encode(self, text: str) -> tuple[int, bytes, str]:
        """(number of ids, ids, decoded text) of a whole text."""
        if self.split_special is None or "<|" not in text and not self.split_special.search(text):
            return self._plain(text)
        found, at = [], 0
        for m in self.split_special.finditer(text):
            found += [self._plain(text[at : m.start()]), (1, np.array([self.special[m.group()]], dtype="<u4").tobytes(), m.group())]
            at = m.end()
        found.append(self._plain(text[at:]))
        found = [x for x in found if x[0]]
        return sum(x[0] for x in found), b"".join(x[1] for x in found), " ".join(x[2] for x in found)

    def _plain(self, text: str) -> tuple[int, bytes, str]:
        cached, add = self.cache.get, self.word
        found = [cached(p) or add(p) for p in self.pieces(text)]
        if not found:
            return 0, b"", ""
        counts, ids, tokens = zip(*found)
        return sum(counts), b"".join(ids), " ".join(tokens)

    def decode(self, ids: bytes) -> str:
        """The tokens of the ids, joined by blanks: the vocabulary names no decoder."""
        return " ".join(self.tokens[i] for i in np.frombuffer(ids, dtype="<u4").tolist())


def encode_texts(
    docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", cache_words: int = CACHE_WORDS
) -> DataFrame:
    """(id, n_tokens, ids, decoded): one row per row of ``docs``, in no given order.

    ``ids`` is binary, little-endian unsigned 32-bit integers; ``decoded`` is the text decoded
    from them. A NULL text counts as empty: no ids, an empty decoded text. Special tokens inside
    a text become their ids. Nothing is truncated. Repeated rows stay, a NULL id is kept, other
    columns are ignored, an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary_json(path or default_path(WORD_BPE)))
    fields = [T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType())]
    schema = T.StructType([*fields, T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBpe(shared.value, cache_words)
        for batch in batches:
            start, counts, ids, decoded, held = 0, [], [], [], 0
            texts = batch.column(1)
            for i in range(len(texts)):
                n, packed, _ = bpe.encode(texts[i].as_py() or "")
                counts.append(n)
                ids.append(packed)
                decoded.append(bpe.decode(packed))
                held += len(packed)
                if held > BATCH_BYTES or i + 1 == len(texts):
                    columns = [batch.column(0).slice(start, i + 1 - start), pa.array(counts, pa.int64()), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, [id_col, "n_tokens", "ids", "decoded"])
                    start, counts, ids, decoded, held = i + 1, [], [], [], 0

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)
