"""Token counts by heap-and-linked-list byte-pair merging.

The vocabulary file gives the merge ranks, the normaliser and the pattern that cuts a text into words. A word starts as one
symbol per byte, the last with the end-of-word suffix. A heap holds the adjacent pairs that can merge; the pair of lowest
rank, leftmost first, is merged and its neighbours in the linked list make new pairs. The count of a word is its initial
symbols minus the merges, so no identifier is looked up. Counts of words are kept in a cache of bounded size.

Special tokens in a text are cut out first and count as one each, as the library does by default. Null or empty text has
no tokens. Rows are counted one by one: repeated rows and null ids come back as they are, other columns are ignored.
"""

from __future__ import annotations

import functools
import heapq
import json
import unicodedata
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T

CACHE = 200_000  # words a generation of the cache may hold


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if printable, else the next free one from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, free = [""] * 256, 0x100
    for b in range(256):
        out[b] = chr(b) if b in printable else chr(free)
        free += b not in printable
    return out


class Counter(dict):
    """``counter[word]`` is the number of symbols left of a word after all merges; two generations bound the memory."""

    def __init__(self, spec: dict):
        model = spec["model"]
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("only a BPE vocabulary with NFC, white space and lower-case normalisers is supported")
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {p: i for i, p in reversed(list(enumerate(pairs)))}
        self.suffix = model["end_of_word_suffix"] or ""
        self.symbols = byte_symbols()
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.split = regex.compile(pattern).findall
        special = [x["content"] for x in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.old: dict[str, int] = {}

    def __missing__(self, word: str) -> int:
        n = self.old.get(word)
        if n is None:
            n = self.merge(word)
        if len(self) >= CACHE:
            self.old = dict(self)
            self.clear()
        self[word] = n
        return n

    def merge(self, word: str) -> int:
        sym = [self.symbols[b] for b in word.encode("utf-8")]
        sym[-1] += self.suffix
        count = len(sym)
        before, after = list(range(-1, count - 1)), [*range(1, count), -1]
        rank = self.rank
        heap = [(r, i, sym[i], sym[i + 1]) for i in range(count - 1) if (r := rank.get((sym[i], sym[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if sym[i] != a or j < 0 or sym[j] != b:
                continue  # one of the pair has merged since
            sym[i], sym[j] = a + b, ""
            after[i] = k = after[j]
            after[j] = -1
            count -= 1
            if k >= 0:
                before[k] = i
                if (r := rank.get((sym[i], sym[k]))) is not None:
                    heapq.heappush(heap, (r, i, sym[i], sym[k]))
            if (k := before[i]) >= 0 and (r := rank.get((sym[k], sym[i]))) is not None:
                heapq.heappush(heap, (r, k, sym[k], sym[i]))
        return count

    def plain(self, text: str) -> int:
        text = regex.sub(r"\p{White_Space}+", " ", unicodedata.normalize("NFC", text)).replace("Σ", "σ").lower()
        return sum(map(self.__getitem__, self.split(text)))

    def count(self, text: str) -> int:
        if self.special is None or "<" not in text:
            return self.plain(text)
        total, at = 0, 0
        for m in self.special.finditer(text):
            total += 1 + self.plain(text[at : m.start()])
            at = m.end()
        return total + self.plain(text[at:])


@functools.lru_cache(2)
def counter(path: str) -> Counter:
    return Counter(json.loads(Path(path).read_text(encoding="utf-8")))


def _run(path: str, limit: int):
    def run(batches):
        tokens = counter(path)
        for part in T.chunks(batches):
            texts = [x or "" for x in part.column(1).to_pylist()]
            n = [tokens.count(x) for x in texts]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 2048) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row; ``vocabulary`` is a file that every executor has."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_run(vocabulary, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
