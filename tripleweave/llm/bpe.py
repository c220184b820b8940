"""Token counts by heap-and-linked-list byte-pair merging (operator 7).

The vocabulary file (its path is a parameter) gives the merges in order of rank and the special strings. A text is cut at
special strings (one token each), then by the byte-level pattern; each piece starts as its bytes, linked as a list, with a
heap of adjacent pairs by (rank, place). The lowest pair is popped and merged if both its ends are still as they were when it
was pushed; the count is the bytes minus the merges. No identifier is made. A task keeps the counts of pieces that it has
met in a bounded table, which is emptied when full: only speed depends on it.

Defined results: a null text counts as empty (0 bytes, 0 tokens); a piece of any length costs n log n; repeated rows are
counted alike; other columns, of whatever name, aren't read; an empty table gives no rows. A file with another model, a
normaliser, or added tokens that aren't special is refused.
"""

from __future__ import annotations

import json
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import load, map_batches, texts

#: Pieces of a byte-level vocabulary, as published with it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
KEPT = 300_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    own = {b: chr(b) for b in plain}
    return [own.get(b) or chr(next(other)) for b in range(256)]


class Counter:
    """count(text): tokens of a text under the vocabulary file."""

    def __init__(self, path: str, kept: int = KEPT) -> None:
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        extra = [t["content"] for t in spec.get("added_tokens", []) if not t.get("special")]
        if spec["model"].get("type", "BPE") != "BPE" or spec.get("normalizer") or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or extra:
            raise ValueError(f"{path}: not a byte-level vocabulary of merges")
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        number: dict[str, int] = {}
        for s in byte_symbols():
            number[s] = len(number)
        self.first = list(range(256))
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(pairs):
            joined = number.setdefault(a + b, len(number))
            self.merges[number[a], number[b]] = (rank, joined)
        special = sorted((t["content"] for t in spec.get("added_tokens", []) if t.get("special")), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.pieces = regex.compile(PATTERN).findall
        self.kept, self.known = kept, {}

    def piece(self, data: bytes) -> int:
        """Bytes minus merges."""
        n = len(data)
        if n < 2:
            return n
        merges, ids = self.merges, list(data)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            m = merges.get((ids[i], ids[i + 1]))
            if m is not None:
                heap.append((m[0], i, m[1], ids[i], ids[i + 1]))
        heapify(heap)
        left = n
        while heap:
            _, i, joined, a, b = heappop(heap)
            if ids[i] != a:
                continue
            j = after[i]
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = joined, -1
            k = after[i] = after[j]
            left -= 1
            if k < n:
                before[k] = i
                m = merges.get((joined, ids[k]))
                if m is not None:
                    heappush(heap, (m[0], i, m[1], joined, ids[k]))
            h = before[i]
            if h >= 0:
                m = merges.get((ids[h], joined))
                if m is not None:
                    heappush(heap, (m[0], h, m[1], ids[h], joined))
        return left

    def plain(self, text: str) -> int:
        known, found, total = self.known, self.pieces(text), 0
        for p, k in zip(found, map(known.get, found)):
            if k is None:
                k = self.piece(p.encode("utf-8", "surrogatepass"))
                if len(p) <= 64:
                    if len(known) >= self.kept:
                        known.clear()
                    known[p] = k
            total += k
        return total

    def count(self, text: str) -> int:
        if self.special is None:
            return self.plain(text)
        parts = self.special.split(text)
        return sum(map(self.plain, parts)) + len(parts) - 1


_READY: dict[str, Counter] = {}


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of docs."""

    def start():
        counter = _READY.get(vocabulary) or _READY.setdefault(vocabulary, Counter(vocabulary))

        def work(batch: pa.RecordBatch) -> dict:
            t = texts(batch)
            return {"n_bytes": [len(x.encode("utf-8", "surrogatepass")) for x in t], "n_tokens": [counter.count(x) for x in t]}

        return work

    new = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]
    return map_batches(docs.select("doc_id", "text"), start, new, ["doc_id"]).withColumn("over_limit", F.col("n_tokens") > limit)


def query(spark, sf_dir: str) -> DataFrame:
    """op7: tokens of every whole text under byte_bpe_50k.json. (doc_id, n_bytes, n_tokens, over_limit)."""
    import public_tokenizers

    return token_counts(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
