"""Token counts by byte-pair merging with a heap over a linked list.

A word starts as its bytes, one symbol each, the last one carrying the word end. The adjacent pair of lowest merge rank
is popped from a heap, again and again, and joined in a linked list; the count is the initial symbols minus the merges
done. No identifiers are emitted. The vocabulary file is a parameter: a tokenizers .json with a byte-level BPE model
(its normaliser, split pattern, special strings and word end are read from it). A word's count is kept in a bounded
memo of each Python worker, as words repeat.

Defined cases: null text counts as empty, 0 tokens; special strings inside texts count 1 each, as in the library; words
of any length take n log n steps; repeated rows are counted alike; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, record_batch, text_column

LIMIT = 2048
#: Words whose counts a worker remembers; beyond it the memo starts anew.
MEMO = 1 << 18
OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])
#: White space as Unicode has it (what \\s means in the vocabulary's patterns).
WHITE = r"\t-\r \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names, extra = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in names:
            names[b] = chr(extra)
            extra += 1
    return [names[b] for b in range(256)]


class Counter:
    """Counts tokens of texts under the vocabulary at `path`; the file is read in each worker on first use."""

    def __init__(self, spec: str):
        self.spec = spec
        self.memo: dict[str, int] = {}

    @classmethod
    def from_file(cls, path: str) -> Counter:
        with open(path, encoding="utf-8") as f:
            return cls(f.read())

    def __getstate__(self):
        return {"spec": self.spec, "memo": {}}

    @cached_property
    def parts(self):
        spec = json.loads(self.spec)
        model = spec["model"]
        if model["type"] != "BPE" or spec.get("truncation") or spec.get("padding") or model.get("ignore_merges") or model.get("byte_fallback"):
            raise ValueError("only plain byte-level BPE vocabularies are supported")
        ids = dict(model["vocab"])
        end = model.get("end_of_word_suffix") or ""
        merges = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            merges[ids[a], ids[b]] = (rank, ids[a + b])
        symbols = byte_symbols()
        inner, last = [ids[s] for s in symbols], [ids[s + end] for s in symbols]
        splits = [p for p in self._flat(spec["pre_tokenizer"], "pretokenizers") if p["type"] == "Split"]
        if len(splits) != 1 or not splits[0]["invert"] or splits[0]["behavior"] != "Removed":
            raise ValueError("one Split pre-tokenizer that keeps its matches is expected")
        words = regex.compile(splits[0]["pattern"]["Regex"].replace(r"\s", WHITE), regex.V0)
        steps = [n["type"] for n in self._flat(spec.get("normalizer"), "normalizers")]
        special = [t["content"] for t in spec["added_tokens"]]
        return merges, inner, last, words, "NFC" in steps, "Lowercase" in steps, regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None

    @staticmethod
    def _flat(node, many):
        return [] if node is None else node[many] if node["type"] == "Sequence" else [node]

    def word(self, text: str) -> int:
        """Initial symbols minus merges."""
        merges, inner, last = self.parts[:3]
        raw = text.encode("utf-8")
        n = len(raw)
        sym = [inner[b] for b in raw]
        sym[-1] = last[raw[-1]]
        if n == 1:
            return 1
        following, previous = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = []
        for i in range(n - 1):
            if m := merges.get((sym[i], sym[i + 1])):
                heap.append((m[0], i, m[1]))
        heapq.heapify(heap)
        count = n
        while heap:
            rank, i, new = heapq.heappop(heap)
            j = following[i]
            if sym[i] < 0 or j < 0:
                continue
            m = merges.get((sym[i], sym[j]))
            if m is None or m[0] != rank or m[1] != new:
                continue
            sym[i], sym[j] = new, -1
            after = following[i] = following[j]
            count -= 1
            if after >= 0:
                previous[after] = i
                if m := merges.get((new, sym[after])):
                    heapq.heappush(heap, (m[0], i, m[1]))
            if (before := previous[i]) >= 0 and (m := merges.get((sym[before], new))):
                heapq.heappush(heap, (m[0], before, m[1]))
        return count

    def plain(self, text: str) -> int:
        _, _, _, words, nfc, lower, _ = self.parts
        if not text.isascii():
            if nfc:
                text = unicodedata.normalize("NFC", text)
            if lower:
                text = text.replace("Σ", "σ")
        if lower:
            text = text.lower()
        memo, total = self.memo, 0
        for w in words.findall(text):
            n = memo.get(w)
            if n is None:
                n = self.word(w)
                if len(w) <= 64:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[w] = n
            total += n
        return total

    def count(self, text: str) -> int:
        special = self.parts[6]
        if special is None or not special.search(text):
            return self.plain(text)
        return len(special.findall(text)) + sum(map(self.plain, special.split(text)))


def token_counts(docs: DataFrame, vocabulary: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens, over_limit for each row. vocabulary: a file that the driver reads."""
    shared = docs.sparkSession.sparkContext.broadcast(Counter.from_file(vocabulary))

    def run(batches):
        for batch in batches:
            texts = text_column(batch, "text")
            n = np.fromiter((shared.value.count(t.as_py()) for t in texts), np.int64, len(texts))
            size = np.fromiter((len(t.as_buffer()) for t in texts), np.int64, len(texts))
            yield record_batch(OUT, batch.column("doc_id"), size, n, n > limit)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op5_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("word_bpe_49k.json")
    return token_counts(read_table(spark, sf_dir, "documents"), vocabulary)
