"""Alignment of two tokenizers over the same bytes: groups of tokens that cover equal bytes, and links of tokens that overlap.

Every text, with a space before it, is encoded by a byte-level BPE of the tokenizers library (A) and by a SentencePiece model
(B, which adds the space itself). The ends of A's and of B's tokens, added up in bytes, are merged: where both have an end
a group closes, and each stretch between neighbouring ends lies in one token of A and one of B, which is a link. This runs
inside mapInPandas over blocks of documents. Neither tokenizer has a token that crosses from a sign to a space after it, so
texts are cut there; each distinct piece of text is encoded and merged once and looked up from then on (models for which
that can't be shown are given whole texts). A block's distinct id pairs and how often it links them go to Spark, which adds
them up over the corpus, takes the highest count of each id on either side and joins both back to the blocks that asked, so
that a pair crosses the network once a block and not once a link. Blocks hold about `BLOCK` characters; a longer text is a
block of its own.

Defined cases: a null or empty text, or one whose tokens of A or B do not spell it (a written U+2581 comes back as a space),
has no tokens: zeros and an empty string; special tokens written out in a text are plain text; equal rows get equal results
and each counts; rows with a null id count and are returned; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, record_batch, release, segment_sums, settle, small_batches
from .sentencepiece_codec import Codec, default_model

#: Characters of text in a block, and of those cut and encoded at a time; pieces of text that a task remembers from one block
#: to the next, unless many are longer than LONG. SLICE: pieces that the library of A encodes at once.
BLOCK, PART, REMEMBERED, LONG, SLICE = 1 << 23, 1 << 20, 1 << 18, 64, 1 << 12
#: Pieces begin before spaces that follow one of these, which no tokenizer takes for white space, if more than spaces follow.
SOLID = r"!-~À-ɏ"
PIECE, ODD_END, CAREFUL = re.compile(r" +[^ ]+(?: +\Z)?"), re.compile(f"[^ {SOLID}] "), re.compile(f"(?<=[{SOLID}])(?= +[^ ])")
NONE = np.zeros(0, np.int64)
BLOCKS = "block long, row int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, groups_sha256 string, pieces binary, pairs array<long>, times array<long>, links binary, sizes binary"
OUT = pa.schema([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("n_best", pa.int64()), ("count_sum", pa.int64()), ("groups_sha256", pa.string()), ("n_best_a", pa.int64()), ("groups", pa.string())])
OUT_SQL = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, n_best_a long, groups string"


def byte_of_sign() -> dict[str, int]:
    """The byte that each sign of a byte-level vocabulary stands for: printable Latin-1 for itself, the rest numbered from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Aligner:
    """Both tokenizers, and what is known of the pieces of text seen so far. Made on the driver, its libraries once a worker."""

    def __init__(self, spec: str, model: bytes):
        self.spec, self.model = spec, model
        known = json.loads(spec)
        pre = known.get("pre_tokenizer") or {}
        plain = not known.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        self.codec = Codec(model, 0)
        #: Whether texts may be cut at spaces for both.
        self.cuts = bool(plain and self.codec.cut_spec)

    def __getstate__(self):
        return {k: self.__dict__[k] for k in ("spec", "model", "codec", "cuts")}

    def start(self) -> None:
        """Load the libraries, unless a task before in this worker has: two copies would be held for a while."""
        self.forget()
        if "a" in self.__dict__:
            return
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a, self.b = Tokenizer.from_str(self.spec), SentencePieceProcessor(model_proto=self.model)
        self.a.encode_special_tokens = True
        sign = byte_of_sign()
        vocabulary = self.a.get_vocab(with_added_tokens=False)
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(sign[c] for c in token)
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(self.b.id_to_piece, range(self.b.get_piece_size())))]
        self.sizes = [np.fromiter(map(len, t), np.int64, len(t)) for t in (self.bytes_a, self.bytes_b)]
        #: Ids as written: those of A, of B behind them, both with what stands between ids; then the same with what ends A's or B's share.
        self.half = len(self.bytes_a) + len(self.bytes_b)
        self.written = [b"%d%c" % (i, c) for last in (b",,", b"|;") for side, c in zip((self.bytes_a, self.bytes_b), last, strict=True) for i in range(len(side))]

    def forget(self) -> None:
        """numbers: of pieces; of each: the groups as text, n_a, n_b, n_groups and n_links, whether they spell it, and its links' pairs."""
        self.numbers: dict[str, int] = {}
        self.said: list[bytes] = []
        self.long = 0
        self.counts, self.spells, self.pairs, self.starts = np.zeros((0, 4), np.int64), np.zeros(0, bool), NONE, np.zeros(1, np.int64)

    def pieces(self, text: str) -> list[str]:
        text = " " + text
        if not self.cuts:
            return [text]
        return CAREFUL.split(text) if ODD_END.search(text) else PIECE.findall(text) or [text]

    def spelled(self, new: list[str], ids: list[list[list[int]]]) -> np.ndarray:
        """Whether the tokens of both sides spell each piece."""
        lengths = np.fromiter((len(p.encode()) for p in new), np.int64, len(new))
        whole, alike = "".join(new).encode(), True
        for side, size, known in zip(ids, self.sizes, (self.bytes_a, self.bytes_b), strict=True):
            n = np.fromiter(map(len, side), np.int64, len(side))
            flat = np.fromiter(chain.from_iterable(side), np.int64, int(n.sum()))
            sums = segment_sums(size[flat].astype(np.float64), np.concatenate([[0], np.cumsum(n)]))
            alike = alike and (sums == lengths).all() and b"".join(map(known.__getitem__, flat.tolist())) == whole
        if alike:
            return np.ones(len(new), bool)
        return np.array([b"".join(map(self.bytes_a.__getitem__, x)) == p.encode() == b"".join(map(self.bytes_b.__getitem__, y)) for p, x, y in zip(new, *ids, strict=True)])

    def learn(self, new: list[str]) -> None:
        """Encode pieces, merge the ends of their tokens, and remember what comes of it."""
        # The library's encodings are many times as large as their ids.
        ids = [[e.ids for i in range(0, len(new), SLICE) for e in self.a.encode_batch_fast(new[i : i + SLICE], add_special_tokens=False)], self.b.encode([p[1:] for p in new], num_threads=1)]
        spells = self.spelled(new, ids)
        if not spells.all():
            ids = [[x if good else [] for x, good in zip(side, spells.tolist(), strict=True)] for side in ids]
        n = [np.fromiter(map(len, side), np.int64, len(side)) for side in ids]
        flat = [np.fromiter(chain.from_iterable(side), np.int64, int(k.sum())) for side, k in zip(ids, n, strict=True)]
        ends = [np.cumsum(size[side]) for size, side in zip(self.sizes, flat, strict=True)]
        cuts = np.sort(np.concatenate(ends), kind="stable")  # two sorted runs
        both = np.zeros(len(cuts), bool)
        both[:-1] = cuts[1:] == cuts[:-1]  # an end of both sides is there twice
        last = np.concatenate([~both[:-1], np.ones(min(1, len(cuts)), bool)])
        both = np.concatenate([np.zeros(min(1, len(cuts)), bool), both[:-1]])[last]
        cuts = cuts[last]
        at = [np.searchsorted(e, cuts) for e in ends]
        borders = [np.concatenate([[0], np.cumsum(k)]) for k in n]
        piece_ends = np.concatenate([[0], ends[0]])[borders[0]]
        edges = np.searchsorted(cuts, piece_ends, "right")
        groups = np.concatenate([[0], np.cumsum(both)])
        counts = np.stack([*n, np.diff(groups[edges]), np.diff(edges)], axis=1)
        closing = [x[both] for x in at]  # the tokens of A and of B with which each group ends
        group = [np.searchsorted(c, np.arange(len(side))) for c, side in zip(closing, flat, strict=True)]
        order = np.zeros(len(flat[0]) + len(flat[1]), np.int64)
        first_b, after_a = np.concatenate([[0], closing[1] + 1]), np.concatenate([closing[0] + 1, [0]])
        order[np.arange(len(flat[0])) + first_b[group[0]]] = flat[0] + np.isin(np.arange(len(flat[0])), closing[0]) * self.half
        order[np.arange(len(flat[1])) + after_a[group[1]]] = flat[1] + len(self.sizes[0]) + np.isin(np.arange(len(flat[1])), closing[1]) * self.half
        words, where = list(map(self.written.__getitem__, order.tolist())), (borders[0] + borders[1]).tolist()
        self.numbers |= zip(new, range(len(self.said), len(self.said) + len(new)), strict=True)
        self.said += [b"".join(words[i:j])[:-1] for i, j in zip(where[:-1], where[1:], strict=True)]
        self.counts, self.spells = np.concatenate([self.counts, counts]), np.concatenate([self.spells, spells])
        self.starts = np.concatenate([self.starts, self.starts[-1] + edges[1:]])
        self.pairs = np.concatenate([self.pairs, flat[0][at[0]] << 32 | flat[1][at[1]]])

    def numbered(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the texts' pieces, and how many pieces each text has; pieces not seen before are learnt."""
        cut = [self.pieces(t) if t else [] for t in texts]
        if new := [p for p in dict.fromkeys(chain.from_iterable(cut)) if p not in self.numbers]:
            self.learn(new)
            self.long += sum(len(p) for p in new if len(p) > LONG)
        sizes = np.fromiter(map(len, cut), np.int64, len(cut))
        return np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(cut)), np.int32, int(sizes.sum())), sizes

    def block(self, number: int, ids: list, texts: list[str], keep_groups: bool) -> pd.DataFrame:
        """Rows of a block: one for each document, and one (row -1) with its pairs, how often it links them, and its pieces' links."""
        parts, first, held = [], 0, 0
        for i, text in enumerate(texts):
            held += len(text)
            if held >= PART or i + 1 == len(texts):
                parts.append(self.numbered(texts[first : i + 1]))
                first, held = i + 1, 0
        at, sizes = (np.concatenate(x) for x in zip(*parts, strict=True))
        good = segment_sums((~self.spells[at]).astype(np.float64), np.concatenate([[0], np.cumsum(sizes)])) == 0
        at = at[np.repeat(good, sizes)]
        borders = np.concatenate([[0], np.cumsum(np.where(good, sizes, 0))])
        totals = segment_sums(self.counts[at].astype(np.float64), borders).astype(np.int64)
        often = np.bincount(at, minlength=len(self.said))
        own = np.flatnonzero(often)
        place = np.zeros(len(often), np.int32)
        place[own] = np.arange(len(own))
        local, often, n_links = place[at], often[own], self.counts[own, 3]
        flat = self.pairs[np.repeat(self.starts[own] - np.concatenate([[0], np.cumsum(n_links)[:-1]]), n_links) + np.arange(n_links.sum())]
        pairs, links = np.unique(flat, return_inverse=True)
        times = np.bincount(links, np.repeat(often, n_links), len(pairs)).astype(np.int64)
        said = [b";".join(map(self.said.__getitem__, at[i:j].tolist())) for i, j in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True)]
        n = len(ids)
        out = pd.DataFrame({
            "block": number, "row": [*range(n), -1], "doc_id": pd.array([*ids, None], "Int64"),
            **{k: [*totals[:, i].tolist(), 0] for i, k in enumerate(("n_a", "n_b", "n_groups", "n_links"))},
            "groups": [*([s.decode() for s in said] if keep_groups else [None] * n), None], "groups_sha256": [*(hashlib.sha256(s).hexdigest() if s else "" for s in said), None],
            "pieces": [*(local[i:j].tobytes() for i, j in zip(borders[:-1], borders[1:], strict=True)), None],
            "pairs": [*[None] * n, pairs], "times": [*[None] * n, times],
            "links": [*[None] * n, links.astype(np.int32).tobytes()], "sizes": [*[None] * n, n_links.astype(np.int32).tobytes()],
        })
        if len(self.said) > REMEMBERED or self.long > BLOCK:
            self.forget()
        return out


def blocks(docs: DataFrame, byte_level: str, sentence_piece: str, id_col: str = "doc_id", text_col: str = "text", keep_groups: bool = False) -> DataFrame:
    """Documents and pairs by block, settled. byte_level, sentence_piece: files that the driver reads."""
    with open(byte_level, encoding="utf-8") as a, open(sentence_piece, "rb") as b:
        shared = docs.sparkSession.sparkContext.broadcast(Aligner(a.read(), b.read()))

    def run(frames):
        aligner = shared.value
        aligner.start()
        number = TaskContext.get().partitionId() << 32
        ids, texts, held = [], [], 0
        for frame in frames:
            for i, text in zip(frame["id"].astype("Int64"), frame["text"], strict=True):
                ids.append(None if i is pd.NA else i)
                texts.append(text or "")
                held += len(texts[-1])
                if held >= BLOCK:
                    yield aligner.block(number, ids, texts, keep_groups)
                    number, ids, texts, held = number + 1, [], [], 0
                    release()
        if ids:
            yield aligner.block(number, ids, texts, keep_groups)
        aligner.forget()
        release()

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return settle(rows.mapInPandas(run, BLOCKS), "aligned-blocks", sweep=True)


def pair_counts(blocked: DataFrame) -> DataFrame:
    """(pair, a, b, n, best_a, best_b): links of each id pair over the corpus, and whether none of its A or B id has more."""
    asked = blocked.where("row = -1").select(F.explode(F.arrays_zip("pairs", "times")).alias("p"))
    counts = asked.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.times").alias("n"))
    counts = settle(counts.select("pair", F.shiftright("pair", 32).alias("a"), F.col("pair").bitwiseAND(0xFFFFFFFF).alias("b"), "n"), "pair-counts", sweep=True)
    for side in ("a", "b"):  # at most as many rows as the vocabulary has ids
        most = counts.groupBy(side).agg(F.max("n").alias(f"most_{side}"))
        counts = counts.join(F.broadcast(most), side)
    return counts.select("pair", "a", "b", "n", (F.col("n") == F.col("most_a")).alias("best_a"), (F.col("n") == F.col("most_b")).alias("best_b"))


def alignment(docs: DataFrame, byte_level: str, sentence_piece: str, id_col: str = "doc_id", text_col: str = "text", keep_groups: bool = False) -> DataFrame:
    """For each row: doc_id, n_a, n_b, n_groups, n_links, n_best and n_best_a (links whose count is their B or A id's highest),
    count_sum, groups_sha256 and, with keep_groups, groups: `a1,a2|b1;a3|b2,b3` with ids in order."""
    blocked = blocks(docs, byte_level, sentence_piece, id_col, text_col, keep_groups)
    asked = blocked.where("row = -1").select("block", F.posexplode("pairs").alias("at", "pair"))
    counted = asked.join(pair_counts(blocked), "pair").select(F.col("block").alias("of"), "at", "n", "best_a", "best_b")

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        release()  # of the group before
        rows = left.column("row").to_numpy()
        whole, documents = left.filter(pa.array(rows == -1)), left.filter(pa.array(rows != -1))
        links, sizes = (np.frombuffer(whole.column(c)[0].as_py(), np.int32) for c in ("links", "sizes"))
        of_pair = np.zeros((right.num_rows, 3))
        if right.num_rows:
            of_pair[right.column("at").to_numpy()] = np.stack([right.column(c).to_numpy().astype(np.float64) for c in ("best_b", "n", "best_a")], axis=1)
        of_piece = segment_sums(of_pair[links], np.concatenate([[0], np.cumsum(sizes)]))
        sums = np.zeros((documents.num_rows, 3), np.int64)
        for i, own in enumerate(documents.column("pieces")):
            if at := own.as_py():
                sums[i] = of_piece[np.frombuffer(at, np.int32)].sum(axis=0)
        known = {c: documents.column(c).combine_chunks() for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups")}
        known |= {"n_best": sums[:, 0], "count_sum": sums[:, 1], "n_best_a": sums[:, 2]}
        return pa.Table.from_batches([record_batch(OUT, *(known[c] for c in OUT.names))])

    return blocked.drop("pairs", "times").groupBy("block").cogroup(counted.groupBy("of")).applyInArrow(scored, OUT_SQL)


def op11_token_alignment(spark: SparkSession, sf_dir: str, byte_level: str | None = None, sentence_piece: str | None = None) -> DataFrame:
    if byte_level is None:
        import public_tokenizers

        byte_level = public_tokenizers.path("byte_bpe_50k.json")
    return alignment(read_table(spark, sf_dir, "documents"), byte_level, sentence_piece or default_model()).drop("groups")
