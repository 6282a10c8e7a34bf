"""SentencePiece encoding and decoding on the tokenizers library.

The model file is read as the protobuf that it is (only the fields that matter), and a tokenizers pipeline is rebuilt from
it: the normaliser (compiled character map, extra white space, dummy prefix), the metaspace marker, the model (unigram
scores, or for BPE models the merges that the scores imply) and byte fallback. Batches are encoded and decoded by the
library's own threads. Where the normaliser only writes the marker for a space and no piece has a marker behind another
sign, no piece crosses from a word to the space after it; texts are then cut there, as the library's metaspace splitting
does, and each distinct piece of text is encoded and decoded once and looked up from then on. Every distinct piece is encoded by
the sentencepiece library as well when it is first met, and a difference fails the task. As no token crosses a cut, that
covers every text; verify="texts" encodes every whole text by that library besides, as is always done where texts are not
cut (verify_one_in: a share of them, by a hash of the text). The decoded text of every row is compared with the text that went in.

Defined cases: null text is empty, no ids; control pieces written out in a text are ordinary text, as in the original
library; repeated rows get equal ids; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, decoders, models, normalizers

from .common import read_table, record_batch, small_batches, text_column, text_parts

#: Kinds of pieces and models in the protobuf.
NORMAL, UNKNOWN, USER_DEFINED, UNIGRAM, BPE = 1, 2, 4, 1, 2
MARK = "▁"
#: One text in so many is encoded by the sentencepiece library, too: all of them; by their pieces, each distinct one once, or as whole texts.
VERIFY_ONE_IN, VERIFY = 1, "pieces"
THREADS = 2
#: A stretch of text is spaces (or markers) and what follows them up to the next. What is remembered is given up beyond so many tokens,
#: and after a batch with so many characters in longer stretches.
STRETCH, REMEMBERED = 64, 1 << 22
CUT = re.compile(f"[ {MARK}]*[^ {MARK}]+|[ {MARK}]+$")
OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("decodes", pa.bool_()), ("ids", pa.list_(pa.int32()))])


def fields(data: bytes):
    """(field number, value) of a protobuf message: int, bytes, or the four bytes of a fixed number."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, data[at : at + size]
            at += size


def parse_model(data: bytes) -> dict:
    """Pieces as (text, score, kind) and the settings that a pipeline needs."""
    out = {"pieces": [], "kind": UNIGRAM, "byte_fallback": False, "charsmap": b"", "dummy_prefix": True, "extra_spaces": True, "escape": True, "suffix": False}
    for number, value in fields(data):
        if number == 1:
            piece = dict(fields(value))
            out["pieces"].append((piece.get(1, b"").decode("utf-8"), struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0, piece.get(3, NORMAL)))
        elif number == 2:
            spec = dict(fields(value))
            out |= {"kind": spec.get(3, UNIGRAM), "byte_fallback": bool(spec.get(35, 0)), "suffix": bool(spec.get(24, 0))}
        elif number == 3:
            spec = dict(fields(value))
            out |= {"charsmap": spec.get(2, b""), "dummy_prefix": bool(spec.get(3, 1)), "extra_spaces": bool(spec.get(4, 1)), "escape": bool(spec.get(5, 1))}
    if out["suffix"] or not out["escape"] or out["kind"] not in (UNIGRAM, BPE):
        raise ValueError("only unigram and BPE models with a leading marker are supported")
    return out


def implied_merges(pieces: list[tuple[str, float, int]]) -> list[tuple[str, str]]:
    """All pairs of pieces that make a piece, best score first; of one piece in order of the pair's ids."""
    ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind in (NORMAL, USER_DEFINED)}
    found = []
    for p, i in ids.items():
        pairs = sorted((ids[p[:k]], ids[p[k:]], k) for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids)
        found += [(-pieces[i][1], i, n, p[:k], p[k:]) for n, (_, _, k) in enumerate(pairs)]
    return [(a, b) for *_, a, b in sorted(found)]


def build_tokenizer(model: dict) -> Tokenizer:
    pieces = model["pieces"]
    unknown = next((i for i, p in enumerate(pieces) if p[2] == UNKNOWN), 0)
    if model["kind"] == UNIGRAM:
        tokenizer = Tokenizer(models.Unigram([(p, s) for p, s, _ in pieces], unknown, model["byte_fallback"]))
    else:
        tokenizer = Tokenizer(models.BPE({p: i for i, (p, _, _) in enumerate(pieces)}, implied_merges(pieces), unk_token=pieces[unknown][0], fuse_unk=True, byte_fallback=model["byte_fallback"]))
    steps = [normalizers.Precompiled(model["charsmap"])] if model["charsmap"] else []
    if model["extra_spaces"]:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model["dummy_prefix"]:
        steps.append(normalizers.Prepend(MARK))
    tokenizer.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
    back = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    tokenizer.decoder = decoders.Sequence(back + ([decoders.Strip(" ", 1, 0)] if model["dummy_prefix"] else []))
    return tokenizer


class Stretches:
    """Ids of stretches of text, flat: number, start and size of each, and whether they decode to it."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.ids, self.size, self.exact = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, bool)
        self.start = np.zeros(1, np.int64)

    def add(self, new: list[str], ids: list[list[int]], exact: list[bool]) -> None:
        self.number |= zip(new, range(len(self.number), len(self.number) + len(new)), strict=True)
        self.size = np.concatenate([self.size, np.fromiter(map(len, ids), np.int64, len(ids))])
        self.start = np.concatenate([[0], np.cumsum(self.size)])
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(ids), np.int32, int(self.start[-1]) - len(self.ids))])
        self.exact = np.concatenate([self.exact, np.array(exact, bool)])


class Codec:
    """The rebuilt pipeline, made once per worker, and the original library for verification."""

    def __init__(self, data: bytes, verify_one_in: int = VERIFY_ONE_IN, threads: int = THREADS, verify: str = VERIFY):
        self.data, self.verify_one_in, self.threads, self.verify = data, verify_one_in, threads, verify
        model = parse_model(data)
        self.spec = build_tokenizer(model).to_str()
        usable = [p for p, _, kind in model["pieces"] if kind in (NORMAL, USER_DEFINED)]
        plain = not model["charsmap"] and not model["extra_spaces"] and model["dummy_prefix"]
        #: The pipeline for stretches, without the marker that is put before a text.
        self.cut_spec = build_tokenizer(model | {"dummy_prefix": False}).to_str() if plain and MARK in usable and not any(MARK in p.lstrip(MARK) for p in usable) else None

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("tokenizer", "cut_tokenizer", "original", "known")}

    def library(self, spec: str) -> Tokenizer:
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ.setdefault("RAYON_NUM_THREADS", str(self.threads))
        return Tokenizer.from_str(spec)

    @cached_property
    def tokenizer(self) -> Tokenizer:
        return self.library(self.spec)

    @cached_property
    def cut_tokenizer(self) -> Tokenizer:
        return self.library(self.cut_spec)

    @cached_property
    def original(self):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_proto=self.data)

    @cached_property
    def known(self) -> Stretches:
        return Stretches()

    def coded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, flat, the first place of each text's ids and one more, and whether each text's ids decode to it."""
        if self.cut_spec is None:
            ids = self.library_ids(self.tokenizer, texts)
            sizes, flat = np.fromiter(map(len, ids), np.int64, len(ids)), np.fromiter(chain.from_iterable(ids), np.int32)
            exact = np.array([x == y for x, y in zip(self.decode(ids), texts, strict=True)], bool)
        else:
            stretches = [CUT.findall(" " + t) if t else [] for t in texts]
            known = self.known
            if new := list(dict.fromkeys(s for s in chain.from_iterable(stretches) if s not in known.number)):
                ids = self.library_ids(self.cut_tokenizer, new)
                if self.verify_one_in == 1 and self.verify == "pieces":
                    self.check_stretches(new, ids)
                known.add(new, ids, [x == y for x, y in zip(self.cut_tokenizer.decode_batch(ids, skip_special_tokens=False), new, strict=True)])
            at = np.fromiter(map(known.number.__getitem__, chain.from_iterable(stretches)), np.int64)
            cuts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, stretches), np.int64, len(texts)))])
            size = known.size[at]
            ends = np.concatenate([[0], np.cumsum(size)])
            flat = known.ids[np.repeat(known.start[at] - ends[:-1], size) + np.arange(ends[-1])]
            sizes, wrong = np.diff(ends[cuts]), np.concatenate([[0], np.cumsum(~known.exact[at])])
            exact = np.diff(wrong[cuts]) == 0
            if len(known.ids) > REMEMBERED or sum(len(s) for s in new if len(s) > STRETCH) > REMEMBERED:
                del self.known
        starts = np.concatenate([[0], np.cumsum(sizes)])
        if self.verify_one_in and not (self.cut_spec and self.verify_one_in == 1 and self.verify == "pieces"):
            some = [i for i, t in enumerate(texts) if self.verify_one_in == 1 or hashlib.blake2b(t.encode("utf-8"), digest_size=4).digest()[0] % self.verify_one_in == 0]
            for i, want in zip(some, self.original.encode([texts[i] for i in some], num_threads=1), strict=True):
                if not np.array_equal(flat[starts[i] : starts[i + 1]], want):
                    raise ValueError(f"not the ids of the sentencepiece library for a text of {len(texts[i])} characters")
        return flat, starts, exact

    def check_stretches(self, new: list[str], ids: list[list[int]]) -> None:
        """Fail unless the sentencepiece library, which puts the first marker itself, gives stretches the same ids."""
        wanted = self.original.encode([s[1:] for s in new], num_threads=1)
        if " " in new or MARK in new:  # a lone marker, at the end of a text; as a text it would be empty
            word, marked = self.original.encode(["a", "a "], num_threads=1)
            wanted = [want if len(s) > 1 else marked[len(word) :] for s, want in zip(new, wanted, strict=True)]
        if wanted != ids:
            bad = next(s for s, i, want in zip(new, ids, wanted, strict=True) if i != want)
            raise ValueError(f"not the ids of the sentencepiece library for a stretch of {len(bad)} characters")

    @staticmethod
    def library_ids(tokenizer: Tokenizer, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        flat, starts, _ = self.coded(texts)
        return [flat[a:b].tolist() for a, b in zip(starts[:-1], starts[1:], strict=True)]

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.tokenizer.decode_batch(ids, skip_special_tokens=False)


def encode(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", verify_one_in: int = VERIFY_ONE_IN, verify: str = VERIFY) -> DataFrame:
    """doc_id, n_tokens, decodes (the ids give back the text), ids for each row. model_file: read by the driver."""
    with open(model_file, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(Codec(f.read(), verify_one_in, verify=verify))

    def run(batches):
        for batch in batches:
            texts = text_column(batch, "text")
            for a, b, _, _ in text_parts(texts):
                flat, starts, exact = shared.value.coded(texts.slice(a, b - a).to_pylist())
                yield record_batch(OUT, batch.column("doc_id").slice(a, b - a), np.diff(starts), exact, pa.ListArray.from_arrays(starts.astype(np.int32), flat))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, decodes boolean, ids array<int>")


def decode(encoded: DataFrame, model_file: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and the text of its ids; null ids give empty text."""
    with open(model_file, "rb") as f:
        shared = encoded.sparkSession.sparkContext.broadcast(Codec(f.read(), 0))
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches):
        for batch in batches:
            yield record_batch(schema, batch.column("doc_id"), shared.value.decode([x or [] for x in batch.column("ids").to_pylist()]))

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(read_table(spark, sf_dir, "documents"), default_model())


def stage_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, decodes and ids of every document that is left."""
    small_batches(spark)
    return encode(docs, default_model())
