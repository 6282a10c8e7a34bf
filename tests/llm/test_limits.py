"""What operators hold at once: memory of Python workers, shuffle files, and the work of verification."""

import random
import re
import time
import tracemalloc

import numpy as np
import public_tokenizers
import pytest

from glasspane.llm import decontaminate, sentencepiece_codec, suffix_dedup, token_alignment


def model_bytes():
    with open(sentencepiece_codec.default_model(), "rb") as f:
        return f.read()


def test_aligner_loads_its_libraries_once_a_worker_and_encodes_in_slices():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        aligner = token_alignment.Aligner(f.read(), model_bytes())
    aligner.start()
    library, most = aligner.a, []

    class Counting:
        @staticmethod
        def encode_batch_fast(pieces, add_special_tokens):
            most.append(len(pieces))
            return library.encode_batch_fast(pieces, add_special_tokens=add_special_tokens)

    aligner.a = counting = Counting()
    text = " ".join(f"w{i}" for i in range(3 * token_alignment.SLICE))
    block = aligner.block(0, [1], [text], True)
    assert max(most) <= token_alignment.SLICE < sum(most)
    assert block["n_a"][0] == len(library.encode(" " + text, add_special_tokens=False).ids)
    aligner.start()  # the worker's next task
    assert aligner.a is counting and not aligner.numbers and not aligner.said


def test_texts_are_verified_once_for_each_distinct_stretch():
    codec, seen = sentencepiece_codec.Codec(model_bytes()), []
    original = codec.original

    class Counting:
        @staticmethod
        def encode(texts, num_threads):
            seen.extend(texts)
            return original.encode(texts, num_threads=num_threads)

    codec.__dict__["original"] = Counting
    text = "The quick brown fox jumps over the lazy dog."
    wanted = original.encode(text)
    for _ in range(50):
        assert codec.encode([text]) == [wanted]
    assert sum(map(len, seen)) <= len(text)


def test_ids_of_stretches_are_those_of_whole_texts():
    """No token crosses a cut, so verifying stretches verifies texts."""
    whole, cut = (sentencepiece_codec.Codec(model_bytes(), verify=v) for v in ("texts", "pieces"))
    rng = random.Random(5)
    signs = ["a", "the", "Zürich", "  ", " ", "▁", "\n", "\t", "日本", "🙂", "​", "<s>", "0.5", "　", ",", "'s", "é"]
    texts = [" ", "  ", "▁", "a ", "a▁", " a", "▁ ▁", "\n ", *("".join(rng.choices(signs, k=rng.randrange(1, 30))) for _ in range(2000))]
    want = whole.original.encode(texts)
    assert cut.encode(texts) == whole.encode(texts) == want


def test_a_stretch_with_other_ids_is_told():
    codec = sentencepiece_codec.Codec(model_bytes())
    original = codec.original

    class Other:
        @staticmethod
        def encode(texts, num_threads):
            return [ids[::-1] if t == "wrongly-encoded" else ids for t, ids in zip(texts, original.encode(texts), strict=True)]

    codec.__dict__["original"] = Other
    codec.encode(["all is well "])
    with pytest.raises(ValueError, match="not the ids"):
        codec.encode(["all is wrongly-encoded here"])


def test_shuffle_files_behind_settled_tables_go(spark):
    def shuffles():
        return set(re.findall(r"shuffle_(\d+)_", spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ")))

    rng = random.Random(3)
    part = " ".join(f"word{rng.randrange(10**6)}" for _ in range(60))
    docs = spark.createDataFrame([(i, f"{rng.random()} {part} {rng.random()}") for i in range(40)], "doc_id long, text string")
    before = shuffles()
    out = suffix_dedup.remove_repeats(docs)
    until = time.time() + 10
    while (left := shuffles() - before) and time.time() < until:
        time.sleep(0.2)
    assert not left
    assert all(r.n_removed >= 400 for r in out.collect())


def test_driver_holds_few_copies_of_the_svds_matrix(spark):
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(rng.integers(0, decontaminate.BUCKETS, 60).tolist(),) for _ in range(400)], "feats array<int>")
    idf = np.ones(decontaminate.BUCKETS)
    tracemalloc.start()
    try:
        found = decontaminate.randomised_svd(rows, idf)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 4.5 * found.nbytes
    # Directions are orthogonal over the rows, each of unit length there.
    a = np.zeros((400, decontaminate.BUCKETS), np.float32)
    for i, r in enumerate(rows.collect()):
        np.add.at(a[i], r.feats, 1)
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    assert np.allclose((a @ found).T @ (a @ found), np.eye(decontaminate.RANK), atol=1e-2)
