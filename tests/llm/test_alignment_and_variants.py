import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from glasspane.llm import spelling_variants, substring_dedup, token_alignment

tokenizers = pytest.importorskip("public_tokenizers")
A, B = tokenizers.path("byte_bpe_50k.json"), tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "   ", "a ", "▁x", "<|endoftext|> <s> hi", "İstanbul 日本語 🙂👍🏽 é", "\x00\n \t x", "don't  stop\n\n  here   now　 then", "a" * 3000, "x  y\x85 z", "end   "]


def table(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "n", 1.0, "b") for i, t in enumerate(texts)], "doc_id long, text string, n string, pair double, block string")


def plain_alignment(texts):
    """All links as pairs of token occurrences whose byte ranges overlap."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    sign = token_alignment.byte_of_sign()
    bytes_a = {i: bytes(sign[c] for c in t) for t, i in a.get_vocab(with_added_tokens=False).items()}
    bytes_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    known = []
    for t in texts:
        x = a.encode(" " + t, add_special_tokens=False).ids if t else []
        y = b.encode(t) if t else []
        ranges = []
        for tokens in ([bytes_a[i] for i in x], [bytes_b(i) for i in y]):
            ends = [sum(map(len, tokens[: k + 1])) for k in range(len(tokens))] if len(tokens) < 400 else None
            if ends is None:
                ends, n = [], 0
                for s in tokens:
                    n += len(s)
                    ends.append(n)
            ranges.append(ends)
        want = (" " + t).encode() if t else b""
        if not t or b"".join(bytes_a[i] for i in x) != want or b"".join(map(bytes_b, y)) != want:
            known.append(([], [], [], ""))
            continue
        shared = sorted(set(ranges[0]) & set(ranges[1]))
        groups, links, i, j = [], [], 0, 0
        for end in shared:
            u, v = ranges[0].index(end) + 1, ranges[1].index(end) + 1
            groups.append(",".join(map(str, x[i:u])) + "|" + ",".join(map(str, y[j:v])))
            start = lambda r, k: r[k - 1] if k else 0
            links += [(x[p], y[q]) for p in range(i, u) for q in range(j, v) if start(ranges[0], p) < ranges[1][q] and start(ranges[1], q) < ranges[0][p]]
            i, j = u, v
        known.append((x, y, links, ";".join(groups)))
    counts = Counter(p for k in known for p in k[2])
    most_b, most_a = defaultdict(int), defaultdict(int)
    for (p, q), n in counts.items():
        most_b[q], most_a[p] = max(most_b[q], n), max(most_a[p], n)
    return [(len(x), len(y), s.count(";") + 1 if s else 0, len(links), sum(counts[p] == most_b[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(s.encode()).hexdigest() if s else "", sum(counts[p] == most_a[p[0]] for p in links), s) for x, y, links, s in known]


def alignment_rows(rows, **more):
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_best_a", "groups")
    return {r.doc_id: tuple(r[n] for n in names) for r in token_alignment.alignment(rows, A, B, keep_groups=True, **more).collect()}


def test_alignment_is_that_of_all_pairs(spark, monkeypatch):
    rng = random.Random(11)
    texts = ODD + ["".join(rng.choice(" ab thing é\n.<>日▁1'sS🙂 ") for _ in range(rng.randint(1, 70))) for _ in range(150)]
    texts += ["the same thing again and again, unbelievably"] * 5 + ["Unbelievable things: " + str(i) * 9 for i in range(20)]
    want = plain_alignment([t or "" for t in texts])
    got = alignment_rows(table(spark, texts).repartition(3))
    assert [got[i] for i in range(len(texts))] == want
    assert want[5][0] == 0 and want[6][0] > 0 and want[10][0] > 0
    assert got[len(ODD) + 150] == got[len(ODD) + 151]


def test_alignment_in_many_blocks_and_without_cuts(spark, monkeypatch):
    texts = [f"Copies of row {i % 4}, tokenised somehow" for i in range(12)]
    want = plain_alignment(texts)
    aligner = token_alignment.Aligner(open(A, encoding="utf-8").read(), open(B, "rb").read())
    assert aligner.cuts
    aligner.start()
    parts = [aligner.block(k, [k], [t], True) for k, t in enumerate(texts)]
    assert [p.iloc[0].n_links for p in parts] == [w[3] for w in want]
    aligner.cuts = False
    aligner.forget()
    again = [aligner.block(k, [k], [t], True) for k, t in enumerate(texts)]
    assert [p.iloc[0].groups for p in again] == [w[8] for w in want] == [p.iloc[0].groups for p in parts]


def test_alignment_of_empty_tables_and_null_ids(spark):
    assert alignment_rows(table(spark, [])) == {}
    rows = spark.createDataFrame([(None, "some words"), (1, "some words"), (1, None)], "doc_id long, text string")
    got = token_alignment.alignment(rows, A, B).collect()
    assert sorted((r.doc_id is None, r.n_a, r.count_sum) for r in got) == [(False, 0, 0), (False, 2, 4), (True, 2, 4)]


def plain_repeats(rows, window):
    """rows: (doc, text); n_words, kept hash and number removed for each."""
    cut = [(d, re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode())) for d, t in rows]
    first = {}
    for d, w in cut:
        for i in range(len(w) - window + 1 if d is not None else 0):
            key = tuple(w[i : i + window])
            first[key] = min(first.get(key, d), d)
    out = []
    for d, w in cut:
        gone = {k for i in range(len(w) - window + 1 if d is not None else 0) if first[tuple(w[i : i + window])] < d for k in range(i, i + window)}
        out.append((len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    return out


@pytest.mark.parametrize("window, alphabet", [(13, 2), (13, 400), (5, 3), (4, 30)])
def test_repeats_are_those_of_brute_force(spark, window, alphabet):
    rng = random.Random(window * 1000 + alphabet)
    word = lambda: f"w{rng.randrange(alphabet)}"
    passages = [[word() for _ in range(rng.randint(window - 2, 160))] for _ in range(12)]
    texts = []
    for _ in range(90):
        parts = [rng.choice(passages) if rng.random() < 0.5 else [word() for _ in range(rng.randint(0, 40))] for _ in range(rng.randint(1, 6))]
        words = [w for p in parts for w in p]
        if words and rng.random() < 0.5:
            words[rng.randrange(len(words))] = "other"
        texts.append(rng.choice([" ", "  ", "\n", "\t "]).join(words))
    texts += [texts[3], texts[3], None, "", "  \x0b ", "a " * 40, "a " * 55, "a " * 12, "b a " * 30, " ".join("cdef") + " x\x1cy"]
    rows = [(100 + (i * 37) % len(texts) if i % 11 else None, t) for i, t in enumerate(texts)]
    rows += [(105, texts[3]), (105, texts[4]), (105, texts[4])]  # one document in several rows
    table = spark.createDataFrame([(i, d, t, "x") for i, (d, t) in enumerate(rows)], "name long, doc_id long, text string, part string")
    out = substring_dedup.without_repeats(table.repartition(3), window=window)
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out.collect())
    assert got == Counter((d, *x) for (d, _), x in zip(rows, plain_repeats(rows, window), strict=True))


def test_repeats_at_scale_of_groups(spark):
    """A thousand near copies, long documents and an empty table."""
    rng = random.Random(5)
    base = [f"v{rng.randrange(5000)}" for _ in range(120)]
    rows = []
    for i in range(1000):
        words = list(base)
        words[rng.randrange(120)] = f"own{i}"
        rows.append((i, " ".join(words)))
    rows.append((1000, " ".join(f"u{rng.randrange(900)}" for _ in range(40000)) + " " + " ".join(base)))
    out = substring_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256, sum(x["size"] for x in r.removed)) for r in out.collect()}
    assert [got[i][:3] for i in range(1001)] == plain_repeats(rows, 13)
    assert all(n == total for _, n, _, total in got.values())
    assert substring_dedup.without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(counts):
    names = sorted(counts)
    out = {}
    for w in names:
        close = [v for v in names if near(w, v)]
        best = min(close, key=lambda v: (-counts[v], v)) if close else None
        form = best if best and counts[best] >= 10 * counts[w] else None
        out[w] = (form, counts[w], len(close), counts[form] if form else None)
    root = lambda w: root(out[w][0]) if out[w][0] else w
    return {w: (f, root(w), n, k, m) for w, (f, n, k, m) in out.items()}


def variant_rows(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


@pytest.mark.parametrize("letters", ["ab", "abcdefghijkl", "aéÿß×"])
def test_variants_are_those_of_all_pairs(spark, letters):
    rng = random.Random(len(letters))
    counts = {}
    for _ in range(60):
        word = "".join(rng.choice(letters) for _ in range(rng.randint(7, 11)))
        counts[word] = rng.choice([2, 3, 30, 400, 5000])
        for _ in range(6):
            i, kind = rng.randrange(len(word)), rng.randrange(3)
            word = word[:i] + (rng.choice(letters) if kind else "") + word[i + (kind < 2) :]
            if len(word) >= 7:
                counts.setdefault(word, rng.choice([2, 3, 25, 40]))
    words = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    assert variant_rows(spelling_variants.variants(words)) == plain_variants(counts)


def test_words_with_and_without_typos(spark, tmp_path):
    rng = random.Random(13)
    known = ["Umbrella", "umbrellas", "Éclairé", "straßenbahn", "ÉCLAIRÉ", "harbour", "short", "keyboard×piano"]
    texts = [" ".join(rng.choice(known) + rng.choice([" ", ",", "9", "_", "\n"]) for _ in range(60)) for _ in range(80)] + [None, "", "longer" * 3000 + " harbour"]
    rows = [(i if i % 7 else None, t, "z") for i, t in enumerate(texts)]
    counts, plain = Counter(), Counter()
    for d, t, _ in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", t or ""):
            low = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            plain[low] += 1
            h = zlib.crc32(f"{'' if d is None else d}:{low}".encode())
            counts[low if h % 31 else low[: h % len(low)] + low[h % len(low) + 1 :]] += 1
    kept = lambda c: {w: n for w, n in c.items() if len(w) >= 7 and n >= 2}
    spark.createDataFrame(rows, "doc_id long, text string, word string").write.parquet(str(tmp_path / "documents.parquet"))
    assert variant_rows(spelling_variants.op13_spelling_variants(spark, str(tmp_path))) == plain_variants(kept(counts))
    table = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert {r.word: r.n for r in spelling_variants.word_counts(table).collect()} == kept(plain)
    assert spelling_variants.variants(spelling_variants.word_counts(table.where(F.lit(False)))).count() == 0
