import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glasspane.functions import fixed_values as V
from glasspane.functions.prefilter import Possible, needed, needed_sql
from glasspane.functions.text import decode_sql, text_slices
from glasspane.operators import links
from glasspane.plans import queries


def test_a_turn_does_not_run_on_in_the_templates_sentence(spark, tmp_path):
    """template 5 ends in what is recommended; a turn that begins with "only" is no part of that."""
    spark.createDataFrame([(i, 5 - i % 6, "user", "only the first of all") for i in range(6)], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    spark.createDataFrame([(1, "https://a.example/", "<article></article>")], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    rows = queries.evaluation_rows(spark, str(tmp_path)).where("kind = 'link'").select("verdict").distinct().collect()
    assert [r.verdict for r in rows] == ["LOOKS_SAFE"]


def test_rows_of_one_url_are_taken_in_order(spark):
    """of rows with one url the first by the further columns counts, wherever they lie."""
    rows = [("https://a.example/", f"page {i}", i) for i in range(64)]
    random.Random(2).shuffle(rows)
    asked = spark.createDataFrame([(1, "see https://a.example/")], "me int, prompt string")
    pages = spark.createDataFrame(rows, "url string, page string, n int").repartition(8)
    assert [r.page for r in links.followed(asked, pages, "me").collect()] == ["page 0"]


def patterns():
    return [p for _, _, _, ps in V.RULES.values() for p in ps] + V.ADDRESS + V.INSTRUCT + V.PAGE_OVERRIDE


def held(needs, text):
    if needs is None or isinstance(needs, str):
        return needs is None or needs in text
    return (all if needs[0] == "AND" else any)(held(n, text) for n in needs[1])


def some_match(tokens, rng):
    """A text that the pattern's tokens match, but for what stands around it."""
    from re import _constants as C

    out = ""
    for kind, what in tokens:
        if kind is C.LITERAL:
            out += chr(what)
        elif kind is C.BRANCH:
            out += some_match(rng.choice(what[1]), rng)
        elif kind is C.SUBPATTERN:
            out += some_match(what[3], rng)
        elif kind in (C.MAX_REPEAT, C.MIN_REPEAT):
            out += "".join(some_match(what[2], rng) for _ in range(rng.randint(what[0], min(what[1], what[0] + 2))))
        elif kind is C.IN:
            fits = [c for c in map(chr, [*range(32, 127), 0xE0, 0xFC, 0xE9]) if re.match(r"[\w.\-]|\s|'", c)]
            inside = [chr(v) for k, v in what if k is C.LITERAL and what[0][0] is not C.NEGATE] or [chr(v[0]) for k, v in what if k is C.RANGE] or [" " if any(k is C.CATEGORY and v is C.CATEGORY_SPACE for k, v in what) else rng.choice(fits)]
            out += rng.choice(inside)
        elif kind in (C.ANY, C.NOT_LITERAL):
            out += "x"
    return out


def test_what_a_pattern_needs_is_in_all_that_it_matches():
    from re import _parser

    rng, met = random.Random(5), 0
    for p in patterns():
        for _ in range(60):
            text = some_match(_parser.parse(p), rng)
            if m := re.search(p, text):
                met += 1
                assert held(needed(p), m[0]), (p, text)
    assert met > 2000
    assert needed(r"a?b*") is None and needed_sql("t", r"\w+") == "true"


def test_patterns_are_only_run_where_they_can_match():
    """Every rule's pattern stands behind strings that it needs."""
    assert all(needed(p) is not None for p in patterns())


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_strings_of_all_patterns_are_found_at_once(kind, monkeypatch):
    """The same patterns as by looking for each string on its own, whatever lies around a text."""
    monkeypatch.setattr("glasspane.functions.prefilter.SLICE", 2000)
    from re import _parser

    rng = random.Random(7)
    asked = Possible(patterns())
    texts = [some_match(_parser.parse(p), rng) for p in patterns() for _ in range(4)] + ["", None, "é", "remembe", "r", "ütrust", "надійн джерел"]
    texts += [" ".join(rng.sample(asked.strings, 12)) + "\U0001f600" for _ in range(60)]
    rng.shuffle(texts)

    def holds(needs, text):
        return needs is None or (needs in text if isinstance(needs, str) else (all if needs[0] == "AND" else any)(holds(x, text) for x in needs[1]))

    want = [[i for i, p in enumerate(patterns()) if holds(needed(p), t or "")] for t in texts]
    assert asked.of(pa.array(texts, kind)).to_pylist() == want and sum(map(bool, want)) > 100
    assert asked.of(pa.array(texts, kind).slice(5, 90)).to_pylist() == want[5:95]
    assert asked.of(pa.array([], kind)).to_pylist() == []


def test_decoding_of_odd_escapes(spark):
    odd = ["a%20b+c", "%", "%4", "%zz%41", "%+1", "%C3%A9", "%C3", "%ED%A0%80", "%EF%BF%BD", "é%41", "%４１", "%2B+", "", None, "%00", "100%25", "%-1"]
    got = [r.d for r in spark.createDataFrame([(i, x) for i, x in enumerate(odd)], "i int, x string").orderBy("i").select(F.expr(decode_sql("x")).alias("d")).collect()]

    def want(x):
        parts = re.findall(r"%[0-9A-Fa-f]{2}|[^%]+|%", x)
        return b"".join(bytes.fromhex(p[1:]) if re.fullmatch("%[0-9A-Fa-f]{2}", p) else p.encode() for p in parts).decode("utf-8", "replace")

    assert got == [None if x is None else want(x) for x in odd]


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_batches_are_gone_through_in_slices(kind):
    """Whole rows, none twice, a long text on its own."""
    texts = pa.array(["x" * n for n in (10, 0, 5, 300, 1, 99, 1)] + [None], kind)
    got = list(text_slices(texts, 100))
    assert [a for a, _ in got] == [0, *(b for _, b in got[:-1])] and got[-1][1] == 8
    assert all(sum(len(t or "") for t in texts.slice(a, b - a).to_pylist()) <= 100 or b == a + 1 for a, b in got)
    assert list(text_slices(texts.slice(0, 0))) == [] and list(text_slices(texts.slice(3, 2), 100)) == [(0, 1), (1, 2)]


def test_links_of_large_keys_are_settled(spark, monkeypatch):
    """op2: both steps of verification are tables of their own, so that no task has the Python workers of two steps at once."""
    from glasspane.llm import simhash

    settled = []
    monkeypatch.setattr(simhash, "settle", lambda df, label, f=simhash.settle: settled.append(label) or f(df, label))
    rows = spark.createDataFrame([(i, i) for i in range(40)], "fp long, node long")
    assert simhash.links(rows, 4).count() >= 39 and settled == ["simhash-links"] * 2


def test_places_before_others():
    """op12: what lies before each place, without a search for each."""
    import numpy as np

    from glasspane.llm.substring_dedup import below

    rng = np.random.default_rng(3)
    for n in (0, 1, 5, 300):
        starts = np.flatnonzero(rng.random(n) < 0.4)
        assert below(starts, n).tolist() == np.searchsorted(starts, np.arange(n + 1)).tolist()


def test_the_stage_finds_near_copies_by_fingerprints(spark, monkeypatch):
    """blocks are runs of a SimHash fingerprint, as plain counting of bits gives it; large blocks in pieces, nothing lost."""
    import numpy as np

    from glasspane.llm import simhash
    from glasspane.llm.components import components

    rng = np.random.default_rng(8)
    x = np.unique(rng.integers(0, 1 << 63, 300, dtype=np.uint64))
    with np.errstate(over="ignore"):
        h = x[:, None] * simhash.FACTORS
        h = (h ^ (h >> np.uint64(32))) * simhash.MIX
    h ^= h >> np.uint64(29)
    counts = np.array([((h >> np.uint64(b)) & np.uint64(1)).sum(axis=0) for b in range(64)])
    want = (counts.reshape(8, 8, simhash.WIDE).transpose(1, 2, 0) * 2 > len(x)).ravel()
    prints = simhash.wide_fingerprint(x)
    assert (np.unpackbits(prints.view(np.uint8)).astype(bool) == want).all()
    assert (simhash.band_keys(x) & 0xFFFF == prints.view(np.uint16)).all()
    for _ in range(200):  # a shingle more on four
        five = rng.integers(0, 1 << 63, 5, dtype=np.uint64)
        assert set(simhash.band_keys(np.sort(five)[1:])) & set(simhash.band_keys(np.sort(five)))

    sets = []
    for _ in range(20):
        base = rng.integers(0, 1 << 63, 90, dtype=np.uint64)
        sets += [np.unique(np.concatenate([base[k:], rng.integers(0, 1 << 63, k, dtype=np.uint64)])) for k in (0, 2, 5, 8)]
    rows = []
    for i, s in enumerate(sets):
        p = simhash.wide_fingerprint(s)
        rows.append((i, len(s), [*simhash.band_keys(s, p).tolist(), 7], *p[:2].view(np.int64).tolist()))
    classes = spark.createDataFrame(rows, "cls long, n int, keys array<int>, x long, y long")
    similar = lambda a, b: 9 * len(np.intersect1d(sets[a], sets[b])) >= 4 * (len(sets[a]) + len(sets[b]))
    near = {(a, b) for b in range(len(sets)) for a in range(b) if similar(a, b)}
    assert len(near) > 60
    for paired, most in ((32, 1 << 13), (32, 8), (2, 8)):  # all are under block 7, which is then too large for one piece
        monkeypatch.setattr(simhash, "PAIRED", paired)
        met = simhash.candidates(classes, most).collect()
        group = {r.node: r.component for r in components(spark.createDataFrame([(r.a, r.b) for r in met if r.many] or [(0, 0)], "a long, b long")).collect()}
        pairs = {(r.a, r.b) for r in met if not r.many}
        assert all(p in pairs or group.get(p[0], -1) == group.get(p[1], -2) for p in near)
        assert any(r.many for r in met) == (paired == 2)


def test_stages_take_small_batches(spark):
    """pipeline: between the JVM and a worker there are batches of some megabytes, not of 10,000 texts."""
    from glasspane.llm import common, decontaminate, langid, sentencepiece_codec, simhash

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"rows": [batch.num_rows], "bytes": [batch.nbytes]})

    before = spark.conf.get(common.BATCH_BYTES)
    try:
        docs = spark.range(8000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 1000).alias("text")).coalesce(1)
        sentencepiece_codec.stage_tokens(spark, docs, "")
        got = docs.mapInArrow(sizes, "rows long, bytes long").agg(F.sum("rows").alias("rows"), F.max("bytes").alias("most")).first()
        assert got.rows == 8000 and got.most < 3 << 20
        for stage in (langid.stage_language, simhash.stage_near_duplicates, decontaminate.stage_decontaminate):
            assert "small_batches" in stage.__code__.co_names
    finally:
        spark.conf.set(common.BATCH_BYTES, before)
