import base64
import hashlib

import corpus_pipeline
import pyarrow as pa
from glasspane.llm import common, queries, warc


def test_archives_round_trip(spark, tmp_path):
    pages = [(1, "https://a/x\r\ny", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "https://c", None), (4, "https://d", ""), (None, "https://e", "<i>"), (6, "u", "z" * 700_000), (7, "u", "<p>é</p>"), (2, "again", "<p>é</p>")]
    rows = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, digest string")
    index = warc.write_archives(rows, "file://" + str(tmp_path / "w"))
    got = sorted(warc.read_archives(index).collect(), key=str)
    first = {"<p>é</p>": 1, "": 3, "<i>": None, "z" * 700_000: 6}
    want = []
    for i, _, html in pages:
        raw, f = (html or "").encode(), first[html or ""]
        revisit = i is not None and i != f
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", f if revisit else None))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    for r in index.collect():
        fields, block, _ = warc.parse(warc.read_record(r.bundle, r.frame_start, r.frame_bytes, r.at, r.length))
        assert fields["warc-record-id"] == f"<{r.record_id}>"
    assert warc.read_archives(warc.write_archives(rows.limit(0), "file://" + str(tmp_path / "e"))).count() == 0


def test_small_payloads_are_all_responses(spark, tmp_path):
    rows = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    got = {r.page_id: r.record_type for r in warc.read_archives(warc.write_archives(rows, "file://" + str(tmp_path / "w"), least=3)).collect()}
    assert got == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_streamed_groups_give_every_row_once():
    keys = [0] * 3 + [1] * 50 + [2, 3, 3] + [4] * 40
    batches = [pa.RecordBatch.from_pydict({"k": keys[i : i + 7]}) for i in range(0, len(keys), 7)]
    got, whole = [], []
    for ok, t in common.streamed_groups(iter(batches), ["k"], 10):
        got += t.column("k").to_pylist()
        whole += sorted(set(t.column("k").to_pylist())) if ok else []
    assert got == keys
    assert len(whole) == len(set(whole)) and {0, 2, 3} <= set(whole) and 1 not in whole


def test_pipeline(spark, tmp_path):
    sf = str(tmp_path)
    words = "the old stone house stands by the river and the water runs under the bridge near a mill".split()
    text = lambda k: " ".join(words[(i * k + i // 7) % len(words)] for i in range(120))
    quote = "which bird builds nests of clay under the roof in late spring and why does it return"
    key = hashlib.sha1(b"x").hexdigest()
    docs = [(1, text(1)), (2, text(1)), (3, text(3)), (4, text(5) + " " + quote + " " + text(7)), (5, "!!! 123"), (6, None), (7, text(11) + f' token = "{key}"'), (8, text(13))]
    rows = spark.createDataFrame([(i, t, "en", "src", len(t or ""), "more") for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long, extra string")
    rows.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(0, quote)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    now, seen = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        now = common.settle(stage(spark, now, sf), "test")
        seen[name] = now
        if name != corpus_pipeline.STAGES[-1][0]:
            assert now.columns == rows.columns
    ids = lambda name: sorted(r.doc_id for r in seen[name].collect())
    assert ids("language_id") == [1, 2, 3, 4, 7, 8]
    assert ids("simhash_near_dedup") == [1, 3, 4, 7, 8]
    assert ids("decontamination") == ids("secret_scan") == ids("sentencepiece") == [1, 3, 7, 8]
    assert key not in next(r.text for r in seen["secret_scan"].collect() if r.doc_id == 7)
    assert all(r.decodes and r.n_tokens == len(r.ids) for r in now.collect())
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, sf).collect()) == [1, 3, 7, 8]


def test_every_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))


def test_sql_is_text():
    assert all(isinstance(q, str) for q in queries.oracle_sql().values())
    assert set(queries.oracle_sql()) <= set(queries.queries())
