"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from framelake import session
from framelake.llm import ann, line_dedup, mixing, packing, quality, simhash, token_counts, toxicity, url_filters, warc
from framelake.llm.queries import RULES, vocabulary

LONG = "word " * 60_000
ROWS = [
    (1, None, "en", "a"),
    (2, "", "en", "a"),
    (3, " \n\t ", None, None),
    (4, "same words here twice over and over again. The end of it all.", "en", "a"),
    (4, "same words here twice over and over again. The end of it all.", "en", "a"),
    (5, "same words here twice over and over again. The end of it all.", "en", "b"),
    (None, "a row without an id", "en", "b"),
    (6, LONG, "en", "b"),
    (7, "x" * 300_000, "de", None),
    (8, "<|endoftext|> and <s> are text \u2581 here\u00a0too \U0001f600", "de", "c"),
]
CLASHING = ["row", "size", "hash", "block", "target", "n", "words", "total", "score", "label", "toxic", "host", "path", "component_id", "fingerprint", "length", "salt", "shards", "marks", "digest", "first", "key", "payload", "n_chars"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    return df.select("*", *(F.lit(7).alias(c) for c in CLASHING))


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def ids(df):
    return sorted((r[0] for r in df.select("doc_id").collect()), key=lambda x: (x is None, x))


IDS = sorted((r[0] for r in ROWS), key=lambda x: (x is None, x))
VOCABULARY = {"pieces": "byte_bpe_50k.json", "counts": "piece_bpe_32k.model"}


def test_packing(docs, none):
    got = packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"), with_ids=True).collect()
    assert {r["doc_id"] for r in got} == set(IDS) and sum(r["piece"] == 0 for r in got) == len(IDS)
    assert [r["length"] for r in got if r["doc_id"] in (1, 2)] == [1, 1]
    assert all(len(r["ids"]) == r["length"] <= 2048 for r in got)
    assert {50256} <= set(next(r for r in got if r["doc_id"] == 8)["ids"])
    assert packing.pack_documents(none, vocabulary("byte_bpe_50k.json")).count() == 0


def test_token_counts(docs, none):
    import sentencepiece

    path = vocabulary("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = token_counts.count_tokens(docs, path).collect()
    want = sorted((r[0] is None, r[0] or 0, len(sp.encode(r[1] or "")), len((r[1] or "").encode())) for r in ROWS)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["n_bytes"]) for r in got) == want
    assert token_counts.count_tokens(none, path).count() == 0


def test_mixing(docs, none):
    got = mixing.mix_sources(docs).select("row.doc_id", "row.target", "size", "source_size", "target", "shards").collect()
    assert len(got) == len(ROWS) and all(len(r["shards"]) <= 3 for r in got)
    assert all(not r["shards"] for r in got if r["size"] == 0)
    assert mixing.mix_sources(none).count() == 0 and mixing.drawn_rows(mixing.mix_sources(none)).count() == 0
    assert mixing.drawn_rows(mixing.mix_sources(docs)).columns == docs.columns


def test_quality(docs, none):
    got = quality.judge(docs).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == sorted((r[0] is None, r[0] or 0) for r in ROWS)
    by = {r["doc_id"]: r for r in got}
    assert by[1]["n_words"] == 0 and by[1]["base_failed"] and not by[1]["kept"]
    assert by[6]["n_words"] == by[6]["n_repeat_words"] == 60_000
    assert quality.judge(none).count() == 0


def test_simhash(docs, none):
    got = simhash.fingerprint_groups(docs).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(ROWS) and by[1]["fingerprint"] == "0" * 16 and by[3]["component_id"] == 1
    assert by[4]["component_id"] == by[5]["component_id"] == 4
    groups = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(docs).collect()}
    assert groups[5] == 4 and groups[2] == groups[3] == 1 and groups[None] is None
    assert simhash.fingerprint_groups(none).count() == simhash.similar_groups(none).count() == 0


def test_line_dedup(docs, none):
    passage = "This passage has words enough to count as one of those. It has a second sentence with several more words in it. And a third one that goes on for a while before it stops. The fourth one follows with a dozen words and then ends it. Nobody reads the fifth sentence of a passage such as this one here."
    more = docs.limit(0).select("doc_id", "text").union(docs.sparkSession.createDataFrame([(1, "Alpha opens this text. " + passage + " Then it goes on."), (2, "Beta begins here. " + passage), (3, None)], "doc_id long, text string"))
    got = {r["row"]["doc_id"]: r for r in line_dedup.dedup_lines(more).collect()}
    assert got[1]["text"].count("third one") == 1 and "third one" not in got[2]["text"] and got[3]["text"] is None
    assert got[2]["removed_words"] >= 40
    all_rows = line_dedup.dedup_lines(docs)
    assert all_rows.count() == len(ROWS) and line_dedup.dedup_lines(none).count() == 0
    assert {r["row"]["doc_id"]: r["text"] for r in all_rows.collect()}[4] == ROWS[3][1]


def test_toxicity(docs, none, spark):
    labels = spark.createDataFrame([(None, 0, 1), (4, 1, None), (8, 0, 1), (8, 0, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")
    got = toxicity.score_documents(docs, labels).collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in got)
    assert toxicity.score_documents(none, labels).count() == 0
    assert {r["score"] for r in toxicity.score_documents(docs, labels.where("false")).collect()} == {0.0}


def test_url_filters(spark):
    urls = [(1, None), (2, ""), (3, "no scheme"), (4, "http://A.EXAMPLE.com/en/7x?q=1"), (5, "ftp://com"), (6, "http://x.net/de/80#a"), (6, "http://x.net/de/80#a"), (None, "http://b.example.net/de/8/" + "y" * 100_000), (7, "http://x.org?/es/"), (8, "x://com/en/://org/es/")]
    pages = spark.createDataFrame(urls, "page_id long, url string").select("*", *(F.lit(1).alias(c) for c in ("host", "path", "rule", "row", "verdict", "short", "salt")))
    rules = url_filters.rule_table(spark, [*RULES, (None, "/x", "block"), ("com", "/en/", "block")])
    got = sorted(((r["row"]["page_id"] or 0), r["host"], r["path"][:9], r["rule"], r["verdict"]) for r in url_filters.apply_rules(pages, rules).where("true").collect() if r["rule"] or r["host"])
    assert got == [
        (0, "b.example.net", "/de/8/yyy", "example.net/de/8", "block"),
        (4, "a.example.com", "/en/7x", "example.com/en/7", "allow"),
        (6, "x.net", "/de/80", "net/de/", "block"),
        (6, "x.net", "/de/80", "net/de/", "block"),
        (8, "com", "/en/://or", "com/en/", "block"),
    ] or [g for g in got if g[0] not in (5, 7)] == [
        (0, "b.example.net", "/de/8/yyy", "example.net/de/8", "block"),
        (4, "a.example.com", "/en/7x", "example.com/en/7", "allow"),
        (6, "x.net", "/de/80", "net/de/", "block"),
        (6, "x.net", "/de/80", "net/de/", "block"),
        (8, "com", "/en/://or", "com/en/", "block"),
    ]
    assert url_filters.apply_rules(pages, rules).count() == len(urls)
    assert url_filters.apply_rules(pages, rules.where("false")).where("verdict = 'allow'").count() == len(urls)
    assert url_filters.apply_rules(pages.where("false"), rules).count() == 0


def test_many_rules_are_joined_with_salt(spark, monkeypatch):
    pages = spark.createDataFrame([(i, f"http://h{i}.com/en/{i}") for i in range(50)], "page_id long, url string")
    rules = url_filters.rule_table(spark, RULES)
    plain = sorted(map(tuple, url_filters.apply_rules(pages, rules).select("row.page_id", "rule").collect()))
    monkeypatch.setattr(url_filters, "broadcast_if_small", lambda df: df)
    assert sorted(map(tuple, url_filters.apply_rules(pages, rules).select("row.page_id", "rule").collect())) == plain


def test_warc(spark, tmp_path):
    big = "é" * 200_000
    data = [(1, "http://a/\r\nX: y", None), (2, None, ""), (3, "u", "s" * 100), (4, "u", "s" * 100), (4, "u", "s" * 100), (None, "u", "s" * 100), (5, "u", "s" * 99), (6, "u", "s" * 99), (7, "u", big), (9, "u", "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 9)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string").select("*", *(F.lit(1).alias(c) for c in ("row", "key", "payload", "digest", "first", "value")))
    path = str(tmp_path / "w")
    warc.write_archive(pages, path)
    got = warc.read_archive(spark, path)
    seen = sorted((r["record_id"], r["warc_type"], r["refers_to"], r["payload_bytes"], r["payload"]) for r in got.collect())
    assert len(seen) == len(data)
    uri = lambda i: f"<urn:framelake:{i}>"
    assert [s[0] for s in seen if s[1] == "revisit"] == [uri(4), uri(4)]
    assert {s[2] for s in seen if s[1] == "revisit"} == {uri(3)} and {s[3] for s in seen if s[1] == "revisit"} == {100}
    assert {s[0]: s[4] for s in seen}[uri(7)] == big and {s[0]: s[4] for s in seen}[uri(9)] == data[-1][2]
    assert got.where("warc_type = 'revisit' AND content_length > 0").count() == 2
    bare = warc.read_archive(spark, path, payload=False).where("record_id LIKE '<urn:framelake:7%'").collect()
    assert len(bare) == 1 and bare[0]["payload"] is None
    empty = str(tmp_path / "none")
    warc.write_archive(pages.where("false"), empty)
    assert warc.read_archive(spark, empty).count() == 0
    members = []
    for name in sorted(tmp_path.glob("w/part-*.warc.gz")):
        rest = name.read_bytes()
        while rest:
            one = zlib.decompressobj(31)
            members.append(one.decompress(rest))
            rest = one.unused_data
    assert len(members) == len(data) and all(m.startswith(b"WARC/1.1\r\n") and m.endswith(b"\r\n\r\n") for m in members)
    assert not [p for p in tmp_path.glob("w/*") if p.name.startswith(".part")]


def test_warc_passes_over_bodies(spark, tmp_path, monkeypatch):
    """Bodies of records that no predicate admits are neither split nor decoded; files end by bytes."""
    from pyspark.sql.datasource import EqualTo, In

    pages = spark.createDataFrame([(i, "u", f"{i}" * 500) for i in range(20)], "page_id long, url string, html string").coalesce(1)
    path = str(tmp_path / "w")
    spark.dataSource.register(warc.WarcSource)
    warc.records(warc.revisits(pages)).write.format("warc").option("file_bytes", 1000).mode("append").save(path)
    assert len(list(tmp_path.glob("w/part-*"))) > 2
    opened, split = [], warc.split_http
    monkeypatch.setattr(warc, "split_http", lambda block: opened.append(block) or split(block))
    reader = warc.WarcReader({"path": path, "split_bytes": "1"})
    assert list(reader.pushFilters([EqualTo(("record_id",), "<urn:framelake:7>"), In(("warc_type",), ("response", "revisit"))])) == []
    assert len(reader.partitions()) > 2
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert [r[2] for r in rows] == ["<urn:framelake:7>"] and rows[0][-1] == "7" * 500 and len(opened) == 1


def test_nearest(spark):
    v = [[1.0, 0.0], [0.0, 1.0], [1.0, 1.0]]
    data = [(0, v[0]), (20, v[1]), (40, v[2]), (41, v[2]), (42, v[2]), (43, None), (44, [0.0, 0.0]), (45, [None, 1.0]), (46, [float("nan"), 1.0]), (47, [float("inf"), 1.0]), (48, [1.0]), (None, v[0]), (60, v[0]), (60, v[0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").select("*", *(F.lit(1).alias(c) for c in ("v", "cell", "salt", "kind", "rank", "score")))
    got = {}
    for r in ann.nearest(df, k=3).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(got) == {0, 20, 40, 60}
    assert got[40] == [(41, 2.0), (42, 2.0), (0, 1.0)] and [x for x, _ in got[20]] == [40, 41, 42]
    assert [x for x, _ in got[60]] == [0, 40, 41]
    assert ann.nearest(df.where("false")).count() == 0


def test_stages(docs, none, spark, tmp_path):
    spark.createDataFrame([(4, 1, 0), (8, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        for df in (docs, none):
            out = stage(spark, df, str(tmp_path))
            n = out.count()
            assert n == 0 if df is none else n > 0, name
            if name != "packing":
                assert out.columns == df.columns, name


def test_near_copies_keep_clean_rows(spark, tmp_path):
    """Null ids and ids with several texts, beside a repeated row."""
    text = lambda k: " ".join(f"t{k}w{i}" for i in range(40))
    data = [(1, text(1)), (1, text(1)), (None, text(2)), (None, text(3)), (None, text(3)), (5, text(5)), (5, text(6)), (7, text(5) + " more"), (8, text(8)), (7, text(7)), (None, text(8))]
    got = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(data, "doc_id long, text string"), str(tmp_path)).collect()
    want = [(1, text(1)), (None, text(2)), (None, text(3)), (5, text(5)), (5, text(6)), (8, text(8)), (7, text(7))]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_line_hashes_take_little_memory():
    """The numbers of a batch of texts are held for a part of them at a time."""
    import tracemalloc

    from framelake.llm import line_dedup

    texts = [f"words of line {i} and of others. " * 300 for i in range(400)]
    line_dedup.chunks_of(texts[:1])
    tracemalloc.start()
    for _, part in line_dedup.parted(texts):
        line_dedup.chunks_of(part)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 << 20, peak


def shuffle_files(spark) -> set[str]:
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for i in range(found.size()) if (name := found.apply(i).getName()).startswith("shuffle_")}


def test_written_tables_leave_no_shuffle_files(spark):
    before = shuffle_files(spark)
    settings = {k: spark.conf.get(k) for k in session.WRITING}
    written = session.materialise_parts((spark.range(1000).groupBy((F.col("id") % n).alias("rest")).count() for n in (7, 11)), "rests")
    assert shuffle_files(spark) <= before
    assert settings == {k: spark.conf.get(k) for k in session.WRITING}
    assert written.count() == 18 and written.agg(F.sum("count")).first()[0] == 2000
    session.release(written)


def test_toxicity_in_slices(spark, monkeypatch):
    """Documents meet the model a slice at a time, one slice's shuffle files gone before the next; the scores are those of one slice."""
    words = ["bad", "good", "fine", "mean", "kind", "rude", "calm", "odd"]
    rows = [(i if i % 9 else None, " ".join(words[(i * k + k * k) % (4 + 4 * (i % 2))] + str(i * k % 13) for k in range(30)), i % 2) for i in range(300)]
    docs = spark.createDataFrame([r[:2] for r in rows + rows[:20]], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] is not None], "doc_id long, toxic int")
    left, write = [], toxicity.materialise_parts

    def watched(parts, purpose):
        def each():
            for part in parts:
                left.append(len(shuffle_files(spark) - before))
                yield part

        return write(each(), purpose)

    monkeypatch.setattr(toxicity, "materialise_parts", watched)
    monkeypatch.setattr(toxicity, "HOT", 16)
    monkeypatch.setattr(toxicity, "HOT_WORDS", 4)
    found = []
    for slices in (1, 3):
        monkeypatch.setattr(toxicity, "SLICES", slices)
        monkeypatch.setattr(toxicity, "PAIR_SLICES", slices)
        before = shuffle_files(spark)
        left.clear()
        scored = toxicity.score_documents(docs, labels).select("doc_id", "text_hash", F.round("score", 9)).collect()
        found.append(sorted(scored, key=str))
        assert len(left) == 2 * slices + 1
        assert max(left[1 : slices + 1]) <= left[0] and max(left[slices + 1 :]) <= left[slices + 1]
    assert found[0] == found[1] and len(found[0]) == 320


def test_workers_get_small_batches(spark):
    """Executors hold a batch for each worker as they write: 10,000 texts took the memory that line_dedup lacked."""

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    written = session.materialise(spark.range(5000, numPartitions=1).mapInArrow(sizes, "n long"), "sizes")
    assert sum(n := [r["n"] for r in written.collect()]) == 5000 and max(n) <= 1000


def test_a_worker_drops_the_packed_broadcast():
    keys = np.array([-(1 << 63), -5, 7, (1 << 63) - 1])
    hot = toxicity.Hot(keys, np.arange(4.0), -np.arange(4.0), None)
    got = hot.unpacked()
    assert (got[0] == keys).all() and got[1].tolist() == [0, 1, 2, 3] and got[3] is None
    assert not hot.packed and hot.unpacked() is got


def test_a_search_tests_its_end_seldom(monkeypatch):
    """Where distances are alike nearly all rows are verified: tests are few beside them, and the nearest are found."""
    x = np.random.default_rng(5).standard_normal((4000, 64))
    plan = ann.Plan(64, float((x * x).sum(axis=1).max()), np.random.default_rng(6).standard_normal((65, ann.DIMS)), np.full((1, ann.DIMS), -np.inf), np.full((1, ann.DIMS), np.inf), [])
    block, calls, cut = ann.Block(np.arange(4000), x, plan, 20), [], np.partition
    z = plan.project(x[:5], query=True)
    far = ann.box_distances(z, block.low, block.high)
    monkeypatch.setattr(np, "partition", lambda *a: calls.append(1) or cut(*a))
    for i in range(5):
        calls.clear()
        best, verified = block.search(i, x[i], z[i], far[i], float("-inf"))
        scores = x @ x[i]
        scores[i] = -np.inf
        nearest = set(np.argsort(-scores)[:20].tolist())
        assert len({v for v, _ in best} & nearest) >= 15 and len(best) == 20
        assert 1000 < verified <= 3999 and len(calls) <= 16
