import random
import zlib

import pytest

import corpus_pipeline
from eigenfold.llm import simhash
from eigenfold.llm.common import components

from .test_text import check_packing, toxic_rows


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 101), (101, 102), (7, 7), (-5, 200), (300, 300)] + [(500, 500 + k) for k in range(1, 30)]
    frame = spark.createDataFrame([*edges, (None, 3), (4, None)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(frame).collect()}
    assert all(got[k] == 0 for k in range(41)) and got[102] == 100 and got[200] == -5 and got[300] == 300 and got[529] == 500
    assert components(frame.limit(0)).count() == 0


def test_few_rows_are_checkpointed_in_few_files(spark, monkeypatch):
    """Near copies through all of SimHash's steps, with many shuffle partitions that Spark leaves as they are."""
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    docs = spark.createDataFrame([(k, " ".join(f"w{i}" for i in range(60)) + f" x{k % 70}") for k in range(200)], "doc_id long, text string").coalesce(2)
    files, plain = [], type(docs).checkpoint
    monkeypatch.setattr(type(docs), "checkpoint", lambda self: (out := plain(self), files.append(out.rdd.getNumPartitions()))[0])
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        got = {r["doc_id"]: r["component_id"] for r in simhash.simhash_components(docs).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    from .test_text import classes

    rows = docs.collect()
    assert got == classes([r["doc_id"] for r in rows], [simhash.fingerprint(r["text"]) for r in rows])
    assert len(files) > 5 and max(files) <= spark.sparkContext.defaultParallelism


@pytest.fixture()
def corpus(spark, tmp_path):
    rng = random.Random(11)
    rows, labels = toxic_rows(rng, 300)
    docs = [(k, t, "aa" if k % 2 else "bb", "s", len(t)) for k, t in rows]
    docs += [(1000 + k, docs[k][1], "aa", "s", 1) for k in range(20)]  # exact copies
    docs += [(2000, None, None, "s", 0), (2001, "12 34 !!", None, "s", 1), (2002, "", "aa", "s", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, 1, y) for k, y in labels], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path), docs, dict(labels)


def test_stages(spark, corpus, tmp_path):
    sf, docs, labels = corpus
    frame = spark.read.parquet(f"{sf}/documents.parquet")
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, frame, sf)
        if name != "packing":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.write.parquet(f"{tmp_path}/{name}")
        frame = spark.read.parquet(f"{tmp_path}/{name}")
        left[name] = frame.collect()
    kept = {n: {r["doc_id"] for r in rows} for n, rows in left.items()}
    assert kept["language"].isdisjoint({2000, 2001, 2002}) and len(kept["language"]) >= 0.9 * 320
    clean = {d[0] for d in docs if d[0] in kept["language"] and not labels.get(d[0] % 1000, 0)}
    assert len(kept["toxicity"] & clean) >= 0.97 * len(clean) and len(kept["toxicity"] - clean) <= 5
    texts = [r["text"] for r in left["toxicity"]]
    keys = [r["doc_id"] for r in left["toxicity"]]
    fp = [simhash.fingerprint(t) for t in texts]
    from .test_text import classes

    want = {k for k, c in classes(keys, fp).items() if k == c}
    assert kept["simhash"] == want
    by = {d[0]: d[1] for d in docs}
    check_packing([(k, by[k]) for k in kept["simhash"]], left["packing"])
    assert corpus_pipeline.ORACLE_SQL is None


def test_run_is_the_stages_in_a_row(spark, corpus):
    sf, docs, _ = corpus
    rows = corpus_pipeline.run(spark, sf).collect()
    by = {d[0]: d[1] for d in docs}
    check_packing([(k, by[k]) for k in {r["doc_id"] for r in rows}], rows)


def test_stages_on_odd_rows(spark, tmp_path):
    """Empty tables, null keys and texts, repeated rows, and further columns whose names are those of results."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, key string, fp long, component_id long"
    rng = random.Random(3)
    rows = [(k, t, "aa", "s", 1, 0.5, "k", 7, 9) for k, t in toxic_rows(rng, 40)[0]]
    rows += [rows[3], (None, rows[5][1], None, None, None, None, None, None, None), (900, None, None, "s", 0, 0.1, "k", 1, 1), (901, "", "aa", "s", 0, 0.1, "k", 1, 1)]
    spark.createDataFrame([(k, 1, k % 2) for k in range(20)] + [(None, 1, 1), (5, 1, None), (5, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    frame = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, frame.limit(0), str(tmp_path))
        assert empty.count() == 0
        out = stage(spark, frame, str(tmp_path))
        if name == "packing":
            assert {r["doc_id"] for r in out.collect()} == {r[0] for r in rows}
            continue
        assert out.columns == empty.columns == frame.columns
        kept = [tuple(r) for r in out.collect()]
        assert set(kept) <= set(rows) and len(kept) == len(set(kept)) + (rows[3] in kept and name != "simhash")
        assert ((None, *rows[-3][1:]) in kept) and (name != "language" or not {900, 901} & {r[0] for r in kept})


def test_entry_lists_every_operator():
    import __spark_entry__ as entry

    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names) and zlib.crc32(b"7") % 4 in range(4)
