"""Readers, writers and resumable runs."""

import gzip
import json

import pytest

from millrace.operators import filters
from millrace.sources import readers, writers
from millrace.streaming import incremental


def lines(path, rows, zipped=False):
    data = "".join(json.dumps(r) + "\n" for r in rows)
    (gzip.open(path, "wt") if zipped else open(path, "w")).write(data)


def test_jsonl(spark, tmp_path):
    lines(tmp_path / "a.jsonl", [{"doc_id": "1", "text": "one two"}, {"id": "x", "text": "three", "estimated_tokens": 7}])
    lines(tmp_path / "b.jsonl.gz", [{"text": "no id"}], zipped=True)
    rows = {r["text"]: r for r in readers.normalise(readers.jsonl(spark, str(tmp_path))).collect()}
    assert rows["one two"]["estimated_tokens"] == 2 and rows["three"]["doc_id"] == "x" and rows["three"]["estimated_tokens"] == 7
    assert rows["no id"]["doc_id"].startswith("doc-")
    (tmp_path / "bad.jsonl").write_text('{"text": \n')
    with pytest.raises(Exception):
        readers.jsonl(spark, str(tmp_path)).collect()


def test_dataset_and_config(spark, tmp_path):
    lines(tmp_path / "c.jsonl", [{"body": "  hello  "}, {"body": "   "}, {"body": "x"}])
    got = readers.from_config(spark, {"provider": "jsonl", "path": str(tmp_path / "c.jsonl"), "text_field": "body", "source": "s"})
    assert sorted(r["text"] for r in got.collect()) == ["hello", "x"]
    with pytest.raises(ValueError):
        readers.from_config(spark, {"provider": "nothing"})
    assert readers.from_config(spark, {"provider": "jsonl", "path": str(tmp_path / "no"), "fallback": {"provider": "jsonl", "path": str(tmp_path / "c.jsonl"), "text_field": "body"}}).count() == 2


def test_text_and_wikitext(spark, tmp_path):
    (tmp_path / "t.txt").write_text("first\npart\n\nsecond\n")
    assert [r["text"] for r in readers.text_chunks(spark, str(tmp_path / "t.txt")).orderBy("chunk").collect()] == ["first\npart", "second"]
    (tmp_path / "w.txt").write_text("preface\n = One = \nbody one\n = = Sub = = \nmore\n = Two = \nbody two\n")
    got = readers.wikitext(spark, str(tmp_path / "w.txt")).orderBy("article").collect()
    assert [r["title"] for r in got] == ["One", "Two"] and "more" in got[0]["text"] and got[1]["text"] == "body two"


def test_budget():
    assert [readers.parse_budget(x) for x in ("10K", "1M", "1B", "full", None, 12, "1.5k")] == [10_000, 10**6, 10**9, None, None, 12, 1500]


def test_inspect(spark, tmp_path):
    (tmp_path / "i.jsonl").write_text('{"text": "a b", "id": 1}\n{"text": ""}\nnot json\n\n')
    r = readers.inspect(spark, str(tmp_path / "i.jsonl")).first()
    assert (r["documents"], r["tokens"], r["empty"], r["invalid"]) == (3, 2, 1, 1)
    assert set(r["fields"]) >= {"text", "id"}


def test_bundle(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b", "s"), (2, "a B", "s"), (3, "c d e", "t")], "doc_id long, text string, source string")
    out = writers.filter_bundle(df, filters.decide(df, "exact_dedup"), str(tmp_path / "out"))
    assert out["summary"]["kept_documents"] == 2 and spark.read.parquet(str(tmp_path / "out/kept")).count() == 2
    assert writers.content_hash(df) == writers.content_hash(df.repartition(5)) != writers.content_hash(df.limit(2))
    m = writers.manifest(df.withColumnRenamed("source", "split"), "n", {"a": 1})
    assert m["splits"]["s"]["documents"] == 2 and writers.validate(df.withColumnRenamed("source", "split"), m, {"a": 1}) == []
    assert writers.validate(df.withColumnRenamed("source", "split"), m, {"a": 2}) == ["config_hash"]
    writers.jsonl(df, str(tmp_path / "j"), by="source", gzip=True)
    assert spark.read.json(str(tmp_path / "j")).count() == 3


def test_resumable(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "state")
    source.mkdir()
    schema = "doc_id long, text string"
    from pyspark.sql.types import _parse_datatype_string

    schema = _parse_datatype_string(schema)
    lines(source / "a.json", [{"doc_id": 1, "text": "a b"}, {"doc_id": 2, "text": "c"}])
    assert incremental.dedup(spark, str(source), schema, out) == 1
    assert incremental.dedup(spark, str(source), schema, out) == 0
    lines(source / "b.json", [{"doc_id": 3, "text": "A  B"}, {"doc_id": 4, "text": "d"}, {"doc_id": 5, "text": "D"}])
    assert incremental.dedup(spark, str(source), schema, out) == 1
    assert sorted(r["doc_id"] for r in spark.read.parquet(f"{out}/data").collect()) == [1, 2, 4]
    with pytest.raises(ValueError):
        incremental.run(spark, str(source), schema, out, lambda d, n: d, {"other": 1})
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    assert incremental.event_counts(events).count() > 5


def test_a_retried_batch_keeps_its_rows(spark, tmp_path):
    """A batch whose data were written but not committed runs again and finds the same rows."""
    from pyspark.sql.types import _parse_datatype_string

    source, out = tmp_path / "in", tmp_path / "state"
    source.mkdir()
    schema = _parse_datatype_string("doc_id long, text string")
    lines(source / "a.json", [{"doc_id": 1, "text": "a b"}, {"doc_id": 2, "text": "c"}])
    assert incremental.dedup(spark, str(source), schema, str(out)) == 1
    lines(source / "b.json", [{"doc_id": 3, "text": "c"}, {"doc_id": 4, "text": "d"}])
    assert incremental.dedup(spark, str(source), schema, str(out)) == 1
    for f in (out / "checkpoint/commits").iterdir():
        if f.name.strip(".").startswith("1"):
            f.unlink()
    assert incremental.dedup(spark, str(source), schema, str(out)) == 1
    assert sorted(r["doc_id"] for r in spark.read.parquet(str(out / "data")).collect()) == [1, 2, 4]


def test_ids_are_the_same_in_each_reading(spark, tmp_path):
    lines(tmp_path / "a.jsonl", [{"text": f"row {k}"} for k in range(50)])
    a = readers.normalise(readers.jsonl(spark, str(tmp_path)))
    b = readers.normalise(readers.jsonl(spark, str(tmp_path)).repartition(7))
    assert {tuple(r) for r in a.select("doc_id", "text").collect()} == {tuple(r) for r in b.select("doc_id", "text").collect()}
    assert a.select("doc_id").distinct().count() == 50 and "metadata" in a.columns


def test_data_source(spark, tmp_path):
    from millrace.sources import datasource

    lines(tmp_path / "a.jsonl", [{"doc_id": 1, "text": "one"}, {"text": "two", "split": "test"}])
    lines(tmp_path / "b.jsonl.gz", [{"id": "x", "text": None}], zipped=True)
    datasource.register(spark, shout=lambda rows, options: ((k, (None, r.strip().upper(), "", "")) for k, r in enumerate(rows)))
    got = {(r["doc_id"], r["text"], r["split"]) for r in spark.read.format("corpus_shards").load(str(tmp_path)).collect()}
    assert got == {("1", "one", "train"), ("a.jsonl:2", "two", "test"), ("x", "", "train")}
    assert spark.read.format("corpus_shards").option("kind", "text").load(str(tmp_path / "a*")).count() == 2
    with pytest.raises(Exception, match="no field"):
        spark.read.format("corpus_shards").option("text_field", "body").load(str(tmp_path)).collect()


def test_plug_ins(spark):
    from pyspark.sql import functions as F

    from millrace.functions import counters

    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    counters.register("letters a", lambda x: F.regexp_count(x, F.lit("a")))
    assert [r[0] for r in df.orderBy("doc_id").select(counters.count(F.col("text"), "letters a")).collect()] == [1, 0]
    filters.register("first only", lambda d, rate: d.select("doc_id", (F.col("doc_id") == 1).alias("keep"), F.lit(1.0).alias("score"), F.lit("x").alias("reason")))
    try:
        assert filters.decide(df, "first only").where("keep").count() == 1
        with pytest.raises(ValueError):
            filters.register("raw", None)
    finally:
        del filters.REGISTRY["first only"], counters.COUNTERS["letters a"]


def test_urd_bundle_and_tables(spark, tmp_path):
    df = spark.createDataFrame([(k, f"word{k} some text number {k} " + "x " * k, "s" if k % 2 else "t") for k in range(12)], "doc_id long, text string, source string")
    out = writers.urd_bundle(df, str(tmp_path / "urd"), 0.5)
    assert out["summary"]["kept_documents"] == 6 and out["summary"]["target_keep_rate_check"]["status"] == "passed" and out["cost"]["input_docs"] == 12
    frontier = spark.read.option("header", True).csv(str(tmp_path / "urd/pareto_frontier"))
    assert frontier.count() == 12 and frontier.where("selected = 'true'").count() == 6
    small = spark.createDataFrame([("a_b", 0.5), (None, 1.0)], "name string, v double")
    assert writers.table_text(small) == "| name | v |\n| --- | --- |\n| a_b | 0.5 |\n|  | 1 |\n"
    assert r"a\_b & 0.5 \\" in writers.table_text(small, "latex")
    with pytest.raises(ValueError):
        writers.table_text(df, most=3)
    assert writers.canonical("a\r\nb\rc") == "a\nb\nc\n" and writers.canonical("") == ""
    df.write.parquet(str(tmp_path / "t"))
    assert readers.lookup(spark, str(tmp_path / "t"), "doc_id", values=[1, 3, 99]).count() == 2
    assert readers.lookup(spark, str(tmp_path / "t"), "doc_id", low=4, high=6).count() == 3


def test_merges_of_many_words(spark):
    """Merges counted in a table are those counted on the driver."""
    from millrace.functions import tokenizers

    df = spark.createDataFrame([(1, "low low low lower lowest newer newest widest é été"), (2, "low newest newest")], "doc_id long, text string")
    assert tokenizers.bpe_merges(df, 12) == tokenizers.bpe_merges(df, 12, at_once=0, every=5)
    merges = tokenizers.bpe_merges(df, 12)
    got = tokenizers.bpe_encode(df, merges).where("doc_id = 2").select(tokenizers.bpe_decode("pieces")).first()[0]
    assert got == "lownewestnewest"
    assert tokenizers.bpe_merges_by_first(df, 1) == [("l", "o")]


@pytest.fixture()
def small_ranges(spark):
    """Files are cut into ranges of some hundred bytes."""
    names = {"spark.sql.files.maxPartitionBytes": "300b", "spark.sql.files.openCostInBytes": "1b", "spark.sql.files.minPartitionNum": "1"}
    was = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in was.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_lines_are_numbered_over_ranges(spark, tmp_path, small_ranges):
    texts = {f"{name}.txt": [f"{name} line {k} " + "x" * (k * 7 % 90) if k % 5 else "" for k in range(n)] for name, n in (("a", 120), ("b", 1), ("c", 62))}
    for name, lines in texts.items():
        (tmp_path / name).write_text("\n".join(lines) + ("\n" if name == "a.txt" else ""))
    rows = readers.numbered_lines(spark, str(tmp_path)).collect()
    assert len({(r["path"], r["block"]) for r in rows}) > 10
    got = {}
    for r in sorted(rows, key=lambda r: (r["path"], r["line"])):
        got.setdefault(r["path"].rpartition("/")[2], []).append((r["line"], r["value"]))
    assert got == {name: list(enumerate(lines)) for name, lines in texts.items() if any(lines)}


def test_articles_go_on_over_ranges(spark, tmp_path, small_ranges):
    lines, want = ["before any article"], []
    for k in range(9):
        body = [f" = = Section {j} = = " if j % 7 == 3 else f"text {k} {j} " + "w" * 40 for j in range(k * 5)]
        lines += [f" = Title {k} = ", *body]
        want.append((k, f"Title {k}", "\n".join(body).strip()))
    (tmp_path / "w.txt").write_text("\n".join(lines) + "\n")
    got = readers.wikitext(spark, str(tmp_path)).orderBy("article").collect()
    assert [(r["article"], r["title"], r["text"]) for r in got] == want


def test_json_shards(spark, tmp_path, small_ranges):
    import gzip

    good = [json.dumps({"id": k, "text": f"text {k}", "source": "s"} if k % 2 else {"text": None if k == 4 else "é" * k}) for k in range(60)]
    (tmp_path / "a.jsonl").write_text("\n".join([*good[:30], "", *good[30:]]))
    with gzip.open(tmp_path / "b.jsonl.gz", "wt") as f:
        f.write(json.dumps({"doc_id": "z", "text": "zipped"}))
    rows = {r["doc_id"]: r for r in readers.json_shards(spark, str(tmp_path), source="own").collect()}
    assert len(rows) == 61 and rows["z"]["text"] == "zipped" and rows["z"]["source"] == "own" and rows["1"]["source"] == "s"
    assert rows["a.jsonl:5"]["text"] == "" and rows["a.jsonl:1"]["line"] == 1 and rows["59"]["line"] == 61 and rows["a.jsonl:60"]["text"] == "é" * 58
    for bad in ("{broken", "[1, 2]", '{"other": 1}'):
        (tmp_path / "c.jsonl").write_text('{"text": "fine"}\n' * 20 + bad)
        with pytest.raises(Exception, match="line 21 of .*c.jsonl"):
            readers.json_shards(spark, str(tmp_path / "c.jsonl")).collect()


def test_two_pass_sampler(spark, tmp_path):
    import hashlib

    from millrace.sources import sampler

    texts = {str(k): " ".join(["w"] * (k % 17)) for k in range(200)}
    df = spark.createDataFrame([(k, t) for k, t in texts.items()], "doc_id string, text string")
    df.repartitionByRange(8, "doc_id").write.parquet(str(tmp_path / "corpus"))
    one = sampler.TwoPassSampler(spark, str(tmp_path / "index"), str(tmp_path / "corpus"))
    sized = {k: len(t.split()) for k, t in texts.items() if t}
    assert one.build() == {"documents": len(sized), "tokens": sum(sized.values()), "reused_index": 0}
    assert one.build()["reused_index"] == 1
    left, want = 60, set()
    for k in sorted(sized, key=lambda k: hashlib.sha256(f"42:{k}".encode()).hexdigest()):
        if sized[k] <= left:
            left -= sized[k]
            want.add(k)
    chosen = one.chosen(60)
    records = one.records(chosen)
    assert {r["doc_id"]: r["text"] for r in records.collect()} == {k: texts[k] for k in want}
    few = one.records(chosen.limit(1))
    read = lambda df: sum("/corpus/" in f for f in df.inputFiles())
    assert read(few) == 1 < read(spark.read.parquet(str(tmp_path / "corpus")))  # only its file is read
    spark.createDataFrame([("new", "document")], "doc_id string, text string").write.mode("append").parquet(str(tmp_path / "corpus"))
    with pytest.raises(ValueError):
        one.build()
    with pytest.raises(ValueError):
        one.chosen(0)


def test_buffered_shuffle(spark):
    from millrace.sources import sampler

    df = spark.range(500).withColumnRenamed("id", "doc_id").repartition(7)
    got = [r["doc_id"] for r in sampler.buffered_shuffle(df, 50, "doc_id").collect()]
    assert sorted(got) == list(range(500)) and got != list(range(500))
    assert max(abs(place - k) for place, k in enumerate(got)) < 50
    assert got == [r["doc_id"] for r in sampler.buffered_shuffle(df.repartition(3), 50, "doc_id").collect()]
    assert [r["doc_id"] for r in sampler.buffered_shuffle(df, 1, "doc_id").collect()] == list(range(500))


def test_batches_are_verified(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(2):
        lines(tmp_path / f"in/{k}.json", [{"doc_id": k * 10 + j, "text": f"t{j}"} for j in range(4)])
        incremental.run(spark, str(tmp_path / "in"), spark.createDataFrame([], "doc_id long, text string").schema, str(tmp_path / "out"), lambda b, _: b.where("doc_id <> 3"), {"v": 1})
    out = str(tmp_path / "out")
    rows = {r["batch"]: (r["rows_in"], r["rows_out"]) for r in incremental.manifest(spark, out).collect()}
    assert rows == {0: (4, 3), 1: (4, 4)} and incremental.verify(spark, out) == []
    spark.createDataFrame([(99, "more")], "doc_id long, text string").write.mode("append").parquet(f"{out}/data/batch=1")
    assert incremental.verify(spark, out) == [1]
