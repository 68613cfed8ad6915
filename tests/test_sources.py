"""Files in and out, catalogue, streams, shared folder."""

import hashlib
import json

from pyspark.sql import functions as F

from garimpo.operators.index import postings
from garimpo.sources import catalogue, files
from garimpo.streaming import incremental
from garimpo.workdir import materialize


def test_json_envelope_and_bare(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"chunks": [{"id": "x", "n": 1}, {"id": "y", "n": None}]}, indent=2))
    (tmp_path / "b.json").write_text(json.dumps([{"id": "z", "n": 3}]))
    got = files.read_json(spark, str(tmp_path), "id string, n int", "chunks")
    assert sorted(map(tuple, got.collect()), key=str) == [("x", 1), ("y", None), ("z", 3)]


def test_csv_decimal_comma(spark, tmp_path):
    df = spark.createDataFrame([("a;b", 1.5), ("ç", None)], "t string, x double")
    files.write_csv(df, str(tmp_path / "c"), True)
    assert sorted(map(tuple, files.read_csv(spark, str(tmp_path / "c"), "t string, x double", True).collect())) == [("a;b", 1.5), ("ç", None)]
    files.write_csv(df, str(tmp_path / "p"))
    assert files.read_csv(spark, str(tmp_path / "p"), "t string, x double").count() == 2


def test_digests(spark, tmp_path):
    (tmp_path / "f.bin").write_bytes(b"abc" * 1000)
    row = catalogue.content_digests(spark, str(tmp_path)).first()
    assert (row["tamanho_bytes"], row["hash_sha256"]) == (3000, hashlib.sha256(b"abc" * 1000).hexdigest())


def test_synthetic(spark):
    assert files.synthetic_candidates(spark, 12000).where("i = 12000").first()["id_chunk"] == "chunk_12000"


def test_materialize_keeps_schema(spark):
    df = spark.createDataFrame([(1, [1, 2], {"a": 1})], "i int, a array<int>, m map<string,bigint>")
    again = materialize(df)
    assert again.schema == df.schema and again.collect() == df.collect()
    assert materialize(df.limit(0)).count() == 0


def test_stream_index(spark, tmp_path):
    rows = [(f"c{i}", f"a b{i % 3} a", f"l{i % 2}", 10) for i in range(20)]
    schema = "id_chunk string, texto string, id_carga string, quantidade_palavras int"
    df = spark.createDataFrame(rows, schema).withColumn("carregado_em", F.timestamp_seconds(F.lit(1_700_000_000) + F.substring("id_chunk", 2, 9).cast("int")))
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    df.where("id_chunk = 'c3'").write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = incremental.grow_index(incremental.first_arrivals(stream), str(tmp_path / "ix"), str(tmp_path / "cp"))
    query.awaitTermination(120)
    got = incremental.grown_postings(spark, str(tmp_path / "ix"))
    assert sorted(got.collect()) == sorted(postings(df).select("term", "id_chunk", "tf").collect())


def test_stream_counts(spark, tmp_path):
    df = spark.createDataFrame([("l", 5), ("l", 7)], "id_carga string, quantidade_palavras int").withColumn("carregado_em", F.timestamp_seconds(F.lit(1_700_000_000)))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = incremental.arrivals(stream).writeStream.outputMode("complete").format("memory").queryName("chegadas").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert [(r["chunks"], r["palavras"]) for r in spark.table("chegadas").collect()] == [(2, 12)]
