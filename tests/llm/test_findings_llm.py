"""What reviews found of the training-data operators, in small."""

import public_tokenizers
import pyarrow as pa

from riskbook.llm import quality_classifier, simhash, units
from riskbook.llm.units import encoder, spaced_units


def test_the_classifier_drops_encoders_of_earlier_stages(spark):
    """Its tasks run in workers that packing has left its tables in."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.createDataFrame([(k, f"text number {k} of some words") for k in range(40)], "doc_id long, text string").coalesce(1)
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")

    def left(batches):
        for batch in batches:
            some = batch.to_pandas()
            encoder(path, spaced_units).batch(some["t"].tolist())
            yield pa.RecordBatch.from_pydict({"n": [len(units.encoder.__defaults__[-1])]})

    def found(batches):
        for batch in batches:
            for scored in quality_classifier.scorer_of(None)(iter([batch.column(0).to_pandas()])):
                yield pa.RecordBatch.from_pydict({"n": [len(units.encoder.__defaults__[-1])] * (len(scored) > 0)})

    texts = docs.selectExpr("text AS t")
    assert {r["n"] for r in texts.mapInArrow(left, "n long").collect()} == {1}
    assert {r["n"] for r in texts.mapInArrow(found, "n long").collect()} == {0}
    assert quality_classifier.keep_quality(docs, labels).count() <= 40


def test_encoders_have_tables_of_the_size_asked_for():
    path = public_tokenizers.path("byte_bpe_50k.json")
    small, large = encoder(path, spaced_units), encoder(path, spaced_units, 1_000_000)
    assert small is encoder(path, spaced_units) and (small.most, large.most) == (500_000, 1_000_000)
    assert small.ids("Some words, and others.").tolist() == large.ids("Some words, and others.").tolist()


def test_replicas_of_fingerprints_are_not_broadcast(spark, tmp_path):
    """Spark sizes the 61 replicas of each fingerprint as the fingerprints themselves."""
    prints = [0, 1, 3, 7, 1 << 40, 1 << 40 | 6, -1, -2]
    spark.createDataFrame([(x,) for x in prints], "fp long").write.parquet(str(tmp_path / "nodes"))
    pairs = simhash.linked_pairs(spark.read.parquet(str(tmp_path / "nodes")), 2)
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in pairs.collect()} == {(x, y) for x in prints for y in prints if x < y and ((x ^ y) & (1 << 64) - 1).bit_count() <= 2}
