"""The stateless operators are plain expressions: they run on a stream as they are."""

from pyspark.sql import functions as F

from foldguard.functions.composition import Site, add_shares
from foldguard.operators.cleaning import CleaningRules, tag_rejects
from foldguard.operators.splits import hash_fold, hash_holdout


def test_clean_and_split_a_stream(spark, tmp_path):
    site = Site("A", "a", "wa", ("FA", "MA"))
    rows = [(str(i), "FA; MA" if i % 2 else "FA", "1; 1", f"g{i % 4}") for i in range(40)]
    batch = spark.createDataFrame(rows, "y string, a string, wa string, g string")
    batch.write.parquet(str(tmp_path / "in"))

    def work(df):
        tagged = tag_rejects(df, CleaningRules("y", 0, 35, None, [site]))
        return add_shares(tagged, [site]).withColumns(
            {"split": hash_holdout(F.col("g"), "0.3"), "fold": hash_fold(F.col("g"), 3)}
        )

    stream = work(spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("cleaned").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got, want = spark.table("cleaned"), work(batch)
    assert got.count() == 40
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
