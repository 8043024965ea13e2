"""A trigram index over the files of a table, for searches that would otherwise read every text.

`build` writes the rows in files of `per_file` rows, and which trigrams of the lower-cased text each file has. A search
looks up the trigrams of its words, reads only files that have all of them, and tests the texts there as a plain search
does, so it finds the same rows. Postings lie in ranges of their trigram; a lookup reads the row groups that can hold one
of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.functions.text import s
from dossier.operators.search import has_all, tokens

#: A search that this many files or more may serve reads the table as it is: leaving some out would not pay.
MANY = 10_000


def grams_of(text: Column) -> Column:
    """The distinct runs of three code points of a text in lower case."""
    low = F.lower(s(text))
    at = F.sequence(F.lit(1), F.char_length(low) - 2)
    return F.when(F.char_length(low) >= 3, F.array_distinct(F.transform(at, lambda k: F.substr(low, k, F.lit(3))))).otherwise(F.array().cast("array<string>"))


class TextIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def build(cls, df: DataFrame, text: Column, path: str, order: str, per_file: int = 20_000) -> TextIndex:
        """Writes df (a column `_said` is added: the text that is searched) in files of rows that are near in `order`."""
        self = cls(df.sparkSession, path)
        rows = df.withColumn("_said", s(text))
        n = max(1, -(-rows.count() // per_file))
        rows.repartitionByRange(n, order).sortWithinPartitions(order).write.mode("overwrite").option("maxRecordsPerFile", per_file).parquet(f"{self.path}/rows")
        held = self.spark.read.parquet(f"{self.path}/rows").select(F.col("_metadata.file_name").alias("file"), F.explode(grams_of(F.col("_said"))).alias("gram")).distinct()
        held.repartitionByRange("gram", "file").sortWithinPartitions("gram", "file").write.mode("overwrite").parquet(f"{self.path}/grams")
        return self

    def files_of(self, words: list[str]) -> list[str] | None:
        """Files that have all trigrams of the words; null if all may or too many do."""
        wanted = sorted({w[k : k + 3] for w in words for k in range(len(w) - 2)})
        if not wanted:
            return None
        held = self.spark.read.parquet(f"{self.path}/grams").where(F.col("gram").isin(wanted))
        found = held.groupBy("file").agg(F.count("*").alias("n")).where(F.col("n") == len(wanted)).select("file").limit(MANY).collect()
        return None if len(found) == MANY else [r.file for r in found]

    def search(self, query: str) -> DataFrame:
        """The rows whose text holds every word of the query."""
        words = tokens(query)
        files = self.files_of(words)
        whole = self.spark.read.parquet(f"{self.path}/rows")
        if files is not None:
            whole = self.spark.read.schema(whole.schema).parquet(*[f"{self.path}/rows/{f}" for f in files]) if files else whole.where(F.lit(False))
        return whole.where(has_all(F.col("_said"), words)).drop("_said")
