"""The row-local steps on a stream of arriving exports."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkmill.plans.jobs import Profiles, categorize_rows, clean_rows, flatten
from talkmill.sources.exports import FILES_PATTERN, split_files


def watch_exports(
    spark: SparkSession,
    folder: str,
    *,
    profiles: Profiles | None = None,
    files_per_batch: int = 1000,
    pattern: str = FILES_PATTERN,
) -> DataFrame:
    """Categorized rows of each JSON export dropped into a folder; needs no state."""
    files = (
        spark.readStream.format("text")
        .option("wholetext", True)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_batch)
        .load(folder)
        .select(F.col("_metadata.file_name").alias("source_file"), "value")
    )
    return categorize_rows(clean_rows(flatten(split_files(files)), profiles))


@dataclass
class Arrivals:
    """Ingest that goes on where the last run ended: each file is read once, and each batch is written once.

    The stream's checkpoint knows the files taken and gives a batch that failed half-way again under the same number; a
    batch is written to a folder of its number, which it replaces. So a batch that runs again changes nothing.
    """

    spark: SparkSession
    folder: str
    output: str
    checkpoint: str
    profiles: Profiles | None = None
    files_per_batch: int = 1000
    pattern: str = FILES_PATTERN
    last: tuple | None = field(default=None, repr=False)

    def _write(self, batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.output}/batch={number}")
        self.last = batch, number

    def run(self) -> None:
        """Take all files that have arrived, in batches, and end."""
        rows = watch_exports(
            self.spark, self.folder, profiles=self.profiles, files_per_batch=self.files_per_batch, pattern=self.pattern
        )
        stream = rows.writeStream.foreachBatch(self._write).option("checkpointLocation", self.checkpoint)
        stream.trigger(availableNow=True).start().awaitTermination()

    def replay(self) -> None:
        """Write the last batch again, as after a failure between its writing and its checkpoint."""
        if self.last:
            self._write(*self.last)

    def rows(self) -> DataFrame:
        """All rows written so far, with the number of their batch."""
        try:
            return self.spark.read.parquet(self.output)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            empty = categorize_rows(clean_rows(flatten(split_files(self.spark.createDataFrame([], "source_file string, value string"))), None))
            return empty.withColumn("batch", F.lit(0))
