"""A store of vectors by content hash, in which each hash of a model is held once.

Vectors lie in folders that never change. A version is a small file that names the folders valid together; a new one is
published under the next number, which only one of several runs can do. A run that comes second looks at what the
others have added meanwhile, leaves out of its own folder what they hold already, and publishes after them.

Each folder has a bitmap of its hashes' first bits beside the vectors. All bitmaps together have a fixed size, whatever the
store holds; a hash whose bit is not set is new, and no key has to be read to know it.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "text_sha string, embedding array<float>, model string"
#: Bits of a hash that the bitmaps tell apart; they take 2 ** BITS / 8 bytes in all.
BITS = 26
_SEGMENT = 15
_FILTER = "model string, segment int, bits binary"


def _slot(sha: Column | str) -> Column:
    return F.shiftright(F.conv(F.substring(sha, 1, 8), 16, 10).cast("bigint"), 32 - BITS).cast("int")


@dataclass
class VectorStore:
    """The store as one run sees it: the folders of the version it has read."""

    spark: SparkSession
    path: str
    version: int = 0
    folders: list[str] = field(default_factory=list)

    def __post_init__(self):
        self.refresh()

    # files

    def _file(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def refresh(self) -> VectorStore:
        """Look for the last version published."""
        place, fs = self._file("versions")
        names = [s.getPath().getName() for s in fs.listStatus(place)] if fs.exists(place) else []
        numbers = [int(n) for n in names if n.isdigit()]
        if numbers:
            self.version = max(numbers)
            path, fs = self._file(f"versions/{self.version:08d}")
            stream = fs.open(path)
            self.folders = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            stream.close()
        return self

    def _publish(self, version: int, folders: list[str]) -> bool:
        """The next version, whole or not at all; false if another run has taken the number."""
        draft, fs = self._file(f"versions/draft-{uuid.uuid4().hex}")
        out = fs.create(draft)
        out.write(bytearray(json.dumps(folders).encode()))
        out.close()
        final, _ = self._file(f"versions/{version:08d}")
        if fs.getScheme() != "file":
            # A rename never replaces a file there.
            return fs.rename(draft, final)
        source, target = draft.toUri().getPath(), final.toUri().getPath()
        try:
            os.link(source, target)
        except FileExistsError:
            return False
        finally:
            os.unlink(source)
        return True

    # rows

    def vectors(self, folders: list[str] | None = None) -> DataFrame:
        """``text_sha, embedding, model`` of the version, or of some of its folders."""
        paths = [f"{self.path}/{f}/vectors" for f in (self.folders if folders is None else folders)]
        if not paths:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).option("basePath", self.path).parquet(*paths)

    def perhaps_known(self, hashes: DataFrame, model: str) -> DataFrame:
        """``hashes`` with ``perhaps``: false where no vector of the model can be held."""
        paths = [f"{self.path}/{f}/filter" for f in self.folders]
        if not paths:
            return hashes.withColumn("perhaps", F.lit(False))
        read = self.spark.read.schema(_FILTER).parquet(*paths).filter(F.col("model") == model)
        # At most 2 ** (BITS - 15) segments of 4 kB each.
        bits = F.broadcast(read.groupBy("segment").agg(F.bitmap_or_agg("bits").alias("bits")))
        marked = hashes.withColumn("slot", _slot("text_sha")).withColumn("segment", F.shiftright("slot", _SEGMENT))
        at = F.col("slot").bitwiseAND((1 << _SEGMENT) - 1)
        byte = F.conv(F.hex(F.substring("bits", F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
        is_set = F.expr("shiftright(byte, slot & 7) & 1") == 1
        known = marked.join(bits, "segment", "left").withColumn("byte", byte)
        return known.withColumn("perhaps", F.coalesce(is_set, F.lit(False))).select(*hashes.columns, "perhaps")

    def _written(self, vectors: DataFrame) -> str:
        folder = f"add-{uuid.uuid4().hex}"
        vectors.select("text_sha", "embedding", "model").write.parquet(f"{self.path}/{folder}/vectors")
        own = self.vectors([folder])
        slots = own.select("model", _slot("text_sha").alias("slot"))
        bits = F.bitmap_construct_agg(F.col("slot").bitwiseAND((1 << _SEGMENT) - 1).cast("bigint"))
        segments = slots.groupBy("model", F.shiftright("slot", _SEGMENT).alias("segment")).agg(bits.alias("bits"))
        segments.write.parquet(f"{self.path}/{folder}/filter")
        return folder

    def add(self, vectors: DataFrame) -> str:
        """Keep vectors that the version read does not hold, each hash once; the name of their folder.

        Without any, nothing is published. What other runs have published since is left out; afterwards this object sees their folders too.
        """
        folder = self._written(vectors)
        if self.vectors([folder]).isEmpty():
            return folder
        while not self._publish(self.version + 1, [*self.folders, folder]):
            seen = set(self.folders)
            self.refresh()
            others = self.vectors([f for f in self.folders if f not in seen]).select("model", "text_sha")
            own = self.vectors([folder])
            if not own.join(others, ["model", "text_sha"], "left_semi").isEmpty():
                folder = self._written(own.join(others, ["model", "text_sha"], "left_anti"))
                if self.vectors([folder]).isEmpty():
                    return folder
        self.version, self.folders = self.version + 1, [*self.folders, folder]
        return folder
