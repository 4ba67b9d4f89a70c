"""Small files next to a stream's tables, on whatever store Spark itself writes to."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def delete(spark: SparkSession, path: str) -> None:
    store, place = _at(spark, path)
    store.delete(place, True)


class Manifests:
    """One small record per micro-batch. A batch that is run again replaces its own and starts from the one before it; a
    record that was not written to its end does not count."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def numbers(self) -> list[int]:
        store, place = _at(self.spark, self.path)
        if not store.exists(place):
            return []
        names = [s.getPath().getName() for s in store.listStatus(place)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _read(self, number: int) -> dict | None:
        store, place = _at(self.spark, f"{self.path}/{number:012d}.json")
        source = store.open(place)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8"))
        except ValueError:
            return None
        finally:
            source.close()

    def before(self, number: int | None = None) -> dict | None:
        """The last record, of the batches before `number` if one is given."""
        for own in reversed(self.numbers()):
            if (number is None or own < number) and (found := self._read(own)) is not None:
                return found
        return None

    def put(self, number: int, record: dict) -> None:
        store, place = _at(self.spark, f"{self.path}/{number:012d}.json")
        out = store.create(place, True)
        out.write(bytearray(json.dumps(record).encode()))
        out.close()
        every = self.numbers()
        # the one before stays for a retry; later ones are of batches that this one undoes
        for own in [n for n in every if n < number][:-1] + [n for n in every if n > number]:
            delete(self.spark, f"{self.path}/{own:012d}.json")
