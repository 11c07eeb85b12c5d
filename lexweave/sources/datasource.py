"""The catalogue as a data source: spark.read.format("license_catalog").load(), or with a folder of texts as path."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader

from .catalog import rows


class CatalogReader(DataSourceReader):
    def __init__(self, folder: str | None):
        self.table = rows(folder)  # read on the driver, so executors need no path

    def read(self, partition):
        yield from self.table


class LicenseCatalog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "license_catalog"

    def schema(self) -> str:
        return "ord int, name string, url string, license_id string, text string"

    def reader(self, schema) -> DataSourceReader:
        return CatalogReader(self.options.get("path"))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LicenseCatalog)
