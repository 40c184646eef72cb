import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

PRODUCT_DDL = ("id bigint, sku string, mpn string, brand string, name string, description string, category_hint string,"
               " price double, currency string, source_url string, source_document string, free_text string,"
               " specs array<struct<key:string,value:string,locator:string>>")
_FIELDS = ["sku", "mpn", "brand", "name", "description", "category_hint", "price", "currency", "source_url",
           "source_document", "free_text"]


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (SparkSession.builder.master("local[4]").appName("tests")
               .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
               .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g")
               .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    if session.conf.get("spark.checkpoint.dir", None) is None:
        session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    return session


@pytest.fixture(scope="session")
def product():
    """Build one product row; specs is a dict in supplier order."""
    def build(id, specs=None, **fields):
        return {"id": id, **{f: fields.get(f) for f in _FIELDS},
                "specs": [(k, v, None) for k, v in (specs or {}).items()]}
    return build


@pytest.fixture(scope="session")
def product_df(spark):
    def build(rows):
        return spark.createDataFrame(rows, PRODUCT_DDL)
    return build
