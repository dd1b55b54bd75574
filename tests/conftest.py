import os
import sys
from decimal import Decimal

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from scoreloom.schemas import STAGING, STAGING_FIELDS  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("scoreloom-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def staging_of(spark):
    """Build a staging frame from partial records; fields left out hold the missing-value text."""

    def build(*records):
        rows = [tuple(record.get(field, "null") for field in STAGING_FIELDS) for record in records]
        return spark.createDataFrame(rows, STAGING)

    return build


@pytest.fixture(scope="session")
def profiles_of(spark):
    """Build a profile frame from partial records; fields left out are NULL."""
    schema = """out_id string, macro_location string, gender string, institution_id long, institution_name string,
        institution_type string, reg_name string, score_ukr decimal(5,2), score_math decimal(5,2), score_hist decimal(5,2),
        mandatory_avg_score decimal(5,2), elective_subject string, elective_score decimal(5,2),
        overall_mean decimal(18,12), is_regional_center boolean, failed boolean, failed_mandatory boolean"""
    fields = [part.split()[0] for part in schema.replace("\n", " ").split(", ")]

    def build(*records):
        def value(v):
            return Decimal(str(v)) if isinstance(v, (float, str)) and str(v).replace(".", "", 1).isdigit() else v

        return spark.createDataFrame([tuple(value(r.get(f)) for f in fields) for r in records], schema)

    return build
