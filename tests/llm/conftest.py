import pytest


@pytest.fixture
def folder(tmp_path, spark):
    """Writes rows as `documents` and other tables; gives the folder."""

    def write(**tables):
        for name, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write
