import pytest
from pyspark.sql import SparkSession

CUSTOMERS = [
    (11, "Harbour Lights", "desk@harbourlights.test", "north", "2021-03-02"),
    (12, "Kiln & Loom", None, "south", "2021-03-09"),
    (13, "Mossgrove", "orders@mossgrove.test", "south", "2021-04-17"),
    (14, "Tin Whistle", "call us instead", "north", "2021-06-28"),
    (15, "Old Ferry", None, "east", "2021-08-14"),
    (16, "Paper Lantern", "hello@paperlantern.test", "east", "2021-09-30"),
    (17, "Quarry Bank", "stone@quarrybank.test", "north", "2021-11-05"),
    (18, "Saltmarsh", "mail@saltmarsh.test", "west", "2021-12-21"),
]
ORDERS = [
    (501, 11, 18.25, "sent", "2022-01-03"),
    (502, 13, 240.00, "sent", "2022-01-04"),
    (503, 13, 7.60, "open", "2022-01-11"),
    (504, 14, -3.10, "booked wrong", "2022-01-19"),
    (505, 15, 99.95, "sent", "2022-02-02"),
    (506, 16, 61.00, "open", "2022-02-08"),
    (507, 17, 5.05, "sent", "2022-02-23"),
    (508, 18, 312.40, "sent", "2022-03-01"),
    (509, 18, 44.44, "sent", "2022-03-15"),
    (510, 12, 12.12, "open", "2022-03-16"),
]
PRODUCTS = [
    (71, "LMP-9", 31.50, "lamps"),
    (72, "ROP-2", 4.25, "rigging"),
    (73, "ROP-2", 4.25, "rigging"),
    (74, "BEL-1", 88.00, "brass"),
    (75, None, 15.20, "brass"),
]


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tablegauge-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sample(spark):
    """Small shop with one planted defect per table."""
    return {
        "customers": spark.createDataFrame(
            CUSTOMERS, "id INT, name STRING, email STRING, `group` STRING, created_at STRING"
        ),
        "orders": spark.createDataFrame(
            ORDERS, "id INT, customer_id INT, amount DOUBLE, status STRING, order_date STRING"
        ),
        "products": spark.createDataFrame(
            PRODUCTS, "id INT, sku STRING, price DOUBLE, category STRING"
        ),
    }
