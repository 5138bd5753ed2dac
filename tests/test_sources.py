import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import days
from varloom.operators import realized as rz
from varloom.sources import boards as bd, library as lb
from varloom.streaming.daily_variance import binned_prices


@pytest.fixture()
def library(spark, tmp_path):
    path = str(tmp_path / "lib")
    rows = [("2019-07-01 00:00:00+01:00", ".SPX", 1.0), ("2019-07-01 00:00:00+01:30", ".SPX", 9.0), ("2019-07-02 00:00:00+01:00", ".spx", 2.0), ("bad", ".SPX", 3.0), ("2019-07-01 00:00:00+00:00", ".FTSE", 4.0)]
    lb.write_table(spark.createDataFrame(rows, "`Unnamed: 0` string, Symbol string, rv5 double"), path)
    return path


def test_library_keeps_local_dates_and_first_rows(spark, library):
    got = lb.load_library(spark, library, [".SPX"]).orderBy("date").toPandas()
    assert [str(d) for d in got.date] == ["2019-07-01", "2019-07-02"] and list(got.rv5) == [1.0, 2.0]


def test_date_column_is_found_by_probing(spark, tmp_path):
    path = str(tmp_path / "odd")
    lb.write_table(spark.createDataFrame([("2020-01-02x", "A", 1.0), ("2020-01-03x", "A", 2.0)], "seen string, ticker string, rv5 double"), path)
    assert lb.load_library(spark, path).count() == 2


def test_unknown_symbol_lists_known_ones(spark, library):
    with pytest.raises(ValueError, match="FTSE"):
        lb.require_symbol(lb.load_library(spark, library), ".XXX")


def test_existing_panel_is_kept_unless_forced(spark, tmp_path):
    df = spark.createDataFrame([("X", days(1)[0], 1.0)], "asset string, date date, rv double")
    path = str(tmp_path / "panel")
    lb.write_panel(df, path)
    with pytest.raises(Exception):
        lb.write_panel(df, path)
    lb.write_panel(df.withColumn("rv", F.lit(2.0)), path, force=True)
    assert spark.read.parquet(path).first()["rv"] == 2.0


def test_interval_discovery_needs_both_sides(spark):
    wide = spark.createDataFrame([("X", days(1)[0], 1.0, 0.5, 2.0, 0.1)], "asset string, date date, y_true double, `m-a_lo90` double, `m-a_hi90` double, `m-a_lo50` double")
    got = bd.discover_intervals(wide).collect()
    assert len(got) == 1 and got[0]["method"] == "m-a" and got[0]["level_pct"] == 90


def test_incomplete_join_fails(spark):
    a = spark.createDataFrame([("X", d) for d in days(2)], "asset string, date date")
    s = a.limit(1).withColumn("state", F.lit(1))
    with pytest.raises(Exception, match="no state"):
        bd.attach_complete(a, s).collect()


def test_streamed_bins_give_the_batch_variance(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = []
    for d in days(3):
        t = pd.date_range(pd.Timestamp(d) + pd.Timedelta(hours=9), periods=400, freq="1min")
        rows.append(pd.DataFrame({"asset": "X", "ts": t, "price": 100 * np.exp(np.cumsum(rng.normal(0, 1e-3, 400))), "seq": np.arange(400)}))
    bars = spark.createDataFrame(pd.concat(rows))
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    bars.write.parquet(source)
    q = binned_prices(spark.readStream.schema(bars.schema).parquet(source)).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    streamed = rz.realized_variance(spark.read.parquet(out)).orderBy("date").toPandas()
    batch = rz.realized_variance(bars).orderBy("date").toPandas()
    assert len(streamed) >= 2
    assert np.allclose(streamed.rv[:2], batch.rv[:2])
