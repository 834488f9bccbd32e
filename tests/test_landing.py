"""Landed archives: lines move packed, and an archive has full members."""

import zipfile

import pytest
from pyspark.sql import functions as F
from rows import values
from test_raw_moves import batch

from quoteflow import fixtures
from quoteflow.sources import quotefiles


@pytest.mark.parametrize("packed", [200_000, 7])
def test_landed_archives(spark, tmp_path, monkeypatch, packed):
    """An archive a date, of members that are full but for the last; every line reads back."""
    monkeypatch.setattr(fixtures, "PACKED_LINES", packed)
    df = batch(spark).withColumn("FinInstrmNm", F.translate("FinInstrmNm", '"', "'")).repartition(4)
    fixtures.land_dated(df, f"file:{tmp_path}/landing", 6)
    files = sorted((tmp_path / "landing").iterdir())
    assert [f.name for f in files] == [f"quotes_2026090{n}.zip" for n in (1, 2, 3)]
    for file in files:
        with zipfile.ZipFile(file) as archive:
            sizes = [archive.read(m).decode().count("\n") - 1 for m in archive.namelist()]
        assert sizes == [6, 6, 6, 2]
    back = quotefiles.read_zips(spark, [str(f) for f in files])
    empty = [F.nullif(F.col(c), F.lit("")).alias(c) for c in df.columns]
    assert values(back, *df.columns) == values(df.select(*empty), *df.columns)


def test_lines_move_packed(spark, tmp_path, monkeypatch):
    plans = []
    monkeypatch.setattr(type(batch(spark)), "collect", lambda self: plans.append(self._jdf.queryExecution().executedPlan().toString()))
    fixtures.land_dated(batch(spark), f"file:{tmp_path}/landing")
    move = next(line for line in plans[0].splitlines() if "Exchange hashpartitioning" in line)
    sort = next(line for line in plans[0].splitlines() if "Sort [" in line)
    assert "BizDt" in move and "BizDt" in sort and "packed" in plans[0] and "MapInPandas pack" in plans[0][plans[0].index(move):]
