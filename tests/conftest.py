import pathlib
import sys

import pytest

sys.path[:0] = [str(pathlib.Path(__file__).resolve().parent.parent), str(pathlib.Path(__file__).resolve().parent)]

from small_tables import SF, TABLES  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    from headway.session import local_session

    session = local_session("8", "headway-tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con
