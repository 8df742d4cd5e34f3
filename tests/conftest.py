from __future__ import annotations

import sys
from pathlib import Path

import pytest
from oracle import SMALL

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    from batchloom.session import local_session, ship

    session = local_session("4", 4, "3g")
    session.sparkContext.setLogLevel("ERROR")
    ship(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for path in Path(SMALL).iterdir():
        con.sql(f"create view {path.stem} as from '{path}'")
    return con
