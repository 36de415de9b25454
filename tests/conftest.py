from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tools"))

DATA = os.environ.get("FACTLOOM_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from factloom.session import local_session

    folder = str(tmp_path_factory.mktemp("checkpoints"))
    session = local_session(8, "factloom-tests", **{"spark.checkpoint.dir": folder})
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables(spark):
    from factloom.sources.tables import Tables

    return Tables(spark, DATA)


FACT_DEFAULTS = {
    "to_id": None,
    "to_day": None,
    "edge_label": "AFFILIATED",
    "fact_type": "employee",
    "fact": "f",
    "confidence": "stated",
    "source_record": "r",
    "source_type": "email",
    "source_at": None,
    "recorded_at": None,
    "stale": False,
    "replaced_by": None,
    "valid_until": None,
    "op_area": "reality",
}


@pytest.fixture()
def make_facts(spark):
    from datetime import date, datetime

    from factloom.schema import FACTS

    def at(value):
        return datetime.fromisoformat(value) if isinstance(value, str) else value

    def day(value):
        return date.fromisoformat(value) if isinstance(value, str) else value

    def make(*rows: dict):
        full = []
        for row in rows:
            r = {**FACT_DEFAULTS, **row}
            r["source_at"], r["recorded_at"] = at(r["source_at"]), at(r["recorded_at"])
            r["to_day"], r["valid_until"] = day(r["to_day"]), day(r["valid_until"])
            full.append(tuple(r[name] for name in FACTS.fieldNames()))
        return spark.createDataFrame(full, FACTS)

    return make


@pytest.fixture()
def make_entities(spark):
    from factloom.schema import ENTITIES

    def make(*rows: tuple):
        full = [
            (i, kind, name, email, domain, {}, None)
            for i, kind, name, email, domain in (r + (None,) * (5 - len(r)) for r in rows)
        ]
        return spark.createDataFrame(full, ENTITIES)

    return make


@pytest.fixture()
def make_records(spark):
    from datetime import datetime

    from factloom.schema import RECORDS

    base = {
        "type": "email",
        "source": "s",
        "created_at": None,
        "content": "",
        "metadata": {},
        "dedup_key": None,
        "expert_name": "x",
        "expert_version": "1",
        "indexed": False,
        "classification": None,
        "raw": None,
        "human_context": None,
    }

    def make(*rows: dict):
        full = []
        for row in rows:
            r = {**base, **row}
            if isinstance(r["created_at"], str):
                r["created_at"] = datetime.fromisoformat(r["created_at"])
            full.append(tuple(r[name] for name in RECORDS.fieldNames()))
        return spark.createDataFrame(full, RECORDS)

    return make
