from __future__ import annotations

import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import functions as F  # noqa: E402

from engram.session import local_session  # noqa: E402

AS_OF = dt.datetime(2024, 2, 1)
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", 4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def as_of(spark):
    return F.lit(AS_OF)


MEMORY = {
    "memory_id": 0, "user_id": 1, "memory_type": "semantic", "content": "", "summary": None, "importance_score": 0.5,
    "future_utility_score": 0.5, "identity_impact_score": 0.5, "emotional_salience_score": 0.5, "reinforcement_score": 0.5,
    "temporal_persistence_score": 0.5, "cognitive_state": "active", "memory_strength": 0.5, "decay_rate": 0.05, "entropy_score": 0.0,
    "reinforcement_count": 0, "retrieval_count": 0, "access_count": 0, "revival_count": 0, "created_at": AS_OF, "last_accessed": AS_OF,
}
MEMORY_DDL = ("memory_id long, user_id long, memory_type string, content string, summary string, importance_score double, "
              "future_utility_score double, identity_impact_score double, emotional_salience_score double, reinforcement_score double, "
              "temporal_persistence_score double, cognitive_state string, memory_strength double, decay_rate double, entropy_score double, "
              "reinforcement_count int, retrieval_count int, access_count int, revival_count int, created_at timestamp, last_accessed timestamp")


@pytest.fixture(scope="session")
def memories(spark):
    """Build memory rows from partial dicts; ids count up from one."""
    def build(*rows: dict):
        full = [{**MEMORY, "memory_id": i + 1, **r} for i, r in enumerate(rows)]
        return spark.createDataFrame([tuple(r[k] for k in MEMORY) for r in full], MEMORY_DDL)
    return build


@pytest.fixture(scope="session")
def empty_concepts(spark):
    return spark.createDataFrame([], "concept_id long, user_id long, concept_name string, description string, confidence double, support_count int, "
                                     "supporting_memory_ids array<long>, retired boolean, created_at timestamp, last_reinforced_at timestamp")


@pytest.fixture(scope="session")
def empty_traits(spark):
    return spark.createDataFrame([], "node_id long, user_id long, node_type string, node_value string, confidence double, importance double, "
                                     "evidence_count int, reinforcement_count int, decay_rate double, retired boolean, "
                                     "supporting_memory_ids array<long>, created_at timestamp, last_reinforced_at timestamp")


def days_ago(n: float) -> dt.datetime:
    return AS_OF - dt.timedelta(days=n)
