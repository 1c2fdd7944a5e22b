import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from catalumen.runtime import build_session

    conf = {"spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")), "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.sql.codegen.wholeStage": "false"}
    session = build_session("tests", 4, **conf)
    yield session
    session.stop()


@pytest.fixture(autouse=True)
def no_nested_loops(monkeypatch):
    """No plan that is checkpointed or collected in any test joins by a nested loop or a product."""
    from pyspark.sql.classic.dataframe import DataFrame

    found = []

    def watch(name):
        plain = getattr(DataFrame, name)

        def run(self, *args, **named):
            plan = self._jdf.queryExecution().executedPlan().toString()
            if "NestedLoop" in plan or "CartesianProduct" in plan:
                found.append(plan)
            return plain(self, *args, **named)

        monkeypatch.setattr(DataFrame, name, run)

    watch("checkpoint"), watch("collect")
    yield
    assert not found, found[0]
