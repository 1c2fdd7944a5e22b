import importlib
import os

import pytest

from catalumen.llm.registry import MODULES
from oracle import compare

FOLDER = "/root/testdata/sf0.001"
NAMES = [(m, q) for m in map(importlib.import_module, MODULES) for q in m.QUERIES]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
@pytest.mark.parametrize(("module", "name"), NAMES, ids=[q for _, q in NAMES])
def test_query(spark, module, name):
    if name in module.SQL:
        compare(spark, FOLDER, module.QUERIES[name], module.SQL[name])
    else:
        assert module.QUERIES[name](spark, FOLDER).count() >= 0
