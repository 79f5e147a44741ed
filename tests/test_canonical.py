"""Every registered batch query gives the same rows on the canonical
(materialised, date-clustered) layout as on the on-the-fly views."""

import pytest

import storepulse.plans.catalog as catalog
from __spark_entry__ import queries
from oracles.compare import canonical
from storepulse.session import shared_dir
from storepulse.sources.retail import materialize_retail
from tests.conftest import SF_SMALL

KEYS = sorted(k for k in catalog.QUERIES if not k.startswith(("stream_", "schema_profile")) and not k.endswith("_report")
              and k != "load_tables")


@pytest.fixture(scope="module")
def canon(spark, retail):
    return materialize_retail(retail, shared_dir(spark, "canonical-all"))


@pytest.mark.parametrize("key", KEYS)
def test_same_result_on_canonical_layout(spark, canon, key, monkeypatch):
    base = queries()[key](spark, SF_SMALL)
    expected = canonical([tuple(r) for r in base.collect()], base.columns)
    monkeypatch.setattr(catalog, "_r", lambda s, d: canon)
    got = queries()[key](spark, SF_SMALL)
    assert canonical([tuple(r) for r in got.collect()], got.columns) == expected
