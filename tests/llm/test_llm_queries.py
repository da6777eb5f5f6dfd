"""The registered queries on the smallest tables: against their SQL where there is one, by their rows where there isn't."""

import os

import pytest

from provspark.llm import queries
from tests.compare import differences, views

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert differences(queries.queries()[name](spark, SF), views(SF), queries.oracle_sql()[name]) == []


@pytest.mark.parametrize("name", ["op1_webp_media", "op4_pii_anchors", "op5_token_counts", "op7_mix_weights", "op9_brown_lm", "op10_simhash"])
def test_a_row_for_each_document(spark, name):
    ids = views(SF).sql("SELECT doc_id FROM documents ORDER BY 1").fetchall()
    assert sorted(tuple(r) for r in queries.queries()[name](spark, SF).select("doc_id").collect()) == ids
