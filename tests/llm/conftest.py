"""Fixtures of the llm tests; scratch tables go to the temporary folder, as the session names no shared one."""

from __future__ import annotations

import pytest


@pytest.fixture()
def docs_of(spark):
    def make(rows, schema="doc_id bigint, text string, lang string, source string, n_chars bigint"):
        wide = [tuple(r) + (None,) * (len(schema.split(",")) - len(r)) for r in rows]
        return spark.createDataFrame(wide, schema).repartition(3)

    return make
