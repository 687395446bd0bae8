"""The selection's plan: what keeps it fast on large tables."""

import contextlib
import io
import re

from lattiq.operators import selecting
from lattiq.plans import event_queries
from tests.conftest import DATA

#: Bytes of a method beyond which the JVM doesn't compile it.
HUGE = 8000


def test_code_of_the_selection_is_compiled(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        told = io.StringIO()
        with contextlib.redirect_stdout(told):
            event_queries.cmp_select(spark, DATA).explain("codegen")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", told.getvalue())]
    assert len(sizes) > 5 and max(sizes) < HUGE


def test_wishes_of_legs_or_of_outcomes(spark):
    """The same rows, whether the wishes were worked out for the legs or for each outcome."""
    rows = event_queries.funnel_rows(spark, DATA).where("event_id < 300")
    found = [selecting.select_outcomes(x, ["leg", "event_id"], ["outcome_id"]) for x in (rows, rows.drop(*selecting._WISHES))]
    assert found[0].columns == found[1].columns and not set(selecting._WISHES) & set(found[0].columns)
    assert sorted(map(str, found[0].collect())) == sorted(map(str, found[1].collect()))
