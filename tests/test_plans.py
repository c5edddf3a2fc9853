"""What plans must look like at scale."""

import contextlib
import io
import re

import pytest

from postweave.plans import all_queries
from postweave.session import scratch_path
from tests.conftest import SMALL

QUERIES = all_queries()


def plan_of(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize(
    "name", ["normalize_posts", "classify_posts", "classify_labels_only", "tidy_jamo", "truncate_tokens"]
)
def test_row_wise_queries_shuffle_nothing_but_the_small_input(spark, name):
    # The one exchange spreads an input that has fewer splits than cores.
    plan = plan_of(QUERIES[name].run(spark, SMALL))
    exchanges = re.findall(r"\) Exchange\nInput.*\nArguments: (.*)", plan)
    of_texts = [e for e in exchanges if "hashpartitioning(id" in e]
    assert len(of_texts) <= 1 and all("REPARTITION_BY_NUM" in e for e in of_texts)


def test_normalize_has_one_python_step(spark):
    plan = plan_of(QUERIES["normalize_posts"].run(spark, SMALL))
    assert len(re.findall(r"\) ArrowEvalPython", plan)) == 1


@pytest.mark.parametrize("name", ["label_catalogues", "live_keys", "exclude_names", "activity_sessions"])
def test_scans_read_only_what_they_need(spark, name):
    plan = plan_of(QUERIES[name].run(spark, SMALL))
    for schema in re.findall(r"ReadSchema: struct<(.*)>", plan):
        assert "text" not in schema and "props" not in schema


@pytest.mark.parametrize(
    "name", [n for n, q in QUERIES.items() if not n.startswith(("stream_", "trained"))]
)
def test_no_cross_joins(spark, name):
    plan = plan_of(QUERIES[name].run(spark, SMALL))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_scratch_is_refused_where_executors_may_not_see_it():
    class Session:
        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

        class conf:  # noqa: N801
            @staticmethod
            def get(key, default=None):
                return "/local/warehouse" if "warehouse" in key else default

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_path(Session, "x")
    Session.sparkContext.master = "local[4]"
    assert scratch_path(Session, "x").startswith("/local/warehouse/scratch/x-")
