"""Plans stay small: what a step hands on is stored, not planned again in each later step, which fills the driver's heap."""

from fleetlake.llm import mixing
from fleetlake.llm.common import table


def nodes(df, kind):
    return df._jdf.queryExecution().optimizedPlan().toString().count(kind)


def test_mixing_plans_its_steps_once(spark, sf_dir):
    plan = mixing.copies(mixing.sized(table(spark, sf_dir, "documents")))
    assert nodes(plan, "Window [") <= 1  # 65 when targets, calibration and bins were planned again by each reader
    assert nodes(plan, "Join ") <= 4
