import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from nestegg.session import get_spark
    s = get_spark("nestegg-tests", cpus="*", shuffle_partitions=8, driver_memory="8g")
    yield s
    s.stop()


SURVEY_DDL = ("user_id long, name string, age int, period int, experience int, psychology int, loss_level int, "
              "finance_knowledge int, investment_goal int, pension_ratio int, expected_income int, "
              "investment_amount long, pension_operator array<string>, direct_manage boolean")


def survey_row(user_id, **kw):
    base = dict(user_id=user_id, name=f"u{user_id}", age=40, period=10, experience=3, psychology=2, loss_level=3,
                finance_knowledge=2, investment_goal=2, pension_ratio=2, expected_income=2,
                investment_amount=1000000, pension_operator=["OP1"], direct_manage=True)
    base.update(kw)
    return base
