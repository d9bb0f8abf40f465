"""Inputs that both engines make from one SQL text."""

from lexloom.plans.base import Derived


def test_table_names_inside_strings_stay(spark, sf_dir):
    body = "SELECT concat('part', n_nationkey, ' of the nation''s orders {x}') AS text FROM nation WHERE n_nationkey = 3"
    assert [r.text for r in Derived(body).df(spark, sf_dir).collect()] == ["part3 of the nation's orders {x}"]
