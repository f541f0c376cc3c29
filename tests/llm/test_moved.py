"""Texts and sets that are moved between tasks: those that a step needs, however many ids there are."""

import re

import pytest

import cases
import corpus_pipeline
from test_near_dedup import expected, found, near_copies
from tallyframe.llm import filters, near_dedup


@pytest.fixture
def no_broadcasts(spark):
    """As with tables that are too large for Spark to send round by itself."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield
    spark.conf.set(name, before)


def planned(table):
    return table._jdf.queryExecution().executedPlan().toString()


def test_asked_values(spark):
    asked = filters.asking(spark.createDataFrame([(i, "x") for i in range(50)] + [(None, "y")], "a long, b string"), "a", "b")
    rows = spark.range(5000).selectExpr("id AS a", "'x' AS b").withColumn("held", asked("a", "b")).collect()
    assert all(r.held for r in rows if r.a < 50)
    assert sum(r.held for r in rows) < 500
    assert not any(r.held for r in spark.range(0).withColumn("held", asked("id", "id")).collect())
    none = filters.asking(spark.range(0), "id")
    assert not any(r.held for r in spark.range(9).withColumn("held", none("id")).collect())


@pytest.mark.parametrize("most", [0, 1 << 20])
def test_few_ids_are_sent_to_the_sets(spark, monkeypatch, no_broadcasts, most):
    plans, stored = {}, near_dedup.stored

    def kept(table, purpose, **more):
        plans[purpose] = planned(table)
        return stored(table, purpose, **more)

    monkeypatch.setattr(filters, "SENT_ROWS", most)
    monkeypatch.setattr(near_dedup, "stored", kept)
    rows = near_copies()
    rows += [(len(rows) + i, text, lang) for i, (_, text, lang) in enumerate(rows[:20], 1)]
    assert found(near_dedup.near_duplicates(cases.documents(spark, rows), 2)) == expected(rows, 2, 80)
    assert ("BroadcastHashJoin" in plans["checked"]) == (most > 0)
    assert "ArrowEvalPython" in plans["checked"] and "ArrowEvalPython" in plans["buckets"]  # few others are let through


@pytest.mark.parametrize("most", [0, 1 << 20])
def test_texts_of_ids_that_stay_are_not_moved(spark, monkeypatch, no_broadcasts, most):
    monkeypatch.setattr(filters, "SENT_ROWS", most)
    plain = [(i, f"{i} " * 9 + f"a text of its own {i * i}", "en") for i in range(100, 160)]
    copies = [(i + 100, text, lang) for i, text, lang in plain[:10]]
    repeated = [plain[20], plain[20], (plain[21][0], "another text under one id and no other", "en")]
    blank = [(copies[0][0], " ", "en")]  # it stays itself, and so does its id
    without_id = [(None, plain[0][1], "en"), (None, plain[0][1], "en")]
    rows = plain + copies + repeated + blank + without_id
    out = corpus_pipeline.near_dedup_stage(spark, cases.documents(spark, rows), "")
    wanted = plain + repeated[2:] + blank + copies[:1] + without_id
    assert sorted((str(r.doc_id), r.text) for r in out.collect()) == sorted((str(i), text) for i, text, _ in wanted)
    branches = re.split(r"\n {3}[:+]- ", planned(out.select("text")).split("Union", 1)[1])
    assert len(branches) == 4 and "Exchange" not in branches[1]
