import pytest

from qaspark.operators import evaluate as E

PREDS = [(1, "q1", "a", 0.1), (2, "q1", "b", 0.2), (3, "q1", "c", 0.3),
         (4, "q2", "a", 0.1), (5, "q2", "b", 0.2), (6, "q3", "a", 0.1),
         (7, "q5", "x", 0.1), (8, "q5", "a", 0.2)]
LABELS = [("q1", "a", 1), ("q1", "b", 0), ("q1", "c", 1), ("q2", "a", 0), ("q2", "b", 1),
          ("q3", "a", 0), ("q4", "a", 1), ("q5", "a", 1)]
QUESTIONS = [(i + 1, q) for i, q in enumerate(["q1", "q2", "q3", "q4", "q5"])]


@pytest.fixture(scope="module")
def frames(spark):
    return (spark.createDataFrame(PREDS, "line_no long, q string, answer string, dist double"),
            spark.createDataFrame(LABELS, "q string, answer string, label int"),
            spark.createDataFrame(QUESTIONS, "pos long, q string"))


def test_at1(frames):
    r = E.at1_stats(*frames).first()
    assert (r["correct"], r["predictions"], r["total"]) == (1, 4, 5)
    assert r["precision_at1"] == pytest.approx(0.25)
    assert r["recall_at1"] == pytest.approx(0.2)
    assert r["f1"] == pytest.approx(2 / 9)
    assert r["ranking_error_rate"] == pytest.approx(1 / 5)
    assert r["lexicon_error_rate"] == pytest.approx(2 / 5)


def test_map_both_orders(frames):
    assert E.mean_average_precision(*frames, direction="asc").first()["map"] == pytest.approx(11 / 30)
    assert E.mean_average_precision(*frames, direction="desc").first()["map"] == pytest.approx(17 / 30)


def test_last_wins_and_report(spark, frames):
    p, l, q = frames
    extra = spark.createDataFrame([(100, "q3", "a", 0.9)], p.schema)
    sc = E.scored(p.unionByName(extra), l).filter("q = 'q3'").first()
    assert sc["dist"] == 0.9 and sc["first_line"] == 6
    top = {r["q"]: r["answer"] for r in E.report_top(*frames).collect()}
    assert top == {"q1": "c", "q2": "b", "q3": "a", "q4": None, "q5": "a"}
    rep = E.report(*frames).filter("q = 'q4'").collect()
    assert [(r["section"], r["answer"], r["mark"]) for r in rep] == [("question", "0", ""), ("missed", "a", "?")]
    assert E.report(*frames).filter("section = 'question'").count() == 5


def test_text_forms(spark, frames):
    lines = spark.createDataFrame([(1, "1\tq1\ta"), (2, "u\tq1\tb"), (3, "0\tq1\ta"), (4, "bad"), (5, " 1\tq2\tc ")],
                                  "line_no long, value string")
    lab = {(r.q, r.answer): r.label for r in E.clean_labels(E.read_labels(lines)).collect()}
    assert lab == {("q1", "a"): 0, ("q2", "c"): 1}  # u is dropped, the last line wins
    out = E.prediction_lines(frames[0]).collect()
    back = E.read_predictions(spark.createDataFrame([(r.line_no, r.value) for r in out], "line_no long, value string"))
    assert sorted(map(tuple, back.collect())) == sorted(PREDS)
    shuffled = frames[0].selectExpr("10 - line_no AS line_no", "q", "answer", "dist")
    order = [(r.first_line, r.line_no) for r in E.prediction_lines(shuffled).collect()]
    assert order == sorted(order)
