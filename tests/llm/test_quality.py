import zlib

from helpers import documents, empty, odd_rows, plain, table, with_clashing
from pyspark.sql import functions as F

from retailcast.llm import quality as q


def test_held_out_accuracy(spark):
    docs, labels = table(spark), table(spark, "labels")
    scored = {r.doc_id: r for r in q.quality_scores(docs, labels).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in scored.items())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in scored.values())
    marks = [(scored[r.doc_id], r.quality) for r in labels.collect() if scored[r.doc_id].held_out]
    assert sum(s.predicted == y for s, y in marks) >= 0.9 * len(marks)


def test_held_out_labels_change_nothing(spark):
    docs, labels = table(spark), table(spark, "labels")
    turned = labels.withColumn("quality", F.when(q.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    columns = ["doc_id", "score"]
    assert plain(q.quality_scores(docs, labels).select(*columns)) == plain(q.quality_scores(docs, turned).select(*columns))


def test_compiled_rules_equal_plain_python(spark):
    docs, labels = table(spark), table(spark, "labels")
    stats = q._statistics_table(docs, "doc_id", "text")
    model = q._fit_on(stats, labels, q.Fit())
    assert model.rules and any(len(rule) > 1 for rule, _ in model.rules)
    for r in stats.withColumn("score", q.score(model)).collect():
        total = model.intercept
        for rule, weight in model.rules:
            total += weight * all(r[a] <= t if s == "<=" else r[a] > t for a, s, t in rule)
        assert abs(r.score - 1 / (1 + 2.718281828459045**-total)) < 1e-9


def test_statistics():
    s = dict(zip(q.STATISTICS, q.statistics_of("ab ab AB 12 *|\nx\nx")))
    assert (s["words"], s["repeats_last_word"], s["top_word"], s["repeated_lines"]) == (7, 2 / 7, 2 / 7, 1 - 2 / 3)
    assert s["digits"] == s["upper"] == 2 / 18 and q.statistics_of(" \n") == (0.0,) * len(q.STATISTICS)


def test_odd_rows(spark):
    docs, labels = with_clashing(odd_rows(spark)), table(spark, "labels")
    got = q.quality_scores(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert q.good_documents(docs, labels).columns == docs.columns
    assert q.quality_scores(empty(spark), labels).count() == 0
    none = q.quality_scores(docs, labels.where("false")).collect()
    assert {r.score for r in none} == {0.5}
    nulls = labels.withColumn("quality", F.lit(None).cast("int"))
    assert {r.score for r in q.quality_scores(docs, nulls).collect()} == {0.5}
    ones = labels.withColumn("quality", F.lit(1))
    assert all(r.predicted == 1 for r in q.quality_scores(table(spark), ones).collect())


def test_stage_keeps_what_is_predicted_good(spark):
    docs, labels = table(spark), table(spark, "labels")
    good = {r.doc_id for r in q.quality_scores(docs, labels).where("predicted = 1").collect()}
    assert {r.doc_id for r in q.good_documents(docs, labels).collect()} == good
    assert documents(spark, "x").count() == 1
