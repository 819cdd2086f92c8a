import zlib

import numpy as np
from pyspark.sql import functions as F

from lattica.llm import common as C
from lattica.llm import quality as Y
from lattica.llm import queries as Q


def auc(y, s):
    r = np.argsort(np.argsort(s, kind="stable")) + 1
    n1 = y.sum()
    return (r[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = Q.op6_quality_rules(spark, sf).toPandas()
    assert len(got) == C.table(spark, sf, "documents").count() and got.score.between(0, 1).all()
    assert ((got.score >= 0.5).astype(int) == got.predicted).all()
    assert all(h == (zlib.crc32(str(d).encode()) % 3 == 1) for d, h in zip(got.doc_id, got.held_out))
    m = got.merge(C.table(spark, sf, "labels").toPandas(), on="doc_id")
    m = m[m.held_out]
    assert auc(m.quality.to_numpy(), m.score.to_numpy()) > 0.97


def test_held_out_labels_are_not_learned(spark, sf):
    docs, labels = C.table(spark, sf, "documents"), C.table(spark, sf, "labels")
    turned = labels.withColumn("quality", F.when(Y.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert Y.train(docs, labels) == Y.train(docs, turned)


def test_column_equals_rules(spark, sf):
    docs = C.table(spark, sf, "documents")
    model = Y.train(docs, C.table(spark, sf, "labels"))
    x = Y.with_statistics(docs).select("doc_id", "__stats.*").orderBy("doc_id").toPandas()
    z = model.bias + sum(w * r.holds(x[list(Y.FEATURES)].to_numpy()) for r, w in zip(model.rules, model.weights))
    got = Y.score(docs, model).orderBy("doc_id").toPandas().score
    assert model.rules and np.allclose(got, 1 / (1 + np.exp(-z)))


def test_edges(spark, sf):
    rows = [(1, None), (None, ""), (2, " \n"), (2, "word " * 9000), (3, "x" * 100_000), (4, "***")]
    df = spark.createDataFrame([(d, t, 1, 0.2) for d, t in rows], "doc_id long, text string, n int, score double")
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 1), (None, 0, 0), (2, 0, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    for lab in (labels, labels.limit(0), C.table(spark, sf, "labels")):
        out = Y.score(df.drop("score"), Y.train(df.drop("score"), lab)).collect()
        assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    assert Y.score(df.limit(0), Y.train(df.limit(0), labels)).count() == 0
