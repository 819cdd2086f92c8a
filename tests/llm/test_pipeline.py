import re

import corpus_pipeline as P
from lattica.llm import common as C
from lattica.llm import quality
from tests.llm.test_decontaminate import brute
from tests.llm.test_near_dup import staying


def test_every_stage_against_brute_force(spark, tmp_path):
    sf = "/root/testdata/sf0.01"
    docs = C.table(spark, sf, "documents")
    columns = docs.columns
    seen = []
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        assert k == len(P.STAGES) - 1 or out.columns == columns
        seen.append((docs, out))
        docs = out
    rows = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()))
    before, after = map(rows, seen[0])
    bad = {r.doc_id for r in C.table(spark, sf, "labels").where("quality = 0").collect()}
    good = {r.doc_id for r in C.table(spark, sf, "labels").where("quality = 1").collect()}
    left = {d for d, _ in after}
    assert len(bad & left) <= 0.03 * len(bad) and len(good - left) <= 0.01 * len(good) and len(after) < len(before)
    before, after = map(rows, seen[1])
    assert after == sorted(staying(before))
    before, after = map(rows, seen[2])
    leaked = {d for d, _ in brute(before, [(r.item_id, r.text) for r in C.table(spark, sf, "benchmark").collect()])}
    assert leaked and after == [x for x in before if x[0] not in leaked]
    before, after = map(rows, seen[3])
    assert [d for d, _ in before] == [d for d, _ in after]
    hide = lambda t: re.sub(r"AKIA[0-9A-Z]{16}|(?<=password=)[0-9a-f]{18}|(?<=token = \")[0-9a-f]{40}", "<secret>", t)
    assert [t for _, t in after] == [hide(t) for _, t in before]
    assert all(r.n_chars == len(r.text) for r in seen[3][1].collect())
    mix = seen[4][1].collect()
    assert len(mix) == len(after) and abs(sum(r.taken for r in mix) - 1.5 * sum(r.size for r in mix)) < 100


def test_run(spark, sf):
    out = P.run(spark, sf)
    assert out.columns == ["doc_id", "source", "size", "source_size", "target", "copies", "taken"] and out.count() > 0
    assert P.ORACLE_SQL is None and quality.SAMPLE_ROWS > 0
