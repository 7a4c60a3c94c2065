"""The stages of the pipeline, each on its predecessor's rows."""

from collections import Counter

import corpus_pipeline as cp
import pytest
from tests.llm import brute


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for k, (_, stage) in enumerate(cp.STAGES):
        folder = str(tmp_path_factory.mktemp("stages") / str(k))
        before = docs
        stage(spark, docs, sf).write.parquet(folder)
        docs = spark.read.parquet(folder)
        out.append((before, docs))
    return out


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_stages(spark, sf, stages):
    columns = spark.read.parquet(f"{sf}/documents.parquet").columns
    assert all(after.columns == columns for _, after in stages[:-1])
    before, after = map(pairs, stages[0])
    assert 0.5 * len(before) < len(after) < len(before) and not Counter(after) - Counter(before)
    before, after = map(pairs, stages[1])
    kept = {i for i, _, _, k, _ in brute.equal_texts(before) if k}
    assert sorted(i for i, _ in after) == sorted(kept)
    before, after = map(pairs, stages[2])
    keep = brute.linked_components(before, 5, 80)
    assert sorted(i for i, _ in after) == sorted(i for i, c in keep.items() if i == c)
    before, after = map(pairs, stages[3])
    times = Counter(after)
    assert set(times) <= set(before) and max(times.values()) <= 3
    total = sum(len(brute.WORD.findall(brute.utf8(t))) for _, t in before)
    assert sum(len(brute.WORD.findall(brute.utf8(t))) for _, t in after) == pytest.approx(total, rel=0.1)
    before, after = stages[4]
    assert Counter(r.doc_id for r in after.where("piece = 0").collect()) == Counter(i for i, _ in pairs(before))


def test_run(spark, sf, stages):
    whole = cp.run(spark, sf).select("doc_id", "piece", "start", "length", "ids_crc32")
    last = stages[-1][1].select(*whole.columns)
    assert Counter(map(tuple, whole.collect())) == Counter(map(tuple, last.collect()))


@pytest.mark.parametrize("name", [n for n, _ in cp.STAGES])
def test_messy_rows_and_none(spark, sf, frame, nothing, name):
    stage = dict(cp.STAGES)[name]
    for docs in (frame, nothing):
        out = stage(spark, docs, sf)
        rows = out.collect()
        if name != cp.STAGES[-1][0]:
            assert out.columns == docs.columns
        assert bool(rows) == (docs is frame)


def test_near_duplicates_with_null_and_repeated_ids(spark, sf):
    def text(seed, changed=None):
        return " ".join(f"w{seed}x{k}" if k != changed else "changed" for k in range(90))

    rows = [(None, text(1)), (None, text(1, 0)), (None, text(2)), (5, text(3)), (4, text(3, 0)), (5, text(4)), (None, text(5, 89)), (9, text(5)),
            (7, text(6)), (7, text(6, 1)), (None, None), (None, None), (5, "")]
    docs = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id bigint, text string, n int").repartition(4)
    got = cp.near_duplicate_stage(spark, docs, sf)
    assert got.columns == docs.columns
    stays = sorted(r.n for r in got.collect())
    assert [n for n in stays if n not in (0, 1, 8, 9)] == [2, 4, 5, 7, 10, 11, 12]
    assert len({0, 1} & set(stays)) == 1 and len({8, 9} & set(stays)) == 1


def test_near_duplicates_shuffle_few_texts(spark, sf):
    """Where the dropped keys are too many for a broadcast, rows whose key has no dropped one's hash still go on without a shuffle; column names may be any."""
    texts = [" ".join(f"w{k // 2 if k < 20 else k}x{j}" if j or k % 2 else "changed" for j in range(90)) for k in range(60)]
    docs = spark.createDataFrame([(k, t, k, k, k) for k, t in enumerate(texts)], "doc_id bigint, text string, bucket int, dropped int, row_key int")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = cp.near_duplicate_stage(spark, docs, sf)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert got.columns == docs.columns
        assert sorted(r.dropped for r in got.collect()) == [k for k in range(60) if k >= 20 or not k % 2]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "LeftAnti, BuildRight" in "".join(x for x in plan.splitlines() if "BroadcastHashJoin" in x)
