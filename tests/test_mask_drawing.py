"""Masks are drawn once, in all partitions, however few bytes their polygons have."""

from strideflow.operators import contacts as K
from strideflow.plans import registry

SF = "/root/testdata/sf0.001"
registry.load()


def test_frames_are_drawn_in_all_partitions(spark):
    from strideflow.plans import join_queries as JQ

    spans = JQ.drawn(spark, SF)[1]
    assert spans.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_detection_draws_masks_once(spark, monkeypatch):
    """Both tables come from the stored drawing, not from the frames again, and are those of the operator."""
    from strideflow.plans import join_queries as JQ

    given = {}
    detect = K.detect_contacts

    def seen(frames, prototypes, spans, mask_frames, keyframes):
        given.update(spans=spans, mask_frames=mask_frames)
        return detect(frames, prototypes, spans, mask_frames, keyframes)

    monkeypatch.setattr(K, "detect_contacts", seen)
    assert registry.QUERIES["e5_detect_contacts"](spark, SF).count()
    for table, plain in zip((given["mask_frames"], given["spans"]), JQ.drawn(spark, SF, JQ.M.MIN_KEYFRAMES)):
        assert "parquet" not in table._jdf.queryExecution().optimizedPlan().toString().lower()
        assert sorted(map(tuple, table.collect())) == sorted(map(tuple, plain.collect()))
