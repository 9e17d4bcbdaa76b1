"""Queries next to their SQL where the last video has only a few frames, as in tables of any size."""

import os

import check_oracle
import pytest

from strideflow.operators import masks as M
from strideflow.plans import carriers as C
from strideflow.plans import registry

SF = "/root/testdata/sf0.001"
registry.load()


@pytest.fixture(scope="module")
def short(spark, tmp_path_factory):
    """The smallest tables with embeddings cut in the middle of the third video, after six frames."""
    at = tmp_path_factory.mktemp("short")
    for t in check_oracle.TABLES:
        if t != "embeddings":
            os.symlink(f"{SF}/{t}.parquet", at / f"{t}.parquet")
    spark.read.parquet(f"{SF}/embeddings.parquet").filter("vec_id < 106").toPandas().to_parquet(at / "embeddings.parquet")
    return str(at)


def same(spark, short, *names):
    con = check_oracle.duck(short)
    for name in names:
        problem, rows = check_oracle.compare(spark, con, short, name, registry.QUERIES[name], registry.ORACLES[name])
        assert problem is None and rows, name


def test_seeds_reach_only_frames_that_exist(spark, short):
    same(spark, short, "e27_nearest_seed_wins")


@pytest.mark.parametrize("name", ["m10_rasterise_polygons", "m10_mask_cells", "m10_mask_spans", "j7_mask_overlap", "j8_patch_fraction", "j9_surface", "m9_mask_edit"])
def test_masks_of_a_video_with_one_keyframe(spark, short, name):
    same(spark, short, name)


def test_operator_still_wants_five_keyframes(spark, short):
    from strideflow.plans import join_queries as JQ  # after the modules it needs

    made, _ = M.rasterise_polygons(C.frames(spark, short), JQ.drawn_keyframes(spark, short))
    assert {r.video_id for r in made.select("video_id").distinct().collect()} == {"0", "1"}


@pytest.mark.parametrize("name", ["m3_rebuild_confidence", "m3_rebuild_phases", "m3_rebuild_contacts"])
def test_markers_beyond_the_last_frame(spark, short, name):
    same(spark, short, name)


def test_totals_of_a_video_without_a_speed(spark, short, tmp_path):
    """Nobody is seen in the first video, so its hops have no length: SQL's mean speed is null, the panel's own 0."""
    for t in check_oracle.TABLES:
        if t != "embeddings":
            os.symlink(f"{SF}/{t}.parquet", tmp_path / f"{t}.parquet")
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").filter("vec_id < 200").toPandas()
    for i in rows.index[rows.vec_id < 50]:
        # neither a person nor a sure keypoint
        rows.at[i, "embedding"] = [-1.0 if k == 34 else 0.0 if k < 33 and k % 3 == 2 else v for k, v in enumerate(rows.at[i, "embedding"])]
    rows.to_parquet(tmp_path / "embeddings.parquet")
    same(spark, str(tmp_path), "a18_panel_totals")
    got = {r.video_id: r.avg_speed for r in registry.QUERIES["a18_panel_totals"](spark, str(tmp_path)).collect()}
    assert got["0"] is None and got["1"] > 0
