"""Labels from future steps alone, and filters that do not measure tracks twice."""

from kinepair.operators import pairs, risk, tracks
from kinepair.plans import fixtures
from kinepair.sources.staging import staged


def test_labels_need_no_paths_and_only_future_steps(spark, sf_dir):
    frames = fixtures.frames(spark, sf_dir).where("sc < 2")
    nodes = staged(tracks.build_nodes(frames), "nodes")
    whole = pairs.join_pairs(nodes)
    bare = pairs.join_pairs(nodes.select("scenario_id", "city", "track_id", "cur_x", "cur_y", "future"))
    ids = ["scenario_id", "a_track_id", "b_track_id"]
    # Every pair has a row for each of the 60 future steps, whatever was seen of it.
    steps = pairs.pair_frames(bare, first=50)
    assert steps.count() == 60 * whole.count() > 0 and steps.where("t < 50").count() == 0
    # The same labels as next to the history, which reads all steps.
    both = pairs.summarise_pairs(whole, risk=risk.RiskConfig()).select(*ids, *risk.RISK_COLUMNS)
    alone = risk.dynamic_risk(bare).select(*ids, *risk.RISK_COLUMNS)
    assert sorted(map(str, both.collect())) == sorted(map(str, alone.collect()))


def test_quality_is_not_measured_before_and_after_the_filter(spark, sf_dir):
    built = tracks.build_nodes(fixtures.frames(spark, sf_dir))
    text = built.select("track_id", "num_observed", "pos_jumps", "max_acc", "future")._jdf.queryExecution().optimizedPlan().toString()
    # One measure of jumps per series: x, y, vx, vy and heading, each with two sorted arrays.
    assert text.count("sort_array") <= 12
    # Positions of the last frame are read off the last sample: no path is made for them.
    placed = built.select("track_id", "cur_x", "cur_y")._jdf.queryExecution().optimizedPlan().toString()
    assert "flatten" not in placed
