"""The dynamic-risk label on motions whose margin is known in closed form, and against a step-by-step check."""

import random

import pytest
from kinepair.config import RiskConfig, stored_risk_config
from kinepair.operators.risk import dynamic_risk

from helpers import future_pair


def label(spark, distances, valid=None, **config):
    return dynamic_risk(future_pair(spark, distances, valid), RiskConfig(**config)).first()


def by_steps(distances, valid, cfg):
    """(computable, label, longest run, margins): slope of a line through a full window of valid samples, then the margin at its middle."""
    half, dt = cfg.closing_speed_window_frames // 2, cfg.future_dt_seconds
    margins = {}
    for i in range(half, len(distances) - half):
        window = range(i - half, i + half + 1)
        if all(valid[k] for k in window):
            mean = sum(distances[k] for k in window) / len(window)
            slope = sum((k - i) * (distances[k] - mean) for k in window) / sum((k - i) ** 2 for k in window) / dt
            speed = max(0.0, -slope)
            margins[i] = distances[i] - (cfg.risk_base_distance_m + cfg.risk_reaction_time_s * speed + speed * speed / (2 * cfg.risk_safe_decel_mps2))

    def longest(ok):
        best = run = 0
        for i in range(len(distances)):
            run = run + 1 if i in margins and ok(margins[i]) else 0
            best = max(best, run)
        return best

    computable = longest(lambda m: True) >= cfg.min_risk_consecutive_frames
    bad = longest(lambda m: m <= 0)
    return computable, int(computable and bad >= cfg.min_risk_consecutive_frames), bad if computable else 0, margins


@pytest.mark.parametrize("gap, speed, reaction, decel", [(31.0, 0.7, 0.4, 2.5), (12.5, 1.1, 0.0, 6.0), (44.0, 2.3, 1.2, 3.5), (9.0, 0.0, 2.0, 1.0)])
def test_uniform_approach_has_a_closed_form(spark, gap, speed, reaction, decel):
    """gap - speed * t: the margin falls evenly, so it is least at the last step with a full window."""
    steps, dt, base = 14, 0.5, 3.25
    row = label(spark, [gap - speed * dt * t for t in range(steps)], risk_base_distance_m=base, risk_reaction_time_s=reaction, risk_safe_decel_mps2=decel, future_dt_seconds=dt)
    last = steps - 3 if speed else 2
    want = gap - speed * dt * last - (base + reaction * speed + speed * speed / (2 * decel))
    assert row.dynamic_margin_min == pytest.approx(want, abs=1e-9)
    assert row.closing_speed_at_risk == pytest.approx(speed, abs=1e-9)
    assert row.dynamic_risk_step == last


def test_moving_apart_needs_only_the_base_distance(spark):
    row = label(spark, [7.5 + 1.3 * t for t in range(11)], risk_base_distance_m=2.5, risk_reaction_time_s=3.0)
    assert (row.label_dynamic_risk, row.violation_run_max) == (0, 0)
    assert row.dynamic_margin_min == pytest.approx(7.5 + 1.3 * 2 - 2.5)


@pytest.mark.parametrize("seed", range(12))
def test_random_gaps_equal_the_steps(spark, seed):
    rng = random.Random(seed)
    cfg = {"closing_speed_window_frames": rng.choice([3, 5, 7]), "min_risk_consecutive_frames": rng.choice([1, 2, 4]), "risk_base_distance_m": rng.uniform(2, 9),
           "risk_reaction_time_s": rng.uniform(0, 2), "risk_safe_decel_mps2": rng.uniform(1, 6), "future_dt_seconds": rng.choice([0.1, 0.5])}
    distances, at = [], rng.uniform(5, 25)
    for _ in range(rng.randrange(6, 55)):
        at = abs(at + rng.gauss(-0.15, 0.6))
        distances.append(round(at, 3))
    valid = [rng.random() < 0.85 for _ in distances]
    row, (computable, risky, run, margins) = label(spark, distances, valid, **cfg), by_steps(distances, valid, RiskConfig(**cfg))
    assert (row.dynamic_computable, row.label_dynamic_risk, row.violation_run_max) == (computable, risky, run)
    if computable and not risky:
        assert row.dynamic_margin_min == pytest.approx(min(margins.values()))
    if not computable:
        assert row.dynamic_margin_min is None


def test_configuration_values_and_stored_digest():
    plain = RiskConfig()
    assert len({c.sha256() for c in (plain, RiskConfig(), RiskConfig(risk_safe_decel_mps2=4.5))}) == 2
    for field, value in (("risk_safe_decel_mps2", -1.0), ("future_dt_seconds", float("inf")), ("closing_speed_window_frames", 6), ("min_risk_consecutive_frames", 1.5),
                         ("risk_reaction_time_s", -0.1), ("closing_speed_method", "two_point")):
        with pytest.raises(ValueError, match=field):
            RiskConfig(**{field: value})
    fields = dict(vars(plain))
    assert stored_risk_config({"label_config": fields, "label_config_hash": plain.sha256()}) == plain == stored_risk_config({"label_config": fields})
    for record in ({}, {"label_config": fields, "label_config_hash": RiskConfig(risk_base_distance_m=6.0).sha256()}):
        with pytest.raises(ValueError, match="run record"):
            stored_risk_config(record)
