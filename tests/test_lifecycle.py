import datetime
import random

import pytest
from models import EVENT, NEXT, fold

from conftest import SMALL
from tilepulse.operators import lifecycle
from tilepulse.plans import inputs
from tilepulse.streaming.devices import apply_commands

CMDS = (
    "event_id long, ts timestamp, action string, zoom int, top_left_lat double, "
    "top_left_lng double, bot_right_lat double, bot_right_lng double"
)
ACTIONS = ["create", "ping", "delete", "happy", "sad"]
START = datetime.datetime(2024, 1, 1)


def commands(spark, triples):
    """(seconds, device, action) with the position as the event id; a device is a
    rectangle of its own."""
    rows = [
        (i, START + datetime.timedelta(seconds=s), a, 18, d + 1.0, d + 0.0, d + 0.0, d + 1.0)
        for i, (s, d, a) in enumerate(triples)
    ]
    return spark.createDataFrame(rows, CMDS)


def model(triples):
    ordered = sorted(enumerate(triples), key=lambda p: (p[1][0], p[0]))
    return fold((i, d, a) for i, (_, d, a) in ordered)


def crowd(seed, n, devices=6, ties=False):
    """A third of all commands go to device 0; with ``ties``, many at one time."""
    rng = random.Random(seed)
    triples = []
    for _ in range(n):
        device = 0 if rng.random() < 1 / 3 else rng.randrange(devices)
        second = rng.choice([5, 5, 5, rng.randrange(n)]) if ties else rng.randrange(10 * n)
        triples.append((second, device, rng.choice(ACTIONS)))
    return triples


@pytest.mark.parametrize("state", ["I", "H", "S"])
@pytest.mark.parametrize("action", ACTIONS)
def test_every_cell_of_the_transition_table(state, action):
    after = NEXT[state].get(action, state)
    assert apply_commands(state, [action]) == ([EVENT.get(state + after)], after)


def test_every_cell_through_the_batch_job(spark):
    lead = {"I": [], "H": ["create"], "S": ["create", "sad"]}
    cases = [(s, a) for s in lead for a in ACTIONS]
    triples = [(i, d, a) for d, (s, c) in enumerate(cases) for i, a in enumerate([*lead[s], c])]
    cmds = commands(spark, triples)
    events, states = model(triples)
    got = {(r.event_id, r.event_type) for r in lifecycle.derive_events(cmds).collect()}
    assert got == set(events)
    ends = {int(r.top_left_lng): r.state for r in lifecycle.device_state(cmds).collect()}
    assert ends == states == {d: NEXT[s].get(a, s) for d, (s, a) in enumerate(cases)}


@pytest.mark.parametrize("ties", [False, True])
@pytest.mark.parametrize("chunk_rows", [None, 40, 7])
def test_windows_equal_the_fold_however_devices_are_cut(spark, chunk_rows, ties):
    triples = crowd(17, 900, ties=ties)
    cmds = commands(spark, triples)
    events, states = model(triples)
    got = lifecycle.derive_events(cmds, chunk_rows).collect()
    assert sorted((r.event_id, r.event_type) for r in got) == sorted(events)
    ends = {int(r.top_left_lng): r.state for r in lifecycle.device_state(cmds, chunk_rows).collect()}
    assert ends == states


def test_one_device_without_any_deletes_is_cut_too(spark):
    triples = [(i, 0, ["happy", "sad"][i % 2]) for i in range(60)]
    triples += [(60, 0, "ping")] + [(61 + i, 0, ["happy", "sad"][i % 2]) for i in range(200)]
    got = lifecycle.derive_events(commands(spark, triples), 10).collect()
    assert sorted((r.event_id, r.event_type) for r in got) == sorted(model(triples)[0])


def test_hot_device_is_spread_over_chunks(spark):
    from tilepulse.functions.grid import RECT
    from tilepulse.operators.skew import split_points, with_chunk

    cmds = commands(spark, crowd(23, 900))
    splits = split_points(cmds, RECT, lifecycle.ORDER, 50)
    sizes = with_chunk(cmds, RECT, lifecycle.ORDER, splits).groupBy(*RECT, "chunk").count()
    assert sizes.agg({"count": "max"}).head()[0] <= 100 and sizes.count() > 15
    assert split_points(cmds, RECT, lifecycle.ORDER, 10_000) is None


@pytest.mark.parametrize(
    "folder, counts",
    [
        ("sf0.001", (139, 83, 49, 49, 101, 579)),
        ("sf0.01", (1404, 880, 423, 422, 875, 5996)),
    ],
)
def test_known_outcome_on_the_given_tables(spark, folder, counts):
    history = lifecycle.device_history(inputs.commands(spark, SMALL.replace("sf0.001", folder)))
    got = {r.event_type: r["count"] for r in history.groupBy("event_type").count().collect()}
    names = [*lifecycle.STATE_AFTER, None]
    assert got == dict(zip(names, counts))


def test_replay_gives_the_state_of_devices_that_ever_changed(spark):
    cmds = commands(spark, crowd(31, 400))
    states = {r.top_left_lat: r.state for r in lifecycle.device_state(cmds).collect()}
    rebuilt = lifecycle.replay(lifecycle.derive_events(cmds)).collect()
    assert {r.top_left_lat: r.state for r in rebuilt} == states


def test_outcomes_count_every_command(spark):
    triples = crowd(37, 500)
    rows = lifecycle.command_outcomes(commands(spark, triples)).collect()
    assert sum(r.command_count for r in rows) == 500
    effective = sum(r.command_count for r in rows if r.effective)
    assert effective == len(model(triples)[0])


def test_one_shuffle_for_ordinary_devices(spark):
    plan = lifecycle.derive_events(commands(spark, crowd(1, 50)))._jdf.queryExecution()
    text = plan.executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1 and text.count("Sort [") == 1
