"""Plain Python models the Spark jobs are checked against."""

from __future__ import annotations

import math
import random

SPLIT = {0: (1, 2), 1: (3, 3), 2: (3, 3)}  # tiles down and across inside a tile
NEXT = {
    "I": {"create": "H", "ping": "H"},
    "H": {"delete": "I", "sad": "S"},
    "S": {"delete": "I", "happy": "H"},
}
EVENT = {
    "IH": "DeviceActivated",
    "HI": "DeviceDeactivatedHappy",
    "SI": "DeviceDeactivatedSad",
    "SH": "DeviceMadeHappy",
    "HS": "DeviceMadeSad",
}


def descend(zoom: int, lat: float, lng: float):
    """(row, col) by walking down the tile tree: the first child, north to south
    then west to east, whose closed rectangle holds the point."""
    row = col = 0
    top, left, height, width = 90.0, -180.0, 180.0, 360.0
    for level in range(zoom):
        down, across = SPLIT.get(level, (2, 2))
        height, width = height / down, width / across
        for i in range(down):
            if top - (i + 1) * height <= lat <= top - i * height:
                break
        else:
            return None
        for j in range(across):
            if left + j * width <= lng <= left + (j + 1) * width:
                break
        else:
            return None
        row, col = row * down + i, col * across + j
        top, left = top - i * height, left + j * width
    return row, col


def fold(commands, start="I"):
    """Events of (id, device, action) in order, and the end states."""
    states, events = {}, []
    for ident, device, action in commands:
        state = states.get(device, start)
        after = NEXT[state].get(action, state)
        if after != state:
            events.append((ident, EVENT[state + after]))
        states[device] = after
    return events, states


def ulp_neighbours(value: float):
    return [math.nextafter(value, -math.inf), value, math.nextafter(value, math.inf)]


def random_rect(rng: random.Random, size: float, span: float = 95.0):
    """A rectangle, now and then reaching past the rim of the map."""
    top = rng.uniform(-span, span)
    left = rng.uniform(-2 * span, 2 * span)
    return top, left, top - rng.uniform(0.01, 1) * size, left + rng.uniform(0.01, 1) * size


def overlap(a, b) -> bool:
    return a[2] < b[0] and a[0] > b[2] and a[3] > b[1] and a[1] < b[3]


def inside(r, lat, lng) -> bool:
    return r[2] <= lat <= r[0] and r[1] <= lng <= r[3]


def contains(outer, inner) -> bool:
    return inside(outer, inner[0], inner[1]) and inside(outer, inner[2], inner[3])
