"""Settings of the session."""

from __future__ import annotations

import pytest

from tallywright.session import INITIAL_PARTITIONS, SETTINGS, default_partitions, shuffle_partitions


@pytest.mark.parametrize(
    ("size", "partitions"), [(0, 200), (10**9, 200), (200 * 64 * 1024**2 + 1, 201), (10**13, 149012)]
)
def test_partitions_grow_with_the_shuffle(size, partitions):
    assert shuffle_partitions(size) == partitions


def test_settings_are_in_force(spark):
    for key, value in SETTINGS.items():
        assert spark.conf.get(key).lower() == value.lower()


def test_shuffles_start_wide_unless_told():
    assert int(default_partitions(None, {})[INITIAL_PARTITIONS]) >= 4096
    assert default_partitions(None, {"spark.sql.shuffle.partitions": "8"}) == {}
    assert default_partitions(10**13, {}) == {"spark.sql.shuffle.partitions": "149012"}
