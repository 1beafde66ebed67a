"""Node states of the frontier walks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def next_state(s: Column) -> Column:
    """The ternary ratchet: -1 to 0, 0 to +1, +1 to -1."""
    return F.when(s == -1, 0).when(s == 0, 1).when(s == 1, -1)


def conflict(a: Column, b: Column) -> Column:
    return (a == b).cast("int")


def node_gradient(state: Column, neighbour_state: Column, neighbour_degree: Column) -> Column:
    """What one neighbour adds to the gain of turning a node once: conflicts removed less conflicts made, by degree."""
    return neighbour_degree * (conflict(state, neighbour_state) - conflict(next_state(state), neighbour_state))


def combined_arrival(a: Column, b: Column) -> Column:
    """The later of two arrivals; -1 unless both are there. Missing arrivals are null or negative."""
    return F.when((a >= 0) & (b >= 0), F.greatest(a, b)).otherwise(-1)
