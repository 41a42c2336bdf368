"""Trajectory analytics on Spark: gaps, interpolation, road matching, travel time."""
