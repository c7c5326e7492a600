"""Trajectory and semantic-ID analytics on Spark."""
