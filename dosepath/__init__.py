"""Spark-first engine for prescription trajectories and corpus preparation."""
