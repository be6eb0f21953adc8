"""Trainers: iterative plans with one Spark job an iteration."""
