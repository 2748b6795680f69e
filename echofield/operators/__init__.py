"""Operators: sampling, graph, exposure, state, metrics, bandit, statistics, calibration."""
