"""Benchmark runs: settings, cases, samples of resource use, reports."""
