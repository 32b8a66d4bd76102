"""Tracked views: stored results, change propagation, incremental and micro-batch refresh."""
