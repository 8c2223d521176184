"""Redundancy of examples: least-squares fits, greedy removal, half-space tests."""
