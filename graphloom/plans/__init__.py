"""Compositions of operators: evaluation, sweeps, registered queries."""
