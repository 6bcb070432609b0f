"""Compositions of operators, and the views that the registered queries use."""
