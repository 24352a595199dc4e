"""Compositions of operators: the offline build, the online request, the suite."""
