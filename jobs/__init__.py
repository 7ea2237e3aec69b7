"""Runnable jobs over the given tables; jobs.registry has them as queries."""
