"""Runnable queries over the test tables; importing `catalog` registers them all."""
