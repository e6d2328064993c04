"""Whole plans: registered queries, the build, and incremental maintenance."""
