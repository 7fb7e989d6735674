"""Incremental operators on streams of trees."""
