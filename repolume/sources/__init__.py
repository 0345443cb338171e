"""Feeds in, tables out, table maintenance, thresholds, SQL entry."""
