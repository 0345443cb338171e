"""Incremental jobs: ingest, daily rollup, streamed counts and de-duplication."""
