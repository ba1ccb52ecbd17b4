"""Operators of a training-data pipeline: cleaning, deduplication, mixing, packing and sharding of documents."""
