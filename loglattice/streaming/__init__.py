"""Streams of export requests into a store."""
