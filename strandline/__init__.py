"""Neighbourhood analytics over long sequences, planned by Spark."""
