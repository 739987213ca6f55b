"""Planar road-network division on Spark."""
