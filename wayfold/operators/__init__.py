"""Operators over points, cells, edges and solutions; every one is keyed by instance_id."""
