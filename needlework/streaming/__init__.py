"""Scans of unbounded inputs."""
