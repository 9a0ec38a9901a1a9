"""Readers, writers and mappings to the engine's inputs."""
