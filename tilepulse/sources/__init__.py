"""Readers and writers: telemetry, the event journal and the tile table."""
