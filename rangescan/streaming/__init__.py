"""Structured Streaming: fan-out to sinks, time synchronisation, replay."""
