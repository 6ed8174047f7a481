"""Sensor models, table views and whole segmentation plans."""
