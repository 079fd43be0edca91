"""Fiberlake: labelled multi-dimensional sensor data as Spark plans."""
