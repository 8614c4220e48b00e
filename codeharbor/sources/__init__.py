"""Readers, sinks and the table views the operators run on."""
