"""Spark-native waveform analytics."""
