"""Batch analytics over long tables of poses, signals, spikes and annotations, on Spark DataFrames."""
