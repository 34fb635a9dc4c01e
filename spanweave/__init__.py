"""Timeline analytics on Spark DataFrames: cues, words, shots, samples and findings."""

__version__ = "0.1.0"
