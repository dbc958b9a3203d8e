"""Select source-code repositories for long-context training data, on Spark."""

from repoloom.settings import ScoreWeights, Settings

__all__ = ["ScoreWeights", "Settings"]
