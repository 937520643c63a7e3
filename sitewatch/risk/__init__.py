"""Landmark model of subject dropout: features, folds, training, scoring."""
