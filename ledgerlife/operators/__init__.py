"""Lifecycle operators: DataFrame in, DataFrame out, no action unless a model is fitted."""
