"""Compositions: training, batch prediction, walk-forward backtest, reports."""
