"""Operators: functions from DataFrames to a DataFrame. Rounds and players are the partition keys throughout."""
