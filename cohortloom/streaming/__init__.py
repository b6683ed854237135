"""Intentionally empty: every scan of the modelled tool is a whole-file batch read."""
