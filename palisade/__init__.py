"""Palisade: threat analytics for web traffic, written as DataFrame plans."""
