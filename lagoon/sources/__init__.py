"""lagoon.sources"""
