"""lagoon.streaming"""
