"""lagoon.operators"""
