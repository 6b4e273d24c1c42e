"""lagoon.functions"""
