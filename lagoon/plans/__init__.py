"""lagoon.plans"""
