"""turnscore.plans"""
