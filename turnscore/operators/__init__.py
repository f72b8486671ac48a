"""turnscore.operators"""
