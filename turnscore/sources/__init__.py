"""turnscore.sources"""
