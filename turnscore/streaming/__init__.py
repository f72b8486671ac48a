"""turnscore.streaming"""
