"""loam.streaming"""
