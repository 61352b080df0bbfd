"""loam.sources"""
