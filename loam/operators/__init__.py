"""loam.operators"""
